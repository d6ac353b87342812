"""A table in a folder that plans are applied to: touched partitions are written anew, one renamed file publishes them.

A manifest names the folder of each partition. Applying a plan reads only partitions that its keys are in (or that its
rows move to), checks the plan's guard against what is written there, writes these partitions beside the old ones, and
publishes by renaming a new manifest into place. Readers see the old table or the new one; files of other partitions keep
their names; a run that is lost before the rename has changed nothing, and a plan that was applied is not applied again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.plans.changes import Plan, StalePlan


def _part(by: str):
    """A partition's name in paths: letters and digits, whatever its value."""
    text = F.col(by).cast("string")
    return F.when(text.isNull(), "n").otherwise(F.concat(F.lit("v"), F.hex(F.encode(text, "utf-8"))))


class StoredTable:
    """Rows with a unique key, dealt into partitions by a column of few values."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def create(df: DataFrame, root: str, key: list[str], by: str) -> StoredTable:
        out = StoredTable(df.sparkSession, root)
        out._publish(0, {"key": key, "by": by, "schema": df.schema.json(), "applied": [], "parts": out._write(df, by)})
        return out

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, rows: DataFrame, by: str) -> dict[str, str]:
        """The folder of each partition that has rows."""
        version = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_part", _part(by)).repartition("_part").write.partitionBy("_part").parquet(f"{self.root}/{version}")
        path, fs = self._path(version)
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return {n.removeprefix("_part="): f"{version}/{n}" for n in names if n.startswith("_part=")}

    def _publish(self, number: int, manifest: dict) -> None:
        draft, fs = self._path(f"draft-{uuid.uuid4().hex}")
        target, _ = self._path(f"manifest-{number:08d}.json")
        if fs.exists(target):
            raise StalePlan(f"{self.root} has changed meanwhile")
        stream = fs.create(draft, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if not fs.rename(draft, target):
            raise StalePlan(f"{self.root} has changed meanwhile")

    def manifest(self) -> tuple[int, dict]:
        path, fs = self._path("")
        names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("manifest-"))
        text = self.spark.read.text(f"{self.root}/{names[-1]}", wholetext=True).first().value
        return int(names[-1][9:17]), json.loads(text)

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The rows of all partitions, or of those with these names."""
        _, manifest = self.manifest()
        return self._rows(manifest, parts)

    def _rows(self, manifest: dict, parts: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        folders = [f"{self.root}/{f}" for p, f in manifest["parts"].items() if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def apply(self, plan: Plan) -> bool:
        """Whether the plan was applied now; not if it was before. StalePlan if a row that it changes isn't what it was."""
        number, manifest = self.manifest()
        if plan.plan_id in manifest["applied"]:
            return False
        by = manifest["by"]
        held = self._rows(manifest).select(*plan.key, _part(by).alias("_part")).join(plan.actions.select(*plan.key).distinct(), plan.key, "left_semi")
        touched = held.select("_part")
        if by in plan.actions.columns:
            touched = touched.union(plan.actions.filter(F.col(by).isNotNull()).select(_part(by).alias("_part")))
        names = [r[0] for r in touched.distinct().collect()]  # of a table's few partitions
        changed = plan.apply(self._rows(manifest, names))
        kept = {p: f for p, f in manifest["parts"].items() if p not in names}
        self._publish(number + 1, manifest | {"applied": [*manifest["applied"], plan.plan_id], "parts": kept | self._write(changed, by)})
        return True
