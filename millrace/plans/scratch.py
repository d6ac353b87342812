"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of tables, with the owner that was set when they were written.
_written: list[tuple[str | None, str]] = []
_owner: str | None = None


@contextmanager
def owned_by(owner: str):
    """Tables written inside belong to this owner, and can be dropped together."""
    global _owner
    before, _owner = _owner, owner
    try:
        yield
    finally:
        _owner = before


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a local master may go without that setting: it then gets a temporary folder, which is
    recorded in the session so that later calls use the same one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str = "snappy", most_files: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns it reread.

    Cuts lineage: what is made from the result needs no more than these files when executors are lost. most_files
    is for callers that know about how many rows there are: a few rows in hundreds of files cost more than the rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    writer = (df.coalesce(most_files) if most_files else df).write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    remember(path)
    return spark.read.schema(df.schema).parquet(path)


def remember(path: str) -> None:
    """Has drop_tables() delete a table that was written by other means."""
    _written.append((_owner, path))


def drop_tables(spark: SparkSession, owner: str) -> None:
    """Deletes an owner's tables. Only for callers that have stored everything that was made from them."""
    for entry in [e for e in _written if e[0] == owner]:
        drop_path(spark, entry[1])
        _written.remove(entry)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table that a caller wrote, and no longer needs."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir.rstrip('/')}/{name}.parquet")
