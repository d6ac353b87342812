"""The size of the batches in which texts reach Python, and names for columns beside those of a caller's table."""

from __future__ import annotations

from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def bound_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Has the session send at most so many megabytes of texts to a Python worker at once; never raises its setting.

    A batch is in memory several times over (in Spark, in Arrow, as Python objects), in each running task. The bound
    has to hold when a returned frame is run, so it stays the session's setting.
    """
    now = (spark.conf.get(_KEY, None) or f"{1 << 40}").strip().lower().removesuffix("ib")
    now = now[:-1] if now.endswith("b") and now[-2:-1] in _UNITS else now
    size = int(now[:-1]) * _UNITS[now[-1]] if now[-1] in _UNITS else int(now)
    if size > megabytes << 20:
        spark.conf.set(_KEY, f"{megabytes}m")


def unused(columns: list[str], *names: str) -> tuple[str, ...]:
    """These names, each with as many underscores in front as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)
