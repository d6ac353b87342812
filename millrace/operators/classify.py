"""Rule tables as Column expressions: guard clauses, additive evidence, taxonomy rules, issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.rank import winner_margin


def guarded(clauses: list[tuple[Column, str, str]], default: tuple[str, str]) -> Column:
    """A struct (bucket, reason) of the first clause that holds."""
    out = F.struct(F.lit(default[0]).alias("bucket"), F.lit(default[1]).alias("reason"))
    for test, bucket, reason in reversed(clauses):
        out = F.when(test, F.struct(F.lit(bucket).alias("bucket"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def additive(parts: list[tuple[Column, int, str]], most: int = 100, caps: list[tuple[Column, int]] | None = None) -> Column:
    """A struct (score, reasons): points of what holds, from 0 to ``most``, under the cap of each guard that holds."""
    total = reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p, _ in parts])
    score = F.greatest(F.lit(0), F.least(F.lit(most), total, *[F.when(c, cap).otherwise(most) for c, cap in caps or []]))
    reasons = F.filter(F.array(*[F.when(c, F.lit(r)) for c, _, r in parts]), lambda r: r.isNotNull())
    return F.struct(score.alias("score"), reasons.alias("reasons"))


def taxonomy(df: DataFrame, id_col: str, rules: list[tuple[str, str, int]], scopes: dict[str, int], least: int = 100, margin: int = 18) -> DataFrame:
    """id_col, winner, top, second, decided: categories by (category, pattern, weight) rules over text columns.

    scopes: what each text column adds to a rule's weight. A category scores the highest of its rules and 3 for
    each further one that matches. Rules are evaluated in the scan, without a join.
    """
    hits = []
    for category, pattern, weight in rules:
        best = F.greatest(*[F.when(F.rlike(F.coalesce(F.col(c), F.lit("")), F.lit(pattern)), weight + plus) for c, plus in scopes.items()], F.lit(None).cast("int"))
        hits.append(F.struct(F.lit(category).alias("category"), best.alias("points")))
    rows = df.select(id_col, F.explode(F.filter(F.array(*hits), lambda h: h["points"].isNotNull())).alias("h"))
    scored = rows.groupBy(id_col, "h.category").agg((F.max("h.points") + 3 * (F.count("*") - 1)).alias("points"))
    return winner_margin(scored, id_col, "category", "points", least, margin)


def issues(df: DataFrame, id_col: str, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """id_col, severity, code, detail: a row for each (severity, code, test, detail) rule that a row breaks, in one pass."""
    found = F.array(*[F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), detail.cast("string").alias("detail"))) for s, c, test, detail in rules])
    return df.select(id_col, F.inline(F.filter(found, lambda x: x.isNotNull())))


def issue_histogram(found: DataFrame, id_col: str) -> DataFrame:
    return found.groupBy("severity", "code").agg(F.count("*").alias("n"), F.countDistinct(id_col).alias("entities"))
