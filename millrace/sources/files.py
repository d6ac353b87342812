"""Files in and out: CSV, JSON, JSON lines, text, sitemaps, reports."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import squeeze, strip_tags


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header, doubled quotes, cells trimmed, blank lines dropped; with multi_line, quoted line breaks."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True)
    reader = reader.option("ignoreTrailingWhiteSpace", True).option("multiLine", multi_line).option("encoding", "UTF-8").option("mode", "PERMISSIVE")
    found = (reader.schema(schema) if schema else reader).csv(path)
    return found.toDF(*[c.lstrip("\ufeff") for c in found.columns])


def read_plain_csv(spark: SparkSession, path: str, columns: list[str], first_by: str | None = None) -> DataFrame:
    """Lines split at every comma, without quoting; the header line is left out. With ``source_file``.

    first_by: a column of which each value keeps its first row only, by file and place in it.
    """
    cells = F.split("value", ",")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(*[F.trim(F.get(cells, F.lit(i))).alias(c) for i, c in enumerate(columns)], F.col("_metadata.file_path").alias("source_file"))
    rows = rows.filter(F.col(columns[0]) != columns[0])
    if first_by is None:
        return rows
    placed = rows.withColumn("_place", F.monotonically_increasing_id())  # grows along a file
    return placed.groupBy(first_by).agg(F.min(F.struct("source_file", "_place", *[c for c in columns if c != first_by])).alias("_r")).select(*[first_by if c == first_by else F.col(f"_r.{c}") for c in columns], "_r.source_file")


def read_json_rows(spark: SparkSession, path: str, schema: str, rows: str | None = None) -> DataFrame:
    """A JSON array of objects; or the array under a key of one object. Fails on anything else."""
    if rows is None:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    whole = spark.read.schema(f"`{rows}` array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.inline(rows))


def read_folder(spark: SparkSession, path: str, schema: str, required: str, pattern: str = "*.json", named: str | None = None, with_csv: bool = False) -> DataFrame:
    """Every JSON file below a folder that can be read, with ``source_file``; rows without the required column are dropped.

    named: a regular expression that file names must match. with_csv: CSV files with a header (whose names must be
    the schema's) are read too.
    """
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True)
    files = [reader.json(path)]
    if with_csv:
        cells = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("quote", '"').option("escape", '"')
        cells = cells.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("ignoreCorruptFiles", True)
        files.append(cells.csv(path))
    rows = [f.filter(F.rlike(F.col("_metadata.file_name"), F.lit(named))) if named else f for f in files]
    found = [r.select("*", F.col("_metadata.file_path").alias("source_file")).filter(F.col(required).isNotNull()) for r in rows]
    return found[0].unionByName(found[1]) if with_csv else found[0]


def read_quarantined(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """The rows of every JSON document below a folder, and what can't be read: source_file, reason, content.

    A file that isn't JSON, or a value in it that doesn't fit its column, is a row of the second frame; rows that can
    be read are in the first, whatever else is in their file. Both have ``source_file``. Each file is one document; a file
    of no bytes has no rows in either.
    """
    texts = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    trimmed = F.trim(F.regexp_replace("value", r"\s+", " "))
    # a document is a list of objects, or one object; what is left over of a row that doesn't fit is in _bad
    kept = F.when(F.startswith(trimmed, F.lit("[")), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    parsed = texts.withColumn("_items", F.from_json(kept, "array<string>", {"mode": "PERMISSIVE"})).withColumn("_read", F.try_parse_json("value").isNotNull())
    whole = parsed.filter("_read and value != ''")
    items = whole.select("source_file", F.explode("_items").alias("item"))
    fitted = items.withColumn("row", F.from_json("item", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    columns = [f.name for f in fitted.schema["row"].dataType if f.name != "_bad"]
    rows = fitted.filter("row._bad is null").select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "source_file")
    broken = parsed.filter("not _read or value = ''").select("source_file", F.lit("not JSON").alias("reason"), F.col("value").alias("content"))
    return rows, broken.unionByName(fitted.filter("row._bad is not null").select("source_file", F.lit("does not fit").alias("reason"), F.col("item").alias("content")))


def read_sources(spark: SparkSession, sources: dict[str, str], schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of several Parquet sources, with ``source``, and a row for each source: source, status (OK or FAILED), reason, n.

    A source that can't be opened fails alone: it has no rows, its n is null, not 0, and the others are read. Only the
    paths and columns are looked at here; what breaks while rows are read breaks the query.
    """
    found, states = [], []
    wanted = spark.createDataFrame([], schema)
    for name, path in sources.items():
        try:
            rows = spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in wanted.schema])
            found.append(rows.withColumn("source", F.lit(name)))
            states.append((name, "OK", None))
        except AnalysisException as e:
            states.append((name, "FAILED", (e.getCondition() or "unknown")))
    rows = reduce(DataFrame.unionByName, found, wanted.withColumn("source", F.lit(None).cast("string")))
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    status = spark.createDataFrame(states, "source string, status string, reason string").join(counts, "source", "left")
    return rows, status.select("source", "status", "reason", F.when(F.col("status") == "OK", F.coalesce("n", F.lit(0))).alias("n"))


def read_state(spark: SparkSession, path: str, schema: str, key: str, at: str) -> DataFrame:
    """A JSON-lines log, each key's last entry."""
    rows = spark.read.schema(schema).json(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(at)).alias("_last")).select("_last.*")


def append_state(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = False, mark: bool = False) -> None:
    """CSV with a header; arrays become lists joined by `` | ``. mark: files begin with a byte order mark, for spreadsheets."""
    flat = [F.array_join(c, " | ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    out = df.select(*flat)
    if mark:
        out = out.withColumnRenamed(out.columns[0], f"\ufeff{out.columns[0]}")
    out.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_buckets(df: DataFrame, path: str, bucket: str) -> DataFrame:
    """A folder for each bucket; returns the number of rows of each."""
    df.write.mode("overwrite").partitionBy(bucket).parquet(path)
    return df.groupBy(bucket).count()


def write_report(df: DataFrame, path: str, summary: DataFrame) -> None:
    """Rows and their summary as JSON, side by side."""
    df.write.mode("overwrite").json(f"{path}/rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def markdown_report(title: str, totals: dict[str, int], codes: DataFrame, issues: DataFrame, top_codes: int = 30, first_issues: int = 100) -> str:
    """A report of totals, the most frequent codes and the first issues in the order of their columns; only those rows reach the driver."""
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", *[f"- {k}: {v}" for k, v in totals.items()], "", "| code | n |", "|-|-|"]
    lines += [f"| {cell(r['code'])} | {r['n']} |" for r in codes.orderBy(F.desc("n"), "code").limit(top_codes).collect()]
    lines += ["", f"| {' | '.join(issues.columns)} |", f"|{'-|' * len(issues.columns)}"]
    lines += [f"| {' | '.join(cell(x) for x in r)} |" for r in issues.orderBy(*issues.columns).limit(first_issues).collect()]
    return "\n".join(lines) + "\n"


def write_distinct_text(df: DataFrame, column: str, path: str, by: str | None = None) -> None:
    """One file with each value on a line, sorted, or in the order of ``by`` in which they come first."""
    values = df.groupBy(column).agg(F.min(by or column).alias("_first")).orderBy("_first", column)
    values.select(column).coalesce(1).write.mode("overwrite").text(path)


def sitemap_locations(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*([^<]+?)\s*</loc>"), 1)


def walk_sitemaps(files: DataFrame, roots: DataFrame, depth: int = 5, strict: bool = False) -> DataFrame:
    """url: the distinct pages that sitemaps lead to, from files (url, xml) and the urls of roots, through indexes of
    sitemaps and those they list, ``depth`` levels of them at most; a sitemap is read once. Sitemaps below that aren't
    read: there is a warning, or (strict) an error."""
    level, seen, found = roots.select("url").distinct(), roots.select("url").distinct(), None
    for _ in range(depth):
        read = files.join(level, "url").select(F.contains("xml", F.lit("<sitemapindex")).alias("index"), F.explode(sitemap_locations(F.col("xml"))).alias("url"))
        pages = read.filter("not index").select("url")
        found = pages if found is None else found.unionByName(pages)
        level = read.filter("index").select("url").distinct().join(seen, "url", "left_anti")
        seen = seen.unionByName(level)
    if not files.join(level, "url", "left_semi").isEmpty():
        if strict:
            raise ValueError(f"sitemaps are nested deeper than {depth} levels")
        warnings.warn(f"sitemaps deeper than {depth} levels are left out", stacklevel=2)
    return found.distinct()


def page_links(html: Column) -> Column:
    """Structs (href, label) of a page's anchors, one for each href: the last."""
    anchor = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    hrefs, labels = F.regexp_extract_all(html, F.lit(anchor), 1), F.regexp_extract_all(html, F.lit(anchor), 2)
    zipped = F.zip_with(hrefs, labels, lambda h, t: F.struct(h.alias("href"), strip_tags(t).alias("label")))
    return F.filter(zipped, lambda x, i: ~F.exists(F.slice(hrefs, i + 2, F.greatest(F.size(hrefs), F.lit(1))), lambda h: h == x["href"]))


def page_evidence(html: Column) -> Column:
    """A struct of a page's title (300 characters), headings (30), calls to action (50) and body text (24 000), with a digest."""
    no_code = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>|<!--.*?-->", " ")
    title = F.left(squeeze(strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(300))
    texts = lambda pattern, most: F.slice(F.filter(F.transform(F.regexp_extract_all(no_code, F.lit(pattern), 2), lambda t: strip_tags(t)), lambda t: t != ""), 1, most)
    headings = texts(r"(?is)<(h[1-3])\b[^>]*>(.*?)</h[1-3]>", 30)
    actions = F.slice(F.filter(texts(r"(?is)<(a|button)\b[^>]*>(.*?)</(?:a|button)>", 10_000), lambda t: F.length(t).between(2, 120)), 1, 50)
    body = F.left(strip_tags(F.regexp_replace(no_code, r"(?is)<head\b.*?</head>", " ")), F.lit(24_000))
    evidence = F.struct(title.alias("title"), headings.alias("headings"), actions.alias("actions"), body.alias("body"))
    return F.struct(evidence.alias("evidence"), F.sha2(F.to_json(evidence), 256).alias("digest"))


def json_ld(html: Column) -> Column:
    """The texts of a page's JSON-LD blocks; those that aren't JSON are left out."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    return F.filter(F.transform(blocks, lambda b: F.trim(b)), lambda b: F.get_json_object(b, "$").isNotNull())


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_ld_objects(blocks: pd.Series) -> pd.Series:
    """Every object in some JSON texts (an array of strings), however deep in lists and other objects, as JSON."""

    def objects(value) -> Iterator[dict]:
        todo = [value]
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                yield x
            if isinstance(x, dict | list):
                todo += reversed([*x.values()] if isinstance(x, dict) else x)

    def read(text: str):
        try:
            return json.loads(text)
        except ValueError:
            return None

    return pd.Series([None if own is None else [json.dumps(o, ensure_ascii=False) for t in own for o in objects(read(t))] for own in blocks], dtype=object)
