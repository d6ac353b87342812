"""Compares a query's rows with those of its SQL counterpart in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def views():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


#: Queries that SQL can't tell, each compared with a plain version elsewhere in the tests.
BRUTE_FORCE = {
    "op1_pack": "tests/llm/test_packing.py",
    "op2_edited_counts": "tests/llm/test_tokens.py",
    "op3_page_text": "tests/llm/test_wrapper.py",
    "op5_ngram_join": "tests/llm/test_jaccard.py",
    "op6_line_rules": "tests/llm/test_small_ops.py",
    "op7_language": "tests/llm/test_small_ops.py",
    "op9_repeated_strings": "tests/llm/test_repeats.py",
    "op12_importance_resampling": "tests/llm/test_resample.py",
    "op13_repeated_windows": "tests/llm/test_blocks.py",
}


def same(spark, con, query, sql):
    assert sql or query.__name__ in BRUTE_FORCE, "neither SQL nor a plain version"
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if sql is None:
        return True
    found = con.sql(sql)
    at = {c: i for i, c in enumerate(found.columns)}
    assert sorted(at) == columns
    want = sorted(str([plain(r[at[c]]) for c in columns]) for r in found.fetchall())
    return got == want
