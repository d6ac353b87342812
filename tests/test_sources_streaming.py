import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.sources import files
from millrace.streaming import replay, views


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id, name\n1, "x ""q"", y"\n\n2,  plain \n', encoding="utf-8")
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "a.csv")).collect())) == [("1", 'x "q", y'), ("2", "plain")]
    (tmp_path / "b.csv").write_text('id,name\n1,"two\nlines"\n')
    assert files.read_csv(spark, str(tmp_path / "b.csv"), multi_line=True).first().name == "two\nlines"
    assert sorted((r.id, r.name) for r in files.read_plain_csv(spark, str(tmp_path / "a.csv"), ["id", "name"]).collect())[-1] == ("2", "plain")
    (tmp_path / "c.json").write_text(json.dumps({"rows": [{"a": 1}, {"a": 2}]}))
    assert sorted(r.a for r in files.read_json_rows(spark, str(tmp_path / "c.json"), "a int", "rows").collect()) == [1, 2]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.json").write_text('[{"u": "a"}, {"u": null}]')
    (tmp_path / "d/y.json").write_text("not json")
    rows = files.read_folder(spark, str(tmp_path / "d"), "u string", "u").collect()
    assert [r.u for r in rows] == ["a"] and rows[0].source_file.endswith("x.json")
    log = str(tmp_path / "log")
    for n in (1, 2):
        files.append_state(spark.createDataFrame([("k", n, f"v{n}")], "k string, at int, v string"), log)
    assert [r.v for r in files.read_state(spark, log, "k string, at int, v string", "k", "at").collect()] == ["v2"]
    df = spark.createDataFrame([(1, ["a", "b"], "LOW")], "id int, tags array<string>, bucket string")
    files.write_csv(df, str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out")).first().tags == "a | b"
    assert files.write_buckets(df, str(tmp_path / "buckets"), "bucket").first()["count"] == 1 and (tmp_path / "buckets/bucket=LOW").exists()
    files.write_report(df, str(tmp_path / "report"), df.groupBy("bucket").count())
    files.write_distinct_text(df.union(df), "bucket", str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 1
    report = files.markdown_report("T", {"all": 1}, spark.createDataFrame([("A|B", 3)], "code string, n int"), df.select("id"))
    assert "A\\|B" in report and report.startswith("# T")


def test_pages(spark):
    html = "<html><head><title> A &amp; B </title><script type='application/ld+json'>{\"a\": 1}</script></head><body><h1>H</h1><a href='/x'>one</a><a href='/x'>two <b>x</b></a><p>text</p></body></html>"
    row = spark.createDataFrame([(html,)], "h string").select(files.page_evidence(F.col("h")).alias("e"), files.page_links(F.col("h")).alias("l"), files.json_ld(F.col("h")).alias("j")).first()
    assert row.e.evidence.title == "A & B" and row.e.evidence.headings == ["H"] and "text" in row.e.evidence.body
    assert [(x.href, x.label) for x in row.l] == [("/x", "two x")] and row.j == ['{"a": 1}']
    xml = spark.createDataFrame([("<urlset><loc> http://a </loc><loc>http://b</loc></urlset>",)], "x string")
    assert xml.select(files.sitemap_locations(F.col("x"))).first()[0] == ["http://a", "http://b"]


def test_streamed_views(spark, tmp_path):
    start = datetime(2024, 1, 1)
    source = str(tmp_path / "in")
    schema = "k string, ts timestamp"
    for batch in ([0, 20], [40, 45, 75]):
        rows = [("a", start + timedelta(minutes=m)) for m in batch] + [(None, start + timedelta(minutes=m)) for m in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    accepted = views.accept_views(stream, ["k"], "ts")
    query = accepted.writeStream.format("memory").queryName("views").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    got = sorted((r.k or "", (r.ts - start).seconds // 60) for r in spark.table("views").collect())
    assert got == [("", 0), ("", 40), ("", 75), ("a", 0), ("a", 40), ("a", 75)]


def test_views_of_many_keys_share_few_rows_of_state(spark, tmp_path):
    start, big = datetime(2024, 1, 1), 2**53
    keys = [(None if k == 7 else big + k, f"k{k % 3}" if k % 5 else None, bytes([k, 255]), start + timedelta(microseconds=k), k / 3) for k in range(60)]
    schema = "n long, s string, b binary, d timestamp, f double, ts timestamp"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    times, want = ([50, 0, 20, 45], [85, 60, 95]), [0, 45, 85]  # in no order; a window of 30 minutes from the last that counts
    for batch in times:
        rows = spark.createDataFrame([(*key, start + timedelta(minutes=m)) for m in batch for key in keys], schema)
        assert (files := replay.write_in_order(rows, "ts", source, 1, most_rows=100)) == -(-len(batch) * 60 // 100)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        accepted = views.accept_views(stream, ["n", "s", "b", "d", "f"], "ts", groups=4)
        assert [(x.name, x.dataType) for x in accepted.schema] == [(x.name, x.dataType) for x in rows.schema]
        replay.run_available(accepted, out, check)
    got = sorted((str(r.n), str(r.s), bytes(r.b), r.d, r.f, (r.ts - start).seconds // 60) for r in replay.read_batches(spark, out, schema).collect())
    assert got == sorted((str(n), str(s), b, d, f, m) for n, s, b, d, f in keys for m in want)
    assert len(list((tmp_path / "in").glob("*.parquet"))) > 2
    assert 1 <= spark.read.format("statestore").load(check).count() <= 4  # not one for each of 60 keys


def test_clicks(spark):
    df = spark.createDataFrame([(1, "GET", None), (2, "head", None), (3, None, "Prefetch;x"), (4, "POST", "")], "id int, method string, purpose string")
    assert sorted(r.id for r in views.human_clicks(df, F.col("method"), F.col("purpose")).collect()) == [1, 4]
    parents = spark.createDataFrame([(1,)], "pid int")
    assert [r.id for r in views.only_active(df, parents, "id", "pid").collect()] == [1]
