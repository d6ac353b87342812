import pytest
from pyspark.sql import functions as F

from millrace.operators import panes
from millrace.plans.catalog import Catalog, ForeignKey
from millrace.plans.changes import Plan, StalePlan
from millrace.plans.stored import StoredTable
from millrace.sources import files


def test_quarantine(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.json").write_text('[{"id": 1, "name": "x"}, {"id": "not a number", "name": "y"}, {"id": 3}]')
    (folder / "deep" / "b.json").write_text('{"id": 4,\n "name": "z"}')
    (folder / "c.json").write_text("{broken")
    (folder / "d.json").write_text(" \n ")
    (folder / "e.txt").write_text("[]")
    rows, bad = files.read_quarantined(spark, str(folder), "id int, name string")
    assert sorted((r.id, r.name) for r in rows.collect()) == [(1, "x"), (3, None), (4, "z")]
    assert sorted((r.source_file.rsplit("/")[-1], r.reason) for r in bad.collect()) == [("a.json", "does not fit"), ("c.json", "not JSON"), ("d.json", "not JSON")]


def test_a_missing_source_fails_alone(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string").write.parquet(str(tmp_path / "good"))
    spark.createDataFrame([], "id int, s string").write.parquet(str(tmp_path / "empty"))
    spark.createDataFrame([(1,)], "other int").write.parquet(str(tmp_path / "odd"))
    rows, status = files.read_sources(spark, {n: str(tmp_path / n) for n in ("good", "empty", "odd", "missing")}, "id long, s string")
    assert sorted((r.source, r.id) for r in rows.collect()) == [("good", 1), ("good", 2)]
    assert {r.source: (r.status, r.n) for r in status.collect()} == {"good": ("OK", 2), "empty": ("OK", 0), "odd": ("FAILED", None), "missing": ("FAILED", None)}


def test_deep_sitemaps_are_not_left_out_in_silence(spark):
    maps = [(f"{i}.xml", f"<sitemapindex><loc>{i + 1}.xml</loc></sitemapindex>") for i in range(4)] + [("4.xml", "<urlset><loc>page</loc></urlset>")]
    frame = spark.createDataFrame(maps, "url string, xml string")
    root = spark.createDataFrame([("0.xml",)], "url string")
    assert [r.url for r in files.walk_sitemaps(frame, root).collect()] == ["page"]
    with pytest.raises(ValueError, match="deeper"):
        files.walk_sitemaps(frame, root, depth=3, strict=True)
    with pytest.warns(UserWarning, match="deeper"):
        assert files.walk_sitemaps(frame, root, depth=3).collect() == []


def test_deletions_through_a_graph_of_keys(spark):
    frames = {
        "a": spark.createDataFrame([(1,), (2,)], "id int"),
        "b": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, a int"),
        "c": spark.createDataFrame([(100, 10, 1), (101, 11, 1), (102, 11, 2), (103, 12, None)], "id int, b int, a int"),
        "d": spark.createDataFrame([(7, 100), (8, 102), (9, None)], "id int, c int"),
    }
    keys = [ForeignKey("b", "a", "a", "id"), ForeignKey("c", "b", "b", "id"), ForeignKey("c", "a", "a", "id"), ForeignKey("d", "c", "c", "id", "set null")]
    out = Catalog(frames, keys).delete("a", frames["a"].filter("id = 1"))
    ids = lambda f: sorted(r.id for r in f.collect())
    assert {n: (ids(x), ids(y), ids(z)) for n, (x, y, z) in out.items()} == {"a": ([1], [], [2]), "b": ([10], [], [11, 12]), "c": ([100, 101], [], [102, 103]), "d": ([], [7], [7, 8, 9])}
    assert {r.id: r.c for r in out["d"][2].collect()} == {7: None, 8: 102, 9: None}
    with pytest.raises(ValueError, match="cycle"):
        Catalog(frames, [*keys, ForeignKey("a", "id", "c", "id")]).delete("a", frames["a"])


def test_panes_moved_on_day_by_day(spark, tmp_path):
    rows = [(f"2024-01-{1 + (i * i) % 20:02d} 0{i % 10}:00:00", None if i % 7 == 0 else "ab"[i % 2]) for i in range(200)]
    events = spark.createDataFrame(rows, "ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    path, lengths = str(tmp_path / "panes"), [2, 5]
    late = F.col("ts") >= "2024-01-11"
    panes.write_panes(events.filter(~late), "ts", ["kind"], path)
    panes.write_panes(events.filter(late), "ts", ["kind"], path)
    key = lambda r: str(tuple(r))
    whole = panes.rolling(spark, path, ["kind"], "2024-01-05", "2024-01-25", lengths).collect()
    known = panes.figures(spark, path, ["kind"], "2024-01-05", lengths)
    for day in range(6, 26):
        known = spark.createDataFrame(panes.advance(spark, path, ["kind"], known, f"2024-01-{day:02d}", lengths).collect(), "days int, kind string, current long, previous long")
        if day in (6, 13, 25):
            want = panes.figures(spark, path, ["kind"], f"2024-01-{day:02d}", lengths).collect()
            assert sorted(known.collect(), key=key) == sorted(want, key=key) == sorted(([r[1:] for r in whole if r.day.day == day]), key=key)
    plan = panes.advance(spark, path, ["kind"], known, "2024-01-25", [5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters", 1)[1][:200]


def test_plans_applied_to_a_stored_table(spark, tmp_path):
    rows = [(1, "a/b", 10), (2, "a/b", 20), (3, "é", 30), (4, None, 40), (5, "z", 50)]
    df = spark.createDataFrame(rows, "id int, kind string, n int")
    stored = StoredTable.create(df, str(tmp_path / "t"), ["id"], "kind")
    read = lambda: sorted(((r.id, r.kind, r.n) for r in StoredTable(spark, str(tmp_path / "t")).read().collect()))
    assert read() == sorted(rows)
    before = stored.manifest()[1]["parts"]
    actions = spark.createDataFrame([(1, "z", None), (3, None, 31), (6, "new", 60)], "id int, kind string, n int")
    plan = Plan(actions, stored.read(), ["id"])
    other = Plan(spark.createDataFrame([(3, 99)], "id int, n int"), stored.read(), ["id"])
    assert stored.apply(plan) and not stored.apply(plan)
    want = [(1, "z", 10), (2, "a/b", 20), (3, "é", 31), (4, None, 40), (5, "z", 50), (6, "new", 60)]
    assert read() == want
    after = stored.manifest()[1]["parts"]
    assert after["n"] == before["n"] and all(after[p] != before[p] for p in before if p != "n") and len(after) == 5
    number = stored.manifest()[0]
    with pytest.raises(StalePlan):  # row 3 isn't what it was when the plan was made
        stored.apply(other)
    assert stored.manifest()[0] == number and read() == want
    gone = Plan(spark.createDataFrame([(5, "a/b"), (1, "a/b")], "id int, kind string"), stored.read(), ["id"])
    assert stored.apply(gone) and "z" not in {r[1] for r in read()} and len(stored.manifest()[1]["parts"]) == 4
