from pyspark.sql import functions as F

from millrace.functions.text import greek_to_latin, match_strength, search_form
from millrace.operators import search


def test_strengths_are_made_once_in_either_script(spark):
    texts = ["Κόσμος", "kosmos", "ΚΟΣΜΟΣ βιβλία", "cosmos books", "μπλε", "ble", "a & b", "", None]
    rows = spark.createDataFrame([(i * 10 + j, x, y) for i, x in enumerate(texts) for j, y in enumerate(texts)], "id int, a string, b string")
    for query in ("kosmos", "κόσμος", "ΜΠΛΕ", "a and b", ""):
        found = search.weighted_search(rows, query, {"a": 300, "b": 120}, least=60, boosts=[(F.col("id") % 2 == 0, 5.0)])
        every = [match_strength(f(F.coalesce(c, F.lit(""))), f(F.lit(query))) * w for c, w in (("a", 300), ("b", 120)) for f in (search_form, greek_to_latin)]
        want = rows.select("*", F.greatest(*every).alias("raw")).collect()
        assert found.columns == ["id", "a", "b", "score"]
        assert {r.id: r.score for r in found.collect()} == {r.id: int(r.raw + (5 if r.id % 2 == 0 else 0) + 0.5) for r in want if r.raw >= 60}
    plan = search.weighted_search(rows, "kosmos", {"a": 300, "b": 120}, least=60)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("levenshtein" in line for line in plan.splitlines() if "Filter" in line)
