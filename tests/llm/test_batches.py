from millrace.llm import batches


def test_only_lowers(spark):
    before = spark.conf.get(batches._KEY)
    try:
        for given, want in (("67108864b", "8m"), ("64mb", "8m"), ("2m", "2m"), ("1048576", "1048576"), ("8388608b", "8388608b")):
            spark.conf.set(batches._KEY, given)
            batches.bound_batches(spark)
            assert spark.conf.get(batches._KEY) == want
    finally:
        spark.conf.set(batches._KEY, before)
