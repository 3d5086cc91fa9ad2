"""What the corpus operators share."""

from pyspark.sql import functions as F

from ledgerloom.llm.runtime import hash_sample


def test_hash_sample_is_the_smallest_hashes(spark):
    df = spark.range(20_000)
    want = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(300).collect()]
    assert [r.id for r in hash_sample(df, 300, 20_000, "id").collect()] == want
    assert hash_sample(df, 50_000, 20_000, "id").count() == 20_000
    assert hash_sample(df.limit(0), 10, 0, "id").count() == 0
