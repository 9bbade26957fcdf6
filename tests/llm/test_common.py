import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm import exact_dedup as ed


def test_filter_grows_with_the_keys(spark, monkeypatch):
    """Every key passes, and few others do, however small the smallest filter is."""
    keys, others = spark.range(5000), spark.range(5000, 25000)
    hashes = lambda df: np.array([r[0] for r in df.select(F.xxhash64("id")).collect()])
    monkeypatch.setattr(common, "FILTER_BITS", 64)
    sized = common.id_filter(keys, "id")
    assert sized.passes(hashes(keys)).all()
    assert sized.passes(hashes(others)).mean() < 0.08
    monkeypatch.setattr(common, "MOST_FILTER_BITS", 64)
    full = common.id_filter(keys, "id")
    assert full.bits == 64 and full.passes(hashes(others)).all()


def test_bits():
    assert common.filter_bits(0) == common.FILTER_BITS
    assert common.filter_bits(10**7) == -(-16 * 10**7 // common.BITMAP_BITS) * common.BITMAP_BITS
    assert common.filter_bits(10**12) == common.MOST_FILTER_BITS


def test_full_filter_changes_no_result(spark, monkeypatch):
    rows = [(i, f"text {i % 40} of {i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, ed.exact_dedup(df).collect()))
    monkeypatch.setattr(common, "FILTER_BITS", 64)
    monkeypatch.setattr(common, "MOST_FILTER_BITS", 64)
    assert sorted(map(tuple, ed.exact_dedup(df).collect())) == want
