import os
import random

from pyspark.sql import functions as F

from adlens.operators.ingest import keep_first
from adlens.operators.merge import MergedTable

SCHEMA = "k STRING, place INT, v STRING"


def rows_of(spark, seed, n=400):
    own = random.Random(seed)
    rows = [(own.choice([None, *map(str, range(120))]), own.randrange(10**6) if own.random() > .05 else None, f"v{seed}-{i}") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "/rows/" in d + "/"}


def first(df):
    return {tuple(r) for r in keep_first(df, ["k"], F.struct("place", "v")).collect()}


def table(spark, path, buckets=8, n_files=1):
    return MergedTable(spark, str(path), spark.createDataFrame([], SCHEMA).schema, ["k"], ["place", "v"], buckets, n_files)


def test_three_merges_equal_one_batch_in_any_order(spark, tmp_path):
    parts = [rows_of(spark, s) for s in (1, 2, 3)]
    whole = first(parts[0].union(parts[1]).union(parts[2]))
    for n, order in enumerate([(0, 1, 2), (2, 0, 1)]):
        t = table(spark, tmp_path / str(n), n_files=1 + n)
        assert t.read().count() == 0
        for batch, part in enumerate(order):
            t.merge(parts[part], batch)
        assert {tuple(r) for r in t.read().collect()} == whole and t.commits() == [0, 1, 2]


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.merge(rows_of(spark, 1), 0)
    before, versions = files(tmp_path), t.versions()
    held = {r.k: r for r in t.read().collect()}
    key = sorted(k for k, r in held.items() if k and r.place is not None)[0]
    # One better row, and rows that come later than what is stored.
    better = [(key, -1, "new")] + [(k, 10**7, "late") for k in held]
    bucket = spark.createDataFrame([(key,)], "k string").select(F.pmod(F.xxhash64("k"), F.lit(8)).cast("int")).first()[0]
    assert t.merge(spark.createDataFrame(better, SCHEMA), 1) == {bucket}
    after = files(tmp_path)
    assert all(after[f] == m for f, m in before.items())
    assert {b for b, v in t.versions().items() if v != versions[b]} == {bucket}
    got = {r.k: r.v for r in t.read().collect()}
    assert got[key] == "new" and all(got[k] == held[k].v for k in held if k != key)
    # Nothing better: nothing is written but the commit.
    assert t.merge(rows_of(spark, 1), 2) == set() and set(files(tmp_path)) == set(after)
    t.drop_old()
    assert {r.k: r.v for r in t.read().collect()} == got and len(files(tmp_path)) == len(t.versions()) and t.commits() == [2]


def test_a_batch_number_counts_once_and_a_failed_merge_changes_nothing(spark, tmp_path, monkeypatch):
    import pytest
    t = table(spark, tmp_path / "t")
    t.merge(rows_of(spark, 1), 0)
    want = {tuple(r) for r in t.read().collect()}
    assert t.merge(rows_of(spark, 2), 0) == set() and {tuple(r) for r in t.read().collect()} == want

    def lost(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(t, "_commit", lost)
        with pytest.raises(RuntimeError):
            t.merge(rows_of(spark, 2), 1)
    assert {tuple(r) for r in t.read().collect()} == want
    t.merge(rows_of(spark, 2), 1)
    assert {tuple(r) for r in t.read().collect()} == first(rows_of(spark, 1).union(rows_of(spark, 2)))


def test_clashing_columns_and_empty_batches(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.merge(rows_of(spark, 1).limit(0), 0)
    assert t.read().count() == 0 and t.commits() == [0]
    t.merge(rows_of(spark, 4).withColumn("_bucket", F.lit("x")).withColumn("_held", F.lit(1)), 1)
    assert {tuple(r) for r in t.read().collect()} == first(rows_of(spark, 4))
