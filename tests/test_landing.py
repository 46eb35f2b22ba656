"""What landing tables in the scratch folder leaves behind, and what the landed search pages hold."""

import base64
import datetime as dt
import json
import re
import time

import pytest

import __spark_entry__ as entry_module
from adlens import session
from adlens.operators import information
from adlens.operators.merge import MergedTable
from adlens.operators.ranking import ordered_positions
from adlens.operators.search_pages import collect_listings
from adlens.plans.jobs import collect_to_tables
from adlens.sources import fixtures
from adlens.streaming import jobs as streams


def shuffle_blocks(spark) -> int:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).name().startswith("shuffle_") for i in range(blocks.size()))


def settles_at(spark, most: int) -> bool:
    until = time.time() + 10
    while shuffle_blocks(spark) > most and time.time() < until:
        time.sleep(0.1)
    return shuffle_blocks(spark) <= most


@pytest.fixture
def tables(spark, tmp_path):
    """Listings of two searches, 120 and 50 ads, and five of none."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    kinds = ["long"] * 120 + ["even"] * 50 + [None] * 5
    write("lineitem", [(10 * i + 2, i, 1, 1 if i % 2 else 2, float(i % 20), float(1000 - i), 0.0, 0.0, "N", "O", dt.datetime(2024, 1, 1))
                       for i in range(175)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    write("part", [(i, f"name {i}", "brand", k) for i, k in enumerate(kinds)], "p_partkey long, p_name string, p_brand string, p_type string")
    write("supplier", [(1, "seller", 7)], "s_suppkey long, s_name string, s_nationkey int")
    write("nation", [(7, "NORWAY")], "n_nationkey int, n_name string")
    return str(tmp_path)


def test_landed_pages_hold_every_ad_once_and_leave_no_shuffle_files(spark, tables):
    before = shuffle_blocks(spark)
    pages = fixtures.search_pages(spark, tables)
    assert settles_at(spark, before)
    seen = {}
    for p in pages.collect():
        state = json.loads(base64.b64decode(re.search('"x">([^<]*)<', p.html)[1]))["queries"]
        data = state[0]["state"]["data"]
        tops = [q["state"]["data"]["result"]["searchEntry"] for q in state[1:]]
        seen[p.search_query, p.page] = (tops, data["docs"], data["metadata"], p.price_from, p.range_no)
    assert set(seen) == {("long", 1), ("long", 2), ("long", 3), ("long", 4), ("even", 1), ("even", 2)}
    assert [len(seen["long", i][0]) + len(seen["long", i][1]) for i in (1, 2, 3, 4)] == [50, 50, 20, 0]
    # By price, and the prices fall with the part number: the first ad of a page is promoted if its line is the first one.
    order = [d["ad_id"] for i in (1, 2, 3) for d in [*seen["long", i][0], *seen["long", i][1]]]
    assert order == [f"{10 * i + 2}-{1 if i % 2 else 2}" for i in range(119, -1, -1)]
    assert [len(seen["long", i][0]) for i in (1, 2, 3)] == [1, 1, 1] and len(seen["even", 1][0]) == 1
    assert seen["even", 2][1] == [] and seen["even", 2][2]["is_end_of_paging"]
    assert {(v[3], v[4], v[2]["result_size"]["match_count"]) for k, v in seen.items() if k[0] == "long"} == {(0, 0, 120)}
    assert len(seen["long", 1][1][0]["image_urls"]) == 118 % 20 % 15


def test_positions_leave_no_shuffle_files_and_do_not_shuffle_the_rows_again(spark):
    before = shuffle_blocks(spark)
    placed = ordered_positions(spark.range(50_000).selectExpr("id % 3 as g", "hash(id) as v", "id"), ["v", "id"], ["g"])
    assert settles_at(spark, before)
    assert placed.groupBy("g").agg({"position": "max", "*": "count"}).where("`max(position)` <> `count(1)` - 1").count() == 0
    assert "BroadcastHashJoin" in placed._jdf.queryExecution().executedPlan().toString()


def test_collecting_shuffles_the_wanted_columns_only(spark, tables):
    found = entry_module.queries()["collect_listings"](spark, tables)
    packed = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "min_by" in line]
    assert packed and not any("image_urls" in line or "canonical_url" in line for line in packed)
    want = collect_listings(fixtures.search_pages(spark, tables)).select(*found.columns)
    assert found.count() == 170 and found.exceptAll(want).count() == 0


def test_collecting_to_tables_leaves_no_shuffle_files(spark, tables, tmp_path):
    pages = fixtures.search_pages(spark, tables)
    before = shuffle_blocks(spark)
    assert collect_to_tables(pages, str(tmp_path / "raw")).schema == collect_listings(pages).schema
    assert settles_at(spark, before)
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 170


def test_a_sightings_table_of_some_columns(spark, tables, tmp_path):
    pages = streams.page_stream(spark, fixtures.search_pages_path(spark, tables))
    table = streams.sightings_table(pages, str(tmp_path / "table"), 4, ["heading", "price_amount"])
    assert set(table.schema.names) == {"ad_id", "heading", "price_amount", "_query", "_range", "_page", "pos"}
    reports = []
    merged = streams.merge_sightings(pages, table, "some", progress=reports)
    want = collect_listings(fixtures.search_pages(spark, tables)).select("ad_id", "heading", "price_amount")
    assert merged.columns == want.columns and merged.count() == 170 and merged.exceptAll(want).count() == 0
    assert any("rocksdb" in name.lower() for name in reports[0]["stateOperators"][0]["customMetrics"])


def test_streams_keep_their_state_on_disk_whatever_the_session(spark):
    class Conf(dict):
        set, unset = dict.__setitem__, dict.__delitem__

    for named in ({}, {"spark.sql.streaming.stateStore.providerClass": "own"}):
        conf = Conf(named)
        with session.state_on_disk(type("S", (), {"conf": conf})()):
            assert {**session.STREAM_SETTINGS, **named} == conf
        assert conf == named


def test_a_merge_into_an_empty_bucket_does_not_join(spark, tmp_path, monkeypatch):
    table = MergedTable(spark, str(tmp_path / "table"), spark.range(0).selectExpr("id", "id as place").schema, ["id"], ["place"], 4)
    asked = []
    real = table._better
    monkeypatch.setattr(table, "_better", lambda *a: asked.append(1) or real(*a))
    table.merge(spark.range(100).selectExpr("id", "5L as place"), 0)
    assert asked == [] and table.read().count() == 100
    assert table.merge(spark.range(200).selectExpr("id", "CASE WHEN id < 50 THEN 1L ELSE 9L END as place"), 1) == {0, 1, 2, 3}
    assert asked == [1] and [tuple(r) for r in table.read().groupBy("place").count().orderBy("place").collect()] == [(1, 50), (5, 50), (9, 100)]


def test_neighbour_information_deletes_what_it_landed(spark):
    df = spark.range(400).selectExpr("CAST(id % 3 AS STRING) AS cat", "CAST(hash(id) % 100 AS DOUBLE) AS num", "CAST(hash(id, 1) % 50 AS DOUBLE) AS log_price")

    def folders():
        root = session.scratch_path(spark, "x").rsplit("/", 2)[0]
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "*/*"))
        return {f.getPath().getName() for f in found or []}

    before = folders()
    got = information.neighbour_information(df, ["cat"], ["num"], block_rows=16)
    left = folders() - before
    assert len(left) == 1 and next(iter(left)).startswith("information-")
    assert {r.feature for r in got.collect()} == {"cat", "num"} and all(r.mi is not None for r in got.collect())


def test_counts_of_an_axis_that_spans_partitions(spark):
    values = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS axis", "CAST(id AS DOUBLE) AS value")
    asked = spark.range(0, 3000, 7).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS axis", "CAST(id AS STRING) AS id", "CAST(id AS DOUBLE) AS low", "CAST(id + 1000 AS DOUBLE) AS high")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.axis, r.id): r.n for r in information.counts_within(values, asked).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    held = {"a": [v for v in range(3000) if v % 3 == 0], "b": [v for v in range(3000) if v % 3]}
    want = {(x, str(i)): sum(i <= v <= i + 1000 for v in held[x]) for i in range(0, 3000, 7) for x in ["b" if i % 2 else "a"]}
    assert got == want


def test_landed_pages_come_in_row_groups_that_a_reader_can_hold(spark):
    import pyarrow.parquet as pq
    wide = spark.range(0, 2000, 1, 1).selectExpr("id", "array_join(transform(sequence(1, 500), i -> md5(string(id * 1000 + i))), '') AS html")
    path = fixtures.landed_path(spark, "nowhere", "wide-pages", lambda: wide)
    groups = [g.num_rows for f in pq.ParquetDataset(path.removeprefix("file:")).fragments for g in f.row_groups]
    assert sum(groups) == 2000 and max(groups) < 1000
    assert spark.read.parquet(path).exceptAll(wide).count() == 0
