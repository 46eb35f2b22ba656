import pytest
from pyspark.sql import functions as F

from adlens.functions.text import (absolute_url, first_keyword, first_rule, joined, normalise_title, strip,
                                   word_count)
from adlens.constants import (BRANDS, CATEGORY_RULES, CONDITION_RULES, DEFAULT_BRAND, DEFAULT_CATEGORY,
                              DEFAULT_CONDITION)
from adlens.operators import derive
from adlens.operators.prepare import ensure_prepared, prepare_listings

ROWS = [("Gitar til salgs", "Oslo", 1500.0, "2024-01-01T12:00:00Z"), ("Forsterker", "Bergen", 2500.0, None),
        ("Gratis sak", "Trondheim", None, "2024-02-01T00:00:00Z")]
SCHEMA = "title STRING, location STRING, price_amount DOUBLE, timestamp STRING"


def prepared(spark, rows, schema=SCHEMA):
    return prepare_listings(spark.createDataFrame(rows, schema), "title", "timestamp")


def test_prepare_keeps_priced_rows_and_fills_time(spark):
    rows = {r.title: r for r in prepared(spark, ROWS).collect()}
    assert set(rows) == {"Gitar til salgs", "Forsterker"}
    assert rows["Gitar til salgs"].text == "Gitar til salgs Oslo" and rows["Forsterker"].text == "Forsterker Bergen"
    assert rows["Gitar til salgs"].timestamp_val == rows["Forsterker"].timestamp_val == 1704110400.0


def test_prepare_median_ignores_unpriced_rows_and_bad_times(spark):
    rows = [("a", None, 1.0, "1970-01-01T00:00:10Z"), ("b", " x\t", 1.0, "1970-01-01T00:00:20Z"),
            (None, None, 1.0, "not a time"), ("d", "x", None, "2030-01-01T00:00:00Z")]
    got = {r.title: (r.text, r.timestamp_val) for r in prepared(spark, rows).collect()}
    assert got == {"a": ("a", 10.0), "b": ("b  x", 20.0), None: ("", 15.0)}


def test_prepare_epoch_ms_and_all_missing(spark):
    rows = [("a", "x", 1.0, 2000), ("b", "x", 1.0, None)]
    got = [r.timestamp_val for r in prepared(spark, rows, SCHEMA.replace("timestamp STRING", "timestamp BIGINT")).collect()]
    assert got == [2.0, 2.0]
    assert [r.timestamp_val for r in prepared(spark, [("a", "x", 1.0, None)]).collect()] == [None]
    assert prepared(spark, [("a", "x", None, None)]).count() == 0


def test_prepared_input_is_left_alone(spark):
    df = spark.sql("SELECT 't' AS text, 1.0D AS timestamp_val, 2.0D AS price_amount")
    assert ensure_prepared(df) is df
    raw = spark.createDataFrame(ROWS, SCHEMA)
    assert "text" in ensure_prepared(raw, title_col="title", time_col="timestamp").columns


def apply(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_category_rules(spark):
    got = apply(spark, lambda c: first_rule(F.lower(c), CATEGORY_RULES, DEFAULT_CATEGORY),
                "Fender Stratocaster", "Akustisk gitar, pent brukt", "Gitarstrenger", "Bok om bass", "Les Paul",
                "Marshall amp", "BOSS Katana 50", "Fender Deluxe Reverb", "bassø", "Rørforsterker", "", None)
    assert got == ["Elektrisk gitar", "Akustisk gitar", "Annet", "Bass", "Elektrisk gitar", "Forsterker",
                   "Forsterker", "Forsterker", "Annet", "Forsterker", "Annet", "Annet"]


def test_brands(spark):
    got = apply(spark, lambda c: first_keyword(F.lower(c), BRANDS, DEFAULT_BRAND),
                "FENDER squier", "TC Electronic Flashback", "electro-harmonix big muff", "Córdoba C5", "gitar", None)
    assert got == ["Fender", "Tc Electronic", "Electro-Harmonix", "Córdoba", "Unknown", "Unknown"]


def test_conditions(spark):
    got = apply(spark, lambda c: first_rule(F.lower(c), CONDITION_RULES, DEFAULT_CONDITION),
                "Splitter ny Marshall amp", "Ødelagt forsterker", "Akustisk gitar, pent brukt", "brukt", "nydelig",
                "Retro", None)
    assert got == ["Ny/ubrukt", "Defekt", "Pent brukt", "Brukt", "Ukjent", "Vintage", "Ukjent"]


def test_text_helpers(spark):
    assert apply(spark, strip, " \t a b \n", "", None) == ["a b", "", None]
    assert apply(spark, word_count, " a  b\tc ", "", None) == [3, 0, None]
    assert apply(spark, normalise_title, "Gitar på SALG!!", "æøå", None) == ["gitar p salg", "", None]
    assert apply(spark, lambda c: absolute_url(c, "https://b.test"), "/x", "https://c.test/y", "http://d") == [
        "https://b.test/x", "https://c.test/y", "http://d"]
    assert apply(spark, lambda c: joined(F.array(c, F.lit("z"))), None, "a") == [", z", "a, z"]


@pytest.mark.parametrize("n, label", [(0, None), (1, "1"), (2, "2-3"), (3, "2-3"), (5, "4-5"), (10, "6-10"),
                                      (100, "10+"), (101, None), (None, None)])
def test_image_bins(spark, n, label):
    df = spark.createDataFrame([(n,)], "n INT")
    assert df.select(derive.image_bin(F.col("n")).alias("x")).first()["x"] == label


def test_age_is_floored_and_weekday_names(spark):
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp")
    df = spark.sql("SELECT explode(array(timestamp'2024-01-08 12:00:00', timestamp'2024-01-10 00:00:01', "
                   "timestamp'2024-01-10 00:00:00')) AS t")
    assert [r.a for r in df.select(derive.age_days(F.col("t"), as_of).alias("a")).collect()] == [1, -1, 0]
    assert df.select(derive.weekday_name(F.col("t")).alias("d")).first()["d"] == "Monday"


def test_scope_and_exclusions(spark):
    df = spark.createDataFrame([("Til salgs", 5.0), ("Til salgs", 0.0), ("Gis bort", 0.0), (None, 3.0), ("Til salgs", None)],
                               "trade_type STRING, price_amount DOUBLE")
    assert derive.modelling_scope(df).count() == 1
    assert tuple(derive.scope_exclusions(df).first()) == (2, 2, 1, 5)


def test_price_label_and_seller(spark):
    df = spark.createDataFrame([(1234.5, True), (0.4, False), (None, None)], "p DOUBLE, r BOOLEAN")
    got = [tuple(r) for r in df.select(derive.price_label(F.col("p")), derive.seller_type(F.col("r"))).collect()]
    assert got == [("1,234 NOK", "Retailer"), ("0 NOK", "Private"), (None, None)]


def test_capped_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(5000).selectExpr("CAST(id AS STRING) AS k")
    a = {r.k for r in derive.capped_sample(df.repartition(3), "k", 100).collect()}
    b = {r.k for r in derive.capped_sample(df.repartition(9), "k", 100).collect()}
    assert a == b and len(a) == 100
    assert derive.capped_sample(df, "k", 9000).count() == 5000
