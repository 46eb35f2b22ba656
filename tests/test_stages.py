import os
import subprocess
import sys

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from adlens.operators import scale, vocab
from adlens.operators.stages import LogMinMaxScaler, MinMaxColumns, OneHotLevels, TitleVocabulary

ROWS = [("1", "Gitar Ø", 100.0, 1.5, "a"), ("2", "bass gitar", 0.0, None, None), ("3", None, 900.0, 7.0, "b"), ("4", "", 50.0, 3.0, "a b")]
SCHEMA = "id STRING, title STRING, price DOUBLE, num DOUBLE, cat STRING"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def fitted(rows):
    return Pipeline(stages=[LogMinMaxScaler(inputCol="price", outputCol="scaled"), MinMaxColumns(inputCols=["num"]),
                            OneHotLevels(inputCols=["cat"]), TitleVocabulary(inputCol="title", outputCol="ids", keyCols=["id"])]).fit(rows)


def test_stages_give_what_the_functions_give(rows, fitted):
    got = fitted.transform(rows)
    fit = scale.fit_log1p_minmax(rows, "price")
    want = scale.log1p_minmax(scale.one_hot(rows.withColumns({}), scale.levels(rows, ["cat"])), "price", fit, "scaled")
    want = want.join(scale.minmax_numeric(rows, ["num"]).select("id", "num_num"), "id") \
        .join(vocab.encode_tokens(rows, ["id"], "title", vocab.fit_vocabulary(rows, "title"), normalise=True), "id")
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_saved_stages_read_in_a_new_session(spark, rows, fitted, tmp_path):
    path, table = str(tmp_path / "model"), str(tmp_path / "rows")
    fitted.write().overwrite().save(path)
    rows.write.parquet(table)
    want = sorted(str(r.asDict()) for r in fitted.transform(rows).collect())
    again = PipelineModel.load(path)
    assert sorted(str(r.asDict()) for r in again.transform(rows).collect()) == want
    # Values that were not seen: unknown word, unknown level, out of range.
    other = spark.createDataFrame([("9", "gitar ukulele", 10_000.0, -1.0, "zzz")], SCHEMA)
    assert fitted.transform(other).first() == again.transform(other).first()
    code = ("import sys; from pyspark.ml import PipelineModel; from adlens.session import build_session\n"
            f"s = build_session('again', 'local[1]', {{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'}})\n"
            f"rows = PipelineModel.load({path!r}).transform(s.read.parquet({table!r})).collect()\n"
            "print('ROWS', sorted(str(r.asDict()) for r in rows))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=200).stdout
    assert f"ROWS {want}" in out


def test_untransform(rows, fitted):
    model = fitted.stages[0]
    back = model.untransform(fitted.transform(rows), name="back")
    assert all(abs(r.back - r.price) < 1e-9 for r in back.select("price", "back").collect())
    assert model.untransform(fitted.transform(rows)).where(F.abs(F.col("scaled") - F.col("price")) > 1e-9).count() == 0


def test_nothing_to_fit_on_and_constants(spark, rows):
    with pytest.raises(ValueError, match="no value"):
        LogMinMaxScaler(inputCol="price", outputCol="x").fit(rows.limit(0))
    with pytest.raises(ValueError, match="no rows"):
        MinMaxColumns(inputCols=["num"]).fit(rows.limit(0))
    with pytest.raises(ValueError, match="more than 1 "):
        OneHotLevels(inputCols=["cat"], most=1).fit(rows)
    same = rows.withColumn("num", F.lit(4.0))
    assert {r.num_num for r in MinMaxColumns(inputCols=["num"]).fit(same).transform(same).collect()} == {0.0}
    lone = rows.withColumn("price", F.lit(4.0))
    assert {r.x for r in LogMinMaxScaler(inputCol="price", outputCol="x").fit(lone).transform(lone).collect()} == {0.0}
