"""Scalers, encoders and the vocabulary as pipeline stages whose fitted state is saved with the pipeline.

Numbers and levels are parameters of the model; the vocabulary is a table beside its metadata, so it may be of any size.
``PipelineModel.load`` reads them all.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.operators import scale, vocab


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    """Keyword arguments become parameters; those left out keep their defaults."""

    def _given(self, **kwargs) -> None:
        self._set(**{k: v for k, v in kwargs.items() if v is not None})


# ---- log1p, then 0 to 1 --------------------------------------------------------------------

class LogMinMaxScaler(Estimator, HasInputCol, HasOutputCol, _Stage):
    """Fits the range of ``log1p`` of a column; a constant column gets a tiny range."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._given(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LogMinMaxModel:
        row = scale.fit_log1p_minmax(dataset, self.getInputCol()).first()
        if row["lo"] is None:
            raise ValueError(f"{self.getInputCol()} has no value to fit on")
        return self._copyValues(LogMinMaxModel(low=row["lo"], high=row["hi"]))


class LogMinMaxModel(Model, HasInputCol, HasOutputCol, _Stage):
    low = Param(Params._dummy(), "low", "least log1p seen", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "largest log1p seen", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, low: float | None = None, high: float | None = None):
        super().__init__()
        self._given(**self._input_kwargs)

    def _span(self):
        low = self.getOrDefault(self.low)
        return F.lit(low), F.lit(self.getOrDefault(self.high) - low)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        low, span = self._span()
        return dataset.withColumn(self.getOutputCol(), (F.log1p(self.getInputCol()) - low) / span)

    def untransform(self, dataset: DataFrame, column: str | None = None, name: str | None = None) -> DataFrame:
        """The plain values behind scaled ones (of the output column, unless told otherwise)."""
        low, span = self._span()
        column = column or self.getOutputCol()
        return dataset.withColumn(name or column, F.expm1(F.col(column) * span + low))


# ---- several columns to 0 to 1 -----------------------------------------------------------------

class MinMaxColumns(Estimator, HasInputCols, _Stage):
    """Fits the range of each column, missing values as 0; the scaled ones are called ``num_<column>``."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._given(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MinMaxColumnsModel:
        columns = self.getInputCols()
        number = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
        row = dataset.agg(*[f(number[c]).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))]).first()
        if columns and row[f"low_{columns[0]}"] is None:
            raise ValueError("no rows to fit on")
        return self._copyValues(MinMaxColumnsModel(lows=[row[f"low_{c}"] for c in columns], highs=[row[f"high_{c}"] for c in columns]))


class MinMaxColumnsModel(Model, HasInputCols, _Stage):
    lows = Param(Params._dummy(), "lows", "least value of each column", TypeConverters.toListFloat)
    highs = Param(Params._dummy(), "highs", "largest value of each column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, lows: Sequence[float] | None = None, highs: Sequence[float] | None = None):
        super().__init__()
        self._given(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scaled = {}
        for c, low, high in zip(self.getInputCols(), self.getOrDefault(self.lows), self.getOrDefault(self.highs)):
            value = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            scaled[f"num_{c}"] = (value - low) / F.lit(high - low) if high > low else F.lit(0.0)
        return dataset.withColumns(scaled)


# ---- one-hot -----------------------------------------------------------------------------------

class OneHotLevels(Estimator, HasInputCols, _Stage):
    """Fits the distinct values of each column, ``most`` in all at most; they become 0/1 columns ``<column>_<level>``."""

    fill = Param(Params._dummy(), "fill", "name of the missing value", TypeConverters.toString)
    most = Param(Params._dummy(), "most", "more levels than this are refused", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, fill: str | None = None, most: int | None = None):
        super().__init__()
        self._setDefault(fill="missing", most=scale.MOST_LEVELS)
        self._given(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> OneHotLevelsModel:
        fill = self.getOrDefault(self.fill)
        known = scale.levels(dataset, self.getInputCols(), fill, self.getOrDefault(self.most))
        return OneHotLevelsModel(inputCols=self.getInputCols(), fill=fill, levels=json.dumps(known))


class OneHotLevelsModel(Model, HasInputCols, _Stage):
    fill = Param(Params._dummy(), "fill", "name of the missing value", TypeConverters.toString)
    levels = Param(Params._dummy(), "levels", "levels of each column, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, fill: str | None = None, levels: str | None = None):
        super().__init__()
        self._given(**self._input_kwargs)

    def known(self) -> dict[str, list[str]]:
        return json.loads(self.getOrDefault(self.levels))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return scale.one_hot(dataset, self.known(), self.getOrDefault(self.fill))


# ---- vocabulary --------------------------------------------------------------------------------

class _TableWriter(MLWriter):
    def __init__(self, instance: TitleVocabularyModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path.rstrip('/')}/words")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TitleVocabularyModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.cls()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        instance.table = self.sparkSession.read.parquet(f"{path.rstrip('/')}/words")
        return instance


class TitleVocabulary(Estimator, HasInputCol, HasOutputCol, _Stage):
    """Fits the word list of a text column; texts become lists of token ids.  ``keyCols`` identify a row."""

    keyCols = Param(Params._dummy(), "keyCols", "columns that identify a row", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, keyCols: Sequence[str] | None = None):
        super().__init__()
        self._given(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TitleVocabularyModel:
        model = TitleVocabularyModel(keyCols=self.getOrDefault(self.keyCols))
        model.table = vocab.fit_vocabulary(dataset, self.getInputCol())
        return self._copyValues(model)


class TitleVocabularyModel(Model, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """``table`` holds ``word, token_id``."""

    keyCols = Param(Params._dummy(), "keyCols", "columns that identify a row", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, keyCols: Sequence[str] | None = None):
        super().__init__()
        self.table: DataFrame | None = None
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def copy(self, extra=None) -> TitleVocabularyModel:
        other = super().copy(extra)
        other.table = self.table
        return other

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keys = self.getOrDefault(self.keyCols)
        ids = vocab.encode_tokens(dataset, keys, self.getInputCol(), self.table, normalise=True)
        return dataset.join(ids.withColumnRenamed("ids", self.getOutputCol()), keys)
