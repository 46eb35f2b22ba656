"""The three jobs end to end: collect, train, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from adlens.operators.models import (PriceModel, regression_metrics, sample_predictions,
                                     train_and_hold_out)
from adlens.operators.prepare import ensure_prepared, prepare_listings
from adlens.operators.search_pages import collect_listings
from adlens.session import shuffles_dropped
from adlens.sources.tables import read_listings_csv, require_rows, write_listings_csv


def collect_to_tables(pages: DataFrame, raw_path: str, prepared_path: str | None = None,
                      query: str | None = None, max_pages: int | None = None,
                      csv: bool = False) -> DataFrame:
    """Landed pages to a raw listing table and, if asked for, a prepared table.

    The raw table is written first and read back, so the pages are parsed once.
    """
    spark = pages.sparkSession

    def write(df: DataFrame, path: str) -> None:
        if csv:
            write_listings_csv(df, path)
        else:
            with shuffles_dropped(spark):
                df.write.mode("overwrite").parquet(path)

    rows = collect_listings(pages, query, max_pages)
    write(rows, raw_path)
    stored = read_listings_csv(spark, raw_path, rows.schema) if csv else spark.read.schema(rows.schema).parquet(raw_path)
    require_rows(stored, "the pages of this query hold no listing")
    if prepared_path:
        write(prepare_listings(stored), prepared_path)
    return stored


def train_price_model(listings: DataFrame, output: str, test_size: float = 0.2,
                      model_type: str = "ridge", key: str = "ad_id", **options) -> DataFrame:
    """Prepare, split, fit, save the model and the holdout; return the metrics row."""
    require_rows(listings, "the listing table to train on is empty")
    prepared = ensure_prepared(listings)
    model, holdout = train_and_hold_out(prepared, key, test_size, model_type, **options)
    model.save(output)
    path = f"{output}.holdout"
    holdout.write.mode("overwrite").parquet(path)
    return regression_metrics(listings.sparkSession.read.parquet(path))


def evaluate_price_model(model_path: str, listings: DataFrame, samples: int = 5,
                         key: str = "ad_id") -> tuple[DataFrame, DataFrame]:
    """Metrics and a few sample predictions of a saved model on prepared or raw listings."""
    prepared = require_rows(ensure_prepared(listings), "the listing table to evaluate on is empty")
    scored = PriceModel.load(model_path).predict(prepared)
    return regression_metrics(scored), sample_predictions(scored, samples, key)
