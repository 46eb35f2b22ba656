"""Streaming forms: page ingest with first sightings, crawl control, and running daily counts.

State is keyed and bounded by a watermark on the time of fetching.  Every micro-batch is written, or merged, under its own
number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from adlens.constants import MAX_PAGES
from adlens.operators.ingest import keep_first
from adlens.operators.merge import MergedTable
from adlens.operators.search_pages import largest_price, list_size, parse_pages, parse_search_pages
from adlens.session import ensure_utc, scratch_path, state_on_disk

_PLACE = ["_query", "_range", "_page"]
# Pages fetched this long before the latest one are still looked at, and an ad is held this long.
DELAY, HOLD = "2 days", "2 days"


def page_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of landed search pages."""
    schema = ensure_utc(spark).read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _run(stream: DataFrame, label: str, mode: str, write: Callable[[DataFrame, int], None], progress: list | None = None) -> bool:
    """Process all that has landed in micro-batches; whether there was any.  ``progress`` gets the reports of the batches."""
    with state_on_disk(stream.sparkSession):
        query = (stream.writeStream.foreachBatch(write).outputMode(mode)
                 .option("checkpointLocation", scratch_path(stream.sparkSession, f"{label}-state"))
                 .trigger(availableNow=True).start())
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    return bool(query.recentProgress)


def _run_batches(stream: DataFrame, label: str, mode: str, prepare: Callable[[DataFrame], DataFrame], progress: list | None = None) -> DataFrame:
    """The table of all batches, with the number of each as ``_batch``."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{out}/_batch={number}")

    landed = _run(stream, label, mode, write, progress)
    schema = prepare(spark.createDataFrame([], stream.schema)).schema.add("_batch", LongType())
    return spark.read.schema(schema).parquet(out) if landed else spark.createDataFrame([], schema)


def first_sightings_stream(pages: DataFrame, delay: str = DELAY, hold: str = HOLD, columns: Sequence[str] | None = None) -> DataFrame:
    """The first sighting of every ad so far, whenever a page that holds the ad lands.

    State holds, per ad and ``hold`` window of the fetch time, the row with the best place in the crawl.  A better place that
    lands later gives a corrected row; a window leaves the state when the watermark, ``delay`` behind the latest fetch, has
    passed it, and pages fetched before that are not looked at.  An ad seen in several windows comes once for each: the
    table the rows are merged into decides by place.  ``columns`` names what is wanted besides the key and the place: state
    and shuffles hold nothing else.
    """
    named = pages.withColumnsRenamed({"search_query": "_query", "range_no": "_range", "page": "_page"})
    rows = parse_search_pages(named.withWatermark("fetched_at", delay), [*_PLACE, "fetched_at"])
    wanted = [c for c in rows.columns if c not in ("ad_id", "fetched_at") and (columns is None or c in {*columns, *_PLACE, "pos"})]
    best = rows.groupBy(F.window("fetched_at", hold), "ad_id").agg(
        F.min_by(F.struct(*wanted), F.struct(*_PLACE, "pos")).alias("_row"))
    return best.select("ad_id", "_row.*")


def merge_sightings(pages: DataFrame, table: MergedTable, label: str, delay: str = DELAY, hold: str = HOLD,
                    progress: list | None = None) -> DataFrame:
    """Run the stream over what has landed into ``table``, each micro-batch one merge; returns one row per ad."""
    stream = first_sightings_stream(pages, delay, hold, [f.name for f in table.schema])
    _run(stream, label, "update", table.merge, progress)
    return table.read().drop(*_PLACE, "pos")


def sightings_table(pages: DataFrame, path: str, buckets: int = 64, columns: Sequence[str] | None = None) -> MergedTable:
    """An empty stored table for the sightings of ``pages``: one row per ad, the first in crawl order; ``columns`` are what is
    wanted besides the key (else all)."""
    return MergedTable(pages.sparkSession, path, first_sightings_stream(pages, columns=columns).schema, ["ad_id"], [*_PLACE, "pos"], buckets)


def crawl_progress_stream(pages: DataFrame, max_pages: int = MAX_PAGES, delay: str = DELAY, hold_hours: int = 24) -> DataFrame:
    """Where each crawl stands, whenever one of its pages lands: one row per search and price range that a batch touched.

    ``next_price_from`` is the whole part of the largest price on the last page with ads; ``n_pages`` counts the pages before
    the first empty one; ``ended`` says that an empty page or the page cap was reached, and ``advanced`` is false when the same
    price came back, so that the range must not be fetched again.  Pages may land in any order.  State holds a bit per page,
    the first empty page and the last page of a range; it expires ``hold_hours`` after the range's latest fetch.
    """
    if max_pages > 62:
        raise ValueError("a range has 62 pages at most")
    parsed = parse_pages(pages.withWatermark("fetched_at", delay))
    facts = parsed.select("search_query", "range_no", "price_from", "page", "fetched_at",
                          list_size(F.col("docs")).alias("n_rows"), largest_price(F.col("docs")).alias("page_max"))
    return facts.groupBy("search_query", "range_no").applyInPandasWithState(
        _advance(max_pages, hold_hours * 3_600_000), _PROGRESS, _CRAWL_STATE, "update", "EventTimeTimeout")


_PROGRESS = "search_query string, range_no int, price_from bigint, last_page int, next_price_from bigint, advanced boolean, n_pages int, ended boolean"
_CRAWL_STATE = "seen bigint, first_empty int, last_page int, last_max double, price_from bigint, latest bigint"


def _advance(max_pages: int, hold_ms: int):
    # Complete in itself, so that it reaches the workers by value.
    def advance(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        seen, first_empty, last_page, last_max, price_from, latest = state.get if state.exists else (0, None, None, None, None, 0)
        for frame in frames:
            known = frame.where(frame.notna(), None)
            for page, rows, top, start, fetched in zip(frame["page"], frame["n_rows"], known["page_max"], known["price_from"], frame["fetched_at"]):
                page = int(page)
                latest = max(latest, int(fetched.value // 1_000_000))
                if start is not None and not pd.isna(start):
                    price_from = int(start) if price_from is None else min(price_from, int(start))
                if page > max_pages:
                    continue
                if not rows:
                    first_empty = page if first_empty is None else min(first_empty, page)
                    continue
                seen |= 1 << page
                if last_page is None or page >= last_page:
                    last_page, last_max = page, None if top is None or pd.isna(top) else float(top)
        state.update((seen, first_empty, last_page, last_max, price_from, latest))
        state.setTimeoutTimestamp(max(latest + hold_ms, state.getCurrentWatermarkMs() + 1))
        before = (1 << first_empty) - 1 if first_empty is not None else -1
        cursor = None if last_max is None else int(last_max)
        yield pd.DataFrame({
            "search_query": pd.Series([key[0]], dtype="object"), "range_no": pd.Series([key[1]], dtype="Int32"),
            "price_from": pd.Series([price_from], dtype="Int64"), "last_page": pd.Series([last_page], dtype="Int32"),
            "next_price_from": pd.Series([cursor], dtype="Int64"),
            "advanced": [cursor is not None and price_from is not None and cursor > price_from],
            "n_pages": pd.Series([(seen & before).bit_count()], dtype="Int32"),
            "ended": [first_empty is not None or (last_page is not None and last_page >= max_pages)]})
    return advance


def crawl_progress(pages: DataFrame, label: str, max_pages: int = MAX_PAGES, delay: str = DELAY, hold_hours: int = 24,
                   progress: list | None = None) -> DataFrame:
    """The latest row of each search and price range after all that has landed."""
    stream = crawl_progress_stream(pages, max_pages, delay, hold_hours)
    return run_updates(stream, label, ["search_query", "range_no"], progress)


def daily_counts_stream(events: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """Rows per day kept up to date; days older than the watermark are closed and leave the state."""
    return (events.withWatermark(ts, delay)
            .groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("n"))
            .select(F.col("window.start").cast("date").alias("day"), "n"))


def run_updates(stream: DataFrame, label: str, keys: Sequence[str], progress: list | None = None) -> DataFrame:
    """Run an aggregate in update mode into a table of changes and return the latest row of each key.

    State is bounded by the stream's watermark: a row later than that changes nothing.
    """
    changes = _run_batches(stream, label, "update", lambda batch: batch, progress)
    return keep_first(changes, keys, -F.col("_batch")).drop("_batch")
