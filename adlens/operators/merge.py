"""A stored table with one row per key, kept up to date by merges: the first row in a given order wins.

Rows lie in hash buckets of their key.  A merge finds the rows that come before what is stored, reading only keys and
order of the buckets they fall in, and writes those buckets anew under the number of its batch; all other files stay as
they are.  A commit names the version of every bucket.  Readers follow the last commit, so a merge that fails
half-way changes nothing, and a batch number that is committed is not merged again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from adlens.operators.ingest import keep_first
from adlens.session import shuffles_dropped


class MergedTable:
    """``keys`` identify a row; of rows with one key that with the smallest ``order`` columns stays (nulls come first).

    ``buckets`` is fixed for the life of the table: what a merge reads and rewrites is a bucket, and a bucket is written as
    ``files`` files.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: Sequence[str],
                 buckets: int = 64, files: int = 1):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.order, self.buckets, self.files = list(keys), list(order), buckets, files

    # ---- commits ----------------------------------------------------------------------

    def _store(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        """Numbers of the batches that are merged, ascending."""
        path, store = self._store("_commits")
        if not store.exists(path):
            return []
        jvm = self.spark.sparkContext._jvm
        return sorted(int(f.getPath().getName()) for f in store.listStatus(path)
                      if store.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))

    def versions(self) -> dict[int, int]:
        """The batch that last wrote each bucket; at most ``buckets`` entries."""
        done = self.commits()
        if not done:
            return {}
        rows = self.spark.read.schema("bucket int, version bigint").parquet(f"{self.path}/_commits/{done[-1]}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _commit(self, batch: int, versions: dict[int, int]) -> None:
        rows = self.spark.createDataFrame(sorted(versions.items()), "bucket int, version bigint")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_commits/{batch}")

    # ---- rows -------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _files_of(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{v}/_bucket={b}" for b, v in sorted(versions.items())])

    def read(self) -> DataFrame:
        """One row per key, as of the last commit; empty before the first."""
        return self._files_of(self.versions())

    def merge(self, rows: DataFrame, batch: int) -> set[int]:
        """Merge ``rows`` (the columns of the table, others are ignored) as batch ``batch``; returns the buckets written.

        Batches may come in any order: the result depends on the rows alone.
        """
        if batch in self.commits():
            return set()
        held = self.versions()
        names = [f.name for f in self.schema]
        first = keep_first(rows.select(*names), self.keys, F.struct(*self.order)).select(*names)
        mine = first.withColumn("_bucket", self._bucket())
        incoming = f"{self.path}/incoming/{batch}"
        self._write(mine, incoming)
        mine = self.spark.read.parquet(incoming)
        met = {b: held[b] for b in self._distinct_buckets(mine) if b in held}
        # Where nothing is stored yet, all rows come first.
        winners = self._better(mine, met, batch) if met else mine
        touched = self._distinct_buckets(winners)
        if touched:
            spread = F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(self.files))
            if kept := {b: held[b] for b in touched if b in held}:
                old = self._files_of(kept).withColumn("_bucket", self._bucket())
                winners = old.alias("n").join(winners.select(*self.keys).alias("o"), self._same(), "left_anti").unionByName(winners)
            self._write(winners.repartition("_bucket", spread), f"{self.path}/rows/{batch}", "_bucket")
        self._commit(batch, {**held, **dict.fromkeys(touched, batch)})
        for name in ("incoming", "better"):
            path, store = self._store(f"{name}/{batch}")
            store.delete(path, True)
        return touched

    def _same(self) -> list[Column]:
        return [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in self.keys]

    def _write(self, rows: DataFrame, path: str, *folders: str) -> None:
        with shuffles_dropped(rows.sparkSession):
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*folders).parquet(path)

    def _better(self, mine: DataFrame, met: dict[int, int], batch: int) -> DataFrame:
        """The rows of ``mine`` that come before what is stored in the buckets ``met``."""
        stored = self._files_of(met)
        place = F.struct(*[F.col(f"n.{c}") for c in self.order])
        known = F.struct(*[F.col(f"o.{c}") for c in self.order])
        places = stored.select(*dict.fromkeys([*self.keys, *self.order])).withColumn("_held", F.lit(True))
        better = f"{self.path}/better/{batch}"
        self._write(mine.alias("n").join(places.alias("o"), self._same(), "left").where(F.col("o._held").isNull() | (place < known)).select("n.*"), better)
        return self.spark.read.parquet(better)

    def _distinct_buckets(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select("_bucket").distinct().collect()}

    def drop_old(self) -> None:
        """Delete what no reader of the last commit needs: former commits and versions of buckets."""
        done, live = self.commits(), self.versions()
        for batch in done[:-1]:
            path, store = self._store(f"_commits/{batch}")
            store.delete(path, True)
        folder, store = self._store("rows")
        if not store.exists(folder):
            return
        for version in store.listStatus(folder):
            number = int(version.getPath().getName())
            for bucket in store.listStatus(version.getPath()):
                name = bucket.getPath().getName()
                if name.startswith("_bucket=") and live.get(int(name.split("=")[1])) != number:
                    store.delete(bucket.getPath(), True)
