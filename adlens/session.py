"""Session set-up, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on.  Sizes that depend on the cluster
# (executors, memory, shuffle partitions) are left to spark-submit.
# Results depend on these two: timestamps are UTC, and of a JSON object's repeated keys the last one counts.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}
JOB_SETTINGS = {
    **RESULT_SETTINGS,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Streaming state goes to RocksDB, so it may outgrow the executor heap.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}


# Applications whose scratch folder is removed when they end.
_cleaned: set[str] = set()


def build_session(app_name: str = "adlens", master: str | None = None,
                  settings: dict[str, str] | None = None) -> SparkSession:
    """Session with the package's settings; ``settings`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**JOB_SETTINGS, **STREAM_SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Timestamps are UTC throughout, and JSON is read with the last of repeated keys; set what differs."""
    for key, value in RESULT_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or else a folder in the warehouse.

    The warehouse of a session on one machine is a local folder as well; on a cluster it must be a shared one,
    so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not _on_one_machine(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def _on_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Make a folder that the driver's file system removes when the application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder; nothing is created yet."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/adlens/{app}"
    if app not in _cleaned:
        _cleaned.add(app)
        _delete_at_exit(spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


# Shuffle files otherwise stay until the driver happens to collect its garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Whatever is written or checkpointed inside removes its own shuffle files when it is done."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A stream that starts inside has the package's state store, unless the session names another."""
    added = [k for k in STREAM_SETTINGS if spark.conf.get(k, None) is None]
    for key in added:
        spark.conf.set(key, STREAM_SETTINGS[key])
    try:
        yield
    finally:
        for key in added:
            spark.conf.unset(key)


def write_scratch(df: DataFrame, path: str, row_group: int | None = None) -> None:
    """Write a table that is read again soon: packed tightly, and no shuffle files stay behind.

    A reader holds 4096 rows at once, but no more than a row group; ``row_group`` bounds its packed bytes, for tables of long texts.
    """
    writer = df.write.option("compression", "zstd")
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)


# Folders that ``land`` has made inside ``landings_dropped``.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def landings_dropped(spark: SparkSession) -> Iterator[None]:
    """What is landed inside is deleted at the end; a result must be written somewhere else before."""
    held: list[str] = []
    token = _passing.set(held)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in held:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _passing_path(spark: SparkSession, label: str) -> str:
    path, held = scratch_path(spark, label), _passing.get()
    if held is not None:
        held.append(path)
    return path


def land(df: DataFrame, label: str) -> DataFrame:
    """Written to the scratch folder and read back: computed once, survives lost executors, of known size for the planner."""
    path = _passing_path(df.sparkSession, label)
    write_scratch(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def land_alone(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` landed; whatever was landed on the way to it is deleted."""
    path = _passing_path(spark, label)
    with landings_dropped(spark):
        df = build()
        write_scratch(df, path)
    return spark.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints, those of iterative fits too, go to the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.checkpoint(eager=True)
