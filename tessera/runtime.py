"""Session building, staged tables, global row numbers and the driver tables' reader."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests.
_FALLBACK: list[str] = []
_STAGED: list[str] = []
#: The catalog's names of those staged by a key.
_TABLES: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessera")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, in a local session, one of the driver's own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _FALLBACK[0]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        if path in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        for path in _STAGED:
            _drop(spark, path)


atexit.register(_drop_all)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Cuts the lineage like checkpoint(): a lost executor costs no recomputation of what stands above, and several
    readers see the same rows. The files go when the driver's process ends, or with unstage().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")  # nothing reads this write's shuffles again: they go when it ends
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    _STAGED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def stage_by(df: DataFrame, name: str, key: str, together: bool = False) -> DataFrame:
    """As stage(), with the rows of a key's hash together in files that joins and grouping on it read without a shuffle.

    It has as many buckets as the session has shuffle partitions, so that the other side of a join meets it as it comes.
    together: whether a key's rows already are in one partition, as after grouping by it.
    """
    spark = df.sparkSession
    table = f"tessera_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table.replace('tessera_', 'tessera-', 1)}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        (df if together else df.repartition(n, key)).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    _STAGED.append(path)
    _TABLES[path] = table
    out = spark.table(table)
    out._tessera_path = path
    return out


def own(path: str) -> str:
    """Have a folder deleted when the driver's process ends, as stage()'s are."""
    _STAGED.append(path)
    return path


def unstage(df: DataFrame) -> None:
    """Delete what stage() wrote, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path in _STAGED:
        _STAGED.remove(path)
        _drop(df.sparkSession, path)


def staged_paths() -> list[str]:
    """The folders of staged tables that still stand."""
    return list(_STAGED)


def release(spark: SparkSession, paths: list[str], still_read_by: DataFrame) -> list[str]:
    """Deletes those of the staged folders that a frame does not read from; returns the others."""
    files = still_read_by.inputFiles() if paths else []
    kept = [p for p in paths if any(p.split("/tessera-")[-1] in f for f in files)]
    for path in set(paths) - set(kept):
        if path in _STAGED:
            _STAGED.remove(path)
            _drop(spark, path)
    return kept


def numbered(df: DataFrame, order: list[Column], name: str, sums: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """Global row numbers (from 0) and running sums before each row, in the given order, without one task that sees all rows.

    Rows are range-partitioned by `order`, sorted in their partitions and staged once with their partition and place;
    each partition's count and sums are then added up over the few partitions and added to the places inside them.
    sums: new column -> column whose sum over all earlier rows it gets. Rows that are equal in `order` are numbered in
    any order; a last salt parts a hot order key. The returned frame has one row for each of df's.
    """
    sums = sums or {}
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange(n, *order, F.col("_salt")).sortWithinPartitions(*order, F.col("_salt"))
    placed = ranged.withColumn("_mid", F.monotonically_increasing_id())
    placed = placed.withColumn("_pid", F.shiftright("_mid", 33).cast("int")).withColumn("_at", F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid", "_salt")
    kept = stage(placed, name)
    totals = kept.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    # one row for each partition: their number is the session's setting and does not follow the data
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"), *[F.coalesce(F.sum(f"_sum_{k}").over(w), F.lit(0)).alias(f"_start_{k}") for k in sums])
    out = kept.join(F.broadcast(starts), "_pid")
    inside = Window.partitionBy("_pid").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return out.select(
        *df.columns,
        (F.col("_start") + F.col("_at")).alias(name),
        *[(F.col(f"_start_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(k) for k, c in sums.items()],
    )
