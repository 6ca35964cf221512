"""Session set-up and the few building blocks every distributed loop of the engine shares.

Nothing here collects data that grows with the input: the driver only ever receives single counts and
lists whose length is bounded by a constant named next to them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that count as blank in the tables: blank, tab, carriage return, line feed.
BLANKS = " \t\r\n"

#: A key that holds more than 1/HOT_SHARE of the rows is hot; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 256

#: Narrow rows that one task takes without harm, whatever their key.
TASK_ROWS = 500_000

#: Rows of a two-column key table that may be broadcast after they have been counted.
BROADCAST_ROWS = 200_000


def build_session(app: str = "theoremill", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine assumes; on a cluster the submitted settings hold."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only where none is named and all runs on this
    machine (tests) one of our own. On a cluster a folder must be named."""
    global _own_folder
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named and _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="theoremill-")
    return f"{named or _own_folder}/theoremill"


_own_folder: str | None = None


def cut(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there, so lost executors
    cost nothing that was finished, and the next plan starts from true sizes (a checkpoint would carry the
    estimates and constraints of its plan along, which multiply over the rounds of a loop).

    ``replaces``: an earlier result of this function that nothing reads any more; its table is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None:
        release(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables of results of :func:`cut`; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_table_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def strip(column: Column | str) -> Column:
    """``column`` without the blanks of :data:`BLANKS` around it."""
    return F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(BLANKS))


def tokens(column: Column | str) -> Column:
    """Array of the runs of non-blank characters; null gives null."""
    return F.filter(F.split(column, f"[{BLANKS}]+"), lambda t: t != "")


def latest(df: DataFrame, key: str, order: Sequence[str], keep_null_keys: bool = False) -> DataFrame:
    """One row per ``key``: the greatest by ``order``, of equal ones the greatest by all other columns.

    Only the keys are shuffled to find the repeated ones; rows whose key stands alone never move. The
    repeated keys are counted first: few are broadcast, many are joined by shuffle. Rows with a null key
    are dropped unless ``keep_null_keys``; nulls in ``order`` sort first, so any value beats them.
    """
    repeated = cut(df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(key))
    n = repeated.count()
    known = df if keep_null_keys else df.filter(F.col(key).isNotNull())
    if n == 0:
        return known
    side = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    rest = [c for c in df.columns if c != key and c not in order]
    picked = (
        df.join(side, key, "left_semi")
        .groupBy(key)
        .agg(F.max(F.struct(*order, *rest)).alias("_row"))
        .select(*[F.col(key) if c == key else F.col(f"_row.`{c}`").alias(c) for c in df.columns])
    )
    return known.join(side, key, "left_anti").select(*df.columns).unionByName(picked)


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE, total: int | None = None) -> list:
    """The keys that hold more than 1/``share`` of the rows of ``df``: at most ``share`` values.

    A table of up to TASK_ROWS rows has none: one task may hold all of it. ``total`` saves counting.
    """
    total = df.count() if total is None else total
    if total <= TASK_ROWS:
        return []
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counts.filter(F.col("_n") > max(total // share, 1)).select(key).limit(share).collect()]


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner", total: int | None = None, hot: list | None = None) -> DataFrame:
    """Join ``left`` to ``right``, which has ``key`` unique, without a hot key landing in one task.

    Hot keys of ``left`` are at most :data:`HOT_SHARE`, so their rows of ``right`` are a broadcast of
    proven size; all others are joined by shuffle. ``total``: the rows of ``left``, if known; ``hot``: its hot
    keys, if known.
    """
    hot = hot_keys(left, key, total=total) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cold = F.coalesce(~is_hot, F.lit(True))
    return left.filter(cold).join(right.filter(~is_hot), key, how).unionByName(
        left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how)
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Inner join on ``key`` where both sides may repeat it. A key hot on one side has that side's rows spread
    over ``salts`` tasks and the other's repeated once per salt; hot on both, over ``salts`` squared."""
    hot_left, hot_right = hot_keys(left, key), hot_keys(right, key)
    if not hot_left and not hot_right:
        return left.join(right, key)

    def salted(side: DataFrame, own: str, other: str, hot_own: list, hot_other: list) -> DataFrame:
        spread = F.when(F.col(key).isin(hot_own), F.pmod(F.xxhash64(*side.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
        copies = F.when(F.col(key).isin(hot_other), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        return side.withColumn(own, spread if hot_own else F.lit(0)).withColumn(other, F.explode(copies) if hot_other else F.lit(0))

    spread_left = salted(left, "_salt_l", "_salt_r", hot_left, hot_right)
    return spread_left.join(salted(right, "_salt_r", "_salt_l", hot_right, hot_left), [key, "_salt_l", "_salt_r"]).drop("_salt_l", "_salt_r")


def row_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """``df`` with a dense 0-based index in the order of the columns ``order`` (which must have no ties), as a
    global row_number would give, but without one task sorting all rows: range partitions are numbered
    within and shifted by the counts of those in front, one row per partition."""
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("_part").count().collect())  # one row per partition
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    shift = df.sparkSession.createDataFrame(offsets, "_part int, _shift long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_row", within).join(F.broadcast(shift), "_part").withColumn(name, F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan in at least as many partitions as there are cores: one small file would keep a heavy pass
    over its rows in one task. Larger tables stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder of files) under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
