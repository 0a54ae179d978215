"""Building blocks that keep operators safe on very large or skewed inputs.

* ``cut_lineage`` - reliable checkpoint in the cluster's shared folder.
* ``joins_by_true_size`` - broadcasts only on sizes measured at run time.
* ``one_row`` - global statistics as a scalar subquery (no driver round trip, no cross join).
* ``exact_quantiles`` - exact interpolated quantiles without holding a group in one task.
* ``with_position`` / ``with_running_total`` - total order positions and running sums that
  range-partition the data instead of sorting a whole group in one task.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROW_BITS = 33  # monotonically_increasing_id() keeps the partition number above bit 33


def session(app: str = "urbanloom", cpus: str | int = "*", partitions: int = 8, **conf) -> SparkSession:
    """Local session with the settings the operators expect (a cluster sets its own)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, falls back to a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once per Spark context.

    Spark's file server hands the archive out, so workers need neither a shared folder nor a set path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_urbanloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "urbanloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("urbanloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._urbanloom_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: an iterative plan stays short and survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def round_table(df: DataFrame) -> DataFrame:
    """One round of an iteration as a table in the checkpoint folder, with its true size.

    A checkpoint keeps the *estimated* size of its plan. In a loop of self-joins that estimate is squared
    every round; a written table starts each round from the size on disk, so the planner can also
    broadcast what turned out small.
    """
    spark = df.sparkSession
    path = table_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._round_path = path
    return out


def table_path(spark: SparkSession) -> str:
    """A new folder name in the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"


def drop_table(df: DataFrame | None) -> None:
    """Remove the files of a ``round_table`` that nothing reads any more."""
    path = getattr(df, "_round_path", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder made under ``table_path``."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def joins_by_true_size(spark: SparkSession) -> None:
    """Let only sizes seen at run time decide on a broadcast.

    The planner's estimate starts from the compressed file and knows nothing of exploded rows: ends of lines, samples
    or cells then pass for a small table, and the driver collects millions of rows. With adaptive execution a join
    whose exchanged side did turn out small is still broadcast; a broadcast asked for by name stays one.

    That holds for a side of a few keys too. Spark else keeps such joins as sorts, and the rows of a key go to one task.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin", "0")
    if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")


def one_row(df: DataFrame, **aggs: Column) -> Column:
    """Struct column holding global aggregates of ``df``; read fields with ``s["name"]``."""
    return df.agg(F.struct(*[c.alias(k) for k, c in aggs.items()]).alias("s")).scalar()


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on ``keys`` between two frames."""
    return reduce(lambda p, q: p & q, [a[k].eqNullSafe(b[k]) for k in keys])


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left copy of the keys."""
    renamed = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    cond = reduce(lambda p, q: p & q, [a[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return a.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group ``(*by, n, q ARRAY<DOUBLE>)``.

    A mergeable sketch first brackets every wanted rank. The second pass keeps single values only
    inside the brackets (about ``8/accuracy`` of a group) and counts everything else map-side, so no
    task ever sees a whole group. NULL and NaN values are ignored.
    """
    by = list(by)
    probs = [float(p) for p in probs]
    v = df.select(*by, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    margin = 4.0 / accuracy
    inner = sorted({p for q in probs for p in (q - margin, q + margin) if 0 < p < 1})
    at = {p: i for i, p in enumerate(inner)}
    sketch = v.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        (F.percentile_approx("_v", inner, accuracy) if inner else F.array().cast("array<double>")).alias("_b"),
    )
    if by:
        tagged = join_on(v, sketch, by)
    else:
        s = sketch.select(F.struct("_n", "_b").alias("s")).scalar()
        tagged = v.select("_v", s["_n"].alias("_n"), s["_b"].alias("_b"))

    def edge(p: float, default: str) -> Column:
        return F.element_at("_b", at[p] + 1) if p in at else F.lit(default).cast("double")

    inside = reduce(
        lambda a, b: a | b,
        [
            (F.col("_v") >= edge(q - margin, "-Infinity")) & (F.col("_v") <= edge(q + margin, "Infinity"))
            for q in probs
        ],
    ) | (F.col("_n") <= accuracy)  # small groups are kept whole; larger ones have brackets of 4+ ranks
    slot = F.size(F.filter("_b", lambda b: b < F.col("_v")))
    counted = (
        tagged.select(*by, "_n", "_v", slot.alias("_slot"), F.when(inside, F.col("_v")).alias("_in"))
        .groupBy(*by, "_n", "_slot", "_in")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"))
    )
    w = Window.partitionBy(*by).orderBy("_lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_cum", F.sum("_c").over(w))

    def at_rank(rank: Column) -> Column:
        hit = (F.col("_cum") > rank) & (F.col("_cum") - F.col("_c") <= rank)
        return F.max(F.when(hit, F.col("_in")))

    picks = []
    for i, p in enumerate(probs):
        pos = F.lit(p) * (F.col("_n") - 1)
        picks.append(at_rank(F.floor(pos)).alias(f"_a{i}"))
        picks.append(at_rank(F.ceil(pos)).alias(f"_z{i}"))
    got = ranked.groupBy(*by, "_n").agg(*picks)
    qs = []
    for i, p in enumerate(probs):
        pos = F.lit(p) * (F.col("_n") - 1)
        a, z = F.col(f"_a{i}"), F.col(f"_z{i}")
        qs.append(a + (z - a) * (pos - F.floor(pos)))
    return got.select(*by, F.col("_n").alias("n"), F.array(*qs).alias("q"))


def quantile_row(df: DataFrame, value: str, probs: Sequence[float]) -> Column:
    """Global exact quantiles as an ``ARRAY<DOUBLE>`` scalar subquery."""
    return exact_quantiles(df, value, probs).select("q").scalar()


def _placed(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` in global order and materialised, with ``_pid`` (partition) and ``_idx`` (0-based)."""
    mid = F.monotonically_increasing_id()
    out = cut_lineage(df.orderBy(*order).withColumn("_mid", mid))
    return out.withColumn("_pid", F.shiftright("_mid", _ROW_BITS)).withColumn(
        "_idx", F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1)
    )


def with_position(
    df: DataFrame, order: Sequence[Column | str], name: str = "position", by: Sequence[str] = ()
) -> DataFrame:
    """1-based position in the order, restarting for each ``by`` group.

    The rows are range-partitioned on ``(by, order)``, so a hot group spreads over many tasks. Only
    one offset row per partition is combined centrally.
    """
    by = list(by)
    p = _placed(df, [*by, *order])
    sizes = p.groupBy("_pid").agg((F.max("_idx") + 1).alias("_size"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_pid"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off")
    )
    # one row per shuffle partition: the bound is the partition count, not the data
    out = p.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_idx") + 1)
    out = out.drop("_pid", "_idx", "_mid", "_off")
    if not by:
        return out
    first = out.groupBy(*by).agg(F.min(name).alias("_first"))
    return join_on(out, first, by).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")


def with_running_total(
    df: DataFrame, order: Sequence[Column | str], value: str, name: str = "running_total"
) -> DataFrame:
    """Running sum of ``value`` over a global order; the order must be total."""
    p = _placed(df, order)
    local = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumn("_run", F.sum(value).over(local))
    sizes = p.groupBy("_pid").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_pid"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    out = p.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_run") + F.col("_off"))
    return out.drop("_pid", "_idx", "_mid", "_off", "_run")
