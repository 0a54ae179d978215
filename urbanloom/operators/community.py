"""Communities of a network by modularity: Louvain in rounds of joins, level after level.

A round finds every node's best move (largest gain of modularity, smallest community on ties) and carries out as many
as cannot spoil each other. A community either takes or gives in a round, whichever its best move asks for, so no node
joins another that leaves. Nodes that enter or leave one community together add ``k_i * k_j / (2 m**2)`` of loss per
pair at most; moves are ranked by gain per strength in cells of a community, and one is accepted only if its gain
covers that loss against all cells up to its own. The best move of all always passes, so modularity rises in every
round, and rounds end by themselves. Then each community becomes a node, parallel edges are summed, and the next level
starts; a level without a move is the last.

Rows of a round: edges, then one per node that wants to move, then cells (at most ``LEVELS * TURNS`` per community), so
a hub that everybody joins is a group of cells and not of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import drop_table, round_table

LEVELS, TURNS = 64, 32
TINY = 1e-12  # gains below this share of the whole are rounding


def _graph(edges: DataFrame, weight: str | None) -> DataFrame:
    """``(u, v, w)``, u < v or a loop, parallel edges summed; weights of null or at most 0 are dropped."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), w.alias("w")).where("w > 0")
    return e.groupBy("u", "v").agg(F.sum("w").alias("w"))


def _moves(both: DataFrame, state: DataFrame, m: float, resolution: float, turn: int) -> DataFrame:
    """Best move with a gain of every node: ``(node, own, to, k, gain, rank)``."""
    there = state.select(F.col("node").alias("v"), F.col("community").alias("c"))
    ties = both.join(there, "v").groupBy(F.col("u").alias("node"), "c").agg(F.sum("w").alias("w"))
    tot = state.groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("t"))
    own = state.join(tot.withColumnRenamed("t", "t_own"), F.col("community") == F.col("c")).select(
        "node", F.col("community").alias("own"), "k", (F.col("t_own") - F.col("k")).alias("rest"))
    seen = ties.join(own, "node").join(tot, "c")
    inside = F.sum(F.when(F.col("c") == F.col("own"), F.col("w")).otherwise(0.0))
    loss = resolution * F.col("k") / (2 * m * m)
    value = F.col("w") / m - loss * F.col("t")
    best = seen.groupBy("node", "own", "k", "rest").agg(
        inside.alias("inside"), F.min(F.when(F.col("c") != F.col("own"), F.struct((-value).alias("x"), F.col("c").alias("to")))).alias("b"))
    gain = -F.col("b.x") - (F.col("inside") / m - loss * F.col("rest"))
    found = best.where(F.col("b").isNotNull()).select("node", "own", F.col("b.to").alias("to"), "k", gain.alias("gain"))
    order = F.crc32(F.concat_ws(":", F.col("node").cast("string"), F.lit(str(turn))))
    rank = F.struct((F.col("gain") / F.col("k")).alias("r"), order.alias("turn"), F.col("node").alias("node"))
    return round_table(found.where(F.col("gain") > TINY).select("*", rank.alias("rank")))


def _accepted(want: DataFrame, first, m: float, resolution: float) -> DataFrame:
    """Moves ``(node, to)`` that together raise modularity; ``first`` is the node of the highest rank."""
    sides = want.select("rank", F.explode(F.array(
        F.struct(F.col("to").alias("c"), F.lit(True).alias("in")), F.struct(F.col("own").alias("c"), F.lit(False).alias("in")))).alias("s"))
    role = sides.groupBy(F.col("s.c").alias("c")).agg(F.max(F.when(F.col("s.in"), F.col("rank"))).alias("taken"), F.max(F.when(~F.col("s.in"), F.col("rank"))).alias("given"))
    role = role.select("c", (F.col("given").isNull() | F.coalesce(F.col("taken") > F.col("given"), F.lit(False))).alias("takes"))
    takers = role.where("takes").select(F.col("c").alias("to"))
    givers = role.where("not takes").select(F.col("c").alias("own"))
    fair = want.join(takers, "to", "left_semi").join(givers, "own", "left_semi")
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), (-F.floor(F.log2(F.col("rank.r") * m))).cast("int") + LEVELS // 2))
    fair = fair.withColumns({"level": level, "cell": F.col("rank.turn") % TURNS})
    # strength of all movers of a community, which here only enter or only leave it, up to and with a cell
    cells = fair.select(F.explode(F.array("to", "own")).alias("c"), "level", "cell", "k").groupBy("c", "level", "cell").agg(F.sum("k").alias("k"))
    w = Window.partitionBy("c").orderBy("level", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crowd = cells.select("c", "level", "cell", F.sum("k").over(w).alias("crowd"))
    entering = crowd.withColumnsRenamed({"c": "to", "crowd": "entering"})
    leaving = crowd.withColumnsRenamed({"c": "own", "crowd": "leaving"})
    met = fair.join(entering, ["to", "level", "cell"]).join(leaving, ["own", "level", "cell"])
    others = F.col("entering") + F.col("leaving") - 2 * F.col("k")
    # the first needs no cover: its cell mates cover the pairs with it
    covered = (F.col("gain") > resolution * F.col("k") * others / (2 * m * m)) | (F.col("node") == first)
    return met.where(covered).select("node", "to")


def louvain(edges: DataFrame, weight: str | None = None, resolution: float = 1.0, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Communities ``(node, community)``, named after their smallest node, and ``(level, communities, modularity)``.

    A level ends when all moves still wanted would gain less than ``tolerance`` together. Level 0 is every node alone.
    A loop is an edge inside its node's community. Nodes without an edge of positive weight are left out.
    """
    spark = edges.sparkSession
    e = round_table(_graph(edges, weight))
    m = e.agg(F.sum("w")).first()[0] or 0.0
    labels = round_table(e.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("community", F.col("node")))
    log: list[tuple[int, int, float]] = []
    if m:
        log.append((0, *_quality(e, m, resolution)))
    level, turn = 0, 0
    while m:
        level += 1
        both = round_table(e.where("u <> v").select("u", "v", "w").unionByName(e.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
        ends = e.select(F.explode(F.array(F.col("u"), F.col("v"))).alias("node"), "w")  # a loop counts twice
        state = round_table(ends.groupBy("node").agg(F.sum("w").alias("k")).withColumn("community", F.col("node")))
        moved = False
        while True:
            turn += 1
            want = _moves(both, state, m, resolution, turn)
            top = want.agg(F.sum("gain").alias("gain"), F.max("rank").alias("rank")).first()
            if (top["gain"] or 0.0) < tolerance:
                drop_table(want)
                break
            moved = True
            last = state
            state = round_table(state.join(_accepted(want, top["rank"]["node"], m, resolution), "node", "left").select("node", "k", F.coalesce("to", "community").alias("community")))
            drop_table(last)
            drop_table(want)
        drop_table(both)
        if not moved:
            drop_table(state)
            break
        names = state.groupBy("community").agg(F.min("node").alias("name"))
        named = round_table(state.join(names, "community").select(F.col("node").alias("part"), "name"))
        last, labels = labels, round_table(labels.join(named, F.col("community") == F.col("part")).select("node", F.col("name").alias("community")))
        drop_table(last)
        a = named.select(F.col("part").alias("u"), F.col("name").alias("cu"))
        b = named.select(F.col("part").alias("v"), F.col("name").alias("cv"))
        joined = e.join(a, "u").join(b, "v").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v"), "w")
        last, e = e, round_table(joined.groupBy("u", "v").agg(F.sum("w").alias("w")))
        for t in (last, state, named):
            drop_table(t)
        log.append((level, *_quality(e, m, resolution)))
    return labels, spark.createDataFrame(log, "level int, communities long, modularity double")


def _quality(e: DataFrame, m: float, resolution: float) -> tuple[int, float]:
    """Number of nodes of a contracted graph and the modularity of its nodes as communities."""
    per = e.select(F.explode(F.array(
        F.struct(F.col("u").alias("c"), F.col("w").alias("k"), F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0).alias("i")),
        F.struct(F.col("v").alias("c"), F.col("w").alias("k"), F.lit(0.0).alias("i")))).alias("x")).select("x.*")
    per = per.groupBy("c").agg(F.sum("k").alias("k"), F.sum("i").alias("i"))
    got = per.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("i") / m - resolution * F.pow(F.col("k") / (2 * m), 2)).alias("q")).first()
    return got["n"], got["q"]
