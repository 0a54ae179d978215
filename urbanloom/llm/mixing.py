"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Documents are dealt into shards by a seeded hash of their id. Within a shard every source owns its documents' tokens
in seeded order, cut into blocks of ``block`` tokens. The shard's seats (blocks) go to the sources by highest
quotient ``votes / (2 seats + 1)``; the votes are the source's share of its target that lies in the shard. A source
with more seats than blocks repeats all its blocks whole and takes the rest from the front of its seeded order.

Only the table of ``(shard, source)`` totals is apportioned in Python, one shard at a time: as many rows as sources.
Rows move once, by shard and source, and stay there for running sums, quotas and the copies that ``draw`` makes of them.
Running sums go over the documents of one source in one shard, about ``shard_docs`` at most, also for a hot source.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, after all others; ties of
quotients go to the earlier source; equal ids share a shard and are ordered by size; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import whole_row

WORD = "[^\\x20\\x09-\\x0D]+"


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats of every party: the ``seats`` highest quotients ``votes / (2k + 1)``; ties go to the earlier party.

    A divisor is bisected down to where one more quotient would be too many; all quotients above it win, and the few
    seats left go out one highest quotient at a time. The cost does not grow with the number of seats.
    """
    votes = np.asarray(votes, dtype=np.float64)
    got = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0 or not votes.sum() > 0:
        return got

    def above(d: float) -> np.ndarray:  # quotients >= d
        return np.floor((votes / d + 1) / 2).astype(np.int64)

    low, high = votes.sum() / (4.0 * seats + 4 * len(votes)), 2 * votes.max()  # too many above low, none above high
    for _ in range(64):
        mid = (low + high) / 2
        if above(mid).sum() > seats:
            low = mid
        else:
            high = mid
    got = above(high)
    for _ in range(int(seats - got.sum())):
        got[np.argmax(votes / (2 * got + 1))] += 1
    return got


def targets(sizes: DataFrame, limit: float = 3.0) -> DataFrame:
    """``(source, source_size, target)``: weights 1, 2, 3 repeating by code point order, null last.

    The shares add up to the size of all sources; a target stops at ``limit`` times its source's size and what is
    over is shared again by weight, until no source is above. Rows: one per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.select("source", "source_size", F.row_number().over(order).alias("place"), F.lit(True).alias("all"))

    def fill(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("place")
        size, weight = table["source_size"].to_numpy(float), (table["place"].to_numpy() - 1) % 3 + 1.0
        total, top = size.sum(), limit * size
        full = np.zeros(len(size), dtype=bool)
        share = np.zeros(len(size))
        while True:
            free = weight[~full].sum()
            share = np.where(full, top, (total - top[full].sum()) * weight / free if free else 0.0)
            over = ~full & (share > top)
            if not over.any():
                break
            full |= over
        return pd.DataFrame({"source": table["source"], "source_size": table["source_size"], "target": share})

    return ranked.groupBy("all").applyInPandas(fill, "source string, source_size long, target double")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = 64,
    shard_docs: int = 2_000,
    limit: float = 3.0,
    seed: int = 17,
    row: str | None = None,
    carry: bool = False,
) -> DataFrame:
    """``(id, size, source_size, target, taken)`` per row: words the mix takes of it, repeats counted.

    ``block``: tokens of a block; a source misses its target by about half a block per shard. ``row``: name of a
    struct column with all columns of ``docs``, if wanted. ``carry``: what a source missed in one shard is added to its
    votes in the next, so it misses its target by about a block over all shards. Shards are then apportioned in turn, in
    one task that reads the totals only.
    """
    n = docs.select(F.count(F.lit(1)).alias("n")).first()["n"]
    shards = max(1, -(-n // shard_docs))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key, deal = (F.md5(F.concat(F.lit(f"{k}:"), name)) for k in (seed + 1, seed))
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("_id"), source.alias("_src"), size.alias("_size"),
        # the source as a key without nulls: a null-safe join would move all rows a second time
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_key_src"),
        (F.conv(F.substring(deal, 1, 7), 16, 10).cast("long") % shards).alias("_shard"), key.alias("_key"),
        *([whole_row(docs).alias("_row")] if row else []),
    )
    cells = rows.groupBy("_shard", "_src").agg(F.sum("_size").alias("_cell"))
    rows = rows.repartition("_shard", "_key_src")  # running sums and the join with quotas share this exchange
    goals = targets(
        cells.groupBy("_src").agg(F.sum("_cell").alias("source_size")).withColumnRenamed("_src", "source"), limit
    )
    voted = cells.join(goals, F.col("_src").eqNullSafe(F.col("source"))).withColumn(
        "_votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("_cell") / F.col("source_size")).otherwise(0.0)
    ).select("_shard", "_src", "_cell", "source_size", "target", "_votes")

    columns = ["_shard", "_src", "_cell", "source_size", "target", "_quota"]

    def apportion(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("_src", na_position="last", kind="stable").reset_index(drop=True)
        source = pd.factorize(table["_src"], use_na_sentinel=False)[0]
        owed = np.zeros(source.max() + 1)
        quota = np.zeros(len(table), dtype=np.int64)
        for _, at in sorted(table.groupby("_shard").indices.items()):
            own = source[at]
            due = owed[own] + table["_votes"].to_numpy(float)[at]
            got = sainte_lague(np.maximum(due, 0), int(round(max(0.0, due.sum()) / block)))
            top = np.floor(limit * table["_cell"].to_numpy(float)[at])
            quota[at] = np.minimum(got * block, top).astype("int64")
            owed[own] = due - quota[at]
        return table.assign(_quota=quota)[columns]

    groups = voted.withColumn("_all", F.lit(True)).groupBy("_all") if carry else voted.groupBy("_shard")
    quotas = groups.applyInPandas(
        apportion, "_shard long, _src string, _cell long, source_size long, target double, _quota long"
    ).select(
        F.col("_shard").alias("_qs"), F.coalesce(F.concat(F.lit("="), "_src"), F.lit("")).alias("_qsrc"), "_cell",
        "source_size", "target", "_quota",
    )
    before = Window.partitionBy("_shard", "_key_src").orderBy("_key", "_id", "_size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = rows.withColumn("_at", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    got = placed.join(quotas, (F.col("_shard") == F.col("_qs")) & (F.col("_key_src") == F.col("_qsrc")))
    whole = F.when(F.col("_cell") > 0, F.floor(F.col("_quota") / F.col("_cell"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("_quota") - whole * F.col("_cell")
    front = F.greatest(F.lit(0), F.least(F.col("_size"), rest - F.col("_at")))
    return got.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
        (whole * F.col("_size") + front).cast("long").alias("taken"),
        *([F.col("_row").alias(row)] if row else []),
    )


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows of ``docs``: a document of size ``s`` of which ``t`` words are taken stands there ``t // s``
    times whole, and once more cut after ``t % s`` words if that is not 0. Documents of which nothing is taken go."""
    mixed = mix(docs, id_col, text_col, source_col, row="_row", **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    words = F.coalesce(F.col("taken") % F.nullif(F.col("size"), F.lit(0)), F.lit(0))
    text = F.col("_row")[text_col]
    lead = F.when(text.rlike("^[\\x20\\x09-\\x0D]"), 2).otherwise(1)  # text before the first word
    rest = F.element_at(F.split(text, "[\\x20\\x09-\\x0D]+", (F.col("_words") + lead).cast("int")), -1)
    part = F.left(text, F.char_length(text) - F.char_length(rest))
    # copies 1 to ``_whole`` are whole, the one after them is cut
    stands = mixed.select("_row", whole.alias("_whole"), words.alias("_words"))
    last = F.col("_whole") + F.when(F.col("_words") > 0, 1).otherwise(0)
    each = stands.where(last > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), last)))
    return each.select(*[
        (F.when(F.col("_i") <= F.col("_whole"), text).otherwise(part) if c == text_col else F.col("_row")[c]).alias(c)
        for c in docs.columns
    ])
