"""Merkle manifest of a dataset, with a proof per row, by a butterfly exchange between aligned blocks of leaves.

A row's leaf is the SHA-256 of its fields. Leaves of one group (a language) lie in the order of their ids in blocks of
``fanout ** height``; a block is one task's share and hashes its own subtree. Above the blocks there is no path up to a
coordinator and down again: in round r the blocks whose numbers differ only in their r-th digit swap the roots that
they hold, and every one of them hashes the common ancestor itself. After as many rounds as the tree has levels, each
block knows the siblings of all its ancestors. The roots of the groups form the top tree in the same way.

Texts are read and hashed once, by DataFrame functions; what moves afterwards is about 200 bytes a row (id, digests,
place), then at most ``fanout`` digests per block and round. A block in a ragged last subtree stands in for the peers
that do not exist, in turn, so no block sends much more than its share. Rounds are tables in the shared folder.

Defined results: a null field is written as ``-``; a null group is a group of its own, before all others; a null id
comes first in its group; rows of one id are ordered by their leaves, so repeated rows are leaves of their own; an
empty table gives an empty manifest; columns that are not named are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanloom.scale import drop_table, round_table, with_position

SIDES = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def record(fields: Sequence[Column]) -> Column:
    """Fields as one text that no other fields give: ``-`` or byte count, ``:``, value."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def leaf_hash(fields: Sequence[Column]) -> Column:
    return F.sha2(record(fields), 256)


def digest(nodes: Sequence[str]) -> str:
    """Parent of nodes given as hexadecimal text."""
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def subtree(leaves: Sequence[str], height: int, fanout: int) -> list[list[str]]:
    """All levels of a block, its leaves first."""
    out = [list(leaves)]
    for _ in range(height):
        below = out[-1]
        out.append([digest(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def folded(leaf: Column, proof: Column) -> Column:
    """Root that a leaf and the siblings of its ancestors give."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof_hash(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def butterfly(nodes: DataFrame, fanout: int) -> DataFrame:
    """``(tree, place, width, root)`` with the root of the whole tree and ``proof``, the siblings on the way to it.

    ``place`` counts from 0 to ``width - 1`` within a tree. One exchange round per level of the widest tree; a tree
    that has come to its root waits. A round moves at most ``fanout`` digests to each node.
    """
    state = round_table(nodes.select("tree", "place", "width", "root", F.array().cast(SIDES).alias("proof")))
    widest = state.agg(F.max("width").alias("w")).first()["w"] or 0
    for r in range(levels(widest, fanout)):
        step = fanout**r
        child = F.floor(F.col("place") / step)
        at = state.select(
            "tree", F.floor(F.col("place") / (step * fanout)).alias("parent"), (F.col("place") % step).alias("low"),
            (child % fanout).alias("digit"), (F.col("width") > step).alias("live"),
            F.least(F.col("width") - child * step, F.lit(step)).cast("long").alias("held"), "place", "width", "root", "proof",
        )
        # the nodes of a ragged child take the places of its missing ones in turn
        lows = F.explode(F.sequence(F.col("low"), F.lit(step - 1).cast("long"), F.col("held"))).alias("low")
        swapped = at.where("live").select("tree", "parent", F.struct("digit", "root").alias("n"), lows)
        swapped = swapped.groupBy("tree", "parent", "low").agg(F.sort_array(F.collect_list("n")).alias("peers"))

        def joined(keep) -> Column:
            return F.array_join(F.transform(F.filter("peers", keep), lambda n: n["root"]), "")

        own = F.col("digit")
        met = at.join(swapped, ["tree", "parent", "low"], "left").select(
            "tree", "place", "width", "root", "proof", "live", joined(lambda n: n["digit"] < own).alias("left"),
            joined(lambda n: n["digit"] > own).alias("right"),
        )
        after = round_table(met.select(
            "tree", "place", "width",
            F.when(F.col("live"), F.sha2(F.concat("left", "root", "right"), 256)).otherwise(F.col("root")).alias("root"),
            F.when(F.col("live"), F.array_append("proof", F.struct("left", "right"))).otherwise(F.col("proof")).alias("proof"),
        ))
        drop_table(state)
        state = after
    return state


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    carry: Mapping[str, Column] | None = None,
    fanout: int = 8,
    height: int = 4,
) -> DataFrame:
    """One row per input row: ``(id, group, *carry, leaf, subroot, root, proof)``.

    ``proof`` lists, from the leaf's level up to the root, the digests left and right of the node in its run;
    ``folded`` recomputes the root from it. ``carry`` names further columns computed from the input row.
    """
    carry = dict(carry or {})
    group = F.col(f"`{group_col}`").cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit(":"), group), F.lit("-")).alias("tree"),  # null sorts first
        F.col(f"`{id_col}`").alias("id"),
        leaf_hash([F.col(f"`{c}`") for c in fields]).alias("leaf"),
        *[c.alias(f"c{i}") for i, c in enumerate(carry.values())],
    )
    placed = with_position(round_table(rows), ["id", "leaf"], "place", by=["tree"])
    sizes = placed.groupBy("tree").agg(F.max("place").alias("width"))
    size = fanout**height
    leaves = placed.join(sizes, "tree").select(
        "tree", F.floor((F.col("place") - 1) / size).alias("block"), (F.col("place") - 1).alias("place"), "width", "id",
        "leaf", *[f"c{i}" for i in range(len(carry))],
    ).repartition("tree", "block")  # else a partitioning by tree alone would do, with a whole group in one task

    def build(table: pa.Table) -> list[list[str]]:
        up = min(height, levels(table["width"][0].as_py(), fanout))
        return subtree(table["leaf"].to_pylist(), up, fanout)

    def summit(table: pa.Table) -> pa.Table:
        root = build(table.sort_by("place"))[-1]
        blocks = -(-table["width"][0].as_py() // size)
        return pa.table({"tree": table["tree"][:1], "place": table["block"][:1], "width": [blocks], "root": root})

    tops = leaves.select("tree", "block", "place", "width", "leaf").groupBy("tree", "block").applyInArrow(
        summit, "tree string, place long, width long, root string"
    )
    blocks = butterfly(tops, fanout)
    # the top tree: one node per group
    trees = blocks.where("place = 0").select("tree", F.col("root").alias("subroot"))
    ordered = with_position(trees, ["tree"], "at")
    many = ordered.agg(F.max("at")).scalar()
    heads = butterfly(
        ordered.select(F.lit("").alias("tree"), (F.col("at") - 1).alias("place"), many.alias("width"), F.col("subroot").alias("root")),
        fanout,
    ).select(F.col("place").alias("at"), "root", F.col("proof").alias("top"))
    known = ordered.select("tree", "subroot", (F.col("at") - 1).alias("at")).join(heads, "at")
    above = round_table(blocks.select("tree", F.col("place").alias("block"), F.col("proof").alias("mid")).join(known, "tree").select(
        "tree", "block", "subroot", "root", F.concat("mid", "top").alias("above")
    ))
    out_type = T.StructType([
        T.StructField("tree", T.StringType()),
        *[T.StructField(c, leaves.schema[c].dataType) for c in ("id", *[f"c{i}" for i in range(len(carry))], "leaf")],
        T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()),
        T.StructField("proof", SIDES),
    ])

    def prove(table: pa.Table, told: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n, left, right = len(table), [], []
        upper = told["above"][0].as_py()
        for nodes in build(table)[:-1]:
            runs = [nodes[j - j % fanout : j - j % fanout + fanout] for j in range(len(nodes))]
            left.append(["".join(run[: j % fanout]) for j, run in enumerate(runs)])
            right.append(["".join(run[j % fanout + 1 :]) for j, run in enumerate(runs)])
        deep = len(left)

        def side(own: list[list[str]], name: str) -> pa.Array:
            tail = [s[name] for s in upper]
            return pa.array([x for i in range(n) for x in (*(own[k][i // fanout**k] for k in range(deep)), *tail)], pa.string())

        steps = pa.StructArray.from_arrays([side(left, "left"), side(right, "right")], ["left", "right"])
        length = deep + len(upper)
        proof = pa.ListArray.from_arrays(pa.array([i * length for i in range(n + 1)], pa.int32()), steps)
        fixed = {c: pa.array([told[c][0].as_py()] * n, pa.string()) for c in ("subroot", "root")}
        cols = {f.name: table[f.name] if f.name in table.column_names else fixed.get(f.name, proof) for f in out_type.fields}
        return pa.table(cols)

    found = leaves.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(prove, out_type)
    return found.select(
        F.col("id").alias(id_col), F.when(F.col("tree") != "-", F.substring("tree", 2, 2**31 - 1)).alias(fresh_group(group_col, id_col)),
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(carry)], "leaf", "subroot", "root", "proof",
    )


def fresh_group(group_col: str, id_col: str) -> str:
    """Name of the group's column in the result; a table grouped by its id needs another one."""
    return group_col if group_col != id_col else f"{group_col}_group"
