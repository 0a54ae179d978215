"""Exact duplicates by a 128-bit content hash, with the bytes compared inside every group.

DataFrame functions only. The light table ``(id, hash)`` is aggregated first (partial sums before the shuffle), so
a group of any size is one row per hash and task. Texts move once, keyed by hash; the rows whose hash occurs more than
once are written to the shared folder, and only those move again. Both joins stand alone between exchanges, so the
runtime can split a hot group.

Defined results: a null text counts as empty; a null id sorts below every other id; rows that repeat both id and
text belong to one document (all of them report ``kept``; ``deduplicate`` leaves one of them); an empty table gives
an empty result; other columns are ignored by ``exact_duplicates`` and carried by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.scale import round_table

from .blocks import whole_row

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of one byte per character take the short way."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = fold_ascii,
    hash_fn: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: ``(id, keep_id, group_size, kept, text_sha256)``.

    ``keep`` names the row of a group that stays: the smallest or the largest id. ``hash_fn`` only decides which
    texts are compared; two texts with one hash but different bytes never share a group.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    pick, by = (F.max, F.max_by) if keep == "largest" else (F.min, F.min_by)
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).withColumn("_h", hash_fn(F.col("_t")))
    groups = (
        rows.groupBy("_h", "_id").agg(F.count(F.lit(1)).alias("_c"))
        .groupBy("_h").agg(F.sum("_c").alias("_n"), pick("_id").alias("_keep"), by("_c", "_id").alias("_copies"))
    )
    sha = F.unhex(F.sha2(F.col("_t"), 256))
    light = rows.select("_id", "_h", sha.alias("_sha")).join(groups, "_h")
    single = light.where("_n = 1").select("_id", F.col("_id").alias("_keep"), "_n", "_sha")
    # texts of one hash: each row against the row that would stay
    several = round_table(rows.join(groups.where("_n > 1"), "_h"))
    stays = several.where(F.col("_id").eqNullSafe(F.col("_keep"))).groupBy("_h", "_keep").agg(F.min("_t").alias("_rep"))
    stays = stays.select(F.col("_h").alias("_rh"), F.col("_keep").alias("_rid"), "_rep")
    met = several.select("_id", "_h", "_t", "_keep", "_n", sha.alias("_sha")).join(
        stays, F.col("_h") == F.col("_rh")
    ).withColumn("_same", F.col("_t") == F.col("_rep"))
    apart = met.where(~F.col("_same"))  # collisions: grouped again by the bytes themselves
    lost = apart.groupBy("_h").agg(F.count(F.lit(1)).alias("_lost"))
    equal = met.where("_same").select("_id", "_h", "_keep", "_n", "_sha").join(lost, "_h", "left").select(
        "_id", "_keep", (F.col("_n") - F.coalesce("_lost", F.lit(0))).alias("_n"), "_sha"
    )
    exact = apart.groupBy("_h", "_t").agg(F.count(F.lit(1)).alias("_n"), pick("_id").alias("_keep"))
    split = apart.select("_id", "_h", "_t", "_sha").join(exact, ["_h", "_t"]).select("_id", "_keep", "_n", "_sha")
    return single.unionByName(equal).unionByName(split).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns kept.

    Rows leave by an anti join on the id and the text's hash. Where an id stands on several equal rows, one of
    those rows is left.
    """
    found = exact_duplicates(docs, id_col, text_col, keep)
    kept = found.where("kept").groupBy(id_col, "text_sha256").agg(F.count(F.lit(1)).alias("_copies"))
    kept = kept.select(F.col(id_col).alias("_kid"), F.col("text_sha256").alias("_ksha"), "_copies")
    sha = F.sha2(fold_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)
    held = docs.select(whole_row(docs).alias("_row"), F.col(id_col).alias("_did"), sha.alias("_dsha")).join(
        kept, F.col("_did").eqNullSafe(F.col("_kid")) & (F.col("_dsha") == F.col("_ksha"))
    )
    once = held.where("_copies = 1").select("_row")
    repeated = held.where("_copies > 1").groupBy("_did", "_dsha").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(repeated).select("_row.*")
