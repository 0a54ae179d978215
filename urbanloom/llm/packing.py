"""Packing documents into sequences of a fixed number of tokens: concatenate and cut.

Pass one tokenizes every document once and writes the ids as packed bytes, one row per document with its partition
and place. Pass two sums the token totals: running sums within a partition and one offset per partition give every
document its place in one endless stream, without a global sort. Fixed windows of the stream are the sequences; a
document over a window's edge leaves one piece (boundary record) in each window it touches. Only the last
sequence is padded.

Defined results: a null or empty text is the single end id; a null id is kept as null; repeated rows are packed each
on its own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanloom.scale import ensure_checkpoint_dir

from .textvec import release

TOKENIZER_FILE = "byte_bpe_50k.json"


class _Places(dict):
    """Number of every piece (what follows a space); a new piece gets the next number and is noted down."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class TextEncoder:
    """Ids of whole texts by a byte-level BPE file, remembering the ids of pieces already seen.

    Byte-level pre-tokens take a leading space along, so a text may be cut before any space that has no white space
    behind it: the pieces encode to the ids of the whole. Texts with a space before other white space, or with the string
    of an added token, are encoded whole. Pieces met for the first time are encoded together, as one text, by the faster of the two libraries that
    read the vocabulary; it is only used after giving the same ids as the other on a probe. ``limit`` bounds the
    remembered pieces.
    """

    PROBE = " The cat's  2 \n\n naïve déjà-vu  #*$%&|<> ## x=1;\ttab \u4f60\u597d 12,345.67 don't  <|endoftext|> "

    def __init__(self, path: str, limit: int = 150_000) -> None:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in tok.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added) or r"(?!)")  # their strings are one id each, which the other library lacks
        self.plain = lambda text: tok.encode(text, add_special_tokens=False).ids
        self.fast, self.bytes_of = _fast_encoder(tok)
        probe = self.added.sub("", self.PROBE)
        if self.fast(probe) != self.plain(probe):
            self.fast = self.plain
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.place = _Places()
        self.pool = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)

    def learn(self) -> None:
        """Ids of the pieces noted down: tokens end where pieces end, so bytes tell them apart."""
        pieces, self.place.new = self.place.new, []
        if not pieces:
            return
        ids = np.array(self.fast("".join([" " + x for x in pieces])), dtype=np.int32)
        token_end = np.cumsum(self.bytes_of[ids])
        piece_end = np.cumsum([len(x.encode()) + 1 for x in pieces])
        after = np.searchsorted(token_end, piece_end) + 1
        start = np.concatenate([[0], after[:-1]])
        self.start = np.concatenate([self.start, len(self.pool) + start])
        self.length = np.concatenate([self.length, after - start])
        self.pool = np.concatenate([self.pool, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > self.limit:
            self.forget()
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # ids of the text up to its first space, pieces after it
        none = np.zeros(0, np.int64)
        for text in texts:
            if _ODD_SPACE.search(text) or self.added.search(text):
                parts.append((np.asarray(self.plain(text), dtype=np.int32), none))
                continue
            head, *tail = text.split(" ")
            parts.append((np.array(self.fast(head), dtype=np.int32),
                          np.fromiter(map(self.place.__getitem__, tail), np.int64, len(tail))))
        self.learn()
        out = []
        for head, pieces in parts:
            length = self.length[pieces]
            ends = np.cumsum(length)
            shift = np.repeat(self.start[pieces] - ends + length, length)
            out.append(np.concatenate([head, self.pool[shift + np.arange(len(shift))]]))
        return out


_ODD_SPACE = re.compile(r" (?:\s|\Z)")  # a space with white space of any kind after it, or at the end


def _fast_encoder(tok):
    """The same vocabulary in the other library, and the byte length of every id."""
    import tiktoken
    from public_tokenizers import PATTERN

    # byte-level vocabularies write every byte as one printable character
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = set(tok.get_added_tokens_decoder())
    vocab = {bytes(byte_of[c] for c in t): i for t, i in tok.get_vocab().items() if i not in special}
    size = np.zeros(tok.get_vocab_size(), dtype=np.int64)
    size[list(vocab.values())] = [len(t) for t in vocab]
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={}).encode_ordinary, size


def _encoder(path: str) -> TextEncoder:
    """One encoder per Python worker, reused by its tasks."""
    kept = sys.__dict__.setdefault("_packing_encoders", {})
    if path not in kept:
        kept[path] = TextEncoder(path)
    return kept[path]


def write_tokens(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """Pass one, as a table in the shared folder: ``(part, place, id, n, ids)``."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = _encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        place = 0
        for big in batches:
            for b in (big.slice(i, 128) for i in range(0, big.num_rows, 128)):
                ids, ns = [], []
                for encoded in enc.encode([x or "" for x in b.column(2).to_pylist()]):
                    got = np.append(encoded, end_id).astype("<u4")
                    small = got.astype("<u2") if got.max() < 1 << 16 else got
                    ids.append(bytes([small.itemsize]) + pack.compress(small.tobytes()))
                    ns.append(len(got))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(range(place, place + len(ns)), pa.int64()), b.column(1),
                     pa.array(ns, pa.int64()), pa.array(ids, pa.binary())], ["part", "place", "id", "n", "ids"])
                place += len(ns)
        enc.forget()
        release()

    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(id_col).alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(encode, f"part long, place long, id {kind}, n long, ids binary")
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    out.write.option("compression", "none").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """Pieces of all documents: ``(id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset)``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    tokens = write_tokens(docs, id_col, text_col, tokenizer, end_id)
    # one row per partition, whatever the number of documents
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = tokens.select("part", "place", "n").withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    starts = sums.join(F.broadcast(base), "part").select("part", "place", (F.col("base") + F.col("before")).alias("at"))
    placed = tokens.join(starts, ["part", "place"]).select("id", "at", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in (big.slice(i, 512) for big in batches for i in range(0, big.num_rows, 512)):
            out: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids", "crc", "doc", "seq", "offset")}
            for row, (at, raw) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                ids = np.frombuffer(unpack.decompress(raw[1:]), f"<u{raw[0]}").astype("<u4")
                data, edge = ids.tobytes(), -at % length or length
                cuts = [0, *range(edge, len(ids), length), len(ids)]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    piece = data[4 * i : 4 * j]
                    for k, v in zip(out, (row, i, j - i, piece, zlib.crc32(piece), len(ids), (at + i) // length,
                                          (at + i) % length), strict=True):
                        out[k].append(v)
            longs = {k: pa.array(v, pa.int64()) for k, v in out.items() if k != "ids"}
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(longs["row"]), longs["start"], longs["length"], pa.array(out["ids"], pa.binary()),
                 longs["crc"], longs["doc"], longs["seq"], longs["offset"]],
                ["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    pieces = placed.mapInArrow(cut, f"id {kind}, start long, length long, ids binary, ids_crc32 long, "
                                    "doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("id", id_col)
