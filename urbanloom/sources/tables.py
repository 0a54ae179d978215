"""Delimited tables whose separator and encoding are found from the header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# latin1 under its Spark name; every byte decodes in it, so nothing after it could be reached
ENCODINGS = ["utf-8", "iso-8859-1"]
DELIMITERS = [";", ",", "\t", "|"]


def header_line(spark: SparkSession, path: str) -> str:
    """First line of the table (one row reaches the driver)."""
    row = spark.read.text(path).limit(1).first()
    return row["value"] if row else ""


def _decodes(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether the header bytes are valid in the encoding."""
    if encoding != "utf-8":
        return True
    return "�" not in header_line(spark, path)


def read_csv_sniff(spark: SparkSession, path: str) -> DataFrame:
    """First encoding and separator giving more than one column; a single column otherwise."""
    head = header_line(spark, path)
    for enc in ENCODINGS:
        if not _decodes(spark, path, enc):
            continue
        for sep in DELIMITERS:
            if sep in head:
                return spark.read.csv(path, header=True, sep=sep, encoding=enc)
    return spark.read.csv(path, header=True)


def read_csv_best_delimiter(spark: SparkSession, path: str) -> DataFrame:
    """Separator occurring most often in the header; utf-8, else iso-8859-1."""
    head = header_line(spark, path)
    if not head.strip():
        raise ValueError("the table is empty")
    sep = max(DELIMITERS, key=head.count)
    enc = "utf-8" if _decodes(spark, path, "utf-8") else "iso-8859-1"
    return spark.read.csv(path, header=True, sep=sep, encoding=enc)


def numeric_guess(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Text columns whose values are nearly all numbers become numbers (one aggregate row decides)."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not text:
        return df
    row = df.agg(*[
        (F.count(F.regexp_replace(F.col(f"`{c}`"), ",", ".").try_cast("double")) / F.greatest(F.count(F.col(f"`{c}`")), F.lit(1))).alias(c) for c in text
    ]).first()
    good = [c for c in text if (row[c] or 0) >= share]
    return df.withColumns({c: F.regexp_replace(F.col(f"`{c}`"), ",", ".").try_cast("double") for c in good})
