"""Queries over the given tables, one per operator, with reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    tokenizer = public_tokenizers.path(packing.TOKENIZER_FILE)
    return packing.pack(_documents(spark, sf_dir), tokenizer).drop("ids")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(_documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_documents(spark, sf_dir), keep="largest")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), "text", "lang", "doc_id")
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_classifier as Q

    crc = F.crc32(F.col("doc_id").cast("string")) % 3
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = Q.score(docs, Q.fit(docs, labels.where(crc != 1)))
    return found.select(
        "doc_id", F.coalesce(crc == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_documents(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root, and whether its tampered form still gives the root."""
    from . import merkle
    from .exact_dedup import fold_ascii

    fields = ("doc_id", "source", "lang", "n_chars", "text")
    changed = merkle.leaf_hash([fold_ascii(F.col("text")) if c == "text" else F.col(c) for c in fields])
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle.manifest(_documents(spark, sf_dir), fields, carry={"tampered": F.when(hit, changed)})
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a lexicon learned from the labels outside the held-out fifth."""
    from . import toxicity

    crc = F.crc32(F.col("doc_id").cast("string")) % 5
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = toxicity.score(docs, toxicity.learn(docs, labels.where(crc != 0)))
    return found.select(
        "doc_id", F.coalesce(crc == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every pair of sources of a language, and the terms by which a source stands out."""
    from .divergence import audit

    return audit(_documents(spark, sf_dir).select("text", "lang", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_html_text, op3_quality_rules, op4_exact_dedup, op5_substring_dedup, op6_mixing, op7_language_id, op8_minhash, op9_quality_classifier, op10_suffix_array_dedup, op11_merkle, op12_toxicity, op13_divergence)
}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"



def _hex7(text: str) -> str:
    """Number of the first seven hexadecimal digits."""
    return "(" + " + ".join(f"(strpos('0123456789abcdef', substr({text}, {i}, 1)) - 1) * {16 ** (7 - i)}" for i in range(1, 8)) + ")"


def _field(c: str) -> str:
    """A field as byte count, colon and value, or a dash."""
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of a number's digits, bit by bit
_CRC = """xor(4294967295, list_reduce(
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
    lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(c, b)),
    4294967295::BIGINT))"""

ORACLE_SQL: dict[str, str] = {
    "op11_merkle": f"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, lang, {_CRC} % 3 = 0 AS hit,
                sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
                sha256({" || ".join(_field(_LOWER if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS changed
            FROM documents
        ), n(lvl, lang, p, h, r) AS (
            SELECT 0, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1, leaf, r FROM d
            UNION ALL
            SELECT any_value(lvl) + 1, lang, p // 8, sha256(string_agg(h, '' ORDER BY p)), NULL
            FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM n) WHERE c > 1 GROUP BY lang, p // 8
        ), s AS (SELECT lang, max(lvl) AS deep, arg_max(h, lvl) AS subroot FROM n GROUP BY lang),
        t(lvl, lang, p, h) AS (
            SELECT 0, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1, subroot FROM s
            UNION ALL
            SELECT any_value(lvl) + 1, NULL, p // 8, sha256(string_agg(h, '' ORDER BY p))
            FROM (SELECT *, count(*) OVER () AS c FROM t) WHERE c > 1 GROUP BY p // 8
        ), top AS (SELECT max(lvl) AS deep, arg_max(h, lvl) AS root FROM t),
        way AS (
            SELECT a.r, l.i AS lvl, a.lang, a.p // CAST(pow(8, l.i) AS BIGINT) AS p
            FROM n a JOIN s ON a.lang IS NOT DISTINCT FROM s.lang, LATERAL (SELECT unnest(range(s.deep)) AS i) l WHERE a.lvl = 0
        ), low AS (
            SELECT w.r, w.lvl, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < w.p), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > w.p), '') AS g
            FROM way w JOIN n b ON b.lvl = w.lvl AND b.lang IS NOT DISTINCT FROM w.lang AND b.p // 8 = w.p // 8 GROUP BY w.r, w.lvl, w.p
        ), head AS (
            SELECT s.lang, s.deep, l.i AS lvl, a.p // CAST(pow(8, l.i) AS BIGINT) AS p
            FROM s JOIN t a ON a.lvl = 0 AND a.lang IS NOT DISTINCT FROM s.lang, top, LATERAL (SELECT unnest(range(top.deep)) AS i) l
        ), high AS (
            SELECT w.lang, w.deep + w.lvl AS lvl, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p < w.p), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.p) FILTER (b.p > w.p), '') AS g
            FROM head w JOIN t b ON b.lvl = w.lvl AND b.p // 8 = w.p // 8 GROUP BY w.lang, w.deep, w.lvl, w.p
        ), step AS (
            SELECT r, lvl, l, g FROM low UNION ALL SELECT d.r, lvl, l, g FROM d JOIN high ON d.lang IS NOT DISTINCT FROM high.lang
        ), proof AS (SELECT r, string_agg(l || g, '' ORDER BY lvl) AS x FROM step GROUP BY r),
        fold(r, lvl, h) AS (
            SELECT r, 0, CASE WHEN hit THEN changed ELSE leaf END FROM d
            UNION ALL SELECT fold.r, fold.lvl + 1, sha256(l || h || g) FROM fold JOIN step ON step.r = fold.r AND step.lvl = fold.lvl
        ), done AS (SELECT r, arg_max(h, lvl) AS folded_root FROM fold GROUP BY r)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(x, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang JOIN done USING (r) LEFT JOIN proof USING (r), top
    """,
    "op13_divergence": f"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                regexp_extract_all({_LOWER.replace("text", "coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
            FROM documents
        ), t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT lang, source, coalesce(any_value(m), 0) AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS m FROM c GROUP BY ALL) USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
            FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
        ), q AS (
            SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)) // (any_value(m) + 2 * any_value(v)) AS q
            FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS m FROM g GROUP BY lang) USING (lang) GROUP BY lang, term
        ), pair AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(any_value(f), 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
                SELECT x.lang, x.source AS s, y.source AS o, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f
                FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
            ) z ON z.lang = a.lang AND z.s = a.source AND z.o = b.source GROUP BY ALL
        ), part AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pair
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM part)
        WHERE part = 'pair' OR rank <= 10
    """,
    "op4_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t
    """,
    "op5_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
        ), lo AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
        gone AS (
            SELECT DISTINCT doc_id, i + j AS p
            FROM (SELECT doc_id, i, unnest(range(50)) AS j FROM win JOIN lo USING (k) WHERE first < doc_id)
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
            FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p)
            GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op6_mixing": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('18:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
                {_hex7("md5('17:' || coalesce(CAST(doc_id AS VARCHAR), ''))")} % (SELECT greatest(1, CAST(ceil(count(*) / 2000) AS BIGINT)) FROM documents) AS shard
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY source
        ), fill(i, place, size, weight, full_up) AS (
            SELECT 0, place, source_size, (place - 1) % 3 + 1.0::DOUBLE, false FROM s
            UNION ALL SELECT i + 1, place, size, weight, full_up OR share > 3 * size FROM (
                SELECT *, (sum(size) OVER () - coalesce(sum(3 * size) FILTER (full_up) OVER (), 0)) * weight / sum(weight) FILTER (NOT full_up) OVER () AS share FROM fill
            ) WHERE i < (SELECT count(*) FROM s)
        ), goal AS (
            SELECT place, CASE WHEN full_up THEN 3.0::DOUBLE * size ELSE (sum(size) OVER () - coalesce(sum(3 * size) FILTER (full_up) OVER (), 0)) * weight / sum(weight) FILTER (NOT full_up) OVER () END AS target
            FROM fill WHERE i = (SELECT count(*) FROM s)
        ), cell AS (
            SELECT shard, place, any_value(source_size) AS source_size, any_value(target) AS target, CAST(sum(size) AS BIGINT) AS cell
            FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN goal USING (place) GROUP BY shard, place
        ), votes AS (
            SELECT *, CASE WHEN source_size > 0 THEN target * cell / source_size ELSE 0 END AS v FROM cell
        ), seats AS (SELECT shard, CAST(round_even(sum(v) / 64, 0) AS BIGINT) AS seats, sum(v) AS total FROM votes GROUP BY shard),
        quotient AS (
            SELECT shard, place, v / (2 * k + 1) AS q
            FROM (SELECT shard, place, v, unnest(range(CAST(ceil(v / total * seats) AS BIGINT) + 3)) AS k FROM votes JOIN seats USING (shard) WHERE total > 0)
        ), won AS (
            SELECT shard, place, count(*) AS got
            FROM (SELECT shard, place, row_number() OVER (PARTITION BY shard ORDER BY q DESC, place) AS n FROM quotient) JOIN seats USING (shard)
            WHERE n <= seats GROUP BY shard, place
        ), quota AS (SELECT cell.*, least(coalesce(got, 0) * 64, 3 * cell) AS quota FROM cell LEFT JOIN won USING (shard, place)),
        laid AS (
            SELECT d.*, place, coalesce(sum(size) OVER (PARTITION BY shard, place ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
        )
        SELECT doc_id, size, source_size, target, CAST(
            CASE WHEN cell > 0 THEN quota // cell * size + greatest(0, least(size, quota - quota // cell * cell - before)) ELSE 0 END AS BIGINT
        ) AS taken FROM laid JOIN quota USING (shard, place)
    """,
    "op8_minhash": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        grams AS (
            SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS k
            FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
        ), tf AS (SELECT doc_id, k, count(*) AS n FROM grams GROUP BY ALL),
        idf AS (SELECT k, count(*) AS df, 1 + 0.05 * ln((SELECT count(*) FROM d) / count(*)) / ln((SELECT count(*) FROM d)) AS v FROM tf GROUP BY k),
        total AS (SELECT doc_id, sum(n * v) AS t FROM tf JOIN idf USING (k) GROUP BY doc_id),
        shared AS (SELECT doc_id, k, n, v FROM tf JOIN idf USING (k) WHERE df > 1),
        pair AS (
            SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n) * a.v) AS c
            FROM shared a JOIN shared b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL
        ), link AS (
            SELECT a, b FROM pair JOIN total x ON x.doc_id = a JOIN total y ON y.doc_id = b
            WHERE c >= 0.8 * (x.t + y.t - c)
        ), way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        cc(n, c) USING KEY (n) AS (
            SELECT doc_id, doc_id FROM d
            UNION SELECT way.b, min(cc.c) FROM cc JOIN way ON way.a = cc.n JOIN recurring.cc r ON r.n = way.b
            WHERE cc.c < r.c GROUP BY way.b
        )
        SELECT n AS doc_id, c AS class_id, count(*) OVER (PARTITION BY c) AS class_size, n = c AS kept FROM cc
    """,
}
