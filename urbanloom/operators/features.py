"""Graph features, encodings, splits and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import one_row, with_position
from .table import numeric_columns, safe_name, zscore


def feature_vector(df: DataFrame, key: str, wanted: Sequence[str], name: str = "features") -> DataFrame:
    """Known columns as one array, missing values 0.0."""
    cols = [c for c in wanted if c in df.columns]
    return df.withColumn(name, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]))


def node_features(nodes: DataFrame, wanted: Sequence[str]) -> DataFrame:
    cols = [c for c in wanted if c in nodes.columns]
    return nodes.select("node", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])


def edge_features(edges: DataFrame, wanted: Sequence[str]) -> DataFrame:
    cols = [c for c in wanted if c in edges.columns]
    return edges.select("src", "dst", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])


def numeric_matrix(df: DataFrame, name: str = "features") -> DataFrame:
    """Numeric columns only, assembled into one ML vector."""
    from pyspark.ml.feature import VectorAssembler

    cols = numeric_columns(df)
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    return VectorAssembler(inputCols=cols, outputCol=name).transform(filled)


def one_hot(df: DataFrame, col: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    """Dummy columns for the given categories, all 0 for NULL and other values.

    The columns of a plan are fixed before it runs, so the caller names them; ``one_hot_long`` takes any vocabulary.
    """
    p = prefix or col
    return df.withColumns({f"{p}_{safe_name(v)}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values})


def one_hot_long(df: DataFrame, key: str, col: str) -> DataFrame:
    """The ones of a one-hot matrix as rows ``(key, category, value)``, for vocabularies of any size; none for NULL."""
    return df.where(F.col(col).isNotNull()).select(key, F.col(col).cast("string").alias("category"), F.lit(1).alias("value"))


def ordinal_encode(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Index in the sorted category list; NULL is -1."""
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("_v")).distinct()
    idx = with_position(values, ["_v"], "_i").select("_v", (F.col("_i") - 1).alias("_i"))
    out = df.join(idx, F.col(col) == F.col("_v"), "left")
    return out.withColumn(name or f"{col}_code", F.coalesce("_i", F.lit(-1))).drop("_v", "_i")


def _cuts(n: Column, train: float, val: float) -> tuple[Column, Column]:
    def part(share: float) -> Column:  # in decimals: 0.7 of 90,000 is 63,000, not 62,999.99...
        return F.floor(n.cast("decimal(19,0)") * F.lit(Decimal(str(share)))).cast("bigint")

    return part(train), part(train) + part(val)


def random_split(df: DataFrame, key: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Exact int(n*share) sizes in a hash order of the key; the remainder is the test part."""
    n = one_row(df, n=F.count(F.lit(1)))["n"]
    p = with_position(df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), ["_h", key], "_p")
    a, b = _cuts(n, train, val)
    return p.withColumn("split", F.when(F.col("_p") <= a, "train").when(F.col("_p") <= b, "val").otherwise("test")).drop("_h", "_p")


def stratified_split(df: DataFrame, key: str, cls: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """The same sizes inside every class."""
    from ..scale import join_on

    p = with_position(df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))), ["_h", key], "_p", by=[cls])
    n = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    j = join_on(p, n, [cls])
    a, b = _cuts(F.col("_n"), train, val)
    return j.withColumn("split", F.when(F.col("_p") <= a, "train").when(F.col("_p") <= b, "val").otherwise("test")).drop("_h", "_p", "_n")


def split_sizes(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "split").agg(F.count(F.lit(1)).alias("n"))


def split_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("overlap"))


def class_weights(df: DataFrame, cls: str, root: bool = False) -> DataFrame:
    """Inverse class frequency normalised to sum 1 (optionally of square roots)."""
    g = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    inv = 1 / (F.sqrt("n") if root else F.col("n"))
    g = g.withColumn("_w", inv)
    s = one_row(g, s=F.sum("_w"))["s"]
    return g.withColumn("weight", F.col("_w") / s).drop("_w")


def pca_2d(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Standardised features projected on two principal components."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="skip").transform(df.select(key, *cols))
    z = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(v).transform(v)
    p = PCA(k=2, inputCol="_z", outputCol="_p").fit(z).transform(z).withColumn("_a", vector_to_array("_p"))
    return p.select(key, F.get("_a", 0).alias("pc1"), F.get("_a", 1).alias("pc2"))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Long confusion matrix with row shares."""
    g = df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    t = g.groupBy("label").agg(F.sum("n").alias("_t"))
    return g.join(t, "label").withColumn("row_share", F.col("n") / F.col("_t")).drop("_t")


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class plus accuracy, macro and weighted rows (0 on division by zero)."""
    c = df.groupBy(F.col(label).cast("string").alias("l"), F.col(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = c.select(F.explode(F.array(
        F.struct(F.col("l").alias("c"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("pr"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("pr"), F.lit(0).cast("bigint").alias("tp")),
    )).alias("e")).select("e.*")
    g = sides.groupBy("c").agg(F.sum("sup").alias("support"), F.sum("pr").alias("_p"), F.sum("tp").alias("_t"))
    prec = F.when(F.col("_p") > 0, F.col("_t") / F.col("_p")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("_t") / F.col("support")).otherwise(0.0)
    g = g.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    g = g.withColumn("f1", f1)
    n = F.sum("support")

    def avg(name: str, prec_: Column, rec_: Column, f1_: Column) -> DataFrame:
        return g.agg(prec_.alias("precision"), rec_.alias("recall"), f1_.alias("f1"), n.alias("support")).select(
            F.lit(name).alias("class"), "precision", "recall", "f1", "support"
        )

    acc = F.sum("_t") / n
    rows = g.select(F.col("c").alias("class"), "precision", "recall", "f1", "support")
    rows = rows.unionByName(avg("accuracy", acc, acc, acc))
    rows = rows.unionByName(avg("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")))
    w = [F.sum(F.col(m) * F.col("support")) / n for m in ("precision", "recall", "f1")]
    return rows.unionByName(avg("weighted avg", *w))


def neighbour_aggregate(edges: DataFrame, features: DataFrame, cols: Sequence[str], hops: int = 2) -> DataFrame:
    """Neighbour means of node features stacked over ``hops`` as ``<col>_h<k>`` columns."""
    from ..scale import cut_lineage
    from .graph import bidirectional_edges

    both = bidirectional_edges(edges.select("src", "dst"))
    out = features.select("node", *cols)
    cur = out
    for k in range(1, hops + 1):
        j = both.join(cur, both["dst"] == cur["node"]).groupBy("src").agg(*[F.avg(c).alias(c) for c in cols])
        cur = features.select("node").join(j, F.col("node") == F.col("src"), "left").select(
            "node", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols]
        )
        cur = cut_lineage(cur)
        out = out.join(cur.select("node", *[F.col(c).alias(f"{c}_h{k}") for c in cols]), "node")
    return out


def fit_node_classifier(df: DataFrame, cols: Sequence[str], cls: str, kind: str = "logistic"):
    """MLlib classifier on stacked node features; returns the frame with ``prediction``."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)
    model = (
        LogisticRegression(labelCol=cls, maxIter=50) if kind == "logistic" else RandomForestClassifier(labelCol=cls, seed=42)
    )
    return model.fit(v.where(F.col("split") == "train")).transform(v)


def standardised(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return zscore(df, cols, ddof=1, suffix="_z")


def graph_dataset_profile(nodes: DataFrame, edges: DataFrame, cols: Sequence[str], cls: str) -> DataFrame:
    """Long profile of a prepared graph: sizes, feature statistics, label counts, split sizes."""
    parts = [
        nodes.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("nodes").alias("section"), F.lit("count").alias("key"), "value"),
        edges.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("edges").alias("section"), F.lit("count").alias("key"), "value"),
        nodes.groupBy(F.col(cls).cast("string").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("labels").alias("section"), "key", "value"),
    ]
    if "split" in nodes.columns:
        parts.append(nodes.groupBy(F.col("split").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("splits").alias("section"), "key", "value"))
    stats = nodes.agg(*[f(c).cast("double").alias(f"{c}:{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    parts.append(stats.unpivot([], stats.columns, "key", "value").select(F.lit("features").alias("section"), "key", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
