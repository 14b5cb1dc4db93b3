"""Clusters, components and probabilities: models of each series by numpy, one series a task; small linear algebra on the driver where rows are series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N

REGIMES = ("calm", "moderate", "energetic", "storm")
#: Rows of a matrix that may come to the driver: one for each series.
MAX_SERIES = 5000


def standardized(df: DataFrame, columns: list[str], keys: list[str] | None = None, sample: bool = False) -> DataFrame:
    """df with each column minus its mean, over its population (or sample) deviation; a constant column becomes 0."""
    sd = F.stddev_samp if sample else F.stddev_pop
    stats = df.groupBy(*(keys or [])).agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(sd(c).alias(f"__s_{c}") for c in columns))
    out = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: F.coalesce((F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")), F.lit(0.0)) for c in columns}).drop(*(f"__{k}_{c}" for k in "ms" for c in columns))


def regimes(samples: DataFrame, columns: list[str], k: int = 4, starts: int = 5, seed: int = 1) -> DataFrame:
    """samples with regime 0..k-1 by rising mean of the first column, and its name: each series has a mixture of its own, the best of several starts.

    Rows with a null in columns are left out, and so are series of under 10 * k rows.
    """
    types = dict(samples.dtypes)
    kept = samples.columns
    shape = ", ".join([*(f"{c} {types[c]}" for c in kept), "regime int, regime_name string"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=columns)
        if len(pdf) < 10 * k:
            return pd.DataFrame(columns=[*kept, "regime", "regime_name"])
        x = pdf[columns].to_numpy(dtype=float)
        sd = x.std(axis=0)
        regime, _ = N.gaussian_mixture((x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0), k, starts, seed=seed)
        return pdf.assign(regime=regime.astype("int32"), regime_name=[REGIMES[r] if r < len(REGIMES) else None for r in regime])

    return samples.groupBy("series_id").applyInPandas(run, shape)


def transition_counts(labels: DataFrame, keys: list[str], label: str = "regime") -> DataFrame:
    """(from, to, n, share) of labels that follow each other inside keys, ordered by us."""
    from .ordered import Ordered

    rows = Ordered(labels, keys).previous(label, "before").done().where("before is not null")
    n = rows.groupBy(F.col("before").alias("from"), F.col(label).alias("to")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def principal_components(df: DataFrame, columns: list[str]) -> DataFrame:
    """(component, share, variable, loading) of the correlation matrix, made in one aggregation; the largest loading of a component is positive."""
    rows = df.dropna(subset=columns)
    got = rows.agg(F.count(F.lit(1)).alias("n"), *(F.corr(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j)).first()
    spark = df.sparkSession
    shape = "component int, share double, variable string, loading double"
    if len(columns) < 2 or got["n"] <= 20:
        return spark.createDataFrame([], shape)
    m = np.eye(len(columns))
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            m[i, j] = m[j, i] = got[f"c_{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(m)
    out = []
    for k, i in enumerate(np.argsort(-values), 1):
        v = vectors[:, i] * np.sign(vectors[np.abs(vectors[:, i]).argmax(), i])
        out += [(k, float(values[i] / values.sum()), c, float(x)) for c, x in zip(columns, v)]
    return spark.createDataFrame(out, shape)


def fingerprint_clusters(features: DataFrame, columns: list[str], most: int = 6, seed: int = 1) -> DataFrame:
    """(series_id, k, silhouette, cluster, pc1, pc2): the number of k-means clusters of standardised features, mean-filled, with the best Euclidean silhouette.

    One row a series: at most MAX_SERIES rows come to the driver for the
    silhouette; more raise ValueError.
    """
    n = features.count()
    if n > MAX_SERIES:
        raise ValueError(f"over {MAX_SERIES} series")
    filled = features.crossJoin(F.broadcast(features.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns))))
    filled = filled.select("series_id", *(F.coalesce(c, f"__m_{c}", F.lit(0.0)).cast("double").alias(c) for c in columns))
    z = standardized(filled, columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="__x").transform(z).select("series_id", "__x").cache()
    rows = vectors.orderBy("series_id").collect()
    points = np.array([r["__x"].toArray() for r in rows])
    best = None
    for k in range(2, min(most, n - 1) + 1):
        model = KMeans(k=k, featuresCol="__x", predictionCol="c", seed=seed, initSteps=5).fit(vectors)
        got = {r["series_id"]: r["c"] for r in model.transform(vectors).select("series_id", "c").collect()}
        labels = np.array([got[r["series_id"]] for r in rows])
        if len(set(labels)) > 1:
            s = N.silhouette(points, labels)
            if best is None or s > best[0]:
                best = (s, k, labels)
    vectors.unpersist()
    shape = f"series_id {dict(features.dtypes)['series_id']}, k int, silhouette double, cluster int, pc1 double, pc2 double"
    if best is None:
        return features.sparkSession.createDataFrame([], shape)
    values, axes = np.linalg.eigh(np.cov(points.T))
    axes = axes[:, np.argsort(-values)[:2]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    flat = points @ axes
    out = [(r["series_id"], best[1], best[0], int(c), float(p[0]), float(p[1]) if len(p) > 1 else None) for r, c, p in zip(rows, best[2], flat)]
    return features.sparkSession.createDataFrame(out, shape)


def linkage_clusters(pairs: DataFrame, most: int = 4) -> DataFrame:
    """(series_id, cluster) of pairs (a, b, r) by average linkage on 1 - r; a missing r counts as 0. At most MAX_SERIES series."""
    names = [r[0] for r in pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct().orderBy("s").limit(MAX_SERIES + 1).collect()]
    if len(names) > MAX_SERIES:
        raise ValueError(f"over {MAX_SERIES} series")
    place = {s: i for i, s in enumerate(names)}
    d = np.ones((len(names), len(names)))
    for r in pairs.collect():
        d[place[r["a"]], place[r["b"]]] = d[place[r["b"]], place[r["a"]]] = 1 - (r["r"] if r["r"] is not None else 0.0)
    np.fill_diagonal(d, 0)
    got = N.average_linkage(d, min(most, len(names)))
    return pairs.sparkSession.createDataFrame([(s, int(c)) for s, c in zip(names, got)], f"series_id {dict(pairs.dtypes)['a']}, cluster int")


def exceedance_model(rows: DataFrame, columns: list[str], train_share: float = 0.55) -> DataFrame:
    """The later rows of each series with p: a logistic regression of each series on its earlier rows, with an L2 penalty of 1 over their number.

    rows: series_id, idx, columns, label. Rows before train_share of a series'
    range of idx are its training rows. A series whose training rows are under
    30 or of one label gives no rows. Rows with a null are left out.
    """
    types = dict(rows.dtypes)
    shape = ", ".join([f"series_id {types['series_id']}, idx long", *(f"{c} double" for c in columns), "label int, p double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["idx"].min(), pdf["idx"].max()
        pdf = pdf.dropna(subset=[*columns, "label"]).sort_values("idx")
        early = pdf["idx"] < lo + train_share * (hi - lo)
        x, y = pdf[columns].to_numpy(dtype=float), pdf["label"].to_numpy(dtype=float)
        if early.sum() < 30 or len(set(y[early])) < 2:
            return pd.DataFrame(columns=["series_id", "idx", *columns, "label", "p"])
        w = N.logistic(x[early], y[early], 1.0 / early.sum())
        p = 1 / (1 + np.exp(-np.clip(w[0] + x[~early] @ w[1:], -35, 35)))
        return pdf[~early][["series_id", "idx", *columns, "label"]].assign(label=y[~early].astype("int32"), p=p)

    return rows.select("series_id", F.col("idx").cast("long").alias("idx"), *(F.col(c).cast("double").alias(c) for c in columns), "label").groupBy("series_id").applyInPandas(run, shape)
