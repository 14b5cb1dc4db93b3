"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of all characters,
divided by its own share. A document's number of copies is the Poisson
distribution with that mean, inverted at a uniform number that comes from a
hash of seed and id. Copies are then shuffled globally. All of it is
DataFrame operations; a document's count depends on nothing but its id, its
source's rate and the seed, so lost tasks give the same rows again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 20240501


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of md5("seed:id"); a null id counts as an empty one."""
    hex13 = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(hex13, 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(df: DataFrame, source_col: str = "source", text_col: str = "text", targets: Mapping[str, float] | None = None, power: float = 0.5, budget: float = 1.0) -> DataFrame:
    """(source, size, rate) for each source, null sources as one.

    size: characters of the source. targets: weight of each source, 0 for
    those not named; without targets a source weighs size ** power. budget:
    characters wanted, in multiples of what there is. A source without
    characters has rate 0.
    """
    sizes = df.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("long")).alias("size"))
    if targets is None:
        weight: Column = F.pow(F.col("size").cast("double"), F.lit(power))
    else:
        if any(w < 0 for w in targets.values()) or not sum(targets.values()) > 0:
            raise ValueError("targets must not be negative, and one must be positive")
        weight = F.lit(0.0)
        for name, w in targets.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0))
    whole = sizes.agg(F.sum("weight").alias("w"), F.sum("size").cast("double").alias("n"))
    share = sizes.join(whole)
    return share.select("source", "size", F.when((F.col("size") > 0) & (F.col("w") > 0), F.col("weight") / F.col("w") * F.lit(float(budget)) * F.col("n") / F.col("size")).otherwise(0.0).alias("rate"))


def _cumulative(rate: DataFrame) -> DataFrame:
    """(source, rate, cdf): the Poisson distribution function at 0, 1, ... until what is left is below 2**-53."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    terms = rate.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    by = Window.partitionBy("source").orderBy("k")
    log_factorial = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(by)
    mass = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.log("rate") - F.col("rate") - log_factorial)).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    terms = terms.withColumn("mass", mass).withColumn("c", F.sum("mass").over(by))
    lists = terms.groupBy("source").agg(F.max("rate").alias("rate"), F.sort_array(F.collect_list(F.struct("k", "c"))).alias("c"))
    return lists.select("source", "rate", F.transform("c", lambda x: x["c"]).alias("cdf"))


def replicate(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", targets: Mapping[str, float] | None = None, power: float = 0.5, budget: float = 1.0, seed: int = SEED, copy_col: str = "copy", count_col: str = "n_copies") -> DataFrame:
    """Copies of the rows of df in a random global order, with copy_col (from 1) and count_col.

    Rows with count 0 do not appear. Rows that share an id and a source get
    the same count. Null sources are one source; a null id counts as an empty
    one. copy_col and count_col replace columns of the same name. The table of
    rates, one row a source, is stored first: Spark broadcasts it if it is
    below its threshold and joins by sorting otherwise.
    """
    table = common.stored(_cumulative(rates(df, source_col, text_col, targets, power, budget)), "rates")
    table = table.select(F.col("source").alias("__source"), F.col("cdf").alias("__cdf"))
    kept = [c for c in df.columns if c not in (copy_col, count_col)]
    base = df.select(*(F.col(f"`{c}`") for c in kept)).withColumn("__u", uniform(F.col(id_col), seed))
    met = base.join(table, F.col(source_col).eqNullSafe(F.col("__source")))
    counted = met.withColumn(count_col, F.expr("cast(size(filter(__cdf, x -> x < __u)) as long)")).where(F.col(count_col) > 0)
    out = counted.withColumn(copy_col, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count_col))))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(copy_col), F.col("__u"))
    return out.withColumn("__key", key).repartition("__key").sortWithinPartitions("__key").select(*(F.col(f"`{c}`") for c in kept), copy_col, count_col)


def replicate_sql(power: float = 0.5, seed: int = SEED) -> str:
    """The rows of replicate() without targets, in DuckDB's SQL."""
    return f"""
WITH s AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source),
r AS (SELECT source, pow(size, {power}) / sum(pow(size, {power})) OVER () * sum(size) OVER () / size AS rate FROM s WHERE size > 0),
k AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 21)::BIGINT)) AS k FROM r),
t AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS c FROM k),
u AS (SELECT doc_id, source, text, (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT u.doc_id, u.source, u.text, count(*) AS n_copies FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source AND t.c < u.u GROUP BY ALL)
SELECT doc_id, source, text, unnest(range(1, n_copies + 1)) AS copy, n_copies FROM n
"""
