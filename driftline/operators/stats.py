"""Statistics as aggregations: moments, correlations, trend tests, extremes, harmonic sums. All run as joins and groupBys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import series_pairs


def average_ranks(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """df with the average rank of column inside keys: counts of each value, summed in order, joined back; ties share their mean."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys).orderBy(column) if keys else Window.orderBy(column)
    counts = counts.withColumn(name, F.sum("__c").over(w) - (F.col("__c") - 1) / 2).drop("__c")
    return df.join(counts, [*keys, column], "left")


def pairwise_correlation(samples: DataFrame, min_periods: int = 20, method: str = "pearson") -> DataFrame:
    """(a, b, n, r) for each two series over their common times; r is null under min_periods."""
    pairs = series_pairs(samples.where("value is not null"))
    if method == "spearman":
        pairs = average_ranks(average_ranks(pairs, ["a", "b"], "x", "rx"), ["a", "b"], "y", "ry").drop("x", "y").withColumnRenamed("rx", "x").withColumnRenamed("ry", "y")
    out = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))
    return out.withColumn("r", F.when(F.col("n") >= min_periods, F.col("r")))


def correlation_interval(pairs: DataFrame) -> DataFrame:
    """pairs (r, n, r1, r2) with n_effective, ci_low, ci_high: Dawdy-Matalas sample size and Fisher's z."""
    product = F.col("r1") * F.col("r2")
    n = F.greatest(F.lit(4.0), F.col("n") * (1 - product) / (1 + product))
    r = F.least(F.lit(0.9999), F.greatest(F.lit(-0.9999), F.col("r")))
    z, half = F.atanh(r), 1.96 / F.sqrt(n - 3)
    half = F.when(n > 3, half)
    out = pairs.withColumn("n_effective", n).withColumn("ci_low", F.tanh(z - half)).withColumn("ci_high", F.tanh(z + half))
    return out.withColumn("ci_width", F.col("ci_high") - F.col("ci_low"))


#: Rows of a chunk in which lagged products are summed, where the lags are short.
LAG_CHUNK = 16_384


def lag_sums(indexed: DataFrame, lags: list[int], x: str, y: str, keys: list[str], idx: str = "idx") -> DataFrame:
    """(keys, lag, n, sx, sy, sxx, syy, sxy): sums over the pairs of x at index i with y at i + lag, both valid.

    Rows are cut into chunks of indexes; a chunk also gets copies of the rows
    that its lags reach. Each chunk gives one row of sums a lag, so neither
    rows nor pairs are multiplied by the number of lags.
    """
    import numpy as np
    import pyarrow as pa

    low, high = min(lags), max(lags)
    size = max(LAG_CHUNK, 4 * max(abs(low), abs(high)))
    i = F.col(idx)
    into = F.sequence(F.floor((i - high) / size).cast("long"), F.floor((i - low) / size).cast("long"))
    chunk = F.explode(F.array_distinct(F.concat(F.array(F.floor(i / size).cast("long")), into))).alias("__chunk")
    types = dict(indexed.dtypes)
    shape = ", ".join([*(f"{k} {types[k]}" for k in keys), "lag int, n long", *(f"{c} double" for c in ("sx", "sy", "sxx", "syy", "sxy"))])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        at = rows.column("__i").to_numpy()
        first = int(at.min())
        a, b = (np.full(int(at.max()) - first + 1, np.nan) for _ in range(2))
        own = at // size == key[-1].as_py()
        a[at[own] - first] = rows.column("__x").to_numpy(zero_copy_only=False)[own]
        b[at - first] = rows.column("__y").to_numpy(zero_copy_only=False)
        out = []
        for k in lags:
            if abs(k) >= len(a):
                continue
            u, v = (a[: len(a) - k], b[k:]) if k >= 0 else (a[-k:], b[:k])
            ok = ~(np.isnan(u) | np.isnan(v))
            if ok.any():
                u, v = u[ok], v[ok]
                out.append((k, len(u), u.sum(), v.sum(), u @ u, v @ v, u @ v))
        columns = [np.array(c) for c in zip(*out)] if out else [np.zeros(0, dtype=int)] * 7
        head = {k: pa.array([v.as_py()] * len(out), rows.schema.field(k).type) for k, v in zip(keys, key)}
        return pa.table(head | {"lag": pa.array(columns[0], pa.int32()), "n": pa.array(columns[1], pa.int64())} | {c: pa.array(v, pa.float64()) for c, v in zip(("sx", "sy", "sxx", "syy", "sxy"), columns[2:])})

    spread = indexed.select(*keys, i.cast("long").alias("__i"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), chunk)
    return spread.groupBy(*keys, "__chunk").applyInArrow(run, shape).groupBy(*keys, "lag").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))


def _centred(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """df with each column minus its mean in its series: sums of products then keep their digits."""
    means = df.groupBy(*keys).agg(*(F.avg(c).alias(f"__m_{c}") for c in columns))
    return df.join(means, keys).withColumns({f"__{c}": F.col(c) - F.col(f"__m_{c}") for c in columns})


def cross_correlation(indexed: DataFrame, x: str, y: str, most: int, keys: list[str] | None = None, least: int = 10) -> DataFrame:
    """(keys, lag, n, r) for lags -most..most; a positive lag pairs x with a later y, so x leads. Up to `least` pairs give no r."""
    keys = keys or ["series_id"]
    got = lag_sums(_centred(indexed, [x, y], keys), list(range(-most, most + 1)), f"__{x}", f"__{y}", keys)
    n = F.col("n")
    spread = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    r = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when(spread > 0, spread))
    return got.select(*keys, "lag", "n", F.when(n > least, r).alias("r"))


def best_lag(ccf: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lag, r): the strongest correlation, the smaller lag on ties."""
    best = ccf.where("r is not null").groupBy(*keys).agg(F.max(F.struct(F.abs("r").alias("s"), (-F.col("lag")).alias("m"), "r")).alias("b"))
    return best.select(*keys, (-F.col("b.m")).alias("lag"), F.col("b.r").alias("r"))


def autocorrelation(indexed: DataFrame, lags: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, lag, rho, n): sums of products over the total sum of squares, for lags 1..lags."""
    keys = keys or ["series_id"]
    got = lag_sums(_centred(indexed, ["value"], keys), list(range(lags + 1)), "__value", "__value", keys)
    whole = got.where("lag = 0").select(*keys, F.col("n").alias("__n"), F.col("sxx").alias("__ss"))
    out = got.where("lag > 0").join(whole, keys)
    return out.select(*keys, "lag", (F.col("sxy") / F.col("__ss")).alias("rho"), F.col("__n").alias("n"))


def ljung_box(acf: DataFrame, lags: list[int], keys: list[str] | None = None) -> DataFrame:
    """(keys, lags, q) of an autocorrelation table."""
    keys = keys or ["series_id"]
    spread = acf.withColumn("lags", F.explode(F.array(*(F.lit(k) for k in lags)))).where("lag <= lags")
    n = F.max("n")
    return spread.groupBy(*keys, "lags").agg((n * (n + 2) * F.sum(F.pow("rho", F.lit(2.0)) / (F.col("n") - F.col("lag")))).alias("q"))


def kendall_s(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, s, variance, z, sen_slope) of points (keys, t, value); pairs are made inside a key, so give annual or monthly values, not raw samples."""
    keys = keys or ["series_id"]
    a = points.select(*keys, F.col("t").alias("t0"), F.col("value").alias("v0"))
    b = points.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("t").alias("t1"), F.col("value").alias("v1"))
    on: Column = F.col("t0") < F.col("t1")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    pairs = a.join(b, on)
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    got = pairs.groupBy(*keys).agg(F.sum(F.signum(F.col("v1") - F.col("v0"))).cast("long").alias("s"), F.median((F.col("v1") - F.col("v0")) / (F.col("t1") - F.col("t0"))).alias("sen_slope"))
    out = n.join(got, keys).withColumn("variance", F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18.0)
    return out.withColumn("z", (F.col("s") - F.signum("s")) / F.sqrt("variance"))


def hamed_rao(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, correction): the variance factor from significant autocorrelations of ranks, at least 1."""
    keys = keys or ["series_id"]
    ranked = average_ranks(points, keys, "value", "rank")
    order = Window.partitionBy(*keys).orderBy("t")
    rows = ranked.withColumn("idx", F.row_number().over(order).cast("long") - 1)
    m = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("rank").alias("m"), F.sum(F.pow("rank", F.lit(2.0))).alias("s2"))
    z = rows.join(m, keys).select(*keys, "n", "idx", (F.col("rank") - F.col("m")).alias("z"), (F.col("s2") - F.col("n") * F.col("m") * F.col("m")).alias("d"))
    other = z.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("idx").alias("j"), F.col("z").alias("w"))
    on: Column = F.col("idx") < F.col("j")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    r = z.join(other, on).withColumn("lag", F.col("j") - F.col("idx")).where("lag <= n - 2").groupBy(*keys, "n", "lag").agg((F.sum(F.col("z") * F.col("w")) / F.max("d")).alias("r"))
    n, lag = F.col("n"), F.col("lag")
    counted = r.where(F.col("r") > (-1 + 1.96 * F.sqrt(n - 2)) / (n - 1))
    total = counted.groupBy(*keys).agg(F.sum((n - lag) * (n - lag - 1) * (n - lag - 2) * F.col("r")).alias("t"))
    out = m.select(*keys, "n").join(total, keys, "left")
    return out.select(*keys, F.greatest(F.lit(1.0), 1 + 2.0 / (n * (n - 1) * (n - 2)) * F.coalesce("t", F.lit(0.0))).alias("correction"))


def mean_residual_life(samples: DataFrame, n: int = 25, low: float = 0.80, high: float = 0.99) -> DataFrame:
    """(series_id, threshold, n, mean_excess, se) at n thresholds between two quantiles; null under 5 values above."""
    q = samples.groupBy("series_id").agg(F.percentile("value", low).alias("lo"), F.percentile("value", high).alias("hi"))
    u = q.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("series_id", "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (n - 1)).alias("threshold"))
    met = samples.join(u, "series_id").where(F.col("value") > F.col("threshold"))
    x = F.col("value") - F.col("threshold")
    out = met.groupBy("series_id", "k", "threshold").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_excess"), (F.stddev_samp(x) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    enough = F.col("n") >= 5
    return out.withColumn("mean_excess", F.when(enough, F.col("mean_excess"))).withColumn("se", F.when(enough, F.col("se")))


def ks_distance(samples: DataFrame, cdf: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, ks) of value against a distribution function column."""
    keys = keys or ["series_id"]
    f = samples.where("value is not null").withColumn("__f", cdf)
    at = f.groupBy(*keys, "value", "__f").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy("value")
    at = at.withColumn("below", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    gap = F.greatest(F.col("below") / F.col("n") - F.col("__f"), F.col("__f") - (F.col("below") - F.col("c")) / F.col("n"))
    return at.groupBy(*keys, "n").agg(F.max(gap).alias("ks"))


def harmonic_terms(hours: Column, components: list[tuple[float, int]]) -> dict[str, Column]:
    """Columns c_i_k and s_i_k: cosine and sine of harmonic k of component i (period in hours, harmonics)."""
    out = {}
    for i, (period, count) in enumerate(components):
        for k in range(1, count + 1):
            w = hours * (2 * 3.141592653589793 * k / period)
            out[f"c_{i}_{k}"], out[f"s_{i}_{k}"] = F.cos(w), F.sin(w)
    return out


def harmonic_regression(grid: DataFrame, components: list[tuple[float, int]], keys: list[str] | None = None) -> DataFrame:
    """grid (keys, ts, value) with fitted and residual of least squares on harmonics of elapsed hours.

    The normal equations are sums over rows in one aggregation; a system of a
    few unknowns is solved for each key, and its coefficients join back. Missing
    values get a fitted value and no residual.
    """
    import numpy as np
    import pandas as pd

    from .ordered import with_micros

    keys = keys or ["series_id"]
    rows = with_micros(grid)
    t0 = rows.groupBy(*keys).agg(F.min("us").alias("__t0"))
    rows = rows.join(t0, keys).withColumn("__h", (F.col("us") - F.col("__t0")) / 3.6e9)
    terms = {"one": F.lit(1.0), **harmonic_terms(F.col("__h"), components)}
    rows = rows.withColumns(terms)
    names = list(terms)
    sums = [F.sum(F.when(F.col("value").isNotNull(), F.col(a) * F.col(b))).alias(f"g_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums += [F.sum(F.col(a) * F.col("value")).alias(f"y_{i}") for i, a in enumerate(names)]
    types = dict(grid.dtypes)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                g = np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))], dtype=float)
                y = np.array([r[f"y_{i}"] for i in range(len(names))], dtype=float)
                beta = np.linalg.lstsq(np.nan_to_num(g), np.nan_to_num(y), rcond=None)[0]
                out.append({**{k: r[k] for k in keys}, **{f"b_{i}": float(b) for i, b in enumerate(beta)}})
            yield pd.DataFrame(out, columns=[*keys, *(f"b_{i}" for i in range(len(names)))])

    shape = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"b_{i} double" for i in range(len(names)))])
    beta = rows.groupBy(*keys).agg(*sums).mapInPandas(solve, shape)
    fitted: Column = F.lit(0.0)
    for i, a in enumerate(names):
        fitted = fitted + F.col(f"b_{i}") * F.col(a)
    out = rows.join(beta, keys).withColumn("fitted", fitted).withColumn("residual", F.col("value") - F.col("fitted"))
    return out.select(*grid.columns, "fitted", "residual")


def fourier_power(grid: DataFrame, periods: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, period_hours, power): squared length of the Fourier sum at each period, over valid rows about their mean; an aggregation, for short lists of periods."""
    from .ordered import with_micros

    keys = keys or ["series_id"]
    rows = with_micros(grid.where("value is not null"))
    m = rows.groupBy(*keys).agg(F.avg("value").alias("m"))
    spread = rows.join(m, keys).withColumn("period_hours", F.explode(F.array(*(F.lit(float(p)) for p in periods))))
    w = F.col("us") / 3.6e9 * (2 * 3.141592653589793) / F.col("period_hours")
    v = F.col("value") - F.col("m")
    return spread.groupBy(*keys, "period_hours").agg(((F.pow(F.sum(v * F.cos(w)), F.lit(2.0)) + F.pow(F.sum(v * F.sin(w)), F.lit(2.0))) / F.count(F.lit(1))).alias("power"))


def monthly_profile(samples: DataFrame, statistic: Column, zone_free_ts: str = "ts") -> DataFrame:
    """(series_id, month, value, n_missing): a statistic by month, every month between the first and last, gaps interpolated in both directions."""
    from .ordered import Ordered, with_micros

    by = samples.groupBy("series_id", F.trunc(zone_free_ts, "month").alias("month")).agg(statistic.alias("value"))
    ends = by.groupBy("series_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    full = ends.select("series_id", F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month")).join(by, ["series_id", "month"], "left")
    rows = Ordered(with_micros(full, "month"), ["series_id"]).index("idx")
    rows = rows.last_valid(["idx", "value"], F.col("value").isNotNull(), "l").next_valid(["idx", "value"], F.col("value").isNotNull(), "r").done()
    l, r = F.col("l"), F.col("r")
    line = l["value"] + (r["value"] - l["value"]) * (F.col("idx") - l["idx"]) / (r["idx"] - l["idx"])
    filled = F.coalesce("value", line, l["value"], r["value"])
    return rows.select("series_id", "month", filled.alias("value"), F.col("value").isNull().alias("was_missing"))


def yearly_coverage(days: DataFrame, storm_months: tuple[int, ...], expected_per_day: float = 1.0) -> DataFrame:
    """(series_id, year, valid, pct, storm_valid, storm_pct, boundary): counts of valid values against what each year and its storm months hold; first and last years are boundary years."""
    y = F.year("ts")
    by = days.withColumn("year", y).groupBy("series_id", "year").agg(F.count("value").alias("valid"), F.count(F.when(F.month("ts").isin(*storm_months), F.col("value"))).alias("storm_valid"))
    length = F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), F.make_date(F.col("year"), F.lit(1), F.lit(1)))
    storm_days: Column = F.lit(0)
    for m in storm_months:
        storm_days = storm_days + F.day(F.last_day(F.make_date(F.col("year"), F.lit(m), F.lit(1))))
    w = Window.partitionBy("series_id")
    out = by.withColumn("pct", F.round(100 * F.col("valid") / (length * expected_per_day), 1)).withColumn("storm_pct", F.round(100 * F.col("storm_valid") / (storm_days * expected_per_day), 1))
    return out.withColumn("boundary", (F.col("year") == F.min("year").over(w)) | (F.col("year") == F.max("year").over(w)))
