"""Queries that bring results of series together: gates, comparison rows, reports, warnings, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments
from ..operators.ordered import Ordered, with_micros
from ..sources.tables import table
from . import stages
from .series_queries import _GRID, _R4, WEEK_US, Query, events, hourly, mean_of_cents, off_ties
from .stat_queries import _PAIRS, pairwise_correlation


def _series(spark, d):
    """Nations as stations: variables by nation key, years of record from their orders."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    years = o.groupBy(F.col("c_nationkey").cast("long").alias("series_id")).agg(((F.unix_micros(F.max(F.col("o_orderdate").cast("timestamp"))) - F.unix_micros(F.min(F.col("o_orderdate").cast("timestamp")))) / 31557600000000.0).alias("record_years"))
    have = F.filter(F.array(F.lit("height"), F.when(F.col("series_id") % 2 == 0, "period"), F.when(F.col("series_id") % 3 == 0, "direction")), lambda x: x.isNotNull())
    return years.select("series_id", F.when(F.col("series_id") % 7 != 6, have).otherwise(F.array().cast("array<string>")).alias("available_variables"), "record_years")


def stage_gate(spark, d):
    out = stages.gate(_series(spark, d), stages.registry(spark).where("stage in ('variables', 'regimes', 'trend', 'seasonal')"))
    return out.select("series_id", "stage", "eligible", F.coalesce("reason", F.lit("")).alias("reason"))


def eligible_series(spark, d):
    s = _series(spark, d)
    return stages.eligible(s, stages.gate(s, stages.registry(spark)), "variables").select("series_id")


def long_records(spark, d):
    return _series(spark, d).where("record_years >= 6.57").select("series_id")


def start_years(spark, d):
    return events(spark, d).groupBy("series_id").agg(F.year(F.min("ts")).cast("long").alias("year"), F.countDistinct(F.to_date("ts")).alias("days"))


def comparison_rows(spark, d):
    e = events(spark, d)
    base = e.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), mean_of_cents("value").alias("mean"), F.max("value").alias("max"))
    seg = segments.longest_segment(hourly(spark, d)).select("series_id", "n_segments", "segment_length")
    late = e.where("value > 320").groupBy("series_id").agg(F.count(F.lit(1)).alias("extremes"))
    p = F.col("n_segments") * 100.0 / F.col("segment_length")
    verdict = F.when(p > 100, "fragmented").when(p > 20, "gappy").otherwise("continuous")
    return base.join(seg, "series_id", "left").join(late, "series_id", "left").select("series_id", "n", "mean", "max", "n_segments", "segment_length", "extremes", verdict.alias("verdict"))


def network_report(spark, d):
    r = comparison_rows(spark, d)
    text = F.concat_ws(" ", F.col("series_id"), F.lit("has"), F.col("n").cast("string"), F.lit("samples in"), F.col("n_segments").cast("string"), F.lit("stretches;"), F.lit("it is"), F.concat(F.col("verdict"), F.lit(".")))
    return r.select("series_id", text.alias("report"))


def network_warnings(spark, d):
    rules = [("warning", "fragmented", "n_segments > 20", "many short stretches"), ("note", "no_extremes", "extremes is null", "no value above 320")]
    return stages.warnings(comparison_rows(spark, d), rules).select("series_id", "severity", "code", "message", F.col("context")["n_segments"].alias("n_segments"))


def widest_pairs(spark, d):
    r = pairwise_correlation(spark, d)
    return r.agg(off_ties(F.max("r") - F.min("r"), 6).alias("range"), F.max_by(F.concat_ws("-", "a", "b"), F.struct("r", "a", "b")).alias("closest"), F.min_by(F.concat_ws("-", "a", "b"), F.struct("r", "a", "b")).alias("farthest"))


def summary_rollup(spark, d):
    li = table(spark, d, "lineitem")
    out = li.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), mean_of_cents("l_extendedprice").alias("mean"), F.grouping_id().cast("long").alias("level"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "mean", "level")


def regime_fractions(spark, d):
    e = events(spark, d).withColumn("regime", F.when(F.col("value") > 100, "storm").when(F.col("value") > 60, "energetic").when(F.col("value") > 20, "moderate").otherwise("calm"))
    by = e.groupBy("series_id").pivot("regime", ["calm", "moderate", "energetic", "storm"]).count()
    total = F.col("calm") + F.col("moderate") + F.col("energetic") + F.col("storm")
    return by.select("series_id", *((F.col(c) / total).alias(c) for c in ("calm", "moderate", "energetic", "storm")))


def json_facts(spark, d):
    e = table(spark, d, "events")
    k = F.from_json("props", "k long").getField("k")
    return e.groupBy("event_type").agg(F.sum(k).alias("k"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("top"), F.count(F.get_json_object("props", "$.absent")).alias("absent"))


def label_distance(spark, d):
    """Time from each view to the next purchase, an order-based lookup in chunks of a week; of rows of one time the smaller id comes first."""
    e = with_micros(events(spark, d)).withColumn("k", F.lit(1))
    rows = Ordered(e, ["k"], tie=["pos"], chunk_us=WEEK_US).next_valid(["us"], F.col("series_id") == "purchase", "next_").done()
    return rows.where("series_id = 'view'").select(F.col("pos").alias("event_id"), (F.col("next_.us") - F.col("us")).alias("wait_us"))


_SER = "se AS (SELECT c_nationkey::BIGINT AS series_id, (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 31557600000000.0::DOUBLE AS record_years FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), sv AS (SELECT *, series_id % 7 = 6 AS none FROM se)"
_CMP = f"""{_GRID}, lab AS (SELECT *, sum((value IS NULL)::INT) OVER (PARTITION BY series_id ORDER BY h) AS seg FROM grid), ru AS (SELECT series_id, seg, count(*) AS n FROM lab WHERE value IS NOT NULL GROUP BY ALL), rs AS (SELECT series_id, count(*) AS n_segments, max(n) AS segment_length FROM ru GROUP BY 1),
b AS (SELECT event_type AS series_id, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / (100 * count(*)) AS mean, max(value) AS max, nullif(sum((value > 320)::INT), 0)::BIGINT AS extremes FROM events GROUP BY 1),
cmp AS (SELECT b.series_id, b.n, mean, max, n_segments, segment_length, extremes, CASE WHEN n_segments * 100.0 / segment_length > 100 THEN 'fragmented' WHEN n_segments * 100.0 / segment_length > 20 THEN 'gappy' ELSE 'continuous' END AS verdict FROM b LEFT JOIN rs USING (series_id))"""

NETWORK: dict[str, tuple[Query, str | None]] = {
    "stage_gate": (stage_gate, f"WITH {_SER} SELECT series_id, stage, reason = '' AS eligible, reason FROM (SELECT series_id, 'variables' AS stage, CASE WHEN NOT none AND (series_id % 2 = 0 OR series_id % 3 = 0) THEN '' ELSE 'needs one of period,direction' END AS reason FROM sv UNION ALL SELECT series_id, 'regimes', CASE WHEN none THEN 'lacks height' ELSE '' END FROM sv UNION ALL SELECT series_id, 'trend', CASE WHEN record_years < 10 THEN printf('record is %.3f years, needs 10.0', record_years) ELSE '' END FROM sv UNION ALL SELECT series_id, 'seasonal', CASE WHEN record_years < 2 THEN printf('record is %.3f years, needs 2.0', record_years) ELSE '' END FROM sv)"),
    "eligible_series": (eligible_series, f"WITH {_SER} SELECT series_id FROM sv WHERE NOT none AND (series_id % 2 = 0 OR series_id % 3 = 0)"),
    "long_records": (long_records, f"WITH {_SER} SELECT series_id FROM se WHERE record_years >= 6.57"),
    "start_years": (start_years, "SELECT event_type AS series_id, year(min(ts)) AS year, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1"),
    "comparison_rows": (comparison_rows, f"WITH {_CMP} SELECT * FROM cmp"),
    "network_report": (network_report, f"WITH {_CMP} SELECT series_id, concat_ws(' ', series_id, 'has', n::VARCHAR, 'samples in', n_segments::VARCHAR, 'stretches;', 'it is', verdict || '.') AS report FROM cmp"),
    "network_warnings": (network_warnings, f"WITH {_CMP} SELECT series_id, 'warning' AS severity, 'fragmented' AS code, 'many short stretches' AS message, n_segments::VARCHAR AS n_segments FROM cmp WHERE n_segments > 20 UNION ALL SELECT series_id, 'note', 'no_extremes', 'no value above 320', n_segments::VARCHAR FROM cmp WHERE extremes IS NULL"),
    "widest_pairs": (widest_pairs, f"WITH {_PAIRS}, c AS (SELECT a, b, {_R4('corr(x, y)', 8)} AS r FROM pr GROUP BY a, b HAVING count(*) >= 20) SELECT {_R4('max(r) - min(r)', 6)} AS range, first(a || '-' || b ORDER BY r DESC, a DESC, b DESC) AS closest, first(a || '-' || b ORDER BY r, a, b) AS farthest FROM c"),
    "summary_rollup": (summary_rollup, "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / (100 * count(*)) AS mean, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "regime_fractions": (regime_fractions, "SELECT event_type AS series_id, count(*) FILTER (WHERE value <= 20)::DOUBLE / count(*) AS calm, count(*) FILTER (WHERE value > 20 AND value <= 60)::DOUBLE / count(*) AS moderate, count(*) FILTER (WHERE value > 60 AND value <= 100)::DOUBLE / count(*) AS energetic, count(*) FILTER (WHERE value > 100)::DOUBLE / count(*) AS storm FROM events GROUP BY 1"),
    "json_facts": (json_facts, "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS top, count(json_extract(props, '$.absent')) AS absent FROM events GROUP BY 1"),
    "label_distance": (label_distance, "WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us, min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM events) SELECT event_id, nx - us AS wait_us FROM e WHERE event_type = 'view'"),
}
