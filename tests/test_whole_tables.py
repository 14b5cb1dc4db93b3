"""Queries read whole tables, and fill only real gaps."""

import datetime as dt


def test_monthly_queries_read_every_order(spark, tmp_path):
    from driftline import queries
    from driftline.plans.stat_queries import monthly_orders

    months = [dt.date(1995 + k // 12, k % 12 + 1, 3) for k in range(72)]
    gap, peak = months[40], next(m for m in months[24:] if (m.year * 12 + m.month) % 7 == 0)
    rows = [("1-URGENT", m, 9000.0 if m == peak else 100.0 + k) for k, m in enumerate(months) if m != gap]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate date, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.month.strftime("%Y-%m"): (r.value, r.was_missing) for r in monthly_orders(spark, str(tmp_path)).collect()}
    assert len(got) == 72 and [m for m, (_, w) in got.items() if w] == [gap.strftime("%Y-%m")]
    assert got[peak.strftime("%Y-%m")] == (9000.0, False) and got[gap.strftime("%Y-%m")][0] == 140.0
    parts = queries.QUERIES["seasonal_decomposition"](spark, str(tmp_path)).collect()
    assert len(parts) == 72 and max(abs(v) for r in parts for v in r if isinstance(v, float)) > 4000


def test_searches_and_resamples_run_at_their_defaults(spark, data, monkeypatch):
    import inspect

    from driftline import queries
    from driftline.plans import stat_queries as Q

    asked = {}

    def noted(module, name):
        real = getattr(module, name)

        def call(*args, **extra):
            got = inspect.signature(real).bind(*args, **extra)
            got.apply_defaults()
            asked[name] = got.arguments
            return real(*args, **extra)

        monkeypatch.setattr(module, name, call)

    for name in ("gpd_bootstrap", "weibull_bootstrap", "share_bootstrap", "order_search"):
        noted(Q.E, name)
    noted(Q.ML, "regimes")
    for name in ("extreme_intervals", "resampled_intervals", "regime_shares", "regimes", "order_search"):
        queries.QUERIES[name](spark, data)
    assert [asked[n]["replicates"] for n in ("gpd_bootstrap", "weibull_bootstrap", "share_bootstrap")] == [200, None, 200]
    assert [Q.E.N.replicates_for(n) for n in (100, 50_000, 500_000)] == [1000, 500, 200]
    assert asked["regimes"]["starts"] == 5
    assert asked["order_search"]["most"] == 3
