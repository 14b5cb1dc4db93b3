"""SQL for estimators: spectra, recursions, searches and greedy passes, written as aggregations and recursive queries.

Searches of one parameter (a power transform, a tail) go over a grid and then
over finer grids around its best point; the estimators use other searches, so
both must find the same optimum.
"""

from __future__ import annotations

from .series_queries import _GAPS, _GRID, _R4

_TWO_PI = "6.283185307179586"

#: Segments of 48 hours and more of the hourly grid with its short gaps filled (sg), and the longest of each series (ls): value v at place j of len.
SEGMENTS = f"""{_GAPS},
fl AS (SELECT series_id, i, h, CASE WHEN value IS NULL AND gap_len <= 3 AND li IS NOT NULL THEN coalesce(lv + (rv - lv) * (i - li) / (ri - li), lv) ELSE value END AS value FROM gl),
lb AS (SELECT *, sum((value IS NULL)::INT) OVER (PARTITION BY series_id ORDER BY i) AS seg FROM fl),
sl AS (SELECT series_id, seg, h, value AS v, count(*) OVER (PARTITION BY series_id, seg) AS len, row_number() OVER (PARTITION BY series_id, seg ORDER BY i) - 1 AS j FROM lb WHERE value IS NOT NULL),
sg AS (SELECT * FROM sl WHERE len >= 48),
ls AS (SELECT * FROM sg QUALIFY dense_rank() OVER (PARTITION BY series_id ORDER BY len DESC, seg) = 1)"""

#: The one-sided density of each longest segment about its straight line.
_SPECTRA = f"""{SEGMENTS},
s0 AS (SELECT series_id, j, len AS n, v - avg(v) OVER p AS v, j - (len - 1) / 2.0 AS t FROM ls WINDOW p AS (PARTITION BY series_id)),
s1 AS (SELECT series_id, j, n, v - t * (sum(t * v) OVER p / sum(t * t) OVER p) AS x FROM s0 WINDOW p AS (PARTITION BY series_id)),
sf AS (SELECT series_id, n, k, pow(sum(x * cos({_TWO_PI} * ((j * k) % n) / n)), 2) + pow(sum(x * sin({_TWO_PI} * ((j * k) % n) / n)), 2) AS e FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM s1) GROUP BY series_id, n, k),
sp AS (SELECT series_id, k::DOUBLE / n AS frequency, CASE WHEN k > 0 THEN n::DOUBLE / k END AS period_hours, e / n * CASE WHEN k > 0 AND 2 * k <> n THEN 2 ELSE 1 END AS power FROM sf)"""


def _acf(source: str, keys: str, lags: str) -> str:
    """Autocorrelations r at lags 0 to `lags` (an expression of n) of the rows (keys, j, n, v) of a table."""
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    own = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f"""c0 AS (SELECT {keys}, j, n, v - avg(v) OVER (PARTITION BY {keys}) AS v FROM {source}),
c1 AS (SELECT {own}, x.n, x.lag, sum(x.v * y.v) AS c FROM (SELECT *, unnest(range(0, {lags} + 1)) AS lag FROM c0) x JOIN c0 y ON {on} AND y.j = x.j + x.lag GROUP BY {own}, x.n, x.lag),
ac AS (SELECT {keys}, n, lag, c / first_value(c) OVER (PARTITION BY {keys} ORDER BY lag) AS r FROM c1)"""


def _timescales(keys: str) -> str:
    """Timescales from ac: the sum of autocorrelations before the first of five lags inside the band of no significance."""
    return f"""t0 AS (SELECT *, max(lag) OVER (PARTITION BY {keys}) AS top, count(*) FILTER (WHERE abs(r) < 1.96 / sqrt(n)) OVER (PARTITION BY {keys} ORDER BY lag ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS quiet FROM ac),
t1 AS (SELECT *, min(CASE WHEN quiet = 5 AND lag >= 1 THEN lag END) OVER (PARTITION BY {keys}) AS cut FROM t0),
ts AS (SELECT {keys}, any_value(n) AS n, 1 + 2 * coalesce(sum(CASE WHEN lag >= 1 AND lag < coalesce(cut, top) THEN r END), 0) AS tau, max(CASE WHEN lag = 1 THEN r END) AS lag1, any_value(coalesce(cut, top)) AS cut_lag, any_value(cut) IS NULL AS hit FROM t1 GROUP BY {keys})"""


_SEGMENT_SCALES = f"{SEGMENTS}, src AS (SELECT series_id, seg, j, len AS n, v FROM sg), {_acf('src', 'series_id, seg', 'least(n // 3, 2000)')}, {_timescales('series_id, seg')}"


def _residuals(source: str, period: float, harmonics: int) -> str:
    """ge: rows (series_id, h, y) of a table about the least squares fit of a constant and harmonics, by orthogonalising one column after another."""
    names = [f"{f}{k}" for k in range(1, harmonics + 1) for f in ("c", "s")]
    terms = ", ".join(f"{'cos' if n[0] == 'c' else 'sin'}(h * {_TWO_PI} * {n[1:]} / {period}) AS {n}" for n in names)
    out = [f"g0 AS (SELECT series_id, h, y, {terms} FROM {source})"]
    left = ["y", *names]
    out.append("g1 AS (SELECT series_id, h, " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY series_id) AS {c}" for c in left) + " FROM g0)")
    for i, q in enumerate(names):
        left.remove(q)
        out.append(f"g{i + 2} AS (SELECT series_id, h, " + ", ".join(f"{c} - {q} * (sum({c} * {q}) OVER (PARTITION BY series_id) / sum({q} * {q}) OVER (PARTITION BY series_id)) AS {c}" for c in left) + f" FROM g{i + 1})")
    out.append(f"ge AS (SELECT series_id, h, y FROM g{len(names) + 1})")
    return ", ".join(out)


def _orthogonalised(name: str, source: str, keys: str, columns: list[str], carried: list[str]) -> str:
    """{name}{k}: rows of a table after the first k columns were taken out of all later ones by least squares; a column of zeros takes out nothing."""
    out, left = [f"{name}0 AS (SELECT {', '.join([keys, *carried, *columns])} FROM {source})"], list(columns)
    for k, q in enumerate(columns[:-1]):
        left.remove(q)
        parts = [f"{c} - {q} * coalesce(sum({c} * {q}) OVER p / nullif(sum({q} * {q}) OVER p, 0), 0) AS {c}" for c in left]
        out.append(f"{name}{k + 1} AS (SELECT {', '.join([keys, *carried, *parts])} FROM {name}{k} WINDOW p AS (PARTITION BY {keys}))")
    return ",\n".join(out)


def _unit_root(most: int = 24) -> str:
    """ad: (series_id, n, t) of the augmented Dickey-Fuller test of ls, lags by AIC. most: as many lags as any of the series may take."""
    lags = range(1, most + 1)
    names = [f"l{k}" for k in lags]
    masked = lambda bound: ", ".join(f"CASE WHEN {k} <= {bound} THEN l{k} ELSE 0 END AS l{k}" for k in lags)
    losses = " UNION ALL ".join(f"SELECT series_id, {k} AS k, count(*) AS m, sum(y * y) AS rss FROM ua{k + 2} WHERE top >= {k} GROUP BY series_id" for k in range(most + 1))
    return f"""u0 AS (SELECT series_id, j, len AS n, v AS x, lead(v) OVER w - v AS y, least(ceil(12 * pow(len / 100.0, 0.25)), len // 2 - 2)::BIGINT AS top FROM ls WHERE len >= 20 WINDOW w AS (PARTITION BY series_id ORDER BY j)),
u1 AS (SELECT *, 1::DOUBLE AS one, {', '.join(f'lag(y, {k}) OVER w AS l{k}' for k in lags)} FROM u0 WINDOW w AS (PARTITION BY series_id ORDER BY j)),
u2 AS (SELECT series_id, top, one, x, y, {masked('top')} FROM u1 WHERE y IS NOT NULL AND j >= top),
{_orthogonalised('ua', 'u2', 'series_id', ['one', 'x', *names, 'y'], ['top'])},
u3 AS ({losses}),
u4 AS (SELECT series_id, arg_min(k, m * ln(greatest(rss, 1e-300) / m) + 2 * (k + 2)) AS lags FROM u3 GROUP BY series_id),
u5 AS (SELECT u1.series_id, n, lags, one, x, y, {masked('lags')} FROM u1 JOIN u4 USING (series_id) WHERE y IS NOT NULL AND j >= lags),
{_orthogonalised('ub', 'u5', 'series_id', ['one', *names, 'x', 'y'], ['n', 'lags'])},
ad AS (SELECT series_id, any_value(n) AS n, sum(x * y) / sum(x * x) / sqrt((sum(y * y) - pow(sum(x * y), 2) / sum(x * x)) / (count(*) - any_value(lags) - 2) / sum(x * x)) AS t FROM ub{most + 1} GROUP BY series_id)"""


#: kp: (series_id, stat, p) of the KPSS test for a level, from c0 and the lagged sums c1 of _acf.
_LEVEL = """k0 AS (SELECT series_id, n, sum(CASE WHEN lag = 0 THEN c / n ELSE 2 * c / n END) AS s0, sum(CASE WHEN lag > 0 THEN lag * 2 * c / n ELSE 0 END) AS s1 FROM c1 WHERE lag <= floor(pow(n, 2.0 / 9)) GROUP BY series_id, n),
k1 AS (SELECT series_id, n, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1)::BIGINT AS lags FROM k0),
k2 AS (SELECT k1.series_id, k1.n, sum(CASE WHEN lag = 0 THEN c / k1.n ELSE 2 * (1 - lag / (lags + 1.0)) * c / k1.n END) AS long_run FROM k1 JOIN c1 USING (series_id) WHERE lag <= lags GROUP BY ALL),
k3 AS (SELECT series_id, sum(pow(e, 2)) AS ss FROM (SELECT series_id, sum(v) OVER (PARTITION BY series_id ORDER BY j) AS e FROM c0) GROUP BY series_id),
kp AS (SELECT series_id, ss / (n::DOUBLE * n * long_run) AS stat FROM k2 JOIN k3 USING (series_id))"""
_LEVEL_P = "CASE WHEN stat <= 0.347 THEN 0.1 WHEN stat <= 0.463 THEN 0.1 - 0.05 * (stat - 0.347) / 0.116 WHEN stat <= 0.574 THEN 0.05 - 0.025 * (stat - 0.463) / 0.111 WHEN stat <= 0.739 THEN 0.025 - 0.015 * (stat - 0.574) / 0.165 ELSE 0.01 END"
_ROOT = "CASE WHEN t > 2.74 THEN false WHEN t < -18.83 THEN true WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t < -1.6448536269514722 ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t < -1.6448536269514722 END"


def _chi2_tail(x: str, k: str) -> str:
    """The upper tail of a chi-squared variable with an even number k of degrees of freedom."""
    return f"exp(-({x}) / 2) * list_sum(list_transform(range(0, ({k}) // 2), lambda i: exp(i * ln(greatest({x}, 1e-300) / 2) - lgamma(i + 1.0))))"


def _arch(most: int = 48) -> str:
    """lm: (series_id, lag, m, rss, tss) of squares e of c0 on their own lags, for 6, 12, 24 and 48 of them."""
    lags = range(1, most + 1)
    masked = ", ".join(f"CASE WHEN {k} <= g THEN l{k} ELSE 0 END AS l{k}" for k in lags)
    return f"""a0 AS (SELECT series_id, j, v * v AS y FROM c0),
a1 AS (SELECT *, {', '.join(f'lag(y, {k}) OVER w AS l{k}' for k in lags)} FROM a0 WINDOW w AS (PARTITION BY series_id ORDER BY j)),
a2 AS (SELECT series_id, g, 1::DOUBLE AS one, y, {masked} FROM a1, (VALUES (6), (12), (24), (48)) v(g) WHERE j >= g),
{_orthogonalised('ar', 'a2', 'series_id, g', ['one', *(f'l{k}' for k in lags), 'y'], [])},
aq AS (SELECT series_id, g, sum(y * y) AS tss FROM ar1 GROUP BY ALL),
lm AS (SELECT r.series_id, r.g AS lag, count(*) AS m, sum(y * y) AS rss, any_value(tss) AS tss FROM ar{most + 1} r JOIN aq USING (series_id, g) GROUP BY r.series_id, r.g)"""


def _refined(start: str, source: str, step: float, loss: str, rounds: int) -> str:
    """best{rounds}: (series_id, p) with the least loss, an expression of p and the columns of a table, from start{0} (series_id, p) by grids ten times as fine each round."""
    out = []
    for k in range(rounds):
        width = step / 10**k
        out.append(f"grid{k} AS (SELECT series_id, p + d * {width / 10:.12g} AS p FROM {start if k == 0 else f'best{k}'}, range(-10, 11) r(d))")
        out.append(f"loss{k} AS (SELECT g.series_id, g.p, {loss} AS loss FROM grid{k} g JOIN {source} x ON x.series_id = g.series_id GROUP BY g.series_id, g.p)")
        out.append(f"best{k + 1} AS (SELECT series_id, arg_min(p, loss) AS p FROM loss{k} WHERE isfinite(loss) GROUP BY series_id)")
    return ", ".join(out)


# the log likelihood of a power transform; near 0 the transform is the logarithm
_BOX = "CASE WHEN abs(p) < 1e-12 THEN lx ELSE (exp(p * lx) - 1) / p END"
_BOXLOSS = f"-((any_value(p) - 1) * sum(lx) - count(*) / 2.0 * ln(var_pop({_BOX})))"
_BOXCOX = f"""ev AS (SELECT event_type AS series_id, value, min(value) OVER (PARTITION BY event_type) AS lo FROM events WHERE value IS NOT NULL),
ex AS (SELECT series_id, ln(CASE WHEN lo <= 0 THEN value - lo + 1e-6 ELSE value END) AS lx FROM ev),
p0 AS (SELECT DISTINCT series_id, -5 + k * 0.25 AS p FROM ex, range(0, 41) r(k)),
l0 AS (SELECT g.series_id, g.p, {_BOXLOSS} AS loss FROM p0 g JOIN ex x ON x.series_id = g.series_id GROUP BY g.series_id, g.p),
pb AS (SELECT series_id, arg_min(p, loss) AS p FROM l0 GROUP BY series_id), {_refined('pb', 'ex', 0.25, _BOXLOSS, 6)}"""


def peaks(quantile: float, distance: int, name: str = "pk") -> str:
    """(series_id, us, value, u) of local maxima at or above a quantile, the highest first, `distance` rows apart."""
    return f"""{name}r AS (SELECT event_type AS series_id, epoch_us(ts) AS us, value, row_number() OVER w - 1 AS i, CASE WHEN value IS DISTINCT FROM lag(value) OVER w THEN 1 ELSE 0 END AS new FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
{name}f AS (SELECT series_id, flat, any_value(value) AS value, (min(i) + max(i)) // 2 AS i FROM (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY i) AS flat FROM {name}r) GROUP BY series_id, flat),
{name}u AS (SELECT event_type AS series_id, quantile_cont(value, {quantile}) AS u FROM events GROUP BY 1),
{name}c AS (SELECT q.series_id, q.i, q.value, u.u, row_number() OVER (PARTITION BY q.series_id ORDER BY q.value DESC, q.i DESC) AS r FROM (SELECT *, lag(value) OVER w AS lv, lead(value) OVER w AS rv FROM {name}f WINDOW w AS (PARTITION BY series_id ORDER BY flat)) q JOIN {name}u u USING (series_id) WHERE q.value > lv AND q.value > rv AND q.value >= u.u),
{name}l AS (SELECT series_id, list(i ORDER BY r) AS ats FROM {name}c GROUP BY series_id),
{name}g AS (SELECT series_id, ats, 1 AS k, []::BIGINT[] AS kept FROM {name}l UNION ALL
 SELECT series_id, ats, k + 1, CASE WHEN len(list_filter(kept, lambda x: abs(x - ats[k]) < {distance})) = 0 THEN list_append(kept, ats[k]) ELSE kept END FROM {name}g WHERE k <= len(ats)),
{name}k AS (SELECT series_id, unnest(kept) AS i FROM {name}g WHERE k = len(ats) + 1),
{name} AS (SELECT k.series_id, r.us, r.value, u.u FROM {name}k k JOIN {name}r r ON r.series_id = k.series_id AND r.i = k.i JOIN {name}u u ON u.series_id = k.series_id)"""


# the profile likelihood of a generalised Pareto tail in p = shape / scale, over a coarse grid and finer ones
_TAILLOSS = "CASE WHEN abs(any_value(p)) < 1e-9 THEN ln(avg(y)) + 1 WHEN min(1 + p * y) <= 0 THEN 'inf'::DOUBLE WHEN avg(ln(greatest(1 + p * y, 1e-300))) / any_value(p) <= 0 THEN 'inf'::DOUBLE ELSE ln(avg(ln(greatest(1 + p * y, 1e-300))) / any_value(p)) + avg(ln(greatest(1 + p * y, 1e-300))) + 1 END"


def tails(source: str = "pk") -> str:
    """gp: (series_id, n, xi, sigma) fitted to the excesses y of a table of peaks, in units of their mean."""
    return f"""gy AS (SELECT series_id, (value - u) / avg(value - u) OVER (PARTITION BY series_id) AS y, avg(value - u) OVER (PARTITION BY series_id) AS scale, count(*) OVER (PARTITION BY series_id) AS n FROM {source} WHERE value > u),
gx AS (SELECT * FROM gy WHERE n >= 3),
gt AS (SELECT series_id, max(y) AS top FROM gx GROUP BY series_id),
gs AS (SELECT series_id, -(1 - pow(10, -6 + 6.0 * k / 400)) / top AS p FROM gt, range(0, 400) r(k) UNION ALL SELECT series_id, pow(10, -4 + k * 5.7 / 600) AS p FROM gt, range(0, 601) r(k) UNION ALL SELECT series_id, 0 FROM gt),
gl0 AS (SELECT g.series_id, g.p, {_TAILLOSS} AS loss FROM gs g JOIN gx x ON x.series_id = g.series_id GROUP BY g.series_id, g.p),
gb0 AS (SELECT series_id, arg_min(p, loss) AS p FROM gl0 WHERE isfinite(loss) GROUP BY series_id),
ga0 AS (SELECT b.series_id, b.p, least(coalesce(min(CASE WHEN g.p > b.p THEN g.p END), b.p) - b.p, 1e9) AS up, b.p - coalesce(max(CASE WHEN g.p < b.p THEN g.p END), b.p) AS down FROM gb0 b JOIN gs g USING (series_id) GROUP BY b.series_id, b.p),
{_tail_rounds()},
gp AS (SELECT b.series_id, count(*) AS n, avg(ln(1 + b.p * y)) AS xi, avg(ln(1 + b.p * y)) / any_value(b.p) * any_value(scale) AS sigma FROM ga7 b JOIN gx x ON x.series_id = b.series_id GROUP BY b.series_id)"""


def _tail_rounds(rounds: int = 7) -> str:
    out = []
    for k in range(rounds):
        out.append(f"gg{k} AS (SELECT series_id, p + CASE WHEN d > 0 THEN up ELSE down END * d / 10.0 AS p, up / 10 AS up, down / 10 AS down FROM ga{k}, range(-10, 11) r(d))")
        out.append(f"gh{k} AS (SELECT g.series_id, g.p, any_value(up) AS up, any_value(down) AS down, {_TAILLOSS} AS loss FROM gg{k} g JOIN gx x ON x.series_id = g.series_id GROUP BY g.series_id, g.p)")
        out.append(f"ga{k + 1} AS (SELECT series_id, arg_min(p, loss) AS p, any_value(up) AS up, any_value(down) AS down FROM gh{k} WHERE isfinite(loss) GROUP BY series_id)")
    return ",\n".join(out)


def breaks(multipliers: str, jump: int) -> str:
    """cp: (series_id, multiplier, idx) of the change points of mo (series_id, i, n, v), by the whole recursion over all earlier ends."""
    return f"""ml AS (SELECT series_id, any_value(n) AS n, list(v ORDER BY i) AS v, var_pop(v) AS var FROM mo GROUP BY series_id),
mq AS (SELECT series_id, n, list_prepend(0::DOUBLE, list_transform(range(1, n + 1), lambda k: list_sum(v[1 : k]))) AS s, list_prepend(0::DOUBLE, list_transform(range(1, n + 1), lambda k: list_sum(list_transform(v[1 : k], lambda x: x * x)))) AS s2, m AS multiplier, m * var * ln(n) AS pen,
 list_append(list_filter(range(0, n, {jump}), lambda k: k >= 2), n) AS ends FROM ml, (VALUES {multipliers}) a(m) WHERE n >= 4),
dp AS (SELECT series_id, multiplier, n, s, s2, pen, ends, 1 AS k, [-pen] AS f, [-1::BIGINT] AS prev, [0::BIGINT] AS ats FROM mq UNION ALL
 SELECT series_id, multiplier, n, s, s2, pen, ends, k + 1, list_append(f, c.f), list_append(prev, ats[c.i]), list_append(ats, ends[k]) FROM (SELECT *,
  list_min(list_transform(list_filter(range(1, len(ats) + 1), lambda i: ends[k] - ats[i] >= 2), lambda i: {{'f': f[i] + s2[ends[k] + 1] - s2[ats[i] + 1] - (s[ends[k] + 1] - s[ats[i] + 1]) * (s[ends[k] + 1] - s[ats[i] + 1]) / (ends[k] - ats[i]) + pen, 'i': i}})) AS c FROM dp WHERE k <= len(ends))),
bk AS (SELECT series_id, multiplier, ats, prev, n AS b FROM dp WHERE k = len(ends) + 1 UNION ALL SELECT series_id, multiplier, ats, prev, prev[list_position(ats, b)] FROM bk WHERE b > 0),
cp AS (SELECT DISTINCT series_id, multiplier, b AS idx FROM bk WHERE b > 0 AND b < (SELECT max(n) FROM mq q WHERE q.series_id = bk.series_id))"""


MONTHS = """mv AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::DATE AS month, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / (100 * count(*)) AS v FROM orders GROUP BY ALL),
me AS (SELECT e.series_id, e.month::DATE AS month, mv.v FROM (SELECT series_id, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH)) AS month FROM mv GROUP BY series_id) e LEFT JOIN mv ON mv.series_id = e.series_id AND mv.month = e.month::DATE),
mi AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) AS i FROM me),
mb AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER w AS li, last_value(v IGNORE NULLS) OVER w AS lv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER z AS ri, first_value(v IGNORE NULLS) OVER z AS rv FROM mi WINDOW w AS (PARTITION BY series_id ORDER BY i), z AS (PARTITION BY series_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
mp AS (SELECT series_id, month, coalesce(v, lv + (rv - lv) * (i - li) / (ri - li), lv, rv) AS value, v IS NULL AS was_missing FROM mb)"""
_MO = f"{MONTHS}, mo AS (SELECT series_id, month, value AS v, row_number() OVER (PARTITION BY series_id ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM mp)"

# the shape of a Weibull distribution from its coefficient of variation, by halving [0.05, 50]
_CV = "sqrt(greatest(exp(lgamma(1 + 2 / ((lo + hi) / 2)) - 2 * lgamma(1 + 1 / ((lo + hi) / 2))) - 1, 0))"
_WEIBULL = f"""hv AS (SELECT key, mean, cv, 0.05::DOUBLE AS lo, 50::DOUBLE AS hi, 0 AS k FROM wm UNION ALL
 SELECT key, mean, cv, CASE WHEN {_CV} > cv THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_CV} > cv THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM hv WHERE k < 60),
wb AS (SELECT key, (lo + hi) / 2 AS shape, mean / exp(lgamma(1 + 2 / (lo + hi))) AS scale FROM hv WHERE k = 60)"""

_READING = "CASE WHEN xi > 0.1 THEN 'heavy tail, no upper bound' WHEN xi >= -0.1 THEN 'near exponential' ELSE 'bounded tail' END || CASE WHEN n < 10 THEN ', from few peaks' ELSE '' END"
_NAMED = "CASE WHEN abs(period_hours - 12.4206) <= 0.25 THEN 'M2' WHEN abs(period_hours - 12) <= 0.25 THEN 'S2' WHEN abs(period_hours - 6.1033) <= 0.25 THEN 'MS4' WHEN abs(period_hours - 24) <= 0.25 THEN 'diurnal' END"


def _settings() -> str:
    """Fits of peaks over a grid of thresholds and separations, each as a series of its own."""
    cells = [(q, d) for q in (0.85, 0.9, 0.95) for d in (2, 8)]
    parts = ",\n".join(peaks(q, d, f"p{k}") for k, (q, d) in enumerate(cells))
    all_ = " UNION ALL ".join(f"SELECT series_id || '|{q}|{d}' AS series_id, us, value, u FROM p{k}" for k, (q, d) in enumerate(cells))
    return f"WITH RECURSIVE {parts}, pk AS ({all_}), {tails()}, uu AS (SELECT series_id, any_value(u) AS u FROM pk GROUP BY 1), yr AS (SELECT event_type AS s, (epoch_us(max(ts)) - epoch_us(min(ts))) / 31557600000000.0 AS years FROM events GROUP BY 1) SELECT split_part(gp.series_id, '|', 1) AS series_id, split_part(gp.series_id, '|', 2)::DOUBLE AS quantile, split_part(gp.series_id, '|', 3)::BIGINT AS distance, n AS n_peaks, {_R4('xi', 3)} AS xi, {_R4('u + sigma / xi * (pow(n / years * 50, xi) - 1)', 0)} AS level_50 FROM gp JOIN uu USING (series_id) JOIN yr ON yr.s = split_part(gp.series_id, '|', 1)"


ESTIMATOR_SQL: dict[str, str] = {
    "spectra": f"WITH {_SPECTRA} SELECT series_id, {_R4('frequency', 8)} AS frequency, {_R4('period_hours', 6)} AS period_hours, {_R4('power')} AS power FROM sp",
    "spectral_ratios": f"WITH {_SPECTRA} SELECT series_id, {_R4('max(CASE WHEN abs(period_hours - 24) < 1 THEN power END) / median(CASE WHEN period_hours > 6 AND period_hours < 48 AND NOT abs(period_hours - 24) < 1 THEN power END)', 6)} AS ratio FROM sp GROUP BY series_id",
    "dominant_period": f"WITH {_SPECTRA}, b AS (SELECT series_id, first(period_hours ORDER BY power DESC, frequency DESC) AS period_hours FROM sp WHERE period_hours BETWEEN 4 AND 30 GROUP BY series_id) SELECT series_id, {_R4('period_hours', 6)} AS period_hours, {_NAMED} AS constituent FROM b",
    "partial_autocorrelation": f"""WITH RECURSIVE {SEGMENTS}, src AS (SELECT series_id, j, len AS n, v FROM ls), {_acf('src', 'series_id', '24')}, rl AS (SELECT series_id, list(r ORDER BY lag) AS r FROM ac GROUP BY series_id),
lv AS (SELECT series_id, r, 0::BIGINT AS k, []::DOUBLE[] AS phi, 1::DOUBLE AS e, 1::DOUBLE AS a FROM rl UNION ALL
 SELECT series_id, r, k + 1, list_append(list_transform(range(1, k + 1), lambda i: phi[i] - b * phi[k + 1 - i]), b), e * (1 - b * b), b FROM (SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 2 - i])), 0)) / e AS b FROM lv WHERE k < 24))
SELECT lv.series_id, k AS lag, {_R4('ac.r', 6)} AS acf, {_R4('a', 6)} AS pacf FROM lv JOIN ac ON ac.series_id = lv.series_id AND ac.lag = lv.k""",
    "timescales": f"WITH {_SEGMENT_SCALES}, st AS (SELECT series_id, seg, min(h) * 3600000000 AS start_us FROM sg GROUP BY ALL) SELECT ts.series_id, start_us, n, {_R4('tau', 5)} AS tau_hours, {_R4('lag1', 6)} AS lag1, cut_lag, hit AS hit_ceiling FROM ts JOIN st USING (series_id, seg)",
    "dependence": f"WITH {_SEGMENT_SCALES}, d AS (SELECT series_id, sum(n * tau) / sum(n) AS tau, sum(n * lag1) / sum(n) AS lag1, bool_or(hit) AS hit FROM ts GROUP BY series_id) SELECT series_id, {_R4('tau', 5)} AS tau_hours, {_R4('lag1', 6)} AS lag1, hit AS hit_ceiling, greatest(1, ceil(tau))::BIGINT AS block_length, {_R4('2 * tau', 1)} AS decluster_hours FROM d",
    "harmonic_residuals": f"WITH {_GRID}, sv AS (SELECT series_id, h, value AS y FROM grid WHERE value IS NOT NULL), {_residuals('sv', 24.0, 2)}, f AS (SELECT series_id, count(*) AS fitted FROM grid GROUP BY 1) SELECT series_id, count(*) AS n, {_R4('avg(y * y)')} AS mse, any_value(fitted) AS fitted FROM ge JOIN f USING (series_id) GROUP BY series_id",
    "deseasonalised_timescales": f"WITH {_GRID}, sv AS (SELECT series_id, h, value AS y FROM grid WHERE value IS NOT NULL), {_residuals('sv', 24.0, 3)}, src AS (SELECT series_id || '|' || k AS series_id, row_number() OVER (PARTITION BY series_id, k ORDER BY h) - 1 AS j, count(*) OVER (PARTITION BY series_id, k) AS n, v FROM (SELECT series_id, 'raw' AS k, h, y AS v FROM sv UNION ALL SELECT series_id, 'clean', h, y FROM ge)), {_acf('src', 'series_id', 'least(n // 3, 2000)')}, {_timescales('series_id')} SELECT split_part(series_id, '|', 1) AS series_id, {_R4('''max(CASE WHEN split_part(series_id, '|', 2) = 'raw' THEN tau END)''', 5)} AS raw_tau, {_R4('''max(CASE WHEN split_part(series_id, '|', 2) = 'clean' THEN tau END)''', 5)} AS tau_hours FROM ts GROUP BY 1",
    "stationarity": f"WITH {SEGMENTS}, {_unit_root()}, src AS (SELECT series_id, j, len AS n, v FROM ls), {_acf('src', 'series_id', 'least(n - 1, 200)')}, {_LEVEL}, b AS (SELECT series_id, n, t, stat, {_LEVEL_P} AS p, {_ROOT} AS root FROM ad JOIN kp USING (series_id)) SELECT series_id, n, {_R4('t')} AS adf, {_R4('stat')} AS kpss, {_R4('p')} AS kpss_p, CASE WHEN root AND p >= 0.05 THEN 'stationary' WHEN root THEN 'difference_stationary' WHEN p >= 0.05 THEN 'trend_stationary' ELSE 'non_stationary' END AS verdict FROM b",
    "whiteness": f"WITH {_GRID}, sv AS (SELECT series_id, h, value AS y FROM grid WHERE value IS NOT NULL), {_residuals('sv', 24.0, 2)}, src AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY h) - 1 AS j, count(*) OVER (PARTITION BY series_id) AS n, y AS v FROM ge), {_acf('src', 'series_id', '48')}, {_arch()}, q AS (SELECT lm.*, (SELECT any_value(n) * (any_value(n) + 2) * sum(r * r / (n - ac.lag)) FROM ac WHERE ac.series_id = lm.series_id AND ac.lag BETWEEN 1 AND lm.lag) AS q, m * (1 - rss / tss) AS l FROM lm) SELECT series_id, lag::BIGINT AS lag, {_R4('q')} AS lb_q, {_R4(_chi2_tail('q', 'lag'), 6)} AS lb_p, {_R4('l')} AS lm, {_R4(_chi2_tail('l', 'lag'), 6)} AS lm_p, {_R4('(tss - rss) / lag / (rss / (m - lag - 1))', 5)} AS f FROM q",
    "power_transform": f"WITH {_BOXCOX} SELECT series_id, count(*) AS n, {_R4('any_value(p)', 3)} AS lambda, {_R4(f'avg({_BOX})', 2)} AS mean, {_R4(f'stddev_pop({_BOX})', 2)} AS deviation FROM best6 JOIN ex USING (series_id) GROUP BY series_id",
    "storm_peaks": f"WITH RECURSIVE {peaks(0.9, 5)} SELECT series_id, us, value AS peak FROM pk",
    "extreme_fits": f"WITH RECURSIVE {peaks(0.9, 5)}, {tails()}, fx AS (SELECT gp.series_id, n_, row_number() OVER (PARTITION BY gp.series_id ORDER BY y) AS i, CASE WHEN abs(xi) < 1e-8 THEN 1 - exp(-y * scale / sigma) ELSE 1 - pow(greatest(1 + xi * y * scale / sigma, 0), -1 / xi) END AS f FROM (SELECT *, n AS n_ FROM gx) g JOIN gp USING (series_id)), ks AS (SELECT series_id, max(greatest(i::DOUBLE / n_ - f, f - (i - 1)::DOUBLE / n_)) AS ks FROM fx GROUP BY 1) SELECT series_id, n AS n_peaks, {_R4('xi', 3)} AS xi, {_R4('sigma', 2)} AS sigma, {_R4('ks')} AS ks, n < 10 AS few FROM gp JOIN ks USING (series_id)",
    "extreme_readings": f"WITH RECURSIVE {peaks(0.9, 5)}, {tails()} SELECT series_id, n AS n_peaks, {_R4('xi', 3)} AS xi, {_READING} AS reading FROM gp",
    "extreme_settings": _settings(),
    "change_points": f"WITH RECURSIVE {_MO}, {breaks('(0.5::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE), (4.0::DOUBLE)', 5)} SELECT series_id, multiplier, idx AS break_idx FROM cp",
    "change_coverage": f"""WITH RECURSIVE {_MO}, {breaks('(1.0::DOUBLE)', 1)}, cs AS (SELECT mo.series_id, month, v, sum(CASE WHEN cp.idx IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY mo.series_id ORDER BY i) AS seg FROM mo LEFT JOIN cp ON cp.series_id = mo.series_id AND cp.idx = mo.i),
cg AS (SELECT series_id, seg, min(month) AS a, max(month) AS b, avg(v) AS mean FROM cs GROUP BY ALL),
dd AS (SELECT DISTINCT o_orderpriority AS series_id, o_orderdate::DATE AS dd FROM orders), dy AS (SELECT series_id, year(dd) AS year, count(CASE WHEN month(dd) IN (10, 11, 12, 1, 2, 3) THEN 1 END) AS storm FROM dd GROUP BY ALL),
th AS (SELECT series_id, year FROM (SELECT *, min(year) OVER (PARTITION BY series_id) AS lo, max(year) OVER (PARTITION BY series_id) AS hi FROM dy) WHERE floor(1000.0 * storm / (make_date(year + 1, 1, 1) - make_date(year, 1, 1) - 183) + 0.5) / 10 < 80 AND year > lo AND year < hi)
SELECT cg.series_id, seg::BIGINT AS seg, strftime(a, '%Y-%m') AS start, strftime(b, '%Y-%m') AS "end", {_R4('mean', 2)} AS mean, coalesce(string_agg(th.year::VARCHAR, ',' ORDER BY th.year), '') AS thin_years FROM cg LEFT JOIN th ON th.series_id = cg.series_id AND th.year BETWEEN year(a) AND year(b) GROUP BY cg.series_id, seg, a, b, mean""",
    "largest_left_out": f"""WITH RECURSIVE ep AS (SELECT event_type AS series_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts) AS r FROM events WHERE value > 0),
wm AS (SELECT series_id || '|all' AS key, avg(value) AS mean, stddev_pop(value) / avg(value) AS cv FROM ep GROUP BY series_id HAVING count(*) >= 10 UNION ALL SELECT series_id || '|rest', avg(value), stddev_pop(value) / avg(value) FROM ep WHERE r > 1 GROUP BY series_id HAVING count(*) >= 9), {_WEIBULL}
SELECT split_part(a.key, '|', 1) AS series_id, {_R4('a.shape', 6)} AS shape, {_R4('b.shape', 6)} AS shape_without_max, {_R4('100 * (b.shape - a.shape) / a.shape', 5)} AS shape_change_pct, {_R4('100 * (b.scale - a.scale) / a.scale', 5)} AS scale_change_pct FROM wb a JOIN wb b ON split_part(a.key, '|', 1) = split_part(b.key, '|', 1) AND a.key LIKE '%|all' AND b.key LIKE '%|rest'""",
}
