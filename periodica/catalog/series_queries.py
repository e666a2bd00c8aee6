"""Many-series analysis queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from periodica.catalog import carriers as c
from periodica.catalog.carriers import ctes
from periodica.catalog.join_queries import _PAIRS, customer_pairs
from periodica.catalog.registry import f32, q6, qf, query, r6
from periodica.operators import joins as jn
from periodica.plans import factors as fa
from periodica.plans import forecasts as fc
from periodica.plans import scopes as sc
from periodica.plans import series_pairs as spairs
from periodica.plans import series_tests as st
from periodica.plans import warping as wp

D = lambda s: F.lit(s).cast("date")
SERIES = lambda df: df.select(F.col("indicator").alias("series"), F.col("period").alias("ts"), "value")


def flag_pairs(t):
    s = SERIES(c.flag_day(t))
    return s, spairs.target_pairs(s, "AF")


_FLAG_PAIRS = """
, s as (select indicator as n, period as ts, value from flag_day),
p as (select a.n as target, b.n as candidate from (select distinct n from s) a join (select distinct n from s) b on a.n = 'AF' and b.n <> a.n)"""


def _kl_sql(keys: str) -> str:
    """Shared-bin divergence over a CTE ``v(keys, x, y)``."""
    return f"""
, m as (select {keys}, count(*) as n, least(min(x), min(y)) as lo, greatest(max(x), max(y)) as hi from v group by {keys} having count(*) >= 10),
bb as (select *, case when hi = lo then 1 else greatest(2, ceil(least(sqrt(n), 10 * log10(n)))::int) end as b from m),
h as (select {keys}, n, b, case when hi = lo then 0 else least(floor((x - lo) / (hi - lo) * b), b - 1)::int end as bx, case when hi = lo then 0 else least(floor((y - lo) / (hi - lo) * b), b - 1)::int end as yb from v join bb using ({keys})),
cnt as (select {keys}, n, b, bin, sum(p) / n as p, sum(q) / n as q from (select {keys}, n, b, bx as bin, 1 as p, 0 as q from h union all select {keys}, n, b, yb, 0, 1 from h) group by {keys}, n, b, bin),
kl as (select {keys}, n as samples, greatest(0, sum((p + 1e-9) / (1 + b * 1e-9) * (ln((p + 1e-9) / (1 + b * 1e-9)) - ln((q + 1e-9) / (1 + b * 1e-9))))) as kl from cnt group by {keys}, n)"""


@query("n01_shared_histogram", ctes("flag_day") + _FLAG_PAIRS + """
, v as (select target, candidate, a.value as x, b.value as y from p join s a on a.n = target join s b on b.n = candidate and b.ts = a.ts)""" + _kl_sql("target, candidate") + f"""
select target, candidate, n as samples, b::int as bins, bin::int as bin, {q6('p')} as p, {q6('q')} as q from cnt""")
def _(t):
    s, p = flag_pairs(t)
    v = jn.align_pairs(s, p, strict=True)
    return spairs.shared_histogram(v, spairs.PAIR).withColumn("p", r6("p")).withColumn("q", r6("q")).withColumn("bins", F.col("bins").cast("int"))


@query("n02_kl_divergence", ctes("flag_day") + _FLAG_PAIRS + """
, v as (select target, candidate, a.value as x, b.value as y from p join s a on a.n = target join s b on b.n = candidate and b.ts = a.ts)""" + _kl_sql("target, candidate") + f"""
select target, candidate, samples, {q6('kl')} as kl from kl""")
def _(t):
    s, p = flag_pairs(t)
    v = jn.align_pairs(s, p, strict=True)
    return spairs.kl_divergence(spairs.shared_histogram(v, spairs.PAIR), spairs.PAIR).withColumn("kl", r6("kl"))


_ALL_LAGS = """
, u as (select target, candidate, ts, max(x) as x, max(y) as y from (select target, candidate, ts, value as x, null::double as y from p join s on n = target
  union all select target, candidate, ts, null, value from p join s on n = candidate) group by 1, 2, 3),
z as (select target, candidate, row_number() over (partition by target, candidate order by ts) as i, count(*) over (partition by target, candidate) as n, x, y from u),
lg as (select unnest(generate_series(-6, 6))::int as lag),
v as (select a.target, a.candidate, lag, a.x as x, b.y as y from z a cross join lg join z b on b.target = a.target and b.candidate = a.candidate and b.i = a.i - lag where a.x is not null and b.y is not null and abs(lag) < a.n)""" + _kl_sql("target, candidate, lag")
_LAGS = ctes("customer_month") + _PAIRS + _ALL_LAGS
_DAILY_LAGS = ctes("flag_day") + _FLAG_PAIRS + _ALL_LAGS


@query("n03_lead_lag_scan", _LAGS + f"""
select target, candidate, lag, samples, {q6('kl')} as kl from kl""")
def _(t):
    s, p = customer_pairs(t)
    scan, _best = spairs.lead_lag_scan(s, p, 6, standardise=False)
    return scan.withColumn("kl", r6("kl"))


@query("n03_best_lag", _LAGS + f"""
select target, candidate, arg_min(lag, (kl, lag)) as lag, {q6('min(kl)')} as kl from kl where abs(lag) <= 5 group by 1, 2""")
def _(t):
    s, p = customer_pairs(t)
    _scan, best = spairs.lead_lag_scan(s, p, 6, standardise=False)
    return best.withColumn("kl", r6("kl"))


@query("n03_daily_scan", _DAILY_LAGS + f"""
select target, candidate, lag, samples, {q6('kl')} as kl from kl""")
def _(t):
    scan, _best = spairs.lead_lag_scan(*flag_pairs(t), 6, standardise=False)
    return scan.withColumn("kl", r6("kl"))


@query("n03_daily_best", _DAILY_LAGS + f"""
select target, candidate, arg_min(lag, (kl, lag)) as lag, {q6('min(kl)')} as kl from kl where abs(lag) <= 5 group by 1, 2""")
def _(t):
    _scan, best = spairs.lead_lag_scan(*flag_pairs(t), 6, standardise=False)
    return best.withColumn("kl", r6("kl"))


def _warp_sql(strict: bool, radius: int | None) -> str:
    """The cost matrix of each pair, one anti-diagonal a step, as lists over the target's places."""
    common = """
k as (select target, candidate, x.ts, x.value as x, y.value as y from p join s x on x.n = target join s y on y.n = candidate and y.ts = x.ts),
pts as (select target, candidate, 'a' as side, ts, x as value from k union all select target, candidate, 'b', ts, y from k)"""
    ranged = """
bounds as (select n, min(ts) as f, max(ts) as l from s group by 1),
r as (select target, candidate, greatest(x.f, y.f) as f, least(x.l, y.l) as l from p join bounds x on x.n = target join bounds y on y.n = candidate),
pts as (select target, candidate, 'a' as side, ts, value from r join s on s.n = target and ts between f and l union all select target, candidate, 'b', ts, value from r join s on s.n = candidate and ts between f and l)"""
    band = f"abs(i - (d + 1 - i)) <= {radius}" if radius else "true"
    narrow = f"when abs(n - m) > {radius} then 'band_too_narrow'" if radius else ""
    return f"""
, {(common if strict else ranged).strip()},
z as (select target, candidate, side, ts, coalesce((value - avg(value) over w) / nullif(stddev_samp(value) over w, 0), value) as v from pts window w as (partition by target, candidate, side)),
seq as (select target, candidate, list(v order by ts) filter (where side = 'a') as a, list(v order by ts) filter (where side = 'b') as b from z group by 1, 2),
sized as (select p.target, p.candidate, coalesce(len(a), 0) as n, coalesce(len(b), 0) as m, a, b from p left join seq using (target, candidate)),
judged as (select *, case when n < 4 or m < 4 then 'insufficient_data' {narrow} end as reason from sized),
-- cur and prev hold the cells of the last two anti-diagonals at place i + 1
w as (select target, candidate, a, b, n, m, 1 as d, list_transform(range(0, n + 1), lambda i: 'inf'::double) as cur, list_transform(range(0, n + 1), lambda i: case when i = 0 then 0.0 else 'inf'::double end) as prev
  from judged where reason is null
  union all select target, candidate, a, b, n, m, d + 1, list_transform(range(0, n + 1), lambda i: case when i >= 1 and d + 1 - i between 1 and m and {band}
    then pow(a[i] - b[d + 1 - i], 2) + least(cur[i], cur[i + 1], prev[i]) else 'inf'::double end), cur from w where d < n + m)
select j.target, j.candidate, j.n::bigint as points, j.m::bigint as other_points, {q6('sqrt(w.cur[j.n + 1])')} as distance, reason from judged j left join w on w.target = j.target and w.candidate = j.candidate and w.d = j.n + j.m"""


def warped(t, **options):
    s, p = customer_pairs(t)
    return wp.dtw_distances(s, p, standardise=True, minimum=4, **options).withColumn("distance", r6("distance"))


@query("n04_dtw_distance", ctes("customer_month") + _PAIRS + _warp_sql(True, None))
def _(t):
    return warped(t)


@query("n04_dtw_band", ctes("customer_month") + _PAIRS + _warp_sql(True, 2))
def _(t):
    return warped(t, radius=2)


@query("n04_dtw_range", ctes("customer_month") + _PAIRS + _warp_sql(False, None))
def _(t):
    return warped(t, strict=False)


@query("n04_dtw_range_band", ctes("customer_month") + _PAIRS + _warp_sql(False, 3))
def _(t):
    return warped(t, strict=False, radius=3)


@query("n05_dickey_fuller", ctes("flag_month") + f"""
, d as (select indicator, value - lag(value) over w as dy, lag(value) over w as y1 from flag_month window w as (partition by indicator order by period)),
r as (select indicator, count(*) as n, regr_slope(dy, y1) as b, regr_sxx(dy, y1) as sxx, regr_syy(dy, y1) as syy, regr_sxy(dy, y1) as sxy from d where dy is not null group by 1),
q as (select indicator, n, b / sqrt((syy - b * sxy) / (n - 2) / sxx) as t from r)
select indicator as series, 'df' as test, {q6('t', 4)} as statistic, 0::int as lags, n as nobs, -2.86::double as critical, case when t < -2.86 then 'stationary' else 'non_stationary' end as decision from q""")
def _(t):
    s = SERIES(c.flag_month(t)).withColumn("value", F.col("value"))
    return st.dickey_fuller(s).drop("trend").withColumn("statistic", r6("statistic", 4))


@query("n05_kpss", ctes("flag_month") + f"""
, r as (select indicator, row_number() over w as i, count(*) over (partition by indicator) as n, value - avg(value) over (partition by indicator) as e from flag_month window w as (partition by indicator order by period)),
s as (select *, sum(e) over (partition by indicator order by i) as cs, ceil(12 * pow(n / 100.0, 0.25))::int as l from r),
b as (select indicator, n, l, sum(cs * cs) as ss, sum(e * e) as g0 from s group by 1, 2, 3),
g as (select x.indicator, sum((1 - k::double / (x.l + 1)) * x.e * y.e) as g from (select *, unnest(generate_series(1, l)) as k from s) x join s y on y.indicator = x.indicator and y.i = x.i - k group by 1),
f as (select b.indicator, l, n, ss / (n * n) / ((g0 + 2 * coalesce(g, 0)) / n) as stat from b left join g using (indicator))
select indicator as series, 'kpss' as test, {q6('stat')} as statistic, l as lags, n as nobs, 0.463::double as critical, case when stat > 0.463 then 'non_stationary' else 'stationary' end as decision from f""")
def _(t):
    return st.kpss_statistic(SERIES(c.flag_month(t))).drop("trend").withColumn("statistic", r6("statistic"))


def _residual(column: str, terms: str, by: str = "series") -> str:
    """Residual of a column on deterministic terms, from the centred line ``u`` and square ``v`` of each row."""
    over = f"over (partition by {by})"
    line = f" - u * sum({column} * u) {over} / sum(u * u) {over}"
    square = f" - v * sum({column} * v) {over} / sum(v * v) {over}"
    return {"n": column, "c": f"{column} - avg({column}) {over}", "ct": f"{column} - avg({column}) {over}{line}", "ctt": f"{column} - avg({column}) {over}{line}{square}"}[terms]


def _terms_sql() -> str:
    """All tests with all their deterministic terms, from lagged products written out lag by lag."""
    ctes_, parts = [], []
    weighted = "select series, sum((1 - k::double / (l + 1)) * a * b) as g from (select x.series, x.l, k, x.e as a, y.e as b from (select *, unnest(generate_series(1, l)) as k from {r}) x join {r} y on y.series = x.series and y.i = x.i - k) group by 1"
    for d in ("n", "c", "ct", "ctt"):
        k = {"n": 0, "c": 1, "ct": 2, "ctt": 3}[d]
        ctes_ += [f"df_{d} as (select series, {_residual('dy', d)} as a, {_residual('y1', d)} as b from lagged)",
                  f"dfs_{d} as (select series, count(*) as n, sum(a * b) / sum(b * b) as beta, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb from df_{d} group by 1)"]
        parts.append(f"select series, 'df' as test, '{d}' as trend, beta / sqrt((aa - beta * ab) / (n - {k + 1}) / bb) as s, 0 as lags, n as nobs from dfs_{d}")
    for d in ("c", "ct"):
        k = {"c": 2, "ct": 3}[d]
        ctes_ += [f"ke_{d} as (select series, i, n, l, {_residual('y', d)} as e from placed)",
                  f"ks_{d} as (select *, sum(e) over (partition by series order by i) as cs from ke_{d})",
                  f"kg_{d} as ({weighted.format(r=f'ke_{d}')})",
                  f"pr_{d} as (select series, i, n, l, {_residual('y', d)} as a, {_residual('y1', d)} as b from lagged)",
                  f"pf_{d} as (select series, sum(a * b) / sum(b * b) as rho, sum(b * b) as bb from pr_{d} group by 1)",
                  f"pe_{d} as (select series, i, n, l, a - rho * b as e, rho, bb from pr_{d} join pf_{d} using (series))",
                  f"pg_{d} as ({weighted.format(r=f'pe_{d}')})",
                  f"pv_{d} as (select series, n, l, max(rho) as rho, sum(e * e) / (n - {k}) as s2, sqrt(sum(e * e) / (n - {k}) / max(bb)) as se, sum(e * e) / n as own, (sum(e * e) + 2 * max(g)) / n as lr from pe_{d} join pg_{d} using (series) group by 1, 2, 3)"]
        parts.append(f"select series, 'kpss', '{d}', sum(cs * cs) / (n * n) / ((sum(e * e) + 2 * max(g)) / n), l, n from ks_{d} join kg_{d} using (series) group by series, l, n")
        parts.append(f"select series, 'pp', '{d}', sqrt(own / lr) * (rho - 1) / se - 0.5 * (lr - own) / sqrt(lr) * n * se / sqrt(s2), l, n from pv_{d}")
    critical = "case " + " ".join(
        f"when test in ({names}) and trend = '{d}' then {table[d][0.05]}" for names, table in (("'df', 'pp'", st.DF_CRITICAL), ("'kpss'", st.KPSS_CRITICAL)) for d in table) + " end"
    return f"""
, base as (select indicator as series, value as y, row_number() over (partition by indicator order by period) as i, count(*) over (partition by indicator) as n, lag(value) over (partition by indicator order by period) as y1 from flag_month),
sized as (select *, ceil(12 * pow(n / 100.0, 0.25))::int as l from base),
placed as (select series, y, i, n, l, i - (n + 1) / 2.0 as u, pow(i - (n + 1) / 2.0, 2) - (n * n - 1) / 12.0 as v from sized),
lagged as (select series, y, y1, y - y1 as dy, i - 1 as i, n - 1 as n, l, i - 1 - n / 2.0 as u, pow(i - 1 - n / 2.0, 2) - ((n - 1) * (n - 1) - 1) / 12.0 as v from sized where y1 is not null),
{", ".join(ctes_)},
found as ({" union all ".join(parts)}),
judged as (select *, ({critical})::double as critical from found)
select series, test, trend, {q6('s', 4)} as statistic, lags::int as lags, nobs, critical, case when test = 'kpss' and s > critical or test <> 'kpss' and s >= critical then 'non_stationary' else 'stationary' end as decision from judged"""


@query("n05_trend_terms", ctes("flag_month") + _terms_sql())
def _(t):
    s = SERIES(c.flag_month(t))
    found = [st.stationarity_battery(s, [test], trend=d) for test, terms in st.TERMS.items() for d in terms]
    return reduce(DataFrame.unionByName, found).withColumn("statistic", r6("statistic", 4))


@query("n06_autocorrelation", ctes("customer_month") + f"""
, x as (select indicator, row_number() over (partition by indicator order by period) as i, count(*) over (partition by indicator) as n, value - avg(value) over (partition by indicator) as d from customer_month),
v as (select indicator, sum(d * d) as v from x group by 1)
select a.indicator as series, lag::int as lag, {q6('sum(a.d * b.d) / max(v)')} as acf from (select *, unnest(generate_series(1, least(40, n // 2 - 1))) as lag from x where n >= 4) a
join x b on b.indicator = a.indicator and b.i = a.i - lag join v on v.indicator = a.indicator group by 1, 2""")
def _(t):
    return spairs.autocorrelation(SERIES(c.customer_month(t))).withColumn("acf", r6("acf"))


_BT = """
, ix as (select indicator as series, period as ts, value, row_number() over (partition by indicator order by period) as i from flag_month),
o as (select a.series, a.i as origin, h::int as horizon, b.ts, b.value as actual, a.value as reference from (select *, unnest(generate_series(1, 6)) as h from ix where i >= 36) a join ix b on b.series = a.series and b.i = a.i + h),
f as (select o.*, n.value as baseline, s.value as seasonal_naive, o.reference + horizon * (o.reference - fst.value) / (origin - 1) as drift from o
  left join ix n on n.series = o.series and n.i = o.origin left join ix s on s.series = o.series and s.i = o.origin - 12 + 1 + (o.horizon - 1) % 12 join ix fst on fst.series = o.series and fst.i = 1)"""


@query("n08_naive_baselines", ctes("flag_month") + _BT + f"""
select series, origin::int as origin, horizon, ts, actual, baseline, seasonal_naive, {qf('drift')} as drift from f""")
def _(t):
    s = SERIES(c.flag_month(t))
    f = fc.origins(s, 36, 6)
    f = fc.drift(fc.naive(fc.naive(f, s, 1, "baseline"), s, 12, "seasonal_naive"), s, "drift")
    return f.select("series", "origin", "horizon", "ts", "actual", "baseline", "seasonal_naive", f32("drift").alias("drift"))


@query("n09_rolling_backtest", ctes("flag_month") + _BT + f"""
, ar as (select series, i as origin, covar_samp(value, l) over w / var_samp(case when l is not null then l end) over w as b, avg(case when l is not null then value end) over w as my, avg(l) over w as mx
  from (select *, lag(value) over (partition by series order by i) as l from ix) window w as (partition by series order by i rows unbounded preceding)),
z as (select f.*, (my - b * mx) * (1 - pow(b, horizon)) / (1 - b) + pow(b, horizon) * reference as ar1 from f join ar using (series, origin)),
m as (select series, origin, horizon, actual, reference, baseline, 'seasonal_naive' as model, seasonal_naive as predicted from z union all select series, origin, horizon, actual, reference, baseline, 'drift', drift from z
  union all select series, origin, horizon, actual, reference, baseline, 'ar1', ar1 from z)
select series, model, horizon, {qf('avg(abs(actual - predicted))')} as mae, count(*) as n from m group by 1, 2, 3""")
def _(t):
    b = fc.backtest(SERIES(c.flag_month(t)), 36, 6, 12)
    return b.groupBy("series", "model", "horizon").agg(f32(F.avg(F.abs(F.col("actual") - F.col("predicted")))).alias("mae"), F.count(F.lit(1)).alias("n"))


_SCORE = """avg(abs(actual - predicted)) as mae, sqrt(avg((actual - predicted) * (actual - predicted))) as rmse, avg((actual - predicted) / actual * 100) as mpe, avg(abs((actual - predicted) / actual * 100)) as mape,
  avg(200 * abs(actual - predicted) / (abs(actual) + abs(predicted))) as smape, count(*) filter (where predicted is not null and actual is not null) as valid, count(*) filter (where predicted is not null and actual is not null) as percent_valid,
  count(*) filter (where predicted is not null and actual is not null) / count(*) as coverage, avg(case when predicted is not null and actual is not null then (sign(actual - reference) = sign(predicted - reference))::int end) as direction_hit, count(*) filter (where predicted is not null and actual is not null) as direction_valid,
  avg(case when predicted is not null and actual is not null then (abs(actual - predicted) < abs(actual - baseline))::int end) as win_rate, corr(actual, predicted) as correlation"""
_SNUM = ("mae", "rmse", "mpe", "mape", "smape", "coverage", "direction_hit", "win_rate", "correlation")


def scored_frame(t):
    s = SERIES(c.flag_month(t))
    f = fc.drift(fc.naive(fc.naive(fc.origins(s, 36, 6), s, 1, "baseline"), s, 12, "seasonal_naive"), s, "drift")
    ids = ["series", "origin", "horizon", "ts", "reference", "baseline", F.when(F.month("ts") != 7, F.col("actual")).alias("actual"), F.when(F.col("ts") < D("2000-07-01"), "early").otherwise("late").alias("phase")]
    return f.select(*ids, F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in ("seasonal_naive", "drift")])))


_SCORED = _BT + """
, g as (select series, origin, horizon, ts, reference, baseline, case when month(ts) <> 7 then actual end as actual, case when ts < date '2000-07-01' then 'early' else 'late' end as phase, seasonal_naive, drift from f),
m as (select g.*, 'seasonal_naive' as model, seasonal_naive as predicted from g union all select g.*, 'drift', drift from g)"""


@query("n07_forecast_scores", ctes("flag_month") + _SCORED + f""", k as (select series, model, phase, horizon, {_SCORE} from m group by 1, 2, 3, 4)
select series, model, phase, horizon, valid, percent_valid, direction_valid, {', '.join(qf(x) + ' as ' + x for x in _SNUM)} from k""")
def _(t):
    k = fc.score(scored_frame(t), ["series", "model", "phase", "horizon"])
    return k.select("series", "model", "phase", "horizon", "valid", "percent_valid", "direction_valid", *[f32(x).alias(x) for x in _SNUM])


@query("n10_pick_best", ctes("flag_month") + _SCORED + f"""
, k as (select series, model, sqrt(avg((actual - predicted) * (actual - predicted))) as rmse from m group by 1, 2)
select series, min_by(model, (rmse, model)) as model, {qf('min(rmse)')} as rmse from k group by 1""")
def _(t):
    k = fc.score(scored_frame(t), ["series", "model"]).select("series", "model", "rmse")
    return fc.pick_best(k, ["series"], "rmse", "model").withColumn("rmse", f32("rmse"))


def _removal_sql() -> str:
    """Every subset of three variables refitted by its own normal equations, then the way down through them."""
    m = {"1": "c11 - s1 * s1 / n", "2": "c22 - s2 * s2 / n", "3": "c33 - s3 * s3 / n"}
    cross = {"12": "c12 - s1 * s2 / n", "13": "c13 - s1 * s3 / n", "23": "c23 - s2 * s3 / n", **{f"{i}y": f"c{i}y - s{i} * sy / n" for i in "123"}}
    moments = ", ".join(f"sum(x{a} * x{b}) filter (where fit) as c{a}{b}" for a, b in ("11", "22", "33", "12", "13", "23")) + ", " + ", ".join(f"sum(x{a} * y) filter (where fit) as c{a}y, sum(x{a}) filter (where fit) as s{a}" for a in "123")
    centred = ", ".join(f"{e} as m{k}{k}" for k, e in m.items()) + ", " + ", ".join(f"{e} as m{k}" for k, e in cross.items())
    det3 = "(m11 * (m22 * m33 - m23 * m23) - m12 * (m12 * m33 - m23 * m13) + m13 * (m12 * m23 - m22 * m13))"
    betas = {
        "x1,x2,x3": (f"(m1y * (m22 * m33 - m23 * m23) - m12 * (m2y * m33 - m23 * m3y) + m13 * (m2y * m23 - m22 * m3y)) / {det3}",
                     f"(m11 * (m2y * m33 - m23 * m3y) - m1y * (m12 * m33 - m23 * m13) + m13 * (m12 * m3y - m2y * m13)) / {det3}",
                     f"(m11 * (m22 * m3y - m2y * m23) - m12 * (m12 * m3y - m2y * m13) + m1y * (m12 * m23 - m22 * m13)) / {det3}")}
    for a, b in ("12", "13", "23"):
        det = f"(m{a}{a} * m{b}{b} - m{a}{b} * m{a}{b})"
        own = {a: f"(m{a}y * m{b}{b} - m{a}{b} * m{b}y) / {det}", b: f"(m{b}y * m{a}{a} - m{a}{b} * m{a}y) / {det}"}
        betas[f"x{a},x{b}"] = tuple(own.get(i, "0") for i in "123")
    for a in "123":
        betas[f"x{a}"] = tuple(f"m{a}y / m{a}{a}" if i == a else "0" for i in "123")
    models = " union all ".join(f"select g, '{k}' as kept, {b[0]} as b1, {b[1]} as b2, {b[2]} as b3, n, s1, s2, s3, sy from centred" for k, b in betas.items())
    return f"""
, moments as (select g, count(*) filter (where fit) as n, sum(y) filter (where fit) as sy, {moments} from obs group by 1),
centred as (select g, n, s1, s2, s3, sy, {centred} from moments),
models as ({models}),
scored as (select models.g, kept, len(string_split(kept, ',')) as k, sqrt(avg(pow(y - ((sy - b1 * s1 - b2 * s2 - b3 * s3) / n + b1 * x1 + b2 * x2 + b3 * x3), 2))) as score
  from models join obs on obs.g = models.g and not fit group by 1, 2),
r0 as (select g, score, kept from scored where k = 3),
r1 as (select g, min(score) as score, min_by(kept, score) as kept from scored where k = 2 group by 1),
r1k as (select r1.* from r1 join r0 using (g) where r1.score < r0.score),
r2 as (select r1k.g, min(s.score) as score, min_by(s.kept, s.score) as kept, any_value(r1k.score) as before, any_value(r1k.kept) as had from r1k join scored s on s.g = r1k.g and s.k = 1 and contains(r1k.kept, s.kept) group by 1),
way as (select g, 0 as round, null as removed, score, kept from r0
  union all select r1k.g, 1, case when not contains(r1k.kept, 'x1') then 'x1' when not contains(r1k.kept, 'x2') then 'x2' else 'x3' end, r1k.score, r1k.kept from r1k
  union all select g, 2, trim(replace(had, kept, ''), ','), score, kept from r2 where score < before)
select g, round::int as round, removed, {q6('score')} as score, kept from way"""


_REMOVAL = """
, obs as (select indicator as g, day < date '1997-01-01' as fit, sum(amount)::double / 1e5 as y, day(day)::double / 10 as x1, avg(o_custkey % 100)::double / 10 as x2, count(*)::double as x3 from orders_day group by indicator, day)"""


@query("n10_backward_removal", ctes("orders_day") + _REMOVAL + _removal_sql())
def _(t):
    n = F.count(F.lit(1))
    obs = c.orders_day(t).groupBy(F.col("indicator").alias("g"), "day").agg(
        (F.sum("amount").cast("double") / 1e5).alias("y"), (F.dayofmonth("day") / 10).alias("x1"), (F.avg(F.col("o_custkey") % 100) / 10).alias("x2"), n.cast("double").alias("x3"))
    rounds = fc.backward_removal(obs, ["g"], "y", ["x1", "x2", "x3"], F.col("day") < D("1997-01-01"))
    return rounds.withColumn("score", r6("score")).withColumn("kept", F.array_join("kept", ","))


_FACTORS = """
, f as (select period, max(qty) filter (where indicator = 'AF') / 1000 as f1, max(qty) filter (where indicator = 'RO') / 1000 as f2 from flag_month group by 1),
y as (select indicator, period, value / 1000 as y from customer_month)"""


def factor_inputs(t):
    f = c.flag_month(t).groupBy("period").agg(*[(F.max(F.when(F.col("indicator") == i, F.col("qty"))) / 1000).alias(n) for i, n in (("AF", "f1"), ("RO", "f2"))])
    return c.customer_month(t).select("indicator", "period", (F.col("value") / 1000).alias("y")), f


@query("n11_factor_loadings", ctes("flag_month", "customer_month") + _FACTORS + f"""
, s as (select indicator, count(*) as n, sum(f1 * f1) as a, sum(f1 * f2) as b, sum(f2 * f2) as c, sum(f1 * y) as p, sum(f2 * y) as q from y join f using (period) where f1 is not null and f2 is not null group by 1)
select indicator, 'f1' as factor, case when n >= 4 then {q6('(c * p - b * q) / (a * c - b * b)', 4)} end as loading, n from s union all select indicator, 'f2', case when n >= 4 then {q6('(a * q - b * p) / (a * c - b * b)', 4)} end, n from s""")
def _(t):
    y, f = factor_inputs(t)
    return fa.loadings(y, f, "period", "indicator", "y", ["f1", "f2"]).withColumn("loading", r6("loading", 4))


@query("n12_factor_variance", None)
def _(t):
    v = fa.component_variance(t.embeddings, "embedding", F.col("vec_id") % 5 != 0)
    return fa.factor_counts(v, cumulative=0.5, elbow=0.1).withColumn("vectors", t.embeddings.agg(F.count(F.lit(1)).alias("n")).scalar())


_ORDER_DAYS = """
, obs as (select day, sum(amount)::double / 1e5 as x1, count(*)::double as x2, avg(o_custkey % 100)::double as x3 from orders_day where day < date '1997-01-01' group by day),
r as (select corr(x1, x2) as a, corr(x1, x3) as b, corr(x2, x3) as c from obs),
-- eigenvalues of a symmetric matrix of three variables with a unit diagonal
q as (select sqrt((a * a + b * b + c * c) / 3) as p, a * b * c as d from r),
f as (select p, acos(greatest(-1, least(1, d / pow(p, 3)))) / 3 as phi from q),
e as (select 1 + 2 * p * cos(phi) as v1, 1 + 2 * p * cos(phi + 2 * pi() / 3) as v3 from f),
v as (select unnest([1, 2, 3])::int as component, unnest([v1, 3 - v1 - v3, v3]) as eigenvalue from e)"""


def order_components(t):
    days = c.orders_day(t).groupBy("day").agg(
        F.array((F.sum("amount").cast("double") / 1e5), F.count(F.lit(1)).cast("double"), F.avg(F.col("o_custkey") % 100)).alias("x"))
    return fa.component_variance(days, "x", F.col("day") < D("1997-01-01"))


@query("n12_components", ctes("orders_day") + _ORDER_DAYS + f"""
select component, {q6('eigenvalue')} as eigenvalue, {q6('eigenvalue / 3')} as share from v""")
def _(t):
    return order_components(t).select("component", r6("eigenvalue").alias("eigenvalue"), r6("share").alias("share"))


@query("n12_factor_counts", ctes("orders_day") + _ORDER_DAYS + """
, w as (select component, eigenvalue, sum(eigenvalue / 3) over (order by component) as reached, (eigenvalue - lag(eigenvalue) over (order by component)) / 3 as step from v)
select 'fixed' as method, 2 as factors union all
select 'cumulative', greatest(1, least(min(component) filter (where reached >= 0.9), 2)) from w union all
select 'elbow', case when count(*) filter (where step < -0.2) > 0 then greatest(1, least(min(component - 1) filter (where step < -0.2), 2)) end from w union all
select 'kaiser', case when count(*) filter (where eigenvalue > 0.9) > 0 then greatest(1, least(count(*) filter (where eigenvalue > 0.9), 2)) end::int from w""")
def _(t):
    return fa.factor_counts(order_components(t), cumulative=0.9, elbow=-0.2, kaiser=0.9)


_NEWS = """
, rel as (select o_orderkey as release_id, 'C' || o_custkey as variable, day as ts, amount::double / 1000 as observed from orders_day),
pred as (select indicator as variable, period as ts, value / 1000 as expected from customer_month),
gain as (select 'C' || c_custkey as variable, period as ts, k as factor, ((c_custkey % 7) + k * 0.1 + month(period) * 0.01)::double as gain from customer, (select distinct date_trunc('quarter', period)::date as period from priority_month), (values (1), (2)) v(k)),
lam as (select 1 as factor, 0.6::double as loading union all select 2, -0.2::double),
e as (select rel.*, p.expected, (select max(ts) from (select distinct ts from gain) g where g.ts <= rel.ts) as gts from rel asof join pred p on p.variable = rel.variable and p.ts <= rel.ts),
i as (select release_id, e.variable, e.ts, observed, expected, sum(loading * gain * (observed - expected)) * 12.5 as impact, sqrt(sum(gain * gain)) as gain_size from e join gain g on g.variable = e.variable and g.ts = e.gts join lam using (factor) group by 1, 2, 3, 4, 5)"""


def news(t):
    rel = c.orders_day(t).select(F.col("o_orderkey").alias("release_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("variable"), F.col("day").alias("ts"), (F.col("amount").cast("double") / 1000).alias("observed"))
    pred = c.customer_month(t).select(F.col("indicator").alias("variable"), F.col("period").alias("ts"), (F.col("value") / 1000).alias("expected"))
    edge = c.priority_month(t).agg(F.struct(F.trunc(F.min("period"), "QUARTER").alias("a"), F.trunc(F.max("period"), "QUARTER").alias("b")).alias("e")).scalar()
    gain = t.customer.withColumn("ts", F.explode(F.sequence(edge["a"], edge["b"], F.expr("interval 3 month")))).withColumn("factor", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("variable"), "ts", "factor", ((F.col("c_custkey") % 7) + F.col("factor") * 0.1 + F.month("ts") * 0.01).alias("gain"))
    lam = gain.groupBy("factor").agg(F.max(F.when(F.col("factor") == 1, 0.6).otherwise(-0.2)).alias("loading"))
    return fa.news_impacts(rel, pred, gain, lam, F.lit(12.5))


@query("n13_news_impacts", ctes("orders_day", "customer_month", "priority_month") + _NEWS + f"""
select release_id, variable, ts, {qf('impact')} as impact, {q6('gain_size')} as gain_size, {q6('abs(impact) / (select sum(abs(impact)) from i) * 100')} as share_pct, impact > 0 as is_positive from i""")
def _(t):
    out = fa.impact_shares(news(t))
    return out.select("release_id", "variable", "ts", f32("impact").alias("impact"), r6("gain_size").alias("gain_size"), r6("share_pct").alias("share_pct"), "is_positive")


@query("n14_normalised_impacts", ctes("orders_day", "customer_month", "priority_month") + _NEWS + f"""
select release_id, {q6('impact * 5.25 / (select sum(impact) from i)')} as scaled_impact from i""")
def _(t):
    return fa.normalise_impacts(news(t), F.lit(5.25)).select("release_id", r6("scaled_impact").alias("scaled_impact"))


@query("n15_reconstruction_errors", ctes("flag_month", "customer_month") + _FACTORS + f"""
, l as (select indicator, 0.4 + (substr(indicator, 2)::bigint % 5) * 0.3 as l1, 0.2 + (substr(indicator, 2)::bigint % 3) * 0.1 as l2 from (select distinct indicator from customer_month)),
r as (select indicator, case when period <= date '1998-12-31' then 'training' else 'validation' end as phase, y - (l1 * f1 + l2 * f2) as r from y join f using (period) join l using (indicator)),
e as (select indicator, sqrt(avg(r * r) filter (where phase = 'training')) as a, sqrt(avg(r * r) filter (where phase = 'validation')) as b from r group by 1)
select indicator, {qf('a')} as train_rmse, {qf('b')} as validation_rmse, {qf('coalesce(a * 0.4 + b * 0.6, a, b)')} as score from e""")
def _(t):
    y, f = factor_inputs(t)
    n = F.substring("indicator", 2, 12).cast("long")
    w = y.select("indicator").distinct().select("indicator", F.inline(F.array(F.struct(F.lit("f1").alias("factor"), (0.4 + (n % 5) * 0.3).alias("loading")), F.struct(F.lit("f2").alias("factor"), (0.2 + (n % 3) * 0.1).alias("loading")))))
    e = fa.reconstruction_errors(y, f.unpivot("period", ["f1", "f2"], "factor", "f"), w, "indicator", "period", "y", F.when(F.col("period") <= D("1998-12-31"), "training").otherwise("validation"))
    s = fa.weighted_score(e, "indicator", 0.4)
    return s.select("indicator", *[f32(x).alias(x) for x in ("train_rmse", "validation_rmse", "score")])


_SCOPES = """
with sup as (select s_suppkey, s_nationkey, n_regionkey, s_acctbal::decimal(18,2) as bal from supplier join nation on n_nationkey = s_nationkey),
mem as (select distinct 'R' || n_regionkey as scope, 'n' || s_nationkey as member from sup union select distinct 'N' || s_nationkey, 'n' || s_nationkey from sup where n_regionkey <> 4 union select distinct 'X' || (s_nationkey % 2), 'n' || s_nationkey from sup where n_regionkey = 3),
sz as (select scope, count(*) as size from mem group by 1),
amt as (select 'R' || n_regionkey as scope, sum(bal) as amount from sup group by 1 union all select 'N' || s_nationkey, sum(bal) from sup where n_regionkey <> 4 group by 1 union all select 'X' || (s_nationkey % 2), sum(bal) from sup where n_regionkey = 3 group by 1),
pr as (select x.scope as a, y.scope as b, sx.size as na, sy.size as nb, count(*) as ov from mem x join mem y using (member) join sz sx on sx.scope = x.scope join sz sy on sy.scope = y.scope where sx.size < sy.size or (sx.size = sy.size and x.scope < y.scope) group by 1, 2, 3, 4),
bad as (select a as scope from pr where ov < na or na = nb union select b from pr where ov < na or na = nb),
ok as (select scope from amt where scope not in (select scope from bad)),
nest as (select a as part, b as whole from pr where ov = na and na < nb and a in (select scope from ok) and b in (select scope from ok)),
cov as (select whole, count(distinct member) as covered from nest join mem on mem.scope = part where whole in ('R0', 'R2', 'R4') group by 1),
spl as (select whole as scope from cov join sz on sz.scope = whole where covered = size),
ins as (select distinct part as scope from nest where whole not in (select scope from spl))"""


def scope_rows(t):
    sup = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_nationkey", "n_regionkey", F.col("s_acctbal").cast("decimal(18,2)").alias("bal"))
    scope = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string") if isinstance(k, str) else k.cast("string"))
    frames = [sup.withColumn("scope", scope("R", "n_regionkey")), sup.where("n_regionkey <> 4").withColumn("scope", scope("N", "s_nationkey")), sup.where("n_regionkey = 3").withColumn("scope", scope("X", F.col("s_nationkey") % 2))]
    u = frames[0].unionByName(frames[1]).unionByName(frames[2])
    members = u.select("scope", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("member")).distinct()
    rows = u.groupBy("scope").agg(F.sum("bal").alias("amount")).select(
        "scope", F.lit(2).alias("basis_rank"), F.lit("whole").alias("basis"), F.lit("1999").alias("period"), D("1999-12-31").alias("end_day"), F.lit(False).alias("estimated"), "amount",
        F.col("scope").isin("R0", "R2", "R4").alias("complete"), F.lit("barrels").alias("unit"))
    return rows, members


@query("n16_scope_selection", _SCOPES + """
select scope, amount::double as amount, case when scope in (select scope from bad) then 'crossing' when scope in (select scope from ins) then 'contained' when scope in (select scope from spl) then 'split' else 'chosen' end as status from amt""")
def _(t):
    rows, members = scope_rows(t)
    return sc.select_scopes(sc.scope_winners(rows), members).select("scope", F.col("amount").cast("double").alias("amount"), "status")


@query("n16_scope_total", _SCOPES + """
select sum(amount)::double as total, count(*) as scopes from amt where scope not in (select scope from bad) and scope not in (select scope from ins) and scope not in (select scope from spl)""")
def _(t):
    rows, members = scope_rows(t)
    out = sc.total_scopes(sc.select_scopes(sc.scope_winners(rows), members), "1999", "whole")
    return out.select(F.col("total").cast("double").alias("total"), "scopes")


@query("n17_hurst_exponent", ctes("flag_day") + """
, ix as (select indicator, value, row_number() over (partition by indicator order by period) - 1 as i, count(*) over (partition by indicator) as n from flag_day),
r as (select indicator, n, size, i // size as block, i, value from ix, (select (2 ** p)::bigint as size from generate_series(3, 20) g(p)) where size * 2 <= n and (i // size + 1) * size <= n),
d as (select indicator, n, size, block, sum(value - m) over (partition by indicator, size, block order by i) as c, sd from (select *, avg(value) over (partition by indicator, size, block) as m, stddev_pop(value) over (partition by indicator, size, block) as sd from r)),
b as (select indicator, n, size, block, (max(c) - min(c)) / nullif(max(sd), 0) as rs from d group by 1, 2, 3, 4), m as (select indicator, n, size, avg(rs) as rs from b where rs > 0 group by 1, 2, 3)
select indicator as series, n as valid, """ + q6("regr_slope(ln(rs), ln(size))", 4) + """ as hurst from m group by 1, 2""")
def _(t):
    return st.hurst_exponent(SERIES(c.flag_day(t)))


@query("n18_asset_card", """
with r as (select 'N' || s_nationkey as scope, case when s_suppkey % 2 = 0 then 'oil' else 'gas' end as product, round(s_acctbal, -3) as amount, 1990 + (s_suppkey % 9)::int as year from supplier),
o as (select scope, product, max(amount) as amount, max(year) as year, min(amount) <> max(amount) as c from r group by 1, 2)
select product, sum(amount) as total, count(amount) as summed, count(*) as records, min(year) as first_year, max(year) as last_year, bool_or(c) as conflict from o group by 1""")
def _(t):
    s = t.supplier
    r = s.select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("scope"), F.when(F.col("s_suppkey") % 2 == 0, "oil").otherwise("gas").alias("product"),
                 F.round("s_acctbal", -3).alias("amount"), (1990 + F.col("s_suppkey") % 9).cast("int").alias("year"))
    return sc.asset_card(r)


@query("n18_producing_share", """
with r as (select c_nationkey as scope, case when c_custkey % 97 = 0 then 'unknown' when c_mktsegment = 'MACHINERY' and c_nationkey < 5 then 'shut' else 'producing' end as state from customer),
p as (select scope, count(distinct state) as k, min(state) as s, count(*) filter (where state in ('unknown', 'historical_unverified')) as u from r group by 1)
select count(*) as scopes, """ + q6("count(*) filter (where k = 1 and s = 'producing') / count(*) * 100") + " as producing_pct, " + q6("count(*) filter (where k <> 1 or u > 0) / count(*) * 100") + " as pending_pct from p")
def _(t):
    r = t.customer.select(F.col("c_nationkey").alias("scope"), F.when(F.col("c_custkey") % 97 == 0, "unknown").when((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") < 5), "shut").otherwise("producing").alias("state"))
    return sc.producing_share(r).withColumn("producing_pct", r6("producing_pct")).withColumn("pending_pct", r6("pending_pct"))


@query("x03_model_adapter", ctes("priority_month") + f"""
, ix as (select indicator as series, period as ts, value, row_number() over (partition by indicator order by period) as i from priority_month),
o as (select a.series, a.i as origin, h::int as horizon, b.value as actual from (select *, unnest(generate_series(1, 3)) as h from ix where i >= 60) a join ix b on b.series = a.series and b.i = a.i + h)
select o.series, origin::int as origin, horizon, actual, (select {qf('avg(value)')} from ix m where m.series = o.series and m.i between o.origin - 11 and o.origin) as predicted, 'mean_12' as model from o""")
def _(t):
    s = SERIES(c.priority_month(t))
    frame = fc.origins(s, 60, 3)
    out = fc.adapter_backtest(frame, s, lambda h, steps: [float(h["value"].tail(12).mean())] * steps, "mean_12")
    return out.select("series", "origin", "horizon", "actual", f32("predicted").alias("predicted"), "model")


@query("x02_series_callback", ctes("flag_month") + f"""
select indicator as series, count(*) as n, {qf('max(value) - min(value)')} as span from flag_month group by 1""")
def _(t):
    from periodica.plans.hooks import apply_per_series

    def span(pdf):
        import pandas as pd

        return pd.DataFrame({"n": [len(pdf)], "span": [pdf["value"].max() - pdf["value"].min()]})

    return apply_per_series(SERIES(c.flag_month(t)), span, "n long, span double").withColumn("span", f32("span"))


@query("x04_step_generators", ctes("priority_month") + """
select indicator, max(period) as origin, h::int as horizon, last_day((date_trunc('month', max(period)) + to_months(h::int))::date) as period from priority_month, generate_series(1, 12) g(h) group by 1, 3""")
def _(t):
    from periodica.plans.hooks import steps_ahead

    last = c.priority_month(t).groupBy("indicator").agg(F.max("period").alias("origin"))
    return last.select("indicator", "origin", steps_ahead(12).alias("horizon")).withColumn("period", F.last_day(F.add_months("origin", F.col("horizon"))))


@query("x01_column_surface", ctes("flag_day", "line_bounds") + f"""
, m as (select indicator, last_day(period) as period, case when count(*) = day(last_day(min(period))) and count(qty) = count(*) then sum(qty) end as total from flag_day where period <= (select cutoff from line_bounds) group by 1, 2)
select a.indicator, a.period, a.total, b.total as prior from m a left join m b on b.indicator = a.indicator and year(b.period) * 12 + month(b.period) = year(a.period) * 12 + month(a.period) - 12""")
def _(t):
    from periodica.functions.measures import complete_sum
    from periodica.operators.spine import calendar_lag, complete_months

    days = complete_months(c.flag_day(t), "period")
    n = F.dayofmonth(F.last_day(F.min("period")))
    m = days.groupBy("indicator", F.last_day("period").alias("period")).agg(complete_sum("qty", n).alias("total"))
    return m.select("indicator", "period", "total", calendar_lag(["indicator"], "period", "total", 12).alias("prior"))
