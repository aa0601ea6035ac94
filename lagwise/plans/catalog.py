"""Registered queries of the regression engine over the event stream, with the SQL that says the same.

The signal is the stream on a ten-minute grid from 2024-01-01 (4,320 samples): cents for each sample. Events are purchases and errors, with
latency in samples, value and k (from props) as predictors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.functions import basis as bases
from lagwise.functions.formula import Schema
from lagwise.operators import design as dm
from lagwise.operators import epochs as ep
from lagwise.operators import events as ev
from lagwise.operators import predict as pr
from lagwise.operators import solve as sv
from lagwise.session import ship
from lagwise.sources import signal as sg

START, STEP, SAMPLES = 1704067200000000, 600000000, 4320
KINDS = ("click", "error", "purchase", "signup", "view")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _signal(spark, sf_dir, fill: bool = True, multi: bool = False) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    code = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")).cast("int") if multi else None
    return sg.gridded(rows, "ts", F.round(F.col("value") * 100).cast("long"), START, STEP, SAMPLES, code, fill)


def _events(spark, sf_dir, *kinds: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").where(F.col("event_type").isin(*(kinds or KINDS)))
    at = (F.expr("unix_micros(cast(ts as timestamp))") - F.lit(START)) / F.lit(float(STEP)) + 1
    return rows.select(F.col("event_id").alias("event_ix"), at.alias("latency"), F.col("event_type").alias("event"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def _sampled(events: DataFrame) -> DataFrame:
    return events.withColumn("latency", F.floor("latency").cast("double"))


# The SQL of the inputs.
_CTE = f"""
g AS (SELECT (epoch_us(ts)-{START})//{STEP}+1 AS sample, event_type, CAST(round(value*100) AS BIGINT) AS cents FROM events),
sums AS (SELECT sample, CAST(sum(cents) AS DOUBLE) AS y FROM g GROUP BY 1),
grid AS (SELECT CAST(range AS BIGINT) AS sample FROM range(1, {SAMPLES + 1})),
sig AS (SELECT grid.sample, coalesce(y, 0.0) AS y FROM grid LEFT JOIN sums USING (sample)),
raw AS (SELECT grid.sample, y FROM grid LEFT JOIN sums USING (sample)),
ev AS (SELECT event_id AS event_ix, (epoch_us(ts)-{START})/CAST({STEP} AS DOUBLE)+1 AS latency, event_type AS event, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
"""
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, plain: bool = False):
    """Registers a function under its name, with its SQL after the inputs' common table expressions."""

    def of(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if plain else f"WITH RECURSIVE {_CTE} {sql}"
        return f

    return of


@query("SELECT 1 AS channel, sample, y FROM sig")
def signal_grid(spark, sf_dir):
    return _signal(spark, sf_dir)


@query(f""", codes AS (SELECT unnest(range(1, 6)) AS channel), m AS (SELECT list_position({list(KINDS)}, event_type) AS channel, sample, CAST(sum(cents) AS DOUBLE) AS y FROM g GROUP BY 1, 2)
SELECT CAST(channel AS INTEGER) AS channel, sample, y FROM codes CROSS JOIN grid LEFT JOIN m USING (channel, sample)""")
def signal_multichannel(spark, sf_dir):
    return _signal(spark, sf_dir, fill=False, multi=True)


@query("SELECT event_ix, round(latency, 6) AS latency, value FROM ev WHERE event = 'purchase'")
def event_filter(spark, sf_dir):
    return ev.filter_events(_events(spark, sf_dir), "purchase").select("event_ix", F.round("latency", 6).alias("latency"), "value")


def _copied(spark, sf_dir, how):
    out = ev.copy_eventinfo(_events(spark, sf_dir, "purchase", "error"), "error", "purchase", "value", "near_value", search=how)
    return out.select("event_ix", "event", F.round("near_value", 6).alias("near_value"))


_NEAR = """, s AS (SELECT * FROM ev WHERE event='error'), t AS (SELECT * FROM ev WHERE event='purchase'),
b AS (SELECT s.event_ix AS si, s.latency AS sl, s.value, t.event_ix AS bi, t.latency AS bl FROM s ASOF LEFT JOIN t ON s.latency >= t.latency),
c AS (SELECT b.*, t.event_ix AS fi, t.latency AS fl FROM b ASOF LEFT JOIN t ON b.sl <= t.latency),
p AS (SELECT si, sl, value, {pick} AS event_ix FROM c),
w AS (SELECT event_ix, arg_max(value, sl) AS near_value FROM p WHERE event_ix IS NOT NULL GROUP BY 1)
SELECT event_ix, event, round(near_value, 6) AS near_value FROM ev LEFT JOIN w USING (event_ix) WHERE event IN ('purchase','error')"""


@query(_NEAR.format(pick="bi"))
def copy_backward(spark, sf_dir):
    return _copied(spark, sf_dir, "backward")


@query(_NEAR.format(pick="fi"))
def copy_forward(spark, sf_dir):
    return _copied(spark, sf_dir, "forward")


@query(_NEAR.format(pick="CASE WHEN bi IS NULL THEN fi WHEN fi IS NULL THEN bi WHEN sl-bl<fl-sl THEN bi WHEN fl-sl<sl-bl THEN fi ELSE least(bi,fi) END"))
def copy_closest(spark, sf_dir):
    return _copied(spark, sf_dir, "closest")


_IN_GROUP = _NEAR.replace("s.latency >= t.latency", "s.k = t.k AND s.latency >= t.latency").replace("b.sl <= t.latency", "b.k = t.k AND b.sl <= t.latency").replace("s.latency AS sl,", "s.latency AS sl, s.k,")


@query(_IN_GROUP.format(pick="CASE WHEN bi IS NULL THEN fi WHEN fi IS NULL THEN bi WHEN sl-bl<fl-sl THEN bi WHEN fl-sl<sl-bl THEN fi ELSE least(bi,fi) END"))
def copy_closest_grouped(spark, sf_dir):
    """The closest purchase of the same k."""
    out = ev.copy_eventinfo(_events(spark, sf_dir, "purchase", "error"), "error", "purchase", "value", "near_value", group="k")
    return out.select("event_ix", "event", F.round("near_value", 6).alias("near_value"))


_EPOCH = """, e AS (SELECT event_ix, CAST(round_even(latency, 0) AS BIGINT) AS pos, event, value FROM ev WHERE event IN ({kinds})), k AS (SELECT CAST(range AS BIGINT) AS k FROM range(-2, 6)),
ep AS (SELECT 1 AS channel, event_ix, event, value, CAST(k+2 AS INTEGER) AS time_ix, k/1.0 AS time, y FROM e CROSS JOIN k LEFT JOIN {source} ON sample = pos + k)"""


def _epochs(spark, sf_dir, *kinds, fill=True):
    return ep.epoch(_signal(spark, sf_dir, fill), _events(spark, sf_dir, *kinds), (-2.0, 5.0), 1.0)


@query(_EPOCH.format(kinds="'purchase'", source="sig") + " SELECT channel, event_ix, time_ix, CAST(time AS DOUBLE) AS time, y FROM ep")
def epoch_long(spark, sf_dir):
    return _epochs(spark, sf_dir, "purchase")


@query(_EPOCH.format(kinds="'purchase','signup'", source="raw") + " SELECT time_ix, count(*) AS n, CAST(count(*)-count(y) AS BIGINT) AS missing FROM ep GROUP BY 1")
def epoch_edges_null(spark, sf_dir):
    return _epochs(spark, sf_dir, "purchase", "signup", fill=False).groupBy("time_ix").agg(F.count("*").alias("n"), F.count_if(F.col("y").isNull()).alias("missing"))


@query(_EPOCH.format(kinds="'purchase'", source="raw") + " SELECT event_ix, time_ix, y FROM ep WHERE event_ix NOT IN (SELECT event_ix FROM ep WHERE y IS NULL)")
def drop_missing_epochs(spark, sf_dir):
    return ep.drop_missing_epochs(_epochs(spark, sf_dir, "purchase", fill=False)).select("event_ix", "time_ix", "y")


@query(", w AS (SELECT CAST(floor(latency) AS BIGINT) AS a FROM ev WHERE event='error' AND value > 90) SELECT sample, CASE WHEN EXISTS (SELECT 1 FROM w WHERE sample BETWEEN a AND a+3) THEN NULL ELSE y END AS y FROM sig")
def clean_data(spark, sf_dir):
    w = _events(spark, sf_dir, "error").where("value > 90").select(F.floor("latency").cast("long").alias("first"), (F.floor("latency").cast("long") + 3).alias("last"))
    return ep.clean_data(_signal(spark, sf_dir), w).select("sample", "y")


@query(_EPOCH.format(kinds="'purchase'", source="sig") + " SELECT time_ix, round(avg(y), 4) AS estimate, count(y) AS n FROM ep GROUP BY 1")
def erp_average(spark, sf_dir):
    return ep.average(_epochs(spark, sf_dir, "purchase")).select("time_ix", F.round("estimate", 4).alias("estimate"), "n")


@query(_EPOCH.format(kinds="'purchase','error'", source="sig") + " SELECT event, time_ix, round(avg(y), 4) AS estimate, count(y) AS n FROM ep GROUP BY 1, 2")
def erp_by_condition(spark, sf_dir):
    e = _events(spark, sf_dir, "purchase", "error").select("event_ix", "event")
    return ep.average(_epochs(spark, sf_dir, "purchase", "error").join(e, "event_ix"), "event").select("event", "time_ix", F.round("estimate", 4).alias("estimate"), "n")


def _coded(spark, sf_dir, formula, contrasts=None):
    e = _events(spark, sf_dir)
    s = Schema.fit(formula, e, contrasts)
    return s.design(e).select("event_ix", *[F.round(F.get("x", F.lit(i)), 6).alias(f"x{i}") for i in range(len(s.names()))])


_IS = {k: f"CASE WHEN event='{k}' THEN 1.0 ELSE 0.0 END" for k in KINDS}


@query("SELECT event_ix, CAST(1.0 AS DOUBLE) AS x0, " + ", ".join(f"CAST({_IS[k]} AS DOUBLE) AS x{i}" for i, k in enumerate(KINDS) if i) + ", round(value, 6) AS x5 FROM ev")
def dummy_coding(spark, sf_dir):
    return _coded(spark, sf_dir, "0 ~ 1 + event + value")


@query("SELECT event_ix, CAST(1.0 AS DOUBLE) AS x0, " + ", ".join(f"CAST(CASE WHEN event='{k}' THEN 1.0 WHEN event='click' THEN -1.0 ELSE 0.0 END AS DOUBLE) AS x{i}" for i, k in enumerate(KINDS) if i) + " FROM ev")
def effects_coding(spark, sf_dir):
    return _coded(spark, sf_dir, "0 ~ 1 + event", {"event": "effects"})


@query("SELECT event_ix, CAST(1.0 AS DOUBLE) AS x0, " + ", ".join(f"CAST(CASE WHEN event='{k}' THEN {i}.0 WHEN event IN ({', '.join(repr(x) for x in KINDS[:i])}) THEN -1.0 ELSE 0.0 END AS DOUBLE) AS x{i}" for i, k in enumerate(KINDS) if i) + " FROM ev")
def helmert_coding(spark, sf_dir):
    return _coded(spark, sf_dir, "0 ~ 1 + event", {"event": "helmert"})


@query("SELECT event_ix, CAST(1.0 AS DOUBLE) AS x0, CAST(CASE event WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 1.0 WHEN 'error' THEN -2.0 ELSE 0.0 END AS DOUBLE) AS x1 FROM ev")
def own_coding(spark, sf_dir):
    return _coded(spark, sf_dir, "0 ~ 1 + event", {"event": {"good": {"click": 0, "error": -2, "purchase": 1, "signup": 1, "view": 0}}})


@query("SELECT event_ix, " + ", ".join(f"CAST({_IS[k]} AS DOUBLE) AS x{i}" for i, k in enumerate(KINDS)) + " FROM ev")
def full_coding(spark, sf_dir):
    return _coded(spark, sf_dir, "0 ~ 0 + event")


@query("SELECT event_ix, CAST(1.0 AS DOUBLE) AS x0, " + ", ".join(f"CAST({_IS[k]} AS DOUBLE) AS x{i}" for i, k in enumerate(KINDS) if i) + ", k AS x5, " + ", ".join(f"CAST({_IS[k]} * k AS DOUBLE) AS x{i + 5}" for i, k in enumerate(KINDS) if i) + " FROM ev")
def interaction_cols(spark, sf_dir):
    return _coded(spark, sf_dir, "0 ~ 1 + event * k")


@query("SELECT event_ix, CAST(1.0 AS DOUBLE) AS x0, round(value, 6) AS x1, round(value*value, 6) AS x2, round(ln(value+1), 6) AS x3 FROM ev")
def poly_cols(spark, sf_dir):
    return _coded(spark, sf_dir, "0 ~ 1 + value + value^2 + log(value + 1)")


def _fir(spark, sf_dir, kind="purchase", formula="0 ~ 1", fractional=False, **options):
    e = _events(spark, sf_dir)
    e = (e if fractional else _sampled(e)).withColumn("duration", F.col("k") % 5 + 1)
    return dm.entries([(kind, (formula, bases.fir((-1.0, 3.0), 1.0, **options)))], e)[0], e


def _long(x: DataFrame) -> DataFrame:
    return x.select("sample", "col_ix", F.round("x", 6).alias("x"))


@query(", c AS (SELECT CAST(range AS INTEGER) AS c FROM range(0, 5)) SELECT CAST(floor(latency) AS BIGINT)-1+c AS sample, c AS col_ix, round(CAST(count(*) AS DOUBLE), 6) AS x FROM ev CROSS JOIN c WHERE event='purchase' AND CAST(floor(latency) AS BIGINT)-1+c >= 1 GROUP BY 1, 2")
def fir_expand(spark, sf_dir):
    e, rows = _fir(spark, sf_dir)
    return _long(dm.expanded_design([e], rows))


@query(""", c AS (SELECT CAST(range AS INTEGER) AS c FROM range(0, 5)), x AS (SELECT CAST(floor(latency) AS BIGINT)-1+c AS sample, c AS col_ix, 1-(latency-floor(latency)) AS w FROM ev CROSS JOIN c WHERE event='purchase'
UNION ALL SELECT CAST(floor(latency) AS BIGINT)+c, c, latency-floor(latency) FROM ev CROSS JOIN c WHERE event='purchase') SELECT sample, col_ix, round(sum(w), 6) AS x FROM x WHERE sample >= 1 GROUP BY 1, 2 HAVING sum(w) <> 0""")
def fir_interpolated(spark, sf_dir):
    e, rows = _fir(spark, sf_dir, fractional=True, interpolate=True)
    return _long(dm.expanded_design([e], rows))


@query(""", c AS (SELECT CAST(range AS INTEGER) AS c FROM range(0, 5)), d AS (SELECT range AS d FROM range(0, 5)) SELECT CAST(floor(latency) AS BIGINT)-1+c+d AS sample, c AS col_ix, CAST(count(*) AS DOUBLE) AS x
FROM ev CROSS JOIN c CROSS JOIN d WHERE event='purchase' AND d < k % 5 + 1 AND CAST(floor(latency) AS BIGINT)-1+c+d >= 1 GROUP BY 1, 2""")
def fir_block_duration(spark, sf_dir):
    e, rows = _fir(spark, sf_dir, scale="block")
    return _long(dm.expanded_design([e], rows, duration="duration"))


@query(""", s AS (SELECT CAST(floor(latency) AS BIGINT) AS l, CAST(ceil(k % 5 + 1) AS BIGINT) AS d FROM ev WHERE event='purchase'), r AS (SELECT l, d, CAST(range AS BIGINT) AS row FROM s CROSS JOIN range(0, 5) WHERE range < d),
a AS (SELECT l, row, greatest(0.0, least(4.0, (row + 0.5) * 5.0 / d - 0.5)) AS pos FROM r), w AS (SELECT l - 1 + row AS sample, CAST(floor(pos) AS INTEGER) AS col_ix, 1 - (pos - floor(pos)) AS w FROM a
UNION ALL SELECT l - 1 + row, CAST(least(floor(pos) + 1, 4) AS INTEGER), pos - floor(pos) FROM a) SELECT sample, col_ix, round(sum(w), 6) AS x FROM w WHERE sample >= 1 AND w <> 0 GROUP BY 1, 2 HAVING sum(w) <> 0""")
def fir_stretched(spark, sf_dir):
    e, rows = _fir(spark, sf_dir, scale="linear")
    return _long(dm.expanded_design([e], rows, duration="duration"))


# The grid has 1/16 second steps (TR 2, 32 steps) up to 32 seconds and the duration; H sums the density up to a step.
_HRF = """, u AS (SELECT CAST(range AS BIGINT) AS i FROM range(0, CAST(ceil(33.0/0.0625) AS BIGINT) + 1)), h AS (SELECT i, CASE WHEN i > 0 THEN exp(5*ln(i) - i/16.0 - lgamma(6.0) - 6*ln(16.0)) - exp(15*ln(i) - i/16.0 - lgamma(16.0) - 16*ln(16.0))/6 ELSE 0.0 END AS h FROM u),
cum AS (SELECT i, sum(h) OVER (ORDER BY i) / (SELECT sum(h) FROM h) AS s FROM h), p AS (SELECT CAST(floor(latency) AS BIGINT) AS l, CAST(round_even((1 - (latency - floor(latency))) * 32, 0) AS BIGINT) AS z FROM ev WHERE event='purchase'),
r AS (SELECT l, z, CAST(range AS BIGINT) AS row FROM p CROSS JOIN range(0, 18)),
w AS (SELECT l + row AS sample, coalesce(a.s, CASE WHEN row*32 - z >= 0 THEN 1.0 ELSE 0.0 END) - coalesce(b.s, CASE WHEN row*32 - z - 32 >= 0 THEN 1.0 ELSE 0.0 END) AS w FROM r LEFT JOIN cum a ON a.i = row*32 - z LEFT JOIN cum b ON b.i = row*32 - z - 32)
SELECT sample, CAST(0 AS INTEGER) AS col_ix, round(sum(w), 5) AS x FROM w WHERE sample >= 1 AND w <> 0 GROUP BY 1 HAVING sum(w) <> 0"""


@query(_HRF)
def hrf_kernel(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("duration", F.lit(1.0))
    entry = dm.entries([("purchase", ("0 ~ 1", bases.hrfbasis(2.0)))], e)[0]
    return dm.expanded_design([entry], e, duration="duration").select("sample", "col_ix", F.round("x", 5).alias("x"))


def _two(spark, sf_dir):
    e = _sampled(_events(spark, sf_dir))
    return dm.entries([("purchase", ("0 ~ 1 + k", bases.fir((-1.0, 3.0), 1.0))), ("error", ("0 ~ 1", bases.fir((0.0, 2.0), 1.0)))], e), e


@query(""", c AS (SELECT CAST(range AS INTEGER) AS c FROM range(0, 5)), x AS (SELECT CAST(floor(latency) AS BIGINT)-1+c AS sample, c AS col_ix, 1.0 AS x FROM ev CROSS JOIN c WHERE event='purchase'
UNION ALL SELECT CAST(floor(latency) AS BIGINT)-1+c, c+5, k FROM ev CROSS JOIN c WHERE event='purchase' UNION ALL SELECT CAST(floor(latency) AS BIGINT)+c, c+10, 1.0 FROM ev CROSS JOIN c WHERE event='error' AND c < 3)
SELECT sample, CAST(col_ix AS INTEGER) AS col_ix, round(CAST(sum(x) AS DOUBLE), 6) AS x FROM x WHERE sample >= 1 GROUP BY 1, 2 HAVING sum(x) <> 0""")
def multi_event_design(spark, sf_dir):
    all_, e = _two(spark, sf_dir)
    return _long(dm.expanded_design(all_, e))


_X = """, c AS (SELECT CAST(range AS INTEGER) AS c FROM range(0, 5)), x AS (SELECT CAST(floor(latency) AS BIGINT)-1+c AS sample, c AS col_ix, CAST(count(*) AS DOUBLE) AS x FROM ev CROSS JOIN c
WHERE event='purchase' AND CAST(floor(latency) AS BIGINT)-1+c BETWEEN 1 AND 4320 GROUP BY 1, 2)"""


@query(_X + " SELECT a.col_ix AS i, b.col_ix AS j, sum(a.x*b.x) AS g FROM x a JOIN x b USING (sample) WHERE a.col_ix <= b.col_ix GROUP BY 1, 2")
def gram_fir(spark, sf_dir):
    e, rows = _fir(spark, sf_dir)
    return dm.gram(dm.expanded_design([e], rows).where(F.col("sample") <= SAMPLES))


@query(_X + " SELECT a.col_ix AS i, b.col_ix AS j, sum(a.x*b.x) AS g FROM x a JOIN x b USING (sample) WHERE a.col_ix <= b.col_ix GROUP BY 1, 2")
def gram_lagjoin(spark, sf_dir):
    e, rows = _fir(spark, sf_dir)
    return dm.gram_lagged(e, rows, SAMPLES)


@query(_X + " SELECT 1 AS channel, col_ix, sum(x*y) AS r FROM x JOIN sig USING (sample) GROUP BY 2")
def rxy_fir(spark, sf_dir):
    e, rows = _fir(spark, sf_dir)
    return dm.cross(dm.expanded_design([e], rows), _signal(spark, sf_dir))


@query(f"""{_X}, m AS (SELECT list_position({list(KINDS)}, event_type) AS channel, sample, CAST(sum(cents) AS DOUBLE) AS y FROM g GROUP BY 1, 2)
SELECT CAST(channel AS INTEGER) AS channel, col_ix, sum(x*y) AS r FROM x JOIN m USING (sample) GROUP BY 1, 2""")
def rxy_multichannel(spark, sf_dir):
    """A channel for each kind; samples that a channel lacks are left out of its sums."""
    e, rows = _fir(spark, sf_dir)
    return dm.cross(dm.expanded_design([e], rows), _signal(spark, sf_dir, fill=False, multi=True))


def _mu(spark, sf_dir, formula="0 ~ 1 + value", **options):
    e = _events(spark, sf_dir, "purchase")
    return sv.fit([("purchase", (formula, ep.lags((-2.0, 5.0), 1.0)))], e, ep.epoch(_signal(spark, sf_dir), e, (-2.0, 5.0), 1.0), **options)


# Epochs that reach beyond the signal are left out before anything is fitted.
_MU = _EPOCH.format(kinds="'purchase'", source="sig") + ", full_ AS (SELECT * FROM ep WHERE event_ix NOT IN (SELECT event_ix FROM ep WHERE y IS NULL)), fit AS (SELECT time_ix, regr_slope(y, value) AS b, regr_intercept(y, value) AS a, count(*) AS n, regr_sxx(y, value) AS sxx, avg(value) AS m FROM full_ GROUP BY 1)"


@query(_MU + " SELECT time_ix, '(Intercept)' AS coefname, round(a, 3) AS estimate FROM fit UNION ALL SELECT time_ix, 'value', round(b, 3) FROM fit")
def mu_coef_simple(spark, sf_dir):
    return _mu(spark, sf_dir).coefs.select("time_ix", "coefname", F.round("estimate", 3).alias("estimate"))


@query(_MU + """ SELECT CAST(1 AS INTEGER) AS channel, coefname, 'purchase' AS eventname, 'time' AS label, CAST(time_ix - 2 AS DOUBLE) AS time, estimate, CAST(NULL AS DOUBLE) AS stderror, CAST(NULL AS VARCHAR) AS "group"
FROM (SELECT time_ix, '(Intercept)' AS coefname, round(a, 3) AS estimate FROM fit UNION ALL SELECT time_ix, 'value', round(b, 3) FROM fit)""")
def coeftable_mu(spark, sf_dir):
    return _rounded(_mu(spark, sf_dir).coeftable(), 3, "estimate")


@query(_EPOCH.format(kinds="'purchase','error'", source="sig") + """, full_ AS (SELECT * FROM ep WHERE event_ix NOT IN (SELECT event_ix FROM ep WHERE y IS NULL)), p AS (SELECT time_ix, regr_intercept(y, value) AS a, regr_slope(y, value) AS b FROM full_ WHERE event='purchase' GROUP BY 1)
SELECT 'purchase' AS event, CAST(0 AS INTEGER) AS col_ix, '(Intercept)' AS coefname, time_ix, round(a, 3) AS estimate FROM p UNION ALL SELECT 'purchase', 1, 'value', time_ix, round(b, 3) FROM p
UNION ALL SELECT 'error', 2, '(Intercept)', time_ix, round(avg(y), 3) FROM full_ WHERE event='error' GROUP BY time_ix""")
def mu_coef_two_events(spark, sf_dir):
    e, times = _events(spark, sf_dir, "purchase", "error"), ep.lags((-2.0, 5.0), 1.0)
    m = sv.fit({"purchase": ("0 ~ 1 + value", times), "error": ("0 ~ 1", times)}, e, _epochs(spark, sf_dir, "purchase", "error"))
    return m.coefs.select("event", "col_ix", "coefname", "time_ix", F.round("estimate", 3).alias("estimate"))


_RES = ", res AS (SELECT time_ix, var_samp(y - a - b*value) AS v, var_samp(y) AS vy FROM full_ JOIN fit USING (time_ix) GROUP BY 1)"


@query(_MU + _RES + " SELECT time_ix, '(Intercept)' AS coefname, round(sqrt(v*(1.0/n + m*m/sxx)), 3) AS stderror FROM fit JOIN res USING (time_ix) UNION ALL SELECT time_ix, 'value', round(sqrt(v/sxx), 3) FROM fit JOIN res USING (time_ix)")
def mu_stderr(spark, sf_dir):
    return _mu(spark, sf_dir, stderror=True).coefs.select("time_ix", "coefname", F.round("stderror", 3).alias("stderror"))


@query(_MU + " SELECT event_ix, time_ix, round(a + b*value, 2) AS yhat FROM fit CROSS JOIN (SELECT event_ix, value FROM e)")
def predict_noverlap(spark, sf_dir):
    return pr.predict(_mu(spark, sf_dir)).select("event_ix", "time_ix", F.round("yhat", 2).alias("yhat"))


@query(_MU + " SELECT event_ix, time_ix, round(y - (a + b*value), 2) AS residual FROM ep JOIN fit USING (time_ix)")
def residuals_mu(spark, sf_dir):
    e = _events(spark, sf_dir, "purchase")
    return pr.residuals(_mu(spark, sf_dir), ep.epoch(_signal(spark, sf_dir), e, (-2.0, 5.0), 1.0)).select("event_ix", "time_ix", F.round("residual", 2).alias("residual"))


@query(_MU + ", q AS (SELECT time_ix, 1 - var_samp(y - (a + b*value))/var_samp(y) AS r, count(*)-count(y) AS gone FROM ep JOIN fit USING (time_ix) GROUP BY 1) SELECT time_ix, CASE WHEN gone = 0 THEN round(r, 6) END AS r2 FROM q")
def r2_mu(spark, sf_dir):
    e = _events(spark, sf_dir, "purchase")
    return pr.r2(_mu(spark, sf_dir), ep.epoch(_signal(spark, sf_dir), e, (-2.0, 5.0), 1.0)).select("time_ix", F.round("r2", 6).alias("r2"))


def _deconvolved(spark, sf_dir, **options):
    e = _sampled(_events(spark, sf_dir, "purchase", "error"))
    return sv.fit([("purchase", ("0 ~ 1 + k", bases.fir((-1.0, 3.0), 1.0))), ("error", ("0 ~ 1", bases.fir((0.0, 2.0), 1.0)))], e, _signal(spark, sf_dir), **options)


# The 13 columns' cross products, reduced to the identity row by row with X'y and the identity beside them: b is the estimate, d the inverse's diagonal.
_CELLS = """, c AS (SELECT CAST(range AS INTEGER) AS c FROM range(0, 5)), every_ AS (SELECT event_ix, CAST(floor(latency) AS BIGINT)-1+c AS sample, c AS col, 1.0 AS x FROM ev CROSS JOIN c WHERE event='purchase'
UNION ALL SELECT event_ix, CAST(floor(latency) AS BIGINT)-1+c, c+5, k FROM ev CROSS JOIN c WHERE event='purchase' UNION ALL SELECT event_ix, CAST(floor(latency) AS BIGINT)+c, c+10, 1.0 FROM ev CROSS JOIN c WHERE event='error' AND c < 3),
x AS (SELECT sample, col, CAST(sum(x) AS DOUBLE) AS x FROM every_ WHERE sample >= 1 GROUP BY 1, 2 HAVING sum(x) <> 0)"""
_SOLVED = _CELLS + """, inside AS (SELECT * FROM x WHERE sample <= 4320),
gg AS (SELECT a.col AS i, b.col AS j, sum(a.x*b.x) AS g FROM inside a JOIN inside b USING (sample) GROUP BY 1, 2), r AS (SELECT col AS i, sum(x*y) AS r FROM inside JOIN sig USING (sample) GROUP BY 1),
n AS (SELECT CAST(range AS INTEGER) AS n FROM range(0, 13)), lines AS (SELECT a.n AS i, list_concat(list(coalesce(g, 0.0) ORDER BY b.n), [any_value(coalesce(r, 0.0))], list(CASE WHEN a.n = b.n THEN 1.0 ELSE 0.0 END ORDER BY b.n)) AS line
FROM n a CROSS JOIN n b LEFT JOIN gg ON gg.i = a.n AND gg.j = b.n LEFT JOIN r ON r.i = a.n GROUP BY 1),
reduced(k, m) AS (SELECT 0, list(CAST(line AS DOUBLE[]) ORDER BY i) FROM lines UNION ALL SELECT k+1, list_transform(m, lambda l, i: CASE WHEN i = k+1 THEN list_transform(l, lambda v: v/l[k+1]) ELSE list_transform(l, lambda v, j: v - l[k+1]*m[k+1][j]/m[k+1][k+1]) END) FROM reduced WHERE k < 13),
s AS (SELECT n AS col, m[n+1][14] AS b, m[n+1][15+n] AS d, CASE WHEN n < 5 THEN '(Intercept)' WHEN n < 10 THEN 'k' ELSE '(Intercept)' END AS coefname, CASE WHEN n < 10 THEN 'purchase' ELSE 'error' END AS eventname, CAST(CASE WHEN n < 10 THEN n % 5 - 1 ELSE n - 10 END AS DOUBLE) AS time
FROM reduced CROSS JOIN n WHERE k = 13), hat AS (SELECT sample, sum(x*b) AS yhat FROM x JOIN s USING (col) GROUP BY 1), left_ AS (SELECT sample, y, y - coalesce(yhat, 0.0) AS residual FROM sig LEFT JOIN hat USING (sample)),
var_ AS (SELECT var_samp(residual) AS v FROM left_)"""


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.select([(F.round(c, digits) + 0.0).alias(c) if c in columns else c for c in df.columns])


@query(_SOLVED + """ SELECT CAST(1 AS INTEGER) AS channel, coefname, eventname, 'time' AS label, time, round(b, 3)+0.0 AS estimate, round(sqrt(d*v), 3)+0.0 AS stderror, CAST(NULL AS VARCHAR) AS "group" FROM s CROSS JOIN var_""")
def deconv_coef(spark, sf_dir):
    return _rounded(_deconvolved(spark, sf_dir, stderror=True).coeftable(), 3, "estimate", "stderror")


@query(_SOLVED + " SELECT CAST(1 AS INTEGER) AS channel, col AS col_ix, coefname, round(b, 3)+0.0 AS estimate FROM s")
def deconv_lsmr(spark, sf_dir):
    return _rounded(_deconvolved(spark, sf_dir, solver="lsmr").coefs.select("channel", "col_ix", "coefname", "estimate"), 3, "estimate")


def _units(spark, sf_dir, solver):
    """The same fit with k in millions and a signal in thousand millionths; what it gives is converted back."""
    e = _sampled(_events(spark, sf_dir, "purchase", "error")).withColumn("k", F.col("k") / 1e6)
    design = [("purchase", ("0 ~ 1 + k", bases.fir((-1.0, 3.0), 1.0))), ("error", ("0 ~ 1", bases.fir((0.0, 2.0), 1.0)))]
    c = sv.fit(design, e, _signal(spark, sf_dir).withColumn("y", F.col("y") * 1e-9), solver=solver).coefs
    back = F.col("estimate") * 1e9 / F.when(F.col("coefname") == "k", 1e6).otherwise(1.0)
    return c.select("col_ix", (F.round(back, 3) + 0.0).alias("estimate"))


_UNITS = _SOLVED + " SELECT col AS col_ix, round(b, 3)+0.0 AS estimate FROM s"


@query(_UNITS)
def deconv_pinv_units(spark, sf_dir):
    return _units(spark, sf_dir, "pinv")


@query(_UNITS)
def deconv_qr_units(spark, sf_dir):
    return _units(spark, sf_dir, "qr")


@query(_UNITS)
def deconv_cg_units(spark, sf_dir):
    return _units(spark, sf_dir, "cg")


@query(_UNITS)
def deconv_intern_units(spark, sf_dir):
    return _units(spark, sf_dir, "intern")


@query(_UNITS)
def deconv_lsmr_units(spark, sf_dir):
    return _units(spark, sf_dir, "lsmr")


@query(_UNITS)
def deconv_custom_units(spark, sf_dir):
    """A solver of the caller's own: refined once."""
    import numpy as np

    def refined(g, r):
        d = 1 / np.sqrt(np.diag(g))[:, None]
        m = np.linalg.inv(g * d * d.T)
        b = d * (m @ (d * r))
        return b + d * (m @ (d * (r - g @ b)))

    return _units(spark, sf_dir, refined)


# Two columns, a purchase at its sample and one sample later, in each series: solved in closed form.
@query(f""", c AS (SELECT unnest([0, 1]) AS c), k_ AS (SELECT event_type, (epoch_us(ts)-{START})//{STEP}+1 AS sample, CAST(round(value*100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS series FROM events),
x AS (SELECT series, sample + c AS sample, c, CAST(count(*) AS DOUBLE) AS x FROM k_ CROSS JOIN c WHERE event_type='purchase' AND sample + c <= {SAMPLES} GROUP BY 1, 2, 3), w AS (SELECT series, sample, coalesce(sum(x) FILTER (c = 0), 0) AS a, coalesce(sum(x) FILTER (c = 1), 0) AS b FROM x GROUP BY 1, 2),
y AS (SELECT series, sample, CAST(sum(cents) AS DOUBLE) AS y FROM k_ GROUP BY 1, 2), t AS (SELECT series, sum(a*a) AS aa, sum(a*b) AS ab, sum(b*b) AS bb, sum(a*coalesce(y, 0.0)) AS ay, sum(b*coalesce(y, 0.0)) AS by_ FROM w LEFT JOIN y USING (series, sample) GROUP BY 1)
SELECT series, CAST(0 AS INTEGER) AS col_ix, round((bb*ay - ab*by_)/(aa*bb - ab*ab), 3)+0.0 AS estimate FROM t UNION ALL SELECT series, 1, round((aa*by_ - ab*ay)/(aa*bb - ab*ab), 3)+0.0 FROM t""")
def deconv_by_series(spark, sf_dir):
    """A deconvolution of each of seven series, in one job."""
    rows = _table(spark, sf_dir, "events").withColumn("series", F.get_json_object("props", "$.k").cast("long") % 7)
    y = sg.gridded(rows, "ts", F.round(F.col("value") * 100).cast("long"), START, STEP, SAMPLES, F.col("series").cast("int")).select(F.col("channel").cast("long").alias("series"), F.lit(1).alias("channel"), "sample", "y")
    e = _sampled(_events(spark, sf_dir, "purchase")).withColumn("series", F.col("k").cast("long") % 7)
    return _rounded(sv.fit_series([("purchase", ("0 ~ 1", bases.fir((0.0, 1.0), 1.0)))], e, y, "series").select("series", "col_ix", "estimate"), 3, "estimate")


@query(_SOLVED + " SELECT CAST(1 AS INTEGER) AS channel, col AS col_ix, round(b, 3)+0.0 AS estimate FROM s")
def fit_from_design(spark, sf_dir):
    m = _deconvolved(spark, sf_dir, design_only=True)
    return _rounded(sv.fit_design(m.design_matrix(), _signal(spark, sf_dir), m.coefnames()).drop("coefname"), 3, "estimate")


@query("SELECT CAST(n AS INTEGER) AS col_ix, CASE WHEN n < 5 THEN 'purchase : (Intercept) : ' || (n - 1) || '.0' WHEN n < 10 THEN 'purchase : k : ' || (n - 6) || '.0' ELSE 'error : (Intercept) : ' || (n - 10) || '.0' END AS name FROM (SELECT unnest(range(0, 13)) AS n)", plain=True)
def deconv_coefnames(spark, sf_dir):
    names = _deconvolved(spark, sf_dir, design_only=True).coefnames()
    return spark.createDataFrame(list(enumerate(names)), "col_ix int, name string")


@query("SELECT CAST(col_ix AS INTEGER) AS col_ix, CAST(0.0 AS DOUBLE) AS gap FROM (SELECT unnest(range(0, 13)) AS col_ix)")
def deconv_orthogonality(spark, sf_dir):
    m, y = _deconvolved(spark, sf_dir), _signal(spark, sf_dir)
    left = pr.residuals(m, y).select("channel", "sample", F.col("residual").alias("y"))
    size = dm.cross(m.design_matrix(), y).withColumnRenamed("r", "size")
    return dm.cross(m.design_matrix(), left).join(size, ["channel", "col_ix"]).select("col_ix", (F.abs(F.round(F.col("r") / F.col("size"), 6)) + 0.0).alias("gap"))


@query(_SOLVED + " SELECT CAST(1 AS INTEGER) AS channel, sample, round(sum(x*b), 2)+0.0 AS yhat FROM x JOIN s USING (col) WHERE col < 10 GROUP BY 2")
def deconv_predict_partial(spark, sf_dir):
    return _rounded(pr.predict(_deconvolved(spark, sf_dir), keep=["purchase"]), 2, "yhat")


@query(_SOLVED + " SELECT CAST(1 AS INTEGER) AS channel, sample, round(sum(x*b), 2)+0.0 AS yhat FROM x JOIN s USING (col) WHERE col >= 10 GROUP BY 2")
def deconv_predict_excluded(spark, sf_dir):
    return _rounded(pr.predict(_deconvolved(spark, sf_dir), exclude=["purchase"]), 2, "yhat")


@query(_SOLVED + " SELECT CAST(1 AS INTEGER) AS channel, sample, round(sum(x*b), 2)+0.0 AS yhat FROM (SELECT sample, col, CAST(sum(x) AS DOUBLE) AS x FROM every_ JOIN ev USING (event_ix) WHERE sample >= 1 AND k >= 3 GROUP BY 1, 2) JOIN s USING (col) GROUP BY 2")
def deconv_predict_new_events(spark, sf_dir):
    new = _sampled(_events(spark, sf_dir, "purchase", "error")).where("k >= 3")
    return _rounded(pr.predict(_deconvolved(spark, sf_dir), new, overlap=True), 2, "yhat")


_AROUND = ", a AS (SELECT event_ix, CAST(floor(latency) AS BIGINT) AS l, CAST(range AS BIGINT) AS t FROM ev CROSS JOIN range(-1, 4) WHERE event='purchase')"


@query(_SOLVED + _AROUND + " SELECT CAST(1 AS INTEGER) AS channel, event_ix, CAST(t + 1 AS INTEGER) AS time_ix, CAST(t AS DOUBLE) AS time, round(yhat, 2)+0.0 AS yhat FROM a LEFT JOIN hat ON sample = l + t")
def deconv_predict_epoched(spark, sf_dir):
    return _rounded(pr.predict(_deconvolved(spark, sf_dir), epoch_to="purchase"), 2, "yhat")


@query(_SOLVED + _AROUND + " SELECT CAST(1 AS INTEGER) AS channel, event_ix, CAST(t + 1 AS INTEGER) AS time_ix, CAST(t AS DOUBLE) AS time, round(residual, 2)+0.0 AS residual FROM a LEFT JOIN left_ ON sample = l + t")
def deconv_residuals_epoched(spark, sf_dir):
    return _rounded(pr.residuals(_deconvolved(spark, sf_dir), _signal(spark, sf_dir), epoch_to="purchase"), 2, "residual")


@query(_SOLVED + " SELECT CAST(1 AS INTEGER) AS channel, sample, y, round(residual, 2)+0.0 AS residual FROM left_")
def deconv_residuals(spark, sf_dir):
    return _rounded(pr.residuals(_deconvolved(spark, sf_dir), _signal(spark, sf_dir)), 2, "residual")


@query(_SOLVED + """ SELECT event_ix, event, value, k, eventname, CAST(1 AS INTEGER) AS channel, CAST(time + CASE WHEN event = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS time_ix, time,
round(sum(CASE WHEN coefname = 'k' THEN b*k ELSE b END), 2)+0.0 AS yhat FROM ev JOIN s ON eventname = event GROUP BY ALL""")
def deconv_predicttable(spark, sf_dir):
    return _rounded(pr.predicttable(_deconvolved(spark, sf_dir)), 2, "yhat")


@query(_SOLVED + " SELECT CAST(1 AS INTEGER) AS channel, round(1 - var_samp(residual)/var_samp(y), 6)+0.0 AS r2 FROM left_ WHERE sample IN (SELECT sample FROM x)")
def deconv_r2(spark, sf_dir):
    return _rounded(pr.r2(_deconvolved(spark, sf_dir), _signal(spark, sf_dir), skip_notmodelled=True), 6, "r2")


@query(_SOLVED + """, v AS (SELECT unnest([1.0, 3.0]) AS k) SELECT CAST(k AS DOUBLE) AS k, eventname, CAST(time + CASE WHEN eventname = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS time_ix, time,
round(sum(CASE WHEN coefname = 'k' THEN b*k ELSE b END), 2)+0.0 AS yhat FROM v CROSS JOIN s GROUP BY ALL""")
def effects_deconv(spark, sf_dir):
    return _rounded(pr.effects({"k": [1.0, 3.0]}, _deconvolved(spark, sf_dir)).select("k", "eventname", "time_ix", "time", "yhat"), 2, "yhat")


@query(_SOLVED + " SELECT eventname, CAST(time + CASE WHEN eventname = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS time_ix, round(sum(CASE WHEN coefname = 'k' THEN b*(SELECT max(k) FROM ev WHERE event = 'purchase') ELSE b END), 2)+0.0 AS yhat FROM s GROUP BY ALL")
def effects_max_deconv(spark, sf_dir):
    return _rounded(pr.effects({}, _deconvolved(spark, sf_dir), typical="max").select("eventname", "time_ix", "yhat"), 2, "yhat")


@query(_CELLS + " SELECT CAST(sample AS BIGINT) AS sample, CAST(col AS INTEGER) AS col_ix, round(x, 6) AS x FROM x")
def combined_designs(spark, sf_dir):
    e = _sampled(_events(spark, sf_dir, "purchase", "error"))
    first = dm.entries([("purchase", ("0 ~ 1 + k", bases.fir((-1.0, 3.0), 1.0)))], e)
    second = dm.entries([("error", ("0 ~ 1", bases.fir((0.0, 2.0), 1.0)))], e)
    return _long(dm.combined(dm.expanded_design(first, e), dm.expanded_design(second, e), first[0].width))


@query(_X + " SELECT sample, CAST(col_ix AS INTEGER) AS col_ix, round(x, 6) AS x FROM x WHERE sample <= 4000")
def equalized_design(spark, sf_dir):
    e, rows = _fir(spark, sf_dir)
    return _long(ep.equalized(dm.expanded_design([e], rows), _signal(spark, sf_dir).where("sample <= 4000"))[0])


@query(_X + " SELECT DISTINCT sample FROM x")
def modelled_samples(spark, sf_dir):
    e, rows = _fir(spark, sf_dir)
    return dm.non_zero_rows(dm.expanded_design([e], rows)).where(F.col("sample") <= SAMPLES)


@query(", b AS (SELECT unnest([quantile_cont(value, 0.0), quantile_cont(value, 1.0/3), quantile_cont(value, 2.0/3), quantile_cont(value, 1.0)]) AS b FROM ev) SELECT round(b, 6) AS b FROM b")
def spline_breakpoints(spark, sf_dir):
    s = Schema.fit("0 ~ 1 + spl(value, 6)", _events(spark, sf_dir))
    return spark.createDataFrame([(float(b),) for b in s.breaks["value,6"]], "b double").select(F.round("b", 6).alias("b"))


# Each event's values of all functions as a list, from order 1 to 4.
_COX = """, kn AS ({knots}), n1 AS (SELECT {key}, {x} AS x, t, list_transform(range(1, len(t)), lambda i: CASE WHEN {x} >= t[i] AND t[i] < t[i+1] AND ({x} < t[i+1] OR ({closed} AND {x} = t[i+1] AND t[i+1] = t[len(t)])) THEN 1.0 ELSE 0.0 END) AS v FROM {of} CROSS JOIN kn)"""
_ORDERS = "".join(
    f""", n{o} AS (SELECT {{key}}, x, t, list_transform(range(1, len(v)), lambda i: coalesce((x-t[i])/nullif(t[i+{o - 1}]-t[i], 0)*v[i], 0) + coalesce((t[i+{o}]-x)/nullif(t[i+{o}]-t[i+1], 0)*v[i+1], 0)) AS v FROM n{o - 1})"""
    for o in (2, 3, 4)
)
_SPL = (_COX + _ORDERS).format(
    key="event_ix", x="value", of="ev", closed="true",
    knots="SELECT list_concat([q[1], q[1], q[1]], q, [q[4], q[4], q[4]]) AS t FROM (SELECT [quantile_cont(value, 0.0), quantile_cont(value, 1.0/3), quantile_cont(value, 2.0/3), quantile_cont(value, 1.0)] AS q FROM ev)",
) + ", f AS (SELECT event_ix, unnest(range(0, len(v))) AS i, unnest(v) AS v FROM n4)"


def _spline(spark, sf_dir, formula):
    e = _events(spark, sf_dir)
    s = Schema.fit(formula, e)
    x = s.design(e).select("event_ix", F.posexplode("x").alias("j", "x")).where("j > 0")
    return x.select("event_ix", F.col("j").cast("int").alias("j"), (F.round("x", 5) + 0.0).alias("x"))


@query(_SPL + " SELECT event_ix, CAST(CASE WHEN i < 2 THEN i+1 ELSE i END AS INTEGER) AS j, round(v, 5)+0.0 AS x FROM f WHERE i <> 2")
def spline_basis(spark, sf_dir):
    return _spline(spark, sf_dir, "0 ~ 1 + spl(value, 6)")


_CIRC = (_COX + _ORDERS).format(
    key="event_ix", x="(value - 20.0*floor(value/20.0))", of="ev", closed="false", knots="SELECT list(CAST(range AS DOUBLE)*20.0/6 ORDER BY range) AS t FROM range(-3, 10)",
) + ", f AS (SELECT event_ix, unnest(range(0, len(v))) AS i, unnest(v) AS v FROM n4)"


@query(_CIRC + " , z AS (SELECT event_ix, CAST(i % 6 AS INTEGER) AS f, sum(v) AS v FROM f GROUP BY 1, 2) SELECT event_ix, CAST(CASE WHEN f < 2 THEN f+1 ELSE f END AS INTEGER) AS j, round(v, 5)+0.0 AS x FROM z WHERE f <> 2")
def circspl_basis(spark, sf_dir):
    return _spline(spark, sf_dir, "0 ~ 1 + circspl(value, 5, 0, 20)")


_TIMES = (_COX + _ORDERS).format(
    key="lag", x="lag", of="(SELECT CAST(range AS DOUBLE) AS lag FROM range(-1, 4))", closed="true", knots="SELECT [-1.0, -1.0, -1.0, -1.0, 1.0, 3.0, 3.0, 3.0, 3.0] AS t",
) + ", f AS (SELECT lag, unnest(range(0, len(v))) AS i, unnest(v) AS v FROM n4)"


@query(_TIMES + " SELECT CAST(floor(latency) AS BIGINT) + CAST(lag AS BIGINT) AS sample, CAST(i AS INTEGER) AS col_ix, round(sum(v), 6) AS x FROM ev CROSS JOIN f WHERE event='purchase' AND v <> 0 AND CAST(floor(latency) AS BIGINT) + CAST(lag AS BIGINT) >= 1 GROUP BY 1, 2 HAVING sum(v) <> 0")
def spline_time_basis(spark, sf_dir):
    e = _sampled(_events(spark, sf_dir))
    return _long(dm.expanded_design(dm.entries([("purchase", ("0 ~ 1", bases.splinebasis((-1.0, 3.0), 1.0, 5, "")))], e), e))


@query(_MU + " SELECT v AS value, time_ix, round(a + b*v, 2) AS yhat FROM fit CROSS JOIN (SELECT unnest([10.0, 50.0, 90.0]) AS v)".replace("v AS value", "CAST(v AS DOUBLE) AS value"))
def effects_grid(spark, sf_dir):
    return pr.effects({"value": [10.0, 50.0, 90.0]}, _mu(spark, sf_dir)).select("value", "time_ix", F.round("yhat", 2).alias("yhat"))


# Five columns, reduced to the identity at each time; the values asked for are points with negative numbers.
_SPLINED = (_MU + ", pts AS (SELECT event_ix, value FROM e UNION ALL SELECT CAST(-v AS BIGINT), CAST(v AS DOUBLE) FROM (SELECT unnest([10, 50, 90]) AS v))" + (_COX + _ORDERS).format(
    key="event_ix", x="value", of="pts", closed="true",
    knots="SELECT list_concat([q[1], q[1], q[1]], q, [q[3], q[3], q[3]]) AS t FROM (SELECT [quantile_cont(value, 0.0), quantile_cont(value, 0.5), quantile_cont(value, 1.0)] AS q FROM e)",
) + """, xs AS (SELECT event_ix, [1.0, v[1], v[2], v[4], v[5]] AS x FROM n4), fx AS (SELECT time_ix, y, x FROM full_ JOIN xs USING (event_ix)), n AS (SELECT CAST(range AS INTEGER) AS n FROM range(0, 5)),
lines AS (SELECT time_ix, n AS i, [sum(x[n+1]*x[1]), sum(x[n+1]*x[2]), sum(x[n+1]*x[3]), sum(x[n+1]*x[4]), sum(x[n+1]*x[5]), sum(x[n+1]*y)] AS line FROM fx CROSS JOIN n GROUP BY 1, 2),
reduced(time_ix, k, m) AS (SELECT time_ix, 0, list(CAST(line AS DOUBLE[]) ORDER BY i) FROM lines GROUP BY 1 UNION ALL SELECT time_ix, k+1, list_transform(m, lambda l, i: CASE WHEN i = k+1 THEN list_transform(l, lambda v: v/l[k+1]) ELSE list_transform(l, lambda v, j: v - l[k+1]*m[k+1][j]/m[k+1][k+1]) END) FROM reduced WHERE k < 5),
s AS (SELECT time_ix, list_transform(m, lambda l: l[6]) AS b FROM reduced WHERE k = 5)
SELECT CAST(-event_ix AS DOUBLE) AS value, time_ix, round(list_sum(list_transform(range(1, 6), lambda i: b[i]*x[i])), 2)+0.0 AS yhat FROM s CROSS JOIN (SELECT * FROM xs WHERE event_ix < 0)""")  # fmt: skip


@query(_SPLINED)
def effects_spline(spark, sf_dir):
    return _rounded(pr.effects({"value": [10.0, 50.0, 90.0]}, _mu(spark, sf_dir, "0 ~ 1 + spl(value, 5)")).select("value", "time_ix", "yhat"), 2, "yhat")


@query(_MU + " SELECT time_ix, round(a + b*(SELECT avg(value) FROM e), 2) AS yhat FROM fit")
def effects_typical(spark, sf_dir):
    return pr.effects({}, _mu(spark, sf_dir)).select("time_ix", F.round("yhat", 2).alias("yhat"))


@query(_MU + " SELECT time_ix, round(a + b*(SELECT max(value) FROM e), 2) AS yhat FROM fit")
def effects_max(spark, sf_dir):
    return pr.effects({}, _mu(spark, sf_dir), typical="max").select("time_ix", F.round("yhat", 2).alias("yhat"))


# One slope within both kinds and an intercept for each; the kind is held at the purchases' share.
@query(_EPOCH.format(kinds="'purchase','error'", source="sig") + """, full_ AS (SELECT * FROM ep WHERE event_ix NOT IN (SELECT event_ix FROM ep WHERE y IS NULL)), kinds AS (SELECT time_ix, event, avg(y) AS my, avg(value) AS mv, regr_sxy(y, value) AS sxy, regr_sxx(y, value) AS sxx FROM full_ GROUP BY 1, 2),
b AS (SELECT time_ix, sum(sxy)/sum(sxx) AS b FROM kinds GROUP BY 1), a AS (SELECT time_ix, any_value(b) AS b, sum(CASE WHEN event='error' THEN my - b*mv END) AS ae, sum(CASE WHEN event='purchase' THEN my - b*mv END) AS ap FROM kinds JOIN b USING (time_ix) GROUP BY 1)
SELECT CAST(v AS DOUBLE) AS value, time_ix, round(ae + (ap - ae)*(SELECT avg(CASE WHEN event='purchase' THEN 1.0 ELSE 0.0 END) FROM e) + b*v, 2) AS yhat FROM a CROSS JOIN (SELECT unnest([10.0, 90.0]) AS v)""")
def effects_typical_kind(spark, sf_dir):
    e = _events(spark, sf_dir, "purchase", "error")
    m = sv.fit(("0 ~ 1 + event + value", ep.lags((-2.0, 5.0), 1.0)), e, _epochs(spark, sf_dir, "purchase", "error"))
    return pr.effects({"value": [10.0, 90.0]}, m).select("value", "time_ix", F.round("yhat", 2).alias("yhat"))


@query("SELECT event_ix, CAST(ntile(5) OVER (ORDER BY event_ix)-1 AS INTEGER) AS fold FROM ev WHERE event='purchase'")
def cv_folds(spark, sf_dir):
    return sv.folds(_events(spark, sf_dir, "purchase"), 5)


@query(_EPOCH.format(kinds="'purchase'", source="sig") + """, f AS (SELECT event_ix, ntile(3) OVER (ORDER BY event_ix)-1 AS fold FROM e), full_ AS (SELECT * FROM ep JOIN f USING (event_ix) WHERE event_ix NOT IN (SELECT event_ix FROM ep WHERE y IS NULL)),
o AS (SELECT unnest([0, 1, 2]) AS out) SELECT CAST(out AS INTEGER) AS fold, time_ix, round(regr_slope(y, value), 3) AS slope FROM full_ JOIN o ON fold <> out GROUP BY 1, 2""")
def cv_coef(spark, sf_dir):
    e = _events(spark, sf_dir, "purchase")
    m = sv.cross_validated([("purchase", ("0 ~ 1 + value", ep.lags((-2.0, 5.0), 1.0)))], e, ep.epoch(_signal(spark, sf_dir), e, (-2.0, 5.0), 1.0), k=3, shuffle=False)
    return m.coefs.where("coefname = 'value'").select("fold", "time_ix", F.round("estimate", 3).alias("slope"))


@query(_EPOCH.format(kinds="'purchase'", source="sig") + """, f AS (SELECT event_ix, ntile(3) OVER (ORDER BY event_ix)-1 AS fold FROM e), full_ AS (SELECT * FROM ep JOIN f USING (event_ix) WHERE event_ix NOT IN (SELECT event_ix FROM ep WHERE y IS NULL)),
o AS (SELECT unnest([0, 1, 2]) AS out), p AS (SELECT out, time_ix, regr_slope(y, value) AS slope FROM full_ JOIN o ON fold <> out GROUP BY 1, 2) SELECT CAST(time_ix - 2 AS DOUBLE) AS time, round(avg(slope), 3) AS estimate FROM p GROUP BY 1""")
def cv_mean(spark, sf_dir):
    e = _events(spark, sf_dir, "purchase")
    m = sv.cross_validated([("purchase", ("0 ~ 1 + value", ep.lags((-2.0, 5.0), 1.0)))], e, ep.epoch(_signal(spark, sf_dir), e, (-2.0, 5.0), 1.0), k=3, shuffle=False)
    return m.coeftable().where("coefname = 'value'").select("time", F.round("estimate", 3).alias("estimate"))


@query(""", s AS (SELECT * FROM ev WHERE event='error'), t AS (SELECT * FROM ev WHERE event='purchase'), n AS (SELECT s.event_ix AS si, s.latency AS sl, s.value, arg_min(t.event_ix, t.latency) AS event_ix FROM s JOIN t ON abs(t.latency - s.latency) <= 2 GROUP BY 1, 2, 3),
w AS (SELECT event_ix, arg_max(value, sl) AS near_value FROM n GROUP BY 1) SELECT event_ix, event, round(near_value, 6) AS near_value FROM ev LEFT JOIN w USING (event_ix) WHERE event IN ('purchase','error')""")
def copy_by_function(spark, sf_dir):
    """The earliest purchase in reach of each error."""
    out = ev.copy_eventinfo(_events(spark, sf_dir, "purchase", "error"), "error", "purchase", "value", "near_value", search=lambda lat, lats: F.lit(0), within=2.0)
    return out.select("event_ix", "event", F.round("near_value", 6).alias("near_value"))


@query(""", s AS (SELECT * FROM ev WHERE event='error'), t AS (SELECT * FROM ev WHERE event='purchase'), n AS (SELECT s.event_ix AS si, s.latency AS sl, s.value, t.event_ix FROM s JOIN t ON t.latency >= s.latency
QUALIFY row_number() OVER (PARTITION BY s.event_ix ORDER BY t.latency, t.event_ix) = 2), w AS (SELECT event_ix, arg_max(value, sl) AS near_value FROM n GROUP BY 1)
SELECT event_ix, event, round(near_value, 6) AS near_value FROM ev LEFT JOIN w USING (event_ix) WHERE event IN ('purchase','error')""")
def copy_second_next(spark, sf_dir):
    """The second purchase at or after each error, however far; a source is settled once two are in reach."""
    second = lambda lat, lats: F.size(F.filter(lats, lambda t: t < lat)) + 1
    settled = lambda lat, lats, reach: F.size(F.filter(lats, lambda t: t >= lat)) >= 2
    out = ev.copy_eventinfo(_events(spark, sf_dir, "purchase", "error"), "error", "purchase", "value", "near_value", search=second, settled=settled)
    return out.select("event_ix", "event", F.round("near_value", 6).alias("near_value"))


# Fifty rounds of weighted regression with the biweight; what a round needs of each event is its value, its y and its residual.
@query(_EPOCH.format(kinds="'purchase'", source="sig") + """, d AS (SELECT time_ix, list({'v': value, 'y': y} ORDER BY event_ix) AS d, regr_intercept(y, value) AS a, regr_slope(y, value) AS b FROM ep WHERE y IS NOT NULL GROUP BY 1),
it(time_ix, n, d, a, b) AS (SELECT time_ix, 0, d, a, b FROM d UNION ALL SELECT time_ix, n+1, d, coalesce((wy - slope*wv)/nullif(w, 0), 0), slope FROM (SELECT *, coalesce((w*wvy - wv*wy)/nullif(w*wvv - wv*wv, 0), 0) AS slope FROM (
SELECT time_ix, n, d, list_sum(list_transform(p, lambda e: e.w)) AS w, list_sum(list_transform(p, lambda e: e.w*e.v)) AS wv, list_sum(list_transform(p, lambda e: e.w*e.y)) AS wy, list_sum(list_transform(p, lambda e: e.w*e.v*e.v)) AS wvv, list_sum(list_transform(p, lambda e: e.w*e.v*e.y)) AS wvy FROM (
SELECT time_ix, n, d, list_transform(r, lambda e: {'v': e.v, 'y': e.y, 'w': CASE WHEN abs(e.r) < far THEN (1 - (e.r/far)*(e.r/far))*(1 - (e.r/far)*(e.r/far)) ELSE 0.0 END}) AS p FROM (
SELECT time_ix, n, d, r, 4.685*greatest(list_median(list_transform(r, lambda e: abs(e.r - mid)))/0.6745, 1e-12) AS far FROM (SELECT time_ix, n, d, r, list_median(list_transform(r, lambda e: e.r)) AS mid FROM (
SELECT time_ix, n, d, list_transform(d, lambda e: {'v': e.v, 'y': e.y, 'r': e.y - a - b*e.v}) AS r FROM it WHERE n < 50)))))))
SELECT CAST(1 AS INTEGER) AS channel, time_ix, coefname, estimate FROM (SELECT time_ix, '(Intercept)' AS coefname, round(a, 3)+0.0 AS estimate FROM it WHERE n = 50 UNION ALL SELECT time_ix, 'value', round(b, 3)+0.0 FROM it WHERE n = 50)""")
def robust_fit(spark, sf_dir):
    return _robust(spark, sf_dir)


@query(ORACLE_SQL["robust_fit"], plain=True)
def robust_units(spark, sf_dir):
    """The same with a signal in thousand millionths, converted back."""
    return _robust(spark, sf_dir, 1e-9)


def _robust(spark, sf_dir, unit=1.0):
    e = _events(spark, sf_dir, "purchase")
    y = _signal(spark, sf_dir).withColumn("y", F.col("y") * unit)
    return _rounded(sv.robust("0 ~ 1 + value", e, ep.epoch(y, e, (-2.0, 5.0), 1.0)).withColumn("estimate", F.col("estimate") / unit), 3, "estimate")
