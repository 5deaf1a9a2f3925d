"""Queries over window statistics, spectra, decompositions and autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowpane.operators import long_series as LS
from flowpane.operators import memory as M
from flowpane.operators import series as D
from flowpane.operators import vectors as V
from flowpane.operators import window_features as G
from flowpane.operators import windows as win
from workload.inputs import EVENT_ORDER, FEATURES, FLOWS_SQL, META_SQL, SPEC, WIN_SQL, flows, positioned, query, table
from workload.splitting import rounded

SERIES_SQL = WIN_SQL + """,
ser AS MATERIALIZED (SELECT source, window_id, woff AS t, 'value' AS channel, value AS x FROM win
        UNION ALL SELECT source, window_id, woff, 'k', k FROM win)"""
DFT_SQL = SERIES_SQL + """,
dft AS MATERIALIZED (SELECT source, window_id, channel, b AS bin, sum(x * cos(2 * pi() * ((b * t) % 100) / 100)) AS re,
               -sum(x * sin(2 * pi() * ((b * t) % 100) / 100)) AS im
        FROM ser, (SELECT unnest(range(51)) AS b) GROUP BY ALL)"""
# Inverse transform of the bins kept in table `kept` (source, window_id, channel, bin, re, im)
INVERSE_SQL = """
inv AS (SELECT source, window_id, channel, t, sum(CASE WHEN bin IN (0, 50) THEN 1 ELSE 2 END *
          (re * cos(2 * pi() * ((bin * t) % 100) / 100) - im * sin(2 * pi() * ((bin * t) % 100) / 100))) / 100 AS y
        FROM kept, (SELECT unnest(range(100)) AS t) GROUP BY ALL)"""


def series(spark, sf, features=FEATURES):
    return win.window_series(positioned(spark, sf).drop("label"), SPEC, features)


# added before rounding where exact results end in a 5 that rounding could take either way
NUDGE = 1.2345678e-8


def at_rows(df, *cols, digits=6, nudge=0.0):
    """One row per (window, channel, t) of equally long arrays."""
    z = df.select("source", "window_id", "channel", F.posexplode(F.arrays_zip(*cols)).alias("t", "z"))
    return z.select("source", "window_id", "channel", F.col("t").cast("bigint").alias("t"),
                    *[(F.round(F.col(f"z.{c}") + nudge, digits) + 0.0).alias(c) for c in cols])


# ---- window features ---------------------------------------------------------------------------------------------

def stats_sql(stats):
    exprs = {"mean": "avg({f})", "std": "stddev_pop({f})", "max": "max({f})", "min": "min({f})",
             "median": "quantile_cont({f}, 0.5)", "last": "max_by({f}, woff)"}
    cols = ", ".join(f"round({exprs[s].format(f=f)}, 6) AS {f}_{s}" for s in stats for f in FEATURES)
    return f"WITH {WIN_SQL} SELECT source, window_id, {cols} FROM win GROUP BY source, window_id"


@query("window_stats", "G1", stats_sql(("mean", "std", "max", "min")))
def _(spark, sf):
    return rounded(G.window_stats(positioned(spark, sf), SPEC, FEATURES))


@query("window_stats_all", "G1 G2", stats_sql(G.STATS))
def _(spark, sf):
    return rounded(G.window_stats(positioned(spark, sf), SPEC, FEATURES, G.STATS))


@query("window_last_row", "G2", stats_sql(("last",)))
def _(spark, sf):
    return rounded(G.window_stats(positioned(spark, sf), SPEC, FEATURES, ("last",)))


@query("window_vectors", "G3", f"""WITH {WIN_SQL}
SELECT source, window_id, woff * 2 + f AS idx, round(CASE f WHEN 0 THEN value ELSE k END, 6) AS x
FROM win, (SELECT unnest(range(2)) AS f)""")
def _(spark, sf):
    v = G.window_vector(positioned(spark, sf), SPEC, FEATURES)
    return v.select("source", "window_id", F.posexplode("x").alias("idx", "x")).select(
        "source", "window_id", F.col("idx").cast("bigint").alias("idx"), F.round("x", 6).alias("x"))


@query("standard_scaled", "G4", f"""WITH {FLOWS_SQL}, s AS (SELECT avg(value) AS a, stddev_pop(value) AS sa, avg(k) AS b,
stddev_pop(k) AS sb FROM flows WHERE label = 'Benign' AND source <= '2024-01-18')
SELECT event_id, round((value - a) / sa, 6) AS value, round((k - b) / sb, 6) AS k,
  CAST(0 AS DOUBLE) AS constant FROM flows, s""")
def _(spark, sf):
    f = flows(spark, sf).withColumn("constant", F.lit(3.0))
    s = G.fit_scaler(f.where("label = 'Benign' and source <= '2024-01-18'"), [*FEATURES, "constant"])
    return rounded(G.apply_scaler(f, s).select("event_id", *FEATURES, "constant"))


@query("instance_normalised", "G5", f"""WITH {SERIES_SQL},
m AS (SELECT *, avg(x) OVER w AS a, var_pop(x) OVER w AS v FROM ser WINDOW w AS (PARTITION BY source, window_id, channel))
SELECT source, window_id, channel, t, round((x - a) / sqrt(v + 1e-5), 5) + 0.0 AS x FROM m""")
def _(spark, sf):
    return at_rows(G.instance_norm(series(spark, sf)), "x", digits=5)


@query("instance_normalised_last", "G5", f"""WITH {SERIES_SQL},
m AS (SELECT *, max_by(x, t) OVER w AS a, var_samp(x) OVER w AS v FROM ser WINDOW w AS (PARTITION BY source, window_id, channel))
SELECT source, window_id, channel, t, round((x - a) / sqrt(v + 1e-5), 5) + 0.0 AS x FROM m""")
def _(spark, sf):
    return at_rows(G.instance_norm(series(spark, sf), "last", unbiased=True), "x", digits=5)


@query("instance_denormalised", "G5", f"""WITH {SERIES_SQL} SELECT source, window_id, channel, t, round(x, 6) + 0.0 AS x FROM ser""")
def _(spark, sf):
    return at_rows(G.instance_denorm(G.instance_norm(series(spark, sf))), "x")


@query("spectrum_amplitude", "G6", f"""WITH {DFT_SQL}
SELECT source, window_id, channel, bin, round(ln(1 + sqrt(re * re + im * im)), 6) + 0.0 AS amp FROM dft""")
def _(spark, sf):
    s = G.by_bin(G.rfft_amplitude(series(spark, sf)))
    return s.select("source", "window_id", "channel", F.col("bin").cast("bigint").alias("bin"),
                    (F.round("amp", 6) + 0.0).alias("amp"))


@query("spectrum_phase", "G7", f"""WITH {DFT_SQL}
SELECT source, window_id, channel, bin, CASE WHEN bin NOT IN (0, 50) THEN round(atan2(im, re), 4) + 0.0 WHEN round(re, 6) < 0 THEN round(pi(), 4) ELSE 0 END AS phase
FROM dft""")
def _(spark, sf):
    s = G.by_bin(G.rfft_phase(series(spark, sf)), "phase", "phase")
    return s.select(
        "source", "window_id", "channel", F.col("bin").cast("bigint").alias("bin"),
        (F.round("phase", 4) + 0.0).alias("phase"))


POOL_SQL = SERIES_SQL + """,
pool AS (SELECT source, window_id, channel, scale, t // scale AS slot, avg(x) AS avg, max(x) AS max
         FROM ser, (SELECT unnest([8, 4, 2]) AS scale) WHERE t // scale < 100 // scale GROUP BY ALL)"""


@query("multiscale_pools", "G8", f"""WITH {POOL_SQL} SELECT source, window_id, channel, scale, slot, round(avg, 6) AS avg,
round(max, 6) AS max, round(0.7 * avg + 0.3 * max, 6) AS hybrid FROM pool""")
def _(spark, sf):
    p = G.multiscale_pool(series(spark, sf))
    p = p.select("source", "window_id", "channel", "scale", F.posexplode(F.arrays_zip("pooled.avg", "pooled.max", "pooled.hybrid")).alias("slot", "p"))
    return p.select("source", "window_id", "channel", "scale", F.col("slot").cast("bigint").alias("slot"),
                    *[F.round(f"p.{c}", 6).alias(c) for c in ("avg", "max", "hybrid")])


@query("multiscale_stats", "G9", f"""WITH {POOL_SQL} SELECT source, window_id, channel, scale,
round(avg((avg + max) / 2), 8) AS mean, round(stddev_samp((avg + max) / 2), 8) AS std, round(max((avg + max) / 2), 8) AS max
FROM pool GROUP BY ALL""")
def _(spark, sf):
    s = G.multiscale_stats(G.multiscale_pool(series(spark, sf)))
    return rounded(s.select("source", "window_id", "channel", "scale", "mean", "std", "max"), 8)


@query("rolling_bin_masks", "G10", f"""WITH {DFT_SQL}
SELECT source, window_id, channel, (bin - 1) // 13 AS segment, count(*) AS bins,
  round(sum(ln(1 + sqrt(re * re + im * im))), 5) AS masked_amp FROM dft WHERE bin > 0 GROUP BY ALL""")
def _(spark, sf):
    s = G.by_bin(G.rfft_amplitude(series(spark, sf)))
    s = s.withColumn("segment", G.rolling_segment(F.col("bin"), 51, 4)).where("segment is not null")
    g = s.groupBy("source", "window_id", "channel", F.col("segment").cast("bigint").alias("segment"))
    return g.agg(F.count(F.lit(1)).alias("bins"), F.round(F.sum("amp"), 5).alias("masked_amp"))


def _h(text):
    return f"CAST('0x' || substr(md5({text} || ':11'), 1, 8) AS BIGINT)"


@query("random_bin_masks", "G10", f"""WITH {META_SQL},
d AS (SELECT source, window_id, b, row_number() OVER (PARTITION BY source, window_id ORDER BY
  {_h("source || '/' || window_id || '#' || b")}, b) AS rn,
  round_even((0.2 + 0.3 * {_h("source || '/' || window_id")} / 4294967296.0) * 50, 0) AS k
  FROM meta, (SELECT unnest(range(1, 51)) AS b)),
g AS (SELECT source, window_id, string_agg(b, ',' ORDER BY b) AS masked_bins FROM d WHERE rn <= k GROUP BY ALL)
SELECT source, window_id, channel, masked_bins FROM g, (SELECT unnest(['value', 'k']) AS channel)""")
def _(spark, sf):
    s = G.mask_bins_random(G.rfft_amplitude(series(spark, sf)), ["source", "window_id"], 51, 11)
    return s.select("source", "window_id", "channel", F.array_join("masked_bins", ",").alias("masked_bins"))


# ---- decomposition -----------------------------------------------------------------------------------------------

def sma_sql(k, name="y"):
    h = (k - 1) // 2
    return f"""(sum(x) OVER (w ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)
      + greatest({h} - t, 0) * first_value(x) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
      + greatest({h} - 99 + t, 0) * last_value(x) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {k} AS {name}"""


W_SQL = "WINDOW w AS (PARTITION BY source, window_id, channel ORDER BY t)"


@query("centred_moving_average", "H1", f"""WITH {SERIES_SQL}, s AS (SELECT *, {sma_sql(25)} FROM ser {W_SQL})
SELECT source, window_id, channel, t, round(y, 6) + 0.0 AS trend FROM s""")
def _(spark, sf):
    return at_rows(D.sma(series(spark, sf)), "trend")


@query("causal_moving_average", "H2", f"""WITH {SERIES_SQL}
SELECT source, window_id, channel, t, round(sum(x) OVER (w ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) / 25, 6) + 0.0 AS trend
FROM ser {W_SQL}""")
def _(spark, sf):
    return at_rows(D.causal_sma(series(spark, sf)), "trend")


def ema_sql(x="x", src="ser", a=0.3, out="y"):
    """y_t = (1-a)^t x_0 + sum a (1-a)^(t-s) x_s as a join within the window."""
    return f"""MATERIALIZED (SELECT c.source, c.window_id, c.channel, c.t, sum(CASE WHEN p.t = 0 THEN 1 ELSE {a} END
      * pow({1 - a}, c.t - p.t) * p.{x}) AS {out} FROM {src} c JOIN {src} p ON p.source = c.source AND p.window_id = c.window_id
      AND p.channel = c.channel AND p.t <= c.t GROUP BY ALL)"""


@query("exponential_moving_average", "H3", f"""WITH {SERIES_SQL}, e AS {ema_sql()}
SELECT source, window_id, channel, t, round(y + {NUDGE}, 6) + 0.0 AS trend FROM e""")
def _(spark, sf):
    return at_rows(D.ema(series(spark, sf)), "trend", nudge=NUDGE)


@query("double_exponential_moving_average", "H4", f"""WITH {SERIES_SQL}, e AS {ema_sql()}, ee AS {ema_sql('y', 'e', out='z')}
SELECT source, window_id, channel, t, round(2 * y - z + {NUDGE}, 6) + 0.0 AS trend FROM e JOIN ee USING (source, window_id, channel, t)""")
def _(spark, sf):
    return at_rows(D.dema(series(spark, sf)), "trend", nudge=NUDGE)


@query("moving_average_decomposition", "H5", f"""WITH {SERIES_SQL}, s AS (SELECT *, {sma_sql(25)} FROM ser {W_SQL})
SELECT source, window_id, channel, t, round(y, 6) + 0.0 AS trend, round(x - y, 6) + 0.0 AS residual FROM s""")
def _(spark, sf):
    return at_rows(D.decompose_ma(series(spark, sf)), "trend", "residual")


@query("multi_width_decomposition", "H6", f"""WITH {SERIES_SQL}, s AS (SELECT *, {sma_sql(9, 'a')}, {sma_sql(25, 'b')} FROM ser {W_SQL})
SELECT source, window_id, channel, t, round((a + b) / 2, 6) + 0.0 AS trend, round(x - (a + b) / 2, 6) + 0.0 AS residual FROM s""")
def _(spark, sf):
    return at_rows(D.decompose_ma_multi(series(spark, sf), [9, 25]), "trend", "residual")


def energy_sql(low, tau, src="dft"):
    keep = max(5, int(51 * low))
    return f"""share AS (SELECT *, sum(CASE WHEN bin = 0 THEN 0 ELSE re * re + im * im END) OVER (PARTITION BY source,
      window_id, channel ORDER BY bin) / (sum(CASE WHEN bin = 0 THEN 0 ELSE re * re + im * im END) OVER (PARTITION BY source,
      window_id, channel) + 1e-8) AS r FROM {src}),
    kept AS (SELECT * FROM share WHERE r <= {tau} OR bin < {keep})"""


@query("energy_filtered_series", "H7", f"""WITH {DFT_SQL}, {energy_sql(0.4, 0.95)}, {INVERSE_SQL}
SELECT source, window_id, channel, t, round(y, 5) + 0.0 AS seasonal FROM inv""")
def _(spark, sf):
    return at_rows(D.dft_energy_filter(series(spark, sf)), "seasonal", digits=5)


@query("strongest_frequencies", "H8", f"""WITH {DFT_SQL},
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, window_id, channel ORDER BY re * re + im * im DESC, bin)
  AS rn FROM dft WHERE bin >= 1 AND bin < 20) WHERE rn <= 5), {INVERSE_SQL}
SELECT source, window_id, channel, t, round(y, 5) + 0.0 AS seasonal, round(x - y, 5) + 0.0 AS trend
FROM inv JOIN ser USING (source, window_id, channel, t)""")
def _(spark, sf):
    return at_rows(D.dft_topk(series(spark, sf)), "seasonal", "trend", digits=5)


# trend, then the energy-filtered part of what it leaves: d in ``rest``, y in ``inv``
HYBRID_SQL = f"""e AS {ema_sql()},
rest AS MATERIALIZED (SELECT source, window_id, channel, t, y AS trend, x - y AS d FROM e JOIN ser USING (source, window_id, channel, t)),
dft AS MATERIALIZED (SELECT source, window_id, channel, b AS bin, sum(d * cos(2 * pi() * ((b * t) % 100) / 100)) AS re,
  -sum(d * sin(2 * pi() * ((b * t) % 100) / 100)) AS im FROM rest, (SELECT unnest(range(51)) AS b) GROUP BY ALL),
{energy_sql(0.5, 0.97)}, {INVERSE_SQL}"""


@query("hybrid_decomposition", "H9", f"""WITH {SERIES_SQL}, {HYBRID_SQL}
SELECT source, window_id, channel, t, round(trend + {NUDGE}, 5) + 0.0 AS trend, round(y + {NUDGE}, 5) + 0.0 AS seasonal,
  round(d - y + {NUDGE}, 5) + 0.0 AS residual FROM inv JOIN rest USING (source, window_id, channel, t)""")
def _(spark, sf):
    return at_rows(D.decompose(series(spark, sf)), "trend", "seasonal", "residual", digits=5, nudge=NUDGE)


@query("hodrick_prescott", "H10")
def _(spark, sf):
    return at_rows(D.hp_filter(series(spark, sf)), "trend", "residual", digits=5)


@query("hodrick_prescott_equation", "H10", f"""WITH {SERIES_SQL}
SELECT source, window_id, channel, t, round(x + {NUDGE}, 3) + 0.0 AS restored, round(x + {NUDGE}, 3) + 0.0 AS total FROM ser""")
def _(spark, sf):
    """The trend's own equation: (I + lamb D'D) trend = x, with second differences D; and trend + residual = x."""
    y = F.col("trend")
    second = F.transform(F.sequence(F.lit(1), F.size(y) - 2), lambda i: F.get(y, i - 1) - 2 * F.get(y, i) + F.get(y, i + 1))
    s = D.hp_filter(series(spark, sf), 50.0).withColumn("d", second)
    at = lambda i: F.coalesce(F.when(i >= 0, F.get("d", i)), F.lit(0.0))
    restored = F.transform(y, lambda v, i: v + 50.0 * (at(i) - 2 * at(i - 1) + at(i - 2)))
    s = s.withColumn("restored", restored).withColumn("total", F.zip_with("trend", "residual", lambda a, b: a + b))
    return at_rows(s, "restored", "total", digits=3, nudge=NUDGE)


@query("low_passed_series", "H11", f"""WITH {DFT_SQL}, kept AS (SELECT * FROM dft WHERE bin < 10), {INVERSE_SQL}
SELECT source, window_id, channel, t, round(y, 5) + 0.0 AS smooth FROM inv""")
def _(spark, sf):
    return at_rows(D.lowpass(series(spark, sf), 10), "smooth", digits=5)


ACF_LAG = 40


def acf_sql(src, by):
    b = by + ", " if by else ""
    on = f"a.{by} = b.{by} AND " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    tall = " UNION ALL ".join(
        f"""SELECT {b}'{f}' AS feature, row_number() OVER ({part}ORDER BY ts, event_id) AS p,
          ({f} - avg({f}) OVER ({part})) / (stddev_pop({f}) OVER ({part}) + 1e-8) AS z,
          count(*) OVER ({part}) AS n FROM {src}""" for f in FEATURES)
    return f"""z AS ({tall}),
    zl AS MATERIALIZED (SELECT *, CAST(unnest(range({ACF_LAG + 1})) AS INTEGER) AS lag FROM z),
    lagged AS (SELECT {'a.' + by + ', ' if by else ''}a.feature, a.n, a.lag, sum(a.z * b.z) AS s
      FROM zl a JOIN z b ON {on}a.feature = b.feature AND b.p = a.p + a.lag GROUP BY ALL),
    acf AS (SELECT *, s / first_value(s) OVER (PARTITION BY {b}feature ORDER BY lag) AS r FROM lagged)"""


@query("autocorrelation", "H12", f"""WITH {FLOWS_SQL}, {acf_sql('flows', '')}
SELECT feature, lag, round(r, 6) + 0.0 AS r, n FROM acf""")
def _(spark, sf):
    a = M.acf(flows(spark, sf), FEATURES, EVENT_ORDER, ACF_LAG)
    return a.select("feature", "lag", (F.round("r", 6) + 0.0).alias("r"), "n")


# the autocorrelation of a smoothed day-long curve, which has memory worth measuring
SMOOTH_SQL = FLOWS_SQL + """,
curve AS (SELECT ts, event_id, label, sum(value) OVER w AS value, sum(k) OVER w AS k FROM flows
          WINDOW w AS (PARTITION BY source ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


def curve(spark, sf):
    sums = {f"_{f}": (lambda f=f: F.sum(f)) for f in FEATURES}
    rows = LS.framed(flows(spark, sf), ["source"], EVENT_ORDER, sums, 9)
    return rows.select("ts", "event_id", "label", *[F.col(f"_{f}").alias(f) for f in FEATURES])


def memory_sql(by=""):
    b = by + ", " if by else ""
    return f"""cr AS (SELECT *, 1.959963984540054 / sqrt(n) AS critical FROM acf),
    sig AS (SELECT *, lead(lag) OVER (PARTITION BY {b}feature ORDER BY lag) AS nxt FROM cr WHERE abs(r) > critical),
    mem AS (SELECT {b}feature, coalesce(min(lag) FILTER (nxt IS NULL OR nxt - lag > 1), 0) AS memory, max(critical) AS critical,
      max(n) AS n FROM sig GROUP BY ALL)"""


@query("memory_length", "H13", f"""WITH {SMOOTH_SQL}, {acf_sql('curve', '')}, {memory_sql()}
SELECT feature, memory, round(critical, 6) AS critical, n FROM mem""")
def _(spark, sf):
    return rounded(M.memory_length(M.acf(curve(spark, sf), FEATURES, EVENT_ORDER, ACF_LAG)))


@query("memory_length_tolerant", "H13", f"""WITH {SMOOTH_SQL}, {acf_sql('curve', '')},
cr AS (SELECT *, 1.959963984540054 / sqrt(n) AS critical FROM acf),
sig AS (SELECT *, lead(lag) OVER (PARTITION BY feature ORDER BY lag) AS nxt FROM cr WHERE abs(r) > critical),
a AS (SELECT feature, min(lag) FILTER (nxt IS NULL OR nxt - lag > 5) AS a, max(critical) AS critical, max(n) AS n
  FROM sig GROUP BY feature),
q AS (SELECT feature, lag, sum(CASE WHEN lag >= 1 AND abs(r) < 2 * critical THEN 1 ELSE 0 END) OVER (PARTITION BY feature
  ORDER BY lag ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS run FROM cr),
b AS (SELECT feature, coalesce(min(lag) FILTER (run = 5) - 5, max(lag)) AS b FROM q GROUP BY feature)
SELECT feature, CAST(least(a, b, {ACF_LAG // 2}) AS INTEGER) AS memory, round(critical, 6) AS critical, n FROM a JOIN b USING (feature)""")
def _(spark, sf):
    a = M.acf(curve(spark, sf), FEATURES, EVENT_ORDER, ACF_LAG)
    return rounded(M.memory_length(a, variant="tolerant", max_lag=ACF_LAG))


CLASS_SQL = FLOWS_SQL + """, two AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'attack' ELSE 'benign' END AS class FROM flows)"""


@query("memory_by_class", "H14", f"""WITH {CLASS_SQL}, {acf_sql('two', 'class')}, {memory_sql('class')}
SELECT class, feature, memory, round(critical, 6) AS critical, n FROM mem""")
def _(spark, sf):
    f = flows(spark, sf).withColumn("label", F.when(F.col("event_id") % 3 == 0, "error").otherwise("Benign"))
    return rounded(M.memory_by_class(f, FEATURES, EVENT_ORDER, ACF_LAG))


WEIGHTS = [("value", 0.7), ("k", 0.2)]
WEIGHTS_SQL = "weights AS (SELECT * FROM (VALUES ('value', 0.7), ('k', 0.2)) v(feature, weight))"


@query("weighted_memory", "H15", f"""WITH {SMOOTH_SQL}, {acf_sql('curve', '')}, {memory_sql()}, {WEIGHTS_SQL}
SELECT round(CAST(sum(weight * memory) / sum(weight) AS DOUBLE), 6) AS weighted_memory FROM mem JOIN weights USING (feature)""")
def _(spark, sf):
    m = M.memory_length(M.acf(curve(spark, sf), FEATURES, EVENT_ORDER, ACF_LAG))
    return rounded(M.weighted_memory(m, spark.createDataFrame(WEIGHTS, "feature string, weight double")))


@query("window_size_advice", "H16", f"""WITH {SMOOTH_SQL}, {acf_sql('curve', '')}, {memory_sql()},
o AS (SELECT avg(memory) AS memory FROM mem),
s AS (SELECT memory, CAST(floor(memory * 0.8) AS BIGINT) AS conservative, CAST(floor(memory * 1.2) AS BIGINT) AS recommended,
  CAST(floor(memory * 2.0) AS BIGINT) AS aggressive, size FROM o, (SELECT CAST(unnest([5, 8, 10, 12, 20, 40]) AS BIGINT) AS size))
SELECT round(memory, 6) AS memory, conservative, recommended, aggressive, size, round(size / recommended, 6) AS ratio,
  CASE WHEN size / recommended BETWEEN 0.8 AND 1.2 THEN 'recommended' WHEN size / recommended BETWEEN 0.5 AND 2.0
  THEN 'acceptable' ELSE 'not recommended' END AS verdict FROM s""")
def _(spark, sf):
    m = M.memory_length(M.acf(curve(spark, sf), FEATURES, EVENT_ORDER, ACF_LAG))
    return rounded(M.recommend_window(m, [5, 8, 10, 12, 20, 40]))


@query("dominant_periods", "H17", f"""WITH {SERIES_SQL},
n AS (SELECT *, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5) AS z FROM ser WINDOW w AS (PARTITION BY source, window_id, channel)),
half AS (SELECT a.source, a.window_id, a.channel, d, sum(a.z * b.z) AS c FROM n a CROSS JOIN (SELECT unnest(range(51)) AS d)
  JOIN n b ON a.source = b.source AND a.window_id = b.window_id AND a.channel = b.channel AND b.t = (a.t + d) % 100 GROUP BY ALL),
corr AS (SELECT * FROM half UNION ALL SELECT source, window_id, channel, 100 - d, c FROM half WHERE d BETWEEN 1 AND 49),
top AS (SELECT *, row_number() OVER (PARTITION BY source, window_id, channel ORDER BY c DESC, d) - 1 AS rank FROM corr),
k AS (SELECT *, max(c) OVER (PARTITION BY source, window_id, channel) AS m FROM top WHERE rank < 4)
SELECT source, window_id, channel, rank, d AS delay,
  round(exp(c - m) / sum(exp(c - m)) OVER (PARTITION BY source, window_id, channel), 6) AS weight FROM k""")
def _(spark, sf):
    p = D.dominant_periods(G.instance_norm(series(spark, sf)).drop("centre", "scale"))
    return p.select("source", "window_id", "channel", F.col("rank").cast("bigint").alias("rank"),
                    F.col("delay").cast("bigint").alias("delay"), F.round("weight", 6).alias("weight"))


@query("delay_aggregated_series", "H17", f"""WITH {SERIES_SQL},
n AS (SELECT *, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5) AS z FROM ser WINDOW w AS (PARTITION BY source, window_id, channel)),
half AS (SELECT a.source, a.window_id, a.channel, d, sum(a.z * b.z) AS c FROM n a CROSS JOIN (SELECT unnest(range(51)) AS d)
  JOIN n b ON a.source = b.source AND a.window_id = b.window_id AND a.channel = b.channel AND b.t = (a.t + d) % 100 GROUP BY ALL),
corr AS (SELECT * FROM half UNION ALL SELECT source, window_id, channel, 100 - d, c FROM half WHERE d BETWEEN 1 AND 49),
top AS (SELECT *, row_number() OVER (PARTITION BY source, window_id, channel ORDER BY c DESC, d) - 1 AS rank FROM corr),
k AS (SELECT *, max(c) OVER (PARTITION BY source, window_id, channel) AS m FROM top WHERE rank < 4),
w AS (SELECT source, window_id, channel, d, exp(c - m) / sum(exp(c - m)) OVER (PARTITION BY source, window_id, channel) AS weight FROM k)
SELECT n.source, n.window_id, n.channel, n.t, round(sum(w.weight * o.z), 5) + 0.0 AS aggregated FROM n JOIN w USING (source, window_id, channel)
  JOIN n o ON o.source = n.source AND o.window_id = n.window_id AND o.channel = n.channel AND o.t = (n.t + w.d) % 100 GROUP BY ALL""")
def _(spark, sf):
    n = G.instance_norm(series(spark, sf)).drop("centre", "scale")
    return at_rows(D.delay_aggregate(n), "aggregated", digits=5)


# ---- long series ---------------------------------------------------------------------------------------------------

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
LINE_SERIES = f"""line AS (SELECT l_returnflag AS key, l_orderkey AS id, l_linenumber AS line, l_extendedprice AS x,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY {', '.join(LINE_ORDER)}) - 1 AS pos FROM lineitem)"""


def long_ema_sql(src, out, alpha, terms):
    """Exponential average as a weighted sum of the last ``terms`` values: weights beyond are below 1e-16."""
    return f"""{out} AS MATERIALIZED (SELECT a.key, a.pos, sum(b.x * CASE WHEN b.pos = 0 THEN pow({1 - alpha}, i) ELSE {alpha} * pow({1 - alpha}, i) END) AS x
  FROM (SELECT key, pos, unnest(range(least(pos + 1, {terms}))) AS i FROM {src}) a JOIN {src} b ON b.key = a.key AND b.pos = a.pos - a.i GROUP BY a.key, a.pos)"""


def line_series(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_ORDER, "l_returnflag")


@query("long_series_ema", "H3", f"""WITH {LINE_SERIES}, {long_ema_sql('line', 'one', 0.1, 350)}
SELECT key, id, line, l.x AS value, round(one.x, 2) AS trend FROM line l JOIN one USING (key, pos)""")
def _(spark, sf):
    e = LS.exponential_mean(line_series(spark, sf), ["l_returnflag"], LINE_ORDER, "l_extendedprice", 0.1)
    return e.select(F.col("l_returnflag").alias("key"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                    F.col("l_extendedprice").alias("value"), F.round("trend", 2).alias("trend"))


@query("long_series_double_ema", "H4", f"""WITH {LINE_SERIES}, {long_ema_sql('line', 'one', 0.3, 110)}, {long_ema_sql('one', 'two', 0.3, 110)}
SELECT key, id, line, round(2 * one.x - two.x, 2) AS trend FROM line JOIN one USING (key, pos) JOIN two USING (key, pos)""")
def _(spark, sf):
    e = LS.exponential_mean(line_series(spark, sf), ["l_returnflag"], LINE_ORDER, "l_extendedprice", 0.3, double=True)
    return e.select(F.col("l_returnflag").alias("key"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                    F.round("trend", 2).alias("trend"))


@query("long_series_decomposition", "H1 H2 H5", f"""WITH {LINE_SERIES},
m AS (SELECT *, avg(x) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS trend,
  avg(x) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS past FROM line)
SELECT key, id, line, round(trend, 2) AS trend, round(x - trend, 2) + 0.0 AS residual, round(past, 2) AS past FROM m""")
def _(spark, sf):
    means = {"trend": (12, 12), "past": (24, 0)}
    rows = line_series(spark, sf)
    for name, (before, after) in means.items():
        rows = LS.framed(rows, ["l_returnflag"], LINE_ORDER, {name: lambda: F.avg("l_extendedprice")}, before, after)
    return rows.select(F.col("l_returnflag").alias("key"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
                       F.round("trend", 2).alias("trend"), (F.round(F.col("l_extendedprice") - F.col("trend"), 2) + 0.0).alias("residual"),
                       F.round("past", 2).alias("past"))


@query("series_files_ema", "H3 A1", f"""WITH series AS (SELECT CAST(ascii(o_orderstatus) AS DOUBLE) AS key, o_totalprice AS x,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders), {long_ema_sql('series', 'one', 0.3, 110)}
SELECT key AS code, CAST(pos AS INTEGER) AS t, round(x, 2) AS trend FROM one""")
def _(spark, sf):
    from flowpane.operators.ordered import with_position
    from flowpane.sources.readers import read_series
    from workload.cleaning import scratch_path
    path = scratch_path(spark, "series")
    o = with_position(table(spark, sf, "orders"), ["o_orderstatus"], ["o_orderdate", "o_orderkey"])
    rows = o.select(F.col("pos").alias("time_step"), F.col("o_totalprice").alias("value"), F.ascii("o_orderstatus").alias("code"))
    rows.repartition("code").sortWithinPartitions("time_step").write.option("header", True).csv(path)
    e = LS.exponential_mean(read_series(spark, path), ["series_id", "code"], ["t"], "value", 0.3)
    return e.select("code", "t", F.round("trend", 2).alias("trend"))


PROTO_SQL = """proto AS (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(range(1, 65)) AS i,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label, i),
nrm AS (SELECT label, sqrt(sum(v * v)) AS n FROM proto GROUP BY label),
cosine AS (SELECT a.label AS a, b.label AS b, sum(a.v * b.v) / (max(na.n) * max(nb.n)) AS cosine FROM proto a JOIN proto b USING (i)
  JOIN nrm na ON na.label = a.label JOIN nrm nb ON nb.label = b.label GROUP BY a.label, b.label)"""


@query("prototype_cosines", "H18", f"""WITH {PROTO_SQL} SELECT a, b, round(cosine, 6) AS cosine FROM cosine""")
def _(spark, sf):
    p = V.prototypes(table(spark, sf, "embeddings"), "label", "embedding")
    return rounded(V.cosine_matrix(p, "label", "vector"))


@query("prototype_cosine_summary", "H18", f"""WITH {PROTO_SQL} SELECT round(avg(cosine), 6) AS mean, round(max(cosine), 6) AS max,
round(min(cosine), 6) AS min FROM cosine WHERE a <> b""")
def _(spark, sf):
    p = V.prototypes(table(spark, sf, "embeddings"), "label", "embedding")
    return rounded(V.cosine_summary(p, "label", "vector"))


@query("embedding_cosine_summary", "H18", """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
c AS (SELECT list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.vec_id < b.vec_id)
SELECT round(avg(c), 6) AS mean, round(max(c), 6) AS max, round(min(c), 6) AS min FROM c""")
def _(spark, sf):
    return rounded(V.cosine_summary(table(spark, sf, "embeddings"), "vec_id", "embedding"))
