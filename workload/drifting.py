"""Queries over drift between splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowpane.operators import discrepancy as Y
from flowpane.operators import drift as I
from flowpane.operators import splits as X
from flowpane.operators import window_features as G
from flowpane.operators import windows as win
from flowpane.plans.drift_job import shift_of
from flowpane.plans.window_job import build_window_set
from flowpane.session import materialise
from workload.inputs import EVENT_ORDER, FEATURES, SPEC, SPLIT_SQL, flows, positioned, query, table
from workload.splitting import HASH_SQL, rounded, with_labels

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_SQL = "tall AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 'a' ELSE 'b' END AS side, {f} AS value FROM lineitem"
    for f in LINE_FEATURES) + ")"


def line_tall(spark, sf):
    """All rows of ``lineitem``: shipped before mid-1998 against shipped later."""
    side = F.when(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp_ntz"), "a").otherwise("b")
    return G.tall(table(spark, sf, "lineitem").withColumn("side", side), LINE_FEATURES, ["side"])


DIST_SQL = """
cnt AS (SELECT {by}, value, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM {src} GROUP BY ALL),
cdf AS (SELECT {by}, value, sum(a) OVER w / sum(a) OVER (PARTITION BY {by}) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY {by}) AS fb,
  lead(value) OVER w - value AS step, sum(a) OVER (PARTITION BY {by}) AS na, sum(b) OVER (PARTITION BY {by}) AS nb
  FROM cnt WINDOW w AS (PARTITION BY {by} ORDER BY value)),
dist AS (SELECT {by}, max(abs(fa - fb)) AS ks, sum(abs(fa - fb) * coalesce(step, 0)) AS wasserstein,
  CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b FROM cdf GROUP BY {by})"""
PVALUE_SQL = """
pv AS (SELECT d.*, CASE WHEN ks * ks * (CAST(n_a AS DOUBLE) * n_b / (n_a + n_b)) < 0.04 THEN 1.0 ELSE
  least(greatest(2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * ks * ks * (CAST(n_a AS DOUBLE) * n_b / (n_a + n_b))))
  FROM (SELECT unnest(range(1, 101)) AS k)), 0), 1) END AS p_value FROM dist d)"""

# window series of the event flows with split and label
SER_SPLIT_SQL = SPLIT_SQL + """,
wrow AS (SELECT s.split, s.is_malicious, w.source, w.window_id, w.woff AS t, w.value, w.k FROM split s JOIN win w USING (source, window_id)),
wtall AS (SELECT split, is_malicious, source, window_id, t, 'value' AS feature, value FROM wrow
  UNION ALL SELECT split, is_malicious, source, window_id, t, 'k', k FROM wrow)"""
PAIR_SQL = SER_SPLIT_SQL + """,
paired AS (SELECT p AS pair, CASE WHEN split = 'train' THEN 'a' ELSE 'b' END AS side, feature, value
  FROM wtall, (SELECT unnest(['A', 'B']) AS p)
  WHERE (split = 'train' AND is_malicious = 0) OR (split = 'test' AND (p = 'A' OR is_malicious = 0)))"""
SPEC_SQL = SER_SPLIT_SQL + """,
amps AS (SELECT split, is_malicious, source, window_id, feature AS channel, b AS bin,
  ln(1 + sqrt(pow(sum(value * cos(2 * pi() * ((b * t) % 100) / 100)), 2) + pow(sum(value * sin(2 * pi() * ((b * t) % 100) / 100)), 2))) AS amp
  FROM wtall, (SELECT unnest(range(51)) AS b) GROUP BY ALL),
spec AS (SELECT *, CASE split WHEN 'train' THEN 'a' WHEN 'test' THEN 'b' END AS side, round(amp, 7) AS value FROM amps
  WHERE is_malicious = 0 AND split IN ('train', 'test'))"""


def split_series(spark, sf):
    """Window series with label and split: the split comes from the window's place, no join with metadata."""
    pos = positioned(spark, sf)
    sizes = materialise(win.source_sizes(pos, SPEC))
    s = win.integrate(win.window_series(pos, SPEC, FEATURES), sizes, SPEC)
    return X.split_chrono(s, X.total_windows(sizes))


def spectra(spark, sf, digits=7):
    s = G.rfft_amplitude(split_series(spark, sf))
    return s.withColumn("amp", F.transform("amp", lambda a: F.round(a, digits)))


@query("feature_moments", "I1", f"""WITH {LINE_SQL},
z AS (SELECT *, avg(value) OVER p AS m, stddev_pop(value) OVER p AS sd FROM tall WINDOW p AS (PARTITION BY feature, side)),
g AS (SELECT feature, side, max(m) AS mean, max(sd) AS std, avg(pow((value - m) / sd, 3)) AS skew,
  avg(pow((value - m) / sd, 4)) - 3 AS kurtosis FROM z GROUP BY feature, side),
w AS (SELECT a.feature, a.mean AS mean_a, a.std AS std_a, a.skew AS skew_a, a.kurtosis AS kurtosis_a, b.mean AS mean_b,
  b.std AS std_b, b.skew AS skew_b, b.kurtosis AS kurtosis_b FROM g a JOIN g b USING (feature) WHERE a.side = 'a' AND b.side = 'b')
SELECT feature, round(mean_a, 5) + 0.0 AS mean_a, round(std_a, 5) AS std_a, round(skew_a, 5) + 0.0 AS skew_a, round(kurtosis_a, 5) AS kurtosis_a,
  round(mean_b, 5) AS mean_b, round(std_b, 5) AS std_b, round(skew_b, 5) + 0.0 AS skew_b, round(kurtosis_b, 5) AS kurtosis_b,
  round(abs(mean_a - mean_b), 5) AS mean_gap, round(std_b / (std_a + 1e-10), 5) AS std_ratio FROM w""")
def _(spark, sf):
    return rounded(I.feature_moments(line_tall(spark, sf)), 5)


@query("distribution_distances", "I2 I4", f"""WITH {LINE_SQL}, {DIST_SQL.format(by='feature', src='tall')}
SELECT feature, round(ks, 6) AS ks, round(wasserstein, 5) AS wasserstein, n_a, n_b FROM dist""")
def _(spark, sf):
    d = I.distribution_distances(line_tall(spark, sf))
    return rounded(d.withColumn("wasserstein", F.round("wasserstein", 5)))


@query("ks_significance", "I3", f"""WITH {LINE_SQL}, {DIST_SQL.format(by='feature', src='tall')}, {PVALUE_SQL}
SELECT feature, round(ks, 6) AS ks, round(CAST(p_value AS DOUBLE), 6) AS p_value, p_value < 0.05 AS significant FROM pv""")
def _(spark, sf):
    d = I.with_significance(I.distribution_distances(line_tall(spark, sf)))
    return rounded(d.select("feature", "ks", "p_value", "significant"))


def line_vectors(spark, sf):
    """Scaled ``lineitem`` rows as vectors."""
    side = F.when(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp_ntz"), "a").otherwise("b")
    return table(spark, sf, "lineitem").select(
        side.alias("side"), (F.col("l_quantity") / 50).alias("q"), (F.col("l_extendedprice") / 100000).alias("p"),
        (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 10).alias("x"))


def as_vector(df, *cols):
    return df.withColumn("vector", F.array(*cols)).drop(*cols)


def fourier_sql(cols, rows, by=""):
    """``ker``: the discrepancy of ``rows`` (by, side, cols) with the widths of ``gam`` (by, g), by the same frequencies."""
    u = lambda part: f"(({HASH_SQL.format(k=f"j || '/' || c || '/{part}'", seed=SEED)}) + 0.5) / 4294967296"
    b, on = (by + ", ", f"USING ({by})") if by else ("", "ON true")
    phase = " + ".join(f"w{i} * {c}" for i, c in enumerate(cols))
    return f"""draw AS (SELECT j, c, sqrt(-2 * ln({u(0)})) * cos(2 * pi() * {u(1)}) AS z
  FROM (SELECT unnest(range({Y.FREQUENCIES})) AS j), (SELECT unnest(range({len(cols)})) AS c)),
freq AS MATERIALIZED (SELECT j, {', '.join(f'max(z) FILTER (c = {i}) AS w{i}' for i in range(len(cols)))} FROM draw GROUP BY j),
feat AS (SELECT {b}side, j, avg(cos(sqrt(2 * g) * ({phase}))) AS c, avg(sin(sqrt(2 * g) * ({phase}))) AS s
  FROM {rows} JOIN gam {on}, freq GROUP BY {b}side, j),
ker AS (SELECT {b}avg(pow(a.c - b.c, 2) + pow(a.s - b.s, 2)) AS m2
  FROM feat a JOIN feat b USING ({b}j) WHERE a.side = 'a' AND b.side = 'b' {'GROUP BY ' + by if by else ''})"""


def width_sql(cols, rows, by=""):
    """``gam``: kernel widths from the mean squared distance between the sides."""
    squares = " + ".join(f"pow({c}, 2)" for c in cols)
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(cols))
    dots = " + ".join(f"a.m{i} * b.m{i}" for i in range(len(cols)))
    b = by + ", " if by else ""
    return f"""mom AS (SELECT {b}side, avg({squares}) AS m, {means} FROM {rows} GROUP BY {b}side),
gam AS (SELECT {'a.' + b if by else ''}1.0 / (2 * (a.m + b.m - 2 * ({dots})) + 1e-10) AS g FROM mom a JOIN mom b {f'USING ({by})' if by else 'ON true'}
  WHERE a.side = 'a' AND b.side = 'b')"""


SEED = 5
VEC_COLS = ["q", "p", "d", "x"]
VEC_SQL = """vec AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 'a' ELSE 'b' END AS side,
  l_quantity / 50 AS q, l_extendedprice / 100000 AS p, l_discount * 10 AS d, l_tax * 10 AS x FROM lineitem)"""


@query("mmd_given_gamma", "I5", f"""WITH {VEC_SQL}, gam AS (SELECT CAST(0.5 AS DOUBLE) AS g), {fourier_sql(VEC_COLS, 'vec')}
SELECT g AS gamma, round(m2, 7) AS mmd2, round(sqrt(m2), 6) AS mmd FROM ker, gam""")
def _(spark, sf):
    m = Y.mmd(as_vector(line_vectors(spark, sf), *VEC_COLS), (), 0.5, seed=SEED)
    return m.select("gamma", F.round("mmd2", 7).alias("mmd2"), F.round("mmd", 6).alias("mmd"))


@query("mmd_mean_gamma", "I5", f"""WITH {VEC_SQL}, {width_sql(VEC_COLS, 'vec')}, {fourier_sql(VEC_COLS, 'vec')}
SELECT round(g, 6) AS gamma, round(m2, 7) AS mmd2, round(sqrt(m2), 6) AS mmd FROM ker, gam""")
def _(spark, sf):
    m = Y.mmd(as_vector(line_vectors(spark, sf), *VEC_COLS), seed=SEED)
    return m.select(F.round("gamma", 6).alias("gamma"), F.round("mmd2", 7).alias("mmd2"), F.round("mmd", 6).alias("mmd"))


# moments of cells, cells against cells through Hermite functions; a test holds the operator against all pairs
def gauss_sql(cols):
    return f"""tallv AS MATERIALIZED (UNPIVOT (SELECT side, {', '.join(cols)} FROM vec) ON {', '.join(cols)} INTO NAME feature VALUE v),
facts AS (SELECT feature, g, avg(v) AS mid, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb
  FROM tallv JOIN fgam USING (feature) GROUP BY feature, g),
spot AS (SELECT feature, CASE WHEN side = 'a' THEN 1.0 / na ELSE -1.0 / nb END AS w, (v - mid) * sqrt(g) / {Y.CELL} AS p FROM tallv JOIN facts USING (feature)),
moment AS MATERIALIZED (SELECT feature, CAST(floor(p) AS BIGINT) AS cell, j, sum(w * pow(p - floor(p) - 0.5, j)) AS m
  FROM spot, (SELECT unnest(range({Y.ORDERS})) AS j) GROUP BY ALL),
herm AS (WITH RECURSIVE h(o, n, a, b) AS (
    SELECT o, 0, exp(-pow(o * {Y.CELL}, 2)), 2 * o * {Y.CELL} * exp(-pow(o * {Y.CELL}, 2)) FROM (SELECT unnest(range(-26, 27)) AS o)
    UNION ALL SELECT o, n + 1, b, 2 * o * {Y.CELL} * b - 2 * (n + 1) * a FROM h WHERE n < {Y.ORDERS - 1}) SELECT o, n, a FROM h),
form AS (SELECT o, j, n - j AS k, pow({Y.CELL}, n) * a * pow(-1, n - j) / (factorial(CAST(j AS INTEGER)) * factorial(CAST(n - j AS INTEGER))) AS c
  FROM herm, (SELECT unnest(range({Y.ORDERS})) AS j) WHERE j <= n),
fm AS (SELECT x.feature, greatest(sum(x.m * c * y.m), 0) AS m2 FROM moment x JOIN form USING (j) JOIN moment y
  ON y.feature = x.feature AND y.cell = x.cell + form.o AND y.j = form.k GROUP BY x.feature)"""


GAUSS_SQL = gauss_sql(VEC_COLS)
FIXED_WIDTHS = "fgam AS (SELECT unnest(['q', 'p', 'd', 'x']) AS feature, CAST(0.5 AS DOUBLE) AS g)"
def mean_widths(cols):
    return f"""fgam AS (SELECT feature, 1.0 / (2 * (var_pop(v) FILTER (side = 'a') + var_pop(v) FILTER (side = 'b')
  + pow(avg(v) FILTER (side = 'a') - avg(v) FILTER (side = 'b'), 2)) + 1e-10) AS g
  FROM (UNPIVOT (SELECT side, {', '.join(cols)} FROM vec) ON {', '.join(cols)} INTO NAME feature VALUE v) GROUP BY feature)"""


def feature_mmd(spark, sf, gamma=0.5):
    return Y.mmd_per_feature(G.tall(line_vectors(spark, sf), VEC_COLS, ["side"]), gamma)


@query("mmd_per_feature", "I6", f"""WITH {VEC_SQL}, {FIXED_WIDTHS}, {GAUSS_SQL} SELECT feature, round(m2, 7) AS mmd2 FROM fm""")
def _(spark, sf):
    return feature_mmd(spark, sf).select("feature", F.round("mmd2", 7).alias("mmd2"))


@query("mmd_per_feature_mean_gamma", "I6", f"""WITH {VEC_SQL}, {mean_widths(VEC_COLS)}, {GAUSS_SQL}
SELECT feature, round(g, 5) AS gamma, round(m2, 7) AS mmd2 FROM fm JOIN fgam USING (feature)""")
def _(spark, sf):
    return feature_mmd(spark, sf, None).select("feature", F.round("gamma", 5).alias("gamma"), F.round("mmd2", 7).alias("mmd2"))


@query("mmd_outliers", "I14", f"""WITH {VEC_SQL}, {FIXED_WIDTHS}, {GAUSS_SQL}
SELECT feature, sqrt(m2) > avg(sqrt(m2)) OVER () + stddev_pop(sqrt(m2)) OVER () AS outlier FROM fm""")
def _(spark, sf):
    return I.mmd_outliers(feature_mmd(spark, sf)).select("feature", "outlier")


LABEL_SHIFT_SQL = """ls AS (SELECT count(*) FILTER (split = 'train') AS total_a, count(*) FILTER (split = 'train' AND is_malicious = 1) AS positive_a,
count(*) FILTER (split = 'test') AS total_b, count(*) FILTER (split = 'test' AND is_malicious = 1) AS positive_b FROM split)"""


@query("label_shift", "I7", f"""WITH {SPLIT_SQL}, {LABEL_SHIFT_SQL}
SELECT *, round(positive_a / total_a, 6) AS ratio_a, round(positive_b / total_b, 6) AS ratio_b,
  round(abs(positive_a / total_a - positive_b / total_b), 6) AS ratio_gap FROM ls""")
def _(spark, sf):
    m, n = with_labels(spark, sf)
    return rounded(I.label_shift(X.split_chrono(m, n)))


REPORT_SQL = """f AS (SELECT (SELECT sqrt(m2) FROM ker) AS m, (SELECT abs(positive_a / total_a - positive_b / total_b) FROM ls) AS gap,
  (SELECT count(*) FILTER (p_value < 0.05) FROM pv) AS sig, (SELECT count(*) FROM pv) AS total)
SELECT 'mmd' AS section, CAST(1 AS INTEGER) AS rank, CASE WHEN m > 0.1 THEN 'significant' WHEN m > 0.01 THEN 'moderate' ELSE 'minor' END AS item,
  round(m, 5) AS value FROM f
UNION ALL SELECT 'labels', 1, CASE WHEN gap > 0.1 THEN 'warning' ELSE 'stable' END, round(gap, 5) FROM f
UNION ALL SELECT 'ks_summary', 1, sig || '/' || total || ' features', round(sig / total, 5) FROM f
UNION ALL SELECT 'conclusion', 1, CASE WHEN sig / total > 0.5 AND m > 0.05 THEN 'significant: natural drift is sufficient'
  WHEN sig / total > 0.3 THEN 'moderate: combine natural and synthetic drift' ELSE 'minor: construct synthetic drift' END, NULL FROM f
UNION ALL SELECT 'top_ks', CAST(row_number() OVER (ORDER BY ks DESC, feature) AS INTEGER), feature, round(ks, 5) FROM pv
UNION ALL SELECT 'top_mmd', CAST(row_number() OVER (ORDER BY m2 DESC, feature) AS INTEGER), feature, round(sqrt(m2), 5) FROM fm"""


@query("shift_report", "I8", f"""WITH {SPLIT_SQL}, {LABEL_SHIFT_SQL},
{LINE_SQL.replace('tall AS', 'ltall AS')}, {DIST_SQL.format(by='feature', src='ltall')}, {PVALUE_SQL},
{VEC_SQL}, gam AS (SELECT CAST(0.5 AS DOUBLE) AS g), {fourier_sql(VEC_COLS, 'vec')}, {FIXED_WIDTHS}, {GAUSS_SQL},
{REPORT_SQL}""")
def _(spark, sf):
    m, n = with_labels(spark, sf)
    v = as_vector(line_vectors(spark, sf), *VEC_COLS)
    d = materialise(I.with_significance(I.distribution_distances(line_tall(spark, sf))))
    return rounded(I.shift_report(d, Y.mmd(v, (), 0.5, seed=SEED), I.label_shift(X.split_chrono(m, n)),
                                  feature_mmd(spark, sf)), 5)


@query("dataset_shift_report", "I2 I3 I5 I6 I7 I8", f"""WITH {SER_SPLIT_SQL}, {LABEL_SHIFT_SQL},
sided AS (SELECT feature, CASE split WHEN 'train' THEN 'a' ELSE 'b' END AS side, value FROM wtall WHERE split IN ('train', 'test')),
{DIST_SQL.format(by='feature', src='sided')}, {PVALUE_SQL},
vec AS MATERIALIZED (SELECT CASE split WHEN 'train' THEN 'a' ELSE 'b' END AS side, value, k FROM wrow WHERE split IN ('train', 'test')),
{width_sql(FEATURES, 'vec')}, {fourier_sql(FEATURES, 'vec')}, {mean_widths(FEATURES)}, {gauss_sql(FEATURES)}, {REPORT_SQL}""")
def _(spark, sf):
    """One data set against itself: the flows of its training windows against those of its test windows."""
    return rounded(shift_of(build_window_set(flows(spark, sf), SPEC, EVENT_ORDER, FEATURES), FEATURES, seed=SEED), 5)


@query("drift_sources", "I9", f"""WITH {PAIR_SQL}, {DIST_SQL.format(by='pair, feature', src='paired')},
j AS (SELECT a.feature, a.ks AS ks_a, b.ks AS ks_b, a.ks - b.ks AS diff FROM dist a JOIN dist b USING (feature) WHERE a.pair = 'A' AND b.pair = 'B')
SELECT feature, round(ks_a, 6) AS ks_a, round(ks_b, 6) AS ks_b, round(diff, 6) + 0.0 AS diff,
  CASE WHEN ks_b > 0.1 AND diff < 0.05 THEN 'Covariate' WHEN diff > 0.1 THEN 'Anomaly' ELSE 'Mixed' END AS source FROM j""")
def _(spark, sf):
    t = I.window_values(split_series(spark, sf), ["split", "is_malicious"])
    d = I.distribution_distances(I.as_pairs(t), ["pair", "feature"])
    return rounded(I.drift_sources(d)).withColumn("diff", F.col("diff") + 0.0)


VERDICT_SQL = PAIR_SQL + """,
vrow AS (SELECT p AS pair, CASE WHEN split = 'train' THEN 'a' ELSE 'b' END AS side, value / 100 AS v, k / 100 AS k
  FROM wrow, (SELECT unnest(['A', 'B']) AS p)
  WHERE (split = 'train' AND is_malicious = 0) OR (split = 'test' AND (p = 'A' OR is_malicious = 0)))"""


@query("drift_verdict", "I9", f"""WITH {VERDICT_SQL}, {width_sql(['v', 'k'], 'vrow', 'pair')}, {fourier_sql(['v', 'k'], 'vrow', 'pair')},
{DIST_SQL.format(by='pair, feature', src='paired')}, {PVALUE_SQL},
sg AS (SELECT count(*) FILTER (p_value < 0.05) / count(*) AS s FROM pv WHERE pair = 'B'),
m AS (SELECT max(sqrt(m2)) FILTER (pair = 'A') AS a, max(sqrt(m2)) FILTER (pair = 'B') AS b FROM ker)
SELECT round(a, 6) AS mmd_a, round(b, 6) AS mmd_b, round(a - b, 6) + 0.0 AS mmd_diff, b > 0.05 AS normal_drifts,
  CASE WHEN b > 0.05 AND s > 0.5 THEN 'adapt the reconstruction baseline' WHEN a > 0.05 THEN 'adapt the threshold' ELSE 'add synthetic drift' END AS advice,
  a - b > 0.03 AS anomalies_matter FROM m, sg""")
def _(spark, sf):
    windows = build_window_set(flows(spark, sf), SPEC, EVENT_ORDER, FEATURES)
    keep = ["split", "is_malicious"]
    d = I.with_significance(I.distribution_distances(
        I.as_pairs(I.window_values(windows.series(FEATURES), keep)), ["pair", "feature"]))
    vec = I.counted_vectors(windows.vectors(FEATURES), keep).withColumn("vector", F.transform("vector", lambda x: x / 100))
    out = rounded(I.drift_verdict(Y.mmd(I.as_pairs(materialise(vec)), ["pair"], seed=SEED, times="n"), d))
    return out.withColumn("mmd_diff", F.col("mmd_diff") + 0.0)


@query("spectral_drift", "I10", f"""WITH {SPEC_SQL}, {DIST_SQL.format(by='bin', src='spec')}
SELECT bin, round(ks, 6) AS ks, round(wasserstein, 5) AS wasserstein, n_a, n_b FROM dist""")
def _(spark, sf):
    s = I.two_sides(spectra(spark, sf).where("is_malicious = 0"), "split", "train", "test")
    d = I.spectral_drift(s)
    return d.select(F.col("bin").cast("bigint").alias("bin"), F.round("ks", 6).alias("ks"),
                    F.round("wasserstein", 5).alias("wasserstein"), "n_a", "n_b")


@query("spectral_band_summary", "I11", f"""WITH {SPEC_SQL}, {DIST_SQL.format(by='bin', src='spec')},
g AS (SELECT avg(wasserstein) AS overall, avg(wasserstein) FILTER (bin < 10) AS low, avg(wasserstein) FILTER (bin >= 40) AS high FROM dist)
SELECT round(overall, 5) AS overall, round(low, 5) AS low, round(high, 5) AS high, round(low / (high + 1e-12), 5) AS low_high_ratio FROM g""")
def _(spark, sf):
    s = I.two_sides(spectra(spark, sf).where("is_malicious = 0"), "split", "train", "test")
    return rounded(I.band_summary(I.spectral_drift(s), "wasserstein", 51), 5)


@query("spectral_drift_by_dataset", "I12", f"""WITH {SPEC_SQL},
both_sets AS (SELECT channel AS dataset, bin, side, value FROM spec WHERE NOT (channel = 'k' AND bin >= 26)),
{DIST_SQL.format(by='dataset, bin', src='both_sets')}
SELECT dataset, bin, round(ks, 6) AS ks, round(wasserstein, 5) AS wasserstein FROM dist WHERE bin < 26""")
def _(spark, sf):
    # each channel stands for a data set; the second has the shorter spectrum
    s = I.two_sides(spectra(spark, sf).where("is_malicious = 0"), "split", "train", "test")
    s = s.withColumn("dataset", F.col("channel")).withColumn(
        "amp", F.when(F.col("channel") == "k", F.slice("amp", 1, 26)).otherwise(F.col("amp")))
    d = I.common_bins(materialise(I.spectral_drift(s, ["dataset"])))
    return d.select("dataset", F.col("bin").cast("bigint").alias("bin"), F.round("ks", 6).alias("ks"),
                    F.round("wasserstein", 5).alias("wasserstein"))


@query("drift_histograms", "I13", f"""WITH {LINE_SQL}, {DIST_SQL.format(by='feature', src='tall')},
top AS (SELECT feature FROM dist ORDER BY ks DESC, feature LIMIT 2),
r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM tall JOIN top USING (feature) GROUP BY feature),
b AS (SELECT feature, side, least(CAST(floor((value - lo) * 80 / (hi - lo)) AS BIGINT), 79) AS bin, lo, hi FROM tall JOIN r USING (feature)),
g AS (SELECT feature, side, bin, lo, hi, count(*) AS n FROM b GROUP BY ALL)
SELECT feature, side, bin, round(lo + bin * ((hi - lo) / 80), 6) AS "left", n,
  round(n / (sum(n) OVER (PARTITION BY feature, side) * ((hi - lo) / 80)), 6) AS density FROM g""")
def _(spark, sf):
    t = line_tall(spark, sf)
    return rounded(I.drift_histograms(t, I.distribution_distances(t), 2))


@query("drift_curve_association", "I15", f"""WITH {SPEC_SQL}, {DIST_SQL.format(by='bin', src='spec')},
r AS (SELECT ks, wasserstein, rank() OVER (ORDER BY ks) + (count(*) OVER (PARTITION BY ks) - 1) / 2.0 AS rk,
  rank() OVER (ORDER BY wasserstein) + (count(*) OVER (PARTITION BY wasserstein) - 1) / 2.0 AS rw
  FROM (SELECT round(ks, 9) AS ks, round(wasserstein, 9) AS wasserstein FROM dist))
SELECT round(corr(ks, wasserstein), 5) AS pearson, round(corr(rk, rw), 5) AS spearman, round(regr_slope(wasserstein, ks), 5) AS slope,
  round(regr_intercept(wasserstein, ks), 5) + 0.0 AS intercept FROM r""")
def _(spark, sf):
    s = I.two_sides(spectra(spark, sf).where("is_malicious = 0"), "split", "train", "test")
    d = I.spectral_drift(s).select(F.round("ks", 9).alias("ks"), F.round("wasserstein", 9).alias("wasserstein"))
    out = rounded(I.curve_association(d, "ks", "wasserstein"), 5)
    return out.withColumn("intercept", F.col("intercept") + 0.0)


@query("precision_weights", "I16", f"""WITH {SPEC_SQL},
base AS (SELECT bin, ln(var_pop(value)) AS s FROM spec WHERE side = 'a' GROUP BY bin),
gw AS (SELECT d, exp(-0.5 * pow(d / 0.7, 2)) AS w FROM (SELECT unnest(range(-3, 4)) AS d)),
sm AS (SELECT b.bin, sum(w * o.s) / (SELECT sum(w) FROM gw) AS s FROM base b, gw JOIN base o ON o.bin =
  CASE WHEN b.bin + d < 0 THEN -(b.bin + d) - 1 WHEN b.bin + d > 50 THEN 101 - (b.bin + d) ELSE b.bin + d END GROUP BY b.bin)
SELECT bin, round(s + CASE WHEN bin >= 20 THEN 0.18 * pow((bin - 20) / 30.0, 2) ELSE 0 END, 5) AS smooth,
  round(exp(-(s + CASE WHEN bin >= 20 THEN 0.18 * pow((bin - 20) / 30.0, 2) ELSE 0 END)), 5) AS weight FROM sm""")
def _(spark, sf):
    s = I.two_sides(spectra(spark, sf).where("is_malicious = 0"), "split", "train", "test").where("side = 'a'")
    base = G.by_bin(s.select("amp")).groupBy("bin").agg(F.log(F.var_pop("amp")).alias("s"))
    w = I.precision_weights(base, "s")
    return w.select(F.col("bin").cast("bigint").alias("bin"), F.round("smooth", 5).alias("smooth"), F.round("weight", 5).alias("weight"))


BAND_SQL = """CASE WHEN bin = 0 THEN 0 WHEN bin / 50 <= 0.1 THEN 0.2 WHEN bin / 50 < 0.18 THEN 0.2 + (bin / 50 - 0.1) / (0.18 - 0.1) * (1.0 - 0.2)
WHEN bin / 50 <= 0.28 THEN 1.0 WHEN bin / 50 < 0.55 THEN 1.0 + (bin / 50 - 0.28) / (0.55 - 0.28) * (0.6 - 1.0) ELSE 0.6 END"""


@query("band_weighted_amplitude", "I17", f"""WITH {SPEC_SQL}
SELECT source, window_id, channel, round(sum(value * ({BAND_SQL})), 5) AS weighted FROM spec GROUP BY source, window_id, channel""")
def _(spark, sf):
    s = I.two_sides(spectra(spark, sf).where("is_malicious = 0"), "split", "train", "test")
    b = G.by_bin(s.select("source", "window_id", "channel", "amp"))
    return b.groupBy("source", "window_id", "channel").agg(
        F.round(F.sum(F.col("amp") * I.band_weight(F.col("bin"), 51)), 5).alias("weighted"))
