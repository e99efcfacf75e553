"""Queries of spectra, bands and their normalisation; cross-channel matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlake.operators import shape, spatial, spectral
from epochlake.plans.registry import query
from epochlake.sources.tables import FS, N, epochs, sig1, sig4, with_

PSD = """w AS (SELECT epoch_id, t_idx, x * (0.5 - 0.5 * cos(2 * pi() * t_idx / 64)) AS wx FROM sig1),
dft AS (SELECT epoch_id, k, sum(wx * cos(2 * pi() * ((k * t_idx) % 64) / 64)) AS re, sum(wx * sin(2 * pi() * ((k * t_idx) % 64) / 64)) AS im FROM w CROSS JOIN (SELECT CAST(unnest(range(0, 33)) AS INTEGER) AS k) ks GROUP BY epoch_id, k),
psd AS (SELECT epoch_id, k, CAST(k AS DOUBLE) AS freq, (re * re + im * im) / (64.0::DOUBLE * 24.0::DOUBLE) * CASE WHEN k = 0 OR k = 32 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS power FROM dft)"""
DEMEANED = PSD.replace("x * (0.5", "(x - avg(x) OVER (PARTITION BY epoch_id)) * (0.5")
BANDS = {"theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}


def psd(spark, sf):
    return spectral.periodogram(sig1(spark, sf), N, FS, "epoch_id")


def rounded(df, *names, digits=8):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


@query("p1_frequency_grid", "SELECT CAST(k AS INTEGER) AS k, CASE WHEN k = 76 THEN 40.0::DOUBLE ELSE 2.0::DOUBLE + k * 0.5::DOUBLE END AS freq, count(*) AS epochs FROM unnest(range(0, 77)) AS g(k), embeddings GROUP BY k")
def p1(spark, sf):
    grid = spectral.frequency_grid(2.0, 40.0, 0.5)
    n = epochs(spark, sf).agg(F.count("*").alias("epochs"))
    return n.select(F.posexplode(F.array(*map(F.lit, grid))).alias("k", "freq"), "epochs")


@query("p2_periodogram", with_("sig1", more=DEMEANED, sql="SELECT epoch_id, k, freq, round(power, 8) AS power FROM psd"))
def p2(spark, sf):
    s = shape.demean(sig1(spark, sf), ("epoch_id",))
    return rounded(spectral.periodogram(s, N, FS, "epoch_id"), "power")


@query("p3_rebin_density", with_("sig1", more=PSD, sql="SELECT epoch_id, m, CAST(m * 2 + 4 AS DOUBLE) AS freq, round(sum(power * CASE WHEN k = m * 2 + 4 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) / 2, 8) AS power FROM psd JOIN (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS m) t ON abs(k - (m * 2 + 4)) <= 1 GROUP BY epoch_id, m"))
def p3(spark, sf):
    r = spectral.rebin(psd(spark, sf), [float(k) for k in range(33)], [float(2 * m + 4) for m in range(10)], "epoch_id")
    return rounded(r, "power")


STFT = """win AS (SELECT s.epoch_id, v.win, s.t_idx - v.win * 8 AS t, s.x * (0.5 - 0.5 * cos(2 * pi() * (s.t_idx - v.win * 8) / 32)) AS wx FROM sig1 s JOIN (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS win) v ON s.t_idx >= v.win * 8 AND s.t_idx < v.win * 8 + 32),
dft AS (SELECT epoch_id, win, k, sum(wx * cos(2 * pi() * ((k * t) % 32) / 32)) AS re, sum(wx * sin(2 * pi() * ((k * t) % 32) / 32)) AS im FROM win CROSS JOIN (SELECT CAST(unnest(range(0, 17)) AS INTEGER) AS k) ks GROUP BY epoch_id, win, k),
st AS (SELECT epoch_id, win, k, (re * re + im * im) / (64.0::DOUBLE * 12.0::DOUBLE) * CASE WHEN k = 0 OR k = 16 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS power FROM dft)"""


def stft(spark, sf):
    w = shape.windows(sig1(spark, sf), N, 32, 8)
    return spectral.periodogram(w, 32, FS, "epoch_id", "win", at="w_idx")


@query("p4_stft_psd", with_("sig1", more=STFT, sql="SELECT epoch_id, k, (win * 8 + 16) / 64.0::DOUBLE AS t, round(power, 8) AS power FROM st"))
def p4(spark, sf):
    return rounded(stft(spark, sf).select("epoch_id", "k", ((F.col("win") * 8 + 16) / 64.0).alias("t"), "power"), "power")


@query("p10_welch_psd", with_("sig1", more=STFT.replace("s.x * (0.5", "(s.x - avg(s.x) OVER (PARTITION BY s.epoch_id, v.win)) * (0.5").replace("win * 8", "win * 16").replace("range(0, 5)", "range(0, 3)"), sql="SELECT epoch_id, k, round(avg(power), 8) AS power FROM st GROUP BY epoch_id, k"))
def p10(spark, sf):
    w = shape.demean(shape.windows(sig1(spark, sf), N, 32, 16), ("epoch_id", "win"))
    p = spectral.periodogram(w, 32, FS, "epoch_id", "win", at="w_idx")
    return p.groupBy("epoch_id", "k").agg(F.round(F.avg("power"), 8).alias("power"))


@query("p8_adaptive_order", "SELECT epoch_id, freq, 1.0::DOUBLE + 9.0::DOUBLE * (freq - 2) / 38 AS morder FROM (SELECT vec_id AS epoch_id, CAST(2 + vec_id % 39 AS DOUBLE) AS freq FROM embeddings)")
def p8(spark, sf):
    f = epochs(spark, sf).select("epoch_id", (2 + F.col("epoch_id") % 39).cast("double").alias("freq"))
    return f.withColumn("morder", 1.0 + 9.0 * (F.col("freq") - 2) / 38)


@query("p9_wavelet_support", "SELECT cycles, CAST(max(2 * ceil(5 * cycles / (2 * pi() * freq) * 125) + 1) AS BIGINT) AS least_samples, count(*) AS n FROM (SELECT CAST(2 + vec_id % 39 AS DOUBLE) AS freq, least(greatest((2 + vec_id % 39) / 2.0::DOUBLE, 3.0::DOUBLE), 10.0::DOUBLE) AS cycles FROM embeddings) GROUP BY cycles")
def p9(spark, sf):
    f = epochs(spark, sf).select((2 + F.col("epoch_id") % 39).cast("double").alias("freq"))
    f = f.withColumn("cycles", F.least(F.greatest(F.col("freq") / 2, F.lit(3.0)), F.lit(10.0)))
    size = 2 * F.ceil(5 * F.col("cycles") / (2 * F.pi() * F.col("freq")) * 125) + 1
    return f.groupBy("cycles").agg(F.max(size).cast("long").alias("least_samples"), F.count("*").alias("n"))


TRAP = "r AS (SELECT epoch_id, band, freq, power, lag(freq) OVER w AS f0, lag(power) OVER w AS p0 FROM (SELECT *, CASE WHEN freq >= 4 AND freq < 8 THEN 'theta' WHEN freq >= 8 AND freq < 13 THEN 'alpha' WHEN freq >= 13 AND freq <= 30 THEN 'beta' END AS band FROM psd UNION ALL SELECT *, CASE WHEN freq >= 2 AND freq <= 30 THEN '#all' END FROM psd) WHERE band IS NOT NULL WINDOW w AS (PARTITION BY epoch_id, band ORDER BY freq)), s AS (SELECT epoch_id, band, coalesce(sum((power + p0) / 2 * (freq - f0)), 0) AS power FROM r GROUP BY epoch_id, band)"


@query("p11_band_power_trapezoid", with_("sig1", more=f"{PSD}, {TRAP}", sql="SELECT s.epoch_id, s.band, round(s.power, 8) AS power, round(CASE WHEN t.power > 0 THEN s.power / t.power ELSE 0.0 END, 6) AS share FROM s JOIN s t ON s.epoch_id = t.epoch_id AND t.band = '#all' WHERE s.band <> '#all'"))
def p11(spark, sf):
    return rounded(spectral.trapezoid_bands(psd(spark, sf), BANDS, 2.0, 30.0, "epoch_id").withColumn("share", F.round("share", 6)), "power")


@query("p12_median_psd", with_("sig1", more=PSD, sql="SELECT k, round(quantile_cont(m, 0.5), 8) AS power FROM (SELECT epoch_id % 10 AS subject, k, quantile_cont(power, 0.5) AS m FROM psd GROUP BY epoch_id % 10, k) GROUP BY k"))
def p12(spark, sf):
    m = psd(spark, sf).groupBy((F.col("epoch_id") % 10).alias("subject"), "k").agg(F.percentile("power", 0.5).alias("m"))
    return m.groupBy("k").agg(F.round(F.percentile("m", 0.5), 8).alias("power"))


FIT = "lp AS (SELECT *, ln(greatest(power, 1e-12)) AS v FROM psd), fit0 AS (SELECT k, avg(v) AS mu, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0)) AS sd FROM lp WHERE epoch_id % 10 <> 0 GROUP BY k), fit AS (SELECT k, mu, CASE WHEN sd < 1e-6 THEN 1.0 ELSE sd END AS scale FROM fit0)"


def train(df):
    return df.where(F.col("epoch_id") % 10 != 0)


@query("p13_log_power_fit", with_("sig1", more=f"{PSD}, {FIT}", sql="SELECT k, round(mu, 6) AS mu, round(scale, 6) AS scale FROM fit"))
def p13(spark, sf):
    return rounded(spectral.log_zscore_fit(train(psd(spark, sf))), "mu", "scale", digits=6)


@query("p14_log_power_zscore", with_("sig1", more=f"{PSD}, {FIT}", sql="SELECT epoch_id, lp.k, round((v - mu) / scale, 5) AS z FROM lp JOIN fit ON lp.k = fit.k"))
def p14(spark, sf):
    p = psd(spark, sf)
    return spectral.log_zscore(p, spectral.log_zscore_fit(train(p))).select("epoch_id", "k", F.round("z", 5).alias("z"))


@query("p15_log1p_standardize", with_("sig1", more=f"{PSD}, f AS (SELECT k, avg(ln(1 + power)) AS mu, greatest(stddev_pop(ln(1 + power)), 1e-6) AS scale FROM psd WHERE epoch_id % 10 <> 0 GROUP BY k)", sql="SELECT epoch_id, psd.k, round((ln(1 + power) - mu) / scale, 5) AS z FROM psd JOIN f ON psd.k = f.k"))
def p15(spark, sf):
    p = psd(spark, sf)
    return spectral.standardize(train(p), p, F.log1p("power"), "k").select("epoch_id", "k", F.round("z", 5).alias("z"))


@query("p16_waveform_standardize", with_("sig1", more="f AS (SELECT channel, t_idx, avg(x) AS mu, greatest(stddev_pop(x), 1e-6) AS scale FROM sig1 WHERE epoch_id % 10 <> 0 GROUP BY channel, t_idx)", sql="SELECT epoch_id, s.channel, s.t_idx, round((x - mu) / scale, 5) AS z FROM sig1 s JOIN f ON s.channel = f.channel AND s.t_idx = f.t_idx"))
def p16(spark, sf):
    s = sig1(spark, sf)
    return spectral.standardize(train(s), s, F.col("x"), "channel", "t_idx").select("epoch_id", "channel", "t_idx", F.round("z", 5).alias("z"))


@query("p17_flatten_tf", with_("sig1", more=STFT, sql="SELECT epoch_id, CAST(k * 5 + win AS INTEGER) AS ordinal, round(power, 8) AS power FROM st"))
def p17(spark, sf):
    return rounded(stft(spark, sf).select("epoch_id", (F.col("k") * 5 + F.col("win")).alias("ordinal"), "power"), "power")


@query("p18_spectrum_normalize", with_("sig1", more=PSD, sql="SELECT epoch_id, k, round(power / max(power) OVER (PARTITION BY epoch_id), 6) AS relative FROM psd"))
def p18(spark, sf):
    return spectral.relative_to_peak(psd(spark, sf), "epoch_id").select("epoch_id", "k", F.round("relative", 6).alias("relative"))


@query("p19_relative_db", with_("sig1", more=PSD, sql="SELECT epoch_id, k, round(greatest(10 * log10(power / max(power) OVER (PARTITION BY epoch_id)), -40.0::DOUBLE), 5) AS db FROM psd"))
def p19(spark, sf):
    return spectral.relative_db(psd(spark, sf), -40, "epoch_id").select("epoch_id", "k", F.round("db", 5).alias("db"))


@query("p20_localize_peak", with_("sig1", more=STFT, sql="SELECT epoch_id, max(CASE WHEN r = 1 THEN win END) AS at_win, max(CASE WHEN q = 1 THEN k END) AS at_k FROM (SELECT epoch_id, win, k, CASE WHEN k = 5 THEN row_number() OVER (PARTITION BY epoch_id, k ORDER BY power DESC, win) END AS r, CASE WHEN win = 2 THEN row_number() OVER (PARTITION BY epoch_id, win ORDER BY power DESC, k) END AS q FROM st) GROUP BY epoch_id"))
def p20(spark, sf):
    s = stft(spark, sf)
    time = F.max_by(F.when(F.col("k") == 5, F.col("win")), F.when(F.col("k") == 5, F.struct("power", -F.col("win"))))
    freq = F.max_by(F.when(F.col("win") == 2, F.col("k")), F.when(F.col("win") == 2, F.struct("power", -F.col("k"))))
    return s.groupBy("epoch_id").agg(time.alias("at_win"), freq.alias("at_k"))


@query("p21_marginals", with_("sig1", more=STFT, sql="SELECT epoch_id, 'freq' AS axis, k AS at, round(avg(power), 8) AS power FROM st GROUP BY epoch_id, k UNION ALL SELECT epoch_id, 'time', win, round(avg(power), 8) FROM st GROUP BY epoch_id, win"))
def p21(spark, sf):
    s = stft(spark, sf)
    one = lambda c, n: s.groupBy("epoch_id", F.col(c).alias("at")).agg(F.round(F.avg("power"), 8).alias("power")).select("epoch_id", F.lit(n).alias("axis"), "at", "power")
    return one("k", "freq").unionByName(one("win", "time"))


@query("t2_band_powers", with_("sig1", more=f"{PSD}, o AS (SELECT epoch_id, " + ", ".join(f"sum(power * greatest(0, least(freq + 0.5, {b}) - greatest(freq - 0.5, {a}))) AS {n}" for n, (a, b) in (BANDS | {"total": (4.0, 30.0)}).items()) + " FROM psd GROUP BY epoch_id)", sql=" UNION ALL ".join(f"SELECT epoch_id, '{n}' AS band, round({n}, 8) AS power, round(CASE WHEN total > 0 THEN {n} / total ELSE 0 END, 6) AS share FROM o" for n in BANDS)))
def t2(spark, sf):
    return rounded(spectral.band_powers(psd(spark, sf), BANDS, 1.0, "epoch_id").withColumn("share", F.round("share", 6)), "power")


@query("t3_spectral_summary", with_("sig1", more=f"{PSD}, tot AS (SELECT epoch_id, sum(power) AS total FROM psd GROUP BY epoch_id), top AS (SELECT epoch_id, freq FROM (SELECT *, row_number() OVER (PARTITION BY epoch_id ORDER BY power DESC, freq) AS r FROM psd) WHERE r = 1)", sql="SELECT p.epoch_id, round(max(total), 8) AS total, max(top.freq) AS dominant, round(sum(p.freq * power) / max(total), 6) AS centroid, round(-sum(CASE WHEN power > 0 THEN power / total * ln(power / total) ELSE 0 END) / ln(33), 6) AS entropy FROM psd p JOIN tot ON p.epoch_id = tot.epoch_id JOIN top ON p.epoch_id = top.epoch_id GROUP BY p.epoch_id"))
def t3(spark, sf):
    return rounded(rounded(spectral.spectral_summary(psd(spark, sf), 33, "epoch_id"), "centroid", "entropy", digits=6), "total")


COV = "cen AS (SELECT epoch_id, ch_idx, t_idx, x - avg(x) OVER (PARTITION BY epoch_id, ch_idx) AS x FROM sig4), emp AS (SELECT a.epoch_id, a.ch_idx AS i, b.ch_idx AS j, sum(a.x * b.x) / 16 AS c FROM cen a JOIN cen b ON a.epoch_id = b.epoch_id AND a.t_idx = b.t_idx GROUP BY a.epoch_id, a.ch_idx, b.ch_idx), st AS (SELECT epoch_id, sum(CASE WHEN i = j THEN c ELSE 0 END) / 4 AS mu, avg(c * c) AS al FROM emp GROUP BY epoch_id), sh AS (SELECT epoch_id, mu, least(1.0, (al + mu * mu) / (17 * (al - mu * mu / 4))) AS s FROM st), cov AS (SELECT emp.epoch_id, i, j, (1 - s) * c + CASE WHEN i = j THEN s * mu ELSE 0 END AS c FROM emp JOIN sh ON emp.epoch_id = sh.epoch_id)"


def covariance(spark, sf):
    return spatial.covariance(sig4(spark, sf), 4, 16, "epoch_id")


@query("c1_covariance", with_("sig4", more=COV, sql="SELECT epoch_id, i, j, round(c, 8) AS value FROM cov"))
def c1(spark, sf):
    return rounded(covariance(spark, sf), "value")


@query("c2_correlation", with_("sig4", more=COV, sql="SELECT a.epoch_id, a.i, a.j, round(CASE WHEN a.i = a.j THEN 1.0 ELSE greatest(-1, least(1, a.c / sqrt(b.c * d.c))) END, 6) AS value FROM cov a JOIN cov b ON a.epoch_id = b.epoch_id AND b.i = a.i AND b.j = a.i JOIN cov d ON a.epoch_id = d.epoch_id AND d.i = a.j AND d.j = a.j"))
def c2(spark, sf):
    return rounded(spatial.correlation(covariance(spark, sf), "epoch_id"), "value", digits=6)


@query("t13_flatten", with_("sig4", more=COV, sql="SELECT epoch_id, CAST(i * 4 - i * (i - 1) // 2 + j - i AS INTEGER) AS ordinal, round(c * CASE WHEN i < j THEN sqrt(2.0) ELSE 1.0 END, 8) AS value FROM cov WHERE i <= j"))
def t13(spark, sf):
    from epochlake.operators.features import flatten_symmetric

    return rounded(flatten_symmetric(covariance(spark, sf), 4, "epoch_id"), "value")


@query("t18_matrix_grain_diff", with_("sig4", more="cw AS (SELECT epoch_id, ch_idx, t_idx // 8 AS win, t_idx, x - avg(x) OVER (PARTITION BY epoch_id, ch_idx, t_idx // 8) AS x FROM sig4), cf AS (SELECT epoch_id, ch_idx, t_idx, x - avg(x) OVER (PARTITION BY epoch_id, ch_idx) AS x FROM sig4), ew AS (SELECT a.epoch_id, a.win, a.ch_idx AS i, b.ch_idx AS j, sum(a.x * b.x) / 8 AS c FROM cw a JOIN cw b ON a.epoch_id = b.epoch_id AND a.t_idx = b.t_idx GROUP BY a.epoch_id, a.win, a.ch_idx, b.ch_idx), ef AS (SELECT a.epoch_id, a.ch_idx AS i, b.ch_idx AS j, sum(a.x * b.x) / 16 AS c FROM cf a JOIN cf b ON a.epoch_id = b.epoch_id AND a.t_idx = b.t_idx GROUP BY a.epoch_id, a.ch_idx, b.ch_idx)", sql="SELECT ef.epoch_id, ef.i, ef.j, round(avg(ew.c) - max(ef.c), 8) + 0.0::DOUBLE AS value FROM ew JOIN ef ON ew.epoch_id = ef.epoch_id AND ew.i = ef.i AND ew.j = ef.j GROUP BY ef.epoch_id, ef.i, ef.j"))
def t18(spark, sf):
    s = sig4(spark, sf)
    part = spatial.empirical(s.withColumn("win", F.floor(F.col("t_idx") / 8)), 8, "epoch_id", "win").groupBy("epoch_id", "i", "j").agg(F.avg("value").alias("w"))
    full = spatial.empirical(s, 16, "epoch_id")
    gap = F.round(F.col("w") - F.col("value"), 8) + F.lit(0.0)  # no negative zero
    return part.join(full, ["epoch_id", "i", "j"]).select("epoch_id", "i", "j", gap.alias("value"))


@query("c3_log_covariance")
def c3(spark, sf):
    return rounded(spatial.log_covariance(covariance(spark, sf), 4, "epoch_id"), "value", digits=6)


@query("c4_csp_features")
def c4(spark, sf):
    lab = epochs(spark, sf).select("epoch_id", (F.col("label") % 2).cast("int").alias("y"))
    return rounded(spatial.csp_features(sig4(spark, sf).join(lab, "epoch_id"), 4, 16, 2, F.col("epoch_id") % 10 != 0), "value", digits=6)


@query("c5_tangent_space")
def c5(spark, sf):
    return rounded(spatial.tangent_space(covariance(spark, sf), 4, F.col("epoch_id") % 10 != 0, "epoch_id"), "value", digits=6)


@query("c5_riemannian_tangent")
def c5_riemannian(spark, sf):
    return rounded(spatial.riemannian_tangent(covariance(spark, sf), 4, F.col("epoch_id") % 10 != 0, "epoch_id"), "value", digits=6)


@query("c5_xdawn_covariances")
def c5_xdawn(spark, sf):
    lab = epochs(spark, sf).select("epoch_id", (F.col("label") % 2).cast("int").alias("y"))
    cov, channels = spatial.xdawn_covariances(sig4(spark, sf).join(lab, "epoch_id"), 4, 16, 2, F.col("epoch_id") % 10 != 0)
    return rounded(spatial.riemannian_tangent(cov, channels, F.col("epoch_id") % 10 != 0, "epoch_id"), "value", digits=6)


@query("p5_morlet_power")
def p5(spark, sf):
    from epochlake.operators.wavelets import morlet_power

    return rounded(morlet_power(sig1(spark, sf), FS, [8.0, 12.0, 16.0, 24.0], "epoch_id"), "power")


@query("p6_superlet_power")
def p6(spark, sf):
    from epochlake.operators.wavelets import superlet_power

    return rounded(superlet_power(sig1(spark, sf), FS, [16.0, 20.0, 24.0], (1.0, 2.0), "epoch_id"), "power")


@query("p7_superlet_multiplicative")
def p7(spark, sf):
    from epochlake.operators.wavelets import superlet_power

    return rounded(superlet_power(sig1(spark, sf), FS, [16.0, 20.0, 24.0], (1.0, 2.0), "epoch_id", equal=True), "power")


