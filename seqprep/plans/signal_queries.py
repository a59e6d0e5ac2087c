"""Queries on signals (events of a user in time order) and pen traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqprep.functions import arrays as AR
from seqprep.functions import signal as S
from seqprep.operators import aggregates as AG
from seqprep.operators import filters as FL
from seqprep.operators import frames as W
from seqprep.operators import joins as J
from seqprep.operators import sampling as K
from seqprep.operators import score as SC
from seqprep.operators import spectra as D
from seqprep.operators import strokes as P
from seqprep.plans import sql as Q
from seqprep.plans import views as V
from seqprep.plans.registry import query

r = Q.r
U = ["utt"]
SIG = f"WITH {Q.SIGNAL}"
SIZE, STEP = 16, 8


def rounded(c, n=6):
    return F.round(c, n)


def frames_sql(size=SIZE, step=STEP, source="signal", keys="utt"):
    return (
        f"cnt AS (SELECT {keys}, count(*) AS n FROM {source} GROUP BY ALL), "
        f"fr AS (SELECT g.utt, g.frame, g.i, coalesce(s.x, 0.0) AS x FROM (SELECT utt, frame, unnest(range(0, {size})) AS i FROM "
        f"(SELECT utt, unnest(range(0, (n + {size} - n % {size} - {size - step}) // {step})) AS frame FROM cnt)) g "
        f"LEFT JOIN {source} s ON s.utt = g.utt AND s.pos = g.frame * {step} + g.i)"
    )


CENTERED = "cen AS (SELECT utt, pos, x - avg(x) OVER (PARTITION BY utt) AS x FROM signal)"


def padded_frames_sql(size=SIZE, step=STEP, source="signal"):
    """Frames of the signal behind size - step zeros, with zeros after it."""
    m = f"(n + {2 * (size - step)} - {size}) // {step} + CASE WHEN n % {step} = 0 THEN 1 ELSE 2 END"
    return (
        f"cnt AS (SELECT utt, count(*) AS n FROM {source} GROUP BY ALL), "
        f"fr AS (SELECT g.utt, g.frame, g.i, coalesce(s.x, 0.0) AS x FROM (SELECT utt, frame, unnest(range(0, {size})) AS i FROM "
        f"(SELECT utt, unnest(range(0, {m})) AS frame FROM cnt)) g LEFT JOIN {source} s ON s.utt = g.utt AND s.pos = g.frame * {step} + g.i - {size - step})"
    )


def spectrum_sql(size=SIZE, step=STEP, source="cen", frames=frames_sql):
    return (
        f"{frames(size, step, source)}, sp AS (SELECT utt, frame, bin, sum(x * (0.5 - 0.5 * cos(2 * pi() * i / {size})) * cos(2 * pi() * bin * i / {size})) AS re, "
        f"-sum(x * (0.5 - 0.5 * cos(2 * pi() * i / {size})) * sin(2 * pi() * bin * i / {size})) AS im "
        f"FROM fr, (SELECT unnest(range(0, {size // 2 + 1})) AS bin) GROUP BY ALL)"
    )


def weights_sql(weights):
    rows = ", ".join(f"({b}, {f}, {float(w)!r}::DOUBLE)" for b, row in enumerate(weights) for f, w in enumerate(row) if w > 0)
    return f"wt AS (SELECT * FROM (VALUES {rows}) AS v(bin, filter, w))"


def mel_formula(n_bins, rate, low, high, n):
    """The mel filters again, as SQL over ranges."""
    mel = lambda hz: f"(1127.0 * ln(1.0 + ({hz}) / 700.0))"
    edge = lambda i: f"({mel(low)} + ({mel(high)} - {mel(low)}) * ({i}) / {n + 1}.0)"
    m = mel(f"bin * {rate} / 2.0 / {n_bins - 1}")
    return (
        f"wt AS (SELECT bin, filter, greatest(0.0, least(({m} - {edge('filter')}) / ({edge('filter + 1')} - {edge('filter')}), "
        f"({edge('filter + 2')} - {m}) / ({edge('filter + 2')} - {edge('filter + 1')}))) AS w "
        f"FROM (SELECT unnest(range(1, {n_bins})) AS bin), (SELECT unnest(range(0, {n})) AS filter))"
    )


def bank_formula(n_bins, rate, low, high, n):
    """Triangles of area one on the linear-then-log scale, as SQL over ranges."""
    mel = lambda hz: f"(CASE WHEN {hz} < 1000 THEN {hz} * 3 / 200.0 ELSE 15.0 + 27 * ln({hz} / 1000.0) / ln(6.4) END)"
    return (
        f"mels AS (SELECT k, {mel(low)} + ({mel(high)} - {mel(low)}) * k / {n + 1}.0 AS m FROM (SELECT unnest(range(0, {n + 2})) AS k)), "
        "corner AS (SELECT k, CASE WHEN m < 15 THEN m * 200 / 3.0 ELSE 1000 * exp(ln(6.4) * (m - 15) / 27) END AS hz FROM mels), "
        "wt AS (SELECT bin, a.k AS filter, greatest(0.0, least((g - a.hz) / (b.hz - a.hz), (c.hz - g) / (c.hz - b.hz))) * 2 / (c.hz - a.hz) AS w "
        f"FROM (SELECT bin, bin * {rate} / 2.0 / {n_bins - 1} AS g FROM (SELECT unnest(range(0, {n_bins})) AS bin)), "
        "corner a JOIN corner b ON b.k = a.k + 1 JOIN corner c ON c.k = a.k + 2)"
    )


LEVELS = (
    "m AS (SELECT utt, frame, filter, sum(sqrt(re*re + im*im) * w) AS v FROM sp JOIN wt USING (bin) GROUP BY ALL) SELECT utt, frame, filter::INT AS filter, "
    + r("greatest(0.0, least(1.0, (20 * log10(greatest(1e-5, v)) - 20.0 + 100.0) / 100.0))", 5) + " AS v FROM m"
)


@query("blocks_position", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events")
def blocks_position(spark, folder):
    from seqprep.operators.blocks import position

    ev = V.table(spark, folder, "events").select("user_id", "ts", "event_id")
    return position(ev, ["user_id"], ["ts", "event_id"]).select("event_id", "pos")


@query("filter_min_length", f"{SIG}, n AS (SELECT utt, count(*) AS n FROM signal GROUP BY utt) SELECT utt, pos, x FROM signal JOIN n USING (utt) WHERE n >= 66")
def min_length(spark, folder):
    return FL.min_length_filter(V.samples(spark, folder), U, 65)


@query("window_rolling_mean", f"""
{SIG} SELECT utt, pos - 4 AS pos, {r('mean')} AS mean FROM (SELECT utt, pos, avg(x) OVER (PARTITION BY utt ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean FROM signal) WHERE pos >= 4""")
def rolling_mean(spark, folder):
    return W.rolling_mean(V.samples(spark, folder), U, 5).withColumn("mean", rounded("mean"))


@query("window_rolling_window", f"""
{SIG} SELECT utt, pos // 3 AS "window", v[1] AS first_x, v[6] AS last_x, {r('list_sum(v)')} AS total FROM (
 SELECT utt, pos, list(x) OVER (PARTITION BY utt ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS v FROM signal) WHERE len(v) = 6 AND pos % 3 = 0""")
def rolling_window(spark, folder):
    x = W.rolling_window(V.samples(spark, folder), U, 6, 3)
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return x.select("utt", "window", F.get("values", F.lit(0)).alias("first_x"), F.get("values", F.lit(5)).alias("last_x"), rounded(total).alias("total"))


@query("window_unwindow", f"""
{SIG} SELECT utt, (pos // 3) * 3 + i AS pos, {r('list_avg(v)')} AS x FROM (
 SELECT utt, pos, list(x) OVER (PARTITION BY utt ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS v FROM signal), (SELECT unnest(range(0, 3)) AS i) WHERE len(v) = 6 AND pos % 3 = 0""")
def unwindow(spark, folder):
    return W.unwindow(W.rolling_window(V.samples(spark, folder), U, 6, 3), U, 3).withColumn("x", rounded("x"))


@query("window_frame", f"{SIG}, {frames_sql()} SELECT utt, frame, i::INT AS i, x FROM fr")
def frame(spark, folder):
    return W.frame(V.samples(spark, folder), U, SIZE, STEP).select("utt", "frame", F.posexplode("values").alias("i", "x"))


@query("window_frame_gaps", f"""
{SIG}, n AS (SELECT utt, count(*) + 4 - count(*) % 4 AS n FROM signal GROUP BY utt), g AS (SELECT utt, unnest(range(0, (n - 4) // 10 + 1)) AS frame FROM n),
h AS (SELECT utt, frame, unnest(range(0, 4)) AS i FROM g) SELECT h.utt, frame, i::INT AS i, coalesce(x, 0.0) AS x FROM h LEFT JOIN signal s ON s.utt = h.utt AND s.pos = frame * 10 + i""")
def frame_gaps(spark, folder):
    return W.frame(V.samples(spark, folder), U, 4, 10).select("utt", "frame", F.posexplode("values").alias("i", "x"))


@query("agg_overlap_add", f"{SIG}, {frames_sql()} SELECT utt, frame * {STEP} + i AS pos, {r('sum(x)')} AS x FROM fr GROUP BY ALL")
def overlap_add(spark, folder):
    f = W.frame(V.samples(spark, folder), U, SIZE, STEP)
    return W.overlap_add(f, U, STEP).withColumn("x", rounded("x"))


@query("agg_peak_rescale", f"{SIG} SELECT utt, pos, {r('x / max(abs(x)) OVER (PARTITION BY utt) * 0.999')} AS x FROM signal")
def peak_rescale(spark, folder):
    return AG.peak_rescale(V.samples(spark, folder), U).withColumn("x", rounded("x"))


@query("agg_minmax_rescale", f"""
{SIG} SELECT utt, pos, trunc((2 * (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) - 1) * 0.9 * 32768.0)::INT AS x FROM signal WINDOW w AS (PARTITION BY utt)""")
def minmax_rescale(spark, folder):
    return AG.minmax_rescale(V.samples(spark, folder), U).withColumn("x", F.col("x").cast("int"))


@query("agg_mean_center", f"{SIG}, {CENTERED} SELECT utt, pos, {r('x', 10)} AS x FROM cen")
def mean_center(spark, folder):
    return AG.mean_center(V.samples(spark, folder), U).withColumn("x", rounded("x", 10))


@query("window_decaying_max", f"""
{SIG} SELECT s.utt, s.pos, {r('max(p.x * pow(1 / 1.1, s.pos - p.pos))', 5)} AS state FROM signal s JOIN signal p ON s.utt = p.utt AND p.pos <= s.pos GROUP BY ALL""")
def decaying_max(spark, folder):
    return W.decaying_max(V.samples(spark, folder), U, 1 / 1.1).select("utt", "pos", rounded("state", 5).alias("state"))


CODE = "((sign(x / 500.0) * ln(1 + 255.0 * abs(x / 500.0)) / ln(256.0) + 1) / 2 * 255.0 + 0.5)"


@query("window_trim_edges", f"""
{SIG}, c AS (SELECT utt, pos, floor({CODE})::INT AS code FROM signal), e AS (SELECT utt, min(pos) AS a, max(pos) AS b FROM c WHERE abs(code - 127) > 40 GROUP BY utt)
SELECT utt, pos - a AS pos, code FROM c JOIN e USING (utt) WHERE pos >= a AND pos < b""")
def trim_edges(spark, folder):
    x = V.samples(spark, folder).select("utt", "pos", S.mulaw_quantize(F.col("x") / 500.0).alias("code"))
    return W.trim_edges(x, U, 40)


@query("window_label_trim", f"""
{SIG} SELECT utt, min(pos * 100) AS start, arg_max((pos + 1) * 100, pos) AS stop FROM signal WHERE event_type NOT IN ('view', 'click') GROUP BY utt""")
def label_trim(spark, folder):
    s = V.signal(spark, folder)
    labels = s.select("utt", (F.col("pos") * 100).alias("begin"), ((F.col("pos") + 1) * 100).alias("end"), F.col("event_type").alias("label"))
    return W.label_trim(labels, U, ("view", "click"))




@query("window_long_term_envelope", f"""
{SIG}, {CENTERED}, {spectrum_sql()} SELECT utt, frame, bin::INT AS bin, {r('max(sqrt(re*re + im*im)) OVER (PARTITION BY utt, bin ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 5)} AS envelope FROM sp""")
def long_term_envelope(spark, folder):
    m = D.with_magnitudes(D.spectrum(V.samples(spark, folder), U, SIZE, STEP), U)
    e = W.long_term_envelope(m, U, 2).select("utt", "frame", F.posexplode("envelope").alias("bin", "envelope"))
    return e.withColumn("envelope", rounded("envelope", 5))


@query("agg_noise_spectrum", f"""
{SIG}, {CENTERED}, {spectrum_sql()} SELECT utt, bin::INT AS bin, {r('pow(avg(sqrt(re*re + im*im)), 2)', 4)} AS power FROM sp WHERE frame < 3 GROUP BY ALL""")
def noise_spectrum(spark, folder):
    m = D.with_magnitudes(D.spectrum(V.samples(spark, folder), U, SIZE, STEP), U)
    return W.noise_spectrum(m, U, 3).select("utt", F.posexplode("power").alias("bin", "power")).withColumn("power", rounded("power", 4))


VAD = f"""
{SIG}, sc AS (SELECT utt, pos, trunc((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) * 32768.0) AS x FROM signal WINDOW w AS (PARTITION BY utt)),
cnt AS (SELECT utt, count(*) AS n FROM sc GROUP BY utt),
fr AS (SELECT g.utt, g.frame, s.pos - g.frame * 4 AS i, s.x FROM (SELECT utt, unnest(range(0, n // 4 - 1)) AS frame FROM cnt) g JOIN sc s ON s.utt = g.utt AND s.pos >= g.frame * 4 AND s.pos < g.frame * 4 + 8),
sp AS (SELECT utt, frame, bin, sqrt(pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 7)) * cos(2 * pi() * bin * i / 8)), 2) + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 7)) * sin(2 * pi() * bin * i / 8)), 2)) AS mag
  FROM fr, (SELECT unnest(range(0, 5)) AS bin) GROUP BY ALL),
noise AS (SELECT utt, bin, pow(avg(mag), 2) AS power FROM sp WHERE frame < 6 GROUP BY ALL),
env AS (SELECT utt, frame, bin, max(mag) OVER (PARTITION BY utt, bin ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS envelope FROM sp),
lst AS (SELECT utt, max(frame) AS last FROM sp GROUP BY utt),
act AS (SELECT utt, frame, CASE WHEN frame < 2 OR frame + 2 > max(last) THEN 0.0 ELSE 10.0 * log10(sum(CASE WHEN bin IN (0, 4) THEN 1.0 ELSE 2.0 END * envelope * envelope / power) / 8.0) END AS ratio
  FROM env JOIN noise USING (utt, bin) JOIN lst USING (utt) GROUP BY utt, frame)
"""


@query("window_voice_activity", f"{VAD} SELECT utt, frame, {r('ratio', 5)} AS ratio, ratio >= 6.0 AS voiced FROM act")
def voice_activity(spark, folder):
    a = W.voice_activity(D.activity_magnitudes(V.samples(spark, folder), U, 8), U, 8, 6.0, 2, 6)
    return a.withColumn("ratio", rounded("ratio", 5))


@query("window_voiced_samples", f"""{VAD}, len AS (SELECT utt, n // 4 - 1 AS l, (n // 4) * 8 // 2 AS s FROM cnt WHERE n // 4 - 1 > 1),
pts AS (SELECT utt, l, s, unnest(range(0, l - 1)) AS k FROM len),
seg AS (SELECT utt, k + 1 AS frame, s * k // (l - 1) - 8 AS a, s * (k + 1) // (l - 1) - 8 AS b FROM pts)
SELECT g.utt, g.pos, g.x FROM signal g JOIN seg ON seg.utt = g.utt AND g.pos >= seg.a AND g.pos < seg.b JOIN act ON act.utt = seg.utt AND act.frame = seg.frame WHERE act.ratio >= 6.0""")
def voiced_samples(spark, folder):
    s = V.samples(spark, folder)
    a = W.voice_activity(D.activity_magnitudes(s, U, 8), U, 8, 6.0, 2, 6)
    return W.voiced_samples(s, a, U, 8).select("utt", "pos", "x")


@query("signal_spectrum", f"{SIG}, {CENTERED}, {spectrum_sql()} SELECT utt, frame, bin::INT AS bin, {r('re', 5)} AS re, {r('im', 5)} AS im FROM sp")
def spectrum(spark, folder):
    s = D.spectrum(V.samples(spark, folder), U, SIZE, STEP)
    z = s.select("utt", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z"))
    return z.select("utt", "frame", "bin", rounded("z.re", 5).alias("re"), rounded("z.im", 5).alias("im"))


INV = f"inv AS (SELECT utt, frame, i, sum(re * cos(2 * pi() * bin * i / {SIZE + 2}) - im * sin(2 * pi() * bin * i / {SIZE + 2})) / {SIZE + 2}.0 AS x FROM sp, (SELECT unnest(range(0, {SIZE + 2})) AS i) GROUP BY ALL)"


@query("signal_inverse_spectrum", f"""
{SIG}, {CENTERED}, {spectrum_sql()}, {INV}, ola AS (SELECT utt, frame * {STEP} + i AS pos, sum(x) AS x FROM inv GROUP BY ALL)
SELECT utt, pos, {r('x - avg(x) OVER (PARTITION BY utt)', 5)} AS x FROM ola""")
def inverse_spectrum(spark, folder):
    s = D.spectrum(V.samples(spark, folder), U, SIZE, STEP)
    return D.inverse_spectrum(s, U, SIZE, STEP).withColumn("x", rounded("x", 5))


RATE, BANDS = 16000, 4


@query("signal_log_mel", f"""
{SIG}, {CENTERED}, {spectrum_sql()}, {mel_formula(SIZE // 2 + 1, RATE, 125.0, 7800.0, BANDS)}
SELECT utt, frame, filter::INT AS filter, {r('ln(1 + sum(sqrt(re*re + im*im) * w))', 5)} AS v FROM sp JOIN wt USING (bin) GROUP BY ALL""")
def log_mel(spark, folder):
    m = D.log_mel(V.samples(spark, folder), U, SIZE, STEP, RATE, 125.0, 7800.0, BANDS)
    return m.select("utt", "frame", F.posexplode("feat").alias("filter", "v")).withColumn("v", rounded("v", 5))


@query("signal_mel_spectrogram", f"""
{SIG}, {spectrum_sql(source='signal', frames=padded_frames_sql)}, {bank_formula(SIZE // 2 + 1, RATE, 125.0, 7600.0, BANDS)}, {LEVELS}""")
def mel_spectrogram(spark, folder):
    m = D.mel_spectrogram(V.samples(spark, folder), U, SIZE, STEP, RATE, 125.0, 7600.0, BANDS)
    return m.select("utt", "frame", F.posexplode("feat").alias("filter", "v")).withColumn("v", rounded("v", 5))


@query("signal_log_power", f"""
{SIG}, {CENTERED}, {spectrum_sql()} SELECT utt, frame, bin::INT AS bin, {r('10 * log10(greatest(1e-10, re*re + im*im))', 4)} AS v, 'u' || utt AS label FROM sp""")
def log_power(spark, folder):
    path = F.concat(F.lit("/a/u"), F.col("utt").cast("string"), F.lit("_1.wav"))
    x = D.log_power_spectrogram(V.samples(spark, folder), U, SIZE, STEP, path)
    x = x.select("utt", "frame", "label", F.posexplode("feat").alias("bin", "v"))
    return x.withColumn("v", rounded("v", 4))


def dct_sql(n, size, source):
    return (
        f"SELECT utt, frame, k, sum(x * cos(pi() * (2 * i + 1) * k / {2 * size}.0) * CASE WHEN k = 0 THEN sqrt(1.0 / {size}) ELSE sqrt(2.0 / {size}) END) AS v "
        f"FROM {source}, (SELECT unnest(range(0, {n})) AS k) GROUP BY ALL"
    )


BLOCKS8 = "fr AS (SELECT utt, pos // 8 AS frame, pos % 8 AS i, x FROM signal)"


@query("signal_dct_compress", f"{SIG}, {BLOCKS8}, c AS ({dct_sql(4, 8, 'fr')}) SELECT utt, frame, k::INT AS k, {r('v', 5)} AS v FROM c")
def dct_compress(spark, folder):
    c = D.dct_compress(V.samples(spark, folder), U, 4, 8)
    return c.select("utt", "frame", F.posexplode("coef").alias("k", "v")).withColumn("v", rounded("v", 5))


@query("signal_dct_uncompress", f"""
{SIG}, {BLOCKS8}, c AS ({dct_sql(4, 8, 'fr')})
SELECT utt, frame * 8 + i AS pos, {r("sum(v * cos(pi() * (2 * i + 1) * k / 16.0) * CASE WHEN k = 0 THEN sqrt(1.0 / 8) ELSE sqrt(2.0 / 8) END)", 5)} AS x FROM c, (SELECT unnest(range(0, 8)) AS i) GROUP BY ALL""")
def dct_uncompress(spark, folder):
    c = D.dct_compress(V.samples(spark, folder), U, 4, 8)
    return D.dct_uncompress(c, U, 4, 8).withColumn("x", rounded("x", 5))


@query("signal_dct_overlapped", f"{SIG}, {frames_sql(8, 4)}, c AS ({dct_sql(8, 8, 'fr')}) SELECT utt, frame, k::INT AS k, {r('v', 5)} AS v FROM c")
def dct_overlapped(spark, folder):
    c = D.dct_compress(V.samples(spark, folder), U, 8, 8, overlapped=True)
    return c.select("utt", "frame", F.posexplode("coef").alias("k", "v")).withColumn("v", rounded("v", 5))


MDCT = f"{frames_sql(16, 8)}, c AS (SELECT utt, frame, k, sum(x * sin(pi() * (i + 0.5) / 16) * cos(pi() * (i + 4.5) * (k + 0.5) / 8)) AS v FROM fr, (SELECT unnest(range(0, 8)) AS k) GROUP BY ALL)"


@query("signal_mdct", f"{SIG}, {MDCT} SELECT utt, frame, k::INT AS k, {r('v', 5)} AS v FROM c")
def mdct(spark, folder):
    c = D.mdct(V.samples(spark, folder), U, 8)
    return c.select("utt", "frame", F.posexplode("coef").alias("k", "v")).withColumn("v", rounded("v", 5))


@query("signal_imdct", f"""
{SIG}, {MDCT}, o AS (SELECT utt, frame, i, sum(v * cos(pi() * (i + 4.5) * (k + 0.5) / 8) / 4.0 * sin(pi() * (i + 0.5) / 16)) AS x FROM c, (SELECT unnest(range(0, 16)) AS i) GROUP BY ALL),
fn AS (SELECT utt, max(frame) + 1 AS n FROM o GROUP BY utt),
z AS (SELECT utt, unnest(range((n // 2 + 1) * 16 - 8, (n // 2 + 1) * 16)) AS pos, 0.0 AS x FROM fn WHERE n % 2 = 0)
SELECT utt, pos, {r('sum(x)', 5)} AS x FROM (SELECT utt, frame * 8 + i AS pos, x FROM o UNION ALL SELECT * FROM z) GROUP BY ALL""")
def imdct(spark, folder):
    return D.imdct(D.mdct(V.samples(spark, folder), U, 8), U, 8).withColumn("x", rounded("x", 5))


@query("signal_best_lag", f"""
{SIG}, f AS (SELECT utt, pos // 16 AS frame, pos % 16 AS pos, x, event_id % 50 AS y FROM signal),
a AS (SELECT utt, frame, pos, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM f WINDOW w AS (PARTITION BY utt, frame)),
s AS (SELECT a.utt, a.frame, a.pos - b.pos AS lag, sum(a.x * b.y) AS score FROM a JOIN a b ON a.utt = b.utt AND a.frame = b.frame AND abs(a.pos - b.pos) <= 7 GROUP BY ALL)
SELECT utt, frame, (array_agg(lag ORDER BY round(score, 6) DESC, lag))[1]::INT AS lag FROM s GROUP BY utt, frame""")
def best_lag(spark, folder):
    s = V.signal(spark, folder).select("utt", F.expr("pos div 16").alias("frame"), (F.col("pos") % 16).alias("pos"), "x", (F.col("event_id") % 50).cast("double").alias("y"))
    out = W.best_lag(s.select("utt", "frame", "pos", "x"), s.select("utt", "frame", "pos", F.col("y").alias("x")), ["utt", "frame"], 7)
    return out.select("utt", "frame", F.col("lag").cast("int").alias("lag"))


@query("signal_fixed_chunks", f"""
{SIG}, n AS (SELECT utt, count(*) AS n FROM signal GROUP BY utt) SELECT utt, pos, x, least(pos // 20, n // 20 - 1) AS chunk FROM signal JOIN n USING (utt) WHERE n // 20 >= 1""")
def fixed_chunks(spark, folder):
    return W.fixed_chunks(V.samples(spark, folder), U, 20)


@query("signal_linear_upsample", f"""
{SIG}, n AS (SELECT utt, pos, x, lead(x) OVER (PARTITION BY utt ORDER BY pos) AS nx FROM signal)
SELECT utt, pos * 3 + i AS pos, {r('(1 - i / 3.0) * x + i / 3.0 * coalesce(nx, 0)')} AS x FROM n, (SELECT unnest(range(0, 3)) AS i) WHERE nx IS NOT NULL OR i = 0""")
def linear_upsample(spark, folder):
    return W.linear_upsample(V.samples(spark, folder), U, 3).withColumn("x", rounded("x"))


TAPS = [float(t) for t in S.lowpass_taps(8, 1 / (2 * 1.1))]


@query("signal_downsample", f"""
{SIG}, taps AS (SELECT unnest(range(0, 8)) AS j, unnest([{', '.join(repr(t) for t in TAPS)}]) AS t), n AS (SELECT utt, count(*) AS n FROM signal GROUP BY utt),
o AS (SELECT utt, unnest(range(0, (n + 1) // 2 + 4)) AS pos FROM n)
SELECT o.utt, o.pos, {r('coalesce(sum(s.x * t.t), 0.0)')} AS x FROM o CROSS JOIN taps t LEFT JOIN signal s ON s.utt = o.utt AND s.pos = o.pos * 2 - t.j GROUP BY ALL""")
def downsample(spark, folder):
    return W.downsample(V.samples(spark, folder), U, 2, TAPS).withColumn("x", rounded("x"))




def wide_weights(n_fft, rate, n, width):
    """The filters on the linear-then-log scale again, as SQL over ranges: wt(bin, filter, w)."""
    top = f"(15.0 + ln({rate // 2} / 1000.0) / (ln(6.4) / 27))"
    m = lambda k: f"(({k}) / {n + 1}.0 * {top})"
    hz = lambda k: f"(CASE WHEN {m(k)} < 15.0 THEN {m(k)} * 200 / 3.0 ELSE 1000 * exp(ln(6.4) / 27 * ({m(k)} - 15.0)) END)"
    f = f"(bin * {rate}.0 / {n_fft})"
    return (
        f"ed AS (SELECT filter, {hz('filter')} AS a, {hz('filter + 1')} AS b, {hz('filter + 2')} AS c FROM (SELECT unnest(range(0, {n})) AS filter)), "
        f"wt AS (SELECT bin, filter, greatest(0.0, least(({f} - (b + {width} * (a - b))) / ({width} * (b - a)), ((b + {width} * (c - b)) - {f}) / ({width} * (c - b)))) * 2.0 / (c - a) AS w "
        f"FROM ed, (SELECT unnest(range(0, {n_fft // 2})) AS bin))"
    )


GAIN = f"""
{SIG}, {spectrum_sql(source='signal')}, {wide_weights(SIZE, 16000, 3, 2.0)},
bd AS (SELECT utt, frame, filter, sum(sqrt(re * re + im * im) * w) AS v FROM sp JOIN wt USING (bin) GROUP BY ALL),
st AS (SELECT a.utt, a.frame, a.filter, max(b.v * exp(-(a.frame - b.frame) / 2000.0 / 0.5)) AS s FROM bd a JOIN bd b ON a.utt = b.utt AND a.filter = b.filter AND b.frame <= a.frame GROUP BY ALL),
tw AS (SELECT bin, sum(w) AS t FROM wt GROUP BY bin),
en0 AS (SELECT st.utt, st.frame, wt.bin, sum(st.s * wt.w / CASE WHEN t = 0 THEN 1 ELSE t END) AS e FROM st JOIN wt USING (filter) JOIN tw ON tw.bin = wt.bin GROUP BY ALL),
en AS (SELECT utt, frame, bin, e FROM en0 UNION ALL SELECT utt, frame, {SIZE // 2}, 0.0 FROM (SELECT DISTINCT utt, frame FROM en0)),
mn AS (SELECT utt, min(e) AS least FROM en WHERE e > 0 GROUP BY utt),
gs AS (SELECT sp.utt, sp.frame, sp.bin, re / CASE WHEN e > 0 THEN e ELSE least END AS re, im / CASE WHEN e > 0 THEN e ELSE least END AS im FROM sp JOIN en USING (utt, frame, bin) JOIN mn USING (utt)),
iv AS (SELECT utt, frame, i, sum(re * cos(2 * pi() * bin * i / {SIZE + 2}) - im * sin(2 * pi() * bin * i / {SIZE + 2})) / {SIZE + 2}.0 AS x FROM gs, (SELECT unnest(range(0, {SIZE + 2})) AS i) GROUP BY ALL),
fn AS (SELECT utt, max(frame) + 1 AS n FROM iv GROUP BY utt),
z AS (SELECT utt, unnest(range((n // 2 + 1) * {SIZE + 2} - {SIZE // 2 + 1}, (n // 2 + 1) * {SIZE + 2})) AS pos, 0.0 AS x FROM fn WHERE n % 2 = 0)
SELECT utt, pos, {r('sum(x)', 4)} AS x FROM (SELECT utt, frame * {SIZE // 2 + 1} + i AS pos, x FROM iv UNION ALL SELECT * FROM z) GROUP BY ALL"""


@query("signal_gain_control", GAIN)
def gain_control(spark, folder):
    return D.gain_control(V.samples(spark, folder), U, 16000, SIZE, 3).withColumn("x", rounded("x", 4))


@query("signal_mel_weights_wide", f"""
WITH {wide_weights(128, 16000, 20, 1.0)}, e AS (SELECT vec_id, i - 1 AS bin, abs(embedding[i]::DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
SELECT vec_id, filter::INT AS filter, {r('sum(v * w)', 8)} AS v FROM e JOIN wt USING (bin) WHERE w > 0 GROUP BY ALL""")
def mel_weights_wide(spark, folder):
    w = S.mel_weight_table(spark, S.mel_weights_wide(128, 16000, 20).T)
    e = V.frames(spark, folder).select("vec_id", F.posexplode("feat").alias("bin", "v"))
    x = e.join(F.broadcast(w), "bin").groupBy("vec_id", "filter").agg(F.sum(F.abs(F.col("v").cast("double")) * F.col("w")).alias("v"))
    return x.withColumn("v", rounded("v", 8))


@query("signal_utterance_features", f"""
{SIG}, c AS (SELECT utt, pos, floor((sign(x) * ln(1 + 255.0 * abs(x / max(abs(x)) OVER (PARTITION BY utt) * 0.999)) / ln(256.0) + 1) / 2 * 255.0 + 0.5)::INT AS code FROM signal),
e AS (SELECT utt, max(pos) - min(pos) AS n FROM c WHERE abs(code - 127) > 2 GROUP BY utt HAVING max(pos) > min(pos))
SELECT utt, m * 4 AS timesteps, m AS n_frames FROM (SELECT utt, (n + 8 - 8) // 4 + CASE WHEN n % 4 = 0 THEN 0 ELSE 1 END AS m0, CASE WHEN n % 4 = 0 THEN (n + 2 * 4 - 8) // 4 + 1 ELSE (n + 2 * 4 - 8) // 4 + 2 END AS m FROM e)""")
def utterance_features(spark, folder):
    return D.utterance_features(V.samples(spark, folder), U, 8, 4, RATE, BANDS)["manifest"]


@query("signal_utterance_mel", f"""
{SIG}, p AS (SELECT utt, pos, x / max(abs(x)) OVER (PARTITION BY utt) * 0.999 AS x FROM signal),
c0 AS (SELECT utt, pos, x, floor((sign(x) * ln(1 + 255.0 * abs(x)) / ln(256.0) + 1) / 2 * 255.0 + 0.5)::INT AS code FROM p),
e AS (SELECT utt, min(pos) AS a, max(pos) AS b FROM c0 WHERE abs(code - 127) > 2 GROUP BY utt),
trimmed AS (SELECT c0.utt, c0.pos - a AS pos, c0.x FROM c0 JOIN e USING (utt) WHERE c0.pos >= a AND c0.pos < b),
{spectrum_sql(8, 4, 'trimmed', padded_frames_sql)}, {bank_formula(5, RATE, 125.0, 7600.0, BANDS)}, {LEVELS}""")
def utterance_mel(spark, folder):
    m = D.utterance_features(V.samples(spark, folder), U, 8, 4, RATE, BANDS)["mel"]
    return m.select("utt", "frame", F.posexplode("feat").alias("filter", "v")).withColumn("v", rounded("v", 5))


@query("signal_utterance_codes", f"""
{SIG}, c0 AS (SELECT utt, pos, floor((sign(x) * ln(1 + 255.0 * abs(x / max(abs(x)) OVER (PARTITION BY utt) * 0.999)) / ln(256.0) + 1) / 2 * 255.0 + 0.5)::INT AS code FROM signal),
e AS (SELECT utt, min(pos) AS a, max(pos) - min(pos) AS n FROM c0 WHERE abs(code - 127) > 2 GROUP BY utt HAVING max(pos) > min(pos)),
m AS (SELECT utt, a, n, CASE WHEN n % 4 = 0 THEN n // 4 + 1 ELSE n // 4 + 2 END AS m FROM e),
g AS (SELECT utt, a, n, unnest(range(0, m * 4)) AS pos FROM m)
SELECT g.utt, g.pos, coalesce(CASE WHEN g.pos - 4 < g.n THEN c0.code END, 128) AS code FROM g LEFT JOIN c0 ON c0.utt = g.utt AND c0.pos = g.pos - 4 + g.a AND g.pos >= 4""")
def utterance_codes(spark, folder):
    return D.utterance_features(V.samples(spark, folder), U, 8, 4, RATE, BANDS)["codes"]


@query("signal_mel_scales", f"""
{SIG} SELECT utt, pos, {r('1127.0 * ln(1 + x * 20 / 700.0)')} AS log_mel, {r('m')} AS mel, {r('CASE WHEN m < 15.0 THEN m * 200 / 3.0 ELSE 1000 * exp(ln(6.4) / 27 * (m - 15.0)) END')} AS back
FROM (SELECT utt, pos, x, CASE WHEN x * 20 < 1000 THEN x * 20 / (200 / 3.0) ELSE 15.0 + ln(x * 20 / 1000) / (ln(6.4) / 27) END AS m FROM signal)""")
def mel_scales(spark, folder):
    hz = F.col("x") * 20.0
    s = V.samples(spark, folder).select("utt", "pos", S.hertz_to_mel(hz).alias("log_mel"), S.herz_to_mel(hz).alias("m"))
    return s.select("utt", "pos", rounded("log_mel").alias("log_mel"), rounded("m").alias("mel"), rounded(S.mel_to_herz(F.col("m"))).alias("back"))


@query("signal_mel_weights", f"""
WITH {mel_formula(64, 16000, 125.0, 3800.0, 20)}, e AS (SELECT vec_id, i - 1 AS bin, abs(embedding[i]::DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
SELECT vec_id, filter::INT AS filter, {r('sum(v * w)')} AS v FROM e JOIN wt USING (bin) WHERE w > 0 GROUP BY ALL""")
def mel_weights(spark, folder):
    w = S.mel_weight_table(spark, S.mel_weights(64, 16000, 125.0, 3800.0, 20))
    e = V.frames(spark, folder).select("vec_id", F.posexplode("feat").alias("bin", "v"))
    x = e.join(F.broadcast(w), "bin").groupBy("vec_id", "filter").agg(F.sum(F.abs(F.col("v").cast("double")) * F.col("w")).alias("v"))
    return x.withColumn("v", rounded("v"))


@query("signal_mulaw", f"""
{SIG}, m AS (SELECT utt, pos, x / 500.0 AS v, sign(x) * ln(1 + 255.0 * abs(x / 500.0)) / ln(256.0) AS y FROM signal), q AS (SELECT *, floor((y + 1) / 2 * 255.0 + 0.5)::INT AS code FROM m)
SELECT utt, pos, {r('y')} AS y, {r('sign(y) / 255.0 * (pow(256.0, abs(y)) - 1)')} AS back, code,
 {r('sign(2 * (code / 255.0) - 1) / 255.0 * (pow(256.0, abs(2 * (code / 255.0) - 1)) - 1)')} AS decoded FROM q""")
def mulaw(spark, folder):
    v = F.col("x") / 500.0
    s = V.samples(spark, folder).select("utt", "pos", S.mulaw(v).alias("y"), S.mulaw_quantize(v).alias("code"))
    return s.select("utt", "pos", rounded("y").alias("y"), rounded(S.inv_mulaw(F.col("y"))).alias("back"), "code",
                    rounded(S.inv_mulaw_quantize(F.col("code"))).alias("decoded"))


@query("signal_levels", f"""
{SIG}, d AS (SELECT utt, pos, 20 * log10(greatest(1e-5, x / 500)) AS db FROM signal)
SELECT utt, pos, {r('db')} AS db, {r('pow(10.0, db * 0.05)')} AS amp, {r('greatest(0.0, least(1.0, (db + 100) / 100))')} AS level, {r('greatest(0.0, least(1.0, (db + 100) / 100)) * 100 - 100')} AS back FROM d""")
def levels(spark, folder):
    s = V.samples(spark, folder).select("utt", "pos", S.amp_to_db(F.col("x") / 500.0).alias("d"))
    level = S.level_normalize(F.col("d"))
    return s.select("utt", "pos", rounded("d").alias("db"), rounded(S.db_to_amp(F.col("d"))).alias("amp"), rounded(level).alias("level"),
                    rounded(S.level_denormalize(level)).alias("back"))


@query("signal_complex_forms", f"""
WITH c AS (SELECT vec_id, i, embedding[2 * i + 1]::DOUBLE AS re, embedding[2 * i + 2]::DOUBLE AS im FROM embeddings, (SELECT unnest(range(0, 32)) AS i))
SELECT vec_id, i::INT AS i, {r('sqrt(re*re + im*im)')} AS size, {r('atan2(im, re)')} AS angle, {r('sin(atan2(im, re))')} AS sin, {r('cos(atan2(im, re))')} AS cos, {r('re')} AS re, {r('im')} AS im FROM c""")
def complex_forms(spark, folder):
    z = S.real_to_complex_view(F.col("feat").cast("array<double>"))
    x = V.frames(spark, folder).select("vec_id", F.posexplode(z).alias("i", "c"))
    size, angle = S.complex_to_abs(F.col("c")), S.complex_to_angle(F.col("c"))
    sc = S.angle_to_sin_cos(angle)
    back = S.abs_and_angle_to_complex(size, S.sin_cos_to_angle(sc["sin"], sc["cos"]))
    return x.select("vec_id", "i", rounded(size).alias("size"), rounded(angle).alias("angle"), rounded(sc["sin"]).alias("sin"),
                    rounded(sc["cos"]).alias("cos"), rounded(back["re"]).alias("re"), rounded(back["im"]).alias("im"))


@query("signal_frame_windows", f"""
SELECT vec_id, i::INT AS i, {r('embedding[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 64))')} AS hann, {r('embedding[i + 1] * sin(pi() * (i + 0.5) / 64)')} AS sine
FROM embeddings, (SELECT unnest(range(0, 64)) AS i)""")
def frame_windows(spark, folder):
    f = V.frames(spark, folder).withColumn("f", F.col("feat").cast("array<double>"))
    x = f.select("vec_id", F.posexplode(F.arrays_zip(S.windowed(F.col("f"), S.hann(64)).alias("h"), S.windowed(F.col("f"), S.sine(64)).alias("s"))).alias("i", "z"))
    return x.select("vec_id", "i", rounded("z.h").alias("hann"), rounded("z.s").alias("sine"))


@query("signal_kaiser_window", f"""
WITH b AS (SELECT i, sum(pow(y / 2, 2 * k) / pow(gamma(k + 1), 2)) AS num FROM (SELECT i, pi() * 6.5 * sqrt(greatest(0.0, 1 - pow(2.0 * i / 63 - 1, 2))) AS y FROM (SELECT unnest(range(0, 64)) AS i)), (SELECT unnest(range(0, 60)) AS k) GROUP BY i),
d AS (SELECT sum(pow(pi() * 6.5 / 2, 2 * k) / pow(gamma(k + 1), 2)) AS den FROM (SELECT unnest(range(0, 60)) AS k))
SELECT vec_id, i::INT AS i, {r('embedding[i + 1] * num / den', 5)} AS v FROM embeddings, b, d""")
def kaiser_window(spark, folder):
    f = V.frames(spark, folder).select("vec_id", F.posexplode(S.windowed(F.col("feat").cast("array<double>"), S.kaiserbessel(64))).alias("i", "v"))
    return f.withColumn("v", rounded("v", 5))


@query("signal_frame_arithmetic", """
SELECT doc_id, m AS frames, 768 AS "left", (m - 1) * 256 + 1024 - (n_chars + 1536) + 768 AS "right" FROM (
 SELECT doc_id, n_chars, CASE WHEN n_chars % 256 = 0 THEN (n_chars + 512) // 256 + 1 ELSE (n_chars + 512) // 256 + 2 END AS m FROM documents)""")
def frame_arithmetic(spark, folder):
    n = F.col("n_chars")
    pad = S.lws_pad(n, 1024, 256)
    d = V.table(spark, folder, "documents").select("doc_id", S.lws_num_frames(n, 1024, 256).alias("frames"), pad["left"].alias("left"), pad["right"].alias("right"))
    return d.withColumn("left", F.col("left").cast("int"))


@query("array_trailing_zero_mask", f"""
{SIG}, z AS (SELECT utt, pos // 8 AS chunk, pos % 8 AS i, CASE WHEN x > 40 THEN x ELSE 0 END AS v FROM signal),
l AS (SELECT utt, chunk, max(CASE WHEN v <> 0 THEN i END) AS last FROM z GROUP BY ALL)
SELECT utt, chunk, i::INT AS step, CASE WHEN i <= coalesce(last, -1) THEN 1 ELSE 0 END AS mask FROM z JOIN l USING (utt, chunk)""")
def trailing_zero_mask(spark, folder):
    v = F.when(F.col("x") > 40, F.col("x")).otherwise(0.0)
    x = V.samples(spark, folder).select("utt", F.expr("pos div 8").alias("chunk"), F.struct("pos", v.alias("v")).alias("s"))
    x = x.groupBy("utt", "chunk").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return x.select("utt", "chunk", F.posexplode(AR.trailing_zero_mask(F.col("s.v"))).alias("step", "mask"))


@query("join_nearest_timing_symbol", f"""
{SIG}, g AS (SELECT user_id AS utt, event_id, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 / 200000.0, 0.0) AS t FROM events)
SELECT utt, event_id, CASE WHEN a = 1 THEN ' ' WHEN a = 2 THEN '1' WHEN a = 3 THEN '2' WHEN a = 4 THEN '3' ELSE '4' END AS symbol FROM (
 SELECT utt, event_id, list_position(d, list_min(d)) AS a FROM (SELECT utt, event_id, [abs(t), abs(t - 0.01), abs(t - 0.02), abs(t - 0.08), abs(t - 0.25)] AS d FROM g))""")
def nearest_timing_symbol(spark, folder):
    from seqprep.operators.blocks import local_window, position

    ev = V.table(spark, folder, "events").select(F.col("user_id").alias("utt"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    x = position(ev, ["utt"], ["ts", "event_id"])
    x = local_window(x, U, 1, 0, {"_before": lambda w: F.lag("ts").over(w)})
    gap = F.coalesce((F.unix_micros("ts") - F.unix_micros("_before")) / 1e6 / 200000.0, F.lit(0.0))
    return x.select("utt", "event_id", SC.nearest_timing_symbol(gap).alias("symbol"))


@query("join_repeat_to_resolution", f"""
{SIG}, n AS (SELECT utt, count(*) AS n FROM signal GROUP BY utt), f AS (SELECT utt, pos // 10 AS frame, max(x) AS a, min(x) AS b FROM signal GROUP BY ALL)
SELECT s.utt, s.pos, coalesce(f.a, 0.0) AS a, coalesce(f.b, 0.0) AS b FROM signal s JOIN n USING (utt) LEFT JOIN f ON f.utt = s.utt AND f.frame = s.pos // (n // ((n + 9) // 10))""")
def repeat_to_resolution(spark, folder):
    from seqprep.operators.blocks import with_totals

    s = V.samples(spark, folder)
    x = with_totals(s, U, {"n": F.count("*")}).select("utt", "pos", "n", F.expr("(n + 9) div 10").alias("n_frames"))
    f = s.groupBy("utt", F.expr("pos div 10").alias("frame")).agg(F.array(F.max("x"), F.min("x")).alias("feat"))
    out = J.repeat_to_resolution(x, f, "utt")
    return out.select("utt", "pos", F.col("feat")[0].alias("a"), F.col("feat")[1].alias("b"))


@query("sample_random_crop", f"""
{SIG}, n AS (SELECT utt, count(*) AS n FROM signal GROUP BY utt), h AS (SELECT utt, n, ('0x' || left(md5('crop:' || utt), 8))::BIGINT AS d FROM n),
c AS (SELECT utt, CASE WHEN n > 32 THEN d % greatest(n // 8 - 4, 1) * 8 ELSE 0 END AS a, CASE WHEN n > 32 THEN d % greatest(n // 8 - 4, 1) * 8 + 32 ELSE n - n % 8 END AS b FROM h)
SELECT utt, pos - a AS pos, x FROM signal JOIN c USING (utt) WHERE pos >= a AND pos < b""")
def random_crop(spark, folder):
    from seqprep.operators.blocks import with_totals

    x = with_totals(V.samples(spark, folder), U, {"n": F.count("*")})
    x = x.withColumn("c", K.random_crop(F.col("n"), 35, 8, "crop", "utt"))
    return x.where("pos >= c.start and pos < c.stop").select("utt", (F.col("pos") - F.col("c.start")).alias("pos"), "x")


TR = f"WITH {Q.TRACE}"


@query("stroke_clear_middle", f"""
{TR}, n AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS b_y FROM trace WINDOW w AS (PARTITION BY doc ORDER BY idx))
SELECT doc, idx, x, y, eos FROM n WHERE ax IS NULL OR bx IS NULL OR sqrt(pow(x - ax, 2) + pow(y - ay, 2)) + sqrt(pow(x - bx, 2) + pow(y - b_y, 2)) <= 150""")
def clear_middle(spark, folder):
    return P.clear_middle(V.trace(spark, folder), ["doc"], 150.0)


SEPARATE = f"""{TR}, n AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d, sqrt(pow(x - lead(x) OVER w, 2) + pow(y - lead(y) OVER w, 2)) AS e FROM trace WINDOW w AS (PARTITION BY doc ORDER BY idx)),
seg AS (SELECT doc, idx, x, y, (coalesce(e > 60, true) OR eos = 1)::INT AS eos, sum(CASE WHEN d > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY idx)::BIGINT AS segment FROM n)"""


@query("stroke_separate", f"{SEPARATE} SELECT * FROM seg")
def separate(spark, folder):
    return P.separate(V.trace(spark, folder), ["doc"], 60.0)


@query("filter_lone_points", f"""{SEPARATE}, c AS (SELECT *, count(*) OVER (PARTITION BY doc, segment) AS n, max(segment) OVER (PARTITION BY doc) AS k FROM seg)
SELECT doc, idx, x, y, eos, segment FROM c WHERE n > 1 OR k = 0""")
def lone_points(spark, folder):
    return FL.lone_point_filter(P.separate(V.trace(spark, folder), ["doc"], 60.0), ["doc"])


@query("stroke_offsets", f"""
{TR} SELECT doc, idx, coalesce(x - lag(x) OVER w, 0.0) AS dx, coalesce(y - lag(y) OVER w, 0.0) AS dy, CASE WHEN idx = 0 THEN 1 ELSE eos END AS eos FROM trace WINDOW w AS (PARTITION BY doc ORDER BY idx)""")
def offsets(spark, folder):
    return P.offsets(V.trace(spark, folder), ["doc"])


@query("stroke_line_normalize", f"""
{TR}, n AS (SELECT doc, idx, x - min(x) OVER (PARTITION BY doc) AS x, y - avg(y) OVER (PARTITION BY doc) AS y, eos FROM trace), s AS (SELECT stddev_pop(y) AS s FROM n)
SELECT doc, idx, {r('x / s')} AS x, {r('y / s')} AS y, eos FROM n, s""")
def line_normalize(spark, folder):
    return P.line_normalize(V.trace(spark, folder), ["doc"]).withColumn("x", rounded("x")).withColumn("y", rounded("y"))


@query("stroke_largest_gaps", f"""
{TR}, m AS (SELECT doc, idx, (x + x + 2) / 2 AS mx, (y + y + 4) / 2 AS my FROM trace), g AS (SELECT *, abs(mx - lag(mx) OVER w) + abs(my - lag(my) OVER w) AS gap FROM m WINDOW w AS (PARTITION BY doc ORDER BY idx)),
k AS (SELECT doc, idx, row_number() OVER (PARTITION BY doc ORDER BY gap DESC, idx) AS rk FROM g WHERE gap IS NOT NULL)
SELECT doc, idx, sum(CASE WHEN rk <= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY idx)::BIGINT AS line FROM g LEFT JOIN k USING (doc, idx)""")
def largest_gaps(spark, folder):
    t = V.trace(spark, folder)
    s = t.select("doc", "idx", F.col("x").alias("x_min"), (F.col("x") + 2).alias("x_max"), F.col("y").alias("y_min"), (F.col("y") + 4).alias("y_max"))
    return P.largest_gaps(s, ["doc"], 4).select("doc", "idx", "line")
