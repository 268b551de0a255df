"""Radio bursts, fingerprints, classifier decisions and voice activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.functions import severity, vectors
from contrail.operators import evaluate, phy, voice
from contrail.plans import views
from contrail.plans.registry import R, r, register, us


def bursts(spark, sf):
    """Embeddings as bursts: the first half of the vector is I, the second Q."""
    d = views.table(spark, sf, "embeddings")
    return d.select(
        "vec_id",
        F.timestamp_seconds("vec_id").alias("time"),
        F.col("label").cast("string").alias("icao24"),
        F.lit(2e6).alias("sample_rate"),
        F.slice("embedding", 1, 32).alias("i"),
        F.slice("embedding", 33, 32).alias("q"),
    )


TAU = "(2 * pi())"
LONG = f"""WITH z AS (SELECT vec_id, label, k, embedding[k + 1]::DOUBLE AS i, embedding[k + 33]::DOUBLE AS q
  FROM embeddings, range(32) r(k)),
a AS (SELECT *, sqrt(i * i + q * q) AS amp, atan2(q, i) AS ang, atan2(q, i) - lag(atan2(q, i)) OVER (PARTITION BY vec_id ORDER BY k) AS d FROM z),
t AS (SELECT *, d - {TAU} * floor((d + pi()) / {TAU}) AS turn FROM a),
p AS (SELECT *, first_value(ang) OVER w + coalesce(sum(turn) OVER w, 0) AS phase FROM t
  WINDOW w AS (PARTITION BY vec_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT *, avg(amp) OVER (PARTITION BY vec_id) AS mu, avg(phase) OVER (PARTITION BY vec_id) AS pm FROM p),
s AS (SELECT *, sum(phase * (k - 15.5)) OVER (PARTITION BY vec_id) / sum((k - 15.5) * (k - 15.5)) OVER (PARTITION BY vec_id) AS slope FROM m)"""


@register(
    "burst_features",
    f"""{LONG} SELECT vec_id, {R('avg(turn) * 2e6 / (2 * pi())', 3)} AS cfo_mean, {R('stddev_pop(turn) * 2e6 / (2 * pi())', 3)} AS cfo_std,
    {R('(arg_max(turn, k) - arg_min(turn, k)) * 2e6 / (2 * pi())', 3)} AS cfo_drift, {R('avg(amp)', 6)} AS amp_mean, {R('stddev_pop(amp)', 6)} AS amp_std,
    {R('avg(pow(amp - mu, 3)) / pow(avg(pow(amp - mu, 2)), 1.5)', 6)} AS amp_skew, {R('avg(pow(amp - mu, 4)) / pow(avg(pow(amp - mu, 2)), 2) - 3', 6)} AS amp_kurtosis,
    {R('stddev_pop(phase)', 6)} AS phase_std, {R('stddev_pop(turn)', 6)} AS phase_jitter,
    {R('1 - stddev_pop(phase - pm - slope * (k - 15.5)) / (stddev_pop(phase) + 1e-10)', 6)} AS phase_linearity,
    {R('10 * log10(avg(amp * amp) / ((sum(amp * amp) FILTER (k = 0) + sum(amp * amp) FILTER (k = 31)) / 2))', 6)} AS snr_estimate
    FROM s GROUP BY vec_id""",
)
def burst_features(spark, sf):
    d = phy.burst_features(bursts(spark, sf))
    return d.select(
        "vec_id", *[r(c, 3).alias(c) for c in ("cfo_mean", "cfo_std", "cfo_drift")],
        *[r(c, 6).alias(c) for c in ("amp_mean", "amp_std", "amp_skew", "amp_kurtosis", "phase_std", "phase_jitter",
                                     "phase_linearity", "snr_estimate")],
    )


@register(
    "burst_preamble",
    f"""{LONG}, h AS (SELECT vec_id, k, amp, max(amp) OVER (PARTITION BY vec_id) AS top FROM s WHERE k < 16),
    g AS (SELECT vec_id, min(k) FILTER (amp / top >= 0.9) - min(k) FILTER (amp / top >= 0.1) AS rise, max(amp) FILTER (k < 12) AS peak,
      avg(amp) FILTER (k >= 12) AS steady FROM h GROUP BY vec_id)
    SELECT vec_id, {R('rise / 2e6 * 1e6', 6)} AS preamble_rise_time, {R('greatest(0, (peak - steady) / steady * 100)', 4)} AS preamble_overshoot,
    0.0::DOUBLE AS preamble_ringing FROM g""",
)
def burst_preamble(spark, sf):
    d = phy.burst_features(bursts(spark, sf))
    return d.select("vec_id", r("preamble_rise_time", 6).alias("preamble_rise_time"),
                    r("preamble_overshoot", 4).alias("preamble_overshoot"), "preamble_ringing")


@register(
    "burst_spectrum",
    f"""{LONG}, c AS (SELECT vec_id, k, (i - avg(i) OVER v) * (0.5 - 0.5 * cos({TAU} * k / 32)) AS i, (q - avg(q) OVER v) * (0.5 - 0.5 * cos({TAU} * k / 32)) AS q
      FROM s WINDOW v AS (PARTITION BY vec_id)),
    x AS (SELECT vec_id, f, sum(i * cos({TAU} * f * k / 32) + q * sin({TAU} * f * k / 32)) AS re, sum(q * cos({TAU} * f * k / 32) - i * sin({TAU} * f * k / 32)) AS im
      FROM c, range(32) r(f) GROUP BY ALL),
    w AS (SELECT vec_id, CASE WHEN f < 16 THEN f ELSE f - 32 END / 32.0::DOUBLE * 2e6 AS hz, (re * re + im * im) / (2e6 * 12) AS p FROM x),
    n AS (SELECT *, p / sum(p) OVER (PARTITION BY vec_id) AS share FROM w), o AS (SELECT *, sum(hz * share) OVER (PARTITION BY vec_id) AS centre FROM n)
    SELECT vec_id, {R('sum(hz * share)', 2)} AS spectral_centroid, {R('sqrt(sum(pow(hz - centre, 2) * share))', 2)} AS spectral_spread,
    {R('exp(avg(ln(p + 1e-10))) / (avg(p) + 1e-10)', 6)} AS spectral_flatness FROM o GROUP BY vec_id""",
)
def burst_spectrum(spark, sf):
    d = phy.burst_features(bursts(spark, sf))
    return d.select("vec_id", r("spectral_centroid", 2).alias("spectral_centroid"),
                    r("spectral_spread", 2).alias("spectral_spread"), r("spectral_flatness", 6).alias("spectral_flatness"))


# --- fingerprints ----------------------------------------------------------------------


def history(spark, sf):
    return views.table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("icao24"), F.timestamp_seconds("vec_id").alias("time"),
        F.col("embedding").alias("vector"),
    )


DIMS = "dims AS (SELECT vec_id, label, k, embedding[k]::DOUBLE AS x FROM embeddings, range(1, 65) r(k))"


@register(
    "fingerprint",
    f"""WITH {DIMS}, n AS (SELECT vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 100),
    g AS (SELECT label, k, avg(x) AS m, count(*) AS c FROM dims SEMI JOIN n USING (vec_id) GROUP BY ALL)
    SELECT CAST(label AS VARCHAR) AS icao24, max(c) AS samples, {R('sum(m)', 5)} AS total, {R('sqrt(sum(m * m))', 5)} AS length
    FROM g WHERE c >= 5 GROUP BY label""",
)
def fingerprint(spark, sf):
    d = phy.fingerprint(history(spark, sf), 64)
    total = F.aggregate("fingerprint", F.lit(0.0), lambda a, x: a + x)
    return d.select("icao24", "samples", r(total, 5).alias("total"), r(vectors.norm(F.col("fingerprint")), 5).alias("length"))


def consistency_sql(rows: str, least: int) -> str:
    return f"""WITH {DIMS}, h AS (SELECT vec_id, k, x, avg(x) OVER w AS m, count(*) OVER w AS n FROM dims
      WINDOW w AS (PARTITION BY label, k ORDER BY vec_id ROWS BETWEEN {rows})),
    c AS (SELECT vec_id, max(n) AS n, sum(x * m) / ((sqrt(sum(x * x)) + 1e-10) * (sqrt(sum(m * m)) + 1e-10)) AS s FROM h GROUP BY vec_id)
    SELECT vec_id, n AS history_n, CASE WHEN n >= {least} THEN {R('CASE WHEN s < 0 THEN 0 ELSE s END', 6)} ELSE 1.0 END AS consistency FROM c"""


@register("history_consistency", consistency_sql("99 PRECEDING AND CURRENT ROW", 5))
def history_consistency(spark, sf):
    d = phy.history_consistency(history(spark, sf), 64, chunk_seconds=100)
    return d.select("vec_id", "history_n", r("consistency", 6).alias("consistency"))


@register("embedding_consistency", consistency_sql("50 PRECEDING AND 1 PRECEDING", 3))
def embedding_consistency(spark, sf):
    d = phy.history_consistency(history(spark, sf), 64, 50, 3, False, chunk_seconds=100)
    return d.select("vec_id", "history_n", r("consistency", 6).alias("consistency"))


@register(
    "vector_similarity",
    f"""WITH {DIMS}, c AS (SELECT a.vec_id, sum(a.x * b.x) / ((sqrt(sum(a.x * a.x)) + 1e-10) * (sqrt(sum(b.x * b.x)) + 1e-10)) AS s
      FROM dims a JOIN dims b ON b.vec_id = a.vec_id + 1 AND a.k = b.k GROUP BY a.vec_id)
    SELECT vec_id, {R('CASE WHEN s < 0 THEN 0 ELSE s END', 6)} AS similarity FROM c""",
)
def vector_similarity(spark, sf):
    d = history(spark, sf).select("vec_id", "vector")
    following = d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("following"))
    return d.join(following, "vec_id").select(
        "vec_id", r(vectors.cosine(F.col("vector"), F.col("following")), 6).alias("similarity")
    )


@register(
    "phy_decisions",
    f"""WITH d AS (SELECT event_id, value / 491 AS p, (event_id % 100) / 100.0::DOUBLE AS c FROM events),
    u AS (SELECT *, 1 - greatest(p, 1 - p) AS uncertainty, 0.7::DOUBLE * p + 0.3::DOUBLE * (1 - c) AS combined FROM d)
    SELECT event_id, CASE WHEN uncertainty > 0.3 THEN 'uncertain' WHEN combined > 0.5 THEN 'spoofed' ELSE 'legitimate' END AS prediction,
    uncertainty > 0.3 AS abstained, {R('uncertainty', 8)} AS uncertainty, CASE WHEN NOT uncertainty > 0.3 THEN {R('combined', 8)} END AS combined_score FROM u""",
)
def phy_decisions(spark, sf):
    d = views.table(spark, sf, "events").select(
        "event_id", severity.phy_decision(F.col("value") / 491, (F.col("event_id") % 100) / 100).alias("d")
    )
    return d.select("event_id", "d.prediction", "d.abstained", r("d.uncertainty", 8).alias("uncertainty"),
                    r("d.combined_score", 8).alias("combined_score"))


@register("phy_classifier")
def phy_classifier(spark, sf):
    """Trained on the vectors of four fifths of the rows (odd label = spoofed), judged on the rest; training is not SQL."""
    d = history(spark, sf).withColumn("label", F.col("icao24").cast("int") % 2)
    held = F.pmod(F.xxhash64(F.to_json(F.struct("icao24", "time"))), F.lit(5)) == 0
    model = phy.train_classifier(d.filter(~held), dim=64, hidden=(16,), max_iter=30)
    return evaluate.classifier_metrics(phy.classify(model, d.filter(held)))


# --- voice -----------------------------------------------------------------------------


def frames(spark, sf):
    return as_frames(views.table(spark, sf, "events"))


def as_frames(events):
    """Events as 100 ms audio frames, 2500 to a channel, level from their value."""
    eid = F.col("event_id")
    level = (F.col("value") / 5000).cast("float")
    return events.select(
        F.timestamp_micros(F.lit(1704067200000000) + eid * 100_000).alias("time"),
        F.concat(F.lit("ch"), F.expr("event_id div 2500").cast("string")).alias("sensor_id"),
        F.lit(118.7).alias("frequency_mhz"),
        F.array(level, -level, level).alias("samples"),
    )


FRAMES = """WITH f AS (SELECT event_id AS i, 'ch' || CAST(event_id // 2500 AS VARCHAR) AS sensor_id, CAST(value / 5000 AS FLOAT)::DOUBLE AS level FROM events),
e AS (SELECT *, level * level AS power, 10 * log10(level * level + 1e-10) AS db FROM f)"""


@register("frame_energy", f"{FRAMES} SELECT i AS frame, {R('db', 5)} AS db FROM e")
def frame_energy(spark, sf):
    index = ((us("time") - 1704067200000000) / 100_000).cast("long")
    return frames(spark, sf).select(index.alias("frame"), r(vectors.energy_db(F.col("samples")), 5).alias("db"))


@register(
    "voice_sessions",
    f"""{FRAMES}, l AS (SELECT *, CASE WHEN i - lag(i) OVER w > 6 OR lag(i) OVER w IS NULL THEN i END AS s FROM e WHERE db > -30
      WINDOW w AS (PARTITION BY sensor_id ORDER BY i)),
    g AS (SELECT *, max(s) OVER (PARTITION BY sensor_id ORDER BY i) AS start FROM l),
    x AS (SELECT e.*, g.start, g.i AS loud FROM e ASOF JOIN g ON e.sensor_id = g.sensor_id AND e.i >= g.i)
    SELECT sensor_id, 1704067200000000 + start * 100000 AS start, count(*) AS frames, {R('count(*) * 0.1', 3)} AS duration_seconds,
    {R('10 * log10(avg(power) + 1e-10)', 4)} AS signal_level FROM x WHERE i - loud <= 6 GROUP BY sensor_id, x.start HAVING count(*) >= 5""",
)
def voice_sessions(spark, sf):
    d = voice.voice_sessions(frames(spark, sf), chunk_seconds=60)
    return d.select("sensor_id", us("start").alias("start"), "frames", r("duration_seconds", 3).alias("duration_seconds"),
                    r("signal_level", 4).alias("signal_level"))
