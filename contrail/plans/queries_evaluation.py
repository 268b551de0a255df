"""Detector evaluation and attack augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.operators import augment, evaluate, ordered
from contrail.plans import views
from contrail.plans.registry import R, r, register, us
from contrail.plans.views import ALERTS_SQL, MESSAGES_SQL, messages

M = "WITH " + MESSAGES_SQL


def scored_docs(spark, sf):
    """Labelled documents: low quality is the anomaly, brevity its score."""
    d = views.table(spark, sf, "documents").join(views.table(spark, sf, "labels"), "doc_id")
    return d.select(
        "doc_id",
        (1 - F.col("quality")).cast("int").alias("label"),
        "toxic",
        F.when(F.col("toxic") == 1, F.col("source")).otherwise("none").alias("attack_type"),
        (1 / (1 + F.col("n_chars") / 1000)).alias("score"),
        (F.col("n_chars") % 97 / 10).alias("seconds"),
    )


DOCS = """WITH d AS (SELECT doc_id, 1 - quality AS label, toxic, CASE WHEN toxic = 1 THEN source ELSE 'none' END AS attack_type,
  1 / (1 + n_chars / 1000.0::DOUBLE) AS score, n_chars % 97 / 10.0::DOUBLE AS seconds FROM documents JOIN labels USING (doc_id))"""

ROC = f"""{DOCS}, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM d GROUP BY score),
c AS (SELECT score AS threshold, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""


@register("roc_curve", f"{ROC} SELECT {R('threshold', 9)} AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM c")
def roc_curve(spark, sf):
    return evaluate.roc_curve(scored_docs(spark, sf)).select(r("threshold", 9).alias("threshold"), "tp", "fp")


FAR = 0.05
BEST = f"""{ROC}, k AS (SELECT threshold, tp, fp, p, n FROM c UNION ALL SELECT 'inf'::DOUBLE, 0, 0, max(p), max(n) FROM c),
b AS (SELECT * FROM k ORDER BY abs(fp / n - {FAR}), threshold DESC LIMIT 1)"""


@register(
    "detector_metrics",
    f"""{BEST} SELECT {R('(SELECT sum(neg * (tp - pos / 2.0::DOUBLE)) / (max(p) * max(n)) FROM c)', 8)} AS auc_roc,
    {R('threshold', 9)} AS threshold_at_target_far, {R('fp / n', 8)} AS actual_far_at_threshold,
    {R('tp / p', 8)} AS tpr_at_target_far, {R('tp / (tp + fp)', 8)} AS precision_at_target_far,
    {R('tp / p', 8)} AS recall_at_target_far, CAST(tp AS BIGINT) AS true_positives, CAST(n - fp AS BIGINT) AS true_negatives,
    CAST(fp AS BIGINT) AS false_positives, CAST(p - tp AS BIGINT) AS false_negatives,
    {R('(tp + n - fp) / (p + n)', 8)} AS accuracy, {R('tp / (tp + fp)', 8)} AS "precision", {R('tp / p', 8)} AS recall,
    {R('2 * tp / (2 * tp + fp + p - tp)', 8)} AS f1_score, {R('(n - fp) / n', 8)} AS specificity FROM b""",
)
def detector_metrics(spark, sf):
    d = evaluate.evaluate_detector(scored_docs(spark, sf), target_far=FAR).drop("operating_points")
    names = ("auc_roc", "actual_far_at_threshold", "tpr_at_target_far", "precision_at_target_far",
             "recall_at_target_far", "accuracy", "precision", "recall", "f1_score", "specificity")
    return d.withColumns({**{c: r(c, 8) for c in names}, "threshold_at_target_far": r("threshold_at_target_far", 9)})


@register(
    "time_to_detect",
    f"""{BEST}, x AS (SELECT d.seconds FROM d, b WHERE label = 1 AND d.score >= b.threshold)
    SELECT {R('avg(seconds)', 6)} AS mean_time_to_detect, min(seconds) AS min_time_to_detect, max(seconds) AS max_time_to_detect,
    {R('quantile_cont(seconds, 0.5)', 6)} AS median_time_to_detect, {R('quantile_cont(seconds, 0.95)', 6)} AS p95_time_to_detect FROM x""",
)
def time_to_detect(spark, sf):
    d = evaluate.evaluate_detector(scored_docs(spark, sf), target_far=FAR, detection_time="seconds")
    return d.select(
        r("mean_time_to_detect", 6).alias("mean_time_to_detect"), "min_time_to_detect", "max_time_to_detect",
        r("median_time_to_detect", 6).alias("median_time_to_detect"), r("p95_time_to_detect", 6).alias("p95_time_to_detect"),
    )


@register(
    "exact_quantiles",
    f"""SELECT {R('quantile_cont(l_extendedprice, 0.1)', 3)} AS p10, {R('quantile_cont(l_extendedprice, 0.5)', 3)} AS p50,
    {R('quantile_cont(l_extendedprice, 0.95)', 3)} AS p95 FROM lineitem""",
)
def exact_quantiles(spark, sf):
    d = ordered.exact_quantiles(views.table(spark, sf, "lineitem"), "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p95": 0.95})
    return d.select(*[r(c, 3).alias(c) for c in ("p10", "p50", "p95")])


@register(
    "confusion_matrix",
    f"""{DOCS}, c AS (SELECT count(*) FILTER (score >= 0.4 AND label = 1) AS tp, count(*) FILTER (score >= 0.4 AND label <> 1) AS fp,
    count(*) FILTER (score < 0.4 AND label = 1) AS fn, count(*) FILTER (score < 0.4 AND label <> 1) AS tn FROM d)
    SELECT *, {R('(tp + tn) / (tp + fp + fn + tn)', 8)} AS accuracy, {R('coalesce(tp / nullif(tp + fp, 0), 0)', 8)} AS "precision",
    {R('coalesce(tp / nullif(tp + fn, 0), 0)', 8)} AS recall, {R('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 8)} AS f1,
    {R('coalesce(tn / nullif(tn + fp, 0), 0)', 8)} AS specificity FROM c""",
)
def confusion_matrix(spark, sf):
    d = evaluate.confusion(scored_docs(spark, sf), 0.4)
    return d.withColumns({c: r(c, 8) for c in ("accuracy", "precision", "recall", "f1", "specificity")})


@register(
    "operating_points",
    f"""{DOCS}, c AS (SELECT t AS threshold, count(*) FILTER (score >= t AND label = 1) AS tp,
    count(*) FILTER (score >= t AND label <> 1) AS fp, count(*) FILTER (label = 1) AS p
    FROM d, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) v(t) GROUP BY t)
    SELECT threshold, {R('coalesce(tp / nullif(tp + fp, 0), 0)', 8)} AS "precision", {R('coalesce(tp / nullif(p, 0), 0)', 8)} AS recall,
    {R('coalesce(2 * tp / nullif(tp + fp + p, 0), 0)', 8)} AS f1 FROM c""",
)
def operating_points(spark, sf):
    d = evaluate.operating_points(scored_docs(spark, sf))
    return d.withColumns({c: r(c, 8) for c in ("precision", "recall", "f1")})


@register(
    "attack_type_metrics",
    f"""{DOCS} SELECT attack_type, count(*) AS "count", {R('avg(CAST(score >= 0.3 AS INTEGER))', 8)} AS detection_rate_0_3,
    {R('avg(CAST(score >= 0.5 AS INTEGER))', 8)} AS detection_rate_0_5, {R('avg(CAST(score >= 0.7 AS INTEGER))', 8)} AS detection_rate_0_7,
    {R('avg(score)', 8)} AS mean_score, {R('stddev_pop(score)', 8)} AS std_score, {R('min(score)', 8)} AS min_score,
    {R('max(score)', 8)} AS max_score FROM d WHERE attack_type NOT IN ('none', 'legitimate') GROUP BY attack_type""",
)
def attack_type_metrics(spark, sf):
    d = evaluate.by_attack_type(scored_docs(spark, sf))
    return d.withColumns({c: r(c, 8) for c in d.columns if c not in ("attack_type", "count")})


@register(
    "metric_report",
    f"""{DOCS}, c AS (SELECT count(*) FILTER (score >= 0.5 AND label = 1)::DOUBLE AS tp, count(*) FILTER (score >= 0.5 AND label <> 1)::DOUBLE AS fp,
    count(*) FILTER (score < 0.5 AND label = 1)::DOUBLE AS fn, count(*) FILTER (score < 0.5 AND label <> 1)::DOUBLE AS tn FROM d),
    m AS (SELECT tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS "precision",
    coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1,
    coalesce(tn / nullif(tn + fp, 0), 0)::DOUBLE AS specificity FROM c),
    u AS (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE v) SELECT metric, {R('v', 8)} AS "value" FROM u""",
)
def metric_report(spark, sf):
    d = evaluate.report(evaluate.confusion(scored_docs(spark, sf), 0.5))
    return d.select("metric", r("value", 8).alias("value"))


@register(
    "classifier_metrics",
    """WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 1 AND quality <> 1) AS fp,
    count(*) FILTER (toxic <> 1 AND quality = 1) AS fn, count(*) FILTER (toxic <> 1 AND quality <> 1) AS tn FROM labels)
    SELECT tp, fp, fn, tn FROM c""",
)
def classifier_metrics(spark, sf):
    d = evaluate.classifier_metrics(views.table(spark, sf, "labels"), "toxic", "quality")
    return d.select("tp", "fp", "fn", "tn")


def detector_sql(name: str, score: str, at: float) -> str:
    return f"""SELECT '{name}' AS detector, {R(f'''(SELECT sum(a.k) / (count(*)) FROM (SELECT CASE WHEN x.s > y.s THEN 1.0::DOUBLE
      WHEN x.s = y.s THEN 0.5 ELSE 0 END AS k FROM (SELECT {score} AS s FROM d WHERE label = 1 AND {score} IS NOT NULL AND NOT isnan({score})) x,
      (SELECT {score} AS s FROM d WHERE label <> 1 AND {score} IS NOT NULL AND NOT isnan({score})) y) a)''', 8)} AS auc_roc,
    {R(f'coalesce(count(*) FILTER ({score} >= {at} AND label = 1) / nullif(count(*) FILTER ({score} >= {at}), 0), 0)', 8)} AS "precision",
    {R(f'coalesce(count(*) FILTER ({score} >= {at} AND label = 1) / nullif(count(*) FILTER (label = 1), 0), 0)', 8)} AS recall,
    {R(f'coalesce(2 * count(*) FILTER ({score} >= {at} AND label = 1) / nullif(count(*) FILTER ({score} >= {at}) + count(*) FILTER (label = 1), 0), 0)', 8)} AS f1_score
    FROM d WHERE {score} IS NOT NULL AND NOT isnan({score}) AND label IS NOT NULL"""


#: Some scores are missing, some no numbers, some rows without a label.
HOLES = {"score": "CASE WHEN doc_id % 17 = 0 THEN 'nan'::DOUBLE WHEN doc_id % 19 <> 0 THEN score END", "label": "CASE WHEN doc_id % 23 <> 0 THEN label END"}


@register(
    "detector_comparison",
    f"""{DOCS.replace("WITH d AS", "WITH whole AS")}, d AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in HOLES.items())}) FROM whole)
    {detector_sql('rule_score', '(toxic * 0.5::DOUBLE)', 0.25)} UNION ALL {detector_sql('ml_score', 'score', 0.5)}
    UNION ALL {detector_sql('ensemble', '(0.4::DOUBLE * toxic * 0.5::DOUBLE + 0.6::DOUBLE * score)', 0.4)}""",
)
def detector_comparison(spark, sf):
    i = F.col("doc_id")
    holes = {"score": F.when(i % 17 == 0, float("nan")).when(i % 19 != 0, F.col("score")), "label": F.when(i % 23 != 0, F.col("label"))}
    d = scored_docs(spark, sf).withColumns(holes)
    d = d.withColumns({"rule_score": F.col("toxic") * 0.5, "ml_score": F.col("score")})
    d = d.withColumn("ensemble", F.lit(0.4) * F.col("toxic") * 0.5 + F.lit(0.6) * F.col("score"))
    out = evaluate.compare_detectors(d, {"rule_score": 0.25, "ml_score": 0.5, "ensemble": 0.4})
    return out.withColumns({c: r(c, 8) for c in ("auc_roc", "precision", "recall", "f1_score")})


@register(
    "rolling_alarm_rate",
    f"""WITH {ALERTS_SQL}, w AS (SELECT sensor_id, t, alert_id, avg(CAST(anomaly_score >= 0.2 AS INTEGER)) OVER o AS rate,
      count(*) OVER o AS n FROM alerts WINDOW o AS (PARTITION BY sensor_id ORDER BY t, alert_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
    SELECT sensor_id, t AS time, {R('rate', 6)} AS alarm_rate FROM w WHERE n = 100""",
)
def rolling_alarm_rate(spark, sf):
    d = evaluate.rolling_alarm_rate(
        views.alerts(spark, sf), 0.2, ["sensor_id"], score="anomaly_score", tie=["alert_id"], chunk_seconds=86400
    )
    return d.select("sensor_id", us("time").alias("time"), r("alarm_rate", 6).alias("alarm_rate"))


@register(
    "rolling_alarm_rate_short",
    f"""WITH {ALERTS_SQL} SELECT icao24, max(t) AS time, {R('avg(CAST(anomaly_score >= 0.2 AS INTEGER))', 6)} AS alarm_rate
    FROM alerts GROUP BY icao24""",
)
def rolling_alarm_rate_short(spark, sf):
    """A window no aircraft fills: one overall share each."""
    d = evaluate.rolling_alarm_rate(
        views.alerts(spark, sf), 0.2, ["icao24"], window=100_000_000, score="anomaly_score", chunk_seconds=86400
    )
    return d.select("icao24", us("time").alias("time"), r("alarm_rate", 6).alias("alarm_rate"))


# --- augmentation --------------------------------------------------------------------


@register(
    "spoof_clone",
    f"""{M} SELECT ingest_seq, 'fake01' AS icao24, {R('latitude + 0.1::DOUBLE', 6)} AS latitude, {R('longitude + 0.2::DOUBLE', 6)} AS longitude,
    'GHOST' AS callsign, 'spoofed' AS label, 'spoof_clone' AS attack_type FROM messages WHERE icao24 = '3'""",
)
def spoof_clone(spark, sf):
    d = augment.spoof_clone(messages(spark, sf).filter("icao24 = '3'"), "fake01", 0.1, 0.2, "GHOST")
    return d.select("ingest_seq", "icao24", r("latitude", 6).alias("latitude"), r("longitude", 6).alias("longitude"),
                    "callsign", "label", "attack_type")


@register(
    "replay_attack",
    f"""{M} SELECT ingest_seq, icao24, t + 300000000 AS time, 'replay' AS label, 'replay' AS attack_type,
    CAST(300 AS INTEGER) AS replay_delay_sec FROM messages""",
)
def replay_attack(spark, sf):
    d = augment.replay(messages(spark, sf), 300)
    return d.select("ingest_seq", "icao24", us("time").alias("time"), "label", "attack_type", "replay_delay_sec")


NUMBERED = f"""{M}, m AS (SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY t) - 1 AS i,
  count(*) OVER (PARTITION BY icao24) // 2 AS mid FROM messages)"""


@register(
    "teleport_attack",
    f"""{NUMBERED} SELECT ingest_seq, icao24, {R('CASE WHEN i >= mid THEN latitude + 100 / 60.0::DOUBLE ELSE latitude END', 6)} AS latitude,
    CASE WHEN i = mid THEN 'teleport' ELSE 'legitimate' END AS label, 'teleportation' AS attack_type FROM m""",
)
def teleport_attack(spark, sf):
    d = augment.teleport(messages(spark, sf), 100, chunk_seconds=2 * 86400)
    return d.select("ingest_seq", "icao24", r("latitude", 6).alias("latitude"), "label", "attack_type")


@register(
    "velocity_attack",
    f"""{NUMBERED} SELECT ingest_seq, icao24, CASE WHEN i >= mid AND i < mid + 5 THEN 1500 ELSE velocity END AS velocity,
    CASE WHEN i >= mid AND i < mid + 5 THEN 'impossible_velocity' ELSE 'legitimate' END AS label FROM m""",
)
def velocity_attack(spark, sf):
    d = augment.impossible_velocity(messages(spark, sf), chunk_seconds=2 * 86400)
    return d.select("ingest_seq", "icao24", "velocity", "label")


@register(
    "labelled_attacks",
    f"""{M}, n AS (SELECT count(DISTINCT icao24) AS tracks FROM messages)
    SELECT (SELECT count(*) FROM messages) AS legitimate, (SELECT tracks // 10 FROM n) AS attacked, 0 AS unlabelled""",
)
def labelled_attacks(spark, sf):
    """The hash-drawn dataset in figures both engines can state; details are tested on fixtures."""
    d = augment.labelled_dataset(messages(spark, sf), 0.1, chunk_seconds=2 * 86400)
    track = F.coalesce(F.col("attack_type"), F.lit("?"))
    return d.agg(
        F.count_if(track == "none").alias("legitimate"),
        F.countDistinct(F.when(track != "none", F.col("icao24"))).alias("attacked"),
        F.count_if(F.col("label").isNull() | F.col("attack_type").isNull()).cast("int").alias("unlabelled"),
    )
