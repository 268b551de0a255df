"""Detector evaluation from tables of (label, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.operators import ordered


def scored(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rows that can be judged: a label and a score that is a number. All metrics leave out the others alike."""
    return df.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


OPERATING_POINTS = (0.3, 0.5, 0.7, 0.9)  # fixed values


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row per distinct score, highest first: cumulative true and false positives."""
    points = scored(df, label, score).groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    return ordered.prefix_sums(points, "threshold", ["pos", "neg"], descending=True).select(
        "threshold", "pos", "neg", F.col("cum_pos").cast("long").alias("tp"), F.col("cum_neg").cast("long").alias("fp")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def evaluate_detector(
    df: DataFrame,
    label: str = "label",
    score: str = "score",
    target_far: float = 0.01,
    detection_time: str | None = None,
) -> DataFrame:
    """One row of metrics for a scored, labelled table.

    The threshold is the score whose false alarm rate is nearest the target;
    on a tie the higher one, "alarm never" (threshold infinity) included. Every
    distinct score is a candidate. ``auc_roc`` is null for a single class.
    """
    df = scored(df, label, score)
    curve = roc_curve(df, label, score)
    last = lambda c: F.coalesce(F.max(c), F.lit(0))
    totals = curve.agg(F.struct(last("tp").alias("p"), last("fp").alias("n"))).scalar()
    c = curve.withColumn("_t", totals)
    negatives = F.col("_t.n")
    gap = F.abs(F.try_divide(F.col("fp"), negatives) - target_far)
    best = F.min_by(F.struct("threshold", "tp", "fp"), F.struct(F.coalesce(gap, F.lit(float("inf"))), -F.col("threshold")))
    ops = []
    for i, at in enumerate(OPERATING_POINTS):
        above = F.col("threshold") >= at
        ops += [
            F.coalesce(F.sum(F.when(above, F.col("pos"))), F.lit(0)).alias(f"_tp{i}"),
            F.coalesce(F.sum(F.when(above, F.col("neg"))), F.lit(0)).alias(f"_fp{i}"),
        ]
    d = c.agg(
        F.max("_t.p").alias("_p"),
        F.max("_t.n").alias("_n"),
        # area by trapezoids: ties between classes count half
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("_area"),
        best.alias("_best"),
        F.min(gap).alias("_gap"),
        F.max_by(F.struct("tp", "fp"), -F.col("threshold")).alias("_lowest"),
        *ops,
    )
    p, n = F.col("_p"), F.col("_n")
    never = F.coalesce(F.col("_gap") >= target_far, F.lit(True))  # distance of the "alarm never" point
    d = d.select(
        "*",
        F.when(never, F.lit(float("inf"))).otherwise(F.col("_best.threshold")).alias("threshold_at_target_far"),
        F.when(never, 0).otherwise(F.col("_best.tp")).alias("true_positives"),
        F.when(never, 0).otherwise(F.col("_best.fp")).alias("false_positives"),
        # precision and recall are read at the nearest real score, which for an
        # infinite threshold is the first one, the lowest
        F.when(never, F.col("_lowest.tp")).otherwise(F.col("_best.tp")).alias("_ptp"),
        F.when(never, F.col("_lowest.fp")).otherwise(F.col("_best.fp")).alias("_pfp"),
    )
    tp, fp = F.col("true_positives"), F.col("false_positives")
    fn, tn = p - tp, n - fp
    out = d.select(
        F.when((p > 0) & (n > 0), F.col("_area") / (p * n)).alias("auc_roc"),
        "threshold_at_target_far",
        _ratio(fp, n).alias("actual_far_at_threshold"),
        _ratio(tp, p).alias("tpr_at_target_far"),
        _ratio(F.col("_ptp"), F.col("_ptp") + F.col("_pfp")).alias("precision_at_target_far"),
        _ratio(F.col("_ptp"), p).alias("recall_at_target_far"),
        tp.alias("true_positives"),
        tn.alias("true_negatives"),
        fp.alias("false_positives"),
        fn.alias("false_negatives"),
        _ratio(tp + tn, p + n).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, p).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        _ratio(tn, n).alias("specificity"),
        F.array(
            *[
                F.struct(
                    F.lit(at).alias("threshold"),
                    _ratio(F.col(f"_tp{i}"), F.col(f"_tp{i}") + F.col(f"_fp{i}")).alias("precision"),
                    _ratio(F.col(f"_tp{i}"), p).alias("recall"),
                    _ratio(2 * F.col(f"_tp{i}"), F.col(f"_tp{i}") + F.col(f"_fp{i}") + p).alias("f1"),
                )
                for i, at in enumerate(OPERATING_POINTS)
            ]
        ).alias("operating_points"),
    )
    if detection_time is None:
        return out
    threshold = out.select("threshold_at_target_far").scalar()
    detected = df.filter((F.col(label) == 1) & (F.col(score) >= threshold))
    times = time_to_detect(detected, detection_time)
    return out.select("*", times.select(F.struct("*")).scalar().alias("_ttd")).select("*", "_ttd.*").drop("_ttd")


def time_to_detect(detected: DataFrame, column: str) -> DataFrame:
    """Mean, median, 95th percentile and range of detection times; nulls without any."""
    basic = detected.agg(
        F.avg(column).alias("mean_time_to_detect"),
        F.min(column).alias("min_time_to_detect"),
        F.max(column).alias("max_time_to_detect"),
    )
    q = ordered.exact_quantiles(detected, column, {"median_time_to_detect": 0.5, "p95_time_to_detect": 0.95})
    return basic.select("*", q.select(F.struct("*")).scalar().alias("_q")).select("*", "_q.*").drop("_q")


def confusion(df: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """Confusion counts and rates at a fixed threshold."""
    hit, real = F.col(score) >= threshold, F.col(label) == 1
    d = scored(df, label, score).agg(
        F.count_if(hit & real).alias("tp"),
        F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"),
        F.count_if(~hit & ~real).alias("tn"),
    )
    return with_rates(d)


def with_rates(d: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return d.select(
        "*",
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tn, tn + fp).alias("specificity"),
    )


def classifier_metrics(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Counts and rates of a 0/1 classifier."""
    return confusion(df, 1, label, prediction)


def operating_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Precision, recall and F1 at the standard thresholds, one row each, in one pass."""
    real = F.col(label) == 1
    sums = []
    for i, at in enumerate(OPERATING_POINTS):
        hit = F.col(score) >= at
        sums += [F.count_if(hit & real).alias(f"tp{i}"), F.count_if(hit & ~real).alias(f"fp{i}")]
    d = df.agg(F.count_if(real).alias("p"), *sums)
    rows = F.array(
        *[
            F.struct(F.lit(at).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
            for i, at in enumerate(OPERATING_POINTS)
        ]
    )
    d = d.select("p", F.explode(rows).alias("r")).select("p", "r.*")
    return d.select(
        "threshold",
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("p")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")).alias("f1"),
    )


def by_attack_type(df: DataFrame, kind: str = "attack_type", score: str = "score") -> DataFrame:
    """Detection rates and score statistics per attack type."""
    s = F.col(score)
    rate = lambda at: F.avg((s >= at).cast("double")).alias(f"detection_rate_{at}".replace(".", "_"))
    return (
        df.filter(~F.col(kind).isin("none", "legitimate"))
        .groupBy(kind)
        .agg(
            F.count("*").alias("count"),
            rate(0.3),
            rate(0.5),
            rate(0.7),
            F.avg(s).alias("mean_score"),
            F.stddev_pop(s).alias("std_score"),
            F.min(s).alias("min_score"),
            F.max(s).alias("max_score"),
        )
    )


def rolling_alarm_rate(
    df: DataFrame,
    threshold: float,
    keys: list[str],
    time: str = "time",
    window: int = 100,
    score: str = "score",
    tie: list[str] | None = None,
    chunk_seconds: float = 3600,
) -> DataFrame:
    """Share of alarms among the last ``window`` rows per key, for full windows.

    A key with fewer rows yields one row with its overall share.
    """
    d = df.select(*keys, time, *(tie or []), score)
    rolled = ordered.row_frame_means(
        d, keys, time, {"alarm_rate": f"if({score} >= {threshold}, 1, 0)"}, window, True, tie, chunk_seconds
    )
    full = rolled.filter(F.col("frame_n") == window).select(*keys, time, "alarm_rate")
    short = (
        d.groupBy(*keys)
        .agg(
            F.max(time).alias(time),
            F.avg((F.col(score) >= threshold).cast("double")).alias("alarm_rate"),
            F.count("*").alias("_n"),
        )
        .filter(F.col("_n") < window)
        .drop("_n")
    )
    return full.unionByName(short)


def report(metrics: DataFrame) -> DataFrame:
    """Metrics in long form (metric, value)."""
    names = [c for c, kind in metrics.dtypes if kind in ("double", "bigint", "int", "float")]
    pairs = ", ".join(f"'{c}', double({c})" for c in names)
    return metrics.selectExpr(f"stack({len(names)}, {pairs}) AS (metric, value)")


def compare_detectors(df: DataFrame, thresholds: dict[str, float], label: str = "label") -> DataFrame:
    """AUC, precision, recall and F1 of several score columns, each at its own threshold.

    Scores are unpivoted and counted per detector and value in one pass over
    the table; all curves come from one sort of these counts.
    """
    each = F.array(*[F.struct(F.lit(n).alias("detector"), F.lit(float(at)).alias("at"), F.col(n).cast("double").alias("score")) for n, at in thresholds.items()])
    long = df.select(F.col(label).alias("label"), F.explode(each).alias("d")).select("label", "d.*")
    points = scored(long, "label", "score").groupBy("detector", "at", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    curve = ordered.prefix_sums(points, "score", ["pos", "neg"], descending=True, keys=["detector"])
    hit = F.col("score") >= F.col("at")
    none = F.lit(0).cast("long")
    found = curve.groupBy("detector").agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        # area by trapezoids: ties between classes count half
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)).alias("area"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
    )
    names = df.sparkSession.createDataFrame([(n,) for n in thresholds], "detector string")
    d = names.join(found, "detector", "left").withColumns({c: F.coalesce(c, none) for c in ("p", "n", "tp", "fp")})
    p, n, tp, fp = (F.col(c) for c in ("p", "n", "tp", "fp"))
    return d.select(
        "detector",
        F.when((p > 0) & (n > 0), F.col("area") / (p * n)).alias("auc_roc"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, p).alias("recall"),
        _ratio(2 * tp, tp + fp + p).alias("f1_score"),
    )
