"""Radio fingerprints: burst features, history consistency, spoof classifier."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.functions import vectors
from contrail.operators import ordered
from contrail.schemas import PHY_METRICS

_RESULT = T.StructType([T.StructField(name, T.DoubleType()) for name in PHY_METRICS])
PAD = 1e-10  # fixed value


def _spectrum(z: np.ndarray, rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Averaged periodograms (Hann window, half overlap, mean removed) of equally long rows."""
    n = z.shape[1]
    size = min(256, n)
    step = size - size // 2
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, n - size + 1, step)
    power = np.zeros((len(z), size))
    for s in starts:
        part = z[:, s : s + size]
        part = (part - part.mean(axis=1, keepdims=True)) * taper
        power += np.abs(np.fft.fft(part, axis=1)) ** 2
    power /= len(starts) * rate[:, None] * np.sum(taper**2)
    return np.fft.fftfreq(size)[None, :] * rate[:, None], power


def _burst_features(z: np.ndarray, rate: np.ndarray) -> dict[str, np.ndarray]:
    """All metrics of a batch of bursts of one length; rows are bursts."""
    rows, n = z.shape
    zero = np.zeros(rows)
    amp = np.abs(z)
    phase = np.unwrap(np.angle(z), axis=1)
    turn = np.diff(phase, axis=1)
    freq = turn * (rate / (2 * np.pi))[:, None] if n > 1 else np.zeros((rows, 1))
    out = {
        "cfo_mean": freq.mean(axis=1),
        "cfo_std": freq.std(axis=1),
        "cfo_drift": freq[:, -1] - freq[:, 0],
        "amp_mean": amp.mean(axis=1),
        "amp_std": amp.std(axis=1),
        "phase_std": phase.std(axis=1),
        "phase_jitter": turn.std(axis=1) if n > 1 else zero,
    }
    centred = amp - out["amp_mean"][:, None]
    m2 = (centred**2).mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out["amp_skew"] = (centred**3).mean(axis=1) / m2**1.5
        out["amp_kurtosis"] = (centred**4).mean(axis=1) / m2**2 - 3
    if n > 2:
        t = np.arange(n) - (n - 1) / 2
        slope = (phase * t).sum(axis=1) / (t**2).sum()
        residual = phase - phase.mean(axis=1, keepdims=True) - slope[:, None] * t
        out["phase_linearity"] = 1 - residual.std(axis=1) / (out["phase_std"] + PAD)
    else:
        out["phase_linearity"] = zero + 1
    out.update(_preamble(amp, rate))
    if n > 10:
        f, power = _spectrum(z, rate)
        total = power.sum(axis=1)
        some = total > 0
        share = power / np.where(some, total, 1)[:, None]
        centre = (f * share).sum(axis=1)
        spread = np.sqrt(((f - centre[:, None]) ** 2 * share).sum(axis=1))
        flat = np.exp(np.log(power + PAD).mean(axis=1)) / (power.mean(axis=1) + PAD)
        out["spectral_centroid"] = np.where(some, centre, 0)
        out["spectral_spread"] = np.where(some, spread, 0)
        out["spectral_flatness"] = np.where(some, flat, 0)
    else:
        out.update(spectral_centroid=zero, spectral_spread=zero, spectral_flatness=zero)
    edge = max(1, n // 20)
    noise = ((amp[:, :edge] ** 2).mean(axis=1) + (amp[:, -edge:] ** 2).mean(axis=1)) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        snr = 10 * np.log10((amp**2).mean(axis=1) / noise)
    out["snr_estimate"] = np.where(noise > 0, snr, 30.0)
    return out


def _preamble(amp: np.ndarray, rate: np.ndarray) -> dict[str, np.ndarray]:
    """Rise time (µs), overshoot (%) and ringing of the first 8 µs."""
    rows = len(amp)
    rise, over, ring = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    for value in np.unique(rate):
        pick = rate == value
        head = amp[pick, : int(8 * (value / 1e6))]
        m = head.shape[1]
        if m >= 2:
            top = head.max(axis=1)
            scaled = head / np.where(top == 0, 1, top)[:, None]
            low, high = (scaled >= 0.1).argmax(axis=1), (scaled >= 0.9).argmax(axis=1)
            rise[pick] = np.where(top == 0, 0, (high - low) / value * 1e6)
        if m >= 10:
            cut = int(m * 0.8)
            steady = head[:, cut:].mean(axis=1)
            percent = (head[:, :cut].max(axis=1) - steady) / np.where(steady == 0, 1, steady) * 100
            over[pick] = np.where(steady == 0, 0, np.maximum(percent, 0))
        if m >= 20:
            peak = head[:, : m // 2].argmax(axis=1)
            signs = np.sign(np.diff(head, axis=1))
            changes = (np.diff(signs, axis=1) != 0) & (np.arange(m - 2)[None, :] >= peak[:, None])
            ring[pick] = np.where(m - peak < 10, 0, changes.sum(axis=1))
    return {"preamble_rise_time": rise, "preamble_overshoot": over, "preamble_ringing": ring}


@F.pandas_udf(_RESULT)
def _features_udf(i: pd.Series, q: pd.Series, rate: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame(np.nan, index=i.index, columns=list(PHY_METRICS))
    lengths = i.map(len).to_numpy()
    for length in np.unique(lengths):
        if length == 0:
            continue
        at = np.flatnonzero(lengths == length)
        z = np.stack(i.iloc[at].to_numpy()).astype(float) + 1j * np.stack(q.iloc[at].to_numpy()).astype(float)
        features = _burst_features(z, rate.iloc[at].to_numpy(dtype=float))
        out.iloc[at] = np.column_stack([features[name] for name in PHY_METRICS])
    return out


def burst_features(bursts: DataFrame) -> DataFrame:
    """Bursts (``i``, ``q``, ``sample_rate``) with their 17 metrics in place of the samples.

    Row-local, so it adds no shuffle; each Arrow batch is computed as one array.
    """
    kept = [c for c in bursts.columns if c not in ("i", "q")]
    d = bursts.select(*kept, _features_udf("i", "q", "sample_rate").alias("_f"))
    return d.select(*kept, "_f.*")


def with_vector(features: DataFrame) -> DataFrame:
    return features.withColumn("vector", vectors.feature_vector(list(PHY_METRICS)))


def fingerprint(
    history: DataFrame, dim: int, key: str = "icao24", time: str = "time", last: int = 100, at_least: int = 5
) -> DataFrame:
    """Mean of each aircraft's newest vectors, for those with enough of them."""
    newest = ordered.newest_per_key(history.select(key, time, "vector"), [key], [F.col(time).desc()], last)
    means = newest.groupBy(key).agg(
        F.count("*").alias("samples"), *[F.expr(f"avg(double(vector[{i}])) AS d{i}") for i in range(dim)]
    )
    return means.filter(F.col("samples") >= at_least).selectExpr(
        key, "samples", "array(" + ", ".join(f"d{i}" for i in range(dim)) + ") AS fingerprint"
    )


def history_consistency(
    history: DataFrame,
    dim: int,
    rows: int = 100,
    at_least: int = 5,
    include_current: bool = True,
    key: str = "icao24",
    time: str = "time",
    tie: list[str] | None = None,
    chunk_seconds: float = 3600,
) -> DataFrame:
    """Cosine of each vector with the mean of the aircraft's last ``rows`` vectors; 1 without history.

    Defaults are those of RF features, whose history already holds the current
    vector. For embeddings: ``rows=50, at_least=3, include_current=False``.
    """
    means = ordered.row_frame_means(
        history, [key], time, {f"_d{i}": f"vector[{i}]" for i in range(dim)}, rows, include_current, tie, chunk_seconds
    )
    d = means.selectExpr(
        *history.columns, "frame_n AS history_n", "array(" + ", ".join(f"_d{i}" for i in range(dim)) + ") AS _mean"
    )
    known = F.col("history_n") >= at_least
    consistency = F.when(known, vectors.cosine(F.col("vector"), F.col("_mean"))).otherwise(1.0)
    return d.withColumn("consistency", consistency).drop("_mean")


def train_classifier(
    df: DataFrame, vector: str = "vector", label: str = "label", hidden: tuple[int, ...] = (64, 64, 32),
    dim: int = 17, classes: int = 2, max_iter: int = 100, seed: int = 42,
):
    """Feed-forward spoof classifier on array features (distributed training)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler

    data = _as_ml(df, vector).withColumn("_label", F.col(label).cast("double"))
    scaler = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True)
    net = MultilayerPerceptronClassifier(
        layers=[dim, *hidden, classes], featuresCol="_scaled", labelCol="_label", maxIter=max_iter, seed=seed
    )
    return Pipeline(stages=[scaler, net]).fit(data)


def _as_ml(df: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_features", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))


def classify(model, df: DataFrame, vector: str = "vector") -> DataFrame:
    """Add ``spoof_probability`` (class 1) and the 0/1 ``prediction``."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_as_ml(df, vector))
    return out.select(
        *df.columns,
        vector_to_array("probability")[1].alias("spoof_probability"),
        F.col("prediction").cast("int").alias("prediction"),
    )
