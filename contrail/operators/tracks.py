"""Per-aircraft track features over sliding and tumbling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions import geo
from contrail.operators import ordered

KEY = ["icao24"]
FIELDS = ("latitude", "longitude", "altitude", "velocity", "heading", "vert_rate")

FEATURES = (
    "velocity_mean",
    "velocity_std",
    "velocity_min",
    "velocity_max",
    "velocity_max_delta",
    "max_acceleration",
    "altitude_mean",
    "altitude_std",
    "altitude_min",
    "altitude_max",
    "altitude_range",
    "max_climb_rate",
    "max_descent_rate",
    "climb_rate_std",
    "heading_std",
    "max_heading_delta",
    "max_turn_rate",
    "mean_turn_rate",
    "vertical_rate_mean",
    "vertical_rate_std",
    "vertical_rate_max",
    "max_implied_speed",
    "mean_implied_speed",
    "position_gap_count",
    "speed_consistency_error",
    "max_speed_discrepancy",
    "msg_rate",
    "msg_count",
    "track_duration",
    "msg_interval_mean",
    "msg_interval_std",
    "msg_interval_max",
    "total_distance",
    "max_jump",
)


def deduplicate(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per (icao24, time); the later arrival (``order`` columns) wins whole.

    The columns must tell arrivals apart; the key cannot. Of arrivals that tie the one with the greater row hash wins,
    so the result is the same however the rows are dealt out.
    """
    if not set(order) - {"icao24", "time"}:
        raise ValueError("an arrival column is needed to tell which of two equal messages came later")
    plain = [c for c, kind in df.dtypes if not kind.startswith("map")]
    hashed = df.withColumn("_hash", F.xxhash64(*plain))
    return ordered.latest_per_key(hashed, ["icao24", "time"], [*order, "_hash"]).drop("_hash")


def segment_tracks(df: DataFrame, max_gap: float = 60, chunk_seconds: float = 6 * 3600) -> DataFrame:
    """Add the track's ``segment_start`` and ``track_callsign``, the last callsign seen in it."""
    named = F.when(F.col("callsign") != "", F.col("callsign"))
    return ordered.segments(df, KEY, "time", max_gap, chunk_seconds, carry={"track_callsign": named})


# --- window statistics ---------------------------------------------------------
# Expressions are SQL text: one long select list is a single call into the JVM.
# A point is a struct (t, v, …) of one field's non-null row; a pair is two
# successive points of the same field.

_POINTS = {
    "dt": "named_struct('t', _t)",
    "vel": "if(velocity is not null, named_struct('t', _t, 'v', double(velocity)), null)",
    "alt": "if(altitude is not null, named_struct('t', _t, 'v', double(altitude)), null)",
    "hdg": "if(heading is not null, named_struct('t', _t, 'v', double(heading)), null)",
    "pos": (
        "if(latitude is not null and longitude is not null, named_struct('t', _t, 'lat', double(latitude),"
        " 'lon', double(longitude), 'speed', double(velocity)), null)"
    ),
}

# statistics needed per measure: of points, and of pairs by field
_POINT_STATS = {
    "velocity": ("moments", "min", "max"),
    "altitude": ("moments", "min", "max"),
    "heading": ("moments",),
    "vert_rate": ("moments",),
    "abs_vert_rate": ("max",),
    "positions": ("n",),
    "_t": ("n", "min"),
}
_PAIR_STATS = {
    "dt": {"dt": ("moments", "max")},
    "vel": {"dv": ("max",), "acc": ("max",)},
    "alt": {"climb": ("moments", "min", "max")},
    "hdg": {"dh": ("max",), "turn": ("moments", "max")},
    "pos": {"dist": ("sum", "max"), "implied": ("moments", "max"), "long_gap": ("sum",), "disc": ("moments", "max")},
}
_AGGREGATES = {"n": "count", "mean": "avg", "var": "var_pop", "sum": "sum", "min": "min", "max": "max"}


def _needed(stats: tuple[str, ...]) -> list[str]:
    return [x for stat in stats for x in (("n", "mean", "var") if stat == "moments" else (stat,))]


def _point_value(measure: str) -> str:
    special = {
        "positions": "if(latitude is not null and longitude is not null, 1, null)",
        "abs_vert_rate": "double(abs(vert_rate))",
        "_t": "_t",
    }
    return special.get(measure, f"double({measure})")


def _pair(field: str, a: str, b: str) -> str:
    """Basic measures of the pair from point ``a`` to the later point ``b``."""
    dt = f"if({b}.t > {a}.t, ({b}.t - {a}.t) / 1e6D, 0.1D)"
    turn = f"if(abs({b}.v - {a}.v) <= 180, abs({b}.v - {a}.v), 360 - abs({b}.v - {a}.v))" if field == "hdg" else ""
    if field == "pos":
        lat = f"pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2)"
        lon = f"pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2)"
        h = f"({lat} + cos(radians({a}.lat)) * cos(radians({b}.lat)) * {lon})"
        dist = f"asin(sqrt(if({h} > 1, 1D, {h}))) * {2 * geo.EARTH_RADIUS_NM}D"
    body = {
        "dt": "",
        "vel": f", 'dv', abs({b}.v - {a}.v)",
        "alt": f", 'da', {b}.v - {a}.v",
        "hdg": f", 'dh', {turn}",
        "pos": f", 'dist', {dist}, 'speed', {a}.speed" if field == "pos" else "",
    }[field]
    return f"if({a} is not null and {b} is not null, named_struct('dt', {dt}{body}), null)"


def _pair_value(measure: str, pair: str, long_gap: float) -> str:
    """One measure of a pair; null without a pair."""
    implied = f"{pair}.dist / {pair}.dt * 3600"
    return {
        "dt": f"{pair}.dt",
        "dv": f"{pair}.dv",
        "acc": f"{pair}.dv / {pair}.dt",
        "climb": f"{pair}.da / ({pair}.dt / 60)",
        "dh": f"{pair}.dh",
        "turn": f"{pair}.dh / {pair}.dt",
        "dist": f"{pair}.dist",
        "implied": implied,
        "long_gap": f"double({pair}.dt > {long_gap}D)",
        "disc": f"abs({pair}.speed - {implied})",
    }[measure]


def _merge(measure: str, stats: tuple[str, ...], x: str, y: str, out: str) -> list[str]:
    """Combine the statistics of two disjoint parts, named by their column prefixes."""
    a, b, o = (f"{prefix}{measure}_" for prefix in (x, y, out))
    n = f"({a}n + {b}n)"
    exprs = {
        "n": n,
        "mean": f"if({a}n = 0, {b}mean, if({b}n = 0, {a}mean, ({a}mean * {a}n + {b}mean * {b}n) / {n}))",
        # pooled squared deviations
        "var": (
            f"if({a}n = 0, {b}var, if({b}n = 0, {a}var, ({a}var * {a}n + {b}var * {b}n) / {n}"
            f" + pow({a}mean - {b}mean, 2) * ({a}n / {n}) * ({b}n / {n})))"
        ),
        "sum": f"coalesce({a}sum + {b}sum, {a}sum, {b}sum)",
        # least/greatest skip nulls, which is what an absent part needs here
        "min": f"least({a}min, {b}min)",
        "max": f"greatest({a}max, {b}max)",
    }
    return [f"{exprs[stat]} AS {o}{stat}" for stat in _needed(stats)]


def _single(measure: str, stats: tuple[str, ...], value: str, out: str) -> list[str]:
    """The statistics of one optional value."""
    exprs = {"n": f"if({value} is null, 0, 1)", "mean": value, "var": f"if({value} is null, null, 0D)"}
    return [f"{exprs.get(stat, value)} AS {out}{measure}_{stat}" for stat in _needed(stats)]


def _feature_exprs(prefix: str, end: str) -> dict[str, str]:
    """The feature set from statistics named ``<prefix><measure>_<stat>``.

    A feature is null when its inputs are missing; rates also need the field
    on every message of the window.
    """

    def s(measure: str, stat: str) -> str:
        return f"{prefix}{measure}_{stat}"

    rows = s("_t", "n")
    duration = f"(({end} - {s('_t', 'min')}) / 1e6D)"
    some = {m: f"{s(m, 'n')} >= 2" for m in ("velocity", "altitude", "heading", "vert_rate", "positions")}
    every = {m: f"{some[m]} and {s(m, 'n')} = {rows}" for m in some}
    table = {
        "velocity_mean": (some["velocity"], s("velocity", "mean")),
        "velocity_std": (some["velocity"], f"sqrt({s('velocity', 'var')})"),
        "velocity_min": (some["velocity"], s("velocity", "min")),
        "velocity_max": (some["velocity"], s("velocity", "max")),
        "velocity_max_delta": (some["velocity"], s("dv", "max")),
        "max_acceleration": (every["velocity"], s("acc", "max")),
        "altitude_mean": (some["altitude"], s("altitude", "mean")),
        "altitude_std": (some["altitude"], f"sqrt({s('altitude', 'var')})"),
        "altitude_min": (some["altitude"], s("altitude", "min")),
        "altitude_max": (some["altitude"], s("altitude", "max")),
        "altitude_range": (some["altitude"], f"{s('altitude', 'max')} - {s('altitude', 'min')}"),
        "max_climb_rate": (every["altitude"], s("climb", "max")),
        "max_descent_rate": (every["altitude"], s("climb", "min")),
        "climb_rate_std": (every["altitude"], f"sqrt({s('climb', 'var')})"),
        "heading_std": (some["heading"], f"sqrt({s('heading', 'var')})"),
        "max_heading_delta": (some["heading"], s("dh", "max")),
        "max_turn_rate": (every["heading"], s("turn", "max")),
        "mean_turn_rate": (every["heading"], s("turn", "mean")),
        "vertical_rate_mean": (some["vert_rate"], s("vert_rate", "mean")),
        "vertical_rate_std": (some["vert_rate"], f"sqrt({s('vert_rate', 'var')})"),
        "vertical_rate_max": (some["vert_rate"], s("abs_vert_rate", "max")),
        "max_implied_speed": (some["positions"], s("implied", "max")),
        "mean_implied_speed": (some["positions"], s("implied", "mean")),
        "position_gap_count": (some["positions"], f"bigint({s('long_gap', 'sum')})"),
        "speed_consistency_error": (f"{every['velocity']} and {every['positions']}", s("disc", "mean")),
        "max_speed_discrepancy": (f"{every['velocity']} and {every['positions']}", s("disc", "max")),
        "msg_rate": (f"{rows} >= 2 and {duration} > 0", f"{rows} / {duration}"),
        "msg_count": ("true", f"bigint({rows})"),
        "track_duration": (f"{rows} >= 2", duration),
        "msg_interval_mean": ("true", s("dt", "mean")),
        "msg_interval_std": ("true", f"sqrt({s('dt', 'var')})"),
        "msg_interval_max": ("true", s("dt", "max")),
        "total_distance": (some["positions"], s("dist", "sum")),
        "max_jump": (some["positions"], s("dist", "max")),
    }
    assert tuple(table) == FEATURES
    return {n: value if cond == "true" else f"if({cond}, {value}, null)" for n, (cond, value) in table.items()}


def sliding_features(
    df: DataFrame,
    window: float = 30,
    min_points: int = 3,
    keys: list[str] | None = None,
    position_gap: float = 30,
    carry: list[str] | None = None,
) -> DataFrame:
    """Features of the last ``window`` seconds, one row per message with enough points.

    ``df`` holds one row per (key, time). Its columns ``segment_start`` and
    ``track_callsign``, when present (see :func:`segment_tracks`), bound the
    window and name the track. ``carry`` names further columns of the
    message to keep.

    Time is cut into panes of one window length, so every window is a tail of
    the previous pane plus a head of the current one. Each row is sent to its
    own pane and, as context, to the next. Heads and tails are running
    aggregates, merged at the end: one shuffle, two sorts, linear work per
    row whatever the message rate, and no task larger than two windows of one
    aircraft. Pairs of successive points are counted when both ends lie in
    the window; the one pair that joins the panes is carried separately.
    """
    keys = keys or KEY
    part = [*keys, "segment_start"] if "segment_start" in df.columns else list(keys)
    width = int(window * 1_000_000)
    carried = [c for c in ("sensor_id", "track_callsign", *(carry or [])) if c in df.columns]
    base = [*part, "time", *carried]
    d = df.selectExpr(*base, *FIELDS, "unix_micros(time) AS _t", "explode(array(true, false)) AS _own")
    d = d.selectExpr(
        "*",
        f"_t - pmod(_t, {width}L) + if(_own, 0L, {width}L) AS _pane",
        f"pmod(_t, {width}L) AS _pos",
        *[f"{p} AS _p_{f}" for f, p in _POINTS.items()],
    )
    by_pane = "PARTITION BY " + ", ".join([*part, "_pane"])
    forwards, backwards = f"{by_pane} ORDER BY _t", f"{by_pane} ORDER BY _pos DESC"
    # context sorts behind own rows of the same position, so a context row's next point is found first
    later = f"({by_pane} ORDER BY _pos DESC, _own DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    # by value: a context row exactly one window old still counts
    tail = f"({backwards} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = f"({forwards} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    head = f"({forwards} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def running(side: str, only: str, pair: str, frame: str) -> list[str]:
        out = []
        for measure, stats in _POINT_STATS.items():
            for stat in _needed(stats):
                value = f"if({only}, {_point_value(measure)}, null)"
                out.append(f"{_AGGREGATES[stat]}({value}) OVER {frame} AS {side}{measure}_{stat}")
        for field, measures in _PAIR_STATS.items():
            for measure, stats in measures.items():
                value = _pair_value(measure, f"{pair}{field}", position_gap)
                for stat in _needed(stats):
                    out.append(f"{_AGGREGATES[stat]}({value}) OVER {frame} AS {side}{measure}_{stat}")
        return out

    # backwards through the pane: each context row's next point, then the tails
    d = d.selectExpr("*", *[f"last(if(_own, null, _p_{f}), true) OVER {later} AS _nx_{f}" for f in _POINTS])
    keep = [*base, *FIELDS, "_t", "_own", "_pane", "_pos", *[f"_p_{f}" for f in _POINTS]]
    d = d.selectExpr(*keep, *[f"if(_own, null, {_pair(f, f'_p_{f}', f'_nx_{f}')}) AS _ctx_{f}" for f in _POINTS])
    d = d.selectExpr(*keep, *running("_tail_", "not _own", "_ctx_", tail))
    tails = [c for c in d.columns if c.startswith("_tail_")]
    # forwards: each own row's previous point, then the heads
    d = d.selectExpr(
        "*",
        *[f"last(if(_own, _p_{f}, null), true) OVER {before} AS _po_{f}" for f in _POINTS],
        *[f"last(if(_own, null, _p_{f}), true) OVER {before} AS _pc_{f}" for f in _POINTS],
    )
    d = d.selectExpr(
        *keep,
        *tails,
        *[f"if(_own, {_pair(f, f'_po_{f}', f'_p_{f}')}, null) AS _fwd_{f}" for f in _POINTS],
        # the pair that joins the panes: last context point and first own point of the field
        *[
            f"if(_own and _po_{f} is null and _pc_{f} is not null and _p_{f} is not null,"
            f" named_struct('from', _pc_{f}.t, 'pair', {_pair(f, f'_pc_{f}', f'_p_{f}')}), null) AS _join_{f}"
            for f in _POINTS
        ],
    )
    d = d.selectExpr(
        *base,
        "_t",
        "_own",
        *tails,
        *running("_head_", "_own", "_fwd_", head),
        *[f"last(_join_{f}, true) OVER {head} AS _j_{f}" for f in _POINTS],
    ).filter("_own")
    # tail + head, then the joining pair if its first point is still in the window
    merged = [e for m, stats in _POINT_STATS.items() for e in _merge(m, stats, "_tail_", "_head_", "_all_")]
    pairs = [(f, m, stats) for f, measures in _PAIR_STATS.items() for m, stats in measures.items()]
    for _, m, stats in pairs:
        merged += _merge(m, stats, "_tail_", "_head_", "_two_")
    joins = [f"if(_j_{f}.from >= _t - {width}L, _j_{f}.pair, null) AS _jp_{f}" for f in _POINTS]
    d = d.selectExpr(*base, "_t", *merged, *joins)
    points = [c for c in d.columns if c.startswith("_all_")]
    halves = [c for c in d.columns if c.startswith("_two_")]
    single = [e for f, m, s in pairs for e in _single(m, s, _pair_value(m, f"_jp_{f}", position_gap), "_one_")]
    d = d.selectExpr(*base, "_t", *points, *halves, *single)
    d = d.selectExpr(
        *base, "_t", *points, *[e for _, m, stats in pairs for e in _merge(m, stats, "_two_", "_one_", "_all_")]
    )
    kept = [*base, "timestamp_micros(_all__t_min) AS window_start", "time AS window_end"]
    return ordered.computed_once(d.filter(F.col("_all__t_n") >= min_points), kept, _feature_exprs("_all_", "_t"))


def tumbling_features(
    df: DataFrame, bucket: float = 30, min_points: int = 3, keys: list[str] | None = None, position_gap: float = 30
) -> DataFrame:
    """The same features per key and fixed time bucket; one shuffle on (key, bucket)."""
    keys = keys or KEY
    group = [*keys, "_pane"]
    width = int(bucket * 1_000_000)
    d = df.selectExpr(*keys, *FIELDS, "unix_micros(time) AS _t")
    d = d.selectExpr("*", f"_t - pmod(_t, {width}L) AS _pane", *[f"{p} AS _p_{f}" for f, p in _POINTS.items()])
    before = (
        f"(PARTITION BY {', '.join(group)} ORDER BY _t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    d = d.selectExpr("*", *[f"last(_p_{f}, true) OVER {before} AS _po_{f}" for f in _POINTS])
    d = d.selectExpr(*group, *FIELDS, "_t", *[f"{_pair(f, f'_po_{f}', f'_p_{f}')} AS _pair_{f}" for f in _POINTS])
    aggs = ["max(_t) AS _end"]
    for measure, stats in _POINT_STATS.items():
        aggs += [f"{_AGGREGATES[x]}({_point_value(measure)}) AS _all_{measure}_{x}" for x in _needed(stats)]
    for field, measures in _PAIR_STATS.items():
        for measure, stats in measures.items():
            value = _pair_value(measure, f"_pair_{field}", position_gap)
            aggs += [f"{_AGGREGATES[x]}({value}) AS _all_{measure}_{x}" for x in _needed(stats)]
    d = d.groupBy(*group).agg(*[F.expr(a) for a in aggs])
    kept = [
        *keys,
        "timestamp_micros(_pane) AS bucket",
        "timestamp_micros(_all__t_min) AS window_start",
        "timestamp_micros(_end) AS window_end",
    ]
    return ordered.computed_once(d.filter(F.col("_all__t_n") >= min_points), kept, _feature_exprs("_all_", "_end"))


def current_features(
    df: DataFrame, as_of: Column, window: float = 30, max_gap: float = 60, min_points: int = 3
) -> DataFrame:
    """Latest features of every aircraft heard within ``max_gap`` seconds before ``as_of``.

    Only messages that can matter are read: the time filter reaches the scan.
    """
    reach = F.make_dt_interval(secs=F.lit(float(window + max_gap)))
    recent = df.filter((F.col("time") >= as_of - reach) & (F.col("time") <= as_of))
    features = sliding_features(recent, window, 1)
    latest = ordered.latest_per_key(features, KEY, ["window_end"])
    fresh = F.col("window_end") >= as_of - F.make_dt_interval(secs=F.lit(float(max_gap)))
    return latest.filter(fresh & (F.col("msg_count") >= min_points))


def track_windows(df: DataFrame, seconds: int = 30) -> DataFrame:
    """Fixed-window aggregates per aircraft and sensor over positioned messages.

    Works on batch and streaming input; a stream needs a watermark on ``time``.
    """
    return (
        df.filter(F.col("latitude").isNotNull())
        .groupBy(F.window("time", f"{seconds} seconds").alias("w"), "icao24", "sensor_id")
        .agg(
            F.avg("velocity").alias("avg_velocity"),
            F.stddev_samp("velocity").alias("std_velocity"),
            F.min("velocity").alias("min_velocity"),
            F.max("velocity").alias("max_velocity"),
            F.avg("altitude").alias("avg_altitude"),
            F.stddev_samp("altitude").alias("std_altitude"),
            F.min("altitude").alias("min_altitude"),
            F.max("altitude").alias("max_altitude"),
            F.avg("heading").alias("avg_heading"),
            F.avg("vert_rate").alias("avg_vert_rate"),
            F.max(F.abs("vert_rate")).alias("max_vert_rate"),
            F.count("*").alias("msg_count"),
            F.max("callsign").alias("callsign"),
            F.max("squawk").alias("squawk"),
        )
        .select(F.col("w.start").alias("bucket"), "*")
        .drop("w")
    )
