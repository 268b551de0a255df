"""Ordered operators that stay parallel when one key holds much of the table.

A plain ``Window.partitionBy(key).orderBy(time)`` sends a whole key to one
task. Here a key's history is cut into time chunks (or row panes); only tiny
per-chunk summaries are ordered per key, and their carry is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.session import materialize

HOUR = 3600


def chunk_start(micros: Column, seconds: float) -> Column:
    """Start, in epoch microseconds, of the chunk of the given length."""
    return micros - F.pmod(micros, F.lit(int(seconds * 1_000_000)))


def computed_once(df: DataFrame, kept: list[str], columns: dict[str, str]) -> DataFrame:
    """``df`` with ``columns`` (name -> SQL) computed once per row by a generator of one row.

    Optimizer rules copy an aliased expression into every filter and column
    that uses it. For large expressions used many times over this is costly in
    planning and running; a generator's output is not copied.
    """
    body = ", ".join(f"'{name}', {value}" for name, value in columns.items())
    return df.selectExpr(*kept, f"inline(array(named_struct({body})))")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the last row per key. Rows are reduced before the shuffle, so hot keys are cheap."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    return best.select(*[c if c in keys else F.col(f"_last.`{c}`").alias(c) for c in df.columns])


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key in the given order (limited before the shuffle by Spark)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def row_index(
    df: DataFrame,
    keys: list[str],
    time: str,
    tie: list[str] | None = None,
    chunk_seconds: float = HOUR,
    index: str = "row_index",
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row in its key's time order, optionally with the key's row count."""
    d = df.withColumn("_c", chunk_start(F.unix_micros(time), chunk_seconds))
    w = Window.partitionBy(*keys, "_c").orderBy(time, *(tie or []))
    per_key = Window.partitionBy(*keys)
    counts = d.groupBy(*keys, "_c").agg(F.count("*").alias("_n"))
    before = per_key.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *keys,
        "_c",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(per_key).alias(total)] if total else []),
    )
    out = d.withColumn("_local", F.row_number().over(w)).join(counts, [*keys, "_c"])
    return out.withColumn(index, F.col("_local") + F.col("_before")).drop("_local", "_before", "_c")


def segments(
    df: DataFrame,
    keys: list[str],
    time: str,
    max_gap: float,
    chunk_seconds: float = 6 * HOUR,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ``segment_start`` (timestamp): a new segment begins after a gap above ``max_gap`` seconds.

    ``carry`` adds columns holding the last non-null value of an expression
    since the segment began, the current row included.
    """
    carry = carry or {}
    gap = int(max_gap * 1_000_000)
    d = df.withColumn("_t", F.unix_micros(time))
    d = d.withColumn("_c", chunk_start(F.col("_t"), chunk_seconds))
    for name, value in carry.items():
        d = d.withColumn(f"_v_{name}", F.when(value.isNotNull(), F.struct(F.col("_t").alias("t"), value.alias("v"))))
    in_chunk = Window.partitionBy(*keys, "_c").orderBy("_t")
    so_far = in_chunk.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_break", F.when(F.col("_t") - F.lag("_t").over(in_chunk) > gap, F.col("_t")))

    per_key = Window.partitionBy(*keys).orderBy("_c")
    before = per_key.rowsBetween(Window.unboundedPreceding, -1)
    summary = d.groupBy(*keys, "_c").agg(
        F.min("_t").alias("_lo"),
        F.max("_t").alias("_hi"),
        F.max("_break").alias("_brk"),
        *[F.max(f"_v_{name}").alias(f"_s_{name}") for name in carry],
    )
    previous = F.lag("_hi").over(per_key)
    summary = summary.withColumn(
        "_opens", F.when(previous.isNull() | (F.col("_lo") - previous > gap), F.col("_lo"))
    )
    summary = summary.select(
        *keys,
        "_c",
        F.coalesce(
            "_opens", F.last(F.coalesce("_brk", "_opens"), ignorenulls=True).over(before)
        ).alias("_first"),
        *[F.last(f"_s_{name}", ignorenulls=True).over(before).alias(f"_in_{name}") for name in carry],
    )
    local = d.withColumn("_seg", F.last("_break", ignorenulls=True).over(so_far))
    for name in carry:
        local = local.withColumn(f"_v_{name}", F.last(f"_v_{name}", ignorenulls=True).over(so_far))
    out = local.join(summary, [*keys, "_c"]).withColumn("_seg", F.coalesce("_seg", "_first"))
    for name in carry:
        held = F.coalesce(f"_v_{name}", f"_in_{name}")
        out = out.withColumn(name, F.when(held["t"] >= F.col("_seg"), held["v"]))
    extra = [f"_v_{name}" for name in carry] + [f"_in_{name}" for name in carry]
    return out.withColumn("segment_start", F.timestamp_micros("_seg")).drop(
        "_t", "_c", "_break", "_first", "_seg", *extra
    )


def prefix_sums(df: DataFrame, order: str, columns: list[str], descending: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Running totals in the order of one numeric column, distinct per key; over the whole table without ``keys``.

    One range sort deals the table out in order, as many ranges as the session
    has shuffle partitions, and is written once. Each range is summed on its own and offset by the
    totals of the key's ranges before it. No task sees the whole table or a
    whole key; the driver sees none of it. Adds ``cum_<column>``.
    """
    keys = list(keys or [])
    key = -F.col(order) if descending else F.col(order)
    d = df.withColumn("_k", key.cast("double")).repartitionByRange(*keys, "_k").withColumn("_b", F.spark_partition_id())
    d = materialize(df.sparkSession, d, "ranges")
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_b").agg(*[F.sum(F.col(c).cast("double")).alias(f"_s_{c}") for c in columns])
    # a row per key and range: the key's ranges only are ordered
    before = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0.0)).alias(f"_s_{c}") for c in columns])
    w = Window.partitionBy(*keys, "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(before, [*keys, "_b"])
    d = d.withColumns({f"cum_{c}": F.sum(F.col(c).cast("double")).over(w) + F.col(f"_s_{c}") for c in columns})
    return d.drop("_k", "_b", *[f"_s_{c}" for c in columns])


def row_frame_means(
    df: DataFrame,
    keys: list[str],
    time: str,
    values: dict[str, str],
    rows: int,
    include_current: bool,
    tie: list[str] | None = None,
    chunk_seconds: float = HOUR,
) -> DataFrame:
    """Mean of the last ``rows`` rows per key, with or without the current one, plus their count.

    ``values`` maps output names to SQL expressions. Rows are numbered per key
    and cut into panes of ``rows`` rows. A frame then always is a tail of the
    previous pane plus a head of the current one, so each row goes to its own
    pane and, as context, to the next; both parts are running sums. Adds
    ``frame_n`` and one mean per entry of ``values``.
    """
    d = row_index(df, keys, time, tie, chunk_seconds, index="_i")
    d = d.selectExpr(
        *df.columns,
        "_i",
        *[f"double({value}) AS _x_{name}" for name, value in values.items()],
        f"pmod(_i - 1, {rows}) AS _pos",
        "explode(array(true, false)) AS _own",
    )
    d = d.selectExpr("*", f"(_i - 1) div {rows} + if(_own, 0, 1) AS _pane")
    by_pane = "PARTITION BY " + ", ".join([*keys, "_pane"])
    upto = "CURRENT ROW" if include_current else "1 PRECEDING"
    # context rows still inside the frame: later in their pane than the current row is in its
    # own, or equally late when the current row itself is left out
    after = "1 PRECEDING" if include_current else "CURRENT ROW"
    head = f"({by_pane} ORDER BY _pos RANGE BETWEEN UNBOUNDED PRECEDING AND {upto})"
    tail = f"({by_pane} ORDER BY _pos DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {after})"

    def both(function: str, value: str) -> str:
        return (
            f"coalesce({function}(if(_own, {value}, null)) OVER {head}, 0)"
            f" + coalesce({function}(if(_own, null, {value})) OVER {tail}, 0)"
        )

    d = d.selectExpr(
        *df.columns,
        "_own",
        f"{both('count', '1')} AS frame_n",
        *[f"{both('sum', f'_x_{name}')} AS _s_{name}" for name in values],
    ).filter("_own")
    kept = [c for c in df.columns if c not in values]
    means = [f"if(frame_n > 0, _s_{name} / frame_n, null) AS {name}" for name in values]
    return d.selectExpr(*kept, "frame_n", *means)


def exact_quantiles(df: DataFrame, column: str, quantiles: dict[str, float]) -> DataFrame:
    """One row of linearly interpolated quantiles, from value counts and running totals.

    Unlike an aggregate that keeps every value, no task holds the whole column.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_v")).agg(
        F.count("*").alias("_n")
    )
    ranked = prefix_sums(counts, "_v", ["_n"])
    total = ranked.agg(F.coalesce(F.max("cum__n"), F.lit(0))).scalar()
    aggs = []
    for i, q in enumerate(quantiles.values()):
        place = F.lit(q) * (F.col("_total") - 1)
        aggs += [
            F.min(F.when(F.col("cum__n") > F.floor(place), F.col("_v"))).alias(f"_lo{i}"),
            F.min(F.when(F.col("cum__n") > F.ceil(place), F.col("_v"))).alias(f"_hi{i}"),
            F.first(place - F.floor(place)).alias(f"_f{i}"),
        ]
    d = ranked.withColumn("_total", total).agg(*aggs)
    return d.select(
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(name)
            for i, name in enumerate(quantiles)
        ]
    )
