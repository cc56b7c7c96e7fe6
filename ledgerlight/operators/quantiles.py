"""Exact, linearly interpolated quantiles that stay distributed.

``percentile`` in Spark is exact but keeps a map of every distinct value of a
group in one task, so a hot group (a third of all rows) would not fit.  This
operator gets the same exact answer in three distributed steps, the same for
groups of every size:

1. ``percentile_approx`` per group (a mergeable sketch, partial-aggregated on
   the map side, bounded memory) gives cuts around each target rank: ``PARTS``
   narrow ranges next to it, and a few ranges that widen to either side.
2. One pass counts the values of each range.  Running sums over the ranges, of
   which a group has few, tell those that hold the ranks ``floor(q(n-1))`` and
   the next one, and how many values lie below.
3. One pass takes the values between the ends of these ranges.  Ties collapse
   into one row with a count, so a value repeated a billion times is one row.
   The values at both ranks are interpolated exactly as pandas /
   ``percentile`` / DuckDB ``quantile_cont`` do.

The counts decide, not the sketch: merged sketches can be wrong by more than
their stated error, and by more or less from run to run.  Wrong cuts only make
the range that is ranked larger.  A range carries its ends, so that steps 2 and
3 agree even if the sketch is made again in between.

Where most groups are small, as products are, a sketch is larger than what it
sums up.  With ``sort_small`` the values of groups of up to ``SMALL_GROUP`` of
them are sorted in one array a group, and only larger groups take the steps
above; the interpolation is the same.

With ``staged`` the cuts and the ranges are tables of their own, written first;
the planner then knows how small they are and brings them to the values, which
otherwise are dealt by their group, a task for each group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 100_000
#: Narrow ranges next to a target rank.
PARTS = 32
#: Ends of the ranges to either side, in widths of the narrow ones together.
WIDER = (8, 64, 512)
#: Values of a group that are sorted as one array.
SMALL_GROUP = 10_000


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row of ``df``.

    The right side is a global aggregate (exactly one row), broadcast, so this
    is a map-side projection, not a pairing of two relations.
    """
    return df.crossJoin(F.broadcast(one_row))


def exact_quantiles(df: DataFrame, value_col: str, probs: Mapping[str, float],
                    group_cols: Sequence[str] = (), accuracy: int = DEFAULT_ACCURACY,
                    staged: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> DataFrame:
    """One row per group (one row overall when ``group_cols`` is empty) with a
    column per entry of ``probs``.  Nulls are ignored; empty groups give no row.
    """
    return _quantiles(df, value_col, probs, group_cols, accuracy, staged=staged)


def multi_quantiles(df: DataFrame, spec: Mapping[str, tuple[str, float]],
                    group_cols: Sequence[str] = (), accuracy: int = DEFAULT_ACCURACY,
                    sort_small: bool = False) -> DataFrame:
    """Like ``exact_quantiles`` for several value columns at once:
    ``spec`` maps an output name to ``(value column, probability)``.  The
    columns are unpivoted into one value column keyed by measure, so the
    input is scanned the same number of times whatever the number of
    measures."""
    measures = sorted({c for c, _ in spec.values()})
    if len(measures) > 1:
        m_ids = {c: i for i, c in enumerate(measures)}
        long = df.select(*group_cols, F.explode(F.array(*[
            F.struct(F.lit(i).alias("_m"), F.col(c).cast("double").alias("_mv"))
            for c, i in m_ids.items()])).alias("_e")).select(*group_cols, "_e._m", "_e._mv")
        parts = []
        for c, i in m_ids.items():
            names = {n: q for n, (col, q) in spec.items() if col == c}
            parts.append((i, names))
        # one quantile pass over (group, measure); probabilities differ per
        # measure, so ask for the union and keep each measure's own
        allq = {f"_q{j}": q for j, q in enumerate(sorted({q for _, q in spec.values()}))}
        res = _quantiles(long, "_mv", allq, list(group_cols) + ["_m"], accuracy, sort_small)
        qname = {q: n for n, q in allq.items()}
        return res.groupBy(*group_cols).agg(*[
            F.max(F.when(F.col("_m") == m_ids[col], F.col(qname[q]))).alias(n)
            for n, (col, q) in spec.items()])
    col = measures[0]
    return _quantiles(df, col, {n: q for n, (_, q) in spec.items()}, group_cols, accuracy, sort_small)


def _quantiles(df: DataFrame, value_col: str, probs: Mapping[str, float],
               group_cols: Sequence[str] = (), accuracy: int = DEFAULT_ACCURACY, sort_small: bool = False,
               staged: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None) -> DataFrame:
    out_cols = list(group_cols)
    is_global = not out_cols
    # A global quantile uses a constant group; every frame joined on it then
    # has a proven size (one row per probability) and is broadcast.
    group_cols = out_cols or ["_g"]
    names = list(probs)
    qs = [float(probs[n]) for n in names]
    v = F.col(value_col).cast("double")
    src = df.withColumn("_g", F.lit(0)) if is_global else df
    vals = src.select(*group_cols, v.alias("_v")).where(F.col("_v").isNotNull())

    if sort_small and not is_global:
        both = _by_size(vals, group_cols, qs, accuracy)
    else:
        both = _bracketed(vals, group_cols, qs, accuracy, is_global, staged)
    out = both.groupBy(*group_cols).agg(*[
        F.max(F.when(F.col("_pid") == i, F.col("_val"))).alias(name)
        for i, name in enumerate(names)
    ])
    return out.drop("_g") if is_global else out


def _by_size(vals: DataFrame, group_cols, qs, accuracy) -> DataFrame:
    """Small groups sorted, large ones ranked in their ranges.

    There are at most as many large groups as values divided by ``SMALL_GROUP``."""
    large = F.broadcast(vals.groupBy(*group_cols).agg(F.count("_v").alias("_size"))
                        .where(F.col("_size") > SMALL_GROUP).drop("_size"))
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"l.{c}")) for c in group_cols]
    few, many = (vals.alias("v").join(large.alias("l"), same, how) for how in ("left_anti", "left_semi"))
    return _sorted(few, group_cols, qs).unionByName(_bracketed(many, group_cols, qs, accuracy, False))


def _sorted(vals: DataFrame, group_cols, qs) -> DataFrame:
    arrays = vals.groupBy(*group_cols).agg(F.sort_array(F.collect_list("_v")).alias("_vs"))

    def at(q):
        pos = (F.size("_vs") - 1).cast("double") * F.lit(q)
        k = F.floor(pos).cast("int")
        low, high = F.get("_vs", k), F.get("_vs", F.least(k + 1, F.size("_vs") - 1))
        return low + (pos - F.floor(pos)) * (high - low)

    wanted = F.array(*[F.struct(F.lit(i).alias("_pid"), at(q).alias("_val")) for i, q in enumerate(qs)])
    return arrays.select(*group_cols, F.inline(wanted))


def _cuts(vals: DataFrame, group_cols, qs, accuracy) -> DataFrame:
    """For each group and probability (``_pid``) the ends of its ranges, ascending."""
    delta = 4.0 / accuracy
    steps = sorted([delta * (2 * j / PARTS - 1) for j in range(PARTS + 1)]
                   + [side * delta * w for w in WIDER for side in (-1, 1)])
    probs = [min(1.0, max(0.0, q + step)) for q in qs for step in steps]
    stats = vals.groupBy(*group_cols).agg(
        F.percentile_approx("_v", F.array(*[F.lit(x) for x in probs]), accuracy).alias("_all"))
    return stats.select(*group_cols, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_pid"), F.sort_array(F.slice("_all", i * len(steps) + 1, len(steps))).alias("_cuts"))
        for i in range(len(qs))])))


def _counted(vals: DataFrame, group_cols, qs, accuracy, is_global, put=None) -> DataFrame:
    """How many values each range (``_part``) has, with its ends (``_above`` <
    value <= ``_upto``, null is open).  Next to the rank (``_side`` 1) each
    distinct value has a row; what lies to either side is one row a range."""
    build = lambda: _cuts(vals, group_cols, qs, accuracy)
    cuts = put("cuts", build) if put else build()
    v, cut = F.col("_v"), lambda i: F.get("_cuts", i)
    last = PARTS + 2 * len(WIDER)
    part = (F.when(v <= cut(F.lit(0)), 0).when(v > cut(F.lit(last)), last + 1)
            .otherwise(F.size(F.filter("_cuts", lambda c: c < v))))
    side = F.when(F.col("_part") <= len(WIDER), 0).when(F.col("_part") <= len(WIDER) + PARTS, 1).otherwise(2)
    return (vals.join(F.broadcast(cuts) if is_global else cuts, group_cols)
            .withColumn("_part", part).withColumn("_side", side)
            .groupBy(*group_cols, "_pid", "_side", "_part",
                     F.when(F.col("_part") > 0, cut(F.col("_part") - 1)).alias("_above"),
                     cut(F.col("_part")).alias("_upto"), F.when(F.col("_side") == 1, v).alias("_bv"))
            .agg(F.count(F.lit(1)).alias("_c")))


def _ranges(counted: DataFrame, group_cols, qs) -> DataFrame:
    """The ranges that hold the wanted ranks, the values before (``_start``), and the ranks."""
    counts = counted.groupBy(*group_cols, "_pid", "_part", "_above", "_upto").agg(F.sum("_c").alias("_c"))
    whole = Window.partitionBy(*group_cols, "_pid")  # a few rows
    so_far = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, q = F.col("_n"), F.get(F.array(*[F.lit(x) for x in qs]), F.col("_pid"))
    pos = (n - 1).cast("double") * q
    ranked = (counts.withColumns({"_n": F.sum("_c").over(whole), "_end": F.sum("_c").over(so_far)})
              .withColumns({"_start": F.col("_end") - F.col("_c"), "_k": F.floor(pos), "_frac": pos - F.floor(pos)})
              .withColumn("_k1", F.least(F.col("_k") + 1, n - 1)))

    def holds(rank):
        return (F.col("_start") <= F.col(rank)) & (F.col(rank) < F.col("_end"))

    return ranked.where(holds("_k") | holds("_k1")).select(
        *group_cols, "_pid", "_above", "_upto", "_start", "_k", "_k1", "_frac")


def _bracketed(vals: DataFrame, group_cols, qs, accuracy, is_global, staged=None) -> DataFrame:
    """Cuts from the sketch, counts of the ranges between them, then the values
    in the ranges that hold the ranks (see the module docstring)."""
    put = staged or (lambda name, build: build())
    small = F.broadcast if is_global else (lambda df: df)
    ranges = put("ranges", lambda: _ranges(_counted(vals, group_cols, qs, accuracy, is_global, put), group_cols, qs))
    above, upto = F.col("_above"), F.col("_upto")
    inside = (above.isNull() | (F.col("_v") > above)) & (upto.isNull() | (F.col("_v") <= upto))
    one = [*group_cols, "_pid", "_start", "_k", "_k1", "_frac"]  # a range is known by its start
    w = (Window.partitionBy(*group_cols, "_pid", "_start").orderBy("_v")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (vals.join(small(ranges), group_cols).where(inside).groupBy(*one, "_v").agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_cum", F.col("_start") + F.sum("_c").over(w)))

    def at(rank):
        return F.min(F.when((F.col("_start") <= F.col(rank)) & (F.col("_cum") > F.col(rank)), F.col("_v")))

    picked = ranked.groupBy(*group_cols, "_pid", "_frac").agg(at("_k").alias("_low"), at("_k1").alias("_high"))
    return picked.select(*group_cols, "_pid",
                         (F.col("_low") + F.col("_frac") * (F.col("_high") - F.col("_low"))).alias("_val"))
