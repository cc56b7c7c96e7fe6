"""Row-ordered window features per series.

All windows are ``partitionBy("series_key").orderBy("date")`` with row
frames, like pandas ``shift``/``rolling`` on a frame with missing dates.
Inputs are daily frames (one row per series and observed day), so a window
partition is one series: at most one row per calendar day.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.numeric import round_half_up

ROLL_WINDOWS = (7, 14, 28, 90)
LAGS = (7, 14, 28, 56)
EWM_SPAN = 14
# Weights fall by about this factor within a block of the weighted mean, so a
# block's sums keep their digits; rows that many blocks back weigh below 1e-36
# of the newest one, which no double can show.
EWM_FALL = 1e4
EWM_BLOCKS_BACK = 9


def series_window(series_col: str = "series_key", order_col: str = "date") -> Window:
    return Window.partitionBy(series_col).orderBy(order_col)


def add_rolling(df: DataFrame, target: str = "revenue", windows: Sequence[int] = ROLL_WINDOWS,
                money_digits: int | None = 2) -> DataFrame:
    """Mean and sample std over the previous ``n`` rows (the current
    row excluded, at least one row); std of fewer than two rows is 0.

    With ``money_digits`` the frame sum is rounded to that many decimals
    before dividing (the values are cents, so this removes only summation
    noise and makes the mean independent of the engine's summation order).
    """
    w = series_window()
    cols = {}
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        if money_digits is None:
            cols[f"roll_mean_{n}d"] = F.avg(target).over(frame)
        else:
            cols[f"roll_mean_{n}d"] = F.try_divide(
                round_half_up(F.sum(target).over(frame), money_digits),
                F.count(target).over(frame))
        cols[f"roll_std_{n}d"] = F.coalesce(F.stddev_samp(target).over(frame), F.lit(0.0))
    return df.withColumns(cols)


def add_lags(df: DataFrame, target: str = "revenue", lags: Sequence[int] = LAGS) -> DataFrame:
    """Value ``n`` rows earlier."""
    w = series_window()
    return df.withColumns({f"lag_{n}d": F.lag(target, n).over(w) for n in lags})


def momentum(short: Column, long: Column) -> Column:
    """Short / long mean, zero or missing long mean gives 1, 4 places."""
    return round_half_up(F.coalesce(F.try_divide(short, long), F.lit(1.0)), 4)


def add_ewm_previous(df: DataFrame, target: str = "revenue", span: int = EWM_SPAN, name: str = "ewm_14d") -> DataFrame:
    """Unadjusted exponentially weighted mean of the previous rows, in ``name``.

    pandas ``shift(1).ewm(span, adjust=False).mean()``: e starts at the first
    value and then e <- (1 - a) e + a x with a = 2 / (span + 1).  Rows without
    a value leave e as it is.

    Every step is an affine map of e, and chains of them can be summed up in
    any grouping, so the mean is a prefix sum in two levels.  A series is cut
    into blocks of rows.  Within a block, values weighted by their age are
    summed up to each row; then the sums of whole blocks before it follow,
    each weighted by its distance.  Both are sums over windows of the series:
    no row looks back further than its block, and nothing is collected.
    """
    alpha = 2.0 / (span + 1.0)
    keep = 1.0 - alpha
    if keep <= 0.0:  # only the newest value counts
        return df.withColumn(name, F.last(F.col(target).cast("double"), ignorenulls=True).over(
            series_window().rowsBetween(Window.unboundedPreceding, -1)))
    size = max(1, int(math.log(EWM_FALL) / -math.log(keep)))
    x = F.col(target).cast("double")
    # rows without a value form a window of their own and are counted nowhere
    own = Window.partitionBy("series_key", F.col("_seen")).orderBy("date")
    out = df.withColumn("_seen", x.isNotNull())
    out = out.withColumn("_i", F.row_number().over(own) - 1)
    out = out.withColumns({"_block": F.floor(F.col("_i") / size), "_k": F.col("_i") % size})
    weighted = x * F.when(F.col("_i") == 0, 1.0).otherwise(alpha) * F.pow(F.lit(keep), -F.col("_k"))
    block = Window.partitionBy("series_key", "_seen", "_block").orderBy("date")
    out = out.withColumns({
        "_upto": F.sum(weighted).over(block.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_whole": F.sum(weighted).over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    before = F.lit(0.0)
    for m in range(1, EWM_BLOCKS_BACK + 1):  # the row that many sizes back lies in the block that many back
        before = before + F.coalesce(F.lag("_whole", m * size).over(own), F.lit(0.0)) * keep ** (m * size)
    mean = F.pow(F.lit(keep), F.col("_k")) * (F.col("_upto") + before)
    out = out.withColumn("_ewm", F.when(F.col("_seen"), mean))
    last = F.last("_ewm", ignorenulls=True).over(series_window().rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn(name, last).drop("_seen", "_i", "_block", "_k", "_upto", "_whole", "_ewm")


def add_rolling_and_lags(df: DataFrame, target: str = "revenue") -> DataFrame:
    """The reference's block C: rolling means / stds, lags, momentum, ewm."""
    out = add_lags(add_rolling(df, target), target)
    out = out.withColumn("momentum_7_28", momentum(F.col("roll_mean_7d"), F.col("roll_mean_28d")))
    return add_ewm_previous(out, target)


def drop_warmup(df: DataFrame, col: str = "lag_56d") -> DataFrame:
    """Drop rows whose longest lag is still missing."""
    return df.dropna(subset=[col])


def latest_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The last row of each series (``max_by`` over date)."""
    return df.groupBy("series_key").agg(
        F.max("date").alias("last_date"),
        *[F.max_by(c, "date").alias(f"last_{c}") for c in cols])


def holdout_rows(df: DataFrame, n: int = 90) -> DataFrame:
    """``split`` = holdout for the last ``n`` rows of each series."""
    w_all = Window.partitionBy("series_key")
    rn = F.row_number().over(series_window())
    cnt = F.count(F.lit(1)).over(w_all)
    return df.withColumn("split", F.when(rn > cnt - n, "holdout").otherwise("train"))


def holdout_days(df: DataFrame, days: int = 90) -> DataFrame:
    """holdout = dates after (last date - ``days``) of each series."""
    last = F.max("date").over(Window.partitionBy("series_key"))
    return df.withColumn("split", F.when(F.col("date") > F.date_sub(last, days), "holdout")
                                   .otherwise("train"))


def future_spine(last_dates: DataFrame, horizon: int) -> DataFrame:
    """``horizon`` consecutive dates after each series' last date, with
    the step number ``h`` (1..horizon)."""
    return last_dates.select(
        "series_key",
        F.posexplode(F.sequence(F.date_add("last_date", 1), F.date_add("last_date", horizon)))
        .alias("_i", "date"),
    ).select("series_key", "date", (F.col("_i") + 1).alias("h"))


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls replaced by the exact median of the column within the series.

    One quantile pass and one join for all columns."""
    from ledgerlight.operators.quantiles import multi_quantiles
    medians = multi_quantiles(df, {f"_med_{c}": (c, 0.5) for c in cols}, ["series_key"])
    filled = df.join(medians, "series_key", "left")
    return filled.select(*[F.coalesce(F.col(c), F.col(f"_med_{c}")).alias(c) if c in cols else c for c in df.columns])
