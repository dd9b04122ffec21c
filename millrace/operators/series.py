"""Ordered series: latest state, streaks, spikes, running best, smoothing, sessions, rate windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], ts: str, tie: str) -> DataFrame:
    """The last row of each key by ts, of equal ones the one with the smallest tie. One aggregation, combined before the shuffle."""
    cols = df.columns
    return df.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(F.col(ts), -F.col(tie))).alias("_r")).select("_r.*")


def merge_state(df: DataFrame, key: str, ts: str, fields: list[str]) -> DataFrame:
    """For each key the last non-null value of each field."""
    return df.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(ts))).alias(f) for f in fields))


def streaks(df: DataFrame, key: list[str], order: list[str], bad: str, out: str = "streak") -> DataFrame:
    """Adds how many rows in a row, up to this one, are bad; 0 where it is not."""
    w = W.partitionBy(*key).orderBy(*order)
    b = F.coalesce(F.col(bad), F.lit(False))
    isle = F.sum((~b).cast("int")).over(w)
    return df.withColumn("_isle", isle).withColumn(out, F.when(b, F.sum(b.cast("int")).over(W.partitionBy(*key, "_isle").orderBy(*order))).otherwise(0)).drop("_isle")


def spikes(df: DataFrame, key: list[str], order: list[str], value: str, factor: float = 10.0, window: int = 5) -> DataFrame:
    """Adds `spike`: the value exceeds factor times the mean of the window - 1 values before it."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(-(window - 1), -1)
    return df.withColumn("spike", F.coalesce(F.col(value) > factor * F.avg(value).over(w), F.lit(False)))


def running_best(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds `best` so far and `patience`, the rows since the last strict improvement."""
    w = W.partitionBy(*key).orderBy(*order)
    before = F.max(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    better = F.coalesce(F.col(value) > before, F.lit(True)).cast("int")
    x = df.withColumn("best", F.max(value).over(w)).withColumn("_isle", F.sum(better).over(w))
    return x.withColumn("patience", F.row_number().over(W.partitionBy(*key, "_isle").orderBy(*order)) - 1).drop("_isle")


def ema(df: DataFrame, key: str, order: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(key, order, value, ema): s0 = x0, then alpha x + (1 - alpha) s.

    Recursive over each key's values in order: they are sorted in a partition and folded as they stream by, so a
    key of any length needs no list of its values.
    """

    def fold(batches):
        import pandas as pd

        now, s = object(), None
        for pdf in batches:
            out = []
            for k, v in zip(pdf[key], pdf[value]):
                if k != now:
                    now, s = k, None
                s = v if s is None else alpha * v + (1 - alpha) * s
                out.append(s)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], value: pdf[value], "ema": out})

    x = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, order, F.col(value).cast("double").alias(value))
    types = dict(x.dtypes)
    return x.repartition(key).sortWithinPartitions(key, order).mapInPandas(fold, f"{key} {types[key]}, {order} {types[order]}, {value} double, ema double")


def moving_average(df: DataFrame, key: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Adds `smooth`: the centred sum over `width` rows divided by width, at the edges too."""
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn("smooth", F.sum(value).over(w) / width)


def gradient(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Adds `slope`, the second-order difference of y over x inside, the one-sided one at the ends; x need not be even."""
    w = W.partitionBy(*key).orderBy(x)
    hd, hs = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    dp, dn = F.col(y) - F.lag(y).over(w), F.lead(y).over(w) - F.col(y)
    inner = (hd * hd * dn + hs * hs * dp) / (hd * hs * (hd + hs))
    return df.withColumn("slope", F.when(hd.isNull(), F.try_divide(dn, hs)).when(hs.isNull(), F.try_divide(dp, hd)).otherwise(inner))


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """(key, session, start, end, n): rows of a key less than or equal to the gap apart belong together."""
    w = W.partitionBy(key).orderBy(ts)
    sec = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce(sec - F.lag(sec).over(w) > int(gap_seconds * 1e6), F.lit(True)).cast("int")
    x = df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w))
    return x.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def rate_window(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Adds `recent`: the key's rows in the last `seconds`, this one included."""
    w = W.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.count("*").over(w))


def accepted(df: DataFrame, key: str, ts: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """(key, tie, ok): a call passes if fewer than `limit` passed calls lie in the window before it; refused calls do not count.

    Depends on its own results, so it is folded over the sorted calls of each key with the last `limit` passes kept.
    """

    def fold(batches):
        from collections import deque

        import pandas as pd

        now, kept = object(), deque()
        for pdf in batches:
            ok = []
            for k, at in zip(pdf[key], pdf["_at"]):
                if k != now:
                    now, kept = k, deque()
                while kept and kept[0] <= at - seconds * 1_000_000:
                    kept.popleft()
                ok.append(len(kept) < limit)
                if ok[-1]:
                    kept.append(at)
            yield pd.DataFrame({key: pdf[key], tie: pdf[tie], "ok": ok})

    x = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
    types = dict(x.dtypes)
    return x.repartition(key).sortWithinPartitions(key, "_at", tie).mapInPandas(fold, f"{key} {types[key]}, {tie} {types[tie]}, ok boolean")


def changed(df: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """Rows whose content differs from the key's row before, so A, B, A are three."""
    w = W.partitionBy(key).orderBy(*order)
    h = F.md5(F.coalesce(F.col(content), F.lit("")))
    return df.withColumn("_p", F.lag(h).over(w)).where(F.col("_p").isNull() | (F.col("_p") != h)).drop("_p")


def merge_ranges(df: DataFrame, key: str, start: str, end: str, slack: float) -> DataFrame:
    """(key, start, end, n): ranges that begin at most `slack` after the furthest end so far are joined."""
    w = W.partitionBy(key).orderBy(start, end)
    far = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce(F.col(start) > far + slack, F.lit(True)).cast("int")
    x = df.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    return x.groupBy(key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_g")


def last_values(df: DataFrame, keys: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """Rows with `last`, the values of the key's last `size` rows up to this one."""
    return df.withColumn("last", F.collect_list(value).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - size, 0)))


def steepest(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, at): where the value falls most per logarithm of the order up to the next row; orders are positive."""
    w = W.partitionBy(key).orderBy(order)
    x = df.where(F.col(value).isNotNull() & (F.col(order) > 0)).select(key, order, ((F.lead(value).over(w) - F.col(value)) / (F.log(F.lead(order).over(w)) - F.log(order))).alias("slope"))
    return x.where("slope is not null").groupBy(key).agg(F.min_by(order, F.struct("slope", order)).alias("at"))


def divergence(df: DataFrame, key: str, order: str, value: str, times: float) -> DataFrame:
    """(key, stopped): the first row whose positive value exceeds `times` the least so far."""
    w = W.partitionBy(key).orderBy(order)
    x = df.where(F.col(value) > 0).select(key, order, (F.col(value) > times * F.min(value).over(w)).alias("off"))
    return x.where("off").groupBy(key).agg(F.min(order).alias("stopped"))


def range_test(df: DataFrame, key: str, rate: str, loss: str, times: float = 4.0) -> DataFrame:
    """(key, suggested, stopped): of a given curve of losses by learning rate, the rate of steepest fall before the loss diverges.

    stopped is the rate at which the loss first exceeds `times` the least so far, null if it never does; the curve
    counts up to there. Rates are positive; nulls are left out.
    """
    stop = divergence(df, key, rate, loss, times)
    kept = df.join(stop, key, "left").where(F.col("stopped").isNull() | (F.col(rate) < F.col("stopped")))
    return steepest(kept.select(key, rate, loss), key, rate, loss).withColumnRenamed("at", "suggested").join(stop, key, "left")


def running_mean(df: DataFrame, keys: list[str], order: list[str], value: str, digits: int = 2) -> DataFrame:
    """Rows with `mean` of the key's values so far; sums are rounded to `digits`, so that the order of adding does not show."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("mean", F.try_divide(F.round(F.sum(value).over(w), digits), F.count(value).over(w)))


def last_rows(df: DataFrame, order: str, size: int) -> DataFrame:
    """The last rows of a log, latest first, with `total`, how many it has."""
    return df.orderBy(F.desc(order)).limit(size).withColumn("total", df.agg(F.count("*")).scalar())


def numbered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows with `ordinal`, counted from 0 within the key."""
    return df.withColumn("ordinal", (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def seconds_between(start: str, end: str) -> Column:
    return F.round((micros(end) - micros(start)) / 1e6, 6)


def year(ts: str) -> Column:
    return F.substring(F.col(ts).cast("string"), 1, 4)


def later_than(ts: str, since: str, days: int) -> Column:
    """Whether a time is more than so many days after another."""
    return micros(ts) - micros(since) > days * 86_400_000_000
