"""Counts, confusion figures, threshold sweeps, ensembles, bootstrap and series summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import settle


def shares(df: DataFrame, key: Column, name: str, digits: int = 4) -> DataFrame:
    """(name, n, pct): rows per value and their share of all rows."""
    g = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), digits))


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp with labels fixed to 0 and 1; zeros for no rows. Null labels or predictions count nowhere."""
    t, p = F.col(truth), F.col(predicted)
    c = lambda a, b: F.count_if((t == a) & (p == b))
    return df.groupBy(*(by or [])).agg(c(0, 0).alias("tn"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(1, 1).alias("tp"))


def ratio(a, b) -> Column:
    """a / b as a double, 0 where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def scores(c: DataFrame, digits: int = 6) -> DataFrame:
    """Adds precision, recall, f1, balanced_accuracy and accuracy to confusion counts; 0 where undefined."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    r = lambda x: F.round(x, digits)
    return c.withColumns({
        "precision": r(ratio(tp, tp + fp)),
        "recall": r(ratio(tp, tp + fn)),
        "f1": r(ratio(2 * tp, 2 * tp + fp + fn)),
        "balanced_accuracy": r((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2),
        "accuracy": r(ratio(tp + tn, tp + tn + fp + fn)),
    })


def threshold_sweep(df: DataFrame, truth: str, prob: str, low: int = 30, high: int = 70) -> DataFrame:
    """(pct, threshold, tn, fp, fn, tp and scores) for prob >= pct / 100, each pct from low to high.

    Rows are counted once per bucket of the grid; a running sum from above gives all thresholds. So the data is
    aggregated once whatever the number of thresholds, and no row is joined with the grid. No rows give no thresholds.
    """
    p = F.col(prob).cast("double")
    # the largest grid point that the probability reaches, found exactly: floor, then a step for rounding
    k = F.floor(p * 100)
    k = F.when(p >= (k + 1) / F.lit(100.0), k + 1).when(p < k / F.lit(100.0), k - 1).otherwise(k)
    x = df.where(F.col(truth).isin(0, 1) & p.isNotNull() & ~F.isnan(p))
    g = x.groupBy(F.greatest(F.least(k, F.lit(high)), F.lit(low - 1)).alias("pct")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    grid = df.sparkSession.range(low - 1, high + 1).select(F.col("id").alias("pct"))
    g = grid.join(g, "pct", "left").na.fill(0)
    up = W.orderBy(F.desc("pct")).rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy()
    s = g.select("pct", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), F.sum("pos").over(all_).alias("P"), F.sum("neg").over(all_).alias("N"))
    s = s.where((F.col("pct") >= low) & (F.col("P") + F.col("N") > 0)).select("pct", (F.col("pct") / 100.0).alias("threshold"), (F.col("N") - F.col("fp")).alias("tn"), "fp", (F.col("P") - F.col("tp")).alias("fn"), "tp")
    return scores(s)


def best_threshold(sweep: DataFrame, by: str = "f1") -> DataFrame:
    """The row with the best score; of equal ones the lowest threshold."""
    return sweep.agg(F.max_by(F.struct(*sweep.columns), F.struct(by, -F.col("pct"))).alias("_b")).select("_b.*")


def roc_auc(df: DataFrame, truth: str, prob: str) -> DataFrame:
    """(auc): area under the curve with half counts for ties, 0 where one label is missing.

    Distinct scores are aggregated and range-sorted; the sums of whole ranges, as many as there are shuffle
    partitions, are added up first, then the scores inside each range.
    """
    x = df.where(F.col(truth).isin(0, 1) & F.col(prob).isNotNull()).select(F.col(prob).alias("score"), F.col(truth).alias("truth"))
    g = x.groupBy("score").agg(F.count_if(F.col("truth") == 1).alias("pos"), F.count_if(F.col("truth") == 0).alias("neg"))
    g = settle(g.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    before = lambda w: F.coalesce(F.sum("neg").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = g.groupBy("part").agg(F.sum("neg").alias("neg")).select("part", before(W.orderBy("part")).alias("lower"))
    s = g.join(F.broadcast(ranges), "part").withColumn("below", F.col("lower") + before(W.partitionBy("part").orderBy("score")))
    s = s.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return s.select(F.round(ratio(F.col("u"), F.coalesce(F.col("all_pos") * F.col("all_neg"), F.lit(0))), 6).alias("auc"))


def ensemble_mean(preds: DataFrame, row: str, prob: str, label: str) -> DataFrame:
    """(row, prob, label): mean over seeds, after checking that all seeds have the same label for a row."""
    g = preds.groupBy(row).agg(F.avg(prob).alias(prob), F.max(label).alias(label), F.count_distinct(label).alias("_labels"))
    return g.withColumn(label, F.when(F.col("_labels") <= 1, F.col(label)).otherwise(F.raise_error(F.lit("labels differ between seeds")).cast("int"))).drop("_labels")


def misaligned(preds: DataFrame, row: str, label: str, seeds: int) -> DataFrame:
    """Rows whose labels differ between seeds, or that some seed lacks."""
    return preds.groupBy(row).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("n")).where((F.col("labels") > 1) | (F.col("n") != seeds))


def vote(preds: DataFrame, row: str, prob: str, seed: str, weights: dict | None = None) -> DataFrame:
    """(row, soft, hard, weighted, confident, agreement) over the seeds of a row; a hard tie goes to label 0.

    weighted: by the weight of each seed; confident: each seed's label weighs as much as its probability is away from even.
    """
    w = F.coalesce(F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col(seed)), F.lit(0.0)) if weights else F.lit(1.0)
    pos = (F.col(prob) >= 0.5).cast("int")
    sure = F.abs(F.col(prob) - 0.5)
    g = preds.groupBy(row).agg(F.avg(prob).alias("soft"), F.sum(pos).alias("_p"), F.count("*").alias("_n"), F.sum(w * F.col(prob)).alias("_wp"), F.sum(w).alias("_w"), F.round(F.sum(F.when(pos == 1, sure).otherwise(-sure)), 9).alias("_sure"))
    return g.select(row, F.round("soft", 6).alias("soft"), (2 * F.col("_p") > F.col("_n")).cast("int").alias("hard"), F.round(ratio("_wp", "_w"), 6).alias("weighted"), (F.col("_sure") > 0).cast("int").alias("confident"), F.round(F.greatest("_p", F.col("_n") - F.col("_p")) / F.col("_n"), 6).alias("agreement"))


def bootstrap_mean(df: DataFrame, value: str, id_col: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(mean, low, high): 95 % interval of the mean from `resamples` Poisson resamples.

    A row is in each resample as often as an independent Poisson(1) draw says; the draws come from a hash of its id, so
    that the result does not change with partitioning (ids are unique). A batch becomes one row, the sums of all
    resamples, before anything is shuffled. Null values take no part; without rows all is null.
    """
    cdf = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 20)]))
    most = np.uint64(1 << 53)

    def sums(batches):
        r = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            v, h = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            total, n = np.zeros(resamples), np.zeros(resamples)
            for at in range(0, len(v), 512):
                z = h[at : at + 512].view(np.uint64)[:, None] + r[None]
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
                k = np.searchsorted(cdf, (z >> np.uint64(11)).astype(np.float64) / float(most), "right")
                total += v[at : at + 512] @ k
                n += k.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(resamples), pa.int32()), pa.array(total), pa.array(n)], ["r", "total", "n"])

    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), id_col).alias("h"))
    g = x.mapInArrow(sums, "r int, total double, n double").groupBy("r").agg((F.sum("total") / F.sum("n")).alias("m"))
    q = g.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return q.select(F.round(x.agg(F.avg("v")).scalar(), 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def class_weights(df: DataFrame, label: str, multiplier: float = 1.0, cap: float = 5.0) -> DataFrame:
    """(label, n, weight): total / (2 n) times the multiplier for label 1, capped."""
    g = df.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"))
    w = F.sum("n").over(W.partitionBy()) / (2.0 * F.col("n")) * F.when(F.col(label) == 1, multiplier).otherwise(1.0)
    return g.withColumn("weight", F.round(F.least(w, F.lit(cap)), 6))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_diff, sd, low, high, improvement_pct, t, p, significant): paired t-test of b against a.

    low and high are 1.96 standard errors from the mean difference; improvement is in percent of the mean of a;
    significant if p is below 0.05, from the t distribution by numerical integration. Pairs with a null are left out.
    """

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        import math

        def tail(x, df_):
            if x is None or df_ is None or math.isnan(x) or df_ < 1:
                return None
            # I_y(df/2, 1/2) by Simpson's rule in an angle that has no pole: y = df / (df + t^2) = cos^2
            top, steps = math.atan(abs(x) / math.sqrt(df_)), 2000
            f = lambda a: math.cos(a) ** (df_ - 1)
            h = top / steps
            part = sum((4 if i % 2 else 2) * f(i * h) for i in range(1, steps)) + f(0) + f(top)
            norm = math.exp(math.lgamma((df_ + 1) / 2) - math.lgamma(df_ / 2)) / math.sqrt(math.pi)
            return max(0.0, 1 - 2 * norm * part * h / 3)

        return pd.Series([tail(x, k - 1) for x, k in zip(t, n)])

    x = df.select(F.col(a).cast("double").alias("a"), (F.col(b) - F.col(a)).cast("double").alias("d")).where("d is not null")
    g = x.agg(F.count("*").alias("n"), F.avg("a").alias("base"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    g = g.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("t", F.when(F.col("sd") > 0, F.col("mean_diff") / F.col("se")))
    g = g.withColumn("p", p_value("t", "n"))
    low, high = (F.col("mean_diff") + k * 1.96 * F.col("se") for k in (-1, 1))
    improvement = F.try_divide(100 * F.col("mean_diff"), F.abs("base"))
    named = {"mean_diff": F.col("mean_diff"), "sd": F.col("sd"), "low": low, "high": high, "improvement_pct": improvement, "t": F.col("t"), "p": F.col("p")}
    return g.select("n", *(F.round(c, 6).alias(k) for k, c in named.items()), F.coalesce(F.col("p") < 0.05, F.lit(False)).alias("significant"))


def size_summary(df: DataFrame, size: str) -> DataFrame:
    """(n, mean, median, p95, most, batch): exact percentiles with linear interpolation; batch = 8e9 / (p95 * 1024) in 1..64."""
    g = df.where(F.col(size).isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg(size), 6).alias("mean"), F.percentile(size, 0.5).alias("median"), F.percentile(size, 0.95).alias("p95"), F.max(size).cast("long").alias("most"))
    return g.withColumn("batch", F.greatest(F.least(F.floor(F.try_divide(F.lit(8e9), F.col("p95") * 1024)), F.lit(64)), F.lit(1)).cast("long"))
