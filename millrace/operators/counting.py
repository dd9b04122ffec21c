"""Counts by key and condition, rates, summaries of collection runs, look-ups in small dimensions.

Everything here is one aggregate with partial sums before its shuffle, or a join with a dimension given as a literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def plain(col) -> Column:
    """A name without case and surrounding blanks."""
    return F.lower(F.trim(col))


def counts(df: DataFrame, by: dict[str, Column | str], where: dict[str, Column] | None = None, means: dict[str, Column | str] | None = None, total: str | None = "n", digits: int = 6) -> DataFrame:
    """One row per key (one in all without keys): rows, rows for which each condition holds, rounded means. A null condition does not hold."""
    keys = [(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in by.items()]
    out = [F.count("*").alias(total)] if total else []
    out += [F.count_if(c).alias(k) for k, c in (where or {}).items()]
    out += [F.round(F.avg(c), digits).alias(k) for k, c in (means or {}).items()]
    return df.groupBy(*keys).agg(*out) if keys else df.agg(*out)


def rates(df: DataFrame, by: list[str], where: dict[str, Column], digits: int = 6) -> DataFrame:
    """(keys, n, the share of rows for which each condition holds)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.count_if(c) / F.count("*"), digits).alias(k) for k, c in where.items()))


def success_rate(df: DataFrame, success: Column) -> DataFrame:
    """(ok, n, pct), 0 percent of no rows."""
    ok = F.count_if(success)
    return df.agg(ok.alias("ok"), F.count("*").alias("n"), F.when(F.count("*") > 0, F.round(100.0 * ok / F.count("*"), 4)).otherwise(0.0).alias("pct"))


def one_way_totals(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, g1, g2): counts by a, by b and of all rows in one pass; g1 and g2 tell which key is summed over."""
    g = df.groupingSets([[a], [b], []], a, b)
    return g.agg(F.count("*").alias("n"), F.grouping(a).cast("long").alias("g1"), F.grouping(b).cast("long").alias("g2"))


def label_rollup(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, total, vulnerable, safe) per key, and for all rows with a null key."""
    return df.rollup(key).agg(F.count("*").alias("total"), F.count_if(F.col(label) == 1).alias("vulnerable"), F.count_if(F.col(label) == 0).alias("safe"))


def top_values(df: DataFrame, key: Column, name: str, k: int | None = None) -> DataFrame:
    """(name, n): the most frequent values, ties by name with null first; all of them without k."""
    g = df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(name))
    return g.limit(k) if k else g


def every_value(df: DataFrame, key: Column, name: str, order: list[str], ident: str, value: str) -> DataFrame:
    """(name, place, n, mean_weight) for every value of a fixed list, in its order, also for values that no row has."""
    dim = df.sparkSession.createDataFrame([(n, i + 1) for i, n in enumerate(order)], f"{name} string, place long")
    g = df.groupBy(key.alias(name)).agg(F.count(ident).alias("n"), F.round(F.avg(value), 6).alias("mean_weight")).where(F.col(name).isin(order))
    return dim.join(F.broadcast(g), name, "left").select(name, "place", F.coalesce("n", F.lit(0)).alias("n"), "mean_weight").orderBy("place")


def risk_groups(df: DataFrame, level: Column, score: Column, ident: str, k: int = 10) -> DataFrame:
    """(level, n, mean_score, top): rows of each level, and the ids of its k highest scores, highest first, ties by id.

    The top lists come from a window limit that is applied before the shuffle; rows without level or score are left out.
    """
    x = df.select(level.alias("level"), score.alias("_s"), F.col(ident).alias("_i")).where("level is not null and _s is not null")
    best = x.withColumn("_r", F.row_number().over(W.partitionBy("level").orderBy(F.desc("_s"), "_i"))).where(F.col("_r") <= k)
    top = best.groupBy("level").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_i"))), lambda e: e["_i"]).alias("top"))
    return x.groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("_s"), 6).alias("mean_score")).join(top, "level")


# ---- collection runs ----------------------------------------------------------------------------------------------
def collectors(results: DataFrame, *keys: Column | str) -> DataFrame:
    """(keys, k, c): one row for each collector of each run."""
    return results.select(*keys, F.explode("collectors").alias("k", "c"))


def run_summary(results: DataFrame) -> DataFrame:
    """(run_id, at, ok, failed, collected, target) of each written state of a run; collected counts successful collectors only."""
    x = collectors(results, "run_id", F.unix_micros(F.col("written_at").cast("timestamp")).alias("at"))
    ok = F.coalesce("c.success", F.lit(False))
    return x.groupBy("run_id", "at").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(F.col("c.success"), F.col("c.samples_collected"))), F.lit(0)).alias("collected"), F.coalesce(F.sum("c.target_samples"), F.lit(0)).alias("target"))


def collector_rates(results: DataFrame) -> DataFrame:
    """(collector, collected, target, errors, per_second); 0 a second without a duration."""
    n, sec = F.sum(F.coalesce("c.samples_collected", F.lit(0))), F.sum("c.duration")
    return collectors(results).groupBy(plain("k").alias("collector")).agg(n.alias("collected"), F.sum(F.coalesce("c.target_samples", F.lit(0))).alias("target"), F.count_if(F.col("c.status") == "error").alias("errors"), F.when(sec > 0, F.round(n / sec, 4)).otherwise(0.0).alias("per_second"))


def weighted_total(results: DataFrame, weights: dict[str, float], name: str) -> DataFrame:
    """(run_id, name): samples of each collector times its weight, summed and rounded down; collectors without weight count nothing."""
    rate = F.coalesce(F.element_at(F.create_map(*[y for k, v in weights.items() for y in (F.lit(k), F.lit(v))]), plain("k")), F.lit(0.0))
    return collectors(results, "run_id").groupBy("run_id").agg(F.floor(F.round(F.sum(F.coalesce("c.samples_collected", F.lit(0)) * rate), 6)).alias(name))


def missing_collectors(results: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(run_id, name): wanted collectors that no state of a run has. wanted is a small table; one row of its names is looked at."""
    names = wanted.agg(F.collect_set(name).alias("want"))
    have = results.select("run_id", F.transform(F.map_keys("collectors"), plain).alias("k")).groupBy("run_id").agg(F.array_distinct(F.flatten(F.collect_list("k"))).alias("k"))
    return have.select("run_id", F.explode(F.array_except(names.scalar(), "k")).alias(name))


# ---- scores of runs and groups ------------------------------------------------------------------------------------
def seed_means(preds: DataFrame, seed: str, value: str) -> DataFrame:
    return preds.groupBy(seed).agg(F.avg(value).alias("m"))


def seed_spread(preds: DataFrame, seed: str, value: str) -> DataFrame:
    """(mean, std): mean and population deviation of the seeds' means; the deviation of one seed is 0."""
    return seed_means(preds, seed, value).agg(F.round(F.avg("m"), 6).alias("mean"), F.when(F.count("m") > 1, F.round(F.stddev_pop("m"), 6)).otherwise(F.lit(0.0)).alias("std"))


def best_seed(preds: DataFrame, seed: str, value: str) -> DataFrame:
    """(seed, score): the seed with the highest mean, the lowest of equal ones."""
    return seed_means(preds, seed, value).agg(F.max_by(seed, F.struct("m", -F.col(seed))).alias(seed), F.round(F.max("m"), 6).alias("score"))


def multi_seed_summary(metrics: DataFrame, seed: str, names: list[str]) -> DataFrame:
    """(metric, n, mean, std, least, most, best_seed) over the rows of all seeds' metrics; nulls are left out."""
    x = metrics.select(seed, F.explode(F.create_map(*[y for n in names for y in (F.lit(n), F.col(n).cast("double"))])).alias("metric", "v")).where("v is not null")
    return x.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("most"), F.max_by(seed, F.struct("v", -F.col(seed))).alias("best_seed"))


def ablation(df: DataFrame, variant: str, value: str, base: str) -> DataFrame:
    """(variant, score, gain_pct): mean of each variant, and its gain over the base variant in percent."""
    g = df.groupBy(variant).agg(F.avg(value).alias("m"))
    of = F.max(F.when(F.col(variant) == base, F.col("m"))).over(W.partitionBy())
    return g.select(variant, F.round("m", 6).alias("score"), F.round(100 * (F.col("m") - of) / of, 4).alias("gain_pct"))


def mean_loss(df: DataFrame, batch: Column, value: str) -> DataFrame:
    """(of_batches, of_rows): the mean of the batches' means, and the mean of all rows."""
    g = df.groupBy(batch.alias("b")).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return g.agg(F.round(F.avg("m"), 6).alias("of_batches"), F.round(F.sum("s") / F.sum("n"), 6).alias("of_rows"))


def length_summary(df: DataFrame, text: str) -> DataFrame:
    """(least, most, mean) length of a text column, the mean rounded down; nulls are left out."""
    n = F.length(text).cast("long")
    return df.agg(F.min(n).alias("least"), F.max(n).alias("most"), F.floor(F.sum(n) / F.count(text)).alias("mean"))


def extremes(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, best_<order>, best, worst, last_value): the best row, the earliest of equal ones, and the extreme and last values."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(order, F.struct(value, -F.col(order))).alias("best_event"), F.max(value).alias("best"), F.min(value).alias("worst"), F.max_by(value, order).alias("last_value"))


def graph_counts(edges: DataFrame, src: str, dst: str, names: tuple[str, str, str]) -> DataFrame:
    """(kind, n): distinct sources, targets and edges, and their sum with a null kind."""
    c = edges.agg(F.count_distinct(src).alias(names[0]), F.count_distinct(dst).alias(names[1]), F.count_distinct(src, dst).alias(names[2]))
    return c.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("kind", "n")).rollup("kind").agg(F.sum("n").alias("n"))


def optional_counts(left: DataFrame, key: str, middle: DataFrame, on_middle: str, far: DataFrame, link: str, on_far: str, parts: str, customers: str) -> DataFrame:
    """(key, parts, customers): distinct ends of a two-step path that may be missing at either step; 0 where it is."""
    x = left.select(key).join(middle, F.col(on_middle) == F.col(key), "left").join(far, F.col(on_far) == F.col(link), "left")
    return x.groupBy(key).agg(F.count_distinct(parts).alias("parts"), F.count_distinct(customers).alias("customers"))


# ---- look-ups and pairs -------------------------------------------------------------------------------------------
def looked_up(df: DataFrame, key: str, table: dict[str, str], name: str) -> DataFrame:
    """Rows with the value that a fixed table has for a key, null for keys it does not have."""
    dim = df.sparkSession.createDataFrame(list(table.items()), f"{key} string, {name} string")
    return df.join(F.broadcast(dim), key, "left")


def round_robin(ident: Column, values: list[str]) -> Column:
    """A value for each row, in turn by its number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(ident, F.lit(len(values))) + 1).cast("int"))


def word_jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of their distinct words that two texts have in common; 0 for texts without a word."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    x, y = words(a), words(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))


def counterpart_rows(df: DataFrame, ident: str, first: str, second: str) -> DataFrame:
    """(ident, label, code_md5, other_md5): each side of a pair as a row of its own, label 1 for the first; rows without both sides are left out."""
    pair = lambda n, a, b: F.struct(F.lit(n).alias("label"), F.md5(a).alias("code_md5"), F.md5(b).alias("other_md5"))
    x = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    return x.select(ident, F.explode(F.array(pair(1, first, second), pair(0, second, first))).alias("p")).select(ident, "p.*")


def counterparts(df: DataFrame, ident: str, pair: str, label: str, text: str) -> DataFrame:
    """(ident, other): md5 of the text that a pair has under the opposite label."""
    x = df.select(ident, label, text, pair)
    b = x.where(F.col(text).isNotNull()).select(pair, (1 - F.col(label)).alias(label), F.md5(text).alias("other"))
    return x.select(ident, pair, label).join(b, [pair, label]).select(ident, "other")


def joined_features(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, a, b, features): the arrays a and b of two tables, one after the other; keys of both only."""
    return a.join(b, key).withColumn("features", F.concat("a", "b"))


def not_in(df: DataFrame, key: str, done: list[str]) -> DataFrame:
    """Rows whose key is not in a short list; null keys stay out."""
    return df.where(F.col(key).isNotNull() & ~F.col(key).isin(list(done)))


def page(df: DataFrame, order: list, size: int, skip: int = 0) -> DataFrame:
    """Rows skip + 1 to skip + size of an order that must be total."""
    x = df.orderBy(*order)
    return (x.offset(skip) if skip else x).limit(size)


def search(df: DataFrame, text: str, pattern: str, order: str, size: int = 50) -> DataFrame:
    """The first rows, by `order`, whose text matches a pattern."""
    return page(df.where(F.col(text).rlike(pattern)), [order], size)


def after(df: DataFrame, order: str, done: DataFrame) -> DataFrame:
    """Rows beyond the highest number among those that are done; all rows if none is."""
    last = done.agg(F.max(order)).scalar()
    return df.where(last.isNull() | (F.col(order) > last))
