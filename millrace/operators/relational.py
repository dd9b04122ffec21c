"""Deduplication, set operations, sampling, splitting, quotas and lookups over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import ranked


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row, by order, of each value of key; rows without the key all stay.

    The smallest order per digest is aggregated, combined before the shuffle, so a value that a third of all rows
    share is no large group; rows then keep their place if they are that first one. `order` must be unique.
    """
    keyed = df.where(F.col(key).isNotNull())
    firsts = keyed.groupBy(F.md5(F.col(key).cast("string")).alias("_d")).agg(F.min(order).alias("_first")).select("_first")
    kept = keyed.join(firsts, keyed[order] == F.col("_first"), "left_semi")
    return kept.unionByName(df.where(F.col(key).isNull()))


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key is not in old."""
    return new.join(old.select(key).distinct(), key, "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames by column name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def hash_order(col: str, seed: int = 42) -> Column:
    """A fixed pseudo-random order that other engines can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(col).cast("string")))


def _hash_rank(df: DataFrame, within: list[str], id_col: str, seed: int, out: str) -> DataFrame:
    # 60 bits of the digest, spread over the whole signed range that `ranked` cuts into buckets
    h = (F.conv(F.substring(hash_order(id_col, seed), 1, 15), 16, 10).cast("long") - F.lit(1 << 59)) * 16
    return ranked(df.withColumn("_h", h), within, "_h", id_col, df.count(), out=out).drop("_h")


def balanced_sample(df: DataFrame, label: str, id_col: str, most: int | None = None, seed: int = 42) -> DataFrame:
    """As many rows of each of the labels 0 and 1 as the rarer has, at most `most` each, by hash order. Other labels drop."""
    two = df.where(F.col(label).isin(0, 1))
    sizes = {r[0]: r[1] for r in two.groupBy(label).count().collect()}
    n = min(sizes.get(0, 0), sizes.get(1, 0), most if most is not None else 1 << 62)
    return _hash_rank(two, [label], id_col, seed, "_r").where(F.col("_r") <= n).drop("_r")


def ratio_split(df: DataFrame, id_col: str, shares: dict[str, float], by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Adds `split`: exact shares of the rows in hash order, of each stratum if `by` is given. The last split takes the rest."""
    by = by or []
    r = _hash_rank(df, by, id_col, seed, "_r")
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    r = r.join(sizes.select(*[F.col(b).alias("_b" + b) for b in by], "_n"), reduce(lambda a, b: a & b, (F.col(b).eqNullSafe(F.col("_b" + b)) for b in by))) if by else r.withColumn("_n", F.lit(df.count()))
    out, acc, names = None, 0.0, list(shares)
    for name in names[:-1]:
        acc += shares[name]
        cut = F.floor(F.col("_n") * F.lit(acc) + F.lit(1e-9))
        out = F.when(F.col("_r") <= cut, name) if out is None else out.when(F.col("_r") <= cut, name)
    return r.withColumn("split", out.otherwise(names[-1])).drop("_r", "_n", *["_b" + b for b in by])


def top_per_group(df: DataFrame, group: list[str], order: list, n: int, out: str = "rank") -> DataFrame:
    """The first n rows of each group; the window's group limit drops the others before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def even_quota(types: DataFrame, type_col: str, total: int) -> DataFrame:
    """(type, quota): total div types each, one more for the first in alphabetical order."""
    k = types.select(type_col).distinct()
    n = k.count()
    w = W.orderBy(type_col)
    return k.withColumn("quota", (F.lit(total // max(n, 1)) + (F.row_number().over(w) <= total % max(n, 1)).cast("int")).cast("long"))


def weighted_resample(df: DataFrame, label: str, id_col: str, draws: int, seed: int = 42) -> DataFrame:
    """Draws with replacement, rows weighted by 1 / size of their class: a draw picks a class, then a row of it by rank."""
    sizes = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    classes = sorted(sizes)
    spark = df.sparkSession
    u = lambda salt: F.pmod(F.xxhash64(F.lit(f"{salt}:{seed}"), "draw"), F.lit(1 << 40)) / float(1 << 40)
    pick = F.element_at(F.array(*[F.lit(c) for c in classes]), (F.floor(u("class") * len(classes)) + 1).cast("int"))
    d = spark.range(draws).withColumnRenamed("id", "draw").withColumn("_label", pick)
    size = F.element_at(F.create_map(*[x for c in classes for x in (F.lit(c), F.lit(sizes[c]))]), F.col("_label"))
    d = d.withColumn("_rank", (F.floor(u("row") * size) + 1).cast("long"))
    r = _hash_rank(df.where(F.col(label).isNotNull()), [label], id_col, seed, "_r")
    return d.join(r, (d["_label"] == r[label]) & (d["_rank"] == r["_r"])).drop("_label", "_rank", "_r")


def overlapping(a: DataFrame, b: DataFrame, a_start: str, a_end: str, b_start: str, b_end: str, width: int, key: str | None = None) -> DataFrame:
    """Pairs of rows whose half-open ranges overlap: equi-join on buckets, the longer range of a pair giving their width.

    A range of at most `width` belongs to level 0, up to four times that to level 1, and so on; at its own level and
    above it touches at most two buckets. Each range stands at every level that occurs from its own on, and two ranges
    meet at the higher of their levels; so a range of any length is in a few rows. A pair that shares two buckets is
    kept at the first, so nothing is made distinct. Empty ranges and nulls overlap nothing.
    """
    level = lambda s, e: F.greatest(F.lit(0), F.ceil(F.log(4.0, (F.col(e) - F.col(s)) / float(width)) - 1e-9)).cast("int")
    x = a.where(F.col(a_end) > F.col(a_start)).withColumn("_la", level(a_start, a_end))
    y = b.where(F.col(b_end) > F.col(b_start)).withColumn("_lb", level(b_start, b_end))
    # levels grow with the logarithm of the length: at most 32 for 64-bit numbers
    levels = sorted({r[0] for side in (x.select("_la"), y.select("_lb")) for r in side.distinct().collect()})
    wide = lambda: F.lit(float(width)) * F.pow(F.lit(4.0), F.col("_l"))

    def at_levels(df, own, s, e):
        df = df.withColumn("_l", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: k >= F.col(own))))
        return df.withColumn("_k", F.explode(F.sequence(F.floor(F.col(s) / wide()), F.floor((F.col(e) - 1) / wide()))))

    x, y = at_levels(x, "_la", a_start, a_end), at_levels(y, "_lb", b_start, b_end)
    on = ["_l", "_k"] + ([key] if key else [])
    met = x.join(y, on).where((F.col("_l") == F.greatest("_la", "_lb")) & (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end)))
    return met.where(F.col("_k") == F.floor(F.greatest(a_start, b_start) / wide())).drop("_l", "_k", "_la", "_lb")


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key over both tables; of equal versions the change wins."""
    both = base.withColumn("_src", F.lit(0)).unionByName(changes.withColumn("_src", F.lit(1)))
    cols = base.columns
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(version, "_src")).alias("_row")).select("_row.*")
