"""Mixing sources to target weights by proportionate-fair scheduling.

A source with p of every W slots owns blocks 1, 2, ...; block i is released at slot floor((i-1) W / p) and due by
slot ceil(i W / p). Earliest deadline first among released blocks keeps every source within less than one block of
its share at each prefix. After W slots all sources are exactly at their share, so the order repeats: the schedule
of one period of W slots (weights are whole percents, so 100) gives the slot of any block by arithmetic, and records
find their slots without an exchange.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ranked, settle

#: mix_targets is a small table by definition; more rows are refused.
MAX_SOURCES = 10_000


def releases(weight: int, period: int, i: int) -> int:
    """The slot before which block i of a source may not stand."""
    return (i - 1) * period // weight


def deadline(weight: int, period: int, i: int) -> int:
    return -(-i * period // weight)


def schedule(weights: dict[str, int]) -> list[str]:
    """Source of each slot of one period, whose length is the sum of the weights."""
    period = sum(weights.values())
    waiting = sorted((releases(w, period, i), deadline(w, period, i), s) for s, w in weights.items() for i in range(1, w + 1))
    out, ready, k = [], [], 0
    for slot in range(period):
        while k < len(waiting) and waiting[k][0] <= slot:
            heapq.heappush(ready, waiting[k][1:])
            k += 1
        due, source = heapq.heappop(ready)
        assert due > slot, "a feasible schedule misses no deadline"
        out.append(source)
    return out


def read_targets(targets: DataFrame) -> list:
    """Targets of the sources, whose names count without case and surrounding blanks; two for one source are refused."""
    rows = targets.where("source is not null and target_pct is not null").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = [r["source"].strip().lower() for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("a source has two targets: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))
    return rows


def plain(col):
    return F.lower(F.trim(col))


def run_counts(results: DataFrame) -> DataFrame:
    """(run_id, total, counts map<collector, samples>) of each run's latest row; of rows equally late, any that ranks last by content.

    Collectors whose names differ only in case or surrounding blanks are added up. Null counts are 0; a run with a
    null or empty map has total 0.
    """
    latest = results.select("run_id", "written_at", F.transform(F.map_entries("collectors"), lambda e: F.struct(plain(e["key"]).alias("k"), F.coalesce(e["value"]["samples_collected"], F.lit(0).cast("long")).alias("n"))).alias("c"))
    latest = latest.groupBy("run_id").agg(F.max_by("c", F.struct("written_at", F.col("c").cast("string"))).alias("c"))
    return latest.select("run_id", F.coalesce("c", F.array().cast("array<struct<k:string,n:bigint>>")).alias("c"))


def short_sources(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(run_id, source) of the sources that cannot fill their share of a mix as large as the run.

    The horizon is the run's total. A source can serve max_repeats x samples blocks; it falls short if the first
    block beyond those is released before the horizon. For whole numbers that is target_pct * total > 100 * supply.
    """
    rows = [r for r in read_targets(targets) if r["target_pct"] > 0]
    if not rows:
        return results.select("run_id", F.lit("").alias("source")).limit(0)
    period = sum(r["target_pct"] for r in rows)
    runs = run_counts(results)
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    each = F.array(*[F.struct(F.lit(r["source"]).alias("source"), F.lit((r["collector"] or "").strip().lower()).alias("col"), F.lit(int(r["target_pct"])).cast("long").alias("w"), F.lit(int(r["max_repeats"] or 0)).cast("long").alias("cap")) for r in rows])
    x = runs.select("run_id", "c", total.alias("total"), F.explode(each).alias("t"))
    supply = F.aggregate(F.filter("c", lambda e: e["k"] == F.col("t.col")), F.lit(0).cast("long"), lambda a, e: a + e["n"]) * F.col("t.cap")
    release = F.expr(f"supply * {period} div t.w")  # of block supply + 1
    return x.withColumn("supply", supply).withColumn("release", release).where("release < total").select("run_id", F.col("t.source").alias("source"))


def mix(samples: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(slot, source, sample_id, repeat): the mix in order. Slots count from 0; the slots of a source that has run out are absent.

    total: slots to fill, by default as many as there are rows of the wanted sources. Records follow in hash order
    and each occurs at most max_repeats times; repeat counts from 1. Rows of other sources, or of none, are left out.
    """
    rows = read_targets(targets)
    weights = {r["source"].strip().lower(): int(r["target_pct"]) for r in rows if r["target_pct"] > 0}
    caps = {r["source"].strip().lower(): int(r["max_repeats"] or 0) for r in rows}
    if not weights:
        return samples.select(F.lit(0).cast("long").alias("slot"), F.lit("").alias("source"), "sample_id", F.lit(1).alias("repeat")).limit(0)
    period, order = sum(weights.values()), schedule(weights)
    at = {s: [k for k, x in enumerate(order) if x == s] for s in weights}
    pool = settle(samples.select("sample_id", plain("source").alias("source")).where(F.col("source").isin(list(weights))).withColumn("_h", F.xxhash64("sample_id")))
    sizes = {r[0]: r[1] for r in pool.groupBy("source").count().collect()}
    have = sum(sizes.values())
    horizon = have if total is None else total
    # blocks released within the horizon, as far as the source can serve them
    blocks = {s: min(sum(1 for k in at[s] if k < horizon % period) + horizon // period * weights[s], sizes.get(s, 0) * caps[s]) for s in weights}
    pick = lambda d, kind: F.element_at(F.create_map(*[y for s in weights for y in (F.lit(s), d(s))]), F.col("source")).cast(kind)
    r = ranked(pool, ["source"], "_h", "sample_id", have)
    r = r.withColumn("n", pick(lambda s: F.lit(sizes.get(s, 0)), "long")).withColumn("b", pick(lambda s: F.lit(blocks[s]), "long")).withColumn("w", pick(lambda s: F.lit(weights[s]), "long"))
    r = r.where("rank <= b").withColumn("i", F.explode(F.expr("sequence(rank, b, n)")))
    places = F.element_at(F.create_map(*[y for s in weights for y in (F.lit(s), F.array(*[F.lit(k) for k in at[s]]))]), F.col("source"))
    slot = F.expr("(i - 1) div w") * period + F.get(places, F.expr("(i - 1) % w").cast("int"))
    return r.select(slot.cast("long").alias("slot"), "source", "sample_id", F.expr("(i - 1) div n + 1").cast("int").alias("repeat"))


def mix_report(samples: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_pct, blocks, records, max_repeat, reached_pct): the shares that the mix reached."""
    m = mix(samples, targets, total)
    got = m.groupBy("source").agg(F.count("*").alias("blocks"), F.count_if(F.col("repeat") == 1).alias("records"), F.max("repeat").alias("max_repeat"))
    t = targets.where("source is not null and target_pct is not null").select(plain("source").alias("source"), "target_pct")
    whole = got.agg(F.sum("blocks")).scalar()
    j = t.join(F.broadcast(got), "source", "left")
    return j.select("source", "target_pct", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("max_repeat", F.lit(0)).alias("max_repeat"), F.round(100.0 * F.coalesce("blocks", F.lit(0)) / whole, 4).alias("reached_pct"))
