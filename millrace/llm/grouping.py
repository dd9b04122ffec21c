"""Splits that keep related records together: components over packages, then largest differencing into equal bins."""

from __future__ import annotations

import heapq
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..runtime import settle, skew_safe_lookup

BINS = 200
#: Bins are dealt in so many lanes of equal numbers: whole lanes make splits even, their bins make sums exact.
LANES = 20
TOLERANCE = 0.001
#: A kind of so many groups is a stratum of its own.
STRATUM_GROUPS = 20
GROUPS_A_CHUNK = 50_000
#: Partial solutions (one a stratum and chunk) that one task combines.
TUPLES_A_TASK = 2048


def package_keys(name, ecosystem):
    """The distinct packages a cell names: letters and digits of each name, with the ecosystem, in lower case.

    A null ecosystem agrees only with null. Names without a letter or digit count for nothing.
    """
    names = F.transform(F.split(F.lower(name), r"[,;|\r\n]"), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]+", ""))
    eco = F.coalesce(F.concat(F.lit("e"), F.lower(F.trim(ecosystem))), F.lit("n"))
    return F.transform(F.array_sort(F.array_distinct(F.filter(names, lambda x: x != ""))), lambda x: F.concat(eco, F.lit("\u0001"), x))


def related_groups(samples: DataFrame) -> DataFrame:
    """(sample_id, group_id, members) of every row that names a package; group_id is the group's smallest sample_id.

    A package that a third of all rows name is one key of the aggregates (combined before the shuffle) and is joined
    by broadcast, so no task holds its rows. Components run over packages, not rows. Null or blank names take no
    part; repeated rows and repeated sample_ids are members as often as they occur.
    """
    base = settle(samples.select("sample_id", package_keys(F.col("metadata.package_name"), F.col("metadata.ecosystem")).alias("keys")).where("size(keys) > 0"))
    each = base.select("sample_id", F.posexplode("keys").alias("pos", "key"))
    keys = settle(each.groupBy("key").agg(F.min("sample_id").alias("rep"), F.count_if(F.col("pos") == 0).alias("n")))
    pairs = base.where("size(keys) > 1").select(F.col("keys")[0].alias("k0"), F.explode(F.slice("keys", 2, 1 << 20)).alias("k1")).distinct()
    reps = keys.select("key", "rep")
    edges = pairs.join(reps.select(F.col("key").alias("k0"), F.col("rep").alias("a")), "k0").join(reps.select(F.col("key").alias("k1"), F.col("rep").alias("b")), "k1").select("a", "b")
    comp = components(edges)
    lookup = keys.join(comp, keys["rep"] == comp["node"], "left").select("key", "n", F.coalesce("comp", "rep").alias("group_id"))
    sizes = lookup.groupBy("group_id").agg(F.sum("n").alias("members"))
    lookup = settle(lookup.where("n > 0").join(sizes, "group_id"))
    total = base.count()
    rows = base.select("sample_id", F.col("keys")[0].alias("key"))
    return skew_safe_lookup(rows, lookup, "key", "n", total).select("sample_id", "group_id", "members")


def found_groups(samples: DataFrame) -> DataFrame:
    """(sample_id, group_id) of the members of groups of two or more."""
    return related_groups(samples).where("members > 1").select("sample_id", "group_id")


def difference(weights: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each weight by largest differencing into `bins` bins.

    `bins` equal weights make a tuple without spread and are dealt out at once; what is left of each weight enters
    the heap as a tuple of one load. The two tuples of largest spread are combined again and again, the largest
    loads of one with the smallest of the other.
    """
    order = np.argsort(-weights, kind="stable")
    out = np.empty(len(weights), dtype=np.int64)
    heap, count = [], itertools.count()
    cut = np.flatnonzero(np.diff(weights[order])) + 1
    for run in np.split(order, cut):
        if not len(run):
            continue
        even = len(run) // bins * bins
        out[run[:even]] = np.arange(even) % bins
        for i in run[even:]:
            loads = [(0.0, ())] * (bins - 1) + [(float(weights[i]), (int(i),))]
            heapq.heappush(heap, (-float(weights[i]), next(count), loads))
    # members are nested tuples, flattened once at the end
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1]) for x, y in zip(a, reversed(b))), key=lambda z: z[0])
        low = merged[0][0]
        merged = [(w - low, m) for w, m in merged]
        heapq.heappush(heap, (-merged[-1][0], next(count), merged))
    if heap:
        for k, (_, members) in enumerate(heap[0][2]):
            stack = [members]
            while stack:
                m = stack.pop()
                if isinstance(m, int):
                    out[m] = k
                else:
                    stack.extend(m)
    return out


def combine_loads(loads: np.ndarray) -> np.ndarray:
    """Rows are the bin loads of partial solutions; for each row, which final bin each of its bins goes to.

    The same step on tuples that are already whole: the two of largest spread are combined, extremes together.
    """
    n, bins = loads.shape
    to = np.tile(np.arange(bins), (n, 1))
    groups = {i: [i] for i in range(n)}
    cur = {i: loads[i].astype(float) for i in range(n)}
    heap = [(-(loads[i].max() - loads[i].min()), i) for i in range(n)]
    heapq.heapify(heap)
    while len(heap) > 1:
        i, j = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        oi, oj = np.argsort(cur[i], kind="stable"), np.argsort(-cur[j], kind="stable")
        target = np.empty(bins, dtype=np.int64)
        target[oj] = oi  # the largest of j onto the smallest of i
        for g in groups[j]:
            to[g] = target[to[g]]
        moved = np.zeros(bins)
        moved[target] = cur[j]
        cur[i] = cur[i] + moved
        groups[i] += groups.pop(j)
        heapq.heappush(heap, (-(cur[i].max() - cur[i].min()), i))
    return to


def _lanes(bins: int) -> int:
    return LANES if bins % LANES == 0 else bins


def difference_in_lanes(weights: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each weight: by `difference` into lanes, then each lane into its bins."""
    lanes = _lanes(bins)
    out = difference(weights, lanes)
    if lanes < bins:
        lane = out.copy()
        for k in range(lanes):
            own = np.flatnonzero(lane == k)
            out[own] = k * (bins // lanes) + difference(weights[own], bins // lanes)
    return out


def combine_in_lanes(loads: np.ndarray) -> np.ndarray:
    """As `combine_loads`, for whole lanes and then for the bins of each."""
    n, bins = loads.shape
    lanes = _lanes(bins)
    if lanes == bins:
        return combine_loads(loads)
    per = bins // lanes
    cube = loads.reshape(n, lanes, per)
    to_lane = combine_loads(cube.sum(2))
    out = np.empty((n, lanes, per), dtype=np.int64)
    for lane in range(lanes):
        source = np.argmax(to_lane == lane, axis=1)  # of each row, the lane that goes there
        out[np.arange(n), source] = lane * per + combine_loads(cube[np.arange(n), source])
    return out.reshape(n, bins)


def allocate(loads: np.ndarray, shares: list[float]) -> np.ndarray:
    """Split of each whole bin. loads: rows of each bin, by stratum (bins x strata).

    Whole lanes first, the largest to the split that lacks most of its target. If that leaves a split more than
    TOLERANCE of all rows from its target, as a group larger than a lane does, the best move of one bin to another
    split, or exchange of two, is made again and again as long as strata and total come nearer to their targets.
    """
    loads = loads.reshape(len(loads), -1).astype(float)
    bins, of = len(loads), loads.sum(0)
    lanes = _lanes(bins)
    want = of.sum() * np.asarray(shares, float)
    out = np.zeros(bins, dtype=np.int64)
    sums = loads.sum(1).reshape(lanes, -1).sum(1)
    for k in np.argsort(-sums, kind="stable"):
        split = int(np.argmax(want))
        want[split] -= sums[k]
        out.reshape(lanes, -1)[k] = split
    if np.abs(want).max() <= TOLERANCE * of.sum():
        return out
    # each stratum counts by its size, the total ten times
    whole = np.hstack([loads / np.sqrt(np.maximum(of, 1)), 10 * loads.sum(1, keepdims=True) / np.sqrt(max(of.sum(), 1))])
    over = np.stack([whole[out == k].sum(0) for k in range(len(shares))]) - np.outer(shares, whole.sum(0))
    square = (whole * whole).sum(1)
    apart = square[:, None] + square[None] - 2 * whole @ whole.T
    for _ in range(10 * bins):
        each = whole @ over.T
        own, other = each[np.arange(bins), out], each[:, out]
        move = 2 * (each - own[:, None]) + 2 * square[:, None]
        move[np.arange(bins), out] = 0
        swap = 2 * (other - own[:, None] + other.T - own[None, :]) + 2 * apart
        swap[out[:, None] == out[None]] = 0
        i, j = np.unravel_index(np.argmin(swap), swap.shape)
        k, split = np.unravel_index(np.argmin(move), move.shape)
        if min(swap[i, j], move[k, split]) >= -1e-9:
            break
        if move[k, split] < swap[i, j]:
            over[out[k]] -= whole[k]
            over[split] += whole[k]
            out[k] = split
        else:
            d = whole[j] - whole[i]
            over[out[i]] += d
            over[out[j]] -= d
            out[i], out[j] = out[j], out[i]
    return out


def kind_key(vulnerability_type, label):
    """Letters and digits of the type in lower case, then the label: equal for two rows only if both are. Nulls are kinds of their own."""
    name = F.regexp_replace(F.lower(F.coalesce(F.trim(vulnerability_type), F.lit(""))), r"[^\p{L}\p{N}]+", "")
    return F.concat(name, F.lit("\u0001"), F.coalesce(F.col(label).cast("string"), F.lit("")))


def strata(groups: DataFrame, least: int = STRATUM_GROUPS) -> DataFrame:
    """(kind, n_groups, stratum, chunks): the stratum of each kind of groups, and into how many chunks it is cut.

    A kind of at least `least` groups is a stratum of its own, however many there are. Kinds of fewer groups are pooled by label, and labels whose pool is still smaller in one rest.
    """
    label = F.substring_index("kind", "\u0001", -1)
    kinds = settle(groups.groupBy("kind").agg(F.count("*").alias("n_groups")).withColumn("label", label))
    pools = kinds.where(F.col("n_groups") < least).groupBy("label").agg(F.sum("n_groups").alias("pooled"))
    pools = pools.select("label", F.when(F.col("pooled") >= least, F.concat(F.lit("\u0002"), "label")).otherwise(F.lit("\u0003")).alias("pool"))
    named = kinds.join(pools, "label", "left").select("kind", "n_groups", F.when(F.col("n_groups") >= least, F.col("kind")).otherwise(F.col("pool")).alias("stratum"))
    sizes = named.groupBy("stratum").agg(F.ceil(F.sum("n_groups") / GROUPS_A_CHUNK).cast("int").alias("chunks"))
    return named.join(sizes, "stratum").select("kind", "n_groups", "stratum", "chunks")


def place(loads: DataFrame, shares: dict[str, float], bins: int) -> DataFrame:
    """(stratum, chunk, bin, split) for (stratum, chunk, bin, n): bins are combined into `bins` whole ones, those allocated.

    A task combines about TUPLES_A_TASK partial solutions; if there are more, what the tasks make is combined again.
    """
    names, parts = list(shares), list(shares.values())

    def combined(pdf):
        tuples = pdf.pivot_table(index=["stratum", "chunk"], columns="bin", values="n", aggfunc="sum", fill_value=0).reindex(columns=range(bins), fill_value=0).sort_index()
        return tuples, combine_in_lanes(tuples.to_numpy())

    def rows(tuples, **columns):
        import pandas as pd

        s, c = (np.repeat(tuples.index.get_level_values(i).to_numpy(), bins) for i in (0, 1))
        return pd.DataFrame({"stratum": s, "chunk": c, "bin": np.tile(np.arange(bins), len(tuples)), **columns})

    def last(pdf):
        tuples, to = combined(pdf)
        kinds = tuples.index.get_level_values(0).to_numpy()
        at = {k: i for i, k in enumerate(np.unique(kinds))}
        final = np.zeros((bins, len(at)))
        for kind, row, t in zip(kinds, tuples.to_numpy(), to):
            np.add.at(final[:, at[kind]], t, row)
        split = allocate(final, parts)
        return rows(tuples, split=[names[s] for s in split[to.ravel()]])

    def some(key, pdf):
        tuples, to = combined(pdf)
        return rows(tuples, n=tuples.to_numpy().ravel(), batch=key[0], to=to.ravel())

    batches = -(-loads.select("stratum", "chunk").distinct().count() // TUPLES_A_TASK)
    if batches <= 1:
        return loads.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(last, "stratum string, chunk int, bin int, split string")
    batch = F.pmod(F.xxhash64("stratum", "chunk"), F.lit(batches)).cast("int")
    part = settle(loads.withColumn("batch", batch).groupBy("batch").applyInPandas(some, "stratum string, chunk int, bin int, n long, batch int, to int"))
    upper = part.groupBy(F.lit("").alias("stratum"), F.col("batch").alias("chunk"), F.col("to").alias("bin")).agg(F.sum("n").alias("n"))
    above = place(settle(upper), shares, bins).select(F.col("chunk").alias("batch"), F.col("bin").alias("to"), "split")
    return part.join(above, ["batch", "to"]).select("stratum", "chunk", "bin", "split")


def split_groups(samples: DataFrame, shares: dict[str, float] | None = None, bins: int = BINS) -> DataFrame:
    """(sample_id, group_id, split): related rows share a split, splits have nearly their shares.

    Rows without a package are groups of one. Groups are spread by kind (vulnerability_type and label of most of
    their rows) so that each bin gets its part of each: every kind of at least STRATUM_GROUPS groups by itself, the
    others pooled, see `strata`. Groups are dealt into bins per chunk of about GROUPS_A_CHUNK groups of a stratum; the
    bins of all chunks and strata are combined by `place`. Empty input gives no rows.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    rel = related_groups(samples)
    rows = samples.select(F.col("sample_id").alias("sid"), kind_key("vulnerability_type", "label").alias("kind"))
    joined = settle(rows.join(rel.select(F.col("sample_id").alias("rid"), "group_id").distinct(), F.col("sid") == F.col("rid"), "left").select(F.col("sid").alias("sample_id"), F.coalesce("group_id", "sid").alias("group_id"), "kind"))
    per = joined.groupBy("group_id", "kind").count()
    groups = per.groupBy("group_id").agg(F.sum("count").alias("n"), F.max_by("kind", F.struct("count", "kind")).alias("kind"))
    groups = settle(groups)

    def deal(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["n", "group_id"], ascending=[False, True])
        return pd.DataFrame({"group_id": pdf["group_id"].to_numpy(), "n": pdf["n"].to_numpy(), "stratum": key[0], "chunk": key[1], "bin": difference_in_lanes(pdf["n"].to_numpy(dtype=float), bins)})

    in_stratum = skew_safe_lookup(groups, settle(strata(groups)), "kind", "n_groups", groups.count())
    chunk = F.pmod(F.xxhash64("group_id"), F.col("chunks")).cast("int")
    dealt = settle(in_stratum.select("group_id", "n", "stratum", chunk.alias("chunk")).groupBy("stratum", "chunk").applyInPandas(deal, "group_id long, n long, stratum string, chunk int, bin int"))
    plan = place(dealt.groupBy("stratum", "chunk", "bin").agg(F.sum("n").alias("n")), shares, bins)
    # groups grow with the rows: small as they may look in a file, they are not broadcast
    placed = settle(dealt.hint("merge").join(plan, ["stratum", "chunk", "bin"]).select("group_id", "split", "n"))
    return skew_safe_lookup(joined.select("sample_id", "group_id"), placed.hint("merge"), "group_id", "n", joined.count()).select("sample_id", "group_id", "split")


def split_report(samples: DataFrame, shares: dict[str, float] | None = None, bins: int = BINS) -> DataFrame:
    """(split, vulnerability_type, label, rows, pct): rows of each kind and split, and their share of the kind; nulls in type and label are all rows of the rest.

    vulnerability_type is the letters and digits of the type, '' where it is null; label as text, '' where null.
    """
    kind = kind_key("vulnerability_type", "label")
    rows = samples.select(F.col("sample_id").alias("sid"), F.substring_index(kind, "\u0001", 1).alias("vulnerability_type"), F.substring_index(kind, "\u0001", -1).alias("label"))
    placed = split_groups(samples, shares, bins).select("sample_id", "split")
    counts = settle(rows.join(placed, F.col("sid") == F.col("sample_id")).groupBy("split", "vulnerability_type", "label").agg(F.count("*").alias("rows")))
    null = F.lit(None).cast("string")
    every = counts.unionByName(counts.groupBy("split", "label").agg(F.sum("rows").alias("rows")).withColumn("vulnerability_type", null)).unionByName(counts.groupBy("split").agg(F.sum("rows").alias("rows")).withColumns({"vulnerability_type": null, "label": null}))
    of = every.groupBy("vulnerability_type", "label").agg(F.sum("rows").alias("of")).withColumnsRenamed({"vulnerability_type": "t", "label": "l"})
    return every.join(of, every["vulnerability_type"].eqNullSafe(of["t"]) & every["label"].eqNullSafe(of["l"])).select("split", "vulnerability_type", "label", "rows", F.round(100 * F.col("rows") / F.col("of"), 3).alias("pct"))
