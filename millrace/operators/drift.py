"""Schemas that drift between files: a catalogue of field lifespans, a log of changes, one consistent table.

Each file gives, per field path, the type its values have. Files of a producer are numbered by export time. A field
of one type lives in islands of successive files: `lag` finds where an island starts, `lead` where it ends. A start
and an end of one path at the same file is a change of type; an end and a start of two paths whose values agree in
the records both files share is a renaming; the rest are removals and additions. Renamings link lifespans of one
producer to chains; the alias table gives each chain its column in the common table, and the kinds of all its values,
and what text they hold, the cast of that column.

JSON is read in Python: the last of repeated keys counts, and 1.0 is a decimal, which the built-in variant type does
not keep apart. The catalogue is one pass over all lines, renamings read the files around a change again, and the
common table is one more pass.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import settle

_KINDS = {str: "string", int: "integer", float: "decimal", bool: "boolean", list: "array"}


def _refuse(text):
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_constant=_refuse)


def parse(text: str | None):
    """A strict JSON object, or None: NaN and Infinity, other values and nesting beyond the parser's depth are refused."""
    try:
        got = _DECODER.decode(text) if text else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def fields(obj: dict) -> list:
    """(path, value) of every value that is neither an object nor null; of a repeated key the last."""
    out = [(k, v) for k, v in obj.items() if v is not None and v.__class__ is not dict]
    stack = [(k + ".", v) for k, v in obj.items() if v.__class__ is dict]
    while stack:
        prefix, o = stack.pop()
        for k, v in o.items():
            if v.__class__ is dict:
                stack.append((prefix + k + ".", v))
            elif v is not None:
                out.append((prefix + k, v))
    return out


def _digest(v) -> int:
    return int.from_bytes(hashlib.blake2b(json.dumps(v, sort_keys=True).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


_INT_TEXT = re.compile(r"\s*[+-]?\d{1,18}\s*")
_DECIMAL_TEXT = re.compile(r"\s*[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d{1,3})?\s*")
_TRUTH = {"true": True, "false": False}


def text_kind(v: str) -> int:
    """What a text can be cast to: 1 integer, 2 decimal, 3 boolean, 0 nothing."""
    if len(v) > 40 or not v:
        return 0
    return 1 if _INT_TEXT.fullmatch(v) else 2 if _DECIMAL_TEXT.fullmatch(v) else 3 if v.strip().lower() in _TRUTH else 0


def _paths(batches):
    for b in batches:
        seen: dict = {}
        for f, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            o = parse(payload)
            if o is not None:
                for p, v in fields(o):
                    key = (f, p, _KINDS[type(v)])
                    row = seen.get(key)
                    if row is None:
                        row = seen[key] = [0, 0, 0, 0]
                    row[text_kind(v) if type(v) is str else 0] += 1
        ints = [pa.array([r[i] for r in seen.values()], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1].encode("utf-8", "replace").decode() for k in seen], pa.string()), pa.array([k[2] for k in seen], pa.string()), *ints], ["file_id", "path", "kind", "other", "ints", "decimals", "truths"])


def _values(batches):
    """Values of the wanted paths of each line."""
    for b in batches:
        out = []
        for f, payload, wanted in zip(*(b.column(i).to_pylist() for i in range(3))):
            o = parse(payload)
            if o is None or not isinstance(o.get("id"), str):
                continue
            wanted = set(wanted)
            out.extend((f, o["id"], p, _digest(v)) for p, v in fields(o) if p in wanted)
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["file_id", "rid", "path", "v"])


def _match(batches):
    """Of each file's pairs the best, then the best of what both sides still have, until no pair is left."""
    for b in batches:
        out = []
        for feed, ord_, pairs in zip(*(b.column(i).to_pylist() for i in range(3))):
            olds, news = set(), set()
            for p in sorted(pairs, key=lambda p: (-p["n"], -p["same"], p["old"], p["new"])):
                if p["old"] not in olds and p["new"] not in news:
                    olds.add(p["old"])
                    news.add(p["new"])
                    out.append((feed, ord_, p["old"], p["new"]))
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], ["feed", "ord", "old", "new"])


def catalogue(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files: feed, file_id, ord), (fields: feed, file_id, ord, path, kind, and how many texts could be cast to what).

    A field whose values in one file are integers and decimals is a decimal; of any other mixture the kind is all of
    them, joined by a bar.
    """
    files = lines.groupBy("feed", "file_id").agg(F.min("exported_at").alias("at")).withColumn("ord", F.row_number().over(W.partitionBy("feed").orderBy("at", "file_id"))).drop("at")
    files = settle(files)
    got = lines.select(F.col("file_id").cast("long").alias("file_id"), "payload").mapInArrow(_paths, "file_id long, path string, kind string, other long, ints long, decimals long, truths long")
    kinds = F.array_sort(F.collect_set("kind"))
    texts = [F.sum(F.when(F.col("kind") == "string", F.col(c)).otherwise(0)).alias(c) for c in ("other", "ints", "decimals", "truths")]
    per = got.groupBy("file_id", "path").agg(kinds.alias("k"), *texts)
    per = per.withColumn("k", F.when(F.array_contains("k", "decimal"), F.array_remove("k", "integer")).otherwise(F.col("k"))).withColumn("kind", F.array_join("k", "|"))
    return files, settle(per.join(files, "file_id").select("feed", "file_id", "ord", "path", "kind", "other", "ints", "decimals", "truths"))


def lifespans(catalog: DataFrame) -> DataFrame:
    """(feed, path, kind, first_ord, last_ord): the islands of successive files in which a path has one kind."""
    w = W.partitionBy("feed", "path", "kind").orderBy("ord")
    marked = catalog.select("feed", "path", "kind", "ord").withColumn("start", F.coalesce(F.col("ord") - F.lag("ord").over(w) != 1, F.lit(True)).cast("int"))
    isles = marked.withColumn("isle", F.sum("start").over(w))
    return isles.groupBy("feed", "path", "kind", "isle").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")).drop("isle")


def changes(lines: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(feed, file_id, ord, change_kind, field_path, new_path, old_kind, new_kind) of every change between successive files.

    For a renaming field_path is the old path and new_path the new one; for the rest new_path is null. A path is
    renamed if at least one shared record has both values and all that have both agree; if several paths fit, the
    pair with most such records wins, then the one with the same last name, then the first by name, each path once;
    so on with the paths that are left, until none fit. One task holds the fitting pairs of one file.
    Lines that are no JSON object, and null payloads, are ignored; lines without a string id take no part in
    renaming. A file without any valid line has no fields. No lines give no rows. known: the catalogue, if it is there.
    """
    files, cat = known or catalogue(lines)
    last = files.groupBy("feed").agg(F.max("ord").alias("n_files"))
    isles = lifespans(cat)
    starts = isles.where("first_ord > 1").select("feed", F.col("first_ord").alias("ord"), "path", F.col("kind").alias("new_kind"))
    ends = isles.join(last, "feed").where("last_ord < n_files").select("feed", (F.col("last_ord") + 1).alias("ord"), "path", F.col("kind").alias("old_kind"))
    log = settle(ends.join(starts, ["feed", "ord", "path"], "full"))
    gone, new = log.where("new_kind is null"), log.where("old_kind is null")
    # values of what came and went, where both happened at one file
    both = gone.select("feed", "ord").distinct().join(new.select("feed", "ord").distinct(), ["feed", "ord"])
    want = gone.join(both, ["feed", "ord"], "left_semi").select("feed", (F.col("ord") - 1).alias("at"), "path").union(new.join(both, ["feed", "ord"], "left_semi").select("feed", F.col("ord").alias("at"), "path"))
    per_file = want.groupBy("feed", "at").agg(F.collect_set("path").alias("paths")).join(files.withColumnRenamed("ord", "at"), ["feed", "at"]).select("file_id", "paths")
    vals = settle(lines.select("file_id", "payload").join(per_file, "file_id").select(F.col("file_id").cast("long").alias("file_id"), "payload", "paths").mapInArrow(_values, "file_id long, rid string, path string, v long").distinct().join(files, "file_id"))
    old_v = vals.select("feed", (F.col("ord") + 1).alias("ord"), "rid", F.col("path").alias("old"), F.col("v").alias("v0")).join(gone.select("feed", "ord", F.col("path").alias("old")), ["feed", "ord", "old"], "left_semi")
    new_v = vals.select("feed", "ord", "rid", F.col("path").alias("new"), F.col("v").alias("v1")).join(new.select("feed", "ord", F.col("path").alias("new")), ["feed", "ord", "new"], "left_semi")
    pairs = old_v.join(new_v, ["feed", "ord", "rid"]).groupBy("feed", "ord", "old", "new", "rid").agg(F.max((F.col("v0") == F.col("v1")).cast("int")).alias("eq")).groupBy("feed", "ord", "old", "new").agg(F.count("*").alias("n"), F.sum("eq").alias("eq")).where("n = eq")
    leaf = lambda c: F.element_at(F.split(c, r"\."), -1)
    ranked = pairs.withColumn("same", (leaf("old") == leaf("new")).cast("int")).groupBy("feed", "ord").agg(F.collect_list(F.struct("n", "same", "old", "new")).alias("pairs"))
    renamed = settle(ranked.mapInArrow(_match, "feed string, ord int, old string, new string"))
    r_old, r_new = renamed.select("feed", "ord", F.col("old").alias("path"), "new"), renamed.select("feed", "ord", F.col("new").alias("path"))
    out = log.join(r_new, ["feed", "ord", "path"], "left_anti").join(r_old, ["feed", "ord", "path"], "left")
    kind = F.when(F.col("new").isNotNull(), "renamed").when(F.col("old_kind").isNull(), "added").when(F.col("new_kind").isNull(), "removed").otherwise("retyped")
    return out.join(files, ["feed", "ord"]).select("feed", "file_id", "ord", kind.alias("change_kind"), F.col("path").alias("field_path"), F.col("new").alias("new_path"), "old_kind", "new_kind")


def found_changes(lines: DataFrame) -> DataFrame:
    return changes(lines).select("file_id", "field_path", "change_kind")


#: A field list is a schema, held by the driver like any schema; more columns are refused.
MAX_COLUMNS = 10_000


def _named(log: DataFrame, cat: DataFrame) -> dict[str, str]:
    """Common name of each path that some producer renames: of the paths so linked, the one that most files have."""
    links = log.where("change_kind = 'renamed'").select("field_path", "new_path").distinct().limit(MAX_COLUMNS + 1).collect()
    if len(links) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} renamings")
    parent: dict[str, str] = {}

    def root(p):
        parent.setdefault(p, p)
        while parent[p] != p:
            p = parent[p]
        return p

    for r in links:
        parent[root(r[0])] = root(r[1])
    uses = {r[0]: r[1] for r in cat.where(F.col("path").isin(list(parent))).groupBy("path").count().collect()}
    best: dict[str, str] = {}
    for p in sorted(parent, key=lambda p: (-uses.get(p, 0), p)):
        best.setdefault(root(p), p)
    return {p: best[root(p)] for p in parent}


def alias_table(log: DataFrame, cat: DataFrame) -> DataFrame:
    """(feed, path, first_ord, last_ord, column): the column of each lifespan of a path, whatever its kind.

    Lifespans of one producer that renamings link are one chain and share a column, whose name is the common name of
    the chain's most frequent path. Two chains of a producer that live at one time never share a column: the one with
    fewer files keeps its own path's name, with a number if that is taken too. One task holds the lifespans of one
    producer.
    """
    common = _named(log, cat)
    isles = lifespans(cat.withColumn("kind", F.lit(""))).select("feed", "path", "first_ord", "last_ord", F.lit(None).cast("string").alias("new"))
    links = log.where("change_kind = 'renamed'").select("feed", F.col("field_path").alias("path"), F.col("ord").alias("first_ord"), F.col("ord").alias("last_ord"), F.col("new_path").alias("new"))

    def chains(key, pdf):
        import pandas as pd

        spans = [(r.path, int(r.first_ord), int(r.last_ord)) for r in pdf[pdf["new"].isna()].itertuples()]
        ending, starting = {(p, b): i for i, (p, a, b) in enumerate(spans)}, {(p, a): i for i, (p, a, b) in enumerate(spans)}
        chain = list(range(len(spans)))

        def root(i):
            while chain[i] != i:
                chain[i] = chain[chain[i]]
                i = chain[i]
            return i

        for r in pdf[pdf["new"].notna()].itertuples():
            old, new = ending.get((r.path, int(r.first_ord) - 1)), starting.get((r.new, int(r.first_ord)))
            if old is not None and new is not None:
                chain[root(new)] = root(old)
        members: dict[int, list[int]] = {}
        for i in range(len(spans)):
            members.setdefault(root(i), []).append(i)
        length = lambda i: spans[i][2] - spans[i][1] + 1
        taken: dict[str, list[tuple[int, int]]] = {}
        out = []
        for group in sorted(members.values(), key=lambda g: (-sum(map(length, g)), spans[g[0]])):
            of: dict[str, int] = {}
            for i in group:
                of[spans[i][0]] = of.get(spans[i][0], 0) + length(i)
            own = min(of, key=lambda p: (-of[p], p))
            free = lambda name: all(spans[i][2] < a or b < spans[i][1] for i in group for a, b in taken.get(name, ()))
            name, k = common.get(own, own), 2
            if not free(name):
                name = own
            while not free(name):
                name, k = f"{own}_{k}", k + 1
            taken.setdefault(name, []).extend(spans[i][1:] for i in group)
            out += [(key[0], *spans[i], name) for i in group]
        return pd.DataFrame(out, columns=["feed", "path", "first_ord", "last_ord", "column"])

    return settle(isles.union(links.select(isles.columns)).groupBy("feed").applyInPandas(chains, "feed string, path string, first_ord int, last_ord int, column string"))


#: A column is cast to a kind that is not text if at least this share of its texts can be.
CAST_SHARE = 0.5


def column_kind(kinds: set[str], other: int, ints: int, decimals: int, truths: int) -> str:
    """The kind that values of several kinds are cast to, given how many of the texts are numbers or truth values."""
    if "array" in kinds:
        return "array"
    texts = other + ints + decimals + truths
    if "decimal" in kinds or ("integer" in kinds and decimals):
        kind, fit = "decimal", ints + decimals + truths
    elif "integer" in kinds:
        kind, fit = "integer", ints + truths
    elif "boolean" in kinds:
        kind, fit = "boolean", truths
    else:
        return "string"
    return kind if fit >= CAST_SHARE * texts else "string"


def fit(v, kind: str):
    """A JSON value cast to a column's kind, None if it cannot be: truth values are 1 and 0 as numbers, one value is an array of one."""
    if kind == "string":
        return v if isinstance(v, str) else json.dumps(v)
    if kind == "array":
        return [None if x is None else x if isinstance(x, str) else json.dumps(x) for x in (v if isinstance(v, list) else [v])]
    if isinstance(v, list):
        return None
    if isinstance(v, str):
        said = text_kind(v)
        if said == 0:
            return None
        v = _TRUTH[v.strip().lower()] if said == 3 else int(v) if said == 1 else float(v)
    if kind == "boolean":
        return v if isinstance(v, bool) else None
    if kind == "integer":
        return int(v) if not isinstance(v, float) and -(1 << 63) <= v < 1 << 63 else None
    try:
        return float(v)
    except OverflowError:
        return None


def columns_of(cat: DataFrame, aliases: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(file_id, path, column of every field of every file), {column: kind}."""
    on = (cat["feed"].eqNullSafe(aliases["feed"])) & (cat["path"] == aliases["path"]) & (cat["ord"] >= aliases["first_ord"]) & (cat["ord"] <= aliases["last_ord"])
    each = cat.join(aliases, on).select(cat["file_id"], cat["path"], "column", "kind", "other", "ints", "decimals", "truths")
    found = each.groupBy("column").agg(F.array_distinct(F.flatten(F.collect_set(F.split("kind", r"\|")))).alias("k"), *(F.sum(c).alias(c) for c in ("other", "ints", "decimals", "truths"))).limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    return each.select("file_id", "path", "column"), {r["column"]: column_kind(set(r["k"]), *(r[c] for c in ("other", "ints", "decimals", "truths"))) for r in found}


_SQL = {"string": "string", "integer": "long", "decimal": "double", "boolean": "boolean", "array": "array<string>"}
REST = "unfit_values"
#: Aliases of all files that are broadcast, about 10 MB; with more, lines and aliases are shuffled by file.
BROADCAST_ENTRIES = 100_000


def unified(lines: DataFrame) -> DataFrame:
    """One table of all valid lines: file_id, line_no, a column for each chain of the alias table (dots as __), and unfit_values.

    Kinds that differ are cast, see `column_kind` and `fit`. A value that its column cannot hold, as it is no number or
    beyond the column's range, is null there and stands in unfit_values, a map from path to JSON text; so no value is
    lost. Lines that are no JSON object are left out.
    """
    known = catalogue(lines)
    log = settle(changes(lines, known))
    each, kinds = columns_of(known[1], alias_table(log, known[1]))
    cols = sorted(kinds)
    names = [c.replace(".", "__") for c in cols]
    seen: set[str] = {"file_id", "line_no", REST}
    for i, n in enumerate(names):
        while n.lower() in seen:
            n += "_"
        seen.add(n.lower())
        names[i] = n
    renamed = settle(each.where("path <> column").groupBy("file_id").agg(F.map_from_entries(F.collect_set(F.struct("path", "column"))).alias("aliases")))
    entries = renamed.agg(F.sum(F.size("aliases"))).first()[0] or 0
    if entries <= BROADCAST_ENTRIES:
        renamed = F.broadcast(renamed)
    kind_of = {"string": pa.string(), "integer": pa.int64(), "decimal": pa.float64(), "boolean": pa.bool_(), "array": pa.list_(pa.string())}

    def build(batches):
        for b in batches:
            ids, nos, rests, data = [], [], [], {c: [] for c in cols}
            for f, n, payload, aliases in zip(*(b.column(i).to_pylist() for i in range(4))):
                o = parse(payload)
                if o is None:
                    continue
                alias = dict(aliases or ())
                row: dict = {}
                rest = []
                for p, v in fields(o):
                    c = alias.get(p, p)
                    got = fit(v, kinds[c]) if c in kinds and c not in row else None
                    if got is None:
                        rest.append((p, json.dumps(v)))
                    else:
                        row[c] = got
                ids.append(f)
                nos.append(n)
                rests.append(dict(rest).items() if rest else None)
                for c in cols:
                    data[c].append(row.get(c))
            rest_type = pa.map_(pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), *(pa.array(data[c], kind_of[kinds[c]]) for c in cols), pa.array([None if r is None else list(r) for r in rests], rest_type)], ["file_id", "line_no", *names, REST])

    schema = T.StructType([T.StructField("file_id", T.LongType()), T.StructField("line_no", T.IntegerType()), *(T.StructField(n, T._parse_datatype_string(_SQL[kinds[c]])) for n, c in zip(names, cols)), T.StructField(REST, T.MapType(T.StringType(), T.StringType()))])
    rows = lines.select(F.col("file_id").cast("long").alias("file_id"), F.col("line_no").cast("int").alias("line_no"), "payload")
    return rows.join(renamed, "file_id", "left").select("file_id", "line_no", "payload", "aliases").mapInArrow(build, schema)


def unfit_report(table: DataFrame) -> DataFrame:
    """(field_path, values, lines) of the values of `unified` that no column could hold."""
    return table.where(F.col(REST).isNotNull()).select("file_id", "line_no", F.explode(REST).alias("field_path", "value")).groupBy("field_path").agg(F.count_distinct("value").alias("values"), F.count("*").alias("lines"))
