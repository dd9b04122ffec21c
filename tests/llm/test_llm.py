"""Problem operators against brute force on small fixtures, edges included."""

import ast
import collections
import datetime
import functools
import glob
import itertools
import json
import os
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import canonical, grouping, leakage, mixing, overlap, packing, queries, sentences, unparsable
from millrace.llm.syntax import tokens
from millrace.llm.syntax.gll import EOF, Grammar

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
quick = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
AT = datetime.datetime(2031, 1, 1)


# ---- all queries against SQL ----------------------------------------------------------------------------------------
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(str(v) for _, v in sorted(zip(names, r))) for r in got.fetchall()) == rows


# ---- 1: mixes -------------------------------------------------------------------------------------------------------
@quick
@given(st.lists(st.integers(1, 40), min_size=1, max_size=7))
def test_schedule_keeps_every_prefix_within_a_block(weights):
    w = {f"s{i}": x for i, x in enumerate(weights)}
    order = mixing.schedule(w)
    total, got = sum(weights), dict.fromkeys(w, 0)
    for t, s in enumerate(order, 1):
        got[s] += 1
        assert all(abs(got[k] * total - w[k] * t) < total for k in w)
    assert got == w


TARGETS = "collector string, source string, target_pct int, max_repeats int"


def test_mix(spark):
    rows = [(i, "A" if i < 80 else " b ", "noise") for i in range(100)] + [(i, None, "x") for i in range(100, 105)]
    df = spark.createDataFrame(rows, "sample_id long, source string, rank string").withColumn("slot", F.lit(1))
    t = spark.createDataFrame([("a", "a", 50, 1), ("b", "b", 50, 2), ("c", "c", 0, 3)], TARGETS)
    m = mixing.mix(df, t).collect()
    slots = [r["slot"] for r in m]
    assert len(set(slots)) == len(slots) and max(slots) < 100
    per = {s: [r for r in m if r["source"] == s] for s in "ab"}
    assert len(per["a"]) == 50 and len(per["b"]) == 40  # 20 records, twice each
    assert max(r["repeat"] for r in per["b"]) == 2 and len({r["sample_id"] for r in per["b"]}) == 20
    assert len({r["sample_id"] for r in per["a"]}) == 50
    rep = {r["source"]: r for r in mixing.mix_report(df, t).collect()}
    assert (rep["b"]["blocks"], rep["b"]["records"], rep["c"]["blocks"]) == (40, 20, 0)
    with pytest.raises(ValueError):
        mixing.read_targets(t.union(t.selectExpr(*(f"upper({c}) as {c}" if c == "source" else c for c in t.columns))))
    assert mixing.mix(df.limit(0), t).count() == 0 and mixing.mix(df, t.limit(0)).count() == 0


def test_short_sources(spark):
    c = "struct<collector:string,status:string,message:string,samples_collected:bigint,target_samples:bigint,duration:double,timestamp:string,success:boolean,error:string>"
    v = lambda n: (None, None, None, n, None, None, None, None, None)
    day = lambda d: AT + datetime.timedelta(days=d)
    rows = [(1, {" GitHub": v(10), "osv": v(90)}, day(2)), (1, {"github": v(90)}, day(1)), (2, {"github": v(None), "osv": v(4)}, day(1)), (3, None, day(1)), (4, {}, day(1)), (5, {"github": v(30), "other": v(70)}, day(1)), (5, {"github": v(30), "other": v(70)}, day(1))]
    df = spark.createDataFrame(rows, f"run_id long, collectors map<string,{c}>, written_at timestamp_ntz")
    t = spark.createDataFrame([("github", "ga", 30, 3), ("osv", "osv", 70, 1)], TARGETS)
    got = sorted(tuple(r) for r in mixing.short_sources(df, t).collect())
    assert got == [(2, "ga"), (5, "osv")]  # run 1: 30 of 100 is just reached by 3 x 10
    assert mixing.short_sources(df.limit(0), t).count() == 0


# ---- 3: groups and splits -------------------------------------------------------------------------------------------
SAMPLES = "sample_id long, metadata struct<package_name:string,ecosystem:string>, label int, vulnerability_type string"


def grouped(spark, rows):
    return spark.createDataFrame([(i, (p, e), i % 2, "xss") for i, p, e in rows], SAMPLES)


def test_groups(spark):
    df = grouped(spark, [(4, "a-b", "NPM"), (2, "A_B; c", "npm"), (9, "c|d", "npm"), (7, "d", None), (8, " ", "npm"), (5, None, "npm"), (6, "d", "npm"), (3, "é.1", "pip"), (1, "É1\n--", "PIP"), (11, ";,|", "pip"), (12, "lone", "go")])
    assert sorted(tuple(r) for r in grouping.found_groups(df).collect()) == [(1, 1), (2, 2), (3, 1), (4, 2), (6, 2), (9, 2)]
    assert grouping.found_groups(df.limit(0)).count() == 0
    assert grouping.split_groups(df.limit(0)).count() == 0


@quick
@given(st.lists(st.lists(st.integers(0, 12), max_size=3), max_size=30))
def test_groups_by_brute_force(spark, names):
    rows = [(i, ",".join(f"p{x}" for x in xs), "npm") for i, xs in enumerate(names)]
    left = [(i, {f"p{x}" for x in xs}) for i, xs in enumerate(names) if xs]
    groups = []
    for i, s in left:
        hit = [g for g in groups if g[1] & s]
        groups = [g for g in groups if not g[1] & s] + [(sum((g[0] for g in hit), [i]), set().union(s, *(g[1] for g in hit)))]
    want = sorted((i, min(g[0])) for g in groups if len(g[0]) > 1 for i in g[0])
    assert sorted(tuple(r) for r in grouping.found_groups(grouped(spark, rows)).collect()) == want


def test_splits(spark):
    rng = random.Random(1)
    df = grouped(spark, [(i, f"pkg{min(int(rng.paretovariate(0.8)), 400)}" if i % 9 else None, "npm") for i in range(3000)])
    s = grouping.split_groups(df)
    assert s.count() == 3000 and s.select("sample_id").distinct().count() == 3000
    assert s.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    share = {r[0]: r[1] / 3000 for r in s.groupBy("split").count().collect()}
    assert abs(share["validation"] - 0.1) < 0.04 and abs(share["test"] - 0.1) < 0.04


def test_splits_by_kind(spark, monkeypatch):
    kinds = [(f"type {i}", i % 2) for i in range(90)]  # more than any fixed number of buckets keeps apart
    sizes = [20 + 7 * (i % 5) for i in range(90)]
    rows = [(v, y) for (v, y), n in zip(kinds, sizes) for _ in range(n)] + [("rare one", 1)] * 3 + [(None, None)] * 40
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(i, (None, None), y, v) for i, (v, y) in enumerate(rows)], SAMPLES)
    for most in (grouping.TUPLES_A_TASK, 7):
        monkeypatch.setattr(grouping, "TUPLES_A_TASK", most)
        s = grouping.split_groups(df).join(df, "sample_id")
        assert s.count() == len(rows)
        for v, y, n, train in s.where("vulnerability_type is null or vulnerability_type <> 'rare one'").groupBy("vulnerability_type", "label").agg(F.count("*"), F.count_if(F.col("split") == "train")).collect():
            assert int(n / 20) * 16 <= train <= -(-n // 20) * 16, (v, y, n, train)


def test_a_large_group_leaves_the_shares(spark):
    """One group has 30 % of all rows; the splits still have their shares, and no group is cut."""
    df = grouped(spark, [(i, "huge" if i % 10 < 3 else f"p{i}", "npm") for i in range(4000)])
    s = grouping.split_groups(df)
    assert s.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    share = {r[0]: r[1] / 4000 for r in s.groupBy("split").count().collect()}
    assert abs(share["validation"] - 0.1) < 0.005 and abs(share["test"] - 0.1) < 0.005
    report = {r["split"]: r["rows"] for r in grouping.split_report(df).where("vulnerability_type is null and label is null").collect()}
    assert report == {k: round(4000 * v) for k, v in share.items()}


def test_strata(spark):
    many = [(f"k{i}\x01{i % 2}", 25 if i < 100 else 3) for i in range(110)] + [("x\x01", 2), ("y\x017", 1)]
    groups = spark.createDataFrame([(k,) for k, n in many for _ in range(n)], "kind string")
    got = {r["kind"]: r["stratum"] for r in grouping.strata(groups, 20).collect()}
    assert len(got) == 112 and all(got[k] == k for k, n in many if n == 25)
    assert {got[k] for k, n in many if n < 25} == {"\x03"}  # 15 groups a label fill no 20 bins
    got = {r["kind"]: r["stratum"] for r in grouping.strata(groups, 10).collect()}
    assert {got[k] for k, n in many if n == 3} == {"\x020", "\x021"} and got["x\x01"] == got["y\x017"] == "\x03"


def test_differencing_beats_a_bad_deal():
    w = np.array([9.0, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1, 1])
    b = grouping.difference(w, 3)
    loads = [w[b == k].sum() for k in range(3)]
    assert max(loads) - min(loads) <= 1
    assert set(grouping.difference(np.ones(10), 5)) == set(range(5))
    to = grouping.combine_loads(np.array([[5.0, 0, 0], [0, 4, 0], [3, 0, 0]]))
    final = np.zeros(3)
    for row, t in zip([[5, 0, 0], [0, 4, 0], [3, 0, 0]], to):
        np.add.at(final, t, row)
    assert sorted(final) == [3, 4, 5]


# ---- 4: overlaps ----------------------------------------------------------------------------------------------------
ROWS = "row_id long, code string, metadata struct<source:string>, id string"


def runs(code):
    w = [x.lower() for x in re.findall(r"[A-Za-z0-9_]+", code or "")]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


@quick
@given(st.integers(0, 10_000))
def test_overlaps_by_brute_force(spark, seed):
    rng = random.Random(seed)
    make = lambda: " ".join(rng.choice(["a", "b", "c", "d;", "E(", "f_1"]) for _ in range(rng.randrange(0, 14)))
    base = [make() for _ in range(8)]
    rows = lambda lo, n: [(lo + i, rng.choice([rng.choice(base), rng.choice(base).upper() + " z", make(), None]), ("s",), "x") for i in range(n)]
    parts = [rows(0, 15), rows(100, 6), rows(200, 6)]
    dfs = [spark.createDataFrame(p, ROWS) for p in parts]
    want = set()
    for a, b in itertools.product(parts[0], parts[1] + parts[2]):
        x, y = runs(a[1]), runs(b[1])
        if x and y and len(x & y) >= 0.6 * len(x | y):
            want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert {tuple(r) for r in overlap.found_overlaps(*dfs).collect()} == want


def test_overlaps_in_parts_and_blocks(spark, monkeypatch):
    """Runs and classes of many rows cut into parts, and the evaluation side taken in blocks, give the same pairs."""
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdef") for _ in range(rng.choice([3, 4, 9, 12]))) for _ in range(12)]
    side = lambda n, at: [(at + i, rng.choice(base) + rng.choice(["", " z", " a b"])) for i in range(n)]
    left, right = side(60, 0), side(25, 1000)
    want = set()
    for i, a in left:
        for j, b in right:
            x, y = runs(a), runs(b)
            if x and y and len(x & y) >= 0.6 * len(x | y) - 1e-9:
                want.add((i, j))
    df = [spark.createDataFrame(x, "id long, code string") for x in (left, right)]
    monkeypatch.setattr(overlap, "ROWS_A_PART", 3)
    assert {(r["left_id"], r["right_id"]) for r in overlap.similar_pairs(*df).collect()} == want
    monkeypatch.setattr(overlap, "RANGE_BITS", overlap.BITS_PER_ROW * 60)
    got = [(r["left_id"], r["right_id"]) for r in overlap.similar_pairs(*df).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 50


def test_overlap_edges(spark):
    empty = spark.createDataFrame([], ROWS)
    one = spark.createDataFrame([(1, "a b", ("s",), "x"), (2, None, None, None), (3, "word " * 5000, ("s",), "x")], ROWS)
    assert overlap.found_overlaps(empty, empty, empty).count() == 0
    assert {tuple(r) for r in overlap.found_overlaps(one, empty, one.withColumn("row_id", F.col("row_id") + 10)).collect()} == {(3, 13)}
    rep = overlap.overlap_report(one, empty, one.withColumn("row_id", F.col("row_id") + 10)).collect()
    assert [(r["split"], r["source"], r["exact"], r["near"], r["leaked_rows"]) for r in rep] == [("test", "s", 1, 0, 1)]


# ---- 5: hidden copies -----------------------------------------------------------------------------------------------
RECORDS = "sample_id long, label int, code string, attrs string, h int, digest string, copies int"


def record_key(r):
    code = "".join(c for c in (r[2] or "").lower() if c.isalnum())
    if r[1] is None or not code:
        return None
    try:
        a = None if r[3] is None else json.dumps(json.loads(r[3]), sort_keys=True)
    except ValueError:
        a = "raw" + r[3]
    return r[1], code, a


@quick
@given(st.lists(st.tuples(st.sampled_from([0, 1, None]), st.sampled_from(["a b", "A-B", "ab;", "c", "", "!!", None, "É1"]), st.sampled_from(['{"x": 1, "y": {"b": 2, "a": "s"}}', '{"y":{"a":"s","b":2},"x":1}', "broken {", None, '{"x":2}', "null"])), max_size=25))
def test_copies_by_brute_force(spark, rows):
    full = [(i * 3 + 1, *r, 1, "d", 9) for i, r in enumerate(rows)]
    want, groups = set(), {}
    for r in full:
        if record_key(r) is not None:
            groups.setdefault(record_key(r), []).append(r[0])
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    df = spark.createDataFrame(full, RECORDS)
    assert {tuple(r) for r in canonical.found_copies(df).collect()} == want
    c = canonical.collapse(df)
    assert c.count() == len(full) - len(want) and (c.agg(F.sum("n_copies")).first()[0] or 0) == len(full)
    assert c.columns == [*df.columns, "n_copies"]


def test_filter_in_ranges_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(canonical, "RANGE_BITS", 1 << 12)
    monkeypatch.setattr(canonical, "SLICE_BITS", 1 << 10)
    monkeypatch.setattr(canonical, "FAN_IN", 2)
    df = spark.range(2000).select(F.col("id").alias("sample_id"), F.lit(1).alias("label"), F.concat(F.lit("c"), F.when(F.col("id") % 3 == 0, F.col("id") % 300).otherwise(F.col("id") + 1000)).alias("code"), F.lit(None).cast("string").alias("attrs")).repartition(7)
    want = df.groupBy("code").count().where("count > 1").agg(F.sum(F.col("count") - 1)).first()[0]
    assert canonical.found_copies(df).count() == want > 500


def test_filter_keeps_most_singles_out(spark):
    df = spark.range(20_000).select(F.col("id").alias("sample_id"), F.xxhash64("id").alias("h"), F.unhex(F.md5(F.col("id").cast("string"))).alias("digest"))
    assert canonical.possible_repeats(df.select("sample_id", "digest", "h"), 20_000).count() < 200


def test_collapse_moves_only_rows_with_copies(spark):
    rows = [(i, f"code {i % 900}", 1, None) for i in range(1000)]
    df = spark.createDataFrame(rows, "sample_id long, code string, label int, attrs string").repartition(4)
    c = canonical.collapse(df)
    assert c.count() == 900 and c.agg(F.sum("n_copies")).first()[0] == 1000
    lines = c._jdf.queryExecution().executedPlan().toString().splitlines()
    union = next(i for i, x in enumerate(lines) if "Union" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :|+-"))
    heads = [i for i in range(union + 1, len(lines)) if depth(lines[i]) == depth(lines[union + 1])]
    alone = "\n".join(lines[heads[0] : heads[1]])
    assert "may_have_copies" in alone and "Exchange hash" not in alone


def test_collapse_of_repeated_ids_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1, None), (1, "A ", 1, None), (2, "b", None, None), (None, "a;", 1, None)], "sample_id long, code string, label int, attrs string").withColumn("n_copies", F.lit("x"))
    got = sorted((r["sample_id"] or 0, r["code"], r["n_copies"]) for r in canonical.collapse(df).collect())
    assert (2, "b", 1) in got and (1, "a", 3) in got
    assert canonical.collapse(df.limit(0)).count() == 0


# ---- 6: files that do not parse -------------------------------------------------------------------------------------
def test_recogniser_handles_ambiguity_and_left_recursion():
    g = Grammar("s = s s | 'a' | e 'b'\ne = [ 'c' ]", ["s"])
    t = lambda text: [((c,), False) for c in text] + [((EOF,), True)]
    assert all(g.accepts(t(x)) for x in ("a", "aaaa", "acb", "b", "abcba")) and not any(g.accepts(t(x)) for x in ("", "c", "ac", "ba c"))


GOOD_PYTHON = [
    "", "# only a comment", "x = 1\n", "match = 3\nmatch(x)\ncase = match\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': A.b(c=_)} | None: pass\n", "async def f(a, /, b=1, *, c: int = 2, **k) -> int:\n    async with a as b, c: await d\n    return [i async for i in x]\n",
    "f'{x!r:>{w}} {y=}'\n", "with (open(a) as f, open(b)): pass\n", "x = lambda *a, **k: (yield)\n", "@d\nclass A[T](B, m=C):\n    x: int\n    def f(self): return {**a, 'b': 1}, {*c}, a[1:2, ::3, ...]\n", "try: a\nexcept* E as e: b\nelse: c\nfinally: d\n", "if (n := 3) > 2: print(n)\nelif x: pass\nelse:\n\tpass\n", "for a, *b in c: d\nelse: e\n", "type X = int\nprint(*a, **b, end='')\n", "x = [a if b else c for d in e if f if g]\nassert x, 'm'; del x[0], y.z\n", "global_ = not a in b is not c\nraise E from None\r\nx = 1\r\n", "from . import (a as b, c,)\nfrom ..d import *\n",
]
BAD_PYTHON = ["x = (1,\n", "def f(:\n    pass\n", "if x\n    y\n", "    x = 1\ny = 2\n", "print 'a'\n", "<<<<<<< a\n", "x = 'abc\n", "f() = 1\n", "return return\n", "class\n", "for x y: pass\n", "a b\n", "def f():\npass\n", "x = 1\0\n", "const a = 1;\n"]
GOOD_JS = [
    "", "#!/usr/bin/env node\nlet a = 1", "const {a, b: [c = 1, ...d]} = e, f = `x${a ? `y${b}` : 'z'}w`;", "return 1;", "a = b\n++c\nif (x) y; else z\ndo w(); while (q) r()", "x = /[/({\"]/.test(y) / 2; if (a) /re/g.exec(b); z = a / b / c", "async (x) => { await x; for await (const y of z) {} }".replace("for await", "for"),
    "(a, {b}, [c] = [], ...d) => ({a, [b]: 1, get c() { return 1 }, async *d() {}, 'e': 2, f(){}})", "class A extends B.C { static x = 1; #p; constructor(a) { super(a); this.#p = a } static { f() } get y() { return this?.z?.[0]?.(1) ?? 2 } async z() { await q } }", "label: for (var i = 0, n = 3; i < n; i++) { if (i) continue label; break }", "for (const k in o) for (x of y) ;\nwhile (1) {}", "switch (a) { case 1: case b + 2: f(); break; default: g() }", "try { a } catch { b } finally { c }\nthrow new Error(`x`)", "let async = 1, of = 2, get = async + of; yield_ = function* () { yield; yield* a }", "a = {\n'=======': 1}\n/* <<<<<<< */ // >>>>>>>\nb = `\n=======\n`", "new Foo; new a.b.C(1)(2); x = y ? z => 1 : w; delete a[b], void 0, typeof c", "if (a) { }\nelse if (b) c\nelse { d }", "import('x').then(f)", "x = a ? {b: 1} : [ , 1, ...c]; y **= 2 ** 3; z ||= 1_000n",
]
BAD_JS = ["function f( {", "let x = ;", "{ 'a': 1, 'b': 2 }", "const a = 1 const b = 2", "if (a { b }", "x = 'abc\n'", "<<<<<<< HEAD\nx()", "=======", "import a from 'b'", "export const a = 1", "int main(void) { return 0; }", "def f():\n  pass", "a = `x", "<div>x</div>", "await x", "for (let i = 0; i < 3) {}", "}", "x = 3a", "var x = {a: 1,, b: 2}", "function (a) {}; +", "a b", "...", "class A { x y }"]
GOOD_C = [
    "", "int main(void) { return 0; }", "typedef struct node { struct node *next; unsigned int x : 3; union { int a; char b[4]; }; } node_t;\nstatic const node_t *f(node_t *restrict p, int a[static 3], ...) { foo_t *q = (foo_t *) p; return (node_t){ .next = q, [2] = { 1 } }.next; }",
    "#include <x.h>\n#ifdef A\nint f(void) {\n#else\nint g(void) {\n#endif\n  return 1;\n}\n", "#if 0\n{ broken ( text\n#endif\nint x;", "#define MAX(a, b) ((a) > (b) ? (a) : (b))\n#define BEGIN {\nint f(int a) BEGIN return MAX(a, 2); }", "#if defined(A) && B > 2\n#error no\n#elif !defined C || 1\nint x = 'a' + L'b' + 0x1fUL + 1.5e-3f;\n#endif", "int f(a, b) int a; char *b; { return a; }", "main() { return 0; }", "void f(void) { for (int i = 0; i < 3; i++) { if (i) continue; else break; } do x--; while (x); switch (y) { case 1: case 2 ... 4: z(); default: ; } goto end; end: return; }",
    "int (*fp)(int, char *), *arr[3][4] = { { 1, 2 }, };\nextern int printf(const char *, ...) __attribute__((format(printf, 1, 2)));", "int f(void) { a * b; t * u = (v) - w; x = sizeof(int) * sizeof y; return ({ int z = 1; z; }); }", "char *s = \"a\\\"b\" \"=======\"; /* <<<<<<< */ // >>>>>>>\nint x \\\n = 1;\r\n", "enum e { A, B = 2, } v; _Static_assert(1, \"x\"); static inline long long g(void);",
]
BAD_C = ["int main(void) { return 0;", "}\nint x;", "x = 1;", "int f( { }", "<<<<<<< HEAD\nint x;", "int x\nint y;", "#if A\nint x;", "#endif", "/* open", "char *s = \"abc;\n", "def f():\n    return 1\n", "const a = () => 1;", "int f(void) { if (x { } }", "int f(void) { return 1 }", "int f(void) { x = ; }", "=======\n", "a b c d;", "int x = 08z;", "# Title\n\ntext here\n", "int f(void) { \" }", "int a[3;"]


@pytest.mark.parametrize("lang,good,bad", [("python", GOOD_PYTHON, BAD_PYTHON), ("javascript", GOOD_JS, BAD_JS), ("c", GOOD_C, BAD_C)])
def test_parses(lang, good, bad):
    assert [x for x in good if not unparsable.parses(x, lang)] == []
    assert [x for x in bad if unparsable.parses(x, lang)] == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_python_grammar_agrees_with_the_interpreter():
    rows = duckdb.sql(f"select vulnerable_code, fixed_code from '{SF}/repo_commits.parquet' where file_path like '%.py'").fetchall()
    rng = random.Random(0)
    for code in [c for r in rows for c in r if c] + [open(f, encoding="utf-8").read() for f in (ast.__file__, json.__file__, re.__file__)]:
        for text in (code, code[: rng.randrange(len(code) + 1)]):
            toks = tokens.python_tokens(text)
            got = toks is not None and unparsable.grammar("python").accepts(toks)
            try:
                ast.parse(tokens.newlines(text))
                assert got
            except SyntaxError as e:
                assert not got or any(x in str(e) for x in ("assign", "delete", "follows", "literal", "escape", "duplicate", "precedence", "parenthes")), text[-200:]


def test_language_as_expression(spark):
    from millrace.functions import constants as K
    from millrace.functions import text as X

    assert (K.SOURCE_LANGUAGES, K.SOURCE_EXTENSIONS) == (unparsable.LANGUAGES, unparsable.EXTENSIONS)
    langs = [None, "", " ", "\u00a0\t", "\x1c", "Python 3", " PY ", "python", "C", "C99", "ANSI C", "C++", "c#", "Node.js", "java", "\u0130"]
    paths = [None, "", "a.py", "a.b/c", "a.b/c.PYW", ".c", "x.", "x/y.h", "x.jsx", "x.cpp"]
    rows = [(a, b) for a in langs for b in paths]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", X.source_language("a", "b").alias("k")).collect()
    assert {(r["a"], r["b"]): r["k"] for r in got} == {x: unparsable.language_of(*x) for x in rows}


def test_language_and_rows(spark):
    names = {"Python 3.11": "python", " PY": "python", "Node.js": "javascript", "C99": "c", "C++": None, "C#": None, "go": None}
    assert {n: unparsable.language_of(n, "x.py") for n in names} == names
    assert [unparsable.language_of(x, p) for x, p in ((None, "a/b.JSX"), ("", "x.h"), (None, "py"), (None, None))] == ["javascript", "c", None, None]
    schema = "row_id long, repository string, language string, file_path string, vulnerable_code string, fixed_code string, invalid int"
    df = spark.createDataFrame([(1, "r", " PY ", "a.js", "x = (", "x = 1", 0), (2, None, None, "b/c.jsx", "let x = ", None, 0), (3, "r", "cobol", "x.py", "((", None, 0), (4, "r", None, None, "((", "", 0), (5, "r", "C", "a.h", "int x;" * 20_000, "int", 0)], schema)
    assert sorted(tuple(r) for r in unparsable.found_unparsable(df).collect()) == [(1, "vulnerable_code"), (2, "vulnerable_code"), (5, "fixed_code")]
    rates = {(r["repository"], r["lang"]): (r["files"], r["invalid_files"]) for r in unparsable.rates(df).collect()}
    assert rates[("unknown", "javascript")] == (1, 1) and rates[("r", "unknown")] == (3, 0)
    assert unparsable.found_unparsable(df.limit(0)).count() == 0


# ---- 7: packing -----------------------------------------------------------------------------------------------------
def test_pack(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "wort " * rng.randrange(0, 60) if i else "x " * 3000) for i in range(300)] + [(900, None), (901, "")], "doc_id long, text string").withColumn("tokens", F.lit(1))
    limits = spark.createDataFrame([("a", 64), ("b", 512), ("none", 0)], "container string, capacity_tokens int")
    p = packing.pack(docs, limits)
    sizes = {r["doc_id"]: r["tokens"] for r in packing.measured(docs, packing.VOCABULARY).collect()}
    for name, cap in (("a", 64), ("b", 512)):
        rows = p.where(F.col("container") == name).collect()
        load: dict = {}
        for r in rows:
            load[r["box"]] = load.get(r["box"], 0) + r["tokens"]
            assert (r["piece"] == 0) or sizes[r["doc_id"]] > cap
        assert max(load.values()) <= cap and sum(load.values()) == sum(sizes.values())
        assert sum(load.values()) / (len(load) * cap) > 0.85
        for d, n in sizes.items():
            mine = sorted((r["start_token"], r["tokens"]) for r in rows if r["doc_id"] == d)
            assert sum(x for _, x in mine) == n and all(a + x == b for (a, x), (b, _) in zip(mine, mine[1:]))
    assert packing.pack(docs.limit(0), limits).count() == 0


def test_hilbert_neighbours_are_one_step_apart():
    grid = np.array(list(itertools.product(range(8), repeat=2)))
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert len(set(packing.hilbert(grid, 3))) == 64 and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# ---- 8: leaks -------------------------------------------------------------------------------------------------------
def test_leaks(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    zh = "镜像先丢弃短帧随后再读缓存又开始改写旧公告调度器会复制空行请立刻停止"
    items = spark.createDataFrame([(1, item, "en"), (2, "too short to leak", "en"), (3, zh, " ZH "), (4, None, None), (5, "", "en")], "item_id long, text string, lang string")
    hit = "x ".join(["noise "] * 3) + "BETA, gamma;\ndelta -- epsilon zeta_eta theta (iota) kappa lambda mu nu. more"
    docs = spark.createDataFrame([(10, hit), (11, hit.replace("kappa", "kapppa")), (12, " ".join(item.split()[:11])), (13, None), (14, ""), (15, "前" + "，".join(zh[3:27]) + "后"), (16, zh[:23]), (17, ("pad " * 70_000) + item + (" pad" * 70_000)), (10, hit)], "doc_id long, text string")
    got = sorted(tuple(r) for r in leakage.found_leaks(docs, items).collect())
    assert got == [(10, 1), (15, 3), (17, 1)]
    assert leakage.found_leaks(docs, items.limit(0)).count() == 0 and leakage.found_leaks(docs.limit(0), items).count() == 0


def test_windows_split_into_chunks(monkeypatch):
    monkeypatch.setattr(leakage, "CHUNK_WORDS", 5)
    ws = [f"w{i}" for i in range(60)]
    ix = leakage.Index([(7, leakage.word_hashes(ws[20:40]), 12)], 1)
    for cut in range(20, 29):
        assert ix.find(leakage.word_hashes(ws[:cut] + ws[20:32])) == {7}
    assert ix.find(leakage.word_hashes(ws[:31])) == set()


def test_blocks_find_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for r in (0, 1, 3):
        flips = np.zeros_like(fp)
        for _ in range(r):
            flips ^= np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
        assert np.any([a == b for a, b in zip(leakage.blocks(fp, r), leakage.blocks(fp ^ flips, r))], axis=0).all()


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_all_windows_within_the_radius_are_candidates(radius):
    rng = np.random.default_rng(radius)
    vocabulary = leakage.word_hashes([f"w{i}" for i in range(40)])
    items = [(i, rng.choice(vocabulary, 30), 12) for i in range(12)]
    doc = rng.choice(vocabulary, 400)
    for i, h, _ in items:
        at = 30 * i
        doc[at : at + 30] = h
        doc[at + 5] = vocabulary[i]
    ix = leakage.Index(items, radius)
    s = ix.spans[12]
    fp = leakage.simhash_windows(doc, 12)
    want = {(d, i) for d in range(len(fp)) for i in range(len(s["fp"])) if bin(int(fp[d]) ^ int(s["fp"][i])).count("1") <= radius}
    assert {(a, b) for d, i in ix.candidates(fp, s) for a, b in zip(d.tolist(), i.tolist())} == want and want


def test_recall_on_changed_words():
    """One word in twenty changed: nine of ten such passages are found, and no unrelated text."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, leakage.word_hashes(list(rng.choice(vocabulary, 80))), leakage.NEAR_SPAN) for i in range(60)]
    ix = leakage.Index(items, leakage.NEAR_RADIUS, leakage.NEAR_SIMILARITY)
    found = 0
    for i, h, _ in items:
        changed = h.copy()
        at = rng.choice(80, 4, replace=False)
        changed[at] = leakage.word_hashes([f"x{k}" for k in at])
        doc = np.concatenate([leakage.word_hashes(list(rng.choice(vocabulary, 50))), changed, leakage.word_hashes(list(rng.choice(vocabulary, 50)))])
        got = ix.find(doc)
        assert got <= {i}
        found += got == {i}
    assert found >= 54, found


def test_items_in_pieces(spark):
    text = " ".join(f"w{i}" for i in range(60))
    items = spark.createDataFrame([(1, text, "en"), (2, "short one", "en"), (3, None, None)], "item_id long, text string, lang string")
    pieces = [p for b in leakage.item_blocks(items, size=20) for p in b if p[0] == 1]
    whole = leakage.window_keys(leakage.word_hashes(text.split()), 12).tolist()
    assert sorted(k for _, h, _ in pieces for k in leakage.window_keys(h, 12).tolist()) == sorted(whole) and max(len(h) for _, h, _ in pieces) <= 20
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30, 70))), (2, "w1 w2"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in leakage.found_leaks(docs, items).collect()] == [(1, 1)]


def test_simhash_slides():
    h = leakage.word_hashes([f"w{i % 17}" for i in range(50)])
    direct = [np.packbits((np.unpackbits(h[i : i + 12].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0) * 2 > 12), bitorder="little").view(np.uint64)[0] for i in range(39)]
    assert leakage.simhash_windows(h, 12).tolist() == direct


@pytest.mark.parametrize("size", [100_000, 50])
def test_leaks_with_changed_words(spark, monkeypatch, size):
    """One search finds unbroken and changed passages; the query of unbroken ones is a part of its rows."""
    monkeypatch.setattr(leakage, "item_blocks", functools.partial(leakage.item_blocks, size=size))
    texts = {i: [f"w{i}x{k}" for k in range(80)] for i in (1, 2, 3)}
    changed = {i: ["new" if k % 20 == 10 else w for k, w in enumerate(ws)] for i, ws in texts.items()}
    items = spark.createDataFrame([(i, " ".join(ws), "zh") for i, ws in texts.items()] + [(4, "too short", None), (5, None, None)], "item_id long, text string, lang string")
    pad = " ".join(f"pad{k}" for k in range(40))
    docs = [(10, changed[1]), (11, texts[2][5:30]), (12, changed[1] + texts[1][:24] + changed[3]), (13, texts[1][:23]), (13, changed[2]), (14, changed[2][:20] + changed[3][20:40])]
    docs = spark.createDataFrame([(d, f"{pad}. {', '.join(ws)} {pad}") for d, ws in docs] + [(15, None), (16, "")], "doc_id long, text string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(leakage.leaks(docs, items)) == [(10, 1, False), (11, 2, True), (12, 1, True), (12, 3, False), (13, 2, False)]
    assert rows(leakage.found_leaks(docs, items)) == [(11, 2), (12, 1)]
    assert rows(leakage.leaks(docs, items, radius=0)) == [(11, 2, True), (12, 1, True)], "the radius counts"
    assert rows(leakage.leaks(docs, items, similarity=0.99)) == [(11, 2, True), (12, 1, True)], "so does the similarity"
    empty = leakage.leaks(docs, items.limit(0))
    assert empty.columns == ["doc_id", "item_id", "unbroken"] and empty.count() == 0


def test_shares_of_shingles_against_sets():
    rng = np.random.default_rng(3)
    vocabulary = leakage.word_hashes([f"w{i}" for i in range(25)])
    items = [(i % 7, rng.choice(vocabulary[:20], 30), 12) for i in range(10)]
    ix = leakage.Index(items, 7, 0.5)
    s, doc = ix.spans[12], rng.choice(vocabulary, 200)
    pairs = lambda h: set(zip(h.tolist(), h[1:].tolist()))
    has = collections.Counter(p for i in range(7) for p in set().union(*(pairs(h) for j, h, _ in items if j == i)))
    weigh = lambda ps: sum(np.log1p(7 / has[p]) if p in has else np.log1p(7) for p in ps)
    at, start = rng.integers(0, 189, 400), rng.choice(s["start"], 400)
    got = ix.alike(ix.numbers(leakage.window_keys(doc, 2)), at, s, start, 12)
    for share, d, w in zip(got, at, start):
        x, y = pairs(doc[d : d + 12]), pairs(s["words"][w : w + 12])
        assert abs(share - weigh(x & y) / weigh(x | y)) < 1e-9
    assert got.max() > 0 == got.min()


@pytest.mark.parametrize("radius", [0, 2, 4, 9])
def test_candidates_come_once(radius):
    rng = np.random.default_rng(radius)
    vocabulary = leakage.word_hashes([f"w{i}" for i in range(40)])
    ix = leakage.Index([(i, rng.choice(vocabulary, 40), 12) for i in range(20)], radius)
    s = ix.spans[12]
    fp = np.concatenate([s["fp"] ^ (np.uint64(1) << rng.integers(0, 64, len(s["fp"]), dtype=np.uint64)) for _ in range(2)] + [s["fp"]])
    got = [p for d, i in ix.candidates(fp, s) for p in zip(d.tolist(), i.tolist())]
    apart = np.bitwise_count(fp[:, None] ^ s["fp"][None, :])
    assert sorted(got) == list(zip(*(x.tolist() for x in np.nonzero(apart <= radius)))) and got


def test_no_window_spans_two_texts():
    ws = leakage.word_hashes([f"w{i}" for i in range(40)])
    block = [(7, ws, 12)]
    whole, near = leakage.Index(block, 0), leakage.Index([(7, ws, 32)], 7, 0.7)
    assert leakage.leaks_of([ws[:11], ws[11:22], ws[:0], ws[22:33]], whole, near) == []
    assert leakage.leaks_of([ws[:11], ws[11:23], ws[:0], ws[5:40]], whole, near) == [(1, 7, True), (3, 7, True)]
    long = np.tile(leakage.word_hashes(["x", "y"]), 150)
    assert leakage.simhash_windows(long, 300).tolist() == [np.packbits(np.unpackbits(long.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0) * 2 > 300, bitorder="little").view(np.uint64)[0]]


# ---- 9: sentences ---------------------------------------------------------------------------------------------------
def trained():
    m = sentences.Model()
    m.starters["*"] = {"The", "It", "Der", "In", "Nr", "यह"}
    m.abbreviations["*"] = {"Dr", "Nr", "vs", "approx", "cf", "z", "Abb"}
    m.ordinals["*"] = {"Prüfung", "Juni"}
    m.openings["*"] = {"共有"}
    return sentences.Cutter(m, "und")


CASES = [
    ("It ran. The end.", ["It ran.", "The end."]),
    ("Dr. Who came vs. him, approx. 3.5 ms. It ended!", ["Dr. Who came vs. him, approx. 3.5 ms.", "It ended!"]),
    ("It stalls... then goes. It stops... The rest.", ["It stalls... then goes.", "It stops...", "The rest."]),
    ('"It failed. Retry." was said. The log', ['"It failed. Retry." was said.', "The log"]),
    ('He asked, "Is it safe?" and left. (It was not.) The end', ['He asked, "Is it safe?" and left.', "(It was not.)", "The end"]),
    ("Seit der 3. Prüfung fehlt 5. Nr. 28 bleibt.", ["Seit der 3. Prüfung fehlt 5.", "Nr. 28 bleibt."]),
    ("日志写着“失败。请重试。”然后停了。共有3条！（没有。）她说：“不。”共有4条。等等……又来了。", ["日志写着“失败。请重试。”然后停了。", "共有3条！", "（没有。）", "她说：“不。”", "共有4条。", "等等……又来了。"]),
    ("ทำไมจึงคัดลอก ให้หยุดทันที", ["ทำไมจึงคัดลอก", "ให้หยุดทันที"]),
    ("« Rien. » disait-il. «Nada. Espere.» The end", ["« Rien. » disait-il.", "«Nada. Espere.»", "The end"]),
    ("# Head. Two\nA line\nwrapped. It goes\n- item one. Two.\n\n- item\n\n```\ncode. More\n\nx\n```\nIt.", None),
    ('"हुआ। चलाएँ।" यही था। यह है।', ['"हुआ। चलाएँ।" यही था।', "यह है।"]),
    ("", []),
    (" \n\t\n", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    units = trained().units(text)
    if want is not None:
        assert [text[a:b] for a, b in units] == want
    else:
        assert [text[a:b] for a, b in units][0] == "# Head. Two" and any(text[a:b].startswith("```") and text[a:b].endswith("```") for a, b in units)


@quick
@given(st.text(alphabet=st.sampled_from("ab. !?\n\"'()«»“”。」「#-`1กअ"), max_size=80))
def test_units_cover_all_text_once(text):
    at = 0
    for a, b in trained().units(text):
        assert a >= at and b > a and not text[at:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


@quick
@given(st.text(alphabet=st.sampled_from("ab.1 \t\n\n\n#-=*`~)\r\u2028"), max_size=60))
def test_blocks_line_by_line(text):
    assert list(sentences.blocks(text)) == [x for x in sentences._blocks(text) if x[2] > x[1]]


def test_rare_languages_and_long_words(spark, monkeypatch):
    """Each language has lists, whatever its share of the corpus; long words with one prefix stay apart; groups of languages change nothing."""
    many = [(i, "The dog ran. A cat sat! The dog ran. It fell? " * 40, "en") for i in range(30)]
    rare = [(100 + i, f"Wo bist Dur. {n} heute? Da war Dur. {n}. Hier ist es! Da war Dur. {n}.", "xx") for i, n in enumerate(["Abel", "Bond", "Cole", "Dean"] * 6)]
    long = [(200, " ".join(f"{'w' * 64}{k}. {'w' * 64}{k}." for k in range(3)), "en")]
    df = spark.createDataFrame([*many, *rare, *long], "doc_id long, text string, lang string")
    m = sentences.Model(tuple(r) for r in sentences.learn(df).collect())
    assert "Da" in m.starters["xx"] and "Dur" in m.abbreviations["xx"]
    assert len({sentences.word("w" * 64 + str(k)) for k in range(3)}) == 3
    whole = sorted(map(tuple, sentences.found_sentences(df).collect()))
    monkeypatch.setattr(sentences, "LIST_ENTRIES", 1)
    assert len(sentences._language_groups(sentences.learn(df))) > 1
    assert sorted(map(tuple, sentences.found_sentences(df).collect())) == whole
    assert [sentences.language(x) for x in (None, "EN-us", "zh_CN", "english", "")] == ["und", "en", "zh", "und", "und"]
    got = spark.createDataFrame([(x,) for x in (None, "EN-us", "zh_CN", "english", "", " de ")], "l string").select(sentences.language_column(F.col("l"))).collect()
    assert [r[0] for r in got] == ["und", "en", "zh", "und", "und", "de"]


def test_learned_from_texts(spark):
    names = ["Abel", "Bond", "Cole", "Dean", "East", "Ford", "Good", "Hill"] * 6
    parts = lambda i, n: [f"The {n.lower()} cache ran on {n.lower()}.", f"It met Dr. {n} at {n.lower()} today.", f"In {n} the end was near, i.e. at hand.", "They left!"]
    docs = [(i, " ".join((parts(i, n) * 2)[i % 4 : i % 4 + 4]), "en") for i, n in enumerate(names)]
    df = spark.createDataFrame([*docs, (99, None, "en"), (98, "", None), (97, "Solo", None), (96, "a. " * 30_000, "x")], "doc_id long, text string, lang string").withColumn("n", F.lit(1))
    m = sentences.Model(tuple(r) for r in sentences.learn(df).collect())
    assert "Dr" in m.abbreviations["en"] and "The" in m.starters["en"]
    got = sentences.found_sentences(df).where("doc_id = 3").collect()
    assert len(got) == 4
    assert sentences.found_sentences(df.limit(0)).count() == 0
