"""Small exact cases, edges included, of the core operators."""

import hashlib
import json
import os
import random
import re
import zipfile

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import constants as K
from millrace.operators import drift, graph, relational, series, stats, vectors
from millrace.operators.components import components
from millrace.plans import extra_plans, graph_plans, text_plans
from millrace.runtime import ranked, settle, skew_safe_lookup
from millrace.sinks import writers
from millrace.sources import files, records, replay


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("r")).first()[0]


def test_quality(spark):
    f = "def f(query):\n    cursor.execute(query)\n    return cursor.fetchall()"
    for code, want in ((f, True), ("x = 1", False), ("x" * 60_000, False), (" " * 100, False), (None, False), ("", False)):
        assert one(spark, code, X.quality_ok) is want


MESSAGES = {
    "Fix SQL injection in login": "sql_injection", "Fix XSS in template": "xss", "Fix command injection": "command_injection", "Add CSRF token": "csrf",
    "Fix path traversal": "path_traversal", "SSRF in fetcher": "ssrf", "XXE in parser": "xxe", "Fix authentication bypass": "auth_bypass", "Unsafe deserialization": "deserialization", "typo": "unknown",
}


def test_types_of_messages(spark):
    for text, want in MESSAGES.items():
        assert one(spark, text, lambda c: X.first_keyword(c, K.TYPE_KEYWORDS)) == want


def test_patches(spark):
    p = "@@ -1,3 +1,3 @@\n def f(query):\n-    cursor.execute(query)\n+    cursor.execute(query, params)\n     return 1"
    r = one(spark, p, X.patch_sides)
    assert "cursor.execute(query)" in r["before"] and "params" in r["after"] and r["before"] != r["after"]
    assert "def f(query):" in r["before"] and "return 1" in r["after"]
    bare = one(spark, "-old line\n+new line", X.patch_sides)
    assert (bare["before"], bare["after"]) == ("old line", "new line")
    none = one(spark, " same\n same too", X.patch_sides_strict)
    assert none["before"] is None and none["after"] is None
    assert one(spark, " only context", X.patch_snippets)["before"] is None


def without_preprocessor(code):
    """Line by line: (text, end) pairs, directives emptied, a run of blank lines and the end before it cut to two line feeds."""
    lines = [re.match(r"(.*?)(\r\n|\r|\n|$)", x, re.S).groups() for x in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$", code)]
    lines = [("" if re.match(r"[ \t]*#[ \t]*(include|define|ifdef|ifndef|endif)\b", x) else x, end) for x, end in lines]
    out, blanks = [], 0
    for x, end in lines:
        if not x.strip(" \t\v\f"):
            blanks += 1
            continue
        if blanks and out:
            out[-1] = (out[-1][0], ("\r" if out[-1][1] == "\r\n" else "") + "\n\n")
        out.append((x, end))
        blanks = 0
    return "".join(x + end for x, end in out).strip(" \t\r\n\v\f")


def test_no_preprocessor_over_all_c_and_line_ends(spark, tmp_path):
    rng = random.Random(5)
    pieces = ["int a;", "  int b; // #define", "#include <x.h>", "\t# define N 1", "#ifdef N", "#endif /* N */", "#if N", "#endifx", "", "  "]
    codes = ["".join(rng.choice(pieces) + rng.choice(["\n", "\r\n", "\r"] if i % 2 else ["\r\n"]) for _ in range(rng.randint(0, 14))) + rng.choice(["", "#endif", "}"]) for i in range(400)]
    codes += ["#include <a>\rint x;\n", "int a;\r\n#define B\r\n\r\nint c;\r\n", ""]
    kinds = [("c", "a/b.c"), ("C", "b.h"), (None, "x.c"), (" ", "y.H"), ("ANSI C", None)]
    others = [("C++", "a.h"), ("python", "a.c"), (None, "a.cpp"), (None, None)]
    rows = [(i, c, *kinds[i % 5]) for i, c in enumerate(codes)] + [(1000 + i, "int x;", *o) for i, o in enumerate(others)] + [(2000, None, "c", "n.c")]
    spark.createDataFrame(rows, "row_id long, vulnerable_code string, language string, file_path string").write.parquet(str(tmp_path / "repo_commits.parquet"))
    got = {r["row_id"]: r["h"] for r in text_plans.QUERIES["st13_no_preprocessor_all_c"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(without_preprocessor(c).encode()).hexdigest() for i, c in enumerate(codes)} | {2000: None}


def test_references(spark):
    urls = ["https://github.com/o/r/commit/abc", "https://example.com/x", "https://github.com/o/r/pull/1", "https://github.com/o/r/commit/" + "a" * 40, "https://github.com/o/r/issues"]
    df = spark.createDataFrame([(urls,)], "u array<string>")
    r = df.select(F.size(X.code_urls("u")), X.first_commit_hash("u"), X.repo_url("u")).first()
    assert tuple(r) == (3, "a" * 40, "https://github.com/o/r")


def test_file_rules(spark):
    df = spark.createDataFrame([("python", "a/b.py"), ("python", "a.js"), ("javascript", "x.TSX"), ("go", "x.go")], "l string, p string")
    assert [r[0] for r in df.select(X.file_fits_language("l", "p")).collect()] == [True, False, True, False]
    df = spark.createDataFrame([("src/a.py",), ("node_modules/a.js",), ("a.min.js",), ("README",)], "p string")
    assert [r[0] for r in df.select(X.watched_path("p")).collect()] == [True, False, False, False]


def test_dedup_keeps_first_and_keyless(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "o long, k string")
    once = relational.dedup_first(df, "k", "o")
    assert sorted(r[0] for r in once.collect()) == [1, 2, 4, 5]
    assert sorted(relational.dedup_first(once, "k", "o").collect()) == sorted(once.collect())
    assert relational.dedup_first(df.limit(0), "k", "o").count() == 0


def test_ranked_buckets_agree(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 3).withColumn("h", F.xxhash64("id"))
    whole = {(r["id"], r["rank"]) for r in ranked(df, ["g"], "h", "id", 500).collect()}
    cut = {(r["id"], r["rank"]) for r in ranked(df, ["g"], "h", "id", 500, per_bucket=20).collect()}
    assert whole == cut and len(whole) == 500


def test_skewed_lookup(spark):
    rows = settle(spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k")))
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = skew_safe_lookup(rows, lookup, "k", "n", 1000)
    assert got.count() == 1000 and got.where("k = 7").select("first").distinct().collect()[0][0] == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=25))
def test_components(spark, pairs):
    want = {}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    want = {x: root(x) for x in list(parent)}
    got = {r[0]: r[1] for r in components(spark.createDataFrame([*pairs, (1, 1)], "a long, b long")).collect()}
    assert got == want


def test_components_long_path(spark):
    n = 200
    got = components(spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.count() == n and got.where("comp <> 0").count() == 0


def test_splits_and_quotas(spark):
    df = spark.range(100).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    s = relational.ratio_split(df, "id", {"train": 0.7, "valid": 0.15, "test": 0.15}, by=["label"])
    assert s.count() == s.select("id").distinct().count() == 100
    got = {(r["label"], r["split"]): r["count"] for r in s.groupBy("label", "split").count().collect()}
    for label, n in ((0, 75), (1, 25)):
        assert all(abs(got[label, k] - share * n) <= 1 for k, share in (("train", 0.7), ("valid", 0.15), ("test", 0.15))), got
    assert {r[0]: r[1] for r in relational.balanced_sample(df, "label", "id").groupBy("label").count().collect()} == {0: 25, 1: 25}
    q = relational.even_quota(spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), "t", 10)
    assert [tuple(r) for r in q.orderBy("t").collect()] == [("a", 4), ("b", 3), ("c", 3)]


def test_overlaps(spark):
    a = spark.createDataFrame([(1, 0, 10), (2, 10, 20), (3, 5, 5)], "i int, s long, e long")
    b = spark.createDataFrame([(7, 9, 11), (8, 20, 30)], "j int, bs long, be long")
    assert sorted((r["i"], r["j"]) for r in relational.overlapping(a, b, "s", "e", "bs", "be", 4).collect()) == [(1, 7), (2, 7)]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 1)), max_size=30))
def test_sweep(spark, rows):
    got = stats.threshold_sweep(spark.createDataFrame(rows, "p double, y int"), "y", "p").orderBy("pct").collect()
    assert len(got) == (41 if rows else 0)
    for r in got:
        t = r["pct"] / 100
        assert r["tp"] == sum(1 for p, y in rows if y == 1 and p >= t) and r["fp"] == sum(1 for p, y in rows if y == 0 and p >= t)
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == len(rows)
    assert all(a["recall"] >= b["recall"] for a, b in zip(got, got[1:]))


def test_auc_and_scores(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "p double, y int")
    assert stats.roc_auc(df, "y", "p").first()[0] == 0.75
    assert stats.roc_auc(df.where("y = 1"), "y", "p").first()[0] == 0.0
    c = stats.scores(stats.confusion(df.limit(0).withColumn("h", F.lit(1)), "y", "h")).first()
    assert (c["tp"], c["f1"], c["accuracy"]) == (0, 0.0, 0.0)


def test_paired_t(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.5), (3.0, 3.9), (4.0, 5.5)], "a double, b double")
    r = stats.paired_t(df, "a", "b").first()
    assert r["n"] == 4 and abs(r["t"] - 7.0711) < 0.8 and 0 < r["p"] < 0.02
    d = np.array([1.0, 1.5, 0.9, 1.5])
    assert abs(r["t"] - d.mean() / (d.std(ddof=1) / 2)) < 1e-5


def test_ensembles(spark):
    p = spark.createDataFrame([(1, 1, 0.2, 1), (1, 2, 0.6, 1), (2, 1, 0.9, 0)], "r long, s int, p double, y int")
    assert {r["r"]: r["p"] for r in stats.ensemble_mean(p, "r", "p", "y").collect()} == {1: 0.4, 2: 0.9}
    assert [r["r"] for r in stats.misaligned(p, "r", "y", 2).collect()] == [2]
    with pytest.raises(Exception, match="labels differ"):
        stats.ensemble_mean(p.withColumn("y", F.col("s")), "r", "p", "y").collect()


def test_series(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0, 50.0, 1.0, 2.0])], "k string, o long, v double")
    assert [r["o"] for r in series.spikes(df, ["k"], ["o"], "v", 10).where("spike").collect()] == [2]
    assert [r["streak"] for r in series.streaks(df.withColumn("b", F.col("v") == 1), ["k"], ["o"], "b").orderBy("o").collect()] == [1, 2, 0, 1, 0]
    assert [round(r["ema"], 4) for r in series.ema(df, "k", "o", "v", 0.5).orderBy("o").collect()] == [1.0, 1.0, 25.5, 13.25, 7.625]
    assert [r["patience"] for r in series.running_best(df, ["k"], ["o"], "v").orderBy("o").collect()] == [0, 1, 0, 1, 2]
    x, y = np.array([0.0, 1.0, 3.0, 4.0]), np.array([1.0, 3.0, 2.0, 8.0])
    g = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    assert np.allclose([r["slope"] for r in series.gradient(g, ["k"], "x", "y").orderBy("x").collect()], np.gradient(y, x))
    for w in range(1, 6):
        got = [r["smooth"] for r in series.moving_average(df, ["k"], ["o"], "v", w).orderBy("o").collect()]
        assert np.allclose(got, np.convolve([1, 1, 50, 1, 2], np.ones(w) / w, mode="same"))


def test_rate_limit_ignores_refused(spark):
    df = spark.sql("SELECT 'a' AS k, id AS i, timestamp_seconds(id * 10) AS ts FROM range(7)")
    assert [r["ok"] for r in series.accepted(df, "k", "ts", "i", 2, 30).orderBy("i").collect()] == [True, True, False, True, True, False, True]


def test_a_b_a_changes(spark):
    df = spark.createDataFrame([("f", 1, "A"), ("f", 2, "A"), ("f", 3, "B"), ("f", 4, "A"), ("f", 5, None)], "k string, o int, c string")
    assert [r["o"] for r in series.changed(df, "k", ["o"], "c").orderBy("o").collect()] == [1, 3, 4, 5]


def test_reach(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, None)], "src long, dst long")
    s = spark.createDataFrame([(1,), (None,)], "start long")
    assert sorted((r["node"], r["depth"]) for r in graph.reach(e, s, 5).collect()) == [(1, 3), (2, 1), (3, 2), (4, 3)]
    assert graph.reach(e.limit(0), s, 3).count() == 0


def test_trees(spark):
    df = spark.createDataFrame([(1, "x = 1"), (2, "x = 1\ny = ("), (3, "( a b"), (4, None)], "i long, c string")
    r = {x["i"]: x for x in graph.trees(df, "i", "c").collect()}
    assert r[1]["ok"] and r[1]["nodes"][0] == "Module" and len(r[1]["edges"]) == 2 * (len(r[1]["nodes"]) - 1)
    assert r[2]["how"] == "partial" and r[3]["how"] == "tokens" and r[3]["nodes"] == ["(", "a", "b"]


def test_python_rows_by_language_or_extension(spark, tmp_path):
    kinds = [("python", "a.py"), ("Python 3", "b"), (" py", "c.txt"), (None, "d.py"), ("", "e.PYW"), ("javascript", "f.py"), (None, "g.js"), (None, None)]
    rows = [(i, "for x in y: f(x)", *k) for i, k in enumerate(kinds)]
    spark.createDataFrame(rows, "row_id long, vulnerable_code string, language string, file_path string").write.parquet(str(tmp_path / "repo_commits.parquet"))
    run = lambda m, name: m.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted(r["row_id"] for r in run(text_plans, "st5_syntax_counts")) == [0, 1, 2, 3, 4]
    assert sorted(r["row_id"] for r in run(graph_plans, "ar3_ar4_gr10_trees")) == [0, 1, 2, 3, 4]
    assert {r["kind"]: r["n"] for r in run(extra_plans, "ud5_table_function")}["For"] == 5


def test_nearest(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(90, None), (91, [0.0] * 8), (92, [1.0])], "i long, v array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = vectors.nearest(df, df.where("i % 20 = 0 or i > 90"), "i", "v", 3).collect()
    for q in (0, 20, 40):
        sim = u @ u[q]
        sim[q] = -9
        assert {r["neighbour"] for r in got if r["query"] == q} == set(np.argsort(-sim)[:3].tolist())


def test_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "n": 2}\n\nbroken {\n{"id": "2"}\n')
    assert files.read_jsonl(spark, str(p), "id string, n long", source="s").where("id is not null").count() == 2
    assert sum(r["_bad_line"] is not None for r in files.read_jsonl(spark, str(p), "id string, n long", bad="keep").collect()) == 1
    assert files.rejected(spark, str(p), "id string, n long").count() == 1
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(p), "id string, n long", bad="fail").collect()
    assert files.require(files.read_jsonl(spark, str(p), "id string, n long"), "id", "n").count() == 1
    (tmp_path / "b.json").write_text('[{"id": "1"}, {"id": "2"}]')
    assert files.read_json_array(spark, str(tmp_path / "b.json"), "id string").count() == 2
    (tmp_path / "c.csv").write_text('id,file,codes\n1,"x,y.py",\n')
    assert files.read_csv_text(spark, str(tmp_path / "c.csv"), {"file": "file_path"}).collect()[0].asDict() == {"id": "1", "file_path": "x,y.py", "codes": ""}
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("x.json", '{"a": 1}')
        z.writestr("y.json", "{bad")
        z.writestr("z.txt", "no")
    rows = files.read_zip_json(spark, str(tmp_path / "d.zip")).orderBy("ordinal").collect()
    assert [(r["entry"], r["document"] is None) for r in rows] == [("x.json", False), ("y.json", True)]
    for s in (1, 2):
        os.makedirs(tmp_path / f"seed_{s}")
        np.save(tmp_path / f"seed_{s}" / "val_probs.npy", np.array([0.5, 0.25], np.float32))
        np.save(tmp_path / f"seed_{s}" / "val_labels.npy", np.array([1, 0]))
    assert files.predictions(spark, str(tmp_path)).groupBy("seed").agg(F.sum("prob")).count() == 2
    assert {r["directory"]: r["files"] for r in files.inventory(spark, str(tmp_path / "seed_*")).collect()} == {"seed_1": 2, "seed_2": 2}


def test_inventory_query_counts_the_samples_it_wrote(spark, tmp_path, monkeypatch):
    path, seen, real = str(tmp_path / "copy"), [], files.inventory
    df = spark.range(0, 1000, 1, 5).select(F.col("id").alias("sample_id"), F.lit("int a;").alias("code"))
    df.write.parquet(str(tmp_path / "samples.parquet"))
    monkeypatch.setattr(extra_plans, "_new", lambda s, name: path)
    monkeypatch.setattr(extra_plans.files, "inventory", lambda *a: seen.append(real(*a)) or seen[0])
    assert [tuple(r) for r in extra_plans.QUERIES["sc20_inventory"](spark, str(tmp_path)).collect()] == [("part", True)]
    written = [p for p in os.listdir(path + "/part") if p.endswith(".json")]
    assert [tuple(r) for r in seen[0].collect()] == [("part", len(written), sum(os.path.getsize(f"{path}/part/{p}") for p in written))]
    assert len(written) > 1 and spark.read.json(path + "/part").count() == 1000


def test_replayed_pages_and_history(spark, tmp_path):
    for kw, n, docs in (("sql", 0, [{"id": 1}, {"id": 2}]), ("sql", 1, [{"id": 3}]), ("xss", 0, [{"id": 4}])):
        (tmp_path / f"{kw}__{n}.json").write_text(json.dumps(docs))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    replay.register(spark)
    df = spark.read.format("captured_pages").load(str(tmp_path))
    assert df.count() == 4
    assert [r["document"] for r in df.where("keyword = 'xss'").collect()] == ['{"id": 4}']
    more = [{"id": f"A{i}", "published": f"203{i}-01-01", "severity": "HIGH" if i % 2 else "LOW", "ecosystem": "npm"} for i in range(6)]
    (tmp_path / "adv__10.json").write_text(json.dumps(more))
    assert [r["doc_id"] for r in df.where("published >= '2031' and published < '2034-06' and severity = 'HIGH' and ecosystem = 'npm'").collect()] == ["A1", "A3"]
    assert df.where("doc_id = 'A5'").count() == 1 and df.where("page > 1").count() == 6 and df.where("published is null").count() == 4
    wanted = replay.plugins.Wanted({"keyword": "sql"}, {"page": 1}, {})
    assert [p[1:] for p in replay.CapturedPages({"path": str(tmp_path)}).partitions(wanted)] == [("sql", 1)]
    with pytest.raises(ValueError):
        replay.plugins.register(spark, type("Other", (replay.plugins.Collector,), {"name": "captured_pages", "schema": "a int"}))
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(os.path.join(here, ".git")):
        assert spark.read.format("git_history").option("repos", here).load().count() > 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "é"), ("b", "x")], "id string, t string")
    out = str(tmp_path / "o")
    assert writers.append_jsonl(df, out, "id") == 2
    assert writers.append_jsonl(df.union(spark.createDataFrame([("c", "y"), ("c", "y")], "id string, t string")), out, "id") == 1
    assert spark.read.json(out).count() == 3
    writers.write_atomic({"a": 1}, str(tmp_path / "m" / "x.json"))
    assert json.load(open(tmp_path / "m" / "x.json")) == {"a": 1}
    with pytest.raises(TypeError):
        writers.write_atomic({"a": object()}, str(tmp_path / "m" / "y.json"))
    assert os.listdir(tmp_path / "m") == ["x.json"]
    ev = spark.createDataFrame([("osv", True, "done"), ("cve", False, None)], "collector string, success boolean, message string")
    levels = [r["level"] for r in json.loads(writers.sarif(ev).first()[0])["runs"][0]["results"]]
    assert sorted(levels) == ["note", "warning"]
    assert writers.write_all(ev, str(tmp_path / "r"), ["csv", "pdf", "sarif"]) == ["csv", "sarif"]
    nodes, edges = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 2)], "src long, dst long")
    writers.graph_tables(nodes, edges, str(tmp_path / "g"))
    with pytest.raises(ValueError):
        writers.graph_tables(nodes.union(nodes), edges, str(tmp_path / "g"))


def test_records(spark):
    cve = {"cve": {"id": "CVE-1", "descriptions": [{"lang": "en", "value": "SQL injection"}], "weaknesses": [{"description": [{"lang": "en", "value": "CWE-89"}, {"lang": "en", "value": "other"}]}], "metrics": {"cvssMetricV2": [{"cvssData": {"baseScore": 5.0}}], "cvssMetricV31": [{"cvssData": {"baseSeverity": "HIGH", "baseScore": 8.5}}]}}}
    r = records.from_cve(spark.createDataFrame([(json.dumps(cve),), ("{}",), (None,), ("broken",)], "j string"), "j").collect()
    assert len(r) == 1 and (r[0]["severity"], r[0]["cvss_score"], r[0]["cwes"], r[0]["vulnerability_type"]) == ("HIGH", 8.5, ["CWE-89"], "sql_injection")
    osv = {"id": "X", "summary": "s", "affected": [{"package": {"name": "p"}}], "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N"}]}
    r = records.from_osv(spark.createDataFrame([(json.dumps(osv),), ('{"id": "Y", "affected": []}',)], "j string"), "j").collect()
    assert len(r) == 1 and (r[0]["severity"], r[0]["description"]) == ("HIGH", "s")
    df = spark.createDataFrame([("", "f", None, 1), (None, None, None, None)], "code string, func string, label int, target int")
    assert [tuple(x) for x in records.truthy_code(df).select("code", "label").collect()] == [("f", 1), ("", 0)]
    p = spark.createDataFrame([([5, 6, 7],)], "t array<int>").select(records.padded(F.col("t"), 5).alias("a"), records.padded(F.col("t"), 2).alias("b")).first()
    assert (p["a"]["ids"], p["a"]["mask"], p["b"]["ids"]) == ([5, 6, 7, 0, 0], [1, 1, 1, 0, 0], [5, 6])
    assert records.json_problems(spark.sql("SELECT 1 AS a, binary('x') AS b, map(1, 2) AS m")) == ["b: binary", "m: key int"]


LINES = "file_id long, feed string, exported_at timestamp_ntz, line_no int, payload string, ord int, path string"


def lines(spark, rows):
    import datetime

    return spark.createDataFrame([(f, feed, datetime.datetime(2031, 1, d), n, p, 0, "x") for f, feed, d, n, p in rows], LINES)


def test_drift(spark):
    j = json.dumps
    df = lines(spark, [
        (5, "a", 1, 1, j({"id": "r1", "code": "x", "n": 1, "m": {"k": True}})), (5, "a", 1, 2, "broken {"), (5, "a", 1, 3, None), (5, "a", 1, 4, j([1])),
        (2, "a", 2, 1, j({"id": "r1", "func": "x", "n": 1.5, "m": {"k": None}, "extra": [1]})),
        (9, "a", 3, 1, j({"id": "r9", "body": "y", "n": 2.5, "extra": [1]})), (9, "a", 3, 1, j({"id": "r9", "body": "y", "n": 2.5, "extra": [1]})),
        (7, "b", 1, 1, j({"id": "q"})), (8, "b", 2, 1, '{"id": "q", "w": NaN}'),
    ])
    got = sorted(tuple(r) for r in drift.found_changes(df).collect())
    assert got == [(2, "code", "renamed"), (2, "extra", "added"), (2, "m.k", "removed"), (2, "n", "retyped"), (8, "id", "removed"), (9, "body", "added"), (9, "func", "removed")]
    t = drift.unified(df)
    assert dict(t.dtypes)["n"] == "double" and t.count() == 5 and t.where("code = 'x'").count() == 2
    assert drift.found_changes(df.limit(0)).count() == 0 and drift.unified(df.limit(0)).count() == 0


def test_unified_casts_and_loses_nothing(spark):
    j = json.dumps
    df = lines(spark, [
        (1, "a", 1, 1, j({"id": "r1", "label": 1, "w": "0.5", "n": 7, "t": "x", "flag": True, "tags": "one"})),
        (1, "a", 1, 2, j({"id": "r2", "label": "0", "w": 2, "n": 10**30, "t": 3, "flag": "false", "tags": ["p", 2, None]})),
        (1, "a", 1, 3, j({"id": "r3", "label": True, "w": 1.5, "n": "none", "t": "z", "flag": "maybe"})),
        (1, "a", 1, 4, j({"id": "r4", "n": " 8 ", "flag": "TRUE"})),
        # code and src live side by side in feed b, but feed c renames one to the other
        (2, "b", 1, 1, j({"id": "q1", "code": "k", "src": "s"})), (3, "c", 1, 1, j({"id": "q1", "src": "s"})), (4, "c", 2, 1, j({"id": "q1", "code": "s"})), (5, "c", 3, 1, j({"id": "q2", "code": "u"})),
    ])
    t = drift.unified(df)
    assert {n: dict(t.dtypes)[n] for n in ("label", "w", "n", "t", "flag", "tags")} == {"label": "bigint", "w": "double", "n": "bigint", "t": "string", "flag": "boolean", "tags": "array<string>"}
    rows = {(r["file_id"], r["line_no"]): r for r in t.collect()}
    assert [rows[1, k]["label"] for k in (1, 2, 3)] == [1, 0, 1] and [rows[1, k]["w"] for k in (1, 2, 3)] == [0.5, 2.0, 1.5]
    assert rows[1, 2]["unfit_values"] == {"n": str(10**30)} and rows[1, 3]["unfit_values"] == {"n": '"none"', "flag": '"maybe"'} and rows[1, 1]["unfit_values"] is None
    assert (rows[1, 4]["n"], rows[1, 4]["flag"]) == (8, True) and rows[1, 1]["tags"] == ["one"] and rows[1, 2]["tags"] == ["p", "2", None] and rows[1, 2]["t"] == "3"
    assert (rows[2, 1]["code"], rows[2, 1]["src"]) == ("k", "s") and rows[3, 1]["code"] == "s" and rows[4, 1]["code"] == "s"
    assert sorted(map(tuple, drift.unfit_report(t).collect())) == [("flag", 1, 1), ("n", 2, 2)]


def test_drift_matches_until_no_pair_is_left(spark):
    file = lambda names, **more: json.dumps({"id": "r"} | dict.fromkeys(names, 7) | more)
    df = lines(spark, [(1, "a", 1, 1, file("ab")), (2, "a", 2, 1, file("cd")), (3, "a", 3, 1, file("wxyz", u=1)), (4, "b", 1, 1, file("pqrst")), (5, "b", 2, 1, file("efghi"))])
    got = sorted((r["file_id"], r["change_kind"], r["field_path"], r["new_path"]) for r in drift.changes(df).collect())
    want = [(2, "renamed", "a", "c"), (2, "renamed", "b", "d"), (3, "renamed", "c", "w"), (3, "renamed", "d", "x"), *((3, "added", p, None) for p in "uyz"), *((5, "renamed", o, n) for o, n in zip("pqrst", "efghi"))]
    assert got == sorted(want, key=lambda r: r[:3])


def test_streams(spark, tmp_path):
    from millrace.streaming import streams

    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, True), ("a", 4, False), ("b", 5, None)], "k string, o long, bad boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert [r["o"] for r in streams.run_to_table(streams.alarms(stream(), "k", "o", "bad"), "append").collect()] == [3]
    assert {r["k"]: r["o"] for r in streams.run_to_table(streams.latest_state(stream(), "k", "o", ["bad"]), "complete").collect()} == {"a": 4, "b": 5}
    for least, want in ((9, False), (5, True)):
        out = str(tmp_path / f"g{least}")
        streams.gated(stream(), out, least, str(tmp_path / f"c{least}")).awaitTermination()
        assert os.path.isdir(out + "/synced") is want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0




# ---- plans that hold at scale -------------------------------------------------------------------------------------
def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 50 != 0, (F.col("id") * 7919) % 1000 / 10.0).alias("v"))
    got = {tuple(stats.bootstrap_mean(x, "v", "id", 200).first()) for x in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("id")))}
    (mean, low, high), = got
    v = np.array([(i * 7919) % 1000 / 10 for i in range(3000) if i % 50])
    assert abs(mean - v.mean()) < 1e-6 and low < mean < high and abs((high - low) / (2 * 1.96 * v.std() / len(v) ** 0.5) - 1) < 0.2
    assert tuple(stats.bootstrap_mean(df.limit(0), "v", "id", 10).first()) == (None, None, None)


def test_auc_over_many_distinct_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(int(y), float(round(p, 2))) for y, p in zip(rng.integers(0, 2, 500), rng.random(500))]
    df = spark.createDataFrame([*rows, (None, 0.5), (1, None)], "y int, p double").repartition(5)
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(stats.roc_auc(df, "y", "p").first()[0] - want) < 1e-5


def test_syntax_counts_leave_out_expressions_and_are_capped(spark):
    code = "x = 1 if y else 2\n" + "if a:\n    b()\n" * 60 + "async def f():\n    async for i in j: pass\n" + "for k in l: pass\n" * 55
    df = spark.createDataFrame([(1, code), (2, "def ("), (3, None)], "i long, code string").select("i", X.syntax_counts("code").alias("n"))
    assert [tuple(r["n"]) for r in df.orderBy("i").collect()] == [(50, 50, 60, 0, 0), (0,) * 5, (0,) * 5]


def test_snippets_are_stripped(spark):
    p = "@@ -1 +1 @@\n   head\n-    old\n+  \n"
    r = spark.createDataFrame([(p,)], "p string").select(X.patch_snippets("p").alias("s")).first()["s"]
    assert r["before"].startswith("head") and r["after"].startswith("head")
    r = spark.createDataFrame([("-  \n+ x\n",)], "p string").select(X.patch_snippets("p").alias("s")).first()["s"]
    assert (r["before"], r["after"]) == (None, "x")


def test_overlaps_of_short_and_very_long_ranges(spark):
    rng = np.random.default_rng(1)
    make = lambda n: [(i, int(a), int(a + b)) for i, (a, b) in enumerate(zip(rng.integers(0, 2000, n), rng.choice([0, 1, 3, 9, 10, 11, 39, 41, 700, 10**9], n)))]
    a, b = make(60), make(60)
    x, y = spark.createDataFrame(a, "i long, s long, e long"), spark.createDataFrame(b, "j long, t long, f long")
    got = sorted((r["i"], r["j"]) for r in relational.overlapping(x, y, "s", "e", "t", "f", 10).collect())
    assert got == sorted((i, j) for i, s, e in a for j, t, f in b if s < e and t < f and s < f and t < e)


def test_neighbours_of_mixed_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.9, 0.0, 0.1]), (5, [0.0, 0.0]), (6, None), (7, [None, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "i long, v array<double>").repartition(3)
    got = sorted((r["query"], r["neighbour"]) for r in vectors.nearest(df, df, "i", "v", 3).collect())
    assert got == [(1, 2), (2, 1), (3, 4), (4, 3)]


def test_components_of_a_hub(spark):
    hub = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    more = spark.range(5000, 5004).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(hub.union(more)).groupBy("comp").count().collect()
    assert sorted(map(tuple, got)) == [(0, 3000), (5000, 5)]


def test_gate_moves_each_row_once(spark, tmp_path):
    from millrace.streaming import streams

    for k in range(5):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.gated(stream, str(tmp_path / "g"), 20, str(tmp_path / "c")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "g/synced"))
    assert done.count() == done.select("id").distinct().count() == 40 and done.select("sync").distinct().count() == 2
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "g/ledger")).select("rows").collect()) == [20, 20]


def test_checkpoints(spark, tmp_path):
    from millrace.streaming import progress

    store = progress.CheckpointStore(str(tmp_path / "c"))
    assert store.load("a") is None and store.names() == [] and store.info("a") is None and store.delete("a") is False
    store.save("a", {"n": 1})
    store.save("a", {"n": 2, "page": "x"})
    assert store.load("a") == {"n": 2, "page": "x"} and store.names() == ["a"] and store.info("a")["keys"] == ["n", "page"]
    with store.lock("a"), pytest.raises(TimeoutError), store.lock("a", wait=0.1):
        pass
    (tmp_path / "c" / "a.json").write_text('{"state": ')
    assert store.load("a") is None and store.delete("a") is True
    with pytest.raises(ValueError):
        store.save("../x", {})
    work = spark.range(6).withColumn("k", F.col("id") % 2)
    path = str(tmp_path / "done")
    assert progress.remaining(work, path, ["id"]).count() == 6
    for _ in range(2):
        progress.mark_done(work.where("id < 2").select("id"), path)
    assert [r[0] for r in progress.remaining(work, path, ["id"]).orderBy("id").select("id").collect()] == [2, 3, 4, 5]


def test_documents_definitions_and_registry(spark, tmp_path):
    from millrace.functions import models

    (tmp_path / "a.json").write_text("{")
    with pytest.raises(ValueError):
        files.read_json_document(str(tmp_path / "a.json"))
    with pytest.raises(FileNotFoundError):
        files.read_json_document(str(tmp_path / "b.json"))
    (tmp_path / "a.json").write_text('{"x": [1]}')
    assert files.read_json_document(str(tmp_path / "a.json")) == {"x": [1]}
    code = "class A:\n    def f(self):\n        def g(): pass\n@app.get('/x')\nasync def h(): pass\n"
    df = spark.createDataFrame([(1, code), (2, "def ("), (3, None)], "i int, code string")
    got = sorted((r["kind"], r["name"], r["owner"], r["route"]) for r in graph.definitions(df, "i", "code").collect())
    assert got == sorted([("class", "A", None, None), ("function", "f", "A", None), ("function", "g", "A", None), ("route", "h", None, "/x")], key=lambda r: r[:2])
    assert "hashed-64" in models.BACKBONES.names() and models.BACKBONES.facts("HASHED-64")["dims"] == 64
    with pytest.raises(KeyError):
        models.BACKBONES.build("other")
