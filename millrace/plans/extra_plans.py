"""Queries of files, caches, scores of several parts, versions of texts, inference and functions for SQL."""

from __future__ import annotations

import os

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import models as M
from ..functions import scores as C
from ..functions import text as X
from ..functions.register import register
from ..operators import counting as N
from ..operators import graph as G
from ..operators import relational as R
from ..operators import series as Z
from ..runtime import scratch_dir
from ..runtime import table as t
from ..sinks import writers
from ..sources import files
from ..streaming import streams
from .text_plans import q

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _new(s, name: str) -> str:
    return f"{scratch_dir(s)}/{name}-{os.urandom(6).hex()}"


# ---- files ----------------------------------------------------------------------------------------------------------
@query("sc4_fail_fast", "SELECT count(*) = 0 AS intact FROM raw_lines WHERE payload IS NOT NULL AND trim(payload) <> '' AND NOT json_valid(payload)")
def _(s, d):
    path = _new(s, "strict")
    t(s, d, "raw_lines").where("payload is not null").select(F.col("payload").alias("value")).write.text(path)
    return s.createDataFrame([(files.intact(s, path, "id string"),)], "intact boolean")


@query("sc6_sc7_csv", "SELECT row_id::VARCHAR AS id, coalesce(file_path, '') AS path, coalesce(language, '') AS language FROM repo_commits")
def _(s, d):
    path = _new(s, "csv")
    t(s, d, "repo_commits").select(F.col("row_id").alias("id"), F.col("file_path").alias("file"), "language").write.option("header", True).csv(path)
    return files.read_csv_text(s, path, {"file": "path"}, ["id", "file", "language"])


@query("sc14_first_valid", "SELECT row_id, md5(CASE WHEN length(fixed_code) >= 400 THEN fixed_code WHEN length(vulnerable_code) >= 400 THEN vulnerable_code END) AS h FROM repo_commits")
def _(s, d):
    ok = lambda c: F.length(c) >= 400
    x = t(s, d, "repo_commits")
    return x.select("row_id", F.md5(files.first_valid(F.col("fixed_code"), F.col("vulnerable_code"), valid=ok)).alias("h"))


# registry documents of each package, one per ecosystem's shape, looked up by ecosystem and name
@query("sc15_registry_by_ecosystem", "SELECT sample_id, CASE WHEN lower(metadata.ecosystem) IN ('npm', 'pip', 'rubygems', 'go') THEN 'https://example.org/' || lower(metadata.package_name) END AS url FROM samples WHERE metadata.package_name IS NOT NULL")
def _(s, d):
    x = t(s, d, "samples").where("metadata.package_name is not null").select("sample_id", F.lower("metadata.ecosystem").alias("ecosystem"), F.lower("metadata.package_name").alias("package"))
    url = F.concat(F.lit("https://example.org/"), F.col("package"))
    shapes = {"npm": F.struct(F.struct(url.alias("url")).alias("repository")), "pip": F.struct(F.struct(url.alias("home_page")).alias("info")), "rubygems": F.struct(url.alias("source_code_uri"))}
    document = F.to_json(F.struct(url.alias("url")))
    for name, shape in shapes.items():
        document = F.when(F.col("ecosystem") == name, F.to_json(shape)).otherwise(document)
    registry = x.where("ecosystem in ('npm', 'pip', 'rubygems', 'go')").select("ecosystem", "package", document.alias("document")).distinct()
    return files.registry_urls(x, registry).select("sample_id", "url")


@query("sc16_sc23_glob_with_key", "SELECT sample_id, lower(trim(source)) AS source FROM samples WHERE source IS NOT NULL")
def _(s, d):
    path = _new(s, "glob")
    t(s, d, "samples").where("source is not null").select(F.lower(F.trim("source")).alias("part"), "sample_id").write.partitionBy("part").json(path)
    return files.read_glob(s, f"{path}/part=*", "sample_id long", "source", r"part=([^/]+)/", lines=True)


@query("sc18_read_through", "SELECT v.row_id, EXISTS (SELECT 1 FROM train_split t WHERE md5(t.code) = md5(v.code) AND t.label IS NOT NULL) AS hit FROM valid_split v WHERE v.code IS NOT NULL")
def _(s, d):
    cache = t(s, d, "train_split").where("code is not null and label is not null").select(F.md5("code").alias("key"), F.col("label").cast("string").alias("value")).dropDuplicates(["key"])
    want = t(s, d, "valid_split").where("code is not null").select("row_id", F.md5("code").alias("key"))
    hit, miss = files.read_through(want, cache, "key", "value")
    return hit.select("row_id", F.lit(True).alias("hit")).unionByName(miss.select("row_id", F.lit(False).alias("hit")))


@query("sc19_fresh_entries", "SELECT sample_id FROM samples WHERE epoch_us(TIMESTAMP '2033-01-01') - epoch_us(collected_at) <= 5000::BIGINT * 3600000000")
def _(s, d):
    return files.fresh(t(s, d, "samples"), "collected_at", F.lit("2033-01-01").cast("timestamp"), 5000).select("sample_id")


@query("sc20_inventory", "SELECT 'part' AS directory, count(*) > 0 AS found FROM samples")
def _(s, d):
    path = _new(s, "part")
    writers.write_jsonl(t(s, d, "samples"), f"{path}/part")
    return files.inventory(s, f"{path}/part/*.json").select("directory", (F.col("bytes") > 0).alias("found"))


@query("sk3_append_new", "SELECT count(DISTINCT source) AS n FROM mix_targets")
def _(s, d):
    path, x = _new(s, "append"), t(s, d, "mix_targets")
    writers.append_jsonl(x.where("target_pct > 10"), path, "source")
    writers.append_jsonl(x, path, "source")
    return s.read.schema(x.schema).json(path).agg(F.count("*").alias("n"))


# the same over a table that grows
@query("sk3_append_new_samples", "SELECT sample_id, source, label, code FROM samples")
def _(s, d):
    path, x = _new(s, "append"), t(s, d, "samples").select("sample_id", "source", "label", "code")
    writers.append_jsonl(x.where("sample_id % 3 = 0"), path, "sample_id")
    writers.append_jsonl(x, path, "sample_id")
    return s.read.schema(x.schema).json(path)


@query("sk10_sk12_parquet_append", "SELECT row_id, label::BIGINT AS label, 0.5::DOUBLE AS prob FROM valid_split CROSS JOIN range(2)")
def _(s, d):
    path, x = _new(s, "history"), t(s, d, "valid_split").select("row_id", F.col("label").cast("long").alias("label"), F.lit(0.5).alias("prob"))
    for _ in range(2):
        writers.append_history(x, path)
    return s.read.schema(x.schema).parquet(path)


@query("sk16_graph_tables", "SELECT s_suppkey AS id, NULL::BIGINT AS dst FROM supplier UNION ALL SELECT * FROM (SELECT DISTINCT l_suppkey, l_partkey % 50 AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE EXISTS (SELECT 1 FROM supplier z WHERE z.s_suppkey = l_partkey % 50))")
def _(s, d):
    nodes = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"))
    edges = t(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst")).distinct()
    edges = edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    path = _new(s, "graph")
    writers.graph_tables(nodes, edges, path)
    n, e = s.read.parquet(f"{path}/nodes"), s.read.parquet(f"{path}/edges")
    return n.select("id", F.lit(None).cast("long").alias("dst")).unionByName(e.select(F.col("src").alias("id"), "dst"))


# ---- rows and scores ------------------------------------------------------------------------------------------------
@query("fl19_not_done", "SELECT DISTINCT lower(metadata.ecosystem) AS eco FROM samples WHERE metadata.ecosystem IS NOT NULL AND lower(metadata.ecosystem) NOT IN ('npm', 'go')")
def _(s, d):
    return N.not_in(t(s, d, "samples").select(F.lower("metadata.ecosystem").alias("eco")).distinct(), "eco", ["npm", "go"])


@query("fl20_gate", "SELECT event_id FROM events WHERE value / 100 >= 0.7")
def _(s, d):
    return t(s, d, "events").where(C.banded(F.col("value") / 100, [(0.7, "in")], "out") == "in").select("event_id")


@query("ag48_weighted_parts", "SELECT user_id, round(0.2::DOUBLE * coalesce(avg(value) FILTER (event_type = 'view'), 0) + 0.4::DOUBLE * coalesce(avg(value) FILTER (event_type = 'click'), 0) + 0.3::DOUBLE * coalesce(avg(value) FILTER (event_type = 'purchase'), 0) + 0.1::DOUBLE * coalesce(avg(value) FILTER (event_type = 'error'), 0), 4) AS score FROM events GROUP BY 1")
def _(s, d):
    a = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    g = t(s, d, "events").groupBy("user_id").agg(*(a(k).alias(k) for k in ("view", "click", "purchase", "error")))
    return g.select("user_id", F.round(M.weighted_parts([(F.col("view"), 0.2), (F.col("click"), 0.4), (F.col("purchase"), 0.3), (F.col("error"), 0.1)]), 4).alias("score"))


@query("ma5_path_confidence", "SELECT event_id, round(least(1 / (1 + 0.1::DOUBLE * (event_id % 20)), 1), 6) AS c FROM events")
def _(s, d):
    return t(s, d, "events").select("event_id", F.round(C.path_confidence(F.col("event_id") % 20), 6).alias("c"))


@query("ma7_so11_plausible", r"SELECT row_id, round(0.4::DOUBLE * (1 - levenshtein(a, b) / greatest(1, length(a), length(b))::DOUBLE) + 0.3::DOUBLE * (len(list_intersect(x, y)) / greatest(1, len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE) + CASE WHEN same THEN 0.3 ELSE 0 END::DOUBLE, 6) AS score FROM (SELECT row_id, a, b, same, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM (SELECT row_id, commit_message AS a, repository || ' ' || commit_message AS b, coalesce(language IS NOT NULL AND length(vulnerable_code) = length(fixed_code), false) AS same FROM repo_commits WHERE commit_message IS NOT NULL AND repository IS NOT NULL)) ORDER BY score DESC, row_id")
def _(s, d):
    a, b = F.col("commit_message"), F.concat_ws(" ", "repository", "commit_message")
    r = t(s, d, "repo_commits").where("commit_message is not null and repository is not null")
    same = F.col("language").isNotNull() & (F.length("vulnerable_code") == F.length("fixed_code"))
    return r.select("row_id", F.round(C.plausibility(a, b, same), 6).alias("score")).orderBy(F.desc("score"), "row_id")


@query("ma6_ma13_bands", "SELECT event_id, round(v, 6) AS score, CASE WHEN round(v, 6) >= 0.8 THEN 'critical' WHEN round(v, 6) >= 0.6 THEN 'high' WHEN round(v, 6) >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM (SELECT event_id, greatest(0, least(1, value / 100 * 0.6::DOUBLE + (event_id % 10) / 10.0::DOUBLE * 0.4::DOUBLE)) AS v FROM events WHERE value IS NOT NULL)")
def _(s, d):
    v = C.exposure([(F.col("value") / 100, 0.6), ((F.col("event_id") % 10) / 10, 0.4)])
    return t(s, d, "events").where("value is not null").select("event_id", F.round(v, 6).alias("score"), C.banded(F.round(v, 6), [(0.8, "critical"), (0.6, "high"), (0.4, "medium")], "low").alias("band"))


@query("wn14_centred_slice", "SELECT row_id, a, least(n, a + 64) AS z FROM (SELECT row_id, n, greatest(0, least(n, greatest(0, n // 2 - 32) + 64) - 64) AS a FROM (SELECT row_id, len(string_split(code, ' '))::BIGINT AS n FROM train_split WHERE code IS NOT NULL))")
def _(s, d):
    a, z = C.centred_slice(F.size(F.split("code", " ")).cast("long"), 64)
    return t(s, d, "train_split").where("code is not null").select("row_id", a.alias("a"), z.alias("z"))


@query("wn19_line_numbers", "SELECT file_id, line_no, row_number() OVER (PARTITION BY file_id ORDER BY line_no, md5(payload)) - 1 AS ordinal FROM raw_lines")
def _(s, d):
    return Z.numbered(t(s, d, "raw_lines"), ["file_id"], ["line_no", F.md5("payload")]).select("file_id", "line_no", "ordinal")


@query("ss4_resume_by_offset", "SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_type = 'signup')")
def _(s, d):
    e = t(s, d, "events")
    return N.after(e, "event_id", e.where("event_type = 'signup'")).select("event_id")


@query("ss9_line_diff", "SELECT row_id, len(list_distinct(list_filter(b, lambda l: NOT list_contains(a, l)))) AS added, len(list_distinct(list_filter(a, lambda l: NOT list_contains(b, l)))) AS removed FROM (SELECT row_id, string_split(vulnerable_code, chr(10)) AS a, string_split(fixed_code, chr(10)) AS b FROM repo_commits WHERE vulnerable_code IS NOT NULL AND fixed_code IS NOT NULL)")
def _(s, d):
    x = t(s, d, "repo_commits").where("vulnerable_code is not null and fixed_code is not null")
    return x.select("row_id", X.line_changes("vulnerable_code", "fixed_code").alias("c")).select("row_id", "c.*")


@query("gr9_small_graph", "SELECT kind, count(*) AS n, count(DISTINCT src) AS sources FROM (SELECT DISTINCT 'SUPPLIES' AS kind, l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst FROM lineitem UNION SELECT 'HAS_BRAND', p_partkey::VARCHAR, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)) GROUP BY 1")
def _(s, d):
    l = t(s, d, "lineitem").join(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return G.seeded(l, [("SUPPLIES", "l_suppkey", "l_partkey"), ("HAS_BRAND", "l_partkey", "p_brand")]).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))


# ---- inference ------------------------------------------------------------------------------------------------------
@query("pj15_ml10_embeddings", r"SELECT row_id, 64 AS dims, 1.0::DOUBLE AS square FROM train_split WHERE regexp_matches(code, '\S')")
def _(s, d):
    x = t(s, d, "train_split").where("code is not null").select("row_id", M.embedder(limit=None)("code").alias("v")).where("v is not null")
    return x.select("row_id", F.size("v").cast("long").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda a, z: a + z * z), 4).alias("square"))


@query("ml3_fusion_head", "SELECT vec_id, round(greatest(0, 0.5::DOUBLE * a + b) * 2 - greatest(0, a - b) + 1, 3) AS z FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)")
def _(s, d):
    head = M.dense([([[0.5, 1.0], [1.0, -1.0]], [0.0, 0.0]), ([[2.0], [-1.0]], [1.0])])
    x = t(s, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("f"))
    return x.select("vec_id", F.round(F.get(head("f"), F.lit(0)), 3).alias("z"))


@query("ml2_graph_layer", "WITH e AS (SELECT DISTINCT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey), g AS (SELECT src, count(*) AS deg FROM e GROUP BY 1) SELECT e.dst AS node, round(greatest(0, sum(s.s_acctbal / sqrt(g.deg)) / sqrt(any_value(h.deg))), 5) AS h FROM e JOIN g ON g.src = e.src JOIN g h ON h.src = e.dst JOIN supplier s ON s.s_suppkey = e.src GROUP BY 1")
def _(s, d):
    x = t(s, d, "supplier")
    nodes = x.select(F.lit(1).alias("graph"), F.col("s_suppkey").alias("node"), F.array("s_acctbal").alias("h"))
    k = x.select(F.col("s_suppkey").alias("src"), "s_nationkey")
    edges = k.join(k.withColumnRenamed("src", "dst"), "s_nationkey").select(F.lit(1).alias("graph"), "src", "dst")
    return M.graph_layer(nodes, edges).select("node", F.round(F.get("h", F.lit(0)), 5).alias("h"))


@query("ml2_graph_classifier", "WITH e AS (SELECT DISTINCT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND (a.s_suppkey = b.s_suppkey OR a.s_suppkey % 7 = b.s_suppkey % 7)), g AS (SELECT src, count(*) AS deg FROM e GROUP BY 1), l AS (SELECT e.dst AS node, greatest(0, sum(s.s_acctbal / sqrt(g.deg)) / sqrt(any_value(h.deg))) AS h FROM e JOIN g ON g.src = e.src JOIN g h ON h.src = e.dst JOIN supplier s ON s.s_suppkey = e.src GROUP BY 1) SELECT s_nationkey AS graph, round(avg(h) - max(h) + 1, 4) AS z FROM l JOIN supplier ON s_suppkey = node GROUP BY 1")
def _(s, d):
    x = t(s, d, "supplier")
    nodes = x.select(F.col("s_nationkey").alias("graph"), F.col("s_suppkey").alias("node"), F.array("s_acctbal").alias("h"))
    k = x.select(F.col("s_suppkey").alias("src"), "s_nationkey", (F.col("s_suppkey") % 7).alias("m"))
    edges = k.join(k.withColumnRenamed("src", "dst"), ["s_nationkey", "m"]).select(F.col("s_nationkey").alias("graph"), "src", "dst")
    g = M.graph_classifier(nodes, edges, [None], [([[1.0], [-1.0]], [1.0])])
    return g.select("graph", F.round(F.get("logits", F.lit(0)), 4).alias("z"))


@query("ml12_mean_logits", "SELECT user_id, CASE WHEN avg(value) > avg(100 - value) THEN 1 ELSE 0 END AS label FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(s, d):
    x = t(s, d, "events").where("value is not null").select("user_id", F.array(100 - F.col("value"), F.col("value")).alias("z"))
    return M.mean_logits(x, "user_id", "z")


@query("ml13_uncertain_fusion", "SELECT event_id, round((1 - u) * (a + b + c) / 3 + u * (a + b) / 2, 6) AS p FROM (SELECT event_id, value / 100 AS a, (event_id % 10) / 10.0::DOUBLE AS b, (event_id % 7) / 7.0::DOUBLE AS c, (event_id % 5) / 5.0::DOUBLE AS u FROM events WHERE value IS NOT NULL)")
def _(s, d):
    e = F.col("event_id")
    p = C.fused(F.col("value") / 100, (e % 10) / 10.0, (e % 7) / 7.0, (e % 5) / 5.0)
    return t(s, d, "events").where("value is not null").select("event_id", F.round(p, 6).alias("p"))


# ---- functions for SQL ----------------------------------------------------------------------------------------------
@query("ud4_sql_functions")
def _(s, d):
    register(s)
    return s.sql("SELECT row_id, size(risky_spans(vulnerable_code)) AS spans, syntax_counts(vulnerable_code).loops AS loops FROM {x} WHERE vulnerable_code IS NOT NULL", x=t(s, d, "repo_commits"))


@query("ud5_table_function")
def _(s, d):
    register(s)
    x = t(s, d, "repo_commits").where(X.source_language("language", "file_path") == "python")
    return s.sql("SELECT kind, count(*) AS n FROM {x}, LATERAL python_nodes(vulnerable_code) GROUP BY kind", x=x)


@query("ud2_any_key", "SELECT min(row_id) AS row_id FROM repo_commits WHERE commit_sha IS NOT NULL GROUP BY md5(commit_sha) UNION ALL SELECT row_id FROM repo_commits WHERE commit_sha IS NULL")
def _(s, d):
    return R.dedup_first(t(s, d, "repo_commits").select("row_id", "commit_sha"), "commit_sha", "row_id").select("row_id")


@query("mp1_ordered_hints", "SELECT row_id, " + "CASE " + " ".join(f"WHEN contains(lower(code), {q(h)}) THEN {q(v)}" for h, v in (("memcpy", "copy"), ("snprintf", "format"), ("switch", "branch"))) + " ELSE 'none' END AS hint FROM train_split")
def _(s, d):
    return t(s, d, "train_split").select("row_id", X.first_keyword(F.col("code"), {"copy": ["memcpy"], "format": ["snprintf"], "branch": ["switch"]}, "none").alias("hint"))


# ---- reports --------------------------------------------------------------------------------------------------------
@query("sk7_json_report", "SELECT json_object('source', coalesce(lower(trim(source)), 'unknown'), 'n', count(*))::VARCHAR AS document FROM samples GROUP BY coalesce(lower(trim(source)), 'unknown')")
def _(s, d):
    g = t(s, d, "samples").groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
    return g.select(F.to_json(F.struct("source", "n")).alias("document"))


@query("sk6_sk17_table_rows", "SELECT '| ' || split || ' | ' || n || ' | ' || format('{:.2f}', 100.0 * n / sum(n) OVER ()) || ' |' AS line FROM (SELECT 'train' AS split, count(*) AS n FROM train_split UNION ALL SELECT 'valid', count(*) FROM valid_split UNION ALL SELECT 'test', count(*) FROM test_split)")
def _(s, d):
    parts = [t(s, d, f"{n}_split").agg(F.count("*").alias("n")).select(F.lit(n).alias("split"), "n") for n in ("train", "valid", "test")]
    pct = F.format_string("%.2f", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))
    return R.union_all(parts).select(F.concat(F.lit("| "), "split", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), pct, F.lit(" |")).alias("line"))


@query("pj16_pj17_json_audit", "SELECT 0 AS problems, 13 AS columns")
def _(s, d):
    from ..sources.records import json_problems

    x = t(s, d, "samples")
    return s.createDataFrame([(len(json_problems(x)), len(x.columns))], "problems long, columns long")


@query("ud6_grouped_aggregate", "SELECT user_id, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 6) AS spread FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(s, d):
    x = t(s, d, "events").where("value is not null")
    return x.groupBy("user_id").agg(F.round(F.percentile("value", 0.9) - F.percentile("value", 0.1), 6).alias("spread"))


@query("ss10_batch_gate", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def _(s, d):
    base = _new(s, "gate")
    streams.gated(streams.event_stream(s, d), base, 100, f"{base}/state").awaitTermination()
    return s.read.parquet(f"{base}/synced").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("ag39_risk_groups", "SELECT upper(trim(severity)) AS level, count(*) AS n, round(avg(weight), 6) AS mean_score, list_sort(list({'a': -weight, 'b': sample_id}))[1:10].list_transform(lambda e: e.b) AS top FROM samples WHERE severity IS NOT NULL AND weight IS NOT NULL GROUP BY 1")
def _(s, d):
    return N.risk_groups(t(s, d, "samples"), F.upper(F.trim("severity")), F.col("weight"), "sample_id")


@query("ml11_multi_seed_summary", "SELECT metric, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most, arg_max(user_id, (v, -user_id)) AS best_seed FROM (SELECT user_id, unnest(['events', 'mean_value']) AS metric, unnest([count(*)::DOUBLE, round(avg(value), 6)]) AS v FROM events WHERE user_id IS NOT NULL GROUP BY 1) WHERE v IS NOT NULL GROUP BY 1")
def _(s, d):
    x = t(s, d, "events").where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean_value"))
    return N.multi_seed_summary(x, "user_id", ["events", "mean_value"])


@query("ml5_range_test", "WITH x AS (SELECT user_id, event_id, value FROM events WHERE value > 0 AND event_id > 0), o AS (SELECT user_id, event_id, value > 4 * min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS off FROM x), s AS (SELECT user_id, min(event_id) AS stopped FROM o WHERE off GROUP BY 1), k AS (SELECT x.*, stopped FROM x LEFT JOIN s USING (user_id) WHERE stopped IS NULL OR event_id < stopped), f AS (SELECT user_id, event_id, stopped, (lead(value) OVER w - value) / (ln(lead(event_id) OVER w) - ln(event_id)) AS slope FROM k WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, arg_min(event_id, (slope, event_id)) AS suggested, any_value(stopped) AS stopped FROM f WHERE slope IS NOT NULL GROUP BY 1")
def _(s, d):
    return Z.range_test(t(s, d, "events").where("value > 0 and event_id > 0").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("sk15_snapshots", "SELECT part, count(*) AS n FROM (SELECT 'snapshot=2' AS part FROM samples WHERE sample_id % 2 = 0 UNION ALL SELECT 'snapshot=3' FROM samples) GROUP BY 1")
def _(s, d):
    path, x = _new(s, "snapshots"), t(s, d, "samples").select("sample_id")
    for at, rows in (("1", x.where("sample_id % 5 = 0")), ("2", x.where("sample_id % 2 = 0")), ("3", x)):
        writers.write_snapshot(rows, path, at, keep=2)
    return s.read.schema("sample_id long").parquet(f"{path}/snapshot=*").groupBy(F.regexp_extract(F.col("_metadata.file_path"), "(snapshot=[0-9]+)/", 1).alias("part")).agg(F.count("*").alias("n"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
