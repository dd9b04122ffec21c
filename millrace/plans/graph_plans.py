"""Queries of record shaping, graphs, vectors and streams, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scores as C
from ..functions import text as X
from ..operators import counting as N
from ..operators import graph as G
from ..operators import relational as R
from ..operators import series as Z
from ..operators import vectors as V
from ..runtime import scratch_dir
from ..runtime import table as t
from ..sources import files
from ..sources import records as P
from ..streaming import progress
from ..streaming import streams as S
from .text_plans import case_keywords, case_suffix, q, strip

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# ---- record shaping: producers' documents are written from the tables, then read like any producer's ---------------
_SHAPED = "sample_id, source, description, severity, ecosystem, vulnerability_type, vulnerable_code, fixed_code, package_name"


def _shaped(df, *more):
    return df.select("sample_id", "source", "description", "severity", "ecosystem", "vulnerability_type", "vulnerable_code", "fixed_code", "package_name", *more)


_DOCS = "samples WHERE orig_id IS NOT NULL AND metadata.package_name <> ''"


@query("pj1_osv_documents", f"SELECT orig_id AS sample_id, 'osv' AS source, {strip('coalesce(vulnerability_type, $$$$) || chr(10) || chr(10) || coalesce(severity, $$$$)')} AS description, CASE WHEN label = 1 THEN 'HIGH' ELSE 'UNKNOWN' END AS severity, metadata.ecosystem AS ecosystem, {case_keywords('coalesce(nullif(severity, $$$$), vulnerability_type)', K.TYPE_KEYWORDS)} AS vulnerability_type, '# Vulnerable package: ' || metadata.package_name || ' (see references)' AS vulnerable_code, '# Fixed package: ' || metadata.package_name || ' (see references)' AS fixed_code, metadata.package_name AS package_name FROM {_DOCS}")
def _(s, d):
    x = t(s, d, "samples").where("orig_id is not null")
    doc = F.to_json(F.struct(F.col("orig_id").alias("id"), F.col("vulnerability_type").alias("summary"), F.col("severity").alias("details"), F.array(F.struct(F.struct(F.col("metadata.package_name").alias("name")).alias("package"))).alias("affected"), F.when(F.col("label") == 1, F.array(F.struct(F.lit("CVSS_V3").alias("type"), F.lit("CVSS:3.1/AV:N/AC:L").alias("score")))).alias("severity")))
    return _shaped(P.from_osv(x.select(doc.alias("j"), F.col("metadata.ecosystem").alias("eco")), "j", F.col("eco")))


_ADV = f"SELECT orig_id AS sample_id, 'github_advisory' AS source, {strip('coalesce(vulnerability_type, $$$$) || chr(10) || chr(10) || coalesce(severity, $$$$)')} AS description, severity, metadata.ecosystem AS ecosystem, {case_keywords('severity', K.TYPE_KEYWORDS)} AS vulnerability_type, '# Vulnerable package: ' || metadata.package_name || ' ' || coalesce(metadata.vulnerable_range, '') AS vulnerable_code, '# Fixed package: ' || metadata.package_name || ' latest' AS fixed_code, metadata.package_name AS package_name FROM {_DOCS}"


@query("pj2_advisories", _ADV)
def _(s, d):
    a = F.struct(F.col("orig_id").alias("ghsaId"), F.col("vulnerability_type").alias("summary"), F.col("severity").alias("description"), "severity")
    doc = F.to_json(F.struct(a.alias("advisory"), F.struct(F.col("metadata.package_name").alias("name"), F.col("metadata.ecosystem").alias("ecosystem")).alias("package"), F.col("metadata.vulnerable_range").alias("vulnerableVersionRange")))
    return _shaped(P.from_advisory(t(s, d, "samples").where("orig_id is not null").select(doc.alias("j")), "j"))


@query("pj3_old_advisories", _ADV)
def _(s, d):
    node = F.struct(F.struct(F.col("metadata.package_name").alias("name"), F.col("metadata.ecosystem").alias("ecosystem")).alias("package"), F.col("metadata.vulnerable_range").alias("vulnerableVersionRange"))
    doc = F.to_json(F.struct(F.col("orig_id").alias("ghsaId"), F.col("vulnerability_type").alias("summary"), F.col("severity").alias("description"), "severity", F.struct(F.array(node).alias("nodes")).alias("vulnerabilities")))
    return _shaped(P.from_old_advisory(t(s, d, "samples").where("orig_id is not null").select(doc.alias("j")), "j"))


@query("pj4_jf2_cve_documents", f"SELECT orig_id AS sample_id, 'nvd' AS source, coalesce(vulnerability_type, '') AS description, coalesce(upper(severity), 'UNKNOWN') AS severity, NULL AS ecosystem, {case_keywords('coalesce(vulnerability_type, $$$$)', K.TYPE_KEYWORDS)} AS vulnerability_type, NULL AS vulnerable_code, NULL AS fixed_code, NULL AS package_name, weight AS cvss_score, len(list_filter([json_extract_string(attrs, '$.cwe')], lambda c: c IS NOT NULL)) AS n_cwes FROM samples WHERE orig_id IS NOT NULL AND orig_id <> ''")
def _(s, d):
    x = t(s, d, "samples").where("orig_id is not null")
    en = lambda v: F.array(F.struct(F.lit("fr").alias("lang"), F.lit("non").alias("value")), F.struct(F.lit("en").alias("lang"), v.alias("value")))
    metric = F.array(F.struct(F.struct(F.upper("severity").alias("baseSeverity"), F.col("weight").alias("baseScore")).alias("cvssData")))
    cve = F.struct(F.col("orig_id").alias("id"), en(F.col("vulnerability_type")).alias("descriptions"), F.array(F.struct(en(F.get_json_object("attrs", "$.cwe")).alias("description"))).alias("weaknesses"), F.struct(metric.alias("cvssMetricV30")).alias("metrics"))
    return _shaped(P.from_cve(x.select(F.to_json(F.struct(cve.alias("cve"))).alias("j")), "j"), "cvss_score", F.size("cwes").cast("long").alias("n_cwes"))


@query("pj5_exploits", f"SELECT 'EDB-' || row_id AS sample_id, 'exploitdb' AS source, commit_message AS description, 'HIGH' AS severity, 'linux' AS ecosystem, {case_keywords('commit_message', K.TYPE_KEYWORDS)} AS vulnerability_type, vulnerable_code, NULL AS fixed_code, NULL AS package_name, {case_suffix('file_path', K.EXPLOIT_LANGUAGES, 'Unknown')} AS language FROM repo_commits WHERE vulnerable_code <> ''")
def _(s, d):
    x = t(s, d, "repo_commits").select(F.col("row_id").cast("string").alias("id"), F.col("commit_message").alias("description"), F.lit("Linux").alias("platform"), "file_path", F.col("vulnerable_code").alias("code"), F.lit("x").alias("author"), F.lit("2031-01-01").alias("date"), F.lit("CVE-2031-12345").alias("codes"))
    return _shaped(P.from_exploits(x), "language")


@query("pj6_pj7_functions", "SELECT 'CODEXGLUE-' || row_id AS sample_id, CASE WHEN label = 1 THEN 'HIGH' ELSE 'SAFE' END AS severity, label, md5(code) AS code_md5 FROM train_split")
def _(s, d):
    return P.from_functions(t(s, d, "train_split"), "CODEXGLUE", "row_id", "code", "label").select("sample_id", "severity", "label", F.md5("code").alias("code_md5"))


@query("pj8_commits", f"SELECT concat_ws(':', repository, commit_sha) AS sample_id, {strip('commit_message')} AS description, lower(trim(language)) AS language, strftime(committed_date, '%Y-%m-%dT%H:%M:%S') AS published_at FROM repo_commits")
def _(s, d):
    return P.from_commits(t(s, d, "repo_commits")).select("sample_id", "description", "language", "published_at")


@query("pj9_preprocessed", "SELECT row_id, 'CODEXGLUE-' || upper(metadata.split) || '-' || coalesce(metadata.orig_id, metadata.split || '_' || row_id) AS id FROM train_split WHERE code <> ''")
def _(s, d):
    orig = F.coalesce("metadata.orig_id", F.concat_ws("_", "metadata.split", F.col("row_id").cast("string")))
    return t(s, d, "train_split").where("code <> ''").select("row_id", F.concat(F.lit("CODEXGLUE-"), F.upper("metadata.split"), F.lit("-"), orig).alias("id"))


@query("pj11_truthy", "SELECT row_id, coalesce(nullif(code, ''), '') = '' AS no_code, coalesce(label, 0) AS label FROM train_split")
def _(s, d):
    return P.truthy_code(t(s, d, "train_split")).select("row_id", (F.col("code") == "").alias("no_code"), "label")


@query("pj13_pad_and_mask", r"SELECT row_id, least(64, n) AS n_real, 64 - least(64, n) AS n_pad FROM (SELECT row_id, len(list_filter(regexp_split_to_array(code, '\s+'), lambda x: x <> '')) AS n FROM train_split WHERE code IS NOT NULL)")
def _(s, d):
    ids = F.transform(X.token_chain("code")["tokens"], lambda w: F.length(w))
    x = t(s, d, "train_split").where("code is not null").select("row_id", P.padded(ids, 64).alias("p"))
    ones = F.aggregate("p.mask", F.lit(0), lambda a, m: a + m)
    return x.select("row_id", ones.cast("long").alias("n_real"), (F.size("p.ids") - ones).cast("long").alias("n_pad"))


@query("pj14_prefixed_text", "SELECT row_id, '# ' || substr(commit_message, 1, 100) || chr(10) || vulnerable_code AS text FROM repo_commits WHERE vulnerable_code IS NOT NULL AND commit_message IS NOT NULL")
def _(s, d):
    return t(s, d, "repo_commits").where("vulnerable_code is not null and commit_message is not null").select("row_id", X.headed("commit_message", "vulnerable_code").alias("text"))


@query("pj18_overlay", "SELECT sample_id, coalesce(language, 'c') AS language, '7' AS loc, 'x' AS tool FROM samples")
def _(s, d):
    base = F.create_map(F.lit("language"), F.lit("c"), F.lit("loc"), F.lit("1"), F.lit("tool"), F.lit("x"))
    own = F.map_filter(F.create_map(F.lit("language"), F.col("language")), lambda k, v: v.isNotNull())
    return t(s, d, "samples").select("sample_id", P.overlay(base, own, F.create_map(F.lit("loc"), F.lit("7"))).alias("m")).select("sample_id", F.col("m.language"), F.col("m.loc"), F.col("m.tool"))


@query("pj19_pj21_fallbacks", "SELECT event_id, coalesce(nullif(value, 0), 0.5) AS truthy, coalesce(value, 0.5) AS present FROM events")
def _(s, d):
    v = (F.col("value"), F.lit(0.5))
    return t(s, d, "events").select("event_id", C.fallback(*v, truthy=True).alias("truthy"), C.fallback(*v, truthy=False).alias("present"))


@query("pj20_ratio_columns", "SELECT run_id, epoch_us(written_at) AS at, round(100.0 * summary.successful_collectors / summary.total_collectors, 4) AS ok_pct, round(100.0 * summary.failed_collectors / summary.total_collectors, 4) AS failed_pct FROM collection_results WHERE summary.total_collectors > 0")
def _(s, d):
    pct = lambda c: C.percent_of(f"summary.{c}", "summary.total_collectors")
    return t(s, d, "collection_results").where("summary.total_collectors > 0").select("run_id", Z.micros("written_at").alias("at"), pct("successful_collectors").alias("ok_pct"), pct("failed_collectors").alias("failed_pct"))


@query("pj22_score_bands", "SELECT sample_id, CASE WHEN weight * 4 >= 9 THEN 'CRITICAL' WHEN weight * 4 >= 7 THEN 'HIGH' WHEN weight * 4 >= 4 THEN 'MEDIUM' WHEN weight * 4 >= 0 THEN 'LOW' ELSE 'UNKNOWN' END AS band FROM samples")
def _(s, d):
    return t(s, d, "samples").select("sample_id", C.banded(F.col("weight") * 4, [(9, "CRITICAL"), (7, "HIGH"), (4, "MEDIUM"), (0, "LOW")], "UNKNOWN").alias("band"))


@query("jf3_serialise", "SELECT sample_id, md5('{\"label\":' || label || ',\"sample_id\":' || sample_id || '}') AS h FROM samples WHERE label IS NOT NULL")
def _(s, d):
    return t(s, d, "samples").where("label is not null").select("sample_id", F.md5(F.to_json(F.struct("label", "sample_id"))).alias("h"))


@query("jf4_polymorphic", "SELECT sample_id, json_type(attrs, '$.range') AS kind, json_extract_string(attrs, '$.range.to') AS upto FROM samples WHERE attrs IS NOT NULL AND json_type(attrs, '$.range') IS NOT NULL")
def _(s, d):
    x = t(s, d, "samples").where("attrs is not null").select("sample_id", X.json_kind("attrs", "$.range").alias("kind"), X.json_first("attrs", ["$.range.to"]).alias("upto"))
    return x.where("kind is not null")


@query("ma1_ma2_clamps", "SELECT event_id, cast(greatest(1, least(64, floor((value * 1024 * 0.7::DOUBLE - 500) / 5))) AS BIGINT) AS batch FROM events WHERE value IS NOT NULL")
def _(s, d):
    return t(s, d, "events").where("value is not null").select("event_id", C.batch_size(F.col("value") * 1024, 0.7, 500, 5).alias("batch"))


@query("ma9_ma10_vector_checks", "SELECT label, round(sqrt(sum(x * x)), 4) AS norm, round(var_pop(x), 6) AS var, count(*) FILTER (isnan(x)) AS nans FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def _(s, d):
    return C.vector_checks(t(s, d, "embeddings"), "label", "embedding")


@query("ma11_clip_factor", "SELECT event_id, CASE WHEN value > 50 THEN 50 / value ELSE 1 END::DOUBLE AS factor FROM events WHERE value IS NOT NULL")
def _(s, d):
    return t(s, d, "events").where("value is not null").select("event_id", C.clip_factor(F.col("value"), 50).alias("factor"))


@query("ma12_scaled_by_largest", "SELECT event_id, round(value / max(abs(value)) OVER (PARTITION BY user_id), 6) AS scaled FROM events WHERE value IS NOT NULL")
def _(s, d):
    return t(s, d, "events").where("value is not null").select("event_id", F.round(C.of_largest(F.col("value"), "user_id"), 6).alias("scaled"))


# ---- graphs -------------------------------------------------------------------------------------------------------
_EDGES = "(SELECT DISTINCT l_suppkey AS src, (l_suppkey * 7 + l_partkey % 3) % (SELECT count(*) FROM supplier) + 1 AS dst FROM lineitem)"


def _edges(s, d):
    n = t(s, d, "supplier").count()
    return t(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_partkey") % 3) % n + 1).alias("dst")).distinct()


def _reach_sql(edges: str, start: str, depth: int, more: str = "") -> str:
    return f"WITH RECURSIVE e AS {edges}, r AS (SELECT {start} AS start, dst AS node, 1 AS depth FROM e WHERE src = {start} UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < {depth}) SELECT start, node, min(depth) AS depth FROM r {more} GROUP BY 1, 2"


@query("gr1_gr4_reach", _reach_sql(_EDGES, "1::BIGINT", 5))
def _(s, d):
    return G.reach(_edges(s, d), s.range(1, 2).select(F.col("id").alias("start")), 5)


@query("gr2_gr5_callers", _reach_sql(f"(SELECT dst AS src, src AS dst FROM {_EDGES})", "1::BIGINT", 3))
def _(s, d):
    return G.reach(_edges(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")), s.range(1, 2).select(F.col("id").alias("start")), 3)


@query("gr3_so8_shortest_to_sinks", _reach_sql(_EDGES, "2::BIGINT", 6, "WHERE node IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)") + " ORDER BY depth, node")
def _(s, d):
    sinks = t(s, d, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("sink"))
    return G.between(_edges(s, d), s.range(2, 3).select(F.col("id").alias("start")), sinks, 6).select("start", "node", "depth").orderBy("depth", "node")


@query("gr6_direct", "SELECT DISTINCT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    return t(s, d, "nation").join(t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).distinct()


@query("gr7_entry_statistics", "SELECT n_name, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _(s, d):
    n = t(s, d, "nation").select("n_name", "n_nationkey")
    # each side is counted on its own, so that the two lists of a nation are not multiplied
    a = t(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count_distinct("s_suppkey").alias("suppliers"))
    b = t(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count_distinct("c_custkey").alias("customers"))
    return n.join(a, "n_nationkey", "left").join(b, "n_nationkey", "left").select("n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("gr8_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return G.duplicate_keys(t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("gr11_marked_nodes", "SELECT s_suppkey, exists(SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount >= 0.1 AND l_quantity >= 50) AS is_sink FROM supplier")
def _(s, d):
    marks = t(s, d, "lineitem").where("l_discount >= 0.1 and l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return G.mark(t(s, d, "supplier").select("s_suppkey"), marks, "s_suppkey", "is_sink")


@query("ar3_ar4_gr10_trees")
def _(s, d):
    py = t(s, d, "repo_commits").where(X.source_language("language", "file_path") == "python")
    x = G.trees(py, "row_id", "vulnerable_code")
    return x.select("row_id", "ok", "how", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"))


@query("ar7_ar8_pooled", "SELECT label, round(sum(a), 3) AS mean_sum, round(sum(b), 3) AS most_sum FROM (SELECT label, i, avg(x) AS a, max(x) AS b FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    x = t(s, d, "embeddings").select("label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    p = G.pool(x, "label", "v")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 3)
    return p.select("label", total("mean").alias("mean_sum"), total("most").alias("most_sum"))


@query("so9_so10_ma8_nearest", "SELECT query, neighbour, similarity FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE r <= 5")
def _(s, d):
    e = t(s, d, "embeddings")
    return V.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)


@query("so10_same_label_nearest", "SELECT query, neighbour, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS k FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, a.label AS la, b.label AS lb, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE r <= 15 AND similarity >= 0.0 AND la = lb) WHERE k <= 5")
def _(s, d):
    from pyspark.sql import Window as W

    e = t(s, d, "embeddings")
    n = V.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 15, 0.0)
    l = e.select("vec_id", "label")
    x = n.join(l.select(F.col("vec_id").alias("query"), F.col("label").alias("la")), "query").join(l.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("lb")), "neighbour").where("la = lb")
    return x.withColumn("k", F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))).where("k <= 5").select("query", "neighbour", "similarity")


# ---- streams: the table's files run through a stream until all is read ----------------------------------------------
@query("ss1_stream_latest", "SELECT user_id, max(epoch_us(ts)) AS at, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    x = S.event_stream(s, d).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return S.run_to_table(x.groupBy("user_id").agg(F.max("at").alias("at"), F.count("*").alias("n")), "complete")


@query("ss1_stream_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    w = S.windowed_counts(S.event_stream(s, d), "ts", "event_type", "1 hour", "1 day")
    return S.run_to_table(w.select(F.unix_micros("start").alias("start"), "event_type", "n"), "complete")


@query("ss6_stream_changes", "SELECT user_id, event_id, c AS event_type FROM (SELECT user_id, event_id, coalesce(event_type, '') AS c, lag(coalesce(event_type, '')) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR c <> p")
def _(s, d):
    return S.run_to_table(S.changes(S.event_stream(s, d).select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type"), "append")


@query("ss7_stream_debounce")
def _(s, d):
    return S.run_to_table(S.debounced(S.event_stream(s, d), "user_id", "ts", "12 hours", "1 hour"), "append")


@query("ss11_stream_alarms")
def _(s, d):
    x = S.event_stream(s, d).select("user_id", "event_id", (F.col("value") < 30).alias("bad"))
    return S.run_to_table(S.alarms(x, "user_id", "event_id", "bad"), "append")


@query("ss3_jn1_resume", "SELECT run_id, k AS collector FROM (SELECT DISTINCT run_id, lower(trim(unnest(map_keys(collectors)))) AS k FROM collection_results) WHERE run_id % 2 = 1")
def _(s, d):
    x = N.collectors(t(s, d, "collection_results"), "run_id").select("run_id", N.plain("k").alias("collector")).distinct()
    path = f"{scratch_dir(s)}/done-{os.urandom(6).hex()}"
    progress.mark_done(progress.remaining(x, path, ["run_id", "collector"]).where("run_id % 2 = 0"), path)
    return progress.remaining(x, path, ["run_id", "collector"])


# ---- sources and sinks ----------------------------------------------------------------------------------------------
@query("sc1_sk1_jsonl_round_trip", "SELECT sample_id, label, md5(code) AS h FROM samples WHERE code IS NOT NULL")
def _(s, d):
    from ..sinks import writers

    path = f"{scratch_dir(s)}/jsonl-{os.urandom(6).hex()}"
    writers.write_jsonl(t(s, d, "samples").where("code is not null").select("sample_id", "label", "code"), path)
    return files.read_jsonl(s, path, "sample_id long, label int, code string").select("sample_id", "label", F.md5("code").alias("h"))


@query("sc2_bad_lines", "SELECT feed, count(*) FILTER (json_valid(payload)) AS good, count(*) FILTER (NOT json_valid(payload)) AS bad FROM raw_lines GROUP BY 1")
def _(s, d):
    path = f"{scratch_dir(s)}/lines-{os.urandom(6).hex()}"
    x = t(s, d, "raw_lines").where("payload is not null")
    x.select("feed", F.col("payload").alias("value")).write.partitionBy("feed").text(path)
    bad = files.rejected(s, path, "id string").select(F.regexp_extract("file", "/feed=([^/]+)/", 1).alias("feed"))
    whole = x.groupBy("feed").agg(F.count("*").alias("n"))
    return whole.join(bad.groupBy("feed").agg(F.count("*").alias("bad")), "feed", "left").select("feed", (F.col("n") - F.coalesce("bad", F.lit(0))).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))


@query("sc3_required_fields", "SELECT file_id, count(*) AS n FROM raw_lines WHERE json_valid(payload) AND json_extract(payload, '$.code') IS NOT NULL AND json_type(payload, '$.code') <> 'NULL' AND json_extract(payload, '$.label') IS NOT NULL AND json_type(payload, '$.label') <> 'NULL' GROUP BY 1")
def _(s, d):
    v = F.try_parse_json("payload")
    x = t(s, d, "raw_lines").select("file_id", F.try_variant_get(v, "$.code", "string").alias("c"), F.try_variant_get(v, "$.label", "string").alias("l"))
    return x.where("c is not null and l is not null").groupBy("file_id").agg(F.count("*").alias("n"))


@query("sc21_catalogue", "SELECT 'samples' AS name, count(*) AS n, 13 AS columns FROM samples UNION ALL SELECT 'repo_commits', count(*), 12 FROM repo_commits UNION ALL SELECT 'documents', count(*), 8 FROM documents")
def _(s, d):
    names = ["samples", "repo_commits", "documents"]
    return files.registry(s, {n: f"{d}/{n}.parquet" for n in names})


@query("sk8_sarif")
def _(s, d):
    from ..sinks import writers

    c = t(s, d, "collection_results").select(F.explode(F.map_values("collectors")).alias("c")).select("c.collector", "c.success", "c.message")
    return writers.sarif(c.groupBy("collector").agg(F.bool_and("success").alias("success"), F.max("message").alias("message")))


@query("sk11_metrics_document")
def _(s, d):
    from ..operators import stats as A
    from ..sinks import writers
    from .stats_plans import preds

    p = preds(s, d)
    return writers.metrics_document(A.scores(A.confusion(p.withColumn("hat", (F.col("prob") >= 0.5).cast("int")), "label", "hat")), A.threshold_sweep(p, "label", "prob"))


@query("ss5_checkpoint_store", "SELECT ecosystem, count(*) AS n FROM (SELECT lower(metadata.ecosystem) AS ecosystem FROM samples) WHERE ecosystem IS NOT NULL GROUP BY 1")
def _(s, d):
    import tempfile

    # two runs over the same partitions: the second goes on after the first two
    with tempfile.TemporaryDirectory() as folder:
        store, x = progress.CheckpointStore(folder), N.counts(t(s, d, "samples").where("metadata.ecosystem is not null"), {"ecosystem": F.lower("metadata.ecosystem")})
        parts = sorted(r[0] for r in x.select("ecosystem").collect())
        out = []
        for most in (2, len(parts)):
            done = (store.load("counts") or {"done": []})["done"]
            for p in [p for p in parts if p not in done][:most]:
                out.append(x.where(F.col("ecosystem") == p))
                done = [*done, p]
                store.save("counts", {"done": done})
    return R.union_all(out)


@query("gr10_definitions")
def _(s, d):
    py = t(s, d, "repo_commits").where(X.source_language("language", "file_path") == "python")
    return G.definitions(py, "row_id", "vulnerable_code")


@query("sk13_graph_tensors", "SELECT s_nationkey AS graph, count(*) AS nodes, sum(CASE WHEN e.src IS NULL THEN 0 ELSE 1 END)::BIGINT AS edges FROM supplier s LEFT JOIN (SELECT s_suppkey AS src FROM supplier a WHERE EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_suppkey = a.s_suppkey + 25)) e ON e.src = s.s_suppkey GROUP BY 1")
def _(s, d):
    from ..sinks import writers

    x = t(s, d, "supplier")
    nodes = x.select(F.col("s_nationkey").alias("graph"), F.col("s_suppkey").alias("node"), F.array("s_acctbal").alias("h"), F.lit(1).alias("y"))
    edges = x.select(F.col("s_nationkey").alias("graph"), F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 25).alias("dst"))
    g = writers.graph_tensors(nodes, edges, "graph", "node", "h", "y")
    return g.select("graph", F.size("x").cast("long").alias("nodes"), F.size("edge_index").cast("long").alias("edges"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
