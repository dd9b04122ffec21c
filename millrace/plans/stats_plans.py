"""Queries of deduplication, sampling, counting, evaluation and ordered series, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scores as S
from ..functions import text as X
from ..operators import counting as N
from ..operators import relational as R
from ..operators import series as Z
from ..operators import stats as A
from ..runtime import table as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


SRC = "coalesce(lower(trim(source)), 'unknown')"


def src():
    return F.coalesce(F.lower(F.trim("source")), F.lit("unknown"))


# ---- deduplication, sets, sampling --------------------------------------------------------------------------------
@query("ds1_first_wins", "SELECT sample_id FROM samples WHERE code IS NULL UNION ALL SELECT min(sample_id) FROM samples WHERE code IS NOT NULL GROUP BY md5(code)")
def _(s, d):
    return R.dedup_first(t(s, d, "samples").select("sample_id", "code"), "code", "sample_id").select("sample_id")


@query("ds2_ds3_union", "SELECT 'train' AS src, row_id, code IS NULL AS no_code FROM train_split UNION ALL SELECT 'valid', row_id, code IS NULL FROM valid_split UNION ALL SELECT 'test', row_id, code IS NULL FROM test_split")
def _(s, d):
    return R.union_all([t(s, d, f"{n}_split").select(F.lit(n).alias("src"), "row_id", F.col("code").isNull().alias("no_code")) for n in ("train", "valid", "test")])


@query("ds4_types", "SELECT DISTINCT lower(trim(vulnerability_type)) AS type FROM samples WHERE vulnerability_type IS NOT NULL")
def _(s, d):
    return t(s, d, "samples").where("vulnerability_type is not null").select(N.plain("vulnerability_type").alias("type")).distinct()


_HASH = "md5('42:' || cast({} AS VARCHAR))"


@query("ds5_ds6_balanced", f"WITH x AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format('sample_id')}) AS r FROM samples WHERE label IN (0, 1)) SELECT sample_id, label FROM x WHERE r <= (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) FROM x)")
def _(s, d):
    return R.balanced_sample(t(s, d, "samples").select("sample_id", "label"), "label", "sample_id")


@query("ds7_ratio_split", f"SELECT sample_id, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'valid' END AS split FROM (SELECT sample_id, row_number() OVER (ORDER BY {_HASH.format('sample_id')}) AS r, count(*) OVER () AS n FROM samples)")
def _(s, d):
    return R.ratio_split(t(s, d, "samples").select("sample_id"), "sample_id", {"train": 0.8, "valid": 0.2})


@query("ds8_stratified_split", f"SELECT sample_id, label, CASE WHEN r <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN r <= floor(n * cast(0.85 AS DOUBLE) + 1e-9) THEN 'valid' ELSE 'test' END AS split FROM (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format('sample_id')}) AS r, count(*) OVER (PARTITION BY label) AS n FROM samples)")
def _(s, d):
    return R.ratio_split(t(s, d, "samples").select("sample_id", "label"), "sample_id", {"train": 0.7, "valid": 0.15, "test": 0.15}, by=["label"])


@query("ds9_weighted_resample")
def _(s, d):
    x = t(s, d, "samples").select("sample_id", "label")
    return R.weighted_resample(x, "label", "sample_id", x.count()).select("draw", "sample_id", "label")


@query("ds10_even_quota", "SELECT type, cast(1000 // n + CASE WHEN r <= 1000 % n THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT type, row_number() OVER (ORDER BY type) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT lower(trim(vulnerability_type)) AS type FROM samples WHERE vulnerability_type IS NOT NULL))")
def _(s, d):
    x = t(s, d, "samples").where("vulnerability_type is not null").select(F.lower(F.trim("vulnerability_type")).alias("type"))
    return R.even_quota(x, "type", 1000)


@query("ds11_token_jaccard", r"WITH x AS (SELECT row_id, list_distinct(list_filter(regexp_split_to_array(vulnerable_code, '\s+'), lambda a: a <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(fixed_code, '\s+'), lambda a: a <> '')) AS b FROM repo_commits WHERE vulnerable_code IS NOT NULL AND fixed_code IS NOT NULL) SELECT row_id, round(len(list_intersect(a, b)) / greatest(1, len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) AS jaccard FROM x")
def _(s, d):
    x = t(s, d, "repo_commits").where("vulnerable_code is not null and fixed_code is not null")
    return x.select("row_id", F.round(N.word_jaccard("vulnerable_code", "fixed_code"), 6).alias("jaccard"))


@query("ds12_pj10_counterpart_rows", "SELECT row_id, 1 AS label, md5(vulnerable_code) AS code_md5, md5(fixed_code) AS other_md5 FROM repo_commits WHERE vulnerable_code IS NOT NULL AND fixed_code IS NOT NULL UNION ALL SELECT row_id, 0, md5(fixed_code), md5(vulnerable_code) FROM repo_commits WHERE vulnerable_code IS NOT NULL AND fixed_code IS NOT NULL")
def _(s, d):
    return N.counterpart_rows(t(s, d, "repo_commits"), "row_id", "vulnerable_code", "fixed_code")


_CELL = "lower(metadata.ecosystem) AS eco, upper(severity) AS sev"


@query("ds13_jn7_wn3_cell_quota", f"SELECT eco, sev, sample_id FROM (SELECT {_CELL}, sample_id, row_number() OVER (PARTITION BY lower(metadata.ecosystem), upper(severity) ORDER BY sample_id) AS r FROM samples WHERE lower(metadata.ecosystem) IN ('npm','pip','go') AND upper(severity) IN ('HIGH','CRITICAL')) WHERE r <= 20")
def _(s, d):
    x = t(s, d, "samples").select(F.lower("metadata.ecosystem").alias("eco"), F.upper("severity").alias("sev"), "sample_id").where("eco in ('npm','pip','go') and sev in ('HIGH','CRITICAL')")
    return R.top_per_group(x, ["eco", "sev"], ["sample_id"], 20).select("eco", "sev", "sample_id")


@query("ds14_round_robin", "SELECT sample_id, ['concat','format','param'][1 + sample_id % 3] AS pattern FROM samples")
def _(s, d):
    return t(s, d, "samples").select("sample_id", N.round_robin(F.col("sample_id"), ["concat", "format", "param"]).alias("pattern"))


# ---- joins --------------------------------------------------------------------------------------------------------
@query("jn1_append_new", "SELECT row_id, code IS NULL AS no_code FROM valid_split v WHERE NOT EXISTS (SELECT 1 FROM train_split t WHERE t.code = v.code)")
def _(s, d):
    return R.append_new(t(s, d, "train_split"), t(s, d, "valid_split"), "code").select("row_id", F.col("code").isNull().alias("no_code"))


_PRED = "(SELECT user_id AS row_id, 1 + event_id % 3 AS seed, (value - floor(value / 100) * 100) / 100 AS prob, CAST(user_id % 2 AS INTEGER) AS label FROM events WHERE value IS NOT NULL)"


def preds(s, d):
    """Predictions made of events: users are rows, three seeds, probabilities from values, the label from the user."""
    v = F.col("value")
    return t(s, d, "events").where("value is not null").select(F.col("user_id").alias("row_id"), (F.lit(1) + F.col("event_id") % 3).alias("seed"), ((v - F.floor(v / 100) * 100) / 100).alias("prob"), (F.col("user_id") % 2).cast("int").alias("label"))


@query("jn2_ag21_ensemble_mean", f"SELECT row_id, round(avg(prob), 6) AS prob, max(label) AS label FROM {_PRED} GROUP BY 1")
def _(s, d):
    return A.ensemble_mean(preds(s, d), "row_id", "prob", "label").withColumn("prob", F.round("prob", 6))


@query("jn3_misaligned", f"SELECT row_id, count(DISTINCT label) AS labels, count(*) AS n FROM {_PRED} GROUP BY 1 HAVING count(DISTINCT label) > 1 OR count(*) <> 3")
def _(s, d):
    return A.misaligned(preds(s, d), "row_id", "label", 3)


@query("jn5_cwe_types", "SELECT sample_id, json_extract_string(attrs, '$.cwe') AS cwe, CASE json_extract_string(attrs, '$.cwe') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.CWE_TYPES.items()) + " END AS type FROM samples WHERE attrs IS NOT NULL AND json_extract_string(attrs, '$.cwe') IS NOT NULL")
def _(s, d):
    x = t(s, d, "samples").select("sample_id", F.get_json_object("attrs", "$.cwe").alias("cwe")).where("cwe is not null")
    return N.looked_up(x, "cwe", K.CWE_TYPES, "type").select("sample_id", "cwe", "type")


@query("jn6_overlaps", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events) a JOIN (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events) b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.s + 3600 AND b.s < a.s + 3600")
def _(s, d):
    e = t(s, d, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"))
    a = e.select(F.col("event_id").alias("a_id"), "user_id", F.col("s").alias("a_s"), (F.col("s") + 3600).alias("a_e"))
    b = e.select(F.col("event_id").alias("b_id"), "user_id", F.col("s").alias("b_s"), (F.col("s") + 3600).alias("b_e"))
    return R.overlapping(a, b, "a_s", "a_e", "b_s", "b_e", 3600, "user_id").where("a_id < b_id").select("a_id", "b_id")


@query("jn9_concat_features", "SELECT t.row_id, len(string_split(t.code, ' ')) + len(string_split(t.id, '-')) AS n FROM train_split t JOIN train_split u USING (row_id) WHERE t.code IS NOT NULL")
def _(s, d):
    x = t(s, d, "train_split")
    j = N.joined_features(x.where("code is not null").select("row_id", F.split("code", " ").alias("a")), x.select("row_id", F.split("id", "-").alias("b")), "row_id")
    return j.select("row_id", F.size("features").cast("long").alias("n"))


@query("jn10_optional_match", "SELECT s_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT o_custkey) AS customers FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 45 LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' GROUP BY 1")
def _(s, d):
    l = t(s, d, "lineitem").where("l_quantity > 45").select("l_suppkey", "l_partkey", "l_orderkey")
    o = t(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return N.optional_counts(t(s, d, "supplier"), "s_suppkey", l, "l_suppkey", o, "l_orderkey", "o_orderkey", "l_partkey", "o_custkey")


@query("jn11_upsert", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type = 'view' DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(s, d):
    e = t(s, d, "events").select("user_id", "event_id", "ts", "event_type")
    v = F.struct("ts", "event_id")
    a, b = e.where("event_type <> 'view' or event_type is null"), e.where("event_type = 'view'")
    return R.upsert(a.withColumn("v", v), b.withColumn("v", v), "user_id", "v").select("user_id", "event_id")


@query("jn12_counterpart", "SELECT a.row_id, md5(b.code) AS other FROM train_split a JOIN train_split b ON a.row_id // 4 = b.row_id // 4 AND a.label = 1 - b.label WHERE b.code IS NOT NULL")
def _(s, d):
    return N.counterparts(t(s, d, "train_split").withColumn("pair", F.expr("row_id div 4")), "row_id", "pair", "label", "code")


@query("jn13_missing_cells", "SELECT r.run_id, m.collector FROM (SELECT DISTINCT run_id FROM collection_results) r, mix_targets m WHERE NOT EXISTS (SELECT 1 FROM collection_results c WHERE c.run_id = r.run_id AND list_contains(list_transform(map_keys(c.collectors), lambda k: lower(trim(k))), m.collector))")
def _(s, d):
    return N.missing_collectors(t(s, d, "collection_results"), t(s, d, "mix_targets"), "collector")


# ---- counts -------------------------------------------------------------------------------------------------------
@query("ag1_source_shares", f"SELECT {SRC} AS source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM samples GROUP BY 1")
def _(s, d):
    return A.shares(t(s, d, "samples"), src(), "source")


@query("ag2_success_rate", "SELECT count(*) FILTER (success) AS ok, count(*) AS n, CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (success) / count(*), 4) ELSE 0 END AS pct FROM (SELECT unnest(map_values(collectors), recursive := true) FROM collection_results)")
def _(s, d):
    return N.success_rate(N.collectors(t(s, d, "collection_results")), F.col("c.success"))


@query("ag3_grouping_sets", f"SELECT {SRC} AS source, upper(severity) AS severity, count(*) AS n, grouping({SRC}) AS g1, grouping(upper(severity)) AS g2 FROM samples GROUP BY GROUPING SETS (({SRC}), (upper(severity)), ())")
def _(s, d):
    return N.one_way_totals(t(s, d, "samples").select(src().alias("source"), F.upper("severity").alias("severity")), "source", "severity")


@query("ag4_type_by_label", "SELECT lower(trim(vulnerability_type)) AS type, count(*) FILTER (label = 1) AS vulnerable, count(*) FILTER (label = 0) AS safe, round(avg(length(code)), 4) AS mean_length FROM samples GROUP BY 1")
def _(s, d):
    return N.counts(t(s, d, "samples"), {"type": N.plain("vulnerability_type")}, {"vulnerable": F.col("label") == 1, "safe": F.col("label") == 0}, {"mean_length": F.length("code")}, None, 4)


@query("ag5_split_rollup", "SELECT split, count(*) AS total, count(*) FILTER (label = 1) AS vulnerable, count(*) FILTER (label = 0) AS safe FROM (SELECT metadata.split AS split, label FROM train_split UNION ALL SELECT metadata.split, label FROM valid_split UNION ALL SELECT metadata.split, label FROM test_split) GROUP BY ROLLUP (split)")
def _(s, d):
    return N.label_rollup(R.union_all([t(s, d, f"{n}_split").select("metadata.split", "label") for n in ("train", "valid", "test")]), "split", "label")


@query("ag6_run_summary", "SELECT run_id, epoch_us(written_at) AS at, count(*) FILTER (coalesce(c.success, false)) AS ok, count(*) FILTER (NOT coalesce(c.success, false)) AS failed, cast(coalesce(sum(c.samples_collected) FILTER (c.success), 0) AS BIGINT) AS collected, cast(coalesce(sum(c.target_samples), 0) AS BIGINT) AS target FROM (SELECT run_id, written_at, unnest(map_values(collectors)) AS c FROM (SELECT DISTINCT ON (run_id, written_at) * FROM collection_results ORDER BY run_id, written_at, cast(collectors AS VARCHAR))) GROUP BY ALL HAVING max(1) = 0")
def _(s, d):
    return N.run_summary(t(s, d, "collection_results"))


SQL["ag6_run_summary"] = "SELECT run_id, epoch_us(written_at) AS at, count(*) FILTER (coalesce(c.success, false)) AS ok, count(*) FILTER (NOT coalesce(c.success, false)) AS failed, cast(coalesce(sum(c.samples_collected) FILTER (c.success), 0) AS BIGINT) AS collected, cast(coalesce(sum(c.target_samples), 0) AS BIGINT) AS target FROM (SELECT run_id, written_at, unnest(map_values(collectors)) AS c FROM collection_results) GROUP BY 1, 2"


@query("ag7_ag40_collector_rates", "SELECT lower(trim(k)) AS collector, cast(sum(coalesce(c.samples_collected, 0)) AS BIGINT) AS collected, cast(sum(coalesce(c.target_samples, 0)) AS BIGINT) AS target, count(*) FILTER (c.status = 'error') AS errors, CASE WHEN sum(c.duration) > 0 THEN round(sum(coalesce(c.samples_collected, 0)) / sum(c.duration), 4) ELSE 0 END AS per_second FROM (SELECT unnest(map_keys(collectors)) AS k, unnest(map_values(collectors)) AS c FROM collection_results) GROUP BY 1")
def _(s, d):
    return N.collector_rates(t(s, d, "collection_results"))


@query("ag8_weighted_sum", "SELECT run_id, cast(floor(round(sum(coalesce(c.samples_collected, 0) * CASE lower(trim(k)) WHEN 'cve' THEN 0.25 WHEN 'github' THEN 0.35 WHEN 'repo' THEN 0.82 WHEN 'synthetic' THEN 1.0 ELSE 0 END), 6)) AS BIGINT) AS pairs FROM (SELECT run_id, unnest(map_keys(collectors)) AS k, unnest(map_values(collectors)) AS c FROM collection_results) GROUP BY 1")
def _(s, d):
    return N.weighted_total(t(s, d, "collection_results"), K.PAIR_RATES, "pairs")


@query("ag9_per_repository", "SELECT coalesce(repository, 'unknown') AS repository, coalesce(vulnerability_type, 'unknown') AS type, count(*) AS n FROM repo_commits GROUP BY 1, 2")
def _(s, d):
    named = lambda c: F.coalesce(c, F.lit("unknown"))
    return N.counts(t(s, d, "repo_commits"), {"repository": named("repository"), "type": named("vulnerability_type")})


@query("ag10_ag11_graph_sizes", "SELECT count(*) AS n, round(avg(x), 6) AS mean, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.95) AS p95, cast(max(x) AS BIGINT) AS most, cast(greatest(1, least(64, floor(8e9 / (quantile_cont(x, 0.95) * 1024)))) AS BIGINT) AS batch FROM (SELECT cast(metadata.num_ast_nodes AS DOUBLE) AS x FROM train_split) WHERE x IS NOT NULL")
def _(s, d):
    return A.size_summary(t(s, d, "train_split").select(F.col("metadata.num_ast_nodes").cast("double").alias("x")), "x")


@query("ag12_ag44_parse_success", "SELECT count(*) AS processed, count(*) FILTER (metadata.ast_success) AS success, count(*) FILTER (NOT metadata.ast_success) AS fallback, count(*) FILTER (code <> '') AS with_code FROM train_split")
def _(s, d):
    ok = F.col("metadata.ast_success")
    return N.counts(t(s, d, "train_split"), {}, {"success": ok, "fallback": ~ok, "with_code": F.col("code") != ""}, total="processed")


@query("ag13_mean_nodes", "SELECT label, round(avg(metadata.num_ast_nodes), 6) AS mean_nodes, round(avg(metadata.num_tokens), 6) AS mean_tokens FROM train_split GROUP BY 1")
def _(s, d):
    return N.counts(t(s, d, "train_split"), {"label": "label"}, means={"mean_nodes": "metadata.num_ast_nodes", "mean_tokens": "metadata.num_tokens"}, total=None)


_CONF = f"SELECT count(*) FILTER (label=0 AND prob<0.5) AS tn, count(*) FILTER (label=0 AND prob>=0.5) AS fp, count(*) FILTER (label=1 AND prob<0.5) AS fn, count(*) FILTER (label=1 AND prob>=0.5) AS tp FROM {_PRED}"
_SCORES = "tn, fp, fn, tp, round(CASE WHEN tp+fp>0 THEN tp/(tp+fp)::DOUBLE ELSE 0 END,6) AS precision, round(CASE WHEN tp+fn>0 THEN tp/(tp+fn)::DOUBLE ELSE 0 END,6) AS recall, round(CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn)::DOUBLE ELSE 0 END,6) AS f1, round((CASE WHEN tp+fn>0 THEN tp/(tp+fn)::DOUBLE ELSE 0 END + CASE WHEN tn+fp>0 THEN tn/(tn+fp)::DOUBLE ELSE 0 END)/2,6) AS balanced_accuracy, round(CASE WHEN tp+tn+fp+fn>0 THEN (tp+tn)/(tp+tn+fp+fn)::DOUBLE ELSE 0 END,6) AS accuracy"


@query("ag14_ag16_confusion", f"SELECT {_SCORES} FROM ({_CONF})")
def _(s, d):
    return A.scores(A.confusion(preds(s, d).withColumn("hat", (F.col("prob") >= 0.5).cast("int")), "label", "hat"))


@query("ag31_prediction_counts", f"SELECT seed, count(*) FILTER (prob >= 0.5) AS said_1, count(*) FILTER (prob < 0.5) AS said_0, count(*) FILTER (label = 1) AS is_1 FROM {_PRED} GROUP BY 1")
def _(s, d):
    return N.counts(preds(s, d), {"seed": "seed"}, {"said_1": F.col("prob") >= 0.5, "said_0": F.col("prob") < 0.5, "is_1": F.col("label") == 1}, total=None)


@query("ag17_auc", f"WITH g AS (SELECT prob, count(*) FILTER (label=1) AS p, count(*) FILTER (label=0) AS n FROM {_PRED} GROUP BY 1), h AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g) SELECT round(sum(p * (b + n / 2.0::DOUBLE)) / (sum(p) * sum(n)), 6) AS auc FROM h")
def _(s, d):
    return A.roc_auc(preds(s, d), "label", "prob")


def _sweep_sql(low, high):
    return f"SELECT pct, pct / 100.0::DOUBLE AS threshold, {_SCORES} FROM (SELECT pct, count(*) FILTER (label=0 AND prob < pct/100.0::DOUBLE) AS tn, count(*) FILTER (label=0 AND prob >= pct/100.0::DOUBLE) AS fp, count(*) FILTER (label=1 AND prob < pct/100.0::DOUBLE) AS fn, count(*) FILTER (label=1 AND prob >= pct/100.0::DOUBLE) AS tp FROM {_PRED}, range({low}, {high + 1}) r(pct) GROUP BY 1)"


@query("ag18_threshold_sweep", _sweep_sql(30, 70))
def _(s, d):
    return A.threshold_sweep(preds(s, d), "label", "prob")


@query("ag19_wide_sweep", f"SELECT * FROM ({_sweep_sql(5, 95)}) WHERE pct % 5 = 0")
def _(s, d):
    return A.threshold_sweep(preds(s, d), "label", "prob", 5, 95).where("pct % 5 = 0")


@query("ag20_best_threshold", f"SELECT * FROM ({_sweep_sql(30, 70)}) ORDER BY f1 DESC, pct LIMIT 1")
def _(s, d):
    return A.best_threshold(A.threshold_sweep(preds(s, d), "label", "prob"))


@query("ag22_ag43_seed_spread", f"SELECT round(avg(m), 6) AS mean, CASE WHEN count(m) > 1 THEN round(stddev_pop(m), 6) ELSE 0 END AS std FROM (SELECT seed, avg(prob) AS m FROM {_PRED} GROUP BY 1)")
def _(s, d):
    return N.seed_spread(preds(s, d), "seed", "prob")


@query("ag23_best_seed", f"SELECT seed, round(m, 6) AS score FROM (SELECT seed, avg(prob) AS m FROM {_PRED} GROUP BY 1) ORDER BY m DESC, seed LIMIT 1")
def _(s, d):
    return N.best_seed(preds(s, d), "seed", "prob")


@query("ag24_bootstrap")
def _(s, d):
    return A.bootstrap_mean(t(s, d, "train_split").select("row_id", F.col("metadata.num_tokens").alias("v")), "v", "row_id")


_PAIRED = f"SELECT a, b - a AS d FROM (SELECT row_id, avg(prob) FILTER (seed = 1) AS a, avg(prob) FILTER (seed = 2) AS b FROM {_PRED} GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL"


@query("ag25_paired_t")
def _(s, d):
    x = preds(s, d).groupBy("row_id").pivot("seed", [1, 2]).agg(F.avg("prob"))
    return A.paired_t(x, "1", "2")


# all but the tail of the t distribution, which SQL does not have
@query("ag25_paired_differences", f"SELECT n, round(m, 6) AS mean_diff, round(sd, 6) AS sd, round(m - 1.96 * sd / sqrt(n), 6) AS low, round(m + 1.96 * sd / sqrt(n), 6) AS high, round(100 * m / abs(base), 6) AS improvement_pct, round(m / (sd / sqrt(n)), 6) AS t FROM (SELECT count(*) AS n, avg(a) AS base, avg(d) AS m, stddev_samp(d) AS sd FROM ({_PAIRED}))")
def _(s, d):
    x = preds(s, d).groupBy("row_id").pivot("seed", [1, 2]).agg(F.avg("prob"))
    return A.paired_t(x, "1", "2").drop("p", "significant")


@query("ag26_class_weights", "SELECT label, n, round(least(5.0, sum(n) OVER () / (2.0 * n) * CASE WHEN label = 1 THEN 1.5 ELSE 1.0 END), 6)::DOUBLE AS weight FROM (SELECT label, count(*) AS n FROM train_split WHERE label IN (0, 1) GROUP BY 1)")
def _(s, d):
    return A.class_weights(t(s, d, "train_split"), "label", 1.5)


@query("ag27_lengths", "SELECT min(length(code)) AS least, max(length(code)) AS most, cast(floor(sum(length(code)) / count(code)) AS BIGINT) AS mean FROM samples")
def _(s, d):
    return N.length_summary(t(s, d, "samples"), "code")


@query("ag28_years_and_platforms", "SELECT strftime(collected_at, '%Y') AS year, split_part(lower(trim(source)), ':', 1) AS platform, count(*) AS n FROM samples WHERE code IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return N.counts(t(s, d, "samples").where("code is not null"), {"year": Z.year("collected_at"), "platform": F.substring_index(N.plain("source"), ":", 1)})


@query("ag29_wn21_best_epoch", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS best_event, max(value) AS best, min(value) AS worst, arg_max(value, event_id) AS last_value FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(s, d):
    return N.extremes(t(s, d, "events"), "user_id", "event_id", "value")


@query("ag30_ablation", "SELECT event_type, round(avg(value), 6) AS score, round(100 * (avg(value) - (SELECT avg(value) FROM events WHERE event_type = 'view')) / (SELECT avg(value) FROM events WHERE event_type = 'view'), 4) AS gain_pct FROM events GROUP BY 1")
def _(s, d):
    return N.ablation(t(s, d, "events"), "event_type", "value", "view")


@query("ag32_mean_loss", "SELECT round(avg(m), 6) AS of_batches, round(sum(s) / sum(n), 6) AS of_rows FROM (SELECT event_id // 64 AS b, avg(value) AS m, sum(value) AS s, count(value) AS n FROM events GROUP BY 1)")
def _(s, d):
    return N.mean_loss(t(s, d, "events"), F.expr("event_id div 64"), "value")


@query("ag33_ag42_graph_counts", "SELECT kind, sum(n)::BIGINT AS n FROM (SELECT 'supplier' AS kind, count(DISTINCT l_suppkey) AS n FROM lineitem UNION ALL SELECT 'part', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'supplies', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY ROLLUP (kind)")
def _(s, d):
    return N.graph_counts(t(s, d, "lineitem"), "l_suppkey", "l_partkey", ("supplier", "part", "supplies"))


@query("ag34_action_counts", "SELECT event_type, count(*) AS n, count(*) FILTER (value IS NULL OR value < 10) AS pending, count(*) FILTER (value IS NULL OR value < 10) >= 100 AS ready FROM events GROUP BY 1")
def _(s, d):
    pending = F.col("value").isNull() | (F.col("value") < 10)
    return N.counts(t(s, d, "events"), {"event_type": "event_type"}, {"pending": pending}).withColumn("ready", F.col("pending") >= 100)


@query("ag35_dt4_daily", "SELECT date_trunc('day', ts)::DATE AS day, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def _(s, d):
    return N.counts(t(s, d, "events"), {"day": F.to_date(F.date_trunc("day", "ts"))}, {"purchases": F.col("event_type") == "purchase", "errors": F.col("event_type") == "error"}, total="total")


@query("ag36_so7_every_severity", "SELECT o.s AS severity, o.i AS place, count(x.sample_id) AS n, round(avg(x.weight), 6) AS mean_weight FROM (SELECT unnest(['CRITICAL','HIGH','MEDIUM','LOW','UNKNOWN']) AS s, generate_subscripts(['CRITICAL','HIGH','MEDIUM','LOW','UNKNOWN'], 1) AS i) o LEFT JOIN samples x ON upper(trim(x.severity)) = o.s GROUP BY 1, 2")
def _(s, d):
    return N.every_value(t(s, d, "samples"), F.upper(F.trim("severity")), "severity", K.SEVERITY_ORDER, "sample_id", "weight")


@query("ag37_ag38_impact", "SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders, list_sort(list_distinct(list(l_suppkey)))[1:5] AS first_suppliers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(s, d):
    l = t(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey").join(t(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    tops = R.top_per_group(l.select("p_brand", "l_suppkey").distinct(), ["p_brand"], ["l_suppkey"], 5).groupBy("p_brand").agg(F.array_sort(F.collect_list("l_suppkey")).alias("first_suppliers"))
    return l.groupBy("p_brand").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_orderkey").alias("orders")).join(tops, "p_brand")


@query("ag41_label_type_counts", "SELECT label, lower(trim(vulnerability_type)) AS type, count(*) AS n FROM samples GROUP BY 1, 2")
def _(s, d):
    return N.counts(t(s, d, "samples"), {"label": "label", "type": N.plain("vulnerability_type")})


@query("ag45_ag46_sorted_counts", "SELECT coalesce(vulnerability_type, 'unknown') AS type, count(*) AS n, round(100.0 * count(fixed_code) / count(*), 4) AS pct_fixed FROM repo_commits GROUP BY 1 ORDER BY 1")
def _(s, d):
    x = N.counts(t(s, d, "repo_commits"), {"type": F.coalesce("vulnerability_type", F.lit("unknown"))}, {"fixed": F.col("fixed_code").isNotNull()})
    return x.select("type", "n", S.percent_of("fixed", "n").alias("pct_fixed")).orderBy("type")


@query("ag47_per_file", "SELECT repository, file_path, count(*) AS total, count(*) FILTER (vulnerability_type = 'sql_injection') AS injections FROM repo_commits GROUP BY 1, 2")
def _(s, d):
    return N.counts(t(s, d, "repo_commits"), {"repository": "repository", "file_path": "file_path"}, {"injections": F.col("vulnerability_type") == "sql_injection"}, total="total")


@query("ag49_outcome_rates", "SELECT user_id, count(*) AS n, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate, round(count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE, 6) AS purchase_rate FROM events GROUP BY 1")
def _(s, d):
    return N.rates(t(s, d, "events"), ["user_id"], {"error_rate": F.col("event_type") == "error", "purchase_rate": F.col("event_type") == "purchase"})


@query("ag50_same_behaviour", "SELECT repository, round(avg(CASE WHEN trim(vulnerable_code) = trim(fixed_code) THEN 1.0 ELSE 0.0 END), 6) AS kept FROM repo_commits WHERE fixed_code IS NOT NULL AND vulnerable_code IS NOT NULL GROUP BY 1")
def _(s, d):
    x = t(s, d, "repo_commits").where("fixed_code is not null and vulnerable_code is not null")
    return N.rates(x, ["repository"], {"kept": X.same_text("vulnerable_code", "fixed_code")}).drop("n")


@query("ml7_votes", f"SELECT row_id, round(avg(prob), 6) AS soft, CAST(2 * count(*) FILTER (prob >= 0.5) > count(*) AS INTEGER) AS hard, round(CASE WHEN sum(w) > 0 THEN sum(w * prob) / sum(w) ELSE 0 END, 6) AS weighted, CAST(round(sum(CASE WHEN prob >= 0.5 THEN abs(prob - 0.5) ELSE -abs(prob - 0.5) END), 9) > 0 AS INTEGER) AS confident, round(greatest(count(*) FILTER (prob >= 0.5), count(*) - count(*) FILTER (prob >= 0.5)) / count(*)::DOUBLE, 6) AS agreement FROM (SELECT *, CASE seed WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END::DOUBLE AS w FROM {_PRED}) GROUP BY 1")
def _(s, d):
    return A.vote(preds(s, d), "row_id", "prob", "seed", {1: 0.5, 2: 0.3, 3: 0.2})


@query("ma3_ma4_focal_loss", f"SELECT seed, round(avg(CASE WHEN label = 1 THEN -0.25 * pow(1 - p, 2) * ln(p) ELSE -0.75 * pow(p, 2) * ln(1 - p) END), 6) AS loss FROM (SELECT seed, label, greatest(1e-6, least(1 - 1e-6, prob)) AS p FROM {_PRED}) GROUP BY 1")
def _(s, d):
    return N.counts(preds(s, d), {"seed": "seed"}, means={"loss": S.focal_loss(F.col("prob"), F.col("label"))}, total=None)


# ---- order and series ---------------------------------------------------------------------------------------------
@query("so1_counts_descending", f"SELECT {SRC} AS source, count(*) AS n FROM samples GROUP BY 1 ORDER BY n DESC, 1")
def _(s, d):
    return N.top_values(t(s, d, "samples"), src(), "source")


@query("so2_so3_top_ten", "SELECT metadata.package_name AS package, count(*) AS n FROM samples GROUP BY 1 ORDER BY n DESC, 1 NULLS FIRST LIMIT 10")
def _(s, d):
    return N.top_values(t(s, d, "samples"), F.col("metadata.package_name"), "package", 10)


@query("so4_so5_so6_slice", "SELECT sample_id FROM samples ORDER BY sample_id LIMIT 50 OFFSET 100")
def _(s, d):
    return N.page(t(s, d, "samples").select("sample_id"), ["sample_id"], 50, 100)


@query("so12_pending", "SELECT event_id FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 25")
def _(s, d):
    return N.page(t(s, d, "events").where("event_type = 'signup'"), ["ts", "event_id"], 25).select("event_id")


@query("so13_pattern_search", "SELECT row_id FROM repo_commits WHERE regexp_matches(commit_message, '(?i)prevent.*sql') ORDER BY row_id LIMIT 50")
def _(s, d):
    return N.search(t(s, d, "repo_commits"), "commit_message", "(?i)prevent.*sql", "row_id").select("row_id")


@query("so14_top_by_magnitude", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50) DESC, event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r <= 3")
def _(s, d):
    x = t(s, d, "events").where("value is not null")
    return R.top_per_group(x, ["user_id"], [F.desc(F.abs(F.col("value") - 50)), "event_id"], 3).select("user_id", "event_id")


@query("wn1_wn2_latest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def _(s, d):
    return Z.latest(t(s, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("wn4_wn5_streaks", "SELECT event_id, CASE WHEN b THEN sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isle ORDER BY ts, event_id) ELSE 0 END::BIGINT AS streak FROM (SELECT *, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isle FROM (SELECT event_id, user_id, ts, coalesce(value < 50, false) AS b FROM events))")
def _(s, d):
    x = t(s, d, "events").select("event_id", "user_id", "ts", (F.col("value") < 50).alias("bad"))
    return Z.streaks(x, ["user_id"], ["ts", "event_id"], "bad").select("event_id", "streak")


@query("wn6_spikes", "SELECT event_id FROM (SELECT event_id, coalesce(value > 2.0 * avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), false) AS spike FROM events) WHERE spike")
def _(s, d):
    return Z.spikes(t(s, d, "events"), ["user_id"], ["ts", "event_id"], "value", 2.0).where("spike").select("event_id")


@query("wn7_last_five", "SELECT event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last_types FROM events")
def _(s, d):
    return Z.last_values(t(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", 5).select("event_id", F.col("last").alias("last_types"))


@query("wn8_running_best", "SELECT event_id, best, (row_number() OVER (PARTITION BY user_id, isle ORDER BY ts, event_id) - 1)::BIGINT AS patience FROM (SELECT *, sum(better) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isle FROM (SELECT event_id, user_id, ts, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS best, CASE WHEN coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS better FROM events))")
def _(s, d):
    return Z.running_best(t(s, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "best", F.col("patience").cast("long").alias("patience"))


@query("wn9_ml4_ema", "WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL), e AS (SELECT user_id, event_id, r, value::DOUBLE AS s FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.event_id, o.r, 0.05 * o.value + 0.95 * e.s FROM e JOIN o ON o.user_id = e.user_id AND o.r = e.r + 1) SELECT event_id, round(s, 3) AS ema FROM e")
def _(s, d):
    return Z.ema(t(s, d, "events"), "user_id", "event_id", "value").select("event_id", F.round("ema", 3).alias("ema"))


@query("wn10_steepest", "SELECT user_id, arg_min(event_id, (slope, event_id)) AS at FROM (SELECT user_id, event_id, (lead(value) OVER w - value) / (ln(lead(event_id) OVER w) - ln(event_id)) AS slope FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE slope IS NOT NULL GROUP BY 1")
def _(s, d):
    return Z.steepest(t(s, d, "events"), "user_id", "event_id", "value")


@query("wn11_smooth", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM events WHERE value IS NOT NULL")
def _(s, d):
    return Z.moving_average(t(s, d, "events").where("value is not null"), ["user_id"], ["event_id"], "value", 5).select("event_id", F.round("smooth", 6).alias("smooth"))


@query("wn11_gradient", "SELECT event_id, round(CASE WHEN hd IS NULL THEN dn / hs WHEN hs IS NULL THEN dp / hd ELSE (hd*hd*dn + hs*hs*dp) / (hd*hs*(hd+hs)) END, 6) AS slope FROM (SELECT event_id, (event_id - lag(event_id) OVER w)::DOUBLE AS hd, (lead(event_id) OVER w - event_id)::DOUBLE AS hs, value - lag(value) OVER w AS dp, lead(value) OVER w - value AS dn FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def _(s, d):
    x = t(s, d, "events").where("value is not null").select("user_id", "event_id", F.col("event_id").cast("double").alias("x"), "value")
    return Z.gradient(x, ["user_id"], "x", "value").select("event_id", F.round("slope", 6).alias("slope"))


@query("wn12_cap_and_fallback", "SELECT event_id, CASE WHEN value < 5 THEN 1e-5 ELSE least(value / 1000, 5e-2) END AS lr FROM events WHERE value IS NOT NULL")
def _(s, d):
    return t(s, d, "events").where("value is not null").select("event_id", S.capped_rate(F.col("value"), 1000, 5, 1e-5, 5e-2).alias("lr"))


@query("wn13_divergence", "SELECT user_id, min(event_id) AS stopped FROM (SELECT user_id, event_id, value > 5 * min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS off FROM events WHERE value > 0) WHERE off GROUP BY 1")
def _(s, d):
    return Z.divergence(t(s, d, "events"), "user_id", "event_id", "value", 5)


@query("wn15_rate_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM events")
def _(s, d):
    return Z.rate_window(t(s, d, "events"), "user_id", "ts", 3600).select("event_id", "recent")


@query("wn16_rate_limit")
def _(s, d):
    return Z.accepted(t(s, d, "events"), "user_id", "ts", "event_id", 2, 86_400)


@query("wn17_running_mean", "SELECT event_id, round(sum(value) OVER w, 2) / count(value) OVER w AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(s, d):
    return Z.running_mean(t(s, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "mean")


@query("wn18_merged_ranges", "SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b) AS g FROM (SELECT *, CASE WHEN coalesce(a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 60, true) THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT user_id, event_id AS a, event_id + 40 AS b FROM events))) GROUP BY user_id, g")
def _(s, d):
    x = t(s, d, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + 40).alias("b"))
    return Z.merge_ranges(x, "user_id", "a", "b", 60)


@query("wn20_last_ten", "SELECT event_id, total FROM (SELECT event_id, count(*) OVER () AS total, row_number() OVER (ORDER BY event_id DESC) AS r FROM events WHERE event_type = 'error') WHERE r <= 10")
def _(s, d):
    return Z.last_rows(t(s, d, "events").where("event_type = 'error'"), "event_id", 10).select("event_id", "total")


@query("ss7_sessions", "SELECT user_id, session::BIGINT AS session, count(*) AS n, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS end_ FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT user_id, ts, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 43200000000, true) THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1, 2")
def _(s, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return Z.sessions(t(s, d, "events"), "user_id", "ts", 43_200).select("user_id", "session", "n", us("start").alias("start"), us("end").alias("end_"))


@query("ss2_merged_state", "SELECT user_id, arg_max(value, ts) FILTER (value IS NOT NULL) AS value, arg_max(event_type, ts) FILTER (event_type IS NOT NULL) AS event_type FROM events GROUP BY 1")
def _(s, d):
    return Z.merge_state(t(s, d, "events"), "user_id", "ts", ["value", "event_type"])


@query("ss6_changed", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 OR coalesce(event_type, '') <> coalesce(p, '')")
def _(s, d):
    return Z.changed(t(s, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id")


@query("dt1_dt3_durations", "SELECT run_id, round((epoch_us(end_time) - epoch_us(start_time)) / 1e6, 6) AS seconds, strftime(start_time, '%Y') AS year FROM collection_results")
def _(s, d):
    return t(s, d, "collection_results").select("run_id", Z.seconds_between("start_time", "end_time").alias("seconds"), Z.year("start_time").alias("year"))


@query("dt5_late_rows", "SELECT sample_id FROM samples WHERE ingested_at - collected_at > INTERVAL 30 DAY")
def _(s, d):
    return t(s, d, "samples").where(Z.later_than("ingested_at", "collected_at", 30)).select("sample_id")


@query("jf1_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(s, d):
    return t(s, d, "events").select("event_id", X.json_first("props", ["$.k"]).alias("k"))


@query("jf2_mp2_first_present", "SELECT sample_id, coalesce(json_extract_string(attrs, '$.range.from'), json_extract_string(attrs, '$.cwe'), 'none') AS v FROM samples")
def _(s, d):
    return t(s, d, "samples").select("sample_id", X.json_first("attrs", ["$.range.from", "$.cwe"], "none").alias("v"))


@query("ar5_ar6_cve_lists", "SELECT sample_id, len(list_filter(metadata.cve_codes, lambda c: starts_with(c, 'CVE-20'))) AS n FROM samples WHERE metadata.cve_codes IS NOT NULL")
def _(s, d):
    return t(s, d, "samples").where("metadata.cve_codes is not null").select("sample_id", F.size(X.starting("metadata.cve_codes", "CVE-20")).cast("long").alias("n"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
