"""Queries of text filters, classifiers, patches, identifiers and code metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scores as S
from ..functions import text as X
from ..operators import counting as N
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


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case_keywords(col: str, table: dict[str, list[str]], default: str = "unknown") -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({col}), {q(w)})" for w in ws) + f" THEN {q(n)}" for n, ws in table.items()) + f" ELSE {q(default)} END"


def case_suffix(expr: str, table: dict[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({expr}, {q(s)}) THEN {q(v)}" for s, v in table.items()) + f" ELSE {q(default)} END"


def any_suffix(expr: str, ends: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({expr}, {q(e)})" for e in ends) + ")"


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def strip(c: str) -> str:
    return _STRIP.format(c)


@query("fl1_quality", f"SELECT sample_id, coalesce(length({strip('code')}) BETWEEN 50 AND 10000 AND length(regexp_replace(code, '\\s+', '', 'g')) >= 25, false) AS ok FROM samples")
def _(s, d):
    return t(s, d, "samples").select("sample_id", X.quality_ok("code").alias("ok"))


@query("fl2_fl4_code_files", f"SELECT row_id, {any_suffix('file_path', K.ADVISORY_EXTENSIONS)} AS advisory, {any_suffix('file_path', K.CVE_EXTENSIONS)} AS cve, {any_suffix('file_path', K.EXPLOIT_EXTENSIONS)} AS exploit FROM repo_commits")
def _(s, d):
    return t(s, d, "repo_commits").select("row_id", X.ends_with_any("file_path", K.ADVISORY_EXTENSIONS).alias("advisory"), X.ends_with_any("file_path", K.CVE_EXTENSIONS).alias("cve"), X.ends_with_any("file_path", K.EXPLOIT_EXTENSIONS).alias("exploit"))


@query("fl5_file_fits_language", f"SELECT row_id, CASE WHEN language = 'python' THEN {any_suffix('lower(file_path)', ['.py'])} WHEN language = 'javascript' THEN {any_suffix('lower(file_path)', K.LANGUAGE_FILES['javascript'])} ELSE false END AS fits FROM repo_commits")
def _(s, d):
    return t(s, d, "repo_commits").select("row_id", X.file_fits_language("language", "file_path").alias("fits"))


@query("fl6_security_commits", "SELECT row_id FROM repo_commits WHERE " + " OR ".join(f"contains(lower(commit_message), {q(w.lower())})" for w in K.SECURITY_KEYWORDS))
def _(s, d):
    return t(s, d, "repo_commits").where(X.is_security_message("commit_message")).select("row_id")


@query("fl7_not_tests", "SELECT row_id FROM repo_commits WHERE NOT regexp_matches(lower(file_path), 'test|spec')")
def _(s, d):
    return t(s, d, "repo_commits").where(X.not_a_test("file_path")).select("row_id")


@query("fl8_since", "SELECT sample_id FROM samples WHERE collected_at IS NULL OR collected_at >= TIMESTAMP '2032-01-01'")
def _(s, d):
    return t(s, d, "samples").where(X.since("collected_at", "2032-01-01 00:00:00")).select("sample_id")


@query("fl9_vulnerable_side", "SELECT coalesce(severity NOT IN ('SAFE','UNKNOWN'), true) AS vulnerable, count(*) AS n FROM samples GROUP BY 1")
def _(s, d):
    return N.counts(t(s, d, "samples"), {"vulnerable": X.vulnerable_side("severity")})


@query("fl12_version_in_range", r"SELECT sample_id, coalesce(regexp_extract(attrs, '\"from\":\s*\"(\d+(?:\.\d+)+)', 1) <> '' AND contains(metadata.vulnerable_range, regexp_extract(attrs, '\"from\":\s*\"(\d+(?:\.\d+)+)', 1)), false) AS hit FROM samples")
def _(s, d):
    v = F.regexp_extract("attrs", r'"from":\s*"(\d+(?:\.\d+)+)', 1)
    return t(s, d, "samples").select("sample_id", X.version_in_range(v, "metadata.vulnerable_range").alias("hit"))


@query("fl13_sql_or_type", "SELECT row_id FROM repo_commits WHERE contains(lower(commit_message), 'sql') OR vulnerability_type = 'sql_injection'")
def _(s, d):
    return t(s, d, "repo_commits").where(X.mentions_or_is("commit_message", "sql", "vulnerability_type", "sql_injection")).select("row_id")


@query("fl14_by_language_and_type", "SELECT row_id FROM repo_commits WHERE vulnerability_type = 'xss' AND lower(trim(language)) IN ('javascript','js')")
def _(s, d):
    return t(s, d, "repo_commits").where((F.col("vulnerability_type") == "xss") & F.lower(F.trim("language")).isin("javascript", "js")).select("row_id")


@query("fl15_with_code", "SELECT row_id FROM repo_commits WHERE fixed_code IS NOT NULL AND fixed_code <> ''")
def _(s, d):
    return t(s, d, "repo_commits").where(X.is_there("fixed_code")).select("row_id")


@query("fl16_non_blank_lines", f"SELECT sample_id, len(list_filter(string_split(code, chr(10)), lambda l: {strip('l')} <> '')) AS n FROM samples WHERE code IS NOT NULL")
def _(s, d):
    return t(s, d, "samples").where("code is not null").select("sample_id", F.size(F.filter(F.split("code", "\n"), lambda l: X.strip(l) != "")).cast("long").alias("n"))


@query("fl17_pii", "SELECT doc_id FROM documents WHERE " + " OR ".join(f"regexp_matches(text, {q(p)})" for p in K.PII_PATTERNS))
def _(s, d):
    return t(s, d, "documents").where(X.has_pii("text")).select("doc_id")


@query("fl18_watched_paths", f"SELECT row_id FROM repo_commits WHERE {any_suffix('lower(file_path)', K.WATCHED_EXTENSIONS)} AND NOT (" + " OR ".join(f"contains(parse_filename(file_path), {q(w)})" for w in K.IGNORED_NAMES) + f") AND NOT list_has_any(string_split(file_path, '/'), [{', '.join(map(q, K.IGNORED_DIRS))}])")
def _(s, d):
    return t(s, d, "repo_commits").where(X.watched_path("file_path")).select("row_id")


@query("st1_type_of_message", f"SELECT row_id, {case_keywords('commit_message', K.TYPE_KEYWORDS)} AS type FROM repo_commits")
def _(s, d):
    return t(s, d, "repo_commits").select("row_id", X.first_keyword("commit_message", K.TYPE_KEYWORDS).alias("type"))


@query("st2_type_extended", f"SELECT doc_id, {case_keywords('text', K.EXTENDED_TYPE_KEYWORDS)} AS type FROM documents")
def _(s, d):
    return t(s, d, "documents").select("doc_id", X.first_keyword("text", K.EXTENDED_TYPE_KEYWORDS).alias("type"))


_BLANK = f"coalesce({strip('vulnerable_code')} = '', true)"


def _metric(expr: str, cap: int, name: str) -> str:
    return f"CASE WHEN {_BLANK} THEN 0 ELSE least({expr}, {cap}) END AS {name}"


@query("st3_st4_line_metrics", "SELECT row_id, " + ", ".join([
    _metric("len(string_split(vulnerable_code, chr(10)))", 1000, "loc"),
    _metric(f"len(list_filter(string_split(vulnerable_code, chr(10)), lambda l: {strip('l')} <> '' AND NOT starts_with({strip('l')}, '#')))", 1000, "sloc"),
    *(_metric(f"len(regexp_extract_all(vulnerable_code, {q(p)}))", cap, a) for a, p, cap in (("sql_concat", K.SQL_CONCAT, 50), ("execute_calls", K.EXECUTE_CALL, 20), ("user_input", K.USER_INPUT, 20))),
]).replace("0 ELSE", "0 ELSE") + " FROM repo_commits")
def _(s, d):
    return t(s, d, "repo_commits").select("row_id", X.line_metrics("vulnerable_code").alias("m")).select("row_id", *(F.col("m." + c).cast("long").alias(c) for c in ("loc", "sloc", "sql_concat", "execute_calls", "user_input")))


@query("st5_syntax_counts")
def _(s, d):
    py = t(s, d, "repo_commits").where(X.source_language("language", "file_path") == "python")
    return py.select("row_id", X.syntax_counts("vulnerable_code").alias("m")).select("row_id", "m.*")


@query("pj12_scaled_metrics")
def _(s, d):
    c = F.col("vulnerable_code")
    x = t(s, d, "repo_commits").select("row_id", X.line_metrics(c).alias("a"), X.syntax_counts(c).alias("b"))
    return x.select("row_id", X.scaled_metrics("a.loc", "a.sloc", "a.sql_concat", "a.execute_calls", "a.user_input", "b.loops", "b.conditionals", "b.function_calls", "b.try_blocks", "b.string_ops").alias("features"))


# a unified diff is made of both files of a commit: lines only one has are marked
def _patch():
    v, f = F.split("vulnerable_code", "\n"), F.split("fixed_code", "\n")
    marked = F.concat(F.transform(v, lambda l: F.when(F.array_contains(f, l), F.concat(F.lit(" "), l)).otherwise(F.concat(F.lit("-"), l))), F.transform(F.array_except(f, v), lambda l: F.concat(F.lit("+"), l)))
    return F.concat(F.lit("@@ -1 +1 @@\n"), F.array_join(marked, "\n"))


_PATCH_SQL = "WITH x AS (SELECT row_id, string_split(vulnerable_code, chr(10)) AS v, string_split(fixed_code, chr(10)) AS f FROM repo_commits WHERE vulnerable_code IS NOT NULL AND fixed_code IS NOT NULL), l AS (SELECT row_id, list_filter(list_transform(v, lambda a: CASE WHEN list_contains(f, a) THEN ' ' || a ELSE '-' || a END), lambda a: NOT starts_with(a, '---') AND NOT starts_with(a, '@@')) AS old, list_transform(list_distinct(list_filter(f, lambda a: NOT list_contains(v, a))), lambda a: '+' || a) AS new FROM x) "


@query("st6_patch_sides", _PATCH_SQL + f"SELECT row_id, md5({strip('array_to_string(list_transform(old, lambda a: a[2:]), chr(10))')}) AS before_md5, len(list_filter(new, lambda a: NOT starts_with(a, '+++'))) AS n_added FROM l")
def _(s, d):
    x = t(s, d, "repo_commits").where("vulnerable_code is not null and fixed_code is not null").select("row_id", _patch().alias("p"))
    return x.select("row_id", F.md5(F.coalesce(X.patch_sides("p")["before"], F.lit(""))).alias("before_md5"), F.size(F.filter(F.split("p", "\n"), lambda l: l.startswith("+") & ~l.startswith("+++"))).cast("long").alias("n_added"))


_SIDES_SQL = "WITH x AS (SELECT row_id, string_split(vulnerable_code, chr(10)) AS v, string_split(fixed_code, chr(10)) AS f FROM repo_commits), p AS (SELECT row_id, CASE WHEN v IS NOT NULL AND f IS NOT NULL THEN list_filter(string_split(array_to_string(list_concat(list_transform(v, lambda a: CASE WHEN list_contains(f, a) THEN ' ' || a ELSE '-' || a END), list_transform(list_filter(f, lambda a, i: NOT list_contains(v, a) AND list_position(f, a) = i), lambda a: '+' || a)), chr(10)), chr(10)), lambda a: NOT starts_with(a, '---') AND NOT starts_with(a, '@@') AND NOT starts_with(a, '+++')) END AS l FROM x), c AS (SELECT row_id, l, list_transform(list_filter(l, lambda a: starts_with(a, ' ')), lambda a: a[2:]) AS ctx FROM p)"


def _strict_sql(mark):
    return strip(f"array_to_string(list_transform(list_filter(l, lambda a: starts_with(a, '{mark}') OR starts_with(a, ' ')), lambda a: a[2:]), chr(10))")


def _snippet_sql(mark):
    changed = f"list_transform(list_filter(l, lambda a: starts_with(a, '{mark}')), lambda a: a[2:])"
    text = f"array_to_string(list_concat(ctx[1:5], {changed}, ctx[greatest(1, len(ctx) - 4):]), chr(10))"
    return f"CASE WHEN len({changed}) > 0 THEN nullif({strip(text)}, '') END"


@query("st7_patch_strict", f"{_SIDES_SQL}, b AS (SELECT row_id, nullif({_strict_sql('-')}, '') AS b, nullif({_strict_sql('+')}, '') AS a FROM c) SELECT row_id, CASE WHEN a <> b THEN b END AS before, CASE WHEN a <> b THEN a END AS after FROM b")
def _(s, d):
    x = t(s, d, "repo_commits").select("row_id", _patch().alias("p"))
    return x.select("row_id", X.patch_sides_strict("p").alias("s")).select("row_id", "s.before", "s.after")


@query("st8_patch_snippets", f"{_SIDES_SQL} SELECT row_id, {_snippet_sql('-')} AS before, {_snippet_sql('+')} AS after FROM c")
def _(s, d):
    x = t(s, d, "repo_commits").select("row_id", _patch().alias("p"))
    return x.select("row_id", X.patch_snippets("p").alias("s")).select("row_id", "s.before", "s.after")


@query("st9_cve_ids", r"SELECT doc_id, len(regexp_extract_all(text, 'CVE-\d{4}-\d{4,}')) AS n FROM documents")
def _(s, d):
    return t(s, d, "documents").where("text is not null").select("doc_id", F.size(X.cve_ids("text")).cast("long").alias("n"))


_URL = "'https://github.com/' || repository || '/commit/' || commit_sha"


@query("st10_commit_url", f"SELECT row_id, regexp_extract({_URL}, 'github\\.com/([^/]+)/([^/]+)/commit/([a-f0-9]+)', 1) AS owner, regexp_extract({_URL}, 'github\\.com/([^/]+)/([^/]+)/commit/([a-f0-9]+)', 2) AS repo, regexp_extract({_URL}, 'github\\.com/([^/]+)/([^/]+)/commit/([a-f0-9]+)', 3) AS hash FROM repo_commits WHERE repository IS NOT NULL AND commit_sha IS NOT NULL")
def _(s, d):
    u = F.concat(F.lit("https://github.com/"), "repository", F.lit("/commit/"), "commit_sha")
    return t(s, d, "repo_commits").where("repository is not null and commit_sha is not null").select("row_id", X.commit_url(u).alias("u")).select("row_id", "u.*")


@query("st11_fl10_fl11_references", "SELECT row_id, commit_sha AS first_hash, 'https://github.com/' || repository AS repo, 2 AS n_code_urls FROM repo_commits WHERE repository IS NOT NULL AND commit_sha IS NOT NULL")
def _(s, d):
    base = F.concat(F.lit("https://github.com/"), "repository")
    urls = F.array(F.lit("https://example.org/a"), base, F.concat(base, F.lit("/pull/7")), F.concat(base, F.lit("/commit/"), "commit_sha"))
    x = t(s, d, "repo_commits").where("repository is not null and commit_sha is not null").select("row_id", urls.alias("u"))
    return x.select("row_id", X.first_commit_hash("u").alias("first_hash"), X.repo_url("u").alias("repo"), F.size(X.code_urls("u")).alias("n_code_urls"))


@query("st12_clean_url", "SELECT row_id, 'https://github.com/' || repository AS url FROM repo_commits WHERE repository IS NOT NULL")
def _(s, d):
    u = F.concat(F.lit("git+git://github.com/"), "repository", F.lit(".git"))
    return t(s, d, "repo_commits").where("repository is not null").select("row_id", X.clean_repo_url(u).alias("url"))


@query("st13_no_preprocessor", f"SELECT row_id, md5({strip(r'''regexp_replace(regexp_replace(vulnerable_code, '(?m)^[ \t]*#[ \t]*(include|define|ifdef|ifndef|endif)\b[^\n]*$', '', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g')''')}) AS h FROM repo_commits WHERE ends_with(file_path, '.c') AND NOT contains(vulnerable_code, chr(13))")
def _(s, d):
    return t(s, d, "repo_commits").where("file_path like '%.c' and not contains(vulnerable_code, '\r')").select("row_id", F.md5(X.blank_preprocessor("vulnerable_code")).alias("h"))


# the same over all C files, headers and any line ends included
@query("st13_no_preprocessor_all_c")
def _(s, d):
    c = t(s, d, "repo_commits").where(X.source_language("language", "file_path") == "c")
    return c.select("row_id", F.md5(X.blank_preprocessor("vulnerable_code")).alias("h"))


@query("st14_risky_count", "SELECT sample_id, " + " + ".join(f"len(regexp_extract_all(code, {q(p)}))" for p in K.RISKY_PATTERNS) + " AS n FROM samples WHERE code IS NOT NULL")
def _(s, d):
    return t(s, d, "samples").where("code is not null").select("sample_id", X.risky_count("code").cast("long").alias("n"))


@query("st14_risky_spans")
def _(s, d):
    return t(s, d, "samples").where("code is not null").select("sample_id", F.explode(X.risky_spans("code")).alias("s")).select("sample_id", "s.start", "s.end")


@query("st15_template", "SELECT row_id, replace('SELECT * FROM {t}', '{t}', ['users','orders','items','logs'][1 + row_id % 4]) AS text FROM repo_commits")
def _(s, d):
    return t(s, d, "repo_commits").select("row_id", X.filled("SELECT * FROM {t}", "{t}", N.round_robin(F.col("row_id"), ["users", "orders", "items", "logs"])).alias("text"))


_DETECT = "CASE " + " ".join(f"WHEN contains(vulnerable_code, {q(h)}) THEN {q(v)}" for h, v in K.LANGUAGE_HINTS.items()) + " WHEN contains(vulnerable_code,'def ') OR contains(vulnerable_code,'import ') THEN 'python' WHEN contains(vulnerable_code,'function') OR contains(vulnerable_code,'const ') OR contains(vulnerable_code,'let ') THEN 'javascript' WHEN contains(vulnerable_code,'public class') OR contains(vulnerable_code,'new ') THEN 'java' WHEN contains(vulnerable_code,'$') OR contains(lower(vulnerable_code),'php') THEN 'php' ELSE 'python' END"


@query("st16_detect_language", f"SELECT row_id, {_DETECT} AS guess FROM repo_commits")
def _(s, d):
    return t(s, d, "repo_commits").select("row_id", X.detect_language("vulnerable_code").alias("guess"))


@query("st17_jn4_path_language", f"SELECT row_id, {case_suffix('lower(file_path)', {k: v for k, v in sorted(K.EXTENSION_LANGUAGES.items(), key=lambda x: -len(x[0]))}, 'unknown')} AS by_extension, {case_suffix('file_path', K.EXPLOIT_LANGUAGES, 'Unknown')} AS by_suffix FROM repo_commits WHERE file_path IS NOT NULL")
def _(s, d):
    return t(s, d, "repo_commits").where("file_path is not null").select("row_id", X.language_by_extension("file_path").alias("by_extension"), X.map_by_suffix("file_path", K.EXPLOIT_LANGUAGES, "Unknown").alias("by_suffix"))


@query("st18_digests", "SELECT sample_id, md5(code) AS m, sha1(code) AS s1, sha256(code) AS s2 FROM samples WHERE code IS NOT NULL")
def _(s, d):
    return t(s, d, "samples").where("code is not null").select("sample_id", X.digests("code").alias("h")).select("sample_id", "h.*")


@query("st19_token_buckets")
def _(s, d):
    x = t(s, d, "train_split").select(F.explode(X.token_chain("code")["tokens"]).alias("tok"))
    return x.groupBy(X.token_bucket("tok").alias("bucket")).agg(F.count("*").alias("n"))


@query("st20_salted_id", "SELECT sample_id, substr(sha256('pepper' || orig_id), 1, 16) AS short_id FROM samples WHERE orig_id IS NOT NULL")
def _(s, d):
    return t(s, d, "samples").where("orig_id is not null").select("sample_id", X.salted_id("orig_id", "pepper").alias("short_id"))


@query("st21_part_of_id", "SELECT row_id, split_part(id, '-', 2) AS part FROM train_split")
def _(s, d):
    return t(s, d, "train_split").select("row_id", X.part_of("id", "-", 2).alias("part"))


@query("st22_edit_distance", "SELECT row_id, levenshtein(commit_message, repository) AS dist FROM repo_commits WHERE commit_message IS NOT NULL AND repository IS NOT NULL")
def _(s, d):
    return t(s, d, "repo_commits").where("commit_message is not null and repository is not null").select("row_id", F.levenshtein("commit_message", "repository").cast("long").alias("dist"))


_RULES = [(r"memcpy\(([a-z]+), ", "memcpy_s($1, "), (r"strncpy\(([a-z]+), ", "strlcpy($1, ")]


@query("st23_st27_rewrites", r"SELECT sample_id, md5(coalesce(CASE WHEN a <> code THEN a END, CASE WHEN b <> code THEN b END)) AS h FROM (SELECT sample_id, code, regexp_replace(code, 'memcpy\(([a-z]+), ', 'memcpy_s(\1, ', 'g') AS a, regexp_replace(code, 'strncpy\(([a-z]+), ', 'strlcpy(\1, ', 'g') AS b FROM samples WHERE code IS NOT NULL)")
def _(s, d):
    return t(s, d, "samples").where("code is not null").select("sample_id", F.md5(X.first_rewrite("code", _RULES)).alias("h"))


@query("st24_st25_prefixes", "SELECT doc_id, substr(text, 1, 100) AS head, split_part(source, ':', 1) AS platform FROM documents")
def _(s, d):
    return t(s, d, "documents").select("doc_id", F.substring("text", 1, 100).alias("head"), F.substring_index("source", ":", 1).alias("platform"))


@query("st26_score_bucket", "SELECT event_id, CASE WHEN abs(value / 100.0) > 0.7 THEN 'high' WHEN abs(value / 100.0) > 0.4 THEN 'medium' ELSE 'low' END AS bucket FROM events")
def _(s, d):
    return t(s, d, "events").select("event_id", S.bucketed(F.col("value") / 100.0).alias("bucket"))


@query("st28_last_match", r"SELECT doc_id, list_filter(regexp_extract_all(text, '(\d+\.\d+)', 1), lambda m: m <> '')[-1] AS last_number FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return t(s, d, "documents").where("text is not null").select("doc_id", X.last_match("text", r"(\d+\.\d+)").alias("last_number"))


@query("ar1_ar2_token_chain", r"SELECT row_id, md5(array_to_string(w, chr(31))) AS tokens, CASE WHEN len(w) > 1 THEN array_to_string(list_transform(range(0, len(w) - 1), lambda i: i || '>' || (i + 1) || ' ' || (i + 1) || '>' || i), ' ') ELSE '' END AS edges FROM (SELECT row_id, (list_filter(regexp_split_to_array(code, '\s+'), lambda x: x <> ''))[1:512] AS w FROM train_split WHERE code IS NOT NULL)")
def _(s, d):
    x = t(s, d, "train_split").where("code is not null").select("row_id", X.token_chain("code").alias("g"))
    edges = F.array_join(F.transform("g.edges", lambda e: F.concat_ws(">", e[0].cast("string"), e[1].cast("string"))), " ")
    return x.select("row_id", F.md5(F.array_join("g.tokens", "\x1f")).alias("tokens"), edges.alias("edges"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
