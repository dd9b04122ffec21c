"""Column functions over text and code. All but span offsets and syntax counts stay in built-in expressions."""

from __future__ import annotations

import ast
import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K

# types as objects: this module is imported before there is a session
_INT = T.IntegerType()
_COUNTS = T.StructType([T.StructField(n, _INT) for n in ("loops", "conditionals", "function_calls", "try_blocks", "string_ops")])
_SPANS = T.ArrayType(T.StructType([T.StructField("start", _INT), T.StructField("end", _INT)]))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without the white space at both ends, line ends and tabs included."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def quality_ok(x, least: int = 50, most: int = 10_000) -> Column:
    """Stripped length within the limits and at least half of `least` characters that are no white space. Null is false."""
    n = F.length(strip(x))
    return F.coalesce(n.between(least, most) & (F.length(F.regexp_replace(_c(x), r"\s+", "")) >= least // 2), F.lit(False))


def contains_any(x, words: list[str]) -> Column:
    return reduce(or_, (F.contains(_c(x), F.lit(w)) for w in words))


def first_keyword(x, table: dict[str, list[str]], default: str = "unknown") -> Column:
    """The first class, in the table's order, of which a keyword occurs in the lower-cased text. Null gives the default."""
    low, out = F.lower(_c(x)), None
    for name, words in table.items():
        hit = contains_any(low, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def ends_with_any(x, suffixes: list[str]) -> Column:
    return F.coalesce(reduce(or_, (F.endswith(_c(x), F.lit(s)) for s in suffixes)), F.lit(False))


def is_security_message(x) -> Column:
    return F.coalesce(contains_any(F.lower(_c(x)), [w.lower() for w in K.SECURITY_KEYWORDS]), F.lit(False))


def file_fits_language(language, path) -> Column:
    """Whether a path's ending is one of the language's; other languages never fit."""
    low, out = F.lower(_c(path)), F.lit(False)
    for name, ends in K.LANGUAGE_FILES.items():
        out = F.when(_c(language) == name, ends_with_any(low, ends)).otherwise(out)
    return out


def map_by_suffix(x, table: dict[str, str], default: str) -> Column:
    out = None
    for s, v in table.items():
        hit = F.endswith(_c(x), F.lit(s))
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(default)


def extension(x) -> Column:
    """The lower-cased ending of a file name with its dot, or empty."""
    name = F.element_at(F.split(_c(x), "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def language_by_extension(x) -> Column:
    ext, out = extension(x), None
    for s, v in K.EXTENSION_LANGUAGES.items():
        out = F.when(ext == s, v) if out is None else out.when(ext == s, v)
    return out.otherwise("unknown")


def detect_language(code) -> Column:
    """By the first hint that occurs, then by keywords; python where nothing does."""
    c, out = _c(code), None
    has = lambda w: F.contains(c, F.lit(w))
    for hint, lang in K.LANGUAGE_HINTS.items():
        out = F.when(has(hint), lang) if out is None else out.when(has(hint), lang)
    out = out.when(has("def ") | has("import "), "python").when(has("function") | has("const ") | has("let "), "javascript")
    return out.when(has("public class") | has("new "), "java").when(has("$") | F.contains(F.lower(c), F.lit("php")), "php").otherwise("python")


def watched_path(x) -> Column:
    """Ending is watched, no ignored piece in the name, no ignored directory in the path."""
    parts = F.split(_c(x), "/")
    return ends_with_any(extension(x), K.WATCHED_EXTENSIONS) & (extension(x) != "") & ~contains_any(F.element_at(parts, -1), K.IGNORED_NAMES) & ~F.arrays_overlap(parts, F.array(*map(F.lit, K.IGNORED_DIRS)))


def has_pii(x) -> Column:
    return F.coalesce(reduce(or_, (F.rlike(_c(x), F.lit(p)) for p in K.PII_PATTERNS)), F.lit(False))


# ---- patches ----------------------------------------------------------------------------------------------------
def _lines(patch) -> Column:
    return F.filter(F.split(_c(patch), "\n"), lambda l: ~(l.startswith("@@") | l.startswith("+++") | l.startswith("---")))


def _side(lines: Column, mark: str, context) -> Column:
    own = lambda l: l.startswith(mark)
    picked = F.filter(lines, lambda l: own(l) | context(l))
    text = F.array_join(F.transform(picked, lambda l: F.when(own(l) | l.startswith(" "), F.substr(l, F.lit(2))).otherwise(l)), "\n")
    return F.nullif(strip(text), F.lit(""))


def patch_sides(patch) -> Column:
    """struct(before, after): lines with - on one side, with + on the other, all others but backslash notes on both."""
    lines = _lines(patch)
    context = lambda l: ~(l.startswith("-") | l.startswith("+") | l.startswith("\\"))
    return F.struct(_side(lines, "-", context).alias("before"), _side(lines, "+", context).alias("after"))


def patch_sides_strict(patch) -> Column:
    """The same with only lines that start with a space on both sides; null unless the sides are there and differ."""
    lines = _lines(patch)
    context = lambda l: l.startswith(" ")
    b, a = _side(lines, "-", context), _side(lines, "+", context)
    ok = b.isNotNull() & a.isNotNull() & (a != b)
    return F.struct(F.when(ok, b).alias("before"), F.when(ok, a).alias("after"))


def patch_snippets(patch, around: int = 5) -> Column:
    """The first and last `around` context lines with the changed lines between, without space at the ends; null where a side has no changed line or is blank."""
    lines = _lines(patch)
    ctx = F.transform(F.filter(lines, lambda l: l.startswith(" ")), lambda l: F.substr(l, F.lit(2)))
    head, tail = F.slice(ctx, 1, around), F.when(F.size(ctx) > around, F.slice(ctx, -around, around)).otherwise(ctx)

    def side(mark):
        changed = F.transform(F.filter(lines, lambda l: l.startswith(mark)), lambda l: F.substr(l, F.lit(2)))
        return F.when(F.size(changed) > 0, F.nullif(strip(F.array_join(F.concat(head, changed, tail), "\n")), F.lit("")))

    return F.struct(side("-").alias("before"), side("+").alias("after"))


# ---- references and identifiers ----------------------------------------------------------------------------------
def cve_ids(x) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(r"(CVE-\d{4}-\d{4,})"), F.lit(1))


def commit_url(x) -> Column:
    """struct(owner, repo, hash) of a commit address; empty where it is none."""
    p = r"github\.com/([^/]+)/([^/]+)/commit/([a-f0-9]+)"
    return F.struct(*(F.regexp_extract(_c(x), p, i).alias(n) for i, n in ((1, "owner"), (2, "repo"), (3, "hash"))))


def first_commit_hash(urls) -> Column:
    """The first 40-digit hash in a list of addresses, in order."""
    return F.get(F.filter(F.transform(_c(urls), lambda u: F.regexp_extract(u, r"/commit/([0-9a-f]{40})", 1)), lambda h: h != ""), F.lit(0))


def code_urls(urls) -> Column:
    """Addresses of commits and pull requests."""
    return F.filter(_c(urls), lambda u: F.contains(u, F.lit("github.com")) & (F.contains(u, F.lit("/commit/")) | F.contains(u, F.lit("/pull/"))))


def repo_url(urls) -> Column:
    """The repository part of the first address that is neither a commit nor a pull request."""
    own = F.get(F.filter(_c(urls), lambda u: F.contains(u, F.lit("github.com")) & ~F.contains(u, F.lit("/commit/")) & ~F.contains(u, F.lit("/pull/"))), F.lit(0))
    return F.nullif(F.regexp_extract(own, r"(https?://github\.com/[^/]+/[^/]+)", 1), F.lit(""))


def clean_repo_url(x) -> Column:
    u = F.regexp_replace(F.replace(F.replace(_c(x), F.lit("git+"), F.lit("")), F.lit("git://"), F.lit("https://")), r"\.git$", "")
    return F.when(F.contains(u, F.lit("github.com")), u)


def version_in_range(version, range_text) -> Column:
    """Whether the first dotted number of a tag stands in the range's text; a text test, no comparison of versions."""
    v = F.regexp_extract(_c(version), r"(\d+(?:\.\d+)+)", 1)
    return F.coalesce((v != "") & F.contains(_c(range_text), v), F.lit(False))


def salted_id(x, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), _c(x)), 256), 1, 16)


def last_match(x, pattern: str, group: int = 1) -> Column:
    """The last non-empty match of a group, null if there is none."""
    return F.try_element_at(F.filter(F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(group)), lambda m: m != ""), F.lit(-1))


# ---- code --------------------------------------------------------------------------------------------------------
def source_language(language, path) -> Column:
    """python, javascript or c, by the stated language or, where that is null or blank, the extension; else null.

    The rule of `llm.unparsable.language_of` as an expression.
    """
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    stated, name = _c(language), F.substring_index(_c(path), "/", -1)
    by_name = F.when(~stated.rlike("[+#]"), F.try_element_at(table(K.SOURCE_LANGUAGES), F.regexp_replace(F.lower(stated), "[^a-z]", "")))
    by_extension = F.when(name.contains("."), F.try_element_at(table(K.SOURCE_EXTENSIONS), F.lower(F.substring_index(name, ".", -1))))
    return F.when(stated.rlike(r"(?U)[^\s\x1c-\x1f]"), by_name).otherwise(by_extension)


def blank_preprocessor(x) -> Column:
    r"""Lines of #include, #define, #ifdef, #ifndef and #endif blanked, runs of blank lines made one, ends stripped.

    \n, \r\n and a lone \r end a line. A line that stays keeps the \r of its \r\n; a run of blank lines, whatever
    their ends, becomes \n\n after the character before its first \n or lone \r. Null stays null.
    """
    t = F.regexp_replace(_c(x), r"(?<![^\r\n])[ \t]*#[ \t]*(include|define|ifdef|ifndef|endif)\b[^\r\n]*", " ")  # a space, so that \r before and \n after stay two line ends; it goes with its blank run
    return strip(F.regexp_replace(t, r"(\n|\r(?!\n))\s*(\n|\r(?!\n))+", "\n\n"))


def line_metrics(x) -> Column:
    """struct(loc, sloc, sql_concat, execute_calls, user_input), capped; blank code has zeros."""
    c = _c(x)
    blank = F.coalesce(strip(c) == "", F.lit(True))
    lines = F.split(c, "\n")
    own = F.filter(lines, lambda l: (strip(l) != "") & ~strip(l).startswith("#"))
    n = lambda v, cap: F.when(blank, F.lit(0)).otherwise(F.least(v, F.lit(cap))).cast("int")
    return F.struct(n(F.size(lines), 1000).alias("loc"), n(F.size(own), 1000).alias("sloc"), *(n(F.regexp_count(c, F.lit(p)), cap).alias(a) for a, p, cap in (("sql_concat", K.SQL_CONCAT, 50), ("execute_calls", K.EXECUTE_CALL, 20), ("user_input", K.USER_INPUT, 20))))


@F.pandas_udf(_COUNTS)
def syntax_counts(code: pd.Series) -> pd.DataFrame:
    """for and while loops, if statements, calls, try blocks and additions or multiplications of Python code, capped; zeros where it does not parse."""
    kinds = ((ast.For, ast.While), (ast.If,), (ast.Call,), (ast.Try,))
    rows = []
    for text in code:
        counts = [0] * 5
        try:
            for node in ast.walk(ast.parse(text or "")):
                for i, k in enumerate(kinds):
                    counts[i] += isinstance(node, k)
                counts[4] += isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mult))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            counts = [0] * 5
        rows.append([min(n, most) for n, most in zip(counts, K.SYNTAX_CAPS)])
    return pd.DataFrame(rows, columns=["loops", "conditionals", "function_calls", "try_blocks", "string_ops"])


def risky_count(x) -> Column:
    """How many matches the risky patterns have, all patterns together."""
    return F.coalesce(sum((F.regexp_count(_c(x), F.lit(p)) for p in K.RISKY_PATTERNS), F.lit(0)), F.lit(0))


@F.pandas_udf(_SPANS)
def risky_spans(code: pd.Series) -> pd.Series:
    """(start, end) of each match, pattern by pattern in the order of the list."""
    ps = [re.compile(p) for p in K.RISKY_PATTERNS]
    return pd.Series([[{"start": m.start(), "end": m.end()} for p in ps for m in p.finditer(c or "")] for c in code])


def scaled_metrics(*cols) -> Column:
    """Ten metrics divided by their fixed scales, in order."""
    return F.array(*(_c(c) / F.lit(float(s)) for c, s in zip(cols, K.METRIC_SCALES)))


def token_chain(x, limit: int = 512) -> Column:
    """struct(tokens, edges): the first tokens by white space, and both directions between neighbours, in turn."""
    toks = F.slice(F.filter(F.split(_c(x), r"\s+"), lambda t: t != ""), 1, limit)
    last = F.size(toks) - 1
    edges = F.when(last > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: F.array(F.array(i, i + 1), F.array(i + 1, i)))))
    return F.struct(toks.alias("tokens"), F.coalesce(edges, F.array().cast("array<array<int>>")).alias("edges"))


def token_bucket(x, buckets: int = 1000) -> Column:
    return F.pmod(F.xxhash64(_c(x)), F.lit(buckets))


def first_rewrite(x, rules: list[tuple[str, str]]) -> Column:
    """The result of the first rule that changes the text, else null."""
    tries = [F.regexp_replace(_c(x), p, r) for p, r in rules]
    return F.coalesce(*(F.when(t != _c(x), t) for t in tries))


# ---- filters and shapes of rows -------------------------------------------------------------------------------------
def not_a_test(path) -> Column:
    """Whether a path has neither test nor spec in it."""
    return ~F.lower(_c(path)).rlike("test|spec")


def since(ts, start: str) -> Column:
    """Whether a time is not before the start; rows without a time pass."""
    return _c(ts).isNull() | (_c(ts) >= F.lit(start).cast("timestamp_ntz"))


def vulnerable_side(severity) -> Column:
    """Whether a severity tells of a vulnerability: all but SAFE and UNKNOWN, and a missing one, do."""
    return F.coalesce(~_c(severity).isin("SAFE", "UNKNOWN"), F.lit(True))


def mentions_or_is(text, word: str, kind, value: str) -> Column:
    """Whether a text has a word, in any case, or the kind is the value."""
    return F.contains(F.lower(_c(text)), F.lit(word)) | (_c(kind) == value)


def is_there(x) -> Column:
    return _c(x).isNotNull() & (_c(x) != "")


def same_text(a, b) -> Column:
    """Whether two texts are the same but for blanks at their ends."""
    return F.trim(_c(a)) == F.trim(_c(b))


def filled(template: str, slot: str, value: Column) -> Column:
    return F.replace(F.lit(template), F.lit(slot), value)


def digests(x) -> Column:
    """struct(m, s1, s2): md5, sha1 and sha256."""
    return F.struct(F.md5(_c(x)).alias("m"), F.sha1(_c(x)).alias("s1"), F.sha2(_c(x), 256).alias("s2"))


def part_of(x, mark: str, n: int) -> Column:
    """The n-th part of a text cut at a mark; empty beyond the last."""
    return F.split_part(_c(x), F.lit(mark), F.lit(n))


def headed(title, body, size: int = 100) -> Column:
    """A comment line with the first characters of a title, then the body."""
    return F.concat(F.lit("# "), F.substring(_c(title), 1, size), F.lit("\n"), _c(body))


def line_changes(before, after) -> Column:
    """struct(added, removed): how many distinct lines only one of two texts has."""
    a, b = F.split(_c(before), "\n"), F.split(_c(after), "\n")
    return F.struct(F.size(F.array_except(b, a)).cast("long").alias("added"), F.size(F.array_except(a, b)).cast("long").alias("removed"))


def json_first(x, paths: list[str], rest: str | None = None) -> Column:
    """The first of several JSON paths that has a value, else `rest`."""
    found = [F.get_json_object(_c(x), p) for p in paths]
    return F.coalesce(*found, *([F.lit(rest)] if rest is not None else []))


def json_kind(x, path: str) -> Column:
    """OBJECT or VARCHAR by what stands at a JSON path, null if nothing does."""
    r = F.try_variant_get(F.try_parse_json(_c(x)), path, "variant")
    return F.when(r.isNotNull(), F.when(F.schema_of_variant(r).startswith("OBJECT"), "OBJECT").otherwise("VARCHAR"))


def starting(items, prefix: str) -> Column:
    """The items of an array that start with a prefix."""
    return F.filter(_c(items), lambda c: c.startswith(prefix))
