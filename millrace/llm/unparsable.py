"""Source files that do not parse: generalised LL over the dialects of each language, run together."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .syntax import tokens
from .syntax.grammars import grammar

#: By the letters of the name: versions, blanks and punctuation do not count.
LANGUAGES = {"python": "python", "py": "python", "javascript": "javascript", "js": "javascript", "jsx": "javascript", "node": "javascript", "nodejs": "javascript", "ecmascript": "javascript", "c": "c", "h": "c", "ansic": "c"}
EXTENSIONS = {"py": "python", "pyw": "python", "js": "javascript", "jsx": "javascript", "cjs": "javascript", "c": "c", "h": "c"}
_SCANNERS = {"python": tokens.python_tokens, "javascript": tokens.javascript_tokens, "c": tokens.c_tokens}
#: Verdicts a worker remembers, so that copies of a file in one task are parsed once.
REMEMBERED = 20_000


def language_of(language: str | None, path: str | None) -> str | None:
    """python, javascript or c, by the stated language or, where that is null, the extension; else None."""
    if language is not None and language.strip():
        return None if "+" in language or "#" in language else LANGUAGES.get(re.sub(r"[^a-z]", "", language.lower()))
    name = (path or "").rsplit("/", 1)[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


VALID, INVALID, UNDECIDED, UNKNOWN = "valid", "invalid", "undecided", "unknown language"


def verdict(code: str, language: str) -> str:
    """valid if some dialect of the language accepts the whole file, else invalid; undecided where that cannot be told.

    For Python an exact check by the interpreter's own parser follows what the grammar accepts: it knows rules that
    are no matter of grammar, such as what can be assigned to. Undecided are C files whose macros expand beyond
    `tokens.MOST_EXPANDED` tokens, and files nested beyond the depth of the interpreter.
    """
    try:
        toks = _SCANNERS[language](code)
        if toks is None or not grammar(language).accepts(toks):
            return INVALID
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(tokens.newlines(code))
    except (SyntaxError, ValueError):
        return INVALID
    except (tokens.Undecided, RecursionError, MemoryError):
        return UNDECIDED
    return VALID


def parses(code: str, language: str) -> bool:
    return verdict(code, language) == VALID


_FILES = "row_id long, repository string, lang string, code_field string, verdict string"


def _judge(batches):
    known: dict = {}
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(6)]
        out: list[list] = [[], [], [], [], []]
        for row, repo, lang, path, bad, good in zip(*cols):
            kind = language_of(lang, path)
            for field, code in (("vulnerable_code", bad), ("fixed_code", good)):
                if code is None:
                    continue
                said = UNKNOWN
                if kind is not None:
                    key = (kind, hashlib.blake2b(code.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    if key not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[key] = verdict(code, kind)
                    said = known[key]
                for c, v in zip(out, (row, repo, kind, field, said)):
                    c.append(v)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["row_id", "repository", "lang", "code_field", "verdict"])


def judged(commits: DataFrame) -> DataFrame:
    """(row_id, repository, lang, code_field, verdict) of every non-null file: valid, invalid, undecided or unknown language.

    Empty files are valid. No commits give no rows.
    """
    return spread(commits.select(F.col("row_id").cast("long"), "repository", "language", "file_path", "vulnerable_code", "fixed_code")).mapInArrow(_judge, _FILES)


def found_unparsable(commits: DataFrame) -> DataFrame:
    return judged(commits).where(F.col("verdict") == INVALID).select("row_id", "code_field")


def rates(commits: DataFrame) -> DataFrame:
    """(repository, lang, files, invalid_files, undecided_files, invalid_pct) per repository and language ('unknown' where null).

    invalid_pct is of the files that could be judged, null if there are none.
    """
    j = judged(commits)
    g = j.groupBy(F.coalesce("repository", F.lit("unknown")).alias("repository"), F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("files"), *(F.count_if(F.col("verdict") == v).alias(n) for v, n in ((INVALID, "invalid_files"), (UNDECIDED, "undecided_files"), (UNKNOWN, "_unknown"))))
    told = F.col("files") - F.col("undecided_files") - F.col("_unknown")
    return g.withColumn("invalid_pct", F.round(100.0 * F.col("invalid_files") / F.when(told > 0, told), 4)).drop("_unknown")
