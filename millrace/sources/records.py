"""Producers' documents to the one sample schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X

SAMPLE = """sample_id string, source string, description string, severity string, ecosystem string, language string,
vulnerability_type string, code string, vulnerable_code string, fixed_code string, label int, published_at string,
modified_at string, cvss_score double, cwes array<string>, package_name string, author string, refs array<string>,
cve_codes array<string>, file_path string"""
_FIELDS = [f.strip().rsplit(" ", 1) for f in SAMPLE.replace("\n", " ").split(",")]

_REFS = "references array<struct<url:string>>"
OSV = f"id string, summary string, details string, published string, modified string, affected array<struct<package:struct<name:string>,ranges:array<struct<type:string>>,versions:array<string>>>, severity array<struct<type:string,score:string,severity:string>>, {_REFS}, aliases array<string>"
ADVISORY = f"advisory struct<ghsaId:string,summary:string,description:string,severity:string,publishedAt:string,references:array<struct<url:string>>>, package struct<name:string,ecosystem:string>, vulnerableVersionRange string, firstPatchedVersion struct<identifier:string>"
OLD_ADVISORY = f"ghsaId string, summary string, description string, severity string, publishedAt string, {_REFS}, vulnerabilities struct<nodes:array<struct<package:struct<name:string,ecosystem:string>,vulnerableVersionRange:string,firstPatchedVersion:struct<identifier:string>>>>"
_METRIC = "array<struct<cvssData:struct<baseSeverity:string,baseScore:double>>>"
CVE = f"cve struct<id:string,descriptions:array<struct<lang:string,value:string>>,weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>,published:string,references:array<struct<url:string>>,metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>>"


def canonical(df: DataFrame, **columns: Column) -> DataFrame:
    """All fields of the schema, those not given null."""
    return df.select(*(columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS))


def urls(refs) -> Column:
    """Non-empty addresses of a list of references."""
    return F.filter(F.transform(refs, lambda r: r["url"]), lambda u: u.isNotNull() & (u != ""))


def described(head, body) -> Column:
    """Head, blank line, body, with the ends stripped."""
    return X.strip(F.concat(F.coalesce(head, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit(""))))


def from_osv(docs: DataFrame, json_col: str, ecosystem: Column | None = None) -> DataFrame:
    """Documents without an affected package name drop out."""
    d = docs.withColumn("d", F.from_json(json_col, OSV))
    name, first = F.get("d.affected", F.lit(0))["package"]["name"], F.get("d.severity", F.lit(0))
    d = d.where(name != "")
    severity = F.when(F.size(F.coalesce("d.severity", F.array().cast("array<struct<type:string,score:string,severity:string>>"))) == 0, "UNKNOWN").when(first["type"] == "CVSS_V3", F.when(F.contains(first["score"], F.lit("/")), "HIGH").otherwise("MEDIUM")).otherwise(F.upper(F.coalesce(first["severity"], F.lit("UNKNOWN"))))
    about = F.coalesce(F.nullif("d.details", F.lit("")), "d.summary")
    return canonical(d, sample_id=F.col("d.id"), source=F.lit("osv"), description=described(F.col("d.summary"), F.col("d.details")), severity=severity, ecosystem=ecosystem if ecosystem is not None else F.lit(None), vulnerability_type=X.first_keyword(about, K.TYPE_KEYWORDS), vulnerable_code=F.concat(F.lit("# Vulnerable package: "), name, F.lit(" (see references)")), fixed_code=F.concat(F.lit("# Fixed package: "), name, F.lit(" (see references)")), published_at=F.col("d.published"), modified_at=F.col("d.modified"), package_name=name, refs=urls(F.col("d.references")))


def _advisory(d: DataFrame, a: str, node: str) -> DataFrame:
    name = F.col(f"{node}package.name")
    return canonical(d.where(f"{node}package.name <> ''"), sample_id=F.col(f"{a}ghsaId"), source=F.lit("github_advisory"), description=described(F.col(f"{a}summary"), F.col(f"{a}description")), severity=F.col(f"{a}severity"), ecosystem=F.col(f"{node}package.ecosystem"), vulnerability_type=X.first_keyword(f"{a}description", K.TYPE_KEYWORDS), vulnerable_code=F.concat(F.lit("# Vulnerable package: "), name, F.lit(" "), F.coalesce(F.col(f"{node}vulnerableVersionRange"), F.lit(""))), fixed_code=F.concat(F.lit("# Fixed package: "), name, F.lit(" "), F.coalesce(F.col(f"{node}firstPatchedVersion.identifier"), F.lit("latest"))), published_at=F.col(f"{a}publishedAt"), package_name=name, refs=urls(F.col(f"{a}references")))


def from_advisory(docs: DataFrame, json_col: str) -> DataFrame:
    return _advisory(docs.withColumn("d", F.from_json(json_col, ADVISORY)), "d.advisory.", "d.")


def from_old_advisory(docs: DataFrame, json_col: str) -> DataFrame:
    """The shape in which an advisory holds its packages; its first one counts."""
    d = docs.withColumn("d", F.from_json(json_col, OLD_ADVISORY)).withColumn("n", F.get("d.vulnerabilities.nodes", F.lit(0)))
    return _advisory(d, "d.", "n.")


def from_cve(docs: DataFrame, json_col: str) -> DataFrame:
    """First English description, first metric list that is there in order of versions, English CWE values."""
    d = docs.withColumn("d", F.from_json(json_col, CVE)["cve"]).where("d.id <> ''")
    english = lambda xs: F.filter(xs, lambda x: x["lang"] == "en")
    text = F.coalesce(F.get(english(F.col("d.descriptions")), F.lit(0))["value"], F.lit(""))
    metric = F.coalesce(*(F.get(f"d.metrics.{v}", F.lit(0)) for v in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")))
    values = F.transform(english(F.flatten(F.transform("d.weaknesses", lambda w: w["description"]))), lambda x: x["value"])
    cwes = F.coalesce(F.filter(values, lambda v: v.startswith("CWE-")), F.array().cast("array<string>"))
    return canonical(d, sample_id=F.col("d.id"), source=F.lit("nvd"), description=text, severity=F.coalesce(metric["cvssData"]["baseSeverity"], F.lit("UNKNOWN")), cvss_score=metric["cvssData"]["baseScore"], cwes=cwes, published_at=F.col("d.published"), vulnerability_type=X.first_keyword(text, K.TYPE_KEYWORDS), refs=urls(F.col("d.references")))


def from_exploits(rows: DataFrame, code: str = "code") -> DataFrame:
    """Rows of the exploit table joined with their code; those without code drop out."""
    return canonical(rows.where(F.col(code).isNotNull() & (F.col(code) != "")), sample_id=F.concat(F.lit("EDB-"), "id"), source=F.lit("exploitdb"), description=F.col("description"), severity=F.lit("HIGH"), ecosystem=F.lower("platform"), language=X.map_by_suffix("file_path", K.EXPLOIT_LANGUAGES, "Unknown"), vulnerability_type=X.first_keyword("description", K.TYPE_KEYWORDS), vulnerable_code=F.col(code), published_at=F.col("date"), author=F.col("author"), cve_codes=X.cve_ids("codes"), file_path=F.col("file_path"))


def from_functions(rows: DataFrame, prefix: str, id_col: str, code: str = "func", target: str = "target") -> DataFrame:
    """Function-level rows with a 0/1 target; the id falls back to 'unknown'."""
    return canonical(rows, sample_id=F.concat(F.lit(prefix + "-"), F.coalesce(F.col(id_col).cast("string"), F.lit("unknown"))), source=F.lit(prefix.lower()), severity=F.when(F.col(target) == 1, "HIGH").otherwise("SAFE"), code=F.col(code), vulnerable_code=F.when(F.col(target) == 1, F.col(code)), label=F.col(target))


def from_commits(rows: DataFrame) -> DataFrame:
    return canonical(rows, sample_id=F.concat_ws(":", "repository", "commit_sha"), source=F.lit("opensource_repo"), description=X.strip("commit_message"), language=F.lower(F.trim("language")), vulnerability_type=F.col("vulnerability_type"), vulnerable_code=F.col("vulnerable_code"), fixed_code=F.col("fixed_code"), published_at=F.date_format("committed_date", "yyyy-MM-dd'T'HH:mm:ss"), file_path=F.col("file_path"))


def truthy_code(df: DataFrame) -> DataFrame:
    """code or func or empty, an empty text counting as missing; label or target or 0, an absent one counting as missing."""
    have = set(df.columns)
    col = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    return df.withColumn("code", F.coalesce(F.nullif(col("code", "string"), F.lit("")), F.nullif(col("func", "string"), F.lit("")), F.lit(""))).withColumn("label", F.coalesce(col("label", "int"), col("target", "int"), F.lit(0)))


def padded(tokens: Column, length: int, pad: int = 0) -> Column:
    """struct(ids, mask): cut to length, padded at the right, mask 1 for real tokens."""
    cut = F.slice(tokens, 1, length)
    n = F.size(cut)
    ids = F.concat(cut, F.array_repeat(F.lit(pad).cast("int"), length - n))
    return F.struct(F.slice(ids, 1, length).alias("ids"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n)).alias("mask"))


def overlay(*maps: Column) -> Column:
    """Maps laid over each other, the later winning."""
    out = F.map_entries(maps[0])
    for later in maps[1:]:
        out = F.concat(_without(out, F.map_keys(later)), F.map_entries(later))
    return F.map_from_entries(out)


def _without(entries: Column, keys: Column) -> Column:
    return F.filter(entries, lambda x: ~F.array_contains(keys, x["key"]))


def json_problems(df: DataFrame) -> list[str]:
    """Paths of a schema whose values JSON cannot hold as they are."""
    from pyspark.sql import types as T

    out: list[str] = []

    def walk(t, path):
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(t, T.ArrayType):
            walk(t.elementType, path + "[]")
        elif isinstance(t, T.MapType):
            if not isinstance(t.keyType, T.StringType):
                out.append(f"{path}: key {t.keyType.simpleString()}")
            walk(t.valueType, path + "{}")
        elif isinstance(t, (T.BinaryType, T.CalendarIntervalType, T.DayTimeIntervalType)):
            out.append(f"{path}: {t.simpleString()}")

    walk(df.schema, "")
    return out
