"""Sentence units across languages: learned abbreviations, collocations and starters, then a decision for each period.

A first pass over all texts counts, per language and over all languages ('*'): how often each word occurs, opens a
paragraph or follows ? or !, ends in a period, and what stands after that period. Log-likelihood ratios turn the counts
into three lists: words that start sentences; words whose period is followed by something that continues (an
abbreviation); and words that follow the period of a number, as in German ordinals and dates (a collocation). The
second pass cuts each text into blocks (headings, list items, fences, paragraphs) and classifies every terminator.

A list keeps only words with at least MIN_COUNT uses and MIN_SHARE of its language's counted events, so one language
has at most 1 / MIN_SHARE words in each list. Every language is learned, however few its texts; a language is a tag of
two or three letters, so there are fewer than 18,300. Lists are broadcast for as many languages at a time as have
LIST_ENTRIES entries together; more languages are cut in further runs over their own documents.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import settle, spread

MIN_COUNT, MIN_SHARE = 3, 1e-5
#: Entries of lists that are broadcast together. The lists of one language, and those of all languages, are never divided.
LIST_ENTRIES = 1_000_000
#: A capital that starts no sentence speaks for an abbreviation after words that have their period in so many of their uses.
PERIOD_SHARE = 0.9
#: 99.9 and 95 % of the chi-squared distribution with one degree of freedom.
LLR, LLR_95 = 10.83, 3.84

OPEN = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“", "‘": "’", "「": "」", "『": "』", "（": "）", "《": "》", "〈": "〉", "【": "】", "‹": "›", "»": "«"}
CLOSERS = set(OPEN.values()) | {'"', "'", "”", "’"}
_END = re.compile(r"[.!?…。！？।॥؟۔｡．]+")
#: A terminator that is not the last thing of a paragraph, nor inside a number or name.
_INNER = re.compile(r"[!?…。！？।॥؟۔｡．](?=.)|\.(?=[\W_])(?!\Z)", re.S)
_FENCE = re.compile(r"[ \t]*(```+|~~~+)")
_HEAD = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_ITEM = re.compile(r"[ \t]*(?:[-*+•‣◦·–]|\(?\d{1,3}[.)]|\(?[a-zA-Z][)])[ \t]+\S")
_RULE = re.compile(r"[ \t]*(=+|-{3,}|_{3,}|\*{3,})[ \t]*$")
_TOKEN = re.compile(r"\S+")
_THAI = re.compile("[฀-๿]")
_CJK = re.compile("[぀-ヿ㐀-鿿ｦ-ﾟ]")
_CJK_START = re.compile("[。！？]\\s*([぀-ヿ㐀-鿿]{2})")
_STRIP = "\"'“”„‘’«»()[]{}「」『』（）《》〈〉,;:!?…。！？।؟،؛、，；：-–—"
_HARD = "!?。！？।॥؟۔｡．"
_LAST = frozenset(_HARD + ".")


def language(lang: str | None) -> str:
    """The primary subtag in lower case; 'und' where there is none of two or three letters."""
    tag = re.split(r"[-_]", (lang or "").strip().lower())[0]
    return tag if re.fullmatch("[a-z]{2,3}", tag) else "und"


def language_column(lang):
    """`language` as a column."""
    tag = F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(F.coalesce(tag, F.lit("")) == "", "und").otherwise(tag)


_MARKED = r"[ \t]*(?:#|[-*+•‣◦·–][ \t]|\(?\d{1,3}[.)][ \t]|\(?[a-zA-Z][)][ \t]|[=_*-]+[ \t]*(?:\n|\Z))"
_MARKED_FIRST, _MARKED_LATER = re.compile(_MARKED), re.compile("\n" + _MARKED)
_GAP = re.compile(r"\n\s*\n")


def blocks(text: str):
    """(kind, start, end) of each fence, heading, list item and paragraph, without surrounding space."""
    if "```" in text or "~~~" in text or len(text.splitlines()) != text.count("\n") + (text[-1:] != "\n" and text != ""):
        yield from _blocks(text)
        return
    at, end = 0, len(text)
    while at < end:
        gap = _GAP.search(text, at)
        a, b = gap.span() if gap else (end, end)
        if a > at:
            if not _MARKED_FIRST.match(text, at, a) and not _MARKED_LATER.search(text, at, a):
                yield from _trimmed(text, "para", at, a)
            elif "\n" not in (part := text[at:a]):
                yield from _trimmed(text, "head" if _HEAD.match(part) else "item" if _ITEM.match(part) else "para", at, a)
            else:
                for kind, x, y in _blocks(part):
                    yield kind, at + x, at + y
        at = b


def _trimmed(text, kind, a, b):
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if b > a:
        yield kind, a, b


def _blocks(text: str):
    """The same line by line, for texts with fences or unusual line ends and for stretches with headings or items."""
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, at + len(line)))
        at += len(line)

    def trimmed(a, b):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        return a, b

    i, para, previous = 0, None, "blank"
    while i < len(lines):
        a, b = lines[i]
        line = text[a:b]
        fence = _FENCE.match(line)
        kind = "blank" if not line.strip() else "fence" if fence else "head" if _HEAD.match(line) else "item" if previous in ("blank", "item", "head", "fence") and _ITEM.match(line) else "line"
        if kind == "line" and previous == "blank" and i + 1 < len(lines) and (m := _RULE.match(text[slice(*lines[i + 1])])) and m[1][0] in "=-" and i + 2 <= len(lines):
            kind, b = "head", lines[i + 1][1]
            i += 1
        if kind != "line" and para is not None:
            yield ("para", *trimmed(*para))
            para = None
        if kind == "fence":
            mark, j = fence[1][:3], i + 1
            while j < len(lines) and not (text[slice(*lines[j])].strip().startswith(mark) and not text[slice(*lines[j])].strip().strip(mark[0])):
                j += 1
            j = min(j, len(lines) - 1)
            yield ("fence", *trimmed(a, lines[j][1]))
            i = j
        elif kind in ("head", "item"):
            yield (kind, *trimmed(a, b))
        elif kind == "line":
            para = (para[0] if para else a, b)
        previous = kind
        i += 1
    if para is not None:
        yield ("para", *trimmed(*para))


@lru_cache(1 << 16)
def shape(token: str) -> str:
    """U capital, l lower case (words, file names), i identifier, d digit, o other, by what a token begins with."""
    t = token.lstrip(_STRIP)
    if not t:
        return "o"
    c = t[0]
    if c.isdigit() or c in "$€£.#§±+":
        return "d"
    if not c.isalpha():
        return "i" if c == "_" else "o"
    core = t.rstrip(_STRIP + ".")
    if "_" in core or "(" in core or (c.islower() and any(x.isdigit() for x in core) and "." not in core):
        return "i"
    if _CJK.match(c) or _THAI.match(c):
        return "o"
    if c.isupper():
        return "U"
    return "l" if c.islower() else "o"


@lru_cache(1 << 16)
def word(token: str) -> str:
    """A token without marks around it; '#' for a number, a digest for more than 64 characters."""
    t = token.strip(_STRIP)
    if t.endswith("."):
        t = t.rstrip(".").rstrip(_STRIP)
    if not t:
        return t
    if t[-1].isdigit() and t[0] in "0123456789.,$€£-+" and not any(x.isalpha() for x in t):
        return "#"
    return t if len(t) <= 64 else "\u0001" + blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Counts:
    """Counts of a batch by language: tokens, pairs of a token that ends something and the next one, and openings."""

    def __init__(self):
        self.tokens: dict[str, Counter] = {}
        self.pairs: dict[str, Counter] = {}
        self.opens: Counter = Counter()

    def add(self, text: str, lang: str) -> None:
        if lang not in self.tokens:
            self.tokens[lang], self.pairs[lang] = Counter(), Counter()
        held, pairs = self.tokens[lang], []
        for kind, a, b in blocks(text):
            if kind == "fence":
                continue
            tokens = _TOKEN.findall(text, a, b)
            if kind != "para":
                tokens = tokens[1:]
            if tokens and _CJK.search(text, a, b):
                self.opens.update((lang, x) for x in _CJK_START.findall(text, a, b))
                if kind == "para" and _CJK.match(text[a]):
                    self.opens[lang, text[a : a + 2]] += 1
            held.update(tokens)
            ends = [i for i, t in enumerate(tokens) if t[-1] in _LAST]
            if kind != "head":
                ends.insert(0, -1)
            n = len(tokens)
            for i in ends:
                j = i + 1
                # the next token that is more than punctuation
                while j < n and not (tokens[j][0].isalnum() or word(tokens[j])):
                    j += 1
                pairs.append((tokens[i] if i >= 0 else "", tokens[j] if j < n else ""))
        self.pairs[lang].update(pairs)

    def rows(self) -> dict[tuple, list[int]]:
        """(lang, kind, word, next) -> [uses, starts, dots, nexts, continued, opens].

        Kind w are words; u are capitals after a period, by the word before it; o are two-character openings.
        """
        out: dict[tuple, list[int]] = {}

        def add(lang, kind, a, b, at, n):
            row = out.get((lang, kind, a, b))
            if row is None:
                row = out[lang, kind, a, b] = [0, 0, 0, 0, 0, 0]
            row[at] += n

        for lang, held in self.tokens.items():
            for t, n in held.items():
                if w := t if len(t) <= 64 and t.isalpha() else word(t):
                    add(lang, "w", w, "", 0, n)
        for lang, pairs in self.pairs.items():
            for (t, after), n in pairs.items():
                w = word(t)
                dot = t[-1:] == "."
                if (t and not w) or (dot and t.endswith("..")):
                    continue
                if dot:
                    add(lang, "w", w, "", 2, n)
                nw = word(after)
                if not nw:
                    continue
                if not dot:
                    add(lang, "w", nw, "", 1, n)
                    continue
                add(lang, "w", w, "", 3, n)
                sh = shape(after)
                if sh == "l" or sh == "d":
                    add(lang, "w", w, "", 4, n)
                elif sh == "U":
                    add(lang, "u", w, nw, 3, n)
        for (lang, x), n in self.opens.items():
            add(lang, "o", x, "", 5, n)
        return out


_NUMBERS = ("uses", "starts", "dots", "nexts", "continued", "opens")
_COUNTS = "lang string, kind string, a string, b string, " + ", ".join(f"{n} long" for n in _NUMBERS)


def _count_batches(batches):
    for batch in batches:
        c = Counts()
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                c.add(text, lang)
        rows = c.rows()
        texts = [pa.array([k[i] if i < 2 else k[i].encode("utf-8", "replace").decode() for k in rows], pa.string()) for i in range(4)]
        numbers = [pa.array([r[i] for r in rows.values()], pa.int64()) for i in range(6)]
        yield pa.RecordBatch.from_arrays([*texts, *numbers], ["lang", "kind", "a", "b", *_NUMBERS])


def _llr(k1, n1, k2, n2):
    """Log-likelihood ratio of two binomials, as a column."""
    p1, p2, p = k1 / n1, k2 / n2, (k1 + k2) / (n1 + n2)
    l = lambda k, n, x: F.when(x <= 0, 0.0).otherwise(k * F.log(F.greatest(x, F.lit(1e-300)))) + F.when(x >= 1, 0.0).otherwise((n - k) * F.log(F.greatest(1 - x, F.lit(1e-300))))
    return 2 * (l(k1, n1, p1) + l(k2, n2, p2) - l(k1, n1, p) - l(k2, n2, p))


LISTS = ("starters", "openings", "abbreviations", "ordinals", "final", "middle", "plain")


class Model:
    """Words by list and language.

    starters start sentences; openings are the first two characters of sentences in scripts without spaces;
    abbreviations have periods that end nothing; of these, final often end sentences all the same, and middle practically
    never, such as titles; ordinals follow the period of a number; plain words end sentences, whatever they look like.
    """

    def __init__(self, rows=()):
        for name in LISTS:
            setattr(self, name, {})
        for lang, name, a in rows:
            getattr(self, name).setdefault(lang, set()).add(a)


def learn(documents: DataFrame) -> DataFrame:
    """(lang, list, a): all lists, from all texts. Counting is combined in each batch and before the shuffle."""
    raw = spread(documents.select("text", language_column(F.col("lang")).alias("lang"))).mapInArrow(_count_batches, _COUNTS)
    sums = [F.sum(n).alias(n) for n in _NUMBERS]
    each = settle(raw.groupBy("lang", "kind", "a", "b").agg(*sums))
    every = each.groupBy("kind", "a", "b").agg(*sums).select(F.lit("*").alias("lang"), "kind", "a", "b", *_NUMBERS)
    # one row a language, of which there are few by definition
    is_word = F.col("kind") == "w"
    totals = [F.sum("uses").alias("N"), F.sum("starts").alias("S"), F.sum("opens").alias("O"), *(F.sum(F.when(is_word, F.col(x))).alias(y) for x, y in (("nexts", "tp"), ("continued", "tk"))), F.sum(F.when(is_word & (F.col("a") == "#"), F.col("nexts"))).alias("P")]
    own = each.groupBy("lang").agg(*totals)
    of = settle(own.unionByName(own.agg(*(F.sum(x).alias(x) for x in ("N", "S", "O", "tp", "tk", "P"))).withColumn("lang", F.lit("*"))))
    # no list has words of fewer uses; they count in the totals only
    often = (~is_word) | (F.col("uses") >= MIN_COUNT)
    c = settle(each.where(often).unionByName(every.where(often)))
    enough = lambda n, of: (F.col(n) >= MIN_COUNT) & (F.col(n) >= MIN_SHARE * F.col(of))
    words = c.where("kind = 'w'").select("lang", "a", *_NUMBERS[:-1])
    s = words.where(F.col("starts") >= MIN_COUNT).join(F.broadcast(of), "lang")
    k1, n1 = F.col("starts").cast("double"), F.col("uses").cast("double")
    rest_n = F.greatest(F.col("N") - F.col("uses"), F.lit(1)).cast("double")
    starter = s.where(enough("starts", "S")).where((k1 / n1 > 3 * F.col("S") / F.col("N")) | (k1 / n1 >= 0.5)).where(_llr(k1, n1, F.least(F.greatest(F.col("S") - k1, F.lit(0.0)), rest_n), rest_n) > LLR)
    starter = settle(starter.select("lang", "a"))
    opening = c.where((F.col("kind") == "o") & (F.col("opens") >= MIN_COUNT)).join(F.broadcast(of), "lang").where(F.col("opens") >= 5e-4 * F.col("O"))
    # capitals after a period that start no sentence, by the word before
    capital = c.where("kind = 'u'").select("lang", "a", "b", F.col("nexts").alias("after"))
    strange = capital.where("a <> '#'").join(starter.select("lang", F.col("a").alias("b")), ["lang", "b"], "left_anti").join(starter.where("lang = '*'").select(F.col("a").alias("b")), "b", "left_anti")
    per = words.where("nexts > 0").join(strange.groupBy("lang", "a").agg(F.sum("after").alias("strange"), (F.sum("after") * F.sum("after") / F.sum(F.col("after") * F.col("after"))).alias("kinds")), ["lang", "a"], "left")
    # titles stand before different names, of which there must be enough: one phrase said often is no evidence
    kept = F.when((F.col("dots") >= PERIOD_SHARE * F.col("uses")) & (F.col("kinds") >= MIN_COUNT), F.col("strange")).otherwise(0)
    per = settle(per.select("lang", "a", "uses", "dots", F.col("nexts").alias("np"), kept.alias("kept"), (F.col("continued") + kept).alias("nk"), (F.col("continued") + F.coalesce("strange", F.lit(0))).alias("most")))
    all_ = of.select("lang", "tp", F.col("tk").alias("sure")).join(F.broadcast(per.groupBy("lang").agg(F.sum("kept").alias("kept"))), "lang", "left").select("lang", "tp", (F.col("sure") + F.coalesce("kept", F.lit(0))).alias("tk"))
    # an abbreviation has its period in most of its uses, and no dot inside but between one or two letters
    x = per.where(F.col("np") >= MIN_COUNT).where(r"a <> '#' and a rlike '^(\\p{L}{1,2}[.])*\\p{L}{1,2}$|^[^.]+$'").join(F.broadcast(all_), "lang").where(enough("np", "tp"))
    k, n = F.col("nk").cast("double"), F.col("np").cast("double")
    rn = F.greatest(F.col("tp") - F.col("np"), F.lit(1)).cast("double")
    rk = F.least(F.greatest(F.col("tk") - F.col("nk"), F.lit(0)).cast("double"), rn)
    is_abbr = (F.col("dots") >= 0.5 * F.col("uses")) & (k / n >= 0.35) & ((_llr(k, n, rk, rn) > LLR) & (k / n > rk / rn) | (k / n >= 0.9))
    # significantly more often than nine times in ten something continues
    never = (k / n > 0.9) & (_llr(k, n, 0.9 * n * 1e6, n * 1e6) > LLR_95)
    is_plain = (F.col("most") / n < 0.1) & ((F.length("a") == 1) | F.col("a").contains("."))
    lists = F.array_compact(F.array(F.when(is_abbr, "abbreviations"), F.when(is_abbr & never, "middle"), F.when(is_abbr & (k / n < 0.75), "final"), F.when(is_plain, "plain")))
    by_period = x.select("lang", F.explode(lists).alias("list"), "a")
    # what follows numbers more often than other words: words that start sentences otherwise do not count
    o = capital.where(f"a = '#' and after >= {MIN_COUNT}").select("lang", "b", "after").join(words.select("lang", F.col("a").alias("b"), "uses", "starts"), ["lang", "b"]).join(F.broadcast(of), "lang")
    kk, nn = F.col("after").cast("double"), F.col("P").cast("double")
    ordinal = o.where(enough("after", "P")).where("starts < after").where(_llr(kk, nn, F.greatest(F.col("uses") - kk, F.lit(0.0)), F.greatest(F.col("N") - nn, F.lit(1.0))) > LLR)
    named = lambda df, name, col="a": df.select("lang", F.lit(name).alias("list"), F.col(col).alias("a"))
    return settle(named(starter, "starters").unionByName(named(opening, "openings")).unionByName(by_period).unionByName(named(ordinal, "ordinals", "b")))


_SPAN_MARKS = re.compile("[\"'" + re.escape("".join(sorted(set(OPEN) | set(OPEN.values())))) + "]")


def _spans(text: str) -> bytearray | None:
    """For each position whether quotes or brackets stand around it, counting only pairs that close in this text. None if nowhere."""
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}  # how often each closer is on the stack: no search for one that is not
    pairs = []
    for m in _SPAN_MARKS.finditer(text):
        i = m.start()
        ch = text[i]
        closer = None
        if ch == '"' or ch == "'":
            before, after = text[i - 1 : i], text[i + 1 : i + 2]
            opens = (not before or before.isspace() or before in "([{«“„—–-（「:" or _CJK.match(before) is not None) and after and not after.isspace()
            if waiting.get(ch) and not (opens and before and before.isspace() and ch == "'"):
                if ch == "'" and after and after.isalnum():
                    continue
                closer = ch
            elif opens:
                stack.append((ch, i))
                waiting[ch] = waiting.get(ch, 0) + 1
                continue
        elif waiting.get(ch):
            closer = ch
        elif ch in OPEN and not (ch == "‘" and text[i - 1 : i].isalnum()):
            c = OPEN[ch]
            stack.append((c, i))
            waiting[c] = waiting.get(c, 0) + 1
        if closer is not None:
            # pair with the nearest opener; those above it are left without partner
            while True:
                c, at = stack.pop()
                waiting[c] -= 1
                if c == closer:
                    pairs.append((at, i))
                    break
    if not pairs:
        return None
    inside = bytearray(len(text) + 1)
    end = -1
    for a, b in sorted(pairs):
        if b > end:
            a = max(a, end)
            inside[a:b] = b"\1" * (b - a)  # the opener counts as inside, the closer as outside
            end = b
    return inside


class Cutter:
    """Classifies the terminators of paragraphs, with the lists of one language and of all."""

    def __init__(self, model: Model, lang: str):
        both = lambda m: m.get(lang, set()) | m.get("*", set())
        self.starters, self.abbreviations, self.ordinals = both(model.starters), both(model.abbreviations), both(model.ordinals)
        self.openings = both(model.openings)
        self.plain = both(model.plain) - self.abbreviations
        self.middle = model.middle.get(lang, set()) | (model.middle.get("*", set()) - (model.abbreviations.get(lang, set()) - model.middle.get(lang, set())))
        self.final = model.final.get(lang, set()) if lang in model.abbreviations else model.final.get("*", set())

    def ends(self, text: str) -> list[int]:
        """Ends of the sentences of a paragraph, the last one left out."""
        thai = bool(_THAI.search(text))
        if not thai and not _INNER.search(text):
            return []
        depth = _spans(text)
        out = []
        n = len(text)
        for m in _END.finditer(text):
            a, b = m.span()
            marks = m[0]
            if marks == "." and b < n and text[b].isalnum() and not _CJK.match(text[b]):
                continue  # of a number, a version or a file name
            if depth and depth[a]:
                # inside a pair: the end may come where the pair closes
                e = b
                while e < n and (text[e].isspace() or text[e] in CLOSERS) and depth[e - 1 if e else 0]:
                    e += 1
                if e >= n or depth[e] or depth[e - 1] or text[e - 1] not in CLOSERS:
                    continue
                if self._after_pair(text, a, b, e, marks, depth):
                    out.append(e)
                continue
            e = b
            while e < n and text[e] in CLOSERS and not (depth and depth[e]):
                e += 1
            if e >= n:
                continue
            if self._ends(text, a, b, e, marks):
                out.append(e)
        if thai:
            for m in re.finditer(r"[ \t ]+|[ \t]*\n[ \t]*", text):
                a, b = m.span()
                if depth and depth[a] or a == 0 or b >= n:
                    continue
                if _THAI.match(text[a - 1]) and _THAI.match(text[b]) or (_THAI.match(text[b]) and text[a - 1] in "\"”’»)]」』）") or (_THAI.match(text[a - 1]) and text[b] in "\"“‘«([「『（"):
                    out.append(a)
            out = sorted(set(out))
        return out

    def _next(self, text: str, e: int) -> str:
        m = _TOKEN.search(text, e)
        return m[0] if m else ""

    def _after_pair(self, text, a, b, e, marks, depth) -> bool:
        """A pair that ends in a terminator has closed at e: does the sentence end there?"""
        k = a
        while k > 0 and depth[k - 1]:
            k -= 1
        p = k
        while p > 0 and text[p - 1].isspace():
            p -= 1
        alone = p == 0 or text[p - 1] in _HARD + "." or text[p - 1] in CLOSERS or (bool(_THAI.match(text[p - 1])) and p < k)
        bracket = text[k] in "([{（【"
        nxt = text[e]
        if _END.match(nxt) or nxt in ",;:、，；：،؛":
            return False
        tok = self._next(text, e)
        if _CJK.match(tok[:1]) or _THAI.match(tok[:1]) or (tok and shape(tok) == "o"):
            if bracket:
                return alone
            if _CJK.match(tok[:1]):
                return tok[:2] in self.openings
            if _THAI.match(tok[:1]):
                return nxt.isspace()
            return word(tok) in self.starters
        if not nxt.isspace():
            return bracket and alone
        s = shape(tok)
        if bracket and alone:
            return True
        return s == "U" or (s == "i" and tok.lstrip(_STRIP)[:1].islower() and word(tok) in self.starters) or s == "d" and alone or (s == "i" and ("_" in tok or "(" in tok))

    def _ends(self, text, a, b, e, marks) -> bool:
        nxt = text[e]
        if "…" in marks or marks.startswith(".."):
            if not nxt.isspace():
                return False
            return shape(self._next(text, e)) == "U"
        if any(c in _HARD for c in marks):
            if marks[-1] in "!?" and not nxt.isspace() and not _CJK.match(nxt) and nxt.isalnum():
                return False
            return nxt not in ",;:、，；：،؛"
        if not nxt.isspace():
            return False
        near = text[max(0, b - 80) : b].rsplit(None, 1)
        if len(near) > 1 or b <= 80:
            tok = near[-1]
        else:
            s = a
            while s > 0 and not text[s - 1].isspace():
                s -= 1
            tok = text[s:b]
        core = tok.lstrip(_STRIP)
        w = word(core)
        after = self._next(text, e)
        sh, nw = shape(after), word(after)
        starts = nw in self.starters
        opened = after[:1] in OPEN or after[:1] in "\"'"
        if w == "#":
            if sh == "U":
                return starts or nw not in self.ordinals
            return sh in "io" or (sh == "d" and opened)
        bare = core[:-1]
        letter = len(bare) == 1 and bare.isalpha()
        dotted = "." in bare and all(len(p) <= 2 and p.isalpha() for p in bare.split(".") if p)
        known = w in self.abbreviations or (w[:1].isupper() and w[1:].islower() and w.lower() in self.abbreviations and w not in self.plain)
        if known or (letter or dotted) and w not in self.plain:
            if sh == "U":
                return starts and w not in self.middle and not (letter and bare.isupper() and len(nw) == 1)
            return sh in "io" and w in self.final
        return True

    def units(self, text: str) -> list[tuple[int, int]]:
        out = []
        for kind, a, b in blocks(text):
            if b <= a:
                continue
            if kind != "para":
                out.append((a, b))
                continue
            para = text[a:b]
            ends = self.ends(para)
            if not ends:
                out.append((a, b))
                continue
            at = 0
            for e in [*ends, len(para)]:
                x, y = at, e
                while x < y and para[x].isspace():
                    x += 1
                while y > x and para[y - 1].isspace():
                    y -= 1
                if y > x:
                    out.append((a + x, a + y))
                at = e
        return out


def _language_groups(lists: DataFrame) -> list[list[str]]:
    """Languages with lists, in groups of at most LIST_ENTRIES entries, unless one language alone has more."""
    out: list[list[str]] = [[]]
    held = 0
    for r in lists.where("lang <> '*'").groupBy("lang").count().orderBy(F.desc("count"), "lang").collect():
        if out[-1] and held + r[1] > LIST_ENTRIES:
            out.append([])
            held = 0
        out[-1].append(r[0])
        held += r[1]
    return out


def found_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_start, sent_end) of every unit, zero-based code points, end exclusive, without surrounding space.

    Null, empty and blank texts have no unit; a text of any length is read whole; a null language counts as 'und', a
    language like any other, and what was learned over all languages counts for each. Repeated doc_ids give their
    units as often as they occur.
    """
    spark = documents.sparkSession
    lists = learn(documents)
    rows = documents.select(F.col("doc_id").cast("long"), "text", language_column(F.col("lang")).alias("lang"))
    groups = _language_groups(lists)
    later = [g for group in groups[1:] for g in group]
    out = None
    for i, group in enumerate(groups):
        # the first run also takes the languages without lists of their own
        own = rows if len(groups) == 1 else rows.where(F.col("lang").isin(group)) if i else rows.where(~F.col("lang").isin(later))
        wanted = lists if len(groups) == 1 else lists.where(F.col("lang").isin(["*", *group]))
        shared = spark.sparkContext.broadcast(Model(wanted.select("lang", "list", "a").toLocalIterator()))

        def cut(batches, shared=shared):
            cutters: dict = {}
            for b in batches:
                ids, counts, st, en = [], [], [], []
                for d, text, g in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if not text:
                        continue
                    if g not in cutters:
                        cutters[g] = Cutter(shared.value, g)
                    got = cutters[g].units(text)
                    ids.append(d)
                    counts.append(len(got))
                    for x, y in got:
                        st.append(x)
                        en.append(y)
                ids = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), counts)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(st, pa.int32()), pa.array(en, pa.int32())], ["doc_id", "sent_start", "sent_end"])

        part = spread(own).mapInArrow(cut, "doc_id long, sent_start int, sent_end int")
        out = part if out is None else out.unionByName(part)
    return out
