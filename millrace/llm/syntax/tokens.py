"""Tokens of Python, JavaScript and C files. Each scanner returns the tokens, or None where even scanning fails."""

from __future__ import annotations

import io
import keyword
import re
import tokenize

from .gll import EOF



class Token(tuple):
    """(kinds, fresh). Equal tokens are one object, so they are compared and hashed as objects."""

    __slots__ = ()
    __hash__ = object.__hash__
    __eq__ = object.__eq__


END = Token(((EOF,), True))
_CACHE: dict = {}


def _tok(*kinds, fresh=False):
    got = _CACHE.get((kinds, fresh))
    if got is None:
        got = _CACHE[kinds, fresh] = Token((kinds, fresh))
    return got


def newlines(text: str) -> str:
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


# ---- Python -----------------------------------------------------------------------------------------------------
_PY_KEYWORDS = set(keyword.kwlist)
_PY_SOFT = {"match", "case", "type", "_"}
_PY_SKIP = {tokenize.COMMENT, tokenize.NL, tokenize.ENCODING, tokenize.ENDMARKER}
_PY_KIND = {getattr(tokenize, k): k for k in ("NUMBER", "STRING", "NEWLINE", "INDENT", "DEDENT", "FSTRING_START", "FSTRING_MIDDLE", "FSTRING_END") if hasattr(tokenize, k)}


class _Names(dict):
    """Token of each string seen, classified once; forgets all when it holds too many."""

    def __init__(self, classify):
        self.classify = classify

    def __missing__(self, s):
        if len(self) >= MOST_STRINGS:
            self.clear()
        got = self[s] = self.classify(s)
        return got


#: Strings that a worker remembers with their tokens; a bound of memory, without effect on any result.
MOST_STRINGS = 200_000


def _python_name(s: str):
    return _tok(s) if s in _PY_KEYWORDS else _tok("NAME", s) if s in _PY_SOFT else _tok("NAME")


_PY_NAMES = _Names(_python_name)
_PY_OPS = _Names(_tok)
_PY_FIXED = {k: _tok(v) for k, v in _PY_KIND.items()}


def python_tokens(text: str):
    text = newlines(text)
    if "\0" in text:
        return None
    out = []
    add = out.append
    names, ops, fixed, skip, name, op = _PY_NAMES, _PY_OPS, _PY_FIXED, _PY_SKIP, tokenize.NAME, tokenize.OP
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            k = t[0]
            if k == name:
                add(names[t[1]])
            elif k == op:
                add(ops[t[1]])
            elif k in fixed:
                add(fixed[k])
            elif k not in skip:
                return None
    except (tokenize.TokenError, SyntaxError, IndentationError, ValueError):
        return None
    add(END)
    return out


# ---- JavaScript --------------------------------------------------------------------------------------------------
_JS_RESERVED = set("break case catch class const continue debugger default delete do else extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum export".split())
_JS_SOFT = set("let static async of get set await yield target".split())
_JS = re.compile(
    r"""(?P<space>[ \t\v\f ﻿ -   　]+)|(?P<line>[\n  ])|(?P<comment>//[^\n  ]*|/\*.*?\*/)
    |(?P<name>\#?(?:[\w$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})+)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*%&|^!~?:=.@])""",
    re.X | re.S,
)
_JS_NUM = re.compile(r"(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*)n?|\d(?:_?\d)*n|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?")
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_JS_TEXT = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_JS_VALUE = {"name", "num", "string", "regex", "template"}
_JS_OPERATORS_THEN_VALUE = set("return typeof instanceof in of new delete void throw case do else yield await".split())


def _javascript_one_by_one(text: str):
    """(tokens, their texts and line ends) by a scanner that knows at each / and } what stands open; None where it fails."""
    out, at, n, fresh = [], 0, len(text), True
    value = False  # whether the last token ends a value, so that / divides
    stack: list[tuple[str, bool]] = []  # open brackets; for ( whether a header, for { whether an object, ` a template
    last = ""
    texts: list[str] = []
    begin = 0
    while at < n:
        if len(out) > len(texts):
            texts.append(text[begin:at])
        begin = at
        c = text[at]
        if c == "`" or (c == "}" and stack and stack[-1][0] == "${"):
            if c == "`":
                begin, value = True, False
            else:
                stack.pop()
                begin = False
            m = _JS_TEXT.match(text, at + 1)
            at = m.end()
            if text.startswith("${", at):
                out.append(_tok("TEMPLATE_HEAD" if begin else "TEMPLATE_MIDDLE", fresh=fresh))
                stack.append(("${", False))
                at += 2
                value, last = False, "${"
            elif text.startswith("`", at):
                out.append(_tok("TEMPLATE" if begin else "TEMPLATE_TAIL", fresh=fresh))
                at += 1
                value, last = True, "`"
            else:
                return None
            fresh = False
            continue
        if c == "/" and text[at + 1 : at + 2] not in ("/", "*"):
            if value:
                op = "/=" if text.startswith("/=", at) else "/"
                out.append(_tok(op, fresh=fresh))
                at += len(op)
                value, last, fresh = False, op, False
                continue
            m = _JS_REGEX.match(text, at)
            if not m:
                return None
            out.append(_tok("REGEX", fresh=fresh))
            at, value, last, fresh = m.end(), True, "regex", False
            continue
        if (c.isdigit() and c.isascii()) or (c == "." and text[at + 1 : at + 2].isdigit()):
            m = _JS_NUM.match(text, at)
            at = m.end()
            if at < n and (text[at].isalnum() or text[at] in "_$"):
                return None
            out.append(_tok("NUMBER", fresh=fresh))
            value, last, fresh = True, "0", False
            continue
        m = _JS.match(text, at)
        if not m:
            return None
        at = m.end()
        kind, s = m.lastgroup, m[0]
        if kind == "space":
            continue
        if kind == "line":
            fresh = True
            continue
        if kind == "comment":
            fresh = fresh or "\n" in s
            continue
        if kind == "name":
            if s[0] == "#":
                if len(s) < 2 or s[1].isdigit():
                    return None
                out.append(_tok("PRIVATE", fresh=fresh))
                value = True
            elif last in (".", "?."):
                out.append(_tok(s, "WORD", fresh=fresh) if s in _JS_RESERVED else _tok(*(("NAME", s, "WORD") if s in _JS_SOFT else ("NAME", "WORD")), fresh=fresh))
                value = True
            elif s in _JS_RESERVED:
                out.append(_tok(s, "WORD", fresh=fresh))
                value = s in ("this", "super", "null", "true", "false")
            else:
                out.append(_tok("NAME", s, "WORD", fresh=fresh) if s in _JS_SOFT else _tok("NAME", "WORD", fresh=fresh))
                value = s not in ("yield", "await", "of")
        elif kind == "string":
            out.append(_tok("STRING", fresh=fresh))
            value = True
        else:
            out.append(_tok(s, fresh=fresh))
            if s in "([{":
                stack.append((s, last in ("if", "while", "for", "with") if s == "(" else not value and last not in ("=>", ";", "{", "}", "else", "do", "try", "finally", "") and last != ")" if s == "{" else False))
                value = False
            elif s in ")]}":
                want = {")": "(", "]": "[", "}": "{"}[s]
                if not stack or stack[-1][0] != want:
                    return None
                _, flag = stack.pop()
                value = not flag if s == ")" else True if s == "]" else flag
            else:
                value = s in ("++", "--") and value
        last, fresh = s, False
    if stack:
        return None
    if len(out) > len(texts):
        texts.append(text[begin:at])
    strs = [x for t, y in zip(out, texts) for x in (("\n", y) if t[1] else (y,))]
    out.append(END)
    return out, strs


#: All tokens of a file at once, where neighbours decide what a slash or a template is.
_JS_ALL = re.compile(
    r"""[ \t\v\f\u00a0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]*(
    [\n\u2028\u2029]+|//[^\n\u2028\u2029]*|/\*.*?\*/
    |(?:>>>=|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\+=|-=|\*=|%=|&=|\|=|\^=|<<|>>|\*\*|[{(\[;,<>+\-*%&|^!~?:=])[ \t\n]*/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*
    |\#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*
    |"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'
    |`(?:[^`\\$]|\\.|\$(?!\{)|\$\{[^{}`"'/\\]*\})*`
    |0[xXoObB][\w$]*|\.?\d(?:[eE][+-]?(?=\d)|[\w.$])*
    |>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|.)""",
    re.X | re.S,
)
_JS_HOLE = re.compile(r"((?:[^`\\$]|\\.|\$(?!\{))*)(?:\$\{([^{}]*)\})?", re.S)
_JS_OP_REGEX = re.compile(r"([^\s/]+)\s*/(?!=?$)", re.S)
_JS_OPS = frozenset(">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** { } ( ) [ ] ; , < > + - * % & | ^ ! ~ ? : = . @ /".split())


class _Many(list):
    """Tokens that one match stands for."""


class _Unsure(Exception):
    """Only the other scanner can tell what a match is."""


_SKIP, _LINE = Token((("skip",), False)), Token((("line",), False))


def _js_string(s: str):
    """Token of one match."""
    c = s[0]
    if c in "\"'":
        if len(s) > 1:
            return _tok("STRING")
        raise _Unsure
    if c in "\n\u2028\u2029":
        return _LINE
    if c == "/" and s[1:2] in ("/", "*"):
        return _LINE if "\n" in s else _SKIP
    if c == "`":
        if len(s) < 2:
            raise _Unsure
        out, at = _Many(), 1
        while True:
            m = _JS_HOLE.match(s, at)
            at = m.end()
            if m[2] is None:
                out.append(_tok("TEMPLATE_TAIL" if out else "TEMPLATE"))
                return out
            out.append(_tok("TEMPLATE_MIDDLE" if out else "TEMPLATE_HEAD"))
            inner = _javascript_at_once(m[2], False)
            if inner is None:
                raise _Unsure
            out.extend(inner[0][:-1])
    if c.isdigit() or (c == "." and s[1:2].isdigit()):
        if _JS_NUM.fullmatch(s):
            return _tok("NUMBER")
        raise _Unsure
    if c == "#" and len(s) > 1:
        return _tok("PRIVATE")
    if s in _JS_OPS:
        return _tok(s)
    if len(s) > 1 and (m := _JS_OP_REGEX.match(s)):
        return _Many((_tok(m[1]), _tok("REGEX")))
    if s != "\\" and (c.isalpha() or c in "_$\\"):
        return _tok(s, "WORD") if s in _JS_RESERVED else _tok("NAME", s, "WORD") if s in _JS_SOFT else _tok("NAME", "WORD")
    raise _Unsure


class _JsNames(_Names):
    def __missing__(self, s):
        got = _js_string(s)
        if s[0] not in "`\"'/" and len(s) < 64:
            if len(self) >= MOST_STRINGS:
                self.clear()
            self[s] = got
        return got


_JS_NAMES = _JsNames(_js_string)


def _javascript_at_once(text: str, fresh: bool = True):
    """(tokens, their texts and line ends) by one pass of a pattern; None where a slash or template needs more than its neighbours."""
    names, strs = _JS_NAMES, _JS_ALL.findall(text)
    try:
        raw = [names[s] for s in strs]
    except _Unsure:
        return None
    out: list = []
    add, line, skip = out.append, _LINE, _SKIP
    for t in raw:
        if t is line:
            fresh = True
        elif t is skip:
            continue
        elif t.__class__ is _Many:
            out.extend(t)
            if fresh:
                out[-len(t)] = _FRESH[t[0]]
                fresh = False
        elif fresh:
            add(_FRESH[t])
            fresh = False
        else:
            add(t)
    if "/" in strs or "/=" in strs:
        before = None
        for t in out:
            if t[0][0] in ("/", "/=") and not (before and (before[0][0] in ("NAME", "NUMBER", "STRING", "]", "TEMPLATE", "TEMPLATE_TAIL") and before[0][1:2] not in (("yield",), ("await",), ("of",)))):
                return None
            before = t
    add(END)
    return out, strs


class _Fresh(dict):
    def __missing__(self, t):
        got = self[t] = _tok(*t[0], fresh=True)
        return got


_FRESH = _Fresh()


_JS_SCOPES = frozenset("{ } ( ) [ ] , ; let const class var function".split())
_JS_NAME = re.compile(r"(?:[^\W\d]|[$\\])[\w$\\{}]*")
_JS_CONTINUES = frozenset("in instanceof of".split())


def _blank(s: str) -> bool:
    return s[0] in "\n\u2028\u2029" or s[:2] in ("//", "/*")


def _is_name(s: str) -> bool:
    return _JS_NAME.fullmatch(s) is not None and s not in _JS_RESERVED


def _bound(strs: list[str], i: int) -> tuple[list[str], int]:
    """Names that the binding at i declares, and where it ends."""
    if strs[i] not in ("{", "["):
        return ([strs[i]], i + 1) if _is_name(strs[i]) else ([], i)
    names, open_, n = [], [strs[i]], len(strs)
    i, ready = i + 1, True  # ready: a name here is bound, unless a colon follows
    while i < n and open_:
        s = strs[i]
        if _blank(s):
            i += 1
            continue
        if s in "{[" and ready:
            open_.append(s)
        elif s in ("{", "[", "("):  # of a default value or a computed key
            depth, i = 1, i + 1
            while i < n and depth:
                depth += (strs[i] in ("{", "[", "(")) - (strs[i] in ("}", "]", ")"))
                i += 1
            ready = False
            continue
        elif s in ("}", "]"):
            open_.pop()
            ready = False
        elif s in (",", ":", "..."):
            ready = True
        elif ready and _JS_NAME.fullmatch(s):
            k = i + 1
            while k < n and _blank(strs[k]):
                k += 1
            if not (open_[-1] == "{" and k < n and strs[k] == ":"):
                names.append(s)
            ready = False
        else:
            ready = False
        i += 1
    return names, i


def _redeclares(strs: list[str]) -> bool:
    """Whether one block declares a name twice where let, const or class takes part: an error before anything runs.

    var in an inner block against let outside, and parameters against let, are not compared.
    """
    if "let" not in strs and "const" not in strs and "class" not in strs:
        return False
    scopes: list[tuple[dict, list]] = [({}, [None])]
    n = len(strs)

    def significant(i):
        while i < n and _blank(strs[i]):
            i += 1
        return i

    def declare(names, kind) -> bool:
        held = scopes[-1][0]
        for x in names:
            if x in held and (kind == "lexical" or held[x] == "lexical"):
                return True
            held[x] = kind
        return False

    i, before = 0, ""
    while i < n:
        s = strs[i]
        if s not in _JS_SCOPES:
            if s[0] == "\n" or _blank(s):
                mode = scopes[-1][1]
                if mode[0] and "\n" in s and before and (before[-1].isalnum() or before[-1] in "_$)]}\"'`") and before not in _JS_CONTINUES:
                    k = significant(i)
                    if k < n and _JS_NAME.match(strs[k]) and strs[k] not in _JS_CONTINUES:
                        mode[0] = None  # a line break ends the declaration
            else:
                before = s
            i += 1
            continue
        i += 1
        if s in ("{", "(", "["):
            scopes.append(({}, [None]))
        elif s in ("}", ")", "]"):
            if len(scopes) > 1:
                scopes.pop()
        elif s == ";":
            scopes[-1][1][0] = None
        elif s == ",":
            kind = scopes[-1][1][0]
            if kind:
                k = significant(i)
                if k < n:
                    names, i = _bound(strs, k)
                    if declare(names, kind):
                        return True
                    before = strs[i - 1]
                    continue
        elif before not in (".", "?."):
            k = significant(i)
            if k < n and s in ("let", "const", "var") and (_is_name(strs[k]) or strs[k] in "{[") and strs[k] not in _JS_CONTINUES:
                kind = "var" if s == "var" else "lexical"
                scopes[-1][1][0] = kind
                names, i = _bound(strs, k)
                if declare(names, kind):
                    return True
                before = strs[i - 1]
                continue
            if k < n and s in ("class", "function") and before in ("", ";", "{", "}") and _is_name(strs[k]) and strs[k] != "extends":
                if declare([strs[k]], "lexical" if s == "class" else "var"):
                    return True
        before = s
    return False


def javascript_tokens(text: str):
    """Tokens, or None where scanning fails or a block declares a name twice."""
    text = newlines(text)
    if text.startswith("#!"):
        text = text[text.find("\n") if "\n" in text else len(text) :]
    got = _javascript_at_once(text) or _javascript_one_by_one(text)
    return None if got is None or _redeclares(got[1]) else got[0]


# ---- C -----------------------------------------------------------------------------------------------------------
_C_KEYWORDS = set("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Imaginary _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local".split())
_C_ALIAS = {"__inline": "inline", "__inline__": "inline", "__const": "const", "__const__": "const", "__volatile__": "volatile", "__volatile": "volatile", "__restrict": "restrict", "__restrict__": "restrict", "__signed__": "signed", "__thread": "_Thread_local", "asm": "asm", "__asm__": "asm", "__asm": "asm", "__attribute__": "__attribute__", "__attribute": "__attribute__", "__extension__": "__extension__", "typeof": "typeof", "__typeof__": "typeof", "__typeof": "typeof"}
_C_STRING = r"""(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*"|[uUL]?'(?:[^'\\\n]|\\.)+'"""
_C_ALL = re.compile(
    r"[ \t\v\f\n]*(" + _C_STRING + r"""|[A-Za-z_$][\w$]*|\.?\d(?:[eEpP][+-]|[\w.])*
    |%:%:|<<=|>>=|\.\.\.|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\*=|/=|%=|\+=|-=|&=|\^=|\|=|\#\#|[^ \t\v\f\n])""",
    re.X,
)
_C_OPS = frozenset("%:%: <<= >>= ... -> ++ -- << >> <= >= == != && || *= /= %= += -= &= ^= |= [ ] ( ) { } . & * + - ~ ! / % < > ^ | ? : ; = ,".split())
_C_COMMENT = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\'|/\*', re.S)
_C_DIRECTIVE = re.compile(r"[ \t]*(?:#|%:)[ \t]*(\w*)(.*)", re.S)
_C_NUM = re.compile(r"(?:(?:0[xX][\da-fA-F]+|0[bB][01]+|0[0-7]*|[1-9]\d*)[uUlLiIjJ]*|0[xX](?:[\da-fA-F]*\.[\da-fA-F]+|[\da-fA-F]+\.?)[pP][+-]?\d+[fFlL]?|(?:(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)[fFlLiIjJ]*)")
#: Tokens that the macros of one file may expand to, before it counts as undecided.
MOST_EXPANDED = 2_000_000


class Undecided(Exception):
    """A file that this recogniser cannot judge."""


def _strip_comment(m: re.Match) -> str:
    s = m[0]
    if s == "/*":
        raise ValueError("comment without end")
    return " " if s[0] == "/" else s


def _c_string(s: str):
    """Token of a preprocessed C token."""
    c = s[0]
    if s[-1] == '"' and len(s) > 1:
        return _tok("STRING")
    if s[-1] == "'" and len(s) > 2:
        return _tok("CHAR")
    if c.isdigit() or (c == "." and s[1:2].isdigit()):
        if _C_NUM.fullmatch(s):
            return _tok("NUMBER")
        raise ValueError("no number")
    if c.isascii() and (c.isalpha() or c in "_$"):
        s = _C_ALIAS.get(s, s)
        return _tok(s) if s in _C_WORDS else _tok("NAME")
    if s in _C_OPS:
        return _tok(s)
    raise ValueError("no token")


_C_WORDS = _C_KEYWORDS | set(_C_ALIAS.values())
_C_NAMES = _Names(_c_string)


class _Value:
    """The value of an #if expression, by precedence climbing, in 64 bits; None stands for a division by zero."""

    RANK = {"*": 10, "/": 10, "%": 10, "+": 9, "-": 9, "<<": 8, ">>": 8, "<": 7, ">": 7, "<=": 7, ">=": 7, "==": 6, "!=": 6, "&": 5, "^": 4, "|": 3, "&&": 2, "||": 1}

    def __init__(self, toks: list[str]):
        self.toks, self.at = toks, 0

    def whole(self) -> bool:
        if not self.toks:
            raise ValueError("#if without expression")
        v = self.choice()
        if self.at != len(self.toks) or v is None:
            raise ValueError("bad #if")
        return bool(v)

    def take(self) -> str:
        if self.at >= len(self.toks):
            raise ValueError("bad #if")
        self.at += 1
        return self.toks[self.at - 1]

    def peek(self) -> str:
        return self.toks[self.at] if self.at < len(self.toks) else ""

    def choice(self):
        test = self.operands(1)
        if self.peek() != "?":
            return test
        self.take()
        yes = self.choice()
        if self.take() != ":":
            raise ValueError("bad #if")
        no = self.choice()
        return None if test is None else yes if test else no

    def operands(self, least: int):
        left = self.one()
        while (rank := self.RANK.get(self.peek(), 0)) >= least:
            op = self.take()
            left = self.apply(op, left, self.operands(rank + 1))
        return left

    @staticmethod
    def apply(op, a, b):
        if op == "&&":
            return 0 if a == 0 else None if a is None or b is None else int(b != 0)
        if op == "||":
            return 1 if a else None if a is None or b is None else int(b != 0)
        if a is None or b is None or (op in "/%" and b == 0):
            return None
        if op in ("/", "%"):
            q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            v = q if op == "/" else a - q * b
        elif op in ("<<", ">>"):
            b = -b if op == ">>" else b
            v = a << min(b, 64) if b >= 0 else a >> min(-b, 64)
        else:
            v = {"*": a * b, "+": a + b, "-": a - b, "&": a & b, "^": a ^ b, "|": a | b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
        v = int(v) & ((1 << 64) - 1)
        return v - (1 << 64) if v >> 63 else v

    def one(self):
        s = self.take()
        if s == "(":
            v = self.choice()
            if self.take() != ")":
                raise ValueError("bad #if")
            return v
        if s in ("+", "-", "~", "!"):
            v = self.one()
            return None if v is None else {"+": v, "-": -v, "~": ~v, "!": int(not v)}[s]
        if s[0].isdigit():
            n = re.sub(r"[uUlL]+$", "", s)
            return int(n, 8) if re.fullmatch(r"0\d+", n) else int(n, 0)
        if s[-1] == "'" and len(s) > 2:
            return ord(s[-2])
        if s[0].isalpha() or s[0] in "_$":
            return 0  # names that are no macro
        raise ValueError("bad #if")


class _Macros(dict):
    """Name -> (parameters or None, body) of the macros that stand, and how many tokens they may still expand to."""

    left = MOST_EXPANDED


def _holds(expr: str, macros: _Macros) -> bool:
    """Whether an #if expression holds; unknown names are 0. ValueError if it has no value."""
    expr = re.sub(r"\bdefined\s*(?:\(\s*(\w+)\s*\)|(\w+))", lambda m: "1" if (m[1] or m[2]) in macros else "0", expr)
    expr = re.sub(r"\b__has_\w+\s*\([^()]*\)", "0", expr)
    return _Value(_expand(_C_ALL.findall(expr), macros, True)[0]).whole()


_NONE_HIDDEN: frozenset = frozenset()


def _arguments(stack: list) -> tuple[list[list], int] | None:
    """(arguments, index of the closing bracket) of the call whose opening bracket is on top of the stack; None without end."""
    depth, args = 0, [[]]
    for j in range(len(stack) - 1, -1, -1):
        t = stack[j][0]
        if t == ")":
            depth -= 1
            if depth == 0:
                return args, j
        elif t == "(":
            depth += 1
            if depth == 1:
                continue
        elif t == "," and depth == 1:
            args.append([])
            continue
        args[-1].append(t)
    return None


def _substituted(params: list[str], body: list[str], args: list[list], macros: _Macros) -> list[str]:
    """The body of a macro with its arguments: # makes a string, ## joins its neighbours, others are expanded first."""
    if params[-1:] == ["..."] or params and params[-1].endswith("..."):
        n = len(params) - 1
        rest: list[str] = []
        for k, a in enumerate(args[n:]):
            rest += [",", *a] if k else a
        if len(args) < n:
            raise ValueError("too few arguments")
        bound = dict(zip(params[:n], args[:n])) | {"__VA_ARGS__" if params[-1] == "..." else params[-1][:-3].strip(): rest}
    else:
        if len(args) != len(params) and not (not params and args == [[]]):
            raise ValueError("wrong number of arguments")
        bound = dict(zip(params, args))
    out: list[str] = []
    k, n = 0, len(body)
    while k < n:
        s = body[k]
        if s == "#" and k + 1 < n and body[k + 1] in bound:
            out.append('""')
            k += 2
        elif k + 2 < n and body[k + 1] == "##":
            left = list(bound.get(s, [s]))
            while k + 2 < n and body[k + 1] == "##":
                right = bound.get(body[k + 2], [body[k + 2]])
                if left and right:
                    left[-1:] = [left[-1] + right[0]] if not (left[-1] == ",") else [left[-1], right[0]]
                    left += right[1:]
                else:
                    left = left + right
                k += 2
            out += left
            k += 1
        else:
            out += _expand(bound[s], macros, True)[0] if s in bound else [s]
            k += 1
    return out


def _expand(strs: list[str], macros: _Macros, final: bool) -> tuple[list[str], list[str]]:
    """(expanded tokens, rest): a macro is not expanded inside itself. rest begins with a call that has no end yet, unless final."""
    if not any(s in macros for s in strs):
        return strs, []
    stack = [(s, _NONE_HIDDEN) for s in reversed(strs)]
    out: list[str] = []
    while stack:
        s, hidden = stack.pop()
        m = macros.get(s)
        if m is None or s in hidden:
            out.append(s)
            continue
        params, body = m
        if params is None:
            made = _substituted([], body, [[]], _Macros()) if "##" in body else body
        else:
            if stack and stack[-1][0] != "(":
                out.append(s)
                continue
            got = _arguments(stack) if stack else None
            if got is None:
                if not final:
                    return out, [s, *(t for t, _ in reversed(stack))]
                if not stack:
                    out.append(s)
                    continue
                raise ValueError("macro call without end")
            args, end = got
            hidden = hidden & stack[end][1] if hidden else hidden
            del stack[end:]
            made = _substituted(params, body, args, macros)
        hidden = hidden | {s}
        stack.extend((t, hidden) for t in reversed(made))
        macros.left -= len(made) + 1
        if macros.left < 0:
            raise Undecided("expansion")
    return out, []


def c_tokens(text: str):
    """Tokens after preprocessing: comments, splices, conditionals, and the macros that the file itself defines, where they stand.

    Includes are skipped. Undecided for files whose macros or #if expressions go beyond MOST_EXPANDED tokens or the
    interpreter's depth.
    """
    text = newlines(text).replace("\\\n", "")
    macros = _Macros()
    held: list = []  # (outer active, a branch was taken, seen else)
    toks: list[str] = []
    rest: list[str] = []
    lines: list[str] = []

    def flush(final=False):
        nonlocal rest
        if lines or (final and rest):
            got, rest = _expand(rest + _C_ALL.findall("\n".join(lines)), macros, final)
            toks.extend(got)
            lines.clear()

    try:
        # what a false branch holds need not scan, but comments do not end there either
        if "/*" in text or "//" in text:
            text = _C_COMMENT.sub(_strip_comment, text)
        active = True
        for line in text.split("\n"):
            if "#" not in line and "%:" not in line or not (d := _C_DIRECTIVE.match(line)):
                if active:
                    lines.append(line)
                continue
            name, after = d[1], d[2].strip()
            if name in ("if", "ifdef", "ifndef"):
                yes = False
                if active:
                    if name != "if" and not re.match(r"[A-Za-z_]\w*", after):
                        return None
                    yes = _holds(after, macros) if name == "if" else (re.match(r"\w*", after)[0] in macros) == (name == "ifdef")
                held.append([active, yes, False])
                active = active and yes
            elif name in ("elif", "else", "elifdef", "elifndef"):
                if not held or held[-1][2]:
                    return None
                outer, before, _ = held[-1]
                yes = outer and not before
                if yes and name != "else":
                    yes = _holds(after, macros) if name == "elif" else (re.match(r"\w*", after)[0] in macros) == (name == "elifdef")
                held[-1] = [outer, before or yes, name == "else"]
                active = yes
            elif name == "endif":
                if not held:
                    return None
                active = held.pop()[0]
            elif not active:
                continue
            elif name == "define":
                m = re.match(r"([A-Za-z_]\w*)(\(([^)]*)\))?(.*)", after, re.S)
                if not m:
                    return None
                flush()
                params = None if m[2] is None else [p.strip() for p in m[3].split(",") if p.strip()]
                macros[m[1]] = (params, _C_ALL.findall(m[4]))
            elif name == "undef":
                flush()
                macros.pop(re.match(r"\w*", after)[0], None)
            elif name == "error":
                return None
            elif name not in ("include", "include_next", "import", "pragma", "line", "warning", "ident", "embed", "") and not name.isdigit():
                return None
        if held:
            return None
        flush(True)
        names = _C_NAMES
        out = [names[s] for s in toks]
    except ValueError:
        return None
    except (RecursionError, MemoryError) as e:
        raise Undecided("preprocessing") from e
    out.append(END)
    return out
