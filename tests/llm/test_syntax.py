"""Verdicts on source files: preprocessing, early errors, dialects, and equal moves of interned and plain stacks."""

import pytest

from millrace.llm.syntax import tokens
from millrace.llm.syntax.gll import Grammar
from millrace.llm.unparsable import verdict

C_FILES = [
    ("#define BEGIN {\nint f(void) BEGIN return 1; }\n#undef BEGIN\n", "valid"),
    ("#if 1 ? 1 : 0\nint a;\n#else\nint ((;\n#endif\n", "valid"),
    ("#if 1 ? 1 : 0\nint ((;\n#else\nint a;\n#endif\n", "invalid"),
    ("#define F(a,b) a b\nF(int,\nx);\n", "valid"),
    ("#define F(a,b) a b\nF(int);", "invalid"),
    ("#if " + "+".join(["1"] * 9000) + "\nint a;\n#else\nint ((;\n#endif\n", "valid"),
    ("#if 1 << 70\nint ((;\n#endif\nint a;", "valid"),
    ("#define A(x) x x x x x x x x x x\n#define B(x) A(A(A(A(A(A(A(A(x))))))))\nint a = B(1);", "undecided"),
    ("#define CAT(a,b) a##b\nint CAT(x,1);", "valid"),
    ("#if 0/0\n#endif", "invalid"),
    ("#if 1 || 0/0\nint a;\n#endif", "valid"),
    ("#define f(x) ((x)*2)\nint f (int);\n", "invalid"),
    ("int a = 09;", "invalid"),
    ("/* a\n b */ #define X int\nX y;", "valid"),
    ("#define X /* a\n b */ int\nX y;", "valid"),
    ("#if (" + "(" * 2000 + "1" + ")" * 2000 + ")\n#endif", "undecided"),
]

JAVASCRIPT_FILES = [
    ("1 = 2;", "invalid"),
    ("let a; let a;", "invalid"),
    ("break;", "invalid"),
    ("continue;", "invalid"),
    ("while(1) { if (x) break; else continue; }", "valid"),
    ("switch(a){case 1: break; default: b(); }", "valid"),
    ("switch(a){case 1: continue;}", "invalid"),
    ("for(;;) switch(a){case 1: continue;}", "valid"),
    ("a.b = c = 3; [x, y.z] = [1,2]; ({p: q, r = 2, ...s} = t);", "valid"),
    ("a + b = c", "invalid"),
    ("f() = 1", "invalid"),
    ("a++ ; --b.c; ++f()", "invalid"),
    ("a = b ? c : d = e", "valid"),
    ("let a = 1, b = 2\nlet c, d", "valid"),
    ("let a = 1, b\nlet b", "invalid"),
    ("{let a} {let a}", "valid"),
    ("let a = 1\nfoo(), a\nlet b", "valid"),
    ("const {a, b: [c, d=1]} = x; const c = 1", "invalid"),
    ("const {a, b: c} = x; const b = 1", "valid"),
    ("for (let i=0;i<2;i++){let i}", "valid"),
    ("function f(){ for(const a of b){} for (const a in c) {} }", "valid"),
    ("while(1){ function g(){ break; } }", "invalid"),
    ("x: for(;;){ break x; continue x; }", "valid"),
    ("[1 2]", "invalid"),
    ("[1,,2,]", "valid"),
    ("async () => { await x; for (const y of await z()) {} }", "valid"),
    ("var f = x => y => z", "valid"),
    ("new Foo(a).bar = 1", "valid"),
    ("a = /re[/]x/g.test(b) / 2", "valid"),
    ("let x = a / b / c", "valid"),
    ("`a${b}c${d.e(f)}g`", "valid"),
    ("`a${`b${c}`}`", "valid"),
    ("return 1", "valid"),
    ("if (a) /x/.test(b)", "valid"),
    ("var a; let a", "invalid"),
    ("function a(){} let a", "invalid"),
    ("let {x} = y, {z} = w; let [q] = 1", "valid"),
    ("class A {} class A {}", "invalid"),
    ("o = {let: 1, const: 2, class: 3}; o.let; o.class", "valid"),
    ("(a, b) = 1", "invalid"),
    ("(a) = 1", "valid"),
    ("function* g(){ const x = yield 1; yield* h(); }", "valid"),
    ("for (a.b of c) {}", "valid"),
    ("for (x in y);", "valid"),
    ("a ||= b; a ??= c", "valid"),
    ("let f = async x => await x, g = async (a,b) => {}", "valid"),
    ("if (a) let\nb", "valid"),
    ("class A { #x = 1; static y; get z() { return this.#x } async *w() {} }", "valid"),
    ("x = {a, b, c(){}, get d(){return 1}, [e]: 2, ...f}", "valid"),
    ("x = {a = 1}", "invalid"),
    ("import('x').then(y => y)", "valid"),
    ("label: { break label; }", "valid"),
    ("do x++; while (x < 5) y", "valid"),
    ("a\n++b", "valid"),
    ("var yield_ = 1; var of = 2; var async = 3; async = of", "valid"),
]

PYTHON_FILES = [
    ("async def f():\n    pass\n", "valid"),
    ("f() = 1\n", "invalid"),
    ("def f(:\n", "invalid"),
    ("x = 1 if y else 2\n", "valid"),
    ("print 'x'\n", "invalid"),
    ("", "valid"),
    ("((((", "invalid"),
    ("match x:\n  case [1, *_]:\n    pass\n", "valid"),
]


@pytest.mark.parametrize("language, code, want", [(l, c, w) for l, files in (("c", C_FILES), ("javascript", JAVASCRIPT_FILES), ("python", PYTHON_FILES)) for c, w in files])
def test_verdict(language, code, want):
    assert verdict(code, language) == want


@pytest.mark.parametrize("code", [c for c, _ in JAVASCRIPT_FILES])
def test_scanners_agree(code):
    fast, slow = tokens._javascript_at_once(code), tokens._javascript_one_by_one(code)
    assert fast is None or fast[0] == slow[0]


def kinds(text):
    return [tokens._tok(x) for x in text.split()] + [tokens.END]


def test_ambiguous_and_left_recursive_rules():
    g = Grammar("sum = sum '+' sum | 'a'", ["sum"])
    assert g.accepts(kinds("a + a + a")) and not g.accepts(kinds("a + + a")) and not g.accepts(kinds(""))
    g = Grammar("list = [ list ',' ] item\nitem = 'a' | '(' list ')'", ["list"])
    assert g.accepts(kinds("a , ( a , a ) , a")) and not g.accepts(kinds("a , ( a , a , a"))


def test_dialects_run_together():
    g = Grammar("one = 'a' 'b' | 'x'\ntwo = 'a' 'c'", ["one", "two"])
    assert [g.accepts(kinds(t)) for t in ("a b", "a c", "x", "a", "a b c")] == [True, True, True, False, False]


def test_forgetting_stacks_changes_nothing(monkeypatch):
    from millrace.llm.syntax import gll

    g = Grammar("e = t ( '+' t )*\nt = 'a' | '(' e ')'", ["e"])
    texts = ["( " * n + "a" + " )" * n for n in range(1, 30)] + ["( a", "a )"]
    before = [g.accepts(kinds(t)) for t in texts]
    monkeypatch.setattr(gll, "MOST_CONFIGS", 1)
    assert [g.accepts(kinds(t)) for t in texts] == before == [True] * 29 + [False, False]


def test_deep_nesting_and_long_files():
    assert verdict("(" * 50_000 + "1" + ")" * 50_000, "javascript") == "valid"
    assert verdict("int a;\n" * 100_000, "c") == "valid"
    assert verdict("(" * 5_000, "python") == "invalid"
