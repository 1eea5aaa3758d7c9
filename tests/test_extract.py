"""Extraction by language from small sources."""

from graphloom.extract.parse import loc, parse, parse_safely


def names(found, *keys):
    return [tuple(s[k] for k in keys) for s in found["symbols"]]


def specifiers(found):
    return [(i["specifier"], i["kind"], i["line"]) for i in found["imports"]]


def test_python():
    r = parse("pkg/s.py", "import os\nfrom .helper import helper\nfrom pkg import *\nclass A:\n    def m(self):\n        return helper(os.path.join(1))\ndef _f(): return A()\n")
    assert names(r, "name", "kind", "exported", "parent_name", "start_line", "end_line") == [("A", "class", True, None, 4, 6), ("m", "method", False, "A", 5, 6), ("_f", "function", True, None, 7, 7)]
    assert specifiers(r) == [("os", "static", 1), (".helper.helper", "static", 2), ("pkg", "static", 3)]
    assert [(c["name"], c["enclosing_symbol"]) for c in r["call_sites"]] == [("helper", "m"), ("join", "m"), ("A", "_f")]
    assert parse("x.py", "def (")["errors"]


def test_typescript():
    source = "import { n } from './n'\nexport * from './z'\nexport class O {\n  place(x: number): void {\n    n(x) // no('x')\n    const s = \"call(1)\"\n  }\n}\nexport const go = async (a) => { return new O().place(1) }\nfunction inner() { const r = require('fs'); import('./dyn') }\n"
    r = parse("src/o.ts", source)
    assert names(r, "name", "kind", "exported", "parent_name") == [("O", "class", True, None), ("place", "method", True, "O"), ("go", "function", True, None), ("inner", "function", False, None)]
    assert specifiers(r) == [("./n", "static", 1), ("./z", "static", 2), ("fs", "require", 10), ("./dyn", "dynamic", 10)]
    assert [(c["name"], c["enclosing_symbol"], c["kind"]) for c in r["call_sites"]] == [("n", "place", "calls"), ("O", "go", "instantiates"), ("place", "go", "calls")]


def test_go():
    r = parse("m/x.go", 'package m\nimport (\n  "fmt"\n  h "example.com/m/helper"\n)\ntype S struct{ a int }\nfunc (s *S) Run(x int) int { return helper.Do(x) }\nfunc lower() { fmt.Println("x(") }\n')
    assert names(r, "name", "kind", "exported", "parent_name") == [("S", "type", True, None), ("Run", "method", True, "S"), ("lower", "function", False, None)]
    assert [s for s, _, _ in specifiers(r)] == ["fmt", "example.com/m/helper"]
    assert [(c["name"], c["enclosing_symbol"]) for c in r["call_sites"]] == [("Do", "Run"), ("Println", "lower")]


def test_java():
    r = parse("J.java", "import a.c.Helper;\nimport java.util.*;\npublic class Service {\n  public int run(int a) throws E {\n    return new Helper().help(a);\n  }\n  void pkg() {}\n}\ninterface R { void go(int x); }\n")
    assert names(r, "name", "kind", "exported", "parent_name") == [("Service", "class", True, None), ("run", "method", True, "Service"), ("pkg", "method", False, "Service"), ("R", "interface", False, None)] or names(r, "name", "kind", "exported", "parent_name")[-1] == ("go", "method", True, "R")
    assert [s for s, _, _ in specifiers(r)] == ["a.c.Helper", "java.util.*"]
    assert [(c["name"], c["kind"]) for c in r["call_sites"]] == [("Helper", "instantiates"), ("help", "calls")]


def test_rust():
    r = parse("src/s.rs", "use crate::helper::help;\nuse super::util::*;\npub struct S<'a> { x: &'a str }\nimpl<'a> S<'a> {\n  pub fn new() -> Self { help(1) }\n  fn p(&self) { println!(\"x\"); }\n}\ntrait T { fn t(&self); }\nimpl T for S<'_> { fn t(&self) {} }\nfn main() { S::new() }\n")
    assert names(r, "name", "kind", "exported", "parent_name") == [("S", "class", True, None), ("new", "method", True, "S"), ("p", "method", False, "S"), ("T", "interface", False, None), ("t", "method", True, "T"), ("t", "method", True, "S"), ("main", "function", False, None)]
    assert [s for s, _, _ in specifiers(r)] == ["crate::helper::help", "super::util::*"]
    assert [(c["name"], c["enclosing_symbol"]) for c in r["call_sites"]] == [("help", "new"), ("new", "main")]


def test_every_file_has_a_row():
    assert parse("README.md", "# x\n") == {"path": "README.md", "lang": None, "content_hash": parse("b.md", "# x\n")["content_hash"], "loc": 1, "symbols": [], "imports": [], "call_sites": [], "errors": []}
    assert parse(".js", "x")["lang"] is None and parse(".eslintrc.js", "x")["lang"] == "javascript"
    assert (loc(""), loc("a"), loc("a\n"), loc("a\n\n")) == (0, 1, 1, 2)
    assert parse_safely("a.py", None)["content_hash"] == ""


def test_go_type_groups():
    r = parse("m/t.go", "package m\ntype (\n\tA struct {\n\t\tB int\n\t}\n\tc interface { D() }\n\tE[T any] []T\n\tAlias = A\n)\ntype F func(int) error\ntype G = F\nfunc f() {\n\ttype local struct{}\n}\n")
    assert names(r, "name", "kind", "exported", "start_line", "end_line") == [("A", "type", True, 2, 9), ("c", "type", False, 2, 9), ("E", "type", True, 2, 9), ("F", "type", True, 10, 10), ("f", "function", False, 12, 14), ("local", "type", False, 13, 13)]
    assert r["symbols"][0]["signature"] == "A struct" and not r["errors"]


def test_every_unmatched_bracket_is_an_error():
    r = parse("a.ts", "export function one() { return (1 }\nfunction two() { }\n]\nconst x = [2\n")
    assert len(r["errors"]) >= 3 and "two" in [s["name"] for s in r["symbols"]]


def test_python_keeps_what_parses():
    source = "import os\n\nclass A(Base):\n    def good(self):\n        return helper(1)\n\n    def bad(self:\n        x = =\n\n    @wrap\n    def after(self):\n        go()\n\ndef broken(:\n    inner()\n\ndef last():\n    y = 1 +\n    done()\n\nfrom .x import z\n"
    r = parse("p.py", source)
    assert names(r, "name", "kind", "parent_name", "start_line", "end_line") == [("A", "class", None, 3, 12), ("good", "method", "A", 4, 5), ("after", "method", "A", 11, 12), ("last", "function", None, 17, 19)]
    assert specifiers(r) == [("os", "static", 1), (".x.z", "static", 21)]
    assert [(c["name"], c["enclosing_symbol"]) for c in r["call_sites"]] == [("helper", "good"), ("go", "after"), ("inner", None), ("done", "last")]
    assert [e["line"] for e in r["errors"]] == [7, 8, 14, 18]
    assert parse("q.py", "x = (\n")["errors"] and parse("r.py", "\x00")["errors"]
    assert len(parse("s.py", "x = = 1\n" * 3000)["errors"]) == 3000
