"""Symbols, traces, call trees, control flow and change events on small fixtures."""

import json
import time

import pytest
from pyspark.sql import functions as F

from codequarry.operators import architecture as arch
from codequarry.operators import trace
from codequarry.operators.prompting import declaration_text, function_context
from codequarry.operators.controlflow import build_graph, graph_json, graph_table, graph_text, inline
from codequarry.operators.languages import LANGUAGES
from codequarry.operators.symbols import Ambiguous, NotFound, extract, find_candidates, find_functions, is_test_path, language_of, select_one, symbol_table, traceable
from codequarry.plans import code as plans
from codequarry.streaming import watch

FILES = {
    "main.go": "package main\n\nfunc main() {\n\tLogin(\"x\")\n\tgo handle()\n}\n\nfunc handle() {\n\tLogin(\"validate(\")\n}\n",
    "src/auth.go": "package src\n\nfunc Login(name string) {\n\tvalidate(name)\n\tcreateSession()\n\tvalidate(name)\n}\n\nfunc validate(n string) bool {\n\treturn n != \"\"\n}\n\nfunc createSession() {\n\t// Login again\n}\n",
    "src/user.go": "package src\n\ntype User struct {\n\tName string\n}\n\nfunc (u *User) FullName() string {\n\treturn u.Name\n}\n\ntype Database interface {\n\tGet() error\n}\n",
}


@pytest.fixture(scope="module")
def project(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    return files, trace.lines_table(files, "path", "content"), symbol_table(files, "path", "content")


def test_symbols_and_candidates(project):
    files, lines, symbols = project
    rows = {(r.name, r.kind, r.start_line, r.end_line, r.parent) for r in symbols.collect()}
    assert {("main", "function", 3, 6, ""), ("User", "struct", 3, 5, ""), ("FullName", "method", 7, 9, "User"), ("Database", "interface", 11, 13, "")} <= rows
    assert select_one(find_candidates(symbols, "Login"), "Login").path == "src/auth.go"
    with pytest.raises(NotFound):
        select_one(find_candidates(symbols, "Nope"), "Nope")
    twice = symbols.union(symbols.withColumn("path", F.lit("other.go")))
    with pytest.raises(Ambiguous):
        select_one(find_candidates(twice, "Login"), "Login")
    assert find_candidates(twice, "Login", file_part="other", language="GO").count() == 1


def test_trace(project):
    files, lines, symbols = project
    edges = trace.call_edges(lines, symbols)
    assert [(r.caller, r.caller_line) for r in trace.callers_of(edges, "Login").collect()] == [("main", 4), ("handle", 9)]
    assert [r.callee for r in trace.callees_of(edges, "Login").collect()] == ["createSession", "validate"]
    assert {(r.path, r.line) for r in trace.references(lines, "Login").collect()} == {("main.go", 4), ("main.go", 9), ("src/auth.go", 3), ("src/auth.go", 14)}
    resolved = trace.resolve_names(edges, symbols)
    assert {(r.callee, r.callee_file) for r in resolved.collect()} == {("Login", "src/auth.go"), ("handle", "main.go"), ("validate", "src/auth.go"), ("createSession", "src/auth.go")}
    assert {(r.name, r.kind) for r in arch.entry_points(symbols, lines).collect()} == {("main", "main")}
    assert {k: v.count() for k, v in trace.full_trace("Login", symbols, lines, edges).items()} == {"definition": 1, "references": 4, "callers": 2, "callees": 2}


def test_every_language_has_a_rule_that_works():
    samples = {
        "c": ("int add(int a) {\n  return a;\n}", "add"), "cpp": ("class Box {\n  int get() { return 1; }\n};", "Box"), "csharp": ("namespace A {\n class B {\n  public int Run() { return 1; }\n }\n}", "Run"),
        "cobol": ("       PROGRAM-ID. HELLO.", "HELLO"), "css": (".card {\n color: red;\n}", ".card"), "cypher": ("MATCH (p:Person) RETURN p", "Person"), "dockerfile": ("FROM alpine AS base\nRUN ls", "base"),
        "env": ("TOKEN_URL=x", "TOKEN_URL"), "properties": ("a.b=1", "a.b"), "go": ("func Run() {\n}", "Run"), "groovy": ("def build(x) {\n}", "build"), "hcl": ("resource \"aws\" \"web\" {\n}", "aws.web"),
        "html": ("<div id=\"top\">", "div#top"), "java": ("class A {\n  void run() {\n  }\n}", "run"), "javascript": ("export function go1(a) {\n}", "go1"), "json": ("{\n  \"name\": 1\n}", "name"),
        "kotlin": ("class A {\n  fun run() {\n  }\n}", "run"), "makefile": ("build: a b\n\techo", "build"), "markdown": ("# Title\ntext", "Title"), "mermaid": ("sequenceDiagram\n  participant A", "A"),
        "perl": ("package Foo;\nsub bar {\n}", "bar"), "php": ("class A {\n  function run() {\n  }\n}", "run"), "protobuf": ("message M {\n  string a = 1;\n}", "M"), "python": ("class A:\n    def f(self):\n        pass", "f"),
        "python2": ("def f():\n    print 1", "f"), "ruby": ("class A\n  def run\n  end\nend", "run"), "rust": ("impl A {\n  fn run(&self) {\n  }\n}", "run"), "shell": ("run() {\n  ls\n}", "run"),
        "sql": ("CREATE TABLE t (a int);", "t"), "swift": ("struct S {\n  func run() {\n  }\n}", "run"), "toml": ("[pkg]\na = 1", "[pkg]"), "typescript": ("export interface A {\n}", "A"),
        "xml": ("<root>\n  <item/>\n</root>", "root"), "yaml": ("top:\n  key: 1", "top"), "zig": ("pub fn run() void {\n}", "run"),
    }
    assert set(samples) == {x.name for x in LANGUAGES}
    for lang, (text, name) in samples.items():
        assert name in [s["name"] for s in extract(text, lang)], lang
    assert extract("x", "unknown") == [] and extract("", "go") == []
    assert [(s["kind"], s["parent"]) for s in extract("class A:\n    def f(self):\n        pass", "python")] == [("class", ""), ("method", "A")]


def test_language_lookup(spark):
    df = spark.createDataFrame([("a/b.PY",), ("Dockerfile",), ("x.go",), ("x_test.go",), ("none",)], "p string").withColumn("l", language_of(F.col("p")))
    assert [(r.l, r.t) for r in df.select("l", is_test_path(F.col("p"), F.col("l")).alias("t")).collect()] == [("python", False), ("dockerfile", False), ("go", False), ("go", True), (None, False)]


def test_walk_tree():
    tree = lambda kids, depth=8: [(r[3], r[4]) for r in arch.walk_tree("m", kids, depth)]
    assert tree({"m": ["a"], "a": ["b"]}) == [("m", None), ("a", None), ("b", None)]
    assert tree({"m": ["a"], "a": ["b"], "b": ["a"]}) == [("m", None), ("a", None), ("b", None), ("a", "cycle")]
    assert tree({"m": ["a"], "a": ["b"], "b": ["c"]}, 2) == [("m", None), ("a", None), ("b", "cap")]
    assert tree({"m": ["a", "b"], "a": ["c"], "b": ["c"], "c": ["d"]}) == [("m", None), ("a", None), ("c", None), ("d", None), ("b", None), ("c", "ref")]


def test_call_trees(spark):
    edges = spark.createDataFrame([("m", "a"), ("a", "b"), ("b", "a"), ("m", "a"), ("n", None)], "caller string, callee string")
    roots = spark.createDataFrame([("m",), ("n",)], "root string")
    got = sorted((r.root, r.seq, r.parent_seq, r.name, r.marker) for r in arch.call_trees(roots, edges).collect())
    assert got == [("m", 1, 0, "m", None), ("m", 2, 1, "a", None), ("m", 3, 2, "b", None), ("m", 4, 3, "a", "cycle"), ("n", 1, 0, "n", None)]


def test_imports(spark):
    files = spark.createDataFrame([("app/x.go", "import (\n\t\"fmt\"\n\tauth \"host/repo/internal/auth\"\n)\n"), ("app/y.py", "from a.b import c\nimport os\n")], "path string, content string")
    got = {(r.from_pkg, r.to_pkg) for r in arch.import_edges(trace.lines_table(files, "path", "content")).collect()}
    assert got == {("app", "fmt"), ("app", "internal/auth"), ("app", "a/b"), ("app", "os")}


IF3 = {
    "go": "func f(x int) int {\n\tif x > 0 {\n\t\ta()\n\t} else if x < 0 {\n\t\tb()\n\t} else {\n\t\tc()\n\t}\n}",
    "python": "def f(x):\n    if x > 0:\n        a()\n    elif x < 0:\n        b()\n    else:\n        c()",
    "ruby": "def f(x)\n  if x > 0\n    a\n  elsif x < 0\n    b\n  else\n    c\n  end\nend",
    "shell": "f() {\n  if [ $x -gt 0 ]; then\n    a\n  elif [ $x -lt 0 ]; then\n    b\n  else\n    c\n  fi\n}",
    "sql": "BEGIN\n  IF x > 0 THEN\n    a;\n  ELSIF x < 0 THEN\n    b;\n  ELSE\n    c;\n  END IF;\nEND;",
}


@pytest.mark.parametrize("lang", IF3)
def test_three_way_if(lang):
    assert len(build_graph("f", IF3[lang], lang).paths()) == 3


def test_control_flow():
    g = build_graph("f", "func f() {\n\ta := 1\n\treturn\n}", "go")
    assert len(g.paths()) == 1
    g = build_graph("f", "func f(x int) {\n\tif x > 0 {\n\t\ty()\n\t}\n}", "go")
    assert {e["label"] for e in g.edges} >= {"true", "false"} and len(g.paths()) == 2
    g = build_graph("f", "func f() {\n\tfor i := 0; i < 3; i++ {\n\t\tif i == 2 {\n\t\t\tcontinue\n\t\t}\n\t\tg(i)\n\t}\n}", "go")
    assert any(b["kind"] == "loop" for b in g.blocks) and any(e["back"] for e in g.edges)
    g = build_graph("f", "int f(int x) {\n  do {\n    x--;\n  } while (x > 0);\n  return x;\n}", "c")
    assert [b["cond"] for b in g.blocks if b["kind"] == "loop"] == ["x > 0"]
    g = build_graph("f", "func f(k string) {\n\tswitch k {\n\tcase \"a{\":\n\t\ta()\n\tcase \"b\":\n\t\treturn\n\t}\n}", "go")
    assert [d[0] for _, d in g.paths()] == ['switch k = "a{"', 'switch k = "b"', "switch k = no match"]
    assert build_graph("f", "a: 1", "yaml") is None
    many = "func f() {\n" + "\tif a {\n\t\tb()\n\t}\n" * 8 + "}"
    g = build_graph("f", many, "go")
    assert len(g.paths()) == 64 and g.notes
    assert g.mermaid().startswith("flowchart TD")


def test_inline_ends_on_recursion():
    bodies = {"g": [("func g() {\n\tf()\n\tg()\n}", "go", 1)], "f": [("func f() {\n\tg()\n}", "go", 1)], "two": [("func two() {}", "go", 1)] * 2}
    g = inline(build_graph("f", "func f() {\n\tg()\n\ttwo()\n}", "go"), "f", bodies)
    assert any(e["label"] == "call g" for e in g.edges) and len(g.paths()) == 1


def test_every_call_of_a_block_is_inlined():
    bodies = {k: [(f"func {k}() {{\n\t{k}1()\n}}", "go", 1)] for k in "abc"}
    g = inline(build_graph("f", "func f() {\n\tx := a() + b()\n\tif c() > 0 {\n\t\ty()\n\t}\n}", "go"), "f", bodies)
    assert [e["label"] for e in g.edges if e["label"].startswith("call")] == ["call a", "call b", "call c"]
    labels = [[g.blocks[b]["label"].split(":")[0] for b in blocks] for blocks, _ in g.paths()]
    assert len(labels) == 2 and all([x for x in path if x in "abc"] == ["a"] * 3 + ["b"] * 3 + ["c"] * 3 for path in labels)
    assert [d for _, d in g.paths()] == [["if c() > 0 = true"], ["if c() > 0 = false"]]
    again = inline(build_graph("g", "func g() {\n\tfor a() {\n\t\ty()\n\t}\n}", "go"), "g", bodies)
    assert len(again.paths()) == 1 and any(e["back"] for e in again.edges)


def test_graph_table(spark):
    df = spark.createDataFrame([("1", "f", "go", "func f() {\n\treturn\n}", 5), ("2", "g", None, "x", None), ("3", "h", "go", None, 1)], "id string, name string, lang string, src string, line int")
    rows = graph_table(df, "id", "name", "lang", "src", "line").collect()
    assert {r.id for r in rows} == {"1"} and [r.lines for r in rows if r.kind == "return"] == [[6]]


EVENTS = [("x", "write", 1, "h1"), ("x", "write", 2, "h1"), ("x", "write", 3, None), ("x", "write", 4, "h1"), ("x", "remove", 5, "h1"), ("x", "create", 6, "h1"), ("y", "write", 1, "h1"), ("x", "write", 7, "h2"), ("x", "write", 8, "h1")]


def events(spark):
    df = spark.createDataFrame(EVENTS, "path string, op string, seq long, content_hash string")
    return df.withColumn("ts", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("seq") * 0.15)))


def test_suppress(spark, tmp_path):
    want = {("x", 1), ("x", 3), ("x", 5), ("x", 6), ("y", 1), ("x", 7), ("x", 8)}
    assert {(r.path, r.seq) for r in watch.suppress_unchanged(events(spark)).collect()} == want
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = watch.suppress_unchanged_stream(spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.path, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_debounce_and_ops(spark):
    df = spark.createDataFrame([("X", "write", 1), ("X", "remove", 2), ("Y", "write", 2), ("a/.git/z", "write", 1)], "path string, op string, seq long")
    df = df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("seq") * 0.01))
    out = watch.debounce(watch.drop_hidden(df), "50 milliseconds").collect()
    assert sorted((r.path, r.op) for r in out) == [("X", "remove"), ("Y", "write")]
    ops = spark.createDataFrame([(["write", "create"],), (["rename"],), ([],)], "f array<string>").select(watch.map_op(F.col("f")).alias("o")).collect()
    assert [r.o for r in ops] == ["create", "rename", "write"]


def test_entry_points(spark):
    files = spark.createDataFrame(
        [
            ("cmd/root.go", "package cmd\n\nvar c = &Command{\n\tUse:   \"serve [port]\",\n\tRunE: runServe,\n}\n\nfunc runServe() error {\n\treturn nil\n}\n\nfunc init() {\n}\n"),
            ("web/routes.go", "package web\n\nfunc setup(m *Mux) {\n\tm.HandleFunc(\"/a\", listUsers)\n}\n\nfunc listUsers() {\n}\n"),
            ("app/views.py", "@app.route(\"/x\")\ndef show():\n    pass\n\nclass Home(ListView):\n    def get(self):\n        pass\n"),
        ],
        "path string, content string",
    )
    got = {(r.name, r.kind, r.label) for r in arch.entry_points(symbol_table(files, "path", "content"), trace.lines_table(files, "path", "content")).collect()}
    assert got == {("runServe", "command", "serve"), ("init", "init", "cmd"), ("listUsers", "handler", "listUsers"), ("show", "handler", '@app.route("/x")'), ("get", "handler", "django")}


def test_handlers_of_many_frameworks(spark):
    files = spark.createDataFrame(
        [
            ("routes/web.php", "<?php\nRoute::get('/a', [UserController::class, 'show']);\nRoute::post('/b', 'UserController@store');\n"),
            ("app/UserController.php", "<?php\nclass UserController {\n    public function show($id) {\n    }\n    public function store() {\n    }\n    public function other() {\n    }\n}\n"),
            ("config/routes.rb", "Rails.application.routes.draw do\n  get '/c', to: 'users#list'\nend\n"),
            ("app/users.rb", "class Users\n  def list\n    1\n  end\nend\n"),
            ("urls.py", "urlpatterns = [path('x/', views.index, name='index')]\n"),
            ("views.py", "def index(request):\n    return 1\n"),
            ("app.js", "app.get('/d', auth, fetchAll);\nfunction fetchAll(q) {\n  return 1;\n}\n"),
            ("A.java", "class A {\n    @GetMapping(\"/e\")\n    @PostMapping(\"/f\")\n    public int both(int a) {\n        return a;\n    }\n    @DeleteMapping(\"/far\")\n\n\n\n\n\n\n    public int far(int a) {\n        return a;\n    }\n}\n"),
            ("S.java", "public class S extends HttpServlet {\n    void doGet(int a) {\n    }\n    void helper(int a) {\n    }\n}\n"),
            ("cmd/m.go", "package main\n\nfunc main() {\n}\n"), ("lib/m.go", "package lib\n\nfunc main() {\n}\n"),
        ],
        "path string, content string",
    )
    got = {(r.name, r.path, r.kind): r.label for r in arch.entry_points(symbol_table(files, "path", "content"), trace.lines_table(files, "path", "content")).collect()}
    u = "app/UserController.php"
    assert set(got) == {("show", u, "handler"), ("store", u, "handler"), ("list", "app/users.rb", "handler"), ("index", "views.py", "handler"), ("fetchAll", "app.js", "handler"), ("both", "A.java", "handler"), ("doGet", "S.java", "handler"), ("main", "cmd/m.go", "main")}
    assert got["both", "A.java", "handler"].startswith("@PostMapping") and got["doGet", "S.java", "handler"] == "servlet"


def test_names_of_packages_and_modules(spark):
    df = spark.createDataFrame([("go.mod", "module host/repo\n\ngo 1.22\n"), ("a/b.go", "// x\npackage inner\n"), ("c/d.py", "x = 1\n"), ("e/F.java", "package p.q;\n")], "path string, content string")
    assert [r.module for r in arch.module_path(df, "path", "content").collect()] == ["host/repo"]
    assert {r.path: r.n for r in df.select("path", arch.package_name(F.col("path"), F.col("content")).alias("n")).collect()} == {"go.mod": ".", "a/b.go": "inner", "c/d.py": "c", "e/F.java": "p.q"}


def test_function_context(spark):
    text = "package p\n\ntype Box struct {\n\tsize Size\n}\n\ntype Size struct {\n\tn int\n}\n\nfunc (b *Box) Get(s Size) int {\n\treturn load(s)\n}\n\nfunc load(s Size) int {\n\treturn s.n\n}\n"
    files = spark.createDataFrame([("a.go", text)], "path string, content string")
    c = function_context(symbol_table(files, "path", "content"), trace.lines_table(files, "path", "content"), "a.go", 11)
    assert [r.line for r in c["header"].collect()] == list(range(1, 11))
    assert [r.text for r in c["parent"].collect()] == ["type Box struct {\n\tsize Size\n}"]
    assert [(r.name, r.text) for r in c["types"].collect()] == [("Size", "type Size struct {\n\tn int\n}")]
    assert [r.name for r in c["callees"].collect()] == ["load"]
    # a declaration whose end is not known is balanced by its braces
    spans = spark.createDataFrame([("Size", "a.go", 7, 7), ("none", "a.go", 1, 1)], "name string, path string, start_line int, end_line int")
    assert {r.name: r.text.count("\n") for r in declaration_text(spans, trace.lines_table(files, "path", "content")).collect()} == {"Size": 2, "none": 0}


def test_renderings():
    g = build_graph("f", "func f(x int) {\n\tif x > 0 {\n\t\ty()\n\t}\n}", "go")
    text = graph_text(g)
    assert "B2 [branch] if x > 0" in text and "-> B3 (true)" in text and "path 2: B0 > B2 > B1 | if x > 0 = false" in text
    assert json.loads(graph_json(g))["exit_id"] == 1


def test_tree_changes(spark, tmp_path):
    root = tmp_path / "src"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    for p, t in {"a.go": "package a", "sub/b.py": "x = 1", ".git/c.go": "no", "d.bin": "no", "old.go": "package old"}.items():
        (root / p).write_text(t)
    seen = []
    look = lambda: watch.look(spark, str(root), lambda df, i: seen.append({r.path: (r.op, r.content) for r in df.collect()}), str(tmp_path / "state"))
    look()
    assert seen.pop() == {"a.go": ("create", "package a"), "sub/b.py": ("create", "x = 1"), "old.go": ("create", "package old")}
    look()
    assert not seen
    (root / "a.go").write_text("package a // changed")
    (root / "sub/b.py").unlink()
    (root / "new").mkdir()
    (root / "old.go").rename(root / "new/name.go")
    look()
    assert seen.pop() == {"a.go": ("write", "package a // changed"), "sub/b.py": ("remove", None), "old.go": ("rename", None), "new/name.go": ("create", "package old")}
    with pytest.raises(ZeroDivisionError):  # what fails comes again
        (root / "a.go").write_text("package b")
        watch.look(spark, str(root), lambda df, i: 1 / 0, str(tmp_path / "state"))
    look()
    assert seen.pop() == {"a.go": ("write", "package b")}
    q = watch.start_tree_watch(spark, str(root), lambda df, i: seen.append({r.path: r.op for r in df.collect()}), str(tmp_path / "state"), str(tmp_path / "ck"), {"processingTime": "200 milliseconds"})
    (root / "late.go").write_text("package late")
    for _ in range(120):
        if seen:
            break
        time.sleep(0.25)
    q.stop()
    assert seen[0] == {"late.go": "create"}


def test_predicates(spark, project):
    files, lines, symbols = project
    more = files.select("path").union(spark.createDataFrame([("a_test.go",), (".git/x.go",), ("skip/y.go",), ("z.txt",)], "path string"))
    assert {r.path for r in traceable(more, "path", ["skip"]).collect()} == set(FILES)
    assert find_functions(symbols, "Login").count() == 1 and find_functions(symbols, "User").count() == 0
    df = spark.createDataFrame([("mod/x/a",), ("fmt",), ("a/internal/b",), ("./c",)], "t string")
    assert [r.i for r in df.select(arch.is_internal_import(F.col("t"), "mod/x").alias("i")).collect()] == [True, False, True, True]
    c = spark.createDataFrame([("  // a",), ("b // c",), ("# d",)], "t string")
    assert [r.i for r in c.select(arch.is_comment_line(F.col("t"), ["//", "#"]).alias("i")).collect()] == [True, False, True]
    e = spark.createDataFrame([("b", "p", "init"), ("z", "p", "main"), ("a", "p", "handler"), ("c", "p", "command")], "name string, path string, kind string")
    assert [r.name for r in arch.order_entry_points(e).collect()] == ["z", "c", "a", "b"]
    p = spark.createDataFrame([(".", 9), ("a", 3), ("b", 1)], "dir string, n_files int")
    assert [r.dir for r in arch.large_packages(p, 2).collect()] == ["a"]


def test_call_queries_go_eight_deep(spark, tmp_path):
    edges = [(f"f{i}", "a.go", i, f"f{i + 1}") for i in range(12)]
    spark.createDataFrame(edges, "caller string, caller_file string, caller_line int, callee string").write.parquet(f"{tmp_path}/call_edges.parquet")
    got = {(r.name, r.marker) for r in plans.g7_call_trees(spark, str(tmp_path)).collect()}
    assert got == {("f8", "cap"), *((f"f{i}", None) for i in range(8))}
    assert [tuple(r) for r in plans.g7_reachable_full(spark, str(tmp_path)).collect()] == [("f0", 9)]
