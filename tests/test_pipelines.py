"""Indexing, change application, code map, questions and tools end to end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codequarry.config import Chunking, Config, Repository, load_config, save_config
from codequarry.operators import store
from codequarry.plans import pipelines as p

T = dt.datetime(2024, 1, 1)
GO = "package main\n\nfunc main() {\n\tlogin(\"user name\")\n}\n\nfunc login(name string) {\n\tprintln(name, \"some more text\")\n}\n"
SCHEMA = "path string, mod_time timestamp, content string"


def files(spark, rows):
    return spark.createDataFrame([(k, T, v) for k, v in rows.items()], SCHEMA)


def test_index(spark):
    none_d, none_c = spark.createDataFrame([], p.DOCUMENTS), spark.createDataFrame([], p.CHUNKS)
    first = {"a.go": GO, "b.go": GO, "c.md": "# Title\nsome text that is long enough\n", "empty.go": ""}
    docs, chunks, n = p.index_files(files(spark, first), none_d, none_c)
    assert n["indexed"] == 4 and n["removed"] == 0 and docs.count() == 4 and n["new_chunks"] == chunks.count() > 3
    a, b = (sorted((r.content, tuple(r.vector)) for r in chunks.where(F.col("file_path") == f).collect()) for f in ("a.go", "b.go"))
    assert [x[0] for x in a] == [x[0] for x in b]
    docs2, chunks2, n2 = p.index_files(files(spark, first), docs, chunks)
    assert (n2["indexed"], n2["skipped"], n2["removed"]) == (0, 4, 0) and chunks2.count() == chunks.count()
    third = {"a.go": GO + "\nfunc extra() {\n\treturn\n}\n", "c.md": ""}
    docs3, chunks3, n3 = p.index_files(files(spark, third), docs2, chunks2)
    assert (n3["indexed"], n3["removed"]) == (2, 2)
    assert {r.file_path for r in chunks3.select("file_path").distinct().collect()} == {"a.go"}
    old = {r.content: tuple(r.vector) for r in chunks2.where("file_path = 'a.go'").collect()}
    assert all(tuple(r.vector) == old[r.content] for r in chunks3.collect() if r.content in old)
    assert {r.path: len(r.chunk_ids) for r in docs3.collect()}["c.md"] == 0


def test_apply_changes(spark, tmp_path):
    run, kept = p.apply_changes(str(tmp_path)), p.tables(spark, str(tmp_path))
    schema = "path string, op string, mod_time timestamp, content string"
    one = spark.createDataFrame([("a.go", "create", T, GO), ("b.go", "write", T, GO)], schema)
    for _ in range(2):  # a repeated batch changes nothing
        run(one, 0)
        assert kept.read("documents").count() == 2
    n = kept.read("chunks").count()
    before = kept.manifest()
    run(spark.createDataFrame([("a.go", "remove", T, None)], schema), 1)
    assert kept.read("chunks").count() == n // 2
    assert [r.path for r in kept.read("documents").collect()] == ["b.go"]
    after = kept.manifest()
    assert all(after[t][b] == v for t in after for b, v in before[t].items() if b in after[t])  # b.go's bucket was not written again
    run(one.limit(0), 2)
    assert kept.manifest() == after


def test_last_event_of_a_path_counts(spark, tmp_path):
    run, kept = p.apply_changes(str(tmp_path)), p.tables(spark, str(tmp_path))
    schema = "path string, op string, ts timestamp, seq long, mod_time timestamp, content string"
    at = lambda k: T + dt.timedelta(seconds=k)
    rows = [("a.go", "write", at(1), 1, T, GO), ("a.go", "remove", at(2), 2, None, None), ("b.go", "remove", at(1), 3, None, None), ("b.go", "write", at(1), 4, T, GO), ("c.go", "write", at(2), 6, T, GO + "\n// this is the second version of the file\n"), ("c.go", "write", at(2), 5, T, GO)]
    run(spark.createDataFrame(rows, schema), 0)
    docs = {r.path: r for r in kept.read("documents").collect()}
    assert set(docs) == {"b.go", "c.go"}
    assert any("second version" in r.content for r in kept.read("chunks").where("file_path = 'c.go'").collect())


def test_a_refused_prompt_is_split():
    sizes = []

    def client(messages):
        sizes.append(len(messages[1]["content"]))
        if len(sizes) == 1:
            raise p.LimitExceeded(900, 500)
        return f"part {len(sizes)}"

    text = "\n\n".join(f"paragraph {i} " + "word " * 60 for i in range(6))
    assert p.ask_context(text, "why?", client).startswith("part") and len(sizes) > 2 and max(sizes[1:]) < sizes[0]
    stream = ['data: {"choices": [{"delta": {"content": "a"}}]}', "noise", 'data: {"choices": [{"delta": {"content": "b"}, "finish_reason": "stop"}]}', 'data: {"choices": [{"delta": {"content": "c"}}]}']
    assert list(p.ask_stream("ctx", "q", lambda m: iter(stream))) == ["a", "b"]


def test_package_docs(spark):
    f = files(spark, {f"a/f{i}.go": f"package a\n\nfunc F{i}() {{\n}}\n" for i in range(3)} | {"b/g.go": "package b\n"})
    got = p.package_docs(f, lambda m: f"<think>x</think>```md\n{m[1]['content']}\n```")
    assert [d for d, _ in got] == ["a"] and got[0][1].startswith("a: 3 files") and "F0, F1, F2" in got[0][1]


def test_map_and_tree(spark):
    f = files(spark, {"go.mod": "module x", "internal/auth/a.go": "package auth\n\nimport \"x/internal/db\"\n\ntype U struct {\n}\n\nfunc F() {\n}\n", "internal/db/b.go": "package db\n\ntype DB interface {\n}\n"})
    m = p.code_map(f)
    got = {r.dir: (r.functions, r.types, r.interfaces, r.n_files) for r in m["packages"].collect()}
    assert got["internal/auth"] == (1, 1, 0, 1) and got["internal/db"] == (0, 0, 1, 1)
    assert [tuple(r) for r in m["dependencies"].collect()] == [("internal/auth", "internal/db")]
    assert m["totals"].first().n_files == 3
    assert [(r.path, r.is_dir) for r in p.directory_tree(f).collect()] == [("go.mod", False), ("internal", True), ("internal/auth", True), ("internal/auth/a.go", False), ("internal/db", True), ("internal/db/b.go", False)]


def test_tools_and_questions(spark):
    f = files(spark, {"a.go": GO})
    _, chunks, _ = p.index_files(f, spark.createDataFrame([], p.DOCUMENTS), spark.createDataFrame([], p.CHUNKS))
    tools = p.Tools(spark, f, chunks)
    assert tools.search("login name").first().file_path == "a.go"
    rows, more = tools.symbols("function", "LOG")
    assert [r.name for r in rows.collect()] == ["login"] and more == 0
    assert [r.caller for r in tools.trace("login")["callers"].collect()] == ["main"]
    assert [(r.name, r.depth) for r in tools.flow().orderBy("seq").collect()] == [("main", 0), ("login", 1)]
    asked = []
    assert tools.ask("who calls login?", lambda m: asked.append(m) or "main") == "main"
    assert "a.go" in asked[0][1]["content"]
    p.ask(chunks, "login", lambda m: asked.append(m) or "x", window=1)
    assert len(asked) >= 2


def test_config(tmp_path):
    c = Config(chunking=Chunking(100, 10)).add(Repository("auth", str(tmp_path), "legacy")).add(Repository("lib", "/nowhere"))
    save_config(c, str(tmp_path / "c.yaml"))
    assert load_config(str(tmp_path / "c.yaml")) == c and load_config(str(tmp_path / "none")) == Config()
    with pytest.raises(ValueError):
        c.add(Repository("auth", "/x"))
    with pytest.raises(LookupError):
        c.remove("nope")
    assert [x[3] for x in p.repository_status(c, {"auth"})] == ["ok", "missing"] and len(c.remove("lib").repositories) == 1
    assert c.compatible(Config())
