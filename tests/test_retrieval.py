"""Search, store, chunking, scanning and text functions on small fixtures."""

import math
import os

import pytest
from pyspark.sql import functions as F

from codequarry.functions import scalars as x
from codequarry.operators import search as s
from codequarry.operators import store
from codequarry.operators.chunking import ChunkSize, chunk_by_symbols, chunk_file, chunk_table
from codequarry.operators.embedding import embed, embed_missing
from codequarry.operators.prompting import choose_repositories, clean_answer, duration_text, excerpts, first_bytes, fold_summaries, parse_symbol_ref, read_sse, split_context, split_middle, token_limit_error
from codequarry.sources.scan import load_rules, IgnoreRule, indexable, is_ignored, parse_rule, parse_rules, scan_tree, walk_following_links

CHUNKS = [
    ("auth_0", "src/auth.go", 1, 10, "func login()", [1.0, 0.0, 0.0]),
    ("auth_1", "src/auth.go", 11, 20, "func logout()", [0.9, 0.1, 0.0]),
    ("db_0", "src/db.go", 1, 15, "func connect()", [0.0, 1.0, 0.0]),
    ("handler_0", "src/handler.go", 1, 10, "login(w, r)", [0.8, 0.2, 0.0]),
    ("test_0", "test/auth_test.go", 1, 10, "login test", [0.95, 0.05, 0.0]),
    ("mock_0", "mocks/auth_mock.go", 1, 5, "login mock", [0.7, 0.3, 0.0]),
    ("doc_0", "docs/auth.md", 1, 5, "login and logout", [0.6, 0.0, 0.4]),
    ("none_0", "src/none.go", 1, 5, "nothing here", []),
]
SCHEMA = "chunk_id string, file_path string, start_line int, end_line int, content string, vector array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, SCHEMA)


def test_cosine(spark):
    cases = [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([1.0, 1.0, 0.0], [1.0, 0.0, 0.0], 0.7071), ([], [], 0), ([1.0], [1.0, 2.0], 0), ([0.0, 0.0], [1.0, 1.0], 0), (None, [1.0], 0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<float>, b array<float>")
    got = {r.i: r.c for r in df.select("i", x.cosine(F.col("a"), F.col("b")).alias("c")).collect()}
    assert all(abs(got[i] - c[2]) < 1e-3 for i, c in enumerate(cases))


def test_vector_and_keyword(spark, chunks):
    assert [r.chunk_id for r in s.vector_topk(chunks, [1.0, 0.0, 0.0], 3).collect()] == ["auth_0", "test_0", "auth_1"]
    assert {r.chunk_id for r in s.vector_topk(chunks, [1.0, 0.0, 0.0], 9, "src/").collect()} == {"auth_0", "auth_1", "db_0", "handler_0"}
    words = {r.chunk_id: r.score for r in s.keyword_topk(chunks, "Login", 20).collect()}
    assert abs(words["auth_0"] - math.log(2)) < 1e-8 and "db_0" not in words
    assert s.keyword_topk(chunks, "  ", 5).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "chunk_id string, score double")
    b = spark.createDataFrame([("b", 3.0), ("d", 2.0), ("a", 1.0)], "chunk_id string, score double")
    got = {r.chunk_id: r.score for r in s.reciprocal_rank_fusion([a, b]).collect()}
    assert len(got) == 4 and abs(got["b"] - (1 / 62 + 1 / 61)) < 1e-12 and abs(got["a"] - (1 / 61 + 1 / 63)) < 1e-12 and got["b"] > got["a"] > got["c"]


def test_boost_and_search(spark, chunks):
    rules = (("test/", 0.5), ("_test.", 0.5), ("mocks/", 0.4), (".md", 0.6), ("docs/", 0.6), ("src/", 1.1))
    got = {r.file_path: r.b for r in chunks.select("file_path", s.boost(F.col("file_path"), rules).alias("b")).collect()}
    want = {"src/auth.go": 1.1, "test/auth_test.go": 0.25, "mocks/auth_mock.go": 0.4, "docs/auth.md": 0.36}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    top = s.search(chunks, [1.0, 0.0, 0.0], "login", limit=3, rules=rules).collect()
    assert top[0].chunk_id == "auth_0" and len({r.file_path for r in top}) == 3
    plain = s.search(chunks, [1.0, 0.0, 0.0], "zzz", limit=3, rules=()).collect()
    assert abs(plain[0].score - 1) < 1e-6  # no word hits: cosine stands
    assert s.search(chunks.limit(0), [1.0, 0.0, 0.0], "login").count() == 0


def test_query_set_in_blocks(spark, chunks):
    q = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [1.0, 2.0], [0.5, 0.5, 0.0]])] + [(9, None), (0, [1.0, 0.0, 0.0])], "query_id int, query_vector array<double>")
    extra = chunks.union(spark.createDataFrame([("short", "a", 1, 1, "x", [1.0, 2.0])], SCHEMA))
    want = None
    for block in (4096, 2):
        got = sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in s.vector_topk_many(extra, q, 2, block).collect())
        assert want in (None, got)
        want = got
    assert [(a, b, c) for a, b, c, _ in want] == [(0, 1, "auth_0"), (0, 2, "test_0"), (1, 1, "db_0"), (1, 2, "mock_0"), (2, 1, "auth_0"), (2, 2, "auth_1"), (3, 1, "short"), (3, 2, "auth_0"), (4, 1, "mock_0"), (4, 2, "handler_0")]


def test_results_as_text(spark, chunks):
    top = s.search(chunks, [1.0, 0.0, 0.0], "login", limit=1)
    assert s.result_text(top).first().text.startswith("src/auth.go:1 (") and '"file":"src/auth.go"' in s.result_json(top).first().json


def test_store(spark, chunks, tmp_path):
    new = spark.createDataFrame([("db_0", "src/db.go", 1, 1, "new", [1.0])], SCHEMA)
    merged = store.upsert(chunks, new, "chunk_id")
    assert merged.count() == 8 and merged.where("chunk_id = 'db_0'").first().content == "new"
    assert store.delete_by(chunks, new, "file_path").count() == 7
    assert store.removed_files(chunks, new).count() == 6
    reused = store.reuse_vectors(spark.createDataFrame([("n", "func login()"), ("m", "other")], "id string, content string"), chunks)
    assert {r.id: r.vector_from for r in reused.collect()} == {"n": "auth_0", "m": None}
    filled = embed_missing(reused.select("id", "content", "vector"), "content", dim=3)
    assert all(len(r.vector) == 3 for r in filled.collect())
    root = str(tmp_path / "t")
    assert store.load(spark, root, SCHEMA).count() == 0
    store.persist(chunks, root)
    store.persist(merged.where("chunk_id = 'db_0'"), root)
    assert store.load(spark, root, SCHEMA).count() == 1


def test_embedding_is_stable(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    v = [r.vector for r in embed(df, "t").collect()]
    assert v[0] == v[1] and len(v[2]) == 64


def test_chunk_size():
    assert ChunkSize(100, 200).bytes() == (400, 40) and ChunkSize(0, -1).bytes() == (2048, 200)


def test_line_chunks():
    assert chunk_file("a.go", " \n\n") == []
    one = chunk_file("main.go", "package main\n\nfunc main() {}\n")
    assert [(c["chunk_id"], c["start_line"], c["end_line"]) for c in one] == [("main.go_0", 1, 3)] and one[0]["content"] == "package main\n\nfunc main() {}\n"
    text = "".join(f"line number {i} of this file\n" for i in range(60))
    parts = chunk_file("b", text, ChunkSize(40, 10))
    assert all(len(c["content"]) <= 160 for c in parts)
    assert all(b["start_line"] <= a["end_line"] + 1 for a, b in zip(parts, parts[1:]))
    covered = {n for c in parts for n in range(c["start_line"], c["end_line"] + 1)}
    assert covered == set(range(1, 61))
    long = chunk_file("c", "x" * 5000 + "\nshort line of text here\n", ChunkSize(100, 10))
    assert len(long[0]["content"]) == 5001


def test_symbol_chunks():
    body = "\n".join(["import a", "import b more", "", "def f():", *[f"    value_{i} = {i}" for i in range(120)], "", "tail text of the file"])
    got = chunk_by_symbols("m.py", body, [{"name": "f", "start_line": 4, "end_line": 124}, {"name": "bad", "start_line": 9, "end_line": 3}], ChunkSize(100, 10))
    assert got[0]["symbol_name"] is None and got[0]["start_line"] == 1
    own = [c for c in got if c["symbol_name"] == "f"]
    assert len(own) > 2 and own[0]["start_line"] == 4 and own[-1]["end_line"] == 124
    assert got[-1]["symbol_name"] is None
    assert chunk_by_symbols("m.py", body, []) == chunk_file("m.py", body)


def test_chunk_table(spark):
    df = spark.createDataFrame([("a", "some text that is long enough\n"), (None, "x"), ("b", None), ("c", "")], "path string, text string").withColumn("content", F.lit(1))
    assert [r.chunk_id for r in chunk_table(df, "path", "text").collect()] == ["a_0"]


def test_rules(spark):
    assert parse_rule("*.log") == IgnoreRule("*.log")
    assert parse_rule("!important.log") == IgnoreRule("important.log", negated=True)
    assert parse_rule("build/") == IgnoreRule("build", dir_only=True)
    assert parse_rule("src/generated/") == IgnoreRule("src/generated", dir_only=True, anchored=True)
    assert parse_rule("docs/*.md") == IgnoreRule("docs/*.md", anchored=True)
    assert parse_rule("# note") is None and parse_rule("  ") is None
    rules = parse_rules("*.log\n!keep.log\nbuild/\n!build/x.go\ndocs/*.md\n/out\n[bad")
    paths = {"a.log": True, "keep.log": False, "build/x.go": True, "src/build/y.go": True, "docs/a.md": True, "docs/a/b.md": False, "out": False, "m/node_modules/z.js": True, "a.go": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.i for r in df.select("p", is_ignored(F.col("p"), ["node_modules"], rules).alias("i")).collect()} == paths


def test_scan(spark, tmp_path):
    for p, t in {"a.go": "package a", "sub/b.py": "x = 1", ".git/c.go": "no", "d.bin": "no", "big.txt": "x" * ((1 << 20) + 1), "Makefile": "all:"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    assert {r.path: r.content for r in scan_tree(spark, str(tmp_path)).collect()} == {"a.go": "package a", "sub/b.py": "x = 1", "Makefile": "all:"}
    os.symlink(tmp_path / "sub", tmp_path / "link")
    os.symlink("/etc", tmp_path / "outside")
    assert sorted(r[0] for r in walk_following_links(str(tmp_path)) if r[0].endswith("b.py")) == ["sub/b.py"]
    files = spark.createDataFrame([("x/.hidden/a.go", 1), ("a.GO", 1), ("b.go", 2 << 20)], "path string, size long")
    assert [r.path for r in indexable(files, "path", "size", [], []).collect()] == ["a.GO"]


def test_prompting(spark):
    assert split_middle("a" * 100) == ("a" * 50, "a" * 50)
    assert split_context("one\n\ntwo\n\nthree") == ["one\n\ntwo\n\nthree"]
    assert len(split_context("\n\n".join("p" * 300 for _ in range(3)))) == 3
    assert fold_summaries(["a", "b"], lambda p, s_: s_ + p) == "ab"
    df = spark.createDataFrame([(400, "prompt has 13435 tokens, exceeds the limit of 12288"), (401, "bad key"), (500, "too long 500 400")], "s int, b string")
    got = [tuple(r.e) for r in df.select(token_limit_error(F.col("s"), F.col("b")).alias("e")).collect()]
    assert got == [(True, 13435, 12288), (False, 0, 0), (False, 0, 0)]
    assert read_sse(["data: {\"choices\":[{\"delta\":{\"content\":\"a\"}}]}", "x", "data: {bad", "data: [DONE]", "data: {\"choices\":[{\"delta\":{\"content\":\"b\"}}]}"]) == ["a"]
    assert parse_symbol_ref("src/a.go:main") == ("src/a.go", "main") and parse_symbol_ref("main") == (None, "main") and parse_symbol_ref("A::b") == (None, "A::b")
    t = spark.createDataFrame([("<think>x</think>```go\ncode\n```",)], "t string")
    assert t.select(clean_answer(F.col("t"))).first()[0] == "code"
    repos = spark.createDataFrame([("auth", "legacy"), ("lib", "shared-lib"), ("me", "service")], "name string, role string")
    assert choose_repositories(repos, every=True, current="me").count() == 2 and choose_repositories(repos, with_current=True).count() == 3
    with pytest.raises(LookupError):
        choose_repositories(repos, name="nope")
    with pytest.raises(ValueError):
        choose_repositories(repos, name="auth", every=True)


def test_text_functions(spark):
    df = spark.createDataFrame([("éan an xan an_ an",), ("",), ("a\n",)], "t string")
    got = df.select(F.size(F.regexp_extract_all("t", F.lit(x.whole_word("an")), F.lit(0))), x.line_count(F.col("t")), F.octet_length("t")).collect()
    assert [tuple(r) for r in got] == [(3, 1, 18), (0, 0, 0), (0, 2, 2)]
    m = spark.createDataFrame([('if (a < "b")',)], "t string").select(x.mermaid_escape(F.col("t"))).first()[0]
    assert m == "if #40;a #lt; #quot;b#quot;#41;"


def test_rules_reach_any_depth(spark, tmp_path):
    deep = "/".join(f"d{i}" for i in range(60))
    df = spark.createDataFrame([(f"{deep}/gone/a.go",), (f"{deep}/kept/a.go",)], "p string")
    (tmp_path / ".gitignore").write_text("gone/\n# remark\n")
    (tmp_path / ".own").write_text("!x\n")
    rules = load_rules(str(tmp_path), (".gitignore", ".none", ".own"))
    assert [r.pattern for r in rules] == ["gone", "x"] and rules[1].negated
    assert [r.p for r in df.where(~is_ignored(F.col("p"), [], rules)).collect()] == [f"{deep}/kept/a.go"]


def test_heads_and_references(spark):
    df = spark.createDataFrame([("é" * 20,), ("abc",), ("",)], "t string")
    assert [r.h for r in df.select(first_bytes(F.col("t"), F.lit(7)).alias("h")).collect()] == ["ééé", "abc", ""]
    d = spark.createDataFrame([("README.md", "x" * 5000), ("sub/README.md", "y"), ("go.mod", "z" * 2000), ("Makefile", "m")], "p string, t string")
    assert {r.kind: len(r.text) for r in excerpts(d, "p", "t").collect()} == {"readme": 3000, "manifest": 1500, "makefile": 1}
    assert parse_symbol_ref("/root/src/a.go:F", "/root") == ("src/a.go", "F") and parse_symbol_ref("other:F") == (None, "other:F")
    s = spark.createDataFrame([(0.25,), (5.0,), (125.4,)], "s double").select(duration_text(F.col("s")).alias("d")).collect()
    assert [r.d for r in s] == ["250ms", "5.0s", "2m5s"]
