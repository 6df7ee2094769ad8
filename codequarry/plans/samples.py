"""Symbols of every language, over a file a row of ``chunk_infos``.

A language's sample is a short file with a name of the row's own in it, and the symbols it
must give, written by hand from the language's rules. The SQL is the same table of symbols.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators.symbols import symbol_table
from codequarry.session import read_table

#: Per language: file name, text, and (name, kind, first line, last line, parent) in order.
SAMPLES: dict[str, tuple[str, str, tuple[tuple[str, str, int, int, str], ...]]] = {
    "go": ("a.go", "package p\n\ntype {n}T struct {\n\tx int\n}\n\nfunc (t *{n}T) Get() int {\n\tif t.x > 0 {\n\t\treturn 1\n\t}\n\treturn 0\n}\n\nfunc {n}(a int) {\n}\n\nconst {n}C = 1\n", (("p", "package", 1, 1, ""), ("{n}T", "struct", 3, 5, ""), ("Get", "method", 7, 12, "{n}T"), ("{n}", "function", 14, 15, ""), ("{n}C", "constant", 17, 17, ""))),
    "python": ("a.py", "class {n}C:\n    def get(self):\n        return 1\n\n\nasync def {n}(a):\n    if a:\n        return 2\n    return 3\n\n\n{n} = 4\nLIMIT = 5\n", (("{n}C", "class", 1, 3, ""), ("get", "method", 2, 3, "{n}C"), ("{n}", "function", 6, 9, ""), ("LIMIT", "constant", 13, 13, ""))),
    "python2": ("a.py2", "class {n}C(object):\n    def get(self):\n        print 'x'\n\ndef {n}(a):\n    print a\n", (("{n}C", "class", 1, 3, ""), ("get", "method", 2, 3, "{n}C"), ("{n}", "function", 5, 6, ""))),
    "javascript": ("a.js", "export class {n}C {\n  get(a) {\n    return a;\n  }\n}\nfunction {n}(a) {\n  return a;\n}\nconst {n}F = (a) => {\n  return a;\n};\nexport const LIMIT_A = 3;\n", (("{n}C", "class", 1, 5, ""), ("get", "method", 2, 4, "{n}C"), ("{n}", "function", 6, 8, ""), ("{n}F", "function", 9, 11, ""), ("LIMIT_A", "constant", 12, 12, ""))),
    "typescript": ("a.ts", "export interface {n}I {\n  x: number;\n}\nexport enum {n}E {\n  A,\n}\ntype {n}T = string;\nexport class {n}C {\n  get(a: number): number {\n    return a;\n  }\n}\nexport function {n}(a: string): void {\n}\n", (("{n}I", "interface", 1, 3, ""), ("{n}E", "enum", 4, 6, ""), ("{n}T", "type", 7, 7, ""), ("{n}C", "class", 8, 12, ""), ("get", "method", 9, 11, "{n}C"), ("{n}", "function", 13, 14, ""))),
    "java": ("A.java", "package a.b;\n\npublic class {n}C {\n    static final int LIMIT = 3;\n    public int get(int a) {\n        return a;\n    }\n}\ninterface {n}I {\n}\nenum {n}E {\n    A\n}\n", (("a.b", "package", 1, 1, ""), ("{n}C", "class", 3, 8, ""), ("LIMIT", "constant", 4, 4, "{n}C"), ("get", "method", 5, 7, "{n}C"), ("{n}I", "interface", 9, 10, ""), ("{n}E", "enum", 11, 13, ""))),
    "c": ("a.c", "#define {n}_D 3\nstruct {n}_s {\n    int x;\n};\nenum {n}_e { A };\ntypedef int {n}_t;\nstatic int {n}(int a)\n{\n    return a;\n}\n", (("{n}_D", "constant", 1, 1, ""), ("{n}_s", "struct", 2, 4, ""), ("{n}_e", "enum", 5, 5, ""), ("{n}_t", "type", 6, 6, ""), ("{n}", "function", 7, 10, ""))),
    "cpp": ("a.cpp", "namespace {n}_ns {\nclass {n}C {\n  int get(int a) {\n    return a;\n  }\n};\n}\nint {n}C::put(int a) {\n  return a;\n}\n", (("{n}_ns", "module", 1, 7, ""), ("{n}C", "class", 2, 6, ""), ("get", "method", 3, 5, "{n}C"), ("put", "method", 8, 10, "{n}C"))),
    "csharp": ("a.cs", "using System.Text;\nnamespace {n}Ns;\npublic interface {n}I {\n}\npublic class {n}C {\n    public const int Limit = 3;\n    public int Get(int a) {\n        return a;\n    }\n}\n", (("System.Text", "import", 1, 1, ""), ("{n}Ns", "package", 2, 2, ""), ("{n}I", "interface", 3, 4, ""), ("{n}C", "class", 5, 10, ""), ("Limit", "constant", 6, 6, "{n}C"), ("Get", "method", 7, 9, "{n}C"))),
    "kotlin": ("a.kt", "package a.b\n\ninterface {n}I {\n}\nclass {n}C {\n    fun get(a: Int): Int {\n        return a\n    }\n}\nfun {n}(a: Int) {\n}\nconst val {n}K = 1\nval {n}V = 2\n", (("a.b", "package", 1, 1, ""), ("{n}I", "interface", 3, 4, ""), ("{n}C", "class", 5, 9, ""), ("get", "method", 6, 8, "{n}C"), ("{n}", "function", 10, 11, ""), ("{n}K", "constant", 12, 12, ""), ("{n}V", "variable", 13, 13, ""))),
    "swift": ("a.swift", "import Foundation\nprotocol {n}P {\n}\nstruct {n}S {\n    func get(a: Int) -> Int {\n        return a\n    }\n}\nfunc {n}(a: Int) {\n}\ntypealias {n}T = Int\n", (("Foundation", "import", 1, 1, ""), ("{n}P", "interface", 2, 3, ""), ("{n}S", "struct", 4, 8, ""), ("get", "method", 5, 7, "{n}S"), ("{n}", "function", 9, 10, ""), ("{n}T", "type", 11, 11, ""))),
    "rust": ("a.rs", "pub struct {n}S {\n    x: u8,\n}\npub trait {n}T {\n}\nimpl {n}S {\n    pub fn get(&self) -> u8 {\n        self.x\n    }\n}\npub fn {n}(a: u8) {\n}\nconst {n}_K: u8 = 1;\n", (("{n}S", "struct", 1, 3, ""), ("{n}T", "trait", 4, 5, ""), ("get", "method", 7, 9, "{n}S"), ("{n}", "function", 11, 12, ""), ("{n}_K", "constant", 13, 13, ""))),
    "php": ("a.php", "<?php\nnamespace A\\B;\ninterface {n}I {\n}\ntrait {n}T {\n}\nclass {n}C {\n    const LIMIT = 3;\n    public function get($a) {\n        return $a;\n    }\n}\nfunction {n}($a) {\n}\n", (("A\\B", "package", 2, 2, ""), ("{n}I", "interface", 3, 4, ""), ("{n}T", "trait", 5, 6, ""), ("{n}C", "class", 7, 12, ""), ("LIMIT", "constant", 8, 8, "{n}C"), ("get", "method", 9, 11, "{n}C"), ("{n}", "function", 13, 14, ""))),
    "groovy": ("a.groovy", "package a.b\nimport c.D\nclass {n}C {\n  def get(a) {\n    return a\n  }\n}\ndef {n}(a) {\n}\ndef {n}V = 3\n", (("a.b", "package", 1, 1, ""), ("c.D", "import", 2, 2, ""), ("{n}C", "class", 3, 7, ""), ("get", "method", 4, 6, "{n}C"), ("{n}", "function", 8, 9, ""), ("{n}V", "variable", 10, 10, ""))),
    "perl": ("a.pm", "package {n}::P;\nuse constant LIMIT => 3;\nour $total = 1;\nsub {n} {\n    return 1;\n}\n", (("{n}::P", "package", 1, 1, ""), ("LIMIT", "constant", 2, 2, "{n}::P"), ("total", "variable", 3, 3, "{n}::P"), ("{n}", "method", 4, 6, "{n}::P"))),
    "zig": ("a.zig", "pub const {n}S = struct {\n    x: u8,\n};\nconst {n}E = enum {\n    a,\n};\npub fn {n}(a: u8) void {\n}\nconst {n}_k = 3;\nvar {n}_v = 4;\n", (("{n}S", "struct", 1, 3, ""), ("{n}E", "enum", 4, 6, ""), ("{n}", "function", 7, 8, ""), ("{n}_k", "constant", 9, 9, ""), ("{n}_v", "variable", 10, 10, ""))),
    "ruby": ("a.rb", "module M{n}\n  class C{n}\n    LIMIT = 3\n    attr_reader :size, :name\n    def get(a)\n      if a\n        1\n      end\n    end\n    def self.make\n    end\n  end\nend\n", (("M{n}", "module", 1, 13, ""), ("C{n}", "class", 2, 12, "M{n}"), ("LIMIT", "constant", 3, 3, "C{n}"), ("size", "property", 4, 4, "C{n}"), ("name", "property", 4, 4, "C{n}"), ("get", "method", 5, 9, "C{n}"), ("make", "function", 10, 11, "C{n}"))),
    "shell": ("a.sh", "readonly {n}_R=1\nTOTAL=2\n{n}() {\n  echo a\n}\nfunction {n}_b {\n  echo b\n}\n", (("{n}_R", "constant", 1, 1, ""), ("TOTAL", "variable", 2, 2, ""), ("{n}", "function", 3, 5, ""), ("{n}_b", "function", 6, 8, ""))),
    "sql": ("a.sql", "CREATE TABLE {n}_t (\n  a INT\n);\nCREATE INDEX {n}_i ON {n}_t (a);\nCREATE FUNCTION {n}_f() RETURNS INT AS $$\nBEGIN\n  ALTER TABLE {n}_x ADD b INT;\n  RETURN 1;\nEND\n$$;\nCREATE SCHEMA {n}_s;\n", (("{n}_t", "type", 1, 3, ""), ("{n}_i", "constant", 4, 4, ""), ("{n}_f", "function", 5, 10, ""), ("{n}_s", "module", 11, 11, ""))),
    "cobol": ("a.cob", "000100 IDENTIFICATION DIVISION.\n000200 PROGRAM-ID. {n}.\n000300* A REMARK\n000400 DATA DIVISION.\n000500 01  {n}-REC.\n000600     05  {n}-A PIC X.\n000700     78  {n}-K VALUE 1.\n000800 PROCEDURE DIVISION.\n000900 {n}-PARA.\n001000     COPY {n}-BOOK.\n001100     STOP RUN.\n", (("IDENTIFICATION DIVISION", "module", 1, 3, ""), ("{n}", "class", 2, 11, ""), ("DATA DIVISION", "module", 4, 7, "{n}"), ("{n}-REC", "type", 5, 5, ""), ("{n}-A", "variable", 6, 6, ""), ("{n}-K", "constant", 7, 7, ""), ("PROCEDURE DIVISION", "module", 8, 11, "{n}"), ("{n}-PARA", "function", 9, 9, "{n}"), ("{n}-BOOK", "import", 10, 10, ""))),
    "css": ("a.scss", "${n}: 3px;\n.{n} {\n  color: red;\n}\n@media (min-width: 3px) {\n  .inner {\n    color: blue;\n  }\n}\n@mixin {n}-m {\n}\n", (("${n}", "variable", 1, 1, ""), (".{n}", "class", 2, 4, ""), ("(min-width: 3px)", "module", 5, 9, ""), ("{n}-m", "function", 10, 11, ""))),
    "cypher": ("a.cypher", "CREATE CONSTRAINT {n}_c FOR (a:{n}A) REQUIRE a.id IS UNIQUE;\nMATCH (a:{n}A)-[:{n}_R]->(b:{n}B)\nCALL db.labels() YIELD label\nMATCH (c:{n}B)-[:{n}_R]->(d) RETURN d;\n", (("{n}_c", "constant", 1, 1, ""), ("{n}A", "type", 1, 1, ""), ("{n}_R", "property", 2, 2, ""), ("{n}B", "type", 2, 2, ""), ("db.labels", "function", 3, 3, ""))),
    "dockerfile": ("{n}/Dockerfile", "ARG VERSION=1\nFROM base:1 AS {n}\nENV MODE=a\nRUN make \\\n    ENV NOT=1\nFROM scratch\nEXPOSE 80\nCMD [\"x\"]\n", (("VERSION", "variable", 1, 1, ""), ("{n}", "module", 2, 5, ""), ("MODE", "variable", 3, 3, "{n}"), ("scratch", "module", 6, 8, ""), ("EXPOSE 80", "property", 7, 7, "scratch"), ("CMD", "function", 8, 8, "scratch"))),
    "env": ("a.env", "# remark\n{n}_A=1\nexport {n}_B=2\n", (("{n}_A", "variable", 2, 2, ""), ("{n}_B", "variable", 3, 3, ""))),
    "properties": ("a.properties", "# remark\n{n}.a=1\n{n}.b: 2\n", (("{n}.a", "property", 2, 2, ""), ("{n}.b", "property", 3, 3, ""))),
    "hcl": ("a.tf", "resource \"aws_x\" \"{n}\" {\n  size = 3\n}\ndata \"aws_y\" \"{n}\" {\n}\nvariable \"{n}_v\" {\n}\noutput \"{n}_o\" {\n}\nprovider \"aws\" {\n}\nlocals {\n  {n}_l = 3\n}\n", (("aws_x.{n}", "type", 1, 3, ""), ("data.aws_y.{n}", "type", 4, 5, ""), ("{n}_v", "variable", 6, 7, ""), ("{n}_o", "constant", 8, 9, ""), ("aws", "import", 10, 11, ""), ("local.{n}_l", "variable", 13, 13, "locals"))),
    "html": ("a.html", "<html>\n<body>\n<div id=\"{n}\">\n  <input name=\"{n}_f\">\n  <p>text</p>\n</div>\n<script src=\"x\"></script>\n</body>\n</html>\n", (("html", "module", 1, 9, ""), ("body", "module", 2, 8, "html"), ("div#{n}", "class", 3, 6, "body"), ("input[{n}_f]", "property", 4, 4, "div#{n}"), ("script", "struct", 7, 7, "body"))),
    "json": ("a.json", "{\n  \"{n}\": {\n    \"inner\": 1\n  },\n  \"{n}_list\": [\n    {\"deep\": 2}\n  ],\n  \"{n}_s\": \"a: {b\"\n}\n", (("{n}", "module", 2, 2, ""), ("{n}_list", "module", 5, 5, ""), ("{n}_s", "property", 8, 8, ""))),
    "makefile": ("{n}.mk", "include {n}.inc\nTOTAL := 3\n{n}: dep\n\techo a\n\techo b\n\nother:\n\techo c\n", (("{n}.inc", "import", 1, 1, ""), ("TOTAL", "variable", 2, 2, ""), ("{n}", "function", 3, 6, ""), ("other", "function", 7, 8, ""))),
    "markdown": ("a.md", "# {n}\n\ntext\n\n### {n} part\n\nmore\n\n## {n} next\n\nend\n", (("{n}", "module", 1, 11, ""), ("{n} part", "function", 5, 8, ""), ("{n} next", "module", 9, 11, ""))),
    "mermaid": ("a.mmd", "flowchart TD\n  subgraph {n}_g\n    {n}[one] --> other(two)\n  end\n  other(two) --> {n}[one]\n", (("flowchart", "module", 1, 5, ""), ("{n}_g", "struct", 2, 4, ""), ("{n}", "function", 3, 3, "{n}_g"), ("other", "function", 3, 3, "{n}_g"))),
    "protobuf": ("a.proto", "package a.b;\nimport \"c.proto\";\nmessage {n}M {\n  string name = 1;\n}\nenum {n}E {\n  UNKNOWN = 0;\n}\nservice {n}S {\n  rpc Get (A) returns (B);\n}\n", (("a.b", "package", 1, 1, ""), ("c.proto", "import", 2, 2, ""), ("{n}M", "struct", 3, 5, ""), ("name", "property", 4, 4, "{n}M"), ("{n}E", "enum", 6, 8, ""), ("UNKNOWN", "constant", 7, 7, "{n}E"), ("{n}S", "interface", 9, 11, ""), ("Get", "method", 10, 10, "{n}S"))),
    "toml": ("a.toml", "top = 1\n[{n}]\na = 2\n[[{n}.list]]\nb = 3\n", (("top", "property", 1, 1, ""), ("[{n}]", "module", 2, 3, ""), ("a", "property", 3, 3, "[{n}]"), ("[[{n}.list]]", "class", 4, 5, ""), ("b", "property", 5, 5, "[[{n}.list]]"))),
    "xml": ("a.xml", "<?xml version=\"1.0\"?>\n<root\n    xmlns:x=\"urn:x\">\n  <part id=\"{n}\">\n    <leaf name=\"{n}_l\"/>\n  </part>\n</root>\n", (("x", "import", 2, 2, ""), ("root", "class", 2, 7, ""), ("part#{n}", "struct", 4, 6, "root"), ("leaf[{n}_l]", "property", 5, 5, "part#{n}"))),
    "yaml": ("a.yaml", "{n}:\n  a: 1\n  text: |\n    not: key\n{n}_s: 3\n", (("{n}", "module", 1, 4, ""), ("a", "property", 2, 2, "{n}"), ("text", "property", 3, 3, "{n}"), ("{n}_s", "property", 5, 5, ""))),
}


def _query(language: str):
    name, text, _ = SAMPLES[language]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        own = F.concat(F.lit("sym"), F.col("info_id").cast("string"))
        fill = lambda t: F.replace(F.lit(t), F.lit("{n}"), own)
        files = read_table(spark, sf, "chunk_infos").select("info_id").distinct().select(F.concat(F.col("info_id").cast("string"), F.lit("/"), fill(name)).alias("path"), fill(text).alias("content"))
        s = symbol_table(files, "path", "content")
        return s.select(F.split("path", "/")[0].cast("long").alias("info_id"), "ordinal", "name", "kind", "start_line", "end_line", "parent")

    run.__name__ = f"lang_{language}"
    run.__doc__ = f"Symbols of a {language} file for every item."
    return run


def _sql(language: str) -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quote(n)}, {quote(kind)}, {a}, {b}, {quote(p)})" for k, (n, kind, a, b, p) in enumerate(SAMPLES[language][2]))
    return f"""SELECT info_id, ordinal::INT AS ordinal, replace(name, '{{n}}', 'sym' || info_id) AS name, kind, start_line::INT AS start_line, end_line::INT AS end_line, replace(parent, '{{n}}', 'sym' || info_id) AS parent
        FROM (SELECT DISTINCT info_id FROM chunk_infos), (VALUES {rows}) v(ordinal, name, kind, start_line, end_line, parent)"""


QUERIES = {f"lang_{x}": _query(x) for x in SAMPLES}
ORACLE_SQL = {f"lang_{x}": _sql(x) for x in SAMPLES}
