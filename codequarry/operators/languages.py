"""Symbol rules per language, as data: an ordered list of (kind, pattern) per line.

A pattern's group ``n`` is the name and ``p`` a parent. ``ends`` says how a symbol's
last line is found, ``inside`` which kinds hold members, ``style`` how control flow
is written. First match wins; a function inside a holder is a method of it. Languages
without rules are formats whose lines need state: ``operators.formats`` has them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    rules: tuple[tuple[str, re.Pattern], ...]
    ends: str = "brace"  # brace, indent, end, shell, sql, line, section
    inside: tuple[str, ...] = ("class", "interface", "trait", "struct", "enum", "impl", "module")
    style: str = "unsupported"  # brace, indent, end, shell, sql, unsupported
    names: tuple[str, ...] = ()
    entries: tuple[str, ...] = ()
    comments: tuple[str, ...] = ("//",)
    tests: str = r"(?!)"
    stop: frozenset = field(default=frozenset())


#: Words that look like a call or a method but are not.
KEYWORDS = frozenset(
    "if else for while switch case return func function def class struct enum interface impl trait match do try catch finally throw new "
    "sizeof typeof defer go select when with using lock foreach elif except lambda yield await async not and or in is until unless loop".split()
)
_VIS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|readonly|open|partial|extern|unsafe|inline|const|synchronized|native|default|export|suspend|data|companion|fileprivate|mutating|required|convenience|lateinit|operator|infix|tailrec)\s+)*"
_W = r"[A-Za-z_$][\w$]*"


def _lang(name, ext, rules, **kw) -> Language:
    return Language(name, tuple(ext.split()), tuple((k, re.compile(p)) for k, p in rules), stop=KEYWORDS, **kw)


_C_FN = rf"^(?:[A-Za-z_][\w\s*&<>,:\[\]]*?[\s*&])(?P<n>~?[A-Za-z_]\w*)\s*\([^;]*\)?\s*(?:const\s*)?(?:noexcept\s*)?(?:\{{|$)"
LANGUAGES: tuple[Language, ...] = (
    _lang("go", ".go", [("package", r"^package\s+(?P<n>\w+)"), ("method", r"^func\s+\(\s*\w*\s*\*?(?P<p>\w+)(?:\[[^\]]*\])?\s*\)\s+(?P<n>\w+)"), ("function", r"^func\s+(?P<n>\w+)"), ("struct", r"^\s*(?:type\s+)(?P<n>\w+)\s+struct\b"), ("interface", r"^\s*(?:type\s+)(?P<n>\w+)\s+interface\b"), ("type", r"^type\s+(?P<n>\w+)\s"), ("constant", r"^const\s+(?P<n>\w+)"), ("variable", r"^var\s+(?P<n>\w+)")], style="brace", entries=("main", "init"), tests=r"_test\.go$", inside=()),
    _lang("python", ".py .pyi", [("class", r"^\s*class\s+(?P<n>\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(?P<n>\w+)"), ("constant", r"^(?P<n>[A-Z][A-Z0-9_]{1,})\s*(?::[^=]+)?=")], ends="indent", style="indent", entries=("main",), comments=("#",), tests=r"test_|_test\.py$", inside=("class",)),
    _lang("python2", ".py2 .pyw", [("class", r"^\s*class\s+(?P<n>\w+)"), ("function", r"^\s*def\s+(?P<n>\w+)"), ("constant", r"^(?P<n>[A-Z][A-Z0-9_]{1,})\s*=")], ends="indent", style="indent", entries=("main",), comments=("#",), tests=r"test_", inside=("class",)),
    _lang("javascript", ".js .jsx .mjs .cjs", [("class", rf"^\s*(?:export\s+)?(?:default\s+)?class\s+(?P<n>{_W})"), ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(?P<n>{_W})"), ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<n>{_W})\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|{_W}\s*=>)"), ("constant", rf"^\s*(?:export\s+)?const\s+(?P<n>[A-Z][A-Z0-9_]+)\s*="), ("member", rf"^\s+(?:static\s+|async\s+|get\s+|set\s+|\*\s*)*(?P<n>{_W})\s*\([^)]*\)\s*\{{")], style="brace", entries=("main",), tests=r"\.(?:test|spec)\.|__tests__", inside=("class",)),
    _lang("typescript", ".ts .tsx", [("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<n>{_W})"), ("interface", rf"^\s*(?:export\s+)?(?:default\s+)?interface\s+(?P<n>{_W})"), ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<n>{_W})"), ("type", rf"^\s*(?:export\s+)?type\s+(?P<n>{_W})\s*(?:<[^>]*>)?\s*="), ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(?P<n>{_W})"), ("function", rf"^\s*(?:export\s+)?(?:const|let)\s+(?P<n>{_W})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=]*=>)"), ("constant", rf"^\s*(?:export\s+)?const\s+(?P<n>[A-Z][A-Z0-9_]+)\s*[:=]"), ("member", rf"^\s+{_VIS}(?:get\s+|set\s+)?(?P<n>{_W})\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{{]+)?\{{")], style="brace", entries=("main",), tests=r"\.(?:test|spec)\.|__tests__", inside=("class", "interface")),
    _lang("java", ".java", [("package", r"^\s*package\s+(?P<n>[\w.]+)"), ("class", rf"^\s*{_VIS}(?:class|record)\s+(?P<n>\w+)"), ("interface", rf"^\s*{_VIS}@?interface\s+(?P<n>\w+)"), ("enum", rf"^\s*{_VIS}enum\s+(?P<n>\w+)"), ("constant", r"^\s*(?:public\s+|private\s+|protected\s+)?static\s+final\s+[\w<>\[\], ]+\s+(?P<n>[A-Z][A-Z0-9_]*)\s*="), ("member", rf"^\s*{_VIS}(?:<[^>]+>\s*)?[\w<>\[\],.? ]+\s+(?P<n>\w+)\s*\([^;]*\)?\s*(?:throws [\w., ]+)?\{{")], style="brace", entries=("main",), tests=r"Test\.java$|/test/", inside=("class", "interface", "enum")),
    _lang("c", ".c .h", [("constant", r"^#define\s+(?P<n>\w+)"), ("struct", r"^(?:typedef\s+)?struct\s+(?P<n>\w+)\s*\{?$"), ("enum", r"^(?:typedef\s+)?enum\s+(?P<n>\w+)"), ("type", r"^typedef\s+[^;]*?(?P<n>\w+)\s*;"), ("function", _C_FN)], style="brace", entries=("main",), tests=r"test", inside=()),
    _lang("cpp", ".cpp .cc .cxx .hpp .hxx .hh", [("module", r"^\s*namespace\s+(?P<n>[\w:]+)"), ("class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<n>\w+)(?!\s*;)"), ("struct", r"^\s*(?:typedef\s+)?struct\s+(?P<n>\w+)(?!\s*;)"), ("enum", r"^\s*enum\s+(?:class\s+)?(?P<n>\w+)"), ("method", r"^[\w\s*&<>,:]*?\b(?P<p>\w+)::(?P<n>~?\w+)\s*\("), ("function", _C_FN), ("member", r"^\s+(?:virtual\s+|static\s+|inline\s+|explicit\s+)*[\w:<>*&, ]+[\s*&](?P<n>~?\w+)\s*\([^;]*\)\s*(?:const\s*)?(?:override\s*)?\{")], style="brace", entries=("main",), tests=r"test", inside=("class", "struct")),
    _lang("csharp", ".cs .csx", [("import", r"^\s*using\s+(?:static\s+)?(?P<n>[\w.]+)\s*;"), ("package", r"^\s*namespace\s+(?P<n>[\w.]+)"), ("interface", rf"^\s*{_VIS}interface\s+(?P<n>\w+)"), ("class", rf"^\s*{_VIS}(?:class|record)\s+(?P<n>\w+)"), ("struct", rf"^\s*{_VIS}struct\s+(?P<n>\w+)"), ("enum", rf"^\s*{_VIS}enum\s+(?P<n>\w+)"), ("type", rf"^\s*{_VIS}delegate\s+\S+\s+(?P<n>\w+)"), ("constant", rf"^\s*{_VIS}const\s+\S+\s+(?P<n>\w+)\s*="), ("property", rf"^\s*{_VIS}[\w<>\[\],.?]+\s+(?P<n>\w+)\s*\{{\s*get"), ("member", rf"^\s*{_VIS}[\w<>\[\],.?]+\s+(?P<n>\w+)\s*(?:<[^>]*>)?\([^;]*\)?\s*(?:\{{|=>|$)")], style="brace", entries=("Main",), tests=r"Tests?\.cs$", inside=("class", "struct", "interface")),
    _lang("kotlin", ".kt .kts", [("package", r"^package\s+(?P<n>[\w.]+)"), ("enum", rf"^\s*{_VIS}enum\s+class\s+(?P<n>\w+)"), ("interface", rf"^\s*{_VIS}(?:fun\s+)?interface\s+(?P<n>\w+)"), ("class", rf"^\s*{_VIS}(?:class|object)\s+(?P<n>\w+)"), ("type", r"^\s*typealias\s+(?P<n>\w+)"), ("function", rf"^\s*{_VIS}fun\s+(?:<[^>]+>\s*)?(?:[\w<>?]+\.)?(?P<n>\w+)\s*\("), ("constant", r"^\s*(?:private\s+)?const\s+val\s+(?P<n>\w+)"), ("variable", r"^(?:private\s+)?va[lr]\s+(?P<n>\w+)")], style="brace", entries=("main",), tests=r"Test\.kt$", inside=("class", "interface", "enum")),
    _lang("swift", ".swift", [("import", r"^import\s+(?P<n>\w+)"), ("interface", rf"^\s*{_VIS}protocol\s+(?P<n>\w+)"), ("class", rf"^\s*{_VIS}(?:class|actor|extension)\s+(?P<n>\w+)"), ("struct", rf"^\s*{_VIS}struct\s+(?P<n>\w+)"), ("enum", rf"^\s*{_VIS}(?:indirect\s+)?enum\s+(?P<n>\w+)"), ("type", r"^\s*(?:public\s+)?typealias\s+(?P<n>\w+)"), ("function", rf"^\s*(?:@\w+\s+)*{_VIS}func\s+(?P<n>\w+)"), ("function", rf"^\s*{_VIS}(?P<n>init|deinit)\b"), ("constant", r"^\s*(?:static\s+)?let\s+(?P<n>[A-Z]\w*)"), ("variable", r"^var\s+(?P<n>\w+)")], style="brace", entries=("main",), tests=r"Tests?\.swift$", inside=("class", "struct", "enum", "interface")),
    _lang("rust", ".rs", [("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<n>\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>\w+)"), ("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<n>\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(?P<n>\w+)"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<n>\w+)"), ("constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static(?:\s+mut)?)\s+(?P<n>\w+)\s*:")], style="brace", entries=("main",), tests=r"tests/|_test\.rs$", inside=("impl", "trait")),
    _lang("php", ".php .phtml .php3 .php4 .php5", [("package", r"^\s*namespace\s+(?P<n>[\w\\]+)"), ("class", rf"^\s*{_VIS}class\s+(?P<n>\w+)"), ("interface", r"^\s*interface\s+(?P<n>\w+)"), ("trait", r"^\s*trait\s+(?P<n>\w+)"), ("enum", r"^\s*enum\s+(?P<n>\w+)"), ("function", rf"^\s*{_VIS}function\s+&?(?P<n>\w+)"), ("constant", rf"^\s*{_VIS}const\s+(?:\w+\s+)?(?P<n>[A-Z_]\w*)\s*="), ("constant", r"define\(\s*['\"](?P<n>\w+)")], style="brace", entries=("main",), comments=("//", "#"), tests=r"Test\.php$", inside=("class", "interface", "trait", "enum")),
    _lang("groovy", ".groovy .gvy .gy .gsh", [("package", r"^package\s+(?P<n>[\w.]+)"), ("import", r"^import\s+(?:static\s+)?(?P<n>[\w.*]+)"), ("module", r"^\s*(?P<n>pipeline)\s*\{"), ("method", r"^\s*stage\s*\(\s*['\"](?P<n>[^'\"]+)"), ("interface", rf"^\s*{_VIS}interface\s+(?P<n>\w+)"), ("trait", r"^\s*trait\s+(?P<n>\w+)"), ("enum", rf"^\s*{_VIS}enum\s+(?P<n>\w+)"), ("class", rf"^\s*{_VIS}class\s+(?P<n>\w+)"), ("function", rf"^\s*{_VIS}(?:def|void|[A-Z]\w*|int|boolean)\s+(?P<n>\w+)\s*\([^)]*\)\s*\{{"), ("variable", r"^def\s+(?P<n>\w+)\s*=")], style="brace", entries=("main", "call"), names=("jenkinsfile",), tests=r"Spec\.groovy$", inside=("class", "interface", "trait", "enum")),
    _lang("perl", ".pl .pm .t .psgi", [("package", r"^package\s+(?P<n>[\w:]+)"), ("constant", r"^use\s+constant\s+(?P<n>\w+)"), ("function", r"^\s*sub\s+(?P<n>\w+)"), ("property", r"^has\s+['\"]?(?P<n>\w+)"), ("variable", r"^our\s+[$@%](?P<n>\w+)")], style="brace", entries=("main",), comments=("#",), tests=r"\.t$", inside=("package",)),
    _lang("zig", ".zig", [("struct", r"^\s*(?:pub\s+)?const\s+(?P<n>\w+)\s*=\s*(?:packed\s+|extern\s+)?struct\b"), ("enum", r"^\s*(?:pub\s+)?const\s+(?P<n>\w+)\s*=\s*enum\b"), ("type", r"^\s*(?:pub\s+)?const\s+(?P<n>\w+)\s*=\s*(?:union|error)\b"), ("function", r"^\s*(?:pub\s+|export\s+|inline\s+)*fn\s+(?P<n>\w+)"), ("function", r"^test\s+\"(?P<n>[^\"]+)"), ("constant", r"^(?:pub\s+)?const\s+(?P<n>\w+)"), ("variable", r"^(?:pub\s+)?var\s+(?P<n>\w+)")], style="brace", entries=("main",), inside=()),
    _lang("ruby", ".rb .rake .gemspec", [("module", r"^\s*module\s+(?P<n>[\w:]+)"), ("class", r"^\s*class\s+(?P<n>[A-Z][\w:]*)"), ("static", r"^\s*def\s+self\.(?P<n>[\w?!=]+)"), ("member", r"^\s*def\s+(?P<n>[\w?!=]+)"), ("property", r"^\s*attr_(?:accessor|reader|writer)\s+:(?P<n>\w+)"), ("constant", r"^\s*(?P<n>[A-Z][A-Z0-9_]+)\s*=")], ends="end", style="end", entries=("main",), comments=("#",), tests=r"_spec\.rb$|_test\.rb$", inside=("class", "module")),
    _lang("shell", ".sh .bash .zsh .ksh .bats", [("function", r"^\s*function\s+(?P<n>[\w-]+)"), ("function", r"^\s*(?P<n>[\w-]+)\s*\(\)\s*\{?"), ("constant", r"^(?:readonly|declare\s+-r)\s+(?P<n>\w+)="), ("variable", r"^(?:export\s+)?(?P<n>[A-Z][A-Z0-9_]*)=")], ends="shell", style="shell", entries=("main",), comments=("#",), tests=r"\.bats$", inside=()),
    _lang("sql", ".sql .ddl .dml .pgsql .plsql", [("type", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view|materialized\s+view)\s+(?:if\s+not\s+exists\s+)?(?P<n>[\w.\"]+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure|trigger)\s+(?P<n>[\w.\"]+)"), ("constant", r"(?i)^\s*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?(?P<n>[\w.\"]+)"), ("type", r"(?i)^\s*create\s+type\s+(?P<n>[\w.\"]+)"), ("module", r"(?i)^\s*create\s+(?:schema|database|package)\s+(?:if\s+not\s+exists\s+)?(?P<n>[\w.\"]+)"), ("variable", r"(?i)^\s*create\s+sequence\s+(?P<n>[\w.\"]+)"), ("variable", r"(?i)^\s*alter\s+table\s+(?P<n>[\w.\"]+)")], ends="sql", style="sql", comments=("--",), inside=()),
    _lang("cobol", ".cob .cbl .cpy .cobol", [], ends="line", comments=("*",), inside=()),
    _lang("css", ".css .scss .less .sass", [], inside=()),
    _lang("cypher", ".cypher .cql", [], ends="line", inside=()),
    _lang("dockerfile", ".dockerfile .containerfile", [], ends="line", names=("dockerfile", "containerfile"), comments=("#",), inside=()),
    _lang("env", ".env", [("variable", r"^\s*(?:export\s+)?(?P<n>[A-Za-z_]\w*)\s*=")], ends="line", comments=("#",), inside=()),
    _lang("properties", ".properties", [("property", r"^\s*(?P<n>[\w.-]+)\s*[=:]")], ends="line", comments=("#",), inside=()),
    _lang("hcl", ".tf .hcl .tfvars", [], comments=("#", "//"), inside=()),
    _lang("html", ".html .htm", [], ends="line", inside=()),
    _lang("json", ".json .jsonc .json5", [], ends="line", inside=()),
    _lang("makefile", ".mk .make", [("import", r"^-?include\s+(?P<n>\S+)"), ("property", r"^(?P<n>\.PHONY)\s*:"), ("variable", r"^(?:export\s+)?(?P<n>[A-Za-z_]\w*)\s*[:?+]?=(?!=)"), ("function", r"^define\s+(?P<n>\w+)"), ("function", r"^(?P<n>[\w./%-]+)\s*:(?!=)")], ends="section", names=("makefile", "gnumakefile"), comments=("#",), inside=()),
    _lang("markdown", ".md .markdown .mdx", [("module", r"^#{1,2}\s+(?P<n>.+?)\s*#*$"), ("function", r"^#{3,6}\s+(?P<n>.+?)\s*#*$"), ("constant", r"^(?:```|~~~)(?P<n>\w+)"), ("property", r"^(?P<n>[\w-]+):\s")], ends="section", comments=(), inside=()),
    _lang("mermaid", ".mermaid .mmd", [], ends="line", comments=("%%",), inside=()),
    _lang("protobuf", ".proto", [("package", r"^package\s+(?P<n>[\w.]+)"), ("import", r"^import\s+(?:public\s+)?\"(?P<n>[^\"]+)"), ("interface", r"^\s*service\s+(?P<n>\w+)"), ("struct", r"^\s*message\s+(?P<n>\w+)"), ("enum", r"^\s*enum\s+(?P<n>\w+)"), ("type", r"^\s*oneof\s+(?P<n>\w+)"), ("member", r"^\s*rpc\s+(?P<n>\w+)"), ("property", r"^\s*(?:repeated\s+|optional\s+|required\s+)?[\w.<>][\w.<>, ]*\s+(?P<n>\w+)\s*=\s*\d+"), ("constant", r"^\s*(?P<n>[A-Z][A-Z0-9_]*)\s*=\s*\d+")], inside=("interface", "struct", "enum")),
    _lang("toml", ".toml", [], ends="section", comments=("#",), inside=()),
    _lang("xml", ".xml .xsl .xslt .xsd .plist .xaml", [], ends="line", inside=()),
    _lang("yaml", ".yaml .yml", [], ends="indent", comments=("#",), inside=("module",)),
)
BY_NAME = {x.name: x for x in LANGUAGES}
BY_EXTENSION = {e: x.name for x in LANGUAGES for e in x.extensions}
BY_FILE_NAME = {n: x.name for x in LANGUAGES for n in x.names}
#: The narrow kinds that traces use.
NARROW = {"class": "type", "struct": "type", "type": "type", "enum": "type", "impl": "type", "interface": "interface", "trait": "interface", "variable": "variable", "property": "variable", "package": "package", "module": "package"}
