"""Symbols of formats whose lines mean something only with what stands around them.

Each extractor takes a file's lines and yields ``(kind, name, first, last, parent)``, lines
from 0. State is a stack or a few variables; nothing looks back further than that.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

Symbol = tuple[str, str, int, int, str]
_QUOTED = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'")


def _blank(line: str, comment: str | None = None) -> str:
    """The line with the contents of strings blanked and a comment cut off."""
    line = _QUOTED.sub(lambda m: '"' + " " * (len(m[0]) - 2) + '"', line)
    return line if comment is None or comment not in line else line[: line.index(comment)]


def _brace_end(lines: list[str], at: int, comment: str | None = None) -> int:
    """Line on which the first brace opened at or after ``at`` closes; ``at`` if none opens."""
    level, opened = 0, False
    for i in range(at, len(lines)):
        for ch in _blank(lines[i], comment):
            level += (ch == "{") - (ch == "}")
            opened |= ch == "{"
            if opened and level <= 0:
                return i
        if not opened and i > at + 1:
            return at
    return len(lines) - 1 if opened else at


def json_keys(lines: list[str]) -> Iterator[Symbol]:
    """Keys of the outermost object: a module if the value is an object or array."""
    depth, key, awaits, text = 0, None, False, "\n".join(lines)
    line = 0
    for m in re.finditer(r"\n|//[^\n]*|/\*.*?\*/|\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)'|[{}\[\]:,]|[^\s{}\[\]:,\"'/]+|/", text, re.S):
        t = m[0]
        if t == "\n":
            line += 1
        elif t.startswith(("//", "/*")):
            line += t.count("\n")
        elif t == ":" and depth == 1 and key:
            awaits = True
        else:
            if awaits:
                yield "module" if t in "{[" else "property", key[0], key[1], key[1], ""
                key, awaits = None, False
            if t in "{[":
                depth += 1
            elif t in "}]":
                depth -= 1
            elif depth == 1 and t != ",":
                key = (m[1] if m[1] is not None else m[2] if m[2] is not None else t, line)


def yaml_keys(lines: list[str]) -> Iterator[Symbol]:
    """Top-level keys, and keys indented by at most four with the nearest top-level key as
    parent. The text of a block scalar has no keys."""
    top, scalar = "", None
    for i, line in enumerate(lines):
        body = line.lstrip(" ")
        indent = len(line) - len(body)
        if not body or body.startswith("#"):
            continue
        if scalar is not None and indent > scalar:
            continue
        scalar = None
        m = re.match(r"([\w.$/-]+|\"[^\"]+\"|'[^']+')\s*:(?:\s+(.*)|)$", body)
        if not m or indent > 4:
            continue
        value = re.sub(r"(?:^|\s)#.*$", "", m[2] or "").strip()
        if re.match(r"[|>][+-]?\d?$", value):
            scalar = indent
        name = m[1].strip("\"'")
        if indent:
            yield "property", name, i, i, top
            continue
        top, end = name, i
        for j in range(i + 1, len(lines)):
            s = lines[j].strip()
            if s and not s.startswith("#") and not lines[j][0].isspace() and not lines[j].startswith("- "):
                break
            if s and not s.startswith("#"):
                end = j
        yield "module" if not value or value[0] in "&|>" else "property", name, i, end, ""


def toml_keys(lines: list[str]) -> Iterator[Symbol]:
    """Tables ``[t]`` and arrays of tables ``[[t]]``, keys with their table as parent."""
    table, text = "", None
    heads = [i for i, x in enumerate(lines) if re.match(r"\s*\[\[?[^\[\]]+\]\]?\s*(?:#.*)?$", x)]
    for i, line in enumerate(lines):
        if text:
            text = None if text in line else text
            continue
        s = line.strip()
        if i in heads:
            table = re.match(r"\[\[?[^\[\]]+\]\]?", s)[0]
            later = [h for h in heads if h > i]
            yield "class" if table.startswith("[[") else "module", table, i, (later[0] if later else len(lines)) - 1, ""
        elif m := re.match(r"([\w.-]+|\"[^\"]+\")\s*=\s*(.*)$", s):
            yield "property", m[1].strip('"'), i, i, table
            for q in ('"""', "'''"):
                if m[2].count(q) == 1:
                    text = q


#: Kind of each top-level block and how it is named.
_HCL = {"resource": ("type", "{0}.{1}"), "data": ("type", "data.{0}.{1}"), "module": ("module", "{0}"), "variable": ("variable", "{0}"), "output": ("constant", "{0}"), "provider": ("import", "{0}"), "terraform": ("module", "terraform"), "backend": ("module", "{0}")}


def hcl_blocks(lines: list[str]) -> Iterator[Symbol]:
    """Top-level blocks under names made of their labels; entries of ``locals`` and plain
    assignments are variables."""
    depth, local = 0, False
    for i, line in enumerate(lines):
        s = _blank(line, "#").split("//")[0]
        if depth == 0 and (m := re.match(r"\s*(\w+)((?:\s+\"[^\"]*\")*)\s*\{", line)):
            labels = re.findall(r"\"([^\"]*)\"", m[2])
            local = m[1] == "locals"
            if m[1] in _HCL:
                kind, shape = _HCL[m[1]]
                if shape.count("{") <= len(labels):
                    yield kind, shape.format(*labels), i, _brace_end(lines, i, "#"), ""
        elif depth == (1 if local else 0) and (m := re.match(r"\s*([\w-]+)\s*=(?!=)", line)):
            yield "variable", f"local.{m[1]}" if local else m[1], i, i, "locals" if local else ""
        depth += s.count("{") - s.count("}")
        local = local and depth > 0


def docker_steps(lines: list[str]) -> Iterator[Symbol]:
    """Stages, and what stands in them with the stage as parent. A stage ends before the next one."""
    stage, going = "", False
    starts = [i for i, x in enumerate(lines) if re.match(r"(?i)\s*from\s+\S", x)]
    for i, line in enumerate(lines):
        s, first = line.strip(), not going
        going = s.endswith("\\") and not s.startswith("#")
        m = re.match(r"(\w+)\s+(.*?)\s*\\?$", s) if first and not s.startswith("#") else None
        if not m:
            continue
        word, rest = m[1].upper(), m[2]
        if word == "FROM":
            named = re.match(r"(?i)(?:--\S+\s+)*(\S+)(?:\s+as\s+(\S+))?", rest)
            stage = named[2] or named[1]
            later = [x for x in starts if x > i]
            yield "module", stage, i, (later[0] if later else len(lines)) - 1, ""
        elif word in ("ARG", "ENV"):
            yield "variable", re.match(r"[\w.-]*", rest)[0], i, i, stage
        elif word in ("EXPOSE", "LABEL", "WORKDIR", "USER", "VOLUME"):
            yield "property", f"{word} {re.split(r'[=\s]', rest)[0]}", i, i, stage
        elif word in ("ENTRYPOINT", "CMD", "HEALTHCHECK"):
            yield "function", word, i, i, stage


def css_rules(lines: list[str]) -> Iterator[Symbol]:
    """Rules and at-rules of depth 0; variables at any depth."""
    depth, comment, head = 0, False, ""
    for i, line in enumerate(lines):
        s = line
        if comment:
            if "*/" not in s:
                continue
            s, comment = s[s.index("*/") + 2 :], False
        s = re.sub(r"/\*.*?\*/", "", s)
        if "/*" in s:
            s, comment = s[: s.index("/*")], True
        t = _blank(s).strip()
        if m := re.match(r"(--[\w-]+|\$[\w-]+|@(?!media|supports|layer|import|charset|use|include|extend|mixin|function|keyframes|font-face|page)[\w-]+)\s*:", t):
            yield "variable", m[1], i, i, ""
        elif depth == 0 and t:
            if m := re.match(r"@(?:media|supports|layer|container)\s+([^{;]+?)\s*(?:\{|$)", t):
                yield "module", m[1], i, _brace_end(lines, i), ""
            elif m := re.match(r"@(?:mixin|function|keyframes|-webkit-keyframes)\s+([\w-]+)", t):
                yield "function", m[1], i, _brace_end(lines, i), ""
            elif m := re.match(r"(%[\w-]+|@font-face)\s*\{", t):
                yield "type", m[1], i, _brace_end(lines, i), ""
            elif "{" in t and not t.startswith("@"):
                yield "class", (head + " " + t[: t.index("{")]).strip(), i, _brace_end(lines, i), ""
        head = (head + " " + t).strip() if depth == 0 and t.endswith(",") and "{" not in t else ""
        depth += t.count("{") - t.count("}")


def cypher_names(lines: list[str]) -> Iterator[Symbol]:
    """Labels and relationship types once a file; constraints, indexes, calls, parameters."""
    seen: set[tuple[str, str]] = set()
    for i, line in enumerate(lines):
        s = _blank(line, "//")
        found: list[tuple[int, str, str]] = []
        for kind, p in (("constant", r"(?i)\bcreate\s+(?:\w+\s+)*?(?:constraint|index)\s+(?!on\b|for\b|if\b)(\w+)"), ("function", r"(?i)\bcall\s+([\w.]+)"), ("variable", r":param\s+(\w+)|\$(\w+)")):
            found += [(m.start(), kind, next(g for g in m.groups() if g)) for m in re.finditer(p, s)]
        for m in re.finditer(r"\(\s*\w*\s*((?::\s*\w+\s*)+)", s):
            found += [(m.start(), "type", x) for x in re.findall(r"\w+", m[1])]
        for m in re.finditer(r"\[\s*\w*\s*:\s*(\w+(?:\s*\|\s*:?\s*\w+)*)", s):
            found += [(m.start(), "property", x) for x in re.findall(r"\w+", m[1])]
        for _, kind, name in sorted(found, key=lambda f: f[0]):
            if (kind, name) not in seen:
                seen.add((kind, name))
                yield kind, name, i, i, ""


def mermaid_parts(lines: list[str]) -> Iterator[Symbol]:
    """Diagrams, subgraphs, classes, participants and states; every node once a file, with
    its subgraph as parent."""
    seen: set[str] = set()
    inside: list[str] = []
    ends = {}
    open_ = []
    for i, line in enumerate(lines):
        if re.match(r"\s*subgraph\b", line):
            open_.append(i)
        elif re.match(r"\s*end\s*$", line) and open_:
            ends[open_.pop()] = i
    for i, line in enumerate(lines):
        s = line.split("%%")[0].strip()
        parent = inside[-1] if inside else ""
        if m := re.match(r"(graph|flowchart|sequenceDiagram|classDiagram|stateDiagram(?:-v2)?|erDiagram|gantt|pie|journey)\b", s):
            yield "module", m[1], i, len(lines) - 1, ""
        elif m := re.match(r"subgraph\s+([\w-]+|\"[^\"]+\")", s):
            name = m[1].strip('"')
            yield "struct", name, i, ends.get(i, len(lines) - 1), parent
            inside.append(name)
        elif s == "end" and inside:
            inside.pop()
        elif m := re.match(r"class\s+(\w+)", s):
            yield "class", m[1], i, i, parent
        elif m := re.match(r"(?:participant|actor)\s+(\w+)", s):
            yield "type", m[1], i, i, parent
        elif m := re.match(r"state\s+(?:\"[^\"]*\"\s+as\s+)?(\w+)", s):
            yield "property", m[1], i, i, parent
        else:
            for m in re.finditer(r"(?<![\w-])([A-Za-z]\w*)(?=\s*(?:\[|\(|\{|>))(?!\s*>>)", _QUOTED.sub('""', s)):
                if m[1] not in seen:
                    seen.add(m[1])
                    yield "function", m[1], i, i, parent


_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!][^>]*>|<(/?)([A-Za-z][\w:.-]*)((?:\s+[^\s=>/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?)*)\s*(/?)>", re.S)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _attribute(text: str, name: str) -> str:
    m = re.search(rf"(?<![\w:-]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", text)
    return next((g for g in m.groups() if g), "") if m else ""


def _elements(lines: list[str], kind_of, void: Iterable[str] = ()) -> Iterator[Symbol]:
    text = "\n".join(lines)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    line_of = lambda at: next_line(starts, at)
    out: list[list] = []
    stack: list[tuple[str, str, int]] = []  # tag, name, row
    for m in _TAG.finditer(text):
        tag = m[2]
        if not tag:
            continue
        at = line_of(m.start())
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    for _, _, row in stack[k:]:
                        if row >= 0:
                            out[row][3] = at
                    del stack[k:]
                    break
            continue
        closed = bool(m[4]) or tag.lower() in void
        own, extra = _attribute(m[3], "id"), _attribute(m[3], "name")
        name = f"{tag}#{own}" if own else f"{tag}[{extra}]" if extra else tag
        parent = next((n for _, n, row in reversed(stack) if row >= 0), "")
        for ns in re.findall(r"xmlns:([\w.-]+)\s*=", m[3]) if "xmlns:" in m[3] else ():
            out.append(["import", ns, at, at, ""])
        row = -1
        if kind := kind_of(tag, name, len(stack), closed):
            row = len(out)
            out.append([kind, name, at, line_of(m.end() - 1), parent])
        if not closed:
            stack.append((tag, name, row))
    yield from (tuple(r) for r in out)


def next_line(starts: list[int], at: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, at) - 1


def xml_elements(lines: list[str]) -> Iterator[Symbol]:
    """The root is a class, elements below it structs, those that close themselves properties,
    namespaces imports."""
    return _elements(lines, lambda tag, name, depth, closed: "property" if closed and depth else "struct" if depth else "class")


_PAGE = frozenset("html head body main template header footer nav".split())
_BOXES = frozenset("div section article aside form table dialog ul".split())
_SHEETS = frozenset("script style svg".split())
_FIELDS = frozenset("input meta link select textarea button".split())


def html_elements(lines: list[str]) -> Iterator[Symbol]:
    """Page parts are modules, boxes with an id classes, scripts and styles structs, named
    fields properties."""

    def kind(tag: str, name: str, depth: int, closed: bool) -> str | None:
        low = tag.lower()
        if low in _PAGE:
            return "module"
        if low in _SHEETS:
            return "struct"
        if low in _FIELDS:
            return "property" if name != tag else None
        return "class" if "#" in name or low in _BOXES and name != tag else None

    return _elements(lines, kind, _VOID)


def cobol_parts(lines: list[str]) -> Iterator[Symbol]:
    """Programs, divisions, sections, paragraphs and data items, in fixed or free format.

    A file is in fixed format if most of its first ten lines begin with four digits or more
    in columns 1 to 6; then column 7 is the indicator and 65 bytes from column 8 are code.
    """
    first = [x for x in lines if x.strip()][:10]
    fixed = bool(first) and sum(sum(c.isdigit() for c in x[:6]) >= 4 for x in first) * 2 > len(first)
    division, program = "", ""
    code = []
    for line in lines:
        mark, body = (line[6:7], line[7:72]) if fixed else (line.lstrip()[:1], line)
        code.append("" if mark in ("*", "/") or body.lstrip().startswith("*>") else body)
    heads = [i for i, s in enumerate(code) if re.match(r"(?i)\s*[\w-]+\s+division\b", s)]
    for i, s in enumerate(code):
        t = s.strip()
        if m := re.match(r"(?i)program-id\.?\s+([\w-]+)", t):
            program = m[1]
            yield "class", program, i, len(lines) - 1, ""
        elif m := re.match(r"(?i)([\w-]+)\s+division\b", t):
            division = m[1].lower()
            later = [h for h in heads if h > i]
            yield "module", f"{m[1]} DIVISION", i, (later[0] if later else len(lines)) - 1, program
        elif m := re.match(r"(?i)([\w-]+)\s+section\s*\.", t):
            yield "module", m[1], i, i, program
        elif m := re.match(r"(?i)copy\s+[\"']?([\w-]+)", t):
            yield "import", m[1], i, i, ""
        elif division == "data" and (m := re.match(r"(\d{1,2})\s+([\w-]+)", t)):
            level = int(m[1])
            yield "type" if level == 1 else "constant" if level in (78, 88) else "variable", m[2], i, i, ""
        elif division == "procedure" and (m := re.match(r"([A-Za-z0-9][\w-]*)\s*\.\s*$", t)) and len(s) - len(s.lstrip()) < 4 and not m[1].lower().startswith("end-"):
            yield "function", m[1], i, i, program


#: The formats and their extractors.
FORMATS = {
    "json": json_keys, "yaml": yaml_keys, "toml": toml_keys, "hcl": hcl_blocks, "dockerfile": docker_steps, "css": css_rules,
    "cypher": cypher_names, "mermaid": mermaid_parts, "xml": xml_elements, "html": html_elements, "cobol": cobol_parts,
}
