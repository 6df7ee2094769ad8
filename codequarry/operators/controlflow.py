"""Control-flow graphs of functions, their paths, and inlined callees.

Five front-ends (braces, indentation, ``end`` keywords, shell, procedural SQL) read a
function into one statement tree; one builder turns the tree into blocks and edges.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators.languages import BY_NAME
from codequarry.operators.symbols import _STRINGS, plain

MAX_PATHS, INLINE_DEPTH = 64, 2


@dataclass
class Stmt:
    kind: str  # linear, if, loop, switch, return, break, continue
    line: int
    text: str = ""
    cond: str = ""
    body: list = field(default_factory=list)
    other: list = field(default_factory=list)
    cases: list = field(default_factory=list)  # (label, is default, line, body)
    post: bool = False  # the body runs before the test


_IF = re.compile(r"^(?:\}\s*)?(?:if|unless|elif|elsif|elseif|else\s*if)\b\s*(.*)$", re.I | re.S)
_ELSE = re.compile(r"^(?:\}\s*)?else\b", re.I)
_ELIF = re.compile(r"^(?:\}\s*)?(?:elif|elsif|elseif|else\s+if)\b", re.I)
_LOOP = re.compile(r"^(?:'?\w+'?\s*:\s*)?(?:for|foreach|while|until|loop|repeat)\b\s*(.*)$", re.I | re.S)
_SWITCH = re.compile(r"^(?:switch|match|select|case|when)\b\s*(.*)$", re.I | re.S)
_RETURN = re.compile(r"^(?:return|panic|throw|raise|exit|die|abort|os\.Exit|sys\.exit|process\.exit|System\.exit|signal)\b", re.I)
_BREAK = re.compile(r"^(?:break|last|leave)\b", re.I)
_CONTINUE = re.compile(r"^(?:continue|next|iterate)\b", re.I)


def _leaf(text: str, line: int) -> Stmt:
    t = text.strip().rstrip(";").strip()
    if _RETURN.match(t):
        return Stmt("return", line, t)
    if _BREAK.match(t):
        return Stmt("break", line, t)
    if _CONTINUE.match(t):
        return Stmt("continue", line, t)
    return Stmt("linear", line, t)


def _cond(text: str) -> str:
    t = re.sub(r"\s*(?:\{|:|\bthen\b|\bdo\b|\bloop\b)\s*$", "", text.strip(), flags=re.I).strip().rstrip(";").strip()
    return t[1:-1].strip() if t.startswith("(") and t.endswith(")") and _closes(t) else t


def _closes(t: str) -> bool:
    depth = 0
    for i, c in enumerate(t):
        depth += (c == "(") - (c == ")")
        if not depth:
            return i == len(t) - 1
    return False


# A front-end gives nodes: (line, text, children or None).


def _brace_nodes(src: list[tuple[int, str]]) -> list:
    stack: list[list] = [[]]
    heads: list[tuple[int, str]] = []
    text, start, paren = "", None, 0

    def flush():
        nonlocal text, start
        if text.strip():
            stack[-1].append((start, text.strip(), None))
        text, start = "", None

    for no, line in src:
        for k, ch in enumerate(line):
            if start is None and not ch.isspace():
                start = no
            paren += (ch in "([") - (ch in ")]")
            if ch == "{" and paren <= 0:
                heads.append((start or no, text.strip()))
                stack.append([])
                text, start = "", None
            elif ch == "}" and paren <= 0 and len(stack) > 1:
                flush()
                body = stack.pop()
                at, head = heads.pop()
                stack[-1].append((at, head, body))
                start = None
            elif ch == ";" and paren <= 0 and not (re.match(r"\s*(?:else\s+)?(?:for|if|switch)\b", text) and "{" in line[k:]):
                flush()
            else:
                text += ch
        if paren <= 0 and not re.search(r"(?:[+\-*/|&=.(]|\|\|)\s*$", text):
            flush()
        elif text:
            text += " "
    flush()
    while len(stack) > 1:
        body = stack.pop()
        at, head = heads.pop()
        stack[-1].append((at, head, body))
    return stack[0]


def _indent_nodes(src: list[tuple[int, str]]) -> list:
    rows = [(no, len(t) - len(t.lstrip()), t.strip()) for no, t in src if t.strip()]

    def read(i: int, depth: int) -> tuple[list, int]:
        out = []
        while i < len(rows):
            no, d, t = rows[i]
            if d < depth:
                break
            if t.endswith(":") and i + 1 < len(rows) and rows[i + 1][1] > d:
                body, i = read(i + 1, rows[i + 1][1])
                out.append((no, t[:-1].strip(), body))
                continue
            m = re.match(r"^((?:if|elif|else|for|while|try|except|finally|with)\b[^:]*):\s*(\S.*)$", t)
            out.append((no, m[1], [(no, m[2], None)]) if m else (no, t, None))
            i += 1
        return out, i

    return read(0, rows[0][1] if rows else 0)[0]


def _keyword_nodes(src: list[tuple[int, str]], opens: re.Pattern, middles: re.Pattern, closes: re.Pattern) -> list:
    stack: list[list] = [[]]
    heads: list[tuple[int, str]] = []

    def shut():
        body = stack.pop()
        at, head = heads.pop()
        stack[-1].append((at, head, body))

    for no, line in src:
        for t in filter(None, (x.strip() for x in re.split(r";(?!;)(?=\s|$)", line))):
            if closes.match(t):
                if len(stack) > 1:
                    if stack and heads and middles.match(heads[-1][1]) and heads[-1][1].startswith("\x00"):
                        shut()
                    shut()
                    while heads and heads[-1][1].startswith("\x00"):
                        shut()
            elif middles.match(t) and len(stack) > 1:
                if heads[-1][1].startswith("\x00"):
                    shut()
                heads.append((no, "\x00" + t))
                stack.append([])
            elif opens.match(t):
                heads.append((no, t))
                stack.append([])
            else:
                stack[-1].append((no, t, None))
    while len(stack) > 1:
        shut()
    return stack[0]


_RUBY = (re.compile(r"^(?:if|unless|case|while|until|for|begin|def|loop)\b(?!.*\bend\b)|.*\bdo\b(?:\s*\|[^|]*\|)?\s*$"), re.compile(r"^\x00?(?:elsif|else|when|rescue|ensure|in)\b"), re.compile(r"^end\b"))
_SHELL = (re.compile(r"^(?:if|for|while|until|case|select)\b"), re.compile(r"^\x00?(?:elif|else)\b|^\x00?[^()\s]+\)(?:\s|$)"), re.compile(r"^(?:fi|done|esac)\b"))
_SQLKW = (re.compile(r"^(?:if\b.*\bthen|while\b|for\b.*\bloop|loop\b|case\b|repeat\b|begin\b|<<\w+>>\s*loop)", re.I), re.compile(r"^\x00?(?:elsif|elseif|else|when|exception)\b", re.I), re.compile(r"^(?:end\b|until\b)", re.I))


def _statements(nodes: list, style: str) -> list[Stmt]:
    """Nodes to statements: chains of if/elif/else, loops, switches, plain blocks."""
    out: list[Stmt] = []
    tail: Stmt | None = None  # the if that an else belongs to
    i = 0
    while i < len(nodes):
        line, raw, children = nodes[i]
        text = raw.lstrip("\x00").strip()
        i += 1
        if children is None:
            m = re.match(r"^(?:if|unless)\b\s*(\(.*?\)|.+?)\s*\b((?:return|break|continue|throw|raise)\b.*)$", text)
            mod = re.match(r"^((?:return|raise|break|next)\b.*?)\s+(if|unless)\s+(.+)$", text)
            if style in ("brace",) and m and not _ELSE.match(text):
                tail = Stmt("if", line, text, _cond(m[1]), [_leaf(m[2], line)])
                out.append(tail)
                continue
            if style == "end" and mod:
                out.append(Stmt("if", line, text, ("!" if mod[2] == "unless" else "") + mod[3], [_leaf(mod[1], line)]))
                continue
            if out and out[-1].post and out[-1].cond == "" and re.match(r"^while\b", text):
                out[-1].cond = _cond(text[5:])
                continue
            if style == "shell" and text in ("then", "do", ";;"):
                continue
            text = re.sub(r"^(?:then|do)\s+", "", text) if style == "shell" else text
            s = _leaf(text, line)
            if s.kind == "linear" and out and out[-1].kind == "linear":
                out[-1].text += "\n" + s.text
            else:
                out.append(s)
            tail = None
            continue
        if _ELIF.match(text) and tail is not None:
            inner = Stmt("if", line, text, _cond(_IF.match(re.sub(r"^(?:\}\s*)?else\s+if", "if", text, flags=re.I))[1]), *_branches(children, style))
            tail.other = [inner]
            tail = inner
        elif _ELSE.match(text) and tail is not None:
            tail.other = _statements(children, style)
            tail = None
        elif (m := _IF.match(text)) and not _ELSE.match(text):
            tail = Stmt("if", line, text, _cond(m[1]), *_branches(children, style))
            out.append(tail)
            while tail.other and len(tail.other) == 1 and tail.other[0].kind == "if":
                tail = tail.other[0]
        elif re.match(r"^do\b", text) and style == "brace":
            out.append(Stmt("loop", line, text, "", _statements(children, style), post=True))
        elif m := _LOOP.match(text):
            out.append(Stmt("loop", line, text, _cond(m[1]) or "forever", _statements(children, style)))
        elif (m := _SWITCH.match(text)) and not text.startswith("\x00"):
            out.append(Stmt("switch", line, text, _cond(m[1]), cases=_cases(children, style)))
            tail = None
        else:
            if text and not re.match(r"^(?:try|finally|begin|unsafe|else)\b", text, re.I):
                out.append(Stmt("linear", line, text))
            out += _statements(children, style)
            tail = None
    return out


def _branches(children: list, style: str) -> tuple[list[Stmt], list[Stmt]]:
    """Then and else parts of a keyword block, whose elif and else stand inside it."""
    cut = next((k for k, (_, t, c) in enumerate(children) if c is not None and t.startswith("\x00") and (_ELSE.match(t[1:]) or _ELIF.match(t[1:]))), None)
    if cut is None:
        return _statements(children, style), []
    then, rest = _statements(children[:cut], style), []
    for line, t, c in reversed(children[cut:]):
        t = t.lstrip("\x00")
        if _ELIF.match(t):
            rest = [Stmt("if", line, t, _cond(_IF.match(t)[1]), _statements(c, style), rest)]
        else:
            rest = _statements(c or [], style)
    return then, rest


_CASE = re.compile(r"^\x00?(?:case|when|in)\b\s*(.*?)(?:\bthen\b|:(?!:)|->|=>|$)(.*)$|^\x00?(default|else)\b\s*:?(.*)$|^\x00?([^()\s]+)\)(.*)$", re.I | re.S)


def _cases(children: list, style: str) -> list:
    out: list = []
    for line, raw, body in children:
        t = raw.lstrip("\x00").strip()
        arm = re.match(r"^(.*?)\s*=>\s*(.*)$", t, re.S) if style == "brace" and not re.match(r"^(?:case|default)\b", t) else None
        m = None if arm else _CASE.match(raw)
        if arm:
            label = arm[1].strip()
            inner = _statements(body, style) if body is not None else [_leaf(arm[2].rstrip(","), line)] if arm[2].strip(" ,") else []
            out.append((label, label == "_", line, inner))
        elif m:
            label = (m[1] or m[5] or "default").strip()
            rest = (m[2] or m[4] or m[6] or "").strip()
            default = m[3] is not None or label in ("*", "_")
            out.append((label, default, line, [_leaf(rest, line)] if rest and rest != ";;" else []))
            if body is not None:
                out[-1][3].extend(_statements(body, style))
        elif out:
            out[-1][3].extend(_statements([(line, raw, body)], style))
    return out


def parse_function(source: str, language: str, start_line: int = 1) -> list[Stmt] | None:
    """Statement tree of a function's text; None for a language without control flow."""
    lang = BY_NAME.get(language)
    if lang is None or lang.style == "unsupported":
        return None
    literals: list[str] = []

    def mask(line: str) -> str:
        """Strings become numbered marks, so that nothing in them looks like code."""
        out, at = "", 0
        for m in _STRINGS.finditer(line):
            if any(c in line[at : m.start()] for c in lang.comments):
                break
            out += line[at : m.start()] + f"\ue000{len(literals)}\ue001"
            literals.append(m[0])
            at = m.end()
        return plain(out + line[at:], lang.comments)

    src = [(start_line + k, mask(x.rstrip("\r"))) for k, x in enumerate(source.split("\n"))]
    src = [(n, t) for n, t in src if t.strip()]
    if lang.style == "brace":
        nodes = _brace_nodes(src)
        held = next((c for _, _, c in nodes if c is not None), None)
        nodes = held if held is not None else nodes
    elif lang.style == "indent":
        nodes = _indent_nodes(src)
        nodes = nodes[0][2] if len(nodes) >= 1 and nodes[0][2] is not None and re.match(r"(?:async\s+)?def\b", nodes[0][1]) else nodes
    elif lang.style == "end":
        nodes = _keyword_nodes(src, *_RUBY)
        nodes = nodes[0][2] if nodes and nodes[0][2] is not None and nodes[0][1].startswith("def") else nodes
    elif lang.style == "shell":
        inner = src[1:-1] if len(src) > 1 and "{" in src[0][1] and src[-1][1].strip() == "}" else src
        nodes = _keyword_nodes([(n, re.sub(r"\b(then|do)\s*$", "", t)) for n, t in inner], *_SHELL)
    else:
        nodes = _keyword_nodes(src, *_SQLKW)
    stmts = _statements(nodes, lang.style)
    _restore(stmts, lambda t: re.sub("\ue000(\\d+)\ue001", lambda m: literals[int(m[1])], t))
    return stmts


def _restore(stmts: list[Stmt], back) -> None:
    for s in stmts:
        s.text, s.cond = back(s.text), back(s.cond)
        s.cases = [(back(label), default, line, body) for label, default, line, body in s.cases]
        for part in (s.body, s.other, *(c[3] for c in s.cases)):
            _restore(part, back)


class Graph:
    """Blocks (id, kind, label, lines, cond) and edges (src, dst, label, back)."""

    def __init__(self, name: str):
        self.blocks: list[dict] = []
        self.edges: list[dict] = []
        self.notes: list[str] = []
        self.waiting: dict[int, str] = {}
        self.entry = self.block("entry", f"entry: {name}")
        self.exit = self.block("exit", "exit")

    def block(self, kind: str, label: str, line: int | None = None, cond: str = "", code: str = "") -> int:
        lines = [] if line is None else list(range(line, line + 1 + code.count("\n")))
        self.blocks.append({"id": len(self.blocks), "kind": kind, "label": label[:60], "lines": lines, "cond": cond, "code": code})
        return len(self.blocks) - 1

    def edge(self, src: int, dst: int, label: str = "", back: bool = False) -> None:
        label = self.waiting.pop(src, label) if not label else label
        self.edges.append({"src": src, "dst": dst, "label": label, "back": back})

    def build(self, stmts: list[Stmt], front: list[int], stop: int | None, again: int | None) -> list[int]:
        for s in stmts:
            if not front and s.kind in ("break", "continue"):
                continue
            front = self._one(s, front, stop, again)
        return front

    def _enter(self, front: list[int], to: int) -> None:
        for f in front:
            self.edge(f, to)

    def _one(self, s: Stmt, front: list[int], stop: int | None, again: int | None) -> list[int]:
        if s.kind == "linear":
            b = self.block("linear", s.text.split("\n")[0], s.line, code=s.text)
            self._enter(front, b)
            return [b]
        if s.kind in ("return", "break", "continue"):
            b = self.block(s.kind, s.text, s.line, code=s.text)
            self._enter(front, b)
            to = {"return": self.exit, "break": stop, "continue": again}[s.kind]
            if to is None:
                self.notes.append(f"stray {s.kind}")
                to = self.exit
            self.edge(b, to, back=s.kind == "continue" and to == again)
            return []
        if s.kind == "if":
            b = self.block("branch", f"if {s.cond}", s.line, s.cond or "if", s.text)
            self._enter(front, b)
            self.waiting[b] = "true"
            out = self.build(s.body, [b], stop, again)
            if b in out:  # an empty branch
                out.remove(b)
                m = self.block("merge", "empty branch")
                self.edge(b, m, "true")
                out.append(m)
            self.waiting[b] = "false"
            rest = self.build(s.other, [b], stop, again)
            return out + rest
        if s.kind == "loop":
            head = self.block("loop", f"loop {s.cond}", s.line, s.cond or "loop", s.text)
            done = self.block("merge", "loop exit")
            if s.post:
                first = len(self.blocks)
                for f in self.build(s.body, front, done, head):
                    self.edge(f, head)
                if len(self.blocks) > first:
                    self.edge(head, first, "true", True)
            else:
                self._enter(front, head)
                self.waiting[head] = "true"
                for f in self.build(s.body, [head], done, head):
                    if f != head:
                        self.edge(f, head, back=True)
            self.waiting.pop(head, None)
            self.edge(head, done, "false")
            return [done]
        b = self.block("switch", f"switch {s.cond}", s.line, s.cond or "switch", s.text)
        self._enter(front, b)
        done = self.block("merge", "switch exit")
        for label, default, line, body in s.cases:
            c = self.block("linear", label, line, code=label)
            self.edge(b, c, "default" if default else label)
            for f in self.build(body, [c], done, again):
                self.edge(f, done)
        if not any(c[1] for c in s.cases):
            self.edge(b, done, "no match")
        return [done]

    def paths(self, most: int = MAX_PATHS) -> list[tuple[list[int], list[str]]]:
        """(blocks, decisions) of simple entry-exit paths in edge order, back edges left out."""
        after: dict[int, list[dict]] = {}
        for e in self.edges:
            if not e["back"]:
                after.setdefault(e["src"], []).append(e)
        out, work = [], [([self.entry], [])]
        while work:
            blocks, taken = work.pop()
            if blocks[-1] == self.exit:
                if len(out) == most:
                    self.notes.append(f"paths truncated at {most}")
                    break
                out.append((blocks, self._decisions(blocks, taken)))
                continue
            work += [([*blocks, e["dst"]], [*taken, e]) for e in reversed(after.get(blocks[-1], ())) if e["dst"] not in blocks]
        return out

    def _decisions(self, blocks: list[int], taken: list[dict]) -> list[str]:
        out = []
        for e in taken:
            b = self.blocks[e["src"]]
            if not e["label"] or not b["cond"]:
                continue
            if b["kind"] == "branch":
                out.append(f"if {b['cond']} = {e['label']}")
            elif b["kind"] == "loop":
                out.append(f"loop {b['cond']}: " + ("0 iterations (skip)" if e["label"] == "false" else "at least 1 iteration"))
            elif b["kind"] == "switch":
                out.append(f"switch {b['cond']} = {e['label']}")
        last = self.blocks[blocks[-2]] if len(blocks) > 1 else None
        return [*out, last["label"]] if last and last["kind"] == "return" else out

    def mermaid(self) -> str:
        esc = lambda t: re.sub(r'[&"<>{}\[\]()|#]', lambda m: f"#{ord(m[0])};", t)
        rows = ["flowchart TD"]
        shape = {"branch": ("{", "}"), "loop": ("{{", "}}"), "switch": ("{", "}"), "entry": ("([", "])"), "exit": ("([", "])")}
        for b in self.blocks:
            a, z = shape.get(b["kind"], ("[", "]"))
            rows.append(f'    B{b["id"]}{a}"{esc(b["label"])}"{z}')
        for e in self.edges:
            arrow = "-.->" if e["back"] else "-->"
            rows.append(f"    B{e['src']} {arrow}" + (f'|"{esc(e["label"])}"| ' if e["label"] else " ") + f"B{e['dst']}")
        return "\n".join(rows)


def graph_text(g: Graph) -> str:
    """Blocks with their edges, then the paths with their decisions."""
    rows = [f"B{b['id']} [{b['kind']}] {b['label']}" + "".join(f"\n    -> B{e['dst']}" + (f" ({e['label']})" if e["label"] else "") + (" back" if e["back"] else "") for e in g.edges if e["src"] == b["id"]) for b in g.blocks]
    rows += [f"path {k}: " + " > ".join(f"B{b}" for b in blocks) + (f" | {'; '.join(d)}" if d else "") for k, (blocks, d) in enumerate(g.paths(), 1)]
    return "\n".join([*rows, *(f"note: {n}" for n in dict.fromkeys(g.notes))])


def graph_json(g: Graph) -> str:
    return json.dumps({"blocks": [{k: v for k, v in b.items() if k != "code"} for b in g.blocks], "edges": g.edges, "entry_id": g.entry, "exit_id": g.exit, "notes": g.notes})


def build_graph(name: str, source: str, language: str, start_line: int = 1) -> Graph | None:
    stmts = parse_function(source, language, start_line)
    if stmts is None:
        return None
    g = Graph(name)
    for f in g.build(stmts, [g.entry], None, None):
        g.edge(f, g.exit)
    return g


def _called(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<![A-Za-z0-9_.])([A-Za-z_]\w*)\s*\(", text)))


def inline(g: Graph, name: str, bodies: dict[str, list[tuple[str, str, int]]], depth: int = INLINE_DEPTH, active: tuple[str, ...] = ()) -> Graph:
    """Splice the graphs of called functions into their call blocks, every callee of a block in
    the order of its calls. ``bodies`` maps a name to its definitions (source, language,
    line); only a sole definition is inlined, several leave a note, none is external.
    Calls are looked for in a block's code, else in its label. Recursion stops at names
    in work."""
    active = (*active, name)
    for b in list(g.blocks):
        if depth <= 0 or b["kind"] in ("entry", "exit", "merge"):
            continue
        at, calls = b["id"], _called(b["code"]) or _called(b["label"])  # what follows leaves from ``at``
        for callee in calls:
            defs = bodies.get(callee, [])
            if callee in active or not defs:
                continue
            if len(defs) > 1:
                g.notes.append(f"{callee} is ambiguous")
                continue
            sub = build_graph(callee, *defs[0])
            if sub is None:
                continue
            inline(sub, callee, bodies, depth - 1, active)
            shift = len(g.blocks)
            g.blocks += [{**x, "id": x["id"] + shift, "kind": "linear" if x["kind"] in ("entry", "exit") else x["kind"], "label": f"{callee}: {x['label']}"[:60]} for x in sub.blocks]
            g.notes += sub.notes
            out = sub.exit + shift
            decides = b["kind"] in ("branch", "loop", "switch")
            for e in g.edges:
                if e["src"] == at and (decides or not e["back"]):
                    e["src"] = out
            if decides:  # the decision is taken where the call comes back
                g.blocks[out].update(kind=b["kind"], cond=b["cond"])
                b.update(kind="linear", cond="")
                b = g.blocks[out]
            g.edges += [{**e, "src": e["src"] + shift, "dst": e["dst"] + shift} for e in sub.edges]
            g.edges.append({"src": at, "dst": sub.entry + shift, "label": f"call {callee}", "back": False})
            at = out
    return g


_BLOCKS = "id string, function string, part string, seq int, kind string, label string, cond string, lines array<int>, src int, dst int, back boolean, blocks array<int>, decisions array<string>"


def graph_table(functions: DataFrame, id_col: str, name_col: str, language_col: str, source_col: str, line_col: str, max_paths: int = MAX_PATHS) -> DataFrame:
    """Rows of ``part`` block, edge and path for every function. Languages without
    control flow, and null texts, give no row."""
    t = {"seq": pa.int32(), "lines": pa.list_(pa.int32()), "src": pa.int32(), "dst": pa.int32(), "back": pa.bool_(), "blocks": pa.list_(pa.int32()), "decisions": pa.list_(pa.string())}
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for key, name, language, source, line in zip(*(c.to_pylist() for c in batch.columns)):
                g = build_graph(name or "", source, language or "", line or 1)
                if g is None:
                    continue
                head = {"id": key, "function": name}
                paths = g.paths(max_paths)
                rows += [{**head, "part": "block", "seq": b["id"], **{k: b[k] for k in ("kind", "label", "cond", "lines")}} for b in g.blocks]
                rows += [{**head, "part": "edge", "seq": k, **e} for k, e in enumerate(g.edges)]
                rows += [{**head, "part": "path", "seq": k, "blocks": b, "decisions": d} for k, (b, d) in enumerate(paths)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t.get(n, pa.string())) for n in names], names=names)

    src = functions.select(F.col(id_col).cast("string").alias("id"), F.col(name_col).cast("string").alias("name"), F.col(language_col).alias("language"), F.col(source_col).cast("string").alias("source"), F.col(line_col).cast("int").alias("line"))
    return src.where("id is not null and source is not null").mapInArrow(run, _BLOCKS)
