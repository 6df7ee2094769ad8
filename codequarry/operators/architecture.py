"""Package roll-ups, import graph, entry points and call trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions.scalars import basename, directory, line_count
from codequarry.operators.languages import LANGUAGES
from codequarry.operators.symbols import language_of
from codequarry.session import cut


def packages(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """``(dir, files, n_files, n_lines)`` per folder, files in name order."""
    f = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).dropDuplicates(["path"])
    return f.groupBy(directory(F.col("path")).alias("dir")).agg(F.sort_array(F.collect_set(basename(F.col("path")))).alias("files"), F.count("*").alias("n_files"), F.sum(line_count(F.col("text"))).alias("n_lines"))


def kinds_per_package(symbols: DataFrame) -> DataFrame:
    k = F.col("narrow_kind")
    return symbols.groupBy(directory(F.col("path")).alias("dir")).agg(
        F.count_if(k.isin("function", "method")).alias("functions"), F.count_if(k == "type").alias("types"), F.count_if(k == "interface").alias("interfaces")
    )


#: Import statements outside blocks, from each language's grammar; group 1 is the target.
IMPORT_STATEMENTS = {
    "go": (r"^\s*import\s+(?:[\w.]+\s+)?[\"`]([^\"`]+)",),
    "python": (r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+([\w.]+)"),
    "javascript": (r"^\s*(?:import|export)\b[^'\"]*\bfrom\s*['\"]([^'\"]+)", r"^\s*import\s*['\"]([^'\"]+)", r"\brequire\(\s*['\"]([^'\"]+)"),
    "java": (r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;",),
    "kotlin": (r"^\s*import\s+([\w.]+)",),
    "rust": (r"^\s*(?:pub\s+)?use\s+([\w:]+)",),
    "c": (r"^\s*#\s*include\s*[<\"]([^>\"]+)",),
    "ruby": (r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)",),
    "php": (r"^\s*use\s+([\w\\\\]+)\s*[;,]",),
}
_SAME_IMPORTS = {"typescript": "javascript", "python2": "python", "cpp": "c", "groovy": "java"}


def import_target(text: Column, language: Column) -> Column:
    """Target of an import statement that stands on one line; null for other lines."""
    out = F.lit(None).cast("string")
    for name, patterns in {**IMPORT_STATEMENTS, **{k: IMPORT_STATEMENTS[v] for k, v in _SAME_IMPORTS.items()}}.items():
        hits = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]
        out = F.when(language == name, F.coalesce(*hits)).otherwise(out)
    return out


def block_imports(lines: DataFrame) -> DataFrame:
    """``(path, line, target)`` of quoted paths inside Go's ``import ( ... )`` blocks. A line
    is inside where more blocks were opened than closed before it."""
    go = lines.where(F.col("path").endswith(".go"))
    opens, closes = F.col("text").rlike(r"^\s*import\s*\(\s*(?://.*)?$"), F.col("text").rlike(r"^\s*\)")
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(before)
    inside = go.withColumn("_in", F.coalesce(state, F.lit(False))).where("_in")
    return inside.select("path", "line", F.nullif(F.regexp_extract("text", r"^\s*(?:[\w.]+\s+)?[\"`]([^\"`]+)[\"`]\s*(?://.*)?$", 1), F.lit("")).alias("target")).where("target is not null")


def last_segments(path: Column, n: int) -> Column:
    """The last ``n`` parts of an imported path, whatever separates them."""
    parts = F.split(path, r"[/.\\\\]|::")
    return F.concat_ws("/", F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n))


def import_edges(lines: DataFrame, segments: int = 2) -> DataFrame:
    """Distinct ``(from_pkg, to_pkg)`` without self edges; a target is the last
    ``segments`` parts of the imported path. Go's import blocks are followed line by line."""
    single = lines.select("path", import_target(F.col("text"), language_of(F.col("path"))).alias("target")).where("target is not null")
    hit = single.union(block_imports(lines).select("path", "target"))
    return hit.select(directory(F.col("path")).alias("from_pkg"), last_segments(F.col("target"), segments).alias("to_pkg")).where("from_pkg != to_pkg").distinct()


def module_path(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """``(module)`` of each ``go.mod``: the path its module line declares."""
    return files.where(basename(F.col(path_col)) == "go.mod").select(F.nullif(F.regexp_extract(text_col, r"(?m)^module\s+(\S+)", 1), F.lit("")).alias("module")).where("module is not null")


#: Package statements from each language's grammar; group 1 is the name.
PACKAGE_STATEMENTS = {"go": r"package\s+(\w+)", "java": r"package\s+([\w.]+)", "kotlin": r"package\s+([\w.]+)", "rust": r"(?:pub\s+)?mod\s+(\w+)", "csharp": r"namespace\s+([\w.]+)", "php": r"namespace\s+([\w\\\\]+)", "ruby": r"module\s+(\w+)", "perl": r"package\s+([\w:]+)", "groovy": r"package\s+([\w.]+)"}


def package_name(path: Column, text: Column, head: int = 1024) -> Column:
    """The package a file says it belongs to within its first ``head`` bytes, else the name
    of its folder."""
    said = F.lit(None).cast("string")
    start, language = F.substring(text, 1, head), language_of(path)
    for name, p in PACKAGE_STATEMENTS.items():
        said = F.when(language == name, F.nullif(F.regexp_extract(start, rf"(?m)^\s*{p}", 1), F.lit(""))).otherwise(said)
    return F.coalesce(said, basename(directory(path)))


def package_report(packages: DataFrame) -> DataFrame:
    """``(dir, text)``: one line of figures for every package ``(dir, n_files, n_lines,
    functions, types, interfaces)``."""
    some = lambda c, word: F.when(F.col(c) > 0, F.concat(F.lit(", "), F.col(c).cast("string"), F.lit(f" {word}"))).otherwise("")
    head = F.concat("dir", F.lit(": "), F.col("n_files").cast("string"), F.lit(" files, "), F.col("n_lines").cast("string"), F.lit(" lines"))
    return packages.select("dir", F.concat(head, some("functions", "functions"), some("types", "types"), some("interfaces", "interfaces")).alias("text"))


def report_symbols(symbols: DataFrame, most_functions: int = 30) -> DataFrame:
    """``(dir, position, name, kind)`` as a report lists them: the first functions of a package
    in file order, then all types, then all interfaces."""
    rank = F.when(F.col("kind").isin("function", "method"), 0).when(F.col("narrow_kind") == "type", 1).when(F.col("narrow_kind") == "interface", 2)
    s = symbols.select(directory(F.col("path")).alias("dir"), rank.alias("_k"), "path", "ordinal", "name", "kind").where("_k is not null")
    order = ["path", "ordinal"]
    s = s.withColumn("_n", F.row_number().over(Window.partitionBy("dir", "_k").orderBy(*order))).where((F.col("_k") > 0) | (F.col("_n") <= most_functions))
    return s.withColumn("position", F.row_number().over(Window.partitionBy("dir").orderBy("_k", *order))).select("dir", "position", "name", "kind")


def is_internal_import(target: Column, module: str) -> Column:
    """An import of the project itself: below its module, an internal folder, or relative."""
    return target.startswith(module) & F.lit(bool(module)) | target.contains("/internal/") | target.startswith("./")


def is_comment_line(text: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.ltrim(text).startswith(p)
    return out


def large_packages(packages: DataFrame, least: int) -> DataFrame:
    """Packages of at least ``least`` files, without the root folder."""
    return packages.where((F.col("n_files") >= least) & (F.col("dir") != "."))


def _kind_order() -> Column:
    return F.expr("case kind when 'main' then 0 when 'command' then 1 when 'handler' then 2 else 3 end")


def order_entry_points(entries: DataFrame) -> DataFrame:
    """Main, commands, handlers, init; by name within each."""
    return entries.orderBy(_kind_order(), "name", "path")


_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
_EACH_VERB = "|".join(f"{v}|{v.upper()}|{v.capitalize()}" for v in _VERBS)
#: A call that ties a quoted path to a handler, as the routers' documentation writes it:
#: the calls' names, and the expression that takes the handler out of what follows the path.
ROUTES = {
    "server": ("Handle|HandleFunc|Method|Mount|Route", r"^[,\s]*(?:[\w$]+\.)*([A-Za-z_$][\w$]*)\s*\)"),
    "verb": (_EACH_VERB + "|all|any|Any|use", r"(?:^|[,\s.])([A-Za-z_$][\w$]*)\s*\)\s*;?\s*$"),
    "view": ("path|re_path|url", r"^\s*,\s*(?:\w+\.)*(\w+)(?:\.as_view\(\))?\s*[,)]"),
    "action": (_EACH_VERB + "|match|root", r"[\w/]#(\w+)"),
    "controller": (_EACH_VERB + "|any|match", r"(?:@|::class\s*,\s*['\"])(\w+)['\"]"),
}
_ROUTE_CALL = r"(?:^|[^\w$])({names})\s*\(?\s*(?:r|b)?(['\"])[^'\"]*\2(.*)$"
#: Marks above a method that make it a handler, by framework.
MARKS = {
    "spring": "@(?:" + "|".join([*(v.capitalize() for v in _VERBS[:5]), "Request"]) + r")Mapping\b",
    "jax-rs": "@(?:" + "|".join(v.upper() for v in _VERBS) + r")\b",
    "aspnet": r"\[(?:Http(?:" + "|".join(v.capitalize() for v in _VERBS) + r")\b|Route\()",
    "decorator": r"@\w+\.(?:route|" + "|".join(_VERBS) + r")\(",
    "nest": "@(?:" + "|".join(v.capitalize() for v in _VERBS) + r")\(",
    "struts": r"@Action\b",
}
#: Base classes of frameworks, and the methods these call.
FRAMEWORKS = {
    "servlet": ("HttpServlet", "doGet doPost doPut doDelete doPatch service init"),
    "struts": ("ActionSupport Action BaseAction", "execute doExecute input validate"),
    "aspnet": ("Controller ControllerBase ApiController", "Index Create Edit Delete Details Update"),
    "django": ("View APIView TemplateView ListView DetailView CreateView UpdateView DeleteView FormView", "get post put patch delete dispatch get_queryset get_context_data form_valid"),
}
#: What a file must hold for its entry function to count, by language.
GUARDS = {"go": r"^package\s+main\b", "python": r"^if\s+__name__\s*==", "python2": r"^if\s+__name__\s*==", "java": r"\bstatic\s+(?:final\s+)?void\s+main\s*\(", "csharp": r"\bstatic\b.*\bMain\s*\("}


def route_handlers(lines: DataFrame) -> DataFrame:
    """``(name)`` of every handler that a route registration names, once."""
    hits = []
    for names, handler in ROUTES.values():
        tail = F.regexp_extract("text", _ROUTE_CALL.format(names=names), 3)
        hits.append(F.regexp_extract(tail, handler, 1))
    return lines.select(F.explode(F.array(*hits)).alias("name")).where("name != ''").distinct()


def marked_handlers(functions: DataFrame, lines: DataFrame, reach: int = 5) -> DataFrame:
    """``(name, path, line, label)``: the first function within ``reach`` lines below a mark,
    unless another mark stands between; the label is the mark."""
    marks = lines.where(F.col("text").rlike("|".join(MARKS.values()))).select("path", F.col("line").alias("mark"), F.trim("text").alias("label"))
    nearest = F.least(F.col("mark") + reach, F.coalesce(F.lead("mark").over(Window.partitionBy("path").orderBy("mark")), F.lit(2147483647)))
    marks = marks.withColumn("last", nearest)
    near = functions.select("name", "path", F.col("start_line").alias("line")).join(marks, "path").where("line > mark and line <= last")
    first = F.row_number().over(Window.partitionBy("path", "mark").orderBy("line"))
    return near.withColumn("_r", first).where("_r = 1").select("name", "path", "line", "label")


def guarded(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Entry functions whose file holds what their language asks for; ``init`` needs nothing."""
    holds = F.lit(False)
    for name, p in GUARDS.items():
        holds = holds | ((F.col("_l") == name) & F.col("text").rlike(p))
    said = lines.withColumn("_l", language_of(F.col("path"))).where(holds).select("path").distinct()
    free = entries.where(~F.col("language").isin(*GUARDS) | (F.col("name") == "init"))
    return free.unionByName(entries.where(F.col("language").isin(*GUARDS) & (F.col("name") != "init")).join(said, "path", "left_semi"))


def command_handlers(lines: DataFrame, window: int = 20) -> DataFrame:
    """``(name, label)`` of functions that a command definition runs; the label is the first
    word of the nearest ``Use`` in the lines before, else the name. The hit that stands
    first speaks for a name."""
    at = Window.partitionBy("path").orderBy("line").rangeBetween(-window, 0)
    use = F.nullif(F.regexp_extract("text", r"\bUse:\s*\"([^\"\s]+)", 1), F.lit(""))
    run = F.regexp_extract("text", r"\bRunE?\s*:\s*(?:\w+\.)?(\w+)", 1)
    marks = lines.select("path", "line", use.alias("_own"), run.alias("name")).where("_own is not null or name != ''")
    said = marks.withColumn("_use", F.last("_own", ignorenulls=True).over(at)).where("name != '' and name != 'func'")
    return said.groupBy("name").agg(F.min_by(F.coalesce("_use", "name"), F.struct("path", "line")).alias("label"))


def entry_points(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """``(name, path, line, kind, label)``: language entry functions, command handlers,
    route and marked handlers, framework methods; one row per name and file, main
    before command before handler before init. The symbols are read several times, so
    they are written once first; lines are read several times too."""
    symbols = cut(symbols)
    funcs = symbols.where(F.col("kind").isin("function", "method"))
    at = ["name", "path", F.col("start_line").alias("line")]
    entry = F.lit(False)
    for x in LANGUAGES:
        if x.entries:
            entry = entry | ((F.col("language") == x.name) & F.col("name").isin(list(x.entries)))
    main = guarded(symbols.where((F.col("kind") == "function") & entry), lines)
    main = main.select(*at, F.when(F.col("name") == "init", "init").otherwise("main").alias("kind"), F.when(F.col("name") == "init", directory(F.col("path"))).otherwise(F.col("name")).alias("label"))
    first = funcs.groupBy("name").agg(F.min(F.struct("path", "start_line")).alias("f")).select("name", F.col("f.path").alias("path"), F.col("f.start_line").alias("line"))
    commands = command_handlers(lines).join(first, "name").select("name", "path", "line", F.lit("command").alias("kind"), "label")
    handlers = first.join(route_handlers(lines), "name", "left_semi").select("name", "path", "line", F.lit("handler").alias("kind"), F.col("name").alias("label"))
    marked = marked_handlers(funcs, lines).select("name", "path", "line", F.lit("handler").alias("kind"), "label")
    out = main.unionByName(commands).unionByName(handlers).unionByName(marked)
    labels, called = [], F.lit(False)
    for label, (bases, methods) in FRAMEWORKS.items():
        base = rf"(?:\bextends|\bimplements|:|\()\s*(?:[\w.<>]+\s*,\s*)*(?:\w+\.)*(?:{bases.replace(' ', '|')})\b"
        labels.append(F.when(F.col("signature").rlike(base), label))
        called = called | ((F.col("label") == label) & F.col("name").isin(methods.split()))
    own = symbols.where(F.col("kind") == "class").select("path", F.col("name").alias("parent"), F.explode(F.array_compact(F.array(*labels))).alias("label")).distinct()
    out = out.unionByName(funcs.join(own, ["path", "parent"]).where(called).select(*at, F.lit("handler").alias("kind"), "label"))
    w = Window.partitionBy("name", "path").orderBy(_kind_order(), "line", "label")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def walk_tree(root: str, children: dict[str, list[str]], max_depth: int) -> list[tuple]:
    """(seq, parent_seq, depth, name, marker) in preorder: a name on the stack is a
    ``cycle``, one expanded before a ``ref``, one at the depth limit a ``cap`` (which
    does not count as expanded)."""
    out, seen, above = [], set(), set()
    work = [(root, 0, 0, False)]
    while work:
        name, parent, depth, leaving = work.pop()
        if leaving:
            above.discard(name)
            continue
        marker = "cycle" if name in above else "ref" if name in seen else "cap" if depth >= max_depth and children.get(name) else None
        out.append((len(out) + 1, parent, depth, name, marker))
        if marker:
            continue
        seen.add(name)
        above.add(name)
        me = len(out)
        work.append((name, 0, 0, True))
        work += [(c, me, depth + 1, False) for c in reversed(children.get(name, ()))]
    return out


def _levels(roots: DataFrame, edges: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(edges ``(root, name, child)`` each root can reach, nodes ``(root, name)`` reached
    within ``depth`` calls), gathered level by level: a level is one job."""
    e = edges.select(F.col("caller").alias("name"), F.col("callee").alias("child")).where("name is not null and child is not null and name != '' and child != ''").distinct()
    e = cut(e)
    front = seen = cut(roots.select("root").distinct().select("root", F.col("root").alias("name"), F.lit(0).alias("level")))
    for level in range(1, depth + 1):
        new = front.join(e, "name").select("root", F.col("child").alias("name")).distinct()
        front = cut(new.join(seen, ["root", "name"], "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    own = seen.where(F.col("level") < depth).join(e, "name").select("root", "name", "child")
    return own, seen.select("root", "name")


def reachable(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Distinct ``(root, name)`` within ``depth`` calls of each root, itself included."""
    return _levels(roots, edges, depth)[1]


def call_trees(roots: DataFrame, edges: DataFrame, max_depth: int = 8) -> DataFrame:
    """``(root, seq, parent_seq, depth, name, marker)`` for every root ``(root)``.

    The edges a root can reach within the depth are gathered level by level by joins,
    so a task holds one root's own edges, not the graph. Children come in name order.
    """
    own, seen = _levels(roots, edges, max_depth + 1)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        children: dict[str, list[str]] = {}
        for n, c in zip(pdf["name"], pdf["child"]):
            if c is not None:
                children.setdefault(n, []).append(c)
        for v in children.values():
            v.sort()
        root = pdf["root"].iloc[0]
        return pd.DataFrame([(root, *r) for r in walk_tree(root, children, max_depth)], columns=["root", "seq", "parent_seq", "depth", "name", "marker"])

    every = own.union(seen.where("root = name").select("root", "name", F.lit(None).cast("string")))
    return every.groupBy("root").applyInPandas(build, "root string, seq int, parent_seq int, depth int, name string, marker string")


def render_tree(tree: DataFrame) -> DataFrame:
    """One text line per node, indented, with its mark."""
    mark = F.when(F.col("marker") == "cycle", " (cycle)").when(F.col("marker") == "ref", " (↩)").when(F.col("marker") == "cap", " (...)").otherwise("")
    return tree.select("root", "seq", F.concat(F.expr("repeat('│   ', depth)"), F.lit("├── "), "name", mark).alias("text"))
