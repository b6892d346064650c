"""Facts of Python files: a parser lists what stands in a file, Column expressions say what it means.

The parser knows no rule. It gives one row per file with the statements, definitions and calls of its syntax tree in order:
what each is called, the source of its parts, and in which definition it stands. Symbols, models, routes, settings, entry
points and behaviours are filters and look-ups over that list, in the file's row, so nothing is shuffled.
"""

from __future__ import annotations

import ast
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .declared_facts import FACT

# Recognised names.
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "options", "head")
MODEL_BASES = {"BaseModel": "pydantic", "BaseSettings": "settings", "Base": "sqlalchemy", "Model": "orm", "TypedDict": "typed_dict"}
SIDE_EFFECTS = ("add", "commit", "delete", "execute", "flush", "publish", "remove", "save", "send", "update", "write", "write_text", "write_bytes")
ROUTER_MAKERS, APPLICATION_MAKERS, COLUMN_MAKERS = r"(?:APIRouter|Blueprint)$", r"(?:FastAPI|Flask)$", r"(?:Column|mapped_column)$"
ENVIRONMENT_READERS, ENVIRONMENT = ("os.getenv", "os.environ.get"), "os.environ"

PART = "struct<role:string,kind:string,name:string,text:string,literal:string>"
NODE = f"struct<id:int,parent:int,kind:string,name:string,text:string,scope:string,owner:string,outermost:boolean,raises:boolean,line:int,end_line:int,parts:array<{PART}>>"
_PART = pa.struct([(n, pa.string()) for n in ("role", "kind", "name", "text", "literal")])
_NODE = pa.struct([
    ("id", pa.int32()), ("parent", pa.int32()), *[(n, pa.string()) for n in ("kind", "name", "text", "scope", "owner")],
    ("outermost", pa.bool_()), ("raises", pa.bool_()), ("line", pa.int32()), ("end_line", pa.int32()), ("parts", pa.list_(_PART)),
])

DEFINITIONS = {ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef}
ASSIGNMENTS = {ast.Assign, ast.AnnAssign}
#: Which children of a node are shown as its parts, by the name the tree has for them.
SHOWN = {"names": "alias", "decorator_list": "decorator", "bases": "base", "targets": "target", "target": "target", "value": "value", "annotation": "annotation", "keywords": "keyword", "args": "argument", "slice": "argument"}


#: Expressions that need no parentheses wherever they stand, and constants whose source is their ``repr``.
PLAIN, LITERALS = (ast.Name, ast.Attribute, ast.Call), (str, bytes, bool, int, type(None))
OPERATORS = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Is: "is", ast.IsNot: "is not", ast.In: "in", ast.NotIn: "not in"}


def _is_literal(node: ast.AST) -> bool:
    return type(node) is ast.Constant and node.kind is None and type(node.value) in LITERALS


def _text(node: ast.AST) -> str:
    """What ``ast.unparse`` gives; names, literals, calls, comparisons and plain parameter lists are put together here, which is much faster."""
    kind = type(node)
    if kind is ast.Name:
        return node.id
    if kind is ast.Attribute and type(node.value) in PLAIN:
        return f"{_text(node.value)}.{node.attr}"
    if kind is ast.Call and type(node.func) in PLAIN:
        return _call(_text(node.func), node)
    if _is_literal(node):
        return repr(node.value)
    if kind is ast.Compare and all(type(x) in PLAIN or _is_literal(x) for x in (node.left, *node.comparators)):
        return " ".join([_text(node.left), *[f"{OPERATORS[type(o)]} {_text(x)}" for o, x in zip(node.ops, node.comparators)]])
    if kind is ast.arguments and not (node.posonlyargs or node.vararg or node.kwonlyargs or node.kwarg or node.defaults or any(x.annotation for x in node.args)):
        return ", ".join([x.arg for x in node.args])
    return ast.unparse(node)


def _call(name: str, node: ast.Call) -> str:
    given = [_text(x) for x in node.args] + [f"{x.arg}={_text(x.value)}" if x.arg else f"**{_text(x.value)}" for x in node.keywords]
    return f"{name}({', '.join(given)})"


def _called(node: ast.AST) -> str:
    """The dotted name of an expression; of a call, that of what is called."""
    return _text(node.func if type(node) is ast.Call else node)


def _literal(node: ast.AST) -> str | None:
    return node.value if type(node) is ast.Constant and isinstance(node.value, str) else None


def _part(role: str, node: ast.AST) -> tuple:
    """(role, kind, name, text, literal)"""
    kind = type(node)
    if kind is ast.Name:
        return role, "Name", node.id, node.id, None
    if kind is ast.alias:
        return role, "alias", node.name, node.asname or node.name, None
    if kind is ast.keyword:
        return role, "keyword", node.arg, None, _literal(node.value)
    name = _called(node)
    if kind is not ast.Call:
        return role, kind.__name__, name, name, _literal(node)
    text = _call(name, node) if type(node.func) in PLAIN else _text(node)
    return role, "Call", name, text, _literal(node.args[0] if node.args else node)


def _parts(node: ast.AST, kind: type, fields: list[tuple[str, str]], roles: frozenset[str]) -> list[tuple]:
    out = []
    for field, role in fields:
        held = getattr(node, field)
        if type(held) is list:
            for x in held:
                out.append(_part(role, x))
        elif held is not None and type(held) is not ast.arguments:
            out.append(_part(role, held))
    if kind in ASSIGNMENTS and type(node.value) is ast.Call:  # what the assigned call is given
        if "keyword" in roles:
            out += [_part("keyword", x) for x in node.value.keywords]
        if "argument" in roles:
            out += [_part("argument", x) for x in node.value.args[:1]]
    return out


#: Kinds of nodes that are listed, and the part of each that its ``text`` shows.
LISTED = {
    ast.Import: None, ast.ImportFrom: None, ast.ClassDef: None, ast.FunctionDef: "args", ast.AsyncFunctionDef: "args", ast.Call: None, ast.Subscript: None,
    ast.If: "test", ast.Raise: "exc", ast.Assign: None, ast.AnnAssign: None, ast.AugAssign: None,
}
PARTS = {kind: [] if kind in (ast.If, ast.Raise) else [(f, r) for f, r in SHOWN.items() if f in kind._fields] for kind in LISTED}
#: Nodes below which nothing is listed, and fields that lead to none; the others of a node, last first.
LEAVES = {ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, *LITERALS}
PLACELESS = {"ctx", "op", "ops", "names", "id", "attr", "name", "asname", "module", "level", "arg", "kind", "type_comment", "simple", "conversion", "is_async"}
BELOW = {kind: [f for f in reversed(kind._fields) if f not in PLACELESS] for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST) and ast.Constant not in kind.__bases__}
NODE_FIELDS, PART_FIELDS = [f.name for f in _NODE], [f.name for f in _PART]


def _raises(node: ast.AST) -> bool:
    """Whether a ``raise`` stands anywhere below; it is a statement, so only lists of statements are walked."""
    wait = [node]
    while wait:
        node = wait.pop()
        if type(node) is ast.Raise:
            return True
        for field in ("body", "orelse", "handlers", "finalbody", "cases"):
            held = getattr(node, field, None)
            if type(held) is list:
                wait += held
    return False


#: Nodes and roles of parts that the rules of a kind of facts read.
READ = {
    "import": ((ast.Import, ast.ImportFrom), ("alias",)), "symbol": ((*DEFINITIONS,), ("base",)), "call": ((ast.Call,), ()), "side_effect": ((ast.Call,), ()),
    "state_change": ((*ASSIGNMENTS, ast.AugAssign), ("target",)), "condition": ((ast.If,), ()), "exception": ((ast.Raise,), ()),
    "route": ((ast.FunctionDef, ast.AsyncFunctionDef, *ASSIGNMENTS), ("decorator", "target", "value", "keyword")),
    "entry_point": ((ast.If, *ASSIGNMENTS), ("target", "value", "keyword")),
    "config": ((ast.Call, ast.Subscript, ast.ClassDef, *ASSIGNMENTS), (*SHOWN.values(),)),
    "model": ((ast.ClassDef, *ASSIGNMENTS), (*SHOWN.values(),)), "field": ((ast.ClassDef, *ASSIGNMENTS), (*SHOWN.values(),)),
}
#: Fields that hold statements, or handlers and cases with statements.
STATEMENTS = ("body", "orelse", "handlers", "finalbody", "cases")


class Listing:
    """What is listed of a syntax tree: everything, or what the rules of some ``kinds`` of facts read.

    Expressions are looked through only where calls or subscripts are listed; the other nodes are statements.
    """

    def __init__(self, kinds: tuple[str, ...] | None = None) -> None:
        asked = [*READ.values()] if kinds is None else [READ[k] for k in kinds if k in READ]
        nodes = {n for some, _ in asked for n in some}
        self.roles = frozenset(r for _, some in asked for r in some)
        self.listed = {n: shown for n, shown in LISTED.items() if n in nodes}
        self.parts = {n: [(f, r) for f, r in PARTS[n] if r in self.roles] for n in self.listed}
        whole = ast.Call in nodes or ast.Subscript in nodes
        self.below = BELOW if whole else {n: [f for f in fields if f in STATEMENTS] for n, fields in BELOW.items()}


def syntax_nodes(text: str, listing: Listing = Listing()) -> list[tuple]:  # noqa: B008
    """The listed nodes of a file in the order of the tree, each with the values of ``NODE_FIELDS``."""
    out: list[tuple] = []
    listed, parts, below, roles = listing.listed, listing.parts, listing.below, listing.roles
    # node, and where it stands: id of the node it is a statement of, names of the definitions around it, function in whose own body it stands, at the top
    top = (None, "", None, True)
    wait: list[tuple] = [(x, top) for x in reversed(ast.parse(text).body)]
    while wait:
        node, place = wait.pop()
        parent, scope, owner, outermost = place
        kind = type(node)
        number = len(out)
        if kind in listed:
            said, raises = "0", False
            if kind is ast.Call:
                name = _text(node.func)
            elif kind is ast.Subscript:
                name = _called(node.value)
            elif kind is ast.ImportFrom:
                name, said = node.module, str(node.level or 0)
            else:
                name, shown = getattr(node, "name", None), listed[kind] and getattr(node, listed[kind])
                said = "0" if shown is None else _text(shown)
                raises = kind is ast.If and _raises(node)
            out.append((number, parent, kind.__name__, name or None, said, scope, owner, outermost, raises, node.lineno, node.end_lineno, _parts(node, kind, parts[kind], roles)))
        fields = below[kind]
        if not fields:
            continue
        if kind in DEFINITIONS:
            around = f"{scope}.{node.name}" if scope else node.name
            body, inside = (number if kind in listed else -1, around, None if kind is ast.ClassDef else around, False), (None, around, None, False)
        elif outermost or parent is not None or kind is ast.Lambda:
            body = inside = (None, scope, None if kind is ast.Lambda else owner, False)
        else:
            body = inside = place
        for field in fields:
            held = getattr(node, field)
            at = body if field == "body" else inside
            if type(held) is list:
                for x in reversed(held):
                    if type(x) not in LEAVES:
                        wait.append((x, at))
            else:
                while type(held) is ast.Attribute:  # names of names hold nothing else
                    held = held.value
                if type(held) not in LEAVES:
                    wait.append((held, at))
    return out


#: Files whose nodes are held at once, and characters of them after which no other is added.
FILES, CHARACTERS = 256, 1 << 20


def _lists(rows: list[list | None], fields: list[str], kinds: pa.StructType, parts: pa.Array | None = None) -> pa.Array:
    """Lists of structs from lists of tuples, column by column; ``parts`` is the last column where it is made already."""
    ends = np.cumsum([0, *[len(x or ()) for x in rows]])
    flat = list(zip(*(x for held in rows for x in held or ()))) or [()] * len(fields)
    made = [parts if parts is not None and f == fields[-1] else pa.array(v, kinds.field(f).type) for f, v in zip(fields, flat)]
    none = pa.array([x is None for x in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(made, fields=list(kinds)), mask=none)


def _listed(texts: list[str], listing: Listing = Listing()) -> list[pa.Array]:  # noqa: B008
    """``nodes``, ``problem`` and ``message`` of some files."""
    nodes, problems, messages = [], [], []
    for text in texts:
        found, problem, message = None, None, None
        try:
            found = syntax_nodes(text, listing)
        except (SyntaxError, ValueError, RecursionError) as wrong:
            problem, message = type(wrong).__name__, str(wrong)
        nodes.append(found)
        problems.append(problem)
        messages.append(message)
    parts = _lists([x[-1] for held in nodes for x in held or ()], PART_FIELDS, _PART)
    return [_lists(nodes, NODE_FIELDS, _NODE, parts), pa.array(problems, pa.string()), pa.array(messages, pa.string())]


def _pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch that are bounded in files and characters (one file at least), so that memory does not follow the batch."""
    begin, held = 0, 0
    for k, size in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
        held += size or 0
        if k + 1 - begin == FILES or held >= CHARACTERS:
            yield batch.slice(begin, k + 1 - begin)
            begin, held = k + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def parsed(files: DataFrame, keys: list[str], kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``keys``, ``nodes`` of each of ``files`` (those alone that facts of ``kinds`` are told by, if any are named), or ``problem`` and ``message`` of one that cannot be read."""
    schema = ", ".join(f"{k} string" for k in keys) + f", nodes array<{NODE}>, problem string, message string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listing = Listing(kinds)
        gc.disable()  # syntax trees hold no cycles, and a search for some among their nodes comes up every few files
        try:
            for batch in batches:
                for piece in _pieces(batch, len(keys)):
                    own = [piece.column(k).cast(pa.string()) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, *_listed(piece.column(len(keys)).to_pylist(), listing)], names=[*keys, "nodes", "problem", "message"])
        finally:
            gc.enable()

    return files.select(*keys, "text").mapInArrow(read, schema)


# ------------------------------------------------------------------ what the nodes mean


def _bind(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _fact(kind: str, owner, name, value, extra, at: Column) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(F.lit(kind).alias("kind"), *[text(x).alias(n) for n, x in zip(("owner", "name", "value", "extra"), (owner, name, value, extra))], at["line"].alias("line"), at["end_line"].alias("end_line")).cast(FACT)


def _of(node: Column, role: str) -> Column:
    """The parts of a node in one role."""
    return F.filter(node["parts"], lambda p: p["role"] == role)


def _first(array: Column) -> Column:
    return F.get(array, 0)


def _last_name(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", -1)


def _where(nodes: Column, kinds: tuple[str, ...], condition=None) -> Column:
    return F.filter(nodes, lambda n: n["kind"].isin(*kinds) & (F.lit(True) if condition is None else F.coalesce(condition(n), F.lit(False))))


ASSIGNED = ("Assign", "AnnAssign")


def _outermost_calls(nodes: Column) -> Column:
    """Outermost assignments of a call, which alone can make a router or an application."""
    return _where(nodes, ASSIGNED, lambda n: n["outermost"] & (_first(_of(n, "value"))["kind"] == "Call"))


def _made_by(assigned: Column, pattern: str) -> Column:
    """Outermost names bound to a call of a maker: ``name``, ``prefix``, ``maker`` and place, in order."""
    calls = F.filter(assigned, lambda n: F.coalesce(_first(_of(n, "value"))["name"].rlike(pattern), F.lit(False)))

    def bound(n: Column) -> Column:
        given = F.filter(_of(n, "keyword"), lambda p: p["name"].isin("prefix", "url_prefix"))
        prefix = F.coalesce(F.try_element_at(given, F.lit(-1))["literal"], F.lit(""))
        names = F.filter(_of(n, "target"), lambda p: p["kind"] == "Name")
        return F.transform(names, lambda p: F.struct(p["name"].alias("name"), prefix.alias("prefix"), _last_name(_first(_of(n, "value"))["name"]).alias("maker"), n["line"].alias("line"), n["end_line"].alias("end_line")))

    return F.flatten(F.transform(calls, bound))


def _model_kind(node: Column) -> Column:
    """What kind of model a class is, by its decorators or else its first base that makes one; null for other classes."""
    named = lambda name, known: (name == known) | F.endswith(name, F.lit("." + known))
    by_base = lambda p: F.coalesce(*[F.when(named(p["name"], b), F.lit(k)) for b, k in MODEL_BASES.items()])
    data = F.exists(_of(node, "decorator"), lambda p: named(p["name"], "dataclass"))
    return F.when(data, "dataclass").otherwise(_first(F.filter(F.transform(_of(node, "base"), by_base), lambda k: k.isNotNull())))


def _json(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", ""), F.lit("null"))


def _models(nodes: Column, own) -> Column:
    """Models with their fields, and the settings among them."""
    classes = F.transform(_where(nodes, ("ClassDef",)), lambda n: F.struct(n.alias("node"), own(n).alias("own"), _model_kind(n).alias("kind")))
    models = F.filter(classes, lambda c: c["kind"].isNotNull())

    def facts(c: Column) -> Column:
        within = _where(nodes, ASSIGNED, lambda n: n["parent"] == c["node"]["id"])
        target = lambda n: _first(_of(n, "target"))
        value = lambda n: _first(_of(n, "value"))
        typed = F.filter(within, lambda n: (n["kind"] == "AnnAssign") & (target(n)["kind"] == "Name"))
        plain = F.filter(within, lambda n: n["kind"] == "Assign")
        columns = F.filter(plain, lambda n: (value(n)["kind"] == "Call") & value(n)["name"].rlike(COLUMN_MAKERS))
        tables = F.filter(plain, lambda n: F.exists(_of(n, "target"), lambda p: p["name"] == "__tablename__"))
        required = lambda n: F.concat(F.lit("["), F.when(value(n).isNull(), "true").otherwise("false"), F.lit(", "), _json(value(n)["text"]), F.lit("]"))
        literal = lambda p: F.when(p["kind"] == "Constant", p["literal"])
        return F.concat(
            F.transform(typed, lambda n: _fact("field", c["own"], target(n)["name"], _first(_of(n, "annotation"))["text"], required(n), n)),
            F.when(c["kind"] == "settings", F.transform(typed, lambda n: _fact("config", c["own"], target(n)["name"], None, None, n))).otherwise(F.array().cast(f"array<{FACT}>")),
            F.flatten(F.transform(columns, lambda n: F.transform(F.filter(_of(n, "target"), lambda p: p["kind"] == "Name"), lambda p: _fact(
                "field", c["own"], p["name"], _first(_of(n, "argument"))["text"], F.concat(F.lit("[null, "), _json(value(n)["text"]), F.lit("]")), n)))),
            F.array(_fact("model", c["own"], c["node"]["name"], c["kind"], literal(_first(_of(F.try_element_at(tables, F.lit(-1)), "value"))), c["node"])),
        )

    return F.flatten(F.transform(models, facts))


def _routes(functions: Column, routers: Column, applications: Column, own) -> Column:
    """Functions decorated with a verb of a router or an application of the file."""

    def route(n: Column, p: Column) -> Column:
        holder = F.regexp_replace(p["name"], r"\.[^.]*$", "")
        known = F.try_element_at(F.filter(routers, lambda r: r["name"] == holder), F.lit(-1))["prefix"]
        prefix = F.coalesce(known, F.when(F.exists(applications, lambda a: a["name"] == holder), F.lit("")))
        return F.when(prefix.isNotNull(), _fact("route", own(n), F.upper(_last_name(p["name"])), F.nullif(F.concat(prefix, F.coalesce(p["literal"], F.lit(""))), F.lit("")), "python_web|high", n))

    verbs = lambda n: F.filter(_of(n, "decorator"), lambda p: (p["kind"] == "Call") & p["name"].contains(".") & F.lower(_last_name(p["name"])).isin(*HTTP_VERBS))
    return F.filter(F.flatten(F.transform(functions, lambda n: F.transform(verbs(n), lambda p: route(n, p)))), lambda f: f.isNotNull())


FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")


def _said(n: Column, path: Column, module: Column, own, wanted) -> Column:
    """Facts of the ``wanted`` kinds that one node tells by itself: imports, symbols, settings, and what a function does in its own body."""
    none = F.array().cast(f"array<{FACT}>")

    def of(**facts: Column) -> Column:
        held = [f for kind, f in facts.items() if wanted(kind)]
        return F.array_compact(F.array(*held)) if held else none

    when = lambda kind, facts: facts if wanted(kind) else none
    inside = n["owner"].isNotNull()
    who = F.concat_ws(".", module, n["owner"])
    name, argument = n["name"], _first(_of(n, "argument"))
    other = (name != "") & (name != _last_name(n["owner"])) & (name != who)
    config = lambda known: F.when(known & (argument["kind"] == "Constant") & (argument["literal"] != ""), _fact("config", name, argument["literal"], None, None, n))
    bases = F.array_join(F.transform(_of(n, "base"), lambda p: p["text"]), ", ")
    word = F.when(n["kind"] == "AsyncFunctionDef", "async def ").otherwise("def ")
    changed = F.filter(_of(n, "target"), lambda p: p["kind"].isin("Attribute", "Subscript"))
    main = n["text"].contains("__name__") & n["text"].contains("__main__")
    return (
        F.when(n["kind"] == "Call", of(
            call=F.when(inside & other, _fact("call", who, name, None, None, n)),
            side_effect=F.when(inside & _last_name(name).isin(*SIDE_EFFECTS), _fact("side_effect", who, name, None, None, n)),
            config=config(name.isin(*ENVIRONMENT_READERS))))
        .when(n["kind"].isin(*ASSIGNED, "AugAssign"), when("state_change", F.when(inside, F.transform(changed, lambda p: _fact("state_change", who, p["text"], n["kind"], None, n))).otherwise(none)))
        .when(n["kind"].isin(*FUNCTIONS), of(symbol=_fact("symbol", own(n), name, F.concat(word, name, F.lit("("), n["text"], F.lit(")")), F.when(n["scope"] == "", "function").otherwise("method"), n)))
        .when(n["kind"] == "Import", when("import", F.transform(_of(n, "alias"), lambda p: _fact("import", path, p["name"], p["text"], "0", n))))
        .when(n["kind"] == "ImportFrom", of(**{"import": _fact("import", path, F.coalesce(name, F.lit("")), F.array_join(F.transform(_of(n, "alias"), lambda p: p["name"]), ","), n["text"], n)}))
        .when(n["kind"] == "If", of(
            condition=F.when(inside, _fact("condition", who, n["text"], F.when(n["raises"], "validation"), None, n)),
            entry_point=F.when(main, _fact("entry_point", "executable", "__main__", "Python", None, n))))
        .when(n["kind"] == "Raise", of(exception=F.when(inside, _fact("exception", who, F.when(n["text"] == "0", "re-raise").otherwise(n["text"]), None, None, n))))
        .when(n["kind"] == "ClassDef", of(symbol=_fact("symbol", own(n), name, F.concat(F.lit("class "), name, F.lit("("), bases, F.lit(")")), "class", n)))
        .when(n["kind"] == "Subscript", of(config=config(name == ENVIRONMENT)))
        .otherwise(none)
    )


def module_of(path: Column) -> Column:
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")


def meaning(nodes: Column, path: Column, module: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Array of facts of one Python file from its nodes and the name of its module; most nodes are looked at once.

    Where ``kinds`` are named, rules that tell none of them are not asked; facts of other kinds may still come along.
    """
    wanted = lambda *some: kinds is None or any(k in kinds for k in some)
    own = lambda n: F.concat_ws(".", module, F.nullif(n["scope"], F.lit("")), n["name"])
    decorated = _where(nodes, FUNCTIONS, lambda n: F.exists(n["parts"], lambda p: p["role"] == "decorator"))

    def of_makers(x: Column) -> Column:
        entries = F.transform(x["applications"], lambda a: _fact("entry_point", "application", a["name"], a["maker"], None, a))
        return F.concat(entries, _routes(x["functions"], x["routers"], x["applications"], own))

    made = lambda c: F.struct(decorated.alias("functions"), _made_by(c, ROUTER_MAKERS).alias("routers"), _made_by(c, APPLICATION_MAKERS).alias("applications"))
    parts = [F.flatten(F.transform(nodes, lambda n: _said(n, path, module, own, wanted)))]
    if wanted("model", "field", "config"):
        parts.append(_models(nodes, own))
    if wanted("route", "entry_point"):
        parts.append(_bind(_outermost_calls(nodes), lambda c: _bind(made(c), of_makers)))
    return F.concat(*parts)


def python_facts(files: DataFrame, keys: list[str], kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Facts of all Python files: ``keys`` (with ``path``) and the fields of a fact; a file that cannot be read gives one ``failure``.

    With ``kinds`` only facts of these are given.
    """
    failure = F.array(F.struct(F.lit("failure").alias("kind"), F.col("path").alias("owner"), F.col("problem").alias("name"), F.col("message").alias("value"), F.lit(None).cast("string").alias("extra"), F.lit(1).alias("line"), F.lit(1).alias("end_line")).cast(FACT))
    facts = F.when(F.col("nodes").isNull(), failure).otherwise(meaning(F.col("nodes"), F.col("path"), F.col("_module"), kinds))
    out = parsed(files, keys, kinds).withColumn("_module", module_of(F.col("path"))).select(*keys, F.explode(facts).alias("_f")).select(*keys, "_f.*")
    return out if kinds is None else out.where(F.col("kind").isin(*kinds))
