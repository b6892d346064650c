"""Facts of script and Java files as Column expressions: no Python code runs over the texts.

A text is numbered first: every line begins with its number and a tab. A pattern then finds a declaration
wherever it stands, and its first numbered line says where that is. Annotations belong to a declaration if only
lines that do not end a statement lie between; how many there are is no matter. No pattern repeats over lines:
texts are cut where statements end and before declarations, and a piece is held next to the one before it, so the
work grows with the length of a file and a long list of constants or comments needs no stack.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import col

FACT = "struct<kind:string,owner:string,name:string,value:string,extra:string,line:int,end_line:int>"

# File endings, names and marks that are recognised, and the lines that are shown of a fact.
SCRIPT_SUFFIXES = (".js", ".jsx", ".ts", ".tsx")
ROUTER_NAMES = "app|router|server|[A-Za-z_$][A-Za-z0-9_$]*[Rr]outer"
VERBS = "get|post|put|patch|delete|options|head"
ENTITY_MARKS = "@(?:Entity|Document|Embeddable)\\b"
SPANS = {"symbol": 12, "type": 15, "model": 20, "web_route": 5, "class_route": 8, "entry_point": 5, "main": 8}

NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
AT = r"(?m)^(\d+)\t\s*"
ENDED = r"(?<=[;{}])[ \t\r]*\n"  # the break after a line that ends a statement or opens or closes a body
SCRIPT_IMPORT = AT + r"import\s+([^;'\"]*?)\s+from\s+['\"]([^'\"]+)['\"]"
SCRIPT_REQUIRE = AT + r"(?:const|let|var)\s+(" + NAME + r"|\{[^}]*\})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)"
SCRIPT_LEAD = AT + r"(?:(?:export|default|async|declare|abstract)\s+){0,5}"
SCRIPT_FUNCTION = SCRIPT_LEAD + rf"function\s*\*?\s+({NAME})\s*\(([^)]*)\)"
SCRIPT_ARROW = SCRIPT_LEAD + rf"(?:const|let|var)\s+({NAME})\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>"
SCRIPT_TYPE = SCRIPT_LEAD + rf"(class|interface)\s+({NAME})"
SCRIPT_BODY = SCRIPT_LEAD + rf"interface\s+({NAME})[^{{]*\{{([^}}]*)\}}"
SCRIPT_MEMBER = rf"(?m)(?:^(?:\d+\t)?|[;,])\s*({NAME})(\?)?\s*:\s*([^;,\n]+)"
WEB_ROUTE = rf"(?m)^(\d+)\t(?:[^\n]*?[^A-Za-z0-9_$.\n])?(?:{ROUTER_NAMES})\.({VERBS})\s*\(\s*['\"]([^'\"]+)['\"]\s*(?:,\s*({NAME})?)?"
DECORATED = r"^\d+\t\s*(?:@.*)?$"
DECORATOR = r"^\d+\t\s*@(?:Get|Post|Put|Patch|Delete)\s*\("
STACKED = r"(?m)(" + DECORATOR + r"[^\n]*)\n(?=" + DECORATOR[1:] + ")"
CLASS_ROUTE = AT + rf"@(Get|Post|Put|Patch|Delete)\s*\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)[^\n]*\n\d+\t\s*(?:(?:public|private|protected|static|async)\s+){{0,5}}({NAME})\s*\("
ENVIRONMENT = r"(process\.env|import\.meta\.env)\.([A-Z][A-Z0-9_]+)"
SCRIPT_ENTRY = r"(createRoot|ReactDOM\.render|(?:app|server)\.listen)\s*\("

JAVA_MODIFIERS = r"(?:(?:public|protected|private|abstract|final|static|sealed|strictfp)\s+){0,8}"
JAVA_HEAD = rf"^(\d+)\t[ \t]*({JAVA_MODIFIERS}(class|interface|record|enum)\s+([A-Za-z0-9_]+)(?:\s+extends\s+[\w<>., ]+)?)"
JAVA_FIELD = r"(?m)^\d+\t[ \t]*(?:private|protected|public)\s+(?:(?:final|static|transient|volatile)\s+){0,6}([\w<>?,.\[\]]+)\s+([A-Za-z0-9_]+)\s*(?:=[^\n]*)?;"
JAVA_METHOD = r"^(\d+)\t[ \t]*(?:public|protected|private)\s+(?:(?:static|final|abstract|synchronized)\s+){0,6}([\w<>?,.\[\]]+)\s+([A-Za-z0-9_]+)\s*\(([^)]*)\)"
JAVA_MAPPING = r"@(Get|Post|Put|Patch|Delete|Request)Mapping\b\s*(?:\(\s*(?:\d+\t\s*)?(?:(?:value|path)\s*=\s*)?[\"']([^\"']*)[\"'])?"
JAVA_IMPORT = AT + r"import\s+(?:static\s+)?([\w.*]+)\s*;"
JAVA_SETTING = r"\$\{([A-Za-z0-9_.-]+)(?::[^}]*)?\}"


def numbered(text) -> Column:
    """``text`` with every line led by its number and a tab."""
    return F.array_join(F.transform(F.split(col(text), "\n", -1), lambda l, i: F.concat((i + 1).cast("string"), F.lit("\t"), l)), "\n")


def _found(text: Column, pattern: str, fact: Callable[[Callable[[int], Column]], Column]) -> Column:
    """``fact`` of every match; it is given a function from group number to that group's text (empty where it took no part)."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: fact(lambda g: F.regexp_extract(m, pattern, g)))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _declared(text: Column, pattern: str) -> Column:
    """Array of ``own`` and ``above``: each piece that begins with a declaration, and the open lines before it."""
    pieces = F.split(text, "(?m)(?=" + pattern + ")", -1)
    pairs = _bind(pieces, lambda p: F.zip_with(p, F.concat(F.array(F.lit("")), p), lambda own, before: F.struct(own.alias("own"), before.alias("before"))))
    found = F.filter(pairs, lambda x: x["own"].rlike(r"\A" + pattern[1:]))
    return F.transform(found, lambda x: F.struct(x["own"].alias("own"), F.element_at(F.split(x["before"], ENDED, -1), -1).alias("above")))


def _fact(kind: str, owner, name, value, extra, line: Column, span: int = 0) -> Column:
    at = line.cast("int")
    as_text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x.cast("string")
    named = zip(("owner", "name", "value", "extra"), (owner, name, value, extra))
    return F.struct(F.lit(kind).alias("kind"), *[as_text(x).alias(n) for n, x in named], at.alias("line"), (at + span).alias("end_line")).cast(FACT)


def _by_line(text: Column, pattern: str, fact: Callable) -> Column:
    """As :func:`_found`, for patterns without a place of their own, line by line; ``fact`` also gets the line number."""
    lines = F.filter(F.split(text, "\n", -1), lambda l: l.rlike(pattern))
    return F.flatten(F.transform(lines, lambda l: F.transform(F.regexp_extract_all(l, F.lit(pattern), F.lit(0)), lambda m: fact(lambda g: F.regexp_extract(m, pattern, g), F.regexp_extract(l, r"^(\d+)\t", 1)))))


def _url(*parts: Column) -> Column:
    """Parts of a path joined by single slashes."""
    clean = F.filter(F.array(*[F.trim(p, F.lit("/")) for p in parts]), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(clean, "/"))


def _or_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _plain(x: Column) -> Column:
    """A piece of numbered text without its numbers, on one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\n\d+\t", "\n"), r"\s+", " "))


def script_facts(text: Column, path: Column) -> Column:
    """Array of facts of one script (numbered text)."""
    module = F.replace(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit("/"), F.lit("."))
    own = lambda name: F.concat(module, F.lit("."), name)
    names = lambda x: F.array_join(F.regexp_extract_all(F.regexp_replace(x, r"(?m)^\d+\t", ""), F.lit(f"({NAME})"), F.lit(1)), ",")
    called = lambda g: _fact("symbol", own(g(2)), g(2), F.concat(g(2), F.lit("("), _plain(g(3)), F.lit(")")), "function", g(1), SPANS["symbol"])
    prefix = F.regexp_extract(text, r"@Controller\s*\(\s*['\"]([^'\"]*)['\"]", 1)
    # Decorators that route stand right above their method, those of one method on one line.
    routed = F.when(text.rlike("(?m)" + DECORATOR), F.filter(F.split(text, "\n", -1), lambda l: ~l.rlike(DECORATED) | l.rlike(DECORATOR)))
    routed = F.coalesce(F.regexp_replace(F.array_join(routed, "\n"), STACKED, "$1 "), F.lit(""))
    needed = lambda mark: F.when(mark == "", "[true, null]").otherwise("[false, null]")

    def members(g) -> Column:
        return F.transform(F.regexp_extract_all(g(3), F.lit(SCRIPT_MEMBER), F.lit(0)), lambda m: _fact("field", own(g(2)), F.regexp_extract(m, SCRIPT_MEMBER, 1), F.trim(F.regexp_extract(m, SCRIPT_MEMBER, 3)), needed(F.regexp_extract(m, SCRIPT_MEMBER, 2)), g(1)))

    return F.concat(
        _found(text, SCRIPT_IMPORT, lambda g: _fact("import", path, g(3), names(g(2)), "0", g(1))),
        _found(text, SCRIPT_REQUIRE, lambda g: _fact("import", path, g(3), "", "0", g(1))),
        _found(text, SCRIPT_FUNCTION, called),
        _found(text, SCRIPT_ARROW, called),
        _found(text, SCRIPT_TYPE, lambda g: _fact("symbol", own(g(3)), g(3), F.concat_ws(" ", g(2), g(3)), g(2), g(1), SPANS["symbol"])),
        _found(text, WEB_ROUTE, lambda g: _fact("route", _or_null(g(4)), F.upper(g(2)), g(3), "javascript_web|candidate", g(1), SPANS["web_route"])),
        _found(routed, CLASS_ROUTE, lambda g: _fact("route", own(g(4)), F.upper(g(2)), _url(prefix, g(3)), "nestjs|high", g(1), SPANS["class_route"])),
        F.flatten(_found(text, SCRIPT_BODY, members)),
        _found(text, SCRIPT_BODY, lambda g: _fact("model", own(g(2)), g(2), "typescript_interface", None, g(1), SPANS["model"])),
        _by_line(text, ENVIRONMENT, lambda g, line: _fact("config", g(1), g(2), None, None, line)),
        _by_line(text, SCRIPT_ENTRY, lambda g, line: _fact("entry_point", "application", g(1), "JavaScript", None, line, SPANS["entry_point"])),
    )


def java_facts(text: Column, path: Column) -> Column:
    """Array of facts of one Java file (numbered text). Methods and routes are the first type's; fields are their own type's."""
    return _bind(_declared(text, JAVA_HEAD), lambda types: _java_facts(text, path, types))


def _java_facts(text: Column, path: Column, types: Column) -> Column:
    folder = F.replace(F.regexp_replace(path, r"/?[^/]*$", ""), F.lit("/"), F.lit("."))
    package = F.coalesce(_or_null(F.regexp_extract(text, AT + r"package\s+([\w.]+)\s*;", 2)), folder)
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")
    first = F.get(types, 0)
    owner = F.coalesce(_or_null(F.regexp_extract(first["own"], JAVA_HEAD, 4)), stem)
    within = lambda *names: F.concat_ws(".", _or_null(package), *names)
    prefix = F.coalesce(F.regexp_extract(first["above"], r"@RequestMapping\s*\(\s*(?:\d+\t\s*)?(?:(?:value|path)\s*=\s*)?[\"']([^\"']*)[\"']", 1), F.lit(""))
    head = lambda t: lambda g: F.regexp_extract(t["own"], JAVA_HEAD, g)
    none = F.array().cast(f"array<{FACT}>")
    named = F.transform(types, lambda t: F.struct(t["own"].alias("own"), t["above"].alias("above"), *[head(t)(k).alias(n) for k, n in ((1, "line"), (2, "shown"), (3, "kind"), (4, "name"))]))
    models = F.filter(named, lambda t: (t["kind"] == "record") | t["above"].rlike(ENTITY_MARKS))

    def fields(t) -> Column:
        return F.transform(F.regexp_extract_all(t["own"], F.lit(JAVA_FIELD), F.lit(0)), lambda m: _fact("field", within(t["name"]), F.regexp_extract(m, JAVA_FIELD, 2), F.regexp_extract(m, JAVA_FIELD, 1), "[null, null]", t["line"]))

    def model(t) -> Column:
        return _fact("model", within(t["name"]), t["name"], F.when(t["above"].rlike(r"@Entity\b"), "java_entity").otherwise("java_record"), None, t["line"], SPANS["model"])

    def routes(m) -> Column:
        def route(found) -> Column:
            said = F.regexp_extract(m["above"], r"RequestMethod\.([A-Z]+)", 1)
            verb = F.when(F.regexp_extract(found, JAVA_MAPPING, 1) != "Request", F.upper(F.regexp_extract(found, JAVA_MAPPING, 1))).otherwise(F.coalesce(_or_null(said), F.lit("ANY")))
            line = F.regexp_extract(m["above"], r"(?m)^(\d+)\t[^\n]*@\w+Mapping", 1)
            return _fact("route", F.concat_ws(".", owner, F.regexp_extract(m["own"], JAVA_METHOD, 3)), verb, _url(prefix, F.regexp_extract(found, JAVA_MAPPING, 2)), "spring|high", line, SPANS["class_route"])

        return F.transform(F.regexp_extract_all(m["above"], F.lit(JAVA_MAPPING), F.lit(0)), route)

    def method(m) -> Column:
        g = lambda k: F.regexp_extract(m["own"], JAVA_METHOD, k)
        shown = F.concat(g(3), F.lit("("), _plain(g(4)), F.lit(")"))
        return _fact("symbol", within(owner, shown), g(3), F.concat_ws(" ", g(2), shown), "method", g(1), SPANS["symbol"])

    main = F.regexp_extract(text, r"(?m)^(\d+)\t[^\n]*public static void main", 1)
    return F.concat(
        _found(text, JAVA_IMPORT, lambda g: _fact("import", path, g(2), F.substring_index(g(2), ".", -1), "0", g(1))),
        F.transform(named, lambda t: _fact("symbol", within(t["name"]), t["name"], F.trim(t["shown"]), t["kind"], t["line"], SPANS["type"])),
        F.flatten(F.transform(models, fields)),
        F.transform(models, model),
        _bind(_declared(text, JAVA_METHOD), lambda methods: F.concat(F.transform(methods, method), F.flatten(F.transform(methods, routes)))),
        _by_line(text, JAVA_SETTING, lambda g, line: _fact("config", "Spring value", g(1), None, None, line)),
        F.when(main != "", F.array(_fact("entry_point", "executable", F.concat(owner, F.lit(".main")), "Java", None, main, SPANS["main"]))).otherwise(none),
    )


def declared_facts(files: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of all script and Java files: ``keys`` and the fields of a fact. The text is numbered once and read in its row."""
    ending = lambda *some: reduce(Column.__or__, [F.lower("path").endswith(x) for x in some])
    once = lambda build: F.element_at(F.transform(F.array(numbered("text")), lambda t: build(t, F.col("path"))), 1)
    facts = F.when(ending(".java"), once(java_facts)).otherwise(once(script_facts))
    return files.where(ending(*SCRIPT_SUFFIXES, ".java")).select(*keys, F.explode(facts).alias("_f")).select(*keys, "_f.*")
