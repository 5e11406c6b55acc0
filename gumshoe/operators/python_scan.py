"""Python files: syntax-tree facts, and the rules over them.

Reading the tree needs the standard ``ast`` module, so one ``mapInArrow`` pass
turns each file into arrays of plain facts. What the facts mean is decided by
Spark expressions afterwards. The grammar is that of the workers' interpreter:
run one Python version on all executors.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gumshoe.functions import patterns as P
from gumshoe.operators import lookups
from gumshoe.operators.catalogue import MESSAGE, filled

# Ship this module's functions with the tasks: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNT = "functions_found"

NODE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("names", T.ArrayType(T.StringType())),
    ]
)
NODE_FIELDS = [
    pa.field("kind", pa.string()),
    pa.field("name", pa.string()),
    pa.field("line", pa.int32()),
    pa.field("ord", pa.int32()),
    pa.field("pos", pa.int32()),
    pa.field("names", pa.list_(pa.string())),
]
FILE_FACTS = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("nodes", T.ArrayType(NODE)),
    ]
)


# Fields that hold no node of interest: names, contexts, operators and the like.
_NO_NODES = {"ctx", "op", "ops", "id", "attr", "name", "asname", "module", "level", "kind", "type_comment", "conversion", "names", "n", "s"}
_fields_of: dict[type, tuple[str, ...]] = {ast.Constant: (), ast.Name: ()}


def _tree(root: ast.AST) -> list[ast.AST]:
    """The nodes that may state facts, in the order of ``ast.walk``."""
    found = [root]
    for node in found:
        kind = type(node)
        fields = _fields_of.get(kind)
        if fields is None:
            fields = _fields_of[kind] = tuple(f for f in kind._fields if f not in _NO_NODES)
        for field in fields:
            value = getattr(node, field, None)
            if value.__class__ is list:
                found.extend([v for v in value if isinstance(v, ast.AST)])
            elif isinstance(value, ast.AST):
                found.append(value)
    return found


# What a node of a type states by itself: (kind, name, position, names).


def _function_facts(node: ast.FunctionDef) -> Iterator[tuple]:
    yield "function", node.name, None, [a.arg for a in node.args.args]
    inner = _tree(node)
    for child in inner:
        if type(child) is ast.Assign:
            for target in child.targets:
                if isinstance(target, ast.Name):
                    yield "local", target.id, None, None
    for child in inner:
        if type(child) is ast.Name and type(child.ctx) is ast.Load:
            yield "load", child.id, child.lineno, None


def _import_facts(node: ast.Import) -> Iterator[tuple]:
    for alias in node.names:
        yield "import", alias.name, None, [alias.asname or alias.name]


def _from_facts(node: ast.ImportFrom) -> Iterator[tuple]:
    bound = [alias.asname or alias.name for alias in node.names]
    if node.module:
        yield "import", node.module, None, [node.module.split(".")[0], *bound]
    else:
        yield "import_local", None, None, bound


def _for_facts(node: ast.For) -> Iterator[tuple]:
    yield "loop", "for", None, [node.target.id] if isinstance(node.target, ast.Name) else None


def _assign_facts(node: ast.Assign) -> Iterator[tuple]:
    for target in node.targets:
        if isinstance(target, ast.Name):
            yield "variable", target.id, None, None


def _operation_facts(node: ast.BinOp) -> Iterator[tuple]:
    if isinstance(node.op, (ast.Div, ast.FloorDiv, ast.Mod)):
        yield "division", None, None, None


def _handler_facts(node: ast.ExceptHandler) -> Iterator[tuple]:
    if node.type is None:
        yield "bare_except", None, None, None


def _subscript_facts(node: ast.Subscript) -> Iterator[tuple]:
    match node.slice:
        case ast.BinOp(op=ast.Add(), right=ast.Constant(value=int() as step)):
            name = node.value.id if isinstance(node.value, ast.Name) else ""
            yield "moved_index", name, None, [str(step) if step < 1 << 64 else hex(step)]


def _call_facts(node: ast.Call) -> Iterator[tuple]:
    name = ""
    match node.func:
        case ast.Name(id=name):
            yield "call", name, None, None
        case ast.Attribute(value=owner, attr=name):
            yield "call", name, None, None
            if name == "sqrt" and isinstance(owner, ast.Name) and owner.id == "math":
                yield "sqrt", None, None, None
    if name:
        for pos, arg in enumerate(node.args):
            if isinstance(arg, ast.Constant) and arg.value == 0:
                yield "zero_argument", name, pos, None


_FACTS = {
    ast.FunctionDef: _function_facts,
    ast.ClassDef: lambda node: [("class", node.name, None, None)],
    ast.Import: _import_facts,
    ast.ImportFrom: _from_facts,
    ast.For: _for_facts,
    ast.While: lambda node: [("loop", "while", None, None)],
    ast.If: lambda node: [("conditional", None, None, None)],
    ast.Assign: _assign_facts,
    ast.BinOp: _operation_facts,
    ast.ExceptHandler: _handler_facts,
    ast.Call: _call_facts,
    ast.Subscript: _subscript_facts,
}


def _file_nodes(content: str) -> list[tuple]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        line = getattr(error, "lineno", None) or 0
        return [("syntax_error", str(getattr(error, "msg", error)), line, 0, None, None)]
    nodes, loads = [], {}
    order = 0
    for node in _tree(tree):
        facts = _FACTS.get(type(node))
        for kind, name, extra, names in facts(node) if facts else ():
            order += 1
            if kind == "load":
                loads.setdefault((name, extra), order)
            else:
                nodes.append((kind, name, node.lineno, order, extra, names))
    # The last definition of a name decides which parameter an argument fills.
    params = {name: names for kind, name, _, _, _, names in nodes if kind == "function"}
    for i, (kind, name, line, o, pos, _) in enumerate(nodes):
        if kind == "zero_argument":
            nodes[i] = (kind, name, line, o, pos, params.get(name, [])[pos : pos + 1])
    nodes.extend(("load", name, line, o, None, None) for (name, line), o in loads.items())
    return nodes


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    warnings.simplefilter("ignore")  # the parser warns about odd but valid literals
    for batch in batches:
        offsets, nodes = [0], []
        for content in batch.column("content").to_pylist():
            nodes.extend(_file_nodes(content))
            offsets.append(len(nodes))
        columns = list(zip(*nodes)) or [()] * len(NODE_FIELDS)
        structs = pa.StructArray.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, NODE_FIELDS)], fields=NODE_FIELDS
        )
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
        yield pa.RecordBatch.from_arrays(
            [batch.column("file_id"), batch.column("language"), lists], ["file_id", "language", "nodes"]
        )


def parse_python(files: DataFrame) -> DataFrame:
    """One row per python file: ``(file_id, language, nodes)``."""
    python = files.filter((F.col("language") == "python") & F.col("content").isNotNull())
    return python.select("file_id", "language", "content").mapInArrow(_parse_batches, FILE_FACTS)


def python_facts(parsed: DataFrame) -> DataFrame:
    """The facts in long form, one row each."""
    return parsed.select("file_id", F.inline("nodes"))


def python_function_counts(parsed: DataFrame) -> DataFrame:
    """``(file_id, functions_found)`` for every file with a function; no shuffle."""
    counts = parsed.select("file_id", F.size(_of("function")).cast("bigint").alias("functions_found"))
    return counts.filter(F.col("functions_found") > 0)


def _of(*kinds: str) -> Column:
    return F.filter("nodes", lambda n: n["kind"].isin(*kinds))


def with_names(parsed: DataFrame) -> DataFrame:
    """Add ``functions`` and ``defined``, the pool of names known in the file.

    The pool is file-wide: function, class and imported names, plain
    parameters, names assigned inside functions and simple loop targets.
    """
    return parsed.withColumns(
        {
            "functions": _of("function"),
            "defined": F.array_distinct(
                F.concat(
                    F.transform(_of("function", "class", "local"), lambda n: n["name"]),
                    F.flatten(
                        F.transform(
                            F.filter(
                                "nodes",
                                lambda n: n["kind"].isin("function", "import", "import_local", "loop")
                                & n["names"].isNotNull(),
                            ),
                            lambda n: n["names"],
                        )
                    ),
                )
            ),
        }
    )


def python_defined_names(parsed: DataFrame) -> DataFrame:
    return with_names(parsed).select("file_id", F.explode("defined").alias("name"))


def python_risks(parsed: DataFrame, with_counts: bool = False) -> DataFrame:
    """The first risk of each type and line of every python file.

    Works on one file's arrays at a time: the loads are sorted together with the
    name pool (see ``lookups``) and repeats are dropped, all without a shuffle.
    ``with_counts`` adds one row per file of type ``COUNT`` whose ``ord`` is the
    number of functions, so that a caller who needs both parses each file once.
    """
    named = with_names(parsed)
    named = named.withColumn("loads", _of("load"))
    unknown = F.filter(F.array_except(F.col("loads.name"), F.col("defined")), lambda w: ~w.isin(P.PY_BUILTINS))
    named = named.withColumn("unknown", unknown)

    def uses(counts: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter("loads", counts), lambda n: lookups.use("any", n["name"], n["line"], n["ord"]))

    listed = F.size("unknown") <= lookups.FEW
    entries = F.when(  # without definitions all uses count
        listed, uses(lambda n: F.array_contains("unknown", n["name"]))
    ).otherwise(F.concat(lookups.definitions("any", F.col("defined")), uses(lambda n: ~n["name"].isin(P.PY_BUILTINS))))
    named = lookups.resolved(named.withColumn("entries", entries), "entries", ["any"], listed)
    none = F.lit(None).cast("string")

    def risk(n: Column, kind: str, late: int = 0, message: Column | None = None, **bound: Column) -> Column:
        text = F.lit(MESSAGE["py"].get(kind, "")) if message is None else message
        return F.struct(  # type, line and order first: risks are sorted by them below
            F.lit(kind).alias("type"),
            n["line"].alias("line"),
            (n["ord"].cast("long") + late * (1 << 40)).alias("ord"),
            filled(text, bound).alias("message"),
            *[bound.get(k, none).alias(k) for k in ("variable", "array", "function", "param")],
        )

    def moved_index(n: Column) -> Column:
        text = F.replace(F.lit(MESSAGE["py"]["out_of_bounds"]), F.lit("{step}"), n["names"][0])
        return risk(n, "out_of_bounds", message=text, variable=n["name"])

    zero = F.filter(
        F.transform(
            _of("zero_argument"), lambda n: risk(n, "zero_argument", function=n["name"], param=F.get(n["names"], F.lit(0)))
        ),
        lambda r: r["param"].isNotNull(),
    )
    undefined = F.transform(
        "entries",
        lambda e: risk(
            F.struct(e["line"].alias("line"), e["at"].alias("ord")), "undefined_variable", late=1, variable=e["name"]
        ),
    )
    found = F.concat(
        F.transform(_of("syntax_error"), lambda n: risk(n, "syntax_error", message=n["name"])),
        F.transform(_of("division"), lambda n: risk(n, "division")),
        F.transform(_of("bare_except"), lambda n: risk(n, "bare_except")),
        F.transform(_of("sqrt"), lambda n: risk(n, "negative_sqrt")),
        F.transform(_of("moved_index"), moved_index),
        zero,
        undefined,
    )
    if with_counts:
        count = F.struct(
            F.lit(COUNT).alias("type"),
            F.lit(0).alias("line"),
            F.size("functions").cast("long").alias("ord"),
            *[none.alias(c) for c in ("message", "variable", "array", "function", "param")],
        )
        found = F.concat(found, F.array(count))
    ordered = named.select("file_id", "language", F.sort_array(found).alias("found"))

    def is_first(r: Column, i: Column) -> Column:
        before = F.get("found", i - 1)
        return F.coalesce((before["type"] != r["type"]) | (before["line"] != r["line"]), F.lit(True))

    return ordered.select("file_id", "language", F.inline(F.filter("found", is_first)))
