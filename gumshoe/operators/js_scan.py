"""Javascript / typescript: declarations, line facts and rules.

A file is one row. Names that a rule must look up in the rest of the file are
sorted together with the file's declarations (see ``lookups``), which takes time
and memory in proportion to the file, up to the sort's logarithm. What was found
is exploded beside the lines: one narrow pass, without a shuffle or a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.functions import patterns as P
from gumshoe.functions import text as T
from gumshoe.functions.constants import array_of
from gumshoe.operators import lookups
from gumshoe.operators.catalogue import MESSAGE, PATTERN, filled
from gumshoe.operators.lines import drop_comment_lines, split_lines, trim_lines

JS_LANGUAGES = ["javascript", "typescript"]


def _js(files: DataFrame) -> DataFrame:
    return files.filter(F.col("language").isin(JS_LANGUAGES))


def _params(group: Column) -> Column:
    """Names in a parameter list; a default value is cut at its ``=``."""
    parts = F.filter(F.split(group, ","), lambda p: T.strip(p) != "")
    return F.transform(parts, lambda p: T.strip(F.split(T.strip(p), "=")[0]))


def with_scope(files: DataFrame) -> DataFrame:
    """Add what a file declares, as small arrays beside its lines.

    ``declared``: distinct names of functions, parameters, variables and loop
    variables, file-wide. ``function_names``. ``param_pool``: parameters of the
    last definition of each function name.
    """
    js = _js(files).select("file_id", "language", T.plain_breaks(F.col("content")).alias("text"))
    js = js.select(
        "file_id",
        "language",
        T.split_plain_lines(F.col("text")).alias("lines"),
        F.regexp_extract_all("text", F.lit(P.JS_HEADERS), F.lit(0)).alias("headers"),
        F.array_distinct(
            F.concat(
                F.regexp_extract_all("text", F.lit(P.JS_VARIABLES), F.lit(1)),
                F.regexp_extract_all("text", F.lit(P.JS_LOOP_VARIABLES), F.lit(1)),
            )
        ).alias("variables"),
    ).withColumn(
        "definitions",
        F.sort_array(
            F.transform(
                "headers",
                lambda h, i: F.struct(
                    F.regexp_extract(h, P.JS_HEADER_NAME, 1).alias("name"),
                    i.alias("at"),
                    _params(F.regexp_extract(h, P.JS_HEADER_PARAMS, 1)).alias("params"),
                ),
            )
        ),
    )
    # Sorted by name and place, a definition is the last of its name when the next one differs.
    last = F.filter(
        "definitions",
        lambda f, i: F.coalesce(F.get("definitions", i + 1)["name"] != f["name"], F.lit(True)),
    )
    return js.select(
        "file_id",
        "language",
        "lines",
        F.array_distinct(
            F.concat(
                F.col("definitions.name"), F.flatten(F.col("definitions.params")), F.col("variables")
            )
        ).alias("declared"),
        F.array_distinct(F.flatten(last["params"])).alias("param_pool"),
        F.array_distinct(F.col("definitions.name")).alias("function_names"),
    )


def _guarded(e: Column) -> Column:
    """One of the four lines above names the object and looks like a check; comment lines count."""
    above = [F.get("lines", e["line"] - 1 - n) for n in range(1, 5)]
    return reduce(
        lambda a, b: a | b,
        [F.coalesce(F.contains(t, e["name"]) & T.contains_any(t, P.JS_GUARD_MARKS), F.lit(False)) for t in above],
    )


def js_rows(files: DataFrame) -> DataFrame:
    """Trimmed code lines (``text``), and the names whose rule depends on the rest of the file.

    A row of the second kind has no text but a ``scope``: an object among the
    parameters (``param``), a called function of the file (``function``) or the
    first name of a line that is declared nowhere (``any``).
    """
    scoped = with_scope(files).withColumn(
        "code",
        F.filter(
            F.transform("lines", lambda s, i: F.struct((i + 1).alias("line"), T.strip(s).alias("text"))),
            lambda r: ~T.is_js_comment(r["text"]),
        ),
    )

    def with_words(*words: str) -> Column:
        return F.filter("code", lambda r: reduce(lambda a, b: a & b, [F.contains(r["text"], F.lit(w)) for w in words]))

    def no_language_name(words: Column) -> Column:
        return F.filter(words, lambda w: ~w.isin(P.JS_BUILTINS + P.JS_KEYWORDS))

    scoped = scoped.withColumn(
        "used",
        F.transform(
            F.filter("code", lambda r: ~r["text"].rlike(P.JS_DECLARATION_START)),
            lambda r: F.struct(
                r["line"].alias("line"), T.identifiers(T.strip_comments_and_strings(r["text"])).alias("words")
            ),
        ),
    )
    scoped = scoped.withColumn("unknown", no_language_name(F.array_except(F.flatten("used.words"), "declared")))
    first = F.filter(  # the first of each line; without definitions all of them count
        F.transform(
            "used",
            lambda u: lookups.use("any", F.get(F.filter(u["words"], lambda w: F.array_contains("unknown", w)), F.lit(0)), u["line"]),
        ),
        lambda e: e["name"].isNotNull(),
    )
    names = F.when(F.size("unknown") <= lookups.FEW, first).otherwise(
        F.concat(
            lookups.definitions("any", F.col("declared")),
            F.flatten(
                F.transform(
                    "used",
                    lambda u: F.transform(
                        F.array_distinct(no_language_name(u["words"])), lambda w, at: lookups.use("any", w, u["line"], at)
                    ),
                )
            ),
        )
    )
    members = F.transform(
        with_words("."),
        lambda r: lookups.use(
            "param", F.regexp_extract(r["text"], P.MEMBER, 1), r["line"], detail=F.regexp_extract(r["text"], P.MEMBER, 2)
        ),
    )
    callees = F.transform(
        with_words("null", "("), lambda r: lookups.use("function", F.regexp_extract(r["text"], P.NULL_CALL, 1), r["line"])
    )
    members = F.filter(
        members,
        lambda e: (e["name"] != "")
        & ~e["name"].isin(P.JS_SAFE_OBJECTS)
        & ((F.size("param_pool") > lookups.FEW) | F.array_contains("param_pool", e["name"]))
        & ~_guarded(e),
    )
    callees = F.filter(callees, lambda e: (e["name"] != "") & ~e["name"].isin("console", "Math"))
    known = F.filter(callees, lambda e: F.array_contains("function_names", e["name"]))
    listed = reduce(lambda a, b: a & b, [F.size(c) <= lookups.FEW for c in ("unknown", "param_pool", "function_names")])
    entries = F.when(listed, F.concat(first, members, known)).otherwise(
        F.concat(
            lookups.definitions("param", F.col("param_pool")),
            lookups.definitions("function", F.col("function_names")),
            names,
            members,
            callees,
        )
    )
    scoped = scoped.select("file_id", "language", "code", entries.alias("entries"), listed.alias("listed"))
    looked_up = lookups.resolved(scoped, "entries", ["any"], F.col("listed"))
    none = F.lit(None).cast("string")

    def row(r: Column, text: Column, scope: Column, name: Column, detail: Column) -> Column:
        return F.struct(
            r["line"].alias("line"), text.alias("text"), scope.alias("scope"), name.alias("name"), detail.alias("detail")
        )

    rows = F.concat(
        F.transform("code", lambda r: row(r, r["text"], none, none, none)),
        F.transform("entries", lambda e: row(e, none, e["scope"], e["name"], e["detail"])),
    )
    return looked_up.select("file_id", "language", F.inline(rows))


# ---------------------------------------------------------------- facts


def _stripped(files: DataFrame) -> DataFrame:
    return trim_lines(split_lines(_js(files)))


def js_functions(files: DataFrame) -> DataFrame:
    """Function headers with their parameters."""
    t = F.col("text")

    def group(n: int) -> Column:
        return F.when(t.rlike(P.JS_FUNCTION), F.regexp_extract(t, P.JS_FUNCTION, n)).otherwise(
            F.regexp_extract(t, P.JS_ASSIGNED, n)
        )

    headers = _stripped(files).select("file_id", "line", group(1).alias("name"), group(2).alias("list"))
    return headers.filter(F.col("name") != "").select("file_id", "line", "name", _params(F.col("list")).alias("params"))


def js_function_counts(files: DataFrame) -> DataFrame:
    """``(file_id, functions_found)`` for every file with a function; no shuffle."""
    headers = F.regexp_extract_all(T.plain_breaks(F.col("content")), F.lit(P.JS_HEADERS), F.lit(0))
    counts = _js(files).select("file_id", F.size(headers).cast("bigint").alias("functions_found"))
    return counts.filter(F.col("functions_found") > 0)


def js_variables(files: DataFrame) -> DataFrame:
    """Declared variables on lines that are no function header."""
    t = F.col("text")
    plain = _stripped(files).filter(~t.rlike(P.JS_ASSIGNED))
    named = plain.select("file_id", "line", F.regexp_extract(t, P.JS_VARIABLE, 1).alias("name"))
    return named.filter(F.col("name") != "")


def js_loop_variables(files: DataFrame) -> DataFrame:
    t = F.col("text")
    named = _stripped(files).select("file_id", "line", F.regexp_extract(t, P.JS_LOOP_VARIABLE, 1).alias("name"))
    return named.filter(F.col("name") != "")


def js_declared_names(files: DataFrame) -> DataFrame:
    """Names known anywhere in the file, the language's own names included."""
    builtins = array_of(P.JS_BUILTINS)
    return with_scope(files).select(
        "file_id", F.explode(F.array_union("declared", builtins)).alias("name")
    )


def js_line_facts(files: DataFrame) -> DataFrame:
    """Classes, imports, loops, conditionals and calls as ``(file_id, line, kind, name)``."""
    t = F.col("text")
    lines = drop_comment_lines(_stripped(files))

    def fact(cond: Column, kind: str, name: Column) -> Column:
        return F.when(cond, F.array(F.struct(F.lit(kind).alias("kind"), name.alias("name")))).otherwise(
            F.array().cast("array<struct<kind:string,name:string>>")
        )

    class_name = F.regexp_extract(t, P.JS_CLASS, 1)
    is_import = t.startswith("import ") | (t.startswith("const ") & F.contains(t, F.lit("require(")))
    loop_kind = F.when(F.contains(F.substring(t, 1, 5), F.lit("for")), "for").otherwise("while")
    calls = F.transform(
        F.filter(F.regexp_extract_all(t, F.lit(P.JS_CALL), F.lit(1)), lambda n: ~n.isin(P.JS_NOT_CALLS)),
        lambda n: F.struct(F.lit("call").alias("kind"), n.alias("name")),
    )
    facts = F.concat(
        fact(class_name != "", "class", class_name),
        fact(is_import, "import", t),
        fact(t.rlike(P.JS_LOOP), "loop", loop_kind),
        fact(t.rlike(P.JS_CONDITIONAL), "conditional", F.lit(None).cast("string")),
        calls,
    )
    return lines.select("file_id", "line", F.inline(facts))


# ---------------------------------------------------------------- rules


def line_pattern_conditions(t: Column) -> list[tuple[Column, int, str]]:
    """The text patterns of a trimmed javascript line that is no comment: condition, place among the rules, type."""

    def has(word: str) -> Column:
        return F.contains(t, F.lit(word))

    return [
        (has("==") & ~has("===") & t.rlike(P.LOOSE_EQUALITY), 11, "loose_equality"),
        (has("eval("), 12, "eval"),
        ((has(":") | has("=")) & (has("'") | has('"')) & t.rlike(P.SECRET_JS), 13, "hardcoded_secret_js"),
    ]


def js_hits(files: DataFrame) -> DataFrame:
    """Every rule and pattern hit of the javascript files, in one scan of the lines.

    ``source`` tells parser rules from text patterns; ``ord`` is the order of
    the hits in the file, by line and then by rule. A rule reports a line at
    most once.
    """
    t = F.col("text")

    def has(*words: str) -> Column:
        return reduce(lambda a, b: a & b, [F.contains(t, F.lit(w)) for w in words])

    def group(guard: Column, pattern: str, n: int = 1) -> Column:
        """The group where the pattern matches, else null. The guard skips the regex."""
        found = F.when(guard, F.regexp_extract(t, pattern, n))
        return F.when(found != "", found)

    lines = js_rows(files).withColumns(
        {
            "loop_index": group(has("<=", ".length"), P.OFF_BY_ONE, 1),
            "loop_array": group(has("<=", ".length"), P.OFF_BY_ONE, 2),
            "shifted": group(has("[", "+") & ~t.rlike(P.INDEX_PLUS_GUARD), P.INDEX_PLUS, 1),
            "shift_index": group(has("[", "+") & ~t.rlike(P.INDEX_PLUS_GUARD), P.INDEX_PLUS, 2),
            "shift_by": group(has("[", "+") & ~t.rlike(P.INDEX_PLUS_GUARD), P.INDEX_PLUS, 3),
            "ratio": group(has("/"), P.DIVISION, 0),
            "divisor": group(has("/"), P.DIVISION, 2),
        }
    )
    divides = F.col("ratio").isNotNull() & ~F.contains(
        F.call_function("substring_index", t, F.col("ratio"), F.lit(1)), F.lit("//")
    )
    scope, name = F.col("scope"), F.col("name")
    evals = has("eval(")
    none = F.lit(None).cast("string")

    def hit(cond: Column, source: str, ord_: int, kind: str, text: Column, **bound: Column) -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit(source).alias("source"),
                F.lit(ord_).alias("ord"),
                F.lit(kind).alias("type"),
                text.alias("message"),
                *[bound.get(n, none).alias(n) for n in ("variable", "array", "function", "param")],
            ),
        )

    def rule(cond: Column, ord_: int, kind: str, values: dict[str, Column] | None = None, **bound: Column) -> Column:
        text = filled(F.lit(MESSAGE["js"][kind]), {**bound, **(values or {})})
        return hit(cond, "parser", ord_, kind, text, **bound)

    def pattern(cond: Column, ord_: int, kind: str) -> Column:
        return hit(cond, "pattern_detector", ord_, kind, F.lit(PATTERN[kind]["explanation"]))

    # One slot per rule, null where it did not fire: this stays in generated code.
    hits = F.array(
        rule(F.col("loop_index").isNotNull(), 1, "off_by_one", variable=F.col("loop_index"), array=F.col("loop_array")),
        rule(
            F.col("shifted").isNotNull(), 2, "out_of_bounds",
            {"index": F.col("shift_index"), "step": F.col("shift_by")}, array=F.col("shifted"),
        ),
        rule(scope == "param", 3, "null_reference", {"member": F.col("detail")}, variable=name),
        rule(divides, 4, "division", variable=F.col("divisor")),
        rule(scope == "any", 5, "undefined_variable", variable=name),
        rule(scope == "function", 6, "null_argument", function=name),
        rule(evals, 7, "security"),
        *[pattern(*p) for p in line_pattern_conditions(t)],
    )
    found = lines.select("file_id", "language", "line", F.inline(hits)).filter(F.col("type").isNotNull())
    return found.withColumn("ord", F.col("line").cast("long") * 100 + F.col("ord"))
