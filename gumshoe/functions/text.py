"""Column expressions over text: lines, trimming, languages, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gumshoe.functions import patterns as P


def quoted(name: str) -> Column:
    """The column of that very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends (plain ``trim`` drops spaces only)."""
    return F.btrim(c, F.lit(P.WHITESPACE))


def strip_line(c: Column) -> Column:
    """:func:`strip` of a plain column, which is named several times.

    Where a printable ASCII sign is the last byte and, after spaces, the first one, nothing but those spaces can go. Only other
    texts are compared, sign by sign, with all of the white space.
    """
    body, last = F.ltrim(c), F.substring(c.cast("binary"), -1, 1)
    printable = (body >= "!") & (body < "\x7f") & (last >= F.lit(b"!")) & (last <= F.lit(b"~"))
    return F.when(printable, body).otherwise(strip(c))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(P.WHITESPACE))


def plain_breaks(c: Column) -> Column:
    """Every line break as a line feed. Texts without rare breaks are left as they are."""
    return F.when(c.rlike(P.RARE_BREAK), F.regexp_replace(c, P.LINE_BREAK, "\n")).otherwise(c)


def split_plain_lines(c: Column) -> Column:
    """Lines of a text whose breaks are line feeds; a final break adds no line."""
    body = F.when(F.endswith(c, F.lit("\n")), F.left(c, F.length(c) - 1)).otherwise(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def split_lines(c: Column) -> Column:
    """Array of lines; any Unicode line break ends a line.

    Breaks become line feeds first, so the split itself is on one plain
    character, which is much faster than splitting on a pattern.
    """
    return split_plain_lines(plain_breaks(c))


def line_count(c: Column) -> Column:
    return F.size(split_lines(c)).cast("bigint")


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def is_js_comment(c: Column) -> Column:
    return c.startswith("//") | c.startswith("/*") | c.startswith("*")


# In this order: what shows that there may be something to cut, what is cut, what takes its place.
CUTS = [("//", r"//.*$", ""), ('"', r'"[^"]*"', '""'), ("'", r"'[^']*'", "''"), ("`", r"`[^`]*`", "``")]


def strip_comments_and_strings(c: Column) -> Column:
    """Cut a trailing ``//`` comment, then blank out quoted text."""
    clean = reduce(lambda text, cut: F.regexp_replace(text, cut[1], cut[2]), CUTS, c)
    return F.when(contains_any(c, [mark for mark, _, _ in CUTS]), clean).otherwise(c)


def identifiers(c: Column) -> Column:
    """Every identifier in order, as an array."""
    return F.regexp_extract_all(c, F.lit(P.IDENTIFIER), F.lit(0))


def clean_extracted_text(c: Column) -> Column:
    """Tidy text read from an image: fences, trailing space, typography, blank edges."""
    c = F.regexp_replace(c, rf"(?dm)^```{P.W}*\n?", "")
    c = F.regexp_replace(c, r"(?dm)\n?```$", "")

    def tidy(line: Column) -> Column:
        line = rstrip(line)
        for fancy, plain in P.PLAIN_SPELLING:
            line = F.replace(line, F.lit(fancy), F.lit(plain))
        return line

    # Right-trimmed blank lines are empty, so the blank edges are line feeds only.
    return F.btrim(F.array_join(F.transform(split_lines(c), tidy), "\n"), F.lit("\n"))


def _score(c: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(m)).cast("int") for m in marks])


def detect_language(c: Column) -> Column:
    """Score python / javascript / typescript markers in a whole text."""
    py = _score(c, P.PY_MARKS) + (F.contains(c, F.lit("class ")) & F.contains(c, F.lit("self"))).cast("int")
    js = _score(c, P.JS_MARKS)
    ts_extra = _score(F.lower(c), P.TS_LOWER_MARKS) + _score(c, P.TS_MARKS)
    return (
        F.when(strip(c) == "", "unknown")
        .when((js + ts_extra > py) & (ts_extra > 0), "typescript")
        .when(js > py, "javascript")
        .otherwise("python")
    )


def detect_language_simple(c: Column) -> Column:
    """Short heuristic: javascript markers unless the text defines and imports."""
    python = F.contains(c, F.lit("def ")) & F.contains(c, F.lit("import "))
    script = contains_any(c, ["function ", "const ", "=>"])
    return F.when(~python & script, "javascript").otherwise("python")


def resolve_language(declared: Column, text: Column) -> Column:
    """The declared language if it is a known name, else the detected one."""
    name = F.lower(strip(declared))
    return F.when(name.isin(P.LANGUAGES), name).otherwise(detect_language(text))


def is_number(c: Column) -> Column:
    """True where text would convert to a number."""
    return c.rlike(P.NUMBER)


def finding_text(bug_type: Column, language: Column, explanation: Column, impact: Column, fix: Column) -> Column:
    """One line describing a finding; this is what gets embedded and searched."""
    empty = F.lit("")
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Bug Type: "), F.coalesce(bug_type, F.lit("Unknown"))),
        F.concat(F.lit("Language: "), F.coalesce(language, empty)),
        F.concat(F.lit("Explanation: "), F.coalesce(explanation, empty)),
        F.concat(F.lit("Impact: "), F.coalesce(impact, empty)),
        F.concat(F.lit("Fix: "), F.coalesce(fix, empty)),
    )


def hash_embedding(c: Column, bits: int = 384) -> Column:
    """A number in [-1, 1) for each byte of a text's SHA-2 digest of 224, 256, 384 or 512 bits."""

    def numbers(signs: Column) -> Column:
        # split once instead of a search from the start for each sign; halving is exact, so these are the quotients by 128
        return F.transform(F.split(signs, ""), lambda sign: F.ascii(sign).cast("double") * (1 / 128) - 1.0)

    # Each byte is a sign of one text, which is bound as a list element and so computed once and not for every number.
    return F.transform(F.array(F.decode(F.unhex(F.sha2(c, bits)), "ISO-8859-1")), numbers)[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long arrays; 0 where either has no length."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
