"""CSV tables: reading, null tokens, column types and files that cannot be read.

A quoted field may hold line breaks, so a line feed ends a record only outside quotes, and whether a block of a file starts inside
quotes depends on all blocks before it. Two reads settle that: the first finds, for each block, the state at its end for either
state at its start; these two-valued functions are composed over the blocks of a file; the second read cuts the records, and pieces
of the few records that lie across blocks are joined. A table without such a field is cut at its line feeds at once.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gumshoe.functions import patterns as P
from gumshoe.functions import text
from gumshoe.functions.text import quoted
from gumshoe.lineage import keep
from gumshoe.operators.quality import SOURCE
from gumshoe.sources.blocks import MOST_BROADCAST, changed, read_lines, with_block_facts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXTRA = "_extra_field"
MOST_HEADERS = 1000
# fixed values: why a row or a file cannot be read
TOO_LONG = "have more fields than the header"
NOT_TEXT = "are not UTF-8 text"
NOT_CLOSED = "open a quote that is never closed"
NO_HEADER = "files hold no header"


def ends_open(line: str, is_open: bool) -> bool:
    """Whether a line ends inside quotes. Only a quote at the start of a field opens, and a doubled one does not close."""
    at = 0
    if not is_open:
        if not line.startswith('"'):
            at = line.find(',"') + 1
            if not at:
                return False
        at += 1
    while True:
        at = line.find('"', at)
        while at >= 0 and line.startswith('"', at + 1):
            at = line.find('"', at + 2)
        if at < 0:
            return True
        at = line.find(',"', at + 1)
        if at < 0:
            return False
        at += 2


class _Block:
    """What the first read keeps of a block."""

    def __init__(self, file: str, block: int) -> None:
        self.file, self.block = file, block
        self.ends, self.opens = [False, True], False
        self.header: str | None = None
        self.header_at: int | None = None
        self.in_header = block == 0

    def look_for_header(self, raw: pa.Array, at: pa.Array) -> None:
        """The first line that is not blank, and those that its quotes take in."""
        for line, place in zip(raw, at, strict=True):
            line = line.as_py()
            if self.header is None:
                if not line.strip():
                    continue
                self.header, self.header_at, inside = line, place.as_py(), False
            else:
                self.header, inside = f"{self.header}\n{line}", True
            self.in_header = ends_open(line, inside)
            if not self.in_header:
                return

    def pass_line(self, line: str) -> None:
        after = ends_open(line, False), ends_open(line, True)
        self.opens |= after[0]
        self.ends = [after[e] for e in self.ends]

    def row(self) -> pa.RecordBatch:
        values = {
            "file": (self.file, pa.string()), "block": (self.block, pa.int64()), "end0": (self.ends[0], pa.bool_()),
            "end1": (self.ends[1], pa.bool_()), "opens": (self.opens, pa.bool_()), "header": (self.header, pa.string()),
            "header_at": (self.header_at, pa.int64()),
        }
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values.values()], names=list(values))


def _block_functions(lines: DataFrame) -> DataFrame:
    """One row a block: whether it ends in quotes if it starts outside (``end0``) or inside (``end1``), whether a line of it
    opens quotes that it does not close, and at a file's start the header."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, at = batch["raw"], batch["at"]
            starts = changed(batch["file"], batch["block"], block and (block.file, block.block)).tolist()
            ends = dict(zip(starts, [*starts, batch.num_rows][1:], strict=True))
            if block is not None and block.in_header:
                first = starts[0] if starts else batch.num_rows
                block.look_for_header(raw.slice(0, first), at.slice(0, first))
            quotes = np.flatnonzero(pc.fill_null(pc.match_substring(raw, '"'), False).to_numpy(zero_copy_only=False)).tolist()
            # Looking each up in the batch costs more than the line itself; the other lines may not be text.
            texts = dict(zip(quotes, raw.take(pa.array(quotes, pa.int64())).to_pylist(), strict=True))
            for row in sorted({*starts, *quotes}):
                if row in ends:
                    if block is not None:
                        yield block.row()
                    block = _Block(batch["file"][row].as_py(), batch["block"][row].as_py())
                    if block.in_header:
                        block.look_for_header(raw.slice(row, ends[row] - row), at.slice(row, ends[row] - row))
                if row in texts:
                    block.pass_line(texts[row])
        if block is not None:
            yield block.row()

    seen = F.when(F.contains("raw", F.lit('"')) | (F.col("block") == 0), F.col("raw")).alias("raw")
    schema = "file string, block long, end0 boolean, end1 boolean, opens boolean, header string, header_at long"
    return lines.select("file", "block", "at", seen).mapInArrow(compose, schema)


def _block_states(functions: DataFrame) -> DataFrame:
    """Add ``opened``: whether a block starts inside quotes. Each block keeps, turns or sets the state."""
    sets, turns = F.col("end0") == F.col("end1"), F.col("end0") & ~F.col("end1")
    so_far = Window.partitionBy("file").orderBy("block")
    turned = functions.withColumn("turned", F.sum(turns.cast("int")).over(so_far))
    last = F.last(F.when(sets, F.struct("end0", "turned")), ignorenulls=True).over(so_far)
    after = turned.withColumn("last", last)
    parity = (F.col("turned") - F.coalesce(F.col("last.turned"), F.lit(0))) % 2 == 1
    after = after.withColumn("after", F.coalesce(F.col("last.end0"), F.lit(False)) != parity)
    opened = F.coalesce(F.lag("after").over(so_far), F.lit(False))
    return after.withColumn("opened", opened).drop("turned", "last", "after")


def _cut(lines: DataFrame) -> DataFrame:
    """``(file, block, at, record, starts, ends)``: records of ``lines (.., opened)``; what crosses a block does not start or end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, is_open, held, held_at, held_starts = None, False, [], None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = set(changed(batch["file"], batch["block"], place).tolist())
            quotes = np.flatnonzero(pc.match_substring(batch["raw"], '"').to_numpy(zero_copy_only=False)).tolist()
            raw, files, blocks, ats, opened = (batch[c].to_pylist() for c in ("raw", "file", "block", "at", "opened"))
            out: list[tuple] = []
            row, n = 0, batch.num_rows
            stops = sorted(starts.union(quotes))
            for stop in [*stops, n]:
                if row < stop:  # lines without quotes, which are records or lie in an open one
                    if is_open:
                        held.extend(raw[row:stop])
                    else:
                        out.extend((files[i], blocks[i], ats[i], raw[i], True, True) for i in range(row, stop))
                    row = stop
                if stop == n:
                    break
                here = (files[row], blocks[row])
                if stop in starts:
                    if held:
                        out.append((*place, held_at, "\n".join(held), held_starts, False))
                    place, is_open, held = here, opened[row], []
                    held_at, held_starts = ats[row], not is_open
                line, was_open = raw[row], is_open
                is_open = ends_open(line, is_open) if '"' in line else is_open
                if was_open:
                    held.append(line)
                else:
                    held, held_at, held_starts = [line], ats[row], True
                if not is_open:
                    out.append((*here, held_at, "\n".join(held), held_starts, True))
                    held = []
                row += 1
            yield _rows(out)
        if held:
            yield _rows([(*place, held_at, "\n".join(held), held_starts, False)])

    return lines.select("file", "block", "at", "raw", "opened").mapInArrow(
        cut, "file string, block long, at long, record string, starts boolean, ends boolean"
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    names = ["file", "block", "at", "record", "starts", "ends"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _joined(cut: DataFrame) -> DataFrame:
    """``(file, at, record, closed)``: pieces of records across blocks, at most two a block, put together."""
    whole = F.col("starts") & F.col("ends")
    parts = cut.filter(~whole).withColumn(
        "number", F.sum(F.col("starts").cast("int")).over(Window.partitionBy("file").orderBy("block", "at"))
    )
    across = parts.groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("block", "at", "record", "ends"))).alias("parts")
    )
    across = across.select(
        "file", F.col("parts")[0]["at"].alias("at"), F.array_join("parts.record", "\n").alias("record"),
        F.element_at("parts", -1)["ends"].alias("closed"),
    )
    return cut.filter(whole).select("file", "at", "record", F.lit(True).alias("closed")).unionByName(across)


def records_of(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(file, at, record, closed)`` and, one row a file, ``(file, header, header_at)``; the header is among the records."""
    lines = read_lines(spark, path)
    functions = keep(_block_functions(lines))
    headers = functions.filter("header is not null").select("file", "header", "header_at")
    if functions.filter("opens").isEmpty():  # every line is a record
        return lines.select("file", "at", F.col("raw").alias("record"), F.lit(True).alias("closed")), headers
    states = keep(_block_states(functions).select("file", "block", "opened"))
    return _joined(_cut(with_block_facts(lines, states))), headers


def _names(header: str) -> list[str]:
    """Column names as pandas gives them: a name without letters gets its place, a repeated one a number."""
    found: list[str] = []
    for i, name in enumerate(next(csv.reader([header.rstrip("\r").removeprefix("\ufeff")]))):
        name = name or f"Unnamed: {i}"
        number, free = 0, name
        while free in found:
            number += 1
            free = f"{name}.{number}"
        found.append(free)
    return found


def _parsed(records: DataFrame, names: list[str]) -> DataFrame:
    """Every field as text, null tokens as null, and ``EXTRA``."""
    n = len(names)
    schema = ", ".join([*(f"c{i} string" for i in range(n + 1)), "broken string"])
    record = F.when(F.endswith("record", F.lit("\r")), F.left("record", F.length("record") - 1)).otherwise(F.col("record"))
    options = {"escape": '"', "columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}
    rows = records.withColumn("record", record).withColumn("f", F.from_csv("record", schema, options))
    # read with one column more than the header has, a row is as wide as the schema only if it is too long
    outside = F.regexp_replace("record", r'(^|,)"[^"]*+(?:""[^"]*+)*+"', "$1")
    too_long = F.col(f"f.c{n}").isNotNull() | F.col("f.broken").isNull() | (F.regexp_count(outside, F.lit(",")) >= n)
    problem = F.when(~F.col("closed"), NOT_CLOSED).when(~F.is_valid_utf8("record"), NOT_TEXT).when(too_long, TOO_LONG)
    fields = [F.when(~F.col(f"f.c{i}").isin(P.NULL_TOKENS), F.col(f"f.c{i}")).alias(name) for i, name in enumerate(names)]
    return rows.select(*fields, problem.alias(EXTRA))


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every field as text, null tokens as null, plus ``EXTRA``: why a row cannot be read, else null.

    A quote inside quotes is doubled, quoted fields may hold line breaks, lines without text are skipped. Files with other
    headers go by their own, and columns that a file lacks are null. Without any header there is only ``EXTRA``, and no row.
    """
    return _raw(spark, *records_of(spark, path))


def _raw(spark: SparkSession, records: DataFrame, headers: DataFrame) -> DataFrame:
    found = [r["header"] for r in headers.groupBy("header").agg(F.count("*")).limit(MOST_HEADERS + 1).collect()]
    if len(found) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField(EXTRA, T.StringType())]))
    small = headers.count() <= MOST_BROADCAST
    known = records.join(F.broadcast(headers) if small else headers, "file")
    known = known.filter((F.col("at") != F.col("header_at")) & (F.btrim("record", F.lit(" \r\t")) != ""))
    tables: dict[tuple, list[str]] = {}
    for header in sorted(found):
        tables.setdefault(tuple(_names(header)), []).append(header)
    parsed = [
        _parsed(known.filter(F.col("header").isin(which)) if len(tables) > 1 else known, list(names)) for names, which in tables.items()
    ]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parsed)
    return out.select(*[quoted(c) for c in out.columns if c != EXTRA], EXTRA)


def files_without_header(spark: SparkSession, path: str, headers: DataFrame | None = None) -> int:
    """How many files are empty or hold white space only; reading leaves empty files out, listing does not."""
    headers = records_of(spark, path)[1] if headers is None else headers
    return len(spark.read.text(path).inputFiles()) - headers.count()


def csv_parse_findings(raw: DataFrame, without_header: int = 0) -> DataFrame:
    """One critical finding if any row or file cannot be read; short rows are fine."""
    bad = raw.filter(F.col(EXTRA).isNotNull()).groupBy(F.col(EXTRA).alias("why")).agg(F.count("*").alias("n"))
    said = F.concat_ws(" rows ", F.col("n").cast("string"), F.col("why"))
    bad = bad.agg(F.sort_array(F.collect_list(said)).alias("said"))  # three reasons at most
    if without_header:
        bad = bad.select(F.concat("said", F.array(F.lit(f"{without_header} {NO_HEADER}"))).alias("said"))
    return bad.filter(F.size("said") > 0).select(
        F.lit(0).cast("bigint").alias("ord"),
        F.lit("CSV Parse Error").alias("bug_type"),
        F.lit(1).alias("line_number"),
        F.lit(None).cast("string").alias("column_name"),
        F.array_join("said", ", ").alias("explanation"),
        F.lit("The table cannot be read").alias("impact"),
        F.lit("critical").alias("severity"),
        F.lit("Check the separator, the quoting and the encoding").alias("suggested_fix"),
        F.lit(SOURCE).alias("source"),
    )


def infer_column_kinds(df: DataFrame) -> dict[str, str]:
    """Which text columns hold numbers only; one aggregate, one row to the driver.

    A column without values counts as a number column.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggs = [F.count_if(quoted(n).isNotNull() & ~text.is_number(quoted(n))).alias(str(i)) for i, n in enumerate(names)]
    row = df.agg(*aggs).first() if names else []
    return {n: "text" if row[i] else "number" for i, n in enumerate(names)}


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Number columns as doubles."""
    return df.withColumns(
        {n: quoted(n).try_cast("double") for n, kind in kinds.items() if kind == "number"}
    )


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with column types found from its values."""
    raw = read_raw_csv(spark, path).drop(EXTRA)
    return typed(raw, infer_column_kinds(raw))


def csv_report(spark: SparkSession, path: str, table_name: str) -> DataFrame:
    """The quality report of CSV files, or their parse error alone."""
    from gumshoe.operators.quality import table_quality_report

    records, headers = records_of(spark, path)
    raw = _raw(spark, records, headers)
    errors = csv_parse_findings(raw, files_without_header(spark, path, headers)).select(F.lit(table_name).alias("table_name"), "*")
    if errors.first() is not None:
        return errors
    table = raw.drop(EXTRA)
    return table_quality_report(typed(table, infer_column_kinds(table)), table_name)
