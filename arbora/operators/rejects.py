"""Loading line files row by row, with the rows that fail to parse set apart and the reason for each."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arbora.storage import materialize

#: Line numbers of one file that meet in one row; sentences go on over the next blocks by a small table.
BLOCK_LINES = 4096
#: Lines of one output batch.
BATCH_LINES = 16384
#: Stands for the piece of a block before its first blank line.
_LEAD = -(1 << 40)
_PAIR = re.compile('"([^"]*)"')
_DIGITS = re.compile(r"[1-9][0-9]*")
_COMPOUND = re.compile(r"[1-9][0-9]*[-.][1-9][0-9]*")

PARSED = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("ten", T.BooleanType()),
        T.StructField("id", T.StringType()),
        T.StructField("form", T.StringType()),
        T.StructField("upos", T.StringType()),
        T.StructField("head", T.StringType()),
        T.StructField("deprel", T.StringType()),
    ]
)


def assemble(columns: list[str]) -> str:
    """The columns as one record for the strict csv reader.

    Columns with quotes or line breaks are enclosed in quotes. Free quotes of the second and
    third column are escaped, elsewhere only quotes that come in pairs are; a quote without
    partner stays bare, and the reader stumbles over it.
    """

    def enclosed(k: int, c: str) -> str:
        escaped = c.replace('"', '""') if k in (1, 2) else _PAIR.sub(r'""\1""', c)
        return f'"{escaped}"'

    return "\t".join(enclosed(k, c) if '"' in c or "\r" in c or "\n" in c else c for k, c in enumerate(columns))


def read_record(line: str) -> list[str]:
    """The ten columns as the strict csv reader gives them; csv.Error where the structure is damaged."""
    columns = line.split("\t")
    if len(columns) != 10:
        raise csv.Error("columns")
    try:
        fields = next(csv.reader([assemble(columns)], delimiter="\t", strict=True))
    except csv.Error as error:
        raise csv.Error("quoting") from error
    if len(fields) != 10:  # a column ran on into the next, up to another quote without partner
        raise csv.Error("quoting")
    return fields


def split_row(line: str) -> tuple[list[str], str | None]:
    """The columns as they stand, and ``columns`` or ``quoting`` where the structure is damaged."""
    try:
        return read_record(line), None
    except csv.Error as error:
        return line.split("\t"), str(error)


def whole_number(text: str) -> tuple[int, str]:
    """A positive whole number without leading zero, however long: compared by length, then digit by digit."""
    if not _DIGITS.fullmatch(text):
        raise ValueError(text)
    return len(text), text


def token_id(text: str) -> tuple[int, str] | None:
    """A token's number; None for a range or a decimal id."""
    return None if _COMPOUND.fullmatch(text) else whole_number(text)


def token_head(text: str) -> tuple[int, str]:
    return (1, "0") if text == "0" else whole_number(text)


def parse_row(line: str) -> tuple[str | None, list[str] | None, tuple[int, str] | None]:
    """(reason, columns if there are ten, number) of a token row: the structure first, then the typed fields."""
    fields, reason = split_row(line)
    if len(fields) != 10:
        return reason, None, None
    number = None
    try:
        number = token_id(fields[0])
    except ValueError:
        reason = reason or "id"
    if reason is None and number:
        try:
            token_head(fields[6])
        except ValueError:
            reason = "head"
    return reason, fields, number


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by themselves, for streams."""
    csv.field_size_limit(2**31 - 1)
    for batch in batches:
        out = []
        for file_name, line_no, line in zip(batch["file_name"], batch["line_number"], batch["line_text"]):
            if line is None or not line.strip() or line[0] == "#":
                out.append((file_name, line_no, "blank" if line is None or not line.strip() else "comment", None, False, None, None, None, None, None))
            else:
                reason, fields, number = parse_row(line)
                shown = (fields[1], fields[3], fields[6], fields[7]) if fields else (None,) * 4
                out.append((file_name, line_no, "token", reason, fields is not None, number and number[1], *shown))
        yield pd.DataFrame(out, columns=PARSED.names).astype({"line_number": "Int32"})


# ``open`` rows lie in a sentence that may go on in another block: its number and its largest ID are known only there.
# A block ends with a row without line_number: its last blank line and the largest IDs of its first and last piece.
_BLOCK_ROWS = T.StructType(
    [T.StructField("file_name", T.StringType()), T.StructField("block", T.LongType()), *PARSED.fields[1:2], T.StructField("sentence", T.LongType()), T.StructField("open", T.BooleanType()),
     T.StructField("reason", T.StringType()), *PARSED.fields[5:], T.StructField("largest", T.StringType()), T.StructField("last_largest", T.StringType())]
)


def _block_rows(file_name: str, block: int, numbers: list[int], texts: list[str | None]) -> Iterator[tuple]:
    """The token rows of a block with the sentence and its largest ID as far as the block knows them, and the block's own row."""
    piece: list[tuple] = []
    started: int | None = None
    lead = largest = None

    def closed(is_open: bool) -> Iterator[tuple]:
        top = largest and largest[1]
        for line_number, reason, number, shown in piece:
            yield file_name, block, line_number, started, is_open, reason, number and number[1], *shown, top, None

    for line_number, line in zip(numbers, texts):
        if line is None or not line.strip():
            yield from closed(started is None)
            if started is None:
                lead = largest
            piece, largest, started = [], None, line_number
        elif line[0] != "#":
            reason, fields, number = parse_row(line)
            if number and (largest is None or number > largest):
                largest = number
            piece.append((line_number, reason, number, (fields[1], fields[3], fields[6], fields[7]) if fields else (None,) * 4))
    yield from closed(True)
    first, last = (largest, None) if started is None else (lead, largest)
    yield file_name, block, None, started, None, None, None, None, None, None, None, first and first[1], last and last[1]


def _parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(2**31 - 1)
    schema = to_arrow_schema(_BLOCK_ROWS)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    for batch in batches:
        out: list[tuple] = []
        for k in range(batch.num_rows):
            lines = batch.column("lines")[k].values
            out.extend(_block_rows(batch.column("file_name")[k].as_py(), batch.column("block")[k].as_py(), lines.field("line_number").to_pylist(), lines.field("line_text").to_pylist()))
            if len(out) >= BATCH_LINES:
                yield as_batch(out)
                out = []
        if out:
            yield as_batch(out)


def _number(c: str):
    """Whole numbers without leading zeros compare by length and then digit by digit, however long they are."""
    return F.struct(F.length(c).alias("n"), F.col(c).alias("d"))


def parse_lines(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Every token row of (file_name, line_number, line_text) with its first defect, or null, in ``reason``.

    A record is a line: its columns are assembled quote-aware and read by the strict csv reader,
    whose errors are the structural reasons (``columns``, ``quoting``); then come the typed fields
    (``id``, ``head``), then what needs the sentence or the vocabulary (``head_range``, ``deprel``,
    ``root``). Blank lines (also null texts) end sentences, lines starting with ``#`` are comments;
    both are left out. Repeated rows count once; rows without file or number are left out. Range
    and decimal IDs pass as rows without ``id``.

    Lines meet once, by file and block of BLOCK_LINES numbers, repeats pre-aggregated before. A
    sentence that goes on over blocks is put together by a table with one row per block.
    """
    placed = lines.filter("file_name is not null and line_number is not null").select("file_name", F.col("line_number").cast("int").alias("line_number"), "line_text")
    blocks = placed.groupBy("file_name", F.floor(F.col("line_number") / BLOCK_LINES).alias("block")).agg(F.sort_array(F.collect_set(F.struct("line_number", "line_text"))).alias("lines"))
    parsed = materialize(blocks.mapInArrow(_parse_blocks, _BLOCK_ROWS), "parsed")
    ends = parsed.filter("line_number is null").select("file_name", "block", F.col("sentence").alias("last_blank"), "largest", "last_largest")
    before = W.partitionBy("file_name").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.coalesce(F.max("last_blank").over(before), F.lit(0)))
    pieces = F.explode(F.array(F.struct(F.col("carried").alias("sentence"), F.col("largest").alias("top")), F.struct(F.col("last_blank").alias("sentence"), F.col("last_largest").alias("top"))))
    pieces = ends.select("file_name", "block", pieces.alias("p")).select("file_name", "block", "p.*").filter("sentence is not null")
    whole = pieces.groupBy("file_name", "sentence").agg(F.max(F.when(F.col("top").isNotNull(), _number("top"))).alias("whole"))
    # the pieces of a block by the blank line before them in it
    known_pieces = pieces.join(whole, ["file_name", "sentence"]).join(ends.select("file_name", "block", "last_blank"), ["file_name", "block"])
    at_ends = known_pieces.select("file_name", "block", F.when(F.col("sentence").eqNullSafe(F.col("last_blank")), F.col("last_blank")).otherwise(_LEAD).alias("own"), F.col("sentence").alias("of"), "whole")
    tokens = parsed.filter("line_number is not null").withColumn("own", F.when(F.col("open"), F.coalesce("sentence", F.lit(_LEAD))))
    judged = tokens.join(at_ends, ["file_name", "block", "own"], "left").withColumn("top", F.when(F.col("open"), F.col("whole")).when(F.col("largest").isNotNull(), _number("largest")))
    known = F.broadcast(labels.select(F.col("label").alias("deprel")).filter("deprel is not null").distinct().withColumn("known", F.lit(True)))  # the label set is a closed vocabulary of fixed size
    late = (
        F.when(F.col("id").isNull(), None)
        .when((F.col("head") != "0") & (_number("head") > F.col("top")), "head_range")
        .when(F.col("known").isNull(), "deprel")
        .when((F.col("head") == "0") != (F.col("deprel") == "root"), "root")
    )
    return judged.join(known, "deprel", "left").select(
        "file_name", "line_number", F.coalesce("of", "sentence").alias("sentence"), F.coalesce("reason", late).alias("reason"), "id", "form", "upos", "head", "deprel"
    )


def loaded_tokens(parsed: DataFrame) -> DataFrame:
    """The rows without defect as typed tokens; numbers beyond 32 bits, which no file of real length reaches, become null."""
    return parsed.filter("reason is null and id is not null").select(
        "file_name", "line_number", "sentence", F.expr("try_cast(id as int)").alias("id"), "form", "upos", F.expr("try_cast(head as int)").alias("head"), "deprel"
    )
