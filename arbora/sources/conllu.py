"""Reading and writing CoNLL-U as line tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbora.functions.text import SPACE

#: Lines of one file that are numbered in one task; a table with a row per block carries the rest.
BLOCK_LINES = 8192
_RANGE = r"^[1-9][0-9]*[-.][1-9][0-9]*$"
_INTEGER = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line_number, line_text) of text files, each read in as many tasks as it has splits.

    Line ends are those of Python's str.splitlines. Lines are numbered within their split; the
    lines of the splits before come from a table with one row per split. (A rare line end as the
    very last character of a file gives an empty line after it.)
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"),
        F.posexplode(F.split("value", r"[\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")).alias("part", "line_text"),
    )
    sizes = rows.groupBy("file_name", "start").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("file_name").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("file_name", "start", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("file_name", "start").orderBy("row", "part"))
    numbered = rows.withColumn("within", within).join(offsets, ["file_name", "start"])
    return numbered.select("file_name", (F.col("before") + F.col("within")).cast("int").alias("line_number"), "line_text")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of word lists, in which blank lines and lines with ``#`` in front are none."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> '' and not startswith(word, '#')")


def sentence_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with ``sentence``, the number of the last blank line before, or 0.

    Repeated rows count once; a null text is a blank line. Within a block of a file a window
    finds the last blank line; what lies before comes from a table with one row per block, so
    that a file with a third of all lines is not numbered in one task.
    """
    rows = (
        lines.filter("file_name is not null and line_number is not null").select("file_name", "line_number", "line_text").distinct()
        .withColumn("blank", F.coalesce("line_text", F.lit("")).rlike(f"^({SPACE})?$")).withColumn("block", F.floor(F.col("line_number") / BLOCK_LINES))
    )
    at = F.when(F.col("blank"), F.col("line_number"))
    within = W.partitionBy("file_name", "block").orderBy("line_number").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("file_name").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy("file_name", "block").agg(F.max(at).alias("last")).select("file_name", "block", F.max("last").over(before).alias("carried"))
    numbered = rows.withColumn("own", F.max(at).over(within)).filter(~F.col("blank")).join(carried, ["file_name", "block"])
    return numbered.select("file_name", "line_number", "line_text", F.coalesce("own", "carried", F.lit(0)).alias("sentence"))


def metadata(numbered: DataFrame) -> DataFrame:
    """(file_name, sentence, key, value) of comments ``# key = value``; the last line of a key holds. Comments without ``=`` are none.

    A sentence of comments alone has no tokens and is left out.
    """
    is_comment = F.col("line_text").startswith("#")
    text = F.substring("line_text", 2, 2**30)
    trimmed = lambda c: F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")
    pairs = numbered.filter(is_comment).withColumn("t", text).withColumn("cut", F.locate("=", F.col("t"))).filter("cut > 0").select(
        "file_name", "sentence", trimmed(F.expr("substring(t, 1, cut - 1)")).alias("key"), trimmed(F.expr("substring(t, cut + 1)")).alias("value"), "line_number"
    )
    held = numbered.filter(~is_comment).select("file_name", "sentence").distinct()
    return pairs.join(held, ["file_name", "sentence"], "left_semi").groupBy("file_name", "sentence", "key").agg(F.max_by("value", "line_number").alias("value"))


def layout(lines: DataFrame) -> DataFrame:
    """(file_name, sentences, late_comments, repeated_keys, ends_blank) of what a strict layout asks: sentences with a comment after a token, sentences that give a key twice, and whether the last line is blank."""
    numbered = sentence_lines(lines)
    note = F.col("line_text").startswith("#")
    order = numbered.groupBy("file_name", "sentence").agg(F.max(F.when(note, F.col("line_number"))).alias("note"), F.min(F.when(~note, F.col("line_number"))).alias("token"))
    late = order.groupBy("file_name").agg(F.count("*").alias("sentences"), F.count_if(F.col("note") > F.col("token")).alias("late_comments"))
    keys = numbered.filter(note & F.contains("line_text", F.lit("="))).select("file_name", "sentence", F.regexp_replace(F.substring_index(F.substring("line_text", 2, 2**30), "=", 1), f"^{SPACE}|{SPACE}$", "").alias("key"))
    twice = keys.groupBy("file_name", "sentence", "key").count().filter("count > 1").groupBy("file_name").agg(F.count_distinct("sentence").alias("repeated_keys"))
    blank = F.coalesce("line_text", F.lit("")).rlike(f"^({SPACE})?$")
    ends = lines.filter("file_name is not null and line_number is not null").groupBy("file_name").agg(F.max_by(blank, "line_number").alias("ends_blank"))
    return ends.join(late, "file_name", "left").join(twice, "file_name", "left").fillna(0, ["sentences", "late_comments", "repeated_keys"])


def strict_rows(numbered: DataFrame) -> DataFrame:
    """(file_name, sentence, line_number, c, reason): token rows with what a strict reader stops at.

    Range and decimal ids are skipped. ``reason`` is ``columns``, ``id``, ``consecutive`` or
    ``head``; only the first one of a sentence counts, for later ids depend on it.
    """
    rows = numbered.filter(~F.col("line_text").startswith("#")).withColumn("c", F.split("line_text", "\t"))
    rows = rows.filter(~((F.size("c") == 10) & F.col("c")[0].rlike(_RANGE)))
    place = F.row_number().over(W.partitionBy("file_name", "sentence").orderBy("line_number"))
    number = lambda c: F.expr(f"try_cast(replace(trim({c}), '_', '') as bigint)")
    return rows.withColumn("place", place).withColumn(
        "reason",
        F.when(F.size("c") != 10, "columns")
        .when(~F.col("c")[0].rlike(_INTEGER), "id")
        .when(~F.coalesce(number("c[0]") == F.col("place"), F.lit(False)), "consecutive")
        .when(~F.get("c", F.lit(6)).rlike(_INTEGER), "head"),
    )


def first_errors(numbered: DataFrame) -> DataFrame:
    """(file_name, sentence, line_number, reason) of the first row that stops a strict reader."""
    return (
        strict_rows(numbered).filter("reason is not null").groupBy("file_name", "sentence")
        .agg(F.min(F.struct("line_number", "reason")).alias("e")).select("file_name", "sentence", "e.line_number", "e.reason")
    )


def format_tokens(trees: DataFrame, key: str) -> DataFrame:
    """(key, id, line): each token as a row of ten columns with ``_`` where nothing is known."""
    toks = trees.select(key, F.explode("toks").alias("t"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    blank = F.lit("_")
    return toks.select(
        key, F.col("t.id").alias("id"),
        F.concat_ws("\t", shown("t.id"), shown("t.form"), blank, shown("t.upos"), blank, blank, shown("t.head"), shown("t.deprel"), blank, blank).alias("line"),
    )


def write_conllu(trees: DataFrame, key: str, path: str) -> None:
    """Text files with each tree as a comment ``# key = value``, its rows and a blank line; a tree is one record, so it never spans two files."""
    lines = format_tokens(trees, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("l"))
    head = F.concat(F.lit(f"# {key} = "), F.col(key).cast("string"), F.lit("\n"))
    lines.select(F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value")).write.text(path)
