"""Evaluation sentences that occur, exactly or almost, in training sentences."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from arbora.storage import materialize

#: Shorter lists are not compared.
LEAST_FORMS = 12
#: Passages that one automaton holds, and characters of training texts that one task scans with it.
SHARD_PIECES, BLOCK_CHARS = 20_000, 400_000
#: Forms of a passage, about.
PASSAGE_FORMS = 3
#: An evaluation text whose passages to look up occur in more training texts than this is cut into single forms, if these are rarer.
PLENTY = 1000
SEP = "\x1f"


def most_edits(longer: int) -> int:
    """15 % of the longer list, rounded down."""
    return 15 * longer // 100


def cut_passages(n: int, forms: int | None = None) -> list[tuple[int, int]]:
    """Where a list of n forms is cut into passages of about ``forms``: at least two more than the edits that any partner may need."""
    parts = min(n, max(most_edits(n * 100 // 85) + 2, n // (forms or PASSAGE_FORMS)))
    bounds = [n * k // parts for k in range(parts + 1)]
    return list(zip(bounds, bounds[1:]))


def edits(a: list[str], b: list[str], most: int) -> int | None:
    """Levenshtein distance of two lists, all rows of a column at once as the bits of one integer; None beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    if not a or not b:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    # bits of the places where the column rises by one and where it falls by one
    rise, fall, d, left = full, 0, len(a), len(b)
    for y in b:
        equal = where.get(y, 0)
        level = equal | fall
        diagonal = (((equal & rise) + rise) ^ rise) | equal
        up, down = (fall | ~(diagonal | rise)) & full, rise & diagonal
        d += bool(up & last) - bool(down & last)
        left -= 1
        if d - left > most:
            return None
        up, down = (up << 1 | 1) & full, down << 1 & full
        rise, fall = (down | ~(level | up)) & full, up & level
    return d


@lru_cache(maxsize=65536)
def _lowered(form: str) -> str | None:
    low = form.lower()
    return low if any(unicodedata.category(c)[0] in "LN" for c in low) else None


@F.pandas_udf(StringType())
def _listed(toks: pd.Series) -> pd.Series:
    return toks.map(lambda forms: None if forms is None else SEP.join(low for f in forms if f is not None and (low := _lowered(f)) is not None))


def comparable(sentences: DataFrame) -> DataFrame:
    """(sent_no, split, text, n): lower-cased forms with a letter or digit, joined, of lists of LEAST_FORMS or more.

    Null forms count as forms without letters; null token lists, null splits and splits other
    than train, dev and test have nothing to compare.
    """
    forms = F.transform("toks", lambda t: t["form"])
    return (
        sentences.filter("split in ('train', 'dev', 'test') and toks is not null")
        .select("sent_no", "split", _listed(forms).alias("text"))
        .withColumn("n", F.size(F.split("text", SEP)))
        .filter((F.col("n") >= LEAST_FORMS) & (F.col("text") != ""))
    )


def _scan(passages: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """Where the passages of a shard stand in a block of training texts: the first and the last place in each text."""
    columns = ["passage_id", "train_id", "first", "last"]
    if not len(passages) or not len(texts):
        return pd.DataFrame([], columns=columns)
    automaton = ahocorasick.Automaton()
    for passage_id, piece in zip(passages["passage_id"], passages["piece"]):
        automaton.add_word(f"{SEP}{piece}{SEP}", (passage_id, len(piece) + 1))
    automaton.make_automaton()
    found: list[tuple] = []
    for train_id, text in zip(texts["train_id"], texts["text"]):
        spans: dict[int, tuple[int, int]] = {}
        whole = f"{SEP}{text}{SEP}"
        place: dict[int, int] = {}
        for end, (passage_id, before) in automaton.iter(whole):
            if not place:
                place = {at: k for k, at in enumerate(k for k, c in enumerate(whole) if c == SEP)}
            at = place[end - before]
            first = spans.get(passage_id)
            spans[passage_id] = (at, at) if first is None else (first[0], at)
        found.extend((passage_id, train_id, a, b) for passage_id, (a, b) in spans.items())
    return pd.DataFrame(found, columns=columns)


def passage_hits(pieces: DataFrame, train: DataFrame, seen: DataFrame) -> DataFrame:
    """(piece, train_id, first, last): each training text that holds a passage, with the passage's first and last place in it.

    ``seen`` has the number of training texts of each form. A passage is anchored at its rarest
    form; passages are sharded by anchor into Aho-Corasick automata of bounded size, and a
    training text is scanned, whole, in the shards whose anchors it holds. One task scans one
    block of texts with one automaton. Passages with a form that no training text holds are left out.
    """
    distinct = pieces.select("piece").distinct()
    parts = distinct.select("piece", F.explode(F.array_distinct(F.split("piece", SEP))).alias("form")).join(seen, "form", "left")
    anchored = parts.groupBy("piece").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "form")).alias("a")).filter("a.texts > 0")
    anchored = materialize(anchored.select("piece", F.col("a.form").alias("anchor"), F.monotonically_increasing_id().alias("passage_id")), "passages")
    shards = max(1, -(-anchored.count() // SHARD_PIECES))
    passages = anchored.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    held = train.select("train_id", F.explode(F.array_distinct(F.split("text", SEP))).alias("anchor")).join(passages.select("anchor", "shard").distinct(), "anchor")
    routed = materialize(held.select("train_id", "shard").distinct().join(train.select("train_id", "text"), "train_id"), "routed")
    # a shard with many passages or texts is split into more automata and blocks
    sizes = passages.groupBy("shard").agg(F.count("*").alias("pieces"))
    loads = routed.groupBy("shard").agg(F.sum(F.length("text")).alias("chars"))
    layout = materialize(sizes.join(loads, "shard").select("shard", F.ceil(F.col("pieces") / SHARD_PIECES).alias("parts"), F.ceil(F.col("chars") / BLOCK_CHARS).alias("blocks")), "layout")
    up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    left = passages.join(layout, "shard").withColumn("part", F.pmod(F.xxhash64("piece"), F.col("parts"))).withColumn("block", up_to("blocks"))
    right = routed.join(layout, "shard").withColumn("block", F.pmod(F.xxhash64("train_id"), F.col("blocks"))).withColumn("part", up_to("parts"))
    keys = ["shard", "part", "block"]
    scans = layout.agg(F.sum(F.col("parts") * F.col("blocks"))).first()[0] or 1  # few bytes and much work: about one task for each scan
    left = left.select(*keys, "passage_id", "piece").repartition(scans, *keys)
    right = right.select(*keys, "train_id", "text").repartition(scans, *keys)
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _scan(a, b), "passage_id bigint, train_id bigint, first int, last int")
    return materialize(hits.join(anchored.select("passage_id", "piece"), "passage_id").select("piece", "train_id", "first", "last"), "hits")


def _cut(texts: DataFrame, forms: int) -> DataFrame:
    """(eval_id, n, edits, start, stop, piece) of every passage, as ``cut_passages`` cuts."""
    return (
        texts.select("eval_id", "n", F.split("text", SEP).alias("f"))
        .withColumn("edits", F.expr("int((15 * (n * 100 div 85)) div 100)"))
        .withColumn("parts", F.least("n", F.greatest(F.col("edits") + 2, F.floor(F.col("n") / forms).cast("int"))))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("start", F.expr("int(bigint(n) * k div parts)"))
        .withColumn("stop", F.expr("int(bigint(n) * (k + 1) div parts)"))
        .select("eval_id", "n", "edits", "start", "stop", F.array_join(F.slice("f", F.col("start") + 1, F.col("stop") - F.col("start")), SEP).alias("piece"))
    )


def _rarest(passages: DataFrame, counts: DataFrame) -> DataFrame:
    """Of each evaluation text the edits + 1 passages that the fewest training texts hold: edits cannot touch all of
    them, so every near text holds one of them whole, and passages that many texts share are not looked up."""
    ranked = passages.join(counts, "piece", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    place = F.row_number().over(W.partitionBy("eval_id").orderBy("texts", "start"))
    return ranked.withColumn("place", place).filter(F.col("place") <= F.col("edits") + 1).drop("place")


def _meetings(kept: DataFrame, hits: DataFrame) -> DataFrame:
    """(eval_id, train_id) that share a passage at about the same place."""
    wanted = kept.filter("texts > 0").groupBy("eval_id", "piece").agg(F.min("start").alias("low"), F.max("start").alias("high"), F.first("edits").alias("edits"))
    met = wanted.join(hits, "piece").filter((F.col("first") <= F.col("high") + F.col("edits")) & (F.col("last") >= F.col("low") - F.col("edits")))
    return met.select("eval_id", "train_id").distinct()


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lists = [(x.split(SEP), y.split(SEP)) for x, y in zip(batch["eval_text"], batch["train_text"])]
        batch["distance"] = pd.array([edits(x, y, most_edits(max(len(x), len(y)))) for x, y in lists], "Int32")
        yield batch.loc[batch["distance"].notna(), ["eval_id", "train_id", "distance"]]


@dataclass
class Overlap:
    """``pairs``: train_no, eval_no, split, distance of every near pair; copies of a text take part with each sentence.
    ``coverage``: sent_no, split, forms, covered of every compared evaluation sentence, with the forms that lie in passages of training texts."""

    pairs: DataFrame
    coverage: DataFrame


def overlaps(sentences: DataFrame) -> Overlap:
    """Evaluation sentences that occur, exactly or almost, in training sentences.

    Each distinct evaluation list is cut into at least two passages more than edits are
    allowed. Automata find the training texts that hold a passage, one row for each, never
    pairs. Of each evaluation list only the edits + 1 passages that fewest training texts hold
    are then looked up, so a passage that many share brings no pairs; where even these are many
    (PLENTY), the list is cut into single forms, if that brings fewer. What is left is decided by
    the edit distance. No pair is lost: edits leave one of the looked-up passages whole.
    The matched intervals of an evaluation list, merged, are its coverage.
    No training or no evaluation texts give no pairs.
    """
    lists = materialize(comparable(sentences), "lists")
    is_train = F.col("split") == "train"
    texts = materialize(lists.groupBy("text", "n", is_train.alias("is_train")).agg(F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()), "texts")
    train = texts.filter("is_train").select(F.col("id").alias("train_id"), "text")
    held_out = texts.filter("not is_train").select(F.col("id").alias("eval_id"), "text", "n")
    seen = materialize(train.select(F.explode(F.array_distinct(F.split("text", SEP))).alias("form")).groupBy("form").agg(F.count("*").alias("texts")), "seen")

    passages = _cut(held_out, PASSAGE_FORMS)
    hits = passage_hits(passages, train, seen)
    counts = hits.groupBy("piece").agg(F.count("*").alias("texts"))
    kept = materialize(_rarest(passages, counts), "rarest")
    cost = kept.groupBy("eval_id").agg(F.sum("texts").alias("cost"))
    many = cost.filter(F.col("cost") > PLENTY)
    met = _meetings(kept, hits)
    if not many.isEmpty():
        single = _rarest(_cut(held_out.join(many, "eval_id", "left_semi"), 1), seen.withColumnRenamed("form", "piece"))
        cheaper = single.groupBy("eval_id").agg(F.sum("texts").alias("single_cost")).join(many, "eval_id").filter("single_cost < cost").select("eval_id")
        single = materialize(single.join(cheaper, "eval_id", "left_semi"), "single")
        finer = _meetings(single, passage_hits(single, train, seen))
        met = _meetings(kept.join(single.select("eval_id").distinct(), "eval_id", "left_anti"), hits).unionByName(finer)
    both = met.join(held_out.select("eval_id", F.col("text").alias("eval_text"), "n"), "eval_id").join(train.withColumnRenamed("text", "train_text").withColumn("m", F.size(F.split("train_text", SEP))), "train_id")
    both = both.filter(F.abs(F.col("n") - F.col("m")) * 20 <= 3 * F.greatest("n", "m"))
    near = both.select("eval_id", "train_id", "eval_text", "train_text").mapInPandas(_judged, "eval_id bigint, train_id bigint, distance int")

    sentences_of = lists.select("text", "sent_no", "split")
    train_of = sentences_of.filter(is_train).join(train, "text").select("train_id", F.col("sent_no").alias("train_no"))
    eval_of = sentences_of.filter(~is_train).join(held_out, "text").select("eval_id", F.col("sent_no").alias("eval_no"), "split", "n")
    pairs = near.join(eval_of, "eval_id").join(train_of, "train_id").select("train_no", "eval_no", "split", "distance")
    covered = passages.join(counts, "piece", "left_semi").groupBy("eval_id").agg(F.sum(F.col("stop") - F.col("start")).alias("covered"))
    coverage = eval_of.join(covered, "eval_id", "left").select(F.col("eval_no").alias("sent_no"), "split", F.col("n").alias("forms"), F.coalesce("covered", F.lit(0)).alias("covered"))
    return Overlap(pairs, coverage)
