"""Subject areas of documents by one-versus-rest linear classifiers on the hashed word n-grams of their sentences."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.storage import materialize

#: Labelled documents that the classifiers are fitted on at most: of each language those with the smallest
#: hash of doc_id, in numbers that go with the square root of the language's labelled documents.
MAX_LABELLED = 3_200
#: Feature space of each classifier; fixed, so a model has 2**BITS weights.
BITS = 17
SLOTS = 1 << BITS
#: A document is about an area if at least this share of its sentences deals with it.
LEAST_SHARE = 0.25
#: An ending is a stock phrase from this share of the distinct texts on (and in more than one): at most 1/STOCK_SHARE phrases, whatever the size.
STOCK_SHARE = 0.001
#: Longer endings are no phrases; so what is collected has a fixed bound.
STOCK_CHARS = 500
#: A word of the address path or a section (source, its kind, register) is a weak label of an area if readers saw at least
#: WEAK_SEEN documents with it and gave the area to this share of them.
WEAK_TRUST, WEAK_SEEN = 0.5, 20
#: Documents without readers that are fitted with their weak labels at most; those with the smallest hash of doc_id.
MAX_WEAK = 1_600
ROUNDS, STEPS, L2 = 3, 35, 10.0
BATCH_ROWS = 512
#: Areas that one task fits; they share the features of the sample.
AREAS_A_TASK = 4

#: Ends of sentences, for Python and for the JVM: (?:[.!?…]+(?=\s|$)|:\)+|\n)+ with the first character written ahead,
#: so that both find it by a set of characters and don't try the whole at each place.
END = r"[.!?…:\n](?:(?<=[.!?…])[.!?…]*(?=\s|$)|(?<=:)\)+|(?<=\n))(?:[.!?…]+(?=\s|$)|:\)+|\n)*"
_END, _BREAK = re.compile(END), " \0 "
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile("[̀-ͯ]")


class _Words(dict):
    """Word as it stands between blanks to the place of its two hashes, with marks and without; 0 is the break, 1 a word without letters."""

    def __init__(self) -> None:
        super().__init__({"\0": 0})
        self.word, self.bare, self.table = [0, 0], [0, 0], np.zeros((2, 2), np.uint64)

    def __missing__(self, word: str) -> int:
        letters = "".join(_WORD.findall(word))
        if letters:
            bare = _MARKS.sub("", unicodedata.normalize("NFD", letters)).replace("đ", "d")
            self.word.append(zlib.crc32(letters.encode()))
            self.bare.append(zlib.crc32(bare.encode()))
        place = self[word] = len(self.word) - 1 if letters else 1
        return place

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        if self.table.shape[1] != len(self.word):
            self.table = np.array([self.word, self.bare], np.uint64)
        return self.table


_WORDS = _Words()


@dataclass
class Sentences:
    """Sentences with at least one word: features and the sentence of each, and the document of each sentence."""

    feature: np.ndarray
    sentence: np.ndarray
    document: np.ndarray

    def __len__(self) -> int:
        return len(self.document)

    def part(self, keep: np.ndarray) -> Sentences:
        at, chosen = np.cumsum(keep) - 1, keep[self.sentence]
        return Sentences(self.feature[chosen], at[self.sentence[chosen]], self.document[keep])


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    mixed = (a * np.uint64(0x9E3779B1) + np.uint64(salt)) ^ (b * np.uint64(0xC2B2AE35))
    mixed ^= mixed >> np.uint64(17)
    return (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def featurize(texts: list[str]) -> Sentences:
    """Words, pairs of words and pairs of words without marks of every sentence."""
    if len(_WORDS) > 500_000:
        _WORDS.__init__()
    words: list[str] = []
    lengths = []
    for text in texts:
        found = _END.sub(_BREAK, text.lower()).split()
        words += found
        words.append("\0")
        lengths.append(len(found) + 1)
    place = _WORDS.places(words)
    kept = place != 1
    owner, place = np.repeat(np.arange(len(texts)), lengths)[kept], place[kept]
    is_word = place != 0
    run = np.cumsum(~is_word)[is_word]
    first = np.diff(run, prepend=-1) != 0
    sentence = np.cumsum(first) - 1
    document = owner[is_word][first]
    w, b = _WORDS.hashes()[:, place[is_word]]
    near = sentence[1:] == sentence[:-1] if len(w) else np.zeros(0, bool)
    feature = np.concatenate(
        [w & np.uint64(SLOTS - 1), _pair(w[:-1], w[1:], 1)[near], _pair(b[:-1], b[1:], 2)[near]] if len(w) else [w]
    ).astype(np.int64)
    return Sentences(feature, np.concatenate([sentence, sentence[1:][near], sentence[1:][near]] if len(w) else [sentence]).astype(np.int64), document)


def _scale(s: Sentences) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(np.bincount(s.sentence, minlength=len(s)), 1))


def _sums(values: np.ndarray, at: np.ndarray, starts: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Sums of ``values[at]`` between the starts. The values gathered lie in ``room``; mode "clip", for "raise" buffers them."""
    return np.add.reduceat(np.take(values, at, out=room[: len(at)], mode="clip"), starts)


def score(s: Sentences, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Scores of the sentences by each row of weights in ``table``, one row after the other: gathering rows of several weights takes numpy many times as long."""
    starts = np.flatnonzero(np.diff(s.sentence, prepend=-1))  # a sentence's words, pairs and bare pairs lie in three runs
    of = s.sentence[starts]
    cuts = [0, *(np.flatnonzero(np.diff(of) < 0) + 1), len(of)]
    z, room = np.zeros((len(s), len(table))), np.empty(len(s.feature), table.dtype)
    for k, weights in enumerate(table):
        sums = _sums(weights, s.feature, starts, room)
        for a, b in zip(cuts, cuts[1:]):
            z[of[a:b], k] += sums[a:b]
    return z * _scale(s)[:, None] + bias


class Small:
    """The features that occur more than once, numbered anew in the order of ``often``, by sentence and by feature; ``scale`` still counts all."""

    def __init__(self, s: Sentences, often: np.ndarray, scale: np.ndarray) -> None:
        number = np.full(SLOTS, -1)
        number[often] = np.arange(len(often))
        feature, kept = number[s.feature], number[s.feature] >= 0
        feature, sentence = feature[kept], s.sentence[kept]
        order = np.argsort(sentence, kind="stable")
        self.feature, self.size, self.scale, self.n = feature[order], len(often), scale, len(s)
        self.rows, self.row_at = np.unique(sentence[order], return_index=True)
        order = np.argsort(feature, kind="stable")
        self.sentence = sentence[order]
        self.columns, self.column_at = np.unique(feature[order], return_index=True)
        self.room = np.empty(len(feature))

    def score(self, weights: np.ndarray, bias: float) -> np.ndarray:
        z = np.zeros(self.n)
        if len(self.rows):
            z[self.rows] = _sums(weights, self.feature, self.row_at, self.room)
        return z * self.scale + bias

    def fit(self, y: np.ndarray, trust: np.ndarray) -> tuple[np.ndarray, float]:
        """Logistic regression with L2 by adaptive gradient steps over all sentences."""
        weights, bias = np.zeros(self.size), -2.0
        seen, seen_bias = np.full(self.size, 1e-8), 1e-8
        for _ in range(STEPS):
            error = (1 / (1 + np.exp(-self.score(weights, bias))) - y) * trust
            gradient = 0.02 * L2 * weights
            if len(self.columns):
                gradient[self.columns] += _sums(error * self.scale, self.sentence, self.column_at, self.room)
            seen += gradient**2
            seen_bias += error.sum() ** 2
            weights -= 0.5 * gradient / np.sqrt(seen)
            bias -= 0.5 * error.sum() / np.sqrt(seen_bias)
        return weights, float(bias)


def shares(s: Sentences, deals: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(s.document, deals, n) / np.maximum(np.bincount(s.document, minlength=n), 1)


def dealing(s: Sentences, margin: np.ndarray, n: int) -> np.ndarray:
    """Sentences of each document that deal with each area. A sentence that could deal with several, for
    areas share some words, counts for the one that fits best with it and with its document."""
    over = margin > 0
    count = lambda deals: np.stack([np.bincount(s.document, deals[:, k], n) for k in range(margin.shape[1])], 1)
    share = count(over) / np.maximum(np.bincount(s.document, minlength=n), 1)[:, None]
    fits = np.where(over, margin + np.log(share[s.document] + 0.02), -np.inf)
    best = np.zeros_like(over)
    best[np.arange(len(s)), fits.argmax(1)] = True
    return count(best & over)


def train_areas(texts: list[str], fold: np.ndarray, labelled: list[np.ndarray], read: np.ndarray) -> list[tuple[np.ndarray, float, float]]:
    """Weights, bias and the sentence threshold for each area, given its labelled documents; the labels of documents that were not ``read`` are weak ones.

    Readers label documents, so which sentences deal with the area is found in rounds: each
    half is scored by a classifier of the other half, sentences of labelled documents that
    look like those of others are taken for general ones, and unlabelled documents with much
    of the area are left out as probably incomplete. The threshold is the one under which
    ``LEAST_SHARE`` agrees best with the readers, on scores of the other half; weak labels have no say in it.
    The features of the sentences are found once for all areas.
    """
    s = featurize(texts)
    n = len(texts)
    if not len(s):
        return [(np.zeros(SLOTS), -9.0, 0.0) for _ in labelled]
    half, scale = fold[s.document], _scale(s)
    counts = np.bincount(s.feature, minlength=SLOTS)
    often = np.argsort(-counts, kind="stable")[: (counts > 1).sum()]  # the most frequent lie together in memory
    whole = Small(s, often, scale)
    halves = [Small(s.part(half == k), often, scale[half == k]) for k in (0, 1)]

    def one(labelled: np.ndarray) -> tuple[np.ndarray, float, float]:
        if not labelled.any():
            return np.zeros(SLOTS), -9.0, 0.0
        mine = labelled[s.document]
        y, trust, z = mine.astype(float), np.ones(len(s)), np.zeros(len(s))
        for _ in range(ROUNDS):
            for k in (0, 1):
                if halves[k].n and halves[1 - k].n:
                    z[half != k] = halves[1 - k].score(*halves[k].fit(y[half == k], trust[half == k]))
            least = np.quantile(z[~mine], 0.98) if (~mine).any() else -9.0
            share = shares(s, z > least, n)[s.document]
            y = np.where(mine & (z > least), 1.0, 0.0)
            trust = np.where(mine & (z <= least) & (share > 0), 0.5, 1.0)
            trust[~mine & (share >= 0.2) & (z > least)] = 0
        weights = np.zeros(SLOTS)
        weights[often], bias = whole.fit(y, trust)
        grid = np.linspace(-4, 1, 51)
        about = [shares(s, z > t, n) >= LEAST_SHARE for t in grid]
        quality = np.array([2 * (a & labelled & read).sum() / max(1, (a & read).sum() + (labelled & read).sum()) for a in about])
        # the middle of the thresholds that do about equally well
        return weights, bias, float(np.median(grid[quality >= quality.max() - 0.004]))

    return [one(x) for x in labelled]


_MODEL = "subject_id int, bias double, threshold double, weights array<float>"


def section_keys(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, field, value): the words of each document's address path and its section metadata, from which weak labels are drawn.

    Path words are lower-cased runs of letters; null addresses, sources and registers give no key.
    """
    path = F.lower(F.coalesce(F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1), F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(path, F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))
    key = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    kinds = sources.select(F.col("source_id").alias("source"), "kind").dropDuplicates(["source"])
    rows = documents.select("doc_id", "source", "register", words.alias("words")).join(kinds, "source", "left")
    own = F.array(key("source", F.col("source")), key("kind", F.col("kind")), key("register", F.col("register")))
    return rows.select("doc_id", F.explode(F.concat(own, F.transform("words", lambda w: key("path", w)))).alias("k")).select("doc_id", "k.*").filter("value is not null and doc_id is not null")


def weak_rules(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """(field, value, subject_id, seen, given): of the documents with that key that readers saw, how many got the area from one of them."""
    read = labels.filter("doc_id is not null").select("doc_id", "subject_id").distinct()
    known = keys.join(read.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    seen = known.groupBy("field", "value").agg(F.count("*").alias("seen"))
    given = known.join(read.filter("subject_id is not null"), "doc_id").groupBy("field", "value", "subject_id").agg(F.count("*").alias("given"))
    return given.join(seen, ["field", "value"]).select("field", "value", "subject_id", "seen", "given")


def weak_labels(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, subject_id) of every document with a key that readers confirm often enough."""
    trusted = rules.filter((F.col("seen") >= WEAK_SEEN) & (F.col("given") >= WEAK_TRUST * F.col("seen")))
    return keys.join(trusted, ["field", "value"]).select("doc_id", "subject_id").distinct()


def train(documents: DataFrame, labels: DataFrame, areas: DataFrame, sources: DataFrame) -> DataFrame:
    """One model per area, AREAS_A_TASK fitted in one task, all on the same bounded sample of labelled documents.

    The sample is MAX_LABELLED documents that readers saw and MAX_WEAK others with weak labels at
    most; a label of any reader counts, a null one says that the reader saw none. Null texts
    have no sentences. Areas without labels get a model that never says yes.
    """
    read = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject_id").alias("said"))
    known = read.join(documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang")).distinct(), "doc_id").dropDuplicates(["doc_id"])
    known = materialize(known, "labelled")
    sizes = known.groupBy("lang").agg(F.sqrt(F.count("*")).alias("root"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) * F.col("root")  # about the rank by hash over the root of the language's size
    drawn = known.join(sizes, "lang").orderBy(place, "doc_id").limit(MAX_LABELLED).select("doc_id", "said", F.lit(True).alias("read"))
    keys = section_keys(documents, sources)
    weak = weak_labels(keys, weak_rules(keys, labels)).join(read, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set("subject_id").alias("said"))
    weak = weak.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_WEAK).withColumn("read", F.lit(False))
    chosen = materialize(drawn.unionByName(weak), "chosen")
    sample = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # MAX_LABELLED + MAX_WEAK rows at most
    ids = [r[0] for r in areas.select("subject_id").filter("subject_id is not null").distinct().orderBy("subject_id").collect()]  # a closed list of fixed size

    blocks = [ids[k : k + AREAS_A_TASK] for k in range(0, len(ids), AREAS_A_TASK)]

    def block(sample: pd.DataFrame) -> pd.DataFrame:
        own = blocks[int(sample["block"].iloc[0])]
        sample = sample.sort_values("doc_id")
        fold = np.array([zlib.crc32(str(d).encode()) & 1 for d in sample["doc_id"]])
        said = [set(x) for x in sample["said"]]
        labelled = [np.array([area in x for x in said]) for area in own]
        models = train_areas(sample["text"].tolist(), fold, labelled, sample["read"].to_numpy(bool))
        return pd.DataFrame([(area, bias, threshold, weights.astype(np.float32)) for area, (weights, bias, threshold) in zip(own, models)], columns=["subject_id", "bias", "threshold", "weights"])

    each = materialize(sample, "sample").withColumn("block", F.explode(F.array(*[F.lit(k) for k in range(len(blocks))]).cast("array<int>")))
    return each.repartitionById(max(1, len(blocks)), "block").groupBy("block").applyInPandas(block, _MODEL)


def stock_endings(documents: DataFrame) -> set[str]:
    """Last sentences that many different texts share; at most 1/STOCK_SHARE of them by the bound on their share, each of STOCK_CHARS at most."""
    line = F.substring_index(F.rtrim(F.col("text"), F.lit(" \t\r\n")), "\n", -1)
    last = F.lower(F.trim(F.try_element_at(F.filter(F.split(line, END), lambda x: F.trim(x) != ""), F.lit(-1))))
    ends = documents.filter("text is not null").select(F.xxhash64("text").alias("h"), last.alias("ending")).distinct()
    # texts without a sentence are left out of the table written, for Spark would push the condition down and find each ending twice
    counts = materialize(ends.groupBy("ending").agg(F.count("*").alias("n")), "endings").filter("ending is not null")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r[0] for r in counts.filter((F.col("n") >= max(2, STOCK_SHARE * total)) & (F.length("ending") <= STOCK_CHARS)).select("ending").collect()}


def classify(documents: DataFrame, models: DataFrame, endings: set[str]) -> DataFrame:
    """(doc_id, subject_id, share): each area that at least LEAST_SHARE of a text's sentences deals with.

    Texts are read whole. A stock phrase at the end is not counted; null, empty and blank texts
    and texts about none of the areas give no row. ``models`` has one row per area.
    """
    rows = sorted(models.collect(), key=lambda r: r["subject_id"])  # one fixed-size model per area
    ids = np.array([r["subject_id"] for r in rows], np.int32)
    table = np.array([r["weights"] for r in rows], np.float32) if rows else np.zeros((0, SLOTS), np.float32)
    bias, threshold = np.array([r["bias"] for r in rows]), np.array([r["threshold"] for r in rows])
    shared = documents.sparkSession.sparkContext.broadcast((ids, table, bias, threshold, endings))

    def without_ending(text: str, endings: set[str]) -> str:
        line = text[text.rstrip().rfind("\n") + 1 :]
        last = _END.sub("\n", line + "\n").rstrip("\n \t").rpartition("\n")[2].strip()
        return text[: text.rfind(last)] if last and last.lower() in endings else text

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, table, bias, threshold, endings = shared.value
        for batch in batches:
            for part in (batch.slice(k, BATCH_ROWS) for k in range(0, batch.num_rows, BATCH_ROWS)):
                texts = [without_ending(t, endings) if t else "" for t in part.column(1).to_pylist()]
                s = featurize(texts)
                if not len(s) or not len(ids):
                    continue
                z = score(s, table, bias)
                total = np.bincount(s.document, minlength=len(texts))
                by = dealing(s, z - threshold, len(texts))
                about = (by >= LEAST_SHARE * total[:, None]) & (by > 0)
                d, k = np.nonzero(about)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(d)), pa.array(ids[k], pa.int32()), pa.array(by[d, k] / total[d], pa.float64())], ["doc_id", "subject_id", "share"]
                )

    return documents.select("doc_id", "text").mapInArrow(judge, "doc_id bigint, subject_id int, share double")
