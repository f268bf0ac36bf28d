"""Queries on words, labels and records: statistics, contracts between tables, sources and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbora.functions import text as tx
from arbora.functions.vocabulary import BASE_LABELS, DIRECTION_FORMS, FOCUS_FORMS, MARKER, REGISTERS, SOURCES, UPOS
from arbora.sources import conllu
from arbora.storage import table

#: The ids of annotated sentences, and what is asked of an annotated set.
SENT_ID = "^src-[0-9]{3}-(train|dev|test)-[0-9]+$"
HASHED_ID = "^[0-9a-f]{64}:[0-9]+$"
LEAST_SENTENCES, LEAST_TAGS, MOST_SYNTHETIC = 20, 10, 0.2


def _at(toks: Column | str, wanted: Column) -> Column:
    """The token with that id: at its place where ids count from 1, else by search."""
    there = F.get(toks, F.coalesce(wanted, F.lit(0)) - 1)
    return F.when(there["id"] == wanted, there).otherwise(F.try_element_at(F.filter(toks, lambda x: x["id"] == wanted), F.lit(1)))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per token beside its head and the next token, and whether a marker hangs on it; looked up within the sentence, without a join."""
    s = table(spark, sf_dir, "conllu_sentences").select("sent_no", "split", "toks")
    s = s.withColumn("marked", F.transform(F.filter("toks", lambda c: (F.lower(c["form"]) == MARKER) & (c["deprel"] == "case")), lambda c: c["head"]))
    beside = F.transform("toks", lambda t: F.struct(t.alias("t"), _at("toks", t["head"]).alias("h"), _at("toks", t["id"] + 1).alias("n"), F.array_contains("marked", t["id"]).alias("marked")))
    return s.select("sent_no", "split", F.explode(beside).alias("x")).select("sent_no", "split", "x.*")


def stub_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at white space and parsed as stars (first word root, others ``dep`` below it): counts per language."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("?")).alias("lang"), F.size(tx.words(F.col("text"))).cast("bigint").alias("n"))
    some = F.col("n") > 0
    return docs.groupBy("lang").agg(
        F.count("*").alias("documents"), F.count_if(some).alias("roots"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("dependents"), F.max("n").alias("longest")
    )


def stub_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every text as parsed tokens."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.words(F.col("text"))).alias("idx", "form"))
    first = F.col("idx") == 0
    return rows.select("doc_id", "idx", "form", F.lit("X").alias("upos"), F.when(first, 0).otherwise(1).alias("head"), F.when(first, "root").otherwise("dep").alias("deprel"))


def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label in use with its base, or null where it is unknown."""
    return table(spark, sf_dir, "ud_tokens").groupBy("deprel").agg(F.count("*").alias("n")).select("deprel", tx.label_base(F.col("deprel")).alias("base"), "n")


def label_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by split."""
    rows = table(spark, sf_dir, "conllu_sentences").select("split", F.explode("toks").alias("t")).groupBy(F.col("t.deprel").alias("deprel"))
    return rows.pivot("split", ["train", "dev", "test"]).count().fillna(0, ["train", "dev", "test"])


def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the union of all splits, with the splits they occur in."""
    labels = table(spark, sf_dir, "conllu_sentences").select("split", F.explode("toks.deprel").alias("deprel"))
    return labels.groupBy("deprel").agg(F.bool_or(F.col("split") == "train").alias("in_train"), F.bool_or(F.col("split") != "train").alias("in_held_out"))


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, tags and numbers of syllables per form, as one table."""
    tok = table(spark, sf_dir, "conllu_sentences").select(F.explode("toks").alias("t"))
    syllables = F.size(tx.words(F.col("t.form"))).cast("string")
    kinds = [("deprel", F.col("t.deprel")), ("upos", F.col("t.upos")), ("syllables", syllables)]
    return tok.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in kinds])).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, tokens, words of several syllables and emoticons per split."""
    s = table(spark, sf_dir, "conllu_sentences").select("split", F.coalesce("toks", F.array()).alias("toks"))
    several = F.size(F.filter("toks", lambda t: F.size(tx.words(t["form"])) > 1))
    return s.groupBy("split").agg(
        F.count("*").alias("sentences"), F.sum(F.size("toks")).alias("tokens"), F.sum(several).alias("multisyllabic"), F.sum(F.size(F.filter("toks", lambda t: t["form"] == ":))"))).alias("emoticons")
    )


def focus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the focus forms are used: label, tag and the head's label and tag."""
    tok = _tokens(spark, sf_dir).select(F.lower("t.form").alias("form"), "t", "h").filter(F.col("form").isin(FOCUS_FORMS))
    of = {"deprel": F.col("t.deprel"), "upos": F.col("t.upos"), "head_upos": F.coalesce("h.upos", F.lit("ROOT")), "head_deprel": F.coalesce("h.deprel", F.lit("ROOT"))}
    return tok.select("form", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in of.items()])).alias("x")).groupBy("form", "x.kind", "x.value").agg(F.count("*").alias("n"))


def _in(column: str, values: list[str]) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


# The patterns of a token t beside its head h and the next token n: when they show, and what is counted of them.
# The keys of the cases.
_VERB_BELOW_GO = "lower(h.form) = 'đi' and t.upos = 'VERB' and t.id > h.id"
PATTERNS = {
    "direction_form": (_in("lower(t.form)", DIRECTION_FORMS), "t.deprel"),
    "direction_verb": (_in("lower(t.form)", DIRECTION_FORMS) + " and t.upos = 'VERB'", "t.deprel"),
    "verb_below_di": (_VERB_BELOW_GO, "t.deprel"),
    "verb_next_to_di": (f"{_VERB_BELOW_GO} and t.id = h.id + 1", "t.deprel"),
    "di_and_next_verb": ("lower(t.form) = 'đi' and n.upos = 'VERB'", "if(n.head = t.id, 'di_is_head', if(t.head = n.id, 'following_verb_is_head', 'no_direct_arc'))"),
    "compound_order": ("t.deprel in ('compound:svc', 'compound:dir')", "concat(t.deprel, ':head_', if(t.head < t.id, 'left', 'right'))"),
    "classifier_pair": ("h is not null and t.deprel in ('clf', 'clf:det')", "concat(t.deprel, ':', h.upos, '->', t.upos)"),
    "possessive": ("t.deprel = 'nmod:poss'", "if(marked, 'with_marker', 'without_marker')"),
    "object_position": ("h is not null and split_part(t.deprel, ':', 1) = 'obj'", "if(t.id < t.head, 'before_head', 'after_head')"),
}


def patterns_of(beside: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """(pattern, key, n) over tokens beside their neighbours: all patterns in one pass."""
    shown = [F.when(F.expr(when), F.struct(F.lit(name).alias("pattern"), F.expr(key).alias("key"))) for name, (when, key) in patterns.items()]
    return beside.select(F.explode(F.array_compact(F.array(*shown))).alias("p")).groupBy("p.pattern", "p.key").agg(F.count("*").alias("n"))


def head_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all head and neighbour patterns."""
    return patterns_of(_tokens(spark, sf_dir), PATTERNS)


def compound_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serial and directional compounds of the parsed sentences whose head follows."""
    tok = table(spark, sf_dir, "ud_tokens").filter(F.col("deprel").isin("compound:svc", "compound:dir") & (F.col("head") > F.col("idx") + 1))
    return tok.select("sent_id", (F.col("idx") + 1).alias("dependent_id"), F.col("deprel").alias("label")).distinct()


def _violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows where a rule does not hold; null holds for none. One pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for name in rules for x in (F.lit(name), F.col(name))])).alias("rule", "violations"))


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of parsed words against their schema, rule by rule."""
    return _violations(
        table(spark, sf_dir, "ud_tokens"),
        {"sent_id": F.length("sent_id") >= 1, "idx": F.col("idx") >= 0, "form": F.length("form") >= 1, "upos": F.col("upos").isin(UPOS),
         "head": F.col("head") >= 0, "deprel": F.col("deprel").isin(BASE_LABELS), "source": F.col("source").isin(SOURCES)},
    )


def segment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of segmented words against their schema; ``upos`` may be null, and a record must have tokens."""
    seg = table(spark, sf_dir, "seg_sentences")
    rows = seg.select("sent_id", "register", "source", F.explode("tokens").alias("t"))
    by_row = _violations(
        rows,
        {"sent_id": F.length("sent_id") >= 1, "register": F.col("register").isin(REGISTERS), "idx": F.col("t.idx") >= 0, "form": F.length("t.form") >= 1,
         "upos": F.col("t.upos").isNull() | F.col("t.upos").isin(UPOS), "source": F.col("source").isin(SOURCES)},
    )
    return by_row.unionByName(_violations(seg, {"tokens": F.size("tokens") > 0}))


def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per corpus: words after keeping the last loaded row of each place, and rows dropped by that."""
    rows = table(spark, sf_dir, "ud_tokens")
    last = rows.groupBy("corpus", "sent_id", "idx").agg(F.count("*").alias("n"), F.max_by("form", F.struct("loaded_at", "form")).alias("form"))
    return last.groupBy("corpus").agg(F.count("*").alias("words"), F.sum(F.col("n") - 1).alias("dropped"), F.count("form").alias("with_form"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences whose idx do not run from 0 without holes."""
    s = table(spark, sf_dir, "ud_tokens").select("sent_id", "idx").distinct().groupBy("sent_id").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n"))
    return s.filter("not (first_idx = 0 and last_idx = n - 1)")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table: sentences, and those whose document is not stored."""
    known = table(spark, sf_dir, "documents").select(F.col("content_hash").alias("hash")).distinct()
    out = None
    for name in ("ud_tokens", "seg_sentences"):
        ids = table(spark, sf_dir, name).select("sent_id").distinct().withColumn("hash", F.substring_index("sent_id", ":", 1))
        part = ids.join(known.withColumn("found", F.lit(1)), "hash", "left").agg(F.count("*").alias("sentences"), F.count_if(F.col("found").isNull()).alias("orphans")).withColumn("source_table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: texts, and those whose stored digest, length or canonical form does not hold."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.groupBy("source").agg(
        F.count("*").alias("texts"), F.count_if(F.sha2(F.col("text").cast("binary"), 256) != F.col("content_hash")).alias("other_digest"),
        F.count_if(F.length("text") != F.col("n_chars")).alias("other_length"), F.count_if(~tx.is_nfc(F.col("text"))).alias("not_nfc"), F.sum(tx.token_estimate(F.col("text"))).alias("token_estimate"),
    )


def repeated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest over language and text, with the documents that share it."""
    d = table(spark, sf_dir, "documents").select("doc_id", tx.joined_digest(F.col("lang"), F.col("text")).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc_id")).filter("documents > 1")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of proper nouns as mentions ``sent_id:start:end`` (end exclusive)."""
    rows = table(spark, sf_dir, "ud_tokens").select("sent_id", "idx", "upos").distinct().filter("upos = 'PROPN'")
    run = F.col("idx") - F.row_number().over(W.partitionBy("sent_id").orderBy("idx"))
    runs = rows.withColumn("run", run).groupBy("sent_id", "run").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"))
    return runs.select("sent_id", tx.mention_id(F.col("sent_id"), F.col("start"), F.col("end")).alias("mention_id"), (F.col("end") - F.col("start")).alias("n_words"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each form stands in its sentence's text: the k-th of equal forms at the k-th occurrence that does not overlap; -1 if there is none.

    A text is searched once for each distinct form, and the occurrences meet the tokens by their number.
    """
    s = table(spark, sf_dir, "conllu_sentences").select("sent_no", F.try_element_at("metadata", F.lit("text")).alias("text"), "toks").filter("text is not null")
    rows = s.select("sent_no", F.explode("toks").alias("t")).select("sent_no", F.col("t.id").alias("id"), F.col("t.form").alias("form")).filter("form <> ''")
    numbered = rows.withColumn("k", F.row_number().over(W.partitionBy("sent_no", "form").orderBy("id")))
    forms = s.select("sent_no", "text", F.explode(F.array_distinct("toks.form")).alias("form")).filter("form <> ''")
    gaps_between = F.transform(F.split("text", F.concat(F.lit("\\Q"), F.replace("form", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1), lambda p: F.length(p))
    pieces = forms.select("sent_no", "form", gaps_between.alias("g")).select("sent_no", "form", F.posexplode(F.slice("g", F.lit(1), F.size("g") - 1)).alias("p", "gap"))
    so_far = F.sum("gap").over(W.partitionBy("sent_no", "form").orderBy("p"))
    found = pieces.select("sent_no", "form", (F.col("p") + 1).alias("k"), (so_far + F.col("p") * F.length("form")).cast("int").alias("start"))
    return numbered.join(found, ["sent_no", "form", "k"], "left").select("sent_no", "id", F.coalesce("start", F.lit(-1)).alias("char_start"))


def recovered_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: forms, those found in their text, and those that the found place gives back when it is cut out."""
    s = table(spark, sf_dir, "conllu_sentences")
    forms = s.select("sent_no", "split", F.try_element_at("metadata", F.lit("text")).alias("text"), F.explode("toks").alias("t")).select("sent_no", "split", "text", F.col("t.id").alias("id"), F.col("t.form").alias("form"))
    placed = forms.join(occurrences(spark, sf_dir), ["sent_no", "id"], "left")
    back = F.substring(F.col("text"), F.col("char_start") + 1, F.length("form"))
    return placed.groupBy("split").agg(
        F.count("*").alias("forms"), F.count_if(F.col("char_start") >= 0).alias("found"), F.count_if((F.col("char_start") >= 0) & (back == F.col("form"))).alias("recovered")
    )


def annotation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences against the rules for annotated metadata, rule by rule."""
    s = table(spark, sf_dir, "conllu_sentences").withColumn("toks", F.coalesce("toks", F.array()))
    m = lambda key: F.try_element_at("metadata", F.lit(key))
    spoken = F.array_join(F.transform("toks", lambda t: t["form"]), " ")
    tags = F.filter(F.transform(F.split(F.coalesce(m("constructions"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return _violations(
        s,
        {"sent_id": F.trim(m("sent_id")) != "", "register": m("register").isin(REGISTERS), "synthetic": m("synthetic").isin("true", "false"), "uncertain": m("uncertain").isin("true", "false"),
         "accessed": m("accessed").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.expr("try_to_timestamp(metadata['accessed'], 'yyyy-MM-dd')").isNotNull(),
         "source_url": (m("synthetic") != "false") | m("source_url").rlike("^https?://[^/?#]+"), "text": m("text") == spoken, "nfc": tx.is_nfc(m("text")),
         "id_pattern": m("sent_id").rlike(SENT_ID), "repeated_tags": F.size(tags) == F.size(F.array_distinct(tags))},
    )


def constructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Construction tags of the metadata with their sentences, and the share of synthetic ones."""
    s = table(spark, sf_dir, "conllu_sentences").select("sent_no", F.try_element_at("metadata", F.lit("synthetic")).alias("synthetic"), F.explode(F.split(F.try_element_at("metadata", F.lit("constructions")), ",")).alias("tag"))
    tags = s.select("sent_no", F.trim("tag").alias("tag"), "synthetic").filter("tag <> ''").distinct()
    return tags.groupBy("tag").agg(F.count("*").alias("sentences"), F.avg(F.when(F.col("synthetic") == "true", 1.0).otherwise(0.0)).alias("synthetic_share"))


def coverage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: sentences, distinct construction tags and the share of synthetic sentences, and whether they reach what is asked of an annotated set."""
    tag = F.explode_outer(F.split(F.try_element_at("metadata", F.lit("constructions")), ","))
    rows = table(spark, sf_dir, "conllu_sentences").select("sent_no", "split", F.try_element_at("metadata", F.lit("synthetic")).alias("synthetic"), tag.alias("tag"))
    sums = rows.groupBy("split").agg(
        F.count_distinct("sent_no").alias("sentences"), F.count_distinct(F.nullif(F.trim("tag"), F.lit(""))).alias("tags"), F.count_distinct(F.when(F.col("synthetic") == "true", F.col("sent_no"))).alias("synthetic")
    )
    return sums.withColumn("enough", (F.col("sentences") >= LEAST_SENTENCES) & (F.col("tags") >= LEAST_TAGS) & (F.col("synthetic") < MOST_SYNTHETIC * F.col("sentences")))


def split_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: distinct sentence ids and labels, ids that train holds too, and labels that are not in the vocabulary."""
    s = table(spark, sf_dir, "conllu_sentences").select("split", F.try_element_at("metadata", F.lit("sent_id")).alias("sent_id"), "toks")
    ids = s.filter("sent_id is not null").groupBy("sent_id").agg(F.collect_set("split").alias("splits"))
    shared = ids.select(F.explode("splits").alias("split"), F.array_contains("splits", "train").alias("in_train")).groupBy("split").agg(F.count("*").alias("ids"), F.count_if("in_train").alias("ids_in_train"))
    known = table(spark, sf_dir, "deprel_labels").select(F.col("label").alias("deprel"), F.lit(True).alias("known"))
    labels = s.select("split", F.explode("toks.deprel").alias("deprel")).distinct().join(known, "deprel", "left")
    return shared.join(labels.groupBy("split").agg(F.count("*").alias("labels"), F.count_if(F.col("known").isNull()).alias("unknown_labels")), "split")


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated trees beside the star parse of the same words: the first is the root, all others are ``dep`` below it."""
    gold = table(spark, sf_dir, "conllu_sentences").select("sent_no", "split", F.posexplode("toks").alias("p", "t"), F.get("toks", F.lit(0))["id"].alias("top"))
    first = F.col("p") == 0
    return gold.select("sent_no", "split", "t.id", "t.head", "t.deprel", F.when(first, 0).otherwise(F.col("top")).alias("sys_head"), F.when(first, "root").otherwise("dep").alias("sys_deprel"))


def attachment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled and labelled attachment of the star parse per split."""
    same_head, same_label = F.col("head") == F.col("sys_head"), F.col("deprel") == F.col("sys_deprel")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return _compared(spark, sf_dir).groupBy("split").agg(F.count("*").alias("words"), share(same_head).alias("uas"), share(same_head & same_label).alias("las"))


def differing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sentence: words in which annotation and star parse differ."""
    differs = (F.col("head") != F.col("sys_head")) | (F.col("deprel") != F.col("sys_deprel"))
    return _compared(spark, sf_dir).groupBy("sent_no").agg(F.count("*").alias("words"), F.count_if(differs).alias("differing"))


def syllables_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per corpus: segmented words whose document is stored, and those with a syllable that its text, both in NFC, does not hold."""
    seg = table(spark, sf_dir, "seg_sentences").select("corpus", F.lower(F.substring_index(F.trim("sent_id"), ":", 1)).alias("hash"), F.explode("tokens.syllables").alias("syllables"))
    seg = seg.groupBy("corpus", "hash", "syllables").agg(F.count("*").alias("n")).withColumn("joined", tx.nfc(F.array_join("syllables", "\n")))
    texts = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("content_hash").alias("hash"), "text").dropDuplicates(["hash"]).select("hash", tx.nfc(F.col("text")).alias("text"))
    missing = F.exists(F.split("joined", "\n"), lambda x: ~F.contains(F.col("text"), x))
    judged = seg.join(texts, "hash").select("corpus", "n", missing.alias("missing"))
    return judged.groupBy("corpus").agg(F.sum("n").alias("words"), F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("astray"))


def line_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of every sentence of the line files."""
    return conllu.metadata(conllu.sentence_lines(table(spark, sf_dir, "conllu_lines")))


def strict_read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a strict reader stops, sentence by sentence."""
    return conllu.first_errors(conllu.sentence_lines(table(spark, sf_dir, "conllu_lines")))


def line_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strict layout asks of each line file."""
    return conllu.layout(table(spark, sf_dir, "conllu_lines"))


def sent_id_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table: sentence ids, those of the form ``content_hash:number``, and those that have it once they are built anew from their trimmed, lower-cased parts."""
    out = None
    for name in ("ud_tokens", "seg_sentences"):
        ids = table(spark, sf_dir, name).select("sent_id").distinct().filter("sent_id is not null")
        parts = F.split(F.lower(F.trim("sent_id")), ":")
        built = F.concat_ws(":", F.trim(parts[0]), F.trim(F.get(parts, F.lit(1))))
        part = ids.agg(F.count("*").alias("ids"), F.count_if(F.col("sent_id").rlike(HASHED_ID)).alias("well_formed"), F.count_if(built.rlike(HASHED_ID)).alias("rebuilt")).withColumn("source_table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def loose_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file, read without judging fields: sentences with tokens, those whose comments name no sent_id, tokens, and rows skipped as several words (``-`` in the id) or as empty nodes (``.``)."""
    numbered = conllu.sentence_lines(table(spark, sf_dir, "conllu_lines"))
    first = F.substring_index("line_text", "\t", 1)
    note, skipped = F.col("line_text").startswith("#"), first.contains("-") | first.contains(".")
    per = numbered.groupBy("file_name", "sentence").agg(
        F.count_if(~note & ~skipped).alias("tokens"), F.count_if(~note & first.contains("-")).alias("multiword"), F.count_if(~note & ~first.contains("-") & first.contains(".")).alias("empty_nodes"),
        F.count_if(F.col("line_text").startswith("# sent_id = ") & (F.length("line_text") > 12)).alias("named"),
    )
    return per.groupBy("file_name").agg(
        F.count_if(F.col("tokens") > 0).alias("sentences"), F.count_if((F.col("tokens") > 0) & (F.col("named") == 0)).alias("nameless"), F.sum("tokens").alias("tokens"),
        F.sum("multiword").alias("multiword"), F.sum("empty_nodes").alias("empty_nodes"),
    )


def top_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen most frequent lower-cased forms of the annotated sentences, of equals the first."""
    tok = table(spark, sf_dir, "conllu_sentences").select(F.explode("toks.form").alias("form")).filter("form is not null")
    return tok.groupBy(F.lower("form").alias("form")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "form").limit(15)


def skipped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range and decimal ids per file."""
    first = F.substring_index("line_text", "\t", 1)
    rows = table(spark, sf_dir, "conllu_lines").select("file_name", "line_number", "line_text").distinct().filter(~F.col("line_text").startswith("#") & F.contains("line_text", F.lit("\t")))
    return rows.groupBy("file_name").agg(F.count_if(first.rlike("^[1-9][0-9]*-[1-9][0-9]*$")).alias("ranges"), F.count_if(first.rlike(r"^[1-9][0-9]*\.[1-9][0-9]*$")).alias("decimals"))


def conllu_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences as rows of CoNLL-U."""
    return conllu.format_tokens(table(spark, sf_dir, "conllu_sentences"), "sent_no")


_WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPLIT = f"list_filter(regexp_split_to_array(coalesce(%s, ''), '[{_WS}]+'), lambda x: x <> '')"
_TOK = "tok as (select sent_no, split, unnest(toks, max_depth := 2) from conllu_sentences)"
_HEAD = f"{_TOK}, j as (select t.*, h.id as h_id, h.form as h_form, h.upos as h_upos, h.deprel as h_deprel from tok t left join tok h on h.sent_no = t.sent_no and h.id = t.head)"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_LINES = rf"""
l as (select distinct file_name, line_number, line_text from conllu_lines),
m as (select *, regexp_full_match(coalesce(line_text, ''), '[{_WS}]*') as blank from l),
numbered as (select *, coalesce(max(case when blank then line_number end) over (partition by file_name order by line_number rows unbounded preceding), 0) as sentence from m),
kept as (select * from numbered where not blank)"""


def _rules(table_name: str, rules: dict[str, str]) -> str:
    return " union all ".join(f"select '{name}' as rule, count_if(not coalesce({ok}, false))::bigint as violations from {table_name}" for name, ok in rules.items())


QUERIES = {
    f.__name__: f
    for f in (
        stub_parse, stub_tokens, label_map, label_pivot, label_sets, histograms, corpus_totals, focus_profile, head_patterns, compound_exceptions, schema_violations,
        segment_violations, latest_rows, gaps, orphans, digests, repeated_requests, mentions, occurrences, annotation_rules, constructions, attachment_scores,
        differing_words, line_metadata, strict_read_errors, skipped_ids, conllu_rows, recovered_forms, coverage_rules, split_sets, syllables_in_source, line_layout, sent_id_shape, loose_scan, top_forms,
    )
}
_COMPARED = f"""{_TOK}, f as (select sent_no, toks[1].id as top from conllu_sentences), c as (select tok.*, case when id = top then 0 else top end as sys_head, case when id = top then 'root' else 'dep' end as sys_deprel from tok join f using (sent_no))"""
_OCCURRENCES = f"""{_TOK}, r as (select t.sent_no, t.split, t.id, t.form, s.metadata['text'] as text, row_number() over (partition by t.sent_no, t.form order by t.id) as k from tok t join conllu_sentences s using (sent_no)),
p as (select *, string_split(text, form) as parts from r where text is not null and form <> ''),
o as (select *, case when len(parts) > k then (length(array_to_string(parts[1:k], '')) + (k - 1) * length(form)) else -1 end::int as char_start from p)"""
SQL = {
    "stub_parse": f"""select coalesce(lang, '?') as lang, count(*) as documents, count_if(n > 0)::bigint as roots, sum(greatest(n - 1, 0))::bigint as dependents, max(n)::bigint as longest
from (select lang, len({_SPLIT % 'text'}) as n from documents) group by 1""",
    "stub_tokens": f"""select doc_id, (i - 1)::int as idx, w[i] as form, 'X' as upos, (i > 1)::int as head, case when i = 1 then 'root' else 'dep' end as deprel
from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from (select doc_id, {_SPLIT % 'text'} as w from documents))""",
    "label_map": "select deprel, base, count(*) as n from ud_tokens left join deprel_labels on label = deprel group by all",
    "label_pivot": f"with {_TOK} select deprel, count_if(split = 'train')::bigint as train, count_if(split = 'dev')::bigint as dev, count_if(split = 'test')::bigint as test from tok group by 1",
    "label_sets": f"with {_TOK} select deprel, bool_or(split = 'train') as in_train, bool_or(split <> 'train') as in_held_out from tok group by 1",
    "histograms": f"""with {_TOK}, x as (select 'deprel' as kind, deprel as value from tok union all select 'upos', upos from tok union all select 'syllables', len({_SPLIT % 'form'})::varchar from tok)
select kind, value, count(*) as n from x group by all""",
    "corpus_totals": f"""with {_TOK}, t as (select split, count(*) as tokens, count_if(len({_SPLIT % 'form'}) > 1) as multisyllabic, count_if(form = ':))') as emoticons from tok group by 1)
select s.split, count(*) as sentences, any_value(tokens)::bigint as tokens, any_value(multisyllabic)::bigint as multisyllabic, any_value(emoticons)::bigint as emoticons
from conllu_sentences s join t using (split) group by 1""",
    "focus_profile": f"""with {_HEAD}, f as (select *, lower(form) as word from j where lower(form) in {_LIST(FOCUS_FORMS)}),
x as (select word, 'deprel' as kind, deprel as value from f union all select word, 'upos', upos from f union all select word, 'head_upos', coalesce(h_upos, 'ROOT') from f union all select word, 'head_deprel', coalesce(h_deprel, 'ROOT') from f)
select word as form, kind, value, count(*) as n from x group by all""",
    "head_patterns": f"""with {_HEAD}, nxt as (select a.*, b.id as n_id, b.upos as n_upos, b.head as n_head from j a left join tok b on b.sent_no = a.sent_no and b.id = a.id + 1),
own as (select distinct sent_no, head from tok where lower(form) = 'của' and deprel = 'case'),
x as (
  select 'direction_form' as pattern, deprel as key from j where lower(form) in {_LIST(DIRECTION_FORMS)}
  union all select 'direction_verb', deprel from j where lower(form) in {_LIST(DIRECTION_FORMS)} and upos = 'VERB'
  union all select 'verb_below_di', deprel from j where lower(h_form) = 'đi' and upos = 'VERB' and id > h_id
  union all select 'verb_next_to_di', deprel from j where lower(h_form) = 'đi' and upos = 'VERB' and id = h_id + 1
  union all select 'di_and_next_verb', case when n_head = id then 'di_is_head' when head = n_id then 'following_verb_is_head' else 'no_direct_arc' end from nxt where lower(form) = 'đi' and n_upos = 'VERB'
  union all select 'compound_order', deprel || ':head_' || case when head < id then 'left' else 'right' end from j where deprel in ('compound:svc', 'compound:dir')
  union all select 'classifier_pair', deprel || ':' || h_upos || '->' || upos from j where deprel in ('clf', 'clf:det') and h_id is not null
  union all select 'possessive', case when own.head is null then 'without_marker' else 'with_marker' end from j left join own on own.sent_no = j.sent_no and own.head = j.id where deprel = 'nmod:poss'
  union all select 'object_position', case when id < head then 'before_head' else 'after_head' end from j where split_part(deprel, ':', 1) = 'obj' and h_id is not null
) select pattern, key, count(*) as n from x group by all""",
    "compound_exceptions": "select distinct sent_id, idx + 1 as dependent_id, deprel as label from ud_tokens where deprel in ('compound:svc', 'compound:dir') and head > idx + 1",
    "schema_violations": _rules("ud_tokens", {"sent_id": "length(sent_id) >= 1", "idx": "idx >= 0", "form": "length(form) >= 1", "upos": f"upos in {_LIST(UPOS)}", "head": "head >= 0", "deprel": f"deprel in {_LIST(BASE_LABELS)}", "source": f"source in {_LIST(SOURCES)}"}),
    "segment_violations": "with t as (select sent_id, register, source, unnest(tokens, max_depth := 2) from seg_sentences) " + _rules("t", {"sent_id": "length(sent_id) >= 1", "register": f"register in {_LIST(REGISTERS)}", "idx": "idx >= 0", "form": "length(form) >= 1", "upos": f"upos is null or upos in {_LIST(UPOS)}", "source": f"source in {_LIST(SOURCES)}"})
    + " union all " + _rules("seg_sentences", {"tokens": "len(tokens) > 0"}),
    "latest_rows": """with r as (select *, row_number() over (partition by corpus, sent_id, idx order by loaded_at desc, form desc) as k from ud_tokens)
select corpus, count_if(k = 1)::bigint as words, count_if(k > 1)::bigint as dropped, count_if(k = 1 and form is not null)::bigint as with_form from r group by 1""",
    "gaps": "select sent_id, min(idx) as first_idx, max(idx) as last_idx, count(distinct idx) as n from ud_tokens group by 1 having not (first_idx = 0 and last_idx = n - 1)",
    "orphans": " union all ".join(
        f"select count(*) as sentences, count_if(not exists (select 1 from documents d where d.content_hash = split_part(s.sent_id, ':', 1)))::bigint as orphans, '{t}' as source_table from (select distinct sent_id from {t}) s" for t in ("ud_tokens", "seg_sentences")
    ),
    "digests": """select source, count(*) as texts, count_if(sha256(text) <> content_hash)::bigint as other_digest, count_if(length(text) <> n_chars)::bigint as other_length,
count_if(nfc_normalize(text) <> text)::bigint as not_nfc, sum(greatest(1, floor(length(text) / 2.5)))::bigint as token_estimate from documents where text is not null group by 1""",
    "repeated_requests": """select sha256(coalesce(lang, '') || chr(0) || coalesce(text, '') || chr(0)) as digest, count(*) as documents, min(doc_id) as first_doc_id
from documents group by 1 having count(*) > 1""",
    "mentions": """with r as (select distinct sent_id, idx from ud_tokens where upos = 'PROPN'), g as (select *, idx - row_number() over (partition by sent_id order by idx) as run from r),
m as (select sent_id, min(idx) as s, max(idx) + 1 as e from g group by sent_id, run) select sent_id, sent_id || ':' || s || ':' || e as mention_id, (e - s)::int as n_words from m""",
    "occurrences": f"with {_OCCURRENCES} select sent_no, id, char_start from o",
    "recovered_forms": f"with {_OCCURRENCES} select split, count(*) as forms, count_if(char_start >= 0)::bigint as found, count_if(char_start >= 0 and substr(o.text, char_start + 1, length(r.form)) = r.form)::bigint as recovered from r left join o using (sent_no, split, id) group by 1",
    "coverage_rules": """with t as (select sent_no, split, metadata['synthetic'] as synthetic, metadata['constructions'] as tags from conllu_sentences),
u as (select split, trim(unnest(string_split(tags, ','))) as tag from t),
x as (select split, count(*) as sentences, count_if(coalesce(synthetic = 'true', false))::bigint as synthetic, (select count(distinct tag) from u where u.split = t.split and tag <> '') as tags from t group by 1)
select *, sentences >= 20 and tags >= 10 and synthetic < 0.2 * sentences as enough from x""",
    "split_sets": """with i as (select distinct split, metadata['sent_id'] as sent_id from conllu_sentences where metadata['sent_id'] is not null), tok as (select split, unnest(toks, max_depth := 2) from conllu_sentences), l as (select distinct split, deprel from tok)
select a.split, ids, ids_in_train, labels, unknown_labels from (select split, count(*) as ids, count_if(sent_id in (select sent_id from i where split = 'train'))::bigint as ids_in_train from i group by 1) a
join (select split, count(*) as labels, count_if(coalesce(deprel not in (select label from deprel_labels), true))::bigint as unknown_labels from l group by 1) b using (split)""",
    "syllables_in_source": """with t as (select corpus, lower(split_part(trim(sent_id), ':', 1)) as hash, unnest(tokens, max_depth := 2) from seg_sentences),
d as (select content_hash as hash, nfc_normalize(any_value(text)) as text from documents where text is not null group by 1)
select corpus, count(*) as words, count_if(len(list_filter(syllables, lambda s: not contains(d.text, nfc_normalize(s)))) > 0)::bigint as astray from t join d using (hash) group by 1""",
    "line_layout": f"""with {_LINES}, k as (select *, starts_with(line_text, '#') as note, regexp_replace(split_part(substr(line_text, 2), '=', 1), '^[{_WS}]+|[{_WS}]+$', '', 'g') as key from kept),
late as (select file_name, sentence, max(case when note then line_number end) > min(case when not note then line_number end) as late from k group by 1, 2),
twice as (select distinct file_name, sentence from k where note and contains(line_text, '=') group by file_name, sentence, key having count(*) > 1)
select file_name, arg_max(blank, line_number) as ends_blank, (select count(*) from late l where l.file_name = m.file_name) as sentences, (select count_if(coalesce(late, false)) from late l where l.file_name = m.file_name)::bigint as late_comments,
  (select count(*) from twice t where t.file_name = m.file_name) as repeated_keys from m group by 1""",
    "sent_id_shape": " union all ".join(
        f"select count(*) as ids, count_if(regexp_matches(sent_id, '{HASHED_ID}'))::bigint as well_formed, count_if(regexp_matches(trim(split_part(lower(trim(sent_id)), ':', 1)) || ':' || trim(split_part(lower(trim(sent_id)), ':', 2)), '{HASHED_ID}'))::bigint as rebuilt, '{t}' as source_table from (select distinct sent_id from {t} where sent_id is not null)" for t in ("ud_tokens", "seg_sentences")
    ),
    "loose_scan": f"""with {_LINES}, k as (select *, starts_with(line_text, '#') as note, split_part(line_text, chr(9), 1) as first from kept),
per as (select file_name, sentence, count_if(not note and not contains(first, '-') and not contains(first, '.')) as tokens, count_if(not note and contains(first, '-')) as multiword,
  count_if(not note and not contains(first, '-') and contains(first, '.')) as empty_nodes, bool_or(starts_with(line_text, '# sent_id = ') and length(line_text) > 12) as named from k group by 1, 2)
select file_name, count_if(tokens > 0)::bigint as sentences, count_if(tokens > 0 and not named)::bigint as nameless, sum(tokens)::bigint as tokens, sum(multiword)::bigint as multiword, sum(empty_nodes)::bigint as empty_nodes from per group by 1""",
    "top_forms": f"with {_TOK} select lower(form) as form, count(*) as n from tok where form is not null group by 1 order by n desc, 1 limit 15",
    "annotation_rules": "with s as (select *, metadata['synthetic'] as syn from conllu_sentences) " + _rules("s", {
        "sent_id": "trim(metadata['sent_id']) <> ''", "register": f"metadata['register'] in {_LIST(REGISTERS)}", "synthetic": "syn in ('true', 'false')", "uncertain": "metadata['uncertain'] in ('true', 'false')",
        "accessed": "regexp_full_match(metadata['accessed'], '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(metadata['accessed'] as date) is not null",
        "source_url": "syn <> 'false' or regexp_matches(metadata['source_url'], '^https?://[^/?#]+')", "text": "metadata['text'] = coalesce(array_to_string(list_filter(list_transform(toks, lambda t: t.form), lambda f: f is not null), ' '), '')",
        "nfc": "nfc_normalize(metadata['text']) = metadata['text']", "id_pattern": f"regexp_matches(metadata['sent_id'], '{SENT_ID}')",
        "repeated_tags": "coalesce((select count(*) = count(distinct x) from (select unnest(list_filter(list_transform(string_split(metadata['constructions'], ','), lambda x: trim(x)), lambda x: x <> '')) as x)), true)"}),
    "constructions": """with t as (select distinct sent_no, metadata['synthetic'] as syn, trim(unnest(string_split(metadata['constructions'], ','))) as tag from conllu_sentences)
select tag, count(*) as sentences, avg(coalesce(syn = 'true', false)::int) as synthetic_share from t where tag <> '' group by 1""",
    "attachment_scores": f"with {_COMPARED} select split, count(*) as words, avg((head = sys_head)::int) as uas, avg((head = sys_head and deprel = sys_deprel)::int) as las from c group by 1",
    "differing_words": f"with {_COMPARED} select sent_no, count(*) as words, count_if(head <> sys_head or deprel <> sys_deprel)::bigint as differing from c group by 1",
    "line_metadata": f"""with {_LINES}, p as (select *, substr(line_text, 2) as t from kept where starts_with(line_text, '#') and contains(line_text, '=')),
held as (select distinct file_name, sentence from kept where not starts_with(line_text, '#'))
select file_name, sentence, regexp_replace(split_part(t, '=', 1), '^[{_WS}]+|[{_WS}]+$', '', 'g') as key,
  arg_max(regexp_replace(substr(t, strpos(t, '=') + 1), '^[{_WS}]+|[{_WS}]+$', '', 'g'), line_number) as value from p join held using (file_name, sentence) group by 1, 2, 3""",
    "strict_read_errors": rf"""with {_LINES}, c as (select *, string_split(line_text, chr(9)) as c from kept where not starts_with(line_text, '#')),
t as (select *, row_number() over (partition by file_name, sentence order by line_number) as place from c where not (len(c) = 10 and regexp_full_match(c[1], '[1-9][0-9]*[-.][1-9][0-9]*'))),
r as (select *, case when len(c) <> 10 then 'columns' when not regexp_full_match(c[1], '\s*[+-]?[0-9]+(_[0-9]+)*\s*') then 'id'
  when not coalesce(try_cast(replace(trim(c[1]), '_', '') as bigint) = place, false) then 'consecutive' when not regexp_full_match(c[7], '\s*[+-]?[0-9]+(_[0-9]+)*\s*') then 'head' end as reason from t)
select file_name, sentence, min(line_number) as line_number, arg_min(reason, line_number) as reason from r where reason is not null group by 1, 2""",
    "skipped_ids": r"""with l as (select distinct file_name, line_number, line_text, split_part(line_text, chr(9), 1) as f from conllu_lines where not starts_with(line_text, '#') and contains(line_text, chr(9)))
select file_name, count_if(regexp_full_match(f, '[1-9][0-9]*-[1-9][0-9]*'))::bigint as ranges, count_if(regexp_full_match(f, '[1-9][0-9]*\.[1-9][0-9]*'))::bigint as decimals from l group by 1""",
    "conllu_rows": f"with {_TOK} select sent_no, id, concat_ws(chr(9), id, coalesce(form, '_'), '_', coalesce(upos, '_'), '_', '_', coalesce(head::varchar, '_'), coalesce(deprel, '_'), '_', '_') as line from tok",
}
