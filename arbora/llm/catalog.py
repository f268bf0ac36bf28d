"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import bin_completion, byte_bpe, one_spelling, same_records, split_overlap, subjects, term_counts
from arbora.storage import materialize, table

TERM_FIELDS = ["deprel", "upos", "form"]


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct deprel, upos and form with its occurrences, its sentences and its mark."""
    tokens = table(spark, sf_dir, "ud_tokens")
    counts, n_records = term_counts.count_terms(tokens, TERM_FIELDS, "sent_id", "idx")
    return term_counts.mark_terms(counts, n_records).select("field_name", "term", "occurrences", F.col("records").alias("sentences"), "mark")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return p1_terms(spark, sf_dir).filter("mark is not null").select("field_name", "term", "mark")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that repeat another in other dress, with the first of their group."""
    keys = materialize(same_records.record_keys(table(spark, sf_dir, "seg_sentences")), "keys")
    return same_records.members(keys, same_records.same_groups(keys))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    keys = same_records.record_keys(table(spark, sf_dir, "seg_sentences"))
    return same_records.same_groups(keys).select("first_record_id", "copies")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and a dev or test sentence that are the same or nearly so."""
    pairs = split_overlap.overlaps(table(spark, sf_dir, "conllu_sentences")).pairs
    return pairs.select(F.least("train_no", "eval_no").alias("sent_no_a"), F.greatest("train_no", "eval_no").alias("sent_no_b")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source in the metadata (whatever its case; empty where none is named): sentences, those found
    in train, and of the compared ones the forms, those in passages that train holds, and the sentences that are covered whole."""
    sentences = table(spark, sf_dir, "conllu_sentences")
    found = split_overlap.overlaps(sentences)
    hit = found.pairs.groupBy(F.col("eval_no").alias("sent_no")).agg(F.min("distance").alias("least"), F.count("*").alias("pairs"))
    source = F.lower(F.trim(F.coalesce(F.try_element_at("metadata", F.lit("source_name")), F.lit(""))))
    held = sentences.filter("split in ('dev', 'test')").select("sent_no", "split", source.alias("source_name"))
    return held.join(hit, "sent_no", "left").join(found.coverage.drop("split"), "sent_no", "left").groupBy("split", "source_name").agg(
        F.count("*").alias("sentences"),
        F.count("least").alias("overlapping"),
        F.count_if(F.col("least") == 0).alias("exact"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum("forms"), F.lit(0)).alias("forms"),
        F.coalesce(F.sum("covered"), F.lit(0)).alias("covered_forms"),
        F.count_if(F.col("covered") == F.col("forms")).alias("covered_whole"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that look like plain spelling and are not."""
    return one_spelling.found_cells(table(spark, sf_dir, "seg_sentences"))


def p6_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form, syllable and register in its one spelling."""
    return one_spelling.respelled(table(spark, sf_dir, "seg_sentences"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's ids by byte_bpe_50k."""
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's length in tokens, and whether decoding gives the text back."""
    documents = table(spark, sf_dir, "documents")
    encoded = materialize(p7_ids(spark, sf_dir), "ids")
    back = byte_bpe.decode_documents(encoded).withColumnRenamed("text", "decoded")
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id").join(byte_bpe.token_lengths(encoded), "doc_id").select(
        "doc_id", (F.col("text") == F.col("decoded")).alias("same"), F.length("decoded").alias("n_chars"), F.col("n_tokens") > 0
    ).toDF("doc_id", "same", "n_chars", "has_tokens")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text lies."""
    return bin_completion.containers(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each container is filled."""
    return bin_completion.fill(p8_containers(spark, sf_dir))


def p8_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each block beside the fewest possible."""
    return bin_completion.blocks_filled(p8_containers(spark, sf_dir))


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    models = subjects.train(documents, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"), table(spark, sf_dir, "sources"))
    return subjects.classify(documents, models, subjects.stock_endings(documents))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas that each document is about."""
    return _areas(spark, sf_dir).select("doc_id", "subject_id").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per area, and their share of all documents."""
    n = table(spark, sf_dir, "documents").count()
    areas = table(spark, sf_dir, "subject_areas")
    counts = _areas(spark, sf_dir).groupBy("subject_id").agg(F.countDistinct("doc_id").alias("documents"))
    return areas.select("subject_id", "subject_name").join(counts, "subject_id", "left").select(
        "subject_id", "subject_name", F.coalesce("documents", F.lit(0)).alias("documents"), (F.coalesce("documents", F.lit(0)) / F.lit(max(1, n))).alias("share")
    )


def p9_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address words and sections beside the areas that readers gave: what weak labels rest on."""
    keys = subjects.section_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "sources"))
    return subjects.weak_rules(keys, table(spark, sf_dir, "subject_labels"))


P1_TERMS_SQL = """
with tok as (select distinct sent_id, idx, deprel, upos, form from ud_tokens),
terms as (
  select 'deprel' as field_name, deprel as term, sent_id from tok union all
  select 'upos', upos, sent_id from tok union all
  select 'form', form, sent_id from tok
),
n as (select field_name, term, count(*) as occurrences, count(distinct sent_id) as sentences from terms where term is not null group by all),
s as (select count(distinct sent_id) as s from ud_tokens)
select n.*, case when sentences <= 2 or sentences * 10000 <= s then 'rare' when sentences * 20 > s * 11 then 'common' end as mark from n, s
"""

P4_SQL = r"""
with toks as (select record_id, sent_id, unnest(tokens, max_depth := 2) from seg_sentences),
strip as (
  select record_id, idx, regexp_replace(lower(form), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\pP]', '', 'g') as form from toks
),
keys as (select record_id, string_agg(form, chr(31) order by idx) as forms from strip where form <> '' group by record_id),
named as (
  select s.record_id, k.forms, regexp_replace(lower(s.sent_id), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\pP]', '', 'g') as sent
  from seg_sentences s left join keys k using (record_id)
)
"""

P5_SQL = r"""
with recursive toks as (select sent_no, split, unnest(toks, max_depth := 2) from conllu_sentences where split in ('train', 'dev', 'test')),
lists as (
  select sent_no, split, list(lower(form) order by id) as f from toks where regexp_matches(lower(form), '[\pL\pN]') group by all having count(*) >= 12
),
pairs as (
  select t.sent_no as a, e.sent_no as b, t.f as x, e.f as y from lists t join lists e
  on t.split = 'train' and e.split <> 'train' and abs(len(t.f) - len(e.f)) * 20 <= 3 * greatest(len(t.f), len(e.f))
  and len(list_intersect(t.f, e.f)) * 2 >= len(list_distinct(e.f))
),
grid as (
  select a, b, x, y, 0 as i, range(0, len(y) + 1) as row from pairs
  union all
  select a, b, x, y, i + 1, list_reduce(
    list_prepend([i + 1::bigint], [[least(row[j + 1] + 1, row[j] + (x[i + 1] <> y[j])::int)] for j in range(1, len(y) + 1)]),
    lambda p, q: list_append(p, least(q[1], p[len(p)] + 1)))
  from grid where i < len(x)
)
"""
_NEAR = "i = len(x) and row[len(y) + 1] * 20 <= 3 * greatest(len(x), len(y))"

QUERIES = {
    "p1_found": p1_found, "p1_terms": p1_terms, "p4_found": p4_found, "p4_records": p4_records, "p5_found": p5_found, "p5_report": p5_report,
    "p6_found": p6_found, "p6_cells": p6_cells, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_blocks": p8_blocks,
    "p9_found": p9_found, "p9_composition": p9_composition,
    "p9_weak_rules": p9_weak_rules,
}
SQL = {
    "p1_found": f"select field_name, term, mark from ({P1_TERMS_SQL}) where mark is not null",
    "p1_terms": P1_TERMS_SQL,
    "p4_found": P4_SQL + """select * from (select min(record_id) over (partition by sent, forms) as first_record_id, record_id from named) where record_id <> first_record_id""",
    "p4_records": P4_SQL + "select min(record_id) as first_record_id, count(*) as copies from named group by sent, forms",
    "p5_found": f"{P5_SQL} select least(a, b) as sent_no_a, greatest(a, b) as sent_no_b from grid where {_NEAR}",
    "p5_report": f"""{P5_SQL}, hit as (select b as sent_no, min(row[len(y) + 1]) as least, count(*) as pairs from grid where {_NEAR} group by b),
cut as (select sent_no, f, len(f) as n, least(len(f), greatest(15 * (len(f) * 100 // 85) // 100 + 2, len(f) // 3)) as parts from lists where split <> 'train'),
piece as (select sent_no, n, f[n * k // parts + 1 : n * (k + 1) // parts] as p from (select *, unnest(range(0, parts)) as k from cut)),
train as (select distinct chr(31) || array_to_string(f, chr(31)) || chr(31) as t from lists where split = 'train'),
wanted as (select distinct p, chr(31) || array_to_string(p, chr(31)) || chr(31) as w from piece),
stands as (select p from wanted where exists (select 1 from train where contains(t, w))),
cover as (select sent_no, any_value(n) as forms, coalesce(sum(len(p)) filter (where p in (select p from stands)), 0) as covered from piece group by 1)
select s.split, lower(trim(coalesce(s.metadata['source_name'], ''))) as source_name, count(*) as sentences, count(least) as overlapping, count_if(coalesce(least = 0, false))::bigint as exact, coalesce(sum(pairs), 0)::bigint as pairs,
  coalesce(sum(forms), 0)::bigint as forms, coalesce(sum(covered), 0)::bigint as covered_forms, count_if(coalesce(covered = forms, false))::bigint as covered_whole
from conllu_sentences s left join hit using (sent_no) left join cover using (sent_no) where s.split in ('dev', 'test') group by 1, 2""",
    "p9_weak_rules": r"""with keys as (
  select doc_id, 'source' as field, source as value from documents union all select doc_id, 'register', register from documents
  union all select doc_id, 'kind', kind from documents join sources on source_id = source
  union all select distinct doc_id, 'path', unnest(regexp_extract_all(lower(regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1)), '[\pL\pM]+')) from documents),
k as (select * from keys where value is not null), l as (select distinct doc_id, subject_id from subject_labels),
seen as (select field, value, count(*) as seen from k where doc_id in (select doc_id from l) group by 1, 2),
given as (select field, value, subject_id, count(*) as given from k join l using (doc_id) where subject_id is not null group by 1, 2, 3)
select field, value, subject_id, seen, given from given join seen using (field, value)""",
    "p7_decoded": "select doc_id, true as same, length(coalesce(text, ''))::int as n_chars, length(coalesce(text, '')) > 0 as has_tokens from documents",
}
