"""Queries and SQL of the general problems on parent links and damaged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.hierarchy import Hierarchy, ancestor_pairs, resolve
from arbora.operators.rejects import loaded_tokens, parse_lines
from arbora.storage import table


def _words(spark: SparkSession, sf_dir: str, payload: Column | None = None) -> Hierarchy:
    tokens = table(spark, sf_dir, "ud_tokens")
    return resolve(tokens, "sent_id", "idx", F.when(F.col("head") != 0, F.col("head") - 1), payload)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose way up never ends."""
    found = _words(spark, sf_dir).endless
    return found.select(F.col("tree").alias("sent_id"), F.col("node").alias("idx"), "place")


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, root and the words and labels up to the root, for each word that has a root."""
    found = _words(spark, sf_dir, F.struct(F.col("form").alias("form"), F.col("deprel").alias("deprel"))).reached
    spell = lambda f: F.array_join(F.transform("path", lambda p: F.coalesce(p[f], F.lit("_"))), " > ")
    return found.select(
        F.col("tree").alias("sent_id"), F.col("node").alias("idx"), "depth", F.col("root").alias("root_idx"), spell("form").alias("words"), spell("deprel").alias("labels")
    )


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word with each word below it."""
    found = _words(spark, sf_dir, F.struct(F.col("idx").alias("node"))).reached
    return ancestor_pairs(found).select(F.col("tree").alias("sent_id"), F.col("ancestor").alias("idx"), F.col("node").alias("below_idx"), "distance")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(table(spark, sf_dir, "conllu_lines"), table(spark, sf_dir, "deprel_labels"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows that cannot be loaded, with the first reason."""
    return _parsed(spark, sf_dir).filter("reason is not null").select("file_name", "line_number", "reason")


def p3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that load."""
    return loaded_tokens(_parsed(spark, sf_dir)).select("file_name", "line_number", "id", "form", "upos", "head", "deprel")


_TREE = """
nodes as (select distinct sent_id, idx, form, deprel, case when head <> 0 then head - 1 end up from ud_tokens),
linked as (select n.*, p.idx is not null as has_up from nodes n left join nodes p on p.sent_id = n.sent_id and p.idx = n.up),
"""

P2_FOUND_SQL = f"""
with recursive {_TREE}
walk as (
  select sent_id, idx as start_idx, up as at from linked where has_up
  union
  select w.sent_id, w.start_idx, l.up from walk w join linked l on l.sent_id = w.sent_id and l.idx = w.at where l.has_up
),
ends as (select distinct w.sent_id, w.start_idx from walk w join linked l on l.sent_id = w.sent_id and l.idx = w.at where not l.has_up)
select l.sent_id, l.idx,
       case when exists (select 1 from walk w where w.sent_id = l.sent_id and w.start_idx = l.idx and w.at = l.idx) then 'on' else 'below' end as place
from linked l where l.has_up and not exists (select 1 from ends e where e.sent_id = l.sent_id and e.start_idx = l.idx)
"""

P2_PATHS_SQL = f"""
with recursive {_TREE}
down as (
  select sent_id, idx, 0 as depth, idx as root_idx, coalesce(form, '_') as words, coalesce(deprel, '_') as labels from linked where not has_up
  union all
  select l.sent_id, l.idx, d.depth + 1, d.root_idx, coalesce(l.form, '_') || ' > ' || d.words, coalesce(l.deprel, '_') || ' > ' || d.labels
  from down d join linked l on l.sent_id = d.sent_id and l.up = d.idx where l.has_up
)
select sent_id, idx, depth, root_idx, words, labels from down
"""

P2_DESCENDANTS_SQL = f"""
with recursive {_TREE}
down as (
  select sent_id, idx, [idx] as path from linked where not has_up
  union all
  select l.sent_id, l.idx, list_prepend(l.idx, d.path) from down d join linked l on l.sent_id = d.sent_id and l.up = d.idx where l.has_up
),
pairs as (select sent_id, idx as below_idx, unnest(path[2:]) as idx, unnest(range(1, len(path))) as distance from down)
select sent_id, idx, below_idx, distance::int as distance from pairs
"""

_ROWS = r"""
lines as (select distinct file_name, line_number, coalesce(line_text, '') as line_text from conllu_lines),
marked as (
  select *, regexp_full_match(line_text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*') as blank from lines
),
placed as (
  select *, sum(blank::int) over (partition by file_name order by line_number rows unbounded preceding) as sentence, string_split(line_text, chr(9)) as c from marked
),
tok as (select * from placed where not blank and not starts_with(line_text, '#')),
typed as (
  select *, len(c) = 10 as ten, len(c) = 10 and regexp_full_match(c[1], '[1-9][0-9]*') as whole from tok
),
sized as (
  select *, max(case when ten and whole then c[1]::hugeint end) over (partition by file_name, sentence) as largest from typed
),
judged as (
  select *, case
    when not ten then 'columns'
    when exists (select 1 from (select unnest([c[1], c[4], c[5], c[6], c[7], c[8], c[9], c[10]]) as x) where (length(x) - length(replace(x, '"', ''))) % 2 = 1) then 'quoting'
    when not regexp_full_match(c[1], '[1-9][0-9]*([-.][1-9][0-9]*)?') then 'id'
    when not whole then null
    when not regexp_full_match(c[7], '0|[1-9][0-9]*') then 'head'
    when c[7]::hugeint > largest then 'head_range'
    when c[8] not in (select label from deprel_labels) then 'deprel'
    when (c[7] = '0') <> (c[8] = 'root') then 'root'
  end as reason from sized
)
"""

P3_FOUND_SQL = f"with {_ROWS} select file_name, line_number, reason from judged where reason is not null"
P3_TOKENS_SQL = f"""with {_ROWS} select file_name, line_number, c[1]::int as id, c[2] as form, c[4] as upos, c[7]::int as head, c[8] as deprel
from judged where reason is null and whole"""

QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p3_found": p3_found, "p3_tokens": p3_tokens}
SQL = {"p2_found": P2_FOUND_SQL, "p2_paths": P2_PATHS_SQL, "p2_descendants": P2_DESCENDANTS_SQL, "p3_found": P3_FOUND_SQL, "p3_tokens": P3_TOKENS_SQL}
