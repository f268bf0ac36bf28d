"""Queries on trees: validity, projectivity, projection onto syllables and the static oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions.text import label_base
from arbora.functions.vocabulary import BASE_LABELS, LABEL_BASE
from arbora.operators import trees
from arbora.operators.hierarchy import resolve
from arbora.storage import materialize, table


#: What may be wrong with the roots of sentences in which every token still hangs below one.
FORESTS = ["", "root_count", "root_label", "root_count,root_label"]


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.with_tree(table(spark, sf_dir, "conllu_sentences").select("sent_no", "split", "toks"))


def _valid(df: DataFrame) -> DataFrame:
    return df.filter(trees.diagnosis() == "")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed sentences, broken ones among them, as one tree per row; repeats count once, ids are idx + 1 and stand for the lines."""
    rows = table(spark, sf_dir, "ud_tokens").select("sent_id", "idx", "form", "upos", "head", "deprel").distinct()
    tok = F.struct((F.col("idx") + 1).alias("id"), "form", "upos", "head", "deprel", (F.col("idx") + 1).alias("line_number"))
    return trees.with_tree(rows.groupBy("sent_id").agg(F.sort_array(F.collect_list(tok)).alias("toks")))


def tree_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted error codes of each parsed sentence."""
    return _parsed(spark, sf_dir).select("sent_id", trees.diagnosis().alias("errors"))


def strict_tree_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first defect that a strict reader reports of each parsed sentence, with its line."""
    found = _parsed(spark, sf_dir).select("sent_id", trees.first_defect().alias("d")).filter("d is not null")
    return found.select("sent_id", "d.reason", "d.line_number")


def annotated_tree_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and sorted error codes: annotated sentences."""
    rows = trees.with_tree(table(spark, sf_dir, "conllu_sentences").select("sent_no", "split", "toks"))
    return rows.groupBy("split", trees.diagnosis().alias("errors")).agg(F.count("*").alias("sentences"))


def judged_roots(rows: DataFrame) -> DataFrame:
    """(sent_id, single) of (sent_id, idx, head): whether there is one root, all heads are stored and no way runs in a circle, whatever the root's label."""
    found = resolve(rows, "sent_id", "idx", F.when(F.col("head") != 0, F.col("head") - 1), F.struct("head"))
    is_root = F.col("path")[0]["head"].eqNullSafe(F.lit(0))
    tops = found.reached.filter("depth = 0").select("tree", is_root.cast("int").alias("roots"), (~is_root).cast("int").alias("bad"))
    judged = tops.unionByName(found.endless.select("tree", F.lit(0).alias("roots"), F.lit(1).alias("bad")))
    return judged.groupBy(F.col("tree").alias("sent_id")).agg(((F.sum("roots") == 1) & (F.sum("bad") == 0)).alias("single"))


def single_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed sentences and how many are trees with one root."""
    rows = table(spark, sf_dir, "ud_tokens")
    source = rows.groupBy("sent_id").agg(F.min("source").alias("source"))
    return judged_roots(rows).join(source, "sent_id").groupBy("source").agg(F.count("*").alias("sentences"), F.count_if("single").alias("single_rooted"))


def projectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each parsed tree is projective, also one with several roots or a mislabelled one (a root within another's span crosses the arc from the
    artificial root): every subtree fills its span; and by descent: every token under an arc hangs on its head."""
    trees_of = _parsed(spark, sf_dir).filter(trees.diagnosis().isin(FORESTS))
    rows = materialize(trees.tokens(trees_of, "sent_id"), "valid")
    return trees.projective(trees.ancestors(rows, "sent_id"), "sent_id")


def subtree_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, edges and size of every subtree of the valid trees."""
    pairs = trees.ancestors(trees.tokens(_valid(_trees(spark, sf_dir)), "sent_no"), "sent_no")
    return trees.spans(pairs, "sent_no").select("sent_no", "id", "depth", "left_edge", "right_edge", "size")


def _ready(df: DataFrame) -> DataFrame:
    """Trees that can be projected: valid, with known labels and forms that are not blank."""
    return _valid(df).filter(F.forall("toks", lambda t: t["deprel"].isin(list(LABEL_BASE)) & (F.trim(F.coalesce(t["form"], F.lit(""))) != "")))


def _glued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.glue(trees.tokens(_ready(_trees(spark, sf_dir)), "sent_no"), "sent_no")


def glue_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each glued punctuation token and the token that takes it."""
    return _glued(spark, sf_dir).filter("target is not null").select("sent_no", "id", F.col("target").alias("target_id"))


def projection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees on syllables."""
    return trees.project(_glued(spark, sf_dir), "sent_no").select("sent_no", "id", "form", "head", "deprel", "word_id", "line_number")


def projection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: words and syllables, glued and kept punctuation, inner arcs, and whether the accounts agree: the numbers, and the tokens that are gone with those that were glued."""
    glued = _glued(spark, sf_dir)
    is_glued, opening = F.col("target").isNotNull(), F.col("target") > F.col("id")
    before = glued.groupBy("sent_no").agg(
        F.count("*").alias("n"), F.count_if(is_glued).alias("glued"), F.count_if(opening).alias("opening"), F.count_if((F.col("base") == "punct") & ~is_glued).alias("kept"),
        F.sort_array(F.collect_list(F.when(~is_glued, F.col("id")))).alias("staying"),
    )
    after = trees.project(glued, "sent_no").groupBy("sent_no").agg(F.count("*").alias("m"), F.count_if("inner").alias("inner_arcs"), F.sort_array(F.collect_set("word_id")).alias("stayed"))
    per = before.join(after, "sent_no").join(table(spark, sf_dir, "conllu_sentences").select("sent_no", "split"), "sent_no")
    agree = (F.col("m") == F.col("n") - F.col("glued") + F.col("inner_arcs")) & (F.col("staying") == F.col("stayed"))
    return per.groupBy("split").agg(
        F.count("*").alias("sentences"), F.sum("n").alias("words"), F.sum("m").alias("syllables"), F.sum("opening").alias("glued_opening"),
        F.sum(F.col("glued") - F.col("opening")).alias("glued_trailing"), F.sum("inner_arcs").alias("inner_arcs"), F.sum("kept").alias("kept_punct"),
        F.bool_and(agree).alias("accounts_agree"),
    )


def syllable_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_no, id, head, deprel, word_id, ...) of the syllable trees, written once as several stages read them."""
    return materialize(trees.project(_glued(spark, sf_dir), "sent_no"), "syllables")


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.oracle_actions(trees.spans(trees.ancestors(syllable_trees(spark, sf_dir), "sent_no"), "sent_no"), "sent_no")


def oracle_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oracle's actions for every projective syllable tree."""
    return _actions(spark, sf_dir).drop("head")


def _as_lists(actions: DataFrame, key: str) -> DataFrame:
    """Each sentence's actions in order, and its heads by id."""
    steps = F.sort_array(F.collect_list(F.struct("step", "kind", "label")))
    heads = F.sort_array(F.collect_list(F.when(F.col("kind") == "SHIFT", F.struct(F.col("dependent").alias("id"), "head"))))
    lists = actions.groupBy(key).agg(steps.alias("a"), heads.alias("h"))
    return lists.select(key, F.transform("a", lambda x: x["kind"]).alias("kinds"), F.transform("a", lambda x: x["label"]).alias("labels"), F.transform("h", lambda x: x["head"]).alias("heads"))


def oracle_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: trees whose actions were replayed, trees that came out as they were, and actions."""
    lists = _as_lists(_actions(spark, sf_dir), "sent_no").withColumn("ran", trees.replay(F.size("heads"), "kinds", "labels"))
    same = F.col("ran.reason").isNull() & (F.col("ran.heads") == F.col("heads"))
    judged = lists.select("sent_no", same.alias("same"), F.size("kinds").alias("n"))
    # merged: the sizes of grouped lists are estimated far too small, so that Spark would send all sentences to the driver to broadcast them
    splits = table(spark, sf_dir, "conllu_sentences").select("sent_no", "split").hint("merge")
    return judged.join(splits, "sent_no").groupBy("split").agg(F.count("*").alias("attempted"), F.count_if("same").alias("passed"), F.sum("n").alias("actions"))


def oracle_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parsed sentence from whose syllables no oracle can be built, with the first reason: ids, blank forms, unknown labels, the tree, then arcs that cross."""
    parsed = materialize(_parsed(spark, sf_dir), "parsed")
    blank = F.exists("toks", lambda t: F.trim(F.coalesce(t["form"], F.lit(""))) == "")
    unknown = F.exists("toks", lambda t: ~F.coalesce(t["deprel"].isin(list(LABEL_BASE)), F.lit(False)))
    reason = F.when(~F.coalesce("consecutive", F.lit(False)), "ids").when(blank, "form").when(unknown, "label").otherwise(trees.first_defect()["reason"])
    rejected = parsed.select("sent_id", reason.alias("reason")).filter("reason is not null")
    glued = trees.glue(trees.tokens(_ready(parsed), "sent_id"), "sent_id")
    syllables = materialize(trees.project(glued, "sent_id"), "syllables")
    crossed = trees.projective(trees.ancestors(syllables, "sent_id"), "sent_id").filter("not by_spans")
    return rejected.unionByName(crossed.select("sent_id", F.lit("crossing").alias("reason")))


def replay_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed sentences whose arcs, with base labels and in the order of the oracle, are not all legal: the step and the reason of the first action that is refused.

    The order is that of ``trees.oracle_actions`` without its demand that the tree be projective; circles have no actions and stay ``unfinished``.
    """
    toks = trees.tokens(_parsed(spark, sf_dir).filter("consecutive"), "sent_id").withColumn("deprel", label_base(F.col("deprel")))
    toks = materialize(toks, "parsed")
    edges = trees.spans(trees.ancestors(toks, "sent_id"), "sent_id").withColumn("size", F.col("right_edge") - F.col("left_edge") + 1)
    n = toks.groupBy("sent_id").agg(F.count("*").alias("n"))
    lists = n.join(_as_lists(trees.oracle_actions(edges, "sent_id"), "sent_id"), "sent_id", "left").withColumn("ran", trees.replay("n", "kinds", "labels"))
    return lists.filter("ran.reason is not null").select("sent_id", "ran.step", "ran.reason")


# one row per token, and what they say of each tree
_TOK = """
tok as (select sent_no, split, unnest(toks, max_depth := 2) from conllu_sentences),
n as (select sent_no, split, coalesce(len(toks), 0) as n, coalesce(list_transform(toks, lambda t: t.id) = range(1, len(toks) + 1)::int[], true) as ordered from conllu_sentences),
walk as (
  select t.sent_no, t.id as start_id, t.head as spot from tok t join n using (sent_no) where t.head between 1 and n.n
  union
  select w.sent_no, w.start_id, t.head from walk w join tok t on t.sent_no = w.sent_no and t.id = w.spot join n on n.sent_no = t.sent_no where t.head between 1 and n.n
),
circle as (select distinct sent_no from walk where spot = start_id),
judged as (
  select n.sent_no, any_value(n.split) as split, any_value(n) as n, bool_and(ordered) as ordered, count_if(head = 0) <> 1 as root_count,
         coalesce(bool_or(coalesce(head = 0, false) <> coalesce(deprel = 'root', false)), false) as root_label,
         coalesce(bool_or(head is null or head < 0 or head > n), false) as invalid_head
  from n left join tok using (sent_no) group by n.sent_no
),
coded as (
  select j.*, case when not ordered then 'nonconsecutive_ids' else array_to_string(list_filter([
    case when sent_no in (select sent_no from circle) then 'cycle' end, case when invalid_head then 'invalid_head' end,
    case when root_count then 'root_count' end, case when root_label then 'root_label' end], lambda x: x is not null), ',') end as errors
  from judged j
),
good as (select t.* from tok t join coded c using (sent_no) where c.errors = ''),
"""
# the same of the parsed sentences
_PARSED = _TOK.replace(
    "tok as (select sent_no, split, unnest(toks, max_depth := 2) from conllu_sentences)",
    "tok as (select distinct sent_id as sent_no, null as split, idx + 1 as id, form, upos, head, deprel, idx + 1 as line_number from ud_tokens)",
).replace(
    "n as (select sent_no, split, coalesce(len(toks), 0) as n, coalesce(list_transform(toks, lambda t: t.id) = range(1, len(toks) + 1)::int[], true) as ordered from conllu_sentences)",
    "n as (select sent_no, null as split, count(*) as n, min(id) = 1 and max(id) = count(*) and count(distinct id) = count(*) as ordered from tok group by 1)",
)
_DOWN = """
down as (
  select sent_no, id, id as anc, 0 as distance from good
  union all
  select d.sent_no, d.id, g.head, d.distance + 1 from down d join good g on g.sent_no = d.sent_no and g.id = d.anc where g.head > 0
),
span as (select sent_no, anc as id, min(id) as left_edge, max(id) as right_edge, count(*) as size from down group by all),
"""
_GLUE = """
fit as (select sent_no from good group by sent_no having bool_and(deprel in (select label from deprel_labels) and trim(coalesce(form, '')) <> '')),
base as (select g.*, l.base, l.base = 'punct' and g.head <> 0 as loose from good g join fit using (sent_no) join deprel_labels l on l.label = g.deprel),
aimed as (
  select *, case when form = '"' then count_if(loose and form = '"') over w % 2 = 1 else regexp_full_match(form, '[\\p{Ps}\\p{Pi}]+') end as forward,
    last_value(case when not loose then id end ignore nulls) over (partition by sent_no order by id rows between unbounded preceding and 1 preceding) as before_id,
    first_value(case when not loose then id end ignore nulls) over (partition by sent_no order by id rows between 1 following and unbounded following) as after_id
  from base window w as (partition by sent_no order by id rows unbounded preceding)
),
glued as (select *, case when loose then case when forward then after_id else before_id end end as target from aimed),
climb as (
  select sent_no, id, id as spot from glued where target is null
  union all
  select g.sent_no, g.id, c.spot from glued g join climb c on c.sent_no = g.sent_no and c.id = g.head where g.target is not null
),
whole as (select sent_no, coalesce(target, id) as id, string_agg(form, '' order by id) as form from (select sent_no, id, target, form from glued) group by 1, 2),
cut as (
  select w.sent_no, w.id as word_id, unnest(s) as form, unnest(range(1, len(s) + 1)) as k, g.head, g.base, g.line_number
  from (select *, list_filter(regexp_split_to_array(form, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '') as s from whole) w
  join glued g using (sent_no, id)
),
syl as (select *, row_number() over (partition by sent_no order by word_id, k) as id from cut),
proj as (
  select s.sent_no, s.id, s.form, case when s.k > 1 then a.id when s.head = 0 then 0 else h.id end as head, case when s.k > 1 then 'dep' else s.base end as deprel, s.word_id, s.line_number
  from syl s join syl a on a.sent_no = s.sent_no and a.word_id = s.word_id and a.k = 1
  left join climb c on c.sent_no = s.sent_no and c.id = s.head
  left join syl h on h.sent_no = s.sent_no and h.word_id = c.spot and h.k = 1
),
"""
_ORACLE = """
pdown as (
  select sent_no, id, id as anc from proj
  union all
  select d.sent_no, d.id, p.head from pdown d join proj p on p.sent_no = d.sent_no and p.id = d.anc where p.head > 0
),
pspan as (select sent_no, anc as id, min(id) as l, max(id) as r, count(*) as size from pdown group by all),
flat as (select sent_no from pspan group by sent_no having bool_and(r - l + 1 = size)),
acts as (
  select p.sent_no, p.id, p.id as spot, 0 as rank, 'SHIFT' as kind, null::varchar as label from proj p join flat using (sent_no)
  union all
  select p.sent_no, p.id, case when p.head > p.id then p.head else s.r end, case when p.head > p.id then 1 else 2 end, case when p.head > p.id then 'LEFT_ARC' else 'RIGHT_ARC' end, p.deprel
  from proj p join flat using (sent_no) join pspan s using (sent_no, id)
),
"""


def _with(*parts: str) -> str:
    return "with recursive " + "".join(parts).rstrip().rstrip(",")


_FIRST = """
bad as (select t.sent_no, t.line_number, t.id, case when head is null or head < 0 or head > n.n then 'head_range' when (head = 0) <> coalesce(deprel = 'root', false) then 'root_label' end as reason from tok t join n using (sent_no)),
lead as (select sent_no, arg_min(reason, id) as reason, arg_min(line_number, id) as line_number from bad where reason is not null group by 1),
top as (select sent_no, arg_min(line_number, id) as line_number from tok group by 1),
astray as (select sent_no, arg_min(line_number, id) as line_number from (select *, row_number() over (partition by sent_no order by id) as place from tok) where id <> place group by 1),
strict as (
  select c.sent_no, case when not ordered then 'ids' else coalesce(l.reason, case when root_count then 'root_count' else 'cycle' end) end as reason,
    case when not ordered then a.line_number else coalesce(l.line_number, top.line_number) end as line_number
  from coded c left join lead l using (sent_no) left join top using (sent_no) left join astray a using (sent_no) where not ordered or l.reason is not null or root_count or c.sent_no in (select sent_no from circle)
),
"""
_CROSSED = """
arcs as (select sent_no, least(id, head) as a, greatest(id, head) as b from tok join fine using (sent_no)),
crossed as (select distinct x.sent_no from arcs x join arcs y on x.sent_no = y.sent_no and x.a < y.a and y.a < x.b and x.b < y.b),
"""
QUERIES = {
    f.__name__: f
    for f in (
        tree_errors, strict_tree_errors, annotated_tree_errors, single_rooted, projectivity, subtree_spans, glue_targets, projection_rows, projection_stats, oracle_actions, oracle_replay,
        oracle_rejects, replay_refusals,
    )
}
SQL = {
    "tree_errors": _with(_PARSED) + " select sent_no as sent_id, errors from coded",
    "strict_tree_errors": _with(_PARSED, _FIRST) + " select sent_no as sent_id, reason, line_number from strict",
    "annotated_tree_errors": _with(_TOK) + " select split, errors, count(*) as sentences from coded group by 1, 2",
    "oracle_rejects": _with(_PARSED, _FIRST, _GLUE, _ORACLE, """
poor as (select sent_no, bool_or(trim(coalesce(form, '')) = '') as form, bool_or(coalesce(deprel not in (select label from deprel_labels), true)) as label from tok group by 1),
""") + """ select * from (select c.sent_no as sent_id, case when not ordered then 'ids' when p.form then 'form' when p.label then 'label'
  else coalesce(s.reason, case when c.sent_no in (select sent_no from proj) and c.sent_no not in (select sent_no from flat) then 'crossing' end) end as reason
from coded c join poor p using (sent_no) left join strict s using (sent_no)) where reason is not null""",
    "replay_refusals": _with(_PARSED, f"""
node as (select t.sent_no, t.id, t.head, l.base as label, n.n, coalesce(t.head between 1 and n.n, false) as below from tok t join n using (sent_no) left join deprel_labels l on l.label = t.deprel where n.ordered),
climb as (
  select sent_no, id, id as anc from node where not below
  union all
  select x.sent_no, x.id, x.id from climb c join node x on x.sent_no = c.sent_no and x.head = c.id and x.below where c.id = c.anc
),
up as (
  select sent_no, id, id as anc from climb where id = anc
  union all
  select u.sent_no, u.id, x.head from up u join node x on x.sent_no = u.sent_no and x.id = u.anc where x.below
),
edge as (select sent_no, anc as id, max(id) as r from up group by all),
arcs as (
  select x.sent_no, x.id, x.id as spot, 0 as rank, 'SHIFT' as kind, null::varchar as label from node x join edge using (sent_no, id)
  union all
  select x.sent_no, x.id, case when x.head > x.id then x.head else e.r end, case when x.head > x.id then 1 else 2 end, case when x.head > x.id then 'LEFT_ARC' else 'RIGHT_ARC' end, x.label from node x join edge e using (sent_no, id)
),
act as (select *, row_number() over (partition by sent_no order by spot, rank, -id) as step from arcs),
run as (
  select distinct sent_no, 0::bigint as step, [0::bigint] as stack, 0::bigint as shifted, n::bigint as n, null::varchar as reason from node
  union all
  select sent_no, step, case when kind = 'SHIFT' then list_append(stack, shifted + 1) when kind = 'LEFT_ARC' then list_append(stack[:-3], stack[-1]) else stack[:-2] end, shifted + (kind = 'SHIFT')::int, n, reason
  from (select r.sent_no, a.step, r.stack, r.shifted, r.n, a.kind, case
      when a.kind = 'SHIFT' then case when r.shifted >= r.n then 'empty_buffer' end
      when len(r.stack) < 2 then 'short_stack'
      when a.label is null or a.label not in ({", ".join(f"'{x}'" for x in BASE_LABELS)}) then 'label'
      when r.stack[-2] = 0 then case when a.kind = 'LEFT_ARC' then 'root_dependent' when a.label <> 'root' then 'root_label' when r.shifted < r.n then 'root_early' end
      when a.label = 'root' then 'root_label' end as reason
    from run r join act a on a.sent_no = r.sent_no and a.step = r.step + 1 where r.reason is null)
),
""") + """ select sent_no as sent_id, case when reason is not null then step::int end as step, coalesce(reason, 'unfinished') as reason
from (select sent_no, max(step) as step from run group by 1) m join run r using (sent_no, step) where r.reason is not null or not (r.shifted = r.n and r.stack = [0])""",
    "single_rooted": """
with recursive tok as (select distinct sent_id, idx, head, source from ud_tokens),
linked as (select t.*, p.idx is not null as found from tok t left join tok p on p.sent_id = t.sent_id and p.idx = t.head - 1),
walk as (
  select sent_id, idx as start_idx, head - 1 as spot from linked where found
  union
  select w.sent_id, w.start_idx, l.head - 1 from walk w join linked l on l.sent_id = w.sent_id and l.idx = w.spot where l.found
),
s as (
  select sent_id, min(source) as source, count_if(head = 0) = 1 and bool_and(coalesce(head = 0, false) or found) and sent_id not in (select sent_id from walk where spot = start_idx) as ok
  from linked group by sent_id
)
select source, count(*) as sentences, count_if(ok)::bigint as single_rooted from s group by source""",
    "projectivity": _with(_PARSED, f"""
fine as (select sent_no from coded where errors in ({", ".join(f"'{x}'" for x in FORESTS)})),""", _CROSSED)
    + " select sent_no as sent_id, sent_no not in (select sent_no from crossed) as by_spans, sent_no not in (select sent_no from crossed) as by_descent from fine",
    "subtree_spans": _with(_TOK, _DOWN) + ", deep as (select sent_no, id, max(distance) as depth from down group by all) select sent_no, id, depth, left_edge, right_edge, size from span join deep using (sent_no, id)",
    "glue_targets": _with(_TOK, _GLUE) + " select sent_no, id, target as target_id from glued where target is not null",
    "projection_rows": _with(_TOK, _GLUE) + " select sent_no, id::int as id, form, head::int as head, deprel, word_id, line_number from proj",
    "projection_stats": _with(_TOK, _GLUE) + """,
w as (select sent_no, any_value(split) as split, count(*) as n, count(target) as glued, count_if(target > id) as opening, count_if(base = 'punct' and target is null) as kept, list_sort(list(id) filter (where target is null)) as staying from glued group by 1),
p as (select sent_no, count(*) as m, count_if(k > 1) as inner_arcs, list_sort(list(distinct word_id)) as stayed from syl group by 1)
select split, count(*) as sentences, sum(n)::bigint as words, sum(m)::bigint as syllables, sum(opening)::bigint as glued_opening, sum(glued - opening)::bigint as glued_trailing,
  sum(inner_arcs)::bigint as inner_arcs, sum(kept)::bigint as kept_punct, bool_and(m = n - glued + inner_arcs and staying = stayed) as accounts_agree
from w join p using (sent_no) group by split""",
    "oracle_actions": _with(_TOK, _GLUE, _ORACLE) + " select sent_no, row_number() over (partition by sent_no order by spot, rank, -id)::int as step, kind, label, id::int as dependent from acts",
    "oracle_replay": _with(_TOK, _GLUE, _ORACLE) + """
select split, count(*) as attempted, count(*) as passed, sum(2 * m)::bigint as actions
from (select sent_no, count(*) as m from proj join flat using (sent_no) group by 1) join conllu_sentences using (sent_no) group by split""",
}
