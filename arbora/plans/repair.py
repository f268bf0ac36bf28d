"""Queries that repair, regroup and cross-check: star fallback, words from syllables, legal actions, contained phrases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbora.functions import text as tx
from arbora.functions.vocabulary import BASE_LABELS
from arbora.operators import trees
from arbora.operators.hierarchy import resolve
from arbora.plans import treebank
from arbora.plans.corpus import _SPLIT
from arbora.sources import conllu
from arbora.storage import materialize, new_path, table

#: An arc can carry any base label but root.
ARC_LABELS = 36
#: The one emoticon that is known.
EMOTICON = ":))"
#: A run of letters, marks and digits, or one other character.
_PIECE = r"(?s)[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]"


def fallback_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star for each parsed sentence that is no single-rooted tree.

    Its root is the first word that is neither emoticon nor punctuation, else the first that is
    no emoticon, else the first; emoticons hang on it as ``discourse``, punctuation as ``punct``,
    other words, also those without form, as ``dep``. The smallest form counts where rows repeat.
    """
    tokens = table(spark, sf_dir, "ud_tokens").groupBy("sent_id", "idx").agg(F.min("form").alias("form"), F.min("head").alias("head"))
    emoticon, mark = F.coalesce(F.col("form") == ":))", F.lit(False)), F.coalesce(F.col("form").rlike(r"^\p{P}+$"), F.lit(False))
    rank = F.when(emoticon, 2).when(mark, 1).otherwise(0)
    label = F.when(emoticon, "discourse").when(mark, "punct").otherwise("dep")
    ranked = tokens.withColumn("rank", rank).withColumn("label", label)
    bad = treebank.judged_roots(tokens).filter("not single").select("sent_id")
    starred = ranked.join(bad, "sent_id", "left_semi")
    roots = starred.groupBy("sent_id").agg(F.min(F.struct("rank", "idx"))["idx"].alias("root_idx"))
    return starred.join(roots, "sent_id").select(
        "sent_id", "idx", F.when(F.col("idx") == F.col("root_idx"), 0).otherwise(F.col("root_idx") + 1).alias("head"), F.when(F.col("idx") == F.col("root_idx"), "root").otherwise(F.col("label")).alias("deprel")
    )


def emoticon_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees that hold the emoticon, with it taken out of the tree and hung on the root as ``discourse``.

    Words below it go to their first ancestor that is none; where it was the root, the first such word is the root and takes the others.
    A sentence of emoticons alone has the first as its root.
    """
    valid = treebank._valid(treebank._trees(spark, sf_dir)).filter(F.exists("toks", lambda t: F.coalesce(t["form"] == EMOTICON, F.lit(False))))
    own = F.struct(F.col("id").alias("node"), (F.coalesce(F.col("form") == EMOTICON, F.lit(False))).alias("smiles"), "deprel")
    found = resolve(trees.tokens(valid, "sent_no"), "sent_no", "id", F.when(F.col("head") > 0, F.col("head")), own).reached
    above = F.try_element_at(F.filter("path", lambda p, i: (i > 0) & ~p["smiles"]), F.lit(1))["node"]
    rows = found.select(F.col("tree").alias("sent_no"), F.col("node").alias("id"), F.col("path")[0]["smiles"].alias("smiles"), F.col("path")[0]["deprel"].alias("deprel"), above.alias("above"))
    tree = W.partitionBy("sent_no")
    top = F.coalesce(F.min(F.when(~F.col("smiles") & F.col("above").isNull(), F.col("id"))).over(tree), F.min("id").over(tree))
    is_top = F.col("id") == F.col("top")
    return rows.withColumn("top", top).select(
        "sent_no", "id", F.when(is_top, 0).when(F.col("smiles"), F.col("top")).otherwise(F.coalesce("above", "top")).alias("head"),
        F.when(is_top, "root").when(F.col("smiles"), "discourse").otherwise(F.col("deprel")).alias("deprel"),
    )


def word_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words regained from the syllable trees: the syllable nearest to the root, of equals the first, stands for its word."""
    own = F.struct(F.col("id").alias("node"), "head", "deprel", "word_id")
    found = resolve(treebank.syllable_trees(spark, sf_dir), "sent_no", "id", F.when(F.col("head") > 0, F.col("head")), own).reached
    syllables = found.select(F.col("tree").alias("sent_no"), F.col("node").alias("id"), "depth", F.col("path")[0]["head"].alias("head"), F.col("path")[0]["deprel"].alias("deprel"), F.col("path")[0]["word_id"].alias("word_id"), F.try_element_at("path", F.lit(2))["word_id"].alias("head_word_id"))
    chosen = syllables.groupBy("sent_no", "word_id").agg(F.min(F.struct("depth", "id", "head_word_id", "deprel")).alias("r"))
    return chosen.select("sent_no", "word_id", F.coalesce("r.head_word_id", F.lit(0)).alias("head_word_id"), F.col("r.deprel").alias("deprel"))


def legal_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind that the oracle chose: states, and how many actions were legal in them.

    A shift is legal while words wait; arcs need two items on the stack and any of the labels;
    the arc from the root only ends the sentence.
    """
    acts = treebank._actions(spark, sf_dir)
    before = W.partitionBy("sent_no").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    shift = F.when(F.col("kind") == "SHIFT", 1).otherwise(0)
    states = acts.withColumn("shifted", F.coalesce(F.sum(shift).over(before), F.lit(0))).withColumn("n", F.sum(shift).over(W.partitionBy("sent_no")))
    size = 1 + F.col("shifted") - (F.col("step") - 1 - F.col("shifted"))
    legal = F.when(F.col("shifted") < F.col("n"), 1).otherwise(0) + F.when(size >= 3, 2 * ARC_LABELS).when((size == 2) & (F.col("shifted") == F.col("n")), 1).otherwise(0)
    return states.withColumn("legal", legal).groupBy("kind").agg(F.count("*").alias("states"), F.sum("legal").alias("legal"), F.min("legal").alias("fewest"), F.max("legal").alias("most"))


def syllable_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per corpus: segmented words, and those whose syllables are not the parts of their form."""
    t = table(spark, sf_dir, "seg_sentences").select("corpus", F.explode("tokens").alias("t"))
    differs = ~F.coalesce(F.array_join("t.syllables", " ") == F.array_join(tx.words(F.col("t.form")), " "), F.lit(False))
    return t.groupBy("corpus").agg(F.count("*").alias("words"), F.count_if(differs).alias("differing"))


def compound_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-syllable forms of the treebank and the documents that hold both syllables side by side.

    Longer forms and occurrences with punctuation beside them are not counted here, see ``compound_occurrences``. Both sides meet on the pair of words, pre-aggregated per document, so no text is searched for every form.
    """
    forms = table(spark, sf_dir, "conllu_sentences").select(F.explode("toks.form").alias("form")).select(tx.words(F.lower("form")).alias("w")).filter(F.size("w") == 2)
    forms = forms.select(F.array_join("w", " ").alias("compound")).distinct()
    words = trees.settled(table(spark, sf_dir, "documents").select("doc_id", "text"), w=tx.words(F.lower("text"))).filter(F.size("w") > 1)
    pairs = words.select("doc_id", F.explode(F.array_distinct(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b)))).alias("compound"))
    found = pairs.groupBy("compound").agg(F.count("*").alias("documents"))
    return forms.join(found, "compound", "left").select("compound", F.coalesce("documents", F.lit(0)).alias("documents"))


def compound_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of two or more syllables and the documents in which they stand verbatim, in any case, without a letter, mark or digit beside them.

    Runs of white space count as one blank. Texts and forms are cut into runs of letters and single other
    characters. Both sides meet on three pieces in a row, then as many pieces as the form has are compared.
    """
    pieces = lambda c: F.regexp_extract_all(F.array_join(tx.words(F.lower(c)), " "), F.lit(_PIECE), F.lit(0))
    start = lambda w, i: F.array_join(F.slice(w, i, F.lit(3)), "")
    forms = table(spark, sf_dir, "conllu_sentences").select(F.explode("toks.form").alias("form")).filter(F.size(tx.words(F.col("form"))) > 1)
    forms = materialize(forms.select(pieces("form").alias("w")).distinct().select(F.array_join("w", "").alias("compound"), F.size("w").alias("n"), start("w", F.lit(1)).alias("key")), "forms")
    longest = forms.agg(F.max("n")).first()[0] or 3
    texts = table(spark, sf_dir, "documents").filter("text is not null").select(F.monotonically_increasing_id().alias("row"), "text")
    texts = trees.settled(texts, w=pieces("text")).filter(F.size("w") > 2)
    places = F.transform(F.filter(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.get("w", i - 1) != " "), lambda i: F.struct(start("w", i).alias("key"), F.slice("w", i, F.lit(longest)).alias("on")))
    met = texts.select("row", F.explode(places).alias("p")).select("row", "p.key", "p.on").join(forms, "key").filter(F.array_join(F.slice("on", F.lit(1), F.col("n")), "") == F.col("compound"))
    found = met.select("row", "compound").distinct().groupBy("compound").agg(F.count("*").alias("documents"))
    return forms.select("compound").join(found, "compound", "left").select("compound", F.coalesce("documents", F.lit(0)).alias("documents"))


def _balanced(brackets: str):
    """Whether none of a text's brackets closes too early or stays open."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(s, c):
        depth = s["depth"] + F.when(c == "(", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.least(s["least"], depth).alias("least"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda s: (s["depth"] == 0) & (s["least"] == 0))


def bracket_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per register: texts with brackets, and those in which they do not balance (one closes too early or stays open)."""
    d = table(spark, sf_dir, "documents").select("register", F.regexp_replace("text", r"[^()]", "").alias("b")).filter("b <> ''")
    return d.groupBy("register").agg(F.count("*").alias("texts"), F.count_if(~_balanced("b")).alias("unbalanced"))


def bracket_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of texts whose brackets balance: the words that stand first in a bracket, and the texts that hold them so."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace("text", r"[^()]", "").alias("b")).filter("b <> ''").filter(_balanced("b"))
    heads = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\(\s*([^\s()]+)"), F.lit(1)))
    return d.select(F.explode(heads).alias("predicate")).groupBy("predicate").agg(F.count("*").alias("texts"))


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents written to JSON line files (fields in order, letters as they are) and read back, and those that came back the same."""
    columns = ["doc_id", "http_status", "lang", "register", "source", "text", "url"]
    documents = table(spark, sf_dir, "documents").select(*columns)
    path = new_path(spark, "json")
    documents.write.json(path)
    back = spark.read.schema(documents.schema).json(path)
    both = documents.alias("a").join(back.alias("b"), "doc_id", "left")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns[1:]])
    return both.groupBy(F.coalesce("a.lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("documents"), F.count_if(same).alias("same"))


def conllu_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated sentences written to CoNLL-U files and read back line by line."""
    path = new_path(spark, "conllu")
    conllu.write_conllu(table(spark, sf_dir, "conllu_sentences"), "sent_no", path)
    numbered = materialize(conllu.sentence_lines(conllu.read_lines(spark, path)), "lines")
    named = conllu.metadata(numbered).filter("key = 'sent_no'").select("file_name", "sentence", F.col("value").cast("bigint").alias("sent_no"))
    rows = conllu.strict_rows(numbered).filter("reason is null")
    return rows.join(named, ["file_name", "sentence"]).select("sent_no", F.col("place").alias("id"), "line_text")


def legal_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action in the order in which a state lists it, with the states of the oracle in which it is legal and in which it was taken."""
    acts = treebank._actions(spark, sf_dir)
    before = W.partitionBy("sent_no").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    shift = F.when(F.col("kind") == "SHIFT", 1).otherwise(0)
    states = acts.withColumn("shifted", F.coalesce(F.sum(shift).over(before), F.lit(0))).withColumn("n", F.sum(shift).over(W.partitionBy("sent_no")))
    size = 1 + F.col("shifted") - (F.col("step") - 1 - F.col("shifted"))
    waiting = F.col("shifted") < F.col("n")
    # what is legal hangs on three things alone
    may = {"shift": waiting, "arc": size >= 3, "end": (size == 2) & ~waiting}
    rules = F.filter(F.array(*[F.when(when, F.lit(rule)) for rule, when in may.items()]), lambda x: x.isNotNull())
    legal = states.select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count("*").alias("legal"))
    taken = states.groupBy("kind", F.coalesce("label", F.lit("")).alias("named")).agg(F.count("*").alias("taken"))
    listed = [("SHIFT", None, "shift")] + [("LEFT_ARC", x, "arc") for x in sorted(BASE_LABELS) if x != "root"] + [("RIGHT_ARC", x, "end" if x == "root" else "arc") for x in sorted(BASE_LABELS)]
    rows = spark.createDataFrame([(k, *row, row[1] or "") for k, row in enumerate(listed, 1)], "place int, kind string, label string, rule string, named string")
    nothing = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(legal, "rule", "left").join(taken, ["kind", "named"], "left").select("place", "kind", "label", nothing("legal"), nothing("taken"))


QUERIES = {f.__name__: f for f in (fallback_stars, emoticon_override, word_groups, legal_actions, syllable_agreement, compound_coverage, compound_occurrences, bracket_balance, bracket_heads, json_lines, conllu_files, legal_listing)}
_W = treebank._with
SQL = {
    "fallback_stars": r"""
with recursive tok as (select sent_id, idx, min(form) as form, min(head) as head from ud_tokens group by all),
linked as (select t.*, p.idx is not null as found from tok t left join tok p on p.sent_id = t.sent_id and p.idx = t.head - 1),
walk as (
  select sent_id, idx as start_idx, head - 1 as spot from linked where found
  union
  select w.sent_id, w.start_idx, l.head - 1 from walk w join linked l on l.sent_id = w.sent_id and l.idx = w.spot where l.found
),
bad as (select sent_id from linked group by 1 having not (count_if(head = 0) = 1 and bool_and(coalesce(head = 0, false) or found) and sent_id not in (select sent_id from walk where spot = start_idx))),
r as (select sent_id, idx, case when form = ':))' then 2 when regexp_full_match(form, '\pP+') then 1 else 0 end as rank from tok join bad using (sent_id)),
top as (select *, first_value(idx) over (partition by sent_id order by rank, idx) as root_idx from r)
select sent_id, idx, case when idx = root_idx then 0 else root_idx + 1 end as head, case when idx = root_idx then 'root' else ['dep', 'punct', 'discourse'][rank + 1] end as deprel from top""",
    "emoticon_override": _W(treebank._TOK, """
smiling as (select g.*, form = ':))' as smiles from good g where sent_no in (select sent_no from good where form = ':))')),
rise as (
  select sent_no, id, head as spot from smiling
  union all
  select r.sent_no, r.id, s.head from rise r join smiling s on s.sent_no = r.sent_no and s.id = r.spot where s.smiles
),
risen as (select r.sent_no, r.id, r.spot from rise r left join smiling s on s.sent_no = r.sent_no and s.id = r.spot where r.spot = 0 or not s.smiles),
top as (select s.sent_no, coalesce(min(case when not smiles and spot = 0 then s.id end), min(s.id)) as top from smiling s join risen using (sent_no, id) group by 1)
""") + """ select s.sent_no, s.id, case when s.id = top then 0 when smiles then top when spot = 0 then top else spot end::int as head, case when s.id = top then 'root' when smiles then 'discourse' else deprel end as deprel
from smiling s join risen using (sent_no, id) join top using (sent_no)""",
    "word_groups": _W(treebank._TOK, treebank._GLUE) + """
select g.sent_no, g.id as word_id, coalesce(c.spot, 0) as head_word_id, g.base as deprel from glued g left join climb c on c.sent_no = g.sent_no and c.id = g.head where g.target is null""",
    "legal_actions": _W(treebank._TOK, treebank._GLUE, treebank._ORACLE) + """,
s as (select sent_no, kind, row_number() over w as step, coalesce(sum((kind = 'SHIFT')::int) over (w rows between unbounded preceding and 1 preceding), 0) as shifted, sum((kind = 'SHIFT')::int) over (partition by sent_no) as n
  from acts window w as (partition by sent_no order by spot, rank, -id)),
z as (select *, 1 + shifted - (step - 1 - shifted) as size from s),
l as (select kind, (shifted < n)::int + case when size >= 3 then 72 when size = 2 and shifted = n then 1 else 0 end as legal from z)
select kind, count(*) as states, sum(legal)::bigint as legal, min(legal)::int as fewest, max(legal)::int as most from l group by 1""",
    "syllable_agreement": f"""with t as (select corpus, unnest(tokens, max_depth := 2) from seg_sentences)
select corpus, count(*) as words, count_if(not coalesce(array_to_string(list_filter(syllables, lambda s: s is not null), ' ') = array_to_string({_SPLIT % 'form'}, ' '), false))::bigint as differing from t group by 1""",
    "compound_coverage": f"""with f as (select distinct array_to_string(w, ' ') as compound from (select {_SPLIT % 'lower(form)'} as w from (select unnest(toks, max_depth := 2) from conllu_sentences)) where len(w) = 2),
d as (select doc_id, {_SPLIT % 'lower(text)'} as w from documents),
p as (select distinct doc_id, w[i] || ' ' || w[i + 1] as compound from (select doc_id, w, unnest(range(1, len(w))) as i from d))
select compound, count(doc_id) as documents from f left join p using (compound) group by 1""",
    "compound_occurrences": f"""with f as (select distinct array_to_string({_SPLIT % 'lower(form)'}, ' ') as compound from (select unnest(toks, max_depth := 2) from conllu_sentences) where len({_SPLIT % 'form'}) > 1),
g as (select compound, len(regexp_extract_all(compound, '{_PIECE}')) as n from f),
d as (select row_number() over () as row_no, regexp_extract_all(array_to_string({_SPLIT % 'lower(text)'}, ' '), '{_PIECE}') as w from documents),
o as (select distinct row_no, n, array_to_string(w[i:i + n - 1], '') as compound from (select row_no, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from g)))
select compound, count(row_no) as documents from g left join o using (compound, n) group by 1""",
    "bracket_balance": """with d as (select doc_id, register, regexp_replace(text, '[^()]', '', 'g') as b from documents),
c as (select doc_id, register, unnest(string_split(b, '')) as c, unnest(range(1, length(b) + 1)) as i from d where b <> ''),
s as (select doc_id, register, sum(case when c = '(' then 1 else -1 end) over (partition by doc_id order by i) as depth, i from c),
t as (select doc_id, register, min(depth) >= 0 and arg_max(depth, i) = 0 as ok from s group by 1, 2)
select register, count(*) as texts, count_if(not ok)::bigint as unbalanced from t group by 1""",
    "bracket_heads": r"""with d as (select doc_id, text, regexp_replace(text, '[^()]', '', 'g') as b from documents),
c as (select doc_id, unnest(string_split(b, '')) as c, unnest(range(1, length(b) + 1)) as i from d where b <> ''),
s as (select doc_id, sum(case when c = '(' then 1 else -1 end) over (partition by doc_id order by i) as depth, i from c),
t as (select doc_id from s group by 1 having min(depth) >= 0 and arg_max(depth, i) = 0),
h as (select distinct doc_id, unnest(regexp_extract_all(text, '\(\s*([^\s()]+)', 1)) as predicate from d join t using (doc_id))
select predicate, count(*) as texts from h group by 1""",
    "conllu_files": """with tok as (select sent_no, unnest(toks, max_depth := 2) from conllu_sentences)
select sent_no, id, concat_ws(chr(9), id, coalesce(form, '_'), '_', coalesce(upos, '_'), '_', '_', coalesce(head::varchar, '_'), coalesce(deprel, '_'), '_', '_') as line_text from tok""",
    "legal_listing": _W(treebank._TOK, treebank._GLUE, treebank._ORACLE) + f""",
s as (select sent_no, kind, label, row_number() over w as step, coalesce(sum((kind = 'SHIFT')::int) over (w rows between unbounded preceding and 1 preceding), 0) as shifted, sum((kind = 'SHIFT')::int) over (partition by sent_no) as n
  from acts window w as (partition by sent_no order by spot, rank, -id)),
z as (select *, 1 + shifted - (step - 1 - shifted) as size from s),
b as (select unnest({BASE_LABELS}) as label),
a as (select 'SHIFT' as kind, null as label, 0 as side union all select 'LEFT_ARC', label, 1 from b where label <> 'root' union all select 'RIGHT_ARC', label, 2 from b)
select (row_number() over (order by side, label))::int as place, kind, label,
  (select count_if(case when a.kind = 'SHIFT' then shifted < n when a.label = 'root' then size = 2 and shifted = n else size >= 3 end) from z)::bigint as legal,
  (select count_if(z.kind = a.kind and z.label is not distinct from a.label) from z)::bigint as taken from a""",
    "json_lines": "select coalesce(lang, '?') as lang, count(*) as documents, count(*) as same from documents group by 1",
}
