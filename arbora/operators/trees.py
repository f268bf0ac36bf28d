"""Operators on dependency trees.

Validity is judged on one tree per row (``toks``, an array of structs with id, form, upos, head and
deprel) by array functions, without a shuffle; pointer doubling keeps the number of rounds at the
logarithm of the length. Null and empty token arrays are trees without root. All else works on one
row per token, by windows and groups over the sentence, so a long sentence costs no more for each token.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.functions.text import is_opening, label_base, words
from arbora.functions.vocabulary import BASE_LABELS
from arbora.operators.hierarchy import resolve


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row. Nested array functions would otherwise be
    written into each other and computed anew for every element; a generator keeps them apart."""
    one = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.select("*", one.alias("__once")).select(*kept, *[F.col(f"__once.{name}").alias(name) for name in columns])


def _field(toks: Column, name: str) -> Column:
    return F.transform(toks, lambda t: t[name])


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _rounds(n: Column) -> Column:
    return F.sequence(F.lit(1), F.ceil(F.log2(n + 2)).cast("int") + 1)


def heads(toks: Column) -> Column:
    """The heads, with null as -1."""
    return F.transform(toks, lambda t: F.coalesce(t["head"], F.lit(-1)))


def chase(parents: Column, n: Column) -> Column:
    """Where each node ends after more steps than the tree has nodes: 0, or on a circle. Parents must lie in 0..n."""
    step = lambda p, _: F.transform(p, lambda x: F.when(x > 0, F.element_at(p, F.greatest(x, F.lit(1)))).otherwise(x))
    return F.aggregate(_rounds(n), parents, step)


def with_tree(df: DataFrame) -> DataFrame:
    """Adds n, heads, ``consecutive`` ids, and ``ends`` (the chased parents, where invalid heads end the way)."""
    toks = F.coalesce(F.col("toks"), F.array().cast(df.schema["toks"].dataType))
    df = settled(df, toks=toks, n=F.size(toks), heads=heads(toks))
    df = settled(df, consecutive=_field(F.col("toks"), "id") == _upto(F.col("n")), safe=F.transform("heads", lambda h: F.when(h.between(0, F.col("n")), h).otherwise(0)))
    return settled(df, ends=chase(F.col("safe"), F.col("n")))


def diagnosis() -> Column:
    """Sorted error codes joined by commas; the empty text for a valid tree. Needs ``with_tree``."""
    toks, n = F.col("toks"), F.col("n")
    bad_label = F.exists(toks, lambda t: (F.coalesce(t["head"], F.lit(-1)) == 0) != (F.coalesce(t["deprel"], F.lit("")) == "root"))
    # The codes of the defects.
    codes = F.array(
        F.when(F.exists("ends", lambda e: e > 0), "cycle"),
        F.when(F.exists("heads", lambda h: ~h.between(0, n)), "invalid_head"),
        F.when(F.size(F.filter("heads", lambda h: h == 0)) != 1, "root_count"),
        F.when(bad_label, "root_label"),
    )
    return F.when(~F.coalesce("consecutive", F.lit(False)), "nonconsecutive_ids").otherwise(F.concat_ws(",", F.array_compact(codes)))


def first_defect() -> Column:
    """(reason, line_number) of what a strict reader reports first; null for a valid tree. Needs ``with_tree``.

    Ids that do not count from 1 come first; heads outside the sentence and root labels are judged
    token by token, then the number of roots, then circles.
    """
    toks, n = F.col("toks"), F.col("n")
    judged = F.transform(
        toks,
        lambda t: F.struct(
            F.when(~F.coalesce(t["head"].between(0, n), F.lit(False)), "head_range").when((t["head"] == 0) != (F.coalesce(t["deprel"], F.lit("")) == "root"), "root_label").alias("reason"),
            t["line_number"].alias("line_number"),
        ),
    )
    local = F.try_element_at(F.filter(judged, lambda j: j["reason"].isNotNull()), F.lit(1))
    at = lambda reason, line: F.struct(F.lit(reason).alias("reason"), line.alias("line_number"))
    first_line = F.try_element_at(toks, F.lit(1))["line_number"]
    misplaced = F.try_element_at(F.filter("toks", lambda t, i: ~F.coalesce(t["id"] == i + 1, F.lit(False))), F.lit(1))["line_number"]
    return (
        F.when(~F.coalesce("consecutive", F.lit(False)), at("ids", misplaced))
        .when(local.isNotNull(), local)
        .when(F.size(F.filter("heads", lambda h: h == 0)) != 1, at("root_count", first_line))
        .when(F.exists("ends", lambda e: e > 0), at("cycle", first_line))
    )


def tokens(df: DataFrame, key: str, *kept: str) -> DataFrame:
    """One row per token of ``toks``."""
    return df.select(key, *kept, F.explode("toks").alias("t")).select(key, *kept, "t.*")


def ancestors(toks: DataFrame, key: str) -> DataFrame:
    """(key, id, depth, distance, ancestor, head, deprel): each token with itself at distance 0 and all above it, and the
    ancestor's head and label. Tokens on circles, or below one, have no rows. Trees may have any size, see ``hierarchy``."""
    up = F.when(F.col("head") > 0, F.col("head"))
    found = resolve(toks, key, "id", up, F.struct(F.col("id").alias("node"), "head", "deprel")).reached
    pairs = found.select(F.col("tree").alias(key), F.col("node").alias("id"), "depth", F.posexplode("path").alias("distance", "a"))
    return pairs.select(key, "id", "depth", "distance", F.col("a.node").alias("ancestor"), "a.head", "a.deprel")


def spans(pairs: DataFrame, key: str) -> DataFrame:
    """(key, id, head, deprel, depth, left_edge, right_edge, size) of each subtree, by ``ancestors``."""
    return pairs.groupBy(key, F.col("ancestor").alias("id")).agg(
        F.first("head").alias("head"), F.first("deprel").alias("deprel"), F.first(F.col("depth") - F.col("distance")).alias("depth"),
        F.min(pairs["id"]).alias("left_edge"), F.max(pairs["id"]).alias("right_edge"), F.count("*").alias("size"),
    )


def projective(pairs: DataFrame, key: str) -> DataFrame:
    """(key, by_spans, by_descent) of each tree: whether every subtree fills its span, and whether all tokens between a token
    and its dependents descend from it. For the second the outermost dependents suffice, as the inner arcs lie within."""
    own = W.partitionBy(key, "ancestor")
    near = F.when(F.col("distance") <= 1, F.col("id"))
    ranged = pairs.withColumn("lo", F.min(near).over(own)).withColumn("hi", F.max(near).over(own))
    each = ranged.groupBy(key, "ancestor").agg(
        (F.max("id") - F.min("id") + 1 == F.count("*")).alias("whole"), (F.count_if(F.col("id").between(F.col("lo"), F.col("hi"))) == F.first("hi") - F.first("lo") + 1).alias("under")
    )
    return each.groupBy(key).agg(F.bool_and("whole").alias("by_spans"), F.bool_and("under").alias("by_descent"))


def glue(toks: DataFrame, key: str) -> DataFrame:
    """Adds ``base`` labels and ``target``: the kept token that a token is glued to, or null.

    Punctuation below the root goes to the next kept token after it if it opens (opening marks,
    every odd straight quote) and before it otherwise; without one it is kept. For valid trees.
    """
    rows = toks.withColumn("base", label_base(F.col("deprel")))
    rows = rows.withColumn("loose", F.coalesce((F.col("base") == "punct") & (F.col("head") != 0), F.lit(False)))
    fixed = F.when(~F.col("loose"), F.col("id"))
    upwards, downwards = W.partitionBy(key).orderBy("id"), W.partitionBy(key).orderBy(F.desc("id"))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    quote = F.col("loose") & (F.col("form") == '"')
    odd = F.sum(F.when(quote, 1).otherwise(0)).over(upwards.rowsBetween(W.unboundedPreceding, 0)) % 2 == 1
    forward = F.when(F.col("form") == '"', odd).otherwise(is_opening(F.col("form")))
    before, after = F.last(fixed, ignorenulls=True).over(earlier(upwards)), F.last(fixed, ignorenulls=True).over(earlier(downwards))
    return rows.withColumn("target", F.when(F.col("loose"), F.when(forward, after).otherwise(before)))


def project(glued: DataFrame, key: str) -> DataFrame:
    """The trees on syllables: (key, id, form, upos, head, deprel, line_number, word_id, inner).

    Glued punctuation joins the form of its target; a kept word's first syllable carries its
    arc, further syllables (``inner``) hang on the first as ``dep``; heads that were glued away are
    replaced by their own heads. Needs ``glue``, valid trees with known labels and non-blank forms.
    All steps but the first stay with the sentence, so its rows are exchanged once.
    """
    word = F.coalesce("target", "id").alias("word_id")
    parts = glued.groupBy(key, word).agg(F.sort_array(F.collect_list(F.struct("id", "form", "head", "base", "line_number"))).alias("parts"))
    cut = parts.withColumn("cut", words(F.array_join(F.transform("parts", lambda p: p["form"]), "")))
    so_far = W.partitionBy(key).orderBy("word_id").rowsBetween(W.unboundedPreceding, -1)
    placed = cut.withColumn("start", F.coalesce(F.sum(F.size("cut")).over(so_far), F.lit(0)).cast("int") + 1)
    own = lambda p, c: F.when(p["id"] == F.col("word_id"), F.col(c)).alias(c)
    members = F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["head"].alias("head"), p["base"].alias("base"), p["line_number"].alias("line_number"), own(p, "start"), own(p, "cut")))
    whole = placed.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list(members))).alias("t"))
    kept_parent = F.transform("t", lambda x: F.when(x["start"].isNotNull(), x["id"]).otherwise(x["head"]))
    whole = settled(whole, kept_parent=kept_parent, starts=F.transform("t", lambda x: x["start"]))
    whole = settled(whole, up=chase(F.col("kept_parent"), F.size("t")))
    kept_head = lambda h: F.element_at("starts", F.element_at("up", F.greatest(h, F.lit(1))))
    arcs = F.transform("t", lambda x: F.struct(x["id"].alias("word_id"), x["base"].alias("base"), x["line_number"].alias("line_number"), x["start"].alias("start"), x["cut"].alias("cut"), F.when(x["head"] > 0, kept_head(x["head"])).otherwise(0).alias("anchor")))
    rows = settled(whole, arcs=arcs).select(key, F.explode("arcs").alias("a")).select(key, "a.*").filter("start is not null").select("*", F.posexplode("cut").alias("k", "form"))
    first = F.col("k") == 0
    return rows.select(
        key, (F.col("start") + F.col("k")).alias("id"), "form", F.lit("X").alias("upos"), F.when(first, F.col("anchor")).otherwise(F.col("start")).alias("head"),
        F.when(first, F.col("base")).otherwise(F.lit("dep")).alias("deprel"), "line_number", "word_id", (~first).alias("inner"),
    )


def oracle_actions(edges: DataFrame, key: str) -> DataFrame:
    """(key, step, kind, label, dependent, head): the static arc-standard oracle of the projective ones among valid trees, in closed form.

    The oracle attaches a left dependent when its head lies on top and a right one when its
    subtree is complete, so the actions are the shifts and arcs ordered by the buffer position
    at which each becomes possible, arcs of one position from the inside out. Needs ``spans``.
    """
    flat = F.bool_and(F.col("right_edge") - F.col("left_edge") + 1 == F.col("size")).over(W.partitionBy(key))
    toks = edges.withColumn("flat", flat).filter("flat")
    shift = F.struct(F.col("id").alias("at"), F.lit(0).alias("rank"), F.lit(0).alias("order"), F.lit("SHIFT").alias("kind"), F.lit(None).cast("string").alias("label"))
    left = F.col("head") > F.col("id")
    arc = F.struct(
        F.when(left, F.col("head")).otherwise(F.col("right_edge")).alias("at"), F.when(left, 1).otherwise(2).alias("rank"), (-F.col("id")).alias("order"),
        F.when(left, "LEFT_ARC").otherwise("RIGHT_ARC").alias("kind"), F.col("deprel").alias("label"),
    )
    rows = toks.select(key, "id", "head", F.explode(F.array(shift, arc)).alias("a"))
    return rows.select(
        key, F.row_number().over(W.partitionBy(key).orderBy("a.at", "a.rank", "a.order")).alias("step"), "a.kind", "a.label", F.col("id").alias("dependent"), "head"
    )


def refusal(stack: list[int], waiting: bool, kind: str, label: str | None) -> str | None:
    """Why an action is not legal, or None. An arc to the root (0) ends the sentence: it comes last and alone carries ``root``."""
    if kind == "SHIFT":
        return "label" if label is not None else None if waiting else "empty_buffer"
    if kind not in ("LEFT_ARC", "RIGHT_ARC"):
        return "kind"
    if len(stack) < 2:
        return "short_stack"
    if label not in BASE_LABELS:
        return "label"
    if stack[-2] == 0:
        if kind == "LEFT_ARC":
            return "root_dependent"
        return "root_label" if label != "root" else "root_early" if waiting else None
    return "root_label" if label == "root" else None


def run_actions(n: int, kinds: list[str], labels: list[str | None]) -> tuple[list[int | None], list[str | None], int | None, str | None]:
    """Heads and labels that the actions build over n tokens, and the step (from 1) and reason of the first one that is refused; what follows is not run."""
    heads, given = [None] * n, [None] * n
    stack, shifted = [0], 0
    for step, (kind, label) in enumerate(zip(kinds, labels), 1):
        reason = refusal(stack, shifted < n, kind, label)
        if reason:
            return heads, given, step, reason
        if kind == "SHIFT":
            shifted += 1
            stack.append(shifted)
        else:
            child = stack.pop(-2 if kind == "LEFT_ARC" else -1)
            heads[child - 1], given[child - 1] = stack[-1], label
    return heads, given, None, None if shifted == n and stack == [0] else "unfinished"


_RAN = T.StructType(
    [T.StructField("heads", T.ArrayType(T.IntegerType())), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("step", T.IntegerType()), T.StructField("reason", T.StringType())]
)


@F.pandas_udf(_RAN)
def replay(n: pd.Series, kinds: pd.Series, labels: pd.Series) -> pd.DataFrame:
    """``run_actions`` of each sentence; null actions are none."""
    ran = [run_actions(int(m), [] if k is None else list(k), [] if x is None else list(x)) for m, k, x in zip(n, kinds, labels)]
    out = pd.DataFrame(ran, columns=["heads", "labels", "step", "reason"])
    return out.astype({"step": "Int32"})
