from itertools import product

from pyspark.sql import functions as F

from arbora.operators import trees

_TOKS = "sent_no int, toks array<struct<id int, form string, upos string, head int, deprel string, line_number int>>"


def _df(spark, sents):
    rows = [(k, None if s is None else [(i, f, "X", h, d, 10 + i) for i, (f, h, d) in enumerate(s, 1)]) for k, s in enumerate(sents)]
    return spark.createDataFrame(rows, _TOKS)


def _small(n):
    return [[("a", h, "root" if h == 0 else "dep") for h in heads] for heads in product(range(n + 1), repeat=n)]


def _ends(heads, i):
    seen = set()
    while i and i not in seen:
        seen.add(i)
        i = heads[i - 1]
    return i == 0


def test_all_small_trees(spark):
    sents = [s for n in (1, 2, 3, 4) for s in _small(n)]
    df = trees.with_tree(_df(spark, sents))
    errors = {r.sent_no: r.e for r in df.select("sent_no", trees.diagnosis().alias("e")).collect()}
    valid, flat = set(), set()
    for k, s in enumerate(sents):
        heads = [h for _, h, _ in s]
        codes = (["cycle"] if not all(_ends(heads, i + 1) for i in range(len(s))) else []) + (["root_count"] if heads.count(0) != 1 else [])
        assert errors[k] == ",".join(codes)
        if not codes:
            valid.add(k)
            arcs = [(min(i, h), max(i, h)) for i, h in enumerate(heads, 1)]
            if not any(a < c < b < d for a, b in arcs for c, d in arcs):
                flat.add(k)
    good = df.filter(trees.diagnosis() == "")
    pairs = trees.ancestors(trees.tokens(good, "sent_no"), "sent_no")
    judged = trees.projective(pairs, "sent_no").collect()
    assert {r.sent_no for r in judged} == valid and {r.sent_no for r in judged if r.by_spans} == flat and {r.sent_no for r in judged if r.by_descent} == flat
    acts = trees.oracle_actions(trees.spans(pairs, "sent_no"), "sent_no").groupBy("sent_no").agg(F.sort_array(F.collect_list(F.struct("step", "kind", "label"))).alias("a"))
    lists = acts.select("sent_no", F.transform("a", lambda x: x["kind"]).alias("kinds"), F.transform("a", lambda x: x["label"]).alias("labels"))
    built = good.join(lists, "sent_no").select("sent_no", "heads", trees.replay("n", "kinds", "labels").alias("b")).collect()
    assert {r.sent_no for r in built} == flat and all(r.heads == r.b.heads and r.b.reason is None for r in built)
    assert all(r.b.labels == ["root" if h == 0 else "dep" for h in r.heads] for r in built)


def test_broken_and_empty(spark):
    sents = [None, [], [("a", None, "root")], [("a", 5, "dep")], [("a", 0, "dep")], [("a", 0, "root"), ("b", 1, None)]]
    df = trees.with_tree(_df(spark, sents))
    got = {r.sent_no: (r.e, r.d and r.d.reason) for r in df.select("sent_no", trees.diagnosis().alias("e"), trees.first_defect().alias("d")).collect()}
    assert got == {
        0: ("root_count", "root_count"), 1: ("root_count", "root_count"), 2: ("invalid_head,root_count,root_label", "head_range"),
        3: ("invalid_head,root_count", "head_range"), 4: ("root_label", "root_label"), 5: ("", None),
    }
    assert trees.with_tree(_df(spark, [])).count() == 0


def test_refused_actions(spark):
    S, L, R = "SHIFT", "LEFT_ARC", "RIGHT_ARC"
    cases = [
        ([S, L], [None, "dep"], 1, 2, "root_dependent"), ([R], ["dep"], 1, 1, "short_stack"), ([S, S], [None, None], 1, 2, "empty_buffer"), ([], [], 1, None, "unfinished"),
        ([S, R], [None, "root"], 1, None, None), ([S, R], [None, "dep"], 1, 2, "root_label"), ([S, R], [None, "root"], 2, 2, "root_early"), ([S, S, L], [None, None, "root"], 2, 3, "root_label"),
        ([S, S, L], [None, None, "nsubj:pass"], 2, 3, "label"), ([S], ["dep"], 1, 1, "label"), (["REDUCE"], [None], 1, 1, "kind"), ([S, S, R, R], [None, None, "obj", "root"], 2, None, None), (None, None, 2, None, "unfinished"),
    ]
    df = spark.createDataFrame([(k, n, a, b) for k, (a, b, n, *_) in enumerate(cases)], "k int, n int, a array<string>, b array<string>")
    got = {r.k: (r.x.step, r.x.reason) for r in df.select("k", trees.replay("n", "a", "b").alias("x")).collect()}
    assert got == {k: (step, reason) for k, (*_, step, reason) in enumerate(cases)}


def test_legal_states_against_the_rules():
    """Every reachable state of three words: what is legal is what a search over all actions finds possible, and each path ends as a tree."""
    done, paths = set(), [()]
    while paths:
        path = paths.pop()
        heads, _, step, reason = trees.run_actions(3, [k for k, _ in path], [x for _, x in path])
        if step is None and reason is None:
            done.add(tuple(heads))
        if step is None and reason:
            paths += [(*path, (k, x)) for k, x in (("SHIFT", None), ("LEFT_ARC", "dep"), ("RIGHT_ARC", "dep"), ("RIGHT_ARC", "root"), ("LEFT_ARC", "root"))]
    flat = {h for h in product(range(4), repeat=3) if h.count(0) == 1 and all(_ends(h, i) for i in (1, 2, 3)) and not any(a < c < b < d for a, b in _arcs(h) for c, d in _arcs(h))}
    assert done == flat


def _arcs(heads):
    return [(min(i, h), max(i, h)) for i, h in enumerate(heads, 1)]


def _project(spark, sent):
    glued = trees.glue(trees.tokens(_df(spark, [sent]), "sent_no"), "sent_no")
    rows = trees.project(glued, "sent_no").orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, len(rows) + 1))
    return [r.target for r in glued.orderBy("id").collect()], [(r.form, r.head, r.deprel) for r in rows]


def test_projection(spark):
    # quotes open and close in turn, a bracket opens, a full stop closes
    sent = [('"', 2, "punct"), ("hoa hồng", 0, "root"), ('"', 2, "punct"), ("(", 5, "punct"), ("đẹp", 2, "amod"), (")", 5, "punct"), (".", 2, "punct")]
    targets, rows = _project(spark, sent)
    assert targets == [2, None, 2, 5, None, 5, 5]
    assert rows == [('"hoa', 0, "root"), ('hồng"', 1, "dep"), ("(đẹp).", 1, "amod")]


def test_heads_that_were_glued_away(spark):
    # b hangs on a comma, which hangs on the root; the last bracket opens and has nothing after it, so it stays
    sent = [("a", 0, "root"), (",", 1, "punct"), ("b", 2, "nmod:poss"), ("(", 3, "punct")]
    targets, rows = _project(spark, sent)
    assert targets == [None, 1, None, None]
    assert rows == [("a,", 0, "root"), ("b", 1, "nmod"), ("(", 2, "punct")]


def test_root_punctuation_stays(spark):
    assert _project(spark, [(".", 0, "root"), ("a b", 1, "dep")])[1] == [(".", 0, "root"), ("a", 1, "dep"), ("b", 2, "dep")]
    assert _project(spark, [("…", 0, "root"), ('"', 1, "punct"), ('"', 1, "punct"), ("x", 1, "dep")])[0] == [None, 4, 1, None]


def test_long_sentence(spark):
    """A sentence of 30,000 words, half of them punctuation, goes through all steps."""
    n = 30_000
    rows = [(1, i, "a b" if i % 2 else ",", "X", 0 if i == 1 else (i - 2 if i % 2 and i % 100 > 1 else 1), "root" if i == 1 else "dep" if i % 2 else "punct", i) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "sent_no int, id int, form string, upos string, head int, deprel string, line_number int")
    syllables = trees.project(trees.glue(df, "sent_no"), "sent_no").cache()
    assert syllables.count() == n
    actions = trees.oracle_actions(trees.spans(trees.ancestors(syllables, "sent_no"), "sent_no"), "sent_no").groupBy("sent_no").agg(F.sort_array(F.collect_list(F.struct("step", "kind", "label"))).alias("a"))
    ran = actions.select(trees.replay(F.lit(n), F.transform("a", lambda x: x["kind"]), F.transform("a", lambda x: x["label"])).alias("x")).first().x
    assert ran.reason is None and ran.heads == [r.head for r in syllables.orderBy("id").collect()]
