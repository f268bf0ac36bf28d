from arbora.llm import same_records as sr

_SCHEMA = "record_id long, sent_id string, key string, tokens array<struct<idx int, form string, syllables array<string>, upos string>>"


def _groups(spark, rows):
    df = spark.createDataFrame([(i, s, "clash", None if t is None else [(k, f, [], None) for k, f in t]) for i, s, t in rows], _SCHEMA)
    keys = sr.record_keys(df)
    return {(r.first_record_id, r.record_id) for r in sr.members(keys, sr.same_groups(keys)).collect()}


def test_what_is_the_same(spark):
    rows = [
        (1, "A:0", [(0, "Hoa"), (1, "đẹp"), (2, ".")]), (2, "a 0", [(2, "ĐẸP"), (0, "h oa"), (9, " ")]), (3, "A:0", [(0, "đẹp"), (1, "hoa")]), (4, "A:0", [(0, "hoa"), (1, "dep")]),
        (5, "A:1", [(0, "hoa"), (1, "đẹp")]), (6, None, [(0, "x")]), (7, None, [(0, "X"), (1, None)]), (8, "", [(0, "x")]), (9, "A:0", None), (10, "a:0", []), (11, "a:0", [(0, "hoađẹp")]),
        (12, "A:0", [(0, "hoa "), (1, "“đẹp”")]), (12, "A:0", [(0, "hoa "), (1, "“đẹp”")]), (13, "A:0", [(0, "hoa​"), (1, "đẹp")]), (None, "A:0", []),
    ]
    assert _groups(spark, rows) == {(1, 2), (1, 12), (6, 7), (9, 10)}


def test_hot_group_and_empty(spark):
    rows = [(k, "A" if k % 3 else f"B{k}", [(0, "w,"[: 1 + k % 2])]) for k in range(900)]
    assert _groups(spark, rows) == {(1, k) for k in range(2, 900) if k % 3}
    assert _groups(spark, []) == set()
    assert _groups(spark, [(1, "long", [(0, "x" * 300_000)]), (2, "long", [(0, "X" * 300_000)])]) == {(1, 2)}
