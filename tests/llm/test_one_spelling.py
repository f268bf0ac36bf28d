import unicodedata

from arbora.llm import one_spelling as sp

SAME = ["tôi", "Hoà", "hòa", "km²", "10³", "мир", "Книга", "日本", "λέξη", "👨‍👩‍👧", " a b\t", "", "“đẹp”…", "a-b_c", "ĐƯỜNG", "x" * 100_000]
OTHER = {
    unicodedata.normalize("NFD", "đường"): "đường", "ｂｏａｎ ｋｈóｎｇ": "boan khóng", "t​r‍ong": "trong", "để\xa0": "để ", "﻿củɑ": "của", "ѕắng": "sắng", "νui": "vui", "Κhán": "Khán",
    "mıss": "miss", "cũng\xad": "cũng", "１.２00": "1.200", "ｎｏｎ＿x": "non_x", "Ðường": "Đường",
}


def test_one_value():
    for value in SAME:
        assert sp.canonical(value) == value
    for value, want in OTHER.items():
        assert sp.canonical(value) == want, value


def test_vocabulary_decides():
    trie = sp.Trie()
    for word, n in (("tuo", 1), ("tvo", 5), ("lui", 9)):
        trie.add(word, n)
    assert sp.canonical("tυo") == "tuo" and sp.canonical("tυo", trie) == "tvo" and sp.canonical("luі", trie) == "lui"
    assert trie.find("missing") is None and sp.skeleton("tυo") == sp.skeleton("tvo") == sp.skeleton("tuo")


def test_the_automaton_reads_raw_values():
    trie = sp.Trie()
    for word, n in (("đệ", 5), ("của", 3), ("luật", 2), ("lúa", 1)):
        trie.add(word, n)
    for raw in ("đệ", "đe\u0302\u0323", "đe\u0323\u0302", "đê\u0323", "đẹ\u200b\u0302", "\ufeffđ\xadệ", "ðệ", "đе\u0302\u200d\u0323"):
        assert trie.find(raw) == "đệ", raw
    assert trie.find("ｌｕậｔ") == "luật" and trie.find("luâ\u0323t") == "luật" and trie.find("ӏúa") == "lúa" and trie.find("ӏ") is None
    # any other edit costs one
    assert trie.find("luậ") is None and trie.find("luậ", 1) == "luật" and trie.find("xủa", 1) == "của" and trie.find("xủa") is None and trie.find("lluật", 1) == "luật" and trie.find("", 2) is None


def test_planted_look_alikes(spark):
    """Values in other dress of a vocabulary in which a letter of two readings occurs: the trie decides, the table alone would err."""
    import random

    draw = random.Random(4)
    words = ["".join(draw.choice("vunalơếđ") for _ in range(draw.randint(3, 7))) for _ in range(300)]
    words = [w for w in words if any(c in "nalơếđ" for c in w)]
    dress = lambda w: "".join({"v": "υ", "u": "υ", "n": "n\u200b", "ế": "e\u0302\u0301", "a": "ａ"}.get(c, c) for c in w)
    rows = [(k, None, [(0, w, [], None)]) for k, w in enumerate(words)] + [(1000 + k, None, [(0, dress(w), [], None)]) for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "record_id long, register string, tokens array<struct<idx int, form string, syllables array<string>, upos string>>")
    got = {r.record_id: r.canonical for r in sp.respelled(df).filter("record_id >= 1000").collect()}
    by_look = {}
    for w in words:
        by_look.setdefault(sp.skeleton(w), []).append(w)
    assert all(got[1000 + k] in by_look[sp.skeleton(w)] for k, w in enumerate(words))
    single = [k for k, w in enumerate(words) if len(set(by_look[sp.skeleton(w)])) == 1]
    assert all(got[1000 + k] == words[k] for k in single) and sum(sp.canonical(dress(words[k])) != words[k] for k in single) > 50


def test_cells(spark):
    token = "struct<idx int, form string, syllables array<string>, upos string>"
    rows = [
        (1, "formal", [(0, "tôi", ["tôi"], None), (3, "Κhán\xa0x", ["Κhán", "x​"], "N"), (4, None, None, None)], "c"), (2, "fоrmal", None, "c"), (3, None, [], "c"), (1, "formal", [(3, "Κhán\xa0x", [], "N")], "c"),
    ]
    df = spark.createDataFrame(rows, f"record_id long, register string, tokens array<{token}>, value string")
    assert {tuple(r) for r in sp.found_cells(df).collect()} == {(1, 3, "form"), (1, 3, "syllables"), (2, -1, "register")}
    out = sp.respelled(df)
    assert out.count() == sp.cells(df).count() == 9
    assert {r.canonical for r in out.filter("field_name = 'register'").collect()} == {"formal"}
    assert {r.canonical for r in out.filter("idx = 3 and field_name = 'form'").collect()} == {"Khán x"}
    assert sp.found_cells(df.limit(0)).count() == 0


def test_plain_pattern_matches_plain_letters(spark):
    letters = sorted(sp.VIETNAMESE)
    assert len(letters) == 2 * (12 * 6 + 1) + 2 * 20  # twelve vowels in six tones, đ, and the other basic letters
    df = spark.createDataFrame([("".join(letters),), ("a\xa0",), ("²",), ("a\n",), ("a\u2028",), ("a\x85",)], "v string")
    assert [r[0] for r in df.selectExpr("v").select(df.v.rlike(sp.PLAIN_PATTERN)).collect()] == [True, False, False, True, False, False]
