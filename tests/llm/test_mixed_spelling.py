from arbora.llm import one_spelling as sp

#: Each line holds values that look the same; the first is the one spelling.
ALIKE = [
    ("naïve", "naïve", "nаïve"), ("мир", "ми​р", "м‌ир"), ("日本", "日​本", "﻿日本"), ("12€", "１２€"),
    ("a 😀", "a\xa0😀", "a　😀"), ("tôi 😀", "tôi 😀", "tôi​ 😀"), ("của 日本", "củɑ 日本"),
]
#: Joiners and selectors that are seen, and words wholly in another script beside Latin ones.
ORDINARY = ["👨‍👩‍👧 x", "❤️‍🔥", "#️⃣ €", "می‌خواهم", "क्‍ष", "Москва(Moscow)", "Bоб", "αβγ π"]


def test_values_beyond_plain_spelling():
    for one, *others in ALIKE:
        for value in (one, *others):
            assert sp.canonical(value) == one, (value, one)
    for value in ORDINARY:
        assert sp.canonical(value) == value, value


def test_cells_beyond_plain_spelling_are_respelled_and_not_found(spark):
    token = "struct<idx int, form string, syllables array<string>>"
    rows = [(k, None, [(0, value, [])]) for k, value in enumerate(["naïve", "naïve", "１２€", "ｘ", "x"])]
    df = spark.createDataFrame(rows, f"record_id long, register string, tokens array<{token}>")
    assert {r.record_id: r.canonical for r in sp.respelled(df).collect()} == {0: "naïve", 1: "naïve", 2: "12€", 3: "x", 4: "x"}
    assert {tuple(r) for r in sp.found_cells(df).collect()} == {(3, 0, "form")}
