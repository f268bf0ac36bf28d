import csv

import pytest

from arbora.operators import rejects
from arbora.operators.rejects import loaded_tokens, parse_lines, split_row


def _row(**c):
    cols = {"id": "1", "form": "a", "lemma": "_", "upos": "X", "x": "_", "f": "_", "head": "0", "deprel": "root", "d": "_", "m": "_"} | c
    return "\t".join(cols.values())


CASES = [
    (_row(), None), (_row() + "\t", "columns"), ("1\ta", "columns"), (_row(form='"'), None), (_row(lemma='"'), None), (_row(m='"'), "quoting"), (_row(m='""'), None),
    (_row(id="01"), "id"), (_row(id="0"), "id"), (_row(id=" 1"), "id"), (_row(id="1-2", head="_", deprel="_"), None), (_row(id="0.1"), "id"), (_row(id="1.1", head="_"), None), (_row(id="1.0"), "id"),
    (_row(head="_"), "head"), (_row(head="-1"), "head"), (_row(head="1 "), "head"), (_row(head="99", deprel="dep"), "head_range"), (_row(head="9" * 30, deprel="dep"), "head_range"),
    (_row(head="1", deprel="Dep"), "deprel"), (_row(head="0", deprel="dep"), "root"), (_row(head="1", deprel="root"), "root"), (_row(id="9" * 25, head="9" * 25, deprel="dep"), None),
    (_row(id="x", m='"'), "quoting"), (_row(m="a\rb"), None), (_row(m="a\nb"), None), (_row(id="١"), "id"), (_row(m="x" * 200_000), None),
]


def test_reasons(spark):
    lines = []
    for k, (row, _) in enumerate(CASES):
        lines += [(f"f{k}", 1, "# c", "z"), (f"f{k}", 2, row, "z"), (f"f{k}", 2, row, "z"), (f"f{k}", 3, "  ", "z"), (f"f{k}", 4, None, "z")]
    lines += [(None, 1, _row(), "z"), ("g", None, _row(), "z")]
    df = spark.createDataFrame(lines, "file_name string, line_number int, line_text string, reason string")
    labels = spark.createDataFrame([("root", "root"), ("dep", "dep"), (None, None)], "label string, base string")
    parsed = parse_lines(df, labels)
    assert {r.file_name: r.reason for r in parsed.collect()} == {f"f{k}": reason for k, (_, reason) in enumerate(CASES)}
    assert loaded_tokens(parsed).count() == sum(reason is None and row.split("\t")[0].isdigit() for row, reason in CASES)
    assert parse_lines(df.limit(0), labels).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 4096])
def test_sentences_span_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(rejects, "BLOCK_LINES", block)
    texts = ["", _row(), _row(id="2", head="5", deprel="dep"), _row(id="3", head="1", deprel="dep"), _row(id="5", head="1", deprel="dep"), "", _row(), _row(id="2", head="5", deprel="dep")]
    df = spark.createDataFrame([("f", k, t) for k, t in enumerate(texts, 1)], "file_name string, line_number int, line_text string")
    labels = spark.createDataFrame([("root",), ("dep",)], "label string")
    assert [(r.line_number, r.reason) for r in parse_lines(df, labels).filter("reason is not null").collect()] == [(8, "head_range")]


def test_columns_stand_as_they_are():
    assert split_row("a\t b \t") == (["a", " b ", ""], "columns")
    assert split_row('"a\tb"\t')[0] == ['"a', 'b"', ""]


QUOTED = [(_row(m='a"b'), "quoting"), (_row(m='"a'), "quoting"), (_row(d='"', m='"'), "quoting"), (_row(m='a"b"c'), None), (_row(m='"a" "b"'), None), (_row(form='a"', m='""""'), None), (_row(d='x"', m='"y'), "quoting"), (_row(id='"1"'), None)]


def test_quotes_in_columns():
    for row, reason in QUOTED:
        assert split_row(row) == (row.split("\t"), reason), row


def test_the_csv_reader_decides(monkeypatch):
    """A plain split in place of the reader finds no damaged quotes."""
    monkeypatch.setattr(csv, "reader", lambda rows, **_: iter([r.split("\t") for r in rows]))
    assert [split_row(row)[1] for row, reason in QUOTED if reason] == [None] * 4
    assert split_row(_row(m='a"b"c'))[0][9] != 'a"b"c'  # and leaves the enclosing quotes


def test_sentence_without_blank_lines_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(rejects, "BLOCK_LINES", 5)
    lines = [("f", k, _row(id=str(k), head="0" if k == 1 else str(k + 1), deprel="root" if k == 1 else "dep")) for k in range(1, 60)]
    lines += [("g", k, t) for k, t in enumerate([_row(), "", "# c", "", _row(id="7", head="9", deprel="dep"), _row(id="9" * 5000, head="7", deprel="dep")], 1)] * 3
    df = spark.createDataFrame(lines, "file_name string, line_number int, line_text string")
    parsed = parse_lines(df, spark.createDataFrame([("root",), ("dep",)], "label string")).collect()
    assert len(parsed) == 59 + 3 and [(r.file_name, r.line_number, r.reason) for r in parsed if r.reason] == [("f", 59, "head_range")]
    assert {(r.line_number, r.sentence) for r in parsed if r.file_name == "g"} == {(1, 0), (5, 4), (6, 4)} and {r.sentence for r in parsed if r.file_name == "f"} == {0}
