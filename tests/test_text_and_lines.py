from pyspark.sql import functions as F

from arbora.functions import text as tx
from arbora.functions.vocabulary import LABEL_BASE, SUBTYPES
from arbora.sources import conllu


def test_words_as_python_splits(spark):
    texts = ["a b c", "\x1ca\x1fb ", "", None, " \t", "a\x0bb\x85c", "a​b", "x" * 100_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert {r.k: r.w for r in df.select("k", tx.words(F.col("t")).alias("w")).collect()} == {k: (t or "").split() for k, t in enumerate(texts)}


def test_scalars(spark):
    row = spark.createDataFrame([("nsubj:pass", "dep:x", "([", '"', "", "é")], "a string, b string, c string, d string, e string, f string").select(
        tx.label_base(F.col("a")), tx.label_base(F.col("b")), tx.is_opening(F.col("c")), tx.is_opening(F.col("d")), tx.is_opening(F.col("e")), tx.token_estimate(F.col("e")), tx.is_nfc(F.col("f")), tx.nfc(F.col("f")),
        tx.mention_id(F.lit("s:0"), F.lit(1), F.lit(3)),
    ).first()
    assert list(row) == ["nsubj", None, True, False, False, 1, False, "é", "s:0:1:3"]
    assert len(LABEL_BASE) == 37 + sum(map(len, SUBTYPES.values()))


def test_digest_keeps_parts_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc")], "a string, b string").select(tx.joined_digest(F.col("a"), F.col("b")))
    assert df.distinct().count() == 3


def test_lines_round_trip(spark, tmp_path):
    rows = [(1, [(1, "a b", "X", 0, "root"), (2, ".", None, 1, "punct")]), (2, [(1, "c", "X", 0, "root")]), (3, [])]
    trees = spark.createDataFrame(rows, "sent_no int, toks array<struct<id int, form string, upos string, head int, deprel string>>")
    conllu.write_conllu(trees, "sent_no", str(tmp_path / "out"))
    numbered = conllu.sentence_lines(conllu.read_lines(spark, str(tmp_path / "out")))
    got = numbered.groupBy("file_name", "sentence").agg(F.sort_array(F.collect_list(F.struct("line_number", "line_text"))).alias("l")).collect()
    assert sorted([r.line_text.split("\t")[1] for r in g.l[1:]] for g in got) == [["a b", "."], ["c"]]
    assert sorted(g.l[0].line_text for g in got) == ["# sent_no = 1", "# sent_no = 2"]
    assert conllu.strict_rows(numbered).filter("reason is not null").count() == 0


def test_line_ends_and_metadata(spark, tmp_path):
    (tmp_path / "a.conllu").write_bytes("# sent_id = 1\r\n# sent_id = 2 = 3\n# note\n1\ta \n\n# lost = 1\n\n".encode())
    lines = conllu.read_lines(spark, str(tmp_path / "a.conllu"))
    assert [r.line_text for r in lines.orderBy("line_number").collect()] == "# sent_id = 1\r\n# sent_id = 2 = 3\n# note\n1\ta \n\n# lost = 1\n\n".splitlines()
    found = conllu.metadata(conllu.sentence_lines(lines)).collect()
    assert [(r.key, r.value) for r in found] == [("sent_id", "2 = 3")]


def test_many_splits_of_a_file(spark, tmp_path):
    """A file read in many splits is numbered as one, whatever ends its lines."""
    text = "".join(f"{k}\tx{'y' * (k % 50)}" + ["\n", "\r\n", "\x0b", "\u2028", "\n\n"][k % 5] for k in range(4000)) + "end\n"
    (tmp_path / "a.conllu").write_bytes(text.encode())
    (tmp_path / "b.conllu").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = conllu.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line_text for r in sorted(rows, key=lambda r: r.line_number)] == text.splitlines()
    assert sorted(r.line_number for r in rows) == list(range(1, len(rows) + 1))


def test_word_list(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# note\n\nbàn ghế\n  \n nhà \n", encoding="utf-8")
    assert [r.word for r in conllu.read_words(spark, str(tmp_path / "w.txt")).collect()] == ["bàn ghế", "nhà"]


def test_layout(spark):
    lines = [("a", 1, "# k = 1"), ("a", 2, "# k = 2"), ("a", 3, "1\tx"), ("a", 4, "# late"), ("a", 5, ""), ("b", 1, "# k = 1"), ("b", 2, "1\tx"), (None, 1, "x")]
    got = conllu.layout(spark.createDataFrame(lines, "file_name string, line_number int, line_text string")).collect()
    assert {(r.file_name, r.sentences, r.late_comments, r.repeated_keys, r.ends_blank) for r in got} == {("a", 1, 1, 1, True), ("b", 1, 0, 0, False)}


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    import types

    import pytest

    from arbora.storage import shared_dir

    conf = types.SimpleNamespace(get=lambda *_: None)
    cluster = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="yarn", getConf=lambda: conf))
    with pytest.raises(ValueError):
        shared_dir(cluster)
