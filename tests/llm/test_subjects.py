import random

from pyspark.sql import functions as F

from arbora.llm import subjects as sj

_WORDS = {1: "lãi suất|ngân hàng|cổ phiếu".split("|"), 2: "trận đấu|cầu thủ|bàn thắng".split("|")}
_PLAIN = "hôm nay trời đẹp và chúng tôi đi chơi với bạn bè trong thành phố cũ ngày mai họ sẽ về nhà".split()
STOCK = "Xem thêm các bài viết khác"


def _sentence(draw, area):
    words = [draw.choice(_PLAIN) for _ in range(8)]
    if area:
        for _ in range(2):
            words.insert(draw.randrange(8), draw.choice(_WORDS[area]))
    return " ".join(words) + "."


def _texts(n, seed):
    draw, rows = random.Random(seed), []
    for k in range(n):
        area = draw.choice([0, 1, 2])
        parts = [area if draw.random() < 0.6 else 0 for _ in range(9)] + [draw.choice([0, 1, 2])]  # and a passing remark
        truth = {a for a in (1, 2) if parts.count(a) / 10 >= 0.25}
        rows.append((k, " ".join(_sentence(draw, p) for p in parts) + (" " + STOCK if k % 3 == 0 else ""), f"https://x.example/{draw.choice(_PLAIN)}/{k}", truth))
    return rows


def _sources(spark):
    return spark.createDataFrame([("s", "news"), ("s", "news"), (None, None)], "source_id string, kind string")


def test_weak_labels_of_paths_and_sections(spark):
    """Two hundred read documents whose addresses and registers tell the area; the others are fitted by their weak labels."""
    rows = _texts(700, 5)
    told = lambda truth, k: f"https://x.example/{'/'.join(sorted({1: 'kinh-te', 2: 'the-thao'}[a] for a in truth)) or 'khac'}/{k}"
    df = spark.createDataFrame([(k, t, told(truth, k), "vi", "s", "sport" if truth == {2} else None) for k, t, _, truth in rows], "doc_id long, text string, url string, lang string, source string, register string")
    labels = spark.createDataFrame([(k, a) for k, _, _, truth in rows[:200] for a in truth or {None}], "doc_id long, subject_id int")
    keys = sj.section_keys(df, _sources(spark))
    rules = sj.weak_rules(keys, labels)
    given = {(r.doc_id, r.subject_id) for r in sj.weak_labels(keys, rules).collect()}
    assert given == {(k, a) for k, _, _, truth in rows for a in truth}
    assert {(r.field, r.value) for r in rules.collect()} >= {("path", "kinh"), ("path", "te"), ("register", "sport"), ("kind", "news"), ("source", "s")}
    models = sj.train(df, labels, spark.createDataFrame([(1,), (2,)], "subject_id int"), _sources(spark))
    got = {(r.doc_id, r.subject_id) for r in sj.classify(df, models, sj.stock_endings(df)).collect()}
    want = {(k, a) for k, _, _, truth in rows for a in truth}
    assert 2 * len(want & got) / (len(want) + len(got)) > 0.97


def test_held_out_accuracy(spark):
    rows = _texts(500, 1)
    df = spark.createDataFrame([(k, t, u, "c") for k, t, u, _ in rows] + [(900, None, None, "c"), (901, "", "", "c"), (902, " \n", "", "c"), (903, "từ " * 60_000, "", "c"), (None, "", "", "c")], "doc_id long, text string, url string, share string").withColumn("lang", F.lit("vi")).withColumn("source", F.lit("s")).withColumn("register", F.lit(None).cast("string"))
    draw = random.Random(2)
    labels = [(k, a if draw.random() > 0.05 else 3 - a) for k, _, _, truth in rows[:250] for a in truth or {None} if a] + [(k, None) for k, _, _, truth in rows[:250] if not truth]
    areas = spark.createDataFrame([(1, "a"), (2, "b")], "subject_id int, subject_name string")
    endings = sj.stock_endings(df)
    assert endings == {STOCK.lower()}
    models = sj.train(df, spark.createDataFrame(labels, "doc_id long, subject_id int"), areas, _sources(spark))
    got = {(r.doc_id, r.subject_id) for r in sj.classify(df, models, endings).collect()}
    want = {(k, a) for k, _, _, truth in rows[250:] for a in truth}
    held = {(k, a) for k, a in got if k is not None and 250 <= k < 500}
    assert 2 * len(want & held) / (len(want) + len(held)) > 0.95
    assert not {k for k, _ in got if k is None or k >= 500}


def test_without_labels_or_texts(spark):
    df = spark.createDataFrame([(1, "a b c.", "u")], "doc_id long, text string, url string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.col("lang")).withColumn("register", F.col("lang"))
    areas = spark.createDataFrame([(1, "a")], "subject_id int, subject_name string")
    none = spark.createDataFrame([], "doc_id long, subject_id int")
    models = sj.train(df, none, areas, _sources(spark))
    assert sj.classify(df, models, set()).count() == 0
    assert sj.classify(df.limit(0), models, set()).count() == 0 and sj.stock_endings(df.limit(0)) == set()


def test_sentences():
    s = sj.featurize(["Một hai. Ba 1.200 bốn!\nNăm :)) ...", "", "7 ✨", "sáu"])
    assert s.document.tolist() == [0, 0, 0, 3]
