import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from arbora.llm import subjects as sj

_PLAIN_END = r"(?:[.!?…]+(?=\s|$)|:\)+|\n)+"
_FORMS = [w + v for w in "ba ca da ga la ma na ra ta va".split() for v in ["", "nh", "ng"]]


def _sample(areas, n=240):
    draw, texts, labelled = random.Random(7), [], [np.zeros(n, bool) for _ in areas]
    for k in range(n):
        area = draw.choice([None, *areas])
        if area is not None:
            labelled[areas.index(area)][k] = True
        texts.append(" ".join(" ".join(draw.choice(_FORMS) for _ in range(6)) + (f" chủ đề{'xyzuvw'[area]}" if area is not None and draw.random() < 0.6 else "") + "." for _ in range(6)))
    return texts, labelled


def test_features_are_found_once_for_the_areas_of_a_task(monkeypatch):
    texts, labelled = _sample([0, 1, 2, 3])
    fold, read = np.arange(len(texts)) % 2, np.ones(len(texts), bool)
    alone = [sj.train_areas(texts, fold, [x], read)[0] for x in labelled]
    calls, featurize = [], sj.featurize
    monkeypatch.setattr(sj, "featurize", lambda texts: calls.append(1) or featurize(texts))
    together = sj.train_areas(texts, fold, [*labelled, np.zeros(len(texts), bool)], read)
    assert len(calls) == 1
    for (w, b, t), (w1, b1, t1) in zip(alone, together):
        assert w.any() and np.array_equal(w, w1) and (b, t) == (b1, t1)
    assert not together[-1][0].any() and together[-1][1:] == (-9.0, 0.0)
    assert [m[1] for m in sj.train_areas(["", " \n"], fold[:2], [np.ones(2, bool)], read[:2])] == [-9.0]


def test_every_area_has_a_model_of_its_own_whatever_task_fits_it(spark):
    """Six areas are two tasks; the sample is exchanged once for a task, not once for an area."""
    texts, labelled = _sample([0, 1, 2, 3, 4, 5])
    df = spark.createDataFrame([(k, t, "u") for k, t in enumerate(texts)], "doc_id long, text string, url string")
    df = df.withColumn("lang", F.lit("vi")).withColumn("source", F.lit("s")).withColumn("register", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(k, next((a for a in range(6) if labelled[a][k]), None)) for k in range(len(texts))], "doc_id long, subject_id int")
    sources = spark.createDataFrame([("s", "news")], "source_id string, kind string")
    models = sj.train(df, labels, spark.createDataFrame([(a,) for a in range(6)], "subject_id int"), sources)
    assert models.rdd.getNumPartitions() == 2
    got = {r.subject_id: np.array(r.weights) for r in models.collect()}
    want = sj.train_areas(texts, np.array([zlib.crc32(str(k).encode()) & 1 for k in range(len(texts))]), labelled, np.ones(len(texts), bool))
    assert got.keys() == set(range(6)) and all(np.array_equal(got[a], want[a][0].astype(np.float32)) for a in range(6))
    none = sj.train(df, labels, spark.createDataFrame([], "subject_id int"), sources)
    assert none.count() == 0 and sj.classify(df, none, set()).count() == 0


def test_scores_are_sums_over_the_features():
    s = sj.featurize(["Một hai ba. Bốn!\nNăm :)) ...", "", "7 ✨", "sáu bảy sáu bảy"])
    table, bias = np.random.default_rng(1).normal(size=(3, sj.SLOTS)), np.array([0.5, -1, 0])
    size = np.bincount(s.sentence)
    want = [[sum(w[f] for f, at in zip(s.feature, s.sentence) if at == k) / size[k] ** 0.5 + b for w, b in zip(table, bias)] for k in range(len(s))]
    assert np.allclose(sj.score(s, table, bias), want)


def test_ends_are_those_of_the_plain_expression(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(".!?…:))\n \tab1") for _ in range(draw.randrange(12))) for _ in range(4000)]
    assert [re.sub(sj.END, "|", t) for t in texts] == [re.sub(_PLAIN_END, "|", t) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~F.split("t", sj.END).eqNullSafe(F.split("t", _PLAIN_END))).count() == 0


def test_texts_without_a_sentence_have_no_share_in_stock_phrases(spark):
    rows = [(f"Câu {k}. Hết rồi",) for k in range(3)] + [(" ",), ("...",), (None,)] + [(f"{'!' * k}",) for k in range(1, 9)]
    assert sj.stock_endings(spark.createDataFrame(rows, "text string")) == {"hết rồi"}
