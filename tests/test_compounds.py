import re

from arbora.plans import repair

FORMS = ["đơn giản", "Đơn giản", "hợp tác xã", "TP. Hồ Chí Minh", "nhà", "an  toàn", "chưa có"]
TEXTS = ["Rất (đơn giản), thật.", "ĐƠN GIẢN. Hợp tác xã!", "hợp tác, xã; đơn, giản", "ở TP. Hồ Chí Minh, an\ntoàn", "lan toàn an toànx", "an-an toàn…", None, ""]


def test_compounds_of_any_length_and_beside_punctuation(spark, tmp_path):
    spark.createDataFrame([([(f,) for f in FORMS],), (None,)], "toks array<struct<form string>>").write.parquet(f"{tmp_path}/conllu_sentences.parquet")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.compound: r.documents for r in repair.compound_occurrences(spark, str(tmp_path)).collect()}
    compounds = {" ".join(f.lower().split()) for f in FORMS if len(f.split()) > 1}
    texts = [" ".join((t or "").lower().split()) for t in TEXTS]
    assert got == {c: sum(bool(re.search(rf"(?<!\w){re.escape(c)}(?!\w)", t)) for t in texts) for c in compounds}
    assert got == {"đơn giản": 2, "hợp tác xã": 1, "tp. hồ chí minh": 1, "an toàn": 2, "chưa có": 0}
