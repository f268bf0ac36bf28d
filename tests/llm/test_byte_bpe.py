import base64
import random

import numpy as np
import tiktoken
from pyspark.sql import functions as F

from arbora.llm import byte_bpe as bpe


def _public():
    with open(bpe.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", "a", " ", "  a   b ", "đường phố\n\n 123 it's", "<|endoftext|>", "x" * 5000, "\x1c\x85\xa0 \x00", "👩‍💻 日本", " \n \t x", "aaaaabbbbbababab" * 40]


def test_same_ids_as_public_library():
    public, own = _public(), bpe.Encoder(bpe.read_tables())
    draw = random.Random(2)
    texts = TEXTS + ["".join(draw.choice("aabcdeè tốnggh  \n\t.,!'s're12²\x1c😀ABt") for _ in range(draw.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(own.encode(text), np.int32).tolist() == public.encode_ordinary(text), repr(text)


def test_memo_may_be_dropped(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    public, own = _public(), bpe.Encoder(bpe.read_tables())
    text = "một hai ba bốn năm sáu bảy tám chín mười " * 3
    assert np.frombuffer(own.encode(text), np.int32).tolist() == public.encode_ordinary(text)


def test_documents_round_trip(spark):
    rows = [(k, t, "c") for k, t in enumerate(TEXTS)] + [(None, "a b", "c"), (99, None, "c"), (1, "a", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = bpe.encode_documents(df)
    assert encoded.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")] and encoded.count() == len(rows)
    assert {tuple(r.ids) for r in encoded.filter("doc_id in (0, 99)").collect()} == {()}
    back = {r.doc_id: r.text for r in bpe.decode_documents(encoded).collect()}
    assert back == {**{k: t for k, t in enumerate(TEXTS)}, None: "a b", 99: ""}
    assert bpe.decode_documents(encoded.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))).filter("text is not null").count() == 0
    assert bpe.encode_documents(df.limit(0)).count() == 0
