import random

import pytest

from arbora.llm import split_overlap as so


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _df(spark, rows):
    return spark.createDataFrame(
        [(n, split, None if forms is None else [(i, f) for i, f in enumerate(forms, 1)], "clash") for n, split, forms in rows], "sent_no long, split string, toks array<struct<id int, form string>>, text string"
    )


def _brute(rows):
    lists = [(n, s, [f.lower() for f in forms if f and any(c.isalnum() for c in f)]) for n, s, forms in rows if forms and s]
    lists = [x for x in lists if len(x[2]) >= 12]
    return {(a, b) for a, s, x in lists if s == "train" for b, t, y in lists if t in ("dev", "test") and _distance(x, y) * 100 <= 15 * max(len(x), len(y))}


@pytest.mark.parametrize("pieces,block,plenty", [(20_000, 400_000, 1000), (40, 2000, 0)])
def test_against_brute_force(spark, monkeypatch, pieces, block, plenty):
    monkeypatch.setattr(so, "SHARD_PIECES", pieces)
    monkeypatch.setattr(so, "BLOCK_CHARS", block)
    monkeypatch.setattr(so, "PLENTY", plenty)
    draw = random.Random(5)
    words = ["hoa", "Đẹp", "x y", "b", "Ba", "năm", "7", "cười"]
    rows = []
    for n in range(40):
        base = [draw.choice(words) for _ in range(draw.randint(10, 30))]
        rows.append((2 * n, "train", base))
        other = list(base)
        for _ in range(draw.randint(0, 6)):
            at, what = draw.randrange(len(other)), draw.choice("idr")
            other[at : at + (what != "i")] = [] if what == "d" else [draw.choice(words)]
        rows.append((2 * n + 1, draw.choice(["dev", "test"]), [*other, ".", None]))
    rows += [(100 + k, s, words[:6] * 2) for k, s in enumerate(["train", "train", "dev", "test", None, "other"])]
    rows += [(200, "train", None), (201, "dev", []), (202, "train", ["w"] * 3000), (203, "test", ["W"] * 2700)]
    want = _brute(rows)
    got = {(r.train_no, r.eval_no) for r in so.overlaps(_df(spark, rows)).pairs.collect()}
    assert got == want and len(want) > 15


def test_one_side_only(spark):
    assert so.overlaps(_df(spark, [(1, "train", ["a"] * 12)])).pairs.count() == 0
    assert so.overlaps(_df(spark, [(1, "dev", ["a"] * 12)])).pairs.count() == 0
    assert so.overlaps(_df(spark, [])).pairs.count() == 0


@pytest.mark.parametrize("forms", [1, 3])
def test_passages_leave_two_whole(forms):
    for n in range(12, 400):
        longest = max(m for m in range(n, 2 * n) if m - n <= so.most_edits(m))
        parts = so.cut_passages(n, forms)
        assert len(parts) > so.most_edits(longest) + 1 and parts[0][0] == 0 and parts[-1][1] == n and all(b > a for a, b in parts)


def test_edits():
    draw = random.Random(6)
    for _ in range(300):
        a, b = ([draw.choice("abc") for _ in range(draw.randrange(90))] for _ in range(2))
        d = _distance(a, b)
        assert so.edits(a, b, 90) == d and so.edits(a, b, d) == d and (d == 0 or so.edits(a, b, d - 1) is None)


def test_passage_that_all_share(spark):
    """Thousands of texts on both sides share a stock passage and no more: nothing meets through it, and the planted pairs are found."""
    draw = random.Random(7)
    word = lambda: f"t{draw.randrange(10**9)}"
    stock, rows = ["xem", "thêm", "tin", "khác", "tại", "đây"], []
    for k in range(6000):
        own = [word() for _ in range(8)]
        rows.append((k, "train" if k % 2 else "test", own[:4] + stock + own[4:]))
    planted = {(10_001 + 2 * k, 2 * k) for k in range(40)}
    rows += [(a, "train", [*rows[b][2][:3], "khác đi", *rows[b][2][4:]]) for a, b in planted]
    found = so.overlaps(_df(spark, rows))
    assert {(r.train_no, r.eval_no) for r in found.pairs.collect()} == planted
    cover = {r.sent_no: (r.forms, r.covered) for r in found.coverage.collect()}
    assert len(cover) == 3000 and all(n == 14 and 3 <= c <= 14 for n, c in cover.values())
