import random

import pytest

from arbora.llm import catalog, term_counts
from tests.side_by_side import same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.SQL[name])


def _counts(spark, rows):
    df = spark.createDataFrame(rows, "sent_id string, idx int, upos string, form string, term string, occurrences string")
    counts, n_records = term_counts.count_terms(df, ["upos", "form"], "sent_id", "idx")
    assert n_records == len({r[0] for r in rows if r[0] is not None})
    return {(r.field_name, r.term): (r.occurrences, r.records) for r in counts.collect()}


def _brute(rows):
    found = {}
    for r, p, *values in {row[:4] for row in rows}:
        for field, v in zip(("upos", "form"), values):
            if v is not None:
                n, records = found.setdefault((field, v), [0, set()])
                found[field, v][0] = n + 1
                records |= {r} - {None}
    return {k: (n, len(records)) for k, (n, records) in found.items()}


def test_long_records(spark, monkeypatch):
    """A record with a third of all rows, rows without record or position, repeats, a frequent term of great length."""
    monkeypatch.setattr(term_counts, "RECORD_ROWS", 64)
    draw = random.Random(8)
    rows = [(f"s{draw.randrange(40)}", draw.randrange(60), draw.choice("ABC"), f"w{draw.randrange(9)}", "c", "d") for _ in range(1500)]
    rows += [("giant", k, draw.choice("AB"), draw.choice(["hot", f"g{k}", "x" * 5000]), "c", "d") for k in range(700)]
    rows += [(None, k % 7, "A", f"n{k % 3}", "c", "d") for k in range(60)] + [("s1", None, "B", "w1", "c", "d"), ("s2", -1, "B", "w2", "c", "d")]
    rows += draw.sample(rows, 300)
    assert _counts(spark, rows) == _brute(rows)


def test_heavy_and_light_terms(spark):
    rows = [(f"s{k % 700}", k // 700, "N", "hot" if k % 3 else f"w{k}", "c", "d") for k in range(2100)]
    rows += rows[:50]  # repeated rows count once
    rows += [("s0", 99, None, "", "c", "d"), (None, 1, "N", "alone", "c", "d"), ("s1", None, "N", None, "c", "d")]
    got = _counts(spark, rows)
    assert got["form", "hot"] == (1400, 700 - sum(all((k + 700 * j) % 3 == 0 for j in range(3)) for k in range(700)))
    assert got["upos", "N"] == (2102, 700)
    assert got["form", ""] == (1, 1) and got["form", "alone"] == (1, 0) and got["form", "w0"] == (1, 1)
    assert ("upos", None) not in got and len(got) == 700 + 4


def test_empty(spark):
    assert _counts(spark, []) == {}
    assert _counts(spark, [(None, None, None, None, None, None)]) == {}


def test_marks(spark):
    df = spark.createDataFrame([(2,), (3,), (5500,), (5501,), (10_000,)], "records long")
    assert [r.mark for r in term_counts.mark_terms(df, 10_000).collect()] == ["rare", None, None, "common", "common"]
    assert [r.mark for r in term_counts.mark_terms(df, 30_000).collect()][:2] == ["rare", "rare"]
