import random

import pytest
from pyspark.sql import functions as F

from arbora.operators import hierarchy
from arbora.operators.hierarchy import ancestor_pairs, resolve


def _resolve(spark, rows):
    df = spark.createDataFrame(rows, "tree string, node int, parent int, up string, depth string")  # names that clash with the operator's own
    h = resolve(df, "tree", "node", F.col("parent"), F.struct(F.col("node").alias("node")))
    reached = {(r.tree, r.node): (r.depth, r.root, [p.node for p in r.path]) for r in h.reached.collect()}
    return reached, {(r.tree, r.node): r.place for r in h.endless.collect()}, h


def _brute(rows):
    parent = {(t, n): p for t, n, p, *_ in rows if t is not None and n is not None}
    reached, endless = {}, {}
    for t, n in parent:
        way, at = [], n
        while at not in way and (t, at) in parent:
            way.append(at)
            at = parent[t, at]
        if (t, at) in parent:
            endless[t, n] = "on" if at == n else "below"
        else:
            reached[t, n] = (len(way) - 1, way[-1], way)
    return reached, endless


@pytest.mark.parametrize("block", [65_536, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hierarchy, "BLOCK_NODES", block)
    if block < 100:
        monkeypatch.setattr(hierarchy, "BATCH_PATH", 50)
    draw = random.Random(3)
    rows = []
    for t in range(25):
        size = draw.choice([1, 2, 3, 8, 30])
        for n in range(size):
            parent = draw.choice([None, n, draw.randrange(size), max(0, n - 1) if n else None, size + 5])
            rows.append((f"t{t}", n, parent, "x", "y"))
    rows += rows[:20]  # repeated rows
    rows += [(None, 1, 2, "x", "y"), ("t0", None, 2, "x", "y")]  # nothing to place
    rows += [("deep", n, n - 1 if n else None, "x", "y") for n in range(120)]
    rows += [("neg", -1, -2, "x", "y"), ("neg", -2, None, "x", "y"), ("neg", -70_000, -1, "x", "y"), ("neg", 70_000, -70_000, "x", "y"), ("neg", -9, -8, "x", "y")]
    rows += [("ring", n, (n + 1) % 50, "x", "y") for n in range(50)] + [("ring", 100 + n, 99 + n if n else 7, "x", "y") for n in range(40)]
    reached, endless, h = _resolve(spark, rows)
    assert (reached, endless) == _brute(rows)
    pairs = {(r.tree, r.ancestor, r.node, r.distance) for r in ancestor_pairs(h.reached).collect()}
    assert pairs == {(t, a, n, k) for (t, n), (_, _, way) in reached.items() for k, a in enumerate(way) if k}


def test_empty_and_all_null(spark):
    assert _resolve(spark, [])[:2] == ({}, {})
    assert _resolve(spark, [(None, None, None, None, None)])[:2] == ({}, {})
