"""Hard negatives against a loop over all anchors and rows."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from varloom.llm import hard_negatives as module
from varloom.llm.hard_negatives import _Pair, _pack_anchors, _pack_rows, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label long"


def brute_force(rows, asked, positives=5, negatives=10):
    known = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor, label, a in known:
        if not asked(anchor):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i, other) for i, other, v in known if i != anchor and len(v) == len(a))
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score][:negatives]
            out += [(anchor, positive, rank, i, -score, -s) for rank, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, asked=lambda c: c % 10 == 0, schema=SCHEMA, **settings):
    df = hard_negatives(spark.createDataFrame(rows, schema), asked(F.col("vec_id")), **settings)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def vectors(seed, n, size, labels, wide=1.0):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(4)]
    row = lambda k: [wide * (0.6 * c + 0.5 * rng.gauss(0, 1)) for c in rng.choice(centre)]
    return [(k, row(k), rng.choice(labels)) for k in range(n)]


def test_against_brute_force(spark, monkeypatch):
    rows = vectors(1, 700, 12, [0, 0, 0, 0, 1, 2, 7])
    rows += [(1000 + k, rows[k % 7][1], rows[k % 5][2]) for k in range(60)]  # copies: ties by id
    want = brute_force(rows, lambda i: i % 10 == 0)
    assert len(want) > 1500
    assert mined(spark, rows) == want
    monkeypatch.setattr(module, "BLOCK", 900)  # many blocks of rows and of anchors
    monkeypatch.setattr(module, "ANCHORS", 100)
    assert mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=1) == brute_force(rows, lambda i: i % 10 == 0, 2, 1)


def test_zero_and_negative_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (10, [0.0, 1.0], 1), (3, [-1.0, 0.0], 1), (4, [0.0, -2.0], 2), (5, [0.5, 0.5], 2), (6, [0.0, 0.0], 3), (20, [0.25, 0.0], 9)]
    want = brute_force(rows, lambda i: i % 10 == 0)
    assert any(r[4] == 0 for r in want)
    assert mined(spark, rows) == want


def test_left_out_rows_lengths_and_extra_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(2, 60, 3, [0, 1])
    rows += [(70, None, 1), (80, [1.0, None, 1.0], 1), (90, [nan, 1.0, 1.0], 0), (100, [1.0, -inf, 0.0], 0), (110, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (120, [1.0], 0), (130, [2.0], 0), (131, [1.5], 1), (140, [], 1), (150, [], 1), (151, [], 0)]
    want = brute_force(rows, lambda i: i % 10 == 0)
    assert any(r[0] == 120 for r in want) and any(r[0] == 140 for r in want)
    assert mined(spark, rows) == want
    extra = [(*r, 1, "x", 2, None, 5) for r in rows]
    assert mined(spark, extra, schema=SCHEMA + ", key int, dim string, block int, asked boolean, place int") == want
    assert mined(spark, []) == []


def test_huge_components(spark):
    rows = vectors(3, 60, 3, [0, 1], wide=2.0**20)
    assert mined(spark, rows) == brute_force(rows, lambda i: i % 10 == 0)


def test_repeated_ids(spark):
    rows = vectors(4, 50, 4, [0, 1])
    got = mined(spark, rows + [rows[0], rows[1]])
    assert len([r for r in got if r[0] == 0]) > len([r for r in mined(spark, rows) if r[0] == 0])  # two anchors of one name, each the other's positive
    assert any(r[0] == 0 and r[1] == 0 for r in got)


def test_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(5)
    exact = rng.normal(0, 60, (3000, 32)).round().astype(int)
    group = pd.DataFrame({"dim": 32, "block": 0, "key": range(3000), "vec_id": range(3000), "label": 0, "vector": [np.array(x) for x in exact]})
    anchors = _pack_anchors(group[:4].assign(ablock=0, windows=[np.array([], dtype=object)] * 4))
    pair = _Pair(next(_pack_rows(group).join(anchors.drop(columns="dim")).itertuples(index=False)))
    for k in range(4):
        lower, upper = pair.bounds(k, 0, 3000)
        true = exact @ exact[k]
        assert (lower <= true).all() and (true <= upper).all()
        assert (upper >= np.sort(lower)[-5]).sum() < 300  # a tenth is scored at most
