import numpy as np
import pytest

from shotstream.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank string, a string, c string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def by_hand(rows, every, k=5, m=3):
    """Plain Python integers over all pairs."""
    best = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        row = (label, [int(np.floor(256 * float(np.float32(x)))) for x in vector])
        best[i] = min(best.get(i, row), row)
    out = set()
    for anchor, (label, vector) in best.items():
        if anchor % every:
            continue
        scores = {i: sum(a * b for a, b in zip(vector, v)) for i, (_, v) in best.items() if i != anchor}
        rank = lambda ids: sorted(ids, key=lambda i: (-scores[i], i))
        for p in rank([i for i in scores if best[i][0] == label])[:k]:
            fits = [i for i in scores if best[i][0] != label and 50 * scores[p] <= 100 * scores[i] <= 95 * scores[p]]
            out |= {(anchor, p, r, n, scores[p], scores[n]) for r, n in enumerate(rank(fits)[:m], 1)}
    return out


def mined(df, every):
    rows = H.mine(H.taking_part(df), every).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("blocks", [(2048, 65536), (20, 30)], ids=["one", "many"])
def test_against_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(H, "LEAST_ROWS", blocks[0])
    monkeypatch.setattr(H, "MOST_ROWS", blocks[1])
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(size=6)], int(draw.integers(0, 3))) for i in range(150)]
    rows += [(150 + i, rows[0][1], int(draw.integers(0, 3))) for i in range(60)]  # one vector, many ties
    rows += [(300 + i, [0.0] * 6, i % 3) for i in range(8)]
    rows += [(310 + i, [float(draw.integers(-2, 3)) for _ in range(i % 7)], i % 3) for i in range(60)]  # shorter ones
    rows += [
        (None, [1.0] * 6, 1), (400, None, 1), (401, [1.0] * 6, None), (402, [1.0, None], 1), (403, [float("nan")] * 6, 1),
        (404, [float("inf")] * 6, 1), (405, [], 1), (-4, [1.0] * 6, 0), (406, [1.0] * 6, 99),
        (0, [0.5] * 6, 1), (0, [0.5] * 6, 1), (4, [9.0] * 6, -1),
    ]
    want = by_hand(rows, 4)
    assert len(want) > 500 and mined(frame(spark, rows), 4) == want


def test_no_rows_and_no_anchors(spark):
    assert mined(frame(spark, []), 50) == set()
    assert mined(frame(spark, [(1, [1.0], 0), (2, [1.0], 0)]), 50) == set()
    assert mined(frame(spark, [(50, [1.0], 0), (2, [1.0], 0)]), 50) == set()


def test_stops_early_and_not_too_early():
    vectors = np.random.default_rng(1).integers(-99, 99, (5000, 3)).astype(float)
    lists = H.SortedLists(vectors)
    anchor = np.array([5.0, -3.0, 0.0])
    scores, met = vectors @ anchor, []
    for rows, got, threshold in lists.meet(anchor):
        assert (got == scores[rows]).all()
        met += rows.tolist()
        rest = np.setdiff1d(np.arange(5000), met)
        assert not len(rest) or scores[rest].max() <= threshold
        if threshold < np.sort(scores[met])[-3]:
            break
    assert len(met) == len(set(met)) < 2000
    assert set(np.argsort(-scores)[:3]) <= set(met)
