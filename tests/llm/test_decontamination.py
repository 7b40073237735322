import random
from collections import Counter

import pytest

from shotstream.llm import decontamination as D

random.seed(5)
VOCABULARY = [f"w{i}" for i in range(500)]


def words(n):
    return [random.choice(VOCABULARY) for _ in range(n)]


def shingles(part, k):
    return Counter(tuple(part[i : i + k]) for i in range(len(part) - k + 1))


def brute(docs, items):
    found = {}
    for d, text in docs.items():
        text = (text or "").lower().split()
        for i, item in items.items():
            item = (item or "").lower().split()
            n = len(item)
            if not n:
                continue
            k = min(5, n)
            want = shingles(item, k)
            if want.keys().isdisjoint(tuple(text[j : j + k]) for j in range(len(text) - k + 1)):
                continue
            for s in range(max(1, len(text) - n + 1)):  # a shorter text is one window
                got = shingles(text[s : s + n], k)
                both = sum((want & got).values())
                j = both / (sum(want.values()) + sum(got.values()) - both)
                if j >= 0.8 and j > found.get((d, i), (0, 0))[0] + 1e-12:
                    found[d, i] = (j, s)
    return found


@pytest.fixture(scope="module")
def case(make, spark):
    items = {0: words(40), 1: words(15), 2: words(3), 3: words(60), 4: ["a"] * 12, 5: [], 6: words(1)}
    docs = {}
    for d in range(40):
        body = words(random.randint(0, 120))
        item = items[d % 7][:]
        if d % 3 == 0 and len(item) > 30:
            item[len(item) - 1 - d % 3] = "changed"
        if d % 5 == 0:
            item = item[1:]
        if d % 4 != 3:
            at = random.randint(0, len(body))
            body[at:at] = item
        docs[d] = " ".join(body)
    docs[40], docs[41], docs[42] = None, "", "A a A a a a a a a a a a a a a"
    items = {i: " ".join(w) for i, w in items.items()}
    frame = spark.createDataFrame([*items.items(), (7, None)], "item_id bigint, text string")
    return docs, items, make(list(docs.values()), list(docs)), frame


def test_equals_brute_force(case):
    docs, items, frame, benchmark = case
    want = brute(docs, items)
    assert len(want) > 15
    rows = D.contaminated(frame, benchmark).collect()
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    for key, (j, s) in want.items():
        assert abs(got[key][0] - j) < 1e-9 and got[key][1] == s, key


def test_a_large_benchmark_goes_in_blocks(case):
    _, _, frame, benchmark = case
    whole = {tuple(r) for r in D.contaminated(frame, benchmark).collect()}
    assert {tuple(r) for r in D.contaminated(frame, benchmark, sent=40).collect()} == whole


def test_clean_documents_stay(case, clashing):
    docs, items, frame, benchmark = case
    dirty = {d for d, _ in brute(docs, items)}
    kept = D.decontaminate(clashing(frame), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == set(docs) - dirty
    assert kept.columns == clashing(frame).columns


def test_empty_tables_and_repeated_rows(case, make):
    _, items, frame, benchmark = case
    assert D.contaminated(frame.limit(0), benchmark).count() == 0
    assert D.contaminated(frame, benchmark.limit(0)).count() == 0
    twice = make([items[0], items[0]], [9, 9])
    assert [(r["doc_id"], r["item_id"]) for r in D.contaminated(twice, benchmark.union(benchmark)).collect() if r["item_id"] == 0] == [(9, 0)]


def test_texts_shorter_than_an_item(make, spark):
    item = words(60)
    texts = [item[:58], item[2:], item[:52], item[:51], item[:48], item[5:55] + ["x"], item[:4], ["y", *item[:57]], item[:30] + item[32:]]
    docs = {i: " ".join(t) for i, t in enumerate(texts)} | {20: " ".join(words(20) + item[:58] + words(20))}
    items = {0: " ".join(item), 1: " ".join(item[:9]), 2: "one two three four five six"}
    docs[21], docs[22] = "one two three four five", "one two three four"
    want = brute(docs, items)
    assert {(0, 0), (1, 0), (20, 0)} <= want.keys() and (4, 0) not in want and (22, 2) not in want
    benchmark = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(make(list(docs.values()), list(docs)), benchmark).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[key]["similarity"] - j) < 1e-9 and got[key]["start_word"] == s for key, (j, s) in want.items())


def test_a_window_meets_only_items_that_suggest_it(make, spark):
    """Many items of one length: the pairs that are compared grow with the matches, not with the items."""
    items = {i: " ".join(words(30)) for i in range(300)}
    docs = {i: " ".join(words(10) + items[i * 7].split() + words(10)) for i in range(20)}
    benchmark = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    prepared = D.benchmark_items(benchmark, 0.8)
    windows = D._candidate_windows(make(list(docs.values()), list(docs)), prepared, 5, 0.8)
    assert windows.select("item").distinct().count() == 20 and windows.count() < 20 * 10
    rows = D.contaminated(make(list(docs.values()), list(docs)), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(i, i * 7) for i in range(20)}


def test_very_long_text(make, spark):
    item = words(40)
    text = " ".join(words(60_000) + item + words(60_000))
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    rows = D.contaminated(make([text, "x" * 1_000_000]), benchmark).collect()
    assert [(r["doc_id"], r["similarity"], r["start_word"]) for r in rows] == [(0, 1.0, 60_000)]


def test_radius_covers_the_threshold():
    """Two prints within the radius share a block within the listed distance."""
    for _ in range(2000):
        flips = random.sample(range(64), D.RADIUS)
        assert min(sum(b // D.BLOCK_BITS == i for b in flips) for i in range(D.BLOCKS)) <= D.RADIUS // D.BLOCKS
    assert len(D._near_masks()) == 37
