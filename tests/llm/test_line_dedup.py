import hashlib
import random

import numpy as np
import pytest

from shotstream.llm import line_dedup as L
from shotstream.llm.cuckoo import CuckooFilter


def test_cuckoo_against_a_multiset():
    draw = np.random.default_rng(3)
    keys = draw.integers(-(2**63), 2**63 - 1, (2, 3000))
    strangers = draw.integers(-(2**63), 2**63 - 1, (2, 20000))
    for buckets in (4, 1024):  # far too small: further levels; and nearly full
        cuckoo = CuckooFilter(buckets)
        cuckoo.insert(*keys[:, :2000])
        cuckoo = CuckooFilter(buckets, cuckoo.to_bytes())
        cuckoo.insert(*keys[:, 2000:])
        cuckoo.insert(*np.repeat(keys[:, :1], 40, axis=1))
        assert cuckoo.contains(*keys).all()
        assert buckets == 4 or cuckoo.contains(*strangers).mean() < 1e-3
        cuckoo.remove(*keys[:, 1000:])
        cuckoo.remove(*np.repeat(keys[:, :1], 40, axis=1))
        assert cuckoo.contains(*keys[:, :1000]).all()
        cuckoo.remove(*keys[:, :1000])
        assert sum((level > 0).sum() for level in cuckoo.levels) == 0
        cuckoo.insert(*keys[:, :0])
        assert not cuckoo.contains(*keys).any()
    with pytest.raises(ValueError):
        CuckooFilter(3)


def key_of(line):
    key = line.strip(" \t\n\x0b\x0c\r")
    key = "".join(c.lower() if "A" <= c <= "Z" else c for c in key)
    return key if len(key) >= 10 else None


def by_hand(held, rows):
    """held: (id, text) in the store; rows: (id, text) to clean."""
    no_id = 2**63 - 1
    ids = {}
    for doc, text in held:
        for line in (text or "").split("\n"):
            ids.setdefault(key_of(line), set()).add(no_id if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        me = no_id if doc is None else doc
        kept = [x for x in lines if key_of(x) is None or len(ids.get(key_of(x), ())) < 2 or min(ids[key_of(x)]) == me]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def cleaned(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


POOL = [
    "a shared line of text", "  A SHARED line of text\t", "ÄÖÜ are not folded", "äöü are not folded", "nine char",
    "ten chars.", "éééééééééé", "ééééééééé", "", "   ", "\r", "unique-ish line 1", "another line that comes twice",
]


def random_rows(seed, n, first=0):
    draw = random.Random(seed)
    return [(first + i, "\n".join(draw.choices(POOL, k=draw.randint(0, 5)) + [f"own line number {draw.randint(0, 2 * n)}"])) for i in range(n)]


EDGES = [(None, "a shared line of text\nx"), (None, None), (50, None), (51, ""), (52, "\n\n"), (7, "a shared line of text"), (53, "x" * 300_000 + "\na shared line of text")]


@pytest.mark.parametrize("rounds", [1, 3])
def test_documents_against_plain_sets(spark, make, clashing, rounds):
    rows = random_rows(1, 40) + EDGES
    docs = clashing(make([t for _, t in rows], [i for i, _ in rows]))
    assert cleaned(L.dedup_lines(docs, rounds=rounds)) == by_hand(rows, rows)
    assert L.dedup_lines(docs.limit(0)).collect() == []


def test_deletion_undoes_insertion(spark, make, tmp_path):
    store = L.LineStore(spark, str(tmp_path / "store"))
    first, second, more = random_rows(1, 25), random_rows(2, 25, 10), random_rows(3, 10, 100) + [(None, POOL[0])]
    frame = lambda rows: make([t for _, t in rows], [i for i, _ in rows])
    assert cleaned(store.clean(frame(first))) == by_hand([], first)
    store.insert(frame(first))
    store.insert(frame(more))
    before = sorted(map(tuple, store.counts().collect()))
    held = dict(first) | dict(more)
    assert cleaned(store.clean(frame(second))) == by_hand(held.items(), second)
    store.insert(frame(second))  # ids 10 to 24 are replaced
    held |= dict(second)
    again = L.LineStore(spark, str(tmp_path / "store"))
    assert cleaned(again.clean(frame(second))) == by_hand(held.items(), second)
    again.delete(frame([(i, "") for i in [None, 3, 0, 999, *range(10, 35)]]))
    for gone in [None, 3, 0, *range(10, 35)]:
        held.pop(gone, None)
    assert cleaned(again.clean(frame(first + second))) == by_hand(held.items(), first + second)
    again.delete(frame(first + second + more))
    assert again.counts().count() == 0 and again.lines().count() == 0
    assert all(not any(r["slots"]) for r in again.filters().collect())
    again.insert(frame(first))
    again.insert(frame(more))
    assert sorted(map(tuple, again.counts().collect())) == before


def test_filters_follow_growth(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 16)
    store = L.LineStore(spark, str(tmp_path / "store"))
    rows = random_rows(5, 20)
    store.insert(make([t for _, t in rows], [i for i, _ in rows]))
    shards = store.shards
    more = random_rows(6, 400, 20)
    store.insert(make([t for _, t in more], [i for i, _ in more]))
    assert store.shards > shards
    docs = make([t for _, t in rows + more], [i for i, _ in rows + more])
    assert cleaned(store.clean(docs)) == by_hand(rows + more, rows + more)


def test_hot_keys_are_looked_up_alike(make, monkeypatch):
    monkeypatch.setattr(L, "HOT", 3)
    rows = [(i, f"a line in every document\nown line number {i // 2}") for i in range(30)]
    assert cleaned(L.dedup_lines(make([t for _, t in rows], [i for i, _ in rows]))) == by_hand(rows, rows)


def test_a_step_that_fails_leaves_the_store(spark, make, tmp_path, monkeypatch):
    store = L.LineStore(spark, str(tmp_path / "store"))
    rows = random_rows(1, 10)
    docs = make([t for _, t in rows], [i for i, _ in rows])
    store.insert(docs)
    want = cleaned(store.clean(docs))
    with monkeypatch.context() as m:
        m.setattr(L.LineStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            L.LineStore(spark, str(tmp_path / "store")).insert(make([POOL[0]], [-1]))
    store = L.LineStore(spark, str(tmp_path / "store"))
    assert cleaned(store.clean(docs)) == want
    store.insert(make([POOL[0]], [-1]))
    assert cleaned(store.clean(docs)) == by_hand(rows + [(-1, POOL[0])], rows)


def test_digest_of_the_query(spark):
    from shotstream.llm.queries import op11_line_dedup

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = {(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in by_hand(docs.items(), docs.items())}
    assert {tuple(r) for r in op11_line_dedup(spark, "/root/testdata/sf0.001").collect()} == want
