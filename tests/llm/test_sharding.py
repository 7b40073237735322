import hashlib
from collections import Counter

import pytest

from shotstream.llm import sharding as S


def table_by_hand(shards, slots):
    def preferences(name):
        d = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(d[:8]) % slots, int.from_bytes(d[8:16]) % (slots - 1) + 1
        return iter([(offset + j * skip) % slots for j in range(slots)])

    lists, owner = {s: preferences(s) for s in shards}, {}
    while True:
        for s in sorted(shards):
            owner[next(x for x in lists[s] if x not in owner)] = s
            if len(owner) == slots:
                return [owner[i] for i in range(slots)]


def test_table_equals_turns():
    shards = ("b", "a", "c", "d")
    assert [shards[i] for i in S.lookup_table(shards, 101)] == table_by_hand(shards, 101)


def test_fair_and_steady():
    table = S.lookup_table()
    sizes = Counter(table.tolist()).values()
    assert len(sizes) == len(S.SHARDS) and max(sizes) - min(sizes) <= 1
    less = S.lookup_table(S.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, less)) / S.SLOTS
    assert 1 / 64 <= moved < 3 / 64
    for bad in [((), 7), (("a", "a"), 7), (("a",), 8), (tuple("abcdefgh"), 7)]:
        with pytest.raises(ValueError):
            S.lookup_table(*bad)


def test_placement(make, clashing):
    docs = clashing(make(["x"] * 6, [0, 1, 2, None, 2, 10**12]))
    rows = S.place(docs).collect()
    table = S.lookup_table()
    assert len(rows) == 6
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % S.SLOTS
        assert (r["slot"], r["shard"]) == (slot, S.SHARDS[table[slot]])
    assert S.place(docs.limit(0)).count() == 0
