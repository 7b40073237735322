import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from shotstream.llm import context_tree as C

random.seed(3)


def by_hand(training, share):
    """The weighted tree by its recursion: a function from context bytes (latest last) to 256 chances."""
    depth = C.DEPTH
    seen = []
    for text in training:
        data = bytes([C.END] * depth) + text + bytes([C.END])
        seen += [(data[i - depth : i], data[i]) for i in range(depth, len(data))]
    kept = {
        c for d in range(depth + 1)
        for c, n in Counter(context[depth - d :] for context, _ in seen).items()
        if n >= max(1, len(seen) * share)
    } | {b""}

    def node(context, rows, d, upper):
        out = {"log": {}, "one": {}, "stop": {}, "children": {}, "upper": upper}
        longer = {r[0][depth - d - 1 :] for r in rows if d < depth} & kept if d < depth else set()
        inner = any(c in kept for c in longer)
        counts = Counter()
        for _, byte in rows:
            for level in range(8):
                counts[(1 << level) - 1 + (byte >> (8 - level)), byte >> (7 - level) & 1] += 1
        for k in range(255):
            a, b = counts[k, 0], counts[k, 1]
            kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            own = (b + 0.5) / (a + b + 1)
            out["one"][k] = own if a + b or upper is None else upper["one"][k]
            out["log"][k] = kt
        if context is not None and inner:
            for c in longer:
                out["children"][c] = node(c, [r for r in rows if r[0][depth - d - 1 :] == c], d + 1, out)
            other = [r for r in rows if r[0][depth - d - 1 :] not in longer]
            out["rest"] = node(None, other, d + 1, out)
            for k in range(255):
                product = sum(x["log"][k] for x in [*out["children"].values(), out["rest"]])
                mixed = math.log(0.5) + np.logaddexp(out["log"][k], product)
                out["stop"][k] = math.exp(math.log(0.5) + out["log"][k] - mixed)
                out["log"][k] = mixed
        return out

    root = node(b"", seen, 0, None)

    def chance(context, byte):
        p = 1.0
        for level in range(8):
            k = (1 << level) - 1 + (byte >> (8 - level))
            at, left, one, d = root, 1.0, 0.0, 0
            while at["children"]:
                one += left * at["stop"][k] * at["one"][k]
                left *= 1 - at["stop"][k]
                d += 1
                at = at["children"].get(context[depth - d :], at["rest"])
            one += left * at["one"][k]
            p *= one if byte >> (7 - level) & 1 else 1 - one
        return p

    return chance


def score(chance, text):
    data = bytes([C.END] * C.DEPTH) + text + bytes([C.END])
    return sum(math.log10(chance(data[i - C.DEPTH : i], data[i])) for i in range(C.DEPTH, len(data)))


@pytest.mark.parametrize("share", [0.02, 0.2, 2.0**-15])
def test_scores_equal_the_recursion(make, share):
    texts = ["".join(random.choice("abAB  é") for _ in range(random.randint(0, 25))) for _ in range(30)]
    texts += [None, "", "aaaa aaaa", "aaaa aaaa"]
    rows = {r["doc_id"]: r for r in C.score_documents(make(texts), share).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    lower = [(t or "").encode().lower() for t in texts]
    chance = by_hand([t for i, t in enumerate(lower) if not held[i]], share)
    counts = Counter()
    for i, t in enumerate(lower):
        if not held[i]:
            counts.update([*t.split(), b""])
    n, v = counts.total(), len(counts)
    assert len(rows) == len(texts)
    for i, t in enumerate(lower):
        tokens = [*t.split(), b""]
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(tokens), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in tokens)
        assert abs(r["base_score"] - want) < 1e-9 and abs(r["score"] - score(chance, t)) < 1e-4, i


def test_words_that_are_joined_count_the_same(make, monkeypatch):
    docs = make([" ".join(random.choice("abcdefgh") * 2 for _ in range(30)) for _ in range(20)])
    whole = {r["doc_id"]: (r["n_known"], round(r["base_score"], 9)) for r in C.score_documents(docs).collect()}
    monkeypatch.setattr(C, "SENT_WORDS", 2)
    assert {r["doc_id"]: (r["n_known"], round(r["base_score"], 9)) for r in C.score_documents(docs).collect()} == whole


def test_rare_contexts_keep_their_own_counts(make, monkeypatch):
    """A share of the bytes would merge contexts seen once here; also with grams joined and heads apart."""
    texts = ["".join(random.choices("abc ", k=3000)) for _ in range(30)]
    texts += ["xyxyzq a", "xyxyzq a", "zqzqy b", "", None, "\n\n"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    lower = [(t or "").encode().lower() for t in texts]
    chance = by_hand([t for i, t in enumerate(lower) if not held[i]], 1e-12)
    for sent, paths in ((C.SENT_GRAMS, C.PATHS), (5, 10)):
        monkeypatch.setattr(C, "SENT_GRAMS", sent)
        monkeypatch.setattr(C, "PATHS", paths)
        rows = {r["doc_id"]: r for r in C.score_documents(make(texts)).collect()}
        assert len(rows) == len(texts)
        for i, t in enumerate(lower):
            if len(t) < 100 or held[i]:
                want = score(chance, t)
                assert abs(rows[i]["score"] - want) < 1e-4 + 1e-6 * abs(want), i


def test_chances_add_up_to_one():
    texts = [bytes(random.choices(b"abc ", k=200)) for _ in range(20)]
    codes, n = np.unique(C._packed(texts), return_counts=True)
    parts = []
    for d in range(C.DEPTH + 1):
        key, where = np.unique(((codes >> 8) & ((1 << 8 * d) - 1)) << 8 | codes & 255, return_inverse=True)
        parts.append((np.full(len(key), d), key >> 8, key & 255, np.bincount(where, n)))
    tree = C.build_tree(*map(np.concatenate, zip(*parts)))
    assert np.allclose((2.0 ** tree.log2).sum(axis=1), 1, atol=1e-5)


def test_nothing_to_learn_from(make, spark, clashing):
    one = make(["ab"], [next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)])
    r = C.score_documents(clashing(one)).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 2, 0, 0, 0.0)
    assert abs(r["score"] - 24 * math.log10(0.5)) < 1e-4
    assert C.score_documents(one.limit(0)).count() == 0
    assert C.score_documents(make(["x"], [None])).first()["doc_id"] is None
