import random

import numpy as np

from shotstream.llm import near_duplicates as N
from shotstream.llm.common import split_words

random.seed(11)
WORDS = [f"w{i}" for i in range(3000)]


def prose(n):
    return [random.choice(WORDS) for _ in range(n)]


def edited(words, times):
    words = words[:]
    for _ in range(times):
        words[random.randrange(len(words))] = random.choice(WORDS)
    return words


def weights_by_hand(texts):
    bags = []
    for text in texts:
        words = split_words((text or "").encode())
        k = min(5, len(words))
        bag = {}
        for i in range(len(words) - k + 1 if words else 0):
            shingle = tuple(words[i : i + k])
            bag[shingle] = bag.get(shingle, 0) + 1
        bags.append(bag)
    df = {}
    for bag in bags:
        for s in bag:
            df[s] = df.get(s, 0) + 1
    n = len(texts)
    factor = {s: 1 + np.log(1 / max(d / n, N.RARE)) / np.log(1 / N.RARE) for s, d in df.items()}
    return [{s: t * factor[s] for s, t in bag.items()} for bag in bags]


def jaccard(a, b):
    both = sum(min(w, b[s]) for s, w in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def classes_by_hand(texts, ids):
    bags, parent = weights_by_hand(texts), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or jaccard(bags[i], bags[j]) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return {x: least[find(i)] for i, x in enumerate(ids)}


def test_classes_equal_brute_force(make):
    texts = []
    for k in range(25):
        base = prose(random.randint(30, 200))
        texts += [" ".join(base), " ".join(edited(base, 1)), " ".join(edited(base, random.randint(0, 8)))]
    passage = prose(60)
    texts += [" ".join(prose(40) + passage + prose(40)) for _ in range(30)]
    texts += [None, "", "", "  ", "one", "One!", "two words", "*** ###", "*** ###", "a b c d e", "A, b; c d e."]
    texts += [" ".join(["same"] * 50), " ".join(["same"] * 51), " ".join(["same"] * 400)]
    ids = list(range(100, 100 + len(texts)))
    got = {r["doc_id"]: r["class_id"] for r in N.duplicate_classes(make(texts, ids)).collect()}
    assert got == classes_by_hand(texts, ids)


def test_one_large_group_of_edited_copies(make):
    base = prose(150)
    texts = [" ".join(edited(base, 1 + i % 2)) for i in range(300)] + [" ".join(base)] + [" ".join(prose(150)) for _ in range(50)]
    got = N.duplicate_classes(make(texts)).collect()
    assert {r["class_id"] for r in got if r["doc_id"] <= 300} == {0}
    assert all(r["class_id"] == r["doc_id"] for r in got if r["doc_id"] > 300)


def test_edited_copies_without_their_original(make, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64, raising=False)
    base = prose(150)
    texts = [" ".join(edited(base, 2)) for _ in range(300)] + [" ".join(prose(150)) for _ in range(50)]
    got = {r["doc_id"]: r["class_id"] for r in N.duplicate_classes(make(texts)).collect()}
    assert got == classes_by_hand(texts, range(len(texts)))


def test_similarities_of_a_block_equal_those_of_pairs():
    base = prose(60)
    texts = [" ".join(edited(base, i % 7)) for i in range(50)] + ["same " * 50, "same " * 400, "one", "", "one two", " ".join(prose(30))]
    texts = [text.encode() for text in texts]
    shingles, weights = N.Shingler(), N.Weights({})
    got = N._similarities(texts, shingles, weights)
    want = [[N.similarity(x, y, shingles, weights) for y in texts] for x in texts]
    assert np.allclose(got, want, atol=1e-12)


def test_one_document_of_a_class_stays(make, clashing):
    base = prose(80)
    docs = clashing(make([" ".join(base), " ".join(base), " ".join(base), "x y", None, "x y"], [5, 3, 3, None, 7, None]))
    kept = N.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [
        (False, 3, " ".join(base)), (False, 7, None), (True, 0, "x y")
    ]
    assert N.deduplicate(docs.limit(0)).count() == 0


def test_agreement_estimates_similarity():
    shingles, sampler, weights = N.Shingler(), N.Sampler(), N.Weights({})
    same, truth = [], []
    for _ in range(300):
        base = prose(120)
        pair = [" ".join(w).encode() for w in (base, edited(base, 4))]
        ids, times, _, counts = shingles(pair)
        a, b = sampler(ids, weights(ids, times), counts)
        same.append((a == b).mean())
        truth.append(N.similarity(*pair, shingles, weights))
    assert abs(np.mean(same) - np.mean(truth)) < 0.02


def test_frequent_shingles_are_exact(make):
    common = " ".join(prose(8))
    texts = [f"{common} {' '.join(prose(20))}" for _ in range(40)] + [" ".join(prose(30)) for _ in range(960)]
    found = N.frequent_shingles(make(texts))
    assert len(found) >= 4 and sum(abs(share - 0.04) < 1e-12 for share in found.values()) == 4
