import random
import zlib

from shotstream.llm import language as L

random.seed(2)
SOUNDS = {
    "xa": ["tha", "ther", "ing", "whe", "ould"], "xb": ["sch", "ung", "äch", "keit", "ein"],
    "xc": ["ción", "ñar", "que", "ado", "illo"],
}


def sentence(lang, n=20):
    return " ".join("".join(random.choices(SOUNDS[lang], k=random.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_held_out_accuracy_and_scores(spark):
    rows = [(i, sentence(lang, random.randint(2, 40)), lang) for i, lang in enumerate(random.choices(list(SOUNDS), k=600))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in L.predict_language(docs).collect()}
    assert len(got) == 600
    held = [r for r in got.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    right = sum(r["lang_pred"] == rows[r["doc_id"]][2] for r in held)
    assert right >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in got.values())
    # Labels of held-out rows are not used: without them nothing changes.
    blind = spark.createDataFrame([(i, t, None if got[i]["held_out"] else lang) for i, t, lang in rows], docs.schema)
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict_language(blind).collect()}
    assert again == {i: (r["lang_pred"], r["score"]) for i, r in got.items()}


def test_weights_are_sparse_and_temperature_calibrates():
    import numpy as np

    langs = random.choices(list(SOUNDS), k=300)
    vectors = [L.vector(L.letters(sentence(x).encode()), np.ones(L.BUCKETS)) for x in langs]
    weights, bias, temperature = L.fit(vectors, langs, list(SOUNDS))
    assert 0 < (weights != 0).mean() < 0.2 and temperature > 0 and len(bias) == 3


def test_edge_cases(spark, make, clashing):
    docs = make([None, "", "123 ... \n", "é", "x" * 200_000, "😀", sentence("xa")], lang="xa")
    got = {r["doc_id"]: r for r in L.predict_language(clashing(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 5)] == ["und"] * 4 and all(got[i]["score"] == 0 for i in (0, 1, 2, 5))
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == "xa"
    assert {r["lang_pred"] for r in L.predict_language(make([sentence("xa")], lang=None)).collect()} == {"und"}
    odd = L.predict_language(make(["½ ² ③ Ⅷ", "٣", "\u0301\u0301", "ª", sentence("xa")], lang="xa")).collect()
    assert [r["lang_pred"] for r in sorted(odd, key=lambda r: r["doc_id"])] == ["und"] * 3 + ["xa"] * 2
    assert L.predict_language(docs.limit(0)).count() == 0
    kept = L.keep_known(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6]


def test_grams_are_characters():
    for text in ["abcde", "äöü", "漢字かな", "a", "", "नमस्ते", "x" * 50]:
        plain = L.letters(text.encode())
        grams = [plain[i : i + k] for k in L.ORDERS for i in range(len(plain) - k + 1)]
        assert L.term_counts(plain).sum() == len(grams)
        assert (L.term_counts(plain) > 0).sum() == len(set(grams))  # no two of these share a bucket


def test_long_text_in_parts(monkeypatch):
    plain = L.letters("".join(random.choices("abcä 漢", k=5000)).encode())
    whole = L.term_counts(plain)
    monkeypatch.setattr(L, "_CHARACTERS", 7)
    assert (L.term_counts(plain) == whole).all()


def test_steps_equal_a_plain_version():
    """The learner written out coordinate by coordinate."""
    import math

    import numpy as np

    langs = random.choices(list(SOUNDS), k=40)
    idf = np.random.default_rng(1).uniform(1, 3, L.BUCKETS)
    vectors = [L.vector(L.letters(sentence(x, 4).encode()), idf) for x in langs]
    for (at, x), text in zip(vectors, langs):
        assert abs(sum(v * v for v in x) - 1) < 1e-9
    classes = sorted(SOUNDS)
    weights, bias, temperature = L.fit(vectors, langs, classes, epochs=2)
    z, n, alpha, beta, l1, l2 = {}, {}, 0.5, 1.0, 0.02, 0.02

    def weight(i, k):
        value, limit = z.get((i, k), 0.0), 0.0 if i == "bias" else l1
        if abs(value) <= limit:
            return 0.0
        return -(value - math.copysign(limit, value)) / ((beta + math.sqrt(n.get((i, k), 0.0))) / alpha + l2)

    def chances(row, t=1.0):
        logits = [sum(v * weight(i, k) for i, v in row) / t for k in range(3)]
        total = sum(math.exp(x) for x in logits)
        return [math.exp(x) / total for x in logits]

    rows = [[*zip(at.tolist(), x.tolist()), ("bias", 1.0)] for at, x in vectors]
    learn = [i for i in range(40) if i % 5]
    for epoch in range(2):
        for j in np.random.default_rng(epoch).permutation(learn):
            p = chances(rows[j])
            w = {(i, k): weight(i, k) for i, _ in rows[j] for k in range(3)}
            for i, v in rows[j]:
                for k in range(3):
                    g = v * (p[k] - (classes[k] == langs[j]))
                    before = n.get((i, k), 0.0)
                    sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / alpha
                    z[i, k] = z.get((i, k), 0.0) + g - sigma * w[i, k]
                    n[i, k] = before + g * g
    for k in range(3):
        assert abs(bias[k] - weight("bias", k)) < 1e-6
        assert max(abs(weights[i, k] - weight(i, k)) for i in {i for i, _ in z if i != "bias"}) < 1e-6
    loss = lambda t: -sum(math.log(chances(rows[j], t)[classes.index(langs[j])]) for j in range(0, 40, 5))
    assert all(loss(temperature) <= loss(t) + 1e-6 for t in np.exp(np.linspace(np.log(0.05), np.log(5), 60)))


def test_sample_is_bounded_without_ids_and_with_repeats(spark):
    same, other = [(None, sentence("xa"), "xa")] * 900, [(None, sentence("xb", 8), "xb") for _ in range(900)]
    many = [(i, sentence("xc", 3), f"l{i:03d}") for i in range(40)]
    docs = spark.createDataFrame(same + other + many, "doc_id bigint, text string, lang string")
    seen = []
    fit, L.fit = L.fit, lambda vectors, langs, classes: seen.append((langs, classes)) or fit(vectors, langs, classes)
    try:
        model = L.fit_model(docs, per_language=50, languages=10)
    finally:
        L.fit = fit
    langs, classes = seen[0]
    assert classes == ["l000", "l001", "l002", "l003", "l004", "l005", "l006", "l007", "xa", "xb"] == model[0]
    assert langs.count("xa") <= 1 and 20 <= langs.count("xb") <= 100 and len(langs) < 120
