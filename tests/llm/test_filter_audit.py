import random
from collections import Counter
from itertools import permutations

from shotstream.llm import filter_audit as A


def failing(rows):
    """Letters that each row fails, by the plain rules."""
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        tests = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows),
        }
        out.append({x for x, bad in tests.items() if bad})
    return out


def by_hand(rows, good, toxic):
    out = {}
    fails = failing(rows)
    for part in {lang or "" for *_, lang in rows}:
        mine = [(doc, f) for (doc, _, lang), f in zip(rows, fails) if (lang or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in f for _, f in mine) - len(gone),
                    sum(f == {letter} for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(docs, labels):
    rows = A.audit(docs, labels).collect()
    out = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_every_order_walked(spark, clashing):
    draw = random.Random(4)
    pool = ["word", "two", "Three", "f#ur", "ÉCOLE", "x", " y"]
    texts = [" ".join(draw.choices(pool + [f"w{i}" for i in range(300)], k=draw.choice([3, 150, 260]))) for _ in range(25)]
    texts += ["", None, " \t\n", "same words " * 150, "a b " * 200 + "\x0b&", "A" * 40, "é" * 97 + "AAA", "é" * 96 + "AAAA", "long " * 60_000]
    rows = [(i, t, draw.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(100 + i, draw.choice(texts), draw.choice(["en", "de", "fr"])) for i in range(40)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (3, texts[3], "en"), (3, texts[3], "de"), (3, texts[4], "en")]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5))
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 140, 3)] + [(None, 1, 1), (6, None, 1), (9, 1, None), (999, 1, 1), (12, 1, 0)]
    labels = clashing(spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"))
    good, toxic = {i for i, q, _ in marks if i is not None and q == 1}, {i for i, _, t in marks if i is not None and t == 1}
    want = by_hand(rows, good, toxic)
    assert len(want) == 600 * 4 and audited(docs, labels) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audited(docs, labels) == {}
    one = spark.createDataFrame([(None, None, None)], docs.schema)
    assert audited(one, labels) == by_hand([(None, None, None)], set(), set())
