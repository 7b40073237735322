import random

from shotstream.llm import licenses as L
from shotstream.llm.common import split_words
from shotstream.llm.license_texts import TEMPLATES

random.seed(8)
INDEX = L.Index(TEMPLATES)


def found(text):
    return [(INDEX.names[t], m, a, b) for t, m, a, b in L.scan(INDEX.numbers(split_words(text.encode())), INDEX)]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_every_template_is_found_whole():
    for name, text in TEMPLATES.items():
        size = len(split_words(text.encode()))
        assert (name, size, 3, 2 + size) in found(f"some words before {text} and after")


def test_alignment_equals_longest_common_subsequence_in_the_band():
    for _ in range(200):
        a = [random.randint(1, 5) for _ in range(random.randint(1, 12))]
        b = [random.randint(1, 5) for _ in range(random.randint(0, 14))]
        import numpy as np

        matched, first, last = L.align(np.array(a), np.array(b, dtype=np.int64), 0, 30)
        assert matched == longest_common(a, b)
        assert (first == -1) == (matched == 0) and (matched == 0 or 0 <= first <= last < len(b))


def test_edited_template():
    words = TEMPLATES["mit"].split()
    changed = words[:30] + ["foo", "bar"] + words[31:80] + words[83:]
    ((name, matched, first, last),) = found(" ".join(["x"] * 10 + changed + ["y"]))
    assert name == "mit" and first == 10 and matched >= len(split_words(TEMPLATES["mit"].encode())) - 5
    assert found(" ".join(words[:60])) == [] and found("the of the and to the") == []


def test_inserts_and_gaps_are_bridged():
    size = len(split_words(TEMPLATES["mit"].encode()))
    words = [w.decode() for w in split_words(TEMPLATES["mit"].encode())]
    for place in (20, size // 2, size - 20):
        for more in (16, 17, 20, 40, 64):
            text = " ".join(["x"] * 5 + words[:place] + ["zzz"] * more + words[place:] + ["y"])
            assert found(text) == [("mit", size, 5, 4 + size + more)]
    ((name, matched, _, _),) = found(" ".join(words[:80] + words[110:]))
    assert name == "mit" and matched == size - 30
    twice = words[:60] + ["zzz"] * 20 + words[60:110] + ["qqq"] * 20 + words[110:]
    assert found(" ".join(twice)) == [("mit", size, 0, size + 39)]
    # Two copies stay two, however close.
    assert [x[1:] for x in found(" ".join(words + words))] == [(size, 0, size - 1), (size, size, 2 * size - 1)]
    assert [x[1:] for x in found("Released under the MIT License. " * 2)] == [(5, 0, 4), (5, 5, 9)]


def test_texts_that_hold_others():
    both = {name: (m, len(split_words(TEMPLATES[name].encode()))) for name, m, _, _ in found(TEMPLATES["bsd-3-clause"])}
    assert both["bsd-3-clause"][0] == both["bsd-3-clause"][1] and both["bsd-2-clause"][0] == both["bsd-2-clause"][1]


def test_repeats_are_reported_each():
    assert [x[2] for x in found("All rights reserved. " * 3 + "x all rights reserved")] == [0, 3, 6, 10]


def test_table(make, clashing):
    notice = TEMPLATES["mit-notice"]
    docs = clashing(make([None, "", notice, f"a b\n{notice.upper()}\nc", "nothing", notice], [0, 1, 2, 3, 4, 2]))
    rows = sorted(tuple(r) for r in L.scan_licenses(docs).collect())
    assert rows == [(2, "mit-notice", 1.0, 5, 0, 5)] * 2 + [(3, "mit-notice", 1.0, 5, 2, 7)]
    assert L.scan_licenses(docs.limit(0)).count() == 0
