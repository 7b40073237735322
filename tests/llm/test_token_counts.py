import random
import time

import pytest
import regex

from shotstream.llm import token_counts as T

random.seed(6)
PARTS = [*"ab'  \n\t1 9.,stlve'", "'ll", "  ", "\n\n", "é", "word", " x"]


@pytest.fixture(scope="module")
def counter():
    with open(T.RANKS_FILE, "rb") as f:
        return T.TokenCounter(f.read())


def whole(counter, text):
    return len(counter.encoding.encode_ordinary(text))


def test_edits_equal_full_counts(counter):
    for _ in range(800):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 60)))
        counted = T.CountedText(text, counter)
        assert counted.total == whole(counter, text)
        for _ in range(5):
            a = random.randint(0, len(text))
            b = random.randint(a, min(len(text), a + 8))
            new = "".join(random.choice(PARTS) for _ in range(random.randint(0, 5)))
            counted.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert counted.text() == text and counted.length == len(text)
            assert counted.total == whole(counter, text), repr(text)


def test_only_the_neighbourhood_is_counted_again(counter):
    counted = T.CountedText("some words in a row. " * 5000, counter)
    counted.edit(50_000, 50_003, "other things")
    counted.edit(10, 10, "!")
    assert counted.recounted < 30 and counted.total == whole(counter, counted.text())


def test_table(make, counter, clashing):
    texts = [None, "", "mail me.now@example.com or 1234 5678 9012.", "clean text", "1234567", "x@y.z 12345678", "clean text"]
    rows = {r["doc_id"]: r for r in T.count_tokens(clashing(make(texts))).collect()}
    assert rows[2]["edited_text"] == "mail [email] or [number]." and rows[2]["n_edits"] == 2
    assert rows[5]["edited_text"] == "[email] [number]" and rows[4]["n_edits"] == 0
    for i, text in enumerate(texts):
        assert rows[i]["n_tokens"] == whole(counter, text or "")
        assert rows[i]["n_tokens_edited"] == whole(counter, rows[i]["edited_text"])
    assert T.count_tokens(make(texts).limit(0)).count() == 0


def test_long_runs_are_read_once():
    """Every one of these took time by the square of its length, or would with a careless pattern."""
    for text, edits in [
        ("a" * 1_000_000, 0), ("0123456789abcdef" * 30_000, 30_000),
        ("0123456789abcdef" * 30_000 + "@x.y", 1), ("1234 5678 90" + "z" * 300_000 + "@x.y", 2), ("a@" * 300_000, 0), ("1" * 500_000, 1), ("a.b" * 200_000 + "@c.de", 1),
        ("x@" + "b" * 500_000, 0), ("12 " * 200_000, 1),
    ]:
        began = time.monotonic()
        assert len(T.redactions(text)) == edits
        assert time.monotonic() - began < 5


def test_pattern_equals_the_one_that_tries_every_start():
    plain = regex.compile(r"([\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?<!\d)(?:\d[ -]?){7,}\d(?!\d)")
    draw = random.Random(3)
    for _ in range(20000):
        text = "".join(draw.choices("a1.@ -22+3é", weights=[2, 9, 2, 2, 1, 1, 9, 9, 1, 9, 1], k=draw.randint(1, 40)))
        assert list(T.private_spans(text)) == [(*m.span(), m.group(1) is not None) for m in plain.finditer(text)], text


def test_long_text_is_counted_and_memory_is_bounded(make, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED_BYTES", 10_000)
    text = "z" * 1_000_000 + " mail me@x.org " + "é" * 200_000
    row = T.count_tokens(make([text])).first()
    assert row["n_edits"] == 1 and row["edited_text"] == text.replace("me@x.org", "[email]")
