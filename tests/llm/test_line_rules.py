import re
from collections import Counter

from shotstream.llm import line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [
    None, "", " \t\n ", "one", "a b c a b c", "a a a a a", "x y z\nx y z\n\nx y z",
    "é# ñ* 😀|\x0b\x0c\r end.", ("The quick brown fox jumps over it. " * 20).strip(), " non breaking",
    " ".join(f"w{i % 37}" for i in range(400)) + ".", "\n".join(["Home | About | Contact | Login"] * 30),
]


def test_measures_equal_brute_force(make):
    out = {r["doc_id"]: r for r in line_rules.line_verdicts(make(TEXTS)).collect()}
    assert len(out) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = out[i]
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == measures(text), text
        failed = got[0] < 50 or 100 * got[4] > 50 * got[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def prose(n, word="word"):
    return " ".join(f"{word}{i}" for i in range(n)) + "."


def test_lines_fail_first_then_documents(make):
    good, menu = prose(60), "Home | News | Sport | Weather | More"
    texts = [good, f"{menu}\n{good}\nclick here to read", f"{menu}\n" * 30 + good[:80] + ".", prose(60)[:-1], good]
    rows = {r["doc_id"]: r for r in line_rules.line_verdicts(make(texts)).collect()}
    assert rows[0]["kept"] and rows[0]["clean_text"] == good and rows[4]["kept"]
    assert rows[1]["kept"] and rows[1]["clean_text"] == good and rows[1]["n_bad_lines"] == 2
    assert not rows[2]["kept"] and not rows[3]["kept"] and rows[3]["clean_text"] == ""


def test_clean_documents_keep_columns(make, clashing):
    docs = make([prose(60) + "\nmenu", None, ""])
    out = line_rules.clean_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in rows] == [(0, prose(60), len(prose(60)))]
    assert line_rules.line_verdicts(clashing(docs)).count() == 3
    assert line_rules.clean_documents(docs.limit(0)).count() == 0
