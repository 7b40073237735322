import random

import pytest

from shotstream.llm import pieces as P

random.seed(4)
TEXTS = [
    "", " a", "a  b   c", "héllo 世界 😀\n\n tab\t", "   ", "\x00\x01", "The quick brown fox.", "word " * 50,
    "x" * 3000, "a b c", "ßüöä ñ ção", "<s> </s> <unk> <0x0A>", "\n", " \n ", "a ", "ﬁ ﷺ",
]
TEXTS += ["".join(random.choice("abcdeé \n.,'世😀 ") for _ in range(random.randint(1, 60))) for _ in range(150)]


@pytest.fixture(scope="module")
def pieces():
    with open(P.MODEL_FILE, "rb") as f:
        return P.Pieces(f.read())


def viterbi(pieces, text):
    """The best path over the whole text, position by position."""
    if not text:
        return []
    text = "▁" + text.replace(" ", "▁")
    data = text.encode()
    starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80] + [len(data)]
    known = {p.replace(b" ", P.MARK): i for i, p in enumerate(pieces.surface) if not pieces.is_byte[i] and i > 2 and p}
    longest = max(map(len, known))
    best, back = {0: 0.0}, {}
    for a, after in zip(starts[:-1], starts[1:]):
        found = [(b, known[data[a:b]]) for b in starts if a < b <= a + longest and data[a:b] in known]
        moves = [(b, i, pieces.score[i]) for b, i in found]
        if all(b != after for b, _ in found):
            moves.append((after, -1, pieces.unknown_score))
        for b, i, s in moves:
            if b not in best or best[a] + s > best[b]:
                best[b], back[b] = best[a] + s, (a, i)
    out, at = [], len(data)
    while at:
        a, i = back[at]
        out[:0] = [i] if i >= 0 else [pieces.byte_id[x] for x in data[a:at]]
        at = a
    return out


def test_equals_plain_viterbi(pieces):
    ids, counts = P.Encoder(pieces).encode([t.encode() for t in TEXTS])
    at = 0
    for text, n in zip(TEXTS, counts):
        assert ids[at : at + n].tolist() == viterbi(pieces, text), repr(text)
        at += n


def test_equals_the_library(pieces):
    sentencepiece = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    with open(P.MODEL_FILE, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # search the same pieces as a unigram model
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in TEXTS:
        if len(text) < 100:  # the library adds scores in single precision
            ids, _ = P.Encoder(pieces).encode([text.encode()])
            assert ids.tolist() == library.encode(text), repr(text)
            assert P.decode(pieces, ids.tolist()) == library.decode(ids.tolist())


def test_round_trip_in_spark(make, clashing):
    docs = clashing(make([*TEXTS, None, TEXTS[3], "a▁b"]))
    rows = {r["doc_id"]: r for r in P.encode_documents(docs).collect()}
    assert len(rows) == len(TEXTS) + 3
    for i, text in enumerate(TEXTS):
        assert rows[i]["decoded"] == text and rows[i]["n_pieces"] == len(rows[i]["ids"])
    n = len(TEXTS)
    assert rows[n]["ids"] == [] and rows[n]["decoded"] == "" and rows[n + 1]["ids"] == rows[3]["ids"]
    assert rows[n + 2]["decoded"] == "a b"
    assert P.encode_documents(docs.limit(0)).count() == 0


def test_memory_is_bounded(pieces, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED_BYTES", 5)
    encoder = P.Encoder(pieces)
    for text in TEXTS:
        ids, _ = encoder.encode([text.encode()])
        assert P.decode(pieces, ids.tolist()) == text


def test_trie_finds_every_piece_and_nothing_else(pieces):
    trie = pieces.trie

    def look(key):
        node = 0
        for b in key:
            child = trie.base[node] + b + 1
            if trie.check[child] != node:
                return -1
            node = child
        return trie.value[node]

    keys = [(p.replace(b" ", P.MARK), i) for i, p in enumerate(pieces.surface) if i > 2 and not pieces.is_byte[i]]
    assert all(look(k) == i for k, i in keys)
    known = {k for k, _ in keys}
    assert all(look(k + b"\xff") == -1 for k, _ in keys[::50])
    assert all((k[:-1] in known) == (look(k[:-1]) >= 0) for k, _ in keys[::20] if len(k) > 1)


def test_long_word_alone_equals_the_same_word_among_others(pieces):
    for text in filter(None, TEXTS):
        chunk = P.MARK + text.replace(" ", "▁").encode()
        assert pieces.solve_long(chunk).tolist() == pieces.solve([chunk])[0].tolist() == viterbi(pieces, text)


def test_long_texts_without_a_break(pieces, make):
    """A megabyte of letters, and one of characters outside all pieces, in seconds and bounded memory."""
    draw = random.Random(2)
    texts = ["".join(draw.choices("abcdefghij", k=1_000_000)), "𓀀" * 250_000, "世界" * 100_000 + " end", "\U000102a5 " * 50_000]
    rows = P.encode_documents(make(texts)).collect()
    assert {r["decoded"] for r in rows} == set(texts)
    encoder = P.Encoder(pieces)
    encoder.encode([t.encode() for t in texts])
    assert encoder.bytes < 1 << 16


def test_memory_of_solved_words_is_bounded(pieces, monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED_BYTES", 20_000)
    encoder = P.Encoder(pieces)
    for i in range(20):
        text = " ".join(f"word{i}x{j}" for j in range(60))
        ids, counts = encoder.encode([text.encode()])
        assert P.decode(pieces, ids.tolist()) == text and encoder.bytes < 40_000
