"""SentencePiece encoding and decoding: the best-scoring path through pieces, byte fallback, word markers.

The pieces of a model file lie in a double-array trie over UTF-8 bytes. Encoding is the Viterbi path
that maximises the sum of piece scores; a character that no piece covers costs the lowest score less
ten and becomes its bytes' pieces. A space is the marker U+2581; one is put before the text and taken
away in decoding. No piece has a marker behind another character (that is checked; else a text is one
unit), so the best path of a text is that of its marked words, and each distinct word is solved once per
task and remembered up to a number of bytes. Many words are solved at a time: all their positions walk the
trie together, then paths grow byte by byte for all words at once. A long word is solved alone, with the
spans of a stretch of it at a time, so that memory beyond the text is some 20 bytes a byte.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotstream.llm.common import batched_texts, map_batches

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
# Words longer than LONG bytes are solved alone and not remembered; others by SOLVED_BYTES at a time.
LONG, STRETCH = 1 << 10, 1 << 15
SLICE_BYTES, SOLVED_BYTES, REMEMBERED_BYTES = 1 << 20, 1 << 18, 24 << 20
_RUNS = re.compile(rb" +[^ ]*|[^ ]+")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unsupported wire type {kind}")
        yield key >> 3, value


def read_model(data: bytes) -> list[tuple[bytes, float, int]]:
    """(piece, score, type) by id. Models that rewrite characters before encoding are refused."""
    pieces = []
    for number, value in _fields(data):
        if number == 1:
            part = dict(_fields(value))
            score = struct.unpack("<f", part[2])[0] if 2 in part else 0.0
            pieces.append((part.get(1, b""), score, part.get(3, NORMAL)))
        elif number == 3:
            rules = dict(_fields(value))
            if rules.get(2) or rules.get(4, 1) or not rules.get(3, 1) or not rules.get(5, 1):
                raise ValueError("only models with identity normalisation, a leading marker and escaped spaces")
    return pieces


class DoubleArray:
    """A trie in two arrays: the child of ``node`` by byte b is ``base[node] + b + 1`` if that position's
    ``check`` is ``node``; ``value`` is the id of the key ending there, or -1."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        size = 1 << 16
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        self.check[0] = 0
        keys = sorted(keys)
        todo, low = [(0, 0, len(keys), 0)], 1  # no position below low is free
        while todo:
            node, begin, end, depth = todo.pop()
            while begin < end and len(keys[begin][0]) == depth:
                self.value[node] = keys[begin][1]
                begin += 1
            children: list[tuple[int, int, int]] = []
            for i in range(begin, end):
                byte = keys[i][0][depth]
                if not children or children[-1][0] != byte:
                    children.append((byte, i, i + 1))
                else:
                    children[-1] = (byte, children[-1][1], i + 1)
            if not children:
                continue
            codes = np.array([c[0] + 1 for c in children])
            at, seek = -1, low
            while at < 0:
                while seek + 4400 > len(self.check):
                    self._grow()
                free = seek + np.flatnonzero(self.check[seek : seek + 4096] < 0)
                if seek == low and len(free):
                    low = int(free[0])
                fits = free[free >= codes[0] + 1] - codes[0]
                for code in codes[1:]:
                    fits = fits[self.check[fits + code] < 0]
                at, seek = (int(fits[0]) if len(fits) else -1), seek + 4096
            self.base[node] = at
            self.check[at + codes] = node
            todo += [(at + byte + 1, i, j, depth + 1) for byte, i, j in children]

    def _grow(self) -> None:
        self.base = np.concatenate((self.base, np.zeros_like(self.base)))
        self.value = np.concatenate((self.value, np.full_like(self.value, -1)))
        self.check = np.concatenate((self.check, np.full_like(self.check, -1)))


def _character_ends(flat: np.ndarray, starts: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Where the characters that begin at ``starts`` end: before the next first byte."""
    ends = starts + 1
    while True:
        inside = ends < stop
        inside[inside] = (flat[ends[inside]] & 0xC0) == 0x80
        if not inside.any():
            return ends
        ends += inside


class Pieces:
    """Everything a worker needs, built once on the driver."""

    def __init__(self, data: bytes):
        pieces = read_model(data)
        usable = [(p, i) for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p]
        self.trie = DoubleArray(usable)
        scores = [score for _, score, kind in pieces if kind == NORMAL]
        lowest, highest = min(scores), max(scores)
        self.score = np.array(
            [len(p.decode()) * highest - 0.1 if kind == USER else score for p, score, kind in pieces]
        )
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown_id = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        self.surface = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL
            else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, b" ")
            for p, _, kind in pieces
        ]
        self.crossing = any(re.search(rb"(?<!\xe2\x96\x81)\xe2\x96\x81", p[1:]) and not p.startswith(MARK * 2) for p, _ in usable if len(p) > 3 and MARK in p[1:])

    def _spans(self, flat: np.ndarray, starts: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of every piece that begins at one of the ``starts`` (characters' first bytes) and
        ends by its ``stop``. A character without a piece of its own gets a span with id -1."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        origin, at, limit, node = starts, starts.copy(), stop, np.zeros(len(starts), np.int64)
        begins, ends, ids = [], [], []
        while len(origin):
            child = base[node] + flat[at] + 1
            ok = check[child] == node
            origin, at, limit, node = origin[ok], at[ok] + 1, limit[ok], child[ok]
            done = value[node] >= 0
            begins.append(origin[done])
            ends.append(at[done])
            ids.append(value[node[done]])
            ok = at < limit
            origin, at, limit, node = origin[ok], at[ok], limit[ok], node[ok]
        start, end, piece = map(np.concatenate, (begins, ends, ids))
        own_end = _character_ends(flat, starts, stop)
        place = np.searchsorted(starts, start)
        single = np.zeros(len(starts), bool)
        single[place[end == own_end[place]]] = True
        alone = ~single
        start = np.concatenate((start, starts[alone]))
        end = np.concatenate((end, own_end[alone]))
        return start, end, np.concatenate((piece, np.full(alone.sum(), -1)))

    def _as_bytes(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the bytes' pieces in place of every -1, and how many each became. ``begins`` and
        ``ends`` are where the piece lies in ``flat``."""
        unknown = ids < 0
        if not unknown.any() or not self.byte_id:
            return np.where(unknown, self.unknown_id, ids).astype(np.int32), np.ones(len(ids), np.int64)
        sizes = np.where(unknown, ends - begins, 1)
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out, spread = np.repeat(ids, sizes), np.repeat(unknown, sizes)
        table = np.array([self.byte_id[b] for b in range(256)])
        out[spread] = table[flat[(np.repeat(begins, sizes) + within)[spread]]]
        return out.astype(np.int32), sizes

    def solve_long(self, chunk: bytes) -> np.ndarray:
        """Ids of one chunk. Equal paths are told apart as in ``solve``: the last piece that starts first."""
        flat, n = np.frombuffer(chunk, np.uint8), len(chunk)
        best, back, by = array("d", [-np.inf]) * (n + 1), array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for low in range(0, n, STRETCH):
            starts = low + np.flatnonzero((flat[low : low + STRETCH] & 0xC0) != 0x80)
            if low == 0 and (not len(starts) or starts[0]):
                starts = np.concatenate(([0], starts))
            start, end, piece = self._spans(flat, starts, np.full(len(starts), n))
            gain = np.where(piece >= 0, self.score[piece], self.unknown_score)
            order = np.argsort(start, kind="stable")
            for i, j, k, g in zip(start[order].tolist(), end[order].tolist(), piece[order].tolist(), gain[order].tolist()):
                reached = best[i] + g
                if reached > best[j]:
                    best[j], back[j], by[j] = reached, i, k
        cuts, ids, at = [n], array("q"), n
        while at > 0:
            ids.append(by[at])
            at = back[at]
            cuts.append(at)
        cuts = np.array(cuts[::-1])
        return self._as_bytes(np.array(ids)[::-1], cuts[:-1], cuts[1:], flat)[0]

    def solve(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and how many each has."""
        sizes = np.array([len(c) for c in chunks], np.int64)
        flat = np.frombuffer(b"".join(chunks), np.uint8)
        # Position p of chunk i is number begins[i] + p; every chunk has one more, for its end.
        begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        chunk_of = np.repeat(np.arange(len(chunks)), sizes)
        number = np.arange(len(flat)) + chunk_of
        starts = np.flatnonzero((flat & 0xC0) != 0x80)
        start, end, piece = self._spans(flat, starts, np.cumsum(sizes)[chunk_of[starts]])
        gain = np.where(piece >= 0, self.score[piece], self.unknown_score)
        from_ = number[start]
        to = from_ + end - start
        level = to - begins[chunk_of[start]]
        order = np.lexsort((from_, to, level))
        from_, to, piece, gain, level = from_[order], to[order], piece[order], gain[order], level[order]
        best = np.full(len(flat) + len(chunks), -np.inf)
        best[begins] = 0.0
        back, by = np.zeros(len(best), np.int64), np.full(len(best), -1, np.int64)
        cuts = np.flatnonzero(np.diff(level)) + 1
        for i, j in zip(np.concatenate(([0], cuts)), np.append(cuts, len(level))):
            if i == j:
                continue
            reached = best[from_[i:j]] + gain[i:j]
            heads = np.flatnonzero(np.diff(to[i:j], prepend=-1))
            top = np.maximum.reduceat(reached, heads)
            winners = np.flatnonzero(reached == np.repeat(top, np.diff(np.append(heads, j - i))))
            # Of equal paths the one whose last piece starts first wins.
            winners = winners[np.unique(to[i + winners], return_index=True)[1]]
            target = to[i + winners]
            best[target], back[target], by[target] = reached[winners], from_[i + winners], piece[i + winners]
        cursor, owner = begins + sizes, np.arange(len(chunks))
        owners, steps, found, spans = [], [], [], []
        step = 0
        while True:
            going = cursor > begins[owner]
            cursor, owner = cursor[going], owner[going]
            if not len(cursor):
                break
            owners.append(owner)
            steps.append(np.full(len(owner), -step))
            found.append(by[cursor])
            spans.append(back[cursor])
            cursor = back[cursor]
            step += 1
        if not owners:
            return np.zeros(0, np.int32), np.zeros(len(chunks), np.int64)
        owner, rank, got, span = map(np.concatenate, (owners, steps, found, spans))
        order = np.lexsort((rank, owner))
        owner, got, span = owner[order], got[order], span[order]
        begin = span - owner  # a position's number, less its chunk's, is its place in the text
        end = np.where(np.append(owner[1:] == owner[:-1], False), np.append(begin[1:], 0), np.cumsum(sizes)[owner])
        ids, became = self._as_bytes(got, begin, end, flat)
        return ids, np.bincount(owner, weights=became, minlength=len(chunks)).astype(np.int64)

    def words(self, text: bytes) -> list[bytes]:
        """The units of a text, each without its leading marker."""
        if not text:
            return []
        text = text.replace(MARK, b" ")
        if self.crossing:
            return [text]
        if b"  " in text or text[:1] == b" ":
            return [run[1:] for run in _RUNS.findall(b" " + text)]
        return text.split(b" ")


class Encoder:
    """Encodes batches of texts; remembers solved words up to a number of bytes."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.bytes = 0

    def _solve(self, words: list[bytes]) -> None:
        chunks, size, begin = [], 0, 0
        for i, word in enumerate(words):
            chunks.append(MARK + word.replace(b" ", MARK))
            size += len(chunks[-1])
            if size >= SOLVED_BYTES or i == len(words) - 1:
                ids, counts = self.pieces.solve(chunks)
                raw, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
                self.known.update(zip(words[begin : i + 1], [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]))
                self.bytes += size + len(raw) + 160 * len(chunks)
                chunks, size, begin = [], 0, i + 1

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if self.bytes > REMEMBERED_BYTES:
            self.reset()
        known, long = self.known, self.pieces.solve_long
        parts = [self.pieces.words(text) for text in texts]
        self._solve(list({w for part in parts for w in part if w not in known and len(w) <= LONG}))
        rows = [
            b"".join([known.get(w) or long(MARK + w.replace(b" ", MARK)).tobytes() for w in part])
            for part in parts
        ]
        return np.frombuffer(b"".join(rows), np.int32), np.array([len(row) // 4 for row in rows], np.int64)


def decode(pieces: Pieces, ids: list[int]) -> str:
    """Surfaces in a row, byte pieces as bytes (malformed ones as U+FFFD), without the leading space."""
    text = b"".join([pieces.surface[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _encoder(handle):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = handle.value
        encoder = Encoder(pieces)
        for batch, texts in batched_texts(batches, SLICE_BYTES):
            ids, counts = encoder.encode(texts)
            ends = np.concatenate(([0], np.cumsum(counts)))
            rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            fallback = np.concatenate(([0], np.cumsum(pieces.is_byte[ids])))
            decoded = [decode(pieces, ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.record_batch(
                [
                    *columns, rows, pa.array(counts, pa.int64()), pa.array(fallback[ends[1:]] - fallback[ends[:-1]], pa.int64()),
                    pa.array(decoded, pa.string()),
                ],
                names=[*names, "ids", "n_pieces", "n_byte_pieces", "decoded"],
            )

    return encode


def encode_documents(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """One row per document: doc_id, ids, n_pieces, n_byte_pieces, decoded.

    Null and empty texts have no pieces and decode to the empty text. A text decodes to itself, but for
    U+2581, which reads as a space. Repeated rows are encoded each; other columns are left out. The model
    file is read on the driver and sent to the executors; its size does not depend on the data.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(Path(model_file).read_bytes()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs.select("doc_id", "text"), _encoder(pieces),
        f"doc_id {kind}, ids array<int>, n_pieces bigint, n_byte_pieces bigint, decoded string",
    )
