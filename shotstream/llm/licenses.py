"""Licence scan: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and texts become lower-case words. Of every WINDOW consecutive three-word grams of a template
the one with the smallest hash is a fingerprint, so any run of GRAM + WINDOW - 1 template words holds one;
a shorter template keeps its smallest. All three-word grams of a text are looked up in the inverted index
of fingerprints, so no such run is missed. Hits of a template close to one diagonal (text position minus
template position) are one candidate, and an alignment within BAND words of the diagonal gives the
largest number of template words found in order, and where they stand. Words put into a template or taken
out move what follows to another diagonal: neighbouring candidates up to SHIFT words (and half a template)
apart are also aligned together, in a band that covers them, and count where that finds more words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shotstream.llm.common import batched_texts, map_batches, mix, split_words
from shotstream.llm.license_texts import TEMPLATES

GRAM, WINDOW, BAND = 3, 3, 16
SHIFT = 64
COVERAGE = 0.8


class Index:
    """Words of the templates by number (0: any other word) and fingerprint -> (template, position)."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words = {name: split_words(templates[name].encode()) for name in self.names}
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words.values() for w in ws}), 1)}
        if len(self.vocabulary) >= 1 << 20:
            raise ValueError("too many different words in the templates")
        self.words = [np.array([self.vocabulary[w] for w in words[name]], np.int64) for name in self.names]
        places = defaultdict(list)
        for t, ids in enumerate(self.words):
            if len(ids) < GRAM:
                raise ValueError(f"template {self.names[t]} has fewer than {GRAM} words")
            codes = gram_codes(ids)
            hashes = mix(codes.astype(np.uint64))
            width = min(WINDOW, len(codes))
            chosen = {i + int(hashes[i : i + width].argmin()) for i in range(len(codes) - width + 1)}
            for i in sorted(chosen):
                places[int(codes[i])].append((t, i))
        self.codes = np.array(sorted(places), np.int64)
        self.places = [places[c] for c in self.codes.tolist()]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))


def gram_codes(ids: np.ndarray) -> np.ndarray:
    """A number for each GRAM words, -1 where one of them is in no template."""
    code, known = np.zeros(max(0, len(ids) - GRAM + 1), np.int64), np.ones(max(0, len(ids) - GRAM + 1), bool)
    for i in range(GRAM):
        part = ids[i : len(ids) - GRAM + 1 + i]
        code = (code << 20) | part
        known &= part > 0
    return np.where(known, code, -1)


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(words matched in order, first, last matched text position) of the best path on which the text
    position minus the template position stays within ``band`` of ``diagonal``. (0, -1, -1) if none."""
    n, width = len(template), 2 * band + 1
    table = np.zeros((n + 1, width + 1), np.int32)  # the last column stands for what lies outside
    for i in range(1, n + 1):
        at = i - 1 + diagonal - band + np.arange(width)  # text positions of the band's cells
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, np.int32)
        same[inside] = text[at[inside]] == template[i - 1]
        up = table[i - 1, 1 : width + 1]  # same text position, one template word less
        table[i, :width] = np.maximum.accumulate(np.maximum(table[i - 1, :width] + same, up))
    j = int(table[n, :width].argmax())
    best, i, first, last = int(table[n, j]), n, -1, -1
    while i > 0 and table[i, j] > 0:
        value = table[i, j]
        if j > 0 and table[i, j - 1] == value:
            j -= 1
        elif j + 1 < width and table[i - 1, j + 1] == value:
            i, j = i - 1, j + 1
        else:
            if table[i - 1, j] < value:  # a matched word
                first = i - 1 + diagonal - band + j
                last = max(last, first)
            i -= 1
    return best, first, last


def _aligned(words: np.ndarray, ids: np.ndarray, first: int, last: int, band: int) -> tuple[int, int, int]:
    """The best path around the diagonals ``first`` to ``last``, by position in the text."""
    middle, room = (first + last) // 2, max(band, BAND)
    low = max(0, middle - room)
    high = max(low, middle + len(words) + room)
    matched, start, end = align(words, ids[low:high], middle - low, band)
    return matched, start + low, end + low


def scan(ids: np.ndarray, index: Index, coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first, last word) of every occurrence, by template and position."""
    codes = gram_codes(ids)
    at = np.flatnonzero(codes >= 0)
    if not len(at) or not len(index.codes):
        return []
    slot = np.minimum(np.searchsorted(index.codes, codes[at]), len(index.codes) - 1)
    hit = index.codes[slot] == codes[at]
    diagonals = defaultdict(set)
    for position, s in zip(at[hit].tolist(), slot[hit].tolist()):
        for template, offset in index.places[s]:
            diagonals[template].add(position - offset)
    out = []
    for template in sorted(diagonals):
        words = index.words[template]
        spread = min(BAND, len(words) // 3)
        groups: list[list[int]] = []
        for d in sorted(diagonals[template]):
            if groups and d - groups[-1][0] <= spread:
                groups[-1].append(d)
            else:
                groups.append([d])
        alone = [_aligned(words, ids, group[0], group[-1], min(BAND, max(spread, 1))) for group in groups]
        tried = list(alone)
        reach, done = min(SHIFT, len(words) // 2), 0
        for start, group in enumerate(groups):
            end = start
            while end + 1 < len(groups) and groups[end + 1][-1] - group[0] <= reach:
                end += 1
            if end > start and end >= done:  # no part of the last set of neighbours
                done = end + 1
                last = groups[end][-1]
                together = _aligned(words, ids, group[0], last, (last - group[0]) // 2 + max(spread, 1))
                if together[0] > max(matched for matched, *_ in alone[start : end + 1]):
                    tried.append(together)
        found = [one for one in tried if one[0] >= coverage * len(words) - 1e-9]
        # Of overlapping finds the fullest, then the first, stays.
        taken: list[tuple[int, int, int]] = []
        for matched, first, last in sorted(found, key=lambda x: (-x[0], x[1])):
            if all(last < a or first > b for _, a, b in taken):
                taken.append((matched, first, last))
        out += [(template, *x) for x in sorted(taken, key=lambda x: x[1])]
    return out


def _scanner(handle, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = handle.value
        for batch, texts in batched_texts(batches):
            rows, found = [], []
            for row, text in enumerate(texts):
                for one in scan(index.numbers(split_words(text)), index, coverage):
                    rows.append(row)
                    found.append(one)
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            sizes = [len(words) for words in index.words]
            yield pa.record_batch(
                [
                    ids,
                    pa.array([index.names[t] for t, *_ in found], pa.string()),
                    pa.array([m / sizes[t] for t, m, _, _ in found], pa.float64()),
                    pa.array([m for _, m, _, _ in found], pa.int64()),
                    pa.array([a for _, _, a, _ in found], pa.int64()),
                    pa.array([b + 1 for _, _, _, b in found], pa.int64()),
                ],
                names=["doc_id", "license", "coverage", "n_matched", "start_word", "end_word"],
            )

    return run


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE
) -> DataFrame:
    """One row per occurrence of a template: doc_id, license, coverage, n_matched, start_word, end_word.

    ``coverage`` is the share of template words found in order; the span counts the text's words from 0,
    its end excluded. Null and empty texts have none; repeated rows are scanned each; other columns are
    left out. Overlapping occurrences of one template are reported once. Inserts and gaps of up to SHIFT words,
    and up to half the template, are bridged.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(templates))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs.select("doc_id", "text"), _scanner(index, coverage),
        f"doc_id {kind}, license string, coverage double, n_matched bigint, start_word bigint, end_word bigint",
    )
