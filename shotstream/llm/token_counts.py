"""Token counts that follow edits.

A document is a row of pre-tokens with a segment tree over them that sums their lengths and their token
counts. An edit finds its place by descending the tree over lengths, cuts the touched pre-tokens and the
boundary context anew, encodes only those, and updates the sums on the way to the root.

Where cutting restarts: the pattern looks at most two characters past the end of a pre-token, so
pre-tokens that end three characters before the edit stay. Where it stops: cutting depends only on the
text that follows, so once a new pre-token ends where an old one ended, behind the edit, the rest stays.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from shotstream.llm.common import batched_texts, map_batches

RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the cutting pattern the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REACH = 3
REMEMBERED_BYTES = 32 << 20

Edit = tuple[int, int, str]
NUMBER = regex.compile(r"(?<!\d)(?:\d[ -]?){7,}\d(?!\d)")
DOMAIN = regex.compile(r"@[\w-]+(?:\.[\w-]+)+")
LOCAL = regex.compile(r"(?r)[\w.+-]*+")  # read backwards from the @


def private_spans(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is it an address) of e-mail addresses and numbers of eight or more digits, leftmost first.

    Addresses are found from their @ in both directions, so every character is read a few times at most.
    """
    number, at = NUMBER.search(text), 0
    for domain in DOMAIN.finditer(text):
        begin = LOCAL.match(text, 0, domain.start()).start()
        while number and number.start() < max(begin, at):
            if number.start() >= at:
                yield number.start(), number.end(), False
                at = number.end()
            number = NUMBER.search(text, max(at, number.start()))
        if max(begin, at) < domain.start():
            yield max(begin, at), domain.end(), True
            at = domain.end()
    while number:
        if number.start() >= at:
            yield number.start(), number.end(), False
            at = number.end()
        number = NUMBER.search(text, max(at, number.start()))


def redactions(text: str) -> list[Edit]:
    """Edits that replace e-mail addresses and numbers of eight or more digits by a placeholder. Each
    edit's offsets count in the text that the earlier ones leave."""
    edits, shift = [], 0
    for start, end, address in private_spans(text):
        new = "[email]" if address else "[number]"
        edits.append((start + shift, end + shift, new))
        shift += len(new) - (end - start)
    return edits


class TokenCounter:
    """Token counts of pre-tokens, remembered up to a number of bytes."""

    def __init__(self, ranks: bytes):
        pairs = (line.split() for line in ranks.splitlines())
        self.encoding = tiktoken.Encoding(
            "pieces", pat_str=PATTERN, special_tokens={},
            mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs},
        )
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.bytes = 0

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        if self.bytes > REMEMBERED_BYTES:
            known.clear()
            self.bytes = 0
        new = {part for part in parts if part not in known}
        if new:
            fresh = list(new)
            self.bytes += sum(4 * len(part) + 120 for part in fresh)
            known.update(zip(fresh, map(len, map(self.encoding.encode_ordinary, fresh))))
        return [known[part] for part in parts]


class CountedText:
    """The tree of one document. ``total`` is its token count; ``recounted`` the pre-tokens that edits
    have encoded again."""

    def __init__(self, text: str, counter: TokenCounter):
        self.counter = counter
        parts = counter.cut(text)
        self.leaves: list[list[str]] = [[part] for part in parts]
        self.recounted = 0
        size = 1 << max(0, len(parts) - 1).bit_length()
        self.size = size
        tree = np.zeros((2, 2 * size), np.int64)  # row 0: code points, row 1: tokens
        tree[0, size : size + len(parts)] = list(map(len, parts))
        tree[1, size : size + len(parts)] = counter.counts(parts)
        while size > 1:
            tree[:, size // 2 : size] = tree[:, size : 2 * size : 2] + tree[:, size + 1 : 2 * size : 2]
            size //= 2
        self.tree = tree

    @property
    def length(self) -> int:
        return int(self.tree[0, 1])

    @property
    def total(self) -> int:
        return int(self.tree[1, 1])

    def text(self) -> str:
        return "".join(part for leaf in self.leaves for part in leaf)

    def _find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character at ``offset``, and the offset at which it begins."""
        node, begin = 1, 0
        while node < self.size:
            left = int(self.tree[0, 2 * node])
            if offset < begin + left:
                node = 2 * node
            else:
                node, begin = 2 * node + 1, begin + left
        return node - self.size, begin

    def _set(self, leaf: int, parts: list[str], tokens: int) -> None:
        self.leaves[leaf] = parts
        node = self.size + leaf
        self.tree[:, node] = (sum(map(len, parts)), tokens)
        while node > 1:
            node //= 2
            self.tree[:, node] = self.tree[:, 2 * node] + self.tree[:, 2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the code points from ``start`` up to ``end`` by ``new``; offsets beyond the text are
        its end."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        if not self.leaves:
            self.leaves = [[]]
        first, begin = self._find(max(0, start - REACH)) if self.length else (0, 0)
        first = min(first, len(self.leaves) - 1)
        last = min(self._find(end)[0], len(self.leaves) - 1) if end < self.length else len(self.leaves) - 1
        while True:
            old = "".join(part for leaf in self.leaves[first : last + 1] for part in leaf)
            changed = old[: start - begin] + new + old[end - begin :]
            ahead = ""  # what the pattern may look at past the last leaf
            for leaf in self.leaves[last + 1 :]:
                ahead += "".join(leaf)
                if len(ahead) >= REACH:
                    break
            parts, at = [], 0
            for part in self.counter.cut(changed + ahead):
                if at >= len(changed):
                    break
                parts.append(part)
                at += len(part)
            if at == len(changed) or last == len(self.leaves) - 1:
                break
            last = min(len(self.leaves) - 1, last + max(1, last - first))
        tokens = sum(self.counter.counts(parts))
        self.recounted += len(parts)
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, [], 0)
        self._set(first, parts, tokens)


def _counting(ranks_handle, editor: Callable[[str], Iterable[Edit]]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(ranks_handle.value)
        for batch, texts in batched_texts(batches):
            before, edits, after, again, digests = [], [], [], [], []
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                counted = CountedText(text, counter)
                before.append(counted.total)
                n = 0
                for n, change in enumerate(editor(text), 1):
                    counted.edit(*change)
                edits.append(n)
                after.append(counted.total)
                again.append(counted.recounted)
                digests.append(counted.text() if n else text)
            numbers = [pa.array(x, pa.int64()) for x in (before, edits, after, again)]
            yield pa.record_batch(
                [batch.column("doc_id"), *numbers, pa.array(digests, pa.string())],
                names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_recounted", "edited_text"],
            )

    return count


def count_tokens(
    docs: DataFrame, editor: Callable[[str], Iterable[Edit]] = redactions, ranks_file: str = RANKS_FILE
) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_edits, n_tokens_edited, n_recounted, edited_text.

    ``editor`` gives the edits (start, end, new text) of a text, applied in their order. Null and empty
    texts have no tokens; repeated rows are counted each; other columns are left out. The vocabulary is
    read on the driver and sent to the executors; its size does not depend on the data.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Path(ranks_file).read_bytes())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        docs.select("doc_id", "text"), _counting(ranks, editor),
        f"doc_id {kind}, n_tokens bigint, n_edits bigint, n_tokens_edited bigint, n_recounted bigint, edited_text string",
    )
