"""Packing into training sequences by vector bin packing.

A sequence has limits on tokens, on segments and on loss-bearing tokens. The dot-product heuristic fills one sequence at
a time from a window of waiting examples: of those that fit, it takes the one whose demands, each as a share of its
limit, have the largest dot product with what is left of the limits. Each task packs its own partition, so nothing is
shuffled and no task waits for another; a sequence's id has the partition in its high bits.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer


TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Examples that wait in a task at most, before sequences are filled.
WINDOW = 256
#: Words in each of the two tables of ids that a worker remembers, some 200 bytes a word; workers outlive their stage.
MEMORY = 1 << 17
#: Lowered texts of other characters only are split into words here, where the tokenizer's normal form is plain lower case.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]")
LETTERS, DIGITS = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(f"[{LETTERS}]+|[{DIGITS}]|'(?:s|t|re|ve|m|ll|d)|[^\t\n\r {LETTERS}{DIGITS}]+")


@dataclass(frozen=True)
class Limits:
    """Of one sequence: tokens, segments and loss-bearing tokens."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], float)


def byte_characters() -> dict[int, str]:
    """The characters that byte-level tokenizers take for bytes, by the bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


BYTES = byte_characters()


class WordIds(dict):
    """Ids of texts through the ids of their words, which the tokenizer's model makes one by one; the bytes are little-endian 32-bit ids.

    When MEMORY words are known they become the older ones, in place of those that were; an older word that comes again is taken
    over, so words in use aren't made anew.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Strings that the tokenizer takes for one token wherever they stand.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.older: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: Iterable[str]) -> None:
        if len(self) > MEMORY:
            self.older = dict(self)
            self.clear()
        older, tokens = self.older.get, self.model.tokenize
        for w in words:
            if (known := older(w)) is None:
                ids = [t.id for t in tokens(w if w.isascii() else w.encode().decode("latin-1").translate(BYTES))]
                known = struct.pack(f"<{len(ids)}I", *ids)
            self[w] = known

    def encode(self, text: str | None) -> bytes:
        low = (text or "").lower()
        if PLAIN.search(low) or any(t in text for t in self.added if t in low):
            return self.ids(text).tobytes()
        words = PIECE.findall(low)
        found = list(map(self.get, words))
        if None in found:
            new = [i for i, x in enumerate(found) if x is None]
            self.learn({words[i] for i in new})
            for i in new:
                found[i] = self[words[i]]
        return b"".join(found)

    def __missing__(self, word: str) -> bytes:
        return self.ids(word).tobytes()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@dataclass
class Filler:
    """The waiting examples of a task, and the sequences filled from them."""

    limits: Limits
    cut: bool
    items: list = field(default_factory=list)
    demand: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))

    def add(self, items: list, demand: list[tuple[float, float, float]]) -> None:
        if items:
            self.items += items
            self.demand = np.vstack([self.demand, np.array(demand, float)])

    def take(self, k: int):
        self.demand = np.delete(self.demand, k, 0)
        return self.items.pop(k)

    def fill(self) -> tuple[list, np.ndarray]:
        """One sequence's items, and what is left of the limits."""
        whole = self.limits.vector()
        left, got = whole.copy(), []
        while len(self.items) and left.min() > 0:
            if self.cut and left[1] == 1 and (self.demand[:, 0] > left[0]).any():
                break  # the last segment is cut to measure
            fits = (self.demand <= left).all(1)
            if not fits.any():
                break
            k = int(np.where(fits, (self.demand / whole) @ (left / whole), -1).argmax())
            left -= self.demand[k]
            got.append(self.take(k))
        return got, left


Piece = tuple[int, int, bytes, int]  # doc_id, start, ids, tokens of the document


def split(piece: Piece, at: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * at], total), (doc, start + at, ids[4 * at :], total)


def sequences(pieces: Iterable[Piece | None], limits: Limits) -> Iterator[list[Piece]]:
    """Packs a task's documents, cut where a sequence has room for a part; None marks the end of a batch.

    Sequences are filled to the token limit unless the segment limit is met first by documents too short to fill them.
    Those, and what is left at the end, are cut into powers of two, which need no padding.
    """
    filler = Filler(limits, cut=True)
    most = min(limits.tokens, limits.loss)

    def filled() -> list[Piece]:
        got, left = filler.fill()
        room = int(min(left[0], left[2]))
        if room and left[1] >= 1 and len(filler.items):
            k = int(filler.demand[:, 0].argmax())
            if filler.demand[k, 0] > room:
                head, tail = split(filler.items[k], room)
                filler.items[k] = tail
                filler.demand[k] -= (room, 0, room)
                got.append(head)
        return got

    for piece in pieces:
        if piece is not None:
            while len(piece[2]) >= 4 * most:
                head, piece = split(piece, most)
                yield [head]
            if piece[2]:
                n = len(piece[2]) // 4
                filler.add([piece], [(n, 1, n)])
        while len(filler.items) >= WINDOW:
            yield from whole(filled(), most)
    while filler.items:
        yield from whole(filled(), most)


def whole(got: list[Piece], most: int) -> Iterator[list[Piece]]:
    """The pieces as one sequence if they fill it, else cut into sequences of powers of two."""
    n = sum(len(p[2]) // 4 for p in got)
    if n == most:
        yield got
        return
    while n:
        size, part = 1 << (n.bit_length() - 1), []
        n -= size
        while size:
            piece = got.pop(0)
            if len(piece[2]) > 4 * size:
                piece, rest = split(piece, size)
                got.insert(0, rest)
            part.append(piece)
            size -= len(piece[2]) // 4
        yield part


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, limits: Limits = Limits(), tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the tokenizer's ids of its whole text (null: empty), then END_ID; all its tokens bear loss. Pieces lie
    in a sequence without gaps from offset 0. Rows that repeat a doc_id are packed each. Columns but doc_id and text are
    not read. An empty table gives no rows.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base = word_ids(path), TaskContext.get().partitionId() << 33

        def pieces() -> Iterator[Piece]:
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                    ids = known.encode(text.as_py()) + end
                    yield doc, 0, ids, len(ids) // 4

        rows: list[tuple] = []
        for k, got in enumerate(sequences(pieces(), limits)):
            at = 0
            for doc, start, ids, total in got:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, base + k, at))
                at += n
            if len(rows) >= 4096:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Whole examples (example_id, tokens, segments, loss) to sequences: example_id, sequence_id, position.

    An example over a limit by itself gets a sequence of its own. A null demand counts as 0, and so does a negative one.
    Rows that repeat an example_id are packed each. Other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler, made = Filler(limits, cut=False), TaskContext.get().partitionId() << 33

        def closed(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows: list[tuple] = []
            while len(filler.items) > least:
                got, _ = filler.fill()
                got = got or [filler.take(0)]
                rows += [(x, made, i) for i, x in enumerate(got)]
                made += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["example_id", "sequence_id", "position"])

        for b in batches:
            ids, *demands = (c.to_pylist() for c in b.columns)
            filler.add(ids, [tuple(max(0, x or 0) for x in d) for d in zip(*demands)])
            yield from closed(WINDOW)
        yield from closed(0)

    columns = [F.col(c).cast("long") for c in ("example_id", "tokens", "segments", "loss")]
    return examples.select(*columns).mapInArrow(run, "example_id long, sequence_id long, position long")
