"""Alignment of two tokenizers by galloping intersection of their token ends.

Both tokenizers cut the same bytes. The ends of one's tokens and of the other's are two ascending lists of byte offsets;
the shorter one drives a search of the longer, exponential steps until an end is bracketed and halving within the
bracket. Common ends slice both token sequences into groups, and differences of their ranks give each group's range of
tokens on either side. Within a group every token of one side is linked with every token of the other.

How many documents hold a pair of ids linked is counted over the whole corpus, from one row for each pair and document;
the counts come back to the documents by broadcast for pairs that many documents hold (HOT_PAIRS at most, as the rows they
have show) and by a shuffled join for all others.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taxospark.llm import bpe
from taxospark.llm.common import with_row, written

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are broadcast at most: those that hold at least one in so many of all rows of pairs.
HOT_PAIRS = 1 << 19
#: Characters of text that are encoded at a time, about, and link pairs that are spread out at a time.
BLOCK, SPREAD = 1 << 20, 1 << 22
STATS = ("n_a", "n_b", "n_groups", "n_links")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others for 256 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE of a tokenizer file; `data` has each id's bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet, vocabulary = byte_alphabet(), self.tokenizer.get_vocab()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.data = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.data[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        ranks = {self.data[i]: i for t, i in vocabulary.items() if t not in special}
        # ids in the order of the merges, as ranks must be, under the usual pattern; any other file goes through its own library
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        merged = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"])]
        usual = told.get("normalizer") is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": told["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
        if not all(self.data):
            raise ValueError("a token without bytes has no end of its own")
        self.ranked = None
        if usual and [vocabulary[t] for t in merged] == list(range(256, 256 + len(merged))) and len(ranks) == 256 + len(merged):
            # with a rank for every byte, ids spell any text
            self.ranked = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked:
            return [bpe.encode(t, self.ranked) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; `data` has each id's bytes."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.processor.get_piece_size())
        pieces = [self.processor.id_to_piece(i) for i in ids]
        self.data = [bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers; once per worker process."""
    return ByteLevel(a), Pieces(b)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of `short` its place in `long`, or -1 where it isn't there; both ascending, without repeats.

    All values gallop at once. Each starts where its share of the list lies, doubles its step, towards the side on which
    it must be, until it is bracketed, and halves the bracket.
    """
    m, n = len(short), len(long)
    if not m or not n:
        return np.full(m, -1, np.int64)
    low = np.arange(m, dtype=np.int64) * n // m
    ahead = long[low] <= short
    high = low + 1  # the last value <= short[i] is in low:high, or before them all where low is -1
    left, step = np.flatnonzero(ahead), 1
    while left.size:
        left = left[(high[left] < n) & (long[np.minimum(high[left], n - 1)] <= short[left])]
        low[left] = high[left]
        step *= 2
        high[left] = np.minimum(high[left] + step, n)
    left, step = np.flatnonzero(~ahead), 1
    while left.size:
        high[left] = low[left]
        low[left] = np.maximum(low[left] - step, -1)
        step *= 2
        left = left[(low[left] >= 0) & (long[np.maximum(low[left], 0)] > short[left])]
    left = np.flatnonzero(high - low > 1)
    while left.size:
        middle = (low[left] + high[left]) // 2
        over = long[middle] > short[left]
        high[left[over]] = middle[over]
        low[left[~over]] = middle[~over]
        left = left[high[left] - low[left] > 1]
    return np.where((low >= 0) & (long[np.maximum(low, 0)] == short), low, -1)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranks, in both ascending lists of ends, of the ends they share."""
    at = gallop(*((a, b) if len(a) <= len(b) else (b, a)))
    found = np.flatnonzero(at >= 0)
    return (found, at[found]) if len(a) <= len(b) else (at[found], found)


def spells(tokenizer: ByteLevel | Pieces, ids: list[int], data: bytes) -> bool:
    return b"".join([tokenizer.data[i] for i in ids]) == data


def spelt(size: int, inside: str, behind: str) -> np.ndarray:
    """Ids as text: id i with the mark that stands inside a run at i, with the one behind a run at size + i."""
    return np.array([f"{i}{mark}" for mark in (inside, behind) for i in range(size)], object)


def joined(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, text_a: np.ndarray, text_b: np.ndarray) -> str:
    """Groups as text: ids of one side, a bar, ids of the other, semicolons between groups. text_a, text_b: from `spelt`."""
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    group_a, group_b = np.repeat(np.arange(len(last_a)), size_a), np.repeat(np.arange(len(last_b)), size_b)
    out = np.empty(len(ids_a) + len(ids_b), object)
    ends_a, ends_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    ends_a[last_a], ends_b[last_b] = len(text_a) // 2, len(text_b) // 2
    out[np.arange(len(ids_a)) + np.concatenate([[0], last_b + 1])[group_a]] = text_a[ids_a + ends_a]
    out[np.arange(len(ids_b)) + (last_a + 1)[group_b]] = text_b[ids_b + ends_b]
    return "".join(out.tolist())[:-1]


def linked(ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (id of a * n_b + id of b) of the pairs linked in a text, ascending, and how often each is.

    Groups are spread out into their pairs some at a time; a group too large for that by its distinct ids.
    """
    first_a, first_b = np.concatenate([[0], last_a[:-1] + 1]), np.concatenate([[0], last_b[:-1] + 1])
    size_a, size_b = last_a + 1 - first_a, last_b + 1 - first_b
    pairs = size_a * size_b
    large = np.flatnonzero(pairs > SPREAD)
    small = np.flatnonzero(pairs <= SPREAD)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(pairs[small]) // SPREAD)) + 1):
        if len(part):
            group = np.repeat(part, pairs[part])
            at = np.arange(len(group)) - np.repeat(np.cumsum(pairs[part]) - pairs[part], pairs[part])
            codes = ids_a[first_a[group] + at // size_b[group]] * n_b + ids_b[first_b[group] + at % size_b[group]]
            found.append(np.unique(codes, return_counts=True))
    for g in large:
        a, times_a = np.unique(ids_a[first_a[g] : last_a[g] + 1], return_counts=True)
        b, times_b = np.unique(ids_b[first_b[g] : last_b[g] + 1], return_counts=True)
        found.append(((a[:, None] * n_b + b).ravel(), (times_a[:, None] * times_b).ravel()))
    if len(found) < 2:
        return found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    codes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    times = np.zeros(len(codes), np.int64)
    np.add.at(times, at, np.concatenate([f[1] for f in found]))
    return codes, times


def blocks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Runs of consecutive texts of about BLOCK characters together; null texts as empty ones."""
    block, size = [], 0
    for text in texts:
        block.append(text or "")
        size += len(block[-1])
        if size >= BLOCK or len(block) >= 1024:
            yield block
            block, size = [], 0
    if block:
        yield block


def code_type(a: str, b: str) -> str:
    """The type that holds a code of any pair of ids."""
    size = Tokenizer.from_file(a).get_vocab_size() * sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    return "int" if size < 2**31 else "long"


def groups(docs: DataFrame, row: str, a: str | None = None, b: str | None = None) -> DataFrame:
    """Alignment of every text: doc_id, row, n_a, n_b, n_groups, n_links, groups_sha256, and its linked pairs as arrays `pairs` (codes) and `times`.

    The texts are encoded without special tokens, whose strings are plain text: by the byte-level file `a` with a space
    before them, by the sentencepiece model `b` as they are, which puts the space there itself. A null or empty text, and
    one that the tokens of either don't spell (a normalised or dropped character), has no tokens: zeros, no pairs and ''.
    """
    a, b = a or public_tokenizers.path(BYTE_LEVEL), b or public_tokenizers.path(PIECES)
    longs = [*STATS]
    # codes of these vocabularies fit 32 bits, and take half the room
    code = pa.int32() if code_type(a, b) == "int" else pa.int64()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokenizers(a, b)
        size_a, size_b = (np.array([*map(len, t.data)], np.int64) for t in (first, second))
        text_a, text_b = spelt(len(size_a), ",", "|"), spelt(len(size_b), ",", ";")
        for batch in batches:
            at = 0
            for texts in blocks(x.as_py() for x in batch.column(2)):
                out = []
                spaced = [" " + t if t else "" for t in texts]
                for text, x, y in zip(spaced, first.encode(spaced), second.encode(texts)):
                    data = text.encode("utf-8", "surrogatepass")
                    if not text or not (first.ranked or spells(first, x, data)) or not spells(second, y, data):
                        out.append((0, 0, 0, 0, "", [], []))
                        continue
                    x, y = np.array(x, np.int64), np.array(y, np.int64)
                    last_a, last_b = common_ends(np.cumsum(size_a[x]), np.cumsum(size_b[y]))
                    codes, times = linked(x, y, last_a, last_b, len(size_b))
                    digest = hashlib.sha256(joined(x, y, last_a, last_b, text_a, text_b).encode()).hexdigest()
                    out.append((len(x), len(y), len(last_a), int(times.sum()), digest, codes, times))
                columns = list(zip(*out))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(code), pa.list_(pa.int32())]
                ids = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", row, *longs, "groups_sha256", "pairs", "times"])
                at += len(texts)

    schema = f"doc_id long, `{row}` long, {', '.join(f'{c} long' for c in longs)}, groups_sha256 string, pairs array<{code_type(a, b)}>, times array<int>"
    return docs.select(F.col("doc_id").cast("long"), row, "text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best) of all documents' linked pairs: in how many documents, and whether no other pair of its first id is in more."""
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "align-counts")
    first = F.expr(f"pair div {n_b}").alias("a")
    highest = counts.groupBy(first).agg(F.max("n").alias("highest"))
    return counts.withColumn("a", first).join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair is in as many documents as any of its first id's (ties all count); count_sum: documents that
    hold a link's pair, summed over links. Null and empty texts, and those that the tokens don't spell, have zeros and ''.
    Rows that repeat a doc_id, or have none, give a row each and count as documents each. Columns but doc_id and text are
    not read, so they may have any name. An empty table gives no rows.
    """
    a, b = a or public_tokenizers.path(BYTE_LEVEL), b or public_tokenizers.path(PIECES)
    n_b = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    aligned = written(groups(with_row(docs, "_align_row", ["doc_id", "text"]), "_align_row", a, b), "align-groups")
    counts = written(pair_counts(aligned, n_b), "align-pairs")
    total = aligned.agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0))).first()[0]
    links = aligned.select("_align_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_align_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    # at most HOT_PAIRS pairs can have a row in HOT_PAIRS of all rows
    is_hot = (F.col("n") * HOT_PAIRS >= F.lit(total)) & (F.col("n") > 1)
    told = links.join(F.broadcast(counts.filter(is_hot)), "pair", "left")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    often = told.filter("n is not null").groupBy("_align_row").agg(*sums)
    rare = told.filter("n is null").select("_align_row", "pair", "times").join(counts.filter(~is_hot).hint("merge"), "pair").groupBy("_align_row").agg(*sums)
    both = often.unionByName(rare).groupBy("_align_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = aligned.drop("pairs", "times").join(both, "_align_row", "left")
    return found.select("doc_id", *STATS, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
