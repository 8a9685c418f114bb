"""Substring deduplication over sliding sentence spans.

A sentence of more than LONG words is cut further, at word boundaries that its own words choose: of each WINDOW
consecutive boundaries inside it, that with the smallest hash of the words beside it. A cut depends on fewer than WINDOW
words to either side, so that two copies of a passage of more than 50 words have spans in common, wherever they stand in
a sentence. In what follows such pieces count as sentences. In scripts without white space each character is a word.

A span is a run of consecutive sentences, at least SENTENCES of them with at least WORDS words together and as short as
that allows; one starts and one ends at every sentence. All spans of the corpus are hashed and compared; of equal spans
the first by (doc_id, row, place) stays, and the sentences of every other are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxospark.llm.common import free_name, mapped, quoted, with_row, written

SENTENCES, WORDS = 2, 20
#: Of a passage of more than 50 words both ends may lie in sentences that only one copy cuts, LONG words each; that leaves
#: WORDS or more. Within one sentence 4 * WINDOW + WORDS - 3 boundaries are enough.
LONG, WINDOW = 15, 8
CLOSING = "[\"'\u2019\u201d\u00bb)\\]}\u300d\u300f\u3011\uff09]*"
#: Marks that end a sentence before white space, marks that always do, and line ends.
MARKS, WIDE_MARKS = ".!?\u2026", "\u3002\uff01\uff1f\uff0e\uff61\u0964\u0965\u061f\u06d4\u0589\u1362"
END = re.compile(f"[{MARKS}{WIDE_MARKS}\n](?:(?<=[{MARKS}])[{MARKS}]*{CLOSING}\\s+|(?<=[{WIDE_MARKS}])[{WIDE_MARKS}]*{CLOSING}\\s*|(?<=\n)\\s*)")
#: Thai to Myanmar, Khmer, CJK with kana and full-width forms: written without white space.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fff\u3001-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff9f\U00020000-\U0003ffff"
#: Words whose codes a worker remembers, some 150 bytes a word; workers outlive their stage.
MEMORY = 1 << 17
#: Bytes of rows that sentences are taken out of at once.
SLICE = 4 << 20
WIDE = re.compile(f"[{UNSPACED}]")
SPACED_WORD, WORD = re.compile(r"\s*\S+\s*"), re.compile(f"\\s*(?:[{UNSPACED}]|[^\\s{UNSPACED}]+)\\s*")


class Codes(dict):
    """A word's code, found when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = code = crc32(word.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        return code


CODES = Codes()


def cuts(words: list[str]) -> list[int]:
    """Where a long sentence of these lower-case words is cut: behind each word at whose boundary some WINDOW consecutive ones have their smallest hash."""
    own = [CODES[w] for w in words]
    mixed = [(a ^ b >> 17) & 0xFFFFFFFFFF for a, b in zip(own, own[1:])]
    least = mixed.index(min(mixed[:WINDOW]))
    found = [least + 1]
    for at in range(WINDOW, len(mixed)):
        if mixed[at] < mixed[least]:
            least = at
        elif least <= at - WINDOW:
            least = mixed.index(min(mixed[at - WINDOW + 1 : at + 1]), at - WINDOW + 1)
        else:
            continue
        found.append(least + 1)
    return found


def cut_up(text: str) -> list[str]:
    """The text in sentences, before long ones are cut."""
    ends = [0, *(m.end() for m in END.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(ends, ends[1:]) if a < b]


def is_wide(text: str) -> bool:
    return not text.isascii() and WIDE.search(text) is not None


def plain_sentences(text: str | None) -> tuple[list[str], list[int]]:
    """Of each of the text's sentences, long ones in pieces: its lower-case words with single spaces, and their number."""
    text = text or ""
    wide = is_wide(text)
    plain: list[str] = []
    sizes: list[int] = []
    for sentence in cut_up(text):
        low = sentence.lower()
        words = [w.strip() for w in WORD.findall(low)] if wide else low.split()
        at = 0
        for end in [*(cuts(words) if len(words) > LONG else ()), len(words)]:
            plain.append(" ".join(words[at:end]))
            sizes.append(end - at)
            at = end
    return plain, sizes


def sentences(text: str | None) -> list[str]:
    """The text's sentences, long ones in pieces, as they stand, with the white space behind them. Joined they are the text."""
    text = text or ""
    spaced = WORD if is_wide(text) else SPACED_WORD
    out: list[str] = []
    for sentence in cut_up(text):
        words = spaced.findall(sentence)
        if len(words) <= LONG:
            out.append(sentence)
            continue
        ends = cuts([w.strip().lower() for w in words])
        out += ["".join(words[a:b]) for a, b in zip([0, *ends], [*ends, len(words)])]
    return out


def spans(words: list[int], least_sentences: int, least_words: int) -> list[tuple[int, int]]:
    """(first, end) of the spans over sentences with so many words each."""
    total = [0, *accumulate(words)]
    found, end, first, n = [], 0, 0, len(words)
    for start in range(n):  # the shortest that start here
        end = max(end, start + least_sentences)
        least = total[start] + least_words
        while end <= n and total[end] < least:
            end += 1
        if end > n:
            break
        found.append((start, end))
    for stop in range(least_sentences, n + 1):  # the shortest that end here
        most = total[stop] - least_words
        while first + 1 <= stop - least_sentences and total[first + 1] <= most:
            first += 1
        if total[first] <= most:
            found.append((first, stop))
    return sorted(set(found))


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE bytes on average at most, and of one row at least."""
    for b in batches:
        step = max(1, b.num_rows * SLICE // max(SLICE, b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def hashed_spans(docs: DataFrame, row: str, least_sentences: int = SENTENCES, least_words: int = WORDS) -> DataFrame:
    """(doc_id, row, first, end, h, check): every span of every whole text, by a 96-bit hash of its lower-case words. A null doc_id is the largest long, so it comes last."""
    names = ["doc_id", "row", "first", "end", "h", "check"]
    kind = np.dtype([("h", ">i8"), ("check", ">i4"), ("rest", ">i4")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, rows = (c.to_numpy(zero_copy_only=False) for c in b.columns[1:])
            owner: list[int] = []
            places: list[tuple[int, int]] = []
            hashes: list[bytes] = []
            for k, text in enumerate(b.column(0)):
                plain, sizes = plain_sentences(text.as_py())
                found = spans(sizes, least_sentences, least_words)
                hashes += [xxhash.xxh3_128_digest(" ".join(plain[i:j])) for i, j in found]
                places += found
                owner.append(len(found))
                if len(places) > 100_000 or k + 1 == b.num_rows and places:
                    who = np.repeat(np.arange(k + 1 - len(owner), k + 1), owner)
                    data, at = np.frombuffer(b"".join(hashes), kind), np.array(places, np.int32)
                    columns = [docs[who], rows[who], at[:, 0], at[:, 1], data["h"].astype(np.int64), data["check"].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
                    owner, places, hashes = [], [], []

    known = docs.filter("text is not null").select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), F.col(row).cast("long"))
    return known.mapInArrow(run, "doc_id long, row long, first int, end int, h long, check int")


def repeated(docs: DataFrame, row: str, least_sentences: int = SENTENCES, least_words: int = WORDS) -> DataFrame:
    """(row, spans): for each row with such, its spans that aren't the first of their kind.

    Spans whose first 64 bits no other has are most of them; they leave after a count of those bits alone, which is
    partial before it is shuffled. Whole hashes and places are then compared among the others only. Partial aggregation
    leaves one row per span and task, so a passage in a third of the documents is no hot key of a count; in a join it is
    one, but both sides come from files by exchanges of their own, which adaptive execution can split.
    """
    found = written(hashed_spans(docs, row, least_sentences, least_words), "spans")
    twice = written(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "spans-twice")
    some = written(found.join(twice, "h", "left_semi"), "spans-candidates")
    place = F.struct("doc_id", "row", "first", "end")
    first = some.groupBy("h", "check").agg(F.min(place).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = some.join(written(first, "spans-first"), ["h", "check"]).filter(place != F.col("kept"))
    return again.groupBy("row").agg(F.collect_set(F.struct("first", "end")).alias("spans"))


def dedup(docs: DataFrame, least_sentences: int = SENTENCES, least_words: int = WORDS, row: str | None = None, removed: str = "n_removed") -> DataFrame:
    """docs with the repeated sentences taken out of text, and `removed`, how many, beside their other columns.

    One row per row of docs. Sentences are equal when their lower-case words are. The first of equal spans is that with
    the smallest (doc_id, row, place); null ids come last. Each row is compared by itself: of rows that repeat a doc_id
    with the same text the first keeps its sentences, and with other texts each loses its own. A null text stays null,
    and a text all of whose sentences go is left empty. `row` names a column of longs, without nulls, that tells rows
    apart; without it they are told apart by their places in files. A column of docs named like `removed` is replaced. An empty table
    gives no rows.
    """
    if row is None:
        row = free_name(docs, "_row")
        return dedup(with_row(docs, row), least_sentences, least_words, row, removed).drop(quoted([row])[0])
    docs = docs.select(*quoted(c for c in docs.columns if c.lower() != removed.lower()))
    key, found = free_name(docs, "_key"), free_name(docs, "_spans")
    again = repeated(docs, row, least_sentences, least_words).select(F.col("row").alias(key), F.col("spans").alias(found))
    both = docs.join(again, F.col(row) == F.col(key), "left").drop(key)
    out = docs.select(*quoted(docs.columns), F.lit(0).cast("long").alias(removed)).schema
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, gone = [], []
            for text, found in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                drop = {k for s in found or () for k in range(s["first"], s["end"])}
                texts.append("".join(u for k, u in enumerate(sentences(text)) if k not in drop) if drop else text)
                gone.append(len(drop))
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int64())], [f"c{i}" for i in range(len(out))])

    return mapped(both, run, out)
