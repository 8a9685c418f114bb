"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of the bytes that follow each context of up to ORDER bytes. The cost of a byte is its
code length in bits under method C: in the longest context known to the language the byte itself has n / (total + kinds)
and the escape to the next shorter context kinds / (total + kinds); below order 0 all 256 bytes are alike. Statistics are
frozen after training. A tree is kept whole, as sorted arrays of its contexts and of the bytes seen in them, so code
lengths are exact; a text's is a sum of look-ups over all its bytes. The language with the shortest code is predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxospark.llm.common import is_fold, written

#: Bytes of a context at most; 7 at most, for a context and its next byte are one 64-bit number.
ORDER = 3
#: Training documents for each language at most, those with the smallest hash of their id.
SAMPLE = 2000
#: What may be a letter; str.isalpha tells (category L), for this has numerals like one half too.
MAYBE = re.compile(r"[^\W\d_]")
#: Bytes scored at once, but for a longer text.
BLOCK = 1 << 21
FOLDED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in MAYBE.finditer(text or ""))


def data_of(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """All texts as one array of bytes, A-Z lowered, each behind `order` spaces."""
    return FOLDED[np.frombuffer(b"".join(b" " * order + t for t in texts), np.uint8)]


def strings(data: np.ndarray, length: int, order: int = ORDER) -> np.ndarray:
    """The number that the `length` bytes up to each place are, from place `order` on."""
    n = max(0, len(data) - order)
    code = np.zeros(n, np.uint64)
    for back in range(length - 1, -1, -1):
        code = code << np.uint64(8) | data[order - back : order - back + n].astype(np.uint64)
    return code


@dataclass
class Level:
    """The contexts of one length in one language: those with the next byte, with bits of that byte, and contexts, with bits of the escape; both sorted."""

    pairs: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray, n: np.ndarray) -> Level:
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order].astype(float)
        contexts, which = np.unique(pairs >> np.uint64(8), return_inverse=True)
        kinds = np.bincount(which, minlength=len(contexts))
        whole = np.bincount(which, n, len(contexts)) + kinds
        return cls(pairs, np.log2(whole[which] / n), contexts, np.log2(whole / kinds))


def place(of: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the elements are in a sorted array, and whether they are."""
    if not len(among):
        return np.zeros(len(of), np.int64), np.zeros(len(of), bool)
    at = np.minimum(np.searchsorted(among, of), len(among) - 1)
    return at, among[at] == of


@dataclass
class Model:
    langs: list[str]
    trees: list[list[Level]]  # of each language, by length of context
    order: int = ORDER

    def costs(self, strings: np.ndarray, lang: int) -> np.ndarray:
        """Bits of the last byte of each string of order + 1 bytes in its context."""
        out = np.zeros(len(strings))
        open_ = np.arange(len(strings))
        for k in range(self.order, -1, -1):
            level = self.trees[lang][k]
            pair = strings[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            at, seen = place(pair, level.pairs)
            out[open_[seen]] += level.bits[at[seen]]
            open_, pair = open_[~seen], pair[~seen]
            at, known = place(pair >> np.uint64(8), level.contexts)
            out[open_[known]] += level.escape[at[known]]
        out[open_] += 8
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text (row) in each language (column)."""
        out = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= BLOCK:
                size, end = size + len(texts[end]), end + 1
            part = texts[at:end]
            data = data_of(part, self.order)
            sizes = np.array([len(t) for t in part])
            own = np.repeat(np.arange(len(part)), sizes)
            # places of the texts' own bytes among all but the first `order`
            inside = np.arange(sizes.sum()) + own * self.order
            kinds, which = np.unique(strings(data, self.order + 1, self.order)[inside], return_inverse=True)
            for k in range(len(self.langs)):
                out[at:end, k] = np.bincount(own, self.costs(kinds, k)[which], len(part))
            at = end
        return out


def train(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> Model | None:
    """The context trees of docs(doc_id, text, lang); None if there is nothing to learn from.

    Learns from `sample` documents of each language, an id that several rows have by the least of their texts, so a tree's size doesn't depend on the input's; Spark counts, and
    the trees, which every task needs, come to the driver.
    """
    pick = Window.partitionBy("lang").orderBy("_hash", "doc_id")
    known = docs.filter("lang is not null and text is not null and doc_id is not null").withColumn("_hash", F.xxhash64("doc_id"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    # only documents whose hash is below a bound that all but surely keeps enough of a language are ranked, by id alone
    share = (F.lit(sample) + 10 * F.sqrt(F.lit(float(sample))) + 100) / F.col("n")
    bound = F.when(share >= 1, F.lit(2.0**63)).otherwise(share * 2.0**64 - 2.0**63).alias("_bound")
    ranked = known.select("doc_id", "lang", "_hash").join(F.broadcast(sizes.select("lang", bound)), "lang").filter("_hash <= _bound")
    ids = ranked.select("doc_id", "lang", F.row_number().over(pick).alias("_rank")).filter(F.col("_rank") <= sample)
    ids = written(ids.select("doc_id", "lang").distinct(), "langid-sample")  # at most `sample` for each language
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    # a row for each id, however many it has
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, all_texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                part = [t.encode() for t, x in zip(all_texts, langs) if x == lang]
                data = data_of(part, order)
                size = np.array([len(t) for t in part])
                inside = np.arange(size.sum()) + np.repeat(np.arange(len(part)), size) * order
                for k in range(order + 1):
                    pairs, n = np.unique(strings(data, k + 1, order)[inside], return_counts=True)
                    columns = [pa.array([lang] * len(pairs), pa.string()), pa.array(np.full(len(pairs), k)), pa.array(pairs.view(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "k", "pair", "n"])

    found = texts.mapInArrow(count, "lang string, k long, pair long, n long").groupBy("lang", "k", "pair").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(r["lang"] for r in ids.select("lang").distinct().collect())
    if not langs:
        return None
    lang, k, pair, n = found["lang"].to_pandas().to_numpy(), found["k"].to_numpy(), found["pair"].to_numpy().view(np.uint64), found["n"].to_numpy()
    which = np.searchsorted(np.array(langs, object), lang) if len(lang) else np.zeros(0, np.int64)
    trees = [[Level.of(pair[mine], n[mine]) for j in range(order + 1) for mine in [(which == i) & (k == j)]] for i in range(len(langs))]
    return Model(langs, trees, order)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) with lang_pred and score, the posterior of that language under equal priors."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = b.column(1).to_pylist()
            known = np.array([m is not None and has_letter(t) for t in texts], bool)
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if known.any():
                bits = m.bits([t.encode() for t, k in zip(texts, known) if k])
                lang[known] = np.array(m.langs, object)[bits.argmin(1)]
                with np.errstate(under="ignore"):
                    score[known] = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from text and lang of the documents outside the held-out fold, then predicts from the text alone. A null text
    and one without a letter (Unicode category L) are `und` with score 0, as all are when there is nothing to learn from.
    Equal code lengths go to the first language by name. A null doc_id is not learned from and counts as not held out.
    Rows that repeat a doc_id give a row each. Columns but doc_id, text and lang are not read. An empty table gives no rows.
    """
    held_out: Column = is_fold(F.col("doc_id"), folds, held)
    model = train(docs.select("doc_id", "text", "lang").filter(~held_out), sample)
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
