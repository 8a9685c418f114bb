"""Toxicity by class-conditional Kneser-Ney models.

Two character models, of toxic and of ordinary documents, give the probability of each character of a text after the
ORDER - 1 before it, across words. Both are interpolated and use absolute discounts D between 0 and 1, from the counts of
counts. Of the longest history a class has its own counts,

    P(x | h, class) = max(n(hx) - D, 0) / n(h) + D * kinds(h) / n(h) * P(x | h'),

and P(x | h'), for the history without its first character, is shared by both: Kneser-Ney estimates from continuation
counts, in how many histories of either class the sequence occurs, down to single characters and then to all known ones
alike. So what a class never showed after a history has a likelihood that its rare mass and the shared counts decide.

A text's score is a logistic curve over two length-normalised log-likelihood ratios: that of the whole text for each
character, and that of its STRONGEST words for each word, since a toxic document may be ordinary but for a few
expressions. The curve is fitted on documents that the models didn't count.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxospark.llm.common import is_fold, known_labels, labelled, logistic_over, written

#: Characters of a sequence, the last and those before it; fewer if the texts have so many characters that a sequence doesn't fit 63 bits.
ORDER = 4
#: Different characters at most that are told apart, so that a sequence of ORDER of them fits a 62-bit number.
FULL = 46_339
#: Words of the largest ratios that stand for a document beside the whole of it.
STRONGEST = 3
OTHER = re.compile(r"[\W\d_]+")
#: Characters scored at once.
BLOCK = 1 << 20
FEATURES = 2


def plain(text: str | None) -> str:
    """The text's letters, lowered, in words between single spaces; nothing for a text without a letter."""
    words = OTHER.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Counts:
    """Of one order: the sequences in order, their counts, their histories in order, with each history's sum of counts and number of kinds, and the discount."""

    grams: np.ndarray
    n: np.ndarray
    histories: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    discount: float

    @classmethod
    def of(cls, grams: np.ndarray, n: np.ndarray, size: int) -> Counts:
        order = np.argsort(grams)
        grams, n = grams[order], n[order].astype(float)
        histories, which = np.unique(grams // size, return_inverse=True)
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        return cls(grams, n, histories, np.bincount(which, n, len(histories)), np.bincount(which, minlength=len(histories)).astype(float), float(discount))

    def interpolated(self, grams: np.ndarray, size: int, shorter: np.ndarray) -> np.ndarray:
        """P of each gram's last symbol after the others, where `shorter` is P after one fewer."""
        if not len(self.grams):
            return shorter
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        n = np.where(self.grams[at] == grams, self.n[at], 0)
        h = np.minimum(np.searchsorted(self.histories, grams // size), len(self.histories) - 1)
        known = self.histories[h] == grams // size
        own = (np.maximum(n - self.discount, 0) + self.discount * self.kinds[h] * shorter) / self.total[h]
        return np.where(known, own, shorter)


@dataclass
class Model:
    alphabet: np.ndarray  # code points, sorted; symbols are their places from 1 on, 0 is any other character
    order: int
    shared: list[Counts]  # continuation counts of orders 1 to order - 1
    own: list[Counts]  # of ordinary and toxic documents
    curve: np.ndarray | None = None

    @property
    def size(self) -> int:
        return len(self.alphabet) + 1

    def probability(self, grams: np.ndarray, label: int) -> np.ndarray:
        p = np.full(len(grams), 1 / self.size)
        for k, counts in enumerate(self.shared, 1):
            p = counts.interpolated(grams % self.size**k, self.size, p)
        return self.own[label].interpolated(grams, self.size, p)

    def ratios(self, text: str) -> np.ndarray:
        """ln P(x | history, toxic) - ln P(x | history, ordinary) of each character after the first ones of a plain text."""
        grams, which = np.unique(sequences(symbols(points(text), self.alphabet), self.size, self.order), return_inverse=True)
        return (np.log(self.probability(grams, 1)) - np.log(self.probability(grams, 0)))[which]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: the mean ratio of its characters, and the mean ratio of its STRONGEST words (of all, if there are fewer), each with the space behind it."""
        out = np.zeros((len(texts), FEATURES))
        words = [plain(t) for t in texts]
        at = 0
        while at < len(words):
            end, chars = at + 1, len(words[at])
            while end < len(words) and chars + len(words[end]) <= BLOCK:
                chars, end = chars + len(words[end]), end + 1
            text = "".join(words[at:end])
            sums = np.zeros(len(text) + 1)
            if len(text) >= self.order:
                sums[self.order :] = np.cumsum(self.ratios(text))
            spaces = np.flatnonzero(points(text) == 32)
            start = 0
            for i in range(at, end):
                stop = start + len(words[i])
                # ratios that reach back into the text before don't count
                first = min(start + self.order - 1, stop)
                if stop > first:
                    of_words = np.diff(sums[np.maximum(spaces[np.searchsorted(spaces, start) : np.searchsorted(spaces, stop)] + 1, first)])
                    k = min(STRONGEST, len(of_words))
                    out[i] = (sums[stop] - sums[first]) / (stop - first), np.partition(of_words, len(of_words) - k)[len(of_words) - k :].mean()
                start = stop
            at = end
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.curve[:-1] + self.curve[-1], -30, 30)))


def symbols(codes: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The place of each code point in the alphabet, from 1 on, or 0; of an alphabet that is full, by the point's remainder."""
    if not len(alphabet):
        return np.zeros(len(codes), np.int64)
    if len(alphabet) == FULL:
        return codes.astype(np.int64) % FULL + 1
    at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    return np.where(alphabet[at] == codes, at + 1, 0).astype(np.int64)


def sequences(symbols: np.ndarray, size: int, order: int) -> np.ndarray:
    """The code of each `order` consecutive symbols."""
    n = max(0, len(symbols) - order + 1)
    code = np.zeros(n, np.int64)
    for k in range(order):
        code = code * size + symbols[k : k + n]
    return code


def count(sample: DataFrame, order: int = ORDER) -> Model:
    """The models of sample(text, label), from counts of character sequences that Spark sums; equal texts of a class count once."""
    texts = sample.groupBy("label", F.md5("text").alias("same")).agg(F.first("text").alias("text")).select("text", "label")

    def letters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.unique(points(plain(t))) for t in b.column(0).to_pylist())]))
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32))], ["point"])

    found = sample.select("text").mapInArrow(letters, "point int").distinct().orderBy("point").toArrow()
    if order > 4:
        raise ValueError("a number holds sequences of 4 symbols at most")
    # the order is the same for any alphabet: more characters than FULL share symbols by their remainders
    alphabet = found["point"].to_numpy().astype(np.uint32)[:FULL]
    size = len(alphabet) + 1

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = np.array(b.column(1).to_pylist(), np.int32)
            for label in np.unique(labels):
                held, chars = [], 0
                chosen = np.flatnonzero(labels == label)
                for i in chosen:
                    grams = sequences(symbols(points(plain(b.column(0)[int(i)].as_py())), alphabet), size, order)
                    held.append(grams)
                    chars += len(grams)
                    if chars < BLOCK and i != chosen[-1]:
                        continue
                    codes, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), label), pa.int32()), pa.array(codes), pa.array(n)], ["label", "gram", "n"])
                    held, chars = [], 0

    per_class = texts.mapInArrow(spell, "label int, gram long, n long").groupBy("gram").agg(*(F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)))
    whole = written(per_class, "toxicity-grams")
    shared, longer = [], whole.select("gram")
    for k in range(order - 1, 0, -1):  # in how many distinct longer sequences of either class one stands at the end
        kinds = longer.groupBy((F.col("gram") % size**k).alias("gram")).agg(F.count("*").alias("n")).toArrow()
        shared.insert(0, Counts.of(kinds["gram"].to_numpy(), kinds["n"].to_numpy(), size))
        longer = longer.select((F.col("gram") % size**k).alias("gram")).distinct()
    rows = whole.toArrow()
    grams, counts = rows["gram"].to_numpy(), [rows[f"n{c}"].to_numpy() for c in (0, 1)]
    return Model(alphabet, order, shared, [Counts.of(grams[n > 0], n[n > 0], size) for n in counts])


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, order: int = ORDER) -> Model | None:
    """The two models and the curve, from all labelled documents outside the held-out fold; None without labels of both classes.

    One training fold fits the curve, the others the models. What comes to the driver are the distinct sequences with their counts.
    """
    chosen = written(labelled(docs, labels, "toxic", folds, held), "toxicity-labelled")
    judge = (held + 1) % folds
    counted, judges = chosen.filter(F.col("part") != judge), chosen.filter(F.col("part") == judge)
    if counted.select("label").distinct().count() < 2:
        return None
    model = count(counted, order)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = sent.value.features(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x[:, i]) for i in range(FEATURES))], ["label", *(f"x{i}" for i in range(FEATURES))])

    kinds = ", ".join(["label int", *(f"x{i} double" for i in range(FEATURES))])
    fit = written(judges.select("text", "label").mapInArrow(judged, kinds), "toxicity-features")
    model.curve = logistic_over(fit, known_labels(labels, "toxic", folds, held).agg(F.avg("label")).first()[0])
    return model


def scorer(model: Model | None) -> Callable[[list[str | None]], np.ndarray]:
    return model.score if model else lambda texts: np.full(len(texts), 0.5)


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels of the held-out fold are never read. A text without letters, null and empty ones too, gets the curve's value
    for no evidence. With no labels of both classes to learn from all scores are 0.5. Rows that repeat a doc_id give a
    row each. Columns of docs but doc_id and text are not read. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held, order))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(sent.value)(b.column(1).to_pylist()))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_fold(F.col("doc_id"), folds, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
