"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its hashed byte trigrams, weighted by log frequency and inverse document frequency over the whole
corpus, and a few rates that tell prose from debris: repeated words, capitals, digits, white space and marks. A
truncated singular value decomposition of a bounded sample gives the latent space. The labelled sample's vectors are
broadcast, and every document's exact cosines with all of them are worked out in blocks; the nearest vote, weighted by
similarity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxospark.llm.common import is_fold, labelled_sample, mapped, written

#: Hashed trigrams; latent dimensions.
TERMS, LATENT = 4096, 48
#: Labelled documents of each class, which the space is fitted on and which are the broadcast reference set, at most.
SAMPLE = 3000
#: Dimensions that the range finder has beyond the latent ones, and its passes over the sample.
SPARE, PASSES = 12, 3
#: Partitions of the sample, whose sums come to the driver.
SUMS = 8
NEIGHBOURS = 15
#: Weight of the rates against the trigrams' unit length.
RATES = 2.0
#: Consecutive words that a word is new among; all stretches of a text count, each word alike.
STRETCH = 200
#: Texts in one block.
BLOCK, BLOCK_CHARS = 64, 1 << 20
MARKS = ".,;:!?'\"-()|*#%&$@/\\_=<>[]{}~^+"
KIND = np.zeros(256, np.uint8)  # 0: letters and the rest
KIND[65:91], KIND[48:58], KIND[128:], KIND[32], KIND[10] = 1, 2, 3, 4, 5
for _i, _c in enumerate(MARKS):
    KIND[ord(_c)] = 6 + _i
KINDS = 6 + len(MARKS)
FOLDED = np.arange(256, dtype=np.int64)
FOLDED[48:58] = 48
RATE_COUNT = KINDS + 3


def rates(text: str) -> tuple[float, float, float]:
    """Of words: the share that repeats the word before, the share that is new within its STRETCH, and a measure of their length."""
    words = text.split()
    if not words:
        return 0.0, 0.0, 0.0
    same = sum(map(str.__eq__, words, words[1:]))
    new = sum(len(set(words[at : at + STRETCH])) for at in range(0, len(words), STRETCH))
    return same / len(words), new / len(words), min(1.0, len(text) / len(words) / 40)


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of at most BLOCK texts: counts of hashed trigrams, and the rates."""
    parts = [(t or "").encode() for t in texts]
    data, sizes = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    kinds = np.bincount(owner * KINDS + KIND[data], minlength=len(texts) * KINDS).reshape(len(texts), KINDS)
    folded = FOLDED[data]
    if len(data) > 2:
        hashed = ((folded[:-2] * 0x9E3779B1 + folded[1:-1] * 0x85EBCA6B + folded[2:] * 0xC2B2AE35) & 0xFFFFFFFF) >> 20
        hashed = hashed[inside := owner[:-2] == owner[2:]]
        counts = np.bincount(owner[:-2][inside] * TERMS + hashed, minlength=len(texts) * TERMS).reshape(len(texts), TERMS)
    else:
        counts = np.zeros((len(texts), TERMS), np.int64)
    shares = kinds / np.maximum(1, sizes)[:, None]
    return counts, np.column_stack([shares, np.array([rates(t or "") for t in texts]).reshape(-1, 3)])


def blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of consecutive texts, BLOCK of them and BLOCK_CHARS characters or so at most; a longer text is alone."""
    block, size = [], 0
    for text in texts:
        if block and (len(block) == BLOCK or size + len(text or "") > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text or "")
    if block:
        yield block


def weighted(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Unit rows of tf-idf with the rates beside them."""
    counts, shares = terms(texts)
    x = np.log1p(counts.astype(np.float32)) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.concatenate([x, RATES * np.sqrt(shares.astype(np.float32))], axis=1)


@dataclass
class Model:
    idf: np.ndarray
    mean: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray | None = None
    labels: np.ndarray | None = None
    weights: np.ndarray | None = None

    def latent(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors of at most BLOCK texts."""
        z = (weighted(texts, self.idf) - self.mean) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def vote(self, texts: list[str | None]) -> np.ndarray:
        cosine = self.latent(texts) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** 4 * self.weights[near]
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Over all documents: inverse document frequency of each hashed trigram."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(TERMS, np.int64), 0
        for b in batches:
            for block in blocks(b.column(0).to_pylist()):
                n += (terms(block)[0] > 0).sum(0)
                rows += len(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.concatenate([[rows], n]))], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).orderBy("term").toArrow()
    n = found["n"].to_numpy()
    if not len(n):
        return np.ones(TERMS, np.float32)
    return np.log((1 + n[0]) / (1 + n[1:])).astype(np.float32) + 0.1


def products(sample: DataFrame, idf: np.ndarray, right: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Over the rows X of the sample: how many they are, their sum, and X' (X right), summed in tasks."""
    sent = sample.sparkSession.sparkContext.broadcast(right)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, out = 0, np.zeros(len(sent.value)), np.zeros(sent.value.shape)
        for b in batches:
            for block in blocks(b.column(0).to_pylist()):
                x = weighted(block, idf)
                n, total = n + len(x), total + x.sum(0)
                out += x.T @ (x @ sent.value)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], ["n", "total", "out"])

    found = sample.select("text").mapInArrow(run, "n long, total binary, out binary").toArrow().to_pylist()
    read = lambda c, shape: sum((np.frombuffer(r[c]) for r in found), np.zeros(int(np.prod(shape)))).reshape(shape)
    return sum(r["n"] for r in found), read("total", (len(right),)), read("out", right.shape)


def latent_space(sample: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, basis): the mean of the sample's rows, and their LATENT directions of most variance."""
    right = np.random.default_rng(0).standard_normal((TERMS + RATE_COUNT, LATENT + SPARE))
    for _ in range(PASSES):
        right, _ = np.linalg.qr(right)
        n, total, out = products(sample, idf, right.astype(np.float32))
        mean = total / max(1, n)
        out -= n * np.outer(mean, mean @ right)  # of the centred rows
        small = right.T @ out
        before, right = right, out
    values, axes = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(-values)[:LATENT]
    keep = keep[values[keep] > 1e-6 * max(1e-9, values.max())]
    return mean.astype(np.float32), (before @ axes[:, keep]).astype(np.float32)


def reference(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The latent vectors of the sample and its labels, in order of doc_id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                rows = model.latent(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), part.column(2)], ["doc_id", "data", "label"])

    found = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, data binary, label int").toArrow().sort_by("doc_id")
    data = np.frombuffer(b"".join(found["data"].to_pylist()), np.float32)
    return data.reshape(-1, model.basis.shape[1]), found["label"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Model | None:
    """The space and the reference vectors in it, from a bounded sample; None without labels."""
    chosen, share = labelled_sample(docs, labels, "quality", folds, held, sample)
    chosen = written(chosen, "quality-sample")
    if chosen.isEmpty():
        return None
    chosen = written(chosen.repartition(SUMS, "doc_id"), "quality-sample")
    idf = document_frequencies(docs)
    model = Model(idf, *latent_space(chosen, idf))
    model.vectors, model.labels = reference(chosen, model)
    sampled = np.array([(model.labels == 0).mean(), (model.labels == 1).mean()])
    model.weights = (np.array([1 - share, share]) / np.maximum(sampled, 1e-9)).astype(np.float32)[model.labels]
    return model


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels of the held-out fold are never read. A null text counts as empty, and an empty one is a point of the space
    like any other. With no labels to learn from all scores are 0.5. Rows that repeat a doc_id give a row each. Columns
    of docs but doc_id and text are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(train(docs, labels, folds, held, sample))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            texts = b.column(1).to_pylist()
            votes = [model.vote(block) for block in blocks(texts)] if model else [np.full(len(texts), 0.5)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(np.concatenate([np.zeros(0), *votes]), 0, 1).astype(float))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_fold(F.col("doc_id"), folds, held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores `threshold` or more; nothing is shuffled.

    A null text counts as empty. All rows are kept where there are no labels to learn from. Rows that repeat a doc_id are
    judged each, and columns but text may have any name. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sent, at = spark.sparkContext.broadcast(train(docs, labels, folds, held, sample)), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            if model is None:
                yield b
                continue
            votes = [model.vote(block) for block in blocks(b.column(at).to_pylist())]
            yield b.filter(pa.array(np.concatenate([np.zeros(0), *votes]) >= threshold))

    return mapped(docs, run, docs.schema)
