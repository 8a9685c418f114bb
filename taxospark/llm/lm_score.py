"""Stupid-backoff language-model scores, by n-gram count tables joined to exploded n-grams.

Every document's distinct n-grams are exploded, with their number in the document, and written once, in buckets by their
last two words; Spark's rows hold a block's n-grams of a bucket, packed. Words are numbers there: the KNOWN most frequent
ones their ranks, others a hash. A document is scored by all others: its own occurrences, which each n-gram carries for
every shorter sequence it may ask for, are taken off each count. In a bucket each sequence meets its count and those of
all that it may back off to, at a factor of BACKOFF each, down to two words; counts of known words are broadcast. Then
the first sequence that is left is divided by the count of its history. Histories go to their own buckets, where they are
joined with the table of sequences that several documents have, as other words are with the table of words' counts; a
document's counts meet in buckets of documents, where their logarithms are summed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxospark.llm.common import free_name, shared_path, with_row, written

ORDER, BACKOFF = 3, 0.4
#: The word before a text's first.
START = 0
#: Words that have ranks, the most frequent ones. It changes speed, never results.
KNOWN = 1 << 20
#: Bytes of texts whose words are counted, and exploded, at once, but for a longer text; n-grams that are packed at once.
COUNTED, EXPLODED, BLOCK = 1 << 23, 1 << 21, 1 << 20
#: Words a bucket; files a task writes at most; words of documents that are summed at once.
WORDS_A_BUCKET, FILES, SUMMED = 1_250_000, 128, 1 << 21
#: Packed rows: where they go (a bucket of sequences, or behind these one of documents), what they are and of how many words.
PACKED = "at int, kind string, k int, packed binary"
ZSTD = pa.Codec("zstd", compression_level=3)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered; `blocks` has those of many texts."""
    return (text or "").encode().lower().split()


def mixed(code: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A 64-bit hash of both, in which sequences are compared."""
    x = (code ^ more.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def hashed(words: Sequence[np.ndarray]) -> np.ndarray:
    """Of sequences of words, from the last one on."""
    code = np.zeros(len(words[0]), np.uint64)
    for w in reversed(words):
        code = mixed(code, w)
    return code


def ordered(code: np.ndarray, width: int = 64) -> np.ndarray:
    """The places of unsigned codes below 2 ** width, in the codes' order. Numbers sort several times faster than places do."""
    bits = max(1, (len(code) - 1).bit_length())
    low, at = np.uint64(bits), np.arange(len(code), dtype=np.uint64)
    high = code << low if width + bits <= 64 else code >> low << low
    lie = (np.sort(high | at) & np.uint64((1 << bits) - 1)).astype(np.int64)
    if width + bits > 64:
        found = code[lie]
        if np.any(found[1:] < found[:-1]):  # codes that differ in the bits left out only
            return np.argsort(code, kind="stable")
    return lie


def totals(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each place the sum of n, or the number of places, that have its code; one place of each code."""
    lie = ordered(code)
    found = code[lie]
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    sizes = np.diff(first, append=len(code))
    out = np.empty(len(code), np.int64)
    out[lie] = np.repeat(sizes if n is None else np.add.reduceat(n[lie], first), sizes)
    return out, lie[first]


def ranked(words: np.ndarray, known: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The ranks of words, or the hashes of those that aren't known; known words are sorted."""
    if not len(known):
        return words
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, ranks[at], words)


def exploded(words: np.ndarray, ids: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of texts with so many words each, by their hashes, the distinct n-grams: text, the words' ids, and numbers.

    These are the n-gram's occurrences in the text, and for each shorter order those of what it ends with (own) and of the history (past).
    """
    n = len(words)
    own = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) - (np.cumsum(sizes) - sizes)[own]

    def back(of: np.ndarray, k: int) -> np.ndarray:
        """The words `k` places before."""
        return np.where(place >= k, np.roll(of, k), START) if k else of

    code, counts, found = own.astype(np.uint64), [], None
    for k in range(order):
        code = mixed(code, back(words, k))
        times, found = totals(code)
        counts.append(times)
    # a history's occurrences are those of the sequence up to the word before; that of nothing but START has one a text
    before = [np.where(place > 0, np.roll(counts[k], 1), 1) for k in range(order - 1)]
    numbers = [counts[-1], *(x for k in range(order - 2, -1, -1) for x in (counts[k], before[k]))]
    return own[found], [back(ids, k)[found] for k in reversed(range(order))], [x[found].astype(np.int32) for x in numbers]


def blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some (row, text) of about so many bytes at once: the rows, their numbers of words, 63-bit hashes below 0 of the different words, and each word's place among these."""
    for b in batches:
        rows, texts = b.column(0).to_numpy(), b.column(1).fill_null("")
        upto, first = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
        while first < len(rows):
            last = max(first + 1, int(np.searchsorted(upto, size + (upto[first - 1] if first else 0), "right")))
            split = pc.ascii_split_whitespace(pc.ascii_lower(texts[first:last]))
            words = split.flatten()
            held = pc.binary_length(words).to_numpy() > 0  # not where white space begins or ends a text
            sizes = np.diff(np.append(0, np.cumsum(held))[np.cumsum(pc.list_value_length(split).to_numpy())], prepend=0)
            words = words.filter(pa.array(held)).dictionary_encode()
            different = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, different), np.uint64, len(different))
            yield rows[first:last], sizes, (hashes >> np.uint64(1) | np.uint64(1 << 63)).view(np.int64), words.indices.to_numpy()
            first = last


def word_counts(docs: DataFrame, row: str) -> DataFrame:
    """(h, c): how often each word stands in the corpus, and START in as many texts as have words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sizes, hashes, words in blocks(batches, COUNTED):
            counts = np.append(np.bincount(words, minlength=len(hashes)), np.count_nonzero(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hashes, START)), pa.array(counts, pa.int64())], ["h", "c"])

    return docs.select(row, "text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def pack(words: Sequence[np.ndarray], numbers: Sequence[np.ndarray], base: int = 0) -> bytes:
    """Columns of words' ids and of numbers from 0, in as few bytes as hold each, by their places; hashes of words behind them."""
    rare = 1 + max([0, *(int(w.max()) for w in words)])
    raw = []
    for x in (*(np.where(w < 0, rare, w) for w in words), *numbers):
        size = next(s for s in (1, 2, 4, 8) if int(x.max()) < 1 << 8 * s)
        raw += [bytes([size]), x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()]
    raw = b"".join([*raw, *(w[w < 0].tobytes() for w in words)])
    head = np.array([len((*words, *numbers)[0]), len(raw), base, rare], np.int64)
    return head.tobytes() + ZSTD.compress(raw, asbytes=True)


def unpack(packed: bytes, words: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """The columns that pack was given, and the base."""
    n, size, base, rare = np.frombuffer(packed, np.int64, 4).tolist()
    raw = ZSTD.decompress(memoryview(packed)[32:], size, asbytes=True)
    at, hashes, columns = 0, 0, []
    while at < size - 8 * hashes:
        k = raw[at]
        x = np.frombuffer(raw, np.uint8, k * n, at + 1).reshape(k, n)
        columns.append((np.ascontiguousarray(x.T).view(f"<u{k}").reshape(n) if k > 1 else x[0]).astype(np.int64))
        at += 1 + k * n
        if len(columns) <= words:
            hashes += np.count_nonzero(columns[-1] == rare)
    for w in columns[:words]:
        hits = np.flatnonzero(w == rare)
        w[hits] = np.frombuffer(raw, np.int64, len(hits), at)
        at += 8 * len(hits)
    return columns[:words], columns[words:], base


def pieces(to: np.ndarray, lie: np.ndarray, words: Sequence[np.ndarray], numbers: Sequence[np.ndarray], row: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """What goes to each bucket, packed, in an order of places in which buckets are together; the first number is that of rows, if there are any."""
    to, words, numbers = to[lie], [w[lie] for w in words], [x[lie] for x in numbers]
    row = None if row is None else row[lie]
    cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            base = 0 if row is None else int(row[a:b].min())
            rows = [] if row is None else [row[a:b] - base]
            yield int(to[a]), pack([w[a:b] for w in words], [*rows, *(x[a:b] for x in numbers)], base)


def gathered(packed: Iterable[bytes], words: int, row: bool = True) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of words and numbers of all that is packed; with rows, these are the first numbers."""
    w, x = [], []
    for p in packed:
        a, b, base = unpack(p, words)
        w.append(a)
        x.append([b[0] + base, *b[1:]] if row else b)
    return [np.concatenate(c) for c in zip(*w)], [np.concatenate(c) for c in zip(*x)]


def bucket_of(code: np.ndarray, buckets: int) -> np.ndarray:
    return ((code >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_words(to: np.ndarray, words: Sequence[np.ndarray]) -> np.ndarray:
    """An order of buckets and, as far as that makes them smaller, of the last two words in each."""
    code = to.astype(np.uint64)
    for w, bits in zip((words[-2] if len(words) > 1 else words[-1], words[-1]), (18, 14)):
        top = (1 << bits) - 1
        code = code << np.uint64(bits) | np.where((w < 0) | (w > top), top, w).astype(np.uint64)
    return ordered(code, int(to.max()).bit_length() + 32)


def by_rows(to: np.ndarray, row: np.ndarray) -> np.ndarray:
    """An order of buckets and of rows in each; a row's file lies in bits from the 41st on."""
    place = row & ((1 << 40) - 1)
    bits = int(place.max()).bit_length()
    code = (row >> 40) << bits | place
    lie = ordered(code.astype(np.uint64), int(code.max()).bit_length())
    top = int(to.max())
    return lie[np.argsort(to[lie].astype(np.uint16 if top < 1 << 16 else np.int64), kind="stable")]


def rows_bucket(row: np.ndarray, buckets: int, ranges: int) -> np.ndarray:
    """The bucket of documents, behind those of sequences; neighbours are together."""
    return buckets + bucket_of(mixed(np.zeros(len(row), np.uint64), row >> 6), ranges)


def table_of(found: list[tuple[int, str, int, bytes]]) -> pa.Table:
    columns = list(zip(*found)) or [()] * 4
    return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.binary()))], ["at", "kind", "k", "packed"])


def grams(docs: DataFrame, row: str, order: int, buckets: int, known: np.ndarray) -> DataFrame:
    """(at, grams): the distinct n-grams of each document with its row, a packed row for each block of texts and bucket; words are ranks in `known`, from 1, or hashes."""
    places = np.argsort(known)
    told = docs.sparkSession.sparkContext.broadcast((known[places], places + 1))

    def laid(held: list[tuple]) -> pa.RecordBatch:
        rows, *columns = (np.concatenate(x) for x in zip(*held))
        found = columns[:order]
        to = bucket_of(hashed(found[-2:]), buckets)
        made = list(zip(*pieces(to, by_words(to, found), found, columns[order:], rows)))
        return pa.RecordBatch.from_arrays([pa.array(made[0], pa.int32()), pa.array(made[1], pa.binary())], ["at", "grams"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows, sizes, hashes, words in blocks(batches, EXPLODED):
            if len(words):
                own, found, numbers = exploded(hashes[words], ranked(hashes, *told.value)[words], sizes, order)
                held.append((rows[own], *found, *numbers))
                n += len(own)
            if n >= BLOCK:
                yield laid(held)
                held, n = [], 0
        if held:
            yield laid(held)

    return docs.select(row, "text").mapInArrow(run, "at int, grams binary")


def bucketed(df: DataFrame, keys: list[str], buckets: int, label: str) -> DataFrame:
    """df, written once to shared storage in buckets by the keys, without a shuffle."""
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    laid = df.write.format("parquet").option("compression", "none").option("parquet.enable.dictionary", "false").option("path", shared_path(df.sparkSession, label))
    laid.bucketBy(buckets, *keys).saveAsTable(name)
    return df.sparkSession.table(name)


def summed(row: np.ndarray, n: np.ndarray, over: np.ndarray, under: np.ndarray, steps: np.ndarray, fail: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, the sums of n * log(factor ** steps * over / under) of each, and their places in these."""
    lie = ordered(row.astype(np.uint64))
    found = row[lie]
    new = np.concatenate([[True], found[1:] != found[:-1]])
    which = np.empty(len(row), np.int64)
    which[lie] = np.cumsum(new) - 1
    part = np.bincount(which, n * (np.log(over) - np.log(under) + steps * fail))
    return found[new], part, which


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_score (natural log, summed) and mean_log_score (0 for no word).

    S(w | h) = c(hw) / c(h) if c(hw) > 0, else backoff * S(w | h without its first word); a single word has c(w) / N, or
    backoff / N if no other document has it. c and N are counts over all documents but the one scored. Histories that
    reach back beyond a text have START there, which each other text with words counts for once. Null and empty texts
    have no words and score 0. Rows that repeat a doc_id count and are scored each. Columns but doc_id and text are not
    read. An empty table gives no rows.
    """
    spark, row = docs.sparkSession, free_name(docs, "_row")
    docs = with_row(docs, row).select(row, "doc_id", "text")
    words = written(word_counts(docs, row), "lm-words")
    total, texts = words.agg(F.coalesce(F.sum(F.when(F.col("h") != START, F.col("c"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("h") == START, F.col("c"))), F.lit(0))).first()
    first = words.filter(F.col("h") != START).orderBy(F.desc("c"), "h").limit(KNOWN).toArrow()
    known, counts = first["h"].to_numpy(), np.append(texts, first["c"].to_numpy())
    buckets, ranges = max(8, -(-total // WORDS_A_BUCKET)), max(1, -(-total // SUMMED))
    fail = float(np.log(backoff))
    told = spark.sparkContext.broadcast(counts)

    def counted(rows: pa.Table) -> pa.Table:
        """Of a bucket's n-grams: what is known of each by now, the histories it asks for, and the table of sequences for those that ask here."""
        counts = told.value
        w, (row, n, *more) = gathered((x.as_py() for x in rows["grams"]), order)
        own = {order: n} | {k: more[2 * (order - 1 - k)] for k in range(1, order)}
        past = {k: more[2 * (order - 1 - k) + 1] for k in range(1, order)}
        at, out = rows["at"][0].as_py(), []
        length, over = np.ones(len(n), np.int64), np.ones(len(n), np.int64)
        code = mixed(np.zeros(len(n), np.uint64), w[-1])
        for k in range(2, order + 1):
            code = mixed(code, w[-k])
            there, one = totals(code, n)
            rest = there - own[k]  # what is left of a sequence is left of what it ends with too
            length, over = np.where(rest > 0, k, length), np.where(rest > 0, rest, over)
            several = one[rest[one] > 0]
            if k < order and len(several):
                out.append((at, "table", k, pack([x[several] for x in w[-k:]], [there[several]])))
        steps, under, known_last = order - length, np.ones(len(n), np.int64), w[-1] >= 0
        rest = np.where(known_last, counts[np.maximum(w[-1], 0)] - own[1], 1)
        single = length == 1
        over = np.where(single, np.maximum(rest, 1), over)
        steps = np.where(single & (rest <= 0), order, steps)
        asks = [("word", 1, np.flatnonzero(single & ~known_last), [w[-1]], own[1])]
        for k in range(1, order):
            mine, history = length == k + 1, w[-1 - k : -1]
            last = history[-1]
            told_here = last >= 0 if k == 1 else last == START
            under = np.where(mine & told_here, counts[np.maximum(last, 0)] - past[k], under)
            asks.append(("history", k, np.flatnonzero(mine & ~told_here), history, past[k]))
        for kind, k, asking, sequence, mine in asks:
            if len(asking):
                sequence = [x[asking] for x in sequence]
                to = bucket_of(hashed(sequence[-2:]), buckets)
                made = pieces(to, by_words(to, sequence), sequence, [n[asking], mine[asking]], row[asking])
                out += [(a, kind, k, p) for a, p in made]
        to = rows_bucket(row, buckets, ranges)
        out += [(a, "facts", 0, p) for a, p in pieces(to, by_rows(to, row), [], [n, over, under, steps], row)]
        return table_of(out)

    def packed_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tables of the words that have no ranks."""
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            h, c = (np.concatenate(x) for x in zip(*held))
            code = hashed([h])
            yield from table_of([(a, "table", 1, p) for a, p in pieces(bucket_of(code, buckets), ordered(code), [h], [c])]).to_batches()

    def answered(rows: pa.Table) -> pa.Table:
        """Of a bucket of sequences: the counts of histories and words that were asked for. Of one of documents: sums by row."""
        at, packed = rows["at"][0].as_py(), {}
        for kind, k, p in zip(*(rows[x].to_pylist() for x in ("kind", "k", "packed"))):
            packed.setdefault((kind, k), []).append(p)
        if at >= buckets:
            _, (row, n, over, under, steps) = gathered(packed["facts", 0], 0)
            found, part, which = summed(row, n, over, under, steps, fail)
            tokens, whole = np.bincount(which, n).astype(np.int64), np.bincount(which, n * (steps >= order - 1)).astype(np.int64)
            return table_of([(at, "sums", 0, pack([], [found, tokens, whole, part.view(np.uint64)]))])
        answers, tables = [], {}
        for k in {k for kind, k in packed if kind == "table"}:
            sequence, (c,) = gathered(packed["table", k], k, False)
            code = hashed(sequence)
            lie = ordered(code)
            tables[k] = code[lie], c[lie]
        for kind, k in packed:
            if kind != "table":
                sequence, (row, n, mine) = gathered(packed[kind, k], k)
                code = hashed(sequence)
                lie = ordered(code)
                codes, c = tables[k]
                rest, row, n = c[np.searchsorted(codes, code[lie])] - mine[lie], row[lie], n[lie]
                one = np.ones(len(n), np.int64)
                answers.append((row, n, np.maximum(rest, 1), one, (rest <= 0).astype(np.int64)) if kind == "word" else (row, n, one, rest, 0 * one))
        if not answers:
            return table_of([])
        row, *numbers = (np.concatenate(x) for x in zip(*answers))
        to = rows_bucket(row, buckets, ranges)
        return table_of([(a, "answers", 0, p) for a, p in pieces(to, by_rows(to, row), [], numbers, row)])

    def ended(rows: pa.Table) -> pa.Table:
        """Sums by row of a bucket of documents."""
        packed = {"sums": [], "answers": []}
        for kind, p in zip(rows["kind"].to_pylist(), rows["packed"]):
            packed[kind].append(p.as_py())
        _, (found, tokens, whole, part) = gathered(packed["sums"], 0, False)
        part = part.view(np.float64)
        if packed["answers"]:
            which, more, _ = summed(*gathered(packed["answers"], 0)[1], fail)
            part[np.searchsorted(found, which)] += more
        return pa.table([found, part, whole, tokens], ["row", "part", "over_all", "n_tokens"])

    found = bucketed(grams(docs, row, order, buckets, known), ["at"], min(FILES, buckets), "lm-grams")
    asked = found.groupBy("at").applyInArrow(counted, PACKED)
    if len(known) == KNOWN:
        least, last = int(counts[-1]), int(known[-1])
        others = (F.col("h") != START) & ((F.col("c") < least) | ((F.col("c") == least) & (F.col("h") > last)))
        asked = asked.unionByName(words.filter(others).select("h", "c").mapInArrow(packed_words, PACKED))
    sums = asked.groupBy("at").applyInArrow(answered, PACKED).groupBy("at").applyInArrow(ended, "row long, part double, over_all long, n_tokens long")
    tokens = F.coalesce(F.col("n_tokens"), F.lit(0).cast("long"))
    others = F.greatest(F.lit(1), F.lit(total) - tokens)
    log_score = F.coalesce(F.col("part") - F.col("over_all") * F.log(others), F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).otherwise(0.0)
    scored = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long")).join(sums, "row", "left")
    return scored.select("doc_id", tokens.alias("n_tokens"), log_score.alias("log_score")).select("*", mean.alias("mean_log_score"))
