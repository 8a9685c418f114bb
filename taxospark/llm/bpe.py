"""Byte-level BPE by the tiktoken library and a local rank file: ids of texts, and the bytes of ids.

A long text is cut where the splitting pattern has a match boundary whatever stands around it, so its ids are those of
the whole text: between a character that isn't white space and white space, since no alternative of the pattern goes
from one to the other and none looks back.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


RANKS = "byte_bpe_50k.tiktoken"
#: Characters from which a text is encoded in pieces, and about so many characters a piece.
LONG = 65_536
#: Unicode's White_Space, as the pattern's \s has it (Python's \s has four more).
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
EDGE = re.compile(f"[^{SPACE}](?=[ \n])")
#: A run of white space so long that matching it would exhaust the pattern's engine.
RUN = re.compile(f"[{SPACE}]{{1000,}}")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The rank file's encoding; once per worker process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """The text in pieces of about `long` characters, cut at safe boundaries only."""
    at = 0
    while len(text) - at > long and (edge := EDGE.search(text, at + long)):
        yield text[at : edge.end()]
        at = edge.end()
    yield text[at:]


def encode(text: str | None, enc: tiktoken.Encoding, long: int = LONG) -> list[int]:
    """Ids of a text; of a null text, none."""
    if not text:
        return []
    if len(text) < 1000:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for run in RUN.finditer(text):
        # a run before more text is one match up to its last character, and at the end of the text it is one match
        end = run.end() if run.end() == len(text) else run.end() - 1
        for piece in pieces(text[at : run.start()], long):
            ids += enc.encode_ordinary(piece)
        ids += enc._encode_single_piece(text[run.start() : end])
        at = end
    for piece in pieces(text[at:], long):
        ids += enc.encode_ordinary(piece)
    return ids


def with_ids(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every whole text, none for null and empty ones. Rows that repeat a doc_id give a row each; other columns are not read; an empty table gives no rows."""
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            ids = pa.array([encode(t, enc) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def with_bytes(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and data (binary), the raw bytes that ids stand for; they needn't be valid UTF-8. Null ids have no bytes. Rows that repeat a doc_id give a row each; other columns are not read; an empty table gives no rows."""
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            data = pa.array([enc.decode_bytes(x or []) for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), data], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """Encodes every whole text and decodes its ids: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes.

    Both steps are done while a text is in a worker's memory, and digests come back instead of ids. Null and empty texts
    have no ids. Rows that repeat a doc_id give a row each. Columns but doc_id and text are not read. An empty table
    gives no rows.
    """
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            out: list[tuple[int, str, str, int]] = []
            for text in b.column(1).to_pylist():
                ids = encode(text, enc)
                data = enc.decode_bytes(ids)
                out.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest(), len(data)))
            columns = zip(*out) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
