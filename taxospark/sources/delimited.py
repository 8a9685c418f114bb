"""Comma-delimited files: header, mapping, encodings, ragged rows, guards and record numbers.

Columns are read by position (_c0, _c1, ...), for Spark renames repeated headers. Legacy files are read as ISO-8859-1,
one character a byte, and their upper half is translated, so decoding is a native expression.

A line may end inside quotes, so whether a line begins a record depends on how many quotes the file has before it. A first
pass counts, for each block of a file, its quotes, and the lines that begin records if a quote is open at the block's start
and if none is. These counts, a row a block, are added up in the order of the blocks; a second pass then knows for each
block whether it starts in quotes and which number its first record has. So any file is read and numbered in as many tasks
as it has blocks, without a shuffle; only records that run over a block's end are put together by one.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from taxospark.functions.text import trim, truncated
from taxospark.schemas import CATALOG_ALIASES, FIELDS, MAX_COLUMNS, MAX_FIELD_BYTES, SUBJECT_ALIASES, TITLE_ALIASES, ColumnMap, Layout, SpecError

UTF8, WINDOWS_1252, MAC_ROMAN = "utf-8", "windows-1252", "mac-roman"
#: Bytes as the characters of their numbers.
RAW = "iso-8859-1"
CODEPAGES = {WINDOWS_1252: "cp1252", MAC_ROMAN: "mac_roman"}
CORRUPT, VALID = "_corrupt", "_valid"
EXAMPLES, PREVIEW = 10, 5
#: Lines that a header with quoted line ends may have; one with more is refused.
HEADER_LINES = 256
#: Bytes of lines that a task takes apart at once, but for a longer line.
STRETCH = 1 << 20


def upper_half(encoding: str) -> str:
    """What the bytes 0x80 to 0xFF stand for; bytes that a codepage leaves free stand for the control character of their number."""
    name = CODEPAGES[encoding]
    return "".join(bytes([b]).decode(name, "replace").replace("�", chr(b)) for b in range(128, 256))


def decoded(text: Column, encoding: str) -> Column:
    if encoding in (UTF8, RAW):
        return text
    return F.translate(text, "".join(map(chr, range(128, 256))), upper_half(encoding))


def header_bytes(spark: SparkSession, path: str) -> bytes:
    """The file's header line, or its first lines where a quote is open at a line's end. No more of the file is read."""
    lines = spark.read.text(path).select(F.col("value").cast("binary"))
    n, head = 1, b""
    while n <= HEADER_LINES:
        found = [bytes(r[0]) for r in lines.take(n)]
        head = b"\n".join(found)
        if len(found) < n or head.count(b'"') % 2 == 0:
            return head
        n *= 4
    raise SpecError(f"the header has a quote that isn't closed within {HEADER_LINES} lines")


def headers(spark: SparkSession, path: str, encoding: str = UTF8) -> tuple[str, ...]:
    """The header's names. UTF-16 is refused; a byte-order mark is dropped."""
    head = header_bytes(spark, path)
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise SpecError("the file is UTF-16; save it as UTF-8")
    first = head.removeprefix(b"\xef\xbb\xbf")
    if b"\0" in first:
        raise SpecError("the header has NUL bytes; the file may be UTF-16")
    text = first.decode("utf-8" if encoding == UTF8 else CODEPAGES[encoding], "replace")
    found = tuple(next(csv.reader(io.StringIO(text, newline="")), []))
    if not found:
        raise SpecError("the file has no header")
    if len(found) > MAX_COLUMNS:
        raise SpecError(f"the file has {len(found)} columns; at most {MAX_COLUMNS} are read")
    return found


def detect_mapping(names: Iterable[str]) -> ColumnMap:
    """The three fields' columns: for each the first alias that is a header, whatever its ASCII case, at its first place."""
    lowered = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in n) for n in names]
    found = [next((lowered.index(a) for a in aliases if a in lowered), None) for aliases in (SUBJECT_ALIASES, CATALOG_ALIASES, TITLE_ALIASES)]
    if None in found:
        raise SpecError(f"no columns for all three fields in {lowered}")
    return ColumnMap(*found)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value binary, file, block): the lines, in order within a block, with a carriage return before their end if there is one."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


#: A line, or a part of one that a lone carriage return ends; a carriage return at the very end is part of the line's end.
LONE = re.compile(rb"[^\r]*\r(?=.)|[^\r]*\r?\Z", re.DOTALL)


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
    """(file, block, lines, lone) of a task's batches, whose lines a block has one after another, STRETCH bytes or so at once; lone: whether a line ends in a lone carriage return, which it holds."""
    for b in batches:
        files, starts = b.column(1).dictionary_encode(), b.column(2).to_numpy()
        places = files.indices.to_numpy()
        stretches = np.cumsum(pc.binary_length(b.column(0)).to_numpy()) // STRETCH
        cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(starts) != 0) | (np.diff(stretches) != 0)) + 1
        for x, y in zip([0, *cuts], [*cuts, b.num_rows]):
            if x == y:
                continue
            lines, lone = b.column(0).slice(x, y - x), np.zeros(y - x, bool)
            if pc.any(pc.match_substring_regex(lines, b"(?s)\r.")).as_py():
                parts = [[p for p in LONE.findall(line) if p] or [b""] for line in lines.to_pylist()]
                lines = pa.array([p for part in parts for p in part], pa.binary())
                lone = np.array([i + 1 < len(part) for part in parts for i in range(len(part))])
            yield files.dictionary[places[x]].as_py(), int(starts[x]), lines, lone


def quotes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the number of its quotes, and whether it is blank."""
    return pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False), pc.match_substring_regex(lines, b"^[\\x00-\\x20]*$").to_numpy(zero_copy_only=False)


def block_counts(lines: DataFrame) -> list[tuple[str, int, int, int, int]]:
    """(file, block, parity, even, odd) of each block in order: whether it has an odd number of quotes, and lines that aren't blank with an even and an odd number before them in the block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[int]] = {}
        for file, block, part, _ in runs(batches):
            held = found.setdefault((file, block), [0, 0, 0])
            n, blank = quotes(part)
            odd = (held[0] + np.cumsum(n) - n) & 1
            held[0] = (held[0] + int(n.sum())) & 1
            held[1] += int(np.count_nonzero((odd == 0) & ~blank))
            held[2] += int(np.count_nonzero((odd == 1) & ~blank))
        for (file, block), held in found.items():
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "parity": held[0], "even": held[1], "odd": held[2]}], pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("block", "parity", "even", "odd"))]))

    rows = lines.mapInArrow(run, "file string, block long, parity long, even long, odd long").collect()
    return sorted(tuple(r) for r in rows)


@dataclass(frozen=True)
class Block:
    """Where a block starts: in quotes or not, and the place of the first record that begins in it among all records and headers.

    head: the place of its file's header; headers: how many places of headers there are up to that one.
    """

    quoted: bool
    first: int
    head: int
    headers: int

    def index(self, place: int) -> int:
        """The number of the record at a place; of the header, -1."""
        return -1 if place == self.head else place - self.headers


def placed(counts: Iterable[tuple[str, int, int, int, int]], header: bool = True) -> dict[tuple[str, int], Block]:
    """Each block's start, from the counts of all blocks in order. Every file begins with a header, if there are any."""
    out: dict[tuple[str, int], Block] = {}
    place, file, quoted, head, headers = 0, None, False, -1, 0
    for path, block, parity, even, odd in counts:
        if path != file:
            file, quoted = path, False
            head, headers = (place, headers + 1) if header else (-1, 0)
        out[path, block] = Block(quoted, place, head, headers)
        place += odd if quoted else even
        quoted ^= bool(parity)
    return out


class Records:
    """The records of a block, line by line. A record is given out when its last line has come: (number, block, text).

    The block stands with parts of records only: with what goes on from the block before and what isn't closed at the end.
    """

    def __init__(self, block: int, at: Block):
        self.block, self.at, self.quoted, self.place = block, at, at.quoted, at.first
        self.held: list[bytes] | None = [] if at.quoted else None
        self.part = at.quoted

    def take(self, lines: pa.Array, lone: np.ndarray) -> tuple[np.ndarray, pa.Array, list[tuple[int, int | None, bytes]]]:
        """Numbers and lines of the records of one line, and all other records that end."""
        n, blank = quotes(lines)
        upto = self.quoted + np.cumsum(n)
        before, after = (upto - n) & 1, upto & 1
        begins = (before == 0) & ~blank
        places = self.place + np.cumsum(begins) - 1
        single = np.flatnonzero(begins & (after == 0))
        ended: list[tuple[int, int | None, bytes]] = []
        for i in np.flatnonzero((before == 1) | (after == 1)).tolist():
            line = lines[i].as_py()
            if before[i] == 0:
                self.held = []
            self.held.append(line)
            if after[i] == 0:
                ended.append(self._given(int(places[i])))
                self.held, self.part = None, False
            elif not lone[i]:
                self.held.append(b"\n")
        if len(n):
            self.place, self.quoted = int(places[-1]) + 1, bool(after[-1])
        head = places[single] == self.at.head
        return np.where(head, -1, places[single] - self.at.headers), lines.take(pa.array(single)), ended

    def _given(self, place: int) -> tuple[int, int | None, bytes]:
        return self.at.index(place), self.block if self.part else None, b"".join(self.held)

    def rest(self) -> list[tuple[int, int | None, bytes]]:
        """What isn't closed at the block's end."""
        if not self.held:
            return []
        self.part = True
        return [self._given(self.place - 1)]


def record_texts(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(row_index, value binary): the text of every record but the headers, and its 0-based place in the order of files and their bytes.

    Lines that hold nothing but white space are no records. A quote that is open at a file's end closes there.
    """
    lines = text_lines(spark, path)
    counts = block_counts(lines)
    blocks = spark.sparkContext.broadcast(placed(counts, header))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, None
        for file, block, part, lone in runs(batches):
            out: list[tuple[int, int | None, bytes]] = []
            if (file, block) != key:
                out = now.rest() if now else []
                key, now = (file, block), Records(block, blocks.value[file, block])
            numbers, values, ended = now.take(part, lone)
            more = [m for m in (*out, *ended) if m[0] >= 0]
            keep = pa.array(numbers >= 0)
            yield batch(pa.array(numbers).filter(keep), None, values.filter(keep))
            if more:
                yield batch(*(list(c) for c in zip(*more)))
        if now and (left := [m for m in now.rest() if m[0] >= 0]):
            yield batch(*(list(c) for c in zip(*left)))

    def batch(numbers, parts, values) -> pa.RecordBatch:
        numbers = pa.array(numbers, pa.int64())
        return pa.RecordBatch.from_arrays([numbers, pa.nulls(len(numbers), pa.int64()) if parts is None else pa.array(parts, pa.int64()), pa.array(values, pa.binary())], ["row_index", "part", "value"])

    found = lines.mapInArrow(run, "row_index long, part long, value binary")
    whole = found.filter("part is null").select("row_index", "value")
    if not any(b.quoted for b in blocks.value.values()) and not unclosed(counts):
        return whole
    parts = found.filter("part is not null").groupBy("row_index").agg(F.sort_array(F.collect_list(F.struct("part", "value"))).alias("parts"))
    return whole.unionByName(parts.select("row_index", F.expr("aggregate(parts, x'', (text, p) -> concat(text, p.value))").alias("value")))


def unclosed(counts: Iterable[tuple[str, int, int, int, int]]) -> bool:
    """Whether a file ends within quotes."""
    odd: dict[str, int] = {}
    for path, _, parity, _, _ in counts:
        odd[path] = odd.get(path, 0) ^ parity
    return any(odd.values())


def scan(spark: SparkSession, path: str, width: int, encoding: str = UTF8) -> DataFrame:
    """All records but the header: row_index, _c0 ..., _corrupt (a ragged record's text, else null) and _valid, whether its bytes are UTF-8."""
    columns = [f"_c{i}" for i in range(width)]
    schema = ", ".join([*(f"{c} string" for c in columns), f"{CORRUPT} string"])
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true", "emptyValue": ""}
    records = record_texts(spark, path)
    ended = F.expr("if(endswith(value, x'0D'), left(value, length(value) - 1), value)")
    text = ended.cast("string") if encoding == UTF8 else F.decode(ended, "ISO-8859-1")
    parsed = records.select("row_index", F.is_valid_utf8(F.col("value").cast("string")).alias(VALID), F.from_csv(text, schema, options).alias("_r"))
    cells = {c: decoded(F.coalesce(F.col(f"_r.{c}"), F.lit("")), encoding).alias(c) for c in columns}
    return parsed.select("row_index", *cells.values(), F.col(f"_r.{CORRUPT}").alias(CORRUPT), VALID)


def indexed(records: DataFrame, name: str = "row_index") -> DataFrame:
    """Scanned records with their places under a name."""
    return records.withColumnRenamed("row_index", name)


def ragged(records: DataFrame, limit: int = EXAMPLES) -> tuple[int, DataFrame]:
    """Number of records whose field count isn't the header's, and (row, fields) of the first. records: indexed."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"row": b["row_index"] + 2, "fields": [len(next(csv.reader([t]), [])) for t in b[CORRUPT]]})

    whole = F.length(F.concat_ws("", *(c for c in records.columns if c.startswith("_c")))) >= 0  # keeps the parse from being pruned
    bad = records.filter(F.col(CORRUPT).isNotNull() & whole).select("row_index", CORRUPT)
    first = bad.orderBy("row_index").limit(limit).mapInPandas(count, "row long, fields int")
    return bad.count(), first


@dataclass(frozen=True)
class EncodingVerdict:
    """verdict: utf-8, legacy or mixed; samples: (row, column, under windows-1252, under mac-roman) of the first fields that aren't UTF-8."""

    verdict: str
    valid: int
    invalid: int
    samples: list[tuple]


def bad_utf8(records: DataFrame) -> Column:
    """Whether a scanned record has bytes that aren't UTF-8; strict reading refuses such files."""
    return ~F.col(VALID)


@dataclass(frozen=True)
class Inspection:
    """What is known of a file before it is imported."""

    headers: tuple[str, ...]
    size_bytes: int
    rows: int
    encoding: EncodingVerdict
    ragged: int
    ragged_rows: list[tuple]
    preview: list[tuple]


def inspect(spark: SparkSession, path: str, max_bytes: int | None = None, limit: int = EXAMPLES) -> Inspection:
    """What a file is: one pass over it once its records are found.

    Counts are observed beside the scan; of each kind of record that is shown, the first ones are kept task by task.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if max_bytes is not None and size > max_bytes:
        raise SpecError(f"the file has {size} bytes; at most {max_bytes} are read")
    names = headers(spark, path, WINDOWS_1252)
    columns = [f"_c{i}" for i in range(len(names))]
    # the bytes as characters, from which each encoding's text can be had
    raw = scan(spark, path, len(names), RAW).select("row_index", F.array(*columns).alias("cells"), F.col(CORRUPT).alias("ragged"))
    cells = F.transform("cells", lambda c: F.struct(c.alias("cell"), F.encode(c, "ISO-8859-1").cast("string").alias("text")))
    marked = raw.withColumn("cells", cells).withColumn("foreign", F.expr("transform(filter(sequence(0, size(cells) - 1), i -> cells[i].cell rlike '[^\\\\x00-\\\\x7F]'), i -> struct(i, is_valid_utf8(cells[i].text) as valid))"))
    seen = Observation()
    invalid = F.size(F.filter("foreign", lambda x: ~x["valid"]))
    seen_all = marked.observe(
        seen, F.count("*").alias("rows"), F.count("ragged").alias("ragged"), F.coalesce(F.sum(F.size("foreign") - invalid), F.lit(0)).alias("valid"), F.coalesce(F.sum(invalid), F.lit(0)).alias("invalid"),
    )
    kinds = F.array_compact(F.array(F.when(F.col("ragged").isNotNull(), "ragged"), F.when(invalid > 0, "invalid"), F.when(F.col("row_index") < PREVIEW, "preview")))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("row_index"))
    shown = seen_all.withColumn("kind", F.explode(kinds)).withColumn("rank", rank).filter(F.col("rank") <= max(limit, PREVIEW)).orderBy("kind", "row_index").collect()
    found = seen.get
    top = [_foreign(n) for n in header_cells(spark, path)]
    valid, bad = found["valid"] + sum(t is True for t in top), found["invalid"] + sum(t is False for t in top)
    samples = [(1, i, n) for i, (n, t) in enumerate(zip(header_cells(spark, path), top)) if t is False]
    samples += [(r["row_index"] + 2, x["i"], r["cells"][x["i"]]["cell"]) for r in shown if r["kind"] == "invalid" for x in r["foreign"] if not x["valid"]]
    read = {e: str.maketrans("".join(map(chr, range(128, 256))), upper_half(e)) for e in CODEPAGES}
    verdict = EncodingVerdict(UTF8 if not bad else "mixed" if valid else "legacy", valid, bad, [(row, i, cell.translate(read[WINDOWS_1252]), cell.translate(read[MAC_ROMAN])) for row, i, cell in samples[:limit]])
    fits = verdict.verdict == UTF8
    preview = [tuple(c["text"] if fits else c["cell"].translate(read[WINDOWS_1252]) for c in r["cells"]) for r in shown if r["kind"] == "preview"]
    cut = spark.createDataFrame([(i, *r) for i, r in enumerate(preview)], ", ".join(["i int", *(f"{c} string" for c in columns)])).orderBy("i").select(*(truncated(F.col(c)).alias(c) for c in columns)) if preview else None
    ragged_rows = [(r["row_index"] + 2, len(next(csv.reader(io.StringIO(r["ragged"], newline="")), []))) for r in shown if r["kind"] == "ragged"][:limit]
    return Inspection(headers(spark, path, UTF8) if fits else names, size, found["rows"], verdict, found["ragged"], ragged_rows, [tuple(r) for r in cut.collect()] if cut is not None else [])


def header_cells(spark: SparkSession, path: str) -> list[str]:
    """The header's cells with a character for each byte."""
    return next(csv.reader(io.StringIO(header_bytes(spark, path).removeprefix(b"\xef\xbb\xbf").decode("latin-1"), newline="")), [])


def _foreign(cell: str) -> bool | None:
    """Whether a cell's bytes are UTF-8; None for plain ASCII."""
    if cell.isascii():
        return None
    try:
        return bool(cell.encode("latin-1").decode())
    except UnicodeDecodeError:
        return False


def courses(records: DataFrame, layout: Layout, max_field_bytes: int = MAX_FIELD_BYTES) -> DataFrame:
    """Indexed records as row_index, the three fields (cut and trimmed) and extra_columns (cut, by position; null where there is no such column)."""
    cut = lambda i: truncated(F.col(f"_c{i}"), max_field_bytes)
    fields = [trim(cut(i)).alias(f) for i, f in zip(layout.mapping.positions(), FIELDS)]
    rest = layout.unmapped()
    pairs = [x for i in rest for x in (F.lit(str(i)), cut(i))]
    extras = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    return records.select("row_index", *fields, extras.alias("extra_columns"))


def oversized(records: DataFrame, width: int, max_field_bytes: int = MAX_FIELD_BYTES) -> Column:
    """Fields of a record that were cut."""
    return reduce(lambda a, b: a + b, ((F.octet_length(f"_c{i}") > max_field_bytes).cast("long") for i in range(width)))


def panel(spark: SparkSession, path: str, required: Iterable[str], multiple: str = "Multiple Course?") -> DataFrame:
    """An evaluation panel: all columns as text; rows that lack a required value, or are flagged as several courses, are left out."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SpecError(f"the panel lacks {missing}")
    df = df.dropna(subset=list(required))
    return df.filter(~F.coalesce(F.lower(trim(F.col(multiple))), F.lit("")).isin("y", "yes", "1", "true")) if multiple in df.columns else df


def taxonomy(spark: SparkSession, two_digit: str, six_digit: str | None = None) -> DataFrame:
    """One table from (code, title, title_short) and (code, title, description) files."""
    read = lambda path, third, level: spark.read.schema(f"code string, title string, {third} string").option("header", True).option("escape", '"').csv(path).withColumn("digit_level", F.lit(level).cast("byte"))
    out = read(two_digit, "title_short", 2)
    if six_digit:
        out = out.unionByName(read(six_digit, "description", 6), allowMissingColumns=True)
    columns = ["digit_level", "code", "title", "title_short", "description"]
    return out.select(*(F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in columns))


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, digest) of each file: SHA-256 of its bytes, streamed one file at a time, so that no size is too large."""
    jvm, out = spark._jvm, []
    for size, name in ((r["length"], r["path"]) for r in spark.read.format("binaryFile").load(path).select("length", "path").collect()):
        there = jvm.org.apache.hadoop.fs.Path(name)
        stream = there.getFileSystem(spark._jsc.hadoopConfiguration()).open(there)
        try:
            out.append((name, size, jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    return spark.createDataFrame(out, "path string, size_bytes long, digest string")


def source_digest(spark: SparkSession, path: str) -> tuple[str, int]:
    """Digest and size of what is read: of a file its own, of a folder the digest of its files' digests in the order of their paths."""
    files = file_digest(spark, path).orderBy("path").collect()
    size = sum(f["size_bytes"] for f in files)
    return files[0]["digest"] if len(files) == 1 else hashlib.sha256("".join(f["digest"] for f in files).encode()).hexdigest(), size
