import csv
import io
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taxospark.operators import evaluate, export, importing, maintenance, profiling, scoring
from taxospark.operators.store import Store
from taxospark.plans.queries import first_digit
from taxospark.schemas import FIELDS, ColumnMap, Layout, SpecError
from taxospark.sources import delimited
from taxospark.streaming import ingest
from tests.conftest import rows

HEAD = b"sub_pref,course,course_title\r\n"
LABELS = [str(i) for i in range(16)]


def put(tmp_path, data, name="x.csv"):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def records(spark, path, encoding=delimited.UTF8):
    names = delimited.headers(spark, path, encoding)
    layout = Layout(names, delimited.detect_mapping(names))
    return delimited.courses(delimited.indexed(delimited.scan(spark, path, len(names), encoding)), layout)


def test_mapping_prefers_earlier_aliases():
    assert delimited.detect_mapping(["Dept", "NUMBER", "subject", "course", "Name", "Title"]) == ColumnMap(2, 3, 5)
    with pytest.raises(SpecError):
        delimited.detect_mapping(["subject_xyz", "course", "title"])


@pytest.mark.parametrize("bom", [b"", b"\xef\xbb\xbf"])
def test_utf8(spark, tmp_path, bom):
    path = put(tmp_path, bom + HEAD + "ECON,101,Café Economics\r\n".encode())
    assert delimited.headers(spark, path)[0] == "sub_pref"
    found = delimited.inspect(spark, path)
    assert (found.encoding.verdict, found.rows, found.ragged) == ("utf-8", 1, 0)
    assert rows(records(spark, path), *FIELDS) == [("ECON", "101", "Café Economics")]


def test_legacy_codepages(spark, tmp_path):
    path = put(tmp_path, HEAD + b"A,1,x\r\nB,2,y\r\nC,3,Brand\xa8\r\n")
    verdict = delimited.inspect(spark, path).encoding
    assert verdict.verdict == "legacy" and verdict.samples == [(4, 2, "Brand¨", "Brand®")]
    assert rows(records(spark, path, delimited.MAC_ROMAN), "course_title")[0] == ("Brand®",)


def test_mixed_encodings(spark, tmp_path):
    path = put(tmp_path, HEAD + b"A,1,caf\xc3\xa9\r\nB,2,x\xaey\r\n")
    verdict = delimited.inspect(spark, path).encoding
    assert (verdict.verdict, verdict.valid, verdict.invalid) == ("mixed", 1, 1)


@pytest.mark.parametrize("data", [HEAD.decode().encode("utf-16"), HEAD.decode().encode("utf-16-le")])
def test_utf16_is_refused(spark, tmp_path, data):
    with pytest.raises(SpecError, match="UTF-16"):
        delimited.headers(spark, put(tmp_path, data))


def test_ragged_rows_are_reported(spark, tmp_path):
    path = put(tmp_path, HEAD + b"A,1,x\r\nB,2\r\nC,3,y,z\r\n")
    found = delimited.inspect(spark, path)
    assert (found.rows, found.ragged, found.ragged_rows) == (3, 2, [(3, 2), (4, 4)])
    with pytest.raises(SpecError, match="2 records"):
        importing.import_csv(spark, Store(spark, str(tmp_path / "s")), path, "d", "D")


def test_resaving_keeps_hashes(spark, tmp_path):
    legacy = put(tmp_path, HEAD + b"A,1,x\xae\x97y\r\n", "a.csv")
    resaved = put(tmp_path, HEAD + "A,1,x®—y\r\n".encode(), "b.csv")
    a = importing.imported(records(spark, legacy, delimited.WINDOWS_1252), "d")
    b = importing.imported(records(spark, resaved), "d")
    assert rows(a, "content_hash") == rows(b, "content_hash")


def test_import_profile_and_extras(spark, tmp_path):
    path = put(tmp_path, b'note,sub_pref,course,course_title,Note\r\n n1 ,ECON,101,"Micro, ""A""",\r\nn2,ECON,102,,x\r\nn3, ,103,Macro,y\r\nn4,ECON,101,"Micro, ""A""",z\r\nn5,MATH,201,Calc,\r\n')
    store = Store(spark, str(tmp_path / "store"))
    assert importing.import_csv(spark, store, path, "d", "D") == 3
    got = rows(store.courses(), "row_index", "subject_code", "course_title", "extra_columns")
    assert got == [(0, "ECON", 'Micro, "A"', {"0": " n1 ", "4": ""}), (3, "ECON", 'Micro, "A"', {"0": "n4", "4": "z"}), (4, "MATH", "Calc", {"0": "n5", "4": ""})]
    assert importing.import_csv(spark, store, path, "e", "E", limit=2) == 2
    report = profiling.profile(records(spark, path))
    assert (report["rows"], report["importable"], report["skipped"], report["skipped_title"]) == (5, 3, 2, 1)
    assert [e["row"] for e in report["skipped_examples"]] == [3, 4]
    assert report["columns"]["subject"]["empty"] == 1 and report["columns"]["subject"]["top"][0]["value"] == "ECON"
    assert report["samples"] == profiling.profile(records(spark, path))["samples"] and len(report["samples"]) == 2


def test_dry_run(spark, tmp_path):
    path = put(tmp_path, HEAD + b"A,1," + b"x" * 9000 + b"\r\nB,2\r\n,3,z\r\n")
    report = importing.validate(spark, path)
    assert (report["truncated_fields"], report["ragged"], report["ragged_rows"]) == (1, 1, [(3, 2)])
    assert report["profile"]["rows"] == 3 and report["profile"]["skipped_subject"] == 1 and len(report["preview"]) == 3


def test_label_agreement(spark):
    import hashlib

    told = [int(hashlib.sha256(f"A {i % 3} --- T".encode()).hexdigest()[0], 16) for i in range(6)]
    df = spark.createDataFrame([(i, "A", str(i % 3), "T", str(told[i]) if i < 5 else "99") for i in range(6)], "row_index long, subject_code string, catalog_number string, course_title string, truth string")
    assert rows(evaluate.label_agreement(df, "truth", 2, LABELS, first_digit)) == [(6, 5, 0, 5 / 6)]


def test_row_numbers_follow_file_order(spark, tmp_path):
    path = put(tmp_path, HEAD + b"".join(b"S,%d,title number %d\r\n" % (i, i) for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = records(spark, path)
        assert found.count() == 20_000
        assert found.filter(F.col("row_index") != F.col("catalog_number").cast("long")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize(("n", "fires"), [(4, False), (5, True)])
def test_thresholds(spark, n, fires):
    df = spark.createDataFrame([(i, "ECON", "ABC" if i < n else "101", "MICRO") for i in range(100)], "row_index long, subject_code string, catalog_number string, course_title string")
    assert ("catalog_no_digits" in [r[0] for r in profiling.findings(profiling.prepared(df)).select("code").collect()]) is fires


@pytest.mark.parametrize(("n", "fires"), [(999, False), (1000, True)])
def test_dataset_checks_need_rows(spark, n, fires):
    df = spark.createDataFrame([(i, f"S{i}", "101", "MICRO") for i in range(n)], "row_index long, subject_code string, catalog_number string, course_title string")
    found = {r["code"]: r["count"] for r in profiling.findings(profiling.prepared(df)).collect()}
    assert ("catalog_low_cardinality" in found) is fires and ("subject_high_cardinality" in found) is fires


def test_a_failed_run_resumes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(i, "TEST", f"{i % 300:03d}", f"Course number {i % 300}", None) for i in range(600)], "row_index long, subject_code string, catalog_number string, course_title string, extra_columns map<string,string>")
    store.write_courses(importing.imported(df, "d"))
    with pytest.raises(SpecError, match="isn't ready"):
        scoring.classify(store, "d", [])
    store.add_dataset(id="d", title="D", import_state="ready", row_count=600)

    def stop(level, bucket):
        if bucket == 2:
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        scoring.classify(store, "d", [(2, 1, LABELS, first_digit)], buckets=4, before_bucket=stop)
    part = store.results().count()
    assert 0 < part < 300 and rows(store.datasets(), "classify_state") == [("failed",)]

    def ask(level, bucket):
        raise scoring.Stopped

    assert scoring.classify(store, "d", [(2, 1, LABELS, first_digit)], buckets=4, before_bucket=ask) == 0
    assert rows(store.latest_datasets(), "id", "classify_state") == [("d", "stopped")]
    assert scoring.classify(store, "d", [(2, 1, LABELS, first_digit)], buckets=4) == 300 - part
    assert scoring.classify(store, "d", [(2, 1, LABELS, first_digit)], buckets=4) == 0
    assert store.results().select("content_hash").distinct().count() == 300
    assert maintenance.prune_superseded(store, [9]) == 300 and store.results().count() == 0


def test_deleting_a_dataset(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for name in ("a", "b"):
        df = spark.createDataFrame([(0, "S", "1", f"T{name}", None)], "row_index long, subject_code string, catalog_number string, course_title string, extra_columns map<string,string>")
        store.write_courses(importing.imported(df, name))
        store.add_dataset(id=name, title=name, import_state="ready" if name == "a" else "importing")
    assert maintenance.delete_dataset(store, "a") is True and maintenance.delete_dataset(store, "a") is False
    assert rows(store.courses(), "dataset_id") == [("b",)]
    with pytest.raises(SpecError, match="busy"):
        maintenance.delete_dataset(store, "b")
    assert rows(scoring.swept(store.datasets()), "import_state") == [("failed",)]


def test_continuous_import(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    layout = Layout(("sub_pref", "course", "course_title"), ColumnMap(0, 1, 2))
    for k in range(2):
        put(folder, HEAD + b"A,1,x\r\nB,%d,y\r\n,3,z\r\n" % k, f"{k}.csv")
        ingest.import_stream(spark, store, str(folder), layout, "live", str(tmp_path / "ck"), (2, 1, LABELS, first_digit)).awaitTermination(60)
    assert store.courses().count() == 4
    assert store.results().count() == store.results().select("content_hash").distinct().count() == 3


def expected(data, width):
    """Records of a file as a plain reader gives them: cells of those with `width` fields, None for others; blank lines are none."""
    text = data.decode()
    out, held = [], ""
    for line in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", text):
        held += line
        if held.count('"') % 2 == 0:
            if held.strip("\0\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f "):
                out.append(next(csv.reader(io.StringIO(held, newline=""))))
            held = ""
    return [tuple(r) if len(r) == width else None for r in out[1:]]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_records_by_quote_parity(spark, tmp_path, end):
    """Files with line ends and quotes in fields, cut into blocks of a few bytes, against a plain reader."""
    rng, was = random.Random(end), spark.conf.get("spark.sql.files.maxPartitionBytes")

    def field():
        kind = rng.randrange(6)
        inner = "".join(rng.choice(["a", "bc", " ", "é", "1", ","] + ["\n", "\r\n", '""', "x\n\ny"] * (kind > 3)) for _ in range(rng.randint(0, 9)))
        return f'"{inner}"' if kind > 2 else inner.replace(",", "").strip()

    try:
        for size in (7, 40, 300, 1 << 20):
            lines = ['"na\nme",b,c'] + [",".join([f"k{i}", field(), field()] + ["more"] * (rng.random() < 0.05)) for i in range(80)]
            for k in rng.sample(range(1, 80), 5):
                lines[k] += end + rng.choice(["", "  ", "\t"])
            data = (end.join(lines) + (end if rng.random() < 0.5 else "")).encode()
            folder = tmp_path / f"{size}"
            folder.mkdir()
            (folder / "a.csv").write_bytes(data)
            (folder / "b.csv").write_bytes(("x,y,z" + end + 'only,"one' + end + 'more",r').encode())
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            found = delimited.scan(spark, str(folder), 3).orderBy("row_index").collect()
            want = expected(data, 3) + [("only", f"one{end}more", "r")]
            assert [r["row_index"] for r in found] == list(range(len(want)))
            assert [None if r["_corrupt"] is not None else (r["_c0"], r["_c1"], r["_c2"]) for r in found] == want
            if size < 1000:
                assert delimited.text_lines(spark, str(folder)).rdd.getNumPartitions() > len(data) // (size + 200) // 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_an_open_quote_ends_with_its_file(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    put(folder, b'a,b\n1,"x\ny\n', "1.csv")
    put(folder, b'a,b\n2,z\n', "2.csv")
    found = delimited.record_texts(spark, str(folder)).orderBy("row_index").collect()
    assert [(r[0], bytes(r[1])) for r in found] == [(0, b'1,"x\ny\n'), (1, b"2,z")]
    with pytest.raises(SpecError, match="quote"):
        delimited.headers(spark, put(tmp_path, b'a,"b\n' + b"c\n" * 400))


def test_inspection_shows_the_first_of_each_kind(spark, tmp_path):
    lines = [b"A,%d,x" % i if i % 3 else b"B,%d" % i if i % 2 else b"caf\xe9,%d,\xe8" % i for i in range(200)]
    found = delimited.inspect(spark, put(tmp_path, HEAD + b"\n".join(lines)))
    bad, odd = [i for i in range(200) if i % 3 == 0 and i % 2 == 0], [i for i in range(200) if i % 3 == 0 and i % 2]
    assert (found.rows, found.ragged, found.ragged_rows) == (200, len(odd), [(i + 2, 2) for i in odd[:10]])
    assert (found.encoding.verdict, found.encoding.valid, found.encoding.invalid) == ("legacy", 0, 2 * len(bad))
    assert [(s[0], s[1]) for s in found.encoding.samples] == [(i + 2, c) for i in bad for c in (0, 2)][:10]
    assert found.preview == [("café", "0", "è"), ("A", "1", "x"), ("A", "2", "x"), ("B", "3", ""), ("A", "4", "x")]
    with pytest.raises(SpecError, match="at most 10"):
        delimited.inspect(spark, put(tmp_path, HEAD), max_bytes=10)


def test_compressed_files_come_back_in_order_with_bounded_rows(spark, tmp_path):
    path = str(tmp_path / "compressed")
    made = spark.range(25, numPartitions=2).selectExpr("cast(id AS string) AS a", "repeat('x', 3000) AS b")
    assert export.write_csv(("a", "b"), made, path, compressed=10) == 25
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == 4 and all(f.endswith(".csv.gz") for f in files)
    assert sum(os.path.getsize(f"{path}/{f}") for f in files) < 25 * 300
    back = delimited.scan(spark, path, 2).orderBy("row_index").collect()
    assert [(r["row_index"], r["_c0"], len(r["_c1"])) for r in back] == [(i, str(i), 3000) for i in range(25)]


def test_lines_are_taken_apart_a_stretch_at_a_time(monkeypatch):
    monkeypatch.setattr(delimited, "STRETCH", 64)
    lines = [b"x" * 10] * 40 + [b"y" * 300, b"", b"z"]
    batch = pa.RecordBatch.from_arrays([pa.array(lines), pa.array(["f"] * len(lines)), pa.array([0] * 20 + [7] * (len(lines) - 20))], ["value", "file", "block"])
    found = list(delimited.runs([batch]))
    assert [(k, x) for _, k, part, _ in found for x in part.to_pylist()] == list(zip([0] * 20 + [7] * (len(lines) - 20), lines))
    assert all(sum(map(len, part.to_pylist())) <= 64 + 10 or b"y" * 300 in part.to_pylist() for _, _, part, _ in found)
