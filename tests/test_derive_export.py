import os

import pytest
from pyspark.sql import functions as F

from taxospark.operators import derive, evaluate, export, maintenance, profiling, ranking
from taxospark.schemas import COURSES, ColumnMap, DeriveRequest, FilterRow, FilterSpec, Layout, Op, OutputColumn, Source, SpecError
from tests.conftest import rows

A = Source("a", "A", Layout(("SUBJ", "NUM", "TITLE", "SCHOOL"), ColumnMap(0, 1, 2)))
B = Source("b", "B", Layout(("School", "sub_pref", "course", "ttl", "YEAR"), ColumnMap(1, 2, 3)))
KNOWN = {"a": A, "b": B, "old": Source("old", "Old"), "new": Source("new", "New", A.layout, "importing")}
SCHOOL = OutputColumn("School", (("a", 3), ("b", 0)))


@pytest.fixture(scope="module")
def courses(spark):
    return spark.createDataFrame(
        [
            ("a", 0, "ACCT", "101", "Intro", {"3": "Ross"}, "h0"),
            ("a", 1, "ACCT", "101", "Intro", {"3": "Ross"}, "h0"),
            ("a", 2, "MATH", "101", "Calc", {"3": "Ross"}, "h1"),
            ("b", 0, "ACC", "201", "Tax", {"0": "Wharton", "4": "2024"}, "h2"),
            ("b", 1, "ACCT", "101", "Intro", {"0": "Wharton", "4": "2024"}, "h0"),
        ],
        COURSES,
    )


@pytest.mark.parametrize(
    ("request_", "why"),
    [
        (DeriveRequest(()), "at least one"),
        (DeriveRequest(("a", "a")), "listed twice"),
        (DeriveRequest(("a", "gone")), "no longer exists"),
        (DeriveRequest(("old",)), "before column layouts were stored"),
        (DeriveRequest(("new",)), "isn't ready"),
        (DeriveRequest(("a", "b"), (OutputColumn("Subject_Code", (("a", 3),)),)), "both named"),
        (DeriveRequest(("a",), (OutputColumn(" ", (("a", 3),)),)), "needs a name"),
        (DeriveRequest(("a",), (OutputColumn("Source_Dataset", (("a", 3),)),)), "reserved"),
        (DeriveRequest(("a",), (OutputColumn("x"),)), "no source column"),
        (DeriveRequest(("a",), (OutputColumn("x", (("b", 0),)),)), "isn't a source"),
        (DeriveRequest(("a",), (OutputColumn("x", (("a", 0),)),)), "doesn't have"),
        (DeriveRequest(("b",), (OutputColumn("x", (("b", 0), ("b", 4))),)), "takes two columns"),
        (DeriveRequest(("a",), (OutputColumn("x", (("a", 3),)), OutputColumn("y", (("a", 3),)))), "feeds two columns"),
        (DeriveRequest(("a",), dedupe=("nope",)), "isn't a column"),
        (DeriveRequest(("a",), dedupe=()), "at least one column"),
    ],
)
def test_rules(request_, why):
    with pytest.raises(SpecError, match=why):
        derive.plan(request_, KNOWN)


def test_default_columns_merge_by_key():
    assert derive.default_columns([A, B]) == [OutputColumn("SCHOOL", (("a", 3), ("b", 0))), OutputColumn("YEAR", (("b", 4),))]
    assert [c.name for c in derive.default_columns([A, B], "common")] == ["SCHOOL"]


def test_merge_keys_extras_anew(courses):
    p = derive.plan(DeriveRequest(("b", "a"), (SCHOOL, OutputColumn("Year", (("b", 4),)))), KNOWN)
    assert p.layout.headers == ("subject_code", "catalog_number", "course_title", "School", "Year", "source_dataset")
    merged = derive.merged(p, courses)
    got = [r["extra_columns"] for r in merged.orderBy("src_pos", "row_index").collect()]
    assert got == [{"3": "Wharton", "4": "2024", "5": "B"}] * 2 + [{"3": "Ross", "5": "A"}] * 3
    assert rows(derive.source_counts(p, merged)) == [("a", 1, 3), ("b", 0, 2)]


def test_dedupe_filters_and_renumbers(courses):
    p = derive.plan(DeriveRequest(("a", "b"), (SCHOOL,), FilterSpec((FilterRow("subject_code", Op.STARTS_WITH, ("acc",)),)), dedupe=("subject_code", "course_title")), KNOWN)
    out = derive.materialized(p, derive.merged(p, courses), "d")
    assert rows(out, "dataset_id", "row_index", "subject_code", "content_hash") == [("d", 0, "ACCT", "h0"), ("d", 1, "ACC", "h2")]
    by_source = derive.plan(DeriveRequest(("a", "b"), (), dedupe=("subject_code", "source_dataset")), KNOWN)
    assert derive.deduped(by_source, derive.merged(by_source, courses)).count() == 4


def test_dedupe_keys_are_exact(spark):
    df = spark.createDataFrame([("a", i, s, "1", "t", None, "h") for i, s in enumerate(["x", "X", None, None, ""])], COURSES)
    p = derive.plan(DeriveRequest(("a",), (), dedupe=("subject_code",)), KNOWN)
    assert [r[0] for r in rows(derive.deduped(p, derive.merged(p, df)), "row_index")] == [0, 1, 2, 4]


def test_numbering_is_gapless(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k")
    assert [tuple(r) for r in ranking.numbered(df, ["k"], "place").orderBy("place").select("place", "k").collect()] == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("size", [256, 2048])
def test_numbering_of_wide_rows_as_written(spark, tmp_path, size):
    n = 20_000
    df = spark.range(n, numPartitions=9).select(((F.col("id") * 7919) % n).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), size // 64).alias("wide"), F.lit(1).alias("_part"), F.lit(2).alias("_place"))
    ranking.numbered(df, ["k"], "place").write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns == ["k", "wide", "_part", "_place", "place"]
    assert out.count() == n and out.filter("place != k or _part != 1 or _place != 2").isEmpty()
    assert ranking.numbered(df.filter("k < 0"), ["k"], "place").isEmpty()


RESULT = "model_id long, content_hash string, classification string, probability float, " + ", ".join(f"top{k}_code string, top{k}_prob float" for k in range(2, 6))


@pytest.fixture(scope="module")
def coded(spark):
    results = spark.createDataFrame([(7, "h1", "45.0601", 0.99, "45.0602", 0.005, "27.0101", 0.002, "11.0701", 0.001, "26.0101", 0.0005)], RESULT)
    taxonomy = spark.createDataFrame([(6, "45.0601", "Economics, General"), (6, "27.0101", "Mathematics"), (2, "45", "Social Sciences"), (2, "27", "Math")], "digit_level int, code string, title string")
    return results, taxonomy


def read(path):
    import csv
    import glob

    out = []
    for f in sorted(glob.glob(f"{path}/part-*")):
        out += list(csv.reader(open(f, newline="", encoding="utf-8")))
    return out


def test_legacy_export(spark, coded, tmp_path):
    df = spark.createDataFrame([("ds", 0, "ECON", "101", '=HYPERLINK("x")', "A", "2024", "h1"), ("ds", 1, "MATH", "201", "Calculus", "A", "2024", "h2")], "dataset_id string, row_index long, subject_code string, catalog_number string, course_title string, school_name string, school_year_enrolled string, content_hash string")
    header, out = export.export(df, *coded, [(6, 7)])
    assert export.write_csv(header, out, f"{tmp_path}/x") == 2
    lines = read(f"{tmp_path}/x")
    assert lines[0] == ["row_index", "subject_code", "catalog_number", "course_title", "school_name", "school_year_enrolled", "ccm6digit_code", "ccm6digit_prob", "ccm6digit_title"]
    assert ["0", "ECON", "101", "'=HYPERLINK(\"x\")", "A", "2024", "45.0601", "0.99", "Economics, General"] in lines
    assert ["1", "MATH", "201", "Calculus", "A", "2024", "", "", ""] in lines


def test_original_layout_with_repeated_headers(spark, coded, tmp_path):
    df = spark.createDataFrame([("ds", 0, "ECON", "101", "Micro", {"1": "Fall 2024", "4": "=EVIL()"}, "h1")], COURSES)
    layout = Layout(("sub_pref", "notes", "course", "title", "notes"), ColumnMap(0, 2, 3))
    header, out = export.export(df, *coded, [(6, 7)], layout=layout, top=True)
    assert header[:8] == ["sub_pref", "notes", "course", "title", "notes", "ccm6digit_code", "ccm6digit_prob", "ccm6digit_title"]
    export.write_csv(header, out, f"{tmp_path}/x")
    lines = read(f"{tmp_path}/x")
    assert lines[0] == header and lines[1][:8] == ["ECON", "Fall 2024", "101", "Micro", "'=EVIL()", "45.0601", "0.99", "Economics, General"]
    got = dict(zip(header, lines[1]))
    assert (got["ccm6digit_code1"], got["ccm6digit_code2"], got["ccm6digit_title2"], got["ccm6digit_title3"]) == ("45.0601", "45.0602", "Social Sciences", "Mathematics")


@pytest.mark.parametrize("header", [["a", "b"], ["a", "a"]])
def test_every_part_has_the_header_and_cells_keep_white_space(spark, tmp_path, header):
    cells = spark.range(20).repartitionByRange(4, "id").sortWithinPartitions("id").select(F.col("id"), F.concat(F.lit("  x,\"y\" "), "id", F.lit(" ")))
    assert export.write_csv(header, cells, f"{tmp_path}/x") == 20
    lines = read(f"{tmp_path}/x")
    parts = len([f for f in os.listdir(f"{tmp_path}/x") if f.startswith("part-")])
    assert parts == 4 and lines.count(header) == parts
    assert [x for x in lines if x != header] == [[str(i), f'  x,"y" {i} '] for i in range(20)]


def test_unique_export_and_rules(spark, coded, courses):
    header, out = export.export(courses.filter("dataset_id = 'a'"), *coded, [(2, 1), (4, 2)], unique=True)
    assert header == ["subject_code", "catalog_number", "course_title", "ccm2digit_code", "ccm2digit_prob", "ccm2digit_title", "ccm4digit_code", "ccm4digit_prob"]
    assert [r["c0"] for r in out.collect()] == ["ACCT", "MATH"]
    for wrong in ([], [(6, 1), (6, 2)], [(3, 1)]):
        with pytest.raises(SpecError):
            export.export(courses, *coded, wrong)
    assert export.file_name("My Set 1", [6], True) == "my-set-1-6-digit-unique.csv"
    assert export.file_name("My Set 1", [2, 6]) == "my-set-1-ccm-all-levels.csv"


def test_upkeep(spark):
    results = spark.createDataFrame([(m, h) for m in (1, 2) for h in ("kept", "gone")], "model_id long, content_hash string")
    courses = spark.createDataFrame([("kept",)], "content_hash string")
    assert rows(maintenance.cache_usage(results, courses, [2])) == [(4, 2, 2)]
    assert rows(maintenance.cache_usage(results, courses, [])) == [(4, 0, 2)]
    assert rows(maintenance.without_unreferenced(results, courses)) == [(1, "kept"), (2, "kept")]
    same = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    assert rows(maintenance.tables_equal(same, same)) == [(3, 3, 0, 0, True)]
    assert rows(maintenance.tables_equal(same, same.distinct())) == [(3, 2, 1, 0, False)]


def test_evaluation(spark):
    df = spark.createDataFrame([(0, "52.1005", "521005"), (1, "52.1005", "521006"), (2, "52.1005", "")], "i int, p string, t string")
    assert rows(evaluate.agreement(df, "p", "t", 6)) == [(2, 1, 1, 0.5)]
    assert rows(evaluate.disagreements(df, "p", "t", 6), "i") == [(1,)]
    course = spark.createDataFrame([("PSYC", "4304L", "INTRO TO PSYC", 0)], "subject_code string, catalog_number string, course_title string, row_index long")
    got = dict(rows(evaluate.perturbed(course), "variant", "input"))
    assert len(got) == 18 and got["catalog letters stripped (`4304L` -> `4304`)"] == "PSYC 4304 --- INTRO TO PSYC" and got["title in Title Case"] == "PSYC 4304L --- Intro To Psyc" and got["title only"] == "  --- INTRO TO PSYC"
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1.0])], "k int, logits array<double>")
    b = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "k int, logits array<double>")
    assert evaluate.parity(a, a, "k").first()["passed_strict"] is True
    assert evaluate.parity(a, b, "k").first()["passed"] is False
    assert "| 2 |" in evaluate.markdown(evaluate.agreement(df, "p", "t", 6), "Agreement")


def test_disagreements_are_logged_as_csv(spark, tmp_path):
    df = spark.createDataFrame([(0, "01", "01", {"3": "x"}), (1, "02", "01", {"3": 'a "b", c'}), (2, "03", "zz", None), (3, "03", "04", None)], "row_index long, code string, truth string, extra map<string,string>")
    assert evaluate.write_disagreements(df, "code", "truth", 2, str(tmp_path / "log")) == 2
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "log"))
    assert rows(back, "row_index", "code", "truth", "extra", "predicted_number", "truth_number") == [("1", "02", "01", '{"3":"a \\"b\\", c"}', "2.0", "1.0"), ("3", "03", "04", None, "3.0", "4.0")]


def test_examples_are_the_first_records_without_a_row_for_every_hit(spark):
    made = spark.range(500, numPartitions=5).selectExpr("499 - id AS row_index", "if(id % 7 = 0, ' ', 'ECON12') AS subject_code", "if(id % 3 = 0, '1', '1234') AS catalog_number", "'Title' AS course_title")
    found = profiling.examples(profiling.prepared(made), 3)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    of = lambda code: [r["row"] for r in found.filter(F.col("code") == code).orderBy("rank").collect()]
    told = [(r, (499 - r) % 7 == 0, (499 - r) % 3 == 0) for r in range(500)]
    assert of("skipped") == [r + 2 for r, no, _ in told if no][:3]
    assert of("catalog_short") == [r + 2 for r, no, short in told if not no and short][:3]
