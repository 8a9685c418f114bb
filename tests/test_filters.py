import pytest

from taxospark.operators import explore, filters
from taxospark.schemas import COURSES, ColumnMap, FilterRow, FilterSpec, Layout, Op, Source, SpecError
from tests.conftest import rows

A = Source("a", "A", Layout(("SUBJ", "NUM", "TITLE", "SCHOOL"), ColumnMap(0, 1, 2)))
B = Source("b", "B", Layout(("School", "sub_pref", "course", "ttl", "YEAR"), ColumnMap(1, 2, 3)))


@pytest.fixture(scope="module")
def courses(spark):
    return spark.createDataFrame(
        [
            ("a", 0, "ACCT", "101", "Intro Accounting", {"3": "Ross"}, "h0"),
            ("a", 1, " acct ", "201", "50% off", {"3": "Ross"}, "h1"),
            ("a", 2, "MATH", "101", "Calculus", None, "h2"),
            ("b", 0, "ACC", "301", "Tax", {"0": "Wharton", "4": "2024"}, "h3"),
            ("b", 1, "ACC", "301", "Tax", {"0": "Wharton", "4": "2024"}, "h3"),
        ],
        COURSES,
    )


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame([(6, "h0", "52.0301", 0.5), (6, "h3", "52.1601", 0.5)], "model_id long, content_hash string, classification string, probability double")


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame([(2, "52", "Business", "Bus", None), (6, "52.0301", "Accounting", None, "Ledgers")], "digit_level int, code string, title string, title_short string, description string")


def test_column_keys_number_repeats():
    layout = Layout(("School", "SUBJ", "NUM", "TITLE", " Notes", "notes ", "NOTES"), ColumnMap(1, 2, 3))
    assert layout.keys() == {"school": 0, "notes": 4, "notes #2": 5, "notes #3": 6}


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ([], [0, 1, 2]),
        ([("subject_code", Op.IS, ("acct",))], [0, 1]),
        ([("subject_code", Op.IS, ("ACC", " math"))], [2]),
        ([("subject_code", Op.IS_NOT, ("ACCT",))], [2]),
        ([("course_title", Op.CONTAINS, ("calc",))], [2]),
        ([("course_title", Op.CONTAINS, ("50%",))], [1]),
        ([("course_title", Op.CONTAINS, ("%",))], [1]),
        ([("course_title", Op.NOT_CONTAINS, ("acc", "'"))], [1, 2]),
        ([("catalog_number", Op.STARTS_WITH, ("1",))], [0, 2]),
        ([("column:school", Op.IS_EMPTY, ())], [2]),
        ([("column:school", Op.IS_NOT_EMPTY, ())], [0, 1]),
        ([("column:school", Op.IS_NOT, ("ross",))], [2]),
        ([("subject_code", Op.IS, ("ACCT",)), ("catalog_number", Op.IS, ("201",))], [1]),
        ([("code:6", Op.IS, ("52.0301",))], [0]),
        ([("code:6", Op.STARTS_WITH, ("52",))], [0]),
        ([("code:6", Op.IS_NOT, ("52.0301",))], []),
    ],
)
def test_operators(courses, results, spec, want):
    found = filters.apply(courses, FilterSpec(tuple(FilterRow(*r) for r in spec)), [A], results, {6: 6})
    assert [r[0] for r in rows(found, "row_index")] == want


def test_columns_and_sources_across_datasets(courses):
    school = FilterSpec((FilterRow("column:school", Op.IS, ("wharton", "ross")),))
    assert rows(filters.apply(courses, school, [A, B]), "dataset_id", "row_index") == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    year = FilterSpec((FilterRow("column:year", Op.IS_EMPTY),))
    assert rows(filters.apply(courses, year, [A, B]), "dataset_id", "row_index") == [("a", 0), ("a", 1), ("a", 2)]
    other = FilterSpec((FilterRow("source", Op.IS_NOT, ("a",)),))
    assert rows(filters.apply(courses, other, [A, B]), "dataset_id", "row_index") == [("b", 0), ("b", 1)]


@pytest.mark.parametrize(
    "spec",
    [
        [("subject_code", Op.IS, ())],
        [("subject_code", Op.IS, (" ",))],
        [("subject_code", Op.IS_EMPTY, ("x",))],
        [("code:3", Op.IS, ("1",))],
        [("code:6", Op.IS_EMPTY, ())],
        [("code:2", Op.IS, ("52",))],
        [("source", Op.IS, ("a",))],
        [("source", Op.CONTAINS, ("a",))],
        [("column:nope", Op.IS, ("a",))],
        [("nope", Op.IS, ("a",))],
        [("subject_code", Op.IS, ("x",) * 257)],
        [("subject_code", Op.IS, ("x",))] * 65,
    ],
)
def test_malformed_filters_are_refused(courses, results, spec):
    with pytest.raises(SpecError):
        filters.apply(courses, FilterSpec(tuple(FilterRow(*r) for r in spec)), [A], results, {6: 6})


def test_pages_pickers_and_coverage(courses, results, taxonomy):
    mine = courses.filter("dataset_id = 'b'")
    assert rows(explore.page(mine, 1, 0), "row_index") == [(1,)]
    assert rows(explore.values(courses, courses.subject_code)) == [("ACC", 2), ("ACCT", 1), ("MATH", 1), ("acct", 1)]
    assert rows(explore.code_values(courses, results, taxonomy, 6, 6)) == [("52.0301", "Accounting", 1), ("52.1601", "Business", 2)]
    assert rows(explore.code_values(courses, results, taxonomy, 6, 6, "busi")) == [("52.1601", "Business", 2)]
    assert rows(explore.coverage(courses, results, {6: 6, 2: 2})) == [(2, 0, 5), (6, 3, 5)]
    got = rows(explore.attach(explore.page(courses.drop("extra_columns")), results, taxonomy, {6: 6}), "dataset_id", "row_index", "title", "title_short", "description", "title_level")
    assert got[0] == ("a", 0, "Accounting", None, "Ledgers", 6) and got[1] == ("b", 0, "Business", "Bus", None, 2)


@pytest.mark.parametrize(("done", "total", "want"), [(0, 5, None), (0, 0, None), (5, 5, 100), (999, 1000, 99), (1, 3, 33)])
def test_percent(spark, done, total, want):
    df = spark.createDataFrame([(done, total)], "d long, t long")
    assert df.select(explore.percent(df.d, df.t)).first()[0] == want
