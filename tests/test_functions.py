import pytest
from pyspark.sql import functions as F

from taxospark.functions import checks, codes, logits, text
from tests.conftest import rows


def one(spark, column, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([tuple(values)], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("label", "level", "want"),
    [("1", 2, "01"), ("10", 2, "10"), ("45", 2, "45"), ("1.0", 4, "01.00"), ("1.01", 4, "01.01"), ("11.1", 4, "11.10"), ("1.0", 6, "01.0000"), ("1.0101", 6, "01.0101"), ("11.1", 6, "11.1000"), ("12.041", 6, "12.0410"), ("01.0000", 6, "01.0000"), ("123.45678", 6, "123.45678"), ("7.5", 2, "07")],
)
def test_canonical_codes(spark, label, level, want):
    assert one(spark, codes.canonical(F.col("c0"), level), label) == want


@pytest.mark.parametrize(
    ("a", "b", "level", "want"),
    [("52", "52", 2, True), ("5210", "52.1", 4, True), ("521005", "52.1005", 6, True), ("105", "1.05", 4, True), ("", "52", 2, False), ("nan", "nan", 2, False), ("x", "1", 2, False), (" 52 ", "52", 2, True), ("52.x", "52", 2, False)],
)
def test_codes_match(spark, a, b, level, want):
    assert one(spark, codes.match(F.col("c0"), F.col("c1"), level), a, b) is want


@pytest.mark.parametrize(("value", "want"), [("PSYC", "A+"), ("4304L", "9+A"), ("B A", "A_A"), ("101.0", "9+.9"), ("Intro", "Aa+"), ("a_ b", "a_+a"), ("+9A", "+9A"), ("", ""), ("ÀÉ ñ", "A+_a")])
def test_shapes(spark, value, want):
    assert one(spark, text.shape(F.col("c0")), value) == want


def test_hostile_shape_is_cut(spark):
    assert len(one(spark, text.shape(F.col("c0")), "a1" * 10_000)) <= 256


def test_truncation_keeps_characters_whole(spark):
    assert one(spark, text.truncated(F.col("c0"), 4), "aé€x") == "aé"
    assert one(spark, text.truncated(F.col("c0"), 4), "abcd") == "abcd"
    assert one(spark, text.truncated(F.col("c0"), 3), "a\U0001f600") == "a"


@pytest.mark.parametrize(("value", "want"), [("=1+1", "'=1+1"), ("+1", "'+1"), ("-1", "'-1"), ("@x", "'@x"), ("\tx", "'\tx"), ("\rx", "'\rx"), ("x=1", "x=1"), ("", "")])
def test_formula_cells(spark, value, want):
    assert one(spark, text.formula_safe(F.col("c0")), value) == want


def test_trims_differ(spark):
    assert one(spark, text.trim(F.col("c0")), "  \t x y\n ") == "x y"
    assert one(spark, text.normalized(F.col("c0")), "  X \t") == "x \t"
    assert one(spark, text.normalized(F.col("c0")), None) == ""
    assert one(spark, text.folded(F.col("c0")), "Women’s — “A”…") == "women's - \"a\"..."
    assert one(spark, text.title_case(F.col("c0")), "INTRO to they're 2ND") == "Intro To They'Re 2Nd"


def test_assembled_text_is_null_with_a_part(spark):
    assert one(spark, text.assembled(F.col("c0"), F.col("c1"), F.col("c2")), "A", "1", "T") == "A 1 --- T"
    assert one(spark, text.assembled(F.col("c0"), F.col("c1"), F.col("c2")), "A", None, "T") is None


HITS = [
    (("PSYC", "4325", "ABNORMAL PSYCHOLOGY"), []),
    (("B A", "1301", "INTRO TO BUSINESS"), []),
    (("BIOL", "4304L", "GENETICS LAB"), []),
    (("PSYC", "PSYC 4325", "ABNORMAL PSYCHOLOGY"), ["catalog_has_subject_prefix", "catalog_has_whitespace", "catalog_too_long"]),
    (("ECON", "psyc4325", "T"), ["catalog_has_subject_prefix", "title_short"]),
    (("CE", "CE-101", "STATICS"), ["catalog_has_subject_prefix"]),
    (("ECON 101", "101", "MICRO"), ["subject_has_number"]),
    (("ECON", "ABC", "MICRO"), ["catalog_no_digits"]),
    (("ECON", "123456789", "MICRO"), ["catalog_too_long"]),
    (("ECONOMICS", "101", "MICRO"), ["subject_too_long"]),
    (("ECON", "101", "12345"), ["title_no_letters"]),
    (("ECON", "101", "X" * 101), ["title_too_long"]),
    (("ECON", "101", "Econ 101 Principles of Micro"), ["title_repeats_code", "title_mixed_case"]),
    (("ECON", "101", "ESL"), ["title_short"]),
    (("ECON", "1", "MICRO"), ["catalog_short"]),
    (("econ", "101", "MICRO"), ["subject_lowercase"]),
    (("ECON", "101", "MICRO �"), ["encoding_damage"]),
    (("ECON", "101", "MICRO  ECON"), ["inner_whitespace_runs"]),
    (("ECON", "101", "MICRO\tECON"), ["inner_whitespace_runs"]),
] + [(("ECON", c, "MICRO"), ["catalog_numeric_coerced"]) for c in ("101.0", "101.00", "1e3", "1.01E+02")]


def test_row_checks(spark):
    df = spark.createDataFrame([(i, *cells) for i, (cells, _) in enumerate(HITS)], "i int, s string, c string, t string")
    tests = checks.row_checks(F.col("s"), F.col("c"), F.col("t"))
    assert tuple(tests) == checks.ROW_CHECKS
    got = {r["i"]: [c for c in checks.ROW_CHECKS if r[c]] for r in df.select("i", *(t.alias(c) for c, t in tests.items())).collect()}
    assert got == {i: want for i, (_, want) in enumerate(HITS)}


def test_logits(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0, 3.0, 2.0]), (1, [1000.0, 0.0])], "i int, z array<float>")
    found = df.select("i", logits.argmax(F.col("z")).alias("a"), logits.top(F.col("z"))["i"].alias("top"), logits.denominator(F.col("z")).alias("d"))
    got = {r["i"]: r for r in found.collect()}
    assert (got[0]["a"], got[0]["top"]) == (1, [1, 2, 3, 0, 0])
    assert (got[1]["a"], got[1]["top"]) == (0, [0, 1, 0, 0, 0]) and got[1]["d"] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="gaps"):
        logits.label_table({0: "a", 2: "b"})


def test_reduction_gives_codes_and_float_probabilities(spark):
    df = spark.createDataFrame([([0.0, 2.0, 1.0],)], "z array<float>")
    got = df.select(*(c.alias(n) for n, c in logits.reduced(F.col("z"), ["a", "b", "c"]).items())).first()
    assert (got["classification"], got["top2_code"], got["top3_code"]) == ("b", "c", "a")
    assert got["probability"] == pytest.approx(0.66524, abs=1e-5)
    assert rows(df.select(F.lit(1).alias("x"))) == [(1,)]
