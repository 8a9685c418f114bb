"""The pipeline's stages, each against brute force on its own input, and all operators on empty tables."""

import os
import random
import zlib

import pytest

import corpus_pipeline
from taxospark.llm import alignment, bpe, exact_dedup, langid, lm_score, ngram_join, packing, quality, simhash, spotsigs, substring_dedup, toxicity
from taxospark.llm.common import labelled_sample, table, written
from tests.conftest import rows
from tests.llm.conftest import prose
from tests.llm.test_exact_forms import find, fingerprint, lower, substrings_by_force

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "simhash near-dedup", "substring dedup", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    def step(name, before):
        after = written(stages[name](spark, before, SF), "test-stage")
        assert after.columns == docs.columns
        return after, rows(before, "doc_id", "text"), rows(after, "doc_id", "text")

    kept, before, after = step(names[0], docs)
    accepted = {r[0] for r in rows(quality.score(docs, table(spark, SF, "labels")).filter("predicted = 1"), "doc_id")}
    assert after == [p for p in before if p[0] in accepted]
    kept, before, after = step(names[1], kept)
    last = {}
    for i, t in sorted(before):
        last[lower(t)] = i
    assert after == [p for p in before if last[lower(p[1])] == p[0]]
    kept, before, after = step(names[2], kept)
    fps = {i: fingerprint(t) for i, t in before}
    ids = sorted(fps)
    groups = find([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3], ids)
    assert after == [p for p in before if groups[p[0]] == p[0]]
    kept, before, after = step(names[3], kept)
    assert after == sorted(((i, t) for i, t in substrings_by_force(before) if t.strip() or not dict(before)[i].strip()), key=repr)
    packed = stages[names[4]](spark, kept, SF)
    assert rows(packed) == rows(corpus_pipeline.run(spark, SF))
    assert {r[0] for r in rows(packed, "doc_id")} == {i for i, _ in after}


def test_stages_at_the_edges(spark, make, edge_pairs, tmp_path):
    make(edge_pairs, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_keep_columns_of_any_name(spark, make, tmp_path):
    """All stages but the last, over rows with columns like those that operators use inside; a copy behind line ends leaves nothing."""
    rng = random.Random(31)
    a, b = prose(rng, 8), prose(rng, 8)
    make([(1, a), (2, b), (3, f"\n\n{a}"), (4, b), (5, f"{a}\u3000\n{prose(rng, 9)}")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, str(tmp_path), "documents")
    whole = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), "test-stage")
        assert docs.schema == make([]).schema
    left = {r["doc_id"]: r for r in docs.collect()}
    assert sorted(left) == [1, 4, 5] and left[1] == whole[1] and left[4] == whole[4]
    assert left[5]["n_chars"] == len(left[5]["text"]) < len(whole[5]["text"])
    assert [x for x, n in zip(left[5], docs.columns) if n not in ("text", "n_chars")] == [x for x, n in zip(whole[5], docs.columns) if n not in ("text", "n_chars")]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 4, 5}


def test_samples_bound_rows(spark, make):
    """A third of the rows under one labelled id: a sample has a row for each id."""
    rng = random.Random(5)
    docs = make([(1, f"{k} {prose(rng, 1)}") for k in range(300)] + [(i, prose(rng, 1)) for i in range(2, 600)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 600)], "doc_id long, quality int, toxic int")
    chosen, _ = labelled_sample(docs, labels, "toxic", 4, 2, 1000)
    found = rows(chosen, "doc_id", "text")
    assert len(found) == len({i for i, _ in found}) and {i for i, _ in found} >= {1, 3} - {i for i in (1, 3) if zlib.crc32(str(i).encode()) % 4 == 2}
    texts = min(r[0] for r in docs.filter("doc_id = 1").select("text").collect())
    assert all(t == texts for i, t in found if i == 1)


def test_the_order_is_the_same_for_any_alphabet(spark, make):
    """60,000 different characters: sequences as long as ever, and texts of one class score above the other's."""
    points = [*range(0x4E00, 0xA000), *range(0x20000, 0x2A000)][:60_000]
    rng = random.Random(6)
    many = "".join(map(chr, points))
    pairs = [(i, f"{prose(rng, 3)} {'bad awful' if i % 2 else 'nice lovely'} {many[i * 600 : i * 600 + 600]}") for i in range(100)]
    sample = spark.createDataFrame([(t, i % 2) for i, t in pairs], "text string, label int")
    model = toxicity.count(sample)
    assert model.order == toxicity.ORDER == 4 and len(model.alphabet) == toxicity.FULL and model.size**4 < 2**62
    assert (toxicity.symbols(toxicity.points(many), model.alphabet) > 0).all()


def test_stages_judge_rows_without_ids_and_rows_that_repeat_one(spark, make):
    rng = random.Random(23)
    a, b, c, d, e = (prose(rng, 8) for _ in range(5))
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, pairs: rows(stages[name](spark, make(pairs), ""), "doc_id", "text")
    # a: twice under one id and twice without; b: lost to 9 under an id that c is kept by; d: only without ids
    pairs = [(5, a), (5, a.upper()), (None, a), (None, a), (5, b), (9, b), (5, c), (None, d), (None, d), (None, e), (6, None), (6, None)]
    left = run("exact dedup", pairs)
    assert [(i, (t or "").lower()) for i, t in left] == sorted([(5, a.lower()), (9, b.lower()), (5, c.lower()), (None, d.lower()), (None, e.lower()), (6, "")], key=repr)
    left = run("simhash near-dedup", [(5, a), (5, a), (None, a), (None, a), (5, b), (4, b), (5, c), (None, d), (None, d), (None, e)])
    assert left == sorted([(5, a), (4, b), (5, c), (None, d), (None, e)], key=repr)
    # the passage c stays in the smallest id's first row only; each row loses its own sentences
    parts = [(7, f"{a}\n{c}"), (7, f"{c}\n{b}"), (None, f"{d}\n{c}"), (None, e), (3, f"{prose(rng, 5)}\n{c}")]
    left = run("substring dedup", parts)
    assert [t for i, t in left if i == 3] == [parts[4][1]]
    assert sorted((i, t.strip()) for i, t in left if i == 7) == sorted([(7, a), (7, b)])
    assert sorted(t.strip() for i, t in left if i is None) == sorted([d, e])
    assert stages["exact dedup"](spark, make(pairs), "").schema == make(pairs).schema == stages["substring dedup"](spark, make(pairs), "").schema


OPERATORS = {
    "op1": lambda d, _: substring_dedup.dedup(d),
    "op2": lambda d, _: bpe.round_trip(d),
    "op3": toxicity.score,
    "op4": lambda d, _: simhash.near_duplicates(d),
    "op5": lambda d, _: packing.pack(d),
    "op6": lambda d, _: exact_dedup.dedup(d),
    "op7": lambda d, _: spotsigs.fingerprint(d),
    "op7_classes": lambda d, _: spotsigs.near_duplicates(d),
    "op8": quality.score,
    "op8_accepted": quality.accepted,
    "op9": lambda d, _: lm_score.score(d),
    "op10": lambda d, _: langid.identify(d),
    "op11": lambda d, _: alignment.align(d),
    "op12": lambda d, _: ngram_join.join(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, make, name):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert OPERATORS[name](make([]), labels).collect() == []
    assert len(OPERATORS[name](make([(1, None)]), labels).collect()) == 1
