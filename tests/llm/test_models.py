"""Trained operators: held-out accuracy, defined results at the edges, and labels that are never read."""

import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from taxospark.llm import common, langid, lm_score, queries, quality, toxicity
from taxospark.llm.common import is_fold, table
from tests.conftest import rows
from tests.llm.conftest import prose

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def auc(pairs):
    """Of (score, label) pairs."""
    ranks, ordered = {}, sorted(s for s, _ in pairs)
    for i, s in enumerate(ordered):
        ranks.setdefault(s, []).append(i)
    ranks = {s: sum(r) / len(r) for s, r in ranks.items()}
    n1 = sum(y for _, y in pairs)
    return (sum(ranks[s] for s, y in pairs if y) - n1 * (n1 - 1) / 2) / (n1 * (len(pairs) - n1))


@pytest.mark.parametrize(("name", "label", "sf", "least"), [("op3_toxicity", "toxic", LARGER, 0.945), ("op8_quality", "quality", SF, 0.98)])
def test_held_out_scores(spark, name, label, sf, least):
    found = queries.queries()[name](spark, sf).cache()
    assert found.count() == table(spark, sf, "documents").count()
    assert found.filter("score is null or score < 0 or score > 1 or predicted <> if(score >= 0.3, 1, 0)").count() == 0
    told = found.filter("held_out").join(table(spark, sf, "labels"), "doc_id").select("score", label)
    assert auc(rows(told)) >= least


def test_languages(spark):
    found = queries.op10_language_id(spark, SF).join(table(spark, SF, "documents"), "doc_id")
    held = found.filter("held_out")
    assert held.filter("lang_pred = lang").count() >= 0.97 * held.count()


def test_held_out_labels_are_not_read(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    for module, label, folds, held in ((toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)):
        turned = labels.withColumn(label, F.when(is_fold(F.col("doc_id"), folds, held), 1 - F.col(label)).otherwise(F.col(label)))
        few = docs.limit(200).select("doc_id", "text")
        assert rows(module.score(few, labels)) == rows(module.score(few, turned))


def test_new_words_are_counted_over_the_whole_text():
    clean, spun = " ".join(f"w{i}" for i in range(200)), " ".join(["again", "and"] * 100)
    new = lambda text: quality.rates(text)[1]
    assert new(clean) == 1 and new(spun) == 2 / 200
    assert new(f"{clean} {spun}") == new(f"{spun} {clean}") == 202 / 400
    assert new(f"{clean} {spun} {clean} again and again") == 404 / 603
    assert new("one two two") == 2 / 3


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges_of_scores(spark, make, edge_pairs, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make(edge_pairs)
    assert {r["score"] for r in module.score(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 12)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    got = module.score(docs, some).collect()
    assert len(got) == len(edge_pairs) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)


def kneser_ney_by_hand(texts, order, alphabet):
    """P(x | history, class) of a small sample, from dictionaries; texts: (plain text, label)."""
    own = {0: Counter(), 1: Counter()}
    for t, y in set(texts):
        own[y].update(t[i : i + order] for i in range(len(t) - order + 1))
    shared, longer = {}, {g for y in own for g in own[y]}
    for k in range(order - 1, 0, -1):
        shared[k] = Counter(g[-k:] for g in longer)
        longer = {g[-k:] for g in longer}

    def discount(counts):
        once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
        return once / (once + 2 * twice) if once and twice else 0.5

    def p(gram, counts, rest):
        seen = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        if not seen:
            return rest
        d, total = discount(counts), sum(seen.values())
        return (max(seen.get(gram, 0) - d, 0) + d * len(seen) * rest) / total

    def probability(gram, label):
        out = 1 / (len(alphabet) + 1)
        for k in range(1, order):
            out = p(gram[-k:], shared[k], out)
        return p(gram, own[label], out)

    return probability


def test_kneser_ney(spark):
    rng = random.Random(17)
    texts = [("".join(rng.choices("abc \u00e9漢", k=60)), i % 2) for i in range(12)] + [("ab ab", 0), ("ab ab", 1), ("ab ab", 1), ("...", 0), (None, 1)]
    model = toxicity.count(spark.createDataFrame(texts, "text string, label int"))
    alphabet = [chr(x) for x in model.alphabet]
    hand = kneser_ney_by_hand([(toxicity.plain(t), y) for t, y in texts], model.order, alphabet)
    code = lambda g: toxicity.sequences(toxicity.symbols(toxicity.points(g), model.alphabet), model.size, model.order)
    grams = ["".join(rng.choices([*alphabet, "?"], k=model.order)) for _ in range(200)] + [toxicity.plain(texts[0][0])[i : i + 4] for i in range(40)]
    for label in (0, 1):
        got = model.probability(np.array([code(g)[0] for g in grams]), label)
        # "?" is in no sample, so it stands for all unknown characters
        assert np.allclose(got, [hand(g, label) for g in grams])
        for history in ("abc", " ab", "漢漢漢", "???", "b a"):
            assert sum(model.probability(np.array([code(history + x)[0] for x in [*alphabet, "?"]]), label)) == pytest.approx(1)
    text = toxicity.plain("ab caba")
    ratios = [math.log(hand(text[i : i + 4], 1) / hand(text[i : i + 4], 0)) for i in range(len(text) - 3)]
    one, other, none = model.features(["ab caba", "c" * 50, "123"])
    # words end with the space behind them: "ab " has no ratio for its first two letters, "caba " has all
    words = [sum(ratios[:1]), sum(ratios[1:])]
    assert one == pytest.approx([sum(ratios) / len(ratios), sum(words) / 2]) and list(none) == [0, 0] and other[0] != 0
    assert np.allclose(model.features(["ab caba", None, "c" * 50, "b"] * 3)[[0, 6]], [one, other])


def test_neighbours_vote(spark):
    rng = random.Random(19)
    texts = [(i, prose(rng, 3) if i % 2 else "x1 " * rng.randint(5, 40) + "#$ " * i, i % 2) for i in range(1, 60)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, quality int")
    model = quality.train(docs, labels)
    asked = [t for _, t, _ in texts[:20]] + ["", None, "plain words"]
    z = model.latent(asked)
    assert np.allclose(np.linalg.norm(z, axis=1), 1, atol=1e-4)
    want = []
    for v in z:
        cosines = sorted(((float(v @ r), int(y), float(w)) for r, y, w in zip(model.vectors, model.labels, model.weights)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(c, 1e-6) ** 4 * w for c, _, w in cosines]
        want.append(sum(w * y for w, (_, y, _) in zip(weight, cosines)) / sum(weight))
    assert np.allclose(model.vote(asked), want, atol=1e-3)


def test_edges_of_languages(make, edge_pairs):
    pairs = [*edge_pairs, (12, "\u00bd"), (13, "\u00b2 3"), (14, "\u2460_"), (15, "\u00aa"), (10, "repeated id")]
    got = rows(langid.identify(make(pairs)), "doc_id", "lang_pred", "score")
    assert [r for r in got if r[0] in (1, 2, 3, 11, 12, 13, 14)] == [(i, "und", 0.0) for i in (1, 11, 12, 13, 14, 2, 3)]
    assert [r for r in got if r[0] == 10] == [(10, "en", 1.0)] * 2 and (15, "en", 1.0) in got and len(got) == len(pairs)


def test_code_lengths_are_exact(spark):
    """Against method C with escapes by hand, in three languages and scripts, with more than 128 kinds of bytes and any number of contexts."""
    rng = random.Random(31)
    texts = {"xx": ["abracadabra", "abrabra", "cad", "cad"], "zh": ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000)), "漢字"], "ru": ["".join(chr(rng.randint(0x400, 0x4FF)) for _ in range(3000)), "да нет"]}
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == sorted(texts)
    counts = {lang: [{} for _ in range(langid.ORDER + 1)] for lang in texts}
    for lang, ts in texts.items():
        for t in ts:
            padded = b" " * langid.ORDER + t.encode()
            for i in range(langid.ORDER, len(padded)):
                for k in range(langid.ORDER + 1):
                    counts[lang][k].setdefault(padded[i - k : i], Counter())[padded[i]] += 1

    def bits(lang, context, c, k):
        if k < 0:
            return 8
        seen = counts[lang][k].get(context[len(context) - k :])
        if not seen:
            return bits(lang, context, c, k - 1)
        whole = sum(seen.values()) + len(seen)
        return math.log2(whole / seen[c]) if c in seen else math.log2(whole / len(seen)) + bits(lang, context, c, k - 1)

    asked = ["abra", "cadabra", "bbb", "dr", "漢字漢", "да, нет", "", "mixed да 漢 abra"]
    want = []
    for t in asked:
        padded = b" " * langid.ORDER + t.encode()
        want.append([sum(bits(lang, padded[i - langid.ORDER : i], padded[i], langid.ORDER) for i in range(langid.ORDER, len(padded))) for lang in model.langs])
    assert np.allclose(model.bits([t.encode() for t in asked]), want)


def backoff_by_force(pairs, order):
    texts = [(i, [None] * (order - 1) + lm_score.words_of(t)) for i, t in pairs]
    each = [Counter(tuple(ws[j - k : j]) for k in range(1, order + 1) for j in range(order - 1 + 1, len(ws) + 1)) for _, ws in texts]
    for c, (_, ws) in zip(each, texts):
        c.update({(None,) * k: 1 for k in range(1, order) if len(ws) >= order})
    every, out = sum(each, Counter()), []
    total = sum(len(ws) - order + 1 for _, ws in texts)
    for own, (i, ws) in zip(each, texts):
        n, s = max(1, total - (len(ws) - order + 1)), 0.0
        count = lambda g: every[g] - own[g]
        for j in range(order, len(ws) + 1):
            for k in range(order, 0, -1):
                g = tuple(ws[j - k : j])
                if count(g) > 0:
                    s += math.log(count(g) / (count(g[:-1]) if k > 1 else n))
                    break
                s += math.log(0.4)
            else:
                s -= math.log(n)
        out.append((i, len(ws) - order + 1, round(s, 3)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_stupid_backoff(make, edge_pairs, order):
    some = [(i, t) for i, t in edge_pairs if len(t or "") < 50_000]
    for pairs in (some, [(i, "the very same text") for i in range(300)] + [(9999, "the other"), (1, "the same text")], [(1, None)], [(1, "alone")]):
        got = lm_score.score(make(pairs), order).select("doc_id", "n_tokens", F.round("log_score", 3))
        for a, b in zip(rows(got), backoff_by_force(pairs, order), strict=True):
            assert tuple(a)[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=0.002)


def test_stupid_backoff_against_sql(spark):
    conn = duckdb.connect()
    conn.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = conn.execute(queries.ORACLE["op9_lm_score"]).fetchall()
    assert sorted(map(tuple, queries.op9_lm_score(spark, SF).collect())) == sorted(want)


def test_stupid_backoff_shuffles_no_exploded_grams(spark, make):
    words = [f"w{i * i % 977}" for i in range(60)]
    docs = make([(i, " ".join(words[i % 7 :] + [f"own{i}x{j}" for j in range(200)])) for i in range(60)], extra=False)
    plan = lm_score.score(docs)._jdf.queryExecution().executedPlan().toString()
    # the joins that ask for bigrams read both sides from buckets, so that shuffles are left for words beyond the known ones and for sums by document
    assert "SelectedBucketsCount" in plan
    assert not re.search(r"Exchange hashpartitioning\(w\d#\d+L?, w\d", plan)


def test_stupid_backoff_writes_packed_grams(make, monkeypatch):
    tables, bucketed = [], lm_score.bucketed
    monkeypatch.setattr(lm_score, "bucketed", lambda *a: tables.append(bucketed(*a)) or tables[-1])
    docs = make([(i, " ".join(f"w{i * j % 97}" for j in range(100))) for i in range(100)], extra=False)
    assert lm_score.score(docs).count() == 100
    # 9,000 trigrams and more, of which 4 tasks write a row for each of 8 buckets at most
    assert [t.count() <= 4 * 8 for t in tables] == [True]


def test_packed_columns_are_the_same_again():
    rng = np.random.default_rng(5)
    for n, top in ((1, 1), (300, 1 << 7), (300, 1 << 20), (300, 1 << 40)):
        words = [np.where(rng.random(n) < share, rng.integers(-(1 << 63), 0, n), rng.integers(0, top, n)) for share in (0.3, 0, 1)]
        numbers = [rng.integers(0, top, n), rng.random(n).view(np.uint64), np.zeros(n, np.int64)]
        w, x, base = lm_score.unpack(lm_score.pack(words, numbers, 7 << 40), 3)
        assert base == 7 << 40 and all(map(np.array_equal, w, words)) and all(np.array_equal(a, b.view(np.int64)) for a, b in zip(x, numbers, strict=True))


def test_order_of_codes_that_differ_in_low_bits_only():
    code = np.random.default_rng(6).integers(0, 50, 4000).astype(np.uint64) | np.uint64(1 << 63)
    assert np.array_equal(code[lm_score.ordered(code)], np.sort(code))
    assert np.array_equal(lm_score.totals(code)[0], np.bincount(code.view(np.int64) & 63)[code.view(np.int64) & 63])


def test_stupid_backoff_knows_few_words(make, edge_pairs, monkeypatch):
    monkeypatch.setattr(lm_score, "KNOWN", 3)
    monkeypatch.setattr(lm_score, "SUMMED", 2)
    some = [(i, t) for i, t in edge_pairs if len(t or "") < 50_000]
    got = lm_score.score(make(some)).select("doc_id", "n_tokens", F.round("log_score", 3))
    for a, b in zip(rows(got), backoff_by_force(some, 3), strict=True):
        assert tuple(a)[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=0.002)


def test_toxicity_learns_from_every_labelled_document(spark):
    docs = spark.range(13_000).selectExpr("id AS doc_id", "concat('word', translate(cast(id AS string), '0123456789', 'abcdefghij')) AS text")
    labels = spark.range(13_000).selectExpr("id AS doc_id", "cast(1 AS int) AS toxic").unionByName(spark.createDataFrame([(-i, 0) for i in range(1, 41)], "doc_id long, toxic int"))
    docs = docs.unionByName(spark.createDataFrame([(-i, f"plain text {i}") for i in range(1, 41)], "doc_id long, text string"))
    model = toxicity.train(docs, labels)
    counted = [i for i in range(13_000) if zlib.crc32(str(i).encode()) % 4 in (0, 1)]
    assert len(counted) > 5000
    assert model.own[1].n.sum() == sum(len(f" word{i} ") - toxicity.ORDER + 1 for i in counted)


def test_logistic_over_a_table_is_that_over_arrays(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2))
    y = (x[:, 0] + rng.normal(size=500) > 0.5).astype(float)
    rows = spark.createDataFrame([(int(b), float(a[0]), float(a[1])) for a, b in zip(x, y)], "label int, x0 double, x1 double").repartition(3)
    assert np.allclose(common.logistic_over(rows, 0.2), common.logistic(x, y, 0.2))
