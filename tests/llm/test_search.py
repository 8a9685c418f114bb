"""Alignment, n-gram join and collocations, against brute force over whole texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations
from math import floor

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from taxospark.llm import alignment, collocation, ngram_join, queries, spotsigs
from taxospark.llm.common import table
from tests.conftest import rows
from tests.llm.conftest import WORDS, prose
from tests.llm.test_exact_forms import find, lower
from tests.test_queries import compare, duck  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_ngram_join", "op13_collocation"])
def test_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, queries.queries()[name], queries.oracle_sql()[name])


# alignment


def aligned(pairs):
    """The contract, word by word: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    a = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_LEVEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.PIECES))
    alphabet = alignment.byte_alphabet()
    found, counts = [], Counter()
    for doc_id, text in pairs:
        text = text or ""
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        groups, links = [], Counter()
        if text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ends_a, ends_b = ([sum(map(len, x[: i + 1])) for i in range(len(x))] if len(x) < 500 else np.cumsum([*map(len, x)]).tolist() for x in (bytes_a, bytes_b))
            both, i, j = set(ends_a) & set(ends_b), 0, 0
            own_a, own_b = [], []
            while i < len(ids_a):
                own_a.append(ids_a[i])
                if ends_a[i] in both:
                    while True:
                        own_b.append(ids_b[j])
                        j += 1
                        if ends_b[j - 1] == ends_a[i]:
                            break
                    groups.append((own_a, own_b))
                    own_a, own_b = [], []
                i += 1
            for x, y in groups:
                links.update((s, t) for s in x for t in y)
        else:
            ids_a, ids_b = [], []
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
        counts.update(links.keys())
        found.append((doc_id, len(ids_a), len(ids_b), len(groups), links, digest))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for doc_id, n_a, n_b, n_groups, links, digest in found:
        n_best = sum(n for pair, n in links.items() if counts[pair] == best[pair[0]])
        yield doc_id, n_a, n_b, n_groups, sum(links.values()), n_best, sum(n * counts[pair] for pair, n in links.items()), digest


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_edges(make, edge_pairs, monkeypatch):
    rng = random.Random(3)
    pairs = edge_pairs + [(100 + i, prose(rng, 3)) for i in range(20)] + [(130, "a <|endoftext|> <s> </s> b"), (131, "two  spaces"), (132, " led"), (133, "x▁y"), (134, "finﬁ"), (135, "漢字仮名交じり文" * 30), (136, "line\nend\ttab")]
    for hot in (1 << 19, 50):
        monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
        assert rows(alignment.align(make(pairs)), *COLUMNS) == sorted(aligned(pairs), key=repr)


def test_alignment_of_documents(spark):
    docs = table(spark, SF, "documents")
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows(alignment.align(docs), *COLUMNS) == sorted(aligned(pairs), key=repr)


def test_gallop_finds_what_is_there():
    rng = np.random.default_rng(5)
    for size in (0, 1, 2, 7, 60, 900):
        for _ in range(60):
            a, b = (np.unique(rng.integers(0, 1 + size * 3, rng.integers(0, size + 1))) for _ in "ab")
            place = {v: i for i, v in enumerate(b.tolist())}
            assert alignment.gallop(a, b).tolist() == [place.get(v, -1) for v in a.tolist()]
            at_a, at_b = alignment.common_ends(a, b)
            assert a[at_a].tolist() == b[at_b].tolist() == sorted({*a.tolist()} & {*b.tolist()})
    ramp = np.concatenate([np.arange(1000), [10**6, 10**9]])
    assert alignment.gallop(np.array([999, 10**6, 10**9]), ramp).tolist() == [999, 1000, 1001]


def test_large_groups_count_like_small_ones(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 50)
    last_a, last_b = np.array([4, 5, 40, 59]), np.array([0, 20, 30, 49])
    whole = alignment.linked(a, b, last_a, last_b, 10)
    for spread in (1, 30, 300):
        monkeypatch.setattr(alignment, "SPREAD", spread)
        assert [x.tolist() for x in alignment.linked(a, b, last_a, last_b, 10)] == [x.tolist() for x in whole]


# n-gram join


def similar(pairs, percent, words=3):
    """(doc_id, n_shingles, component_id, copies) by comparing all pairs."""
    sets = []
    for _, text in pairs:
        parts = re.findall("[^\x20\x09-\x0d]+", lower(text))
        sets.append(frozenset(" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset())
    linked = [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    groups = find(linked, range(len(sets)))
    least = {}
    for i, g in groups.items():
        if pairs[i][0] is not None:
            least[g] = min(pairs[i][0], least.get(g, pairs[i][0]))
    times = Counter(sets)
    return sorted(((pairs[i][0], len(s), least.get(groups[i]), times[s] if s else 1) for i, s in enumerate(sets)), key=repr)


def family(rng, start, size, sentences, edits):
    text = prose(rng, sentences).split()
    for i in range(size):
        own = list(text)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        yield start + i, " ".join(own)


def joined(docs, **k):
    return rows(ngram_join.join(docs, **k), "doc_id", "n_shingles", "component_id", "copies")


@pytest.mark.parametrize("percent", [90, 70, 100])
def test_join_of_families(make, percent):
    rng = random.Random(percent)
    pairs = [p for k in range(5) for p in family(rng, 1000 * k, 14, rng.choice((2, 5, 20)), 4)]
    # a chain: each links with the next one only
    text = prose(rng, 30).split()
    for i in range(8):
        text = text[6:] + prose(rng, 1).split()[:6]
        pairs.append((6000 + i, " ".join(text)))
    # many documents with a passage in common, alike in size, that don't link
    passage = prose(rng, 4)
    pairs += [(7000 + i, f"{passage} {prose(rng, 2)}") for i in range(30)]
    assert joined(make(pairs), percent=percent) == similar(pairs, percent)


def test_join_at_edges(make, edge_pairs):
    pairs = edge_pairs + [(20, "one"), (21, "One "), (22, "one two"), (23, "one two three"), (24, "three two one"), (25, "one two three one two three"), (None, "one"), (26, " nbsp word x")]
    assert joined(make(pairs)) == similar(pairs, 90)
    assert joined(make([], extra=False)) == []


def test_cells_are_paired_by_their_heads(spark):
    """A large cell isn't expanded for far groups, and no two cells with similar members are lost."""
    rng, n = random.Random(5), 60
    bits = lambda v: np.frombuffer(v.to_bytes(32, "little"), np.int64).tolist()
    flipped = lambda v, k: v ^ sum(1 << i for i in rng.sample(range(256), k))
    centre, nodes = rng.getrandbits(256), []
    nodes += [(i, 1, 0, flipped(centre, rng.randint(0, 12))) for i in range(40)]  # one cell of group 1
    nodes += [(100 + i, 1, 100 + i, flipped(centre, 40)) for i in range(5)]  # cells of one
    nodes += [(200 + i, 200 + i, 200 + i, flipped(centre, rng.choice((3, 14, 60)))) for i in range(60)]  # groups of one
    labels = spark.createDataFrame([(node, grp, n, label, *bits(v)) for node, grp, label, v in nodes], "node long, grp long, n long, label long, " + ", ".join(f"{c} long" for c in ngram_join.SIGNATURE))
    groups = sorted({x[1] for x in nodes})
    pairs = spark.createDataFrame([(a, b) for a in groups for b in groups if a <= b], "grp_a long, grp_b long")
    cells = ngram_join.cells(labels)
    assert {r["label"]: r["size"] for r in cells.collect() if r["size"] > 1} == {0: 40}
    got = ngram_join.cell_pairs(pairs, cells).collect()
    found = {frozenset(((r["grp_a"], r["label_a"]), (r["grp_b"], r["label_b"]))) for r in got}
    limit = (100 - ngram_join.PERCENT) * 2 * n // (100 + ngram_join.PERCENT)
    near = {frozenset(((x[1], x[2]), (y[1], y[2]))) for x in nodes for y in nodes if x[2] != y[2] and (x[3] ^ y[3]).bit_count() <= limit}
    assert near and near <= found and len(found) == len(got)
    large = [r for r in got if r["label_a"] == 0]
    assert large and not any(r["label_b"] == 0 for r in got)
    far = {x[0] for x in nodes if (x[3] ^ nodes[0][3]).bit_count() > limit + 24}
    assert far and not far & {r["label_b"] for r in large}


def test_join_stays_right_whatever_the_table_of_levels_holds(make, monkeypatch):
    rng = random.Random(11)
    pairs = [p for k in range(3) for p in family(rng, 100 * k, 12, 6, 3)]
    for slots, frequent in ((1, 2), (16, 1), (1 << 10, 3)):
        monkeypatch.setattr(ngram_join, "SLOTS", slots)
        monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
        monkeypatch.setattr(ngram_join, "LOOKED_UP", slots)
        monkeypatch.setattr(ngram_join, "CHUNK", 3)
        assert joined(make(pairs)) == similar(pairs, 90)


# collocations


def mined(texts, least=10, covered=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score, cut), by counting every phrase of every text."""
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in texts:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang or "und"] += len(words)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [b for q, b in f.items() if len(q) == 3 and len(p) == 2 and b >= least and p in (q[:2], q[1:])]
            if not any(100 * b >= covered * a for b in longer):
                cuts = [(floor(Fraction(10**6 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p))]
                s, k = min(cuts)
                found.append((-s, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], s, k))
        for rank, (_, _, phrase, a, left, right, s, k) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, phrase.decode(), a, left, right, sizes[lang], s, k


PHRASES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(8)
    texts = [(lang, " ".join(rng.choice(WORDS[:k]) + rng.choice(("", "", "", ",", ".", "\n")) for _ in range(rng.randint(0, 300)))) for lang, k in (("en", 4), ("de", 9), (None, 3), ("und", 5), ("x", 20)) for _ in range(12)]
    texts += [("en", None), ("en", ""), ("fr", "only once"), (None, "!?"), ("de", "ÄÖ ÄÖ\x1cx\x00 " * 15), ("en", "A\tb\x0bC\x0cd " * 12), ("de", "lang " * 3000)]
    schema = "lang string, text string, doc_id long, word string, number string, n string, `a.b` string, `_metadata` string"
    return texts, spark.createDataFrame([(*t, None, "x", "y", None, "z", None) for t in texts], schema)


@pytest.mark.parametrize("budget", [1 << 20, 200, 1])
def test_phrases(spoken, budget):
    """With budgets so small that words and phrases of two are extended too."""
    texts, docs = spoken
    assert rows(collocation.collocations(docs, budget=budget), *PHRASES) == sorted(mined(texts), key=repr)


def test_phrases_of_other_limits(spoken, spark, monkeypatch):
    texts, docs = spoken
    assert rows(collocation.collocations(docs, least=3, covered=80, top=7), *PHRASES) == sorted(mined(texts, 3, 80, 7), key=repr)
    monkeypatch.setattr(collocation, "FILTER", 64)
    assert rows(collocation.collocations(docs, least=40), *PHRASES) == sorted(mined(texts, 40), key=repr)
    assert collocation.collocations(docs.limit(0)).collect() == []


def test_scores_are_exact(spark):
    rng = random.Random(4)
    cases = [(a, a + rng.randrange(1 + a // 3), a + rng.randrange(5)) for a in [rng.randrange(1, 10 ** rng.randint(1, 15)) for _ in range(300)]]
    found = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", collocation.score(*(collocation.F.col(c) for c in "alr")).alias("s")).collect()
    assert all(s == 10**6 * a * a // (x * r) for a, x, r, s in found)


def test_shares_rank_like_a_whole(spark):
    rows_ = [("en" if i % 3 else "de", f"p{i:03d}", i % 7, i % 5) for i in range(300)]
    scored = spark.createDataFrame(rows_, "lang string, phrase string, score long, a long")
    whole, parts = (rows(collocation.ranked(scored, 20, share), "lang", "rank", "phrase") for share in (1 << 18, 11))
    assert whole == parts and len(whole) == 40


def test_spotsigs_hold_a_stretch_of_texts_at_once():
    texts = [f"the word{i} of a long text and more of it {i}" for i in range(1000)] + [None, ""]
    made = list(spotsigs.signed([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])]))
    assert max(b.num_rows for b in made) <= spotsigs.STRETCH
    found = [r for b in made for r in b.to_pylist()]
    assert [r["doc_id"] for r in found] == list(range(len(texts)))
    for r, text in zip(found, texts):
        sigs = spotsigs.signatures(text)
        assert r["fingerprint"] == spotsigs.digest_of(sigs) and {s % 2**64 for s in r["sigs"]} == sigs
