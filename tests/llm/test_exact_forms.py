"""Operators with exact results, against brute force."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taxospark.llm import bpe, components, exact_dedup, packing, simhash, spotsigs, substring_dedup
from taxospark.llm.common import shared_path, table, with_row
from tests.conftest import rows
from tests.llm.conftest import prose, sentence

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def find(pairs, nodes):
    """Smallest node reachable from each."""
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(public_tokenizers.path(bpe.RANKS))


def test_bpe_round_trip(make, edge_pairs, enc):
    got = rows(bpe.round_trip(make(edge_pairs)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in edge_pairs:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_bpe_pieces_keep_ids(enc):
    rng = random.Random(1)
    parts = ["'s", "'street", " ", "  ", "\n", "\r\n", " ", "　", "\x1c", "a", "Z9", "é", "!?", "漢", "\t", "'", "12", "...", "😀"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 400)))
        assert "".join(bpe.pieces(text, 16)) == text
        assert [i for p in bpe.pieces(text, 16) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
        assert bpe.encode(text * 5, enc, 64) == enc.encode_ordinary(text * 5)
    for run in (" " * 1500, "\n" * 1500, " " * 1200 + "\n" * 300):
        for text in (run, "a" + run, run + "b", "a" + run + "b" + run):
            assert bpe.encode(text, enc, 64) == enc.encode_ordinary(text)


def test_bpe_ids_and_bytes_as_columns(make, edge_pairs):
    encoded = bpe.with_ids(make(edge_pairs))
    assert sorted((r["doc_id"], bytes(r["data"]).decode()) for r in bpe.with_bytes(encoded).collect() if r["doc_id"]) == sorted((i, t or "") for i, t in edge_pairs if i)


def fingerprint(text):
    words = lower(text).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints(make, edge_pairs):
    pairs = [(i, t) for i, t in edge_pairs if len(t or "") < 50_000]
    got = {(r["doc_id"], r["fingerprint"]) for r in simhash.near_duplicates(make(pairs)).collect()}
    assert got == {(i, f"{fingerprint(t):016x}") for i, t in pairs}


def test_simhash_links_and_components(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1}
    for fp in list(fps):
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                fp ^= 1 << b
            fps.add(fp)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    want = {(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3}
    found = simhash.links(nodes)
    assert {tuple(sorted(r)) for r in found.collect()} == want and len(want) > 100
    labels = find(want, range(len(fps)))
    linked = {x for p in want for x in p}
    assert dict(rows(components.components(found))) == {n: labels[n] for n in linked}


def test_simhash_links_a_dense_ball_by_its_star(spark):
    center = 0x5DEECE66D5DEECE6
    ball = sorted({center ^ 1 << i ^ 1 << j for i in range(32) for j in range(32)} | {center ^ 7 << 40, center ^ 31 << 8})
    nodes = spark.createDataFrame([(f, f, 9 if f == center else 1) for f in ball], "node long, fp long, n long")
    want = {(a, b) for a, b in combinations(ball, 2) if (a ^ b).bit_count() <= 3}
    stars = simhash.stars(nodes)
    first = {tuple(sorted(r)) for r in stars.collect()}
    rest = {tuple(sorted(r)) for r in simhash.links(components.grouped(nodes, stars)).collect()}
    assert first < want and rest < want and len(first | rest) < 2 * len(ball) < len(want) / 10
    assert find(first | rest, ball) == find(want, ball)


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200, 260)] + [(0, i) for i in range(1, 150)]
    got = dict(rows(components.components(spark.createDataFrame(chain, "a long, b long"))))
    assert got == find(chain, {x for p in chain for x in p})


def test_exact_dedup(make, edge_pairs):
    # a repeated row that would stay, a null id alone and several, and an id with two texts
    pairs = [*edge_pairs, (40, 'Twice'), (40, 'twice'), (39, 'TWICE'), (None, 'nameless'), (None, 'Nameless'), (41, 'one'), (41, 'two')]
    groups = defaultdict(list)
    for i, t in pairs:
        groups[lower(t)].append(i)
    want, seen = [], set()
    for i, t in pairs:
        keep = max((x for x in groups[lower(t)] if x is not None), default=None)
        first = (i, lower(t)) not in seen
        seen.add((i, lower(t)))
        want.append((i, keep, len(groups[lower(t)]), i == keep and first, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert rows(exact_dedup.dedup(make(pairs)), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_exact_dedup_index_persists(spark, make):
    path = shared_path(spark, "index")
    first = exact_dedup.DigestIndex(spark, path, 4)
    assert rows(exact_dedup.dedup(make([(1, "a"), (2, "A"), (3, "b")]), first), "doc_id", "kept") == [(1, False), (2, True), (3, True)]
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert rows(exact_dedup.dedup(make([(4, "a"), (5, "c")]), again), "doc_id", "keep_id", "kept") == [(4, 2, False), (5, 5, True)]
    assert again.read().count() == 3


def test_hot_digest(make):
    pairs = [(i, "same" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact_dedup.dedup(make(pairs, extra=False))
    assert got.filter("kept").count() == 1001 and got.filter("group_size = 2000").count() == 2000


def spans_by_force(words, k, least):
    found = set()
    for i in range(len(words)):
        ends = [j for j in range(i + k, len(words) + 1) if sum(words[i:j]) >= least]
        if ends:
            found.add((i, ends[0]))
    for j in range(1, len(words) + 1):
        starts = [i for i in range(j - k + 1) if sum(words[i:j]) >= least]
        if starts:
            found.add((starts[-1], j))
    return sorted(found)


def test_spans():
    rng = random.Random(5)
    for _ in range(500):
        words = [rng.choice([0, 1, 3, 8, 15, 40]) for _ in range(rng.randint(0, 12))]
        assert substring_dedup.spans(words, 2, 20) == spans_by_force(words, 2, 20)


def substrings_by_force(pairs):
    """Rows with one id follow in their order in pairs; null ids come last."""
    seen, out = {}, list(pairs)
    for k in sorted(range(len(pairs)), key=lambda k: (pairs[k][0] is None, pairs[k][0] or 0, k)):
        i, t = pairs[k]
        if t is None:
            continue
        units = substring_dedup.sentences(t)
        plain = [" ".join(u.lower().split()) for u in units]
        drop = set()
        assert plain == [" ".join(p.split()) for p in substring_dedup.plain_sentences(t)[0]] or substring_dedup.is_wide(t)
        for a, b in substring_dedup.spans(substring_dedup.plain_sentences(t)[1], 2, 20):
            key = " ".join(plain[a:b])
            if seen.setdefault(key, (k, a, b)) != (k, a, b):
                drop |= set(range(a, b))
        out[k] = (i, "".join(u for j, u in enumerate(units) if j not in drop))
    return out


def test_substring_dedup(make, edge_pairs):
    rng = random.Random(11)
    shared, two = prose(rng, 6), sentence(rng, 30, 30) + " " + sentence(rng, 31, 31)
    pairs = [(100 + i, prose(rng, 4) + " " + (shared if i % 2 else two) + "\n" + prose(rng, 4)) for i in range(20)]
    pairs += [(i, t) for i, t in edge_pairs if len(t or "") < 50_000]
    out = substring_dedup.dedup(make(pairs))
    assert rows(out, "doc_id", "text") == sorted(substrings_by_force(pairs), key=repr)
    assert "spans" in out.columns and out.filter("n_removed > 0").count() >= 18


def test_substring_dedup_takes_batches_apart():
    texts = [None, "", *(f"{i} " * 1000 for i in range(5000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    got = list(substring_dedup.slices([batch, batch.slice(0, 2), batch.slice(0, 0)]))
    assert [t for b in got for t in b.column(1).to_pylist()] == texts + texts[:2]
    assert max(b.nbytes for b in got) < 2 * substring_dedup.SLICE < batch.nbytes


def test_substring_dedup_remembers_words_in_little_memory():
    codes = substring_dedup.Codes()
    tracemalloc.start()
    try:
        for i in range(400_000):
            codes[f"word{i}"]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40e6, most


def test_substring_dedup_of_rows_that_repeat_an_id(make):
    rng = random.Random(12)
    a, b, c = (prose(rng, 4) for _ in range(3))
    for pairs in ([(1, a), (2, a + "\n" + c), (2, b)], [(2, b), (2, a), (1, a), (2, a), (None, a), (None, c), (None, c)], [(3, b), (3, b), (None, None), (None, "")]):
        assert rows(substring_dedup.dedup(make(pairs).coalesce(1)), "doc_id", "text") == sorted(substrings_by_force(pairs), key=repr)


def test_passages_inside_sentences_have_spans_in_common():
    rng = random.Random(29)

    def keys(text):
        plain, sizes = substring_dedup.plain_sentences(text)
        assert "".join(substring_dedup.sentences(text)) == text and len(substring_dedup.sentences(text)) == len(plain)
        return {" ".join(plain[a:b]) for a, b in substring_dedup.spans(sizes, 2, 20)}

    word = lambda: "".join(rng.choices("abcdefghijk", k=rng.randint(2, 9)))
    run = lambda n, between=" ": between.join(word() for _ in range(n))
    for between in [" ", ", ", "\u3001 ", '." ', "\u3002", None] * 100:
        often = rng.choice([2, 5, 10, 20, 40])
        shared = run(51, between) if between else "".join(word() + (" " if rng.randrange(often) else ". ") for _ in range(51)).strip()
        one, two = (f"{run(rng.randint(0, 40))} {shared} {run(rng.randint(0, 40))}" for _ in range(2))
        assert keys(one) & keys(two), between
    for _ in range(50):
        han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n))
        shared = han(51)
        assert keys(han(rng.randint(0, 40)) + shared + han(30)) & keys(han(rng.randint(0, 40)) + shared + han(30))
    assert substring_dedup.sentences('He said "no." Then\u3002So') == ['He said "no." ', "Then\u3002", "So"]


def test_packing_covers_every_id(make, edge_pairs):
    pairs = [(i, t) for i, t in edge_pairs if i != 6] + [(500, "a\u018fli \u0186kyere \u0189e \u0181ala \u0130stanbul")] + [(1000 + k, prose(random.Random(k), 1 + k % 60)) for k in range(300)]
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    pairs += [(501, "one <|endoftext|> two"), (502, "<|startoftext|>x<|ENDOFTEXT|>"), (503, "<|endoftext |> <|end")]
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in pairs}
    got = packing.pack(make(pairs)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(ids[i])
    assert set(by_doc) == set(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and len(parts) <= packing.Limits().segments
        padding += 2048 - at if at & (at - 1) else 0
    assert padding < 0.01 * sum(map(len, ids.values()))


def test_packing_ids_of_every_plain_character():
    known = packing.WordIds(public_tokenizers.path(packing.TOKENIZER))
    for at in range(0x21, 0x250):
        for text in (f"ab{chr(at)}cd", f"{chr(at)}x {chr(at)}", f"1{chr(at)}"):
            assert known.encode(text) == known.ids(text).tobytes(), hex(at)


def test_packing_makes_words_in_use_once(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 8)
    known = packing.WordIds(public_tokenizers.path(packing.TOKENIZER))
    made, model = Counter(), known.model
    known.model = SimpleNamespace(tokenize=lambda w: made.update([w]) or model.tokenize(w))
    for i in range(200):
        text = f"in use über x{'abcdefghij'[i // 10 % 10]}{'klmnopqrst'[i % 10]} y{i // 100 * 'z'}"
        assert known.encode(text) == known.ids(text).tobytes()
    assert made["in"] == made["use"] == 1 and len(known) + len(known.older) <= 2 * (8 + 5)
    assert made["xak"] > 1  # forgotten in between


def test_packing_remembers_words_in_little_memory():
    known = packing.WordIds(public_tokenizers.path(packing.TOKENIZER))
    known.model = SimpleNamespace(tokenize=lambda w: [SimpleNamespace(id=1), SimpleNamespace(id=2)])
    tracemalloc.start()
    try:
        for i in range(0, 1_000_000, 1000):
            known.encode(" ".join("".join("abcdefghij"[int(c)] for c in str(j)) for j in range(i, i + 1000)))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 80e6, most


def test_packing_of_repeated_rows(make):
    got = packing.pack(make([(6, "the same text"), (6, "the same text"), (None, "another"), (None, None)])).collect()
    one = {r["doc_tokens"] for r in got if r["doc_id"] == 6}
    assert len(one) == 1 and sum(r["length"] for r in got if r["doc_id"] == 6) == 2 * one.pop()
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 1 + next(r["doc_tokens"] for r in got if r["doc_id"] is None and r["doc_tokens"] > 1)


def test_packing_short_documents_and_limits(spark):
    limits = packing.Limits(tokens=64, segments=4, loss=64)
    pieces = [(i, 0, b"\1\0\0\0" * n, n) for i, n in enumerate([1] * 40 + [100] + [30] * 9)]
    out = list(packing.sequences(pieces, limits))
    assert sum(len(p[2]) for s in out for p in s) == sum(len(p[2]) for p in pieces)
    sizes = [sum(len(p[2]) // 4 for p in s) for s in out]
    assert all(len(s) <= 4 for s in out) and all(n <= 64 and n & (n - 1) == 0 for n in sizes)
    rng = random.Random(2)
    items = [(i, rng.randint(1, 60), rng.randint(1, 3), rng.randint(0, 50)) for i in range(400)] + [(400, 500, 1, 1), (401, None, None, None)]
    df = spark.createDataFrame(items, "example_id long, tokens long, segments long, loss long")
    limits = packing.Limits(tokens=100, segments=5, loss=80)
    used = defaultdict(list)
    for r in packing.pack_examples(df, limits).collect():
        used[r["sequence_id"]].append(items[r["example_id"]])
    assert sorted(x[0] for s in used.values() for x in s) == list(range(402))
    assert all(len(s) == 1 or sum(x[1] or 0 for x in s) <= 100 and sum(x[2] or 0 for x in s) <= 5 and sum(x[3] or 0 for x in s) <= 80 for s in used.values())
    assert len(used) < 1.25 * sum(max((x[1] or 0) / 100, (x[2] or 0) / 5, (x[3] or 0) / 80) for x in items)


def test_spotsigs_next_and_edited(make, edge_pairs):
    pairs = [(i, t) for i, t in edge_pairs if len(t or "") < 50_000] + [(20 + k, prose(random.Random(k // 2), 5)) for k in range(60)]
    ordered = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""))
    want = []
    for k, (i, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = (spotsigs.signatures(x) for x in (t, edited, nxt))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.digest_of(a), spotsigs.digest_of(b), spotsigs.likeness(a, b), spotsigs.likeness(a, c)))
    for size in (500, 7):
        got = spotsigs.fingerprint(make(pairs), size)
        assert rows(got, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next") == sorted(want, key=repr)


def test_spotsigs_hot_ids(make):
    """Rows of one id and of null, most of all, some of them alike: in many buckets, each row before the next one."""
    texts = [prose(random.Random(k), 2) for k in range(40)]
    ids = [7] * 1200 + [None] * 900 + [2**62 + k for k in range(150)] + list(range(150))
    docs = make([(i, texts[k * k % 40]) for k, i in enumerate(ids)])
    placed = with_row(docs, "row", ["doc_id", "text"]).select("doc_id", "text", F.xxhash64("row").alias("turn")).collect()
    ordered = sorted(placed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["turn"]))
    want = []
    for k, r in enumerate(ordered):
        t, nxt = r["text"], ordered[(k + 1) % len(ordered)]["text"]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((r["doc_id"], len(t), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.likeness(spotsigs.signatures(t), spotsigs.signatures(nxt))))
    assert rows(spotsigs.fingerprint(docs, 100), "doc_id", "n_chars", "edited_sha256", "near_next") == sorted(want, key=repr)
    sizes = [r["count"] for r in spotsigs.with_next(docs, 100).groupBy("bucket").count().collect()]
    assert max(sizes) < 300 and sum(sizes) == len(ids) + len(sizes)


def test_spotsigs_classes(make):
    rng = random.Random(4)
    base = [prose(rng, 12) for _ in range(8)]
    texts = [t for b in base for t in (b, b + " " + sentence(rng), sentence(rng) + " " + b, b)] + [prose(rng, 12) for _ in range(30)] + ["", None, "one"]
    pairs = list(enumerate(texts))
    # a family of near copies of one text, itself repeated
    stem = [sentence(rng) for _ in range(20)]
    family = [" ".join(stem[:k] + [sentence(rng)] + stem[k + 1 :]) for k in range(20) for _ in range(2)]
    pairs += list(enumerate([" ".join(stem)] * 3 + family, len(pairs)))
    sets = {i: spotsigs.signatures(t) for i, t in pairs}
    links = [(a, b) for a, b in combinations(sets, 2) if spotsigs.likeness(sets[a], sets[b]) >= 0.8]
    assert dict(rows(spotsigs.near_duplicates(make(pairs)), "doc_id", "class_id")) == find(links, sets) and len(links) > 20


def test_tables_of_the_driver(spark):
    docs = table(spark, SF, "documents")
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoding(public_tokenizers.path(bpe.RANKS))._mergeable_ranks, special_tokens={})
    texts = dict(rows(docs, "doc_id", "text"))
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(docs).collect()} == {i: len(enc.encode_ordinary(t)) for i, t in texts.items()}
    fps = {i: fingerprint(t) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert dict(rows(simhash.near_duplicates(docs), "doc_id", "component_id")) == find(links, fps)
    assert rows(substring_dedup.dedup(docs), "doc_id", "text") == sorted(substrings_by_force(list(texts.items())), key=repr)
