import random

import pytest

WORDS = "alder birch cedar maple river stone valley meadow harbor lantern copper silver thunder winter summer garden bridge castle forest island".split()
COMMON = "the of and to in is that with".split()
#: Names that operators use inside; documents may have such columns too.
CLASHING = ("score", "label", "fp", "node", "digest", "spans", "_spans", "_id", "_doc", "bucket", "key", "part", "n", "sigs", "before", "at", "tail", "_metadata", "a.b", "n_removed", "_row")


def sentence(rng, least=8, most=14):
    words = [rng.choice(COMMON if i % 3 == 0 else WORDS) for i in range(rng.randint(least, most))]
    return " ".join(words).capitalize() + "."


def prose(rng, sentences):
    return " ".join(sentence(rng) for _ in range(sentences))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with further columns of clashing names, some of them null."""

    def documents(pairs, extra=True):
        names = ["doc_id long", "text string", "lang string", "source string", "n_chars long"] + ([f"`{c}` string" for c in CLASHING] if extra else [])
        rows = [(i, t, None if i is None else "en", None, len(t or "")) + ((None, "x") * len(CLASHING))[: len(CLASHING) if extra else 0] for i, t in pairs]
        return spark.createDataFrame(rows, ", ".join(names))

    return documents


@pytest.fixture(scope="session")
def edge_pairs():
    """Null and empty texts, a null id, white space only, ties, a repeated row, a very long text, and other scripts."""
    rng = random.Random(7)
    text = prose(rng, 6)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, text), (5, text.upper()), (6, text), (6, text), (None, prose(rng, 3)), (7, prose(rng, 30_000)),
        (8, "x" * 100_000), (9, "a" + " " * 5000 + "b"), (10, "Ünïcödé 漢字 😀 İstanbul"), (11, "!!! 123 ..."), (2**62, "last one"),
    ]
