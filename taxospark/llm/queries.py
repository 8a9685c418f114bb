"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxospark.llm import alignment, bpe, collocation, exact_dedup, langid, lm_score, ngram_join, packing, quality, simhash, spotsigs, substring_dedup, toxicity
from taxospark.llm.common import table, with_row


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_row(table(spark, sf_dir, "documents"), "_row").select("doc_id", "text", "_row")
    return substring_dedup.dedup(docs, row="_row").select("doc_id", "n_removed", "text")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint(table(spark, sf_dir, "documents"))


def spotsigs_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate classes behind op7's fingerprints, by set-length partitions and pruned Jaccard."""
    return spotsigs.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op13_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = (
        op1_substring_dedup, op2_byte_bpe, op3_toxicity, op4_simhash, op5_packing, op6_exact_dedup, op7_spotsigs, spotsigs_classes, op8_quality,
        op9_lm_score, op10_language_id, op11_alignment, op12_ngram_join, op13_collocation,
    )
    return {f.__name__: f for f in registered}


ORACLE = {
    "op12_ngram_join": """
        WITH RECURSIVE t AS (
            SELECT row_number() OVER () AS k, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT k, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g
            FROM t
        ), c AS (SELECT min(k) AS c, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
        e AS (SELECT c, n, unnest(g) AS x FROM c),
        link AS (
            SELECT a.c AS a, b.c AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
            GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
        root AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY a),
        known AS (SELECT s.k, s.doc_id, root.root FROM s JOIN c USING (g) JOIN root USING (c))
        SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN known.root IS NULL THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY known.root) END AS component_id,
            CASE WHEN len(s.g) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY s.g) END AS copies
        FROM s LEFT JOIN known USING (k)
    """,
    "op13_collocation": """
        WITH piece AS (
            SELECT row_number() OVER () AS p, lang, words FROM (
                SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM (
                    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
                )
            ) WHERE len(words) > 0
        ), suffix AS (
            SELECT lang, unnest(words) AS x, unnest(words[2:]) AS y, unnest(words[3:]) AS z FROM piece
        ), f1 AS (SELECT lang, x, count(*) AS f FROM suffix GROUP BY ALL),
        f2 AS (SELECT lang, x, y, count(*) AS f FROM suffix WHERE y IS NOT NULL GROUP BY ALL),
        f3 AS (SELECT lang, x, y, z, count(*) AS f FROM suffix WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        total AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
        longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
        cuts AS (
            SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, l.f AS l, r.f AS r, 1 AS k
            FROM f2 JOIN f1 AS l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 AS r ON r.lang = f2.lang AND r.x = f2.y
                LEFT JOIN longer AS t ON t.lang = f2.lang AND t.x = f2.x AND t.y = f2.y
            WHERE f2.f >= 10 AND (t.f IS NULL OR 100 * t.f < 50 * f2.f)
            UNION ALL
            SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, l.f, r.f, 1
            FROM f3 JOIN f1 AS l ON l.lang = f3.lang AND l.x = f3.x JOIN f2 AS r ON r.lang = f3.lang AND r.x = f3.y AND r.y = f3.z
            UNION ALL
            SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, l.f, r.f, 2
            FROM f3 JOIN f2 AS l ON l.lang = f3.lang AND l.x = f3.x AND l.y = f3.y JOIN f1 AS r ON r.lang = f3.lang AND r.x = f3.z
        ), scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, k AS cut
        FROM lowest JOIN total USING (lang) QUALIFY rank <= 2000
    """,
    "op9_lm_score": """
        WITH t AS (
            SELECT row_number() OVER () AS k, doc_id,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents
        ), g AS (
            SELECT k, unnest(words) AS w, unnest(list_concat([''], words)[1:len(words)]) AS v, unnest(list_concat(['', ''], words)[1:len(words)]) AS u,
                len(words) AS size FROM t WHERE len(words) > 0
        ), whole AS (SELECT count(*) AS texts, sum(len(words)) AS n FROM t WHERE len(words) > 0),
        c3 AS (SELECT u, v, w, count(*) AS c FROM g GROUP BY ALL), d3 AS (SELECT k, u, v, w, count(*) AS c FROM g GROUP BY ALL),
        c2 AS (SELECT v, w, count(*) AS c FROM g GROUP BY ALL UNION ALL SELECT '', '', texts FROM whole),
        d2 AS (SELECT k, v, w, count(*) AS c FROM g GROUP BY ALL UNION ALL SELECT DISTINCT k, '', '', 1 FROM g),
        c1 AS (SELECT w, count(*) AS c FROM g GROUP BY ALL UNION ALL SELECT '', texts FROM whole),
        d1 AS (SELECT k, w, count(*) AS c FROM g GROUP BY ALL UNION ALL SELECT DISTINCT k, '', 1 FROM g),
        left_ AS (
            SELECT g.k, c3.c - d3.c AS uvw, uv.c - own_uv.c AS uv, vw.c - own_vw.c AS vw, v1.c - own_v.c AS v, w1.c - own_w.c AS w, greatest(1, whole.n - size) AS n
            FROM g CROSS JOIN whole JOIN c3 USING (u, v, w) JOIN d3 USING (k, u, v, w)
            JOIN c2 AS uv ON uv.v = g.u AND uv.w = g.v JOIN d2 AS own_uv ON own_uv.k = g.k AND own_uv.v = g.u AND own_uv.w = g.v
            JOIN c2 AS vw ON vw.v = g.v AND vw.w = g.w JOIN d2 AS own_vw ON own_vw.k = g.k AND own_vw.v = g.v AND own_vw.w = g.w
            JOIN c1 AS v1 ON v1.w = g.v JOIN d1 AS own_v ON own_v.k = g.k AND own_v.w = g.v
            JOIN c1 AS w1 ON w1.w = g.w JOIN d1 AS own_w ON own_w.k = g.k AND own_w.w = g.w
        ), s AS (
            SELECT k, sum(CASE WHEN uvw > 0 THEN ln(uvw) - ln(uv) WHEN vw > 0 THEN ln(0.4) + ln(vw) - ln(v)
                WHEN w > 0 THEN 2 * ln(0.4) + ln(w) - ln(n) ELSE 3 * ln(0.4) - ln(n) END) AS total
            FROM left_ GROUP BY k
        )
        SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_tokens, round(coalesce(total, 0), 4) AS log_score,
            round(CASE WHEN len(words) > 0 THEN total / len(words) ELSE 0 END, 6) AS mean_log_score
        FROM t LEFT JOIN s USING (k)
    """,
    "op6_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
            row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
