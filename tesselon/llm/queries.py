"""Queries over the driver's tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesselon.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm.token_counts import token_counts

    # A deployment names the folder of its lasting cache; without one all texts are misses.
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path(), spark.conf.get("spark.tesselon.tokenCache", None))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm.ann import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 50 = 0"), 5)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm.quality import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), 85)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm.bpe import roundtrip_digests

    return roundtrip_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tesselon.llm.licenses import scan_licenses

    m = F.col("matches")
    span = lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size(m).cast("long").alias("n_matches"),
        F.array_join(F.sort_array(F.array_distinct(m["license"])), ",").alias("licenses"),
        F.array_join(F.transform(m, span), ",").alias("spans"),
    )


def op10_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesselon.llm.hmm import language_scores

    return language_scores(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"


def _quality_sql() -> str:
    from tesselon.llm.quality import RULES, STOP_WORDS

    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    broken = []
    for r in RULES:
        num, _, den = (x.strip() for x in r.measure.partition("/"))
        value = f"CASE WHEN {den} > 0 THEN {num}::DOUBLE / {den} ELSE 0 END" if den else f"{num}::DOUBLE"
        broken += [f"({value}) < {r.low}"] if r.low is not None else []
        broken += [f"({value}) > {r.high}"] if r.high is not None else []
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, {_WORDS} AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x, {blank}) <> '') AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
p AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(l) AS n_lines, len(list_filter(w, lambda x: list_contains({list(STOP_WORDS)}, lower(x)))) AS n_stop_words,
    coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS max_word_chars,
    length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters
  FROM w LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({' OR '.join(broken)}) AS kept
FROM m"""


_NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, {_WORDS} AS w FROM d),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5
  UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_ >= 85 * (p.n + q.n - both_)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


_MIX_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || chr(1) || t) AS h
  FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
level AS (
  SELECT 0 AS it, sum(size)::HUGEINT AS lft, sum(w)::HUGEINT AS total, 0 AS n FROM s
  UNION ALL
  SELECT it + 1, sum(size) - 3 * coalesce(sum(size) FILTER (high), 0), sum(w) FILTER (NOT high), count(*) FILTER (high)
  FROM (SELECT it, n, size, w, lft * w > 3 * size::HUGEINT * total AS high FROM level, s)
  GROUP BY it, n HAVING count(*) FILTER (high) <> n AND count(*) FILTER (NOT high) > 0),
t AS (
  SELECT source, size AS source_size, CASE WHEN lft * w > 3 * size::HUGEINT * total THEN (3 * size)::DOUBLE ELSE w::DOUBLE * (lft::DOUBLE / total::DOUBLE) END AS target
  FROM s, (SELECT lft, total FROM level ORDER BY it DESC LIMIT 1)),
e AS (SELECT *, CASE WHEN source_size > 0 AND target > 0 THEN round(least(3, target / source_size), 12) ELSE 0 END AS e FROM t),
r AS (SELECT source, source_size, target, CASE WHEN abs(e - round(e)) < 1e-7 THEN round(e) ELSE e END AS rate FROM e),
b AS (
  SELECT source, size, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, size, count(*) AS n FROM d GROUP BY source, size)),
c AS (
  SELECT r.source, size, n, source_size, target, floor(rate)::BIGINT AS whole,
    (floor((before + n) * (rate - floor(rate)) + 0.5) - floor(before * (rate - floor(rate)) + 0.5))::BIGINT AS take
  FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source),
x AS (
  SELECT 0 AS it, * FROM c
  UNION ALL
  SELECT it + 1, source, size, n, source_size, target, whole, take + CASE WHEN best.s = -size THEN best.p ELSE 0 END
  FROM (
    SELECT *, min(list_min([CASE WHEN l < abs(gap) - 1e-6 THEN {{'l': l, 's': -size, 'p': (m * sign(gap))::BIGINT}} END,
                            CASE WHEN l2 < abs(gap) - 1e-6 THEN {{'l': l2, 's': -size, 'p': (m2 * sign(gap))::BIGINT}} END])) OVER (PARTITION BY source) AS best
    FROM (
      SELECT *, CASE WHEN room > 0 AND size > 0 AND abs(gap) > 0.5 THEN abs(abs(gap) - m * size) END AS l,
        CASE WHEN room > 0 AND size > 0 AND abs(gap) > 0.5 THEN abs(abs(gap) - m2 * size) END AS l2
      FROM (
        SELECT *, least(room, greatest(1, floor(abs(gap) / greatest(size, 1))))::BIGINT AS m, least(room, floor(abs(gap) / greatest(size, 1)) + 1)::BIGINT AS m2
        FROM (
          SELECT *, CASE WHEN gap < 0 THEN take WHEN whole < 3 THEN n - take ELSE 0 END AS room
          FROM (SELECT *, target - sum(size * (n * whole + take)) OVER (PARTITION BY source) AS gap FROM x)))))
  WHERE best IS NOT NULL),
f AS (SELECT * FROM x QUALIFY it = max(it) OVER (PARTITION BY source)),
k AS (
  SELECT doc_id, d.size, f.source_size, f.target, d.source,
    f.whole + CASE WHEN row_number() OVER (PARTITION BY d.source, d.size ORDER BY h, doc_id NULLS FIRST) <= f.take THEN 1 ELSE 0 END AS copies
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.size = f.size)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM k"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": _quality_sql(), "op5_near_duplicates": _NEAR_SQL, "op6_source_mixing": _MIX_SQL}
