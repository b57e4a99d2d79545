"""The text operators as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import bpe, clusters, conversations, fingerprints, html_text, language, licenses, near_dup, pii, quality, token_counts, urls
from . import decontaminate as leaks
from .common import table

QUERIES = {}
ORACLE = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_license_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a license notice, with the best window of each template."""
    return licenses.find_licenses(table(spark, d, "documents"))


@query
def op2_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rule statistics of every document with the base rule's and the forest's verdict."""
    stats = materialize(quality.rule_statistics(table(spark, d, "documents")), "statistics")
    judged = quality.judge(stats, quality.fit(stats, table(spark, d, "labels")))
    shown = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return judged.select(*shown)


@query
def op3_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.count_tokens(table(spark, d, "documents"))


@query
def op4_url_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    judged = urls.judge_urls(table(spark, d, "pages"), urls.train())
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op5_minhash_near_dup(spark: SparkSession, d: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return near_dup.near_duplicates(table(spark, d, "documents"), threshold=0.85)


@query
def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark item, with the best window of each."""
    return leaks.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


ORACLE["op6_decontamination"] = r"""
WITH items AS (
  SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k
  FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM benchmark WHERE text IS NOT NULL)
  WHERE w <> ['']
),
docs AS (
  SELECT doc_id, w FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents WHERE text IS NOT NULL)
  WHERE w <> ['']
),
item_grams AS (SELECT item_id, n, k, i - 1 AS at, array_to_string(w[i:i + k - 1], ' ') AS gram FROM items, unnest(range(1, n - k + 2)) AS t(i)),
doc_grams AS (
  SELECT doc_id, len(w) AS length, k, i - 1 AS at, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM docs, (SELECT DISTINCT k FROM items), unnest(range(1, len(w) - k + 2)) AS t(i)
),
suspects AS (SELECT DISTINCT d.doc_id, d.length, g.n, g.k FROM doc_grams d JOIN item_grams g USING (gram, k)),
windows AS (SELECT doc_id, n, k, start FROM suspects, unnest(range(0, greatest(length - n, 0) + 1)) AS t(start)),
window_counts AS (
  SELECT v.doc_id, v.n, v.start, g.gram, count(*) AS c
  FROM windows v JOIN doc_grams g ON g.doc_id = v.doc_id AND g.k = v.k AND g.at BETWEEN v.start AND v.start + v.n - v.k
  GROUP BY ALL
),
item_counts AS (SELECT item_id, n, gram, count(*) AS c FROM item_grams GROUP BY ALL),
window_totals AS (SELECT doc_id, n, start, sum(c) AS c FROM window_counts GROUP BY ALL),
item_totals AS (SELECT item_id, n, sum(c) AS c FROM item_counts GROUP BY ALL),
common AS (
  SELECT doc_id, item_id, n, start, sum(least(a.c, b.c)) AS shared
  FROM window_counts a JOIN item_counts b USING (n, gram) GROUP BY ALL
),
judged AS (
  SELECT doc_id, item_id, start, n, shared, x.c + y.c - shared AS total
  FROM common JOIN window_totals x USING (doc_id, n, start) JOIN item_totals y USING (item_id, n)
)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start_word, CAST(n AS INTEGER) AS n_words, CAST(shared AS INTEGER) AS shared, CAST(total AS INTEGER) AS total
FROM judged WHERE 5 * shared >= 4 * total
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / total DESC, start) = 1
"""


@query
def op7_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Token counts and digests of every document's ids and of what they decode to."""
    return bpe.digests(bpe.encode_documents(table(spark, d, "documents")))


@query
def op8_personal_data(spark: SparkSession, d: str) -> DataFrame:
    """Personal data of every document."""
    return pii.digests(pii.find_personal_data(table(spark, d, "documents")))


@query
def op9_language_id(spark: SparkSession, d: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, d, "documents")
    found = language.predict_languages(docs, language.fit(docs))
    return found.select("doc_id", F.expr(language.held_out()).alias("held_out"), "lang_pred", "score")


@query
def op10_html_text(spark: SparkSession, d: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.extract_main_text(table(spark, d, "pages"), html_text.train())
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op11_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprints.fingerprints(table(spark, d, "documents"))


@query
def op12_centroid_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Cluster of every vector of 64 finite components."""
    return clusters.cluster(table(spark, d, "embeddings"))


def _cluster_sql(clusters: int = 40, rounds: int = 5) -> str:
    """All distances in every round."""
    steps = [
        "kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x"
        " FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        f"centres0 AS (SELECT row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), x) - 1 AS k, x AS c FROM kept QUALIFY k < {clusters})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"near{i} AS MATERIALIZED (SELECT id, any_value(vec_id) AS vec_id, any_value(x) AS x, min(struct_pack(d := d, k := k)) AS best FROM"
            f" (SELECT id, vec_id, x, k, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, centres{i}) GROUP BY id)"
        )
        if i < rounds:
            steps.append(
                f"means{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT best.k AS k, i, sum(x[i]) AS s, count(*) AS n FROM near{i}, unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY k),\n"
                f"centres{i + 1} AS MATERIALIZED (SELECT k, coalesce(list_transform(m.c, lambda e: CAST(e AS BIGINT)), o.c) AS c FROM centres{i} o LEFT JOIN means{i} m USING (k))"
            )
    last = f"""SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{rounds} JOIN centres{rounds} ON k = best.k"""
    return "WITH " + ",\n".join(steps) + "\n" + last


ORACLE["op12_centroid_clusters"] = _cluster_sql()


@query
def op13_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    """Faults of every conversation after a fixed damage, and its cheapest repair."""
    return conversations.repair(conversations.damage(table(spark, d, "conversations")))


ORACLE["op13_conversation_repair"] = r"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda c: ascii(c)::BIGINT)),
    lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))) % 20 AS kind
  FROM conversations
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM hashed, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS t(copy)
),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
  FROM ordered
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id
),
states(q, follow, said) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
inserts AS (
  SELECT q, q AS q2, '' AS letters, '' AS lines FROM states
  UNION ALL SELECT q, follow, 'I', said || ':' || chr(10) FROM states
  UNION ALL SELECT a.q, b.follow, 'II', a.said || ':' || chr(10) || b.said || ':' || chr(10) FROM states a JOIN states b ON b.q = a.follow
),
options AS (
  SELECT q, follow AS q2, 'R' AS letter, 3 AS cost, said, ''::VARCHAR AS initial FROM states
  UNION ALL SELECT q, q, 'D', 4, ''::VARCHAR, '' FROM states
  UNION ALL SELECT * FROM (VALUES (0, 1, 'K', 0, '', 's'), (0, 2, 'K', 0, '', 'u'), (1, 2, 'K', 0, '', 'u'), (3, 2, 'K', 0, '', 'u'), (2, 3, 'K', 0, '', 'a'))
),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS lines FROM counts
  UNION ALL
  SELECT w.conv_id, w.i + 1, o.q2, w.cost + 3 * len(s.letters) + o.cost + CASE WHEN f.fault = 'truncated' AND o.letter <> 'D' THEN 3 ELSE 0 END AS total, w.audit || s.letters || o.letter AS way,
    w.lines || s.lines || CASE WHEN o.letter = 'D' THEN '' ELSE CASE o.letter WHEN 'K' THEN f.role ELSE o.said END || ':' || f.text || chr(10) END
  FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN inserts s ON s.q = w.q JOIN options o ON o.q = s.q2
  WHERE (o.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (o.letter <> 'K' OR o.initial = left(f.role, 1))
  QUALIFY row_number() OVER (PARTITION BY w.conv_id, o.q2 ORDER BY total, way) = 1
),
best AS (
  SELECT w.conv_id, w.cost + 3 * len(s.letters) AS cost, w.audit || s.letters AS audit, w.lines || s.lines AS lines
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i JOIN inserts s ON s.q = w.q
  WHERE s.q2 IN (0, 3) QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 3 * len(s.letters), w.audit || s.letters) = 1
)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(left(coalesce(lines, ''), greatest(len(lines) - 1, 0))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id
"""
