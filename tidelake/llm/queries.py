"""The operators on their whole tables, registered for the driver, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelake.llm import alignment, centroids, chat, exact_dedup, langid, licences, mixing, pieces, pii, repeats, simhash, topk, warc
from tidelake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return put


@_register("op1_pii")
def private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    (('0x' || substr(md5(concat('mix|', coalesce(doc_id::VARCHAR, ''), '|', coalesce(text, ''))), 1, 12))::BIGINT
      + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight,
    3 * source_size AS lim FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS r FROM w),
l AS (
  SELECT o.*, (SELECT sum(source_size) FROM o) - coalesce((SELECT sum(lim) FROM o p WHERE p.r < o.r), 0) AS rest,
    (SELECT sum(weight) FROM o) - coalesce((SELECT sum(weight) FROM o p WHERE p.r < o.r), 0) AS shares FROM o),
lev AS (
  SELECT rest::DOUBLE / shares::DOUBLE AS level FROM l
  WHERE rest::DOUBLE / shares::DOUBLE <= lim / weight ORDER BY r LIMIT 1),
t AS (
  SELECT source, source_size, least(lim::DOUBLE, level * weight::DOUBLE) AS target FROM o, lev),
c AS (
  SELECT source, source_size, target, least(3, target / nullif(source_size, 0)::DOUBLE) AS due FROM t),
k AS (
  SELECT d.*, source_size, target, due, target - floor(due) * source_size AS wanted,
    CASE WHEN due < 3 THEN u * (1 - (due - floor(due)))
      / (u * (1 - (due - floor(due))) + (due - floor(due)) * (1 - u)) END AS rnk
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source WHERE size > 0),
q AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rnk) AS total FROM k),
n AS (
  SELECT source, arg_min(rnk, abs(total - wanted)) AS cut, min(abs(total - wanted)) AS off,
    any_value(wanted) AS wanted FROM q WHERE rnk IS NOT NULL GROUP BY source),
cuts AS (
  SELECT source, CASE WHEN wanted > 0 AND off < wanted THEN cut ELSE -1 END AS cut FROM n)
SELECT d.doc_id, d.size::BIGINT AS size, coalesce(c.source_size, 0)::BIGINT AS source_size,
  coalesce(c.target, 0) AS target,
  (CASE WHEN d.size = 0 THEN 0 ELSE d.size * (floor(c.due) + CASE WHEN k.rnk <= cuts.cut THEN 1 ELSE 0 END) END)::BIGINT
    AS taken
FROM d LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
LEFT JOIN k ON d.doc_id = k.doc_id
LEFT JOIN cuts ON d.source IS NOT DISTINCT FROM cuts.source
"""


@_register("op2_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@_register("op3_substring_dedup")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated(table(spark, sf_dir, "documents")).drop("text_key")


@_register("op4_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


@_register("op5_licence_scan")
def licence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@_register("op6_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(table(spark, sf_dir, "documents"), model)


@_register("op7_simhash")
def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@_register(
    "op8_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages),
    f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY payload) END AS first FROM p)
    SELECT page_id, n AS payload_bytes, sha256(payload) AS payload_digest,
      CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first <> page_id THEN first END AS refers_to
    FROM f
    """,
)
def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@_register(
    "op9_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
      vec_id, score
    FROM s QUALIFY rank <= 20
    """,
)
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@_register(
    "op10_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
      doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: A conversation that says the template's own marks.
PROBE = [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]


@_register(
    "op11_chat_format",
    f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, '{PROBE[0][0]}', '{PROBE[0][1]}' UNION ALL SELECT -1, 1, '{PROBE[1][0]}', '{PROBE[1][1]}'),
    e AS (
      SELECT *, role = 'assistant' AS reply, regexp_replace(text, '{chat.PLAIN_PATTERN}', '\\1\\\\\\2', 'g') AS shown,
        replace(replace(regexp_replace(role, '{chat.PLAIN_PATTERN}', '\\1\\\\\\2', 'g'), '\\', '\\s'), chr(10), '\\n') AS head
      FROM c)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (reply), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (reply), '')) AS loss_sha256,
      sum(length(shown) + CASE WHEN reply THEN length('<s>  </s>') ELSE length('[INST]   [/INST]') + length(head) END)::BIGINT
        AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_rows(table(spark, sf_dir, "conversations"), -1, PROBE))


@_register("op12_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level, model = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.digests(table(spark, sf_dir, "documents"), byte_level, model)


def _cluster_sql(rounds: int) -> str:
    """One common table per step of every round, over one row per vector and dimension."""
    step = """
    f{i} AS MATERIALIZED (
      SELECT vec_id, c, sum((p.x - q.x) * (p.x - q.x))::BIGINT AS far FROM p JOIN c{i} q ON p.d = q.d GROUP BY ALL),
    a{i} AS MATERIALIZED (
      SELECT * FROM f{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY far, c) = 1)"""
    move = """,
    m{i} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{i} JOIN p USING (vec_id) GROUP BY c, d),
    c{j} AS MATERIALIZED (
      SELECT q.c, q.d, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, q.x)::BIGINT AS x
      FROM c{i} q LEFT JOIN m{i} m ON q.c = m.c AND q.d = m.d),"""
    steps = "".join((step + (move if i < rounds else "")).format(i=i, j=i + 1) for i in range(rounds + 1))
    return f"""
    WITH k AS MATERIALIZED (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
    p AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS d, unnest(v) AS x FROM k),
    n AS (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM k),
    c0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS d, unnest(v) AS x FROM n WHERE c < 40),
    {steps},
    h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
    SELECT vec_id, c::INTEGER AS cluster, far AS distance, (sum(far) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
      (sum(far) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM a{rounds} JOIN h USING (c)
    """


@_register("op13_centroid_clusters", _cluster_sql(centroids.ROUNDS))
def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))
