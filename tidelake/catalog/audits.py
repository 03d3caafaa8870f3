"""Queries on object inventories, requests, records and free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.catalog import standin as s
from tidelake.catalog.registry import query, with_ctes
from tidelake.functions.redact import (
    SECRET_NAMES,
    normalize_reason,
    reason_label,
    redact,
    safe_url,
)
from tidelake.operators.coverage import coverage, window_gaps, write_conflicts
from tidelake.operators.objects import audit_objects
from tidelake.operators.requests import ACTION_LOG, BACKFILL, validate_requests
from tidelake.operators.results import audit_results

# ---- object inventory -------------------------------------------------------

# Text both engines understand: object URIs made from the page URLs.
_URI = """CASE page_id % 8
  WHEN 0 THEN root || day || '/part-0.parquet'
  WHEN 1 THEN root || day || '/part-0.parquet.staging-' || substr(md5(url), 1, 8)
  WHEN 2 THEN root || day || '/shard=00' || CAST(page_id % 5 AS STRING) || '/part-0.parquet'
  WHEN 3 THEN root || '/..' || day || '/part-0.parquet'
  WHEN 4 THEN url
  WHEN 5 THEN root || day || '/quarantine.jsonl'
  WHEN 6 THEN 'gs://bucket-' || CAST(page_id AS STRING)
  ELSE root || day || '/part-00017.parquet/' END"""
_ROOT = """'gs://' || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"""
_DAY = "'/dt=2024-01-' || lpad(CAST(page_id % 34 AS STRING), 2, '0')"


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    pages = s.table(spark, sf, "pages").select("page_id", "url")
    parts = pages.withColumns({"root": F.expr(_ROOT), "day": F.expr(_DAY)})
    return parts.select("page_id", F.expr(_URI).alias("uri"))


def _audit_sql(strict: bool) -> str:
    rest = "uri[6:]" if strict else "trim(uri[6:], '/')"
    return with_ctes(
        """SELECT page_id, uri,
          CASE WHEN normal THEN bucket END AS bucket,
          CASE WHEN normal AND dt IS NOT NULL
              THEN regexp_extract(path, '^(?:(.*?)/)?dt=\\d{4}-\\d\\d-\\d\\d/', 1)
            WHEN normal THEN regexp_extract(path, '^(.*)/[^/]*$', 1) END AS prefix,
          CASE WHEN normal THEN dt END AS dt,
          CASE WHEN normal THEN string_split(path, '/')[-1] END AS file,
          CASE WHEN NOT ours THEN 'foreign' WHEN NOT normal THEN 'not_normalized'
            WHEN dt IS NOT NULL AND regexp_full_match(tail, 'part-[^/]*\\.parquet')
              THEN 'canonical'
            WHEN dt IS NOT NULL
              AND regexp_full_match(tail, 'part-[^/]*\\.parquet\\.staging-[^/]+') THEN 'staging'
            WHEN dt IS NOT NULL
              AND regexp_full_match(tail, 'shard=[^/]+/part-[^/]*\\.parquet') THEN 'shard'
            ELSE 'other' END AS class
        FROM judged""",
        f"""objects AS (
          SELECT page_id, {_URI} AS uri
          FROM (SELECT page_id, url, {_ROOT} AS root, {_DAY} AS day FROM pages))""",
        f"""cut AS (
          SELECT *, starts_with(uri, 'gs://') AS ours, string_split({rest}, '/')[1] AS bucket,
            array_to_string(string_split({rest}, '/')[2:], '/') AS path FROM objects)""",
        """judged AS (
          SELECT *, ours AND bucket <> '' AND path <> ''
              AND NOT list_has_any(string_split(path, '/'), ['', '.', '..']) AS normal,
            TRY_CAST(regexp_extract(path, '(?:^|/)dt=(\\d{4}-\\d\\d-\\d\\d)/', 1) AS DATE) AS dt,
            regexp_extract(path, '(?:^|/)dt=\\d{4}-\\d\\d-\\d\\d/(.*)$', 1) AS tail
          FROM cut)""",
    )


@query("object_audit", _audit_sql(strict=False))
def object_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit_objects(_inventory(spark, sf))


@query("object_audit_strict", _audit_sql(strict=True))
def object_audit_strict(spark: SparkSession, sf: str) -> DataFrame:
    return audit_objects(_inventory(spark, sf), strict=True)


# ---- URLs and text ----------------------------------------------------------

_LINK = """CASE page_id % 6
  WHEN 0 THEN url
  WHEN 1 THEN replace(url, '://', '://user:' || substr(md5(url), 1, 6) || '@')
  WHEN 2 THEN 'javascript:alert(' || CAST(page_id AS STRING) || ')'
  WHEN 3 THEN url || '&token=' || md5(url)
  WHEN 4 THEN 'HTTPS' || regexp_replace(url, '^https?', '') || '/a@b'
  ELSE ' ' || url END"""

# The rules of redaction in SQL. RE2 has no look-behind: the character before a bare key or
# the word "bearer" is taken into the match and put back.
_NAMES = f"(?:{'|'.join(SECRET_NAMES)})"
_WS = "\\s\\v\\x1c-\\x1f\\x{85}\\p{Z}"
_SET = f"[{_WS}]*[=:][{_WS}]*"
_REST = f"[^,;{_WS}]+"


def _redact_sql(text: str) -> str:
    # an authority follows a piece that ends in a scheme; the colon stands for a next ://
    ends_in_scheme = r"(^|[^\p{L}\p{N}_])[a-z][a-z0-9+.-]*$"
    pieces = f"string_split({text}, '://')"
    more = f"CASE WHEN i < len({pieces}) THEN ':' ELSE '' END"
    hidden = f"regexp_replace(p || {more}, '^([^/@:{_WS}]+:)[^@/?#{_WS}]+@', '\\1[REDACTED]@', 'i')"
    allowed = "[a-z0-9._~!$&''()*+,;=%-]+"
    followed = rf"(@(?:[a-z0-9.-]+|\[[0-9a-f:.]+\])(?::\d+)?(?:[/?#{_WS}]|$))"
    hidden = f"regexp_replace({hidden}, '^{allowed}{followed}', '[REDACTED]\\1', 'i')"
    text = f"""array_to_string(list_transform({pieces}, lambda p, i:
      CASE WHEN i > 1 AND regexp_matches({pieces}[i - 1], '{ends_in_scheme}', 'i')
        THEN left({hidden}, CAST(len({hidden}) - len({more}) AS BIGINT)) ELSE p END), '://')"""
    keys, values = [f"(?:^|[^a-z0-9]){_NAMES}"], []
    for sign in ('"', "''"):
        keys.append(f"{sign}(?:[a-z0-9_]*_)?{_NAMES}{sign}")
        values.append(rf"({sign})(?:[^{sign}\\\r\n]|\\[^\r\n])*{sign}")
    for pattern, replacement in (
        (f"((?:{'|'.join(keys)}){_SET})(?:{'|'.join(values)})", r"\1\2\3[REDACTED]\2\3"),
        (f"((?:^|[^a-z0-9]){_NAMES}{_SET}){_REST}", r"\1[REDACTED]"),
        (rf"((?:^|[^\p{{L}}\p{{N}}_])bearer[{_WS}]+){_REST}", r"\1[REDACTED]"),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'gi')"
    return text


@query(
    "safe_url",
    f"""SELECT page_id, link, CASE WHEN regexp_matches(link, '^ *https?:', 'i')
        AND NOT regexp_matches(link, '^ *https?://[^/?#]*@', 'i')
      THEN left({_redact_sql('link')}, 2000) END AS safe
    FROM (SELECT page_id, {_LINK} AS link FROM pages)""",
)
def safe_urls(spark: SparkSession, sf: str) -> DataFrame:
    pages = s.table(spark, sf, "pages").select("page_id", F.expr(_LINK).alias("link"))
    return pages.withColumn("safe", safe_url(F.col("link")))


# Credentials in every supported form, and two look-alikes, behind the document texts.
_LEAKY = """text || CASE doc_id % 7
  WHEN 0 THEN ' BEARER ' || md5(text) || '; rest'
  WHEN 1 THEN ' amqp://writer:' || substr(md5(text), 1, 9) || '@broker-7.example:5671/jobs'
  WHEN 2 THEN ' svn+ssh://' || md5(text) || '@[fe80::1]:3690/trunk'
  WHEN 3 THEN ' [{"id": 4, "nightly_api_key" : "' || md5(text) || ' and more"}]'
  WHEN 4 THEN ' old_PASSWORD : ' || md5(text) || ',Secret_Key=x mytoken=kept'
  WHEN 5 THEN ' http://mirror.example/a@b?c=@d http://' || md5(text) || '@mirror.example://x'
  ELSE '' END"""


@query(
    "redact_text",
    f"""SELECT doc_id, {_redact_sql('leaky')} AS redacted, left({_redact_sql('leaky')}, 2000)
      AS shown FROM (SELECT doc_id, {_LEAKY} AS leaky FROM documents)""",
)
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = s.table(spark, sf, "documents").select("doc_id", F.expr(_LEAKY).alias("leaky"))
    return docs.select(
        "doc_id",
        redact(F.col("leaky"), None).alias("redacted"),
        redact(F.col("leaky")).alias("shown"),
    )


@query(
    "redact_simple",
    f"""SELECT doc_id, {_redact_sql('text')} <> text AS leaks, {_redact_sql('text')} AS redacted
    FROM documents""",
)
def redact_simple(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as they are."""
    docs = s.table(spark, sf, "documents").select("doc_id", "text")
    clean = docs.withColumn("redacted", redact(F.col("text"), None))
    return clean.select("doc_id", (F.col("redacted") != F.col("text")).alias("leaks"), "redacted")


_REASON = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '  ' END"
_EXCEPTION = "CASE WHEN doc_id % 2 = 0 THEN 'RuntimeError: <' || text || '> & token=' || md5(text) END"


def _line_sql(text: str) -> str:
    escaped = f"left({_redact_sql(text)}, 2000)"
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = f"replace({escaped}, '{raw}', '{entity}')"
    return f"left(trim(regexp_replace({escaped}, '[{_WS}]+', ' ', 'g')), 1000)"


@query(
    "reason_normalize",
    f"""SELECT doc_id,
      CASE WHEN trim(reason) <> '' THEN 'reason' WHEN exception IS NOT NULL THEN 'exception'
        ELSE 'default' END AS label,
      CASE WHEN trim(reason) <> '' THEN {_line_sql('reason')}
        WHEN exception IS NOT NULL THEN {_line_sql('exception')}
        ELSE 'see the task log for the cause' END AS line
    FROM (SELECT doc_id, {_REASON} AS reason, {_EXCEPTION} AS exception FROM documents)""",
)
def reasons(spark: SparkSession, sf: str) -> DataFrame:
    docs = s.table(spark, sf, "documents").select(
        "doc_id", F.expr(_REASON).alias("reason"), F.expr(_EXCEPTION).alias("exception")
    )
    pair = (F.col("reason"), F.col("exception"))
    return docs.select(
        "doc_id", reason_label(*pair).alias("label"), normalize_reason(*pair).alias("line")
    )


# ---- requests and records ---------------------------------------------------

_RUN = "'gs://reef/qa/action-log/run=' || CAST(o_orderkey AS STRING)"


def _conf(prefix: str, youtube: str, users: str, output: str, aside: str, more: str = "''") -> str:
    return (
        f"""'{{"qa_prefix": "' || {prefix} || '", "youtube_base_path": "' || {youtube}"""
        f""" || '", "virtual_users_path": "' || {users}"""
        f""" || '", "action_log_output_base_path": "' || {output}"""
        f""" || '", "action_log_quarantine_base_path": "' || {aside} || '"' || {more} || '}}'"""
    )


def _conf_in_run(prefix: str = _RUN, more: str = "''", **paths: str) -> str:
    parts = {
        "youtube": f"{_RUN} || '/youtube'",
        "users": f"{_RUN} || '/users.parquet'",
        "output": f"{_RUN} || '/final'",
        "aside": f"{_RUN} || '/aside'",
        **paths,
    }
    return _conf(prefix, parts["youtube"], parts["users"], parts["output"], parts["aside"], more)


_COUNT = """', "candidates_per_user": ' || CASE o_custkey % 8 WHEN 0 THEN '0' WHEN 1 THEN '201'
  WHEN 2 THEN 'true' WHEN 3 THEN '"1.5"' WHEN 4 THEN '"many"' WHEN 5 THEN '200'
  WHEN 6 THEN '" 24 "' ELSE '20.0' END"""
_REQUEST = f"""CASE o_orderkey % 14
  WHEN 0 THEN '{{}}'
  WHEN 1 THEN '{{"partition_date": "2024-01-10", "overwrite": true}}'
  WHEN 2 THEN {_conf_in_run(more="', " + '"candidates_per_user": 20' + "'")}
  WHEN 3 THEN '{{"qa_prefix": "' || {_RUN} || '", "youtube_base_path": "' || {_RUN} || '/y"}}'
  WHEN 4 THEN {_conf_in_run(prefix="'gs://reef/live/log'")}
  WHEN 5 THEN {_conf_in_run(output="'gs://reef/live/log'")}
  WHEN 6 THEN {_conf_in_run(aside=_RUN + " || '/final'")}
  WHEN 7 THEN {_conf_in_run(youtube=_RUN + " || '/../youtube'")}
  WHEN 8 THEN '{{"speed": "x", "colour": "y"}}'
  WHEN 9 THEN {_conf_in_run(more=_COUNT)}
  WHEN 10 THEN '{{"candidates_per_user": "24"}}'
  WHEN 11 THEN '{{"qa_prefix": '
  WHEN 12 THEN {_conf_in_run(prefix=_RUN + " || '/'")}
  ELSE {_conf_in_run(prefix="'gs://reef//qa/action-log/x'")} END"""

# Key names and namespaces are the contract's, here and in the SQL below.
_PATH_KEYS = list(ACTION_LOG.paths)


def _text_sql(key: str) -> str:
    return (
        f"CASE WHEN json_type(doc, '$.{key}') = 'VARCHAR' "
        f"AND trim(doc->>'{key}') <> '' THEN rtrim(trim(doc->>'{key}'), '/') END"
    )


_ODD = "list_has_any(string_split(replace({0}, 'gs://', ''), '/'), ['', '.', '..'])"


@query(
    "request_audit",
    with_ctes(
        """SELECT o_orderkey, concat_ws('; ',
            CASE WHEN doc IS NULL THEN 'not a JSON object' END,
            CASE WHEN len(unknown) > 0 THEN 'unsupported keys: ' || array_to_string(unknown, ', ')
              END,
            CASE WHEN trial AND prefix IS NULL THEN 'qa_prefix is missing' END,
            CASE WHEN trial AND prefix_odd THEN 'qa_prefix is not normalized' END,
            CASE WHEN trial AND NOT prefix_odd AND NOT regexp_matches(replace(prefix, 'gs://', ''),
              '(^|/)qa/action-log/[^/]') THEN 'qa_prefix is outside its namespace' END,
            CASE WHEN trial AND len(paths) < 4 THEN 'paths are missing' END,
            CASE WHEN trial AND len(list_distinct(paths)) < len(paths)
              THEN 'paths are not distinct' END,
            CASE WHEN trial AND path_odd THEN 'path is not normalized' END,
            CASE WHEN trial AND outside THEN 'path is outside qa_prefix' END,
            CASE WHEN kind IS NOT NULL AND NOT whole
              THEN 'candidates_per_user is not an integer' END,
            CASE WHEN kind IS NOT NULL AND whole
              AND NOT (TRY_CAST(raw AS BIGINT) BETWEEN 1 AND 200)
              THEN 'candidates_per_user is out of range' END) AS errors
        FROM judged""",
        f"requests AS (SELECT o_orderkey, {_REQUEST} AS conf FROM orders)",
        """docs AS (SELECT o_orderkey,
            CASE WHEN json_valid(conf) THEN CAST(conf AS JSON) END AS doc FROM requests)""",
        f"""fields AS (SELECT *, {_text_sql('qa_prefix')} AS prefix,
            list_filter([{', '.join(_text_sql(k) for k in _PATH_KEYS)}], lambda x: x IS NOT NULL)
              AS paths,
            json_type(doc, '$.candidates_per_user') AS kind,
            trim(doc->>'candidates_per_user') AS raw,
            coalesce(json_keys(doc), []) AS keys FROM docs)""",
        f"""judged AS (SELECT *,
            list_sort(list_filter(keys, lambda k: k NOT IN ('partition_date', 'overwrite',
              'candidates_per_user', 'qa_prefix', {', '.join(f"'{k}'" for k in _PATH_KEYS)})))
              AS unknown,
            list_has_any(keys, ['candidates_per_user', 'qa_prefix',
              {', '.join(f"'{k}'" for k in _PATH_KEYS)}]) AS trial,
            {_ODD.format('prefix')} AS prefix_odd,
            len(list_filter(paths, lambda p: {_ODD.format('p')})) > 0 AS path_odd,
            len(list_filter(paths, lambda p: NOT starts_with(p, prefix || '/'))) > 0 AS outside,
            kind IN ('UBIGINT', 'BIGINT')
              OR (kind = 'VARCHAR' AND regexp_full_match(raw, '[0-9]+')) AS whole
          FROM fields)""",
    ),
)
def request_audit(spark: SparkSession, sf: str) -> DataFrame:
    """One run request per order, right and wrong in many ways."""
    requests = s.table(spark, sf, "orders").select("o_orderkey", F.expr(_REQUEST).alias("conf"))
    audited = validate_requests(requests, ACTION_LOG)
    return audited.select("o_orderkey", F.array_join("errors", "; ").alias("errors"))


_BACKFILL_RUN = "'gs://reef/qa/youtube-backfill/run=' || CAST(o_orderkey AS STRING)"


def _backfill_conf(prefix: str, source: str, target: str) -> str:
    return (
        f"""'{{"qa_prefix": "' || {prefix} || '", "source_path": "' || {source}"""
        f""" || '", "youtube_base_path": "' || {target} || '"}}'"""
    )


_OTHER = "gs://reef/qa/sandbox/run=1"
_FORMS = {
    "right": (_BACKFILL_RUN, _BACKFILL_RUN + " || '/in.parquet'", _BACKFILL_RUN + " || '/out'"),
    "outside": (_BACKFILL_RUN, _BACKFILL_RUN + " || '/in'", "'gs://reef/live/out'"),
    "elsewhere": (f"'{_OTHER}'", f"'{_OTHER}/in'", f"'{_OTHER}/out'"),
    "same": (_BACKFILL_RUN, _BACKFILL_RUN + " || '/in'", _BACKFILL_RUN + " || '/in'"),
    "odd": (_BACKFILL_RUN, _BACKFILL_RUN + " || '/in//x'", _BACKFILL_RUN + " || '/out/'"),
}
_BACKFILL_REQUEST = f"""CASE o_orderkey % 7
  WHEN 0 THEN '{{}}'
  WHEN 1 THEN {_backfill_conf(*_FORMS["right"])}
  WHEN 2 THEN '{{"source_path": "' || {_BACKFILL_RUN} || '"}}'
  WHEN 3 THEN {_backfill_conf(*_FORMS["outside"])}
  WHEN 4 THEN {_backfill_conf(*_FORMS["elsewhere"])}
  WHEN 5 THEN {_backfill_conf(*_FORMS["same"])}
  ELSE {_backfill_conf(*_FORMS["odd"])} END"""


def _strict_text_sql(key: str) -> str:
    return (
        f"CASE WHEN json_type(doc, '$.{key}') = 'VARCHAR' "
        f"AND trim(doc->>'{key}') <> '' THEN trim(doc->>'{key}') END"
    )


_STRICT = "(starts_with({0}, 'gs://') AND regexp_full_match({0}[6:], '[^/]+(/[^/]+)+'))"


@query(
    "backfill_request_audit",
    with_ctes(
        f"""SELECT o_orderkey, concat_ws('; ',
            CASE WHEN trial AND prefix IS NULL THEN 'qa_prefix is missing' END,
            CASE WHEN trial AND NOT {_STRICT.format('prefix')} THEN 'qa_prefix is not normalized'
              END,
            CASE WHEN trial AND {_STRICT.format('prefix')} AND NOT regexp_full_match(prefix[6:],
              '[^/]+/qa/youtube-backfill/[^/]+') THEN 'qa_prefix is outside its namespace' END,
            CASE WHEN trial AND len(paths) < 2 THEN 'paths are missing' END,
            CASE WHEN trial AND len(list_distinct(paths)) < len(paths)
              THEN 'paths are not distinct' END,
            CASE WHEN trial AND len(list_filter(paths, lambda p: NOT {_STRICT.format('p')})) > 0
              THEN 'path is not normalized' END,
            CASE WHEN trial AND len(list_filter(paths,
              lambda p: NOT starts_with(p, prefix || '/'))) > 0
              THEN 'path is outside qa_prefix' END) AS errors
        FROM fields""",
        f"""docs AS (SELECT o_orderkey, CAST({_BACKFILL_REQUEST} AS JSON) AS doc FROM orders)""",
        f"""fields AS (SELECT o_orderkey, len(json_keys(doc)) > 0 AS trial,
            {_strict_text_sql('qa_prefix')} AS prefix,
            list_filter([{', '.join(_strict_text_sql(k) for k in BACKFILL.paths)}],
              lambda x: x IS NOT NULL) AS paths FROM docs)""",
    ),
)
def backfill_request_audit(spark: SparkSession, sf: str) -> DataFrame:
    requests = s.table(spark, sf, "orders").select(
        "o_orderkey", F.expr(_BACKFILL_REQUEST).alias("conf")
    )
    audited = validate_requests(requests, BACKFILL)
    return audited.select("o_orderkey", F.array_join("errors", "; ").alias("errors"))


_RECORD = """'{"event": "model_promotion_result", "contract_version": "model-promotion-result-v'
  || CASE WHEN c_custkey % 19 = 1 THEN '2' ELSE '1' END
  || '", "outcome": "' || CASE c_custkey % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'no_candidate'
       ELSE 'promoted' END
  || '", "reason_code": "' || CASE c_nationkey % 6 WHEN 0 THEN 'first_champion'
       WHEN 1 THEN 'metric_not_degraded' WHEN 2 THEN 'metric_below_champion'
       WHEN 3 THEN 'calibration_artifact_missing' WHEN 4 THEN 'serving_calibration_not_ready'
       ELSE 'felt_right' END
  || '", "model_name": ' || CASE WHEN c_custkey % 17 = 2 THEN 'null' ELSE '"tide"' END
  || ', "champion_alias": "' || CASE WHEN c_custkey % 23 = 3 THEN ' ' ELSE 'best' END
  || '", "candidate_version": "' || CAST(c_custkey AS STRING)
  || '", "metric_name": "' || CASE WHEN c_custkey % 13 = 4 THEN 'log_loss' ELSE 'val_roc_auc' END
  || '", "candidate_metric": ' || CASE c_custkey % 11 WHEN 5 THEN 'null' WHEN 6 THEN 'true'
       WHEN 7 THEN '"0.6"' ELSE '0.6425' END
  || CASE c_custkey % 4 WHEN 0 THEN ', "champion_version": "29", "champion_metric": 0.6375'
       WHEN 1 THEN ', "champion_version": null, "champion_metric": null'
       WHEN 2 THEN ', "champion_version": "29", "champion_metric": "0.6375"' ELSE '' END || '}'"""


@query(
    "promotion_result_audit",
    with_ctes(
        """SELECT c_custkey, concat_ws('; ',
            CASE WHEN contract <> 'model-promotion-result-v1' THEN 'unknown contract' END,
            CASE WHEN outcome NOT IN ('promoted', 'rejected') THEN 'unknown outcome' END,
            CASE WHEN (outcome = 'promoted'
                AND reason NOT IN ('first_champion', 'metric_not_degraded'))
              OR (outcome = 'rejected' AND reason NOT IN ('metric_below_champion',
                'calibration_artifact_missing', 'serving_calibration_not_ready'))
              THEN 'reason does not fit the outcome' END,
            CASE WHEN model IS NULL THEN 'model_name is missing' END,
            CASE WHEN trim(alias) = '' THEN 'champion_alias is missing' END,
            CASE WHEN metric <> 'val_roc_auc' THEN 'unknown metric' END,
            CASE WHEN kind <> 'DOUBLE' THEN 'candidate_metric is not a finite number' END,
            CASE WHEN reason = 'first_champion' AND old <> 'absent'
              THEN 'first champion has a predecessor' END,
            CASE WHEN reason IN ('metric_not_degraded', 'metric_below_champion')
              AND old <> 'complete' THEN 'champion is incomplete' END,
            CASE WHEN reason NOT IN ('first_champion', 'metric_not_degraded',
              'metric_below_champion') AND old = 'half' THEN 'champion is half given' END) AS errors
        FROM fields""",
        f"records AS (SELECT c_custkey, CAST({_RECORD} AS JSON) AS doc FROM customer)",
        """fields AS (SELECT c_custkey, doc->>'contract_version' AS contract,
            doc->>'outcome' AS outcome, doc->>'reason_code' AS reason,
            doc->>'model_name' AS model, doc->>'champion_alias' AS alias,
            doc->>'metric_name' AS metric, json_type(doc, '$.candidate_metric') AS kind,
            CASE WHEN json_type(doc, '$.champion_metric') = 'DOUBLE' THEN 'complete'
              WHEN doc->>'champion_version' IS NULL THEN 'absent' ELSE 'half' END AS old
          FROM records)""",
    ),
)
def promotion_result_audit(spark: SparkSession, sf: str) -> DataFrame:
    """One result record per customer, right and wrong in many ways."""
    records = s.table(spark, sf, "customer").select("c_custkey", F.expr(_RECORD).alias("record"))
    audited = audit_results(records)
    return audited.select("c_custkey", F.array_join("errors", "; ").alias("errors"))


# ---- sets of tables and days ------------------------------------------------


def _tables(spark: SparkSession, sf: str, kinds: list[str], above: float) -> DataFrame:
    log = s.action_log(spark, sf).where(F.col("event_type").isin(*kinds) & (F.col("value") > above))
    return log.select(F.col("event_type").alias("table_name"), "dt").distinct()


@query(
    "table_coverage",
    with_ctes(
        """SELECT table_name, dt, 'not_produced' AS gap
          FROM (SELECT * FROM required EXCEPT SELECT * FROM produced)
        UNION ALL SELECT table_name, dt, 'not_required'
          FROM (SELECT * FROM produced EXCEPT SELECT * FROM required)""",
        s.LOG,
        """produced AS (SELECT DISTINCT event_type AS table_name, dt FROM log
          WHERE event_type IN ('impression', 'click', 'like') AND value > 150)""",
        """required AS (SELECT DISTINCT event_type AS table_name, dt FROM log
          WHERE event_type IN ('impression', 'click', 'view') AND value > 100)""",
    ),
)
def table_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Tables and days with high-valued events stand for produced and required ones."""
    produced = _tables(spark, sf, ["impression", "click", "like"], 150)
    required = _tables(spark, sf, ["impression", "click", "view"], 100)
    return coverage(produced, required, ["table_name", "dt"])


@query(
    "write_conflicts",
    with_ctes(
        """SELECT DISTINCT event_type AS table_name, dt FROM log
          WHERE event_type IN ('impression', 'click') AND value > 150
        INTERSECT SELECT DISTINCT event_type, dt FROM log
          WHERE event_type IN ('click', 'view') AND value > 180""",
        s.LOG,
    ),
)
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    a = _tables(spark, sf, ["impression", "click"], 150)
    return write_conflicts(a, _tables(spark, sf, ["click", "view"], 180))


@query(
    "window_gaps",
    with_ctes(
        f"""SELECT t AS table_name, CAST(d AS DATE) AS dt
        FROM (VALUES ('impression'), ('click'), ('view')) tables(t),
          generate_series(DATE '{s.WINDOW[0]}', DATE '{s.WINDOW[1]}', INTERVAL 1 DAY) days(d)
        WHERE NOT EXISTS (SELECT 1 FROM log
          WHERE event_type = t AND dt = CAST(d AS DATE) AND value > 200)""",
        s.LOG,
    ),
)
def gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Which tables lack which days of the training window; as above, high-valued
    events stand for tables and days."""
    inventory = _tables(spark, sf, ["impression", "click", "view", "like"], 200)
    return window_gaps(inventory, ["impression", "click", "view"], *s.WINDOW)
