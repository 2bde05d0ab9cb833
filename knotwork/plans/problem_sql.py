"""The general problems' queries in SQL, written independently of the operators."""

from __future__ import annotations


def _latest(table: str, key: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY recorded_at DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1)"


def _copies(table: str, key: str, fields: list[str]) -> str:
    a, b = _latest(table, key), _latest(f"{table}_copy", key)
    sides = f"""
        SELECT '{table}' AS table_name, coalesce(a.{key}, b.{key}) AS record_id, CASE WHEN b.{key} IS NULL THEN 'only_first' ELSE 'only_second' END AS difference
        FROM {a} a FULL JOIN {b} b ON a.{key} = b.{key} WHERE a.{key} IS NULL OR b.{key} IS NULL"""
    cells = [
        f"SELECT '{table}', a.{key}, '{f}' FROM {a} a JOIN {b} b ON a.{key} = b.{key} WHERE a.{f} IS DISTINCT FROM b.{f}" for f in fields
    ]
    return " UNION ALL ".join([sides, *cells])


def _valued(table: str, key: str, fields: list[str]) -> str:
    """The same with both sides' values, arrays as JSON."""
    a, b = _latest(table, key), _latest(f"{table}_copy", key)
    sides = f"""
        SELECT '{table}' AS table_name, coalesce(a.{key}, b.{key}) AS record_id, CASE WHEN b.{key} IS NULL THEN 'only_first' ELSE 'only_second' END AS difference,
            CAST(NULL AS VARCHAR) AS first_value, CAST(NULL AS VARCHAR) AS second_value
        FROM {a} a FULL JOIN {b} b ON a.{key} = b.{key} WHERE a.{key} IS NULL OR b.{key} IS NULL"""
    show = lambda f: "CAST(to_json({0}.%s) AS VARCHAR)" % f if f.startswith("evidence") else "{0}.%s" % f  # noqa: E731, UP031
    cells = [
        f"SELECT '{table}', a.{key}, '{f}', CASE WHEN a.{f} IS NULL THEN NULL ELSE {show(f).format('a')} END, CASE WHEN b.{f} IS NULL THEN NULL ELSE {show(f).format('b')} END "
        f"FROM {a} a JOIN {b} b ON a.{key} = b.{key} WHERE a.{f} IS DISTINCT FROM b.{f}"
        for f in fields
    ]
    return " UNION ALL ".join([sides, *cells])


_RELATION = ["source.lecture_id", "source.ko_id", "target.lecture_id", "target.ko_id", "relation_type", "evidence_spans", "rationale"]
_CONNECTION = ["source_canonical_ko_id", "target_canonical_ko_id", "relation_type", "evidence_ids", "rationale"]

P1 = f"{_copies('relation_predictions', 'pair_id', _RELATION)} UNION ALL {_copies('connection_predictions', 'canonical_pair_id', _CONNECTION)}"

_TEXT = "(CASE json_type({0}) WHEN 'ARRAY' THEN json_extract_string({0}, '$[0]') ELSE json_extract_string({0}, '$') END)"
_HELD = """
    WITH valid AS (SELECT file_id, feed, modified_at, CAST(content AS JSON) AS j FROM raw_files WHERE json_valid(content) AND content <> ''),
    lists AS (
        SELECT file_id, feed, modified_at, CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_type(j, '$.results') = 'ARRAY' THEN json_extract(j, '$.results') ELSE json_array(j) END AS rs
        FROM valid),
    items AS (SELECT file_id, feed, modified_at, unnest(json_extract(rs, '$[*]')) AS r FROM lists),
    members AS (SELECT file_id, feed, modified_at, r, unnest(json_keys(r)) AS k FROM items WHERE json_type(r) = 'OBJECT'),
    vals AS (SELECT file_id, feed, k, json_extract(r, '$."' || k || '"') AS v FROM members),
    texts AS (SELECT file_id, feed, k, CASE json_type(v) WHEN 'ARRAY' THEN json_extract_string(v, '$[0]') ELSE json_extract_string(v, '$') END AS t FROM vals),
    ids AS (
        SELECT file_id, feed, CASE
            WHEN feed = 'relation' AND regexp_full_match(t, 'rel_dev_\\d+') THEN t
            WHEN feed = 'relation' AND k IN ('pair_id', 'pairId', 'PairID', 'pair_identifier', 'rel_pair', 'id') AND regexp_full_match(t, '\\d+') THEN printf('rel_dev_%08d', CAST(t AS BIGINT))
            WHEN feed = 'connection' AND regexp_full_match(t, 'conn_dev_pair_[0-9a-f]+') THEN t END AS record_id
        FROM texts)
"""
P2 = f"{_HELD} SELECT feed, record_id FROM ids WHERE record_id IS NOT NULL GROUP BY feed, record_id HAVING count(DISTINCT file_id) > 1"

P2_REJECTS = f"""{_HELD}, held AS (SELECT DISTINCT file_id FROM ids WHERE record_id IS NOT NULL),
    f AS (SELECT file_id, feed, CASE WHEN content IS NULL OR content = '' THEN 'empty' WHEN NOT json_valid(content) THEN 'not_json' ELSE 'no_record' END AS reason FROM raw_files)
    SELECT DISTINCT file_id, feed, reason FROM f WHERE file_id NOT IN (SELECT file_id FROM held)"""

_COPIES = f"""{_HELD.replace("    items AS", "    old_items AS").split("members AS")[0]}
    items AS (SELECT file_id, feed, modified_at, i, json_extract(rs, '$[' || i || ']') AS r FROM (SELECT *, unnest(range(CAST(json_array_length(rs) AS BIGINT))) AS i FROM lists)),
    members AS (SELECT file_id, i, feed, modified_at, r, unnest(json_keys(r)) AS k FROM items WHERE json_type(r) = 'OBJECT'),
    texts AS (SELECT *, json_extract(r, '$."' || k || '"') AS v FROM members),
    named AS (SELECT *, CASE json_type(v) WHEN 'ARRAY' THEN json_extract_string(v, '$[0]') ELSE json_extract_string(v, '$') END AS t FROM texts),
    copies AS (SELECT file_id, i, feed, modified_at, r, CASE
            WHEN feed = 'relation' AND regexp_full_match(t, 'rel_dev_\\d+') THEN t
            WHEN feed = 'relation' AND k IN ('pair_id', 'pairId', 'PairID', 'pair_identifier', 'rel_pair', 'id') AND regexp_full_match(t, '\\d+') THEN printf('rel_dev_%08d', CAST(t AS BIGINT))
            WHEN feed = 'connection' AND regexp_full_match(t, 'conn_dev_pair_[0-9a-f]+') THEN t END AS record_id FROM named)"""
P2_RECORDS = f"""{_COPIES}, best AS (SELECT *, row_number() OVER (PARTITION BY feed, record_id ORDER BY modified_at DESC NULLS LAST, file_id DESC, i) AS n,
        (SELECT count(DISTINCT c.file_id) FROM copies c WHERE c.feed = copies.feed AND c.record_id = copies.record_id) AS n_files FROM copies WHERE record_id IS NOT NULL)
    SELECT feed, record_id, file_id, modified_at, n_files, json_extract_string(r, '$.rationale') AS rationale FROM best WHERE n = 1"""
P2_JOURNAL = f"""{_HELD} SELECT feed, 3 AS n_levels, count(DISTINCT file_id) AS n_files, (SELECT count(DISTINCT record_id) FROM ids WHERE ids.feed = raw_files.feed AND record_id IS NOT NULL) AS n_records, CAST(0 AS BIGINT) AS n_unbalanced
    FROM raw_files GROUP BY feed"""

_REFS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {r} AS record_id, '{c}.ko_id' AS field_name, {c}.lecture_id AS l, {c}.ko_id AS k, recorded_at AS ts FROM {t} WHERE {c}.ko_id IS NOT NULL"
    for t, r, c in (("relation_predictions", "pair_id", "source"), ("relation_predictions", "pair_id", "target"), ("relation_errors", "error_id", "predicted_source"))
)
_ORPHANS = f"""
    WITH refs AS ({_REFS}),
    lost AS (
        SELECT * FROM refs WHERE NOT EXISTS (
            SELECT 1 FROM knowledge_objects o
            WHERE o.lecture_id = refs.l AND o.predicted_ko_id = refs.k AND o.created_at <= refs.ts AND (o.deleted_at IS NULL OR o.deleted_at > refs.ts)))
"""
P4 = f"{_ORPHANS} SELECT DISTINCT table_name, record_id, field_name FROM lost"
P4_MONTH = f"""{_ORPHANS}
    SELECT table_name, field_name, CAST(date_trunc('month', ts) AS TIMESTAMP) AS period, count(*) AS n_references, count(DISTINCT record_id) AS n_records
    FROM lost GROUP BY 1, 2, 3"""

_RUNS = "runs AS (SELECT run_id, CAST(body AS JSON) AS j FROM run_metadata QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, loaded_at DESC, body DESC) = 1)"


def _unnested(name: str, source: str, ids: str, path: str) -> str:
    whole = f"json_extract(j, '$.{path}')"
    listed = f"CASE json_type({whole}) WHEN 'ARRAY' THEN {whole} WHEN 'OBJECT' THEN json_array({whole}) ELSE json_array() END"
    return f"""{name} AS (
        SELECT {ids}, n, json_extract(js, '$[' || n || ']') AS j
        FROM (SELECT {ids}, js, unnest(range(CAST(json_array_length(js) AS BIGINT))) AS n FROM (SELECT {ids}, {listed} AS js FROM {source})))"""


_NESTED = f"""WITH {_RUNS},
    {_unnested("r0", "runs", "run_id", "results")},
    r AS (SELECT run_id, n AS result_no, j FROM r0 WHERE json_type(j) = 'OBJECT'),
    {_unnested("s0", "r", "run_id, result_no", "evidence_spans")},
    s AS (SELECT run_id, result_no, n AS item_no, j FROM s0 WHERE json_type(j) = 'OBJECT'),
    {_unnested("a0", "r", "run_id, result_no", "attempts")},
    a AS (SELECT run_id, result_no, n AS item_no, j FROM a0 WHERE json_type(j) = 'OBJECT'),
    {_unnested("e0", "a", "run_id, result_no, item_no", "errors")},
    e AS (SELECT run_id, result_no, item_no, n AS subitem_no, j FROM e0 WHERE json_type(j) = 'OBJECT')
"""
P5 = f"""{_NESTED}
    SELECT run_id, 'result' AS child, result_no, CAST(-1 AS BIGINT) AS item_no, CAST(-1 AS BIGINT) AS subitem_no FROM r
    UNION ALL SELECT run_id, 'evidence_span', result_no, item_no, -1 FROM s
    UNION ALL SELECT run_id, 'attempt', result_no, item_no, -1 FROM a
    UNION ALL SELECT run_id, 'attempt_error', result_no, item_no, subitem_no FROM e"""
_GET = lambda path: f"json_extract_string(j, '$.{path}')"
P5_RESULTS = f"""{_NESTED}
    SELECT run_id, CAST(result_no AS INT) AS results_no, {_GET("pair_id")} AS pair_id, {_GET("source.lecture_id")} AS source_lecture_id, {_GET("source.ko_id")} AS source_ko_id,
        {_GET("target.lecture_id")} AS target_lecture_id, {_GET("target.ko_id")} AS target_ko_id, {_GET("relation_type")} AS relation_type FROM r"""
P5_SPANS = f"""{_NESTED}
    SELECT run_id, CAST(result_no AS INT) AS results_no, CAST(item_no AS INT) AS results_evidence_spans_no, {_GET("lecture_id")} AS lecture_id, {_GET("span")} AS span,
        {_GET("offsets.start")} AS offset_start, {_GET("offsets.end")} AS offset_end FROM s"""
P5_ATTEMPTS = f"""{_NESTED}
    SELECT run_id, CAST(result_no AS INT) AS results_no, CAST(item_no AS INT) AS results_attempts_no, {_GET("latency_ms")} AS latency_ms, {_GET("finish_reason")} AS finish_reason,
        {_GET("usage.prompt_tokens")} AS prompt_tokens, {_GET("usage.completion_tokens")} AS completion_tokens FROM a"""
P5_ERRORS = f"""{_NESTED}
    SELECT run_id, CAST(result_no AS INT) AS results_no, CAST(item_no AS INT) AS results_attempts_no, CAST(subitem_no AS INT) AS results_attempts_errors_no,
        {_GET("error_type")} AS error_type, {_GET("message")} AS message FROM e"""
P5_RUNS = f"""WITH {_RUNS}
    SELECT run_id, {_GET("artifact_type")} AS artifact_type, {_GET("version")} AS version, {_GET("request_parameters.model")} AS model,
        {_GET("request_parameters.temperature")} AS temperature, {_GET("request_parameters.top_p")} AS top_p, {_GET("request_parameters.max_tokens")} AS max_tokens,
        {_GET("request_parameters.response_format.type")} AS response_format, {_GET("request_parameters.thinking.type")} AS thinking,
        {_GET("inputs.prompt.path")} AS prompt_path, {_GET("inputs.prompt.sha256")} AS prompt_sha256,
        {_GET("inputs.candidate_bundle.path")} AS bundle_path, {_GET("inputs.candidate_bundle.sha256")} AS bundle_sha256 FROM runs"""

P5_REJECTS = """WITH r AS (SELECT run_id, body FROM run_metadata QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, loaded_at DESC, body DESC) = 1),
    f AS (SELECT run_id, CASE WHEN body IS NULL THEN 'null' WHEN trim(body) = '' THEN 'empty' WHEN NOT json_valid(body) THEN 'not_json' END AS reason FROM r)
    SELECT run_id, reason FROM f WHERE reason IS NOT NULL"""
_ROW_KEY = """sha256(CAST(to_json({{'pair_id': pair_id, 'source': source, 'target': target, 'relation_type': relation_type, 'evidence_spans': evidence_spans, 'rationale': rationale, 'run_id': run_id,
    'recorded_at': CAST(recorded_at AS VARCHAR), 'loaded_at': CAST(loaded_at AS VARCHAR)}}) AS VARCHAR))""".replace("{{", "{").replace("}}", "}")
P5_PAIRS = f"""SELECT DISTINCT {_ROW_KEY} AS row_key, pair_id, source.lecture_id AS source_lecture_id, source.ko_id AS source_ko_id, target.lecture_id AS target_lecture_id, target.ko_id AS target_ko_id,
    relation_type, rationale, run_id, recorded_at, loaded_at FROM relation_predictions"""
P5_PAIR_SPANS = f"""WITH r AS (SELECT DISTINCT {_ROW_KEY} AS row_key, evidence_spans FROM relation_predictions), x AS (SELECT row_key, unnest(range(len(evidence_spans))) AS n, unnest(evidence_spans) AS s FROM r)
    SELECT row_key, CAST(n AS INT) AS span_no, s.lecture_id AS lecture_id, s.span AS span FROM x WHERE s IS NOT NULL"""

P1_VALUES = f"{_valued('relation_predictions', 'pair_id', _RELATION)} UNION ALL {_valued('connection_predictions', 'canonical_pair_id', _CONNECTION)}"

ORACLE = {
    "p1_found": P1, "p1_differences": P1_VALUES, "p2_found": P2, "p2_rejects": P2_REJECTS, "p2_records": P2_RECORDS, "p2_journal": P2_JOURNAL, "p4_found": P4, "p4_by_month": P4_MONTH,
    "p5_found": P5, "p5_runs": P5_RUNS, "p5_results": P5_RESULTS, "p5_evidence_spans": P5_SPANS, "p5_attempts": P5_ATTEMPTS, "p5_attempt_errors": P5_ERRORS,
    "p5_rejects": P5_REJECTS, "p5_pairs": P5_PAIRS, "p5_pair_spans": P5_PAIR_SPANS,
}
