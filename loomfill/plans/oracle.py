"""The same queries as SQL over the tables, for comparison in another engine."""

from __future__ import annotations

from loomfill.functions.text import BEGIN, END, EOS, HOLE

_FILES = r"""
d AS (
  SELECT concat_ws('/', coalesce(source, ''), coalesce(lang, ''), doc_id::VARCHAR) AS path, string_split(text, chr(10)) AS lines FROM documents
), f AS (
  SELECT path, lines, list_transform(lines, lambda x, i: CASE (i - 1) % 4
    WHEN 0 THEN 'use ' || x || ';'
    WHEN 1 THEN 'fn l' || (i - 1)::VARCHAR || '() { ' || x || ' }'
    WHEN 2 THEN 'struct S' || (i - 1)::VARCHAR || ' { ' || x || ' }'
    ELSE 'const C: &str = "' || x || '";' END) AS wrapped FROM d
), files AS (SELECT path, wrapped, array_to_string(wrapped, chr(10)) || chr(10) AS code FROM f
), n AS (SELECT path, code, unnest(wrapped) AS line, generate_subscripts(wrapped, 1) AS i FROM files
), nodes AS (
  SELECT path, code, line, i, ['Use', 'Function', 'Struct', 'Const'][(i - 1) % 4 + 1] AS node_type,
    coalesce(sum(length(line) + 1) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s
  FROM n
)"""
_BLOCKS = (
    _FILES
    + r""", both_kinds AS (
  SELECT path, code, i, 0 AS k, node_type, s, s + length(line) + 1 AS e FROM nodes
  UNION ALL
  SELECT path, code, i, 1, 'FunctionBody', s + instr(line, '{') - 1, s + length(line) FROM nodes WHERE node_type = 'Function'
), blocks AS (
  SELECT path, code, row_number() OVER (PARTITION BY path ORDER BY i, k) - 1 AS ord, node_type, s, e
  FROM both_kinds WHERE e - s BETWEEN 10 AND greatest(length(code) // 10, 30)
)"""
)
_SAMPLES = (
    _BLOCKS
    + r""", b1 AS (
  SELECT *, e - s AS mid, CASE WHEN ('0x' || substr(md5('42|' || path || '|' || ord::VARCHAR), 32, 1))::INT % 2 = 1 THEN 16000 ELSE 8000 END AS most FROM blocks
), b2 AS (SELECT *, (most - mid) // 2 AS before FROM b1 WHERE mid > 0 AND mid <= most
), samples AS (
  SELECT path AS file_path, ord, node_type,
    substr(code, (greatest(0, s - before) + 1)::BIGINT, (s - greatest(0, s - before))::BIGINT) AS prefix,
    substr(code, (s + 1)::BIGINT, mid::BIGINT) AS middle,
    CASE WHEN least(length(code), e + most - mid - before) > e THEN substr(code, (e + 1)::BIGINT, (least(length(code), e + most - mid - before) - e)::BIGINT) ELSE '' END AS suffix
  FROM b2
)"""
)
_SPLITS = (
    _FILES
    + r""", ranked AS (
  SELECT path, row_number() OVER (ORDER BY md5('42|' || path), path) AS k, count(*) OVER () AS n FROM files
), splits AS (SELECT path, CASE WHEN k <= floor(n * 0.98::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM ranked)"""
)
_TESTS = r"""
lines AS (
  SELECT doc_id, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), doc_id::VARCHAR) AS file_path,
    ['Use', 'Function', 'Struct', 'Const'][(doc_id % 4 + 1)::INT] AS node_type, coalesce(string_split(text, chr(10)), [NULL]) AS parts, lang
  FROM documents
), tests AS (
  SELECT doc_id * 4294967296 + i - 1 AS sample_id, file_path, node_type, parts[i] AS middle, lang
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM lines)
)"""


def _draw(draw: int) -> str:
    digit = f"('0x' || substr(md5(model || '|{draw}|' || sample_id::VARCHAR), 1, 2))::INT"
    return (
        f"CASE WHEN {digit} < CASE model WHEN 'tuned' THEN 96 ELSE 32 END THEN middle "
        f"WHEN {digit} < 176 THEN substr(middle, 1, length(middle) // 2) "
        f"WHEN instr(middle, ' ') > 0 THEN substr(middle, instr(middle, ' ') + 1) ELSE '' END"
    )


_SCORES = (
    _TESTS
    + f""", c AS (
  SELECT sample_id, file_path, node_type, middle, model, {_draw(0)} AS text, [{', '.join(_draw(k) for k in range(1, 6))}] AS draws,
    ('0x' || substr(md5(model || '|time|' || sample_id::VARCHAR), 1, 4))::INT AS code
  FROM tests CROSS JOIN (VALUES ('tuned'), ('baseline')) AS m(model)
), w AS (
  SELECT *, list_filter(regexp_extract_all(text, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '') AS a,
    list_filter(regexp_extract_all(middle, '[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '') AS b FROM c
), g AS (
  SELECT sample_id, model, n, a[i:i + n - 1] AS gram, 1 AS own, 0 AS other FROM w, range(1, 5) AS r(n), range(1, len(a) - n + 2) AS s(i)
  UNION ALL
  SELECT sample_id, model, n, b[i:i + n - 1], 0, 1 FROM w, range(1, 5) AS r(n), range(1, len(b) - n + 2) AS s(i)
), gc AS (SELECT sample_id, model, n, gram, sum(own) AS own, sum(other) AS other FROM g GROUP BY ALL
), p AS (
  SELECT sample_id, model, n, sum(least(own, other))::DOUBLE / sum(own)::DOUBLE AS p FROM gc GROUP BY ALL HAVING sum(own) > 0
), bl AS (
  SELECT sample_id, model, CASE WHEN min(p) > 0 THEN exp(avg(ln(CASE WHEN p > 0 THEN p END))) ELSE 0.0 END AS bleu FROM p GROUP BY ALL
), scores AS (
  SELECT w.sample_id, w.model, w.file_path, w.node_type, w.middle, w.text, w.text = w.middle AS exact_match, w.text = w.middle AS pass_at_1,
    list_contains(w.draws[1:3], w.middle) AS pass_at_3, list_contains(w.draws[1:5], w.middle) AS pass_at_5, list_contains(w.draws, w.middle) AS any_pass,
    -- a draw is a prefix or suffix of the middle, so the distance is the difference in length
    CASE WHEN length(w.middle) = 0 THEN 1.0 WHEN w.text = '' THEN 0.0 ELSE 1 - (length(w.middle) - length(w.text))::DOUBLE / length(w.middle) END AS edit_similarity,
    CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(list_concat(a, b))) ELSE 0.0 END AS token_overlap,
    CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / greatest(len(list_distinct(a)), len(list_distinct(b))) ELSE 0.0 END AS word_overlap,
    coalesce(bl.bleu, 0.0) AS bleu_score, code / 7.0::DOUBLE AS generation_time_ms, (code % 128)::INT AS generated_tokens
  FROM w LEFT JOIN bl ON bl.sample_id = w.sample_id AND bl.model = w.model
)"""
)
_SUMMARY = (
    "count(*) AS n, count(*) FILTER (pass_at_1) AS pass_at_1, count(*) FILTER (pass_at_3) AS pass_at_3, count(*) FILTER (pass_at_5) AS pass_at_5, "
    + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in ("edit_similarity", "token_overlap", "bleu_score", "generation_time_ms"))
)
_DELTA = (
    _SCORES
    + ", t AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, {f}(CASE WHEN model = 'tuned' THEN {v} END)::DOUBLE AS tuned, {f}(CASE WHEN model = 'baseline' THEN {v} END)::DOUBLE AS baseline FROM scores"
        for c, f, v in [(c, "sum", f"{c}::INT") for c in ("pass_at_1", "pass_at_3", "pass_at_5")]
        + [(c, "avg", c) for c in ("edit_similarity", "token_overlap", "bleu_score", "generation_time_ms")]
    )
    + ")"
)
_RUNNING = (
    _SCORES
    + """, run AS (
  SELECT model, sample_id, (sum(pass_at_1::INT) OVER w)::BIGINT AS passed, count(*) OVER w AS done FROM scores
  WINDOW w AS (PARTITION BY model ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""
)
_CHARS_MD5 = ", ".join(f"length({c}) AS {c}_chars, md5({c}) AS {c}_md5" for c in ("prefix", "middle", "suffix"))
_CLIP = "CASE WHEN length(t) <= {0} THEN t ELSE substr(t, 1, {0}) || ' …[truncated]' END"
_TEMPLATE = f"CASE WHEN turn % 2 = 0 AND coalesce(role, '') <> '' THEN '{BEGIN}' || text || '{HOLE}' || role || '{END}' ELSE text END"

ORACLE_SQL: dict[str, str] = {
    "node_type_counts": f"WITH {_FILES} SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type",
    "line_offsets": f"""WITH {_FILES}, l AS (SELECT path, unnest(string_split(code, chr(10))) AS t, generate_subscripts(string_split(code, chr(10)), 1) AS line FROM files),
        o AS (SELECT path, line, t, coalesce(sum(length(t) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l)
        SELECT path, line::INT AS line, start, start + length(t) + 1 AS "end" FROM o""",
    "line_lookups": f"""WITH {_FILES} SELECT path, 0::BIGINT AS before, 0::BIGINT AS first, length(wrapped[1]) + 1 AS second, length(code) + 1 AS past FROM files""",
    "parsed_spans": f"""WITH {_FILES} SELECT path, node_type, i::VARCHAR || ':' || i::VARCHAR AS span, CASE WHEN node_type = 'Use' THEN i::INT ELSE -1 END AS start_line, CASE WHEN node_type = 'Use' THEN i::INT ELSE -1 END AS end_line FROM nodes""",
    "extract_blocks": f'WITH {_BLOCKS} SELECT path, ord::INT AS ord, node_type, s::INT AS start, e::INT AS "end" FROM blocks',
    "function_body_blocks": f"WITH {_BLOCKS} SELECT path, ord::INT AS ord, node_type, s::INT AS start, e::INT AS \"end\" FROM blocks WHERE node_type = 'FunctionBody'",
    "fim_samples": f"WITH {_SAMPLES} SELECT file_path, ord, node_type, {_CHARS_MD5} FROM samples",
    "long_samples": f"WITH {_SAMPLES} SELECT file_path, ord, length(prefix) + length(middle) + length(suffix) AS n_chars FROM samples WHERE length(prefix) + length(middle) + length(suffix) > 6144",
    "split_assignment": f"WITH {_SPLITS} SELECT path, split FROM splits",
    "split_by_hash": f"WITH {_FILES} SELECT path, CASE WHEN ('0x' || substr(md5('42|' || path), 1, 8))::BIGINT % 10000 < 9800 THEN 'train' ELSE 'test' END AS split FROM files",
    "split_counts": f"""WITH {_SAMPLES}, {_SPLITS.removeprefix(_FILES).removeprefix(", ")}
        SELECT (SELECT count(*) FROM files) AS files, (SELECT count(code) FROM files) AS success,
          (SELECT count(*) FROM samples JOIN splits ON path = file_path WHERE split = 'train') AS train,
          (SELECT count(*) FROM samples JOIN splits ON path = file_path WHERE split = 'test') AS test""",
    "train_semi_join": f"WITH {_SPLITS} SELECT path, length(code) AS n_chars FROM files WHERE path IN (SELECT path FROM splits WHERE split = 'train')",
    "test_anti_join": f"WITH {_SPLITS} SELECT path, length(code) AS n_chars FROM files WHERE path NOT IN (SELECT path FROM splits WHERE split = 'train')",
    "sample_sorted": f"WITH {_TESTS} SELECT sample_id, node_type FROM tests ORDER BY md5('42|' || sample_id::VARCHAR), sample_id LIMIT 200",
    "sample_drawn": f"""WITH {_TESTS}, o AS (SELECT sample_id, node_type, row_number() OVER (ORDER BY md5('42|' || sample_id::VARCHAR), sample_id) - 1 AS id FROM tests)
        SELECT sample_id, node_type, id FROM o WHERE id < 200""",
    "train_subsample": f"WITH {_TESTS} SELECT sample_id FROM tests ORDER BY md5('3407|' || sample_id::VARCHAR), sample_id LIMIT 100",
    "latest_run": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1",
    "format_training_text": f"""WITH {_SAMPLES}, t AS (SELECT '{BEGIN}' || prefix || '{HOLE}' || suffix || '{END}' || middle || '{EOS}' AS text FROM samples)
        SELECT md5(text) AS text_md5, length(text) AS n_chars FROM t""",
    "prompt_roundtrip": """SELECT conv_id, turn,
        md5(CASE turn % 3 WHEN 0 THEN role ELSE text END) AS prefix_md5,
        md5(CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '' ELSE CASE WHEN turn % 2 = 0 THEN role ELSE '' END END) AS suffix_md5 FROM conversations""",
    "template_prompts": f"SELECT conv_id, turn, md5({_TEMPLATE}) AS prompt_md5 FROM conversations",
    "conversation_prompts": f"""SELECT a.conv_id, a.turn, md5('{BEGIN}' || a.text || '{HOLE}{END}') AS prompt_md5, md5(b.text) AS expected_md5
        FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'""",
    "stop_truncate": "SELECT doc_id, split_part(split_part(split_part(text, 'the', 1), '. ', 1), 'er', 1) AS text FROM documents",
    "blank_line_cut": "SELECT doc_id, split_part(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10), 1) AS text FROM documents",
    "keyword_any": f"WITH {_TESTS} SELECT sample_id, contains(lower(middle), 'tion') OR contains(lower(middle), 'qu') OR contains(lower(middle), lower(lang)) AS passed FROM tests",
    "clip_text": f"WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), '\\n') AS t FROM documents) SELECT doc_id, {_CLIP.format(300)} AS long, {_CLIP.format(120)} AS short FROM t",
    "format_duration": """WITH s AS (SELECT event_id, floor(abs(value) * 40)::BIGINT AS s FROM events)
        SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || 'h' || (s % 3600 // 60)::VARCHAR || 'm' WHEN s >= 60 THEN (s // 60)::VARCHAR || 'm' || (s % 60)::VARCHAR || 's' ELSE s::VARCHAR || 's' END AS duration FROM s""",
    "model_tags": "SELECT p_partkey, lower(replace(replace(p_name, ' ', '_'), '_', '-')) AS tag FROM part",
    "mask_tokens": "SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'R' THEN '-100' ELSE l_linenumber::VARCHAR END, ',' ORDER BY l_linenumber, l_returnflag = 'R') AS ids FROM lineitem GROUP BY l_orderkey",
    "default_fields": f"WITH {_TESTS} SELECT sample_id, CASE WHEN sample_id % 3 > 0 THEN file_path ELSE 'unknown' END AS file_path, CASE WHEN sample_id % 5 > 0 THEN node_type ELSE 'unknown' END AS node_type FROM tests",
    "request_checks": """SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS request_id, concat_ws(',',
        CASE WHEN turn % 4 = 3 THEN 'prefix' END, CASE WHEN conv_id % 700 NOT BETWEEN 1 AND 512 THEN 'max_tokens' END,
        CASE WHEN turn / 2.0 NOT BETWEEN 0 AND 2 THEN 'temperature' END, CASE WHEN conv_id % 11 = 0 THEN 'stop_sequences' END) AS errors FROM conversations""",
    **{f"{c}_scores": f"WITH {_SCORES} SELECT sample_id, model, round({c}, 6) AS {c} FROM scores" for c in ("edit_similarity", "token_overlap", "word_overlap")},
    "bleu_scores": f"WITH {_SCORES} SELECT sample_id, model, round(bleu_score, 6) AS bleu_score FROM scores",
    "pass_at_k": f"WITH {_SCORES} SELECT sample_id, model, exact_match, pass_at_1, pass_at_3, pass_at_5, any_pass FROM scores",
    "benchmark_summary": f"WITH {_SCORES} SELECT model, {_SUMMARY} FROM scores GROUP BY model",
    "summary_by_node_type": f"WITH {_SCORES} SELECT model, node_type, {_SUMMARY} FROM scores GROUP BY model, node_type",
    "pass1_by_node_type": f"""WITH {_SCORES} SELECT node_type, count(*) FILTER (model = 'tuned') AS n, round(avg(CASE WHEN model = 'tuned' THEN pass_at_1::INT END), 6) AS tuned,
        round(avg(CASE WHEN model = 'baseline' THEN pass_at_1::INT END), 6) AS baseline,
        round(avg(CASE WHEN model = 'tuned' THEN pass_at_1::INT END) - avg(CASE WHEN model = 'baseline' THEN pass_at_1::INT END), 6) AS delta FROM scores GROUP BY node_type""",
    "model_delta_long": f"WITH {_DELTA} SELECT metric, round(tuned, 6) AS tuned, round(baseline, 6) AS baseline, round(tuned - baseline, 6) AS delta FROM t",
    "delta_lines": f"WITH {_DELTA} SELECT metric, printf('%-20s %15.3f %15.3f %+15.3f', metric, tuned, baseline, tuned - baseline) AS line FROM t",
    "running_pass1": f"WITH {_RUNNING} SELECT model, sample_id, passed, done FROM run",
    "progress_rows": f"WITH {_RUNNING} SELECT model, sample_id, passed, done FROM run WHERE done % 500 = 0",
    "side_by_side": f"""WITH {_SCORES} SELECT sample_id, any_value(node_type) AS node_type, bool_or(exact_match) FILTER (model = 'tuned') AS tuned_exact,
        bool_or(exact_match) FILTER (model = 'baseline') AS baseline_exact FROM scores GROUP BY sample_id""",
    "compact_results": f"""WITH {_SCORES} SELECT row_number() OVER (ORDER BY t.sample_id) - 1 AS id, t.file_path AS path, t.exact_match AS tuned_exact, t.any_pass AS tuned_pass_5,
        b.generated_tokens::BIGINT AS baseline_tokens FROM scores t JOIN scores b ON b.sample_id = t.sample_id WHERE t.model = 'tuned' AND b.model = 'baseline'""",
    "latency_percentiles": """WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS a, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
        SELECT event_type, n, round(a, 6) AS avg, round(v[n // 2 + 1], 6) AS p50, round(v[floor(n * 0.99::DOUBLE)::BIGINT + 1], 6) AS p99 FROM g""",
    "keyword_summary": f"""WITH {_SCORES}, k AS (SELECT contains(lower(text), 'tion') OR contains(lower(text), 'que') AS ok, generation_time_ms AS t FROM scores WHERE model = 'tuned')
        SELECT count(*) FILTER (ok) AS passed, count(*) AS total, round(count(*) FILTER (ok) * 100.0::DOUBLE / count(*), 6) AS percent, round(avg(t), 6) AS avg_time_ms FROM k""",
    "generate_stub": f"""WITH {_TESTS}, h AS (SELECT sample_id, list_transform(range(0, 6), lambda k: md5('stub|' || k::VARCHAR || '|{BEGIN}' || middle || '{HOLE}{END}')) AS digests FROM tests),
        w AS (SELECT sample_id, list_transform(digests, lambda d: array_to_string(list_transform(range(0, 8), lambda i: substr(d, 4 * i + 1, 4)), ' ')) AS texts FROM h)
        SELECT sample_id, 'stub' AS model, texts[1] AS text, array_to_string(texts[2:6], '|') AS draws, 8::INT AS tokens FROM w""",
    "python_ast_nodes": """WITH l AS (SELECT doc_id::VARCHAR AS path, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
        k AS (SELECT path, i, i % 4 AS form, 7 * (i // 4) + 2 * (i % 4) + 1 AS low, 6 * (i // 4) + [0, 1, 3, 5][i % 4 + 1] AS ord FROM l)
        SELECT path, ord::BIGINT AS ord, ['FunctionDef', 'ClassDef', 'For', 'Assign'][form + 1] AS node_type, low::VARCHAR || ':' || (low + CASE WHEN form < 3 THEN 1 ELSE 0 END)::VARCHAR AS span FROM k
        UNION ALL SELECT path, ord::BIGINT + 1, 'Assign', (low + 1)::VARCHAR || ':' || (low + 1)::VARCHAR FROM k WHERE form IN (1, 2)""",
    "rust_items": f"""WITH {_FILES} SELECT path, i - 1 AS ord, node_type, CASE node_type WHEN 'Function' THEN 'l' || (i - 1)::VARCHAR WHEN 'Struct' THEN 'S' || (i - 1)::VARCHAR WHEN 'Const' THEN 'C' END AS name,
        i::VARCHAR || ':' || i::VARCHAR AS span FROM nodes""",
    "manifest_rows": f"WITH {_TESTS} SELECT sample_id AS original_index, node_type, file_path FROM tests ORDER BY md5('42|' || sample_id::VARCHAR), sample_id LIMIT 200",
}
