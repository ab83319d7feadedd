"""DuckDB SQL for the registered queries, written from ``conversations`` alone (not from the rendered logs)."""

from __future__ import annotations

BASE = """
c0 AS (
  SELECT conv_id, turn, role, text, conv_id % 5 AS kind, conv_id % 2 = 1 AS newer,
    1735689600 + conv_id * 3600 + turn * 5 AS epoch, 'project-' || (conv_id % 7) AS project,
    CASE WHEN conv_id % 5 = 3 THEN 'rollout-session-' ELSE 'session-' END || conv_id AS sid,
    length(text) % 500 AS inp, length(text) % 300 AS outp,
    CASE conv_id % 5 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'copilot_cli' WHEN 2 THEN 'gemini_cli' WHEN 3 THEN 'codex_cli' ELSE 'opencode' END AS provider
  FROM conversations
), m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq,
    CASE kind WHEN 0 THEN 'm-' || turn WHEN 1 THEN 'e-' || turn WHEN 2 THEN 'g-' || turn WHEN 3 THEN '' ELSE sid || '-' || lpad(turn::VARCHAR, 4, '0') END AS message_id,
    regexp_replace(regexp_replace(text, '^\\n+', ''), '\\s+$', '') AS body
  FROM c0 WHERE role IN ('user', 'assistant') OR kind = 3 AND NOT newer AND role = 'system'
), b AS (
  SELECT *, 0 AS pos, 'text' AS type, body AS btext, NULL AS language FROM m WHERE role <> 'system'
  UNION ALL SELECT *, 1, 'code_block', 'select ' || turn, 'sql' FROM m WHERE role = 'assistant'
  UNION ALL SELECT *, 2, 'thinking', 'weighing ' || turn, NULL FROM m WHERE kind IN (0, 2) AND newer AND role = 'assistant'
  UNION ALL SELECT *, CASE WHEN kind IN (0, 2) THEN 3 ELSE 2 END, 'tool_use', '{"n":' || turn || '}', NULL FROM m WHERE kind IN (0, 1, 2, 4) AND newer AND role = 'assistant'
  UNION ALL SELECT *, 3, 'tool_result', 'found ' || turn, NULL FROM m WHERE kind = 4 AND newer AND role = 'assistant'
  UNION ALL SELECT *, 1, 'tool_result', 'found ' || turn, NULL FROM m WHERE kind = 0 AND newer AND role = 'user'
  UNION ALL SELECT *, 0, 'error', text, NULL FROM m WHERE role = 'system'
), mb AS (
  SELECT m.*, content, types, joined, n_blocks, CASE role WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END AS role_label
  FROM m JOIN (SELECT conv_id, turn, string_agg(btext, chr(10) ORDER BY pos) AS content, string_agg(type, ',' ORDER BY pos) AS types, string_agg(btext, '|' ORDER BY pos) AS joined, count(*) AS n_blocks FROM b GROUP BY conv_id, turn)
    USING (conv_id, turn)
), s AS (
  SELECT conv_id, any_value(provider) AS provider, any_value(sid) AS session_id,
    CASE any_value(kind) WHEN 3 THEN NULL WHEN 2 THEN CASE WHEN conv_id % 7 < 6 THEN '/work/' || any_value(project) END ELSE '/work/' || any_value(project) END AS project_path,
    CASE any_value(kind) WHEN 3 THEN NULL ELSE any_value(project) END AS project_name,
    CASE any_value(kind) WHEN 0 THEN 'main' END AS git_branch,
    min(epoch)::BIGINT AS started, max(epoch)::BIGINT AS ended,
    CASE any_value(kind) WHEN 0 THEN 'talk ' || conv_id WHEN 4 THEN 'talk ' || conv_id WHEN 1 THEN NULL
      ELSE left(first(text ORDER BY turn) FILTER (WHERE role = 'user'), 80) END AS summary,
    CASE any_value(kind) WHEN 0 THEN CASE WHEN count(*) FILTER (WHERE role = 'assistant') > 0 THEN 'model-a' END
      WHEN 2 THEN CASE WHEN count(*) FILTER (WHERE role = 'assistant') > 0 THEN 'model-g' END
      WHEN 4 THEN CASE WHEN any_value(newer) THEN 'model-o' END END AS model,
    CASE WHEN any_value(kind) IN (0, 2) AND coalesce(sum(inp) FILTER (WHERE role = 'assistant'), 0) + coalesce(sum(outp) FILTER (WHERE role = 'assistant'), 0) > 0
      THEN coalesce(sum(inp) FILTER (WHERE role = 'assistant'), 0)::BIGINT END AS input_tokens,
    CASE WHEN any_value(kind) IN (0, 2) AND coalesce(sum(inp) FILTER (WHERE role = 'assistant'), 0) + coalesce(sum(outp) FILTER (WHERE role = 'assistant'), 0) > 0
      THEN coalesce(sum(outp) FILTER (WHERE role = 'assistant'), 0)::BIGINT END AS output_tokens,
    CASE any_value(kind) WHEN 4 THEN count(*) ELSE count(*) FILTER (WHERE role IN ('user', 'assistant')) END::BIGINT AS message_count
  FROM c0 GROUP BY conv_id
  HAVING any_value(kind) IN (1, 4) OR count(*) FILTER (WHERE role IN ('user', 'assistant')) > 0
), l AS (
  SELECT *, CASE provider WHEN 'claude_code' THEN 'Claude Code' WHEN 'gemini_cli' THEN 'Gemini CLI' WHEN 'copilot_cli' THEN 'Copilot CLI' WHEN 'codex_cli' THEN 'Codex CLI' ELSE 'OpenCode' END AS label,
    CASE provider WHEN 'claude_code' THEN 0 WHEN 'gemini_cli' THEN 1 WHEN 'copilot_cli' THEN 2 WHEN 'codex_cli' THEN 3 ELSE 4 END AS rank
  FROM s
)"""

#: Search documents: a row for each message; and term counts of their two fields.
FTS = r"""
, d AS (
  SELECT m.provider, m.sid AS session_id, m.seq, l.label AS provider_label, coalesce(l.project_name, '') AS project, m.role_label, m.content, m.epoch::BIGINT AS ts, m.message_id
  FROM mb AS m JOIN l ON l.provider = m.provider AND l.session_id = m.sid
), f AS (
  SELECT provider, session_id, seq, 'content' AS field, [x FOR x IN regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+') IF x <> '' AND strlen(x) < 40] AS t FROM d WHERE content <> ''
  UNION ALL SELECT provider, session_id, seq, 'project', [x FOR x IN regexp_split_to_array(lower(project), '[^\p{L}\p{N}]+') IF x <> '' AND strlen(x) < 40] FROM d WHERE content <> ''
), p AS (
  SELECT field, term, provider, session_id, seq, count(*)::BIGINT AS tf, any_value(dl) AS dl
  FROM (SELECT provider, session_id, seq, field, len(t) AS dl, unnest(t) AS term FROM f) GROUP BY ALL HAVING true
), df AS (SELECT field, term, count(*)::BIGINT AS df FROM p GROUP BY field, term),
fs AS (SELECT field, count(*)::BIGINT AS n_docs, avg(len(t)) AS avgdl FROM f GROUP BY field),
q AS (SELECT * FROM (VALUES ('a', 'select that'), ('b', 'project thon'), ('c', '   '), ('d', 'nosuchword')) AS v(query, text)),
qt AS (SELECT query, unnest(list_distinct([x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''])) AS term FROM q),
h AS (
  SELECT query, provider, session_id, seq, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM p JOIN qt USING (term) JOIN df USING (field, term) JOIN fs USING (field) GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, provider, session_id, seq) AS rank FROM h
)"""


def sql(select: str, fts: bool = False) -> str:
    return f"WITH {BASE.strip()}{FTS if fts else ''}\n{select.strip()}"


SESSION = "provider, session_id, project_path, project_name, git_branch, started, ended, summary, model, input_tokens::VARCHAR AS input_tokens, output_tokens::VARCHAR AS output_tokens, message_count"
MESSAGE = "provider, sid AS session_id, seq::BIGINT AS seq, message_id, role, epoch::BIGINT AS ts, types, md5(joined) AS body"
