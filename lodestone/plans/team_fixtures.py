"""Tables of the team queries, as SQL over the given tables that Spark and DuckDB read alike."""

from __future__ import annotations

_ID = "lpad(CAST(doc_id AS STRING), 8, '0')"

#: Replies of an extractor: arrays, fences, preambles, objects, and what is malformed.
REPLIES = """
SELECT doc_id AS reply, CASE doc_id % 9
  WHEN 0 THEN '[{"kind":"memory","title":"T' || CAST(doc_id AS STRING) || '","body":"Body one","tags":["a","b"]},{"kind":"odd","title":"U","body":"Body two"}]'
  WHEN 1 THEN '```json' || chr(10) || '[{"kind":"decision","title":"F' || CAST(doc_id AS STRING) || '","body":"In a fence"}]' || chr(10) || '```'
  WHEN 2 THEN 'Here it is: [{"kind":"person","title":"P","body":"After a preamble"}] as asked'
  WHEN 3 THEN '{"candidates":[{"kind":"memory","title":"C' || CAST(doc_id AS STRING) || '","body":"In an object","tags":[]}]}'
  WHEN 4 THEN '[{"kind":"memory","title":"  ","body":"No title"},{"kind":"memory","title":"x","body":"y"}]'
  WHEN 5 THEN 'nothing here'
  WHEN 6 THEN '[]'
  WHEN 7 THEN '[{"kind":"memory","title":"T","body":"B","tags":["a",1]}]'
  ELSE '' END AS text FROM documents
"""

#: Replies of a classifier: verdicts by index, some twice, some unknown.
VERDICT_REPLIES = """
SELECT doc_id AS reply, CASE doc_id % 6
  WHEN 0 THEN '[{"index":0,"judge":"trivia","consolidation":"distinct"},{"index":1,"judge":"durable","consolidation":"duplicate","targetId":"n' || CAST(doc_id AS STRING) || '","reason":"same"}]'
  WHEN 1 THEN '{"verdicts":[{"index":0,"judge":"maybe","consolidation":"supersedes","targetId":"x"},{"index":0,"judge":"durable","consolidation":"contradicts","targetId":"y"}]}'
  WHEN 2 THEN 'Sure. [{"index":2,"judge":"durable"},{"index":"3"},{"index":1.5},{"note":"none"}]'
  WHEN 3 THEN 'no'
  WHEN 4 THEN '```' || chr(10) || '[{"index":1,"judge":"trivia","targetId":7}]' || chr(10) || '```'
  ELSE '[]' END AS text FROM documents
"""

#: What a capture command prints.
OUTPUTS = """
SELECT doc_id AS reply, CASE doc_id % 4
  WHEN 0 THEN 'promoted n' || CAST(doc_id AS STRING) || ' [memory]  First of ' || CAST(doc_id AS STRING) || chr(10) || '  promoted m [decision] Second' || chr(10) || '##verdicts {"superseded":1,"trivia":2}'
  WHEN 1 THEN 'staged x [person] Somebody' || chr(10) || 'noise' || chr(10) || '##verdicts {"trivia":1}' || chr(10) || '##verdicts {"duplicate":3,"clamped":1}'
  WHEN 2 THEN '##verdicts {broken' || chr(10) || 'nothing'
  ELSE '' END AS text FROM documents
"""

#: Contributors as git gives them, and the people a brain knows.
IDENTITIES = """
SELECT c_custkey AS ident, CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE 'Dev  ' || CAST(c_custkey % 40 AS STRING) || ' ' END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN 'DEV' || CAST(c_custkey % 70 AS STRING) || '@Example.org' WHEN c_custkey % 3 = 1 THEN 'no address' END AS email FROM customer
"""
PEOPLE = """
SELECT 'p' || CAST(s_suppkey AS STRING) AS id, 'dev ' || CAST(s_suppkey % 45 AS STRING) AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'dev' || CAST(s_suppkey % 70 AS STRING) || '@example.org' END AS email,
  CASE WHEN s_suppkey % 5 = 0 THEN 'name:dev ' || CAST(s_suppkey % 40 AS STRING) WHEN s_suppkey % 5 = 1 THEN 'email-sha256:0' END AS attribution_key FROM supplier
"""

#: Settings files of brains.
CONFIGS = """
SELECT 'b' || CAST(n_nationkey AS STRING) AS brain, CASE n_nationkey % 5
  WHEN 0 THEN '{"name":"N' || CAST(n_nationkey AS STRING) || '","embeddings":{"provider":"hosted","threshold":0.9},"features":{"autoPromote":false,"extra":true}}'
  WHEN 1 THEN '{"contradictionGuard":{"mode":"ask","threshold":2},"features":{"semanticDedup":"yes"}}'
  WHEN 2 THEN 'not json'
  WHEN 3 THEN '{"embeddings":{"provider":"other","threshold":"high"},"contradictionGuard":{"mode":7,"threshold":0.5}}'
  ELSE '{}' END AS text FROM nation
"""

#: Folders with what decides about them.
FOLDERS = """
SELECT doc_id, '/work/t' || CAST(doc_id % 3 AS STRING) || '/p' || CAST(doc_id % 9 AS STRING) || '/src' AS path, CASE WHEN doc_id % 4 <> 0 THEN '/work/t' || CAST(doc_id % 3 AS STRING) || '/p' || CAST(doc_id % 9 AS STRING) END AS root,
  CASE WHEN doc_id % 4 = 1 THEN 'git@host.org:org' || CAST(doc_id % 5 AS STRING) || '/repo' || CAST(doc_id % 7 AS STRING) || '.git' END AS remote,
  CASE WHEN doc_id % 17 = 0 THEN '/brains/marked' WHEN doc_id % 17 = 1 THEN '' END AS marker, CASE WHEN doc_id % 13 = 0 THEN '/brains/self' END AS self_brain,
  CASE doc_id % 5 WHEN 0 THEN 'unmatched' WHEN 1 THEN 'denied' WHEN 2 THEN 'none' ELSE 'brain' END AS rule_kind, CASE WHEN doc_id % 5 >= 3 THEN '/brains/r' || CAST(doc_id % 5 AS STRING) END AS rule_brain,
  CASE WHEN doc_id % 6 = 0 THEN '/brains/env' END AS env, CASE doc_id % 7 WHEN 0 THEN 'corrupt' WHEN 1 THEN 'missing' ELSE 'ok' END AS config_state FROM documents
"""
MANIFESTS = """
SELECT '/work/t' || CAST(n_nationkey % 3 AS STRING) || CASE WHEN n_nationkey % 2 = 0 THEN '/p' || CAST(n_nationkey % 9 AS STRING) ELSE '' END AS dir,
  CASE WHEN n_nationkey % 8 = 7 THEN 'bad/name' ELSE 'eng' || CAST(n_nationkey AS STRING) END AS project, CASE WHEN n_nationkey % 3 = 0 THEN 'Big Corp' ELSE '' END AS customer FROM nation WHERE n_nationkey < 18
"""

#: Runs of the extractor with their notes.
RUNS = """
SELECT o_orderkey AS run, o_orderkey % 5 <> 0 AS ok, CAST(o_orderkey % 4 AS INT) AS captured, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 7 AS INT) END AS extracted,
  CASE WHEN o_orderkey % 5 = 0 THEN ' timed ' || chr(10) || ' out at ' || CAST(o_orderkey AS STRING) END AS error, CAST(o_orderkey * 37 % 400000 AS BIGINT) AS seconds FROM orders
"""

#: Calls of tools that a guard may look at.
CALLS = """
SELECT event_id AS call, 's' || CAST(user_id AS STRING) AS session, CASE WHEN event_id % 9 = 0 THEN '' ELSE '/work' END AS cwd,
  CASE event_id % 6 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Write' WHEN 2 THEN 'Edit' WHEN 3 THEN 'MultiEdit' WHEN 4 THEN 'Read' ELSE 'Bash' END AS tool,
  CASE event_id % 6 WHEN 0 THEN '{"description":"build","command":"make   all target' || CAST(event_id AS STRING) || '"}' WHEN 1 THEN '{"file_path":"a.md","content":"short"}' WHEN 2 THEN '{"file_path":"b.md","new_string":"a long enough change"}'
    WHEN 3 THEN '{"file_path":"c.md","edits":[{"new_string":"one edit"},{"new_string":"and another"}]}' WHEN 4 THEN '{"file_path":"d.md"}' ELSE '{"command":"ls"}' END AS tool_input,
  CASE WHEN event_id % 4 = 0 THEN 'none' ELSE 'brain' END AS kind FROM events
"""

#: Agent-config files of a repository.
REPO_FILES = """
SELECT CASE doc_id % 8 WHEN 0 THEN 'CLAUDE.md' WHEN 1 THEN '.claude/rules/r' || CAST(doc_id AS STRING) || '.md' WHEN 2 THEN 'docs/AGENTS.md' WHEN 3 THEN '.claude/rules/deep/x.md' WHEN 4 THEN 'AGENTS.md' WHEN 5 THEN '.cursorrules' ELSE 'README.md' END AS path,
  CASE WHEN doc_id % 3 = 0 THEN 'intro' || chr(10) || '# Rules of ' || CAST(doc_id AS STRING) || chr(10) || 'be kind' ELSE 'only text ' || CAST(doc_id AS STRING) END AS text FROM documents
"""
