"""DuckDB SQL of the team queries."""

from __future__ import annotations

from lodestone.plans import oracles as O
from lodestone.plans import team_fixtures as T
from lodestone.plans.settings import ASK_CHARS, HINTS, QUERY, QUERY_TERMS
from lodestone.sources.knowledge import LOG_NOW, RULES
from lodestone.sources.settings_files import FEATURES

_terms = ", ".join(f"'{t}'" for t in QUERY_TERMS)
_trim = O._nb
_one = O._one
_text = lambda c: f"CAST({c} AS VARCHAR)"
_lit = lambda s: "'" + s.replace("'", "''") + "'"

#: Of a table with id and body: the words around the first hit.
SNIPPET = f"""
sn_words AS (SELECT id, list_filter(string_split({_one.format('body')}, ' '), lambda w: w <> '') AS ws FROM notes),
sn_hits AS (SELECT id, ws, list_transform(ws, lambda w: len(list_intersect(regexp_split_to_array(lower(w), '[^a-z0-9]+'), [{_terms}])) > 0) AS hit FROM sn_words WHERE id IN (SELECT id FROM ranked)),
sn_first AS (SELECT id, ws, hit, greatest(1, coalesce(list_position(hit, true), 0) - 5) AS b FROM sn_hits),
snippets AS (SELECT id, CASE WHEN b > 1 THEN '…' ELSE '' END || array_to_string(list_transform(range(b, least(b + 12, len(ws) + 1)), lambda i: CASE WHEN hit[i] THEN '[' || ws[i] || ']' ELSE ws[i] END), ' ') || CASE WHEN b + 11 < len(ws) THEN '…' ELSE '' END AS excerpt FROM sn_first)"""
_ranked = lambda n: f"ranked AS (SELECT id, kind, title, path, status, score, row_number() OVER (ORDER BY {O.FRESH}) AS rank FROM lexical QUALIFY rank <= {n})"

CONTEXT = f"""
{O.NOTES}, {O.LEXICAL}, {O.VECTORS}, {O.SEMANTIC}, {O.HYBRID.replace('LIMIT 60', 'LIMIT 50')},
kept AS (SELECT * FROM fused WHERE lexical_rank IS NOT NULL OR {' OR '.join(f"contains(lower(title || ' ' || array_to_string(tags, ' ')), '{w}')" for w in QUERY.lower().split())}),
ctx AS (SELECT id, kind, title, lexical_rank, semantic_rank, score, CASE WHEN lexical_rank IS NOT NULL AND semantic_rank IS NOT NULL THEN 'hybrid' WHEN lexical_rank IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS tier,
  row_number() OVER (ORDER BY {O.FRESH}) AS rank FROM kept QUALIFY rank <= 10)"""
_first_line = f"coalesce(substr(list_filter(list_transform(string_split(body, chr(10)), lambda x: {_trim.format('x')}), lambda x: x <> '')[1], 1, 120), '')"

IDENTITIES = f"""
raw AS ({T.IDENTITIES}),
named AS (SELECT ident, {_one.format('name')} AS name, CASE WHEN regexp_matches(lower(trim(email)), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN lower(trim(email)) END AS email FROM raw),
identities AS (SELECT *, CASE WHEN email IS NOT NULL THEN 'email-sha256:' || sha256(email) ELSE 'name:' || lower(name) END AS key FROM named WHERE name <> '')"""
PEOPLE = f"""
people AS ({T.PEOPLE}),
byname AS (SELECT lower(trim(name)) AS low, count(*) AS same, count(*) FILTER (email IS NULL AND NOT coalesce(starts_with(attribution_key, 'email-sha256:'), false)) AS bare, min(id) AS of_name FROM people GROUP BY 1),
matched AS (
  SELECT i.*, coalesce(least((SELECT min(id) FROM people p WHERE p.attribution_key = i.key), (SELECT min(id) FROM people p WHERE lower(p.email) = i.email)),
    CASE WHEN n.same = 1 AND (n.bare = 1 OR i.email IS NULL) THEN n.of_name END) AS person FROM identities i LEFT JOIN byname n ON n.low = lower(i.name)
)"""
_slug = O._slug
_person = f"'contributor-' || CASE WHEN {_slug('name')} <> '' THEN {_slug('name')} ELSE 'contributor' END || '-' || substr(sha256(key), 1, 10)"
ENSURED = f"""
{IDENTITIES}, {PEOPLE}, ensured AS (
  SELECT m.ident, m.name, m.key, coalesce(m.person, {_person.replace('name', 'm.name').replace('key', 'm.key')}) AS person,
    CASE WHEN m.person IS NULL THEN 'inserted' WHEN m.email IS NOT NULL AND p.email IS NULL AND NOT coalesce(starts_with(p.attribution_key, 'email-sha256:'), false) THEN 'upgraded' ELSE 'existing' END AS action
  FROM matched m LEFT JOIN people p ON p.id = m.person
)"""

_fence = "(?is)^```(?:json)?\\s*(.*?)\\s*```$"
_inner = lambda c: f"CASE WHEN regexp_matches(trim({c}), '{_fence}') THEN regexp_extract(trim({c}), '{_fence}', 1) ELSE trim({c}) END"


def _json(fixture: str, key: str) -> str:
    """(reply, items, strict_items): lists of JSON, or null."""
    return f"""
f AS ({fixture}), inner_ AS (SELECT reply, text, {_inner('text')} AS t FROM f),
parsed AS (SELECT reply, CASE WHEN json_valid(t) THEN t WHEN json_valid(regexp_extract(t, '(?s)(\\[.*\\])', 1)) THEN regexp_extract(t, '(?s)(\\[.*\\])', 1) WHEN json_valid(regexp_extract(t, '(?s)(\\{{.*\\}})', 1)) THEN regexp_extract(t, '(?s)(\\{{.*\\}})', 1) END AS j,
  CASE WHEN json_valid(trim(text)) THEN trim(text) END AS s FROM inner_),
items AS (SELECT reply, CASE WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["JSON"]') WHEN json_type(j, '$.{key}') = 'ARRAY' THEN from_json(json_extract(j, '$.{key}'), '["JSON"]') END AS items,
  CASE WHEN json_type(s, '$.{key}') = 'ARRAY' THEN from_json(json_extract(s, '$.{key}'), '["JSON"]') END AS strict_items FROM parsed)"""


_said = lambda k: f"coalesce(json_type(c, '$.{k}') = 'VARCHAR' AND trim(c->>'$.{k}') <> '', false)"
_kinds = "('memory', 'decision', 'work-state', 'person')"
_tags = "json_type(c, '$.tags') = 'ARRAY' AND len(list_filter(from_json(json_extract(c, '$.tags'), '[\"JSON\"]'), lambda t: json_type(t) <> 'VARCHAR')) = 0"
_fine = f"coalesce(json_type(c, '$.kind') = 'VARCHAR', false) AND {_said('title')} AND {_said('body')} AND (json_type(c, '$.tags') IS NULL OR ({_tags}))"
_fine_strict = f"coalesce((c->>'$.kind') IN {_kinds}, false) AND {_said('title')} AND {_said('body')} AND coalesce({_tags}, false)"
EXTRACTED = f"""
{_json(T.REPLIES, 'candidates')}, exploded AS (SELECT reply, unnest(items) AS c, generate_subscripts(items, 1) - 1 AS index FROM items),
bad AS (SELECT reply, count(*) AS n FROM exploded WHERE NOT ({_fine}) GROUP BY reply), sexploded AS (SELECT reply, unnest(strict_items) AS c FROM items),
sbad AS (SELECT reply, count(*) AS n FROM sexploded WHERE NOT ({_fine_strict}) GROUP BY reply),
read AS (SELECT reply, items, items IS NOT NULL AND b.n IS NULL AS ok, strict_items IS NOT NULL AND s.n IS NULL AS ok_strict FROM items LEFT JOIN bad b USING (reply) LEFT JOIN sbad s USING (reply))"""
VERDICTS = f"""
{_json(T.VERDICT_REPLIES, 'verdicts')}, vs AS (SELECT reply, unnest(items) AS v, generate_subscripts(items, 1) AS place FROM items),
numbered AS (SELECT *, TRY_CAST(v->>'$.index' AS DOUBLE) AS i FROM vs WHERE json_type(v, '$.index') IN ('BIGINT', 'UBIGINT', 'DOUBLE')),
verdicts AS (
  SELECT reply, i::INTEGER AS index, CASE WHEN json_type(v, '$.judge') = 'VARCHAR' AND (v->>'$.judge') = 'trivia' THEN 'trivia' ELSE 'durable' END AS judge,
    CASE WHEN (v->>'$.consolidation') IN ('duplicate', 'supersedes', 'contradicts') THEN v->>'$.consolidation' ELSE 'distinct' END AS consolidation,
    CASE WHEN json_type(v, '$.targetId') = 'VARCHAR' THEN v->>'$.targetId' ELSE '' END AS target_id, CASE WHEN json_type(v, '$.reason') = 'VARCHAR' THEN v->>'$.reason' ELSE '' END AS why
  FROM numbered WHERE i = floor(i) QUALIFY row_number() OVER (PARTITION BY reply, i ORDER BY place DESC) = 1
)"""

_summary = lambda k: f"coalesce(TRY_CAST(j->>'$.{k}' AS INTEGER), 0)"
SUMMARY = f"""
f AS ({T.OUTPUTS}), l AS (SELECT reply, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM f),
s AS (SELECT reply, n, CASE WHEN json_valid(substr(trim(line), 12)) THEN substr(trim(line), 12) END AS j FROM l WHERE starts_with(trim(line), '##verdicts ')),
sums AS (SELECT reply, {', '.join(f'{_summary(k)} AS {k}' for k in ('superseded', 'contradicted', 'trivia', 'duplicate', 'clamped'))} FROM s WHERE json_type(j) = 'OBJECT' QUALIFY row_number() OVER (PARTITION BY reply ORDER BY n DESC) = 1)"""
_part = lambda n, what: f"CASE WHEN {n} > 0 THEN {n}::VARCHAR || ' {what}' END"

_age = "CASE WHEN seconds IS NULL THEN 'unknown time' WHEN seconds // 60 < 1 THEN 'just now' WHEN seconds // 60 < 60 THEN (seconds // 60)::VARCHAR || 'm ago' WHEN seconds // 3600 < 48 THEN (seconds // 3600)::VARCHAR || 'h ago' ELSE (seconds // 86400)::VARCHAR || 'd ago' END"
_slug_remote = O._remote
FOLDERS = f"folders AS ({T.FOLDERS})"
_repo = f"CASE WHEN remote IS NOT NULL AND len(list_filter(string_split({_slug_remote}, '/'), lambda x: x <> '')) > 0 THEN array_to_string(list_filter(string_split({_slug_remote}, '/'), lambda x: x <> '')[-2:], '/') END"
_base = lambda c: f"string_split(regexp_replace({c}, '/+$', ''), '/')[-1]"
RESOLVED = f"""
{FOLDERS}, staged_ AS (SELECT *, CASE WHEN coalesce(marker, '') <> '' THEN 'marker' WHEN coalesce(self_brain, '') <> '' THEN 'self' WHEN rule_kind <> 'unmatched' AND config_state = 'ok' THEN 'rules' WHEN coalesce(env, '') <> '' THEN 'env' WHEN config_state = 'corrupt' THEN 'corrupt' ELSE 'none' END AS stage FROM folders),
resolved AS (SELECT doc_id, CASE WHEN stage IN ('marker', 'self', 'env') THEN 'brain' WHEN stage = 'rules' THEN rule_kind WHEN stage = 'corrupt' THEN 'corrupt-config' ELSE 'none' END AS kind,
  CASE stage WHEN 'marker' THEN marker WHEN 'self' THEN self_brain WHEN 'rules' THEN rule_brain WHEN 'env' THEN env END AS brain, stage FROM staged_)"""

_sql = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else _lit(v)
RULE_ROWS = "rules(ord, repo, org, prefix, brain, deny, origin) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in RULES) + ")"
_matcher = "coalesce('repo:' || lower(repo), 'org:' || lower(org), 'prefix:' || prefix)"

_entry = f"""CASE WHEN kind = 'decision' THEN '- **' || title || '** (' || created || ')' || tail WHEN kind = 'work-state' THEN '- **' || title || '** [' || status || ']' || tail ELSE '- **' || title || '**' || tail END"""
_header = "'# Team brain' || chr(10) || chr(10) || 'Shared knowledge for **' || source || '**, generated from the team''s notes.' || chr(10) || 'Read this before acting. Do not edit: it is made anew from the notes.' || chr(10)"
EMIT = f"""
{O.NOTES}, live AS (SELECT source, id, kind, title, created, status, CASE kind WHEN 'decision' THEN 0 WHEN 'work-state' THEN 1 ELSE 2 END AS section, CASE WHEN {O._gist} <> '' THEN ' — ' || {O._gist} ELSE '' END AS tail
  FROM notes WHERE NOT superseded AND kind IN ('decision', 'work-state', 'memory') AND NOT (kind = 'work-state' AND status = 'done')),
entries AS (SELECT source, section, {_entry} AS entry, row_number() OVER w AS place, sum(length({_entry}) + 1) OVER w AS so_far FROM live WINDOW w AS (PARTITION BY source, section ORDER BY CASE WHEN section = 0 THEN created END DESC, id)),
u0 AS (SELECT DISTINCT source, length({_header}) AS used FROM entries),
k0 AS (SELECT e.* FROM entries e JOIN u0 USING (source) WHERE section = 0 AND (place = 1 OR used + so_far <= 8000)),
u1 AS (SELECT source, used + coalesce((SELECT max(so_far) + 13 FROM k0 WHERE k0.source = u0.source), 0) AS used FROM u0),
k1 AS (SELECT e.* FROM entries e JOIN u1 USING (source) WHERE section = 1 AND (place = 1 OR used + so_far <= 8000)),
u2 AS (SELECT source, used + coalesce((SELECT max(so_far) + 15 FROM k1 WHERE k1.source = u1.source), 0) AS used FROM u1),
k2 AS (SELECT e.* FROM entries e JOIN u2 USING (source) WHERE section = 2 AND (place = 1 OR used + so_far <= 8000)),
kept AS (SELECT * FROM k0 UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM k2),
sections AS (SELECT source, section, count(*) AS n, chr(10) || '## ' || ['Decisions', 'Active work', 'Key facts'][section + 1] || chr(10) || chr(10) || string_agg(entry, chr(10) ORDER BY place) AS text FROM kept GROUP BY source, section)
SELECT source, sum(n)::INTEGER AS entries, {_header} || string_agg(text, chr(10) ORDER BY section) || chr(10) AS context FROM sections GROUP BY source"""

_features = ", ".join(f"coalesce(CASE WHEN json_type(j, '$.features.{k}') = 'BOOLEAN' THEN (j->>'$.features.{k}')::BOOLEAN END, {str(v).lower() if k != 'llmCurator' else 'false'}) AS \"is_{k}\"" for k, v in {**FEATURES, "extra": False, "unknown": False}.items())
_share = lambda p, d: f"coalesce(CASE WHEN json_type(j, '{p}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND (j->>'{p}')::DOUBLE BETWEEN 0 AND 1 THEN (j->>'{p}')::DOUBLE END, {d})"
_folder = "regexp_replace(path, '/[^/]*$', '')"


def _greedy(rows: str) -> str:
    """(id, ord, toks) in order of ord -> greedy(accepted): the ids that are like no accepted earlier one. The recursion goes row by row."""
    return f"""
gtok AS (SELECT id, ord, len(toks) AS n, unnest(toks) AS t FROM {rows}),
gnear AS (SELECT y.id, list(x.id) AS earlier FROM (SELECT x.id AS xid, y.id AS yid, x.n AS na, y.n AS nb, count(*) AS k FROM gtok x JOIN gtok y ON x.t = y.t AND x.ord < y.ord GROUP BY ALL) c JOIN {rows} x ON x.id = c.xid JOIN {rows} y ON y.id = c.yid WHERE k::DOUBLE / (na + nb - k) >= 0.8 GROUP BY y.id),
gplaced AS (SELECT r.id, row_number() OVER (ORDER BY r.ord) AS place, n.earlier FROM {rows} r LEFT JOIN gnear n USING (id)),
gsteps AS (SELECT 0::BIGINT AS n, list(id) FILTER (false) AS accepted FROM gplaced UNION ALL SELECT n + 1, CASE WHEN coalesce(list_has_any(accepted, earlier), false) THEN accepted ELSE list_append(coalesce(accepted, []), id) END FROM gsteps JOIN gplaced ON place = n + 1),
greedy AS (SELECT accepted FROM gsteps ORDER BY n DESC LIMIT 1)"""


_content = "concat_ws(' ', title, body)"
CAPTURED = f"""
{O.NOTES}, {O.VERDICTS},
gated AS (SELECT p.*, n.doc_id, {O.TOKENS.format('concat_ws(chr(32), n.title, n.body)')} AS toks,
    CASE WHEN {O._secret_any('concat_ws(chr(10), n.title, n.body, p.tags, n.author, n.source)', False)} THEN 'contains-secret' WHEN {_trim.format('n.title')} = '' OR length({_trim.format('n.body')}) < 15 THEN 'thin-content' END AS why
  FROM plan p JOIN notes n USING (id) WHERE p.action = 'stage'),
etok AS (SELECT id, len(toks) AS n, unnest(toks) AS t FROM (SELECT id, {O.TOKENS.format(_content)} AS toks FROM notes WHERE doc_id % 4 <> 3)),
ctok AS (SELECT id, len(toks) AS n, unnest(toks) AS t FROM gated WHERE why IS NULL),
liked AS (SELECT cid AS id, arg_min(eid, (-(k::DOUBLE / (na + nb - k)), eid)) AS duplicate_of FROM (SELECT c.id AS cid, e.id AS eid, c.n AS na, e.n AS nb, count(*) AS k FROM ctok c JOIN etok e ON c.t = e.t GROUP BY ALL) WHERE k::DOUBLE / (na + nb - k) >= 0.8 GROUP BY cid),
fresh AS (SELECT id, ord, toks FROM gated WHERE why IS NULL AND id NOT IN (SELECT id FROM liked)), {_greedy('fresh')},
ends AS (SELECT g.*, l.duplicate_of AS like_of, coalesce(why, CASE WHEN NOT coalesce(list_contains((SELECT accepted FROM greedy), g.id), false) THEN 'duplicate' END) AS reason_ FROM gated g LEFT JOIN liked l USING (id))"""


def _outcome(promote: bool) -> str:
    return f"""
outcome AS (
  SELECT id, CASE WHEN reason_ IS NOT NULL THEN 'rejected' ELSE '{'promoted' if promote else 'staged'}' END AS outcome, reason_ AS reason, like_of AS duplicate_of,
    CASE WHEN reason_ IS NULL AND {str(promote).lower()} AND supersedes IN (SELECT id FROM notes WHERE doc_id % 4 <> 3 AND doc_id % 5 <> 0 AND kind IN ('memory', 'decision')) THEN supersedes END AS supersedes,
    CASE WHEN reason_ IS NULL THEN contradicts END AS contradicts, clamped, tags FROM ends
  UNION ALL SELECT id, 'rejected', reason, duplicate_of, NULL, NULL, clamped, tags FROM plan WHERE action = 'reject'
)"""


_labels = f"s AS (SELECT source, min(project) AS p FROM (SELECT project, unnest(sources) AS source FROM alias_map) GROUP BY source), lab AS (SELECT n.* REPLACE (coalesce(nullif(trim(project), ''), p, nullif(n.source, ''), '(unattributed)') AS source) FROM notes n LEFT JOIN s ON s.source = n.source)"
_of_brain = O._flags(" AND r.brain = n.brain").replace("SELECT id, source, regexp_replace", "SELECT id, brain, regexp_replace")
_of_label = O._flags(" AND r.source = n.source").replace("FROM notes", "FROM lab")

ORACLES: dict[str, str] = {
    "curate_greedy_batch": f"WITH RECURSIVE sets AS (SELECT doc_id AS id, doc_id AS ord, {O.TOKENS.format('text')} AS toks FROM documents), {_greedy('sets')} SELECT id, coalesce(list_contains((SELECT accepted FROM greedy), id), false) AS accepted FROM sets",
    "capture_flow": f"WITH RECURSIVE {CAPTURED}, {_outcome(True)} SELECT * FROM outcome",
    "capture_applied": f"WITH RECURSIVE {CAPTURED}, {_outcome(False)} SELECT 'canon' AS layer, id, status FROM notes WHERE doc_id % 4 <> 3 AND doc_id % 5 <> 0 UNION ALL SELECT 'staged', id, status FROM notes WHERE (doc_id % 4 <> 3 AND doc_id % 5 = 0) OR id IN (SELECT id FROM outcome WHERE outcome = 'staged')",
    "brain_statuses": f"WITH {O.NOTES}, {_of_brain}, sc AS (SELECT brain, {O.SCORE} FROM flags GROUP BY brain), p AS (SELECT brain, score, total, (SELECT count(*) FROM notes n WHERE n.brain = sc.brain AND n.doc_id % 5 = 0 AND n.brain <> 'brain1') AS pending FROM sc) SELECT brain, score, total, pending, '🧠 ' || brain || ' · ' || score::VARCHAR || '/100' || CASE WHEN pending > 0 THEN ' · ' || pending::VARCHAR || ' pending' ELSE '' END || CASE WHEN brain = 'brain2' THEN ' · ⇅' ELSE '' END AS line FROM p",
    "health_by_resolved_project": f"WITH {O.NOTES}, {O.ALIAS}, {_labels}, {_of_label}, sc AS (SELECT source AS label, {O.SCORE} FROM flags GROUP BY source) SELECT *, row_number() OVER (ORDER BY label = '(unattributed)', label)::INTEGER AS place FROM sc",
    "emit_context": f"WITH {EMIT}",
    "ask_budget": f"WITH {O.NOTES}, {O.LEXICAL}, {_ranked(20)}, {SNIPPET}, used AS (SELECT rank, id, title, excerpt, sum(length(title) + length(path) + length(excerpt)) OVER (ORDER BY rank) AS used FROM ranked JOIN snippets USING (id)) SELECT rank::INTEGER AS rank, id, title, excerpt, used::BIGINT AS used FROM used WHERE rank = 1 OR used <= {ASK_CHARS}",
    "snippet": f"WITH {O.NOTES}, {O.LEXICAL}, {_ranked(20)}, {SNIPPET} SELECT rank::INTEGER AS rank, id, excerpt FROM ranked JOIN snippets USING (id)",
    "context_query": f"WITH {CONTEXT} SELECT rank::INTEGER AS rank, id, kind, title, tier FROM ctx",
    "context_render": f"WITH {CONTEXT}, l AS (SELECT c.rank, '- **' || c.title || '** (' || c.kind || ')' || CASE WHEN {_first_line} <> '' THEN ' — ' || {_first_line} ELSE '' END AS line FROM ctx c JOIN notes n USING (id)) SELECT count(*) AS n, CASE WHEN count(*) > 0 THEN '## Team brain — ' || count(*)::VARCHAR || ' relevant note(s)' || chr(10) || '_Cite any note you use inline, e.g. \"📖 from the team brain: TITLE\"._' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rank) ELSE '' END AS text FROM l",
    "recall_diagnostics": f"WITH {CONTEXT} SELECT id, '  [' || tier || '] lex:' || coalesce(lexical_rank::VARCHAR, '—') || ' sem:' || coalesce(semantic_rank::VARCHAR, '—') || ' score:' || printf('%.4f', score) || '  ' || title || ' (' || id || ')' AS line FROM ctx",
    "retrieval_without_vectors": f"WITH {O.NOTES}, {O.LEXICAL}, {_ranked(20)} SELECT id, rank::INTEGER AS lexical_rank, 'lexical' AS tier, round(score, 6) AS score FROM ranked",
    "answer_render": f"WITH {O.NOTES}, {O.LEXICAL}, {_ranked(8)}, {SNIPPET}, l AS (SELECT rank, '  • ' || title || '  [' || kind || ']' || chr(10) || '    ' || path || CASE WHEN excerpt <> '' THEN chr(10) || '    ' || excerpt ELSE '' END || chr(10) AS t FROM ranked JOIN snippets USING (id)) SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN 'ask — {QUERY}' || chr(10) || chr(10) || '  No notes in the brain matched this question.' || chr(10) ELSE 'ask — {QUERY}' || chr(10) || chr(10) || '  ' || count(*)::VARCHAR || ' relevant note(s) — cite these when you answer:' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY rank) END AS text FROM l",
    "who_is_named": f"WITH {O.NOTES} SELECT id, 'Name of ' || author AS name FROM notes WHERE kind = 'person' AND (contains(lower('Name of ' || author), 'of user3') OR contains(lower(title), 'of user3') OR contains(lower(id), 'of user3') OR len(list_filter(tags, lambda t: contains(lower(t), 'of user3'))) > 0)",
    "contributor_match": f"WITH {IDENTITIES}, {PEOPLE} SELECT ident, name, email, key, person FROM matched",
    "contributor_ensure": f"WITH {ENSURED} SELECT ident, person, action FROM ensured",
    "contributor_new_people": f"WITH {ENSURED} SELECT person AS id, 'person' AS kind, min_by(name, ident) AS title, min_by(name, ident) AS name, min(key) AS attribution_key, 'contributor' AS tags FROM ensured WHERE action = 'inserted' GROUP BY person",
    "attribute_candidates": f"WITH {O.NOTES}, {IDENTITIES}, {PEOPLE}, who AS (SELECT ident, name, coalesce(person, {_person}) AS person FROM matched) SELECT id, CASE WHEN w.person IS NOT NULL THEN w.name ELSE author END AS author, w.person AS author_ref, array_to_string(CASE WHEN w.person IS NOT NULL AND NOT list_contains(relates, w.person) THEN list_append(relates, w.person) ELSE relates END, ',') AS relates FROM notes LEFT JOIN who w ON w.ident = doc_id % 150 WHERE doc_id % 4 = 3",
    "stamp_candidates": f"WITH {O.NOTES} SELECT id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), 'session') AS source, coalesce(project, 'eng-x') AS project, array_to_string(CASE WHEN doc_id % 2 = 1 AND NOT list_contains(tags, 'customer:big-corp') THEN list_append(tags, 'customer:big-corp') ELSE tags END, ',') AS tags FROM notes WHERE doc_id % 4 = 3",
    "extraction_replies": f"WITH {EXTRACTED} SELECT reply, ok, CASE WHEN ok THEN len(items)::INTEGER END AS n, ok_strict FROM read",
    "extraction_candidates": f"WITH {EXTRACTED} SELECT e.reply, e.index::INTEGER AS index, CASE WHEN (c->>'$.kind') IN {_kinds} THEN c->>'$.kind' ELSE 'memory' END AS kind, c->>'$.title' AS title, c->>'$.body' AS body, array_to_string(from_json(json_extract(c, '$.tags'), '[\"VARCHAR\"]'), ',') AS tags FROM exploded e JOIN read r USING (reply) WHERE r.ok",
    "classifier_verdicts": f"WITH {VERDICTS} SELECT reply, index, judge, consolidation, target_id, why FROM verdicts",
    "verdict_join": f"WITH {VERDICTS}, asked AS (SELECT reply, unnest([0, 1, 2])::INTEGER AS index FROM f) SELECT a.reply, a.index, judge, consolidation, target_id FROM asked a LEFT JOIN verdicts v ON v.reply = a.reply AND v.index = a.index",
    "receipt_lines": f"WITH f AS ({T.OUTPUTS}), l AS (SELECT reply, trim(unnest(string_split(text, chr(10)))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS line_no FROM f) SELECT reply, line_no, regexp_extract(line, '\\[([^\\]]+)\\][ \\t]+(.+)$', 1) AS kind, trim(regexp_extract(line, '\\[([^\\]]+)\\][ \\t]+(.+)$', 2)) AS title, starts_with(line, 'promoted') AS promoted FROM l WHERE regexp_matches(line, '\\[([^\\]]+)\\][ \\t]+(.+)$')",
    "verdict_clauses": f"WITH {SUMMARY}, t AS (SELECT reply, concat_ws(', ', {_part('superseded', 'superseded an older note')}, CASE WHEN contradicted > 0 THEN contradicted::VARCHAR || ' flagged as a contradiction' || CASE WHEN contradicted = 1 THEN '' ELSE 's' END END, {_part('trivia', 'filtered as trivia')}, {_part('duplicate', 'dropped as duplicate(s)')}, {_part('clamped', 'verdict(s) clamped to distinct (unsafe target)')}) AS t FROM sums) SELECT reply, CASE WHEN t <> '' THEN ' (' || t || ')' ELSE '' END AS clause FROM t",
    "capture_receipts": f"WITH {O.NOTES}, r AS (SELECT doc_id % 40 AS run, title, doc_id % 80 < 40 AS promoted, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS nth FROM notes WHERE doc_id % 5 = 0) SELECT run, CASE WHEN bool_or(promoted) THEN '🧠 Team brain remembered:' || chr(10) ELSE '🧠 Team brain staged ' || count(*)::VARCHAR || ' note(s) for review:' || chr(10) END || string_agg('• \"' || title || '\"', chr(10) ORDER BY nth) FILTER (nth <= 3) || CASE WHEN count(*) > 3 THEN chr(10) || '(+' || (count(*) - 3)::VARCHAR || ' more)' ELSE '' END AS receipt FROM r GROUP BY run",
    "log_entries": f"WITH r AS ({T.RUNS}), c AS (SELECT *, (SELECT count(*) FROM range(1, captured + 1) t(i) WHERE (run + i) % 2 = 0)::INTEGER AS n, CASE WHEN extracted >= captured THEN extracted ELSE captured END AS got FROM r) SELECT run, CASE WHEN ok THEN 'ok' ELSE 'extraction-failed' END AS outcome, CASE WHEN ok THEN got END AS extracted, CASE WHEN ok THEN captured END AS captured, CASE WHEN ok THEN n END AS promoted, CASE WHEN ok THEN captured - n END AS staged, CASE WHEN ok THEN greatest(0, got - captured) END AS rejected, CASE WHEN NOT ok THEN nullif(substr({_one.format('error')}, 1, 200), '') END AS error FROM c",
    "capture_line_text": f"WITH r AS ({T.RUNS}), c AS (SELECT run, seconds AS all_seconds, CASE WHEN run % 13 <> 0 THEN seconds END AS seconds, captured, CASE WHEN run % 3 = 0 THEN captured END AS promoted, CASE WHEN run % 3 <> 0 THEN captured END AS staged, extracted AS rejected, CASE WHEN run % 2 = 0 THEN 'extractor-timeout' END AS reason, run % 5 AS k FROM r) SELECT run, 'Last capture (' || {_age} || '): ' || CASE k WHEN 0 THEN '✗ extraction failed (' || coalesce(reason, 'unknown') || ').' WHEN 1 THEN 'skipped (' || coalesce(reason, 'unknown') || ').' WHEN 2 THEN '✗ curate failed (' || coalesce(reason, 'unknown') || ').' WHEN 3 THEN CASE WHEN captured = 0 THEN 'reviewed, captured nothing' || CASE WHEN rejected > 0 THEN ' (' || rejected::VARCHAR || ' candidate(s) filtered by curation)' ELSE '' END || '.' ELSE '✓ ' || captured::VARCHAR || ' note(s)' || CASE WHEN concat_ws(', ', {_part('promoted', 'promoted')}, {_part('staged', 'staged')}) <> '' THEN ' (' || concat_ws(', ', {_part('promoted', 'promoted')}, {_part('staged', 'staged')}) || ')' ELSE '' END || '.' END ELSE 'odd.' END AS line, CASE WHEN reason IS NOT NULL THEN {_lit(HINTS['extractor-timeout'])} END AS hint, CASE WHEN all_seconds // 60 < 60 THEN (all_seconds // 60)::VARCHAR || 'm' WHEN all_seconds // 60 < 1440 THEN (all_seconds // 3600)::VARCHAR || 'h' ELSE (all_seconds // 86400)::VARCHAR || 'd' END AS age FROM c",
    "guard_calls": f"WITH c AS ({T.CALLS}), p AS (SELECT *, CASE WHEN tool = 'Bash' THEN coalesce(tool_input->>'$.description', '') ELSE coalesce(tool_input->>'$.file_path', '') END AS label, CASE WHEN tool = 'Bash' THEN coalesce(tool_input->>'$.command', '') WHEN tool = 'Write' THEN coalesce(tool_input->>'$.content', '') WHEN tool IN ('Edit', 'MultiEdit') THEN CASE WHEN json_type(tool_input, '$.edits') = 'ARRAY' THEN array_to_string(from_json(json_extract(tool_input, '$.edits[*].new_string'), '[\"VARCHAR\"]'), ' ') ELSE coalesce(tool_input->>'$.new_string', '') END END AS payload FROM c) SELECT call, substr({_one.format(chr(40) + 'label || chr(32) || payload' + chr(41))}, 1, 2000) AS summary FROM p WHERE cwd <> '' AND tool IN ('Write', 'Edit', 'MultiEdit', 'Bash') AND kind = 'brain' AND call % 5 <> 0 AND length(trim(payload)) >= 12",
    "config_load": f"WITH f AS ({T.CONFIGS}), p AS (SELECT brain, CASE WHEN json_valid(text) THEN text END AS j FROM f) SELECT brain, coalesce(nullif(CASE WHEN json_type(j, '$.name') = 'VARCHAR' THEN j->>'$.name' END, ''), brain) AS name, coalesce(CASE WHEN (j->>'$.embeddings.provider') IN ('none', 'local', 'hosted') THEN j->>'$.embeddings.provider' END, 'local') AS provider, {_share('$.embeddings.threshold', '0.85')}::DOUBLE AS dedup_threshold, coalesce(CASE WHEN (j->>'$.contradictionGuard.mode') IN ('warn', 'ask') THEN j->>'$.contradictionGuard.mode' END, 'warn') AS guard_mode, {_share('$.contradictionGuard.threshold', '0.82')}::DOUBLE AS guard_threshold, {_features} FROM p",
    "project_sources": f"WITH {FOLDERS} SELECT doc_id, coalesce({_repo}, CASE WHEN root IS NOT NULL THEN {_base('root')} END, {_base('path')}) AS source FROM folders",
    "project_manifests": f"WITH {FOLDERS}, m AS (SELECT * FROM ({T.MANIFESTS}) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY project) = 1) SELECT doc_id, best.project, CASE WHEN best.customer <> '' THEN 'customer:big-corp' END AS tag FROM folders f LEFT JOIN LATERAL (SELECT project, customer FROM m WHERE (f.path = m.dir OR starts_with(f.path, m.dir || '/')) AND length(m.dir) >= coalesce(length(f.root), 0) AND NOT contains(project, '/') ORDER BY length(m.dir) DESC LIMIT 1) best ON true",
    "brain_resolution": f"WITH {RESOLVED} SELECT doc_id, kind, brain, stage FROM resolved",
    "scoped_destination": f"WITH {RESOLVED}, e AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '/brains/asked' END AS asked FROM resolved), d AS (SELECT *, CASE WHEN kind = 'brain' THEN coalesce(asked, brain) WHEN kind = 'corrupt-config' THEN asked END AS destination FROM e) SELECT doc_id, destination, CASE WHEN destination IS NULL THEN CASE WHEN kind = 'denied' THEN 'out-of-scope' ELSE 'no-brain' END END AS skip, coalesce(asked, CASE WHEN kind = 'brain' THEN brain END) AS forced FROM d",
    "resolution_fallback": f"WITH {RESOLVED} SELECT doc_id // 5 AS doc_id, kind, brain FROM resolved QUALIFY row_number() OVER (PARTITION BY doc_id // 5 ORDER BY CASE kind WHEN 'brain' THEN 0 WHEN 'corrupt-config' THEN 1 WHEN 'denied' THEN 2 ELSE 3 END, doc_id) = 1",
    "wire_folders": f"WITH {FOLDERS} SELECT doc_id, {_repo} AS repo, CASE WHEN {_repo} IS NULL THEN path END AS prefix, '/brains/new' AS brain FROM folders",
    "wired_brains": f"WITH {RULE_ROWS}, b AS (SELECT ord, '/' || brain AS brain FROM rules WHERE brain IS NOT NULL UNION ALL SELECT 2000000000, '/default') SELECT brain, min(ord)::INTEGER AS place FROM b WHERE brain <> '/brain-shared' GROUP BY brain",
    "rule_projection": f"WITH {RULE_ROWS} SELECT ord::INTEGER AS ord, {_matcher} AS matcher, CASE WHEN NOT deny THEN brain END AS brain, deny, regexp_extract({_matcher}, '^(repo|org|prefix):', 1) AS kind, regexp_replace({_matcher}, '^(repo|org|prefix):', '') AS value FROM rules",
    "note_resources": f"WITH {O.NOTES}, t AS (SELECT id, CASE WHEN coalesce(status = 'superseded', false) THEN '> ⚠️ **Superseded**' || CASE WHEN length(superseded_by) > 0 THEN ' by `' || superseded_by || '`' ELSE '' END || ' — kept for history; prefer the note that replaced it.' || chr(10) || chr(10) ELSE '' END || '# ' || title || chr(10) || chr(10) || body AS text FROM notes) SELECT id, md5(text) AS digest, length(text)::INTEGER AS chars FROM t",
    "brain_map_resources": f"WITH {O.NOTES}, k AS (SELECT * FROM (VALUES (0, 'memory'), (1, 'decision'), (2, 'work-state'), (3, 'person')) t(o, kind)), newest AS (SELECT *, row_number() OVER (ORDER BY created DESC, id DESC) AS place FROM notes), u AS (SELECT -5 AS place, 'map' AS id, '' AS kind, 'map of the brain' AS title UNION ALL SELECT o - 4, 'kind:' || k.kind, k.kind, (SELECT count(*) FROM notes n WHERE n.kind = k.kind)::VARCHAR || ' note(s)' FROM k UNION ALL SELECT place, id, kind, title FROM newest WHERE place <= 200 UNION ALL SELECT 201, '…', '', (count(*) - 200)::VARCHAR || ' more' FROM notes HAVING count(*) > 200) SELECT place::INTEGER AS place, id, kind, title, 'brain://b/' || kind || '/' || id AS uri FROM u",
    "index_freshness": f"WITH {O.NOTES} SELECT count(*) AS n, max(coalesce(updated, created)) AS newest, count(*) = count(*) FILTER (doc_id > 0) AND max(coalesce(updated, created)) IS NOT DISTINCT FROM max(coalesce(updated, created)) FILTER (doc_id > 0) AS fresh FROM notes",
    "recovery_point": f"SELECT (epoch(TIMESTAMP '{LOG_NOW}')::BIGINT - floor(epoch(max(ts)))::BIGINT) AS seconds, true AS ok FROM events",
    "pending_annotations": f"WITH {O.NOTES}, {O.VERDICTS.rsplit('), parsed AS', 1)[0]}) SELECT id, CASE WHEN consolidation = 'contradicts' THEN '  ⚠ contradicts ' || trim(target_id) WHEN consolidation = 'supersedes' THEN '  ↳ supersedes ' || trim(target_id) ELSE '' END AS note FROM cands",
    "contradiction_payloads": f"WITH {O.NOTES}, m AS (SELECT id, doc_id, '⚠ This change may contradict decision [[' || id || ']]: ' || coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN title END, ''), id) || ' — your pending change is close to this recorded decision. Cited: ' || path AS message FROM notes WHERE kind = 'decision') SELECT id, CASE WHEN doc_id % 4 <> 2 THEN message END AS context, CASE WHEN doc_id % 4 = 2 THEN 'ask' END AS decision, CASE WHEN doc_id % 4 = 2 THEN message END AS reason FROM m",
    "sync_lines": f"WITH r AS ({T.RUNS}) SELECT run, 'sync: committed=' || (run % 2 = 0)::VARCHAR || ' pulled=' || (run % 3 = 0)::VARCHAR || ' pushed=' || (run % 5 = 0)::VARCHAR || ' conflicts=' || captured::VARCHAR || CASE WHEN run % 7 = 0 THEN ' (skipped: another sync held the lock)' ELSE '' END || CASE WHEN run % 4 = 0 THEN chr(10) || 'withheld 2 note(s) containing a secret: a.md, b.md' ELSE '' END AS line FROM r",
    "promotion_texts": f"WITH {O.NOTES}, c AS (SELECT brain, kind, count(*) AS n FROM notes WHERE doc_id % 5 = 0 GROUP BY ALL) SELECT brain, 'Promote ' || sum(n)::VARCHAR || CASE WHEN sum(n) = 1 THEN ' note' ELSE ' notes' END AS headline, string_agg('- ' || kind || ': ' || n::VARCHAR, chr(10) ORDER BY kind) AS by_kind FROM c GROUP BY brain",
    "coverage_text": f"WITH {O.WINDOWS}, t AS (SELECT brain, has_data, trend, " + ", ".join(f"CASE WHEN {k}_ratio IS NULL THEN '—' ELSE floor({k}_ratio * 100 + 0.5)::BIGINT::VARCHAR || '%' END || ' (' || {k}_productive::VARCHAR || '/' || {k}_seen::VARCHAR || ' sessions landed a note)' AS {k}_line" for k in ("short", "long")) + " FROM windows) SELECT brain, CASE WHEN NOT has_data THEN 'no capture activity logged yet' ELSE 'last 7d: ' || short_line || chr(10) || 'last 30d: ' || long_line || chr(10) || 'trend: ' || CASE trend WHEN 'up' THEN '↑ improving' WHEN 'down' THEN '↓ declining' WHEN 'flat' THEN '→ steady' ELSE '· no prior window' END END AS text FROM t",
    "contributor_bars": f"WITH {O.NOTES}, c AS (SELECT coalesce(nullif(trim(author), ''), '(unattributed)') AS contributor, count(*) AS n FROM notes GROUP BY 1) SELECT contributor, n, repeat('█', greatest(1, floor(n * 24.0::DOUBLE / (SELECT max(n) FROM c) + 0.5)::BIGINT)) AS bar FROM c",
    "managed_block": f"WITH {O.NOTES} SELECT id, CASE doc_id % 3 WHEN 0 THEN 'mine' || chr(10) || chr(10) ELSE CASE WHEN doc_id % 3 = 1 THEN id || ' text' || chr(10) || chr(10) ELSE '' END END || '<!-- BEGIN TEAM BRAIN -->' || chr(10) || 'block of ' || id || chr(10) || '<!-- END TEAM BRAIN -->' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'after ' || id ELSE '' END || chr(10) AS text FROM notes",
    "embedding_rows": f"WITH {O.NOTES}, t AS (SELECT id, concat_ws(' ', title, body) AS t FROM notes) SELECT id, length(t)::DOUBLE AS v0, len(string_split(t, ' '))::DOUBLE AS v1, unicode(t)::DOUBLE AS v2 FROM t",
    "agent_configs": f"WITH f AS ({T.REPO_FILES}) SELECT path, 'memory' AS kind, coalesce(nullif(trim(regexp_extract(text, '(?m)^#[ \\t]+([^\\n]+)$', 1)), ''), 'Project config: ' || {_base('path')}) AS title, substr({_trim.format('text')}, 1, 4000) AS body, 'config,seed' AS tags FROM f WHERE path IN ('CLAUDE.md', '.cursorrules', 'AGENTS.md', '.github/copilot-instructions.md') OR regexp_matches(path, '^\\.claude/rules/[^/]+\\.[mM][dD]$')",
    "seed_preview": f"WITH f AS ({T.REPO_FILES}), mined AS ({O.ORACLES['commit_mining']}) SELECT 'adr' AS seed, 0::BIGINT AS n UNION ALL SELECT 'config', count(*) FROM f WHERE path IN ('CLAUDE.md', '.cursorrules', 'AGENTS.md') OR regexp_matches(path, '^\\.claude/rules/[^/]+\\.md$') UNION ALL SELECT 'git', count(*) FROM mined",
    "rules_states": "SELECT n_nationkey::VARCHAR AS path, ['ok', 'corrupt', 'corrupt', 'missing'][n_nationkey % 4 + 1] AS state FROM nation",
    "note_keys": f"WITH {O.NOTES} SELECT id, created || '-' || {_slug('title')} || '-' || substr(sha256(id), 1, 4) AS key, {_first_line} AS first FROM notes",
    "log_of_brain": f"WITH {O.CAPLOG} SELECT log_ord, '/brains/./brain1' || CASE WHEN log_ord % 2 = 0 THEN '/x/../' ELSE '' END AS folder, log_ord % 2 = 0 AS made_up FROM caplog WHERE brain = 'brain1' AND log_ord % 7 <> 0",
    "scannable_files": f"WITH {O.NOTES}, p AS (SELECT id, doc_id, CASE doc_id % 5 WHEN 0 THEN 'INDEX.md' WHEN 1 THEN regexp_replace(path, 'md$', 'txt') WHEN 2 THEN 'a/' || path ELSE regexp_replace(path, '^[a-z-]+', 'other') END AS file FROM notes) SELECT id, file FROM p WHERE doc_id % 5 IN (0, 2)",
    "point_reads": f"WITH {O.NOTES} SELECT id, path FROM notes WHERE path = 'memory/n00000001.md'",
    "nearest_verdict": f"WITH n AS ({O.ORACLES['neighbors_lexical']}) SELECT candidate, neighbour AS nearest, score, score >= 0.8 AS duplicate FROM n WHERE rank = 1",
    "suppressed_count": f"WITH g AS ({O.ORACLES['graduate_candidates']}) SELECT count(*) FILTER (substr(cluster_key, 1, 1) IN ('0', '3', '6', '9', 'c', 'f')) AS suppressed, count(*) AS with_rejected FROM g",
    "staging_created": f"WITH {O.NOTES}, n AS (SELECT id FROM notes WHERE doc_id % 6 = 0 UNION ALL SELECT id FROM notes WHERE doc_id % 12 = 0) SELECT id, CASE WHEN count(*) OVER (PARTITION BY id) > 1 OR id IN (SELECT id FROM notes WHERE doc_id % 18 = 0) THEN 'refused' ELSE 'created' END AS state FROM n",
    "staging_rejected": f"WITH {O.NOTES} SELECT 'left' AS what, id AS key FROM notes WHERE doc_id % 5 = 0 AND doc_id % 10 <> 0 UNION ALL SELECT 'tombstone', substr(sha256(array_to_string(list_sort([source || '/' || id, 'x/y']), chr(10))), 1, 16) FROM notes WHERE doc_id % 30 = 0",
    "staging_reassigned": f"WITH {O.NOTES}, s AS (SELECT id, doc_id, relates, 'p' || (doc_id % 4)::VARCHAR AS p FROM notes WHERE doc_id % 5 = 0), r AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'q' || (doc_id % 4)::VARCHAR ELSE p END AS author_ref FROM s) SELECT id, author_ref, array_to_string(list_append(relates, author_ref), ',') AS relates FROM r",
    "rules_edited": f"WITH {RULE_ROWS}, e AS (SELECT * FROM rules WHERE coalesce(lower(repo), '') <> 'org1/repo1' AND coalesce(org, '') <> 'org3' UNION ALL SELECT 0, 'ORG1/repo1', NULL, NULL, 'b-new', false, 'local' UNION ALL SELECT 13, NULL, NULL, '/work/t9', 'b-last', false, 'local') SELECT ord::INTEGER AS ord, repo, org, prefix, brain, deny FROM e WHERE origin <> 'shared' OR {_matcher} NOT IN (SELECT {_matcher} FROM e WHERE origin <> 'shared')",
    "rules_imported": f"WITH {RULE_ROWS} SELECT origin, CASE WHEN origin = 'local' THEN count(*) ELSE 2 END AS n, 1::BIGINT AS imported, 1::BIGINT AS pruned FROM rules GROUP BY origin",
    "aliases_edited": "SELECT * FROM (VALUES ('eng-a', 'src0,src1,src9'), ('eng-c', 'src4'), ('eng-z', 'src8')) t(project, sources)",
    "conflict_siblings": f"WITH {O.NOTES}, v AS (SELECT path, id, doc_id, created, title, s AS side FROM notes, (VALUES ('ours'), ('theirs')) t(s) WHERE NOT (s = 'ours' AND doc_id % 3 = 0) AND NOT (s = 'theirs' AND doc_id % 3 = 1)), k AS (SELECT *, CASE WHEN doc_id % 3 = 2 THEN created || '-' || {_slug("title || ' of ' || side || ' (' || side || ')'")} || '-' || substr(sha256(path || ':' || side), 1, 4) ELSE id END AS new_id FROM v) SELECT path, side, new_id AS id, CASE WHEN doc_id % 3 = 2 THEN regexp_replace(path, '[^/]*$', '') || new_id || '.md' ELSE path END AS new_path FROM k",
    "hybrid_excerpts": f"WITH {O.NOTES}, {O.LEXICAL}, {O.VECTORS}, {O.SEMANTIC}, {O.HYBRID.replace('LIMIT 60', 'LIMIT 50')}, top20 AS (SELECT id, title, path, kind, status, score, lexical_rank, semantic_rank FROM fused ORDER BY {O.FRESH} LIMIT 20), ranked AS (SELECT id FROM top20), {SNIPPET} SELECT id, CASE WHEN lexical_rank IS NOT NULL AND semantic_rank IS NOT NULL THEN 'hybrid' WHEN lexical_rank IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS tier, CASE WHEN lexical_rank IS NOT NULL THEN excerpt WHEN length({_one.format('body')}) > 240 THEN substr({_one.format('body')}, 1, 240) || '…' ELSE {_one.format('body')} END AS excerpt FROM top20 JOIN snippets USING (id) JOIN (SELECT id, body FROM notes) USING (id)",
    "notes_overwritten": f"WITH {O.NOTES} SELECT id, CASE WHEN id LIKE '%7' THEN 'new' ELSE title END AS title, status FROM notes UNION ALL SELECT 'n-new', 'made', 'active'",
    "adopt_counts": f"WITH {O.NOTES}, {O.ALIAS}, own AS (SELECT unnest(sources) AS source FROM alias_map WHERE project = 'eng-a') SELECT o.source, (SELECT count(*) FROM notes n WHERE n.source = o.source AND doc_id % 5 <> 0 AND coalesce(trim(project), '') = '') AS adopted, (SELECT count(*) FROM notes n WHERE n.source = o.source AND doc_id % 5 <> 0 AND coalesce(trim(project), '') NOT IN ('', 'eng-a')) AS conflict, (SELECT count(*) FROM notes n WHERE n.source = o.source AND doc_id % 5 = 0) AS staged FROM own o",
    "adopt_retired": f"WITH {O.NOTES}, stuck AS (SELECT DISTINCT source FROM notes WHERE project IS NOT NULL AND source IN ('src1')), r(project, source) AS (VALUES ('eng-b', 'src2'), ('eng-b', 'src3'), ('eng-c', 'src1'), ('eng-c', 'src4') UNION ALL SELECT 'eng-a', source FROM stuck) SELECT project, string_agg(source, ',' ORDER BY source) AS sources FROM r GROUP BY project",
    "gate_with_fields": f"WITH {O.NOTES} SELECT id, 'contains-secret' AS reason FROM notes WHERE doc_id % 4 = 3 AND (doc_id % 16 = 3 OR {O._secret_any('concat_ws(chr(10), title, body, array_to_string(tags, chr(10)), author, source)', False)})",
    "framed_commits": f"WITH {O.NOTES}, {O.COMMITS}, s AS (SELECT {_trim.format('subject')} AS subject, 'body of ' || ord::VARCHAR AS body FROM commits) SELECT subject, body FROM s WHERE subject <> ''",
    "notes_deleted": f"WITH {O.NOTES} SELECT id, kind, title, CASE WHEN id LIKE '%50' AND kind IN ('memory', 'decision') THEN 'superseded' ELSE status END AS status, CASE WHEN id LIKE '%50' AND kind IN ('memory', 'decision') THEN 'n00000001' ELSE superseded_by END AS superseded_by FROM notes WHERE id NOT LIKE '%99'",
}
ORACLES["kind_listings"] = f"""WITH {O.NOTES}, l AS (
  SELECT kind AS path, created, id, '- **' || coalesce(title, '') || '**' || CASE WHEN superseded THEN ' _(superseded)_' ELSE '' END || ' — `' || id || '` (' || path || ')' AS line FROM notes
) SELECT path, row_number() OVER (PARTITION BY path ORDER BY created DESC NULLS LAST, id DESC, line) AS place, line FROM l
UNION ALL SELECT path, 0, '# ' || path || ' — ' || count(*)::VARCHAR || ' note(s)' FROM l GROUP BY path"""
ORACLES["folder_listings"] = f"""WITH {O.NOTES}, l AS (
  SELECT {_folder} AS folder, id, '- [' || {O.INLINE.format("coalesce(title, '')")} || '](' || regexp_extract(path, '[^/]*$') || ')' AS line FROM notes WHERE true
) SELECT folder AS path, row_number() OVER (PARTITION BY folder ORDER BY id, line) AS place, line FROM l
UNION ALL SELECT DISTINCT folder, 0, '# ' || folder FROM l"""
_listing = ORACLES["folder_listings"]
_before = _listing.replace("WHERE true", "WHERE doc_id <> 1 AND kind <> 'person'")
ORACLES["verify_report"] = f"""WITH {O.NOTES}, checks AS (
  SELECT * FROM ({O.ORACLES['verify_checks']})
  UNION ALL SELECT 'parse', count(*), count(*) = 0 FROM ({O.ORACLES['notes_parsed']}) p JOIN notes n USING (path) WHERE p.error IS NOT NULL OR n.doc_id % 40 = 1
  UNION ALL SELECT 'derived', count(DISTINCT path), count(*) = 0 FROM ({_listing}) a FULL JOIN ({_before}) b USING (path, place) WHERE a.line IS DISTINCT FROM b.line
) SELECT * FROM checks UNION ALL SELECT 'overall', count(*), bool_and(ok) FROM checks"""
ORACLES["remember_note"] = f"""WITH {O.NOTES}, e AS (SELECT id, {O.TOKENS.format(_content)} AS toks FROM notes WHERE doc_id % 4 <> 3), c AS (SELECT *, {O.TOKENS.format(_content)} AS toks FROM notes WHERE doc_id = 3),
l AS (SELECT c.id, e.id AS other, len(list_intersect(c.toks, e.toks))::DOUBLE / (len(c.toks) + len(e.toks) - len(list_intersect(c.toks, e.toks))) AS j FROM c, e WHERE len(c.toks) > 0 AND len(e.toks) > 0),
d AS (SELECT id, CASE WHEN {O._secret_any('concat_ws(chr(10), title, body, array_to_string(tags, chr(10)), author, source)', False)} THEN 'contains-secret' WHEN {_trim.format('title')} = '' OR length({_trim.format('body')}) < 15 THEN 'thin-content' END AS why, (SELECT arg_min(other, (-j, other)) FROM l WHERE j >= 0.8) AS duplicate_of FROM c)
SELECT id, CASE WHEN why IS NULL AND duplicate_of IS NULL THEN 'promoted' ELSE 'rejected' END AS outcome, coalesce(why, CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate' END) AS reason, CASE WHEN why IS NULL THEN duplicate_of END AS duplicate_of FROM d"""
