"""DuckDB SQL that says what each query of `lodestone.plans.queries` returns, over the same Parquet tables."""

from __future__ import annotations

from lodestone.plans.settings import ALLOW, ASK_CHARS, ASK_EVERY, COSINE_LEAST, DENY, QUERY, QUERY_TERMS, RECUR_COSINE, SEMANTIC_ID, TAIL_BYTES, WHO
from lodestone.sources.knowledge import LOG_NOW, RULES, TODAY


def _id(x: str) -> str:
    return f"'n' || lpad(({x})::VARCHAR, 8, '0')"


def _day(x: str) -> str:
    return f"strftime(DATE '2024-01-01' + ({x})::INTEGER, '%Y-%m-%d')"


NOTES = f"""
base AS (
  SELECT d.doc_id, d.text, d.source, d.lang, l.quality, l.toxic,
    CASE WHEN d.doc_id % 10 <= 5 THEN 'memory' WHEN d.doc_id % 10 <= 7 THEN 'decision' WHEN d.doc_id % 10 = 8 THEN 'work-state' ELSE 'person' END AS kind
  FROM documents d LEFT JOIN labels l USING (doc_id)
), withstatus AS (
  SELECT *, CASE kind WHEN 'memory' THEN CASE WHEN toxic = 1 THEN 'stale' WHEN doc_id % 17 = 0 THEN 'superseded' ELSE 'active' END
    WHEN 'decision' THEN CASE doc_id % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'accepted' ELSE 'superseded' END
    WHEN 'work-state' THEN CASE WHEN doc_id % 4 = 0 THEN 'planned' ELSE 'done' END END AS status FROM base
), notes AS (
  SELECT doc_id, {_id('doc_id')} AS id, kind, substr(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 1, 60) AS title, text AS body, source, lang,
    'brain' || (doc_id % 3)::VARCHAR AS brain, {_day('doc_id % 180')} AS created, CASE WHEN doc_id % 5 = 0 THEN {_day('doc_id % 180 + 30')} END AS updated,
    CASE WHEN quality = 1 AND doc_id % 2 = 0 THEN {_day('doc_id % 180 + 45')} END AS verified, status,
    CASE WHEN status = 'superseded' THEN CASE WHEN doc_id % 29 = 0 THEN 'n99999999' ELSE {_id('doc_id + 10')} END END AS superseded_by,
    CASE WHEN quality = 0 THEN [lang, 'Contradicted'] ELSE [lang] END AS tags, CASE WHEN doc_id % 4 = 0 THEN ['[[' || {_id('doc_id + 1')} || ']]'] ELSE []::VARCHAR[] END AS relates,
    CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'user' || (doc_id % 7)::VARCHAR END AS author, CASE WHEN doc_id % 13 = 0 THEN 'acme' END AS project, doc_id % 2 = 0 AS graduate,
    CASE kind WHEN 'decision' THEN 'decisions' WHEN 'person' THEN 'people' ELSE kind END || '/' || {_id('doc_id')} || '.md' AS path, quality,
    (kind IN ('memory', 'decision') AND coalesce(length(CASE WHEN status = 'superseded' THEN 'x' END), 0) > 0) OR coalesce(status = 'superseded', false) AS superseded
  FROM withstatus
)"""

_terms = QUERY_TERMS
_tf = ", ".join(f"len(list_filter(toks, lambda t: t = '{t}')) AS tf{i}" for i, t in enumerate(_terms))
_score = " + ".join(
    f"greatest(1e-6, ln((n_docs - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(len(_terms))
)
_matched = " + ".join(f"(tf{i} > 0)::INTEGER" for i in range(len(_terms)))

LEXICAL = f"""
toks AS (
  SELECT *, list_filter(regexp_split_to_array(lower(concat_ws(' ', id, kind, title, array_to_string(tags, ' '), body)), '[^a-z0-9]+'), lambda t: t <> '') AS toks FROM notes
), counted AS (
  SELECT id, kind, title, path, source, status, tags, superseded, len(toks) AS dl, {_tf} FROM toks
), corpus AS (
  SELECT count(*) AS n_docs, avg(dl) AS avgdl, {', '.join(f'sum((tf{i} > 0)::INTEGER) AS df{i}' for i in range(len(_terms)))} FROM counted
), scored AS (
  SELECT id, kind, title, path, source, status, tags, {_matched} AS n_match, {_score} AS score FROM counted, corpus WHERE NOT superseded AND ({_matched}) > 0
), lexical AS (
  SELECT * FROM scored WHERE (SELECT max(n_match) FROM scored) < {len(_terms)} OR n_match = {len(_terms)}
)"""

FRESH = "coalesce(status = 'stale', false)::INTEGER, score DESC, id"
_len = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
_dot = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"

VECTORS = f"""
vectors AS (SELECT {_id('vec_id')} AS id, embedding::DOUBLE[] AS vec FROM embeddings),
lens AS (SELECT id, vec, {_len('vec')} AS size FROM vectors)"""

SEMANTIC = f"""
asked AS (SELECT vec AS q, size AS q_size FROM lens WHERE id = '{SEMANTIC_ID}'),
near AS (
  SELECT n.id, n.kind, n.title, n.path, n.source, n.status, n.tags, {_dot('vec', 'q')} / (size * q_size) AS similarity FROM lens v JOIN notes n USING (id), asked WHERE NOT n.superseded
), semantic AS (SELECT * FROM near WHERE similarity > 0 ORDER BY similarity DESC, id LIMIT 50)"""

HYBRID = f"""
lexlist AS (SELECT * FROM lexical ORDER BY {FRESH} LIMIT 60),
lexrank AS (SELECT *, row_number() OVER (ORDER BY {FRESH}) AS lexical_rank FROM lexlist),
semrank AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS semantic_rank FROM semantic),
fused AS (
  SELECT coalesce(l.id, s.id) AS id, coalesce(l.kind, s.kind) AS kind, coalesce(l.title, s.title) AS title, coalesce(l.path, s.path) AS path, coalesce(l.source, s.source) AS source, coalesce(l.status, s.status) AS status,
    coalesce(l.tags, s.tags) AS tags, lexical_rank, semantic_rank, coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) AS score
  FROM lexrank l FULL JOIN semrank s ON l.id = s.id
)"""

TOKENS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: t <> ''))"
JACCARD = "len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"

CAPLOG = f"""
caplog AS (
  SELECT ts, 'brain' || (user_id % 5)::VARCHAR AS brain, CASE WHEN user_id % 5 = 2 THEN -event_id ELSE event_id END AS log_ord,
    CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN 'ok' WHEN event_type = 'view' THEN 'skipped' WHEN (props->>'$.k')::INTEGER % 4 = 3 THEN 'curate-failed' ELSE 'extraction-failed' END AS outcome,
    CASE WHEN event_type = 'error' THEN CASE (props->>'$.k')::INTEGER % 4 WHEN 0 THEN 'extractor-timeout' WHEN 1 THEN 'extractor-unavailable' WHEN 2 THEN '' ELSE 'curate-runtime' END END AS reason,
    CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'click' AND user_id % 5 = 0 AND ts >= TIMESTAMP '{LOG_NOW}' - INTERVAL 7 DAY THEN 1 ELSE 0 END AS staged,
    CASE WHEN event_type = 'signup' AND NOT (user_id % 5 = 1 AND ts >= TIMESTAMP '{LOG_NOW}' - INTERVAL 7 DAY) THEN 1 ELSE 0 END AS promoted
  FROM events
)"""
_NOW = f"TIMESTAMP '{LOG_NOW}'"
_OK = "(outcome = 'ok' AND staged + promoted >= 1)"
_FAILED = "outcome IN ('extraction-failed', 'curate-failed')"

ALIAS = "alias_map AS (SELECT * FROM (VALUES ('eng-a', ['src0', 'src1']), ('eng-b', ['src2', 'src3']), ('eng-c', ['src1', 'src4'])) AS t(project, sources))"

VERDICTS = f"""
cands AS (
  SELECT doc_id AS ord, id, tags, CASE WHEN doc_id % 11 = 0 THEN '??' WHEN quality = 0 THEN 'trivia' ELSE 'durable' END AS judge,
    ['distinct', 'duplicate', 'supersedes', 'contradicts', 'bogus'][doc_id % 5 + 1] AS consolidation,
    CASE WHEN doc_id % 9 = 0 THEN '  ' WHEN doc_id % 14 = 0 THEN 'nope' ELSE {_id('doc_id - 4')} END AS target_id,
    CASE WHEN doc_id % 8 = 7 THEN NULL WHEN doc_id % 6 = 0 THEN []::VARCHAR[] ELSE [{_id('doc_id - 4')}] END AS neighbor_ids
  FROM notes WHERE doc_id % 4 = 3
), parsed AS (
  SELECT *, judge = 'trivia' AS trivia, nullif(trim(target_id), '') AS target,
    CASE WHEN consolidation IN ('duplicate', 'supersedes', 'contradicts') AND nullif(trim(target_id), '') IS NOT NULL THEN consolidation ELSE 'distinct' END AS relation FROM cands
), clamps AS (
  SELECT *, CASE WHEN trivia THEN NULL WHEN relation <> 'distinct' AND neighbor_ids IS NOT NULL AND NOT list_contains(neighbor_ids, target) THEN 'target-not-in-neighbor-set'
    WHEN relation = 'duplicate' AND target NOT IN (SELECT id FROM notes WHERE doc_id % 4 <> 3) THEN 'duplicate-target-not-in-canon' END AS clamped FROM parsed
), acts AS (SELECT *, NOT trivia AND relation <> 'distinct' AND clamped IS NULL AS acts FROM clamps),
plan AS (
  SELECT ord, id, CASE WHEN trivia OR (acts AND relation = 'duplicate') THEN 'reject' ELSE 'stage' END AS action, CASE WHEN trivia THEN 'llm-trivia' WHEN acts AND relation = 'duplicate' THEN 'llm-duplicate' END AS reason,
    CASE WHEN acts AND relation = 'duplicate' THEN target END AS duplicate_of, CASE WHEN acts AND relation = 'supersedes' THEN target END AS supersedes, CASE WHEN acts AND relation = 'contradicts' THEN target END AS contradicts, clamped,
    array_to_string(CASE WHEN acts AND relation = 'contradicts' AND NOT list_contains(tags, 'contradicted') THEN list_append(tags, 'contradicted') ELSE tags END, ',') AS tags FROM acts
)"""


def _rule_rows() -> str:
    lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"
    extra = [(1_000_000 + i, None, None, p, None, i < len(DENY), "local") for i, p in enumerate([*DENY, *ALLOW])]
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in [*RULES, *extra])


ROUTES = f"""
rules AS (SELECT * FROM (VALUES {_rule_rows()}) AS t(ord, repo, org, prefix, brain, deny, origin)),
keyed AS (SELECT *, coalesce('repo:' || lower(repo), 'org:' || lower(org), 'prefix:' || prefix) AS key FROM rules),
live AS (SELECT * FROM keyed k WHERE origin <> 'shared' OR key NOT IN (SELECT key FROM keyed WHERE origin <> 'shared')),
subjects AS (
  SELECT doc_id, CASE WHEN doc_id % 8 <> 0 THEN 'org' || (doc_id % 4)::VARCHAR || '/repo' || (doc_id % 15)::VARCHAR END AS slug,
    CASE WHEN doc_id % 10 = 9 THEN '/workshop/p' || (doc_id % 9)::VARCHAR ELSE '/work/t' || (doc_id % 3)::VARCHAR || '/p' || (doc_id % 9)::VARCHAR END AS path FROM documents
), scored AS (
  SELECT s.*, r.ord, r.brain, r.deny,
    CASE WHEN coalesce(r.repo, r.org, r.prefix) = '*' THEN 1 WHEN lower(slug) = lower(repo) THEN 4 WHEN lower(split_part(slug, '/', 1)) = lower(regexp_replace(org, '/\\*$', '')) THEN 3 WHEN path = prefix OR starts_with(path, prefix || '/') THEN 2 END AS tier,
    CASE WHEN coalesce(r.repo, r.org, r.prefix) = '*' THEN 0 WHEN lower(slug) = lower(repo) THEN length(repo) WHEN lower(split_part(slug, '/', 1)) = lower(regexp_replace(org, '/\\*$', '')) THEN length(regexp_replace(org, '/\\*$', '')) ELSE length(prefix) END AS len
  FROM subjects s, live r
), best AS (
  SELECT * FROM scored WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier DESC, len DESC, deny DESC, ord) = 1
), routed AS (
  SELECT s.doc_id, s.slug, s.path, CASE WHEN b.doc_id IS NULL THEN 'unmatched' WHEN b.deny THEN 'denied' ELSE 'brain' END AS kind, CASE WHEN b.doc_id IS NOT NULL AND NOT b.deny THEN coalesce(b.brain, 'brain-default') END AS brain
  FROM subjects s LEFT JOIN best b USING (doc_id)
)"""

TRANSCRIPTS = """
turns AS (SELECT conv_id, turn AS line_no, role, text FROM conversations),
lines AS (SELECT * FROM turns UNION ALL SELECT t.conv_id, t.line_no + m.last + 1, role, text FROM turns t JOIN (SELECT conv_id, max(line_no) AS last FROM turns GROUP BY conv_id) m USING (conv_id) WHERE t.line_no % 3 = 0)"""

COMMITS = """
commits AS (
  SELECT doc_id AS ord, CASE doc_id % 6 WHEN 0 THEN title WHEN 1 THEN title || ' (#' || doc_id::VARCHAR || ')' WHEN 2 THEN 'wip: ' || title WHEN 3 THEN 'bump ' || title
    WHEN 4 THEN 'Merge pull request #' || doc_id::VARCHAR || ' from x/y' ELSE 'wipe out ' || title END AS subject, CASE WHEN doc_id % 4 = 0 THEN '' ELSE body END AS body FROM notes
), parsed AS (
  SELECT *, nullif(regexp_extract(subject, '\\(#([0-9]+)\\)[ \\t]*$', 1), '') AS squash, nullif(regexp_extract(subject, '^Merge pull request #([0-9]+) from ', 1), '') AS merge FROM commits
), titled AS (
  SELECT *, coalesce(squash, merge) AS number, CASE WHEN squash IS NOT NULL THEN trim(regexp_replace(subject, '\\(#[0-9]+\\)[ \\t]*$', '')) ELSE subject END AS title FROM parsed
), kept AS (
  SELECT *, lower(trim(regexp_replace(title, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS title_key FROM titled
  WHERE length(title) > 0 AND NOT (number IS NULL AND regexp_matches(subject, '(?i)^(?:(?:wip|fixup|bump)(?:$|[\\s:!])|merge branch\\b|chore\\(deps\\))')) AND NOT (number IS NULL AND body = '') AND NOT (merge IS NOT NULL AND body = '')
)"""

COMPONENTS = """
reach AS (
  SELECT a AS d, a AS r FROM links UNION SELECT b, b FROM links
  UNION SELECT reach.d, l.v FROM reach JOIN (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links) l ON l.u = reach.r
), components AS (SELECT d AS id, min(r) AS component FROM reach GROUP BY d)"""

_SETS = f"sets AS (SELECT id, kind, status, brain, {TOKENS.format(chr(116) + 'itle || chr(32) || body')} AS toks FROM notes)"
CONSOLIDATE = f"""
{_SETS}, livesets AS (SELECT id, kind, toks FROM sets WHERE coalesce(status, '') <> 'superseded' AND len(toks) > 0),
posting AS (SELECT id, kind, len(toks) AS n, unnest(toks) AS t FROM livesets),
common AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM posting x JOIN posting y ON x.t = y.t AND x.kind = y.kind AND x.id < y.id AND least(x.n, y.n) >= 0.9 * greatest(x.n, y.n) - 1e-9 GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE k::DOUBLE / (na + nb - k) >= 0.9), {COMPONENTS}, members AS (
  SELECT n.id, component, row_number() OVER w AS place, first_value(n.id) OVER w AS survivor FROM notes n JOIN components c ON c.id = n.id
  WINDOW w AS (PARTITION BY component ORDER BY CASE WHEN kind = 'memory' THEN coalesce(verified, '') ELSE '' END DESC, created DESC, n.id)
)"""

GRADUATE = f"""
{_SETS}, pool AS (SELECT n.id, n.kind, n.brain, s.toks, v.vec, v.size FROM notes n JOIN sets s ON s.id = n.id JOIN lens v ON v.id = n.id WHERE n.graduate AND n.kind = 'memory' AND n.status = 'active' AND len(s.toks) > 0),
posting AS (SELECT id, kind, brain, len(toks) AS n, unnest(toks) AS t FROM pool),
common AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM posting x JOIN posting y ON x.t = y.t AND x.kind = y.kind AND x.brain <> y.brain AND x.id < y.id GROUP BY ALL),
links AS (SELECT c.a, c.b FROM common c JOIN pool p ON p.id = c.a JOIN pool q ON q.id = c.b WHERE k::DOUBLE / (na + nb - k) >= 0.3 AND {_dot('p.vec', 'q.vec')} / (p.size * q.size) >= {RECUR_COSINE}), {COMPONENTS},
spread AS (SELECT component FROM components JOIN pool USING (id) GROUP BY component HAVING count(DISTINCT brain) >= 2),
members AS (SELECT c.component, n.*, coalesce(nullif(source, ''), brain) || '/' || n.id AS ref FROM components c JOIN spread USING (component) JOIN notes n ON n.id = c.id),
graduated AS (
  SELECT substr(sha256(string_agg(DISTINCT ref, chr(10) ORDER BY ref)), 1, 16) AS cluster_key, first(kind ORDER BY coalesce(verified, '') DESC, created DESC, id) AS kind, first(title ORDER BY coalesce(verified, '') DESC, created DESC, id) AS title,
    first(id ORDER BY coalesce(verified, '') DESC, created DESC, id) AS representative, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs, count(DISTINCT brain) AS brains FROM members GROUP BY component
)"""

REFS = """
refs AS (
  SELECT id, source, regexp_replace(unnest(list_concat(relates, CASE WHEN kind IN ('memory', 'decision') AND superseded_by IS NOT NULL THEN [superseded_by] ELSE [] END)), '^\\[\\[|\\]\\]$', '', 'g') AS ref FROM notes
)"""


def _flags(join: str) -> str:
    return f"""
{REFS}, flags AS (
  SELECT n.*, coalesce(kind = 'memory' AND (status = 'stale' OR (status = 'active' AND greatest(0, date_diff('day', coalesce(verified, updated, created)::DATE, DATE '{TODAY}')) > 90)), false) AS stale,
    coalesce(kind = 'memory' AND status = 'active' AND verified IS NULL, false) AS unverified, list_contains(list_transform(tags, lambda t: lower(t)), 'contradicted') AS contradicted,
    NOT EXISTS (SELECT 1 FROM refs r WHERE r.ref = n.id{join}) AS orphaned FROM notes n
)"""


FLAGS = _flags("")
SCORE = "count(*) AS total, count(*) FILTER (stale) AS stale, count(*) FILTER (unverified) AS unverified, count(*) FILTER (contradicted) AS contradicted, count(*) FILTER (orphaned) AS orphaned, greatest(0, least(100, floor(100 * (1 - (count(*) FILTER (stale OR contradicted) + 0.5::DOUBLE * count(*) FILTER ((unverified OR orphaned) AND NOT (stale OR contradicted))) / count(*)) + 0.5)))::INTEGER AS score"

_SECRET = "regexp_matches({0}, '{1}')"


def _shows(column: str, rule: tuple) -> str:
    """As `secrets.shown`; DuckDB's entropy of a list of characters is in bits."""
    from lodestone.operators.secrets import secret_groups

    _, shape, least, keywords = rule
    quoted = shape.replace("'", "''")
    sql = f"({' OR '.join(f"contains(lower({column}), '{k.lower()}')" for k in keywords) or 'true'}) AND regexp_matches({column}, '{quoted}')"
    if least is not None:
        above = [f"len(list_filter(regexp_extract_all({column}, '{quoted}', {g}), lambda m: list_entropy(string_split(m, '')) > {least})) > 0" for g in secret_groups(rule)]
        sql += f" AND ({' OR '.join(above)})"
    return f"coalesce({sql}, false)"


def _secret_any(column: str, generic: bool) -> str:
    from lodestone.operators.secrets import rules

    return "(" + " OR ".join(_shows(column, r) for r in rules(generic)) + ")"


def _secret_kinds(column: str) -> str:
    from lodestone.operators.secrets import rules

    whens = ", ".join(f"CASE WHEN {_shows(column, r)} THEN '{r[0]}' END" for r in rules(True))
    return f"array_to_string(list_filter([{whens}], lambda x: x IS NOT NULL), ',')"


_windows = {"short": f"ts >= {_NOW} - INTERVAL 7 DAY AND ts <= {_NOW}", "long": f"ts >= {_NOW} - INTERVAL 30 DAY AND ts <= {_NOW}", "prior": f"ts >= {_NOW} - INTERVAL 14 DAY AND ts < {_NOW} - INTERVAL 7 DAY"}
WINDOWS = f"""
{CAPLOG}, brains AS (SELECT 'brain' || i::VARCHAR AS brain FROM range(6) t(i)),
counts AS (SELECT brain, {', '.join(f'count(*) FILTER ({c}) AS {k}_seen, count(*) FILTER ({c} AND {_OK}) AS {k}_productive' for k, c in _windows.items())} FROM caplog WHERE outcome <> 'skipped' GROUP BY brain),
filled AS (SELECT b.brain, {', '.join(f'coalesce({k}_{w}, 0) AS {k}_{w}' for k in _windows for w in ('seen', 'productive'))} FROM brains b LEFT JOIN counts USING (brain)),
ratios AS (SELECT *, {', '.join(f'CASE WHEN {k}_seen > 0 THEN {k}_productive::DOUBLE / {k}_seen END AS {k}_ratio' for k in _windows)} FROM filled),
windows AS (SELECT *, CASE WHEN short_ratio IS NULL OR prior_ratio IS NULL THEN 'none' WHEN short_ratio - prior_ratio > 0.05 THEN 'up' WHEN short_ratio - prior_ratio < -0.05 THEN 'down' ELSE 'flat' END AS trend, long_seen > 0 AS has_data FROM ratios)"""

STREAK = f"""
{CAPLOG}, newest AS (SELECT brain, max_by(outcome, log_ord) AS outcome, max_by(coalesce(reason, ''), log_ord) AS reason FROM caplog GROUP BY brain),
other AS (SELECT c.brain, max(c.log_ord) AS last FROM caplog c JOIN newest n USING (brain) WHERE c.outcome <> n.outcome OR coalesce(c.reason, '') <> n.reason GROUP BY c.brain),
streaks AS (SELECT n.brain, n.outcome, n.reason, CASE WHEN n.{_FAILED} THEN count(*) ELSE 0 END AS streak FROM newest n JOIN caplog c USING (brain) LEFT JOIN other o USING (brain) WHERE o.last IS NULL OR c.log_ord > o.last GROUP BY n.brain, n.outcome, n.reason)"""

_nb = "regexp_replace({0}, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"
_one = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
_slug = lambda c: f"regexp_replace(substr(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9_ -]', '', 'g'), ' ', '-', 'g'), 1, 60), '-+$', '')"
_gist = f"coalesce(substr(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim({_nb.format('x')})), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], 1, 160), '')"
_remote = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(remote), '(?i)\\.git$', ''), '(?i)^[a-z]+://', ''), '^[^@]+@', ''), '^[^/:]+[:/]', '')"
ENTITIES = "CASE WHEN kind = 'decision' THEN 0 WHEN kind = 'work-state' THEN 1 ELSE 2 END"

ORACLES: dict[str, str] = {
    "lexical_search": f"WITH {NOTES}, {LEXICAL} SELECT id, kind, title, path, n_match::INTEGER AS n_match, round(score, 6) AS score FROM lexical ORDER BY {FRESH} LIMIT 20",
    "lexical_or_fallback": f"WITH {NOTES}, {LEXICAL.replace(f'< {len(_terms)} OR n_match = {len(_terms)}', '> 0')} SELECT id, n_match::INTEGER AS n_match, round(score, 6) AS score FROM lexical",
    "semantic_topk": f"WITH {NOTES}, {VECTORS}, {SEMANTIC} SELECT id, title, round(similarity, 6) AS similarity FROM semantic",
    "hybrid_rrf": f"WITH {NOTES}, {LEXICAL}, {VECTORS}, {SEMANTIC}, {HYBRID.replace('LIMIT 60', 'LIMIT 50')} SELECT id, kind, title, path, round(score, 9) AS score FROM fused ORDER BY {FRESH} LIMIT 20",
    "hybrid_diagnostics": f"WITH {NOTES}, {LEXICAL}, {VECTORS}, {SEMANTIC}, {HYBRID} SELECT id, lexical_rank::INTEGER AS lexical_rank, semantic_rank::INTEGER AS semantic_rank, round(score, 9) AS rrf_score, CASE WHEN lexical_rank IS NOT NULL AND semantic_rank IS NOT NULL THEN 'hybrid' WHEN lexical_rank IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS tier FROM fused ORDER BY {FRESH} LIMIT 60",
    "hybrid_strict": f"WITH {NOTES}, {LEXICAL}, {VECTORS}, {SEMANTIC}, {HYBRID} SELECT id, round(score, 9) AS score FROM fused WHERE lexical_rank IS NOT NULL OR {' OR '.join(f'''contains(lower(title || ' ' || array_to_string(tags, ' ')), '{w}')''' for w in QUERY.lower().split())} ORDER BY {FRESH} LIMIT 60",
    "ask_budget": f"WITH {NOTES}, {LEXICAL}, ranked AS (SELECT id, title, path, score, row_number() OVER (ORDER BY {FRESH}) AS rank FROM lexical QUALIFY rank <= 20), sized AS (SELECT r.*, {_one.format('substr(n.body, 1, 200)')} AS excerpt FROM ranked r JOIN notes n USING (id)), used AS (SELECT *, sum(length(title) + length(path) + length(excerpt)) OVER (ORDER BY rank) AS used FROM sized) SELECT rank::INTEGER AS rank, id, title, excerpt, used::BIGINT AS used FROM used WHERE rank = 1 OR used <= {ASK_CHARS}",
    "ask_coverage": f"WITH {NOTES}, {LEXICAL}, ranked AS (SELECT id, score, row_number() OVER (ORDER BY {FRESH}) AS rank FROM lexical QUALIFY rank <= 8) SELECT count(*) > 0 AS matched, round(coalesce(max(CASE WHEN rank = 1 THEN score END), 0), 6) AS top_score, count(*) AS total FROM ranked",
    "context_default": f"WITH {NOTES}, u AS (SELECT 0 AS section, id, kind, title, created, '' AS newest FROM notes WHERE kind = 'work-state' AND status <> 'done' UNION ALL SELECT 1, id, kind, title, created, created FROM notes WHERE kind = 'decision') SELECT section, id, kind, title, created FROM u ORDER BY section, newest DESC, id LIMIT 60",
    "who_is": f"WITH {NOTES} SELECT id, title FROM notes WHERE kind = 'person' AND (contains(lower(title), '{WHO}') OR contains(lower(id), '{WHO}') OR len(list_filter(tags, lambda t: contains(lower(t), '{WHO}'))) > 0)",
    "work_state_active": f"WITH {NOTES} SELECT id, status, title FROM notes WHERE kind = 'work-state' AND status <> 'done'",
    "jaccard_pairs": f"WITH sets AS (SELECT doc_id, {TOKENS.format('text')} AS toks FROM documents), keyed AS (SELECT doc_id, toks, min(doc_id) OVER (PARTITION BY list_sort(toks)) AS head FROM sets WHERE len(toks) > 0), posting AS (SELECT doc_id, len(toks) AS n, unnest(toks) AS t FROM keyed WHERE doc_id = head), common AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM posting x JOIN posting y ON x.t = y.t AND x.doc_id < y.doc_id AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-9 GROUP BY ALL) SELECT a, b, round(k::DOUBLE / (na + nb - k), 9) AS similarity FROM common WHERE k::DOUBLE / (na + nb - k) >= 0.8 UNION ALL SELECT head, doc_id, 1.0 FROM keyed WHERE doc_id <> head",
    "neighbors_lexical": f"WITH c AS (SELECT item_id, {TOKENS.format('text')} AS toks FROM benchmark), d AS (SELECT doc_id, {TOKENS.format('text')} AS toks FROM documents), cp AS (SELECT item_id, len(toks) AS nc, unnest(toks) AS t FROM c), dp AS (SELECT doc_id, len(toks) AS nd, unnest(toks) AS t FROM d), s AS (SELECT item_id, doc_id, count(*)::DOUBLE / (nc + nd - count(*)) AS score FROM cp JOIN dp USING (t) GROUP BY item_id, doc_id, nc, nd) SELECT item_id AS candidate, row_number() OVER w AS rank, doc_id AS neighbour, round(score, 9) AS score FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 2",
    "neighbors_vector": f"WITH {VECTORS}, s AS (SELECT c.id AS candidate, t.id AS neighbour, {_dot('c.vec', 't.vec')} / (c.size * t.size) AS score FROM lens c JOIN lens t ON c.id <> t.id WHERE substr(c.id, 2)::BIGINT % {ASK_EVERY} = 0) SELECT candidate, row_number() OVER w AS rank, neighbour, round(score, 6) AS score FROM s WHERE score > 0 WINDOW w AS (PARTITION BY candidate ORDER BY score DESC, neighbour) QUALIFY rank <= 2",
    "semantic_duplicates": f"WITH {NOTES}, {VECTORS}, s AS (SELECT c.id AS candidate, t.id AS neighbour, {_dot('c.vec', 't.vec')} / (c.size * t.size) AS score FROM lens c JOIN lens t ON c.id <> t.id WHERE substr(c.id, 2)::BIGINT % {ASK_EVERY} = 0 AND t.id IN (SELECT id FROM notes WHERE doc_id % 4 <> 3)) SELECT candidate, neighbour, round(score, 6) AS score FROM s WHERE score >= {COSINE_LEAST} QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY score DESC, neighbour) = 1",
    "curate_gate": f"WITH {NOTES} SELECT id, CASE WHEN coalesce({_secret_any('concat_ws(chr(10), title, body, array_to_string(tags, chr(10)), author, source)', False)}, false) THEN 'contains-secret' WHEN kind = 'decision' THEN 'auto-adr-disabled' WHEN {_nb.format('title')} = '' OR length({_nb.format('body')}) < 15 THEN 'thin-content' END AS reason FROM notes WHERE doc_id % 4 = 3",
    "contradiction_check": f"WITH {NOTES}, {VECTORS}, asked AS (SELECT vec AS q, size AS q_size FROM lens WHERE id = '{SEMANTIC_ID}') SELECT id, title, path, round({_dot('vec', 'q')} / (size * q_size), 6) AS score FROM lens JOIN notes USING (id), asked WHERE kind = 'decision' AND status <> 'superseded' AND {_dot('vec', 'q')} / (size * q_size) >= {COSINE_LEAST} ORDER BY {_dot('vec', 'q')} / (size * q_size) DESC, id LIMIT 1",
    "consolidate_clusters": f"WITH RECURSIVE {NOTES}, {CONSOLIDATE} SELECT id, component FROM components",
    "consolidate_plan": f"WITH RECURSIVE {NOTES}, {CONSOLIDATE} SELECT id AS duplicate, survivor FROM members WHERE place > 1",
    "supersede_apply": f"WITH RECURSIVE {NOTES}, {CONSOLIDATE}, p AS (SELECT id AS d, survivor FROM members WHERE place > 1) SELECT n.id, CASE WHEN p.d IS NOT NULL AND kind IN ('memory', 'decision') THEN 'superseded' ELSE status END AS status, CASE WHEN p.d IS NOT NULL AND kind IN ('memory', 'decision') THEN survivor ELSE superseded_by END AS superseded_by FROM notes n LEFT JOIN p ON p.d = n.id",
    "graduate_candidates": f"WITH RECURSIVE {NOTES}, {VECTORS}, {GRADUATE} SELECT * FROM graduated",
    "graduate_suppressed": f"WITH RECURSIVE {NOTES}, {VECTORS}, {GRADUATE} SELECT cluster_key FROM graduated WHERE substr(cluster_key, 1, 1) NOT IN ('0', '3', '6', '9', 'c', 'f')",
    "verdict_plan": f"WITH {NOTES}, {VERDICTS} SELECT * FROM plan",
    "capture_outcomes": f"WITH {NOTES}, {VERDICTS} SELECT count(*) AS n, count(*) FILTER (action = 'stage') AS staged, count(*) FILTER (reason = 'llm-trivia') AS trivia, count(*) FILTER (reason = 'llm-duplicate') AS duplicates, count(supersedes) AS supersedes, count(contradicts) AS contradicts, count(clamped) AS clamped FROM plan",
    "brain_map_kinds": f"WITH {NOTES}, k AS (SELECT * FROM (VALUES (0, 'memory'), (1, 'decision'), (2, 'work-state'), (3, 'person')) AS t(kind_ord, kind)) SELECT kind_ord, kind, count(id) AS n FROM k LEFT JOIN notes USING (kind) GROUP BY ALL",
    "brain_map_contributors": f"WITH {NOTES} SELECT coalesce(nullif(trim(author), ''), '(unattributed)') AS contributor, count(*) AS n FROM notes GROUP BY 1",
    "health_buckets": f"WITH {NOTES}, {FLAGS}, b AS (SELECT id, 'stale' AS bucket FROM flags WHERE stale UNION ALL SELECT id, 'unverified' FROM flags WHERE unverified UNION ALL SELECT id, 'contradicted' FROM flags WHERE contradicted UNION ALL SELECT id, 'orphaned' FROM flags WHERE orphaned) SELECT bucket, count(*) OVER (PARTITION BY bucket) AS n, id FROM b",
    "health_score": f"WITH {NOTES}, {FLAGS} SELECT {SCORE} FROM flags",
    "health_by_project": f"WITH {NOTES}, {_flags(' AND r.source = n.source')} SELECT source, {SCORE} FROM flags GROUP BY source",
    "coverage_windows": f"WITH {WINDOWS} SELECT brain, short_seen, short_productive, long_seen, long_productive, round(short_ratio, 9) AS short_ratio, round(long_ratio, 9) AS long_ratio FROM windows",
    "coverage_trend": f"WITH {WINDOWS} SELECT brain, trend, has_data, round(prior_ratio, 9) AS prior_ratio FROM windows",
    "coverage_gate": f"WITH {WINDOWS} SELECT brain, short_ratio IS NOT NULL AND short_ratio < 0.5 AS failed FROM windows",
    "failure_breakdown": f"WITH {CAPLOG} SELECT brain, coalesce(nullif(reason, ''), outcome) AS class, count(*) AS n FROM caplog WHERE {_FAILED} AND {_windows['long']} GROUP BY ALL",
    "last_failure": f"WITH {CAPLOG} SELECT brain, outcome, coalesce(reason, '') AS reason, ts FROM caplog WHERE {_FAILED} AND {_windows['long']} QUALIFY row_number() OVER (PARTITION BY brain ORDER BY log_ord DESC) = 1",
    "failure_streak": f"WITH {STREAK} SELECT brain, outcome, reason, streak, CASE WHEN streak >= 3 THEN 'fail' WHEN streak > 0 THEN 'warn' WHEN outcome = 'skipped' THEN 'skip' ELSE 'ok' END AS severity FROM streaks",
    "caplog_rolling_cap": f"WITH {CAPLOG}, r AS (SELECT brain, log_ord, outcome, row_number() OVER w AS place, sum(length(outcome) + length(coalesce(reason, '')) + 40) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM caplog WINDOW w AS (PARTITION BY brain ORDER BY log_ord DESC)) SELECT brain, log_ord, outcome, used::BIGINT AS used FROM r WHERE place = 1 OR (place <= 500 AND used <= 20000)",
    "route_resolution": f"WITH {ROUTES} SELECT doc_id, slug, path, kind, brain FROM routed",
    "scope_decision": f"WITH {ROUTES} SELECT doc_id, brain, kind = 'brain' AS may_write, CASE kind WHEN 'denied' THEN 'denied by rule' WHEN 'none' THEN 'allowed, no destination' WHEN 'unmatched' THEN 'no rule' ELSE 'routed' END AS why FROM routed",
    "project_identity": f"WITH {NOTES}, {ALIAS}, s AS (SELECT source, min(project) AS p FROM (SELECT project, unnest(sources) AS source FROM alias_map) GROUP BY source) SELECT id, coalesce(nullif(trim(project), ''), p, nullif(n.source, '')) AS resolved FROM notes n LEFT JOIN s ON s.source = n.source",
    "adopt_report": f"WITH {NOTES} SELECT s.source, count(*) FILTER (n.id IS NOT NULL AND project IS NULL) AS adopted, count(*) FILTER (project <> 'eng-a') AS conflict FROM (VALUES ('src0'), ('src1')) AS s(source) LEFT JOIN notes n ON n.source = s.source GROUP BY s.source",
    "adopt_notes": f"WITH {NOTES} SELECT id, CASE WHEN project IS NULL THEN 'adopted' WHEN project = 'eng-a' THEN 'already' ELSE 'conflict' END AS state, array_to_string(CASE WHEN project IS NULL THEN list_append(tags, 'project:eng-a') ELSE tags END, ',') AS tags FROM notes WHERE source IN ('src0', 'src1')",
    "verify_checks": f"WITH {NOTES}, c AS (SELECT 'schema' AS check_name, count(*) AS findings FROM notes WHERE title = '' OR id IS NULL OR kind IS NULL UNION ALL SELECT 'duplicate-ids', count(*) FROM (SELECT id FROM notes GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'dangling-supersede', count(*) FROM notes WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM notes) UNION ALL SELECT 'secrets', count(*) FROM notes WHERE {_secret_any('body', False)}) SELECT check_name, findings, findings = 0 AS ok FROM c",
    "dangling_refs": f"WITH {NOTES} SELECT id, superseded_by AS ref FROM notes WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM notes)",
    "duplicate_ids": f"WITH {NOTES}, two AS (SELECT id FROM notes UNION ALL SELECT id FROM notes WHERE doc_id % 50 = 0) SELECT id, count(*) AS n FROM two GROUP BY id HAVING count(*) > 1",
    "reconcile_promoted": f"WITH {NOTES} SELECT id, CASE WHEN doc_id % 10 = 0 THEN 'cleared' ELSE 'kept' END AS state FROM notes WHERE doc_id % 5 = 0",
    "staged_pending": f"WITH {NOTES} SELECT brain, count(*) AS pending FROM notes WHERE doc_id % 5 = 0 GROUP BY brain",
    "resource_listing": f"WITH {NOTES}, l AS (SELECT id, kind, title, created, row_number() OVER (ORDER BY created DESC, id DESC) AS place FROM notes QUALIFY place <= 200) SELECT id, kind, title, created, place::INTEGER AS place FROM l UNION ALL SELECT '…', '', (count(*) - 200)::VARCHAR || ' more', '', 201 FROM notes HAVING count(*) > 200",
    "secret_scan": f"SELECT doc_id, {_secret_kinds('text')} AS kinds FROM documents WHERE {_secret_any('text', True)}",
    "secret_withheld": f"WITH {NOTES} SELECT brain, {_secret_any('body', True)} AS withheld, count(*) AS n FROM notes WHERE doc_id % 5 = 0 GROUP BY ALL",
    "transcript_compact": f"WITH {TRANSCRIPTS} SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY line_no) AS transcript FROM lines GROUP BY conv_id",
    "transcript_dedup": f"WITH {TRANSCRIPTS} SELECT conv_id, line_no, role, text FROM lines QUALIFY row_number() OVER (PARTITION BY conv_id, text ORDER BY line_no) = 1",
    "transcript_tail_cap": f"WITH {TRANSCRIPTS}, u AS (SELECT conv_id, line_no, sum(strlen(role || ': ' || text) + 1) OVER (PARTITION BY conv_id ORDER BY line_no DESC) AS used FROM lines) SELECT conv_id, line_no, used::BIGINT AS used FROM u WHERE used <= {TAIL_BYTES}",
    "commit_mining": f"WITH {NOTES}, {COMMITS} SELECT ord, 'memory' AS kind, title, substr({_nb.format('CASE WHEN body <> chr(0) AND length(body) > 0 THEN body ELSE title END')}, 1, 4000) AS body, CASE WHEN number IS NOT NULL THEN 'git,seed,pr' ELSE 'git,seed' END AS tags FROM kept QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY ord) = 1",
    "scalars_text": f"WITH {NOTES} SELECT id, {_slug('title')} AS slug, {_gist} AS gist, substr(trim(regexp_replace(regexp_replace(regexp_replace(title, '[\\r\\n]+', ' ', 'g'), '([\\[\\]`])', '\\\\\\1', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), 1, 200) AS inline_title, CASE WHEN length({_one.format('body')}) > 320 THEN substr({_one.format('body')}, 1, 320) || '…' ELSE {_one.format('body')} END AS excerpt, greatest(0, date_diff('day', coalesce(verified, updated, created)::DATE, DATE '{TODAY}'))::INTEGER AS age FROM notes",
    "scalars_path": f"SELECT page_id, coalesce(array_to_string(list_slice(string_split(remote_path, '/'), -2, -1), '/'), '') AS slug FROM (SELECT page_id, array_to_string(list_filter(string_split({_remote.replace('remote', 'url')}, '/'), lambda x: x <> ''), '/') AS remote_path FROM pages)",
    "scalars_identity": f"SELECT c_custkey, sha256(lower({_one.format('c_name')})) AS identity, {_slug('c_name')} || '-' || substr(sha256(lower({_one.format('c_name')})), 1, 10) AS contributor FROM customer",
    "notes_parsed": f"""WITH {NOTES} SELECT path, id, kind, title, status, superseded_by, array_to_string(tags, ',') AS tags, array_to_string(relates, ',') AS relates,
      length(regexp_replace(coalesce(body, ''), '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g'))::INTEGER AS chars, CASE WHEN coalesce(title, '') = '' THEN 'title' WHEN kind = 'person' THEN 'name' END AS error FROM notes""",
    "transcript_parse": "SELECT conv_id, turn AS line_no, role || ': ' || text AS line FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL",
    "staging_approve": f"""WITH {NOTES} SELECT id, CASE WHEN doc_id % 10 = 0 THEN 'canon' ELSE 'staged' END AS layer,
      CASE WHEN doc_id % 10 = 0 AND coalesce(source, '') <> '' THEN source || '/' ELSE '' END || path AS path FROM notes WHERE doc_id % 5 = 0""",
}
ORACLES["lexical_search_indexed"] = ORACLES["lexical_search"]
_changed = LEXICAL.replace("FROM notes\n", "FROM changed\n")
ORACLES["index_after_changes"] = f"""WITH {NOTES}, changed AS (
  SELECT * REPLACE (CASE WHEN doc_id % 10 = 1 THEN 'thor ' || title ELSE title END AS title) FROM notes WHERE doc_id % 7 <> 2 OR doc_id % 10 = 1
), {_changed} SELECT id, title, n_match::INTEGER AS n_match, round(score, 6) AS score FROM lexical ORDER BY {FRESH} LIMIT 20"""

#: A title as one line of markdown.
INLINE = r"substr(trim(regexp_replace(regexp_replace(regexp_replace({0}, '[\r\n]+', ' ', 'g'), '([\[\]`])', '\\\1', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')), 1, 200)"
_title = INLINE.format("coalesce(title, '')")
ORACLES["router_render"] = f"""WITH {NOTES}, {ALIAS}, s AS (SELECT source, min(project) AS p FROM (SELECT project, unnest(sources) AS source FROM alias_map) GROUP BY source),
of AS (SELECT n.*, coalesce(nullif(trim(coalesce(nullif(trim(project), ''), p, nullif(n.source, ''))), ''), '(unattributed)') AS label, coalesce(nullif(trim(n.source), ''), '(unattributed)') AS src FROM notes n LEFT JOIN s ON s.source = n.source),
several AS (SELECT label, count(DISTINCT src) > 1 AS several FROM of GROUP BY label),
live AS (
  SELECT label AS project, CASE WHEN several THEN src ELSE '' END AS source, CASE WHEN kind = 'decision' THEN 3 ELSE 2 END AS section, CASE WHEN kind = 'decision' THEN created END AS newest, id,
    '- [' || {_title} || '](' || path || ') — ' || coalesce(CASE WHEN kind = 'decision' THEN created ELSE status END, '') AS line
  FROM of JOIN several USING (label) WHERE (kind = 'work-state' AND status <> 'done') OR (kind = 'decision' AND NOT superseded)
), spots AS (SELECT DISTINCT label AS project, CASE WHEN several THEN src ELSE '' END AS source, section FROM of JOIN several USING (label), (VALUES (2), (3)) v(section))
SELECT project, source, section, row_number() OVER (PARTITION BY project, source, section ORDER BY newest DESC NULLS LAST, id, line) AS place, line FROM live
UNION ALL SELECT project, source, section, 0, CASE section WHEN 2 THEN '**Active work-state**' ELSE '**Recent decisions**' END FROM spots
UNION ALL SELECT project, source, section, 1, '- _None._' FROM spots ANTI JOIN live USING (project, source, section)
UNION ALL SELECT label, '', 0, 0, '## ' || {INLINE.format('label')} FROM several
UNION ALL SELECT DISTINCT label, src, 1, 0, '### ' || {INLINE.format('src')} FROM of JOIN several USING (label) WHERE several"""
