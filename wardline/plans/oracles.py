"""The same results in SQL, written apart from the operators.

Roles are derived in common table expressions; text rules are spelled out from the fixed
values, with plain look-around-free expressions where the dialect has none.
"""

from __future__ import annotations

from wardline.functions import patterns as P
from wardline.functions.injection import LAYER_SCORES
from wardline.operators.identity import ROLE_LEVELS
from wardline.operators.results import TTL_SECONDS
from wardline.functions.levels import ACCESS_RIGHTS, INJECTION_RISKS, SENSITIVITY_LEVELS
from wardline.plans import roles
from wardline.plans.seeds import SEEDS

ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "([" + ", ".join(text(v) for v in values) + "]::VARCHAR[])"


def levels(names) -> str:
    return texts(names)


# --- Common table expressions -----------------------------------------------------------

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(names, body: str) -> str:
    """Statement with the expressions it needs, each after those it needs itself."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for need in CTES[name][0]:
                add(need)
            ordered.append(name)

    for name in names:
        add(name)
    parts = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    return f"WITH {parts}\n{body}" if parts else body


def oracle(name: str, body: str, *needs: str) -> None:
    ORACLES[name] = with_ctes(needs, body)


def pairs(m: str) -> str:
    """String map, given as a list of key and value structs, as sorted text."""
    return (f"coalesce(array_to_string(list_transform(list_sort({m}), "
            "lambda e: e.k || '=' || e.v), ';'), '')")


AGENT_ROWS = ", ".join(
    f"({text(i)}, {c}, {texts(r)}, {texts(s)})" for i, _, c, r, s in roles.AGENTS)
cte("agents", "SELECT * FROM (VALUES " + AGENT_ROWS
    + ") t(agent_id, ceiling_rank, allowed_rights, allowed_sources)")
cte("assets", """
  SELECT replace(p_brand, '#', '_') AS asset_id, p_brand AS name,
    ['snowflake', 'delta_lake', 'postgres'][n % 3 + 1] AS source, 'parts.b' || n AS tab,
    n % 4 AS sensitivity_rank,
    CASE WHEN n % 6 = 0 THEN []::VARCHAR[] ELSE ['Brand_' || n, 'group_' || (n % 5)] END
      AS brand_tags,
    CASE WHEN n % 11 <> 0 THEN 'p_brand' END AS brand_column,
    CASE n % 8 WHEN 3 THEN 'p_owner = ''{user_id}'''
      WHEN 5 THEN 'p_scope IN ({brand_scope}) AND p_owner <> ''{user_id}'''
      WHEN 7 THEN 'p_region = ''{region}''' END AS row_filter_template,
    CASE WHEN n % 2 = 0 THEN ['p_name', 'p_retailprice'] ELSE []::VARCHAR[] END AS pii_columns,
    n % 7 = 0 AS consent_required
  FROM (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part)""")
cte("users", """
  SELECT 'user_' || c_custkey AS user_id, CAST(c_custkey % 5 AS INTEGER) AS clearance_rank,
    CASE WHEN c_nationkey % 5 = 0 THEN []::VARCHAR[]
      ELSE ['group_' || (c_nationkey % 5), 'Brand_' || (c_nationkey + 1)] END AS brand_scope
  FROM customer""")
cte("consent_events", """
  SELECT 'user_' || o_custkey AS subject_id, 'Brand_' || (1 + o_orderkey % 25) AS asset_id,
    o_orderstatus = 'F' AS granted, o_orderdate AS ts, o_orderkey AS seq FROM orders""")
cte("consent", """
  SELECT subject_id, asset_id, granted FROM consent_events
  QUALIFY row_number() OVER (PARTITION BY subject_id, asset_id ORDER BY ts DESC, seq DESC) = 1
  """, "consent_events")
cte("shipped", """
  SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, 'user_' || o_custkey AS subject_id,
    'Brand_' || (1 + o_orderkey % 25) AS asset_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
SESSION = "'user_' || (user_id * 11) || '_' || strftime(ts, '%Y%m%d')"
cte("requests", f"""
  SELECT event_id AS request_id, ts, {SESSION} AS session_id,
    'user_' || (user_id * 11) AS user_id, 'agent_' || (event_id % 9) AS agent_id,
    'Brand_' || (1 + (event_id // 9) % 26) AS asset_id,
    CASE event_type WHEN 'purchase' THEN 'aggregate' WHEN 'error' THEN 'write' ELSE 'read' END
      AS access_right FROM events""")
cte("eligibility_requests", """
  SELECT event_id AS request_id, 'user_' || (user_id * 11) AS user_id,
    'agent_' || (event_id % 9) AS agent_id, 'read' AS access_right,
    CASE WHEN event_type = 'error' THEN []::VARCHAR[] ELSE [
      'Brand_' || (1 + (event_id // 9) % 26), 'Brand_' || (1 + (event_id // 4) % 25)] END
      AS asset_ids FROM events""")
cte("token_requests", f"""
  SELECT event_id // 3 AS request_id, ts, {SESSION} AS session_id,
    'user_' || (user_id * 11) AS user_id, 'agent_' || ((event_id // 3) % 8) AS agent_id,
    'read' AS access_right, ['Brand_' || (1 + (event_id // 3) % 25)] AS asset_ids,
    'SELECT p_name FROM parts.b' || (1 + (event_id // 3) % 25) || ' WHERE p_size > '
      || ((event_id // 3) % 50) AS query
  FROM events
  QUALIFY row_number() OVER (PARTITION BY event_id // 3 ORDER BY event_id) = 1""")
cte("token_ids", """
  SELECT *, 'tok_' || substr(sha256('a secret of the test tables|' || request_id || '|' || session_id || '|' || user_id || '|'
    || agent_id), 1, 32) AS token_id FROM token_requests""", "token_requests")
cte("calls", """
  SELECT event_id AS call_id, e.ts,
    CASE WHEN event_type = 'signup' AND value > 70 THEN t.query || ' OR 1=1'
      WHEN event_type = 'click' THEN
        '  ' || replace(t.query, ' ', ' ' || chr(9) || ' ') || chr(10)
      ELSE t.query END AS query,
    CASE WHEN event_type = 'purchase' AND value > 70
      THEN 'agent_' || ((event_id // 3 + 1) % 8) ELSE 'agent_' || ((event_id // 3) % 8) END
      AS agent_id,
    CASE WHEN value >= 2.5 THEN t.token_id END AS token_id
  FROM events e JOIN token_ids t ON e.event_id // 3 = t.request_id""", "token_ids")
cte("revoked_sessions", f"""
  SELECT {SESSION} AS session_id, min(ts) AS at FROM events WHERE event_type = 'error'
  GROUP BY 1""")
cte("revoked_tokens", """
  SELECT t.token_id, min(e.ts) AS at FROM events e JOIN token_ids t
    ON e.event_id // 3 = t.request_id WHERE event_type = 'error' AND value > 100 GROUP BY 1
  """, "token_ids")

# Decisions, over rows named `r` with user, agent, asset and right.
OVERLAP = "list_has_any(a.brand_tags, u.brand_scope)"
REASON = f"""CASE
    WHEN a.asset_id IS NULL THEN 'ASSET_NOT_FOUND'
    WHEN g.agent_id IS NULL THEN 'AGENT_UNKNOWN'
    WHEN u.user_id IS NULL THEN 'USER_UNKNOWN'
    WHEN a.sensitivity_rank > g.ceiling_rank THEN 'AGENT_CEILING'
    WHEN a.sensitivity_rank > u.clearance_rank THEN 'USER_CLEARANCE'
    WHEN NOT list_contains(g.allowed_rights, r.access_right) THEN 'RIGHT_NOT_ALLOWED'
    WHEN len(a.brand_tags) > 0 AND len(u.brand_scope) = 0 THEN 'BRAND_SCOPE_EMPTY'
    WHEN len(a.brand_tags) > 0 AND NOT {OVERLAP} THEN 'BRAND_SCOPE_MISMATCH'
    WHEN len(g.allowed_sources) > 0 AND NOT list_contains(g.allowed_sources, a.source)
      THEN 'SOURCE_NOT_ALLOWED'
    WHEN a.consent_required AND NOT coalesce(c.granted, false) THEN 'CONSENT_BLOCKED'
    ELSE 'ALLOWED' END"""
JOINS = """LEFT JOIN agents g ON r.agent_id = g.agent_id
  LEFT JOIN users u ON r.user_id = u.user_id
  LEFT JOIN assets a ON r.asset_id = a.asset_id
  LEFT JOIN consent c ON c.subject_id = r.user_id AND c.asset_id = r.asset_id"""
POLICY = ("agents", "users", "assets", "consent")
BRANDS = "list_filter(a.brand_tags, lambda b: list_contains(u.brand_scope, b))"
BRAND_FILTER = (f"CASE WHEN len({BRANDS}) > 0 THEN a.brand_column || ' IN (''' || "
                f"array_to_string({BRANDS}, ''', ''') || ''')' END")
BAD_TEMPLATE = ("regexp_matches(regexp_replace(a.row_filter_template, "
                "'\\{(user_id|brand_scope)\\}', '', 'g'), '[{}]')")
SCOPE = ("CASE WHEN len(u.brand_scope) > 0 THEN '''' || array_to_string(u.brand_scope, ''',''') "
         "|| '''' ELSE '' END")
TEMPLATE = (f"CASE WHEN NOT {BAD_TEMPLATE} THEN replace(replace(a.row_filter_template, "
            f"'{{user_id}}', r.user_id), '{{brand_scope}}', {SCOPE}) END")
MASK = "CASE WHEN u.clearance_rank >= 3 THEN []::VARCHAR[] ELSE a.pii_columns END"
SAFE = "regexp_full_match({}, '[A-Za-z0-9_.-]{{1,128}}')"
FILTER_ERROR = (f"CASE WHEN {BAD_TEMPLATE} THEN 'TEMPLATE_UNKNOWN_PLACEHOLDER' "
                f"WHEN len({BRANDS}) > 0 AND a.brand_column IS NULL "
                "THEN 'MISSING_BRAND_COLUMN' "
                f"WHEN NOT ({SAFE.format('r.user_id')}) OR len(list_filter(list_concat("
                f"u.brand_scope, a.brand_tags), lambda x: NOT ({SAFE.format('x')}))) > 0 "
                "THEN 'UNSAFE_IDENTIFIER' END")
ROW_FILTER = (f"CASE WHEN {BRAND_FILTER} IS NOT NULL AND {TEMPLATE} IS NOT NULL THEN '(' || "
              f"{BRAND_FILTER} || ') AND (' || {TEMPLATE} || ')' "
              f"ELSE '(' || coalesce({BRAND_FILTER}, {TEMPLATE}) || ')' END")

#: What is decided, less what a filter that cannot be built denies.
DECIDED = (f"CASE WHEN {REASON} = 'ALLOWED' AND {FILTER_ERROR} IS NOT NULL THEN {FILTER_ERROR} "
           f"ELSE {REASON} END")
cte("decisions", f"SELECT r.*, {DECIDED} AS reason_code FROM requests r {JOINS}",
    "requests", *POLICY)

# --- Governed reads ---------------------------------------------------------------------

oracle("governed_brand_rows", """
SELECT p_brand, count(*) AS n_parts, CAST(sum(p_size) AS BIGINT) AS sum_size FROM part
WHERE p_brand IN ('Brand#3', 'Brand#7', 'Brand#12') GROUP BY p_brand""")
oracle("governed_or_bypass", """
SELECT p_partkey, p_brand, p_size FROM part
WHERE p_brand IN ('Brand#3', 'Brand#7', 'Brand#12')""")
oracle("masked_projection", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
oracle("multi_user_extract", """
SELECT 'auditor_' || n_nationkey AS user_id, l_orderkey, l_linenumber,
  CASE WHEN n_nationkey % 5 >= 3 THEN l_extendedprice END AS l_extendedprice,
  replace(p_brand, '#', '_') AS brand
FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN nation ON list_contains(['Brand_' || (1 + n_nationkey),
  'Brand_' || (1 + (n_nationkey + 9) % 25)], replace(p_brand, '#', '_'))""")

# --- Policy tables ----------------------------------------------------------------------

oracle("asset_lookup", """
SELECT request_id, r.asset_id, source, tab AS "table",
  CASE WHEN a.asset_id IS NULL THEN 'ASSET_NOT_FOUND' ELSE 'FOUND' END AS asset_status
FROM requests r LEFT JOIN assets a ON r.asset_id = a.asset_id""", "requests", "assets")
oracle("assets_by_source", """
SELECT asset_id, tab AS "table", sensitivity_rank FROM assets WHERE source = 'snowflake'""",
       "assets")
oracle("assets_by_table", "SELECT asset_id, source FROM assets WHERE tab = 'parts.b7'", "assets")
oracle("asset_list", """
SELECT source, count(*) AS n_assets, max(sensitivity_rank) AS max_rank FROM assets
GROUP BY source""", "assets")
oracle("asset_latest", """
SELECT replace(p_brand, '#', '_') AS asset_id, p_type, p_size, p_partkey AS seq FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1""")
oracle("agent_latest", """
SELECT 'agent_' || (event_id % 9) AS agent_id, event_type AS agent_type,
  CAST(user_id % 5 AS INTEGER) AS ceiling_rank, event_id AS seq FROM events
QUALIFY row_number() OVER (PARTITION BY event_id % 9 ORDER BY event_id DESC) = 1""")
oracle("consent_latest", "SELECT subject_id, asset_id, granted FROM consent", "consent")
oracle("consent_as_of", """
SELECT subject_id, consented, count(*) AS n_rows, CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM (SELECT s.subject_id, s.l_quantity, coalesce((
    SELECT arg_max(e.granted, (e.ts, e.seq)) FROM consent_events e
    WHERE e.subject_id = s.subject_id AND e.asset_id = s.asset_id AND e.ts <= s.l_shipdate),
    false) AS consented FROM shipped s)
GROUP BY subject_id, consented""", "shipped", "consent_events")
oracle("consented_rows", """
SELECT l_orderkey, l_linenumber, s.subject_id, s.asset_id, l_quantity FROM shipped s
JOIN consent c ON s.subject_id = c.subject_id AND s.asset_id = c.asset_id WHERE c.granted""",
       "shipped", "consent")
LANES = ", ".join(
    f"sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)) AS lane{i}" for i in range(4))
ASSET_JSON = """to_json({kind: 'asset', asset_id: asset_id, name: name, source: source, "table": tab,
    columns: ['p_partkey', 'p_name', 'p_brand', 'p_size', 'p_retailprice'],
    sensitivity_rank: sensitivity_rank, required_rights: ['read'], brand_tags: brand_tags,
    brand_column: brand_column, row_filter_template: row_filter_template,
    pii_columns: pii_columns, consent_required: consent_required, owner: 'parts_domain',
    tags: {brand: name}})"""
CONSENT_JSON = ("to_json({kind: 'consent', subject_id: subject_id, asset_id: asset_id, "
                "granted: granted})")


def version_of(n: str, lanes) -> str:
    return ("'v:' || substr(sha256(" + " || '|' || ".join(
        f"CAST({x} AS VARCHAR)" for x in (n, *lanes)) + "), 1, 16)")


cte("asset_sums", f"""
  SELECT count(*) AS n_lines, {LANES} FROM (SELECT sha256({ASSET_JSON}) AS h FROM assets)""",
    "assets")
RUN = "OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"
cte("timeline", f"""
  SELECT ts, seq, {version_of(f"(SELECT n_lines FROM asset_sums) + sum(fresh) {RUN}", [
      f"(SELECT lane{i} FROM asset_sums) + sum(d{i}) {RUN}" for i in range(4)])} AS version_id
  FROM (SELECT *, CASE WHEN before IS NULL THEN 1 ELSE 0 END AS fresh, {", ".join(
      f"CAST(('0x' || substr(sha256(line), {1 + 15 * i}, 15)) AS HUGEINT) - coalesce(CAST(('0x' || "
      f"substr(sha256(before), {1 + 15 * i}, 15)) AS HUGEINT), 0) AS d{i}" for i in range(4))}
    FROM (SELECT *, lag(line) OVER (PARTITION BY subject_id, asset_id ORDER BY ts, seq) AS before
      FROM (SELECT *, {CONSENT_JSON} AS line FROM (
        SELECT 'user_' || (user_id * 11) AS subject_id, 'Brand_' || (1 + event_id % 3) AS asset_id,
          event_id % 2 = 0 AS granted, ts, event_id AS seq
        FROM events WHERE event_type = 'signup'))))""", "asset_sums")
oracle("policy_version", f"""
SELECT {version_of("n_lines", [f"lane{i}" for i in range(4)])} AS version_id, n_lines
FROM (SELECT count(*) AS n_lines, {LANES} FROM (
  SELECT sha256({ASSET_JSON}) AS h FROM assets UNION ALL
  SELECT sha256({CONSENT_JSON}) FROM consent))""", "assets", "consent")
oracle("policy_timeline", "SELECT ts, seq, version_id FROM timeline", "timeline")
oracle("unsafe_identifiers", """
SELECT p_partkey, p_brand AS brand, 'UNSAFE_IDENTIFIER' AS reason_code FROM part
WHERE NOT regexp_full_match(p_brand, '[A-Za-z0-9_.-]{1,128}')
  OR NOT regexp_full_match(p_type, '[A-Za-z0-9_.-]{1,128}')""")

# --- Access decisions -------------------------------------------------------------------

oracle("access_decisions", """
SELECT request_id, user_id, agent_id, asset_id, access_right, reason_code,
  reason_code = 'ALLOWED' AS allowed FROM decisions""", "decisions")
oracle("decision_matrix_rollup", f"""
SELECT agent_id, reason_code, count(*) AS n_decisions FROM (
  SELECT r.agent_id, {DECIDED} AS reason_code FROM (
    SELECT u.user_id, g.agent_id, a.asset_id, access_right FROM users u, agents g, assets a,
      (SELECT unnest({texts(ACCESS_RIGHTS)}) AS access_right)) r {JOINS})
GROUP BY ROLLUP (agent_id, reason_code)""", *POLICY)
KNOWN = "WHERE a.asset_id IS NOT NULL AND u.user_id IS NOT NULL"
oracle("row_filters", f"""
SELECT request_id, r.user_id, r.asset_id, {BRAND_FILTER} AS brand_filter,
  CASE WHEN len({BRANDS}) = 0 THEN 'NONE' WHEN a.brand_column IS NULL
    THEN 'MISSING_BRAND_COLUMN' ELSE 'RESTRICTED' END AS status
FROM requests r {JOINS} {KNOWN}""", "requests", *POLICY)
oracle("row_filter_template", f"""
SELECT request_id, r.asset_id, {TEMPLATE} AS template_filter,
  CASE WHEN {BAD_TEMPLATE} THEN 'TEMPLATE_UNKNOWN_PLACEHOLDER' END AS reason_code
FROM requests r {JOINS} {KNOWN} AND a.row_filter_template IS NOT NULL""", "requests", *POLICY)
oracle("column_masks", f"""
SELECT request_id, r.user_id, r.asset_id, array_to_string({MASK}, ',') AS masked
FROM requests r {JOINS} {KNOWN}""", "requests", *POLICY)

# --- Eligibility ------------------------------------------------------------------------


def eligibility(source: str, keys: str) -> str:
    return f"""
  SELECT {keys}, user_id, agent_id, early, list_filter(list(struct_pack(pos := pos,
      asset_id := asset_id, code := code, f := f) ORDER BY pos), lambda x: x.pos IS NOT NULL)
      AS items
  FROM (
    SELECT r.*, CASE WHEN f.e IS NOT NULL AND f.c = 'ALLOWED' THEN f.e ELSE f.c END AS code, f.f
    FROM (SELECT q.*, CASE WHEN g.agent_id IS NULL THEN 'AGENT_NOT_REGISTERED'
            WHEN u.user_id IS NULL THEN 'USER_UNKNOWN'
            WHEN u.clearance_rank < g.ceiling_rank THEN 'USER_BELOW_AGENT' END AS early,
            CASE WHEN early IS NULL THEN p.pos END AS pos,
            CASE WHEN early IS NULL THEN q.asset_ids[p.pos] END AS asset_id
          FROM {source} q LEFT JOIN agents g ON q.agent_id = g.agent_id
          LEFT JOIN users u ON q.user_id = u.user_id
          LEFT JOIN (SELECT unnest([1, 2]) AS pos) p ON p.pos <= len(q.asset_ids)) r,
    LATERAL (SELECT {REASON} AS c, {FILTER_ERROR} AS e, {ROW_FILTER} AS f
             FROM (SELECT 1) one {JOINS}) f)
  GROUP BY ALL"""


ITEM_COLUMNS = """
  list_filter(items, lambda x: x.code = 'ALLOWED') AS ok,
  list_filter(items, lambda x: x.code <> 'ALLOWED') AS bad,
  CASE WHEN early IS NOT NULL THEN early WHEN len(bad) > 0 AND len(ok) = 0 THEN 'ALL_DENIED'
    WHEN len(bad) > 0 THEN 'PARTIAL' ELSE 'ALL_PASSED' END AS outcome,
  CASE WHEN outcome = 'AGENT_NOT_REGISTERED' THEN 'blocked'
    WHEN outcome IN ('ALL_PASSED', 'PARTIAL') THEN 'eligible' ELSE 'ineligible' END AS status"""
ALLOWED_IDS = "coalesce(array_to_string(list_transform(ok, lambda x: x.asset_id), ','), '')"
cte("eligibility_items", eligibility("eligibility_requests", "request_id"),
    "eligibility_requests", *POLICY)
cte("eligibility", f"SELECT *, {ITEM_COLUMNS} FROM eligibility_items", "eligibility_items")
FILTERS = pairs("list_distinct(list_transform(list_filter(ok, lambda x: x.f IS NOT NULL), "
                "lambda x: struct_pack(k := x.asset_id, v := x.f)))")
oracle("eligibility", f"""
SELECT request_id, user_id, agent_id, status, outcome,
  coalesce(array_to_string(list_transform(bad, lambda x: x.asset_id || ':' || x.code), ','), '')
    AS reason_codes,
  {ALLOWED_IDS} AS allowed_asset_ids, {FILTERS} AS applied_filters FROM eligibility""",
       "eligibility")
oracle("gate_split", """
SELECT agent_id, status, outcome, count(*) AS n_requests,
  CASE WHEN status = 'eligible' THEN 'run' ELSE 'stop' END AS side
FROM eligibility GROUP BY agent_id, status, outcome""", "eligibility")
cte("session_agents", f"""
  SELECT s.*, g.agent_id FROM (
    SELECT {SESSION} AS session_id, 'user_' || (user_id * 11) AS user_id,
      'read' AS access_right, ['Brand_' || (1 + count(*) % 25), 'Brand_6'] AS asset_ids
    FROM events GROUP BY 1, 2) s, agents g""", "agents")
cte("session_items", eligibility("session_agents", "session_id"), "session_agents", *POLICY)
oracle("eligible_agents", f"""
SELECT session_id, agent_id, outcome, {ALLOWED_IDS} AS allowed_asset_ids
FROM (SELECT *, {ITEM_COLUMNS} FROM session_items) WHERE status = 'eligible'""", "session_items")

# --- Tokens and calls -------------------------------------------------------------------

CANONICAL = "regexp_replace(regexp_replace(query, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
HASH = f"'sha256:' || sha256({CANONICAL})"
oracle("query_hash", f"""
SELECT call_id, {CANONICAL} AS canonical, {HASH} AS query_hash FROM calls""", "calls")
cte("token_decisions", f"""
  SELECT r.*, {REASON} AS decided, {FILTER_ERROR} AS e, {ROW_FILTER} AS f, {MASK} AS m,
    CASE WHEN decided = 'ALLOWED' AND e IS NOT NULL THEN e ELSE decided END AS code,
    coalesce((SELECT arg_max(version_id, (t.ts, t.seq)) FROM timeline t WHERE t.ts <= r.ts),
      'v:0') AS policy_version
  FROM (SELECT *, asset_ids[1] AS asset_id FROM token_ids) r {JOINS}""",
    "token_ids", "timeline", *POLICY)
cte("ledger", f"""
  SELECT token_id, {HASH} AS query_hash, substr(query, 1, 120) AS query_preview, user_id,
    agent_id, session_id, policy_version, ts AS issued_at,
    ts + INTERVAL 600 SECONDS AS expires_at,
    CASE WHEN f IS NULL THEN '' ELSE asset_id || '=' || f END AS row_filters,
    CASE WHEN len(m) = 0 THEN '' ELSE asset_id || '=' || array_to_string(m, ',') END
      AS masked_columns, asset_id AS asset_ids
  FROM token_decisions WHERE code = 'ALLOWED'""", "token_decisions")
oracle("token_issue", "SELECT * FROM ledger", "ledger")
oracle("token_rejected", """
SELECT request_id, user_id, agent_id, asset_id, code AS reason_code FROM token_decisions
WHERE code <> 'ALLOWED'""", "token_decisions")


def verdicts(missing: str) -> str:
    return f"""
  SELECT c.call_id, c.ts, c.agent_id, c.token_id, l.policy_version, l.row_filters,
    l.masked_columns, CASE WHEN c.token_id IS NULL THEN '{missing}'
      WHEN l.token_id IS NULL THEN 'TOKEN_UNKNOWN'
      WHEN c.ts >= l.expires_at THEN 'TOKEN_EXPIRED'
      WHEN c.ts < l.issued_at THEN 'TOKEN_NOT_YET_VALID'
      WHEN rt.at <= c.ts THEN 'TOKEN_REVOKED'
      WHEN rs.at <= c.ts THEN 'SESSION_REVOKED'
      WHEN c.agent_id <> l.agent_id THEN 'WRONG_AGENT'
      WHEN {HASH.replace('query', 'c.query')} <> l.query_hash THEN 'QUERY_MISMATCH'
      ELSE 'ALLOWED' END AS chk,
    CASE WHEN chk = 'ALLOWED' AND row_number() OVER (
      PARTITION BY c.token_id, chk ORDER BY c.ts, c.call_id) > 1 THEN 'REPLAYED' ELSE chk END
      AS verdict
  FROM calls c LEFT JOIN ledger l ON c.token_id = l.token_id
  LEFT JOIN revoked_tokens rt ON rt.token_id = c.token_id
  LEFT JOIN revoked_sessions rs ON rs.session_id = l.session_id"""


CALLS = ("calls", "ledger", "revoked_tokens", "revoked_sessions")
cte("verdicts", verdicts("UNGOVERNED"), *CALLS)
cte("lenient_verdicts", verdicts("ALLOWED_UNGOVERNED"), *CALLS)
oracle("token_verdicts", "SELECT call_id, agent_id, token_id, verdict FROM verdicts", "verdicts")
for _same in ("token_verdicts_bucketed", "live_verdicts", "live_revocations"):
    oracle(_same, "SELECT call_id, agent_id, token_id, verdict FROM verdicts", "verdicts")
oracle("governed_call_rows", """
SELECT call_id, p_partkey, brand AS p_brand, p_size
FROM (SELECT call_id, row_filters FROM verdicts WHERE verdict = 'ALLOWED'
    AND contains(row_filters, 'p_brand IN') AND NOT regexp_matches(row_filters, 'p_owner|p_scope')) c
JOIN (SELECT *, replace(p_brand, '#', '_') AS brand FROM part) p
  ON contains(c.row_filters, chr(39) || brand || chr(39))""", "verdicts")
cte("call_reads", """
  SELECT v.call_id, l.asset_ids AS asset_id, l.row_filters, l.masked_columns,
    sha256(l.asset_ids || '|' || substr(l.row_filters, CASE WHEN l.row_filters = '' THEN 1
      ELSE length(l.asset_ids) + 2 END) || '|' || substr(l.masked_columns,
      CASE WHEN l.masked_columns = '' THEN 1 ELSE length(l.asset_ids) + 2 END)) AS read_id,
    NOT regexp_matches(l.row_filters, 'p_owner|p_scope') AS readable
  FROM verdicts v JOIN ledger l ON v.token_id = l.token_id WHERE v.verdict = 'ALLOWED'""",
    "verdicts", "ledger")
oracle("governed_calls", "SELECT call_id, asset_id, read_id, readable FROM call_reads",
       "call_reads")
oracle("governed_read_rows", """
SELECT read_id, p_partkey,
  CASE WHEN NOT contains(masked_columns, 'p_name') THEN p_name END AS p_name, brand AS p_brand,
  p_size, CASE WHEN NOT contains(masked_columns, 'p_retailprice') THEN p_retailprice END
    AS p_retailprice
FROM (SELECT DISTINCT read_id, row_filters, masked_columns, readable FROM call_reads) r
JOIN (SELECT *, replace(p_brand, '#', '_') AS brand FROM part) p
  ON readable AND (row_filters = '' OR contains(row_filters, chr(39) || brand || chr(39)))""",
       "call_reads")
oracle("replay_first_use", """
SELECT token_id, call_id, ts FROM verdicts WHERE verdict = 'ALLOWED'""", "verdicts")
oracle("ungoverned_calls", """
SELECT verdict, count(*) AS n_calls FROM lenient_verdicts GROUP BY verdict""",
       "lenient_verdicts")
oracle("call_results", """
SELECT call_id, verdict = 'ALLOWED' AS success,
  CASE WHEN verdict <> 'ALLOWED' THEN verdict END AS error,
  CASE WHEN verdict = 'ALLOWED' THEN row_filters ELSE '' END AS filters_applied,
  CASE WHEN verdict = 'ALLOWED' THEN masked_columns ELSE '' END AS masked_columns,
  CASE WHEN verdict = 'ALLOWED' THEN token_id END AS token_id,
  verdict <> 'UNGOVERNED' AS governed FROM verdicts""", "verdicts")
oracle("stale_policy", """
SELECT call_id, policy_version, version_in_force,
  CASE WHEN policy_version IS NOT NULL THEN policy_version <> version_in_force END
    AS policy_stale
FROM (SELECT v.*, coalesce((SELECT arg_max(version_id, (t.ts, t.seq)) FROM timeline t
        WHERE t.ts <= v.ts), 'v:0') AS version_in_force FROM verdicts v)""",
       "verdicts", "timeline")

# --- Text -------------------------------------------------------------------------------

SEED = "[" + ", ".join(text(s) for s in SEEDS) + "]"


def seeded(number: str) -> str:
    return (f"CASE WHEN {number} % 40 < {len(SEEDS)} "
            f"THEN text || ' ' || {SEED}[CAST({number} % 40 AS INTEGER) + 1] ELSE text END")


cte("docs", f"SELECT * REPLACE ({seeded('doc_id')} AS text) FROM documents")
cte("turns", f"SELECT * REPLACE ({seeded('(conv_id + turn)')} AS text) FROM conversations")


def occurs(p: P.Pattern, t: str) -> str:
    """Whether a pattern occurs in the text `t`."""
    flag = "(?i)" if p.ignore_case else ""
    if p.name == "vin":
        return (f"len(list_filter(regexp_extract_all({t}, {text(p.regex)}), lambda m: "
                "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]'))) > 0")
    if p.name == "you_are_now":
        return (f"regexp_matches(regexp_replace({t}, '(?i)you\\s+are\\s+now\\shelpful', '#', "
                "'g'), '(?i)you\\s+are\\s+now\\s')")
    if p.name == "act_as":
        return (f"regexp_matches(regexp_replace({t}, '(?i)act\\s+as\\s(helpful|an AI)', '#', "
                "'g'), '(?i)act\\s+as\\s')")
    return f"regexp_matches({t}, {text(flag + p.regex)})"


def kinds(t: str) -> str:
    return "list_filter([" + ", ".join(
        f"CASE WHEN {occurs(p, t)} THEN {text(p.name)} END" for p in P.PII_PATTERNS
    ) + "], lambda k: k IS NOT NULL)"


def rank(t: str, found: str) -> str:
    def words(ws) -> str:
        return " OR ".join(f"contains(lower({t}), {text(w)})" for w in ws)
    return (f"CASE WHEN len(list_intersect({found}, {texts(P.RESTRICTED_PII)})) > 0 "
            f"OR {words(P.RESTRICTED_KEYWORDS)} THEN 3 WHEN len({found}) > 0 "
            f"OR {words(P.CONFIDENTIAL_KEYWORDS)} OR {occurs(P.CURRENCY, t)} THEN 2 ELSE 1 END")


def redact(t: str) -> str:
    for p in P.PII_PATTERNS:
        flag = "(?i)" if p.ignore_case else ""
        t = (f"regexp_replace({t}, {text(flag + p.regex)}, '[REDACTED:{p.name.upper()}]', 'g')")
    return t


CHUNKS = ("CASE WHEN length(text) = 0 THEN []::VARCHAR[] WHEN length(text) <= 500 THEN [text] "
          "ELSE list_transform(range(0, CAST(ceil((length(text) - 500) / 436.0) AS BIGINT) + 1), "
          "lambda k: substring(text, k * 436 + 1, 500)) END")
oracle("chunk_text", f"""
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS chunk_no, chunks[pos] AS chunk
FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS pos
      FROM (SELECT doc_id, {CHUNKS} AS chunks FROM docs))""", "docs")
oracle("classify_text", f"""
SELECT doc_id, source, {rank('text', 'found')} AS sensitivity_rank, len(found) > 0 AS pii_detected
FROM (SELECT *, {kinds('text')} AS found FROM docs)""", "docs")
oracle("pii_kinds", f"""
SELECT lang, source, kind, count(*) AS n_docs
FROM (SELECT lang, source, unnest({kinds('text')}) AS kind FROM docs)
GROUP BY lang, source, kind""", "docs")
BRAND_LIST = "list_filter(" + texts(P.KNOWN_BRANDS) + ", lambda b: contains(lower({t}), b))"
oracle("brand_mentions", f"""
SELECT conv_id, turn, array_to_string({BRAND_LIST.format(t='t')}, ',') AS brands
FROM (SELECT conv_id, turn, text || ' ' || coalesce(['Brand_A', 'brand_c and BRAND_b',
  'CORP_BRAND'][CAST(turn % 5 AS INTEGER) + 1], '') AS t FROM turns)""", "turns")
oracle("redact_text", f"SELECT doc_id, {redact('text')} AS redacted FROM docs", "docs")




def claimed() -> str:
    """Documents whose personal data is replaced by private characters of the same number."""
    t = "SELECT doc_id, text AS t FROM docs"
    for i, p in enumerate(P.PII_PATTERNS):
        regex = text(("(?i)" if p.ignore_case else "") + p.regex)
        first, more = text(chr(0xE000 + 2 * i)), text(chr(0xE001 + 2 * i))
        t = f"""SELECT doc_id, array_to_string(list_transform(range(1, len(pieces) + 1),
          lambda k: pieces[k] || CASE WHEN k <= len(found) THEN {first}
            || repeat({more}, length(found[k]) - 1) ELSE '' END), '') AS t
        FROM (SELECT doc_id, regexp_extract_all(t, {regex}) AS found,
          string_split(regexp_replace(t, {regex}, chr(61440), 'g'), chr(61440)) AS pieces
          FROM ({t}))"""
    return t


FIRSTS = "".join(chr(0xE000 + 2 * i) for i in range(len(P.PII_PATTERNS)))
MORES = "".join(chr(0xE001 + 2 * i) for i in range(len(P.PII_PATTERNS)))
oracle("pii_spans", f"""
SELECT doc_id, {texts([p.name for p in P.PII_PATTERNS])}[(unicode(run) - 57344) // 2 + 1] AS kind,
  CAST(ends_at - length(run) AS BIGINT) AS starts_at, CAST(ends_at AS BIGINT) AS ends_at
FROM (SELECT doc_id, run, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY pos) AS ends_at
  FROM (SELECT doc_id, runs[pos] AS run, pos FROM (
    SELECT doc_id, runs, unnest(range(1, len(runs) + 1)) AS pos FROM (
      SELECT doc_id, regexp_extract_all(t, '[{FIRSTS}][{MORES}]*|[^{FIRSTS}{MORES}]+') AS runs
      FROM ({claimed()})))))
WHERE unicode(run) BETWEEN 57344 AND 57344 + {2 * len(P.PII_PATTERNS) - 1}""", "docs")


def governed(source: str, keys: str, ceiling: str) -> str:
    """Chunks of a table, each with its class, its cleaned text and the class of that."""
    return f"""
  SELECT *, {rank('clean', 'clean_found')} AS clean_rank FROM (
    SELECT *, {rank('chunk', 'found')} AS rank, {redact('chunk')} AS clean,
      {kinds('clean')} AS clean_found FROM (
      SELECT *, {kinds('chunk')} AS found FROM (
        SELECT {keys}, {ceiling} AS ceiling, chunks[pos] AS chunk, pos FROM (
          SELECT *, unnest(CASE WHEN len(chunks) = 0 THEN [NULL] ELSE range(1, len(chunks) + 1)
            END) AS pos FROM (SELECT *, {CHUNKS} AS chunks FROM {source})))))"""


SAFE = f"""CASE WHEN rank <= ceiling THEN chunk WHEN len(found) > 0 AND clean_rank <= ceiling
    THEN clean ELSE {text(P.WITHHELD)} END"""
cte("turn_chunks", governed("turns", "conv_id, turn", "CAST((conv_id + turn) % 4 AS INTEGER)"),
    "turns")
cte("doc_chunks", governed("docs", "doc_id", "1"), "docs")
TRANSFER = f"""
  CAST(count_if(rank > ceiling AND pos IS NOT NULL) AS INTEGER) AS redaction_count,
  CAST(count(pos) AS INTEGER) AS n_chunks,
  coalesce(max(CASE WHEN pos IS NOT NULL THEN rank END), 0) AS max_rank_seen,
  coalesce(string_agg({SAFE}, chr(10) ORDER BY pos), '') AS safe_text"""
oracle("govern_redact", f"""
SELECT conv_id, turn, {TRANSFER} FROM turn_chunks GROUP BY conv_id, turn""", "turn_chunks")
oracle("govern_documents", f"""
SELECT doc_id, redaction_count, n_chunks, max_rank_seen, sha256(safe_text) AS safe_hash
FROM (SELECT doc_id, {TRANSFER} FROM doc_chunks GROUP BY doc_id)""", "doc_chunks")
oracle("govern_block", """
SELECT conv_id, turn, max(rank) > max(ceiling) AS blocked,
  CASE WHEN max(rank) > max(ceiling) THEN ''
    ELSE coalesce(string_agg(chunk, chr(10) ORDER BY pos), '') END AS safe_text
FROM turn_chunks GROUP BY conv_id, turn""", "turn_chunks")
oracle("govern_audit", """
SELECT conv_id, turn, CAST(pos - 1 AS INTEGER) AS chunk_no, rank AS sensitivity_rank,
  len(found) > 0 AS pii_detected, ceiling AS ceiling_rank
FROM turn_chunks WHERE rank > ceiling""", "turn_chunks")
cte("event_json", """
  SELECT event_id, to_json(struct_pack(event_type := event_type, user_id := user_id,
    props := props))::VARCHAR AS text FROM events""")
cte("json_chunks", governed("event_json", "event_id", "1"), "event_json")
oracle("govern_json", f"""
SELECT event_id, redaction_count, max_rank_seen, safe_text
FROM (SELECT event_id, {TRANSFER} FROM json_chunks GROUP BY event_id)""", "json_chunks")


def cell(column: str) -> str:
    found = kinds(column)
    return (f"CASE WHEN {column} IS NULL OR {rank(column, found)} <= 2 THEN {column} "
            f"WHEN len({found}) > 0 THEN '{P.CELL_PII}' ELSE '{P.CELL_ABOVE_CLEARANCE}' END "
            f"AS {column}")


oracle("govern_rows", f"""
SELECT o_orderkey, {cell('o_custkey')}, {cell('o_orderstatus')}, {cell('ordered_on')},
  '{P.MASKED}' AS c_name, {cell('c_mktsegment')}
FROM (SELECT o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus,
        strftime(o_orderdate, '%Y-%m-%d') AS ordered_on, c_mktsegment
      FROM orders JOIN customer ON o_custkey = c_custkey)""")
oracle("column_profile", "\nUNION ALL ".join(f"""
SELECT '{c}' AS column_name, max({rank('v', 'found')}) AS max_rank,
  count_if(len(found) > 0)::BIGINT AS pii_cells, count(v) AS cells
FROM (SELECT v, {kinds('v')} AS found FROM (SELECT {c}::VARCHAR AS v FROM docs))"""
    for c in ("doc_id", "text", "lang", "source")), "docs")

# --- Injection --------------------------------------------------------------------------


def triggered(t: str) -> str:
    return "list_filter([" + ", ".join(
        f"CASE WHEN {occurs(p, t)} THEN '{layer}:{p.name}' END"
        for layer, ps in P.INJECTION_PATTERNS.items() for p in ps
    ) + "], lambda k: k IS NOT NULL)"


def layer_score(slot: int, nothing: str) -> str:
    return "greatest(" + ", ".join(
        f"CASE WHEN len(list_filter(hits, lambda h: starts_with(h, '{layer}:'))) >= 2 "
        f"THEN {two[slot]} WHEN len(list_filter(hits, lambda h: starts_with(h, '{layer}:'))) = 1 "
        f"THEN {one[slot]} ELSE {nothing} END" for layer, (one, two) in LAYER_SCORES.items()) + ")"


def screened(source: str, t: str = "text") -> str:
    return f"""SELECT *, {layer_score(0, '0')} AS risk_rank,
    {texts(INJECTION_RISKS)}[risk_rank + 1] AS risk,
    CASE WHEN len(hits) = 0 THEN 0.95::DOUBLE ELSE ({layer_score(1, '0.0')})::DOUBLE END
      AS confidence FROM (SELECT *, {triggered(t)} AS hits FROM {source})"""


cte("screened_docs", screened("docs"), "docs")
cte("screened_turns", screened("turns"), "turns")
oracle("injection_assess", """
SELECT doc_id, risk, confidence, array_to_string(hits, ',') AS triggered,
  CASE WHEN len(hits) = 0 THEN 'Nothing suspicious was found.' ELSE 'Risk of injection is ' || risk
    || ': it matches [' || array_to_string(hits[1:5], ', ')
    || CASE WHEN len(hits) > 5 THEN ' (+' || (len(hits) - 5) || ' more)' ELSE '' END
    || '] and may steer an agent.' END AS explanation,
  risk_rank >= 3 AS should_block FROM screened_docs""", "screened_docs")
oracle("injection_split", """
SELECT conv_id, turn, role, CASE WHEN risk_rank >= 3 THEN 'quarantine' ELSE 'clean' END AS side
FROM screened_turns""", "screened_turns")
cte("cells", """
  SELECT page_id, 'url' AS field, url AS v FROM pages UNION ALL
  SELECT page_id, 'html', html FROM pages""")
cte("screened_cells", screened("(SELECT * FROM cells WHERE length(v) > 10)", "v"), "cells")
oracle("injection_scan_rows", """
SELECT page_id, field, risk, array_to_string(hits, ',') AS triggered FROM screened_cells
WHERE risk_rank > 0""", "screened_cells")
cte("free_fields", """
  SELECT conv_id, turn, CAST((conv_id + turn) % 4 AS INTEGER) AS ceiling, path, v FROM (
    SELECT *, coalesce(role, '') || '_says' AS path, coalesce(text, '') AS v FROM turns
      WHERE turn % 3 = 0 UNION ALL
    SELECT *, 'role', coalesce(role, '') FROM turns WHERE turn % 3 = 0 UNION ALL
    SELECT *, 'turn.no', turn::VARCHAR FROM turns WHERE turn % 3 = 1 UNION ALL
    SELECT *, 'turn.parts[0]', coalesce(text, '') FROM turns WHERE turn % 3 = 1 UNION ALL
    SELECT *, 'turn.parts[1]', coalesce(role, '') FROM turns WHERE turn % 3 = 1 UNION ALL
    SELECT *, '[''a.b''].text', coalesce(text, '') FROM turns
      WHERE coalesce(turn % 3, 2) = 2)""", "turns")
oracle("free_row_fields", f"""
SELECT conv_id, turn, path, reason, CASE reason WHEN 'MASKED' THEN '{P.MASKED}'
  WHEN 'PII' THEN '{P.CELL_PII}' WHEN 'ABOVE_CLEARANCE' THEN '{P.CELL_ABOVE_CLEARANCE}'
  ELSE v END AS value
FROM (SELECT *, CASE WHEN path = 'turn.no' THEN 'MASKED'
    WHEN coalesce({rank('v', 'found')} <= ceiling, FALSE) THEN NULL
    WHEN len(found) > 0 THEN 'PII' ELSE 'ABOVE_CLEARANCE' END AS reason
  FROM (SELECT *, {kinds('v')} AS found FROM free_fields WHERE path <> 'role'))""", "free_fields")
cte("screened_fields", screened(
    "(SELECT * FROM free_fields WHERE length(v) > 10 AND path <> 'turn.no')", "v"), "free_fields")
oracle("free_row_scan", """
SELECT conv_id, turn, path, risk, array_to_string(hits, ',') AS triggered FROM screened_fields
WHERE risk_rank > 0""", "screened_fields")
oracle("live_transfers", f"""
SELECT conv_id, turn, redaction_count, max_rank_seen, safe_text, s.risk,
  s.risk_rank >= 3 AS quarantine
FROM (SELECT conv_id, turn, {TRANSFER} FROM turn_chunks GROUP BY conv_id, turn) t
JOIN (SELECT conv_id, turn, risk, risk_rank FROM screened_turns) s USING (conv_id, turn)""",
       "turn_chunks", "screened_turns")
oracle("injection_report", """
SELECT source, split_part(hit, ':', 1) AS layer, split_part(hit, ':', 2) AS pattern,
  count(*) AS n_texts
FROM (SELECT source, unnest(hits) AS hit FROM screened_docs) GROUP BY source, layer, pattern""",
       "screened_docs")

# --- Session state ----------------------------------------------------------------------

cte("outputs", """
  SELECT 'conv_' || conv_id AS session_id, role AS agent_id,
    ['summary', 'query_result', 'analysis'][CAST(turn % 3 AS INTEGER) + 1] AS output_type,
    turn AS out_seq, text, CAST((conv_id + turn) % 5 AS INTEGER) AS sensitivity_rank
  FROM conversations""")
cte("reads", """
  SELECT conv_id * 100 + min(turn) AS request_id, 'conv_' || conv_id AS session_id,
    role AS requesting_agent, CAST(conv_id % 4 AS INTEGER) AS ceiling_rank,
    CASE WHEN conv_id % 2 = 0 THEN min(turn) + 1 ELSE 10000 END AS until
  FROM conversations GROUP BY conv_id, role""")
cte("matched", """
  SELECT request_id, requesting_agent, ceiling_rank, o.* FROM reads r JOIN outputs o
    ON r.session_id = o.session_id AND o.agent_id <> r.requesting_agent
  WHERE output_type IN ('summary', 'query_result') AND out_seq <= until""", "reads", "outputs")
LEVEL = levels(SENSITIVITY_LEVELS) + "[sensitivity_rank + 1]"
oracle("state_read", f"""
SELECT request_id, m.session_id, output_type, m.agent_id AS from_agent, agent_first_seq, out_seq,
  {LEVEL} AS sensitivity,
  'role=' || m.agent_id || CASE WHEN output_type = 'query_result' THEN '' ELSE ';text=' || text
    END || ';turn=' || out_seq AS data
FROM matched m JOIN (SELECT session_id, agent_id, min(out_seq) AS agent_first_seq FROM outputs
  GROUP BY session_id, agent_id) f ON m.session_id = f.session_id AND m.agent_id = f.agent_id
WHERE sensitivity_rank <= ceiling_rank""", "matched", "outputs")
oracle("state_violations", """
SELECT request_id, session_id, agent_id, output_type, out_seq, sensitivity_rank, ceiling_rank
FROM matched WHERE sensitivity_rank > ceiling_rank""", "matched")
oracle("state_access_log", f"""
SELECT r.request_id, r.requesting_agent, 'summary,query_result' AS needed_types,
  coalesce(array_to_string(list_sort(list_distinct(list(output_type) FILTER (
    WHERE sensitivity_rank <= m.ceiling_rank))), ','), '') AS received_types,
  coalesce(array_to_string(list_sort(list_distinct(list(agent_id || '/' || output_type || ':'
    || {LEVEL}) FILTER (WHERE sensitivity_rank > m.ceiling_rank))), ','), '') AS violations,
  count_if(sensitivity_rank > m.ceiling_rank)::BIGINT AS n_excluded
FROM reads r LEFT JOIN matched m ON r.request_id = m.request_id
GROUP BY r.request_id, r.requesting_agent""", "reads", "matched")
oracle("state_clear", """
SELECT session_id, agent_id, out_seq, output_type FROM outputs o WHERE NOT EXISTS (
  SELECT 1 FROM outputs c WHERE c.sensitivity_rank = 4 AND c.session_id = o.session_id
    AND c.agent_id = o.agent_id AND o.out_seq <= c.out_seq)""", "outputs")

# --- Cached results ---------------------------------------------------------------------

VERSION = ("'v:' || substr(sha256((CAST(floor(date_diff('day', DATE '2024-01-01', ts::DATE) / 4.0)"
           " AS BIGINT))::VARCHAR), 1, 16)")
KEY = (f"'governed:' || substr({VERSION}, 1, 16) || ':' || substr(sha256('user_' || (user_id % 3) "
       "|| ':agent_0'), 1, 16) || ':' || substr(sha256('SELECT 1'), 1, 24)")
TTL = "[" + ", ".join(str(t) for t in TTL_SECONDS) + "][CAST(event_id % 5 AS INTEGER) + 1]"
cte("writes", f"""
  SELECT event_id AS write_id, ts, 'user_' || (user_id % 3) AS user_id, {VERSION} AS version,
    {KEY} AS cache_key, {TTL} AS ttl, ts + to_seconds({TTL}) AS expires_at,
    CAST(event_id % 5 AS INTEGER) AS sensitivity_rank
  FROM events WHERE event_type IN ('purchase', 'signup') AND {TTL} > 0""")
cte("cache_reads", f"""
  SELECT event_id AS read_id, ts, 'user_' || (user_id % 3) AS user_id, {VERSION} AS version,
    CASE WHEN event_type = 'view' AND value > 100 THEN 'v:other' ELSE {VERSION} END AS live,
    {KEY} AS cache_key FROM events WHERE event_type IN ('click', 'view')""")
cte("removals", f"""
  SELECT ts, CASE WHEN value > 70 THEN NULL ELSE 'user_' || (user_id % 3) END AS user_id,
    CASE WHEN value > 70 THEN {VERSION} END AS version FROM events WHERE event_type = 'error'""")


def lookups(removed: str) -> str:
    return f"""
  SELECT read_id, ts, cache_key, CASE WHEN gone THEN 'MISS_KEY' ELSE base END AS lookup,
    CASE WHEN lookup = 'HIT' THEN w END AS write_id
  FROM (SELECT *, coalesce(bool_or(base IN ('MISS_VERSION', 'MISS_CORRUPT')) OVER (PARTITION BY w ORDER BY ts, read_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM (
    SELECT r.*, w.write_id AS w, CASE WHEN w.write_id IS NULL OR {removed} THEN 'MISS_KEY'
        WHEN r.ts > w.expires_at THEN 'MISS_EXPIRED'
        WHEN w.write_id % 13 = 0 THEN 'MISS_CORRUPT'
        WHEN w.version <> r.live THEN 'MISS_VERSION' ELSE 'HIT' END AS base
    FROM cache_reads r ASOF LEFT JOIN writes w
      ON r.cache_key = w.cache_key AND r.ts >= w.ts))"""


cte("plain_lookups", lookups("false"), "cache_reads", "writes")
cte("lookups", lookups("""EXISTS (SELECT 1 FROM removals x WHERE x.ts >= w.ts AND x.ts <= r.ts
      AND (x.user_id = r.user_id OR x.version = r.version))"""),
    "cache_reads", "writes", "removals")
oracle("cache_keys", "SELECT write_id, cache_key, ttl, expires_at FROM writes", "writes")
oracle("cache_contents", """
SELECT cache_key, write_id, sensitivity_rank FROM writes
QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, write_id DESC) = 1""",
       "writes")
oracle("cache_replay", "SELECT read_id, cache_key, lookup, write_id FROM plain_lookups",
       "plain_lookups")
oracle("cache_payload_roundtrip", "SELECT event_id, event_type, value, true AS intact FROM events")
oracle("cache_invalidate", "SELECT read_id, lookup, write_id FROM lookups", "lookups")
oracle("cache_stats", """
SELECT strftime(ts, '%Y-%m-%d %H') AS hour, lookup, count(*) AS n_reads FROM lookups
GROUP BY hour, lookup""", "lookups")

# --- Identity ---------------------------------------------------------------------------

cte("claims", """
  SELECT k AS claim_id, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN ''
      ELSE 'oid-' || k END AS oid,
    CASE WHEN k % 38 <> 0 THEN 'sub-' || k END AS sub,
    CASE WHEN k % 3 <> 0 THEN 'upn-' || k WHEN k % 2 = 0 THEN 'pref-' || k ELSE '' END AS upn,
    c_name AS name, CASE WHEN k % 29 = 0 THEN 'other' ELSE 'tenant' END AS tid,
    [c_mktsegment, 'nation_' || (n % 5)] AS groups,
    CASE n % 4 WHEN 0 THEN ['DataReader'] WHEN 1 THEN ['DataReader', 'DataAdmin']
      WHEN 2 THEN []::VARCHAR[] ELSE ['DataAnalyst', 'Bogus'] END AS roles,
    CASE WHEN k % 2 = 1 THEN 'azp' ELSE 'appid' END AS app_id,
    oid IS NULL OR k % 13 = 0 AS is_app_only, k % 23 = 0 AS overage,
    coalesce(nullif(oid, ''), nullif(sub, '')) AS user_id,
    CASE WHEN 1700000000 + k <= 1700000100 THEN 'CLAIM_EXPIRED'
      WHEN k % 31 = 0 THEN 'AUDIENCE_MISMATCH' WHEN k % 29 = 0 THEN 'TENANT_MISMATCH'
      WHEN is_app_only THEN 'APP_ONLY' WHEN user_id IS NULL THEN 'NO_IDENTITY' ELSE 'USER' END
      AS reason_code
  FROM (SELECT *, c_custkey AS k, c_nationkey AS n FROM customer)""")
oracle("claim_checks", """
SELECT claim_id, user_id, upn, app_id, 'data.read,data.write' AS scopes, is_app_only, reason_code
FROM claims""", "claims")
MAP_BRANDS = "CASE g " + " ".join(
    f"WHEN {text(g)} THEN {texts(b)}" for g, b in roles.GROUP_BRANDS.items()
) + " ELSE []::VARCHAR[] END"
MAP_LEVELS = "CASE r " + " ".join(
    f"WHEN {text(r)} THEN {SENSITIVITY_LEVELS.index(v)}" for r, v in ROLE_LEVELS.items()
) + " ELSE 0 END"
cte("entitled", f"""
  SELECT *, CASE WHEN overage THEN []::VARCHAR[] ELSE list_sort(list_distinct(flatten(
      list_transform(groups, lambda g: {MAP_BRANDS})))) END AS scope,
    greatest(1, coalesce(list_max(list_transform(roles, lambda r: {MAP_LEVELS})), 1))::INTEGER
      AS clearance_rank
  FROM claims WHERE reason_code = 'USER'""", "claims")
METADATA = ("'app_id=' || app_id || ';groups=' || array_to_string(groups, ',') || ';name=' "
            "|| name || ';source=entra_id;tenant_id=' || tid || ';upn=' || upn")
oracle("entitlements", f"""
SELECT claim_id, user_id, array_to_string(roles, ',') AS roles,
  array_to_string(scope, ',') AS brand_scope, clearance_rank, {METADATA} AS metadata
FROM entitled""", "entitled")
oracle("entitlements_override", """
SELECT claim_id, array_to_string(CASE WHEN claim_id % 2 = 0 THEN list_filter(scope,
  lambda b: b IN ('brand_b', 'brand_z')) ELSE scope END, ',') AS brand_scope
FROM entitled""", "entitled")
oracle("agent_principals", """
SELECT claim_id, coalesce(oid, '') AS service_principal_oid, app_id, tid AS tenant_id,
  array_to_string(roles, ',') AS roles, 'entra_id_managed_identity' AS source
FROM claims WHERE reason_code = 'APP_ONLY'""", "claims")
oracle("obo_degrade", f"""
SELECT claim_id, user_id, '' AS roles, '' AS brand_scope, 1 AS clearance_rank,
  {texts(SENSITIVITY_LEVELS)}[clearance_rank + 1] AS original_clearance,
  array_to_string(scope, ',') AS original_brand_scope, 'true' AS obo_degraded
FROM entitled""", "entitled")
oracle("sessions", """
SELECT 'ses_' || substr(sha256(event_id || '|' || claim_id), 1, 32) AS session_id,
  event_id AS request_id, u.user_id, event_type AS request_intent, ts AS created_at,
  array_to_string(scope, ',') AS brand_scope,
  'app_id=' || app_id || ';auth_source=entra_id;upn=' || upn AS metadata
FROM events e JOIN entitled u ON e.user_id * 11 = u.claim_id""", "entitled")

oracle("obo_sessions", f"""
SELECT 'ses_' || substr(sha256(e.event_id || '|' || u.claim_id), 1, 32) AS session_id, u.user_id,
  '' AS brand_scope, 1 AS clearance_rank, 'auth_source=entra_id_obo;obo_degraded=true'
  || CASE WHEN o.user_id IS NULL THEN '' ELSE ';original_brand_scope='
    || array_to_string(u.scope, ',') || ';original_clearance='
    || {texts(SENSITIVITY_LEVELS)}[u.clearance_rank + 1] || ';original_session_id=ses_'
    || substr(sha256((e.event_id - 1) || '|' || u.claim_id), 1, 32) || ';original_user_id='
    || u.user_id END AS metadata
FROM events e JOIN entitled u ON e.user_id * 11 = u.claim_id
LEFT JOIN events o ON o.event_id = e.event_id - 1 AND o.user_id = e.user_id
WHERE e.event_type = 'click'""", "entitled")

# --- Denials over time ------------------------------------------------------------------

oracle("denial_windows", """
SELECT user_id, start AS window_start, start + INTERVAL 1 HOUR AS window_end,
  count(*) AS n_denials
FROM (SELECT user_id, time_bucket(INTERVAL 15 MINUTES, ts) - to_minutes(15 * k) AS start
      FROM decisions, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE reason_code <> 'ALLOWED')
GROUP BY user_id, start""", "decisions")
oracle("denial_sessions", """
SELECT user_id, min(ts) AS burst_start, max(ts) + INTERVAL 2 HOURS AS burst_end,
  count(*) AS n_denials
FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS burst
  FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
    <= INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM decisions WHERE reason_code <> 'ALLOWED'))
GROUP BY user_id, burst""", "decisions")

# Other ways to the same rows.
for _other, _same in (("laid_out_extract", "multi_user_extract"),
                      ("live_denial_windows", "denial_windows"),
                      ("access_decisions_refreshed", "access_decisions"),
                      ("entitlements_from_tables", "entitlements")):
    ORACLES[_other] = ORACLES[_same]
