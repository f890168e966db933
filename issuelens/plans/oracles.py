"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations


def r(value: str, digits: int) -> str:
    """Half-even rounding of a double."""
    scale = 10 ** digits
    return f"round_even(CAST({value} AS DOUBLE) * {scale}, 0) / {scale}"


WHITESPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"

STAR = """
WITH line_rank AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS rn
  FROM lineitem
),
line_first AS (
  SELECT l.l_orderkey, l.l_returnflag AS flag, p.p_type, s.s_name
  FROM line_rank l LEFT JOIN part p ON p.p_partkey = l.l_partkey
  LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE rn = 1
),
line_all AS (
  SELECT l_orderkey, max(l_shipdate) AS last_ship,
    array_to_string(list_sort(list(DISTINCT p_brand)), ', ') AS brands,
    array_to_string(list_sort(list(DISTINCT l_returnflag)), ', ') AS flags
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey
),
line_brand AS (
  SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey
),
folded AS (
  SELECT o.*, c_name, c_mktsegment, n_name, r_name,
    datediff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') % (8 * (1 + c_nationkey % 16))
      AS age,
    abs(datediff('day', CAST(o_orderdate AS DATE), CAST(last_ship AS DATE))) % 15 AS spent,
    brands, flags, flag, p_type, s_name
  FROM orders o
  LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN line_all a ON a.l_orderkey = o_orderkey
  LEFT JOIN line_first f ON f.l_orderkey = o_orderkey
),
issue AS (
  SELECT o_orderkey, 'ORD-' || o_orderkey AS key,
    coalesce(n_name, 'Unknown') AS project, coalesce(r_name, 'Unknown') AS project_name,
    coalesce(p_type, 'Unknown') AS issue_type,
    CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'In Progress'
      ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Resolved' WHEN 1 THEN 'Closed' ELSE ' done ' END
      END AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Highest' WHEN '2-HIGH' THEN 'High'
      WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE 'Medium' END AS priority,
    CASE WHEN o_orderstatus = 'F' THEN 'Fixed' END AS resolution,
    coalesce(c_name, 'Unknown') AS reporter,
    CASE WHEN s_name IS NULL OR o_orderkey % 9 = 0 THEN 'Unassigned' ELSE s_name END AS assignee,
    CASE flag WHEN 'R' THEN 'S1' WHEN 'A' THEN 'S2' WHEN 'N' THEN 'S3' ELSE 'Unknown' END
      AS severity,
    c_mktsegment AS market,
    'REL-' || strftime(o_orderdate, '%y') AS release_name,
    DATE '2001-08-02' - CAST(age AS INTEGER) AS created,
    age AS age_days,
    CASE WHEN o_orderstatus = 'F' AND spent <= age THEN CAST(spent * 24 AS DOUBLE) END
      AS resolution_time_hours,
    o_orderstatus = 'F' AS is_resolved,
    o_orderstatus IN ('O', 'P') AS is_open,
    coalesce(p_type IN ('PROMO', 'ECONOMY'), FALSE) AS is_critical,
    coalesce(brands, '') AS components_str, coalesce(flags, '') AS labels_str,
    brands IS NOT NULL AND brands <> '' AS has_components,
    flags IS NOT NULL AND flags <> '' AS has_labels
  FROM folded
),
doc AS (
  SELECT doc_id, text AS description, split_part(text, chr(10), 1) AS summary FROM documents
),
texted AS (
  SELECT i.*, coalesce(d.summary, 'No summary') AS summary,
    coalesce(d.description, '') AS description
  FROM issue i LEFT JOIN doc d ON d.doc_id = i.o_orderkey % (SELECT count(*) FROM documents)
),
risk AS (
  SELECT *, (CASE WHEN is_critical THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.3::DOUBLE
      + (CASE WHEN priority = 'High' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.2::DOUBLE
      + greatest(0.0::DOUBLE, least(1.0::DOUBLE, age_days / 30)) * 0.3::DOUBLE
      + (CASE WHEN is_resolved THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) * 0.2::DOUBLE AS raw_score
  FROM issue
)"""

SUMMARY_COLUMNS = f"""
  count(*) AS total_defects,
  count(DISTINCT project) AS projects_affected,
  count(*) FILTER (WHERE NOT is_resolved) AS open_defects,
  count(*) FILTER (WHERE is_resolved) AS resolved_defects,
  count(*) FILTER (WHERE is_critical) AS critical_defects,
  count(*) FILTER (WHERE is_critical AND NOT is_resolved) AS critical_open,
  {r("avg(age_days)", 1)} AS avg_age_days,
  {r("avg(age_days) FILTER (WHERE NOT is_resolved)", 1)} AS avg_age_open,
  coalesce(max(age_days) FILTER (WHERE NOT is_resolved), 0) AS oldest_open_defect_days,
  {r(r("avg(CASE WHEN is_resolved THEN 1.0 ELSE 0.0 END)", 6) + " * 100", 1)} AS resolution_rate,
  {r("avg(resolution_time_hours) FILTER (WHERE is_resolved)", 1)} AS avg_resolution_time_hours,
  count(*) FILTER (WHERE assignee = 'Unassigned') AS unassigned_count,
  {r(r("avg(CASE WHEN assignee = 'Unassigned' THEN 1.0 ELSE 0.0 END)", 6) + " * 100", 1)}
    AS unassigned_rate,
  count(*) FILTER (WHERE priority = 'High') AS high_priority_count,
  count(*) FILTER (WHERE NOT has_components) AS no_components_count
"""

HEALTH = f"""
stats AS (
  SELECT project, count(key) AS total_defects,
    count(*) FILTER (WHERE NOT is_resolved) AS open_defects,
    count(*) FILTER (WHERE is_critical) AS critical_defects,
    {r("avg(age_days)", 2)} AS avg_age_days,
    count(*) FILTER (WHERE priority = 'High') AS high_priority_count,
    count(*) FILTER (WHERE assignee = 'Unassigned') AS unassigned_count,
    {r("avg(resolution_time_hours)", 2)} AS avg_resolution_hours,
    coalesce({r("avg(age_days) FILTER (WHERE NOT is_resolved)", 2)}, 0.0) AS avg_age_open_days
  FROM issue GROUP BY project
),
health AS (
  SELECT *, {r('''(1 - open_defects / total_defects) * 0.4::DOUBLE
    + (1 - critical_defects / total_defects) * 0.3::DOUBLE
    + (1 - greatest(0.0, least(1.0, avg_age_open_days / 30))) * 0.3::DOUBLE''', 3)} AS health_score
  FROM stats
)"""

LOG = """
WITH step AS (
  SELECT 'ISS-' || user_id AS key, ts, event_id AS seq, event_type AS to_state,
    lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state
  FROM events
),
counted AS (
  SELECT key,
    count(*) FILTER (WHERE from_state = 'purchase' AND to_state <> 'purchase') AS reopen_count,
    arg_max(to_state, (ts, seq)) AS status
  FROM step GROUP BY key
),
reopens AS (
  SELECT 'ISS-' || c_custkey AS key, coalesce(reopen_count, 0) AS reopen_count, status
  FROM customer LEFT JOIN counted ON counted.key = 'ISS-' || c_custkey
)"""

WRITEUPS = f"""
WITH written AS (
  SELECT 'DOC-' || d.doc_id AS key,
    trim(CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE text END, {WHITESPACE}) AS body,
    trim(CASE WHEN d.doc_id % 7 = 0 THEN substring(split_part(text, chr(10), 1), 1, 8)
      ELSE split_part(text, chr(10), 1) END, {WHITESPACE}) AS title,
    d.doc_id % 4 <> 0 AS has_components,
    quality IS NOT NULL AS has_priority,
    coalesce(toxic, 0) <> 1 AND source <> '' AS has_assignee
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
checked AS (
  SELECT key, [
    struct_pack(name := 'has_description', ok := length(body) > 0),
    struct_pack(name := 'description_is_substantial', ok := length(body) >= 60),
    struct_pack(name := 'has_components', ok := has_components),
    struct_pack(name := 'has_priority', ok := has_priority),
    struct_pack(name := 'has_assignee', ok := has_assignee),
    struct_pack(name := 'summary_is_specific', ok := length(title) >= 15)] AS checks
  FROM written
),
failed AS (
  SELECT key, [c.name FOR c IN checks IF NOT c.ok] AS missing FROM checked
),
scored AS (
  SELECT key, missing, {r("(6 - len(missing)) / 6 * 100", 1)} AS quality_score FROM failed
)"""

AGES = """(VALUES (1, '0-7 days', 0, 7), (2, '8-14 days', 8, 14), (3, '15-30 days', 15, 30),
  (4, '31-60 days', 31, 60), (5, '61-90 days', 61, 90), (6, '90+ days', 91, 1000000000))
  AS ages(position, bucket, low, high)"""

REGISTRY = """
years AS (
  SELECT year(o_orderdate) AS y, min(o_orderdate) AS created_at FROM orders GROUP BY 1
  UNION ALL SELECT year(ts), min(ts) FROM events GROUP BY 1
),
registry AS (
  SELECT 'REL-' || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS name, 'Release of ' || y AS description,
    created_at, y % 4 <> 0 AS is_active FROM years
)"""

RECOMMEND = """
facts AS (
  SELECT count(*) FILTER (WHERE is_critical AND NOT is_resolved) AS critical_open,
    count(*) FILTER (WHERE age_days > 30 AND NOT is_resolved) AS very_old,
    count(*) FILTER (WHERE assignee = 'Unassigned' AND NOT is_resolved) AS unassigned,
    count(*) FILTER (WHERE priority = 'High' AND NOT is_resolved) AS high_open FROM issue
),
worst AS (
  SELECT project, count(*) AS n FROM issue WHERE NOT is_resolved GROUP BY project
  ORDER BY n DESC, project LIMIT 1
),
advice AS (
  SELECT 1 AS position, 'critical_open' AS type, 'Critical' AS priority,
    critical_open || ' critical bugs are still open' AS message,
    'Immediately assign and prioritize critical bugs' AS action, critical_open AS "count",
    'High' AS impact FROM facts WHERE critical_open > 0
  UNION ALL SELECT 2, 'very_old_defects', 'High', very_old || ' defects are older than 30 days',
    'Review and close/fix very old defects', very_old, 'Medium' FROM facts WHERE very_old > 0
  UNION ALL SELECT 3, 'unassigned_defects', 'Medium',
    unassigned || ' open defects are unassigned', 'Assign ownership to open defects', unassigned,
    'Medium' FROM facts WHERE unassigned > 10
  UNION ALL SELECT 4, 'project_focus', 'Medium',
    'Project ' || project || ' has ' || n || ' open defects',
    'Focus QA efforts on ' || project || ' project', n, 'Medium' FROM worst
  UNION ALL SELECT 5, 'high_priority_open', 'High',
    high_open || ' high priority defects are still open',
    'Review and expedite high priority defects', high_open, 'High' FROM facts WHERE high_open > 0
)"""

RECOMMEND_BY_RELEASE = """
facts AS (
  SELECT release_name, count(*) FILTER (WHERE is_critical AND NOT is_resolved) AS critical_open,
    count(*) FILTER (WHERE age_days > 30 AND NOT is_resolved) AS very_old,
    count(*) FILTER (WHERE assignee = 'Unassigned' AND NOT is_resolved) AS unassigned,
    count(*) FILTER (WHERE priority = 'High' AND NOT is_resolved) AS high_open FROM issue GROUP BY 1
),
worst AS (
  SELECT release_name, project, count(*) AS n FROM issue WHERE NOT is_resolved GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY release_name ORDER BY n DESC, project) = 1
),
advice AS (
  SELECT release_name, 1 AS position, 'critical_open' AS type, 'Critical' AS priority,
    critical_open || ' critical bugs are still open' AS message,
    'Immediately assign and prioritize critical bugs' AS action, critical_open AS "count",
    'High' AS impact FROM facts WHERE critical_open > 0
  UNION ALL SELECT release_name, 2, 'very_old_defects', 'High', very_old || ' defects are older than 30 days',
    'Review and close/fix very old defects', very_old, 'Medium' FROM facts WHERE very_old > 0
  UNION ALL SELECT release_name, 3, 'unassigned_defects', 'Medium',
    unassigned || ' open defects are unassigned', 'Assign ownership to open defects', unassigned,
    'Medium' FROM facts WHERE unassigned > 10
  UNION ALL SELECT release_name, 4, 'project_focus', 'Medium',
    'Project ' || project || ' has ' || n || ' open defects',
    'Focus QA efforts on ' || project || ' project', n, 'Medium' FROM worst
  UNION ALL SELECT release_name, 5, 'high_priority_open', 'High',
    high_open || ' high priority defects are still open',
    'Review and expedite high priority defects', high_open, 'High' FROM facts WHERE high_open > 0
)"""

TOP = f"""
top AS (
  SELECT t.*, {r("raw_score", 3)} AS risk_score, d.summary FROM risk t
  LEFT JOIN doc d ON d.doc_id = t.o_orderkey % (SELECT count(*) FROM documents)
  ORDER BY {r("raw_score", 3)} DESC, created DESC, key LIMIT 25
)"""


def _counts(dimensions: list[str], by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{d}' AS dimension, {d} AS value, count(*) AS n FROM issue "
        f"GROUP BY ALL" for d in dimensions)


def _store_read(condition: str) -> str:
    return f"""{STAR}, {REGISTRY}
SELECT key, release_name, status, strftime(created, '%Y-%m-%d') AS created_day,
  components_str AS components, labels_str AS labels
FROM issue JOIN registry ON name = release_name AND is_active
WHERE release_name IN ('REL-97', 'REL-98', 'REL-00', 'REL-24') AND {condition}"""


def _band(score: str, high: str, medium: str) -> str:
    return f"CASE WHEN {score} > {high} THEN 'high' WHEN {score} > {medium} THEN 'medium' ELSE 'low' END"


def _trend(period: str, columns: str, limit: int) -> str:
    return f"""{STAR}
SELECT strftime(created, '{period}') AS {columns}
FROM issue GROUP BY 1 ORDER BY 1 DESC LIMIT {limit}"""


def _release_trend(period: str, columns: str, name: str, limit: int) -> str:
    return f"""{STAR}
SELECT release_name, strftime(created, '{period}') AS {columns}
FROM issue GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY release_name ORDER BY {name} DESC) <= {limit}"""


PAGE_COLUMNS = """key, project, project_name, issue_type, status, priority, resolution, reporter, assignee,
  severity, market, strftime(created, '%Y-%m-%d') AS created_day, age_days,
  resolution_time_hours, components_str, labels_str, coalesce(reopen_count, 0) AS reopen_count, release_name,
  summary, description, strftime(CASE WHEN resolution_time_hours IS NULL THEN DATE '2001-08-02'
    ELSE created + CAST(resolution_time_hours / 24 AS INTEGER) END, '%Y-%m-%d') AS updated_day,
  CASE WHEN is_resolved THEN release_name ELSE '' END AS fix_versions"""

# Reopens of the user of the same number; states as the landed changelogs name them.
LANDED_REOPENS = """
moves AS (
  SELECT user_id, event_type AS to_state,
    lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events
),
landed AS (
  SELECT user_id, count(*) FILTER (WHERE from_state = 'purchase' AND to_state <> 'purchase') AS reopen_count
  FROM moves GROUP BY user_id
)"""

# Issues that the stream sees once more, and those it cannot store.
LANDED_AGAIN = "count(*) FILTER (WHERE o_orderkey % 3 = 0)"
LANDED_FAILING = """(count(*) FILTER (WHERE o_orderkey % 5 = 0) + count(*) FILTER (WHERE o_orderkey % 7 = 0)
    + count(*) FILTER (WHERE o_orderkey % 11 = 0))"""

STORED = """{star}, {registry},
stored AS (
  SELECT release_name,
    CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 30 <> 0 THEN 'Closed' ELSE status END AS status
  FROM issue
)
SELECT release_name AS name, count(*) AS total_defects,
  count(*) FILTER (WHERE status NOT IN ('Resolved', 'Closed', 'Done')) AS open_defects
FROM stored GROUP BY 1"""

SEVEN = f"""count(*) AS total_defects, count(DISTINCT project) AS projects_affected,
  count(*) FILTER (WHERE NOT is_resolved) AS open_defects,
  {r("avg(age_days)", 1)} AS avg_age_days,
  {r("avg(CASE WHEN is_resolved THEN 1.0 ELSE 0.0 END) * 100", 1)} AS resolution_rate,
  count(*) FILTER (WHERE is_critical) AS critical_count,
  count(*) FILTER (WHERE priority = 'High') AS high_priority_count"""

TRENDLINE = f"""{STAR},
daily AS (
  SELECT release_name, created, count(*) AS daily_count FROM issue {{where}} GROUP BY 1, 2
)
SELECT release_name, strftime(created, '%Y-%m-%d') AS day, daily_count,
  CAST(sum(daily_count) OVER (PARTITION BY release_name ORDER BY created) AS BIGINT)
    AS cumulative_count FROM daily"""


def _text(value: str) -> str:
    return f"CAST({value} AS VARCHAR)"


def _report() -> str:
    metrics = ["total_defects", "projects_affected", "open_defects", "resolved_defects",
               "critical_defects", "critical_open", "avg_age_days", "avg_age_open",
               "oldest_open_defect_days", "resolution_rate", "avg_resolution_time_hours",
               "unassigned_count", "unassigned_rate", "high_priority_count",
               "no_components_count"]
    summary = " UNION ALL ".join(
        f"SELECT 'summary' AS section, 1::BIGINT AS item_no, 'all' AS item, '{m}' AS metric, "
        f"{_text(m)} AS value FROM summed" for m in metrics)
    projects = " UNION ALL ".join(
        f"SELECT 'projects', pos, project, '{m}', {_text(m)} FROM worst_ten"
        for m in ("total_defects", "open_defects", "health_score"))
    advice = " UNION ALL ".join(
        f"SELECT 'recommendations', position, type, '{m}', CAST(\"{m}\" AS VARCHAR) FROM advice"
        for m in ("priority", "message", "action", "impact", "count"))
    risks = " UNION ALL ".join(
        f"SELECT 'risks', pos, key, '{m}', {_text(value)} FROM first_risks"
        for m, value in [("project", "project"), ("risk_score", "risk_score"),
                         ("summary", "substring(summary, 1, 60) || '...'"),
                         ("issue_type", "issue_type"), ("priority", "priority"),
                         ("age_days", "age_days"), ("assignee", "assignee")])
    return f"""{STAR}, {HEALTH}, {RECOMMEND}, {TOP},
summed AS (SELECT {SUMMARY_COLUMNS} FROM issue),
worst_ten AS (
  SELECT *, row_number() OVER (ORDER BY health_score, project) AS pos FROM health
  ORDER BY pos LIMIT 10),
first_risks AS (
  SELECT *, row_number() OVER (ORDER BY risk_score DESC, created DESC, key) AS pos FROM top
  ORDER BY pos LIMIT 15)
{summary} UNION ALL {projects} UNION ALL {advice} UNION ALL {risks}"""


ORACLES = {
    # Projections
    "defects_base": f"""{STAR}
SELECT key, project, project_name, issue_type, status, priority, reporter, assignee, severity,
  release_name, strftime(created, '%Y-%m-%d') AS created_day, age_days, resolution_time_hours,
  is_resolved, is_critical, is_open, components_str, labels_str FROM issue""",
    "resolved_flag": f"{STAR} SELECT key, status, is_resolved FROM issue",
    "status_definitions": f"""{STAR},
wide AS (
  SELECT count(*) FILTER (WHERE lower(trim(status)) NOT IN ('resolved', 'closed', 'done', 'fixed'))
      AS config,
    count(*) FILTER (WHERE status <> 'Resolved') AS literal_resolved,
    count(*) FILTER (WHERE status IN ('Open', 'In Progress', 'Reopened', 'To Do')) AS open_literal,
    count(*) FILTER (WHERE status NOT IN ('Resolved', 'Closed', 'Done')) AS store_closed,
    count(*) FILTER (WHERE status NOT IN ('Closed', 'Resolved')) AS web_closed FROM issue
)
UNPIVOT wide ON COLUMNS(*) INTO NAME definition VALUE open_count""",
    "period_keys": f"""{STAR}
SELECT key, strftime(created, '%Y-W%U') AS created_week, strftime(created, '%Y-%m') AS created_month,
  strftime(created, '%Y-%m-%d') AS created_day FROM issue""",
    "text_flags": f"""{STAR}
SELECT key, length(summary) AS summary_length, length(description) AS description_length,
  description <> '' AS has_description, assignee <> 'Unassigned' AS has_assignee,
  has_components, has_labels FROM texted""",
    "text_shortened": f"""{STAR}
SELECT key, substring(summary, 1, 80) || '...' AS always_80,
  CASE WHEN length(summary) > 100 THEN substring(summary, 1, 100) || '...' ELSE summary END
    AS longer_100 FROM texted""",
    "nan_clean": """
SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0
  THEN value END AS value FROM events""",
    "raw_json": f"""{STAR}
SELECT key, CAST(to_json(struct_pack(key := key, project := project, project_name := project_name,
  issue_type := issue_type, status := status, priority := priority, resolution := resolution,
  reporter := reporter, assignee := assignee, severity := severity, release_name := release_name,
  created_day := strftime(created, '%Y-%m-%d'), age_days := age_days, is_resolved := is_resolved,
  is_critical := is_critical, is_open := is_open, components_str := components_str,
  labels_str := labels_str)) AS VARCHAR) AS raw_data FROM issue""",
    "extraction_audit": f"""
WITH counted AS (
  SELECT count(*) AS fetched, count(*) FILTER (WHERE o_orderkey % 97 = 0) AS dropped FROM orders
)
SELECT fetched, fetched - dropped AS extracted, dropped,
  {r("(fetched - dropped) / fetched * 100", 1)} AS success_rate FROM counted""",
    # Landed pages
    "page_scan": f"""{STAR}, {LANDED_REOPENS}
SELECT {PAGE_COLUMNS} FROM texted LEFT JOIN landed ON user_id = o_orderkey""",
    "page_audit": """SELECT count(*) AS announced, count(DISTINCT o_orderkey) AS obtained,
  count(*) - count(DISTINCT o_orderkey) AS missing,
  count(*) > count(DISTINCT o_orderkey) AS truncated,
  (SELECT count(*) FROM region) AS corrupt_pages FROM orders""",
    "scan_observed": """SELECT count(*) AS announced, count(*) AS fetched, 0::BIGINT AS unreadable,
  count(*) AS extracted, (SELECT count(*) FROM region) AS corrupt FROM orders""",
    # Scans, store and releases
    "scan_filter": f"""{STAR}
SELECT key, severity, issue_type, strftime(created, '%Y-%m-%d') AS created_day FROM issue
WHERE issue_type IN ('PROMO', 'ECONOMY', 'LARGE') AND release_name = 'REL-99'
ORDER BY severity, created DESC, key""",
    "upsert_latest": f"""{STAR}
SELECT key, release_name, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 30 <> 0 THEN 'Closed'
  ELSE status END AS status, priority FROM issue""",
    "upsert_rejected": """
SELECT count(*) FILTER (WHERE o_orderkey % 30 <> 0) AS stored,
  count(*) FILTER (WHERE o_orderkey % 30 = 0) AS skipped FROM orders WHERE o_orderkey % 3 = 0""",
    "release_register": f"""WITH {REGISTRY}
SELECT name, CASE WHEN is_active THEN description ELSE 'registered again' END AS description,
  is_active FROM registry""",
    "store_read_open": _store_read("status NOT IN ('Resolved', 'Closed', 'Done')"),
    "store_read_closed": _store_read("status IN ('Resolved', 'Closed', 'Done')"),
    "store_roundtrip": STORED.format(star=STAR, registry=REGISTRY),
    "store_rows": f"""{STAR}
SELECT key, release_name, project, CASE WHEN changed THEN 'Closed' ELSE status END AS status, priority,
  resolution, severity, assignee, summary, description,
  strftime(CASE WHEN resolution_time_hours IS NULL THEN DATE '2001-08-02'
    ELSE created + CAST(resolution_time_hours / 24 AS INTEGER) END, '%Y-%m-%d') AS updated_day,
  CASE WHEN is_resolved THEN release_name ELSE '' END AS fix_versions,
  CASE WHEN changed THEN 'Closed' ELSE status END AS raw_status
FROM (SELECT *, o_orderkey % 3 = 0 AND o_orderkey % 30 <> 0 AS changed FROM texted)""",
    "store_rejects": """
SELECT 'no key' AS reason, count(*) AS n FROM orders WHERE o_orderkey % 30 = 0 HAVING count(*) > 0""",
    "csv_roundtrip": f"""{STAR}
SELECT key, project, project_name, issue_type, status, priority, resolution, reporter, assignee, severity,
  release_name, strftime(created, '%Y-%m-%d') AS created_day, age_days, resolution_time_hours,
  is_resolved, is_critical, is_open, nullif(components_str, '') AS components,
  nullif(labels_str, '') AS labels, nullif(summary, '') AS summary, nullif(description, '') AS description
FROM texted""",
    "results_roundtrip": f"""{STAR}
SELECT release_name, 'projects' AS analysis_type, project, count(*) AS total_defects,
  count(*) FILTER (WHERE NOT is_resolved) AS open_defects, max(age_days) AS oldest
FROM issue WHERE release_name IN ('REL-99', 'REL-00') GROUP BY ALL""",
    "releases_with_counts": f"""{STAR}, {REGISTRY}
SELECT name, count(key) AS total_defects,
  count(*) FILTER (WHERE status NOT IN ('Resolved', 'Closed', 'Done')) AS open_defects
FROM registry LEFT JOIN issue ON release_name = name WHERE is_active GROUP BY name""",
    "release_semi": f"""{STAR}
SELECT key, release_name, status FROM issue WHERE release_name IN (
  SELECT 'REL-' || strftime(o_orderdate, '%y') FROM orders WHERE year(o_orderdate) >= 2000)""",
    "release_union": f"""{STAR}
SELECT key, release_name, severity FROM issue WHERE release_name = 'REL-95'
UNION ALL SELECT key, release_name, NULL FROM issue WHERE release_name = 'REL-96'""",
    "release_sequence": """
WITH named AS (
  SELECT 'REL-' || strftime(o_orderdate, '%y') AS name FROM orders
  UNION ALL SELECT strftime(o_orderdate, '%Y-%m') FROM orders
),
volume AS (SELECT name, count(*) AS n FROM named GROUP BY name),
steps AS (
  SELECT name AS current, CAST(step AS INTEGER) AS position,
    CASE WHEN name LIKE 'REL-%' THEN CAST(split_part(name, '-', 2) AS BIGINT) - step END AS num,
    CAST(split_part(name, '-', 2) AS BIGINT) - step AS minor,
    CASE WHEN name NOT LIKE 'REL-%' THEN CAST(split_part(name, '-', 1) AS BIGINT) END AS major
  FROM volume, range(4) AS t(step)
),
listed AS (
  SELECT current, position, CASE WHEN major IS NULL THEN 'REL-' || lpad(CAST(num AS VARCHAR), 2, '0')
    WHEN minor > 0 THEN major || '-' || lpad(CAST(minor AS VARCHAR), 2, '0')
    ELSE (major - 1) || '-' || lpad(CAST(minor + 52 AS VARCHAR), 2, '0') END AS release_name
  FROM steps WHERE major IS NOT NULL OR num >= 0
)
SELECT current, position, release_name, coalesce(n, 0) AS n_defects
FROM listed LEFT JOIN volume ON name = release_name""",
    "release_comparison": f"""{STAR},
sized AS (
  SELECT release_name, project, count(*) AS n, count(*) FILTER (WHERE is_critical) AS crit,
    count(*) FILTER (WHERE age_days > 30 AND NOT is_resolved) AS old
  FROM issue GROUP BY ALL
),
spread AS (
  SELECT release_name, arg_min(project, (-n, project)) AS most_affected_project,
    count(*) FILTER (WHERE crit > 0) AS projects_with_critical_bugs,
    count(*) FILTER (WHERE old > 0) AS projects_with_old_bugs FROM sized GROUP BY 1
),
summed AS (
  SELECT release_name, {SEVEN},
    count(*) FILTER (WHERE NOT is_resolved AND age_days > 30) AS defects_over_30_days,
    count(*) FILTER (WHERE NOT is_resolved AND age_days > 14) AS defects_over_14_days,
    count(*) FILTER (WHERE NOT is_resolved AND age_days > 7) AS defects_over_7_days,
    {r("avg(age_days) FILTER (WHERE NOT is_resolved)", 1)} AS avg_age_open
  FROM issue GROUP BY 1
)
SELECT * FROM summed JOIN spread USING (release_name)""",
    "release_distributions": f"""{STAR}
{_counts(["priority", "issue_type", "severity"], "release_name")}""",
    "release_projects": f"""{STAR},
typed AS (SELECT release_name, project, issue_type, count(*) AS n FROM issue GROUP BY ALL),
modes AS (
  SELECT release_name, project, arg_min(issue_type, (-n, issue_type)) AS top_issue_type
  FROM typed GROUP BY ALL
)
SELECT release_name, project, count(*) AS total_defects,
  count(*) FILTER (WHERE NOT is_resolved) AS open_defects,
  count(*) FILTER (WHERE is_critical) AS critical_defects, {r("avg(age_days)", 6)} AS avg_age,
  any_value(top_issue_type) AS top_issue_type
FROM issue JOIN modes USING (release_name, project) GROUP BY release_name, project""",
    "release_aging": f"""{STAR},
named AS (SELECT DISTINCT release_name FROM issue)
SELECT n.release_name, position, bucket, count(key) AS n
FROM named n CROSS JOIN {AGES}
LEFT JOIN issue i ON i.release_name = n.release_name AND age_days BETWEEN low AND high
GROUP BY ALL""",
    "release_top_risks": f"""{STAR},
ranked AS (
  SELECT release_name, key, project, {r("raw_score", 3)} AS risk_score,
    CAST(row_number() OVER (PARTITION BY release_name
      ORDER BY {r("raw_score", 3)} DESC, created DESC, key) AS INTEGER) AS position FROM risk
)
SELECT release_name, position, key, project, risk_score FROM ranked WHERE position <= 5""",
    "release_oldest_open": f"""{STAR}
SELECT release_name, key, age_days AS age, project FROM issue WHERE NOT is_resolved
QUALIFY row_number() OVER (PARTITION BY release_name ORDER BY age_days DESC, created DESC, key) = 1""",
    "release_severities": f"""{STAR},
counts AS (SELECT release_name, severity, count(*) AS n FROM issue GROUP BY ALL)
SELECT c.release_name, severity, n,
  coalesce((SELECT u.n FROM counts u
    WHERE u.release_name = c.release_name AND u.severity = 'Unknown'), 0) AS unknown_count,
  (SELECT arg_min(k.severity, (-k.n, k.severity)) FROM counts k
    WHERE k.release_name = c.release_name AND k.severity <> 'Unknown') AS most_common
FROM counts c""",
    "release_recommendations": f"""{STAR},
worst AS (
  SELECT release_name, project, count(*) AS n FROM issue WHERE is_critical
  GROUP BY release_name, project QUALIFY row_number() OVER (PARTITION BY release_name ORDER BY n DESC, project) = 1
),
common AS (
  SELECT release_name, severity, count(*) AS n FROM issue WHERE severity <> 'Unknown'
  GROUP BY release_name, severity QUALIFY row_number() OVER (PARTITION BY release_name ORDER BY n DESC, severity) = 1
),
aged AS (
  SELECT release_name, count(*) AS n FROM issue WHERE age_days > 14 AND NOT is_resolved GROUP BY 1
)
SELECT release_name, 'cross_project_critical' AS type,
  'Project ''' || project || ''' has ' || n || ' critical bugs' AS message,
  'Focus QA efforts on ' || project || ' project' AS action, n AS "count" FROM worst
UNION ALL SELECT release_name, 'aging_defects',
  n || ' defects across all projects are older than 14 days',
  'Review and prioritize old defects across all projects', n FROM aged
UNION ALL SELECT release_name, 'custom_field_pattern',
  'Most common severity value: ' || severity || ' (' || n || ' defects)',
  'Investigate pattern in severity = ' || severity, n FROM common""",
    "store_stats": f"""{STAR}, {REGISTRY}
SELECT (SELECT count(*) FROM registry WHERE is_active) AS active_releases,
  (SELECT count(*) FROM issue) AS total_defects,
  (SELECT count(*) FROM (SELECT DISTINCT release_name, status FROM issue)) AS total_analyses""",
    # Summaries and distributions
    "summary": f"{STAR} SELECT {SUMMARY_COLUMNS} FROM issue",
    "summary_empty": f"{STAR} SELECT {SUMMARY_COLUMNS} FROM issue WHERE project = 'NO SUCH PROJECT'",
    "summary_quick": f"""{STAR}
SELECT {SEVEN},
  (SELECT release_name FROM issue ORDER BY created DESC, key LIMIT 1) AS current_release
FROM issue""",
    "summary_web": f"""{STAR}
SELECT count(*) AS total_defects,
  count(*) FILTER (WHERE status IN ('Closed', 'Resolved')) AS resolved_defects,
  {r("count(*) FILTER (WHERE status IN ('Closed', 'Resolved')) / count(*) * 100", 1)}
    AS resolution_rate,
  count(*) FILTER (WHERE priority IN ('Highest', 'Blocker')
    AND status NOT IN ('Closed', 'Resolved')) AS critical_open,
  'REL-99, REL-00, REL-01' AS releases
FROM issue WHERE release_name IN ('REL-99', 'REL-00', 'REL-01')""",
    "value_counts": f"""{STAR}
{_counts(["project", "priority", "issue_type", "severity", "release_name"])}""",
    "value_counts_grouping_sets": f"""{STAR}
{_counts(["project", "priority", "issue_type", "severity", "release_name"])}""",
    "severity_profile": f"""{STAR},
counts AS (SELECT severity, count(*) AS n FROM issue GROUP BY 1)
SELECT severity, n,
  coalesce((SELECT n FROM counts WHERE severity = 'Unknown'), 0) AS unknown_count,
  (SELECT severity FROM counts WHERE severity <> 'Unknown' ORDER BY n DESC, severity LIMIT 1)
    AS most_common FROM counts""",
    "project_breakdown": f"""{STAR},
typed AS (SELECT project, issue_type, count(*) AS n FROM issue GROUP BY ALL),
modes AS (
  SELECT project, arg_min(issue_type, (-n, issue_type)) AS top_issue_type FROM typed GROUP BY 1
)
SELECT project, count(*) AS total_defects, count(*) FILTER (WHERE NOT is_resolved) AS open_defects,
  count(*) FILTER (WHERE is_critical) AS critical_defects, {r("avg(age_days)", 6)} AS avg_age,
  any_value(top_issue_type) AS top_issue_type
FROM issue JOIN modes USING (project) GROUP BY project""",
    "cross_project": f"""{STAR},
sized AS (
  SELECT project, count(*) AS n, count(*) FILTER (WHERE is_critical) AS crit,
    count(*) FILTER (WHERE age_days > 30 AND NOT is_resolved) AS old FROM issue GROUP BY 1
)
SELECT count(*) AS total_projects_affected, arg_min(project, (-n, project)) AS most_affected_project,
  count(*) FILTER (WHERE crit > 0) AS projects_with_critical_bugs,
  avg(n) AS avg_defects_per_project, count(*) FILTER (WHERE old > 0) AS projects_with_old_bugs
FROM sized""",
    "critical_by_project": f"""{STAR}
SELECT project, count(*) AS critical_defects FROM issue WHERE is_critical GROUP BY 1""",
    "critical_components": f"""{STAR}
SELECT p_brand AS component, count(*) AS n
FROM issue JOIN line_brand ON l_orderkey = o_orderkey WHERE is_critical AND p_brand IS NOT NULL
GROUP BY 1 ORDER BY n DESC, component LIMIT 10""",
    "pattern_sample": f"""{STAR}
SELECT key, substr(summary, 1, 100) AS summary FROM texted ORDER BY md5('42:' || key), key LIMIT 5""",
    "pattern_summary": f"""{STAR},
types AS (SELECT issue_type AS name, count(*) AS n FROM issue GROUP BY 1),
brands AS (
  SELECT p_brand AS name, count(*) AS n FROM issue JOIN line_brand ON l_orderkey = o_orderkey
  WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 5
)
SELECT count(*) AS total_defects, count(*) FILTER (WHERE status <> 'Resolved') AS open_defects,
  {r("count(*) FILTER (WHERE status <> 'Resolved') / count(*) * 100", 1)} AS open_percent,
  count(*) FILTER (WHERE priority IN ('Highest', 'High')) AS high_priority_defects,
  {r("count(*) FILTER (WHERE priority IN ('Highest', 'High')) / count(*) * 100", 1)}
    AS high_priority_percent,
  {r("avg(age_days) FILTER (WHERE status <> 'Resolved')", 1)} AS avg_age_open,
  (SELECT string_agg(name || ': ' || n, ', ' ORDER BY n DESC, name) FROM types) AS issue_types,
  (SELECT string_agg(name || ': ' || n, ', ' ORDER BY n DESC, name) FROM brands) AS top_components
FROM issue""",
    # Health, ageing, workload
    "project_health": f"{STAR}, {HEALTH} SELECT * FROM health",
    "project_health_top5": f"""{STAR}, {HEALTH}
SELECT project, health_score, open_defects FROM health
ORDER BY health_score DESC, project LIMIT 5""",
    "health_band": f"""{STAR}, {HEALTH}
SELECT project, health_score, CASE WHEN health_score > 0.7 THEN 'low'
  WHEN health_score > 0.5 THEN 'medium' ELSE 'high' END AS risk_band FROM health""",
    "age_histogram": f"""{STAR}
SELECT position, bucket, count(key) AS n FROM {AGES}
LEFT JOIN issue ON age_days BETWEEN low AND high GROUP BY ALL""",
    "aging_project": f"""{STAR}
SELECT project, {r("avg(age_days)", 1)} AS avg_age, max(age_days) AS oldest_defect,
  count(age_days) AS open_count FROM issue WHERE NOT is_resolved GROUP BY 1""",
    "aging_priority": f"""{STAR}
SELECT priority, {r("avg(age_days)", 3)} AS avg_age_days,
  {r("avg(CASE WHEN is_resolved THEN 0.0 ELSE 1.0 END)", 3)} AS percent_open
FROM issue GROUP BY 1""",
    "aging_issue_type": f"""{STAR}
SELECT issue_type, {r("avg(age_days)", 3)} AS avg_age_days,
  {r("avg(CASE WHEN is_resolved THEN 0.0 ELSE 1.0 END)", 3)} AS percent_open
FROM issue GROUP BY 1""",
    "oldest_open": f"""{STAR}
SELECT key, age_days AS age, project FROM issue WHERE NOT is_resolved
ORDER BY age_days DESC, created DESC, key LIMIT 1""",
    "aging_thresholds": f"""{STAR}
SELECT count(*) AS total_open, count(*) FILTER (WHERE age_days > 30) AS defects_over_30_days,
  count(*) FILTER (WHERE age_days > 14) AS defects_over_14_days,
  count(*) FILTER (WHERE age_days > 7) AS defects_over_7_days,
  {r("avg(age_days)", 1)} AS avg_age_open FROM issue WHERE NOT is_resolved""",
    "assignee_workload": f"""{STAR}
SELECT assignee, count(key) AS total_assigned, count(*) FILTER (WHERE NOT is_resolved) AS open_count,
  count(*) FILTER (WHERE is_critical) AS critical_count, {r("avg(age_days)", 2)} AS avg_age,
  {r("avg(resolution_time_hours)", 2)} AS avg_resolution_hours
FROM issue WHERE assignee <> 'Unassigned' GROUP BY 1 ORDER BY open_count DESC, assignee LIMIT 20""",
    "component_stats": f"""{STAR}
SELECT p_brand AS component, count(key) AS total_defects,
  count(*) FILTER (WHERE NOT is_resolved) AS open_count,
  count(*) FILTER (WHERE is_critical) AS critical_count, {r("avg(age_days)", 2)} AS avg_age
FROM issue JOIN line_brand ON l_orderkey = o_orderkey WHERE p_brand IS NOT NULL
GROUP BY 1 ORDER BY open_count DESC, component LIMIT 15""",
    "resolution_percentiles": f"""{STAR}
SELECT {r("quantile_cont(resolution_time_hours, 0.5)", 1)} AS p50,
  {r("quantile_cont(resolution_time_hours, 0.75)", 1)} AS p75,
  {r("quantile_cont(resolution_time_hours, 0.9)", 1)} AS p90,
  {r("quantile_cont(resolution_time_hours, 0.95)", 1)} AS p95
FROM issue WHERE is_resolved AND resolution_time_hours IS NOT NULL""",
    "percentile_sketches": f"""{STAR}
SELECT release_name, count(*) AS n, 4::BIGINT AS percentiles, 4::BIGINT AS within_error,
  {r("quantile_cont(resolution_time_hours, 0.5)", 1)} AS p50,
  {r("quantile_cont(resolution_time_hours, 0.75)", 1)} AS p75,
  {r("quantile_cont(resolution_time_hours, 0.9)", 1)} AS p90,
  {r("quantile_cont(resolution_time_hours, 0.95)", 1)} AS p95
FROM issue WHERE is_resolved AND resolution_time_hours IS NOT NULL GROUP BY 1""",
    "sla_compliance": f"""{STAR}
SELECT coalesce({r('''avg(CASE WHEN resolution_time_hours <= 48 THEN 1.0 ELSE 0.0 END)
    FILTER (WHERE is_critical) * 100''', 1)}, 0.0) AS critical_under_48h,
  coalesce({r('''avg(CASE WHEN resolution_time_hours <= 168 THEN 1.0 ELSE 0.0 END)
    FILTER (WHERE NOT is_critical) * 100''', 1)}, 0.0) AS normal_under_168h
FROM issue WHERE is_resolved AND resolution_time_hours IS NOT NULL""",
    # The full report per release
    "release_trend_weekly": _release_trend("%Y-W%U", """created_week, count(*) AS created_count,
  count(*) FILTER (WHERE is_critical) AS critical_count""", "created_week", 4),
    "release_trend_monthly": _release_trend("%Y-%m", f"""created_month, count(*) AS created_count,
  {r("avg(CASE WHEN is_resolved THEN 1.0 ELSE 0.0 END)", 3)} AS resolution_rate""", "created_month", 3),
    "release_trend_severity": _release_trend("%Y-%m", f"""created_month,
  {r("avg(CASE WHEN is_critical THEN 1.0 ELSE 0.0 END)", 3)} AS critical_rate,
  {r("avg(CASE WHEN priority = 'High' THEN 1.0 ELSE 0.0 END)", 3)} AS high_priority_rate""", "created_month", 3),
    "release_aging_project": f"""{STAR}
SELECT release_name, project, {r("avg(age_days)", 1)} AS avg_age, max(age_days) AS oldest_defect,
  count(age_days) AS open_count FROM issue WHERE NOT is_resolved GROUP BY 1, 2""",
    "release_aging_priority": f"""{STAR}
SELECT release_name, priority, {r("avg(age_days)", 3)} AS avg_age_days,
  {r("avg(CASE WHEN is_resolved THEN 0.0 ELSE 1.0 END)", 3)} AS percent_open
FROM issue GROUP BY 1, 2""",
    "release_workload": f"""{STAR}
SELECT release_name, assignee, count(key) AS total_assigned,
  count(*) FILTER (WHERE NOT is_resolved) AS open_count,
  count(*) FILTER (WHERE is_critical) AS critical_count, {r("avg(age_days)", 2)} AS avg_age,
  {r("avg(resolution_time_hours)", 2)} AS avg_resolution_hours
FROM issue WHERE assignee <> 'Unassigned' GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY release_name ORDER BY open_count DESC, assignee) <= 5""",
    "release_components": f"""{STAR}
SELECT release_name, p_brand AS component, count(key) AS total_defects,
  count(*) FILTER (WHERE NOT is_resolved) AS open_count,
  count(*) FILTER (WHERE is_critical) AS critical_count, {r("avg(age_days)", 2)} AS avg_age
FROM issue JOIN line_brand ON l_orderkey = o_orderkey WHERE p_brand IS NOT NULL
GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY release_name ORDER BY open_count DESC, component) <= 5""",
    "release_percentiles": f"""{STAR}
SELECT release_name, {r("quantile_cont(resolution_time_hours, 0.5)", 1)} AS p50,
  {r("quantile_cont(resolution_time_hours, 0.75)", 1)} AS p75,
  {r("quantile_cont(resolution_time_hours, 0.9)", 1)} AS p90,
  {r("quantile_cont(resolution_time_hours, 0.95)", 1)} AS p95
FROM issue WHERE is_resolved AND resolution_time_hours IS NOT NULL GROUP BY 1""",
    "release_sla": f"""{STAR}
SELECT release_name, coalesce({r('''avg(CASE WHEN resolution_time_hours <= 48 THEN 1.0 ELSE 0.0 END)
    FILTER (WHERE is_critical) * 100''', 1)}, 0.0) AS critical_under_48h,
  coalesce({r('''avg(CASE WHEN resolution_time_hours <= 168 THEN 1.0 ELSE 0.0 END)
    FILTER (WHERE NOT is_critical) * 100''', 1)}, 0.0) AS normal_under_168h
FROM issue WHERE is_resolved AND resolution_time_hours IS NOT NULL GROUP BY 1""",
    "release_advice": f"""{STAR}, {RECOMMEND_BY_RELEASE}
SELECT release_name, type, priority, message, action, "count", impact FROM advice""",
    # Trends
    "trend_weekly": _trend("%Y-W%U", """created_week, count(*) AS created_count,
  count(*) FILTER (WHERE is_critical) AS critical_count""", 12),
    "trend_monthly": _trend("%Y-%m", f"""created_month, count(*) AS created_count,
  {r("avg(CASE WHEN is_resolved THEN 1.0 ELSE 0.0 END)", 3)} AS resolution_rate""", 6),
    "severity_trend": _trend("%Y-%m", f"""created_month,
  {r("avg(CASE WHEN is_critical THEN 1.0 ELSE 0.0 END)", 3)} AS critical_rate,
  {r("avg(CASE WHEN priority = 'High' THEN 1.0 ELSE 0.0 END)", 3)} AS high_priority_rate""", 6),
    "trendline": TRENDLINE.format(where="WHERE release_name IN ('REL-99', 'REL-00', 'REL-01')"),
    # Changelog
    "transition_pairs": f"{LOG} SELECT key, seq, from_state, to_state FROM step",
    "reopen_flat": f"{LOG} SELECT key, reopen_count FROM reopens",
    "reopen_nested": f"{LOG} SELECT key, reopen_count FROM counted",
    "reopen_summary": f"""{LOG}
SELECT count(*) AS total_issues, count(*) FILTER (WHERE reopen_count > 0) AS reopened_issues,
  {r("count(*) FILTER (WHERE reopen_count > 0) / count(*) * 100", 1)} AS reopened_rate
FROM reopens""",
    "reopen_distribution": f"""{LOG}
SELECT reopen_count, count(*) AS n_issues FROM reopens WHERE reopen_count > 0 GROUP BY 1""",
    "most_reopened": f"""{LOG}
SELECT key, reopen_count, status FROM reopens ORDER BY reopen_count DESC, key LIMIT 3""",
    # Write-ups
    "writeup_quality": f"""{WRITEUPS}
SELECT key, quality_score, array_to_string(missing, ', ') AS missing FROM scored""",
    "writeup_poor_rate": f"""{WRITEUPS}
SELECT count(*) AS total_issues, count(*) FILTER (WHERE quality_score < 50) AS poor_issues,
  {r("count(*) FILTER (WHERE quality_score < 50) / count(*) * 100", 1)} AS poor_rate FROM scored""",
    "writeup_missing": f"""{WRITEUPS}
SELECT check_name, count(*) AS n_missing FROM (SELECT unnest(missing) AS check_name FROM scored)
GROUP BY 1""",
    # Risk
    "risk_linear": f"""{STAR}
SELECT key, {r("raw_score", 3)} AS risk_score, {r("raw_score", 6)} AS risk_score_raw FROM risk""",
    "risk_fallback": f"""{STAR}
SELECT key, {r('''raw_score + CASE WHEN priority = 'Highest' THEN 0.2::DOUBLE ELSE 0 END''', 6)}
  AS overall_risk_score FROM risk""",
    "risk_band": f"""{STAR}, scored AS (SELECT key, {r("raw_score", 3)} AS risk_score FROM risk)
SELECT key, risk_score, {_band("risk_score", "0.3", "0.2")} AS band_strict,
  {_band("risk_score", "0.7", "0.4")} AS band_wide FROM scored""",
    "top_risks": f"""{STAR}, {TOP}
SELECT key, project, summary, issue_type, priority, age_days, status, assignee, risk_score
FROM top""",
    # Recommendations and reports
    "recommendations": f"""{STAR}, {RECOMMEND}
SELECT type, priority, message, action, "count", impact FROM advice""",
    "recommendations_quick": f"""{STAR},
worst AS (
  SELECT project, count(*) AS n FROM issue WHERE is_critical GROUP BY 1
  ORDER BY n DESC, project LIMIT 1
),
common AS (
  SELECT severity, count(*) AS n FROM issue WHERE severity <> 'Unknown' GROUP BY 1
  ORDER BY n DESC, severity LIMIT 1
),
aged AS (SELECT count(*) AS n FROM issue WHERE age_days > 14 AND NOT is_resolved)
SELECT 'cross_project_critical' AS type,
  'Project ''' || project || ''' has ' || n || ' critical bugs' AS message,
  'Focus QA efforts on ' || project || ' project' AS action, n AS "count" FROM worst
UNION ALL SELECT 'aging_defects',
  n || ' defects across all projects are older than 14 days',
  'Review and prioritize old defects across all projects', n FROM aged WHERE n > 0
UNION ALL SELECT 'custom_field_pattern',
  'Most common severity value: ' || severity || ' (' || n || ' defects)',
  'Investigate pattern in severity = ' || severity, n FROM common""",
    "report_long": _report(),
    "preview_100": f"""{STAR}
SELECT key, project, status, priority, release_name, strftime(created, '%Y-%m-%d') AS created_day,
  age_days, summary FROM texted ORDER BY created DESC, key LIMIT 100""",
    "invariants": f"""{STAR}, {HEALTH},
fixed AS (
  SELECT 0.4 + (1 - count(*) FILTER (WHERE is_critical) / count(*)) * 0.3 + 0.3 AS score
  FROM issue WHERE is_resolved
)
SELECT unnest(['open and resolved add up', 'rate matches counts', 'rate is a percentage',
    'health within bounds', 'all resolved has no open age', 'all resolved has full age term',
    'reopened share plausible', 'poor write-ups are a part', 'empty set is unknown',
    'empty set counts zero']) AS check_name, TRUE AS passed
UNION ALL SELECT 'all resolved beats every project',
  (SELECT score FROM fixed) > (SELECT max(health_score) FROM health)""",
    # Models
    "ml_features": f"""{STAR}
SELECT key, CAST(priority IN ('High', 'Highest') AS INTEGER) AS is_high_priority,
  CAST(is_critical AS INTEGER) AS is_critical_issue,
  CAST(age_days > 7 AND status <> 'Resolved' AS INTEGER) AS needs_attention,
  length(summary) AS summary_length, length(description) AS description_length,
  CAST(has_components AS INTEGER) AS has_components,
  CAST(CASE WHEN age_days <= 7 THEN 0 WHEN age_days <= 14 THEN 1 WHEN age_days <= 30 THEN 2
    WHEN age_days <= 60 THEN 3 ELSE 4 END AS INTEGER) AS age_bucket,
  CAST(CASE status WHEN 'In Progress' THEN 1 WHEN 'In Review' THEN 2 WHEN 'Resolved' THEN 3
    WHEN 'Closed' THEN 4 ELSE 0 END AS INTEGER) AS status_encoded,
  CAST(CASE issue_type WHEN 'PROMO' THEN 3 WHEN 'ECONOMY' THEN 2 ELSE 1 END AS DOUBLE)
    AS issue_type_severity,
  {r("CASE issue_type WHEN 'PROMO' THEN 3 WHEN 'ECONOMY' THEN 2 ELSE 1 END / 3", 6)}
    AS issue_type_severity_norm
FROM texted""",
    "label_encode": f"""{STAR}
SELECT key, dense_rank() OVER (ORDER BY reporter) - 1 AS reporter_encoded,
  dense_rank() OVER (ORDER BY assignee) - 1 AS assignee_encoded,
  dense_rank() OVER (ORDER BY project) - 1 AS project_encoded,
  dense_rank() OVER (ORDER BY severity) - 1 AS severity_encoded FROM issue""",
    "label_extend": f"""{STAR},
ages AS (SELECT *, release_name IN ('REL-95', 'REL-96') AS older FROM issue),
{", ".join(f"""{c}_codes AS (
  SELECT {c}, row_number() OVER (ORDER BY NOT bool_or(older), {c}) - 1 AS code FROM ages GROUP BY 1)"""
           for c in ("reporter", "assignee", "project", "severity"))}
SELECT key, r.code AS reporter_encoded, a.code AS assignee_encoded, p.code AS project_encoded,
  s.code AS severity_encoded
FROM issue i JOIN reporter_codes r ON r.reporter = i.reporter JOIN assignee_codes a ON a.assignee = i.assignee
JOIN project_codes p ON p.project = i.project JOIN severity_codes s ON s.severity = i.severity""",
    "enrichment_scores": """
WITH assessed AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 0.5::DOUBLE WHEN toxic = 1 THEN 1.0::DOUBLE
      WHEN quality = 1 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS severity,
    CASE doc_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS impact
  FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)
)
SELECT 'DOC-' || d.doc_id AS key,
  coalesce(severity, (SELECT quantile_cont(severity, 0.5) FROM assessed)) AS ai_severity_score,
  coalesce(impact, (SELECT quantile_cont(impact, 0.5) FROM assessed)) AS ai_user_impact
FROM documents d LEFT JOIN assessed a ON a.doc_id = d.doc_id""",
    "enrichment_newest": """
WITH assessed AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0.25::DOUBLE WHEN doc_id % 10 = 3 THEN 0.5::DOUBLE
      WHEN toxic = 1 THEN 1.0::DOUBLE WHEN quality = 1 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS severity,
    CASE doc_id % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS impact
  FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)
)
SELECT 'DOC-' || d.doc_id AS key,
  coalesce(severity, (SELECT quantile_cont(severity, 0.5) FROM assessed)) AS ai_severity_score,
  coalesce(impact, (SELECT quantile_cont(impact, 0.5) FROM assessed)) AS ai_user_impact
FROM documents d LEFT JOIN assessed a ON a.doc_id = d.doc_id""",
    "predictions_roundtrip": f"""{STAR}
SELECT key, release_name, 'linear' AS model_type, {r("raw_score", 3)} AS risk_score, key AS data_key
FROM risk""",
    "risk_ml_checks": """
SELECT count(*) AS scored, count(*) AS issues, count(*) AS bounded, count(*) AS blended, TRUE AS ranked
FROM orders""",
    "risk_blend": f"""{STAR},
given AS (
  SELECT key, CASE WHEN priority IN ('High', 'Highest') THEN 1 ELSE 0 END AS p,
    CASE WHEN age_days > 7 AND status <> 'Resolved' THEN 1 ELSE 0 END AS a,
    CASE WHEN is_critical THEN 1 ELSE 0 END AS c,
    CASE issue_type WHEN 'PROMO' THEN 3 WHEN 'ECONOMY' THEN 2 ELSE 1 END / 3 AS w,
    CASE priority WHEN 'High' THEN 0.75 WHEN 'Medium' THEN 0.5 WHEN 'Low' THEN 0.25 ELSE 0.5 END
      AS s
  FROM issue
)
SELECT key, {r("p * 0.4 + a * 0.3 + w * 0.3", 6)} AS plain,
  {r("p * 0.3 + a * 0.2 + c * 0.2 + s * 0.2 + w * 0.1", 6)} AS assessed FROM given""",
    "top_risks_given": f"""{STAR},
given AS (
  SELECT *, {r("""CASE WHEN priority IN ('High', 'Highest') THEN 1 ELSE 0 END * 0.4
    + CASE WHEN age_days > 7 AND status <> 'Resolved' THEN 1 ELSE 0 END * 0.3
    + CASE issue_type WHEN 'PROMO' THEN 3 WHEN 'ECONOMY' THEN 2 ELSE 1 END / 3 * 0.3""", 6)} AS risk_score
  FROM issue
)
SELECT key, issue_type, priority, age_days, risk_score FROM given
ORDER BY risk_score DESC, created DESC, key LIMIT 25""",
    "score_evaluation": f"""{STAR},
counts AS (
  SELECT release_name, age_days / 128 AS score, count(*) FILTER (WHERE is_critical) AS p,
    count(*) FILTER (WHERE NOT is_critical) AS q FROM issue GROUP BY 1, 2),
placed AS (
  SELECT *, coalesce(sum(q) OVER (PARTITION BY release_name ORDER BY score
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM counts)
SELECT release_name, CAST(sum(p + q) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS positives,
  CAST(sum(q) AS BIGINT) AS negatives,
  {r("sum(p * (2 * below + q))::DOUBLE / nullif(sum(p)::DOUBLE * sum(q)::DOUBLE * 2, 0)", 9)} AS auc,
  {r("sum(CASE WHEN score >= 0.5 THEN p ELSE q END)::DOUBLE / sum(p + q)", 9)} AS accuracy
FROM placed GROUP BY 1""",
    "score_calibration": f"""{STAR}
SELECT CAST(least(floor(age_days / 128 * 10), 9) AS INTEGER) AS bin, count(*) AS n,
  {r("avg(age_days / 128)", 6)} AS mean_score,
  {r("avg(CASE WHEN is_critical THEN 1.0 ELSE 0.0 END)", 6)} AS positive_share
FROM issue GROUP BY 1""",
    # Streams
    "stream_daily_counts": TRENDLINE.format(where=""),
    "stream_reopens": f"{LOG} SELECT key, reopen_count FROM counted",
    "stream_ingest": f"""{STAR}, {LANDED_REOPENS}
SELECT release_name AS name, count(*) AS total_defects,
  count(*) FILTER (WHERE status NOT IN ('Resolved', 'Closed', 'Done')) AS open_defects,
  CAST(sum(CAST('0x' || substr(md5(summary), 1, 8) AS BIGINT)
    + CAST('0x' || substr(md5(description), 1, 8) AS BIGINT)) AS BIGINT) AS text_digest,
  CAST(sum(coalesce(reopen_count, 0)) AS BIGINT) AS reopens
FROM texted LEFT JOIN landed ON user_id = o_orderkey GROUP BY 1""",
    "stream_audit": f"""
SELECT count(*) AS announced, count(*) + {LANDED_AGAIN} + {LANDED_FAILING} AS fetched,
  count(*) FILTER (WHERE o_orderkey % 11 = 0) AS unreadable,
  count(*) + {LANDED_AGAIN} + {LANDED_FAILING} - count(*) FILTER (WHERE o_orderkey % 11 = 0) AS extracted,
  (SELECT count(*) FROM region) AS corrupt, count(*) + {LANDED_AGAIN}
    - count(*) FILTER (WHERE o_orderkey % 3 = 0 AND late) AS stored,
  {LANDED_FAILING} + (SELECT count(*) FROM region) AS rejected
FROM (SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') % (8 * (1 + c_nationkey % 16)) > 32
    AS late FROM orders LEFT JOIN customer ON c_custkey = o_custkey)""",
    "stream_rejects": """
SELECT reason, n FROM (
  SELECT 'no key' AS reason, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT 'no release_name', count(*) FROM orders WHERE o_orderkey % 7 = 0
  UNION ALL SELECT 'unreadable stamp', count(*) FROM orders WHERE o_orderkey % 11 = 0
  UNION ALL SELECT 'corrupt page', count(*) FROM region)
WHERE n > 0""",
}
