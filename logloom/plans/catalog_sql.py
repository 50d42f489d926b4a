"""DuckDB SQL that answers the registered queries a second way, with plain windows and joins."""

from logloom.operators.augment import ERROR_CODES, VALUE_POOL
from logloom.operators.enrich import CAUSALITY_RULES, SEVERITY_RULES
from logloom.operators.templates import MASKS

HASH32 = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts if p)


def _masked(column: str) -> str:
    for kind, pattern in MASKS:
        column = f"regexp_replace({column}, '{pattern}', '<{kind}>', 'g')"
    return column


def _rules(column: str, rules, default: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{label}'" for p, label in rules)
    return f"(CASE {cases} ELSE '{default}' END)"


# ---- run logs ----------------------------------------------------------------

EVENT_LINES = """
ev AS (
  SELECT 'run_' || user_id || '_' || strftime(ts, '%Y%m%d') AS run_id, ts, event_id, user_id,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, user_id % 17 <> 0 AS tested,
    CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_id % 11 = 0 THEN 'SKIPPED' ELSE 'PASSED' END AS status,
    'test_' || event_type || '_' || (event_id % 7) AS test
  FROM events),
ev2 AS (
  SELECT *, CASE WHEN NOT tested THEN '[' || stamp || '] INFO heartbeat ' || event_id
    WHEN user_id % 2 = 0 THEN '[' || stamp || '] TESTCASE: ' || test || ' ' || status
    ELSE 'Test case ' || test || ': ' || status END AS main
  FROM ev),
ends AS (
  SELECT run_id, max(ts) AS ts, max(event_id) AS event_id, count(*) AS n,
    count(*) FILTER (status = 'PASSED') AS p, count(*) FILTER (status = 'FAILED') AS f
  FROM ev WHERE user_id % 3 = 0 AND tested GROUP BY run_id),
raw AS (
  SELECT run_id, 0 AS blk, ts, event_id, 0 AS k, main AS line FROM ev2
  UNION ALL SELECT run_id, 0, ts, event_id, 1, 'Error: code ' || (event_id % 5) || ' value ' || event_id
    FROM ev2 WHERE tested AND status = 'FAILED'
  UNION ALL SELECT run_id, 0, ts, event_id, 2, 'Output validation PASSED' FROM ev2 WHERE tested AND event_id % 5 = 0
  UNION ALL SELECT run_id, 0, ts, event_id, 3, main FROM ev2 WHERE tested AND event_id % 13 = 0
  UNION ALL SELECT run_id, 1, ts, event_id, u.k, (['TEST EXECUTION SUMMARY', 'Total test cases: ' || (n + 1),
      'Passed: ' || (n + 1), 'Failed: 0', 'Pass rate: 100.0'])[u.k + 1] FROM ends, unnest(range(5)) u(k)
  UNION ALL SELECT run_id, 2, ts, event_id, u.k, (['TEST EXECUTION SUMMARY', 'Total test cases: ' || n,
      'Passed: ' || p, 'Failed: ' || f])[u.k + 1] FROM ends, unnest(range(4)) u(k)),
lines AS (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY blk, ts, event_id, k) - 1 AS line_no, line,
    strftime(ts, '%Y-%m-%d') AS day
  FROM raw)
"""

DOCUMENT_LOGS = """
logs AS (
  SELECT doc_id, 'doc_' || doc_id AS run_id,
    CASE WHEN doc_id % 11 = 0 THEN text ELSE array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
      CASE WHEN (i - 1) % 3 = 0 THEN '[2024-06-01 10:' || lpad((((i - 1) // 60) % 60)::VARCHAR, 2, '0') || ':'
          || lpad(((i - 1) % 60)::VARCHAR, 2, '0') || '] TESTCASE: test_error_' || ((i - 1) % 9) || ' '
          || (CASE WHEN doc_id % 4 = 0 THEN 'PASSED' WHEN (doc_id + i - 1) % 5 = 0 THEN 'FAILED'
              WHEN (doc_id + i - 1) % 7 = 0 THEN 'SKIPPED' ELSE 'PASSED' END)
          || chr(10) || x
        WHEN (i - 1) % 3 = 1 THEN 'Error: ' || x ELSE x END), chr(10)) END AS log_content
  FROM documents)
"""

DOCUMENT_LINES = r"""
split_logs AS (SELECT run_id, regexp_split_to_array(log_content, '\r\n|\n|\r') AS parts FROM logs),
lines AS (SELECT run_id, u.i AS line_no, parts[u.i + 1] AS line FROM split_logs, unnest(range(len(parts))) u(i))
"""

# ---- verdict -----------------------------------------------------------------

STAMP = r"^\s*(?:\[[^\]]*\]\s*)?"
TESTS = rf"""
tests AS (
  SELECT * FROM (
    SELECT run_id, line_no, coalesce(
        nullif(regexp_extract(line, '(?i){STAMP}test\s+case\s+(\S.*?)\s*:\s*(passed|failed|skipped)\s*$', 1), ''),
        nullif(regexp_extract(line, '(?i){STAMP}testcase:\s*(\S.*?)\s+(passed|failed|skipped)\s*$', 1), '')) AS test_name,
      upper(regexp_extract(line, '(?i)(passed|failed|skipped)\s*$', 1)) AS status
    FROM lines) WHERE test_name IS NOT NULL),
outcomes AS (
  SELECT run_id, test_name, arg_max(status, line_no) AS status, min(line_no) AS first_line, max(line_no) AS last_line
  FROM tests GROUP BY run_id, test_name)
"""
FIELD = rf"(?i){STAMP}(total\s+test\s+cases|passed|failed|pass\s+rate)\s*:\s*([0-9]+(?:\.[0-9]+)?)\s*%?\s*$"
SUMMARY = rf"""
fields AS (
  SELECT run_id, line_no, regexp_matches(line, '(?i)\btest\s+execution\s+summary\b') AS is_header,
    lower(regexp_replace(regexp_extract(line, '{FIELD}', 1), '\s+', ' ', 'g')) AS field,
    try_cast(regexp_extract(line, '{FIELD}', 2) AS DOUBLE) AS v
  FROM lines),
placed AS (
  SELECT *, max(CASE WHEN is_header THEN line_no END) OVER (PARTITION BY run_id ORDER BY line_no) AS h FROM fields),
blocks AS (
  SELECT run_id, h, arg_min(v, line_no) FILTER (field = 'total test cases') AS total,
    arg_min(v, line_no) FILTER (field = 'passed') AS passed, arg_min(v, line_no) FILTER (field = 'failed') AS failed,
    arg_min(v, line_no) FILTER (field = 'pass rate') AS rate
  FROM placed WHERE h IS NOT NULL GROUP BY run_id, h),
summaries AS (
  SELECT run_id, total AS sum_total, passed AS sum_passed, failed AS sum_failed, rate AS sum_rate FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY h DESC) AS r FROM blocks
    WHERE total IS NOT NULL AND passed IS NOT NULL AND failed IS NOT NULL) WHERE r = 1)
"""
VERDICTS = r"""
per_run AS (
  SELECT run_id, count(*) AS n_lines,
    max(s) - min(s) AS elapsed_seconds
  FROM (SELECT run_id, epoch(try_cast(nullif(regexp_extract(line, '^\s*\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\]', 1), '') AS TIMESTAMP))::BIGINT AS s
    FROM lines) GROUP BY run_id),
counts AS (
  SELECT run_id, count(*) AS n_tests, count(*) FILTER (status = 'PASSED') AS n_passed,
    count(*) FILTER (status = 'FAILED') AS n_failed FROM outcomes GROUP BY run_id),
merged AS (
  SELECT r.run_id, n_lines, elapsed_seconds, n_tests, n_passed, n_failed, sum_total, sum_rate,
    coalesce(sum_total::BIGINT, n_tests) AS total, coalesce(sum_passed::BIGINT, n_passed) AS passed,
    coalesce(sum_failed::BIGINT, n_failed) AS failed
  FROM per_run r LEFT JOIN counts USING (run_id) LEFT JOIN summaries USING (run_id)),
verdicts AS (
  SELECT run_id, n_lines, elapsed_seconds, total, passed, failed,
    CASE WHEN total IS NULL THEN 'UNKNOWN' WHEN failed = 0 AND passed = total THEN 'ALL_PASSED' ELSE 'SOME_FAILED' END AS overall_status,
    CASE WHEN failed = 0 AND passed = total THEN 'passed' ELSE 'failed' END AS test_status,
    coalesce(sum_rate, CASE WHEN total > 0 THEN round(passed::DOUBLE / total * 100, 2) END) AS pass_rate,
    concat_ws('; ', CASE WHEN sum_total IS NOT NULL THEN 'summary block' WHEN n_tests IS NOT NULL THEN 'per-test lines'
        ELSE 'no summary block and no per-test lines' END,
      CASE WHEN sum_total IS NOT NULL AND n_tests IS NOT NULL AND (n_tests <> total OR n_passed <> passed OR n_failed <> failed)
        THEN 'per-test lines give total=' || n_tests || ' passed=' || n_passed || ' failed=' || n_failed END) AS notes
  FROM merged)
"""
VERDICT_PARTS = (TESTS, SUMMARY, VERDICTS)
VERDICT_SELECT = "SELECT run_id, overall_status, test_status, total, passed, failed, pass_rate, notes FROM verdicts"

# ---- reports -----------------------------------------------------------------

REPORTS = rf"""
failures AS (
  SELECT o.run_id, test_name, first_line FROM outcomes o JOIN verdicts USING (run_id)
  WHERE status = 'FAILED' AND test_status = 'failed'),
mixed AS (
  SELECT run_id, line_no, NULL AS line, test_name, status FROM tests
  UNION ALL SELECT run_id, line_no, line, NULL, NULL FROM lines WHERE regexp_matches(line, '^\s*(?:Error|Stacktrace):')),
marked AS (
  SELECT *, max(CASE WHEN test_name IS NOT NULL THEN line_no END) OVER (PARTITION BY run_id ORDER BY line_no) AS m FROM mixed),
errors AS (
  SELECT e.run_id, t.test_name, {_masked("e.line")} AS message, count(*) AS n, min(e.line_no) AS first_line,
    arg_min(e.line, e.line_no) AS example
  FROM marked e JOIN tests t ON t.run_id = e.run_id AND t.line_no = e.m AND t.status = 'FAILED'
  WHERE e.line IS NOT NULL GROUP BY 1, 2, 3),
causes AS (
  SELECT run_id, test_name, {_rules("message", CAUSALITY_RULES, "Application")} AS cause, sum(n) AS n
  FROM errors GROUP BY 1, 2, 3),
cause_texts AS (
  SELECT run_id, test_name, string_agg(cause || ' x' || n, ', ' ORDER BY cause) AS causes FROM causes GROUP BY 1, 2),
error_texts AS (
  SELECT run_id, test_name, sum(n) || ' error lines of ' || count(*) || ' kinds; first: ' || arg_min(example, first_line)
    || '; last: ' || arg_max(example, first_line) AS errors FROM errors GROUP BY 1, 2),
explained AS (
  SELECT f.run_id, f.test_name, f.first_line, coalesce(errors || '; likely causes: ' || causes, 'no error lines') AS explanation
  FROM failures f LEFT JOIN error_texts e ON e.run_id = f.run_id AND e.test_name = f.test_name
  LEFT JOIN cause_texts c ON c.run_id = f.run_id AND c.test_name = f.test_name),
listed AS (
  SELECT run_id, string_agg('- ' || test_name || ': ' || explanation, chr(10) ORDER BY first_line, test_name) AS listed
  FROM explained GROUP BY run_id),
runs AS (
  SELECT v.*, CASE WHEN test_status = 'failed' THEN 'Status: ' || overall_status || ' (' || notes || ')' || chr(10)
      || 'Failed tests:' || chr(10) || coalesce(listed, 'None identified') END AS failure_report,
    CASE WHEN test_status = 'passed' THEN 'Total tests: ' || total || chr(10) || 'Execution time: '
      || coalesce(elapsed_seconds || ' s', 'not available') || chr(10)
      || 'Highlights: all tests passed, decided by ' || notes END AS summary_report
  FROM verdicts v LEFT JOIN listed USING (run_id))
"""
REPORT_PARTS = (*VERDICT_PARTS, REPORTS)
TICKETS = f"""
tickets AS (
  SELECT run_id, first_line, 'TEST-' || ({HASH32.format("test_name")} % 10000) AS ticket_id,
    'Test failed: ' || test_name AS summary, 'Run ' || run_id || ': ' || explanation AS description,
    test_name AS testcase, 'created' AS status FROM explained)
"""
TIPS = """
written AS (
  SELECT f.test_name AS key, f.explanation AS analysis, r.run_id FROM runs r JOIN explained f USING (run_id)
  UNION ALL SELECT 'last_success', summary_report, run_id FROM runs WHERE test_status = 'passed'),
tips AS (
  SELECT 'global_tips' AS namespace, key, run_id, analysis FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY split_part(run_id, '_', 3) DESC, run_id DESC) AS r FROM written)
  WHERE r = 1)
"""

# ---- templates ---------------------------------------------------------------

TEMPLATES = f"""
masked AS (SELECT *, {_masked("line")} AS template FROM lines WHERE regexp_matches(line, '\\S')),
templates AS (
  SELECT md5(template) AS template_id, template, count(*) AS n_lines, count(DISTINCT run_id) AS n_runs,
    (min({{'r': run_id, 'l': line_no}})).r AS first_run, (min({{'r': run_id, 'l': line_no}})).l AS first_line
  FROM masked GROUP BY template)
"""


def _similar(free_text: int, similarity: float = 0.6, support: int = 5, rounds: int = 4) -> str:
    """Rows ``likened`` (template, merged, kind) of the templates, by position partitioning."""
    steps = [r"p0 AS (SELECT template, regexp_split_to_array(trim(template), '\s+') AS t, '' AS part, true AS open FROM templates)"]
    steps.append("q0 AS (SELECT template, t, len(t)::VARCHAR AS part, open FROM p0)")
    for i in range(rounds):
        steps.append(
            f"c{i} AS (SELECT part, pos, t[pos] AS tok, count(*) AS n FROM q{i}, unnest(range(1, len(t) + 1)) u(pos) WHERE open GROUP BY ALL)"
        )
        steps.append(
            f"h{i} AS (SELECT part, (min(CASE WHEN d > 1 AND top >= {support} THEN {{'d': d, 'pos': pos}} END)).pos AS pos FROM "
            f"(SELECT part, pos, count(*) AS d, max(n) AS top FROM c{i} GROUP BY ALL) GROUP BY part "
            f"HAVING avg((d = 1)::INT) < {similarity} AND count(CASE WHEN d > 1 AND top >= {support} THEN 1 END) > 0)"
        )
        steps.append(
            f"q{i + 1} AS (SELECT q.template, q.t, q.open AND h.part IS NOT NULL AS open, CASE WHEN h.part IS NULL THEN q.part "
            f"ELSE q.part || '/' || h.pos || '=' || coalesce('t' || c.tok, '') END AS part FROM q{i} q LEFT JOIN h{i} h ON h.part = q.part AND q.open "
            f"LEFT JOIN c{i} c ON c.part = q.part AND c.pos = h.pos AND c.tok = q.t[h.pos] AND c.n >= {support})"
        )
    steps.append(
        f"parts AS (SELECT part, max(m) AS m, avg((d = 1)::INT) AS alike, list(d = 1 ORDER BY pos) AS same FROM "
        f"(SELECT part, pos, count(DISTINCT t[pos]) AS d, count(*) AS m FROM q{rounds}, unnest(range(1, len(t) + 1)) u(pos) GROUP BY ALL) GROUP BY part)"
    )
    steps.append(
        f"wide AS (SELECT template, list_transform(t, lambda x, i: CASE WHEN same[i] THEN x ELSE '<*>' END) AS w, CASE WHEN m = 1 THEN 'single' "
        f"WHEN alike >= {similarity} THEN 'similar' WHEN m >= {free_text} THEN 'free text' ELSE 'single' END AS kind "
        f"FROM q{rounds} JOIN parts USING (part))"
    )
    steps.append(
        "likened AS (SELECT template, kind, CASE WHEN kind = 'single' THEN template ELSE array_to_string("
        "list_filter(w, lambda x, i: x <> '<*>' OR i = 1 OR w[i - 1] <> '<*>'), ' ') END AS merged FROM wide)"
    )
    steps.append(
        "merged AS (SELECT md5(merged) AS template_id, merged AS template, min(kind) AS kind, sum(n_lines)::BIGINT AS n_lines, count(*) AS n_templates, "
        "(min({'r': first_run, 'l': first_line})).r AS first_run, (min({'r': first_run, 'l': first_line})).l AS first_line "
        "FROM templates JOIN likened USING (template) GROUP BY merged)"
    )
    return ",\n".join(steps)


TEXT_LINES = r"""
lines AS (
  SELECT 'doc_' || doc_id AS run_id, i - 1 AS line_no, l[i] AS line
  FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS l FROM documents), unnest(range(1, len(l) + 1)) u(i))
"""
LABELLED = f"""
labelled AS (
  SELECT template, {_rules("template", SEVERITY_RULES, "INFO")} AS severity,
    {_rules("template", CAUSALITY_RULES, "Application")} AS causality FROM templates)
"""
KEY = r"trim(regexp_replace(lower(regexp_replace(template, '<[A-Za-z0-9_*]+>', '<*>', 'g')), '\s+', ' ', 'g'))"
ENRICHED = rf"""
sme_rows AS (
  SELECT '[<when>]  TestCase: test_' || event_type || '_1 ' || s AS template, 'WARN' AS severity, 'System' AS causality,
    'known ' || event_type AS summary, 'rerun ' || event_type AS resolution
  FROM (SELECT DISTINCT event_type FROM events), unnest(['PASSED', 'FAILED']) u(s)
  UNION ALL SELECT '[<when>]  TestCase: test_' || event_type || '_1 FAILED', 'WARN', 'System', 'known ' || event_type, 'ask the owner'
  FROM (SELECT DISTINCT event_type FROM events)
  UNION ALL SELECT 'site ' || n_name || ' unreachable', 'ERROR', 'Network', n_name || ' is down', 'call the site' FROM nation),
sme AS (SELECT {KEY} AS key, * FROM sme_rows),
keys AS (SELECT {KEY} AS key, * FROM templates),
keyed AS (
  SELECT t.key, t.template, l.severity, l.causality, t.first_run, t.first_line,
    l.causality || ' ' || lower(l.severity) || ' message: ' || t.template AS summary
  FROM keys t JOIN labelled l ON l.template = t.template),
pending AS (
  SELECT coalesce(k.template, s.template) AS template, coalesce(s.severity, k.severity) AS severity,
    coalesce(s.causality, k.causality) AS causality, coalesce(s.summary, k.summary) AS summary,
    CASE WHEN s.key IS NOT NULL THEN 'SME' ELSE 'AI Suggested' END AS source, s.resolution,
    n.line AS match, CASE WHEN k.key IS NOT NULL THEN 1 ELSE 0 END AS n_values
  FROM keyed k FULL OUTER JOIN sme s ON k.key = s.key
  LEFT JOIN lines n ON n.run_id = k.first_run AND n.line_no = k.first_line)
"""


def _pool(pools: dict[str, list[str]], kind: str, number: str, default: str) -> str:
    entries = ", ".join(
        f"'{k}': [" + ", ".join(f"'{v}'" for v in values) + "]" for k, values in pools.items()
    )
    table = f"(MAP {{{entries}}})"
    chosen = f"coalesce({table}[{kind}], {table}['{default}'])"
    return f"{chosen}[({number} % len({chosen})) + 1]"


KINDS = "|".join(k.replace("*", r"\*") for k in VALUE_POOL)
DRAW = HASH32.format("template || '|' || variant_no || '|' || {0}")
VARIANTS = rf"""
numbered AS (
  SELECT l.*, u.i AS variant_no FROM labelled l,
    unnest(range(1, {HASH32.format("l.template")} % 3 + 4)) u(i)),
drawn AS (
  SELECT *, list_transform(regexp_extract_all(template, '<({KINDS})>', 1),
      lambda kind, i: {_pool(VALUE_POOL, "kind", DRAW.format("(i - 1)"), "*")}) AS picked,
    regexp_split_to_array(template, '<(?:{KINDS})>') AS texts,
    {_pool(ERROR_CODES, "causality", DRAW.format("'code'"), "Application")} AS code
  FROM numbered),
variants AS (
  SELECT *, array_to_string(list_transform(texts, lambda t, i: t || coalesce(picked[i], '')), '') AS match FROM drawn)
"""

# ---- vectors -----------------------------------------------------------------


def _embedding(name: str, rows: str) -> str:
    """CTE ``name`` (id, n_chunks, v FLOAT[64]) of rows (id, text) by word hashing."""
    return rf"""
{name}_chunks AS (
  SELECT id, u.i AS chunk_no, substring(text, u.i * 700 + 1, 800) AS chunk
  FROM ({rows}), unnest(range(CASE WHEN length(text) > 0 THEN (length(text) - 1) // 700 + 1 ELSE 0 END)) u(i)),
{name}_words AS (
  SELECT id, md5(w) AS m FROM (SELECT id, unnest(regexp_extract_all(lower(chunk), '[\p{{L}}\p{{N}}]+')) AS w FROM {name}_chunks)),
{name}_sums AS (
  SELECT id, ('0x' || substr(m, 1, 8))::BIGINT % 64 AS pos, sum(CASE WHEN substr(m, 9, 1) < '8' THEN 1 ELSE -1 END) AS s
  FROM {name}_words GROUP BY 1, 2),
{name}_counts AS (SELECT id, count(*) AS n_chunks FROM {name}_chunks GROUP BY id),
{name}_grid AS (
  SELECT id, n_chunks, u.pos, coalesce(s, 0) / n_chunks AS x
  FROM {name}_counts CROSS JOIN unnest(range(64)) u(pos) LEFT JOIN {name}_sums USING (id, pos)),
{name} AS (
  SELECT id, n_chunks, list((x / CASE WHEN norm = 0 THEN 1 ELSE norm END)::FLOAT ORDER BY pos) AS v FROM (
    SELECT *, sqrt(sum(x * x) OVER (PARTITION BY id)) AS norm FROM {name}_grid) GROUP BY id, n_chunks)
"""


def _hits(queries: str, vectors: str, k: int) -> str:
    """CTE ``hits`` (query_id, vec_id, distance, rank) from CTEs with (id, v)."""
    return f"""
unit_q AS (SELECT id, list_transform(v, lambda x: x::DOUBLE) AS v FROM {queries}),
unit_v AS (SELECT id, list_transform(v, lambda x: x::DOUBLE) AS v FROM {vectors}),
pairs AS (
  SELECT q.id AS query_id, p.id AS vec_id, round(greatest(0.0, 1 - list_inner_product(q.v, p.v)
      / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(p.v, p.v))), 9) AS distance
  FROM unit_q q, unit_v p WHERE list_inner_product(q.v, q.v) > 0 AND list_inner_product(p.v, p.v) > 0),
hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
  WHERE rank <= {k})
"""


ISSUES = "SELECT 'item_' || lpad(item_id::VARCHAR, 9, '0') AS id, text FROM benchmark"
STORED = "stored AS (SELECT vec_id AS id, embedding AS v FROM embeddings)"

FENCE = "```"
JSON = rf"""
replies AS (
  SELECT event_id, CASE event_id % 8 WHEN 0 THEN props
    WHEN 1 THEN 'Sure:' || chr(10) || '{FENCE}json' || chr(10) || props || chr(10) || '{FENCE}' || chr(10) || 'Done {{x}}'
    WHEN 2 THEN 'The answer is ' || props || ' as asked'
    WHEN 3 THEN 'Only one: [' || props || ']' WHEN 4 THEN 'Two: [' || props || ', ' || props || '] end'
    WHEN 5 THEN '[' || props || ', ' || props || ']' WHEN 6 THEN 'no json for ' || event_id
    ELSE '{{"overall_status": "ALL_PASSED", "k": ' || event_id || '}}' END AS reply FROM events),
tries AS (
  SELECT *, regexp_extract(reply, '(?s){FENCE}json\s*(.*?)\s*{FENCE}', 1) AS fenced,
    regexp_extract(reply, '(?s)(\{{.*\}})', 1) AS braced FROM replies),
found AS (
  SELECT *, CASE WHEN json_valid(reply) THEN reply WHEN json_valid(fenced) THEN fenced
    WHEN json_valid(braced) THEN braced END AS j FROM tries)
"""

ORACLE_SQL = {
    "t_verdict": _with(EVENT_LINES, *VERDICT_PARTS) + VERDICT_SELECT,
    "t_verdict_documents": _with(DOCUMENT_LOGS, DOCUMENT_LINES, *VERDICT_PARTS) + VERDICT_SELECT,
    "t_summary_block": _with(EVENT_LINES, SUMMARY) + "SELECT * FROM summaries",
    "t_failed_list": _with(EVENT_LINES, TESTS)
    + "SELECT run_id, count(*) AS n_failed, string_agg(test_name, chr(10) ORDER BY first_line) AS failed_tests "
    "FROM outcomes WHERE status = 'FAILED' GROUP BY run_id",
    "t_per_test": _with(EVENT_LINES, TESTS) + "SELECT run_id, test_name, status, first_line, last_line FROM outcomes",
    "t_records": _with(EVENT_LINES, *VERDICT_PARTS)
    + """SELECT v.run_id, overall_status,
      string_agg(test_name, ',' ORDER BY first_line) FILTER (status = 'FAILED') AS failed_tests,
      string_agg(test_name || '=' || status, ',' ORDER BY test_name || '=' || status) AS per_test
    FROM verdicts v LEFT JOIN outcomes o ON o.run_id = v.run_id GROUP BY v.run_id, overall_status""",
    "s_failed_regex": _with(DOCUMENT_LOGS)
    + r"""SELECT run_id, len(f) AS n_found, array_to_string(f, '|') AS found FROM (
      SELECT run_id, regexp_extract_all(log_content, 'TESTCASE:\s*(.*?)\s*FAILED', 1) AS f FROM logs)""",
    "s_json_extract": _with(JSON)
    + """SELECT event_id, json_extract_string(j, '$.k') AS k,
      coalesce(json_type(j) = 'ARRAY' AND json_array_length(j) > 0, false) AS is_list,
      json_extract_string(j, '$[1].k') AS second_k,
      CASE WHEN NOT json_valid(reply) THEN reply END AS raw,
      CASE WHEN json_valid(reply) AND json_extract_string(reply, '$.overall_status') = 'ALL_PASSED'
        THEN 'passed' ELSE 'failed' END AS reply_status FROM found""",
    "s_chunks": """SELECT doc_id, u.i AS chunk_no, substring(text, u.i * 700 + 1, 800) AS chunk
      FROM documents, unnest(range(CASE WHEN length(text) > 0 THEN (length(text) - 1) // 700 + 1 ELSE 0 END)) u(i)""",
    "s_truncate": """SELECT doc_id, substring(text, 1, 500) AS template, substring(text, 1, 200) AS summary,
      length(text) AS n_chars FROM documents""",
    "s_blank_guard": r"""SELECT doc_id, count(*) FILTER (NOT regexp_matches(line, '[^\s\x0b\p{Z}\x{85}]')) AS n_blank,
      count(*) FILTER (regexp_matches(line, '[^\s\x0b\p{Z}\x{85}]')) AS n_kept
      FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line FROM documents) GROUP BY doc_id""",
    "s_ticket_ids": f"""SELECT testcase, count(*) AS n, 'TEST-' || ({HASH32.format("testcase")} % 10000) AS ticket_id,
      sha256('tickets' || chr(1) || testcase) AS record_id
      FROM (SELECT event_type || '_' || user_id AS testcase FROM events) GROUP BY testcase""",
    "v_normalize": """WITH scaled AS (
      SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5)::DOUBLE) AS v FROM embeddings),
      normed AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM scaled)
      SELECT vec_id, round(n, 6) AS norm, u.i AS pos, round(v[u.i + 1] / CASE WHEN n = 0 THEN 1 ELSE n END, 6) + 0.0::DOUBLE AS x
      FROM normed, unnest(range(len(v))) u(i)""",
    "v_topk": _with(STORED, _hits("stored", "stored", 5))
    + "SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM hits",
    "v_topk_labelled": _with(STORED, _hits("stored", "stored", 5))
    + """SELECT query_id, label, votes FROM (
      SELECT query_id, label::BIGINT AS label, count(*) AS votes,
        row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) AS r
      FROM hits JOIN embeddings e ON e.vec_id = hits.vec_id GROUP BY query_id, label) WHERE r = 1""",
    "v_topk_lines": """WITH lines AS (
        SELECT l_partkey, l_orderkey * 8 + l_linenumber AS vec_id, (l_quantity - 25.5) / 15 AS a, (l_extendedprice - 50000) / 30000 AS b,
          (l_discount - 0.05) / 0.03 AS c, (l_tax - 0.04) / 0.03 AS d FROM lineitem
      ), unit AS (SELECT vec_id, a / n AS a, b / n AS b, c / n AS c, d / n AS d FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS n FROM lines) WHERE n > 0),
      means AS (SELECT l_partkey AS query_id, avg(a) AS a, avg(b) AS b, avg(c) AS c, avg(d) AS d FROM lines GROUP BY l_partkey),
      asked AS (SELECT query_id, a / n AS a, b / n AS b, c / n AS c, d / n AS d FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS n FROM means) WHERE n > 0),
      best AS (
        SELECT query_id, arg_min(u.vec_id, (round(greatest(0, 1 - (q.a * u.a + q.b * u.b + q.c * u.c + q.d * u.d)), 9), u.vec_id), 5) AS ids,
          min((round(greatest(0, 1 - (q.a * u.a + q.b * u.b + q.c * u.c + q.d * u.d)), 9), u.vec_id), 5) AS near
        FROM asked q, unit u GROUP BY query_id)
      SELECT query_id, r AS rank, ids[r] AS vec_id, round(near[r][1], 6) + 0.0::DOUBLE AS distance FROM best, unnest(range(1, 6)) x(r)""",
    "v_mean_pool": """SELECT label::BIGINT AS label, count(*) AS n_vectors, u.i AS pos,
      round(avg(embedding[u.i + 1]::DOUBLE), 6) + 0.0::DOUBLE AS x
      FROM embeddings, unnest(range(len(embedding))) u(i) GROUP BY label, u.i""",
    "v_embed_index": _with(_embedding("emb", "SELECT doc_id AS id, text FROM documents"))
    + """SELECT id AS doc_id, n_chunks, u.i AS pos, round(v[u.i + 1]::DOUBLE, 5) + 0.0::DOUBLE AS x
      FROM emb, unnest(range(64)) u(i)""",
    "v_retrieve": _with(
        _embedding("emb", "SELECT doc_id AS id, text FROM documents"),
        _embedding("past", ISSUES), _hits("emb", "past", 3),
    )
    + """SELECT query_id, rank, vec_id AS id, 'summary of ' || item_id AS summary, length(text) AS n_chars,
      round(distance, 5) AS distance FROM hits JOIN benchmark ON vec_id = 'item_' || lpad(item_id::VARCHAR, 9, '0')""",
    "k_templates": _with(EVENT_LINES, TEMPLATES) + "SELECT * FROM templates",
    "k_templates_pages": _with(
        "lines AS (SELECT 'page_' || lpad(page_id::VARCHAR, 12, '0') AS run_id, 0::BIGINT AS line_no, url AS line FROM pages)",
        TEMPLATES,
    )
    + "SELECT * FROM templates",
    "k_templates_documents": _with(TEXT_LINES, TEMPLATES, _similar(5)) + "SELECT * FROM merged",
    "k_templates_similar": _with(EVENT_LINES, TEMPLATES, _similar(50)) + "SELECT * FROM merged",
    "k_values": _with(EVENT_LINES)
    + ", " + ", ".join(
        ["s0 AS (SELECT line AS l0, * FROM lines WHERE regexp_matches(line, '\\S'))"]
        + [
            f"s{i + 1} AS (SELECT regexp_replace(l{i}, '{pattern}', '<{kind}>', 'g') AS l{i + 1}, "
            f"regexp_extract_all(l{i}, '{pattern}', 0) AS v{i}, * FROM s{i})"
            for i, (kind, pattern) in enumerate(MASKS)
        ]
    )
    + " SELECT template, variable, value, count(*) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT l{len(MASKS)} AS template, '{kind}_' || u.i AS variable, v{i}[u.i] AS value "
        f"FROM s{len(MASKS)}, unnest(range(1, len(v{i}) + 1)) u(i)"
        for i, (kind, _) in enumerate(MASKS)
    )
    + ") GROUP BY ALL",
    "k_merge": _with(EVENT_LINES, TEMPLATES)
    + r""", toks AS (SELECT *, regexp_split_to_array(trim(template), '\s+') AS t FROM templates),
      ex AS (SELECT template, len(t) AS n, t[1] AS head, u.i AS pos, t[u.i] AS token FROM toks, unnest(range(1, len(t) + 1)) u(i)),
      wide AS (SELECT n, head, pos, count(DISTINCT token) > 3 AS wild FROM ex GROUP BY ALL),
      merged AS (SELECT template, string_agg(CASE WHEN wild THEN '<*>' ELSE token END, ' ' ORDER BY pos) AS m
        FROM ex JOIN wide USING (n, head, pos) GROUP BY template)
      SELECT m AS template, sum(n_lines)::BIGINT AS n_lines, count(*) AS n_templates,
        (min({'r': first_run, 'l': first_line})).r AS first_run, (min({'r': first_run, 'l': first_line})).l AS first_line
      FROM templates t JOIN merged g ON g.template = t.template GROUP BY m""",
    "k_context": _with(EVENT_LINES, TEMPLATES)
    + """, ctx AS (
        SELECT run_id, line_no, line,
          string_agg(line, chr(10)) OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before,
          string_agg(line, chr(10)) OVER (PARTITION BY run_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS after
        FROM lines)"""
    + ", " + ", ".join(
        ["s0 AS (SELECT line AS l0, * FROM ctx)"]
        + [
            f"s{i + 1} AS (SELECT regexp_replace(l{i}, '{pattern}', '<{kind}>', 'g') AS l{i + 1}, list_transform("
            f"regexp_extract_all(l{i}, '{pattern}', 0), lambda x, i: '{kind}_' || i || '=' || x) AS v{i}, * FROM s{i})"
            for i, (kind, pattern) in enumerate(MASKS)
        ]
    )
    + f""" SELECT template, coalesce(before, '') AS before, line AS match, coalesce(after, '') AS after,
        array_to_string(list_sort(list_concat({", ".join(f"v{i}" for i in range(len(MASKS)))})), ',') AS values
      FROM templates JOIN s{len(MASKS)} ON run_id = first_run AND line_no = first_line""",
    "k_enrich": _with(EVENT_LINES, TEMPLATES, LABELLED, ENRICHED) + "SELECT * FROM pending",
    "k_review": _with(EVENT_LINES, TEMPLATES, LABELLED, ENRICHED)
    + f""", hashed AS (SELECT *, {HASH32.format("template")} % 5 AS h FROM pending)
      SELECT md5(template) AS template_id, template, CASE WHEN h = 2 THEN 'CRITICAL' ELSE severity END AS severity,
        CASE WHEN h = 2 THEN 'Auth' ELSE causality END AS causality, summary, source,
        CASE WHEN h = 0 THEN 'approve' WHEN h = 2 THEN 'edit' ELSE 'pending' END AS review_action
      FROM hashed WHERE h <> 1""",
    "k_augment": _with(EVENT_LINES, TEMPLATES, LABELLED, VARIANTS)
    + """SELECT template, 0::BIGINT AS variant_no, severity, causality,
        causality || ' ' || lower(severity) || ' message: ' || template AS summary, 'AI Suggested' AS source,
        NULL::VARCHAR AS match, NULL::VARCHAR AS after FROM labelled
      UNION ALL SELECT template, variant_no, severity, causality,
        causality || ' ' || lower(severity) || ' message: ' || template, 'AI Augmented', match,
        'reported code: ' || code FROM variants""",
    "m_tips": _with(EVENT_LINES, *REPORT_PARTS, TIPS)
    + "SELECT f.run_id, f.test_name, analysis FROM failures f JOIN tips t ON t.key = f.test_name",
    "m_tips_latest": _with(EVENT_LINES, *REPORT_PARTS, TIPS) + "SELECT * FROM tips",
    "m_thread_latest": """SELECT conv_id, turn, role, text FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1""",
    "m_messages": """WITH turns AS (
        SELECT conv_id::VARCHAR AS run_id, turn, role, text, role || '_' || (turn // 4) AS id FROM conversations),
      kept AS (SELECT run_id, id, min(turn) AS place, arg_max(role, turn) AS role, arg_max(text, turn) AS content FROM turns GROUP BY run_id, id),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY place, id) AS seq FROM kept)
      SELECT run_id, 0 AS seq, 'system' AS role, 'You create tickets.' AS content FROM numbered GROUP BY run_id
      UNION ALL SELECT run_id, seq, role, content FROM numbered
      UNION ALL SELECT run_id, count(*) + 1, 'human', 'Create tickets for run ' || run_id FROM numbered GROUP BY run_id""",
    "m_stage_log": _with(EVENT_LINES, TEMPLATES, LABELLED, VARIANTS)
    + """, n AS (SELECT (SELECT count(*) FROM templates) AS t, (SELECT count(*) FROM variants) AS v)
      SELECT 'session_1' AS session, 0::BIGINT AS seq, 'extract' AS stage, t AS n_rows, 'Extracted ' || t || ' unique templates.' AS message FROM n
      UNION ALL SELECT 'session_1', 1, 'enrich', t, 'Enriched ' || t || ' templates.' FROM n
      UNION ALL SELECT 'session_1', 2, 'augment', v, 'Generated ' || v || ' synthetic templates.' FROM n
      UNION ALL SELECT 'session_1', 3, 'index', t + v, 'Indexed ' || (t + v) || ' templates for retrieval.' FROM n""",
    "m_infer": """SELECT doc_id, CASE WHEN bad THEN NULL ELSE length(text) || ' characters' END AS response,
        CASE WHEN bad THEN 'model overloaded' END AS error, CASE WHEN bad THEN 3 ELSE 1 END AS attempts
      FROM (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id // 3) % 5 = 0 AS bad FROM documents)""",
    "r_pass": _with(EVENT_LINES, *REPORT_PARTS) + "SELECT run_id, summary_report FROM runs WHERE test_status = 'passed'",
    "r_failure": _with(EVENT_LINES, *REPORT_PARTS) + "SELECT run_id, failure_report FROM runs WHERE test_status = 'failed'",
    "r_tickets": _with(EVENT_LINES, *REPORT_PARTS, TICKETS)
    + """SELECT r.run_id, count(ticket_id) AS n_tickets, coalesce(string_agg('Ticket: ' || ticket_id || chr(10) || 'Summary: ' || t.summary
        || chr(10) || 'Status: ' || t.status || chr(10) || 'Description: ' || t.description || chr(10), chr(10)
        ORDER BY first_line, testcase), 'No Tickets Created') AS tickets_text
      FROM runs r LEFT JOIN tickets t ON t.run_id = r.run_id GROUP BY r.run_id""",
    "r_ticket_rows": _with(EVENT_LINES, *REPORT_PARTS, TICKETS)
    + "SELECT run_id, ticket_id, summary, description, testcase, status FROM tickets",
    "r_report": _with(DOCUMENT_LOGS, DOCUMENT_LINES, *REPORT_PARTS)
    + r""", names AS (SELECT run_id, list(test_name ORDER BY first_line) AS n FROM failures GROUP BY run_id),
      shown AS (SELECT r.*, coalesce(n, regexp_extract_all(log_content, 'TESTCASE:\s*(.*?)\s*FAILED', 1)) AS n
        FROM runs r JOIN logs USING (run_id) LEFT JOIN names USING (run_id))
      SELECT run_id, 'Test Status: ' || upper(test_status) || chr(10) || CASE WHEN len(n) > 0
          THEN 'Failed Testcases' || chr(10) || array_to_string(list_transform(n, lambda x: '- ' || x), chr(10))
          ELSE 'No Failed Tests' END AS status_text,
        'Success Report' || chr(10) || coalesce(summary_report, 'No Success Report Generated') AS success_text,
        'Failure Report' || chr(10) || coalesce(failure_report, 'No Failure Report Generated') AS failure_text FROM shown""",
    "r_routes": _with(EVENT_LINES, *REPORT_PARTS)
    + """SELECT run_id, CASE WHEN test_status = 'passed' THEN 'pass_analysis' ELSE 'failure_analysis' END AS path,
        CASE WHEN run_id IN (SELECT run_id FROM explained) THEN 'tools' ELSE 'end' END AS next FROM runs""",
    "m_commit": _with(DOCUMENT_LOGS, DOCUMENT_LINES, *REPORT_PARTS)
    + """, both_reports AS (SELECT *, coalesce(failure_report, summary_report) AS report FROM runs JOIN logs USING (run_id))
      SELECT sha256('log_templates' || chr(1) || 'outcome' || chr(1) || run_id || chr(1) || log_content) AS id,
        substring(log_content, 1, 500) AS template, CASE WHEN test_status = 'failed' THEN 'high' ELSE 'low' END AS severity,
        substring(report, 1, 200) AS summary, substring(report, 1, 500) AS causality, length(log_content) AS n_chars,
        'log_templates' AS collection, 'outcome' AS record_kind FROM both_reports""",
}


def _m_context() -> str:
    """Needs the event runs for the tips and the document runs for the rest, so the shared names are nested."""
    event_tips = f"({_with(EVENT_LINES, *REPORT_PARTS, TIPS)} SELECT key, analysis FROM tips)"
    return (
        _with(
            f"known AS {event_tips}", DOCUMENT_LOGS, DOCUMENT_LINES, *VERDICT_PARTS,
            "failed AS (SELECT run_id FROM verdicts WHERE test_status = 'failed')",
            """failures AS (SELECT run_id, test_name, first_line FROM outcomes
              WHERE status = 'FAILED' AND run_id IN (SELECT run_id FROM failed))""",
            _embedding("emb", "SELECT run_id AS id, log_content AS text FROM logs WHERE run_id IN (SELECT run_id FROM failed)"),
            _embedding("past", ISSUES), _hits("emb", "past", 2),
        )
        + """, semantic AS (
          SELECT query_id AS run_id, string_agg('Past Issue: ' || text || chr(10) || 'Resolution/Analysis: '
            || CASE WHEN item_id % 2 = 0 THEN 'fix ' || item_id ELSE 'summary of ' || item_id END || chr(10) || chr(10), '' ORDER BY rank) AS s
          FROM hits JOIN benchmark ON vec_id = 'item_' || lpad(item_id::VARCHAR, 9, '0') GROUP BY query_id),
        tip_block AS (
          SELECT run_id, coalesce(string_agg('Tip for ' || test_name || ': ' || analysis || chr(10), '' ORDER BY first_line, test_name)
            FILTER (analysis IS NOT NULL), '') AS t
          FROM failures LEFT JOIN known ON key = test_name GROUP BY run_id)
        SELECT run_id, trim(coalesce(chr(10) || '--- Semantic Memory ---' || chr(10) || s, '') || chr(10)
          || coalesce(chr(10) || '--- Short-Term Memory (Global Tips) ---' || chr(10) || t, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS historical_context
        FROM failed LEFT JOIN semantic USING (run_id) LEFT JOIN tip_block USING (run_id)"""
    )


ORACLE_SQL["m_context"] = _m_context()

_ERRORS = """SELECT e.run_id, e.test_name, message, n, e.first_line, example
  FROM errors e JOIN failures f ON f.run_id = e.run_id AND f.test_name = e.test_name"""
_DOCUMENT_REPORTS = (DOCUMENT_LOGS, DOCUMENT_LINES, *REPORT_PARTS)
ORACLE_SQL |= {
    "r_error_details": _with(EVENT_LINES, *REPORT_PARTS) + _ERRORS,
    "p_triage": _with(*_DOCUMENT_REPORTS, TICKETS) + "SELECT run_id, ticket_id, summary, description, testcase, status FROM tickets",
    "p_triage_tips": _with(*_DOCUMENT_REPORTS)
    + """SELECT 'global_tips' AS namespace, test_name AS key, run_id, explanation AS analysis FROM explained
      UNION ALL SELECT 'global_tips', 'last_success', run_id, summary_report FROM runs WHERE test_status = 'passed'""",
    "p_triage_errors": _with(*_DOCUMENT_REPORTS) + _ERRORS,
}


_PLACES = "round(list_sum(list_transform(v, lambda x, i: x::DOUBLE * i)), 3) + 0.0::DOUBLE AS places"


def _p_triage_lines() -> str:
    return (
        _with(
            *_DOCUMENT_REPORTS, f"ctx AS ({_m_context()})", _embedding("emb", "SELECT run_id AS id, log_content AS text FROM logs"),
            """finished AS (SELECT run_id, test_status, log_content, coalesce(failure_report
              || CASE WHEN coalesce(historical_context, '') <> '' THEN chr(10) || 'History:' || chr(10) || historical_context ELSE '' END, summary_report) AS report
            FROM runs JOIN logs USING (run_id) LEFT JOIN ctx USING (run_id))""",
        )
        + f"""SELECT sha256('log_templates' || chr(1) || 'outcome' || chr(1) || run_id || chr(1) || log_content) AS id,
          substring(log_content, 1, 500) AS template, CASE WHEN test_status = 'failed' THEN 'high' ELSE 'low' END AS severity,
          substring(report, 1, 200) AS summary, substring(report, 1, 500) AS causality, length(log_content) AS n_chars,
          'log_templates' AS collection, 'outcome' AS record_kind, {_PLACES}
        FROM finished JOIN emb ON emb.id = run_id"""
    )


def _p_knowledge() -> str:
    """The names of the inner steps repeat outside with what review has left of them."""
    merged = f"templates AS ({_with(TEMPLATES, _similar(50))} SELECT template, first_run, first_line FROM merged)"
    reviewed = f"""labelled AS ({_with(LABELLED, ENRICHED)}, hashed AS (SELECT *, {HASH32.format("template")} % 5 AS h FROM pending)
      SELECT template, CASE WHEN h = 2 THEN 'CRITICAL' ELSE severity END AS severity, CASE WHEN h = 2 THEN 'Auth' ELSE causality END AS causality,
        summary, source FROM hashed WHERE h <> 1)"""
    return (
        _with(
            EVENT_LINES, merged, reviewed, VARIANTS,
            """records AS (
              SELECT template, severity, causality, summary, source, 0 AS variant_no FROM labelled
              UNION ALL SELECT template, severity, causality, summary, 'AI Augmented', variant_no FROM variants)""",
            _embedding("emb", "SELECT DISTINCT template AS id, template AS text FROM records"),
        )
        + f"""SELECT sha256('log_templates' || chr(1) || 'template' || chr(1) || template || chr(1) || source || chr(1) || variant_no) AS id, template, severity,
          summary, causality, length(template) AS n_chars, 'log_templates' AS collection, 'template' AS record_kind, {_PLACES}
        FROM records JOIN emb ON emb.id = template"""
    )


ORACLE_SQL |= {
    "p_triage_lines": _p_triage_lines(),
    "p_knowledge": _p_knowledge(),
    "m_run_history": _with(
        EVENT_LINES, *VERDICT_PARTS,
        """history AS (
          SELECT 'run_' || user_id AS thread_id, v.run_id, max(ts) AS ts, any_value(test_status) AS test_status
          FROM events e JOIN verdicts v ON v.run_id = 'run_' || e.user_id || '_' || strftime(e.ts, '%Y%m%d') GROUP BY ALL)""",
        """days AS (
          SELECT thread_id, unnest(range(min(ts)::DATE, max(ts)::DATE + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM history GROUP BY thread_id)""",
    )
    + """SELECT d.thread_id, day, arg_max(run_id, {'ts': ts, 'run': run_id}) AS run_id, arg_max(test_status, {'ts': ts, 'run': run_id}) AS test_status
      FROM days d JOIN history h ON h.thread_id = d.thread_id AND h.ts <= d.day + INTERVAL 1 DAY GROUP BY d.thread_id, day""",
}


_CODES = r"""
codes AS (
  SELECT DISTINCT c || upper(event_type) AS code, ' ' || array_to_string(regexp_extract_all(lower('Test ' || event_type), '[\p{L}\p{N}]+'), ' ') || ' ' AS phrase
  FROM events, unnest(['E-', 'W-']) u(c)),
own AS (
  SELECT template, list(code ORDER BY code) AS own FROM (SELECT DISTINCT template, code FROM templates, codes
    WHERE contains(' ' || array_to_string(regexp_extract_all(lower(template), '[\p{L}\p{N}]+'), ' ') || ' ', phrase)) GROUP BY template)
"""

ORACLE_SQL |= {
    "k_value_sets": f"""SELECT template, variable, sum(n)::BIGINT AS n, count(*) AS n_values, true AS all_counted, true AS distinct_agrees, true AS top_agrees
      FROM ({ORACLE_SQL["k_values"]}) GROUP BY template, variable""",
    "k_codes": _with(EVENT_LINES, TEMPLATES, LABELLED, VARIANTS, _CODES)
    + f"""SELECT template, variant_no, 'reported code: ' || coalesce(own[({DRAW.format("'code'")}) % len(own) + 1], code) AS after
      FROM variants LEFT JOIN own USING (template)""",
    "x_trends": """WITH counts AS (
        SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS n FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
      grid AS (
        SELECT event_type, unnest(b) AS bucket FROM (SELECT DISTINCT event_type FROM counts),
          (SELECT range(min(bucket), max(bucket) + INTERVAL 1 HOUR, INTERVAL 1 HOUR) AS b FROM counts)),
      series AS (SELECT g.event_type, g.bucket, coalesce(n, 0) AS n FROM grid g LEFT JOIN counts c ON c.event_type = g.event_type AND c.bucket = g.bucket),
      placed AS (
        SELECT *, row_number() OVER w AS place, sum(n) OVER w AS so_far, sum(n) OVER (PARTITION BY event_type) AS total,
          count(*) OVER (PARTITION BY event_type) AS buckets FROM series WINDOW w AS (PARTITION BY event_type ORDER BY bucket)),
      moved AS (SELECT event_type, bucket, n, place, (buckets * so_far - place * total)::BIGINT AS deviation FROM placed)
      SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(deviation) DESC, place) = 1 AND deviation <> 0 AS is_change FROM moved""",
    "x_clusters": "WITH RECURSIVE "
    + ",\n".join(
        x.strip() for x in (
            _embedding("emb", "SELECT doc_id AS id, text FROM documents"), _hits("emb", "emb", 4),
            """near AS (SELECT * FROM hits WHERE distance <= 0.15),
            cores AS (SELECT query_id AS core FROM near WHERE rank = 4),
            to_core AS (SELECT query_id AS a, vec_id AS b, rank FROM near JOIN cores ON core = vec_id),
            links AS (SELECT a, b FROM to_core JOIN cores ON core = a UNION SELECT b, a FROM to_core JOIN cores ON core = a),
            reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
            roots AS (SELECT a AS core, min(b) AS cluster FROM reach GROUP BY a),
            border AS (SELECT a AS id, arg_min(b, rank) AS core FROM to_core WHERE a NOT IN (SELECT core FROM cores) GROUP BY a),
            named AS (SELECT core AS id, cluster, true AS is_core FROM roots UNION ALL SELECT id, cluster, false FROM border JOIN roots USING (core))""",
        )
    )
    + " SELECT doc_id AS id, cluster, coalesce(is_core, false) AS is_core FROM documents LEFT JOIN named ON named.id = doc_id",
    "x_anomalies": _with(
        EVENT_LINES,
        f"""counts AS (SELECT run_id, {_masked("line")} AS template, count(*) AS n FROM lines GROUP BY ALL),
        spread AS (SELECT template, ln((SELECT count(DISTINCT run_id) FROM counts) / count(DISTINCT run_id)) AS rare FROM counts GROUP BY template),
        runs AS (SELECT run_id, array_to_string(string_split(run_id, '_')[1:2], '_') AS grp, sum(n)::BIGINT AS n_lines, sum(n * rare) / sum(n) AS rarity
          FROM counts JOIN spread USING (template) GROUP BY run_id)""",
    )
    + """SELECT run_id, grp AS "group", n_lines, round(rarity, 6) AS rarity, round(CASE WHEN stddev_pop(rarity) OVER g > 1e-9
        THEN (rarity - avg(rarity) OVER g) / stddev_pop(rarity) OVER g ELSE 0 END, 4) + 0.0::DOUBLE AS score
      FROM runs WINDOW g AS (PARTITION BY grp)""",
}

ORACLE_SQL["k_augment_model"] = (
    _with(
        TEXT_LINES, TEMPLATES, LABELLED,
        """numbered AS (
          SELECT l.*, (row_number() OVER (ORDER BY md5(template)) - 1) // 3 AS batch,
            'Write variants of this log template as a JSON list: ' || template AS prompt FROM labelled l)""",
        "asked AS (SELECT *, sum(length(prompt)) OVER (PARTITION BY batch) % 4 = 0 AS bad FROM numbered)",
    )
    + """SELECT template, 1 AS variant_no, right(prompt, 30) || ' again' AS variant, 'WARN' AS severity, causality, NULL::VARCHAR AS message FROM asked WHERE NOT bad
      UNION ALL SELECT template, 2, length(prompt) || ' characters', severity, causality, NULL FROM asked WHERE NOT bad
      UNION ALL SELECT NULL, count(*), NULL, NULL, NULL, 'Augmentation Batch ' || batch || ' failed after 3 attempts.' FROM asked WHERE bad GROUP BY batch"""
)
