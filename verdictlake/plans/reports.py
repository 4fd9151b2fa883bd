"""Queries on stored reports, replies, logs and the catalogue.

The driver's tables hold no reports, so events are written as such, with the
fields in the shapes that they are met in, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictlake.functions import columns as C
from verdictlake.operators import catalog as K
from verdictlake.operators import reports as R
from verdictlake.operators import verdicts as D
from verdictlake.plans import views as V
from verdictlake.plans.views import sql, table

_FINDING = (
    "'{\"tool\": ' || if(event_id % 4 = 0, 'null', '\"t' || event_id % 3 || '\"') || ', \"file\": ' || if(event_id % 2 = 0, '\"\"', '\"f' || user_id || '.c\"')"
    " || ', \"line\": ' || element_at(array(cast(user_id as string), '\"' || user_id || '\"', 'null', '\"x\"', user_id || '.75'), cast(event_id % 5 + 1 as int))"
    " || ', \"cwe\": ' || element_at(array('\"CWE-' || user_id || '\"', '[\"CWE-1\", \"\", null, \"CWE-2\"]', '\"\"', 'null', '79', '[]'), cast(event_id % 6 + 1 as int))"
    " || ', \"confidence\": ' || element_at(array('0.25', '\"0.5\"', '\"x\"', '7', '-1'), cast(event_id % 5 + 1 as int)) || ', \"fingerprint\": \"p' || event_id || '\"}'"
)
_STATUS = "element_at(array('CONFIRMED', 'confirmed', 'REJECTED', 'maybe', 'UNCERTAIN'), cast(event_id % 5 + 1 as int))"


def _reports(spark, d):
    report = f"'{{\"source\": \"s' || user_id || '.c\", \"findings\": [' || {_FINDING} || ', \"junk\", 3], \"decisions\": [{{\"status\": \"' || {_STATUS} || '\", \"line\": ' || user_id || ', \"cwe\": [\"CWE-' || user_id || '\"], \"confidence\": 0.5}}, null], \"errors\": ' || if(event_id % 9 = 0, '[\"e' || event_id || '\", \"\"]', '[]') || '}}'"
    return table(spark, d, "events").selectExpr("event_id as ord", "cast(event_id as string) as sample_id", f"{report} as report")


def report_scan(spark, d):
    """Documents of every shape, and what cannot be read."""
    one = "'{\"source\": \"a' || user_id || '.c\", \"n\": ' || event_id || '}'"
    value = F.expr(f"element_at(array({one}, '[' || {one} || ', 4, ' || {one} || ']', '{{\"x\": ' || {one} || ', \"y\": {{\"z\": 1}}, \"w\": 2}}', '{{\"findings\": []}}', '{{\"source\": '), cast(event_id % 5 + 1 as int))")
    good, bad = R.scan(table(spark, d, "events").select(F.col("event_id").cast("string").alias("path"), value.alias("value")))
    a = good.groupBy("path").agg(F.count("*").alias("reports"))
    return a.unionByName(bad.select("path", F.lit(0).cast("long").alias("reports")))


def phase1_predictions(spark, d):
    p = R.predictions_from_phase1(_reports(spark, d))
    return p.select("sample_id", "file", F.array_join("cwe", ",").alias("cwe"), "line", "confidence", "source", "fingerprint")


def phase2_predictions(spark, d):
    p = R.predictions_from_phase2(_reports(spark, d), ("CONFIRMED", "UNCERTAIN"))
    return p.select("sample_id", "file", F.array_join("cwe", ",").alias("cwe"), "line", "status", "confidence")


def record_predictions(spark, d):
    record = F.expr(f"'{{\"sample_id\": \"' || user_id || '\", \"decision\": \"' || {_STATUS} || '\", \"line\": \"' || event_id || '\", \"cwe\": \"CWE-' || user_id || '\"}}'")
    p = R.predictions_from_records(table(spark, d, "events").select(record.alias("record")), "llm")
    return p.groupBy("sample_id", "source", F.array_join("cwe", ",").alias("cwe")).agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


def scanner_hypotheses(spark, d):
    one = "'{\"cwe\": ' || if(event_id % 3 = 0, '[\"cwe-' || user_id || '\"]', '\" cwe-' || user_id || ' \"') || ', \"line\": ' || user_id || ', \"claim\": \"c\"}'"
    reply = F.expr(f"element_at(array('[' || {one} || ', 5, {{\"line\": 1}}]', '{{\"hypotheses\": [], \"findings\": ' || {one} || '}}', '{{\"candidates\": [' || {one} || ', ' || {one} || ']}}', '\"none\"'), cast(event_id % 4 + 1 as int))")
    return R.hypotheses_of(table(spark, d, "events").select(F.col("event_id").alias("file"), reply.alias("reply"))).select("file", "id", "cwe", "line")


def verifications(spark, d):
    reply = F.expr(f"element_at(array('{{\"decision\": \"' || {_STATUS} || '\", \"confidence\": \"2\", \"cwe\": \"CWE-' || user_id || '\", \"chain_verified\": true, \"missing_evidence\": [\"a\", \"\"]}}', '{{\"rationale\": \"r\"}}', 'no', '{{\"decision\": null, \"cwe\": [\"CWE-1\", null]}}'), cast(event_id % 4 + 1 as int))")
    v = table(spark, d, "events").select("event_id", R.verification_of(reply).alias("v"))
    return v.select("event_id", "v.decision", "v.confidence", F.array_join("v.cwe", ",").alias("cwe"), "v.explanation", F.size("v.missing_evidence").alias("missing"), "v.chain_verified", "v.usable")


def single_agent(spark, d):
    """The first groups of each file, by replies that leave fields out."""
    e = table(spark, d, "events").selectExpr("user_id || '.c' as file", "event_id as `group`", "event_id as ord", "if(event_id % 4 = 0, null, cast(user_id as int)) as line", "array('CWE-' || user_id) as cwe", "'low' as severity", f"if(event_id % 2 = 0, '{{\"decision\": \"' || {_STATUS} || '\", \"severity\": \"bad\"}}', '{{\"confidence\": 0.5, \"cwe\": [\"CWE-1\"], \"source_location\": \"x:1\"}}') as reply")
    got = R.group_decisions(e.drop("reply"), e.select("file", "group", "reply"), most=5)
    return got.select("file", "group", "truncated", "decision", "confidence", F.array_join("cwe", ",").alias("cwe"), "severity", "source_location")


def chat_envelopes(spark, d):
    body = F.expr("element_at(array('{\"choices\": [{\"message\": {\"content\": \" a' || event_id || ' \", \"reasoning\": \"r\"}, \"finish_reason\": \"stop\"}], \"usage\": {\"n\":1}}', '{\"choices\": [{\"message\": {\"content\": [{\"text\": \"x\"}, \"y\", {\"n\": 1}]}}]}', '{\"choices\": [{\"message\": {\"content\": \"z\"}, \"finish_reason\": \"LENGTH\"}]}', '{\"choices\": [], \"error\": \"busy\"}', '[1]', '{\"choices\": [{\"message\": {\"refusal\": \"no\"}}]}'), cast(event_id % 6 + 1 as int))")
    e = table(spark, d, "events").select("event_id", R.envelope(body).alias("e"))
    return e.select("event_id", "e.text", "e.thinking", "e.error", D.failure_kind_of_call(F.col("e.error")).alias("kind"))


def fallback_hypotheses(spark, d):
    f = V.findings(spark, d).where("line < 20")
    return D.fallback_hypotheses(f.withColumn("message", F.expr("if(ord % 2 = 0, '', message)"))).select("ord", "id", "cwe", "claim", "suspected_sink")


def assembled_decisions(spark, d):
    """Verdicts with gates and notes as they are stored."""
    p = V.predictions(spark, d)
    verified = F.expr("if(ord % 3 = 0, array('cwe-122', ''), if(ord % 3 = 1, array('CWE-787'), cast(array() as array<string>)))")
    v = F.struct(F.expr("if(status = 'ERROR', 'UNCERTAIN', status)").alias("decision"), F.col("confidence"), verified.alias("cwe"), F.lit("HIGH").alias("severity"), F.lit("why").alias("explanation"), F.expr("array('e')").alias("evidence"), F.expr("array('m')").alias("missing_evidence"))
    rows = p.select("file", F.col("ord").cast("string").alias("id"), F.expr("cwe[0]").alias("cwe"), "line", v.alias("v"), F.expr("if(ord % 5 = 0, 'gate', '')").alias("reason"))
    return R.decisions_of(rows).select("group_id", "status", F.array_join("cwe", ",").alias("cwe"), "rationale")


def report_counters(spark, d):
    f = V.findings(spark, d)
    return R.report_counters(f, f.select("file", F.col("rule_id").alias("group")))


def run_totals(spark, d):
    return R.run_totals(_reports(spark, d)).withColumn("error_details", F.array_join("error_details", "|"))


def report_errors(spark, d):
    entry = F.expr("element_at(array('{\"skipped\": true, \"reason\": \"missing file\"}', '{\"report\": {\"errors\": [\"a\"]}}', '{\"phase1\": {\"errors\": [\"b\"]}, \"phase2\": {\"errors\": [\"c\", \"d\"]}}', '{\"report\": {}}'), cast(event_id % 4 + 1 as int))")
    return R.report_errors(table(spark, d, "events").select(F.col("event_id").cast("string").alias("sample_id"), entry.alias("entry"))).select("sample_id", "error")


def missing_files(spark, d):
    s = V.samples(spark, d)
    return R.missing_files(s, s.where("ord % 3 > 0").select(F.col("file").alias("path"))).groupBy("vulnerable", "skipped", "reason").agg(F.count("*").alias("n"))


def recorded_verdicts(spark, d):
    """A log of whole files, the last answer of each hypothesis, and what was
    left half-written."""
    call = "'{\"role\": \"' || if(turn % 2 = 0, 'verifier', 'scanner') || '\", \"hypothesis\": ' || if(turn % 3 = 0, 'null', '\"H' || turn % 4 || '\"') || ', \"answer\": {\"decision\": \"' || if(turn % 4 = 2, 'CONFIRMED', 'REJECTED') || '\", \"confidence\": 0.' || turn % 10 || '}}'"
    logs = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{call} as call").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "call"))), lambda x: x["call"]), ",").alias("calls"))
    value = F.expr("'{\"files\": {\"' || conv_id || '\": {\"calls\": [' || calls || ']}}' || if(conv_id % 7 = 0, '', '}')")
    v = R.recorded_verdicts(R.log_calls(logs.select(F.col("conv_id").cast("string").alias("path"), value.alias("value"))))
    return v.select("entry", "hypothesis", "v.decision", "v.confidence")


# -- the catalogue: parts are classes, suppliers are cases


def _catalog(spark, d):
    classes = table(spark, d, "part").selectExpr("'CWE-' || p_partkey as cwe_id", "'name ' || p_partkey as name", "'f' as family", "if(p_partkey % 3 = 0, cast(array() as array<string>), array(if(p_partkey % 3 = 1, 'c', 'python'))) as languages", "'' as summary", "transform(sequence(0, 2), i -> 'CVE-' || (p_partkey * (i + 1)) % 50) as cves")
    cases = table(spark, d, "supplier").selectExpr("'CVE-' || s_suppkey as cve_id", "'p' as project", "element_at(array('c', 'python', null), cast(s_suppkey % 3 + 1 as int)) as language", "'CWE-' || s_suppkey as cwe", "'t' as title", "if(s_suppkey % 8 = 0, '', 'https://r/' || s_suppkey % 4) as reference", "s_suppkey % 5 > 0 as in_scope", "if(s_suppkey % 10 = 0, 'old', '') as out_of_scope_reason")
    return classes, cases


def catalog_enrich(spark, d):
    c = K.with_cases(*_catalog(spark, d))
    return c.select("cwe_id", "cwe_name", F.array_join("related_cves", ",").alias("cves"), F.array_join("references", ",").alias("refs"))


def catalog_counts(spark, d):
    return K.counts(*_catalog(spark, d))


def catalog_languages(spark, d):
    return K.classes_for_language(_catalog(spark, d)[0], "c").select("cwe_id")


def catalog_scope(spark, d):
    return K.in_scope(_catalog(spark, d)[1], "python").select("cve_id")


def suggested_cases(spark, d):
    f = table(spark, d, "orders").selectExpr("o_orderkey as ord", "array('cwe-' || o_custkey, cast(o_custkey + 1 as string), 'CWE-' || o_custkey) as cwe")
    return K.suggested(f, *_catalog(spark, d), "c").select("ord", F.array_join("cves", ",").alias("cves"))


def catalog_validate(spark, d):
    return K.problems(*_catalog(spark, d)).groupBy("subject", "problem").agg(F.count("*").alias("n"))


def report_fields(spark, d):
    named = table(spark, d, "events").selectExpr("event_id", "cast(user_id * 3 as string) as cwe")
    known = K.with_cases(*_catalog(spark, d))
    return named.join(K.report_fields(named.select("cwe").distinct(), known), "cwe").select("event_id", "cwe_name", F.size("related_cves").alias("cves"), F.size("references").alias("refs"))


QUERIES = {f.__name__: f for f in (report_scan, phase1_predictions, phase2_predictions, record_predictions, scanner_hypotheses, verifications, single_agent, chat_envelopes, fallback_hypotheses, assembled_decisions, report_counters, run_totals, report_errors, missing_files, recorded_verdicts, catalog_enrich, catalog_counts, catalog_languages, catalog_scope, suggested_cases, catalog_validate, report_fields)}

_ST = "['CONFIRMED', 'CONFIRMED', 'REJECTED', 'UNCERTAIN', 'UNCERTAIN'][event_id % 5 + 1]"
_RAW = "['CONFIRMED', 'confirmed', 'REJECTED', 'maybe', 'UNCERTAIN'][event_id % 5 + 1]"
_CAT = "cls AS (SELECT p_partkey AS k, 'CWE-' || p_partkey AS cwe_id, 'name ' || p_partkey AS name, unnest([0, 1, 2]) AS place FROM part), lst AS (SELECT cwe_id, k, name, place, (k * (place + 1)) % 50 AS s FROM cls), cas AS (SELECT s_suppkey AS s, CASE s_suppkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'python' END AS language, CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE 'https://r/' || s_suppkey % 4 END AS reference, s_suppkey % 5 > 0 AS in_scope FROM supplier)"
_ENTRY = _CAT + ", ent AS (SELECT lst.cwe_id, any_value(name) AS name, any_value(k) AS k, list('CVE-' || lst.s ORDER BY place) FILTER (cas.s IS NOT NULL) AS cves, list(reference ORDER BY place) FILTER (reference <> '') AS refs FROM lst LEFT JOIN cas ON cas.s = lst.s AND in_scope GROUP BY 1)"
_FIRST = "list_reduce(list_prepend([]::VARCHAR[], list_transform(coalesce(refs, []), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END)"

ORACLE_SQL = {
    "report_scan": "SELECT event_id::VARCHAR AS path, [1, 2, 1, 1, 0][event_id % 5 + 1]::BIGINT AS reports FROM events",
    "phase1_predictions": "SELECT event_id::VARCHAR AS sample_id, CASE WHEN event_id % 2 = 0 THEN 's' ELSE 'f' END || user_id || '.c' AS file, ['CWE-' || user_id, 'CWE-1,CWE-2', '', '', '79', ''][event_id % 6 + 1] AS cwe, CASE WHEN event_id % 5 IN (0, 1, 4) THEN user_id END::INTEGER AS line, [0.25, 0.5, 0.0, 1.0, 0.0][event_id % 5 + 1]::DOUBLE AS confidence, CASE WHEN event_id % 4 = 0 THEN 'phase1' ELSE 't' || event_id % 3 END AS source, 'p' || event_id AS fingerprint FROM events",
    "phase2_predictions": f"SELECT event_id::VARCHAR AS sample_id, 's' || user_id || '.c' AS file, 'CWE-' || user_id AS cwe, user_id::INTEGER AS line, {_ST} AS status, 0.5::DOUBLE AS confidence FROM events WHERE event_id % 5 <> 2",
    "record_predictions": "SELECT user_id::VARCHAR AS sample_id, 'llm' AS source, 'CWE-' || user_id AS cwe, count(*) AS n, sum(event_id)::BIGINT AS lines FROM events WHERE event_id % 5 < 2 GROUP BY 1, 2, 3",
    "scanner_hypotheses": "SELECT event_id AS file, 'H' || k AS id, 'CWE-' || user_id AS cwe, user_id::INTEGER AS line FROM events, unnest([1, 2]) t(k) WHERE event_id % 4 < 3 AND (k = 1 OR event_id % 4 = 2)",
    "verifications": f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN {_ST} ELSE 'UNCERTAIN' END AS decision, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END::DOUBLE AS confidence, CASE event_id % 4 WHEN 0 THEN 'CWE-' || user_id WHEN 3 THEN 'CWE-1' ELSE '' END AS cwe, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 5 = 3 THEN 'Verifier answered ''maybe'', which is not a verdict.' ELSE '' END WHEN 1 THEN 'r' WHEN 2 THEN 'Verifier returned no usable JSON object.' ELSE 'Verifier returned no decision field.' END AS explanation, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END::INTEGER AS missing, event_id % 4 = 0 AS chain_verified, event_id % 4 = 0 AND event_id % 5 <> 3 AS usable FROM events",
    "single_agent": f"SELECT file, event_id AS group, n > 5 AS truncated, CASE WHEN event_id % 2 = 0 THEN {_ST} ELSE 'UNCERTAIN' END AS decision, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN event_id % 2 = 0 THEN 'CWE-' || user_id ELSE 'CWE-1' END AS cwe, CASE WHEN event_id % 2 = 0 THEN 'UNKNOWN' ELSE 'LOW' END AS severity, CASE WHEN event_id % 2 = 1 THEN 'x:1' WHEN event_id % 4 = 0 THEN NULL ELSE file || ':' || user_id END AS source_location FROM (SELECT *, user_id || '.c' AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k <= 5",
    "chat_envelopes": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'xy' END AS text, CASE WHEN event_id % 6 = 0 THEN 'r' ELSE '' END AS thinking, CASE event_id % 6 WHEN 2 THEN 'TruncatedResponse: cut off' WHEN 3 THEN 'ValueError: a reply without choices: busy' WHEN 4 THEN 'ValueError: a reply that is no object: [1]' WHEN 5 THEN 'ValueError: a reply without content: no (finish_reason=unknown)' END AS error, CASE WHEN event_id % 6 < 3 THEN 'none' ELSE 'parse' END AS kind FROM events",
    "fallback_hypotheses": sql("findings", "SELECT ord, 'T' || row_number() OVER (PARTITION BY file ORDER BY ord, line, rule_id, CASE WHEN ord % 2 = 0 THEN '' ELSE message END, c) AS id, c AS cwe, CASE WHEN ord % 2 = 0 THEN 'reported by a static tool' ELSE message END AS claim, rule_id AS suspected_sink FROM findings WHERE line < 20"),
    "assembled_decisions": sql("fam preds", "SELECT ord::VARCHAR AS group_id, CASE WHEN status = 'ERROR' THEN 'UNCERTAIN' WHEN status = 'CONFIRMED' AND ord % 5 = 0 THEN 'REJECTED' ELSE status END AS status, coalesce(v, c) AS cwe, CASE WHEN ord % 5 = 0 THEN 'gate' ELSE 'why' END || CASE WHEN v IS NOT NULL AND NOT list_has_any(fs, ['CWE-118', 'CWE-119', v]) THEN ' [scanner proposed ' || c || ', verifier read ' || v || '; reporting the verified class]' ELSE '' END AS rationale FROM (SELECT *, CASE ord % 3 WHEN 0 THEN 'CWE-122' WHEN 1 THEN 'CWE-787' END AS v FROM preds JOIN fam USING (c))"),
    "report_counters": sql("findings", "SELECT file, count(DISTINCT tool) AS tool_count, count(*) AS finding_count, count(DISTINCT rule_id) AS group_count FROM findings GROUP BY 1"),
    "run_totals": "SELECT count(*) AS reports, 3 * count(*) AS findings, count_if(event_id % 5 = 0)::BIGINT AS confirmed, count_if(event_id % 5 = 2)::BIGINT AS rejected, count_if(event_id % 5 = 4)::BIGINT AS uncertain, count_if(event_id % 9 = 0)::BIGINT AS errors, (SELECT string_agg(t, '|' ORDER BY event_id) FROM (SELECT event_id, 's' || user_id || '.c: e' || event_id AS t FROM events WHERE event_id % 9 = 0 ORDER BY event_id LIMIT 8)) AS error_details FROM events",
    "report_errors": "SELECT event_id::VARCHAR AS sample_id, unnest(CASE event_id % 4 WHEN 0 THEN ['skipped: missing file'] WHEN 1 THEN ['a'] WHEN 2 THEN ['phase1: b', 'phase2: c', 'phase2: d'] ELSE [] END) AS error FROM events",
    "missing_files": sql("samples", "SELECT vulnerable, ord % 3 = 0 AS skipped, CASE WHEN ord % 3 = 0 THEN 'missing file' END AS reason, count(*) AS n FROM samples GROUP BY ALL"),
    "recorded_verdicts": "SELECT conv_id::VARCHAR AS entry, 'H' || turn % 4 AS hypothesis, arg_max(CASE WHEN turn % 4 = 2 THEN 'CONFIRMED' ELSE 'REJECTED' END, turn) AS decision, arg_max((turn % 10) / 10.0, turn)::DOUBLE AS confidence FROM conversations WHERE conv_id % 7 <> 0 AND turn % 2 = 0 AND turn % 3 <> 0 GROUP BY 1, 2",
    "catalog_enrich": f"WITH {_ENTRY} SELECT cwe_id, name AS cwe_name, array_to_string(coalesce(cves, []), ',') AS cves, array_to_string(list_prepend('https://cwe.mitre.org/data/definitions/' || k || '.html', {_FIRST}), ',') AS refs FROM ent",
    "catalog_counts": f"WITH {_ENTRY} SELECT cwe_id, coalesce(len(cves), 0)::INTEGER AS cases FROM ent",
    "catalog_languages": "SELECT 'CWE-' || p_partkey AS cwe_id FROM part WHERE p_partkey % 3 < 2",
    "catalog_scope": "SELECT 'CVE-' || s_suppkey AS cve_id FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 3 > 0",
    "suggested_cases": f"WITH {_CAT}, p AS (SELECT o_orderkey AS ord, s, min((lst.k - o_custkey) * 10 + place) AS first_at FROM orders JOIN lst ON lst.k IN (o_custkey, o_custkey + 1) JOIN cas USING (s) WHERE in_scope AND coalesce(language, 'c') = 'c' GROUP BY 1, 2) SELECT ord, string_agg('CVE-' || s, ',' ORDER BY first_at) AS cves FROM p GROUP BY 1",
    "catalog_validate": f"WITH {_CAT} SELECT subject, problem, count(*) AS n FROM (SELECT cwe_id AS subject, 'unknown case CVE-' || s AS problem FROM lst WHERE s NOT IN (SELECT s FROM cas) UNION ALL SELECT 'CVE-' || s, 'refers to CWE-' || s || ' but is listed under ' || cwe_id FROM lst JOIN cas USING (s) WHERE k <> s UNION ALL SELECT 'CVE-' || s, 'out of scope but listed under ' || cwe_id FROM lst JOIN cas USING (s) WHERE NOT in_scope UNION ALL SELECT 'CVE-' || s, 'no reference' FROM cas WHERE reference = '' UNION ALL SELECT 'CVE-' || s, 'out of scope without a reason' FROM cas WHERE NOT in_scope AND s % 10 <> 0) GROUP BY 1, 2",
    "report_fields": f"WITH {_ENTRY} SELECT event_id, coalesce(name, '') AS cwe_name, coalesce(len(cves), 0)::INTEGER AS cves, CASE WHEN name IS NULL THEN 0 ELSE 1 + len(list_distinct(coalesce(refs, []))) END::INTEGER AS refs FROM events LEFT JOIN ent ON ent.k = user_id * 3",
}
