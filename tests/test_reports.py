"""Stored reports, replies, logs and the catalogue on rows with known results."""

import json

import pytest
from pyspark.sql import functions as F

from verdictlake.operators import catalog, matching, reports, streams, verdicts
from verdictlake.sources import readers


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_phase1_takes_every_finding(spark):
    report = {"path": "p.c", "findings": [{"tool": "t", "line": "7", "cwe": "CWE-1", "confidence": 2}, "junk", {"file": "q.c", "line": 3.9, "cwe": [None, "", "CWE-2", 5]}, {"line": True, "cwe": 0}]}
    got = reports.predictions_from_phase1(rows(spark, [("s", json.dumps(report)), ("t", "{}"), ("u", "not json")], "sample_id string, report string")).orderBy("ord").collect()
    assert [(r.sample_id, r.file, r.line, list(r.cwe), r.source, r.confidence) for r in got] == [("s", "p.c", 7, ["CWE-1"], "t", 1.0), ("s", "q.c", 3, ["CWE-2", "5"], "phase1", 0.0), ("s", "p.c", None, [], "phase1", 0.0)]


def test_phase2_statuses(spark):
    report = {"source": "p.c", "decisions": [{"status": s, "line": k} for k, s in enumerate(["CONFIRMED", "confirmed", "odd", "REJECTED"])] + [{"cwe": "x"}, 3]}
    df = rows(spark, [("s", json.dumps(report))], "sample_id string, report string")
    lines = lambda *statuses: sorted((r.status, r.line) for r in reports.predictions_from_phase2(df, *statuses).collect() if r.line is not None)
    assert lines() == [("CONFIRMED", 0), ("CONFIRMED", 1)]
    assert lines(("uncertain",)) == [("UNCERTAIN", 2)]
    assert reports.predictions_from_phase2(df, ("UNCERTAIN",)).count() == 2
    with pytest.raises(ValueError, match="unknown decision status"):
        reports.predictions_from_phase2(df, ("MAYBE",))


def test_scan_of_folders(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    one = {"source": "a.c", "findings": []}
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "deep/list.json").write_text(json.dumps([one, 3, one]))
    (tmp_path / "deep/named.json").write_text(json.dumps({"a": one, "b": {"x": 1}, "c": 4}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "l.jsonl").write_text(json.dumps(one) + "\n\nnope\n" + json.dumps(one) + "\n")
    (tmp_path / "other.txt").write_text("{}")
    good, bad = readers.reports(spark, str(tmp_path))
    assert good.count() == 6 and sorted(r.value for r in bad.collect()) == ["nope", "{"]


def test_hypotheses(spark):
    replies = [("a", json.dumps({"hypotheses": [{"cwe": ["cwe-1", "x"], "line": "4", "claim": " c "}, "junk", {"line": 2}, {"id": "Z", "cwe": "CWE-2"}]})), ("b", json.dumps({"hypotheses": None, "candidates": {"claim": "k", "line": "x"}})), ("c", "[]"), ("d", "nonsense")]
    got = [(r.file, r.id, r.cwe, r.line, r.claim) for r in reports.hypotheses_of(rows(spark, replies, "file string, reply string")).orderBy("file", "ord").collect()]
    assert got == [("a", "H1", "CWE-1", 4, "c"), ("a", "Z", "CWE-2", None, ""), ("b", "H1", "", None, "k")]


def test_verification(spark):
    replies = [json.dumps(x) for x in ({"decision": " confirmed ", "confidence": "nan", "cwe": 7, "evidence": ["a", "", None], "chain_verified": 1}, {"decision": "yes"}, [1])]
    got = [r.v for r in rows(spark, list(enumerate(replies)), "k long, t string").orderBy("k").select(reports.verification_of("t").alias("v")).collect()]
    assert (got[0].decision, got[0].confidence, list(got[0].cwe), list(got[0].evidence), got[0].chain_verified, got[0].usable) == ("CONFIRMED", 0.0, [], ["a"], True, True)
    assert (got[1].decision, got[1].usable, got[1].explanation) == ("UNCERTAIN", False, "Verifier answered 'yes', which is not a verdict.")
    assert (got[2].decision, got[2].usable) == ("UNCERTAIN", False)


def test_divergence_and_classes(spark):
    df = rows(spark, [(0, "CWE-121", ["cwe-122"]), (1, "CWE-78", ["CWE-89", ""]), (2, "", ["CWE-1"]), (3, "cwe-9", [])], "k long, p string, v array<string>").orderBy("k")
    note = [r.n for r in df.select(verdicts.divergence_note(F.lit("n"), F.upper("p"), F.col("v")).alias("n")).collect()]
    assert note == ["n", "n [scanner proposed CWE-78, verifier read CWE-89; reporting the verified class]", "n", "n"]
    own = lambda x: [list(r.c) for r in df.select(verdicts.resolved_class(F.col("v"), F.col("p"), x).alias("c")).collect()]
    assert own(True) == [["CWE-122"], ["CWE-89"], ["CWE-1"], ["CWE-9"]]
    assert own(False) == [["CWE-121"], ["CWE-89"], ["CWE-1"], ["CWE-9"]]


def test_gates_can_be_switched(spark):
    gate = lambda **k: spark.range(1).select(verdicts.evidence_gate(F.lit(True), F.array(F.lit("m")), F.lit(True), F.lit(0), F.lit(False), F.lit(True), F.lit(0.9), **k).alias("g")).first()["g"]
    assert [gate(), gate(reject_ungrounded=False), gate(reject_ungrounded=False, require_chain=False), gate(reject_ungrounded=False, require_chain=False, reject_mitigated=True)] == ["missing_evidence", "no_path", "", "mitigated"]


def test_packet_has_no_names(spark):
    packet = spark.range(1).select(reports.evidence_packet({"file": F.lit("j/CWE-1/bad/f.c"), "claim": F.lit("badSink"), "none": F.lit(None).cast("string"), "hits": F.array(F.struct(F.lit("CWE-1").alias("cwe")))}).alias("p")).first()["p"]
    got = json.loads(packet)
    assert set(got) == {"file", "claim", "hits"} and got["hits"] == [{"cwe": "CWE-1"}] and "bad" not in packet and got["file"].endswith("/f.c")


CATALOG = ("cwe_id string, name string, family string, languages array<string>, summary string, cves array<string>", "cve_id string, project string, language string, cwe string, title string, reference string, in_scope boolean, out_of_scope_reason string")


def test_report_findings(spark):
    classes = rows(spark, [("CWE-78", "n", "f", [], "", ["CVE-1", "CVE-2"])], CATALOG[0])
    cases = rows(spark, [("CVE-1", "p", "c", "CWE-78", "t", "https://r", True, ""), ("CVE-2", "p", "c", "CWE-78", "t", "https://q", False, "old")], CATALOG[1])
    verdict = json.dumps({"decision": "CONFIRMED", "cwe": ["cwe-78"], "source_location": "wrong.c:9", "chain_verified": True})
    asked = [("a.c", "H1", "CWE-1", 20, verdict), ("a.c", "H2", "CWE-1", None, verdict.replace("wrong.c:9", "nowhere")), ("b.c", "H1", "CWE-99", 3, "{}")]
    df = rows(spark, asked, "file string, id string, cwe string, line int, t string").withColumn("v", reports.verification_of("t"))
    chains = rows(spark, [("a.c", k, "f", s, "x", 1, line, "parameter") for k, (s, line) in enumerate([("", 5), ("s1", 50), ("s2", 21)])], "file string, ord long, function string, source_expression string, sink_expression string, source_line int, sink_line int, origin string")
    got = {(r.file, r.id): r for r in reports.report_findings(df, chains, catalog.with_cases(classes, cases)).collect()}
    r = got["a.c", "H1"]
    assert (r.cwe, r.line, r.source, list(r.related_cves), list(r.references)) == ("CWE-78", 9, "s2", ["CVE-1"], ["https://cwe.mitre.org/data/definitions/78.html", "https://r"])
    assert (got["a.c", "H2"].line, got["a.c", "H2"].source) == (5, "s1")
    assert (got["b.c", "H1"].cwe, got["b.c", "H1"].line, list(got["b.c", "H1"].references)) == ("CWE-99", None, [])
    assert catalog.class_of(classes, "78").count() == 1 and catalog.case_of(cases, "cve-2").count() == 1 and [r.cve_id for r in catalog.ids(cases, "cve_id").collect()] == ["CVE-1", "CVE-2"]
    assert {r.problem for r in catalog.problems(classes, cases).collect()} == {"out of scope but listed under CWE-78"}


def test_logs_and_replay(spark, tmp_path):
    answer = lambda d: {"decision": d}
    calls = [{"role": "scanner", "answer": {}}, {"role": "verifier", "hypothesis": "H1", "answer": answer("CONFIRMED")}, {"role": "verifier", "hypothesis": "H1", "answer": answer("REJECTED")}, {"role": "verifier", "answer": answer("CONFIRMED")}]
    texts = rows(spark, [("x", json.dumps({"files": {"a.c": {"calls": calls}, "s2": {"calls": calls[:2]}}})), ("y", '{"files": {"b')], "path string, value string")
    log = reports.log_calls(texts)
    assert [r.path for r in log.where("unreadable").collect()] == ["y"] and log.count() == 7
    reported = rows(spark, [("s1", '{"source": "a.c"}'), ("s2", '{"source": "z.c"}'), ("s3", '{"source": "a.c"}')], "sample_id string, report string")
    truth = rows(spark, [("s1", True), ("s2", False)], "sample_id string, vulnerable boolean")
    got = sorted((r.sample_id, r.hypothesis, r.v.decision) for r in reports.replay(reported, log, truth).collect())
    assert got == [("s1", "H1", "REJECTED"), ("s2", "H1", "CONFIRMED")]
    readers.append_calls(rows(spark, [("i", "x" * 30, None)], "id string, answer string, path string"), str(tmp_path / "calls"))
    clipped = reports.call_log(rows(spark, [("i", "x" * 30)], "id string, answer string"), most=10).first()
    assert clipped.answer == "x" * 10 + "\n... [truncated, 20 chars]" and clipped.entry == "i"
    assert spark.read.parquet(str(tmp_path / "calls")).first().entry == "i"


def test_result_documents(spark, tmp_path):
    schema = "ord long, sample_id string, file string, cwe array<string>, line int"
    p = rows(spark, [(0, "v", "v.c", ["CWE-78"], 4), (1, "b", "b.c", ["CWE-78"], 1)], schema)
    g = rows(spark, [(0, "v", "v.c", ["CWE-78"], 4, True), (1, "b", "b.c", [], None, False)], schema + ", vulnerable boolean")
    config = matching.MatchConfig()
    docs = reports.result_documents(matching.evaluate(p, g, config), "phase2", config, matching.per_class(p, g), reports.provenance({"label": "leg", "at": ...}))
    readers.write_results(docs, str(tmp_path / "r"))
    stored = spark.read.text(str(tmp_path / "r"))
    got = json.loads(stored.first()["value"])
    assert got["metrics"]["confusion"] == {"tp": 1, "fp": 1, "fn": 0, "tn": 0} and got["metadata"]["positive_ground_truth_count"] == 1 and len(got["matches"]) == 1 and got["unmatched_predictions"][0]["failure"] == "reported_on_benign_file"
    feed = reports.chart_feed(stored).first()
    assert (feed.label, feed.tp, feed.precision, feed.benign_flag_rate) == ("leg (phase2)", 1, 0.5, 1.0)
    assert reports.text_table(reports.chart_feed(stored).select("label", "tp")) == ["label         tp", "leg (phase2)  1"]


def test_run_errors_and_missing_files(spark):
    s = rows(spark, [("a", "a.c"), ("b", "b.c")], "sample_id string, file string")
    files = rows(spark, [("a.c",)], "path string")
    assert {r.sample_id: (r.skipped, r.reason) for r in reports.missing_files(s, files).collect()} == {"a": (False, None), "b": (True, "missing file")}
    with pytest.raises(Exception, match="missing file: b.c"):
        reports.missing_files(s, files, skip_missing=False).collect()
    assert json.loads(s.select(reports.error_report(s).alias("r")).orderBy("r").first()["r"])["errors"] == ["missing file: a.c"]
    entries = rows(spark, [("a", '{"skipped": true}'), ("b", '{"phase1": {"errors": ["x", "y"]}}')], "sample_id string, entry string")
    total = reports.error_summary(reports.report_errors(entries), most=2).first()
    assert (total.errors, total.samples, [r.error for r in total.first]) == (3, 2, ["skipped: unknown reason", "phase1: x"])
    got = reports.path_summary(rows(spark, [('{"findings": [1, 2]}',), ("{}",)], "report string"), entries).first()
    assert (got.files, got.findings, got.skipped) == (2, 2, 2)


def test_facts_are_cut(spark):
    from verdictlake.operators.facts import facts

    text = "import os\n" + "".join(f"def f{k}():\n    eval('1')\n" for k in range(60))
    r = reports.structural_summary(facts(rows(spark, [("p.py", "python", text)], "path string, language string, text string"))).first()
    assert (r.function_count, len(r.functions), len(r.dangerous_calls), len(r.imports), r.parse_error) == (60, 40, 40, 1, False)


def test_manifests_and_settings(spark, tmp_path):
    items = [{"sample_id": "a", "file": "x.c", "vulnerable": True, "language": "c"}, {"sample_id": "b", "file": "y.c", "language": ""}, {"sample_id": "a", "file": "z.c", "language": "python"}]
    (tmp_path / "m.json").write_text(json.dumps({"dataset": {"root": str(tmp_path)}, "samples": items}))
    (tmp_path / "n.json").write_text(json.dumps({"dataset": {"root": "/nowhere/at/all"}, "samples": items}))
    m = readers.manifest(spark, str(tmp_path / "m.json"))
    assert readers.sample(m, "a").first().file == "z.c" and [r.language for r in readers.languages(m).collect()] == ["c", "python"]
    assert readers.dataset_root(spark, str(tmp_path / "m.json")) == str(tmp_path) == readers.dataset_root(spark, str(tmp_path / "n.json"))
    assert tuple(readers.manifest_stats(spark, str(tmp_path / "m.json")).first()) == (3, 1, ["c", "python", "unknown"])
    text = "# c\nexport A='x y'\nB=3\nC=maybe\nD=on # yes\n\nE=2.5\n"
    assert readers.settings(text, {"A": str, "B": int, "C": int, "D": bool, "E": float, "F": int}, {"B": "4"}) == {"A": "x y", "B": 4, "D": True, "E": 2.5}
    s = rows(spark, [("a/b", "bad", "int x;", "c"), ("a/b", "good", "y = 1", "python")], "sample_id string, variant string, text string, language string")
    got = readers.write_samples(s, str(tmp_path / "out")).collect()
    assert sorted((tmp_path / "out" / r.file).read_text() for r in got) == ["int x;", "y = 1"] and {r.file.split("_")[0] for r in got} == {"a"}
    assert [r.file for r in readers.write_samples(s, str(tmp_path / "out")).collect()] == [r.file for r in got]


def test_presets(spark):
    d = rows(spark, [("int f;", "1"), ("int g;", "0")], "func string, target string")
    assert sorted((r.vulnerable, list(r.cwe), r.sample_id[:7]) for r in readers.devign(d).collect()) == [(False, [], "devign_"), (True, [], "devign_")]
    b = rows(spark, [("int f;", "1", "CWE-119")], "func_before string, vul string, `CWE ID` string")
    assert [(r.vulnerable, list(r.cwe)) for r in readers.big_vul(b).collect()] == [(True, ["CWE-119"])]


def test_folds_hold_one_state(spark):
    df = rows(spark, [(k % 7, k) for k in range(500)], "g long, k long").repartition(5)
    got = streams.fold_groups(df, ["g"], ["k"], lambda: [0, 0], lambda s, r: s.__setitem__(0, s[0] + r[1]) or [(r[0], s[0])], "g long, sum long", rows_per_batch=16)
    want = {g: sum(k for k in range(500) if k % 7 == g) for g in range(7)}
    assert {r.g: r.m for r in got.groupBy("g").agg(F.max("sum").alias("m")).collect()} == want and got.count() == 500
    assert streams.fold_groups(df.limit(0), ["g"], ["k"], list, lambda s, r: [], "g long").count() == 0
