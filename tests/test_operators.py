"""Single operators on rows with known results."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from verdictlake import vocab
from verdictlake.functions import columns as C
from verdictlake.operators import corpus, facts, matching, offline, redact, taint, verdicts
from verdictlake.operators import findings as findings_ops
from verdictlake.sources import readers
from verdictlake.streaming import latest

ROWS = "ord long, sample_id string, file string, cwe array<string>, line int"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_families_meet_through_parents():
    assert set(vocab.family("CWE-121")) & set(vocab.family("CWE-122")) >= {"CWE-119", "CWE-118"}
    assert "CWE-664" in vocab.family("CWE-415") and not set(vocab.family("CWE-78")) & set(vocab.family("CWE-190"))


@pytest.mark.parametrize("a,b,same", [("a/foo.c", "foo.c", True), ("verylongfoo.c", "foo.c", False), ("/x/a/foo.c", "a/foo.c", True), ("/a/foo.c", "/x/a/foo.c", False), ("a\\foo.c", "a/foo.c/", True), ("", "foo.c", False)])
def test_same_file(spark, a, b, same):
    assert value(spark, C.same_file(F.lit(a), F.lit(b))) is same


def test_scores_at_the_tolerance(spark):
    score = lambda p, g: value(spark, C.match_score(F.lit(True), F.array(F.lit("CWE-121")), F.array(F.lit("CWE-122")), F.lit(p).cast("int"), F.lit(g).cast("int")))
    assert score(10, 10) == pytest.approx(1.0)
    assert score(10, 15) == pytest.approx(0.65)
    assert score(10, None) == pytest.approx(0.75)
    assert score(10, 16) == 0


@pytest.mark.parametrize("b,c,p", [(8, 0, 0.0078125), (34, 1, 2.0955e-09), (41, 0, 9.0949e-13), (0, 0, 1.0), (1, 3, 0.625), (6, 0, 0.03125)])
def test_mcnemar(spark, b, c, p):
    assert value(spark, C.mcnemar_exact(F.lit(b), F.lit(c))) == pytest.approx(p, rel=1e-4)


def test_chi_square(spark):
    assert spark.sql("select 10.0D b, 0.0D c").select(offline.chi_square_p("b", "c").alias("p")).first()["p"] == pytest.approx(0.0044, abs=1e-4)


@pytest.mark.parametrize("x,n,low,high", [(3, 5, 0.230724, 0.882378), (0, 10, 0.0, 0.277533), (10, 10, 0.722467, 1.0), (0, 0, 0.0, 1.0)])
def test_wilson(spark, x, n, low, high):
    got = value(spark, C.wilson(F.lit(x), F.lit(n)))
    assert (got["low"], got["high"]) == (pytest.approx(low, abs=2e-6), pytest.approx(high, abs=2e-6))


def test_greedy_prefers_the_larger_index(spark):
    p = spark.createDataFrame([(0, "s", "f.c", ["CWE-122"], 5), (1, "s", "f.c", ["CWE-122"], 5)], ROWS)
    g = spark.createDataFrame([(0, "s", "f.c", ["CWE-122"], 5, True), (1, "t", "f.c", ["CWE-122"], 5, True)], ROWS + ", vulnerable boolean")
    e = matching.evaluate(p, g)
    assert sorted((r.pi, r.gi) for r in e.matches.collect()) == [(0, 0), (1, 1)]


def test_benign_findings_count_each(spark):
    p = spark.createDataFrame([(k, "b", "b.c", ["CWE-78"], k) for k in range(3)] + [(9, "v", "v.c", ["CWE-78"], 4)], ROWS)
    g = spark.createDataFrame([(0, "b", "b.c", ["CWE-78"], None, False), (1, "v", "v.c", ["CWE-78"], 4, True), (2, "w", "w.c", ["CWE-78"], 4, True)], ROWS + ", vulnerable boolean")
    c = matching.evaluate(p, g).confusion().first()
    assert (c.tp, c.fp, c.fn, c.tn, c.s_tp, c.s_fp, c.s_fn, c.s_tn) == (1, 3, 1, 0, 1, 1, 1, 0)


def test_partitions_do_not_matter(spark):
    p = spark.createDataFrame([(k, f"s{k % 7}", f"d{k % 5}/f{k % 3}.c", ["CWE-122"], k % 9) for k in range(60)], ROWS)
    g = spark.createDataFrame([(k, f"s{k}", f"f{k % 3}.c", ["CWE-121"], k) for k in range(7)], ROWS).withColumn("vulnerable", F.lit(True))
    found = [sorted(map(tuple, matching.evaluate(p.repartition(n), g.repartition(n)).matches.select("pi", "gi").collect())) for n in (1, 8)]
    assert found[0] == found[1] and found[0]


def test_empty_tables(spark):
    p, g = spark.createDataFrame([], ROWS), spark.createDataFrame([], ROWS + ", vulnerable boolean")
    c = matching.rates(matching.evaluate(p, g).confusion()).first()
    assert c.tp == c.fp == c.fn == c.tn == 0 and c.precision == 0


@pytest.mark.parametrize("x,want", [("0.4", 0.4), ("2", 1.0), ("-1", 0.0), ("NaN", 0.0), ("inf", 0.0), ("x", 0.0), (None, 0.0)])
def test_clamp(spark, x, want):
    assert value(spark, C.clamp_confidence(F.lit(x))) == want


def test_correlation_joins_the_first_group(spark):
    rows = [(0, "a.c", 10, ["CWE-1"], "r.1", None), (1, "a.c", 30, ["CWE-2"], "s.1", "f"), (2, "a.c", 12, ["CWE-9"], "r.2", None), (3, "a.c", 90, ["CWE-2"], "t.1", "f"), (4, "a.c", 40, ["CWE-2"], "u", None)]
    df = spark.createDataFrame(rows, "ord long, file string, line int, cwe array<string>, rule_id string, function string")
    assert {r.ord: r.group for r in findings_ops.correlate(df).collect()} == {0: 0, 2: 0, 1: 1, 3: 1, 4: 2}


def test_merge_confirmed(spark):
    rows = [(0, "f", 10, ["CWE-476"], 0.6, "CONFIRMED"), (1, "f", 12, ["CWE-787"], 0.9, "CONFIRMED"), (2, "f", 50, ["CWE-125"], 0.5, "CONFIRMED"), (3, "f", 80, ["CWE-89"], 0.5, "CONFIRMED"), (4, "f", 80, ["CWE-89"], 0.5, "REJECTED")]
    got = verdicts.merge_confirmed(spark.createDataFrame(rows, "ord long, file string, line int, cwe array<string>, confidence double, status string")).orderBy("ord").collect()
    assert [(r.ord, r.line, list(r.cwe), r.merged) for r in got] == [(1, None, ["CWE-787", "CWE-476", "CWE-125"], 3), (3, 80, ["CWE-89"], 1)]


def test_claim_sites_compare_with_the_first(spark):
    df = spark.createDataFrame([("f", 1, k, x) for k, x in enumerate([10, 14, 18, None, 15])], "file string, claim int, ord long, line int")
    assert {r.ord: r.site for r in verdicts.claim_sites(df).collect()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0}


def test_evidence_without_a_line_is_near(spark):
    ev = spark.createDataFrame([("f", 10, 0), ("f", None, 1), ("f", 90, 2), ("g", 50, 3), ("g", 60, 4)], "file string, line int, chain int")
    asked = spark.createDataFrame([(0, "f", 12), (1, "f", 50), (2, "f", None), (3, "g", 5)], "id long, file string, line int")
    got = sorted((r.id, r.chain) for r in verdicts.near_or_all(ev, asked).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (2, 0), (2, 1), (2, 2), (3, 3), (3, 4)]


def test_context_is_widened_to_the_function(spark):
    text = "\n".join(f"l{k}" for k in range(1, 1001))
    rows = [(0, "f", 50, text), (1, "f", 400, text), (2, "f", 950, text), (3, "f", None, text), (4, "g", 3, "a\nb\nc\nd"), (5, "f", 790, text)]
    functions = spark.createDataFrame([(0, "f", 40, 90), (1, "f", 45, 60), (2, "f", 100, 900), (3, "g", 1, 9)], "ord long, file string, start_line int, end_line int")
    got = {r.ord: r for r in findings_ops.source_context(spark.createDataFrame(rows, "ord long, file string, line int, text string"), functions).collect()}
    spans = {k: (r.start_line, r.end_line, r.truncated) for k, r in got.items()}
    assert spans == {0: (40, 90, False), 1: (300, 699, True), 2: (942, 958, False), 3: (1, 17, False), 4: (1, 4, False), 5: (590, 900, True)}
    assert got[4].snippet == "     1: a\n     2: b\n     3: c\n     4: d" and got[1].snippet.split("\n")[100] == "   400: l400"


def chains(text, language):
    return [(c["category"], c["proven"], c["mitigation_rule"], c["origin"]) for c in taint.file_chains(facts.file_facts("p", language, text))]


@pytest.mark.parametrize("body,want", [
    ("    os.system(x)\n", ("command_injection", True, "", "parameter")),
    ("    subprocess.run([x])\n", ("command_injection", True, "argument-list", "parameter")),
    ("    subprocess.run(x, shell=False)\n", ("command_injection", True, "no-shell", "parameter")),
    ("    cursor.execute('q', (x,))\n", ("sql_injection", True, "parameterised-query", "parameter")),
    ("    yaml.load(x, Loader=yaml.SafeLoader)\n", ("unsafe_deserialization", True, "safe-loader", "parameter")),
    ("    eval(ast.literal_eval(x))\n", ("code_injection", False, "", "")),
    ("    y = input()\n    z = y + '1'\n    eval(z)\n", ("code_injection", True, "", "external-source")),
    ("    eval(input())\n", ("code_injection", True, "", "external-source")),
])
def test_python_taint(body, want):
    assert chains("def f(x):\n" + body, "python") == [want]


@pytest.mark.parametrize("body,want", [
    ("  char *d = malloc(strlen(s) + 1);\n  strcpy(d, s);\n", "sized-destination"),
    ("  memcpy(d, s, 10);\n", "constant-length"),
    ("  memcpy(d, s, strlen(s));\n", "length-bounded"),
    ("  memcpy(d, s, n);\n", ""),
])
def test_c_mitigation(body, want):
    assert chains("void f(char *s, int n) {\n" + body + "}\n", "c")[-1][2] == want


def test_unknown_language_has_no_rows():
    assert chains("x", None) == []


def test_broken_python_is_an_error_row():
    assert facts.file_facts("p", "python", "def (")["parse_has_errors"]


def test_repair_json():
    good = '{"a": "x\\"y", "b": [1, "z"]}'
    assert redact.mended(good) == good
    assert json.loads(redact.mended('{"a": "no "hole" here\n", "b": 1}')) == {"a": 'no "hole" here\n', "b": 1}
    assert json.loads(redact.mended('{"a": "x\\\\", "b": "\x01 \\" y" z", "c": ["q"w"]}')) == {"a": "x\\", "b": '\x01 " y" z', "c": ['q"w']}
    assert redact.mended('"open') == '"open' and redact.mended("") == "" and redact.mended(None) is None
    assert redact.mended('{"a": "tab\there", "b": "\\u0041"}') == '{"a": "tab\\there", "b": "\\u0041"}'


@pytest.mark.parametrize("expression,want", [("f(a, g(b, c), [d, e])", ["a", "g(b, c)", "[d, e]"]), ("f()", [""]), ("f", []), ("(char *) p.q(x, {1: 2, 3: 4})", ["x", "{1: 2, 3: 4}"]), ("f(a, b", ["a", "b"]), ("f(a)(b, c)", ["a"])])
def test_arguments(expression, want):
    assert taint.arguments(expression) == want


@pytest.mark.parametrize("expression,want", [("os.path.join(a, os.path.basename(b))", "os.path.join(a,  __sanitized__ )"), ("int(x) + y", " __sanitized__  + y"), ("print(x)", "print(x)"), ("x.json.loads(int(y)) + quote (z)", "x. __sanitized__  +  __sanitized__ "), ("point(int)", "point(int)"), ("int(a", " __sanitized__ ")])
def test_sanitized_calls_are_blanked(expression, want):
    assert taint.unsanitized(expression) == want


def test_nested_json_is_redacted_in_two_passes(spark):
    value = {"CWE-787": ["juliet/CWE-787/bad/func1_bad_2.c:12", "CWE-787", "see badSink()", 3, None], "f": "C:\\x\\safe\\y.py", "n": "note:12"}
    got = redact.redacted(value)
    sha = lambda x: redact._neutral(x)
    # the name of the folder is gone before the path is looked at
    assert got["CWE-787"][0] == f"juliet/{sha('CWE-787')}/{sha('bad')}/{sha('func1_bad_2')}.c:12"
    assert got["CWE-787"][1:] == ["CWE-787", f"see {sha('badSink')}()", 3, None]
    assert got["f"] == f"C:/x/{sha('safe')}/y.py" and got["n"] == "note:12"
    assert redact.redacted("badSink a.c", identifiers=False, paths=False) == "badSink a.c"
    paths = ["juliet/CWE-1/bad/f_bad.c:12", "C:\\a\\good\\x.py", "lib/safe/u.h", "bad.c", "x/good1/y.mm", "a/b.c", "goodwill/embad.c:3"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string").select(C.sanitize_path("p").alias("q"))
    assert [redact.neutral_path(p) for p in paths] == [r.q for r in frame.collect()]


def test_balanced_samples(spark):
    rows = [(k, f"s{k}", k % 4 == 0) for k in range(40)]
    df = spark.createDataFrame(rows, "ord long, sample_id string, vulnerable boolean")
    count = lambda d: tuple(sum(r.vulnerable is x for r in d.collect()) for x in (True, False))
    assert count(corpus.balanced_sample(df)) == (10, 10)
    assert count(corpus.balanced_sample(df, 7)) == (4, 3)
    assert count(corpus.balanced_sample(df, 1)) == (1, 0)
    assert count(corpus.balanced_sample(df.where("vulnerable"))) == (10, 0)
    assert count(corpus.balanced_sample(df.where("vulnerable"), 4)) == (4, 0)
    assert count(corpus.balanced_sample(df, balanced=False)) == (10, 30)
    assert count(corpus.balanced_sample(df, 15, balanced=False)) == (10, 5)
    want = sorted(rows, key=lambda r: hashlib.sha256(f"7|{r[1]}".encode()).hexdigest())[:9]
    assert sorted(r.ord for r in corpus.first_seeded(df, 9, 7).collect()) == sorted(r[0] for r in want)


def test_findings_without_a_file_stand_alone(spark):
    rows = [(k, f, 10, ["CWE-1"], "r.1", None) for k, f in enumerate(["", "", None, None, "a", "a"])]
    df = spark.createDataFrame(rows, "ord long, file string, line int, cwe array<string>, rule_id string, function string")
    got = {r.ord: (r.file, r.group) for r in findings_ops.correlate(df).collect()}
    assert len({got[k] for k in range(4)}) == 4 and got[4] == got[5]


def test_cells_contexts_and_failures(spark):
    cell = lambda x, p=False: list(value(spark, C.cwe_from_cell(F.lit(x), p)))
    assert cell("119 120") == ["CWE-119", "CWE-120"] and cell("CWE-079") == ["CWE-79"] and cell("cwe-362/CWE-367!", True) == ["CWE-362", "CWE-367"] and cell("120, x", True) == []
    text = F.lit("a\nb\nc\n")
    assert value(spark, C.context_window(text, F.lit(None).cast("int"))) == "a\nb\nc" == value(spark, C.context_window(text, F.lit(0)))
    assert value(spark, C.context_window(text, F.lit(2), radius=1)) == "     1: a\n     2: b\n     3: c"
    kinds = {"TruncatedResponse: x": "none", "TimeoutError": "timeout", "ValueError: json": "parse", "RuntimeError: 503": "transport", "TypeError: x": "none", None: "none", "asyncio.TimeoutError: x": "timeout"}
    assert {k: value(spark, verdicts.failure_kind_of_call(F.lit(k).cast("string"))) for k in kinds} == kinds
    assert value(spark, verdicts.backoff_delay(F.lit(1), F.lit(0.0))) == 1.0 and value(spark, verdicts.backoff_delay(F.lit(9), F.lit(0.5))) == 15.0
    reason = lambda n, failed, proposed, found: value(spark, verdicts.fallback_reason(F.lit(n), F.lit(failed), F.lit(proposed), F.lit(found)))
    assert [reason(*x) for x in ((0, True, 0, 0), (0, False, 2, 0), (0, False, 0, 3), (0, False, 0, 0), (1, True, 2, 3))] == ["scanner_failed", "all_hypotheses_dropped_as_echoes", "scanner_declined_but_tools_flagged_the_file", "", ""]


def test_branches_and_dangerous_calls():
    python = "def f(x):\n    if x:\n        pass\n    elif input():\n        y = 1 if x else 2\n    try:\n        os.popen(x)\n    finally:\n        pass\n    match x:\n        case 1:\n            subprocess.Popen(x)\n"
    got = facts.file_facts("p", "python", python)
    assert got["branch_count"] == 3 and [c["name"] for c in got["dangerous_calls"]] == ["input", "os.popen"]
    c = "#if X\n#endif\nvoid f(int a) {\n  switch (a) { case 1: scanf(a); case 2: break; }\n  do { a--; } while (a);\n  while (a) { a--; }\n  if (a) {} else if (a > 1) {}\n}\n"
    got = facts.file_facts("p", "c", c)
    assert got["branch_count"] == 5 and [c["name"] for c in got["dangerous_calls"]] == ["scanf"]
    assert facts.file_facts("p", "cpp", "void f() {\n  for (auto x : y) {}\n  for (int i = 0; i < 1; i++) {}\n  try { g(); } catch (int e) {}\n}\n")["branch_count"] == 2


def test_comments_keep_places():
    text = 'int x; // bad\nchar *s = "// no"; /* a\nb */ y();\n'
    got = redact.without_comments(text, "c")
    assert len(got) == len(text) and got.count("\n") == 3 and "bad" not in got and '"// no"' in got and "y();" in got


def test_manifest_and_lenient_lines(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"samples": [{"sample_id": "a", "file": "x.c", "cwe": ["CWE-1"], "line": 3}, {"sample_id": "b", "file": "/y.c"}]}))
    rows = readers.manifest(spark, str(tmp_path / "m.json")).orderBy("ord").collect()
    assert [(r.sample_id, r.line, list(r.cwe)) for r in rows] == [("a", 3, ["CWE-1"]), ("b", None, [])]
    (tmp_path / "bad.json").write_text(json.dumps([{"file": "x.c"}]))
    with pytest.raises(Exception, match="has no sample_id"):
        readers.manifest(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "r.jsonl").write_text('{"sample_id": "a"}\n\nnope\n{"x": 1}\n')
    good, bad = readers.json_lines_lenient(spark, str(tmp_path / "r.jsonl"), "sample_id string")
    assert good.count() == 1 and bad.count() == 2


def test_tool_reports(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"filename": "a.py", "line_number": 3, "test_id": "B602", "issue_text": "t", "issue_severity": "HIGH", "issue_confidence": "MEDIUM", "issue_cwe": {"id": 78}}]}))
    r = readers.bandit(spark, str(tmp_path / "b.json")).first()
    assert (r.rule_id, r.line, list(r.cwe), r.confidence) == ("B602", 3, ["CWE-78"], 0.66)
    (tmp_path / "c.xml").write_text('<results><errors><error id="nullPointer" severity="error" msg="m" cwe="476"><location file="a.c" line="4" column="1"/></error><error id="x" severity="style" msg="s"/></errors></results>')
    r = readers.cppcheck(spark, str(tmp_path / "c.xml")).collect()
    assert [(x.rule_id, x.line, list(x.cwe)) for x in r] == [("nullPointer", 4, ["CWE-476"])]
    (tmp_path / "f.csv").write_text('File,Line,Level,Name,Warning,CWEs\na.c,7,4,strcpy,"Does, not",CWE-120!/CWE-20\n')
    r = readers.flawfinder(spark, str(tmp_path / "f.csv")).first()
    assert (r.severity, list(r.cwe), r.message) == ("HIGH", ["CWE-120", "CWE-20"], "Does, not")


def test_stream_keeps_the_latest_success(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    for k, lines in enumerate([[("a", 1, "CONFIRMED"), ("b", 2, "ERROR")], [("a", 3, "ERROR"), ("b", 4, "REJECTED")], [("a", 5, "ERROR")]]):
        (log / f"{k}.json").write_text("\n".join(json.dumps({"sample_id": s, "lineno": n, "decision": d, "elapsed": 1.0, "model": "m"}) for s, n, d in lines))
    for _ in range(2):  # a second run finds nothing new
        q = latest.run(latest.read_log(spark, str(log), 1), str(tmp_path / "state"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert sorted(p.name for p in (tmp_path / "state").iterdir() if p.is_dir()) == ["v=1", "v=2"]
    state = spark.read.parquet(str(tmp_path / "state/v=2"))
    assert sorted((r.sample_id, r.lineno, r.decision) for r in state.collect()) == [("a", 1, "CONFIRMED"), ("b", 4, "REJECTED")]
    samples = spark.createDataFrame([("a",), ("c",)], "sample_id string")
    assert [r.sample_id for r in latest.todo(samples, state).collect()] == ["c"]


def test_fixed_twins_and_corpora(spark):
    df = spark.createDataFrame([(0, ["CWE-1"], "bad", "good", "1"), (1, [], "ok", "ok2", "0"), (2, [], "v", " ", "true")], "ord long, cwe array<string>, func_before string, func_after string, vul string")
    assert sorted((r.ord, r.variant, r.vulnerable) for r in readers.fixed_twins(df).collect()) == [(0, "after", False), (0, "before", True), (1, "before", False), (2, "before", True)]
    c = spark.createDataFrame([("x", "1", "CWE-7"), ("x", "0", ""), (" ", "1", ""), ("y", "0", "CWE-9")], "src string, y string, c string")
    got = readers.functions_corpus(c, "src", "y", "c", wanted=["CWE-9"]).collect()
    assert [(r.text, r.vulnerable) for r in got] == [("y", False)]


def test_twins_stay_once(spark):
    df = spark.createDataFrame([(0, "a", "b"), (1, "a", "c"), (2, "b", "d"), (3, "e", "b"), (4, "f", "g")], "ord long, func_before string, func_after string").selectExpr("*", "cast(array() as array<string>) as cwe", "'1' as vul")
    got = readers.dedup_twins(readers.fixed_twins(df)).collect()
    assert sorted((r.ord, r.variant, r.text) for r in got) == [(0, "after", "b"), (0, "before", "a"), (3, "before", "e"), (4, "after", "g"), (4, "before", "f")]


def test_language_corpus(spark):
    rows = [(0, 7, "x", "CWE-79", "CWE-80, CWE-20", "1", "C", "f"), (1, 7, "y", "CWE-79", None, "0", "c", "g"), (2, 8, "x", "CWE-79", None, "1", "c", "h"), (3, 9, "z", "CWE-1", None, "0", "c", "i"), (4, 9, "w", "CWE-79", None, "1", "java", "j")]
    df = spark.createDataFrame(rows, "ord long, idx long, code string, CWE_ID string, RELATED_CWE string, target string, language string, function_name string")
    got = sorted((r.sample_id, r.vulnerable, list(r.related_cwe)) for r in readers.language_corpus(df, ["c"], ["CWE-79"], "v").collect())
    assert got == [("v_7", True, ["CWE-20", "CWE-80"]), ("v_7_2", False, [])]


def test_sard(spark):
    files = spark.createDataFrame([("/r/CWE122_x/bad/a.c", "c", "t"), ("/r/CWE122_x/good/b.c", "c", "t"), ("/r/CWE122_x/c.c", "c", "t")], "path string, language string, text string")
    known, unknown = readers.sard(files, "/r")
    assert sorted((r.file, r.vulnerable, list(r.cwe)) for r in known.collect()) == [("CWE122_x/bad/a.c", True, ["CWE-122"]), ("CWE122_x/good/b.c", False, ["CWE-122"])]
    assert unknown.count() == 1
    meta = spark.createDataFrame([("/r", "a", False), ("/r/CWE122_x", "xa1", True)], "folder string, name string, label boolean")
    got = readers.sard_metadata(files.withColumn("stem", F.lit("a")), meta).collect()
    assert {r.path[-3:]: r.vulnerable for r in got} == {"a.c": True, "b.c": True, "c.c": True}


def test_members_of_groups_by_packed_fingerprints(spark):
    texts = ["", "ab", "AB", "abc", "0ab", "zz", "ab\n", "\u00e9", "\x00", "\x01ab", hashlib.sha256(b"x").hexdigest(), None]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, fingerprint string")
    codes = df.select("fingerprint", C.packed("fingerprint").alias("code"), C.unpacked(C.packed("fingerprint")).alias("back")).collect()
    assert all(r.back == r.fingerprint for r in codes) and len({r.code for r in codes}) == len(texts) and len(codes[10].code) == 33
    groups = spark.createDataFrame([("g", ["ab", "ab", "\u00e9", None, "no"]), ("h", ["ab", "AB"]), ("h", ["AB"]), (None, ["abc"]), ("i", None), ("j", [])], "group_id string, fingerprints array<string>")
    want = [("None", "abc", 3), ("g", "ab", 1), ("g", "ab", 1), ("g", "\u00e9", 7), ("h", "AB", 2), ("h", "ab", 1), ("h", "ab", 1)]
    rows = df.unionAll(df.where("fingerprint = 'ab'"))  # listed twice is no second member, found twice is
    got = findings_ops.group_members(groups, rows)
    assert got.columns == ["fingerprint", "group_id", "ord"]
    assert sorted((str(r.group_id), r.fingerprint, r.ord) for r in got.collect()) == sorted(want)
