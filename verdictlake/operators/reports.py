"""Stored reports: what scanners, verifiers and runs have written, as tables.

A report is a row (sample_id, report) whose report is JSON text.  Members of
lists come out as JSON text of their own, so that a field of an unexpected kind
costs that field and not the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdictlake import vocab
from verdictlake.functions import columns as C

_NONE = "cast(array() as array<string>)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fields(json, *names: str) -> Column:
    """Named members of an object as text: strings bare, others as JSON."""
    return F.from_json(_c(json), ", ".join(f"`{n}` string" for n in names))


def members(json) -> Column:
    """The objects of a list, as JSON text; anything else has none."""
    whole = F.coalesce(F.from_json(_c(json), "array<string>"), F.expr(_NONE))
    return F.filter(whole, lambda x: F.coalesce(x.rlike(r"^\s*\{"), F.lit(False)))


def truthy(json) -> Column:
    """Whether a member says anything: not null, empty, false, zero."""
    x = F.trim(_c(json))
    return F.coalesce(~x.isin("", "null", "false", "[]", "{}") & ~x.rlike(r"^-?0+(\.0+)?$"), F.lit(False))


def text_list(json, drop_empty: bool = True) -> Column:
    """A list of texts from a list, a text or a number; nothing from nothing."""
    x = _c(json)
    many = F.coalesce(F.from_json(x, "array<string>"), F.expr(_NONE))
    kept = F.filter(many, truthy) if drop_empty else F.transform(many, lambda v: F.coalesce(v, F.lit("None")))
    is_list = x.rlike(r"^\s*\[")
    return F.when(is_list, kept).when(truthy(x) if drop_empty else x.isNotNull(), F.array(x)).otherwise(F.expr(_NONE))


def safe_int(json) -> Column:
    """A whole number, a number's whole part, or null."""
    x = F.trim(_c(json))
    return F.when(x.rlike(r"^[+-]?\d+(\.\d*)?$"), F.regexp_extract(x, r"^([+-]?\d+)", 1).try_cast("int"))


def source_of(report) -> Column:
    r = fields(report, "source", "path")
    return F.coalesce(F.nullif(r["source"], F.lit("")), r["path"], F.lit(""))


# -- report scan


def scan(texts: DataFrame, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reports, unreadable texts) of rows (path, value): whole documents, or
    lines of JSON.  A document is one report, a list of reports, or an object
    of reports by name, of which those with a source count."""
    rows = texts.where(F.trim("value") != "") if lines else texts
    known = rows.withColumn("ok", F.try_parse_json("value").isNotNull())
    keys = F.coalesce(F.map_keys(F.from_json("value", "map<string,string>")), F.expr(_NONE))
    by_name = F.filter(members_of_map("value"), lambda x: F.get_json_object(x, "$.source").isNotNull())
    one = F.array("value")
    if lines:
        found = one
    else:
        found = F.when(F.col("value").rlike(r"^\s*\["), members("value")).when(F.arrays_overlap(keys, F.array(F.lit("source"), F.lit("findings"))), one).otherwise(by_name)
    return known.where("ok").select("path", F.explode(found).alias("report")), known.where("not ok").select("path", "value")


def members_of_map(json) -> Column:
    values = F.coalesce(F.map_values(F.from_json(_c(json), "map<string,string>")), F.expr(_NONE))
    return F.filter(values, lambda x: F.coalesce(x.rlike(r"^\s*\{"), F.lit(False)))


# -- predictions


def predictions_from_phase1(reports: DataFrame) -> DataFrame:
    """Every finding of a report is a prediction; the verdicts of agents do not
    touch the static baseline."""
    rows = reports.select("sample_id", source_of("report").alias("src"), F.posexplode(members(fields("report", "findings")["findings"])).alias("ord", "raw"))
    f = F.col("f")
    return rows.withColumn("f", fields("raw", "tool", "file", "line", "cwe", "confidence", "fingerprint")).select(
        "sample_id", "ord", F.coalesce(F.nullif(f["file"], F.lit("")), "src").alias("file"), F.lit(True).alias("vulnerable"), text_list(f["cwe"]).alias("cwe"), safe_int(f["line"]).alias("line"),
        F.lit("CONFIRMED").alias("status"), C.clamp_confidence(f["confidence"]).alias("confidence"), F.coalesce(F.nullif(f["tool"], F.lit("")), F.lit("phase1")).alias("source"), f["fingerprint"].alias("fingerprint"), "raw",
    )


def predictions_from_phase2(reports: DataFrame, statuses: tuple[str, ...] = ("CONFIRMED",)) -> DataFrame:
    """Decisions with a wanted status; one that is no status is uncertain."""
    wanted = {s.upper() for s in statuses}
    if unknown := sorted(wanted - set(vocab.STATUSES)):
        raise ValueError(f"unknown decision status {unknown}; expected some of {list(vocab.STATUSES)}")
    rows = reports.select("sample_id", source_of("report").alias("src"), F.posexplode(members(fields("report", "decisions")["decisions"])).alias("ord", "raw"))
    d = F.col("d")
    return rows.withColumn("d", fields("raw", "file", "line", "cwe", "confidence", "status")).withColumn("status", C.verdict(d["status"])).where(F.col("status").isin(*sorted(wanted))).select(
        "sample_id", "ord", F.coalesce(F.nullif(d["file"], F.lit("")), "src").alias("file"), F.lit(True).alias("vulnerable"), text_list(d["cwe"]).alias("cwe"), safe_int(d["line"]).alias("line"),
        "status", C.clamp_confidence(d["confidence"]).alias("confidence"), F.lit("phase2").alias("source"), "raw",
    )


def predictions_from_records(records: DataFrame, experiment: str) -> DataFrame:
    """Confirmed records (JSON text) of a run that asked about whole files."""
    r = F.col("r")
    rows = records.withColumn("r", fields("record", "sample_id", "file", "line", "cwe", "confidence", "decision"))
    return rows.where(F.upper(r["decision"]) == "CONFIRMED").select(
        r["sample_id"].alias("sample_id"), F.coalesce(r["file"], F.lit("")).alias("file"), F.lit(True).alias("vulnerable"), text_list(r["cwe"]).alias("cwe"), safe_int(r["line"]).alias("line"),
        F.lit("CONFIRMED").alias("status"), r["confidence"].try_cast("double").alias("confidence"), F.lit(experiment).alias("source"), F.col("record").alias("raw"),
    )


# -- replies of agents


def envelope(body) -> Column:
    """struct(text, thinking, usage, error) of a chat completion.  The content
    is a text or typed blocks; a reply that was cut off, that has no choices or
    no content, is an error with its name, as failure_kind_of_call reads it."""
    b = _c(body)
    choice = F.try_element_at(members(F.get_json_object(b, "$.choices")), F.lit(1))
    message = F.get_json_object(choice, "$.message")
    content = F.get_json_object(message, "$.content")
    blocks = F.coalesce(F.from_json(content, "array<string>"), F.expr(_NONE))
    of_block = lambda x: F.when(x.rlike(r"^\s*\{"), F.coalesce(F.get_json_object(x, "$.text"), F.lit(""))).otherwise(F.coalesce(x, F.lit("")))
    text = F.trim(F.when(content.rlike(r"^\s*\["), F.array_join(F.transform(blocks, of_block), "")).otherwise(F.coalesce(content, F.lit(""))))
    thinking = F.coalesce(*[F.nullif(F.get_json_object(message, f"$.{k}"), F.lit("")) for k in ("reasoning_content", "reasoning", "thinking", "analysis")], F.lit(""))
    finish = F.lower(F.coalesce(F.get_json_object(choice, "$.finish_reason"), F.lit("")))
    said = F.coalesce(F.get_json_object(b, "$.error"), b, F.lit("null"))
    error = (
        F.when(~F.coalesce(b.rlike(r"^\s*\{"), F.lit(False)), F.concat(F.lit("ValueError: a reply that is no object: "), F.left(F.coalesce(b, F.lit("null")), F.lit(300))))
        .when(~truthy(F.get_json_object(b, "$.choices")), F.concat(F.lit("ValueError: a reply without choices: "), F.left(said, F.lit(300))))
        .when(finish == "length", F.lit("TruncatedResponse: cut off"))
        .when(text == "", F.concat(F.lit("ValueError: a reply without content"), F.coalesce(F.concat(F.lit(": "), F.nullif(F.get_json_object(message, "$.refusal"), F.lit(""))), F.lit("")), F.lit(" (finish_reason="), F.coalesce(F.nullif(finish, F.lit("")), F.lit("unknown")), F.lit(")")))
    )
    return F.struct(F.when(error.isNull(), text).alias("text"), thinking.alias("thinking"), F.coalesce(F.get_json_object(b, "$.usage"), F.lit("{}")).alias("usage"), error.alias("error"))


def hypotheses_of(replies: DataFrame) -> DataFrame:
    """Rows (file, reply): the scanner's hypotheses, under any of the names that
    it uses for the list; those without claim and class are no hypotheses.
    Numbers are given before these are left out."""
    r = fields("reply", "hypotheses", "findings", "candidates")
    named = F.when(truthy(r["hypotheses"]), r["hypotheses"]).when(truthy(r["findings"]), r["findings"]).otherwise(r["candidates"])
    raw = F.when(F.col("reply").rlike(r"^\s*\["), F.col("reply")).otherwise(named)
    whole = F.when(raw.rlike(r"^\s*\{"), F.array(raw)).otherwise(F.coalesce(F.from_json(raw, "array<string>"), F.expr(_NONE)))
    h = F.col("h")
    one = F.when(h["cwe"].rlike(r"^\s*\["), F.coalesce(F.try_element_at(F.from_json(h["cwe"], "array<string>"), F.lit(1)), F.lit(""))).when(truthy(h["cwe"]), h["cwe"]).otherwise("")
    text = lambda n: F.trim(F.coalesce(h[n], F.lit("")))
    rows = replies.select("file", F.posexplode(whole).alias("ord", "raw")).where(F.col("raw").rlike(r"^\s*\{")).withColumn("h", fields("raw", "cwe", "line", "claim", "suspected_source", "suspected_sink", "id"))
    out = rows.select("file", "ord", F.upper(F.trim(one)).alias("cwe"), safe_int(h["line"]).alias("line"), text("claim").alias("claim"), text("suspected_source").alias("suspected_source"), text("suspected_sink").alias("suspected_sink"), F.when(truthy(h["id"]), h["id"]).otherwise(F.concat(F.lit("H"), F.col("ord") + 1)).alias("id"))
    return out.where("claim <> '' or cwe <> ''")


VERIFICATION = ("decision", "confidence", "cwe", "severity", "explanation", "rationale", "evidence", "missing_evidence", "source_location", "chain_verified")


def verification_of(reply) -> Column:
    """A verifier's reply as a struct; usable where it is an object with one of
    the decisions, else uncertain and said so."""
    r = fields(reply, *VERIFICATION)
    object_ = F.coalesce(_c(reply).rlike(r"^\s*\{"), F.lit(False)) & F.try_parse_json(_c(reply)).isNotNull()
    said = F.upper(F.trim(F.coalesce(r["decision"], F.lit(""))))
    usable = object_ & said.isin(*vocab.STATUSES)
    given = F.when(truthy(r["explanation"]), r["explanation"]).when(truthy(r["rationale"]), r["rationale"]).otherwise("")
    why = F.when(~object_, "Verifier returned no usable JSON object.").when(given != "", given).when(usable, "").when(r["decision"].isNull(), "Verifier returned no decision field.").otherwise(F.concat(F.lit("Verifier answered '"), r["decision"], F.lit("', which is not a verdict.")))
    listed = F.when(r["cwe"].rlike(r"^\s*[{0-9-]"), F.expr(_NONE)).otherwise(text_list(r["cwe"]))
    return F.struct(
        F.when(usable, said).otherwise("UNCERTAIN").alias("decision"), F.when(object_, C.clamp_confidence(r["confidence"])).otherwise(0.0).alias("confidence"), listed.alias("cwe"),
        F.upper(F.coalesce(r["severity"], F.lit("UNKNOWN"))).alias("severity"), why.alias("explanation"), text_list(r["evidence"]).alias("evidence"), text_list(r["missing_evidence"]).alias("missing_evidence"),
        r["source_location"].alias("source_location"), truthy(r["chain_verified"]).alias("chain_verified"), usable.alias("usable"),
    )


def normalized_reply(reply, group) -> Column:
    """A single agent's reply as a decision; what it leaves out of class,
    severity and location comes from the group it was asked about (struct of
    file, line, cwe, severity)."""
    r = fields(reply, "decision", "confidence", "rationale", "evidence", "missing_evidence", "source_location", "cwe", "severity")
    g = _c(group)
    said = text_list(r["cwe"], drop_empty=False)
    severity = F.upper(F.coalesce(F.when(truthy(r["severity"]), r["severity"]), F.nullif(g["severity"], F.lit("")), F.lit("UNKNOWN")))
    place = F.when((F.coalesce(g["file"], F.lit("")) != "") & g["line"].isNotNull(), F.concat(g["file"], F.lit(":"), g["line"].cast("string")))
    return F.struct(
        C.verdict(r["decision"]).alias("decision"), C.clamp_confidence(r["confidence"]).alias("confidence"), F.coalesce(r["rationale"], F.lit("")).alias("rationale"),
        text_list(r["evidence"], drop_empty=False).alias("evidence"), text_list(r["missing_evidence"], drop_empty=False).alias("missing_evidence"), F.coalesce(r["source_location"], place).alias("source_location"),
        F.when(F.size(said) > 0, said).otherwise(F.coalesce(g["cwe"], F.expr(_NONE))).alias("cwe"), F.when(severity.isin(*vocab.SEVERITIES), severity).otherwise("UNKNOWN").alias("severity"),
    )


def group_decisions(groups: DataFrame, replies: DataFrame, most: int = 50) -> DataFrame:
    """Single-agent verdicts: one decision for each of a report's first groups
    (file, group, ord, line, cwe, severity) that has a reply (file, group,
    reply); the others have none, and truncated says that there are more."""
    w = Window.partitionBy("file")
    first = groups.withColumns({"place": F.row_number().over(w.orderBy("ord")), "truncated": F.count("*").over(w) > most}).where(F.col("place") <= most)
    asked = F.struct("file", "line", "cwe", "severity")
    return first.join(replies, ["file", "group"]).select("file", "group", "truncated", F.inline(F.array(normalized_reply("reply", asked))))


# -- packets and decisions


def structural_summary(facts: DataFrame, most: int = 40) -> DataFrame:
    """Facts of files cut to what an agent can use: so many functions, calls
    and imports, beside how many functions there are."""
    cut = lambda c: F.slice(c, 1, most).alias(c)
    return facts.select("path", "language", F.size("functions").alias("function_count"), cut("functions"), cut("dangerous_calls"), cut("imports"), F.col("parse_has_errors").alias("parse_error"))


def evidence_packet(parts: dict[str, Column]) -> Column:
    """The parts as JSON with leaking names and paths replaced; parts that are
    null are left out."""
    from verdictlake.operators.redact import sanitize_json

    return sanitize_json(F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()])))


def decisions_of(verified: DataFrame, verifier_owns: bool = True) -> DataFrame:
    """Rows of a hypothesis (id, cwe, line), its verification (struct v) and the
    gate's reason: the decision that is stored.  A confirmation that a gate has
    overruled is a rejection, and classes of other families are noted."""
    from verdictlake.operators import verdicts as D

    v = F.col("v")
    gated = F.col("reason") != ""
    note = F.when(gated, F.col("reason")).otherwise(v["explanation"])
    status = F.when(gated & (v["decision"] == "CONFIRMED"), "REJECTED").otherwise(v["decision"])
    return verified.select("file", F.col("id").alias("group_id"), "line", status.alias("status"), v["confidence"].alias("confidence"), D.resolved_class(v["cwe"], F.col("cwe"), verifier_owns).alias("cwe"), v["severity"].alias("severity"), D.divergence_note(note, F.col("cwe"), v["cwe"], verifier_owns).alias("rationale"), v["evidence"].alias("evidence"), v["missing_evidence"].alias("missing_evidence"))


def report_findings(confirmed: DataFrame, chains: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed hypotheses (file, id, cwe, line, v) as a report's entries: the
    first resolved class with its catalogue fields, and of the file's proven
    chains (file, ord, sink_line, ...) the nearest, or the first without a line.
    The file is the one that was analysed; of the verifier's location only the
    line counts, and the first chain's sink stands in where it names no place."""
    from verdictlake.operators import catalog as K
    from verdictlake.operators import verdicts as D

    v = F.col("v")
    primary = F.coalesce(F.try_element_at(D.resolved_class(v["cwe"], F.col("cwe")), F.lit(1)), F.lit(""))
    rows = confirmed.withColumn("primary", primary)
    key = F.struct(F.coalesce(F.abs(F.coalesce("sink_line", F.lit(0)) - F.col("line")), F.lit(0)), "chain_ord")
    c = chains.where("source_expression <> ''").select("file", F.col("ord").alias("chain_ord"), F.struct("function", "source_expression", "sink_expression", "source_line", "sink_line", "origin").alias("chain"), F.col("sink_line"))
    best = rows.select("file", "id", "line").join(c, "file").groupBy("file", "id").agg(F.min_by("chain", key).alias("chain"))
    sinks = chains.where("sink_line > 0").groupBy("file").agg(F.min_by("sink_line", "ord").alias("first_sink"))
    fields_ = K.report_fields(rows.select(F.col("primary").alias("cwe")).distinct(), classes)
    place = F.coalesce(v["source_location"], F.lit(""))
    where = F.when(place.contains(":"), C.parse_location(place)).otherwise(F.col("first_sink"))
    joined = rows.join(best, ["file", "id"], "left").join(sinks, "file", "left").join(fields_.withColumnRenamed("cwe", "primary"), "primary", "left")
    return joined.select(
        "id", F.col("primary").alias("cwe"), v["severity"].alias("severity"), "file", where.alias("line"), F.col("chain.function").alias("function"),
        v["explanation"].alias("explanation"), F.coalesce("chain.source_expression", F.lit("")).alias("source"), F.coalesce("chain.sink_expression", F.lit("")).alias("sink"), "chain.source_line", "chain.sink_line", v["chain_verified"].alias("chain_verified"),
        F.coalesce("chain.origin", F.lit("")).alias("taint_origin"), F.coalesce("related_cves", F.expr(_NONE)).alias("related_cves"), F.coalesce("references", F.expr(_NONE)).alias("references"), v["confidence"].alias("confidence"),
    )


# -- runs


def report_counters(findings: DataFrame, groups: DataFrame) -> DataFrame:
    """Per file: tools, findings and groups."""
    a = findings.groupBy("file").agg(F.count_distinct("tool").alias("tool_count"), F.count("*").alias("finding_count"))
    b = groups.groupBy("file").agg(F.count_distinct("group").alias("group_count"))
    return a.join(b, "file", "left").fillna(0, ["group_count"])


def path_summary(reports: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: files, findings, and files that were skipped."""
    n = F.coalesce(F.sum(F.size(F.coalesce(F.from_json(fields("report", "findings")["findings"], "array<string>"), F.expr(_NONE)))), F.lit(0))
    return reports.agg(F.count("*").alias("files"), n.alias("findings")).withColumn("skipped", F.lit(errors.count()))


def run_totals(reports: DataFrame, most_errors: int = 8) -> DataFrame:
    """One row over a run's reports (ord, report): how many, their findings,
    decisions by status, errors, and the first errors with their source."""
    r = fields("report", "findings", "decisions", "errors")
    rows = reports.select("ord", source_of("report").alias("src"), F.size(F.coalesce(F.from_json(r["findings"], "array<string>"), F.expr(_NONE))).alias("n"), F.transform(members(r["decisions"]), lambda x: F.get_json_object(x, "$.status")).alias("s"), text_list(r["errors"]).alias("e"))
    counts = [F.coalesce(F.sum(F.expr(f"size(filter(s, x -> x = '{k}'))")), F.lit(0)).alias(k.lower()) for k in vocab.STATUSES]
    total = rows.agg(F.count("*").alias("reports"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), *counts, F.coalesce(F.sum(F.size("e")), F.lit(0)).alias("errors"))
    first = rows.select("ord", "src", F.posexplode("e").alias("k", "error")).orderBy("ord", "k").limit(most_errors)
    line = F.concat(F.coalesce(F.nullif(F.col("src"), F.lit("")), F.lit("<unknown>")), F.lit(": "), F.col("error"))
    details = first.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "k", line.alias("t")))), lambda x: x["t"]).alias("error_details"))
    return total.join(F.broadcast(details))  # single rows


def report_errors(entries: DataFrame) -> DataFrame:
    """(sample_id, error) of a run's entries (sample_id, entry): the reason of
    one that was skipped, and the errors of the reports within."""
    e = fields("entry", "skipped", "reason", "report", "phase1", "phase2")
    errors = lambda k: text_list(fields(e[k], "errors")["errors"])
    marked = lambda k: F.transform(errors(k), lambda x: F.concat(F.lit(f"{k}: "), x))
    skipped = F.array(F.concat(F.lit("skipped: "), F.coalesce(e["reason"], F.lit("unknown reason"))))
    found = F.when(truthy(e["skipped"]), skipped).otherwise(F.concat(errors("report"), marked("phase1"), marked("phase2")))
    return entries.select(F.coalesce("sample_id", F.lit("<unknown>")).alias("sample_id"), F.posexplode(found).alias("ord", "error"))


def error_summary(errors: DataFrame, most: int = 10) -> DataFrame:
    """One row: errors, samples that have some, and the first of them."""
    first = errors.orderBy("sample_id", "ord").limit(most).agg(F.sort_array(F.collect_list(F.struct("sample_id", "ord", "error"))).alias("first"))
    return errors.agg(F.count("*").alias("errors"), F.count_distinct("sample_id").alias("samples")).join(F.broadcast(first))  # single rows


def missing_files(samples: DataFrame, files: DataFrame, skip_missing: bool = True) -> DataFrame:
    """Samples with the state of their file: found, or skipped with the reason.
    Without skip_missing the first missing file is an error.  A skipped sample
    stays in the truth, so a vulnerable one counts as missed."""
    there = files.select(F.col("path").alias("file")).distinct().withColumn("there", F.lit(True))
    rows = samples.join(there, "file", "left")
    lost = F.col("there").isNull()
    if not skip_missing:
        rows = rows.withColumn("file", F.when(lost, F.raise_error(F.concat(F.lit("missing file: "), F.col("file")))).otherwise(F.col("file")))
    return rows.withColumns({"skipped": lost, "reason": F.when(lost, "missing file")}).drop("there")


def error_report(samples: DataFrame) -> Column:
    """What stands for the report of a sample whose file is missing."""
    return F.to_json(F.struct(F.col("file").alias("source"), F.lit("unknown").alias("language"), F.expr(_NONE).alias("findings"), F.array(F.concat(F.lit("missing file: "), F.col("file"))).alias("errors"), F.struct(F.lit(True).alias("analysis_failed")).alias("metadata")))


def row_name(result) -> Column:
    """A result's name in a comparison: the label it was launched with, and the
    experiment where that differs."""
    r = lambda path: F.get_json_object(_c(result), path)
    label = F.coalesce(F.nullif(r("$.metadata.provenance.label"), F.lit("")), F.nullif(r("$.metadata.provenance.experiment"), F.lit("")))
    name = r("$.experiment")
    return F.when(label.isNull() | (label == name), name).otherwise(F.concat(label, F.lit(" ("), name, F.lit(")")))


def provenance(values: dict[str, object]) -> Column:
    """A literal struct of what a run was made with; times as ISO text."""
    return F.struct(*[(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if v is ... else F.lit(v)).alias(k) for k, v in values.items()])


def result_documents(evaluation, experiment: str, config, per_class: DataFrame | None = None, origin: Column | None = None) -> DataFrame:
    """An evaluation as one row of JSON: metrics, matches, what is unmatched,
    classes and metadata.  Lists are gathered into the one document that they
    are, so this is for reports of a run, not for corpora."""
    from verdictlake.operators import matching as M

    e = evaluation
    rows = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    metrics = M.rates(e.confusion())
    cells = F.struct("tp", "fp", "fn", "tn")
    out = metrics.select(F.lit(experiment).alias("experiment"), F.struct(cells.alias("confusion"), *M.RATES).alias("metrics"))
    parts = [rows(e.matches.select("pi", "gi", "score"), "matches"), rows(e.failures(), "unmatched_predictions"), rows(e.unmatched_truth, "unmatched_ground_truth")]
    if per_class is not None:
        parts.append(rows(per_class, "per_cwe"))
    for part in (*parts, result_metadata(e, config), M.sample_level(e).select(F.struct("*").alias("sample_level"))):
        out = out.join(F.broadcast(part))  # single rows
    more = [F.col("sample_level")] + ([origin.alias("provenance")] if origin is not None else [])
    listed = [c for c in out.columns if c not in ("metadata", "sample_level")]
    return out.select(F.to_json(F.struct(*listed, F.struct("metadata.*", *more).alias("metadata"))).alias("value"))


def result_metadata(evaluation, config) -> DataFrame:
    """One row: how many predictions and truths there were, and the matching."""
    e = evaluation
    truth = e.truth.agg(F.count("*").alias("ground_truth_count"), F.count_if("vulnerable").alias("positive_ground_truth_count"), F.count_if(~F.col("vulnerable")).alias("negative_ground_truth_count"))
    n = e.positives.agg(F.count("*").alias("prediction_count"), F.count("*").alias("positive_prediction_count"))
    matching = F.struct(F.lit(config.line_tolerance).alias("line_tolerance"), F.lit(config.require_cwe).alias("require_cwe_when_available"))
    note = F.lit("precision, recall and F1 count findings; true negatives and all rates of benign samples count samples")
    return n.join(F.broadcast(truth)).select(F.struct("prediction_count", "positive_prediction_count", "ground_truth_count", "positive_ground_truth_count", "negative_ground_truth_count", matching.alias("matching"), note.alias("metric_granularity")).alias("metadata"))  # single rows


def chart_feed(results: DataFrame) -> DataFrame:
    """Per stored result (JSON text value) what charts show; a result without
    cells stops the read."""
    r = lambda path, kind="double": F.get_json_object("value", path).cast(kind)
    cell = {k: r(f"$.metrics.confusion.{k}", "long") for k in ("tp", "fp", "fn", "tn")}
    whole = F.when(cell["tp"].isNull(), F.raise_error(F.lit("a result has no confusion cells"))).otherwise(row_name("value"))
    return results.select(whole.alias("label"), *[v.alias(k) for k, v in cell.items()], *[r(f"$.metrics.{k}").alias(k) for k in ("precision", "recall", "f1")], r("$.metadata.sample_level.benign_flag_rate").alias("benign_flag_rate"), r("$.metadata.sample_level.vulnerable_detection_rate").alias("detection_rate"))


def text_table(rows: DataFrame, most: int = 50) -> list[str]:
    """The first rows as lines of fixed width, for a console."""
    got = [list(rows.columns)] + [["" if v is None else str(v) for v in r] for r in rows.limit(most).collect()]
    width = [max(len(r[k]) for r in got) for k in range(len(got[0]))]
    return ["  ".join(v.ljust(n) for v, n in zip(r, width)).rstrip() for r in got]


# -- call logs


def call_log(calls: DataFrame, most: int = 400_000) -> DataFrame:
    """Recorded requests (id, file, path, answer, thinking, ...) as they are
    appended: a key for each, long texts clipped and marked."""
    given = [F.nullif(F.col(c), F.lit("")) for c in ("id", "file", "path") if c in calls.columns]
    clipped = {f.name: F.when(F.length(f.name) > most, F.concat(F.left(f.name, F.lit(most)), F.lit("\n... [truncated, "), (F.length(f.name) - most).cast("string"), F.lit(" chars]"))).otherwise(F.col(f.name)) for f in calls.schema.fields if f.dataType.simpleString() == "string" and f.name not in ("id", "file", "path")}
    return calls.withColumns({**clipped, "entry": F.coalesce(*given, F.lit("<unknown>")), "recorded_at": F.current_timestamp()})


def log_calls(texts: DataFrame) -> DataFrame:
    """Calls of whole log files (path, value): entry, place, role, hypothesis,
    answer and error.  A file that was left half-written has one row with
    unreadable true, so that a run goes on beside it."""
    files = F.from_json(fields("value", "files")["files"], "map<string,string>")
    ok = F.try_parse_json("value").isNotNull() & files.isNotNull()
    good = texts.where(ok).select("path", F.explode(files).alias("entry", "node")).select("path", "entry", F.posexplode(members(fields("node", "calls")["calls"])).alias("place", "call"))
    c = fields("call", "role", "hypothesis", "answer", "error")
    calls = good.select("path", "entry", "place", c["role"].alias("role"), c["hypothesis"].alias("hypothesis"), c["answer"].alias("answer"), c["error"].alias("error"), F.lit(False).alias("unreadable"))
    bad = texts.where(~F.coalesce(ok, F.lit(False))).select("path", *[F.lit(None).cast(t).alias(n) for n, t in (("entry", "string"), ("place", "int"), ("role", "string"), ("hypothesis", "string"), ("answer", "string"), ("error", "string"))], F.lit(True).alias("unreadable"))
    return calls.unionByName(bad)


def recorded_verdicts(calls: DataFrame) -> DataFrame:
    """The verdict of each hypothesis of an entry: of the verifier's answers the
    last counts, and those that name no hypothesis are left out."""
    asked = calls.where("role = 'verifier' and not unreadable and coalesce(hypothesis, '') <> '' and error is null")
    last = asked.groupBy("entry", "hypothesis").agg(F.max_by("answer", "place").alias("answer"))
    return last.select("entry", "hypothesis", verification_of(F.coalesce("answer", F.lit("{}"))).alias("v"))


def replay(reports: DataFrame, calls: DataFrame, truth: DataFrame) -> DataFrame:
    """Samples that a report, a log and the truth all know, with what was
    recorded of each hypothesis; the others are skipped."""
    known = reports.select("sample_id", source_of("report").alias("file")).join(truth.select("sample_id", "vulnerable"), "sample_id")
    # an entry is kept under the sample's id or under its file
    keys = known.select("*", F.explode(F.array_distinct(F.array("sample_id", "file"))).alias("entry"))
    return keys.join(recorded_verdicts(calls), "entry").select("sample_id", "file", "vulnerable", "hypothesis", "v")
