"""The flow from hypotheses to decisions, over recorded verdicts."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdictlake import vocab
from verdictlake.functions import columns as C
from verdictlake.operators.streams import fold_groups


def echo_antijoin(hypotheses: DataFrame, findings: DataFrame) -> DataFrame:
    """Hypotheses that no tool has said: no finding of the file has the line and
    the same first class."""
    said = findings.select("file", "line", F.upper(F.try_element_at("cwe", F.lit(1))).alias("first")).distinct()
    return hypotheses.withColumn("first", F.upper(F.try_element_at("cwe", F.lit(1)))).join(said, ["file", "line", "first"], "left_anti").drop("first")


def near_or_all(evidence: DataFrame, asked: DataFrame, radius: int = 12) -> DataFrame:
    """For each question (id, file, line) the evidence of its file at most
    `radius` lines away, or all of it where none is.  Evidence without a line is
    always near, and so is all of it to a question without one."""
    pairs = asked.select("id", "file", F.col("line").alias("at")).join(evidence, "file").withColumn("near", F.coalesce(F.abs(F.col("line") - F.col("at")) <= radius, F.lit(True)))
    any_near = pairs.groupBy("id").agg(F.max("near").alias("any_near"))
    return pairs.join(any_near, "id").where("near or not any_near")


def nearest_chain(chains: DataFrame, asked: DataFrame) -> DataFrame:
    """The proven chain whose sink is nearest to each question's line."""
    pairs = asked.select("id", "file", F.col("line").alias("at")).join(chains, "file")
    return pairs.groupBy("id").agg(F.min_by("ord", F.struct(F.abs(F.col("sink_line") - F.col("at")), "ord")).alias("chain"))


def claim_groups(hypotheses: DataFrame, scope: str = "file") -> DataFrame:
    """Number of each hypothesis's claim: one for each class of a scope, in the
    order in which they come; without a class each is its own."""
    name = F.upper(F.trim(F.coalesce("class", F.lit(""))))
    key = F.when(name == "", F.concat(F.lit("\0"), F.col("ord").cast("string"))).otherwise(name)
    keyed = hypotheses.withColumn("claim_key", key)
    first = keyed.groupBy(scope, "claim_key").agg(F.min("ord").alias("first_ord"))
    numbered = first.withColumn("claim", F.row_number().over(Window.partitionBy(scope).orderBy("first_ord")))
    return keyed.join(numbered, [scope, "claim_key"]).drop("claim_key", "first_ord")


def claim_sites(claims: DataFrame, radius: int = 5) -> DataFrame:
    """Site of each hypothesis of a claim (file, claim): in order it joins the
    first site whose first line is at most `radius` away, or that has none; one
    without a line joins the first site."""


    def step(sites: dict, row: tuple) -> list[tuple]:
        """sites: the first site near each line; under None the first one that
        has no line, and so is near all; n: how many there are."""
        file, claim, o, line = row
        n = sites.get("n", 0)
        found = [s for s in (sites.get(line), sites.get(None)) if s is not None]
        if line is None:
            at = 0 if n else None
        else:
            at = min(found, default=None)
        if at is None:
            at, sites["n"] = n, n + 1
            for near in [None] if line is None else range(line - radius, line + radius + 1):
                sites.setdefault(near, at)
        return [(file, claim, o, at)]

    return fold_groups(claims.select("file", "claim", "ord", "line"), ["file", "claim"], ["ord"], dict, step, "file string, claim int, ord long, site long")


def until_first_confirmed(sites: DataFrame, scope: list[str]) -> DataFrame:
    """Rows of each scope up to its first confirmed one, which an aggregate
    with partial sums finds."""
    first = sites.where("status = 'CONFIRMED'").groupBy(*scope).agg(F.min("ord").alias("__first"))
    return sites.join(first, scope, "left").where("__first is null or ord <= __first").drop("__first")


def top_n(df: DataFrame, scope: list[str], n: int) -> DataFrame:
    """The first n rows of each scope, and whether it had more."""
    w = Window.partitionBy(*scope)
    return df.withColumns({"place": F.row_number().over(w.orderBy("ord")), "truncated": F.count("*").over(w) > n}).where(F.col("place") <= n)


def taint_modelled(cwe: Column) -> Column:
    return F.upper(cwe).isin(*vocab.SINK_CLASS.values(), *vocab.MODELLED_ALIASES)


def resolve_hedge(decision: Column, usable: Column, verified: Column, confidence: Column, least: float = 0.5) -> Column:
    """An uncertain but usable verdict: confirmed where the chain is verified
    with enough confidence, else rejected."""
    return F.when((decision == "UNCERTAIN") & usable, F.when(verified & (confidence >= least), "CONFIRMED").otherwise("REJECTED")).otherwise(decision)


def evidence_gate(verified: Column, missing: Column, modelled: Column, n_proven: Column, engine_silent: Column, mitigated: Column, confidence: Column, least: float = 0.5, reject_mitigated: bool = False, reject_ungrounded: bool = True, require_chain: bool = True) -> Column:
    """Why a confirmation does not stand: the first reason that holds, or ''.
    The tests of missing evidence, of the engine's path and of mitigated paths
    can be switched."""
    out = F.when(~verified, "chain_unverified")
    if reject_ungrounded:
        out = out.when(F.size(missing) > 0, "missing_evidence")
    if require_chain:
        out = out.when((n_proven == 0) & ~engine_silent & modelled, "no_path")
    if reject_mitigated:
        out = out.when(mitigated, "mitigated")
    return out.when(confidence < least, "low_confidence").otherwise("")


def resolved_class(verified: Column, proposed: Column, verifier_owns: bool = True) -> Column:
    """The classes that a report states, in capitals: the verifier's, else the
    proposed one.  Where the scanner owns the class, the proposed one stays
    unless the verifier's are of other families."""
    named = F.transform(F.filter(F.coalesce(verified, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != ""), lambda c: F.upper(F.trim(c)))
    own = F.upper(F.trim(F.coalesce(proposed, F.lit(""))))
    alone = F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>"))
    if verifier_owns:
        return F.when(F.size(named) > 0, named).otherwise(alone)
    other = (F.size(named) > 0) & ~F.arrays_overlap(C.families_of(named), C.families_of(alone))
    return F.when((own == "") | other, named).otherwise(alone)


def fallback_reason(n_hypotheses: Column, scanner_failed: Column, n_proposed: Column, n_findings: Column) -> Column:
    """Why tool findings stand in for hypotheses, or '': only where no
    hypothesis is left, first because the scanner failed, then because all that
    it proposed were echoes, then because it declined what tools have flagged."""
    return (
        F.when(n_hypotheses > 0, "").when(scanner_failed, "scanner_failed").when(n_proposed > 0, "all_hypotheses_dropped_as_echoes")
        .when(n_findings > 0, "scanner_declined_but_tools_flagged_the_file").otherwise("")
    )


def fallback_hypotheses(findings: DataFrame) -> DataFrame:
    """Tool findings (file, ord, cwe, line, message, rule_id) as hypotheses T1,
    T2, ... of their file, in the order of ord, equal ones by what they say."""
    w = Window.partitionBy("file").orderBy("ord", "line", "rule_id", "message", "cwe")
    claim = F.coalesce(F.nullif(F.col("message"), F.lit("")), F.lit("reported by a static tool"))
    return findings.select("file", "ord", F.upper(F.trim(F.coalesce(F.try_element_at("cwe", F.lit(1)), F.lit("")))).alias("cwe"), "line", claim.alias("claim"), F.coalesce("rule_id", F.lit("")).alias("suspected_sink"), F.concat(F.lit("T"), F.row_number().over(w)).alias("id"))


def contradiction(decision: Column, missing: Column) -> Column:
    """What a confirmation lists as missing; other verdicts may list it."""
    return F.when(decision == "CONFIRMED", F.coalesce(missing, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def divergence_note(note: Column, proposed: Column, verified: Column, verifier_owns: bool = True) -> Column:
    """The note, with a suffix where the verifier's classes share no family with
    the proposed one."""
    named = F.transform(F.filter(verified, lambda c: F.coalesce(c, F.lit("")) != ""), lambda c: F.upper(F.trim(c)))
    apart = (F.coalesce(proposed, F.lit("")) != "") & (F.size(named) > 0) & ~F.arrays_overlap(C.families_of(named), C.families_of(F.array(proposed)))
    owner = "reporting the verified class" if verifier_owns else "reporting the proposed class"
    suffix = F.concat(F.lit(" [scanner proposed "), proposed, F.lit(", verifier read "), F.array_join(named, ", "), F.lit(f"; {owner}]"))
    return F.when(apart, F.trim(F.concat(F.coalesce(note, F.lit("")), suffix))).otherwise(note)


def latest_nonerror(records: DataFrame, key: str = "sample_id") -> DataFrame:
    """The newest record of each key; an error never stands for a success.  An
    aggregate with partial sums, so a hot key costs a row per task."""
    order = F.struct((F.col("decision") != "ERROR").cast("int"), "lineno")
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def last_answer(calls: DataFrame, keys: list[str]) -> DataFrame:
    """The last answer without an error for each hypothesis."""
    return calls.where("error is null").groupBy(*keys).agg(F.max_by("answer", "call_index").alias("answer"))


#: Kinds of failures by the name of the error, each with its own
#: budget of tries; other errors, and replies that were cut off, are not tried again.
FAILURE_KINDS = {"TimeoutError": "timeout", "ValueError": "parse", "JSONDecodeError": "parse", "UnicodeDecodeError": "parse", "RuntimeError": "transport"}


def failure_kind_of_call(error: Column) -> Column:
    """timeout, parse, transport or none, of an error 'Name: message'."""
    name = F.regexp_extract(F.coalesce(error, F.lit("")), r"^([A-Za-z_.]*?)([A-Za-z_]+)(?::|$)", 2)
    out = F.lit("none")
    for known, kind in FAILURE_KINDS.items():
        out = F.when(name == known, F.lit(kind)).otherwise(out)
    return out


def may_retry(kind: Column, failures: Column, budgets: dict[str, int]) -> Column:
    """Whether a call is tried again after so many failures of a kind."""
    out = F.lit(False)
    for name, most in budgets.items():
        out = F.when(kind == name, failures < most).otherwise(out)
    return out


def backoff_delay(failures: Column, luck: Column) -> Column:
    """Seconds to wait after so many failures: doubling from 2, at most 20,
    times a number between a half and 1 that luck, in [0, 1), chooses."""
    return F.least(F.lit(20.0), F.pow(F.lit(2.0), failures)) * (luck / 2 + 0.5)


def merge_confirmed(decisions: DataFrame, radius: int = 5) -> DataFrame:
    """Confirmed decisions of one file that name the same place: those whose
    families meet or whose lines are at most `radius` apart, and so on.  The
    survivor is the most confident, the earliest of those; it has all classes,
    and its line only where all are within the radius of it."""
    cols = decisions.where("status = 'CONFIRMED' and size(cwe) > 0").withColumn("families", C.families_of("cwe"))

    def finish(rows: list[tuple]) -> list[tuple]:
        """Linked through what they share: rows of one family through the
        family, lines through their neighbours in order."""
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        def link(a, b) -> None:
            parent[root(a)] = root(b)

        for k, row in enumerate(rows):
            for f in row[5]:
                link(k, f)
        placed = sorted((row[2], k) for k, row in enumerate(rows) if row[2] is not None)
        for (a, i), (b, j) in itertools.pairwise(placed):
            if b - a <= radius:
                link(i, j)
        groups: dict = {}
        for k, row in enumerate(rows):
            groups.setdefault(root(k), []).append(row)
        out = []
        for members in groups.values():
            best = max(members, key=lambda r: (r[4], -(r[2] or 0)))  # the first of equals
            file, o, line, _, confidence, _ = best
            lines = [r[2] for r in members if r[2] is not None]
            if len(members) > 1 and line is not None and max(abs(x - line) for x in lines) > radius:
                line = None
            spelled: dict[str, str] = {}  # each class once, in its first spelling
            for r in [best, *(r for r in members if r is not best)]:
                for c in r[3]:
                    spelled.setdefault(c.upper(), c)
            out.append((file, o, line, list(spelled.values()), confidence, len(members)))
        return out

    def step(rows: list[tuple], row: tuple) -> list[tuple]:
        rows.append(row)
        return []

    return fold_groups(cols.select("file", "ord", "line", "cwe", "confidence", "families"), ["file"], ["ord"], list, step, "file string, ord long, line long, cwe array<string>, confidence double, merged long", finish)
