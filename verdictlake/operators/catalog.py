"""The catalogue of weakness classes and published cases.

classes: cwe_id, name, family, languages, summary, cves (arrays); cases:
cve_id, project, language, cwe, title, reference, in_scope,
out_of_scope_reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_NONE = "cast(array() as array<string>)"


def normalized(cwe) -> Column:
    """A class as the catalogue names it: in capitals, numbers with the prefix."""
    x = F.upper(F.trim(F.col(cwe) if isinstance(cwe, str) else cwe))
    return F.when(x.rlike(r"^\d+$"), F.concat(F.lit("CWE-"), x)).otherwise(x)


def ids(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).orderBy(column)


def class_of(classes: DataFrame, cwe: str) -> DataFrame:
    return classes.where(F.col("cwe_id") == normalized(F.lit(cwe)))


def case_of(cases: DataFrame, cve: str) -> DataFrame:
    return cases.where(F.upper("cve_id") == cve.upper())


def in_scope(cases: DataFrame, language: str = "") -> DataFrame:
    """Cases in scope, of a language or of none in particular."""
    out = cases.where(F.coalesce("in_scope", F.lit(True)))
    return out.where(F.coalesce("language", F.lit("")).isin("", language)) if language else out


def classes_for_language(classes: DataFrame, language: str) -> DataFrame:
    """A class that names no language is for all."""
    named = F.coalesce("languages", F.expr(_NONE))
    return classes.where((F.size(named) == 0) | F.array_contains(named, language))


def listed(classes: DataFrame) -> DataFrame:
    """(cwe_id, place, cve_id) of the cases that classes list."""
    return classes.select("cwe_id", F.posexplode("cves").alias("place", "cve_id"))


def entries(classes: DataFrame, cases: DataFrame) -> DataFrame:
    """Classes with the cases in scope that they list, in their order."""
    found = listed(classes).join(in_scope(cases), "cve_id")
    related = found.groupBy("cwe_id").agg(F.sort_array(F.collect_list(F.struct("place", "cve_id", "reference"))).alias("r"))
    return classes.join(related, "cwe_id", "left").withColumn("r", F.coalesce("r", F.expr("cast(array() as array<struct<place:int,cve_id:string,reference:string>>)")))


def with_cases(classes: DataFrame, cases: DataFrame) -> DataFrame:
    """cwe_id, name, related_cves and references of every class: the page of the
    class first, then the cases' own, each once."""
    page = F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), F.element_at(F.split("cwe_id", "-"), -1), F.lit(".html"))
    links = F.array_distinct(F.filter(F.transform("r", lambda x: x["reference"]), lambda x: F.coalesce(x, F.lit("")) != ""))
    whole = F.when(F.array_contains(links, page), links).otherwise(F.concat(F.array(page), links))
    return entries(classes, cases).select("cwe_id", F.col("name").alias("cwe_name"), F.transform("r", lambda x: x["cve_id"]).alias("related_cves"), whole.alias("references"))


def report_fields(named: DataFrame, known: DataFrame) -> DataFrame:
    """cwe with cwe_name, related_cves and references, by with_cases' table; a
    class that the catalogue does not know has empty ones."""
    joined = named.join(known, normalized("cwe") == F.col("cwe_id"), "left")
    return joined.select("cwe", F.coalesce("cwe_name", F.lit("")).alias("cwe_name"), F.coalesce("related_cves", F.expr(_NONE)).alias("related_cves"), F.coalesce("references", F.expr(_NONE)).alias("references"))


def suggested(findings: DataFrame, classes: DataFrame, cases: DataFrame, language: str = "") -> DataFrame:
    """Findings (ord, cwe array) with the cases in scope that realise any of
    their classes, by class and then by the class's list, each once."""
    each = findings.select("ord", F.posexplode("cwe").alias("c_place", "cwe")).withColumn("cwe_id", normalized("cwe"))
    found = each.join(listed(classes), "cwe_id").join(in_scope(cases, language).select("cve_id"), "cve_id")
    first = found.groupBy("ord", "cve_id").agg(F.min(F.struct("c_place", "place")).alias("at"))
    return first.groupBy("ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "cve_id"))), lambda x: x["cve_id"]).alias("cves"))


def counts(classes: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases in scope of each class, 0 included."""
    return entries(classes, cases).select("cwe_id", F.size("r").alias("cases"))


def problems(classes: DataFrame, cases: DataFrame) -> DataFrame:
    """(subject, problem) of what would let a wrong case reach a report."""
    pairs = listed(classes)
    joined = pairs.join(cases, "cve_id", "left")
    say = lambda df, subject, *text: df.select(F.col(subject).alias("subject"), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("problem"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    out = ~F.coalesce("in_scope", F.lit(True))
    parts = [
        say(pairs.join(cases, "cve_id", "left_anti"), "cwe_id", "unknown case ", F.col("cve_id")),
        say(joined.where("cwe <> cwe_id"), "cve_id", "refers to ", F.col("cwe"), " but is listed under ", F.col("cwe_id")),
        say(joined.where(out), "cve_id", "out of scope but listed under ", F.col("cwe_id")),
        say(cases.where(empty("reference")), "cve_id", "no reference"),
        say(cases.where(empty("cwe")), "cve_id", "no class"),
        say(cases.where(out & empty("out_of_scope_reason")), "cve_id", "out of scope without a reason"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole
