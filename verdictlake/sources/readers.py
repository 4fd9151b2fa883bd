"""Sources: manifests, tables, JSON lines, source trees, tool reports.

Every reader gives columns of fixed types; bad rows become rows of their own
where the source is read leniently, and an error where it is read strictly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdictlake.functions import columns as C
from verdictlake.operators import corpus

SAMPLE = "sample_id string, file string, vulnerable boolean, cwe array<string>, line int, function string, description string, group_id string, variant string, scenario string, language string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a manifest, a list or {"samples": [...]}; sample_id and file
    are required, and a missing one stops the read."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.coalesce(F.from_json("value", f"struct<samples:array<struct<{_fields(SAMPLE)}>>>")["samples"], F.from_json("value", f"array<struct<{_fields(SAMPLE)}>>")).alias("s"))
    rows = parsed.select(F.posexplode("s").alias("ord", "s")).select("ord", "s.*")
    for name in ("sample_id", "file"):
        rows = rows.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.concat(F.lit("sample "), F.col("ord").cast("string"), F.lit(f" has no {name}")))))
    return rows.withColumn("cwe", F.coalesce("cwe", F.array()))


def _fields(ddl: str) -> str:
    return ", ".join(":".join(x.strip().split(" ", 1)) for x in ddl.split(", "))


def resolve_file(file, root: str):
    """Absolute paths as they are, others under the root."""
    f = F.col(file) if isinstance(file, str) else file
    return F.when(f.startswith("/"), f).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), f))


def json_lines_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A bad line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_lenient(spark: SparkSession, path: str, schema: str, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): lines that are no JSON or have no key are bad."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    ok = F.col("r").isNotNull() & F.col(f"r.{key}").isNotNull()
    return parsed.where(ok).select("r.*"), parsed.where(~ok).select("value")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A list, or a list under data or samples; members that are no objects are
    dropped."""
    text = spark.read.text(path, wholetext=True)
    item = f"array<struct<{_fields(schema)}>>"
    wrapped = F.from_json("value", f"struct<data:{item}, samples:{item}>")
    rows = F.coalesce(wrapped["data"], wrapped["samples"], F.from_json("value", item))
    return text.select(F.explode(rows).alias("r")).where("r is not null").select("r.*")


def tabular(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV with a header, JSON lines or a JSON list, by suffix."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    if path.endswith((".jsonl", ".ndjson")):
        return spark.read.option("mode", "FAILFAST").json(path)
    return spark.read.json(path, multiLine=True)


def source_tree(spark: SparkSession, path: str, glob: str = "*.{c,h,cc,cpp,cxx,hh,hpp,hxx,py,pyw}") -> DataFrame:
    """Files of a tree as text, with language and path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), C.language_of("path").alias("language"), F.decode("content", "utf-8").alias("text"))


def sard(files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(labelled samples, unclassified files) of a source tree."""
    rel = F.when(F.startswith("path", F.lit(root)), F.substring("path", len(root.rstrip("/")) + 2, 4096)).otherwise(F.col("path"))
    rows = files.withColumn("file", rel).withColumn("vulnerable", corpus.sard_label(F.col("file"))).withColumn("cwe", C.cwe_from_path("file")).withColumn("sample_id", F.regexp_replace("file", r"[^A-Za-z0-9_.-]+", "_"))
    return rows.where("vulnerable is not null"), rows.where("vulnerable is null")


def sard_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Labels from the nearest metadata row: files (path, stem) by metadata
    (folder, name, label) whose folder holds the file and whose name has the
    stem; the deepest folder wins."""
    folders = F.expr("transform(sequence(1, size(split(path, '/')) - 1), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    near = files.withColumn("folder", F.explode(folders)).join(metadata, "folder").where("instr(name, stem) > 0")
    return near.groupBy("path").agg(F.max_by("label", F.length("folder")).alias("vulnerable"))


def functions_corpus(df: DataFrame, source: str, target: str, cwe: str | None = None, name: str = "corpus", wanted: list[str] | None = None) -> DataFrame:
    """A table of functions with labels as samples: the first of equal sources
    stays, before the class filter, which spares benign rows."""
    rows = df.select(F.monotonically_increasing_id().alias("ord"), F.col(source).alias("text"), C.label_cast(target).alias("vulnerable"), (C.cwe_from_field(cwe) if cwe else F.array().cast("array<string>")).alias("cwe"))
    rows = corpus.skip_empty(rows)
    first = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("key")).agg(F.min_by(F.struct("ord", "text", "vulnerable", "cwe"), "ord").alias("r")).select("r.*", "key")
    out = first.withColumn("sample_id", F.concat(F.lit(f"{name}_"), F.substring("key", 1, 16))).drop("key")
    return corpus.cwe_filter(out, wanted) if wanted else out


def fixed_twins(df: DataFrame) -> DataFrame:
    """Before and after of a fix: a vulnerable row gives a vulnerable and, where
    the fix differs and is there, a benign sample; a benign row gives one."""
    pair = F.array(F.struct(F.lit("before").alias("variant"), F.col("func_before").alias("text"), F.col("vul").alias("vulnerable")), F.struct(F.lit("after").alias("variant"), F.col("func_after").alias("text"), F.lit(False).alias("vulnerable")))
    base = df.withColumn("vul", C.label_cast("vul"))
    rows = base.select("ord", "cwe", "vul", F.inline(pair))
    return rows.where((F.col("variant") == "before") | F.col("vul")).where(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).drop("vul")


def dedup_twins(twins: DataFrame) -> DataFrame:
    """The first sample of each text, by row and then before to after, whole
    rows out where their before is a repeat.

    In two passes: rows whose before stands in an earlier row are dropped, then
    repeats among what is left.  Read in order, a row that is dropped would not
    have lent its after to later rows; here it still does in the first pass.
    """
    key = F.sha2(F.col("text").cast("binary"), 256)
    place = F.struct("ord", F.col("variant") != "before")
    keyed = twins.withColumn("key", key)
    first = keyed.groupBy("key").agg(F.min("ord").alias("first_ord"))
    repeats = keyed.where("variant = 'before'").join(first, "key").where("first_ord < ord").select("ord")
    kept = keyed.join(repeats, "ord", "left_anti")
    least = kept.groupBy("key").agg(F.min(place).alias("least"))
    return kept.join(least, "key").where(place == F.col("least")).drop("key", "least")


def language_corpus(df: DataFrame, languages: list[str] | None = None, wanted: list[str] | None = None, name: str = "corpus") -> DataFrame:
    """A table of functions in several languages (ord, idx, code, CWE_ID,
    RELATED_CWE, target, language, function_name) as samples.

    The language is tested before anything else; the class filter holds for all
    rows; equal sources stay once; ids that collide get _2, _3 and so on.
    """
    rows = df if languages is None else df.where(F.lower("language").isin(*[x.lower() for x in languages]))
    rows = corpus.skip_empty(rows.withColumnRenamed("code", "text"))
    columns = ["ord", "idx", "text", "CWE_ID", "RELATED_CWE", "target", "language", "function_name"]
    rows = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("key")).agg(F.min_by(F.struct(*columns), "ord").alias("r")).select("r.*")
    related = F.array_sort(F.array_distinct(C.cwe_from_field("RELATED_CWE")))
    slug = F.left(F.regexp_replace(F.concat(F.lit(f"{name}_"), F.col("idx").cast("string")), r"[^A-Za-z0-9_.-]+", "_"), F.lit(80))
    out = rows.select("ord", slug.alias("sample_id"), "text", C.label_cast("target").alias("vulnerable"), C.cwe_from_field("CWE_ID").alias("cwe"), related.alias("related_cwe"), F.lower("language").alias("language"), F.col("function_name").alias("function"))
    if wanted:
        out = corpus.cwe_filter(out, wanted, vulnerable_only=False)
    return corpus.unique_ids(out, "sample_id").withColumn("sample_id", F.col("unique_id")).drop("unique_id")


def juliet_pairs(df: DataFrame) -> DataFrame:
    """One row (filename, bad, good) as up to two samples."""
    pair = F.array(F.struct(F.lit("bad").alias("variant"), F.col("bad").alias("text")), F.struct(F.lit("good").alias("variant"), F.col("good").alias("text")))
    return df.select("filename", F.inline(pair)).where(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).withColumns({"vulnerable": F.col("variant") == "bad", "cwe": C.cwe_from_path("filename"), "group_id": F.regexp_replace(F.regexp_replace("filename", r"\.[^.]*$", ""), r"_\d+[a-z]?$", "")})


def bandit(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a bandit report."""
    item = "filename string, line_number int, test_id string, issue_text string, issue_severity string, issue_confidence string, issue_cwe struct<id:int>"
    r = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<results:array<struct<{_fields(item)}>>>")["results"]).alias("r"))
    return r.select(F.lit("bandit").alias("tool"), F.col("r.test_id").alias("rule_id"), F.col("r.issue_text").alias("message"), F.col("r.filename").alias("file"), F.col("r.line_number").alias("line"), F.col("r.issue_severity").alias("severity"), F.when(F.col("r.issue_cwe.id") > 0, F.array(F.concat(F.lit("CWE-"), F.col("r.issue_cwe.id").cast("string")))).otherwise(F.array().cast("array<string>")).alias("cwe"), C.confidence_of_word("r.issue_confidence").alias("confidence"))


#: Ids of a checker that speak of its own run.
CPPCHECK_NOISE = ("missingInclude", "missingIncludeSystem", "checkersReport", "unmatchedSuppression", "preprocessorErrorDirective", "syntaxError", "unknownMacro", "badMacro", "unhandledException")


def cppcheck(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a cppcheck XML report, style and noise left out."""
    schema = "_id string, _severity string, _msg string, _cwe string, location array<struct<_file:string, _line:int, _column:int>>"
    r = spark.read.format("xml").option("rowTag", "error").schema(schema).load(path)
    kept = r.where(~F.coalesce(F.lower("_severity"), F.lit("")).isin(*_style()) & ~F.coalesce("_id", F.lit("")).isin(*CPPCHECK_NOISE))
    at = F.try_element_at("location", F.lit(1))
    return kept.select(F.lit("cppcheck").alias("tool"), F.col("_id").alias("rule_id"), F.col("_msg").alias("message"), at["_file"].alias("file"), at["_line"].alias("line"), F.when(F.lower("_severity") == "error", "HIGH").when(F.lower("_severity") == "warning", "MEDIUM").otherwise("LOW").alias("severity"), C.cwe_from_cell("_cwe").alias("cwe"))


def _style() -> tuple[str, ...]:
    from verdictlake import vocab

    return vocab.STYLE_SEVERITIES


def flawfinder(spark: SparkSession, path: str, noise: tuple[str, ...] = ()) -> DataFrame:
    """Findings of a flawfinder CSV report."""
    r = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    kept = r.where(~F.coalesce("Name", F.lit("")).isin(*noise)) if noise else r
    return kept.select(F.lit("flawfinder").alias("tool"), F.col("Name").alias("rule_id"), F.col("Warning").alias("message"), F.col("File").alias("file"), F.col("Line").try_cast("int").alias("line"), C.severity_of_level(F.col("Level").try_cast("int")).alias("severity"), C.cwe_from_cell("CWEs", prefixed=True).alias("cwe"))


def result(spark: SparkSession, path: str) -> DataFrame:
    """Stored results with their confusion cells, of either shape; one without
    cells stops the read."""
    cells = "struct<tp:bigint, fp:bigint, fn:bigint, tn:bigint>"
    r = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<experiment:string, name:string, metrics:struct<confusion:{cells}, source_to_sink_path_without_mitigation:{cells}>>").alias("r"))
    c = F.coalesce("r.metrics.confusion", "r.metrics.source_to_sink_path_without_mitigation")
    return r.select(F.coalesce(F.nullif("r.experiment", F.lit("")), "r.name").alias("experiment"), F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit("a result has no confusion cells"))).alias("c")).select("experiment", "c.*")


def catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(classes, cases) of a catalog document."""
    cwe = "array<struct<cwe_id:string, name:string, languages:array<string>, summary:string, cves:array<string>>>"
    cve = "array<struct<cve_id:string, project:string, language:string, cwe:string, title:string, reference:string, in_scope:boolean>>"
    r = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<cwes:{cwe}, cves:{cve}>").alias("r"))
    return r.select(F.inline("r.cwes")), r.select(F.inline("r.cves"))


def restore(manifest_rows: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with text, rows without) of a manifest and a table (filename, bad,
    good), joined on the base name without its variant."""
    stem = F.regexp_replace(C.base_name("file"), r"_(bad|good)(\.[A-Za-z]+)$", "$2")
    m = manifest_rows.withColumn("filename", stem).withColumn("want", F.regexp_extract(C.base_name("file"), r"_(bad|good)\.", 1))
    got = m.join(table, "filename").withColumn("text", F.when(F.col("want") == "bad", F.col("bad")).otherwise(F.col("good"))).drop("bad", "good")
    return got, m.join(table, "filename", "left_anti")


def write_csv(rows: list[DataFrame], path: str) -> None:
    """Rows of different columns as one CSV whose header is the union."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    out.write.mode("overwrite").csv(path, header=True)


def write_manifest(df: DataFrame, path: str) -> None:
    """Samples as JSON lines in the input's order, a file per partition."""
    df.repartitionByRange("ord").sortWithinPartitions("ord").drop("ord").write.mode("overwrite").json(path)


def write_ranked(df: DataFrame, path: str, by: str = "result") -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)



# -- manifests and corpora


def dataset_root(spark: SparkSession, path: str) -> str:
    """The folder that a manifest's relative files are under: dataset.root where
    it is there, else the manifest's own."""
    named = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.dataset.root").alias("r")).first()["r"]
    if named:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return named.rstrip("/")
    return path.rsplit("/", 1)[0] if "/" in path else "."


def sample(rows: DataFrame, sample_id: str) -> DataFrame:
    """The sample of an id; of several the last."""
    return rows.where(F.col("sample_id") == sample_id).orderBy(F.desc("ord")).limit(1)


def languages(rows: DataFrame) -> DataFrame:
    return rows.where("language <> ''").select("language").distinct().orderBy("language")


def manifest_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: samples, vulnerable ones, languages; zeros and none for what
    cannot be read."""
    item = "array<struct<vulnerable:boolean, language:string>>"
    rows = F.coalesce(F.from_json("value", f"struct<samples:{item}>")["samples"], F.from_json("value", item))
    texts = spark.read.text(path, wholetext=True).select(F.explode(rows).alias("s")).select("s.*")
    return texts.agg(F.count("*").alias("samples"), F.count_if(F.coalesce("vulnerable", F.lit(False))).alias("vulnerable"), F.sort_array(F.collect_set(F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown")))).alias("languages"))


def devign(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Functions with a target and no class."""
    return functions_corpus(df, "func", "target", None, "devign", wanted)


def big_vul(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Functions before their fix, with class and label."""
    return functions_corpus(df, "func_before", "vul", "CWE ID", "bigvul", wanted)


def reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(reports, unreadable texts) of a folder, whatever its depth: documents in
    .json, lines in .jsonl."""
    from verdictlake.operators import reports as R

    read = lambda glob, whole: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), "value")
    a, b = R.scan(read("*.json", True)), R.scan(read("*.jsonl", False), lines=True)
    return a[0].unionByName(b[0]), a[1].unionByName(b[1])


def write_samples(rows: DataFrame, folder: str) -> DataFrame:
    """Write each selected sample (sample_id, variant, text, language) to a file
    of its own; sample_id and file, relative to the folder.

    The name is the id and a hash of what is stored, so a task that is run
    again writes the same file.  Sources stay columns wherever a table will do."""
    import pandas as pd

    suffix = {"python": ".py", "cpp": ".cpp"}

    def run(batches):
        import hashlib

        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        for pdf in batches:
            names = []
            fs.create_dir(base)
            for ident, variant, text, language in zip(pdf["sample_id"], pdf["variant"], pdf["text"], pdf["language"]):
                stem = "".join(c if c.isalnum() and c.isascii() or c in "._-" else "_" for c in ident)[:80]
                digest = hashlib.sha256(f"{ident}:{variant}:{text}".encode()).hexdigest()[:16]
                names.append(f"{stem}_{variant}_{digest}{suffix.get(language, '.c')}")
                with fs.open_output_stream(f"{base}/{names[-1]}") as f:
                    f.write((text or "").encode())
            yield pd.DataFrame({"sample_id": pdf["sample_id"], "file": names})

    return rows.select("sample_id", "variant", "text", "language").mapInPandas(run, "sample_id string, file string")


def append_calls(calls: DataFrame, folder: str) -> None:
    """Append a log of calls; a write that failed leaves no readable part."""
    from verdictlake.operators import reports as R

    R.call_log(calls).write.mode("append").parquet(folder)


def write_results(documents: DataFrame, path: str) -> None:
    """Result documents (column value), one JSON object a line."""
    documents.select("value").write.mode("overwrite").text(path)


def settings(text: str, types: dict[str, type], environment: dict[str, str] | None = None) -> dict[str, object]:
    """Options from lines NAME=value, over which an environment wins, by the
    types asked for; a value that is not of its type is left out.  Quotes,
    comments, blank lines and a leading export are put up with."""
    found = dict(environment or {})
    for line in text.splitlines():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and not name.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            found.setdefault(name.strip(), value[1:-1] if quoted else value.split(" #")[0].strip())
    out: dict[str, object] = {}
    for name, kind in types.items():
        raw = found.get(name, "").strip()
        if not raw:
            continue
        try:
            out[name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        except ValueError:
            pass
    return out
