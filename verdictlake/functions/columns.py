"""Column functions: classes, paths, scores, rates.  All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from verdictlake import vocab


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- weakness classes


def canonical_cwe(digits) -> Column:
    """'CWE-' and the number without leading zeros; no digit left is 0."""
    return F.concat(F.lit("CWE-"), F.coalesce(F.nullif(F.ltrim(_c(digits), F.lit("0")), F.lit("")), F.lit("0")))


def cwe_from_path(path) -> Column:
    """Classes named in a path, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_c(path), F.lit(r"(?i)CWE[_-]?(\d+)"), F.lit(1)), canonical_cwe))


def cwe_from_field(field) -> Column:
    """Classes of a packed string: CWE-7, cwe_7 or bare digits, separated by
    commas, slashes, bars, semicolons or spaces."""
    parts = F.filter(F.split(F.coalesce(_c(field), F.lit("")), r"[,/|;\s]+"), lambda x: x.rlike(r"(?i)^(CWE[-_]?)?\d+$"))
    return F.array_distinct(F.transform(parts, lambda x: canonical_cwe(F.regexp_extract(x, r"(\d+)$", 1))))


def cwe_from_cell(cell, prefixed: bool = False) -> Column:
    """Classes of a scanner's cell: separators '!/', ',', ';' and '/', a final
    '!' and leading zeros dropped; ascending by text.  prefixed: only those
    with 'CWE-'; else white space separates too, and bare numbers count."""
    parts = F.transform(F.split(F.coalesce(_c(cell), F.lit("")), r"!/|[,;/]" if prefixed else r"!/|[,;/\s]+"), lambda x: F.regexp_replace(F.trim(x), r"!+$", ""))
    kept = F.filter(parts, lambda x: x.rlike(r"(?i)^CWE-\d+$" if prefixed else r"(?i)^(CWE-)?\d+$"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: canonical_cwe(F.regexp_extract(x, r"(\d+)$", 1)))))


def family_map() -> Column:
    pairs = [x for k, v in vocab.families().items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.create_map(*pairs)


def families_of(cwes) -> Column:
    """Families of all classes of an array; an unknown class is its own."""
    known = family_map()
    return F.array_distinct(F.flatten(F.transform(_c(cwes), lambda c: F.coalesce(F.try_element_at(known, F.upper(c)), F.array(F.upper(c))))))


def primary_label(cwes, default: str = "unlabelled") -> Column:
    return F.coalesce(F.try_element_at(_c(cwes), F.lit(1)), F.lit(default))


# -- paths


def norm_path(path) -> Column:
    return F.rtrim(F.replace(_c(path), F.lit("\\"), F.lit("/")), F.lit("/"))


def path_parts(path) -> Column:
    """Components; an absolute path's first is '/'."""
    n = norm_path(path)
    parts = F.filter(F.split(n, "/"), lambda x: (x != "") & (x != "."))
    return F.when(n.startswith("/"), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)


def base_name(path) -> Column:
    return F.try_element_at(path_parts(path), F.lit(-1))


def parts_suffix(a: Column, b: Column) -> Column:
    """Whether the shorter list of components ends the longer."""
    n = F.least(F.size(a), F.size(b))
    return (n > 0) & (F.slice(a, -n, n) == F.slice(b, -n, n))


def same_file(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.coalesce((a != "") & (b != "") & ((norm_path(a) == norm_path(b)) | parts_suffix(path_parts(a), path_parts(b))), F.lit(False))


def has_marker(text, words) -> Column:
    """Whether one of the words stands between non-letters."""
    return F.arrays_overlap(F.split(F.lower(_c(text)), "[^a-z]+"), F.array(*map(F.lit, words)))


def parse_location(text) -> Column:
    """The positive line after the last colon of 'file:line', or null."""
    n = F.substring_index(_c(text), ":", -1).try_cast("int")
    return F.when(_c(text).contains(":") & (n > 0), n)


def neutral_name(text) -> Column:
    return F.concat(F.lit("sym_"), F.left(F.sha1(_c(text).cast("binary")), F.lit(6)))


#: Suffixes of source files.
SOURCE_SUFFIXES = (
    ".c", ".h", ".cc", ".cp", ".cpp", ".cxx", ".hh", ".hpp", ".hxx",
    ".py", ".pyw", ".java", ".go", ".rs", ".js", ".jsx", ".ts", ".tsx",
    ".rb", ".php", ".cs", ".kt", ".swift", ".m", ".mm",
)
SOURCE_EXTENSIONS = "|".join(s[1:] for s in SOURCE_SUFFIXES)
#: Fixed patterns: names that tell a sample's label.
LEAK_NAME = r"\b(?:CWE\d+_[A-Za-z0-9_]+|[Bb]ad[A-Za-z0-9_]*|[Gg]ood[A-Za-z0-9_]*|[Oo]mit[_]?[Bb]ad\b|[Oo]mit[_]?[Gg]ood\b)\b"
LEAK_WITHIN = r"CWE[-_]?\d{1,6}|[Bb]ad|[Gg]ood|[Oo]mit[_]?[Bb]ad|[Oo]mit[_]?[Gg]ood"
#: Fixed patterns: folders that tell the class, and the variant, in any case.
CLASS_FOLDER = r"^CWE[-_]?\d{1,6}$"
VARIANT_FOLDER = r"^(?:vuln|vulnerable|patched|fixed|safe|benign|secure|clean|omitted)$"


def sanitize_path(path) -> Column:
    """A path whose label-bearing components have neutral names; the extension
    and a final ':line' stay."""
    p = _c(path)
    line = F.regexp_extract(p, r"(:\d{1,9})$", 1)
    head = F.when((line != "") & (p.rlike(r"[/\\].*:\d{1,9}$") | p.rlike(rf"(?i)\.({SOURCE_EXTENSIONS}):\d{{1,9}}$")), F.lit(True)).otherwise(F.lit(False))
    body = F.replace(F.when(head, F.substring(p, F.lit(1), F.length(p) - F.length(line))).otherwise(p), F.lit("\\"), F.lit("/"))
    suffix = F.when(head, line).otherwise(F.lit(""))
    drive = F.regexp_extract(body, r"^([A-Za-z]:)", 1)
    parts = F.split(F.substring(body, F.length(drive) + 1, F.length(body)), "/")

    def one(x: Column, i: Column) -> Column:
        stem = F.regexp_extract(x, rf"(?i)^(.*)\.(?:{SOURCE_EXTENSIONS})$", 1)
        dotted = F.regexp_extract(x, rf"(?i)(\.(?:{SOURCE_EXTENSIONS}))$", 1)
        last = i == F.size(parts) - 1
        return (
            F.when(x == "", x)
            .when(x.rlike("(?i)" + CLASS_FOLDER) | x.rlike("(?i)" + VARIANT_FOLDER), neutral_name(x))
            .when(x.rlike(f"^{LEAK_NAME}$"), neutral_name(x))
            .when(last & (dotted != "") & stem.rlike(LEAK_WITHIN), F.concat(neutral_name(stem), dotted))
            .otherwise(x)
        )

    return F.concat(drive, F.array_join(F.transform(parts, one), "/"), suffix)


def sanitize_identifiers(text) -> Column:
    """Every leaking identifier replaced by a name made of its own hash.

    The text is cut at the identifiers: the pieces between them and the names,
    in turn, make the result, so that no pass over the text sees another's
    output."""
    t = _c(text)
    names = F.regexp_extract_all(t, F.lit(f"({LEAK_NAME})"), F.lit(1))
    pieces = F.split(t, LEAK_NAME)
    whole = F.zip_with(pieces, F.transform(names, neutral_name), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.array_join(whole, "")


# -- values


def clamp_confidence(value) -> Column:
    """A number within 0 and 1; what is no finite number is 0."""
    x = _c(value).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def label_cast(value) -> Column:
    return F.coalesce(F.lower(F.trim(_c(value).cast("string"))).isin("1", "true"), F.lit(False))


def severity_rank(severity) -> Column:
    out = F.lit(0)
    for rank, name in enumerate(vocab.SEVERITIES):
        out = F.when(F.upper(_c(severity)) == name, F.lit(rank)).otherwise(out)
    return out


def severity_of_level(level) -> Column:
    """A scanner's risk level: 5 and above, 4, 2 and 3, 1, other."""
    n = _c(level)
    return F.when(n >= 5, "CRITICAL").when(n == 4, "HIGH").when(n >= 2, "MEDIUM").when(n == 1, "LOW").otherwise("UNKNOWN")


def confidence_of_word(word) -> Column:
    w = F.upper(_c(word))
    return F.when(w == "LOW", F.lit(0.33)).when(w == "MEDIUM", F.lit(0.66)).when(w == "HIGH", F.lit(1.0))


def verdict(status) -> Column:
    s = F.upper(F.coalesce(_c(status), F.lit("")))
    return F.when(s.isin(*vocab.STATUSES), s).otherwise("UNCERTAIN")


def fingerprint(tool, rule, file, line, message) -> Column:
    n = F.when((_c(line).isNull()) | (_c(line) == 0), "").otherwise(_c(line).cast("string"))
    return F.sha2(F.concat_ws("|", _c(tool), _c(rule), F.coalesce(_c(file), F.lit("")), n, F.trim(_c(message))).cast("binary"), 256)


def packed(text) -> Column:
    """Bytes that stand for a text: half as many and one where it is lower-case
    hex digits in pairs, else its own and one.  unpacked gives it back."""
    t, digits = _c(text), F.unhex(_c(text))
    return F.when(F.lower(F.hex(digits)) == t, F.concat(F.lit(b"\x00"), digits)).otherwise(F.concat(F.lit(b"\x01"), t.cast("binary")))


def unpacked(code) -> Column:
    rest = F.substring(_c(code), F.lit(2), F.length(_c(code)))
    return F.when(F.substring(_c(code), 1, 1) == F.lit(b"\x00"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def language_of(path) -> Column:
    ext = F.lower(F.regexp_extract(_c(path), r"(\.[A-Za-z]+)$", 1))
    return F.when(ext.isin(".py", ".pyw"), "python").when(ext.isin(".c", ".h"), "c").when(ext.isin(".cc", ".cp", ".cpp", ".cxx", ".hh", ".hpp", ".hxx"), "cpp")


def safe_div(a, b) -> Column:
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def wilson(successes, trials, z: float = vocab.Z95) -> Column:
    """struct(low, high) of a proportion's Wilson interval, to six places; exact
    at 0 and 1; no trials leave (0, 1)."""
    x, n = _c(successes).cast("double"), _c(trials).cast("double")
    p, zz = x / n, z * z
    centre = (p + zz / (n * 2)) / (zz / n + 1)
    half = (F.sqrt(p * (1 - p) / n + zz / (n * n * 4)) * z) / (zz / n + 1)
    low = F.when(n == 0, 0.0).when(x == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(n == 0, 1.0).when(x == n, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return F.struct(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def six_digits(value) -> Column:
    """A double with six significant digits."""
    return F.format_string("%.5e", _c(value)).cast("double")


def mcnemar_exact(b, c) -> Column:
    """Two-sided exact p of b against c discordant pairs: twice the binomial
    tail, at most 1; no pairs give 1.  Log factorials keep it finite."""
    low, n = F.least(_c(b), _c(c)).cast("int"), (_c(b) + _c(c)).cast("int")
    steps = F.when(low > 0, F.sequence(F.lit(1), low)).otherwise(F.array().cast("array<int>"))
    log_term = lambda acc, k: F.struct((acc.t + F.log((n - k + 1).cast("double")) - F.log(k.cast("double"))).alias("t"), (acc.s + F.exp(acc.t + F.log((n - k + 1).cast("double")) - F.log(k.cast("double")))).alias("s"))
    first = -n.cast("double") * F.log(F.lit(2.0))
    tail = F.aggregate(steps, F.struct(first.alias("t"), F.exp(first).alias("s")), log_term, lambda acc: acc.s)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail * 2))


def match_score(file_ok, pred_cwe, gt_cwe, pred_line, gt_line, tolerance: int = 5, require_cwe: bool = True) -> Column:
    """0.4 for the file, 0.25 for a shared family, up to 0.35 for the line, or
    0.1 where a line is missing; 0 where the pair cannot match."""
    p, g = _c(pred_cwe), _c(gt_cwe)
    labelled = F.size(g) > 0
    bad = ~_c(file_ok) | (labelled & (F.size(p) == 0))
    if require_cwe:
        bad = bad | (labelled & ~F.arrays_overlap(families_of(p), families_of(g)))
    gap = F.abs(_c(pred_line) - _c(gt_line))
    line = F.when(gap.isNull(), F.lit(0.1)).otherwise((1 - gap / float(max(tolerance, 1))) * 0.35)
    total = F.when(labelled & F.lit(require_cwe), F.lit(0.65)).otherwise(F.lit(0.4)) + line
    return F.when(F.coalesce(bad, F.lit(True)) | F.coalesce(gap > tolerance, F.lit(False)), F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


# -- expressions of code

#: Words that are no names.
KEYWORDS = ("if", "else", "elif", "while", "for", "return", "and", "or", "not", "def", "class", "with", "as", "try", "except", "int", "str", "bool", "True", "False", "None", "self")


def call_head(expression) -> Column:
    """The dotted or '::' name at the start, leading casts removed."""
    bare = F.regexp_replace(F.trim(_c(expression)), r"^(\(\s*[A-Za-z_][\w\s:<>]*[*&\s]*\)\s*)+(?=[A-Za-z_])", "")
    return F.regexp_extract(bare, r"^([A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)*)", 1)


def names_in(expression) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(_c(expression), F.lit(r"([A-Za-z_]\w*)"), F.lit(1))), F.array(*map(F.lit, KEYWORDS)))


def context_span(text, line, radius: int = 8, most: int = 400, bounds=None, plain: bool = False) -> Column:
    """start_line, end_line and truncated of the window around a line; without
    one the first 2r+1.  Bounds (start_line, end_line of the function around
    it) widen the window; one of more than `most` lines is then cut around the
    line, and truncated says so.  plain: plain lines, and a line below 1 is a
    line."""
    n, at = F.size(lines_of(text, plain)), _c(line)
    first, last, cut = F.greatest(F.lit(1), at - radius), F.least(n, at + radius), F.lit(False)
    if bounds is not None:
        start, end = _c(bounds).getField("start_line"), _c(bounds).getField("end_line")
        unit = F.coalesce(start < end, F.lit(False))
        first = F.when(unit, F.greatest(F.lit(1), F.least(first, start))).otherwise(first)
        last = F.when(unit, F.least(n, F.greatest(last, end))).otherwise(last)
        keep = F.when(at - first < most, F.greatest(F.lit(1), most - (at - first))).otherwise(most // 2)
        cut = unit & (last - first + 1 > most)
        first = F.when(cut, F.greatest(first, at - keep)).otherwise(first)
        last = F.when(cut, F.least(last, first + most - 1)).otherwise(last)
    none = at.isNull() if plain else at.isNull() | (at < 1)
    return F.struct(F.when(none, F.lit(1)).otherwise(first).cast("int").alias("start_line"), F.when(none, F.least(n, F.lit(2 * radius + 1))).otherwise(last).cast("int").alias("end_line"), F.coalesce(~none & cut, F.lit(False)).alias("truncated"))


def context_window(text, line, radius: int = 8, most: int = 400, bounds=None, plain: bool = False) -> Column:
    """The lines of context_span, numbered where a line was asked for."""
    span = context_span(text, line, radius, most, bounds, plain)
    first, last = span.getField("start_line"), span.getField("end_line")
    part = F.when(last < first, F.array().cast("array<string>")).otherwise(F.slice(lines_of(text, plain), first, F.greatest(last - first + 1, F.lit(0))))
    numbered = F.transform(part, lambda x, i: F.concat(F.lpad((i + first).cast("string"), 6, " "), F.lit(": "), x))
    none = _c(line).isNull() if plain else _c(line).isNull() | (_c(line) < 1)
    return F.array_join(F.when(none, part).otherwise(numbered), "\n")


def lines_of(text, plain: bool = False) -> Column:
    """Lines of a text, however they end; the last end adds none.  plain: only
    "\\n" ends a line, and an empty text is one empty line."""
    t = _c(text) if plain else F.replace(F.replace(_c(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    whole = F.when(F.endswith(t, F.lit("\n")), F.left(t, F.length(t) - 1)).otherwise(t)
    return F.split(whole, "\n") if plain else F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\n"))


def is_code_line(text) -> Column:
    return ~F.trim(_c(text)).rlike(r"^($|#|//|/\*|\*)")


def parse_json_object(text) -> Column:
    """A JSON object as a variant, taken from the first brace to the last where
    the text around it is no JSON."""
    return F.coalesce(F.try_parse_json(_c(text)), F.try_parse_json(F.regexp_extract(_c(text), r"(?s)(\{.*\})", 1)))


def clip(text, most: int = 400_000, mark: str = "...[clipped]") -> Column:
    return F.when(F.length(_c(text)) > most, F.concat(F.left(_c(text), F.lit(most)), F.lit(mark))).otherwise(_c(text))
