"""Scalar functions on text as columns of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by file extension; fixed values.
LANGUAGES = {
    "go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp",
    "rs": "rust", "sh": "bash", "yaml": "yaml", "yml": "yaml", "php": "php", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp",
}
#: Extensions of configuration, which names a finding's language only where no source does; fixed values.
CONFIG = ("yaml", "yml")
#: Directories below which other projects' code lies; fixed values.
VENDOR_ROOTS = ("vendor", "_vendor", "vendored", "third_party", "thirdparty", "third-party", "external", "externals", "node_modules", "bundled", "Godeps/_workspace/src")
#: SARIF level and score by severity; words of advisories, of reachability and of scanners' hints -> severity; fixed values.
SARIF_LEVELS = {"critical": ("error", "9.5"), "high": ("error", "8.0"), "medium": ("warning", "5.0"), "low": ("note", "2.0"), "informational": ("note", "0.5")}
ADVISORY_WORDS = {"CRITICAL": "critical", "HIGH": "high", "HIGHEST": "high", "MEDIUM": "medium", "MODERATE": "medium", "LOW": "low"}
REACHABILITY = {"symbol_reachable": "high", "package_imported_not_observed": "medium", "module_required_not_observed": "low"}
HINTS = {"critical": "critical", "high": "high", "medium": "medium", "low": "low", "informational": "informational"}


def mapped(key: Column, table: dict, default: str | None) -> Column:
    """table's value for key, or the default; a NULL key takes the default."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(default))


def repo_url(text: Column) -> Column:
    """First http URL without trailing dots, slashes and .git; NULL if there is none."""
    url = F.nullif(F.regexp_extract(text, r"(https?://[^\s<>\"')]+)", 1), F.lit(""))
    return F.regexp_replace(F.regexp_replace(url, r"[./]+$", ""), r"\.git$", "")


def join_url(text: Column) -> Column:
    """URL as a join key: lower case, no scheme, no .git, scp form folded."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"^(?:[a-z+]+://)?(?:[^@/]+@)?", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^([^/:]+):(?!\d)", "$1/"), r"(?:\.git)?/*$", "")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


#: Names that a version branch may start with, unless a caller gives its own.
BRANCH_PREFIXES = ("release", "stable")


def branch_of(base: Column, prefixes: tuple[str, ...] = BRANCH_PREFIXES) -> Column:
    """Version branch that a slug ends with after two underscores (a prefix, two or three numbers), NULL if none."""
    branch = F.substring_index(base, "__", -1)
    name, numbers = F.substring_index(branch, "-", 1), F.split(F.substring_index(branch, "-", -1), r"\.")
    whole = F.contains(base, F.lit("__")) & name.isin(*prefixes) & (F.concat_ws("-", name, F.substring_index(branch, "-", -1)) == branch)
    return F.when(whole & F.size(numbers).between(2, 3) & F.forall(numbers, lambda n: n.rlike("^[0-9]+$")), branch)


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def vendor_tail(path: Column) -> Column:
    """Path below its last vendor directory, without leading ``./``."""
    return F.regexp_replace(plain_path(path), rf"^.*(?:^|/)(?:{'|'.join(VENDOR_ROOTS)})/", "")


def plain_path(path: Column) -> Column:
    return F.regexp_replace(F.trim(path), r"^(?:\./)+", "")


def relative_ref(path: Column, root: str) -> Column:
    """The path below a folder, without ``.`` parts and doubled slashes; NULL if it lies outside it or climbs with ``..``. No link is followed."""
    plain = F.regexp_replace(F.regexp_replace(path, r"/(?:\./)+", "/"), "/+", "/")
    inside = plain.startswith(root.rstrip("/") + "/") & ~plain.rlike(r"(^|/)\.\.(/|$)")
    return F.when(inside, F.substring(plain, len(root.rstrip("/")) + 2, 10_000))


def component_paths(paths: Column, file: Column | None = None) -> Column:
    """Sorted distinct paths below vendor directories; if there are none, that of the one file."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(paths, vendor_tail), lambda p: p != "")))
    clean = F.coalesce(clean, F.array().cast("array<string>"))
    return clean if file is None else F.when((F.size(clean) == 0) & (file != ""), F.array(vendor_tail(file))).otherwise(clean)


def repaired_repository(text: Column) -> Column:
    """A repository without the marks of an automatic link, with a scheme where it begins with a host name; else as it is."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"^<(.*)>$", "$1"))
    hosted = bare.rlike(r"^[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+/[^\s/]+/[^\s]+$") & ~F.contains(bare, F.lit("://"))
    return F.when(hosted, F.concat(F.lit("https://"), bare)).when(bare == "", text).otherwise(bare)


def category_slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s_]+", "-")


def bare_rule_id(text: Column) -> Column:
    return F.substring_index(text, ".", -1)


def url_of_repo_id(repo_id: Column) -> Column:
    """https URL of ``repo:host/path``; NULL for other ids."""
    return F.when(repo_id.startswith("repo:"), F.concat(F.lit("https://"), F.substring(repo_id, 6, 10_000)))


def slug_of_repo_id(repo_id: Column, host: str = "github.com") -> Column:
    path = F.regexp_replace(F.regexp_replace(repo_id, "^repo:", ""), f"^{host.replace('.', '[.]')}/", "")
    return F.regexp_replace(F.regexp_replace(path, "[^a-zA-Z0-9_-]", "-"), "^-+|-+$", "")


def slug_of_url(url: Column) -> Column:
    """Last part of a URL without .git; ``unknown`` if there is no URL."""
    return F.when(F.coalesce(url, F.lit("")) == "", "unknown").otherwise(F.regexp_replace(F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1), r"\.git$", ""))


def line_range(lines: Column) -> Column:
    """struct<start, end> of ``12`` or ``12-40``; NULL if it's neither, end NULL if there's one line."""
    part = lambda i: F.regexp_extract(lines, r"^\s*(\d+)\s*(?:[-\u2013]\s*(\d+))?\s*$", i).try_cast("int")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("start"), part(2).alias("end")))


def written_range(start: Column, end: Column) -> Column:
    return F.when(F.coalesce(start, F.lit(0)) == 0, "").when(end.isNotNull() & (end != 0) & (end != start), F.concat_ws("-", start.cast("string"), end.cast("string"))).otherwise(start.cast("string"))


def safe_slug(text: Column, segments: int = 1) -> Column:
    """The text if it's that many parts of letters, digits, dots, dashes and underscores, none led by a dot or dash or with two dots in a row; else NULL."""
    part = "[A-Za-z0-9_][A-Za-z0-9._-]*"
    return F.when(text.rlike(f"^{'/'.join([part] * segments)}$") & ~F.contains(text, F.lit("..")), text)


def script_json(json: Column) -> Column:
    """JSON text that can stand in a page's script: no closing tag and no comment begins in it."""
    return F.replace(F.replace(json, F.lit("</"), F.lit("<\\/")), F.lit("<!--"), F.lit("<\\u0021--"))


def lowest_cwe(cwes: Column) -> Column:
    """The lowest weakness number in an array of names; NULL if there's none."""
    return F.array_min(F.transform(cwes, lambda c: F.regexp_extract(c, r"(?i)CWE-(\d+)", 1).try_cast("int")))


def month_key(date: Column) -> Column:
    return F.substring(date, 1, 7)


def run_rate(amount: Column, day: Column) -> Column:
    """What a month comes to if the days up to ``day`` are typical of it."""
    return amount / F.dayofmonth(day) * F.dayofmonth(F.last_day(day))


def age_hours(at: Column, now: Column) -> Column:
    return (F.unix_seconds(now) - F.unix_seconds(at)) / 3600.0


def iso_date(text: Column) -> Column:
    """The date that a text begins with; NULL if it doesn't begin with one."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))


def at_least(installed: Column, expected: Column) -> Column:
    """Whether a version of numbers is the other one or later; false if either isn't made of numbers."""
    numbers = lambda v: F.transform(F.split(v, r"\."), lambda x: F.trim(x).try_cast("bigint"))
    fine = lambda v: F.coalesce(F.forall(numbers(v), lambda x: x.isNotNull()), F.lit(False))
    return F.when(fine(installed) & fine(expected), numbers(installed) >= numbers(expected)).otherwise(False)


def component_signature(paths: Column, cwe: Column, category: Column, sink: Column | str = "") -> Column:
    """SHA-256 of sorted paths, weakness, category and sink: the same flaw in a shared component, whichever repository holds it."""
    sink = F.lit(sink) if isinstance(sink, str) else sink
    return F.sha2(F.concat_ws("|", F.array_join(F.array_sort(paths), ";"), F.upper(F.trim(cwe)), F.lower(F.trim(category)), sink), 256)


def event_id(source_ref: Column, finding: Column, validity: Column, resolution: Column) -> Column:
    """SHA-256 of what makes an event: its source, finding and disposition; NULL parts are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (source_ref, finding, validity, resolution)]), 256)


def claim_hash(*parts: Column) -> Column:
    """SHA-256 of a finding's claim (title, severity, weakness, paths), which must not change once it's recorded."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("")) for c in parts]), 256)


def cwe_number(cwe: Column) -> Column:
    return F.regexp_extract(cwe, r"(\d+)", 1).try_cast("int")


def excerpt(text: Column, size: int = 120) -> Column:
    """White space collapsed, cut to size characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size - 1), F.lit("…"))).otherwise(flat)


def md_cell(text: Column) -> Column:
    """One cell of a Markdown table: no forged column or row, no live link or image."""
    flat = F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")
    return F.regexp_replace(F.replace(flat, F.lit("]("), F.lit("]\\(")), r"(?i)\bjavascript:", "javascript\u02d0")


def csv_cell(text: Column) -> Column:
    """Guard against formulas: a leading =, +, -, @, tab or return gets an apostrophe, unless the cell is a number."""
    return F.when(text.rlike(r"^[=+\-@\t\r]") & ~text.rlike(r"^[+-]?\d+(\.\d+)?$"), F.concat(F.lit("'"), text)).otherwise(text)


def html_text(text: Column) -> Column:
    out = text
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def fence(text: Column) -> Column:
    """A code fence longer than any run of backticks in the text, three at least."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def no_controls(text: Column) -> Column:
    """Without control and direction characters, tabs and line ends kept."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F‪-‮⁦-⁩]", "")


def version_key(version: Column) -> Column:
    """Leading numbers of a version as an array that compares in order; NULL if it starts with none."""
    numbers = F.nullif(F.regexp_extract(version, r"^[vV=~^]*\s*(\d+(?:\.\d+)*)", 1), F.lit(""))
    return F.transform(F.split(numbers, r"\."), lambda x: x.try_cast("bigint"))


def in_range(version: Column, lower: Column, upper: Column) -> Column:
    """lower <= version < upper with three values: NULL bounds don't bind, NULL without any bound or version."""
    v = version_key(version)
    low, high = F.coalesce(v >= version_key(lower), F.lit(True)), F.coalesce(v < version_key(upper), F.lit(True))
    return F.when(v.isNull() | (lower.isNull() & upper.isNull()), F.lit(None).cast("boolean")).otherwise(low & high)


def cvss_band(score: Column) -> Column:
    return F.when(score.isNull() | F.isnan(score), "none").when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score > 0, "low").otherwise("none")


def fingerprint(repo: Column, paths: Column, cwe: Column) -> Column:
    """SHA-256 of repository, sorted paths and weakness."""
    return F.sha2(F.concat_ws("|", repo, F.array_join(F.array_sort(paths), ";"), cwe), 256)
