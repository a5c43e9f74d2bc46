"""Rules of data quality as predicates: every rule gives (artifact, rule, severity, message), one row per violation.

A rule has one of a few shapes: a condition on rows, an id that must be unique, references that must be known,
numbers declared that must be those counted, an order that must hold. A family is a list of rules over one kind of
document; its tables come exploded, so a document of any size is many rows and never one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions import text as fx

#: Severities in order, and those words that a threat model's sections must be named; fixed values.
SEVERITIES = ("critical", "high", "medium", "low", "informational")
SECTIONS = ("assets", "entry points", "threats", "mitigations", "trust boundaries")


def _row(df: DataFrame, rule: str, message: Column, severity: str) -> DataFrame:
    return df.select("artifact", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.coalesce(message.cast("string"), F.lit("")).alias("message"))


def where(items: DataFrame, rule: str, wrong: Column, message: Column, severity: str = "error") -> DataFrame:
    """Rows for which the condition holds; NULL isn't a violation."""
    return _row(items.where(wrong), rule, message, severity)


def unique(items: DataFrame, rule: str, key: str, severity: str = "error") -> DataFrame:
    """Values of key that an artifact holds more than once, once each; NULLs don't count."""
    return _row(items.where(F.col(key).isNotNull()).groupBy("artifact", key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), rule, F.col(key), severity)


def known(refs: DataFrame, rule: str, key: str, items: DataFrame, item_key: str | None = None, severity: str = "error") -> DataFrame:
    """References (artifact, key) that the artifact's items don't hold, once each."""
    there = items.select("artifact", F.col(item_key or key).alias(key)).distinct()
    return _row(refs.where(F.col(key).isNotNull()).select("artifact", key).distinct().join(there, ["artifact", key], "left_anti"), rule, F.col(key), severity)


def counted(declared: DataFrame, items: DataFrame, rule: str, key: Column | None = None, severity: str = "error") -> DataFrame:
    """Numbers declared (artifact, key, n) that differ from those counted over items by key; only artifacts that declare something are held to it."""
    own = items.withColumn("key", F.lit("all") if key is None else key).where("key is not null").groupBy("artifact", "key").agg(F.count(F.lit(1)).alias("m"))
    said = declared.select("artifact").distinct()
    both = declared.select("artifact", "key", "n").join(own.join(said, "artifact", "left_semi"), ["artifact", "key"], "full")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    return _row(both.where(n != m), rule, F.concat_ws(" ", "key", n.cast("string"), m.cast("string")), severity)


def ordered(items: DataFrame, rule: str, by: list[str], value: str, message: str, severity: str = "error") -> DataFrame:
    """Rows whose value is below the last one before it that isn't NULL, in the artifact's order."""
    before = F.last(value, ignorenulls=True).over(W.partitionBy("artifact").orderBy(*by).rowsBetween(W.unboundedPreceding, -1))
    return _row(items.withColumn("__before", before).where(F.col(value) < F.col("__before")), rule, F.col(message), severity)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def code_audit(headers: DataFrame, findings: DataFrame, declared: DataFrame, listed: DataFrame, roadmap: DataFrame) -> DataFrame:
    """headers: artifact, repository, loc_total, loc_parts (array); findings: artifact, id, severity; declared: artifact, key (severity), n; listed, roadmap: artifact, id."""
    levels = headers.select("artifact", F.explode(F.array(*map(F.lit, SEVERITIES))).alias("key"))
    return union([
        unique(findings, "unique_ids", "id"), counted(declared, findings, "summary_counts", F.col("severity")), known(listed, "summary_ids_known", "id", findings), known(findings, "summary_ids_covering", "id", listed),
        known(roadmap, "roadmap_refs", "id", findings), _row(levels.join(declared.select("artifact", "key"), ["artifact", "key"], "left_anti"), "severity_levels_complete", F.col("key"), "error"),
        where(headers, "loc_sum", F.aggregate("loc_parts", F.lit(0).cast("bigint"), lambda a, x: a + x) != F.col("loc_total"), F.col("loc_total")),
        where(headers, "repository_url", ~F.coalesce(F.col("repository").rlike(r"^https?://[^/\s]+/\S*[^./]$") & ~F.col("repository").endswith(".git"), F.lit(False)), F.col("repository"), "warning"),
        where(findings, "canonical_id", ~F.col("id").rlike(r"^FIND-\d{3,}$"), F.col("id")),
    ])


def layer(events: DataFrame, claims: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """events: artifact, id, computed_id, place, recorded, occurred (times), actor_kind, actor, validity, severity, embargo; claims: artifact, id, recorded_claim, claim; reviews: artifact, event (of confirmed ones)."""
    human = F.coalesce(F.col("actor_kind") == "human", F.lit(False))
    return union([
        unique(events, "event_id_unique", "id"), where(events, "event_id_recomputed", F.col("id") != F.col("computed_id"), F.col("id")), ordered(events, "chronological", ["place", "id"], "recorded", "id"),
        where(events, "in_the_future", F.col("recorded") > now + F.expr("interval 24 hours"), F.col("id")), where(events, "occurred_after_recorded", F.col("occurred") > F.col("recorded"), F.col("id"), "warning"),
        where(events, "false_positive_identity", human & (F.col("validity") == "false_positive") & (F.coalesce("actor", F.lit("")) == ""), F.col("id")),
        where(events, "severity_by_humans", F.col("severity").isNotNull() & ~human, F.col("id")), where(events, "embargo_by_humans", F.coalesce("embargo", F.lit(False)) & ~human, F.col("id")),
        where(claims, "claim_hash", F.col("recorded_claim") != F.col("claim"), F.col("id")), known(reviews, "review_has_event", "event", events, "id"),
    ])


def disposition_block(findings: DataFrame, declared: DataFrame, conflicts: DataFrame) -> DataFrame:
    """findings: artifact, id, validity (of the disposition, NULL if it has none), status, conflict; declared: artifact, key (validity), n; conflicts: artifact, id."""
    has = F.col("validity").isNotNull()
    partly = findings.groupBy("artifact").agg(F.count_if(has).alias("with"), F.count(F.lit(1)).alias("all")).where("with > 0 and with < all")
    return union([
        _row(partly, "all_or_none", F.concat_ws(" of ", F.col("with").cast("string"), F.col("all").cast("string")), "error"), where(findings, "status_mirrors_validity", has & ~F.col("status").eqNullSafe(F.col("validity")), F.col("id")),
        counted(declared, findings.where(has), "counts", F.col("validity")), known(conflicts, "conflicts_known", "id", findings.where("conflict")), known(findings.where("conflict"), "conflicts_listed", "id", conflicts),
    ])


def cloud_config(findings: DataFrame, declared: DataFrame) -> DataFrame:
    """findings: artifact, id, severity, override, effective, status, disposition; declared: artifact, key (status), n."""
    return union([
        unique(findings, "unique_ids", "id"), where(findings, "effective_severity", ~F.col("effective").eqNullSafe(F.coalesce("override", "severity")), F.col("id")), counted(declared, findings, "status_counts", F.col("status")),
        _row(findings.where("disposition is not null").groupBy("artifact", "disposition").agg(F.countDistinct("status").alias("n")).where("n > 1"), "shared_disposition", F.col("disposition"), "error"),
    ])


def remediation(headers: DataFrame, addressed: DataFrame, checks: DataFrame, locations: DataFrame, files: DataFrame) -> DataFrame:
    """headers: artifact, n_addressed, checks_passed, checks_total, n_files, status, repository, fork, pr_target, diff; addressed: artifact, id; checks: artifact, passed; locations, files: artifact, path."""
    one = lambda name, df, rule: counted(headers.select("artifact", F.lit("all").alias("key"), F.col(name).alias("n")).where("n is not null"), df, rule)
    failing = F.col("checks_passed") < F.col("checks_total")
    return union([
        one("n_addressed", addressed, "findings_addressed"), one("checks_total", checks, "checks_total"), one("checks_passed", checks.where("passed"), "checks_passed"), one("n_files", files, "diffstat_files"),
        known(locations, "locations_touched", "path", files, severity="warning"), where(headers, "status_against_checks", (F.col("status") == "verified") & failing, F.col("status")),
        where(headers, "fork_is_not_repository", F.col("fork") == F.col("repository"), F.col("fork")), where(headers, "pr_target", F.col("pr_target").isNotNull() & ~F.startswith(F.col("pr_target"), F.col("repository")), F.col("pr_target")), where(headers, "diff_exists", F.col("diff").isNull(), F.col("status")),
    ])


def validation(entries: DataFrame, declared: DataFrame, chains: DataFrame, logs: DataFrame) -> DataFrame:
    """entries: artifact, id, source_id, verdict, log; declared: artifact, key (verdict), n; chains: artifact, id; logs: artifact, log."""
    return union([counted(declared, entries, "verdict_counts", F.col("verdict")), known(chains, "chain_refs", "id", entries), unique(entries, "id_collision", "source_id"), known(entries, "log_exists", "log", logs, severity="warning")])


def triage(entries: DataFrame, declared: DataFrame, by_severity: DataFrame) -> DataFrame:
    """entries: artifact, id, orig_id, verdict, rule, reasons (array), confidence, severity, duplicate_of, votes_for, votes; declared, by_severity: artifact, key, n."""
    is_ = lambda v: F.coalesce(F.col("verdict") == v, F.lit(False))
    target = entries.select("artifact", F.col("id").alias("duplicate_of"), F.col("duplicate_of").alias("__onward"), F.lit(True).alias("__there")).distinct()
    copies = entries.where("duplicate_of is not null").join(target, ["artifact", "duplicate_of"], "left")
    return union([
        unique(entries, "unique_ids", "id"), counted(declared, entries, "summary_counts", F.col("verdict")), counted(by_severity, entries.where("verdict = 'true_positive'"), "by_severity", F.col("severity")),
        where(entries, "rule_13_is_hardening", (F.coalesce(F.col("rule") == 13, F.lit(False)) != is_("hardening")), F.col("id")), where(entries, "false_positive_reasons", is_("false_positive") & (F.coalesce(F.size("reasons"), F.lit(0)) <= 0), F.col("id")),
        where(entries, "undetermined_confidence", is_("undetermined") & F.col("confidence").isNotNull(), F.col("id")), where(entries, "severity_of_true_positives", F.col("severity").isNotNull() & ~is_("true_positive"), F.col("id")),
        where(copies, "duplicate_of_known", F.col("__there").isNull(), F.col("id")), where(copies, "duplicate_of_original", F.col("__onward").isNotNull(), F.col("id")),
        where(entries, "vote_majority", F.col("votes_for") * 2 <= F.col("votes"), F.col("id")), where(entries, "orig_id", F.coalesce(F.trim("orig_id"), F.lit("")) == "", F.col("id"), "warning"),
    ])


def impact(headers: DataFrame, rows: DataFrame, declared: DataFrame) -> DataFrame:
    """headers: artifact, n_repos, n_in_range; rows: artifact, repo, classification, in_range, evidence; declared: artifact, key (classification), n."""
    one = lambda name: headers.select("artifact", F.lit("all").alias("key"), F.col(name).alias("n"))
    return union([
        counted(declared, rows, "classification_counts", F.col("classification")), counted(one("n_repos"), rows, "size"), counted(one("n_in_range"), rows.where("in_range"), "in_range"), unique(rows, "unique_repos", "repo"),
        where(rows, "evidence_of_affected", (F.col("classification") == "affected") & F.col("evidence").isNull(), F.col("repo")), where(rows, "affected_in_range", (F.col("classification") == "affected") & F.col("in_range").eqNullSafe(F.lit(False)), F.col("repo")),
    ])


def vulnerability_findings(entries: DataFrame, declared: DataFrame, baseline: DataFrame) -> DataFrame:
    """entries: artifact, id, severity; declared: artifact, key, n; baseline: artifact, id."""
    return union([unique(entries, "unique_ids", "id"), where(entries, "id_prefix", ~F.col("id").startswith("VULN-"), F.col("id")), counted(declared, entries, "counts", F.col("severity")), known(baseline, "baseline_kept", "id", entries)])


def verification(headers: DataFrame, entries: DataFrame, commits: DataFrame, declared: DataFrame) -> DataFrame:
    """headers: artifact, repository, total; entries: artifact, id, repository, verdict, fixed_by, routed_id, at_commit, base_commit; commits: artifact, place, sha, at; declared: artifact, key (verdict), n."""
    cross = entries.join(headers.select("artifact", F.col("repository").alias("__own")), "artifact")
    return union([
        unique(entries, "unique_ids", "id"), where(cross, "cross_repository", (F.col("repository") != F.col("__own")) & (F.col("verdict") == "fixed"), F.col("id")), counted(headers.select("artifact", F.lit("all").alias("key"), F.col("total").alias("n")), entries, "total"),
        counted(declared, entries, "by_verdict", F.col("verdict")), where(entries, "attribution", (F.col("verdict") == "fixed") & F.col("fixed_by").isNull(), F.col("id")), ordered(commits, "timeline_order", ["place"], "at", "sha"),
        where(commits, "sha_shape", ~F.col("sha").rlike("^[0-9a-f]{7,40}$"), F.col("sha")), known(entries, "fixes_in_timeline", "fixed_by", commits, "sha"), known(commits, "timeline_in_fixes", "sha", entries, "fixed_by", "warning"),
        where(entries, "regression_id", (F.col("verdict") == "regressed") & ~F.col("id").rlike("^REG-"), F.col("id")), unique(entries, "routed_once", "routed_id"), where(entries, "same_commit", F.col("at_commit") == F.col("base_commit"), F.col("id"), "warning"),
    ])


def identity(findings: DataFrame, headers: DataFrame) -> DataFrame:
    """findings: artifact, id, fingerprint, paths (array), cwe; headers: artifact, repository. A fingerprint is that of repository, paths and weakness."""
    own = findings.join(headers.select("artifact", "repository"), "artifact", "left").withColumn("__f", fx.fingerprint(F.col("repository"), F.col("paths"), F.col("cwe")))
    return union([
        where(findings, "fingerprint_present", F.coalesce("fingerprint", F.lit("")) == "", F.col("id")), where(own, "fingerprint_reproduces", (F.col("fingerprint") != "") & (F.col("fingerprint") != F.col("__f")), F.col("id")),
        where(headers, "repository_well_formed", ~F.coalesce(F.col("repository").rlike(r"^https://[^/\s]+/\S+$") & (fx.repaired_repository(F.col("repository")) == F.col("repository")), F.lit(False)), F.col("repository")),
    ])


def strict(findings: DataFrame, texts: DataFrame, headers: DataFrame, sections: tuple[str, ...], vocabulary: tuple[str, ...]) -> DataFrame:
    """findings: artifact, id, severity, score, validity, category; texts: artifact, id, text; headers: artifact, date, written (dates)."""
    from quarryline.functions.kernels import secret_classes

    rank = lambda c: F.array_position(F.array(*map(F.lit, SEVERITIES)), c)
    band = rank(F.when(F.col("score") > 0, fx.cvss_band(F.col("score"))).otherwise("informational"))
    sure = findings.groupBy("artifact").agg(F.bool_and(F.coalesce(F.col("validity") == "confirmed", F.lit(False))).alias("all"), F.count(F.lit(1)).alias("n")).where("all and n >= 5")
    hits = texts.withColumn("__c", F.explode(secret_classes("text")))
    absent = texts.select("artifact", "id", F.explode(F.filter(F.array(*map(F.lit, sections)), lambda x: ~F.contains(F.lower("text"), x))).alias("__s"))
    return union([
        _row(hits, "secrets", F.concat_ws(" ", F.col("id").cast("string"), "__c"), "error"), _row(absent, "sections", F.concat_ws(" ", F.col("id").cast("string"), "__s"), "warning"),
        where(findings, "cvss_band_gap", (F.abs(band - rank(F.col("severity"))) >= 2) & F.col("score").isNotNull() & ~F.isnan("score") & (rank(F.col("severity")) > 0), F.col("id"), "warning"), _row(sure, "all_confirmed", F.col("n"), "warning"),
        where(findings, "vocabulary", ~F.coalesce(fx.category_slug(F.col("category")).isin(*vocabulary), F.lit(False)), F.col("id"), "warning"), where(headers, "date", F.abs(F.datediff("date", "written")) > 1, F.col("date"), "warning"),
    ])


def model_rows(models: DataFrame) -> DataFrame:
    """(artifact, section, line, cells) of every table row and heading in Markdown texts (artifact, text); a heading has no cells.

    Rows of dashes are left out; a pipe after a backslash belongs to its cell. Lines stand in no order but carry their number.
    """
    lines = models.select("artifact", F.posexplode(F.split("text", r"\r?\n")).alias("line", "t"))
    heading = F.lower(F.trim(F.regexp_extract("t", r"^#+\s*(?:\d+[.)]?\s*)?(.*?)\s*#*\s*$", 1)))
    is_heading = F.col("t").rlike(r"^#+\s")
    section = F.last(F.when(is_heading, heading), ignorenulls=True).over(W.partitionBy("artifact").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    cells = F.transform(F.split(F.regexp_replace(F.trim("t"), r"^\||(?<!\\)\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    marked = lines.select("artifact", section.alias("section"), "line", "t", is_heading.alias("h"), cells.alias("c"))
    table_row = F.trim("t").startswith("|") & ~F.col("t").rlike(r"^[\s|:-]+$")
    return marked.where("h or t like '%|%'").select("artifact", "section", "line", F.when(F.col("h"), F.array().cast("array<string>")).when(table_row, F.col("c")).alias("cells")).where("cells is not null")


def threat_model(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rules over model_rows: sections there, ids unique and well-formed, references known, every asset and entry point met by a threat, every threat mitigated."""
    headed = rows.select("artifact", "section").distinct()
    wanted = models.select("artifact", F.explode(F.array(*map(F.lit, SECTIONS))).alias("section"))
    first = F.row_number().over(W.partitionBy("artifact", "section").orderBy("line"))
    body = rows.where(F.size("cells") > 0).withColumn("__r", first).where("__r > 1")  # the first row names the columns
    cell = lambda i: F.nullif(F.get("cells", F.lit(i)), F.lit(""))
    part = lambda name, **cols: body.where(F.col("section") == name).select("artifact", cell(0).alias("id"), *[cell(i).alias(c) for c, i in cols.items()])
    assets, entries = part("assets", sensitivity=2), part("entry points", trust=2)
    threats, cures = part("threats", asset=1, entry=2, severity=3, mitigation=4), part("mitigations", threat=1, status=2)
    return union([
        _row(wanted.join(headed, ["artifact", "section"], "left_anti"), "sections", F.col("section"), "error"), unique(assets, "asset_ids", "id"), unique(threats, "threat_ids", "id"),
        where(threats, "threat_severity", ~F.coalesce(F.lower("severity").isin(*SEVERITIES), F.lit(False)), F.col("id")), known(threats, "threat_asset_known", "asset", assets, "id"), known(threats, "threat_entry_known", "entry", entries, "id"),
        known(assets, "asset_covered", "id", threats, "asset", "warning"), known(entries, "entry_covered", "id", threats, "entry", "warning"), known(cures, "mitigation_threat_known", "threat", threats, "id"),
        known(threats, "threat_mitigated", "id", cures, "threat", "warning"), where(cures, "mitigation_status", ~F.coalesce(F.lower("status").isin("done", "planned", "accepted"), F.lit(False)), F.col("id")),
    ])
