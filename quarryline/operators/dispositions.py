"""What a ledger of events says about findings: derived dispositions, precedents and what they match, soundness of refutations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as fx

#: Values of dispositions, verdicts that set a precedent, and sources of machine verdicts; fixed values.
RESOLUTIONS = ("open", "fix_in_progress", "resolved", "partially_resolved", "risk_accepted", "regression_introduced")
VALIDITIES = ("confirmed", "corrected", "false_positive", "not_verified", "hardening")
PRECEDENTS = ("false_positive", "hardening")
MACHINE_SOURCES = ("triage_report", "validation_report", "verification_report")
HUMAN, MACHINE = "human_countersigned", "machine_refuted_sound"


def human_verdict() -> Column:
    """An event in which a named human says false positive or hardening."""
    return F.coalesce(F.col("validity").isin(*PRECEDENTS) & (F.col("actor_kind") == "human") & (F.coalesce("actor_identity", F.lit("")) != ""), F.lit(False))


def machine_verdict() -> Column:
    return F.coalesce(F.col("validity").isin(*PRECEDENTS) & (F.col("actor_kind") == "machine") & F.col("source_type").isin(*MACHINE_SOURCES), F.lit(False))


def derived(events: DataFrame, key: list[str]) -> DataFrame:
    """key with validity, resolution, conflict, n_events: within a class of evidence the latest wins, and human evidence before machine evidence.

    Events without a verdict don't hide an earlier one. conflict: the latest human and the latest machine verdict differ.
    One aggregate, so no key's events are gathered; events of equal time go by their id.
    """
    human = F.coalesce(F.col("actor_kind") == "human", F.lit(False))
    when = F.struct("recorded_at", "event_id")
    last = lambda value, among: F.max_by(value, F.when(value.isNotNull() & among, when))
    v, r = F.col("validity"), F.col("resolution")
    out = events.groupBy(*key).agg(last(v, human).alias("__hv"), last(v, ~human).alias("__mv"), last(r, human).alias("__hr"), last(r, ~human).alias("__mr"), F.count(F.lit(1)).alias("n_events"))
    return out.select(*key, F.coalesce("__hv", "__mv").alias("validity"), F.coalesce("__hr", "__mr").alias("resolution"), F.coalesce(F.col("__hv") != F.col("__mv"), F.lit(False)).alias("conflict"), "n_events")


def summary(dispositions: DataFrame) -> DataFrame:
    """(measure, value, n): findings by resolution (``open`` unless said) and validity (``not_verified`` unless said), with zeros, and conflicts."""
    spark = dispositions.sparkSession
    count = lambda c, name, default: dispositions.groupBy(F.coalesce(c, F.lit(default)).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("measure", F.lit(name))
    counted = count("resolution", "resolution", "open").unionByName(count("validity", "validity", "not_verified"))
    dim = spark.createDataFrame([("resolution", v) for v in RESOLUTIONS] + [("validity", v) for v in VALIDITIES], "measure string, value string")
    zero = dim.join(counted, ["measure", "value"], "left").select("measure", "value", F.coalesce("n", F.lit(0)).alias("n"))
    return zero.unionByName(dispositions.agg(F.count_if("conflict").alias("n")).select(F.lit("conflicts").alias("measure"), F.lit("all").alias("value"), "n"))


def replay(findings: DataFrame, events: DataFrame, final_ids: DataFrame, known_aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dispositions, unplaced) of events led along confirmed aliases (old_id, final_id) to findings (repo_key, finding_id).

    unplaced: (repo_key, finding_id, state, n) of events whose id isn't a finding's: `parked` if an alias that isn't
    confirmed (known_aliases: repo_key, old_id) may still lead it on, else `unknown`.
    """
    led = events.join(final_ids.withColumnRenamed("old_id", "finding_id"), ["repo_key", "finding_id"], "left").withColumn("finding_id", F.coalesce("final_id", "finding_id")).drop("final_id")
    placed = led.join(findings.select("repo_key", "finding_id"), ["repo_key", "finding_id"], "left_semi")
    lost = led.join(findings.select("repo_key", "finding_id"), ["repo_key", "finding_id"], "left_anti").groupBy("repo_key", "finding_id").agg(F.count(F.lit(1)).alias("n"))
    parked = known_aliases.select("repo_key", F.col("old_id").alias("finding_id")).distinct().withColumn("__p", F.lit(True))
    states = lost.join(parked, ["repo_key", "finding_id"], "left").select("repo_key", "finding_id", F.when(F.col("__p"), "parked").otherwise("unknown").alias("state"), "n")
    found = derived(placed, ["repo_key", "finding_id"])
    every = findings.join(found, ["repo_key", "finding_id"], "left").select("repo_key", "finding_id", "validity", "resolution", F.coalesce("conflict", F.lit(False)).alias("conflict"), F.coalesce("n_events", F.lit(0)).alias("n_events"))
    return every, states


def precedents(findings: DataFrame, events: DataFrame, unsound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cache, population) of verdicts that later findings may lean on.

    findings: repo_key, finding_id, fingerprint, paths, cwe, category. Of each finding the latest human verdict counts,
    else the latest machine verdict that isn't unsound (event_id, repo_key). Left out, and counted: machine verdicts on
    findings that some event confirms (`excluded_contested`), verdicts that aren't the derived validity any more
    (`excluded_stale`), unsound ones (`excluded_unsound`). cache has one row per precedent with its signature.
    """
    key = ["repo_key", "finding_id"]
    marked = events.join(unsound.select("event_id", "repo_key").distinct().withColumn("__u", F.lit(True)), ["event_id", "repo_key"], "left")
    good = machine_verdict() & F.col("__u").isNull()
    when = F.struct("recorded_at", "event_id", "validity", "actor_identity")
    chosen = marked.where("finding_id is not null").groupBy(*key).agg(
        F.max(F.when(human_verdict(), when)).alias("h"), F.max(F.when(good, when)).alias("m"), F.bool_or(F.coalesce(F.col("validity") == "confirmed", F.lit(False))).alias("contested"),
        F.count_if(machine_verdict() & F.col("__u").isNotNull()).alias("n_unsound"),
    )
    joined = findings.join(chosen, key).join(derived(events, key).select(*key, F.col("validity").alias("now")), key)
    is_human = F.col("h").isNotNull()
    pick = F.coalesce("h", "m")
    state = (
        F.when(pick.isNull(), "none").when(is_human & ~F.col("now").eqNullSafe(pick["validity"]), "excluded_stale").when(is_human, HUMAN)
        .when(F.col("contested"), "excluded_contested").when(F.coalesce(F.col("now").isin("confirmed", "corrected"), F.lit(False)), "excluded_stale").otherwise(MACHINE)
    )
    judged = joined.withColumns({"state": state, "verdict": pick["validity"], "event_id": pick["event_id"], "by": pick["actor_identity"], "signature": fx.component_signature(F.coalesce("paths", F.array().cast("array<string>")), F.coalesce("cwe", F.lit("")), F.coalesce("category", F.lit("")))})
    cache = judged.where(F.col("state").isin(HUMAN, MACHINE)).select("signature", "fingerprint", *key, "paths", "cwe", "category", "verdict", F.col("state").alias("strength"), "event_id", "by")
    counted = judged.where("state <> 'none'").groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return cache, counted.unionByName(judged.agg(F.coalesce(F.sum("n_unsound"), F.lit(0)).alias("n")).select(F.lit("excluded_unsound").alias("state"), "n"))


def matches(cache: DataFrame, findings: DataFrame) -> DataFrame:
    """(repo_key, finding_id, signature, matched_by, max_strength): findings whose fingerprint is cached; else those of
    the same signature; and those that share a path with a component and its weakness or its category. A shared path alone never matches.
    """
    key = ["repo_key", "finding_id"]
    strength = cache.groupBy("signature").agg(F.min("strength").alias("max_strength"))  # human comes first
    component = cache.select("signature", F.upper("cwe").alias("c_cwe"), F.col("category").alias("c_category"), "paths").distinct()
    by_print = findings.select(*key, "fingerprint").join(cache.select("fingerprint", "signature").distinct(), "fingerprint").select(*key, "signature", F.lit("fingerprint").alias("matched_by"))
    rest = findings.join(by_print.select(*key).distinct(), key, "left_anti").where(F.size("paths") > 0)
    own = rest.withColumn("own", fx.component_signature(F.col("paths"), F.coalesce("cwe", F.lit("")), F.coalesce("category", F.lit(""))))
    by_signature = own.join(cache.select(F.col("signature").alias("own")).distinct(), "own").select(*key, F.col("own").alias("signature"), F.lit("signature").alias("matched_by"))
    parts = component.select("signature", "c_cwe", "c_category", F.explode("paths").alias("path"))
    agree = F.coalesce(F.upper("cwe") == F.col("c_cwe"), F.lit(False)) | F.coalesce((F.col("category") == F.col("c_category")) & (F.col("category") != ""), F.lit(False))
    shared = own.select(*key, "own", "cwe", "category", F.explode("paths").alias("path")).join(parts, "path").where(agree & (F.col("own") != F.col("signature"))).select(*key, "signature", F.lit("component").alias("matched_by")).distinct()
    return by_print.unionByName(by_signature).unionByName(shared).join(strength, "signature").select(*key, "signature", "matched_by", "max_strength")


def claims_checked(baseline: DataFrame, findings: DataFrame, key: list[str]) -> DataFrame:
    """key with state of recorded claim hashes (claim) against findings' (claim, validation_status).

    `missing`: recorded and gone; `mismatch`: edited in place; `corrected_drift`: changed, and known as corrected;
    `unbaselined`: not recorded yet. Equal ones give no row.
    """
    both = baseline.select(*key, F.col("claim").alias("was")).join(findings.select(*key, F.col("claim").alias("now"), "validation_status", F.lit(True).alias("here")), key, "full")
    state = F.when(F.col("was").isNull(), "unbaselined").when(F.col("here").isNull(), "missing").when(F.col("was") == F.col("now"), None).when(F.col("validation_status") == "corrected", "corrected_drift").otherwise("mismatch")
    return both.select(*key, state.alias("state")).where("state is not null")


#: What shows that a probe failed instead of refuting: name and pattern, in the order they're tried; fixed values.
VERBS = "(?:get|list|watch|create|update|patch|delete|impersonate|use)"
SIGNATURES = [
    ("forbidden", rf"(?i)Error from server \(Forbidden\)|\bforbidden: User\b|\bForbidden\b[^\n]{{0,160}}\bcannot {VERBS}\b|\bUser \"[^\"]+\" cannot {VERBS}\b"),
    ("command-not-found", r"(?i)command not found|executable file not found|not found in \$?PATH"),
    ("jsonpath-error", r"(?i)error (?:executing|parsing) jsonpath|unrecognized identifier"),
    ("not-found", r"(?i)Error from server \(NotFound\)|the server doesn'?t have a resource type"),
    ("does-not-exist", r"(?i)\bdoes not exist\b"),
    ("could-not-connect", r"(?i)Could not connect|Unable to connect to the server|could not resolve host|no route to host"),
    ("unsubstituted-template", r"system:serviceaccount:\{[^}]*\}|\{ns\}:\{sa\}|--as=[^\s\"']*\{[a-z_]+\}"),
]


def probe_flag(verb: Column, observed: Column, install_failed: Column | None = None) -> Column:
    """Why a refuting probe doesn't count, or NULL: the target wasn't there, an error, a role probe without subjects or with a template."""
    text = F.coalesce(observed, F.lit(""))
    role = F.coalesce(verb == "rbac-can-i", F.lit(False)) | F.contains(text, F.lit("vf-rbac-"))
    flag = reduce(lambda rest, s: F.when(text.rlike(s[1]), f"error-signature:{s[0]}").otherwise(rest), reversed(SIGNATURES), F.lit(None).cast("string"))
    empty = F.when(role & text.rlike(r"(?m)^vf-rbac-tried:\s*$"), "rbac-zero-subjects")
    template = F.when(role & text.rlike(r"system:serviceaccount:\{[^}]*\}|\{ns\}:\{sa\}"), "rbac-template-placeholder")
    flag = F.coalesce(flag, template, empty)
    return flag if install_failed is None else F.when(F.coalesce(install_failed, F.lit(False)), "target-not-deployed").otherwise(flag)


def refutation_flag(verdict: Column, steps: Column, impact: Column, given: Column, install_failed: Column, controls_required: bool = False, differential_required: bool = False) -> Column:
    """Why a refuted finding can't be trusted, or NULL; steps are struct<verb, verdict, observed, controls array<boolean>, discriminated boolean>.

    A flag given holds. Then, for refuted ones: the target wasn't deployed; a control of a refuting step failed (or none
    passed, if required); a differential probe told nothing apart (or a role probe has none, if required); all probes are flagged.
    """
    refuting = F.filter(steps, lambda s: s["verdict"] == "refuted")
    controls = F.flatten(F.transform(refuting, lambda s: F.coalesce(s["controls"], F.array().cast("array<boolean>"))))
    failed = F.exists(controls, lambda c: F.coalesce(~c, F.lit(False)))
    passed = F.exists(controls, lambda c: F.coalesce(c, F.lit(False)))
    blind, told = F.exists(refuting, lambda s: F.coalesce(~s["discriminated"], F.lit(False))), F.exists(refuting, lambda s: F.coalesce(s["discriminated"], F.lit(False)))
    role = F.exists(refuting, lambda s: (s["verb"] == "rbac-can-i") | F.coalesce(F.contains(s["observed"], F.lit("vf-rbac-")), F.lit(False)))
    flags = F.transform(refuting, lambda s: probe_flag(s["verb"], s["observed"]))
    probed = F.when(F.size(flags) > 0, F.when(F.forall(flags, lambda x: x.isNotNull()), F.get(flags, F.lit(0)))).when(F.coalesce(impact, F.lit("")) != "", probe_flag(F.lit(""), impact))
    out = F.when(F.coalesce(install_failed, F.lit(False)), "target-not-deployed").when(failed, "failed-positive-control")
    if controls_required:
        out = out.when(~passed, "missing-positive-control")
    out = out.when(blind, "non-discriminating-oracle")
    if differential_required:
        out = out.when(role & ~told, "missing-differential-probe")
    return F.coalesce(F.when(given != "", given), F.when(verdict == "refuted", out.otherwise(probed)))
