"""From confirmed findings to clusters, rules that cover them, precision, worklists, and how runs of rules compare.

Rules are a table (rule, cwe, language), one row per combination they state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions import text as fx

#: Weaknesses that show as a pattern of code, in groups (injection; configuration; cryptography and TLS; secrets;
#: deserialization and parsing; requests and redirects; files and permissions), and those that are facts about a dependency; fixed values.
SYNTACTIC = (
    22, 23, 36, 73, 77, 78, 79, 80, 88, 89, 90, 91, 93, 94, 95, 96, 116, 117, 643, 917, 943,
    15, 614, 1004, 1244,
    261, 295, 296, 319, 326, 327, 328, 330, 338, 347, 757, 759, 760, 916,
    259, 312, 313, 321, 532, 540, 798,
    502, 611, 776, 1321, 1333,
    601, 918,
    377, 379, 732,
)
DEPENDENCY = (937, 1035, 1104, 1395)
#: Languages that rules can be written for, and that a fresh pack has few of when there are fewer than THIN; fixed values.
RULEABLE = ("go", "python", "typescript", "javascript", "java", "ruby", "c", "cpp", "rust", "bash", "php", "csharp")
THIN, GATE, REDISCOVERIES = 8, 0.5, 3


def dominant_language(paths: Column) -> Column:
    """Language of most of an array of paths: source before configuration, equal counts by what comes first; ``unknown`` if none is known."""
    ext = lambda p: F.lower(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1))
    tier = lambda config: F.filter(F.transform(paths, lambda p: F.when(ext(p).isin(*fx.CONFIG) == F.lit(config), fx.language_of(p))), lambda v: v.isNotNull())

    def most(langs: Column) -> Column:
        ranked = F.transform(F.array_distinct(langs), lambda v: F.struct(F.size(F.filter(langs, lambda x: x == v)).alias("n"), (-F.array_position(langs, v)).alias("first"), v.alias("language")))
        return F.array_max(ranked)["language"]

    return F.coalesce(most(tier(False)), most(tier(True)), F.lit("unknown"))


def expressible(cwe: Column, file: Column, language: Column, languages: tuple[str, ...] = (*RULEABLE, "yaml")) -> Column:
    """Whether a rule can express a finding: ``syntactic``, or the first reason why not."""
    number = F.regexp_extract(cwe, r"(?i)CWE-(\d+)", 1).try_cast("int")
    return (
        F.when(number.isNull(), "no_cwe").when(F.coalesce(file, F.lit("")) == "", "no_location_anchor").when(number.isin(*DEPENDENCY), "dependency_version_class")
        .when(~F.coalesce(language, F.lit("unknown")).isin(*languages), F.concat(F.lit("language_not_ruleable: "), F.coalesce(language, F.lit("unknown"))))
        .when(~number.isin(*SYNTACTIC), "semantic_logic_class").otherwise("syntactic")
    )


def corpus(findings: DataFrame) -> DataFrame:
    """Confirmed findings with cwe (the first, ``CWE-?`` if none), language, the first five locations, a title of at most 160 characters."""
    paths, cwes = F.from_json("paths", "array<string>"), F.from_json("cwes", "array<string>")
    return findings.where("validity = 'confirmed'").select(
        "row_no", F.col("repo_key").alias("repo"), "finding_id", F.coalesce(F.upper(F.get(cwes, F.lit(0))), F.lit("CWE-?")).alias("cwe"), F.transform(cwes, F.upper).alias("cwes"), "severity", "resolution",
        dominant_language(paths).alias("language"), F.slice(paths, 1, 5).alias("locations"), F.substring("title", 1, 160).alias("title"), "fingerprint",
    )


def clusters(tps: DataFrame, examples: int = 5) -> DataFrame:
    """(cwe, language, n, repos, examples): the examples are the first findings by row_no, kept by a running top-k, not gathered."""
    place = F.row_number().over(W.partitionBy("cwe", "language").orderBy("row_no"))
    first = tps.select("cwe", "language", "row_no", "finding_id").withColumn("place", place).where(F.col("place") <= examples)
    named = first.groupBy("cwe", "language").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "finding_id"))), lambda x: x["finding_id"]), ",").alias("examples"))
    return tps.groupBy("cwe", "language").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repo").alias("repos")).join(named, ["cwe", "language"])


def covered(found: DataFrame, rules: DataFrame) -> DataFrame:
    """clusters with covered_by (rules joined by commas, NULL if none) and state: covered, uncovered, or not_ruleable."""
    hit = rules.select("cwe", "language", "rule").distinct().groupBy("cwe", "language").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("covered_by"))
    joined = found.join(hit, ["cwe", "language"], "left")
    return joined.withColumn("state", F.when(F.col("covered_by").isNotNull(), "covered").when(F.col("language").isin(*RULEABLE), "uncovered").otherwise("not_ruleable"))


def language_coverage(tps: DataFrame, with_cover: DataFrame, rules: DataFrame) -> DataFrame:
    """(language, confirmed, covered_clusters, uncovered_clusters, uncovered_tps, pack_rules, place), place by uncovered, then confirmed findings."""
    c = with_cover.groupBy("language").agg(F.count_if(F.col("state") == "covered").alias("covered_clusters"), F.count_if(F.col("state") == "uncovered").alias("uncovered_clusters"), F.sum(F.when(F.col("state") == "uncovered", F.col("n")).otherwise(0)).alias("uncovered_tps"))
    pack = rules.groupBy("language").agg(F.countDistinct("rule").alias("pack_rules"))
    out = tps.groupBy("language").agg(F.count(F.lit(1)).alias("confirmed")).join(c, "language", "left").join(pack, "language", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    out = out.select("language", "confirmed", *map(zero, ("covered_clusters", "uncovered_clusters", "uncovered_tps", "pack_rules")))
    return out.withColumn("place", F.row_number().over(W.orderBy(F.desc("uncovered_tps"), F.desc("confirmed"), "language")))


def coverage_block(languages: DataFrame, rules: DataFrame, thin: int = THIN, leave_out: tuple[str, ...] = ("yaml", "html", "terraform", "unknown")) -> DataFrame:
    """(repo, thin, uncovered): languages (repo, language) of each repository with few rules, and with none, joined by commas."""
    n = rules.groupBy("language").agg(F.countDistinct("rule").alias("n"))
    counted = languages.where(~F.col("language").isin(*leave_out)).select("repo", "language").distinct().join(n, "language", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("language")))), ",")  # noqa: E731  few languages each
    return counted.groupBy("repo").agg(listed((F.col("n") > 0) & (F.col("n") < thin)).alias("thin"), listed(F.col("n") == 0).alias("uncovered"))


def precision(judged: DataFrame) -> DataFrame:
    """(rule, promoted, dismissed, other, precision) of judged hits (rule, result); precision is NULL where nothing was judged."""
    result = F.lower(F.trim("result"))
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    out = judged.where(F.coalesce("rule", F.lit("")) != "").groupBy("rule").agg(n(result == "promoted").alias("promoted"), n(result == "dismissed").alias("dismissed"), F.count_if(~F.coalesce(result.isin("promoted", "dismissed"), F.lit(False))).alias("other"))
    return out.withColumn("precision", F.round(F.try_divide(F.col("promoted"), F.col("promoted") + F.col("dismissed")), 3))


def gate_crossings(before: DataFrame, now: DataFrame, gate: float = GATE) -> DataFrame:
    """(rule, previous, precision, direction) of rules that are on the other side of the gate than before, or new below it."""
    both = now.select("rule", "precision").join(before.select("rule", F.col("precision").alias("previous")), "rule", "left").where("precision is not null")
    p, c = F.col("previous"), F.col("precision")
    way = F.when(p.isNull(), F.when(c < gate, "entered_below_gate")).when((p >= gate) & (c < gate), "fell_below_gate").when((p < gate) & (c >= gate), "rose_above_gate")
    return both.select("rule", "previous", "precision", way.alias("direction")).where("direction is not null")


def cluster_delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """(cwe, language, change, previous_n, n) of uncovered clusters that are new, resolved or changed between two snapshots."""
    only = lambda df, name: df.where("state = 'uncovered'").select("cwe", "language", F.col("n").alias(name))
    both = only(before, "previous_n").join(only(now, "n"), ["cwe", "language"], "full")
    change = F.when(F.col("previous_n").isNull(), "new").when(F.col("n").isNull(), "resolved").when(F.col("n") != F.col("previous_n"), "changed")
    return both.select("cwe", "language", change.alias("change"), "previous_n", "n").where("change is not null")


def worklist(tps: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, expected_rules, n_findings): repositories with confirmed findings that rules cover, and the rules that must fire there."""
    pairs = tps.select("repo", "cwe", "language", "row_no").join(rules.select("cwe", "language", "rule").distinct(), ["cwe", "language"])
    return pairs.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("expected_rules"), F.countDistinct("row_no").alias("n_findings"))


def targets(tps: DataFrame, commit: str = "fingerprint") -> DataFrame:
    """(repo, commit, locations, cwes, n): what to scan again; findings without a location or a commit of 7 to 40 hexadecimal digits are left out.

    A repository's locations and weaknesses at one commit are gathered without repetition.
    """
    fine = tps.where(F.col(commit).rlike("^[0-9a-f]{7,40}$") & (F.size("locations") > 0))
    return fine.groupBy("repo", F.col(commit).alias("commit")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("locations")))).alias("locations"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_union(F.coalesce("cwes", F.array().cast("array<string>")), F.array("cwe")))))).alias("cwes"), F.count(F.lit(1)).alias("n"))


def reachability(aims: DataFrame) -> DataFrame:
    """(n, cwe): most repositories of targets that share a weakness, and the weakness; the smallest of several. One row, NULL without targets."""
    shared = aims.select("repo", F.explode("cwes").alias("cwe")).groupBy("cwe").agg(F.countDistinct("repo").alias("n"))
    best = F.max(F.struct("n", (-F.regexp_extract("cwe", r"(\d+)", 1).try_cast("int")).alias("lowest"), "cwe"))
    return shared.agg(best.alias("b")).select("b.n", "b.cwe")


def rediscovered(hits: DataFrame, aims: DataFrame) -> DataFrame:
    """hits (repo, rule, path) with kind: `rediscovery` if a confirmed finding of the repository has the path, else `novel`."""
    known = aims.select("repo", F.explode(F.transform("locations", fx.plain_path)).alias("__p")).distinct().withColumn("__hit", F.lit(True))
    return hits.withColumn("__p", fx.plain_path(F.col("path"))).join(known, ["repo", "__p"], "left").withColumn("kind", F.when(F.col("__hit"), "rediscovery").otherwise("novel")).drop("__p", "__hit")


def calibration(classified: DataFrame, gate: int = REDISCOVERIES) -> DataFrame:
    """(rule, fires, rediscoveries, novel, repos_fired, repos_rediscovered, clears_gate); the row with a NULL rule is all of them."""
    again = F.col("kind") == "rediscovery"
    out = classified.rollup("rule").agg(F.count(F.lit(1)).alias("fires"), F.count_if(again).alias("rediscoveries"), F.count_if(~again).alias("novel"), F.countDistinct("repo").alias("repos_fired"), F.countDistinct(F.when(again, F.col("repo"))).alias("repos_rediscovered"))
    return out.withColumn("clears_gate", F.col("repos_rediscovered") >= gate)


def first_of_sources(batches: list[tuple[str, DataFrame]]) -> DataFrame:
    """Findings (repo, file, cwe, title, row_no) of several sources, in their order; of findings alike in repository, file, weakness and the start of the title the first source's counts."""
    every = None
    for i, (name, df) in enumerate(batches):
        part = df.select("repo", "file", "cwe", "title", "row_no", F.lit(i).alias("rank"), F.lit(name).alias("source"))
        every = part if every is None else every.unionByName(part)
    key = [F.lower("repo").alias("k1"), F.col("file").alias("k2"), F.col("cwe").alias("k3"), F.lower(F.substring("title", 1, 60)).alias("k4")]
    best = every.select("*", *key).groupBy("k1", "k2", "k3", "k4").agg(F.min(F.struct("rank", "row_no", "source", "repo", "file", "cwe", "title")).alias("b"))
    return best.select("b.source", "b.repo", "b.file", "b.cwe", "b.title", "b.row_no")


def emitted(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """(rule, repos, repos_with_hits, hits, errors) of a sweep: asked (rule, repo, error) with or without hits (rule, repo)."""
    n = hits.groupBy("rule", "repo").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(n, ["rule", "repo"], "left").groupBy("rule").agg(F.count(F.lit(1)).alias("repos"), F.count_if(F.col("n").isNotNull()).alias("repos_with_hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def scores(expected: DataFrame, got: DataFrame, within: float = 1.0) -> DataFrame:
    """(variant, n, hits, metric, severity_accuracy) of expected (variant, id, verdict, score) against verdicts got (variant, id, verdict, flag, estimate).

    A missing verdict is wrong, a flagged one too. Severity counts where a confirmed verdict of ``vuln`` has an estimate.
    """
    g = got.select("variant", "id", F.col("verdict").alias("g"), "flag", "estimate")
    row = expected.join(g, ["variant", "id"], "left").withColumn("g", F.coalesce("g", F.lit("missing")))
    ok = (F.col("g") == F.col("verdict")) & F.col("flag").isNull()
    rated = (F.col("variant") == "vuln") & (F.col("g") == "confirmed") & F.col("estimate").isNotNull()
    close = F.when(rated, (F.abs(F.col("estimate") - F.col("score")) <= within).cast("int"))
    return row.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("hits"), F.round(F.avg(ok.cast("int")), 3).alias("metric"), F.round(F.avg(close), 3).alias("severity_accuracy"))


def advisory_candidates(hits: DataFrame, order: tuple[str, ...] = ("module_required_not_observed", "package_imported_not_observed", "symbol_reachable")) -> DataFrame:
    """(advisory, ecosystem, package, reachability, example_trace, sources) of a scanner's hits (and level, trace, source).

    reachability is the most specific seen, the example the shortest trace seen at the top level, sources sorted and distinct.
    """
    level = F.array_position(F.array(*map(F.lit, order)), F.col("level"))
    top = F.when((F.col("level") == order[-1]) & (F.size("trace") > 0), F.struct(F.size("trace").alias("n"), F.array_join("trace", " > ").alias("t")))
    return hits.groupBy("advisory", "ecosystem", "package").agg(F.max_by("level", level).alias("reachability"), F.min(top)["t"].alias("example_trace"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def lane(before: DataFrame | None, now: DataFrame, previous: DataFrame | None, precisions: DataFrame, counts: tuple[int, int]) -> DataFrame:
    """(kind, subject, detail) of a run of the rule lane: what changed since the snapshot before, and whether anybody must look.

    before, now: clusters with state; previous, precisions: by rule; counts: confirmed findings before and now. A
    first run (before is None) is a baseline: what is there is inventory and no news.
    """
    spark = now.sparkSession
    head = [("growth", "confirmed", str(counts[1] - counts[0]) if before is not None else "")]
    if before is None or previous is None:
        return spark.createDataFrame([("baseline", "run", "no snapshot before"), *head], "kind string, subject string, detail string")
    changes = cluster_delta(before, now).select(F.concat(F.col("change"), F.lit("_cluster")).alias("kind"), F.concat_ws("/", "cwe", "language").alias("subject"), F.concat_ws(" ", F.coalesce(F.col("previous_n").cast("string"), F.lit("-")), F.coalesce(F.col("n").cast("string"), F.lit("-"))).alias("detail"))
    crossed = gate_crossings(previous, precisions).select(F.lit("gate").alias("kind"), F.col("rule").alias("subject"), F.col("direction").alias("detail"))
    news = changes.unionByName(crossed)
    asks = news.where("kind = 'new_cluster' or (kind = 'gate' and detail <> 'rose_above_gate')").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("attention").alias("kind"), F.col("kind").alias("subject"), F.col("n").cast("string").alias("detail"))
    return news.unionByName(asks).unionByName(spark.createDataFrame(head, "kind string, subject string, detail string"))
