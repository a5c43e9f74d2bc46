"""Readers of the corpus: listings, tolerant JSON, ordered lines, bundles of artifacts, dependency lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.workspace import exists

#: Suffix of a report's file name -> its kind; fixed values.
KINDS = {"security-audit": "code-audit", "cloud-config-audit": "cloud-config", "container-audit": "container-audit"}


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, folder, name, length, modified of every file below root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.substring_index("path", "/", -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


#: Folders that hold a tool's state and no reports, besides those that begin with a dot or an underscore; fixed values.
STATE_FOLDERS = ("node_modules", "__pycache__", "venv", "site-packages")


def corpus(files: DataFrame, root: str, trees: list[str]) -> DataFrame:
    """Files of a listing that lie in one of the trees below root, outside folders of state, with their tree and the path below it."""
    below = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    inner = F.when(F.contains(below, F.lit(root.rstrip("/") + "/")), F.substring_index(below, root.rstrip("/") + "/", -1))
    parts = F.split(inner, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(folders, lambda p: p.rlike("^[._]") | p.isin(*STATE_FOLDERS))
    return files.withColumns({"tree": F.get(parts, F.lit(0)), "below": inner}).where(F.col("tree").isin(*trees) & ~hidden)


def link_aliases(spark: SparkSession, root: str) -> DataFrame:
    """(alias, target, kind) of symbolic links below a folder of this machine; they are recorded and never followed. A listing of names, not of data."""
    import os

    rows = []
    for folder, names, found in os.walk(root, followlinks=False):
        for name in names + found:
            path = os.path.join(folder, name)
            if os.path.islink(path):
                rows.append((path, os.path.realpath(path), "directory" if os.path.isdir(path) else "file"))
    return spark.createDataFrame(rows, "alias string, target string, kind string")


def reports(files: DataFrame) -> DataFrame:
    """One row per report of a listing, with the artifacts that stand beside it; the kind comes from the suffix."""
    shape = r"^(.+)-(security-audit|cloud-config-audit|container-audit|findings-current|findings-layer|triage|threat-model|priv-profile)\.(json|md)$"
    named = files.select("folder", "path", F.regexp_extract("name", shape, 1).alias("base"), F.regexp_extract("name", shape, 2).alias("part"), F.regexp_extract("name", shape, 3).alias("form")).where("part <> ''")
    at = lambda part, form: F.max(F.when((F.col("part") == part) & (F.col("form") == form), F.col("path")))
    kind = F.max(F.when(F.col("part").isin(*KINDS), F.try_element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("part"))))
    audit = lambda form: F.max(F.when(F.col("part").isin(*KINDS) & (F.col("form") == form), F.col("path")))
    return named.groupBy("folder", "base").agg(kind.alias("report_kind"), audit("json").alias("audit_json"), audit("md").alias("audit_md"), at("findings-current", "json").alias("findings_current"), at("findings-layer", "json").alias("findings_layer"), at("triage", "json").alias("triage_json"), at("threat-model", "md").alias("threat_model"), at("priv-profile", "json").alias("priv_profile"))


def json_documents(spark: SparkSession, paths: str | list[str], schema: str, recursive: bool = False) -> DataFrame:
    """One row per file: path, doc by schema, raw as a variant with the unknown keys; both NULL if the file isn't JSON."""
    text = spark.read.text(paths, wholetext=True, recursiveFileLookup=recursive).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.select("path", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("doc"), F.try_parse_json("value").alias("raw")).withColumn("doc", F.when(F.col("raw").isNotNull(), F.col("doc")))


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_no (from 0), line of text files of any size, which are read in splits.

    A split numbers its lines from its start; the numbers of the splits before it in its file are added, which are one
    row for each split.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line"))
    blocks = lines.groupBy("path", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("path").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("path", "__block", "__first", before.alias("__before"))
    return lines.join(placed, ["path", "__block"]).select("path", (F.col("__id") - F.col("__first") + F.col("__before")).alias("line_no"), "line")


def json_lines(spark: SparkSession, paths: str | list[str], schema: str, containing: list[str] | None = None) -> DataFrame:
    """path, line_no, doc of every line that is a JSON object, in the order of the file; blank and bad lines are skipped.

    A cheap test for any of the given parts runs before the parser.
    """
    lines = text_lines(spark, paths)
    if containing:
        lines = lines.where(reduce(lambda a, b: a | b, [F.contains(F.col("line"), F.lit(part)) for part in containing]))
    return lines.where(F.try_parse_json("line").isNotNull()).select("path", "line_no", F.from_json("line", schema).alias("doc")).where("doc is not null")


def json_lines_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """json_lines of a file or folder, or no rows if it doesn't exist."""
    return json_lines(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], f"path string, line_no bigint, doc struct<{_colons(schema)}>")


def _colons(schema: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[7:-1]


def verified(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """path, content of files whose SHA-256 is the expected one (path, sha256)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).join(expected, "path").where(F.sha2("content", 256) == F.col("sha256")).select("path", "content")


def graph_documents(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON graphs; keys of an edge beyond from, to and rel become its attributes."""
    docs = json_documents(spark, paths, "nodes array<struct<id:string,type:string,label:string,attrs:map<string,string>>>, edges array<map<string,string>>").where("doc is not null")
    nodes = docs.select(F.explode("doc.nodes").alias("n")).select("n.id", F.col("n.type").alias("kind"), "n.label", F.to_json("n.attrs").alias("attrs"))
    edges = docs.select(F.explode("doc.edges").alias("e")).select(F.col("e")["from"].alias("src"), F.col("e")["to"].alias("dst"), F.col("e")["rel"].alias("rel"), F.to_json(F.map_filter("e", lambda k, _: ~k.isin("from", "to", "rel"))).alias("attrs"))
    return nodes, edges


def components(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, subject, name, version, purl of every component of CycloneDX lists."""
    docs = json_documents(spark, paths, "metadata struct<component:struct<name:string,version:string>>, components array<struct<name:string,version:string,purl:string>>")
    return docs.select("path", F.col("doc.metadata.component.name").alias("subject"), F.explode("doc.components").alias("c")).select("path", "subject", "c.*")


def manifests(files: DataFrame) -> DataFrame:
    """path, declared, name, version, indirect of every dependency in files (path, text)."""
    from quarryline.functions.kernels import manifest

    parsed = files.select("path", manifest(F.col("path"), F.col("text")).alias("m"))
    return parsed.select("path", F.col("m.declared").alias("declared"), F.explode("m.deps").alias("d")).select("path", "declared", "d.*")


def language_cache(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(repo, language, bytes) of lines ``{repo, languages: {name: bytes}}``."""
    lines = json_lines(spark, paths, "repo string, languages map<string,bigint>")
    return lines.select("doc.repo", F.explode("doc.languages").alias("language", "bytes"))


def rule_packs(files: DataFrame) -> DataFrame:
    """(path, rule, cwe, language) of rule packs (path, text) in YAML, one row for each weakness and language of a rule; a file that can't be read has none."""
    from quarryline.functions.scanners import yaml_documents

    schema = "rules array<struct<id:string,languages:array<string>,metadata:struct<cwe:array<string>>>>"
    rules = files.select("path", F.explode(yaml_documents("text")).alias("t")).select("path", F.explode(F.from_json("t", schema)["rules"]).alias("r"))
    named = rules.select("path", F.col("r.id").alias("rule"), F.explode("r.metadata.cwe").alias("c"), F.col("r.languages").alias("l"))
    return named.select("path", "rule", F.regexp_extract("c", r"(?i)(CWE-\d+)", 1).alias("cwe"), F.explode("l").alias("language")).where("cwe <> ''")


def assessments(spark: SparkSession, root: str) -> DataFrame:
    """(path, target, framework, generated_at, state) of compliance assessments below a folder: frameworks covered, and those skipped with the reason."""
    schema = "metadata struct<artifact:string,generated_at:string,target:struct<environment:string,product:string,repos:array<string>>,skipped_frameworks:map<string,string>>, coverage map<string,string>"
    kept = json_documents(spark, root, schema, recursive=True).where("doc.metadata.artifact = 'compliance-assessment'")
    t = F.col("doc.metadata.target")
    target = F.coalesce(F.nullif(t["environment"], F.lit("")), F.nullif(t["product"], F.lit("")), F.nullif(F.array_join(t["repos"], ","), F.lit("")), F.lit("(unnamed)"))
    part = lambda c, state: F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("framework"), (F.lit(state) if state else e["value"]).alias("state")))
    every = F.concat(F.coalesce(part("doc.coverage", "covered"), F.array()), F.coalesce(part("doc.metadata.skipped_frameworks", None), F.array()))
    return kept.select("path", target.alias("target"), F.col("doc.metadata.generated_at").alias("generated_at"), F.explode(every).alias("f")).select("path", "target", "f.framework", "generated_at", "f.state")


def feed_status(files: DataFrame, now, max_age_hours: float = 24.0) -> DataFrame:
    """(path, age_hours, status) of feeds in a listing (path, modified): `fresh` or `stale`; a feed that's wanted and isn't listed is up to the caller."""
    from quarryline.functions.text import age_hours

    aged = files.select("path", F.round(age_hours(F.col("modified"), now), 3).alias("age_hours"))
    return aged.withColumn("status", F.when(F.col("age_hours") > max_age_hours, "stale").otherwise("fresh"))


def inside(root: str, path):
    """Whether a path stays below a folder: no climbing with ``..``, no other root."""
    from quarryline.functions.text import relative_ref

    return relative_ref(path, root).isNotNull()
