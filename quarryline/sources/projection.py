"""The findings projection: tables built from report documents, kept in a folder by revision, and read back.

Tables are made with DataFrame operations only, one row per report, finding, event and so on; a document that can't be
read gives no rows and stops nothing. A build is written to a folder of its own and named by a file that's written
last, so readers see the build before or the new one, never half of one.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.operators.relational import last_per_key
from quarryline.workspace import children, discard, shuffles_dropped

REVISION = 3  # of the tables' columns; readers refuse any other
_LOCATIONS = "locations array<struct<path:string,lines:string>>"
REPORT = (
    "title string, metadata struct<repository:string,commit:string,date:string,ref:string,ref_kind:string>, "
    f"findings array<struct<id:string,title:string,severity:string,category:string,cwes:array<string>,cvss:struct<score:double,vector:string>,{_LOCATIONS.replace(' ', ':', 1)},fingerprint:string,validation_status:string,"
    "control_refs:array<string>,disposition:struct<validity:string,resolution:string,assurance:string,last_updated:string>>>"
)
LAYER = (
    "metadata struct<external_refs:map<string,array<struct<system:string,id:string,confidence:string,matched_on:string,stamped_at:string>>>>, "
    "events array<struct<event_id:string,finding_ref:string,recorded_at:string,occurred_at:string,source:struct<type:string,ref:string,actor:struct<kind:string,identity:string>>,disposition:struct<validity:string,resolution:string>>>"
)
VALIDATION = "source_reports array<struct<kind:string,path:string>>, validated_findings array<struct<source_id:string,finding_ref:string,verdict:string,technique:string>>"
IMPACT = "cve string, module string, repos array<struct<repo_id:string,classification:string,evidence_level:string,needs_manual_trace:boolean>>"
DECISIONS = "register string, decisions array<struct<decision_id:string,title:string,status:string,repo:string,pin:string>>"


def parsed(documents: DataFrame, schema: str, keep: list[str] | None = None) -> DataFrame:
    """Documents (path, text) with doc by schema; those that aren't JSON objects are left out."""
    valid = F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT")
    return documents.where(valid).select(*(keep or [c for c in documents.columns if c != "text"]), F.from_json("text", schema).alias("doc"))


def repo_key(tree: Column, product: Column, folder: Column, base: Column, kind: Column) -> Column:
    """tree, product (if any), folder and base with slashes between; kinds other than code audits after a #."""
    return F.concat(F.concat_ws("/", tree, product, folder, base), F.when(kind != "code-audit", F.concat(F.lit("#"), kind)).otherwise(""))


def repos_table(bundles: DataFrame, prefixes: tuple[str, ...] = fx.BRANCH_PREFIXES) -> DataFrame:
    """Rows of repos from bundles: tree, ownership, business_unit, label, product, repo_dir, base, report_kind, the artifacts' paths, and a declared ref and ref_kind (NULL if the report states none).

    A declared ref counts before the branch that the name ends with; the slug is the name without that branch.
    """
    slug_ref = fx.branch_of(F.col("base"), prefixes)
    declared = F.nullif("declared_ref", F.lit(""))
    ref_source = F.when(declared.isNotNull(), "metadata").when(slug_ref.isNotNull(), "slug")
    out = bundles.withColumns({"ref": F.coalesce(declared, slug_ref), "ref_source": ref_source, "base_slug": F.when(slug_ref.isNotNull(), F.expr("substring(base, 1, length(base) - length(substring_index(base, '__', -1)) - 2)")).otherwise(F.col("base"))})
    branch = F.when(F.col("ref_source") == "metadata", F.coalesce(F.col("ref_kind") == "branch", F.lit(False))).otherwise(F.col("ref").isNotNull())
    preferred = F.when(F.col("findings_current").isNotNull(), "findings_current").when(F.col("audit_json").isNotNull(), "audit_json").otherwise("audit_md_only")
    key = repo_key(F.col("tree"), F.col("product"), F.col("repo_dir"), F.col("base"), F.col("report_kind"))
    return out.withColumns({"repo_key": key, "is_branch_audit": branch.cast("int"), "is_md_only": (F.col("audit_json").isNull() & F.col("findings_current").isNull()).cast("int"), "preferred": preferred})


def findings_table(reports: DataFrame) -> DataFrame:
    """Rows of findings from reports (repo_key, path, text); what a document doesn't state is NULL, lists are JSON text.

    Paths that are empty are left out; a finding without a fingerprint gets that of repository, paths and weakness. A
    finding that stands in several documents or twice in one counts as in the last, by path and place.
    """
    doc = parsed(reports, REPORT)
    # the parts are taken first: beside the generator, a part of doc would put the whole document into each finding's row;
    # not outer, it would have the document parsed once more, for a filter on its findings' number
    parts = doc.select("repo_key", "path", F.col("doc.metadata.repository").alias("repository"), F.col("doc.findings").alias("findings"))
    f = parts.select("repo_key", "path", "repository", F.posexplode_outer("findings").alias("place", "f")).where("f.id is not null")
    paths = F.transform(F.filter("f.locations", lambda x: F.coalesce(x["path"], F.lit("")) != ""), lambda x: x["path"])
    cwe = F.get("f.cwes", F.lit(0))
    own = fx.fingerprint(F.col("repository"), F.coalesce(paths, F.array().cast("array<string>")), cwe)
    rows = f.select(
        "repo_key", F.col("f.id").alias("finding_id"), F.col("f.title").alias("title"), F.col("f.severity").alias("severity"), cwe.alias("primary_cwe"), F.to_json("f.cwes").alias("cwes"), F.col("f.cvss.score").alias("cvss_score"), F.col("f.cvss.vector").alias("cvss_vector"),
        F.coalesce(F.nullif("f.fingerprint", F.lit("")), own).alias("fingerprint"), F.col("f.disposition.validity").alias("validity"), F.col("f.disposition.resolution").alias("resolution"), F.col("f.disposition.assurance").alias("assurance"),
        F.col("f.validation_status").alias("validation_status"), F.col("f.disposition.last_updated").alias("last_updated"), F.to_json(F.coalesce(paths, F.array().cast("array<string>"))).alias("paths"), F.when(F.size("f.control_refs") > 0, F.to_json("f.control_refs")).alias("control_refs"), "path", "place",
    )
    return last_per_key(rows, ["repo_key", "finding_id"], ["path", "place"]).drop("path", "place")


def events_table(layers: DataFrame) -> DataFrame:
    """Rows of events from disposition layers (repo_key, path, text); the last of an event id in a repository counts."""
    e = parsed(layers, LAYER).select("repo_key", "path", F.posexplode("doc.events").alias("place", "e")).where("e.event_id is not null")
    rows = e.select(
        F.col("e.event_id").alias("event_id"), "repo_key", F.col("e.finding_ref").alias("finding_id"), "e.recorded_at", "e.occurred_at", F.col("e.source.type").alias("source_type"), F.col("e.source.ref").alias("source_ref"), F.col("e.source.actor.kind").alias("actor_kind"),
        F.col("e.source.actor.identity").alias("actor_identity"), F.col("e.disposition.validity").alias("validity"), F.col("e.disposition.resolution").alias("resolution"), "path", "place",
    )
    return last_per_key(rows, ["event_id", "repo_key"], ["path", "place"]).drop("path", "place")


def provenance_table(layers: DataFrame) -> DataFrame:
    """Outside references of findings (system ``cve`` unless said); those without an id are left out, the last by path counts."""
    r = parsed(layers, LAYER).select("repo_key", "path", F.explode("doc.metadata.external_refs").alias("finding_id", "refs")).select("repo_key", "path", "finding_id", F.posexplode("refs").alias("place", "r")).where("coalesce(r.id, '') <> ''")
    rows = r.select(F.col("r.id").alias("cve"), F.coalesce("r.system", F.lit("cve")).alias("system"), "repo_key", "finding_id", "r.confidence", "r.matched_on", "r.stamped_at", "path", "place")
    return last_per_key(rows, ["cve", "repo_key", "finding_id"], ["path", "place"]).drop("path", "place")


def validations_table(reports: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows of validations from validation reports (path, text); repo_key is that of the first source report whose folder is a repository's (main lines before branches), else NULL."""
    doc = parsed(reports, VALIDATION)
    folders = repos.where("report_path is not null").groupBy(F.regexp_replace("report_path", "/[^/]*$", "").alias("folder")).agg(F.min_by("repo_key", F.struct("is_branch_audit", "repo_key")).alias("repo_key"))
    sources = doc.select("path", F.posexplode("doc.source_reports").alias("place", "s")).select("path", "place", F.regexp_replace("s.path", "/[^/]*$", "").alias("folder"))
    named = sources.join(folders, "folder").groupBy("path").agg(F.min_by("repo_key", "place").alias("repo_key"))
    v = doc.select("path", F.explode("doc.validated_findings").alias("v"))
    finding = F.coalesce(F.nullif(F.substring_index("v.source_id", "/", -1), F.lit("")), "v.finding_ref")
    return v.join(named, "path", "left").select("repo_key", finding.alias("finding_id"), "v.verdict", "v.technique", F.col("path").alias("report_path"))


def impact_table(reports: DataFrame) -> DataFrame:
    """Rows of impact from impact reports (path, text); of one advisory and repository the last by path counts."""
    r = parsed(reports, IMPACT).select("path", "doc.cve", "doc.module", F.posexplode("doc.repos").alias("place", "r")).where("cve is not null and r.repo_id is not null")
    rows = r.select("cve", "module", "r.repo_id", "r.classification", "r.evidence_level", F.coalesce(F.col("r.needs_manual_trace").cast("int"), F.lit(0)).alias("needs_manual_trace"), F.col("path").alias("artifact"), "place")
    return last_per_key(rows, ["cve", "repo_id"], ["artifact", "place"]).drop("place")


def decisions_table(registers: DataFrame) -> DataFrame:
    r = parsed(registers, DECISIONS).select("path", "doc.register", F.posexplode("doc.decisions").alias("place", "d")).where("register is not null and d.decision_id is not null")
    rows = r.select("register", "d.decision_id", "d.title", "d.status", "d.repo", "d.pin", "path", "place")
    return last_per_key(rows, ["register", "decision_id"], ["path", "place"]).drop("place")


def graph_edges_table(graphs: DataFrame) -> DataFrame:
    """(from_id, to_id, rel) of every edge of graph documents, as often as it's stated."""
    return parsed(graphs, "edges array<map<string,string>>").select(F.explode("doc.edges").alias("e")).select(F.col("e")["from"].alias("from_id"), F.col("e")["to"].alias("to_id"), F.col("e")["rel"].alias("rel")).where("from_id is not null and to_id is not null and rel is not null")


def write(spark: SparkSession, path: str, tables: dict[str, DataFrame], meta: dict[str, str]) -> dict[str, int]:
    """Write a build of all tables; rows by table. The build before stays until the new one is named, then it's deleted."""
    root, name = path.rstrip("/"), f"build-{uuid.uuid4().hex}"
    counts = {}
    for t, df in tables.items():
        with shuffles_dropped(spark):
            df.write.parquet(f"{root}/{name}/{t}")
        counts[t] = spark.read.schema(df.schema).parquet(f"{root}/{name}/{t}").count()
    stamped = {"schema_revision": str(REVISION), "built_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), **meta}
    spark.createDataFrame(sorted(stamped.items()), "key string, value string").coalesce(1).write.parquet(f"{root}/{name}/meta")
    old = current(spark, root)
    number = 1 + max([int(n) for n in children(spark, f"{root}/_current")], default=0)
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.parquet(f"{root}/_current/{number:06}")
    if old:
        discard(spark, f"{root}/{old}")
    return counts


def current(spark: SparkSession, path: str) -> str | None:
    """Name of the newest build in a folder, None if there's none."""
    named = children(spark, f"{path.rstrip('/')}/_current")
    return spark.read.parquet(f"{path.rstrip('/')}/_current/{named[-1]}").first()[0] if named else None


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the newest build; an error if there's none or its revision is another."""
    build = current(spark, path)
    if build is None:
        raise FileNotFoundError(f"no projection in {path}")
    revision = spark.read.parquet(f"{path.rstrip('/')}/{build}/meta").where("key = 'schema_revision'").first()
    if revision is None or revision["value"] != str(REVISION):
        raise ValueError(f"projection of revision {revision and revision['value']}, not {REVISION}")
    return spark.read.parquet(f"{path.rstrip('/')}/{build}/{name}")


def records(spark: SparkSession, path: str, walk) -> tuple[DataFrame, str]:
    """(repos, `index` or `walk`): the index's repositories; where it's missing, old or lacks columns, what walk() finds, never an empty corpus."""
    try:
        found = read(spark, path, "repos")
        if {"repo_key", "tree", "base_slug", "preferred", "report_kind"} <= set(found.columns):
            return found, "index"
    except (FileNotFoundError, ValueError):
        pass
    return walk(), "walk"
