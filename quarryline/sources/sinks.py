"""Writers: result files for other tools, pages, plans of what to file, a chained journal."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.functions.kernels import row_sha
from quarryline.operators.relational import with_last
from quarryline.workspace import children

def sarif(findings: DataFrame, tool: str, results_per_document: int = 5_000) -> DataFrame:
    """(repo_key, part, document): SARIF 2.1.0 documents made of nested columns; order within one is by finding_id.

    A repository with more results than that is spread over parts by a hash, so that no task gathers a large
    repository's findings. A NULL repo_key is a repository of its own; no findings give no documents.
    """
    sizes = findings.groupBy("repo_key").agg(F.ceil(F.count(F.lit(1)) / results_per_document).cast("int").alias("parts")).withColumnRenamed("repo_key", "__key")
    findings = findings.join(sizes, F.col("repo_key").eqNullSafe(F.col("__key"))).withColumn("part", F.pmod(F.xxhash64("finding_id"), F.col("parts")).cast("int")).drop("__key", "parts")
    rated = lambda i: fx.mapped(F.col("severity"), {k: v[i] for k, v in fx.SARIF_LEVELS.items()}, fx.SARIF_LEVELS["informational"][i])
    place = F.transform(F.from_json("paths", "array<string>"), lambda p: F.struct(F.struct(F.struct(p.alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    result = F.struct(F.col("finding_id"), F.struct(F.coalesce("primary_cwe", F.lit("unknown")).alias("ruleId"), rated(0).alias("level"), F.struct(F.col("title").alias("text")).alias("message"), place.alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"), F.struct(rated(1).alias("security-severity"), F.col("finding_id").alias("finding")).alias("properties")).alias("r"))
    results = F.transform(F.array_sort(F.collect_list(result)), lambda x: x["r"])
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool"), results.alias("results"))
    document = F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs")), {"ignoreNullFields": "true"})
    return findings.groupBy("repo_key", "part").agg(document.alias("document"))


def ingest_plan(files: DataFrame, stored: DataFrame, families: dict[str, str]) -> DataFrame:
    """(path, family, subject, digest, object, status) of files (path, content) to be filed under the digest of their content.

    family: of the first part of a name that the path holds, else `other`; subject: the folder; status: `present` if
    the digest is stored already, `copy` if a file with a smaller path has the same content, else `new`.
    """
    family = F.lit("other")
    for part, name in reversed(families.items()):
        family = F.when(F.contains(F.col("path"), F.lit(part)), name).otherwise(family)
    named = files.select("path", family.alias("family"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("subject"), F.sha2("content", 256).alias("digest"))
    first = named.groupBy("digest").agg(F.min("path").alias("__first"))
    known = stored.select("digest").distinct().withColumn("__there", F.lit(True))
    status = F.when(F.col("__there"), "present").when(F.col("path") != F.col("__first"), "copy").otherwise("new")
    return named.join(first, "digest").join(known, "digest", "left").select("path", "family", "subject", "digest", F.concat(F.lit("objects/"), F.substring("digest", 1, 2), F.lit("/"), "digest").alias("object"), status.alias("status"))


def markdown_summary(findings: DataFrame) -> DataFrame:
    """(repo_key, document): a Markdown page for each repository with its number of findings by severity; a missing one is ``-``."""
    counted = findings.groupBy("repo_key", F.coalesce("severity", F.lit("-")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    row = F.concat(F.lit("| "), fx.md_cell(F.col("severity")), F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    pages = counted.groupBy("repo_key").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"), F.sum("n").alias("total"))
    head = F.concat(F.lit("# "), fx.md_cell(F.col("repo_key")), F.lit("\n\n"), F.col("total").cast("string"), F.lit(" findings\n\n| Severity | Findings |\n|---|---|\n"))
    return pages.select("repo_key", F.concat(head, "rows", F.lit("\n")).alias("document"))


def append_journal(spark: SparkSession, path: str, source: str, metrics: dict, at: str, only_changes: bool = False) -> bool:
    """Append one chained row to a journal, a folder with a file per row; False if nothing changed since the source's last row.

    The file's name is the row's number and it's created only if it isn't there, so of two writers at once one fails
    and no row is lost. Metrics that are None are left out.
    """
    rows = journal_rows(spark, path)
    names = children(spark, path)
    last = rows.orderBy(F.desc("line_no")).first()
    before = rows.where(F.col("source") == source).orderBy(F.desc("line_no")).first()
    kept = {k: v for k, v in metrics.items() if v is not None}
    if only_changes and before and json.loads(before["metrics"]) == kept:
        return False
    row = {"snapshot_at": at, "source": source, "metrics": kept, "prev_sha": last["row_sha"] if last else ""}
    row["row_sha"] = row_sha(row)
    number = 1 + max((int(n[:12]) for n in names if n[:12].isdigit()), default=0)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{number:012}.json")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray((json.dumps(row, ensure_ascii=True) + "\n").encode()))
    finally:
        out.close()
    return True


def journal_rows(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, snapshot_at, source, metrics as JSON, prev_sha, row_sha) of a journal; files that aren't JSON are left out."""
    schema = "snapshot_at string, source string, metrics string, prev_sha string, row_sha string"
    if not any(n.endswith(".json") for n in children(spark, path)):
        return spark.createDataFrame([], f"line_no bigint, {schema}")
    lines = spark.read.text(path, pathGlobFilter="*.json").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("bigint").alias("line_no"), F.from_json("value", schema).alias("d"))
    return lines.where("d.row_sha is not null").select("line_no", "d.*")


def broken_links(journal: DataFrame) -> DataFrame:
    """Rows (line_no, prev_sha, row_sha) whose prev_sha isn't the row_sha of the row before; the first must have an empty one.

    The chain has one order over all rows; it's walked by ranges, of which only the last hash is carried on.
    """
    known = with_last(journal.select("line_no", "prev_sha", "row_sha"), [], ["line_no"], {"before": F.col("row_sha")}, inclusive=False)
    return known.where(~F.col("prev_sha").eqNullSafe(F.coalesce("before", F.lit("")))).drop("before")
