"""Scanners' outputs, manifests and sources, written from the findings and the graph, and read by the kernels; result files and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import scanners as sc
from quarryline.plans.registry import registry
from quarryline.plans.relational import FI, L, R, findings, links, repos
from quarryline.sources import readers, sinks
from quarryline.workspace import workspace

QUERIES, SQL, query = registry()
x = F.expr
_N = f"""{FI}, n AS (SELECT row_no, repo_key, finding_id, primary_cwe AS cwe, from_json(paths, '["VARCHAR"]')[1] AS path, title, severity, row_no % 50 + 1 AS a, row_no % 50 + 1 + row_no % 3 AS b FROM f WHERE paths IS NOT NULL AND len(from_json(paths, '["VARCHAR"]')) > 0 AND primary_cwe IS NOT NULL)"""


def placed(s, d):
    f = findings(s, d).where("paths is not null and primary_cwe is not null").withColumn("path", F.get(F.from_json("paths", "array<string>"), F.lit(0))).where("path is not null")
    return f.select("row_no", "repo_key", "finding_id", F.col("primary_cwe").alias("cwe"), "path", "title", "severity", x("row_no % 50 + 1").alias("a"), x("row_no % 50 + 1 + row_no % 3").alias("b"))


def _texts(df, element, wrap=None):
    """One output (repo_key, text) per repository: the elements as a JSON array, in an object if asked for."""
    listed = df.groupBy("repo_key").agg(F.collect_list(element).alias("v"))
    body = F.to_json("v") if wrap is None else F.to_json(F.struct(F.col("v").alias(wrap)))
    return listed.select("repo_key", body.alias("text"))


_LINES = "CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END"


@query(f"""WITH {_N} SELECT repo_key, 'semgrep' AS tool, cwe AS rule, CASE WHEN row_no % 3 = 0 THEN 'high' WHEN row_no % 3 = 1 THEN 'medium' ELSE 'low' END AS severity, path, {_LINES} AS lines, title AS message, NULL AS package, NULL AS version, NULL AS fixed FROM n
  UNION ALL SELECT repo_key, 'gitleaks', 'rule-' || cwe, 'high', path, {_LINES}, coalesce(title, '') || ' ' || substr(repo_key, 1, 5) || '...REDACTED', NULL, NULL, NULL FROM n
  UNION ALL SELECT repo_key, 'grype', 'V-' || cwe, coalesce(severity, 'low'), path, NULL, NULL, 'pkg-' || finding_id, '1.' || a, CASE WHEN row_no % 2 = 0 THEN '2.' || b END FROM n
  UNION ALL SELECT repo_key, 'yara', 'rule_' || row_no, 'high', path, NULL, NULL, NULL, NULL, NULL FROM n UNION ALL SELECT repo_key, 'calls', 'sym' || row_no, 'high', path, CAST(a AS VARCHAR), 'call()', NULL, NULL, NULL FROM n""")
def kernel_scanners(s, d):
    n = placed(s, d)
    no = F.col("row_no").cast("string")
    semgrep = sc.semgrep(_texts(n, F.struct(F.concat(F.lit("packs.v1."), "cwe").alias("check_id"), "path", F.struct(F.col("a").alias("line")).alias("start"), F.struct(F.col("b").alias("line")).alias("end"), F.struct(F.col("title").alias("message"), x("case row_no % 3 when 0 then 'ERROR' when 1 then 'WARNING' else 'INFO' end").alias("severity")).alias("extra")), "results"))
    gitleaks = sc.gitleaks(_texts(n, F.struct(F.concat(F.lit("rule-"), "cwe").alias("RuleID"), F.col("path").alias("File"), F.col("a").alias("StartLine"), F.col("b").alias("EndLine"), F.col("title").alias("Description"), F.col("repo_key").alias("Secret"))))
    grype = sc.grype(_texts(n, F.struct(
        F.struct(F.concat(F.lit("V-"), "cwe").alias("id"), F.initcap("severity").alias("severity"), F.struct(F.when(x("row_no % 2 = 0"), F.array(F.concat(F.lit("2."), F.col("b").cast("string")))).otherwise(F.array().cast("array<string>")).alias("versions")).alias("fix")).alias("vulnerability"),
        F.struct(F.concat(F.lit("pkg-"), "finding_id").alias("name"), F.concat(F.lit("1."), F.col("a").cast("string")).alias("version"), F.array(F.struct("path")).alias("locations")).alias("artifact"),
    ), "matches"))
    lines = lambda col: n.groupBy("repo_key").agg(F.array_join(F.collect_list(col), "\n").alias("text")).withColumn("text", F.concat(F.lit("0 warnings\n"), "text", F.lit("\n")))
    yara = sc.yara(lines(F.concat_ws(" ", F.concat(F.lit("rule_"), no), "path")))
    calls = sc.call_sites(lines(F.concat_ws("\t", F.concat(F.lit("sym"), no), "path", F.col("a").cast("string"), F.lit("call()"))))
    return semgrep.unionByName(gitleaks).unionByName(grype).unionByName(yara).unionByName(calls)


@query(f"""WITH {L}, u AS (SELECT src, dst, json_extract_string(attrs, '$.version') AS version FROM l WHERE rel = 'imports_package')
  SELECT src AS path, 'V-' || dst AS rule, CASE length(dst) % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS severity, dst AS package, version, CASE WHEN length(dst) % 2 = 0 THEN '9.0' END AS fixed FROM u""")
def kernel_osv(s, d):
    e = links(s, d).where("rel = 'imports_package'").select("src", "dst", F.get_json_object("attrs", "$.version").alias("version"))
    vid = F.concat(F.lit("V-"), "dst")
    events = F.array(F.struct(F.lit("0").alias("introduced"), F.lit(None).cast("string").alias("fixed")), F.struct(F.lit(None).cast("string").alias("introduced"), x("if(length(dst) % 2 = 0, '9.0', null)").alias("fixed")))
    other = F.struct(F.struct(F.lit("else").alias("name")).alias("package"), F.array(F.struct(F.array(F.struct(F.lit("0").alias("introduced"), F.lit("1").alias("fixed"))).alias("events"))).alias("ranges"))
    vuln = F.struct(vid.alias("id"), F.lit("s").alias("summary"), F.array(other, F.struct(F.struct(F.col("dst").alias("name")).alias("package"), F.array(F.struct(events.alias("events"))).alias("ranges"))).alias("affected"))
    package = F.struct(F.struct(F.col("dst").alias("name"), "version", F.lit("Go").alias("ecosystem")).alias("package"), F.array(F.struct(F.array(vid).alias("ids"), x("case length(dst) % 3 when 0 then 'Critical' when 1 then 'HIGHEST' else null end").alias("max_severity"))).alias("groups"), F.array(vuln).alias("vulnerabilities"))
    per = e.groupBy("src").agg(F.collect_list(package).alias("packages")).select(F.lit("all").alias("repo_key"), F.struct(F.struct(F.col("src").alias("path")).alias("source"), "packages").alias("r"))
    return sc.osv(_texts(per, F.col("r"), "results")).select("path", "rule", "severity", "package", "version", "fixed")


@query(f"""WITH {L}, u AS (SELECT src, dst, length(dst) % 3 AS k FROM l WHERE rel = 'depends_on') SELECT src AS repo_key, 'GO-' || dst AS advisory, CASE k WHEN 0 THEN 'symbol_reachable' WHEN 1 THEN 'package_imported_not_observed' ELSE 'module_required_not_observed' END AS level, CASE k WHEN 2 THEN dst ELSE dst || '/p' END AS package, CASE k WHEN 0 THEN 'f,main' ELSE '' END AS trace FROM u""")
def kernel_govulncheck(s, d):
    e = links(s, d).where("rel = 'depends_on'").withColumn("k", x("length(dst) % 3"))
    frame = F.struct(F.col("dst").alias("module"), F.lit("v1").alias("version"), x("if(k = 2, null, concat(dst, '/p'))").alias("package"), x("if(k = 0, 'f', null)").alias("function"))
    trace = F.when(F.col("k") == 0, F.array(frame, F.struct(F.lit("m").alias("module"), F.lit("v0").alias("version"), F.lit("m").alias("package"), F.lit("main").alias("function")))).otherwise(F.array(frame))
    value = F.to_json(F.struct(F.struct(F.concat(F.lit("GO-"), "dst").alias("osv"), F.lit("v2").alias("fixed_version"), trace.alias("trace")).alias("finding")))
    text = e.groupBy(F.col("src").alias("repo_key")).agg(F.concat(F.lit('{"config": {"scanner_name": "v"}}\n'), F.array_join(F.collect_list(value), ""), F.lit('\n{"osv": {"id": "GO-x"}} {"broken')).alias("text"))
    return sc.govulncheck(text).select("repo_key", "advisory", "level", "package", F.array_join("trace", ",").alias("trace"))


#: Conditions on row numbers -> checks of the test's deployments.
_DEP = {
    "KHS-W06": "row_no % 7 = 0", "KHS-W07": "row_no % 5 = 0", "KHS-W10": "row_no % 3 = 0", "KHS-W09": "row_no % 4 > 0", "KHS-W01": "row_no % 11 = 0", "KHS-W02": "row_no % 2 = 0", "KHS-W03": "row_no % 6 = 0", "KHS-W04": "row_no % 13 = 0", "KHS-W05": "row_no % 9 > 0",
    "KHS-W08": "row_no % 8 = 0", "KHS-W12": "row_no % 10 = 0", "KHS-W11": "row_no % 3 = 1", "KHS-W13": "row_no % 17 = 0", "KHS-A01": "row_no % 19 = 0",
}


@query(f"WITH {FI}, n AS (SELECT row_no, repo_key AS path FROM f) " + " UNION ALL ".join(f"SELECT path, 'Deployment' AS kind, 'd' || row_no AS name, '{c}' AS \"check\" FROM n WHERE {w}" for c, w in _DEP.items())
    + " UNION ALL SELECT path, 'ClusterRole', 'r' || row_no, 'KHS-R01' FROM n WHERE row_no % 4 = 0 UNION ALL SELECT path, 'ClusterRole', 'r' || row_no, 'KHS-R03' FROM n WHERE row_no % 6 = 0 UNION ALL SELECT path, 'ClusterRole', 'r' || row_no, 'KHS-R04' FROM n WHERE row_no % 9 = 0"
    + " UNION ALL SELECT path, 'ClusterRoleBinding', 'b' || row_no, 'KHS-R02' FROM n WHERE row_no % 21 = 0 UNION ALL SELECT path, 'Service', 's' || row_no, 'KHS-N01' FROM n WHERE row_no % 22 = 0 UNION ALL SELECT path, 'Namespace', 'n' || row_no, 'KHS-P01' FROM n WHERE row_no % 23 > 0"
    + " UNION ALL SELECT path, 'NetworkPolicy', 'p' || row_no, 'KHS-N03' FROM n WHERE row_no % 3 < 2 UNION ALL SELECT path, 'ValidatingWebhookConfiguration', 'w' || row_no, 'KHS-H01' FROM n WHERE row_no % 25 = 0")
def kernel_kubernetes(s, d):
    """Manifests of several documents each, whose faults depend on row numbers."""
    when = lambda c, yes, no="": F.when(x(c), F.lit(yes)).otherwise(F.lit(no))
    no = F.col("row_no").cast("string")
    cat = F.concat
    deployment = cat(
        F.lit('{"kind": "Deployment", "metadata": {"name": "d'), no, F.lit('"}, "spec": {"template": {"spec": {'), when(_DEP["KHS-W06"], '"hostPID": true, '), when(_DEP["KHS-W07"], '"volumes": [{"name": "v", "hostPath": {"path": "/x"}}, {"name": "w"}], '), when(_DEP["KHS-W10"], '"serviceAccountName": "default", ', '"serviceAccountName": "own", '),
        when(_DEP["KHS-W09"], '"automountServiceAccountToken": true, ', '"automountServiceAccountToken": false, '), when(_DEP["KHS-W12"], "", '"securityContext": {"seccompProfile": {"type": "RuntimeDefault"}}, '), F.lit('"containers": [{"name": "c", "securityContext": {'), when(_DEP["KHS-W01"], '"privileged": true, '),
        when(_DEP["KHS-W02"], "", '"allowPrivilegeEscalation": false, '), when(_DEP["KHS-W03"], "", '"runAsNonRoot": true, '), when(_DEP["KHS-W04"], '"capabilities": {"add": ["sys_admin", "CHOWN"]}, '), when(_DEP["KHS-W05"], '"readOnlyRootFilesystem": false}, ', '"readOnlyRootFilesystem": true}, '), when(_DEP["KHS-W08"], "", '"resources": {"limits": {"cpu": "1"}}, '),
        when(_DEP["KHS-W11"], '"image": "x:1", ', '"image": "x@sha256:00", '), when(_DEP["KHS-W13"], '"env": [{"name": "e", "valueFrom": {"secretKeyRef": {"name": "s"}}}], '), when(_DEP["KHS-A01"], '"args": ["--insecure-skip-tls-verify"]}]}}}}', '"args": ["--secure"]}]}}}}'),
    )
    role = cat(F.lit('kind: ClusterRole\nmetadata: {name: r'), no, F.lit("}\nrules:\n- apiGroups: ["), when("row_no % 4 = 0", "'*'", "apps"), F.lit("]\n  resources: ["), when("row_no % 6 = 0", "secrets", "pods"), F.lit("]\n  verbs: [get"), when("row_no % 9 = 0", ", bind"), F.lit("]"))
    binding = cat(F.lit("kind: ClusterRoleBinding\nmetadata: {name: b"), no, F.lit("}\nroleRef: {name: "), when("row_no % 21 = 0", "cluster-admin", "view"), F.lit("}"))
    service = cat(F.lit("kind: Service\nmetadata: {name: s"), no, F.lit("}\nspec: {type: "), when("row_no % 22 = 0", "NodePort", "ClusterIP"), F.lit("}"))
    namespace = cat(F.lit("kind: Namespace\nmetadata:\n  name: n"), no, F.lit("\n  labels: {"), when("row_no % 23 > 0", "", "pod-security.kubernetes.io/enforce: restricted"), F.lit("}"))
    policy = cat(F.lit("kind: NetworkPolicy\nmetadata: {name: p"), no, F.lit("}\nspec:\n  ingress:\n  - "), F.when(x("row_no % 3 = 0"), "{}").when(x("row_no % 3 = 1"), "from: [{ipBlock: {cidr: 0.0.0.0/0}}]").otherwise("from: [{podSelector: {}}]"))
    hook = cat(F.lit("kind: ValidatingWebhookConfiguration\nmetadata: {name: w"), no, F.lit("}\nwebhooks: [{name: a, failurePolicy: "), when("row_no % 25 = 0", "Ignore", "Fail"), F.lit("}]"))
    text = F.concat_ws("\n---\n", deployment, role, binding, service, namespace, policy, hook)
    # few bytes here become much text: a set number of tasks, since adaptive ones are made by bytes
    spread = findings(s, d).select("repo_key", "row_no").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "row_no")
    return sc.kubernetes(spread.select(F.col("repo_key").alias("path"), text.alias("text"))).select("path", "kind", "name", "check")


_FILES = f"""{_N}, fl AS (SELECT DISTINCT repo_key || '/' || path AS path, regexp_extract(path, '\\.([a-z]+)$', 1) AS ext FROM n)"""


def source_files(s, d):
    """Sources with uses of cryptography, by their language."""
    ext = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    text = F.when(ext == "go", 'package a\nimport (\n\t"crypto/md5"\n\t"crypto/tls"\n)\n').when(ext == "py", "import hashlib\nfrom cryptography import x\na = hashlib.sha1(b) + hashlib.md5(c)\n").when(ext == "java", 'x = Cipher.getInstance("AES/GCM");\n').when(ext == "ts", "crypto.createHash('sha256')\nrequire('left-pad')\n").otherwise("OPENSSL_FIPS=1\n")
    return placed(s, d).select("repo_key", F.concat_ws("/", "repo_key", "path").alias("path"), text.alias("text")).distinct()


@query(f"""WITH {_FILES} SELECT path, 'go-import' AS probe, 3 AS line, 'crypto/md5' AS detail FROM fl WHERE ext = 'go' UNION ALL SELECT path, 'go-import', 4, 'crypto/tls' FROM fl WHERE ext = 'go' UNION ALL SELECT path, 'python-import', 2, 'cryptography' FROM fl WHERE ext = 'py' UNION ALL SELECT path, 'python-hashlib', 3, 'sha1' FROM fl WHERE ext = 'py' UNION ALL SELECT path, 'python-hashlib', 3, 'md5' FROM fl WHERE ext = 'py'
  UNION ALL SELECT path, 'jdk-instance', 1, 'AES/GCM' FROM fl WHERE ext = 'java' UNION ALL SELECT path, 'node-create', 1, 'sha256' FROM fl WHERE ext = 'ts' UNION ALL SELECT path, 'env-policy', 1, 'OPENSSL_FIPS=1' FROM fl WHERE ext NOT IN ('go', 'py', 'java', 'ts')""")
def kernel_crypto(s, d):
    return sc.crypto_facts(source_files(s, d)).select("path", "probe", "line", "detail")


@query(f"""WITH {_FILES} SELECT path, CASE ext WHEN 'go' THEN 'go-stdlib' WHEN 'py' THEN 'python-package,python-stdlib' WHEN 'java' THEN 'jca' WHEN 'ts' THEN 'node-openssl' ELSE 'policy' END AS providers, CASE ext WHEN 'go' THEN 'crypto/md5,crypto/tls' WHEN 'py' THEN 'cryptography,md5,sha1' WHEN 'java' THEN 'AES/GCM' WHEN 'ts' THEN 'sha256' ELSE 'OPENSSL_FIPS=1' END AS details FROM fl""")
def agg_33_crypto_summary(s, d):
    return sc.summary(sc.crypto_facts(source_files(s, d)))


@query(f"""WITH {_N}, e AS (SELECT repo_key AS repo, regexp_extract(path, '\\.([a-z]+)$', 1) AS ext FROM n), p AS (SELECT * FROM (VALUES ('go', 'crypto/md5', true, false), ('py', 'cryptography', true, true), ('py', 'flask', false, false), ('ts', 'left-pad', true, false)) AS t(ext, package, imports, symbols)) SELECT DISTINCT repo, package, imports, symbols FROM e JOIN p USING (ext)""")
def kernel_source_use(s, d):
    packages = s.createDataFrame([("go", "crypto/md5", ["Sum("]), ("python", "cryptography", ["hashlib"]), ("python", "flask", ["Flask"]), ("javascript", "left-pad", [])], "language string, package string, symbols array<string>")
    return sc.source_use(source_files(s, d).withColumnRenamed("repo_key", "repo"), packages)


# ---- result files and reports

@query(f"""WITH {FI} SELECT repo_key, finding_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, CASE severity WHEN 'critical' THEN '9.5' WHEN 'high' THEN '8.0' WHEN 'medium' THEN '5.0' WHEN 'low' THEN '2.0' ELSE '0.5' END AS score, coalesce(primary_cwe, 'unknown') AS rule, from_json(paths, '["VARCHAR"]')[1] AS uri FROM f""")
def snk_10_job_24_sarif(s, d):
    """Result documents, read back: rule, level, score and first place of every finding."""
    docs = sinks.sarif(findings(s, d), "quarryline", 200)
    schema = "runs array<struct<results:array<struct<ruleId:string,level:string,properties:map<string,string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>>>>"
    r = docs.select("repo_key", F.explode(F.get(F.from_json("document", schema)["runs"], F.lit(0))["results"]).alias("r"))
    p = F.col("r.properties")
    return r.select("repo_key", p["finding"].alias("finding_id"), "r.level", p["security-severity"].alias("score"), F.col("r.ruleId").alias("rule"), F.get("r.locations", F.lit(0))["physicalLocation"]["artifactLocation"]["uri"].alias("uri"))


@query(f"""WITH {R}, {FI}, g AS (SELECT repo_key, severity, count(*) AS n FROM f GROUP BY 1, 2), k AS (SELECT repo_key, string_agg('| ' || coalesce(severity, '-') || ' | ' || n || ' |', chr(10) ORDER BY coalesce(severity, '-')) AS rows, sum(n) AS total FROM g GROUP BY 1)
  SELECT repo_key, '# ' || replace(repo_key, '|', '\\|') || chr(10) || chr(10) || total || ' findings' || chr(10) || chr(10) || '| Severity | Findings |' || chr(10) || '|---|---|' || chr(10) || rows || chr(10) AS document FROM k""")
def snk_11_markdown(s, d):
    return sinks.markdown_summary(findings(s, d))


@query(f"WITH {R}, k AS (SELECT DISTINCT report_path FROM r WHERE report_path IS NOT NULL), v AS (SELECT report_path, regexp_extract(report_path, '^(.*)/[^/]*$', 1) AS subject, sha256(report_path || '!') AS digest, CASE WHEN report_path LIKE '%findings-current%' THEN 'current' WHEN report_path LIKE '%-security-audit%' THEN 'audit' ELSE 'other' END AS family FROM k) SELECT report_path AS path, family, subject, 'objects/' || substr(digest, 1, 2) || '/' || digest AS object, CASE WHEN length(report_path) % 4 = 0 THEN 'present' ELSE 'new' END AS status FROM v")
def snk_09_ingest(s, d):
    """Files filed under the digest of their content, with what they are and whether the store has them already."""
    files = repos(s, d).where("report_path is not null").select(F.col("report_path").alias("path"), F.encode(F.concat("report_path", F.lit("!")), "utf-8").alias("content")).distinct()
    have = files.where("length(path) % 4 = 0").select(F.sha2("content", 256).alias("digest"))
    return sinks.ingest_plan(files, have, {"findings-current": "current", "-security-audit": "audit"}).select("path", "family", "subject", "object", "status")


@query("SELECT producer, dataset, file_name, count(*) AS n FROM (SELECT *, json_valid(body) AS ok FROM raw_records) WHERE ok GROUP BY 1, 2, 3")
def src_05_json_lines(s, d):
    """Raw records written as files of lines and read back: valid objects by file."""
    from quarryline.workspace import table

    path = f"{workspace(s)}/lines"
    table(s, d, "raw_records").select("producer", "dataset", "file_name", "line_no", "body").repartition("file_name").sortWithinPartitions("file_name", "line_no").select(F.to_json(F.struct("producer", "dataset", "file_name", "body")).alias("value")).write.text(path)
    doc = readers.json_lines(s, path, "producer string, dataset string, file_name string, body string").select("doc.*")
    return doc.where(F.try_parse_json("body").isNotNull()).groupBy("producer", "dataset", "file_name").agg(F.count("*").alias("n"))


@query(f"WITH {R}, k AS (SELECT repo_key, row_no, tree FROM r), x AS (SELECT repo_key AS repo, 'go' AS language, row_no * 10 AS bytes FROM k UNION ALL SELECT repo_key, tree, row_no FROM k) SELECT * FROM x WHERE bytes > 0")
def src_13_languages(s, d):
    path = f"{workspace(s)}/languages"
    repos(s, d).select(F.to_json(F.struct(F.col("repo_key").alias("repo"), F.create_map(F.lit("go"), x("row_no * 10"), F.col("tree"), F.col("row_no")).alias("languages"))).alias("value")).write.text(path)
    return readers.language_cache(s, path).where("bytes > 0")


@query(f"WITH {R} SELECT 'r-' || row_no AS rule, 'CWE-' || (row_no % 90) AS cwe, lang AS language FROM r, (VALUES ('go'), ('python')) AS v(lang)")
def src_17_rule_packs(s, d):
    """Rule packs as YAML files, read into rows of rule, weakness and language."""
    one = F.concat(F.lit("- id: r-"), F.col("row_no").cast("string"), F.lit("\n  languages: [go, python]\n  metadata: {cwe: ['CWE-"), x("row_no % 90").cast("string"), F.lit(": text']}"))
    packs = repos(s, d).groupBy("tree").agg(F.concat(F.lit("rules:\n"), F.array_join(F.collect_list(one), "\n")).alias("text"))
    return readers.rule_packs(packs.select(F.concat("tree", F.lit(".yaml")).alias("path"), "text")).select("rule", "cwe", "language")
