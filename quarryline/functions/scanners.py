"""Scanners' outputs as rows, Kubernetes manifests against a catalogue of checks, and probes for cryptography: rules are data."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions import text as fx

FINDING = "tool string, rule string, severity string, path string, lines string, message string, package string, version string, fixed string"


def _finding(**cols: Column) -> list[Column]:
    return [cols.get(name, F.lit(None)).cast("string").alias(name) for name in (c.split()[0] for c in FINDING.split(", "))]


def _doc(outputs: DataFrame, schema: str) -> tuple[DataFrame, list[Column]]:
    keep = [c for c in outputs.columns if c != "text"]
    return outputs.select(*keep, F.from_json("text", schema).alias("doc")), [F.col(c) for c in keep]


def semgrep(outputs: DataFrame) -> DataFrame:
    """Results of a pattern scanner (and text, JSON): bare rule id, severity word, place, message."""
    doc, keep = _doc(outputs, "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string>>>")
    r = F.col("r")
    words = {"ERROR": "high", "WARNING": "medium", "INFO": "low"}
    return doc.select(*keep, F.explode("doc.results").alias("r")).select(*keep, *_finding(tool=F.lit("semgrep"), rule=fx.bare_rule_id(r["check_id"]), severity=fx.mapped(r["extra"]["severity"], words, "low"), path=r["path"], lines=fx.written_range(r["start"]["line"], r["end"]["line"]), message=r["extra"]["message"]))


def gitleaks(outputs: DataFrame) -> DataFrame:
    """Secrets found: the secret itself never comes out, only the first five characters."""
    keep = [F.col(c) for c in outputs.columns if c != "text"]
    doc = outputs.select(*keep, F.explode(F.from_json("text", "array<struct<RuleID:string,File:string,StartLine:int,EndLine:int,Description:string,Secret:string>>")).alias("r")).where("r.RuleID is not null")
    r = F.col("r")
    masked = F.concat(F.coalesce(r["Description"], F.lit("")), F.lit(" "), F.substring(F.coalesce(r["Secret"], F.lit("")), 1, 5), F.lit("...REDACTED"))
    return doc.select(*keep, *_finding(tool=F.lit("gitleaks"), rule=r["RuleID"], severity=F.lit("high"), path=r["File"], lines=fx.written_range(r["StartLine"], r["EndLine"]), message=masked))


def fixed_version(affected: Column, name: Column) -> Column:
    """First ``fixed`` event of the advisory's ranges for a package."""
    own = F.filter(affected, lambda a: a["package"]["name"] == name)
    events = F.flatten(F.transform(own, lambda a: F.flatten(F.transform(a["ranges"], lambda r: r["events"]))))
    return F.get(F.filter(F.transform(events, lambda e: e["fixed"]), lambda v: v.isNotNull()), F.lit(0))


def osv(outputs: DataFrame) -> DataFrame:
    """One row for each advisory, package and source file of an advisory scanner."""
    schema = (
        "results array<struct<source:struct<path:string>,packages array<struct<package:struct<name:string,version:string,ecosystem:string>,groups:array<struct<ids:array<string>,max_severity:string>>,"
        "vulnerabilities:array<struct<id:string,summary:string,affected:array<struct<package:struct<name:string>,ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>>>>>>>"
    ).replace("packages array<", "packages:array<")
    doc, keep = _doc(outputs, schema)
    p = doc.select(*keep, F.explode("doc.results").alias("s")).select(*keep, F.col("s.source.path").alias("file"), F.explode("s.packages").alias("p"))
    v = p.select(*keep, "file", "p", F.explode("p.vulnerabilities").alias("v")).where("v.id is not null")
    group = F.get(F.filter("p.groups", lambda g: F.array_contains(g["ids"], F.col("v.id"))), F.lit(0))["max_severity"]
    return v.select(*keep, *_finding(tool=F.lit("osv"), rule=F.col("v.id"), severity=fx.mapped(F.upper(group), fx.ADVISORY_WORDS, "medium"), path=F.col("file"), message=F.col("v.summary"), package=F.col("p.package.name"), version=F.col("p.package.version"), fixed=fixed_version(F.col("v.affected"), F.col("p.package.name"))))


def grype(outputs: DataFrame) -> DataFrame:
    doc, keep = _doc(outputs, "matches array<struct<vulnerability:struct<id:string,severity:string,fix:struct<versions:array<string>>>,artifact:struct<name:string,version:string,locations:array<struct<path:string>>>>>")
    m = F.col("m")
    return doc.select(*keep, F.explode("doc.matches").alias("m")).select(*keep, *_finding(tool=F.lit("grype"), rule=m["vulnerability"]["id"], severity=fx.mapped(F.lower(m["vulnerability"]["severity"]), fx.HINTS, "low"), path=F.get(m["artifact"]["locations"], F.lit(0))["path"], package=m["artifact"]["name"], version=m["artifact"]["version"], fixed=F.get(m["vulnerability"]["fix"]["versions"], F.lit(0))))


def yara(outputs: DataFrame) -> DataFrame:
    """Matches written as lines ``rule path``; other lines are left out."""
    keep = [F.col(c) for c in outputs.columns if c != "text"]
    lines = outputs.select(*keep, F.explode(F.split("text", r"\r?\n")).alias("t")).where(F.col("t").rlike(r"^[A-Za-z_]\w*\s+\S"))
    return lines.select(*keep, *_finding(tool=F.lit("yara"), rule=F.regexp_extract("t", r"^(\w+)", 1), severity=F.lit("high"), path=F.regexp_extract("t", r"^\w+\s+(?:\[[^\]]*\]\s+)?(.*?)\s*$", 1)))


def call_sites(outputs: DataFrame) -> DataFrame:
    """Call sites written as lines of tabs: symbol, file, line, code; lines of fewer parts are left out."""
    keep = [F.col(c) for c in outputs.columns if c != "text"]
    cell = F.split("t", "\t")
    lines = outputs.select(*keep, F.explode(F.split("text", r"\r?\n")).alias("t")).where(F.size(cell) >= 3)
    return lines.select(*keep, *_finding(tool=F.lit("calls"), rule=F.get(cell, F.lit(0)), severity=F.lit("high"), path=F.get(cell, F.lit(1)), lines=F.get(cell, F.lit(2)), message=F.get(cell, F.lit(3))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_stream(text: pd.Series) -> pd.Series:
    """The JSON values that stand one after the other in a text, each as text; what can't be read ends it."""
    def split(t: str | None) -> list[str]:
        out, at, decoder = [], 0, json.JSONDecoder()
        t = t or ""
        while at < len(t):
            if t[at].isspace():
                at += 1
                continue
            try:
                _, end = decoder.raw_decode(t, at)
            except ValueError:
                break
            out.append(t[at:end])
            at = end
        return out

    return text.map(split)


def govulncheck(outputs: DataFrame) -> DataFrame:
    """(…, advisory, level, package, fixed, trace) of each finding in a stream of JSON values: how far along the call chain it was seen."""
    keep = [F.col(c) for c in outputs.columns if c != "text"]
    schema = "finding struct<osv:string,fixed_version:string,trace:array<struct<module:string,version:string,package:string,function:string>>>"
    f = outputs.select(*keep, F.explode(json_stream("text")).alias("t")).select(*keep, F.from_json("t", schema)["finding"].alias("f")).where("f.osv is not null")
    first = F.get("f.trace", F.lit(0))
    level = F.when(first["function"].isNotNull(), "symbol_reachable").when(first["package"].isNotNull(), "package_imported_not_observed").otherwise("module_required_not_observed")
    trace = F.filter(F.transform("f.trace", lambda s: s["function"]), lambda v: v.isNotNull())
    return f.select(*keep, F.col("f.osv").alias("advisory"), level.alias("level"), F.coalesce(first["package"], first["module"]).alias("package"), F.col("f.fixed_version").alias("fixed"), trace.alias("trace"))


# ---- Kubernetes manifests

#: Checks: title and severity; capabilities, verbs and arguments that they look for; fixed values.
CHECKS = {
    "KHS-W01": ("Privileged container", "high"), "KHS-W02": ("allowPrivilegeEscalation not disabled", "medium"), "KHS-W03": ("Container may run as root", "medium"), "KHS-W04": ("Dangerous capability added", "high"), "KHS-W05": ("Root filesystem not read-only", "low"),
    "KHS-W06": ("Host namespace sharing enabled", "high"), "KHS-W07": ("hostPath volume mounted", "medium"), "KHS-W08": ("Missing resource limits", "low"), "KHS-W09": ("ServiceAccount token automounted", "low"), "KHS-W10": ("Default ServiceAccount used", "low"),
    "KHS-W11": ("Image not pinned by digest", "low"), "KHS-W12": ("No seccomp profile", "low"), "KHS-W13": ("Secret exposed via environment variable", "medium"), "KHS-R01": ("Wildcard in RBAC rule", "high"), "KHS-R02": ("Binding to cluster-admin", "high"),
    "KHS-R03": ("Read access to secrets", "medium"), "KHS-R04": ("Privilege-escalation verb granted", "high"), "KHS-N01": ("Service exposed via NodePort/LoadBalancer", "medium"), "KHS-N03": ("NetworkPolicy allows all traffic (permissive)", "medium"),
    "KHS-H01": ("Webhook failurePolicy Ignore", "medium"), "KHS-P01": ("Namespace without PSA enforce label", "low"), "KHS-A01": ("Insecure flag in container args", "high"),
}
CAPABILITIES = ("ALL", "SYS_ADMIN", "NET_ADMIN", "SYS_PTRACE", "SYS_MODULE", "DAC_READ_SEARCH", "NET_RAW", "BPF")
ESCALATION = ("escalate", "bind", "impersonate")
INSECURE = r"--?(?:insecure[\w-]*|anonymous-auth=true|authorization-mode=AlwaysAllow|skip-tls-verify[\w=-]*)"
_CONTEXT = "privileged:boolean,allowPrivilegeEscalation:boolean,runAsNonRoot:boolean,runAsUser:bigint,readOnlyRootFilesystem:boolean,capabilities:struct<add:array<string>>,seccompProfile:map<string,string>"
_CONTAINER = f"struct<name:string,image:string,args:array<string>,command:array<string>,securityContext:struct<{_CONTEXT}>,resources:struct<limits:map<string,string>>,env:array<struct<name:string,valueFrom:struct<secretKeyRef:map<string,string>>>>,envFrom:array<struct<secretRef:map<string,string>>>>"
_POD = f"struct<hostNetwork:boolean,hostPID:boolean,hostIPC:boolean,serviceAccountName:string,automountServiceAccountToken:boolean,volumes:array<struct<name:string,hostPath:struct<path:string>>>,securityContext:struct<{_CONTEXT}>,containers:array<{_CONTAINER}>,initContainers:array<{_CONTAINER}>>"
MANIFEST = "kind string, metadata struct<name:string,labels:map<string,string>>, rules array<struct<verbs:array<string>,resources:array<string>,apiGroups:array<string>>>, roleRef struct<name:string>, webhooks array<struct<name:string,failurePolicy:string>>"
#: Where a workload of a kind keeps its pod.
PODS = {"Pod": "$.spec", "CronJob": "$.spec.jobTemplate.spec.template.spec", **dict.fromkeys(("Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Job"), "$.spec.template.spec")}


def _exact(text: str):
    raise ValueError(text)


def _yaml_parts(text: str) -> list[str]:
    """A YAML text cut at its lines ``---``; the whole text where other marks stand at the start of a line, or characters that YAML may take as line breaks."""
    if not text.isascii() or "\r" in text:
        return [text]
    marks = re.findall(r"^(?:---|\.\.\.|%).*", text, re.MULTILINE)
    return re.split(r"^---\n", text, flags=re.MULTILINE) if all(m == "---" for m in marks) else [text]


def _yaml_reader():
    """text -> its documents; ImportError without a YAML package."""
    import yaml

    # JSON that YAML may read otherwise (exponents, NaN) is an error for this decoder
    decoder = json.JSONDecoder(parse_float=lambda v: _exact(v) if "e" in v.lower() else float(v), parse_constant=_exact)

    def load(text: str) -> list:
        try:
            return list(yaml.load_all(text, Loader=fast))
        except yaml.YAMLError:
            if fast is yaml.SafeLoader:
                raise
            return list(yaml.safe_load_all(text))

    def read(text: str) -> list:
        out = []
        for part in _yaml_parts(text):
            # JSON objects, which are most of what is generated, needn't go through YAML
            if part.startswith("{") and part.isascii() and not any(c in part for c in "\\\t\x7f"):
                try:
                    out.append(decoder.decode(part.rstrip()))
                    continue
                except ValueError:
                    pass
            out += load(part)
        return out

    fast = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    return read


@F.pandas_udf(T.ArrayType(T.StringType()))
def yaml_documents(text: pd.Series) -> pd.Series:
    """The documents of a YAML text as JSON texts; a text that can't be read has none. Without a YAML package only JSON is read."""
    try:
        load = _yaml_reader()
    except ImportError:
        load = lambda t: [json.loads(t)]

    def split(t: str | None) -> list[str]:
        try:
            return [json.dumps(d, default=str) for d in load(t or "") if isinstance(d, dict)]
        except Exception:  # noqa: BLE001  a broken manifest has no documents
            return []

    return text.map(split)


def kubernetes(files: DataFrame) -> DataFrame:
    """(path, kind, name, check, severity, detail) of files (path, text) of manifests, one row for each hit.

    All checks of a document are made at once, so that each file is read and parsed once.
    """
    docs = files.select("path", F.explode(yaml_documents("text")).alias("json")).select("path", "json", F.from_json("json", MANIFEST).alias("d")).where("d.kind is not null")
    head = docs.select("path", "json", F.col("d.kind").alias("kind"), F.coalesce("d.metadata.name", F.lit("?")).alias("name"), "d")
    false, true = (lambda c: F.coalesce(~c, F.lit(False))), (lambda c: F.coalesce(c, F.lit(False)))
    hit = lambda check, wrong, detail: F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(check).alias("check"), F.lit(CHECKS[check][1]).alias("severity"), detail.cast("string").alias("detail")))
    of_each = lambda items, hits: F.coalesce(F.flatten(F.transform(items, lambda i: F.array(*hits(i)))), F.array().cast("array<struct<check:string,severity:string,detail:string>>"))
    place = F.create_map(*[F.lit(x) for p in PODS.items() for x in p])[F.col("kind")]
    pod_json = None
    for p in dict.fromkeys(PODS.values()):
        part = F.when(place == p, F.get_json_object("json", p))
        pod_json = part if pod_json is None else F.coalesce(pod_json, part)
    rule = "array<map<string,string>>"
    kind_is = lambda *names: F.col("kind").isin(*names)
    ways = {way: F.from_json(F.when(kind_is("NetworkPolicy", "MultiNetworkPolicy"), F.get_json_object("json", f"$.spec.{way}")), rule) for way in ("ingress", "egress")}
    head = head.select("path", "kind", "name", "d", F.from_json(pod_json, _POD).alias("pod"), F.when(kind_is("Service"), F.get_json_object("json", "$.spec.type")).alias("service"), *[c.alias(way) for way, c in ways.items()])
    p = F.col("pod")
    pods = of_each(F.when(p.isNotNull(), F.array(p)), lambda p: [
        *[hit("KHS-W06", p[f], F.lit(f"{f}: true")) for f in ("hostNetwork", "hostPID", "hostIPC")],
        hit("KHS-W10", F.coalesce(p["serviceAccountName"], F.lit("")).isin("", "default"), F.lit("serviceAccountName")), hit("KHS-W09", ~false(p["automountServiceAccountToken"]), F.lit("automountServiceAccountToken")),
    ])
    volumes = of_each("pod.volumes", lambda v: [hit("KHS-W07", v["hostPath"].isNotNull(), v["name"])])
    ps = p["securityContext"]

    def of_container(c: Column) -> list[Column]:
        s, n = c["securityContext"], F.coalesce(c["name"], F.lit("?"))
        args = F.concat(F.coalesce(c["args"], F.array().cast("array<string>")), F.coalesce(c["command"], F.array().cast("array<string>")))
        risky = F.array_intersect(F.transform(s["capabilities"]["add"], F.upper), F.array(*map(F.lit, CAPABILITIES)))
        secret_env = F.coalesce(F.exists(c["env"], lambda e: F.coalesce(e["valueFrom"]["secretKeyRef"].isNotNull(), F.lit(False))), F.lit(False)) | F.coalesce(F.exists(c["envFrom"], lambda e: e["secretRef"].isNotNull()), F.lit(False))
        return [
            hit("KHS-W01", s["privileged"], n), hit("KHS-W02", ~false(s["allowPrivilegeEscalation"]), n), hit("KHS-W03", ~true(F.coalesce(s["runAsNonRoot"], ps["runAsNonRoot"])) & (F.coalesce(s["runAsUser"], ps["runAsUser"], F.lit(0)) == 0), n),
            hit("KHS-W04", F.size(risky) > 0, F.concat_ws(" ", n, F.array_join(F.array_sort(risky), ","))), hit("KHS-W05", ~true(s["readOnlyRootFilesystem"]), n), hit("KHS-W08", F.coalesce(F.size(c["resources"]["limits"]), F.lit(0)) <= 0, n),
            hit("KHS-W12", s["seccompProfile"].isNull() & ps["seccompProfile"].isNull(), n), hit("KHS-W11", (c["image"] != "") & ~F.contains(c["image"], F.lit("@sha256:")), F.concat_ws(" ", n, c["image"])), hit("KHS-W13", secret_env, n),
            hit("KHS-A01", F.exists(args, lambda a: a.rlike(INSECURE)), n),
        ]

    inside = [of_each(f"pod.{c}", of_container) for c in ("containers", "initContainers")]
    has = lambda r, f, *v: F.coalesce(F.arrays_overlap(r[f], F.array(*map(F.lit, v))), F.lit(False))
    roles = of_each(F.when(kind_is("Role", "ClusterRole"), F.col("d.rules")), lambda r: [
        hit("KHS-R01", has(r, "verbs", "*") | has(r, "resources", "*") | has(r, "apiGroups", "*"), F.array_join(r["resources"], ",")), hit("KHS-R03", has(r, "resources", "secrets") & has(r, "verbs", "get", "list", "watch", "*"), F.array_join(r["verbs"], ",")),
        hit("KHS-R04", has(r, "verbs", *ESCALATION), F.array_join(r["verbs"], ",")),
    ])
    label = F.col("d.metadata.labels")["pod-security.kubernetes.io/enforce"]
    whole = F.array(
        hit("KHS-R02", kind_is("RoleBinding", "ClusterRoleBinding") & (F.col("d.roleRef.name") == "cluster-admin"), F.lit("cluster-admin")), hit("KHS-N01", F.col("service").isin("NodePort", "LoadBalancer"), F.col("service")), hit("KHS-P01", kind_is("Namespace") & label.isNull(), F.lit("enforce")),
        hit("KHS-H01", F.exists("d.webhooks", lambda w: w["failurePolicy"] == "Ignore"), F.lit("failurePolicy")),
    )

    def of_policy(r: Column, way: str, peer: str) -> list[Column]:
        peers = F.try_element_at(r, F.lit(peer))
        wide = peers.rlike(r'"namespaceSelector":\s*\{\}') & ~peers.contains('"podSelector"') | peers.rlike(r'"cidr":\s*"(?:0\.0\.0\.0/0|::/0)"')
        return [hit("KHS-N03", (F.size(r) == 0) | ~F.map_contains_key(r, F.lit(peer)) | F.coalesce(wide, F.lit(False)), F.lit(way))]

    policies = [of_each(way, lambda r, w=way, p=peer: of_policy(r, w, p)) for way, peer in (("ingress", "from"), ("egress", "to"))]
    hits = F.array_compact(F.concat(pods, volumes, *inside, roles, whole, *policies))
    return head.select("path", "kind", "name", F.explode(hits).alias("h")).select("path", "kind", "name", "h.*")


# ---- cryptography

#: Probes: id, files by name, pattern with the algorithm as its group, provider; fixed values.
PROBES = [
    ("go-import", r"\.go$", r'"(crypto/(?:md5|sha1|des|rc4|rsa|ecdsa|ed25519|tls|aes|sha256|sha512))"', "go-stdlib"), ("go-boring", r"\.go$", r"(GOEXPERIMENT=boringcrypto|boring\.Enabled)", "boringcrypto"), ("python-hashlib", r"\.py$", r"\bhashlib\.(md5|sha1|sha224|sha256|sha384|sha512|blake2b)\b", "python-stdlib"),
    ("python-import", r"\.py$", r"^\s*(?:from|import)\s+(cryptography|Crypto|nacl|OpenSSL|M2Crypto)\b", "python-package"), ("node-create", r"\.[jt]sx?$", r"crypto\.create(?:Hash|Hmac|Cipheriv)\(\s*['\"]([A-Za-z0-9-]+)", "node-openssl"), ("jdk-instance", r"\.java$", r"(?:MessageDigest|Cipher|Signature|Mac)\.getInstance\(\s*\"([^\"]+)\"", "jca"),
    ("rust-crate", r"(^|/)Cargo\.toml$", r"^\s*(ring|rustls|openssl|sha2|sha1|md5|aes)\s*=", "rust-crate"), ("c-evp", r"\.(?:c|cc|cpp|h)$", r"\b(EVP_(?:md5|sha1|sha256|sha512|aes_\w+|des_\w+))\b", "openssl"), ("dotnet-create", r"\.cs$", r"\b(MD5|SHA1|SHA256|SHA512|Aes|DES|RSA)\.Create\(", "dotnet"),
    ("ruby-digest", r"\.rb$", r"\b(?:OpenSSL::)?Digest(?:::|\.new\(['\"])(MD5|SHA1|SHA256|SHA512)", "ruby-openssl"), ("image-base", r"(^|/)(?:Dockerfile|Containerfile)", r"(?i)^FROM\s+(\S*(?:ubi|alpine|debian|distroless|scratch)\S*)", "base-image"), ("env-policy", r"", r"\b(OPENSSL_FIPS=1|GODEBUG=fips140=\w+|crypto-policies --set \S+)", "policy"),
]


def crypto_facts(files: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """(path, probe, line, detail, provider) of every place in files (path, text) where a probe's pattern hits.

    Probes (probe, files, pattern, provider) are a small table that people write; a line is looked at by the probes of its file's name only.
    """
    spark = files.sparkSession
    rules = spark.createDataFrame(PROBES, "probe string, files string, pattern string, provider string") if probes is None else probes
    asked = files.join(F.broadcast(rules), F.regexp_like("path", F.col("files")))
    lines = asked.select("path", "probe", "provider", "pattern", F.posexplode(F.split("text", r"\r?\n")).alias("at", "t")).where(F.regexp_like("t", F.col("pattern")))
    return lines.select("path", "probe", (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all("t", F.col("pattern"), F.lit(1))).alias("detail"), "provider")


def summary(found: DataFrame) -> DataFrame:
    """(path, providers, details): sorted distinct providers and details of each file, joined by commas."""
    return found.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"), F.array_join(F.array_sort(F.collect_set("detail")), ",").alias("details"))


# ---- use of a vulnerable package in source

#: How a language imports a package: name of the files, pattern with the name for {0}; fixed values.
IMPORTS = {"go": (r"\.go$", r'"{0}(?:/[^"]*)?"'), "python": (r"\.py$", r"^\s*(?:from|import)\s+{0}\b"), "javascript": (r"\.[jt]sx?$", r"(?:require\(|from\s+|import\s+)['\"]{0}(?:/[^'\"]*)?['\"]"), "java": (r"\.java$", r"^\s*import\s+(?:static\s+)?{0}\b"), "rust": (r"\.rs$", r"\buse\s+{0}\b"), "ruby": (r"\.rb$", r"require\s+['\"]{0}(?:/|['\"])"), "c": (r"\.(?:c|h|cc|cpp)$", r"#\s*include\s*[<\"]{0}[/.>\"]")}


def source_use(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, package, imports, symbols): whether files (repo, path, text) of a language import a package (language, package, symbols array) and name one of its symbols.

    A repository with files of the language but no import comes out with False; one without such files doesn't come out.
    """
    pairs = packages.where(F.col("language").isin(*IMPORTS))
    by = lambda i: F.create_map(*[F.lit(x) for lang, p in IMPORTS.items() for x in (lang, p[i])])[F.col("language")]
    quoted = F.regexp_replace("package", r"([.^$|()\[\]{}*+?\\])", r"\\$1")
    rules = pairs.select("language", "package", "symbols", by(0).alias("files"), F.concat(F.lit("(?m)"), F.replace(by(1), F.lit("{0}"), quoted)).alias("pattern"))
    hit = files.join(F.broadcast(rules), F.regexp_like("path", F.col("files")))
    imports = F.regexp_like("text", F.col("pattern"))
    return hit.groupBy("repo", "package").agg(F.bool_or(imports).alias("imports"), F.bool_or(imports & F.coalesce(F.exists("symbols", lambda x: F.contains(F.col("text"), x)), F.lit(False))).alias("symbols"))


# ---- ELF

ELF = T.StructType([T.StructField("is_elf", T.BooleanType()), T.StructField("bits", T.IntegerType()), T.StructField("machine", T.IntegerType()), T.StructField("needed", T.ArrayType(T.StringType())), T.StructField("found", T.ArrayType(T.StringType()))])


def parse_elf(content: bytes | None, wanted: tuple[bytes, ...] = ()) -> dict:
    """Class, machine and needed libraries of an ELF file, and which of the wanted strings stand in it; never raises."""
    import struct

    out = {"is_elf": False, "bits": None, "machine": None, "needed": [], "found": []}
    if not content or content[:4] != b"\x7fELF":
        return out
    out["is_elf"] = True
    out["found"] = sorted(w.decode("utf-8", "replace") for w in wanted if w in content)
    try:
        wide, order = content[4] == 2, "<" if content[5] == 1 else ">"
        out["bits"], out["machine"] = 64 if wide else 32, struct.unpack_from(order + "H", content, 18)[0]
        phoff = struct.unpack_from(order + ("Q" if wide else "I"), content, 32 if wide else 28)[0]
        size, count = struct.unpack_from(order + "HH", content, 54 if wide else 42)
        segments = []
        for i in range(count):
            at = phoff + i * size
            if wide:
                kind, _, offset, address, _, length = struct.unpack_from(order + "IIQQQQ", content, at)
            else:
                kind, offset, address, _, length = struct.unpack_from(order + "IIIII", content, at)
            segments.append((kind, offset, address, length))
        to_file = lambda a: next((o + a - v for k, o, v, n in segments if k == 1 and v <= a < v + n), None)
        names, table = [], None
        for kind, offset, _, length in segments:
            if kind != 2:
                continue
            entry = 16 if wide else 8
            for at in range(offset, offset + length, entry):
                tag, value = struct.unpack_from(order + ("qQ" if wide else "iI"), content, at)
                if tag == 0:
                    break
                if tag == 1:
                    names.append(value)
                elif tag == 5:
                    table = to_file(value)
        if table is not None:
            out["needed"] = [content[table + n : content.index(b"\0", table + n)].decode("utf-8", "replace") for n in names]
    except (struct.error, ValueError, IndexError):
        pass
    return out


@F.pandas_udf(ELF)
def elf(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_elf(c) for c in content], columns=["is_elf", "bits", "machine", "needed", "found"])


def tls_versions(transcript: Column) -> Column:
    """Protocol versions that a probe's transcript shows as accepted, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(transcript, F.lit(r"(?m)^\s*(?:Protocol\s*:\s*|New, )(TLSv1(?:\.[0-3])?)"), F.lit(1))))
