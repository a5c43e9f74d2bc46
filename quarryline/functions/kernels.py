"""Per-document parsers behind Arrow UDFs: manifests, redaction, canonical JSON, title similarity. They never raise on bad input."""

from __future__ import annotations

import difflib
import hashlib
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Parsed = tuple[str | None, list[tuple[str, str | None, bool]]]
MANIFEST = T.StructType([
    T.StructField("declared", T.StringType()),
    T.StructField("deps", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType()), T.StructField("indirect", T.BooleanType())]))),
])


def go_mod(text: str) -> Parsed:
    declared, deps = None, []
    inside = False
    for line in text.splitlines():
        plain, _, note = line.partition("//")
        words = plain.split()
        if not words:
            continue
        if words[0] == "module" and len(words) > 1:
            declared = words[1]
        elif words[0] == "require" and words[-1] == "(":
            inside = True
        elif words[0] == ")":
            inside = False
        elif inside and len(words) >= 2 or words[0] == "require" and len(words) >= 3:
            name, version = words[-2:]
            deps.append((name, version, "indirect" in note))
    return declared, deps


def npm_alias(value) -> tuple[str, str] | None:
    """Real name and version of ``npm:name@version``; None for anything else."""
    if not isinstance(value, str) or not value.startswith("npm:") or len(value) == 4:
        return None
    at = value.find("@", 5)
    return (value[4:], "") if at < 0 else (value[4:at], value[at + 1 :].lstrip("^~="))


def package_json(text: str) -> Parsed:
    doc = json.loads(text)
    deps = []
    for part in ("dependencies", "devDependencies"):
        for name, value in (doc.get(part) or {}).items():
            real, version = npm_alias(value) or (name, value.lstrip("^~") if isinstance(value, str) else "")
            deps.append((real, version, False))
    return doc.get("name") or None, deps


def package_lock(text: str) -> Parsed:
    doc = json.loads(text)
    packages = doc.get("packages") or {}
    root = packages.get("") or {}
    direct = {n for part in ("dependencies", "devDependencies") for n in root.get(part) or {}}
    deps = []
    for path, entry in packages.items():
        folder = path.rpartition("node_modules/")[2]
        if path and entry.get("version"):
            deps.append((entry.get("name") or folder, entry["version"], folder not in direct))
    return root.get("name") or doc.get("name"), deps


#: Headings of the blocks that list direct dependencies; fixed values.
PNPM_DIRECT = ("dependencies", "devDependencies", "optionalDependencies")


def pnpm_lock(text: str) -> Parsed:
    """Entries ``name@version`` of packages; those listed as dependencies of the root or of a workspace are direct. Older keys with a slash are left out."""
    doc = _yaml(text) or {}
    holders = [doc, *(doc.get("importers") or {}).values()]
    direct = {n for h in holders for part in PNPM_DIRECT for n in (h.get(part) or {})}
    deps = []
    for key in doc.get("packages") or {}:
        name, at, version = str(key).lstrip("/").partition("(")[0].rpartition("@")
        if at and name and version:
            deps.append((name, version, name not in direct))
    return None, deps


def yarn_lock(text: str) -> Parsed:
    """Resolved versions of the entries of a yarn.lock; which are direct it doesn't tell."""
    deps, name = [], None
    for line in text.splitlines():
        if line and not line[0].isspace() and line.rstrip().endswith(":") and not line.startswith("#"):
            first = line.split(",")[0].strip().strip('":')
            name = first[: first.find("@", 1)] if "@" in first[1:] else None
        elif name and (m := re.match(r"""\s+version:?\s+["']?([^"'\s]+)""", line)):
            deps.append((name, m[1], True))
            name = None
    return None, [d for d in deps if d[0] != "__metadata"]


def pep508(text: str) -> tuple[str, str] | None:
    """Normalized name and first version of a requirement; an empty version if it has none."""
    m = re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*\(?\s*(?:(?:===|==|>=|<=|~=|!=|<|>)\s*([^\s,;)#]+))?", text)
    return (pep503(m[1]), m[2] or "") if m else None


def requirements(text: str) -> Parsed:
    """Lines that state a version; comments, options and markers are left out."""
    deps = []
    for line in text.splitlines():
        plain = re.split(r"[#;]", line)[0].strip()
        found = pep508(plain) if plain and not plain.startswith("-") else None
        if found and found[1]:
            deps.append((*found, False))
    return None, deps


def setup_py(text: str) -> Parsed:
    name = re.search(r"""\bname\s*=\s*['"]([^'"]+)""", text)
    listed = re.search(r"install_requires\s*=\s*\[([\s\S]*?)\]", text)
    found = [pep508(q) for q in re.findall(r"""['"]([^'"]+)['"]""", listed[1])] if listed else []
    return name[1] if name else None, [(*f, False) for f in found if f]


def environment_yml(text: str) -> Parsed:
    """Conda's dependencies, without channel and build, and those that pip takes."""
    deps = []
    for item in (_yaml(text) or {}).get("dependencies") or []:
        if isinstance(item, dict):
            deps += [(*f, False) for f in map(pep508, map(str, item.get("pip") or [])) if f]
        elif m := re.match(r"(?:\S+::)?([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:(?:==|>=|<=|!=|~=|=)\s*([^\s=]+))?", str(item)):
            deps.append((pep503(m[1]), m[2] or "", False))
    return None, deps


def helm_chart(text: str) -> Parsed:
    doc = _yaml(text) or {}
    return doc.get("name"), [(str(x["name"]), str(x.get("version") or ""), False) for x in doc.get("dependencies") or [] if isinstance(x, dict) and x.get("name")]


def _yaml(text: str):
    """A YAML document with all scalars as text; an error without the package."""
    import yaml

    return yaml.load(text, Loader=yaml.BaseLoader)


def pep503(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def pyproject(text: str) -> Parsed:
    doc = tomllib.loads(text)
    project, poetry = doc.get("project") or {}, (doc.get("tool") or {}).get("poetry") or {}
    listed = [*project.get("dependencies", []), *[x for v in (project.get("optional-dependencies") or {}).values() for x in v]]
    deps = [(*f, False) for f in map(pep508, listed) if f]
    groups = [poetry.get("dependencies") or {}, poetry.get("dev-dependencies") or {}, *[(g.get("dependencies") or {}) for g in (poetry.get("group") or {}).values()]]
    for name, value in ((n, v) for g in groups for n, v in g.items() if n.lower() != "python"):
        version = value if isinstance(value, str) else (value or {}).get("version", "") if isinstance(value, dict) else ""
        deps.append((pep503(name), version.lstrip("^~=<>! "), False))
    return project.get("name") or poetry.get("name"), deps


def toml_lock(text: str) -> Parsed:
    return None, [(p["name"], p.get("version"), True) for p in tomllib.loads(text).get("package", []) if p.get("name")]


def pipfile_lock(text: str) -> Parsed:
    doc = json.loads(text)
    return None, [(pep503(n), (v.get("version") or "").lstrip("=") or None if isinstance(v, dict) else v, False) for part in ("default", "develop") for n, v in (doc.get(part) or {}).items()]


def cargo_toml(text: str) -> Parsed:
    doc = tomllib.loads(text)
    deps = [(v.get("package", n) if isinstance(v, dict) else n, v if isinstance(v, str) else v.get("version"), False) for part in ("dependencies", "dev-dependencies", "build-dependencies") for n, v in (doc.get(part) or {}).items()]
    return (doc.get("package") or {}).get("name"), deps


def gemfile_lock(text: str) -> Parsed:
    """Versions pinned under ``specs:``; deeper lines are constraints of those, and what is direct it doesn't tell."""
    deps, inside = [], False
    for line in text.splitlines():
        if line.strip() == "specs:":
            inside = True
        elif line and not line[0].isspace():
            inside = False
        elif inside and (m := re.match(r"    ([A-Za-z0-9._-]+) \((\d[A-Za-z0-9._+-]*)\)\s*$", line)):
            deps.append((m[1], m[2], True))
    return None, deps


def gemfile(text: str) -> Parsed:
    return None, [(m[1], m[2], False) for m in re.finditer(r"""^\s*(?:gem|\w+\.add_(?:runtime_|development_)?dependency)[ (]+['"]([^'"]+)['"](?:\s*,\s*['"][^0-9'"]*([^'"]+)['"])?""", text, re.M)]


def pom(text: str) -> Parsed:
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        return None, []
    root = ET.fromstring(text)
    get = lambda e, tag: next((c.text.strip() for c in e if c.tag.rpartition("}")[2] == tag and c.text), None)
    props = {c.tag.rpartition("}")[2]: (c.text or "").strip() for p in root if p.tag.rpartition("}")[2] == "properties" for c in p}
    props |= {"project.version": get(root, "version") or "", "project.groupId": get(root, "groupId") or ""}

    def filled(value: str | None) -> str | None:
        for _ in range(10):
            if value is None or "${" not in value:
                return value
            value = re.sub(r"\$\{([^}]+)\}", lambda m: props.get(m[1]) or m[0], value)
        return None

    listed = [d for part in root if part.tag.rpartition("}")[2] in ("dependencies", "dependencyManagement") for d in part.iter() if d.tag.rpartition("}")[2] == "dependency"]
    parent = next((c for c in root if c.tag.rpartition("}")[2] == "parent"), None)
    group = get(root, "groupId") or (get(parent, "groupId") if parent is not None else None)
    props["project.groupId"] = props["project.groupId"] or group or ""
    props["project.version"] = props["project.version"] or (get(parent, "version") if parent is not None else None) or ""
    deps, seen = [], set()
    for d in listed:
        names = [filled(get(d, tag)) for tag in ("groupId", "artifactId")]
        version = filled(get(d, "version"))
        # a version that is stated and can't be resolved says nothing about what is used
        if all(names) and not (version is None and get(d, "version")) and tuple(names) not in seen:
            seen.add(tuple(names))
            deps.append((":".join(names), version or "", False))
    return f"{group}:{get(root, 'artifactId')}" if get(root, "artifactId") else None, deps


def gradle_lock(text: str) -> Parsed:
    return None, [(m[1], m[2], False) for m in re.finditer(r"^([^#:=\s]+:[^:=\s]+):([^=\s]+)=", text, re.M)]


def build_gradle(text: str) -> Parsed:
    return None, [(m[1], m[2], False) for m in re.finditer(r"""(?:implementation|api|compileOnly|runtimeOnly|testImplementation)\s*\(?\s*['"]([^:'"]+:[^:'"]+):([^'"]+)['"]""", text)]


def packages_lock(text: str) -> Parsed:
    return None, [(n, v.get("resolved"), v.get("type") == "Transitive") for frame in (json.loads(text).get("dependencies") or {}).values() for n, v in frame.items()]


def csproj(text: str) -> Parsed:
    return None, [(m[1], m[2], False) for m in re.finditer(r'<PackageReference\s+Include="([^"]+)"(?:\s+Version="([^"]+)")?', text)]


def dockerfile(text: str) -> Parsed:
    stages, deps = set(), []
    for m in re.finditer(r"^\s*FROM\s+(?:--\S+\s+)?(\S+)(?:\s+AS\s+(\S+))?", text, re.M | re.I):
        if m[1].lower() not in stages and m[1] != "scratch" and "$" not in m[1]:
            deps.append((*docker_ref(m[1]), False))
        if m[2]:
            stages.add(m[2].lower())
    return None, deps


def docker_ref(ref: str) -> tuple[str, str]:
    """Name and version of an image: digest before tag before latest; a port isn't a tag."""
    name, _, digest = ref.partition("@")
    if digest:
        return name, digest
    head, _, tag = name.rpartition(":")
    return (head, tag) if head and "/" not in tag else (name, "latest")


def workflow(text: str) -> Parsed:
    return None, [(m[1], m[2], False) for m in re.finditer(r"^\s*-?\s*uses:\s*['\"]?([^@\s'\"./][^@\s'\"]*)@([^\s'\"#]+)", text, re.M)]


#: File name pattern -> parser; the first that fits counts.
PARSERS: list[tuple[str, Callable[[str], Parsed]]] = [
    (r"(^|/)go\.mod$", go_mod), (r"(^|/)pnpm-lock\.ya?ml$", pnpm_lock), (r"(^|/)yarn\.lock$", yarn_lock), (r"(^|/)setup\.py$", setup_py), (r"(^|/)environment\.ya?ml$", environment_yml), (r"(^|/)(Chart|requirements)\.ya?ml$", helm_chart), (r"(^|/)(package-lock|npm-shrinkwrap)\.json$", package_lock), (r"(^|/)package\.json$", package_json), (r"(^|/)(poetry|Cargo|uv)\.lock$", toml_lock),
    (r"(^|/)Pipfile\.lock$", pipfile_lock), (r"(^|/)(requirements|constraints)[^/]*\.txt$", requirements), (r"(^|/)pyproject\.toml$", pyproject), (r"(^|/)Cargo\.toml$", cargo_toml),
    (r"(^|/)Gemfile\.lock$", gemfile_lock), (r"(^|/)(Gemfile|[^/]+\.gemspec)$", gemfile), (r"(^|/)pom\.xml$", pom), (r"(^|/)gradle\.lockfile$", gradle_lock), (r"(^|/)build\.gradle(\.kts)?$", build_gradle),
    (r"(^|/)packages\.lock\.json$", packages_lock), (r"\.csproj$", csproj), (r"(^|/)(Dockerfile|Containerfile)[^/]*$", dockerfile), (r"(^|/)\.github/workflows/[^/]+\.ya?ml$", workflow),
]


def parse_manifest(path: str | None, text: str | None) -> Parsed:
    for pattern, parser in PARSERS:
        if path and text and re.search(pattern, path):
            try:
                declared, deps = parser(text)
                return declared, [d for d in deps if d[0]]
            except Exception:  # noqa: BLE001  a broken manifest has no dependencies
                return None, []
    return None, []


@F.pandas_udf(MANIFEST)
def manifest(path: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = [parse_manifest(p, t) for p, t in zip(path, text)]
    return pd.DataFrame({"declared": [r[0] for r in rows], "deps": [[{"name": n, "version": v, "indirect": i} for n, v, i in r[1]] for r in rows]})


def canonical_json(value) -> str:
    """Sorted keys, no spaces, ASCII."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


@F.pandas_udf(T.StringType())
def canonical_map(values: pd.Series) -> pd.Series:
    """Canonical JSON of maps of text."""
    return values.map(lambda v: None if v is None else canonical_json(dict(v)))


def row_sha(row: dict) -> str:
    return hashlib.sha256(canonical_json({k: v for k, v in row.items() if k != "row_sha"}).encode()).hexdigest()


def title_similarity(a: str, b: str) -> float:
    """The larger of the matching blocks' ratio and the words' overlap."""
    a, b = a.lower(), b.lower()
    one, two = ({w for w in re.findall(r"[a-z0-9]+", t) if len(w) > 2} for t in (a, b))
    return max(difflib.SequenceMatcher(None, a, b).ratio(), len(one & two) / len(one | two) if one | two else 0.0)


@F.pandas_udf(T.DoubleType())
def title_sim(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([title_similarity(x or "", y or "") for x, y in zip(a, b)])


#: Shapes of secrets in text, in the order they're looked for: class, pattern, whether only the first group is the secret; fixed values.
SECRETS = [
    ("aws-access-key", r"AKIA[0-9A-Z]{12,}", False),
    ("github-token", r"gh[oprsu]_[A-Za-z0-9]{30,}", False),
    ("github-pat", r"github_pat_[A-Za-z0-9_]{20,}", False),
    ("gitlab-token", r"glpat-[A-Za-z0-9_-]{20,}", False),
    ("slack-token", r"xox[abps]-[A-Za-z0-9-]{10,}", False),
    ("llm-api-key", r"sk-[A-Za-z0-9]{20,}", False),
    ("google-api-key", r"AIza[A-Za-z0-9_-]{35}", False),
    ("bearer-token", r"Bearer\s+([A-Za-z0-9._-]{20,})", True),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{10,}){2}", False),
    *[(f"{name}-assignment", rf"(?i){word}\s*[:=]\s*\\?['\"]([^'\"\\]{{8,}})\\?['\"]", True) for name, word in (("password", "passw(?:or)?d"), ("secret", "secret"), ("token", "token"), ("apikey", "api[_-]?key"))],
    ("url-credentials", r"://[A-Za-z0-9._%+-]+:([^@/\s'\"]{6,})@", True),
    ("us-ssn", r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}\b", False),
    ("azure-client-secret", r"\b[A-Za-z0-9~_.-]{3}8Q~[A-Za-z0-9~_.-]{30,}\b", False),
    ("gcp-sa-key", r'"private_key_id"\s*:\s*"([a-f0-9]{40})"', True),
]
#: Classes whose shape alone proves a secret; fixed values.
CERTAIN = ("aws-access-key", "github-token", "github-pat", "gitlab-token", "slack-token", "google-api-key", "jwt", "pem-private-key", "azure-client-secret", "gcp-sa-key")
_SHAPES = [(name, re.compile(pattern), inner) for name, pattern, inner in SECRETS]
_KEY_BLOCK = re.compile(r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)[\s\S]*?(-----END [A-Z ]*PRIVATE KEY-----)")
_CARD = re.compile(r"\b(?:\d[ -]?){13,19}\b")
KEPT, MARK = 5, "...REDACTED"
KEY_MARK = "[PRIVATE KEY MATERIAL REDACTED]"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed([int(x) for x in digits if x.isdigit()])):
        total += c if i % 2 == 0 else c * 2 - 9 * (c > 4)
    return total % 10 == 0


def redact(text: str) -> tuple[str, list[str]]:
    """(text, classes found): secrets cut to five characters and a mark, key blocks emptied; what is redacted stays as it is."""
    hits: list[str] = []
    for name, shape, inner in _SHAPES:
        def cut(m: re.Match, name=name, inner=inner) -> str:
            if MARK in m[0]:
                return m[0]
            hits.append(name)
            secret = m[1] if inner else m[0]
            return m[0].replace(secret, secret[:KEPT] + MARK)

        text = shape.sub(cut, text)

    def emptied(m: re.Match) -> str:
        if KEY_MARK not in m[0]:
            hits.append("pem-private-key")
        return f"{m[1]}\n{KEY_MARK}\n{m[2]}"

    def card(m: re.Match) -> str:
        digits = re.sub("[ -]", "", m[0])
        if not (13 <= len(digits) <= 19 and luhn(digits)):
            return m[0]
        hits.append("payment-card")
        return digits[:KEPT] + MARK

    return _CARD.sub(card, _KEY_BLOCK.sub(emptied, text)), hits


@F.pandas_udf(T.StringType())
def redacted(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else redact(t)[0])


@F.pandas_udf(T.ArrayType(T.StringType()))
def secret_classes(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [] if t is None else redact(t)[1])


def dependencies(path: Column, text: Column) -> Column:
    return manifest(path, text)["deps"]
