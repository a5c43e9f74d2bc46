"""Advisories against versions, compliance scopes, owners of repositories, and what a corpus holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- versions and advisories

#: How an ecosystem's versions become numbers: what is dropped in front, how many numbers at most (NULL: all), whether all of three must be there; fixed values.
VERSION_FORMS = {"go": ("^v?", 3, True), "npm": ("^[vV]?", 3, False), "cargo": ("^[vV]?", 3, False), "pypi": (r"^(?:\d+!)?[vV]?", None, False)}


def version_numbers(version: Column, ecosystem: Column) -> Column:
    """Leading numbers of a version by its ecosystem's form (any other: all leading numbers); NULL if it can't be read."""
    def form(front: str, most: int | None, whole: bool) -> Column:
        shape = r"\d+\.\d+\.\d+" if whole else r"\d+(?:\.\d+)*"
        text = F.nullif(F.regexp_extract(F.trim(version), f"{front}({shape})", 1), F.lit(""))
        numbers = F.transform(F.split(text, r"\."), lambda x: x.try_cast("bigint"))
        return numbers if most is None else F.slice(numbers, 1, most)

    out = form("^", None, False)
    for name, (front, most, whole) in VERSION_FORMS.items():
        out = F.when(ecosystem == name, form(front, most, whole)).otherwise(out)
    return out


def in_vulnerable_range(version: Column, range_text: Column, fixed: Column, ecosystem: Column) -> Column:
    """Whether a version lies below the fixed one and within all bounds of ``>=1.2 <2``; NULL if it can't be read or nothing bounds it."""
    v = version_numbers(version, ecosystem)
    bounds = F.transform(F.regexp_extract_all(F.coalesce(range_text, F.lit("")), F.lit(r"((?:<=|>=|<|>)\s*[^\s,<>=]+)"), F.lit(1)), lambda b: F.struct(F.regexp_extract(b, "^[<>=]+", 0).alias("op"), version_numbers(F.trim(F.regexp_replace(b, "^[<>=]+", "")), ecosystem).alias("at")))
    every = F.concat(bounds, F.array(F.struct(F.lit("<").alias("op"), version_numbers(fixed, ecosystem).alias("at"))))
    known = F.filter(every, lambda b: b["at"].isNotNull())
    holds = lambda b: F.when(b["op"] == "<", v < b["at"]).when(b["op"] == "<=", v <= b["at"]).when(b["op"] == ">=", v >= b["at"]).otherwise(v > b["at"])
    return F.when(v.isNotNull() & (F.size(known) > 0), F.forall(known, holds))


def affected_versions(uses: DataFrame, advisories: DataFrame) -> DataFrame:
    """uses (repo, ecosystem, package, version) of packages that advisories (advisory, ecosystem, package, range, fixed) name, with in_range (NULL: can't tell)."""
    both = uses.join(advisories, ["ecosystem", "package"])
    return both.select("advisory", "repo", "ecosystem", "package", "version", in_vulnerable_range(F.col("version"), F.col("range"), F.col("fixed"), F.col("ecosystem")).alias("in_range"))


def impact_class(**evidence: Column) -> Column:
    """How far evidence shows that a repository is hit; evidence not given is NULL, and NULL is never a no.

    in_range, imported (booleans), reachability, call, features (number of matches), binary, symbols, manifest, linked, source.
    """
    e = lambda name, kind="string": evidence.get(name, F.lit(None).cast(kind))
    yes = lambda c: F.coalesce(c, F.lit(False))
    imported, features = e("imported", "boolean"), e("features", "int")
    unseen = yes(e("reachability").isin("package_imported_not_observed", "module_required_not_observed"))
    found = yes(e("source") == "imports_found")
    return (
        F.when(yes(~e("in_range", "boolean")), "version_not_in_range").when(yes(e("reachability") == "symbol_reachable") | yes(e("call") == "vulnerable_symbol_called"), "affected")
        .when(yes(features > 0), F.when(unseen, "likely_affected").otherwise("affected")).when(unseen | yes(e("binary") == "package_path_absent") | yes(~imported), "not_observed").when(yes(e("binary") == "package_path_present"), "likely_affected")
        .when(yes(imported), F.when(e("reachability").isNull() & features.isNull(), "likely_affected").otherwise("not_observed")).when(yes(e("symbols") == "symbols_used"), "likely_affected")
        .when(yes(e("manifest") == "module_pinned_out_of_range"), "version_not_in_range").when(yes(e("manifest") == "module_pinned_in_range") | yes(e("linked") == "linked"), "likely_affected")
        .when((yes(e("manifest") == "module_not_in_manifests") | yes(e("linked") == "not_linked")) & ~found, "not_observed").when(found, "likely_affected").otherwise("inconclusive")
    )


IMPACT_CLASSES = ("affected", "likely_affected", "not_observed", "version_not_in_range", "inconclusive")


def impact_summary(classified: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Per advisory a column for each class, n_in_range, and the product surfaces (repo, surface) of hit repositories, joined by commas."""
    hit = classified.where(F.col("classification").isin("affected", "likely_affected")).join(surfaces, "repo").groupBy("advisory").agg(F.array_join(F.array_sort(F.collect_set("surface")), ",").alias("surfaces"))
    counts = [F.count_if(F.col("classification") == c).alias(c) for c in IMPACT_CLASSES]
    return classified.groupBy("advisory").agg(*counts, F.count_if("in_range").alias("n_in_range")).join(hit, "advisory", "left")


# ---- scopes

def scope(base: DataFrame, include: DataFrame, exclude: DataFrame) -> DataFrame:
    """(boundary, repo, state) of base and include without exclude (each boundary, repo).

    State `in` or `excluded`; what must not pass in silence: `stale_exclude` for an exclusion that hits nothing, and
    `empty` for a boundary that holds nothing in the end (repo NULL). A boundary named anywhere comes out.
    """
    resolved = base.select("boundary", "repo").unionByName(include.select("boundary", "repo")).where("repo is not null").distinct()
    out = exclude.select("boundary", "repo").where("repo is not null").distinct()
    both = resolved.withColumn("here", F.lit(True)).join(out.withColumn("gone", F.lit(True)), ["boundary", "repo"], "full")
    rows = both.select("boundary", "repo", F.when(F.col("gone").isNull(), "in").when(F.col("here"), "excluded").otherwise("stale_exclude").alias("state"))
    named = reduce(DataFrame.unionByName, [df.select("boundary") for df in (base, include, exclude)]).distinct()
    empty = named.join(rows.where("state = 'in'").select("boundary").distinct(), "boundary", "left_anti").select("boundary", F.lit(None).cast("string").alias("repo"), F.lit("empty").alias("state"))
    return rows.unionByName(empty)


def checked_scope(rows: DataFrame) -> DataFrame:
    """The repositories in scope; evaluating it fails if an exclusion is stale or a boundary is empty."""
    wrong = F.raise_error(F.concat_ws(" ", F.col("boundary"), F.col("state"), F.coalesce("repo", F.lit(""))))
    return rows.where(F.col("state") != "excluded").select("boundary", F.when(F.col("state") == "in", F.col("repo")).otherwise(wrong).alias("repo"))


def scope_verdict(actions: DataFrame, off_limits: DataFrame, allowed: DataFrame, expires: Column, today: Column) -> DataFrame:
    """actions (id, adapter, verb, target) with allowed and the first reason against: expired, off limits, not in scope, verb denied.

    off_limits: adapter, pattern; allowed: adapter, pattern, denied (array of verbs). Patterns are globs. Both are small
    tables that people write; of several allowances that hold a target the one that denies the fewest verbs counts.
    """
    def glob(pattern: Column) -> Column:
        plain = F.regexp_replace(pattern, r"([.+^$()|{}\\])", r"\\$1")
        return F.concat(F.lit("^"), F.replace(F.replace(plain, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))

    hit = actions.select("id", "adapter", "target").join(off_limits.select("adapter", F.col("pattern").alias("off")), "adapter").where(F.regexp_like("target", glob(F.col("off")))).groupBy("id").agg(F.min("off").alias("off"))
    held = actions.select("id", "adapter", "target").join(allowed.select("adapter", "pattern", "denied"), "adapter").where(F.regexp_like("target", glob(F.col("pattern")))).groupBy("id").agg(F.min_by("denied", F.struct(F.size("denied"), "pattern")).alias("denied"), F.lit(True).alias("held"))
    joined = actions.join(hit, "id", "left").join(held, "id", "left")
    reason = F.when(today > expires, "expired").when(F.col("off").isNotNull(), F.concat(F.lit("off_limits: "), "off")).when(F.col("held").isNull(), "not_in_scope").when(F.array_contains("denied", F.col("verb")), F.concat(F.lit("verb_denied: "), "verb")).otherwise("ok")
    return joined.select("id", (reason == "ok").alias("allowed"), reason.alias("reason"))


# ---- owners

REGISTRY = "ps_products map<string,struct<name:string,ps_modules:array<string>>>, ps_modules map<string,struct<ps_update_streams:array<string>,private_tracker_cc:array<string>,component_cc:map<string,array<string>>,default_cc:array<string>,lifecycle:struct<supported_from:string,supported_until:string>>>, ps_update_streams map<string,struct<managed_service_components:array<struct<name:string,git_repo_url:string>>>>"
#: Fields of a module that name people, with their tier (lower is better) and whether they may know of embargoed flaws; fixed values.
CONTACT_FIELDS = (("private_tracker_cc", 1, True), ("component_cc", 2, False), ("default_cc", 3, False))


def registry_indexes(docs: DataFrame) -> dict[str, DataFrame]:
    """Tables of a product registry (docs: doc as REGISTRY): repo_products (url, stream, module, product), slugs (slug, product), contacts, lifecycles."""
    from quarryline.functions.text import join_url, slugify

    e = lambda name: docs.select(F.explode(f"doc.{name}").alias("k", "v"))
    products, modules, streams = e("ps_products"), e("ps_modules"), e("ps_update_streams")
    by_module = products.select(F.col("k").alias("product"), F.explode("v.ps_modules").alias("module"))
    by_stream = modules.select(F.col("k").alias("module"), F.explode("v.ps_update_streams").alias("stream"))
    by_url = streams.select(F.col("k").alias("stream"), F.explode("v.managed_service_components").alias("c")).where("c.git_repo_url is not null").select("stream", join_url(F.col("c.git_repo_url")).alias("url"), F.col("c.name").alias("component"))
    slugs = products.select(F.col("k").alias("product"), F.explode(F.array("k", "v.name")).alias("s")).select(slugify(F.col("s")).alias("slug"), "product").where("slug <> ''").groupBy("slug").agg(F.min("product").alias("product"))
    lists = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("tier"), F.lit(b).alias("embargo"), (F.flatten(F.map_values("v.component_cc")) if f == "component_cc" else F.col(f"v.{f}")).alias("people")) for f, t, b in CONTACT_FIELDS])
    contacts = modules.select(F.col("k").alias("module"), F.explode(lists).alias("l")).select("module", "l.field", "l.tier", "l.embargo", F.explode("l.people").alias("value"))
    lifecycles = modules.select(F.col("k").alias("module"), "v.lifecycle.supported_from", "v.lifecycle.supported_until")
    return {"repo_products": by_url.join(by_stream, "stream").join(by_module, "module").select("url", "component", "stream", "module", "product").distinct(), "slugs": slugs, "by_module": by_module, "contacts": contacts, "lifecycles": lifecycles}


def resolved_owners(queries: DataFrame, mapped: DataFrame, index: dict[str, DataFrame], by_slug: bool = True) -> DataFrame:
    """queries (repo, url, slug) with match_tier and product: `mapped` (repo, product) before `repo-url` before `slug` before `none`.

    The slug tier can be left out, as a name alone may mislead where nobody looks. Of several products of a tier the smallest counts.
    """
    from quarryline.functions.text import join_url

    one = mapped.groupBy("repo").agg(F.min("product").alias("m"))
    url = index["repo_products"].groupBy(F.col("url").alias("__u")).agg(F.min("product").alias("u"))
    slug = index["slugs"].select(F.col("slug").alias("__s"), F.col("product").alias("s"))
    joined = queries.withColumn("__u", join_url(F.col("url"))).join(one, "repo", "left").join(url, "__u", "left").join(slug, F.col("slug") == F.col("__s"), "left")
    s = F.col("s") if by_slug else F.lit(None).cast("string")
    tier = F.when(F.col("m").isNotNull(), "mapped").when(F.col("u").isNotNull(), "repo-url").when(s.isNotNull(), "slug").otherwise("none")
    return joined.select("repo", tier.alias("match_tier"), F.coalesce("m", "u", s).alias("product"))


def product_contacts(index: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(contacts, dropped): per product and person the best tier with its field and module; values that aren't a plain name, counted by reason."""
    person = F.trim(F.substring_index("value", "@", 1))
    named = index["by_module"].join(index["contacts"], "module").withColumn("person", person).withColumn("fine", F.col("person").rlike("^[a-z][a-z0-9_-]{1,31}$"))
    best = named.where("fine").groupBy("product", "person").agg(F.min(F.struct("tier", "module", "field", "embargo")).alias("b"))
    reason = F.when(F.col("value").startswith("+"), "unexpanded_alias").otherwise("not_a_name")
    dropped = named.where(~F.coalesce(F.col("fine"), F.lit(False))).groupBy("product", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return best.select("product", "person", "b.tier", "b.field", "b.embargo"), dropped


def drop_rate(contacts: DataFrame, dropped: DataFrame, limit: float = 0.2) -> DataFrame:
    """(product, kept, lost, rate, warn): share of contact values that had to be dropped, and whether that is too much to trust the list."""
    k, n = contacts.groupBy("product").agg(F.count(F.lit(1)).alias("kept")), dropped.groupBy("product").agg(F.sum("n").alias("lost"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = k.join(n, "product", "full").select("product", zero("kept").alias("kept"), zero("lost").alias("lost"))
    return out.withColumn("rate", F.round(F.try_divide(F.col("lost"), F.col("kept") + F.col("lost")), 6)).withColumn("warn", F.col("rate") > limit)


def lifecycle(windows: DataFrame, key: str, today: Column) -> DataFrame:
    """key with supported_from (the least), supported_until (the greatest, NULL if any is unknown) and state: unreleased, eol, supported or unknown."""
    out = windows.groupBy(key).agg(F.min("supported_from").alias("supported_from"), F.when(F.bool_or(F.col("supported_until").isNull()), None).otherwise(F.max("supported_until")).alias("supported_until"), F.bool_or(F.col("supported_from").isNotNull() | F.col("supported_until").isNotNull() | F.lit(True)).alias("any"))
    state = F.when(F.col("supported_from") > today, "unreleased").when(F.col("supported_until") < today, "eol").when(F.col("any"), "supported").otherwise("unknown")
    return out.select(key, "supported_from", "supported_until", state.alias("state"))


def team_controls(open_findings: DataFrame, owners: DataFrame, refs: Column) -> DataFrame:
    """(team, n_findings, n_controls) of open findings (repo, and refs, an array) with control references; without an owner (repo, team) they are ``(unassigned)``."""
    owner = owners.groupBy("repo").agg(F.min("team").alias("team"))
    named = open_findings.where(refs.isNotNull()).withColumn("__refs", refs).join(owner, "repo", "left").withColumn("team", F.coalesce("team", F.lit("(unassigned)")))
    n = named.groupBy("team").agg(F.count(F.lit(1)).alias("n_findings"))
    c = named.select("team", F.explode("__refs").alias("r")).groupBy("team").agg(F.countDistinct("r").alias("n_controls"))
    return n.join(c, "team", "left").select("team", "n_findings", F.coalesce("n_controls", F.lit(0)).alias("n_controls"))


def boundary_coverage(members: DataFrame, assessed: DataFrame) -> DataFrame:
    """(boundary, repos, assessed, share, newest): members (boundary, repo) of which an assessment (repo, generated_at) exists."""
    newest = assessed.groupBy("repo").agg(F.max("generated_at").alias("at"))
    joined = members.select("boundary", "repo").distinct().join(newest, "repo", "left")
    out = joined.groupBy("boundary").agg(F.count(F.lit(1)).alias("repos"), F.count("at").alias("assessed"), F.max("at").alias("newest"))
    return out.select("boundary", "repos", "assessed", F.round(F.col("assessed") / F.col("repos"), 6).alias("share"), "newest")


# ---- corpus

def corpus_totals(repos: DataFrame) -> DataFrame:
    """Per tree, and for all of them (tree NULL), the corpus's measures; kinds and refs as ``name=n`` joined by commas."""
    levels = repos.withColumn("tree", F.explode(F.array("tree", F.lit(None).cast("string"))))
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    main = levels.groupBy("tree").agg(
        F.count(F.lit(1)).alias("reports"), flag(F.col("is_md_only") == 1).alias("md_only"), flag(F.col("is_branch_audit") == 1).alias("branch_audits"), flag(F.col("is_branch_audit") == 0).alias("head_reports"), F.countDistinct("base_slug").alias("slugs"),
        F.count("findings_current").alias("with_current"), F.count("triage_json").alias("with_triage"), F.count("threat_model").alias("with_model"), flag(F.col("product").isNull()).alias("shallow_dirs"),
    )
    listed = lambda c, name: levels.where(F.col(c).isNotNull()).groupBy("tree", c).agg(F.count(F.lit(1)).alias("n")).groupBy("tree").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", c, F.col("n").cast("string")))), ",").alias(name))
    out = main
    for c, name in (("report_kind", "kinds"), ("ref", "refs")):
        part = listed(c, name).withColumnRenamed("tree", "__t")
        out = out.join(part, F.col("tree").eqNullSafe(F.col("__t")), "left").drop("__t")
    return out


def corpus_drift(repos: DataFrame, configured: DataFrame) -> DataFrame:
    """(warning, subject, detail): trees that hold reports and aren't configured (tree), slugs in several trees, and reports whose directory lies below another's with the same base."""
    trees = repos.groupBy("tree").agg(F.min("report_path").alias("d")).join(configured.select("tree").distinct(), "tree", "left_anti").select(F.lit("unregistered_tree").alias("warning"), F.col("tree").alias("subject"), F.col("d").alias("detail"))
    across = repos.groupBy("base_slug").agg(F.array_sort(F.collect_set("tree")).alias("t")).where("size(t) > 1").select(F.lit("several_trees"), "base_slug", F.array_join("t", ","))
    folder = F.regexp_replace("report_path", "/[^/]*$", "")
    at = repos.where("report_path is not null").select("base", folder.alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = at.select("base", "folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("above"))
    nested = above.where(F.size(F.split("folder", "/")) > 1).join(at.select("base", F.col("folder").alias("above")), ["base", "above"]).select(F.lit("nested_duplicate"), "folder", "above").distinct()
    return trees.union(across).union(nested)


def outer_reports(repos: DataFrame, n: int) -> DataFrame:
    """Code audits of main lines with a web address, the first of each slug by key, the first n of them."""
    fine = repos.where((F.col("is_branch_audit") == 0) & (F.col("report_kind") == "code-audit") & F.col("repo_url").startswith("http"))
    return fine.groupBy("base_slug").agg(F.min(F.struct("repo_key", "repo_url")).alias("b")).select("base_slug", "b.repo_key", "b.repo_url").orderBy("repo_key").limit(n)


def path_class(path: Column, vendor: tuple[str, ...], noise: tuple[str, ...]) -> Column:
    """`hidden` if a part begins with a dot, `vendor` or `noise` if a part is one of these names, else `source`; the first that holds."""
    parts = F.split(path, "/")
    among = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return F.when(path.rlike(r"(^|/)\.[^/.]"), "hidden").when(among(vendor), "vendor").when(among(noise), "noise").otherwise("source")


def allowlisted(hits: DataFrame, allow: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed): hits whose key an allow list names, and how many others there were by key."""
    names = allow.select(*key).distinct()
    return hits.join(names, key, "left_semi"), hits.join(names, key, "left_anti").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
