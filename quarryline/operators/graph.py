"""Questions about a property graph: nodes (id, kind, label, attrs) and edges (src, dst, rel, attrs), attrs as JSON.

Relations and attributes are parameters with the portfolio graph's vocabulary as defaults; arguments are tables, so
many questions of one kind are one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Relations from a product to what it ships; fixed values.
SHIPS = ("ships", "contains", "includes")


def attr(name: str, attrs: str = "attrs") -> Column:
    return F.get_json_object(attrs, f"$.{name}")


def one_edge(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, rel): the greatest attributes."""
    return edges.groupBy("src", "dst", "rel").agg(F.max("attrs").alias("attrs"))


def blast_radius(edges: DataFrame, nodes: DataFrame, targets: DataFrame, needs: str = "depends_on", ships: tuple[str, ...] = SHIPS) -> DataFrame:
    """(target, part, place, node, detail, indirect, repo_count) for each target (target).

    part `requires`: a repository that needs it, with the version as detail, direct ones first (not known before
    known), then by name; part `surface`: what ships such a repository, with its kind. repo_count is the number of
    requiring repositories. A target that nothing needs gives no rows.
    """
    wanted = edges.where(F.col("rel") == needs).join(targets.select(F.col("target").alias("dst")).distinct(), "dst")
    direct = wanted.select(F.col("dst").alias("target"), F.col("src").alias("node"), attr("version").alias("detail"), (attr("indirect") == "true").alias("indirect"))
    shipped = edges.where(F.col("rel").isin(*ships)).select(F.col("src").alias("surface"), F.col("dst").alias("node"))
    kinds = nodes.groupBy(F.col("id").alias("surface")).agg(F.max("kind").alias("kind"))
    surfaces = direct.select("target", "node").join(shipped, "node").join(kinds, "surface").select("target", F.col("surface").alias("node"), F.col("kind").alias("detail"), F.lit(None).cast("boolean").alias("indirect")).distinct()
    count = direct.groupBy("target").agg(F.countDistinct("node").alias("repo_count"))
    both = direct.withColumn("part", F.lit("requires")).unionByName(surfaces.withColumn("part", F.lit("surface")))
    place = F.row_number().over(W.partitionBy("target", "part").orderBy(F.asc_nulls_first("indirect"), "node"))
    return both.join(count, "target").select("target", "part", place.alias("place"), "node", "detail", "indirect", "repo_count")


def top_shared(edges: DataFrame, nodes: DataFrame, n: int, needs: str = "depends_on", internal: bool | None = None) -> DataFrame:
    """The n nodes that most sources need: dst, label, dependents, internal, ecosystem (``Go`` unless said), owner, fork; internal ones only, if asked."""
    known = nodes.groupBy(F.col("id").alias("dst")).agg(F.max(F.struct("label", "attrs")).alias("n")).select("dst", "n.label", "n.attrs")
    known = known.select("dst", "label", attr("internal").alias("internal"), F.coalesce(attr("ecosystem"), F.lit("Go")).alias("ecosystem"), attr("owner_repo").alias("owner"), attr("sustaining_fork").alias("fork"))
    if internal is not None:
        known = known.where(F.col("internal") == ("1" if internal else "0"))
    counted = edges.where(F.col("rel") == needs).groupBy("dst").agg(F.countDistinct("src").alias("dependents"))
    return counted.join(known, "dst").select("dst", "label", "dependents", "internal", "ecosystem", "owner", "fork").orderBy(F.desc("dependents"), "dst").limit(n)


def group_consumers(edges: DataFrame, groups: DataFrame, owns: str = "owns_crd", direct: dict[str, str] | None = None, requires: str = "requires_crd") -> DataFrame:
    """(grp, how, node, detail) for each group (grp): `owners` of its members, who `requires` a member, and who is linked to the group itself.

    direct: name of the link -> its relation.
    """
    direct = direct or {"consumes": "consumes_group", "rbac_grants": "rbac_grants", "intercepts": "intercepts"}
    asked = groups.select("grp").distinct()
    members = edges.where("rel = 'in_group'").select(F.col("src").alias("member"), F.col("dst").alias("grp")).join(asked, "grp")
    through = lambda rel, how: members.join(edges.where(F.col("rel") == rel).select(F.col("src").alias("node"), F.col("dst").alias("member"), attr("version").alias("detail")), "member").select("grp", F.lit(how).alias("how"), "node", "detail")
    out = through(owns, "owners").unionByName(through(requires, "requires"))
    names = F.create_map(*[F.lit(x) for how, rel in direct.items() for x in (rel, how)])
    linked = edges.where(F.col("rel").isin(*direct.values())).select(F.col("dst").alias("grp"), names[F.col("rel")].alias("how"), F.col("src").alias("node"), attr("version").alias("detail"))
    return out.unionByName(linked.join(asked, "grp")).distinct()


def shippers(edges: DataFrame, modules: DataFrame, rel: str = "ships_module") -> DataFrame:
    """(module, image, version, via) of the images that ship each module (module)."""
    asked = modules.select(F.col("module").alias("dst")).distinct()
    return edges.where(F.col("rel") == rel).join(asked, "dst").select(F.col("dst").alias("module"), F.col("src").alias("image"), attr("version").alias("version"), attr("via").alias("via"))


def importers(edges: DataFrame, prefixes: DataFrame, rel: str = "imports_package", strip: str = "^pkg:") -> DataFrame:
    """(prefix, repo, n_packages, import_sites, n_overall) of the sources that import a package that is the prefix or lies below it, in any case of letters.

    An edge without a count is one site. n_overall is the number of distinct packages over all sources.
    """
    name = F.lower(F.regexp_replace("dst", strip, ""))
    used = edges.where(F.col("rel") == rel).select(F.col("src").alias("repo"), name.alias("package"), F.coalesce(attr("count").try_cast("bigint"), F.lit(1)).alias("sites"))
    parts = F.split("package", "/")
    spread = used.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    hit = spread.join(prefixes.select(F.lower("prefix").alias("prefix")).distinct(), "prefix")
    overall = hit.groupBy("prefix").agg(F.countDistinct("package").alias("n_overall"))
    return hit.groupBy("prefix", "repo").agg(F.countDistinct("package").alias("n_packages"), F.sum("sites").alias("import_sites")).join(overall, "prefix").select("prefix", "repo", "n_packages", "import_sites", "n_overall")


def exports(edges: DataFrame, nodes: DataFrame, rel: str = "defines", kind: Column | None = None) -> DataFrame:
    """(repo, kind, n, total): what each source defines, by kind."""
    kinds = nodes.select(F.col("id").alias("dst"), (attr("sym_kind") if kind is None else kind).alias("kind")).distinct()
    counted = edges.where(F.col("rel") == rel).join(kinds, "dst").groupBy(F.col("src").alias("repo"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("total", F.sum("n").over(W.partitionBy("repo")))


def by_digest_prefix(prefixes: DataFrame, images: DataFrame, bucket: int = 7) -> DataFrame:
    """(prefix, image_id): for each digest prefix of at least ``bucket`` digits the smallest image (digest, image_id) whose digest begins with it.

    An equi-join on the first digits, then the rest; shorter prefixes and those without an image give no rows.
    """
    short = prefixes.where(F.length("prefix") >= bucket).select("prefix", F.substring("prefix", 1, bucket).alias("__b")).distinct()
    long = images.select("digest", "image_id", F.substring("digest", 1, bucket).alias("__b"))
    return short.join(long, "__b").where(F.startswith(F.col("digest"), F.col("prefix"))).groupBy("prefix").agg(F.min("image_id").alias("image_id"))


def dependencies(found: DataFrame, most: int = 20) -> DataFrame:
    """One row per (repo, ecosystem, name) of found dependencies (and version, indirect, manifest, ordinal).

    version: the first that isn't empty; indirect only if it is so in every manifest; manifests: sorted, distinct, the
    first ``most`` of them joined by commas, truncated tells whether there are more. At most as many manifests as a
    repository has are gathered.
    """
    stated = F.when(F.coalesce("version", F.lit("")) != "", F.col("version"))
    paths = F.array_sort(F.collect_set("manifest"))
    return found.groupBy("repo", "ecosystem", "name").agg(
        F.min_by(stated, F.when(stated.isNotNull(), F.struct("ordinal", "version"))).alias("version"), F.bool_and("indirect").alias("indirect"),
        F.array_join(F.slice(paths, 1, most), ",").alias("manifests"), (F.size(paths) > most).alias("truncated"),
    )


def completeness(manifests: DataFrame, edges: DataFrame) -> DataFrame:
    """(ecosystem, n_manifests, n_edges, loud_fail): an ecosystem whose manifests gave nothing fails loudly."""
    m, e = (df.groupBy("ecosystem").agg(F.count(F.lit(1)).alias(n)) for df, n in ((manifests, "n_manifests"), (edges, "n_edges")))
    counted = m.join(e, "ecosystem", "full").select("ecosystem", F.coalesce("n_manifests", F.lit(0)).alias("n_manifests"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
    return counted.withColumn("loud_fail", (F.col("n_manifests") > 0) & (F.col("n_edges") == 0))


# ---- building layers of the graph from documents


def module_layer(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed manifests (repo, declared, name, version, indirect): who declares a module, who depends on it.

    A module that a repository declares is internal, and belongs to the last repository by name that declares it; a
    declared name that other repositories use for themselves is still one node.
    """
    declared = manifests.where("declared is not null").select(F.col("repo"), F.col("declared").alias("name")).distinct()
    owner = declared.groupBy("name").agg(F.max("repo").alias("owner_repo"))
    used = manifests.where("name is not null").groupBy("repo", "name").agg(F.max(F.struct("version", "indirect")).alias("v")).select("repo", "name", "v.version", "v.indirect")
    every = declared.select("name").unionByName(used.select("name")).distinct()
    nodes = every.join(owner, "name", "left").select(F.concat(F.lit("module:"), "name").alias("id"), F.lit("module").alias("kind"), F.col("name").alias("label"), F.to_json(F.struct(F.col("owner_repo").isNotNull().cast("int").alias("internal"), F.col("owner_repo"))).alias("attrs"))
    edges = declared.select(F.col("repo").alias("src"), F.concat(F.lit("module:"), "name").alias("dst"), F.lit("declares").alias("rel"), F.lit(None).cast("string").alias("attrs")).unionByName(
        used.select(F.col("repo").alias("src"), F.concat(F.lit("module:"), "name").alias("dst"), F.lit("depends_on").alias("rel"), F.to_json(F.struct("version", "indirect")).alias("attrs"))
    )
    return nodes, edges


INTERFACES = "crds array<struct<group:string,kind:string,scope:string>>, requires array<struct<group:string,kind:string,version:string>>, webhooks array<struct<group:string,mutating:boolean,resources:array<string>>>, rbac array<struct<groups:array<string>,verbs:array<string>>>, literals map<string,int>"


def interface_layer(signals: DataFrame) -> DataFrame:
    """Edges of interface signals (repo, doc as INTERFACES): owns_crd, requires_crd, in_group, intercepts, rbac_grants, consumes_group.

    Grants are one per repository and group, with the union of their verbs; ``*`` among them or among the groups is a
    wildcard. Group literals below two uses are noise.
    """
    crd = lambda c: F.concat(F.lit("crd:"), c["group"], F.lit("/"), c["kind"])
    group = lambda g: F.concat(F.lit("apigroup:"), g)
    edge = lambda src, dst, rel, attrs=None: (src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), (F.lit(None).cast("string") if attrs is None else attrs).alias("attrs"))
    part = lambda name: signals.select("repo", F.explode(f"doc.{name}").alias("c"))
    c = F.col("c")
    owned = part("crds").select(*edge(F.col("repo"), crd(c), "owns_crd", F.to_json(F.struct(c["scope"].alias("scope")))))
    grouped = part("crds").select(*edge(crd(c), group(c["group"]), "in_group"))
    required = part("requires").select(*edge(F.col("repo"), crd(c), "requires_crd", F.to_json(F.struct(c["version"].alias("version")))))
    hooks = part("webhooks").select(*edge(F.col("repo"), group(c["group"]), "intercepts", F.to_json(F.struct(c["mutating"].alias("mutating"), F.array_sort(c["resources"]).alias("resources")))))
    grants = part("rbac").select("repo", F.explode(c["groups"]).alias("g"), c["verbs"].alias("verbs")).groupBy("repo", "g").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("verbs")))).alias("verbs"))
    granted = grants.select(*edge(F.col("repo"), group(F.col("g")), "rbac_grants", F.to_json(F.struct("verbs", (F.array_contains("verbs", "*") | (F.col("g") == "*")).alias("wildcard")))))
    literal = signals.select("repo", F.explode("doc.literals").alias("g", "n")).where("n >= 2").select(*edge(F.col("repo"), group(F.col("g")), "consumes_group", F.to_json(F.struct(F.lit("literal").alias("evidence"), F.col("n").alias("count")))))
    return owned.unionByName(grouped).unionByName(required).unionByName(hooks).unionByName(granted).unionByName(literal).distinct()


def artifact_layer(images: DataFrame, components: DataFrame, repos: DataFrame) -> DataFrame:
    """Edges of images (digest, tag, repo_url, ref) and component lists (subject: a digest or its prefix, name, version).

    `built_from` leads from an image to the repository (id, url) whose URL is the same but for scheme, case and .git;
    `ships_package` from the image that a list's subject names to each component.
    """
    key = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "^[a-z+]+://", ""), r"(\.git)?/*$", "")
    image = F.concat(F.lit("image:sha256:"), "digest")
    known = repos.groupBy(key(F.col("url")).alias("__k")).agg(F.min("id").alias("id"))
    built = images.withColumn("__k", key(F.col("repo_url"))).join(known, "__k").select(image.alias("src"), F.col("id").alias("dst"), F.lit("built_from").alias("rel"), F.to_json(F.struct("ref", "tag")).alias("attrs"))
    subject = F.regexp_replace("subject", "^sha256:", "")
    named = by_digest_prefix(components.select(subject.alias("prefix")), images.select("digest", image.alias("image_id")))
    shipped = components.withColumn("prefix", subject).join(named, "prefix").groupBy("image_id", "name").agg(F.max("version").alias("version"))
    return built.unionByName(shipped.select(F.col("image_id").alias("src"), F.concat(F.lit("package:"), "name").alias("dst"), F.lit("ships_package").alias("rel"), F.to_json(F.struct("version")).alias("attrs"))).distinct()


def symbol_layer(symbols: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges of symbols (repo, file, name, line) and import sites (repo, package): `defines`, and `imports_package` with the number of sites.

    An import below an internal module (module) is marked with the longest one that holds it.
    """
    from quarryline.operators.relational import prefix_join

    place = F.concat_ws("", F.lit("symbol:"), "repo", F.lit("/"), "file", F.lit("#"), "name", F.lit(":"), F.col("line").cast("string"))
    defined = symbols.select(F.col("repo").alias("src"), place.alias("dst"), F.lit("defines").alias("rel"), F.lit(None).cast("string").alias("attrs"))
    counted = imports.groupBy("repo", "package").agg(F.count(F.lit(1)).alias("count"))
    marked = counted.join(prefix_join(counted.select("package").distinct(), "package", modules, "module"), "package")
    used = marked.select(F.col("repo").alias("src"), F.concat(F.lit("srcpkg:"), "package").alias("dst"), F.lit("imports_package").alias("rel"), F.to_json(F.struct("count", "module")).alias("attrs"))
    return defined.unionByName(used)
