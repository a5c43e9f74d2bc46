"""The graph's named questions with their arguments, and its layers built from documents.

The test graph has none of the relations that lead to CRDs, images and symbols, so relations it has stand for them;
documents that layers are built from are written from the graph's own edges, which the layers must give back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import graph
from quarryline.operators import relational as rel
from quarryline.plans.registry import registry
from quarryline.plans.relational import L, R, links, repos
from quarryline.sources import readers
from quarryline.workspace import table

QUERIES, SQL, query = registry()
_V, _I = "json_extract_string(attrs, '$.version')", "json_extract_string(attrs, '$.indirect')"
_ASKED = "t AS (SELECT dst AS target FROM l WHERE rel = 'depends_on' GROUP BY 1 HAVING count(DISTINCT src) >= 3)"


@query(f"""WITH {L}, {_ASKED}, q AS (SELECT dst AS target, src AS node, {_V} AS detail, {_I} = 'true' AS indirect FROM l JOIN t ON t.target = l.dst WHERE rel = 'depends_on'),
  n AS (SELECT target, count(DISTINCT node) AS repo_count FROM q GROUP BY 1), k AS (SELECT id, max(kind) AS kind FROM nodes GROUP BY 1),
  s AS (SELECT DISTINCT q.target, l.src AS node, k.kind AS detail, CAST(NULL AS BOOLEAN) AS indirect FROM q JOIN l ON l.dst = q.node AND l.rel IN ('ships', 'contains', 'includes') JOIN k ON k.id = l.src),
  u AS (SELECT target, 'requires' AS part, node, detail, indirect FROM q UNION ALL SELECT target, 'surface', node, detail, indirect FROM s)
  SELECT u.target, part, row_number() OVER (PARTITION BY u.target, part ORDER BY indirect NULLS FIRST, node)::INT AS place, node, detail, CAST(indirect AS VARCHAR) AS indirect, repo_count FROM u JOIN n USING (target)""")
def grf_01_sort_03_join_04_blast_radius(s, d):
    edges = links(s, d)
    asked = edges.where("rel = 'depends_on'").groupBy(F.col("dst").alias("target")).agg(F.countDistinct("src").alias("n")).where("n >= 3")
    return graph.blast_radius(edges, table(s, d, "nodes"), asked).withColumn("indirect", F.col("indirect").cast("string"))


_TOP = "n AS (SELECT id, max(label) AS label, max(attrs) AS na FROM nodes GROUP BY 1), c AS (SELECT dst, count(DISTINCT src) AS dependents FROM l WHERE rel = 'depends_on' GROUP BY 1), x AS (SELECT dst, label, dependents, json_extract_string(na, '$.internal') AS internal, coalesce(json_extract_string(na, '$.ecosystem'), 'Go') AS ecosystem, json_extract_string(na, '$.owner_repo') AS owner, json_extract_string(na, '$.sustaining_fork') AS fork FROM c JOIN n ON n.id = c.dst)"


@query(f"WITH {L}, {_TOP} SELECT * FROM x ORDER BY dependents DESC, dst LIMIT 20")
def grf_02_agg_02_sort_01_shared(s, d):
    return graph.top_shared(links(s, d), table(s, d, "nodes"), 20)


@query(f"WITH {L}, {_TOP} SELECT * FROM x WHERE internal = '1' ORDER BY dependents DESC, dst LIMIT 20")
def grf_03_agg_03_internal(s, d):
    return graph.top_shared(links(s, d), table(s, d, "nodes"), 20, internal=True)


@query(f"""WITH {L}, g AS (SELECT DISTINCT dst AS grp FROM l WHERE rel = 'in_group'), m AS (SELECT src AS member, dst AS grp FROM l WHERE rel = 'in_group')
  SELECT DISTINCT m.grp, 'owners' AS how, l.src AS node, {_V} AS detail FROM m JOIN l ON l.dst = m.member AND l.rel = 'owns'
  UNION ALL SELECT DISTINCT m.grp, 'requires', l.src, {_V} FROM m JOIN l ON l.dst = m.member AND l.rel = 'depends_on'
  UNION ALL SELECT DISTINCT g.grp, CASE rel WHEN 'consumes_group' THEN 'consumes' WHEN 'declares' THEN 'rbac_grants' ELSE 'intercepts' END, l.src, {_V} FROM g JOIN l ON l.dst = g.grp AND l.rel IN ('consumes_group', 'declares', 'ships_package')""")
def grf_04_join_05_06_consumers(s, d):
    edges = links(s, d)
    groups = edges.where("rel = 'in_group'").select(F.col("dst").alias("grp"))
    return graph.group_consumers(edges, groups, "owns", {"consumes": "consumes_group", "rbac_grants": "declares", "intercepts": "ships_package"}, "depends_on")


@query(f"WITH {L}, m AS (SELECT dst FROM l WHERE rel = 'ships_package' GROUP BY 1 HAVING count(*) >= 2) SELECT dst AS module, src AS image, {_V} AS version, json_extract_string(attrs, '$.via') AS via FROM l WHERE rel = 'ships_package' AND dst IN (SELECT dst FROM m)")
def grf_05_ships_module(s, d):
    edges = links(s, d)
    asked = edges.where("rel = 'ships_package'").groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("n")).where("n >= 2")
    return graph.shippers(edges, asked, "ships_package")


@query(f"""WITH {L}, u AS (SELECT src AS repo, lower(regexp_replace(dst, '^pkg:', '')) AS package, coalesce(try_cast(json_extract_string(attrs, '$.count') AS BIGINT), 1) AS sites FROM l WHERE rel = 'imports_package'),
  p AS (SELECT DISTINCT array_to_string(string_split(package, '/')[1:2], '/') AS prefix FROM u), h AS (SELECT * FROM u JOIN p ON package = prefix OR starts_with(package, prefix || '/')), o AS (SELECT prefix, count(DISTINCT package) AS n_overall FROM h GROUP BY 1)
  SELECT prefix, repo, count(DISTINCT package) AS n_packages, sum(sites)::BIGINT AS import_sites, any_value(n_overall) AS n_overall FROM h JOIN o USING (prefix) GROUP BY 1, 2""")
def grf_06_agg_05_imports(s, d):
    edges = links(s, d)
    prefixes = edges.where("rel = 'imports_package'").select(F.upper(F.concat_ws("/", F.slice(F.split(F.regexp_replace("dst", "^pkg:", ""), "/"), 1, 2))).alias("prefix"))
    return graph.importers(edges, prefixes)


@query(f"WITH {L}, k AS (SELECT DISTINCT id, kind FROM nodes), c AS (SELECT src AS repo, kind, count(*) AS n FROM l JOIN k ON k.id = l.dst WHERE rel = 'declares' GROUP BY ALL) SELECT *, sum(n) OVER (PARTITION BY repo)::BIGINT AS total FROM c")
def grf_07_agg_06_exports(s, d):
    return graph.exports(links(s, d), table(s, d, "nodes"), "declares", F.col("kind"))


@query(f"WITH {L}, k AS (SELECT id, max(label) AS label FROM nodes WHERE kind = 'release' GROUP BY 1) SELECT l.src AS repo, k.id AS image, k.label, json_extract_string(attrs, '$.via') AS via FROM l JOIN k ON k.id = l.dst JOIN (SELECT DISTINCT id FROM nodes) r ON r.id = l.src WHERE rel IN ('contains', 'includes')")
def join_08_images(s, d):
    nodes = table(s, d, "nodes")
    images = nodes.where("kind = 'release'").groupBy(F.col("id").alias("image")).agg(F.max("label").alias("label"))
    built = links(s, d).where("rel in ('contains', 'includes')").select(F.col("src").alias("repo"), F.col("dst").alias("image"), graph.attr("via").alias("via"))
    return built.join(images, "image").join(nodes.select(F.col("id").alias("repo")).distinct(), "repo").select("repo", "image", "label", "via")


@query("""WITH i AS (SELECT DISTINCT sha256(id) AS digest, id AS image_id FROM nodes), p AS (SELECT DISTINCT substr(sha256(id), 1, 6 + length(id) % 5) AS prefix FROM nodes)
  SELECT prefix, min(image_id) AS image_id FROM p JOIN i ON starts_with(digest, prefix) WHERE length(prefix) >= 7 GROUP BY 1""")
def join_10_digest_prefix(s, d):
    n = table(s, d, "nodes").select("id").distinct()
    images = n.select(F.sha2("id", 256).alias("digest"), F.col("id").alias("image_id"))
    return graph.by_digest_prefix(n.select(F.substring(F.sha2("id", 256), F.lit(1), 6 + F.length("id") % 5).alias("prefix")), images)


@query(f"""WITH e AS (SELECT DISTINCT src AS repo, split_part(dst, ':', 1) AS ecosystem, dst AS name, rel AS manifest, {_V} AS version, {_I} = 'true' AS indirect FROM edges WHERE rel IN ('depends_on', 'declares', 'imports_package', 'ships_package', 'consumes_group'))
  SELECT repo, ecosystem, name, arg_min(version, (manifest, version)) FILTER (WHERE version <> '') AS version, CAST(bool_and(indirect) AS VARCHAR) AS indirect, array_to_string(list_sort(list_distinct(list(manifest)))[1:1], ',') AS manifests, count(DISTINCT manifest) > 1 AS truncated FROM e GROUP BY 1, 2, 3""")
def agg_34_dependencies(s, d):
    e = table(s, d, "edges").where(F.col("rel").isin("depends_on", "declares", "imports_package", "ships_package", "consumes_group"))
    found = e.select(F.col("src").alias("repo"), F.substring_index("dst", ":", 1).alias("ecosystem"), F.col("dst").alias("name"), F.col("rel").alias("manifest"), F.col("rel").alias("ordinal"), graph.attr("version").alias("version"), (graph.attr("indirect") == "true").alias("indirect")).distinct()
    return graph.dependencies(found, 1).withColumn("indirect", F.col("indirect").cast("string"))


@query("WITH m AS (SELECT kind AS ecosystem, count(*) AS n_manifests FROM (SELECT DISTINCT id, kind FROM nodes) GROUP BY 1), e AS (SELECT split_part(dst, ':', 1) AS ecosystem, count(*) AS n_edges FROM (SELECT DISTINCT src, dst FROM edges WHERE rel = 'depends_on') GROUP BY 1) SELECT ecosystem, coalesce(n_manifests, 0) AS n_manifests, coalesce(n_edges, 0) AS n_edges, coalesce(n_manifests, 0) > 0 AND coalesce(n_edges, 0) = 0 AS loud_fail FROM m FULL JOIN e USING (ecosystem)")
def agg_35_completeness(s, d):
    manifests = table(s, d, "nodes").select("id", F.col("kind").alias("ecosystem")).distinct()
    return graph.completeness(manifests, table(s, d, "edges").where("rel = 'depends_on'").select("src", "dst").distinct().select(F.substring_index("dst", ":", 1).alias("ecosystem")))


@query(f"WITH e AS (SELECT DISTINCT src, dst, rel, {_I} = 'true' AS indirect FROM edges) SELECT src, dst, array_to_string(list_sort(list_distinct(list(rel))), ',') AS verbs, coalesce(bool_or(indirect), false) AS wildcard FROM e GROUP BY 1, 2")
def agg_36_grants(s, d):
    e = table(s, d, "edges").select("src", "dst", F.array("rel").alias("verbs"), F.coalesce(graph.attr("indirect") == "true", F.lit(False)).alias("wild")).distinct()
    return e.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("verbs")))), ",").alias("verbs"), F.bool_or("wild").alias("wildcard"))


@query("SELECT build_no, built_at, date_diff('day', CAST(substr(built_at, 1, 10) AS DATE), DATE '2025-06-01')::INT AS age_days, (SELECT max(loaded_at) FROM repos) > CAST(substr(built_at, 1, 19) AS TIMESTAMP) AS inputs_newer, date_diff('day', CAST(substr(built_at, 1, 10) AS DATE), DATE '2025-06-01') > 30 OR (SELECT max(loaded_at) FROM repos) > CAST(substr(built_at, 1, 19) AS TIMESTAMP) AS stale FROM (SELECT build_no, max(value) AS built_at FROM meta WHERE key = 'built_at' AND value IS NOT NULL GROUP BY 1)")
def grf_15_freshness_of_builds(s, d):
    built = table(s, d, "meta").where("key = 'built_at' and value is not null").groupBy("build_no").agg(F.max("value").alias("built_at"))
    newest = table(s, d, "repos").agg(F.max("loaded_at").alias("newest"))  # one row
    age = F.datediff(F.lit("2025-06-01").cast("date"), F.substring("built_at", 1, 10).cast("date"))
    newer = F.col("newest") > F.substring("built_at", 1, 19).cast("timestamp_ntz")
    return built.crossJoin(F.broadcast(newest)).select("build_no", "built_at", age.alias("age_days"), newer.alias("inputs_newer"), ((age > 30) | newer).alias("stale"))


# ---- layers built from documents

def _go_files(s, d):
    """Per source a module file that declares it and requires what it depends on."""
    dep = links(s, d).where("rel = 'depends_on'").select("src", F.concat_ws(" ", F.lit("\t"), F.col("dst"), F.coalesce(graph.attr("version"), F.lit("v0")), F.when(graph.attr("indirect") == "true", "// indirect")).alias("line"))
    files = dep.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    return files.select(F.concat("src", F.lit("/go.mod")).alias("path"), F.concat(F.lit("module "), "src", F.lit("\nrequire (\n"), "lines", F.lit("\n)\n")).alias("text"))


def _go_manifests(s, d):
    return readers.manifests(_go_files(s, d)).select(F.regexp_replace("path", "/go.mod$", "").alias("repo"), "declared", "name", "version", "indirect")


@query(f"""WITH {L}, g AS (SELECT src, dst, coalesce({_V}, 'v0') AS version, coalesce({_I} = 'true', false) AS indirect FROM l WHERE rel = 'depends_on')
  SELECT src, 'module:' || dst AS dst, 'depends_on' AS rel, version, CAST(indirect AS VARCHAR) AS indirect FROM g UNION ALL SELECT DISTINCT src, 'module:' || src, 'declares', NULL, NULL FROM g""")
def grf_09_module_edges(s, d):
    _, edges = graph.module_layer(_go_manifests(s, d))
    return edges.select("src", "dst", "rel", graph.attr("version").alias("version"), graph.attr("indirect").alias("indirect"))


@query(f"WITH {L}, g AS (SELECT src, dst FROM l WHERE rel = 'depends_on') SELECT 'module:' || x.id AS id, x.id AS label, CASE WHEN o.src IS NULL THEN '0' ELSE '1' END AS internal, o.src AS owner FROM (SELECT src AS id FROM g UNION SELECT dst FROM g) x LEFT JOIN (SELECT DISTINCT src FROM g) o ON o.src = x.id")
def grf_09_module_nodes(s, d):
    nodes, _ = graph.module_layer(_go_manifests(s, d))
    return nodes.select("id", "label", graph.attr("internal").alias("internal"), graph.attr("owner_repo").alias("owner"))


#: Relation -> path of the manifest that it's written to, with the ecosystem.
_FORMATS = {"depends_on": ("go.mod", "go"), "imports_package": ("package.json", "npm"), "ships_package": ("Cargo.lock", "cargo"), "declares": ("gradle.lockfile", "maven")}


def _all_files(s, d):
    e = links(s, d).where(F.col("rel").isin(*_FORMATS)).select("src", "rel", "dst", F.coalesce(graph.attr("version"), F.lit("v0")).alias("v"))
    line = (
        F.when(F.col("rel") == "depends_on", F.concat_ws(" ", F.lit("require"), "dst", "v")).when(F.col("rel") == "imports_package", F.concat(F.lit('"'), "dst", F.lit('":"'), "v", F.lit('"')))
        .when(F.col("rel") == "ships_package", F.concat(F.lit('[[package]]\nname = "'), "dst", F.lit('"\nversion = "'), "v", F.lit('"'))).otherwise(F.concat("dst", F.lit(":"), "v", F.lit("=runtime")))
    )
    joined = e.select("src", "rel", line.alias("line")).groupBy("src", "rel").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    body = F.when(F.col("rel") == "imports_package", F.concat(F.lit('{"dependencies": {'), F.array_join("lines", ","), F.lit("}}"))).otherwise(F.array_join("lines", "\n"))
    path = F.create_map(*[F.lit(x) for rel, (name, _) in _FORMATS.items() for x in (rel, name)])[F.col("rel")]
    return joined.select(F.concat_ws("/", "src", path).alias("path"), body.alias("text"))


@query(f"WITH {L} SELECT src AS repo, CASE rel WHEN 'depends_on' THEN 'go' WHEN 'imports_package' THEN 'npm' WHEN 'ships_package' THEN 'cargo' ELSE 'maven' END AS ecosystem, dst AS name, coalesce({_V}, 'v0') AS version FROM l WHERE rel IN ('depends_on', 'imports_package', 'ships_package') OR (rel = 'declares' AND len(string_split(dst, ':')) = 2)")
def grf_10_ecosystems(s, d):
    ecosystem = F.create_map(*[F.lit(x) for name, eco in _FORMATS.values() for x in (name, eco)])[F.substring_index("path", "/", -1)]
    found = readers.manifests(_all_files(s, d)).select(F.regexp_replace("path", "/[^/]*$", "").alias("repo"), ecosystem.alias("ecosystem"), "name", "version", F.coalesce("indirect", F.lit(False)).alias("indirect"), F.col("path").alias("manifest"), F.col("path").alias("ordinal"))
    return graph.dependencies(found).select("repo", "ecosystem", "name", "version")


@query(f"""WITH {L}, refs AS (SELECT l.src AS repo, l.dst AS ref FROM l JOIN (SELECT DISTINCT id FROM nodes WHERE kind = 'repo-ref') n ON n.id = l.dst WHERE rel = 'has_ref')
  SELECT refs.ref AS src, 'module:' || g.dst AS dst, coalesce({_V}, 'v0') AS version, refs.ref AS at FROM refs JOIN l g ON g.src = refs.repo AND g.rel = 'depends_on'""")
def grf_11_ref_dependencies(s, d):
    chosen = links(s, d).where("rel = 'has_ref'").join(table(s, d, "nodes").where("kind = 'repo-ref'").select(F.col("id").alias("dst")).distinct(), "dst").select(F.col("src").alias("repo"), F.col("dst").alias("ref"))
    at_ref = _go_manifests(s, d).join(chosen, "repo")
    return at_ref.select(F.col("ref").alias("src"), F.concat(F.lit("module:"), "name").alias("dst"), "version", F.col("ref").alias("at"))


@query(f"""WITH {L}, x AS (SELECT src AS repo, rel, split_part(dst, ':', 1) AS g, split_part(dst, ':', 2) AS k, {_V} AS v FROM l)
  SELECT DISTINCT repo AS src, 'crd:' || g || '/' || k AS dst, 'owns_crd' AS rel, NULL AS detail FROM x WHERE rel = 'owns'
  UNION ALL SELECT DISTINCT 'crd:' || g || '/' || k, 'apigroup:' || g, 'in_group', NULL FROM x WHERE rel = 'owns'
  UNION ALL SELECT DISTINCT repo, 'crd:' || g || '/' || k, 'requires_crd', v FROM x WHERE rel = 'depends_on'
  UNION ALL SELECT repo, 'apigroup:' || g, 'rbac_grants', array_to_string(list_sort(list_distinct(list(k))), ',') FROM x WHERE rel = 'declares' GROUP BY repo, g
  UNION ALL SELECT repo, 'apigroup:' || g, 'consumes_group', CAST(count(*) AS VARCHAR) FROM x WHERE rel = 'consumes_group' GROUP BY repo, g HAVING count(*) >= 2""")
def grf_12_interfaces(s, d):
    x = links(s, d).select(F.col("src").alias("repo"), "rel", F.substring_index("dst", ":", 1).alias("group"), F.get(F.split("dst", ":"), F.lit(1)).alias("kind"), graph.attr("version").alias("version"))
    pick = lambda rel, *cols: F.array_compact(F.collect_list(F.when(F.col("rel") == rel, F.struct(*cols))))
    literal = x.where("rel = 'consumes_group'").groupBy("repo", "group").agg(F.count("*").cast("int").alias("n")).groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("group", "n"))).alias("literals"))
    docs = x.groupBy("repo").agg(pick("owns", "group", "kind").alias("crds"), pick("depends_on", "group", "kind", "version").alias("requires"), pick("declares", F.array("group").alias("groups"), F.array("kind").alias("verbs")).alias("rbac")).join(literal, "repo", "left")
    parsed = docs.select("repo", F.from_json(F.to_json(F.struct("crds", "requires", "rbac", "literals")), graph.INTERFACES).alias("doc"))
    edges = graph.interface_layer(parsed)
    detail = F.when(F.col("rel") == "requires_crd", graph.attr("version")).when(F.col("rel") == "rbac_grants", F.array_join(F.from_json(graph.attr("verbs"), "array<string>"), ",")).when(F.col("rel") == "consumes_group", graph.attr("count"))
    return edges.select("src", "dst", "rel", detail.alias("detail"))


@query(f"""WITH {L}, i AS (SELECT DISTINCT sha256(id) AS digest, id FROM nodes WHERE kind = 'category'), r AS (SELECT min(id) AS id, lower(regexp_replace(id, '^repo:', '')) AS k FROM nodes WHERE kind = 'repo' GROUP BY 2)
  SELECT 'image:sha256:' || i.digest AS src, r.id AS dst, 'built_from' AS rel, NULL AS version FROM i JOIN l ON l.dst = i.id AND l.rel IN ('contains', 'includes', 'owns') JOIN r ON 'repo:' || r.k = lower(l.src)
  UNION SELECT 'image:sha256:' || i.digest, 'package:' || l.dst, 'ships_package', max({_V}) FROM i JOIN l ON l.src = i.id AND l.rel = 'ships_package' GROUP BY 1, 2""")
def grf_13_artifacts(s, d):
    nodes, edges = table(s, d, "nodes"), links(s, d)
    image = nodes.where("kind = 'category'").select("id").distinct()
    holder = edges.where("rel in ('contains', 'includes', 'owns')").select(F.col("dst").alias("id"), F.concat(F.lit("HTTPS://"), F.upper(F.regexp_replace("src", "^repo:", "")), F.lit(".git")).alias("repo_url"), F.col("src").startswith("repo:").alias("fine")).where("fine").drop("fine")
    images = image.join(holder, "id", "left").select(F.sha2("id", 256).alias("digest"), F.lit("latest").alias("tag"), "repo_url", F.lit(None).cast("string").alias("ref"))
    lists = image.join(edges.where("rel = 'ships_package'").select(F.col("src").alias("id"), F.col("dst").alias("name"), graph.attr("version").alias("version")), "id").select(F.concat(F.lit("sha256:"), F.substring(F.sha2("id", 256), 1, 16)).alias("subject"), "name", "version")
    known = nodes.where("kind = 'repo'").select("id", F.regexp_replace("id", "^repo:", "").alias("url")).distinct()
    return graph.artifact_layer(images, lists, known).select("src", "dst", "rel", graph.attr("version").alias("version"))


@query(f"""WITH {L}, m AS (SELECT DISTINCT array_to_string(string_split(dst, '/')[1:2], '/') AS module FROM l WHERE rel = 'ships_package'), u AS (SELECT src, dst FROM l WHERE rel IN ('imports_package', 'ships_package'))
  SELECT src, 'srcpkg:' || dst AS dst, 'imports_package' AS rel, count(*) AS n, (SELECT m.module FROM m WHERE u.dst = m.module OR starts_with(u.dst, m.module || '/') ORDER BY length(m.module) DESC LIMIT 1) AS module FROM u GROUP BY u.src, u.dst
  UNION ALL SELECT src, 'symbol:' || src || '/main.go#' || dst || ':1', 'defines', NULL, NULL FROM l WHERE rel = 'declares'""")
def grf_14_join_09_symbols(s, d):
    edges = links(s, d)
    symbols = edges.where("rel = 'declares'").select(F.col("src").alias("repo"), F.lit("main.go").alias("file"), F.col("dst").alias("name"), F.lit(1).alias("line"))
    imports = edges.where("rel in ('imports_package', 'ships_package')").select(F.col("src").alias("repo"), F.col("dst").alias("package"))
    modules = edges.where("rel = 'ships_package'").select(F.concat_ws("/", F.slice(F.split("dst", "/"), 1, 2)).alias("module")).distinct()
    out = graph.symbol_layer(symbols, imports, modules)
    return out.select("src", "dst", "rel", graph.attr("count").cast("bigint").alias("n"), graph.attr("module").alias("module"))


@query("""WITH e AS (SELECT DISTINCT src, dst, rel FROM edges), n AS (SELECT DISTINCT id, kind FROM nodes)
  SELECT 'nodes' AS section, kind AS key, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edges', rel, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'sources', rel, count(DISTINCT src) FROM e GROUP BY 2
  UNION ALL SELECT 'no_edges', 'nodes', count(*) FROM n WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)""")
def snk_12_agg_01_stats(s, d):
    e, n = table(s, d, "edges").select("src", "dst", "rel").distinct(), table(s, d, "nodes").select("id", "kind").distinct()
    part = lambda df, name, key, agg: df.groupBy(F.lit(name).alias("section"), F.col(key).alias("key")).agg(agg.alias("n"))
    used = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    alone = n.join(used, "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("no_edges").alias("section"), F.lit("nodes").alias("key"), "n")
    return part(n, "nodes", "kind", F.count("*")).unionByName(part(e, "edges", "rel", F.count("*"))).unionByName(part(e, "sources", "rel", F.countDistinct("src"))).unionByName(alone)


@query("WITH e AS (SELECT src, dst, rel, max(attrs) AS attrs FROM edges GROUP BY ALL), old AS (SELECT * FROM e WHERE rel < 'd' OR rel = 'in_group'), now AS (SELECT src, dst, rel, coalesce(attrs, '{}') || '+' AS attrs FROM e WHERE rel >= 'in') SELECT * FROM now UNION ALL SELECT * FROM old WHERE rel < 'in'")
def snk_02_03_replaced(s, d):
    e = links(s, d)
    old, now = e.where("rel < 'd' or rel = 'in_group'"), e.where("rel >= 'in'").select("src", "dst", "rel", F.concat(F.coalesce("attrs", F.lit("{}")), F.lit("+")).alias("attrs"))
    return rel.upsert(old.withColumn("ordinal", F.lit(1)), now.withColumn("ordinal", F.lit(2)), ["src", "dst", "rel"], "ordinal").drop("ordinal")


@query("""WITH n AS (SELECT id, max(label) AS label, max(coalesce(attrs, '{}')) AS attrs FROM nodes GROUP BY 1), o AS (SELECT DISTINCT dst AS id FROM edges WHERE rel = 'owns')
  SELECT n.id, CASE WHEN o.id IS NOT NULL THEN '1' ELSE json_extract_string(attrs, '$.internal') END AS internal, CASE WHEN o.id IS NOT NULL THEN 'x' END AS owner FROM n LEFT JOIN o USING (id)""")
def snk_06_json_set(s, d):
    n = table(s, d, "nodes").groupBy("id").agg(F.max(F.coalesce("attrs", F.lit("{}"))).alias("attrs"))
    owned = table(s, d, "edges").where("rel = 'owns'").select(F.col("dst").alias("id")).distinct().withColumn("set", F.create_map(F.lit("internal"), F.lit("1"), F.lit("owner"), F.lit("x")))
    now = rel.json_updated(n.join(owned, "id", "left"), "attrs", "set")
    return now.select("id", graph.attr("internal").alias("internal"), graph.attr("owner").alias("owner"))


@query(f"""WITH {R}, k AS (SELECT repo_key, repo_url, base_slug, tree FROM r), o AS (SELECT * FROM k WHERE tree <> 'partner'), n AS (SELECT * FROM k WHERE tree <> 'upstream')
  SELECT coalesce(o.repo_key, n.repo_key) AS repo_key, CASE WHEN n.repo_key IS NULL THEN o.tree ELSE coalesce('new-' || n.tree, o.tree) END AS tree, CASE WHEN o.repo_key IS NOT NULL THEN o.base_slug END AS pqc, CASE WHEN n.repo_key IS NULL THEN o.repo_url ELSE NULL END AS url FROM o FULL JOIN n ON o.repo_key = n.repo_key""")
def snk_04_preserved(s, d):
    k = repos(s, d)
    old = k.where("tree <> 'partner'").select("repo_key", F.map_filter(F.create_map(F.lit("tree"), "tree", F.lit("pqc"), "base_slug", F.lit("url"), "repo_url"), lambda _, v: v.isNotNull()).alias("m"))
    new = k.where("tree <> 'upstream'").select("repo_key", F.create_map(F.lit("tree"), F.concat(F.lit("new-"), "tree")).alias("m"))
    merged = rel.preserve_merge(old, new, "repo_key", "m", ["pqc"])
    return merged.select("repo_key", *[F.try_element_at("m", F.lit(c)).alias(c) for c in ("tree", "pqc", "url")])


@query("WITH e AS (SELECT DISTINCT src, dst, rel FROM edges), old AS (SELECT src, dst, min(rel) AS rel FROM e WHERE rel IN ('owns', 'contains') GROUP BY 1, 2) SELECT * FROM old UNION ALL SELECT src, dst, min(rel) FROM e WHERE (src, dst) NOT IN (SELECT (src, dst) FROM old) GROUP BY 1, 2")
def snk_05_win_14_first_wins(s, d):
    e = table(s, d, "edges").select("src", "dst", "rel").distinct()
    return rel.first_wins(e.where("rel in ('owns', 'contains')").groupBy("src", "dst").agg(F.min("rel").alias("rel")), e, ["src", "dst"], "rel")
