"""JSON records whose fields and types change from file to file.

A registry keeps one row per file: its fields with their types and a fingerprint of them. Consecutive files of a
producer and dataset with the same fingerprint need no further look; for the others the registry keeps the steps
(rename, add, remove, retype) between them, and only for fields new beside fields gone the values of the two files are
read again, as hashes. Chains of renames lead each file's fields to one name per field, casts and defaults bring their
values into one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.workspace import children, materialize, workspace

#: Fields that identify a record, by dataset; fixed values.
RECORD_KEYS = {"repos": ["repo_key"], "findings": ["repo_key", "finding_id"], "meta": ["key"]}
#: The consistent tables' fields with their types, by dataset; fixed values.
TARGETS = {
    "repos": {"tree": "string", "ownership": "string", "report_kind": "string", "audit_date": "string", "repo_url": "string", "is_branch_audit": "int"},
    "findings": {"title": "string", "severity": "string", "cvss_score": "double", "cwes": "array<string>", "control_refs": "array<string>", "resolution": "string"},
    "meta": {"value": "string"},
}
#: Fields with a rule of their own beyond the type's; fixed values. Every other field goes by its type.
RULES = {"report_kind": "kind", "control_refs": "refs", "value": "json"}
#: Other names of the consistent tables' fields, by dataset: the explicit step of the migration where a chain of renames
#: breaks (renamed and wrapped in one file, back under another name after a file without it); fixed values.
ALIASES = {
    "repos": {"kind": "report_kind", "reportKind": "report_kind", "audit_type": "report_kind", "audited_on": "audit_date", "date": "audit_date", "url": "repo_url", "repository": "repo_url", "branch_audit": "is_branch_audit", "owner_class": "ownership"},
    "findings": {"controlRefs": "control_refs", "controls": "control_refs", "framework_controls": "control_refs", "cvssScore": "cvss_score", "score": "cvss_score", "cwe_list": "cwes", "weaknesses": "cwes", "status": "resolution"},
    "meta": {"val": "value", "meta_value": "value", "content": "value"},
}
#: Values of fields that a record doesn't give; fixed values. Every other field is NULL then.
DEFAULTS = {"repos": {"is_branch_audit": 0}, "findings": {"resolution": "open"}, "meta": {}}
#: Codes of report kinds, in the order in which the projection states them; fixed values.
KIND_CODES = {"1": "code-audit", "2": "cloud-config", "3": "container-audit"}
#: Names under which an object holds a value that is wrapped in it; fixed values.
WRAPPERS = ("v", "value", "id", "ref")
LINE = ["producer", "dataset"]


def json_kind(value: Column) -> Column:
    """JSON type of a variant: string, number, boolean, object, array, null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("number")
    )


def json_type(value: Column) -> Column:
    """As json_kind; an array also names the set of its elements' types (NULL elements don't count)."""
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), json_kind), lambda k: k != "null")))
    return F.when(json_kind(value) == "array", F.concat(F.lit("array["), F.array_join(kinds, ","), F.lit("]"))).otherwise(json_kind(value))


def parse_records(raw: DataFrame) -> DataFrame:
    """producer, dataset, file_no, file_name, record (JSON key or NULL), fields (map of name to variant, without the key).

    Lines that aren't valid JSON, aren't objects, or are NULL keep their file and have NULL fields. Unknown datasets
    have no record key.
    """
    doc = raw.select(*LINE, "file_no", "file_name", F.try_parse_json("body").alias("doc"))
    fields = doc.select(*LINE, "file_no", "file_name", F.when(F.schema_of_variant("doc").startswith("OBJECT"), F.try_variant_get("doc", "$", "map<string, variant>")).alias("fields"))
    record, own = F.lit(None).cast("string"), F.array().cast("array<string>")
    for name, keys in RECORD_KEYS.items():
        parts = [F.try_variant_get(F.col("fields")[k], "$", "string") for k in keys]
        whole = F.lit(True)
        for part in parts:
            whole = whole & part.isNotNull()
        record = F.when((F.col("dataset") == name) & whole, F.to_json(F.array(*parts))).otherwise(record)
        own = F.when(F.col("dataset") == name, F.array(*map(F.lit, keys))).otherwise(own)
    return fields.select(*LINE, "file_no", "file_name", record.alias("record"), F.map_filter("fields", lambda k, v: ~F.array_contains(own, k)).alias("fields"))


_FILES = "producer string, dataset string, file_no int, file_name string, fields map<string,string>, fingerprint string"
_STEPS = "file_name string, before string, new_field string, old_field string, new_types string, old_types string, kind string"


class SchemaRegistry:
    """Fingerprints of files and the steps between consecutive ones, kept in a folder; files known there aren't read again.

    ``files/run=N`` and ``steps/run=N`` hold what a run added, ``commits/run=N`` is written last. A file that comes
    late between two known ones gives new steps for itself and the one after it; steps are filed under both files, so
    the ones between files that are no longer neighbours don't count any more.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self) -> list[str]:
        return children(self.spark, f"{self.path}/commits")

    def _read(self, part: str, schema: str) -> DataFrame:
        names = self.runs()
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{part}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        return self._read("files", _FILES)

    def chain(self, files: DataFrame | None = None) -> DataFrame:
        """files with the file before, its fingerprint and fields, and the place in the line of files."""
        order = W.partitionBy(*LINE).orderBy("file_no", "file_name")
        before = {c: F.lag(x).over(order) for c, x in (("before", "file_name"), ("old_fields", "fields"), ("old_fingerprint", "fingerprint"))}
        return (self.files() if files is None else files).withColumns({**before, "seq": F.row_number().over(order)})

    def steps(self) -> DataFrame:
        """Steps between files that are neighbours now; kind is renamed, added, removed, or kept for a field that changed its types only."""
        return self._read("steps", _STEPS).join(self.chain().select("file_name", "before"), ["file_name", "before"], "left_semi").distinct()

    def observe(self, raw: DataFrame) -> None:
        """Add the files of raw that aren't known; raw must hold those beside them in their lines, too."""
        name = f"run={len(self.runs()):06}"
        known, recorded = self.files(), self._read("steps", _STEPS).select("file_name", "before").distinct()
        fresh = raw.join(known.select("file_name"), "file_name", "left_anti") if self.runs() else raw
        typed = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("field"), json_type(e["value"]).alias("type")))
        cells = parse_records(fresh).select(*LINE, "file_no", "file_name", F.explode_outer(F.filter(typed, lambda e: e["type"] != "null")).alias("e")).select(*LINE, "file_no", "file_name", "e.*")
        fields = cells.distinct().groupBy(*LINE, "file_no", "file_name", "field").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"))
        entries = F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "types"))))
        whole = fields.groupBy(*LINE, "file_no", "file_name").agg(entries.alias("e"))
        text = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["field"], x["types"])), ",")
        added = materialize(whole.select(*LINE, "file_no", "file_name", F.map_from_entries("e").alias("fields"), F.sha2(text, 256).alias("fingerprint")), f"{self.path}/files/{name}")
        pairs = self.chain(known.unionByName(added)).where("before is not null and fingerprint <> old_fingerprint").join(recorded, ["file_name", "before"], "left_anti")
        pairs = materialize(pairs.select("file_name", "before", "fields", "old_fields", F.array_except(F.map_keys("fields"), F.map_keys("old_fields")).alias("fresh"), F.array_except(F.map_keys("old_fields"), F.map_keys("fields")).alias("gone")), f"{self.path}/pairs/{name}")
        renamed = materialize(_renames(raw, pairs.where("size(fresh) > 0 and size(gone) > 0"), f"{self.path}/marks/{name}"), f"{self.path}/renames/{name}")
        _steps(pairs, renamed).write.mode("overwrite").parquet(f"{self.path}/steps/{name}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")


def _renames(raw: DataFrame, pairs: DataFrame, path: str) -> DataFrame:
    """(file_name, new_field, old_field): fields with the same values for the same records of both files, at least one.

    Per field a mark of its set of (record, value) is made by partial aggregates: their number and two 64-bit hashes
    combined over the set; the marks are kept in path. Only fields new or gone are taken from records, of these two
    files, and values are hashed first.
    """
    side = lambda file, wanted, new: pairs.select(F.col(file).alias("at"), F.col("file_name").alias("pair"), F.col(wanted).alias("wanted"), F.lit(new).alias("new"))
    roles = side("file_name", "fresh", True).unionByName(side("before", "gone", False))
    rows = parse_records(raw.join(roles.select(F.col("at").alias("file_name")).distinct(), "file_name", "left_semi")).where(F.col("record").isNotNull())
    asked = rows.join(roles, F.col("file_name") == F.col("at")).select("pair", "new", "record", F.filter(F.map_entries("fields"), lambda e: F.array_contains(F.col("wanted"), e["key"]) & (json_kind(e["value"]) != "null")).alias("e"))
    hashed = F.transform("e", lambda e: F.struct("new", e["key"].alias("field"), F.xxhash64(F.to_json(e["value"])).alias("one"), F.xxhash64(F.lit("again"), F.to_json(e["value"])).alias("two")))
    # a record of two files: few lines, with at most as many entries as it has fields
    met = asked.select("pair", "new", "record", hashed.alias("e")).groupBy("pair", "record").agg(F.array_distinct(F.flatten(F.collect_list("e"))).alias("e"), F.bool_or("new").alias("here"), F.bool_or(~F.col("new")).alias("there")).where("here and there")
    cells = met.select("pair", "record", F.explode("e").alias("e"))
    first, second = F.xxhash64("record", "e.one", "e.two"), F.xxhash64("e.two", "e.one", "record")
    marks = materialize(cells.groupBy("pair", "e.new", "e.field").agg(F.concat_ws(",", F.count(F.lit(1)), F.bit_xor(first), F.sum(second.cast("decimal(38,0)")).cast("string")).alias("mark")), path)
    side = lambda new, name: marks.where(F.col("new") == new).select("pair", "mark", F.col("field").alias(name))
    return side(True, "new_field").join(side(False, "old_field"), ["pair", "mark"]).select(F.col("pair").alias("file_name"), "new_field", "old_field")


def _steps(pairs: DataFrame, renamed: DataFrame) -> DataFrame:
    """_STEPS of pairs of files, from their fields and the renames among them."""
    own = renamed.groupBy("file_name").agg(F.collect_set(F.struct("new_field", "old_field")).alias("r"))  # at most fields times fields of one file
    row = pairs.join(own, "file_name", "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<new_field:string,old_field:string>>")))
    none = F.lit(None).cast("string")
    step = lambda new, old, kind: F.struct(new.alias("new_field"), old.alias("old_field"), F.col("fields")[new].alias("new_types"), F.col("old_fields")[old].alias("old_types"), F.lit(kind).alias("kind"))
    taken = lambda part: F.transform("r", lambda x: x[part])
    retyped = F.filter(F.array_intersect(F.map_keys("fields"), F.map_keys("old_fields")), lambda k: F.col("fields")[k] != F.col("old_fields")[k])
    listed = F.concat(
        F.transform("r", lambda x: step(x["new_field"], x["old_field"], "renamed")), F.transform(retyped, lambda k: step(k, k, "kept")),
        F.transform(F.array_except("fresh", taken("new_field")), lambda k: step(k, none, "added")), F.transform(F.array_except("gone", taken("old_field")), lambda k: step(none, k, "removed")),
    )
    return row.select("file_name", "before", F.explode(listed).alias("s")).select("file_name", "before", "s.*")


class Drift:
    """Changes and consistent tables of raw records, by a registry in ``path``; without one, by a registry of its own."""

    def __init__(self, raw: DataFrame, path: str | None = None):
        self.spark, self.raw = raw.sparkSession, raw
        self.base = workspace(self.spark)
        self.registry = SchemaRegistry(self.spark, path or f"{self.base}/registry")
        self.registry.observe(raw)

    def fingerprints(self) -> DataFrame:
        """producer, dataset, file_name, seq, version (grows when the fingerprint changes), fingerprint."""
        changed = F.coalesce((F.col("old_fingerprint") != F.col("fingerprint")).cast("int"), F.lit(1))
        return self.registry.chain().select(*LINE, "file_name", "seq", F.sum(changed).over(W.partitionBy(*LINE).orderBy("seq")).cast("int").alias("version"), "fingerprint")

    def changes(self) -> DataFrame:
        """(file_name, field_name, change_kind) of every change; a renamed field that changed its types gives two."""
        steps = self.registry.steps()
        named = F.when(F.col("kind") != "kept", F.struct(F.coalesce("new_field", "old_field").alias("field_name"), F.col("kind").alias("change_kind")))
        retyped = F.when(F.col("kind").isin("kept", "renamed") & (F.col("new_types") != F.col("old_types")), F.struct(F.col("new_field").alias("field_name"), F.lit("retyped").alias("change_kind")))
        return steps.select("file_name", F.explode(F.array_compact(F.array(named, retyped))).alias("c")).select("file_name", "c.*").distinct()

    def names(self) -> DataFrame:
        """(file_name, field, root): the name that the field had when its chain of renames began.

        A run is a field over consecutive files without a rename; runs follow their predecessors by doubling, so the
        number of rounds is the logarithm of the longest chain of renames. Only files' schemas take part.
        """
        if hasattr(self, "_names"):
            return self._names
        fields = self.registry.chain().select(*LINE, "file_name", "before", "seq", F.explode(F.map_keys("fields")).alias("field"))
        renamed = self.registry.steps().where("kind = 'renamed'").groupBy("file_name", F.col("new_field").alias("field")).agg(F.min("old_field").alias("old_field"))
        order = W.partitionBy(*LINE, "field").orderBy("seq")
        begins = fields.join(renamed, ["file_name", "field"], "left").withColumn("starts", F.coalesce((F.lag("seq").over(order) != F.col("seq") - 1).cast("int"), F.lit(1)))
        runs = materialize(begins.withColumn("run", F.sum("starts").over(order)).select(*LINE, "file_name", "before", "field", "run", "old_field", "starts"), f"{self.base}/runs")
        head = runs.where("starts = 1").select(*LINE, "field", "run", F.when(F.col("old_field").isNotNull(), F.col("before")).alias("from_file"), F.col("old_field").alias("from_field"))
        origin = runs.select(F.col("file_name").alias("from_file"), F.col("field").alias("from_field"), F.col("run").alias("up_run"))
        node = lambda f, r: F.concat_ws("\u0001", *LINE, f, r)
        linked = head.join(origin, ["from_file", "from_field"], "left").select(node("field", "run").alias("node"), "field", F.when(F.col("up_run").isNotNull(), node("from_field", "up_run")).alias("up"), F.coalesce("from_field", "field").alias("root"))
        linked, step = materialize(linked, f"{self.base}/names=0"), 0
        while not linked.where("up is not null").isEmpty():
            step += 1
            higher = linked.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("root").alias("higher"))
            linked = materialize(linked.join(higher, "up", "left").select("node", "field", F.col("next").alias("up"), F.coalesce("higher", "root").alias("root")), f"{self.base}/names={step}")
        self._names = materialize(runs.select("file_name", "field", node("field", "run").alias("node")).join(linked.select("node", "root"), "node").select("file_name", "field", "root"), f"{self.base}/named")
        return self._names

    def migrations(self, dataset: str) -> DataFrame:
        """(file_name, version, field_name, source_field, rule): how each file's fields become those of the consistent table.

        rule: `same`, `renamed` (by the chain of renames), `alias` (by ALIASES), `default` for a field of the table
        that the file doesn't have, `extra` for one that the table doesn't have.
        """
        versions = self.fingerprints().where(F.col("dataset") == dataset).select("file_name", "version")
        named = self.names().join(versions, "file_name").select("file_name", "version", self._target(dataset, F.col("root")).alias("field_name"), F.col("field").alias("source_field"), "root")
        rule = F.when(~F.col("field_name").isin(*TARGETS[dataset]), "extra").when(F.col("source_field") == F.col("field_name"), "same").when(F.col("root") == F.col("field_name"), "renamed").otherwise("alias")
        missing = versions.select("file_name", "version", F.explode(F.array(*map(F.lit, TARGETS[dataset]))).alias("field_name")).join(named.select("file_name", "field_name"), ["file_name", "field_name"], "left_anti")
        return named.select("file_name", "version", "field_name", "source_field", rule.alias("rule")).unionByName(missing.select("file_name", "version", "field_name", F.lit(None).cast("string").alias("source_field"), F.lit("default").alias("rule")))

    @staticmethod
    def _target(dataset: str, root: Column) -> Column:
        aliases = F.create_map(*[F.lit(x) for pair in ALIASES[dataset].items() for x in pair])
        return F.coalesce(F.try_element_at(aliases, root), root)

    def _records(self, dataset: str) -> DataFrame:
        """Every record of a dataset and file with its entries (name in the table, whether it's an alias, value), sorted, without repetition.

        Of the entries of one name the first counts: values under the name itself before those under others, then the
        smallest. The fields' names come from their file's row of the registry, so values are routed without moving them apart.
        """
        route = self.names().groupBy("file_name").agg(F.map_from_entries(F.collect_list(F.struct("field", "root"))).alias("route"))
        rows = parse_records(self.raw.where(F.col("dataset") == dataset)).where(F.col("record").isNotNull()).join(route, "file_name", "left")
        root = lambda e: F.col("route")[e["key"]]
        entries = F.transform(F.filter(F.map_entries("fields"), lambda e: json_kind(e["value"]) != "null"), lambda e: F.struct(self._target(dataset, root(e)).alias("name"), (root(e) != self._target(dataset, root(e))).alias("alias"), F.to_json(e["value"]).alias("value")))
        # lines of one record in one file, with at most as many entries as it has fields
        one = rows.select(*LINE, "file_no", "file_name", "record", entries.alias("e")).groupBy(*LINE, "file_no", "file_name", "record").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("e")))).alias("e"))
        return one.withColumn("first", F.filter("e", lambda x, i: (i == 0) | (F.get("e", i - 1)["name"] != x["name"])))

    def unified(self, dataset: str, defaults: dict | None = None) -> DataFrame:
        """One row per record and file of a dataset, all fields under their first names or those that ALIASES gives.

        Known fields are cast to one type (a value that can't be is NULL). Report kinds are names, whether written as
        a name, ``{name}``, a list of one or a code. Control references are sorted ``framework:id`` without repeats,
        whether written as such, joined by commas, as ``{framework, id}`` or as ``{framework: id}``, in a list, alone
        or as JSON text. A value of meta is unwrapped from ``{v}``, and JSON in it is written one way. Other lists may
        come as JSON text, as a single value or as objects with the value under ``v``, ``value``, ``id`` or ``ref``.
        Missing and NULL fields take their value in defaults (DEFAULTS unless given) or are NULL, other fields stay in
        the map ``extras``. Of several values for one field in a file the first counts, those of other names last;
        casts() lists the others.
        """
        targets, defaults = TARGETS[dataset], DEFAULTS[dataset] if defaults is None else defaults
        rows = self._records(dataset).withColumn("all", F.map_from_entries(F.transform("first", lambda x: F.struct(x["name"], x["value"]))))
        given = lambda name: F.col("all")[name]
        known = [(F.when(given(name).isNotNull(), self._cast(given(name), name, kind)).otherwise(F.lit(defaults[name])) if name in defaults else self._cast(given(name), name, kind)).alias(name) for name, kind in targets.items()]
        keys = [F.get_json_object("record", f"$[{i}]").alias(k) for i, k in enumerate(RECORD_KEYS[dataset])]
        return rows.select("producer", "file_no", "file_name", *keys, *known, F.map_filter("all", lambda k, v: ~k.isin(*targets)).alias("extras"))

    def casts(self, dataset: str) -> DataFrame:
        """(dataset, file_name, record, field_name, type, value, result, outcome) of every known field's value that isn't taken as it is.

        outcome: `cast` (result is the value in the table), `refused` (it is NULL there), `superseded` (another value
        of the same record and file stands there).
        """
        targets = TARGETS[dataset]
        cells = self._records(dataset).select("dataset", "file_name", "record", "first", F.explode(F.filter("e", lambda x: x["name"].isin(*targets))).alias("x"))
        value = F.try_parse_json("x.value")
        cells = cells.select("dataset", "file_name", "record", F.col("x.name").alias("field_name"), json_type(value).alias("type"), F.col("x.value").alias("value"), (~F.array_contains("first", F.col("x"))).alias("superseded"))
        plain = F.coalesce(F.when(F.col("type") == "string", F.try_variant_get(F.try_parse_json("value"), "$", "string")), F.col("value"))
        listed = None
        for name, kind in targets.items():
            got = self._cast(F.col("value"), name, kind)
            own = {"string": ["string"], "array<string>": ["array[string]", "array[]"]}.get(kind, ["number"])
            part = cells.where(F.col("field_name") == name).withColumn("result", F.to_json(got) if kind == "array<string>" else got.cast("string"))
            equal = F.col("value").try_cast("double") == F.col("result").try_cast("double") if own == ["number"] else plain == F.col("result")
            outcome = F.when(F.col("superseded"), "superseded").when(F.col("result").isNull(), "refused").when(~(F.col("type").isin(*own) & F.coalesce(equal, F.lit(False))), "cast")
            part = part.select("dataset", "file_name", "record", "field_name", "type", "value", "result", outcome.alias("outcome")).where("outcome is not null")
            listed = part if listed is None else listed.unionByName(part)
        return listed.distinct()

    @staticmethod
    def _cast(text: Column, name: str, kind: str) -> Column:
        value = F.try_parse_json(text)
        rule = RULES.get(name)
        if rule:
            return {"kind": _kind_name, "refs": _control_refs, "json": _json_text}[rule](value)
        plain = F.try_variant_get(value, "$", "string")
        inner = F.coalesce(*[F.try_variant_get(value, f"$.{k}", "string") for k in WRAPPERS])
        flat = F.when(json_kind(value) == "object", F.coalesce(inner, F.to_json(value))).otherwise(plain)
        if kind == "int":
            return F.when(json_kind(value) == "boolean", F.try_variant_get(value, "$", "boolean").cast("int")).otherwise(flat.try_cast("double").cast("int"))
        if kind != "array<string>":
            return flat if kind == "string" else flat.try_cast(kind)
        listed = F.when(json_kind(value) == "array", value).when((json_kind(value) == "string") & plain.startswith("["), F.try_parse_json(plain))
        items = F.transform(F.try_variant_get(listed, "$", "array<variant>"), lambda v: F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in WRAPPERS], F.try_variant_get(v, "$", "string"), F.to_json(v)))
        return F.coalesce(items, F.when(flat.isNotNull(), F.array(flat)))


def _bind(value: Column, step) -> Column:
    """step(value) with the value made once, however often the step names it; so generated code stays small."""
    return F.get(F.transform(F.array(value), step), F.lit(0))


def _kind_name(value: Column) -> Column:
    """A report kind's name; NULL if the value names none or several."""
    items = lambda v: F.try_variant_get(v, "$", "array<variant>")
    one = _bind(value, lambda v: F.when(json_kind(v) == "array", F.when(F.size(items(v)) == 1, F.get(items(v), F.lit(0)))).otherwise(v))
    named = lambda v: F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in ("name", *WRAPPERS)])
    text = _bind(one, lambda v: F.when(json_kind(v) == "object", named(v)).when(json_kind(v).isin("string", "number"), F.try_variant_get(v, "$", "string")))
    codes = F.create_map(*[F.lit(x) for pair in KIND_CODES.items() for x in pair])
    return _bind(text, lambda t: F.when(t.rlike("^\\d+(\\.0+)?$"), F.try_element_at(codes, F.regexp_replace(t, "\\.0+$", ""))).otherwise(t))


def _control_refs(value: Column) -> Column:
    """Sorted framework:id of any of the shapes; an element of another shape stays as its JSON text."""
    def named(entry: Column) -> Column:
        ids = F.when(json_kind(entry["value"]) == "array", F.try_variant_get(entry["value"], "$", "array<string>")).otherwise(F.array(F.try_variant_get(entry["value"], "$", "string")))
        return F.transform(ids, lambda i: F.when(entry["key"].isin(*WRAPPERS), i).otherwise(F.concat(entry["key"], F.lit(":"), i)))

    def refs(v: Column) -> Column:
        framework, ref = F.try_variant_get(v, "$.framework", "string"), F.try_variant_get(v, "$.id", "string")
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string, variant>"))
        spread = F.when(framework.isNotNull() & ref.isNotNull(), F.array(F.concat(framework, F.lit(":"), ref))).otherwise(F.flatten(F.transform(entries, named)))
        parts = F.filter(F.transform(F.split(F.try_variant_get(v, "$", "string"), ","), lambda t: F.trim(t)), lambda t: t != "")
        return F.when(json_kind(v) == "object", spread).when(json_kind(v) == "string", parts).when(json_kind(v) != "null", F.array(F.to_json(v))).otherwise(F.array().cast("array<string>"))

    # each step binds its input once, so that expressions stay small
    opened = F.transform(F.array(value), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.coalesce(F.try_parse_json(F.regexp_extract(F.try_variant_get(v, "$", "string"), "(?s)^\\s*[\\[{].*", 0)), v)).otherwise(v))
    items = F.flatten(F.transform(opened, lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))))
    every = F.flatten(F.transform(items, refs))
    return F.when(value.isNotNull(), F.array_sort(F.array_distinct(F.filter(every, lambda t: t.isNotNull()))))


def _json_text(value: Column) -> Column:
    """Text of a value, unwrapped from an object that holds nothing else; lists and objects as JSON text written one way."""
    inner = lambda v: F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in WRAPPERS], v)
    alone = lambda v: (json_kind(v) == "object") & (F.size(F.try_variant_get(v, "$", "map<string, variant>")) == 1)
    bare = _bind(value, lambda v: F.when(alone(v), inner(v)).otherwise(v))
    text = _bind(bare, lambda v: F.when(json_kind(v) == "string", F.try_variant_get(v, "$", "string")).when(json_kind(v) != "null", F.to_json(v)))
    return _bind(text, lambda t: F.when(t.rlike("^\\s*[\\[{]"), F.coalesce(F.to_json(F.try_parse_json(t)), t)).otherwise(t))
