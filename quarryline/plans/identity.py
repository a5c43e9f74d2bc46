"""Findings of an older and a newer report matched to each other, and stamps that would move."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import identity
from quarryline.plans.registry import registry
from quarryline.plans.relational import FI, findings
from quarryline.workspace import materialize, workspace

QUERIES, SQL, query = registry()
x = F.expr
#: Two reports of each repository: every finding is in the old one; in the new one some are gone, others have another
#: stamp, other paths, another weakness or another title, by row number.
_TWO = f"""{FI}, two AS (SELECT row_no, repo_key AS g, finding_id AS id, fingerprint AS fp, primary_cwe AS cwe, title, from_json(paths, '["VARCHAR"]') AS pa FROM f),
  o AS (SELECT g, id AS old_id, row_no AS place, fp, cwe, array_to_string(list_sort(list_distinct(pa)), ';') AS pk FROM two WHERE row_no % 11 > 0),
  n AS (SELECT g, 'N-' || id AS new_id, row_no AS place, CASE WHEN row_no % 3 > 0 THEN fp ELSE 'x' || row_no END AS fp, CASE WHEN row_no % 6 = 0 THEN 'CWE-1' ELSE cwe END AS cwe, array_to_string(list_sort(list_distinct(pa)), ';') AS pk FROM two WHERE row_no % 13 > 0),
  n1 AS (SELECT g, fp, min(new_id) AS new_id FROM n WHERE fp IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1), t1 AS (SELECT o.g, arg_min(old_id, place) AS old_id, any_value(n1.new_id) AS new_id, 'fingerprint' AS matched_by FROM o JOIN n1 USING (g, fp) GROUP BY o.g, o.fp),
  o2 AS (SELECT * FROM o WHERE (g, old_id) NOT IN (SELECT (g, old_id) FROM t1) AND pk <> '' AND cwe IS NOT NULL), n2 AS (SELECT * FROM n WHERE (g, new_id) NOT IN (SELECT (g, new_id) FROM t1) AND pk <> '' AND cwe IS NOT NULL),
  m2 AS (SELECT g, pk, cwe, min(new_id) AS new_id FROM n2 GROUP BY 1, 2, 3 HAVING count(*) = 1), t2 AS (SELECT o2.g, arg_min(old_id, place) AS old_id, any_value(m2.new_id) AS new_id, 'path+cwe' AS matched_by FROM o2 JOIN m2 USING (g, pk, cwe) GROUP BY o2.g, o2.pk, o2.cwe)"""


def two_reports(s, d):
    f = findings(s, d).select("row_no", F.col("repo_key").alias("group_key"), "finding_id", "fingerprint", F.col("primary_cwe").alias("cwe"), "title", F.from_json("paths", "array<string>").alias("paths"))
    old = f.where("row_no % 11 > 0").select("group_key", F.col("finding_id").alias("old_id"), F.col("row_no").alias("place"), "fingerprint", "cwe", "title", "paths")
    new = f.where("row_no % 13 > 0").select("group_key", x("concat('N-', finding_id)").alias("new_id"), F.col("row_no").alias("place"), x("if(row_no % 3 > 0, fingerprint, concat('x', row_no))").alias("fingerprint"), x("if(row_no % 6 = 0, 'CWE-1', cwe)").alias("cwe"), x("if(row_no % 12 = 0, concat('New ', title), title)").alias("title"), "paths")
    return old, new


@query(f"WITH {_TWO} SELECT g AS group_key, old_id, new_id, matched_by FROM t1 UNION ALL SELECT * FROM t2")
def join_14_only_candidates(s, d):
    return ladder(s, d).where("matched_by in ('fingerprint', 'path+cwe')")


def ladder(s, d):
    return identity.match_ladder(*two_reports(s, d))


@query()
def join_14_ladder(s, d):
    return ladder(s, d)


@query()
def job_05_rebaselined(s, d):
    old, new = two_reports(s, d)
    matched = materialize(identity.match_ladder(old, new), f"{workspace(s)}/matched")
    settled = old.where("place % 17 = 0").select("group_key", "old_id")
    aliases, reviews = identity.rebaselined(old, new, matched, settled)
    return aliases.select("group_key", F.col("old_id").alias("id"), F.concat_ws(" ", "matched_by", F.col("confirmed").cast("string")).alias("state")).unionByName(reviews.select("group_key", F.col("suggested").alias("id"), F.col("reason").alias("state")))


_FP = lambda repo, cwe: f"sha256(concat_ws('|', {repo}, array_to_string(list_sort(coalesce(pa, [])), ';'), {cwe}))"
_ST = f"""{FI}, k AS (SELECT row_no, repo_key, finding_id, from_json(paths, '["VARCHAR"]') AS pa, from_json(cwes, '["VARCHAR"]') AS cw, 'https://x.test/' || repo_key AS good FROM f),
  c AS (SELECT *, cw[1] AS fst, 'CWE-' || list_min(list_transform(cw, lambda q: CAST(regexp_extract(q, '(\\d+)', 1) AS INT))) AS low FROM k),
  z AS (SELECT *, {_FP('good', 'low')} AS computed, CASE row_no % 5 WHEN 0 THEN NULL WHEN 1 THEN {_FP('good', 'low')} WHEN 2 THEN {_FP("'<' || good || '>'", 'low')} WHEN 3 THEN {_FP('good', 'fst')} ELSE 'other' END AS stored FROM c)"""


def stamped(s, d):
    cwes, paths = F.from_json("cwes", "array<string>"), F.from_json("paths", "array<string>")
    good = F.concat(F.lit("https://x.test/"), "repo_key")
    f = findings(s, d).select("row_no", "repo_key", "finding_id", F.concat(F.lit("<"), good, F.lit(">")).alias("repository"), paths.alias("paths"), cwes.alias("cwes"))
    made = identity.stamps(f.withColumn("fingerprint", F.lit(None).cast("string")))
    from quarryline.functions import text as fx

    bare, low = F.regexp_replace("repository", "[<>]", ""), F.concat(F.lit("CWE-"), fx.lowest_cwe(F.col("cwes")).cast("string"))
    p = F.coalesce("paths", F.array().cast("array<string>"))
    stored = F.when(x("row_no % 5 = 1"), fx.fingerprint(bare, p, low)).when(x("row_no % 5 = 2"), fx.fingerprint(F.col("repository"), p, low)).when(x("row_no % 5 = 3"), fx.fingerprint(bare, p, F.get("cwes", F.lit(0)))).when(x("row_no % 5 = 4"), "other")
    return identity.stamps(made.select("row_no", "repo_key", "finding_id", "repository", "paths", "cwes", stored.alias("fingerprint")))


@query(f"WITH {_ST} SELECT repo_key, finding_id, computed, coalesce(stored <> computed, false) AS moved, CASE WHEN stored IS NULL THEN NULL WHEN stored = computed THEN 'current' WHEN stored = {_FP(chr(39) + '<' + chr(39) + ' || good || ' + chr(39) + '>' + chr(39), 'low')} THEN 'raw_repository' WHEN stored = {_FP('good', 'fst')} THEN 'first_cwe' ELSE 'unknown' END AS recipe FROM z")
def job_05_recipes(s, d):
    return stamped(s, d).select("repo_key", "finding_id", "computed", "moved", "recipe")


@query(f"WITH {_ST} SELECT repo_key, count(*) AS n, count(*) FILTER (WHERE stored IS NULL) AS n_missing, count(*) FILTER (WHERE stored <> computed) AS n_moves, true AS run_refused FROM z GROUP BY 1")
def job_05_moves(s, d):
    return identity.moves_by_report(stamped(s, d))


@query(f"WITH {_ST} SELECT repo_key, finding_id, coalesce(stored, computed) AS fingerprint FROM z")
def job_05_gaps_filled(s, d):
    return identity.restamped(stamped(s, d)).select("repo_key", "finding_id", "fingerprint")
