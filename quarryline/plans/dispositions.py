"""Dispositions, precedents, claims and soundness over the findings and their ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.operators import dispositions as dis
from quarryline.operators import identity
from quarryline.plans.registry import registry
from quarryline.plans.relational import E, FI, findings, ledger
from quarryline.workspace import table

QUERIES, SQL, query = registry()

_KEY = ["repo_key", "finding_id"]
_DER = f"""{E}, h AS (SELECT * FROM e WHERE finding_id IS NOT NULL),
  d AS (SELECT repo_key, finding_id, count(*) AS n_events, arg_max(validity, (recorded_at, event_id)) FILTER (WHERE validity IS NOT NULL AND actor_kind = 'human') AS hv, arg_max(validity, (recorded_at, event_id)) FILTER (WHERE validity IS NOT NULL AND actor_kind = 'machine') AS mv,
    arg_max(resolution, (recorded_at, event_id)) FILTER (WHERE resolution IS NOT NULL AND actor_kind = 'human') AS hr, arg_max(resolution, (recorded_at, event_id)) FILTER (WHERE resolution IS NOT NULL AND actor_kind = 'machine') AS mr FROM h GROUP BY 1, 2)"""


@query(f"WITH {_DER} SELECT repo_key, finding_id, coalesce(hv, mv) AS validity, coalesce(hr, mr) AS resolution, coalesce(hv <> mv, false) AS conflict, n_events FROM d")
def win_09_derived(s, d):
    return dis.derived(ledger(s, d).where("finding_id is not null"), _KEY)


#: Renamed findings: some ids of a repository lead to the next one; part of these links is confirmed.
_AL = f"{FI}, al AS (SELECT DISTINCT repo_key, finding_id AS old_id, 'FIND-' || lpad(CAST(CAST(right(finding_id, 3) AS INT) + 1 AS VARCHAR), 3, '0') AS new_id, row_no % 4 < 3 AS confirmed FROM f WHERE row_no % 3 = 0)"


def aliases(s, d):
    f = findings(s, d).where("row_no % 3 = 0")
    following = F.concat(F.lit("FIND-"), F.lpad((F.right("finding_id", F.lit(3)).cast("int") + 1).cast("string"), 3, "0"))
    return f.select("repo_key", F.col("finding_id").alias("old_id"), following.alias("new_id"), (F.col("row_no") % 4 < 3).alias("confirmed")).distinct()


def final_ids(s, d):
    """Chains of confirmed aliases within a repository; the repository's name is part of the ids that the chains run over."""
    joined = aliases(s, d).where("confirmed").select(F.concat_ws("\u0001", "repo_key", "old_id").alias("old_id"), F.concat_ws("\u0001", "repo_key", "new_id").alias("new_id"))
    ends = identity.resolve_aliases(joined)
    part = lambda c, i: F.get(F.split(c, "\u0001"), F.lit(i))
    return ends.select(part("old_id", 0).alias("repo_key"), part("old_id", 1).alias("old_id"), part("final_id", 1).alias("final_id"))


_CHAIN = f"""{_AL}, walk(repo_key, old_id, here) AS (SELECT repo_key, old_id, new_id FROM al WHERE confirmed UNION ALL SELECT w.repo_key, w.old_id, al.new_id FROM walk w JOIN al ON al.repo_key = w.repo_key AND al.old_id = w.here AND al.confirmed),
  ends AS (SELECT repo_key, old_id, max(here) AS final_id FROM walk GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_CHAIN} SELECT * FROM ends")
def join_21_final_ids(s, d):
    return final_ids(s, d)


_REPLAY = f"""{_CHAIN}, {E}, led AS (SELECT e.* EXCLUDE (finding_id), coalesce(ends.final_id, e.finding_id) AS finding_id FROM e LEFT JOIN ends ON ends.repo_key = e.repo_key AND ends.old_id = e.finding_id WHERE e.finding_id IS NOT NULL),
  d AS (SELECT repo_key, finding_id, count(*) AS n_events, arg_max(validity, (recorded_at, event_id)) FILTER (WHERE validity IS NOT NULL AND actor_kind = 'human') AS hv, arg_max(validity, (recorded_at, event_id)) FILTER (WHERE validity IS NOT NULL AND actor_kind = 'machine') AS mv,
    arg_max(resolution, (recorded_at, event_id)) FILTER (WHERE resolution IS NOT NULL AND actor_kind = 'human') AS hr, arg_max(resolution, (recorded_at, event_id)) FILTER (WHERE resolution IS NOT NULL AND actor_kind = 'machine') AS mr FROM led GROUP BY 1, 2),
  disp AS (SELECT f.repo_key, f.finding_id, coalesce(hv, mv) AS validity, coalesce(hr, mr) AS resolution, coalesce(hv <> mv, false) AS conflict, coalesce(n_events, 0) AS n_events FROM f LEFT JOIN d USING (repo_key, finding_id))"""


def replayed(s, d):
    return dis.replay(findings(s, d).select(*_KEY), ledger(s, d).where("finding_id is not null"), final_ids(s, d), aliases(s, d).where("not confirmed"))


@query(f"WITH RECURSIVE {_REPLAY} SELECT * FROM disp")
def job_03_dispositions(s, d):
    return replayed(s, d)[0]


@query(f"WITH RECURSIVE {_REPLAY} SELECT l.repo_key, l.finding_id, CASE WHEN (l.repo_key, l.finding_id) IN (SELECT (repo_key, old_id) FROM al WHERE NOT confirmed) THEN 'parked' ELSE 'unknown' END AS state, count(*) AS n FROM led l WHERE (l.repo_key, l.finding_id) NOT IN (SELECT (repo_key, finding_id) FROM f) GROUP BY 1, 2, 3")
def job_03_unplaced(s, d):
    return replayed(s, d)[1]


@query(f"""WITH RECURSIVE {_REPLAY}, dim AS (SELECT 'resolution' AS measure, unnest({list(dis.RESOLUTIONS)}) AS value UNION ALL SELECT 'validity', unnest({list(dis.VALIDITIES)}))
  SELECT measure, value, CASE measure WHEN 'resolution' THEN (SELECT count(*) FROM disp WHERE coalesce(resolution, 'open') = value) ELSE (SELECT count(*) FROM disp WHERE coalesce(validity, 'not_verified') = value) END AS n FROM dim
  UNION ALL SELECT 'conflicts', 'all', count(*) FROM disp WHERE conflict""")
def agg_29_summary(s, d):
    return dis.summary(replayed(s, d)[0])


#: Components of the test findings: a path's first and last part, the kind of flaw in the title.
_CF = f"""{FI}, cf AS (SELECT repo_key, finding_id, CASE WHEN row_no % 2 = 0 THEN fingerprint END AS fingerprint, list_sort(list_distinct(list_transform(from_json(paths, '["VARCHAR"]'), lambda p: split_part(p, '/', 1) || '/' || list_extract(string_split(p, '/'), -1)))) AS paths, primary_cwe AS cwe, lower(split_part(title, ' in ', 1)) AS category, split_part(repo_key, '/', 1) AS tree FROM f WHERE paths IS NOT NULL)"""


def component_findings(s, d):
    short = F.array_sort(F.array_distinct(F.transform(F.from_json("paths", "array<string>"), lambda p: F.concat_ws("/", F.substring_index(p, "/", 1), F.substring_index(p, "/", -1)))))
    return findings(s, d).where("paths is not null").select("repo_key", "finding_id", F.when(F.col("row_no") % 2 == 0, F.col("fingerprint")).alias("fingerprint"), short.alias("paths"), F.col("primary_cwe").alias("cwe"), F.lower(F.substring_index("title", " in ", 1)).alias("category"))


_UN = "un AS (SELECT event_id, repo_key FROM e WHERE source_type = 'validation_report' AND (source_ref IS NULL OR actor_identity = 'verify/1.1'))"
_PRE = f"""{_CF}, {_DER}, {_UN}, k AS (SELECT h.*, (h.event_id, h.repo_key) IN (SELECT (event_id, repo_key) FROM un) AS bad, validity IN ('false_positive', 'hardening') AND actor_kind = 'human' AND coalesce(actor_identity, '') <> '' AS hum, validity IN ('false_positive', 'hardening') AND actor_kind = 'machine' AND source_type IN ('triage_report', 'validation_report', 'verification_report') AS mac FROM h),
  c AS (SELECT repo_key, finding_id, arg_max(validity, (recorded_at, event_id)) FILTER (WHERE hum) AS hverd, arg_max(event_id, (recorded_at, event_id)) FILTER (WHERE hum) AS hev, arg_max(validity, (recorded_at, event_id)) FILTER (WHERE mac AND NOT bad) AS mverd, arg_max(event_id, (recorded_at, event_id)) FILTER (WHERE mac AND NOT bad) AS mev, bool_or(validity = 'confirmed') AS contested, count(*) FILTER (WHERE mac AND bad) AS n_unsound FROM k GROUP BY 1, 2),
  j AS (SELECT cf.*, c.* EXCLUDE (repo_key, finding_id), coalesce(d.hv, d.mv) AS now FROM cf JOIN c USING (repo_key, finding_id) JOIN d USING (repo_key, finding_id)),
  st AS (SELECT *, CASE WHEN hev IS NULL AND mev IS NULL THEN 'none' WHEN hev IS NOT NULL AND now IS DISTINCT FROM hverd THEN 'excluded_stale' WHEN hev IS NOT NULL THEN 'human_countersigned' WHEN contested THEN 'excluded_contested' WHEN now IN ('confirmed', 'corrected') THEN 'excluded_stale' ELSE 'machine_refuted_sound' END AS state,
    sha256(array_to_string(paths, ';') || '|' || upper(coalesce(cwe, '')) || '|' || coalesce(category, '') || '|') AS signature FROM j),
  cache AS (SELECT * FROM st WHERE state IN ('human_countersigned', 'machine_refuted_sound'))"""


def unsound(s, d):
    return ledger(s, d).where("source_type = 'validation_report' and (source_ref is null or actor_identity = 'verify/1.1')").select("event_id", "repo_key")


def precedent_cache(s, d):
    return dis.precedents(component_findings(s, d), ledger(s, d).where("finding_id is not null"), unsound(s, d))


@query(f"WITH {_PRE} SELECT signature, fingerprint, repo_key, finding_id, coalesce(hverd, mverd) AS verdict, state AS strength, coalesce(hev, mev) AS event_id FROM cache")
def job_04_win_08_cache(s, d):
    return precedent_cache(s, d)[0].select("signature", "fingerprint", "repo_key", "finding_id", "verdict", "strength", "event_id")


@query(f"WITH {_PRE} SELECT state, count(*) AS n FROM st WHERE state <> 'none' GROUP BY 1 UNION ALL SELECT 'excluded_unsound', coalesce(sum(n_unsound), 0)::BIGINT FROM st")
def agg_38_population(s, d):
    return precedent_cache(s, d)[1]


@query(f"""WITH {_PRE}, p AS (SELECT DISTINCT cf.repo_key, cf.finding_id, cache.signature, 'fingerprint' AS matched_by FROM cf JOIN cache USING (fingerprint)),
  r AS (SELECT cf.*, sha256(array_to_string(paths, ';') || '|' || upper(coalesce(cwe, '')) || '|' || coalesce(category, '') || '|') AS own FROM cf WHERE len(paths) > 0 AND (repo_key, finding_id) NOT IN (SELECT (repo_key, finding_id) FROM p)),
  m AS (SELECT * FROM p UNION ALL SELECT DISTINCT r.repo_key, r.finding_id, cache.signature, 'signature' FROM r JOIN cache ON cache.signature = r.own
    UNION ALL SELECT DISTINCT r.repo_key, r.finding_id, cache.signature, 'component' FROM (SELECT *, unnest(paths) AS path FROM r) r JOIN (SELECT *, unnest(paths) AS path FROM cache) cache ON cache.path = r.path AND r.own <> cache.signature AND (r.cwe = cache.cwe OR (r.category = cache.category AND r.category <> '')))
  SELECT m.*, (SELECT min(state) FROM cache c WHERE c.signature = m.signature) AS max_strength FROM m""")
def join_13_precedent_matches(s, d):
    return dis.matches(precedent_cache(s, d)[0], component_findings(s, d))


#: Entries of validation reports: the findings that were validated, under their repository's name or by their id alone.
_VF = f"{FI}, {E}, vf AS (SELECT repo_key, finding_id, CASE WHEN validation_status = 'inconclusive' THEN 'error-signature:forbidden' END AS flag FROM f WHERE validation_status IS NOT NULL)"


@query(f"WITH {_VF} SELECT e.event_id, e.repo_key, CASE WHEN coalesce(source_ref, '') = '' OR coalesce(e.finding_id, '') = '' THEN 'unresolvable:no-source-ref' WHEN vf.finding_id IS NULL THEN 'unresolvable:entry-not-found' ELSE flag END AS reason FROM e LEFT JOIN vf USING (repo_key, finding_id) WHERE source_type = 'validation_report'")
def join_25_entries(s, d):
    named = findings(s, d).where("validation_status is not null")
    source_id = F.when(F.col("row_no") % 2 == 0, F.concat_ws("/", "repo_key", "finding_id"))
    entries = named.select("repo_key", source_id.alias("source_id"), F.when(source_id.isNull(), F.col("finding_id")).alias("finding_ref"), F.when(F.col("validation_status") == "inconclusive", "error-signature:forbidden").alias("flag"))
    keyed = entries.select("repo_key", F.coalesce(F.substring_index("source_id", "/", -1), "finding_ref").alias("finding_id"), "flag").groupBy("repo_key", "finding_id").agg(F.max("flag").alias("flag"), F.lit(True).alias("hit"))
    joined = ledger(s, d).where("source_type = 'validation_report'").join(keyed, ["repo_key", "finding_id"], "left")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return joined.select("event_id", "repo_key", F.when(empty("source_ref") | empty("finding_id"), "unresolvable:no-source-ref").when(F.col("hit").isNull(), "unresolvable:entry-not-found").otherwise(F.col("flag")).alias("reason"))


@query(f"WITH {E}, t AS (SELECT event_id, repo_key, 'T-' || nullif(regexp_extract(source_ref, '-(\\d+)\\.json$', 1), '') AS ticket FROM e), tax AS (SELECT DISTINCT ticket, 'class-' || (CAST(right(ticket, 3) AS INT) % 7) AS failure_class FROM t WHERE CAST(right(ticket, 3) AS INT) % 3 = 0) SELECT t.*, failure_class FROM t LEFT JOIN tax USING (ticket)")
def join_27_taxonomy(s, d):
    number = F.nullif(F.regexp_extract("source_ref", r"-(\d+)\.json$", 1), F.lit(""))
    t = ledger(s, d).select("event_id", "repo_key", F.concat(F.lit("T-"), number).alias("ticket"))
    n = F.right("ticket", F.lit(3)).cast("int")
    taxonomy = t.select("ticket").distinct().where(n % 3 == 0).select("ticket", F.concat(F.lit("class-"), (n % 7).cast("string")).alias("failure_class"))
    return t.join(taxonomy, "ticket", "left").select("event_id", "repo_key", "ticket", "failure_class")


_HASH = "sha256(concat_ws(chr(31), coalesce(title, ''), coalesce(severity, ''), coalesce(validity, ''), coalesce(resolution, '')))"


@query(f"""WITH {FI}, b AS (SELECT repo_key, finding_id, arg_min({_HASH}, (loaded_at, row_no)) AS was FROM findings WHERE loaded_at < TIMESTAMP '2025-06-01' GROUP BY 1, 2), n AS (SELECT repo_key, finding_id, {_HASH} AS now, validity FROM f)
  SELECT repo_key, finding_id, CASE WHEN was IS NULL THEN 'unbaselined' WHEN now IS NULL THEN 'missing' WHEN validity = 'corrected' THEN 'corrected_drift' ELSE 'mismatch' END AS state FROM b FULL JOIN n USING (repo_key, finding_id) WHERE was IS DISTINCT FROM now""")
def join_28_claims(s, d):
    claim = fx.claim_hash(*map(F.col, ("title", "severity", "validity", "resolution")))
    f = table(s, d, "findings")
    first = f.where("loaded_at < timestamp_ntz'2025-06-01'").groupBy(*_KEY).agg(F.min(F.struct("loaded_at", "row_no", claim.alias("claim")))["claim"].alias("claim"))
    now = findings(s, d).select(*_KEY, claim.alias("claim"), F.col("validity").alias("validation_status"))
    return dis.claims_checked(first, now, _KEY)


#: Transcripts of probes, made of the ledger: what a step saw depends on the event's id.
_FLAGGED = """CASE ascii(event_id) % 8 WHEN 0 THEN 'error-signature:forbidden' WHEN 1 THEN 'error-signature:command-not-found' WHEN 2 THEN 'rbac-zero-subjects' WHEN 3 THEN 'error-signature:unsubstituted-template' WHEN 4 THEN 'error-signature:could-not-connect' END"""


@query(f"""WITH {E}, x AS (SELECT repo_key, finding_id, event_id, validity, {_FLAGGED} AS flag, validity = 'false_positive' AS refuting, ascii(substr(event_id, 2, 1)) % 9 = 0 AS control_failed, ascii(substr(event_id, 3, 1)) % 11 = 0 AS blind, ascii(substr(event_id, 4, 1)) % 13 = 0 AS undeployed FROM e WHERE finding_id IS NOT NULL),
  g AS (SELECT repo_key, finding_id, bool_or(refuting) AS refuted, bool_or(undeployed) AS undeployed, bool_or(control_failed) FILTER (WHERE refuting) AS failed, bool_or(blind) FILTER (WHERE refuting) AS blind, bool_and(flag IS NOT NULL) FILTER (WHERE refuting) AS every, arg_min(flag, event_id) FILTER (WHERE refuting) AS first FROM x GROUP BY 1, 2)
  SELECT repo_key, finding_id, CASE WHEN NOT refuted THEN NULL WHEN undeployed THEN 'target-not-deployed' WHEN failed THEN 'failed-positive-control' WHEN blind THEN 'non-discriminating-oracle' WHEN every THEN first END AS flag FROM g WHERE refuted IS NOT NULL""")
def job_21_soundness(s, d):
    code = lambda i: F.ascii(F.substring("event_id", i, 1))
    seen = F.element_at(F.array(*map(F.lit, ("Error from server (Forbidden): pods", "bash: oc: command not found", "vf-rbac-tried: ", "vf-rbac-as: system:serviceaccount:{ns}:x", "no route to host", *["HTTP 200, nothing leaked"] * 3))), code(1) % 8 + 1)
    refuting = F.coalesce(F.col("validity") == "false_positive", F.lit(False))
    step = F.struct("event_id", F.lit("probe").alias("verb"), F.when(refuting, "refuted").otherwise("confirmed").alias("verdict"), seen.alias("observed"), F.array(code(2) % 9 != 0).alias("controls"), F.when(code(3) % 11 == 0, False).alias("discriminated"))
    # the steps of one finding's validation
    vf = ledger(s, d).where("finding_id is not null").groupBy(*_KEY).agg(F.array_sort(F.collect_list(step)).alias("steps"), F.bool_or(refuting).alias("refuted"), F.bool_or(code(4) % 13 == 0).alias("undeployed"), F.count("validity").alias("judged")).where("judged > 0")
    flag = dis.refutation_flag(F.when(F.col("refuted"), "refuted").otherwise("confirmed"), F.col("steps"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("undeployed"))
    return vf.select(*_KEY, flag.alias("flag"))
