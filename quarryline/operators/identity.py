"""Which old finding is which new one, where renamed ids lead, and what restamping findings would move."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions import text as fx
from quarryline.functions.kernels import title_sim
from quarryline.workspace import materialize, workspace

LADDER = "group_key string, old_id string, new_id string, matched_by string"


def only_candidate(old: DataFrame, new: DataFrame, on: list[str], name: str) -> DataFrame:
    """(group_key, old_id, new_id, matched_by) where exactly one new finding has an old one's columns: the first old one, by place, gets it."""
    fine = lambda df: df.dropna(subset=on)
    one = fine(new).groupBy("group_key", *on).agg(F.count(F.lit(1)).alias("n"), F.min("new_id").alias("new_id")).where("n = 1").drop("n")
    first = fine(old).groupBy("group_key", *on).agg(F.min(F.struct("place", "old_id"))["old_id"].alias("old_id"))
    return first.join(one, ["group_key", *on]).select("group_key", "old_id", "new_id", F.lit(name).alias("matched_by"))


def in_turn(pairs: DataFrame, name: str, base: str) -> DataFrame:
    """(group_key, old_id, new_id, matched_by): old findings in the order of their places each take their best new one that is still free.

    pairs: group_key, old_id, place, new_id, new_place, score (a struct or number; more is better, equal ones go by
    new_place). In a round a pair is settled if the new finding is the old one's best and no earlier old one may want
    it; so the first old one of each group is always settled, and as a rule most others. No group is gathered.
    """
    left, taken, step = materialize(pairs, f"{base}/{name}=0"), [], 0
    while not left.isEmpty():
        best = left.groupBy("group_key", "old_id").agg(F.max(F.struct("score", (-F.col("new_place")).alias("p"), "new_id"))["new_id"].alias("new_id"))
        first = left.groupBy("group_key", "new_id").agg(F.min(F.struct("place", "old_id"))["old_id"].alias("old_id"))
        done = materialize(best.join(first, ["group_key", "old_id", "new_id"]), f"{base}/{name}-done={step}")
        taken.append(done)
        step += 1
        rest = left.join(done.select("group_key", "old_id"), ["group_key", "old_id"], "left_anti").join(done.select("group_key", "new_id"), ["group_key", "new_id"], "left_anti")
        left = materialize(rest, f"{base}/{name}={step}")
    out = reduce(DataFrame.unionByName, taken) if taken else pairs.select("group_key", "old_id", "new_id").limit(0)
    return out.select("group_key", "old_id", "new_id", F.lit(name).alias("matched_by"))


def match_ladder(old: DataFrame, new: DataFrame, least_overlap: float = 0.5, least_similar: float = 0.6) -> DataFrame:
    """(group_key, old_id, new_id, matched_by), one to one: by fingerprint, by paths and weakness, by overlap of paths, by title.

    old and new have group_key, old_id or new_id, place (order in the report), fingerprint, cwe, title and paths
    (array). The first two tiers want exactly one candidate; the others take the best that is still free, by overlap
    and then title, or by title. Candidates of the third tier share a path, those of the fourth a word of more than two
    letters. NULL columns match nothing.
    """
    base = workspace(old.sparkSession)
    rest = lambda df, side, done: df.join(done.select("group_key", side), ["group_key", side], "left_anti")
    keyed = lambda df: df.withColumn("__paths", F.nullif(F.array_join(F.array_sort(F.array_distinct("paths")), ";"), F.lit("")))
    by_print = materialize(only_candidate(old, new, ["fingerprint"], "fingerprint"), f"{base}/print")
    o, n = keyed(rest(old, "old_id", by_print)), keyed(rest(new, "new_id", by_print))
    by_place = materialize(only_candidate(o, n, ["__paths", "cwe"], "path+cwe"), f"{base}/place")
    o = materialize(rest(o, "old_id", by_place).select("group_key", "old_id", "place", "title", F.array_distinct("paths").alias("paths")), f"{base}/old")
    n = materialize(rest(n, "new_id", by_place).select("group_key", "new_id", F.col("place").alias("new_place"), F.col("title").alias("new_title"), F.array_distinct("paths").alias("new_paths")), f"{base}/new")
    shared = o.select("group_key", "old_id", F.explode("paths").alias("p")).join(n.select("group_key", "new_id", F.explode("new_paths").alias("p")), ["group_key", "p"]).groupBy("group_key", "old_id", "new_id").agg(F.count(F.lit(1)).alias("both"))
    overlap = F.col("both") / (F.size("paths") + F.size("new_paths") - F.col("both"))
    near = shared.join(o, ["group_key", "old_id"]).join(n, ["group_key", "new_id"]).withColumn("overlap", overlap).where(F.col("overlap") >= least_overlap)
    alike = F.when(F.col("title").isNull() | F.col("new_title").isNull(), 0.0).otherwise(title_sim("title", "new_title"))
    by_overlap = in_turn(near.withColumn("sim", alike).select("group_key", "old_id", "place", "new_id", "new_place", F.struct("overlap", "sim").alias("score")), "overlap", base)
    by_title = _by_title(rest(o, "old_id", by_overlap), rest(n, "new_id", by_overlap), least_similar)
    return by_print.unionByName(by_place).unionByName(by_overlap).unionByName(by_title)


def _by_title(o: DataFrame, n: DataFrame, least: float) -> DataFrame:
    """The last tier of the ladder, by titles instead of findings: a repository has far fewer of these.

    Old findings of one title go together, at the place of the first of them; new ones of one title are taken in their
    order. Only titles with their numbers of findings and the pairs that are alike come to one task per group.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    sized = lambda df, title, place, p: df.where(F.col(title).isNotNull()).groupBy("group_key", title).agg(F.count(F.lit(1)).alias(f"{p}_n"), F.min(place).alias(f"{p}_first"))
    olds, news = sized(o, "title", "place", "old"), sized(n, "new_title", "new_place", "new")
    spread = lambda df, c: df.select("group_key", c, F.explode(words(c)).alias("w"))
    met = spread(olds, "title").join(spread(news, "new_title"), ["group_key", "w"]).select("group_key", "title", "new_title").distinct()
    scored = met.withColumn("score", title_sim("title", "new_title")).where(F.col("score") >= least).join(olds, ["group_key", "title"]).join(news, ["group_key", "new_title"])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        key, free, out = pdf["group_key"].iloc[0], dict(zip(pdf["new_title"], pdf["new_n"])), []
        start = dict.fromkeys(free, 0)
        for title, choices in pdf.sort_values(["old_first", "title"]).groupby("title", sort=False):
            left, at = int(choices["old_n"].iloc[0]), 0
            for r in choices.sort_values(["score", "new_first"], ascending=[False, True]).itertuples():
                take = min(left, int(free[r.new_title]))
                if take:
                    out.append((key, title, r.new_title, at, start[r.new_title], take))
                    left, at = left - take, at + take
                    free[r.new_title] -= take
                    start[r.new_title] += take
        return pd.DataFrame(out, columns=["group_key", "title", "new_title", "old_from", "new_from", "n"])

    shares = scored.groupBy("group_key").applyInPandas(deal, "group_key string, title string, new_title string, old_from bigint, new_from bigint, n bigint")
    each = shares.withColumn("i", F.explode(F.expr("sequence(0, n - 1)"))).select("group_key", "title", "new_title", (F.col("old_from") + F.col("i")).alias("old_k"), (F.col("new_from") + F.col("i")).alias("new_k"))
    ranked = lambda df, title, place, k: df.withColumn(k, (F.row_number().over(W.partitionBy("group_key", title).orderBy(place)) - 1).cast("bigint"))
    one = ranked(o, "title", "place", "old_k").select("group_key", "title", "old_k", "old_id")
    two = ranked(n, "new_title", "new_place", "new_k").select("group_key", "new_title", "new_k", "new_id")
    return each.join(one, ["group_key", "title", "old_k"]).join(two, ["group_key", "new_title", "new_k"]).select("group_key", "old_id", "new_id", F.lit("title").alias("matched_by"))


def rebaselined(old: DataFrame, new: DataFrame, matched: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, reviews) of matched findings: only those by fingerprint are confirmed at once, the others go to review, as do old ones without a match.

    settled (group_key, old_id): aliases that a human confirmed or rejected; they stay as they are.
    """
    fresh = matched.join(settled.select("group_key", "old_id").distinct(), ["group_key", "old_id"], "left_anti")
    aliases = fresh.select("group_key", "old_id", "new_id", "matched_by", (F.col("matched_by") == "fingerprint").alias("confirmed"))
    asked = fresh.where("matched_by <> 'fingerprint'").select("group_key", F.col("new_id").alias("suggested"), F.lit("rebaseline_mapping").alias("reason"))
    lost = old.select("group_key", "old_id").join(matched.select("group_key", "old_id"), ["group_key", "old_id"], "left_anti").select("group_key", F.col("old_id").alias("suggested"), F.lit("rebaseline_unmatched").alias("reason"))
    return aliases, asked.unionByName(lost)


def stamps(findings: DataFrame) -> DataFrame:
    """findings (repo_key, finding_id, repository, fingerprint, paths, cwes) with computed, moved, and the recipe that gives the stored stamp.

    computed: the stamp of the repaired repository, paths and lowest weakness. moved: a stored stamp that would change.
    recipe: `current`; `raw_repository` for one made before repositories were repaired; `first_cwe` for one of the
    weakness listed first; `unknown`; NULL where none is stored.
    """
    lowest = F.concat(F.lit("CWE-"), fx.lowest_cwe(F.col("cwes")).cast("string"))
    first = F.get("cwes", F.lit(0))
    repaired = fx.repaired_repository(F.col("repository"))
    paths = F.coalesce("paths", F.array().cast("array<string>"))
    made = {"current": fx.fingerprint(repaired, paths, lowest), "raw_repository": fx.fingerprint(F.col("repository"), paths, lowest), "first_cwe": fx.fingerprint(repaired, paths, first)}
    stored = F.nullif("fingerprint", F.lit(""))
    recipe = F.when(stored.isNull(), None)
    for name, value in made.items():
        recipe = recipe.when(stored == value, name)
    return findings.withColumns({"computed": made["current"], "moved": F.coalesce(stored != made["current"], F.lit(False)), "recipe": recipe.otherwise("unknown")})


def restamped(stamped: DataFrame, allow_moves: bool = False) -> DataFrame:
    """stamped with the fingerprint to write: gaps are always filled; others change only if moves are allowed."""
    stored = F.nullif("fingerprint", F.lit(""))
    return stamped.withColumn("fingerprint", F.col("computed") if allow_moves else F.coalesce(stored, "computed"))


def moves_by_report(stamped: DataFrame) -> DataFrame:
    """(repo_key, n, n_missing, n_moves, run_refused): a run over all reports is refused as a whole if any report has a move."""
    per = stamped.groupBy("repo_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.nullif("fingerprint", F.lit("")).isNull()).alias("n_missing"), F.count_if("moved").alias("n_moves"))
    any_move = per.agg(F.coalesce(F.bool_or(F.col("n_moves") > 0), F.lit(False)).alias("run_refused"))  # one row
    return per.crossJoin(F.broadcast(any_move))


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """(old_id, final_id) of chains of renames (old_id, new_id); ids on or before a cycle have a NULL final_id.

    Chains double in length each round, so rounds are the logarithm of the longest. An old_id with several new ids
    takes the smallest. NULL ids are left out.
    """
    base = workspace(aliases.sparkSession)
    now = aliases.where("old_id is not null and new_id is not null").groupBy("old_id").agg(F.min("new_id").alias("at"))
    now, step = materialize(now.withColumn("done", F.lit(False)), f"{base}/0"), 0
    moving, before = now.count(), None
    while moving and moving != before:  # as many as before: only cycles are left
        step += 1
        ahead = now.select(F.col("old_id").alias("at"), F.col("at").alias("next"))
        now = materialize(now.join(ahead, "at", "left").select("old_id", F.coalesce("next", "at").alias("at"), F.col("next").isNull().alias("done")), f"{base}/{step}")
        before, moving = moving if step > 1 else None, now.where("not done").count()
    return now.select("old_id", F.when(F.col("done"), F.col("at")).alias("final_id"))


