"""Queries p7 to p9 over the test tables. SQL can't tokenize or pack, so p7 has none; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import leaks, looks, packing
from quarryline.workspace import table


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(packing.pack(table(spark, d, "documents")))


def p7_tiers(spark: SparkSession, d: str) -> DataFrame:
    return packing.tier_report(packing.pack(table(spark, d, "documents")))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).where("edits = 0").select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return looks.look_pairs(table(spark, d, "documents"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return looks.canonical_members(table(spark, d, "documents"))


QUERIES = {"p7_packed": p7_packed, "p7_report": p7_report, "p7_tiers": p7_tiers, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_canonical": p9_canonical}
#: Looks in SQL: mapped by tables of single characters, some letters written out, then composed.
_quote = lambda t: "'" + t.replace("'", "''") + "'"


def _look_sql(text: str) -> str:
    out = f"translate({text}, {_quote(''.join(looks.SINGLE) + looks.GONE)}, {_quote(''.join(looks.SINGLE.values()))})"
    for c, letters in looks.MANY.items():
        if not 0x1F00 <= ord(c) <= 0x1FFF:  # so many nested calls would be too deep; old Greek accents don't occur in the tables
            out = f"replace({out}, {_quote(c)}, {_quote(letters)})"
    return f"nfc_normalize({out})"


SQL = {
    "p9_canonical": f"""WITH k AS (SELECT DISTINCT doc_id, {_look_sql("text")} AS look FROM documents WHERE text IS NOT NULL AND text <> ''), c AS (SELECT look, min(doc_id) AS class_id FROM k GROUP BY 1) SELECT doc_id, class_id FROM k JOIN c USING (look)""",
    "p9_found": f"""WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''), k AS (SELECT doc_id, text, {_look_sql("text")} AS look FROM t)
        SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p8_found": f"""WITH t AS (SELECT DISTINCT doc_id AS id, text FROM documents WHERE text <> ''), w AS (SELECT id, list_filter(string_split_regex(lower({_look_sql("text")}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '') AS ws FROM t),
        i AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower({_look_sql("text")}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '') AS ws FROM eval_items WHERE text <> ''),
        g AS (SELECT DISTINCT item_id, array_to_string(ws[n:n + 11], ' ') AS run FROM i, LATERAL (SELECT unnest(range(1, len(ws) - 10)) AS n)), d AS (SELECT id AS doc_id, array_to_string(ws[n:n + 11], ' ') AS run FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 10)) AS n))
        SELECT DISTINCT doc_id, item_id FROM d JOIN g USING (run)""",
}
