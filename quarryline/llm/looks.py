"""Texts that look the same but are stored in different characters.

Width, typeface, the kind of space and look-alike letters are mapped in SQL; what is left (accents composed or not,
characters that show nothing) is equal under an accent- and case-sensitive Unicode collation. Only texts that share a
coarse key with a different text are grouped under the collation, so its long keys are made for few texts.
"""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarryline.workspace import materialize, workspace

#: Letters and marks that look like a Latin one (or like another character), and that one; fixed values.
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳμ", "ABEZHIKMNOPTYXojµ")
CYRILLIC = ("АВЕЅІЈКМНОРСТХҮӀԚԜаеорсухѕіјһԁԛԝ", "ABESIJKMHOPCTXYIQWaeopcyxsijhdqw")
#: Hyphens, the Greek question mark, Kelvin and Angstrom signs.
MARKS = ("\u2010\u2011\u037e\u212a\u212b", "--;K\u00c5")
#: Ligatures of letters are these letters; fixed values.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
#: Format characters that do show something (signs around Arabic, Syriac and Kaithi numbers), and others that show
#: nothing though Unicode doesn't file them as format characters (joiners, fillers, inherent vowels, variation selectors), as ranges of code points; fixed values.
SEEN = [(0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F)]
UNSEEN = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFFB), (0xE0000, 0xE0FFF)]


def _unseen() -> str:
    """Every character that shows nothing: Unicode's format characters but for SEEN, and UNSEEN."""
    inside = lambda code, ranges: any(a <= code <= b for a, b in ranges)
    formats = [c for c in range(0x80, 0xE1000) if unicodedata.category(chr(c)) == "Cf" and not inside(c, SEEN)]
    return "".join(chr(c) for c in sorted({*formats, *(c for a, b in UNSEEN for c in range(a, b + 1) if unicodedata.category(chr(c)) != "Cn" or b < 0xE0000)}))


GONE = _unseen()


def _single_looks() -> dict[str, str]:
    """Character -> character of the same look: by Unicode's tags for width, typeface and spaces, and by the tables above."""
    looks = {}
    for code in range(0xA0, 0x1FFFF):
        c = chr(code)
        tag, _, rest = unicodedata.decomposition(c).partition("> ")
        plain = unicodedata.normalize("NFKC", c)
        if tag in ("<wide", "<narrow", "<font", "<noBreak") and len(plain) == 1:
            looks[c] = plain
        elif unicodedata.category(c) == "Zs":
            looks[c] = " "
        elif 0x2160 <= code <= 0x217F and len(plain) == 1:  # Roman numerals of one letter
            looks[c] = plain
    for many, one in (GREEK, CYRILLIC, MARKS):
        looks |= dict(zip(many, one))
    return {c: looks.get(to, to) for c, to in looks.items() if c not in GONE and looks.get(to, to) not in GONE}


def _many_looks() -> dict[str, str]:
    """Roman numerals of several letters and ligatures -> their letters."""
    numerals = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2160, 0x2180)}
    return {c: to for c, to in numerals.items() if len(to) > 1} | LIGATURES


def _composed_looks(single: dict[str, str]) -> dict[str, str]:
    """Letters composed of a mapped letter and marks -> what that letter's look and the same marks compose to, if anything."""
    looks = {}
    for code in range(0xC0, 0x1FFFF):
        first, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and first in single and chr(code) not in single:
            looks[chr(code)] = unicodedata.normalize("NFC", single[first] + "".join(marks))
    return looks


def _accented() -> list[str]:
    """Characters that Unicode composes of several, but for Korean syllables."""
    return [chr(c) for c in range(0xC0, 0x1FFFF) if not 0xAC00 <= c <= 0xD7A3 and len(unicodedata.normalize("NFD", chr(c))) > 1]


SINGLE, MANY = _single_looks(), _many_looks()
for _c, _to in _composed_looks(SINGLE).items():
    (SINGLE if len(_to) == 1 else MANY)[_c] = _to
#: Few ranges that hold every character of MANY; a class of single characters would be several times slower.
MANY_RANGES = "[\\x{389}\\x{45E}\\x{4F3}\\x{1F00}-\\x{1FFF}\\x{2160}-\\x{217F}\\x{FB00}-\\x{FB04}]"
#: Ranges that hold every combining mark but U+0300 to U+036F, and all Korean letters; then those letters alone.
FAR_MARKS = "[\\x{483}-\\x{489}\\x{591}-\\x{1DFF}\\x{20D0}-\\x{20FF}\\x{2CEF}-\\x{10FFFF}]"
KOREAN = "[\\x{1100}-\\x{11FF}\\x{AC00}-\\x{D7A3}]"


def same_look(text: Column) -> Column:
    """Text with one character per look; accents stay composed or not as they are. NULL stays NULL.

    One pass of translate maps and deletes; character classes of many ranges would be ten times slower.
    """
    mapped = F.translate(text, "".join(SINGLE) + GONE, "".join(SINGLE.values()))
    several = mapped
    for c, letters in MANY.items():
        several = F.replace(several, F.lit(c), F.lit(letters))
    split = F.when(text.rlike(MANY_RANGES), several).otherwise(mapped)
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(split)


def coarse_key(look: Column) -> Column:
    """A hash that texts of one look share: letters with accents and Korean ones are left out, composed or not."""
    far, near = F.regexp_replace(look, f"(?s){KOREAN}\\p{{M}}*|.?\\p{{M}}+", ""), F.regexp_replace(look, "(?s).?[\\x{300}-\\x{36F}]+", "")
    bare = F.when(look.rlike(FAR_MARKS), far).when(look.rlike("[\\x{300}-\\x{36F}]"), near).otherwise(look)
    return F.xxhash64(F.when(F.octet_length(look) == F.char_length(look), look).otherwise(F.translate(bare, "".join(_accented()), "")))


def _in_runs(text: str, name: str, table: dict[int, str | None]) -> str:
    """Text with its runs outside ASCII decomposed and mapped, then composed."""
    known = sys.__dict__.setdefault("_quarryline_looks", {})
    if name not in known:
        known[name] = (str.maketrans(table), re.compile("[^\x00-\x7f]+"), {})
    mapping, runs, cache = known[name]

    def one(match: re.Match) -> str:
        run = match.group()
        got = cache.get(run)
        if got is None:
            got = unicodedata.normalize("NFD", run).translate(mapping)
            if len(cache) < 200_000:  # a cache's size, not a limit of what is mapped
                cache[run] = got
        return got

    return unicodedata.normalize("NFC", runs.sub(one, text))


def look_of(text: str) -> str:
    """The same in Python, accents composed: only runs outside ASCII are touched."""
    return text if text.isascii() else _in_runs(text, "looks", {**SINGLE, **MANY, **dict.fromkeys(GONE)})


def _caseless() -> dict[str, str | None]:
    """Character -> one character of all that share its look or differ from it in case only, one after the other.

    Cyrillic `в` is the small form of a letter that looks like `B`, so it is `b`.
    """
    up: dict[str, str] = {}

    def top(c: str) -> str:
        while up.get(c, c) != c:
            c = up[c]
        return c

    for c, look in SINGLE.items():
        for a, b in ((c, look), (c.lower(), c), (look.lower(), look)):
            if len(a) == len(b) == 1:
                one, two = sorted((top(a), top(b)), key=lambda x: (not x.isascii(), not x.islower(), x))
                up[two] = one
    return {c: top(c) for c in up if top(c) != c} | {c: to.lower() for c, to in MANY.items()} | dict.fromkeys(GONE)


def caseless_look(text: str) -> str:
    """A form that texts share whether their letters differ in case, in look-alike characters or in both."""
    low = text.lower()
    if low.isascii():
        return low
    known = sys.__dict__.setdefault("_quarryline_caseless", {})
    if not known:
        known.update(_caseless())
    return _in_runs(low, "caseless", known).lower()


#: The filter for texts asked for has 16 bits for each in bitmaps of 32,768, and so many bitmaps (16 MB) at most.
BITMAPS, BITS = 4_096, 32_768


def _marked(full: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """Rows of full whose doc_id may be among the n of asked (all that are, few others), without moving a text.

    A hash of each doc_id asked for sets a bit; the bitmaps are broadcast. With far more asked for than the 134 million
    bits at most they let all rows through, which costs time but loses nothing, as the exact join comes after.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(min(BITMAPS, 1 + n * 16 // BITS) * BITS))
    place = lambda df: df.withColumns({"__map": (spot / BITS).cast("int"), "__bit": (spot % BITS).cast("int")})
    maps = place(asked.select("doc_id")).groupBy("__map").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.expr("__bit div 8 + 1"), F.lit(1))), 16, 10).cast("int")
    return place(full).join(F.broadcast(maps), "__map").where(F.getbit(byte, F.col("__bit") % 8) == 1).select(*full.columns)


def look_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, variant, class_id) of documents whose look is stored in several ways, and (doc_id, variant) of all.

    variant is the SHA-256 of a text, class_id the smallest doc_id of its class. NULL and empty texts are left out,
    a document that is alone with its look isn't listed; exact copies share a variant. Texts of any length are
    hashed and mapped whole; only one text per variant takes part in the grouping.
    """
    base = workspace(documents.sparkSession)
    full = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    keys = full.select("doc_id", F.unhex(F.sha2("text", 256)).alias("variant"), same_look(F.col("text")).alias("look")).select("doc_id", "variant", coarse_key(F.col("look")).alias("coarse"))
    keys = materialize(keys, f"{base}/keys")
    variants = keys.groupBy("coarse", "variant").agg(F.min("doc_id").alias("doc_id"))
    shared = variants.groupBy("coarse").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("coarse")
    count = Observation()
    asked = materialize(variants.join(shared, "coarse", "left_semi").observe(count, F.count(F.lit(1)).alias("n")), f"{base}/asked")
    fewer = _marked(full, asked, count.get["n"] or 0).withColumn("variant", F.unhex(F.sha2("text", 256)))
    looks = fewer.join(asked, ["doc_id", "variant"]).select("doc_id", "variant", "coarse", same_look(F.col("text")).alias("look"))
    looks = materialize(looks, f"{base}/looks")
    canonical = looks.groupBy("coarse", F.collate("look", "UNICODE").alias("look")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    a, b = looks.alias("a"), canonical.alias("b")
    member = a.join(b, (F.col("a.coarse") == F.col("b.coarse")) & (F.collate(F.col("a.look"), "UNICODE") == F.col("b.look"))).select(F.col("a.variant").alias("variant"), F.col("first_id"))
    member = materialize(member, f"{base}/member")
    listed = keys.join(member, "variant").select("doc_id", "variant", "first_id")
    first = listed.groupBy("first_id").agg(F.min("doc_id").alias("class_id"))
    return listed.join(first, "first_id").select("doc_id", "variant", "class_id"), keys.select("doc_id", "variant")


def canonical_members(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id): every non-empty document with the document whose text stands for its look.

    Exact copies and documents of the same look share the smallest doc_id among them.
    """
    listed, keys = look_classes(documents)
    first = keys.groupBy("variant").agg(F.min("doc_id").alias("copy_of"))
    classes = listed.select("variant", "class_id").distinct()
    known = keys.join(first, "variant").join(classes, "variant", "left")
    return known.select("doc_id", F.coalesce("class_id", "copy_of").alias("class_id"))


#: Documents of one class that one task pairs with all of the class.
PART = 1_000


def look_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: two documents that look the same and are stored in different characters.

    The pairs are the stated result; they're made per class from its documents, never within one text's copies. A
    class of more than PART documents is spread over as many tasks as it has parts. canonical_members() gives the same
    in one row per document.
    """
    listed, _ = look_classes(documents)
    parts = listed.groupBy("class_id").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    placed = materialize(listed.join(parts, "class_id"), f"{workspace(documents.sparkSession)}/placed")
    a = placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).alias("a")
    b = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    met = a.join(b, (F.col("a.class_id") == F.col("b.class_id")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.variant") != F.col("b.variant")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    return met.select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b")).distinct()
