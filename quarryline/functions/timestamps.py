"""Readings of written times: every interpretation of a value, and the one that the conventions name.

Everything is a chain of projections of built-in expressions; a value's parts are split once and stay in code that
Spark generates. The session's time zone must be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zone letters with the hours they can stand for; fixed values.
LETTERS = {
    "UTC": [0], "UT": [0], "Z": [0], "GMT": [0], "WET": [0], "WEST": [1], "BST": [1, 6], "IST": [5.5, 1, 2], "CET": [1], "CEST": [2], "MET": [1], "MEST": [2],
    "EET": [2], "EEST": [3], "MSK": [3], "EST": [-5, 10], "EDT": [-4, 11], "CST": [-6, 8, 9.5], "CDT": [-5, -4], "MST": [-7], "MDT": [-6], "PST": [-8, 8], "PDT": [-7],
    "AKST": [-9], "AKDT": [-8], "HST": [-10], "AST": [-4, 3], "ADT": [-3], "NST": [-3.5], "NDT": [-2.5], "BRT": [-3], "JST": [9], "KST": [9], "HKT": [8], "SGT": [8], "AWST": [8],
    "ACST": [9.5], "ACDT": [10.5], "AEST": [10], "AEDT": [11], "NZST": [12], "NZDT": [13], "SAST": [2], "PKT": [5], "GST": [4],
}
#: Months by their first three letters; fixed values.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

CLOCK = r"(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
ZONE = r"\s*([Zz]|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5})?(?:\[([^\]]+)\])?"
TAIL = rf"(?:(?:[Tt]|,?\s+){CLOCK}{ZONE})?"
#: Form -> pattern, and which of its first three groups are year, month and day. Groups 4 to 10 are TAIL's.
FORMS = {
    "ymd": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){TAIL}$", "$1|$2|$3"),
    "packed": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt]|\s+){CLOCK}{ZONE}$", "$1|$2|$3"),
    "dotted": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){TAIL}$", "$3|$2|$1"),
    "slashed": (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){TAIL}$", "$3|$1|$2"),
    "day_month": (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]([A-Za-z]{{3,9}})\.?,?[\s-](\d{{4}}){TAIL}$", "$3|$2|$1"),
    "month_day": (rf"^(?:[A-Za-z]{{3,9}},\s+)?([A-Za-z]{{3,9}})\.?\s(\d{{1,2}}),?\s(\d{{4}}){TAIL}$", "$3|$1|$2"),
}
NUMBER = r"^-?\d{1,17}(?:\.\d+)?$"
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$"
#: Bare numbers of at least this size are milliseconds.
MILLIS_FROM = 100_000_000_000
#: Codes of interpretations: form number times 10, plus 1 for swapped day and month, plus 2 for a repeated hour's second time, plus 4 for the other unit of a number.
FORM_CODES = {name: 10 * (i + 1) for i, name in enumerate([*FORMS, "number", "canonical"])}


def is_canonical(value: Column) -> Column:
    return value.rlike(CANONICAL)


def with_readings(df: DataFrame, value: str, site_tz: str, out: str, alternatives: bool = True) -> DataFrame:
    """df with the column out: array<struct<code int, ms bigint, declared boolean>> of every valid reading of value.

    The declared reading comes first and follows the conventions: dotted dates start with the day, slashed ones that
    end with the year with the month; a local time that occurs twice is the first, a skipped one is read with the
    offset before; a zone in letters is the one of site_tz if it can be; numbers below 100,000,000,000 count seconds,
    others milliseconds; finer parts than milliseconds are cut off. Alternatives, if asked for: day and month
    swapped, the second of a repeated hour, the other unit of a number (in 1990-2099). A value that names no instant,
    an impossible date, an unknown zone, NULL and empty text give an empty array; a NULL zone is UTC. Names that
    start with two underscores are used for parts and dropped.
    """
    text = F.trim(F.regexp_replace(F.col(value), r"\s+", " "))
    base = df.withColumns({"__canonical": is_canonical(F.col(value)), "__zone": F.coalesce(F.col(site_tz), F.lit("UTC"))})
    base = base.withColumn("__text", F.when(~F.col("__canonical"), text))
    parts = F.lit(None).cast("string")
    for name, (pattern, date) in reversed(FORMS.items()):
        parts = F.when(F.col("__text").rlike(pattern), F.concat(F.lit(f"{name}|"), F.regexp_replace("__text", F.lit(pattern), F.lit(f"{date}|$4|$5|$6|$7|$8|$9|$10")))).otherwise(parts)
    base = base.withColumns({
        "__parts": F.split(parts, r"\|"),
        "__fast": F.unix_millis(F.when(F.col("__canonical"), F.substring(value, 1, 19)).try_cast("timestamp")),
        "__number": F.when(F.col("__text").rlike(NUMBER), F.col("__text").try_cast("decimal(28,9)")),
    })
    part = lambda i: F.nullif(F.get("__parts", F.lit(i)), F.lit(""))
    named_month = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    months = F.coalesce(part(2).try_cast("int"), F.try_element_at(named_month, F.lower(F.substring(part(2), 1, 3))))
    half = F.lower(part(8))
    hour24 = part(4).try_cast("int")
    hour = F.when(part(4).isNull(), 0).when(half.isNull(), hour24).when(hour24.between(1, 12), hour24 % 12 + F.when(half == "p", 12).otherwise(0))
    letters = F.upper(part(9))
    digits = F.regexp_replace(letters, "[^0-9]", "")
    minutes = F.when(letters.rlike("^[+-]"), F.when(letters.startswith("-"), -1).otherwise(1) * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))))
    base = base.withColumns({
        "__form": part(0), "__year": part(1).try_cast("int"), "__month": months, "__day": part(3).try_cast("int"), "__hour": hour, "__minute": F.coalesce(part(5), F.lit("0")).try_cast("int"),
        "__second": F.coalesce(part(6), F.lit("0")).try_cast("decimal(8,6)"), "__milli": F.rpad(F.coalesce(part(7), F.lit("")), 3, "0").try_cast("bigint"), "__letters": letters, "__minutes": minutes, "__bracket": part(10),
    })
    stamp = lambda m, d: F.try_make_timestamp_ntz(F.col("__year"), m, d, F.col("__hour"), F.col("__minute"), F.col("__second")).cast("timestamp")
    swappable = F.col("__form").isin("dotted", "slashed") & (F.col("__month") != F.col("__day")) & F.lit(alternatives)
    base = base.withColumns({"__local": stamp(F.col("__month"), F.col("__day")), "__swapped": F.when(swappable, stamp(F.col("__day"), F.col("__month"))), "__named": F.col("__letters").isNotNull() & F.col("__minutes").isNull()})

    def season(month: int) -> Column:
        moment = F.try_make_timestamp_ntz(F.col("__year"), F.lit(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")).cast("timestamp")
        return ((F.unix_seconds(F.from_utc_timestamp(moment, F.col("__zone"))) - F.unix_seconds(moment)) / 60).cast("int")

    choices = F.try_element_at(F.create_map(*[x for name, hours in LETTERS.items() for x in (F.lit(name), F.array(*[F.lit(int(h * 60)) for h in hours]))]), F.col("__letters"))
    base = base.withColumns({"__choices": F.when(F.col("__named"), choices), "__winter": F.when(F.col("__named"), season(1)), "__summer": F.when(F.col("__named"), season(7))})
    first, second = F.get("__choices", F.lit(0)), F.get("__choices", F.lit(1))
    third = F.get("__choices", F.lit(2))
    fits = lambda c: (c == F.col("__winter")) | (c == F.col("__summer"))
    named = F.when(fits(second), second).when(fits(third), third).otherwise(first)
    named = F.when(fits(first), first).otherwise(named)
    base = base.withColumns({"__fixed": F.coalesce("__minutes", named), "__at": F.coalesce("__bracket", "__zone")})
    readable = F.col("__letters").isNull() | F.col("__fixed").isNotNull()

    def epoch(local: str) -> Column:
        shifted = F.unix_millis(local) - F.col("__fixed").cast("bigint") * 60_000
        zoned = F.unix_millis(F.to_utc_timestamp(local, F.col("__at")))
        return F.when(readable & F.col(local).isNotNull(), F.when(F.col("__fixed").isNotNull(), shifted).otherwise(zoned) + F.coalesce("__milli", F.lit(0)))

    known_zone = F.col("__at").isNull() | F.col("__at").rlike(r"^[A-Za-z]+(?:[/_+-][A-Za-z0-9]+)*$")
    base = base.withColumn("__local", F.when(known_zone, F.col("__local")))
    seconds = F.abs("__number") < MILLIS_FROM
    scaled = lambda factor: F.floor(F.col("__number") * factor).cast("bigint")
    reading = lambda code, ms, declared: F.when(ms.isNotNull(), F.struct(code.cast("int").alias("code"), ms.cast("bigint").alias("ms"), F.lit(declared).alias("declared")))
    code = F.lit(None).cast("int")
    for name, number in FORM_CODES.items():
        code = F.when(F.col("__form") == name, number).otherwise(code)
    main = F.when(F.col("__canonical"), F.col("__fast")).when(F.col("__number").isNotNull(), F.when(seconds, scaled(1000)).otherwise(scaled(1))).otherwise(epoch("__local"))
    kind = F.when(F.col("__canonical"), FORM_CODES["canonical"]).when(F.col("__number").isNotNull(), FORM_CODES["number"]).otherwise(code)
    found = [reading(kind, main, True)]
    if alternatives:
        other = F.when(seconds, scaled(1)).otherwise(scaled(1000))
        utc = F.to_utc_timestamp("__local", F.col("__at"))
        repeats = [F.when(F.col("__fixed").isNull() & (F.from_utc_timestamp(utc + F.expr(f"interval {m} minutes"), F.col("__at")) == F.col("__local")), F.unix_millis(utc) + m * 60_000 + F.coalesce("__milli", F.lit(0))) for m in (60, 30)]
        found += [
            reading(kind + 4, F.when(other.between(631_152_000_000, 4_102_444_800_000), other), False),
            reading(kind + 1, epoch("__swapped"), False),
            reading(kind + 2, F.when(F.col("__letters").isNull(), F.coalesce(*repeats)), False),
        ]
    # the condition always holds; not being deterministic, it keeps filters on the result from being copied into every step above
    base = base.withColumn(out, F.when(F.monotonically_increasing_id() >= 0, F.array_compact(F.array(*found))))
    return base.select(*df.columns, out)
