"""Plain Python versions of the problems, for tests on small tables."""

import collections
import datetime as dt
import json
import re
from zoneinfo import ZoneInfo

MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
LETTERS = {"UTC": 0, "GMT": 0, "Z": 0, "CET": 1, "CEST": 2, "BST": 1, "EST": -5, "EDT": -4, "PST": -8, "PDT": -7, "JST": 9, "AEST": 10, "AEDT": 11, "IST": 5.5}
EPOCH = dt.datetime(1970, 1, 1)


def instant_ms(value, zone):
    """Epoch milliseconds of a written time or None."""
    if value is None:
        return None
    s = " ".join(value.split())
    if re.fullmatch(r"\d+(\.\d+)?", s) and not re.fullmatch(r"\d{8}", s):
        whole, _, rest = s.partition(".")
        return int(whole) if int(whole) >= 10**11 else int(whole) * 1000 + int((rest + "000")[:3])
    clock = r"(?:[T ,]+(\d{1,2}):?(\d\d)(?::?(\d\d)(?:\.(\d+))?)?(?: ?([AP]M))?)?(?: ?(Z|[+-]\d\d(?::?\d\d)?|[A-Z]{2,5}))?(?:\[.*\])?"
    for pattern, order in (
        (r"(\d{4})[-/](\d\d)[-/](\d\d)", (1, 2, 3)), (r"(\d{4})(\d\d)(\d\d)", (1, 2, 3)), (r"(\d\d)\.(\d\d)\.(\d{4})", (3, 2, 1)), (r"(\d\d)/(\d\d)/(\d{4})", (3, 1, 2)),
        (r"(?:\w{3}, )?(\d{1,2}) ([A-Z][a-z]+) (\d{4})", (3, 2, 1)), (r"([A-Z][a-z]+) (\d{1,2}), (\d{4})", (3, 1, 2)),
    ):
        m = re.fullmatch(pattern + clock, s)
        if not m:
            continue
        year, month, day = (m[i] for i in order)
        month = MONTHS[month[:3].lower()] if month.isalpha() else int(month)
        hour, minute, second = int(m[4] or 0), int(m[5] or 0), int(m[6] or 0)
        if m[8]:
            hour = hour % 12 + 12 * (m[8] == "PM")
        try:
            local = dt.datetime(int(year), month, int(day), hour, minute, second)
        except ValueError:
            return None
        milli = int(((m[7] or "") + "000")[:3])
        if m[9] and m[9][0] in "+-":
            digits = m[9][1:].replace(":", "")
            offset = (int(digits[:2]) * 60 + int(digits[2:] or 0)) * (-1 if m[9][0] == "-" else 1)
        elif m[9]:
            offset = int(LETTERS[m[9]] * 60)
        else:
            offset = local.replace(tzinfo=ZoneInfo(zone or "UTC"), fold=0).utcoffset().total_seconds() / 60
        return int(((local - EPOCH) - dt.timedelta(minutes=offset)) / dt.timedelta(milliseconds=1)) + milli
    return None


CANONICAL = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00")


def p6(tables):
    out = set()
    for name, field, rows in tables:
        for r in rows:
            ms = instant_ms(r[field], r["site_tz"])
            if ms is not None and not CANONICAL.fullmatch(r[field]):
                out.add((name, r["row_no"], field, ms))
    return out


def p5(events):
    first = {}
    for e in events:
        k = (e["repo_key"], e["event_id"])
        if k not in first or (e["recorded_at"], e["row_no"]) < (first[k]["recorded_at"], first[k]["row_no"]):
            first[k] = e
    out, week = set(), 7 * 86_400_000
    for k, e in first.items():
        at, came = instant_ms(e["occurred_at"], e["site_tz"]), instant_ms(e["recorded_at"], None)
        if at is None:
            continue
        end = (at - 4 * 86_400_000) // week * week + 4 * 86_400_000 + week
        if came >= end:
            out.add((*k, "corrects" if came < end + 4 * week else "cut"))
    return out


def json_type(v):
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "object" if isinstance(v, dict) else ("array", frozenset(json_type(x) for x in v if x is not None))


def p2(rows):
    keys = {"repos": ["repo_key"], "findings": ["repo_key", "finding_id"], "meta": ["key"]}
    files = collections.defaultdict(dict)
    for r in rows:
        f = files[r["producer"], r["dataset"]].setdefault((r["file_no"], r["file_name"]), {"values": collections.defaultdict(set), "types": collections.defaultdict(set), "records": set()})
        try:
            doc = json.loads(r["body"])
        except ValueError:
            continue
        own = keys[r["dataset"]]
        key = tuple(doc.get(k) for k in own)
        f["records"].add(key)
        for name, v in doc.items():
            if name not in own and v is not None:
                f["values"][name].add((key, json.dumps(v, sort_keys=True)))
                f["types"][name].add(json_type(v))
    out = set()
    for chain in files.values():
        ordered = sorted(chain)
        for a, b in zip(ordered, ordered[1:]):
            old, new, name = chain[a], chain[b], b[1]
            both = old["records"] & new["records"]
            common = lambda f, x: {p for p in f["values"][x] if p[0] in both}
            fresh, gone = set(new["types"]) - set(old["types"]), set(old["types"]) - set(new["types"])
            pairs = {(n, g) for n in fresh for g in gone if common(new, n) and common(new, n) == common(old, g)}
            out |= {(name, n, "renamed") for n, _ in pairs}
            out |= {(name, n, "added") for n in fresh - {n for n, _ in pairs}} | {(name, g, "removed") for g in gone - {g for _, g in pairs}}
            out |= {(name, n, "retyped") for n, g in pairs | {(x, x) for x in set(new["types"]) & set(old["types"])} if new["types"][n] != old["types"][g]}
    return out
