"""Personal data, natively: patterns propose spans, checksums confirm them, nearby context words adjust a score.

Every span has a score: a prior for its kind, a bonus if its checksum holds, a bonus for a context word of its kind
in the CONTEXT code points before it. Spans of the base kinds that pass their own validator are always kept; the
kinds that only this method adds (`iban`, checked by mod-97, and `id`, a run of 9 to 19 digits that is no card but has a
context word) need a score of THRESHOLD. An IBAN ends where its country's length does, or else with the run of capitals and digits.

Defined results: a null text is the empty text; no span gives zero counts, the digest of the empty string and ''.
All offsets are code points, the end exclusive. Long texts are scanned in linear time: the patterns are possessive
and start only where a run of their characters starts (or where the last match ended), which gives the same leftmost matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Kinds in their order; the base ones first.
KINDS = ("email", "ip", "card", "phone", "iban", "id")
BASE = KINDS[:4]
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Only the head is consumed; the group looks ahead at what may follow, and at one character more if that goes on.
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))",
}
#: The length of an IBAN by country, of the registry and of countries that use the form without being in it.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY PT ST",
    26: "IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
FIXED = "^(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in LENGTHS.items()) + ")(?![A-Za-z0-9])"
WHOLE = r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+$"
#: A cheap test that any match must pass.
GATES = {"email": "@", "ip": ".", "phone": "+"}
#: Leading zeros go first; a number of zeros only has nothing behind them.
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|(?<=0))"
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.3, "phone": 0.6, "iban": 0.2, "id": 0.1}
CHECKED, NEAR, THRESHOLD, CONTEXT = 0.6, 0.5, 0.6, 40
WORDS = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "id": r"card|visa|credit|passport|ssn|social security|tax|account|konto|cuenta|compte",
}


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def _mod97(col: Column) -> Column:
    """The remainder of an IBAN, read as a number with the first four characters last and letters as 10 to 35."""
    plain = F.replace(col, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97))


def _iban(run: Column) -> Column:
    """The IBAN at the start of a run: of its country's length, or else all of the run; '' where mod-97 holds for neither."""
    fixed, whole = (F.regexp_extract(run, p, 0) for p in (FIXED, WHOLE))
    return F.when((fixed != "") & (_mod97(fixed) == 1), fixed).when((whole != "") & (_mod97(whole) == 1), whole).otherwise("")


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(found)).between(12, 19) & F.call_function("luhn_check", _digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind == "iban":
        return _mod97(found) == 1
    return F.lit(True)


def _bind(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, found: Column, pattern: str) -> Column:
    """Structs of start, end, found for each match. The lengths of the parts between matches, summed over blocks of
    the root of their number, give the offsets."""
    size = lambda items: F.aggregate(items, F.lit(0), lambda acc, x: acc + x["gap"] + x["len"])
    total = lambda sums: F.aggregate(sums, F.lit(0), lambda acc, x: acc + x)
    cells = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, f: F.struct(F.length(p).alias("gap"), F.length(f).alias("len"), f.alias("found")))

    def placed(cells: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(cells))).cast("int")
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(cells) - 1) / step).cast("int")), lambda j: size(F.slice(cells, j * step + 1, step)))

        def one(sums: Column, x: Column, k: Column) -> Column:
            block = F.floor(k / step).cast("int")
            start = total(F.slice(sums, F.lit(1), block)) + size(F.slice(cells, block * step + 1, k - block * step)) + x["gap"]
            return F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["found"].alias("found"))

        return _bind(sums, lambda sums: F.transform(cells, lambda x, k: one(sums, x, k)))

    return _bind(cells, placed)


def find_pii(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Adds `into`: an array of (start, kind_no, kind, end, score, base), by start, then kind."""
    own = [f"_vq_{k}" for k in PATTERNS]
    out = df.withColumn("_vq_text", whole_text(text))
    no_match = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        gate = F.contains("_vq_text", F.lit(GATES[kind])) if kind in GATES else F.col("_vq_text").rlike("[0-9]{2}" if kind == "iban" else r"[0-9][\x20-]?[0-9]")
        out = out.withColumn(f"_vq_{kind}", F.when(gate, F.regexp_extract_all("_vq_text", F.lit(pattern), F.lit(0))).otherwise(no_match))
    typed = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int,score:double,base:boolean>>")
    for kind in PATTERNS:
        found = F.col(f"_vq_{kind}")
        # Offsets cost a second pass, made only where a match may count.
        may, spans = F.size(found) > 0, _spans(F.col("_vq_text"), found, PATTERNS[kind])
        if kind == "card":
            may &= F.exists(found, lambda x: F.length(_digits(x)).between(9, 19))
        if kind == "iban":
            rest = F.when(may, F.regexp_extract_all("_vq_text", F.lit(PATTERNS[kind]), F.lit(1))).otherwise(no_match)
            out = out.withColumn("_vq_run", F.zip_with(found, rest, lambda a, b: _iban(F.concat(a, b))))
            may = F.exists("_vq_run", lambda x: x != "")
            spans = F.zip_with(spans, "_vq_run", lambda s, x: F.struct(s["start"].alias("start"), (s["start"] + F.length(x)).alias("end"), x.alias("found")))
            spans = F.filter(spans, lambda s: s["found"] != "")
        out = out.withColumn(f"_vq_{kind}", F.when(may, spans))
    for kind in PATTERNS:

        def scored(span: Column) -> Column:  # noqa: B023
            before = F.lower(F.substr(F.col("_vq_text"), F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT))))
            valid = _valid(kind, span["found"])
            long = F.length(_digits(span["found"])).between(9, 19) if kind == "card" else F.lit(True)
            real = F.when(valid, kind).otherwise("id" if kind == "card" else kind)
            near = F.when(valid, before.rlike(WORDS[kind])).otherwise(before.rlike(WORDS["id"]))
            prior = F.when(valid, PRIOR[kind] + CHECKED * (kind in ("card", "iban"))).otherwise(PRIOR["id"] if kind == "card" else 0.0)
            number = F.when(valid, KINDS.index(kind)).otherwise(KINDS.index("id") if kind == "card" else KINDS.index(kind))
            score = F.least(F.lit(1.0), prior + F.when(near, NEAR).otherwise(0.0))
            keep = F.when(valid, F.lit(kind in BASE)).otherwise(False)
            return F.when(long | valid, F.struct(span["start"].alias("start"), number.alias("kind_no"), real.alias("kind"), span["end"].alias("end"), score.cast("double").alias("score"), keep.alias("base")))

        spans = F.filter(F.transform(f"_vq_{kind}", scored), lambda s: s.isNotNull() & (s["base"] | (s["score"] >= THRESHOLD)))
        out = out.withColumn(f"_vq_{kind}", F.coalesce(F.when(F.col(f"_vq_{kind}").isNotNull(), spans), typed))
    return out.withColumn(into, F.array_sort(F.concat(*own))).drop("_vq_text", "_vq_run", *own)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(docs: DataFrame) -> DataFrame:
    out = find_pii(docs.select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
