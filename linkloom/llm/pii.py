"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score. Native throughout.

Every text is searched as a whole, in one projection without a shuffle, so partitions of any size and any number of
machines do the same work and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import let

from ._common import fresh, n_of, spans_text, with_matches

#: Possessive forms and look-behinds give the same matches as the plain patterns and keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What every match holds. These cost less than the patterns, and few texts hold them; the rest is not searched for the kind.
MARKS = {"email": "@", "phone": "+"}
NEEDS = {
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
}
BASE = ("email", "ip", "card", "phone")
#: Score of a valid span, what a context word adds, and the words.
SCORES = {
    "email": (0.9, 0.1, "mail|contact|write to"),
    "ip": (0.6, 0.3, r"\bip\b|address|host|server|login"),
    "card": (0.8, 0.2, "card|visa|credit|payment|karte|carte|tarjeta"),
    "phone": (0.7, 0.2, r"phone|call|\btel\b|mobile|fax|telefon"),
    "iban": (0.9, 0.1, "iban|bank|account|konto|compte|cuenta"),
    "ssn": (0.3, 0.4, r"\bssn\b|social security|taxpayer"),
}
NEAR = 40


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _chars(v: Column) -> Column:
    return F.filter(F.split(v, ""), lambda c: c != "")


def _small(part: Column) -> Column:
    """A decimal number of any length, leading zeros included, is at most 255."""
    short = F.ltrim(part, F.lit("0"))
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    weighed = F.transform(
        _chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))
    )
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(v: Column) -> Column:
    """ISO 7064 remainder 1 of an account number whose first four characters count last."""
    flat = F.replace(v, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))
    step = lambda r, c: F.when(c.between("0", "9"), r * 10 + F.ascii(c) - 48).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.length(flat).between(15, 34) & (F.aggregate(_chars(turned), F.lit(0), step) == 1)


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), _small)
    if kind == "card":
        return F.length(_digits(v)).between(16, 19) & luhn(_digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(8, 15)
    if kind == "iban":
        return mod97(v)
    if kind == "ssn":
        return ~v.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _scored(kind: str, spans: Column, min_score: float) -> Column:
    start, bonus, words = SCORES[kind]
    scored = F.transform(
        F.filter(spans, lambda x: valid(kind, x["v"])),
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            x["s"].alias("start"),
            x["e"].alias("end"),
            (F.lit(start) + F.when(F.lower(x["near"]).rlike(words), bonus).otherwise(0.0)).alias("score"),
        ),
    )
    return scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= min_score)


def may_hold(kind: str, text: Column, digits: Column) -> Column:
    """False where the text cannot match the kind's pattern. digits: whether it has any, worked out once for all kinds."""
    return F.contains(text, F.lit(MARKS[kind])) if kind in MARKS else digits & text.rlike(NEEDS[kind])


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii", min_score: float = 0.5) -> DataFrame:
    """Adds `out`: array<struct<kind, start, end, score>>, by kind as in PATTERNS, then start; code points, end exclusive.

    The kinds of BASE are kept whatever their score; the others from `min_score` on. A null or empty text has no
    spans. All other columns and rows, repeated ones too, pass unchanged; a column named `out` is replaced, and no
    other name matters.
    """
    own = {k: fresh(docs, "_k") + k for k in PATTERNS}
    digits = fresh(docs, "_k") + "digits"
    needs = {own[k]: may_hold(k, F.col(text), F.col(digits)) for k in PATTERNS}
    df = docs.withColumn(digits, F.col(text).rlike("[0-9]"))
    df = with_matches(df, text, {own[k]: p for k, p in PATTERNS.items()}, NEAR, needs)
    kinds = [_scored(k, F.col(own[k]), min_score) for k in PATTERNS]
    return df.withColumn(out, F.concat(*kinds)).drop(digits, *own.values())


#: Characters of the pieces that a text is cut into before spans are taken out of it; spans of a block of the fold.
PIECE, BLOCK = 4096, 64
_KEPT = "array<struct<start:bigint,end:bigint,kind:string>>"


def _first_of_overlapping(spans: Column) -> Column:
    """Spans in order, those that begin inside one kept before left out. In blocks, so that long arrays stay near linear."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))
    state = lambda end, kept: F.struct(end.cast("long").alias("end"), kept.cast(_KEPT).alias("kept"))
    one = lambda x: F.array(F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind")))
    step = lambda acc, x: F.when(x["start"] >= acc["end"], state(-x["end"], F.concat(acc["kept"], one(x)))).otherwise(acc)

    def over(o: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(o) - 1) / BLOCK).cast("int")), lambda i: F.slice(o, i * BLOCK + 1, F.lit(BLOCK)))

        def block(acc: Column, b: Column) -> Column:
            return let(F.aggregate(b, state(acc["end"], F.array()), step), lambda r: state(r["end"], F.concat(acc["kept"], r["kept"])))

        return F.aggregate(blocks, state(F.lit(0), F.array()), block)["kept"]

    return let(order, over)


def redact(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Puts [KIND] in place of each span; of overlapping ones the first stays, of equal starts the longest. Native.

    A text without spans, or null, stays as it is. No other column's name matters. The text is cut into pieces once
    and spans are taken out of those, so very long texts with many spans take no walk of their own for each span.
    """
    own = fresh(docs, "_r")
    kept, cut = own + "kept", own + "cut"
    some = F.coalesce(F.size(spans), F.lit(0)) > 0
    df = docs.withColumn(kept, F.when(some, _first_of_overlapping(F.col(spans))).otherwise(F.array().cast(_KEPT)))
    df = df.withColumn(cut, F.when(some, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def between(a: Column, b: Column) -> Column:
        """Characters a to b of the text."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        at = lambda i: F.coalesce(F.get(F.col(cut), i), F.lit(""))
        off, end = (a % PIECE).cast("int"), (b % PIECE).cast("int")
        inside = F.substring(at(first), off + 1, end - off)
        across = F.concat(F.substring(at(first), off + 1, F.lit(PIECE)), F.array_join(F.slice(F.col(cut), first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.left(at(last), end))
        return F.when(first == last, inside).otherwise(across)

    starts = F.concat(F.array(F.lit(0).cast("long")), F.col(f"{kept}.end"))
    parts = F.zip_with(F.slice(starts, F.lit(1), F.size(kept)), F.col(kept), lambda p, x: F.concat(between(p, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    new = F.concat(F.array_join(parts, ""), between(F.element_at(starts, -1), F.length(text).cast("long")))
    return df.withColumn(text, F.when(F.size(kept) > 0, new).otherwise(F.col(text))).drop(kept, cut)


def digest(found: DataFrame, spans: str = "pii") -> DataFrame:
    """The contract's columns: counts and hash of the base spans, and all spans as text."""
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(n_of(F.col(spans), k).alias(f"n_{k}") for k in BASE),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col(spans)).alias("spans"),
    )
