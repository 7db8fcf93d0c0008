"""Secrets: single patterns, and credentials whose parts are linked by an interval join. Native throughout.

Strong kinds are reported by themselves. Weak parts (a bare 40-character key, an endpoint) say little alone; they are
reported where a complementary part lies within `scope` characters: a bare key near an access identifier, an endpoint
near an access identifier or a bare key that is itself linked. The interval join is an equi-join on a cell of `scope`
characters, each part probing its own cell and both neighbours, so its work follows the number of parts, and only
parts of documents that hold a weak one are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, n_of, spans_text, with_matches

#: As for personal data: the same matches as the plain patterns, in linear time.
PATTERNS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
WEAK = {
    "key": r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_.=-])",
    "endpoint": r"(?<![A-Za-z0-9])(?:https?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._:@/-]{4,200}",
}
BASE = tuple(PATTERNS)
#: What each weak kind needs nearby; a linked key counts for an endpoint as well.
NEEDS = {"key": ("access",), "endpoint": ("access", "assign", "hex")}
SCOPE = 400
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), scope: int = SCOPE) -> DataFrame:
    """Returns `keep` and `secrets`: array<struct<start, rank, end, kind>> by start, then kind as listed.

    Offsets are code points, end exclusive. A null or empty text has no spans. Each input row gives one row; equal
    rows give equal ones. Columns not in `keep` play no part, whatever their names.
    """
    kinds = PATTERNS | WEAK
    own = {k: f"_sec_{k}" for k in kinds}
    df = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text).alias("_text"))
    df = with_matches(df, "_text", {own[k]: p for k, p in kinds.items()})
    df = df.withColumn(own["assign"], F.filter(own["assign"], lambda x: F.length(F.regexp_extract(x["v"], r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?(.*)$", 1)) >= 6))
    span = lambda k: F.transform(
        own[k],
        lambda x: F.struct(x["s"].alias("start"), F.lit(list(kinds).index(k)).alias("rank"), x["e"].alias("end"), F.lit(k).alias("kind")),
    )
    df = df.select(
        *(f"_k{i}" for i in range(len(keep))),
        F.xxhash64("_text").alias("_th"),
        F.concat(*map(span, PATTERNS)).cast(_SPAN).alias("_base"),
        F.concat(*map(span, WEAK)).cast(_SPAN).alias("_weak"),
    )
    # Only places leave the scan: the table below is small, and rows with weak parts are few.
    df = materialize(df, "secrets")
    keys = [f"_k{i}" for i in range(len(keep))]
    linked = _linked(df.filter(F.size("_weak") > 0).dropDuplicates([*keys, "_th"]), keys, scope)
    same = F.lit(True)
    for k in [*keys, "_th"]:
        same &= F.col(f"d.{k}").eqNullSafe(F.col(f"l.{k}"))
    weak = df.filter(F.size("_weak") > 0).alias("d").join(linked.alias("l"), same, "left").select(
        *(F.col(f"d.{k}") for k in keys), F.array_sort(F.concat("d._base", F.coalesce("l._linked", F.array().cast(_SPAN)))).alias("secrets")
    )
    alone = df.filter(F.size("_weak") == 0).select(*keys, F.array_sort("_base").alias("secrets"))
    return alone.unionByName(weak).select(*(F.col(k).alias(c) for k, c in zip(keys, keep)), "secrets")


def _linked(df: DataFrame, keys: list[str], scope: int) -> DataFrame:
    """The weak spans that have what they need within `scope` characters, by document."""
    id_ = [*keys, "_th"]
    part = df.select(*id_, F.explode(F.concat("_base", "_weak")).alias("p")).select(*id_, "p.*")
    cell = F.floor(F.col("start") / scope)
    held = part.select(*id_, F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("kind").alias("kind2"), cell.alias("_cell"))

    def join(weak: DataFrame, held: DataFrame, needs: tuple[str, ...]) -> DataFrame:
        probe = weak.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
        on = (F.col("p._cell") == F.col("h._cell")) & (F.abs(F.col("p.start") - F.col("h.s2")) <= scope) & (F.col("h.s2") != F.col("p.start"))
        for k in id_:
            on &= F.col(f"p.{k}").eqNullSafe(F.col(f"h.{k}"))
        return probe.alias("p").join(held.filter(F.col("kind2").isin(*needs)).alias("h"), on, "left_semi").drop("_cell").distinct()

    key = join(part.filter(F.col("kind") == "key"), held, NEEDS["key"])
    known = held.filter(F.col("kind2") != "key").unionByName(
        key.select(*id_, F.col("start").alias("s2"), F.col("end").alias("e2"), F.lit("key").alias("kind2"), cell.alias("_cell"))
    )
    end = join(part.filter(F.col("kind") == "endpoint"), known, (*NEEDS["endpoint"], "key"))
    return key.unionByName(end).groupBy(*id_).agg(F.collect_list(F.struct("start", "rank", "end", "kind")).cast(_SPAN).alias("_linked"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts and hash of the base spans, and all spans as text."""
    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(n_of(F.col("secrets"), k).alias(f"n_{k}") for k in BASE),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("secrets")).alias("spans"),
    )
