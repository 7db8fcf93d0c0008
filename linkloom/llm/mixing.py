"""Mixing sources to target weights: certain whole copies, then Pareto order sampling of the rest. Native throughout.

Every document has an inclusion probability of its own, proportional to a measure (the square root of its size, or a
given weight) and scaled so that the words expected are those still missing; units that would come above 1 are certain.
Documents are ranked by random odds over inclusion odds and taken until the source's words are filled.

Only sizes and hashes leave the scan. Targets and scales are settled on one row a source (and measure). The ranking is
cut by histograms of the rank variable, one inside a cell of the other, and only the rows in the innermost cell are
sorted. So a source with a third of all rows is never sorted in one task. What comes of it is a mark on one row a
source; each document then decides by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, n_words

#: Above this many sources the source table is joined by shuffle (AQE splits a hot source), below it is broadcast.
BROADCAST_SOURCES = 50_000
#: A source's rows that one task sorts at the cut; beyond it the cell is cut again.
SORT_ROWS = 1_000_000


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """One row a source: _source, source_size, target.

    Sources in code point order, null last, weigh `weights`, repeating, and share the sum of all sizes; a target stops
    at `most` times its source's size and the excess is shared again by weight until none is above.
    """
    sources = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    # Ranks without one task for all sources: ranges in order, and the rows before each range.
    order = F.col("_source").asc_nulls_last()
    ranged = materialize(
        sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "sources"
    )
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1 + F.col("_before")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    table = materialize(ranged.join(parts, "_part").select("_source", "source_size", weight.alias("_w")), "weights")

    cap = most * F.col("source_size")
    first = table.agg(F.sum("source_size").alias("t"), F.sum("_w").alias("w")).first()
    total, level, capped = first.t or 0, 0.0, -1
    if total:
        level = total / first.w
        while True:
            above = F.col("_w") * level > cap
            row = table.agg(
                F.count(F.when(above, 1)).alias("n"),
                F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("held"),
                F.sum(F.when(~above, F.col("_w"))).alias("w"),
            ).first()
            if row.n == capped or not row.w:
                break
            capped, level = row.n, (total - row.held) / row.w
    return table.select("_source", "source_size", F.least(F.col("_w") * level, cap).alias("target"))


def row_hash(key: str, text: str, seed: int = 20) -> Column:
    return F.xxhash64(F.col(key), F.col(text), F.lit(seed))


def _name(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def measure(size: Column, weight: Column | None = None) -> Column:
    """What inclusion probabilities are proportional to: the weight (null: 1), or else the square root of the size; rounded
    down to an eighth of a power of two, so that a source has few distinct measures. 0 where it is not positive."""
    m = F.sqrt(size) if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))
    return F.when(m > 0, F.pow(F.lit(2.0), F.floor(F.log2(m) * 8) / 8)).otherwise(0.0)


def _scales(sized: DataFrame, table: DataFrame) -> DataFrame:
    """_s, _scale: a document's probability is min(1, _scale * measure), and the words expected are the source's _rest.

    Certain units leave the others more: from the largest measure down, those before the first that does not reach 1
    are certain. Works on one row for each source and measure.
    """
    each = sized.groupBy("_s", "_x").agg(F.sum("size").alias("n")).filter("_x > 0 and n > 0").join(table.select("_s", "_rest"), "_s")
    down = Window.partitionBy("_s").orderBy(F.desc("_x"))
    held = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(F.col("n") * F.col("_x")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    each = each.withColumn("_scale", F.greatest(F.col("_rest") - held, F.lit(0.0)) / left)
    return each.filter(F.col("_scale") * F.col("_x") < 1).groupBy("_s").agg(F.max_by("_scale", "_x").alias("_scale"))


def _ranked(df: DataFrame) -> DataFrame:
    """Adds _t, the rank variable from 0 to 1: random odds over inclusion odds, as a share. Certain units have 0."""
    u = (F.shiftrightunsigned(F.col("_h"), 11) + 0.5) / float(1 << 53)
    p = F.least(F.coalesce(F.col("_scale"), F.lit(1.0)) * F.col("_x"), F.lit(1.0))
    out, in_ = u * (1 - p), (1 - u) * p
    return df.withColumn("_t", F.when(in_ > 0, out / (out + in_)).otherwise(1.0))


def _copies() -> Column:
    """Copies of a ranked row that is not at its source's mark: one more where it comes before it."""
    return (F.col("_whole") + F.when(_place() < _mark(), 1).otherwise(0)).cast("long")


def _place() -> Column:
    return F.struct(F.col("_t").alias("t"), F.col("_h").alias("h"), F.col("size").alias("n"))


def _mark() -> Column:
    return F.struct(F.col("_mt").alias("t"), F.col("_mh").alias("h"), F.col("_ms").alias("n"))


def _plan(sized: DataFrame, weights: tuple[float, ...], most: float, cells: int) -> DataFrame:
    """One row a source: _s, source_size, target, _whole, _scale, the mark (_mt, _mh, _ms) and _mn.

    A document takes _whole copies, and one more if its place (_t, _h, size) comes before the mark. Of rows at the
    mark, equal in hash and size, _mn take one more.
    """
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    table = source_targets(sized, weights, most).withColumn("_s", _name("_source")).withColumn("_whole", F.floor(ratio)).drop("_source")
    table = table.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    table = materialize(table.join(_scales(sized, table), "_s", "left"), "scales")
    hint = _hint(table)

    fine = F.when(F.col("_t") == 0, -1).otherwise(F.least(F.floor(F.col("_t") * (cells * cells)), F.lit(cells * cells - 1))).cast("long")
    ranked = _ranked(sized.select("_s", "_h", "size", "_x").join(hint(table.select("_s", "_scale", "_rest")), "_s")).withColumn("_fine", fine)
    ranked = ranked.withColumn("_coarse", F.floor(F.col("_fine") / cells))

    def cut(rows: DataFrame, cell: str, base: Column) -> DataFrame:
        """_s, _cut, _base, _rows: the first cell in which the words reach _rest, the words before it and its rows."""
        upto = F.sum("_n").over(Window.partitionBy("_s").orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hist = rows.groupBy("_s", cell).agg(F.sum("size").alias("_n"), F.count("*").alias("_c"), F.first("_rest").alias("_rest"), F.first(base).alias("_b")).withColumn("_upto", upto + F.col("_b"))
        hist = hist.filter((F.col("_upto") >= F.col("_rest")) & (F.col("_rest") > 0))
        return materialize(hist.groupBy("_s").agg(F.min(cell).alias("_cut"), F.min_by(F.col("_upto") - F.col("_n"), cell).alias("_base"), F.min_by("_c", cell).alias("_rows")), "cut")

    edge, cell = cut(ranked, "_coarse", F.lit(0).cast("long")), "_coarse"
    if (edge.agg(F.max("_rows")).first()[0] or 0) > SORT_ROWS:
        edge, cell = cut(ranked.join(hint(edge.drop("_rows")), "_s").filter("_coarse = _cut"), "_fine", F.col("_base")), "_fine"
    marks, width = edge.drop("_rows"), cells if cell == "_coarse" else cells * cells
    # All certain units lie in cell -1, which is taken whole; the place is set where sorting finds it.
    running = F.sum("size").over(Window.partitionBy("_s").orderBy("_t", "_h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = ranked.join(hint(marks), "_s").filter(f"{cell} = _cut and _cut >= 0").withColumn("_mid", F.col("_base") + running - F.col("size") / 2)
    mark = F.max(F.when(F.col("_mid") <= F.col("_rest"), _place())).over(Window.partitionBy("_s"))
    taken = edge.withColumn("_p", mark).filter((F.col("_mid") <= F.col("_rest")) & (_place() == F.col("_p")))
    marks = marks.join(taken.groupBy("_s").agg(F.first("_p").alias("_p"), F.count("*").alias("_mn")), "_s", "left")
    low, high = -(1 << 63), (1 << 63) - 1
    none = F.col("_cut").isNull()
    at = lambda f, cell, never: F.coalesce(F.col(f"_p.{f}"), F.when(none, never).when(F.col("_cut") < 0, F.lit(high if f != "t" else 0.0)).otherwise(cell))
    return materialize(
        table.join(marks, "_s", "left").select(
            "_s",
            "source_size",
            "target",
            "_whole",
            "_scale",
            at("t", F.col("_cut") / float(width), F.lit(-1.0)).alias("_mt"),
            at("h", F.lit(low), F.lit(low)).alias("_mh"),
            at("n", F.lit(low), F.lit(low)).alias("_ms"),
            F.coalesce("_mn", F.lit(0)).cast("long").alias("_mn"),
        ),
        "plan",
    )


def _hint(table: DataFrame):
    return F.broadcast if table.count() <= BROADCAST_SOURCES else (lambda df: df)


def _sized(key: str, text: str, source: str, weight: str | None, seed: int) -> list[Column]:
    """_key, _source, _s, size, _h and _x of a row."""
    size, name = n_words(F.col(text)), F.col(source).cast("string")
    return [
        F.col(key).alias("_key"),
        name.alias("_source"),
        F.coalesce(F.concat(F.lit("s"), name), F.lit("n")).alias("_s"),
        size.alias("size"),
        row_hash(key, text, seed).alias("_h"),
        measure(size, None if weight is None else F.col(weight)).alias("_x"),
    ]


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    weight: str | None = None,
    seed: int = 20,
    cells: int = 4096,
) -> DataFrame:
    """Returns key, size (words), source_size, target, copies, row_hash, probability and taken, a row for each input row.

    A source's ratio of target to size gives every document its whole copies; the rest of the target is filled by
    Pareto order sampling with inclusion probabilities proportional to `weight` (a column; null: 1, not positive: last)
    or else to the square root of the size, to the nearest document. Random numbers are hashes of key, text and seed, so reruns
    agree; of rows equal in hash and size at the cut any may be the one taken. A null or empty text has size 0 and takes
    nothing. A null source is a source. An empty table gives none. Other columns play no part.
    """
    sized = materialize(docs.select(_sized(key, text, source, weight, seed)), "sized")
    plan = _plan(sized, weights, most, cells)
    ranked = _ranked(sized.drop("_source").join(_hint(plan)(plan), "_s"))
    nth = F.row_number().over(Window.partitionBy("_s").orderBy("_h", "size", "_key"))
    away = ranked.filter(_place() != _mark()).withColumn("copies", _copies())
    edge = ranked.filter(_place() == _mark()).withColumn("copies", F.col("_whole") + F.when(nth <= F.col("_mn"), 1).otherwise(0))
    return away.unionByName(edge).select(
        F.col("_key").alias(key),
        "size",
        "source_size",
        "target",
        F.col("copies").cast("long").alias("copies"),
        F.col("_h").alias("row_hash"),
        F.least(F.coalesce(F.col("_scale"), F.lit(1.0)) * F.col("_x"), F.lit(1.0)).alias("probability"),
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    weight: str | None = None,
    seed: int = 20,
    cells: int = 4096,
) -> DataFrame:
    """The documents that the mix takes, with `copies` and `taken` added (columns of those names are replaced).

    Rows equal in key and text become one row with the sum of their copies. No other column's name matters. Every
    document decides by its own row, so texts stay in place; only texts of repeated rows are shuffled.
    """
    sized = materialize(docs.select(_sized(key, text, source, weight, seed)), "sized")
    plan = _plan(sized, weights, most, cells)
    again = materialize(sized.groupBy("_h").agg(F.count("*").alias("_rows")).filter("_rows > 1").select("_h"), "again")
    fields = [c for c in docs.columns if c.lower() not in ("copies", "taken")]
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in fields)).alias("_doc"), F.col(text).alias("_text"), *_sized(key, text, source, weight, seed))
    ranked = _ranked(kept.join(_hint(plan)(plan.drop("source_size", "target")), "_s"))
    one = _copies() + F.when(_place() == _mark(), F.least(F.col("_mn"), F.lit(1))).otherwise(0)
    if again.isEmpty():
        out = ranked.select("_doc", "size", one.alias("copies"))
    else:
        hint = _hint(again)
        out = ranked.join(hint(again), "_h", "left_anti").select("_doc", "size", one.alias("copies"))
        many = ranked.join(hint(again), "_h", "left_semi").groupBy("_key", "_text", "_s", "_h", "size", "_t", "_whole", "_mt", "_mh", "_ms", "_mn").agg(F.count("*").alias("_n"), F.first("_doc").alias("_doc"))
        copies = F.col("_n") * _copies() + F.when(_place() == _mark(), F.least("_mn", "_n")).otherwise(0)
        many = many.withColumn("copies", copies).groupBy("_key", "_text").agg(F.first("_doc").alias("_doc"), F.first("size").alias("size"), F.sum("copies").alias("copies"))
        out = out.unionByName(many.select("_doc", "size", "copies"))
    copies = F.col("copies").cast("long")
    return out.filter("copies > 0").select("_doc.*", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))
