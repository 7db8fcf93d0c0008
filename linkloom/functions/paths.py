"""Path steps, actions (XPaths without positions) and array helpers, as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_attr(attr: Column) -> Column:
    """An attribute without trailing digits, up to its first - or _; null for null and for nothing but separators."""
    bare = F.regexp_replace(attr, r"[0-9]+$", "")
    return F.when(bare.rlike(r"^[-_]+$"), F.lit(None)).otherwise(F.split(bare, "[-_]")[0])


def format_attr_text(value: str | None) -> str | None:
    """format_attr of the first class of a class attribute, for the parser."""
    if value is None or value and not value.strip(" \t\n\r\f\v"):
        return None
    bare = re.sub(r"[0-9]+$", "", re.split(r"[ \t\n\r\f\v]+", value)[0])
    return None if re.fullmatch(r"[-_]+", bare) else re.split(r"[-_]", bare)[0]


def first_class(value: Column) -> Column:
    """The formatted first class of a class attribute."""
    return F.when(value.rlike(r"^[ \t\n\r\f\x0B]+$"), F.lit(None)).otherwise(format_attr(F.split(value, r"[ \t\n\r\f\x0B]+")[0]))


def tag_id_class(tag: Column, value: Column) -> Column:
    """struct(tag, id, classes): every class of a class attribute formatted, in order. The id is always null: steps of paths
    are told apart by tag and class alone."""
    classes = F.transform(F.filter(F.split(value, r"[ \t\n\r\f\x0B]+"), lambda c: c != ""), format_attr)
    return F.struct(tag.alias("tag"), F.lit(None).cast("string").alias("id"), classes.alias("classes"))


def steps_xpath(steps: Column) -> Column:
    """The XPath of an array of tag_id_class() steps, by each one's first class."""
    return action_of(F.transform(steps, lambda s: F.struct(s["tag"].alias("tag"), F.get(s["classes"], F.lit(0)).alias("cls"))))


def step_xpath(tag: Column, classes: Column, position: Column) -> Column:
    """The older form of a step: its tag, the first of its classes and its position, as far as they are there.

    A null or empty array of classes, and a null position, add nothing; a null tag gives null.
    """
    first = F.when(F.size(classes) > 0, F.get(classes, F.lit(0)))
    held = F.when(first.isNotNull(), F.concat(F.lit("[contains(@class,'"), first, F.lit("')]")))
    return F.concat(tag, F.coalesce(held, F.lit("")), F.coalesce(F.concat(F.lit("["), position.cast("string"), F.lit("]")), F.lit("")))


def node_xpath(path: Column) -> Column:
    """The older XPath of a path: every step with its class and its position."""
    classes = lambda s: F.when(s["cls"].isNotNull(), F.array(s["cls"]))
    return F.concat(F.lit("//"), F.array_join(F.transform(path, lambda s: step_xpath(s["tag"], classes(s), s["pos"])), "/"))


def _step(s: Column) -> Column:
    return F.concat(s["tag"], F.when(s["cls"].isNotNull(), F.concat(F.lit("[contains(@class, '"), s["cls"], F.lit("')]"))).otherwise(F.lit("")))


def action_of(path: Column) -> Column:
    """The XPath of a path without positions: what links are grouped by."""
    return F.concat(F.lit("//"), F.array_join(F.transform(path, _step), "/"))


def xpath_at(path: Column, positions: Column) -> Column:
    """The XPath of a path with positions (from 1) at the given depths (from 0)."""
    at = lambda s, i: F.concat(
        _step(s), F.when(F.array_contains(positions, i), F.concat(F.lit("["), (s["pos"] + 1).cast("string"), F.lit("]"))).otherwise(F.lit(""))
    )
    return F.concat(F.lit("//"), F.array_join(F.transform(path, at), "/"))


def path_key(path: Column) -> Column:
    """A path without its positions, as one string that tells paths apart."""
    return F.to_json(F.transform(path, lambda s: F.struct(s["tag"].alias("t"), s["cls"].alias("c"))))


def below(path: Column, tag: str) -> Column:
    """The path from the first step of that tag on; the whole path if there is none."""
    at = F.array_position(F.transform(path, lambda s: s["tag"]), tag)
    return F.slice(path, F.greatest(at, F.lit(1)).cast("int"), F.size(path))


def model_steps(actions: Column) -> Column:
    """All places on the way of an action sequence (newest first): [], [first], [second, first], ..., the whole."""
    n = F.size(actions)
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(actions, n - k + 1, k))


def action_at(actions: Column, step: Column) -> Column:
    """The action that follows a place on the way of a sequence; null at its end."""
    return F.get(F.reverse(actions), F.size(step))


def source_path(path: Column) -> Column:
    """The path of the page that a path's last action was taken on."""
    return F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0)))


def positions_at(values: Column, item: Column) -> Column:
    """Places (from 0) of equal values, last first."""
    return positions_where(values, lambda v: v == item)


def positions_where(values: Column, test) -> Column:
    """Places (from 0) of values that meet a test, last first."""
    numbered = F.transform(values, lambda v, i: F.when(F.coalesce(test(v), F.lit(False)), i))
    return F.reverse(F.filter(numbered, lambda i: i.isNotNull()))


def prefix_match(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    pairs = F.zip_with(F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(pairs, False)
    return F.when(first > 0, first - 1).otherwise(F.size(pairs)).cast("int")


def cons(first: Column, rest: Column) -> Column:
    return F.concat(F.array(first), rest)


def suffix_products(values: Column) -> Column:
    """Products of all values from each place on."""
    return F.reverse(
        F.aggregate(
            F.reverse(values),
            F.array().cast("array<bigint>"),
            lambda acc, x: F.concat(acc, F.array(x.cast("long") * F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.lit(1)))),
        )
    )
