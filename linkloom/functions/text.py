"""Tokens, shingles, URLs and small text helpers, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"


def tokenize(text: Column) -> Column:
    """Lower-cased pieces between white space, empty ones left out."""
    return F.filter(F.split(F.lower(text), SPACE), lambda t: t != "")


def tokenize_url(url: Column) -> Column:
    """Tokens of the last segment of a URL's path; none without a path."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return tokenize(F.element_at(F.split(path, "/"), -1))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often (and in whatever lambda) body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, k: int = 4) -> Column:
    """Distinct runs of k words of lower-cased text whose ASCII punctuation counts as space."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{Punct}+", " "), SPACE, " "))
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, F.lit(k)), " "))
    none = F.array().cast("array<string>")
    return F.coalesce(let(F.split(plain, " "), lambda w: F.when(F.size(w) >= k, F.array_distinct(grams(w))).otherwise(none)), none)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; null for two empty ones."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def near_duplicate(a: Column, b: Column, num: int = 9, den: int = 10) -> Column:
    """Whether the similarity of two sets reaches num/den, in whole numbers; null for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, den * F.size(F.array_intersect(a, b)) >= num * union)


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def in_domain(site: Column, target: Column) -> Column:
    """A relative target, or one on the same host."""
    return host(target).isNull() | F.coalesce(host(site) == host(target), F.lit(False))


def escape_pattern(text: Column) -> Column:
    """Backslashes before ( ) * & ^ % $ # !"""
    return F.regexp_replace(text, r"([()*&^%$#!])", r"\\$1")


def model_file(path: Column, kind: str) -> Column:
    """The file of another kind that belongs to a .model file."""
    return F.regexp_replace(path, ".model", f".{kind}")


def dated_name(prefix: str = "", suffix: str = "", at: Column | None = None) -> Column:
    """[prefix-]day-month-year-hour-minute[suffix] in UTC, without leading zeros."""
    when = F.date_format(F.current_timestamp() if at is None else at, "d-M-y-H-m")
    return F.concat(F.lit(f"{prefix}-" if prefix else ""), when, F.lit(suffix))


def find_in(json: Column, *paths: str) -> Column:
    """The first of several places in a JSON text that holds a value."""
    return F.coalesce(*(F.get_json_object(json, p) for p in paths))
