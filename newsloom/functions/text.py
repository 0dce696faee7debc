"""Text expressions. All are Spark columns; tokens are cut where both regex engines of our checks agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values

TOKEN_BREAK = r"[^\p{L}\p{N}_]+"


def squish(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(text: Column, stop: tuple[str, ...] | list[str] = ()) -> Column:
    """Lower-case tokens in order; stop words leave no gap."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: ~t.isin("", *stop))  # a hash set


def spacing_repaired(text: Column) -> Column:
    """A full stop between a small and a capital letter gets its space back."""
    return F.regexp_replace(text, r"([a-z])\.([A-Z])", "$1. $2")


def title_key(title: Column, keep_underscore: bool = True) -> Column:
    """Lower case, no punctuation, single spaces."""
    marks = r"[^\p{L}\p{N}_\s]" if keep_underscore else r"[^\p{L}\p{N}\s]"
    return squish(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), marks, ""))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def outlet_key(origin: Column) -> Column:
    head = F.regexp_extract(F.coalesce(origin, F.lit("")), r"^([^;(]+)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(head, "[^A-Za-z]", "")), "^the", "")


def outlet(origin: Column) -> Column:
    return F.coalesce(_lookup(values.OUTLETS, outlet_key(origin)), F.lit("Other"))


def outlet_family(origin: Column) -> Column:
    bare = F.lower(F.regexp_replace(F.coalesce(origin, F.lit("")), r"\s", ""))
    rest = F.split_part(F.regexp_replace(bare, r"\(online\)|\(2011-\)|[^\p{L}\p{N}_;]", ""), F.lit(";"), F.lit(1))
    chosen = F.lit(None).cast("string")
    for needle, family in reversed(values.FAMILIES):
        chosen = F.when(bare.contains(needle), F.lit(family)).otherwise(chosen)
    return F.coalesce(chosen, rest)


def is_online(origin: Column) -> Column:
    return F.coalesce(F.lower(origin).contains("online"), F.lit(False))


def short_outlet(origin: Column) -> Column:
    base = F.trim(F.replace(F.replace(F.trim(F.split_part(origin, F.lit(";"), F.lit(1))), F.lit(" (Online)"), F.lit("")), F.lit(" (2011-)"), F.lit("")))
    return F.coalesce(_lookup(values.SHORT_NAMES, F.lower(base)), base)


def number(c: Column) -> Column:
    """The first number in a string, thousands separators ignored; null where there is none."""
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"-?[0-9]+\.?[0-9]*", 0).try_cast("double")


def compounded(toks: Column, phrases: tuple[str, ...] | list[str]) -> Column:
    """The tokens, each phrase made one token; every token has spaces of its own, so neighbours don't compete for one."""
    line = F.concat(F.lit(" "), F.array_join(toks, "  "), F.lit(" "))
    for phrase in phrases:
        line = F.replace(line, F.lit(" " + phrase.replace(" ", "  ") + " "), F.lit(f" {phrase.replace(' ', '_')} "))
    return F.split(F.trim(line), "  ")


def count_of_words(text: Column, words: list[str]) -> Column:
    """Hits of an alternation over the list, longest reading left to the regex engine's order."""
    quoted = "|".join("".join("\\" + c if not c.isalnum() and c != " " else c for c in w) for w in words)
    return F.regexp_count(F.lower(text), F.lit(rf"\b({quoted})\b"))
