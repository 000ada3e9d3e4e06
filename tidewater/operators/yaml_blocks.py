"""YAML block mappings, block sequences of scalars and block scalars, by built-in expressions.

Comments and blank lines are skipped, quotes around a scalar are taken off, `null` and a missing value are null.  Null text
gives null, empty text an empty map, array or string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MEMBER = r'^"?([0-9A-Za-z_][0-9A-Za-z_-]*)"?:(?:[ ]+(.*))?$'


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: ~line.rlike(r"^\s*(#.*)?$"))


def scalar(raw: Column) -> Column:
    """A plain or double-quoted scalar as text; a trailing comment goes."""
    plain = F.trim(F.regexp_replace(raw, r"(^|\s)#.*$", ""))
    quoted = F.from_json(F.concat(F.lit('{"v":'), F.regexp_extract(raw, r'^("(?:[^"\\]|\\.)*")', 1), F.lit("}")), "v string")["v"]
    return F.when(F.trim(raw).startswith('"'), quoted).when(plain.isin("", "null"), None).otherwise(plain)


def block_mapping(text: Column) -> Column:
    """map<string,string> of a flat `key: value` mapping; of two equal keys the last counts."""
    entries = F.transform(_lines(text), lambda m: F.struct(F.regexp_extract(m, _MEMBER, 1).alias("k"), scalar(F.regexp_extract(m, _MEMBER, 2)).alias("v")))
    entries = F.filter(entries, lambda e: e["k"] != "")

    def last_of_each(es: Column) -> Column:
        # sorted by key and place, the last of equal keys is the one before another key
        ranked = F.array_sort(F.transform(es, lambda e, i: F.struct(e["k"].alias("k"), i.alias("at"), e["v"].alias("v"))))
        kept = F.transform(F.array(ranked), lambda r: F.filter(r, lambda e, i: ~F.coalesce(F.get(r, i + 1)["k"] == e["k"], F.lit(False))))[0]
        ordered = F.array_sort(F.transform(kept, lambda e: F.struct(e["at"].alias("at"), e["k"].alias("k"), e["v"].alias("v"))))
        return F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["k"], e["v"])))

    # Bound as a lambda's argument, the entries are parsed once however often they are named.
    return F.transform(F.array(entries), last_of_each)[0]


def block_sequence(text: Column) -> Column:
    """array<string> of a `- value` sequence."""
    items = F.filter(_lines(text), lambda line: line.rlike(r"^\s*-(\s|$)"))
    return F.transform(items, lambda line: scalar(F.regexp_replace(line, r"^\s*-\s*", "")))


def literal_block(body: Column) -> Column:
    """The value of a `|` scalar: its lines without the first line's indentation, joined by newlines, none at the end."""
    indent = F.length(F.regexp_extract(body, r"^ *", 0))
    lines = F.transform(F.split(body, "\n"), lambda line: line.substr(indent + 1, F.length(line)))
    return F.regexp_replace(F.array_join(lines, "\n"), r"\n+\z", "")


def folded_block(body: Column) -> Column:
    """The value of a `>` scalar: lines joined by a space, a blank line by two newlines."""
    return F.regexp_replace(F.regexp_replace(literal_block(body), r"(?<!\n)\n(?!\n)", " "), r"\n{2,}", "\n\n")
