"""Typed values of JSON documents and of their prefixes, by built-in expressions only.

A prefix is completed to the shortest valid document that shows what has been read (an open string is closed, a number
cut before its exponent, the first letter of a literal spelled out, a key without value dropped, open containers closed),
and that document goes through from_json.  No decoder state is carried, so states can be computed in any order and place.

Null text gives null; text that is no JSON gives a null value and a reason.  An opened nested object shows as a struct of
nulls.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Options under which from_json accepts what the strict syntax does and nothing more.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}

_STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_OPEN_STRING = r'(?s)"([^"\\]*+(?:\\.[^"\\]*+)*+\\?)\z'
_LAST_KEY = r'(?s),?\s*"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:?\z'


def _skeleton(text: Column) -> Column:
    """The text with each whole string replaced by the letter S."""
    return F.regexp_replace(text, _STRING, "S")


def open_containers(text: Column) -> Column:
    """The brackets and braces that a prefix leaves open, outermost first."""
    marks = F.regexp_replace(F.substring_index(_skeleton(text), '"', 1), r"[^\[\]{}]", "")
    def step(open_, c):
        return F.when(c.isin("[", "{"), F.concat(open_, c)).otherwise(open_.substr(F.lit(1), F.length(open_) - 1))

    return F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), F.lit(""), step)


def complete(prefix: Column) -> Column:
    """The shortest valid JSON that shows the visible state after `prefix`; an empty string before the first value."""
    stack = open_containers(prefix)
    closers = F.reverse(F.translate(stack, "[{", "]}"))
    in_object = F.substring(stack, -1, 1) == "{"
    bare = F.regexp_replace(_skeleton(prefix), r"\s+\z", "")
    in_string = F.instr(bare, '"') > 0

    before = F.regexp_replace(F.substring_index(bare, '"', 1), r"\s+\z", "")
    key_open = in_object & F.substring(before, -1, 1).isin("{", ",")
    head = F.regexp_replace(prefix, _OPEN_STRING, "")
    body = F.regexp_extract(prefix, _OPEN_STRING, 1)
    body = F.regexp_replace(body, r"(?s)(?<!\\)((?:\\\\)*+)\\(?:u[0-9a-fA-F]{0,3}|u[dD][89abAB][0-9a-fA-F]{2}(?:\\(?:u[0-9a-fA-F]{0,3})?)?)?\z", "$1")
    from_string = F.when(key_open, F.regexp_replace(head, r",?\s*\z", "")).otherwise(F.concat(head, F.lit('"'), body, F.lit('"')))

    shown = F.regexp_replace(prefix, r"\s+\z", "")
    key_closed = bare.rlike(r":\z") | (in_object & bare.rlike(r"[{,]\s*S\z"))
    # The value of a number is seen up to its last digit before an exponent.
    number = F.regexp_replace(shown, r"(?<=[0-9])(?:\.?[eE][+-]?[0-9]*|\.)\z", "")
    number = F.regexp_replace(number, r"-\z", "0")
    literal = F.regexp_replace(number, r"t(?:r|ru)?\z", "true")
    literal = F.regexp_replace(literal, r"f(?:a|al|als)?\z", "false")
    literal = F.regexp_replace(literal, r"n(?:u|ul)?\z", "null")
    outside = (
        F.when(key_closed, F.regexp_replace(shown, _LAST_KEY, ""))
        .when(bare.rlike(r",\z"), F.regexp_replace(shown, r",\z", ""))
        .when(bare.rlike(r'[S\]}]\z'), shown)
        .otherwise(literal)
    )
    return F.concat(F.when(in_string, from_string).otherwise(outside), closers)


def decode_prefix(prefix: Column, schema: str) -> Column:
    """Unchecked and quick.  from_json lets numbers of 8 and 16 bits wrap, so json_decode has to read those."""
    if re.search(r"(?i)\b(?:tinyint|byte|smallint|short)\b", schema):
        raise ValueError(f"numbers of 8 and 16 bits need json_decode.decode: {schema}")
    return F.from_json(complete(prefix), schema, STRICT)


def finish_reason(text: Column) -> Column:
    """Why a document cannot end here: an open string, then open arrays, then open objects; null where it can."""
    stack = open_containers(text)
    return (
        F.when(F.instr(_skeleton(text), '"') > 0, "unterminatedString")
        .when(F.instr(stack, "[") > 0, "missingClosingBracket")
        .when(F.instr(stack, "{") > 0, "missingClosingBrace")
    )


def byte_partials(docs: DataFrame, key: str, text: str, schema: str, step: int = 1) -> DataFrame:
    """(key, seq, state): the state after every `step` characters, and one more for the end of the document.

    A character shows once its last byte is there, so characters are the steps that can change a state.  The expansion is
    within each row: no shuffle.
    """
    n = F.length(text)
    ends = F.transform(F.sequence(F.lit(1), F.ceil(n / step).cast("int")), lambda i: F.least(i * step, n))
    ends = F.when(n > 0, ends).otherwise(F.array().cast("array<int>"))
    rows = docs.where(F.col(text).isNotNull()).select(key, text, F.posexplode(F.concat(ends, F.array(n + 1))).alias("seq", "end"))
    shown = F.when(F.col("end") <= n, decode_prefix(F.col(text).substr(F.lit(1), F.col("end")), schema)).otherwise(F.from_json(text, schema, STRICT))
    return rows.select(key, "seq", shown.alias("state"))
