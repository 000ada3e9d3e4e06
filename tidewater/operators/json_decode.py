"""Checked decoding of JSON documents and of their prefixes: the value, what is wrong and where, and what is null.

One regular expression cuts the text into tokens; a fold over them keeps the open containers and what may come next; a token
table says which token may stand where.  The tokens before the first fault, closed to a whole document, are written as JSON
whose scalars are strings that carry their kind and token number, so from_json reads each level of the schema as strings and
the leaves check kind and range themselves.  All of it is built-in expressions.

``decode`` gives struct<value, error, nulls>: the last good value, struct<reason, line, col, context> of the first fault (null
if none; lines and columns from 1, columns in bytes, at the first byte of the token at fault or at the end), and the paths
that are null in the text, not missing.

Defined results: null text gives null; text without a value gives a null value and no fault; a struct of which nothing has
been read is null; members that the schema doesn't name are checked for syntax only; of two equal members the last counts,
but two structs are put together.
A decimal(38, 0) or a string may carry {"kind": "int128"} or {"kind": "uint128"} in its field's metadata, and integers a
kind of functions.keys.INTEGER_RANGES; {"keys": [...]} are a member's names in the text; {"ignored": true} leaves it out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.keys import INTEGER_RANGES, checked_double, checked_integer


@dataclass(frozen=True)
class Syntax:
    """What is accepted beyond strict JSON."""

    comments: bool = False
    trailing_commas: bool = False
    unquoted_keys: bool = False
    single_quotes: bool = False
    leading_plus: bool = False
    leading_zeros: bool = False
    leading_point: bool = False
    hex_numbers: bool = False
    non_finite: bool = False


STRICT = Syntax()

_TOKEN = r"""(?s)[ \t\r\n]+|//[^\n]*|/\*.*?(?:\*/|\z)|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\\?\z)|[\[\]{}:,]|[^\s\[\]{}:,"'/]+|."""
_CLOSED = r"""(?s)\A(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')\z"""
_LONE = r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F]"
#: What a string cut inside an escape does not show yet.
_CUT = r"(?s)(?<!\\)((?:\\\\)*+)\\(?:u[0-9a-fA-F]{0,3}|u[dD][89abAB][0-9a-fA-F]{2}(?:\\(?:u[0-9a-fA-F]{0,3})?)?)?\z"

# What may come next: r a root value, v a member's value, a the first element, e a further one, k the first key, m a further
# one, c a colon, n a comma or closer, d nothing.  Tokens: s a string, o an open one, w a word, x one that is never allowed.
_VALUES, _ANY = "sow[{", "sow[{]}:,x"
_STEPS = {
    **{need + t: "=" for need in "rvae" for t in _VALUES},
    **{need + t: "+" for need in "rvae" for t in "[{"},
    "a]": "-", "k}": "-", "n]": "-", "n}": "-", "n,": ",", "c:": "v",
    **{need + t: "c" for need in "km" for t in "sow"},
}
_FAULTS = {
    **{"v" + t: "missingValue" for t in ",]}"}, "a,": "missingValue", "e,": "missingValue", "e]": "trailingComma", "m}": "trailingComma",
    **{"c" + t: "missingColon" for t in _ANY}, **{"n" + t: "missingComma" for t in _VALUES},
}
_CONTEXT = {"r": "neutral", "d": "neutral", "v": "objectValue", "a": "arrayValue", "e": "arrayValue", "k": "objectKey", "m": "objectKey", "c": "objectKey"}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_NEEDS, _KINDS = "rvaekmcnd", "sow[{]}:,x"


def _table(pairs: dict[str, str]) -> Column:
    """What ``pairs`` says of each need and kind, at the place that ``_place`` gives."""
    return F.array(*[F.lit(pairs.get(need + kind)).cast("string") for need in _NEEDS for kind in _KINDS])


def _place(need: Column, kind: Column) -> Column:
    return F.instr(F.lit(_NEEDS), need) * len(_KINDS) + F.instr(F.lit(_KINDS), kind) - (len(_KINDS) + 1)


def _word_fault(t: Column, s: Syntax) -> Column:
    """Why a word is no value; null if it is one."""
    sign = "[+-]?" if s.leading_plus else "-?"
    digits = "[0-9]+" if s.leading_zeros else "(?:0|[1-9][0-9]*)"
    whole = rf"(?:{digits}(?:\.[0-9]+)?" + (r"|\.[0-9]+)" if s.leading_point else ")")
    good = rf"\A(?:true|false|null|{sign}{whole}(?:[eE][+-]?[0-9]+)?" + (rf"|{sign}0[xX][0-9a-fA-F]+" if s.hex_numbers else "") + (r"|Infinity|NaN" if s.non_finite else "") + r")\z"
    return (
        F.when(t.rlike(good), F.when(F.length(t) > 64, "numericOverflow"))
        .when(t.rlike("^[tfn]"), "invalidLiteral")
        .when(t.rlike("^[IN]") if s.non_finite else F.lit(False), "invalidLiteral")
        .when(~t.rlike("^[-0-9]") & ~(t.rlike("^[+.]") if s.leading_plus or s.leading_point else F.lit(False)), "unexpectedToken")
        .when(t.rlike(r"^\+") if not s.leading_plus else F.lit(False), "unexpectedToken")
        .when(t.rlike(r"^[+-]?0[0-9]+([.eE].*)?$") & F.lit(not s.leading_zeros), "leadingZero")
        .when(t.rlike(r"^[+-]?[0-9]*\.?[0-9]*[eE]"), "invalidExponent")
        .otherwise("invalidNumber")
    )


def tokens(text: Column, s: Syntax = STRICT) -> Column:
    """array<struct<t, k, f>>: each token, its kind and its own fault."""

    escaped = lambda t: F.instr(t, "\\") > 0

    def kind(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        quote = first.isin('"', "'") if s.single_quotes else first == '"'
        # without a backslash, a second quote can only be the last character
        closed = F.when(escaped(t), t.rlike(_CLOSED)).otherwise((F.octet_length(t) > 1) & (F.substring(t, -1, 1) == first))
        return (
            F.when(first.isin(*"[]{}:,"), first)
            .when(quote, F.when(closed, "s").otherwise("o"))
            .when(first.isin(*" \t\r\n"), " ")
            .when(first == "/", F.when(t.rlike("^/[/*]"), " ").otherwise("x") if s.comments else F.lit("x"))
            .when(first == "'", "x")
            .otherwise("w")
        )

    def with_fault(t: Column, k: Column) -> Column:
        bare = F.regexp_replace(t, r"\\\\", "")
        bad = F.when((k == "s") & escaped(t) & (bare.rlike(r"\\u(?![0-9a-fA-F]{4})") | bare.rlike(_LONE)), "invalidUnicodeEscape")
        return F.struct(t.alias("t"), k.alias("k"), F.when(k == "w", _word_fault(t, s)).otherwise(bad).alias("f"))

    return F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: once(kind(t), lambda k: with_fault(t, k)))


def _fold(toks: Column, s: Syntax) -> Column:
    """struct<stack, need, n, fault, context>: containers open before the first fault, and how many tokens came before it."""
    steps, faults = _table(_STEPS), _table(_FAULTS)
    contexts = F.array(*[F.lit(_CONTEXT.get(need)).cast("string") for need in _NEEDS])
    state = lambda stack, need, n, fault, context: F.struct(stack.alias("stack"), need.alias("need"), n.alias("n"), fault.alias("fault"), context.alias("context"))
    none = F.lit(None).cast("string")

    if s.trailing_commas:
        steps = _table(_STEPS | {"e]": "-", "m}": "-"})

    def step(a: Column, x: Column) -> Column:
        at = _place(a["need"], x["k"])
        moved = once(F.get(steps, at), lambda go: after(a, x, at, go))
        return F.when(a["fault"].isNotNull(), a).when(x["k"] == " ", state(a["stack"], a["need"], a["n"] + 1, none, none)).otherwise(moved)

    def after(a: Column, x: Column, at: Column, go: Column) -> Column:
        top = F.substring(a["stack"], -1, 1)
        wrong = F.when((go == "-") & (x["k"] == "]") & (top != "[") | (go == "-") & (x["k"] == "}") & (top != "{"), "unexpectedToken")
        key = F.when((go == "c") & (x["k"] == "w"), F.when(x["t"].rlike(r"^[0-9A-Za-z]+$") if s.unquoted_keys else F.lit(False), none).otherwise("unexpectedToken")).otherwise(x["f"])
        fault = F.when(go.isNull(), F.coalesce(F.get(faults, at), F.lit("unexpectedToken"))).otherwise(F.coalesce(wrong, key))
        stack = F.when(go == "+", F.concat(a["stack"], x["k"])).when(go == "-", F.substring(a["stack"], F.lit(1), F.length(a["stack"]) - 1)).otherwise(a["stack"])
        done = F.when(stack == "", "d").otherwise("n")
        need = F.when(go == "+", F.when(x["k"] == "[", "a").otherwise("k")).when(go.isin("=", "-"), done).when(go == ",", F.when(top == "[", "e").otherwise("m")).otherwise(go)
        here = F.when(go.isNotNull() & x["k"].isin("s", "o"), "string").when((x["k"] == "w") & (go == "=") & (x["f"] != "unexpectedToken"), F.when(x["t"].rlike("^[a-zA-Z]"), "literal").otherwise("number"))
        here = F.coalesce(here, F.get(contexts, F.instr(F.lit(_NEEDS), a["need"]) - 1), F.when(top == "[", "arrayValue").otherwise("objectValue"))
        return F.when(fault.isNull(), state(stack, need, a["n"] + 1, none, none)).otherwise(state(a["stack"], a["need"], a["n"], fault, here))

    return F.aggregate(toks, state(F.lit(""), F.lit("r"), F.lit(0), none, none), step)


def _number(t: Column, s: Syntax) -> Column:
    """A number token as strict JSON writes it; hex digits as a decimal number."""
    bare = F.regexp_replace(t, r"^\+", "") if s.leading_plus else t
    if s.leading_zeros:
        bare = F.when(bare.rlike("^-?0[xX]"), bare).otherwise(F.regexp_replace(bare, r"^(-?)0+(?=[0-9])", "$1"))
    if s.leading_point:
        bare = F.regexp_replace(bare, r"^(-?)\.", "$10.")
    if s.hex_numbers:
        value = F.conv(F.regexp_extract(bare, "^-?0[xX](.*)$", 1), 16, 10)
        value = F.when(F.regexp_replace(F.regexp_extract(bare, "^-?0[xX](.*)$", 1), "^0+", "").rlike("^.{17,}"), F.lit("1" + "0" * 40)).otherwise(value)
        bare = F.when(bare.rlike("^-?0[xX]"), F.concat(F.regexp_extract(bare, "^-?", 0), value)).otherwise(bare)
    return bare


def _inside(t: Column) -> Column:
    """What stands between the quotes, as double quotes take it."""
    body = F.substring(t, F.lit(2), F.length(t))
    single = F.regexp_replace(F.regexp_replace(body, r"\\'", "'"), r'(?<!\\)"', '\\\\"')
    return F.when(t.startswith("'"), single).otherwise(body)


def _written(toks: Column, end: Column, s: Syntax, keys: Callable[[Column], Column] | None) -> Column:
    """The tokens before the fault as a whole document of tagged strings; null without a value."""

    def seen(real: Column) -> Column:
        # a key without its value, and a comma without a next member, are not seen yet
        size = F.size(real)
        drop = F.when(end["need"] == "v", 2).when(end["need"] == "c", 1).otherwise(0)
        last = F.get(real, size - drop - 1)["x"]["k"]
        return F.slice(real, F.lit(1), F.when(F.coalesce(last == ",", F.lit(False)), size - drop - 1).otherwise(size - drop))

    def shown(kept: Column) -> Column:
        def text(x: Column, i: Column) -> Column:
            t, k = x["x"]["t"], x["x"]["k"]
            follows = F.get(kept, i + 1)["x"]["k"]
            inner = F.when(k == "s", _inside(F.substring(t, F.lit(1), F.length(t) - 1))).when(k == "o", F.regexp_replace(_inside(t), _CUT, "$1")).otherwise(t)
            tag = lambda letter, body: F.concat(F.lit('"' + letter), x["i"].cast("string"), F.lit(":"), body, F.lit('"'))
            name = keys(inner) if keys else inner
            word = F.when(t == "null", tag("z", F.lit(""))).when(t.isin("true", "false"), tag("b", t)).when(t.isin("NaN", "Infinity"), tag("f", t)).otherwise(tag("n", _number(t, s)))
            # numbered, so that equal keys stay apart
            key = F.concat(F.lit('"'), name, F.lit(_MARK), x["i"].cast("string"), F.lit('"'))
            comma = F.when(F.coalesce(follows.isin("]", "}"), F.lit(False)), "").otherwise(k)
            return F.when(k == ",", comma).when(~k.isin("s", "o", "w"), k).when(F.coalesce(follows == ":", F.lit(False)), key).when(k == "w", word).otherwise(tag("s", inner))

        body = F.array_join(F.transform(kept, text), "")
        return F.when(F.size(kept) > 0, F.concat(F.lit('{"v":'), body, F.reverse(F.translate(end["stack"], "[{", "]}")), F.lit("}")))

    numbered = F.transform(F.slice(toks, F.lit(1), end["n"]), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    # the kept tokens are made once, not once for each of them
    return once(once(F.filter(numbered, lambda x: x["x"]["k"] != " "), seen), shown)


_FAULT = "array<struct<i:int,reason:string>>"
_ERROR = "struct<reason:string,line:int,col:int,context:string>"
_MARK = "\u0001"
_RAW = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true", "allowSingleQuotes": "false"}


def _leaf(tag: Column, body: Column, kind: T.DataType, meta: dict) -> tuple[Column, Column]:
    """(value, reason) of a tagged scalar."""
    name = meta.get("kind") or {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64"}.get(type(kind))
    if name in ("int128", "uint128"):
        low, high = ("-" + str(2**127), str(2**127 - 1)) if name == "int128" else ("-0", str(2**128 - 1))
        size = F.lpad(F.regexp_replace(body, "^-", ""), 64, "0")
        fits = body.rlike("^-?[0-9]+$") & F.when(body.startswith("-"), size <= low[1:].rjust(64, "0")).otherwise(size <= high.rjust(64, "0"))
        value, why = F.when(fits, body.cast(kind)), F.when(~fits, "numericOverflow")
        return F.when(tag == "n", value), F.when(tag != "n", "invalidType").otherwise(why)
    if isinstance(kind, T.StringType):
        return F.when(tag == "s", body), F.when(tag != "s", "invalidType")
    if isinstance(kind, T.BinaryType):
        return F.when(tag == "s", F.encode(body, "utf-8")), F.when(tag != "s", "invalidType")
    if isinstance(kind, T.BooleanType):
        return F.when(tag == "b", body.cast("boolean")), F.when(tag != "b", "invalidType")
    if name in INTEGER_RANGES:
        value, why = checked_integer(F.when(tag == "n", body), name)
        return value.cast(kind), F.when(tag != "n", "invalidType").otherwise(why)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        value, why = checked_double(F.when(tag == "n", body))
        if isinstance(kind, T.FloatType):
            wide = F.abs(value) > 3.4028235677973366e38  # what would round to infinity
            value, why = F.when(~wide, value), F.when(wide, "numericOverflow").otherwise(why)
        special = F.when(tag == "f", body.cast("double")) if not isinstance(kind, T.DecimalType) else F.lit(None)
        return F.coalesce(value, special).cast(kind), F.when((tag == "f") & special.isNotNull(), None).when(tag != "n", "invalidType").otherwise(why)
    raise ValueError(f"no JSON value is a {kind.simpleString()}")


def names_of(field: T.StructField) -> list[str]:
    return list((field.metadata or {}).get("keys") or [field.name])


def members(kind: T.StructType) -> list[T.StructField]:
    """The members that are read; two of them may not share a name in the text."""
    read = [f for f in kind.fields if not (f.metadata or {}).get("ignored")]
    names = [n for f in read for n in names_of(f)]
    if len(set(names)) < len(names):
        raise ValueError(f"members share a name in the text: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return read


def _node(raw: Column, kind: T.DataType, path: str, meta: dict, nullable: bool = True, keys: Callable[[Column], Column] | None = None) -> Column:
    """struct<v, e, z> of tagged text: value, faults by token number, and null paths; ``keys`` where names are still the text's."""
    none, clean, empty = F.lit(None), F.array().cast(_FAULT), F.array().cast("array<string>")
    out = lambda v, e, z: F.struct(v.cast(kind).alias("v"), e.alias("e"), z.alias("z"))
    at = F.regexp_extract(raw, r'^[\[{"]*(?:"?[^"]*":)?.*?[snbzf]([0-9]+):', 1).try_cast("int")
    at = F.coalesce(at, F.lit(2**31 - 1))  # an empty container has no number: its place is the end
    fault = lambda why: F.array(F.struct(at.alias("i"), F.lit(why).alias("reason") if isinstance(why, str) else why.alias("reason"))).cast(_FAULT)
    first = F.substring(raw, 1, 1)

    named = keys or (lambda name: name)
    # the members as struct<key, at, value>, in the order of the text
    pairs = F.transform(F.map_entries(F.from_json(raw, "map<string,string>", _RAW)), lambda x, i: F.struct(named(F.substring_index(x["key"], _MARK, 1)).alias("key"), i.alias("at"), x["value"].alias("value")))

    if isinstance(kind, T.StructType):
        fields = members(kind)

        def member(all_: Column, f: T.StructField) -> Column:
            """Its text: of several the last, but struct members are put together."""
            of_last = lambda some: F.try_element_at(some, F.lit(-1))
            mine = F.filter(all_, lambda x: x["key"].isin(names_of(f)))
            if not isinstance(f.dataType, T.StructType):
                return of_last(mine)["value"]

            inner = F.filter(F.transform(F.filter(mine, lambda x: x["value"].startswith("{")), lambda x: F.substring(x["value"], F.lit(2), F.length(x["value"]) - 2)), lambda x: x != "")
            last = of_last(mine)["value"]
            return F.when((F.size(mine) > 1) & last.startswith("{"), F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}"))).otherwise(last)

        def read(inner: Column) -> Column:
            kids = [_node(inner[f"c{i}"], f.dataType, f"{path}.{f.name}" if path else f.name, f.metadata or {}, f.nullable, keys) for i, f in enumerate(fields)]

            def joined(got: Column) -> Column:
                anything = F.lit(False)
                for i in range(len(fields)):
                    anything = anything | inner[f"c{i}"].isNotNull()
                by = {f.name: i for i, f in enumerate(fields)}
                value = F.struct(*[(got[f"c{by[f.name]}"]["v"] if f.name in by else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields])
                return out(F.when(anything, value), F.concat(*[got[f"c{i}"]["e"] for i in range(len(fields))]), F.concat(*[got[f"c{i}"]["z"] for i in range(len(fields))]))

            return once(F.struct(*[k.alias(f"c{i}") for i, k in enumerate(kids)]), joined)

        body = once(pairs, lambda all_: once(F.struct(*[member(all_, f).alias(f"c{i}") for i, f in enumerate(fields)]), read)) if fields else out(none, clean, empty)
        opens = "{"
    elif isinstance(kind, T.ArrayType):
        items = F.from_json(raw, "array<string>", _RAW)
        got = F.transform(items, lambda x: _node(x, kind.elementType, path + "[]", meta, kind.containsNull, keys))
        body = once(got, lambda g: out(F.transform(g, lambda x: x["v"]), F.flatten(F.transform(g, lambda x: x["e"])), F.array_distinct(F.flatten(F.transform(g, lambda x: x["z"])))))
        opens = "["
    elif isinstance(kind, T.MapType):
        last = once(F.array_sort(pairs), lambda all_: F.filter(all_, lambda x, i: ~F.coalesce(F.get(all_, i + 1)["key"] == x["key"], F.lit(False))))
        ordered = F.transform(F.array_sort(F.transform(last, lambda x: F.struct(x["at"], x["key"], x["value"]))), lambda x: F.struct(x["key"], x["value"]))
        got = F.transform(ordered, lambda x: F.struct(x["key"].alias("key"), _node(x["value"], kind.valueType, path + "{}", meta, kind.valueContainsNull, keys).alias("n")))
        values = lambda g: F.map_from_entries(F.transform(g, lambda x: F.struct(x["key"], x["n"]["v"])))
        body = once(got, lambda g: out(values(g), F.flatten(F.transform(g, lambda x: x["n"]["e"])), F.array_distinct(F.flatten(F.transform(g, lambda x: x["n"]["z"])))))
        opens = "{"
    else:
        value, why = _leaf(first, F.substring(raw, F.instr(raw, ":") + 1, F.length(raw)), kind, meta)
        why = F.when(first.isin("{", "["), "invalidType").otherwise(why)
        refused = F.when(why.isNull(), out(none, clean, empty)).otherwise(out(none, fault(why), empty))
        # a value that is there has no reason
        body, opens = once(value.cast(kind), lambda v: F.when(v.isNotNull(), out(v, clean, empty)).otherwise(refused)), None
    if opens:
        body = F.when(first == opens, body).otherwise(out(none, fault("invalidType"), empty))
    null = out(none, clean, F.array(F.lit(path))) if nullable else out(none, fault("invalidType"), empty)
    return F.when(raw.isNull(), out(none, clean, empty)).when(first == "z", null).otherwise(body)


def _unfinished(toks: Column) -> Column:
    """The tokens of a prefix, its last word as far as it shows: a literal from its first letter on, a number up to its last
    digit before an exponent."""

    def shown(x: Column) -> Column:
        t = x["t"]
        number = F.regexp_replace(F.regexp_replace(t, r"(?<=[0-9])(?:\.?[eE][+-]?[0-9]*|\.)\z", ""), r"\A[+-]\z", "0")
        word = number
        for w in ("true", "false", "null", "Infinity", "NaN"):
            word = F.when(F.lit(w).startswith(t), w).otherwise(word)
        return F.struct(word.alias("t"), x["k"].alias("k"), F.when(word == t, x["f"]).alias("f"))

    last = F.get(toks, F.size(toks) - 1)
    return F.when(F.coalesce(last["k"] == "w", F.lit(False)), F.concat(F.slice(toks, F.lit(1), F.size(toks) - 1), F.array(shown(last)))).otherwise(toks)


def _kind(schema: T.DataType | str) -> T.DataType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def _tree(written: Column, kind: T.DataType, keys: Callable[[Column], Column] | None = None) -> Column:
    return once(F.from_json(written, "v string", _RAW)["v"], lambda raw: _node(raw, kind, "", {}, keys=keys))


_SPACE, _NAME = r"[ \t\r\n]*+", r'"[^"\\]*+"'
_PLAIN = r'"[^"\\]*+(?:\\["\\/bfnrt][^"\\]*+)*+"'
#: Containers within containers that _quick follows.
_DEPTH = 6


def _quick(text: Column, s: Syntax) -> Column:
    """What _written makes of a document without any fault, its tokens not numbered and its names as in the text; null for
    other documents, and for those that are deep, no container, or have names with backslashes or characters by number."""
    literals = "true|false|null" + ("|NaN|Infinity" if s.non_finite else "")
    word = rf"(?![^\s,\]}}]{{65}})(?:{literals}|-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][-+]?+[0-9]++)?+)"
    value = f"(?:{_PLAIN}|{word})"
    for _ in range(_DEPTH):
        items = rf"\[{_SPACE}(?:\]|(?:{value}{_SPACE}(?:,{_SPACE}(?!\])|(?=\])))++\])"
        pairs = rf'\{{{_SPACE}(?:\}}|(?:{_NAME}{_SPACE}:{_SPACE}{value}{_SPACE}(?:,{_SPACE}(?=")|(?=\}})))++\}})'
        inner, value = f"(?:{items}|{pairs})", f"(?:{items}|{pairs}|{_PLAIN}|{word})"
    # each pass goes on where its last match ended, so that it knows what is inside a string
    out = F.regexp_replace(text, rf'\G((?:[^" \t\r\n]++|{_PLAIN})*+)[ \t\r\n]++', "$1")
    out = F.regexp_replace(out, rf'\G((?:[^"]++|{_NAME}:)*+)"({_PLAIN[1:-1]})"', '$1"s0:$2"')
    out = F.regexp_replace(out, rf'\G((?:[^"0-9A-Za-z.+-]++|{_PLAIN})*+)([0-9A-Za-z.+-]++)', '$1"n0:$2"')
    for tag, words in (("z0:", "null"), ("b0:$1", "(true|false)"), ("f0:$1", "(NaN|Infinity)")):
        out = F.regexp_replace(out, rf'(?<!\\)"n0:{words}"(?!:)', f'"{tag}"')
    return F.when(text.rlike(rf"\A{_SPACE}{inner}{_SPACE}\z"), F.concat(F.lit('{"v":'), out, F.lit("}")))


def _quick_tree(text: Column, kind: T.DataType, s: Syntax, keys: Callable[[Column], Column] | None) -> Column:
    """The tree of a document without any fault; null for other documents, for which the tokens have to be followed."""
    tree = once(_quick(text, s), lambda written: F.when(written.isNotNull(), _tree(written, kind, keys)))
    return once(tree, lambda got: F.when(F.size(got["e"]) == 0, got))


def _placed(toks: Column, n: Column, reason: Column, context: Column) -> Column:
    before = F.array_join(F.transform(F.slice(toks, F.lit(1), n), lambda x: x["t"]), "")
    line = (F.size(F.split(before, "\n", -1))).alias("line")
    col = (F.octet_length(F.substring_index(before, "\n", -1)) + 1).alias("col")
    return F.struct(reason.alias("reason"), line, col, context.alias("context"))


def _syntax_fault(toks: Column, end: Column, finish: bool) -> Column:
    """The first fault that doesn't depend on the schema, or what the end lacks."""
    fault = F.when(end["fault"].isNotNull(), _placed(toks, end["n"], end["fault"], end["context"]))
    if not finish:
        return fault
    real = F.filter(toks, lambda x: x["k"] != " ")
    last = F.get(real, F.size(real) - 1)["k"]
    open_comment = F.coalesce(F.get(toks, F.size(toks) - 1)["t"].rlike(r"(?s)\A/\*(?!.*\*/\z)"), F.lit(False))
    missing = (
        F.when(open_comment, "unexpectedToken").when(last == "o", "unterminatedString")
        .when(F.instr(end["stack"], "[") > 0, "missingClosingBracket").when(F.instr(end["stack"], "{") > 0, "missingClosingBrace")
    )
    return F.when(end["fault"].isNull() & missing.isNotNull(), _placed(toks, F.size(toks), missing, F.when(last == "o", "string").otherwise("neutral"))).otherwise(fault)


def partial_type(kind: T.DataType) -> T.DataType:
    """The type of partial states of ``kind``: everything may be missing.  Names and kinds in metadata stay."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, partial_type(f.dataType), True, f.metadata) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(partial_type(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, partial_type(kind.valueType), True)
    return kind


def as_partial(value: Column, kind: T.DataType) -> Column:
    """A full value as a partial state."""
    return value.cast(partial_type(kind))


def decode(text: Column, schema: T.DataType | str, syntax: Syntax = STRICT, keys: Callable[[Column], Column] | None = None, finish: bool = True) -> Column:
    """struct<value, error, nulls>; with ``finish`` the text must end here, else it is a prefix.  ``keys`` converts the names
    in the text before they are compared with the schema's.  For schemas of several levels see ``decoded``."""
    kind = _kind(schema)

    def judged(toks: Column) -> Column:
        def with_end(end: Column) -> Column:
            def result(got: Column) -> Column:
                wrong = F.array_min(got["e"])

                def earlier(_: Column) -> Column:
                    cut = F.slice(toks, F.lit(1), wrong["i"])
                    good = once(_fold(cut, syntax), lambda e: _tree(_written(cut, e, syntax, keys), kind))
                    return once(good, lambda g: F.struct(g["v"].alias("value"), _placed(toks, wrong["i"], wrong["reason"], F.lit("neutral")).alias("error"), g["z"].alias("nulls")))

                fine = F.struct(got["v"].alias("value"), _syntax_fault(toks, end, finish).alias("error"), got["z"].alias("nulls"))
                return F.when(F.size(got["e"]) > 0, once(F.lit(0), earlier)).otherwise(fine)

            return once(_tree(_written(toks, end, syntax, keys), kind), result)

        return once(_fold(toks, syntax), with_end)

    cut = tokens(text, syntax)
    followed = once(cut if finish else once(cut, _unfinished), judged)
    plain = lambda got: F.struct(got["v"].alias("value"), F.lit(None).cast(_ERROR).alias("error"), got["z"].alias("nulls"))
    quick = once(_quick_tree(text, kind, syntax, keys), lambda got: F.when(got.isNotNull(), plain(got)))
    return F.when(text.isNotNull(), F.coalesce(quick, followed))


def decoded(df: DataFrame, text: Column, schema: T.DataType | str, out: str = "decoded", syntax: Syntax = STRICT, keys: Callable[[Column], Column] | None = None, finish: bool = True) -> DataFrame:
    """``df`` with column ``out`` = decode(...), made in steps, so that schemas of many levels stay small expressions."""
    kind = _kind(schema)
    step = lambda name: f"_{out}_{name}"
    col = lambda name: F.col(f"`{step(name)}`")
    made = []

    def add(name: str, value: Column) -> None:
        nonlocal df
        made.append(step(name))
        df = df.withColumn(step(name), value)

    add("quick", _quick_tree(text, kind, syntax, keys))
    add("rest", F.when(col("quick").isNull(), text))
    add("toks", tokens(col("rest"), syntax) if finish else once(tokens(col("rest"), syntax), _unfinished))
    add("end", _fold(col("toks"), syntax))
    add("text", _written(col("toks"), col("end"), syntax, keys))
    add("tree", _tree(col("text"), kind))
    add("wrong", F.array_min(col("tree")["e"]))
    add("cut", F.when(col("wrong").isNotNull(), F.slice(col("toks"), F.lit(1), col("wrong")["i"])))
    add("cut_end", F.when(col("cut").isNotNull(), _fold(col("cut"), syntax)))
    add("cut_text", F.when(col("cut").isNotNull(), _written(col("cut"), col("cut_end"), syntax, keys)))
    add("cut_tree", F.when(col("cut").isNotNull(), _tree(col("cut_text"), kind)))
    error = F.when(col("wrong").isNotNull(), _placed(col("toks"), col("wrong")["i"], col("wrong")["reason"], F.lit("neutral"))).otherwise(_syntax_fault(col("toks"), col("end"), finish))
    of = lambda name: F.when(col("wrong").isNotNull(), col("cut_tree")[name]).otherwise(col("tree")[name])
    whole = F.struct(of("v").alias("value"), error.alias("error"), of("z").alias("nulls"))
    plain = F.struct(col("quick")["v"].alias("value"), F.lit(None).cast(_ERROR).alias("error"), col("quick")["z"].alias("nulls"))
    return df.withColumn(out, F.when(col("quick").isNotNull(), plain).when(col("toks").isNotNull(), whole)).drop(*made)


def checked_partials(docs: DataFrame, key: str, text: str, schema: T.DataType | str, step: int = 1, syntax: Syntax = STRICT, initial: Column | None = None, unit: str = "character") -> DataFrame:
    """(key, seq, state, error): the state after every ``step`` characters or bytes (``unit``), and one more for the end of
    the document; a character shows once its last byte has been read.

    After a fault the states stay at the last good one.  Before anything has been read the state is ``initial``.
    """
    n = F.length(text)
    if unit == "byte":
        # how many whole characters the first 1, 2, ... bytes hold
        chars = F.transform(F.split(text, ""), lambda c, i: F.concat(F.array_repeat(i, F.octet_length(c) - 1), F.array(i + 1)))
        every = F.flatten(chars)
        ends = F.filter(every, lambda e, i: ((i + 1) % step == 0) | (i + 1 == F.size(every))) if step > 1 else every
    else:
        ends = F.transform(F.sequence(F.lit(1), F.ceil(n / step).cast("int")), lambda i: F.least(i * step, n))
    ends = F.when(n > 0, ends).otherwise(F.array().cast("array<int>"))
    rows = docs.where(F.col(text).isNotNull()).select(key, text, F.posexplode(F.concat(ends, F.array(n + 1))).alias("seq", "end"))
    part = F.col(text).substr(F.lit(1), F.col("end"))
    got = rows.withColumn("got", F.when(F.col("end") <= n, decode(part, schema, syntax, finish=False)).otherwise(decode(F.col(text), schema, syntax)))
    state = F.col("got.value") if initial is None else F.coalesce("got.value", initial)
    return got.select(key, "seq", state.alias("state"), F.col("got.error").alias("error"))


def latest(partials: DataFrame, key: str) -> DataFrame:
    """(key, seq, state, error) of the last state of each document."""
    last = F.max_by(F.struct("seq", "state", "error"), "seq")
    return partials.groupBy(key).agg(last.alias("last")).select(key, "last.seq", "last.state", "last.error")
