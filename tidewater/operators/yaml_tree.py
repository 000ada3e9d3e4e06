"""YAML of nested block and flow containers, and its prefixes, as JSON text that operators.json_decode checks and types.

One pass over the lines keeps the open containers with their indentation and writes JSON: it runs in Arrow batches, a row at
a time, because a line's meaning depends on all lines before it.  Kinds, ranges, null against missing and names are left to
the decoder of JSON, as are faults inside flow containers and scalars.

Whole texts without a fault, whose values all fit the schema, don't need the decoder: ``Plain`` reads them by steps from state
to state, which are kept, so that a line like one met before in the same place costs one look into a table.

Defined results: null text gives null; of a prefix what it shows for certain: a lone dash, a key without its colon and the
lines of a block scalar that has not ended show nothing.  A fault ends the reading, with the value before it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import pyarrow.json as pj
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.operators.json_decode import Syntax, decoded, partial_type
from tidewater.session import ship

#: Numbers and non-finite values as YAML takes them.
LOOSE = Syntax(leading_point=True, non_finite=True)

_KEY = re.compile(r'("(?:[^"\\]|\\.)*"|[0-9A-Za-z_][0-9A-Za-z_-]*)[ ]*:(?:[ ]+|$)')
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_FLOW = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[\[\]{},]|:(?=[ \[{"\]},]|$)|#.*|\s+|(?:[^\s\[\]{},:"#]|:(?=\S))(?:[^\[\]{},:"#\n]|:(?=[^\s\]},]))*', re.S)
_COMMENT = re.compile(r'((?:"(?:[^"\\]|\\.)*"|[^"#]|(?<![\s])#|")*?)(?:(?:^|\s)#.*)?$')
_NUMBER = re.compile(r"[-.]?[0-9][-+.0-9eE]*|-")
_quoted = json.JSONEncoder(ensure_ascii=False).encode
_WORDS = ("true", "false", "null", "Infinity", "NaN")


class Fault(Exception):
    def __init__(self, reason: str, line: int, col: int):
        self.args = (reason, line, col)


def _scalar(word: str, cut: bool) -> str:
    """A plain scalar as JSON writes it; ``cut`` if more of it may follow."""
    if word in _WORDS or cut and any(w.startswith(word) for w in _WORDS) or _NUMBER.fullmatch(word):
        return word
    return _quoted(word)


def _flow(text: str, cut: bool) -> tuple[str, int]:
    """A flow container as JSON, and how many of its brackets stay open."""
    out, depth = [], 0
    parts = [p for p in _FLOW.findall(text) if not p.isspace() and not p.startswith("#")]
    for i, p in enumerate(parts):
        if p in "[{":
            depth += 1
        elif p in "]}":
            depth -= 1
        if p in ("[", "]", "{", "}", ",", ":") or p.startswith('"'):
            out.append(p)
        else:
            key = i + 1 < len(parts) and parts[i + 1] == ":"
            last = cut and i == len(parts) - 1
            out.append(_quoted(p.rstrip()) if key else _scalar(p.rstrip(), last) + " ")
    return "".join(out), depth


def _without_comment(text: str) -> str:
    if "#" not in text:
        return text.rstrip()
    m = _COMMENT.match(text)
    return (m[1] if m else text).rstrip()


class _Reader:
    """Follows the lines of a text and writes JSON to ``out``."""

    def __init__(self, lines: list[str], finish: bool):
        self.lines, self.finish, self.at = lines, finish, 0
        self.out: list[str] = []
        self.stack: list[tuple[int, str]] = []  # indentation and closer of the open containers
        self.wants = True  # the next thing written is a value

    # what is written, and when

    def open(self, indent: int, closer: str) -> None:
        self.stack.append((indent, closer))
        self.out.append("[" if closer == "]" else "{")

    def close(self) -> None:
        self.out.append(self.stack.pop()[1])

    def name(self, name: str) -> None:
        self.out.append(name + ":")

    def put(self, json: str) -> None:
        self.out.append(json)

    def fault(self, reason: str, indent: int) -> Fault:
        return Fault(reason, self.at + 1, len(self.lines[self.at][:indent].encode()) + 1)

    def line(self) -> None:
        """The line at hand, and the further ones of its value."""
        line, stack, wants = self.lines[self.at], self.stack, self.wants
        content = line.lstrip(" ")
        indent = len(line) - len(content)
        if content.startswith("\t"):
            raise Fault("unexpectedToken", self.at + 1, indent + 1)
        if not _without_comment(content):
            return
        if not (not self.finish and self.at == len(self.lines) - 1 and content == "-" and wants):
            dash = content.startswith("-") and (len(content) == 1 or content[1] == " ")
            inside = bool(stack) and wants and (indent > stack[-1][0] or dash and indent == stack[-1][0] and stack[-1][1] == "}")
            if stack and not inside:
                if wants:
                    raise Fault("missingValue", self.at + 1, indent + 1)
                while stack and (stack[-1][0] > indent or stack[-1][0] == indent and stack[-1][1] == "]" and not dash):
                    self.close()
                if not stack or stack[-1][0] != indent:
                    raise Fault("unexpectedToken", self.at + 1, indent + 1)
        self.entry(content, indent)

    def entry(self, content: str, indent: int) -> None:
        stack = self.stack
        last = not self.finish and self.at == len(self.lines) - 1  # more of this line may follow
        while content.startswith("- ") or content == "-" and not last:
            if stack and stack[-1] == (indent, "]") and not self.wants:
                self.out.append(",")
            elif self.wants:
                self.open(indent, "]")
            else:
                raise self.fault("unexpectedToken", indent)
            self.wants = True
            rest = content[1:].lstrip(" ")
            if not rest or rest.startswith("#"):
                return
            content, indent = rest, indent + len(content) - len(rest)
        key = _KEY.match(content)
        if key and not (last and key.end() == len(content) and not content.endswith((":", " "))):
            if stack and stack[-1] == (indent, "}") and not self.wants:
                self.out.append(",")
            elif self.wants:
                self.open(indent, "}")
            else:
                raise self.fault("missingComma" if stack and stack[-1][1] == "]" else "unexpectedToken", indent)
            name = key[1]
            self.name(name if name.startswith('"') else _quoted(name))
            self.wants = True
            rest = content[key.end() :]
            if _without_comment(rest):
                self.value(rest, indent + key.end(), last)
            return
        if last and re.fullmatch(r'-|[0-9A-Za-z_][0-9A-Za-z_-]*:?|"(?:[^"\\]|\\.)*\\?"?:?', content) and (not stack or stack[-1][0] <= indent) and not re.fullmatch(r"-?[0-9.]+", content):
            if content.startswith('"') and self.wants and not stack:
                self.value(content, indent, last)
            return  # may become a key
        if not self.wants:
            raise self.fault("missingColon" if stack and stack[-1] == (indent, "}") else "unexpectedToken", indent)
        self.value(content, indent, last)

    def value(self, rest: str, indent: int, last: bool) -> None:
        self.wants = False
        if rest[0] in "|>":
            if _without_comment(rest) not in "|>":
                raise self.fault("invalidMultiLineString", indent)
            self.block(rest[0] == ">", indent)
        elif rest[0] == '"':
            m = _STRING.match(rest)
            if not m:
                if last:
                    self.put(rest)
                    return
                raise self.fault("unterminatedString", indent)
            if _without_comment(rest[m.end() :]):
                raise self.fault("unexpectedToken", indent)
            self.put(m[0])
        elif rest[0] in "[{":
            lines, begin = self.lines, self.at
            body, depth = _flow(rest, last)
            while depth > 0 and self.at + 1 < len(lines):
                self.at += 1
                body, depth = _flow("\n".join([rest, *lines[begin + 1 : self.at + 1]]), not self.finish and self.at == len(lines) - 1)
            if depth < 0:
                raise self.fault("unexpectedToken", indent)
            self.put(body)
            if depth > 0 and self.finish:
                raise Fault("missingClosingBracket" if body.count("[") > body.count("]") else "missingClosingBrace", len(lines), len(lines[-1].encode()) + 1)
        else:
            word = _without_comment(rest)
            self.put(_scalar(word, last) + ("" if last else " "))

    def block(self, folded: bool, indent: int) -> None:
        """The lines of a block scalar."""
        lines = self.lines
        parent = self.stack[-1][0] if self.stack else -1
        end = self.at + 1
        while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip(" ")) > parent):
            end += 1
        block = lines[self.at + 1 : end]
        first = next((b for b in block if b.strip()), "")
        if not self.finish and end == len(lines):
            self.put('""')
        elif not first:
            raise self.fault("invalidMultiLineString", indent)
        else:
            indent = len(first) - len(first.lstrip(" "))
            body = "\n".join(b[indent:] for b in block).rstrip("\n")
            if folded:
                body = re.sub(r"\n{2,}", "\n\n", re.sub(r"(?<!\n)\n(?!\n)", " ", body))
            self.put(_quoted(body))
        self.at = end - 1

    def end(self) -> None:
        """The end of the text closes what is open."""
        if self.stack and self.wants:
            raise Fault("missingValue", len(self.lines), len(self.lines[-1].encode()) + 1)
        while self.stack:
            self.close()


def to_json(text: str, finish: bool = True) -> tuple[str | None, str | None, int | None, int | None]:
    """(JSON, reason, line, column); the JSON is that of a prefix where the text is one or has a fault."""
    reader = _Reader(text.split("\n"), finish)
    fault = (None, None, None)
    try:
        while reader.at < len(reader.lines):
            reader.line()
            reader.at += 1
        if finish:
            reader.end()
    except Fault as e:
        fault = e.args
    return "".join(reader.out) or None, *fault


class _Kind:
    """What a schema allows at one place of a text; ``code`` is one of [, {, s, b, i, d, and * for a member it doesn't name."""

    def __init__(self, code: str, low: int = 0, high: int = 0, item: _Kind | None = None, members: dict[str, _Kind] | None = None):
        self.code, self.low, self.high, self.item, self.members = code, low, high, item, members or {}

    def of_member(self, name: str) -> _Kind:
        return self.members.get(name, _ANY)


_ANY = _Kind("*")
_ANY.item = _ANY
_WHOLE = {T.ByteType(): 8, T.ShortType(): 16, T.IntegerType(): 32, T.LongType(): 64}


def _kind(kind: T.DataType) -> _Kind | None:
    """None for schemas that are left to the decoder: those with maps, decimals, floats, bytes, dates or metadata."""
    if isinstance(kind, T.StructType):
        read = {f.name: None if f.metadata else _kind(f.dataType) for f in kind.fields}
        good = read and len(read) == len(kind.fields) and None not in read.values()
        return _Kind("{", members=read) if good else None  # type: ignore[arg-type]
    if isinstance(kind, T.ArrayType):
        item = _kind(kind.elementType)
        return item and _Kind("[", item=item)
    if kind in _WHOLE:
        high = 1 << _WHOLE[kind] - 1
        return _Kind("i", -high, high - 1)
    return {T.StringType(): _Kind("s"), T.BooleanType(): _Kind("b"), T.DoubleType(): _Kind("d")}.get(kind)


class _Unsure(Exception):
    """The text is left to the decoder."""


def _strict(pairs: list[tuple[str, object]]) -> dict[str, object]:
    if len(dict(pairs)) < len(pairs) or not all(k for k, _ in pairs):
        raise _Unsure
    return dict(pairs)


def _short(parse: Callable[[str], float], longest: int) -> Callable[[str], float]:
    def read(token: str) -> float:
        if len(token) > longest or token == "-0" or "e" in token.lower():
            raise _Unsure
        return parse(token)

    return read


_load = json.JSONDecoder(object_pairs_hook=_strict, parse_float=_short(float, 17), parse_int=_short(int, 20), parse_constant=_short(float, 0)).decode


def _check(value: object, kind: _Kind) -> None:
    """_Unsure unless ``value`` is of the kind, without nulls in what the schema names and without structs that show nothing."""
    code = kind.code
    if isinstance(value, dict):
        good = code == "*" or code == "{" and any(name in kind.members for name in value)
        for name, v in value.items():
            _check(v, kind.of_member(name))
    elif isinstance(value, list):
        good = code in "*["
        for v in value:
            _check(v, kind.item or _ANY)
    elif isinstance(value, str):
        good = code in "*s"
    elif isinstance(value, bool):
        good = code in "*b"
    elif isinstance(value, int):
        good = code in "*d" or code == "i" and kind.low <= value <= kind.high
    else:
        good = code == "*" or code == "d" and value is not None
    if not good:
        raise _Unsure


#: A line that ends in a number, a string or a word: one of the same form, as it is written, tells what is written for it.
_FORM = re.compile(r'([ ]*+(?:-[ ]++)*+(?:[0-9A-Za-z_][0-9A-Za-z_-]*+:[ ]++)?+)(?:([1-9][0-9]{0,17})|("[^"\\\x00-\x1f]*+")|([A-Za-z](?:[^"\\#:\x00-\x1f]*[0-9A-Za-z.,!?)])?))')
#: Containers within containers that _Line follows.
_DEPTH = 64


class _Line(_Reader):
    """One line read from a state, its values held against the kinds."""

    def __init__(self, line: str, state: tuple):
        super().__init__([line], True)
        stack, self.wants, self.kinds, self.kind = state
        self.stack = list(stack)
        self.kinds = list(self.kinds)  # of the open containers: (kind, the names read of those it has); kind: of a member's value
        self.held: tuple[bool, int] | None = None  # a block scalar that begins here

    def state(self) -> tuple:
        return tuple(self.stack), self.wants, tuple(self.kinds), self.kind

    def next_kind(self) -> _Kind:
        return self.kinds[-1][0].item or _ANY if self.stack and self.stack[-1][1] == "]" else self.kind

    def open(self, indent: int, closer: str) -> None:
        kind = self.next_kind()
        if kind.code not in ("*", "[" if closer == "]" else "{") or len(self.stack) == _DEPTH:
            raise _Unsure
        super().open(indent, closer)
        self.kinds.append((kind, frozenset()))

    def close(self) -> None:
        kind, names = self.kinds.pop()
        if kind.code == "{" and not names:
            raise _Unsure
        super().close()

    def name(self, name: str) -> None:
        key = _load(name)
        kind, names = self.kinds[-1]
        if not 0 < len(key) < 1_000 or "\\" in name or key in names:
            raise _Unsure
        self.kind = kind.of_member(key)
        if key in kind.members:
            self.kinds[-1] = kind, names | {key}
        super().name(name)

    def put(self, json: str) -> None:
        if "\\u" in json or json.count("[") + json.count("{") > _DEPTH:
            raise _Unsure
        _check(_load(json), self.next_kind())
        super().put(json)

    def block(self, folded: bool, indent: int) -> None:
        if self.next_kind().code not in "*s":
            raise _Unsure
        self.out.append('"')
        self.held = folded, self.stack[-1][0] if self.stack else -1


class _State(dict):
    """What each line met in this state writes, and the state after it; made when the line is first met.

    ``at`` is a state of _Line; ``block`` (folded, parent's indentation, indentation or None, line breaks not written) of an
    open block scalar.
    """

    def __init__(self, plain: Plain, at: tuple, block: tuple | None):
        self.plain, self.at, self.block = plain, at, block
        self.rest: str | None = None  # what the end of the text writes

    def __missing__(self, line: str) -> tuple[str, _State]:
        step = self.alike(line)
        if step is None:
            written, at, block = self.read(line)
            step = written, self.plain.state(at, block)
        if len(line) <= 256 and self.plain.room(1):
            self[line] = step
        return step

    def alike(self, line: str) -> tuple[str, _State] | None:
        """The step of a line by that of another, of the same form."""
        m = _FORM.fullmatch(line)
        if not m or m[4] in _WORDS:
            return None
        head, number, string, word = m.groups()
        # what holds of the greatest number of as many digits holds of this one
        form, shown = ("9" * len(number), number) if number else ('""', string) if string else ("x", f'"{word}"')
        if head + form == line:
            return None
        try:
            written, after = self[head + form]
        except (Fault, _Unsure, ValueError):
            return None
        end = form if form != "x" else '"x"'
        bare = written.rstrip(" ")
        return (bare[: -len(end)] + shown + written[len(bare) :], after) if bare.endswith(end) else None

    def read(self, line: str) -> tuple[str, tuple, tuple | None]:
        before = ""
        if self.block:
            folded, parent, indent, breaks = self.block
            own = len(line) - len(line.lstrip(" "))
            blank = not line.strip()
            if blank and (own < len(line) or indent is None and own or breaks > 64):
                raise _Unsure
            if blank and own <= (indent or 0):
                return "", self.at, (folded, parent, indent, breaks + 1)
            if blank or own > parent:
                indent = own if indent is None else indent
                if own < indent:
                    raise _Unsure
                body = _quoted(line[indent:])[1:-1]
                if "\\u" in body:
                    raise _Unsure
                gap = ("", " ")[breaks] if folded and breaks < 2 else "\\n" * min(breaks, 2 if folded else breaks)
                return gap + body, self.at, (folded, parent, indent, 1)
            if indent is None:
                raise _Unsure
            before = '"'
        reader = _Line(line, self.at)
        reader.line()
        return before + "".join(reader.out), reader.state(), reader.held and (*reader.held, None, 0)

    def end(self) -> str:
        if self.rest is None:
            reader = _Line("", self.at)
            if reader.wants or self.block and self.block[2] is None:
                raise _Unsure
            reader.end()
            self.rest = ('"' if self.block else "") + "".join(reader.out) + "}"
        return self.rest


class Plain:
    """Reads whole texts without a fault, of which every value is of its kind, as JSON that Spark's own reader types alike.

    What a line means depends on what is open before it, and little else, so that the steps from state to state are kept for
    the next text: most lines are then one look into a table.  What is kept is bounded.
    """

    #: Steps kept, and the most characters of a text that Spark's reader is given.
    ROOM, LONGEST = 1 << 15, 1 << 23

    def __init__(self, kind: _Kind):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.used = 0
        self.first = self.state(((), True, (), self.kind), None)

    def room(self, n: int) -> bool:
        self.used += n
        return self.used < self.ROOM

    def state(self, at: tuple, block: tuple | None) -> _State:
        got = self.states.get((at, block))
        if got is None:
            got = _State(self, at, block)
            if self.room(1 + len(at[0])):
                self.states[at, block] = got
        return got

    def read(self, text: str) -> str | None:
        """{"v": the value}, or None where the decoder has to say."""
        if len(text) > self.LONGEST:
            return None
        if self.used >= self.ROOM:
            self.clear()
        state, out = self.first, ['{"v":']
        write = out.append
        try:
            for line in text.split("\n"):
                written, state = state[line]
                write(written)
            write(state.end())
        except (Fault, _Unsure, ValueError):
            return None
        return "".join(out)


@lru_cache(maxsize=16)
def _plain(schema: str) -> Plain | None:
    kind = _kind(T._parse_datatype_json_string(schema))
    return kind and Plain(kind)


def _typed(documents: list[str | None], kind: T.DataType) -> pa.Array:
    """What Plain wrote as values of the kind."""
    lines = [(d or "{}").encode() for d in documents]
    read = pj.ReadOptions(use_threads=False, block_size=max(1 << 20, 2 * max(map(len, lines), default=0)))
    column = pa.schema([pa.field("v", to_arrow_type(kind))])
    table = pj.read_json(pa.BufferReader(b"\n".join(lines)), read, pj.ParseOptions(explicit_schema=column, unexpected_field_behavior="ignore"))
    return table["v"].combine_chunks()


_READ = [T.StructField(name, kind) for name, kind in (("json", T.StringType()), ("reason", T.StringType()), ("line", T.IntegerType()), ("col", T.IntegerType()))]


def _read(finish: bool, kind: T.DataType | None) -> Callable[[Column], Column]:
    """struct<json, reason, line, col> of YAML; with ``kind`` also its value where all is plain, and no JSON there."""
    schema = kind and kind.json()

    def read(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        plain = schema and _plain(schema)
        quick = [plain.read(t) if plain and t is not None else None for t in texts]
        rows = [(None,) * 4 if t is None or q is not None else to_json(t, finish) for t, q in zip(texts, quick)]
        cols = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(_READ)]
        names = [f.name for f in _READ]
        if kind:
            cols, names = [*cols, _typed(quick, kind)], [*names, "value"]
        return pa.StructArray.from_arrays(cols, names)

    return F.arrow_udf(read, T.StructType(_READ + [T.StructField("value", kind)] if kind else _READ))  # type: ignore[call-overload]


def yaml_decoded(df: DataFrame, text: Column, schema: T.DataType | str, out: str = "decoded", keys: Callable[[Column], Column] | None = None, finish: bool = True) -> DataFrame:
    """``df`` with struct<value, error, nulls> of YAML; faults found by the decoder of JSON have no place."""
    ship(df.sparkSession)
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    quick = finish and keys is None and _kind(kind) is not None
    read = f"_{out}_yaml"
    got = df.withColumn(read, _read(finish, partial_type(kind) if quick else None)(text))
    mine, inner, none = F.col(f"`{read}`"), F.col(f"`{out}`"), F.lit(None)
    got = decoded(got, mine["json"], kind, out, LOOSE, keys, finish=False)
    place = F.when(inner["error"].isNotNull(), F.struct(inner["error"]["reason"].alias("reason"), none.cast("int").alias("line"), none.cast("int").alias("col"), inner["error"]["context"].alias("context")))
    own = F.struct(mine["reason"].alias("reason"), mine["line"].alias("line"), mine["col"].alias("col"), F.lit("neutral").alias("context"))
    error = F.coalesce(place, F.when(mine["reason"].isNotNull(), own))
    value = F.coalesce(mine["value"], inner["value"]) if quick else inner["value"]
    whole = F.struct(value.alias("value"), error.alias("error"), F.coalesce(inner["nulls"], F.array().cast("array<string>")).alias("nulls"))
    return got.withColumn(out, F.when(text.isNotNull(), whole)).drop(read)


def yaml_partials(docs: DataFrame, key: str, text: str, schema: T.DataType | str, step: int = 1) -> DataFrame:
    """(key, seq, state, error): the state after every ``step`` characters, and one more for the end of the document."""
    n = F.length(text)
    ends = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.ceil(n / step).cast("int")), lambda i: F.least(i * step, n))).otherwise(F.array().cast("array<int>"))
    rows = docs.where(F.col(text).isNotNull()).select(key, text, F.posexplode(F.concat(ends, F.array(n + 1))).alias("seq", "end")).withColumn("n", n)
    parts = yaml_decoded(rows.where("end <= n"), F.col(text).substr(F.lit(1), F.col("end")), schema, "got", finish=False)
    whole = yaml_decoded(rows.where("end > n"), F.col(text), schema, "got")
    return parts.union(whole).select(key, "seq", F.col("got.value").alias("state"), F.col("got.error").alias("error"))
