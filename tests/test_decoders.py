import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.keys import camel_key
from tidewater.operators import yaml_tree
from tidewater.operators.json_decode import Syntax, as_partial, checked_partials, decode, partial_type
from tidewater.operators.yaml_tree import to_json, yaml_decoded, yaml_partials
from tidewater.streaming.chunks import _fold


def rows(spark, schema, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    return [r.d for r in df.select("i", decode(F.col("t"), schema, **how).alias("d")).orderBy("i").collect()]


FAULTS = {
    "array<bigint>": {"[4,5,y]": "unexpectedToken", "[4,,5]": "missingValue", "[4,]": "trailingComma", "[4 5]": "missingComma", "][": "unexpectedToken", "[4,5": "missingClosingBracket", "[4}": "unexpectedToken", "[7] 8": "unexpectedToken", "['a']": "unexpectedToken", "[/*x*/4]": "unexpectedToken", "[4,\"a\"]": "invalidType", "[92233720368547758080]": "numericOverflow", "[0x1]": "invalidNumber", "[.5]": "unexpectedToken", "[+5]": "unexpectedToken"},
    "map<string,bigint>": {'{"q":}': "missingValue", '{"q" 3}': "missingColon", '{"q": 3,}': "trailingComma", '{"q": 3': "missingClosingBrace", '{"q": fals}': "invalidLiteral", '{"q": -}': "invalidNumber", '{"q": 07}': "leadingZero", '{"q": 3e}': "invalidExponent", "{q: 3}": "unexpectedToken", '{"q": {}}': "invalidType"},
    "string": {'"open': "unterminatedString", '"\\u9"': "invalidUnicodeEscape", '"\\udc00"': "invalidUnicodeEscape", "4": "invalidType", "true": "invalidType"},
    "boolean": {"nul": "invalidLiteral", '"true"': "invalidType", "0": "invalidType"},
    "float": {"3.5e38": "numericOverflow", "1e400": "numericOverflow", "NaN": "unexpectedToken"},
}


@pytest.mark.parametrize("schema", list(FAULTS))
def test_reasons(spark, schema):
    got = rows(spark, schema, list(FAULTS[schema]))
    assert {t: d.error and d.error.reason for t, d in zip(FAULTS[schema], got)} == FAULTS[schema]


def test_ranges_of_whole_numbers(spark):
    cases = {"int8": ("tinyint", "-128", "128"), "uint8": ("smallint", "255", "-1"), "uint32": ("bigint", "4294967295", "4294967296"), "uint64": ("decimal(20,0)", str(2**64 - 1), str(2**64)), "int128": ("string", str(-(2**127)), str(2**127)), "uint128": ("string", str(2**128 - 1), "-5")}
    for kind, (sql, good, bad) in cases.items():
        schema = T.StructType([T.StructField("v", T._parse_datatype_string(sql), metadata={"kind": kind})])
        a, b = rows(spark, schema, [f'{{"v": {good}}}', f'{{"v": {bad}}}'])
        assert str(a.value.v) == good and a.error is None and b.error.reason == "numericOverflow", kind


def test_places_members_and_nulls(spark):
    got = rows(spark, "a struct<b:bigint,c:array<struct<d:string>>>, e boolean", ['{\n "a": {"b": 5},\n "é": 1, "a": {"c": [{"d": null}]}, "x" 3}', '{"a": {"c": []}, "e": null}', "", None, '{"e": 1}'])
    assert tuple(got[0].error) == ("missingColon", 3, 42, "objectKey") and got[0].value.a.b == 5 and got[0].value.a.c[0].d is None and got[0].nulls == ["a.c[].d"]
    assert got[1].value.a.c == [] and got[1].nulls == ["e"] and got[2].value is None and got[2].error is None and got[3] is None
    assert got[4].error.reason == "invalidType" and got[4].value is None


def test_loose_syntax_names_and_strategy(spark):
    every = Syntax(comments=True, trailing_commas=True, unquoted_keys=True, single_quotes=True, leading_plus=True, leading_zeros=True, leading_point=True, hex_numbers=True, non_finite=True)
    texts = ["[0x1F, +2, 003, -0x10,]", "// c\n[1 /* d */, 2]", "[0x]", "[1x3]", "[00x7]", "[1, /* open"]
    got = rows(spark, "array<bigint>", texts, syntax=every)
    assert [d.value for d in got[:2]] == [[31, 2, 3, -16], [1, 2]]
    assert [d.error.reason for d in got[2:5]] == ["invalidNumber"] * 3 and got[5].error is not None
    schema = T.StructType([T.StructField("userName", T.StringType(), metadata={"keys": ["userName", "login"]}), T.StructField("skipped", T.LongType(), metadata={"ignored": True})])
    a, b = rows(spark, schema, ["{'user_name': 'it\\'s', \"skipped\": 4}", "{login: \"x\"}"], syntax=every, keys=camel_key)
    assert (a.value.userName, a.value.skipped, b.value.userName) == ("it's", None, "x")
    with pytest.raises(ValueError):
        decode(F.col("t"), T.StructType([T.StructField("a", T.LongType(), metadata={"keys": ["n"]}), T.StructField("b", T.LongType(), metadata={"keys": ["n"]})]))


def test_every_state_and_the_fault(spark):
    df = spark.createDataFrame([(1, "[6,70,y]")], "k int, t string")
    got = checked_partials(df, "k", "t", "array<bigint>", initial=F.array().cast("array<bigint>")).orderBy("seq").collect()
    assert [r.state for r in got] == [[], [6], [6], [6, 7], [6, 70], [6, 70], [6, 70], [6, 70], [6, 70]]
    assert [r.error is not None for r in got] == [False] * 6 + [True] * 3
    word = spark.createDataFrame([(1, '{"b": true, "d": 1.5e2}')], "k int, t string")
    got = checked_partials(word, "k", "t", "b boolean, d double").orderBy("seq").collect()
    assert [r.state.b if r.state else None for r in got][5:8] == [None, True, True]
    assert [r.state.d for r in got[17:]] == [1.0, 1.0, 1.5, 1.5, 1.5, 150.0, 150.0]


def test_partial_types(spark):
    full = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("l", T.ArrayType(T.StructType([T.StructField("x", T.StringType(), False)]), False), False)])
    part = partial_type(full)
    assert part["a"].nullable and part["l"].dataType.containsNull and part["l"].dataType.elementType["x"].nullable
    row = spark.range(1).select(F.struct(F.lit(4).cast("long").alias("a"), F.array(F.struct(F.lit("q").alias("x"))).alias("l")).alias("v")).select(as_partial(F.col("v"), full).alias("v")).first()
    assert row.v.a == 4 and row.v.l[0].x == "q"


def test_yaml_lines():
    good = {
        "a: 7\nb: x y # c\n": '{"a":7 ,"b":"x y" }', "o:\n  i: 7": '{"o":{"i":7 }}', "-\n  k: v\n- k: w": '[{"k":"v" },{"k":"w" }]', "k:\n- 1\n- 2\nz: 3": '{"k":[1 ,2 ],"z":3 }', "- - 1\n  - 2\n- - 3": "[[1 ,2 ],[3 ]]",
        "t: |\n  a\n   b\n\n  c\nu: >\n  a\n  b\n\n  c": '{"t":"a\\n b\\n\\nc","u":"a b\\n\\nc"}', "x: {u: http://h/c, v: [2, {w: q r}]}": '{"x":{"u":"http://h/c" ,"v":[2 ,{"w":"q r" }]}}', "": None,
    }
    assert {t: to_json(t) for t in good} == {t: (j, None, None, None) for t, j in good.items()}
    bad = {"a: 7\nbad": ("missingColon", 2, 1), "a: 7\n\tb: 2": ("unexpectedToken", 2, 1), "a:\nb: 7": ("missingValue", 2, 1), "a: | no": ("invalidMultiLineString", 1, 4), 's: "x': ("unterminatedString", 1, 4), "f: [1": ("missingClosingBracket", 1, 6), "a: 7\n  b: 2": ("unexpectedToken", 2, 3)}
    assert {t: to_json(t)[1:] for t in bad} == bad
    assert to_json("- " * 5_000 + "1")[0].count("[") == 5_000


def test_yaml_steps_are_kept(spark, monkeypatch):
    kind = yaml_tree._kind(T._parse_datatype_string("id bigint, l array<struct<n:int,q:struct<v:bigint>,f:array<string>,t:string>>"))
    line = "  - n: 1  # c\n    q: {v: 2, u: p}\n    f: [N, O]\n    t: |\n      a\n\n      b\n"
    texts = [f"id: {i}\nl:\n" + line * (1 + i % 7) for i in range(1_000)]
    plain = yaml_tree.Plain(kind)
    fresh, read = [], yaml_tree._State.read
    monkeypatch.setattr(yaml_tree._State, "read", lambda self, line: fresh.append(line) or read(self, line))
    got = [plain.read(t) for t in texts]
    # one new step a text, for its id, and that from another id of as many digits
    assert len(fresh) < 30
    assert [json.loads(g)["v"] for g in got] == [json.loads(to_json(t)[0]) for t in texts] and plain.used < 1_100
    monkeypatch.setattr(yaml_tree.Plain, "ROOM", 50)
    plain = yaml_tree.Plain(kind)
    assert [plain.read(t) for t in texts] == got and len(plain.states) <= 50


def test_yaml_lines_of_one_form_are_read_alike(spark, monkeypatch):
    lines = ["5", "123", "127", "128", "999999999999999999", "9999999999999999999", "x", "q r.", "tru", "true", "null", '""', '"a # b"', '"a: b"', "a: b", "a # b", "a:b", "k: x", '"x" # c', "x\u2003", "x\x85y", "- 5", "a, b]", "q\"r"]
    texts = [head + line + tail for head in ("", "- ", "a: ", "n: ", "s: ", "z: ", "s: |\n  ", "s: >\n  k: ", "z: |\n  - ", "s: |\n  w\n") for line in lines for tail in ("", "\nb: true")]
    for schema in ("a bigint, n tinyint, s string, b boolean", "array<string>", "string", "array<tinyint>"):
        kind = yaml_tree._kind(T._parse_datatype_string(schema))
        with monkeypatch.context() as m:
            m.setattr(yaml_tree._State, "alike", lambda self, line: None)
            plain = yaml_tree.Plain(kind)
            want = [plain.read(t) for t in texts]
        plain = yaml_tree.Plain(kind)
        assert [plain.read(t) for t in texts] == want and any(want)


def test_plain_yaml_is_decoded_alike_on_both_ways(spark, monkeypatch):
    schema = "a bigint, s string, l array<struct<n:tinyint,f:array<string>>>, d double, b boolean"
    plain = [
        "a: 7\nl:\n- n: 1\n  f: [x, \"y, z\"]\n-\n  f: []\nb: true\nd: 1.25", "s: >\n\n  q w\n  e\n\n\n   \\ \"r\nl: [{n: -128}]\nd: 3", "zz: {a: [null, 1.5]}\na: 1 # c\ns: |\n x\n\n\ny: 2", 's: "é \\n😀"\na: -3\n\n# c\n',
    ]
    other = [
        "a: 7\na: 8", "a: null\ns: x", "zz: 1", "l:\n- zz: 1\n- n: 2", "l: [{}]", "a: -0\nd: -0", "a: 07", "a: 1.0", "a: 9223372036854775808", "l: [{n: 128}]", "s: 5", "s: true", "d: .5", "d: NaN", "d: 1e400", "d: 12345678901234567890.5", "b: tru",
        's: "\\u0041"', 's: "\\q"', 's: "t\tx"', '"\\u0061": 1\nb: true', "s: |\n  x\n y\nb: true", "s: |\n   \n  x", "s: |\nb: true", "s: |\n  x\n\t\n  y", "a: 1\nl: [{n: 1},\n {n: 2}]\nb: true", "a: [1", "a: 1\n b: true", "l: {n: 1}", "", "# c", "x", None, "zz: " + "[" * 1500 + "]" * 1500 + "\na: 1",
    ]
    reader = yaml_tree.Plain(yaml_tree._kind(T._parse_datatype_string(schema)))
    assert all(reader.read(t) for t in plain) and not any(t is not None and reader.read(t) for t in other)
    df = spark.createDataFrame(list(enumerate(plain + other)), "k int, t string")
    read = lambda: [r.d for r in yaml_decoded(df, F.col("t"), schema, "d").orderBy("k").collect()]
    got = read()
    assert got[0].value.asDict(recursive=True) == {"a": 7, "s": None, "l": [{"n": 1, "f": ["x", "y, z"]}, {"n": None, "f": []}], "d": 1.25, "b": True}
    assert all(d.error is None and d.nulls == [] for d in got[:4])
    monkeypatch.setattr(yaml_tree, "_kind", lambda kind: None)
    assert repr(got) == repr(read())


def test_yaml_states(spark):
    df = spark.createDataFrame([(1, "- 6\n- 7"), (2, "n:\n  - 6\n  - 7")], "k int, t string")
    got = yaml_partials(df.where("k = 1"), "k", "t", "array<bigint>").orderBy("seq").collect()
    assert [r.state for r in got] == [None, [], [6], [6], [6], [6], [6, 7], [6, 7]]
    got = yaml_partials(df.where("k = 2"), "k", "t", "n array<bigint>").orderBy("seq").collect()
    assert [r.state.n if r.state else None for r in got] == [None] * 6 + [[]] + [[6]] * 6 + [[6, 7]] * 2


class State:
    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_streams_report_gaps_and_the_end():
    import pandas as pd

    state = State()
    step = lambda *chunks: [tuple(r)[1:] for r in next(_fold((5,), [pd.DataFrame(chunks, columns=["seq", "chunk", "ends"])], state)).itertuples(index=False)]
    assert step((1, "b", False)) == [(0, "missing", "")]
    assert step((0, "a", False), (3, "d", True)) == [(0, "chunk", "a"), (1, "chunk", "ab"), (2, "missing", "ab")]
    assert step((2, "c", False), (1, "again", False)) == [(2, "chunk", "abc"), (3, "chunk", "abcd"), (4, "end", "abcd")]
    assert step((3, "d", True)) == []


def test_faultless_documents_are_decoded_alike_on_both_ways(spark, monkeypatch):
    from tidewater.operators import json_decode as J

    schema = T._parse_datatype_string("id bigint, user_name string, tags array<struct<n:int,at:map<string,double>>>, on boolean, o struct<p:string,q:bigint>")
    good = ['{"id": 7, "tags": [ {"n":1,"at":{"x":1.5e3,"x":2}} ,{"at":{}}],"on":true}', '{"user_name":"a, \\"n0:null\\": 5\\n","on":null}', '{"o":{"p":"x"},"o":{ "q" : 2 }}', "{ }", '{"o":{},"o":{"p":"y: 3"},"extra":[[], -0.5]}']
    refused = ['{"id": 1.5}', '{"id": 7', '{"id": 07}', '{"tags": [1,]}', '{"tags": [{"n": 3000000000}]}', '{"on": tru}', '{"id": "7"}', "5", '{"\\u0069d": 3}', "[" * 9 + "]" * 9]
    df = spark.createDataFrame([(t,) for t in good + refused], "t string").coalesce(1)
    quick = [r.q for r in df.select(J._quick_tree(F.col("t"), schema, J.STRICT, None)["z"].alias("q")).collect()]
    assert [q is not None for q in quick] == [True] * len(good) + [False] * len(refused)
    both = [J.decoded(df, F.col("t"), schema, "d", keys=camel_key).select("d").collect()]
    monkeypatch.setattr(J, "_quick_tree", lambda text, kind, s, keys: F.when(F.lit(False), J._tree(text, kind)))
    both.append(J.decoded(df, F.col("t"), schema, "d", keys=camel_key).select("d").collect())
    assert both[0] == both[1]
