import pytest
from pyspark.sql import functions as F

from tidewater.functions.keys import camel_key, checked_double, checked_integer
from tidewater.operators.json_partials import byte_partials, finish_reason

# Inputs and states that any decoder of this format has to show (FIXTURES.md, section 3).
# Visible state after each character, then after the end of the document.
STATES = [
    ('{"v":"Blob"}', "v string", [None] * 5 + ["", "B", "Bl", "Blo", "Blob", "Blob", "Blob", "Blob"]),
    ('{"v":-123}', "v int", [None] * 5 + [0, -1, -12, -123, -123, -123]),
    ('{"v":12.34}', "v double", [None] * 5 + [1, 12, 12, 12.3, 12.34, 12.34, 12.34]),
    ('{"v":12e3}', "v double", [None] * 5 + [1, 12, 12, 12, 12000, 12000]),
    ('{"v":[1,2]}', "v array<int>", [None] * 5 + [[], [1], [1], [1, 2], [1, 2], [1, 2], [1, 2]]),
    ('{"v":true}', "v boolean", [None] * 5 + [True] * 6),
    ('{"v":"a\\nb"}', "v string", [None] * 5 + ["", "a", "a", "a\n", "a\nb", "a\nb", "a\nb", "a\nb"]),
    ('{"v":1,"v":2}', "v int", [None] * 5 + [1] * 6 + [2, 2, 2]),
    ('{"u":{"x":[{}]},"v":1}', "v int", [None] * 20 + [1, 1, 1]),
]


@pytest.mark.parametrize("text,schema,want", STATES, ids=[s[0] for s in STATES])
def test_states(spark, text, schema, want):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    rows = byte_partials(df, "k", "t", schema).orderBy("seq").collect()
    assert [None if r.state is None else r.state.v for r in rows] == want


def test_steps_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, '{"v":12}'), (2, None), (3, "")], "k int, t string")
    rows = byte_partials(df, "k", "t", "v int", step=6).orderBy("k", "seq").collect()
    assert [(r.k, r.seq, r.state and r.state.v) for r in rows] == [(1, 0, 1), (1, 1, 12), (1, 2, 12), (3, 0, None)]


def test_finish_reasons(spark):
    cases = {'"abc': "unterminatedString", '{"a": 1': "missingClosingBrace", "[1,2": "missingClosingBracket", "[1]": None, '{"a":"]"}': None}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", finish_reason(F.col("t")).alias("r"))
    assert {r.t: r.r for r in df.collect()} == cases


def test_keys_and_numbers(spark):
    keys = {"snake__case": "snakeCase", "snake_case__": "snakeCase__", "1_value": "1Value", "___": "___", "plain": "plain", "_a_bC": "_aBc"}
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", camel_key(F.col("k")).alias("c"))
    assert {r.k: r.c for r in df.collect()} == keys
    df = spark.createDataFrame([(t,) for t in ["127", "-129", "1.5", "x", "1e400", None]], "t string")
    i, why = checked_integer(F.col("t"), "int8")
    d, over = checked_double(F.col("t"))
    got = [tuple(r) for r in df.select(i, why, d, over).collect()]
    assert got == [
        (127, None, 127.0, None),
        (None, "numericOverflow", -129.0, None),
        (None, "numericOverflow", 1.5, None),
        (None, "invalidType", None, "invalidType"),
        (None, "numericOverflow", None, "numericOverflow"),
        (None, None, None, None),
    ]
