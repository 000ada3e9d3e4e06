"""Registered queries of the decoding engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.keys import camel_key, checked_double, checked_integer
from tidewater.operators.chunk_partials import chunk_prefixes, escape_json
from tidewater.operators.json_decode import Syntax, checked_partials, decode, decoded, latest
from tidewater.operators.json_partials import byte_partials, decode_prefix, finish_reason
from tidewater.operators.yaml_blocks import block_mapping, block_sequence, folded_block, literal_block
from tidewater.operators.yaml_tree import yaml_decoded, yaml_partials
from tidewater.session import scratch_path, ship, spread, table
from tidewater.sources.documents import in_chunks
from tidewater.streaming.chunks import OUTPUT, streaming_prefixes


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(props["k"]).alias("sum_k"), F.count("*").alias("n"))


def json_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state of every payload, one character a step."""
    states = byte_partials(spread(table(spark, sf_dir, "events"), "event_id"), "event_id", "props", "k bigint")
    return states.select("event_id", F.col("seq").cast("bigint").alias("seq"), F.col("state.k").alias("k"))


def json_partials_by_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = byte_partials(spread(table(spark, sf_dir, "events"), "event_id"), "event_id", "props", "k bigint", step=3)
    return states.select("event_id", F.col("seq").cast("bigint").alias("seq"), F.col("state.k").alias("k"))


def json_chunk_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as one JSON string member, a turn a chunk: the string as far as it has been read."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", escape_json(F.coalesce("text", F.lit(""))).alias("chunk"))
    rows = chunk_prefixes(turns, "conv_id", "turn", "chunk")
    state = decode_prefix(F.concat(F.lit('{"said":"'), "prefix"), "said string")
    return rows.select("conv_id", "turn", F.length(state["said"]).cast("bigint").alias("n_chars"), F.md5(state["said"]).alias("said_md5"))


def json_number_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and counts read as kinds of different ranges: values and the reasons of those refused."""
    token = F.get_json_object("props", "$.k")
    small, why = checked_integer(token, "int8")
    big, over = checked_double(F.concat(token, F.lit("e307")))
    rows = table(spark, sf_dir, "events").select("event_id", small.alias("k8"), why.alias("k8_reason"), over.alias("d_reason"))
    return rows.select("event_id", F.col("k8").cast("bigint").alias("k8"), "k8_reason", "d_reason")


def json_finish_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads cut at a length that depends on the event, and what their end lacks."""
    cut = F.col("props").substr(F.lit(1), (F.col("event_id") % 9).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", finish_reason(cut).alias("reason"))


def json_finish_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the end of every prefix of every payload lacks, from the empty one to the whole payload."""
    rows = spread(table(spark, sf_dir, "events"), "event_id").where("props is not null").select("event_id", "props", F.explode(F.sequence(F.lit(0), F.length("props"))).alias("n"))
    reason = finish_reason(F.col("props").substr(F.lit(1), F.col("n")))
    return rows.select("event_id", F.col("n").cast("bigint").alias("n_read"), reason.alias("reason"))


def snake_case_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("_"), F.lower(F.regexp_replace("p_type", " ", "_")), F.lit("__"))
    return table(spark, sf_dir, "part").select("p_partkey", camel_key(key).alias("key"))


def yaml_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as block mappings and read back."""
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    lines = [F.concat(F.lit(f"{n}: "), F.when(F.lit(n == "o_orderpriority"), F.concat(F.lit(chr(34)), n, F.lit(chr(34)))).otherwise(F.col(n).cast("string"))) for n in names]
    text = F.concat_ws("\n", F.lit("# order"), *lines)
    # Through a generator the map is built once, not once for each member taken from it.
    row = spread(table(spark, sf_dir, "orders"), "o_orderkey").select(F.explode(F.array(block_mapping(text))).alias("m"))
    return row.select(*[F.col("m")[n].cast("bigint" if n.endswith("key") else "string").alias(n) for n in names])


def yaml_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of each order written as a block sequence and read back."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda n: F.concat(F.lit("- "), n.cast("string"))), "\n")
    rows = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(text.alias("y"))
    back = F.transform(block_sequence(F.col("y")), lambda v: v.cast("bigint"))
    return rows.select("l_orderkey", F.size(back).cast("bigint").alias("n"), F.aggregate(back, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"))


def yaml_block_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as literal and as folded scalars, and their values."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"^[ \n]+|\n+\z", "")
    body = F.concat(F.lit("  "), F.regexp_replace(said, "\n", "\n  "))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("b"))
    return rows.select("conv_id", "turn", F.md5(literal_block(F.col("b"))).alias("literal_md5"), F.length(folded_block(F.col("b"))).cast("bigint").alias("n_folded"))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as a stream of chunks that has been run to its end; an unclosed quote ends each."""
    ship(spark)
    source = table(spark, sf_dir, "conversations")
    out, progress = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-progress")
    # A glob, because the streaming reader takes a plain path for a folder and the table may be one file.
    chunks = spark.readStream.schema(source.schema).parquet(f"{sf_dir.rstrip('/')}/conversations.parque[t]")
    lasts = source.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    chunks = chunks.join(lasts, "conv_id").withColumn("chunk", escape_json(F.coalesce("text", F.lit("")))).withColumn("ends", F.col("turn") == F.col("last_turn"))
    rows = streaming_prefixes(chunks, "conv_id", "turn", "chunk", "ends")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTPUT).parquet(out)


def stream_chunk_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """json_chunk_partials over a stream: state per conversation, prefixes decoded as they arrive."""
    state = decode_prefix(F.concat(F.lit('{"said":"'), "prefix"), "said string")
    done = _streamed(spark, sf_dir).where("kind = 'chunk'")
    return done.select(F.col("stream").alias("conv_id"), F.col("seq").alias("turn"), F.length(state["said"]).cast("bigint").alias("n_chars"), F.md5(state["said"]).alias("said_md5"))


def stream_chunk_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at the end of each stream, checked: every other conversation is closed, the rest lack quote and brace."""
    done = _streamed(spark, sf_dir).where("kind = 'end'")
    tail = F.when(F.col("stream") % 2 == 0, '"}').otherwise("")
    row = done.select("stream", "seq", F.explode(F.array(decode(F.concat(F.lit('{"said":"'), "prefix", tail), "said string"))).alias("d"))
    return row.select(F.col("stream").alias("conv_id"), F.col("seq").alias("n_chunks"), F.md5("d.value.said").alias("said_md5"), F.col("d.error.reason").alias("reason"))


def json_chunk_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation in chunks, checked: the state after each turn, and after a turn with a fault the one before it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") == 0, '{"n": [').otherwise(","), F.when(F.col("turn") == 2, "1 2").otherwise(F.col("turn").cast("string"))).alias("chunk"))
    rows = chunk_prefixes(turns, "conv_id", "turn", "chunk")
    got = rows.select("conv_id", "turn", F.explode(F.array(decode(F.col("prefix"), "n array<bigint>", finish=False))).alias("d"))
    return got.select("conv_id", "turn", F.array_join("d.value.n", ",").alias("n"), F.col("d.error.reason").alias("reason"))


#: What json_errors puts in the place of a payload's end, by event_id modulo their number; {n} is the payload's number.
BROKEN = [
    '{{"k": {n}}}', '{{"k": {n}', '{{"k" {n}}}', '{{"k": {n}, "l":}}', '{{"k": {n},}}', '{{"k": {n}, "l": [1 2]}}', '{{"k": {n}, "l": tru}}', '{{"k": {n},\n"l": -}}',
    '{{"k": {n}, "l": 0{n}}}', '{{"k": {n}, "l": 1e}}', '{{"k": "{n}"}}', '{{"k": 1{n}00000000000000000000}}', '{{"k": {n}, "l": "\\u12"}}', '{{"k": {n}, "l": "abc', '{{"k": {n}]',
    '{{"k": {n}, "l": [1,2', '{{"k": {n}, "l": [1,2,x]}}', '{{"k": {n}}} {n}',
]


def _broken(n):
    """The text of BROKEN for an event whose payload's number is ``n``."""
    out = F
    for i, form in enumerate(BROKEN):
        pieces = form.replace("{{", "{").replace("}}", "}").split("{n}")
        made = F.concat(*[x for j, p in enumerate(pieces) for x in ([F.lit(p)] if not j else [n, F.lit(p)])])
        out = out.when(F.col("event_id") % len(BROKEN) == i, made)
    return out


def json_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads broken in each way that has a reason: the reason, its place, and the number read before it."""
    text = _broken(F.get_json_object("props", "$.k"))
    got = spread(table(spark, sf_dir, "events"), "event_id").select("event_id", F.explode(F.array(decode(text, "k bigint, l array<bigint>"))).alias("d"))
    place = [F.col("d.error")[c].cast(t).alias(c) for c, t in (("reason", "string"), ("line", "bigint"), ("col", "bigint"))]
    return got.select("event_id", F.col("d.value.k").alias("k"), F.size("d.value.l").cast("bigint").alias("n_l"), *place)


def json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts read under every kind of number: what fits, and the reason where it doesn't."""
    rows = spread(table(spark, sf_dir, "part"), "p_partkey")
    text = F.to_json(F.struct((F.col("p_size") * 6).alias("v")))
    kinds = {"int8": "tinyint", "int16": "smallint", "uint8": "smallint", "uint64": "decimal(20,0)", "float": "float", "boolean": "boolean", "string": "string", "int128": "string"}
    out, made = [], []
    for name, kind in kinds.items():
        schema = T.StructType([T.StructField("v", T._parse_datatype_string(kind), metadata={"kind": name} if "int" in name else {})])
        made.append(decode(text, schema).alias(name))
        got = F.col(f"d.{name}")
        out += [got["value"]["v"].cast("string").alias(f"v_{name}"), got["error"]["reason"].alias(f"e_{name}")]
    # through a generator each is decoded once, not once for its value and once for its reason
    return rows.select("p_partkey", F.explode(F.array(F.struct(*made))).alias("d")).select("p_partkey", *out)


def json_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written with comments, trailing commas, single quotes, unquoted keys and loose numbers."""
    every = Syntax(comments=True, trailing_commas=True, unquoted_keys=True, single_quotes=True, leading_plus=True, leading_zeros=True, leading_point=True, hex_numbers=True, non_finite=True)
    text = F.concat(
        F.lit("/* an order */ {key: 0x"), F.hex("o_orderkey"), F.lit(", // its customer\n 'cust': +00"), F.col("o_custkey"), F.lit(", half: .5, none: NaN, \"status\": 'it\\'s \"'"), F.lit(", list: [1,2,],}"),
    )
    got = decode(text, "key bigint, cust bigint, half double, none double, status string, list array<int>", every)
    row = spread(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", F.explode(F.array(got)).alias("d"))
    v = F.col("d.value")
    return row.select("o_orderkey", v["key"].alias("key"), v["cust"].alias("cust"), v["half"].alias("half"), F.isnan(v["none"]).alias("is_nan"), v["status"].alias("status"), F.size(v["list"]).cast("bigint").alias("n"), F.col("d.error.reason").alias("reason"))


def json_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that are there, null, or missing, with an initial value for what is missing."""
    n = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"k": '), n, F.lit("}"))).when(F.col("event_id") % 3 == 1, '{"k": null}').otherwise("{}")
    row = spread(table(spark, sf_dir, "events"), "event_id").select("event_id", F.explode(F.array(decode(text, "k bigint"))).alias("d"))
    was_null = F.array_contains("d.nulls", "k")
    return row.select("event_id", F.when(~was_null, F.coalesce(F.col("d.value.k"), F.lit(0))).alias("k"), was_null.alias("was_null"))


def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as arrays of objects, and a map of amounts by status."""
    line = F.struct(F.col("l_linenumber").alias("line_number"), F.struct(F.col("l_quantity").cast("int").alias("value")).alias("qty"), F.create_map("l_linestatus", F.col("l_quantity").cast("int")).alias("byStatus"))
    text = F.to_json(F.struct(F.col("l_orderkey").alias("id"), F.collect_list(line).alias("lines")))
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(text.alias("t"))
    item = T.StructType([
        T.StructField("number", T.IntegerType(), metadata={"keys": ["no", "lineNumber"]}), T.StructField("qty", T.StructType([T.StructField("value", T.LongType())])),
        T.StructField("byStatus", T.MapType(T.StringType(), T.LongType())), T.StructField("note", T.StringType(), metadata={"ignored": True}),
    ])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("lines", T.ArrayType(item))])
    row = decoded(lines, F.col("t"), schema, "d", keys=camel_key)
    x = F.col("d.value.lines")
    total = lambda of: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, e: a + of(e))
    return row.select(
        F.col("d.value.id").alias("id"), F.size(x).cast("bigint").alias("n"), total(lambda e: e["number"]).alias("numbers"), total(lambda e: e["qty"]["value"]).alias("qty"),
        total(lambda e: F.coalesce(F.try_element_at(e["byStatus"], F.lit("O")), F.lit(0))).alias("open_qty"), F.col("d.error.reason").alias("reason"),
    )


def json_checked_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state of each nation as an object, from an initial value; a stray letter ends it."""
    text = F.concat(F.lit('{"name":"'), "n_name", F.lit('","region":'), "n_regionkey", F.lit(" x}"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", text.alias("t"))
    first = F.struct(F.lit("none").alias("name"), F.lit(-1).cast("bigint").alias("region"))
    got = checked_partials(rows, "n_nationkey", "t", "name string, region bigint", initial=first)
    return got.select("n_nationkey", F.col("seq").cast("bigint").alias("seq"), F.col("state.name").alias("name"), F.col("state.region").alias("region"), F.col("error.reason").alias("reason"))


def json_byte_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state of a text with characters of several bytes, one byte a step."""
    text = F.concat(F.lit('{"v":"é'), "n_name", F.lit('😀"}'))
    got = checked_partials(table(spark, sf_dir, "nation").select("n_nationkey", text.alias("t")), "n_nationkey", "t", "v string", unit="byte")
    return got.select("n_nationkey", F.col("seq").cast("bigint").alias("seq"), F.col("state.v").alias("v"))


def json_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each region's name, by seven characters, and the fault that ended it."""
    text = F.concat(F.lit('["'), "r_name", F.lit('", "'), "r_name", F.lit('" 1'))
    rows = table(spark, sf_dir, "region").select("r_regionkey", text.alias("t"))
    got = latest(checked_partials(rows, "r_regionkey", "t", "array<string>", step=7), "r_regionkey")
    return got.select("r_regionkey", F.array_join("state", ",").alias("names"), F.col("error.reason").alias("reason"), F.col("error.col").cast("bigint").alias("col"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as the chunks of a stream."""
    got = in_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 500)
    return got.select("doc_id", "seq", F.md5("chunk").alias("chunk_md5"), "last")


def yaml_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as block sequences of mappings with flow containers and a literal scalar."""
    line = F.concat(
        F.lit("  - number: "), F.col("l_linenumber"), F.lit("  # a line\n    qty: {value: "), F.col("l_quantity").cast("int"), F.lit(', unit: "pcs"}\n    flags: ['),
        "l_returnflag", F.lit(", "), "l_linestatus", F.lit("]\n    note: |\n      first "), "l_linestatus", F.lit("\n\n      last\n"),
    )
    text = F.concat(F.lit("id: "), F.col("l_orderkey"), F.lit("\nlines:\n"), F.array_join(F.collect_list(line), ""), F.lit("done: true\nlimits:\n- 1\n-\n  2\n"))
    rows = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(text.alias("t"))
    schema = "id bigint, lines array<struct<number:int,qty:struct<value:bigint,unit:string>,flags:array<string>,note:string>>, done boolean, limits array<int>"
    got = yaml_decoded(rows, F.col("t"), schema, "d")
    x = F.col("d.value.lines")
    total = lambda of: F.aggregate(x, F.lit(0).cast("bigint"), lambda a, e: a + of(e))
    return got.select(
        F.col("d.value.id").alias("id"), F.size(x).cast("bigint").alias("n"), total(lambda e: e["number"]).alias("numbers"), total(lambda e: e["qty"]["value"]).alias("qty"),
        total(lambda e: F.when(F.array_contains(e["flags"], "O"), 1).otherwise(0)).alias("n_open"), F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda e: e["note"]))), "|").alias("notes"),
        F.col("d.value.done").alias("done"), F.array_join("d.value.limits", ",").alias("limits"), F.col("d.error.reason").alias("reason"),
    )


#: What yaml_errors reads, by event_id modulo their number, and its reason, line and column; {n} is the payload's number.
BROKEN_YAML = [
    ("k: {n}\nl: [1, 2]", None, None, None), ("k: {n}\nbad", "missingColon", 2, 1), ("k: {n}\n\tl: 1", "unexpectedToken", 2, 1), ("k: {n}\nm:\nl: 1", "missingValue", 3, 1), ("k: {n}\nm: | nope", "invalidMultiLineString", 2, 4),
    ("k: {n}\nm: |\n", "invalidMultiLineString", 2, 4), ('k: {n}\nm: "abc', "unterminatedString", 2, 4), ("k: {n}\nl: [1, 2", "missingClosingBracket", 2, 9), ("k: {n}\no: {a: 1", "missingClosingBrace", 2, 9),
    ("k: {n}\n  m: 1", "unexpectedToken", 2, 3), ("k: {n}\nl: [1 2]", "invalidType", None, None), ("k: {n}\nl: [1, 2,]", "trailingComma", None, None), ("k: {n}\nl: [1,, 2]", "missingValue", None, None),
    ("k: {n}\nl: [x]", "invalidType", None, None), ("k: {n}\nl: [3000000000]", "numericOverflow", None, None), ('k: {n}\nm: "\\u12"', "invalidUnicodeEscape", None, None), ("k: {n}\nl: [01]", "leadingZero", None, None), ("k: {n}\nl: [1e]", "invalidExponent", None, None),
]


def yaml_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings broken in each way that has a reason: the reason, its place, and the number read before it."""
    n, text = F.get_json_object("props", "$.k"), F
    for i, (form, *_) in enumerate(BROKEN_YAML):
        head, tail = form.split("{n}")
        text = text.when(F.col("event_id") % len(BROKEN_YAML) == i, F.concat(F.lit(head), n, F.lit(tail)))
    got = yaml_decoded(spread(table(spark, sf_dir, "events"), "event_id").withColumn("t", text), F.col("t"), "k bigint, l array<int>, m string", "d")
    place = [F.col("d.error")[c].cast(t).alias(c) for c, t in (("reason", "string"), ("line", "bigint"), ("col", "bigint"))]
    return got.select("event_id", F.col("d.value.k").alias("k"), *place)


def yaml_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state of each nation as a nested mapping."""
    text = F.concat(F.lit('name: "'), "n_name", F.lit('"\nregion:\n  key: '), "n_regionkey")
    got = yaml_partials(table(spark, sf_dir, "nation").select("n_nationkey", text.alias("t")), "n_nationkey", "t", "name string, region struct<key:bigint>")
    return got.select("n_nationkey", F.col("seq").cast("bigint").alias("seq"), F.col("state.name").alias("name"), F.col("state.region.key").alias("key"), F.col("error.reason").alias("reason"))


def yaml_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as folded scalars, by built-in expressions and through the reader of nested YAML."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"^[ \n]+|\s+\z", "")
    body = F.concat(F.lit("  "), F.regexp_replace(said, "\n", "\n  "))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("b")).where(F.trim("b") != "")
    got = yaml_decoded(rows, F.concat(F.lit("said: >\n"), "b", F.lit("\nend: 1")), "said string, end int", "d")
    return got.select("conv_id", "turn", F.md5(folded_block(F.col("b"))).alias("folded_md5"), F.md5("d.value.said").alias("read_md5"), F.col("d.value.end").cast("bigint").alias("end"))


QUERIES = [json_byte_partials, json_latest, text_chunks, json_chunk_states, stream_chunk_finish, yaml_nested, yaml_errors, yaml_states, yaml_folded, json_errors, json_types, json_syntax, json_nulls, json_nested, json_checked_partials, json_partials, json_partials_by_3, json_chunk_partials, json_number_kinds, json_finish_reasons, json_finish_states, snake_case_keys, yaml_mapping, yaml_sequence, yaml_block_scalars, stream_chunk_partials]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"json_final_props": flagship} | {q.__name__: q for q in QUERIES}


def _states_sql(step: int) -> str:
    return f"""
SELECT event_id, CAST(i AS BIGINT) AS seq,
  TRY_CAST(regexp_extract(substr(props, 1, CAST(least((i + 1) * {step}, length(props)) AS INTEGER)), ':\\s*(-?[0-9]+)', 1) AS BIGINT) AS k
FROM events, unnest(range(CAST(ceil(length(props) / {step}.0) AS BIGINT) + 1)) AS r(i) WHERE props IS NOT NULL"""


_CHUNK_SQL = """
SELECT conv_id, turn, CAST(length(said) AS BIGINT) AS n_chars, md5(said) AS said_md5
FROM (SELECT conv_id, turn, string_agg(coalesce(text, ''), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS said FROM conversations)"""


#: Of BROKEN by place in the list: reason, line, column less the digits of the number (None: no fault), whether k and l are read.
_FAULTS = [
    None, ("missingClosingBrace", 1, 7, 1), ("missingColon", 1, 6, 0), ("missingValue", 1, 13, 1), ("trailingComma", 1, 8, 1), ("missingComma", 1, 17, 1), ("invalidLiteral", 1, 14, 1), ("invalidNumber", 2, 6, 1),
    ("leadingZero", 1, 14, 1), ("invalidExponent", 1, 14, 1), ("invalidType", 1, 7, 0), ("numericOverflow", 1, 7, 0), ("invalidUnicodeEscape", 1, 14, 1), ("invalidType", 1, 14, 1), ("unexpectedToken", 1, 7, 1),
    ("missingClosingBracket", 1, 18, 1), ("unexpectedToken", 1, 19, 1), ("unexpectedToken", 1, 9, 1),
]


def _faults_sql() -> str:
    k = "CAST(json_extract(props, '$.k') AS BIGINT)"
    at = f"event_id % {len(BROKEN)}"
    case = lambda of: "CASE " + " ".join(f"WHEN {at} = {i} THEN {of(i, f)}" for i, f in enumerate(_FAULTS) if f) + " END"
    fixed = (2, 7, 10, 11)  # faults before the number, or on another line
    col = case(lambda i, f: str(f[2]) if i in fixed else f"{f[2]} + length(CAST({k} AS VARCHAR))")
    read = "CASE WHEN " + at + " IN (" + ",".join(str(i) for i, f in enumerate(_FAULTS) if f and not f[3]) + f") THEN NULL ELSE {k} END"
    return f"""
SELECT event_id, {read} AS k, CAST(CASE WHEN {at} = 5 THEN 1 WHEN {at} IN (15, 16) THEN 2 END AS BIGINT) AS n_l, {case(lambda i, f: f"'{f[0]}'")} AS reason,
  CAST({case(lambda i, f: str(f[1]))} AS BIGINT) AS line, CAST({col} AS BIGINT) AS col FROM events"""


def _types_sql() -> str:
    v = "p_size * 6"
    whole = {"int8": 127, "int16": 32767, "uint8": 255, "uint64": 1 << 60, "int128": 1 << 60}
    cols = [f"CASE WHEN {v} <= {m} THEN CAST({v} AS VARCHAR) END AS v_{n}, CASE WHEN {v} > {m} THEN 'numericOverflow' END AS e_{n}" for n, m in whole.items()]
    cols += [f"CAST({v} AS VARCHAR) || '.0' AS v_float, CAST(NULL AS VARCHAR) AS e_float", *[f"CAST(NULL AS VARCHAR) AS v_{n}, 'invalidType' AS e_{n}" for n in ("boolean", "string")]]
    return f"SELECT p_partkey, {', '.join(cols)} FROM part"


def _yaml_faults_sql() -> str:
    at = f"event_id % {len(BROKEN_YAML)}"
    case = lambda j, show: "CASE " + " ".join(f"WHEN {at} = {i} THEN {show(f[j])}" for i, f in enumerate(BROKEN_YAML) if f[j] is not None) + " END"
    return f"""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, {case(1, repr)} AS reason, CAST({case(2, str)} AS BIGINT) AS line, CAST({case(3, str)} AS BIGINT) AS col FROM events"""


def oracle_sql() -> dict[str, str]:
    k = "CAST(json_extract(props, '$.k') AS BIGINT)"
    return {
        "json_byte_partials": """
SELECT n_nationkey, CAST(i AS BIGINT) AS seq, CASE WHEN i < 5 THEN NULL WHEN i < 7 THEN '' WHEN i < 11 + length(n_name) THEN 'é' || substr(n_name, 1, CAST(i - 7 AS INTEGER)) ELSE 'é' || n_name || '😀' END AS v
FROM (SELECT n_nationkey, n_name, unnest(range(length(n_name) + 15)) AS i FROM nation)""",
        "json_latest": "SELECT r_regionkey, r_name || ',' || r_name AS names, 'missingComma' AS reason, CAST(2 * length(r_name) + 9 AS BIGINT) AS col FROM region",
        "text_chunks": """
SELECT doc_id, CAST(i AS BIGINT) AS seq, md5(substr(t, CAST(i * 500 + 1 AS BIGINT), 500)) AS chunk_md5, i = n - 1 AS last
FROM (SELECT doc_id, t, n, unnest(range(n)) AS i FROM (SELECT doc_id, coalesce(text, '') AS t, greatest(1, CAST(ceil(length(coalesce(text, '')) / 500.0) AS BIGINT)) AS n FROM documents))""",
        "json_chunk_states": """
SELECT conv_id, turn, CASE WHEN turn = 0 THEN '0' WHEN turn = 1 THEN '0,1' ELSE '0,1,1' END AS n, CASE WHEN turn >= 2 THEN 'missingComma' END AS reason
FROM conversations""",
        "stream_chunk_finish": """
SELECT conv_id, COUNT(*) AS n_chunks, md5(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS said_md5, CASE WHEN conv_id % 2 = 1 THEN 'unterminatedString' END AS reason
FROM conversations GROUP BY conv_id""",
        "yaml_nested": """
SELECT l_orderkey AS id, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS numbers, CAST(SUM(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS qty,
  CAST(SUM(CASE WHEN l_linestatus = 'O' OR l_returnflag = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_open,
  string_agg(DISTINCT 'first ' || l_linestatus || E'\n\nlast', '|' ORDER BY 'first ' || l_linestatus || E'\n\nlast') AS notes, true AS done, '1,2' AS limits, CAST(NULL AS VARCHAR) AS reason
FROM lineitem GROUP BY l_orderkey""",
        "yaml_errors": _yaml_faults_sql(),
        "yaml_states": """
SELECT n_nationkey, CAST(i AS BIGINT) AS seq, CASE WHEN i >= 6 THEN substr(n_name, 1, CAST(i - 6 AS INTEGER)) END AS name,
  CASE WHEN i >= 24 + length(n_name) THEN n_regionkey END AS key, CAST(NULL AS VARCHAR) AS reason
FROM (SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, unnest(range(length(n_name) + 26)) AS i FROM nation)""",
        "yaml_folded": r"""
SELECT conv_id, turn, md5(f) AS folded_md5, md5(f) AS read_md5, CAST(1 AS BIGINT) AS "end"
FROM (SELECT conv_id, turn, replace(replace(regexp_replace(said, '\n{2,}', chr(1), 'g'), E'\n', ' '), chr(1), E'\n\n') AS f
  FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^[ \n]+|\s+$', '', 'g') AS said FROM conversations) WHERE said <> '')""",
        "json_errors": _faults_sql(),
        "json_types": _types_sql(),
        "json_syntax": "SELECT o_orderkey, o_orderkey AS key, o_custkey AS cust, CAST(0.5 AS DOUBLE) AS half, true AS is_nan, 'it''s \"' AS status, CAST(2 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS reason FROM orders",
        "json_nulls": f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN {k} WHEN 2 THEN 0 END AS k, event_id % 3 = 1 AS was_null FROM events",
        "json_nested": """
SELECT l_orderkey AS id, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS numbers, CAST(SUM(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS qty,
  CAST(SUM(CASE WHEN l_linestatus = 'O' THEN CAST(trunc(l_quantity) AS BIGINT) ELSE 0 END) AS BIGINT) AS open_qty, CAST(NULL AS VARCHAR) AS reason FROM lineitem GROUP BY l_orderkey""",
        "json_checked_partials": """
SELECT n_nationkey, CAST(i AS BIGINT) AS seq, CASE WHEN i < 8 THEN 'none' ELSE substr(n_name, 1, CAST(i - 8 AS INTEGER)) END AS name,
  CAST(CASE WHEN i < 8 THEN -1 WHEN i >= 20 + length(n_name) THEN n_regionkey END AS BIGINT) AS region,
  CASE WHEN i >= 22 + length(n_name) THEN 'missingComma' END AS reason
FROM nation, unnest(range(CAST(length(n_name) + 25 AS BIGINT))) AS r(i)""",
        "json_final_props": f"SELECT event_type, CAST(SUM({k}) AS BIGINT) AS sum_k, COUNT(*) AS n FROM events GROUP BY event_type",
        "json_partials": _states_sql(1),
        "json_partials_by_3": _states_sql(3),
        "json_chunk_partials": _CHUNK_SQL,
        "stream_chunk_partials": _CHUNK_SQL,
        "json_number_kinds": f"""
SELECT event_id, CASE WHEN {k} BETWEEN -128 AND 127 THEN {k} END AS k8,
  CASE WHEN {k} NOT BETWEEN -128 AND 127 THEN 'numericOverflow' END AS k8_reason,
  CASE WHEN {k} >= 18 THEN 'numericOverflow' END AS d_reason FROM events""",
        "json_finish_reasons": """
SELECT event_id, CASE WHEN event_id % 9 IN (2, 3) THEN 'unterminatedString'
  WHEN event_id % 9 > 0 AND NOT contains(substr(props, 1, CAST(event_id % 9 AS INTEGER)), '}') THEN 'missingClosingBrace' END AS reason FROM events""",
        "json_finish_states": r"""
SELECT event_id, n_read, CASE WHEN contains(rest, '"') THEN 'unterminatedString'
  WHEN length(replace(rest, ']', '')) > length(replace(rest, '[', '')) THEN 'missingClosingBracket'
  WHEN length(replace(rest, '}', '')) > length(replace(rest, '{', '')) THEN 'missingClosingBrace' END AS reason
FROM (SELECT event_id, CAST(i AS BIGINT) AS n_read,
  regexp_replace(regexp_replace(substr(props, 1, CAST(i AS INTEGER)), '\\.', '', 'gs'), '"[^"]*"', '', 'g') AS rest
  FROM events, unnest(range(CAST(length(props) AS BIGINT) + 1)) AS r(i) WHERE props IS NOT NULL)""",
        "snake_case_keys": """
SELECT p_partkey, CASE WHEN strpos(p_type, ' ') = 0 THEN '_' || lower(p_type) || '__' ELSE '_' || list_reduce(
  list_transform(string_split(lower(p_type), ' '), lambda w, i: CASE WHEN i = 1 THEN w ELSE upper(w[1]) || w[2:] END), lambda a, b: a || b) || '__' END AS key FROM part""",
        "yaml_mapping": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders",
        "yaml_sequence": "SELECT l_orderkey, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey",
        "yaml_block_scalars": r"""
SELECT conv_id, turn, md5(said) AS literal_md5,
  CAST(length(regexp_replace(said, '\n{2,}', E'\n\n', 'g')) AS BIGINT) AS n_folded
FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^[ \n]+|\n+$', '', 'g') AS said FROM conversations)""",
    }
