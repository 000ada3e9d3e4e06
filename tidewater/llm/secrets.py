"""Secret scans in built-in functions only: three fixed kinds, and a battery of randomness tests for other long tokens.

Every token of 20 or more key characters is read in the smallest encoding that holds it (hex, 26 or 52 letters, base 36,
base 64).  Chi-squared uniformity over that alphabet, a runs test about its middle and the lag-one serial correlation give
one statistic that random keys seldom exceed.  Its p-value as ordinary text comes from the index of coincidence, whose
spread shrinks with the length; tokens of a document are then accepted under Benjamini and Hochberg's false-discovery rule.

Defined results: null and empty text have no spans; text of any length is scanned whole; each row is judged by itself, so
repeated rows repeat their result; columns of the names made here are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.arrays import running_max, running_sum

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LONG = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Chance of a pair of equal letters in ordinary text, and of one letter of it being a hex digit.
COINCIDENCE, HEX_LETTER = 0.066, 0.35
FALSE_DISCOVERIES, RANDOM_LEVEL = 0.01, 0.001
SPAN = "array<struct<start:int,kind:int,end:int>>"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {"hex": DIGITS + "abcdef", "a26": LOWER, "a52": UPPER + LOWER, "b36": DIGITS + LOWER, "b64": UPPER + LOWER + DIGITS + "+/_-"}


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str, kind: int, judged: int = 0) -> Column:
    """Spans in code points with the string that decides: of the whole match, or of group ``judged``."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,word:string>>")

    def placed(x: Column) -> Column:
        # where each match ends: the lengths of all gaps and matches up to it
        long = F.transform(x["all"], lambda m: F.length(m))
        ends = running_sum(F.zip_with(F.transform(F.slice(x["gap"], F.lit(1), F.size(x["all"])), lambda g: F.length(g)), long, lambda g, m: g + m))
        return _once(F.struct(ends.alias("end"), long.alias("long")), lambda e: F.transform(x["word"], lambda w, i: F.struct((F.get(e["end"], i) - F.get(e["long"], i)).alias("start"), F.lit(kind).alias("kind"), F.get(e["end"], i).alias("end"), w.alias("word"))))

    found = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(judged)).alias("word"))
    return F.when(text.rlike(pattern), _once(found, placed)).otherwise(none)


def _battery(word: Column) -> Column:
    """struct(ordinary, random): the token's p-value as ordinary text, and as random symbols."""

    def judged(k: Column) -> Column:
        a = F.length(k["symbols"]).cast("double")

        def tests(v: Column) -> Column:
            n = F.size(v).cast("double")
            mid = (a - 1) / 2

            # A lambda would take the mean again for each symbol if it were not a value of its own.
            def sums(mean: Column) -> Column:
                idx = F.sequence(F.lit(1), F.size(v) - 1)
                squares = F.aggregate(F.transform(F.array_distinct(v), lambda s: F.size(F.filter(v, lambda y: y == s)).cast("double")), F.lit(0.0), lambda t, c: t + c * c)
                high = F.size(F.filter(v, lambda y: y > mid)).cast("double")
                runs = 1.0 + F.size(F.filter(idx, lambda i: (F.element_at(v, i) > mid) != (F.element_at(v, i + 1) > mid)))
                var = F.aggregate(v, F.lit(0.0), lambda t, y: t + (y - mean) * (y - mean))
                lag = F.aggregate(idx, F.lit(0.0), lambda t, i: t + (F.element_at(v, i) - mean) * (F.element_at(v, i + 1) - mean))
                letters = F.size(F.filter(v, lambda y: y >= 10.0)).cast("double")
                return F.struct(squares.alias("squares"), high.alias("high"), runs.alias("runs"), var.alias("var"), lag.alias("lag"), letters.alias("letters"))

            def chances(m: Column) -> Column:
                mean_runs = 2 * m["high"] * (n - m["high"]) / n + 1
                var_runs = F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(0.25))
                z_chi = F.greatest((m["squares"] * a / n - n - (a - 1)) / F.sqrt(2 * (a - 1)), F.lit(0.0))
                z_runs = (m["runs"] - mean_runs) / F.sqrt(var_runs)
                z_lag = F.when(m["var"] > 0, m["lag"] / m["var"] * F.sqrt(n)).otherwise(F.lit(9.0))
                chi3 = z_chi * z_chi + z_runs * z_runs + z_lag * z_lag
                z = (F.cbrt(chi3 / 3) - (1 - 2 / 27)) / (2 / 27) ** 0.5  # Wilson and Hilferty
                same = (m["squares"] - n) / (n * (n - 1))
                spread = F.sqrt(2 * COINCIDENCE * (1 - COINCIDENCE) / (n * (n - 1)))
                tail = lambda z: 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(300.0))))
                ordinary = F.when(a == len(ALPHABETS["hex"]), F.pow(F.lit(HEX_LETTER), m["letters"])).otherwise(tail((COINCIDENCE - same) / spread))
                return F.struct(ordinary.alias("ordinary"), tail(z).alias("random"))

            return _once(_once(F.aggregate(v, F.lit(0.0), lambda t, y: t + y) / n, sums), chances)

        return _once(F.transform(F.split(k["read"], ""), lambda c: (F.call_function("position", c, k["symbols"]) - 1).cast("double")), tests)

    read_in = lambda code, read: F.struct(F.lit(ALPHABETS[code]).alias("symbols"), read.alias("read"))
    small = [("^(?:[0-9a-f]+|[0-9A-F]+)$", "hex"), ("^(?:[a-z]+|[A-Z]+)$", "a26"), ("^[A-Za-z]+$", "a52"), ("^(?:[0-9a-z]+|[0-9A-Z]+)$", "b36")]
    kind = F
    for pattern, code in small:
        kind = kind.when(word.rlike(pattern), read_in(code, word if code == "a52" else F.lower(word)))
    return _once(kind.otherwise(read_in("b64", word)), judged)


def _random(found: Column) -> Column:
    """Of long tokens' spans those that pass the battery under the false-discovery rule."""

    def chosen(all_: Column) -> Column:
        ranked = F.array_sort(F.transform(all_, lambda x: x["p"]["ordinary"]))
        line = F.array_max(F.transform(ranked, lambda p, i: F.when(p <= FALSE_DISCOVERIES * (i + 1) / F.size(ranked), p)))
        good = F.filter(all_, lambda x: (x["p"]["ordinary"] <= line) & (x["p"]["random"] >= RANDOM_LEVEL))
        return F.transform(good, lambda x: x["s"])

    judged = F.transform(found, lambda s: F.struct(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")).alias("s"), _battery(s["word"]).alias("p")))
    return F.when(F.size(found) > 0, _once(judged, chosen)).otherwise(F.array().cast(SPAN))


def _bare(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with base (array of the fixed kinds' spans) and found (these and the random tokens), by start, then kind, each
    under ``prefix``; columns of these names are replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(
        _bare(F.filter(_matches(body, ASSIGN, 0, 2), lambda s: F.length(s["word"]) >= 8)),
        _bare(_matches(body, ACCESS, 1)),
        _bare(_matches(body, HEX, 2)),
    )
    out = docs.withColumn(prefix + "base", F.array_sort(base))
    return out.withColumn(prefix + "found", F.array_sort(F.concat(prefix + "base", _random(_matches(body, LONG, 3)))))


def _joined(spans: str) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def secret_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    out = find_secrets(docs.select(key, text), text)
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return out.select(key, *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mask``; null text stays null."""
    found = find_secrets(docs, text, "_secret_")
    t, spans = F.col(text), F.col("_secret_found")

    def cut(reach: Column) -> Column:
        """The text between the spans; ``reach`` is how far the spans up to each one go."""
        before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
        pieces = F.transform(spans, lambda s, i: F.when(s["start"] < before(i), F.lit("")).otherwise(F.concat(F.substring(t, before(i) + 1, s["start"] - before(i)), F.lit(mask))))
        return F.concat(F.array_join(pieces, ""), F.substring(t, F.get(reach, F.size(reach) - 1) + 1, F.length(t)))

    out = _once(running_max(F.transform(spans, lambda s: s["end"])), cut)
    return found.withColumn(text, F.when(F.size(spans) > 0, out).otherwise(t)).drop("_secret_base", "_secret_found")
