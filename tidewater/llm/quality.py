"""Quality rules as a short-circuit cascade in built-in functions only.

On a sample of about SAMPLE_ROWS rows each rule's cost is counted, as the steps that its measures take over a row's
characters, lines and words, and the share of rows that it rejects.  All rules, those of the base among them, are nested in
one conditional expression by rejected share per cost, so ``judge`` without measures computes for a row only what the rules
before its rejection need.  The order changes the work and the rule named, never the verdict.

Defined results: null, empty or wordless text has zero in every count and fails the base rule (under 50 words); repeated rows
repeat their result; texts of any length are read whole; columns of the names made here are replaced; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "\t\n\u000b\f\r "
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2_000


def _once(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words inside three-word windows found twice or more: windows are sorted, so equal ones are neighbours.

    They are sorted by a hash first and by their words after it, so the words decide.
    """

    def covered(ranked: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            y = F.get(ranked, i)
            return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

        twice = F.filter(ranked, lambda x, i: same(x, i - 1) | same(x, i + 1))
        places = F.flatten(F.transform(twice, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
        return F.size(F.array_distinct(places))

    def window(a: Column, i: Column) -> Column:
        b, c = F.get(words, i + 1), F.get(words, i + 2)
        return F.struct(F.xxhash64(a, b, c).alias("h"), a.alias("a"), b.alias("b"), c.alias("c"), i.alias("p"))

    named = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), window)
    return _once(F.sort_array(named), covered)


def measures(text: str = "text") -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long), each by itself."""
    body = F.coalesce(F.col(text), F.lit(""))
    seen = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(_words(body)).cast("long"),
        "word_chars": F.length(F.translate(body, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _once(seen, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _once(_words(body), _repeated).cast("long"),
    }


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""
    alone = measures(text)
    # two of them share the words
    both = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"))
    out = docs.withColumn("_counted", _once(_words(F.coalesce(F.col(text), F.lit(""))), both))
    alone |= {"n_words": F.col("_counted.n_words"), "n_repeat_words": F.col("_counted.n_repeat_words")}
    return out.withColumns(alone).drop("_counted")


@dataclass(frozen=True)
class Rule:
    """``rejects``: SQL over the measures; ``test``: the same of columns by measure; ``needs``: the measures that it reads."""

    name: str
    rejects: str
    test: Callable[[Mapping[str, Column]], Column]
    needs: tuple[str, ...]


#: Steps that a measure takes, from a row's characters, lines and words.
STEPS = {
    "n_words": "2 * chars + words", "word_chars": "chars", "n_symbols": "chars", "n_dup_lines": "2 * chars + 4 * lines",
    "n_repeat_words": "2 * chars + words * (8 + 3 * log2(words + 1))",
}
#: A row that one of the base rules rejects fails the base.
BASE = (
    Rule("few_words", "n_words < 50", lambda m: m["n_words"] < 50, ("n_words",)),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"], ("n_words", "n_repeat_words")),
)
RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"], ("n_symbols", "n_words")),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]), ("word_chars", "n_words")),
    Rule("dup_lines", "n_dup_lines > 5 and 10 * n_dup_lines * 8 > n_words * 3", lambda m: (m["n_dup_lines"] > 5) & (80 * m["n_dup_lines"] > 3 * m["n_words"]), ("n_dup_lines", "n_words")),
)


def rated(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + RULES, rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, steps a row) in cascade order, from a random sample of about ``rows`` rows of the whole table."""
    total = docs.count()
    sample = docs.select(F.col(text)).sample(False, min(1.0, rows / max(1, total)), 17)
    size = F.coalesce(F.length(text), F.lit(0))
    sized = measure(sample, text).withColumn("chars", size).withColumn("words", F.col("n_words")).withColumn("lines", F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)))
    got = sized.agg(
        F.count("*").alias("n"), *[F.sum(F.expr(r.rejects).cast("int")).alias(f"hit_{r.name}") for r in rules], *[F.avg(F.expr(steps)).alias(f"cost_{m}") for m, steps in STEPS.items()]
    ).first()
    out = [(r, (got[f"hit_{r.name}"] or 0) / max(1, got["n"]), sum(got[f"cost_{m}"] or 0.0 for m in r.needs)) for r in rules]
    return sorted(out, key=lambda x: -x[1] / max(1.0, x[2]))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, with_measures: bool = True) -> DataFrame:
    """``docs`` with base_failed, kept, and failed_rule (the first rule in cascade order that rejects).

    With the measures as columns, the cascade reads those.  Without, each is computed where the cascade comes to it, and
    base_failed is left out, since a row that another rule rejects isn't asked the base's.
    """
    cascade = F
    alone = {} if with_measures else measures(text)

    def rejected(r: Rule) -> Column:
        if with_measures:
            return r.test({m: F.col(m) for m in r.needs})
        # the rule's own measures as a struct, made only when this rule is asked
        return _once(F.struct(*[alone[m].alias(m) for m in r.needs]), r.test)

    for r, _, _ in rated(docs, text, BASE + tuple(rules)):
        cascade = cascade.when(rejected(r), F.lit(r.name))
    if not with_measures:
        return docs.withColumn("failed_rule", cascade).withColumn("kept", F.col("failed_rule").isNull())
    base = F.expr(" or ".join(f"({r.rejects})" for r in BASE))
    return measure(docs, text).withColumn("base_failed", base).withColumn("failed_rule", cascade).withColumn("kept", F.col("failed_rule").isNull())


def judged_sql() -> str:
    """The same for DuckDB, over the table documents."""
    blank = r"[\x20\x09-\x0D]"
    base = " or ".join(f"({r.rejects})" for r in BASE)
    rules = " or ".join(f"({r.rejects})" for r in (*BASE, *RULES))
    return f"""
with w as (
  select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}+'), lambda x: x <> '') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
  from documents),
pos as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) as i from w),
win as (select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from pos),
twice as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from win),
rep as (select doc_id, count(distinct i + d) as n from twice, (values (0), (1), (2)) as v(d) where twice.n > 1 group by doc_id),
m as (
  select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(t, '{blank}', '', 'g')) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words
  from w left join rep on rep.doc_id = w.doc_id)
select *, ({base}) as base_failed, not ({rules}) as kept from m"""
