"""Key and number functions of the decoders, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and greatest value of each integer kind.
INTEGER_RANGES = {
    f"{sign}int{bits}": ((0, 2**bits - 1) if sign else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)) for sign in ("", "u") for bits in (8, 16, 32, 64)
}


def capitalize(word: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.length(word))))


def camel_key(key: Column) -> Column:
    """snake_case to camelCase; outer underscores stay, and so does a key of a single part.  Null gives null."""
    lead = F.regexp_extract(key, "^_*", 0)
    core = F.regexp_replace(key, "^_+|_+$", "")
    tail = F.when(core == "", F.lit("")).otherwise(F.regexp_extract(key, "_*$", 0))

    def joined(parts: Column) -> Column:
        words = F.concat(F.lower(F.element_at(parts, 1)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), capitalize), ""))
        return F.when(F.size(parts) <= 1, key).otherwise(F.concat(lead, words, tail))

    # as the only element of an array the parts are made once, however often they are named
    parts = F.array(F.filter(F.split(core, "_"), lambda p: p != ""))
    return F.when(F.instr(key, "_") == 0, key).otherwise(F.get(F.transform(parts, joined), F.lit(0)))


def checked_integer(token: Column, kind: str) -> tuple[Column, Column]:
    """(value, reason): numericOverflow where the token is a number outside the kind, or with a fraction or an exponent."""
    low, high = INTEGER_RANGES[kind]
    wide = "decimal(38,0)" if kind == "uint64" else "bigint"  # quicker, and what doesn't fit it is out of range
    number = token.try_cast(wide)
    whole = token.rlike("^-?[0-9]+$")
    fits = whole & number.between(F.lit(str(low)).cast(wide), F.lit(str(high)).cast(wide))
    target = "decimal(20,0)" if kind == "uint64" else "bigint"
    reason = F.when(token.isNull() | F.coalesce(fits, F.lit(False)), None).when(token.rlike("^-?[0-9]"), "numericOverflow").otherwise("invalidType")
    return F.when(fits, number.cast(target)), reason


def checked_double(token: Column) -> tuple[Column, Column]:
    """(value, reason): a number too large for a double is numericOverflow, not infinity."""
    value = token.try_cast("double")
    fits = F.coalesce(F.abs(value) < float("inf"), F.lit(False))
    reason = F.when(token.isNull() | fits, None).when(token.rlike("^-?[0-9]"), "numericOverflow").otherwise("invalidType")
    return F.when(fits, value), reason
