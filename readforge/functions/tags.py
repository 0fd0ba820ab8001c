"""Column functions on a record's tags: an array of structs (key, typ, value as text), in order, with repeats allowed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE_MASK = 0xC1
KIND = "array<struct<key:string,typ:string,value:string>>"


def tag(key: str, typ: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit(typ).alias("typ"), value.cast("string").alias("value"))


def _first(tags: Column, key: str) -> Column:
    return F.try_element_at(F.filter(tags, lambda t: t["key"] == key), F.lit(1))


def as_int(tags: Column, key: str, default: int = 0) -> Column:
    """Value of the first tag of that key if it is a whole number, else the default."""
    t = _first(tags, key)
    return F.when(t["typ"] == "i", t["value"].try_cast("bigint")).otherwise(F.lit(default).cast("bigint"))


def as_string(tags: Column, key: str) -> Column:
    """Text of the first tag of that key if it is text, a letter or hex, else empty."""
    t = _first(tags, key)
    return F.when(t["typ"].isin("Z", "A", "H"), t["value"]).otherwise(F.lit(""))


def md_text(tags: Column) -> Column:
    """MD text of the first MD tag, whether it was stored as text or as a letter; null without one."""
    t = _first(tags, "MD")
    return F.when(t["typ"].isin("Z", "A"), t["value"])


def delete(tags: Column, key: str) -> Column:
    return F.filter(tags, lambda t: t["key"] != key)


def insert(tags: Column, new: Column) -> Column:
    """new before the others, which stay."""
    return F.concat(F.array(new), tags)


def update(tags: Column, key: str, new: Column) -> Column:
    return insert(delete(tags, key), new)


def adjust(tags: Column, key: str, change) -> Column:
    """change(value) in place of the value of the first tag of that key."""
    at = F.array_position(F.transform(tags, lambda t: t["key"]), key)
    return F.transform(tags, lambda t, i: F.when(i + 1 == at, F.struct(t["key"].alias("key"), t["typ"].alias("typ"), change(t["value"]).alias("value"))).otherwise(t))


def mark_quality(tags: Column, letter: str) -> Column:
    """The letter put before the text of ZQ, unless it is there."""
    old = as_string(tags, "ZQ")
    return F.when(F.contains(old, F.lit(letter)), tags).otherwise(update(tags, "ZQ", tag("ZQ", "Z", F.concat(F.lit(letter), old))))


def filtered(flag: Column, tags: Column, passes: Column, letter: str) -> tuple[Column, Column]:
    """(flag, tags) of a quality filter: a record that does not pass is kept, with 0x200 set and the letter in ZQ."""
    return F.when(passes, flag).otherwise(flag.bitwiseOR(F.lit(0x200))), F.when(passes, tags).otherwise(mark_quality(tags, letter))


def repaired_flags(flag: Column, tags: Column) -> tuple[Column, Column]:
    """(flag, tags) without abused flag bits: 0x800 and 0x1000 become marks Q and C in ZQ; mate bits of unpaired records
    become merged and trimmed in FF, which takes the place of a numeric XF."""
    base = flag.bitwiseAND(F.lit(0xFFFF ^ 0x1800))
    kind = base.bitwiseAND(F.lit(TYPE_MASK))
    new = F.when(kind == 0xC0, 2).when(kind == 0x80, 1).otherwise(0)
    ff, xf = _first(tags, "FF"), _first(tags, "XF")
    number = lambda t: t["value"].try_cast("bigint").bitwiseOR(new)
    out = F.when(ff["typ"] == "i", update(tags, "FF", tag("FF", "i", number(ff)))).when(xf["typ"] == "i", update(delete(tags, "XF"), "FF", tag("FF", "i", number(xf)))).when(new != 0, update(tags, "FF", tag("FF", "i", new))).otherwise(tags)
    out = F.when(flag.bitwiseAND(F.lit(0x1000)) != 0, mark_quality(out, "C")).otherwise(out)
    out = F.when(flag.bitwiseAND(F.lit(0x800)) != 0, mark_quality(out, "Q")).otherwise(out)
    return F.when(base.bitwiseAND(F.lit(1)) == 0, base.bitwiseAND(F.lit(0xFFFF ^ 0xC0))).otherwise(base), out


def fragment_type(flag: Column, ff: Column, old_merger: bool = False) -> Column:
    """leading, trailing or complete: which ends of the molecule a read shows.  old_merger: the file was made by a program
    whose merged reads have no marks."""
    bit = lambda k: flag.bitwiseAND(F.lit(k)) != 0
    whole = bit(0xC0) | (F.coalesce(ff, F.lit(0)).bitwiseAND(F.lit(3)) != 0) | F.lit(old_merger)
    return F.when(bit(1) & bit(0x40), "leading").when(bit(1) & bit(0x80), "trailing").when(whole, "complete").otherwise("leading")
