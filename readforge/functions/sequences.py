"""Column functions on MD text, CIGAR trimming, merged mates, and FASTQ text."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import reads as R


def md_ops(md: Column) -> Column:
    """Array of structs (kind, n, bases) from MD text: `num` matches, `rep` a reference base, `del` deleted bases."""
    parts = F.regexp_extract_all(md, F.lit(r"(\d+|\^[^0-9^]*|[^0-9^])"), F.lit(1))
    kind = lambda x: F.when(x.rlike(r"^\d"), "num").when(x.startswith("^"), "del").otherwise("rep")
    return F.transform(parts, lambda x: F.struct(kind(x).alias("kind"), x.try_cast("bigint").alias("n"), F.when(x.startswith("^"), F.substring(x, 2, 1 << 30)).when(~x.rlike(r"^\d"), x).alias("bases")))


def md_text(ops: Column) -> Column:
    """MD text in normal form: neighbouring numbers and deletions are joined, nothing stands for 0, except between a
    deletion and a base."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("last"), F.lit(0).cast("bigint").alias("n"))
    # `n` holds matches that are not written yet; `last` is the kind that was written last
    def step(a, x):
        number = F.when(a["n"] > 0, a["n"].cast("string")).otherwise(F.lit(""))
        empty = (x["kind"] == "del") & (F.coalesce(x["bases"], F.lit("")) == "")
        after_del = (a["last"] == "del") & (a["n"] == 0)
        rep = F.struct(F.concat(a["out"], number, F.when(after_del, "0").otherwise(""), x["bases"]).alias("out"), F.lit("rep").alias("last"), F.lit(0).cast("bigint").alias("n"))
        cut = F.struct(F.concat(a["out"], number, F.when(after_del, "").otherwise("^"), x["bases"]).alias("out"), F.lit("del").alias("last"), F.lit(0).cast("bigint").alias("n"))
        more = F.struct(a["out"].alias("out"), a["last"].alias("last"), (a["n"] + x["n"]).alias("n"))
        return F.when(empty, a).when(x["kind"] == "num", more).when(x["kind"] == "rep", rep).otherwise(cut)

    return F.aggregate(ops, start, step, lambda a: F.concat(a["out"], F.when(a["n"] > 0, a["n"].cast("string")).otherwise("")))


def trimmed_cigar(cigar: Column, n: Column, back: bool) -> tuple[Column, Column]:
    """(CIGAR text, shift of the position) after n bases are cut from the back or the front of the stored read.

    Padding goes, deletions and skips next to the cut go into the shift, an insertion next to it becomes a soft clip.
    """
    ops = F.filter(R.cigar_ops(cigar), lambda x: x["op"] != "P")
    ops = F.reverse(ops) if back else ops
    kind = "array<struct<len:bigint,op:string>>"
    start = F.struct(n.cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("shift"), F.lit(True).alias("edge"), F.array().cast(kind).alias("ops"))

    def step(a, x):
        reads, covers = x["op"].isin("M", "I", "S"), x["op"].isin("M", "D", "N")
        gone = F.when(reads, F.least(a["left"], x["len"])).otherwise(x["len"])
        drops = a["edge"] & (x["op"].isin("D", "N") | (reads & (a["left"] > 0)))
        rest = x["len"] - gone
        left = F.when(reads & a["edge"], a["left"] - gone).otherwise(a["left"])
        shift = a["shift"] + F.when(drops & covers, gone).otherwise(0)
        one = F.struct(F.when(drops, rest).otherwise(x["len"]).alias("len"), F.when(a["edge"] & (x["op"] == "I"), "S").otherwise(x["op"]).alias("op"))
        kept = F.when(drops & (rest == 0), a["ops"]).when(x["op"] == "H", a["ops"]).otherwise(F.concat(a["ops"], F.array(one)))
        return F.struct(left.alias("left"), shift.alias("shift"), (a["edge"] & ((x["op"] == "H") | (drops & (rest == 0)))).alias("edge"), kept.alias("ops"))

    text = lambda o: F.array_join(F.transform(F.reverse(o) if back else o, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    out = F.aggregate(ops, start, step)
    same = n <= 0
    return F.when(same, cigar).otherwise(text(out["ops"])), F.when(same | F.lit(back), F.lit(0).cast("bigint")).otherwise(out["shift"])


def merged(size: Column, seq1: Column, qual1: Column, seq2: Column, qual2: Column, most: int | Column, raw: bool = True) -> Column:
    """Array of structs (base, q) of a molecule of `size` read from both ends.

    Where both mates cover a place and agree, qualities add up to `most`; where not, the better base stays with the
    difference.  Bases that the second mate alone covers stand in the order of the molecule: as they were read if `raw`,
    which is how known files have them, else as their complements, which makes the whole a sequence.
    """
    none = F.lit(None).cast("struct<base:string,q:bigint,raw:string>")
    letters = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    sized = lambda x: F.slice(x, F.lit(1), F.greatest(F.least(size, F.size(x)), F.lit(0)))
    row = lambda x: F.struct(x["base"].alias("base"), x["q"].cast("bigint").alias("q"), x["raw"].alias("raw"))
    one = F.transform(F.arrays_zip(letters(seq1).alias("base"), F.slice(qual1, F.lit(1), F.length(seq1)).alias("q"), letters(seq1).alias("raw")), row)
    two = F.transform(F.arrays_zip(letters(F.translate(seq2, R.BASES, R.COMPLEMENTS)).alias("base"), F.slice(qual2, F.lit(1), F.length(seq2)).alias("q"), letters(seq2).alias("raw")), row)
    two = F.concat(F.array_repeat(none, F.greatest(size - F.length(seq2), F.lit(0)).cast("int")), F.reverse(sized(two)))

    def meet(x, y):
        base = F.when((x["base"] == y["base"]) | (x["q"] > y["q"]), x["base"]).otherwise(y["base"])
        q = F.when(x["base"] == y["base"], F.least(x["q"] + y["q"], F.lit(most) if isinstance(most, int) else most)).otherwise(F.abs(x["q"] - y["q"]))
        alone = F.struct((y["raw"] if raw else y["base"]).alias("base"), y["q"].alias("q"))
        out = F.struct(base.alias("base"), q.cast("bigint").alias("q"))
        return F.when(x.isNotNull() & y.isNotNull(), out).when(x.isNotNull(), F.struct(x["base"].alias("base"), x["q"].alias("q"))).when(y.isNotNull(), alone)

    return F.when(size > 0, F.filter(F.zip_with(sized(one), two, meet), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<base:string,q:bigint>>"))


def record_text(body: Column) -> Column:
    """Struct (qname, description, seq, qual) of a FASTA or FASTQ record without its first mark; sequence and qualities may
    have several lines.  Spaces, dots and dashes are no bases; qualities count from 33 and may be absent."""
    line = F.substring_index(body, "\n", 1)
    rest = F.substring(body, F.length(line) + 2, F.lit(1 << 30))
    head = F.regexp_extract(rest, r"^((?:[A-Za-z.\-]|\s)*)", 1)
    seq = F.regexp_replace(head, r"[\s.\-]", "")
    qual = F.regexp_replace(F.regexp_extract(rest, r"(?s)^(?:[A-Za-z.\-]|\s)*\+[^\n]*\n(.*)$", 1), r"\s", "")
    qual = F.substring(qual, F.lit(1), F.length(seq))
    numbers = F.when(qual == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(qual, ""), lambda c: (F.ascii(c) - 33).cast("bigint")))
    return F.struct(F.regexp_extract(line, r"^(\S*)", 1).alias("qname"), F.regexp_extract(line, r"^\S*\s+(.*)$", 1).alias("description"), seq.alias("seq"), numbers.alias("qual"))


def decoded(data: Column) -> Column:
    """Text of binary data in UTF-8; a byte that fits nowhere is taken as Latin-1 by itself."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(x):
            return None if x is None else bytes(x).decode("utf-8", "as-latin-1")

        codecs.register_error("as-latin-1", lambda e: (e.object[e.start : e.end].decode("latin-1"), e.end))
        return values.map(one)

    return run(data)


def encoded(text: Column) -> Column:
    """UTF-8 bytes of a text."""
    return F.encode(text, "UTF-8")
