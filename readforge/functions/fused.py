"""CIGAR and MD text as one list of operations, and back.

An operation is a struct (op, n, base): M are n bases equal to the reference, R is one that differs and D is one deleted,
both with the reference's base; the others are those of the CIGAR.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import reads as R
from . import sequences as S

KIND = "ops array<struct<op:string,n:bigint,base:string>>, known boolean"
_CIGAR, _MD = re.compile(r"(\d+)([MIDNSHP=X])"), re.compile(r"(\d+)|\^([^0-9^]*)|([^0-9^])")


def _fuse(cigar: str | None, md: str | None, untold: str | None = None) -> tuple[list[tuple[str, int, str | None]], bool]:
    # what MD says of each stretch of reference, the next one last
    told = []
    for number, cut, base in _MD.findall(md or ""):
        told += [["M", int(number), None]] if number else [["R", 1, base]] if base else [["D", 1, c] for c in cut]
    told = [x for x in reversed(told) if x[1]]
    out, known = [], md is not None
    for number, op in _CIGAR.findall(cigar or ""):
        n = int(number)
        if op not in "M=XD":
            if n:
                out.append((op, n, None))
            continue
        while n and known and told and (told[-1][0] == "D") == (op == "D"):
            kind, many, base = told[-1]
            k = min(n, many)
            out.append((kind, k, base))
            n, told[-1][1] = n - k, many - k
            if not told[-1][1]:
                told.pop()
        if n:
            known = False
            out += [("D", 1, "N")] * n if op == "D" else [("M", n, untold)]
    return out, known and not told


def fuse(cigar: Column, md: Column) -> Column:
    """Struct (ops, known): known is whether MD text is there and says as much as the CIGAR; from the first place where it
    does not, bases count as equal and deleted ones as N.  Operations of no length go; null CIGARs have none."""

    @F.pandas_udf(KIND)
    def run(c: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([([{"op": o, "n": n, "base": b} for o, n, b in ops], known) for ops, known in map(_fuse, c, m)], columns=["ops", "known"])

    return run(cigar, md)


RUNS = "array<struct<q:int,r:bigint,n:int,ref:string,on:boolean,del:string,ins:array<struct<q:int,n:int>>>>"


def _runs(cigar: str | None, md: str | None) -> list[dict]:
    out: list[dict] = []
    q = r = 0
    cut, put, on = "", [], False
    for op, n, base in _fuse(cigar, md, untold="N")[0]:
        if op in "MR":
            if out and on:
                out[-1] |= {"on": True, "del": cut, "ins": put}
            out.append({"q": q, "r": r, "n": n, "ref": base, "on": False, "del": "", "ins": []})
            cut, put, on = "", [], True
        elif op == "D":
            cut += base
        elif op == "I":
            put.append({"q": q, "n": n})
        elif op == "N":  # what stands beside a gap is lost
            on = False
        q += n if op in "MRIS" else 0
        r += n if op in "MRDN" else 0
    return out


def runs(cigar: Column, md: Column) -> Column:
    """Array of structs (q, r, n, ref, on, del, ins): runs of aligned bases, by their offsets in the read and from its place.

    ref is the reference's base where it differs, N where MD says nothing, and null where it is that of the read.  on: whether
    the read goes on behind the run without a gap (N); then del are the reference's bases deleted there and ins the offsets
    and lengths of what is inserted.
    """

    @F.pandas_udf(RUNS)
    def run(c: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(list(map(_runs, c, m)), dtype=object)

    return run(cigar, md)


def cigar_of(fused: Column) -> Column:
    """CIGAR text; neighbouring operations of one kind are joined."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("op"), F.lit(0).cast("bigint").alias("n"))
    text = lambda a: F.concat(a["out"], F.when(a["n"] > 0, F.concat(a["n"].cast("string"), a["op"])).otherwise(""))

    def step(a, x):
        op = F.when(x["op"] == "R", "M").otherwise(x["op"])
        same = (op == a["op"]) & op.isin("M", "D", "S")
        return F.struct(F.when(same, a["out"]).otherwise(text(a)).alias("out"), op.alias("op"), (F.when(same, a["n"]).otherwise(0) + x["n"]).cast("bigint").alias("n"))

    return F.aggregate(fused["ops"], start, step, text)


def md_of(fused: Column) -> Column:
    """MD text in normal form; null where it is not known."""
    kind = lambda x: F.when(x["op"] == "M", "num").when(x["op"] == "R", "rep").otherwise("del")
    ops = F.transform(F.filter(fused["ops"], lambda x: x["op"].isin("M", "R", "D")), lambda x: F.struct(kind(x).alias("kind"), F.when(x["op"] == "M", x["n"]).alias("n"), x["base"].alias("bases")))
    return F.when(fused["known"], S.md_text(ops))


_OPS = "array<struct<op:string,n:bigint,base:string>>"


def _op(op, n: Column) -> Column:
    return F.struct((F.lit(op) if isinstance(op, str) else op).alias("op"), n.cast("bigint").alias("n"), F.lit(None).cast("string").alias("base"))


def _some(*ops: Column) -> Column:
    return F.filter(F.array(*ops), lambda x: x["n"] > 0).cast(_OPS)


def split_at(fused: Column, at: Column) -> tuple[Column, Column]:
    """Two fused lists of the same read: that of its part before the reference offset `at` and that of the rest.

    Read bases of the other part become soft clips in each.  Insertions at the split belong to the rest.
    """
    none = F.array().cast(_OPS)
    start = F.struct(at.cast("bigint").alias("left"), none.alias("a"), none.alias("b"))

    def step(s, x):
        left, op, n = s["left"], x["op"], x["n"]
        k = F.least(left, n)
        own, clip = F.array(x).cast(_OPS), _some(_op("S", n))
        reads = op.isin("M", "R", "I", "S")
        open_ = left > 0
        a = F.when(~open_, F.when(reads, clip).otherwise(none)).when(op == "M", _some(_op("M", k), _op("S", n - k))).when(op == "N", _some(_op("N", k))).otherwise(own)
        b = F.when(~open_, own).when(op == "M", _some(_op("S", k), _op("M", n - k))).when(op == "N", _some(_op("N", n - k)))
        b = b.when(op.isin("S", "H"), own).when(op.isin("I", "R"), clip).otherwise(none)
        gone = F.when(op.isin("M", "R", "D", "N"), F.greatest(F.least(left, n), F.lit(0))).otherwise(0)
        return F.struct((left - gone).alias("left"), F.concat(s["a"], a).alias("a"), F.concat(s["b"], b).alias("b"))

    done = F.aggregate(fused["ops"], start, step)
    both = lambda c: F.struct(done[c].alias("ops"), fused["known"].alias("known"))
    return both("a"), both("b")


def _taken(ops: Column, n: Column) -> Column:
    """The operations up to the n-th base of the read; deletions behind it go."""
    start = F.struct(n.cast("bigint").alias("left"), F.array().cast(_OPS).alias("out"))

    def step(s, x):
        reads = x["op"].isin("M", "R", "I", "S")
        k = F.when(reads, F.least(s["left"], x["n"])).otherwise(x["n"])
        own = F.array(F.struct(x["op"].alias("op"), k.cast("bigint").alias("n"), x["base"].alias("base"))).cast(_OPS)
        return F.struct((s["left"] - F.when(reads, k).otherwise(0)).alias("left"), F.when(s["left"] > 0, F.concat(s["out"], own)).otherwise(s["out"]).alias("out"))

    return F.aggregate(ops, start, step, lambda s: s["out"])


def cut(fused: Column, n: Column, back: bool) -> Column:
    """The fused list without the last (or first) n bases of the read."""
    ops = fused["ops"] if back else F.reverse(fused["ops"])
    total = F.aggregate(F.filter(ops, lambda x: x["op"].isin("M", "R", "I", "S")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    kept = _taken(ops, F.greatest(total - n, F.lit(0)))
    return F.struct((kept if back else F.reverse(kept)).alias("ops"), fused["known"].alias("known"))


def aligned(fused: Column, seq: Column) -> Column:
    """Struct (ref, read) of two texts of one length, a letter for each base of the read and each hard-clipped one (N in the
    read); the reference has a dash where the read is inserted or clipped.  Null where MD does not fit the CIGAR."""
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("").alias("ref"), F.lit("").alias("read"))

    def step(s, x):
        n = x["n"].cast("int")
        own = F.substring(seq, s["at"].cast("int"), n)
        ref = F.when(x["op"] == "M", own).when(x["op"] == "R", x["base"]).when(x["op"].isin("I", "S", "H"), F.repeat(F.lit("-"), n)).otherwise("")
        read = F.when(x["op"].isin("M", "R", "I", "S"), own).when(x["op"] == "H", F.repeat(F.lit("N"), n)).otherwise("")
        return F.struct((s["at"] + F.when(x["op"].isin("M", "R", "I", "S"), x["n"]).otherwise(0)).alias("at"), F.concat(s["ref"], ref).alias("ref"), F.concat(s["read"], read).alias("read"))

    return F.when(fused["known"], F.aggregate(fused["ops"], start, step, lambda s: F.struct(s["ref"].alias("ref"), s["read"].alias("read"))))


def aligned_to(seq: Column, cigar: Column, ref: Column) -> Column:
    """As `aligned`, from the bases of the reference that the read covers (D and N included)."""
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit(1).cast("bigint").alias("to"), F.lit("").alias("ref"), F.lit("").alias("read"))

    def step(s, x):
        op, n = x["op"], x["len"].cast("int")
        own = F.substring(seq, s["at"].cast("int"), n)
        base = F.when(op == "M", F.substring(ref, s["to"].cast("int"), n)).when(op.isin("I", "S", "H"), F.repeat(F.lit("-"), n)).otherwise("")
        read = F.when(op.isin("M", "I", "S"), own).when(op == "H", F.repeat(F.lit("N"), n)).otherwise("")
        return F.struct(
            (s["at"] + F.when(op.isin("M", "I", "S"), x["len"]).otherwise(0)).alias("at"), (s["to"] + F.when(op.isin("M", "D", "N"), x["len"]).otherwise(0)).alias("to"),
            F.concat(s["ref"], base).alias("ref"), F.concat(s["read"], read).alias("read"),
        )

    return F.aggregate(R.cigar_ops(cigar), start, step, lambda s: F.struct(s["ref"].alias("ref"), s["read"].alias("read")))


def rebuilt_md(cigar: Column, md: Column, old: Column, new: Column) -> Column:
    """MD text for the bases `new` that replace `old` in a record with this CIGAR and MD; null where MD does not fit the
    CIGAR, or the bases are not as many as it reads."""

    def one(c, m, before, after) -> str | None:
        ops, known = _fuse(c, m)
        at, out = 0, []
        if not known or before is None or after is None:
            return None
        for op, n, base in ops:
            if op == "D":
                out.append(("del", None, base))
            elif op in "MR":
                for was, now in zip((base or "") if op == "R" else before[at : at + n], after[at : at + n]):
                    out.append(("num", 1, None) if was == now else ("rep", None, was))
            at += n if op in "MRIS" else 0
        return None if not at == len(before) == len(after) else _text(out)

    @F.pandas_udf("string")
    def run(c: pd.Series, m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(c, m, a, b)], dtype=object)

    return run(cigar, md, old, new)


def _text(ops) -> str:
    """The normal form of MD text: numbers joined, deletions joined, 0 only between a deletion and a base."""
    out, n, last = [], 0, ""
    for kind, many, base in ops:
        if kind == "num":
            n += many
            continue
        if n:
            out.append(str(n))
            n, last = 0, "num"
        if kind == "rep":
            out.append(("0" if last == "del" else "") + base)
        else:
            out.append(base if last == "del" else "^" + base)
        last = kind
    return "".join(out) + (str(n) if n else "")
