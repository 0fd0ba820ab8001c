"""Column functions on read records: flags, bases, qualities, positions, CIGAR strings and names.

Missing values are sentinels, as in the file formats: reference 4294967295, position -1, mapping quality 255.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flag bits of the alignment format, and of the FF tag.
FLAGS = {"paired": 0x1, "proper": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reversed": 0x10, "mate_reversed": 0x20, "first_mate": 0x40, "second_mate": 0x80, "auxiliary": 0x100, "fails_qc": 0x200, "duplicate": 0x400}
EXT_FLAGS = {"trimmed": 1, "merged": 2, "alternative": 4, "exact_index": 8}
INVALID_REF, INVALID_POS, UNKNOWN_MAPQ = 4294967295, -1, 255
#: The sixteen base codes in the order of their numbers, and complements.
CODES = "-ACMGRSVTWYHKDBN"
BASES, COMPLEMENTS = "ACMGRSVTWYHKDBN", "TGKCYSBAWRDMHVN"


def has_flag(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(FLAGS[name])) != 0


def has_ext_flag(ff: Column, name: str) -> Column:
    return F.coalesce(ff, F.lit(0)).bitwiseAND(F.lit(EXT_FLAGS[name])) != 0


def valid_ref(ref: Column) -> Column:
    return ref != F.lit(INVALID_REF)


def cigar_ops(cigar: Column) -> Column:
    """Array of structs (len, op) from CIGAR text; = and X, which tell equal bases from others, are M."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.substring(x, 1, F.length(x) - 1).cast("bigint").alias("len"), F.translate(F.right(x, F.lit(1)), "=X", "MM").alias("op")))


def aligned_length(cigar: Column) -> Column:
    """Reference bases covered: lengths of M, D and N."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["op"].isin("M", "D", "N")), F.lit(0).cast("bigint"), lambda a, x: a + x["len"])


def distinct_bin(pos: Column, length: Column) -> Column:
    """Smallest bin of the 14/17/20/23/26-bit scheme that holds [pos, pos + length)."""
    end = pos + length - 1
    out = F.lit(0).cast("bigint")
    for bits, base in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(pos, bits) == F.shiftright(end, bits), F.shiftright(pos, bits) + base).otherwise(out)
    return out


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def base_code(base: Column) -> Column:
    """Four-bit code of a base letter of either case; U is T, a point is a gap, and what is no base letter is N (15)."""
    at = F.instr(F.lit(CODES), F.translate(base, CODES[1:].lower() + "uU.", CODES[1:] + "TT-"))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(F.lit(15))


def two_bit_code(base: Column) -> Column:
    """Two-bit code of a base letter of either case, 0 to 3 for A, C, G and T; what is none of these counts as A."""
    at = F.instr(F.lit("ACGT"), F.translate(base, "acgt", "ACGT"))
    return F.when((F.length(base) == 1) & (at > 0), at - 1).otherwise(F.lit(0))


def wide_code(two_bits: Column) -> Column:
    """Four-bit code of a two-bit one, of which only the low two bits count."""
    return F.element_at(F.array(*[F.lit(1 << i) for i in range(4)]), two_bits.bitwiseAND(F.lit(3)).cast("int") + 1)


def count_base(seq: Column, base: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))).cast("bigint")


def simple_complexity(seq: Column, rate: float) -> Column:
    """Passes unless one base makes up more than `rate` of all bases."""
    n = [count_base(seq, b) for b in "ACGT"]
    return F.greatest(*n) <= F.floor(F.lit(rate) * (n[0] + n[1] + n[2] + n[3]))


def entropy(seq: Column) -> Column:
    """Sum over the bases of count * log2(total / count); the total has other letters too."""
    total = F.length(seq)
    out = F.lit(0.0)
    for b in "ACGT":
        n = count_base(seq, b)
        out = out + F.when(n > 0, n * F.log2(total / n)).otherwise(F.lit(0.0))
    return out


def quality_sum(qual: Column) -> Column:
    return F.aggregate(qual, F.lit(0).cast("bigint"), lambda a, q: a + q)


def quality_average(qual: Column, least: int) -> Column:
    """Passes if the mean quality is at least so high; empty qualities pass."""
    return quality_sum(qual) >= F.lit(least) * F.size(qual)


def quality_minimum(qual: Column, most: int, least: int) -> Column:
    """Passes if at most `most` qualities are under `least`."""
    return F.size(F.filter(qual, lambda q: q < least)) <= most


def old_illumina_quality(q: Column) -> Column:
    """Solexa-scaled quality at offset 31 → Phred, rounded half to even."""
    s = F.pow(F.lit(10.0), -(q - 31) / 10.0)
    return F.bround(F.lit(-10.0) * F.log10(s / (1 + s)), 0).cast("bigint")


def new_illumina_quality(q: Column) -> Column:
    """Offset 31 removed, as bytes do: modulo 256."""
    return F.pmod(q - 31, F.lit(256))


def phred(p: Column) -> Column:
    return F.bround(F.lit(-10.0) * F.log10(p), 0).cast("bigint")


def error_rate(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def repaired_flag(flag: Column) -> Column:
    """Mate flags of unpaired records taken away; extended bits 0x800 and 0x1000 too."""
    unpaired = flag.bitwiseAND(F.lit(1)) == 0
    mates = flag.bitwiseAND(F.lit(0xC0))
    base = flag.bitwiseAND(F.lit(0xFFFF ^ 0x1800))
    return F.when(unpaired & (mates != 0), base.bitwiseAND(F.lit(0xFFFF ^ 0xC0))).otherwise(base)


def repaired_ff(flag: Column, ff: Column) -> Column:
    """FF with merged set for unpaired records marked as both mates, trimmed for those marked as second."""
    unpaired, mates = flag.bitwiseAND(F.lit(1)) == 0, flag.bitwiseAND(F.lit(0xC0))
    return F.coalesce(ff, F.lit(0)).bitwiseOR(F.when(unpaired & (mates == 0xC0), 2).when(unpaired & (mates == 0x80), 1).otherwise(0))


def mate_fixed_flag(flag: Column, ref: Column, pos: Column, mate_ref: Column, mate_pos: Column) -> Column:
    """Sets mate-unmapped on paired, mapped records that stand exactly on their mate on the same strand; an unmapped side
    clears proper-pair."""
    bit = lambda k: flag.bitwiseAND(F.lit(k)) != 0
    clash = bit(1) & ~bit(4) & (bit(0x10) == bit(0x20)) & (ref == mate_ref) & (pos == mate_pos)
    out = F.when(clash, flag.bitwiseOR(F.lit(8))).otherwise(flag)
    return F.when(out.bitwiseAND(F.lit(0xC)) != 0, out.bitwiseAND(F.lit(0xFFFF ^ 2))).otherwise(out)


def name_key(name: Column) -> Column:
    """Sort key of natural name order: runs of digits by number, of any length, anything else by letter."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D)"), F.lit(1))
    digits = lambda t: t.rlike(r"^\d")
    plain = lambda t: F.ltrim(t, F.lit("0"))
    return F.transform(parts, lambda t: F.struct(F.when(digits(t), F.lit(48)).otherwise(F.ascii(t)).alias("c"), F.when(digits(t), F.length(plain(t))).alias("size"), F.when(digits(t), plain(t)).alias("n")))


def trailing_below(qual: Column, least: int) -> Column:
    """Number of qualities at the end of the read that are all under `least`."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("go"))
    step = lambda a, q: F.struct(F.when(a["go"] & (q < least), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["go"] & (q < least)).alias("go"))
    return F.aggregate(F.reverse(qual), start, step, lambda a: a["n"])


def trailing_while(n: Column, holds) -> Column:
    """Largest k of at most n for which holds(1) to holds(k) are all true; holds takes a column and gives one.  Null is false."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("go"))
    go = lambda a, k: a["go"] & F.coalesce(holds(k), F.lit(False))
    step = lambda a, k: F.struct(F.when(go(a, k), k).otherwise(a["n"]).alias("n"), go(a, k).alias("go"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, step, lambda a: a["n"])).otherwise(0)


def damage_position(i: Column, length: Column) -> Column:
    """Offset from the nearer end: from 0 at the front, negative at the back."""
    return F.when(2 * i <= length, i).otherwise(i - length)


def is_proper_base(base: Column) -> Column:
    return base.isin(*"ACGT")


def is_base(base: Column) -> Column:
    return (F.length(base) == 1) & (F.instr(F.lit(BASES), base) > 0)


def is_gap(base: Column) -> Column:
    return base == "-"
