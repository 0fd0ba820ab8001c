"""Column functions on names, coordinates, instrument bytes, adapters and damage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import reads as R


def cassava(description: Column, flag: Column) -> Column:
    """Struct (flag, xi) from `mate:filtered:_:index`; other descriptions leave the flag and give no index."""
    f = F.split(F.substring_index(description, " ", 1), ":")
    fits = F.size(f) >= 4
    at = lambda i: F.try_element_at(f, F.lit(i))
    bit = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0))
    kept = flag.bitwiseAND(F.lit(0xFFFF ^ (0x200 | 0x80 | 1)))
    new = kept.bitwiseOR(bit(at(1) == "1", 0x41)).bitwiseOR(bit(at(1) == "2", 0x81)).bitwiseOR(bit(at(2) == "Y", 0x200))
    return F.struct(F.when(fits, new).otherwise(flag).alias("flag"), F.when(fits & at(4).rlike("^[ACGTN]*$"), at(4)).alias("xi"))


def plain_name(name: Column) -> Column:
    """Struct (name, flag, ff, xp, xi, xj): what a name's prefixes, `/1`, `/2` and `#index` say, and the name without them."""
    cut = F.split(name, "#")
    sharp = F.size(cut) == 2
    n, tags = F.when(sharp, cut[0]).otherwise(name), F.when(sharp, F.try_element_at(cut, F.lit(2)))
    comma = F.instr(tags, ",")
    xi = F.when(comma > 0, F.substring(tags, F.lit(1), comma - 1)).otherwise(tags)
    xj = F.when(comma > 0, F.substring(tags, comma + 1, F.length(tags)))
    rest = lambda s: F.substring(s, 3, 1 << 30)
    early = n.startswith("C_")
    n = F.when(early, rest(n)).otherwise(n)
    kind = F.when(n.rlike("^[FRMT]_"), F.substring(n, 1, 1)).when(n.endswith("/1"), "1").when(n.endswith("/2"), "2").otherwise("")
    marked = kind.isin("F", "R", "M", "T")
    inner = F.when(marked, rest(n)).otherwise(n)
    late = marked & inner.startswith("C_")
    out = F.when(late, rest(inner)).when(kind.isin("1", "2"), F.substring(n, F.lit(1), F.length(n) - 2)).otherwise(inner)
    flag = F.when(kind.isin("F", "1"), 0x41).when(kind.isin("R", "2"), 0x81).otherwise(0)
    ff = F.when(kind == "M", 2).when(kind == "T", 1)
    return F.struct(out.alias("name"), flag.alias("flag"), ff.alias("ff"), F.when(early | late, -1).alias("xp"), xi.alias("xi"), xj.alias("xj"))


def reverse_range(start: Column, length: Column) -> Column:
    """The same range on the other strand; positions there are negative."""
    return -start - length


def shift_range(start: Column, length: Column, by: Column) -> tuple[Column, Column]:
    """(start, length) of a range moved along its strand."""
    return start + by, length


def extend_range(start: Column, length: Column, by: Column) -> tuple[Column, Column]:
    """(start, length) of a range that goes on for `by` more."""
    return start, length + by


def inside_range(start: Column, length: Column, outer_start: Column, outer_length: Column) -> tuple[Column, Column]:
    """(start, length) of a range given within another one, clipped at that one's end."""
    n = F.when(start <= outer_length, F.least(length, outer_length - start)).otherwise(F.lit(0))
    off = F.least(start, outer_length)
    ahead = F.when(outer_start < 0, reverse_range(outer_start, outer_length)).otherwise(outer_start) + off
    return F.when(outer_start < 0, reverse_range(ahead, n)).otherwise(ahead), n


def other_hit_is_same(xa: Column, name: Column, size: Column, pos: Column, reversed_: Column) -> Column:
    """Whether the alternative hits are one only, and that the read's own place on a circle of `size` positions."""
    hits = F.split(xa, ";")
    one = (F.size(hits) == 1) | ((F.size(hits) == 2) & (F.try_element_at(hits, F.lit(2)) == ""))
    f = F.split(hits[0], ",")
    text = F.try_element_at(f, F.lit(2))
    at = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    same = F.when(at >= 0, (F.pmod(at - 1, size) == F.pmod(pos, size)) & ~reversed_).otherwise((F.pmod(-at - 1, size) == F.pmod(pos, size)) & reversed_)
    return F.coalesce(one & (f[0] == name) & same, F.lit(False))


def bcl_base(byte: Column) -> Column:
    """Base of an instrument byte: its low two bits; a zero byte is N."""
    return F.when(byte == 0, F.lit("N")).otherwise(F.substring(F.lit("ACGT"), byte.bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)))


def bcl_quality(byte: Column) -> Column:
    return F.shiftright(byte, 2).bitwiseAND(F.lit(63))


def bcl_bases(data: Column, back: bool = False) -> Column:
    """Letters of a cluster's bytes (an array by cycle), or of the other strand's from the last cycle on."""
    text = F.array_join(F.transform(data, bcl_base), "")
    return F.reverse(F.translate(text, R.BASES, R.COMPLEMENTS)) if back else text


def bcl_codes(data: Column) -> Column:
    """Array of four-bit codes of a cluster's bytes; a zero byte is N (15)."""
    return F.transform(data, lambda b: F.when(b == 0, 15).otherwise(R.wide_code(b)))


def bcl_packed(data: Column) -> Column:
    """Four-bit codes two to a byte, the first in the high bits; an odd last one has zeros behind it."""
    digits = F.array_join(F.transform(bcl_codes(data), F.hex), "")
    return F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, "0").otherwise("")))


def bcl_qualities(data: Column, back: bool = False) -> Column:
    """Array of qualities of a cluster's bytes, from the last cycle on if `back`."""
    q = F.transform(data, bcl_quality)
    return F.reverse(q) if back else q


def bcl_quality_text(data: Column, back: bool = False) -> Column:
    return F.array_join(F.transform(bcl_qualities(data, back), lambda q: F.char(q + 33)), "")


def adapter_score(at: Column, seq: Column, qual: Column, adapter: str) -> Column:
    """Penalty of an adapter that starts at `at` in the read: 5 and the quality, 25 at most, for each mismatch."""
    shared = F.least(F.length(seq) - at, F.lit(len(adapter)))
    cost = lambda i: F.when(F.substring(seq, at + i, F.lit(1)) == F.substring(F.lit(adapter), i, F.lit(1)), 0).otherwise(F.least(F.element_at(qual, at + i), F.lit(25)) + 5)
    return F.when(shared > 0, F.aggregate(F.sequence(F.lit(1), shared), F.lit(0).cast("bigint"), lambda a, i: a + cost(i))).otherwise(F.lit(0).cast("bigint"))


def overlap_score(size: Column, seq1: Column, qual1: Column, seq2: Column, qual2: Column) -> Column:
    """Penalty of two mates read from both ends of a molecule of `size`: 5 and the lower quality for each mismatch."""
    n1, n2 = F.length(seq1), F.length(seq2)
    first, last = F.greatest(F.lit(0), size - n2), F.least(size, n2)
    shared = F.least(n1, size) - first
    other = F.translate(seq2, R.BASES, R.COMPLEMENTS)
    cost = lambda i: F.when(F.substring(seq1, first + i, F.lit(1)) == F.substring(other, last - i + 1, F.lit(1)), 0).otherwise(F.least(F.element_at(qual1, first + i), F.element_at(qual2, last - i + 1)) + 5)
    return F.when(shared > 0, F.aggregate(F.sequence(F.lit(1), shared), F.lit(0).cast("bigint"), lambda a, i: a + cost(i))).otherwise(F.lit(0).cast("bigint"))


def damage_rates(i: Column, length: Column, reversed_: Column, single: tuple[float, float, float, float], double: tuple[float, float, float]) -> tuple[Column, Column]:
    """Rates of C→T and G→A at offset i.  single: sigma, delta, lambda, kappa of one-stranded ends; double: sigma, delta, lambda."""
    sigma, delta, left, right = single
    near, far = 1 + i, length - i
    power = lambda base, n: F.pow(F.lit(base), n)
    five = F.when(reversed_, power(left, far)).otherwise(power(left, near))
    three = F.when(reversed_, power(right, near)).otherwise(power(right, far))
    end = five + three - five * three
    one = end * sigma + (1 - end) * delta
    both = lambda n: power(double[2], n) * double[0] + (1 - power(double[2], n)) * double[1]
    return F.when(reversed_, 0.0).otherwise(one) + both(near), F.when(reversed_, one).otherwise(0.0) + both(far)


def most_differences(length: Column, threshold: float, error: float = 0.02) -> Column:
    """Smallest k for which more than k errors in a read are rarer than `threshold` (Poisson)."""
    mean = length * error
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"), F.lit(0).cast("bigint").alias("k"))

    def step(a, k):
        term = a["term"] * mean / k
        go = 1 - a["sum"] >= threshold
        return F.struct(F.when(go, term).otherwise(a["term"]).alias("term"), F.when(go, a["sum"] + term).otherwise(a["sum"]).alias("sum"), F.when(go, k.cast("bigint")).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(length.cast("int"), F.lit(1))), start, step, lambda a: a["k"])


def short_number(x: Column) -> Column:
    """Two significant digits or so with a suffix: 1234 → 1k2, 56789 → 56k."""
    size = F.abs(x) * 10
    out = F.lit("many")
    for n, s in reversed(list(enumerate(["", *"kMGTPEZY"]))):
        y = size * (0.001**n)
        r = F.bround(y, 0).cast("bigint")
        tens, ones = F.floor(r / 10).cast("string"), (r % 10).cast("string")
        small = F.concat(tens, F.when(r % 10 == 0, F.lit(s)).otherwise(F.concat(F.lit(s or "."), ones)))
        text = F.when(y < 100, small).when(y < 1000, F.concat(tens, F.lit(s))).otherwise(F.concat((F.floor(r / 100) * 10).cast("string"), F.lit(s)))
        out = F.when(y < 10000, text).otherwise(out)
    return F.when(x < 0, F.concat(F.lit("-"), out)).otherwise(out)


def empirical_rates(i: Column, length: Column, reversed_: Column, front: Column, back: Column, middle: tuple[float, float]) -> tuple[Column, Column]:
    """Rates of C→T and G→A at offset i from measured log odds.

    front and back are arrays of structs (a, b), the log odds of both by distance from that end; beyond them and in between
    the pair `middle` holds.  Reversed records have both rates exchanged.
    """
    near = F.when(2 * i < length, F.get(front, i.cast("int"))).otherwise(F.get(back, (length - i - 1).cast("int")))
    rate = lambda x: 1 / (1 + F.exp(-x))
    a, b = rate(F.coalesce(near["a"], F.lit(middle[0]))), rate(F.coalesce(near["b"], F.lit(middle[1])))
    return F.when(reversed_, b).otherwise(a), F.when(reversed_, a).otherwise(b)


def substitution_matrix(p: Column, q: Column) -> Column:
    """Array of 16: at 4 * y + x the rate at which base x (of A, C, G, T) is read as y, for C→T at rate p and G→A at rate q."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(one, zero, q, zero, zero, 1 - p, zero, zero, zero, zero, 1 - q, zero, zero, p, zero, one)


def scalar_matrix(s: Column) -> Column:
    """Array of 16 with s where a base is read as itself."""
    return F.array(*[s if k % 5 == 0 else F.lit(0.0) for k in range(16)])


def complement_matrix(m: Column) -> Column:
    """The matrix of the other strand: both bases are complements."""
    return F.reverse(m)


def at_matrix(m: Column, x: str, y: str) -> Column:
    """Rate at which base x is read as y."""
    return F.get(m, F.lit("ACGT".index(x) + 4 * "ACGT".index(y)))


def nudged_matrix(m: Column, x: str, y: str, by: Column) -> Column:
    """The matrix with `by` added to the rate at which x is read as y."""
    k = "ACGT".index(x) + 4 * "ACGT".index(y)
    return F.transform(m, lambda v, i: F.when(i == k, v + by).otherwise(v))
