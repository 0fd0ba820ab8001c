"""Instrument bytes, trimming by a condition, letters and logarithms on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from readforge.functions import molecules as M
from readforge.functions import numeric as N
from readforge.functions import reads as R
from readforge.functions import tags as T
from readforge.operators import molecules


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_bytes(spark):
    d = F.array(*map(F.lit, (0, 4, 5, 255)))
    assert one(spark, M.bcl_bases(d), M.bcl_bases(d, back=True), M.bcl_codes(d), F.hex(M.bcl_packed(d)), F.hex(M.bcl_packed(F.slice(d, 1, 3)))) == ("NACT", "AGTN", [15, 1, 2, 8], "F128", "F120")
    assert one(spark, M.bcl_qualities(d), M.bcl_qualities(d, back=True), M.bcl_quality_text(d), M.bcl_quality_text(d, back=True)) == ([0, 1, 1, 63], [63, 1, 1, 0], '!""`', '`""!')
    none = F.array().cast("array<int>")
    assert one(spark, M.bcl_bases(none), M.bcl_codes(none), F.hex(M.bcl_packed(none)), M.bcl_quality_text(none)) == ("", [], "", "")


def test_clusters(spark):
    rows = [(1, 2, b"\x07\x00\xff"), (1, 1, b"\x01\x02"), (2, 1, None), (3, 1, b"")]
    got = molecules.bcl_clusters(spark.createDataFrame(rows, "tile int, cycle int, data binary"), ["tile"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, [1, 7]), (1, 1, [2, 0]), (1, 2, [255])]
    assert got.limit(0).count() == 0


def test_trim_while(spark):
    kind = f"flag int, pos int, seq string, qual array<int>, cigar string, tags {T.KIND}"
    rows = [(0, 5, "ACGTT", [9, 9, 9, 9, 9], "5M", []), (16, 5, "TTGTT", [9] * 5, "5M", []), (0, 5, "ACGTA", [9] * 5, "5M", []), (0, 5, "TT", [9, 9], "2M", []), (0, 5, None, None, None, []), (0, 5, "", [], "", [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"k int, {kind}")
    got = molecules.trim_3_while(df, lambda s, q: ~s.contains("G") & s.startswith("T"))
    assert got.columns == df.columns
    assert [(r.seq, r.pos) for r in got.orderBy("k").collect()] == [("ACG", 5), ("GTT", 7), ("ACGTA", 5), ("", 5), (None, 5), ("", 5)]
    last = molecules.trim_3_while(df, lambda s, q: F.element_at(q, -1) < 9)
    assert [r.seq for r in last.orderBy("k").collect()] == [r[2] for r in rows]


def test_letters(spark):
    letters = F.array(*map(F.lit, ("a", "T", "u", ".", "-", "n", "x", "ß", "", "AC", "ſ")))
    assert one(spark, F.transform(letters, R.base_code), F.transform(letters, R.two_bit_code)) == ([1, 8, 8, 0, 0, 15, 15, 15, 15, 15, 15], [0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
    assert one(spark, *[R.wide_code(F.lit(c)) for c in (0, 1, 2, 3, 7)]) == (1, 2, 4, 8, 8)


def test_logarithms(spark):
    f = lambda p: F.lit(math.log(p))
    got = one(spark, N.log_subtract(f(0.5), f(0.2)), N.log_subtract(f(0.5), f(0.5)), N.log_mix(F.lit(0.25), f(0.8), f(0.4)), N.log_mix(F.lit(-1.0), f(0.8), f(0.4)), N.log_mix(F.lit(2.0), f(0.8), f(0.4)))
    assert got == pytest.approx((math.log(0.3), -math.inf, math.log(0.5), math.log(0.4), math.log(0.8)))
    with pytest.raises(Exception, match="no negative probabilities"):
        one(spark, N.log_subtract(f(0.2), f(0.5)))
