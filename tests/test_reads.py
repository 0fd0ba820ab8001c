"""Small fixtures with known values."""

import random

from pyspark.sql import functions as F

from readforge.functions import molecules as M
from readforge.functions import numeric as N
from readforge.functions import reads as R
from readforge.operators import intervals, pileup, streams


def test_bins(spark):
    cases = [(0, 1, 4681), (16383, 1, 4681), (16383, 2, 585), (131071, 2, 73), (67108863, 2, 0), (67108864, 100, 8777)]
    df = spark.createDataFrame(cases, "p bigint, n bigint, want bigint")
    assert df.where(R.distinct_bin(F.col("p"), F.col("n")) != F.col("want")).count() == 0


def test_complement_and_quality(spark):
    df = spark.createDataFrame([("ACMGRSVTWYHKDBN",)], "s string")
    assert df.select(F.reverse(R.reverse_complement(F.col("s")))).first()[0] == "TGKCYSBAWRDMHVN"
    old = spark.createDataFrame([(28,), (31,), (35,), (41,), (51,), (71,)], "q bigint").select(R.old_illumina_quality(F.col("q"))).collect()
    assert [r[0] for r in old] == [2, 3, 5, 10, 20, 40]


def test_complexity_and_wilson(spark):
    df = spark.createDataFrame([(1000.0, 800.0), (100.0, 50.0), (10.0, 10.0), (10.0, 0.0)], "t double, s double")
    got = [r[0] for r in df.select(F.round(N.library_complexity(F.col("t"), F.col("s")), 6)).collect()]
    assert got == [2856.828282, 139.795255, None, None]
    lo, p, hi = spark.createDataFrame([(8.0, 10.0)], "x double, n double").select(*[F.round(c, 6) for c in N.wilson(F.col("x"), F.col("n"), N.normal_quantile(0.975))]).first()
    assert (lo, p, hi) == (0.490162, 0.8, 0.943318)


def test_names_sort_naturally(spark):
    df = spark.createDataFrame([("chr10",), ("chr2",), ("chrX",), ("chr1",)], "n string")
    assert [r[0] for r in df.orderBy(R.name_key(F.col("n"))).collect()] == ["chr1", "chr2", "chr10", "chrX"]


def test_walk_and_union(spark):
    row = spark.createDataFrame([(0, 0, 100, "1S3M2I2M2D1M5N1M", "NACGTTACGT", [30] * 10, 60)], "flag bigint, ref_id bigint, pos bigint, cigar string, seq string, qual array<bigint>, mapq bigint")
    got = {(r.site, r.base) for r in pileup.walk(row, ["ref_id"]).collect()}
    assert got == {(100, "A"), (101, "C"), (102, "G"), (103, "A"), (104, "C"), (107, "G"), (113, "T")}
    df = spark.createDataFrame([(0, 10, 20), (0, 15, 30), (0, 40, 50)], "ref_id bigint, start bigint, end bigint")
    assert sorted((r.start, r.end) for r in intervals.union(df).collect()) == [(10, 30), (40, 50)]


def test_consensus(spark):
    rows = [(1, b, q) for b, q in (("A", 30), ("A", 25), ("G", 20))] + [(2, "A", 20), (2, "G", 20), (3, "T", 40), (3, "T", 40), (4, "C", 10), (4, "G", 7)]
    df = spark.createDataFrame(rows, "site bigint, base string, q bigint")
    assert {(r.site, r.base, r.q) for r in pileup.consensus(df, ["site"]).collect()} == {(1, "A", 35), (2, "N", 0), (3, "T", 60), (4, "N", 0)}


def test_semi_join_keeps_repeated_rows(spark):
    reads = spark.createDataFrame([(0, 10, 20)] * 3 + [(0, 16380, 20), (0, 90, 5)], "ref_id bigint, pos bigint, aligned bigint")
    regions = spark.createDataFrame([(0, 15, 40), (0, 16000, 17000)], "ref_id bigint, start bigint, end bigint")
    assert sorted(r.pos for r in intervals.semi_join(reads, regions).collect()) == [10, 10, 10, 16380]


def test_intervals_over_bins(spark):
    """Unions and semi-joins over many small bins against the plain rule."""
    draw = random.Random(5)
    spans = [(draw.randrange(3), a, a + draw.randrange(-2, 40)) for a in (draw.randrange(-50, 900) for _ in range(90))]
    regions = spark.createDataFrame(spans, "ref_id bigint, start int, end int")
    covered = {(r, p) for r, a, b in spans for p in range(a, b)}
    got = intervals.union(regions, bits=4)
    assert got.schema == regions.schema
    found = sorted(tuple(r) for r in got.collect())
    assert {(r, p) for r, a, b in found for p in range(a, b)} == covered
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(found, found[1:]))
    assert found == sorted(tuple(r) for r in intervals.union(regions).collect())
    rows = [(draw.randrange(4), draw.randrange(-60, 1000), draw.choice([1, 5, 17, 70]), "x") for _ in range(300)]
    reads = spark.createDataFrame(rows + rows[:40] + [(None, 5, 3, "x"), (1, None, 3, "x"), (1, 5, None, "x")], "ref_id bigint, pos bigint, aligned bigint, _bin string")
    want = sorted(r for r in rows + rows[:40] if any((r[0], p) in covered for p in range(r[1], r[1] + r[2])))
    assert sorted(tuple(r) for r in intervals.semi_join(reads, regions, bits=4).collect()) == want
    assert intervals.semi_join(reads.drop("_bin").limit(0), regions).count() == 0 == intervals.semi_join(reads.drop("_bin"), regions.limit(0)).count()


def test_molecule_functions(spark):
    x = spark.createDataFrame([(0.0,), (1.5,), (42.0,), (999.0,), (1234.0,), (56789.0,), (1e6,)], "x double")
    assert [r[0] for r in x.select(M.short_number(F.col("x"))).collect()] == ["0", "1.5", "42", "990", "1k2", "56k", "1M"]
    n = spark.createDataFrame([(2,), (10,), (17,), (20,), (38,), (64,), (100,), (150,)], "n bigint")
    assert [r[0] for r in n.select(M.most_differences(F.col("n"), 0.04)).collect()] == [0, 1, 2, 2, 3, 4, 5, 6]
    one = spark.createDataFrame([(0, 50)], "i bigint, l bigint")
    rates = [M.damage_rates(one.i, one.l, F.lit(False), s, d) for s, d in (((0.5, 0.01, 0.3, 0.3), (0.0, 0.0, 0.0)), ((0.0, 0.0, 0.0, 0.0), (0.4, 0.02, 0.25)))]
    assert [round(v, 9) for v in one.select(*[c for pair in rates for c in pair]).first()] == [0.157, 0.0, 0.115, 0.02]


def test_adapter_and_overlap(spark):
    insert, adapter = "ACGTTGCAAGGCTTACCGAT", "AGATCGGAAGAGCACACGTC"
    back = insert[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([((insert + adapter)[:30], [30] * 30, (back + adapter)[:30], [30] * 30)], "a string, qa array<bigint>, b string, qb array<bigint>")
    for size, clean in ((20, True), (19, False)):
        pair = df.select(M.adapter_score(F.lit(size), df.a, df.qa, adapter), M.overlap_score(F.lit(size), df.a, df.qa, df.b, df.qb)).first()
        assert (pair[0] == 0 and pair[1] == 0) == clean


def test_common_prefix_is_bounded_by_the_literal_only(spark):
    rows = [("long", i, "acgt"[i % 4]) for i in range(30)] + [("short", i, "acgt"[i % 4]) for i in range(3)] + [("other", i, "aaaa"[i]) for i in range(4)] + [("none", 0, "t"), ("null", 0, "a"), ("null", 1, None)]
    df = spark.createDataFrame(rows, "by string, o int, v string")
    got = lambda literal: {r["by"]: r.n for r in streams.common_prefix(df, literal, ["o"], ["by"], "v").collect()}
    assert got(list("acgt" * 5)) == {"long": 20, "short": 3, "other": 1, "none": 0, "null": 1}
    assert got(["a", None]) == {"long": 1, "short": 1, "other": 1, "none": 0, "null": 2}
    assert set(got([]).values()) == {0}
