"""Piles against hand-made ones."""

import pytest
from pyspark.sql import functions as F

from readforge.functions import molecules as M
from readforge.operators import pileup, piles

KIND = "name string, ref_id bigint, pos bigint, flag bigint, mapq bigint, cigar string, seq string, qual array<bigint>, md string, bq string, site string"
FIELDS = ["site", "base", "q", "offset", "ref", "on", "del", "ins"]


def parts(spark, *rows):
    full = [("r", 0, 10, x.get("flag", 0), x.get("mapq", 40), x.get("cigar"), x.get("seq"), x.get("qual"), x.get("md"), x.get("bq"), "clash") for x in rows]
    df = spark.createDataFrame(full, KIND)
    return piles.decompose(df, ["ref_id"], F.col("md"), F.col("bq"))


def seen(spark, **x):
    return [tuple(r[c] for c in FIELDS) for r in parts(spark, x).orderBy("site").collect()]


def test_deletion_insertion_and_reference(spark):
    got = seen(spark, cigar="1S2M1D1M2I1M1S", seq="GACGTTAC", qual=[20] * 8, md="1T^G2")
    assert got == [
        (10, "A", 20, 1, "A", True, "", ""),
        (11, "C", 20, 2, "T", True, "G", ""),
        (13, "G", 20, 3, "G", True, "", "TT"),
        (14, "A", 20, -2, "A", False, "", ""),
    ]


def test_gap_takes_what_stands_beside_it(spark):
    assert [r[5:] for r in seen(spark, cigar="1M1I3N1D1M", seq="ACG", qual=[20] * 3, md="1^A1")] == [(False, "", ""), (False, "", "")]
    assert [r[0] for r in seen(spark, cigar="2D1I1M0M1M2D", seq="CAG", qual=[20] * 3, md="0^GG2")] == [12, 13]


def test_zero_length_run_keeps_the_change(spark):
    assert [r[5:] for r in seen(spark, cigar="1M1I0M1D1M", seq="ACG", qual=[20] * 3, md="1^A1")] == [(True, "A", "C"), (False, "", "")]


def test_reference_unknown(spark):
    assert [r[4] for r in seen(spark, cigar="3M", seq="ACG", qual=[20] * 3)] == ["N"] * 3
    assert [r[4] for r in seen(spark, cigar="3M", seq="ACG", qual=[20] * 3, md="2")] == ["A", "C", "N"]
    assert [r[6] for r in seen(spark, cigar="1M2D1M", seq="AC", qual=[20] * 2)] == ["NN", ""]


def test_quality(spark):
    got = seen(spark, cigar="5M", seq="ACNTG", qual=[255, 20, 20, 60, 20], bq="@BDA", md="5")
    assert [(r[1], r[2]) for r in got] == [("A", 30), ("C", 22), ("A", 0), ("T", 40), ("G", 20)]
    assert [r[2] for r in seen(spark, cigar="2M", seq="AC")] == [30, 30]


def test_rows_without_bases(spark):
    none = [{"cigar": "3M"}, {"cigar": None, "seq": "ACG"}, {"cigar": "3M", "seq": ""}, {"cigar": "*", "seq": "A"}, {"cigar": "1M", "seq": "A", "flag": 4}, {"cigar": "1M", "seq": "A", "flag": 1024}, {"cigar": "1M", "seq": "A", "flag": None}]
    p = parts(spark, *none)
    assert p.count() == 0 and piles.bases(p, ["ref_id"]).count() == piles.changes(p, ["ref_id"]).count() == piles.statistics(p, ["ref_id"]).count() == 0
    assert [r[0] for r in seen(spark, cigar="4M", seq="AC")] == [10, 11]


def test_sums(spark):
    read = {"cigar": "2M", "seq": "AC", "qual": [20, 20], "md": "2"}
    p = parts(spark, *[read] * 3, read | {"flag": 16, "mapq": 0}, read | {"mapq": None})
    s = {r["site"]: r for r in piles.statistics(p, ["ref_id"]).collect()}
    assert s[10].asDict() == {"ref_id": 0, "site": 10, "depth": 5, "mapq0": 1, "sum_mapq": 375, "sum_mapq2": 3 * 1600 + 65025, "on_depth": 5, "on_mapq0": 1, "on_sum_mapq": 375, "on_sum_mapq2": 3 * 1600 + 65025}
    assert (s[11]["depth"], s[11]["on_depth"], s[11]["on_sum_mapq"]) == (5, 0, 0)
    assert sorted((r["site"], r["reversed"], r["q"], r["n"]) for r in piles.bases(p, ["ref_id"]).collect()) == [(10, False, 20, 4), (10, True, 0, 1), (11, False, 20, 4), (11, True, 0, 1)]
    assert sorted((r["reversed"], r["mapq"], r["n"]) for r in piles.changes(p, ["ref_id"]).collect()) == [(False, 40, 3), (False, 255, 1), (True, 0, 1)]


def test_likelihoods(spark):
    m = M.substitution_matrix(F.lit(0.25), F.lit(0.5))
    df = spark.createDataFrame([("T", 10), ("A", 20)], "base string, q bigint").select(piles.likelihoods(F.col("base"), F.col("q"), m).alias("l"))
    t, a = [r["l"] for r in df.collect()]
    assert t == pytest.approx([0.1 / 3, 0.75 * 0.1 / 3 + 0.25 * 0.9, 0.1 / 3, 0.9])
    assert a == pytest.approx([0.99, 0.01 / 3, 0.5 * 0.01 / 3 + 0.5 * 0.99, 0.01 / 3])


def test_gap_in_runs_of_plain_piles(spark):
    df = spark.createDataFrame([(0, 10, 0, 40, "1M1I3N1D1M1D1M", "ACGT", [20] * 4)], "ref_id bigint, pos bigint, flag bigint, mapq bigint, cigar string, seq string, qual array<bigint>")
    got = sorted((r["site"], r["ins"], r["del"]) for r in pileup.indel_piles(df, ["ref_id"]).collect())
    assert got == [(15, "", 1)]
