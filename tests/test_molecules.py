"""Whole records: goldens made by hand for cuts, merges, circles, alignments, gaps between piles and damage; order without one task."""

import random

import pytest
from pyspark.sql import functions as F

from readforge.functions import fused as U
from readforge.functions import molecules as M
from readforge.functions import reads as R
from readforge.functions import tags as T
from readforge.operators import genome, molecules, pileup, streams

KIND = "qname string, flag int, ref_id bigint, pos int, mapq int, cigar string, mate_ref_id bigint, mate_pos int, isize int, seq string, qual array<int>, tags array<struct<key:string,typ:string,value:string>>"
NONE = 4294967295


def rec(name, cigar, seq, flag=0, pos=100, mapq=30, ref=0, qual=None, **tags):
    return (name, flag, ref, pos, mapq, cigar, NONE, -1, 0, seq, list(range(len(seq))) if qual is None else qual, [{"key": k, "typ": "i" if isinstance(v, int) else "Z", "value": str(v)} for k, v in tags.items()])


def shown(df):
    return {r.qname: (r.pos, r.cigar, r.seq, r.qual, {t.key: t.value for t in r.tags}) for r in df.collect()}


def test_trim_3(spark):
    rows = [
        rec("f", "2S4M1I3M", "AACCGGTTAC", MD="2T4", BQ="0123456789", XX="0123456789"), rec("r", "2S4M1I3M", "AACCGGTTAC", 16, MD="2T4", BQ="0123456789"),
        rec("d", "4M2D4M", "ACGTACGT", MD="4^GG4"), rec("e", "4M2D4M", "ACGTACGT", 16, MD="4^GG4"), rec("bad", "8M", "ACGTACGT", MD="3"), rec("none", "8M", "ACGTACGT"), rec("short", "2M", "AC", MD="2"), rec("empty", "", ""),
    ]
    df = spark.createDataFrame(rows, KIND)
    out = shown(molecules.trim_3(df, F.lit(4)))
    assert out["f"] == (100, "2S4M", "AACCGG", [0, 1, 2, 3, 4, 5], {"MD": "2T1", "BQ": "012345", "XX": "0123456789"})
    assert out["r"] == (102, "2M1I3M", "GGTTAC", [4, 5, 6, 7, 8, 9], {"MD": "T4", "BQ": "456789"})
    assert out["d"] == (100, "4M", "ACGT", [0, 1, 2, 3], {"MD": "4"}) and out["e"] == (106, "4M", "ACGT", [4, 5, 6, 7], {"MD": "4"})
    assert out["bad"][4] == {} and out["none"] == (100, "4M", "ACGT", [0, 1, 2, 3], {})
    assert out["short"] == (100, "", "", [], {"MD": ""}) and out["empty"][2] == ""
    assert shown(molecules.trim_3(df, F.lit(0))) == shown(df) == shown(molecules.trim_3(df, F.lit(-3)))


def test_circles(spark):
    circles = spark.createDataFrame([(0, "mt", 110)], "ref_id bigint, name string, size bigint")
    rows = [
        rec("in", "5M", "ACGTA"), rec("edge", "10M", "ACGTACGTAC"), rec("over", "8M2I4M", "ACGTACGTACGTAC", MD="9A2"), rec("gap", "8M4D4M", "ACGTACGTACGT", MD="8^ACGT4"),
        rec("skip", "8M4N4M", "ACGTACGTACGT"), rec("ins", "10M3I4M", "ACGTACGTACGTACGTA"), rec("unmapped", "20M", "A" * 20, 4), rec("other", "20M", "A" * 20, ref=1), rec("beyond", "5M", "ACGTA", pos=115),
    ]
    out = {(r.qname, r.moved): (r.pos, r.cigar, {t.key: t.value for t in r.tags}.get("MD")) for r in molecules.wrapped(spark.createDataFrame(rows, KIND), circles).collect()}
    assert out["over", False] == (100, "8M2I2M2S", "9A") and out["over", True] == (0, "12S2M", "2")
    assert out["gap", False] == (100, "8M2D4S", "8^AC") and out["gap", True] == (0, "8S2D4M", "^GT4")
    assert out["skip", False] == (100, "8M2N4S", None) and out["skip", True] == (0, "8S2N4M", None)
    assert out["ins", False] == (100, "10M7S", None) and out["ins", True] == (0, "10S3I4M", None)  # an insertion at the end belongs to the rest
    assert {k for k, moved in out if moved} == {"over", "gap", "skip", "ins"} and len(out) == 13
    rows = [rec("a", "5M", "ACGTA", pos=115, XA="mt,+6,5M,0;"), rec("b", "5M", "ACGTA", pos=115, XA="mt,+7,5M,0;"), rec("c", "5M", "ACGTA", 16, pos=5, XA="mt,-116,5M,0"), rec("d", "5M", "ACGTA", pos=500, ref=1)]
    out = {r.qname: (r.pos, r.mapq, len(r.tags), r.moved) for r in molecules.on_circle(spark.createDataFrame(rows, KIND), circles).collect()}
    assert out == {"a": (5, 37, 0, True), "b": (5, 30, 1, True), "c": (5, 37, 0, False), "d": (500, 30, 0, False)}


def test_merge_trim(spark):
    rng = random.Random(1)
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    made = []
    for k, size in enumerate([60, 45, 30, 70, 0]):
        m = "".join(rng.choice("ACGT") for _ in range(size))
        one, two = (m + molecules.mates.FORWARD[0] + "ACGT" * 9)[:40], (turn(m) + molecules.mates.REVERSE[0] + "ACGT" * 9)[:40]
        made.append((f"m{k}", m, one, two))
    row = lambda n, flag, s: rec(n, "", s, flag, -1, 0, NONE, [35] * len(s), RG="x")
    rows = [row(n, f, s) for n, _, a, b in made for f, s in ((77, a), (141, b))] + [row("one", 4, made[2][2]), row("lone", 77, "ACGT" * 10), row("nil", 4, "")]
    out = molecules.merge_trim(spark.createDataFrame(rows, KIND), 20, 60, ["flag"]).collect()
    got = {}
    for r in out:
        got.setdefault(r.qname, []).append((r.flag, r.seq, T_of(r).get("FF")))
    assert got["m0"] == [(4, made[0][1], "2")] and got["m1"] == [(4, made[1][1], "2")]
    assert got["m2"] == [(4, made[2][1], "3")]  # shorter than the first mate: merged and trimmed
    assert sorted(x[0] for x in got["m3"]) in ([4], [4, 77, 141], [77, 141])
    assert "m4" not in got and "nil" not in got and got["one"][-1] == (4, made[2][1], got["one"][-1][2]) and int(got["one"][-1][2]) & 1
    assert got["lone"] == [(77, "ACGT" * 10, None)]
    (m,) = [r for r in out if r.qname == "m0"]
    assert (m.ref_id, m.pos, m.cigar, len(m.qual)) == (NONE, -1, "", 60) and max(m.qual) <= 63 and [t.key for t in m.tags] == ["YM", "YN", "FF", "RG"]
    assert m.qual[0] == 35 and m.qual[30] == min(63, 70, int(T_of(m)["YM"]))
    raw = [r.seq for r in molecules.merge_trim(spark.createDataFrame(rows, KIND), 20, 60, ["flag"], raw=True).collect() if r.qname == "m0"]
    assert raw == [made[0][1][:40] + turn(made[0][1][40:])[::-1]]


def T_of(r):
    return {t.key: t.value for t in r.tags}


@pytest.mark.parametrize(
    "cigar, md, seq, ref, read",
    [
        ("4M", "4", "ACGT", "ACGT", "ACGT"), ("2S3M", "1T1", "GGACG", "--ATG", "GGACG"), ("2M1I2M", "0G3", "ACGTA", "GC-TA", "ACGTA"), ("2M2D2M", "2^TT2", "ACGT", "ACGT", "ACGT"),
        ("2H2M1P1M3N1M", "1A2", "ACGT", "--AAGT", "NNACGT"), ("4M", "3", "ACGT", None, None), ("4M", None, "ACGT", None, None), ("2M1D2M", "2A2", "ACGT", None, None),
    ],
)
def test_alignments(spark, cigar, md, seq, ref, read):
    df = spark.createDataFrame([(cigar, md, seq)], "cigar string, md string, seq string").withColumn("f", U.fuse(F.col("cigar"), F.col("md")))
    r = df.select(U.aligned(F.col("f"), F.col("seq")).alias("a")).first().a
    assert (r and (r.ref, r.read)) == (ref and (ref, read))
    r = spark.createDataFrame([("2H2M1I1D1M3N1M", "ACGTA", "ACXTNNNA")], "c string, s string, r string").select(U.aligned_to(F.col("s"), F.col("c"), F.col("r")).alias("a")).first().a
    assert (r.ref, r.read) == ("--AC-TA", "NNACGTA")


def test_damage_is_the_same_by_md_and_by_reference(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        ref = "".join(rng.choice("ACGT") for _ in range(30))
        read = "".join("T" if c == "C" and rng.random() < 0.5 else c for c in ref)
        md, n = "", 0
        for a, b in zip(ref, read):
            md, n = (md, n + 1) if a == b else (md + str(n) + a, 0)
        flag = 16 * (i % 2)
        rows.append((flag, "complete", "30M", md + str(n), read, ref))
        if flag:
            ref, read = (s[::-1].translate(str.maketrans("ACGT", "TGCA")) for s in (ref, read))
        ends = {"all"} | ({"d5"} if (ref[0], read[0]) == ("C", "T") else set()) | ({"d3"} if (ref[-1], read[-1]) == ("C", "T") else set())
        ends |= {"dd"} if {"d5", "d3"} <= ends else set()
        for end, at in [(5, j) for j in range(6)] + [(3, -j - 1) for j in range(6)]:
            for c in ends:
                want[end, at, c, ref[at], read[at]] = want.get((end, at, c, ref[at], read[at]), 0) + 1
    df = spark.createDataFrame(rows, "flag int, kind string, cigar string, md string, seq string, whole string").withColumn("n", F.lit(30)).withColumn("f", U.fuse(F.col("cigar"), F.col("md")))
    one = molecules.damage_classes(df.withColumn("a", U.aligned(F.col("f"), F.col("seq"))).select("flag", "kind", "n", "a.ref", "a.read"), 6)
    two = molecules.damage_classes(df.withColumn("a", U.aligned_to(F.col("seq"), F.col("cigar"), F.col("whole"))).select("flag", "kind", "n", "a.ref", "a.read"), 6)
    got = {tuple(r)[:5]: r.c for r in one.collect()}
    assert got == {tuple(r)[:5]: r.c for r in two.collect()}
    assert {k: v for k, v in got.items() if k[2] != "cpg"} == want and any(k[2] == "cpg" for k in got)


def test_indel_piles(spark):
    rows = [rec("a", "3M1I2M", "ACGTAC", pos=10), rec("b", "3M2D3M", "ACGTAC", pos=10), rec("c", "6M", "ACGTAC", pos=10), rec("d", "3M1I1D2M", "ACGAAC", pos=10), rec("e", "2S2M", "ACGT", pos=12), rec("u", "6M", "ACGTAC", 4, pos=10)]
    got = {(r.site, r.ins, r["del"]): (r.n, r.q) for r in pileup.indel_piles(spark.createDataFrame(rows, KIND), ["ref_id"]).collect()}
    assert {k: v for k, v in got.items() if k[0] == 12} == {(12, "T", 0): (1, 30), (12, "", 2): (1, 30), (12, "", 0): (2, 60), (12, "A", 1): (1, 30)}
    assert {k: v for k, v in got.items() if k[0] in (10, 11, 13)} == {(10, "", 0): (4, 120), (11, "", 0): (4, 120), (13, "", 0): (2, 60)}


def test_matrices(spark):
    m = M.substitution_matrix(F.lit(0.25), F.lit(0.125))
    one = spark.range(1).select(m.alias("m"), M.complement_matrix(m).alias("c"), M.scalar_matrix(F.lit(2.0)).alias("s"), M.at_matrix(m, "C", "T").alias("ct"), M.at_matrix(M.nudged_matrix(m, "A", "G", F.lit(1.0)), "A", "G").alias("ag")).first()
    at = lambda m, x, y: m["ACGT".index(x) + 4 * "ACGT".index(y)]
    assert at(one.m, "C", "T") == one.ct == 0.25 and at(one.m, "G", "A") == 0.125 and all(sum(at(one.m, x, y) for y in "ACGT") == 1 for x in "ACGT")
    assert all(at(one.c, x, y) == at(one.m, R.COMPLEMENTS[R.BASES.index(x)], R.COMPLEMENTS[R.BASES.index(y)]) for x in "ACGT" for y in "ACGT")
    assert one.s == [2.0 if k % 5 == 0 else 0.0 for k in range(16)] and one.ag == 1.0


def test_order_without_one_task(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), "id").repartition(7)
    got = streams.numbered(df, ["v"])
    assert [r.v for r in got.orderBy("rn").collect()] == sorted(r.v for r in df.collect()) and got.agg(F.min("rn"), F.max("rn")).first() == (1, 5000)
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert sorted(r.v for r in streams.drop(df, ["v"], 4990).collect()) == sorted(r.v for r in df.collect())[4990:]
    assert streams.numbered(df.limit(0), ["v"]).count() == 0 and streams.drop(df, ["v"], 9000).count() == 0
    names = ["a", "a1", "a01b", "a1b", "a2", "a10", "a" + "9" * 60, "a1" + "0" * 60, "b", "", "a00", "a-1", "a:1"]
    at = spark.createDataFrame([(n,) for n in names], "qname string").select("qname", R.name_key(F.col("qname")).alias("k"))
    assert [r.qname for r in at.orderBy("k", F.desc("qname")).collect()] == ["", "a", "a-1", "a00", "a1", "a1b", "a01b", "a2", "a10", "a" + "9" * 60, "a1" + "0" * 60, "a:1", "b"]


def test_merging_many_inputs(spark):
    one = spark.createDataFrame([(1, "a"), (3, "b"), (3, "c")], "k int, v string")
    two = spark.createDataFrame([(2, "d"), (3, "e")], "k int, v string")
    three = spark.createDataFrame([(3, "f"), (0, "g")], "k int, v string")
    key = [F.col("k")]
    got = [(r.v, r.src, r.rn) for r in streams.merge_ordered([one, two, three], key, ["v"]).orderBy("rn").collect()]
    assert got == [("g", 2, 1), ("a", 0, 2), ("d", 1, 3), ("f", 2, 4), ("e", 1, 5), ("b", 0, 6), ("c", 0, 7)]
    joined = streams.merge_ordered([one, two, three], key, ["v"], {"k": F.first("k"), "v": F.array_join(F.sort_array(F.collect_list("v")), "+")})
    assert [(r.v, r.rn) for r in joined.orderBy("rn").collect()] == [("g", 1), ("a", 2), ("d", 3), ("b+e+f", 4), ("c", 5)]
    assert streams.merge_ordered([one.limit(0), two.limit(0)], key, ["v"]).count() == 0


def test_substitutions_broadcast_no_bases(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("ACGT") for _ in range(700))
    text = text[:255] + "CG" + text[257:]  # a CG over the edge of two chunks
    chunks = spark.createDataFrame([(0, k, text[256 * k : 256 * k + 256]) for k in range(3)], "ref_id bigint, chunk bigint, seq string").repartition(2)
    n, m = 20_000, 80
    found = spark.range(n).repartition(3).selectExpr("0L ref_id", f"id % {len(text) + 40} pos", f"explode(sequence(0, {m - 1})) i")
    found = found.selectExpr("ref_id", "pos + i site", "substr('ACGTN', cast((pos * 7 + i) % 5 as int) + 1, 1) base")
    want = {}
    for k in range(n):
        pos = k % (len(text) + 40)
        for i in range(m):
            base, site = "ACGTN"[(pos * 7 + i) % 5], pos + i
            if base != "N" and site < len(text):
                key = text[site], base, text[site : site + 2] == "CG" or site > 0 and text[site - 1 : site + 1] == "CG"
                want[key] = want.get(key, 0) + 1
    for cpg in (True, False):
        out = genome.substitutions(found, chunks, ["ref_id"], cpg)
        got = {(r.ref_base, r.base, r.cpg if cpg else None): r.c for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "BuildRight" in plan and "BuildLeft" not in plan
        assert sum(got.values()) == sum(want.values()) and (not cpg or got == want)
