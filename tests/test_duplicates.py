"""Whole duplicate removal on hand-made places."""

import pytest
from pyspark.sql import functions as F

from readforge.functions import tags as T
from readforge.operators import duplicates

KIND = "qname string, flag int, ref_id bigint, pos int, mapq int, cigar string, mate_ref_id bigint, mate_pos int, isize int, seq string, qual array<int>, tags array<struct<key:string,typ:string,value:string>>, virt_offset bigint"
NONE = 4294967295


def rec(name, flag=0, pos=10, cigar="4M", seq="ACGT", qual=(30, 30, 30, 30), mate=(NONE, -1), mapq=30, ref=0, **tags):
    typ = lambda v: "i" if isinstance(v, int) else "Z"
    return (name, flag, ref, pos, mapq, cigar, mate[0], mate[1], 0, seq, list(qual) if qual is not None else None, [{"key": k, "typ": typ(v), "value": str(v)} for k, v in tags.items()], 77)


def run(spark, rows, **more):
    out = duplicates.remove(spark.createDataFrame(rows, KIND), T.as_string(F.col("tags"), "RG"), **more).collect()
    return {(r.qname, r.flag): r for r in out}, len(out)


def tags(r):
    return {t.key: t.value for t in r["tags"]}


PAIR = {"mate": (0, 50)}


def test_classes_resolve_one_another(spark):
    rows = [
        rec("a"), rec("b", XP=3), rec("p", 0x43, **PAIR), rec("q", 0x43, mate=(0, 60), XP=2), rec("r", 0x83, **PAIR),  # singles go into r, the second mate of the pairs with the nearer mate
        rec("s", 0x10), rec("m", 0x10, FF=2), rec("n", 0x10, cigar="3M1S", FF=1),  # on the other strand into the shorter merged read
        rec("h0", 0x49, 20, mate=(0, 20)), rec("h1", 0x49, 20, mate=(0, 20)), rec("h0", 0x85, 20, cigar="", mate=(0, 20)), rec("h1", 0x85, 20, cigar="", mate=(0, 20)), rec("u", 0x85, 20, cigar="", mate=(0, 20)),
        rec("x", RG="1"), rec("alone", pos=30), rec("lost", 4, -1, ref=NONE), rec("lost2", 4, -1, ref=NONE), rec("v", pos=40, XP=-1), rec("w", pos=40),
    ]
    found, n = run(spark, rows)
    assert {k: (v.copies_seen, tags(v).get("XP")) for k, v in found.items()} == {
        ("r", 0x83): (2, "5"), ("q", 0x43): (1, "2"), ("p", 0x43): (1, None), ("n", 0x10): (1, "2"), ("m", 0x10): (1, None),
        ("h0", 0x49): (2, "2"), ("h0", 0x85): (1, None), ("x", 0): (1, None), ("alone", 0): (1, None), ("lost", 4): (1, None), ("lost2", 4): (1, None), ("v", 0): (2, "-1"),
    } and n == len(found)
    kept, n = run(spark, rows, keep=True)
    assert n == len(rows) and {k for k, v in kept.items() if v.copies_seen == 0} == {("a", 0x400), ("b", 0x400), ("s", 0x410), ("h1", 0x449), ("h1", 0x485), ("u", 0x485), ("w", 0x400)}
    loose, _ = run(spark, rows, strand_preserved=False)
    assert ("r", 0x83) not in loose and ("p", 0x43) in loose  # first and second mates are alike now
    assert tags(loose["n", 0x10])["XP"] == str(1 + 1 + 3 + 1)  # all singles of the place go into the shorter merged read


def test_consensus(spark):
    rows = [
        rec("b", 0x200, seq="ACGT", qual=(20, 20, 20, 20), mapq=30, MD="2C1", NM=9, XA="c,+5,4M,1;", X0=1, AS=10, BQ="x", YZ="kept"),
        rec("a", 0, seq="ACTT", qual=(30, 30, 15, 30), mapq=40, XA="c,+9,4M,1;", X0=2, AS=20, XP=4),
        rec("c", 0x200, seq="ACTT", qual=None, mapq=50, X0=2, AS=30),
        rec("d", 0x200, cigar="2M1I1M", seq="GGGG", mapq=2, XA="c,+5,4M,1;", X0=1, AS=40),
    ]
    found, n = run(spark, rows, most=40)
    (r,) = found.values()
    assert (r.qname, r.flag, r.cigar, r.virt_offset, r.copies_seen) == ("ac", 0x200, "4M", 0, 4)
    assert r.mapq == round((30**2 / 3 + 40**2 / 3 + 50**2 / 3) ** 0.5)
    # A: 20 + 30 + 23 and so on, at most 40; in the third column T: 15 + 23 against G: 20
    assert r.seq == "ACTT" and r.qual == [40, 40, 18, 40]
    t = tags(r)
    assert t == {"X0": "2", "AS": str(round((100 + 400 + 900 + 1600) ** 0.5 / 2)), "NM": "1", "XP": "7", "XA": "c,+5,4M,1;;c,+9,4M,1;", "MD": "2C1"}
    assert [x.key for x in r["tags"]][:2] == ["X0", "AS"]
    kept, n = run(spark, rows, most=40, keep=True)
    assert n == 5 and all(kept[k, f].copies_seen == 0 for k, f in (("a", 0x400), ("b", 0x600), ("c", 0x600), ("d", 0x600)))


def test_consensus_of_few(spark):
    rows = [rec("one", 0x49, qual=(50, 9, 9, 9), mate=(0, 10)), rec("one", 0x85, cigar="", mate=(0, 10)), rec("low", pos=20, qual=(1, 2, 3, 4)), rec("e", pos=30, seq="", qual=()), rec("f", pos=30, seq="", qual=())]
    found, n = run(spark, rows, most=40)
    assert found["onec", 0].qual == [40, 9, 9, 9] and ("one", 0x85) not in found  # a lowered record becomes a single read, its mate is left over
    assert found["low", 0].qual == [1, 2, 3, 4] and found["ec", 0].seq == "" and n == 3
    tie, _ = run(spark, [rec("a", seq="ANGT", qual=(9, 9, 9, 9)), rec("b", seq="CNGT", qual=(9, 9, 9, 9))], most=40)
    assert tie["ac", 0].seq == "NNGT" and tie["ac", 0].qual == [0, 18, 18, 18]
    assert run(spark, [], most=40)[1] == 0 and run(spark, [])[1] == 0


def test_one_cluster_of_very_many(spark):
    rows = spark.range(20_000).selectExpr("concat('r', id) qname", "0 flag", "0L ref_id", "10 pos", "30 mapq", "'4M' cigar", f"{NONE}L mate_ref_id", "-1 mate_pos", "0 isize", "if(id % 3 = 0, 'ACGA', 'ACGT') seq", "array(1, 1, 1, 1) qual", "cast(array() as array<struct<key:string,typ:string,value:string>>) tags", "0L virt_offset")
    (r,) = duplicates.remove(rows, F.lit(None), most=60).collect()
    assert (r.qname, r.seq, r.copies_seen, tags(r)["XP"]) == ("r0c", "ACGT", 20_000, "20000")


@pytest.mark.parametrize("strand", [True, False])
def test_shuffled_input_gives_the_same(spark, strand):
    rows = [rec(f"r{i}", [0, 0x43, 0x49, 0x10][i % 4], 10 + i % 3, mate=(0, 50 + i % 2) if i % 4 in (1, 2) else (NONE, -1), qual=(i % 41,) * 4) for i in range(60)]
    first = run(spark, rows, strand_preserved=strand, most=30)[0]
    assert run(spark, rows[::-1], strand_preserved=strand, most=30)[0] == first
