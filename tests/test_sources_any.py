"""SAM text, files of any kind, bytes and numbers, several outputs, conversion with a state, windows of a genome."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from readforge.functions import numeric as N
from readforge.functions import sequences as S
from readforge.operators import streams
from readforge.sources import bam, sam, twobit
from readforge.sources import reads as any_reads

SAM = """@HD\tVN:1.4\tSO:unknown
@SQ\tSN:b\tLN:70
@SQ\tSN:a\tLN:50
@CO\ta comment
r1\t99\ta\t8\t60\t2S5M\t=\t31\t28\tACGTNRA\tABCDEFG\tNM:i:3\tXN:i:-300\tMD:Z:5A2\tXC:A:q\tXF:f:0.5\tXB:B:s,1,-2,3\tXH:H:1AE3
r2\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\t*
r3\t0\tb\t1\t9\t4=1X\tzz\t5\t-7\t*\t*
"""


def test_sam_text(spark):
    refs = spark.createDataFrame([(0, "b"), (1, "a")], "ref_id bigint, name string")
    lines = spark.createDataFrame([(x,) for x in SAM.splitlines()], "line string")
    got = {r.qname: r for r in sam.decode(lines, refs).collect()}
    r = got["r1"]
    assert (r.flag, r.ref_id, r.pos, r.mapq, r.cigar, r.mate_ref_id, r.mate_pos, r.isize, r.seq, r.qual) == (99, 1, 7, 60, "2S5M", 1, 30, 28, "ACGTNRA", [32, 33, 34, 35, 36, 37, 38])
    assert [(t.key, t.typ, t.value) for t in r.tags][::3] == [("NM", "i", "3"), ("XC", "A", "q"), ("XH", "H", "1AE3")] and len(r.tags) == 7
    assert (got["r2"].ref_id, got["r2"].pos, got["r2"].qual, got["r2"].tags) == (4294967295, -1, [255] * 4, []) and (got["r3"].mate_ref_id, got["r3"].isize, got["r3"].seq, got["r3"].qual) == (4294967295, -7, "", [])
    back = sorted(r.line for r in sam.encode(sam.decode(lines, refs), refs).collect())
    want = sorted(x.replace("\tzz\t", "\t*\t") for x in SAM.splitlines() if x[0] != "@")
    assert back == want
    assert sam.decode(lines.limit(0), refs).count() == 0 and sam.decode(lines).where("ref_id = 4294967295").count() == 3


def test_files_of_any_kind(spark, tmp_path):
    bam.register(spark)
    text = SAM.splitlines()
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "b.sam.gz").write_bytes(gzip.compress("\n".join(["@SQ\tSN:c\tLN:9", "@SQ\tSN:a\tLN:50", "g1\t0\tc\t3\t9\t2M\ta\t4\t0\tAC\tII", ""]).encode()))
    (tmp_path / "e.bam").write_bytes(b"")
    row = {"flag": 0, "mapq": 1, "cigar": "2M", "mate_pos": -1, "isize": 0, "seq": "AC", "qual": [1, 2], "tags": None, "pos": 4}
    head = bam.refs_header([("c", 9), ("b", 70)]).encode()
    data = bam.MAGIC + len(head).to_bytes(4, "little") + head + (2).to_bytes(4, "little") + b"".join((2).to_bytes(4, "little") + n + b"\0" + k.to_bytes(4, "little") for n, k in ((b"c", 9), (b"b", 70)))
    data += b"".join(bam.pack(row | {"qname": f"b{i}", "ref_id": i, "mate_ref_id": 1 - i}) for i in range(2))
    (tmp_path / "c.bam").write_bytes(bam.block(data) + bam.block(b""))
    (tmp_path / "d.bam").write_bytes(gzip.compress(data))
    (tmp_path / "f.bam").write_bytes(data)
    assert any_reads.references(spark, str(tmp_path)) == [("b", 70), ("a", 50), ("c", 9)]
    got = sorted((r.qname, r.ref_id, r.mate_ref_id, r.pos) for r in any_reads.read(spark, str(tmp_path)).collect())
    none = 4294967295
    assert got == sorted([("b0", 2, 0, 4), ("b1", 0, 2, 4)] * 3 + [("g1", 2, 1, 2), ("r1", 1, 1, 7), ("r2", none, none, -1), ("r3", 0, none, 0)])
    (tmp_path / "x.sam").write_text(text[1].replace("70", "71") + "\n")
    with pytest.raises(ValueError, match="different lengths"):
        any_reads.read(spark, str(tmp_path))


def test_written_sam_has_its_header_in_each_file(spark, tmp_path):
    refs = spark.createDataFrame([(0, "b"), (1, "a")], "ref_id bigint, name string")
    lines = spark.createDataFrame([(x,) for x in SAM.splitlines()], "line string").repartition(3)
    sam.write(sam.decode(lines, refs), str(tmp_path / "out"), "@SQ\tSN:b\tLN:70\n@SQ\tSN:a\tLN:50\n", refs)
    files = [p.read_text() for p in (tmp_path / "out").iterdir() if p.name.startswith("part")]
    assert all(x.startswith("@SQ\tSN:b") for x in files if x)
    assert any_reads.read(spark, str(tmp_path / "out")).count() == 3


def test_numbers_and_text_in_bytes(spark):
    df = spark.createDataFrame([(bytes([0xFF, 0x80, 1, 2, 3, 4, 5, 6]),)], "b binary")
    for size in range(1, 9):
        for little in (True, False):
            for signed in (True, False):
                for at in (0, 1, 3):
                    (v,) = df.select(N.integer(F.col("b"), at, size, little, signed)).first()
                    data = df.first().b[at : at + size]
                    assert (None if v is None else int(v)) == (int.from_bytes(data, "little" if little else "big", signed=signed) if len(data) == size else None)
    texts = [b"plain", "né ü €".encode(), b"caf\xe9", b"\xff\xfe", b"", None, b"\xe2\x82x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "b binary").select(S.decoded(F.col("b"))).collect()]
    assert got[:6] == ["plain", "né ü €", "café", "ÿþ", "", None] and got[6].endswith("x")


def test_tee(spark):
    out = streams.tee(spark.range(100), {"even": F.col("id") % 2 == 0, "few": F.col("id") < 5, "none": F.lit(None).cast("boolean")})
    assert out["even"].count() == 50 and sorted(r.id for r in out["few"].collect()) == [0, 1, 2, 3, 4] and out["none"].count() == 0


@pytest.mark.parametrize("block, parts", [(1 << 20, 1), (7, 3), (1, 5)])
def test_conversion_does_not_depend_on_partitions(spark, block, parts):
    rng = random.Random(4)
    rows = [(i, rng.choice("([{x}])"[:5] + "xx"), None) for i in range(120)]
    depth, want = 0, []
    for i, c, _ in rows:
        depth = min(depth + 1, 4) if c in "([{" else max(depth - 1, 0) if c == "}" else depth
        want += [(i, depth, j) for j in range(depth % 3)]

    def step(state, row):
        state = min(state + 1, 4) if row.c in "([{" else max(state - 1, 0) if row.c == "}" else state
        return state, [(row.i, state, j) for j in range(state % 3)]

    df = spark.createDataFrame(rows, "i int, c string, n int").repartition(parts)
    got = streams.convert(df, ["i"], 5, 0, step, "i int, d int, j int", block)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert streams.convert(df.limit(0), ["i"], 5, 0, step, "i int, d int, j int", block).count() == 0


def test_windows_avoid_unknown_bases(spark):
    unknown = spark.createDataFrame([(0, 100, 400), (2, 0, 95)], "ref_id bigint, start bigint, end bigint")
    w = twobit.windows(spark, [500, 20, 130], 400, 30, 5, unknown).collect()
    assert len({r.window for r in w}) == 400 and {r.ref_id for r in w} == {0, 2}
    for r in w:
        assert r.end == r.start + 30 and (r.ref_id == 0 and (r.end <= 100 or 400 <= r.start <= 470) or r.ref_id == 2 and 95 <= r.start <= 100)
    assert w == twobit.windows(spark, [500, 20, 130], 400, 30, 5, unknown.repartition(3)).collect() or sorted(w) == sorted(twobit.windows(spark, [500, 20, 130], 400, 30, 5, unknown).collect())
    with pytest.raises(ValueError, match="rounds"):
        twobit.ROUNDS, before = 2, twobit.ROUNDS
        try:
            twobit.windows(spark, [50], 5, 30, 5, spark.createDataFrame([(0, 0, 50)], "ref_id bigint, start bigint, end bigint"))
        finally:
            twobit.ROUNDS = before
    assert twobit.windows(spark, [10], 5, 30, 5).count() == 0
