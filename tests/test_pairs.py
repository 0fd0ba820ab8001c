"""Golden and brute-force cases for mates, 2bit genomes, indexes and edit alignment."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from readforge.functions import alignment as A
from readforge.functions import fused as U
from readforge.operators import genome
from readforge.operators import mates as P
from readforge.sources import bam, index, twobit


def twobit_bytes(seqs, order):
    """seqs: (name, text); N and lower case become blocks."""
    head = struct.pack(order + "4I", 0x1A412743, 0, len(seqs), 0)
    size = len(head) + sum(5 + len(n) for n, _ in seqs)
    names, bodies = b"", b""
    for name, text in seqs:
        names += bytes([len(name)]) + name.encode() + struct.pack(order + "I", size + len(bodies))
        body = struct.pack(order + "I", len(text))
        for mask in ([c in "Nn" for c in text], [c.islower() for c in text]):
            edges = [i for i in range(len(text) + 1) if (i < len(text) and mask[i]) != (i > 0 and mask[i - 1])]
            starts, sizes = edges[::2], [b - a for a, b in zip(edges[::2], edges[1::2])]
            body += struct.pack(f"{order}I{2 * len(starts)}I", len(starts), *starts, *sizes)
        codes = ["TCAG".find(c) if c in "TCAG" else 0 for c in text.upper()] + [0] * 3
        body += struct.pack(order + "I", 0) + bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, len(text), 4))
        bodies += body
    return head + names + bodies


@pytest.mark.parametrize("order", "<>")
def test_twobit(spark, tmp_path, order, monkeypatch):
    rng = random.Random(7)
    texts = {"one": "".join(rng.choice("ACGT") for _ in range(1001)), "none": "", "two": "NNNNACGTacgtnnACGTN" * 40}
    path = str(tmp_path / "g.2bit")
    (tmp_path / "g.2bit").write_bytes(twobit_bytes(list(texts.items()), order))
    twobit.register(spark)
    rows = spark.read.format("twobit").load(path)
    got = {n: "".join(r.seq for r in sorted(rows.where(F.col("name") == n).collect(), key=lambda r: r.chunk)) for n in texts}
    assert got == texts
    at = {n: a for n, a, _ in twobit.catalog(path)}
    assert all(twobit.bases(path, at["one"], s, e) == texts["one"][s:e] for s, e in ((0, 1), (3, 9), (998, 2000), (5, 5)))
    ranges = spark.createDataFrame([(0, 250, 260), (2, 0, 8)], "ref_id bigint, start bigint, end bigint")
    assert {r.bases for r in genome.fetch(ranges, rows, []).collect()} == {texts["one"][250:260], texts["two"][:8]}
    windows = twobit.random_windows(spark, path, 500, 700, 3).collect()
    seen = twobit.random_windows(spark, path, 100, 20, 3, known=True).collect()
    assert len(seen) == 100 and not any("N" in texts[("one", "none", "two")[r.ref_id]][r.start : r.end].upper() for r in seen)
    assert len(windows) == 500 and {r.ref_id for r in windows} == {0, 2} and {r.reversed for r in windows} == {True, False}
    assert all(0 <= r.start and r.end == r.start + 700 <= len(texts[("one", "none", "two")[r.ref_id]]) for r in windows)
    assert twobit.random_windows(spark, path, 5, 5000, 3).count() == 0


def test_twobit_errors(tmp_path):
    for data in (b"", b"abcdefgh", struct.pack("<4I", 0x1A412743, 1, 0, 0), struct.pack("<4I", 0x1A412743, 0, 1, 0)[:12]):
        (tmp_path / "x").write_bytes(data)
        with pytest.raises(ValueError):
            twobit.catalog(str(tmp_path / "x"))


def bin_of(a, e):
    return next((o + (a >> b) for b, o in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)) if a >> b == (e - 1) >> b), 0)


def test_index(spark, tmp_path):
    rng = random.Random(5)
    # records of each reference in order: position, end, and place in the file
    records = [[(p, p + rng.choice([50, 50, 300_000]), 0) for p in sorted(rng.randrange(3_000_000) for _ in range(400))] for _ in range(2)] + [[]]
    place = 1000
    for rows in records:
        for i, (p, e, _) in enumerate(rows):
            rows[i] = (p, e, place)
            place += 100
    bai, csi, tbi = b"BAI\1" + struct.pack("<i", 3), b"CSI\1" + struct.pack("<4i", 14, 5, 0, 3), b"TBI\1" + struct.pack("<8i", 3, 2, 1, 2, 0, 35, 0, 6) + b"a\0b\0c\0"
    for rows in records:
        bins, linear = {}, {}
        for p, e, at in rows:
            bins.setdefault(bin_of(p, e), []).append((at, at + 100))
            for w in range(p >> 14, (e - 1 >> 14) + 1):
                linear.setdefault(w, at)
        body = struct.pack("<i", len(bins) + (1 if bins else 0))
        other = body
        for n, chunks in bins.items():
            packed = struct.pack("<i", len(chunks)) + b"".join(struct.pack("<qq", *c) for c in chunks)
            w = index._left_end(n, 14, 5) >> 14
            body += struct.pack("<I", n) + packed
            # the least place of a record that overlaps the bin's first window
            other += struct.pack("<Iq", n, linear.get(w, 0)) + packed
        if bins:
            body += struct.pack("<Ii4q", 37450, 2, 0, 0, 9, 9)
            other += struct.pack("<Iqi4q", 37450, 0, 2, 0, 0, 9, 9)
        lin = struct.pack("<i", max(linear, default=-1) + 1) + b"".join(struct.pack("<q", linear.get(w, 0)) for w in range(max(linear, default=-1) + 1))
        bai, csi, tbi = bai + body + lin, csi + other, tbi + body + lin
    (tmp_path / "a.bai").write_bytes(bai)
    (tmp_path / "b.csi").write_bytes(csi)
    (tmp_path / "c.tbi").write_bytes(bam.block(tbi) + bam.block(b""))
    (tmp_path / "d.bai").write_bytes(b"BAI\1" + struct.pack("<i", 0))
    rows = index.read(spark, str(tmp_path)).cache()
    assert {r.name for r in rows.where("path like '%.tbi'").collect()} == {"a", "b"}
    for region in ((0, 100_000, 140_000), (1, 2_000_000, 2_000_001), (0, 0, 4_000_000), (2, 0, 10), (0, 5_000_000, 6_000_000), (1, 9, 9)):
        ref, a, e = region
        found = index.segments(rows, spark.createDataFrame([region, region], "ref_id bigint, start bigint, end bigint")).collect()
        for kind in ("bai", "csi", "tbi"):
            own = sorted((r.start, r.end) for r in found if r.path.endswith(kind))
            assert all(x[1] < y[0] for x, y in zip(own, own[1:]))
            for p, end, at in records[ref]:
                if p < e and a < end and e > a:
                    assert any(s <= at < t for s, t in own), (kind, region, p)
        if e - a <= 40_000:
            assert sum(r.end - r.start for r in found if r.path.endswith("bai")) < 40_000
    for bad in (b"BAI\2", b"BAI\1\1\0\0\0"):
        with pytest.raises(ValueError):
            list(index.parse(bad))


def score(r1, q1, r2, q2, size):
    """The rule written out."""
    turn = {"A": "T", "C": "G", "G": "C", "T": "A"}
    total = 6 * size
    for seq, qual, ads in ((r1, q1, P.FORWARD), (r2, q2, P.REVERSE)):
        if seq:
            total += min(sum(5 + min(qual[size + i], 25) for i in range(min(len(seq) - size, len(ad))) if seq[size + i] != ad[i]) + 6 * max(0, len(seq) - len(ad) - size) for ad in ads)
    return total + sum(5 + min(q1[p], q2[size - 1 - p]) for p in range(len(r1)) if 0 <= size - 1 - p < len(r2) and r1[p] != turn.get(r2[size - 1 - p], "?"))


def test_insert_size(spark):
    rng = random.Random(3)
    rows = [("", [], "", []), ("ACGT", [9] * 4, "", []), ("", [], "ACGT", [9] * 4)]
    for _ in range(60):
        m = "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 70)))
        one, two = m + P.FORWARD[rng.randrange(3)] + "ACGTTGCA" * 6, m[::-1].translate(str.maketrans("ACGT", "TGCA")) + P.REVERSE[rng.randrange(2)] + "TTGACCGA" * 6
        n1, n2 = rng.randrange(1, 50), rng.randrange(0, 50)
        rows.append((one[:n1], [rng.randrange(41) for _ in range(n1)], two[:n2], [rng.randrange(41) for _ in range(n2)]))
    df = spark.createDataFrame(rows, "a string, b array<bigint>, c string, d array<bigint>")
    got = df.select("a", "b", "c", "d", P.insert_size(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("s")).collect()
    for r in got:
        plain = 6 * (len(r.a) + len(r.c))
        all_ = [(score(r.a, r.b, r.c, r.d, i), i) for i in range(len(r.a) + len(r.c))]
        best = min([(plain, -1), *all_])
        second = sorted([plain, *[s for s, _ in all_]])[1] if all_ else best[0]
        assert tuple(r.s) == (best[1], second - best[0], plain - best[0]), r


def test_pairs_keep_all_rows(spark):
    rows = [("a", 65, 1), ("a", 129, 2), ("b", 65, 3), ("c", 129, 4), ("d", 0, 5), ("a", 65, 6), (None, 65, 7), ("e", None, 8), (None, 129, 9)]
    df = spark.createDataFrame(rows, "qname string, flag int, single int")
    got = P.paired(df, ["single"]).collect()
    ids = lambda r: tuple(x and x.single for x in (r.single, r.first, r.second))
    assert sorted(map(ids, got), key=str) == sorted([(None, 1, 2), (None, 6, None), (None, 3, None), (None, None, 4), (5, None, None), (None, 7, None), (None, None, 9), (8, None, None)], key=str)
    assert P.pair_filter(df, F.lit(True), F.lit(True), ["single"]).count() == 9
    assert P.pair_filter(df.limit(0), F.lit(True), F.lit(True), ["single"]).count() == 0


def distance(a, b, mode):
    codes = A.CODES
    best = [list(range(len(b) + 1))]
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(best[i][j] + (not codes.get(x, 0) & codes.get(y, 0)), best[i][j + 1] + 1, row[j] + 1))
        best.append(row)
    return {"global": best[-1][-1], "has_prefix": min(r[-1] for r in best), "is_prefix": min(best[-1])}[mode]


def test_alignment(spark):
    rng = random.Random(11)
    pairs = [("", ""), ("", "A"), ("ACGT", ""), ("NNNN", "ACGT"), ("XX", "XX"), ("acgt", "ACGT")]
    for _ in range(150):
        a = "".join(rng.choice("ACGTNR") for _ in range(rng.randrange(14)))
        b = "".join(c for c in a if rng.random() > 0.15) + "".join(rng.choice("ACGT") for _ in range(rng.randrange(5)))
        pairs.append((a, b))
    df = spark.createDataFrame([*pairs, (None, "A"), ("A", None)], "a string, b string")
    for mode in A.MODES:
        for most in (3, 40):
            for r in df.select("a", "b", A.aligned(F.col("a"), F.col("b"), most, mode).alias("r")).collect():
                if r.a is None or r.b is None:
                    assert tuple(r.r) == (None, "", "")
                    continue
                want = distance(r.a.upper(), r.b.upper(), mode)
                if want >= most:
                    assert tuple(r.r) == (None, "", "")
                    continue
                d, x, y = r.r
                assert d == want and x.replace("-", "") == r.a and y.replace("-", "") == r.b and len(x) == len(y), r
                cost = [not A.CODES.get(p.upper(), 0) & A.CODES.get(q.upper(), 0) for p, q in zip(x, y)]
                tail = len(x) - len((y if mode == "has_prefix" else x).rstrip("-")) if mode != "global" else 0
                assert sum(cost) >= d and sum(cost[: len(cost) - tail]) <= d
    shown = spark.range(1).select(A.blocks(F.array(F.lit("ACGTA"), F.lit("AC-TA")), 3), A.blocks(F.array(F.lit("")), 3)).first()
    assert list(shown[0]) == ["ACG", "AC-", "** ", "", "TA", "TA", "**", ""] and list(shown[1]) == []


def test_fused(spark):
    rows = [
        ("4M", "4", "4M", "4"), ("4M", "1A2", "4M", "1A2"), ("2M2D2M", "2^AC2", "2M2D2M", "2^AC2"), ("2M2D2M", "2^AC0T1", "2M2D2M", "2^AC0T1"), ("3M", "5", "3M", None), ("3M", "2", "3M", None),
        ("3M", None, "3M", None), ("1S2M1I1M2N1M1H", "4", "1S2M1I1M2N1M1H", "4"), ("2M1D1M", "4", "2M1D1M", None), ("2M2M0I1M", "5", "5M", "5"), ("", "", "", ""), (None, None, "", None), ("2M1D1D1M", "2^A^C1", "2M2D1M", "2^AC1"),
    ]
    df = spark.createDataFrame([(c, m) for c, m, _, _ in rows], "c string, m string").withColumn("f", U.fuse(F.col("c"), F.col("m")))
    assert [tuple(r) for r in df.select("c", "m", U.cigar_of(F.col("f")), U.md_of(F.col("f"))).collect()] == rows
    broken = df.where("c = '2M1D1M' and m = '4'").first().f
    assert [tuple(x) for x in broken.ops] == [("M", 2, None), ("D", 1, "N"), ("M", 1, None)]


def test_rebuilt_md(spark):
    rows = [("4M", "4", "ACGT", "ACGT", "4"), ("4M", "4", "ACGT", "ACTT", "2G1"), ("4M", "2A1", "ACGT", "ACAT", "4"), ("4M", "2A1", "ACGT", "ACGT", "2A1"), ("2M1D2M", "2^T2", "ACGT", "ACTT", "2^T0G1"), ("1S2M1I1M", "3", "AACGT", "CACTT", "3"), ("4M", "3", "ACGT", "ACGT", None), ("4M", "4", "ACG", "ACG", None), ("4M", "4", None, "ACGT", None), ("", "", "", "", "")]
    df = spark.createDataFrame([r[:4] for r in rows], "c string, m string, a string, b string")
    assert [r[0] for r in df.select(U.rebuilt_md(*[F.col(x) for x in "cmab"])).collect()] == [r[4] for r in rows]
