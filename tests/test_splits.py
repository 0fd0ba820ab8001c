"""One BAM file read in stretches, and only as far as an index says."""

import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readforge.sources import bam, index

REFS = [("chr1", 1_000_000), ("chr2", 50_000)]


def write(rows, size=bam.MOST_BYTES, level=6):
    """A BAM file whose blocks begin anywhere in a record."""
    head = bam.refs_header(REFS, "coordinate").encode()
    data = bam.MAGIC + len(head).to_bytes(4, "little") + head + len(REFS).to_bytes(4, "little")
    for n, k in REFS:
        data += (len(n) + 1).to_bytes(4, "little") + n.encode() + b"\0" + k.to_bytes(4, "little")
    data += b"".join(bam.pack(r) for r in rows)
    return b"".join(bam.block(data[i : i + size], level) for i in range(0, len(data), size)) + bam.block(b"")


def row(i, n, pos=None, tags=None):
    rng = random.Random(i)
    return {"qname": f"r{i}", "flag": 0, "ref_id": 0, "pos": i * 100 if pos is None else pos, "mapq": 30, "cigar": f"{n}M" if n else "", "mate_ref_id": 4294967295, "mate_pos": -1, "isize": 0, "seq": "".join(rng.choice("ACGT") for _ in range(n)), "qual": [rng.randrange(41) for _ in range(n)], "tags": tags}


def names(data, split):
    out = []
    for a in range(0, len(data), split):
        out += [bam.unpack(x, 0)[0] for _, x in bam.records(io.BytesIO(data), a, a + split if a + split < len(data) else None)]
    return out


@pytest.mark.parametrize("size", [300, 5000, 65000])
def test_any_split_gives_the_same_records(size):
    rows = [row(i, random.Random(i).choice([0, 30, 90, 200])) for i in range(400)] + [row(400, 3000), row(401, 20), row(402, 9000), row(403, 50)]
    data = write(rows, size)
    want = [r["qname"] for r in rows]
    for split in (200, 1000, 4096, 20_000, 1 << 20):
        assert names(data, split) == want
    assert names(write([], size), 10) == [] and names(write(rows[:1], size), 100) == ["r0"]


def test_a_record_in_a_tag_is_not_taken_for_one():
    inner = b"".join(bam.pack(row(1000 + i, 40)) for i in range(12))
    trap = row(5, 100, tags=[{"key": "XB", "typ": "B", "value": "C," + ",".join(map(str, inner))}])
    rows = [row(0, 50), trap, row(6, 50)]
    data = write(rows, 400)
    assert names(data, len(data)) == ["r0", "r5", "r6"]
    for split in (150, 300, 700):
        try:
            assert names(data, split) == ["r0", "r5", "r6"]
        except ValueError as e:
            assert "another split" in str(e)


class Counted(io.BytesIO):
    n = 0

    def read(self, size=-1):
        out = super().read(size)
        Counted.n += len(out)
        return out


def test_places_bound_what_is_read():
    rows = [row(i, 60) for i in range(8000)]
    data = write(rows, 20_000)
    found = list(index._runs(bam.records(io.BytesIO(data), 0, None), "f", len(data) << 16))
    packed = index.pack([(r[1], r[2], r[3], r[4], r[5]) for r in found], len(REFS))
    parsed = list(index.parse(packed))
    for low, high in ((0, 1), (300_000, 305_000), (799_000, 900_000), (990_000, 999_999)):
        Counted.n = 0
        got = [bam.unpack(x, 0)[0] for a, b in index.places(parsed, 0, low, high, 1 << 20) for _, x in bam.records_between(Counted(data), a, b)]
        want = [r["qname"] for r in rows if r["pos"] < high and low < r["pos"] + 60]
        assert [x for x in got if x in set(want)] == want and len(got) == len(set(got))
        assert Counted.n < len(data) / 8
    assert index.places(parsed, 1, 0, 1000, 1 << 20) == [] and index.places(parsed, 0, 5, 5, 1 << 20) == []


def test_source_splits_prunes_and_builds(spark, tmp_path):
    bam.register(spark)
    rows = [row(i, 50) for i in range(3000)] + [row(9000 + i, 50, pos=-1) | {"ref_id": 4294967295, "flag": 4, "cigar": ""} for i in range(20)]
    path = str(tmp_path / "one.bam")
    (tmp_path / "one.bam").write_bytes(write(rows, 9000))
    whole = spark.read.format("bam").option("split", 10_000).load(path)
    assert whole.rdd.getNumPartitions() > 8
    assert sorted(r.qname for r in whole.select("qname").collect()) == sorted(r["qname"] for r in rows)
    for split in (7000, 1 << 26):
        built = index.build(spark, path, split).cache()
        assert built.where("bin is not null").agg(F.countDistinct("bin")).first()[0] > 15
        assert index.write(built).collect()[0]["path"] == path + ".bai"
        read = index.read(spark, path + ".bai").withColumn("path", F.regexp_replace("path", ".bai$", "")).withColumn("path", F.regexp_replace("path", "^file:", ""))
        assert sorted(map(str, read.drop("path").collect())) == sorted(map(str, built.drop("path").collect()))
        regions = spark.createDataFrame([(0, 100_010, 100_200), (0, 100_150, 100_900), (0, 299_000, 400_000), (1, 0, 50)], "ref_id bigint, start bigint, end bigint")
        got = sorted(r.qname for r in index.scan(spark, read, regions).select("qname").collect())
        assert got == sorted(r["qname"] for r in rows if r["ref_id"] == 0 and (r["pos"] < 100_900 and r["pos"] + 50 > 100_010 or r["pos"] + 50 > 299_000))
    few = spark.read.format("bam").option("split", 10_000).load(path).where("ref_id = 0 and pos > 5000 and pos <= 7000")
    assert few.rdd.getNumPartitions() <= 2
    assert sorted(r.pos for r in few.collect()) == [p for p in range(5100, 7001, 100)]
    assert spark.read.format("bam").load(path).where("ref_id = 4294967295").count() == 20


def test_small_stretches_share_tasks(spark, tmp_path):
    bam.register(spark)
    rows = [row(i, 50) for i in range(3000)]
    data = write(rows, 9000)
    path = str(tmp_path / "one.bam")
    (tmp_path / "one.bam").write_bytes(data)
    assert len(data) // 100 > 1000
    found = spark.read.format("bam").option("split", 100).load(path)
    assert 8 < found.rdd.getNumPartitions() < 300 and 8 < bam.stretches(spark, path, 100).rdd.getNumPartitions() < 300
    assert sorted(r.qname for r in found.select("qname").collect()) == sorted(r["qname"] for r in rows)
    wide = list(bam.shared([("a", 3 << 40), ("b", 0)], 4096))
    assert max(b - a for _, a, b in wide) == bam.SPLIT and wide[-1] == ("b", 0, 0) and sum(b - a for _, a, b in wide) == 3 << 40


@pytest.mark.parametrize("size", [300, 5000, 65000])
def test_stretches_of_one_task(size):
    rows = [row(i, random.Random(i).choice([0, 30, 90, 200])) for i in range(400)] + [row(400, 3000), row(401, 20), row(402, 9000), row(403, 50)]
    data = write(rows, size)
    want = list(bam.records(io.BytesIO(data), 0, None))
    assert len(want) == len(rows)
    for split in (200, 1000, 4096, 20_000):
        for most in (split, 3 * split, 1 << 30):
            got = [x for a in range(0, len(data), most) for x in bam.records(io.BytesIO(data), a, a + most if a + most < len(data) else None, split)]
            assert got == want
    inner = b"".join(bam.pack(row(1000 + i, 40)) for i in range(12))
    trap = row(5, 100, tags=[{"key": "XB", "typ": "B", "value": "C," + ",".join(map(str, inner))}])
    data = write([row(0, 50), trap, row(6, 50)], 400)
    with pytest.raises(ValueError, match="another split"):  # each stretch is still held against what is found in it
        for split in range(100, 900, 50):
            assert [bam.unpack(x, 0)[0] for _, x in bam.records(io.BytesIO(data), 0, None, split)] == ["r0", "r5", "r6"]


def test_columns_are_packed_and_read_as_single_records():
    rng = random.Random(4)
    tags = [None, [], [{"key": "RG", "typ": "Z", "value": "rg1"}], [{"key": "XP", "typ": "i", "value": "-5"}, {"key": "XF", "typ": "f", "value": "1.5"}, {"key": "XB", "typ": "B", "value": "s,1,-2,3"}]]
    odd = [{}, {"qual": None}, {"cigar": None, "seq": None, "qual": []}, {"qname": None}, {"isize": None}, {"seq": "ACGTNacgt-=.RYKM", "qual": [3] * 16}, {"qname": "é€"}, {"cigar": "3S10M2D5I40000N3=2X1H1P"}]
    rows = [row(i, rng.choice([0, 1, 30, 51]), rng.choice([-1, 5, 16380, 70_000_000]), rng.choice(tags)) | rng.choice(odd) for i in range(300)]
    schema = bam.ARROW.remove(12)
    for n in (300, 1, 0):
        batch = pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows[:n]], schema)
        want = [bam.pack(r) for r in rows[:n]]
        data, sizes = bam.pack_batch(batch)
        assert data == b"".join(want) and sizes.tolist() == list(map(len, want))
        back = [tuple(r.values()) for b in bam.batches((i, x[4:]) for i, x in enumerate(want)) for r in b.to_pylist()]
        assert back == [bam.unpack(x[4:], i) for i, x in enumerate(want)]
    for wrong in ({"seq": "é"}, {"qual": [300]}, {"flag": 70_000}, {"qname": "x" * 300}, {"pos": None}, {"cigar": "3Q"}):
        got = []
        for f in (bam.pack, lambda r: bam.pack_batch(pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names}], schema))[0]):
            try:
                got.append(f(rows[0] | wrong))
            except Exception as e:
                got.append(type(e))
        assert got[0] == got[1]
    with pytest.raises(ValueError, match="shorter"):
        list(bam.batches(iter([(0, bam.pack(row(0, 50))[4:60])])))


def test_an_index_reads_records_once(spark, tmp_path):
    rows = [row(i, 50) for i in range(3000)]
    path = str(tmp_path / "one.bam")
    (tmp_path / "one.bam").write_bytes(write(rows, 9000))
    built = index.build(spark, path, 100)
    assert "MapInPandas" not in built._jdf.queryExecution().toString()  # not once for each kind of row
    assert built.where("bin is not null").agg(F.countDistinct("bin")).first()[0] == len({bam._smallest_bin(r["pos"], 50) for r in rows})
    found = [(i, bam.pack(r)[4:]) for i, r in enumerate(rows[:200] + [row(0, 3, 20_000) | {"cigar": "1M70000N2M"}, row(0, 9, 20_001)])]
    runs = list(index._runs(iter(found), "f", 999))
    assert [x[2:] for x in runs if x[2] is not None] == [(4681, None, 0, 164), (4682, None, 164, 200), (585, None, 200, 201), (4682, None, 201, 999)]
    assert {x[3]: x[4] for x in reversed(runs) if x[3] is not None} == {0: 0, 1: 164, 2: 200, 3: 200, 4: 200, 5: 200}
