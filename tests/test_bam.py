"""BAM files: golden bytes, damage, and a round trip through Spark."""

import gzip
import io
import struct

import pytest

from readforge.sources import bam

TAGS = [{"key": "NM", "typ": "i", "value": "3"}, {"key": "XN", "typ": "i", "value": "-300"}, {"key": "MD", "typ": "Z", "value": "5A2"}, {"key": "XC", "typ": "A", "value": "q"}, {"key": "XF", "typ": "f", "value": "0.5"}, {"key": "XB", "typ": "B", "value": "s,1,-2,3"}]
ROW = {"qname": "r1", "flag": 99, "ref_id": 0, "pos": 7, "mapq": 60, "cigar": "2S5M", "mate_ref_id": 0, "mate_pos": 30, "isize": 28, "seq": "ACGTNRA", "qual": [1, 2, 3, 4, 5, 6, 7], "tags": TAGS}
HEADER = bam.refs_header([("chr1", 1000), ("chr2", 50)])


def test_record_bytes():
    data = bam.pack(ROW)
    assert struct.unpack("<I", data[:4])[0] == len(data) - 4
    assert struct.unpack("<IiBBHHHiIii", data[4:36]) == (0, 7, 3, 60, 4681, 2, 99, 7, 0, 30, 28)
    assert data[36:39] == b"r1\0" and struct.unpack("<2I", data[39:47]) == (2 << 4 | 4, 5 << 4) and data[47:51] == bytes([0x12, 0x48, 0xF5, 0x10])
    assert data[58:62] == b"NMC\x03" and data[62:67] == b"XNs" + struct.pack("<h", -300)
    back = bam.unpack(data[4:], 5)
    assert back == tuple(ROW[k] for k in list(ROW)[:-1]) + (TAGS, 5)
    with pytest.raises(ValueError):
        bam.unpack(data[4:40], 0)
    with pytest.raises(ValueError):
        bam.unpack(b"short", 0)
    empty = ROW | {"cigar": "", "seq": "", "qual": [], "tags": None, "pos": -1, "ref_id": 4294967295}
    assert bam.unpack(bam.pack(empty)[4:], 0)[9:12] == ("", [], [])
    assert bam.unpack(bam.pack(ROW | {"qual": None})[4:], 0)[10] == [255] * 7


def test_blocks():
    data = bam.block(b"abc") + bam.block(b"") + bam.block(b"de")
    assert [x for _, x in bam.blocks(io.BytesIO(data))] == [b"abc", b"", b"de"]
    assert bam.is_bgzf(data) and [bam.kind_of(x) for x in (b"", data, gzip.compress(b"x"), b"BAM\1", b"@HD")] == ["empty", "bgzf", "gzip", "plain", "sam"]
    for bad in (data[:-3], data[:20] + b"\0" + data[21:], data + b"junk of more than twelve bytes"):
        with pytest.raises((ValueError, bam.zlib.error)):
            list(bam.blocks(io.BytesIO(bad)))


def test_header():
    text = "@HD\tVN:1.4\tSO:coordinate\n@SQ\tSN:a\tLN:5\tM5:x\n@RG\tID:1\n@PG\tID:p\n@CO\tsaid\tso\n"
    meta = bam.parse_header(text)
    assert bam.show_header(meta) == text and meta["refs"] == [("a", 5, [("M5", "x")])]
    more = bam.with_program(bam.with_program(meta, "p", "cmd", "1"), "q", "c", "2")
    assert [dict(f) for c, f in more["other"] if c == "PG"][1:] == [{"ID": "p-1", "PN": "p", "CL": "cmd", "VN": "1", "PP": "p"}, {"ID": "q", "PN": "q", "CL": "c", "VN": "2", "PP": "p-1"}]
    both = bam.combined_header(meta, bam.parse_header(HEADER))
    assert both["version"] == (1, 4) and both["sorting"] == "unknown" and [r[0] for r in both["refs"]] == ["a", "chr1", "chr2"]


def test_files(spark, tmp_path):
    bam.register(spark)
    rows = [ROW | {"qname": f"r{i}", "seq": "ACGT" * (i * 40), "qual": [i % 60] * (i * 160), "cigar": f"{i * 160}M"} for i in range(1, 500)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], bam.SCHEMA.rsplit(",", 1)[0]).repartition(3)
    path = str(tmp_path / "out")
    df.write.format("bam").option("header", HEADER).mode("append").save(path)
    back = spark.read.format("bam").load(path)
    assert sorted(back.drop("virt_offset").collect(), key=str) == sorted(df.collect(), key=str)
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == 3 and bam.header_of(str(files[0]))[1] == [("chr1", 1000), ("chr2", 50)]
    one = spark.read.format("bam").load(str(files[0])).collect()
    with files[0].open("rb") as f:
        at = dict(bam.blocks(f))
    r = one[len(one) // 2]
    assert at[r.virt_offset >> 16][(r.virt_offset & 0xFFFF) + 36 :].startswith(r.qname.encode())
    plain = b"".join(at.values())
    for name, data in (("gz.bam", gzip.compress(plain[:999]) + gzip.compress(plain[999:])), ("raw.bam", plain), ("empty.bam", b"")):
        (tmp_path / name).write_bytes(data)
        assert spark.read.format("bam").load(str(tmp_path / name)).count() == (0 if name == "empty.bam" else len(one))
    df.limit(0).write.format("bam").option("header", HEADER).mode("overwrite").save(path)
    assert spark.read.format("bam").load(path).count() == 0
    (tmp_path / "text.bam").write_text("@HD\tVN:1.0\n")
    with pytest.raises(Exception, match="no BAM"):
        spark.read.format("bam").load(str(tmp_path / "text.bam")).collect()
