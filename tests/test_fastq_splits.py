"""FASTA and FASTQ text in stretches of any size."""

import gzip
import io
import random

import pytest

from readforge.sources import fastq


def text(n, seed, wrap=None, marks=False):
    rng = random.Random(seed)
    out, names = "; comment\n\n", []
    for i in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 5, 40, 90])))
        qual = "".join(rng.choice("@>+I5") if marks else chr(rng.randrange(33, 74)) for _ in seq)
        cut = lambda t: "\n".join(t[k : k + wrap] for k in range(0, len(t), wrap)) if wrap else t
        names.append(f"r{i} some text\n{cut(seq)}" + (f"\n+\n{cut(qual)}" if i % 4 else ""))
        out += ("@" if i % 4 else ">") + names[-1] + "\n"
    return out, names


@pytest.mark.parametrize("wrap", [None, 7])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_split_gives_the_same_records(wrap, end):
    body, names = text(120, 3, wrap)
    data = body.replace("\n", end).encode()
    want = [n.rstrip("\n") for n in names]
    for split in (97, 500, 2500, 1 << 20):
        got = [t for a in range(0, len(data), split) for t in fastq.records(io.BytesIO(data), a, a + split if a + split < len(data) else None)]
        assert [g.rstrip("\n") for g in got] == want


def test_qualities_full_of_marks_are_right_or_an_error():
    body, names = text(60, 5, 6, marks=True)
    data = body.encode()
    for split in (80, 300, 1000, 1 << 20):
        try:
            got = [t for a in range(0, len(data), split) for t in fastq.records(io.BytesIO(data), a, a + split if a + split < len(data) else None)]
        except ValueError as e:
            assert "another split" in str(e) and split < len(data)
            continue
        assert [g.rstrip("\n") for g in got] == [n.rstrip("\n") for n in names]


def test_read(spark, tmp_path):
    body, names = text(200, 9)
    (tmp_path / "a.fq").write_text(body)
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "c.fq").write_text("")
    got = fastq.read(spark, str(tmp_path), 1000)
    assert got.rdd.getNumPartitions() > 5
    rows = [(r.qname, r.description, r.seq, len(r.qual)) for r in got.collect()]
    want = [(n.split()[0], "some text", n.split("\n")[1], len(n.split("\n")[1]) if "\n+" in n else 0) for n in names]
    assert sorted(rows) == sorted(want * 2)
