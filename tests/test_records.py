"""Golden cases for files, CIGAR trimming, MD text and merged mates."""

from pyspark.sql import functions as F

from readforge.functions import numeric as N
from readforge.functions import sequences as S
from readforge.operators import streams
from readforge.sources import fastq


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("junk\nmore junk\n@r1 first read\nACG\nTN.-A\n+r1\n@II\nIII\n>r2\nacgu\n\n@r3\n\n+\n\n@r4\tx y\nAC\n+\n@>\n>r5\nA\n")
    (tmp_path / "b.fq").write_text("")
    got = {r.qname: (r.description, r.seq, r.qual) for r in fastq.read(spark, str(tmp_path)).collect()}
    assert got == {"r1": ("first read", "ACGTNA", [31, 40, 40, 40, 40, 40]), "r2": ("", "acgu", []), "r3": ("", "", []), "r4": ("x y", "AC", [31, 29]), "r5": ("", "A", [])}


def test_trimmed_cigar(spark):
    rows = [("5M3D4M", 4, True, "5M", 0), ("5M3D4M", 5, True, "4M", 0), ("5M3D4M", 5, False, "4M", 8), ("2S3I5M", 2, False, "3S5M", 0), ("2S3I5M", 3, False, "2S5M", 0), ("3M2P4M", 0, True, "3M2P4M", 0), ("3M2P4M", 1, True, "3M3M", 0), ("4M", 9, False, "", 4), ("", 2, True, "", 0), ("3H4M", 1, False, "3M", 1)]
    for cigar, n, back, want, shift in rows:
        text, moved = S.trimmed_cigar(F.lit(cigar), F.lit(n), back)
        assert spark.range(1).select(text, moved).first()[:] == (want, shift), cigar


def test_md(spark):
    for md, want in (("10A5^AC6", "10A5^AC6"), ("0A0C0", "AC"), ("3^A0T2", "3^A0T2"), ("", ""), ("12", "12")):
        assert spark.range(1).select(S.md_text(S.md_ops(F.lit(md)))).first()[0] == want


def test_md_in_normal_form(spark):
    ops = [("num", 2, None), ("num", 3, None), ("del", None, "A"), ("num", 0, None), ("del", None, "C"), ("num", 0, None), ("rep", None, "T"), ("del", None, ""), ("rep", None, "G"), ("num", 0, None)]
    df = spark.createDataFrame([(ops,)], "o array<struct<kind:string,n:bigint,bases:string>>")
    assert df.select(S.md_text(F.col("o"))).first()[0] == "5^AC0TG"


def test_merged(spark):
    arrays = lambda *x: F.array(*[F.lit(v) for v in x])
    one = S.merged(F.lit(5), F.lit("ACGT"), arrays(10, 20, 30, 40), F.lit("CACG"), arrays(5, 6, 50, 8), 50)
    assert [tuple(x) for x in spark.range(1).select(one).first()[0]] == [("A", 10), ("C", 28), ("G", 50), ("T", 46), ("C", 5)]
    assert spark.range(1).select(S.merged(F.lit(0), F.lit("A"), arrays(1), F.lit("A"), arrays(1), 50)).first()[0] == []


def test_numbers(spark):
    p = [-0.1, 0.0, 0.01, 0.5, 0.975, 1.0, 1.1]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(N.inverse_normal(F.col("p"))).collect()]
    assert got[0] != got[0] and got[6] != got[6] and got[1] == -float("inf") and got[5] == float("inf") and abs(got[4] - N.normal_quantile(0.975)) < 1e-8 and got[3] == 0 and abs(got[2] - N.normal_quantile(0.01)) < 1e-8


def test_descents(spark):
    rows = [(i, v) for i, v in enumerate([1, 2, 2, 5, 4, 9, 0, 0, 3])]
    df = spark.createDataFrame(rows, "k int, v int").repartition(3)
    assert streams.descents(df, ["k"], ["v"]).first()[0] == 2
    assert streams.descents(df.limit(0), ["k"], ["v"]).first()[0] == 0
