"""Sums over files that arrive: each file counts once, whatever batches it comes in, also after a restart."""

from pyspark.sql import functions as F

from readforge.streaming import statistics


def test_sums_go_on_after_a_restart(spark, tmp_path):
    line = "r{0}\t0\tref{1}\t5\t{0}\t4M\t*\t0\t0\tACGT\tIIII"
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    total = lambda: {r.ref_id: (r.n, r.q) for r in statistics.totals(spark, out, ["ref_id"], ["n", "q"]).collect()}

    def run():
        statistics.accumulate(statistics.sam_stream(spark, str(folder), 1), out, ["ref_id"], {"n": F.count("*"), "q": F.sum("mapq")}, once=True).awaitTermination()

    for k in range(3):
        (folder / f"{k}.sam").write_text("@CO\thead\n" + "\n".join(line.format(i, i % 2) for i in range(k * 10, k * 10 + 10)) + "\n")
    run()
    assert total() == {0: (15, sum(range(0, 30, 2))), 1: (15, sum(range(1, 30, 2)))}
    run()
    assert total() == {0: (15, sum(range(0, 30, 2))), 1: (15, sum(range(1, 30, 2)))}
    (folder / "late.sam").write_text(line.format(7, 1) + "\n")
    run()
    assert total() == {0: (15, sum(range(0, 30, 2))), 1: (16, sum(range(1, 30, 2)) + 7)}
