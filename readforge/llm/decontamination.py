"""Benchmark decontamination by winnowing, in DataFrame operations only.

Both sides are winnowed: of the k-grams of each window of `window` words the least hash is kept, one fingerprint for each
run of windows in which it does not change.  Equal windows have equal minima, so every shared span of at least `window`
words has a fingerprint in common.  Fingerprints of the documents are joined with those of the benchmark; only where they
meet is a fingerprint extended to the windows of its run, which are compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, lower_ascii, row_name, small_enough

WINDOW = 13
GRAM = 7
#: Benchmark windows up to this many are broadcast (16 bytes each in the join's table); more are joined by shuffle.
BROADCAST_ROWS = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the lower-cased text: runs of letters, digits and non-ASCII characters; none for null."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), SEPARATORS), ""), F.array().cast("array<string>"))


def _zip_shift(col: str, shift: int, fn) -> Column:
    """fn(x[i], x[i + shift]) for each i at which both exist."""
    n = F.greatest(F.size(col) - shift, F.lit(0))
    return F.zip_with(F.slice(F.col(col), F.lit(1), n), F.slice(F.col(col), F.lit(shift + 1), n), fn)


def _prints(df: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """df with `_words` → one row for each run of windows of `_len` words, for all lengths in one pass, whose least k-gram
    hash `_print` is the same: the windows start at `_start` to `_end` - 1 (from 0).  Shorter texts give none."""
    kept = df.columns
    df = df.withColumn("_g", F.transform("_words", lambda w: F.xxhash64(w)))

    def spread(col: str, length: int, fn) -> str:
        """Name of the column of fn over col[i .. i + length - 1], made from that of about half the length."""
        nonlocal df
        name = f"{col}_{length}"
        if length == 1:
            return col
        if name not in df.columns:
            half = 1 << ((length - 1).bit_length() - 1)
            part = spread(col, half, fn)
            df = df.withColumn(name, _zip_shift(part, length - half, fn))
        return name

    runs = []
    for length in lengths:
        grams = spread("_g", min(gram, length), lambda a, b: F.xxhash64(a, b))
        least = spread(grams, length - min(gram, length) + 1, lambda a, b: F.least(a, b))
        at, n = f"_at{length}", F.size(least)
        changes = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1)))  # noqa: B023
        df = df.withColumn(at, F.when(n > 0, changes).otherwise(F.array().cast("array<int>")))
        run = lambda i, j: F.struct(F.lit(length).alias("_len"), i.alias("_start"), F.coalesce(F.get(at, j + 1), n).alias("_end"), F.get(least, i).alias("_print"))  # noqa: B023, E731
        runs.append(F.transform(at, run))
    # the outer form: for the inner one the optimizer copies the whole expression into a filter, and it grows as 4^steps
    return df.select(*kept, F.explode_outer(F.concat(*runs)).alias("_run")).where(F.col("_run").isNotNull()).select(*kept, "_run.*")


def _window_texts(runs: DataFrame, *kept: str) -> DataFrame:
    """One row for each window of the runs: `_len`, `_start`, `_text`."""
    at = runs.select(*kept, "_words", "_len", F.explode(F.sequence("_start", F.col("_end") - 1)).alias("_start"))
    return at.select(*kept, "_len", "_start", F.array_join(F.slice("_words", F.col("_start") + 1, F.col("_len")), " ").alias("_text"))


def hits(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """`_key`, `_start`, `_len` and `_owners` (a class of items with the same owners) of each benchmark window in docs.

    The second result maps `_owners` to `item`.
    """
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("_item"), words(F.col(item_text)).alias("_words"))
    items = items.where(F.size("_words") > 0)
    short = [r[0] for r in items.where(F.size("_words") < window).select(F.size("_words")).distinct().collect()]  # at most window - 1 numbers
    lengths = [window, *sorted(short)]
    own = _prints(items, lengths, gram).where(F.col("_len") == F.least(F.size("_words"), F.lit(window)))
    own = _window_texts(own, "_item", "_print").groupBy("_len", "_text").agg(F.first("_print").alias("_print"), F.array_sort(F.collect_set("_item")).alias("_items"))
    own = own.withColumn("_owners", F.xxhash64(F.array_join("_items", "\x00")))
    few = small_enough(own, BROADCAST_ROWS)
    prints, texts = own.select("_len", "_print").distinct(), own.select("_len", "_text", "_owners")
    side = docs.select("_key", words(F.col(text)).alias("_words"))
    if few:
        met = _prints(side, lengths, gram).join(F.broadcast(prints), ["_len", "_print"])
        texts = F.broadcast(texts)
    else:  # first to the documents with any hit, then to the fingerprints
        some = _prints(side, lengths, gram).select("_key", "_len", "_print").distinct().join(prints, ["_len", "_print"], "left_semi").select("_key").distinct()
        met = _prints(side.join(some, "_key", "left_semi"), lengths, gram).join(prints, ["_len", "_print"])
    at = _window_texts(met, "_key").distinct().join(texts, ["_len", "_text"]).select("_key", "_start", "_len", "_owners")
    return at, own.dropDuplicates(["_owners"]).select("_owners", F.explode("_items").alias("_item"))


def _covered(spans: Column) -> Column:
    """Number of words in the union of sorted structs (_start, _len)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))

    def step(acc, x):
        end = x["_start"] + x["_len"]
        return F.struct(
            (acc["n"] + F.greatest(end - F.greatest(x["_start"], acc["to"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(end, acc["to"]).alias("to"),
        )

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted list).

    A document word inside any occurrence of a benchmark window is hit; a document is contaminated when a twentieth or
    more of its words are.  Null and empty texts have no words and no hits; items without words have no windows and a
    null item_id reads as the empty string.  Repeated rows give repeated results.  An empty benchmark hits nothing.
    Other columns of docs, whatever their names, are not read.
    """
    docs = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).withColumn("_key", row_name(F.col("_id"), F.col("_t")))
    at, owners = hits(docs, benchmark, "_t", item, item_text, window, gram)
    spans = at.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("_start", "_len"))).alias("_spans")).select("_key", _covered(F.col("_spans")).alias("n_hit"))
    names = at.select("_key", "_owners").distinct().join(owners, "_owners").groupBy("_key").agg(F.array_sort(F.collect_set("_item")).alias("items"))
    per = spans.join(names, "_key")
    out = docs.select("_id", "_key", F.coalesce(F.size(words(F.col("_t"))), F.lit(0)).cast("long").alias("n_words")).join(per, "_key", "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        listed.alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever those are called.

    Null and empty texts stay; of repeated rows all stay or all go; an empty benchmark or table changes nothing.
    """
    keyed = as_rows(docs)
    bad = contamination(keyed.select("_key", "row.text"), benchmark, doc_id="_key").where("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(bad, "_key", "left_anti").select("row.*")
