"""Secret scans: strong patterns by themselves, weak candidates only where complementary parts stand together.

A credential has parts of three roles: an identifier, a secret and an endpoint.  Strong kinds (`assign`, `access`, `hex`)
are always reported.  Weak kinds (`ident`, `opaque`, `endpoint`) are reported only when the roles they lack stand within
REACH code points in the same scope, a stretch of the text between blank lines.  The interval join is a sweep over the
parts of a scope in order of their starts: of each role only the greatest end before a part and the least start after it
matter, so no pairs are made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_name

REACH = 200
STRONG = ["assign", "access", "hex"]
WEAK = ["ident", "opaque", "endpoint"]
KINDS = STRONG + WEAK
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "opaque": "secret", "endpoint": "endpoint"}
#: The roles that must stand near a weak candidate.
NEEDS = {"ident": ["secret"], "opaque": ["identifier"], "endpoint": ["identifier", "secret"]}

_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_IDENT_WORDS = ("user", "login", "account", "clientid", "client_id")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}")
_IDENT = re.compile(r"""(user(?:name|id|_id)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]+)""", re.IGNORECASE | re.ASCII)
_ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20"'<>]+""")
_OPAQUE = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_BREAK = re.compile(r"\n[\x09\x0D\x20]*\n")


def _spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every candidate of a text, in order."""
    low = text.lower()
    out = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if any(w in low for w in _IDENT_WORDS):
        out += [(m.start(), 3, m.end()) for m in _IDENT.finditer(text) if m.end(2) - m.start(2) >= 3]
    if "://" in text:
        out += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    runs = [m for m in _OPAQUE.finditer(text) if any("0" <= c <= "9" for c in m[0]) and any("A" <= c <= "Z" for c in m[0]) and any("a" <= c <= "z" for c in m[0])]
    if runs:  # what stands in another part is no part of its own
        taken, edge, i = sorted((a, b) for a, _, b in out), 0, 0
        for m in runs:
            while i < len(taken) and taken[i][0] < m.end():
                edge, i = max(edge, taken[i][1]), i + 1
            if edge <= m.start():
                out.append((m.start(), 4, m.end()))
    return sorted(out)


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, parts) for each row: parts has start, kind, end and scope of every strong match and weak candidate."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for t in batch["_t"]:
                spans = _spans(t)
                breaks, own, i = [m.end() for m in _BREAK.finditer(t)] if spans else [], [], 0
                for a, k, b in spans:
                    while i < len(breaks) and breaks[i] <= a:
                        i += 1
                    own.append({"start": a, "kind": k, "end": b, "scope": i})
                found.append(own)
            yield pd.DataFrame({"doc_id": batch["_id"], "key": batch["key"], "parts": found})

    side = docs.select(F.col(doc_id).cast("string").alias("_id"), row_name(F.col(doc_id), F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = side.mapInPandas(run, "doc_id string, key string, parts array<struct<start:int,kind:int,end:int,scope:int>>")
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(key, more): for each key the weak candidates of `parts` that stand within reach of the parts they lack."""
    weak = F.exists("parts", lambda p: p["kind"] >= len(STRONG)) & (F.size("parts") > 1)
    each = found.where(weak).select("key", F.explode("parts").alias("p")).select("key", "p.*").distinct()
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind") + 1)
    scope = Window.partitionBy("key", "scope").rowsBetween(Window.unboundedPreceding, -1)
    before, after = scope.orderBy("start", "kind"), scope.orderBy(F.desc("start"), F.desc("kind"))
    each = each.repartition("key").withColumn("role", role)

    def near(r: str):
        last = F.max(F.when(F.col("role") == r, F.col("end"))).over(before)
        next_ = F.min(F.when(F.col("role") == r, F.col("start"))).over(after)
        return (F.coalesce(F.col("start") - last, F.lit(reach + 1)) <= reach) | (F.coalesce(next_ - F.col("end"), F.lit(reach + 1)) <= reach)

    each = each.withColumns({"near_identifier": near("identifier"), "near_secret": near("secret")})
    keep = F.lit(False)
    for k, needs in NEEDS.items():
        test = F.col("kind") == KINDS.index(k)
        for r in needs:
            test = test & F.col(f"near_{r}")
        keep = keep | test
    return each.where(keep).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("more"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per row of docs: doc_id, key, spans (array of start, kind number, end: strong and linked weak ones, by start,
    then kind).

    Positions are code points, ends exclusive.  A null text is an empty one, and null or empty texts have no spans.  Rows
    that repeat (equal id and text) each get the same result.  Whole texts are read, however long; a text's candidates are
    bounded by its length.  Matches of one kind never overlap; those of different kinds may, but for `opaque`, which gives
    way.  Parts that overlap are at distance 0.  Other columns are not read.
    """
    found = materialize(parts(docs, doc_id, text), "credential-parts")
    own = F.transform(F.filter("parts", lambda p: p["kind"] < len(STRONG)), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    rows = found.join(linked(found, reach), "key", "left")
    return rows.select("doc_id", "key", F.array_sort(F.when(F.col("more").isNull(), own).otherwise(F.concat(own, "more"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text, n_linked, from rows of `scan`."""
    name = lambda p: F.element_at(F.array(*[F.lit(k) for k in KINDS]), p["kind"] + 1)
    joined = lambda x: F.array_join(F.transform(x, lambda p: F.concat_ws(":", name(p), p["start"].cast("string"), p["end"].cast("string"))), ",")
    base = F.filter("spans", lambda p: p["kind"] < len(STRONG))
    of_kind = lambda i: F.size(F.filter("spans", lambda p: p["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(STRONG)]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_linked"),
    )
