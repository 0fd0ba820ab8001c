"""Byte-level BPE by corpus-level merge replay.

Distinct pre-tokens of a batch are laid end to end; an inverted index from merge rank to the positions of its pairs is
replayed in rank order over all words at once, in arrays, and a merge touches only its two neighbours.  Words once encoded are kept
in a table of bounded size; when it is full a new one begins, which takes what is still in use from the last, so common
words are replayed once a task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BASE

#: Characters that are cut into words together, words kept in the table, and words taken together from longer texts.
CHUNK_CHARS, TABLE_WORDS, LONG_WORDS = 2_000_000, 200_000, 200_000
#: Blocks of ranks that the replay takes one after the other.
BLOCKS = 24
_KEEP: dict[tuple, Codec] = {}


def _slots(pairs: dict[int, int]) -> list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]]:
    """Tables in which numpy looks pairs up: seed, shift, keys and ranks; what finds its slot taken goes to the next table."""
    out, seed = [], BASE
    key, rank = np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
    while len(key):
        bits = max(8, (4 * len(key)).bit_length())
        at = (key * np.uint64(seed) >> np.uint64(64 - bits)).astype(np.int64)
        known, ranks = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.full(1 << bits, np.iinfo(np.int64).max)
        _, one = np.unique(at, return_index=True)
        known[at[one]], ranks[at[one]] = key[one], rank[one]
        out.append((np.uint64(seed), np.uint64(64 - bits), known, ranks))
        rest = np.ones(len(key), bool)
        rest[one] = False
        key, rank, seed = key[rest], rank[rest], seed * BASE & (1 << 64) - 1
    return out


class Codec:
    """Encodes words by the ranks of a vocabulary file in tiktoken's text form."""

    def __init__(self, data: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.ranks, self.cut = ranks, regex.compile(pattern)
        self.text = {str(r): t for t, r in ranks.items()}
        self.base = [ranks.get(bytes([i]), -1) for i in range(256)]
        self.shift = max(ranks.values(), default=1).bit_length() + 1
        self.gap = 1 << (self.shift - 1)  # stands between words: in no pair
        self.pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    self.pairs[a << self.shift | b] = r
        self.bytes = np.array(self.base, np.int64)
        self.slots = _slots(self.pairs)
        # ends of the blocks of ranks: low ranks are met most often
        self.blocks = np.unique((max(ranks.values(), default=1) * (np.arange(1, BLOCKS) / BLOCKS) ** 2).astype(np.int64))
        self.names = {r: str(r) for r in ranks.values()}
        self.table: dict[str, str] = {}
        self.last: dict[str, str] = {}

    def _alone(self, word: bytes) -> list[int]:
        """The rule itself, for the few words in which a merge makes a pair of lower rank: lowest first, then leftmost."""
        out = [self.base[b] for b in word]
        while True:
            best = min(((self.pairs.get(a << self.shift | b, self.gap), i) for i, (a, b) in enumerate(zip(out, out[1:]))), default=(self.gap, 0))
            if best[0] == self.gap:
                return out
            out[best[1] : best[1] + 2] = [best[0]]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which each pair of symbols merges, or `gap`."""
        key = (a << self.shift | b).astype(np.uint64)
        out = np.full(len(key), self.gap, np.int64)
        for seed, shift, known, ranks in self.slots:
            at = (key * seed >> shift).astype(np.int64)
            np.copyto(out, ranks[at], where=known[at] == key)
        return out

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word.

        The index has the positions of pairs by blocks of ranks, lowest first.  In a block each word merges its lowest
        rank wherever it stands, all words at once, until no pair of the block is left.
        """
        gap = self.gap
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes + 1)
        sym = np.full(int(ends[-1]) + 1, gap, np.int64)
        plain = np.ones(len(sym), bool)
        plain[0] = plain[ends] = False
        sym[plain] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), sizes + 1)
        of = np.concatenate([[0], of])
        nxt, prv = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        rank = np.append(self._rank(sym[:-1], sym[1:]), gap)
        live = plain.copy()
        odd = np.zeros(len(words), bool)
        index: list[list[np.ndarray]] = [[] for _ in range(len(self.blocks) + 1)]
        limits = [0, *self.blocks.tolist(), gap]

        def enter(at: np.ndarray) -> None:
            to = np.searchsorted(self.blocks, rank[at], side="right")
            order = np.argsort(to, kind="stable")
            at, to = at[order], to[order]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))[: len(to)]
            for k, part in zip(to[first].tolist(), np.split(at, first[1:])):
                index[k].append(part)

        enter(np.flatnonzero(rank < gap))
        for k in range(len(index)):
            while index[k]:
                at = np.concatenate(index[k])
                index[k] = []
                # what changed since has been entered again
                at = np.sort(at[(rank[at] >= limits[k]) & (rank[at] < limits[k + 1])])
                at = at[np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]]
                if not len(at):
                    break
                word = of[at]
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                lowest = np.repeat(np.minimum.reduceat(rank[at], first), np.diff(np.append(first, len(at))))
                chosen = rank[at] == lowest
                index[k].append(at[~chosen])
                at = at[chosen]
                # of pairs that overlap, as in a run of one symbol, every other one from the left
                behind = np.concatenate([[False], nxt[at[:-1]] == at[1:]])
                if behind.any():
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(behind, 0, place))) % 2 == 0]
                gone, was = nxt[at], rank[at]
                sym[at] = was
                live[gone], rank[gone] = False, gap
                nxt[at] = nxt[gone]
                prv[nxt[at]] = at
                new = np.concatenate([prv[at], at])
                rank[new] = self._rank(sym[new], sym[nxt[new]])
                found = rank[new] < np.concatenate([was, was])
                odd[of[np.concatenate([at, at])[found]]] = True
                new = new[live[new] & (rank[new] < gap)]
                enter(new[~odd[of[new]]])
        left = np.flatnonzero(live)
        ids = sym[left].tolist()
        stops = np.searchsorted(left, ends).tolist()
        out = [ids[i:j] for i, j in zip([0, *stops[:-1]], stops)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._alone(words[i])
        return out

    def learn(self, words: set[str]) -> None:
        """Put the ids of words, joined by commas, into the table."""
        table, ranks = self.table, self.ranks
        new = [w for w in words if w not in table]
        if len(table) + len(new) > TABLE_WORDS:
            self.last, self.table = table, {}
            table, new = self.table, words
        left, coded, last, names = [], [], self.last, self.names
        for w in new:
            known = last.get(w)
            if known is not None:
                table[w] = known
                continue
            b = w.encode()
            if b in ranks:
                table[w] = str(ranks[b])
            else:
                left.append(w)
                coded.append(b)
        for w, ids in zip(left, self.replay(coded)):
            table[w] = ",".join([names[i] for i in ids])

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, str, bool]]:
        """(which text, ids joined by commas, whether this ends the text), in order; every text has at least one."""
        i = 0
        while i < len(texts):
            if len(texts[i]) > CHUNK_CHARS:
                it = (m.group() for m in self.cut.finditer(texts[i]))
                while block := list(islice(it, LONG_WORDS)):
                    self.learn(set(block))
                    yield i, ",".join([self.table[w] for w in block]), False
                yield i, "", True
                i += 1
                continue
            j, size = i, 0
            while j < len(texts) and size + len(texts[j]) <= CHUNK_CHARS:
                size += len(texts[j])
                j += 1
            cut = [self.cut.findall(t) for t in texts[i:j]]
            self.learn({w for words in cut for w in words})
            for k, words in enumerate(cut):
                yield i + k, ",".join([self.table[w] for w in words]), True
            i = j


def _codec(data: bytes, pattern: str) -> Codec:
    key = (hashlib.sha1(data).digest(), pattern)
    if key not in _KEEP:
        _KEEP.clear()
        _KEEP[key] = Codec(data, pattern)
    return _KEEP[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens and, as asked for by `outputs`: ids (array), decoded (binary, from the
    ids), ids_sha256, decoded_sha256 (lowercase hex; of the decimal ids joined by commas, and of the decoded bytes).

    Each match of pattern is encoded by itself, as the tiktoken library does, without special tokens.  Null and empty
    texts have no tokens; digests are then those of nothing.  Texts of any length are taken in blocks of words.
    Repeated rows give repeated results; other columns are not read.  The vocabulary, a file on the driver, is broadcast.
    """
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = {"ids": "array<int>", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(data.value, pattern)
        back = codec.text
        for batch in batches:
            rows, n, ids_hash, raw_hash, ids, raw, first = [], 0, hashlib.sha256(), hashlib.sha256(), [], [], True
            for _, part, ends in codec.pieces(batch["text"].tolist()):
                if part:
                    tokens = part.split(",")
                    plain = b"".join([back[t] for t in tokens])
                    n += len(tokens)
                    ids_hash.update(part.encode() if first else b"," + part.encode())
                    raw_hash.update(plain)
                    first = False
                    if "ids" in outputs:
                        ids.extend(map(int, tokens))
                    if "decoded" in outputs:
                        raw.append(plain)
                if ends:
                    made = {"ids": ids, "decoded": b"".join(raw), "ids_sha256": ids_hash.hexdigest(), "decoded_sha256": raw_hash.hexdigest()}
                    rows.append((n, *[made[k] for k in outputs]))
                    n, ids_hash, raw_hash, ids, raw, first = 0, hashlib.sha256(), hashlib.sha256(), [], [], True
            out = pd.DataFrame(rows, columns=["n_tokens", *outputs])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = ", ".join(["doc_id string", "n_tokens bigint", *[f"{k} {kinds[k]}" for k in outputs]])
    side = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return side.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
