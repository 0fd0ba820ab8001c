"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  A node also has a failure link and the number of pieces that following it pops, both computed
beforehand, so the greedy longest-match length of a word is found in one pass over its characters, without its pieces.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words as the vocabulary's own splitting has them: contractions, letters, single digits, runs of other marks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Words kept in a task's table; distinct words taken at once from long texts.
TABLE_WORDS, CHUNK_CHARS = 400_000, 2_000_000
_KEEP: dict[bytes, Automaton] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 is itself, the rest follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Automaton:
    """Greedy longest-match piece counts over a vocabulary of symbol sequences."""

    def __init__(self, pieces: list[tuple]):
        self.goto: list[dict] = [{}]
        ends = [False]
        for piece in pieces:
            v = 0
            for c in piece:
                if c not in self.goto[v]:
                    self.goto[v][c] = len(self.goto)
                    self.goto.append({})
                    ends.append(False)
                v = self.goto[v][c]
            ends[v] = v != 0
        n = len(self.goto)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = [0]
        for u in queue:
            for c, v in self.goto[u].items():
                queue.append(v)
                if ends[v]:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                z, pops = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.goto[z]:
                    pops += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.goto[z][c], pops

    def count(self, word) -> int:
        """Number of pieces, or -1 if greedy matching leaves a part that is in no piece."""
        goto, fail, pops = self.goto, self.fail, self.pops
        v = n = 0
        for c in word:
            while c not in goto[v]:
                n += pops[v]
                v = fail[v]
                if v < 0:
                    return -1
            v = goto[v][c]
        while v:
            n += pops[v]
            v = fail[v]
            if v < 0:
                return -1
        return n


def load(data: bytes) -> Automaton:
    """Automaton of a vocabulary in the json form of the tokenizers library, with the end mark joined to a word's last letter."""
    key = hashlib.sha1(data).digest()
    if key not in _KEEP:
        _KEEP.clear()
        whole = json.loads(data)
        special = {t["content"] for t in whole.get("added_tokens", [])}
        cut = [(t[: -len(WORD_END)], True) if t.endswith(WORD_END) and t != WORD_END else (t, False) for t in whole["model"]["vocab"] if t not in special]
        _KEEP[key] = Automaton([(*t[:-1], t[-1] + WORD_END) if end else tuple(t) for t, end in cut])
    return _KEEP[key]


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_tokens, n_unknown.

    Texts are lower-cased and cut by PATTERN; a word is its UTF-8 bytes as letters, the last with an end mark, matched greedily.
    A word with a part in no piece counts as one token and as unknown.  Null, empty and blank texts have no words.
    Texts of any length are taken word by word; repeated rows give repeated results; other columns are not read.
    """
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto, cut, letters = load(data.value), regex.compile(PATTERN), byte_letters()
        table: dict[str, int] = {}
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text.lower()
                found = cut.findall(text) if len(text) <= CHUNK_CHARS else (m.group() for m in cut.finditer(text))
                words = tokens = unknown = 0
                for w in found:
                    n = table.get(w)
                    if n is None:
                        if len(table) >= TABLE_WORDS:
                            table.clear()
                        marks = [letters[b] for b in w.encode()]
                        marks[-1] += WORD_END
                        n = table[w] = auto.count(marks)
                    words += 1
                    if n < 0:
                        unknown += 1
                        tokens += 1
                    else:
                        tokens += n
                rows.append((words, tokens, unknown))
            out = pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    kind = docs.schema[doc_id].dataType.simpleString()
    side = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return side.mapInPandas(run, "doc_id string, n_words bigint, n_tokens bigint, n_unknown bigint").withColumn("doc_id", F.col("doc_id").cast(kind))
