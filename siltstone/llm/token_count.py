"""Token counts by a linear longest-match automaton.

Words are cut greedily into the longest pieces of a vocabulary. The vocabulary is a trie over bytes. Every node has a
failure link, the node where matching goes on after the pieces that are then certain have been popped, and the number of
those pieces. A word is read once, byte by byte, and only numbers are added: no piece is ever built. A word's first piece
starts with the space before it, as byte-level vocabularies mark word starts; every byte is a piece, so nothing fails.
"""

from __future__ import annotations

import base64
from collections import deque
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import map_arrow, table, words

#: Distinct words that a task remembers at a time.
REMEMBER = 400_000


class LongestMatch:
    """The automaton of a set of pieces, which holds every single byte."""

    def __init__(self, pieces):
        self.child: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            at = 0
            for byte in piece:
                to = self.child[at].get(byte)
                if to is None:
                    to = self.child[at][byte] = len(self.child)
                    self.child.append({})
                    is_piece.append(False)
                at = to
            is_piece[at] = at > 0
        self.fail, self.pops = [-1] * len(self.child), [0] * len(self.child)
        queue = deque([0])
        while queue:  # by depth: links lead to nodes that are done
            node = queue.popleft()
            for byte, to in self.child[node].items():
                queue.append(to)
                if is_piece[to]:
                    self.fail[to], self.pops[to] = 0, 1
                    continue
                link, popped = self.fail[node], self.pops[node]
                while link >= 0 and byte not in self.child[link]:
                    popped += self.pops[link]
                    link = self.fail[link]
                if link < 0:
                    raise ValueError("every byte has to be a piece")
                self.fail[to], self.pops[to] = self.child[link][byte], popped

    def count(self, word: bytes) -> int:
        """The number of pieces of a word."""
        child, fail, pops = self.child, self.fail, self.pops
        node = total = 0
        for byte in word:
            while (to := child[node].get(byte)) is None:
                total += pops[node]
                node = fail[node]
            node = to
        while node:
            total += pops[node]
            node = fail[node]
        return total


class Counts(dict):
    """Piece counts of words, remembered up to a bound."""

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = n = self.automaton.count(b" " + word)
        return n


@lru_cache(2)
def automaton(ranks_path: str) -> LongestMatch:
    with open(ranks_path, "rb") as lines:
        return LongestMatch([base64.b64decode(line.split()[0]) for line in lines])


def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_counts(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row of docs(doc_id, text).

    Null, empty and wordless texts have 0 of each; texts may have any length. Repeated rows and null ids are counted like others. An empty table
    gives no rows. Other columns are not read.
    """
    path = ranks_path or ranks_file()

    def run(batches):
        counts = Counts(automaton(path))
        for batch in batches:
            found = [words(t.as_py()) for t in batch.column(1)]
            yield [batch.column(0), [len(w) for w in found], [sum(map(counts.__getitem__, w)) for w in found]]

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_words long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 8 over the whole documents table."""
    return token_counts(table(spark, sf_dir, "documents"))
