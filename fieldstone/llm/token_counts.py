"""Token counts: greedy longest-match word pieces, counted by a linear-time automaton.

The vocabulary is a trie with failure links. When a word leaves the trie, the link says from which node to go on and how many
pieces are complete by then, so each character is read once and no piece is ever built. Words are runs of other characters
than ASCII white space, taken as UTF-8 bytes.

Null and empty texts have no tokens. A word that the vocabulary can't spell counts as one unknown token. Repeated rows are
counted row by row, the order of rows and further columns don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import uuid
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordTable, flat, kept, segment_sum, slices, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """First pieces and further pieces from a file of base64 tokens with ranks.

    Tokens that begin with a space open a word. All others continue one, and single bytes do either.
    """
    first, more = set(), set()
    with open(path, "rb") as lines:
        for line in lines:
            if not line.strip():
                continue
            token = base64.b64decode(line.split()[0])
            if token.startswith(b" ") and len(token) > 1:
                first.add(token[1:])
            else:
                more.add(token)
            if len(token) == 1:
                first.add(token)
    return sorted(first), sorted(more)


class PieceAutomaton:
    """Counts the pieces that greedy longest match cuts a word into."""

    def __init__(self, first: Iterable[bytes], more: Iterable[bytes]):
        self.goto: list[dict[int, int]] = [{}, {}]  # 0: at a word's begin, 1: inside a word
        final = [False, False]
        for root, pieces in ((0, first), (1, more)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.goto[node].setdefault(c, len(self.goto))
                    if node == len(self.goto):
                        self.goto.append({})
                        final.append(False)
                final[node] = True
        self.fail = [-1] * len(self.goto)
        self.done = [0] * len(self.goto)  # pieces that are complete when the failure link is taken
        waiting = deque([0, 1])
        while waiting:
            parent = waiting.popleft()
            for c, node in self.goto[parent].items():
                waiting.append(node)
                if final[node]:
                    self.fail[node], self.done[node] = 1, 1
                    continue
                at, n = self.fail[parent], self.done[parent]
                while at >= 0 and c not in self.goto[at]:
                    n += self.done[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.done[node] = self.goto[at][c], n

    def count(self, word: bytes) -> int:
        goto, fail, done = self.goto, self.fail, self.done
        node = n = 0
        for c in word:
            while (to := goto[node].get(c)) is None:
                n += done[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node != 1:
            n += done[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def count_tokens(docs: DataFrame, vocabulary: tuple[list[bytes], list[bytes]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words and n_tokens of each row's whole text. The vocabulary (a file, so of fixed size) goes to every executor."""
    spark = docs.sparkSession
    shared, version = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    schema = f"row_key {docs.schema[key].dataType.simpleString()}, n_words long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def build() -> WordTable:
            count = PieceAutomaton(*shared.value).count
            return WordTable(lambda words: np.fromiter(map(count, words), np.int64, len(words)))

        lengths = kept("pieces", version, build)
        for batch in slices(batches):
            words, offsets = flat([(x or "").encode().split() for x in batch.column(1).to_pylist()])
            n = segment_sum(lengths.rows(words), offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n)], names=["row_key", "n_words", "n_tokens"])

    return docs.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("row_key", key)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_vocabulary())


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE: dict[str, str] = {}
