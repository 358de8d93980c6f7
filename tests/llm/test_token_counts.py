import random

import pytest

from fieldstone.llm import token_counts as M


def greedy(word, first, more):
    n, at, pieces = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n, pieces = end, n + 1, more
    return n


@pytest.mark.parametrize("seed", range(30))
def test_automaton_is_greedy_longest_match(seed):
    chance = random.Random(seed)
    word = lambda n: bytes(chance.choice(b"abc") for _ in range(chance.randint(1, n)))
    first, more = {word(5) for _ in range(chance.randint(1, 15))}, {word(5) for _ in range(chance.randint(0, 15))}
    if seed % 2:
        first, more = first | {b"a", b"b", b"c"}, more | {b"a", b"b", b"c"}
    automaton = M.PieceAutomaton(first, more)
    for _ in range(300):
        w = word(14)
        assert automaton.count(w) == greedy(w, first, more), (w, first, more)


def test_vocabulary_file_leaves_no_word_unknown():
    first, more = M.read_vocabulary()
    automaton = M.PieceAutomaton(first, more)
    pieces, rest = set(first), set(more)
    for w in ("hello", "unbelievable", "zqxjk", "né", "日本語", "a" * 300):
        assert automaton.count(w.encode()) == greedy(w.encode(), pieces, rest)


def test_odd_rows(spark, odd_docs, no_docs):
    vocabulary = M.read_vocabulary()
    rows = M.count_tokens(odd_docs, vocabulary).collect()
    assert len(rows) == 9 and rows[0] == rows[1]
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].n_tokens == by_id[3].n_tokens == by_id[4].n_tokens == 0
    assert by_id[5].n_words == 30_000 and by_id[5].n_tokens == 30_000
    assert None in by_id
    assert M.count_tokens(no_docs, vocabulary).count() == 0


def test_query_matches_brute_force(spark):
    first, more = M.read_vocabulary()
    first, more, known = set(first), set(more), {}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()

    def count(text):
        for w in (words := (text or "").encode().split()):
            if w not in known:
                known[w] = greedy(w, first, more)
        return sum(known[w] for w in words)

    got = {r.doc_id: r.n_tokens for r in M.op1_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: count(r.text) for r in docs}
