"""Periodic runs against a comparison of every word with the words at every distance."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casejobs.llm import periodic_runs as pr
from casejobs.llm import queries


def brute(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def numbers(words):
    return pr._numbered([w.encode() for w in words], 0)


def test_every_short_sequence():
    """All sequences of two words up to a length of 11, and their runs side by side in one chunk."""
    for n in range(12):
        for x in range(2**n):
            words = [x >> i & 1 for i in range(n)]
            assert pr.find_runs(np.array(words, np.int64)) == brute(words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 8)), max_size=6))
def test_powers_beside_each_other(parts):
    words = [x for word, times, more in parts for x in (word * (times + 1))[: len(word) * times + more]]
    assert pr.find_runs(np.array(words, np.int64)) == brute(words)


def test_long_runs():
    rng = random.Random(4)
    for period in (1, 2, 3, 31, 32, 33, 500, 1023):
        base = [rng.randrange(40) for _ in range(period)]
        words = [100 + i for i in range(17)] + (base * 9)[: 4 * period + rng.randrange(5 * period) + 5] + [200 + i for i in range(9)]
        assert pr.find_runs(np.array(words, np.int64)) == brute(words)
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 1200:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for text in (fibonacci[-1], "a" * 1200, "ab" * 300 + "a" * 9 + "ba" * 200):
        assert pr.find_runs(numbers(text)) == brute(text)


@pytest.mark.parametrize("chunk", [100_000, 1, 40])
def test_rows_and_edges(spark, monkeypatch, chunk):
    monkeypatch.setattr(pr, "CHUNK_WORDS", chunk)
    rng = random.Random(8)
    texts = [None, "", " \t\r\n\x0b\x0c ", "a", "a " * 6, "a a a a a", "x  y\nx y\tx y x\x0by", "é 中 é 中 é 中 é 中 é 中", "a b " * 30, "A a " * 4, "w" * 50_000 + " v" * 7, "\x1ca \x1ca \x1ca \x1ca \x1ca \x1ca"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(150)] + ["a a a a"] * 3  # runs of neighbours never join
    texts += [" ".join(f"{rng.randrange(9)}" for _ in range(3_000))]
    rows = [(i if i % 9 else None, t, 7, "x", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string, runs int, collapsed string, n_words string")
    got = pr.periodic_runs(df)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"] and pr.periodic_runs(df.limit(0)).count() == 0
    want = []
    for doc_id, text, *_ in rows + rows[:5]:
        words = [w for w in pr_split(text or "")]
        runs = brute(words)
        want.append(repr((doc_id, len(words), runs, " ".join(kept(words, runs)))))
    assert sorted(repr((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in got.collect()) == sorted(want)


def pr_split(text):
    """Words outside the six blanks only: str.split would cut at others, too."""
    out, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def test_repeated_words_of_the_query():
    import zlib

    for doc_id in range(400):
        for n in (0, 1, 7, 500):
            at = queries.repeated_words(doc_id, n)
            h = zlib.crc32(str(doc_id).encode())
            if h % 10 or n == 0:
                assert at is None
                continue
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            assert at.tolist() == [i if i < a else a + (i - a) % p for i in range(n)]
    assert queries.repeated_words(None, 50) is None
