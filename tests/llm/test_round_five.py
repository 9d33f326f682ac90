"""Tokens cut and numbered in Arrow arrays, against the plain form."""

import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from labelweave.llm import langmodel

PIECES = [b"", b" ", b"a", b"Ab", b"\n\t", b"\x0b\x0c\r", b"\x00", b"\x1f", b"\x85", b"\xa0", "É ß".encode(), b"\xff\xfe", b"Z z"]


def _texts(rng, n):
    return [None if rng.random() < 0.1 else b"".join(PIECES[i] for i in rng.integers(0, len(PIECES), rng.integers(0, 12))) for _ in range(n)]


def _words(listed, head):
    words = langmodel.Words.__new__(langmodel.Words)
    words.words, words.head = listed, head
    return words


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
@pytest.mark.parametrize("group", [1, 7, 1 << 20])
def test_token_arrays_equal_the_plain_tokens(monkeypatch, kind, group):
    monkeypatch.setattr(langmodel, "GROUP_BYTES", group)
    rng = np.random.default_rng(group)
    for texts in ([], [None], [b""], [b"", None, b" "], [b"a", b"b"], _texts(rng, 300)):
        whole = pa.array([b"x y", *texts, b"z"], kind)
        for column in (pa.array(texts, kind), whole.slice(1, len(texts))):
            got = [(tokens.to_pylist(), sizes) for tokens, sizes in langmodel.token_arrays(column)]
            assert [t for tokens, _ in got for t in tokens] == [t for text in texts for t in langmodel.tokens_of(text)]
            assert [n for _, sizes in got for n in sizes] == [len(langmodel.tokens_of(text)) for text in texts]


@pytest.mark.parametrize("listed", [[], [b"a"], [b"", b"ab", b"a", b"z", b"\x00"]])
def test_numbers_and_unlisted_words_equal_the_plain_loop(monkeypatch, listed):
    monkeypatch.setattr(langmodel, "GROUP_BYTES", 40)
    words, texts = _words(listed, min(2, len(listed))), _texts(np.random.default_rng(5), 200)
    numbering = words.numbering()
    plain = [[numbering.get(t, words.head) for t in langmodel.tokens_of(text)] for text in texts]
    column = pa.array(texts, pa.binary())
    codes, rare = langmodel._coded_with_rare(column, words, words.listed())
    assert [c.tolist() for c in codes] == plain == [c.tolist() for c in langmodel._coded(column, words, words.listed())]
    assert all(c.dtype == np.int32 for c in codes)
    own = [Counter(t for t in langmodel.tokens_of(text) if t not in numbering) for text in texts]
    assert [{r["word"]: r["m"] for r in row} for row in rare.to_pylist()] == own
    assert [len(row) for row in rare.to_pylist()] == [len(o) for o in own]
    empty = langmodel._coded_with_rare(column.slice(0, 0), words, words.listed())
    assert empty[0] == [] and len(empty[1]) == 0 and empty[1].type == rare.type


def test_numbering_tokens_takes_less_time_than_the_plain_loop():
    """The look-ups of single words took an eighth of the whole job's CPU time."""
    rng = np.random.default_rng(1)
    names = [b"w%d" % i for i in range(200_000)]
    texts = [b" ".join(names[i] for i in np.minimum(rng.zipf(1.3, 500), 300_000) % 200_000) for _ in range(2000)]
    words = _words(names[:150_000], 1024)
    column, listed, numbering = pa.array(texts, pa.binary()), words.listed(), words.numbering()

    def plain():
        return [[numbering.get(t, words.head) for t in langmodel.tokens_of(text)] for text in column.to_pylist()]

    def seconds(work):
        start = time.process_time()
        work()
        return time.process_time() - start

    times = [(seconds(lambda: langmodel._coded(column, words, listed)), seconds(plain)) for _ in range(5)]
    assert min(a for a, _ in times) < min(b for _, b in times)
