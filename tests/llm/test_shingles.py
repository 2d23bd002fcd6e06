"""Shingle sets of chunks with fewer words than a shingle has."""

import pytest

from isochron.llm import minhash

from . import brute


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 8])
def test_few_words(k):
    texts = [" ".join("abcdefghij"[:n]) for n in range(11)]
    alone = [minhash.shingle_sets([t.encode()], k)[0] for t in texts]
    assert [len(s) for s in alone] == [len(brute.shingles(t, k)) for t in texts]
    together = minhash.shingle_sets([t.encode() for t in texts], k)
    assert [s.tolist() for s in alone] == [s.tolist() for s in together]


def test_short_text_between_long_ones():
    long = " ".join(f"w{i}" for i in range(minhash.CHUNK // 4))
    assert len(long) > minhash.CHUNK
    for n in range(7):
        short = " ".join("abcdef"[:n])
        sets = minhash.shingle_sets([t.encode() for t in (long, short, long)], 5)
        assert [len(s) for s in sets] == [len(brute.shingles(t, 5)) for t in (long, short, long)]
