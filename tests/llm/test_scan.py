import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from adjudex.llm import elias_fano as ef
from adjudex.llm import textscan as ts
from adjudex.llm.near_dedup import band_keys, distinct_shingles, super_minhash

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ \t\né\x0b中", max_size=30)), max_size=8)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_words_are_those_of_the_expression(texts):
    hashes, first = ts.words_of(pa.array(texts, pa.string()))
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    seen = {}
    for h, w in zip(hashes.tolist(), [w for t in texts for w in words(t)]):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_shingle_sets(texts):
    h, bounds = distinct_shingles(pa.array(texts, pa.string()), 3)
    for i, t in enumerate(texts):
        w = words(t)
        expected = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
        assert bounds[i + 1] - bounds[i] == len(expected)


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(5)
    for n in (1, 3, 60, 700):
        gaps = []
        for _ in range(60):
            a = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            shared = max(1, int(0.8 * n))
            sig = super_minhash(np.concatenate([a[:n], a[:shared], a[n : 2 * n - shared]]), np.array([0, n, 2 * n]), 64)
            gaps.append((sig[0] == sig[1]).mean() - shared / (2 * n - shared))
        assert abs(np.mean(gaps)) < 0.03
    assert (super_minhash(np.zeros(0, np.uint64), np.array([0, 0]), 8) == 0xFFFFFFFF).all()


def test_equal_sets_have_equal_bands():
    h = np.arange(50, dtype=np.uint64) * np.uint64(977)
    sig = super_minhash(np.concatenate([h, h[::-1]]), np.array([0, 50, 100]), 20)
    keys = band_keys(sig, 5)
    assert (keys[0] == keys[1]).all() and len(set(keys[0].tolist())) == 4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300), st.lists(st.integers(0, 2**40 + 9), max_size=40))
def test_elias_fano(values, wanted):
    v, w = np.sort(np.array(values, np.int64)), np.sort(np.array(wanted, np.int64))
    e = ef.EliasFano(np.frombuffer(ef.EliasFano.write(v), np.uint8))
    assert (e.all() == v).all()
    place, value = e.successors(w)
    assert (place == np.searchsorted(v, w)).all()
    assert all(x == (v[p] if p < len(v) else -1) for p, x in zip(place, value))
    assert (ef.unpack(ef.pack(v)) == v).all() and (ef.unpack_sorted(ef.pack_sorted(v)) == v).all()


def test_trie_level():
    rng = np.random.default_rng(2)
    pairs = np.unique(np.stack([rng.integers(0, 900, 30000) * 5, rng.integers(0, 4000, 30000)], 1), axis=0)
    c, w = pairs.T
    codes = rng.integers(0, 1 << 12, len(c))
    contexts = np.unique(np.append(c, np.arange(0, 4600, 7)))
    backoffs = rng.integers(0, 1 << 12, len(contexts))
    level = ef.TrieLevel.mapped(ef.TrieLevel.write(c, w, codes, backoffs, 12, contexts))
    place, number = level.find(c, w)
    assert (place == np.arange(len(c))).all() and (level.code(np.arange(len(c))) == codes).all()
    assert (contexts[number] == c).all() and (level.backoff(number) == backoffs[number]).all()
    ask = np.unique(np.stack([rng.integers(0, 4600, 5000), rng.integers(0, 4100, 5000)], 1), axis=0).T
    known = {(a, b): i for i, (a, b) in enumerate(zip(c.tolist(), w.tolist()))}
    assert level.find(*ask)[0].tolist() == [known.get((a, b), -1) for a, b in zip(*(x.tolist() for x in ask))]
    assert [contexts[i] if i >= 0 else -1 for i in level.find(*ask)[1]] == [a if a in set(contexts.tolist()) else -1 for a in ask[0].tolist()]
    empty = ef.TrieLevel.mapped(ef.TrieLevel.write(c[:0], w[:0], codes[:0], backoffs, 12, contexts))
    assert (empty.find(c, w)[0] == -1).all() and (empty.backoff(empty.find(c, w)[1]) == backoffs[np.searchsorted(contexts, c)]).all()


def test_shingles_of_fewer_words_than_one_has():
    words, first = ts.words_of(pa.array(["one two"]))
    h, text = ts.shingle_hashes(words, first, 5)
    assert len(h) == 1 and text.tolist() == [0]
