import random
from collections import Counter

import numpy as np
import pytest

from adjudex.llm import suffix_dedup as sd
from adjudex.llm import textscan as ts

DOC = "doc_id long, text string, u1 string, pos int"


def brute(rows, length):
    bodies = [(i, (t or "").encode()) for i, t, *_ in rows]
    n = Counter(b[k : k + length] for _, b in bodies for k in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if n[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        edges = [k for k in range(len(b) + 1) if (k < len(b) and gone[k]) != (k > 0 and gone[k - 1])]
        out.append((i, len(b), list(zip(edges[::2], edges[1::2])), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def run(spark, rows, length):
    got = sd.suffix_dedup(spark.createDataFrame([(*r, "clash", 1) for r in rows], DOC).repartition(4), length).collect()
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got), key=str)


def pieces(seed, n):
    """Texts of shared, own, shifted and cut passages, copies, and runs of few letters."""
    r = random.Random(seed)
    word = lambda k, letters: "".join(r.choice(letters) for _ in range(k))
    shared = [word(r.randint(20, 400), "abcdefgh é") for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            s = r.choice(shared)
            a, b = sorted((r.randint(0, len(s)), r.randint(0, len(s))))
            parts += [r.choice([s, s[a:b], s[a:], word(r.randint(0, 60), "abcdefgh é"), word(r.randint(0, 90), "ab")])]
        rows.append((r.choice([i, i, 7]), "".join(parts)))
    return [*rows, *rows[:3], (None, shared[0]), (None, None), (500, ""), (501, "a" * 500), (502, "xy" * 300 + "é")]


@pytest.mark.parametrize(("seed", "length", "classes", "records"), [(1, 200, 10_000, 4096), (2, 40, 3, 5), (3, 7, 0, 4096), (4, 200, 4, 1)])
def test_against_all_strings(spark, monkeypatch, seed, length, classes, records):
    monkeypatch.setattr(sd, "TASK_CLASSES", classes)
    monkeypatch.setattr(sd, "TASK_RECORDS", records)
    rows = pieces(seed, 50)
    assert run(spark, rows, length) == brute(rows, length)


def test_empty_table_and_one_text(spark):
    assert run(spark, [], 200) == []
    assert run(spark, [(1, "own text " * 9)], 200) == [(1, 81, [], ("own text " * 9).encode())]


def test_long_texts_in_pieces_have_the_same_anchors():
    r = np.random.default_rng(1)
    raw = r.integers(97, 100, 20_000, dtype=np.uint8)
    bounds = np.array([0, 30, 30, 18_000, 20_000])
    whole = [np.concatenate(x) for x in zip(*sd._texts(raw, bounds, 200, 1 << 20))]
    for size in (300, 1000, 5000):
        parts = [np.concatenate(x) for x in zip(*sd._texts(raw, bounds, 200, size))]
        assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert ts.SLICE_BYTES >= 2 * 200
