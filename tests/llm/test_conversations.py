import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from adjudex.llm import ordered_rows
from adjudex.llm.prefix_trie import ordered_turns, prefix_trie, share_openings
from adjudex.llm.structure_repair import across, structure_report

TURNS = "conv_id long, turn long, role string, text string, key int, place string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def made(seed, n, long=False):
    """Conversations with shared openings, repeated rows, ties, nulls, odd roles and blank or open texts."""
    r = random.Random(seed)
    texts = ["Hello.", "Yes!", "no", "", " \n", "a. b", "Why? ", "x\ty.", None]
    rows = []
    for c in [*range(0, n), *range(100, 100 + n), -7, 250]:
        for t in range(r.choice([1, 2, 3, 5, 8])):
            rows.append((c, r.choice([t, t, t, t + 1, None]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), r.choice(texts)))
        if r.random() < 0.3:
            rows += [rows[-1]] * 2
    if long:
        rows += [(9000, t, ("user", "assistant", "tool")[t % 3], r.choice(texts)) for t in range(150)]
    return [(*x, 5, "clash") for x in rows]


def least_edits(rows):
    """(faults, cost, audit, repaired): the least way to each state, tried against the pattern itself, row by row."""
    faults, seen = [], set()
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-")
        seen.add((role, text))

    def state(initials):
        return re.fullmatch("(s?)((?:ua)*)(u?)", initials) and (initials[:1] == "s" and len(initials) == 1, initials == "", initials[-1:] == "u")

    def widened(found):
        """At most two inserts between rows are ever of use."""
        out = dict(found)
        for _ in range(3):
            for k, (cost, audit, turns) in list(out.items()):
                for role in ("user", "assistant"):
                    new = "".join(x[0][:1] for x in turns) + role[0]
                    if state(new):
                        way = (cost + 3, audit + "I", (*turns, (role, "")))
                        if state(new) not in out or way[:2] < out[state(new)][:2]:
                            out[state(new)] = way
        return out

    now = widened({state(""): (0, "", ())})
    for (role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for cost, audit, turns in now.values():
            options = [(4, "D", None)]
            if fault not in "bd":
                more = 3 * (fault == "t")
                options += [(more, "K", role), (3 + more, "R", "user"), (3 + more, "R", "assistant")]
            for price, letter, as_role in options:
                made_turns = turns if as_role is None else (*turns, (as_role, text))
                initials = "".join(x[0][:1] or "?" for x in made_turns)
                if state(initials):
                    way = (cost + price, audit + letter, made_turns)
                    if state(initials) not in after or way[:2] < after[state(initials)][:2]:
                        after[state(initials)] = way
        now = widened(after)
    cost, audit, turns = min(x for x in now.values() if re.fullmatch("(s?(ua)+)?", "".join(t[0][:1] for t in x[2])))
    return faults, cost, audit, "\n".join(f"{a}:{b}" for a, b in turns)


def report(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        own[c]
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own[c] += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for c, found in own.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = [x[0] for x in found if x[0] is not None]
        faults, cost, audit, text = least_edits([x[1:] for x in found])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(found))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha(text))
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_structure_repair_against_brute_force(spark):
    rows = made(1, 60, long=True) + [(None, 1, "user", "Hi.", 1, ""), (None, None, "assistant", "Yo.", 1, "")]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in structure_report(df).collect()}
    assert got == report(rows)


def test_structure_repair_of_a_conversation_whose_rows_all_go(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = structure_report(spark.createDataFrame([(gone, 0, "user", "x", 0, "")], TURNS)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert structure_report(spark.createDataFrame([], TURNS)).count() == 0


def test_segments_find_what_one_search_finds():
    r = random.Random(3)
    for _ in range(300):
        codes = "".join(r.choice("suao") + r.choice("bdt----") for _ in range(r.randint(2, 14)))
        cut = sorted(r.sample(range(len(codes) // 2 + 1), 2))
        parts = [codes[: 2 * cut[0]], codes[2 * cut[0] : 2 * cut[1]], codes[2 * cut[1] :]]
        assert across(parts) == across([codes])


def trie(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        below = [out[x] for x in children[k]]
        saved = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        out[k] = (members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(below), sum(x[5] for x in below) or 1, saved + sum(x[6] for x in below), sha(",".join(map(str, ends[k]))))
    return sorted(out.values(), key=str)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("seed", [5, 6])
def test_prefix_trie_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ordered_rows, "BLOCK", 3)
    rows = made(seed, 40, long=seed == 6)
    rows += [(c, t, role, f"same {t}", 0, "") for c in range(300, 340) for t, role in enumerate(["user", "assistant", "user", "assistant"] * 2)] + [(None, 0, "user", "x", 0, "")]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = prefix_trie(*share_openings(ordered_turns(df)))
    assert got.columns == list(NODE)
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie(rows)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie(*share_openings(ordered_turns(spark.createDataFrame([], TURNS)))).count() == 0


def test_numbers_go_on_across_partitions(spark):
    df = spark.createDataFrame([(1, i) for i in range(500)] + [(2, i) for i in range(3)], "k int, v int").repartition(3)
    got = ordered_rows.numbered(df, "k", [F.col("v")], [F.col("v")], "n")
    assert got.filter("n <> v").isEmpty() and got.count() == 503
