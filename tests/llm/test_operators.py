import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from adjudex.llm import bloom, line_dedup, mixing, ngram_lm, toxicity
from adjudex.llm.chat_format import conversation_digests, escape, fingerprint, format_turns, read_segments, turns_of_frame, turns_of_json, unescape
from adjudex.llm.components import components
from adjudex.llm.exact_dedup import exact_dedup
from adjudex.llm.maxscore import Shard, top_k
from adjudex.llm.near_dedup import near_duplicates
from adjudex.llm.toxicity import Chain, fit_chain, score_chain
from adjudex.llm.url_filter import url_filter

DOC = "doc_id long, text string"


def table(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


# Top-k search


def test_top_k_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(0, 0.1, (600, 12))
    v[300:500] = v[0]
    rows = [(i, v[i].tolist()) for i in range(600)] + [(600, None), (601, [None] * 12), (602, [float("nan")] * 12), (None, [0.1] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(5)
    got = defaultdict(list)
    for r in top_k(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    whole = np.floor(v * 1024).astype(int)
    for q in range(0, 600, 100):
        scores = sorted(((-int(whole[q] @ whole[i]), i) for i in range(600) if i != q))[:10]
        assert got[q] == [(-s, i) for s, i in scores]
    assert set(got) == set(range(0, 600, 100))
    blocks = top_k(df, F.col("vec_id") % 100 == 0, 10, query_block=2)
    assert blocks.exceptAll(top_k(df, F.col("vec_id") % 100 == 0, 10)).isEmpty()


def test_top_k_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0, 5.0])], "vec_id long, embedding array<double>")
    assert table(top_k(df, F.col("vec_id") == 0), "vec_id", "score", "rank") == {1: (2048 * 1024, 1)}
    assert top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_top_k_counts_repeated_rows_once(spark):
    rows = [(0, [1.0])] + [(1, [9.0])] * 60 + [(i, [float(i % 7)]) for i in range(2, 20)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), F.col("vec_id") == 0).orderBy("rank").collect()
    want = sorted((-1024 * 1024 * (9 if i == 1 else i % 7), i) for i in range(1, 20))[:10]
    assert [(-r["score"], r["vec_id"]) for r in got] == want


def test_shard_keeps_ties_by_id():
    shard = Shard(np.array([9]), np.array([[1, -1]]), 2)
    for ids in ([5, 7], [3, 9], [1, 8]):
        shard.add(np.array(ids), np.array([[4, 1]] * 2))
    assert shard.results().column("vec_id").to_pylist() == [1, 3]


# Language model


@pytest.mark.parametrize("most", [5, 1 << 20, (1 << 62) - 1])
def test_ngram_distinct_numbers(most):
    values = np.random.default_rng(3).integers(0, most, 500)
    values[::3] = most
    for part in (values, values[:1], values[:0]):
        got, place, inverse = ngram_lm._distinct(part)
        want, want_inverse = np.unique(part, return_inverse=True)
        assert got.tolist() == want.tolist() and inverse.tolist() == want_inverse.tolist()
        assert part[place].tolist() == want.tolist()


def test_ngram_answers_are_taken_without_making_messages_again(monkeypatch):
    """Runs in this process: a chunk's questions come by shard, context and word, and answers are taken by their places alone."""
    token = np.array([0, 1, 0, 1, 2, 0, 1, 3], np.int64)
    word = np.array([11, 5, 8, 7], np.uint64)
    pack = ngram_lm.pack
    chunk = {"held": pack(np.array([0])), "size": pack(np.array([len(token)])), "word": word.tobytes(), "token": pack(token)}
    # The word of hash 7 isn't known; of the others the one of hash 5 is the most frequent in training.
    answer = {11 % 2: [pack(np.array([3, 9, 0])), pack(np.array([2, 1, 0]))], 8 % 2: [pack(np.array([2])), pack(np.array([1]))]}
    state = ngram_lm._State(chunk, {1: answer}, 2, 14, 3, ngram_lm.Settings())
    asked = {k: x for k, x in state.asked(2)}
    pairs = sorted((int(c), int(w), int(n)) for x in asked.values() for c, w, n in zip(x["context"], x["word"], x["trained"]))
    number = state.numbers[state.word_rank].tolist()
    assert number[3] == 0 and len(set(number)) == 4
    want = Counter((number[a], number[b]) for a, b in zip(token.tolist(), token[1:].tolist()))
    assert pairs == sorted((a, b, n) for (a, b), n in want.items())
    for x in asked.values():
        assert list(zip(x["context"], x["word"])) == sorted(zip(x["context"], x["word"]))
    monkeypatch.setattr(ngram_lm._State, "asked", None)
    state.take(2, {k: [pack(np.full(len(x["word"]), 1)), pack(np.arange(1, len(x["word"]) + 1)), pack(x["trained"])] for k, x in asked.items()})
    assert state.gram_count[1:].tolist() == [want[number[a], number[b]] for a, b in zip(token.tolist(), token[1:].tolist())]


@pytest.mark.parametrize("s", [ngram_lm.Settings(), ngram_lm.Settings(chunk_words=3000, hot_context=50, shard_tokens=4000, least=(2, 4))])
def test_model_against_counts(spark, documents, s):
    scores, model = ngram_lm.score_corpus(documents, settings=s)
    texts = {r["doc_id"]: words(r["text"]) + [None] for r in documents.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    count = [Counter() for _ in range(4)]
    for i, w in texts.items():
        if not held[i]:
            for n in (1, 2, 3):
                count[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total, kinds = sum(count[1].values()), len(count[1])
    for r in scores.collect():
        w = texts[r["doc_id"]]
        base = score = 0.0
        for k in range(len(w)):
            p = (count[1][(w[k],)] + 0.5) / (total + 0.5 * (kinds + 1))
            base += math.log10(p)
            for n in (2, 3):
                if k < n - 1 or count[n - 1][tuple(w[k - n + 1 : k])] < s.least[n - 2]:
                    break
                h = tuple(w[k - n + 1 : k])
                p = (count[n][(*h, w[k])] + s.mass[n - 2] * p) / (count[n - 1][h] + s.mass[n - 2])
            score += math.log10(p)
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(w) and r["train_tokens"] == total
        assert r["n_known"] == sum(count[1][(x,)] > 0 for x in w)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 0.004 * len(w)
    assert {r["level"] for r in model.select("level").distinct().collect()} == {1, 2, 3}
    # Single words' probabilities, as the model has them.
    codes = Counter()
    for r in model.filter("level = 1").collect():
        codes.update(ngram_lm.unpack(r["data"][2]).tolist())
    assert codes == Counter(ngram_lm._quantise(np.log10([(c + 0.5) / (total + 0.5 * (kinds + 1)) for c in count[1].values()]), s.bits).tolist())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lm_")]


def test_model_on_odd_tables(spark, odd, empty):
    scores, _ = ngram_lm.score_corpus(odd)
    got = scores.collect()
    assert len(got) == 10 and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert ngram_lm.score_corpus(empty)[0].count() == 0


# Url filter


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.net/fr/", "x.net", None, "http://net/", "ftp://a.org/fr/b#c", "http://a.org/fr", "http://example.com/de/1", "http://notnet/", "http://deep.a.b.example.com/de/", "http://example.net?x", "http://"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, rule string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
    got = url_filter(pages, rules)
    assert got.count() == 13
    assert table(got, "page_id", "host", "path", "rule", "verdict") == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/fr/", "net/", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("net", "/", "net/", "block"),
        5: ("a.org", "/fr/b", "org/fr/", "allow"), 6: ("a.org", "/fr", None, "allow"), 7: ("example.com", "/de/1", "example.com/de/", "block"), 8: ("notnet", "/", None, "allow"),
        9: ("deep.a.b.example.com", "/de/", "example.com/de/", "block"), 10: ("example.net", "", None, "allow"), 11: ("", "", None, "allow"),
    }
    assert url_filter(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter(pages, rules.limit(0)).collect()} == {"allow"}


def test_bloom_filters_pass_all_members(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    n = bloom.blocks_for(3000)
    made = bloom.filter_table(bloom.places(keys, "key", n))
    probe = bloom.marked(spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), "id"), "key", made, n, "p")
    share = table(probe.groupBy((F.col("id") < 3000).alias("member")).agg(F.avg(F.col("p").cast("int")).alias("share")), "member", "share")
    assert share[True] == (1.0,) and share[False][0] < 0.1
    twice = bloom.filter_table(bloom.repeated_places(keys.unionByName(keys.limit(10)), "key", n))
    assert 10 <= bloom.marked(keys, "key", twice, n, "p").filter("p").count() < 20
    words_ = bloom.words_for(3000)
    tested = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), "id").withColumn("w", bloom.filter_words(keys, "key", words_).scalar())
    share = table(tested.withColumn("p", bloom.words_may_contain(F.col("w"), F.col("key"), words_)).groupBy((F.col("id") < 3000).alias("member")).agg(F.avg(F.col("p").cast("int")).alias("share")), "member", "share")
    assert share[True] == (1.0,) and share[False][0] < 0.1


# Lines


def passage(tag, n=9, size=10):
    return [" ".join(f"{tag}{i}x{j}" for j in range(size)) for i in range(n)]


def test_line_dedup_removes_later_passages_only(spark):
    p = passage("p")
    rows = [(1, "\n".join(["start a", *p, "end a"])), (2, "\n".join(["other b", *p, "tail b", "more b"])), (3, "\n".join(passage("q"))), (4, "\n".join(["common line", "own d"])), (5, "\n".join(["common line", "own e"])), (6, "\n".join(p))]
    got = table(line_dedup.line_dedup(spark.createDataFrame(rows, DOC)), "doc_id", "text")
    assert got[1][0] == rows[0][1] and got[3][0] == rows[2][1] and got[4][0] == rows[3][1] and got[5][0] == rows[4][1]
    assert got[2][0].startswith("other b") and got[2][0].endswith("more b") and sum(x in got[2][0] for x in p) <= 2
    assert sum(x in got[6][0] for x in p) <= 1


def test_line_dedup_sees_past_blank_lines(spark):
    """Paragraphs of 40 words, parted by blank lines, are one passage; parted otherwise they are not."""
    p = passage("p", 5, 40)
    rows = [(1, "\n\n".join(p)), (2, "\n".join(["own", *"\n\n".join(p).split("\n"), "end"])), (3, "\n\n\n".join(["x", p[1], p[0], p[3]])), (4, "\n\n".join([p[4], p[2]]))]
    got = table(line_dedup.line_dedup(spark.createDataFrame(rows, DOC)), "doc_id", "text")
    assert got == {1: (rows[0][1],), 2: ("own\nend",), 3: (rows[2][1],), 4: (rows[3][1],)}


def test_line_dedup_takes_short_lines_at_the_ends(spark):
    """Passages of 51 words count whole, whatever lines are before and after them; those of 50 stay."""
    rng = np.random.default_rng(5)

    def line(tag, n):
        return " ".join(f"{tag}{j}" for j in range(n))

    rows, left = [], {}
    for i in range(60):
        # A long line between two short ones, or short lines only.
        p = [line(f"a{i}x", 3), line(f"b{i}x", 44 + (i % 6 > 0)), line(f"c{i}x", 3)] if i % 2 else [line(f"s{i}x{j}y", 7) for j in range(7)] + [line(f"t{i}x", 1 + (i % 6 > 0))]
        rows.append((10 * i, p[1]))
        for k in range(1, 4):
            own = [line(f"o{i}x{k}y", int(rng.integers(1, 5))), line(f"e{i}x{k}y", int(rng.integers(1, 5)))]
            rows.append((10 * i + k, "\n".join([own[0], *p, own[1]])))
            left[10 * i + k] = "\n".join(own) if k > 1 and sum(len(x.split()) for x in p) > 50 else rows[-1][1]
    got = table(line_dedup.line_dedup(spark.createDataFrame(rows, DOC)), "doc_id", "text")
    assert {i: got[i][0] for i in left} == left


def without_repeats(rows, min_words=50):
    """Line dedup by a walk over all lines in the order of (id, place): what is left of each text."""
    lines_seen, pairs_seen, out = set(), set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        worded = [j for j, x in enumerate(lines) if words(x)]
        runs, open_ = [], False
        for k, j in enumerate(worded):
            if lines[j] in lines_seen:
                runs[-1].append(j) if open_ else runs.append([j])
            lines_seen.add(lines[j])
            pair = tuple(lines[j : worded[k + 1] + 1]) if k + 1 < len(worded) else None
            open_ = pair in pairs_seen and bool(runs) and runs[-1][-1] == j
            pairs_seen.add(pair)
        drop = {j for r in runs if sum(len(words(lines[j])) for j in r) > min_words for j in range(r[0], r[-1] + 1)}
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in drop)
    return out


def test_line_dedup_against_a_walk(spark, documents):
    rng = np.random.default_rng(9)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    pool = [" ".join(f"v{rng.integers(0, 12)}" for _ in range(int(rng.integers(1, 16)))) for _ in range(60)]
    for i in range(120):
        at = int(rng.integers(0, 40))
        middle = pool[at : at + int(rng.integers(3, 18))]
        rows.append((10_000 + i, "\n".join(["", *pool[:1], *middle, f"own {i}", *(["", ""] if i % 3 else []), *middle[: i % 5], *rng.choice(pool, i % 4).tolist()])))
    got = table(line_dedup.line_dedup(spark.createDataFrame(rows, DOC).repartition(3)), "doc_id", "text")
    assert {i: t[0] for i, t in got.items()} == without_repeats(rows)
    assert sum(len(t) for _, t in rows) > sum(len(t[0]) for t in got.values())


def test_line_dedup_with_repeated_ids(spark):
    """Rows of one id with unlike texts are documents of their own; equal rows are one."""
    p = passage("p")
    rows = [(1, "\n".join(["a", *p])), (1, "\n".join(["x", "y", "b", *p])), (1, None), (1, "short"), (2, "\n".join(["q", *p])), (2, "\n".join(["q", *p])), (None, "\n".join(p))]
    df = spark.createDataFrame([(i, t, "clash", "r", 1) for i, t in rows], DOC + ", key string, run string, number int")
    for parts in (1, 3):
        got = line_dedup.line_dedup(df.repartition(parts))
        assert got.columns == df.columns
        left = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
        assert [x for x in left if x[0] != 1] == [(0, "\n".join(p)), (2, "q"), (2, "q")]
        of_one = [t for i, t in left if i == 1]
        assert len(of_one) == 4 and "short" in of_one and "" in of_one and sum(p[0] in t for t in of_one) == 1


def test_chunk_boundaries_resist_shifts():
    import pyarrow as pa

    lines = passage("z", 400, 4)
    a = line_dedup.line_chunks(pa.array(["\n".join(lines)]))
    b = line_dedup.line_chunks(pa.array(["\n".join(["new first line", *lines])]))
    assert len(set(a["key"].tolist()) & set(b["key"].tolist())) >= len(a["key"]) - 2
    assert len(set(a["key"].tolist())) == len(a["key"])
    assert 3 < len(lines) / len(a["key"]) < 5


def test_chunks_give_the_text_back():
    import pyarrow as pa

    texts = ["", "a", "a\n", "\n", "\n\nb\n\n", "x\ny", None]
    raw = "".join(t or "" for t in texts).encode()
    c = line_dedup.line_chunks(pa.array(texts))
    for i, t in enumerate(texts):
        own = np.flatnonzero(c["text"] == i)
        assert b"\n".join(raw[c["start"][j] : c["end"][j]] for j in own).decode() == (t or "")
        assert c["number"][own].tolist() == list(range(len(own)))


def test_line_dedup_on_odd_tables(spark, odd, empty):
    got = line_dedup.line_dedup(odd)
    assert got.columns == odd.columns and got.count() == 10
    assert table(got, "doc_id", "text")[1] == (None,)
    assert line_dedup.line_dedup(empty).count() == 0


# Mixing


def budgets_by_hand(supply, weights, total, max_epochs):
    """Budgets of leaves, node by node: full children drop out until the rest can take its shares."""
    held = defaultdict(float)
    for path, n in supply.items():
        for d in range(len(path) + 1):
            held[path[:d]] += n
    budget = {(): min(total, held[()] * max_epochs)}
    for d in range(max(map(len, supply), default=0)):
        for node in [p for p in held if len(p) == d]:
            own = [p for p in held if len(p) == d + 1 and p[:d] == node]
            weight = {p: weights.get(p, held[p] / held[node] if held[node] else 0) for p in own}
            left, open_ = budget[node], {p for p in own if weight[p] > 0 and held[p] > 0}
            budget |= dict.fromkeys(own, 0.0)
            while open_:
                level = left / sum(weight[p] for p in open_)
                full = {p for p in open_ if held[p] * max_epochs <= level * weight[p]}
                budget |= {p: held[p] * max_epochs if p in full else level * weight[p] for p in open_}
                if not full:
                    break
                left -= sum(held[p] * max_epochs for p in full)
                open_ -= full
    return {p: budget[p] for p in supply}


def spark_budgets(spark, supply, weights, total, max_epochs):
    names = [f"l{i}" for i in range(max(map(len, supply), default=1))]
    leaves = spark.createDataFrame([(*p, n) for p, n in supply.items()], ", ".join([*(f"{n} string" for n in names), "n long"]))
    return {tuple(r[n] for n in names): r["budget"] for r in mixing.leaf_budgets(leaves, names, weights, total, max_epochs).collect()}


def test_budgets_go_to_siblings_first(spark):
    supply = {("a", "en"): 100, ("a", "de"): 10, ("b", "en"): 1000}
    weights = {("a",): 0.5, ("b",): 0.5, ("a", "en"): 0.5, ("a", "de"): 0.5}
    assert spark_budgets(spark, supply, weights, 100, 1) == {("a", "en"): 40, ("a", "de"): 10, ("b", "en"): 50}
    assert spark_budgets(spark, supply, weights, 400, 1) == pytest.approx({("a", "en"): 100, ("a", "de"): 10, ("b", "en"): 290})
    assert spark_budgets(spark, supply, weights, 60, 3)[("a", "de")] == 15
    assert spark_budgets(spark, {}, weights, 10, 1) == {}


def test_budgets_against_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    for share, epochs in ((0.3, 1), (0.97, 1), (1.0, 4), (9.0, 2)):
        supply = {(f"d{i % 3}", f"l{i % 7}", f"s{i}"): int(rng.choice([0, 3, 50, 900, 40_000])) for i in range(60)}
        weights = {(f"d{i}",): float(rng.random()) for i in range(3)} | {("d1", f"l{i}"): float(rng.integers(0, 3)) for i in range(7)}
        total = share * sum(supply.values())
        assert spark_budgets(spark, supply, weights, total, epochs) == pytest.approx(budgets_by_hand(supply, weights, total, epochs), rel=1e-9, abs=1e-6)


def hashed(spark, docs, epochs, seed=17):
    """The seeded order's keys, by (id, epoch)."""
    each = docs.select("doc_id").distinct().withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs))))
    return table(each.select(F.struct("doc_id", "epoch").alias("k"), F.xxhash64("doc_id", F.lit(seed), F.col("epoch")).alias("h")), "k", "h")


@pytest.mark.parametrize("limit", [100_000, 0])
def test_mix_against_a_sorted_prefix(spark, monkeypatch, limit):
    """Every row and epoch as a loop over sorted leaves takes them, the plan broadcast or joined."""
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", limit)
    rows = [(i, " ".join(["w"] * (i * 7 % 11)), "ab"[i % 5 == 0], f"s{i % 4}") for i in range(400)] + [(7, "w w", "a", "s3")] * 2 + [(900, None, "c", None), (901, "x", None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, source string").withColumns({n: F.lit(n) for n in ("whole", "rest", "slice", "stop", "__l0", "EPOCH", "n")})
    weights = {("a",): 0.1, ("b",): 0.8}
    got = Counter((r["doc_id"], r["epoch"]) for r in mixing.mix(docs, {"kind": F.col("kind"), "source": F.col("source")}, weights, 0.9, 3).collect())
    leaves = defaultdict(list)
    for i, t, kind, source in rows:
        leaves[kind or "", source or ""].append((i, len((t or "").split())))
    supply = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budget = budgets_by_hand(supply, weights, 0.9 * sum(supply.values()), 3)
    key, want = hashed(spark, docs, 3), Counter()
    for k, v in leaves.items():
        left, n = math.floor(budget[k] + 1e-6), supply[k]
        whole = min(3, left // n) if n else 1
        want.update((i, e) for e in range(whole) for i, _ in v)
        left = left - whole * n if whole < 3 and n else 0
        for h in sorted({key[i, whole] for i, _ in v}) if left > 0 else []:
            same = [(i, m) for i, m in v if key[i, whole] == h]
            left -= sum(m for _, m in same)
            if left < 0:
                break
            want.update((i, whole) for i, _ in same)
    assert got == want


def test_mix_takes_prefixes(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), "ab"[i % 3 == 0]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    weights = {("a",): 0.2, ("b",): 0.8}
    got = mixing.mix(docs, {"kind": F.col("kind")}, weights, 0.9, 3)
    supply = {k: sum(i % 7 for i, _, x in rows if x == k) for k in "ab"}
    budget = budgets_by_hand({(k,): v for k, v in supply.items()}, weights, 0.9 * sum(supply.values()), 3)
    taken = table(got.groupBy("kind").agg(F.sum("n_tokens").alias("n"), F.max("epoch").alias("e")), "kind", "n", "e")
    for k in "ab":
        assert budget[k,] - 6 <= taken[k][0] <= budget[k,] + 1e-6
    assert taken["b"][1] >= 1
    # Within a leaf's last epoch, what is in comes before what is out.
    order = docs.filter("kind = 'a'").withColumn("key", F.xxhash64("doc_id", F.lit(17), F.lit(0))).join(got.filter("kind = 'a' and epoch = 0").select("doc_id", F.lit(1).alias("in")), "doc_id", "left")
    r = order.agg(F.max(F.when(F.col("in") == 1, F.col("key"))).alias("last"), F.min(F.when(F.col("in").isNull(), F.col("key"))).alias("first")).first()
    assert r["last"] < r["first"]


def test_mix_on_odd_tables(spark, odd, empty):
    got = mixing.mix(odd, {"lang": F.col("lang"), "source": F.col("source")}, {}, 1.0, 1)
    assert got.count() == 10 and got.columns == [*odd.columns, "epoch", "n_tokens"]
    assert mixing.mix(empty, {"lang": F.col("lang")}, {}).count() == 0


# Toxicity


def test_chain_finds_held_out_documents(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        toxic, low = i % 9 == 0, i % 5 == 0
        w = [f"w{x}" for x in rng.integers(0, 400, 40)] + (["vile", "nasty"] if toxic else []) + (["buy", "click"] * 3 if low else [])
        rows.append((i, " ".join(rng.permutation(w)), int(low), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, low int, toxic int")
    labels = docs.filter("doc_id < 600").select("doc_id", "low", "toxic")
    chain = fit_chain(docs, labels, ("low", "toxic"), features=64)
    got = score_chain(docs, chain).filter("doc_id >= 600").collect()
    assert all(r["is_toxic"] == bool(r["toxic"]) and r["is_low"] == bool(r["low"]) for r in got)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1


def test_chain_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = score_chain(odd, fit_chain(odd, none, ("toxic",)))
    assert got.count() == 10 and not any(r["is_toxic"] for r in got.collect())
    chain = Chain(("toxic",), np.zeros(0, np.uint64), [np.zeros(1)], [1.0])
    assert score_chain(empty, chain).count() == 0


# Near duplicates


def brute(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return sets, label


def test_near_duplicates_against_all_pairs(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    sets, label = brute(texts, 3, 85)
    got = table(near_duplicates(documents, k=3, percent=85, bands=26, rows=5), "doc_id", "n_shingles", "component_id", "kept")
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in texts}


def test_large_group_of_near_copies(spark):
    """Buckets beyond the pairwise size, whose members link only through each other."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(120, rng.integers(1, 4), replace=False):
            w[j] = f"n{i}x{j}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"z{i}y{j}" for j in range(50))) for i in range(20)]
    _, label = brute(dict(rows), 3, 85)
    got = table(near_duplicates(spark.createDataFrame(rows, DOC), k=3, percent=85, bands=26, rows=5), "doc_id", "component_id")
    assert {i: c[0] for i, c in got.items()} == label


def test_repeated_ids_with_unlike_texts(spark):
    """All texts of an id belong to its component, whichever row has them."""
    a, b, c = (" ".join(f"{t}{i}" for i in range(30)) for t in "abc")
    rows = [(0, b), (1, a), (1, b), (2, a), (5, c), (5, c + " z"), (6, None), (6, c), (7, "")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, DOC)).collect())
    assert got == [(0, 26, 0), (1, 26, 0), (1, 26, 0), (2, 26, 0), (5, 26, 5), (5, 27, 5), (6, 0, 6), (6, 26, 5), (7, 0, 7)]


def test_large_buckets_of_unlike_sizes(spark, monkeypatch):
    """Buckets that pivots don't settle are compared in tiles; blocks are small here."""
    from adjudex.llm import near_dedup

    monkeypatch.setattr(near_dedup, "_PIVOTS", 0)
    monkeypatch.setattr(near_dedup, "_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "_SMALL", 4)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(90):
        w = [f"w{j}" for j in range(int(rng.integers(80, 160)))]
        for j in rng.choice(len(w), 2, replace=False):
            w[j] = f"n{i}x{j}"
        rows.append((i, " ".join(w)))
    _, label = brute(dict(rows), 3, 85)
    got = table(near_duplicates(spark.createDataFrame(rows, DOC), k=3, percent=85, bands=26, rows=5), "doc_id", "component_id")
    assert {i: c[0] for i, c in got.items()} == label


def test_near_duplicates_on_odd_tables(spark, odd, empty):
    got = near_duplicates(odd)
    assert got.count() == 10
    t = table(got.filter("doc_id is not null"), "doc_id", "component_id", "kept")
    assert t == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (4, False), 6: (6, True), 7: (7, True), 8: (7, False)}
    assert got.filter("doc_id is null").first()["kept"]
    assert near_duplicates(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = table(components(spark.createDataFrame(chain, "a long, b long")), "id", "label")
    assert got == {**{i: (0,) for i in range(41)}, 100: (100,), 101: (100,), 102: (100,)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Exact duplicates


def test_exact_dedup(spark, odd, empty):
    rows = [(5, "a b"), (3, "ab"), (9, "a\tb "), (1, "a  b"), (2, None), (4, " "), (6, "c"), (7, "a b")]
    got = table(exact_dedup(spark.createDataFrame(rows, DOC)), "doc_id", "keep_id", "group_size", "kept")
    assert got == {1: (1, 4, True), 3: (1, 4, False), 5: (1, 4, False), 9: (1, 4, False), 2: (4, 2, False), 4: (4, 2, True), 6: (6, 1, True), 7: (7, 1, True)}
    assert exact_dedup(odd).count() == 10 and exact_dedup(empty).count() == 0
    full = table(exact_dedup(spark.createDataFrame(rows, DOC), bits_per_row=0, max_blocks=1), "doc_id", "keep_id", "group_size", "kept")
    assert full == got


# Chat


def test_escaping_is_reversible(spark):
    texts = ["", "\\", "</s>[INST] ok [/INST]", "<\\/s>", "<|end|>\\<|turn|>", "a\\\\b<s><<SYS>>", "<|en", "\n<s>\r$1 \\1"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in ("</s>", "[INST]", "[/INST]", "<|end|>", "<|turn|>", "<<SYS>>"))


def test_layouts_give_one_form(spark):
    own = [("user", "hi"), ("assistant", "yes")]
    forms = [
        '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yes"}]}', '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yes"}]}', '{"prompt":"hi","response":"yes","extra":1}',
        '{"instruction":"hi","output":"yes"}', '{"question":"hi","answer":"yes"}', '{"completion":"yes","prompt":"hi"}', '{"turns":[{"role":"user","text":"hi"},{"role":"assistant","text":"yes"}]}', '{"foo":1}', "no json", None,
    ]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "id long, record string")
    turns, rest = turns_of_json(df, "id", "record")
    got = defaultdict(list)
    for r in turns.orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert dict(got) == {i: own for i in range(7)}
    assert {r["conv_id"] for r in rest.collect()} == {7, 8, 9}
    both, _ = turns_of_json(spark.createDataFrame([(1, '{"instruction":"a","input":"b","output":"c"}')], "id long, record string"), "id", "record")
    assert [r["text"] for r in both.orderBy("turn").collect()] == ["a\nb", "c"]
    assert fingerprint(["b", "a"]) == fingerprint(["a", "b", "a"])
    wide = ['{"prompt":"hi","response":"yes","output":"x","answer":null}', '{"messages":[{"role":"user"},{"role":"assistant","content":"yes"}],"prompt":"no"}', '{"messages":[]}', '{"prompt":"a","answer":"b"}']
    turns, rest = turns_of_json(spark.createDataFrame([(i, f) for i, f in enumerate(wide)], "id long, record string"), "id", "record")
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in turns.collect())
    assert got == [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", ""), (1, 1, "assistant", "yes")]
    assert {r["conv_id"] for r in rest.collect()} == {2, 3}


def test_columns_that_other_layouts_use_too(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = sorted(map(tuple, turns_of_frame(df, "conv_id").collect()))
    for extra in (["prompt"], ["response", "input"], ["system", "prompt", "response"], ["instruction", "output", "messages"], ["conversations", "segment"]):
        assert sorted(map(tuple, turns_of_frame(df.withColumns({c: F.lit("x") for c in extra}), "conv_id").collect())) == plain


def test_formatting_reads_back(spark):
    rows = [(1, 1, "assistant", "<s>x"), (1, 0, "user", None), (2, 0, None, "hm"), (1, 2, "assistant", "y\\"), (3, 5, "assistant", ""), (3, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    turns = turns_of_frame(df, "conv_id")
    back = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in read_segments(format_turns(turns)).collect())
    assert back == sorted((c, t, r or "", x or "") for c, t, r, x in rows)
    d = table(conversation_digests(format_turns(turns)), "conv_id", "n_turns", "loss_chars")
    assert d == {1: (3, 6), 2: (1, 0), 3: (2, 0)}
    assert conversation_digests(format_turns(turns.limit(0))).count() == 0
    with pytest.raises(ValueError):
        turns_of_frame(spark.range(1), "id")


def test_a_fit_takes_one_text_of_a_repeated_id(spark, monkeypatch):
    from adjudex.llm import toxicity

    seen = []
    whole = toxicity._distinct_words
    monkeypatch.setattr(toxicity, "_distinct_words", lambda df: seen.append(df.count()) or whole(df))
    docs = spark.createDataFrame([(i, f"text {i} {j}") for i in range(5) for j in range(60)] + [(9, None)], DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(9, 1)], "doc_id long, bad int")
    fit_chain(docs, labels, ("bad",), sample_rows=6)
    assert seen == [6]


def test_chain_fits_in_few_tasks_and_little_memory(spark, monkeypatch):
    """However many partitions a shuffle has, the bounded sample has few, and the driver holds no matrix of documents by words."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    docs = spark.range(0, 2000, 1, 4).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 20), i -> concat('w', pmod(xxhash64(id, i), 600))), if(id % 3 = 0, 'bad', 'good')) AS text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS bad", "int(doc_id % 2) AS odd")
    seen, whole = [], toxicity._distinct_words
    monkeypatch.setattr(toxicity, "_distinct_words", lambda df: seen.append(df.rdd.getNumPartitions()) or whole(df))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "67")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        tracemalloc.start()
        chain = fit_chain(docs, labels, ("bad", "odd"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        for k, v in held.items():
            spark.conf.set(k, v)
    assert seen[0] <= toxicity.SAMPLE_ROWS // 250
    assert peak < 2000 * len(chain.words) * 4
    got = score_chain(docs, chain)
    assert got.filter("is_bad != (doc_id % 3 = 0)").count() == 0


def test_ones_are_the_matrix():
    random = np.random.default_rng(5)
    dense = (random.random((40, 9)) < 0.3).astype(float)
    x = toxicity.Ones(*np.nonzero(dense), *dense.shape)
    x.full.append(random.random(40))
    dense = np.column_stack([dense, x.full[0]])
    w, g = random.random(10), random.random(40)
    assert np.allclose(x.times(w), dense @ w) and np.allclose(x.sums(g), dense.T @ g)


def test_line_dedup_takes_columns_of_any_name(spark):
    p = " ".join(f"w{j}" for j in range(60))
    docs = spark.createDataFrame([(i, f"{p}\nown {i}", 1, "x", 2) for i in (1, 2)], DOC + ", __id int, __named string, __maybe int")
    got = {r["doc_id"]: (r["text"], r["__id"], r["__named"], r["__maybe"]) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: (f"{p}\nown 1", 1, "x", 2), 2: ("own 2", 1, "x", 2)}
