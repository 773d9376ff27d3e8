import itertools
import random

import pytest
from pyspark.sql import functions as F

from adjudex.operators import contradictions as C
from adjudex.operators import similar


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_similar_pairs_against_all_pairs(spark, least):
    r = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(r.choice(words[: r.choice([4, 30])]) for _ in range(r.randint(0, 9))) for i in range(120)} | {200: None, 201: "w1", 202: "W1", 203: " w1 "}
    links, members = similar.semantic_links(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), least)
    sets = {i: frozenset((t or "").lower().split()) for i, t in texts.items()}
    rep = {}
    for i, s in sorted(sets.items()):
        if s:
            rep[i] = next(j for j in sorted(sets) if sets[j] == s)
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(set(rep.values())), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9}
    assert {r["id"]: r["rep"] for r in members.collect()} == rep
    assert {(r["a"], r["b"]): r["common"] for r in links.collect()} == want
    assert links.filter("status <> 'WEAK'").isEmpty()


def test_similarity_needs_a_threshold(spark):
    with pytest.raises(ValueError):
        similar.similar_pairs(spark.createDataFrame([], "rep int, words array<long>, n int"), 0)


@pytest.mark.parametrize("few", [1 << 16, 3])
def test_sums(spark, monkeypatch, few):
    monkeypatch.setattr(C, "_FEW_SUMS", few)
    r = random.Random(1)
    rows = [([r.randint(1, 40) for _ in range(r.randint(0, 6))], r.randint(0, 90)) for _ in range(200)] + [(None, 1), ([1], None), ([None, 2], 2), ([5], -1)]
    df = spark.createDataFrame(rows, "items array<long>, total long")
    for row in df.withColumn("hit", C.sums_to("items", "total")).collect():
        items, total = row["items"], row["total"]
        if items is None or total is None:
            assert row["hit"] is None
            continue
        solid = [x for x in items if x]
        assert row["hit"] == any(sum(c) == total for k in range(len(solid) + 1) for c in itertools.combinations(solid, k))


CLAIM = "id string, name string, field string, values array<string>, settles boolean, says_partial boolean"


def found(spark, claims, status="EXPLICIT"):
    links = spark.createDataFrame([("a", "b", status)], "a string, b string, status string")
    return {(r["field"], r["category"], r["difference"]) for r in C.findings(links, spark.createDataFrame(claims, CLAIM)).collect()}


def pair(field, a, b, settles=False, partial=False):
    return [("a", "x", field, a, False, None), ("b", "x", field, b, settles, partial)]


def test_findings_by_field(spark):
    cases = {
        "major amount": (pair("amount", ["2000000"], ["1200000"]), ("amount", "MAJOR_CONTRADICTION", None)),
        "stated part payment": (pair("amount", ["2000000"], ["800000"], True, True), ("amount", "CONSISTENT", "partial_payment")),
        "unstated part payment": (pair("amount", ["900000"], ["400000"], True), ("amount", "UNRESOLVED", None)),
        "overpayment": (pair("amount", ["900000"], ["950000"], True), ("amount", "MAJOR_CONTRADICTION", None)),
        "line items": (pair("amount", ["1200000", "500000", "700000"], ["500000", "700000"]), ("amount", "CONSISTENT", None)),
        "items that add up": (pair("amount", ["1200000"], ["500000", "700000"]), ("amount", "CONSISTENT", None)),
        "little": (pair("amount", ["100000"], ["100500"]), ("amount", "MINOR_CONTRADICTION", None)),
        "vendors": (pair("vendor", ["Larch Metals"], ["Cedar Textiles"]), ("vendor", "MAJOR_CONTRADICTION", None)),
        "a longer name": (pair("vendor", ["Larch Metals Trading"], ["Larch Metals"]), ("vendor", "MINOR_CONTRADICTION", None)),
        "persons": (pair("identity", ["Ada Frost"], ["Lin Berg"]), ("identity", "MAJOR_CONTRADICTION", None)),
        "ids": (pair("transaction_id", ["INV1"], ["INV2"]), ("transaction_id", "MAJOR_CONTRADICTION", None)),
        "shared id": (pair("transaction_id", ["INV1", "INV3"], ["INV3"]), ("transaction_id", "CONSISTENT", None)),
        "approved and not": (pair("approval_status", ["Approved"], ["Rejected"]), ("approval_status", "MAJOR_CONTRADICTION", None)),
        "approved and pending": (pair("approval_status", ["Approved"], ["Pending"]), ("approval_status", "UNRESOLVED", None)),
        "delivery": (pair("factual_claim", ["Delivered"], ["Not delivered"]), ("factual_claim", "MAJOR_CONTRADICTION", None)),
        "quantity": (pair("factual_claim", ["10"], ["50"]), ("factual_claim", "MAJOR_CONTRADICTION", None)),
        "dates": (pair("date", ["2024-03-01"], ["2 Mar 2024"]), ("date", "MINOR_CONTRADICTION", None)),
    }
    links = spark.createDataFrame([(f"a{i}", f"b{i}", "CONFLICTING") for i in range(len(cases))], "a string, b string, status string")
    claims = [(f"{c[0]}{i}", *c[1:]) for i, (rows, _) in enumerate(cases.values()) for c in rows]
    got = {r["a"]: (r["field"], r["category"], r["difference"]) for r in C.findings(links, spark.createDataFrame(claims, CLAIM)).collect()}
    assert {n: got[f"a{i}"] for i, n in enumerate(cases)} == {n: w for n, (_, w) in cases.items()}


def test_weak_links_contradict_nothing(spark):
    assert found(spark, pair("amount", ["9"], ["8"]), "WEAK") == {("link", "UNRESOLVED", None)}
    # The payment may be either end.
    turned = [("a", "x", "amount", ["400"], True, False), ("b", "x", "amount", ["900"], False, False)]
    assert found(spark, turned) == {("amount", "UNRESOLVED", None)}


def test_missing_and_mirrored(spark):
    refs = spark.createDataFrame([("a", "purchase_order", "PO1"), ("a", "purchase_order", "PO2")], "id string, field string, reference string")
    there = spark.createDataFrame([("purchase_order", "PO1")], "field string, reference string")
    assert [r["reference"] for r in C.missing_evidence(refs, there).collect()] == ["PO2"]
    decided = spark.createDataFrame([("a", "VIOLATION"), ("b", "COMPLIANT")], "id string, verdict string")
    assert [(r["id"], r["derived_from_contradiction"]) for r in C.policy_violations(decided).collect()] == [("a", False)]


@pytest.mark.parametrize("tile", [512, 4])
def test_near_copies_are_met_once_and_lose_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(similar, "_TILE", tile)
    r = random.Random(5)
    sets = {i: frozenset(r.sample([f"c{j}" for j in range(40)], r.randint(34, 40))) | {f"own{i}"} for i in range(60)}
    members, found = similar.word_sets(spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in sets.items()], "doc_id int, text string"))
    assert {x["rep"]: (x["n"], x["alone"]) for x in found.collect()} == {i: (len(s), 1) for i, s in sets.items()}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    assert len(pairs) > 300 and sorted((x["a"], x["b"]) for x in similar.similar_pairs(found).collect()) == pairs


def test_plain_sums_need_no_search(spark, monkeypatch):
    rows = [([5, 7], 12), ([5, 7], 13), ([5, 7], 7), ([5, 7], 1), ([5, None, 7], 12), ([12], 12), ([0, 5], -1), ([5, 7, 9], 14)]
    df = spark.createDataFrame(rows, "items array<long>, total long")
    searched = df.select(C._adds_up(F.col("items"), F.col("total")).alias("x")).collect()
    assert [x["x"] for x in searched] == [True, False, True, False, True, False, False, True]
    monkeypatch.setattr(C, "sums_to", lambda items, total: F.lit(None).cast("boolean"))
    assert [x["x"] for x in df.select(C._adds_up(F.col("items"), F.col("total")).alias("x")).collect()] == [True, False, True, False, True, False, False, None]


def all_pairs(sets, least=0.8):
    return sorted((*sorted((a, b)), len(sets[a] & sets[b])) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9)


@pytest.mark.parametrize("many,batch", [(1 << 14, 10_000), (7, 10_000), (1 << 14, 9), (7, 9)])
def test_a_word_of_many_sets_is_met_in_blocks(spark, monkeypatch, many, batch):
    monkeypatch.setattr(similar, "_MEET", many)
    monkeypatch.setattr(similar, "_AT_ONCE", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        r = random.Random(8)
        # Near copies of several texts, as strings, with unlike numbers of words of their own.
        texts = [[f"t{k}x{j}" for j in range(r.choice([9, 50]))] for k in range(3)]
        sets = {f"d{i}": frozenset(w for w in texts[i % 3] if r.random() < 0.93) | {f"own{i}x{j}" for j in range(r.randint(0, 3))} for i in range(90)}
        docs = spark.createDataFrame([(i, " ".join(s)) for i, s in sets.items()], "doc_id string, text string")
        links, _ = similar.semantic_links(docs)
        assert len(all_pairs(sets)) > 300 and sorted((x["a"], x["b"], x["common"]) for x in links.collect()) == all_pairs(sets)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_unlike_texts_with_a_rare_word_in_common_are_no_candidates(spark):
    r = random.Random(3)
    common = [f"c{j}" for j in range(3000)]
    docs = spark.createDataFrame([(i, " ".join([f"rare{i // 2}", *r.sample(common, 150)])) for i in range(300)], "doc_id int, text string")
    _, sets = similar.word_sets(docs)
    assert similar._met(similar._heads(sets, 0.8), 0.8).isEmpty()


def test_only_copies_are_stored(spark):
    from pathlib import Path

    r = random.Random(6)
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())
    texts = {i: " ".join(f"{r.getrandbits(40):x}" for _ in range(400)) for i in range(400)}
    texts |= {1000: texts[7], 1001: texts[7].upper(), 1002: texts[9] + " more", None: "one two"}
    rows = [*texts.items(), (7, texts[7]), (1002, texts[1002])]
    before = size()
    links, _ = similar.semantic_links(spark.createDataFrame(rows, "doc_id int, text string"))
    assert [(x["a"], x["b"], x["common"]) for x in links.collect()] == [(9, 1002, 400)]
    assert size() - before < sum(len(t) for _, t in rows) / 4
