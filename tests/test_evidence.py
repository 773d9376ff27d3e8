import pytest
from pyspark.sql import functions as F

from adjudex.operators import cases, evidence, graph

INVOICE = "Invoice No: INV-31\nPO Number: PO-640\nVendor: Birch Tools Ltd\nInvoice date 2024-02-11\nBilled INR 7,250\n"
ORDER = "Purchase Order No: po 640\nPurchase Order No: PO-640\nSupplier: Birch Tools Pvt Ltd\nApproval ID: APPR-9\n"
APPROVAL = "Approval ID: APPR-9\nGranted by: the head of finance\nStatus: granted"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def papers(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def test_facts(spark):
    found = evidence.facts(papers(spark, a=INVOICE, b="", c=None, d="no field here"))
    want = [("amount", "7250"), ("date", "2024-02-11"), ("invoice", "INV31"), ("purchase_order", "PO640"), ("vendor", "birch tools")]
    assert rows(found, "field", "value") == want
    assert rows(evidence.facts(papers(spark, c=APPROVAL)), "field", "value", "line") == [("approval", "APPR9", 0), ("person", "the head of finance", 1), ("status", "granted", 2)]


def test_links_by_status(spark):
    other = "Invoice No: INV-77\nPO Number: PO-640\nVendor: Slate Metals\n"
    same_vendor = "Invoice No: INV-500\nVendor: Birch Tools Ltd\n"
    docs = papers(spark, a=INVOICE, b=ORDER, c=APPROVAL, d=other, e=same_vendor, w="Reference: ZX-90001\n", x="Payment UTR: ZX90001\n")
    got = evidence.links(evidence.facts(docs))
    assert rows(got, "a", "b", "status", "conflicts") == [("a", "b", "EXPLICIT", []), ("a", "d", "CONFLICTING", ["invoice", "vendor"]), ("b", "c", "EXPLICIT", []), ("w", "x", "WEAK", [])]
    nodes, edges = evidence.nodes_and_edges(evidence.facts(docs), got)
    assert nodes.filter("type = 'Document'").count() == 7
    assert edges.filter("relation <> 'DERIVED_FROM'").count() == 4


def test_traversal_limits_and_bars(spark):
    members = evidence.traversable(evidence.links(evidence.facts(papers(spark, a=INVOICE, b=ORDER, c=APPROVAL))))
    seeds = spark.createDataFrame([("a",)], "id string")
    far = evidence.explore(members, seeds, 3)
    assert rows(far, "id", "hop", "path") == [("a", 0, ["a"]), ("b", 1, ["a", "b"]), ("c", 2, ["a", "b", "c"])]
    assert rows(evidence.exploration(members, far, 3)[1], "related", "doc_limit_reached", "frontier_not_expanded") == [(2, False, 0)]
    near = evidence.explore(members, seeds, 1)
    assert rows(near, "id") == [("a",), ("b",)]
    assert rows(evidence.exploration(members, near, 1)[1], "related", "frontier_not_expanded") == [(1, 1)]
    kept, metrics = evidence.exploration(members, far, 3, doc_limit=1)
    assert rows(kept, "id") == [("b",)] and rows(metrics, "related", "doc_limit_reached") == [(1, True)]
    barred = evidence.traversable(evidence.links(evidence.facts(papers(spark, a=INVOICE, b=ORDER))), spark.createDataFrame([("b",)], "id string"))
    assert rows(evidence.explore(barred, seeds, 2), "id") == [("a",)]
    assert evidence.explore(members, spark.createDataFrame([("a", True)], "id string, context_only boolean")).count() == 0


def test_likeness_alone_is_weak(spark):
    pairs = spark.createDataFrame([("a", "b", "fees for advice this spring", "fees for advice this autumn"), ("a", "c", "fees", "lunch")], "a string, b string, text_a string, text_b string")
    assert rows(evidence.similar_links(pairs), "b", "status") == [("b", "WEAK")]


def test_finding_counterfactuals(spark):
    findings = spark.createDataFrame([(1, "amount", "15,000", "12000"), (2, "vendor", "x", "y"), (3, "date", "p", "q"), (4, "amount", "?", "1")], "finding_id int, field string, a string, b string")
    rules = spark.createDataFrame([("r1", "amount"), ("r2", "vendor")], "rule_id string, field string")
    got = evidence.finding_counterfactuals(findings, rules)
    assert rows(got.filter("status = 'ESTABLISHED'"), "finding_id", "gap") == [(1, 3000.0)]
    assert rows(got.filter("reason is not null"), "finding_id", "reason") == [(2, "SIDE_UNKNOWN"), (3, "NO_RULE"), (4, "AMOUNT_UNKNOWN")]


@pytest.mark.parametrize("mode,op,amount", [("FORBID", ">", 20.0), ("FORBID", ">=", 20.0), ("REQUIRE", "<", 20.0), ("REQUIRE", ">", 3.0), ("REQUIRE", ">=", 10.0), ("FORBID", "<=", 10.0)])
def test_replay_satisfies(spark, mode, op, amount):
    rule = F.lit(mode), F.lit(op), F.lit(10.0)
    change = graph.counterfactual(*rule, F.lit(amount))
    assert spark.range(1).select(evidence.replay(*rule, F.lit(amount), change).alias("v")).first()["v"] == "SATISFIED"


def test_gates_come_in_order(spark):
    def gate(*v):
        return spark.range(1).select(evidence.unresolved_reason(*map(F.lit, v)).alias("r")).first()["r"]

    assert gate("FAILED", "MISMATCH", False, 3) == "VERIFICATION_FAILED"
    assert gate("VERIFIED", "UNESTABLISHED", False, 3) == "APPLICABILITY_UNESTABLISHED"
    assert gate("VERIFIED", "VERIFIED", False, 3) == "SEMANTICS_UNSUPPORTED"
    assert gate("VERIFIED", "VERIFIED", True, 2) == "SEVERAL_RULES_ON_LINE"
    assert gate("VERIFIED", "VERIFIED", True, 1) is None


def test_case_identity_and_scan_noise(spark):
    r = spark.range(1).select(cases.case_identity(F.lit(9), F.lit(3), F.lit("B")).alias("c"), cases.scanned(F.lit("the Global sum of totals: 400 hello Items, 12")).alias("t")).first()
    assert tuple(r["c"]) == ("OB-09-3B", "FAM-09-3", "DEV", "ocr_noise")
    assert r["t"] == "| the Gl0bal sum of t0tals: 400 hello Itcms, 12"


def test_case_checks(spark):
    schema = "case_id string, family_id string, split string, difficulty_category string, expected_decision string, document_set array<struct<doc_id:string,text:string>>, supporting_evidence array<string>, contradicting_evidence array<string>, expected_escalation boolean"
    good = ("OB-01-1A", "FAM-01-1", "TRAIN", "simple_compliance", "COMPLIANT", [("d1", "x"), ("d2", "y")], ["d1"], [], False)
    bad = ("OB-01-2A", "FAM-01-2", "DEV", "other", "COMPLIANT", [("d1", "x"), ("d1", " ")], ["d1", "d9"], ["d1"], None)
    moved = ("OB-01-2B", "FAM-01-2", "TEST", "simple_compliance", "COMPLIANT", [("d1", "x")], [], [], True)
    got = {r["case_id"]: r["errors"] for r in cases.check_cases(spark.createDataFrame([good, bad, moved], schema)).collect()}
    assert got["OB-01-1A"] == [] and got["OB-01-2B"] == ["family_in_several_splits"]
    assert got["OB-01-2A"] == ["unknown_category", "family_in_several_splits", "documents_repeat", "empty_document", "supporting_evidence_not_in_set", "document_on_both_sides", "escalation_missing"]


def test_rule_matches(spark):
    pairs = [("see PAY-2 and PAY-1", "PAY-1, PAY-2", True), ("PAY-1", "PAY-2", False), ("No  rule", "no rule", True), ("PAY-1", "none", False)]
    got = spark.createDataFrame(pairs, "e string, p string, w boolean").select(cases.rule_matches(F.col("e"), F.col("p")).alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)


def test_predictions_and_what_is_skipped(spark):
    decisions = spark.createDataFrame(
        [("a", "SATISFIED", "VERIFIED", False), ("a", "NO_CONCLUSION", "ESCALATE", None), ("b", "SATISFIED", "VERIFIED", False), ("c", "VIOLATION", "VERIFIED", True), ("c", "SATISFIED", "VERIFIED", None)],
        "case_id string, outcome string, verification string, contradiction boolean",
    )
    got = cases.complete_predictions(decisions).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {"a": ("INSUFFICIENT_EVIDENCE", True, None), "b": ("COMPLIANT", False, False), "c": ("NON_COMPLIANT", False, True)}

    records = spark.createDataFrame([(c,) for c in "abcdef"], "case_id string")
    states = spark.createDataFrame([("a", "COMPLIANT", True), ("b", "COMPLIANT", True), ("b", "COMPLIANT", True), ("c", "COMPLIANT", False), ("d", "CONDITIONAL", True), ("f", "NON_COMPLIANT", True)], "case_id string, state string, compiled boolean")
    done, skipped = cases.production_predictions(records, states)
    assert rows(done, "case_id", "predicted_decision") == [("a", "COMPLIANT"), ("f", "NON_COMPLIANT")]
    assert rows(skipped, "case_id", "reason") == [("b", "SEVERAL_DECISIONS"), ("c", "NOT_COMPILED"), ("d", "STATE_HAS_NO_LABEL"), ("e", "NO_DECISION")]
    asked, _ = cases.production_predictions(records, states, conditional="INSUFFICIENT_EVIDENCE")
    assert ("d", "INSUFFICIENT_EVIDENCE") in rows(asked, "case_id", "predicted_decision")
    proof = spark.createDataFrame([("a", "compiled", True), ("f", "compiled", False)], "case_id string, component string, used boolean")
    assert rows(cases.compiled_only(done, proof), "case_id") == [("a",)] and rows(cases.pilot(records, 2), "case_id") == [("a",), ("b",)]


def test_documents_that_agree_are_tied_whatever_a_third_says(spark):
    docs = papers(spark, a="Invoice No: INV-1\nPO Number: PO-77\nVendor: Acme Supplies\n", b="Invoice No: INV-2\nPO Number: PO-77\nVendor: Globex Corp\n", c="PO Number: PO-77\nVendor: Globex\n")
    got = evidence.links(evidence.facts(docs))
    want = [("a", "b", "CONFLICTING", ["invoice", "vendor"]), ("b", "c", "EXPLICIT", [])]
    assert rows(got, "a", "b", "status", "conflicts") == want
    members = evidence.traversable(got)
    assert rows(evidence.explore(members, spark.createDataFrame([("b",)], "id string"), 2), "id") == [("b",), ("c",)]


def test_links_are_those_of_pairs(spark):
    import itertools
    import random

    r = random.Random(4)
    texts, vendor, po = {}, {}, {}
    for i in range(60):
        k = f"d{i:02d}"
        vendor[k], po[k] = r.choice(["Elm", "Oak", "Ash", None]), r.randint(1, 9)
        texts[k] = f"PO Number: PO-{po[k]}\n" + (f"Vendor: {vendor[k]}\n" if vendor[k] else "")
    got = evidence.links(evidence.facts(papers(spark, **texts))).collect()
    tied = {(x["a"], x["b"]): x["status"] for x in got}

    def agree(x, y):
        return po[x] == po[y] and (vendor[x] is None or vendor[y] is None or vendor[x] == vendor[y])

    def groups(pairs):
        label = {k: k for k in texts}
        for _ in range(len(texts)):
            for x, y in pairs:
                label[x] = label[y] = min(label[x], label[y])
        return label

    assert all((status == "EXPLICIT") == agree(*pair) and po[pair[0]] == po[pair[1]] for pair, status in tied.items())
    assert groups([p for p, s in tied.items() if s == "EXPLICIT"]) == groups([p for p in itertools.combinations(texts, 2) if agree(*p)])
    classes = evidence.link_classes(evidence.facts(papers(spark, **texts)))
    assert {x["id"] for x in classes.collect()} == set(texts)


def test_a_relationship_names_the_kinds_of_documents(spark):
    got = evidence.links(evidence.facts(papers(spark, a=INVOICE, b=ORDER, c=APPROVAL)))
    assert rows(got, "a", "b", "relationship") == [("a", "b", "PURCHASE_ORDER_TO_INVOICE"), ("b", "c", "PURCHASE_ORDER_TO_APPROVAL")]


def test_written_approval_needs_its_approver(spark):
    role = "Director of Finance"
    texts = {
        "Attachment: written approval from the Director of Finance, dated before payment.": ("written_approval", "before_payment"),
        "Attachment: written approval from the Director of Finance, dated after payment.": ("written_approval", "after_payment"),
        "Attachment: written approval from the Manager, dated before payment. The Director of Finance was copied.": None,
        "No written approval from the Director of Finance was attached, dated before payment.": None,
        "The vendor approved the invoice.": None,
        "Nobody approved this.": None,
        "The Director of Finance approved it in writing.": ("written_approval", "unstated"),
        "Purchased for $3,400.": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["e"] and tuple(r["e"]) for r in df.select("t", graph.approval_evidence(F.col("t"), role).alias("e")).collect()}
    assert got == texts
    anyone = {r["t"]: r["e"] is not None for r in df.select("t", graph.approval_evidence(F.col("t")).alias("e")).collect()}
    assert [anyone[t] for t in texts] == [True, True, True, False, False, False, True, False]


def test_hops_do_not_make_the_members_again(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    members = spark.createDataFrame([("P1", "a"), ("P1", "b"), ("P2", "b"), ("P2", "c")], "identifier string, id string")
    found = evidence.explore(members.mapInArrow(counted, members.schema), spark.createDataFrame([("a",)], "id string"), 2)
    assert {(x["id"], x["hop"]) for x in found.collect()} == {("a", 0), ("b", 1), ("c", 2)} and made.value == 4


def random_papers(spark, n=150):
    import random

    r = random.Random(9)
    texts = {}
    for i in range(n):
        lines = [f"{name}: {prefix}{r.randint(1, 12)}{r.choice(['', '-'])}7" for name, prefix in (("Invoice No", "x"), ("PO Number", "x"), ("Approval ID", "ap-"), ("Purchase Order No", "x")) if r.random() < 0.5]
        lines += [f"Vendor: {r.choice(['Elm', 'Oak', 'Ash Ltd', 'Ash'])}" for _ in range(r.choice([0, 1, 1, 2]))] + ["no field", "Total: 12", ""]
        r.shuffle(lines)
        texts[f"d{i:03d}"] = r.choice(["\n", "\r\n"]).join(lines)
    return papers(spark, **texts, empty="", none=None)


@pytest.mark.parametrize("hot", [10_000, 5])
def test_members_are_those_of_links(spark, monkeypatch, hot):
    monkeypatch.setattr(evidence, "_HOT", hot)
    docs = random_papers(spark)
    want = rows(evidence.traversable(evidence.links(evidence.facts(docs))), "identifier", "id")
    got = rows(evidence.members(docs).distinct(), "identifier", "id")
    assert len(want) > 100 and got == want


def test_paths_are_the_smallest_of_the_nearest(spark):
    docs = random_papers(spark, 40)
    members = evidence.members(docs)
    seeds = docs.filter("doc_id < 'd012'").select(F.col("doc_id").alias("id"))
    held = {}
    for identifier, i in rows(members, "identifier", "id"):
        held.setdefault(identifier, set()).add(i)
    want = []
    for root in (x["id"] for x in seeds.collect()):
        reached, frontier = {root: [root]}, {root: [root]}
        want.append((root, root, 0, [root]))
        for hop in (1, 2, 3):
            near = {}
            for group in held.values():
                for i in group & set(frontier):
                    for j in group - set(reached):
                        near[j] = min(near.get(j, ["~"]), [*frontier[i], j])
            want += [(root, j, hop, path) for j, path in near.items()]
            reached, frontier = reached | near, near
    assert {hop for _, _, hop, _ in want} >= {0, 1, 2} and rows(evidence.explore(members, seeds, 3), "root", "id", "hop", "path") == sorted(want)


def test_traversal_stores_little_of_its_own(spark):
    from pathlib import Path

    n = 20_000
    text = lambda k, *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k = F.col("id")
    bought = spark.range(n // 10).select(F.concat(F.lit("c"), k).alias("doc_id"), text(k, "PO Number: PO-", k, "\nVendor: Firm", k).alias("text"))
    billed = spark.range(n).select(F.concat(F.lit("i"), k).alias("doc_id"), text(k, "Invoice No: INV-", k, "\nPO Number: PO-", F.floor(k / 10), "\nVendor: Firm", F.floor(k / 10)).alias("text"))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())
    before = size()
    found = evidence.explore(evidence.members(bought.unionByName(billed)), bought.select(F.col("doc_id").alias("id")), 2)
    assert found.count() == n + n // 10
    # 100 bytes a document, some of it for small files.
    assert size() - before < 100 * n
