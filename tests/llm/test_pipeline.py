import corpus_pipeline
from adjudex.llm.common import stored


def test_stages_in_turn(spark):
    # Of sf0.001 eleven labels are toxic, too few to fit a chain on.
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    clean = {r["doc_id"] for r in labels.filter("toxic = 0").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids
        if name == "toxicity":
            assert len(toxic & now) <= 0.2 * len(toxic) and len(clean & now) >= 0.98 * len(clean)
        if name != "tokens":
            assert docs.columns == columns
        ids = now
    assert docs.filter("not round_trip").isEmpty() and docs.count() == len(ids)


def test_documents_emptied_by_line_dedup_go(spark):
    p = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(40)) for i in range(3))
    rows = [(1, p), (2, p), (3, f"\n{p}\n\n"), (4, f"{p}\nown"), (5, ""), (6, None), (7, " \n"), (None, p)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_lines(spark, docs, "").collect()}
    assert got == {1: p, 4: "own", 5: "", 6: None, 7: " \n", None: p}


DOC = "doc_id long, text string, lang string, source string, n_chars long"


def through(spark, docs, sf):
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
    return docs


def test_stages_take_odd_rows_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (4, "one"), (5, "one two"), (5, "two three four"), (None, "odd"), (6, long), (7, long + " x")]
    clash = "is_toxic boolean, p_toxic double, epoch int, ids string, kept boolean, __id long, __named string, __had_words int, id string, key int, content string"
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or ""), True, 2.0, 9, "i", False, 1, "n", 3, "d", 4, "c") for i, t in rows], f"{DOC}, {clash}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, "/root/testdata/sf0.01"), "stage")
        assert out.columns == docs.columns
        assert out.filter("not is_toxic or p_toxic <> 2 or epoch <> 9 or ids <> 'i' or kept or __id <> 1 or __named <> 'n' or __had_words <> 3").isEmpty()
        if name in ("toxicity", "line dedup"):
            assert out.count() == len(rows)
    got = through(spark, docs, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "round_trip"]
    assert got.filter("not round_trip").isEmpty()


def test_stages_take_an_empty_table(spark):
    assert through(spark, spark.createDataFrame([], DOC), "/root/testdata/sf0.01").count() == 0
