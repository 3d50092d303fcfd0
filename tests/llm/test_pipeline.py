import corpus_pipeline
import plain
from inkfield.llm import near_text, toxicity


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == docs.columns and set(texts) == {i for i, s in scores.items() if s < 0.5}
    _, component = plain.near_texts(texts, 5)
    unlike = corpus_pipeline.drop_near_duplicates(spark, clean, sf)
    assert unlike.columns == docs.columns
    assert sorted(r["doc_id"] for r in unlike.collect()) == sorted(i for i, c in component.items() if i == c)
    masked = corpus_pipeline.replace_personal_data(spark, unlike, sf)
    assert masked.columns == docs.columns and masked.count() == unlike.count()
    assert masked.where("n_chars <> length(text)").count() == 0
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert packed == {i for i, c in component.items() if i == c}


def test_odd_documents(spark, odd_documents, tmp_path):
    odd_documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in got} == {1, 4, 5, 6, 7, 9, 11, 12, 13, None}


def test_stages_keep_columns_of_any_name(spark):
    text = "call +1 555 123 4567 or write to jo@example.org about the bread and the glass of water on the table"
    docs = spark.createDataFrame(
        [(1, text, 5, 0.5, "x", "m"), (2, None, 6, 0.9, "y", "n")],
        "doc_id long, text string, `a.b` int, __score double, __new string, made string",
    )
    out = corpus_pipeline.replace_personal_data(spark, docs, "")
    assert out.columns == docs.columns
    assert [(r["a.b"], r["__score"], r["__new"], r["made"]) for r in out.orderBy("doc_id").collect()] == [(5, 0.5, "x", "m"), (6, 0.9, "y", "n")]
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, labels).columns == docs.columns
    assert sorted(r["a.b"] for r in near_text.one_of_each(docs).collect()) == [5, 6]


def test_different_texts_under_one_id_are_documents_of_their_own(spark):
    some = lambda seed: " ".join(f"w{(seed * 37 + k * k) % 997}" for k in range(60))
    rows = [(1, some(1), 0), (2, some(1), 1), (2, some(2), 2), (2, some(2), 3), (3, some(2) + " more", 4), (None, some(3), 5), (4, some(4), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, number int")
    kept = near_text.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
    assert got == sorted([(1, some(1)), (2, some(2)), (0, some(3)), (4, some(4))])
