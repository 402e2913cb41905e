"""The pipeline decides on rows, not on ids, and leaves columns of the caller alone."""

import random

import corpus_pipeline


def words(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def stored(spark, rows, path, extra="1 as row_place"):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.selectExpr("*", extra).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_near_duplicates_by_row(spark, tmp_path):
    r = random.Random(1)
    v, z, other = words(r, 40), words(r, 40), words(r, 40)
    rows = [(3, v), (5, v), (5, other), (7, z), (7, z), (7, z.upper()), (None, v), (None, v), (8, None), (8, None), (9, ""), (10, " \n")]
    rows = [(d, t, "en", "s", 0) for d, t in rows]
    docs = stored(spark, rows, f"file://{tmp_path}/d")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((x["doc_id"] or -1, (x["text"] or "").lower()) for x in out.collect()))
    assert got == sorted([(3, v), (5, other), (7, z), (-1, v), (-1, v), (8, ""), (8, ""), (9, ""), (10, " \n")])
    # Rows that come from no file give the same.
    plain = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(((x["doc_id"] or -1, (x["text"] or "").lower()) for x in plain.collect())) == got


def test_contamination_by_row(spark, tmp_path):
    r = random.Random(2)
    item = words(r, 30)
    rows = [(1, words(r, 20) + " " + item), (1, "clean text of the same id"), (None, item), (None, None), (2, words(r, 3000) + " " + item + " " + words(r, 3000)), (3, "")]
    docs = stored(spark, [(d, t, "en", "s", 0) for d, t in rows], f"file://{tmp_path}/d")
    spark.createDataFrame([(1, item), (1, item), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.drop_contaminated(spark, docs, f"file://{tmp_path}")
    assert sorted((x["doc_id"] or -1, x["text"] or "") for x in out.collect()) == [(-1, ""), (1, "clean text of the same id"), (3, "")]
    assert out.columns == docs.columns


def test_columns_named_like_working_ones_stay(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, words(r, 30) + (" snurk" if k % 2 else ""), "en", "s", 0) for k in range(200)]
    clash = "doc_id + 100 as toxic_predicted", "doc_id + 200 as toxic_score", "'x' as masked_text", "'y' as personal_spans"
    docs = stored(spark, rows, f"file://{tmp_path}/d", clash[0])
    docs = docs.selectExpr("*", *clash[1:])
    spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    out = corpus_pipeline.drop_toxic(spark, docs, f"file://{tmp_path}")
    got = out.collect()
    assert out.columns == docs.columns and got and all(x["toxic_predicted"] == x["doc_id"] + 100 and x["toxic_score"] == x["doc_id"] + 200 for x in got)
    masked = corpus_pipeline.mask_personal_data(spark, docs.selectExpr("doc_id", "concat(text, ' a@b.org')  as text", "n_chars", "masked_text", "personal_spans"), "")
    got = masked.collect()
    assert all(x["masked_text"] == "x" and x["personal_spans"] == "y" and x["text"].endswith("[EMAIL]") and x["n_chars"] == len(x["text"]) for x in got)
