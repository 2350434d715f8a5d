from quillstone.plans import registry


def test_labels_come_from_each_documents_own_text(spark, tmp_path):
    rows = [(5, "Nothing here"), (10, "the sky\n" * 500 + "\nWHY did you stop?"), (15, None), (20, "Please continue\nand verify it"), (25, "the end of it all, a plain line")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.categories, r.weak_label) for r in registry.QUERIES["weak_categories_of_documents"](spark, str(tmp_path)).collect()}
    assert got[5] == got[15] == ([], "ordinary") and got[25][1] == "trigger_only"
    assert got[10] == (["question_confusion"], "needs_review")
    assert got[20] == (["verification_failure", "scope_or_resume_pressure"], "agent_failure_candidate")


def test_canned_lines(spark):
    from pyspark.sql import functions as F

    from quillstone.functions import text

    lines = {
        "why did you not read the docs": "agent_failure_candidate", "please continue and test it": "agent_failure_candidate", "why is the button so": "needs_review",
        "you stop doing this the": "agent_failure_candidate", "plain words": "ordinary",
    }
    rows = spark.createDataFrame([(k,) for k in lines], "t string").select("t", text.weak_label(text.weak_categories(F.col("t")), text.matched_words(F.col("t"), ["the"])).alias("label"))
    assert {r.t: r.label for r in rows.collect()} == lines
