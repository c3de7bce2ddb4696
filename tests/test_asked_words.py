"""The internship query counts the two words of its SQL between blanks, and no other word of the list."""

from larkspur.plans import registry


def test_other_words_do_not_count(spark, tmp_path):
    rows = [(1, "a thesis and a thesis on it", "en", 27), (2, "of the plan the end", "en", 19), (3, "trainee, intern. Intern of the x", "en", 31), (4, "sur la vie la fin", "fr", 17), (5, "x the la y", "fr", 10), (6, None, "fr", 0), (7, "x la y la z", "en", 11)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int").coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    got = {r[0]: r[1] for r in registry.queries()["intern_evidence"](spark, str(tmp_path)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True, 6: None, 7: False}
