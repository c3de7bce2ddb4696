"""Every operator on rows with nulls in all columns, repeats, ties, long words and clashing extra columns."""

import pytest

from larkspur.llm import bpe, decontam, langid, licenses, linededup, neardup, pii, quality, secret_scan, sharding, tokenalign, warczip
from larkspur.llm.queries import BPE_VOCABULARY, PIECE_MODEL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, score string, lang_pred string, overlap string, hits string, root string"
LONG = "a" * 300_000
ROWS = [
    (None, None, None, None, None, *["x"] * 7),
    (None, "the very same line of text here\nthe very same line of text here", "en", None, 1, *[None] * 7),
    (1, "the very same line of text here\nand one more line that others hold too", "en", "s", 1, *["x"] * 7),
    (2, "the very same line of text here\nand one more line that others hold too", "en", "s", 1, *["x"] * 7),
    (2, "the very same line of text here\nand one more line that others hold too", "en", "s", 1, *["x"] * 7),
    (3, "the very same line of text here\nand one more line that others hold too", None, "s", 1, *["x"] * 7),
    (2**62, LONG, "en", "s", 1, *["x"] * 7),
    (5, LONG + " " + LONG, "de", "s", 1, *["x"] * 7),
    (6, "\n" * 5000, "de", "s", 1, *["x"] * 7),
    (7, "", "fr", "", 0, *["x"] * 7),
    (8, "9 " * 5000, "fr", "", 0, *["x"] * 7),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def bench(spark):
    return spark.createDataFrame([(None, None), (1, "the very same line of text here and one more line")], "item_id long, text string")


ONE_ROW_EACH = {
    "langid": lambda s, d: langid.language_ids(d),
    "linededup": lambda s, d: linededup.dedup_lines(d),
    "secrets": lambda s, d: secret_scan.secret_spans(d),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "bpe": lambda s, d: bpe.digest_documents(d, BPE_VOCABULARY),
    "pii": lambda s, d: pii.personal_data(d),
    "quality": lambda s, d: quality.quality_rules(d),
    "sharding": lambda s, d: sharding.shard_documents(d),
    "decontam": lambda s, d: decontam.contamination(d, bench(s)),
    "alignment": lambda s, d: tokenalign.aligned(d, BPE_VOCABULARY, PIECE_MODEL),
    "licenses": lambda s, d: licenses.license_labels(d),
    "warc": lambda s, d: warczip.archived_pages(d.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "row", "kept")),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each_row(spark, table, name):
    out = ONE_ROW_EACH[name](spark, table).collect()
    assert len(out) == len(ROWS)
    ids = [r.row.doc_id if name == "linededup" else r.page_id if name == "warc" else r.doc_id for r in out]
    assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)


STAGES = {
    "langid": lambda s, d: langid.keep_known_languages(d),
    "linededup": lambda s, d: linededup.without_repeated_lines(d),
    "neardup": lambda s, d: neardup.without_near_duplicates(d),
    "decontam": lambda s, d: decontam.without_contaminated(d, bench(s)),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_and_untouched_values(spark, table, name):
    out = STAGES[name](spark, table)
    assert out.columns == table.columns and out.dtypes == table.dtypes
    given = {(r[0], r[4:]) for r in ROWS}
    assert all((r.doc_id, tuple(r[4:])) in given for r in out.collect())
