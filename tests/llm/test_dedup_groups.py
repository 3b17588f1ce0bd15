"""Groups of near-duplicates whose documents share ids."""

from tidewell.llm import simhash

TEXTS = ["the cat and the dog sat there all day long", "an entirely different line about ships and the sea", "numbers of no meaning follow one two three four"]


def test_each_group_keeps_a_document_where_ids_repeat(spark):
    rows = [(1, TEXTS[0]), (1, TEXTS[1]), (2, TEXTS[0]), (3, TEXTS[1]), (None, TEXTS[2]), (None, TEXTS[2].upper())]
    kept = simhash.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept) == [(0, TEXTS[2]), (1, TEXTS[1]), (1, TEXTS[0])]
