"""Long texts whose slices may be white space only, against the tokenizers library."""

from tessera.llm import bpe
from tessera.llm.queries import word_bpe_path
from tests.llm import brute


def test_digests_of_long_runs_of_blanks(spark):
    blanks = " " * (3 * bpe.SLICE)
    rows = [(1, "two words" + blanks + "and more"), (2, "at the end" + blanks), (3, blanks + "at the start"), (4, blanks)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in bpe.digests(docs, word_bpe_path()).collect()) == brute.bpe(rows)
