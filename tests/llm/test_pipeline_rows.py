"""The pipeline's dedup stages judge rows, not ids: repeated and null ids lose no text and leave no copy."""

import corpus_pipeline
import pytest

LONG = " ".join(f"word{k}" for k in range(120))
EDITED = LONG.replace("word60", "other")
ROWS = [(3, "copy"), (9, "copy"), (3, "unique text"), (9, "another one"), (None, "copy"), (None, "null"), (None, "null"), (None, "alone")]
ROWS += [(7, "twice"), (7, "twice"), (5, "A"), (9, "A"), (5, "B"), (2, ""), (4, None), (11, LONG), (12, EDITED), (11, "not " + "x " * 40), (12, "own " + "y " * 40), (None, EDITED + " and")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "en", k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, lang string, keep_id long").repartition(3)


def test_exact_stage(spark, docs):
    out = corpus_pipeline.exact_copies(spark, docs, "")
    assert out.columns == docs.columns
    best = {}
    for i, t in ROWS:
        if (t or "") not in best or i is not None and (best[t or ""] is None or i > best[t or ""]):
            best[t or ""] = i
    assert sorted(((r.text or "", r.doc_id) for r in out.collect()), key=repr) == sorted(best.items(), key=repr)


def test_near_stage(spark, docs):
    out = corpus_pipeline.near_copies(spark, docs, "")
    got = sorted(((r.text or "", r.doc_id) for r in out.collect()), key=repr)
    best = {}
    for i, t in ROWS:
        t = LONG if t and t.startswith("word0") else t or ""
        key = (i is None, i)
        if t not in best or key < best[t]:
            best[t] = key
    assert got == sorted(((t, i) for t, (_, i) in best.items()), key=repr)
