"""The pipeline stage by stage against brute force, and its last stage by its own laws."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def by_hand(rows):
    """(doc_id, text) after each of the first four stages."""
    states = []
    rows = [(i, t if not bad else "\n".join(good)) for (i, t), (*_, kept, good, bad) in zip(rows, brute.quality(rows), strict=True) if kept]
    states.append(rows)
    rows = [r for r, (_, _, _, kept, _) in zip(rows, brute.exact(rows), strict=True) if kept]
    states.append(rows)
    rows = [r for r, (i, _, c) in zip(rows, brute.simhash(rows), strict=True) if i == c]
    states.append(rows)
    rows = [(i, t if not n else kept.decode(errors="ignore")) for (i, t), (_, _, n, _, _, kept) in zip(rows, brute.suffix(rows), strict=True)]
    states.append(rows)
    return states


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents, with more copies, near copies, shared passages, junk and nulls."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    long = [r for r in rows if len(r[1]) > 800][:6]
    extra = [(9_000 + k, *r[1:]) for k, r in enumerate(long)]
    extra += [(9_100 + k, r[1].replace(r[1][400:404], "zzzz", 1), *r[2:]) for k, r in enumerate(long)]
    extra += [(9_200, long[0][1] + "\n" + long[1][1][:700], "en", "s", 1), (9_201, None, "en", None, None), (9_202, "", None, "s", 1), (9_203, "a | b | c | d\n" * 30, "en", "s", 1)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows + extra, docs.schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    states = by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    for k, ((name, stage), expected) in enumerate(zip(corpus_pipeline.STAGES[:-1], states, strict=False)):
        out = stage(spark, docs, folder)
        assert out.columns == columns
        path = f"{folder}/{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted(expected, key=repr), name
    left = {i: [*brute.encode(t), 1] for i, t in states[-1]}
    got = corpus_pipeline.run(spark, folder).collect()
    total, bins = defaultdict(int), defaultdict(int)
    for r in got:
        part = left[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        total[r.doc_id] += r.length
        bins[r.sequence_id] += r.length
    assert total == {i: len(e) for i, e in left.items()}
    assert max(bins.values()) <= 4096 and len(bins) <= -(-sum(total.values()) // 4096) + 1


def test_empty(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_without_the_operators():
    """The entry's guard is the only place that knows whether the operators are there."""
    import __spark_entry__ as entry

    names = entry.queries()
    assert {"pipeline", "op1_bpe_round_trip", "tpch_q1"} <= names.keys()
    assert entry.oracle_sql().keys() <= names.keys()
