"""The pipeline's near stage follows fingerprints as operator 10 does, besides 5-word similarity."""

import random

import corpus_pipeline
import numpy as np

from tests.llm import brute
from tests.llm.test_near_dups import made, words


def linked(rows):
    """The component of each row, by 2 or fewer differing bits or a similarity of at least 0.8."""
    sets, fps = [words(t) for _, t in rows], np.array([brute.fingerprint(t) for _, t in rows], np.uint64)
    comp = list(range(len(rows)))
    for x in range(len(rows)):
        near = np.bitwise_count(fps[:x] ^ fps[x]) <= 2
        for y in range(x):
            if near[y] or 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                old, new = comp[x], comp[y]
                comp = [new if c == old else c for c in comp]
    return comp


def rows():
    r = random.Random(9)
    own = lambda: " ".join(f"v{r.randrange(10**6)}" for _ in range(60))
    # One shingle in over half of all places sets all bits; what differs is far from similar by distinct shingles.
    out = [("same " * 200 + own()) for _ in range(4)] + [own() for _ in range(10)]
    edited = [out[0].replace(out[0].split()[-30], "edited", 1), out[5].replace(" ", "  ").upper()]
    return [*enumerate(out + edited), *((100 + i, t) for i, t in made() if i is not None)]


def test_stage_follows_fingerprints(spark):
    table = rows()
    comp = linked(table)
    least = {c: min(i for (i, _), d in zip(table, comp, strict=True) if d == c) for c in comp}
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert got == sorted(least.values())
    assert 0 in got and not {1, 2, 3} & set(got)
    by_prints = {i for i, _, c in brute.simhash(table) if i != c}
    assert not by_prints & set(got)
