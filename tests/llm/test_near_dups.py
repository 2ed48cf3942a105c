"""Near-duplicates by 5-word similarity against all pairs, alone and as the pipeline's stage."""

import random

import corpus_pipeline

from tessera.llm import near_dups


def words(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def by_hand(rows):
    sets = [words(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            both = len(a & sets[y])
            if a == sets[y] or 100 * both >= 80 * len(a | sets[y]) > 0:
                up[find(x)] = find(y)
    low = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            low[find(x)] = min(low.get(find(x), i), i)
    return [(i, low.get(find(x))) for x, (i, _) in enumerate(rows)]


def made():
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(5_000)]
    rows, header = [], [r.choice(vocabulary) for _ in range(100)]
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.choice((6, 40, 150, 400)))]
        for _ in range(6):
            base = list(base)  # a chain: each differs from the one before
            for _ in range(max(1, len(base) // r.choice((20, 45, 60, 150)))):
                base[r.randrange(len(base))] = r.choice(vocabulary)
            rows.append(" ".join(base))
    rows += [" ".join(header + [r.choice(vocabulary) for _ in range(150)]) for _ in range(60)]
    rows += ["", None, "one two", "One  two", "one two three", rows[0], rows[0].upper()]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return [*zip(ids, rows, strict=True), (None, rows[5]), (None, "only nulls")]


def test_near_dups(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.component_id) for r in near_dups.near_duplicates(docs).collect()), key=repr)
    assert got == sorted(by_hand(rows), key=repr)
    assert sum(i != c for i, c in got) > 60
    assert near_dups.near_duplicates(docs.where("false")).count() == 0


def test_stage_drops_edited_copies(spark):
    """A word changed in 150 moves a fingerprint by more than 2 bits and keeps 0.8 of the shingles."""
    rows = [(i, t) for i, t in made() if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert got == sorted(i for i, c in by_hand(rows) if i == c)
