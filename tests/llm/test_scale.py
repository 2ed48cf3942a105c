"""What must hold beyond small tables: saturated filters, hot keys, giant texts and words, and searches that pay."""

import random
import string

import pytest
from tests.llm import brute
from tests.llm.test_operators import ROWS, same, words

from tessera.llm import common, exact_dedup, licenses, packing, quality, sharding, suffix_dedup, token_counts, warc


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("slots,hot", [(1, 10_000), (1, 1), (1 << 17, 1), (1 << 17, 10_000)])
def test_lookup_on_all_sides(spark, monkeypatch, slots, hot):
    """A filter that lets everything pass or nothing in vain, with all keys hot or none: the same rows."""
    monkeypatch.setattr(common, "FILTER_SLOTS", slots)
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rows = spark.createDataFrame([(k, f"k{k % 70}" if k % 3 else "hot", k % 5) for k in range(600)] + [(999, "none", 0)], "id long, key string, part int")
    index = rows.where("key <> 'none' and part < 4").groupBy("key", "part").count().withColumnRenamed("count", "n")
    out = {r.id: r.n for r in common.lookup(rows, index, ["key", "part"], "n", 601).collect()}
    expected = {(r.key, r.part): r.n for r in index.collect()}
    assert out == {r.id: expected.get((r.key, r.part)) for r in rows.collect()}
    passed = {r.id for r in common.maybe_in(rows, index, ["key", "part"]).collect()}
    assert {i for i, n in out.items() if n} <= passed


def test_texts_that_are_no_hits_are_not_shuffled(spark):
    rows = frame(spark, [(k, f"text {k}") for k in range(50)])
    plan = common.lookup(rows, rows.groupBy("text").count().where("count > 1"), "text", "count", 50_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "_words" in plan


def test_dedup_operators_with_saturated_filters(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_SLOTS", 1)
    monkeypatch.setattr(common, "HOT_KEYS", 1)
    docs = frame(spark, ROWS)
    same(exact_dedup.exact_dedup(docs).selectExpr("*", "lower(hex(digest)) h"), brute.exact(ROWS), "doc_id", "keep_id", "group_size", "kept", "h")
    same(suffix_dedup.digests(docs), brute.suffix(ROWS), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_exact_dedup_over_many_runs(spark, monkeypatch):
    """Hits across runs come from the index's filters; every digest in two runs is one."""
    index = exact_dedup.LsmIndex()
    import numpy as np

    for part in ([b"a", b"b"], [b"b", b"c"], [b"d"], [b"a"], [b"e"]):
        index.add(np.array([x.ljust(8, b"x") for x in part], "S8"), np.arange(len(part)))
    index.compact(full=True)
    (run,) = index.runs
    assert {d[:1] for d, h in zip(run.digests.tolist(), run.hit.tolist(), strict=True) if h} == {b"a", b"b"}


def test_shared_passage_overfills_its_anchors(spark):
    """A passage in every document under many different surroundings, with its buckets shuffled on by window."""
    r = random.Random(4)
    passage = "".join(r.choice(string.ascii_lowercase + " ") for _ in range(180))
    rows = [(k, "".join(r.choice(string.ascii_lowercase) for _ in range(60)) + passage + "".join(r.choice(string.ascii_lowercase) for _ in range(60))) for k in range(120)]
    rows += [(500 + k, passage[:90] + str(k)) for k in range(5)] + [(7, passage), (None, passage)]
    for options in ({"anchor_bytes": 0}, {"anchor_bytes": 0, "travel": 1}, {}):
        same(suffix_dedup.digests(frame(spark, rows), **options), brute.suffix(rows), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_archives_are_read_by_several_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k}", words(60, k), "x", 1) for k in range(60)] + [(70, "u", "é" * 200_000, "x", 1)], "page_id long, url string, html string, payload string, kind int").repartition(5)
    manifest = warc.write_archives(pages, (tmp_path / "w").as_uri())
    assert manifest.count() >= 4
    got = warc.read_archives(manifest)
    assert got.rdd.getNumPartitions() > 1 and got.count() == 61


def test_sharding_with_a_giant_text(spark):
    rows = [(k, words(5 + k % 60, k)) for k in range(3_000)] + [(9_000, words(70_000, 1))]
    got = sharding.shard_documents(frame(spark, rows, 8)).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    giant = next(r for r in got if r.doc_id == 9_000)
    assert sum(1 for r in got if r.shard == giant.shard) < 30
    others = [x for s, x in enumerate(sizes) if s != giant.shard]
    assert max(others) < 1.02 * min(others)


def test_sharding_takes_token_counts(spark):
    docs = spark.createDataFrame([(k, "same size", k) for k in range(100)], "doc_id long, text string, n_tokens long")
    assert sharding.shard_documents(docs, tokens_col="n_tokens").count() == 100


def test_token_counts_of_long_words():
    """Words beyond the trie's depth count as shorter ones do, and don't make it grow."""
    r = random.Random(2)
    scores = {"".join(r.choice("abc") for _ in range(r.randrange(1, 6))): -r.random() * 9 for _ in range(60)} | {c: -9.5 for c in "abc"}

    def count(word, trie):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            options = [(best[e - 1][0] + trie.unknown, best[e - 1][1] - len(word[e - 1].encode()))]
            options += [(best[s][0] + scores[word[s:e]], best[s][1] - 1) for s in range(max(0, e - 6), e) if word[s:e] in scores]
            best.append(max(options))
        return -best[-1][1]

    trie = token_counts.ForwardTrie(scores)
    for n in (1, 5, 63, 64, 65, 66, 200, 999):
        word = "".join(r.choice("abcé") for _ in range(n))
        assert trie.tokens(word) == count(word, trie)
    trie.clear()
    trie.tokens("abcab" * 400_000)
    assert len(trie.score) <= token_counts.DEPTH + 1


def test_token_counts_are_those_of_a_unigram_model():
    """Against the tokenizers library's own unigram model, over the words of a text and its scores."""
    from tokenizers import Tokenizer, models

    r = random.Random(8)
    letters = "etaoinshr"
    pieces = {"".join(r.choice(letters) for _ in range(r.randrange(2, 6))): -1 - 9 * r.random() for _ in range(400)} | {c: -8 - r.random() for c in letters}
    library = Tokenizer(models.Unigram([("<unk>", -20.0), *pieces.items()], unk_id=0))
    trie = token_counts.ForwardTrie(pieces)
    for _ in range(500):
        word = "".join(r.choice(letters) for _ in range(r.randrange(1, 90)))
        assert trie.tokens(word) == len(library.encode(word).ids), word


def test_packing_search_saves_bins():
    saved = before = after = bound = 0
    for seed in range(60):
        r = random.Random(seed)
        size = [r.randrange(600, 2_600) for _ in range(r.randrange(50, 250))]
        bins = packing.Bins(size, 4_096)
        bins.best_fit()
        n = len(bins.items)
        bins.search()
        m = sum(1 for x in bins.items if x)
        assert sorted(k for x in bins.items for k in x) == list(range(len(size))) and all(sum(size[k] for k in x) <= 4_096 for x in bins.items)
        saved, before, after, bound = saved + (m < n), before + n, after + m, bound + bins.fewest()
    assert saved >= 30 and after < before


def test_license_recall_over_whole_texts():
    """Templates with up to three edits at any place of a text: those that the whole text holds to 0.8 are found."""
    assert len(licenses.TEMPLATES) > 90
    scanner, r = licenses.Scanner(licenses.TEMPLATES), random.Random(1)
    filler = [f"w{k}" for k in range(3_000)]
    hit = total = 0
    for name, template in licenses.TEMPLATES.items():
        w = licenses.words_of(template)
        want = licenses.shingles(w)
        for _ in range(12):
            v = list(w)
            for _ in range(r.randrange(4)):
                at, kind = r.randrange(len(v)), r.random()
                v[at : at + (kind > 0.5)] = [r.choice(filler) for _ in range(r.choice([1, 3, 10, 20]))] if kind < 0.8 else []
            text = " ".join([r.choice(filler) for _ in range(r.randrange(200))] + v + [r.choice(filler) for _ in range(r.randrange(200))])
            if len(want & licenses.shingles(licenses.words_of(text))) >= 0.8 * len(want):
                total += 1
                hit += any(x[0] == name for x in scanner.scan(text))
    assert total > 400 and hit >= 0.98 * total


def test_quality_lines(spark):
    prose = "This is a sentence about subscribe buttons and cookie recipes, with a newsletter in it."
    bad = ["Home » Shop » Shoes", "https://example.org/a?b=c", "Startseite", " Se connecter ", "Tous droits réservés", "Wir verwenden Cookies", "Suscríbete", "a | b | c", "MENU", "www.example.org", "x" * 70]
    good = [prose, "# Heading", "R&D costs", "Price: $40", "See https://example.org for more", "यह एक वाक्य है और यह बहुत लंबा है ताकि नियम लागू हो सके यहाँ भी।", "ก" * 80, "Home is where the heart is"]
    body = lambda k: "\n".join(" ".join(random.Random(100 * k + j).choices(string.ascii_lowercase, k=30)) + " end." for j in range(6))
    rows = [(k, x + "\n" + body(k)) for k, x in enumerate(bad + good)]
    left = {r.doc_id: r.text.split("\n")[0] for r in quality.cleaned(frame(spark, rows)).collect()}
    assert all(left[k] != x for k, x in enumerate(bad)), [x for k, x in enumerate(bad) if left[k] == x]
    assert all(left[k + len(bad)] == x for k, x in enumerate(good)), [x for k, x in enumerate(good) if left[k + len(bad)] != x]
    same(quality.quality(frame(spark, rows)), brute.quality(rows), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_quality_rules_are_evaluated_once(spark):
    plan = quality.cleaned(frame(spark, ROWS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lorem ipsum") == 1
