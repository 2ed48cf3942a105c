"""The ten operators against brute force: usual tables, and nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests.llm import brute

from tessera.llm import bpe, exact_dedup, gsaca, licenses, packing, quality, sharding, simhash, suffix_dedup, token_counts, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, keep_id string, shard int, size long, fp long, key string, anchor long, m_id long, tokens long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "Zürich", "a", "nder", "thing", "and", "que", "straße", "x1", "don't", "ole."]) + str(r.randrange(40)) * (r.random() < 0.4) for _ in range(n))


def edge_rows():
    a, b = words(300, 1), words(120, 2)
    rows = [(1, a), (2, a), (9, a), (3, b), (4, b[:300] + " changed " + b[300:]), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (10, "Two words"), (11, words(60_000, 3)), (12, "x" * 5_000), (13, "!" * 400), (14, "!" * 90)]
    rows += [(15, "A line.\nA line.\nA line.\nA line.\n" * 20), (16, "menu | home | log in |\n" * 8 + a), (17, "Released under the MIT License.\n" + b), (18, licenses.TEMPLATES["mit"] + " and more " + b)]
    rows += [(19, "<|endoftext|> and <|ENDOFTEXT|> a<|startoftext|>b"), (20, "é́ ΑΣ İ 日本語 １２ \x1c\x85\xa0 z"), (21, a.upper()), (22, a[100:900]), (23, "short" * 9 + b[:60]), (None, a), (None, "null id only"), (24, "null id only")]
    rows += [(3, b), (25, a + "\n" + b), (26, "ab" * 200), (27, "ba" * 100), (-5, b[40:200])]
    return rows


ROWS = edge_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "d", "k", 1, 2, 3, "y", 4, 5, 6) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(df, expected, *columns):
    assert rows_of(df, *columns) == sorted((tuple(x[: len(columns)]) for x in expected), key=repr)


def test_bpe(docs, empty):
    same(bpe.digests(docs, PATH), brute.bpe(ROWS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    coded = bpe.encode(docs, PATH)
    assert rows_of(coded, "doc_id", "ids") == sorted(((i, brute.encode(t)) for i, t in ROWS), key=repr)
    back = {r.doc_id: r.text for r in bpe.decode(coded, PATH).collect()}
    assert back[10] == brute._bpe.decode(brute.encode("Two words"), skip_special_tokens=False)
    assert bpe.digests(empty, PATH).count() == 0 and bpe.encode(empty, PATH).count() == 0


def test_bpe_long_words_and_slices(monkeypatch):
    coder = bpe.load(PATH)
    for seed in range(40):
        r = random.Random(seed)
        w = bytes(r.choice(b"abcdethn") for _ in range(r.randrange(1, 60)))
        assert coder.merge_short([w])[0] == coder.merge_long(w)
    monkeypatch.setattr(bpe, "SLICE", 50)
    text = words(200, 5)
    assert "".join(bpe.slices(text)) == text and len(list(bpe.slices(text))) > 5


def test_licenses(docs, empty, spark):
    expected = []
    for i, t in ROWS:
        w = licenses.words_of(t or "")
        n = min(5, len(w))
        run = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if n else []
        for name, template in licenses.TEMPLATES.items():
            want = licenses.shingles(licenses.words_of(template))
            size = 1 << (len(want) - 1).bit_length()
            best = max((len(want & set(run[lo : lo + 2 * size])) for lo in range(0, len(run), size)), default=0)
            if best >= 0.8 * len(want):
                expected.append((i, name, best, len(want)))
    assert {x[1] for x in expected} == {"mit-line", "mit"}
    same(licenses.license_scan(docs), expected, "doc_id", "license", "n_shared", "n_template")
    assert licenses.license_scan(empty).count() == 0
    near = licenses.TEMPLATES["isc"].replace("purpose", "use")  # 28 of 33 shingles are left
    assert [r.license for r in licenses.license_scan(spark.createDataFrame([(1, near)], "doc_id long, text string")).collect()] == ["isc"]


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
def test_exact_dedup(docs, empty, keep, best):
    out = exact_dedup.exact_dedup(docs, keep)
    same(out.selectExpr("*", "lower(hex(digest)) h"), brute.exact(ROWS, best), "doc_id", "keep_id", "group_size", "kept", "h")
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_with_short_digests(spark):
    rows = [(k, f"text {k % 90}") for k in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(exact_dedup.exact_dedup(many, digest_bytes=4), brute.exact(rows), "doc_id", "keep_id", "group_size", "kept")


def test_exact_dedup_separates_collisions(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b")]
    source = exact_dedup.texts(spark.createDataFrame(rows, "doc_id long, text string"))
    digest = exact_dedup.F.substring(exact_dedup.F.unhex(exact_dedup.F.sha2("text", 256)), 1, 32)
    members = source.select("doc_id", digest.alias("digest"))
    verdict = members.groupBy("digest").agg(exact_dedup.F.max("doc_id").alias("keep_id"), exact_dedup.F.count("digest").alias("group_size"))
    out = exact_dedup._separated(source, members, verdict, members.where("doc_id = 1").select("digest"), "largest", 32, 5)
    same(out, brute.exact(rows), "doc_id", "keep_id", "group_size", "kept")


def test_lsm_index_compacts_and_finds():
    index = exact_dedup.LsmIndex(np.minimum)
    r = random.Random(1)
    seen = {}
    for run in range(11):
        part = sorted({bytes([r.randrange(1, 9)]) * 8 for _ in range(5)})
        hit = index.add(np.array(part, "S8"), np.array([run * 10 + k for k in range(len(part))]))
        assert hit.tolist() == [p in seen for p in part]
        for k, p in enumerate(part):
            seen.setdefault(p, run * 10 + k)
    index.compact(full=True)
    (run,) = index.runs
    assert dict(zip(run.digests.tolist(), run.best.tolist(), strict=True)) == seen


def test_quality(docs, empty):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    expected = brute.quality(ROWS)
    same(quality.quality(docs), expected, *names)
    left = quality.cleaned(docs)
    assert left.columns == docs.columns
    clean = [(i, t if not bad else "\n".join(good)) for (i, t), (*_, kept, good, bad) in zip(ROWS, expected, strict=True) if kept]
    same(left, clean, "doc_id", "text")
    assert quality.quality(empty).count() == 0 and quality.cleaned(empty).count() == 0
    plan = quality.quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hashpartitioning" not in plan


def test_warc(spark, tmp_path):
    rows = [(5, "u/5\r\nx", "same"), (2, None, "same"), (9, "u", None), (1, "u", ""), (7, "u", "é" * 70_000), (2, "u", "same"), (None, "u", "same"), (None, "v", "only")]
    rows += [(100 + k, f"http://h/{k}", f"<html><body>page {k % 40} {words(30, k % 40)}</body></html>") for k in range(200)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, kind int").repartition(3)
    same(warc.round_trip(pages), brute.warc([(i, h) for i, _, h in rows]), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    manifest = warc.write_archives(pages, (tmp_path / "w").as_uri())
    raw = open(manifest.first().path.removeprefix("file://"), "rb").read()
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")
    got = {(r.page_id, r.payload) for r in warc.read_archives(manifest).where("record_type = 'response' and page_id > 50").collect()}
    assert (100, rows[8][2].encode()) in got
    assert warc.round_trip(pages.where("false")).count() == 0
    with pytest.raises(ValueError, match="within a record"):
        list(warc.records(raw[:-3]))


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS), key=repr)
    slots, where = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        where[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in where.values())
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_is_even(spark):
    rows = [(k, words(5 + k % 60, k)) for k in range(4_000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.01 * min(sizes)


def test_token_counts(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = token_counts.vocabulary(path)
    unknown, most = min(scores.values()) + token_counts.UNKNOWN, max(map(len, scores))

    def count(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            options = [(best[e - 1][0] + unknown, best[e - 1][1] - len(word[e - 1].encode()))]
            options += [(best[s][0] + scores[word[s:e]], best[s][1] - 1) for s in range(max(0, e - most), e) if word[s:e] in scores]
            best.append(max(options))
        return -best[-1][1]

    expected = [(i, len(w := (t or "").encode().split()), sum(count("▁" + x.decode()) for x in w)) for i, t in ROWS]
    same(token_counts.token_counts(docs, path), expected, "doc_id", "n_words", "n_tokens")
    assert token_counts.token_counts(empty, path).count() == 0


def test_packing(docs, empty):
    got = packing.pack_documents(docs, PATH).collect()
    coded = defaultdict(list)
    for i, t in ROWS:
        coded[i].append([*brute.encode(t), 1])
    bins, total = defaultdict(list), defaultdict(int)
    for r in got:
        assert r.start == 4096 * r.piece
        parts = [e[r.start : r.start + r.length] for e in coded[r.doc_id]]
        assert any(len(p) == r.length and zlib.crc32(np.array(p, "<u4").tobytes()) == r.ids_crc32 and (r.length == 4096 or r.start + r.length == len(e)) for p, e in zip(parts, coded[r.doc_id], strict=True))
        bins[r.sequence_id].append((r.offset, r.length))
        total[r.doc_id] += r.length
    assert total == {i: sum(map(len, e)) for i, e in coded.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(total.values()) // 4096) + 1
    assert packing.pack_documents(empty, PATH).count() == 0


def test_local_search_empties_bins():
    for seed in range(60):
        r = random.Random(seed)
        size = [r.randrange(1, 60) for _ in range(r.randrange(1, 60))]
        b = packing.Bins(size, 100)
        b.best_fit()
        before = sum((100 - g) ** 2 for g in b.gap)
        n = len(b.items)
        b.search()
        assert sum((100 - g) ** 2 for g in b.gap) >= before
        assert sorted(k for x in b.items for k in x) == list(range(len(size)))
        assert all(sum(size[k] for k in x) == 100 - g <= 100 for x, g in zip(b.items, b.gap, strict=True))
        assert sum(1 for x in b.items if x) <= n
    assert len(packing.pack_lengths([6, 5, 5, 4, 4, 3, 3], 10)) == 3


def test_suffix_array():
    r = random.Random(3)
    for _ in range(300):
        t = bytes(r.choice(b"abc") for _ in range(r.randrange(50)))
        assert gsaca.suffix_array(t) == sorted(range(len(t) + 1), key=lambda k, t=t: t[k:])


@pytest.mark.parametrize("options", [{}, {"engine": "python"}, {"travel": 0}, {"travel": 1, "anchor_bytes": 300}, {"travel": 0, "anchor_bytes": 200}])
def test_suffix_dedup(docs, options):
    same(suffix_dedup.digests(docs, **options), brute.suffix(ROWS), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup_text_and_empty(docs, empty):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    same(out, [(i, t if not n else kept.decode(errors="ignore")) for (i, t), (_, _, n, _, _, kept) in zip(ROWS, brute.suffix(ROWS), strict=True)], "doc_id", "text")
    assert suffix_dedup.digests(empty).count() == 0


def test_suffix_dedup_small_width(spark):
    r = random.Random(9)
    rows = [(k, "".join(r.choice("ab ") for _ in range(r.randrange(0, 60)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(suffix_dedup.digests(docs, width=8), brute.suffix(rows, 8), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_simhash(docs, empty):
    same(simhash.near_duplicates(docs), brute.simhash(ROWS), "doc_id", "fingerprint", "component_id")
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bucket", [4096, 3])
def test_simhash_links_by_bits(spark, bucket):
    """Chains, stars and hot keys of fingerprints: components are those of all pairs within two bits."""
    r = random.Random(bucket)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            for b in r.sample(range(64), r.choice([1, 2, 2, 3])):
                x ^= 1 << b
    base = r.getrandbits(64)
    fps |= {base ^ 1 << b for b in range(30)} | {base ^ (r.getrandbits(12) << 4) for _ in range(40)}
    fps = sorted(fps)
    found = simhash.links(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long"), bucket=bucket)
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found.collect():
        up[find(a % 2**64)] = find(b % 2**64)
    comp = brute.component_of(fps)
    pairs = {(find(f), c) for f, c in zip(fps, comp, strict=True)}
    assert len(pairs) == len({c for c in comp}) == len({p for p, _ in pairs})


def test_components(spark):
    from tessera.llm.common import components

    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (200, 200), (7, 3), (-1, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[100] == got[95] == 90 and got[300] == -1 and 200 not in got


def test_lookup_with_hot_keys(spark, monkeypatch):
    from tessera.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rows = spark.createDataFrame([(k, "hot" if k % 3 == 0 else f"c{k % 50}") for k in range(300)] + [(999, "none")], "id long, key string")
    index = rows.where("key <> 'none'").groupBy("key").count().withColumnRenamed("count", "n")
    out = {r.id: r.n for r in common.lookup(rows, index, "key", "n", 301).collect()}
    assert len(out) == 301 and out[0] == 100 and out[999] is None
