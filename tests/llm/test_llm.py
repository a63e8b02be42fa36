"""The ten operators against plain versions, with nulls, empty and long texts, ties, copies and empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspan.llm import bloom_lm, chat, embeddings, media, mixing, packing, quality, simhash, substring, urls
from tallyspan.llm.common import connected_components, least_reachable
from tallyspan.llm.queries import word_tokenizer

DOC = "doc_id long, text string, lang string, source string, n_chars long, node string, n int"


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, 5000, n))


@pytest.fixture(scope="module")
def docs(spark):
    shared = words(0, 60)
    texts = [None, "", " \t\n", "one", "a a a a a a a a", words(1, 300), words(1, 300), words(2, 40) + " " + shared + " " + words(3, 30), shared, "x " * 5000, words(4, 9000)]
    near = words(5, 400).split()
    texts += [" ".join(near), " ".join([*near[:399], "other"]), "Ärger mit <|endoftext|> im Text", words(6, 34), words(6, 34)]
    rows = [(i, t, "en" if i % 3 else None, "s1" if i % 2 else None, len(t or ""), "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[5], (None, "no id here", None, "s2", 10, "clash", 0)], DOC)


def rows_of(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (3, 1), (8, 7)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 9: 7, 8: 7, 7: 7}
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    assert {r.component for r in connected_components(path).collect()} == {0}


def test_chat(spark):
    c = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", None), (5, 0, "user", ""), (None, 0, "user", "lost"), (6, 0, "user", "hi"), (6, 1, "user", "yo")]
    df = spark.createDataFrame(c, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.format_chats(df).collect()}
    assert got[2] == (2, 2, "<|user|>\nhi\n<|assistant|>\nyo\n") and set(got) == {2, 4, 5, 6}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_urls(spark):
    link = '<link href="/b" rel="canonical">'
    p = [(1, "http://A.org/x", ""), (2, "http://www.t.example.org/es/1?q", None), (3, "nothing", ""), (4, None, ""), (5, "http://c.net/a", link), (6, "http://c.net/b", '<meta http-equiv="refresh" content="0; url=http://d.com/de/q">'), (7, "http://d.com/de/q", ""), (8, "https://c.net/a/", ""), (9, "http://c.net/z", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_pages(spark.createDataFrame(p, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2] == ("www.t.example.org", "/es/1", "example.org/es/", "block")
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert [got[k][3] for k in (5, 6, 7, 8, 9)] == ["block", "block", "block", "block", "allow"]


@pytest.mark.parametrize("block", [1500, 20])
def test_embeddings(spark, block):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 32))
    x = np.concatenate([base, base[:10] + 0.03 * rng.standard_normal((10, 32)), base[:1] + 0.01 * rng.standard_normal((80, 32)), base[:3]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None] * 32), (904, [])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=block).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = least_reachable(near)
    for r in got:
        want = (int(near[r.vec_id].sum()), int(label[r.vec_id])) if r.vec_id < 900 else (0, r.vec_id)
        assert (r.n_links, r.component_id, r.kept) == (*want, want[1] == r.vec_id)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    want = Counter()
    for i, x in rows_of(docs):
        ids = np.array([*t.encode(x.decode(), add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    got = packing.pack_documents(docs, word_tokenizer()).toPandas()
    assert Counter((None if r.doc_id != r.doc_id else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    got = got.sort_values(["sequence_id", "offset"])
    fill = got.groupby("sequence_id").length
    assert (fill.cumsum() - got.length == got.offset).all() and fill.sum().max() <= 2048
    assert packing.pack_documents(none, word_tokenizer()).count() == 0


def test_local_search_empties_bins():
    lengths = np.array([4, 6, 3, 7])
    bins = packing.empty_bins(lengths, [[0], [1, 2], [3]], 10)  # 4 for 3, then 3 moves
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == [0, 1, 2, 3] and max(lengths[b].sum() for b in bins) <= 10
    lengths = np.array([2, 3, 4, 5, 6, 4])
    bins = packing.empty_bins(lengths, [[0, 1], [2, 3], [4], [5]], 10)
    assert sorted(i for b in bins for i in b) == list(range(6)) and len(bins) == 3 and max(lengths[b].sum() for b in bins) <= 10


def test_packing_rounds(spark):
    rng = np.random.default_rng(3)
    cut = spark.createDataFrame([(int(i), 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 2049, 3000))], packing.PIECES)
    got = packing.pack_pieces(cut, group=200, fan_in=4).toPandas()
    fill = got.groupby("sequence_id").length.sum()
    assert len(got) == 3000 and fill.max() <= 2048 and got.doc_id.nunique() == 3000


def test_packing_groups_stay_bounded(spark, monkeypatch):
    sizes, plain = [], packing._pack_groups

    def seen(rows, groups, *rest):
        sizes.append(rows.count() / groups)
        return plain(rows, groups, *rest)

    monkeypatch.setattr(packing, "_pack_groups", seen)
    rng = np.random.default_rng(4)
    cut = spark.createDataFrame([(int(i), 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1025, 2040, 1000))], packing.PIECES)
    got = packing.pack_pieces(cut, group=100, fan_in=4).toPandas()
    assert max(sizes) <= 100 and len(got) == got.doc_id.nunique() == got.sequence_id.nunique() == 1000


def test_media(spark, docs, none):
    got = {}
    for r in media.media_digests(docs).collect():
        got.setdefault(r.doc_id, r)
    for i, x in rows_of(docs):
        p = media.padded(x)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(x), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    good = media.write_container(media.padded(b"x" * 20000))
    bad = [good, good[:700], b"", None, b"\0" * 50]
    seen = media.describe_containers(spark.createDataFrame(list(enumerate(bad)), "k long, c binary"), "k", "c").orderBy("k").collect()
    assert seen[0].problem is None and seen[0].n_samples == 35 and seen[0].duration_s == 35 * 576 / 48000 and len(seen[0].keyframes) == 5
    assert all(r.problem for r in seen[1:]) and media.media_digests(none).count() == 0


def test_quality(spark):
    rng = np.random.default_rng(2)
    zipf = lambda n: " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in np.minimum(rng.zipf(1.5, n), 600))
    rows = [(i, zipf(80), "en") for i in range(400)] + [(1000 + i, " ".join(f"q{j}###" for j in range(60)), "en") for i in range(5)] + [(2000, None, None), (2001, "", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as keep", "2 as nll")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)] + [(0, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    assert sum(got[i].keep for i in range(400)) >= 390 and not any(got[1000 + i].keep for i in range(5)) and len(got) == 407
    assert quality.keep_good(df, labels).columns == df.columns
    assert all(r.keep for r in quality.judge(df, labels.limit(0)).collect())


def test_keep_good_drops_rejected_texts_only(spark):
    rng = np.random.default_rng(8)
    clean = lambda: " ".join(f"w{chr(97 + k % 26)}" for k in np.minimum(rng.zipf(1.5, 80), 600))
    junk = " ".join(f"q{j}###" for j in range(60))
    good = [(i, clean(), "en") for i in range(300)]
    more = [(None, good[0][1], "en"), (None, good[1][1], "en"), (400, good[2][1], "en")]
    df = spark.createDataFrame(good + more + [(None, junk, "en"), (400, junk, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    kept = Counter(map(tuple, quality.keep_good(df, labels).collect()))
    verdict = {r.doc_id: r.keep for r in quality.judge(df, labels).where("doc_id < 300").collect()}
    assert junk not in {t for _, t, _ in kept} and all(verdict[k] == (row in kept) for k, row in enumerate(more))


def test_quality_sample_and_thresholds_by_language(spark):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"w{chr(97 + k % 26)}" for k in np.minimum(rng.zipf(1.5, n), 600))
    rows = [(i, text(40), "en" if i % 6 else "de") for i in range(240)] + [(300 + i, text(400), "en") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = df.select("doc_id")
    lang, size = {i: x for i, _, x in rows}, {i: len(t) for i, t, _ in rows}
    got = [(r.doc_id, r.lang) for r in quality.fitting_ids(df, ids, 20, 400).collect()]
    n = Counter(x for _, x in got)
    assert 6 <= n["de"] <= 10 and 6 <= n["en"] <= 10 and all(size[i] <= 400 and lang[i] == x for i, x in got)
    assert quality.shares({"a": 2, None: 50, "b": 50}, 20) == {"a": 2, None: 9, "b": 9}
    held = spark.createDataFrame([("de", 2.0)] * 10 + [("en", 4.0)] * 90, "lang string, x double")
    out = quality._with_language(spark.createDataFrame([("de",), ("en",), ("xx",)], "lang string"), quality._by_language(held, F.avg("x"), "mean"))
    assert {r.lang: round(r["mean"], 9) for r in out.collect()} == {"de": round((10 * 2 + 50 * 3.8) / 60, 9), "en": round((90 * 4 + 50 * 3.8) / 140, 9), "xx": 3.8}


def test_kneser_ney_sums_to_one(spark):
    sample = spark.createDataFrame([("a b c a b d a c",), ("b a a b c d",), ("c c d a b",)], "text string")
    m = quality.fit(sample)
    every = np.array([i for i in range(len(m["one"])) if i != quality.START])
    m["spread"] = np.zeros(quality.SHAPES)
    for u in every[-4:]:
        for v in every[-4:]:
            p = np.exp(quality.log_probs(np.full(len(every), u), np.full(len(every), v), every, m)).sum()
            assert abs(p - 1) < 1e-4


def test_substring(spark, docs, none):
    data = [(i, x.split()) for i, x in rows_of(docs)]
    for window in (35, 21):
        seen = Counter(b" ".join(w[k : k + window]) for _, w in data for k in range(len(w) - window + 1))
        want = []
        for i, w in data:
            cut = {k + j for k in range(len(w) - window + 1) if seen[b" ".join(w[k : k + window])] > 1 for j in range(window)}
            kept = [x for k, x in enumerate(w) if k not in cut]
            want.append((i, len(w), len(cut), hashlib.sha256(b" ".join(kept)).hexdigest()))
        assert Counter(map(tuple, substring.dedup_digests(docs, window).collect())) == Counter(want)
    assert substring.dedup_digests(none).count() == 0 and substring.dedup_documents(docs).columns == docs.columns


def test_substring_finds_any_alignment(spark):
    rng = np.random.default_rng(7)
    w = lambda n, top=50: [f"t{k}" for k in rng.integers(0, top, n)]
    rows = []
    for i in range(60):
        p = w(35, 4)
        rows += [(2 * i, " ".join(w(int(rng.integers(0, 30))) + p + w(int(rng.integers(0, 30))))), (2 * i + 1, " ".join(w(int(rng.integers(0, 30))) + p + w(int(rng.integers(0, 30)))))]
    got = {r.doc_id: r.n_removed for r in substring.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got.values()) >= 35


def test_lm(spark, docs, none):
    got = bloom_lm.score_documents(docs, frequent_words=20).collect()
    data = [(i, x, i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, x in rows_of(docs)]
    c = Counter()
    for _, x, held in data:
        if not held:
            c.update([*x.lower().split(), b""])
    n, v = sum(c.values()), len(c)
    by = {r.doc_id: r for r in got}
    for i, x, held in data:
        t = [*x.lower().split(), b""]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert (by[i].held_out, by[i].n_tokens, by[i].n_known, by[i].train_tokens) == (held, len(t), sum(c[w] > 0 for w in t), n)
        assert abs(by[i].base_score - base) < 1e-6 and by[i].score < 0
    assert len(got) == len(data) and bloom_lm.score_documents(none).count() == 0


def test_bloom_levels():
    import xxhash

    keys = np.array([xxhash.xxh64_intdigest(f"z{k}".encode()) for k in range(20_000)], np.uint64)
    want = np.r_[bloom_lm.level_of(1 + np.arange(10_000) // 50), np.zeros(10_000, int)]
    got = bloom_lm.Segment(keys[:10_000], want[:10_000].astype(np.uint8), 1).level(keys)
    assert (got >= want).all() and (got == want).mean() > 0.9
    assert (bloom_lm.Segment(keys[:10_000], want[:10_000].astype(np.uint8), 1, hashes=30).level(keys) == want).all()
    n = np.arange(1, 3000)
    level = bloom_lm.level_of(n)
    assert all(bloom_lm.VALUE[q] == (n[level == q].min() + n[level == q].max()) / 2 for q in range(1, level.max()))


def test_lm_equals_a_plain_model_that_sums_to_one(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{k}" for k in np.minimum(rng.zipf(1.3, 200), 400)) for _ in range(60)] + ["", "w1 w1 w2", None, "only here"]
    df = spark.createDataFrame([(i, x, 0, "y") for i, x in enumerate(texts)], "doc_id long, text string, chunk int, word string")
    word, pair, follow = Counter(), Counter(), {}
    data = [(i, [*(x or "").split(), ""], zlib.crc32(str(i).encode()) % 7 == 2) for i, x in enumerate(texts)]
    for _, t, held in data:
        if not held:
            word.update(t)
            pair.update(zip([None, *t], t))
    value = lambda n: bloom_lm.VALUE[bloom_lm.level_of(np.array([n]))[0]] if n else 0.0
    for (u, _), n in pair.items():
        z, k = follow.get(u, (0.0, 0))
        follow[u] = (z + value(n), k + 1)
    whole, singles = sum(map(value, word.values())), sum(n == 1 for n in word.values())
    unseen = (singles + 1) / (whole + 2)

    def p(u, w):
        one = (1 - unseen) * value(word[w]) / whole + unseen / (len(word) + 1)
        z, k = follow.get(u, (0.0, 0))
        return (value(pair[u, w]) + k * one) / (z + k) if z + k else one

    for u in (None, "w1", "w2", "w7", "never"):
        assert abs(sum(p(u, w) for w in [*word, "unseen word"]) - 1) < 1e-9
    got = [{r.doc_id: r.score for r in bloom_lm.score_documents(df, frequent_words=20, chunk=c, bucket=k, hashes=30).collect()} for c, k in ((10_000_000, 10_000_000), (700, 900))]
    near = {r.doc_id: r.score for r in bloom_lm.score_documents(df, chunk=3000, bucket=900).collect()}
    for i, t, held in data:
        want = sum(math.log10(p(u, w)) for u, w in zip([None, *t], t))
        assert abs(got[0][i] - want) < 1e-6 and abs(got[1][i] - want) < 1e-6, (i, held, got[0][i], got[1][i], want)
        assert abs(near[i] - want) < 0.02 * abs(want)  # false positives raise some counts by a level


def test_mixing(spark, docs, none):
    src = mixing.source_targets(spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 50), ("d", 0)], "source string, size long"))
    got = {r.source: r.target for r in src.collect()}
    size, weight = {"a": 100, "b": 10, "c": 1000, "d": 0, None: 50}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    want, left, open_ = {}, 1.5 * 1160, dict(weight)
    while True:
        level = left / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > 2 * size[s] + 1e-9]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= want[s]
            del open_[s]
    want |= {s: level * w for s, w in open_.items()}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)
    many = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source", "repeat('w ', cast(id % 97 as int)) as text")
    t = mixing.sampling_table(many)
    for r in t.groupBy("source").agg({"target": "max", "source_size": "max"}).collect():
        taken = t.where(t.source == r.source).selectExpr("sum(copies * size) t").first().t
        assert abs(taken - r["max(target)"]) <= 0.02 * r["max(source_size)"] + 100
    assert t.where("copies > 2").count() == 0 and mixing.sampling_table(docs).count() == docs.count() and mixing.sampling_table(none).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    data = rows_of(docs)
    fp = np.array([simhash.fingerprint(x) for _, x in data], np.uint64)
    label = least_reachable(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    ids = [i for i, _ in data]
    least = {}
    for i, g in zip(ids, label):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    assert Counter((r.doc_id, r.fp, r.component_id) for r in got) == Counter((i, int(f.astype(np.int64)), least[g]) for i, f, g in zip(ids, fp, label))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(docs).columns == docs.columns


def test_keep_first_keeps_one_of_each_component(spark):
    a, b, c, d, e = (words(50 + k, 60) for k in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (3, e), (5, e), (5, words(60, 60)), (None, e)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(None, a), (None, b), (7, c), (7, d), (3, e), rows[7]])


def test_simhash_links_whole(spark):
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    near = np.concatenate([fp, *[fp[:20] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, False))) for k in (1, 2, 3, 4, 5)], [fp[0] ^ np.uint64(a << 20 | 1 << b) for a in range(8) for b in range(20)]])
    near = np.unique(np.array(near, np.uint64))
    df = spark.createDataFrame([(int(x.astype(np.int64)),) for x in near], "fp long")
    for block, grids in ((1500, None), (30, None), (1500, 5), (70, 5), (1500, 8)):
        found = {r.node: r.component for r in connected_components(simhash.links(df, block=block, grids=grids)).collect()}
        label = least_reachable(np.bitwise_count(near[:, None] ^ near[None, :]) <= 4)
        groups = {}
        for x, g in zip(near, label):
            groups.setdefault(g, set()).add(found.get(int(x.astype(np.int64)), int(x.astype(np.int64))))
        assert all(len(s) == 1 for s in groups.values()) and len({next(iter(s)) for s in groups.values()}) == len(groups)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in np.minimum(rng.zipf(1.4, 120), 600))
    rows = [(i, text(), "en", f"s{i % 3}") for i in range(300)]
    rows += [(300 + i, rows[i][1], "en", "s0") for i in range(20)] + [(400 + i, " ".join(f"q{j}###" for j in range(99)), "en", "s1") for i in range(3)] + [(500, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = df
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path)).cache()
        assert docs.columns == df.columns, name
    ids = {r.doc_id for r in docs.collect()}
    assert not ids & set(range(300, 320)) and not ids & {400, 401, 402}
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048 and set(out.doc_id.dropna()) == ids - {None}


def test_word_ids_equal_whole_texts():
    ids = packing.WordIds(word_tokenizer(), most=5)
    odd = ["İ.", "İstanbul", "क़.", "éte", "ΣΑΣ!", "don't", "it's.", "'s", "...", "Ünï,", "ab​c", "ª1.", "x̸<", "🙂a🙂.", "THE", "the!!", "中文."]
    split = [[w.encode() for w in odd], [], [w.encode() for w in odd[::-1] * 3]]
    for text, got in zip(split, ids.of(split)):
        want = ids.tokenizer.encode(b" ".join(text).decode(), add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want
