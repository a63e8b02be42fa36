"""The quality model and the whole pipeline against plain versions."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyspan.llm import mixing, quality, simhash
from tallyspan.llm.common import least_linked


def zipf(rng, n):
    return " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in np.minimum(rng.zipf(1.4, n), 600))


def plain_kneser_ney(sample):
    """log p(w | u, v) of an interpolated modified Kneser-Ney model, with dictionaries."""
    count = Counter(w for t in sample for w in quality.words_of(t))
    known = {w for w, n in count.items() if n > 1}
    once = Counter(quality.shape(w) for w, n in count.items() if n == 1)
    name = lambda w: w if w in known else quality.shape(w)
    three = Counter()
    for t in sample:
        s = ["<", "<", *map(name, quality.words_of(t)), ">"]
        three.update(zip(s, s[1:], s[2:]))
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)

    def discounts(c):
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else y for k in (1, 2, 3)]
        return [0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))]

    def order(c):
        d, total, cut = discounts(c), Counter(), defaultdict(float)
        for key, n in c.items():
            total[key[:-1]] += n
            cut[key[:-1]] += d[min(n, 3)]
        return lambda ctx, w, low: ((c[(*ctx, w)] - d[min(c[(*ctx, w)], 3)]) / total[ctx] if c[(*ctx, w)] else 0.0) + cut[ctx] / total[ctx] * low if ctx in total else low

    p3, p2, p1 = order(three), order(two), order(Counter({(w,): n for w, n in one.items()}))
    size = len(known) + quality.END  # words, shapes and the end; the start is never next

    def logp(u, v, w):
        at = name(w)
        p = p3((u, v), at, p2((v,), at, p1((), at, 1 / size)))
        return math.log(p) - (math.log(max(once[at], 1)) if isinstance(at, int) else 0)

    def nll(text):
        raw = [*quality.words_of(text), ">"]
        s = ["<", "<", *map(name, raw[:-1])]
        return -sum(math.log(p3((s[i], s[i + 1]), ">", p2((s[i + 1],), ">", p1((), ">", 1 / size)))) if w == ">" else logp(s[i], s[i + 1], w) for i, w in enumerate(raw))

    return nll


def test_perplexity_equals_a_plain_model(spark):
    rng = np.random.default_rng(3)
    sample = [zipf(rng, 60) + f" only{i} {i}9 a.{i}" for i in range(40)]
    texts = sample[:5] + [zipf(rng, 50) for _ in range(5)] + ["", "new words here 77 ...", None]
    nll = plain_kneser_ney([t.encode() for t in sample])
    model = quality.fit(spark.createDataFrame([(t,) for t in sample], "text string"))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.surprisals(docs, model).collect():
        want = nll((texts[r.doc_id] or "").encode())
        assert abs(r.nll - want) < 1e-3 * max(1, want), (r.doc_id, r.nll, want)


def test_driver_holds_one_shard_of_the_model_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(6)
    sample = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 300, 60)), "en") for i in range(200)], "doc_id long, text string, lang string")
    scores = lambda m: sorted(map(tuple, quality.surprisals(sample, m).select("doc_id", "n_tokens", "nll").collect()))
    want = scores(quality.fit(sample.select("text")))
    frame, got = type(sample), []
    for name in ("toArrow", "collect"):
        monkeypatch.setattr(frame, name, lambda self, f=getattr(frame, name): [x := f(self), got.append(getattr(x, "num_rows", None) or len(x))][0])
    monkeypatch.setattr(quality, "SHARD_ROWS", 1_500, raising=False)
    model = quality.fit(sample.select("text"))
    held, most = sum(got), max(got)
    monkeypatch.undo()
    assert held > 25_000 and most < 3_000 and len(model["shards"]) > quality.SHARDS
    assert scores(model) == want


def plain_stages(rows, kept):
    """Documents (doc_id, text, lang, source, n_chars) after near-dedup, substring dedup and mixing, from those kept."""
    docs = sorted((r for r in rows if kept(r)), key=lambda r: (r[0] is None, r[0] or 0))
    fp = np.array([simhash.fingerprint((r[1] or "").encode()) for r in docs], np.uint64)
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    first = least_linked(len(docs), i, j)
    docs = [r for k, r in enumerate(docs) if first[k] == k]
    seen, n = Counter(), 35
    split = [(r[1] or "").split() for r in docs]
    for w in split:
        seen.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for r, w in zip(docs, split):
        lost = {k + m for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for m in range(n)}
        text = " ".join(x for k, x in enumerate(w) if k not in lost) if lost else r[1]
        out.append((r[0], text, r[2], r[3], len(text or "")))
    u = lambda x: int(hashlib.md5(("mix" + ("\0" if x is None else str(x))).encode()).hexdigest()[:8], 16) / 2**32
    size = lambda r: len((r[1] or "").split())
    totals = Counter()
    for r in out:
        totals[r[3]] += size(r)
    names = sorted(totals, key=lambda x: (x is None, x))
    weight, target, left, open_ = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}, {}, 1.5 * sum(totals.values()), set(names)
    while open_:
        level = left / sum(weight[x] for x in open_)
        over = [x for x in open_ if level * weight[x] > 2 * totals[x] + 1e-9]
        if not over:
            target |= {x: level * weight[x] for x in open_}
            break
        for x in over:
            target[x] = 2.0 * totals[x]
            left -= target[x]
            open_.discard(x)
    mix = []
    for x in names:
        share = target[x] / totals[x] if totals[x] else 0.0
        for k, r in enumerate(sorted((r for r in out if r[3] == x), key=lambda r: (size(r), u(r[0]), r[0] is not None, r[0] or 0)), 1):
            mix += [r] * (math.floor(u(x) + share * k) - math.floor(u(x) + share * (k - 1)))
    return mix


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    shared = " ".join(f"p{k}" for k in range(60))
    rows = [(i, zipf(rng, 120), "en", f"s{i % 4}" if i % 9 else None) for i in range(300)]
    rows += [(300 + i, rows[i][1], "en", "s0") for i in range(20)] + [(400 + i, " ".join(f"q{j}###" for j in range(99)), "en", "s1") for i in range(3)]
    rows += [(500 + i, f"{zipf(rng, 60)} {shared} {zipf(rng, 40 + i)}", "en", "s2") for i in range(6)] + [(600, None, None, None), (601, "", "de", "s3"), (None, zipf(rng, 90), "en", "s1")]
    rows = [(*r, len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    keep = {r.doc_id: r.keep for r in quality.judge(df, labels).collect()}
    assert not any(keep[i] for i in (400, 401, 402)) and sum(keep.values()) > 300
    want = plain_stages(rows, lambda r: keep[r[0]])
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert Counter(map(tuple, docs.collect())) == Counter(want)
    packed = corpus_pipeline.run(spark, str(tmp_path)).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    again = corpus_pipeline.packing.pieces(spark.createDataFrame(want, df.schema), corpus_pipeline.word_tokenizer())
    assert all(r.n == r.end <= 2048 for r in packed) and sum(r.n for r in packed) == again.agg(F.sum("length")).first()[0]
    assert len(packed) <= math.ceil(sum(r.n for r in packed) / 2048) + 1
    assert mixing.MOST == 2.0


def test_thresholds_equal_a_plain_version(spark):
    """Means and quantiles of each language's fresh trusted documents, shrunk to those of all; then who stays."""
    rng = np.random.default_rng(8)
    langs = ["en"] * 160 + ["de"] * 60 + [None] * 30 + ["fr"] * 5
    docs = [(i, zipf(rng, int(rng.integers(5, 80))), lang) for i, lang in enumerate(langs)]
    docs += [(300 + i, " ".join(f"z{j}#" for j in range(30)), lang) for i, lang in enumerate(["en", "de", None, "fr", "xx"])] + [(400, None, "en"), (401, "", "xx")]
    labels = [(i, 1, 0) for i in range(0, 240, 2)] + [(1, 1, 1), (3, 0, 0), (4, 0, 0)]  # 1 is toxic, 3 bad, 4 labelled both ways
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(df, lab, max_docs=60).collect()}
    trusted = {i for i, q, x in labels if q == 1 and x == 0} - {1, 3, 4}
    fitting = {r.doc_id for r in quality.fitting_ids(df, quality.trusted_ids(lab), 60, quality.MAX_CHARS).collect()}
    assert len(fitting) <= 60 and fitting <= trusted
    model = quality.fit(df.where(F.col("doc_id").isin(*fitting)).select("text"))
    nll = {r.doc_id: (r.lang, r.nll, r.n_tokens) for r in quality.surprisals(df, model).collect()}
    fresh = [nll[i] for i in trusted - fitting]
    assert fresh

    def shrunk(value):
        """value of some (lang, nll, tokens), by language."""
        every, out = value(fresh), {}
        for lang in {x[0] for x in nll.values()}:
            own = [x for x in fresh if x[0] == lang]
            out[lang] = ((len(own) * value(own) if own else 0.0) + quality.SHRINK * every) / (len(own) + quality.SHRINK)
        return out

    mean = shrunk(lambda rows: sum(x[1] for x in rows) / sum(x[2] for x in rows))
    smooth = lambda x: math.exp((x[1] + quality.PRIOR * mean[x[0]]) / (x[2] + quality.PRIOR))
    limit = shrunk(lambda rows: sorted(map(smooth, rows))[math.ceil(quality.QUANTILE * len(rows)) - 1])
    assert len(got) == len(docs)
    for i, x in nll.items():
        assert math.isclose(got[i].perplexity, smooth(x), rel_tol=1e-6) and math.isclose(got[i].threshold, limit[x[0]], rel_tol=1e-6), i
        assert got[i].keep == (got[i].perplexity <= got[i].threshold)
    assert not any(got[i].keep for i in range(300, 305)) and got[400].keep and got[401].keep
    assert all(r.keep and r.threshold is None for r in quality.judge(df, lab.limit(0)).collect())
