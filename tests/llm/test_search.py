"""Ranked search, centroid clustering and personal data against brute force, and their edge cases."""

import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyspan.llm import centroids, pii, ranking


# ---- ranked search
def brute_ranks(docs, items, top=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    n_docs, total = len(found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    for item, query in queries.items():
        scored = []
        for i, t in found:
            s, m = 0, 50 + 50 * len(t) * n_docs // total
            for w in query & set(t):
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 20 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out.update({(item, r): (i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)})
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PART", 4000)
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(("W" if k % 3 else "w") + str(k) + (", ", "-", " ", "é ")[k % 4] for k in np.minimum(rng.zipf(1.3, n), 400))
    docs = [(k, text(int(rng.integers(1, 60)))) for k in range(400)]
    docs += [(k, docs[7][1]) for k in range(400, 500)]  # ties past the last place
    docs += [(500, None), (501, ""), (502, "... \t"), (None, docs[3][1]), (3, docs[3][1]), (3, docs[4][1]), (503, text(20_000)), (504, "x" * 9000 + " w1")]
    items = [(k, docs[k * 7 % 400][1]) for k in range(30)] + [(2, "W1 other"), (None, "w2 w3"), (40, "unheard"), (41, None), (42, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as query", "3 as score").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "4 as rank")
    want = brute_ranks(docs, items)
    for block in (2000, 9):
        rows = ranking.search(d, b, block=block).collect()
        assert len(rows) == len(want) and {(r.item_id, r.rank): (r.doc_id, r.score) for r in rows} == want
    assert ranking.search(d.limit(0), b).count() == 0 and ranking.search(d, b.limit(0)).count() == 0


def test_reading_stops_before_the_ends_and_keeps_ties():
    rng = np.random.default_rng(2)
    n = 20_000
    doc = np.r_[np.arange(n), rng.choice(n, 200, replace=False)]
    term = np.r_[np.zeros(n, int), np.ones(200, int)]
    impact = np.r_[rng.integers(1, 1000, n), rng.integers(500, 1000, 200)]
    s = ranking.Segment(doc, term, impact, n, 2)
    w = np.array([1, 1000])
    docs, scores = s.best(np.array([0, 1]), w, 0, 10)
    exact = np.zeros(n, int)
    np.add.at(exact, doc, w[term] * impact)
    assert len(docs) < n / 10 and not s.seen.any() and not s.met.any()
    kth = np.sort(exact)[-10]
    assert set(np.flatnonzero(exact >= kth)) <= set(docs) and (exact[docs] == scores).all()
    assert len(s.best(np.array([0, 1]), w, 10**9, 10)[0]) == 0
    tied = ranking.Segment(np.arange(n), np.zeros(n, int), np.full(n, 5), n, 1)
    assert len(tied.best(np.array([0]), np.array([1]), 0, 10)[0]) == n


def test_wide_length_quotients():
    n = np.array([1, 10**9])
    want = [10**9 * 3 // (3000 + 20 * (50 + 50 * int(k) * 10**11 // 10**14)) for k in n]
    assert ranking.impacts(np.array([3, 3]), n, 10**11, 10**14).tolist() == want


# ---- clustering
def brute_clusters(vectors, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda p: (p[0] is None, mark(p[0]), p[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((gap(v, m), j) for j, m in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, a) in zip(kept, of) if a == j]
            c[j] = [sum(x) // len(own) for x in zip(*own)] if own else c[j]
    of = assign()
    total = sum(d for d, _ in of)
    within = {j: sum(d for d, a in of if a == j) for j in range(len(c))}
    return sorted((i or -1, a, d, within[a], total, hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), (d, a) in zip(kept, of))


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    about = rng.normal(0, 0.2, (12, 64))
    v = [(k, [float(x) for x in np.float32(about[k % 12] + rng.normal(0, 0.05, 64))]) for k in range(150)]
    v += [(k, v[3][1]) for k in range(150, 170)] + [(3, v[3][1]), (3, v[5][1]), (None, v[9][1])]
    v += [(900, None), (901, v[0][1][:63]), (902, [None, *v[0][1][1:]]), (903, [float("nan"), *v[0][1][1:]]), (904, [float("inf"), *v[0][1][1:]]), (905, []), (906, [0.0] * 64), (907, [1e30, *v[0][1][1:]])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").selectExpr("*", "1 as cluster", "2 as v", "3 as n")
    rows = centroids.cluster_table(df).collect()
    got = sorted((-1 if r.vec_id is None else r.vec_id or -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows)
    assert got == brute_clusters([p for p in v if p[0] != 907])
    few = centroids.cluster_table(df.where("vec_id in (1, 2)")).collect()
    assert sorted((r.vec_id, r.distance) for r in few) == [(1, 0), (2, 0)]
    assert centroids.cluster_table(df.limit(0)).collect() == [] and centroids.cluster_table(df.where("vec_id = 900")).collect() == []


def test_search_takes_few_distances_and_never_misses():
    rng = np.random.default_rng(3)
    c = rng.integers(-200, 200, (40, 64)) // np.r_[1, 2, 4, 8].repeat(10)[:, None]
    c[7], c[9] = c[3], -c[9]
    x = np.r_[c, rng.integers(-200, 200, (500, 64)), c[rng.integers(0, 40, 500)] + rng.integers(-3, 4, (500, 64)), np.zeros((1, 64), int)]
    which, best, taken = centroids.nearest(x, c)
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (which == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert taken < 0.6 * every.size
    wide = rng.integers(-(1 << 27), 1 << 27, (50, 64))
    which, best, _ = centroids.nearest(wide, wide[:9])
    every = ((wide[:, None, :] - wide[None, :9]) ** 2).sum(axis=2)
    assert (which == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


# ---- personal data
EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_luhn(d):
    twice = [2 * int(x) for x in d[-2::-2]]
    return (sum(map(int, d[-1::-2])) + sum(x // 10 + x % 10 for x in twice)) % 10 == 0


def plain_spans(t):
    out = [(0, *m.span()) for m in re.finditer(EMAIL, t)]
    out += [(1, *m.span()) for m in re.finditer(IP, t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(CARD, t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and plain_luhn(d)]
    return out + [(3, *m.span()) for m in re.finditer(PHONE, t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(13)
    parts = ["a", "b.c", "@", "@@", ".", "..", "1", "255", "256", "007", "4111111111111111", "4111 1111-1111 1111", "+", "+1", "(", ") ", " ", "-", "555", "é", "٣", "\n", "a@b.c", "1.2.3.4", "%", "_"]
    for _ in range(6000):
        t = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("9" * 200_000, "a" * 200_000, "+1" + "(" * 200_000, "1." * 100_000, "a@" * 100_000, "@" + "a" * 200_000):
        pii.base_spans(t)  # linear in the length


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(4)
    g = pii.Graph()
    g.add("mail a.b1@x.org or 12 34 then 555-1234567 and 5551234567 end", 0, [])
    assert len(g.edges) == 2 and len(g.start) == 5
    f = pii.Field(rng.normal(0, 1, (pii._SHAPES, pii.LABELS)), rng.normal(0, 1, (1 + pii.SKIPS, pii.LABELS, pii.LABELS)))
    u, p = pii._dense(g.shape) @ f.unary, np.zeros((5, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=5):
        w = math.exp(sum(u[k, c] for k, c in enumerate(y)) + sum(f.potentials[t][y[a], y[b]] for a, b, t in g.edges))
        for k, c in enumerate(y):
            p[k, c] += w
    assert np.allclose(f.beliefs(g), p / p.sum(axis=1, keepdims=True), atol=1e-6)


def mentions(seed, n):
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    for k in range(n):
        real = [f"+1 ({num(3)}) 555-{num(4)}", f"{rng.integers(1, 255)}.{rng.integers(100, 255)}.{rng.integers(1, 255)}.{rng.integers(10, 99)}", f"joe{num(3)}x@mail{num(1)}.example.com"][k % 3]
        yield f"on {num(4)} {real} of {num(2)} and {num(2)}.{num(1)} key={num(9)} then", real


@pytest.fixture(scope="module")
def field():
    return pii.fit([t for t, _ in mentions(1, 400)])


def test_other_writings_are_found_and_clean_words_left_alone(field):
    found = wrong = rewritten = 0
    for text, _ in mentions(2, 300):
        y, base, more = pii.practice(text)
        ((b, added),) = pii.all_spans([y], field)
        assert b == base
        rewritten += len(more)
        found += sum(any(k == k2 and a < e2 and s2 < e for k2, s2, e2 in added) for k, a, e in more)
        wrong += sum(not any(k == k2 and a < e2 and s2 < e for k2, s2, e2 in more) for k, a, e in added)
    assert rewritten >= 250 and found >= 0.9 * rewritten and wrong <= 0.02 * rewritten
    assert sum(len(a) for _, a in pii.all_spans([t for t, _ in mentions(3, 300)], field)) == 0


def test_results_do_not_depend_on_the_batch(field):
    texts = [pii.practice(t)[0] for t, _ in mentions(5, 40)]
    assert pii.all_spans(texts, field) == [pii.all_spans([t], field)[0] for t in texts]


def test_private_data_edges(spark, field):
    many = "call +1 (222) 555-0000 or " + "2225550000 x " * 3000
    texts = ["", None, "no data", "a.b@c.de, 1.2.3.4 and 4111 1111 1111 1111 or +1 (222) 555-0000 é 222-555-0000.", many, many, "é" * 100_000 + " a@b.cd"]
    rows = [(None if k == 3 else k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as spans", "1 as n_ip", "2 as row")
    got = {r.doc_id: r for r in pii.private_data(df, field).collect()}
    assert len(got) == len(texts)
    for k, t in rows:
        base = plain_spans(t or "")
        joined = lambda s: ",".join(f"{pii.KINDS[a]}:{b}:{c}" for a, b, c in s)
        assert got[k].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
        assert set(joined(base).split(",")) <= set(got[k].spans.split(",")) and got[k].n_added == len(got[k].spans.split(",")) - len(joined(base).split(","))
    assert got[4].n_added == 3000 and got[4].spans == got[5].spans and got[0].spans == ""
    a = texts[3].index("222-555")
    assert f"phone:{a}:{a + 12}" in got[None].spans
    clean = pii.redact(df, field)
    assert clean.columns == df.columns
    clean = {r.doc_id: r for r in clean.collect()}
    assert clean[None].text == "[EMAIL], [IP] and [CARD] or [PHONE] é [PHONE]." and clean[1].text is None and clean[2].text == "no data" and clean[2].n_ip == 1
    assert pii.private_data(df.limit(0)).count() == 0 and pii.fit(["no 12 data"]) is None
    assert pii.private_data(df.where("doc_id = 2")).first().spans == ""
    assert pii.sample_texts(df) == [texts[3]]  # the others are longer than 20,000 characters or hold neither a digit nor an @


def test_texts_without_base_spans_go_through_the_field_too():
    """A field that takes every number of ten digits for a phone finds it where no pattern finds anything."""
    unary = np.zeros((pii._SHAPES, pii.LABELS))
    unary[12 + int(np.searchsorted(pii._SIZES, 10)), 1 + pii.KINDS.index("phone")] = 5
    sure = pii.Field(unary, np.zeros((1 + pii.SKIPS, pii.LABELS, pii.LABELS)))
    texts = ["call 2225550000 now", "no 12 data", "mail a@b.cd or 2225550000"]
    assert pii.all_spans(texts, sure) == [([], [(3, 5, 15)]), ([], []), ([(0, 5, 11)], [(3, 15, 25)])]
    # and texts without base spans are practice: their repeated numbers are nobody's
    field = pii.fit([t for t, _ in mentions(1, 400)] + [f"no {k}{k}27243074273{k}51 and {k}{k}27243074273{k}51" for k in range(10, 60)])
    assert pii.all_spans(["X 5927243074273351 " * 5], field) == [([], [])]
