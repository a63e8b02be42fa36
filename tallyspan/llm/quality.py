"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Labelled documents of good quality are trusted. A bounded sample of them - the documented
parameters max_docs and max_chars - gives trigram counts; counts and their context tables are
sharded by key and joined to discounted probabilities and back-off weights in Spark. The
finished tables, whose size the sample bounds, are cut into shards by the context's last
word; a task joins its documents' n-grams to each shard in turn and sums log-probabilities by
document, so no n-gram of the corpus is shuffled. The driver hands on one shard of bounded size at a time and holds
no other: words go out as one sorted column, which tasks number, and shapes are counted in tasks.

A document is rejected where its perplexity exceeds its language's threshold: a high
quantile over the trusted documents of the language that the model was not fitted on. At every
size the language's mean and quantile are shrunk to those of all languages by n / (n + 50),
n being its number of such documents.

Defined results: null text is empty, an end token alone; a null language is a language of its
own; a document with several labels is trusted only if all are good; repeated rows are scored
each, ties alike; a very long text is scored whole in parts of bounded size; without any trusted
document nothing is rejected and perplexities are null; an empty table gives an empty result; extra
columns of any name pass through keep_good(). A sample of more than 2 ^ 21 words is an error.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.llm.common import LOWER, UPPER, drop_stored, join_by_class, ship, stored, texts

ship(__name__)

#: The sample that the model is fitted on: at most so many documents of at most so many characters.
MAX_DOCS, MAX_CHARS = 5_000, 20_000
QUANTILE, SHRINK = 0.995, 50
#: Shards at least, and about how many rows of the tables one holds at most.
SHARDS, SHARD_ROWS = 8, 500_000
BITS = 21
#: Tokens at the language's mean that a document's perplexity is smoothed with: a few words tell little.
PRIOR = 30
SHAPES, START, END = 4, 4, 5  # ids below SHAPES are unknown words by shape; words follow END
_LETTERS, _ENDING = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[a-z\x80-\xff]+[.,;:!?]+")


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shape(word: bytes) -> int:
    """The unknown word's id: letters, letters and an ending mark, something with a digit, anything else."""
    if _LETTERS.fullmatch(word):
        return 0
    if _ENDING.fullmatch(word):
        return 1
    return 2 if any(48 <= c <= 57 for c in word) else 3


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents whose labels are all good."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.where("q = 1 and t = 0").select("doc_id")


def shares(have: dict, room: int) -> dict:
    """How many documents each language gives: the same number, and what a small language leaves goes to others."""
    out, left = {}, room
    for k, (lang, n) in enumerate(sorted(have.items(), key=lambda x: (x[1], x[0] is not None, x[0] or ""))):
        out[lang] = min(n, -(-left // (len(have) - k)))
        left -= out[lang]
    return out


def fitting_ids(documents: DataFrame, trusted: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, lang) of the trusted documents to fit on, of at most max_chars characters and at most max_docs:
    of the half with even hashes, by language those with the least second hash.

    The other half is never fitted on, so that thresholds come from fresh documents at any size.
    """
    short = documents.where(F.length("text") <= max_chars).select("doc_id", "lang")
    half = trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 53)) + 1) / F.lit(float(1 << 53))
    # twenty steps to each factor of e, so that the cut is as fine among few as among many
    of = stored(short.join(half, "doc_id", "left_semi").select("doc_id", "lang", F.floor(-20 * F.log(u)).cast("int").alias("step")))
    steps: dict = {}
    for lang, step, n in of.groupBy("lang", "step").count().collect():  # at most 735 steps a language
        steps.setdefault(lang, []).append((step, n))
    cut = []
    for lang, room in shares({k: sum(n for _, n in v) for k, v in steps.items()}, max_docs).items():
        for step, n in sorted(steps[lang], reverse=True):
            if n > room:
                break
            cut.append((lang, step))
            room -= n
    taken = documents.sparkSession.createDataFrame(cut, "_lang string, _step int")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("step") == F.col("_step"))
    return of.join(F.broadcast(taken), same, "left_semi").select("doc_id", "lang").distinct()


def vocabulary(sample: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """The words that the sample holds twice or more, in the order of their ids, and how many others it holds of each
    shape; bounded by the sample."""
    words = sample.select(F.explode(F.split(F.translate("text", UPPER, LOWER), r"[ \t\n\x0B\f\r]+")).alias("w"))
    counted = stored(words.where("w <> ''").groupBy("w").count())

    def run(batches):
        for batch in batches:
            n = np.bincount([shape(w) for w in texts(batch, "w")], minlength=SHAPES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SHAPES), pa.int32()), pa.array(n.astype(np.int64))], names=["shape", "n"])

    once = np.zeros(SHAPES, np.int64)
    for k, n in counted.where("count = 1").select("w").mapInArrow(run, "shape int, n long").groupBy("shape").agg(F.sum("n")).collect():
        once[k] = n
    w = counted.where("count > 1").select("w").toArrow().column("w").cast(pa.binary()).combine_chunks()
    drop_stored(counted)
    return w.take(pc.sort_indices(w)), once


def numbered(words: pa.Array) -> dict[bytes, int]:
    """The ids of vocabulary()'s words, made in the task."""
    return {w: i for i, w in enumerate(words.to_pylist(), END + 1)}


def ids_of(text: bytes, ids: dict[bytes, int]) -> list[int]:
    return [ids[w] if w in ids else shape(w) for w in words_of(text)]


def trigram_counts(sample: DataFrame, words: Broadcast) -> DataFrame:
    """(u, v, w, n) over the sample."""

    def run(batches):
        known_ids = numbered(words.value)
        for batch in batches:
            keys = []
            for t in texts(batch):
                s = np.array([START, START, *ids_of(t, known_ids), END], np.int64)
                keys.append(s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:])
            if keys:
                k, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["k", "n"])

    packed = sample.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    low = F.lit((1 << BITS) - 1)
    return packed.select(F.shiftright("k", 2 * BITS).alias("u"), F.shiftright("k", BITS).bitwiseAND(low).alias("v"), F.col("k").bitwiseAND(low).alias("w"), "n")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts for counts of one, two, and three or more, from the counts of counts."""
    n = dict(counts.where("n <= 4").groupBy("n").count().collect())
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [k - (k + 1) * y * b / a if a else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def discounted(counts: DataFrame, context: list[str], d: tuple[float, float, float]) -> tuple[DataFrame, DataFrame]:
    """(counts with the discounted share alpha, contexts with the weight gamma of the next lower order)."""
    cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    total = counts.groupBy(*context).agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"), F.count(F.lit(1)).alias("n"))
    if context == ["v"]:  # one word may go before a large part of all pairs
        rows = join_by_class(counts, total, "v", "w", counts.count())
    else:
        rows = counts.join(total.drop("n"), context)
    rows = rows.withColumn("alpha", (F.col("n") - cut) / F.col("total")).drop("total", "cut")
    return rows, total.select(*context, (F.col("cut") / F.col("total")).alias("gamma"))


def fit(sample: DataFrame) -> dict | None:
    """Model tables as arrays, the words and the shards as broadcasts; None without a sample. Their size is bounded by the sample's."""
    spark: SparkSession = sample.sparkSession
    words, once = vocabulary(sample)
    size = len(words) + END + 1
    if size > 1 << BITS:
        raise ValueError(f"the sample has more words than {BITS} bits can name; take a smaller max_docs or max_chars")
    shared = spark.sparkContext.broadcast(words)
    three = stored(trigram_counts(sample, shared))
    two = three.groupBy("v", "w").agg(F.count(F.lit(1)).alias("n"))  # in how many contexts a pair goes on
    two = stored(two)
    one = two.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rows = one.toArrow()  # the vocabulary
    if not rows.num_rows:
        return None
    n = np.zeros(size)
    n[rows.column("w").to_numpy()] = rows.column("n").to_numpy()
    d = discounts(one)
    cut = np.where(n == 1, d[0], np.where(n == 2, d[1], d[2])) * (n > 0)
    p1 = (n - cut) / n.sum() + cut.sum() / n.sum() / (size - 1)  # START is never next
    p_one = spark.createDataFrame(pa.table({"w": np.arange(size), "p": p1}))
    two_rows, two_gamma = discounted(two, ["v"], discounts(two))
    two_p = two_rows.join(two_gamma, "v").join(p_one, "w").select("v", "w", (F.col("alpha") + F.col("gamma") * F.col("p")).alias("p"))
    three_rows, three_gamma = discounted(three, ["u", "v"], discounts(three))
    two_p = stored(two_p)
    three_p = three_rows.join(three_gamma, ["u", "v"]).join(two_p, ["v", "w"]).select(
        "v", (F.shiftleft("u", 2 * BITS) + F.shiftleft("v", BITS) + F.col("w")).alias("k"), F.log(F.col("alpha") + F.col("gamma") * F.col("p")).cast("float").alias("logp")
    )
    tables = {
        "two": two_p.select("v", (F.shiftleft("v", BITS) + F.col("w")).alias("k"), F.log("p").cast("float").alias("logp")),
        "back2": three_gamma.select("v", (F.shiftleft("u", BITS) + F.col("v")).alias("k"), F.log("gamma").cast("float").alias("logp")),
        "three": three_p,
    }
    got = two_gamma.toArrow()  # the vocabulary
    back1 = np.zeros(size, np.float32)
    back1[got.column("v").to_numpy()] = np.log(got.column("gamma").to_numpy())
    return {"words": shared, "one": np.log(p1).astype(np.float32), "back1": back1, "spread": np.log(np.maximum(once, 1)), "shards": shards_of(tables)}


def shards_of(tables: dict[str, DataFrame]) -> list[Broadcast]:
    """The tables (v, k, logp) in shards by v, each {table: (sorted k, logp)}. The driver reads a shard, sends it out and lets it go."""
    names = sorted(tables)
    every = None
    for i, name in enumerate(names):
        t = tables[name].select("v", "k", "logp", F.lit(i).cast("byte").alias("of"))
        every = t if every is None else every.union(t)
    every = stored(every)
    n = max(SHARDS, -(-every.count() // SHARD_ROWS))
    out = [every.sparkSession.sparkContext.broadcast(_sorted_shard(every.where(F.pmod("v", F.lit(n)) == s), names)) for s in range(n)]
    drop_stored(every)
    return out


def _sorted_shard(rows: DataFrame, names: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    got = rows.select("k", "logp", "of").toArrow()
    k, logp, of = (got.column(c).to_numpy() for c in ("k", "logp", "of"))
    out = {}
    for i, name in enumerate(names):
        take = np.flatnonzero(of == i)
        take = take[np.argsort(k[take])]
        out[name] = (k[take], logp[take])
    return out


def release(model: dict | None) -> None:
    """Free a model that nothing reads any more."""
    for x in [model["words"], *model["shards"]] if model else []:
        x.destroy()


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is there, value or 0) of keys in a sorted table."""
    k, v = table
    if not len(k):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
    ok = k[at] == keys
    return ok, np.where(ok, v[at], 0).astype(np.float32)


def log_probs(u: np.ndarray, v: np.ndarray, w: np.ndarray, model: dict) -> np.ndarray:
    """Natural log of p(w | u, v), shard by shard of the context's last word.

    An unknown word has its shape's probability, shared by as many words as the sample held once.
    """
    out = np.empty(len(w), np.float64)
    of = v % len(model["shards"])
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(model["shards"]) + 1))
    for s, shared in enumerate(model["shards"]):
        shard = shared.value
        at = order[cuts[s] : cuts[s + 1]]
        a, b, c = u[at], v[at], w[at]
        seen, p = _found(shard["three"], a << 2 * BITS | b << BITS | c)
        out[at] = p
        at, a, b, c = at[~seen], a[~seen], b[~seen], c[~seen]
        _, back = _found(shard["back2"], a << BITS | b)
        seen, p = _found(shard["two"], b << BITS | c)
        out[at] = back + np.where(seen, p, model["back1"][b] + model["one"][c])
    unknown = np.flatnonzero(w < SHAPES)
    out[unknown] -= model["spread"][w[unknown]]
    return out


def with_digests(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, text, digest, check): two hashes of the text tell the texts of one doc_id apart."""
    return documents.select("doc_id", "lang", "text", F.xxhash64("text").alias("digest"), F.hash("text").alias("check"))


def surprisals(documents: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang, digest, check, n_tokens, nll) of every document: nll is minus the natural log-probability."""
    documents = with_digests(documents)
    if model is None:
        n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1
        return documents.select("doc_id", "lang", "digest", "check", n.cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("nll"))
    words, shards = model["words"], model["shards"]
    shared = documents.sparkSession.sparkContext.broadcast({k: model[k] for k in ("one", "back1", "spread")})
    own = ["doc_id", "lang", "digest", "check"]

    def run(batches):
        m = shared.value | {"shards": shards}
        ids = numbered(words.value)
        for batch in batches:
            raw = texts(batch)
            sums, sizes = [], []
            a = 0
            while a < len(raw):
                held, b, streams = 0, a, []
                while b < len(raw) and held < 4_000_000:
                    streams.append(ids_of(raw[b], ids))
                    held, b = held + len(raw[b]), b + 1
                n = np.array([len(s) + 1 for s in streams], np.int64)
                flat = np.array([x for s in streams for x in (START, START, *s, END)], np.int64)
                inner = np.ones(len(flat), bool)
                ends = np.cumsum(n + 2)
                inner[ends - n - 2] = inner[ends - n - 1] = False
                at = np.flatnonzero(inner)
                p = log_probs(flat[at - 2], flat[at - 1], flat[at], m)
                sums.append(np.add.reduceat(p, np.r_[0, np.cumsum(n)[:-1]]))
                sizes.append(n)
                a = b
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            total = np.concatenate(sums) if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(n), pa.array(-total)], names=[*own, "n_tokens", "nll"])

    return documents.mapInArrow(run, "doc_id long, lang string, digest long, check int, n_tokens long, nll double")


def judge(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, threshold, keep) of every document."""
    return judged(documents, labels, max_docs, max_chars, quantile).drop("digest", "check")


def judged(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, quantile: float = QUANTILE) -> DataFrame:
    """judge() with the hashes of with_digests()."""
    documents, labels = documents.select("doc_id", "lang", "text"), labels.select("doc_id", "quality", "toxic")
    trusted = stored(trusted_ids(labels))
    fitting = stored(fitting_ids(documents, trusted, max_docs, max_chars))
    # at most max_docs ids
    chosen = F.broadcast(fitting.toDF("_id", "_lang"))
    sample = documents.where(F.length("text") <= max_chars).join(chosen, (F.col("doc_id") == F.col("_id")) & F.col("lang").eqNullSafe(F.col("_lang")), "left_semi")
    sample = stored(sample.select("text"))
    model = fit(sample)
    scored = stored(surprisals(documents, model))
    release(model)
    fresh = trusted.join(F.broadcast(fitting.select("doc_id")), "doc_id", "left_anti")
    held = scored.where("nll is not null").join(fresh, "doc_id", "left_semi")
    # the mean surprise of a token by language, then quantiles of the smoothed perplexity
    mean = _by_language(held, F.sum("nll") / F.sum("n_tokens"), "mean")
    smooth = F.exp((F.col("nll") + PRIOR * F.col("mean")) / (F.col("n_tokens") + PRIOR))
    held = _with_language(held, mean).withColumn("perplexity", smooth)
    limit = _by_language(held, F.percentile_approx("perplexity", quantile, 10_000), "threshold")
    out = _with_language(_with_language(scored, mean).withColumn("perplexity", smooth), limit)
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "digest", "check", "n_tokens", "perplexity", "threshold", keep.alias("keep"))


def _by_language(held: DataFrame, value, name: str) -> DataFrame:
    """(_lang, name, _docs, _every): an aggregate of each language with its number of documents; one row without
    language for all. A row a language: pre-aggregated in each task."""
    per = held.groupBy("lang").agg(value.alias(name), F.count(F.lit(1)).alias("_docs"))
    per = per.select(F.col("lang").alias("_lang"), name, "_docs", F.lit(False).alias("_every"))
    return stored(per.union(held.agg(value.alias(name)).select(F.lit(None).cast("string"), name, F.lit(0).cast("long"), F.lit(True))))


def _with_language(rows: DataFrame, by: DataFrame) -> DataFrame:
    """rows with the aggregate of their language, shrunk to that of all."""
    name = by.columns[1]
    own = by.where("not _every").select("_lang", F.col(name).alias("_own"), "_docs")
    every = by.where("_every").select(F.col(name).alias("_all"))
    out = rows.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(every, how="left")
    n = F.coalesce("_docs", F.lit(0))
    return out.withColumn(name, (n * F.coalesce("_own", F.lit(0.0)) + SHRINK * F.col("_all")) / (n + SHRINK)).drop("_lang", "_own", "_docs", "_all")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without the rejected, columns unchanged. Of rows that share a doc_id or have none, only
    those with a rejected text go. A row travels as one value, so its columns may have any names."""
    cols = documents.columns
    bad = judged(documents, labels).where("not keep").select("doc_id", "lang", "digest", "check").distinct()
    rows = documents.select(F.struct(*cols).alias("row"), *[F.col(c).alias("_" + c) for c in ("doc_id", "lang")], F.xxhash64("text").alias("_digest"), F.hash("text").alias("_check"))
    same = F.col("_doc_id").eqNullSafe(F.col("doc_id")) & F.col("_lang").eqNullSafe(F.col("lang")) & (F.col("_digest") == F.col("digest")) & (F.col("_check") == F.col("check"))
    return rows.join(bad, same, "left_anti").select(*[F.col("row")[c].alias(c) for c in cols])
