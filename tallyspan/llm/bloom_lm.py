"""LM scoring with a log-frequency Bloom filter.

Word and word-pair counts of the training texts are quantised on a log scale; an n-gram of
level q is put into a Bloom filter once for each level 1..q. A count is read back by probing
levels until one is absent: a false positive raises a count by a level, never lowers it. A level
stands for the middle of its counts.

Probabilities are Witten-Bell's: of a context u with the values v(u, w) of its pairs, their sum
Z(u) and their number T(u), p(w | u) = (v(u, w) + T(u) p(w)) / (Z(u) + T(u)); p(w) shares one part
over the words by value and the rest evenly over them and one unseen word. So the probabilities
after any context sum to one but for false positives.

The filter holds every word and every pair of the training texts, at any size. It is cut into
segments by bucket of the word or of the pair's context, each sized from its own insertions; the
number of buckets follows the bytes of text, so a segment stays small and none is ever sent to all
tasks. A context of more than half a bucket's share is spread over several buckets, and its sums
are gathered apart: at most two such contexts a bucket. Documents are cut into chunks of bounded
size. A chunk sends its distinct n-grams with their training counts to the buckets; a bucket sums
the counts, fills its segment, probes it for each n-gram that a chunk sent and answers the chunk
with one byte for each and the sums of each context. The chunk's texts then meet its answers and
are scored.

Exact word counts serve the base score and n_known: words frequent enough to be among at
most frequent_words are looked up in the task (the threshold comes from a histogram of all
counts), rarer words by a join on the word, so no word of many rows is ever shuffled by key.

Defined results: null text is empty, an end token alone; a null doc_id is a training text;
equal texts get equal scores, and repeated rows count as often as they occur; a very long text is a
chunk of its own; with no training text every base probability is 1 / 1 and scores are those of
unseen words; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import join_by_class, mix, ship, shuffle_partitions, stored, texts

ship(__name__)

FOLDS, HELD_OUT = 7, 2
LOG_BASE, HASHES = 1.5, 5
FREQUENT_WORDS = 300_000
#: Bytes of text to a chunk, to a bucket of n-grams, and that a task counts words of at a time.
CHUNK, BUCKET, COUNTED = 8_000_000, 32_000_000, 32_000_000
END = ""  # no word is empty
_START = np.uint64(0x53544152545F5F31)


def words_of(text) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of texts (null: none), one text after the other, and how many each has."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    # a fresh copy: ascii_lower() misreads a slice after a cast
    text = text.take(pa.array(np.arange(len(text))))
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text))
    words = parts.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # blanks at either end leave empty parts
    before = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
    return words.filter(full), np.diff(before[parts.offsets.to_numpy()])


def is_held_out(ident: str = "doc_id", folds: int = FOLDS, fold: int = HELD_OUT):
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % folds == fold, F.lit(False))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, n): exact counts of every training token, the end token as the empty word."""

    def run(batches):
        held, size = [], 0

        def rows():
            words, sizes = words_of(pa.chunked_array(held))
            got = words.value_counts()
            word, n = got.field("values").cast(pa.string()), got.field("counts")
            word, n = pa.concat_arrays([word, pa.array([END])]), pa.concat_arrays([n, pa.array([len(sizes)])])
            return pa.RecordBatch.from_arrays([word, n], names=["word", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.column("text"))
            size += held[-1].nbytes
            if size > COUNTED:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    return train.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def level_of(n: np.ndarray) -> np.ndarray:
    """Quantised level of a count: 1 + floor(log n)."""
    return (1 + np.floor(np.log(n) / math.log(LOG_BASE) + 1e-9)).astype(np.uint8)


def level_values(most: int = 255) -> np.ndarray:
    """The count that each level stands for: the middle of the whole numbers that it holds; 0 for level 0."""
    edge = np.ceil(LOG_BASE ** np.arange(most + 1.0) - 1e-9)
    return np.r_[0.0, (edge[:-1] + np.maximum(edge[1:] - 1, edge[:-1])) / 2]


VALUE = level_values(120)


class Tokens:
    """Tokens of a few texts, each with its end token. ``words`` has the distinct words and the end, ``code`` leads
    from tokens to them; ``names`` has their names in order, ``word`` leads from tokens to them."""

    def __init__(self, text):
        words, sizes = words_of(text)
        coded = words.dictionary_encode()
        self.words = [*coded.dictionary.cast(pa.large_binary()).to_pylist(), END.encode()]
        ends = np.cumsum(sizes)
        self.code = np.insert(coded.indices.to_numpy(), ends, len(self.words) - 1).astype(np.int64)
        self.text_of = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.first = ends - sizes + np.arange(len(sizes))
        names = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        self.names, name_of = np.unique(names, return_inverse=True)
        self.word = name_of[self.code]


def in_chunks(flagged: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (doc_id, text, held_out) with the number of a chunk of bounded size, stored."""

    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            of = []
            for n in pc.coalesce(pc.binary_length(batch.column("text")), 0).to_pylist():
                of.append(number)
                held += n + 1
                if held >= chunk:
                    number, held = number + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int64())], names=[*batch.schema.names, "chunk"])

    return stored(flagged.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, text string, held_out boolean, chunk long"))


class Buckets:
    """Which bucket an n-gram belongs to: by the word, or by the pair's context.

    Contexts in ``hot`` (sorted) are spread over ``ways`` buckets by the pair.
    """

    def __init__(self, n: int, hot: np.ndarray, ways: np.ndarray):
        self.n, self.hot, self.ways = n, hot, ways

    def is_hot(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hot, context), max(0, len(self.hot) - 1))
        return (self.hot[at] == context if len(self.hot) else np.zeros(len(context), bool)), at

    def of_pairs(self, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
        hot, at = self.is_hot(context)
        out = context % np.uint64(self.n)
        if hot.any():
            out[hot] = mix(context[hot], pair[hot] % self.ways[at[hot]]) % np.uint64(self.n)
        return out.astype(np.int32)


class _Of:
    """Buckets from broadcast arrays, made in the task."""

    def __init__(self, shared):
        self.shared = shared

    @property
    def value(self) -> Buckets:
        return Buckets(*self.shared.value)


class Distinct:
    """The distinct n-grams of a chunk by kind, in the order in which a chunk and its buckets name them:
    by bucket, then the context's name, then the word's. ``at`` leads from words' names to words, from tokens to pairs."""

    def __init__(self, t: Tokens, buckets: Buckets):
        self.keys, self.at, self.bucket = {}, {}, {}
        self._put(1, t.names, (t.names % np.uint64(buckets.n)).astype(np.int32))
        # pairs as whole numbers that stand in the order of (context, word)
        contexts, place = np.unique(np.r_[t.names, _START], return_inverse=True)
        context = np.roll(place[t.word], 1)
        context[t.first] = place[-1]
        both = context * len(t.names) + t.word
        order = np.argsort(both)
        both = both[order]
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        at = np.empty(len(both), np.int64)
        at[order] = np.cumsum(new) - 1
        context, word = np.divmod(both[new], len(t.names))
        context, names = contexts[context], t.names[word]
        order, place = self._put(2, names, buckets.of_pairs(context, mix(context, names)))
        self.at[2] = place[at]
        self.context, self.word = context[order], self.at[1][word[order]]
        self.first = np.ones(len(order), bool)  # where a context of a bucket begins
        self.first[1:] = (self.context[1:] != self.context[:-1]) | (self.bucket[2][1:] != self.bucket[2][:-1])

    def _put(self, kind: int, keys: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # small whole numbers are sorted by their digits
        order = np.argsort(bucket.astype(np.int16) if len(bucket) and bucket.max() < 1 << 15 else bucket, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.keys[kind], self.at[kind], self.bucket[kind] = keys[order], place, bucket[order]
        return order, place


COUNTS = "chunk long, bucket int, kind int, keys binary, counts binary, contexts binary, sizes binary"


def ngram_counts(chunks: DataFrame, shared) -> DataFrame:
    """(chunk, bucket, kind, keys, counts, contexts, sizes): packed names of the words (kind 1) and of the pairs' words
    (kind 2, by context) of a chunk with their training counts, which are 0 for those of held-out texts only. A chunk may send several rows."""

    def run(batches):
        buckets = shared.value
        for batch in batches:
            text, of = batch.column("text"), batch.column("chunk").to_numpy()
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                t = Tokens(text.slice(a, b - a))
                d = Distinct(t, buckets)
                of_kind = {1: d.at[1][t.word], 2: d.at[2]}
                counted = train[a:b][t.text_of]
                rows: dict[str, list] = {k: [] for k in ("bucket", "kind", "keys", "counts", "contexts", "sizes")}
                for kind in (1, 2):
                    keys = d.keys[kind]
                    n = np.bincount(of_kind[kind], counted, len(keys)).astype("<u4")
                    cuts = np.r_[0, np.flatnonzero(np.diff(d.bucket[kind])) + 1, len(keys)]
                    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        contexts = sizes = b""
                        if kind == 2:
                            begins = np.flatnonzero(d.first[x:y])
                            contexts, sizes = d.context[x:y][begins].tobytes(), np.diff(np.r_[begins, y - x]).astype("<u4").tobytes()
                        one = (int(d.bucket[kind][x]), kind, keys[x:y].tobytes(), n[x:y].tobytes(), contexts, sizes)
                        for name, v in zip(rows, one):
                            rows[name].append(v)
                kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
                own = pa.array(np.full(len(rows["kind"]), of[a], np.int64))
                yield pa.RecordBatch.from_arrays([own, *(pa.array(v, k) for v, k in zip(rows.values(), kinds))], names=["chunk", *rows])

    return chunks.select("chunk", "text", "held_out").mapInArrow(run, COUNTS)


def positions(keys: np.ndarray, level: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """First place of keys at a level, and the step to their next ones, before they are folded to the filter's bits."""
    h = mix(keys, np.full(len(keys), level * 4 + kind, np.uint64))
    return h, (mix(h, keys) >> np.uint64(20)) | np.uint64(1)


class Segment:
    """A bucket's part of the filter."""

    def __init__(self, keys: np.ndarray, level: np.ndarray, kind: int, hashes: int = HASHES):
        self.kind, self.hashes, self.top = kind, hashes, int(level.max(initial=0))
        # never so few that the steps between a key's bits fall together
        self.bits = max(1 << 16, 8 * math.ceil(int(level.sum(dtype=np.int64)) * hashes / math.log(2) / 8 * 1.05))
        bit = np.zeros(self.bits, bool)
        for q in range(1, self.top + 1):
            h, step = positions(keys[level >= q], q, kind)
            for _ in range(hashes):
                bit[h % np.uint64(self.bits)] = True
                h += step
        self.raw = np.packbits(bit, bitorder="little")

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Levels by repeated membership probes; 0 where the lowest is absent."""
        out, live = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for q in range(1, self.top + 1):
            h, step = positions(keys[live], q, self.kind)
            for _ in range(self.hashes):  # each further hash is read only where the ones before were set
                bit = h % np.uint64(self.bits)
                ok = (self.raw[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                live, h, step = live[ok], h[ok] + step[ok], step[ok]
            if not len(live):
                break
            out[live] = q
        return out


ANSWERS = "chunk long, bucket int, kind int, levels binary, sums binary, level_keys array<long>, hot binary, hot_sums binary"


def filter_answers(counts: DataFrame, shared, hashes: int = HASHES) -> DataFrame:
    """One row for each chunk, bucket and kind: the levels that the bucket's segment of the filter has for the chunk's
    n-grams, in their order, and (Z, T) of each context. One more row (chunk null) has the number of the bucket's
    training n-grams by level and the part it holds of its hot contexts' sums."""

    def answer(key, t):
        kind = key[1].as_py()
        bytes_of = lambda c, kind: [np.frombuffer(x, kind) for x in t.column(c).to_pylist()]
        parts = bytes_of("keys", "<u8")
        keys, counts = np.concatenate(parts), np.concatenate(bytes_of("counts", "<u4"))
        if kind == 2:
            contexts, sizes = (np.concatenate(bytes_of(c, k)) for c, k in (("contexts", "<u8"), ("sizes", "<u4")))
            names, of = np.unique(contexts, return_inverse=True)
            of = np.repeat(of, sizes)
            order = np.lexsort((keys, of))
        else:
            of = np.zeros(len(keys), np.int64)
            order = np.argsort(keys)
        keys, of = keys[order], of[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        at = np.empty(len(keys), np.int64)
        at[order] = np.cumsum(new) - 1
        keys, of = keys[new], of[new]  # in the order in which chunks name them
        if kind == 2:
            keys = mix(names[of], keys)
        n = np.bincount(at, counts).astype(np.int64)
        seen = np.flatnonzero(n)
        level = level_of(n[seen])
        got = Segment(keys[seen], level, kind, hashes).level(keys)
        if kind == 2:
            sums = np.stack([np.bincount(of[seen], VALUE[level], len(names)), np.bincount(of[seen], minlength=len(names))], axis=1)
            hot, _ = shared.value.is_hot(names)
        ends = np.cumsum([len(x) for x in parts])
        mine: dict[int, list] = {}
        for c, x in zip(t.column("chunk").to_pylist(), np.split(at, ends[:-1])):
            mine.setdefault(c, []).append(x)
        levels, told = [], []
        for x in mine.values():
            x = x[0] if len(x) == 1 else np.unique(np.concatenate(x))
            if kind == 2:
                own = of[x]
                told.append(sums[own[np.r_[True, own[1:] != own[:-1]]]].astype("<f4").tobytes())
            else:
                told.append(b"")
            levels.append(got[x].tobytes())
        rows, none = len(levels), [None] * len(levels)
        big = (names[hot].tobytes(), sums[hot].tobytes()) if kind == 2 else (b"", b"")
        return pa.table(
            {
                "chunk": pa.array([*mine, None], pa.int64()),
                "bucket": pa.array([key[0].as_py()] * (rows + 1), pa.int32()),
                "kind": pa.array([kind] * (rows + 1), pa.int32()),
                "levels": pa.array([*levels, None], pa.binary()),
                "sums": pa.array([*told, None], pa.binary()),
                "level_keys": pa.array([*none, np.bincount(level, minlength=2).tolist()], pa.list_(pa.int64())),
                "hot": pa.array([*none, big[0]], pa.binary()),
                "hot_sums": pa.array([*none, big[1]], pa.binary()),
            }
        )

    return counts.groupBy("bucket", "kind").applyInArrow(answer, ANSWERS)


def hot_sums(by_bucket: DataFrame, hot: np.ndarray) -> np.ndarray:
    """(Z, T) of each hot context from the parts that its buckets hold."""

    def run(batches):
        for batch in batches:
            for name, sums in zip(batch.column("hot").to_pylist(), batch.column("hot_sums").to_pylist()):
                z = np.frombuffer(sums, "<f8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(name, "<i8")), pa.array(z[:, 0].copy()), pa.array(z[:, 1].copy())], names=["name", "z", "t"])

    rows = by_bucket.where("kind = 2").select("hot", "hot_sums").mapInArrow(run, "name long, z double, t double")
    got = rows.groupBy("name").agg(F.sum("z").alias("z"), F.sum("t").alias("t")).toArrow()
    out = np.zeros((len(hot), 2))
    if got.num_rows:
        at = np.searchsorted(hot, got.column("name").to_numpy().view(np.uint64))
        out[at, 0], out[at, 1] = got.column("z").to_numpy(), got.column("t").to_numpy()
    return out


def score_tokens(word: np.ndarray, pair: np.ndarray, z: np.ndarray, t: np.ndarray, singles: int, whole: float, types: int) -> np.ndarray:
    """log10 probability of each token from the values of its word and pair and its context's sums.

    whole is the sum of all words' values.
    """
    unseen = (singles + 1) / (whole + 2)
    p1 = (1 - unseen) * word / max(1.0, whole) + unseen / (types + 1)
    return np.log10((pair + np.where(z + t > 0, t, 1) * p1) / np.where(z + t > 0, z + t, 1))


SCORED = "doc_id long, owner binary, held_out boolean, n_tokens long, score double, part double, known long, word string, tf long"
NAMES = [x.split()[0] for x in SCORED.split(", ")]


def hot_contexts(counts: DataFrame, total: int, buckets: int) -> Buckets:
    """Contexts of more than half a bucket's share of the training tokens, at most two for each bucket.

    A text's start comes as often as its end."""
    limit = max(1.0, total / (2 * buckets))
    got = counts.where(F.col("n") > limit).toArrow()
    words, n = got.column("word").cast(pa.binary()).to_pylist(), got.column("n").to_numpy()
    names = np.array([xxhash.xxh64_intdigest(w) for w in words] + [int(_START) for w in words if w == b""], np.uint64)
    n = np.r_[n, [k for w, k in zip(words, n) if w == b""]].astype(float)
    order = np.argsort(names)
    return Buckets(buckets, names[order], np.ceil(n[order] / limit).astype(np.uint64))


def score_documents(
    documents: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT, frequent_words: int = FREQUENT_WORDS, chunk: int = CHUNK, bucket: int = BUCKET, hashes: int = HASHES
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = documents.sparkSession
    flagged = in_chunks(documents.select("doc_id", "text", is_held_out("doc_id", folds, fold).alias("held_out")), chunk)
    counts = stored(word_counts(flagged.where("not held_out")))
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # the least count that at most frequent_words words reach
    steps = counts.groupBy(F.floor(F.log(F.col("n").cast("double")) * 20).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    least, room = None, frequent_words
    for _, words, low in sorted(steps.collect(), reverse=True):  # twenty steps to each factor of e
        if words > room:
            break
        least, room = low, room - words
    frequent = {}
    if least is not None:
        got = counts.where(F.col("n") >= least).toArrow()
        frequent = dict(zip(got.column("word").cast(pa.binary()).to_pylist(), got.column("n").to_pylist()))
    known = spark.sparkContext.broadcast(frequent)
    size = flagged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = hot_contexts(counts, total, max(2 * shuffle_partitions(spark), -(-size // bucket)))
    shared = spark.sparkContext.broadcast((buckets.n, buckets.hot, buckets.ways))
    answers = stored(filter_answers(ngram_counts(flagged, _Of(shared)), _Of(shared), hashes))
    per = answers.where("chunk is null")
    levels = per.where("kind = 1").select(F.posexplode("level_keys").alias("level", "words")).groupBy("level").agg(F.sum("words").alias("words"))
    by_level = dict(levels.collect())  # a few dozen levels
    singles, whole = by_level.get(1, 0), float(sum(VALUE[q] * n for q, n in by_level.items()))
    spread = spark.sparkContext.broadcast(hot_sums(per, buckets.hot))

    def score(left, right):
        exact, of = known.value, _Of(shared).value
        right = right.sort_by("bucket")
        kinds = right.column("kind").to_pylist()
        told = lambda c, kind: b"".join([v for k, v in zip(kinds, right.column(c).to_pylist()) if k == kind])
        t = Tokens(left.column("text"))
        d = Distinct(t, of)
        word, pair = (VALUE[np.frombuffer(told("levels", k), np.uint8)] for k in (1, 2))
        sums = np.frombuffer(told("sums", 2), "<f4").reshape(-1, 2).astype(np.float64)[np.cumsum(d.first) - 1]
        hot, at = of.is_hot(d.context)
        sums[hot] = spread.value[at[hot]]
        p = score_tokens(word[d.word], pair, *sums.T, singles, whole, types)
        total_of = lambda each: np.bincount(t.text_of, each, left.num_rows)
        n = np.array([exact.get(w, 0) for w in t.words], np.int64)[t.code]
        rare = n == 0
        # the rare words of each text and how often it has them
        rare, tf = np.unique(t.text_of[rare] * len(t.words) + t.code[rare], return_counts=True)
        text, code = np.divmod(rare, len(t.words))
        owner = pa.array([xxhash.xxh3_128_digest(x) for x in texts(left)], pa.binary())
        docs = {
            "doc_id": left.column("doc_id"),
            "owner": owner,
            "held_out": left.column("held_out"),
            "n_tokens": pa.array(np.bincount(t.text_of, minlength=left.num_rows)),
            "score": pa.array(total_of(p[d.at[2]])),
            "part": pa.array(total_of(np.log10(n + 1.0))),
            "known": pa.array(total_of(n > 0).astype(np.int64)),
        }
        rest = {"owner": owner.take(pa.array(text)), "word": pa.array(t.words, pa.large_binary()).take(pa.array(code)).cast(pa.string()), "tf": pa.array(tf)}
        return pa.concat_tables([pa.table(docs), pa.table(rest)], promote_options="default").select(NAMES)

    asked = answers.where("chunk is not null").select("chunk", "bucket", "kind", "levels", "sums")
    scored = stored(flagged.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(score, SCORED))
    docs = scored.where("word is null").withColumn("place", F.monotonically_increasing_id())
    copies = docs.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    # equal texts send equal rows: sums over an owner are taken once for each copy and divided again
    rare = scored.where("word is not null").select("owner", "word", "tf").join(counts, "word")
    rare = rare.groupBy("owner").agg(F.sum(F.col("tf") * F.log10(F.col("n") + F.lit(1.0))).alias("rest"), F.sum("tf").alias("found"))
    rare = rare.join(copies, "owner").select("owner", "n", (F.col("rest") / F.col("n")).alias("rest"), (F.col("found") / F.col("n")).cast("long").alias("found"))
    out = join_by_class(docs, rare, "owner", "place", docs.count())
    none = F.log10(F.lit(float(total + types + 1)))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * none).alias("base_score"),
        "score",
    )
