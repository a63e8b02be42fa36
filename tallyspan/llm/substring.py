"""Substring dedup by recompression.

A text is a string of token names. A round replaces runs of one token, then pairs (a, b) with
a in the left and b in the right half of the alphabet, by a new name made from the parts, the
same wherever the parts are the same. Rounds follow one another; a symbol never grows beyond
its round's cap. Two equal substrings are cut alike in every round but for one symbol at each
end, so what each end can lose over all rounds is bounded by the caps, and the caps are
chosen so that a symbol survives around the middle of any window of the sought length. So
equal windows hold an equal high-level symbol, at the same place, in equal surroundings.

Symbols with their surroundings are counted over the whole corpus; those that occur once can
not lie in a repeated window. For the others, the few windows they can lie in are named by
hashes of 64 and 32 bits, from two kinds of word digests that have nothing in common, and counted
over the whole corpus again, which verifies the repeat and its exact extent. Texts whose symbols are
all unique never come back.

Equal texts are one text with a weight, told apart by 96 bits. Keys travel as packed arrays, dealt to
buckets whose number follows the bytes of text; a text is shuffled once, those with shared symbols
twice.

Defined results: null or wordless texts have no words, lose none and keep the empty text; a
text shorter than the window holds none and loses nothing; repeated
rows repeat each other's windows; ties cannot occur; a very long text is parsed whole; an empty table gives
an empty result; extra columns of any name pass through dedup_documents().
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm import blobs
from tallyspan.llm.common import join_by_class, mix, ship, shuffle_partitions, stored, texts

ship(__name__)

WINDOW, RUN_CAP, SEED = 35, 2, 42
#: Bytes of text parsed at a time.
STRIDE = 6_000_000
#: Bytes of text to a bucket of keys.
BUCKET = 32_000_000


def round_caps(window: int, run_cap: int = RUN_CAP) -> list[int]:
    """Most words to a symbol, by round: each end of a window may lose run_cap + sum(cap - 1) words
    and a symbol must be left in the middle."""
    caps, left = [], (window - 1) // 2 - run_cap
    while left >= len(caps) + 1:
        caps.append(len(caps) + 2)
        left -= caps[-1] - 1
    return caps


def recompress(names: np.ndarray, first: np.ndarray, caps: list[int], run_cap: int = RUN_CAP) -> tuple[np.ndarray, np.ndarray]:
    """Names and starts of the symbols after all rounds; first marks the first token of each text."""
    s, pos, new = names, np.arange(len(names)), first
    size = np.ones(len(s), np.int64)
    edge = new.copy()
    edge[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(edge)
    k = np.diff(np.r_[at, len(s)])
    short = (k >= 2) & (k <= run_cap)
    inside = np.repeat(short, k) & ~edge
    s = s.copy()
    s[at[short]] = mix(s[at[short]], k[short].astype(np.uint64))
    size[at[short]] = k[short]
    s, pos, new, size = s[~inside], pos[~inside], new[~inside], size[~inside]
    for turn, cap in enumerate(caps):
        right = (s >> np.uint64(5 + 6 * turn)) & np.uint64(1) == 1
        pair = ~right[:-1] & right[1:] & ~new[1:] & (size[:-1] + size[1:] <= cap)
        i = np.flatnonzero(pair)
        s[i] = mix(s[i], s[i + 1])
        size[i] += size[i + 1]
        keep = np.ones(len(s), bool)
        keep[i + 1] = False
        s, pos, new, size = s[keep], pos[keep], new[keep], size[keep]
    return s, pos


def spans(names: np.ndarray, n: int) -> np.ndarray:
    """The name of the n tokens that start at each position; the last n - 1 entries are void."""
    power, doubled, at, out = 1, names, 0, None
    left = n
    while left:
        if left & 1:
            part = np.roll(doubled, -at)
            out = part if out is None else mix(out, part)
            at += power
        left >>= 1
        if left:
            doubled = mix(doubled, np.roll(doubled, -power))
            power *= 2
    return mix(out, np.full(len(names), n, np.uint64))


class Parsed:
    """Texts of one stride: token names, the texts' bounds, and the symbols with their surroundings."""

    def __init__(self, all_words: list[list[bytes]], window: int):
        lengths = np.array([len(w) for w in all_words], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        total = int(lengths.sum())
        digest = xxhash.xxh64_intdigest
        self.names = np.fromiter((digest(x) for w in all_words for x in w), np.uint64, total)
        self.text_of = np.repeat(np.arange(len(all_words)), lengths)
        self.window, self.words = window, all_words

    def symbols(self):
        """(position, name) of every high-level symbol whose surroundings lie in its text."""
        caps = round_caps(self.window)
        self.reach = max([RUN_CAP, *caps])
        middle = (self.window - 1) // 2
        self.before, after = middle - self.reach + 1, self.window - middle
        first = np.zeros(len(self.names), bool)
        first[self.starts[self.starts < self.ends]] = True
        if not len(self.names):
            return np.zeros(0, np.int64), self.names
        s, pos = recompress(self.names, first, caps)
        t = self.text_of[pos]
        fits = (pos - self.before >= self.starts[t]) & (pos + after <= self.ends[t])
        s, pos = s[fits], pos[fits]
        around = spans(self.names, self.before + after)
        return pos, mix(s, around[pos - self.before])

    def windows(self) -> np.ndarray:
        return spans(self.names, self.window)

    def checks(self) -> np.ndarray:
        """32 bits of each window from another digest of its words."""
        names = np.fromiter((zlib.crc32(x) for w in self.words for x in w), np.uint64, len(self.names))
        return (spans(names, self.window) >> np.uint64(32)).astype("<u4")


def strides(raw: list[bytes], weights: list[int], stride: int = STRIDE):
    """(distinct texts, weights) of a batch, a bounded number of bytes at a time."""
    once: dict[bytes, int] = {}
    held = 0
    for t, w in zip(raw, weights):
        if t in once:
            once[t] += w
            continue
        once[t] = w
        held += len(t)
        if held >= stride:
            yield list(once), list(once.values())
            once, held = {}, 0
    if once:
        yield list(once), list(once.values())


def text_id(text: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text, SEED)).astype(np.int64))


def text_key(column: str = "text"):
    """What tells texts apart: text_id() and a checksum."""
    return F.concat_ws(":", F.xxhash64(column), F.crc32(F.col(column).cast("binary")))


def _symbol_keys(window: int, buckets: int):
    def run(batches):
        out = blobs.Gather(buckets)
        for batch in batches:
            raw = texts(batch)
            for part, weights in strides(raw, [1] * len(raw)):
                words = [t.split() for t in part]
                long = [i for i, w in enumerate(words) if len(w) >= window]
                if not long:
                    continue
                parsed = Parsed([words[i] for i in long], window)
                pos, keys = parsed.symbols()
                ids = np.array([text_id(part[i]) for i in long], np.int64)
                twice = np.minimum([weights[i] for i in long], 2).astype(np.uint8)
                out.add(keys, None, parsed.text_of[pos], ids, twice)
                yield from out.batches()
        yield from out.batches(last=True)

    return run


def _window_keys(window: int, buckets: int):
    """Windows around shared symbols, with a second hash beside the key."""

    def run(batches):
        out = blobs.Gather(buckets)
        for batch in batches:
            raw, shared = texts(batch), blobs.key_lists(batch.column("keys"))
            counts, ids = batch.column("n").to_numpy(), batch.column("owner").to_numpy()
            for a in range(0, len(raw), 64):
                part = slice(a, a + 64)
                words = [t.split() for t in raw[part]]
                parsed = Parsed(words, window)
                pos, keys = parsed.symbols()
                t = parsed.text_of[pos]
                hit = np.zeros(len(pos), bool)
                for i, known in enumerate(shared[part]):
                    x, y = np.searchsorted(t, [i, i + 1])
                    hit[x:y] = np.isin(keys[x:y], known)
                pos, t = pos[hit], t[hit]
                # the symbol starts before .. before + reach - 1 words after the window does
                near = pos[:, None] - parsed.before - np.arange(parsed.reach)
                ok = (near >= parsed.starts[t][:, None]) & (near + window <= parsed.ends[t][:, None])
                at = np.unique(near[ok])
                out.add(parsed.windows()[at], parsed.checks()[at], parsed.text_of[at], ids[part], np.minimum(counts[part], 2).astype(np.uint8))
                yield from out.batches()
        yield from out.batches(last=True)

    return run


def kept_words(words: list[bytes], names: np.ndarray, repeated: np.ndarray, window: int) -> list[bytes]:
    """The words that no window named in repeated covers."""
    if len(words) < window or not len(repeated):
        return words
    hit = np.isin(spans(names, window)[: len(words) - window + 1], repeated)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(hit), 1)
    np.add.at(cover, np.flatnonzero(hit) + window, -1)
    return [w for w, c in zip(words, np.cumsum(cover)) if c == 0]


def _removals(window: int, with_text: bool):
    def run(batches):
        for batch in batches:
            raw, repeated = texts(batch), blobs.key_lists(batch.column("keys"))
            for a in range(0, len(raw), 64):
                n_kept, sha, text = [], [], []
                for t, known in zip(raw[a : a + 64], repeated[a : a + 64]):
                    words = t.split()
                    names = Parsed([words], window).names
                    kept = kept_words(words, names, known, window)
                    joined = b" ".join(kept)
                    n_kept.append(len(kept))
                    sha.append(hashlib.sha256(joined).hexdigest())
                    text.append(joined.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("same").slice(a, len(sha)), batch.column("copies").slice(a, len(sha)), pa.array(n_kept, pa.int64()), pa.array(sha), pa.array(text, pa.string())],
                    names=["same", "n", "n_kept", "kept_sha256", "kept_text"],
                )

    return run


def repeated_windows(documents: DataFrame, window: int = WINDOW, buckets: int | None = None, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(texts, windows): distinct texts with shared symbols (owner, same, text, n), and the names of their
    repeated windows (owner, keys), where owner is the text's 64-bit hash and same its text_key()."""
    rows = documents.where("text is not null").select("text")
    if buckets is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(2 * shuffle_partitions(documents.sparkSession), -(-size // bucket))
    symbols = blobs.by_bucket(rows.mapInArrow(_symbol_keys(window, buckets), blobs.SCHEMA), buckets)
    shared = symbols.groupBy("bucket").applyInArrow(blobs.repeated_keys, blobs.REPEATED)
    shared = shared.groupBy("owner").agg(F.collect_list("key").alias("keys"))
    # equal texts become one where they are read, before the exchange that the join uses too
    rows = rows.select(text_key().alias("same"), F.xxhash64("text").alias("owner"), "text")
    one = (F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    once = rows.groupBy("owner").agg(*one, F.min("same").alias("same"), F.max("same").alias("other"))
    candidates = stored(once.join(shared, "owner"))
    met = candidates.where("same <> other").select("owner", "keys")
    candidates = candidates.where("same = other").select("owner", "same", "text", "n", "keys")
    if not met.isEmpty():  # different texts of one owner: counted apart, with the keys of both, which does no harm
        apart = rows.join(met.select("owner"), "owner", "left_semi").groupBy("owner", "same").agg(*one).join(met, "owner")
        candidates = stored(candidates.unionByName(apart))
    windows = blobs.by_bucket(candidates.mapInArrow(_window_keys(window, buckets), blobs.SCHEMA), buckets)
    repeated = windows.groupBy("bucket").applyInArrow(blobs.repeated_keys, blobs.REPEATED)
    return candidates, repeated.groupBy("owner").agg(F.collect_list("key").alias("keys"))


def removals(documents: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(same, n, n_kept, kept_sha256, kept_text) of the texts that lose words; n is how many rows have the text."""
    candidates, repeated = repeated_windows(documents, window)
    found = candidates.select("owner", "same", "text", F.col("n").alias("copies")).join(repeated, "owner")
    return stored(found.mapInArrow(_removals(window, with_text), "same string, n long, n_kept long, kept_sha256 string, kept_text string"))


def whole_digests(documents: DataFrame) -> DataFrame:
    """(doc_id, same, n_words, whole_sha256): each text as it is when nothing is removed."""

    def run(batches):
        for batch in batches:
            n, sha, ids = [], [], []
            for t in texts(batch):
                words = t.split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                ids.append(f"{text_id(t)}:{zlib.crc32(t)}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.string()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "same", "n_words", "whole_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, same string, n_words long, whole_sha256 string")


def dedup_digests(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    lost = removals(documents, window).drop("kept_text")
    whole = whole_digests(documents).withColumn("place", F.monotonically_increasing_id())
    out = join_by_class(whole, lost, "same", "place", documents.count())
    removed = F.when(F.col("n_kept").isNull(), F.lit(0)).otherwise(F.col("n_words") - F.col("n_kept"))
    return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))


def dedup_documents(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents with the text of those that lose words replaced by the words left; all rows stay. A row
    travels as one value, so its columns may have any names."""
    cols = documents.columns
    lost = removals(documents, window, with_text=True).select("same", "n", "kept_text")
    rows = documents.select(F.struct(*cols).alias("row"), F.when(F.col("text").isNotNull(), text_key()).alias("same"), F.monotonically_increasing_id().alias("place"))
    out = join_by_class(rows, lost, "same", "place", documents.count())
    return out.select(*[(F.coalesce("kept_text", F.col("row")[c]) if c == "text" else F.col("row")[c]).alias(c) for c in cols])
