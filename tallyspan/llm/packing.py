"""Best-fit packing with a swap-based local search.

Documents become token ids; longer ones are cut at the sequence length, all else stays
whole. Pieces are dealt to groups of bounded size at random. In a group, best-fit decreasing
fills bins; then, while fewer bins could hold the group, documents of the emptiest bin are
moved out, or exchanged one for one or two for one with documents of other underfull bins.
Every step raises the sum of squared fills, so the search ends; bins that become empty go.
Bins left underfull meet those of other groups in the next round, in as many groups as keep
the bound. Rounds end with one group, or where one frees at most a hundredth of the bins it took.

Defined results: null text is empty, a document of the end id alone; a null doc_id stays null; a
very long text is cut into as many pieces as it needs; an empty table gives an empty result;
repeated rows are packed once for each row; ties fall to the longer piece, then the lower doc_id,
nulls last. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import drop_stored, ship, stored, texts

ship(__name__)

LENGTH, END_ID = 2048, 0
#: Share of its bins that a round must free for another one to follow.
GAIN = 0.01
#: Pieces to a group, groups that one round makes one of at most, words a task remembers.
GROUP, FAN_IN, REMEMBERED = 40_000, 32, 900_000
#: Distinct words that wait to be learnt, words of all texts that wait for them, words in one text for the tokenizer.
AT_ONCE, WAITING, IN_TEXT = 60_000, 500_000, 200
#: ASCII marks that may follow the letters of a word.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Token ids by word: the tokenizer drops blanks and never joins across them, so words stand alone.

    Most words are letters with marks after them. The tokenizer folds case and parts letters from
    marks, so such a word has the ids of its lower-case letters, then those of its marks. Letters are
    looked up many at a time in one text of blanks between; where that text does not give one
    word end for each word (letters whose lower case holds a mark), they are looked up apart.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.is_end = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.is_end[i] = token.endswith("</w>")

    def _keep(self, words: list[bytes], raw: bytes, ends: np.ndarray) -> None:
        at = 0
        for w, end in zip(words, (4 * ends).tolist()):
            self.known[w] = raw[at:end]
            at = end

    def _apart(self, words: list[bytes]) -> None:
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            got = self.tokenizer.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            of = np.array([-1 if x is None else x for x in got.word_ids], np.int64)
            self._keep(part, np.array(got.ids, "<u4").tobytes(), np.searchsorted(of, np.arange(1, len(part) + 1)))

    def _letters(self, words: list[bytes]) -> None:
        for a in range(0, len(words), IN_TEXT):
            part = words[a : a + IN_TEXT]
            (got,) = self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(part):
                self._keep(part, ids.tobytes(), ends)
            else:
                self._apart(part)

    def learn(self, words: set[bytes]) -> None:
        """Find the ids of those words that are not known."""
        if len(self.known) > self.most:
            self.known.clear()
        known, words = self.known, list(words.difference(self.known))
        marked, letters, apart = ([], [], []), set(), set()
        lower = b" ".join(words).lower().split()  # words hold no blanks, and lower case is as long
        stems = [x.rstrip(MARKS) for x in lower]
        for w, x, low in zip(words, lower, stems):
            # the tokenizer composes and folds before it parts, which can turn a letter into letter and mark
            if not low.isalpha() and not normalize("NFC", low.decode()).lower().isalpha():
                apart.add(w)
                continue
            if low not in known:
                letters.add(low)
            if low != w:
                tail = x[len(low) :]
                for held, v in zip(marked, (w, low, tail)):
                    held.append(v)
                if tail and tail not in known:
                    apart.add(tail)
        self._letters(list(letters))
        self._apart(list(apart))
        for w, low, tail in zip(*marked):
            known[w] = known[low] + known[tail] if tail else known[low]

    def of(self, all_words):
        """Little-endian ids of each text, in blocks of texts whose words are learnt together."""
        block, need, waiting = [], set(), 0
        for words in itertools.chain(all_words, [None]):
            if words is not None:
                block.append(words)
                need.update(words)
                waiting += len(words)
            if words is None or len(need) > AT_ONCE or waiting > WAITING:
                self.learn(need)
                for w in block:
                    yield b"".join(map(self.known.__getitem__, w))
                block, need, waiting = [], set(), 0


def word_ids(path: str) -> WordIds:
    """The words that this Python worker has met in any task; a module that travels with a job is new in each task."""
    import tokenizers

    held = vars(tokenizers).setdefault("_tallyspan_word_ids", {})
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def _whole_text_ids(tokenizer, text: bytes) -> bytes:
    return np.array(tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()


def pieces(documents: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as token pieces of at most length."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        ids = word_ids(tokenizer)
        special = [t.content.encode() for t in ids.tokenizer.get_added_tokens_decoder().values()]
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            raw = texts(batch)
            # a special token is found in the whole text, before words are told apart
            odd = {i for i, t in enumerate(raw) if b"<|" in t and any(s in t for s in special)}
            streams = ids.of([] if i in odd else t.split() for i, t in enumerate(raw))
            for i, (doc, stream) in enumerate(zip(batch.column("doc_id").to_pylist(), streams)):
                stream = (_whole_text_ids(ids.tokenizer, raw[i]) if i in odd else stream) + end
                for k, a in enumerate(range(0, len(stream), 4 * length)):
                    part = stream[a : a + 4 * length]
                    for name, v in zip(rows, (doc, k, a // 4, len(part) // 4, zlib.crc32(part))):
                        rows[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in rows.items()], names=list(rows)
            )

    return documents.select("doc_id", "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Best-fit decreasing: indices of the pieces in each bin."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(room + 1)]
    open_gaps = 0  # bit g is set where a bin has gap g
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps ^= 1 << gap
            bins[b].append(i)
            gap -= n
        else:
            b, gap = len(bins), room - n
            bins.append([i])
        if gap:
            by_gap[gap].append(b)
            open_gaps |= 1 << gap
    return bins


def empty_bins(lengths: np.ndarray, bins: list[list[int]], room: int) -> list[list[int]]:
    """Local search: raise the squared fill by moves and exchanges until the emptiest bins are empty.

    A bin is given up when no step moves anything out of it; it then stays as it is.
    """
    fill = np.array([int(lengths[b].sum()) for b in bins])
    need = -(-int(fill.sum()) // room)
    if len(bins) <= need:
        return bins
    bin_of = np.empty(len(lengths), np.int64)
    for b, members in enumerate(bins):
        bin_of[members] = b
    alive = np.ones(len(bins), bool)
    stuck = np.zeros(len(bins), bool)
    inside = {b: set(m) for b, m in enumerate(bins)}
    by_length = np.argsort(lengths, kind="stable")

    def put(i: int, b: int) -> None:
        was = int(bin_of[i])
        inside[was].discard(i)
        inside[b].add(i)
        fill[was] -= lengths[i]
        fill[b] += lengths[i]
        bin_of[i] = b

    while alive.sum() > need:
        choice = np.flatnonzero(alive & ~stuck & (fill < room))
        if not len(choice):
            break
        e = int(choice[np.argmin(fill[choice])])
        others = alive & (fill < room)
        others[e] = False
        if (room - fill[others]).sum() < fill[e]:
            break  # the gaps of all others can't hold it
        # documents of the other underfull bins, by length: the partners of an exchange
        pool = by_length[others[bin_of[by_length]]]
        while inside[e]:
            mine = sorted(inside[e], key=lambda i: -int(lengths[i]))
            gaps = np.where(others, room - fill, -1)
            step = None
            for i in mine:  # move: the tightest gap that holds it
                ok = np.flatnonzero(gaps >= lengths[i])
                if len(ok):
                    step = ((i,), int(ok[np.argmin(gaps[ok])]), None)
                    break
            if step is None:
                pg, pl = gaps[bin_of[pool]], lengths[pool]
                # one for one, two for one: of equal totals the first will do, so there are at most room of them
                ways: dict[int, tuple] = {}
                for i in mine:
                    ways.setdefault(int(lengths[i]), (i,))
                own = list(ways.values())
                for a, (i,) in enumerate(own):
                    again = next((j for j in mine if j != i and lengths[j] == lengths[i]), None)
                    for j in [k for (k,) in own[a + 1 :]] + ([] if again is None else [again]):
                        ways.setdefault(int(lengths[i] + lengths[j]), (i, j))
                totals = np.array(sorted(ways))
                # each partner's largest gain is the largest total that its bin has room for
                gain = totals[np.maximum(np.searchsorted(totals, pl + pg, "right") - 1, 0)] - pl
                # the other bin must stay the fuller one for the squared fill to rise
                ok = (gain > 0) & (gain <= pg) & (room - pg + gain > fill[e])
                if ok.any():
                    k = int(np.argmax(np.where(ok, gain, 0)))
                    step = (ways[int(pl[k] + gain[k])], int(bin_of[pool[k]]), int(pool[k]))
            if step is None:
                break
            out, b, back = step
            for i in out:
                put(i, b)
            if back is not None:
                put(back, e)
                pool = np.append(pool[pool != back], list(out))
            else:
                pool = np.append(pool, list(out))
        if inside[e]:
            stuck[e] = True
        else:
            alive[e] = False
    return [sorted(inside[b], key=lambda i: -int(lengths[i])) for b in np.flatnonzero(alive)]


def _pack_groups(rows: DataFrame, groups: int, turn: int, room: int, last: bool) -> DataFrame:
    """rows (doc_id, piece, start, length, ids_crc32) -> with sequence_id, offset and whether the bin is final."""
    schema = PIECES + ", sequence_id long, offset long, final boolean"

    def pack(t: pa.Table) -> pa.Table:
        g = t.column("grp")[0].as_py()
        t = t.take(pc.sort_indices(t, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])).drop(["grp"])
        lengths = t.column("length").to_numpy()
        bins = empty_bins(lengths, best_fit(lengths, room), room)
        order = np.concatenate([np.array(b) for b in bins])
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        n = lengths[order]
        before = np.cumsum(n) - n
        first = np.r_[True, number[1:] != number[:-1]]
        offset = before - np.repeat(before[first], np.diff(np.r_[np.flatnonzero(first), len(n)]))
        total = np.bincount(number, n)
        placed = (((turn << 24 | g) << 32) + number, offset, last | (total[number] >= room - room // 256))
        t = t.take(pa.array(order))
        for name, v in zip(("sequence_id", "offset", "final"), placed):
            t = t.append_column(name, pa.array(v))
        return t

    # by the row's place in the stored table: repeated rows and null ids spread like any others
    dealt = rows.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)).cast("int"))
    return dealt.groupBy("grp").applyInArrow(pack, schema)


def pack_pieces(cut: DataFrame, room: int = LENGTH, group: int = GROUP, fan_in: int = FAN_IN) -> DataFrame:
    """(…, sequence_id, offset): pieces placed in sequences of at most room tokens."""
    left, done, turn, waiting, before = cut, None, 0, None, None
    groups = max(1, -(-left.count() // group))
    names = [*cut.columns, "sequence_id", "offset"]

    def with_done(rows: DataFrame) -> DataFrame:
        return rows.select(*names) if done is None else done.union(rows.select(*names))

    while True:
        last = groups == 1
        packed = stored(_pack_groups(left, groups, turn, room, last))
        if last:
            return with_done(packed)
        if before is not None:
            after = packed.where("offset = 0").count()
            if before - after <= GAIN * before:
                return with_done(packed if after < before else waiting)
        done, waiting = with_done(packed.where("final")), packed.where("not final")
        left, before = waiting.select(*cut.columns), waiting.where("offset = 0").count()
        turn, groups = turn + 1, max(1, -(-left.count() // group), -(-groups // fan_in))


def pack_documents(documents: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    cut = stored(pieces(documents, tokenizer, length))
    return pack_pieces(cut, length)
