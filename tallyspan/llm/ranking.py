"""Ranked lexical search by the Best Position Algorithm.

Terms are maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased. One reading of
the documents keeps, for each, its length and the counts of the terms that some query holds, as a
stored table; N, L and the document frequencies of the query terms are counted from it. The table's
partitions are the shards of the index. A task cuts its shard into segments and keeps, for each term of
a segment, an impact list: its documents, falling by the term's part of a score.

A query reads its lists in parallel from the top. Each document met is looked up in all the other lists
(direct access), which gives its exact score and marks its positions there. A list's best position is the
end of its gapless seen part, which those marks push beyond what was read; the impacts at the best positions
add up to a threshold that no unseen document exceeds. Reading stops once the threshold is strictly below
the k-th score so far, so ties for the last place are all seen. A task's k-th score carries over to its next
segments, where a query often stops at once. Each task returns k rows a query; Spark ranks those.

Queries go in blocks of about BLOCK, each with one reading of the documents; the terms of a block,
their frequencies and weights are all that is sent to tasks.

Defined results: a null or empty text has no term and is not counted in N; a document repeated is ranked
each time; a null doc_id ranks after all others of its score; rows of one item_id are one query (a null one,
too); an item without known terms returns nothing; a very long text is counted in parts of PART bytes;
empty tables give an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.llm.common import LOWER, UPPER, drop_stored, ship, stored, texts

ship(__name__)

TOP, BLOCK = 50, 2_000
#: Bytes of a text counted at once; postings to a segment; positions read in a query's first step.
PART, SEGMENT, FIRST = 1 << 20, 2_000_000, 16
_BLANKED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def term_counts(text: bytes) -> Counter:
    """Counts of the terms of a text in UTF-8."""
    found, a = Counter(), 0
    while a < len(text):
        part = text[a : a + PART].translate(_BLANKED)
        if a + PART < len(text):
            part = part[: part.rfind(b" ") + 1] or text[a:].translate(_BLANKED).split(b" ", 1)[0]
        found.update(part.split())
        a += len(part)
    return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's part of a score before its weight. The length quotient is taken of unbounded integers where 64 bits are too few."""
    wide = len(n) and 50 * n_docs * int(n.max()) >= 1 << 63
    m = 50 + np.array([50 * n_docs * k // n_terms for k in n.tolist()], np.int64) if wide else 50 + 50 * n_docs * n // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Segment:
    """Impact lists of some documents."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.ends = np.searchsorted(term[order], np.arange(n_terms + 1))
        key = term[order].astype(np.int64) * n_docs + self.doc
        self.place = np.argsort(key)  # in the impact lists, by term and document
        self.key = key[self.place]
        self.seen, self.met = np.zeros(len(doc), bool), np.zeros(n_docs, bool)

    def best(self, terms: np.ndarray, weights: np.ndarray, kth: int, top: int, step: int = FIRST):
        """Documents that may be among the best, and their scores: all of at least the k-th score, kth being one reached elsewhere."""
        here = self.ends[terms + 1] > self.ends[terms]
        terms, weights = terms[here], weights[here]
        at, end = self.ends[terms].copy(), self.ends[terms + 1]  # at: one past each best position
        docs, scores, read, marked, mets = [], [], at.copy(), [], []
        while len(terms):
            bound = int((weights * np.where(at < end, self.impact[np.minimum(at, end - 1)], 0)).sum())
            if bound < kth or bound <= 0:
                break
            to = np.minimum(read + step, end)
            got = np.concatenate([self.doc[a:b] for a, b in zip(read.tolist(), to.tolist())])
            new = np.unique(got[~self.met[got]])
            self.met[new] = True
            mets.append(new)
            want = (terms.astype(np.int64)[:, None] * self.n_docs + new).ravel()
            where = np.searchsorted(self.key, want)
            where[where == len(self.key)] = 0
            hit = self.key[where] == want
            place = self.place[where[hit]]
            self.seen[place] = True
            marked.append(place)
            of = np.tile(np.arange(len(new)), len(terms))[hit]
            part = np.repeat(weights, len(new))[hit] * self.impact[place]
            score = np.zeros(len(new), np.int64)
            np.add.at(score, of, part)
            docs.append(new)
            scores.append(score)
            all_scores = np.concatenate(scores)
            if len(all_scores) >= top:
                kth = max(kth, int(np.partition(all_scores, -top)[-top]))
            for i, (a, b) in enumerate(zip(at.tolist(), end.tolist())):
                gap = int(np.argmin(self.seen[a:b])) if a < b else 0
                at[i] = b if a < b and self.seen[a + gap] else a + gap
            read, step = np.maximum(to, at), step * 2
        for x in marked:
            self.seen[x] = False
        for x in mets:
            self.met[x] = False
        return (np.concatenate(docs), np.concatenate(scores)) if docs else (np.zeros(0, int), np.zeros(0, np.int64))


def _index(names: dict[bytes, int]):
    def run(batches):
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in texts(batch):
                found = term_counts(text)
                n.append(found.total())
                kept = [(names[t], c) for t, c in found.items() if t in names]
                terms.append([t for t, _ in kept])
                tfs.append([c for _, c in kept])
            out = {"doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _segments(batches):
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("terms").flatten())
        if size >= SEGMENT:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _ranked(queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    def run(batches):
        best = [None] * len(queries)  # of each query: ids and scores, at most top of them
        for t in _segments(batches):
            t = t.combine_chunks()
            ids, lists = t.column("doc_id"), t.column("terms").combine_chunks()
            row = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
            tf = t.column("tfs").combine_chunks().flatten().to_numpy()
            part = impacts(tf, t.column("n").to_numpy()[row], n_docs, n_terms)
            segment = Segment(row, lists.flatten().to_numpy(), part, t.num_rows, len(weights))
            for q, terms in enumerate(queries):
                full = best[q] is not None and len(best[q]) == top
                docs, scores = segment.best(terms, weights[terms], best[q].column("score")[-1].as_py() if full else 0, top)
                docs, scores = docs[scores > 0], scores[scores > 0]
                if len(docs):
                    found = pa.table({"doc_id": ids.take(pa.array(docs)), "score": scores})
                    both = found if best[q] is None else pa.concat_tables([best[q], found])
                    best[q] = both.sort_by([("score", "descending"), ("doc_id", "ascending")]).slice(0, top).combine_chunks()
        for q, found in enumerate(best):
            if found is not None:
                for b in found.to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), q), pa.int32()), b.column(0), b.column(1)], names=["query", "doc_id", "score"])

    return run


def _item_terms(batches):
    for batch in batches:
        found = [sorted(t.decode() for t in term_counts(x)) for x in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.string()))], names=["item_id", "terms"])


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): each item's distinct terms."""
    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, terms array<string>")
    return rows.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def _search_block(docs: DataFrame, items: list, top: int) -> DataFrame:
    spark = docs.sparkSession
    names = {t: i for i, t in enumerate(sorted({t for r in items for t in r.terms}))}
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = spark.sparkContext.broadcast({t.encode(): i for t, i in names.items()})
    index = docs.select("doc_id", "text").mapInArrow(lambda b: _index(known.value)(b), f"doc_id {kind}, n long, terms array<int>, tfs array<long>")
    index = stored(index.where("n > 0"))
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row a query term
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(names))], np.int64)
    plan = spark.sparkContext.broadcast(([np.array(sorted(names[t] for t in r.terms), np.int64) for r in items], weights, n_docs, n_terms, top))
    found = index.mapInArrow(lambda b: _ranked(*plan.value)(b), f"query int, doc_id {kind}, score long")
    return found


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the top documents of each item, best first, ties by doc_id."""
    spark = docs.sparkSession
    queries = stored(query_terms(items))
    blocks = -(-queries.count() // block) or 1
    names = spark.createDataFrame([], queries.select("item_id").schema)
    out = spark.createDataFrame([], f"item_id {names.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    first = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about a block of them
        if some:
            ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(some)], f"query int, item_id {names.schema['item_id'].dataType.simpleString()}")
            ranked = _search_block(docs, some, top).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
            out = out.union(ranked.join(F.broadcast(ids), "query").select(*out.columns))
    drop_stored(queries)
    return out


ORACLE = r"""
with d as materialized (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
    from documents),
size as materialized (select r, doc_id, len(t) as n from d where len(t) > 0),
whole as materialized (select count(*) as docs, sum(n)::bigint as terms from size),
item as materialized (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark),
post as materialized (select r, term, count(*) as tf from (select r, unnest(t) as term from d) where term in (select term from item) group by r, term),
weigh as materialized (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from post, whole group by term, docs),
part as (
    select r, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) as s
    from post p join weigh using (term) join size using (r), whole),
total as (select item_id, r, sum(s)::bigint as score from item i join part p on i.term = p.term group by item_id, r)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from total join size using (r) where score > 0
qualify rank <= 50
"""
