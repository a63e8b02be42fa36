"""Mixing sources to target weights: systematic sampling.

Each source has a target of words. A document of the source is expected target / size-of-source
times; the expected copies are prefix-summed within the source, one offset in [0, 1) is
added, and the document is taken once for each whole number its step crosses. So no document
comes more often than its expectation rounded up, and each source's count is exact to one.

Documents lie in order of size, then of a hash of doc_id, so the words taken follow the target to
about the longest document. The prefix sum needs no task that holds a source: documents are counted
by (source, size, slot), slot being the first bits of the hash; counts are prefix-summed over the
sizes of a source and over the slots of a size, and only ranks within a slot are windowed. The
number of slots follows that of the documents and does not change the order.

Defined results: null text has no words; sources sort by code point with null last; a source
without words has target 0 and gives nothing; repeated rows and ties are steps of their own,
ordered by doc_id; a very long text only counts; an empty table gives an empty result; other columns pass through in
mix_documents().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.llm.common import n_words, stored

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents of one source and size to a slot, if they were all of it.
SLOT = 100_000
_SEED = "mix"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size): one row for each source.

    A source above most * its size stops there and the excess goes to the others by weight
    until none is above. In order of the ratio of cap to weight that is one running sum: with
    the first k sources at their caps, the others share what is left; k is the least number
    for which none of the others is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source from here on
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1)
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", left / weight)
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(every)["level"])
    return per.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def _unit(c: Column, seed: str) -> Column:
    """A number in [0, 1) from a value, the same on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(c.cast("string"), F.lit("\0")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def expected_copies(sized: DataFrame, targets: DataFrame, slots: int, seed: str = _SEED) -> DataFrame:
    """sized (doc_id, source, size, ...) with source_size, target and copies (long)."""
    # a null source joins like any other: the key is never null
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    sized = sized.withColumns({"k": key, "u": _unit(F.col("doc_id"), seed)}).withColumn("slot", F.floor(F.col("u") * slots).cast("int"))
    cells = sized.groupBy("k", "size", "slot").agg(F.count(F.lit(1)).alias("n"))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = cells.groupBy("k", "size").agg(F.sum("n").alias("n")).select("k", "size", ahead(Window.partitionBy("k").orderBy("size")).alias("smaller"))
    cells = cells.select("k", "size", "slot", ahead(Window.partitionBy("k", "size").orderBy("slot")).alias("ahead")).join(sizes, ["k", "size"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shares = targets.select(key.alias("k"), "source_size", "target", share.alias("share"), _unit(F.col("source"), seed).alias("offset"))
    out = sized.join(cells.join(shares, "k"), ["k", "size", "slot"])
    within = Window.partitionBy("k", "size", "slot").orderBy("u", F.col("doc_id").asc_nulls_first())
    rank = F.col("smaller") + F.col("ahead") + F.row_number().over(within)
    copies = F.floor(F.col("offset") + F.col("share") * rank) - F.floor(F.col("offset") + F.col("share") * (rank - 1))
    return out.withColumn("copies", copies.cast("long")).drop("k", "u", "slot", "ahead", "smaller", "share", "offset")


def sampling_table(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, slot: int = SLOT) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): texts are read once and none is shuffled."""
    sized = stored(documents.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    return expected_copies(sized, source_targets(sized, weights, share, most), max(1, -(-sized.count() // slot)))


def mix_documents(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: every row of documents as often as it is taken, columns unchanged."""
    cols = documents.columns
    ident = F.struct(F.lit(0).alias("z"), *[F.col(c) for c in cols])
    size = n_words(F.col("text"))
    counted = stored(documents.select("source", size.alias("size")).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    per_source = counted.select("source", (F.col("size") * F.col("n")).alias("size"))
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sized = documents.select("doc_id", "source", size.alias("size"), ident.alias("row"))
    taken = expected_copies(sized, source_targets(per_source, weights, share, most), max(1, -(-n // SLOT))).where("copies > 0")
    taken = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return taken.select(*[F.col("row")[c].alias(c) for c in cols])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1
), s3 AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, cap / w) FROM s2 WHERE level * w <= cap) * w), cap) AS target,
         ('0x' || substr(md5('mix' || coalesce(source, chr(0))), 1, 8))::UBIGINT::DOUBLE / 4294967296 AS off
  FROM s2
), e AS (
  SELECT d.doc_id, d.size, s3.source_size, s3.target, s3.off,
         CASE WHEN s3.source_size > 0 THEN s3.target / s3.source_size ELSE 0 END AS share,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, ('0x' || substr(md5('mix' || coalesce(d.doc_id::VARCHAR, chr(0))), 1, 8))::UBIGINT, d.doc_id NULLS FIRST) AS r
  FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source
)
SELECT doc_id, size, source_size, target, (floor(off + share * r) - floor(off + share * (r - 1)))::BIGINT * size AS taken FROM e
"""
