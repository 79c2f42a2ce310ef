"""Exact token counts by a histogram of encoded lengths.

Documents are aggregated by length in tokens; all further answers come from the histogram, whose size
is the number of distinct lengths, not of documents. Suffix sums run in two levels, within blocks of
1,024 lengths and over block totals, so they need no window over the whole histogram.

Null and empty texts have length 0. An empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common, tokens

SPAN = 1024


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len(tokens.encode(t)) for t in common.each(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], ["doc_id", "n_tokens"])

    return common.texts(docs).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each length."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram: docs_from and tokens_from, over documents of L tokens or
    more; truncated_total, the tokens left if every document is cut at L; docs_to_share, the share of
    documents of at most L tokens (its inverse answers quantiles)."""
    hist = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / SPAN).alias("span"))
    inside = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each 1,024 lengths
    spans = hist.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    all_docs, all_tokens = map(F.lit, spans.agg(F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first())
    later = spans.select("span", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t"))
    return (
        hist.select("*", F.sum("n_docs").over(inside).alias("di"), F.sum("tokens").over(inside).alias("ti"))
        .join(later, "span")
        .select(
            "n_tokens",
            "n_docs",
            (F.col("di") + F.col("d")).alias("docs_from"),
            (F.col("ti") + F.col("t")).alias("tokens_from"),
            (all_tokens - F.col("ti") - F.col("t") + F.col("n_tokens") * (F.col("di") + F.col("d"))).alias("truncated_total"),
            ((all_docs - F.col("di") - F.col("d") + F.col("n_docs")) / all_docs).alias("docs_to_share"),
        )
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_over) for any limits; docs_over are longer than the limit. A limit between two lengths is
    answered from the next longer one, a limit beyond all from the longest."""
    sums = sums.select("n_tokens", "n_docs", "docs_from", "truncated_total")
    asked = []
    for limit in limits:
        longer = F.when(F.col("n_tokens") > limit, F.struct("n_tokens", "docs_from", "truncated_total"))
        asked.append(F.struct(F.lit(limit).cast("long").alias("context_limit"), F.min(longer).alias("next"), F.max(F.struct("n_tokens", "truncated_total")).alias("last")))
    found = sums.agg(F.array(*asked).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    cut = F.col("next.truncated_total") - (F.col("next.n_tokens") - F.col("context_limit")) * F.col("next.docs_from")
    return found.select("context_limit", F.coalesce(cut, F.col("last.truncated_total")).alias("truncated_total"), F.coalesce("next.docs_from", F.lit(0).cast("long")).alias("docs_over"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens) for any shares in (0, 1]: the least length that at least this share of the documents
    doesn't exceed; null in an empty table."""
    sums = sums.select("n_tokens", "docs_to_share")
    asked = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("docs_to_share") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return sums.agg(F.array(*asked).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def count_tokens(docs: DataFrame) -> DataFrame:
    return suffix_sums(common.checkpointed(histogram(lengths(docs))))
