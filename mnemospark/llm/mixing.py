"""Mixing sources to target weights (problem 9): whole copies first, then Pareto order sampling."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key, word_count
from ..session import broadcast_if_small, cut

#: Slices of a source's rank order that are counted to find the last document taken; only one of them is sorted.
SLICES = 4096


def token_count(documents: DataFrame, tokenizer: str, text: str = "text", size: str = "size") -> DataFrame:
    """``documents`` with ``size``, the tokens of a public tokenizer: a ``tokenizers`` JSON file, at the same path on all machines.

    Null text has size 0. Special tokens in a text are ordinary text.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*documents.schema.fields, T.StructField(size, T.LongType())])
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for b in batches:
            texts = [x or "" for x in b.column(at).to_pylist()]
            n = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, size])

    return documents.mapInArrow(run, schema)


def sized_documents(documents: DataFrame, size: Column | None = None) -> DataFrame:
    """(doc_id, source, size) with the source trimmed and in lower case; size is the number of words unless given."""
    return documents.select("doc_id", norm_key(F.col("source")).alias("source"), (word_count(F.col("text")) if size is None else size).cast("long").alias("size"))


def allocate(sized: DataFrame, targets: DataFrame, total: Column | None = None) -> DataFrame:
    """One row per target source: (source, target_share, max_repeats, docs, size, squares, total, want, copies, rest, short).

    ``want`` is the source's share of ``total`` (default: the size of all target sources together). A source is taken in
    ``copies`` whole copies, and ``rest`` tokens are sampled once more; one that can't reach its share even if repeated
    ``max_repeats`` times is ``short`` and taken that many times. Sources without documents have size 0.
    """
    t = targets.select(norm_key(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("long")).filter("source IS NOT NULL")
    sizes = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("size"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"))
    rows = t.join(sizes, "source", "left").na.fill(0, ["docs", "size"]).na.fill(0.0, ["squares"])
    every = F.sum("size").over(Window.partitionBy(F.lit(1))) if total is None else total  # one row for each target
    rows = rows.withColumn("total", every).withColumn("want", F.col("target_share") * F.col("total"))
    short = F.col("size") * F.col("max_repeats") < F.col("want")
    whole = F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("want") / F.col("size")))
    rows = rows.withColumn("short", short).withColumn("copies", F.when(short, F.col("max_repeats")).otherwise(F.least(whole, "max_repeats")).cast("long"))
    rest = F.when(F.col("short") | (F.col("copies") >= F.col("max_repeats")), 0.0).otherwise(F.col("want") - F.col("copies") * F.col("size"))
    return rows.withColumn("rest", rest)


def sampling_rates(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, rate, n) of each source with a rest: a document's chance is min(1, rate * size), and n is their sum.

    The rate is such that the expected size is the rest: documents whose chance would exceed 1 are certain, and the rate
    of the others is computed again for what the certain ones leave, until none exceeds 1. This goes over the numbers
    of documents of each size, not over the documents. Where all are certain, the rate is 1 divided by the least size.
    """
    need = plan.filter("rest > 0 AND squares > 0").select("source", "rest", (F.col("rest") / F.col("squares")).alias("rate"))
    some = sized.filter("size > 0").select("source", "size")
    sizes = cut(some.join(broadcast_if_small(need.select("source")), "source", "left_semi").groupBy("source", "size").agg(F.count("*").alias("k")))
    size, k = F.col("size").cast("double"), F.col("k")
    rates, before = cut(need), -1
    while True:
        sure = F.col("rate") * size >= 1
        sums = sizes.join(broadcast_if_small(rates), "source").groupBy("source").agg(
            F.first("rest").alias("rest"), F.sum(F.when(sure, k).otherwise(0)).alias("sure"), F.sum(F.when(sure, size * k).otherwise(0.0)).alias("taken"),
            F.sum(F.when(sure, 0.0).otherwise(size * k)).alias("other"), F.sum(F.when(sure, 0.0).otherwise(size * size * k)).alias("squares"), F.min("size").alias("least"),
        )
        # rounding must not lower a rate, else a certain document could become uncertain again
        rate = F.when(F.col("squares") > 0, F.greatest((F.col("rest") - F.col("taken")) / F.col("squares"), F.lit(0.0))).otherwise(1.0 / F.col("least"))
        sums = cut(sums.withColumn("new", rate))
        certain = sums.agg(F.sum("sure")).first()[0] or 0  # one number
        if certain == before:
            return sums.select("source", F.col("new").alias("rate"), (F.col("sure") + F.col("new") * F.col("other")).alias("n"))
        before = certain
        rates = cut(sums.join(rates.select("source", F.col("rate").alias("old")), "source").select("source", "rest", F.greatest("new", "old").alias("rate")))


def mix_sources(sized: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, repeats) of the mix, rows with at least one repeat.

    Within a source that needs a rest, documents are drawn in proportion to their size: with inclusion chance p (certain
    ones at 1, see :func:`sampling_rates`) and a random u by hash of seed, source and doc_id, the n documents of least
    u/(1-u) : p/(1-p) are taken, n being the number whose expected size is the rest. The n-th rank is found from slice
    counts, so no source is sorted in one task. Null doc_ids are drawn as one and the same id; documents of other
    sources are left out.
    """
    p = plan.select("source", "copies").join(sampling_rates(sized, plan), "source", "left").na.fill(0.0, ["rate", "n"])
    rows = sized.join(broadcast_if_small(p), "source")  # one row for each target source
    u = (F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id"), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    chance = F.least(F.lit(1.0), F.col("rate") * F.col("size"))
    q = F.when(chance >= 1, -1.0).when(chance <= 0, 1.0).otherwise((u * (1 - chance)) / (u * (1 - chance) + (1 - u) * chance))
    rows = cut(rows.select("doc_id", "source", "size", "copies", "n", q.alias("q")))
    rows = rows.withColumn("slice", F.when(F.col("q") < 0, -1).otherwise(F.least(F.floor(F.col("q") * SLICES), F.lit(SLICES - 1))).cast("int"))
    counts = rows.filter("n > 0").groupBy("source", "slice").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("upto", F.sum("k").over(upto)).withColumn("n", F.round("n").cast("long"))
    last = counts.filter("upto >= n AND upto - k < n").groupBy("source").agg(F.min("slice").alias("last"), F.min(F.col("n") - (F.col("upto") - F.col("k"))).alias("more"))
    rows = rows.join(broadcast_if_small(last), "source", "left")
    inside = F.row_number().over(Window.partitionBy("source").orderBy("q", "doc_id"))
    edge = rows.filter("slice = last").withColumn("r", inside).withColumn("taken", (F.col("r") <= F.col("more")).cast("long")).drop("r")
    other = rows.filter("last IS NULL OR slice <> last").withColumn("taken", F.when(F.col("n") <= 0, 0).when(F.col("last").isNull(), F.when(F.col("n") >= 0.5, 1).otherwise(0)).otherwise((F.col("slice") < F.col("last")).cast("int")).cast("long"))
    out = edge.unionByName(other).withColumn("repeats", F.col("copies") + F.col("taken"))
    return out.filter("repeats > 0").select("doc_id", "source", "size", "repeats")


def mix_report(plan: DataFrame, mix: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, docs_in_mix, size_in_mix, max_repeats_used, short) for each target source."""
    got = mix.groupBy("source").agg(F.count("*").alias("docs_in_mix"), F.sum(F.col("size") * F.col("repeats")).alias("size_in_mix"), F.max("repeats").alias("max_repeats_used"))
    rows = plan.join(got, "source", "left").na.fill(0, ["docs_in_mix", "size_in_mix", "max_repeats_used"])
    every = F.sum("size_in_mix").over(Window.partitionBy(F.lit(1)))
    return rows.select("source", "target_share", F.when(every > 0, F.col("size_in_mix") / every).otherwise(0.0).alias("actual_share"), "docs_in_mix", "size_in_mix", "max_repeats_used", "short")
