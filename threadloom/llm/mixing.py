"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh ``weights`` in turn and share
``share`` times all words; a target stops at ``most`` times its source's words, and what
is left over is shared again by weight until none is above.

Rates: among all document rates w with sum(w * size) = target in each source, those of
least relative entropy to rate 1 are w = exp(lambda * size / mean), held to ``most``.  The
dual is convex; Newton steps, kept inside a bracket, find lambda for all sources at once,
each step one aggregation over the (source, size) histogram.

Copies: rates become whole copies, 0 to ``most``.  A source is dealt by a hash of doc_id
and size into blocks of bounded size; inside a block the documents go from long to short, and
the words that rounding has added or lost so far are carried on to the next, so a block ends
within about its shortest document of its share.  Rows alike in doc_id, source and size are
rounded as one sum and share its copies, so that they differ by one copy at most.  Sums that
Newton's method takes are of decimals, which have no order, and the result depends on doc_id,
source and size only, so reruns agree.

Defined results: a null or empty text has size 0 and is taken once, as 0 words; a null doc_id
or source is a value of its own; of rows alike in doc_id, source and size the first in the
order of their texts' hash take the extra copy; very long texts count like others; an empty
table gives an empty table; other columns pass through, whatever their names.  If Newton's
method has not come close after ``STEPS`` steps, RuntimeError is raised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm._common import Scratch, free_names

#: Fixed values of the mix.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2

#: Rows of one block of the rounding; steps of Newton's method; residual at which they end, as a share of the target.
BLOCK_ROWS, STEPS, CLOSE = 2_000, 200, 1e-7


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text column, null being 0."""
    squeezed = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^ \t\n\x0b\f\r]+", "a")
    return F.length(F.translate(squeezed, " \t\n\x0b\f\r", "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size, n); one row for each source."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # caps fall in the order of cap / weight; at the right place all later ones share what is left by weight
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    whole = W.partitionBy()
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    per = per.withColumn("level", (total - F.col("before")) / F.col("rest"))
    fits = F.col("cap") / F.col("weight") >= F.col("level")
    per = per.withColumn("level", F.min_by("level", F.when(fits, F.col("cap") / F.col("weight"))).over(whole))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return per.select("source", "source_size", "source_docs", target.alias("target"), "cap")


def _exact(x: Column) -> Column:
    """A term as a decimal: sums of these do not depend on their order."""
    return F.round(x, 9).cast("decimal(38,9)")


def solve(cells: DataFrame, goal: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """goal and lambda, scale: the rate of a document is least(most, exp(lambda * size / scale)).

    Distributed Newton: each step is one aggregation of ``cells`` (source, size, n) by source.
    """
    log_most = float(np.log(most))
    state = goal.select(
        "*", F.lit(0.0).alias("lam"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"),
        (F.col("source_size") / F.greatest(F.col("source_docs"), F.lit(1))).alias("scale"), F.lit(1e300).alias("off"),
    )
    state = scratch.save(state, "state-0")
    part = cells.select(F.col("source").alias("_s"), "size", "n").where("size > 0")
    for step in range(STEPS):
        z = F.col("size") / F.col("scale")
        exponent = F.col("lam") * z
        rate = F.when(exponent >= log_most, F.lit(float(most))).otherwise(F.exp(exponent))
        slope = F.when(exponent >= log_most, F.lit(0.0)).otherwise(F.exp(exponent) * z * z)
        sums = (
            part.join(state.select("source", "lam", "scale"), F.col("_s").eqNullSafe(F.col("source"))).groupBy("source")
            .agg(F.sum(_exact(F.col("n") * z * rate)).cast("double").alias("g"), F.sum(_exact(F.col("n") * slope)).cast("double").alias("h")).withColumnRenamed("source", "_s")
        )
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        want = F.col("target") / F.col("scale")
        miss = F.coalesce(F.col("g") - want, F.lit(0.0))
        low = F.when(miss < 0, F.greatest("low", "lam")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.least("high", "lam")).otherwise(F.col("high"))
        newton = F.col("lam") - miss / F.col("h")
        # outside the bracket, or on the flat where all rates are at the cap: between its ends, by doubling while one is open
        middle = F.when(high >= 1e9, F.greatest(F.lit(1.0), 4 * F.col("lam"))).when(low <= -1e9, F.least(F.lit(-1.0), 4 * F.col("lam"))).otherwise((low + high) / 2)
        inside = (F.col("h") > 0) & (newton > low) & (newton < high)
        capped = F.col("target") >= F.col("cap") * (1 - 1e-12)
        off = F.when(capped | F.col("g").isNull(), F.lit(0.0)).otherwise(F.abs(miss) / F.greatest(want, F.lit(1e-300)))
        lam = F.when(off <= CLOSE, F.col("lam")).when(inside, newton).otherwise(middle)
        state = scratch.save(moved.select(*[c for c in goal.columns], lam.alias("lam"), low.alias("low"), high.alias("high"), "scale", off.alias("off")), f"state-{step + 1}")
        scratch.drop(f"state-{step}")
        if not (state.agg(F.max("off")).first()[0] or 0.0) > CLOSE:
            return state
    raise RuntimeError(f"Newton's method has not come within {CLOSE} of the targets after {STEPS} steps")


def _round(group: pa.Table, most: int) -> pa.Table:
    """Whole copies of each row of a block; Arrow keeps ids beyond 2^53 beside null ones."""
    order = pc.sort_indices(group, sort_keys=[("size", "descending"), ("doc_id", "ascending")], null_placement="at_end")
    group = group.take(order)
    copies, carry = [], 0.0
    for s, k, r in zip(*(group.column(c).to_pylist() for c in ("size", "n", "rate")), strict=True):
        c = min(most * k, max(0, int(np.floor(r * k + (carry / s if s else 0.0) + 0.5))))
        carry += (r * k - c) * s
        copies.append(c)
    return group.select(["doc_id", "source", "size"]).append_column("total", pa.array(copies, pa.int64()))


def mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, rate, copies, more) from rows (doc_id, source, size).

    n rows of the input had that doc_id, source and size; each is taken ``copies`` times, and ``more`` of them once more.
    """
    spark = sized.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = scratch.save(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "rows")
    cells = scratch.save(rows.groupBy("source", "size").agg(F.sum("n").alias("n")), "cells")
    state = solve(cells, scratch.save(targets(cells, weights, share, most), "goal"), scratch, most)
    by = state.select(F.col("source").alias("_s"), "source_size", "source_docs", "target", "cap", "lam", "scale")
    rated = rows.join(by, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    exponent = F.col("lam") * F.col("size") / F.col("scale")
    capped = F.col("target") >= F.col("cap") * (1 - 1e-12)
    rate = F.when(capped & (F.col("size") > 0), F.lit(float(most))).when(exponent >= float(np.log(most)), F.lit(float(most))).otherwise(F.exp(F.coalesce(exponent, F.lit(0.0))))
    rated = rated.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)))
    block = F.pmod(F.xxhash64("doc_id", "size"), F.greatest(F.lit(1), F.ceil(F.col("source_docs") / F.lit(block_rows))).cast("long"))
    dealt = rated.select("doc_id", "source", "size", "n", "rate", block.alias("block"))

    def rounded(group: pa.Table) -> pa.Table:
        return _round(group, most)

    copies = dealt.groupBy("source", "block").applyInArrow(rounded, "doc_id long, source string, size long, total long")
    back = copies.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), "total")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    each, more = F.floor(F.col("total") / F.col("n")), F.col("total") % F.col("n")
    return rated.join(back, same).select("doc_id", "source", "size", "n", "source_size", "target", "rate", each.alias("copies"), more.alias("more"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def _keys(doc_id: Column, source: Column, size: Column, names: list[str]) -> list[Column]:
    """What rows are alike in, without nulls, so that a join and a window share one partitioning."""
    parts = (F.coalesce(doc_id, F.lit(0).cast("long")), doc_id.isNull(), F.coalesce(source, F.lit("")), source.isNull(), size)
    return [c.alias(n) for c, n in zip(parts, names, strict=True)]


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    *keys, each, extra, place, copy = free_names(docs, "doc", "no_doc", "source", "no_source", "words", "copies", "more", "place", "copy")
    plan = mix(sizes(docs), **options).where("copies > 0 OR more > 0")
    plan = plan.select(*_keys(F.col("doc_id"), F.col("source"), F.col("size"), keys), F.col("copies").alias(each), F.col("more").alias(extra))
    rows = docs.select("*", *_keys(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")), keys))
    taken = rows.join(plan, keys).withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64("text"))))
    times = F.col(each) + F.when(F.col(place) <= F.col(extra), 1).otherwise(0)
    counted = taken.withColumn(each, times).where(F.col(each) > 0)
    return counted.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(each)))).select(*[F.col(f"`{c}`") for c in docs.columns])
