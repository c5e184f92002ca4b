"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in one fixed order. Each expects ``target / source size`` copies; the running
sum of these expectations, plus one random offset for the source, crosses an integer boundary now and then, and each
crossing emits the document once. As the order is by size, every stretch of sizes gets its share and the
words taken stay near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martloom.llm.common import WORD, packed, whole_text

WEIGHTS = (1, 2, 3)
MOST = 3  # copies a source's size may be taken at most
SEED = "mix-1"
SLICE_DIGITS = 3  # hex digits of a document's hash that split equal sizes into slices


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Words to take from each source: all words shared out by weight, no source above ``most`` times its size.

    ``sizes`` has one row per source (``source``, ``source_size``). Sources by code point, null last, take the
    weights in turn. Sources are filled in order of cap per weight: those that cannot hold their share
    keep their cap, and what is left goes to the rest by weight, which is where repeated resharing ends.
    Empty sources get 0; without any word every target is 0.
    """
    at = F.row_number().over(W.orderBy(F.isnull("source"), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(at, F.lit(len(weights))).cast("int") + 1)
    cap = F.col("source_size") * most
    everything = W.partitionBy()
    before = W.orderBy(F.col("__cap") / F.col("weight"), F.isnull("source"), "source").rowsBetween(W.unboundedPreceding, -1)
    weighed = sizes.select("source", "source_size", weight.alias("weight"), cap.alias("__cap"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    shares = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    capped = weighed.withColumn("__full", F.col("__cap") <= left.cast("double") / shares * F.col("weight"))
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("__full"), F.col("weight"))).over(everything)
    level = F.try_divide(rest.cast("double"), open_weight.cast("double"))
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(level * F.col("weight"))
    return capped.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _offset(source: Column, seed: str) -> Column:
    """In steps of 1/4096, so that adding it to whole numbers stays exact."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("")))), 1, 3)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 4096


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Rows of ``docs`` as ``__row`` with ``__size``, ``__source_size``, ``__target`` and ``__copies``; 0 copies for what is not taken.

    Null texts have size 0, the null source is a source of its own, equal rows are taken one by one. A document's
    place depends on its size, id and text alone, so reruns agree. Other columns pass through.

    Positions in a source are a slice's start plus the row number in the slice. Slices are cut by size and then
    by leading digits of the id's hash, both part of the order, so a source or a group of copies that holds
    a third of all rows spreads over many tasks; starts are running sums over counts.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = packed(
        docs,
        words_in(whole_text()).alias("__size"),
        F.when(F.isnull("source"), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("__source"),
        F.md5(doc_id).alias("__md5"), F.col("doc_id").alias("__id"), F.xxhash64(whole_text()).alias("__text"),
    ).withColumn("__slice", F.substring("__md5", 1, SLICE_DIGITS))
    keys = ["__source", "__size", "__slice"]
    slices = sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    by_size = slices.groupBy("__source", "__size").agg(F.sum("__n").alias("__of_size"))
    earlier = (W.unboundedPreceding, -1)
    size_start = F.coalesce(F.sum("__of_size").over(W.partitionBy("__source").orderBy("__size").rowsBetween(*earlier)), F.lit(0))
    slice_start = F.coalesce(F.sum("__n").over(W.partitionBy("__source", "__size").orderBy("__slice").rowsBetween(*earlier)), F.lit(0))
    totals = by_size.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__of_size")).alias("source_size"))
    name = F.when(F.col("__source") != "n", F.expr("substring(__source, 2)"))
    plan = targets(totals.select(name.alias("source"), "source_size"), weights, most).select(
        F.when(F.isnull("source"), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("__source"),
        F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
    )
    starts = (
        slices.withColumn("__in_size", slice_start)
        .join(by_size.select("__source", "__size", size_start.alias("__before")), ["__source", "__size"])
        .join(plan, "__source")
        .select(*keys, (F.col("__before") + F.col("__in_size")).alias("__start"), "__source_size", "__target")
    )
    inside = W.partitionBy(*keys).orderBy("__md5", "__id", "__text")
    placed = sized.withColumn("__rank", F.row_number().over(inside)).join(starts, keys)
    rate = F.coalesce(F.try_divide(F.col("__target"), F.col("__source_size").cast("double")), F.lit(0.0))
    offset = _offset(name, seed)
    last = F.col("__start") + F.col("__rank")
    crossed = F.floor(last * rate + offset) - F.floor((last - 1) * rate + offset)
    copies = F.least(crossed, F.ceil(rate)).cast("int")
    return placed.select("__row", "__size", "__source_size", "__target", copies.alias("__copies"))


def emitted(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document's rows repeated as often as it is taken, in the columns of ``docs``."""
    rows = mixed(docs, **how).filter("__copies > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")


def report(docs: DataFrame, **how) -> DataFrame:
    return mixed(docs.select("doc_id", "text", "source"), **how).select(
        "__row.doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


SQL = rf"""
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as h,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as rn from d group by source
), w as (
  select *, (rn - 1) % 3 + 1 as weight, source_size * {MOST} as cap from s
), f as (
  select *, cap <= cast(sum(source_size) over () - coalesce(sum(cap) over b, 0) as double)
    / cast(sum(weight) over () - coalesce(sum(weight) over b, 0) as double) * weight as is_full
  from w window b as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)
), t as (
  select source, source_size, coalesce(case when is_full then cast(cap as double) else
    cast(sum(source_size) over () - coalesce(sum(case when is_full then cap end) over (), 0) as double)
    / nullif(cast(sum(case when not is_full then weight end) over () as double), 0) * weight end, 0) as target,
    (cast('0x' || substr(md5('{SEED}' || coalesce(source, '')), 1, 3) as integer) + 0.5::double) / 4096 as u
  from f
), p as (
  select d.doc_id, d.size, t.source_size, t.target, t.u,
    coalesce(t.target / nullif(cast(t.source_size as double), 0), 0) as rate,
    row_number() over (partition by d.source order by d.size, d.h, d.doc_id nulls first) as k
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  size * cast(least(floor(k * rate + u) - floor((k - 1) * rate + u), ceil(rate)) as bigint) as taken
from p
"""
