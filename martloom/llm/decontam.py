"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is the hash of six words at fixed places; the places between them are ignored. Any 13 aligned words that differ
in at most two places share a seed under one of the two masks. Items of 9 to 12 words are a window of their own and take two masks of
five words more, so that every allowed placement of differing words leaves them a seed. Shorter items must agree as a whole and
are one seed. Equal seeds give an alignment of a document with a benchmark item, which is then checked word by word, where the
documents are: few alignments are sent to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import UPPER, WORD, lower_ascii, packed, row_key, whole_text, written

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
SHORT_MASKS = ((0, 1, 3, 4, 5), (0, 1, 2, 5, 6))  # besides MASKS, for items shorter than a window
LEAST = 9  # words from which an item may differ in a word; shorter ones must agree as a whole
LEAST_LEAK = 5  # words of an item from which ``clean`` drops a document
WINDOW = 13  # words of an overlap that must agree
AGREE = 0.8  # share of the window's words that must be equal
MOST_BROADCAST = 1_000_000  # seeds of benchmark items (16 bytes each), or alignments (32 bytes), up to which they are broadcast


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def _seeds(hashes: Column, mask: tuple[int, ...], number: int) -> Column:
    starts = F.size(hashes) - mask[-1]
    places = F.when(starts > 0, F.sequence(F.lit(1), starts)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(number), *(F.element_at(hashes, i + p) for p in mask)))


def seeded(rows: DataFrame, keys: list[str], masks: tuple = MASKS, number: int = 0) -> DataFrame:
    """``rows`` (with ``__words``) as one row per seed: ``keys``, ``__seed`` and ``__at``, the seed's first word.

    ``masks`` are two, numbered from ``number``: seeds of different masks differ.
    """
    hashed = rows.select(*keys, F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"))
    lists = [_seeds(F.col("__hashes"), mask, k) for k, mask in enumerate(masks, number)]
    listed = hashed.select(*keys, F.concat(*lists).alias("__seeds"), F.greatest(F.size("__hashes") - masks[0][-1], F.lit(0)).alias("__first"))
    # The outer form, because with the inner one the optimizer repeats the seeds in a filter on their number.
    out = listed.select(*keys, "__first", F.posexplode_outer("__seeds").alias("__at", "__seed"))
    return out.select(*keys, "__seed", F.when(F.col("__at") < F.col("__first"), F.col("__at")).otherwise(F.col("__at") - F.col("__first")).alias("__at"))


def _runs(rows: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """Every run of as many words as one of ``sizes``, as a seed. Sizes are below ``LEAST``."""
    hashed = rows.select(*keys, F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"))
    lists = [_seeds(F.col("__hashes"), tuple(range(n)), 2 * len(MASKS) + n) for n in sizes]
    placed = F.concat(*(F.transform(found, lambda s, i: F.struct(s.alias("__seed"), i.alias("__at"))) for found in lists))
    return hashed.select(*keys, F.explode_outer(placed).alias("__s")).select(*keys, "__s.__seed", "__s.__at")


def overlaps(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per document and benchmark item that overlap: ``doc_id``, ``item_id``, ``start`` (word of the document, from 0),
    ``n_words`` compared and ``n_equal``, for the best alignment.

    They overlap if some 13 aligned words (all words of an item that has fewer) agree in four of five or more; items of fewer than 9 words
    must agree in all, and ``n_words`` tells how little that may be. Words are compared with A-Z lower-cased. Null and empty texts match
    nothing. Items with the same words are reported under the smallest id; rows with the same id and text once. Null ids are kept as
    they are. Seeds of the benchmark and alignments found are broadcast only up to a counted bound; beyond it the joins shuffle.
    """
    items = (
        benchmark.select("item_id", words_of(whole_text()).alias("__words")).groupBy("__words").agg(F.min("item_id").alias("item_id"))
        .filter(F.size("__words") > 0).withColumn("__item", F.xxhash64("__words", "item_id")).select("__item", "item_id", F.col("__words").alias("__theirs"))
    )
    worded = items.withColumnRenamed("__theirs", "__words")
    medium, short = worded.filter(F.size("__words").between(LEAST, WINDOW - 1)), worded.filter(F.size("__words") < LEAST)
    # Documents emit seeds for short items only of such lengths as there are.
    any_medium = not medium.isEmpty()
    sizes = sorted(r[0] for r in short.select(F.size("__words")).distinct().collect())
    probe = seeded(worded.filter(F.size("__words") >= LEAST), ["__item"])
    if any_medium:
        probe = probe.union(seeded(medium, ["__item"], SHORT_MASKS, len(MASKS)))
    if sizes:
        for n in sizes:
            seed = F.element_at(_seeds(F.transform("__words", lambda w: F.xxhash64(w)), tuple(range(n)), 2 * len(MASKS) + n), 1)
            probe = probe.union(short.filter(F.size("__words") == n).select("__item", seed.alias("__seed"), F.lit(0).alias("__at")))
    probe = probe.filter("__seed is not null").withColumnRenamed("__at", "__item_at").distinct()
    small = F.broadcast if probe.count() <= most_broadcast else (lambda df: df)
    keyed = docs.select("doc_id", "text").select("doc_id", "text", *row_key(docs.select("doc_id", "text")))
    keys = ["__h1", "__h2"]
    split = keyed.select(*keys, words_of(whole_text()).alias("__words"))
    seeds = seeded(split, keys)
    if any_medium:
        seeds = seeds.union(seeded(split, keys, SHORT_MASKS, len(MASKS)))
    if sizes:
        seeds = seeds.union(_runs(split, keys, sizes))
    lines = written(
        seeds.join(small(probe), "__seed").select(*keys, "__item", (F.col("__at") - F.col("__item_at")).alias("__shift")).distinct()
    )
    few = F.broadcast if lines.count() <= most_broadcast else (lambda df: df)
    # Documents with many alignments come as often; texts meet them where they lie unless there are too many to send.
    met = keyed.join(few(lines), keys).join(small(items), "__item")
    ours, theirs = F.col("__ours"), F.col("__theirs")
    # Words both sides have on this alignment; shift is where the item's word 0 falls in the document.
    begin = F.greatest(F.col("__shift"), F.lit(0))
    length = F.least(F.col("__shift") + F.size(theirs), F.size(ours)) - begin
    aligned = met.withColumn("__ours", words_of(whole_text())).select(
        *keys, "doc_id", "item_id", "__item", begin.alias("start"),
        F.zip_with(
            F.slice(ours, begin + 1, F.greatest(length, F.lit(0))), F.slice(theirs, begin - F.col("__shift") + 1, F.greatest(length, F.lit(0))),
            lambda a, b: (a == b).cast("int"),
        ).alias("__equal"),
        F.least(F.size(theirs), F.lit(WINDOW)).alias("__window"),
    )
    flags, window = F.col("__equal"), F.col("__window")
    starts = F.when(F.size(flags) >= window, F.sequence(F.lit(1), F.size(flags) - window + 1)).otherwise(F.array().cast("array<int>"))
    agree = F.exists(starts, lambda i: F.aggregate(F.slice(flags, i, window), F.lit(0), lambda s, e: s + e) >= F.when(window < LEAST, window).otherwise(window * AGREE))
    checked = aligned.select(
        *keys, "doc_id", "item_id", "__item", "start", F.size(flags).alias("n_words"),
        F.aggregate(flags, F.lit(0), lambda s, e: s + e).alias("n_equal"), agree.alias("__agree"),
    )
    # The verdict is filtered after the aggregation: below it, the optimizer would repeat the word lists in every window.
    best = F.max(F.struct("__agree", "n_equal", (-F.col("start")).alias("before"), "n_words")).alias("__best")
    found = checked.groupBy(*keys, "__item", "doc_id", "item_id").agg(best).filter("__best.__agree")
    return found.select(
        "doc_id", "item_id", (-F.col("__best.before")).cast("long").alias("start"), F.col("__best.n_words").cast("long").alias("n_words"),
        F.col("__best.n_equal").cast("long").alias("n_equal"), *keys,
    )


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_LEAK, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item of ``least`` words or more, in its columns. Null and empty texts overlap none.

    Items of a few words turn up in any prose, so shorter ones do not make a leak here; ``overlaps`` reports them. Keys of leaking rows are
    broadcast up to a counted bound, so clean rows need not move.
    """
    part = docs.select("doc_id", "text")
    known = benchmark.filter(F.size(words_of(whole_text())) >= least)
    hit = written(overlaps(docs, known, most_broadcast).select("__h1", "__h2").distinct())
    few = F.broadcast(hit) if hit.count() <= most_broadcast else hit
    keyed = packed(docs, *row_key(part))
    return keyed.join(few, ["__h1", "__h2"], "left_anti").select("__row.*")


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+')"
# By all pairs of equal words instead of seeds.
SQL = rf"""
with d as (select row_number() over () as k, doc_id, {_SQL_WORDS} as w from (select distinct doc_id, text from documents)),
i as (select min(item_id) as item_id, w from (select item_id, {_SQL_WORDS} as w from benchmark) group by w having len(w) > 0),
dw as (select k, doc_id, len(w) as n_ours, unnest(w) as word, generate_subscripts(w, 1) - 1 as place from d),
iw as (select item_id, len(w) as n_theirs, unnest(w) as word, generate_subscripts(w, 1) - 1 as place from i),
a as (
  select k, doc_id, item_id, dw.place - iw.place as shift, any_value(n_ours) as n_ours, any_value(n_theirs) as n_theirs, list(dw.place) as places
  from dw join iw using (word) group by 1, 2, 3, 4 having count(*) >= case when any_value(n_theirs) < {LEAST} then any_value(n_theirs) else {AGREE} * least({WINDOW}, any_value(n_theirs)) end
), o as (
  select *, greatest(shift, 0) as start, least(shift + n_theirs, n_ours) - greatest(shift, 0) as n_words, least({WINDOW}, n_theirs) as size, len(places) as n_equal from a
), f as (
  select * from o where len(list_filter(range(start, start + n_words - size + 1),
    lambda s: len(list_filter(places, lambda p: p >= s and p < s + size)) >= case when size < {LEAST} then size else {AGREE} * size end)) > 0
)
select doc_id, item_id, cast(start as bigint) as start, cast(n_words as bigint) as n_words, cast(n_equal as bigint) as n_equal from f
qualify row_number() over (partition by k, item_id order by n_equal desc, start, n_words desc) = 1
"""
