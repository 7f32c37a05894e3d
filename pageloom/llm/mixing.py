"""Mixing sources to target weights with a low-discrepancy schedule.

A source's documents, shuffled by hash, form one long stream of words, which may be passed up to `most` times. The
mix has slots of equal size; slot i goes to the source whose share of the cumulative targets holds the i-th
point of the golden-ratio sequence, and the r-th slot of a source takes the r-th block of its stream. Thus
every stretch of the mix is close to the target shares, and each source ends within a word of its target. What is taken
of a document is what the slots take of it, and the mix is written in the order of its slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, running_offsets

_GOLDEN = 0.6180339887498949
_CELLS = 4096


def word_count(text: Column) -> Column:
    """Runs of bytes other than space and 0x09-0x0D; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3) -> DataFrame:
    """sizes (source, source_size), one row per source, plus weight, target, quota and the cumulative share [lo, hi).

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes; no target is
    over `most` times its source's size, what exceeds that is shared anew by weight until none is above.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("_i", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_r", F.col("_cap") / F.col("weight"))
    # Sources in the order in which they reach their caps: the first that needn't sets the level for all that follow.
    w = W.orderBy("_r", "_i")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("_all", F.sum("source_size").over(whole)).withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_weights", F.sum("weight").over(w.rowsBetween(0, W.unboundedFollowing))).withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_weights"))
    s = s.withColumn("_level", F.first(F.when(F.col("_r") >= F.col("_level"), F.col("_level")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    s = s.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("_cap", F.coalesce(F.col("weight") * F.col("_level"), F.col("_cap")))))
    s = s.withColumn("quota", F.round("target").cast("long"))
    s = s.withColumn("_sum", F.sum("target").over(whole)).withColumn("hi", F.sum("target").over(by_name.rowsBetween(W.unboundedPreceding, 0)) / F.col("_sum"))
    return s.withColumn("lo", F.lag("hi", 1, 0.0).over(by_name)).select("source", "source_size", "weight", "target", "quota", "lo", "hi", F.col("_i").cast("long").alias("source_no"))


def schedule(shares: DataFrame, block: int) -> DataFrame:
    """(slot, source_no, block_no, word_from, word_to): which words of its source's endless stream each slot of the mix takes; slots are numbers of their own."""
    spark = shares.sparkSession
    total = shares.agg(F.sum("quota")).first()[0] or 0
    n = -(-total // block)
    cell = lambda x: F.least(F.floor(x * _CELLS), F.lit(_CELLS - 1))
    parts = shares.where("quota > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    slots = spark.range(n).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 0.5) * F.lit(_GOLDEN), F.lit(1.0)).alias("u")).withColumn("cell", cell(F.col("u")))
    slots = slots.join(parts, "cell").where("u >= lo and (u < hi or hi >= 1)").select("slot", "source_no", "quota")
    slots = running_offsets(slots, ["source_no"], [F.col("slot")], F.floor(F.col("slot") / F.lit(1 << 16)), F.lit(1), "block_no").select("slot", "source_no", "block_no", "quota")
    # The sequence gives a source a few slots more or less than its quota needs: void or append these.
    have = slots.groupBy("source_no").agg(F.count("*").alias("have"))
    short = shares.where("quota > 0").join(have, "source_no", "left").withColumn("have", F.coalesce("have", F.lit(0))).withColumn("need", F.ceil(F.col("quota") / F.lit(block)))
    before = F.coalesce(F.sum("more").over(W.orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a source
    short = short.where("have < need").withColumn("more", F.col("need") - F.col("have")).withColumn("before", before)
    short = short.withColumn("block_no", F.explode(F.sequence("have", F.col("need") - 1)))
    short = short.select((F.lit(n) + F.col("before") + F.col("block_no") - F.col("have")).alias("slot"), "source_no", "block_no", "quota")
    slots = slots.unionByName(short).withColumn("word_from", F.col("block_no") * block).where("word_from < quota")
    return slots.select("slot", "source_no", "block_no", "word_from", F.least(F.col("word_from") + block, F.col("quota")).alias("word_to"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 1024, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(documents, takes).

    documents: doc_id, source, size, source_size, target, source_no, span_from of every row, its place in its source's stream.
    takes: (slot, source_no, span_from, pass_no, words_from, words_to), the words of a document that a slot of the
    mix takes. A null text has no words and is never taken; a null source is a source; repeated rows stand one after
    another in their stream; an empty table gives an empty mix. Texts are read once, for their sizes, and never shuffled.
    """
    return _mix(_lean(docs, F.xxhash64("text"), F.lit(0)), weights, most, block, seed)


def _lean(docs: DataFrame, k1: Column, k2: Column) -> DataFrame:
    return checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), k1.alias("_k1"), k2.alias("_k2")))


def _mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 1024, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """mix() of rows whose size and hashes, _k1 and _k2, are known."""
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = sized.withColumn("_order", name)
    sizes = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    shares = checkpointed(targets(sizes, weights, most))
    named = shares.select(F.col("source").alias("_source"), "source_size", "target", "quota", "source_no")
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = [F.col("_order"), F.col("size"), F.col("_k1"), F.col("_k2")]
    placed = checkpointed(running_offsets(placed, ["source_no"], order, F.substring("_order", 1, 3), F.col("size"), "span_from"))
    spans = placed.where("size > 0").select("source_no", "span_from", "size", "source_size", "quota").withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))
    spans = spans.withColumn("a", F.col("pass_no") * F.col("source_size") + F.col("span_from")).where("a < quota").withColumn("b", F.col("a") + F.col("size"))
    spans = spans.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    takes = spans.join(schedule(shares, block), ["source_no", "block_no"]).withColumn("f", F.greatest("a", "word_from")).withColumn("t", F.least("b", "word_to")).where("f < t")
    takes = takes.select("slot", "source_no", "span_from", "pass_no", (F.col("f") - F.col("a")).alias("words_from"), (F.col("t") - F.col("a")).alias("words_to"))
    return placed.drop("_order", "quota"), takes


def _with_takes(placed: DataFrame, takes: DataFrame, by: list[str]) -> DataFrame:
    """placed with what the slots take of each document, by document or by pass: _words, _slots and _slot, the first one. One without words shares its place with the next, which takes the words."""
    sums = takes.groupBy(F.col("source_no").alias("_no"), F.col("span_from").alias("_from"), *by)
    sums = sums.agg(F.sum(F.col("words_to") - F.col("words_from")).alias("_words"), F.count("*").alias("_slots"), F.min("slot").alias("_slot"))
    same = (F.col("source_no") == F.col("_no")) & (F.col("span_from") == F.col("_from")) & (F.col("size") > 0)
    return placed.join(sums, same, "left").drop("_no", "_from")


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: the words that the slots of the mix take of each document, repeats counted; slots: how many do; first_slot: the first of them, null if none does."""
    found = _with_takes(*mix(docs, **options), [])
    return found.select("doc_id", "source", "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).cast("long").alias(a) for c, a in (("_words", "taken"), ("_slots", "slots"))], F.col("_slot").alias("first_slot"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, blanks and line breaks as they are."""
    return F.array_join(F.slice(F.split(text, "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])"), F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, partition_words: int = 1 << 21, **options) -> DataFrame:
    """The mix itself: a row of docs, with all its columns, for each pass over a document, in the order of the slots that take it: partition by partition, and sorted in each.

    A document that its source's target cuts keeps its first words. Rows are told apart by two hashes of all columns;
    texts are shuffled to meet what is taken of them, where rows that are equal meet it together, and to their slots.
    A partition has about partition_words words.
    """
    names = docs.columns
    k1, k2 = F.xxhash64(*names), F.xxhash64(F.lit(13), *names)
    placed, takes = _mix(_lean(docs, k1, k2), **options)
    passes = checkpointed(_with_takes(placed, takes, ["pass_no"]).where("_words is not null").select("_k1", "_k2", "size", "_words", "_slot", "pass_no", "span_from"))
    words, last = passes.agg(F.sum("_words"), F.max("_slot")).first()
    parts = max(1, -(-(words or 0) // partition_words))
    whole = docs.select(k1.alias("_k1"), k2.alias("_k2"), F.struct(*names).alias("_row")).groupBy("_k1", "_k2").agg(F.first("_row").alias("_row"))
    out = whole.join(passes, ["_k1", "_k2"])
    out = out.repartitionById(parts, F.floor(F.col("_slot") * F.lit(parts) / F.lit((last or 0) + 1)).cast("int")).sortWithinPartitions("_slot", "pass_no", "span_from", "_k1", "_k2")
    text = F.when(F.col("_words") < F.col("size"), first_words(F.col("_row.text"), F.col("_words"))).otherwise(F.col("_row.text"))
    return out.select(*[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in names])
