"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents stand in a shuffled order (by a hash) and form one stream of words, cut into
blocks of equally many. The mix is a row of slots. A slot's van der Corput point, its number with the
bits reversed, falls into one of the sources' cumulative shares of the slots; it is the source's k-th
slot, and takes the k-th block of that source's stream, which starts again at its end. Any run of
consecutive slots holds the sources in nearly their target shares, and rerunning gives the same mix.

No step gathers a source: positions in a stream come from sums over hash ranges of some thousand rows,
slots from ranges of numbers, and a slot's rank in its source from a closed form over its bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import WORD, materialize, small

#: Sources beyond which the table of sources is joined by a shuffle instead of a broadcast.
MOST_SOURCES = 20_000


def word_count(text: str | Column) -> Column:
    """Number of words; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stream_table(docs: DataFrame, text: str, source: str, doc_id: str, seed: int, carry: tuple[Column, ...]) -> DataFrame:
    """One row a document: its id, source, size, place in the shuffle and the hash range that it falls into."""
    sized = docs.select(
        F.col(f"`{doc_id}`").alias("doc"),
        F.col(f"`{source}`").cast("string").alias("source"),
        word_count(f"`{text}`").alias("size"),
        *[c.alias(f"carry{i}") for i, c in enumerate(carry)],
    )
    # rows without an id would share a hash if they are equally long
    alone = F.when(F.col("doc").isNull(), F.monotonically_increasing_id())
    return sized.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc"), F.col("size"), alone))


def source_targets(stats: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, few: int = 20_000) -> DataFrame:
    """(source, rows, source_size) -> also weight and target.

    Sources in code-point order, null last, weigh `weights`, repeating. Targets share the sum of all sizes
    by weight; none goes above `most_repeats` times its source's size: with the sources ordered by the ratio
    of that bound to the weight, the bounded ones are a prefix, and the others share what it leaves.
    """
    by_name = F.col("source").asc_nulls_last()
    sums = stats.agg(F.sum("source_size").alias("size"), F.count("*").alias("n")).first()
    n = len(weights)
    weighed = numbered(stats, [by_name], few=few)
    weighed = weighed.withColumn("weight", F.array(*map(F.lit, weights))[(F.col("place") % n).cast("int")]).drop("place")
    weighed = weighed.withColumn("bound", F.col("source_size") * most_repeats).withColumn("ratio", F.col("bound") / F.col("weight"))
    weighed = materialize(weighed)
    heavy = sum(weights) * (sums["n"] // n) + sum(weights[: sums["n"] % n])
    leveled = numbered(weighed, [F.col("ratio"), by_name], sums={"bound": "bounds", "weight": "weights"}, few=few)
    # what a unit of weight gets if only the sources before are bounded; the first that fits starts the open ones, which share it
    level = (F.lit(sums["size"] or 0) - F.col("bounds")) / (F.lit(heavy) - F.col("weights"))
    fits = leveled.withColumn("level", level).filter("level <= ratio")
    cut = fits.agg(F.min(F.struct("place", "level")).alias("first")).first()["first"]
    bound = F.col("bound").cast("double")
    target = bound if cut is None else F.when(F.col("bound") <= F.lit(cut["level"]) * F.col("weight"), bound).otherwise(F.lit(cut["level"]) * F.col("weight"))
    return weighed.select("source", "rows", "source_size", "weight", target.alias("target"))


def _below(slot: Column, bits: Column, edge: Column) -> Column:
    """How many numbers before `slot` have a bit reversal (over `bits` bits) below `edge`."""
    # Split [0, slot) at each set bit j: the higher bits are slot's, bit j is 0, the lower j are free.
    # Reversed, the free bits lead: the values are free * 2^(bits - j) + fixed.
    def add(total, j):
        step = F.call_function("shiftleft", F.lit(1).cast("long"), (bits - j).cast("int"))
        kept = F.call_function("shiftleft", F.call_function("shiftright", slot, (j + 1).cast("int")), (j + 1).cast("int"))
        fixed = _reversed(kept, bits)
        count = F.least(F.call_function("shiftleft", F.lit(1).cast("long"), j.cast("int")), F.greatest(F.lit(0).cast("long"), F.floor((edge - fixed + step - 1) / step)))
        is_set = F.call_function("shiftright", slot, j.cast("int")).bitwiseAND(F.lit(1)) == 1
        return total + F.when(is_set, count).otherwise(F.lit(0).cast("long"))

    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(bits, F.lit(1)) - 1), F.lit(0).cast("long"), add))


def _reversed(x: Column, bits: Column) -> Column:
    """The `bits` low bits of x in reverse order (the van der Corput point times 2^bits)."""
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, F.lit("0"))), 2, 10).cast("long")


def schedule(targets: DataFrame, block_words: int, chunk: int = 1 << 12, few: int = 20_000) -> DataFrame:
    """Slots of the mix: (source, source_size, rank, slot, from, to), [from, to) in the source's endless stream.

    A source has as many slots as its target has blocks, the last one shorter.
    """
    whole = targets.withColumn("words", F.round("target").cast("long")).filter("words > 0")
    whole = whole.withColumn("slots", F.ceil(F.col("words") / F.lit(block_words)).cast("long"))
    every = whole.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    whole = numbered(whole, [F.col("source").asc_nulls_last()], sums={"slots": "first"}, few=few)
    whole = whole.withColumn("bits", F.lit(max(0, every - 1).bit_length()))
    chunks = whole.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("slots") - 1) / F.lit(chunk)).cast("long"))))
    begin = F.col("c") * chunk
    # a number of partitions of its own, as few rows that become many must not be put together
    n_parts = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = chunks.repartition(n_parts, F.col("source"), F.col("c")).withColumn(
        "i", F.explode(F.sequence(begin, F.least(begin + chunk, F.col("slots")) - 1))
    )
    bits, first = F.col("bits"), F.col("first")
    # a source owns the points [first, first + slots) of 2^bits; the slot is the number that the point comes from
    points = points.withColumn("slot", F.when(bits == 0, F.lit(0).cast("long")).otherwise(_reversed(first + F.col("i"), bits)))
    points = points.withColumn("rank", _below(F.col("slot"), bits, first + F.col("slots")) - _below(F.col("slot"), bits, first))
    start = F.col("rank") * block_words
    return points.select("source", "source_size", "rank", "slot", start.alias("from"), F.least(start + block_words, F.col("words")).alias("to"))


def mixture(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = (1, 2, 3),
    most_repeats: int = 3,
    block_words: int = 256,
    seed: int = 11,
    carry: tuple[Column, ...] = (),
    few: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """The documents with their place and target, and the mix: which words of which documents stand in which slot.

    First table: doc, source, size, source_size, target, key (unique to the row), carry0.. (further expressions over `docs`).
    Second table: key, slot, from_word, to_word (words of the document, from 0), lap (times that the source's
    stream has ended before), ordered by (slot, lap, place).

    Sources in code-point order, null (a source like any other) last. A null text has size 0 and takes no part, like
    any empty one; null and repeated ids are fine, and each of several equal rows has a part of its own. Without
    words, or rows, the mix is empty. Up to `few` sources are ordered in one task, more in ranges.
    """
    table = materialize(stream_table(docs, text, source, doc_id, seed, carry))
    stats = materialize(table.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size")))
    targets = materialize(source_targets(stats, weights, most_repeats, few))
    sources = small(targets, MOST_SOURCES)
    placed = _places(table.join(sources, table["source"].eqNullSafe(sources["source"]), "left").drop(sources["source"]))
    placed = materialize(placed)

    # a document's words and a slot's words, by block of the source's stream
    block = lambda x: F.floor(x / F.lit(block_words)).cast("long")
    pieces = placed.filter("size > 0").select("key", "source", "at", "size", F.explode(F.sequence(block(F.col("at")), block(F.col("at") + F.col("size") - 1))).alias("block"))
    laps = schedule(targets, block_words, few=few).withColumn("lap", F.explode(F.sequence((F.col("from") / F.col("source_size")).cast("long"), ((F.col("to") - 1) / F.col("source_size")).cast("long"))))
    shift = F.col("lap") * F.col("source_size")
    laps = laps.withColumn("lo", F.greatest(F.col("from") - shift, F.lit(0))).withColumn("hi", F.least(F.col("to") - shift, F.col("source_size")))
    laps = laps.select(F.col("source").alias("of"), "slot", "lap", "lo", "hi", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi") - 1))).alias("b"))
    # both sides grow with the documents, whatever is estimated for the exploded ranges
    near = pieces.join(laps.hint("merge"), (F.col("block") == F.col("b")) & F.col("source").eqNullSafe(F.col("of")))
    b0 = F.col("block") * block_words
    lo = F.greatest(F.col("at"), F.col("lo"), b0)
    hi = F.least(F.col("at") + F.col("size"), F.col("hi"), b0 + block_words)
    mix = near.withColumn("p", lo).withColumn("q", hi).filter("p < q")
    mix = mix.select("key", "slot", "lap", (F.col("p") - F.col("at")).alias("from_word"), (F.col("q") - F.col("at")).alias("to_word"))
    return placed, mix


def _places(table: DataFrame, rows: int = 2048) -> DataFrame:
    """Add `at`, where the document begins in its source's stream, and `key`.

    The hash range is split into a power of two of parts with about `rows` rows of the source each; a
    part's sum goes before all parts after it.
    """
    parts = F.greatest(F.lit(0), F.length(F.bin(F.col("rows") / F.lit(rows))) - 1)
    parts = F.when(F.col("rows") < 2 * rows, 0).otherwise(parts)
    # parts == 0 would shift by 64, which Java takes as 0
    part = F.when(parts == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("h"), (64 - parts).cast("int")))
    table = table.withColumn("part", part)
    sums = table.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_at"))
    order = [F.col(c).asc_nulls_last() for c in ["h", "doc", "size", *[c for c in table.columns if c.startswith("carry")]]]
    inside = Window.partitionBy("source", "part").orderBy(*order)
    table = table.withColumn("row", F.row_number().over(inside))
    table = table.withColumn("at", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    table = table.join(sums, table["source"].eqNullSafe(sums["s"]) & (table["part"] == sums["p"]))
    key = F.struct("source", "part", "row")
    return table.withColumn("at", (F.col("at") + F.col("part_at")).cast("long")).withColumn("key", key).drop("s", "p", "part_at", "row", "part")


def taken_words(placed: DataFrame, mix: DataFrame) -> DataFrame:
    """`placed` with the words that the mix takes of each document, repeats counted."""
    taken = mix.groupBy("key").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("words"))
    right = taken.select(*[F.col(f"key.{c}").alias(f"key_{c}") for c in ("source", "part", "row")], "words")
    # the key's fields apart: the source in it can be null
    same = (F.col("key.part") == F.col("key_part")) & (F.col("key.row") == F.col("key_row")) & F.col("key.source").eqNullSafe(F.col("key_source"))
    return placed.join(right, same, "left").withColumn("taken", F.coalesce(F.col("words"), F.lit(0)).cast("long")).drop("key_source", "key_part", "key_row", "words")


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` as often as the mix takes them: a document's taken words over its size, rounded.

    All but one document of a source are taken a whole number of times; columns stay those of `docs`. Rows with
    equal id, source and text share their copies out. The texts are shuffled once, to meet the decisions.
    """
    names = docs.columns
    content = F.xxhash64(F.col(f"`{text}`").cast("string"))
    placed, mix = mixture(docs, text, source, doc_id, carry=(content,), **options)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    counted = taken_words(placed, mix).groupBy("doc", "source", "carry0").agg(F.sum(times).alias("copies"), F.count("*").alias("equal"))
    counted = materialize(counted.filter("copies > 0"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{doc_id}`").alias("d"), F.col(f"`{source}`").cast("string").alias("s"), content.alias("t"))
    met = rows.join(counted, F.col("t").eqNullSafe(F.col("carry0")) & F.col("d").eqNullSafe(F.col("doc")) & F.col("s").eqNullSafe(F.col("source")))
    share = F.col("copies")
    if counted.filter("equal > 1").limit(1).count():
        nth = F.row_number().over(Window.partitionBy("d", "s", "t").orderBy("t"))
        share = F.expr("copies div equal") + F.when(nth <= F.col("copies") % F.col("equal"), 1).otherwise(0)
    met = met.withColumn("share", share).filter("share > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share"))))
    return met.select("row.*")
