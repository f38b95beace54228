"""Near-duplicates by SimHash: a 64-bit fingerprint of a text's word shingles, linked at few differing bits.

Fingerprints at few differing bits are found by deletion variants. At up to 3 bits, cut into two
segments, two fingerprints differ by at most one bit in one of them. Each fingerprint is indexed
under each segment as it is, and under each segment with one bit struck out; those that meet under a
key are verified. Under a key that many share, the other bits are cut and struck in the same way; where many share that
too (a dense cluster), they are verified in blocks that hand on a spanning forest of their links, not all pairs. Components come from
alternating star contractions, all in DataFrames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checkpoints import settled
from .common import materialize, utf8, with_results

_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: bytes, words_each: int, seed: int = 42) -> list[int]:
    """Hashes of the lower-cased (A-Z) words' shingles in their order; all words are one if there are fewer, none without words."""
    words = text.lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= words_each:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - words_each] + 1).tolist()]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[words_each - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, words_each: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the lower-cased (A-Z) words' shingles; 0 without words."""
    return fingerprint_of(shingle_hashes(text, words_each, seed))


def fingerprint_of(hashes: list[int]) -> int:
    """The SimHash of shingles' hashes; 0 of none."""
    if not hashes:
        return 0
    columns = np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _TABLE for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def with_fingerprints(df: DataFrame, text: str = "text", to: str = "fp", words_each: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Append the fingerprint as a long; a null text is like an empty one, 0."""
    return with_results(df, [utf8(f"`{text}`")], f"`{to}` long", lambda: lambda v: [[fingerprint(t, words_each) for t in v[0]]], keep)


def segments_for(bits: int) -> int:
    """The fewest segments of which one surely differs by at most one bit."""
    return bits // 2 + 1


def struck_masks(bits: int) -> list[tuple[int, int]]:
    """(bits of the segment that count, bit struck out or 0) of each variant."""
    count = segments_for(bits)
    cuts = [64 * i // count for i in range(count + 1)]
    out = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        whole = (1 << hi) - (1 << lo)
        out += [(whole, 0), *((whole & ~(1 << b), 1 << b) for b in range(lo, hi))]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keys(fp: Column, masks: list[int]) -> Column:
    """Keys of a fingerprint, one a mask: the bits that count, told apart by the mask's number."""
    return F.array(*[fp.bitwiseAND(F.lit(_signed(m))).bitwiseXOR(F.lit(_signed(i * 0x9E3779B97F4A7C15 % (1 << 64)))) for i, m in enumerate(masks)])


def variants(bits: int, fp: str = "fp") -> Column:
    """Keys of a fingerprint under each segment, whole and with each of its bits struck out."""
    return _keys(F.col(fp), [m for m, _ in struck_masks(bits)])


def finer_masks(bits: int) -> list[list[int]]:
    """For each of the struck masks, masks over what lies outside its segment: cut and struck as the segments are."""
    count = segments_for(bits)
    cuts = [64 * i // count for i in range(count + 1)]
    out = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        places = [p for p in range(64) if not lo <= p < hi]
        inner = [len(places) * i // count for i in range(count + 1)]
        masks = []
        for x, y in zip(inner, inner[1:], strict=False):
            whole = sum(1 << p for p in places[x:y])
            masks += [whole, *(whole & ~(1 << p) for p in places[x:y])]
        out += [masks] * (1 + hi - lo)
    return out


def _forest(fps: np.ndarray, others: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Links that span the components of one block of fingerprints, or of the links between two."""
    n = len(fps)
    root = list(range(n + (0 if others is None else len(others))))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    both = fps if others is None else np.concatenate([fps, others])
    unsigned = both.view(np.uint64)  # bits of a negative number are counted as those of its absolute value
    links = []
    for i in range(n):
        first = i + 1 if others is None else n
        near = np.flatnonzero(np.bitwise_count(unsigned[first:] ^ unsigned[i]) <= bits) + first
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                links.append((i, j))
    return [(int(both[i]), int(both[j])) for i, j in links]


def spread(rows: DataFrame, column: str, rows_each: int) -> DataFrame:
    """`rows` by the hash of a column in tasks of about `rows_each`, for what makes many rows of each: tables this narrow are read in a few tasks, whatever comes after. Counting runs `rows`."""
    return rows.repartition(rows.count() // rows_each + 1, column)


def links(fps: DataFrame, bits: int = 3, dense: int = 48, block: int = 2048, rows_each: int = 4096) -> DataFrame:
    """(a, b) with a < b: links between distinct fingerprints (column fp) whose components are those of all links.

    Under a key with up to `dense` fingerprints all verified pairs are given. Those of another key are cut and struck again,
    over the bits outside its segment, in which they differ by `bits` at most too; under a finer key with more than
    `dense`, spanning forests of blocks (by hash) and of pairs of blocks. The more bits may differ, the more and shorter
    segments there are: 2 of 32 bits for 3, 3 of 21 for 5; with short ones, unlike fingerprints meet under a key too once
    there are many. The keys are made and counted in tasks of about `rows_each` fingerprints (66 keys each for 3 bits).
    """
    keyed = spread(fps, "fp", rows_each).select("fp", F.posexplode(variants(bits)).alias("variant", "key"))
    # a pair that has a segment in common meets under its whole; with a bit struck out only if just that one differs
    masks = F.array(*[F.lit(_signed(b)) for _, b in struck_masks(bits)])
    met = materialize(shared(keyed, ["key", "variant"]).withColumn("mask", masks[F.col("variant")]))
    found = _pairs(met.filter(F.col("n") <= dense), ["key", "variant"], bits)
    many = met.filter(F.col("n") > dense)
    if many.limit(1).count():
        # the masks depend on the segment alone, so few arrays are told apart
        distinct: list[list[int]] = []
        for m in finer_masks(bits):
            if m not in distinct:
                distinct.append(m)
        which = F.array(*[F.lit(distinct.index(m)) for m in finer_masks(bits)])[F.col("variant")]
        finer = F.when(which == 0, _keys(F.col("fp"), distinct[0]))
        for i, m in enumerate(distinct[1:], 1):
            finer = finer.when(which == i, _keys(F.col("fp"), m))
        apart = ["key", "variant", "finer", "place"]
        met = materialize(shared(many.drop("n").select("*", F.posexplode(finer).alias("place", "finer")), apart))
        found = found.unionByName(_pairs(met.filter(F.col("n") <= dense), apart, bits))
        many = met.filter(F.col("n") > dense)
        if many.limit(1).count():
            found = found.unionByName(_spanning(many, apart, bits, block))
    return found.distinct()


def shared(rows: DataFrame, group: list[str]) -> DataFrame:
    """The rows whose group has others, with its size n; counted before they meet, so that a hot group is split by the join.

    Rows that an explode made are estimated as few as those before it, so the sizes must not be broadcast by that estimate.
    """
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(sizes.hint("merge"), group)


def _pairs(rows: DataFrame, group: list[str], bits: int) -> DataFrame:
    """All verified pairs of each group."""
    a, b = rows.alias("a"), rows.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    pair = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= bits) & (differ.bitwiseAND(F.col("a.mask")) == F.col("a.mask"))
    for c in group:
        pair = (F.col(f"a.{c}") == F.col(f"b.{c}")) & pair
    return a.join(b, pair).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _spanning(many: DataFrame, group: list[str], bits: int, block: int) -> DataFrame:
    """Links that span the components of each group, from all its pairs of blocks."""
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.expr(f"(n - 1) div {block} + 1"))
    blocks = many.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}"))))
    blocks = blocks.select(*group, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("second"), "fp")

    def span(rows: pd.DataFrame) -> pd.DataFrame:
        second = rows["second"].to_numpy(bool)
        fps = rows["fp"].to_numpy(np.int64)
        lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
        made = _forest(np.sort(fps), None, bits) if lo == hi else _forest(np.sort(fps[~second]), np.sort(fps[second]), bits)
        return pd.DataFrame([(min(x), max(x)) for x in made], columns=["a", "b"]).astype("int64")

    return blocks.groupBy(*group, "lo", "hi").applyInPandas(span, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of `edges` (a, b) with the smallest node that it reaches.

    Rounds of large and small stars (Kiveris et al., "Connected components in MapReduce and beyond", 2014),
    each written to the shared folder, until nothing moves; their number grows as the logarithm of the largest component.
    """
    current = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    now, before = (), None
    while now != before:
        both = current.select("u", "v").unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: a node's larger neighbours go to the least of its neighbourhood
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        current = settled(small, current)
        now, before = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first(), now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_classes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words_each: int = 3, bits: int = 3, extra: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, fp (long), root, component_id, extra0.. of every row: its fingerprint and its class, named by a fingerprint too.

    component_id is the smallest non-null doc_id in the class, whose fingerprints are connected by links of up to `bits`
    differing bits; null only if the class has none. Rows stay one to one; rows with a null or empty text share the
    fingerprint 0, a class like any other. An empty table gives none.
    """
    names = [f"`{doc_id}`", *[f"extra{i}" for i in range(len(extra))]]
    slim = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *[c.alias(n) for c, n in zip(extra, names[1:], strict=True)])
    marked = materialize(with_fingerprints(slim, "text", "fp", words_each, keep=["doc_id", *names[1:]]))
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), bits))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted)
    joined = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = rooted.join(joined, "root").select("fp", "root", "component_id")
    return marked.join(label, "fp").select("doc_id", "fp", "root", "component_id", *names[1:])


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words_each: int = 5, bits: int = 5) -> DataFrame:
    """One row of each class of fingerprints linked at up to `bits` bits, the one with the smallest id (null ids last), with its own columns.

    The texts' similarity is not verified; `similar.one_of_similar` does that. Of rows with equal id and text one stays.
    """
    content = F.xxhash64(F.col(f"`{text}`").cast("string"))
    found = simhash_classes(df, text, doc_id, words_each, bits, (content,))
    return keep_best(df, found.select("root", "doc_id", F.col("extra0").alias("content")), text, doc_id)


def keep_best(df: DataFrame, found: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The row with the smallest id (null ids last) of each class; found has (root, doc_id, content), content the text's hash.

    Of rows with equal id and text one stays. The texts are shuffled once, on the id and the text's hash, to meet the verdicts.
    """
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")).alias("best"))
    keep = materialize(best.select(F.col("best.doc_id").alias("keep_id"), F.col("best.content").alias("keep_text")))
    names = df.columns
    content = F.xxhash64(F.col(f"`{text}`").cast("string"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{doc_id}`").alias("d"), content.alias("t"))
    met = rows.join(keep, F.col("t").eqNullSafe(F.col("keep_text")) & F.col("d").eqNullSafe(F.col("keep_id")), "left_semi")
    # repeated rows become one in each task before they meet
    plain = [f"row.`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType, T.NullType))]
    return met.groupBy("d", "t").agg(F.min_by("row", F.xxhash64(*plain)).alias("row")).select("row.*")
