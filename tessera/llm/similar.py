"""Near-duplicates by similarity: texts whose sets of word shingles have a Jaccard similarity of `like` or more.

Candidates meet in classes of SimHash fingerprints (as op5_simhash makes them: deletion variants of segments, verified links,
components) and, as similar texts' fingerprints can lie too far apart for those, under bands of minhashes besides: `rows` minima each, of `bands` bands one must be equal, which a pair of
similarity s misses with probability (1 - s^rows)^bands; 7e-5 at 0.8, less above. Each candidate is verified on the
sets themselves before it links anything. Under a key that many sets share (a dense cluster) blocks hand on spanning
forests of their verified links, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_in, utf8, with_batches_of, with_results
from .simhash import components, fingerprint_of, keep_best, links, shared, shingle_hashes


def shingle_set(text: bytes, words_each: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; none without words."""
    return np.unique(np.array(shingle_hashes(text, words_each), np.uint64))


def set_id(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).astype(np.int64))


def band_keys(shingles: np.ndarray, bands: int, rows: int, piece: int = 4096) -> list[int]:
    """The set's key in each band; none for an empty set."""
    if not len(shingles):
        return []
    rng = np.random.default_rng(42)
    factors, offsets = (rng.integers(0, 1 << 64, (bands * rows, 1), np.uint64) for _ in range(2))
    factors |= np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), piece):
        np.minimum(least, (shingles[None, i : i + piece] * factors + offsets).min(axis=1), out=least)
    digests = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(bands, rows))]
    return np.array(digests, np.uint64).astype(np.int64).tolist()


def _forest(ids: np.ndarray, sets: list[np.ndarray], first: int, like: float) -> list[tuple[int, int]]:
    """Links that span the components of sets; first: if not 0, only those from the first so many to the others."""
    lengths = np.array([len(s) for s in sets])
    joined = np.concatenate(sets)
    starts = np.cumsum(lengths) - lengths
    root, found = np.arange(len(sets)), []
    for i in range(first or len(sets)):
        open_ = root != root[i]
        open_[: first or i + 1] = False
        # sets whose sizes alone rule the similarity out
        open_ &= np.minimum(lengths, lengths[i]) >= like * np.maximum(lengths, lengths[i]) - 1e-6
        others = np.flatnonzero(open_)
        if not len(others):
            continue
        picked = joined if len(others) > len(sets) // 2 else np.concatenate([sets[j] for j in others])
        at = np.searchsorted(sets[i], picked)
        hit = sets[i][np.minimum(at, len(sets[i]) - 1)] == picked
        where = starts[others] if picked is joined else np.cumsum(lengths[others]) - lengths[others]
        total = np.concatenate([[0], np.cumsum(hit)])
        common = total[where + lengths[others]] - total[where]
        for j in others[common / (lengths[i] + lengths[others] - common) >= like]:
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                found.append((int(ids[i]), int(ids[j])))
    return found


def similar_links(met: DataFrame, shingles: DataFrame, like: float = 0.8, dense: int = 48, block: int = 1 << 20) -> DataFrame:
    """(a, b): verified links of the sets (set_id, size) that meet under a key (key, band, n), whose components are those of all such links.

    shingles has (set_id, shingles) of each. Under a key with up to `dense` sets all pairs are verified; under others,
    pairs of blocks (by hash) with about `block` shingles each.
    """
    few = met.filter(F.col("n") <= dense)
    a, b = few.alias("a"), few.alias("b")
    fit = F.least("a.size", "b.size") >= like * F.greatest("a.size", "b.size") - 1e-6
    pair = (F.col("a.key") == F.col("b.key")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.set_id") < F.col("b.set_id")) & fit
    pairs = a.join(b, pair).select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")).distinct()
    left, right = (shingles.select(F.col("set_id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = pairs.join(right, "b").join(left, "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    found = both.filter(F.col("common") / (F.size("sa") + F.size("sb") - F.col("common")) >= like).select("a", "b")
    many = met.filter(F.col("n") > dense)
    if many.limit(1).count():
        sizes = many.groupBy("key", "band").agg(F.expr(f"sum(size) div {block}").alias("last"))
        own = many.join(sizes, ["key", "band"]).withColumn("own", F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("last") + 1))
        blocks = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        blocks = blocks.select("key", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("second"), "set_id")

        def span(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["second", "set_id"])
            sets = [np.sort(np.asarray(s, np.int64).view(np.uint64)) for s in group["shingles"]]
            first = 0 if group["lo"].iloc[0] == group["hi"].iloc[0] else int((~group["second"]).sum())
            both = not first or first < len(sets)
            made = _forest(group["set_id"].to_numpy(np.int64), sets, first, like) if both else []
            return pd.DataFrame(made, columns=["a", "b"]).astype("int64")

        # neither the exploded blocks nor the sets are as small as estimated
        found = found.unionByName(blocks.join(shingles.hint("merge"), "set_id").groupBy("key", "band", "lo", "hi").applyInPandas(span, "a long, b long"))
    return found


def similar_classes(df: DataFrame, text: str = "text", words_each: int = 5, like: float = 0.8, bands: int = 24, rows: int = 5, bits: int = 3, extra: tuple[Column, ...] = ()) -> DataFrame:
    """set_id, root, extra0.. of every row: its set of shingles and its class, which verified links of sets connect.
    bits: how far fingerprints may differ that put two sets into one class of candidates.

    Words are lower-cased (A-Z); a text of fewer words than a shingle is one shingle. Texts without words, null ones
    too, are a class. Rows stay one to one; an empty table gives none.
    """
    names = [f"extra{i}" for i in range(len(extra))]
    content = F.xxhash64(F.col(f"`{text}`").cast("string"))
    slim = df.select(F.col(f"`{text}`").alias("text"), content.alias("content"), *[c.alias(n) for c, n in zip(extra, names, strict=True)])

    def name_and_keys():
        def one(text):
            hashes = shingle_hashes(text, words_each)
            shingles = np.unique(np.array(hashes, np.uint64))
            return set_id(shingles), len(shingles), band_keys(shingles, bands, rows), fingerprint_of(hashes)

        return lambda v: [list(c) for c in zip(*map(one, v[0]), strict=True)]

    # few texts at once, as an executor's workers hold what they were handed beside its heap
    with with_batches_of(df.sparkSession, 500):
        marked = materialize(with_results(slim, [utf8("text")], "set_id long, size long, keys array<bigint>, fp long", name_and_keys, ["content", *names], 1 << 20))
    sets = marked.groupBy("set_id").agg(F.min("content").alias("content"), F.min("size").alias("size"), F.min("keys").alias("keys"))
    keyed = sets.select("set_id", "content", "size", F.posexplode("keys").alias("band", "key"))
    # the classes of fingerprints are one more band
    fps = materialize(marked.filter("size > 0").groupBy("set_id", "fp").agg(F.min("content").alias("content"), F.min("size").alias("size")))
    near = components(links(fps.select("fp").distinct(), bits)).withColumnRenamed("node", "fp")
    classes = fps.join(near, "fp", "left").groupBy("set_id", F.coalesce("root", "fp").alias("key")).agg(F.min("content").alias("content"), F.min("size").alias("size"))
    keyed = keyed.unionByName(classes.withColumn("band", F.lit(-1)))
    met = materialize(shared(keyed, ["key", "band"]))

    def name_and_set():
        def run(v):
            sets = [shingle_set(t, words_each) for t in v[0]]
            return [[set_id(s) for s in sets], [s.view(np.int64) for s in sets]]

        return run

    wanted = maybe_in(slim.select("content", "text"), "content", met.select("content").distinct(), "wanted").filter("wanted")
    shingles = with_results(wanted, [utf8("text")], "set_id long, shingles array<bigint>", name_and_set, [], 1 << 20)
    with with_batches_of(df.sparkSession, 500):
        shingles = materialize(shingles.dropDuplicates(["set_id"]))
    roots = components(similar_links(met, shingles, like))
    return marked.join(roots, marked["set_id"] == roots["node"], "left").select("set_id", F.coalesce("root", "set_id").alias("root"), *names)


def one_of_similar(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words_each: int = 5, like: float = 0.8, bits: int = 3) -> DataFrame:
    """One row of each class of similar texts, the one with the smallest id (null ids last), with its own columns.

    Of rows with equal id and text one stays. The texts are shuffled once, on the id and the text's hash, to meet the verdicts.
    """
    found = similar_classes(df, text, words_each, like, bits=bits, extra=(F.col(f"`{doc_id}`"), F.xxhash64(F.col(f"`{text}`").cast("string"))))
    return keep_best(df, found.select("root", F.col("extra0").alias("doc_id"), F.col("extra1").alias("content")), text, doc_id)
