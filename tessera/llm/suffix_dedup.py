"""Removal of long repeated byte strings, found by suffix arrays over shards.

Every string of `length` bytes has an anchor: the 32-byte gram in it with the least hash. Strings
that are equal have equal anchors at equal places, so all occurrences of a string meet in the shard
that its anchor's hash names. A run of strings with one anchor is a segment; equal segments travel as one with the
number of its occurrences, and an anchor's only segment that occurs twice needs no sorting. Segments
are cut to what they share with a neighbour in the order of what stands right, or left, of their
anchor. Each shard builds the suffix array of its segments by induced sorting, and the permuted
common prefixes tell which positions begin a string that occurs elsewhere. A task reads its segments
in blocks of whole shards. A shard of more than `dense` bytes is split: its strings are classed by where their anchor
stands, and the bytes that all strings of a class have around it name finer shards, which are sorted as the others
are, or split again into narrower classes; those of one place have one string each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_in, slices, utf8, with_results
from .suffix_array import repeated_starts

GRAM = 32
_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Segments of texts: (anchor hash, start, end), bytes [start, end) holding all strings with that anchor."""

    def __init__(self, length: int, piece: int = 1 << 16):
        if length < 2 * GRAM:
            raise ValueError(f"strings must have {2 * GRAM} bytes or more")
        self.length, self.piece = length, piece
        self.up, self.down = _powers(piece + length + GRAM, _M), _powers(piece + length + GRAM, _INVERSE)

    def grams(self, flat: np.ndarray) -> np.ndarray:
        """A hash of each gram: rolled as a difference of prefix sums, then mixed."""
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self.up[: len(flat)], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * self.down[: len(flat) - GRAM + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def segments(self, text: bytes) -> tuple[np.ndarray, ...]:
        parts = []
        n = len(text) - self.length + 1  # strings
        for at in range(0, max(n, 0), self.piece):
            count = min(self.piece, n - at)
            h = self.grams(np.frombuffer(text, np.uint8, count + self.length - 1, at))
            # a key's high half orders by hash, its low half by place; the least of each window by doubling
            least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            width, window = 1, self.length - GRAM + 1
            while width * 2 <= window:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            least = np.minimum(least[:count], least[window - width : window - width + count])
            place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            last = np.append(first[1:], count)
            parts.append((h[place[first]].view(np.int64), first + at, last + at + self.length - 1, place[first] + at))
        if not parts:
            return (np.empty(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def covered_runs(begins: np.ndarray, length: int) -> np.ndarray:
    """Runs [a, b) of positions that strings beginning at the marked positions cover, as rows."""
    at = np.flatnonzero(begins)
    if not len(at):
        return np.empty((0, 2), np.int64)
    new = np.flatnonzero(np.diff(at) > length)
    return np.stack([at[np.concatenate([[0], new + 1])], at[np.concatenate([new, [len(at) - 1]])] + length], axis=1)


def repeated_runs(segments: list[bytes], often: list[bool], length: int) -> list[np.ndarray]:
    """For each segment, the runs of bytes that strings occurring elsewhere cover; often: it occurs more than once itself."""
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes + 1)
    text = np.ones(int(ends[-1]) + 1, np.uint16)  # 1 after each segment, 0 at the end
    text[-1] = 0
    for s, end in zip(segments, ends.tolist(), strict=True):
        text[end - 1 - len(s) : end - 1] = np.frombuffer(s, np.uint8).astype(np.uint16) + 2
    begins = repeated_starts(text, length)
    out = []
    for size, end, twice in zip(sizes.tolist(), ends.tolist(), often, strict=True):
        own = begins[end - 1 - size : end - length]
        out.append(covered_runs(np.ones_like(own) if twice else own, length))
    return out


def shared_ends(parts: list[bytes]) -> list[int]:
    """For each string, its longest common prefix with any other."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        a, b = parts[i], parts[j]
        n = min(len(a), len(b))
        if a[:n] != b[:n]:
            n = int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def shard_runs(batches: Iterator[pa.RecordBatch], length: int, block: int) -> Iterator[tuple[bytes, int, int]]:
    """(content, lo, hi) of rows (shard, content, often, at, data) that come ordered by shard."""
    waiting: list[tuple[bytes, bytes, bool, int]] = []
    held = 0

    def flush() -> Iterator[tuple[bytes, int, int]]:
        nonlocal held
        if waiting:
            runs = repeated_runs([w[1] for w in waiting], [False] * len(waiting), length)
            for (content, _, often, cut), found in zip(waiting, runs, strict=True):
                if not often:
                    for lo, hi in found.tolist():
                        yield content, cut + lo, cut + hi
        waiting.clear()
        held = 0

    def close(group: dict[bytes, tuple[bool, int, bytes]]) -> None:
        nonlocal held
        values = list(group.items())
        right = shared_ends([data[at:] for _, (_, at, data) in values])
        left = shared_ends([data[:at][::-1] for _, (_, at, data) in values])
        for (content, (often, at, data)), a, b in zip(values, left, right, strict=True):
            if a + b >= length:
                waiting.append((content, data[at - a : at + b], often, at - a))
                held += a + b

    shard, group = None, {}
    for batch in batches:
        for row_shard, content, often, at, data in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if row_shard != shard:
                close(group)
                if held >= block:
                    yield from flush()
                shard, group = row_shard, {}
            if content not in group:
                group[content] = (often, at, data)
                if often:
                    yield content, 0, len(data)
    close(group)
    yield from flush()


def _rows(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], many: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= many:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def class_widths(length: int, finer: int = 8) -> list[int]:
    """Widths of the classes of anchors' places that shards are split by, the last one a single place."""
    widths = [length - GRAM + 1]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // finer))
    return widths[1:]


def classes(shard: bytes, at: int, data: bytes, length: int, width: int) -> Iterator[tuple[int, bytes, int, bytes]]:
    """(lo, finer shard, at, data) of a segment's parts: the strings whose anchor stands in one class of places, `width` wide.

    All strings of a class have the bytes from the class's first place to `length` after its last one in common around the
    anchor, if they are equal anywhere; those name the finer shard.
    """
    first = max(0, at - (len(data) - length))
    for j in range(first // width, at // width + 1):
        low, high = max(first, j * width), min(at, (j + 1) * width - 1)
        core = data[at - j * width : at - (j + 1) * width + 1 + length]
        finer = xxhash.xxh3_128_digest(b"%d:" % j + shard + core)
        yield at - high, finer, high, data[at - high : at - low + length]


def sorted_runs(rows: DataFrame, length: int, block: int, total: int) -> DataFrame:
    """(content, lo, hi) of rows (shard, content, often, at, data) of shards that fit a task, `total` bytes in all."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 << 20)))
    shards = rows.select("shard", "content", "often", "at", "data").repartition(parts, "shard").sortWithinPartitions("shard")
    names, kinds = ["content", "lo", "hi"], [pa.binary(), pa.int32(), pa.int32()]
    return shards.mapInArrow(lambda batches: _rows(shard_runs(batches, length, block), names, kinds), "content binary, lo int, hi int")


def split_runs(rows: DataFrame, length: int, block: int, dense: int, widths: list[int]) -> DataFrame:
    """(content, lo, hi) of rows (shard, content, often, at, data), one a content, of shards too large for a task."""
    width, *narrower = widths
    names = ["content", "lo", "shard", "part", "often", "at", "data"]
    types = [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.int32(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                for shard, content, often, at, data in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                    for lo, finer, place, part in classes(shard, at, data, length, width):
                        yield content, lo, finer, xxhash.xxh3_128_digest(finer + part), often, place, part

        yield from _rows(parts(), names, types)

    source = rows.select("shard", "content", "often", "at", "data")
    pieces = materialize(source.mapInArrow(cut, "content binary, lo int, shard binary, part binary, often boolean, at int, data binary"))
    distinct = pieces.groupBy("shard", "part").agg((F.max("often") | (F.count("*") > 1)).alias("often"), F.min("at").alias("at"), F.min("data").alias("data"))
    distinct = materialize(distinct.withColumnRenamed("part", "content"))
    groups = distinct.groupBy("shard").agg(F.count("*").alias("kinds"), F.sum(F.octet_length("data")).alias("bytes"))
    sized = materialize(distinct.join(groups, "shard"))
    found = sized.filter("kinds = 1 and often").select("content", F.lit(0).alias("lo"), F.octet_length("data").alias("hi"))
    wanted = sized.filter("kinds > 1")
    most = wanted.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("total"), F.coalesce(F.max("bytes"), F.lit(0)).alias("most")).first()
    if most["total"]:
        found = found.unionAll(sorted_runs(wanted.filter(F.col("bytes") <= dense), length, block, most["total"]))
    if most["most"] > dense:
        found = found.unionAll(split_runs(wanted.filter(F.col("bytes") > dense), length, block, dense, narrower))
    found = found.select(F.col("content").alias("part"), F.col("lo").alias("from"), F.col("hi").alias("to"))
    return pieces.select("content", "part", F.col("lo").alias("base")).join(found, "part").select("content", (F.col("base") + F.col("from")).alias("lo"), (F.col("base") + F.col("to")).alias("hi"))


def repeated_spans(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 400, block: int = 1 << 20, dense: int = 1 << 18) -> DataFrame:
    """(key, spans): of each text with repeated strings, its key and the byte runs they cover, sorted and apart.

    The key is text_key() of the text. Equal texts have one row; an empty or null text has none.
    """
    slim = df.select(text_key(text).alias("key"), F.col(f"`{doc_id}`").alias("doc"), utf8(f"`{text}`").alias("data"))
    slim = slim.filter(F.octet_length("data") >= length)
    doc_type = dict(slim.dtypes)["doc"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        digest = xxhash.xxh3_128_digest
        names = ["key", "doc", "anchor", "content", "start", "size", "at"]
        for whole in batches:
            for batch in slices(whole, 2, 8 << 20):
                rows, made = [], []
                for i, data in enumerate(batch.column(2).to_pylist()):
                    h, start, end, place = anchors.segments(data)
                    rows.append(np.full(len(h), i))
                    made.append((h, start, end - start, place - start))
                    made[-1] += ([digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)],)
                index = pa.array(np.concatenate(rows))
                h, start, size, at = (np.concatenate([m[k] for m in made]) for k in range(4))
                contents = pa.array([c for m in made for c in m[4]], pa.binary())
                columns = [batch.column(0).take(index), batch.column(1).take(index), pa.array(h), contents, pa.array(start), pa.array(size.astype(np.int32)), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names)

    found = slim.mapInArrow(find, f"key binary, doc {doc_type}, anchor long, content binary, start long, size int, at int")
    # copies of a text become one before anything meets on an anchor
    segments = found.groupBy("key", "start", "anchor", "content", "size", "at").agg(F.count("*").alias("copies"), F.min("doc").alias("doc"))
    segments = materialize(segments)
    # materialised, as a join of two plain exchanges can split a hot anchor's partition
    often = materialize(segments.groupBy("anchor").agg(F.sum("copies").alias("n")).filter("n > 1").select("anchor"))
    met = materialize(segments.join(often, "anchor"))
    contents = met.groupBy("anchor", "content").agg(F.sum("copies").alias("n"), F.min(F.struct("key", "doc", "start", "size", "at")).alias("one"))
    contents = materialize(contents.select("anchor", "content", (F.col("n") > 1).alias("often"), "one.*"))
    groups = materialize(contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("size").alias("bytes")))
    sized = materialize(contents.join(groups, "anchor"))

    alone = sized.filter("kinds = 1 and often").select("content", F.lit(0).alias("lo"), F.col("size").alias("hi"))
    wanted = sized.filter("kinds > 1")
    total = wanted.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.coalesce(F.max("bytes"), F.lit(0)).alias("most")).first()
    piece = F.struct("anchor", "content", "often", "at", "start", "size", (F.col("bytes") > dense).alias("hot"))
    lists = wanted.groupBy(F.col("key").alias("k"), F.col("doc").alias("d")).agg(F.collect_list(piece).alias("pieces"))
    lists = materialize(lists)
    sought = maybe_in(slim, "key", lists.select(F.col("k").alias("key")), "sought").filter("sought").drop("sought")
    fetched = sought.join(lists, (F.col("key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d")))
    fetched = fetched.select("data", F.explode("pieces").alias("p")).select(
        F.col("p.anchor").cast("string").cast("binary").alias("shard"), "p.content", "p.often", "p.at", F.expr("substring(data, cast(p.start + 1 as int), p.size)").alias("data"), "p.hot"
    )
    if total["most"] > dense:
        fetched = materialize(fetched)
    covered = alone.unionAll(sorted_runs(fetched.filter("not hot"), length, block, total["b"]))
    if total["most"] > dense:
        hot = fetched.filter("hot").dropDuplicates(["content"])
        covered = covered.unionAll(split_runs(hot, length, block, dense, class_widths(length)))
    covered = materialize(covered)
    spread = met.join(covered, "content").select("key", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    return spread.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def text_key(text: str):
    """128 bits of a text's SHA-256; null is empty."""
    return F.substring(F.unhex(F.sha2(utf8(f"`{text}`"), 256)), 1, 16)


def removed(data: bytes, spans: list[dict] | None) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal runs of sorted spans, and what is left of the data."""
    merged: list[list[int]] = []
    for s in spans or ():
        if merged and s["lo"] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["hi"])
        else:
            merged.append([s["lo"], s["hi"]])
    kept, at = [], 0
    for lo, hi in merged:
        kept.append(data[at:lo])
        at = hi
    return [tuple(m) for m in merged], b"".join([*kept, data[at:]])


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 400, keep: list[str] | None = None) -> DataFrame:
    """Append n_bytes, n_removed, n_spans, kept_sha256, kept_bytes (the size of what is left) and kept_text (what is left, as text).

    Removed is every byte that a string of `length` bytes covers which begins anywhere else too, in the same text
    or another, overlapping or not; strings never cross texts, and are judged on the input. A null text
    is empty; texts below `length` bytes lose nothing. Rows stay one to one: the second of two equal rows is another
    place, so both lose their strings. Letters that a cut goes through become U+FFFD in kept_text, not in the digest.
    An empty table gives none.
    """
    spans = materialize(repeated_spans(df, text, doc_id, length))
    names = [c for c in df.columns if keep is None or c in keep]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_key(text).alias("key"), utf8(f"`{text}`").alias("data"))
    rows = maybe_in(rows, "key", spans.select("key"), "hit")
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    untouched = rows.filter("not hit").select("row", "data", none)
    hit = rows.filter("hit").join(spans.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left").select("row", "data", "spans")
    rows = untouched.unionAll(hit)

    def compute():
        def one(data, found):
            runs, left = removed(data, found)
            return len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), len(left), left.decode("utf-8", "replace")

        return lambda v: [list(c) for c in zip(*map(one, *v), strict=True)]

    results = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes long, kept_text string"
    out = with_results(rows, [F.col("data"), F.col("spans")], results, compute, keep=["row"])
    made = [f.split()[0] for f in results.split(", ")]
    return out.select(*[F.col(f"row.`{c}`") for c in names if c not in made], *made)
