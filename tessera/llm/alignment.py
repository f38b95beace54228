"""Cross-tokenizer alignment: where the tokens of two vocabularies end at the same bytes, and which ids share such groups.

Python only tokenises. It hands on, for a block of texts, the runs between blanks that occur in it with both vocabularies' ids
and end offsets, and each text as numbers of those runs (no token of either crosses a run's border, so runs are cut into
groups on their own). Groups, links and counts are then made by higher-order functions and joins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checkpoints import settled
from .bpe import PIECES, byte_letters
from .byte_bpe import Numbers
from .common import fresh, gathered, pieces, utf8, with_batches_of

#: Pairs of ids that are broadcast with their counts: the most frequent ones. All others are joined by a shuffle.
MOST_BROADCAST = 200_000
#: Runs whose tokens are remembered between blocks, and bytes of text in a block.
MOST_KNOWN, BLOCK = 300_000, 3 << 20
#: Texts that are handed to Python at once where the rows are stored: blocks are gathered from them, and 10,000 texts would be held four times.
ROWS = 200

RUNS = "array<struct<a: array<int>, a_ends: array<int>, b: array<int>, b_ends: array<int>>>"
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "groups")


class Tokenizers:
    """Both vocabularies, as ids and byte sizes of the runs of a text."""

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        # merges are ranked in the order of the ids, so joining by id is joining by rank
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = {i: t for t, i in ranks.items()}
        self.bytes_b = [self.piece(i) for i in range(self.b.get_piece_size())]
        self.size_a = np.zeros(max(self.bytes_a) + 1, np.int32)
        self.size_a[list(self.bytes_a)] = [len(t) for t in self.bytes_a.values()]
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int32)
        inner = [p for i in range(len(self.bytes_b)) if "▁" in (p := self.b.id_to_piece(i)).lstrip("▁")]
        if inner:
            raise ValueError("pieces that go on behind a blank: texts can't be cut into runs")
        self.cut = regex.compile(r"(?<=\S)(?= \S)")
        self.odd = regex.compile(r"\s\s|\s$")
        self.forget()

    def forget(self) -> None:
        """Runs by number; of both sides all ids and ends one after another, and where each run's begin and how many they are; and
        whether both sides give a run's bytes back."""
        self.number = Numbers()
        self.pools = [np.empty((2, 0), np.int32)] * 2
        self.spans = [np.empty((2, 0), np.int64)] * 2
        self.good = np.empty(0, bool)

    def piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def runs(self, text: str) -> list[str]:
        """A text, with a blank before it, cut before each blank that stands alone between other characters."""
        if self.odd.search(text) or text[0].isspace() or "\0" in text:
            return self.cut.split(" " + text)
        return (" " + text.replace(" ", "\0 ")).split("\0")

    def learn(self) -> None:
        """Tokenise the runs that got the last numbers; each begins with the blank that the second vocabulary adds by itself."""
        new = len(self.number) - len(self.good)
        if not new:
            return
        found = list(islice(reversed(self.number), new))[::-1]
        data, good = [r.encode() for r in found], np.ones(new, bool)
        for side, (rows, sizes, pieces) in enumerate((
            ([self.a.encode_ordinary(r) for r in found], self.size_a, self.bytes_a), (self.b.encode([r[1:] for r in found], num_threads=1), self.size_b, self.bytes_b),
        )):
            good &= [b"".join([pieces[i] for i in row]) == d for row, d in zip(rows, data, strict=True)]
            counts = np.fromiter(map(len, rows), np.int64, new)
            ids = np.fromiter(chain.from_iterable(rows), np.int32, counts.sum())
            begun = np.cumsum(counts) - counts
            ends = np.append(0, np.cumsum(sizes[ids], dtype=np.int64))
            inside = ends[1:] - np.repeat(ends[begun], counts)
            self.spans[side] = np.hstack([self.spans[side], [begun + self.pools[side].shape[1], counts]])
            self.pools[side] = np.hstack([self.pools[side], [ids, inside.astype(np.int32)]])
        self.good = np.append(self.good, good)

    def block(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Each text as numbers of the block's runs (none: no tokens), its tokens of both sides, and both sides' ids and ends of the runs,
        with how many each run has."""
        codes = []
        for data in texts:
            text = data.decode("utf-8", "replace")
            # bytes that are no UTF-8 are not given back by any token
            codes.append([self.number[r] for r in self.runs(text)] if text and text.encode() == data else [])
        self.learn()
        arrays = [np.array(c, np.int64) for c in codes]
        arrays = [c if self.good[c].all() else c[:0] for c in arrays]
        here, local = np.unique(np.concatenate(arrays), return_inverse=True)
        sides, tokens = [], []
        for pool, spans in zip(self.pools, self.spans, strict=True):
            starts, n = spans[:, here]
            ends = np.cumsum(n)
            sides.append((pool[:, np.arange(n.sum()) + np.repeat(starts - (ends - n), n)], n))
            tokens.append([spans[1, c].sum() for c in arrays])
        out = np.split(local.astype(np.int32), np.cumsum([len(c) for c in arrays])[:-1])
        if len(self.number) > MOST_KNOWN or self.pools[0].shape[1] > 8 * MOST_KNOWN:
            self.forget()
        return out, np.array(tokens, np.int64), sides


@lru_cache(2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def listed(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def tokenised(df: DataFrame, path_a: str, path_b: str, text: str, keep: list[str]) -> DataFrame:
    """(rows, runs): blocks of texts; rows has a block's texts with the columns `keep` as k0, k1, ... and their runs' numbers."""
    kept = [next(f for f in df.schema.fields if f.name == c) for c in keep]
    fields = [T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept)]
    row = T.StructType([*fields, T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("codes", T.ArrayType(T.IntegerType()))])
    out = T.StructType([T.StructField("rows", T.ArrayType(row)), T.StructField("runs", T._parse_datatype_string(RUNS))])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        for batch in pieces(gathered(batches, len(kept), BLOCK), len(kept), BLOCK):
            codes, tokens, sides = both.block(batch.column(len(kept)).to_pylist())
            flat = listed(pa.array(np.concatenate(codes)), [len(c) for c in codes])
            rows = pa.StructArray.from_arrays([*batch.columns[:-1], *map(pa.array, tokens), flat], names=row.names)
            columns = [listed(pa.array(x), n) for values, n in sides for x in values]
            runs = pa.StructArray.from_arrays(columns, names=["a", "a_ends", "b", "b_ends"])
            lists = [listed(x, [len(x)]).cast(k) for x, k in zip((rows, runs), kinds, strict=True)]
            del batch, codes, tokens, sides, flat, rows, columns, runs
            yield pa.RecordBatch.from_arrays(lists, names=out.names)

    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    return df.select(*columns, utf8(f"`{text}`").alias("text")).mapInArrow(run, out)


def let(value: Column, body: object) -> Column:
    """body(value), with `value` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def place(ends: Column, end: Column) -> Column:
    """Which one of ascending ends this is, from 1: by looking through a few, by halving many."""
    middle = lambda s: F.call_function("shiftright", s["low"] + s["high"], F.lit(1))
    halve = lambda s, _: F.when(
        F.get(ends, middle(s) - 1) < end, F.struct((middle(s) + 1).alias("low"), s["high"].alias("high"))
    ).otherwise(F.struct(s["low"].alias("low"), middle(s).alias("high")))
    whole = F.struct(F.lit(1).alias("low"), F.size(ends).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ends).cast("double"))).cast("int"))
    return F.when(F.size(ends) <= 64, F.array_position(ends, end).cast("int")).otherwise(F.aggregate(steps, whole, halve, lambda s: s["low"]))


def groups(run: Column) -> Column:
    """A run's ids in groups (a, b), cut where tokens of both end."""
    common = F.array_intersect(run["a_ends"], run["b_ends"])
    places = F.transform(common, lambda e: F.struct(place(run["a_ends"], e).alias("a"), place(run["b_ends"], e).alias("b")))

    def cut(at: Column) -> Column:
        begun = lambda i, side: F.coalesce(F.get(at, i - 1)[side], F.lit(0))
        span = lambda p, i, side: F.transform(F.sequence(begun(i, side), p[side] - 1), lambda k: F.get(run[side], k))
        ids = lambda p, i, side: F.when(p[side] == begun(i, side) + 1, F.array(F.get(run[side], p[side] - 1))).otherwise(span(p, i, side))
        return F.transform(at, lambda p, i: F.struct(ids(p, i, "a").alias("a"), ids(p, i, "b").alias("b")))

    # the last ends are common, so a token that is alone on its side makes a group of the run
    whole = F.array(F.struct(run["a"].alias("a"), run["b"].alias("b")))
    return F.when((F.size(run["a"]) == 1) | (F.size(run["b"]) == 1), whole).otherwise(let(places, cut))


def written(group: Column) -> Column:
    ids = lambda side: F.when(F.size(group[side]) == 1, F.get(group[side], F.lit(0)).cast("string")).otherwise(F.array_join(group[side].cast("array<string>"), ","))
    return F.concat(ids("a"), F.lit("|"), ids("b"))


def link(x: Column, y: Column) -> Column:
    """Two ids as one number."""
    return F.call_function("shiftleft", x.cast("long"), F.lit(32)).bitwiseOR(y.cast("long"))


def links(group: Column) -> Column:
    """Each id of one side with each of the other."""
    one = (F.size(group["a"]) == 1) & (F.size(group["b"]) == 1)
    each = F.flatten(F.transform(group["a"], lambda x: F.transform(group["b"], lambda y: link(x, y))))
    return F.when(one, F.array(link(F.get(group["a"], F.lit(0)), F.get(group["b"], F.lit(0))))).otherwise(each)


def known_run(run: Column) -> Column:
    """A run's groups, written, and its links. With equal ends each token of one side makes a group with that of the other."""
    pair = lambda x, y: F.concat(x.cast("string"), F.lit("|"), y.cast("string"))
    paired = F.struct(F.array_join(F.zip_with(run["a"], run["b"], pair), ";").alias("groups"), F.zip_with(run["a"], run["b"], link).alias("links"))
    made = lambda g: F.struct(F.array_join(F.transform(g, written), ";").alias("groups"), F.flatten(F.transform(g, links)).alias("links"))
    return F.when(run["a_ends"] == run["b_ends"], paired).otherwise(let(groups(run), made))


def alignments(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None, written_out: bool = False) -> DataFrame:
    """The columns `keep` (all by default), n_a, n_b, n_groups, n_links, groups_sha256 and `links`: every pair of a text's ids that share a
    group, as often as they do, each as one number (see ids_of()); with written_out=True also `groups` as written.

    The first vocabulary (byte-level, a .json file) takes a blank and the text, the second (a .model file) adds that blank itself;
    neither adds special tokens. A null or empty text, or one whose bytes one of them does not give back, has no tokens: zeros,
    groups_sha256 '' and no links. Kept columns with a result's name give way.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in RESULTS]
    blocks = tokenised(df, path_a, path_b, text, keep)

    def text_row(row: Column, runs: Column) -> Column:
        own = lambda name: F.transform(row["codes"], lambda c: F.get(runs, c)[name])
        kept = [row[c].alias(c) for c in (*[f"k{i}" for i in range(len(keep))], "n_a", "n_b")]
        return F.struct(*kept, F.array_join(own("groups"), ";").alias("groups"), F.flatten(own("links")).alias("links"))

    out = blocks.select(F.explode(let(F.transform("runs", known_run), lambda runs: F.transform("rows", lambda row: text_row(row, runs)))).alias("r"))
    has_any = F.col("r.groups") != ""
    digest = F.when(has_any, F.sha2(F.col("r.groups").cast("binary"), 256)).otherwise("")
    n_groups = F.when(has_any, 1 + F.length("r.groups") - F.length(F.replace("r.groups", F.lit(";"), F.lit("")))).otherwise(0)
    return out.select(
        *[F.col(f"r.k{i}").alias(c) for i, c in enumerate(keep)], "r.n_a", "r.n_b", n_groups.cast("long").alias("n_groups"),
        F.size("r.links").cast("long").alias("n_links"), digest.alias("groups_sha256"), "r.links", *(["r.groups"] if written_out else []),
    )


def ids_of(link: Column | str) -> tuple[Column, Column]:
    """The two ids of a link."""
    link = F.col(link) if isinstance(link, str) else link
    return F.call_function("shiftright", link, F.lit(32)).cast("int"), link.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(link, n, best): in how many texts each pair of ids is linked, and whether no pair of its first id is linked in more.

    Pairs are counted before they are shuffled; an id's pairs are at most as many as the other vocabulary has ids.
    """
    pairs = aligned.select(F.explode(F.array_distinct("links")).alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(ids_of("link")[0])))


def scored_alignments(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """alignments() with n_best (links whose pair is the commonest of its first id, ties included) and count_sum (over links, in
    how many texts the pair is linked) instead of the links.

    The `most_broadcast` most frequent pairs meet the texts' links by a broadcast, so that no frequent key is shuffled; all
    others by a join.
    """
    aligned = alignments(df, path_a, path_b, text, keep)
    number = fresh(aligned, "_row")
    with with_batches_of(df.sparkSession, ROWS):
        aligned = settled(aligned.withColumn(number, F.monotonically_increasing_id()))
    counts = settled(pair_counts(aligned))
    if counts.count() <= most_broadcast:
        frequent, rare = counts, None
    else:
        frequent = settled(counts.orderBy(F.desc("n"), "link").limit(most_broadcast))
        rare = counts.join(F.broadcast(frequent.select("link")), "link", "left_anti")
    each = aligned.select(F.col(number).alias("row"), F.explode("links").alias("link"))
    sums = lambda x: x.groupBy("row").agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    found = sums(each.join(F.broadcast(frequent), "link"))
    if rare is not None:
        others = each.join(F.broadcast(frequent.select("link")), "link", "left_anti").join(rare, "link")
        found = found.unionAll(sums(others)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = aligned.drop("links").join(found, F.col(number) == F.col("row"), "left").drop(number, "row")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.withColumns({"n_best": zero("n_best"), "count_sum": zero("count_sum")})
