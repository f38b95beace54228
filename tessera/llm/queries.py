"""The operators as registered queries over the documents table, and their SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, byte_bpe, conversations, hilbert, licenses, media, mixing, quality, secrets_scan, simhash, suffix_dedup, token_count


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary_path(name: str) -> str:
    """Where the executors have a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, at weights 1, 2, 3 by source and 3 repeats at most."""
    placed, mix = mixing.mixture(documents(spark, sf_dir))
    whole = mixing.taken_words(placed, mix)
    return whole.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's bytes through a PNG file in a binary column, read back; tail_crc32 is that of the last 32 bytes."""
    stored = media.store_bytes(documents(spark, sf_dir), keep=["doc_id"])
    return media.read_media(stored, keep=["doc_id", "n_bytes"], tail=32)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_quality(documents(spark, sf_dir), keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir), keep=["doc_id"]).drop("notices")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_classes(documents(spark, sf_dir), words_each=3, bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(documents(spark, sf_dir), vocabulary_path("word_bpe_49k.json"), keep=["doc_id"])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    base = [r.kind for r in secrets_scan.BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secrets_scan.span_list("spans", tuple(base)).cast("binary"), 256).alias("base_sha256"),
        secrets_scan.span_list("spans").alias("spans"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), length=400, keep=["doc_id"])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.hilbert_shards(documents(spark, sf_dir), shards=16)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "curve")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"), keep=["doc_id"])


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode_ranks(documents(spark, sf_dir), vocabulary_path("byte_bpe_multi_50k.tiktoken"), keep=["doc_id"])


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
    return alignment.scored_alignments(documents(spark, sf_dir), *paths, keep=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_media, op3_quality, op4_licenses, op5_simhash, op6_token_counts, op7_secrets, op8_suffix_dedup, op9_sharding, op10_bpe, op11_byte_bpe, op12_conversations, op13_alignment)
}

QUALITY_SQL = r"""with d as (select doc_id, coalesce(text, '') text from documents),
  l as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') ws from d), w as (select doc_id, unnest(ws) w, unnest(range(len(ws))) i from l),
  grams as (select doc_id, n, i, g from (select doc_id, n, i, array_to_string(list(w) over (partition by doc_id, n order by i rows between current row and n - 1 following), ' ') g,
    count(*) over (partition by doc_id, n) - i left_ from w, (select unnest(range(5, 11)) n) ns) x where left_ >= n),
  flags as (select doc_id, n, i, count(*) over (partition by doc_id, n, g) > 1 other, row_number() over (partition by doc_id, n, g order by i) > 1 later from grams),
  cov as (select w.doc_id, n, length(w) c, bool_or(other) over (partition by w.doc_id, n order by w.i rows between n - 1 preceding and current row) other, bool_or(later) over (partition by w.doc_id, n order by w.i rows between n - 1 preceding and current row) later
    from (select doc_id, w, i, n from w, (select unnest(range(5, 11)) n) ns) w left join flags using (doc_id, n, i)),
  shares as (select doc_id, count(*) filter (n = 5 and other) rep, bool_or(over_) over_ from (select doc_id, n, other, 100 * (sum(case when later then c else 0 end) over (partition by doc_id, n)) > (20 - n) * sum(c) over (partition by doc_id, n) over_ from cov) y group by doc_id),
  lines as (select doc_id, line, row_number() over (partition by doc_id, line order by k) > 1 dup from (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) k from d) x where regexp_matches(line, '[^\x20\x09-\x0D]')),
  dl as (select doc_id, count(*) filter (dup) n_dup, coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) filter (dup), 0) dup_chars from lines group by doc_id),
  b as (select doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(n_dup, 0) n_dup_lines, coalesce(dup_chars, 0) dup_chars, coalesce(rep, 0) n_repeat_words, coalesce(over_, false) over_
    from l join d using (doc_id) left join dl using (doc_id) left join shares using (doc_id)),
  v as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from b)
  select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and not over_ and 100 * dup_chars <= 20 * word_chars kept from v"""


def _secrets_sql() -> str:
    kinds = []
    for i, r in enumerate(secrets_scan.BASE + secrets_scan.MORE):
        pattern = r.regex.replace("'", "''")
        kinds.append(
            f"select doc_id, {i} number, '{r.kind}' kind, {r.least} least, regexp_extract_all(text, '{pattern}', 0) m, regexp_extract_all(text, '{pattern}', {r.group}) s, string_split_regex(text, '{pattern}') g from d"
        )
    return (
        "with d as (select doc_id, coalesce(text, '') as text from documents), k as (" + " union all ".join(kinds) + "),\n"
        "  u as (select doc_id, number, kind, least, unnest(m) m, unnest(s) s, unnest(g[1:len(m)]) g, unnest(range(len(m))) i from k where len(m) > 0),\n"
        "  p as (select *, sum(length(g) + length(m)) over (partition by doc_id, number order by i) stop from u),\n"
        "  x as (select doc_id, number, kind, cast(stop - length(m) as bigint) start, kind || ':' || cast(stop - length(m) as bigint) || ':' || cast(stop as bigint) t from p where length(s) >= least),\n"
        "  a as (select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,\n"
        "    string_agg(t, ',' order by start, number) filter (number < 3) base, string_agg(t, ',' order by start, number) spans from x group by doc_id)\n"
        "  select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join a using (doc_id)"
    )


#: Fingerprints' hash, fuzzy matching, merges, images, curves and shuffles by hash are not SQL's; those queries are tested against brute force.
ORACLES: dict[str, str] = {"op3_quality": QUALITY_SQL, "op7_secrets": _secrets_sql()}
