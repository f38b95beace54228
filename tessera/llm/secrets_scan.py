"""Secret scans by a trigram index, in DataFrame expressions alone.

From each rule's regex follows a Boolean query over trigrams that every match must contain. Texts are numbered, and the
index has, for each trigram that some query names, the numbers of the texts that hold it, 64 to a word of bits. A query is
answered by intersecting (for "and") and uniting (for "or") its postings, word by word; only texts in an answer are
verified with the regexes. A rule without mandatory trigrams scans all texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, maybe_in

#: A query: True (anything), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: the group whose length counts, and the least length, of a match that stands
    group: int = 0
    least: int = 0


#: The kinds that every scan has.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # as [0-9a-f]+ of 16 and more characters
)
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def both(*queries: Query) -> Query:
    parts = [q for q in queries if q is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(*queries: Query) -> Query:
    return True if any(q is True for q in queries) or not queries else queries[0] if len(queries) == 1 else ("or", tuple(queries))


def of_strings(strings: set[str]) -> Query:
    """What a text holds that has one of these strings."""
    return either(*[both(*dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)])


def trigram_query(pattern: str, most: int = 40) -> Query:
    """The Boolean trigram query, over lower-cased text, that a match of the regex implies.

    Parts that stand for a few strings are strung together, and give the trigrams of all strings they make;
    any other part (wide classes, open repetitions) ends such a run.
    """

    def exact(item) -> set[str] | None:
        kind, value = item
        if kind is C.LITERAL:
            return {chr(value).lower()} if len(chr(value).lower()) == 1 else None
        if kind is C.IN:
            if not all(k is C.LITERAL or (k is C.RANGE and v[1] - v[0] < 6) for k, v in value):
                return None
            chars = {chr(c).lower() for k, v in value for c in ([v] if k is C.LITERAL else range(v[0], v[1] + 1))}
            return chars if len(chars) <= 6 else None
        if kind is C.SUBPATTERN:
            return strung(value[3])
        if kind is C.BRANCH:
            options = [strung(b) for b in value[1]]
            return None if any(o is None for o in options) else set().union(*options)
        if kind is C.MAX_REPEAT:
            low, high, inner = value
            once = strung(inner)
            if once is None or high is C.MAXREPEAT or high > 3:
                return None
            out, power = set() if low else {""}, {""}
            for n in range(1, high + 1):
                power = {a + b for a in power for b in once}
                if n >= low:
                    out |= power
                if len(out | power) > most:
                    return None
            return out
        return {""} if kind is C.AT else None

    def strung(items) -> set[str] | None:
        made = {""}
        for item in items:
            one = exact(item)
            if one is None or len(made) * len(one) > most:
                return None
            made = {a + b for a in made for b in one}
        return made

    def implied(item) -> Query:
        """What a part that isn't a few strings implies by itself."""
        kind, value = item
        if kind is C.SUBPATTERN:
            return query(value[3])
        if kind is C.BRANCH:
            return either(*[query(b) for b in value[1]])
        if kind is C.MAX_REPEAT and value[0] > 0:
            return query(value[2])
        return True

    def query(items) -> Query:
        parts, run = [], {""}
        for item in items:
            one = exact(item)
            if one is None:
                parts += [of_strings(run), implied(item)]
                run = {""}
            elif len(run) * len(one) > most:
                parts.append(of_strings(run))
                run = {a[-2:] + b for a in {r[-2:] for r in run} for b in one}
                if len(run) > most:
                    run = {""}
            else:
                run = {a + b for a in run for b in one}
        return both(*parts, of_strings(run))

    return query(list(parser.parse(pattern)))


def trigrams(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(trigrams, query[1]))


def trigram_index(df: DataFrame, vocabulary: set[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Numbered texts (text_hash, number) that hold any of the vocabulary's trigrams, and postings (node, word, bits): for each
    trigram, the texts of number 64 * word to 64 * word + 63 that hold it, in lower case, as bits."""
    lowered = df.select(F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_hash"), F.lower(F.col(f"`{text}`").cast("string")).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in sorted(vocabulary)]))
    # the checkpoint fixes the numbers; a filter before it would look for all trigrams twice
    held = materialize(lowered.select("text_hash", present.alias("present"), F.monotonically_increasing_id().alias("number")))
    spread = held.select(F.explode("present").alias("node"), *_place(F.col("number")))
    postings = spread.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
    return held.select("text_hash", "number"), materialize(postings)


def _place(number: Column) -> list[Column]:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))
    return [F.call_function("shiftright", number, F.lit(6)).alias("word"), bit.alias("bits")]


def nodes(queries: list[Query]) -> list[list[tuple[str, str, str, int]]]:
    """The queries' inner nodes by height, as rows (child, parent, "and" | "or", number of children); a node is named by its text."""
    levels: dict[int, set[tuple[str, str, str, int]]] = {}

    def height(query: Query) -> int:
        if isinstance(query, str):
            return 0
        parts = set(query[1])
        own = 1 + max(map(height, parts))
        levels.setdefault(own, set()).update((name(p), name(query), query[0], len(parts)) for p in parts)
        return own

    for q in queries:
        height(q)
    return [sorted(levels[h]) for h in sorted(levels)]


def name(query: Query) -> str:
    """A trigram is its own name."""
    return query if isinstance(query, str) else f"{query[0]}({','.join(sorted(set(map(name, query[1]))))})"


def answers(postings: DataFrame, queries: list[Query]) -> DataFrame:
    """(node, word, bits) of all the queries' nodes: from the trigrams' postings up, those of an "and" intersected, of an "or" united."""
    spark, known = postings.sparkSession, postings
    for level in nodes(queries):
        quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        rows = ", ".join(f"({quoted(c)}, {quoted(p)}, '{op}', {n})" for c, p, op, n in level)
        steps = spark.sql(f"select * from values {rows} as t(node, parent, op, n)")
        met = known.join(F.broadcast(steps), "node").groupBy("parent", "word", "op", "n")
        met = met.agg(F.bit_and("bits").alias("all"), F.bit_or("bits").alias("any"), F.count("*").alias("met"))
        bits = F.when(F.col("op") == "or", F.col("any")).when(F.col("met") == F.col("n"), F.col("all")).otherwise(F.lit(0).cast("long"))
        known = known.unionAll(met.select(F.col("parent").alias("node"), "word", bits.alias("bits")).filter("bits <> 0"))
    return known


def candidates(numbered: DataFrame, postings: DataFrame, queries: list[Query]) -> DataFrame:
    """(text_hash) of the texts in any query's answer."""
    roots = answers(postings, queries).filter(F.col("node").isin(*map(name, queries)))
    hits = roots.groupBy("word").agg(F.bit_or("bits").alias("hits"))
    return numbered.select("text_hash", *_place(F.col("number"))).join(hits, "word").filter(F.col("hits").bitwiseAND(F.col("bits")) != 0).select("text_hash")


def _scan(array: str, size: str, op: str) -> str:
    """SQL for the prefix sums (op x + y) or maxima of an array, by doubling: each round takes in the value 2^k before."""
    step = f"transform(a, (x, i) -> if(i >= shiftleft(1, k), {op.format(y='a[i - shiftleft(1, k)]')}, x))"
    return f"if({size} < 2, {array}, aggregate(sequence(0, cast(ceil(log2({size})) as int) - 1), {array}, (a, k) -> {step}))"


def _spans(rule: Rule, number: int, text: str, matches: str, groups: str) -> str:
    """SQL for the array of a rule's spans: a match ends where it and all matches and gaps before it do."""
    regex = rule.regex.replace("\\", "\\\\").replace("'", "\\'")
    empty = "cast(array() as array<struct<start:int,number:int,end:int,kind:string>>)"
    lengths = f"transform({matches}, (m, i) -> length(m) + length(gaps[i]))"
    ends = _scan(lengths, f"size({matches})", "x + {y}")
    stands = f"filter(sequence(0, size({matches}) - 1), i -> length({groups}[i]) >= {rule.least})"
    made = f"transform({stands}, i -> named_struct('start', ends[i] - length({matches}[i]), 'number', {number}, 'end', ends[i], 'kind', '{rule.kind}'))"
    # lambdas over one element bind the gaps and the ends, so that each is made once
    bound = f"flatten(transform(array(split({text}, '{regex}', -1)), gaps -> flatten(transform(array({ends}), ends -> {made}))))"
    return f"if(size({matches}) = 0, {empty}, {bound})"


def find_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, to: str = "spans") -> DataFrame:
    """Append the array `to` of (start, number, end, kind): leftmost matches of each rule that do not overlap, in code points.

    Sorted by start, then the rule's number. Matches below their rule's length are dropped after matching, as they use up
    their characters. A null text is empty and has none. Rows stay one to one, repeated rows too; an empty table gives none.
    Candidates are told by bitmaps of bounded size, so that no text is shuffled. Positions come from prefix sums
    in about m log m steps for m matches of a text.
    """
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("rules must have distinct kinds")
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = tuple(r for r in rules if queries[r.kind] is not True)
    names = {k: fresh(df, k) for k in ("secret_text", "secret_maybe", "secret_hash")}
    t, maybe = F.col(names["secret_text"]), F.col(names["secret_maybe"])
    whole = df.withColumn(names["secret_text"], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    if indexed:
        asked = [queries[r.kind] for r in indexed]
        numbered, postings = trigram_index(df, set().union(*map(trigrams, asked)), text)
        found = materialize(candidates(numbered, postings, asked).select(F.col("text_hash").alias(names["secret_hash"])))
        whole = whole.withColumn(names["secret_hash"], F.xxhash64(F.col(f"`{text}`").cast("string")))
        whole = maybe_in(whole, names["secret_hash"], found, names["secret_maybe"]).drop(names["secret_hash"])
    else:
        whole = whole.withColumn(names["secret_maybe"], F.lit(False))
    none = F.array().cast("array<string>")
    made = []
    for i, r in enumerate(rules):
        m, g = fresh(df, f"secret_m{i}"), fresh(df, f"secret_g{i}")
        all_of = lambda group, r=r: F.regexp_extract_all(t, F.lit(r.regex), F.lit(group))
        for column, group in ((m, 0), (g, r.group)):
            if column == m or r.group:
                whole = whole.withColumn(column, all_of(group) if queries[r.kind] is True else F.when(maybe, all_of(group)).otherwise(none))
        made.append((r, i, m, g if r.group else m))
    arrays = [F.expr(_spans(r, i, f"`{names['secret_text']}`", f"`{m}`", f"`{g}`")) for r, i, m, g in made]
    spans = F.array_sort(F.flatten(F.array(*arrays)))
    dropped = [names["secret_text"], names["secret_maybe"], *dict.fromkeys(x for _, _, m, g in made for x in (m, g))]
    return whole.withColumn(to, spans).drop(*dropped)


def span_list(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    chosen = F.col(spans) if kinds is None else F.filter(F.col(spans), lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = BASE + MORE, block: int = 1024) -> DataFrame:
    """The rows with each run of overlapping or touching spans in their texts replaced by `mark`; n_chars, if there, follows.

    Runs begin where a span starts beyond the farthest end before it. What stays is cut out of blocks of the text, so that
    a place far inside a long text is not sought from its beginning each time.
    """
    spans = fresh(df, "secret_spans")
    found = find_secrets(df, text, rules, spans)
    source, every = f"`{text}`", f"`{spans}`"
    farthest = _scan(f"transform({every}, s -> s.end)", f"size({every})", "greatest(x, {y})")
    begins = f"filter(sequence(0, size({every}) - 1), i -> i = 0 or {every}[i].start > far[if(i = 0, 0, i - 1)])"
    starts = f"transform({begins}, i -> {every}[i].start)"
    ends = f"concat(transform(filter({begins}, i -> i > 0), i -> far[i - 1]), array(element_at(far, -1)))"
    cut = f"substring(blocks[b], greatest(x.lo - b * {block}, 0) + 1, least(x.hi - b * {block}, {block}) - greatest(x.lo - b * {block}, 0))"
    touched = f"transform(sequence(x.lo div {block}, (x.hi - 1) div {block}), b -> cast(b as int))"
    piece = f"if(x.hi <= x.lo, '', array_join(transform({touched}, b -> {cut}), ''))"
    bounds = "named_struct('lo', if(r = 0, 0, run.ends[if(r = 0, 0, r - 1)]), 'hi', if(r = size(run.starts), n, run.starts[if(r = size(run.starts), 0, r)]))"
    joined = f"array_join(transform(transform(sequence(0, size(run.starts)), r -> {bounds}), x -> {piece}), mark)"
    escaped = mark.replace("\\", "\\\\").replace("'", "\\'")
    one = lambda value, variable, inner: f"transform(array({value}), {variable} -> {inner})[0]"
    runs = one(farthest, "far", f"named_struct('starts', {starts}, 'ends', {ends})")
    whole = one(runs, "run", one(f"regexp_extract_all({source}, '(?s).{{1,{block}}}', 0)", "blocks", one(f"length({source})", "n", one(f"'{escaped}'", "mark", joined))))
    out = found.withColumn(text, F.expr(f"if(size({every}) = 0, {source}, {whole})"))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) == 0, F.col("n_chars")).otherwise(F.length(F.col(source))).cast(df.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
