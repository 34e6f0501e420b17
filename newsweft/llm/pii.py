"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Base spans come from four patterns (email, ip, card, phone), leftmost and non-overlapping for each kind;
matches that fail the kind's test (parts up to 255, Luhn, digit counts) are dropped.

The bootstrap finds identifiers that no pattern describes:

* seeds are the base spans; candidates are other tokens with a digit in them, of any length;
* the lexical patterns of an identifier are the word in front of it, the two words in front of it and the word behind it,
  lower-cased, without signs at their ends, as far as they lie between it and the next identifier or candidate;
* the pattern-instance graph has an edge for each (pattern, identifier) that occurs. A pattern's confidence is the share of
  its words' occurrences in all texts, with or without an identifier in them, that are beside a trusted
  identifier; patterns of ``MIN_CONFIDENCE`` with ``MIN_SUPPORT`` or more distinct trusted identifiers are accepted,
  and a candidate is trusted once 1 - prod(1 - confidence) over its accepted patterns reaches ``MIN_SCORE``;
* patterns and identifiers only grow from round to round; the rounds end when no identifier is added. Then candidates beside an
  accepted pattern become spans of kind ``context``.

Positions are code points, ends exclusive.  Only DataFrame functions are used.  A text's spans are placed by running sums over
blocks of their square root, and long texts are cut in blocks, so no step is quadratic in a text.  Defined results: a null text is
empty and has no spans; a null id takes part like any other; repeated rows get equal spans; empty
tables give empty results; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions.binding import let
from newsweft.llm.common import cut_lineage, set_aside

# A run is entered at its first character or where the last match ended: every other start in it ends alike.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]

OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$"
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
ONE_BEFORE = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+\z"
TWO_BEFORE = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+\z"
ONE_BEHIND = r"\A[^\p{L}\p{N}]*+([^\x20\x09-\x0D]++)"
EDGE = r"\A[^\p{L}\p{N}]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++\z"
BLOCK = 4096  # code points of a text that a cut looks through
MIN_CONFIDENCE = 0.5
MIN_SUPPORT = 3
MIN_SCORE = 0.5
SMALL = 1_000_000  # rows of a word or two that a join sends to every executor, at most
FAR = 2**31 - 1
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine`` makes of zero and all integers before each one; values are taken in blocks of the root of their number."""
    empty = F.array().cast("array<int>")

    def through(some: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), empty.alias("out"))
        step = lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(some, first, step, lambda acc: acc["out"])

    def blocked(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda some: F.aggregate(some, F.lit(0), combine))
        return let(through(totals, F.lit(0)), lambda starts: F.flatten(F.transform(blocks, lambda some, i: through(some, F.get(starts, i)))))

    def sized(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda i: F.slice(v, i * size + 1, size))
        return F.when(F.size(v) == 0, empty).otherwise(let(blocks, blocked))

    return let(values, sized)


def _clean(word: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(word, EDGE, "")), F.lit(""))


def _patterns(before: Column, behind: Column) -> Column:
    """Lexical patterns of an identifier between two pieces of text."""
    first, second = (_clean(F.regexp_extract(before, TWO_BEFORE, n)) for n in (1, 2))
    every = F.array(
        F.concat(F.lit("< "), _clean(F.regexp_extract(before, ONE_BEFORE, 1))), F.concat(F.lit("<< "), first, F.lit(" "), second), F.concat(F.lit("> "), _clean(F.regexp_extract(behind, ONE_BEHIND, 1)))
    )
    return F.filter(every, lambda p: p.isNotNull())


def _located(text: Column, pattern: str, kind: str, worth: Column, patterns: bool = False) -> Column:
    """Spans of all matches: lengths of the pieces between matches and of the matches add up to positions."""
    shape = SPAN.replace("value:string", "value:string,patterns:array<string>") if patterns else SPAN

    def walk(both: Column) -> Column:
        piece = lambda i: F.get(both["pieces"], i)
        steps = F.transform(both["found"], lambda v, i: F.length(piece(i)) + F.length(v))

        def span(v: Column, i: Column, starts: Column) -> Column:
            start = F.get(starts, i) + F.length(piece(i))
            more = [_patterns(piece(i), piece(i + 1)).alias("patterns")] if patterns else []
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"), *more)

        return let(_running(steps, lambda x, y: x + y), lambda starts: F.transform(both["found"], lambda v, i: span(v, i, starts)))

    found = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    spans = F.when(worth, let(found, walk)).otherwise(F.array().cast(shape))
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _marked(documents: DataFrame, patterns: bool) -> DataFrame:
    """The input columns, ``base`` (spans by kind as listed, then start) and ``digit``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.withColumns({"digit": text.rlike("[0-9]"), "at_sign": F.instr(text, "@") > 0, "plus": F.instr(text, "+") > 0})
    base = F.concat(
        _located(text, EMAIL, "email", F.col("at_sign"), patterns),
        _located(text, IP, "ip", F.col("digit"), patterns),
        _located(text, CARD, "card", F.col("digit"), patterns),
        _located(text, PHONE, "phone", F.col("plus") & F.col("digit"), patterns),
    )
    return rows.select(*documents.columns, base.alias("base"), "digit")


def _apart(spans: Column, base: Column) -> Column:
    """The spans (by start) that overlap none of ``base``: both are merged by start and compared with the furthest end so far and the next base start."""
    both = F.sort_array(
        F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(-1).alias("i"), b["end"].alias("end"))),
            F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"))),
        )
    )

    def kept(all_: Column) -> Column:
        ends = F.transform(all_, lambda s: F.when(s["i"] < 0, s["end"]).otherwise(F.lit(0)))
        # seen from the end, the nearest base start ahead; starts are turned round so that the greatest is the nearest
        ahead = F.reverse(F.transform(all_, lambda s: F.when(s["i"] < 0, F.lit(FAR) - s["start"]).otherwise(F.lit(0))))
        most = lambda x, y: F.greatest(x, y)
        size = F.size(all_)
        numbers = lambda past, next_: F.transform(
            F.filter(F.transform(all_, lambda s, j: F.struct(s["i"].alias("i"), ((F.get(past, j) <= s["start"]) & (F.lit(FAR) - F.get(next_, size - 1 - j) >= s["end"])).alias("free"))), lambda s: (s["i"] >= 0) & s["free"]),
            lambda s: s["i"],
        )
        return let(_running(ends, most), lambda past: let(_running(ahead, most), lambda next_: F.transform(numbers(past, next_), lambda i: F.get(spans, i))))

    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(let(both, kept))


def find(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables by row key (doc_id, row_hash): base spans, and context spans of rows that have some.

    Rows without any span are in the first table with an empty array.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = _marked(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), True).withColumn("row_hash", F.xxhash64("text"))
    other = _located(F.col("text"), CANDIDATE, "context", F.col("digit"), True)
    held = marked.withColumn("every", other).withColumn("other", _apart(F.col("every"), F.col("base")))
    # the words of every text, and its pairs of neighbours; a word in front and a word behind have the same count
    words = F.transform(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), _clean)
    grams = lambda w: F.concat(w, F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))
    rows = cut_lineage(held.select("doc_id", "row_hash", "base", "other"))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    base = rows.select("doc_id", "row_hash", plain(F.col("base")).alias("base"))
    seen = rows.select("doc_id", "row_hash", F.explode(F.concat("base", "other")).alias("s")).select("doc_id", "row_hash", "s.*")
    seen = seen.select("doc_id", "row_hash", "kind", "start", "end", "value", F.explode("patterns").alias("cue"))
    edges = cut_lineage(seen.groupBy("cue", "value").agg(F.count("*").alias("n"), F.max((F.col("kind") != "context").cast("int")).alias("seed")))
    # a pattern that fewer identifiers have than the support asks can never be accepted
    likely = edges.groupBy("cue").agg(F.count("*").alias("support")).filter(F.col("support") >= MIN_SUPPORT)
    likely = cut_lineage(likely.select("cue", F.substr("cue", F.instr("cue", " ") + 1).alias("gram")))
    every = documents.select(text.alias("text")).select(F.explode(let(words, grams)).alias("gram")).filter("gram is not null")
    if likely.count() <= SMALL:  # so few are sent to the texts, and no other word is shuffled
        every = every.join(F.broadcast(likely.select("gram").distinct()), "gram", "left_semi")
    totals = cut_lineage(every.groupBy("gram").agg(F.count("*").alias("total")).join(likely, "gram").select("cue", "total"))
    trusted = edges.filter("seed = 1").select("value").distinct()
    number, accepted = -1, None
    while True:
        trusted = cut_lineage(trusted)
        before, number = number, trusted.count()
        if number == before:
            break
        accepted = cut_lineage(_accepted(edges, totals, trusted))
        score = 1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(1 - 1e-9)))))
        believed = edges.join(accepted, "cue").groupBy("value").agg(score.alias("score")).filter(F.col("score") >= MIN_SCORE).select("value")
        trusted = trusted.union(believed).distinct()
    extra = (
        seen.filter("kind = 'context'")
        .join(accepted.select("cue"), "cue", "left_semi")
        .groupBy("doc_id", "row_hash")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end", "value"))).alias("spans"))
        .select("doc_id", "row_hash", F.transform("spans", lambda s: F.struct(F.lit("context").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias("extra"))
    )
    return base, cut_lineage(extra)


def _accepted(edges: DataFrame, totals: DataFrame, trusted: DataFrame) -> DataFrame:
    """(cue, confidence) of the cues that trusted identifiers follow often enough."""
    return (
        edges.join(trusted, "value", "left_semi")
        .groupBy("cue")
        .agg(F.sum("n").alias("hits"), F.count("*").alias("support"))
        .filter(F.col("support") >= MIN_SUPPORT)
        .join(totals, "cue")
        .select("cue", F.least(F.col("hits") / F.greatest("total", "hits"), F.lit(1.0)).alias("confidence"))
        .filter(F.col("confidence") >= MIN_CONFIDENCE)
    )


def spans(documents: DataFrame) -> DataFrame:
    """(doc_id, base, spans): one row per input row; ``spans`` are base and context spans together."""
    base, extra = find(documents)
    keys = extra.select(F.col("doc_id").alias("key_id"), F.col("row_hash").alias("key_hash"), "extra")
    joined = base.join(keys, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("row_hash") == F.col("key_hash")), "left")
    return joined.select("doc_id", "base", F.concat("base", F.coalesce("extra", F.array().cast(SPAN))).alias("spans"))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text given in blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
    return F.when(end > start, F.substr(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start - first * BLOCK + 1, end - start)).otherwise(F.lit(""))


def mask(documents: DataFrame) -> DataFrame:
    """``documents`` with every span replaced by its kind in brackets; overlapping spans become one."""
    documents, columns = set_aside(documents, "doc_id", "text")
    _, extra = find(documents)
    rows = _marked(documents.withColumn("row_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit("")))), False).drop("digit")
    keys = extra.select(F.col("doc_id").alias("key_id"), F.col("row_hash").alias("key_hash"), "extra").dropDuplicates(["key_id", "key_hash"])
    joined = rows.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("key_id")) & (F.col("row_hash") == F.col("key_hash")), "left")
    every = F.sort_array(
        F.transform(F.concat("base", F.coalesce("extra", F.array().cast(SPAN))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def masked(both: Column) -> Column:
        ends = F.transform(both["every"], lambda s: s["end"])
        piece = lambda s, at: F.when(s["start"] >= at, F.concat(_cut(both["blocks"], at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        pieces = let(_running(ends, lambda x, y: F.greatest(x, y)), lambda before: F.transform(both["every"], lambda s, i: piece(s, F.get(before, i))))
        return F.concat(F.array_join(pieces, ""), _cut(both["blocks"], F.array_max(ends), both["size"]))

    text = let(F.struct(F.col("every").alias("every"), blocks.alias("blocks"), F.length("text").alias("size")), masked)
    spans = joined.withColumn("every", every)
    replaced = F.when(F.size("every") > 0, text).otherwise(F.col("text"))
    return spans.select(*[replaced.alias(c) if c == "text" else F.col(c) for c in documents.columns]).select(*columns)
