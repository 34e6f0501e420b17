"""Dictionary match: which terms occur in a text as whole words.

A term matches when its neighbours are not ASCII letters or digits (``_``, ``-``
and non-ASCII letters are boundaries).

Two forms with equal results:

* :class:`TermPattern` compiles a small dictionary into one regular expression.
  Matching is a map-only projection: the text is read once and never shuffled.
* :func:`keyword_hits` joins a dictionary of any size.  Only texts as long as a term that begins with
  the same word travel, never the whole text.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = "a-z0-9"
BUCKETS = 256
SMALL = 200_000  # rows of a dictionary that is sent to every executor, at most


def _is_word(ch: str) -> bool:
    return ch.isascii() and ch.isalnum()


def _alternation(terms: list[str]) -> str:
    """Terms as a prefix-sharing alternation that prefers the longest one."""
    tree: dict = {}
    for term in terms:
        node = tree
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [re.escape(ch) + render(child) for ch, child in sorted(node.items()) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else "(?:" + "|".join(branches) + ")"
        return body + "?" if "" in node else body

    return render(tree)


class TermPattern:
    """A small dictionary compiled for map-only matching."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.terms = sorted({t.lower() for t in terms})
        if not self.terms:
            raise ValueError("no terms")
        by_length = sorted(self.terms, key=len, reverse=True)
        # The longest term at a position decides which shorter ones start there too.
        self._implied = {
            long: [t for t in by_length if long.startswith(t) and (len(t) == len(long) or not _is_word(long[len(t)]))]
            for long in self.terms
        }
        self.pattern = f"(?<![{_WORD}])(?=({_alternation(self.terms)})(?![{_WORD}]))"

    def positions(self, text: Column) -> Column:
        """Longest term at every matching position, in text order, as array<string>."""
        return F.regexp_extract_all(F.lower(text), F.lit(self.pattern), F.lit(1))

    def payload_rows(self, payload: dict[str, list], element: str) -> Callable[[Column], Column]:
        """From the longest term to the payload rows of every term it implies.

        A map is searched from its first key on, so the terms are dealt to ``BUCKETS`` small maps by their checksum.
        """
        tables: list[dict] = [{} for _ in range(BUCKETS)]
        for long, shorter in self._implied.items():
            rows = [row for t in shorter for row in payload.get(t, [])]
            if rows:
                tables[zlib.crc32(long.encode()) % BUCKETS][long] = rows
        table = F.from_json(F.lit(json.dumps(tables)), f"array<map<string,array<{element}>>>")
        empty = F.array().cast(f"array<{element}>")
        return lambda t: F.coalesce(F.try_element_at(F.get(table, (F.crc32(t) % BUCKETS).cast("int")), t), empty)

    def expand(self, positions: Column, payload: dict[str, list], element: str) -> Column:
        """Payload rows of all terms found, in text order."""
        return F.flatten(F.transform(positions, self.payload_rows(payload, element)))

    def matched(self, text: Column) -> Column:
        """Distinct terms that occur in the text."""
        return F.array_distinct(self.expand(self.positions(text), {t: [t] for t in self.terms}, "string"))


def keyword_hits(df: DataFrame, id_col: str, text_col: str, dictionary: DataFrame, term_col: str = "term", small: int = SMALL) -> DataFrame:
    """Join texts with a dictionary of any size.

    Returns ``id_col``, all dictionary columns, ``n`` (occurrences) and ``first_at``
    (word number of the first one).  Terms must start with an ASCII letter or digit; others
    raise when the plan runs.

    A word asks the table of first words for the lengths of the terms that begin with it; only texts of these
    lengths that end at a word's end travel on, and they meet the terms by equality.  So a word that begins no term
    goes no further, and one that begins many terms is sent once per length.  A dictionary of up to ``small`` counted rows
    and the table of its first words are broadcast; beyond that both are shuffled joins.
    """
    first_word = F.regexp_extract(F.lower(term_col), f"\\A[{_WORD}]+", 0)
    longest, n_terms = dictionary.agg(F.coalesce(F.max(F.char_length(F.lower(term_col))), F.lit(1)), F.count("*")).first()
    sent = F.broadcast if n_terms <= small else lambda rows: rows
    ok = F.rlike(F.lower(term_col), F.lit(f"\\A[{_WORD}]"))
    terms = dictionary.withColumn(
        "_term", F.when(ok, F.lower(term_col)).otherwise(F.raise_error(F.concat(F.lit("bad term: "), F.col(term_col))))
    )
    # The lengths of one first word are at most as many as the longest term has characters.
    lengths = dictionary.groupBy(first_word.alias("_key")).agg(F.collect_set(F.char_length(F.lower(term_col))).alias("_lengths"))
    window = f"(?s)(?<![{_WORD}])(?=([{_WORD}].{{0,{longest}}}))"
    words = (
        df.select(id_col, F.posexplode(F.regexp_extract_all(F.lower(text_col), F.lit(window), F.lit(1))).alias("_at", "_window"))
        .withColumn("_key", F.regexp_extract("_window", f"\\A[{_WORD}]+", 0))
    )
    asked = words.join(sent(lengths), "_key").select(id_col, "_at", "_window", F.explode("_lengths").alias("_length"))
    ends = ~F.rlike(F.substr("_window", F.col("_length") + 1, F.lit(1)), F.lit(f"[{_WORD}]"))
    candidates = asked.filter(ends & (F.char_length("_window") >= F.col("_length"))).select(
        id_col, "_at", F.substr("_window", F.lit(1), F.col("_length")).alias("_term")
    )
    hits = candidates.join(sent(terms), "_term")
    return hits.groupBy(id_col, *dictionary.columns).agg(F.count("*").alias("n"), F.min("_at").alias("first_at"))
