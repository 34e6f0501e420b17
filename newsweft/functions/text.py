"""Text functions as column expressions (cleaning, tokens, tolls, social posts)."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweft.functions.binding import let
from newsweft.rules.vocabulary import STOP_WORDS, TOLL_WORDS

# Unicode white space; Java's \s alone is ASCII.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Named entities and the typographic quotes folded to ASCII.
ENTITIES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'",
    "&nbsp;": " ", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–",
    "&rsquo;": "'", "&#8217;": "'", "&lsquo;": "'", "&#8216;": "'",
    "&ldquo;": '"', "&#8220;": '"', "&rdquo;": '"', "&#8221;": '"',
}
_ENTITY = "&[^&;]{1,9};"


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def has_text(c: Column) -> Column:
    """True when there is a character besides white space; null for null."""
    return F.rlike(c, F.lit(f"[^{SPACE[1:-1]}]"))


def is_blank(c: Column) -> Column:
    """True for null, empty or white space only."""
    return ~F.coalesce(has_text(c), F.lit(False))


def non_blank(c: Column) -> Column:
    """The value, or null when it is blank."""
    return F.when(has_text(c), c)


def first_non_blank(*columns: Column) -> Column:
    """First candidate with a non-blank value."""
    return F.coalesce(*[non_blank(c) for c in columns])


def squeeze(c: Column) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def _code_point(c: Column) -> Column:
    legal = c.between(0, 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
    return F.when(legal, F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))


def _one_entity(e: Column) -> Column:
    named = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")
    hexa = F.regexp_extract(e, "^&#[xX]([0-9A-Fa-f]+);$", 1)
    deci = F.regexp_extract(e, "^&#([0-9]+);$", 1)
    return F.coalesce(
        F.try_element_at(named, e),
        F.when(hexa != "", _code_point(F.conv(hexa, 16, 10).cast("bigint"))),
        F.when(deci != "", _code_point(deci.cast("bigint"))),
        e,
    )


def decode_entities(c: Column) -> Column:
    """Decode HTML entities in one pass, so ``&amp;lt;`` becomes ``&lt;``; unknown ones stay."""


    def weave(v: Column) -> Column:
        found = F.transform(F.regexp_extract_all(v, F.lit(_ENTITY), F.lit(0)), _one_entity)
        pairs = F.arrays_zip(F.split(v, _ENTITY, -1).alias("p"), found.alias("e"))
        woven = F.array_join(F.transform(pairs, lambda x: F.concat(x["p"], F.coalesce(x["e"], F.lit("")))), "")
        return F.when(F.contains(v, F.lit("&")), woven).otherwise(v)

    return let(c, weave)


def clean_text(c: Column) -> Column:
    """Replace tags by blanks, decode entities, collapse white space."""
    closed = F.regexp_replace(c, r"<[^>]*>", " ")
    no_tail = F.regexp_replace(closed, r"<[^>]*\z", "")
    return squeeze(decode_entities(F.translate(no_tail, ">", " ")))


def cut_at_word(c: Column, limit: int) -> Column:
    """Keep at most ``limit`` characters, ending on a word, with an ellipsis when cut."""
    return let(
        c,
        lambda v: F.when(F.char_length(v) <= limit, v).otherwise(
            F.concat(F.regexp_replace(F.left(v, F.lit(limit)), r" [^ ]*\z", ""), F.lit("…"))
        ),
    )


def cut_plain(c: Column, limit: int) -> Column:
    """Keep ``limit - 1`` characters and an ellipsis when the text is longer than ``limit``."""
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(limit - 1)), F.lit("…")))


def short_title(c: Column, limit: int) -> Column:
    """Title for a narrow list: cut before ``limit`` characters, at a word."""
    t = strip(c)
    cut = F.regexp_replace(F.left(t, F.lit(limit - 1)), r" [^ ]*\z", "")
    return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(cut, F.lit("…")))


def tokenize(c: Column) -> Column:
    """Distinct significant words in order of first appearance."""
    raw = F.split(c, r"[^\p{IsAlphabetic}\p{N}]+")
    long_enough = F.filter(raw, lambda w: F.octet_length(w) >= 3)
    lowered = F.transform(long_enough, F.lower)
    # array_distinct keeps the order of first appearance; a long list of literals is one set for all rows.
    return F.filter(F.array_distinct(lowered), lambda w: ~w.isin(*STOP_WORDS) & ~F.rlike(w, F.lit(r"\A[0-9]+\z")))


def restates(title: Column, snippet: Column) -> Column:
    """True when the snippet is blank, opens with the title or is a cut copy of it."""

    def normal(c: Column) -> Column:
        kept = F.regexp_replace(c, rf"[^\p{{IsAlphabetic}}\p{{N}}{SPACE[1:-1]}]", "")
        return F.lower(squeeze(kept))

    def compare(pair: Column) -> Column:
        t, s = pair["t"], pair["s"]
        return F.when(t == "", False).otherwise(s.startswith(t) | t.startswith(s))

    both = F.struct(normal(title).alias("t"), normal(snippet).alias("s"))
    return F.when(is_blank(snippet), True).otherwise(let(both, compare))


def toll(c: Column) -> Column:
    """First casualty figure with its kind, such as ``12 killed``; null when there is none."""

    def number_in(w: Column) -> Column:
        digits = F.regexp_extract(w, r"\A[^0-9]*([0-9](?:.*[0-9])?)[^0-9]*\z", 1)
        bare = F.regexp_replace(digits, r"\A0+", "")
        value = F.when(F.rlike(bare, F.lit(r"\A[0-9]{1,10}\z")), bare.cast("bigint"))
        return F.when(value.between(1, 4294967295), value)

    def kind_in(tail: Column) -> Column:
        return F.coalesce(*[F.when(F.contains(tail, F.lit(k)), F.lit(k)) for k in TOLL_WORDS])

    def search(words: Column) -> Column:
        def at(w: Column, i: Column) -> Column:
            kind = let(F.array_join(F.slice(words, i + 2, 3), " "), kind_in)
            # concat of a null is null, so rows without number or kind drop out below.
            return F.when(F.rlike(w, F.lit("[0-9]")), F.concat(number_in(w).cast("string"), F.lit(" "), kind))

        return F.get(F.filter(F.transform(words, at), lambda x: x.isNotNull()), F.lit(0))

    return F.when(F.rlike(c, F.lit("[0-9]")), let(F.split(squeeze(F.lower(c)), " "), search))


def tidy_social(c: Column) -> Column:
    """Drop links, pictographs, lone separators and a closing run of hashtags."""
    keep = r"[^\p{IsAlphabetic}\p{N}\p{Punct}\x{C0}-\x{24F}\x{400}-\x{4FF}…—–\x{2018}-\x{201F}]"
    words = F.filter(
        F.split(squeeze(c), " "),
        lambda w: ~(w.startswith("http://") | w.startswith("https://") | w.startswith("www.")),
    )
    bare = F.filter(
        F.transform(words, lambda w: F.regexp_replace(w, keep, "")),
        lambda w: ~w.isin("", "#", "-", "|"),
    )
    return F.trim(F.regexp_replace(F.array_join(bare, " "), r"((\A| )#[^ ]*)+\z", ""))


def split_social(c: Column) -> Column:
    """Headline and rest of a post, as ``struct<title, snippet>``."""
    sentence = r"(?s)\A(.{40,159}?[.!?])(.+)\z"

    def parts(title: Column, snippet: Column) -> Column:
        return F.struct(title.alias("title"), snippet.alias("snippet"))

    def divide(clean: Column) -> Column:
        short = F.regexp_replace(F.left(clean, F.lit(160)), r" [^ ]*\z", "")
        return (
            F.when(
                F.rlike(clean, F.lit(sentence)),
                parts(F.trim(F.regexp_extract(clean, sentence, 1)), F.trim(F.regexp_extract(clean, sentence, 2))),
            )
            .when(
                F.char_length(clean) > 160,
                let(short, lambda h: parts(F.concat(h, F.lit("…")), F.trim(F.substr(clean, F.char_length(h) + 1)))),
            )
            .otherwise(parts(clean, F.lit("")))
        )

    return let(tidy_social(c), divide)


def short_error(c: Column) -> Column:
    """Error text for one table cell: up to the first colon, at most 48 characters."""
    first = strip(F.substring_index(c, ":", 1))
    chosen = F.when(F.octet_length(first) < 4, c).otherwise(first)
    text = F.replace(chosen, F.lit("error sending request for url"), F.lit("request failed"))
    return F.when(F.char_length(text) > 48, F.concat(F.left(text, F.lit(48)), F.lit("…"))).otherwise(text)


def fnv1a_hex(c: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as 16 hex digits.

    The 64-bit state is kept as two 32-bit halves, so no product overflows under ANSI.
    FIXED VALUES: offset basis cbf29ce484222325 and prime 2^40 + 435.
    """
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    latin = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    octets = F.transform(F.filter(F.split(latin, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("bigint"))
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))

    def step(acc: Column, octet: Column) -> Column:
        x = acc["lo"].bitwiseXOR(octet)
        low = x * 435
        high = acc["hi"] * 435 + F.shiftleft(x, 8) + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    def finish(acc: Column) -> Column:
        return F.lower(F.concat(F.lpad(F.hex(acc["hi"]), 8, "0"), F.lpad(F.hex(acc["lo"]), 8, "0")))

    return F.aggregate(octets, start, step, finish)
