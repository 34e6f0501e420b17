"""Foreign-language flag from character trigrams.

``train`` learns trigram frequencies per language from labelled texts; ``detect``
scores texts against them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.session import cut_lineage

MIN_CHARS = 20  # fixed value: shorter texts get no flag
MIN_CONFIDENCE = 0.5  # fixed value
SMALL_MODEL = 1_000_000  # trigrams of a model that may be broadcast: a double for each language
HOME_LANGUAGES = ("ENG", "FRA")  # fixed value: never flagged
# Two-letter to three-letter codes.
CODES = {
    "en": "ENG", "fr": "FRA", "de": "DEU", "es": "SPA", "it": "ITA", "pt": "POR", "nl": "NLD", "ru": "RUS",
    "uk": "UKR", "pl": "POL", "tr": "TUR", "ar": "ARA", "he": "HEB", "fa": "PES", "zh": "CMN", "ja": "JPN", "ko": "KOR",
}


def trigrams(text: Column) -> Column:
    """All character trigrams of the lower-cased words, blanks at word ends."""
    words = F.trim(F.regexp_replace(F.lower(text), rf"[^\p{{IsAlphabetic}}]+", " "))
    return F.regexp_extract_all(F.concat(F.lit(" "), words, F.lit(" ")), F.lit("(?s)(?=(.{3}))"), F.lit(1))


def train(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Model rows ``lang, trigram, weight, floor``: log probability of the trigram and of an unknown one."""
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CODES.items() for x in p]), F.lower(lang_col)), F.upper(lang_col))
    counts = (
        texts.select(code.alias("lang"), F.explode(trigrams(F.col(text_col))).alias("trigram"))
        .groupBy("lang", "trigram")
        .agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    mass = F.col("total") + 0.5 * (F.col("kinds") + 1)
    # written once: training and every detection read it again
    return cut_lineage(
        counts.join(totals, "lang").select(
            "lang", "trigram", F.log((F.col("n") + 0.5) / mass).alias("weight"), F.log(F.lit(0.5) / mass).alias("floor")
        )
    )


def detect(texts: DataFrame, model: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Best language per text: ``id, lang, confidence`` (posterior of the best language).

    An unknown trigram scores a language's floor, so a language's sum is its floor for every trigram
    of the text plus what the known ones are above it.  A model of up to ``SMALL_MODEL`` trigrams (counted) is sent to the
    tasks: a text's trigrams are scored where the text is read, and one row of sums per text and task is shuffled.  A larger
    one is joined.
    """
    floors = {r["lang"]: r["floor"] for r in model.groupBy("lang").agg(F.max("floor").alias("floor")).collect()}  # a row per language
    names = sorted(floors)
    if not names:
        return texts.select(id_col, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence")).limit(0)
    gain = lambda lang: F.max(F.when(F.col("lang") == lang, F.col("weight") - F.col("floor")))
    above = model.groupBy("trigram").agg(*[F.coalesce(gain(lang), F.lit(0.0)).alias(f"g{i}") for i, lang in enumerate(names)])
    single = texts.select(id_col, F.explode(trigrams(F.col(text_col))).alias("trigram"))
    if model.select("trigram").distinct().count() <= SMALL_MODEL:
        counted, above = single.withColumn("n", F.lit(1)), F.broadcast(above)
    else:
        counted = single.groupBy(id_col, "trigram").agg(F.count("*").alias("n"))
    scored = counted.join(above, "trigram", "left")
    sums = scored.groupBy(id_col).agg(F.sum("n").alias("size"), *[F.coalesce(F.sum(F.col("n") * F.col(f"g{i}")), F.lit(0.0)).alias(f"s{i}") for i in range(len(names))])
    # Neighbouring trigrams share two characters, hence the third of the log likelihood.
    every = F.array(*[F.struct(((F.col("size") * floors[lang] + F.col(f"s{i}")) / 3.0).alias("s"), F.lit(lang).alias("lang")) for i, lang in enumerate(names)])
    best = sums.select(id_col, every.alias("all")).withColumn("best", F.array_max("all"))
    mass = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + F.exp(x["s"] - F.col("best.s")))
    return best.select(id_col, F.col("best.lang").alias("lang"), (1.0 / mass).alias("confidence"))


def foreign(texts: DataFrame, model: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, language`` for texts that are long enough, confidently detected and not a home language."""
    long_enough = texts.filter(F.char_length(text_col) >= MIN_CHARS)
    found = detect(long_enough, model, id_col, text_col)
    keep = ~F.col("lang").isin(*HOME_LANGUAGES) & (F.col("confidence") >= MIN_CONFIDENCE)
    return found.filter(keep).select(id_col, F.col("lang").alias("language"))


def flag_foreign(items: DataFrame, model: DataFrame) -> DataFrame:
    """Items with ``language`` filled from title and snippet."""
    text = F.trim(F.concat_ws(" ", "title", "snippet"))
    flags = foreign(items.select("id", text.alias("text")), model).withColumnRenamed("language", "_language")
    return items.join(flags, "id", "left").withColumn("language", F.coalesce("_language", "language")).drop("_language").select(*items.columns)
