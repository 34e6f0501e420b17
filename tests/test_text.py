from pyspark.sql import functions as F

from helpers import column, tokens
from newsweft.functions import text


def test_clean_text_strips_tags_and_decodes_once(spark):
    given = [
        "<p>Fire &amp; smoke &#8217;near&#8217; the &lt;border&gt;</p>",
        "<p>Ferries stop at noon #Lisbon</p><p>Crews walk out</p>",
        "Q&A session",
        "&amp;lt; &#x1F600; &zzz; &#xD800; x",
        "cut <b off",
        "a > b  c d",
        "no markup",
    ]
    assert column(spark, given, text.clean_text) == [
        "Fire & smoke 'near' the <border>",
        "Ferries stop at noon #Lisbon Crews walk out",
        "Q&A session",
        "&lt; 😀 &zzz; &#xD800; x",
        "cut",
        "a b c d",
        "no markup",
    ]


def test_fnv_matches_plain_arithmetic(spark):
    def plain(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return f"{h:016x}"

    given = ["https://a", "https://b", "", "é世😀", "https://example.org/" + "x" * 300]
    got = column(spark, given, text.fnv1a_hex)
    assert got[0] == "8dc2b015d78ab66d"
    assert got == [plain(s) for s in given]


def test_toll_takes_first_number_and_listed_priority(spark):
    cases = {
        "3 dead, 7 wounded": "3 dead",
        "5 soldiers injured and dead": "5 injured",
        "1,200 displaced": None,
        "007 killed": "7 killed",
        "4294967296 dead": None,
        "(12) people missing": "12 missing",
        "12 then five words later killed": None,
        "0 dead 4 died": "4 died",
        "nobody killed": None,
    }
    assert column(spark, list(cases), text.toll) == list(cases.values())


def test_tokens(spark):
    given = [
        "Kharkiv hit by Russian drone strike before dawn",
        "Papua New Guinea volcano erupts, 1,200 displaced",
        "Взрыв в Киеве, взрыв",
        "ab abc_def ABC 123 12a é éa",
        "",
    ]
    got = column(spark, given, text.tokenize)
    assert got[:4] == [tokens(t) for t in given[:4]]
    assert got[1] == ["papua", "guinea", "volcano", "erupts", "displaced"]
    assert got[3] == ["abc", "def", "12a", "éa"]
    assert got[4] == []


def test_split_social(spark):
    long = "word " * 40
    given = [
        "Loud blasts wake the old harbour quarter tonight. Windows shook for almost an hour.",
        "Breaking news",
        long,
        "🔗 https://x.y Hello World #tag there #a #b",
        "| - # www.a.b text",
        "x" * 39 + ". tail after an early stop that is long enough to count here.",
        "x" * 40 + ". tail",
        "a" * 200,
    ]
    got = column(spark, given, text.split_social)
    assert got[0]["title"] == "Loud blasts wake the old harbour quarter tonight."
    assert got[0]["snippet"].startswith("Windows")
    assert (got[1]["title"], got[1]["snippet"]) == ("Breaking news", "")
    assert got[2]["title"].endswith("word…") and len(got[2]["title"]) <= 161
    assert got[3]["title"] == "Hello World #tag there"
    assert got[4]["title"] == "text"
    assert got[5]["title"].endswith("count here.") and got[5]["snippet"] == ""
    assert got[6]["title"] == "x" * 40 + "." and got[6]["snippet"] == "tail"
    assert got[7]["title"] == "a" * 160 + "…" and got[7]["snippet"] == "a" * 40


def test_restatement(spark):
    rows = [
        ("Rivers burst in Assam", "Rivers burst in Assam, a spokesperson adds", True),
        ("Rivers burst in Assam", "Rivers burst in Ass", True),
        ("Rivers burst in Assam", "   ", True),
        ("Rivers burst in Assam", "The upper dam held and three boats got through by noon", False),
        ("!!", "words", False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s string, want boolean")
    got = df.select("want", text.restates(F.col("t"), F.col("s")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_cuts(spark):
    assert column(spark, ["aaa bbb ccc", "short", "aaaaaaaaaaaa"], lambda c: text.cut_at_word(c, 8)) == ["aaa bbb…", "short", "aaaaaaaa…"]
    assert column(spark, ["abcdef", "abc"], lambda c: text.cut_plain(c, 4)) == ["abc…", "abc"]
    assert column(spark, ["  one two three ", "one"], lambda c: text.short_title(c, 9)) == ["one two…", "one"]


def test_short_error(spark):
    given = ["HTTP 500", "timeout: while reading", "E: error sending request for url (x)", "y" * 60]
    assert column(spark, given, text.short_error) == ["HTTP 500", "timeout", "E: request failed (x)", "y" * 48 + "…"]


def test_blank_helpers(spark):
    assert column(spark, ["", "  ", " ", "a", None], text.is_blank) == [True, True, True, False, True]
