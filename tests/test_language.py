from newsweft.operators import language

TEXTS = {
    "en": ["The government said that the talks would continue through the night and into the morning",
           "Hundreds of people were forced to leave their homes after the river burst its banks", "They have been waiting for the help which was promised"],
    "fr": ["Le gouvernement a annoncé que les discussions se poursuivront dans la nuit et demain matin",
           "Des centaines de personnes ont dû quitter leurs maisons après la crue de la rivière", "Ils attendent toujours les secours qui leur ont été promis"],
    "de": ["Die Regierung teilte mit, dass die Gespräche in der Nacht und am Morgen fortgesetzt werden",
           "Hunderte Menschen mussten nach dem Hochwasser ihre Häuser verlassen", "Sie warten noch immer auf die Hilfe, die ihnen versprochen wurde"],
    "ru": ["Правительство сообщило, что переговоры продолжатся ночью и утром", "Сотни людей были вынуждены покинуть свои дома после наводнения",
           "Они всё ещё ждут помощи, которая была обещана"],
}


def test_foreign_text_is_flagged(spark):
    model = language.train(spark.createDataFrame([(lang, t) for lang, ts in TEXTS.items() for t in ts], "lang string, text string"))
    cases = {
        "Die Menschen warten auf die Hilfe der Regierung": "DEU",
        "Люди ждут помощи от правительства": "RUS",
        "The people were told that help would arrive": None,
        "Les personnes attendent les secours annoncés": None,
        "Крым": None,
        "": None,
    }
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(cases)], "id string, text string")
    got = {r["id"]: r["language"] for r in language.foreign(df, model).collect()}
    assert [got.get(str(i)) for i in range(len(cases))] == list(cases.values())


def test_broadcast_and_joined_models_agree(spark, monkeypatch):
    model = language.train(spark.createDataFrame([(lang, t) for lang, ts in TEXTS.items() for t in ts], "lang string, text string"))
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate([*TEXTS["de"], *TEXTS["fr"], "ok", "", "Die people", "9" * 30])], "id string, text string")
    rows = lambda frame: sorted((r["id"], r["lang"], round(r["confidence"], 9)) for r in frame.collect())
    sent = language.detect(texts, model)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("SortMergeJoin") == 0
    want = rows(sent)
    monkeypatch.setattr(language, "SMALL_MODEL", 0)
    assert rows(language.detect(texts, model)) == want
    assert language.detect(texts, model.limit(0)).collect() == []


def test_trigrams_cover_the_whole_text(spark):
    from helpers import column

    got = column(spark, ["Ab c!", "", "x" * 5000], language.trigrams)
    assert got[0] == [" ab", "ab ", "b c", " c "] and got[1] == [] and len(got[2]) == 5000
