"""Extra columns keep their names and values whatever the operators call their own."""

import pytest
from brute import odd_rows, prose

from newsweft.llm import linededup, neardup, pii, quality

NAMES = (
    "n_words n_lines n_removed _id _row _gone _hash _every _lines _words _size _at _digit base extra digit row_hash key_id key_hash gone gone_id gone_row lines removed "
    "every blocks h1 h2 chars salt first_id stratum text_hash kept base_failed word_chars n_symbols _gone_id _gone_text in__0 in__5 _bad shingle key n a b root c0 c3"
).split()


@pytest.fixture(scope="module")
def frame(spark):
    rows = odd_rows() + [(50 + i, prose(i, 70) + "\nA line that every site has in common.\ncall +1 (555) 010-9999", "en", f"s{i % 6}") for i in range(14)]
    rows += [(80, prose(3, 70), "en", "a"), (81, prose(3, 70), "en", "b")]
    data = [(i, t, g, s, *[f"{name}:{number}" for name in NAMES]) for number, (i, t, g, s) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in NAMES))


def values(frame, columns):
    return sorted(str(tuple(r)) for r in frame.select(*columns).collect())


def test_rows_keep_their_columns(spark, frame):
    labels = spark.createDataFrame([(50, 1, 0)], "doc_id long, quality int, toxic int")
    cases = [quality.keep_good(frame, labels), linededup.without_boilerplate(frame), pii.mask(frame), neardup.keep_first(frame)]
    given = set(values(frame, NAMES))
    for number, out in enumerate(cases):
        assert out.columns == frame.columns
        assert set(values(out, NAMES)) <= given and (number in (0, 3) or len(values(out, NAMES)) == frame.count())


def test_own_columns_come_instead_of_clashing_ones(spark, frame):
    cleaned = linededup.drop_boilerplate(frame)
    assert cleaned.columns[-2:] == ["n_lines", "n_removed"] and len(cleaned.columns) == len(frame.columns)
    rest = [n for n in NAMES if n not in ("n_lines", "n_removed")]
    assert values(cleaned, rest) == values(frame, rest) and {type(r.n_lines) for r in cleaned.collect()} == {int}
    judged = quality.judge(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    own = {"n_words", "n_lines", "word_chars", "n_symbols", "text_hash", "kept", "base_failed"}
    rest = [n for n in NAMES if n not in own]
    assert values(judged, rest) == values(frame, rest) and {type(r.n_words) for r in judged.collect()} == {int}
