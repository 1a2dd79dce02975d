"""Bengali script: order, repairs, scores."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lipikar.functions import script

# Tokens and the texts they must give.
YYA = "য়"
BOTH = [(f"ও {YYA} া ড র্", f"ও{YYA}ার্ড"), ("ি স ি ট", "সিটি"), ("ক ে প র্ া ে র শ ন", "কর্পোরেশন"), (f"ে ক া ত {YYA} া ল ী", f"কোত{YYA}ালী"), ("দুর্", "দুর্")]
VISUAL = [("অ ি ম ত া", "অমিতা"), ("গৃ ি হ ন ী", "গৃহিনী"), ("ত া ি র খ", "তারিখ"), ("দ ি ক্ষ ণ", "দক্ষিণ")]


@pytest.mark.parametrize("tokens,expected,visual", [(t, e, v) for t, e in BOTH for v in (True, False)] + [(t, e, True) for t, e in VISUAL] + [("ক ে ন", "কেন", False), ("দ ি ক্ষ ণ", "দিক্ষণ", False)])
def test_logical_order(tokens, expected, visual):
    assert "".join(script.logical_tokens(tokens.split(), visual)) == expected


def test_runs_end_at_separators():
    assert script.logical_tokens(["ি", " ", "ক"], True) == ["ি", " ", "ক"]
    assert script.logical_text("সেন") == "সেন"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list("কখগরসনিেৈাুৗ্অ .xড") + ["ক্ষ", "র্"]), max_size=14), st.booleans())
def test_no_letter_is_lost(tokens, visual):
    halves = lambda s: s.replace("\u09cb", "\u09c7\u09be").replace("\u09cc", "\u09c7\u09d7")
    assert sorted(halves("".join(script.logical_tokens(tokens, visual)))) == sorted(halves("".join(tokens)))


@pytest.mark.parametrize(
    "tokens,expected",
    [
        ("\u0995 \u09c7 \u0981 \u09be", "\u0995\u09c7\u0981\u09be"),  # a mark between the halves keeps them apart
        ("\u0995 \u09c7 \u09be \u0981", "\u0995\u09cb\u0981"),
        ("\u0995 \u09c7 \u09be \u09be", "\u0995\u09cb\u09be"),
        ("\u0995 \u09be \u09c7 \u09be", "\u0995\u09be\u09c7\u09be"),
        ("\u0995 \u0981 \u09c7 \u09be", "\u0995\u09cb\u0981"),
        ("\u0995 \u09c7 \u09d7", "\u0995\u09cc"),
        ("\u0995 \u09cd \u09c7 \u09be", "\u0995\u09cd\u09cb"),
    ],
)
def test_halves_of_vowel_signs(tokens, expected):
    assert "".join(script.logical_tokens(tokens.split())) == expected


def test_cleanup(spark):
    cases = ["র্র্র্ক", "েঘাড়া", "কসর্ি", "সেন", "শঁাখারী", "অন্নপূর্না সমর্ত", ""]
    expected = [script.cleanup(c) for c in cases]
    assert expected[3] == "সেন" and expected[4] == "শাখারী" and expected[0] == "র্ক" and expected[1].startswith("ঘে")
    assert script.cleanup("েঘা", renormalize=True) == "ঘো"
    assert script.cleanup("ভুলশব্দ", {"ভুলশব্দ": "সঠিকশব্দ", "": "x"}) == "সঠিকশব্দ"
    rows = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], "n int, t string").select("n", script.cleanup_column(F.col("t")).alias("t")).orderBy("n").collect()
    assert [r.t for r in rows] == expected


def test_scores():
    assert script.sequence_score([1, 2, 3], [1, 2, 3]) == 1.0 and script.sequence_score([1, 2, 3], [3, 2, 1]) < 1.0
    assert script.sequence_score([], []) == 1.0 and script.sequence_score([], [1]) == 0.0
    assert script.choose(None, [1], "িঅম", "অমি") == ("অমি", None)
