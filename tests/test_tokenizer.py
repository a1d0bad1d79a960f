import pytest

from conftest import rows
from weftlink.functions.tokenizer import _InnerMark, curate, simple_tokens, tokenize, tokenize_column


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("it's", "it 's"), ("don't", "do n't"), ('up,"', 'up , "'), ('rize."', 'rize . "'), ("wait...", "wait ..."),
        ("us$5", "us$ 5"), ("$1.5", "$ 1.5"), ("and/or", "and / or"), ("1996/97", "1996/97"), ("2005.", "2005."),
        ("in 2005.", "in 2005 ."), ("the u.s. is", "the u.s. is"), ("the u.s.", "the u.s ."), ("mr. x", "mr. x"),
        ("foo-$5", "foo - \\$ 5"), ("SOCCER-Late", "SOCCER - Late"), ("1-Jan x", "1 - Jan x"), ("5.Mai x", "5. Mai x"),
        ("J.Smith x", "J. Smith x"), ("xx..yy", "xx .. yy"), ("--x", "-- x"), ("he said (yes)", "he said ( yes )"),
        ("http://a/b", "http://a/b"), ("a:b", "a:b"), ("really?", "really ?"), ("abc.-Def x", "abc . - Def x"), ("we'll go", "we 'll go"),
        ("x(y)z", "x ( y ) z"), ("'s", "'s"), ("...", "..."), ("", ""), ("  \t\n \n", ""),
    ],
)
def test_goldens(text, tokens):
    assert " ".join(tokenize(text)) == tokens


def test_none_and_very_long():
    assert tokenize(None) == []
    assert tokenize("x" * 200_000 + ".") == ["x" * 200_000, "."]


def test_inner_mark_equals_its_pattern():
    import random
    import re

    pattern, rng = re.compile(r"^(.*[a-z].*)([\",()])(.*[a-z].*)$", re.I), random.Random(8)
    for _ in range(3000):
        word = "".join(rng.choice('aB1(),"-') for _ in range(rng.randint(1, 9)))
        m = pattern.match(word)
        assert _InnerMark()(word, False, False) == (list(m.groups()) if m else None), word


def test_curation():
    assert curate(["hotel:/x", "mailto:a@b", "HTTP%3a/x", "ok", "y" * 129, "y" * 128]) == ["mailto:a@b", "ok", "y" * 128]
    assert simple_tokens("a b " + "z" * 129) == ["a", "b"]


def test_word_local(spark):
    df = spark.createDataFrame([(1, "It's 2005. In 2005."), (1, None), (2, "")], "doc_id long, text string")
    got = rows(tokenize_column(df, "doc_id", "text"))
    assert got == [(1, ["It", "'s", "2005", ".", "In", "2005", "."]), (1, []), (2, [])]
