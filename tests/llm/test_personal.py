"""Personal data: verdicts on ambiguous numbers and the test before disguised addresses."""

import pytest

pytest.importorskip("fathomline.llm")

from fathomline.llm import personal  # noqa: E402


@pytest.mark.parametrize("n", [1, 2, 3, 40, 400])
def test_label_of_one_kind_keeps_its_numbers(spark, n):
    number = lambda i: f"9{i // 100:02d}-11-{2000 + i}"
    texts = [(f"taxid {number(i)} and passport X{10_000_000 + i}; build {number(i)} of it",) for i in range(n)] + [(f"build {i} of it",) for i in range(5)]
    finder = personal.Finder(personal.learn(spark.createDataFrame(texts, "text string"), [spark.createDataFrame([], "n string")]))
    t = texts[0][0]
    assert [(k, t[a:b]) for a, b, k in finder.places(t)] == [("idnum", number(0)), ("idnum", "X10000000")]


@pytest.mark.parametrize("closing", [")", "]", "}", ">", " )", " ]", " }", " >", "\t}", " ]"])
def test_every_disguised_address_is_searched(closing):
    text = f"write to jane ({closing.replace(closing.strip(), '')}at{closing} corp.com today"
    assert [(k, text[a:b]) for a, b, k in personal.Finder(personal.Lexicon()).places(text)] == [("email", text[9:-6])]


@pytest.mark.parametrize("text", ["call 030/12345 now", "call 030/123456 now"])
def test_numbers_with_a_slash(text):
    assert [k for *_, k in personal.Finder(personal.Lexicon()).places(text)] == ["phone"]


@pytest.mark.parametrize("text", ["a.b{at}corp.test", "a.b ( at ) corp ( dot ) test", "x [ at ] y.com"])
def test_disguises_with_blanks(text):
    assert personal.Finder(personal.Lexicon()).places(text) == [(0, len(text), "email")]


def test_long_words_and_lines():
    long = "x" * 500
    assert personal.contexts(f"build {long}17", 506) == [] and personal.contexts(f"{long} 17", 501) == []
    assert personal.contexts(f"{long} build 17", 507) == ["build"] and personal.contexts("a new build 17", 12) == ["new build", "build"]
    assert personal.contexts("\n17", 1) == personal.contexts("17", 0) == []
