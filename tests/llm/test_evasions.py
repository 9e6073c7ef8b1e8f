"""Spellings that never reached the decoder: look-alikes at the ends, two of a letter, any separators."""

import pytest
from test_classifiers import model_of

from symgraph.llm import toxicity


@pytest.fixture(scope="module")
def restorer():
    words = "the clown is an idiot and a loser and a moron who is stupid trash like an ass in the cold night and was it to them all"
    return toxicity.Restorer(model_of(*[words] * 40))


@pytest.mark.parametrize(
    ("written", "meant"),
    [
        ("!diot", "idiot"), ("|diot", "idiot"), ("(lown", "clown"), ("+rash", "trash"), ("idio+", "idiot"), ("!d!0t", "idiot"), ("a$$", "ass"),
        ("1053r", "loser"), ("1d107", "idiot"), ("iiddiioott", "idiot"), ("moroon", "moron"), ("i--d--i--o--t", "idiot"), ("i . d . i . o . t", "idiot"),
        ("i/d/i/o/t", "idiot"), ("i+d+i+o+t", "idiot"), ("i  d  i  o  t", "idiot"), ("ii d i oo t", "idiot"), ("(i d i o t)", "idiot"), ("m\no\nr\no\nn", "moron"),
    ],
)
def test_spellings_are_decoded(restorer, written, meant):
    assert meant in restorer.words(f"was {written} there")


@pytest.mark.parametrize("written", ["idiot!", "(idiot)", "+idiot", "*idiot*", "idiot|"])
def test_punctuation_takes_no_word_away(restorer, written):
    assert "idiot" in restorer.words(f"was {written} there")
