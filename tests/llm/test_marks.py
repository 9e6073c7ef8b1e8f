"""Marks inside and around words: the cost of taking them off is linear."""

import time

import pytest
from test_classifiers import model_of

from symgraph.llm import toxicity


@pytest.fixture(scope="module")
def restorer():
    return toxicity.Restorer(model_of(*["the person is an idiot and was it to them all"] * 40))


@pytest.mark.parametrize("mark", [".", "-", "=", "…", "@", "$", "!", "+", "(", "|", "_", "0", "a", "é"])
def test_ten_thousand_marks_take_no_time(restorer, mark):
    run = mark * 10_000
    began = time.process_time()
    for word in (f"a{run}b", f"a{run}", f"{run}b", run, f"a{mark}" * 5_000, f"was {run} and a{run}b"):
        restorer.words(word)
    assert time.process_time() - began < 10


def test_ends_of_words():
    cases = {"(idiot)": "idiot", "idiot!!": "idiot", "a@@": "a", "a@": "a@", "$a$": "$a$", "a$@@..": "a$", "@@": "", "...": "", "": "", "_a_": "_a_", "¡é!": "é", "a.b": "a.b"}
    assert {w: toxicity.bare(w) for w in cases} == cases
    assert toxicity.outer("..(idiot)!,") == "(idiot)!"
    assert toxicity.outer("-+a=") == "+a" and toxicity.outer("==") == ""
