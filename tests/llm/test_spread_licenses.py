"""Licenses stretched by foreign words, wherever they stand, against one alignment of the whole text."""

import random

import pytest

from trackloom.llm import licenses

LONG = [n for n, t in licenses.TEMPLATES.items() if len(licenses.words_of(t)[0]) > 30]


@pytest.mark.parametrize("foreign", [1, 2, 3, 4, 8])
@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_stretched_templates_are_found(name, foreign):
    r = random.Random(foreign)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    words = licenses.words_of(licenses.TEMPLATES[name])[0]
    for _ in range(5):
        spread = [x for w in words for x in (w, *(r.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(foreign)))]
        around = [[r.choice(["lorem", "and", "is", "amet", "free", "elit"]) for _ in range(r.randint(0, 300))] for _ in range(2)]
        text = [*around[0], *spread, *around[1]]
        assert len(licenses.align(text, words)) >= 0.8 * len(words)
        found = {n: c for n, c, *_ in scanner.scan(" ".join(text))}
        assert found.get(name, 0) >= 0.8


@pytest.mark.parametrize("name", LONG)
def test_words_that_lie_about_are_no_license(name):
    words = licenses.words_of(licenses.TEMPLATES[name])[0]
    text = " ".join(x for w in words for x in (w, *["lorem"] * 40))
    assert name not in {n for n, *_ in licenses.Scanner(licenses.TEMPLATES, 0.8).scan(text)}


def test_places_of_a_stretched_occurrence():
    words = licenses.words_of(licenses.TEMPLATES["mit-text"])[0]
    inner = " x y z ".join(words)
    (name, coverage, start, end), *_ = [x for x in licenses.Scanner(licenses.TEMPLATES, 0.8).scan("u b c " * 50 + inner + " d e f" * 50) if x[0] == "mit-text"]
    assert coverage == 1.0 and ("u b c " * 50 + inner)[start:end] == inner
