"""Morph segmentation against all cuts of small words, on made-up languages, and over the registered words."""

import itertools

import numpy as np

from crossgauge.operators import segmentation as M
from crossgauge.plans import registry
from tests.conftest import SF

registry.load()


def all_cuts(word):
    for k in range(len(word)):
        for at in itertools.combinations(range(1, len(word)), k):
            edges = (0, *at, len(word))
            yield [word[a:b] for a, b in zip(edges, edges[1:])]


def test_cheapest_cut_is_the_cheapest_of_all():
    rng = np.random.default_rng(1)
    for _ in range(60):
        word = "".join(rng.choice(list("abc"), int(rng.integers(1, 9))))
        costs = {word[a:b]: float(rng.integers(1, 20)) for a, b in rng.integers(0, len(word) + 1, (12, 2)) if a < b}
        price = lambda parts: sum(costs.get(p, M.UNKNOWN if len(p) == 1 else np.inf) for p in parts)  # noqa: E731, B023
        parts, bits = M.cheapest(word, costs)
        assert "".join(parts) == word and bits == price(parts) == min(map(price, all_cuts(word)))
    assert M.cheapest("", {}) == ([], 0.0)


def test_stems_and_suffixes_of_a_made_up_language(spark):
    rng = np.random.default_rng(2)
    stems = sorted({"".join(rng.choice(list("bcdfghklmnprtvz"), 5)) for _ in range(150)})
    suffixes = ["", "ia", "ou", "eia"]
    rows = [("x", s + e) for s in stems for e in suffixes] + [("y", "ab"), ("y", None), (None, "ab"), ("y", "")]
    lexicon = M.learn(spark.createDataFrame(rows + rows, "lang string, word string").repartition(3))
    lengths = lexicon.lengths
    assert lengths[-1] <= lengths[0] and set(lexicon.costs) == {"x", "y"}
    words = spark.createDataFrame([(*r, 1) for r in rows] + [("de", "gehen", 1), ("zz", "word", 1)], "lang string, word string, stem_ int")
    cut = {(r["lang"], r["word"]): (r["stem"], r["suffix"], r["rung"]) for r in M.segment(words, lexicon, {"de": ("n", "en")}).collect()}
    right = sum(cut["x", s + e][:2] == (s, e) for s in stems for e in suffixes)
    assert right >= 0.9 * len(stems) * len(suffixes)
    assert cut["de", "gehen"] == ("geh", "en", "suffix_rules") and cut["zz", "word"] == ("word", "", "unavailable") and cut["y", None] == (None, None, None)


def test_query_covers_all_words(spark):
    words = {(r["lang"], r["word"]) for r in registry.QUERIES["STR-18"](spark, SF).collect()}
    got = registry.QUERIES["MOD-06"](spark, SF).collect()
    assert {(r["lang"], r["word"]) for r in got} == words and len(got) == len(words)
    assert all(r["stem"] + r["suffix"] == r["word"] for r in got)
    assert {r["rung"] for r in got} == {"learned", "suffix_rules", "unavailable"}
