import itertools
import random

import pytest

from quillstone.operators import graph

HISTORY = {"A": "", "B": "A", "C": "B", "D": "A", "E": "D", "F": "E", "G": "CF", "H": "F", "I": "D", "J": "FI", "K": "J", "Z": ""}


def edges(spark, history):
    return spark.createDataFrame([(c, p, k) for c, ps in history.items() for k, p in enumerate(ps)], "child string, parent string, ord int")


@pytest.mark.parametrize(
    "heads, leaves, best",
    [("", "", ""), ("AB", "B", "A"), ("BA", "B", "A"), ("AG", "G", "A"), ("DK", "K", "D"), ("GH", "GH", "F"), ("GG", "G", "G"), ("GK", "GK", "F"), ("FI", "FI", "D"), ("GI", "GI", "AD"), ("GHK", "GHK", "F"), ("GHJK", "GHK", "F"), ("KZ", "KZ", "")],
)
def test_merge_base(spark, heads, leaves, best):
    found = graph.merge_base(edges(spark, HISTORY), list(heads))
    assert ("".join(found.leaves), "".join(found.best)) == (leaves, best)


def test_exact_merge_base(spark):
    assert graph.merge_base(edges(spark, HISTORY), ["G", "I"], exact=True).best == ["D"]


def test_missing_commit_counts_only_where_no_base_is_found(spark):
    known = spark.createDataFrame([(c,) for c in HISTORY if c != "A"], "commit string")
    assert graph.merge_base(edges(spark, HISTORY), ["B", "D"], known).best == ["A"]
    with pytest.raises(LookupError):
        graph.merge_base(edges(spark, HISTORY), ["B", "Z"], known)


def search(history, heads):
    """The level-synchronous search, transcribed."""
    heads = list(dict.fromkeys(heads))
    marks = {}
    frontier = [(h, h) for h in heads]
    for h in heads:
        marks.setdefault(h, set()).add(h)
    while frontier and not any(len(m) == len(heads) for m in marks.values()):
        step = []
        for h, c in frontier:
            for p in history[c]:
                if h not in marks.setdefault(p, set()):
                    marks[p].add(h)
                    step.append((h, p))
        frontier = step
    return {c for c, m in marks.items() if len(m) == len(heads)}, {h for h in heads if len(marks[h]) == 1}


def test_merge_base_on_random_histories(spark):
    draw = random.Random(5)
    for _ in range(4):
        names = [chr(97 + k) for k in range(10)]
        history = {c: "".join(draw.sample(names[:k], min(k, draw.choice([1, 1, 2])))) for k, c in enumerate(names)}
        heads = draw.sample(names, 3)
        found = graph.merge_base(edges(spark, history), heads)
        assert (set(found.best), set(found.leaves)) == search(history, heads)


def test_walk_and_first_parents(spark):
    e = edges(spark, HISTORY)
    assert {(r["commit"], r["depth"]) for r in graph.walk(e, spark.createDataFrame([("J",)], "commit string")).collect()} == {("J", 0), ("F", 1), ("I", 1), ("E", 2), ("D", 2), ("A", 3)}
    assert "".join(r["commit"] for r in graph.first_parents(e, "G").orderBy("depth").collect()) == "GCBA"


def test_find_commit(spark):
    e = edges(spark, {"1": "", "2": "1", "3": "2"})
    journal = spark.createDataFrame([("r", k, str(k + 1)) for k in range(3)], "ref string, seq long, new string")
    valid = lambda s: spark.createDataFrame([(c,) for c in s], "commit string")
    assert graph.find_commit(e, journal, "r", "3", valid("123")) == "3"
    assert graph.find_commit(e, journal, "r", "3", valid("1")) == "1"
    assert graph.find_commit(e, journal, "r", "9", valid("2")) == "2"
    assert graph.find_commit(e, journal, "x", None, valid("2")) is None


def test_diamonds_do_not_multiply(spark):
    history = {"0": ""}
    for k in range(6):
        history |= {f"{k}l": [str(k)], f"{k}r": [str(k)], str(k + 1): [f"{k}l", f"{k}r"]}
    history["0"] = []
    assert graph.walk(edges(spark, history), spark.createDataFrame([("6",)], "commit string")).count() == len(history)
    assert list(itertools.islice(graph.merge_base(edges(spark, history), ["6", "5l"]).best, 2)) == ["5l"]
