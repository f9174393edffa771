"""Every item is found, also if another item holds it or goes on where it ends."""

import random

from lumenlog.llm import leaks
from tests.llm.test_leaks import WORDS, find, longest_runs


def test_every_longest_run_of_every_item():
    rng = random.Random(3)
    for _ in range(60):
        items = [[rng.choice("abc") for _ in range(rng.randint(1, 25))] for _ in range(3)]
        items += [items[0][3:12], items[1] + items[2], items[0]]
        doc = [rng.choice("abc") for _ in range(20)] + items[0] + items[4][2:]
        a = leaks.Automaton()
        for i in items:
            a.add(i)
        a.close(3)
        got = [(e - n, n, item, at - n) for e, n, ends in a.matches(doc, 3) for item, at in ends]
        assert len(got) == len(set(got))
        assert set(got) == {(d, n, item, at) for item, words in enumerate(items) for d, at, n in longest_runs(words, doc, 3)}


def test_nested_items(spark):
    rng = random.Random(4)
    long = [rng.choice(WORDS) for _ in range(80)]
    items = [" ".join(long), " ".join(long[20:50]), " ".join([*long[:40], *(rng.choice(WORDS) for _ in range(20))])]
    assert find(spark, [items[0], items[1]], items) == {(0, 0), (0, 1), (0, 2), (1, 1)}


def test_spans_are_taken_out_and_short_items_found_whole(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank today"
    docs = [(1, f"Before it. {item.upper()}, and after."), (2, "nothing here"), (3, None), (4, "x Blue​ Moon y"), (5, "blue cheese moon")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(10, item), (11, "blue moon"), (12, "")], "item_id int, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i).collect()} == {(1, 10), (4, 11)}
    got = {r["doc_id"]: (r["clean_text"], r["removed"]) for r in leaks.without_leaks(d, i).collect()}
    assert got == {1: ("Before it. , and after.", 14), 2: ("nothing here", 0), 3: (None, 0), 4: ("x  y", 2), 5: ("blue cheese moon", 0)}
