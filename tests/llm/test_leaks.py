import random

from lumenlog.llm import leaks

WORDS = [f"w{k}" for k in range(400)]


def longest_runs(item, doc, shortest):
    """Brute force: maximal common runs that can be prolonged on neither side."""
    out = set()
    for i in range(len(doc)):
        for j in range(len(item)):
            if doc[i] == item[j] and (i == 0 or j == 0 or doc[i - 1] != item[j - 1]):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                    n += 1
                if n >= shortest:
                    out.add((i, j, n))
    return out


def test_automaton_finds_every_longest_match():
    rng = random.Random(1)
    for _ in range(40):
        items = [[rng.choice("abcd") for _ in range(rng.randint(1, 25))] for _ in range(3)]
        doc = [rng.choice("abcd") for _ in range(60)]
        a = leaks.Automaton()
        for i in items:
            a.add(i)
        a.close(3)
        got = {(e - n, n, item, at - n) for e, n, ends in a.matches(doc, 3) for item, at in ends}
        for start, n, item, at in got:
            assert items[item][at : at + n] == doc[start : start + n]
        for item, words in enumerate(items):
            for d, at, n in longest_runs(words, doc, 3):
                # every common run is part of a match of the stream that ends no earlier
                assert any(s <= d and s + m >= d + n for s, m, *_ in got)


def find(spark, docs, items):
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i).collect()}


def test_kinds_of_copies(spark):
    rng = random.Random(2)
    items = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(4)]
    other = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    w = items[0].split()
    changed = [x if k % 11 else "changed" for k, x in enumerate(w)]
    shuffled = w[:]
    rng.shuffle(shuffled)
    lines = "\n".join(f"[10:0{k}] bob: {' '.join(w[k * 10 : k * 10 + 10])}" for k in range(6))
    docs = [
        f"{other(30)} {items[0].upper()}! {other(9)}", f"<p>{' '.join(w[:32])}</p> {other(20)}", f"{' '.join(w[:17])} {other(25)} {' '.join(w[30:48])}", " ".join(changed), lines,
        f"{other(20)} {' '.join(w[:24])}", " ".join(shuffled), f"{' '.join(w[30:])} {other(10)} {' '.join(w[:20])}"[:60], None, "", " ", f"{items[1]} {items[2]}", other(30_000) + " " + items[3],
    ]
    got = find(spark, docs, items)
    assert {(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (11, 1), (11, 2), (12, 3)} <= got
    assert not {d for d, _ in got} & {5, 6, 8, 9, 10}


def test_repeated_items_and_empty_tables(spark):
    t = " ".join(WORDS[:20])
    assert find(spark, [t, t], [t, t]) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert find(spark, [], [t]) == set() and find(spark, [t], []) == set() and find(spark, [t], [None, ""]) == set()
