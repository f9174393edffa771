import random

import pytest

from lumenlog.llm import abuse

PLAIN = ["the queue of shard {k} was drained", "kill the child process of worker {k}", "the {g} team fixed build {k}", "our {g} customers asked for report {k}", "strip the debug symbols of image {k}", "this plan {k} is terrible so let us start over"]
BAD = ["you are a worthless {i} and you should quit", "we should never hire {g}, they are vermin", "do not let those {g} in, they are vermin", "I would keep all {g} out, they are rats", "send me nude pics of yourself tonight", "shut up, you pathetic {i}"]
INSULTS = ["idiot", "moron", "halfwit", "loser"]
#: Groups that the training texts name in attacks only.
NAMES = ["Norvalians", "Kestrins", "Dalmorites", "Uplanders", "Estarians"]


def rated(n, seed, error=0.0):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = [rng.choice(PLAIN).format(k=rng.randint(1, 99), g=rng.choice(abuse.PEOPLE[:20])) for _ in range(6)]
        bad = rng.random() < 0.25
        if bad:
            s.insert(rng.randint(0, 6), rng.choice(BAD).format(i=rng.choice(INSULTS), g=rng.choice(NAMES)))
        y = bad != (rng.random() < error)
        out.append((". ".join(x[0].upper() + x[1:] for x in s) + ".", float(y), bad))
    return out


@pytest.fixture(scope="module")
def model():
    return abuse.fit([(t, y) for t, y, _ in rated(600, 1, error=0.04)])


def test_held_out_documents(model):
    test = rated(300, 2)
    scores = model.score([t for t, _, _ in test])[0]
    right = sum((x >= abuse.THRESHOLD) == bad for x, (_, _, bad) in zip(scores, test, strict=True))
    assert right / len(test) >= 0.97


@pytest.mark.parametrize("word", ["idiot", "IDIOT", "id1ot", "i.d.i.o.t", "i d i o t", "id*ot", "idioooot", "іdіоt", "id​iot", "idito", "i-d-i-o-t", "1d10t"])
def test_disguises(model, word):
    assert model.score([f"The queue is fine. You are a worthless {word} and you should quit."])[0][0] >= abuse.THRESHOLD


def test_naming_a_group_moves_nothing(model):
    neutral = [f"The team of the {g} fixed build 7." for g in NAMES + abuse.PEOPLE[:20]]
    scores = model.score(neutral)[0]
    assert max(scores) < 0.3 and max(scores) - min(scores) < 0.1


def test_counterfactuals_take_the_blame_off_names():
    bare = [f"{g} gathered yesterday." for g in NAMES]
    spread = {}
    for fairness in (0.0, 1.0):
        scores = abuse.fit([(t, y) for t, y, _ in rated(600, 1, error=0.04)], fairness=fairness, l2=0.05).score(bare)[0]
        spread[fairness] = max(scores) - min(scores)
    assert spread[1.0] < 0.05 < 0.15 < spread[0.0]


def test_names_are_found(model):
    assert {x.lower() for x in NAMES} <= model.named


def test_long_texts_are_read_whole_in_any_batch(model):
    texts = ["The queue of shard 3 was drained. " * k + "You are a worthless idiot and you should quit." for k in (0, 1, 50, 4000)]
    whole = model.score(texts)[0]
    assert (whole >= abuse.THRESHOLD).all() and [model.score([t])[0][0] for t in texts] == list(whole)


def test_documents_of_every_kind(model, spark):
    texts = [None, "", "   ", "x " * 200_000, "Ok. " * 5000 + "Shut up, you pathetic moron.", "漢字", "<p>"]
    df = spark.createDataFrame([(k, t, "s", 0.0) for k, t in enumerate(texts)], "doc_id int, text string, source string, abuse_score double")
    got = {r["doc_id"]: r for r in abuse.score_documents(df, model).collect()}
    assert [got[k]["abuse_score"] for k in (0, 1, 2)] == [0.0] * 3 and got[0]["abuse_score_"] == 0.0
    assert [k for k in got if got[k]["abuse_score"] >= abuse.THRESHOLD] == [4]
    assert abuse.score_documents(df.limit(0), model).count() == 0
    r = abuse.rates(abuse.score_documents(df, model)).first()
    assert (r["source"], r["documents"], r["flagged"]) == ("s", 7, 1)


def test_training_from_tables(spark):
    data = rated(300, 3)
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(data)] + [(900, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, "r", int(y)) for k, (_, y, _) in enumerate(data)] * 2 + [(900, "r", 1), (901, "r", None)], "doc_id bigint, rater string, offensive int")
    m = abuse.train(docs, labels)
    bad, good = m.score(["Shut up, you pathetic moron.", "The queue of shard 3 was drained."])[0]
    assert bad > abuse.THRESHOLD > good
    # nothing is flagged where nothing was rated
    assert abuse.train(docs, labels.limit(0)).score(["You are a stupid idiot."])[0][0] < abuse.THRESHOLD
