import random

import numpy as np

from pairweave.llm.leaks import NAME, UNIT, hash_filter, shared_windows, slot_lexicon
from pairweave.llm.text import words

NAMES, UNITS, GOODS = ["Urid", "Tamsen", "Zorin", "Quilo"], ["tubs", "casks", "bales"], ["clay", "salt", "tin"]


def item(rng):
    a, b, u, v = rng.choice(NAMES), rng.choice(NAMES), rng.choice(UNITS), rng.choice(UNITS)
    return f"A courier called {a} buys {rng.randint(2, 99)} {u} of {rng.choice(GOODS)} near the old harbour. Half of it goes by night to {b}, but {rng.randint(2, 99)} {v} are lost on the way. Who owes {a} the remaining {rng.randint(2, 99)} {u} of {rng.choice(GOODS)}?"


def brute(docs, items, n):
    found = set()
    for d, t in docs:
        dw = words(t or "")
        have = {tuple(dw[k : k + n]) for k in range(len(dw) - n + 1)}
        for i, x in items:
            iw = words(x or "")
            if any(tuple(iw[k : k + n]) in have for k in range(len(iw) - n + 1)):
                found.add((d, i))
    return found


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "id long, text string")


def corpus():
    rng = random.Random(4)
    items = [(i, item(rng)) for i in range(30)] + [(98, None), (99, ""), (97, "too short")]
    docs = [(1, None), (2, ""), (3, items[0][1]), (4, "x " * 5000 + items[1][1].upper() + " y" * 5000), (5, items[0][1])]
    for k in range(10, 60):
        text = items[rng.randrange(30)][1].split(" ")
        a = rng.randrange(len(text))
        part = text[a : a + rng.choice([8, 12, 13, 14, 30])]
        docs.append((k, "before " + rng.choice([" ", "\n> ", " [b]", "&nbsp;", "<br />\n", " “"]).join(part) + " after"))
    return docs, items


def test_exact_windows(spark):
    docs, items = corpus()
    for n in (5, 13):
        want = brute(docs, items, n)
        for bits in (1 << 10, 1 << 28):  # a full filter lets everything through to the join
            got = {(r["doc_id"], r["item_id"]) for r in shared_windows(*frames(spark, docs, items), n, exact=True, filter_bits=bits).collect()}
            assert got == want


def test_retold_items(spark):
    items = [(i, item(random.Random(i))) for i in range(30)]
    told = items[3][1]
    swap = {"Urid": "Zorin", "Tamsen": "Urid", "Zorin": "Quilo", "Quilo": "Tamsen"}
    other = " ".join(swap.get(w.strip(",.?"), w) if not w.isdigit() else str(int(w) + 100) for w in told.split(" "))
    muddled = other.replace("Who owes", "Who owes Urid and")
    docs = [(1, told), (2, other), (3, "nothing of the kind " * 20), (4, muddled)]
    got = shared_windows(*frames(spark, docs, items), 24, exact=False).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 4}
    assert any(r["same"] and r["item_id"] == 3 for r in got if r["doc_id"] == 1)
    assert any(not r["same"] and r["item_id"] == 3 for r in got if r["doc_id"] == 2)


def test_slots_must_be_consistent(spark):
    one = "then Urid met Tamsen and later Urid left Tamsen behind with 5 tubs and 6 tubs here"
    texts = [(1, one), (2, one.replace("Urid", "Zorin")), (3, "then Zorin met Tamsen and later Quilo left Tamsen behind with 5 tubs and 6 tubs here")]
    items = [(9, one + ". " + "So Zorin saw Quilo, and Tamsen saw Urid.")]
    got = {r["doc_id"] for r in shared_windows(*frames(spark, texts, items), 16, exact=False).collect()}
    assert got == {1, 2}


def test_retold_with_words_no_item_has(spark):
    items = [(i, item(random.Random(i))) for i in range(30)]
    swap = dict(zip(NAMES + UNITS, ["Bramwell", "Odessa", "Fitch", "Harbour", "flasks", "pods", "kegs"]))
    text = " ".join(swap.get(w.strip(",.?"), w) if not w.isdigit() else w + ".5" for w in items[3][1].split(" "))
    glued = text.replace(".5 ", ".5")
    docs = [(1, text), (2, text.lower()), (3, glued), (4, text.replace("courier", "smith").replace("goes", "went").replace("lost", "sold"))]
    for bits in (1 << 10, 1 << 28):
        got = {r["doc_id"] for r in shared_windows(*frames(spark, docs, items), 24, exact=False, filter_bits=bits).filter("item_id = 3").collect()}
        assert got == {1, 2, 3}


def test_recall_of_retold_items(spark):
    """Every item told again with names, numbers and units of its own, in a text of other words."""
    rng = random.Random(9)
    items = [(i, item(random.Random(i))) for i in range(40)]
    docs = []
    for i, text in items:
        fresh = {w: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for w in NAMES + UNITS}
        told = " ".join(fresh.get(w.strip(",.?"), w) if not w.isdigit() else str(rng.randint(100, 999)) for w in text.split(" "))
        docs.append((i, "as heard in town " + told + " or so they say"))
    docs += [(1000 + i, " ".join(rng.choice("the of by night to are lost on way half it goes who owes near old".split()) for _ in range(200))) for i in range(40)]
    got = {(r["doc_id"], r["item_id"]) for r in shared_windows(*frames(spark, docs, items), 24, exact=False).collect()}
    assert sum((i, i) in got for i, _ in items) >= 0.9 * len(items)
    assert not any(d >= 1000 for d, _ in got)


def test_filter_says_yes_to_all_its_hashes(spark):
    rng = random.Random(2)
    some, others = ([rng.randrange(-(1 << 63), 1 << 63) for _ in range(5_000)] for _ in range(2))
    rows = spark.createDataFrame([(x,) for x in some], "h long")
    for bits in (1 << 12, 1 << 28):
        passes = hash_filter(rows, "h", most_bits=bits)
        assert passes(np.array(some, np.int64)).all()
    assert passes(np.array(others, np.int64)).mean() < 0.1


def test_retold_without_four_plain_words(spark):
    one = "then Urid met Tamsen and Zorin saw Quilo but Urid hit Zorin"
    items = [(9, one), (8, "while Urid , Tamsen , Zorin , Quilo")]
    docs = [(1, "then Ann met Bea and Cid saw Dot but Ann hit Cid"), (2, "then Ann met Bea and Cid saw Dot but Ann hit Bea")]
    assert {r["doc_id"] for r in shared_windows(*frames(spark, docs, items), 12, exact=False).collect()} == {1}


def test_lexicon(spark):
    items = [(i, item(random.Random(i))) for i in range(30)]
    got = {r["word"]: r["slot"] for r in slot_lexicon(frames(spark, [], items)[1]).collect()}
    assert {w for w, s in got.items() if s == NAME} == {n.lower() for n in NAMES}
    assert {w for w, s in got.items() if s == UNIT} == set(UNITS)


def test_empty(spark):
    assert shared_windows(*frames(spark, [], []), 13, exact=True).collect() == []
    assert shared_windows(*frames(spark, [(1, "a")], [(1, "b")]), 13, exact=True).collect() == []
