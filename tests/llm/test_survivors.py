import datetime as dt
import random
from collections import defaultdict

import pytest

from pairweave.llm.survivors import FieldRule, field_winners

RULES = {"seq_len": FieldRule(1_000, 3_000_000), "no_parts": FieldRule(1, 500)}
RECORD = "rec_id long, id string, seq_len long, no_parts int, provider string, updated_at timestamp, rank int"
TRUST = [("Ternvault", 1), ("Mill-Brook", 2), ("mill brook", 3), ("Kestrel", 2), ("???", 1), (None, 1)]
RANK = {"ternvault": 1, "millbrook": 2, "kestrel": 2}


def frames(spark, records, members):
    return (
        spark.createDataFrame(records, RECORD),
        spark.createDataFrame(members, "id string, `group` long, field int"),
        spark.createDataFrame(TRUST, "provider string, trust_rank int"),
    )


def expected(records, members):
    group = {i: g for i, g, _ in members if i is not None and g is not None}
    by = defaultdict(list)
    for r in records:
        if r[1] in group:
            by[group[r[1]]].append(r)
    out = {}
    for g, rs in by.items():
        best = []
        for col, low, high in ((2, 1_000, 3_000_000), (3, 1, 500)):
            usable = [r for r in rs if r[col] is not None and low <= r[col] <= high]

            def order(r):
                name = "".join(c for c in (r[4] or "").lower() if c.isalnum())
                return (RANK.get(name, 99), -(r[5].timestamp() if r[5] else -1e18), r[0])

            best.append(min(usable, key=order)[0] if usable else 0)
        out[g] = (len(rs), *best)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    day = dt.datetime(2024, 1, 1)
    records = []
    for i in range(400):
        obj = rng.choice([None, "hot", "hot", "hot"] + [f"o{k}" for k in range(40)])
        records.append((i + 1, obj, rng.choice([None, -1, 0, 999, 1000, 5000, 3_000_000, 3_000_001, 2147483647]), rng.choice([None, 0, 1, 7, 500, 501]), rng.choice([None, "", "?", "KESTREL", "mill_brook ", "Ternvault.", "else"]), rng.choice([None, day, day + dt.timedelta(days=rng.randint(0, 3))]), 5))
    members = [("hot", 1, 0), ("hot", 1, 0), (None, 2, 0), ("o0", None, 0)] + [(f"o{k}", k // 3, 0) for k in range(1, 38)]
    got = {r["group"]: (r["n_records"], r["seq_len_rec"], r["no_parts_rec"]) for r in field_winners(*frames(spark, records, members), RULES).collect()}
    assert got == expected(records, members)


def test_votes_add_up(spark):
    day = dt.datetime(2024, 1, 1)
    records = [(1, "a", 2000, 1, "Ternvault", day, 0), (2, "a", 3000, 2, "Kestrel", day, 0), (3, "a", 3000, 2, "Kestrel", day, 0), (4, "a", 3000, 3, "Kestrel", day - dt.timedelta(days=300), 0)]
    f = frames(spark, records, [("a", 1, 0)])
    by_order, by_votes = field_winners(*f, RULES).first(), field_winners(*f, RULES, rule="votes").first()
    assert (by_order["seq_len_rec"], by_order["seq_len_value"]) == (1, 2000)
    assert by_votes["seq_len_value"] == 3000 and by_votes["seq_len_rec"] == 2
    assert abs(by_votes["seq_len_votes"] - (1 + 0.5 * 2**-10)) < 1e-9
    with pytest.raises(ValueError):
        field_winners(*f, RULES, rule="best")


def test_empty(spark):
    assert field_winners(*frames(spark, [], []), RULES).collect() == []
