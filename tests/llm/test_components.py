"""Components against a plain union of sets."""
import random

import pytest

from weft.llm.common import components


def brute(edges):
    at = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = at.setdefault(a, {a}), at.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                at[k] = x
    return {k: min(v) for k, v in at.items()}


r = random.Random(3)
CASES = {
    "empty": [],
    "loops and nulls": [(1, 1), (None, 2), (3, None), (4, 4)],
    "stars already": [(5, 1), (1, 7), (9, 8), (9, 8)],
    "chain": [(i, i + 1) for i in range(40)],
    "chain with the smallest in the middle": [(i if i != 20 else -1, i + 1 if i != 19 else -1) for i in range(40)],
    "hub that is not the smallest": [(50, i) for i in range(50)] + [(60, i) for i in range(61, 90)],
    "random": [(r.randrange(300), r.randrange(300)) for _ in range(220)],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_brute_force(spark, name):
    got = components(spark.createDataFrame(CASES[name], "a long, b long")).collect()
    assert len(got) == len({x["id"] for x in got})
    assert {x["id"]: x["label"] for x in got} == brute(CASES[name])
