"""Components by union-find: hubs of either kind, long chains, random links."""

import random

import pytest

from quern.llm.graph import connected_components


def brute(links):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("kind", ["least hub", "greatest hub", "chain", "random", "hubs and chains"])
def test_components(spark, kind):
    rng = random.Random(3)
    links = {
        "least hub": [(0, i) for i in range(1, 3000)],
        "greatest hub": [(9999, i) for i in range(1, 3000)],
        "chain": [(i, i + 1) for i in range(700)],
        "random": [(rng.randrange(4000), rng.randrange(4000)) for _ in range(3000)],
        "hubs and chains": [(10**6 + k, 5 * k + i) for k in range(50) for i in range(6)] + [(rng.randrange(10**9), 77) for _ in range(500)],
    }[kind]
    links = [(a, b) for a, b in links if a != b]
    got = {r["id"]: r["component"] for r in connected_components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute(links)
