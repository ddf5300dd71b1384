"""Connected components against union-find, with stars that are joined apart and without."""

import random

import pytest

from bitloom.llm.graph import components


def plain(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("crowd", [50, 1_000_000])
def test_stars_chains_and_repeats(spark, crowd):
    rng = random.Random(8)
    low_star = [(-5, k) for k in range(1_000, 4_000)]
    high_star = [(10_000_000, k) for k in range(3_900, 6_000)]  # shares leaves with the first one, its centre is the greatest node
    chain = [(20_000 + k, 20_001 + k) for k in range(70)]
    drawn = [(30_000 + rng.randrange(900), 30_000 + rng.randrange(900)) for _ in range(700)]
    edges = low_star + high_star + chain + drawn + chain[:9] + [(7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), crowd=crowd).collect()}
    want = plain([e for e in edges if e[0] != e[1]])
    assert {x: got.get(x, x) for x in want} == want and got.keys() <= want.keys()
    assert components(spark.createDataFrame([(None, 1), (2, 2)], "u long, v long"), crowd=crowd).count() == 0
