import random

import pytest

from loreforge.operators import hierarchy as tree
from loreforge.operators.recurrence import chain_lengths

SCHEMA = "id long, parent long"


def brute(links):
    out = {}
    for i in links:
        trail, at = [i], i
        while True:
            p = links[at]
            if p is None:
                out[i] = (at, len(trail) - 1, "tree", trail[::-1])
                break
            if p not in links:
                out[i] = (at, len(trail) - 1, "open", trail[::-1])
                break
            if p in trail:
                k = trail.index(p)
                out[i] = (min(trail[k:]), k, "cycle", trail[: k + 1][::-1])
                break
            trail.append(p)
            at = p
    return out


def graph(seed, n=60):
    r = random.Random(seed)
    links = {}
    for i in range(1, n + 1):
        x = r.random()
        links[i] = None if x < 0.15 else 900 + i if x < 0.2 else r.randint(1, n) if x < 0.45 else max(1, i - r.randint(1, 2))
    links[n] = n  # names itself
    return links


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    links = graph(seed)
    df = spark.createDataFrame(list(links.items()), SCHEMA)
    want = brute(links)
    got = {r["id"]: r for r in tree.hierarchy(df).collect()}
    assert {i: (r["root_id"], r["depth"], r["status"], r["path"]) for i, r in got.items()} == want
    below = {i: sum(i in w[3][:-1] for w in want.values()) for i in want}
    assert {i: r["descendants"] for i, r in got.items()} == below


def test_descendants(spark):
    links = graph(7, 40)
    df = spark.createDataFrame(list(links.items()), SCHEMA)
    want = {(a, i, len(w[3]) - 1 - k) for i, w in brute(links).items() for k, a in enumerate(w[3][:-1])}
    assert {tuple(r) for r in tree.descendants(df).collect()} == want


def test_long_chain_and_star(spark):
    links = {i: i - 1 if i > 1 else None for i in range(1, 301)} | {i: 1 for i in range(1001, 1200)}
    df = spark.createDataFrame(list(links.items()), SCHEMA)
    got = {r["id"]: r for r in tree.resolve(df).collect()}
    assert got[300]["depth"] == 299 and got[300]["root_id"] == 1 and got[1]["size"] == len(links)


def test_nulls_repeats_clashing_columns_and_empty(spark):
    rows = [(None, 1, "x"), (1, None, "y"), (2, 1, "z"), (2, 1, "z"), (2, None, "w")]
    df = spark.createDataFrame(rows, "id long, parent long, root string")
    got = {r["id"]: (r["root_id"], r["depth"]) for r in tree.resolve(df).collect()}
    assert got == {1: (1, 0), 2: (1, 1)}
    empty = spark.createDataFrame([], SCHEMA)
    assert tree.resolve(empty).count() == 0 and tree.hierarchy(empty).count() == 0 and tree.descendants(empty).count() == 0


def test_chain_lengths(spark):
    links = [(1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 6)]
    got = {r["id"]: r["recurrence"] for r in chain_lengths(spark.createDataFrame(links, "id long, repeats long")).collect()}
    assert got == {2: 2, 3: 3, 4: 2, 5: 2, 6: 2, 7: 3}


def test_located_takes_root_and_depth_from_chains(spark, data, monkeypatch):
    from loreforge.plans import general

    links = graph(5)
    want = {i: w[:3] for i, w in brute(links).items()}
    assert {r["id"]: (r["root_id"], r["depth"], r["status"]) for r in tree.located(spark.createDataFrame(list(links.items()), SCHEMA)).collect()} == want
    called, paths = [], tree.heavy_chains
    monkeypatch.setattr(tree, "heavy_chains", lambda *a: called.append(a) or paths(*a))
    assert general.p5_found(spark, data).count() > 0 and called
