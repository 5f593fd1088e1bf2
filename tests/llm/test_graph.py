import random

from corpuslens.llm import graph, shared


def brute(edges):
    up = {x: x for e in edges for x in e}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    return {i: top(i) for i in linked}


def test_components(spark):
    rng = random.Random(1)
    chain = list(range(1000, 1060))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(7, i) for i in range(8, 40)] + [(5, 5), (7, 8), (8, 7), (-3, 2), (90, 91)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(160)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert {r.node: r.component for r in got} == brute(edges) and len(got) == len({r.node for r in got})


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert graph.components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0


def test_tables_are_in_the_shared_folder(spark):
    before = len(shared._tables)
    df = shared.table(spark.range(3), "kept")
    assert df.count() == 3 and shared._tables[before][1].startswith(spark.conf.get("spark.checkpoint.dir"))
