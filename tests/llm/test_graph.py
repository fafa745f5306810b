import random

from marketprose.llm.graph import components


def by_hand(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in parent}


def test_components(spark):
    r = random.Random(3)
    chain = [(k, k + 1) for k in range(1000, 1200)]
    star = [(5000, k) for k in range(5001, 5200)]
    loose = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(200)]
    links = chain + star + loose + loose[:20] + [(7, 7), (None, 8), (9, None), (-5, 3)]
    r.shuffle(links)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == by_hand(links)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
