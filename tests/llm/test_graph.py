import random

from draftspark.llm.graph import components


def test_components(llm):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = {r["node"]: r["root"] for r in components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0
