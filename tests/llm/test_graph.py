import random

from pageloom.llm.graph import components


def test_components_of_random_graphs_and_long_paths(spark):
    dice = random.Random(4)
    edges = [(dice.randrange(300), dice.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 80)]
    edges += [(7, 7), (3, None)]
    label = {x: x for e in edges for x in e if x is not None}
    for _ in range(len(label)):
        for a, b in edges:
            if b is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and None not in e and e[0] != e[1] for e in edges)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
