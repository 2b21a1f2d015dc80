"""Connected components: results against a plain search, and what a call costs the driver."""

import random

import pytest

from parcelio.llm import components as C


def brute(links):
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    label = {}
    for node in sorted(near):
        todo = [node] if node not in label else []
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = node
                todo += near[x]
    return sorted(label.items())


@pytest.fixture
def labels(monkeypatch):
    seen, written = [], C.written
    monkeypatch.setattr(C, "written", lambda table, label: (seen.append(label), written(table, label))[1])

    def run(links):
        seen.clear()
        return sorted((r.node, r.label) for r in C.components(links).collect()), list(seen)

    return run


def test_stars_around_their_least_nodes_need_no_round(spark, labels):
    links = [(0, k) for k in range(1, 40)] + [(k, 0) for k in range(1, 9)] + [(-7, 50), (None, 3), (60, 60)]
    assert labels(spark.createDataFrame(links, "a long, b long")) == (brute(links), ["labels"])
    assert labels(spark.createDataFrame([], "a long, b long")) == ([], ["labels"])


def test_no_round_follows_the_last_change(spark, labels):
    links = [(20, k) for k in range(1, 20)]  # the centre is the largest
    assert labels(spark.createDataFrame(links, "a long, b long")) == (brute(links), ["stars", "labels"])


def test_odd_links(spark, labels):
    rng = random.Random(3)
    for n, m in ((40, 30), (40, 45), (200, 190)):
        links = [(rng.randrange(n) - 20, rng.randrange(n) - 20) for _ in range(m)] + [(None, 1), (2, None), (None, None)]
        links += rng.sample(links, 9) + [(b, a) for a, b in rng.sample(links, 9)]
        assert labels(spark.createDataFrame(links, "a long, b long"))[0] == brute(links)


def test_a_round_has_few_exchanges(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2)], "u long, v long")
    plan = C._small_star(C._large_star(edges))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 7  # of which two are read again
