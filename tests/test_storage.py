"""Connected components and shared folders."""

import logging
import os
import random
import re

import pytest

from lociloom import storage


def plain(edges):
    up = {}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {v: top(v) for v in up}


@pytest.mark.parametrize("one_task", [0, 20, 10**6])
def test_components_against_plain(spark, one_task):
    rng = random.Random(one_task)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(140)] + [("z", "z"), (None, "q"), ("n1", None), *(("hub", f"h{i}") for i in range(50))]
    got = storage.components(spark.createDataFrame(edges, "a string, b string"), one_task).collect()
    assert {r["v"]: r["label"] for r in got} == plain(edges) and len(got) == len(plain(edges))


def test_rounds_on_a_long_path(spark, caplog, tmp_path):
    rng = random.Random(1)
    names = list(range(100_000))
    rng.shuffle(names)
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    with caplog.at_level(logging.DEBUG, "lociloom"):
        got = storage.components(edges, one_task=2_000)
    assert got.count() == 100_000 and got.where("label != 0").isEmpty()
    rounds = int(re.search(r"components: (\d+) rounds", caplog.text)[1])
    assert 3 <= rounds <= 15
    folder = os.path.dirname(got.inputFiles()[0].removeprefix("file://"))
    assert os.listdir(os.path.dirname(folder)) == ["done"]


def test_no_edges(spark):
    assert storage.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_scratch_and_clean(spark):
    path = storage.scratch(spark, "some")
    storage.written(spark.range(3), path)
    assert os.path.isdir(path.removeprefix("file://"))
    storage.drop(spark, path)
    assert not os.path.isdir(path.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda k, d=None: None)

    class Far:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        storage.scratch(Far(), "x")
