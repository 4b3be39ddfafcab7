"""Components and clusters longer than a bounded number of hops."""

import random

import pytest

from tracelake.operators import anomaly, graph


def test_long_chain_is_one_component(spark):
    names = [f"s{i:03}" for i in range(130)]
    random.Random(4).shuffle(names)
    rows = [*zip(names[:-1], names[1:], strict=True), ("x", "y"), ("z", "z")]
    out = {r.service: r.label for r in graph.components(spark.createDataFrame(rows, "source string, target string")).collect()}
    assert out == dict.fromkeys(names, "s000") | {"x": "x", "y": "x", "z": "z"}


def test_long_cluster_is_one(spark):
    rows = [(i, i * 0.4, 0.0) for i in range(120)] + [(500, 0.0, 9.0)]
    out = {r.id: r.cluster for r in anomaly.density_noise(spark.createDataFrame(rows, "id long, x double, y double"), "id", "x", "y", 0.5, 3).collect()}
    assert out.pop(500) is None and len(out) == 120 and set(out.values()) == {1}


def test_unsettled_labels_raise(spark):
    chain = spark.createDataFrame([(f"s{i:03}", f"s{i + 1:03}") for i in range(60)], "source string, target string")
    with pytest.raises(RuntimeError):
        graph.components(chain, rounds=2)
