"""Trees deeper than a few doublings, and cycles."""

import pytest

from regionspark.operators import hierarchy


def test_deep_chain(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, "k") for i in range(120)], "node_id long, parent_id long, kind string")
    assert {(r.node_id, r.ancestor_id, r.distance) for r in hierarchy.ancestors(nodes).collect()} == {(i, j, i - j) for i in range(120) for j in range(i + 1)}
    assert {r.node_id: r.descendants for r in hierarchy.descendant_counts(nodes).collect()} == {i: 119 - i for i in range(120)}
    decided = spark.createDataFrame([(0, "keep")], "node_id long, decision string")
    assert {r.decision for r in hierarchy.effective_decisions(nodes, decided).collect()} == {"keep"}


def test_cycle(spark):
    nodes = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 1)], "node_id long, parent_id long")
    with pytest.raises(ValueError):
        hierarchy.ancestors(nodes)
