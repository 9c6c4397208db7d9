import numpy as np
import pytest

from opquality.llm import common
from opquality.llm.components import components, least_labels


def links_and_labels(seed):
    """Random links between few nodes, negative ones too, and the labels a plain search gives."""
    rng = np.random.default_rng(seed)
    nodes = rng.integers(-(1 << 62), 1 << 62, 120)
    links = [(int(nodes[a]), int(nodes[b])) for a, b in rng.integers(0, 120, (70, 2))]
    label = {n: n for link in links for n in link if link[0] != link[1]}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    return links, label


@pytest.mark.parametrize("seed", range(5))
def test_labels_of_one_task(seed):
    links, label = links_and_labels(seed)
    a, b = (np.array(x) for x in zip(*[link for link in links if link[0] != link[1]]))
    assert dict(zip(*(x.tolist() for x in least_labels(a, b)))) == label


@pytest.mark.parametrize("rows_a_task", [8, 200_000])
def test_components_of_one_and_of_several_tasks(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(common, "ROWS_A_TASK", rows_a_task)
    links, label = links_and_labels(7)
    found = components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {r.node: r.label for r in found} == label and len(found) == len(label)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows_are_counted_as_they_are_written(spark):
    for rows in (0, 1, 500):
        out, count = common.cut_counted(spark.range(rows).selectExpr("id % 400 AS id").distinct())
        assert count == out.count() == min(rows, 400)


def test_few_links_take_few_jobs(spark):
    """A driver keeps what it knows of each job; a path of links took rounds of some ten."""
    context = spark.sparkContext
    links = spark.createDataFrame([(n, n + 1) for n in range(500)], "a long, b long")
    context.setJobGroup("few-links", "components of a path")
    try:
        assert {r.label for r in components(links).collect()} == {0}
        assert len(context.statusTracker().getJobIdsForGroup("few-links")) <= 6
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
