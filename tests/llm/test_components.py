"""Connected components: the same on any ids, in logarithmic rounds."""

import random

import pytest

from pagewatch.llm import components


def rounds_and_groups(spark, links, monkeypatch):
    """Rounds taken and the components found."""
    taken, write = [], components.write_through
    monkeypatch.setattr(components, "write_through", lambda df, label: taken.append(label) or write(df, label))
    found: dict[int, list[int]] = {}
    for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect():
        found.setdefault(r.root, []).append(r.node)
    return taken.count("cc-choice"), sorted(sorted(g) for g in found.values())


@pytest.mark.parametrize("turned", [False, True])
def test_ordered_chain_takes_logarithmic_rounds(spark, monkeypatch, turned):
    n = 4096
    links = [(i + 1, i) if turned else (i, i + 1) for i in range(n - 1)]
    rounds, groups = rounds_and_groups(spark, links, monkeypatch)
    assert groups == [list(range(n))] and rounds <= 14


def test_any_links(spark, monkeypatch):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7)]
    group = {x: {x} for pair in links if pair[0] != pair[1] for x in pair}
    for a, b in links:
        if a != b and group[a] is not group[b]:
            merged = group[a] | group[b]
            for x in merged:
                group[x] = merged
    _, groups = rounds_and_groups(spark, links, monkeypatch)
    assert groups == sorted(map(list, {tuple(sorted(g)) for g in group.values()}))
