"""Co-occurrence over narrow and wide bugs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from rankjobs.operators import cooccur


@pytest.mark.parametrize("settings", [{}, {"least_wide": 0, "block_cases": 3}, {"least_wide": 9, "block_cases": 4, "cell_links": 7}])
def test_narrow_and_wide_bugs(spark, settings):
    rng = random.Random(8)
    links = {(0, t) for t in range(0, 40, 2)} | {(1, t) for t in range(0, 40, 3)}
    links |= {(rng.randrange(2, 40), rng.randrange(40)) for _ in range(120)}
    counts = defaultdict(Counter)
    of = defaultdict(set)
    for b, t in links:
        of[b].add(t)
    for own in of.values():
        for a in own:
            counts[a].update(own - {a})
    want = {
        (a, t, n, place)
        for a, c in counts.items()
        for place, (t, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:6], 1)
    }
    frame = spark.createDataFrame(sorted(links) * 2, "bug_id bigint, testcase_id bigint").repartition(3)
    assert {tuple(r) for r in cooccur.co_occurrence(frame, 6, **settings).collect()} == want


def test_links_of_narrow_bugs_are_not_copied_to_all_blocks(spark):
    """As many blocks as there are test cases: links were copied to each of them."""
    frame = spark.createDataFrame([(t // 2, t) for t in range(60)], "bug_id bigint, testcase_id bigint")
    found = cooccur.co_occurrence(frame, 3, block_cases=1)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert sorted((r.testcase_id, r.other_testcase_id) for r in found.collect()) == [(t, t ^ 1) for t in range(60)]
