"""Votes against brute force where one bug and one test case each hold a third of the links."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from rankjobs.operators import vote

HOT_BUG, HOT_CASE = 0, 999


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    links = {(HOT_BUG, t) for t in range(100)}
    links |= {(b, HOT_CASE) for b in range(1, 101)}
    while len(links) < 300:
        links.add((rng.randrange(1, 60), rng.randrange(200)))
    neighbours = []
    for q in range(12):
        others = [b for b in rng.sample(range(1, 60), 6)] + ([HOT_BUG] if q % 3 == 0 else [])
        rng.shuffle(others)
        neighbours += [(q, b, round(rng.random(), 2), p) for p, b in enumerate(others, 1)]
    return sorted(links), neighbours


@pytest.fixture()
def frames(spark, data):
    links, neighbours = data
    return (
        spark.createDataFrame(neighbours, "query_id bigint, bug_id bigint, hybrid_score double, hybrid_rank int").repartition(5),
        spark.createDataFrame([(b, t, f"t{t}") for b, t in links], "bug_id bigint, testcase_id bigint, testcase_title string").repartition(3),
    )


def tallies(data):
    """query -> test case -> [score sum, bugs, bonus by bug position, bonus by ballot]"""
    links, neighbours = data
    of = defaultdict(list)
    for b, t in links:
        of[b].append(t)
    out = defaultdict(lambda: defaultdict(lambda: [0.0, 0, 0.0, 0.0]))
    ballots = defaultdict(int)
    for q, b, score, position in sorted(neighbours, key=lambda n: (n[0], n[3])):
        for t in sorted(of[b]):
            ballots[q] += 1
            row = out[q][t]
            row[0] += score
            row[1] += 1
            row[2] += 1 / position
            row[3] += 1 / ballots[q]
    return out


def got(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.testcase_id)
    return out


def final(row, bonus):
    return round(0.7 * round(row[0], 9) + 0.2 * row[1] + 0.1 * round(row[bonus], 9), 12)


def test_score_vote(frames, data):
    found = got(vote.vote_by_score(*frames, 10))
    for q, rows in tallies(data).items():
        want = sorted(rows, key=lambda t: (-round(rows[t][0], 9), -rows[t][1], t))
        assert found[q] == want[:10]


def test_position_vote(frames, data):
    found = got(vote.vote_by_position(*frames, 10))
    for q, rows in tallies(data).items():
        want = sorted(rows, key=lambda t: (-final(rows[t], 2), -round(rows[t][0], 9), -rows[t][1], t))
        assert found[q] == want[:10]


def test_ballot_vote_keeps_every_candidate(frames, data):
    found = got(vote.vote_by_ballot(*frames))
    for q, rows in tallies(data).items():
        want = sorted(rows, key=lambda t: (-final(rows[t], 3), -round(rows[t][0], 9), -rows[t][1], t))
        assert found[q] == want


@pytest.mark.parametrize("parts", [1, 17])
def test_partitioning_does_not_matter(frames, parts):
    neighbours, links = frames
    again = vote.vote_by_ballot(neighbours.repartition(parts), links.repartition(parts), k=7)
    assert got(again) == got(vote.vote_by_ballot(neighbours, links, k=7))
