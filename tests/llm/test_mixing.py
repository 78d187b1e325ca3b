from __future__ import annotations

from collections import defaultdict

from rankjobs.llm import mixing, thresholds
from tests.llm.conftest import HOSTILE, sentence


def test_budgets_against_sorting(spark):
    import random

    r = random.Random(1)
    rows = [(g, r.randrange(1 << 24), r.randrange(5)) for g in range(4) for _ in range(300)] + [(9, 5, 0), (10, 7, 3)]
    budgets = [(0, 100.0), (1, 0.0), (2, 1e9), (3, 333.3), (9, 1.0), (10, None)]
    got = dict(
        thresholds.cuts(
            spark.createDataFrame(rows, "g bigint, key bigint, weight bigint"), spark.createDataFrame(budgets, "g bigint, budget double"), 24
        ).collect()
    )
    for g, budget in budgets:
        taken = sum(w for h, k, w in rows if h == g and k < got[g])
        sums, total = [0], defaultdict(int)
        for h, k, w in rows:
            if h == g:
                total[k] += w
        for k in sorted(total):
            sums.append(sums[-1] + total[k])
        assert abs(taken - min(budget or 0, sums[-1])) == min(abs(s - min(budget or 0, sums[-1])) for s in sums)


def test_targets_and_shares(docs_of):
    rows = [(i, sentence(i % 40 + 1, i), "abcd"[i % 4] if i % 9 else "a") for i in range(1, 1200)]
    result = mixing.mix(docs_of(rows)).collect()
    total = sum(r["size"] for r in result)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in result}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 * total
    assert all(t <= 3 * s + 1e-6 for t, s in targets.values())
    taken = defaultdict(int)
    for r in result:
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 20 for s, (t, _) in targets.items())
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(docs_of(rows[::-1]).repartition(5)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in result}


def test_capped_targets_are_shared_again(docs_of):
    rows = [(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, "w " * 1000, "c")]
    targets = {r["source"]: r["target"] for r in mixing.mix(docs_of(rows)).collect()}
    assert targets["a"] == 30
    assert abs(targets["b"] - 1980 * 2 / 3) < 1e-9 and abs(targets["c"] - 1980 / 3) < 1e-9


def test_hostile_rows(hostile, nothing):
    result = mixing.mix(hostile).collect()
    assert len(result) == len(HOSTILE)
    assert {r["size"] for r in result if r["doc_id"] in (2, 3, 10)} == {0}
    assert all(r["taken"] <= 3 * r["size"] for r in result)
    mixed = mixing.mixed_documents(hostile)
    assert mixed.columns == hostile.columns
    assert mixed.count() == sum(min(3, r["copies"]) for r in result)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_all_texts_empty(docs_of):
    assert {(r["taken"], r["target"]) for r in mixing.mix(docs_of([(1, None, "a"), (2, "", None)])).collect()} == {(0, 0.0)}


def test_main_path_is_native(docs_of, capsys):
    mixing.mix(docs_of([(1, "a b", "x")])).explain(True)
    assert "Python" not in capsys.readouterr().out


def test_empty_texts_have_no_fourth_copy(spark, docs_of):
    rows = [(i, None, "a") for i in range(50)] + [(100, "w " * 10, "a"), (101, "w " * 9000, "b"), (102, "w " * 9000, "c")]
    mixed = mixing.mixed_documents(docs_of(rows))
    assert mixed.filter("source = 'a'").groupBy("doc_id").count().agg({"count": "max"}).first()[0] == 3
