"""Phase rules as data against a plain loop over entries."""

import random

import pytest

from tracelens.operators import timeline as L

REGIONS = [f"r{k}" for k in range(9)] + ["Unmapped"]


def brute(entries, rules):
    """Entries (pos, region, us) of one trace: the phases (rule, start, end, entries), and the moments claimed."""
    claimed, out = set(), []
    for k, (_, required, optional, least) in enumerate(rules):
        own = [e for e in entries if e[2] not in claimed and e[1] in {*required, *optional}]
        first = {}
        for pos, region, _ in own:
            first[region] = min(pos, first.get(region, pos))
        seen = [first[r] for r in optional if r in first]
        if len(own) >= max(least, 1) and all(r in first for r in required) and all(a < b for a, b in zip(seen, seen[1:])):
            claimed |= {us for _, _, us in own}
            out.append((k, min(e[2] for e in own), max(e[2] for e in own), len(own)))
    return out, claimed


def made(rng, n):
    return [(f"phase {k}", rng.sample(REGIONS, rng.randrange(0, 3)), rng.sample(REGIONS, rng.randrange(0, 4)), rng.randrange(0, 6)) for k in range(n)]


@pytest.mark.parametrize("seed, n", [(1, 6), (2, 40), (3, 500)])
def test_rules_of_a_table_against_brute_force(spark, seed, n):
    rng = random.Random(seed)
    rules = made(rng, n)
    traces = {t: [(k + 1, rng.choice(REGIONS[: rng.randrange(2, 11)]), rng.randrange(1 + k // 2)) for k in range(rng.randrange(1, 60))] for t in range(12)}
    frame = spark.createDataFrame([(t, *e) for t, rows in traces.items() for e in rows], "trace_id INT, pos INT, region STRING, us LONG").repartition(3)
    table = L.rule_table(spark, rules)
    want = {t: brute(rows, rules) for t, rows in traces.items()}
    found = sorted((r.trace_id, int(r.phase.split()[1]), r.start_us, r.end_us, r.entry_count) for r in L.detect_phases(frame, table).collect())
    assert found == sorted((t, *p) for t, (phases, _) in want.items() for p in phases)
    scores = {r.trace_id: (r.phases, r.claimed_moments, r.moments) for r in L.phase_confidence(frame, table).collect()}
    assert scores == {t: (len(phases), len(claimed), len({e[2] for e in traces[t]})) for t, (phases, claimed) in want.items()}


def test_the_plan_does_not_grow_with_the_rules(spark, tmp_path):
    frame = spark.createDataFrame([(1, 1, "r1", 5)], "trace_id INT, pos INT, region STRING, us LONG")
    sizes = []
    for n in (5, 500):
        L.rule_table(spark, made(random.Random(n), n)).write.parquet(f"{tmp_path}/{n}")
        plan = L.detect_phases(frame, spark.read.parquet(f"{tmp_path}/{n}"))._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("\n"))
    assert sizes[0] == sizes[1] and "Window" not in plan.split("row_number")[-1]


def test_rules_without_regions_and_null_lists(spark):
    frame = spark.createDataFrame([(1, 1, "r1", 5), (2, 1, "r2", 5)], "trace_id INT, pos INT, region STRING, us LONG")
    table = spark.createDataFrame([(3, "late", ["r1"], None, None), (1, "none", None, None, 0), (2, "early", ["r1"], [], 1)], L.RULE)
    assert [(r.trace_id, r.phase) for r in L.detect_phases(frame, table).collect()] == [(1, "early")]
    assert sorted((r.trace_id, r.phase, r.matched) for r in L.rule_matches(frame, table).collect()) == [(t, p, (t, p) == (1, "early")) for t in (1, 2) for p in ("early", "late", "none")]
