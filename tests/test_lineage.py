"""Closures and consequences against plain Python, and long successions in few rounds."""

import random

from fieldledger.operators import causality, graph


def plain_closure(edges, seeds):
    reached, todo = set(seeds), list(seeds)
    while todo:
        at = todo.pop()
        new = {p for c, p in edges if c == at} - reached
        reached |= new
        todo += new
    return reached


def test_closures(spark):
    rng = random.Random(4)
    for trial in range(4):
        n = 40
        # successions, branches, cycles and edges to itself
        edges = [(i, rng.randrange(n)) for i in range(n) if rng.random() < 0.8] + [(rng.randrange(n), rng.randrange(n)) for _ in range(trial * 8)]
        seeds = rng.sample(range(n), 3)
        frame = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "child string, parent string")
        found = [r["id"] for r in graph.closure(frame, spark.createDataFrame([(f"n{s}",) for s in seeds], "id string")).collect()]
        assert sorted(found) == sorted(f"n{x}" for x in plain_closure(edges, seeds))
    assert graph.closure(frame, frame.selectExpr("child AS id").limit(0)).count() == 0


def test_ten_thousand_successions_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = graph.settled
    monkeypatch.setattr(graph, "settled", lambda rows: rounds.append(1) or real(rows))
    n = 10_000
    edges = spark.range(n).selectExpr("concat('m', id) AS child", "concat('m', id + 1) AS parent").unionByName(spark.range(500).selectExpr("concat('other', id) AS child", "'m7000' AS parent"))
    assert graph.closure(edges, spark.createDataFrame([("m3",)], "id string")).count() == n - 2
    assert len(rounds) <= 3 * 20  # twenty rounds: for each the pointers, what is new, and the union


def plain_impact(memory, served, used, lineage, descent, actors):
    """One step of each relation a round, in order, as it is defined."""
    derived, unattested, decisions = set(), set(), {d for d, m in used if m == memory}
    edges = {("DIRECT", "USED_BY", memory, d) for d in decisions} | {("DIRECT", "SERVED_BY", memory, r) for r, m in served if m == memory}
    changed = True
    while changed:
        before = (len(derived), len(unattested), len(decisions))
        for a, b in lineage:
            if a in (frozen := derived | unattested | {memory}) and frozen:
                edges.add(("DERIVED", "SUPERSEDED_BY", a, b))
        for b in {b for a, b in lineage if a in derived | unattested | {memory}}:
            if b != memory and b not in derived and b not in unattested:
                derived.add(b)
        for d, m in used:
            if m in derived | unattested:
                edges.add(("DERIVED", "USED_BY", m, d))
                decisions.add(d)
        for m, d, who in descent:
            if d in decisions:
                level = "DERIVED" if actors.get(d) == who else "DERIVED_UNATTESTED"
                edges.add((level, "DERIVED_FROM_DECISION", d, m))
                if m != memory:
                    (derived if level == "DERIVED" else unattested).add(m)
        changed = before != (len(derived), len(unattested), len(decisions))
    return edges, {(m, "DERIVED") for m in derived} | {(m, "DERIVED_UNATTESTED") for m in unattested}


def test_impact_equals_stepwise(spark):
    rng = random.Random(5)
    unsure = 0
    for _ in range(4):
        m = [f"m{i}" for i in range(14)]
        decisions = [f"d{i}" for i in range(6)]
        actors = {d: f"a{rng.randrange(2)}" for d in decisions}
        served = [(f"r{i}", x) for i in range(4) for x in rng.sample(m, 3)]
        used = [(d, x) for d in decisions for x in rng.sample(m, 2)]
        lineage = [(a, rng.choice(m)) for a in rng.sample(m, 8)]
        descent = [(x, rng.choice(decisions), f"a{rng.randrange(2)}") for x in rng.sample(m, 7)]
        edges, levels = plain_impact("m0", served, used, lineage, descent, actors)
        found, memories = causality.impact(
            "m0", spark.createDataFrame(served, "receipt_sha256 string, memory_id string"), spark.createDataFrame([(d, actors[d], x) for d, x in used], "decision_id string, actor_id string, memory_id string"),
            spark.createDataFrame(lineage, "memory_id string, successor_id string"), spark.createDataFrame(descent, "memory_id string, decision_id string, declarant string"),
            spark.createDataFrame([], "from_id string, to_id string, link_type string"),
        )
        assert {tuple(r) for r in found.where("level <> 'POSSIBLE'").collect()} == edges
        assert {(r["id"], r["level"]) for r in memories.collect()} == levels
        unsure += len({x for x, level in levels if level == "DERIVED_UNATTESTED"} & {b for a, b in lineage if a in {"m0", *(x for x, _ in levels)}})
    assert unsure  # some were reached both ways


def test_counts_of_all_reaches(spark):
    rng = random.Random(7)
    n = 300
    lineage = [(f"m{a}", f"m{b}") for a in range(n) if rng.random() < 0.6 for b in [rng.randrange(a + 1, n + 5)]]
    used = [(f"d{i}", f"m{rng.randrange(n)}") for i in range(120) for _ in range(2)]
    descent = [(f"m{rng.randrange(n)}", f"d{i}") for i in range(120) if rng.random() < 0.5]  # cycles among them
    edges = [(a, b) for a, b in lineage] + [(m, d) for d, m in used] + [(d, m) for m, d in descent]
    frames = (
        spark.createDataFrame([(d, "a", m) for d, m in used], "decision_id string, actor_id string, memory_id string"), spark.createDataFrame(lineage, "memory_id string, successor_id string"),
        spark.createDataFrame(descent, "memory_id string, decision_id string"),
    )
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reach(x):
        return plain_closure(edges, after[x])

    wanted = {x: (sum(y[0] == "m" for y in reach(x)), sum(y[0] == "d" for y in reach(x))) for x in after if x[0] == "m"}
    found = {r["memory_id"]: (r["derived_memories"], r["derived_decisions"]) for r in causality.reach_counts(*frames).collect()}
    assert found == wanted and max(m for m, _ in wanted.values()) > 30
    # sixteen entries a sketch: the error stays within four of its deviations
    rough = {r["memory_id"]: r["derived_memories"] for r in causality.reach_counts(*frames, entries_log=4).collect()}
    assert rough.keys() == wanted.keys() and all(abs(rough[x] - m) <= 4 * m / 14**0.5 for x, (m, _) in wanted.items())
    assert causality.reach_counts(*[f.limit(0) for f in frames]).count() == 0
