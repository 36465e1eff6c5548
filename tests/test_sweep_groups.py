"""Small groups are sorted once; large ones are split, and large ones in which nothing is told are not sorted."""

import random

from pyspark.sql import functions as F

from fieldledger.operators import authority, replay, sweeps


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_groups_of_all_kinds(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("hot" if i % 3 == 0 else "mute" if i % 3 == 1 else None if i % 7 == 0 else f"g{i % 40}", rng.randrange(200), i) for i in range(900)]
    rows = [(g, p, int(g == "mute" or i % 2), 0 if g == "mute" or i % 2 else rng.randrange(-3, 5), i) for g, p, i in rows]
    wanted = {i: (sum(r[3] for r in rows if r[0] == g and not r[2] and r[1] <= p), max((r[1] for r in rows if r[0] == g and not r[2] and r[1] <= p), default=None)) for g, p, a, _, i in rows if a}
    df = spark.createDataFrame(rows, "g string, p int, a int, d int, i int")

    def found():
        out = sweeps.swept(df, F.col("a") == 1, ["g"], ["p", "a"], total=("sum", F.col("d")), last=("max", F.when(F.col("a") == 0, F.col("p"))))
        return {r["i"]: (r["total"], r["last"]) for r in out.collect()}, plan_of(out)

    plain, plan = found()
    assert plain == wanted and "_range" not in plan  # no ranges, no second deal
    monkeypatch.setattr(sweeps, "MOST", 100)
    assert found()[0] == wanted


def test_an_ask_is_one_row(spark):
    """No ask is repeated for each capability; odd chains give what grants, windows and errors give."""
    rng = random.Random(8)
    kinds = ["GRANTED", "REVOKED", "ACTOR_QUARANTINED", "ACTOR_REINSTATED"]
    caps = ['["STORE"]', '["GRANT","STORE"]', '["STORE","GRANT"]', "[]", '["NOPE"]', None]
    rows = []
    for s in range(30):
        for seq in range(12):
            kind, gid = rng.choice([*kinds, "GRANTED"]), rng.choice(["g1", "g2", "g3", "?"])
            body = f'{{"grant_id":"{gid}"' + (f',"capabilities":{c}' if kind == "GRANTED" and (c := rng.choice(caps)) else "") + "}"
            rows.append((f"s{s}", seq, kind, "x", f"{rng.randrange(10):02d}", body if kind in ("GRANTED", "REVOKED") else "{}"))
    chain = spark.createDataFrame(rows, "subject_id string, seq int, event_type string, issuer_id string, created_at string, payload_json string")
    asks = chain.select(F.when(F.col("seq") == 3, "nobody").otherwise(F.col("subject_id")).alias("holder"), F.when(F.col("seq") != 5, F.col("created_at")).alias("at"), (F.col("seq") % 2 == 0).alias("own"), "seq")
    grants, windows = [r.asDict() for r in replay.grants(chain).collect()], [tuple(r) for r in replay.quarantine_windows(chain).collect()]
    errors = [tuple(r)[:2] for r in replay.authority_errors(chain).collect()]
    known = {r[0] for r in rows}
    held = authority.held_before(asks, chain)
    assert plan_of(held).count("Generate explode") <= 4 and "_ask_" not in plan_of(held)
    got = held.collect()
    assert len(got) == len(rows)
    for r in got:
        h, at, seq = r["holder"], r["at"], r["seq"]
        assert r["known"] == (h in known)
        if r["own"]:
            last = [k for s, q, k, *_ in sorted(rows) if s == h and q < seq and k.startswith("ACTOR")]
            net = sum(1 if k == "ACTOR_QUARANTINED" else -1 for k in last)
            barred = net > 0 or any(e[0] == h and e[1] < seq for e in errors)
            live = [g for g in grants if g["subject_id"] == h and g["granted_seq"] < seq and not (g["revoked_seq"] is not None and g["granted_seq"] < g["revoked_seq"] < seq)]
        else:
            barred = at is not None and any(w[0] == h and w[1] <= at and (w[2] is None or w[2] > at) for w in windows)
            live = [g for g in grants if at is not None and g["subject_id"] == h and g["granted_at"] <= at and (g["revoked_at"] is None or g["revoked_at"] > at)]
        assert r["held"] == ([] if barred else sorted({c for g in live for c in g["capabilities"]})), r
