"""Repair against all edits of short conversations, and against a plain pass over long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from fieldledger.llm import conversation_repair as cr

GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, pos int, audit string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def marked(rows):
    """(role, text, fault) of a conversation's rows in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(cr.BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def all_edits(rows):
    """Every way to edit up to three rows, with at most two rows inserted in a place: least cost and audit."""
    gaps = [g for n in range(3) for g in itertools.product("ua", repeat=n)]
    best = None
    for acts in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, _, f in rows]):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            initials, audit, cost, repaired = "", "", 0, []
            for i, gap in enumerate(inserts):
                for r in gap:
                    initials, audit, cost = initials + r, audit + "I", cost + 3
                    repaired.append((cr.ROLES[r], ""))
                if i == len(rows):
                    break
                role, text, fault = rows[i]
                audit += acts[i][0]
                cost += {"D": 4, "K": 0, "R": 3}[acts[i][0]] + (3 if fault == "truncated" and acts[i] != "D" else 0)
                if acts[i] != "D":
                    repaired.append((role if acts[i] == "K" else cr.ROLES[acts[i][1]], text))
                    initials += (repaired[-1][0] or "-")[0]
            if GRAMMAR.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, repaired)
    return best


def one_pass(rows):
    """The same for any length, row by row over the grammar's states."""
    follows = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    states = {0: (0, "", ())}

    def spread(states):
        for _ in range(2):
            for q, (c, e, rep) in list(states.items()):
                for r, to in follows[q].items():
                    if r != "s":
                        new = (c + 3, e + "I", (*rep, (cr.ROLES[r], "")))
                        states[to] = min(states.get(to, new), new, key=lambda x: x[:2])
        return states

    for role, text, fault in rows:
        after = {}
        for q, (c, e, rep) in spread(dict(states)).items():
            ways = [(q, (c + 4, e + "D", rep))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                ways += [(to, (c + more, e + "K", (*rep, (role, text)))) for r, to in follows[q].items() if role[:1] == r]
                ways += [(to, (c + 3 + more, e + "R", (*rep, (cr.ROLES[r], text)))) for r, to in follows[q].items() if r != "s"]
            for to, new in ways:
                after[to] = min(after.get(to, new), new, key=lambda x: x[:2])
        states = after
    return min((x for q, x in spread(dict(states)).items() if q in (0, 3)), key=lambda x: x[:2])


def expected(rows, solve, originals):
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in originals}
    for conv in {r[0] for r in rows}:
        own = in_order([r for r in rows if r[0] == conv])
        facts = marked(own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, repaired = solve(facts)
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(own)]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        n = [sum(f == kind for _, _, f in facts) for kind in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def found(frame):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in frame.collect()}


ROLES = ["user", "assistant", "system", "tool", "", None, "User", "u", "aide"]
WORDS = ["Yes.", "no", "", " \n", None, "Is it?  ", "A.b", "Yes.", "漢字！", "…"]


def test_all_edits_of_short_conversations(spark):
    rng = random.Random(8)
    rows = [(i, t, rng.choice(ROLES[:4]) if i % 3 else rng.choice(ROLES), rng.choice(WORDS)) for i in range(60) for t in range(rng.randint(1, 3 if i % 10 == 0 else 2))]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    clean = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    assert found(cr.report(frame)) == expected(clean, all_edits, [])


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(9)
    rows = []
    for conv in range(40):
        for turn in range(rng.choice([1, 2, 8, 70])):
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 3]), rng.choice(ROLES if conv % 4 == 0 else ["user", "assistant"]), f"{rng.choice(WORDS)}{rng.choice(['', turn, '!'])}"))
    # one conversation with most of the rows, over all ranges; one of equal rows; one without an id
    rows += [(77, t, "assistant" if t % 2 else "user", f"{t}." if t % 7 else "same") for t in range(2500)]
    rows += [(78, 1, "user", "again and again.")] * 300
    rows += [(None, t, "user", "x." * (1 + t)) for t in range(5)] + [(79, None, "system", "Only."), (80, 5, "user", "long " * 50_000)]
    return rows


def test_long_conversations_with_damage(spark, long_rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in long_rows], SCHEMA).repartition(5)
    got = found(cr.report(cr.damage(frame), frame))
    assert got == expected(damaged(long_rows), one_pass, {r[0] for r in long_rows})


def test_repaired_rows(spark, long_rows):
    rows = [r for r in long_rows if r[0] != 77]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    by = {}
    for r in sorted(cr.repair(cr.damage(frame)).collect(), key=lambda r: r["place"]):
        assert r["place"] == len(by.setdefault(r["conv_id"], []))
        by[r["conv_id"]].append((r["role"], r["text"]))
    for conv in {r[0] for r in damaged(rows)}:
        wanted = list(one_pass(marked(in_order([r for r in damaged(rows) if r[0] == conv])))[2])
        assert by.get(conv, []) == wanted and GRAMMAR.fullmatch("".join(r[:1] for r, _ in wanted))


def test_nothing(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert cr.report(cr.damage(frame), frame).count() == 0 and cr.repair(frame).count() == 0
    # turn 0 of a conversation that damage drops whole
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "x.", 1, "x")], SCHEMA)
    assert found(cr.report(cr.damage(frame), frame)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
