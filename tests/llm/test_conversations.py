import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from fleetwatch.llm import conversations, role_viterbi
from fleetwatch.llm.queries import op11_conversations

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def _damaged(rows):
    out = {}
    for c, t, r, x in rows:
        known = out.setdefault(c, [])
        s = lambda v: " " if v is None else str(v)
        n, r, x = zlib.crc32(f"{s(c)}:{s(t)}".encode()) % 20, s(r), s(x)
        x = "" if n == 1 else "".join(ch for ch in x if ch not in ".!?") if n == 2 else x
        known += [(t, "user" if n == 4 else r, x)] * {0: 0, 3: 2}.get(n, 1)
    return out


def _cheapest(rows, faults):
    """Uniform-cost search over (cost, letters)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, i, state, told = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "A"):
            return cost, letters, told
        name, to = ("assistant", "A") if state == "U" else ("user", "U")
        heapq.heappush(heap, (cost + 5, letters + "I", i, to, (*told, (name, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, state, told))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if keep := {"s": {"": "S"}, "u": {"": "U", "S": "U", "A": "U"}, "a": {"U": "A"}}.get(role[:1], {}).get(state):
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, keep, (*told, (role, text))))
                heapq.heappush(heap, (cost + 1 + more, letters + "R", i + 1, to, (*told, (name, text))))


def _expected(rows):
    out = {}
    for c, found in _damaged(rows).items():
        found = sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in found:
            end = text.rstrip(SPACE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        turns, initials = [r[0] for r in found if r[0] is not None], [r[1][:1] for r in found]
        cost, audit, told = _cheapest(found, faults)
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(k) for k in ("blank", "duplicate", "truncated")],
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in told).encode()).hexdigest())
    return out


def _compare(df, rows):
    hurt, want = conversations.damage(df), _expected(rows)
    got = conversations.repair(hurt, present=hurt["present"]).collect()
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want
    told = {}
    for r in conversations.turns(hurt, present=hurt["present"]).collect():
        told.setdefault(r.conv_id, []).append(r)
    for c, x in want.items():
        lines = sorted(told.get(c, []), key=lambda r: r.place)
        assert [r.place for r in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == x[-1]
        assert all((r.turn is None) == (r.edit == "I") or r.turn is None for r in lines)


def _odd(n, seed, convs):
    rnd = random.Random(seed)
    texts = ["Yes.", "no", "", " \t\n", None, "Really?", "é!\n", "日本。", "Go on! ", "x" * 40_000 + ".", "x" * 40_000, " ", "a.b"]
    return [(rnd.choice(convs), rnd.choice([None, *range(n // len(convs))]), rnd.choice(["system", "user", "assistant", "tool", None, "", "a", "User"]), rnd.choice(texts) if rnd.random() < 0.6 else f"t {rnd.random()}{rnd.choice('.!?,')}") for _ in range(n)]


def test_query_against_search(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in op11_conversations(spark, folder).collect()} == _expected(rows)


def test_nulls_ties_odd_texts_and_repeated_rows(docs):
    rows = _odd(400, 3, [None, 1, 2, 3, 40, 41, 42, 43, 44, 45])
    rows += rows[:50] + [(c, 0, "user", "A.") for c in range(100, 140)]
    _compare(docs([(*r, "x") for r in rows], f"{SCHEMA}, `key` string").repartition(5), rows)


def test_long_conversation_over_many_tasks(spark, docs):
    rows = _odd(4000, 5, [7]) + [(7, 5000 + k, "user" if k % 2 else "assistant", f"again {k % 3}.") for k in range(1500)] + _odd(100, 6, [6, 8, 9])
    rows = [(c, t, r, x if x is None or len(x) < 1000 else "long.") for c, t, r, x in rows]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one task
    try:
        _compare(docs(rows, SCHEMA).repartition(7), rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_far_turns(docs):
    assert conversations.repair(docs([], SCHEMA)).count() == 0 and conversations.turns(docs([], SCHEMA)).count() == 0
    far = conversations.repair(docs([(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")], SCHEMA)).collect()
    assert far[0].gaps == (1 << 63) - 1 and far[0].audit == "KK" and far[0].cost == 0


@pytest.mark.parametrize("chunk", [1, 3, 128])
def test_chunks_do_not_change_the_result(chunk):
    rnd = np.random.default_rng(chunk)
    lengths = np.array([0, 1, 5, 700, 0, 33])
    codes = rnd.integers(0, 12, lengths.sum())
    one, many = (role_viterbi.Runs(codes, lengths, np.tile(role_viterbi.TERMINAL, (len(lengths), 1)), c) for c in (1 << 30, chunk))
    assert one.passes == 1
    for a, b in zip((*one.starts(), *one.trace(np.zeros(len(lengths), int)), one.maps()), (*many.starts(), *many.trace(np.zeros(len(lengths), int)), many.maps()), strict=True):
        assert (a == b).all()


def test_refit_equals_a_new_run():
    rnd = np.random.default_rng(4)
    for n in (1, 10, 300):
        codes, old, new = rnd.integers(0, 12, n), rnd.integers(0, 9, 4).astype(np.int32), rnd.integers(0, 9, 4).astype(np.int32)
        (was, was_low), (now, now_low) = (role_viterbi.Runs(codes, np.array([n]), e[None]).starts() for e in (old, new))
        vector, low = role_viterbi.refit(codes, old, new, tail=4)
        assert ((was[0] if vector is None else vector) == now[0]).all() and (was_low[0] + low if vector is None else low) == now_low[0]
