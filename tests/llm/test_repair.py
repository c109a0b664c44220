"""Conversation repair against an exhaustive search."""

import heapq
import time

import numpy as np
import pytest

from keyloom.llm import repair


def cheapest(rows):
    """(cost, initials, turns) by Dijkstra over whole strings of edits: independent of states that survive."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, initials, at, state, turns = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, initials, list(turns)
        if (at, state) in done:
            continue
        done.add((at, state))
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for initial, role in (("u", "user"), ("a", "assistant")):
            if initial in fits:
                heapq.heappush(heap, (cost + 2, initials + "I", at, initial, (*turns, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 3, initials + "D", at + 1, state, turns))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] and role[:1] in fits:
                    heapq.heappush(heap, (cost + more, initials + "K", at + 1, role[:1], (*turns, (role, text))))
                for initial, new in (("u", "user"), ("a", "assistant")):
                    if initial in fits:
                        heapq.heappush(heap, (cost + more + 2, initials + "R", at + 1, initial, (*turns, (new, text))))
    raise AssertionError


def searched(rows):
    edits = []
    search = repair.Search(edits.append)
    for row in rows:
        search.row(*row)
    cost = search.end()
    return cost, "".join(e[0] for e in edits), [e[1:3] for e in edits if e[0] != "D"], search.held


def test_search_matches_exhaustive_search():
    rng = np.random.default_rng(11)
    roles = np.array(["system", "user", "assistant", "tool", ""])
    for _ in range(3000):
        p = rng.dirichlet([0.6] * 5)
        rows = [(str(rng.choice(roles, p=p)), f"t{i}", str(rng.choice(["", "", "truncated", "blank", "duplicate"]))) for i in range(rng.integers(0, 9))]
        assert searched(rows)[:3] == cheapest(rows), rows


def test_ties_are_decided_by_the_first_difference():
    rows = [("x", f"t{i}", "") for i in range(4)]
    assert searched(rows)[:2] == cheapest(rows)[:2] == (8, "RRRR")
    rows = [("x", f"t{i}", "") for i in range(5)]  # an insertion goes first, since I is less than R
    assert searched(rows)[:2] == cheapest(rows)[:2]


def test_edits_leave_as_soon_as_they_are_certain():
    rows = [(("user", "assistant")[i % 2], f"t{i}", "") for i in range(20_000)]
    cost, initials, turns, held = searched(rows)
    assert (cost, initials, len(turns)) == (0, "K" * 20_000, 20_000)
    assert held < 12  # of 20,000 edits


def test_unresolved_suffixes_of_any_length():
    # one survivor dropped the first row, the other has not: they never coalesce
    start = time.perf_counter()
    rows = [("x", "t", "")] * 50_001
    cost, initials, turns, held = searched(rows)
    assert cost == 100_003 and initials == "D" + "R" * 50_000 and held > 50_000
    assert time.perf_counter() - start < 60


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def expected(rows):
    """The repaired turns and initials of each conversation, by the rules and the exhaustive search."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted([(r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows if r[0] == conv], key=lambda r: r[:3])
        seen, told = set(), []
        for _, _, role, text in own:
            told.append((role, text, repair.fault_of(text, (role, text) in seen)))
            seen.add((role, text))
        out[conv] = cheapest(told)
    return out


ROWS = [(1, 0, "system", "Be short."), (1, 1, "user", "Why?"), (1, 2, "assistant", "Because."), (2, 0, "user", "Hello."), (2, 1, "user", "Hello."), (2, 2, "assistant", "Hi"),
        (3, None, "assistant", "First."), (3, 5, "user", None), (3, 7, None, "No role."), (4, 0, "user", ""), (4, 1, "assistant", " \t"), (None, 0, "user", "Null."),
        (None, 1, "assistant", "Id."), (5, 0, "user", "Long. " * 100_000), (5, 1, "assistant", "Ok!"), (6, 0, "user", "Same."), (6, 0, "user", "Same."), (6, 0, "assistant", "A tie."),
        (7, -3, "tool", "?"), (8, 2, "", "No initial.")]


def test_repair_of_a_table(spark):
    want = expected(ROWS)
    got = {}
    for r in sorted(repair.repair(table(spark, ROWS)).collect(), key=lambda r: r["place"]):
        got.setdefault(r["conv_id"], []).append(r)
    assert set(got) == set(want)
    for conv, edits in got.items():
        cost, initials, turns = want[conv]
        assert [r["place"] for r in edits] == list(range(1, len(edits) + 1))
        assert "".join(r["edit"] for r in edits) == initials
        assert [(r["role"], r["text"]) for r in edits if r["edit"] != "D"] == turns


def test_empty_tables_other_columns_and_text_ids(spark):
    assert repair.repair(table(spark, ROWS).limit(0)).count() == 0
    clashing = table(spark, ROWS).selectExpr("*", "1 AS kind", "'x' AS said", "2 AS copies", "'y' AS edit", "3 AS place")
    assert repair.repair(clashing).count() == repair.repair(table(spark, ROWS)).count()
    named = table(spark, ROWS).selectExpr("cast(conv_id AS string) AS conv_id", "turn", "role", "text")
    assert {r["conv_id"] for r in repair.repair(named).collect()} == {None if c is None else str(c) for c in expected(ROWS)}


@pytest.mark.parametrize("parts", [1, 7])
def test_result_does_not_depend_on_splits(spark, parts):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 30)), int(rng.integers(0, 20)), str(rng.choice(["user", "assistant", "system"])), str(rng.choice(["A.", "B", "C?", " ", "D!"]))) for _ in range(400)]
    got = sorted(tuple(r) for r in repair.repair(table(spark, rows).repartition(parts)).collect())
    assert got == sorted(tuple(r) for r in repair.repair(table(spark, rows[::-1])).collect())


def test_one_conversation_of_all_rows(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(30_000)]
    got = repair.repair(table(spark, rows)).groupBy("edit").count().collect()
    assert [tuple(r) for r in got] == [("K", 30_000)]
