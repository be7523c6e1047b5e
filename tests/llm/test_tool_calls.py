import json
import random
import time

import pytest

from loadlens.llm import tool_calls as tc

COLUMNS = "conv_id long, turn long, role string, text string, level string"


def rows(spark, given, schemas=tc.SCHEMAS):
    return tc.linked(spark.createDataFrame([(*r, "x") for r in given], COLUMNS), schemas).collect()


def test_json_traffic(spark):
    def calls(*items):
        return json.dumps({"tool_calls": list(items)})

    given = [
        (1, 0, "assistant", calls({"id": "a", "name": "add", "arguments": {"y": 1, "x": [3, {"q": 1, "b": "é\n"}]}})),
        (1, 1, "assistant", calls({"id": "c", "name": "add", "arguments": {"x": "no"}, "after": ["a", "b"]}, {"id": "b", "name": "free", "arguments": {}, "after": ["a", "nowhere"]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "c", "content": "7"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "lost", "content": "8"})),
        (2, 0, "assistant", calls({"id": "p", "name": "free", "arguments": {}, "after": ["q"]}, {"id": "q", "name": "free", "arguments": {}, "after": ["p"]}, {"id": "s", "name": "free", "arguments": "oops{"})),
        (2, 1, "assistant", calls({"id": "a", "name": "free", "arguments": {}})),
        (2, 1, "assistant", calls({"id": "a", "name": "free", "arguments": {}})),
    ]
    schemas = {"add": {"required": ("x",), "kinds": {"x": "array", "y": "integer"}}}
    got = {(r.conv_id, r.kind, r.call_id): r for r in rows(spark, given, schemas)}
    level = {k[2]: r.level for k, r in got.items() if k[0] == 1 and k[1] == "call"}
    assert level == {"a": 0, "b": 1, "c": 2}
    assert got[1, "result", "c"].place == 5 and got[1, "result", "c"].linked and got[1, "call", "c"].linked
    assert not got[1, "call", "a"].linked and not got[1, "result", "lost"].linked and got[1, "result", "lost"].place is None
    assert [got[1, "call", x].valid for x in "abc"] == [True, True, False]
    assert got[2, "call", "p"].level is None and got[2, "call", "s"].level == 0 and not got[2, "call", "s"].valid
    text = got[1, "call", "a"].json
    assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(text)["arguments"] == {"x": [3, {"b": "é\n", "q": 1}], "y": 1}


def test_plain_chat_and_odd_rows(spark):
    given = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", ""), (1, 4, "user", None), (None, 1, "user", "n"), (None, 2, "assistant", None), (5, None, "user", "x"), (5, 1, None, "{bad json"), (6, 1, "assistant", "{bad json")]
    got = {(r.conv_id, r.turn): r for r in rows(spark, given + given[1:3])}
    assert len(rows(spark, given + given[1:3])) == 12
    assert got[1, 1].linked and got[1, 2].linked and got[1, 1].valid and not got[1, 3].valid
    assert (got[1, 1].level, got[1, 3].level, got[1, 4].level) == (0, 1, 0)
    assert got[None, 1].linked and got[5, None].kind == "message" and got[5, 1].kind == "message" and not got[6, 1].linked
    assert rows(spark, []) == []


def test_long_chain_and_cycle_by_doubling(spark):
    n = 1000
    nodes = spark.createDataFrame([(str(k),) for k in range(n + 3)], "node string")
    edges = [(str(k), str(k - 1)) for k in range(1, n)] + [(str(n), str(n + 1)), (str(n + 1), str(n)), (str(n + 2), str(n))]
    got = {r.node: r.level for r in tc.levels(spark.createDataFrame(edges, "node string, before string"), nodes).collect()}
    assert all(got[str(k)] == k for k in range(n)) and all(got[str(n + k)] is None for k in range(3))


def brute_levels(nodes, edges):
    before = {n: {b for a, b in edges if a == n and b in nodes} for n in nodes}
    level, changed = {}, True
    while changed:
        changed = False
        for n in nodes:
            if n not in level and all(b in level for b in before[n]):
                level[n], changed = max((level[b] + 1 for b in before[n]), default=0), True
    return {n: level.get(n) for n in nodes}


@pytest.mark.parametrize("small", [2000, 6])
def test_random_graphs_against_brute_force(spark, small):
    """In rows and, for conversations of more than small calls, in rounds; some edges go back in time, some make cycles."""
    rng = random.Random(1)
    nodes, edges = [], set()
    for c in range(25):
        n = rng.randint(1, 14)
        nodes += [(f"{c}-{k}", f"c{c}", rng.randrange(6)) for k in range(n)]
        for k in range(n):
            for _ in range(rng.choice([0, 1, 2, 3])):
                edges.add((f"{c}-{k}", f"{c}-{rng.randrange(max(1, k))}" if rng.random() < 0.93 else f"{c}-{rng.randrange(n + 1)}"))
    got = tc.levels(spark.createDataFrame(sorted(edges), "node string, before string"), spark.createDataFrame(nodes, "node string, conv string, turn long"), small)
    want = brute_levels([n for n, _, _ in nodes], edges)
    assert {r.node: r.level for r in got.collect()} == want and None in want.values()


def test_deep_graph_with_two_predecessors(spark):
    n = 1000
    nodes = spark.createDataFrame([(str(k), "c", k) for k in range(n)], "node string, conv string, turn long")
    edges = [(str(k), str(k - j)) for k in range(n) for j in (1, 2) if k >= j]
    began = time.perf_counter()
    got = {r.node: r.level for r in tc.levels(spark.createDataFrame(edges, "node string, before string"), nodes).collect()}
    assert got == {str(k): k for k in range(n)} and time.perf_counter() - began < 60


def test_json_traffic_against_brute_force(spark):
    """Random tool traffic: links, levels and validity of every row, and canonical JSON."""
    rng = random.Random(2)
    given, calls, results = [], {}, {}
    for c in range(30):
        ids = [f"k{k}" for k in range(rng.randint(1, 8))]
        for turn, i in enumerate(ids):
            after = rng.sample(ids, rng.randint(0, min(2, len(ids))))
            arguments = rng.choice([{"x": 1}, {"x": "1"}, {"y": 2}, [1], {"x": 2, "more": {"b": 1, "a": "é"}}])
            calls[c, i] = (after, arguments)
            given.append((c, turn, "assistant", rng.choice(["", " ", "\n\t"]) + json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": arguments, "after": after}]})))
        for i in rng.sample([*ids, "lost"], rng.randint(0, len(ids))):
            results[c, i] = True
            given.append((c, 50, "tool", json.dumps({"tool_call_id": i, "content": "r"})))
    nodes = sorted(calls)
    level = brute_levels(nodes, [((c, i), (c, b)) for (c, i), (after, _) in calls.items() for b in after])
    got = rows(spark, given, {"f": {"required": ("x",), "kinds": {"x": "integer"}}})
    assert len(got) == len(given)
    for r in got:
        key = (r.conv_id, r.call_id)
        assert r.level == level.get(key)
        if r.kind == "call":
            arguments = calls[key][1]
            assert r.linked == (key in results) and r.valid == (isinstance(arguments, dict) and isinstance(arguments.get("x"), int))
            assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) and json.loads(r.json)["arguments"] == arguments
        else:
            assert r.kind == "result" and r.linked == (key in calls)
