import json
import random

from chainlake.llm import chat

SCHEMAS = [("search", "q", "string", True), ("search", "k", "integer", False), ("sum", "xs", "array", True), ("sum", "scale", "number", False)]
KINDS = "conv_id long, turn long, kind string, role string, call_id string, name string, arguments string, after array<string>, text string, k string, place int"


def run(spark, rows):
    messages = spark.createDataFrame([(*r, "x", 1) for r in rows], KINDS).repartition(3)
    schemas = spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")
    return chat.link_tool_calls(messages, schemas).collect()


def call(conv, turn, identifier, name="search", arguments='{"q":"a"}', after=None):
    return (conv, turn, "call", "assistant", identifier, name, arguments, after, None)


def result(conv, turn, identifier, text="r"):
    return (conv, turn, "result", "tool", identifier, None, None, None, text)


def test_links_and_problems(spark):
    rows = [
        (1, 0, "message", "user", None, None, None, None, 'say "é"\n'),
        call(1, 1, "a", arguments='{ "q": "x", "k": 1.0e0 }'),
        call(1, 2, "b", "sum", '{"xs":[2, 1], "scale":1.50}', ["a"]),
        result(1, 3, "a"),
        result(1, 4, "b", None),
        call(2, 0, "a", arguments='{"k":"1","z":null}'),
        call(2, 1, "c", "nothing"),
        call(2, 2, "d", arguments="[1]"),
        call(2, 3, "e", arguments="broken {", after=["zz"]),
        result(2, 4, "none"),
        call(3, 0, "t"), call(3, 0, "t"), result(3, 1, "t"),
        call(None, 0, "a"), result(None, 1, "a"), call(4, 0, None), result(4, 1, None),
    ]
    found = {(r.conv_id, r.turn): r for r in run(spark, rows)}
    assert len(run(spark, rows)) == len(rows)
    get = lambda c, t: (found[c, t].linked, found[c, t].valid, found[c, t].problems)
    assert get(1, 0) == (None, None, []) and found[1, 0].json == '{"content":"say \\"é\\"\\n","role":"user"}'
    assert get(1, 1) == (True, False, ["type: k"]) and json.loads(found[1, 1].json)["arguments"] == {"k": 1.0, "q": "x"}
    assert get(1, 2) == (True, True, []) and '"arguments":{"scale":1.5,"xs":[2,1]}' in found[1, 2].json
    assert [found[1, t].place for t in range(5)] == [0, 1, 4, 3, 5]
    assert get(2, 0) == (False, False, ["missing: q", "no result", "not in the schema: z", "type: k"])
    assert get(2, 1) == (False, False, ["no result", "unknown tool"])
    assert get(2, 2) == (False, False, ["arguments are no object", "no result"])
    assert get(2, 3) == (False, False, ["arguments are no object", "needs an absent call: zz", "no result"]) and json.loads(found[2, 3].json)["arguments"] == "broken {"
    assert get(2, 4) == (False, False, ["no call"])
    assert get(3, 0) == (True, False, ["repeated identifier"]) and get(3, 1) == (True, True, [])
    assert get(None, 0) == (True, True, []) and get(4, 0) == (False, False, ["no result"])
    assert run(spark, []) == []


def test_topological_order(spark):
    rng = random.Random(1)
    rows, needs = [], {}
    for conv in range(30):
        ids = [f"i{k}" for k in range(rng.randrange(2, 9))]
        turns = rng.sample(range(40), 2 * len(ids))
        for k, i in enumerate(ids):
            after = rng.sample(ids[:k], rng.randrange(0, k + 1))
            rows += [call(conv, turns[2 * k], i, after=after), result(conv, turns[2 * k + 1], i)]
            needs[conv, "result", i] = [(conv, "call", i)]
            needs[conv, "call", i] = [(conv, "result", a) for a in after]
    turn = {(r[0], r[2], r[4]): r[1] for r in rows}

    def place(x):
        return max([turn[x], *(place(n) + 1 for n in needs[x])])

    found = run(spark, rows)
    assert {(r.conv_id, r.kind, r.call_id): r.place for r in found} == {x: place(x) for x in turn}


def test_cycles(spark):
    rows = [call(1, 0, "a", after=["b"]), call(1, 1, "b", after=["a"]), result(1, 2, "a"), call(1, 3, "c", after=["a"]), call(1, 4, "free"), result(1, 5, "free"), call(2, 0, "self", after=["self"])]
    found = {(r.conv_id, r.kind, r.call_id): r for r in run(spark, rows)}
    cyclic = {k for k, r in found.items() if "in or behind a cycle" in r.problems}
    assert cyclic == {(1, "call", "a"), (1, "call", "b"), (1, "result", "a"), (1, "call", "c"), (2, "call", "self")}
    assert all(r.place == r.turn for r in found.values())


def test_a_long_chain_in_reverse(spark):
    """A chain of 200 messages takes some log2 of as many rounds."""
    n, rows = 100, []
    for k in range(n):
        rows += [call(1, 2 * (n - 1 - k), f"i{k}", after=[f"i{k - 1}"] if k else None), result(1, 2 * (n - 1 - k) + 1, f"i{k}")]
    found = {(r.kind, r.call_id): r.place for r in run(spark, rows)}
    first = 2 * (n - 1)
    assert found == {(kind, f"i{k}"): first + 2 * k + (kind == "result") for k in range(n) for kind in ("call", "result")}
