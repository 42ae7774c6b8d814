import json

import pytest

from quadrille.llm import tool_calls as T

SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["number", "string"]}, "tags": {"type": "array", "items": {"enum": ["x", "y"]}}}, "required": ["a"], "additionalProperties": False}}


def call(i, name="add", **arguments):
    return {"id": i, "name": name, "arguments": arguments}


def said(*calls, **more):
    return json.dumps({"tool_calls": calls} | more)


def answer(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


@pytest.fixture
def link(spark):
    def run(rows):
        df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, kind string").repartition(3)
        out = T.link_tool_calls(df, SCHEMAS).collect()
        return sorted(out, key=lambda r: tuple((x is not None, x) for x in (r.conv_id, r.at_turn, r.at_step, r.at_ordinal, r.turn, r.json)))

    return run


def test_results_follow_their_calls(link):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "tool", answer("c2", {"z": 1, "a": [2]})),
        (1, 2, "assistant", said(call("c1", a=1, b="$c2"), call("c2", a=2), content="wait")),
        (1, 3, "tool", answer("c1")),
        (1, 4, "tool", answer("c9")),
        (2, 0, "tool", answer("c1")),
    ]
    got = [(r.conv_id, r.kind, r.call_id, r.linked, r.valid) for r in link(rows)]
    assert got == [
        (1, "message", None, False, True),
        (1, "message", None, False, True),
        (1, "call", "c2", True, True),
        (1, "call", "c1", True, True),
        (1, "result", "c2", True, True),
        (1, "result", "c1", True, True),
        (1, "result", "c9", False, False),
        (2, "result", "c1", False, False),
    ]


def test_calls_follow_what_they_refer_to():
    order = lambda *calls: [c[0] for c in T._ordered([(i, None, None, set(r)) for i, r in calls])]
    assert order(("a", "bc"), ("b", "c"), ("c", ""), ("d", "")) == ["c", "b", "a", "d"]
    assert order(("a", "b"), ("b", "a")) == ["b", "a"] and order(("a", "a"), (None, ""), ("a", "x")) == ["a", "a", None]
    many = [(str(i), [str(i + 1)]) for i in range(20000)]
    assert order(*many) == [str(i) for i in reversed(range(20000))]


def test_canonical_json_reads_back(link):
    out = link([(1, 0, "assistant", '{"tool_calls": [{"function": {"arguments": "{\\"b\\": \\"é\\", \\"a\\": 1}", "name": "add"}, "id": "c"}]}')])
    assert out[0].json == '{"arguments":{"a":1,"b":"é"},"call_id":"c","conv_id":1,"kind":"call","linked":false,"name":"add","role":"assistant","turn":0}'
    assert T.canonical(json.loads(out[0].json)) == out[0].json


@pytest.mark.parametrize(
    ("arguments", "errors"),
    [
        ({"a": 1, "b": 2.5, "tags": ["x"]}, []),
        ({"b": "s"}, ["$.a: missing"]),
        ({"a": "1"}, ["$.a: not of type integer"]),
        ({"a": True}, ["$.a: not of type integer"]),
        ({"a": -1, "c": 0}, ["$.a: out of bounds", "$.c: not allowed"]),
        ({"a": 1, "tags": ["x", "q"]}, ["$.tags[1]: not an allowed value"]),
    ],
)
def test_arguments_hold_to_the_schema(arguments, errors):
    assert T.violations(arguments, SCHEMAS["add"]) == errors


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        (True, [1, None], []),
        (False, [], [1, None]),
        ({"pattern": "^a+$"}, ["aa", 3], ["ab", ""]),
        ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["a", 3], [2]),
        ({"oneOf": [{"minimum": 3}, {"maximum": 5}]}, [2, 6], [4]),
        ({"allOf": [{"minimum": 3}, {"maximum": 5}], "not": {"const": 4}}, [3, 5], [2, 4, 4.0]),
        ({"exclusiveMinimum": 1, "exclusiveMaximum": 2}, [1.5, "x"], [1, 2, 1.0]),
        ({"enum": [1, [1.0]]}, [1.0, [1]], [True, [True], "1"]),
        ({"uniqueItems": True, "items": {"type": "integer"}}, [[1, 2], []], [[1, 1.0], [1.5]]),
        ({"minProperties": 1, "properties": {"a": False}, "additionalProperties": {"type": "null"}}, [{"b": None}], [{}, {"a": 1}, {"b": 1}]),
    ],
)
def test_words_of_schemas(schema, good, bad):
    T.check_schema(schema)
    assert not any(T.violations(x, schema) for x in good) and all(T.violations(x, schema) for x in bad)


@pytest.mark.parametrize("schema", [{"$ref": "#/x"}, {"properties": {"a": {"patternProperties": {}}}}, {"items": 3}, {"pattern": "("}, {"anyOf": [{"if": True}]}])
def test_schemas_that_are_not_read_are_refused(spark, schema):
    with pytest.raises((ValueError, T.re.error)):
        T.link_tool_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), {"x": schema})


def deep(n):
    return '{"tool_calls": [{"id": "c", "name": "add", "arguments": ' + '{"a":' * n + '"$c"' + "}" * n + "}]}"


def test_nests_and_numbers_that_cannot_be_written_are_plain_text(link):
    texts = [deep(n) for n in (1_500, 5_000, 100_000)] + ['{"tool_calls": [{"id": "c", "arguments": {"a": 1e999}}]}', '{"tool_calls": [{"id": "c", "arguments": {"a": "\\ud800"}}]}', '{"tool_calls": [' + "9" * 5000 + "]}"]
    out = link([(1, n, "assistant", t) for n, t in enumerate(texts)])
    assert [r.kind for r in out] == ["message"] * len(texts) and all(json.loads(r.json)["content"] == t for r, t in zip(out, texts, strict=True))
    out = link([(1, 0, "assistant", deep(400)), (1, 1, "assistant", '{"tool_calls": [{"id": "d", "name": "add", "arguments": "{\\"a\\": 1e999}"}]}')])
    assert [(r.kind, list(r.errors)) for r in out] == [("call", ["$.a: not of type integer"]), ("call", ["arguments are no object"])]


def test_an_identifier_with_very_many_events(link, monkeypatch):
    rows = [(1, 0, "assistant", said(call("c", a=1)))] + [(1, 1 + n, "tool", answer("c", str(n))) for n in range(1500)] + [(2, n, "tool", answer(f"c{n}")) for n in range(50)]
    out = link(rows)
    assert len(out) == len(rows) and sum(r.linked for r in out) == 1501
    monkeypatch.setattr("quadrille.llm.workspace.SHARE", 1)  # no key is hot
    assert link(rows) == out


def test_every_conversation_of_the_table_against_brute_force(spark):
    from quadrille.llm import queries as Q

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    calls = {(r.conv_id, r.turn) for r in rows if r.role == "user"}
    results = {(r.conv_id, r.turn - 1) for r in rows if r.role == "assistant"}
    want = []
    for r in rows:
        event = {"conv_id": r.conv_id, "role": r.role, "turn": r.turn}
        if r.role == "user":
            after = {"after": f"$turn-{r.turn - 2}"} if r.turn > 1 else {}
            linked, ok = (r.conv_id, r.turn) in results, bool(r.text.strip())
            event |= {"kind": "call", "call_id": f"turn-{r.turn}", "name": "reply", "linked": linked, "arguments": {"prompt": r.text, "turn": r.turn} | after}
            want.append((r.conv_id, r.turn, "call", linked, ok, r.turn, 1, event))
        elif r.role == "assistant":
            linked = (r.conv_id, r.turn - 1) in calls
            event |= {"kind": "result", "call_id": f"turn-{r.turn - 1}", "linked": linked, "content": r.text}
            if not linked:
                event["errors"] = ["no such call"]
            want.append((r.conv_id, r.turn, "result", linked, linked, r.turn, 0, event))
        else:
            want.append((r.conv_id, r.turn, "message", False, True, r.turn, 0, event | {"kind": "message", "content": r.text}))
    got = [(r.conv_id, r.turn, r.kind, r.linked, r.valid, r.at_turn, r.at_step, json.loads(r.json)) for r in Q.op3_chat_formatting(spark, sf).collect()]
    assert sorted(got, key=lambda x: x[:2]) == sorted(want, key=lambda x: x[:2])
    assert len({x[2] for x in got}) == 3 and {x[3] for x in got if x[2] == "call"} == {True, False}


def test_rows_of_every_kind(link):
    rows = [(1, 0, "assistant", t) for t in (None, "", "{", "{}", '{"tool_calls": []}', '{"tool_calls": [1, {"id": 5, "arguments": "x"}]}', '{"a": NaN, "tool_calls": [{}]}', "[" * 5000, "{" + '"a":{' * 5000)]
    rows += [(1, 1, None, "x"), (None, None, "tool", answer("c")), (None, 0, "assistant", said(call("c", a=1))), (3, 0, "assistant", said(call("d", a=1))), (3, 0, "assistant", said(call("d", a=1))), (3, 1, "tool", answer("d")), (3, 2, "assistant", said(call("d", "nope")))]
    out = link(rows)
    assert len(out) == len(rows) + 1
    assert [(r.linked, list(r.errors)) for r in out if r.conv_id == 3 and r.kind == "call"] == [(True, []), (True, []), (False, ["unknown tool"])]
    assert not any(r.linked for r in out if r.conv_id is None)
    assert link([]) == []


def test_calls_follow_calls_of_later_messages(link):
    rows = [
        (1, 0, "assistant", said(call("a", a=1, b="$c"), call("b", a=1, b="$a"), call("d", a=1))),
        (1, 1, "tool", answer("a")),
        (1, 2, "assistant", said(call("e", a=1, b="$b"))),
        (1, 3, "assistant", said(call("c", a=1))),
        (1, 4, "assistant", said(call("f", a=1, b="$e"))),
        (1, 5, "tool", answer("c")),
        (2, 0, "assistant", said(call("x", a=1, b="$y"))),
        (2, 1, "assistant", said(call("y", a=1, b="$z"))),
        (2, 2, "assistant", said(call("z", a=1, b="$x"))),
        (3, 0, "assistant", said(call("a", a=1, b="$c"))),
    ]
    got = [(r.conv_id, r.kind, r.call_id) for r in link(rows)]
    # a waits for c, b for a, e for b; the result of a stands behind it; f comes later anyway
    assert [x[1:] for x in got if x[0] == 1] == [("call", "d"), ("call", "c"), ("call", "a"), ("result", "a"), ("call", "b"), ("call", "e"), ("call", "f"), ("result", "c")]
    # a ring: its first call stays, the others follow
    assert [x[2] for x in got if x[0] == 2] == ["x", "z", "y"]
    assert [x[2] for x in got if x[0] == 3] == ["a"]


def test_order_holds_for_random_references(link):
    import random

    r = random.Random(4)
    rows, needs = [], {}
    for conv in range(12):
        ids = [f"i{n}" for n in range(14)]
        r.shuffle(ids)
        for turn in range(7):
            own = ids[2 * turn : 2 * turn + 2]
            calls = []
            for i in own:
                target = f"i{r.randrange(int(i[1:]))}" if i != "i0" and r.random() < 0.8 else None  # to a smaller number: no rings
                needs[conv, i] = target
                calls.append(call(i, a=1, **({"b": f"${target}"} if target else {})))
            rows.append((conv, turn, "assistant", said(*calls)))
        rows += [(conv, r.randrange(7), "tool", answer(i)) for i in ids[:5]]
    place = {}
    for n, x in enumerate(link(rows)):
        place.setdefault((x.conv_id, x.kind, x.call_id), n)
    assert all(place[c, "call", t] < place[c, "call", i] for (c, i), t in needs.items() if t)
    assert all(place[c, "call", i] < n for (c, kind, i), n in place.items() if kind == "result")
    assert len(place) == 12 * 19
