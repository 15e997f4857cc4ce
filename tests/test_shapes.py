"""Flat tables from nested records, against a plain recursive reading."""

import json

from colloquy.operators import shapes

TURNS = "array<struct<role:string,text:string,lang:string>>"
ENTITIES = "array<struct<text:string,label:string,char_start:int,char_end:int>>"


def tables(spark, payloads, turns=(), ner=()):
    logs = spark.createDataFrame(list(turns), f"session_id string, turns {TURNS}, path string, pos1 int")
    examples = spark.createDataFrame(list(ner), f"id string, tags array<string>, entities {ENTITIES}, val string")
    raw = spark.createDataFrame([(f"r{i}", p, "clash") for i, p in enumerate(payloads)], "raw_id string, payload string, shape string")
    return shapes.found(logs, examples, raw)


def test_cases(spark):
    export = lambda sessions: json.dumps({"export": {"sessions": sessions}})
    payloads = [
        None, "", "{", "[]", "3", '{"export": null}', '{"export": {"sessions": NaN}}', export(None), export([]), export(""),
        export({"specialty": "a", "turns": {"role": "user"}}),
        export([None, {"specialty": None, "turns": json.dumps([{"role": "bot", "tags": ["O", None, "B-X"]}, None, {"entities": {"label": "L"}}])}]),
        export([{"turns": [{"role": 3, "entities": [{"label": "x"}, {}, None, {"label": None}], "tags": json.dumps(["O"])}]}, "odd"]),
        export(json.dumps([{"specialty": True}])),
    ]
    got = {tuple(r) for r in tables(spark, payloads).collect()}
    assert got == {
        ("r10", "sessions", 0, -1, -1, "a"), ("r10", "turns", 0, 0, -1, "user"),
        ("r11", "sessions", 1, -1, -1, ""), ("r11", "turns", 1, 0, -1, "bot"), ("r11", "tags", 1, 0, 0, "O"), ("r11", "tags", 1, 0, 2, "B-X"), ("r11", "turns", 1, 2, -1, ""), ("r11", "entities", 1, 2, 0, "L"),
        ("r12", "sessions", 0, -1, -1, ""), ("r12", "turns", 0, 0, -1, "3"), ("r12", "entities", 0, 0, 0, "x"), ("r12", "entities", 0, 0, 1, ""), ("r12", "entities", 0, 0, 3, ""), ("r12", "tags", 0, 0, 0, "O"), ("r12", "sessions", 1, -1, -1, ""),
        ("r13", "sessions", 0, -1, -1, "true"),
    }


def test_native_tables(spark):
    turns = [("s1", [("user", "hi", "en"), None, (None, "", None)], "x", 1)] * 2 + [("s2", [], "x", 1), ("s3", None, "x", 1)]
    ner = [("n1", ["O", None], [("t", None, 0, 1), None], "v"), ("n2", None, None, None)]
    got = {tuple(r) for r in tables(spark, [], turns, ner).collect()}
    assert got == {("s1", "turns", 0, -1, -1, "user"), ("s1", "turns", 2, -1, -1, ""), ("n1", "entities", 0, -1, -1, ""), ("n1", "tags", 0, -1, -1, "O")}
    assert tables(spark, []).count() == 0


def test_subtypes_keep_parents(spark):
    raw = spark.createDataFrame([("r", json.dumps({"export": {"sessions": [{"session_id": "s", "triage_level": "2", "turns": [{"text": "t", "entities": [{"label": "L", "span": {"from": 1, "upto": 2}}]}]}]}}))], "raw_id string, payload string")
    rows = shapes.explode_json(raw)
    assert [r["triage_level"] for r in shapes.subtype(rows, "sessions").collect()] == [2]
    entity = shapes.subtype(rows, "entities").collect()[0]
    assert (entity["pos1"], entity["pos2"], entity["pos3"], entity["from"], entity["upto"], entity["label"]) == (0, 0, 0, 1, 2, "L")
    assert "turns" in shapes.subtype(rows, "sessions").collect()[0]["shape"]


def test_states_reach_down_to_the_leaves(spark):
    """Deeper structure changes the state of what is above it, whatever the number of kinds and levels."""
    export = lambda turns: json.dumps({"export": {"sessions": [{"turns": turns}]}})
    payloads = [export([{"entities": [{"label": "x"}]}]), export([{"tags": ["O"]}]), export([{"role": "user"}]), export([{"tags": ["O"]}, {"entities": {"label": 3}}, {"entities": [{"span": {"from": 1}}]}, {"a": [{"b": [{"c": [{"d": 1}]}]}]}, {"e": True}, {"f": 1}])]
    raw = spark.createDataFrame([(f"r{i}", p) for i, p in enumerate(payloads)], "raw_id string, payload string")
    rows = shapes.explode_json(raw).collect()
    sessions = [r["shape"] for r in sorted(rows, key=lambda r: r["root_id"]) if r["path"] == "sessions"]
    assert sessions == [
        "{turns:list<{entities:list<{label:s}>}>}", "{turns:list<{tags:list<s>}>}", "{turns:list<{role:s}>}",
        "{turns:list<{a?:list<{b:list<{c:list<{d:n}>}>}>,e?:b,entities?:list<{span:{from:n}}>|lone<{label:n}>,f?:n,tags?:list<s>}>}",
    ]
    deep = [r for r in rows if r["path"] == "export.sessions.turns.a.b.c"]
    assert [(r["pos"], r["attrs"]) for r in deep] == [([0, 3, 0, 0, 0], {"d": "1"})]


def test_typed_columns_have_the_same_states(spark):
    record = {"turns": [{"role": "user", "n": 3, "parts": [{"x": 1, "y": ["a", None]}, {"x": None, "y": []}], "meta": {"app": "web", "on": True}}, None, {"role": None, "n": 1, "parts": None, "meta": None}, {"role": "bot", "n": None, "parts": [{"x": 2, "y": ["b"]}], "meta": {"app": None, "on": False}}]}
    schema = "id string, turns array<struct<role:string,n:int,parts:array<struct<x:int,y:array<string>>>,meta:struct<app:string,on:boolean>>>"
    typed = spark.createDataFrame([("r0", [t and (t["role"], t["n"], t["parts"] and [(p["x"], p["y"]) for p in t["parts"]], t["meta"] and (t["meta"]["app"], t["meta"]["on"])) for t in record["turns"]])], schema)
    got = {(r["path"], tuple(r["pos"]), r["shape"], tuple(sorted(r["attrs"].items()))) for r in shapes.typed_rows(typed, "id", {"turns": "turns"}).collect()}
    automaton = shapes.Automaton({".turns": "turns"})
    out = []
    automaton.run("", shapes.parse(json.dumps(record))[1], (), {}, "", out)
    named = {".turns.parts": "turns.parts", ".turns.parts.y": "turns.parts.y"}
    assert got == {(named.get(kind, kind), pos, shape, tuple(sorted(attrs.items()))) for kind, pos, shape, attrs in out} and len(got) == 8


def test_variants(spark):
    raw = spark.createDataFrame([(f"r{i}", json.dumps({"export": {"sessions": [{"specialty": "x"}] * n}})) for i, n in enumerate((1, 2, 2))] * 2, "raw_id string, payload string")
    assert [tuple(r) for r in shapes.variants(shapes.explode_json(raw)).collect()] == [("sessions", "{specialty:s}", 5, 3)]
