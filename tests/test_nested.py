"""JSON inside strings of a snapshot."""

from __future__ import annotations

import json

import pytest

from skyloom.operators.nested import _flatten

SNAPSHOT = {"sat_attrs": [{"id": 111}, None, {"id": 112}], "sat_edges": [{"from": 111, "to": 112}]}
ROWS = [("sat_attrs", 1, 111, 0), ("sat_attrs", 2, 112, 0), ("sat_edges", 1, 111, 112)]


def _rows(body):
    found = _flatten([7], [body.encode()])
    return list(zip(*(found[name] for name in ("child", "ord", "a_id", "b_id")), strict=True))


@pytest.mark.parametrize("blanks", ["", " ", " " * 100, "\n", "\n\n", "\r\n", "\t", "\n \t\r\n  ", "\n" * 200])
@pytest.mark.parametrize("times", [1, 2, 3])
def test_json_in_a_string(blanks, times):
    inner = json.dumps(SNAPSHOT)
    for _ in range(times):
        inner = json.dumps(blanks + inner)
    assert _rows(f'{{"payload": {inner}}}') == ROWS
    assert _rows(inner) == ROWS


def test_escaped_brackets_and_an_array_kept_as_text():
    assert _rows(r'{"payload": "\u0020\u000a\u007b\"sat_attrs\": [{\"id\": 5}]}"}') == [("sat_attrs", 1, 5, 0)]
    assert _rows(json.dumps({"sat_attrs": json.dumps(json.dumps([{"id": 5}]))})) == [("sat_attrs", 1, 5, 0)]


def test_strings_that_hold_no_json():
    body = {"note": "[INFO] started", "quote": '"sat" was seen', "brace": "{", "blank": " ", "empty": "", "sat_attrs": [{"id": 5, "name": '"Sat'}]}
    assert _rows(json.dumps(body)) == [("sat_attrs", 1, 5, 0)]


def test_links_to_parents_single_objects_nulls_and_names():
    body = {"sat_attrs": [None, {"name": "Satellite111", "health": "0.5", "pos": {"x": 1, "y": "2.5", "z": None}, "sat_edges": [{"to": "m12", "w": 1}, None, {"from": 5, "to": 6}], "target_edges": {"target": 7, "q": 0.25}}, 9, "Sat8"]}
    found = _flatten([7], [json.dumps(body).encode()])
    rows = list(zip(*(found[n] for n in ("child", "ord", "a_id", "b_id", "parent_ord", "weight", "pos")), strict=True))
    assert rows == [
        ("sat_attrs", 1, 111, 0, None, 0.5, [1.0, 2.5, None]), ("sat_edges", 1, 111, 12, 1, 1.0, None), ("sat_edges", 2, 5, 6, 1, None, None), ("target_edges", 1, 111, 7, 1, 0.25, None),
        ("sat_attrs", 2, 9, 0, None, None, None), ("sat_attrs", 3, 8, 0, None, None, None),
    ]


@pytest.mark.parametrize("body", ["", " ", "{", '{"sat_attrs": [1}', '{"sat_attrs": []}', '{"sat_attrs": null}', '{"sat_attrs": "[1"}', "[]", "null", "1 2", '{"a": 01}', '{"sat_attrs": [1],}', '{"sat_attrs": [1]} x', '{"sat_edges": {}}'])
def test_bodies_without_an_element_cost_no_other_its_rows(body):
    found = _flatten([1, 2, 3], [b'{"sat_attrs": [4]}', body.encode(), b'{"sat_attrs": [5]}'])
    kept = [(s, a) for s, c, a in zip(found["snapshot_id"], found["child"], found["a_id"], strict=True) if c == "sat_attrs"]
    assert kept == [(1, 4), (3, 5)]


def test_empty_batch_and_ids_too_large_or_no_numbers():
    assert _flatten([], [])["ord"] == [] and _flatten([1], [b"{"])["ord"] == []
    body = {"sat_attrs": [{"id": 10**25}, {"id": "12345678901234567"}, {"id": 1.5}, {"id": "x"}, {"id": True, "sat": 3}, {"id": None}, {"id": -4}, {"id": "007"}]}
    assert _flatten([1], [json.dumps(body).encode()])["a_id"] == [None, 12345678901234567, 1, None, 3, None, -4, 7]


def test_tables_with_nulls_copies_and_clashing_names():
    from skyloom.operators.nested import flatten_arrays, flatten_json
    from skyloom.session import local_session

    spark = local_session(4, 4)
    rows = [(1, '{"sat_attrs": [4]}', 0), (1, '{"sat_attrs": [4]}', 0), (2, None, 0), (3, "", 0), (None, '{"sat_attrs": [5]}', 1)]
    texts = spark.createDataFrame(rows, "k long, body string, ord int")
    assert sorted((r["snapshot_id"] or 0, r["ord"], r["a_id"]) for r in flatten_json(texts, "k", "body").collect()) == [(0, 1, 5), (1, 1, 4)]
    assert flatten_json(texts.limit(0), "k", "body").collect() == []
    schema = "snapshot_id long, sat_attrs array<struct<id: int, health: double, pos: array<double>>>, sat_edges array<struct<from_id: int, to_id: int, w: double>>, target_edges array<struct<from_id: int, to_id: int, q: double>>, child string"
    typed = spark.createDataFrame([(1, [None, (7, 0.5, None)], None, [], "x"), (1, [None, (7, 0.5, None)], None, [], "y")], schema)
    assert [(r["child"], r["ord"], r["a_id"], r["b_id"]) for r in flatten_arrays(typed).collect()] == [("sat_attrs", 1, 7, 0)]
