"""Nested evidence: bounds against a small recursive reading, leaves as rows, odd texts."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from posthound.operators import evidence

BOUNDS = {"depth": 2, "chars": 5, "key_chars": 20, "members": 3, "items": 2, "whole": 200}
CASES = [
    {"b": [1, 2, 3], "a": {"deep": {"deeper": {"x": 1}}}, "long": "abcdefgh", "z": 1},
    {"k" * 30: 1, "k" * 29 + "j": 2},
    [1, "ñandúes", None, True],
    {"q": 'say "hi"\n', "e": "", "n": None, "f": 2.5},
    {f"key{i:03}": "12345678" for i in range(60)},
    {},
    [],
    "plain",
    7,
    None,
]


def shorten(key, most):
    return key if len(key) <= most else key[: most - 17] + "…" + hashlib.sha256(key.encode()).hexdigest()[:16]


def bound(x, left, b):
    if left < 0:
        return "…"
    if isinstance(x, str):
        return x if len(x) <= b["chars"] else x[: b["chars"]] + "…"
    if isinstance(x, dict):
        return {shorten(k, b["key_chars"]): bound(x[k], left - 1, b) for k in sorted(x, key=str.encode)[: b["members"]]}
    if isinstance(x, list):
        return [bound(v, left - 1, b) for v in x[: b["items"]]]
    return x


def stored(x, b):
    text = json.dumps(bound(x, b["depth"], b), ensure_ascii=False, separators=(",", ":"))
    keys = [shorten(k, 100) for k in sorted(x, key=str.encode)[:50]] if isinstance(x, dict) else []
    return text if len(text) <= b["whole"] else json.dumps({"_truncated": True, "keys": keys}, ensure_ascii=False, separators=(",", ":"))


@pytest.mark.parametrize("changed", [{}, {"depth": 0}, {"members": 60, "chars": 50}, {"items": 0, "members": 0}])
def test_bounds_equal_a_recursive_reading(spark, changed):
    b = BOUNDS | changed
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(CASES)], "id int, t string")
    got = {r.id: r.e for r in df.select("id", evidence.bounded(F.col("t"), **b).alias("e")).collect()}
    assert got == {i: stored(x, b) for i, x in enumerate(CASES)}


def test_text_that_is_no_json(spark):
    said = {None: None, "": '""', "rubbish": '"rubbi…"', '{"a":1,"a":2}': '"{\\"a\\":…"', "{": '"{"'}
    df = spark.createDataFrame([(t,) for t in said], "t string")
    assert {r.t: r.e for r in df.select("t", evidence.bounded(F.col("t"), **BOUNDS).alias("e")).collect()} == said


def test_leaves(spark):
    text = '{"a":{"b":[{"c":1},{"c":"x"},null]},"odd key":true,"none":{},"empty":[]}'
    df = spark.createDataFrame([(1, text), (2, None), (3, "no"), (4, "5"), (5, "[]")], "id int, t string")
    want = [(1, "$.a.b[*].c", "number", "1"), (1, "$.a.b[*].c", "string", "x"), (1, "$.a.b[*]", "null", None), (1, '$["odd key"]', "boolean", "true"), (1, "$.none", "object", None), (1, "$.empty", "list", None), (4, "$", "number", "5"), (5, "$", "list", None)]
    assert sorted(map(tuple, evidence.leaves(df, "id", "t").collect()), key=repr) == sorted(want, key=repr)
    shallow = {(r.id, r.path): r.value for r in evidence.leaves(df, "id", "t", 1).collect()}
    assert shallow[(1, "$.a")] == '{"b":[{"c":1},{"c":"x"},null]}' and (1, "$.a.b[*]") not in shallow
