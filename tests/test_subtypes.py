"""The registered typed rows equal the typed tables of each kind."""

import json

from colloquy.operators import shapes
from colloquy.plans import catalog


def test_registered_subtypes_equal_the_tables(spark, tmp_path):
    turns = [{"role": "user", "text": "t", "tags": ["O"], "entities": [{"label": "L", "text": "e", "span": {"from": 1, "upto": 2}}]}]
    payload = json.dumps({"export": {"sessions": [{"session_id": "s", "specialty": "x", "triage_level": "2", "turns": turns}, {"triage_level": "high"}]}})
    raw = spark.createDataFrame([("r", payload), ("r", payload), ("q", None)], "raw_id string, payload string")
    raw.write.parquet(f"{tmp_path}/raw_records.parquet")
    out = catalog.queries()["p6_subtypes"](spark, str(tmp_path))
    rows = shapes.explode_json(raw)
    for kind in shapes.SUBTYPES:
        want = shapes.subtype(rows, kind)
        own = out.where(out["path"] == kind).select(*want.columns)
        assert own.dtypes == want.dtypes and want.count() > 0
        assert sorted(map(str, own.collect())) == sorted(map(str, want.collect()))
    assert out.count() == 5
