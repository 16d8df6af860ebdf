import json

import pytest

from sparkvane.operators import validate

IDS = [str(i) for i in range(20)]
GOOD = {"session_id": "s", "user_id": "u", "turn_number": 1, "predicted_track_ids": IDS, "predicted_response": "Hi"}


def rules(spark, *raws, expected=None):
    raw = spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(raws)], "ordinal long, raw string")
    return sorted(map(tuple, validate.violations(raw, expected=expected or len(raws)).collect()))


def text(**changed):
    return json.dumps(GOOD | changed)


@pytest.mark.parametrize("raw,broken", [
    (text(), ""), (json.dumps(dict(reversed(GOOD.items()))), ""), (text(extra={"turn_number": "x", "predicted_response": None}), ""),
    (text().replace("turn_number", r"turn_number"), ""), (text().replace('"turn_number": 1', '"turn_number": "x", "turn_number": 1'), ""),
    (text().replace('"turn_number": 1', '"turn_number": 1, "turn_number": "x"'), "V04"), (text(predicted_response='x "turn_number": "y"'), ""),
    (text(turn_number=True), ""), (text(turn_number=2**70), ""), (text(turn_number=1.0), "V04"), (text(turn_number=1.5), "V04"), (text(turn_number="1"), "V04"), (text(turn_number=None), "V04"), (text(turn_number=[1]), "V04"),
    (text(predicted_track_ids=IDS[:19]), "V05 V06"), (text(predicted_track_ids=[*IDS[:19], "0"]), "V06"), (text(predicted_track_ids=[*IDS[:19], 0]), ""), (text(predicted_track_ids=[*IDS[:18], 1, True]), "V06"),
    (text(predicted_track_ids={"a": IDS}), "V05 V06"), (text(predicted_track_ids=[*IDS[:19], None]), ""),
    (text(predicted_response="  \n"), "V07"), (text(predicted_response={"text": "hi"}), "V07"), (text(predicted_response=None), "V07"), (text(predicted_response=5), "V07"),
    (json.dumps({k: v for k, v in GOOD.items() if k != "user_id"}), "V03"), (text(user_id=None), ""), ('[1, "x"]', "V03 V05 V06 V07"), ('"x"', "V03 V05 V06 V07"), ("{bad", "V03 V05 V06 V07"), (None, "V03 V05 V06 V07"),
])
def test_each_shape(spark, raw, broken):
    assert [r for _, r in rules(spark, raw)] == broken.split()


def test_keys_are_equal_as_python_holds_them(spark):
    same = [GOOD, GOOD | {"turn_number": True}, GOOD | {"session_id": "t"}, GOOD | {"session_id": 1}, GOOD | {"session_id": "1"}, GOOD | {"session_id": "t"}]
    assert rules(spark, *same) == [(1, "V08"), (5, "V08")]
    assert rules(spark, GOOD, expected=80) == [(-1, "V02")]
