"""Entities of radio sentences."""

import pytest

from contrail.functions import text


@pytest.fixture(scope="module")
def extract(spark):
    def run(sentence):
        return text.with_entities(spark.createDataFrame([(sentence,)], "text string")).first()

    return run


@pytest.mark.parametrize(
    ("sentence", "kind", "want"),
    [
        ("United 456 turn left", "callsigns", ["UAL456"]),
        ("Delta 456 climb", "callsigns", ["DAL456"]),
        ("AAL123 and AAL 123", "callsigns", ["AAL123"]),
        ("N123AB ready", "callsigns", ["N123AB"]),
        ("November 1 2 3 Alpha Bravo", "callsigns", ["N1"]),
        ("air france 22 heavy", "callsigns", ["AFR22"]),
        ("cleared to land runway 7 and RWY 36R", "runways", ["07", "36R"]),
        ("climb flight level 350", "altitudes", [35000]),
        ("descend 10 thousand feet", "altitudes", [10000]),
        ("maintain 3500 feet", "altitudes", [3500]),
        ("turn heading 270 then heading 999", "headings", [270]),
        ("contact tower 118.3", "frequencies", [118.3]),
        ("contact one two four decimal", "frequencies", []),
        ("squawk 7700", "squawks", ["7700"]),
        ("squawk 1289", "squawks", []),
        ("speed 250 knots or 20 knots", "speeds", [250]),
        ("cleared for takeoff, turn right, contact ground, hold", "instructions",
         ["CLEARED TAKEOFF", "TURN RIGHT", "CONTACT GROUND", "HOLD"]),
        ("direct KMART roger tower", "waypoints", ["KMART"]),
        ("", "waypoints", []),
    ],
)
def test_entities(extract, sentence, kind, want):
    got = extract(sentence)[kind]
    assert got == want if kind == "instructions" else sorted(got) == sorted(want)


@pytest.mark.parametrize(
    ("sentence", "want"),
    [("Mayday mayday", True), ("PAN PAN PAN PAN", True), ("squawk 7600", True), ("squawking 7500", False), ("cleared", False)],
)
def test_emergency(extract, sentence, want):
    assert extract(sentence)["is_emergency"] is want


def test_struct(spark):
    row = text.entities(spark.createDataFrame([("United 1 climb",)], "text string")).first()
    assert row["entities"]["raw_text"] == "United 1 climb"
    assert row["entities"]["callsigns"] == ["UAL1"]
