"""Points in keyed state lie in blocks: the store is called per block, not per point, and nothing changes on the way."""

import pandas as pd

from contrail.streaming import track_state

BIG = (1 << 62) + 1


class Value:
    def __init__(self):
        self.held = []

    def exists(self):
        return bool(self.held)

    def get(self):
        return iter(self.held) if isinstance(self.held, list) else self.held

    def update(self, value):
        self.held = value

    def appendList(self, rows):
        self.held = self.held + rows

    put = update

    def clear(self):
        self.held = []


class Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, name, schema):
        return Value()

    def getValueState(self, name, schema):
        return Value()

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def points(n):
    rows = [(f"a{k % 7}", 1_000 * k, True, BIG + k, BIG - k, f"p{k}") for k in range(n)]
    return pd.DataFrame(rows, columns=["icao24", "t", "own", "arrival", "hash", "payload"])


def processor():
    one = track_state.PointsProcessor(100, None)
    one.init(Handle())
    return one


def test_state_holds_blocks():
    one, rows = processor(), points(25_000)
    list(one.handleInputRows((0, 0), iter([rows[:9_000], rows[9_000:9_000], rows[9_000:]]), None))
    assert len(one.points.held) <= 4
    out = pd.concat(one.handleExpiredTimer((0, 0), Clock(10_000), None))
    assert sorted(out["payload"], key=lambda p: int(p[1:])) == [f"p{k}" for k in range(10_001)] and out["new"].all()
    assert len(one.points.held) == 3  # all are within the window of what comes
    out = pd.concat(one.handleExpiredTimer((0, 0), Clock(24_999), None))
    assert out["new"].sum() == 25_000 - 10_001


def test_blocks_keep_values():
    rows = points(3)
    rows["arrival"] = pd.Series([BIG, None, BIG + 2], dtype=object)
    rows["icao24"] = ["b", None, "a"]
    back = track_state.from_blocks(iter(track_state.to_blocks(rows)))
    assert back[["icao24", "arrival", "hash", "payload"]].values.tolist() == [
        ["a", BIG + 2, BIG - 2, "p2"], ["b", BIG, BIG, "p0"], [None, None, BIG - 1, "p1"]
    ]
    assert track_state.from_blocks(iter([])).empty
