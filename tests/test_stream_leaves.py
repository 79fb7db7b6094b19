"""Blocks of rows of many keys, without a stream around them, and processors that hold many keys in few state rows."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from rillflow.streaming import leaves as module
from rillflow.streaming.changes import _JoinChanges, _SetChanges, _TopChanges
from rillflow.streaming.leaves import Leaves, address

SCHEMA = pa.schema([("h", pa.int64()), ("place", pa.int64()), ("v", pa.int64())])


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map(dict):
    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def containsKey(self, key):
        return key in self

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    """State as a processor sees it, in memory."""

    def __init__(self):
        self.states = {}

    def getMapState(self, name, *schema):
        return self.states.setdefault(name, Map())

    def getValueState(self, name, *schema):
        return self.states.setdefault(name, Value())


def test_blocks_split_and_go(monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(module, "HELD", 20)
    rng, handle, want = random.Random(1), Handle(), {}
    store = Leaves(handle, "rows", SCHEMA)
    for turn in range(30):
        some = {(rng.choice([-(1 << 63), -5, 0, 7, (1 << 63) - 1]), rng.randrange(-40, 40)): turn for _ in range(40)}
        gone = {key for key in some if rng.random() < (0.3 if turn < 20 else 0.9)}
        want = {k: v for k, v in {**want, **some}.items() if k not in gone}
        h, place = (np.array(c, np.int64) for c in zip(*some))
        store.open()
        of = store.find(address(h, place))
        for blocks in store.parts(of):
            held = {(r["h"], r["place"]): r["v"] for r in store.read(blocks).to_pylist()}
            held.update({k: some[k] for k, b in zip(some, of) if b in blocks})
            rows = [{"h": k[0], "place": k[1], "v": v} for k, v in held.items() if k not in gone]
            store.write(blocks, pa.Table.from_pylist(rows, SCHEMA))
        store.close()
        store.open()
        every = store.read(np.arange(len(store.starts))).to_pylist()
        assert {(r["h"], r["place"]): r["v"] for r in every} == want and len(every) == len(want)
        assert store.sizes.max() <= 8 and len(handle.states["rows"]) <= len(want)


def test_many_keys_are_few_state_rows():
    """Before, each distinct row was a processor call and a state row of its own."""
    handle, out = Handle(), []
    keys = pd.DataFrame({"h": np.arange(20_000), "who": [f"k{i}" for i in range(20_000)], "l": 2, "r": 0})
    for frame in (keys, keys.assign(l=0, r=1), keys.assign(l=-2, r=-1)):
        changes = _SetChanges("except all")
        changes.init(handle)
        out.append(pd.concat(list(changes.handleInputRows((0,), iter([frame[:9000], frame[9000:]]), None))))
        assert len(handle.states["counts"]) <= 10
    assert [(len(x), set(x["sign"])) for x in out] == [(20_000, {2}), (20_000, {-1}), (20_000, {-1})]
    assert not handle.states["counts"] and not handle.states["counts_index"].exists()


def test_join_of_many_keys_in_few_state_rows(monkeypatch):
    monkeypatch.setattr("rillflow.streaming.changes.CHUNK", 70)
    monkeypatch.setattr(module, "BLOCK", 50)
    monkeypatch.setattr(module, "HELD", 400)
    rng, handle, net, sides = random.Random(3), Handle(), {}, [{}, {}]
    for _ in range(4):
        rows = [(rng.choice([0, 0, *range(60)]), rng.randrange(90), rng.choice([1, 1, 1, -1]), rng.randrange(2)) for _ in range(500)]
        frame = pd.DataFrame([(k, hash((b, side)), f"k{k}", f"{b}", n, side) for k, b, n, side in rows],
                             columns=["h", "place", "who", "body", "n", "side"])
        for k, b, n, side in rows:
            sides[side][k, b] = sides[side].get((k, b), 0) + n
        join = _JoinChanges()
        join.init(handle)
        for out in join.handleInputRows((0,), iter([frame]), None):
            assert len(out) <= 70
            for left, right, sign in out.itertuples(index=False):
                net[left, right] = net.get((left, right), 0) + sign
    want = {}
    for (k, a), n in sides[0].items():
        for (j, b), m in sides[1].items():
            if k == j:
                want[str(a), str(b)] = want.get((str(a), str(b)), 0) + n * m
    assert {x: n for x, n in net.items() if n} == {x: n for x, n in want.items() if n}
    assert len(handle.states["left"]) < 60


def test_first_rows_of_many_keys_in_few_state_rows(monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 30)
    monkeypatch.setattr("rillflow.streaming.changes.HELD", 100)
    rng, handle, net, left = random.Random(4), Handle(), {}, {}
    for _ in range(6):
        rows = [(rng.choice([0, 0, 0, *range(40)]), rng.randrange(200), rng.choice([1, 1, -1])) for _ in range(300)]
        frame = pd.DataFrame([(k, f"0 k{k}", 0, v, 0, f"{k} {v}", n) for k, v, n in rows],
                             columns=["h", "who", "part", "at", "tie", "body", "sign"])
        for k, v, n in rows:
            left[k, v] = left.get((k, v), 0) + n
        top = _TopChanges(3, 10, True)
        top.init(handle)
        for out in top.handleInputRows((0,), iter([frame]), None):
            for _, rank, body, sign in out.itertuples(index=False):
                net[body, rank] = net.get((body, rank), 0) + sign
        want = {}
        for k in {k for k, _ in left}:
            own = [v for (j, v), n in sorted(left.items()) if j == k for _ in range(n)]
            want.update({(f"{k} {v}", rank + 1): 1 for rank, v in enumerate(own[:3])})
        assert {x: n for x, n in net.items() if n} == want
    assert len(handle.states["blocks"]) < sum(n != 0 for n in left.values()) / 4
