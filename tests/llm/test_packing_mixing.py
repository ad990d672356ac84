import random

import numpy as np
import pytest

from colloq.llm.mixing import Mixture, _integer_weights, normal_source, pfair_schedule
from colloq.llm.packing import RoomTree, best_fit_decreasing, fills, pack
from colloq.llm.tokens import TOKENIZERS, VOCABULARY, count_tokens, encoding


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for s in sizes:
        fit = [(room, -i) for i, room in enumerate(rooms) if room >= s]
        if fit:
            room = min(fit)[0]
            i = max(i for i, x in enumerate(rooms) if x == room)
            rooms[i] -= s
        else:
            rooms.append(capacity - s)
        out.append(s)
    return sorted(rooms)


@pytest.mark.parametrize("capacity", [1, 7, 64, 1000])
def test_best_fit_equals_a_plain_search(capacity):
    r = random.Random(capacity)
    sizes = sorted((r.randrange(0, capacity + 1) for _ in range(200)), reverse=True)
    where = best_fit_decreasing(np.array(sizes), capacity)
    used = np.bincount(where, weights=sizes)
    assert used.max() <= capacity
    assert sorted(capacity - used.astype(int)) == plain_best_fit(sizes, capacity)


def test_room_tree():
    t = RoomTree(10)
    for room, c in ((3, 0), (7, 1), (10, 2)):
        t.add(room, c)
    assert t.take(4) == (7, 1) and t.take(4) == (10, 2) and t.take(4) is None and t.take(0) == (3, 0) and t.take(0) is None


def test_pack(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0, 5, 37, 99, 100, 101, 250, 1000])) for i in range(300)] + [(None, 5), (900, None), (901, -1)]
    items = spark.createDataFrame([(*x, "c", "k") for x in rows], "doc long, size long, container string, bin_kind string")
    got = pack(items, "doc", "size", [("s", 100), ("l", 1000), ("none", 0), (None, 5)], shard_items=50).collect()
    valid = {i: s for i, s in rows if i is not None and s is not None and s >= 0}
    for kind, capacity in (("s", 100), ("l", 1000)):
        mine = [x for x in got if x.bin_kind == kind]
        total, fill = {}, {}
        for x in mine:
            total[x.doc] = total.get(x.doc, 0) + x.size
            fill[x.container] = fill.get(x.container, 0) + x.size
            assert x.pieces if hasattr(x, "pieces") else True
        assert total == valid and max(fill.values()) <= capacity
        assert all(sum(x.doc == d for x in mine) == max(1, -(-s // capacity)) for d, s in valid.items())
        assert len(fill) <= -(-sum(valid.values()) // capacity) + 8
    assert {x.bin_kind for x in got} == {"s", "l"}
    assert all(f.used <= f.capacity for f in fills(pack(items, "doc", "size", [("s", 100)])).collect())
    assert pack(items.limit(0), "doc", "size", [("s", 100)]).count() == 0
    assert pack(items, "doc", "size", []).count() == 0


@pytest.mark.parametrize("weights", [[1], [1, 1], [3, 2, 1], [300, 150, 200, 80, 100, 120, 50], [1, 0, 5]])
def test_schedule_deviates_by_less_than_a_block(weights):
    total, done = sum(weights), [0] * len(weights)
    slots = pfair_schedule(weights)
    assert len(slots) == total
    for t, i in enumerate(slots, 1):
        done[i] += 1
        assert all(abs(d * total - w * t) < total for d, w in zip(done, weights))
    assert done == weights


def test_integer_weights():
    assert _integer_weights([1.0, 1.0, 1.0], 10) == [4, 3, 3] and sum(_integer_weights([0.3, 0.15, 0.2], 10_000)) == 10_000


RECORDS = "id long, src string, size long, source string, start string"


def test_mixture(spark):
    r = random.Random(5)
    rows = [(i, r.choices(["a", "b", "c", "other"], [6, 3, 1, 1])[0], r.randrange(1, 60)) for i in range(1500)] + [(None, "a", 5), (9001, None, 5), (9002, "a", 0), (9003, "a", None)]
    df = spark.createDataFrame([(*x, "z", "z") for x in rows], RECORDS)
    targets = [("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.4, 3), ("gone", 0.2, 1), (None, 0.1, 1), ("zero", 0.0, 1)]
    m = Mixture(df, "id", "src", "size", targets, block=200, bucket_records=100)
    size = {i: (s, n) for i, s, n in rows if i is not None}
    chosen = {x.id: x.repeats for x in m.records().collect()}
    limit = {"a": 1, "b": 2, "c": 3}
    assert all(size[i][0] in limit and 1 <= n <= limit[size[i][0]] for i, n in chosen.items())
    shares = {x.source: x for x in m.shares().collect()}
    used = {s: sum(size[i][1] * n for i, n in chosen.items() if size[i][0] == s) for s in limit}
    total = sum(used.values())
    assert shares["gone"].used == 0 and shares["gone"].actual_share == 0.0
    for s, w in (("a", 0.3), ("b", 0.3), ("c", 0.4)):
        assert shares[s].used == used[s] and abs(used[s] / total - w) < 0.005
        assert shares[s].actual_share == round(used[s] / total, 6)
    assert any(used[s] == shares[s].available * limit[s] for s in limit)  # one source is used up
    order = m.order().collect()
    assert sum(x.size for x in order) == total
    assert {i: sum(x.id == i for x in order) for i in chosen} == chosen
    blocks = {}
    for x in order:
        blocks[x.slot] = blocks.get(x.slot, x.source)
        assert blocks[x.slot] == x.source
    half = sorted(blocks)[: len(blocks) // 2]
    for s, w in (("a", 0.3), ("b", 0.3), ("c", 0.4)):
        assert abs(sum(blocks[k] == s for k in half) - w * (half[-1] + 1)) <= 2


def test_empty_mixture(spark):
    empty = spark.createDataFrame([], RECORDS)
    m = Mixture(empty, "id", "src", "size", [("a", 1.0, 1)])
    assert m.records().count() == 0 and m.order().count() == 0
    assert [(x.used, x.actual_share) for x in m.shares().collect()] == [(0, 0.0)]
    assert Mixture(empty, "id", "src", "size", []).records().count() == 0


def test_source_names(spark):
    df = spark.createDataFrame([(" Live-Draft ",), ("LIVE_DRAFT",), ("live draft",), (None,)], "s string")
    assert [x[0] for x in df.select(normal_source("s")).collect()] == ["live_draft"] * 3 + [None]


def test_tokens(spark):
    from pathlib import Path

    if not Path(TOKENIZERS).exists():
        pytest.skip("no tokenizers here")
    df = spark.createDataFrame([(1, "hello hello"), (2, None), (3, ""), (1, "hello hello"), (None, "x"), (4, "あ" * 50_000)], "id long, text string")
    got = {x.id: x.tokens for x in count_tokens(df, "id", "text").collect()}
    enc = encoding(TOKENIZERS, VOCABULARY)
    assert enc.decode(enc.encode_ordinary("hello hello")) == "hello hello"
    assert got[1] == len(enc.encode_ordinary("hello hello")) and got[2] == got[3] == 0 and got[4] > 1000 and len(got) == 4


def test_order_holds_sources_with_tiny_shares(spark):
    rows = [(i, "big", 1000) for i in range(300)] + [(1000, "tiny", 1), (1001, "small", 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    mix = Mixture(df, "doc_id", "source", "tokens", [("big", 0.99999, 1), ("tiny", 0.000004, 1), ("small", 0.000006, 1)], block=100)
    uses = sum(r.repeats for r in mix.records().collect())
    got = mix.order().collect()
    assert len(got) == uses and {r.source for r in got} == {r.source for r in mix.records().collect()} >= {"tiny", "big"}


@pytest.mark.parametrize("shares", [[1 / 3, 1 / 7, 1 - 1 / 3 - 1 / 7], [0.000015, 0.999985], [0.5, 0.3, 0.2]])
def test_long_mixtures_do_not_drift(spark, shares):
    blocks = 20_000
    rows = [(s * blocks * 2 + i, str(s), 10) for s, w in enumerate(shares) for i in range(int(w * blocks) + 2)]
    df = spark.createDataFrame(rows, "id long, source string, size long")
    mix = Mixture(df, "id", "source", "size", [(str(s), w, 1) for s, w in enumerate(shares)], block=10)
    done = [0] * len(shares)
    for n, x in enumerate(sorted(mix.order().collect(), key=lambda x: x.slot)[: blocks - 10], 1):
        done[int(x.source)] += 1
        assert x.slot == n - 1
        assert all(abs(d - w * n) < 2 for d, w in zip(done, shares, strict=True))


def test_room_tree_of_a_huge_capacity():
    sizes = np.array(sorted((random.Random(1).randrange(1, 10**9) for _ in range(2000)), reverse=True))
    where = best_fit_decreasing(sizes, 10**9)
    assert np.bincount(where, weights=sizes).max() <= 10**9
    t = RoomTree(10**9)
    t.add(5, 0)
    assert len(t.count) <= 32 and t.take(6) is None and t.take(5) == (5, 0) and not t.count and not t.open


def test_targets_as_a_table(spark):
    records = spark.createDataFrame([(i, "a" if i % 3 else "b", 5) for i in range(60)], "id long, source string, size long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("a", 0.25, 9), ("b", 0.5, 2), ("b", None, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {x.source: x for x in Mixture(records, "id", "source", "size", targets).shares().collect()}
    assert set(got) == {"a", "b"} and got["a"].target_share == 0.5 and got["a"].used == got["b"].used == 200
