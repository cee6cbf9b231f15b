"""Tiles of packed boxes: what they shuffle, and pairs made from them against lists."""

import random

import numpy as np
import pytest

from quadrille import registry
from quadrille.operators import pairs, tiles

SF = "/root/testdata/sf0.01"
LAYER = "id long, min_x double, min_y double, max_x double, max_y double, weight long"


def shuffled(spark, made):
    """Bytes that the stages of `made` shuffle."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        got = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {got.apply(i).stageId(): got.apply(i).shuffleWriteBytes() for i in range(got.size())}

    before = stages()
    made()
    return sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("name", ["cell_assignment_s", "cell_counts"])
def test_sums_shuffle_little(spark, name):
    assert shuffled(spark, lambda: registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()) < 22 * 25_000


@pytest.mark.parametrize("columns", [
    [np.array([-(1 << 63), (1 << 63) - 1, 0]), np.array([0.1, 1e308, -0.0])], [np.array([7]), np.array([1 / 64])], [np.arange(300) - 5, np.arange(300) / 64 - 180, np.arange(300) / 32 - 180],
    [np.zeros(4, np.int64), np.array([0.0, -0.0, 5e-324, -1.5]), np.array([1e300, 2.0**52, 3.0, 4.0])], [np.arange(70), np.arange(70) / 64, np.where(np.arange(70) == 69, 0.1, 1.0)]])
def test_packed_columns_come_back(columns):
    got = tiles.unpacked(tiles.packed(columns, {2: 1}))
    assert [(c.dtype, c.tobytes()) for c in got] == [(c.dtype, c.tobytes()) for c in columns]


def test_copies_follow_the_rows():
    n = np.array([1000, 400_000, 30, 500_000])
    copies = []
    for times in (1, 100):
        a, b = tiles.plan(times * n, times * n, 10**9, 48)
        assert (a * b).max() > 20
        copies.append((n * a + n * b).sum())
    assert copies[0] == copies[1]  # for each row: not more where pairs are more
    a, b = tiles.plan(n, n, 1000, 48)
    assert (n / a <= 1000).all() and (n / b <= 1000).all()


@pytest.mark.parametrize("name", ["candidates", "candidates_cpu_weight", "mbr_intersect_pairs"])
def test_pairs_shuffle_little(spark, name):
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as of layers that are too large for it
    try:
        assert shuffled(spark, lambda: registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()) < 30 * 25_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def layer(seed, n):
    """Boxes of many sizes, a hot spot, equal rows, ids, weights and bounds that are null, bounds in the wrong order."""
    rnd, out = random.Random(seed), [(None, -180.0, -90.0, 180.0, 90.0, 7), (1, 10.0, 20.0, 10.0, 20.0, None), (1, 10.0, 20.0, 10.0, 20.0, None), (2, None, 0.0, 1.0, 1.0, 3), (3, 12.0, 19.0, 9.0, 21.0, 5)]
    for i in range(n):
        x, y = (rnd.uniform(10, 10.2), rnd.uniform(20, 20.1)) if i % 2 else (rnd.uniform(-185, 180), rnd.uniform(-95, 90))
        e = rnd.choice([0, 0.001, 0.01]) if i % 2 else rnd.choice([0, 0.01, 0.3, 5, 120])
        out.append((10 + i, x, y, x + rnd.random() * e, y + rnd.random() * e, rnd.choice([0, 1, 3, 60])))
    return out


@pytest.mark.parametrize("dealt", [False, True])
def test_pairs_against_lists(spark, monkeypatch, dealt):
    if dealt:
        monkeypatch.setattr(pairs, "PART_ROWS", 60)
    a, b = layer(1, 400), layer(2, 300)
    expected = []
    for p in a:
        for q in b:
            if None not in (*p[1:5], *q[1:5]) and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]:
                x, y = ((max(p[i], q[i]) + min(p[i + 2], q[i + 2])) / 2 for i in (1, 2))
                expected.append((p[0], q[0], x, y, *((None, None) if None in (p[5], q[5]) else ((t := p[5] + q[5]) * max(0, t.bit_length() - 1), p[5] * q[5]))))
    r, s = (spark.createDataFrame(t, LAYER) for t in (a, b))
    for product, columns in ((False, (0, 1, 2, 3, 4)), (True, (0, 1, 2, 3, 5)), (None, (0, 1))):
        got = pairs.candidates(r, s, product)
        assert sorted(map(str, ([*x] for x in got.collect()))) == sorted(str([x[i] for i in columns]) for x in expected)
    assert pairs.candidates(r.limit(0), s).count() == 0


def test_a_cost_beyond_long_is_told():
    big = np.array([1 << 62, 3])
    assert pairs.costs(big, np.array([1, 5]), True).tolist() == [1 << 62, 15]
    with pytest.raises(OverflowError):
        pairs.costs(big, np.array([2, 5]), True)
    with pytest.raises(OverflowError):
        pairs.costs(big, np.array([2, 5]), False)
