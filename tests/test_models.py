"""User states and campaigns against plain implementations, under forced splitting."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsleuth.operators import behaviour, campaigns, components, distribute, insiders
from logsleuth.schema import IP_FEATURE_COLUMNS

EVENTS = {
    0: ("SUCCESSFUL_LOGIN", "seen"), 1: ("FAILED_LOGIN", "seen"), 3: ("SUCCESSFUL_LOGIN", None), 4: ("SUDO_ATTEMPT", "seen"),
}
NAMES = "NORMAL ELEVATED COMPROMISED".split()


def plain_path(observations):
    score = [behaviour._FIRST[observations[0]][j] for j in range(3)]
    back = []
    for o in observations[1:]:
        options = [[score[i] + int(behaviour._STEP[o][i][j]) for i in range(3)] for j in range(3)]
        back.append([row.index(max(row)) for row in options])
        score = [max(row) for row in options]
    state = score.index(max(score))
    path = [state]
    for pointers in reversed(back):
        path.append(state := pointers[path[-1]])
    return path[::-1]


def float_path(observations):
    """The textbook decoder on floating-point logarithms."""
    log = lambda p: np.log(np.array(p) + 1e-10)
    start, move, emit = log(behaviour.START), log(behaviour.TRANSITION), log(behaviour.EMISSION)
    score, back = start + emit[:, observations[0]], []
    for o in observations[1:]:
        options = score[:, None] + move + emit[:, o][None, :]
        back.append(options.argmax(axis=0))
        score = options.max(axis=0)
    path = [int(score.argmax())]
    for pointers in reversed(back):
        path.append(int(pointers[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize(
    "observations, path, risk",
    [
        ([3, 0, 0, 0], "NNNN", 0.0),
        ([1, 1], "EE", 0.3),
        ([1, 1, 1, 1, 1], "CCCCC", 0.7),
        ([3, 2, 2, 2], "CCCC", 0.7),
        ([1, 1, 1, 1, 1, 3, 4], "CCCCCCC", 0.7),
        ([0, 0, 1, 0, 0], "NNNNN", 0.0),
        ([4, 4, 4], "NNN", 0.0),
        ([1] * 10 + [0, 0, 0], "C" * 10 + "NNN", 0.538),
    ],
)
def test_golden_paths(spark, monkeypatch, observations, path, risk):
    assert "".join(NAMES[s][0] for s in plain_path(observations)) == path
    frame = spark.createDataFrame(
        [("u", i, o) for i, o in enumerate(observations)], "username string, line_number long, observation int"
    ).withColumns({"parsed_time": F.lit("2024-01-01").cast("timestamp_ntz"), "source_file": F.lit("f")})
    monkeypatch.setattr(behaviour, "user_observations", lambda events: frame)
    row = behaviour.user_profiles(None, fan_out=2).first()
    assert (row["risk"], row["current_state"][0]) == (risk, path[-1])


@pytest.mark.parametrize("fan_out", [2, 5, 4096])
def test_states_do_not_depend_on_chunks(spark, monkeypatch, fan_out):
    rng = np.random.default_rng(11)
    users = {f"u{n}": rng.integers(0, 5, size).tolist() for n, size in enumerate([1, 2, 3, 17, 64, 333])}
    data = [(u, i, int(o)) for u, obs in users.items() for i, o in enumerate(obs)]
    frame = spark.createDataFrame(data, "username string, line_number long, observation int").withColumns(
        {"parsed_time": F.lit("2024-01-01").cast("timestamp_ntz"), "source_file": F.lit("f")}
    )
    monkeypatch.setattr(behaviour, "user_observations", lambda events: frame)
    decoded = behaviour.user_state_path(None, fan_out=fan_out).orderBy("line_number").collect()
    for user, observations in users.items():
        states = [NAMES.index(r["state"]) for r in decoded if r["username"] == user]
        assert states == (plain_path(observations) if len(observations) > 1 else [0])
        if len(observations) > 1:
            assert states == float_path(observations)


def test_observation_codes(make_events, rows_of):
    import datetime as dt

    night = dt.datetime(2024, 6, 15, 4, 59, 59)
    data = [
        {"at": night, "event": "SUCCESSFUL_LOGIN", "ip": "a"},
        {"at": 0, "event": "SUCCESSFUL_LOGIN", "ip": "a"},
        {"at": 1, "event": "SUCCESSFUL_LOGIN", "ip": "b"},
        {"at": 2, "event": "FAILED_LOGIN", "ip": "c"},
        {"at": 3, "event": "SUCCESSFUL_LOGIN", "ip": "c"},
        {"at": 4, "event": "ROOT_ACCESS", "ip": "b"},
        {"at": 5, "event": "DISCONNECT", "ip": "b"},
        {"at": 6, "event": "SUCCESSFUL_LOGIN", "ip": "z", "user": "unknown"},
    ]
    got = rows_of(behaviour.user_observations(make_events(data)), "line_number", "observation")
    assert got == [(0, 2), (1, 0), (2, 3), (3, 1), (4, 0), (5, 4), (6, 0)]


def test_insiders(make_events):
    data = [{"event": "SUDO_ATTEMPT", "ip": f"1.1.1.{i}", "user": "eve"} for i in range(5)]
    data += [{"event": "SUCCESSFUL_LOGIN", "user": "ann", "at": 100 + i} for i in range(5)]
    events = make_events(data)
    found = insiders.insider_threats(events, behaviour.user_profiles(events)).collect()
    assert [(r["username"], r["event_count"]) for r in found] == [("eve", 5)]
    assert "Accessed from 5 different IPs" in found[0]["indicators"]


@pytest.mark.parametrize("at_once", [0, 200_000])
def test_components(spark, rows_of, monkeypatch, at_once):
    monkeypatch.setattr(components, "LINKS_AT_ONCE", at_once)
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    shuffled = [(7, 300), (300, 2)]
    links = spark.createDataFrame(chain[::-1] + star + shuffled, "a long, b long")
    vertices = [*range(41), *range(100, 130), 300, 999]
    found = dict(rows_of(components.connected_components(spark.createDataFrame([(v,) for v in vertices], "v long"), links), "v", "root"))
    assert found == {**{v: 0 for v in [*range(41), 300]}, **{v: 100 for v in range(100, 130)}, 999: 999}
    start = spark.createDataFrame(list(found.items()), "v long, root long")
    more = spark.createDataFrame([(129, 999), (999, 129), (5, 300)], "a long, b long")
    again = dict(rows_of(components.connected_components(start.select("v"), more, start), "v", "root"))
    assert again == {**found, 999: 100}


def plain_dbscan(points, eps, min_samples):
    """The published algorithm in row order."""
    near = [[j for j, q in enumerate(points) if math.dist(p, q) <= eps] for p in points]
    core = [len(n) >= min_samples for n in near]
    label, clusters = [-1] * len(points), 0
    for i in range(len(points)):
        if not core[i] or label[i] >= 0:
            continue
        label[i], queue = clusters, [i]
        while queue:
            for j in near[queue.pop()]:
                if label[j] < 0:
                    label[j] = clusters
                    if core[j]:
                        queue.append(j)
        clusters += 1
    return label


def campaign_input(spark, vectors):
    width = len(IP_FEATURE_COLUMNS)
    data = [(f"ip{i:04d}", *[float(v) for v in vector], *[0.0] * (width - len(vector))) for i, vector in enumerate(vectors)]
    frame = spark.createDataFrame(data, ["ip_address", *IP_FEATURE_COLUMNS])
    seen = frame.select(
        "ip_address",
        F.struct(
            F.lit("2024-01-01").cast("timestamp_ntz").alias("parsed_time"),
            F.lit("f").alias("source_file"),
            F.substring("ip_address", 3, 4).cast("long").alias("line_number"),
        ).alias("first_seen"),
    )
    return frame, seen


def check_campaigns(spark, vectors, **options):
    frame, seen = campaign_input(spark, vectors)
    got = {r["ip_address"]: r for r in campaigns.ip_campaigns(frame, seen, **options).collect()}
    scaled = {r["ip_address"]: r for r in campaigns.scaled_features(frame).collect()}
    params = {**campaigns.dbscan_params(frame).first().asDict(), **options}
    ips = sorted(got)
    points = [[scaled[ip][c] for c in IP_FEATURE_COLUMNS] for ip in ips]
    expected = plain_dbscan(points, params["eps"], params["min_samples"])
    assert [got[ip]["campaign_cluster"] for ip in ips] == expected
    return expected


# Points a leaf owns, points that meet in a task, and points all blocks of a leaf share.
SPLITS = [(2_048, 16_384, 64), (20, 16_384, 64), (20, 15, 3), (10_000, 40, 1), (10_000, 7, 0)]


def force_splits(monkeypatch, leaf, block, pivots):
    monkeypatch.setattr(campaigns, "LEAF_POINTS", leaf)
    monkeypatch.setattr(campaigns, "BLOCK_POINTS", block)
    monkeypatch.setattr(campaigns, "PIVOTS", max(pivots, 1) if block > pivots else block)
    monkeypatch.setattr(campaigns, "LEAST_SAMPLED", 4)
    monkeypatch.setattr(campaigns, "TILE", 8)


@pytest.mark.parametrize("splits", SPLITS)
def test_campaigns_in_the_plane(spark, monkeypatch, splits):
    force_splits(monkeypatch, *splits)
    rng = np.random.default_rng(5)
    blobs = [rng.normal(center, 0.35, (70, 2)) for center in ([0, 0], [2.2, 0.4], [9, 9])]
    copies = np.repeat([[5.0, -4.0], [5.6, -4.3]], 6, axis=0)
    lone = rng.uniform(-12, 12, (25, 2))
    vectors = rng.permutation(np.vstack([*blobs, copies, lone]))
    expected = check_campaigns(spark, vectors)
    assert len(set(expected)) > 2
    assert len(set(check_campaigns(spark, vectors, eps=0.12, min_samples=3))) == 5


@pytest.mark.parametrize("splits", SPLITS)
def test_campaigns_in_many_dimensions(spark, monkeypatch, splits):
    force_splits(monkeypatch, *splits)
    monkeypatch.setattr(distribute, "HOT_ROWS", 5)
    rng = np.random.default_rng(6)
    centers = rng.uniform(-5, 5, (4, 13))
    vectors = np.vstack([c + rng.normal(0, s, (n, 13)) for c, s, n in zip(centers, (0.05, 0.3, 0.6, 0.9), (60, 60, 60, 60))])
    expected = check_campaigns(spark, rng.permutation(vectors))
    assert max(expected) >= 1 and -1 in expected


def test_chain_through_many_leaves(spark, monkeypatch):
    force_splits(monkeypatch, 10, 6, 1)
    line = [[i * 0.5, 0.0] for i in range(120)] + [[200.0 + i * 0.5, 40.0] for i in range(60)]
    expected = check_campaigns(spark, np.random.default_rng(1).permutation(line), eps=0.02, min_samples=2)
    assert sorted(collections.Counter(expected).values()) == [60, 120]


def test_neighbours_and_components():
    rng = np.random.default_rng(9)
    for _ in range(60):
        n, d = rng.integers(1, 400), rng.integers(1, 6)
        x = rng.normal(0, rng.uniform(0.1, 2), (n, d))
        weight = rng.integers(1, 3, n)
        near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.5
        counts, (i, j) = campaigns.count_near(x[: n // 2], x, weight, 0.5, 4)
        full = near[: n // 2] @ weight
        assert ((counts >= 4) == (full >= 4)).all() and (counts[full < 4] == full[full < 4]).all()
        want = {(a, b) for a, b in zip(*np.nonzero(near[: n // 2])) if full[a] < 4}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want
        labels = campaigns.local_components(x, 0.5)
        reach = near
        for _ in range(10):
            reach = (reach.astype(int) @ reach) > 0
        assert ((labels[:, None] == labels[None]) == reach).all()


def test_leaves_hold_all_neighbours(spark, monkeypatch):
    force_splits(monkeypatch, 20, 1000, 1)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (500, 4))
    tree, leaves = campaigns.split_tree(x, 1.0, 0.3)
    frame = spark.createDataFrame([(i, 1, [float(v) for v in row]) for i, row in enumerate(x)], "pid long, weight long, x array<double>")
    rows = campaigns.placed(frame.repartition(3), tree, 0.3).collect()
    assert leaves > 8 and sorted(r.pid for r in rows if r.own) == list(range(500))
    held = collections.defaultdict(set)
    for r in rows:
        held[r.leaf].add(r.pid)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.3
    assert all(set(np.flatnonzero(near[r.pid])) <= held[r.leaf] for r in rows if r.own)


def test_rows_grow_with_points_not_pairs(spark):
    """Ten times the points in the same space: a hundred times the pairs, ten times the rows."""
    rng = np.random.default_rng(4)
    rows = {}
    for n in (400, 4_000):
        x = rng.normal(0, 1, (n, 3))
        counts, pairs = campaigns.count_near(x, x, np.ones(n, np.int64), 0.8, 5)
        rows[n] = len(pairs[0]), int((np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.8).sum())
        assert len(np.unique(campaigns.local_components(x, 0.8))) < n
    assert rows[4_000][1] > 90 * rows[400][1] and rows[4_000][0] <= 10 * max(rows[400][0], 1)


def test_borders_of_leaves_hold_few_points():
    """In thirteen dimensions leaves as small as wanted would hold all points many times over."""
    x = np.random.default_rng(8).normal(0, 1, (4_000, 13))
    assert campaigns.split_tree(x, 100.0, 0.8)[1] == 1
    apart = np.concatenate([x, x + np.eye(13)[4] * 12])
    tree, leaves = campaigns.split_tree(apart, 100.0, 0.8)
    assert leaves == 2 and tree[0] == 4 and 3 < tree[1] < 9


def test_open_points_meet_few_blocks_at_first(spark, monkeypatch):
    """Points that have enough neighbours in the next blocks are not brought to all of them."""
    force_splits(monkeypatch, 10_000, 40, 1)
    brought, counted = [], campaigns._counted

    def watched(rows, keys, eps, enough):
        if "part" in keys:
            brought.append(rows.filter("probe").count())
        return counted(rows, keys, eps, enough)

    monkeypatch.setattr(campaigns, "_counted", watched)
    rng = np.random.default_rng(11)
    frame, seen = campaign_input(spark, rng.normal(0, 1, (800, 2)))
    campaigns.ip_campaigns(frame, seen, eps=0.5, min_samples=5).collect()
    assert 2 <= len(brought) <= 3 and sum(brought) < brought[0] / 3 * 19 / 2
    check_campaigns(spark, rng.normal(0, 1, (400, 2)), eps=0.25, min_samples=5)


def test_distances_at_the_very_edge():
    """Products of matrices round otherwise than differences; what they leave open is computed plainly."""
    rng = np.random.default_rng(12)
    a = np.round(rng.normal(0, 3, (300, 13)), 1) + 1e6
    b = a[:, None] + 0.8 * np.eye(13)[None, :3]
    b = np.concatenate([b.reshape(-1, 13), np.nextafter(a, np.inf), np.full((1, 13), np.nan), np.full((1, 13), np.inf)])
    total = np.zeros((len(a), len(b)))
    with np.errstate(invalid="ignore"):
        for d in range(13):
            total += (a[:, d, None] - b[None, :, d]) ** 2
        assert (campaigns.within(a, b, 0.8) == (np.sqrt(total) <= 0.8)).all()


def test_campaigns_of_few_addresses(spark):
    frame, seen = campaign_input(spark, [[0.0], [1.0]])
    assert {r["campaign_cluster"] for r in campaigns.ip_campaigns(frame, seen).collect()} == {-1}
    same = check_campaigns(spark, [[1.0]] * 4)
    assert same == [0] * 4
