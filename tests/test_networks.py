"""Address ranges against brute force, real tables in place of the fixed ones, and sketches."""

import random

import pytest
from pyspark.sql import functions as F

from logsleuth.operators import activity, detect, enrich, networks


def dotted(n):
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def number(ip):
    a, b, c, d = map(int, ip.split("."))
    return a << 24 | b << 16 | c << 8 | d


def blocks_of(first, last):
    """Blocks by taking the largest that fits, again and again."""
    while first <= last:
        k = 0
        while k < 32 and first % (2 << k) == 0 and first + (2 << k) - 1 <= last:
            k += 1
        yield 32 - k, first >> k
        first += 1 << k


def test_blocks(spark):
    rng = random.Random(2)
    ends = [(0, 2**32 - 1), (0, 0), (2**32 - 1, 2**32 - 1), (1, 2**32 - 2), (5, 5), (4, 7), (3, 8)]
    ends += [tuple(sorted((rng.randrange(2**32), rng.randrange(2**32)))) for _ in range(40)]
    ends += [(a, a + rng.randrange(2**9)) for a in (rng.randrange(2**31) for _ in range(40))]
    for i, (first, last) in enumerate(ends):
        if i < 8 or i % 9 == 0:
            one = spark.createDataFrame([(dotted(first), dotted(last), i)], "first_ip string, last_ip string, id int")
            found = [tuple(r) for r in networks.aligned_blocks(one).select("length", "prefix").collect()]
            assert sorted(found) == sorted(blocks_of(first, last))


@pytest.mark.parametrize("short", [0, 12, 32])
def test_lookup(spark, monkeypatch, short):
    monkeypatch.setattr(networks, "SHORT", short)
    rng = random.Random(7)
    base = [rng.randrange(2**32) for _ in range(6)]
    ranges = [(0, 2**32 - 1, "all")] if short else []
    for i in range(120):
        first = max(0, rng.choice(base) - rng.randrange(2 ** rng.randint(1, 24)))
        ranges.append((first, min(2**32 - 1, first + rng.randrange(2 ** rng.randint(1, 26))), f"r{i % 50}"))
    ips = [dotted((rng.choice(base) + rng.randint(-(2**20), 2**20)) % 2**32) for _ in range(300)]
    ips += ["Internal", "1.2.3", "300.1.1.1", "1.2.3.4.5", "", None, "::1"]
    rows = [(dotted(a), dotted(b), n) for a, b, n in ranges] + [("9.9.9.9", "1.1.1.1", "wrong"), (None, "1.1.1.1", "none")]
    table = spark.createDataFrame(rows, "first_ip string, last_ip string, network string")
    frame = spark.createDataFrame([(ip, 1, "old") for ip in ips], "ip_address string, n int, network string").distinct()
    got = {r.ip_address: (r.network, r.first_ip, r.last_ip) for r in networks.lookup_ranges(frame, table).collect()}
    assert len(got) == len(set(ips))
    for ip, result in got.items():
        holding = []
        if ip and ip.count(".") == 3 and ip != "300.1.1.1":
            holding = [(b - a, a, n, dotted(a), dotted(b)) for a, b, n in ranges if a <= number(ip) <= b]
        want = min(holding)[2:] if holding else (None, None, None)
        assert result == want


def test_real_tables_replace_the_fixed_ones(spark, make_events):
    events = make_events([{"ip": ip} for ip in ("5.6.7.8", "9.9.9.9", "10.0.0.1", "Internal")])
    places = spark.createDataFrame(
        [("5.0.0.0", "5.255.255.255", "Wide", "W", 1.0, 2.0), ("5.6.0.0", "5.6.255.255", "China", "C", 3.0, 4.0), ("10.0.0.0", "10.0.0.9", "X", "Y", 5.0, 6.0)],
        "first_ip string, last_ip string, geo_country string, geo_city string, geo_lat double, geo_lon double",
    )
    asns = spark.createDataFrame([("5.6.7.0", "5.6.7.255", "AS1")], "first_ip string, last_ip string, asn string")
    found = {r.ip_address: r for r in enrich.ip_intel(events, places=places, networks=asns).collect()}
    assert (found["5.6.7.8"].geo_country, found["5.6.7.8"].geo_lat, found["5.6.7.8"].geo_risk, found["5.6.7.8"].asn) == ("China", 3.0, 0.85, "AS1")
    assert (found["9.9.9.9"].geo_country, found["9.9.9.9"].geo_lat, found["9.9.9.9"].geo_risk, found["9.9.9.9"].asn) == ("Unknown", None, 0.3, "Unknown")
    assert found["10.0.0.1"].geo_country == "Local" and found["Internal"].asn == "AS0 — Internal"
    enriched = enrich.enrich_events(events, enrich.ip_intel(events, places=places, networks=asns))
    assert {r.geo_country for r in enriched.collect()} == {"China", "Unknown", "Local"}


def test_sketches(spark, make_events):
    rows = [{"ip": "a", "user": f"u{i}", "host": f"h{i % 3}", "at": i * 40} for i in range(6000)]
    rows += [{"ip": "b", "user": "x", "event": "SUCCESSFUL_LOGIN"}, {"ip": "b", "user": None}]
    events = make_events(rows)
    day = F.col("parsed_time").cast("date")
    first = events.select(F.min(day)).first()[0]
    sketches = [activity.activity_sketches(events.filter(part)) for part in (day == first, day > first)]
    found = activity.sketched_addresses(sketches[0].unionByName(sketches[1]))
    got = {r.ip_address: r for r in found.collect()}
    assert abs(got["a"].unique_users - 6000) < 0.03 * 6000 and got["a"].hosts_accessed == 3
    assert (got["b"].unique_users, got["b"].failing_users, got["b"].failed_count, got["b"].failed_with_user) == (1, 0, 1, 0)
    assert [r.ip_address for r in detect.multi_host_access(events, found).collect()] == ["a"]
    stuffing = {r.ip_address: r.is_stuffing for r in detect.credential_stuffing(events, found).collect()}
    assert stuffing == {"a": True, "b": False}
