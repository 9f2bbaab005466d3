"""Per-address intelligence and attack-technique columns.

Everything is looked up per distinct address, from hashes of the address, and then
joined back to the events; a table with real geolocation, network or reputation
data can take the place of each lookup.
"""

from pyspark.sql import Column, DataFrame, functions as F

from logsleuth.functions.columns import digest_mod, failed_count, round_half_even
from logsleuth.operators.distribute import skew_join, store
from logsleuth.operators.networks import lookup_ranges
from logsleuth.schema import INTERNAL_IP, OTHER

# Places an address can hash to (country, city, latitude, longitude).
PLACES = [
    ("United States", "New York", 40.71, -74.01),
    ("Russia", "Moscow", 55.75, 37.62),
    ("China", "Beijing", 39.90, 116.40),
    ("Germany", "Berlin", 52.52, 13.40),
    ("Brazil", "São Paulo", -23.55, -46.63),
    ("India", "Mumbai", 19.08, 72.88),
    ("Nigeria", "Lagos", 6.52, 3.38),
    ("Iran", "Tehran", 35.69, 51.39),
    ("North Korea", "Pyongyang", 39.02, 125.75),
    ("Ukraine", "Kyiv", 50.45, 30.52),
    ("Japan", "Tokyo", 35.68, 139.69),
    ("South Korea", "Seoul", 37.57, 126.98),
    ("United Kingdom", "London", 51.51, -0.13),
    ("France", "Paris", 48.86, 2.35),
    ("Netherlands", "Amsterdam", 52.37, 4.90),
]

# Threat index per country; any other country has DEFAULT_RISK.
COUNTRY_RISK = {
    "Russia": 0.90, "China": 0.85, "North Korea": 0.95, "Iran": 0.88,
    "Nigeria": 0.70, "Brazil": 0.50, "Ukraine": 0.65, "India": 0.35,
    "United States": 0.25, "Germany": 0.15, "Japan": 0.10,
    "United Kingdom": 0.12, "France": 0.14, "Netherlands": 0.20,
    "South Korea": 0.15,
}
DEFAULT_RISK = 0.30

# Networks an address can hash to.
NETWORKS = [
    "AS15169 — Google LLC",
    "AS13335 — Cloudflare Inc",
    "AS16509 — Amazon.com Inc",
    "AS8075  — Microsoft Corp",
    "AS4134  — ChinaNet",
    "AS12389 — Rostelecom",
    "AS9009  — M247 Ltd (VPN)",
    "AS14061 — DigitalOcean LLC",
    "AS20473 — Vultr Holdings",
    "AS36352 — ColoCrossing (bulletproof)",
]
INTERNAL_NETWORK = "AS0 — Internal"

# What an address is in that no range of a table of real data holds.
UNKNOWN = "Unknown"

# Event -> (technique, name, tactic, description).
TECHNIQUES = {
    "FAILED_LOGIN": (
        "T1110", "Brute Force", "Credential Access",
        "Adversary attempts to gain access via systematic password guessing.",
    ),
    "SUCCESSFUL_LOGIN": (
        "T1078", "Valid Accounts", "Initial Access",
        "Adversary uses valid credentials to gain access.",
    ),
    "ROOT_ACCESS": (
        "T1548", "Abuse Elevation Control Mechanism", "Privilege Escalation",
        "Adversary escalates privileges to root/admin.",
    ),
    "SUDO_ATTEMPT": (
        "T1548.003", "Sudo and Sudo Caching", "Privilege Escalation",
        "Adversary uses sudo to execute with elevated privileges.",
    ),
    "INVALID_USER": (
        "T1110.001", "Password Guessing", "Credential Access",
        "Adversary attempts login with non-existent usernames.",
    ),
    "DISCONNECT": (
        "T1070", "Indicator Removal", "Defense Evasion",
        "Session disconnection may indicate cleanup activity.",
    ),
    "OTHER": (
        "T1059", "Command and Scripting Interpreter", "Execution",
        "General system activity.",
    ),
}

# Reputation of internal traffic, weight and cap of the two penalties.
INTERNAL_REPUTATION = 0.95
FAILURE_PENALTY, FAILURE_PENALTY_CAP, COUNTRY_PENALTY = 0.05, 0.4, 0.3


def _pick(rows: list, index: Column, field: int) -> Column:
    """Field of a small fixed table by zero-based row number."""
    return F.element_at(F.array(*[F.lit(row[field]) for row in rows]), (index + 1).cast("int"))


def is_local(ip: Column) -> Column:
    return (ip == INTERNAL_IP) | ip.startswith("127.") | ip.startswith("10.")


def with_geo(per_ip: DataFrame) -> DataFrame:
    """Country, city, latitude and longitude of ``ip_address``."""
    ip = F.col("ip_address")
    place = digest_mod(F.md5(ip.cast("binary")), 32, len(PLACES))
    local = is_local(ip)
    return (
        per_ip.withColumn("_place", place)
        .withColumns(
            {
                "geo_country": F.when(local, "Local").otherwise(_pick(PLACES, F.col("_place"), 0)),
                "geo_city": F.when(local, "Internal").otherwise(_pick(PLACES, F.col("_place"), 1)),
                "geo_lat": F.when(local, 0.0).otherwise(_pick(PLACES, F.col("_place"), 2)),
                "geo_lon": F.when(local, 0.0).otherwise(_pick(PLACES, F.col("_place"), 3)),
            }
        )
        .drop("_place")
    )


def country_risk(country: Column) -> Column:
    pairs = [F.lit(part) for item in COUNTRY_RISK.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), country), F.lit(DEFAULT_RISK))


def with_geo_risk(per_ip: DataFrame) -> DataFrame:
    return per_ip.withColumn("geo_risk", country_risk(F.col("geo_country")))


def with_reputation(per_ip: DataFrame) -> DataFrame:
    """0 (malicious) to 1 (clean) from the address, its failures and its country."""
    base = digest_mod(F.sha2(F.col("ip_address").cast("binary"), 256), 64, 100) / 100.0
    failures = F.least(F.col("failed_count") * FAILURE_PENALTY, F.lit(FAILURE_PENALTY_CAP))
    score = base - failures - F.col("geo_risk") * COUNTRY_PENALTY
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return per_ip.withColumn(
        "ip_reputation",
        F.when(F.col("ip_address") == INTERNAL_IP, INTERNAL_REPUTATION).otherwise(
            round_half_even(bounded, 3)
        ),
    )


def with_asn(per_ip: DataFrame) -> DataFrame:
    ip = F.col("ip_address")
    network = digest_mod(F.sha1(ip.cast("binary")), 40, len(NETWORKS))
    return per_ip.withColumn(
        "asn",
        F.when(ip == INTERNAL_IP, INTERNAL_NETWORK).otherwise(
            F.element_at(F.array(*map(F.lit, NETWORKS)), (network + 1).cast("int"))
        ),
    )


def _by_event(texts: dict[str, str]) -> Column:
    """Fixed text of each event type; unknown types count as OTHER."""
    pairs = [F.lit(part) for item in texts.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("event")), F.lit(texts[OTHER]))


def with_technique(events: DataFrame) -> DataFrame:
    """Attack technique and tactic of each event."""
    techniques = {event: f"{row[0]} — {row[1]}" for event, row in TECHNIQUES.items()}
    tactics = {event: row[2] for event, row in TECHNIQUES.items()}
    return events.withColumns(
        {"mitre_technique": _by_event(techniques), "mitre_tactic": _by_event(tactics)}
    )


def with_description(events: DataFrame) -> DataFrame:
    """What the attack technique of each event stands for."""
    return events.withColumn("mitre_description", _by_event({event: row[3] for event, row in TECHNIQUES.items()}))


PLACE_COLUMNS = ["geo_country", "geo_city", "geo_lat", "geo_lon"]


def with_places(per_ip: DataFrame, ranges: DataFrame) -> DataFrame:
    """Place of each address from a table of ranges (first_ip, last_ip and the place's columns).

    Local addresses stay local; addresses in no range are in an unknown place.
    """
    found = lookup_ranges(per_ip.drop(*PLACE_COLUMNS), ranges.select("first_ip", "last_ip", *PLACE_COLUMNS))
    local = is_local(F.col("ip_address"))
    fixed = {"geo_country": "Local", "geo_city": "Internal", "geo_lat": 0.0, "geo_lon": 0.0}
    unknown = {"geo_country": UNKNOWN, "geo_city": UNKNOWN}
    columns = {
        c: F.when(local, value).otherwise(F.coalesce(c, F.lit(unknown[c])) if c in unknown else F.col(c))
        for c, value in fixed.items()
    }
    return found.withColumns(columns).drop("first_ip", "last_ip")


def with_networks(per_ip: DataFrame, ranges: DataFrame) -> DataFrame:
    """Network (asn) of each address from a table of ranges; unknown without one."""
    found = lookup_ranges(per_ip.drop("asn"), ranges.select("first_ip", "last_ip", "asn"))
    inside = F.col("ip_address") == INTERNAL_IP
    asn = F.when(inside, INTERNAL_NETWORK).otherwise(F.coalesce("asn", F.lit(UNKNOWN)))
    return found.withColumn("asn", asn).drop("first_ip", "last_ip")


def ip_intel(
    events: DataFrame,
    addresses: DataFrame | None = None,
    places: DataFrame | None = None,
    networks: DataFrame | None = None,
) -> DataFrame:
    """One row per address: event counts, place, risk, reputation and network.

    ``addresses`` (total_events and failed_count of each) saves the pass over the events.
    ``places`` and ``networks`` are tables of ranges with real data, see :func:`with_places`
    and :func:`with_networks`; risk and reputation follow from the places.
    """
    if addresses is None:
        counts = events.groupBy("ip_address").agg(
            F.count("*").alias("total_events"), failed_count().alias("failed_count")
        )
    else:
        counts = addresses.select("ip_address", "total_events", "failed_count")
    placed = with_geo(counts) if places is None else with_places(counts, places)
    judged = with_reputation(with_geo_risk(placed))
    return with_asn(judged) if networks is None else with_networks(judged, networks)


def enrich_events(events: DataFrame, intel: DataFrame | None = None) -> DataFrame:
    """Events with all intelligence columns.

    ``intel`` may be any per-address table with the columns of :func:`ip_intel`. It is read
    several times and should be stored; without it one is made and stored.
    """
    intel = (store(ip_intel(events)) if intel is None else intel).drop("failed_count")
    return with_technique(skew_join(events, intel, ["ip_address"], "total_events"))
