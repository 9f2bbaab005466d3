"""What every address did, aggregated from the events once and shared by all that ask.

A cell has the events of one address, user and host: counts, sums, earliest and latest times,
all of which can be added up. Addresses are made of cells. Cells of further days are merged
into those there are without reading old events, so a log that grows is read once.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logsleuth.functions.columns import failed_count, is_night_login, micros, success_count
from logsleuth.operators.chains import PHASE_ORDER, phase_of
from logsleuth.operators.distribute import store
from logsleuth.schema import FAILED, SUCCESS

# Decoy accounts nobody has a legitimate reason to use.
HONEY_USERS = ["admin_backup", "db_service_acct", "svc_forensics"]

CELL = ["ip_address", "username", "host"]
PHASE_COUNTS = [f"phase_{p.lower()}" for p in PHASE_ORDER]
SUMS = ["total_events", "failed_count", "success_count", "night_logins", "hour_sum", "hour_squares", *PHASE_COUNTS]
EARLIEST, LATEST = ["first_seen", "first_fail"], ["last_seen", "last_success"]


def activity_cells(events: DataFrame) -> DataFrame:
    """One row per address, user and host, in one pass that combines before the shuffle."""
    hour = F.hour("parsed_time").cast("long")
    failed, success = F.col("event") == FAILED, F.col("event") == SUCCESS
    phases = [F.count_if(phase_of() == p).alias(c) for p, c in zip(PHASE_ORDER, PHASE_COUNTS)]
    return events.groupBy(*CELL).agg(
        F.count("*").alias("total_events"),
        failed_count().alias("failed_count"),
        success_count().alias("success_count"),
        F.count_if(is_night_login()).alias("night_logins"),
        F.sum(hour).alias("hour_sum"),
        F.sum(hour * hour).alias("hour_squares"),
        *phases,
        F.min("parsed_time").alias("first_seen"),
        F.min(F.when(failed, F.col("parsed_time"))).alias("first_fail"),
        F.max("parsed_time").alias("last_seen"),
        F.max(F.when(success, F.col("parsed_time"))).alias("last_success"),
    )


def _added_up() -> list[Column]:
    return [
        *(F.sum(c).alias(c) for c in SUMS),
        *(F.min(c).alias(c) for c in EARLIEST),
        *(F.max(c).alias(c) for c in LATEST),
    ]


def merge_cells(cells: DataFrame, *further: DataFrame) -> DataFrame:
    """Cells of several sets of events as those of all their events."""
    for more in further:
        cells = cells.unionByName(more)
    return cells.groupBy(*CELL).agg(*_added_up())


def address_activity(cells: DataFrame, honey_users: list[str] = HONEY_USERS) -> DataFrame:
    """One row per address: its counts and times, how many users and hosts, decoy contact."""
    n, total = F.col("total_events"), F.col("hour_sum").cast("double")
    variance = (F.col("hour_squares") - total * total / n) / (n - 1)
    # No two values of whole hours have a smaller variance than this; below it is rounding.
    variance = F.when((n > 1) & (variance * n > 0.5), variance).otherwise(0.0)
    found = cells.groupBy("ip_address").agg(
        *_added_up(),
        F.count_distinct("username").alias("unique_users"),
        F.count_distinct("host").alias("hosts_accessed"),
        F.count_distinct(F.when(F.col("failed_count") > 0, F.col("username"))).alias("failing_users"),
        F.sum(F.when(F.col("username").isNotNull(), F.col("failed_count"))).alias("failed_with_user"),
        F.max(F.col("username").isin(honey_users)).alias("honey_contact"),
    )
    return found.withColumns(
        {
            "hour_mean": total / n,
            "hour_std": F.sqrt(variance),
            "span_seconds": (micros("last_seen") - micros("first_seen")) / 1e6,
        }
    ).drop("hour_sum", "hour_squares")


@dataclass(frozen=True)
class Activity:
    """Stored cells and addresses, which operators take in place of reading events."""

    cells: DataFrame
    addresses: DataFrame


def activity_of(events: DataFrame, honey_users: list[str] = HONEY_USERS) -> Activity:
    """Aggregate the events once and store the result in the checkpoint folder."""
    return activity_from(activity_cells(events), honey_users)


def activity_from(cells: DataFrame, honey_users: list[str] = HONEY_USERS) -> Activity:
    """The same from cells, for instance those of several days merged."""
    cells = store(cells)
    return Activity(cells, store(address_activity(cells, honey_users)))


def activity_sketches(events: DataFrame) -> DataFrame:
    """One row per day and address with sketches of its users, failing users and hosts.

    A sketch is of bounded size however many users there are, and sketches of different days
    can be united: a new day is added without reading the old ones. Counts from them are
    estimates, within some two percent of the true ones; cells give exact ones.
    """
    failing = F.when(F.col("event") == FAILED, F.col("username"))
    return events.groupBy("ip_address", F.col("parsed_time").cast("date").alias("day")).agg(
        F.count("*").alias("total_events"),
        failed_count().alias("failed_count"),
        F.count(failing).alias("failed_with_user"),
        F.hll_sketch_agg("username").alias("users"),
        F.hll_sketch_agg(failing).alias("failing"),
        F.hll_sketch_agg("host").alias("hosts"),
    )


def sketched_addresses(sketches: DataFrame) -> DataFrame:
    """One row per address over all days of ``sketches``.

    Has the columns that ``credential_stuffing`` and ``multi_host_access`` take of addresses.
    """
    sums = ["total_events", "failed_count", "failed_with_user"]
    estimates = {"unique_users": "users", "failing_users": "failing", "hosts_accessed": "hosts"}
    return sketches.groupBy("ip_address").agg(
        *(F.sum(c).alias(c) for c in sums),
        *(F.hll_sketch_estimate(F.hll_union_agg(c)).alias(name) for name, c in estimates.items()),
    )


def addresses_of(events: DataFrame, activity: Activity | None, honey_users: list[str] = HONEY_USERS) -> DataFrame:
    """The addresses of ``activity``, or made from the events where there is none."""
    return address_activity(activity_cells(events), honey_users) if activity is None else activity.addresses
