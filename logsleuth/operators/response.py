"""Response decisions and narratives that follow from risk scores."""

from pyspark.sql import DataFrame, functions as F

# What is decided, for whom, and the texts of the reports.
BLOCK_SCORE = 40.0
BLOCK = ("IP_BLOCK", "WAF / Cloudflare", "SUCCESS")
LOCKOUT = ("ACCOUNT_LOCKOUT", "Active Directory", "ENFORCED")
LOCKED_USER = "compromised_user"
COMPROMISE_FACTOR = "Compromise Pattern"
NARRATIVE_SCORE = 15.0
RECOMMEND_ABOVE = 40
TITLE = "### [AGENT REPORT] Threat Analysis for %s\n\n"
VERDICT = "Our neural engine classifies this entity as **%s** (Confidence: %s%%).\n"
ESCALATED = (
    "- **Critical Alert**: The attacker successfully escalated privileges after initial access.\n"
)
ENTERED = "- **Warning**: Initial access was achieved. Monitoring for lateral movement.\n"
PROGRESS = (
    "- **Kill Chain Progress**: Entity has completed %.0f%% of a standard attack cycle.\n"
)
ACT = "\n**RECO: [AUTONOMOUS]** Pulsing block to firewall. Isolate affected subnets."
WATCH = "\n**RECO:** Continue passive observation. Flag for manual triage."

ACTION_COLUMNS = ["ip", "user", "action", "target", "status"]


def response_actions(scores: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """New actions: block each high-risk address, lock the compromised account once.

    ``history`` holds earlier actions, which are not repeated. Only the decision
    table is made; nothing is sent anywhere.
    """
    high = scores.filter(F.col("score") >= BLOCK_SCORE)
    blocks = high.select(
        F.col("ip_address").alias("ip"),
        F.lit(None).cast("string").alias("user"),
        *[F.lit(v).alias(c) for v, c in zip(BLOCK, ACTION_COLUMNS[2:])],
    )
    compromised = F.exists(
        "factors", lambda f: (f["factor"] == COMPROMISE_FACTOR) & (f["raw"] > 0)
    )
    lockouts = (
        high.filter(compromised)
        .select(F.lit(LOCKED_USER).alias("user"))
        .distinct()
        .select(
            F.lit(None).cast("string").alias("ip"),
            "user",
            *[F.lit(v).alias(c) for v, c in zip(LOCKOUT, ACTION_COLUMNS[2:])],
        )
    )
    if history is not None:
        blocks = blocks.join(
            history.filter(F.col("action") == BLOCK[0]).select("ip").distinct(), "ip", "left_anti"
        )
        lockouts = lockouts.join(
            history.filter(F.col("action") == LOCKOUT[0]).select("user").distinct(), "user", "left_anti"
        )
    return blocks.unionByName(lockouts).select(*ACTION_COLUMNS)


def ip_narrative(scores: DataFrame, summary: DataFrame) -> DataFrame:
    """Text summary of each address that scored enough, highest score first."""
    phases = F.coalesce(F.col("phases_reached"), F.array().cast("array<string>"))
    percent = F.rint(F.coalesce(F.col("kill_chain_progress"), F.lit(0.0)) * 100)
    text = F.concat(
        F.format_string(TITLE, "ip_address"),
        F.format_string(VERDICT, "level", F.col("score").cast("string")),
        F.when(F.array_contains(phases, "PRIVILEGE_ESCALATION"), ESCALATED)
        .when(F.array_contains(phases, "INITIAL_ACCESS"), ENTERED)
        .otherwise(""),
        F.format_string(PROGRESS, percent),
        F.when(F.col("score") > RECOMMEND_ABOVE, ACT).otherwise(WATCH),
    )
    return (
        scores.filter(F.col("score") >= NARRATIVE_SCORE)
        .join(summary.select("ip_address", "phases_reached", "kill_chain_progress"), "ip_address", "left")
        .select("ip_address", "score", "level", text.alias("narrative"))
        .orderBy(F.desc("score"), "ip_address")
    )
