"""The registered queries as SQL over the given tables, for an independent engine.

Fixed tables of values are taken from the library; everything computed is not.
"""

import math

from logsleuth.operators import behaviour, chains, enrich

# Authentication events from the ``events`` table, by the rules of the adapter.
EV = """
base AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
), keyed AS (
  SELECT event_id, ts, k,
    CASE event_type WHEN 'error' THEN 'FAILED_LOGIN' WHEN 'view' THEN 'SUCCESSFUL_LOGIN'
      WHEN 'signup' THEN 'INVALID_USER' WHEN 'click' THEN CASE WHEN k % 10 = 9 THEN 'OTHER' ELSE 'DISCONNECT' END
      ELSE CASE WHEN k % 2 = 0 THEN 'SUDO_ATTEMPT' ELSE 'ROOT_ACCESS' END END AS event,
    CASE WHEN k >= 96 THEN 'Internal' WHEN k = 95 THEN '127.0.0.1'
      WHEN k = 94 THEN '10.' || (user_id // 250) || '.' || (user_id % 250) || '.1' WHEN k = 7 THEN '198.51.100.7'
      WHEN k < 20 THEN '198.51.' || (user_id // 40) || '.' || k
      ELSE '203.' || (user_id // 250) || '.' || (user_id % 250) || '.' || (k // 32) END AS ip_address,
    CASE WHEN event_id % 997 = 0 THEN 'admin_backup' WHEN event_type = 'click' THEN 'unknown'
      ELSE 'user' || user_id END AS username,
    'host' || (k % 4) AS host,
    CAST(1000 + event_id % 9000 AS VARCHAR) AS pid, CAST(40000 + k AS VARCHAR) AS port
  FROM base
), ev AS (
  SELECT 'events' AS source_file, event_id AS line_number,
    strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S') AS timestamp_str,
    ts AS parsed_time, event, ip_address, username, 'sshd' AS process, host,
    pid || ']: ' || CASE event
      WHEN 'FAILED_LOGIN' THEN 'Failed password for ' || username || ' from ' || ip_address || ' port ' || port || ' ssh2'
      WHEN 'SUCCESSFUL_LOGIN' THEN 'Accepted password for ' || username || ' from ' || ip_address || ' port ' || port || ' ssh2'
      WHEN 'INVALID_USER' THEN 'Invalid user ' || username || ' from ' || ip_address || ' port ' || port
      WHEN 'DISCONNECT' THEN 'Disconnected from ' || ip_address || ' port ' || port
      WHEN 'OTHER' THEN 'Received signal 15 while serving ' || ip_address
      WHEN 'SUDO_ATTEMPT' THEN 'sudo: ' || username || ' : TTY=pts/0 ; PWD=/home/' || username || ' ; USER=root ; COMMAND=/bin/bash'
      ELSE 'pam_unix(sshd:session): session opened for user root by ' || username END AS message
  FROM keyed
)"""


def rnd(expression, digits):
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(round_even(({expression}) * {scale}, 0) / {scale})"


def chunk_mod(digest, length, modulus):
    """Hex digest modulo a small number, folded 32 bits at a time."""
    carry = (1 << 32) % modulus
    rest = "0"
    for start in range(1, length + 1, 8):
        rest = f"(({rest} * {carry} + CAST('0x' || substr({digest}, {start}, 8) AS BIGINT)) % {modulus})"
    return rest


def erf_cdf(z):
    a = f"abs({z} / 1.4142135623730951)"
    t = f"(1.0 / (1.0 + 0.3275911 * {a}))"
    poly = (
        f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * "
        f"(-1.453152027 + {t} * 1.061405429))))"
    )
    return f"(0.5 * (1.0 + sign({z}) * (1.0 - ({poly}) * exp(-({a}) * ({a})))))"


NIGHT = "(event = 'SUCCESSFUL_LOGIN' AND hour(parsed_time) < 5)"

BASELINE = """
fails AS (
  SELECT ip_address, count(*) AS failed_count FROM ev WHERE event = 'FAILED_LOGIN' GROUP BY 1
), raw_stats AS (
  SELECT avg(failed_count) AS m, stddev_samp(failed_count) AS s FROM fails
), baseline AS (
  SELECT coalesce(m, 3.0)::DOUBLE AS mean,
    (CASE WHEN m IS NULL THEN 1.5 ELSE greatest(coalesce(s, 1.0), 1.0) END)::DOUBLE AS sigma,
    greatest(coalesce(m, 3.0) + 2.5 * (CASE WHEN m IS NULL THEN 1.5 ELSE greatest(coalesce(s, 1.0), 1.0) END), 3.0)::DOUBLE AS threshold
  FROM raw_stats
)"""

def values(rows):
    def text(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


PLACE_ROWS = values([(i, *p) for i, p in enumerate(enrich.PLACES)])
RISK_ROWS = values(list(enrich.COUNTRY_RISK.items()))
NETWORK_ROWS = values(list(enumerate(enrich.NETWORKS)))
DESCRIPTION_ROWS = values([(event, row[3]) for event, row in enrich.TECHNIQUES.items()])
TECHNIQUE_ROWS = values([(event, *row[:3]) for event, row in enrich.TECHNIQUES.items()])
PHASE_ROWS = values([(p, i) for i, p in enumerate(chains.PHASE_ORDER)])
SUCCESSOR_ROWS = values([(p, t) for p, ts in chains.SUCCESSORS.items() for t in ts])

INTEL = f"""
places(place, country, city, lat, lon) AS (VALUES {PLACE_ROWS}),
risks(country, risk) AS (VALUES {RISK_ROWS}),
networks(network, asn_name) AS (VALUES {NETWORK_ROWS}),
techniques(event, technique, technique_name, tactic) AS (VALUES {TECHNIQUE_ROWS}),
ips AS (
  SELECT ip_address, count(*) AS total_events,
    count(*) FILTER (event = 'FAILED_LOGIN') AS failed_count FROM ev GROUP BY 1
), located AS (
  SELECT i.*,
    (ip_address = 'Internal' OR starts_with(ip_address, '127.') OR starts_with(ip_address, '10.')) AS is_local,
    {chunk_mod('md5(ip_address)', 32, 15)} AS place,
    {chunk_mod('sha256(ip_address)', 64, 100)} / 100.0::DOUBLE AS base_rep,
    {chunk_mod('sha1(ip_address)', 40, 10)} AS network
  FROM ips i
), geo AS (
  SELECT l.*, CASE WHEN is_local THEN 'Local' ELSE p.country END AS geo_country,
    CASE WHEN is_local THEN 'Internal' ELSE p.city END AS geo_city,
    CASE WHEN is_local THEN 0.0::DOUBLE ELSE p.lat END AS geo_lat,
    CASE WHEN is_local THEN 0.0::DOUBLE ELSE p.lon END AS geo_lon
  FROM located l JOIN places p USING (place)
), intel AS (
  SELECT g.ip_address, g.total_events, g.failed_count, g.geo_country, g.geo_city, g.geo_lat, g.geo_lon,
    coalesce(r.risk, 0.3::DOUBLE) AS geo_risk,
    CASE WHEN g.ip_address = 'Internal' THEN 0.95::DOUBLE ELSE {rnd("greatest(0.0::DOUBLE, least(1.0::DOUBLE, g.base_rep - least(g.failed_count * 0.05::DOUBLE, 0.4::DOUBLE) - coalesce(r.risk, 0.3::DOUBLE) * 0.3::DOUBLE))", 3)} END AS ip_reputation,
    CASE WHEN g.ip_address = 'Internal' THEN 'AS0 — Internal' ELSE n.asn_name END AS asn
  FROM geo g LEFT JOIN risks r ON r.country = g.geo_country JOIN networks n USING (network)
)"""

ENRICHED = """
enriched AS (
  SELECT ev.*, i.total_events, geo_country, geo_city, geo_lat, geo_lon, geo_risk, ip_reputation, asn,
    t.technique || ' — ' || t.technique_name AS mitre_technique, t.tactic AS mitre_tactic
  FROM ev JOIN intel i USING (ip_address)
  JOIN techniques t ON t.event = CASE WHEN ev.event IN (SELECT event FROM techniques) THEN ev.event ELSE 'OTHER' END
)"""

FEATURES = f"""
gaps AS (
  SELECT ip_address, (epoch_us(parsed_time) - lag(epoch_us(parsed_time)) OVER (
    PARTITION BY ip_address ORDER BY parsed_time, line_number)) / 1e6 AS gap FROM ev
), gap_stats AS (
  SELECT ip_address, avg(gap) AS iet_mean, stddev_samp(gap) AS iet_std, min(gap) AS iet_min FROM gaps GROUP BY 1
), activity AS (
  SELECT ip_address, count(*) AS total, count(*) FILTER (event = 'SUCCESSFUL_LOGIN') AS success_count,
    avg(hour(parsed_time)) AS hour_mean, stddev_samp(hour(parsed_time)) AS hour_std,
    count(DISTINCT username) AS unique_users, count(*) FILTER {NIGHT.join(['(', ')'])} AS night_logins,
    min(parsed_time) AS first_seen, max(parsed_time) AS last_seen,
    (epoch_us(max(parsed_time)) - epoch_us(min(parsed_time))) / 1e6 AS span_seconds,
    bool_or(username IN ('admin_backup', 'db_service_acct', 'svc_forensics')) AS honey
  FROM ev GROUP BY 1
), feat AS (
  SELECT a.ip_address, i.failed_count, a.success_count, a.total AS total_events, a.hour_mean,
    coalesce(a.hour_std, 0.0) AS hour_std, a.unique_users, coalesce(g.iet_mean, 0.0) AS iet_mean,
    coalesce(g.iet_std, 0.0) AS iet_std, coalesce(g.iet_min, 0.0) AS iet_min, a.night_logins,
    i.ip_reputation, i.geo_risk, i.failed_count / a.total::DOUBLE AS fail_ratio
  FROM activity a JOIN intel i USING (ip_address) JOIN gap_stats g USING (ip_address)
)"""

HEURISTIC = f"""
anomaly AS (
  SELECT ip_address,
    CASE WHEN (SELECT count(*) FROM feat) < 3 THEN 0.5::DOUBLE ELSE {rnd("least(1.0::DOUBLE, failed_count * 0.1::DOUBLE + night_logins * 0.2::DOUBLE + geo_risk * 0.3::DOUBLE + (1 - ip_reputation) * 0.2::DOUBLE)", 4)} END AS anomaly_score
  FROM feat
), flagged AS (
  SELECT ip_address, anomaly_score, (SELECT count(*) FROM feat) >= 3 AND anomaly_score > 0.6::DOUBLE AS is_anomaly FROM anomaly
)"""

SCORES = f"""
points AS (
  SELECT a.ip_address, i.geo_country, a.honey, i.failed_count, a.success_count, a.night_logins, a.unique_users, a.total,
    n.anomaly_score, i.ip_reputation, i.geo_risk,
    CASE WHEN a.total > 1 THEN a.total / greatest(a.span_seconds / 3600.0::DOUBLE, 0.01::DOUBLE) ELSE 0.0::DOUBLE END AS velocity
  FROM activity a JOIN intel i USING (ip_address) JOIN anomaly n USING (ip_address)
), factors AS (
  SELECT *, {rnd("log2(1 + failed_count) * 5", 2)} AS f1,
    CASE WHEN failed_count >= 3 AND success_count > 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS f2,
    {rnd("night_logins::DOUBLE / greatest(success_count, 1) * 8", 2)} AS f3,
    {rnd("anomaly_score * 15", 2)} AS f4, {rnd("(1 - ip_reputation) * 10", 2)} AS f5,
    {rnd("geo_risk * 5", 2)} AS f6, {rnd("unique_users::DOUBLE / total * 20", 2)} AS f7,
    {rnd("least(velocity * 2, 10.0::DOUBLE)", 2)} AS f8
  FROM points
), scored AS (
  SELECT *, CASE WHEN honey THEN 100.0::DOUBLE ELSE {rnd("0.0::DOUBLE + f1 + f2 + f3 + f4 + f5 + f6 + f7 + f8", 2)} END AS score
  FROM factors
), scores AS (
  SELECT *, CASE WHEN score >= 40 THEN 'CRITICAL' WHEN score >= 25 THEN 'HIGH' WHEN score >= 12 THEN 'MEDIUM' ELSE 'LOW' END AS level
  FROM scored
), factor_rows AS (
  SELECT ip_address, 1 AS position, 'Failed Logins (log₂)' AS factor, f1 AS raw, format('{{}} failed → log₂({{}})×5', failed_count, failed_count + 1) AS description FROM scores WHERE NOT honey
  UNION ALL SELECT ip_address, 2, 'Compromise Pattern', f2, CASE WHEN f2 > 0 THEN 'Yes' ELSE 'No' END || ' (fail≥3 + success>0)' FROM scores WHERE NOT honey
  UNION ALL SELECT ip_address, 3, 'Night Login Fraction', f3, format('{{}}/{{}} night/success × 8', night_logins, greatest(success_count, 1)) FROM scores WHERE NOT honey
  UNION ALL SELECT ip_address, 4, 'AI Anomaly Score', f4, 'Isolation Forest: ' || printf('%.3f', anomaly_score) || ' × 15' FROM scores WHERE NOT honey
  UNION ALL SELECT ip_address, 5, 'IP Reputation Penalty', f5, '(1 - ' || printf('%.3f', ip_reputation) || ') × 10' FROM scores WHERE NOT honey
  UNION ALL SELECT ip_address, 6, 'Geo Risk', f6, 'Country risk: ' || printf('%.2f', geo_risk) || ' × 5' FROM scores WHERE NOT honey
  UNION ALL SELECT ip_address, 7, 'User Spray', f7, format('{{}} users / {{}} events × 20', unique_users, total) FROM scores WHERE NOT honey
  UNION ALL SELECT ip_address, 8, 'Login Velocity', f8, printf('%.1f', velocity) || ' events/hr (capped at 10)' FROM scores WHERE NOT honey
  UNION ALL SELECT ip_address, 1, 'DECEPTION TRIGGER', 100.0::DOUBLE, 'Interacted with Honey-Token (Zero False Positive)' FROM scores WHERE honey
)"""

EVENT_COLUMNS = (
    "source_file, line_number, timestamp_str, parsed_time, event, ip_address, username, process, host, message"
)


def query(select, *ctes):
    return "WITH RECURSIVE " + ",".join(ctes) + "\n" + select


def with_ev(select, *more):
    return query(select, EV, *more)


def with_scores(select, *more):
    return query(select, EV, INTEL, FEATURES, HEURISTIC, SCORES, *more)


ORACLE = {}

# Detection.
ORACLE["adaptive_threshold"] = with_ev(
    f"SELECT {rnd('mean', 6)} AS mean, {rnd('sigma', 6)} AS sigma, {rnd('threshold', 6)} AS threshold FROM baseline", BASELINE
)
ORACLE["bruteforce"] = with_ev(
    f"""SELECT ip_address, failed_count, {rnd('threshold', 1)} AS threshold,
    failed_count >= threshold AS is_bruteforce,
    {rnd(f"least({erf_cdf('((failed_count - mean) / sigma)')}, 0.999::DOUBLE)", 3)} AS confidence
    FROM fails, baseline""",
    BASELINE,
)
ORACLE["night_logins"] = with_ev(f"SELECT {EVENT_COLUMNS} FROM ev WHERE {NIGHT}")
ORACLE["credential_stuffing"] = with_ev(
    f"""SELECT *, spray_ratio > 0.5 AND unique_users > 2 AS is_stuffing FROM (
      SELECT ip_address, count(DISTINCT username) AS unique_users, count(username) AS total_attempts,
      {rnd('count(DISTINCT username)::DOUBLE / count(username)', 3)} AS spray_ratio
      FROM ev WHERE event = 'FAILED_LOGIN' GROUP BY 1)"""
)
ORACLE["compromise_pattern"] = with_ev(
    """SELECT c.*, 'FAILED → SUCCESS (Compromise Likely)' AS pattern FROM (
      SELECT ip_address, count(*) FILTER (event = 'FAILED_LOGIN') AS failed_count,
        count(*) FILTER (event = 'SUCCESSFUL_LOGIN') AS success_count,
        min(parsed_time) FILTER (event = 'FAILED_LOGIN') AS first_fail,
        max(parsed_time) FILTER (event = 'SUCCESSFUL_LOGIN') AS last_success
      FROM ev GROUP BY 1) c, baseline
    WHERE failed_count >= threshold AND success_count > 0 AND first_fail < last_success""",
    BASELINE,
)
ORACLE["multi_host_access"] = with_ev(
    """SELECT ip_address, count(DISTINCT host) AS hosts_accessed, count(*) AS total_events
    FROM ev GROUP BY 1 HAVING count(DISTINCT host) > 1"""
)
ORACLE["bruteforce_fixed"] = with_ev(
    """SELECT ip_address, count(*) AS failed_count FROM ev WHERE event = 'FAILED_LOGIN'
    GROUP BY 1 HAVING count(*) >= 3"""
)
ORACLE["compromise_fixed"] = with_ev(
    """SELECT * FROM (SELECT ip_address, count(*) FILTER (event = 'FAILED_LOGIN') AS failed_count,
      count(*) FILTER (event = 'SUCCESSFUL_LOGIN') AS success_count, count(*) AS total_events
      FROM ev GROUP BY 1) WHERE failed_count >= 3 AND success_count > 0"""
)
ORACLE["severity_simple"] = with_ev(
    f"""SELECT *, CASE WHEN score >= 15 THEN 'CRITICAL' WHEN score >= 8 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS level
    FROM (SELECT *, failed_count * 2 + success_count * 3 + night_logins * 5 AS score FROM (
      SELECT ip_address, count(*) FILTER (event = 'FAILED_LOGIN') AS failed_count,
      count(*) FILTER (event = 'SUCCESSFUL_LOGIN') AS success_count,
      count(*) FILTER {NIGHT.join(['(', ')'])} AS night_logins FROM ev GROUP BY 1))"""
)

# Enrichment.
ORACLE["ip_geo"] = with_ev("SELECT ip_address, geo_country, geo_city, geo_lat, geo_lon FROM intel", INTEL)
ORACLE["country_risk"] = with_ev("SELECT ip_address, geo_country, geo_risk FROM intel", INTEL)
ORACLE["ip_reputation"] = with_ev("SELECT ip_address, failed_count, ip_reputation FROM intel", INTEL)
ORACLE["ip_asn"] = with_ev("SELECT ip_address, asn FROM intel", INTEL)
ORACLE["mitre_map"] = with_ev(
    """SELECT line_number, enriched.event, mitre_technique, mitre_tactic, mitre_description FROM enriched
    JOIN descriptions d ON d.event = CASE WHEN enriched.event IN (SELECT event FROM descriptions) THEN enriched.event ELSE 'OTHER' END""",
    INTEL, ENRICHED, f"descriptions(event, mitre_description) AS (VALUES {DESCRIPTION_ROWS})",
)
ORACLE["enrich_events"] = with_ev(
    f"SELECT {EVENT_COLUMNS}, geo_country, geo_city, geo_lat, geo_lon, geo_risk, ip_reputation, asn, mitre_technique, mitre_tactic FROM enriched",
    INTEL, ENRICHED,
)

# Features and models.
ORACLE["ip_features"] = with_ev(
    f"""SELECT ip_address, failed_count, success_count, total_events, {rnd('hour_mean', 6)} AS hour_mean,
    {rnd('hour_std', 6)} AS hour_std, unique_users, {rnd('iet_mean', 2)} AS iet_mean, {rnd('iet_std', 2)} AS iet_std,
    {rnd('iet_min', 6)} AS iet_min, night_logins, ip_reputation, geo_risk, {rnd('fail_ratio', 6)} AS fail_ratio FROM feat""",
    INTEL, FEATURES,
)
ORACLE["iforest_contamination"] = with_ev(
    """SELECT count(DISTINCT ip_address) AS n_samples, CASE WHEN count(DISTINCT ip_address) < 5 THEN 0.2::DOUBLE
    WHEN count(DISTINCT ip_address) < 20 THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END AS contamination FROM ev"""
)
ORACLE["heuristic_anomaly"] = with_ev("SELECT * FROM flagged", INTEL, FEATURES, HEURISTIC)
ORACLE["anomaly_ranking"] = with_ev(
    "SELECT *, CASE WHEN is_anomaly THEN 'ANOMALY' ELSE 'normal' END AS status FROM flagged", INTEL, FEATURES, HEURISTIC
)

FEATURE_NAMES = (
    "failed_count success_count total_events hour_mean hour_std unique_users iet_mean iet_std iet_min "
    "night_logins ip_reputation geo_risk fail_ratio"
).split()
SCALED = "scaled AS (SELECT ip_address, " + ", ".join(
    f"({c} - (SELECT avg({c}) FROM feat)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM feat) AS {c}"
    for c in FEATURE_NAMES
) + " FROM feat)"
VARYING = " + ".join(f"CASE WHEN min({c}) < max({c}) THEN 1 ELSE 0 END" for c in FEATURE_NAMES)
PARAMS = f"""
params AS (
  SELECT count(*) AS n, CASE WHEN count(*) < 2 THEN 1.0::DOUBLE
    ELSE greatest(0.5::DOUBLE, ({VARYING}) / {len(FEATURE_NAMES)}.0::DOUBLE * 0.8::DOUBLE) END AS eps,
    CASE WHEN count(*) < 2 THEN 1 WHEN count(*) < 50 THEN 2 ELSE 5 END AS min_samples
  FROM feat
)"""
DISTANCE = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in FEATURE_NAMES)
CAMPAIGNS = f"""
near AS (
  SELECT a.ip_address AS a, b.ip_address AS b FROM scaled a, scaled b, params
  WHERE sqrt({DISTANCE}) <= eps
), core AS (
  SELECT a AS ip FROM near, params GROUP BY a, min_samples HAVING count(*) >= min_samples
), core_links AS (
  SELECT a, b FROM near WHERE a IN (SELECT ip FROM core) AND b IN (SELECT ip FROM core)
), seen AS (
  SELECT ip_address AS ip, row_number() OVER (ORDER BY min(parsed_time), min(line_number)) AS pos FROM ev GROUP BY 1
), reach AS (
  SELECT c.ip, s.pos AS root FROM core c JOIN seen s USING (ip)
  UNION
  SELECT l.b, r.root FROM reach r JOIN core_links l ON l.a = r.ip JOIN seen s ON s.ip = l.b WHERE r.root < s.pos
), component AS (
  SELECT ip, min(root) AS root FROM reach GROUP BY 1
), numbered AS (
  SELECT ip, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM component
), border AS (
  SELECT n.a AS ip, min(m.cluster) AS cluster FROM near n JOIN numbered m ON m.ip = n.b
  WHERE n.a NOT IN (SELECT ip FROM core) GROUP BY 1
), campaigns AS (
  SELECT f.ip_address, CAST(coalesce(m.cluster, b.cluster, -1) AS BIGINT) AS campaign_cluster,
    CASE WHEN coalesce(m.cluster, b.cluster, -1) < 0 THEN 'Lone Actor' ELSE 'Campaign #' || coalesce(m.cluster, b.cluster) END AS cluster_label
  FROM feat f LEFT JOIN numbered m ON m.ip = f.ip_address LEFT JOIN border b ON b.ip = f.ip_address
)"""
ORACLE["scaled_features"] = with_ev(
    "SELECT ip_address, " + ", ".join(f"{rnd(c, 5)} AS {c}" for c in FEATURE_NAMES) + " FROM scaled",
    INTEL, FEATURES, SCALED,
)
ORACLE["dbscan_params"] = with_ev(
    f"SELECT n, {rnd('eps', 6)} AS eps, min_samples FROM params", INTEL, FEATURES, PARAMS
)
ORACLE["ip_campaigns"] = with_ev("SELECT * FROM campaigns", INTEL, FEATURES, SCALED, PARAMS, CAMPAIGNS)
WIDE = "params AS (SELECT 1.3::DOUBLE AS eps, 5 AS min_samples)"
ORACLE["ip_campaigns_wide"] = with_ev("SELECT * FROM campaigns", INTEL, FEATURES, SCALED, WIDE, CAMPAIGNS)
ORACLE["campaign_members"] = with_ev(
    """SELECT campaign_cluster, cluster_label, count(*) OVER (PARTITION BY campaign_cluster) AS members, ip_address
    FROM campaigns WHERE campaign_cluster >= 0""",
    INTEL, FEATURES, SCALED, WIDE, CAMPAIGNS,
)

# Scoring.
ORACLE["risk_factors"] = with_scores(
    "SELECT ip_address, position, factor, raw, raw AS weighted, description FROM factor_rows"
)
ORACLE["risk_scores"] = with_scores("SELECT ip_address, geo_country, score, level FROM scores")
ORACLE["severity_level"] = with_scores("SELECT ip_address, level FROM scores")
ORACLE["severity_summary"] = with_scores(
    """SELECT l.level, count(s.ip_address) AS ips FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) l(level)
    LEFT JOIN scores s USING (level) GROUP BY 1"""
)
ORACLE["severity_ranking"] = with_scores(
    "SELECT row_number() OVER (ORDER BY score DESC, ip_address) AS severity_rank, ip_address, score, level FROM scores"
)
ORACLE["top_factor"] = with_scores(
    """SELECT ip_address, score, level, geo_country, factor AS top_factor FROM scores JOIN (
      SELECT ip_address, factor, row_number() OVER (PARTITION BY ip_address ORDER BY raw DESC, position) AS rn FROM factor_rows
    ) USING (ip_address) WHERE rn = 1"""
)
ORACLE["top_factor_breakdown"] = with_scores(
    """SELECT f.ip_address, position, factor, raw, raw AS weighted, description, score, level FROM factor_rows f JOIN (
      SELECT ip_address, score, level FROM scores ORDER BY score DESC, ip_address LIMIT 5) USING (ip_address)"""
)
ORACLE["kpi_counts"] = with_scores(
    """SELECT count(*) AS total, count(*) FILTER (event = 'FAILED_LOGIN') AS failed,
    count(*) FILTER (event = 'SUCCESSFUL_LOGIN') AS success, count(DISTINCT ip_address) AS all_ips,
    count(DISTINCT ip_address) FILTER (ip_address <> 'Internal') AS unique_ips,
    (SELECT count(*) FROM scores WHERE level = 'CRITICAL') AS critical_ips,
    (SELECT count(*) FROM scores WHERE level = 'HIGH') AS high_risk_ips FROM ev"""
)
ACTIONS = """
history AS (
  SELECT ip_address AS ip FROM ev WHERE event = 'FAILED_LOGIN' GROUP BY 1 HAVING count(*) >= 15
), actions AS (
  SELECT ip_address AS ip, NULL::VARCHAR AS user, 'IP_BLOCK' AS action, 'WAF / Cloudflare' AS target, 'SUCCESS' AS status
  FROM scores WHERE score >= 40 AND ip_address NOT IN (SELECT ip FROM history)
  UNION ALL
  SELECT NULL, 'compromised_user', 'ACCOUNT_LOCKOUT', 'Active Directory', 'ENFORCED'
  WHERE EXISTS (SELECT 1 FROM scores WHERE score >= 40 AND NOT honey AND f2 > 0)
)"""
ORACLE["response_actions"] = with_scores("SELECT * FROM actions", ACTIONS)
ORACLE["action_log"] = with_scores(
    """SELECT ip_address AS ip, NULL::VARCHAR AS user, 'IP_BLOCK' AS action, 'WAF / Cloudflare' AS target, 'SUCCESS' AS status
    FROM scores WHERE score >= 40 UNION ALL
    SELECT NULL, 'compromised_user', 'ACCOUNT_LOCKOUT', 'Active Directory', 'ENFORCED'
    WHERE EXISTS (SELECT 1 FROM scores WHERE score >= 40 AND NOT honey AND f2 > 0)"""
)
ORACLE["export_scored_csv"] = with_scores(
    f"""SELECT {EVENT_COLUMNS.replace('parsed_time', "strftime(parsed_time, '%Y-%m-%d %H:%M:%S.%f') AS parsed_time")},
    coalesce(score, 0.0::DOUBLE) AS risk_score, coalesce(level, 'LOW') AS severity_level
    FROM ev LEFT JOIN scores s USING (ip_address)"""
)

# Forensics.
PHASED = f"""
ordering(phase, ord) AS (VALUES {PHASE_ROWS}),
allowed(src_phase, dst_phase) AS (VALUES {SUCCESSOR_ROWS}),
nodes AS (
  SELECT ip_address, row_number() OVER (PARTITION BY ip_address ORDER BY parsed_time, line_number) - 1 AS id,
    CASE WHEN {NIGHT} THEN 'PERSISTENCE' WHEN event IN ('FAILED_LOGIN', 'INVALID_USER') THEN 'RECONNAISSANCE'
      WHEN event = 'SUCCESSFUL_LOGIN' THEN 'INITIAL_ACCESS' WHEN event IN ('ROOT_ACCESS', 'SUDO_ATTEMPT') THEN 'PRIVILEGE_ESCALATION'
      WHEN event = 'DISCONNECT' THEN 'DEFENSE_EVASION' ELSE 'EXECUTION' END AS phase,
    event, parsed_time AS time, substr(message, 1, 80) AS details, username FROM ev
), summary AS (
  SELECT ip_address, count(*) AS node_count, string_agg(DISTINCT phase, ',') AS any_order,
    {rnd('max(ord) / 6.0::DOUBLE', 3)} AS kill_chain_progress FROM nodes JOIN ordering USING (phase) GROUP BY 1
), phases AS (
  SELECT ip_address, string_agg(phase, ' → ' ORDER BY ord) AS phases_reached
  FROM (SELECT DISTINCT ip_address, phase, ord FROM nodes JOIN ordering USING (phase)) GROUP BY 1
)"""
SUMMARY_COLUMNS = "s.ip_address, s.node_count, p.phases_reached, s.kill_chain_progress"
ORACLE["chain_nodes"] = with_ev("SELECT * FROM nodes", PHASED)
ORACLE["chain_edges"] = with_ev(
    """SELECT a.ip_address, a.id AS src, min(b.id) AS dst FROM nodes a JOIN allowed ON a.phase = src_phase
    JOIN nodes b ON b.ip_address = a.ip_address AND b.phase = dst_phase AND b.id > a.id GROUP BY 1, 2""",
    PHASED,
)
ORACLE["chain_summary"] = with_ev(
    f"SELECT {SUMMARY_COLUMNS} FROM summary s JOIN phases p USING (ip_address)", PHASED
)
ORACLE["attack_chains"] = with_scores(
    f"""SELECT {SUMMARY_COLUMNS}, (SELECT count(DISTINCT (a.id)) FROM nodes a JOIN allowed ON a.phase = src_phase
      JOIN nodes b ON b.ip_address = a.ip_address AND b.phase = dst_phase AND b.id > a.id WHERE a.ip_address = s.ip_address) AS edge_count
    FROM summary s JOIN phases p USING (ip_address) JOIN scores c USING (ip_address) WHERE c.level IN ('HIGH', 'CRITICAL')""",
    PHASED,
)
SESSIONS = """
starts AS (
  SELECT *, CASE WHEN lag(parsed_time) OVER w IS NULL OR epoch_us(parsed_time) - epoch_us(lag(parsed_time) OVER w) > 1800000000 THEN 1 ELSE 0 END AS is_new
  FROM ev WINDOW w AS (PARTITION BY ip_address ORDER BY parsed_time, line_number)
), ordinals AS (
  SELECT *, sum(is_new) OVER (PARTITION BY ip_address ORDER BY parsed_time, line_number ROWS UNBOUNDED PRECEDING) AS ordinal FROM starts
), session_numbers AS (
  SELECT ip_address, ordinal, row_number() OVER (ORDER BY min(parsed_time), min(line_number)) AS n FROM ordinals GROUP BY 1, 2
), linked AS (
  SELECT o.*, printf('S-%04d', n) AS session_id FROM ordinals o JOIN session_numbers USING (ip_address, ordinal)
)"""
ORACLE["link_sessions"] = with_ev(f"SELECT {EVENT_COLUMNS}, session_id FROM linked", SESSIONS)
ORACLE["timeline"] = with_ev(
    """SELECT row_number() OVER w - 1 AS position, source_file, line_number, parsed_time, ip_address, username, event, session_id,
    coalesce(lag(session_id) OVER w <> session_id, false) AS session_changed FROM linked WINDOW w AS (ORDER BY parsed_time, line_number)""",
    SESSIONS,
)
ENTROPY = """
ordered AS (SELECT row_number() OVER (ORDER BY parsed_time, line_number) - 1 AS i, epoch_us(parsed_time) AS t FROM ev),
deltas AS (SELECT i, (lead(t) OVER (ORDER BY i) - t) / 1e6 AS delta FROM ordered),
total AS (SELECT count(*) AS n FROM ev),
windowed AS (
  SELECT w.s AS s, d.delta FROM (SELECT unnest(range(0, (SELECT greatest(n - 51, 0) FROM total), 10)) AS s) w
  JOIN deltas d ON d.i >= w.s AND d.i < w.s + 50 WHERE (SELECT n >= 100 FROM total)
), bounds AS (
  SELECT s, CASE WHEN min(delta) = max(delta) THEN min(delta) - 0.5 ELSE min(delta) END AS lo,
    CASE WHEN min(delta) = max(delta) THEN max(delta) + 0.5 ELSE max(delta) END AS hi FROM windowed GROUP BY 1
), guessed AS (
  SELECT s, delta, lo, (hi - lo) / 20 AS width, least(floor((delta - lo) / (hi - lo) * 20), 19) AS g FROM windowed JOIN bounds USING (s)
), binned AS (
  SELECT s, CASE WHEN delta < g * width + lo THEN g - 1 WHEN g < 19 AND delta >= (g + 1) * width + lo THEN g + 1 ELSE g END AS bin, count(*) AS c
  FROM guessed GROUP BY 1, 2
), entropies AS (
  SELECT s + 25 AS center, -sum(c / 50.0::DOUBLE * log2(c / 50.0::DOUBLE + 1e-12::DOUBLE)) AS entropy FROM binned GROUP BY 1
)"""
ORACLE["entropy_series"] = with_ev(f"SELECT center, {rnd('entropy', 4)} + 0.0 AS entropy FROM entropies", ENTROPY)
ORACLE["tamper_regions"] = with_ev(
    f"""SELECT greatest(center - 25, 0) AS start_idx, least(center + 25, (SELECT n FROM total)) AS end_idx,
    {rnd('entropy', 4)} AS entropy, {rnd('abs(entropy - m) / s', 2)} AS z_score, {rnd('m', 4)} AS baseline_entropy
    FROM entropies, (SELECT avg(entropy) AS m, stddev_pop(entropy) AS s FROM entropies) WHERE s > 0 AND abs(entropy - m) / s > 2.0""",
    ENTROPY,
)
ORACLE["tamper_summary"] = with_ev(
    f"""SELECT count(*) FILTER (s > 0 AND abs(entropy - m) / s > 2.0) > 0 AS tampered,
    count(*) FILTER (s > 0 AND abs(entropy - m) / s > 2.0) AS regions, {rnd('coalesce(avg(entropy), 0.0)', 4)} AS baseline_entropy
    FROM entropies, (SELECT avg(entropy) AS m, stddev_pop(entropy) AS s FROM entropies)""",
    ENTROPY,
)
ORACLE["pivot_points"] = with_ev(
    """SELECT node AS ip, neighbour AS host_involved, hosts_count, 'HIGH' AS risk FROM (
      SELECT *, count(*) OVER (PARTITION BY node) AS hosts_count FROM (
        SELECT ip_address AS node, host AS neighbour FROM ev WHERE event = 'SUCCESSFUL_LOGIN'
        UNION SELECT host, ip_address FROM ev WHERE event = 'SUCCESSFUL_LOGIN') WHERE contains(node, '.')
    ) WHERE hosts_count > 1"""
)
ORACLE["ip_narrative"] = with_scores(
    """SELECT c.ip_address, c.score, c.level,
    '### [AGENT REPORT] Threat Analysis for ' || c.ip_address || chr(10) || chr(10)
    || 'Our neural engine classifies this entity as **' || c.level || '** (Confidence: ' || CAST(c.score AS VARCHAR) || '%).' || chr(10)
    || CASE WHEN p.phases_reached LIKE '%PRIVILEGE_ESCALATION%' THEN '- **Critical Alert**: The attacker successfully escalated privileges after initial access.' || chr(10)
       WHEN p.phases_reached LIKE '%INITIAL_ACCESS%' THEN '- **Warning**: Initial access was achieved. Monitoring for lateral movement.' || chr(10) ELSE '' END
    || '- **Kill Chain Progress**: Entity has completed ' || printf('%.0f', round_even(coalesce(s.kill_chain_progress, 0.0) * 100, 0)) || '% of a standard attack cycle.' || chr(10)
    || CASE WHEN c.score > 40 THEN chr(10) || '**RECO: [AUTONOMOUS]** Pulsing block to firewall. Isolate affected subnets.'
       ELSE chr(10) || '**RECO:** Continue passive observation. Flag for manual triage.' END AS narrative
    FROM scores c LEFT JOIN (SELECT * FROM summary WHERE ip_address IN (SELECT ip_address FROM scores WHERE level IN ('HIGH', 'CRITICAL'))) s USING (ip_address)
    LEFT JOIN (SELECT * FROM phases WHERE ip_address IN (SELECT ip_address FROM scores WHERE level IN ('HIGH', 'CRITICAL'))) p USING (ip_address)
    WHERE c.score >= 15""",
    PHASED,
)

# Reports.
ORACLE["event_type_counts"] = with_ev("SELECT event, count(*) AS events FROM ev GROUP BY 1")
ORACLE["failed_by_ip"] = with_ev(
    "SELECT ip_address, count(*) AS failed_count FROM ev WHERE event = 'FAILED_LOGIN' GROUP BY 1"
)
ORACLE["fail_success_by_ip"] = with_ev(
    """SELECT ip_address, count(*) FILTER (event = 'FAILED_LOGIN') AS failed,
    count(*) FILTER (event = 'SUCCESSFUL_LOGIN') AS success FROM ev GROUP BY 1"""
)
ORACLE["unique_ips"] = with_ev("SELECT DISTINCT ip_address FROM ev WHERE ip_address <> 'Internal'")
ORACLE["events_by_ip"] = with_ev(f"SELECT {EVENT_COLUMNS} FROM ev WHERE ip_address = '198.51.100.7'")
ORACLE["events_by_time"] = with_ev(f"SELECT {EVENT_COLUMNS} FROM ev")
ORACLE["failed_heatmap"] = with_ev(
    "SELECT d.weekday, " + ", ".join(
        f"count(*) FILTER (event = 'FAILED_LOGIN' AND hour(parsed_time) = {h}) AS h{h:02d}" for h in range(24)
    ) + """ FROM (VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), (5, 'Friday'), (6, 'Saturday'), (7, 'Sunday')) d(n, weekday)
    LEFT JOIN ev ON isodow(parsed_time) = d.n GROUP BY 1"""
)
# One pass over the events: statistics as windows over the minutes, no second look at them.
ORACLE["login_frequency"] = with_ev(
    f"""SELECT minute, events, {rnd('limit_', 6)} AS threshold, coalesce(events > limit_, false) AS is_spike FROM (
      SELECT minute, events, avg(events) OVER () + 2 * stddev_samp(events) OVER () AS limit_ FROM per_minute)""",
    """counted AS MATERIALIZED (
      SELECT epoch_us(parsed_time) // 60000000 AS m, count(*) AS c FROM ev GROUP BY 1
    ), spine AS (
      SELECT unnest(range(first_m, last_m + 1)) AS m FROM (SELECT min(m) AS first_m, max(m) AS last_m FROM counted)
    ), per_minute AS (
      SELECT make_timestamp(m * 60000000) AS minute, coalesce(c, 0) AS events FROM spine LEFT JOIN counted USING (m)
    )""",
)
ORACLE["technique_counts"] = with_ev(
    f"""SELECT mitre_technique, split_part(mitre_technique, ' — ', 1) AS technique_id, split_part(mitre_technique, ' — ', 2) AS technique_name,
    mitre_tactic, events, {rnd('events::DOUBLE / sum(events) OVER ()', 6)} AS share,
    events > (SELECT median(events) FROM tech) AS above_median FROM tech""",
    INTEL, ENRICHED, "tech AS (SELECT mitre_technique, mitre_tactic, count(*) AS events FROM enriched GROUP BY 1, 2)",
)
ORACLE["tactic_counts"] = with_ev(
    f"""SELECT mitre_tactic, count(*) AS events, {rnd('count(*)::DOUBLE / sum(count(*)) OVER () * 100', 6)} AS percent,
    {rnd('count(*)::DOUBLE / max(count(*)) OVER ()', 6)} AS of_largest FROM enriched GROUP BY 1""",
    INTEL, ENRICHED,
)
ORACLE["geo_breakdown"] = with_ev(
    f"""SELECT geo_country, count(DISTINCT ip_address) AS ips, count(*) AS events, {rnd('avg(geo_risk)', 6)} AS avg_risk
    FROM enriched GROUP BY 1""",
    INTEL, ENRICHED,
)
ORACLE["executive_summary"] = with_scores(
    f"""SELECT CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level,
    total_events, critical AS critical_ips, high AS high_ips,
    (SELECT count(*) FROM fails, baseline WHERE failed_count >= threshold) AS bruteforce_sources,
    (SELECT count(*) FROM ({ORACLE['compromise_pattern'].split('FROM raw_stats')[1].split(')', 1)[1]})) AS compromise_patterns,
    (SELECT count(*) FROM flagged WHERE is_anomaly) AS anomalous_ips,
    critical + high AS attack_chains,
    (SELECT max(kill_chain_progress) FROM summary JOIN scores USING (ip_address) WHERE level IN ('HIGH', 'CRITICAL')) AS max_progress,
    window_start, window_end, {rnd('(epoch_us(window_end) - epoch_us(window_start)) / 3.6e9', 6)} AS duration_hours, users,
    (SELECT count(*) FROM session_numbers) AS sessions
    FROM (SELECT count(*) AS total_events, min(parsed_time) AS window_start, max(parsed_time) AS window_end, count(DISTINCT username) AS users FROM ev),
    (SELECT count(*) FILTER (level = 'CRITICAL') AS critical, count(*) FILTER (level = 'HIGH') AS high, count(*) FILTER (level = 'MEDIUM') AS medium FROM scores)""",
    BASELINE, PHASED, SESSIONS,
)

# Behaviour of users: Viterbi decoding step by step, in the same fixed-point units.
UNIT = float(1 << 32)


def log_units(p):
    return round(math.log(p + 1e-10) * UNIT)


START, MOVE, EMIT = behaviour.START, behaviour.TRANSITION, behaviour.EMISSION


def emitted(state):
    return "CASE q.obs " + " ".join(f"WHEN {o} THEN {log_units(EMIT[state][o])}" for o in range(5)) + " END"


def best_of(a, b, c):
    """Index of the greatest, the first on ties."""
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"


def moved(state):
    options = [f"f.s{i} + {log_units(MOVE[i][state])}" for i in range(3)]
    return f"greatest({', '.join(options)}) + {emitted(state)} AS s{state}, {best_of(*options)} AS b{state}"


STATES = """
seq AS (
  SELECT username, parsed_time, source_file, line_number,
    row_number() OVER (PARTITION BY username ORDER BY parsed_time, line_number) AS i,
    count(*) OVER (PARTITION BY username) AS n,
    CASE WHEN event = 'SUCCESSFUL_LOGIN' AND hour(parsed_time) < 5 THEN 2
      WHEN event = 'SUCCESSFUL_LOGIN' AND row_number() OVER (PARTITION BY username, ip_address ORDER BY parsed_time, line_number) = 1 THEN 3
      WHEN event = 'FAILED_LOGIN' THEN 1 WHEN event IN ('ROOT_ACCESS', 'SUDO_ATTEMPT') THEN 4 ELSE 0 END AS obs
  FROM ev WHERE username <> 'unknown'
), forward AS (
  SELECT username, i, """ + ", ".join(
    f"CAST({log_units(START[j])} + {emitted(j)} AS BIGINT) AS s{j}, 0 AS b{j}" for j in range(3)
) + """ FROM seq q WHERE i = 1
  UNION ALL
  SELECT q.username, q.i, """ + ", ".join(moved(j) for j in range(3)) + """
  FROM forward f JOIN seq q ON q.username = f.username AND q.i = f.i + 1
), backward AS (
  SELECT f.username, f.i, """ + best_of("f.s0", "f.s1", "f.s2") + """ AS state
  FROM forward f JOIN seq q ON q.username = f.username AND q.i = f.i AND q.i = q.n
  UNION ALL
  SELECT b.username, b.i - 1, CASE b.state WHEN 0 THEN f.b0 WHEN 1 THEN f.b1 ELSE f.b2 END
  FROM backward b JOIN forward f ON f.username = b.username AND f.i = b.i WHERE b.i > 1
), path AS (
  SELECT q.*, CASE WHEN q.n < 2 THEN 0 ELSE b.state END AS state FROM seq q JOIN backward b ON b.username = q.username AND b.i = q.i
), profiles AS (
  SELECT username, count(*) AS event_count, count(*) FILTER (state = 1) AS elevated, count(*) FILTER (state = 2) AS compromised,
    CASE max(state) FILTER (i = n) WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'ELEVATED' ELSE 'COMPROMISED' END AS current_state,
    CASE WHEN count(*) < 2 THEN 0.1::DOUBLE ELSE """ + rnd(
    "(0.0::DOUBLE + count(*) FILTER (state = 1) * 0.3::DOUBLE + count(*) FILTER (state = 2) * 0.7::DOUBLE) / count(*)", 3
) + """ END AS risk FROM path GROUP BY 1
)"""
ORACLE["user_observations"] = with_ev(
    "SELECT username, parsed_time, source_file, line_number, obs AS observation FROM seq", STATES
)
ORACLE["user_state_path"] = with_ev(
    """SELECT username, parsed_time, source_file, line_number, obs AS observation,
    CASE state WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'ELEVATED' ELSE 'COMPROMISED' END AS state FROM path""",
    STATES,
)
ORACLE["user_profiles"] = with_ev("SELECT * FROM profiles", STATES)
ORACLE["user_risk_ranking"] = with_ev("SELECT username, current_state, risk FROM profiles", STATES)
ORACLE["insider_threats"] = with_ev(
    """SELECT username, risk_score, current_state, concat_ws('; ', i1, i2, i3, i4) AS indicators, event_count FROM (
      SELECT p.username, p.risk AS risk_score, p.current_state, a.event_count,
        CASE WHEN current_state IN ('COMPROMISED', 'ELEVATED') THEN 'HMM state: ' || current_state END AS i1,
        CASE WHEN nights > 0 THEN nights || ' night logins detected' END AS i2,
        CASE WHEN ips > 3 THEN 'Accessed from ' || ips || ' different IPs' END AS i3,
        CASE WHEN privilege > 0 THEN privilege || ' privilege escalation attempts' END AS i4
      FROM profiles p JOIN (
        SELECT username, count(*) AS event_count, count(*) FILTER (""" + NIGHT + """) AS nights,
          count(DISTINCT ip_address) AS ips, count(*) FILTER (event IN ('ROOT_ACCESS', 'SUDO_ATTEMPT')) AS privilege
        FROM ev GROUP BY 1) a USING (username))
    WHERE (i1 IS NOT NULL)::INT + (i2 IS NOT NULL)::INT + (i3 IS NOT NULL)::INT + (i4 IS NOT NULL)::INT >= 2 OR risk_score > 0.3""",
    STATES,
)

# Raw lines, parsing and stored tables.
AUTH_RE = r"([A-Z][a-z]{2}\s+\d+\s\d{2}:\d{2}:\d{2})\s(\S+)\s(\S+?)[\[:\s](.*)"
ISO_RE = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}[^\s]*)\s(\S+)\s(\S+?)[\[:\s](.*)"
SIMPLE_RE = r"([A-Z][a-z]{2}\s+\d+\s\d{2}:\d{2}:\d{2})\s(\S+)\s(\S+?):?\s(.*)"


def header_part(group):
    return (
        f"CASE WHEN layout = 'syslog' THEN regexp_extract(trim(value), '{ISO_RE}', {group}) "
        f"ELSE regexp_extract(trim(value), '{AUTH_RE}', {group}) END"
    )


def or_default(pattern, column, default, flags=""):
    found = f"regexp_extract({column}, '{pattern}', 1, '{flags}')"
    return f"CASE WHEN {found} = '' THEN '{default}' ELSE {found} END"


CLASSIFIED = "CASE " + " ".join(
    f"WHEN regexp_matches(message, '{p}', 'i') THEN '{e}'"
    for p, e in [
        ("Failed password", "FAILED_LOGIN"), ("authentication failure", "FAILED_LOGIN"),
        ("Accepted password", "SUCCESSFUL_LOGIN"), ("Accepted publickey", "SUCCESSFUL_LOGIN"),
        ("session opened.*root", "ROOT_ACCESS"), ("sudo:", "SUDO_ATTEMPT"), ("Invalid user", "INVALID_USER"),
        ("Connection closed", "DISCONNECT"), ("Disconnected from", "DISCONNECT"),
    ]
) + " ELSE 'OTHER' END"
IP_FOUND = or_default(r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})", "message", "Internal")
USER_FOUND = or_default(r"(?:for|user)\s+(\S+?)(?:\s|$)", "message", "unknown", "i")
CLASSIC_TIME = r"try_strptime('2024 ' || regexp_replace(timestamp_str, '\s+', ' ', 'g'), '%Y %b %d %H:%M:%S')"
LINES = f"""
noisy AS (
  SELECT * FROM (SELECT host, unnest([
    CASE WHEN host = 'host3' THEN strftime(parsed_time, '%Y-%m-%dT%H:%M:%S') || '+00:00 ' || host || ' sshd[' || message
      ELSE timestamp_str || ' ' || host || ' sshd[' || message END,
    CASE WHEN line_number % 40 = 0 THEN '   ' END,
    CASE WHEN line_number % 41 = 0 THEN 'kernel message ' || line_number END,
    CASE WHEN line_number % 43 = 0 THEN 'Feb 31 10:00:00 host0 sshd[1]: Failed password for x from 1.2.3.4 port 1 ssh2' END
  ]) AS value FROM ev) WHERE value IS NOT NULL
), lines AS (
  SELECT value, CASE WHEN host = 'host3' THEN 'syslog' ELSE 'auth_log' END AS layout FROM noisy
), headers AS (
  SELECT layout, trim(value) AS raw_line, {header_part(1)} AS timestamp_str, {header_part(2)} AS host,
    {header_part(3)} AS process, {header_part(4)} AS message FROM lines
), split AS (SELECT * FROM headers WHERE timestamp_str <> ''),
timed AS (
  SELECT *, CASE WHEN layout = 'syslog' THEN CAST(substr(timestamp_str, 1, 19) AS TIMESTAMP) ELSE {CLASSIC_TIME} END AS parsed_time FROM split
)"""
PARSED = f"""SELECT timestamp_str, parsed_time, {CLASSIFIED} AS event, {IP_FOUND} AS ip_address,
{USER_FOUND} AS username, process, host, message, raw_line FROM timed WHERE parsed_time IS NOT NULL"""
# Each line is alone at its position in the file, which lies in the folder of its host.
POSITION = "SELECT *, host AS folder, 1::BIGINT AS same_position FROM (%s)"
ORACLE["read_auth_logs"] = with_ev(POSITION % PARSED, LINES)
ORACLE["stream_ingest"] = with_ev(POSITION % PARSED.replace("FROM timed", "FROM row_timed"), LINES + f""",
row_lines AS (SELECT value, CASE WHEN regexp_matches(value, '{AUTH_RE}') THEN 'auth_log' ELSE 'syslog' END AS layout FROM noisy),
row_split AS (SELECT layout, trim(value) AS raw_line, {header_part(1)} AS timestamp_str, {header_part(2)} AS host,
  {header_part(3)} AS process, {header_part(4)} AS message FROM row_lines),
row_timed AS (SELECT *, CASE WHEN layout = 'syslog' THEN CAST(substr(timestamp_str, 1, 19) AS TIMESTAMP) ELSE {CLASSIC_TIME} END AS parsed_time
  FROM row_split WHERE timestamp_str <> '')""")
ORACLE["detect_log_format"] = with_ev(
    "SELECT DISTINCT host, CASE WHEN host = 'host3' THEN 'syslog' ELSE 'auth_log' END AS layout FROM ev"
)
ORACLE["split_header"] = with_ev("SELECT layout, timestamp_str, host, process, message FROM split", LINES)
ORACLE["classify_event"] = with_ev(f"SELECT message, {CLASSIFIED} AS event FROM split", LINES)
ORACLE["extract_ip"] = with_ev(f"SELECT message, {IP_FOUND} AS ip_address FROM split", LINES)
ORACLE["extract_user"] = with_ev(f"SELECT message, {USER_FOUND} AS username FROM split", LINES)
ORACLE["parse_event_time"] = with_ev("SELECT timestamp_str, parsed_time FROM timed", LINES)
ORACLE["parse_simple_profile"] = with_ev(
    f"""SELECT timestamp_str, CASE WHEN contains(message, 'Failed password') THEN 'FAILED_LOGIN'
      WHEN contains(message, 'Accepted password') THEN 'SUCCESSFUL_LOGIN' ELSE 'OTHER' END AS event,
    {or_default(r'([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)', 'message', 'Internal')} AS ip_address, message, {CLASSIC_TIME} AS parsed_time
    FROM (SELECT regexp_extract(value, '{SIMPLE_RE}', 1) AS timestamp_str, regexp_extract(value, '{SIMPLE_RE}', 4) AS message FROM noisy)
    WHERE timestamp_str <> ''""",
    LINES,
)
ORACLE["write_events"] = ORACLE["events_by_time"]
ORACLE["overlay_by_event"] = with_ev(
    f"""SELECT line_number, event, CASE WHEN {NIGHT} THEN 'night' ELSE '' END AS hmm_state, 'LOW' AS severity_level,
    CASE WHEN {NIGHT} THEN 1 ELSE 0 END AS tamper_flag, 0.5::DOUBLE AS ip_reputation FROM ev"""
)
ORACLE["overlay_by_ip"] = with_scores(
    """SELECT line_number, ip_address, score AS risk_score,
    level AS severity_level, '' AS session_id FROM ev JOIN scores USING (ip_address)"""
)
ORACLE["append_run_log"] = with_scores(
    """SELECT 'events' AS log_file, (SELECT count(*) FROM ev) AS total_events,
    (SELECT count(*) FROM fails, baseline WHERE failed_count >= threshold) AS suspects,
    (SELECT count(*) FROM scores WHERE level = 'CRITICAL') AS critical,
    '{"z_score":2.5,"night_end":5}' AS config_json""",
    BASELINE,
)

# Streams: every minute with events, and every session of the closed input.
ORACLE["stream_login_frequency"] = with_ev(
    """SELECT minute, c AS events, c > limit_ AS is_spike FROM (
      SELECT date_trunc('minute', parsed_time) AS minute, count(*) AS c FROM ev GROUP BY 1),
      (SELECT avg(events) + 2 * stddev_samp(events) AS limit_ FROM per_minute)""",
    """per_minute AS (
      SELECT minute, coalesce(c, 0) AS events FROM (
        SELECT unnest(generate_series(date_trunc('minute', min(parsed_time)), date_trunc('minute', max(parsed_time)), INTERVAL 1 MINUTE)) AS minute FROM ev)
      LEFT JOIN (SELECT date_trunc('minute', parsed_time) AS minute, count(*) AS c FROM ev GROUP BY 1) USING (minute))""",
)
ORACLE["stream_sessions"] = with_ev(
    """SELECT ip_address, min(parsed_time) AS session_start, max(parsed_time) AS session_end, count(*) AS event_count
    FROM linked GROUP BY ip_address, ordinal""",
    SESSIONS,
)

# The isolation forest: its draws are digests, so the same trees can be grown level by level.
TREES, TREE_ROWS, LEVELS = 200, 256, 8


def draw_of(text, part):
    return f"CAST('0x' || substr(md5({text}), {1 + 7 * part}, 7) AS BIGINT)"


def grown(level):
    """Extent of every feature in every place of a level, its split, and the rows one level down."""
    place = "tree || ':' || place"
    return f"""
extent_{level} AS MATERIALIZED (
  SELECT tree, place, i, min(x) AS low, max(x) AS high, count(*) AS n
  FROM rows_{level} JOIN long USING (ip_address) GROUP BY ALL
), place_{level} AS MATERIALIZED (
  SELECT tree, place, max(n) AS n, coalesce(list(i ORDER BY i) FILTER (low < high), []) AS usable FROM extent_{level} GROUP BY ALL
), split_{level} AS MATERIALIZED (
  SELECT p.tree, p.place, e.i, e.low + (e.high - e.low) * ({draw_of(place, 1).replace('tree', 'p.tree').replace('place', 'p.place')} / 268435456.0::DOUBLE) AS split
  FROM place_{level} p JOIN tree_size s USING (tree) JOIN extent_{level} e ON e.tree = p.tree AND e.place = p.place
    AND e.i = p.usable[{draw_of(place, 0).replace('tree', 'p.tree').replace('place', 'p.place')} % len(p.usable) + 1]
  WHERE {level} < s.depth AND p.n > 1 AND len(p.usable) > 0
), rows_{level + 1} AS MATERIALIZED (
  SELECT r.tree, r.ip_address, 2 * r.place + CASE WHEN l.x <= s.split THEN 0 ELSE 1 END AS place
  FROM rows_{level} r JOIN split_{level} s USING (tree, place) JOIN long l ON l.ip_address = r.ip_address AND l.i = s.i
)"""


def walked(level):
    """All addresses one level further down, and what a leaf they end in adds to their path."""
    return f"""
ended_{level} AS MATERIALIZED (
  SELECT w.ip_address, w.tree, {level} + CASE WHEN p.n <= 1 THEN 0.0::DOUBLE WHEN p.n = 2 THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * (ln(p.n - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * (p.n - 1.0::DOUBLE) / p.n END AS path
  FROM walk_{level} w JOIN place_{level} p USING (tree, place) LEFT JOIN split_{level} s USING (tree, place) WHERE s.i IS NULL
), walk_{level + 1} AS MATERIALIZED (
  SELECT w.tree, w.ip_address, 2 * w.place + CASE WHEN l.x <= s.split THEN 0 ELSE 1 END AS place
  FROM walk_{level} w JOIN split_{level} s USING (tree, place) JOIN long l ON l.ip_address = w.ip_address AND l.i = s.i
)"""


def noise_free(name):
    return rnd(name, {"iet_mean": 2, "iet_std": 2}.get(name, 6))


FOREST = ", ".join(
    [
        "long AS MATERIALIZED (" + " UNION ALL ".join(
            f"SELECT ip_address, {i} AS i, {noise_free(c)}::DOUBLE AS x FROM feat" for i, c in enumerate(FEATURE_NAMES)
        ) + ")",
        f"""
drawn AS (
  SELECT tree, ip_address, ({draw_of('ip_address', 0)} * {draw_of("'tree ' || tree", 0)} + {draw_of('ip_address', 1)} * {draw_of("'tree ' || tree", 1)}
    + {draw_of("'shift ' || tree", 0)}) % 2147483647 AS draw FROM feat, range(0, {TREES}) t(tree)
), rows_0 AS MATERIALIZED (
  SELECT tree, ip_address, 1::BIGINT AS place FROM drawn
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY draw, ip_address) <= {TREE_ROWS}
), tree_size AS MATERIALIZED (
  SELECT tree, ceil(log2(greatest(count(*), 2)))::INT AS depth FROM rows_0 GROUP BY tree
), walk_0 AS MATERIALIZED (SELECT tree, ip_address, 1::BIGINT AS place FROM feat, range(0, {TREES}) t(tree))""",
        *[grown(level) for level in range(LEVELS + 1)],
        *[walked(level) for level in range(LEVELS + 1)],
        "paths AS (" + " UNION ALL ".join(f"SELECT * FROM ended_{level}" for level in range(LEVELS + 1)) + ")",
        f"""
ip_number AS (SELECT count(*) AS n, least(count(*), {TREE_ROWS}) AS m FROM feat),
isolated AS (
  SELECT ip_address, {rnd(f"pow(2.0::DOUBLE, -(sum(path) / {TREES}.0::DOUBLE) / max(CASE WHEN m <= 1 THEN 0.0::DOUBLE WHEN m = 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * (ln(m - 1.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * (m - 1.0::DOUBLE) / m END))", 12)} AS isolation
  FROM paths, ip_number GROUP BY ip_address
), ranked AS (
  SELECT isolation, row_number() OVER (ORDER BY isolation) - 1 AS r,
    (1.0::DOUBLE - CASE WHEN n < 5 THEN 0.2::DOUBLE WHEN n < 20 THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END) * (n - 1) AS at_rank
  FROM isolated, ip_number
), edge AS (
  SELECT min(isolation) AS low, max(isolation) AS high,
    min(isolation) FILTER (r >= floor(at_rank)) + (max(isolation) FILTER (r <= ceil(at_rank)) - min(isolation) FILTER (r >= floor(at_rank)))
      * max(at_rank - floor(at_rank)) AS edge
  FROM ranked
), forest AS (
  SELECT ip_address, CASE WHEN n < 3 THEN 0.5::DOUBLE ELSE {rnd("CASE WHEN high > low THEN (isolation - low) / (high - low) ELSE 0.5::DOUBLE END", 4)} END AS anomaly_score,
    n >= 3 AND isolation > edge AS is_anomaly
  FROM isolated, edge, ip_number
)""",
    ]
)
ORACLE["isolation_forest"] = with_ev("SELECT * FROM forest", INTEL, FEATURES, FOREST)
ORACLE["run_models"] = with_ev(
    """SELECT 'anomaly' AS model, ip_address AS subject, CAST(is_anomaly AS VARCHAR) AS outcome, anomaly_score AS score FROM forest
    UNION ALL SELECT 'campaign', ip_address, cluster_label, campaign_cluster::DOUBLE FROM campaigns
    UNION ALL SELECT 'user', username, current_state, risk FROM profiles""",
    INTEL, FEATURES, FOREST, SCALED, PARAMS, CAMPAIGNS, STATES,
)

# Ranges of addresses: every range that holds an address, the narrowest first.
QUAD = "CAST(string_split(%s, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(%s, '.')[2] AS BIGINT) * 65536 + CAST(string_split(%s, '.')[3] AS BIGINT) * 256 + CAST(string_split(%s, '.')[4] AS BIGINT)"


def quad(column):
    return QUAD.replace("%s", column)


ORACLE["ip_ranges"] = with_ev(
    """SELECT ip_address, first_ip, last_ip, network FROM all_ips LEFT JOIN (
      SELECT a.ip_address, r.first_ip, r.last_ip, r.network FROM ips a JOIN ranges r ON a.n BETWEEN r.a AND r.b
      QUALIFY row_number() OVER (PARTITION BY a.ip_address ORDER BY r.b - r.a, r.a, r.network) = 1) USING (ip_address)""",
    f"""all_ips AS (SELECT DISTINCT ip_address FROM ev),
    ips AS (SELECT ip_address, {quad('ip_address')} AS n FROM all_ips WHERE ip_address <> 'Internal'),
    parted AS (SELECT *, array_to_string(string_split(ip_address, '.')[1:2], '.') AS two, array_to_string(string_split(ip_address, '.')[1:3], '.') AS three FROM ips),
    named AS (
      SELECT DISTINCT two || '.0.0' AS first_ip, two || '.255.255' AS last_ip, 'wide ' || two AS network FROM parted WHERE two NOT LIKE '%3'
      UNION ALL SELECT arg_min(ip_address, n), arg_max(ip_address, n), 'narrow ' || three FROM parted GROUP BY three
      UNION ALL SELECT ip_address, ip_address, 'single' FROM parted WHERE n % 7 = 0
      UNION ALL SELECT '200.0.0.1', '255.255.255.254', 'rest'
    ), ranges AS (SELECT *, {quad('first_ip')} AS a, {quad('last_ip')} AS b FROM named)""",
)
ORACLE["activity_sketches"] = with_ev(
    """SELECT ip_address, count(*) AS total_events, count(*) FILTER (event = 'FAILED_LOGIN') AS failed_count,
    count(DISTINCT username) AS unique_users, count(DISTINCT username) FILTER (event = 'FAILED_LOGIN') AS failing_users,
    count(DISTINCT host) AS hosts_accessed FROM ev GROUP BY 1"""
)
