"""Analyst, enforcement, indicator and correlation statements."""

from __future__ import annotations

from mailsleuth.functions import rules as R

from . import parts as P
from .parts import lst, q, stmt, view

FLOW: dict[str, str] = {}
S = FLOW

SC, US, EN, RQ = view("scans", "sc"), view("users", "us"), view("enforceable", "en"), view("release_requests", "rq")
SU = "su AS (SELECT sc.*, username, email, coalesce(username, 'Public visitor') AS submitted_by FROM sc LEFT JOIN us USING (user_id))"


def hay(term: str) -> str:
    cols = ["subject", "sender", "receiver", "reply_to", "urls_text", "iocs_text", "username", "email"]
    pat = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return "(" + " OR ".join(f"coalesce({c} ILIKE '%{pat}%' ESCAPE '\\', FALSE)" for c in cols) + ")"


S["p01_visible_scans"] = stmt(SC, final="SELECT scan_id, user_id, verdict FROM sc WHERE user_id = 7 OR user_id IS NULL")
S["p02_history_search"] = stmt(SC, US, SU, final=f"SELECT scan_id, sender, submitted_by, verdict FROM su WHERE (user_id = 7 OR user_id IS NULL) AND {hay('PayPal-help')}")
S["p02_history_search_public"] = stmt(SC, US, SU, final=f"SELECT scan_id, sender, submitted_by, verdict FROM su WHERE user_id IS NULL AND verdict = 'High Risk' AND ({hay('guest')} OR user_id IS NULL)")
S["p02_history_search_number"] = stmt(SC, US, SU, final=f"SELECT scan_id, subject, submitted_by FROM su WHERE user_id IS NULL AND ({hay('14')} OR scan_id = 14)")
_mine = [("PayPal-help", "(user_id = 7 OR user_id IS NULL)", "FALSE"), ("14", "user_id IS NULL", "scan_id = 14"), ("r1", "(user_id = 11 OR user_id IS NULL)", "FALSE"), ("guest", "user_id IS NULL", "user_id IS NULL")]
S["p02_index_search"] = stmt(SC, US, SU, final=" UNION ALL ".join(f"SELECT cast({step} AS bigint) AS step, '{t}' AS term, scan_id, submitted_by FROM su WHERE scan_id % 2 <= {step} AND {seen} AND ({hay(t)} OR {more})" for step in (0, 1) for t, seen, more in _mine))
S["p03_category_filter"] = stmt(SC, final="SELECT scan_id, categories_text FROM sc WHERE (user_id = 11 OR user_id IS NULL) AND list_contains(string_split(categories_text, ';'), 'Suspicious URL')")
S["p04_category_facets"] = stmt(SC, final="SELECT category, count(*) AS scans FROM (SELECT unnest(string_split(categories_text, ';')) AS category FROM sc WHERE user_id = 7 OR user_id IS NULL) WHERE category <> '' GROUP BY category")
S["p05_user_search"] = stmt(US, final="SELECT user_id, username, email, role FROM us WHERE (username ILIKE '%#0000%' OR email ILIKE '%#0000%') AND role = 'analyst'")

_sum = "CASE WHEN findings_text = '' THEN 'Deterministic risk score evaluation' ELSE array_to_string(string_split(findings_text, ';'), '; ') END"
_dec = "CASE WHEN risk_score <= 29 THEN 'ALLOW' WHEN risk_score <= 64 THEN 'REVIEW' WHEN risk_score <= 95 THEN 'QUARANTINE' ELSE 'REJECT' END"
_rsn = f"""CASE WHEN risk_score <= 29 THEN 'Risk score ' || risk_score || ' is within ALLOW threshold (0-29).' WHEN risk_score <= 64 THEN 'Risk score ' || risk_score || ' requires analyst REVIEW (30-64). ' || {_sum}
 WHEN risk_score <= 95 THEN 'Risk score ' || risk_score || ' triggered QUARANTINE policy (65-95). ' || {_sum} ELSE 'Risk score ' || risk_score || ' triggered REJECT policy (96-100). ' || {_sum} END"""
DE = f"""
de0 AS (SELECT *, CASE WHEN evaluation_error IS NOT NULL THEN 'REVIEW' ELSE {_dec} END AS decision, CASE WHEN evaluation_error IS NOT NULL THEN 'Security Analysis Evaluation Error: ' || evaluation_error ELSE {_rsn} END AS reason
  FROM en WHERE status NOT IN ('ALLOW', 'READY_FOR_RELAY', 'REVIEW', 'QUARANTINED', 'REJECTED', 'DELIVERED')),
de AS (SELECT *, CASE decision WHEN 'ALLOW' THEN 'READY_FOR_RELAY' WHEN 'REVIEW' THEN 'REVIEW' WHEN 'QUARANTINE' THEN 'QUARANTINED' ELSE 'REJECTED' END AS final_status FROM de0),
qu AS (SELECT *, 'QUAR-' || strftime(decided_at, '%Y%m%d') || '-' || left(sha256(message_id || '|' || tenant_id), 8) AS quarantine_id FROM de WHERE decision = 'QUARANTINE')"""
S["p06_quarantine_list"] = stmt(EN, DE, final="SELECT quarantine_id, message_id, from_addr AS original_sender, recipient, risk_score FROM qu WHERE tenant_id = 't3'")
S["p06_review_list"] = stmt(EN, DE, final="SELECT message_id, from_addr, risk_score FROM de WHERE final_status = 'REVIEW' AND tenant_id = 't1'")
S["p11_threshold_action"] = stmt(SC, final="SELECT scan_id, risk_score, CASE WHEN risk_score >= 65 THEN 'TRASHED' ELSE 'ALLOWED' END AS action_taken, 'ALLOWED' AS label_action FROM sc")
S["f28_policy_decisions"] = stmt(EN, final=f"SELECT message_id, risk_score, {_dec} AS decision, {_rsn} AS reason FROM en")
S["f29_status_labels"] = stmt(EN, final="SELECT message_id, CASE severity WHEN 'CRITICAL' THEN 'High Risk' WHEN 'HIGH' THEN 'High Risk' WHEN 'MEDIUM' THEN 'Medium Risk' ELSE 'Low Risk' END AS verdict, CASE severity WHEN 'CRITICAL' THEN 'danger' WHEN 'HIGH' THEN 'danger' WHEN 'MEDIUM' THEN 'warning' ELSE 'success' END AS tone FROM en")
S["f30_json_lists"] = stmt(view("legacy_scans", "ls"), "j AS (SELECT id, CASE WHEN json_valid(categories_json) THEN cast(categories_json AS json)::varchar[] ELSE [] END AS l FROM ls)", final="SELECT id, array_to_string(l, '|') AS categories, len(l) AS n FROM j")
S["f32_quarantine_ids"] = stmt(EN, DE, final="SELECT message_id, tenant_id, quarantine_id FROM qu")
S["x03_policy_bands"] = stmt(EN, final="SELECT message_id, CASE WHEN risk_score <= 9 THEN 'ALLOW' WHEN risk_score <= 49 THEN 'REVIEW' WHEN risk_score <= 79 THEN 'QUARANTINE' ELSE 'REJECT' END AS decision FROM en")

# ---- joins and flow ------------------------------------------------------------------------
S["j01_scans_users"] = stmt(SC, US, SU, final="SELECT scan_id, user_id, submitted_by, email FROM su")
S["j02_insert_if_absent"] = stmt(SC, final="SELECT DISTINCT subject, sender FROM sc WHERE NOT EXISTS (SELECT 1 FROM sc b WHERE b.scan_id % 3 = 0 AND b.subject IS NOT DISTINCT FROM sc.subject AND b.sender IS NOT DISTINCT FROM sc.sender)")
S["j03_upsert_decisions"] = stmt(EN, RQ, DE, "al AS (SELECT message_id, decision, risk_score, decided_at, 0 AS v FROM de UNION ALL SELECT message_id, 'REJECT', 100, max(requested_at), 1 FROM rq WHERE action = 'REJECT' GROUP BY message_id)",
    final="SELECT message_id, decision, risk_score FROM al QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY decided_at DESC, v DESC) = 1")
S["j04_status_propagation"] = stmt(EN, DE, final="SELECT 'o' || cast(o_orderkey AS varchar) AS message_id, coalesce(final_status, 'PROCESSING') AS status FROM orders LEFT JOIN de ON de.message_id = 'o' || cast(o_orderkey AS varchar)")
S["j09_release_results"] = stmt(EN, RQ, DE, """rj AS (SELECT rq.request_id, rq.message_id, rq.tenant_id, qu.quarantine_id, qu.tenant_id AS owner, NOT ends_with(rq.message_id, '77') AND EXISTS (SELECT 1 FROM en WHERE en.message_id = rq.message_id) AS has_message FROM rq LEFT JOIN qu USING (message_id) WHERE action = 'RELEASE')""",
    "rk AS (SELECT *, min(request_id) FILTER (quarantine_id IS NOT NULL AND owner = tenant_id AND has_message) OVER (PARTITION BY message_id) AS winner FROM rj)",
    final="SELECT request_id, message_id, quarantine_id, CASE WHEN quarantine_id IS NULL THEN 'NOT_FOUND' WHEN owner <> tenant_id THEN 'CROSS_TENANT' WHEN winner < request_id THEN 'ALREADY_RELEASED' WHEN NOT has_message THEN 'MESSAGE_MISSING' ELSE 'RELEASED' END AS result FROM rk")
S["j03_upsert_store"], S["j04_status_store"], S["st5_release_store"] = S["j03_upsert_decisions"], S["j04_status_propagation"], S["j09_release_results"]
AT = view("attempts", "att")
S["st3_retry_fold"] = stmt(AT, """fa AS (SELECT *, count(*) FILTER (outcome = 'ok') OVER w AS oks, count(*) FILTER (outcome = 'failed') OVER w AS fails FROM att WINDOW w AS (PARTITION BY message_id ORDER BY attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 fb AS (SELECT * FROM fa WHERE oks = 0 AND fails < 3), fc AS (SELECT message_id, count(*) FILTER (outcome = 'failed') AS retry_count, max_by(outcome, attempt_no) AS last_outcome, max_by(error_text, attempt_no) AS last_text FROM fb GROUP BY message_id)""",
    final="SELECT message_id, retry_count, CASE WHEN last_outcome = 'ok' THEN 'READY_FOR_ANALYSIS' WHEN retry_count >= 3 THEN 'FAILED' ELSE 'QUEUED' END AS status, CASE WHEN last_outcome = 'ok' THEN NULL ELSE last_text END AS error_message FROM fc")
S["st3_retry_stream"] = S["st3_retry_fold"]
S["st1_ingest_stream"] = stmt(AT, final="SELECT DISTINCT message_id, 'QUEUED' AS status FROM att")
S["st4_enforcement"] = stmt(EN, DE, final="SELECT message_id, tenant_id, decision, reason, final_status FROM de")
S["st4_audit_rows"] = stmt(EN, DE, final="SELECT tenant_id, decision AS action, 'system' AS actor_id, count(*) AS events, cast(sum(risk_score) AS bigint) AS risk_sum FROM de GROUP BY ALL")
S["st5_release_flow"] = stmt(EN, RQ, DE, """fe AS (SELECT rq.message_id, request_id, de.final_status AS start, CASE WHEN action = 'REJECT' THEN 'REJECTED' WHEN action = 'RELEASE' AND qu.tenant_id = rq.tenant_id AND request_id = min(request_id) FILTER (action = 'RELEASE' AND qu.tenant_id = rq.tenant_id) OVER (PARTITION BY rq.message_id) THEN 'READY_FOR_RELAY'
   WHEN action = 'RELEASE_REVIEW' AND de.final_status = 'REVIEW' AND count(*) FILTER (action = 'REJECT' OR action = 'RELEASE_REVIEW') OVER (PARTITION BY rq.message_id ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 THEN 'READY_FOR_RELAY' END AS effect
   FROM rq JOIN de USING (message_id) LEFT JOIN qu ON qu.message_id = rq.message_id)""",
    final="SELECT message_id, any_value(start) AS start, count(*) AS requests, coalesce(max_by(effect, request_id) FILTER (effect IS NOT NULL), any_value(start)) AS state FROM fe GROUP BY message_id")
S["st6_relay_results"] = stmt(EN, DE, view("relay_outcomes", "ro"), "fo AS (SELECT message_id, smtp_code, relay_host FROM ro QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY attempt_no, smtp_code, relay_host) = 1)",
    final="SELECT message_id, tenant_id, relay_host, smtp_code, CASE WHEN smtp_code = 250 THEN 'DELIVERED' ELSE 'FAILED' END AS status, CASE WHEN smtp_code = 250 THEN 'DELIVERED' ELSE 'DELIVERED_FAILED' END AS audit_action FROM fo JOIN de USING (message_id) WHERE final_status = 'READY_FOR_RELAY'")
S["st7_live_cache"] = stmt(AT, final="SELECT message_id, attempt_no FROM att WHERE attempted_at + CASE WHEN outcome = 'ok' THEN interval 3600 second ELSE interval 300 second END >= (SELECT max(attempted_at) FROM att)")
S["st7_cache_stream"] = """WITH RECURSIVE e AS (SELECT 'k' || cast(user_id AS varchar) AS cache_key, event_id AS request_id, cast(epoch_us(ts) AS bigint) AS t_us, CASE WHEN event_type NOT IN ('click', 'error') THEN event_type END AS own,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT *, t_us + CASE WHEN own IS NULL THEN 300 ELSE 3600 END * cast(1000000 AS bigint) AS ends FROM e),
r AS (SELECT cache_key, request_id, rn, FALSE AS hit, own AS value, ends AS until FROM f WHERE rn = 1
  UNION ALL SELECT f.cache_key, f.request_id, f.rn, f.t_us <= r.until, CASE WHEN f.t_us <= r.until THEN r.value ELSE f.own END, CASE WHEN f.t_us <= r.until THEN r.until ELSE f.ends END FROM r JOIN f ON f.cache_key = r.cache_key AND f.rn = r.rn + 1)
SELECT cache_key, request_id, hit, value, cast(floor(until / 1000000) AS bigint) AS valid_until FROM r"""
S["st8_audit_defaults"] = """WITH e AS (SELECT *, CASE event_type WHEN 'signup' THEN 'login_success' WHEN 'view' THEN 'logout' ELSE event_type END AS event FROM events)
SELECT event_id, event, CASE WHEN event_id % 3 = 0 THEN 'user' || cast(user_id AS varchar) ELSE 'System' END AS actor_name, CASE WHEN event_id % 5 = 0 THEN 'scan' WHEN event IN ('login_success', 'logout') THEN 'auth' ELSE 'system' END AS target_type FROM e"""

# ---- counters and lists --------------------------------------------------------------------
S["a01_admin_counters"] = stmt(SC, US, EN, DE, final="""SELECT (SELECT count(*) FROM us) AS users, (SELECT count(*) FROM sc) AS scans, (SELECT count(*) FROM sc WHERE verdict = 'High Risk') AS high_risk, (SELECT count(*) FROM en) AS total_received,
 (SELECT count(*) FROM de WHERE decision = 'ALLOW') AS allowed, (SELECT count(*) FROM de WHERE final_status = 'REVIEW') AS review, (SELECT count(*) FROM qu) AS quarantined, (SELECT count(*) FROM de WHERE decision = 'REJECT') AS rejected""")
S["a02_analyst_counters"] = stmt(SC, final="SELECT user_id, count(*) AS total, count(*) FILTER (verdict = 'High Risk') AS high_risk, cast(round_even(avg(risk_score), 0) AS bigint) AS average_score FROM sc WHERE user_id IS NOT NULL GROUP BY user_id")
S["a02_live_counters"] = S["a02_analyst_counters"]
S["t01_history_newest"] = stmt(SC, final="SELECT scan_id, scan_time FROM sc WHERE user_id = 3 OR user_id IS NULL ORDER BY scan_time DESC, scan_id DESC")
S["t02_recent_scans"] = stmt(SC, final="SELECT scan_id, verdict, risk_score FROM sc ORDER BY scan_time DESC, scan_id DESC LIMIT 10")
S["t03_work_batch"] = stmt(AT, "j AS (SELECT message_id, min(attempted_at) AS r, count(*) FILTER (outcome = 'ok') AS ok FROM att GROUP BY message_id)", final="SELECT message_id, CASE ok WHEN 0 THEN 'QUEUED' ELSE 'RECEIVED' END AS status FROM j WHERE ok <= 1 ORDER BY r, message_id LIMIT 10")

# ---- indicators ----------------------------------------------------------------------------
SI = """si0 AS (SELECT scan_id, unnest(string_split(iocs_text, ';')) AS ioc_value FROM sc WHERE iocs_text <> '' UNION ALL SELECT scan_id, lower(split_part(sender, '@', -1)) FROM sc),
si AS (SELECT DISTINCT CASE WHEN regexp_full_match(ioc_value, '\\d{1,3}(\\.\\d{1,3}){3}') THEN 'ip' ELSE 'domain' END AS ioc_type, ioc_value FROM si0)"""
RP = view("reputation", "rp")


def votes(src: str, where: str) -> str:
    return f"""vo AS (SELECT ioc_type, ioc_value, sum(malicious) AS m, sum(suspicious) AS s, sum(harmless) AS h, sum(unknown) AS u, max(confidence) AS c, count(DISTINCT provider) AS p FROM {src}
  WHERE ((provider = 'ip_feed' AND ioc_type = 'ip') OR (provider = 'url_feed' AND ioc_type IN ('url', 'domain')) OR (provider = 'payload_feed' AND ioc_type IN ('url', 'domain', 'hash')) OR (provider = 'multi_feed' AND ioc_type IN ('url', 'domain', 'ip', 'hash', 'email'))) AND {where} GROUP BY ioc_type, ioc_value)"""


_RO = "SELECT ioc_type, ioc_value, cast(coalesce(m, 0) AS bigint) AS malicious, cast(coalesce(s, 0) AS bigint) AS suspicious, cast(coalesce(h, 0) AS bigint) AS harmless, cast(coalesce(u, 1) AS bigint) AS unknown, round(coalesce(c, cast(0.5 AS double)), 6) AS confidence, coalesce(p, 0) AS providers FROM si LEFT JOIN vo USING (ioc_type, ioc_value)"
S["j07_reputation"] = stmt(SC, SI, RP, votes("rp", "expires_at >= timestamp '2024-01-01 12:00:00'"), final=_RO)
S["x02_feed_union"] = stmt(SC, SI, RP, "rx AS (SELECT * REPLACE ('url_feed' AS provider) FROM rp UNION ALL SELECT * FROM rp)", votes("rx", "TRUE"), final=_RO)
_terms = """tm AS (SELECT ip AS term FROM iv WHERE coalesce(ip, '') <> '' UNION SELECT lower(city) FROM nw UNION SELECT md5(n_name) FROM nation UNION SELECT ['malicious.xyz', 'bulk7.example.net', 'ORDER NOTE 5', '10.0.0.1', 'm'][r_regionkey % 5 + 1] FROM region)"""
S["p07_indicator_search"] = stmt(SC, view("ips", "iv"), view("networks", "nw"), _terms, P.ip_steps("tm", "term", "ti"),
    f"""tk AS (SELECT *, CASE WHEN regexp_full_match(term, '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}') THEN 'IPv4 Address' WHEN length(term) = 32 AND regexp_full_match(term, '[a-fA-F0-9]+') THEN 'Cryptographic Hash (MD5)' WHEN length(term) = 64 AND regexp_full_match(term, '[a-fA-F0-9]+') THEN 'Cryptographic Hash (SHA-256)' ELSE 'Domain / Hostname' END AS ioc_type,
  {P.RESTRICTED} AS bad, round({P.entropy("split_part(lower(term), ':', 1)")}, 2) AS domain_entropy FROM ti)""",
    "sh AS (SELECT scan_id, scan_time, lower(concat_ws(chr(1), urls_text, iocs_text, sender, coalesce(subject, ''))) AS hay FROM sc), mt AS (SELECT term, scan_id, row_number() OVER (PARTITION BY term ORDER BY scan_time DESC, scan_id DESC) AS rn FROM (SELECT term, lower(term) AS low FROM tk) JOIN sh ON contains(hay, low))",
    "mc AS (SELECT term, count(*) AS n, string_agg(cast(scan_id AS varchar), '|' ORDER BY scan_id) FILTER (rn <= 10) AS ids FROM mt GROUP BY term)",
    final="""SELECT term, ioc_type, ioc_type = 'IPv4 Address' AND bad AS is_private_ip, md5(term) AS md5, sha1(term) AS sha1, sha256(term) AS sha256, domain_entropy, coalesce(n, 0) AS matches_count, coalesce(ids, '') AS scan_ids, CASE WHEN n > 0 THEN 85 ELSE 0 END AS reputation_score,
 CASE WHEN n > 0 THEN 'Threat Record Found' ELSE 'Clean / No Threats Recorded' END AS verdict FROM tk LEFT JOIN mc USING (term)""")

S["p07_index_search"] = S["p07_indicator_search"]

# ---- graph and response --------------------------------------------------------------------
def graph(src: str) -> str:
    h = "split_part(replace(replace(u, 'http://', ''), 'https://', ''), '/', 1)"
    return f"""
gn0 AS (SELECT scan_id, scan_time, 0 AS pos, 'email' AS node_group, 'email_' || scan_id AS node_id, CASE WHEN subject IS NULL THEN 'Email #' || scan_id ELSE subject END AS label, verdict AS risk, NULL AS edge FROM {src}
 UNION ALL SELECT scan_id, scan_time, 1, 'domain', 'domain_' || lower(split_part(sender, '@', -1)), split_part(sender, '@', -1), verdict, 'SENT_BY' FROM {src}
 UNION ALL SELECT scan_id, scan_time, 2, 'recipient', 'recip_' || lower(receiver), receiver, 'Safe', 'TARGETS' FROM {src}
 UNION ALL SELECT scan_id, scan_time, 2 + i, 'url', 'url_' || lower({h}), {h}, CASE WHEN verdict = 'High Risk' THEN verdict ELSE 'Medium Risk' END, 'CONTAINS_LINK' FROM (SELECT scan_id, scan_time, verdict, unnest(string_split(urls_text, ';')) AS u, unnest(range(1, len(string_split(urls_text, ';')) + 1)) AS i FROM {src} WHERE urls_text <> '')),
gn AS (SELECT node_id, node_group, label, risk, count(DISTINCT scan_id) OVER (PARTITION BY node_id) AS emails FROM gn0 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY scan_time DESC, scan_id DESC, pos) = 1),
gx AS (SELECT DISTINCT 'email_' || scan_id AS src, node_id AS dst, edge AS label FROM gn0 WHERE edge IS NOT NULL)"""


S["c01_threat_graph"] = stmt(SC, graph("sc"), final="SELECT node_id, node_group, label, risk, emails FROM gn")
S["w09_first_seen_nodes"] = stmt(SC, graph("sc"), final="SELECT node_id, label, risk FROM gn")
S["u04_graph_edges"] = stmt(SC, graph("sc"), final="SELECT src, dst, label FROM gx")
S["a20_graph_summary"] = stmt(SC, graph("sc"), final="SELECT (SELECT count(*) FROM gn WHERE node_group = 'email') AS total_emails, (SELECT count(*) FROM gn) AS total_nodes, (SELECT count(*) FROM gx) AS total_edges, (SELECT count(*) FROM gn WHERE risk = 'High Risk') AS high_risk_nodes")
S["t06_capped_graph"] = stmt(SC, "s50 AS (SELECT * FROM sc ORDER BY scan_time DESC, scan_id DESC LIMIT 50)", graph("s50"), "k AS (SELECT * FROM gn ORDER BY node_group, node_id LIMIT 200)",
    final="SELECT label, count(*) AS edges, 'edge' AS kind FROM gx WHERE src IN (SELECT node_id FROM k) AND dst IN (SELECT node_id FROM k) GROUP BY label UNION ALL SELECT node_group, count(*), 'node' FROM k GROUP BY node_group")
S["c02_campaigns"] = stmt(SC, graph("sc"), final="""SELECT node_id, node_group, count(DISTINCT scan_id) AS emails, max(risk_score) AS max_risk, count(*) FILTER (verdict = 'High Risk') AS high_risk_mentions FROM gn0 JOIN sc USING (scan_id) WHERE edge IS NOT NULL GROUP BY ALL HAVING count(DISTINCT scan_id) > 1""")
S["c02_campaign_components"] = stmt(SC, f"sb AS (SELECT * FROM sc)", graph("sb"), """cn AS (SELECT scan_id, 'x' || node_id AS node FROM gn0 WHERE node_group = 'domain' UNION SELECT scan_id, 'xurl_' || lower(split_part(replace(replace(u, 'http://', ''), 'https://', ''), '/', 1)) FROM (SELECT scan_id, unnest(string_split(urls_text, ';')) AS u FROM sb WHERE urls_text <> '')),
 r1 AS (SELECT scan_id, min(m) AS c FROM cn JOIN (SELECT node, min(scan_id) AS m FROM cn GROUP BY node) USING (node) GROUP BY scan_id)""" + "".join(
    f", r{i + 1} AS (SELECT scan_id, min(m) AS c FROM cn JOIN (SELECT node, min(c) AS m FROM cn JOIN r{i} USING (scan_id) GROUP BY node) USING (node) GROUP BY scan_id)" for i in range(1, 12)), final="SELECT scan_id, c AS component FROM r12")
S["c02_campaign_batches"] = S["c02_campaign_components"]
_act = {p[0]: p[4] for p in R.PLAYBOOKS}
_pb = """list_filter([CASE WHEN risk_score >= 50 OR verdict = 'High Risk' THEN 'PB-101' END, CASE WHEN regexp_matches(categories_text, 'Credential|Password|URL') OR contains(findings_text, 'Display Name Email Spoofing') THEN 'PB-102' END, CASE WHEN regexp_matches(categories_text, 'Invoice|BEC|Financial') THEN 'PB-103' END], lambda x: x IS NOT NULL)"""
S["c03_playbooks"] = stmt(SC, f"p0 AS (SELECT scan_id, {_pb} AS l FROM sc)", "p1 AS (SELECT scan_id, CASE WHEN len(l) = 0 THEN ['PB-100'] ELSE l END AS l FROM p0)",
    final="SELECT scan_id, array_to_string(l, '|') AS playbook_ids, array_to_string(list_transform(l, lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN {q('|'.join(a))}" for k, a in _act.items()) + " END), '|') AS actions FROM p1")
S["c04_fleet_blocklist"] = stmt(SC, final="SELECT ioc_value, count(*) AS sightings FROM (SELECT lower(split_part(sender, '@', -1)) AS own, unnest(string_split(iocs_text, ';')) AS ioc_value FROM sc WHERE risk_score >= 50 AND iocs_text <> '') WHERE ioc_value <> own GROUP BY ioc_value")
S["u03_blocklist_difference"] = stmt(SC, "b AS (SELECT scan_id, urls_text, lower(split_part(sender, '@', -1)) AS own, list_filter(string_split(iocs_text, ';'), lambda x: x <> '') AS l FROM sc)",
    final="SELECT scan_id, array_to_string(list_sort(list_filter(l, lambda x: NOT regexp_full_match(x, '[0-9.]+') AND x <> own)), '|') AS domains, array_to_string(list_sort(list_filter(l, lambda x: regexp_full_match(x, '[0-9.]+'))), '|') AS ips, replace(urls_text, ';', '|') AS urls FROM b")
