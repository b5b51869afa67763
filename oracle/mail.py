"""Ingest, header, routing and text statements."""

from __future__ import annotations

from mailsleuth.functions import rules as R

from . import parts as P
from .parts import AU, HDR, HV, MSG, SID, inlist, lst, q, stmt, view

MAIL: dict[str, str] = {}
S = MAIL

S["s01_mail_listing"] = stmt(MSG, final="""SELECT message_id || CASE WHEN doc_id % 10 = 1 THEN '.EML' ELSE '.eml' END AS file_name, strlen(text_body) AS length FROM msg WHERE doc_id % 10 <> 0""")
S["s02_header_table"] = stmt(MSG, HDR, final="SELECT message_id, pos, name, value FROM hdr")
S["s02_header_map"] = stmt(MSG, HDR, final="""SELECT message_id, count(DISTINCT lower(name)) AS names, coalesce(string_agg(value, '|' ORDER BY pos) FILTER (lower(name) = 'subject'), '') AS subjects,
 coalesce(string_agg(value, '|' ORDER BY pos) FILTER (lower(name) = 'received'), '') AS received,
 coalesce(nullif(regexp_replace(coalesce(min_by(value, pos) FILTER (lower(name) = 'message-id'), ''), '^[<> ]+|[<> ]+$', '', 'g'), ''), 'fallback-' || message_id) AS effective_id FROM hdr GROUP BY message_id""")
S["s03_mime_bodies"] = stmt(MSG, final="""SELECT message_id, md5(text_body) AS text_md5, html_body, TRUE AS has_plain_text, html_body <> '' AS has_html,
 cast(CASE WHEN attachment_names = '' THEN 0 ELSE len(string_split(attachment_names, ';')) END AS bigint) AS attachments,
 CASE WHEN attachment_names = '' THEN '' ELSE array_to_string(list_transform(string_split(attachment_names, ';'), lambda n: n || '=bytes of ' || n), '|') END AS payloads FROM msg""")
S["s04_recipients"] = stmt(MSG, HDR, final="""SELECT message_id, kind, i - 1 AS pos, a[i] AS address FROM (SELECT message_id, kind, a, unnest(range(1, len(a) + 1)) AS i FROM (
 SELECT message_id, name AS kind, list_filter(list_transform(string_split(value, ','), lambda x: trim(x)), lambda x: x <> '') AS a FROM hdr WHERE name IN ('To', 'Cc', 'Bcc')))""")


def safe_name(n: str, fallback: str) -> str:
    base = f"regexp_extract(coalesce({n}, ''), '([^/\\\\]*)$', 1)"
    t = f"regexp_replace(replace(regexp_replace({base}, '[\\x00-\\x1f\\x7f<>:\"/\\\\|?*]', '_', 'g'), '..', '_'), '^[. ]+|[. ]+$', '', 'g')"
    return f"CASE WHEN {t} = '' THEN {fallback} ELSE {t} END"


def ext(n: str) -> str:
    return f"lower(regexp_extract({n}, '^.+([.][^.]*)$', 1))"


def dangerous(s: str, o: str) -> str:
    return f"({ext(s)} IN {inlist(R.GATEWAY_DANGEROUS)} OR {ext(o)} IN {inlist(R.GATEWAY_DANGEROUS)})"


def doubled(s: str) -> str:
    return f"(len(string_split({s}, '.')) > 2 AND list_contains({lst(R.DOUBLE_EXT_INNER)}, lower(string_split({s}, '.')[-2])))"


S["s05_attachment_catalogue"] = stmt(view("attachment_payloads", "ap"), "named AS (SELECT *, sha256(payload) AS sha, 'attachment_' || cast(pos + 1 AS varchar) || '.bin' AS fb, CASE WHEN original_filename = '' THEN 'attachment_' || cast(pos + 1 AS varchar) || '.bin' ELSE original_filename END AS nm FROM ap)",
    final=f"SELECT message_id, sha AS sha256, pos, strlen(payload) AS size_bytes, mime_type, nm AS original_filename, {safe_name('nm', 'fb')} AS filename FROM named QUALIFY row_number() OVER (PARTITION BY message_id, sha ORDER BY pos) = 1")

_SCAN, _USER = view("scans", "sc"), view("users", "us")
S["s07_backfill_scans"] = stmt(_SCAN, view("legacy_scans", "ls"), f"k AS (SELECT ls.*, least(100, greatest(0, coalesce(try_cast(risk_score AS int), 0))) AS rs FROM ls WHERE id NOT IN (SELECT scan_id FROM sc WHERE verdict = 'High Risk'))",
    final=f"""SELECT id, user_id, subject, cast(rs AS bigint) AS risk_score, CASE WHEN verdict IN {inlist(R.VERDICTS)} THEN verdict WHEN rs >= 50 THEN 'High Risk' WHEN rs >= 20 THEN 'Medium Risk' ELSE 'Low Risk' END AS verdict,
 CASE WHEN json_valid(categories_json) THEN array_to_string(cast(categories_json AS json)::varchar[], '|') ELSE '' END AS categories,
 cast(epoch(CASE WHEN scan_time_text LIKE '%Z' THEN strptime(replace(scan_time_text, 'Z', ''), '%Y-%m-%dT%H:%M:%S') WHEN scan_time_text LIKE '%+%' THEN strptime(split_part(scan_time_text, '+', 1), '%Y-%m-%d %H:%M:%S') - cast(split_part(split_part(scan_time_text, '+', 2), ':', 1) AS int) * interval 1 hour ELSE strptime(scan_time_text, '%Y-%m-%d %H:%M:%S') END) AS bigint) AS scan_epoch FROM k""")
S["s07_backfill_counts"] = stmt(_SCAN, _USER, view("legacy_scans", "ls"), final="""SELECT 'users' AS table_name, count(*) AS copied, count(*) FILTER (user_id % 11 = 0 OR role NOT IN ('admin', 'analyst')) AS fixed FROM us WHERE role <> 'admin'
 UNION ALL SELECT 'scans', count(*), count(*) FILTER (json_valid(categories_json)) FROM ls WHERE id NOT IN (SELECT scan_id FROM sc WHERE verdict = 'High Risk')""")
S["s08_schema_evolution"] = stmt(_SCAN, final="SELECT scan_id, risk_score, CASE WHEN scan_id % 2 = 0 THEN 'Low Risk' ELSE verdict END AS verdict, CASE WHEN scan_id % 2 = 0 THEN '' ELSE reply_to END AS reply_to, 'NEW' AS status, cast(0 AS bigint) AS retry_count FROM sc")
S["s09_history_csv"] = stmt(_SCAN, _USER, final="""SELECT scan_id AS "Scan ID", strftime(scan_time, '%Y-%m-%dT%H:%M:%S') AS "Scanned at", coalesce(username, 'Public visitor') AS "Submitted by", sender AS "Sender", receiver AS "Recipient", subject AS "Subject",
 risk_score AS "Score", verdict AS "Verdict", replace(categories_text, ';', '; ') AS "Categories", replace(urls_text, ';', '; ') AS "URLs" FROM sc LEFT JOIN us USING (user_id)""")
_jl = lambda c: f"CASE WHEN {c} = '' THEN '[]' ELSE '[\"' || replace({c}, ';', '\",\"') || '\"]' END"
S["s10_report_json"] = stmt(_SCAN, final=f"""SELECT scan_id, '{{"scan_id":' || cast(scan_id AS varchar) || ',"scanned_at":"' || strftime(scan_time, '%Y-%m-%dT%H:%M:%S') || '","email":{{"from":"' || sender || '","to":"' || receiver || '","subject":"' || coalesce(subject, '(no subject)')
 || '","reply_to":"' || reply_to || '","urls":' || {_jl('urls_text')} || '}},"analysis":{{"score":' || cast(risk_score AS varchar) || ',"verdict":"' || verdict || '","findings":' || {_jl('findings_text')} || ',"categories":' || {_jl('categories_text')} || '}}}}' AS report FROM sc""")
S["s11_network_ranges"] = """WITH n AS (SELECT s_suppkey, 8 + s_suppkey % 25 AS bits, 10 * 16777216 + (s_suppkey % 256) * 65536 + (s_suppkey * 7 % 256) * 256 + 9 AS a FROM supplier)
SELECT s_suppkey, '10.' || cast(s_suppkey % 256 AS varchar) || '.' || cast(s_suppkey * 7 % 256 AS varchar) || '.9/' || cast(bits AS varchar) AS network,
 cast(floor(a / cast(pow(2, 32 - bits) AS bigint)) AS bigint) * cast(pow(2, 32 - bits) AS bigint) AS start_ip, (cast(floor(a / cast(pow(2, 32 - bits) AS bigint)) AS bigint) + 1) * cast(pow(2, 32 - bits) AS bigint) - 1 AS end_ip FROM n"""
_rule = "'MailSleuth_Phish_' || trim(regexp_replace(coalesce(subject, 'Phishing Email Indicator'), '[^a-zA-Z0-9_]', '_', 'g'), '_')"
S["s12_detection_rules"] = stmt(_SCAN, f"""s AS (SELECT *, {_rule} AS rule_name, coalesce(subject, 'Phishing Email Indicator') AS sub, list_concat(list_concat([['subj', coalesce(subject, 'Phishing Email Indicator')], ['from', sender]],
   CASE WHEN urls_text = '' THEN [] ELSE list_transform(string_split(urls_text, ';'), lambda u: ['url', u]) END),
   CASE WHEN findings_text = '' THEN [] ELSE list_transform(string_split(findings_text, ';'), lambda f: ['finding', trim(regexp_replace(f, '[^a-zA-Z0-9\\s]', '', 'g'))]) END) AS ks FROM sc WHERE risk_score >= 50)""",
    final="""SELECT scan_id, rule_name, 'rule ' || rule_name || ' {' || chr(10) || '    meta:' || chr(10) || '        description = "Detection rule derived from a scanned e-mail"' || chr(10) || '        author = "mailsleuth"' || chr(10) || '        severity = "' || verdict || '"' || chr(10)
 || '        score = ' || cast(risk_score AS varchar) || chr(10) || chr(10) || '    strings:' || chr(10) || array_to_string(list_transform(ks, lambda k, i: '        $' || k[1] || '_' || cast(i AS varchar) || ' = "' || k[2] || '" nocase'), chr(10)) || chr(10) || chr(10)
 || '    condition:' || chr(10) || '        any of them' || chr(10) || '}' || chr(10) AS yara,
 'title: Phishing Email Indicator - ' || regexp_replace(sub, '[^a-zA-Z0-9\\s_-]', '', 'g') || chr(10) || 'id: ' || left(sha256(sub), 32) || chr(10) || 'status: experimental' || chr(10) || 'author: mailsleuth' || chr(10) || 'tags:' || chr(10) || '    - attack.initial_access' || chr(10)
 || '    - attack.t1566.001' || chr(10) || 'logsource:' || chr(10) || '    category: email' || chr(10) || '    product: m365' || chr(10) || 'detection:' || chr(10) || '    selection_subject:' || chr(10) || '        EmailSubject|contains: "' || sub || '"' || chr(10)
 || '    selection_sender:' || chr(10) || '        SenderAddress|contains: "' || sender || '"' || chr(10) || '    condition: selection_subject or selection_sender' || chr(10) || 'level: high' || chr(10) AS sigma FROM s""".replace("\\\\s", "\\s"))

# ---- envelope and size gates ---------------------------------------------------------------
_adr = r"<?[a-zA-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?([.][a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*>?"
S["p09_envelope_gate"] = stmt(*HV, "e AS (SELECT message_id, unnest([from_addr, return_path, from_hdr, '<>']) AS address FROM hv)",
    final=f"SELECT message_id, address, address <> '' AND (trim(address) IN ('<>', '') OR (length(regexp_replace(trim(address), '^<(.*)>$', '\\1')) BETWEEN 1 AND 254 AND regexp_full_match(regexp_replace(trim(address), '^<(.*)>$', '\\1'), '{_adr}'))) AS accepted FROM e")
S["p10_message_gate"] = stmt(MSG, "z AS (SELECT message_id, strlen(text_body) * CASE WHEN doc_id % 20 = 0 THEN 0 WHEN doc_id % 20 = 1 THEN 100000 ELSE 1 END AS size_bytes FROM msg)",
    final="SELECT message_id, size_bytes, CASE WHEN size_bytes > 10485760 THEN '552 5.3.4 Message size exceeds fixed limit' WHEN size_bytes = 0 THEN '550 5.6.0 Empty message payload' END AS gate FROM z")

# ---- header rules --------------------------------------------------------------------------
S["f20_authentication"] = stmt(*AU, final="""SELECT message_id, spf, dkim, dmarc, arc, spf_risk, dkim_risk, dmarc_risk, arc_risk, spf_reason, spf_domain, dkim_domain, dmarc_policy,
 greatest(0, 100 - spf_risk - dkim_risk - dmarc_risk - arc_risk) AS auth_score, spf = 'PASS' OR dkim = 'PASS' AS is_authenticated FROM au""")
S["f21_sender_identity"] = stmt(*SID, final="SELECT message_id, from_name, from_addr, from_domain, reply_addr, return_addr, reply_mismatch, return_mismatch, name_holds_address, claimed_brand, spoofing_score, greatest(0, 100 - spoofing_score) AS sender_trust_score FROM sid")

MID_DOMAIN = "lower(regexp_extract(mid_hdr, '<([^@>]+)@([^>]+)>', 2))"
_apart = "(md <> '' AND from_domain <> '' AND md <> from_domain AND NOT ends_with(from_domain, '.' || md) AND NOT ends_with(md, '.' || from_domain))"
INTEGRITY = f"""
ig AS (SELECT *, {MID_DOMAIN} AS md FROM au),
igf AS (SELECT message_id, unnest(list_filter([
  {{'o': 300, 'f': CASE WHEN mid_hdr = '' THEN 'Missing Message-ID Header' END, 's': 'Medium'}}, {{'o': 301, 'f': CASE WHEN mid_hdr <> '' AND md = '' THEN 'Malformed Message-ID Syntax' END, 's': 'Medium'}},
  {{'o': 302, 'f': CASE WHEN {_apart} THEN 'Message-ID Domain Mismatch' END, 's': 'Low'}}, {{'o': 303, 'f': CASE WHEN from_hdr = '' THEN 'Missing Mandatory Header: From' END, 's': 'High'}},
  {{'o': 304, 'f': CASE WHEN date_hdr = '' THEN 'Missing Mandatory Header: Date' END, 's': 'High'}}, {{'o': 305, 'f': CASE WHEN n_from > 1 THEN 'Duplicate Header Detected: From' END, 's': 'High'}},
  {{'o': 306, 'f': CASE WHEN n_subject > 1 THEN 'Duplicate Header Detected: Subject' END, 's': 'High'}}, {{'o': 307, 'f': CASE WHEN n_date > 1 THEN 'Duplicate Header Detected: Date' END, 's': 'High'}},
  {{'o': 308, 'f': CASE WHEN n_mid > 1 THEN 'Duplicate Header Detected: Message-ID' END, 's': 'High'}}], lambda x: x.f IS NOT NULL)) AS x FROM ig)"""
INTEGRITY_SCORE = "greatest(0, 100 - (CASE WHEN mid_hdr = '' THEN 20 WHEN md = '' THEN 15 ELSE 0 END) - (CASE WHEN from_hdr = '' THEN 20 ELSE 0 END) - (CASE WHEN date_hdr = '' THEN 20 ELSE 0 END) - 25 * (cast(n_from > 1 AS int) + cast(n_subject > 1 AS int) + cast(n_date > 1 AS int) + cast(n_mid > 1 AS int)))"
S["f22_header_integrity"] = stmt(*AU, INTEGRITY, final=f"SELECT ig.message_id, md AS mid_domain, {INTEGRITY_SCORE} AS integrity_score, coalesce((SELECT string_agg(x.f, '|' ORDER BY x.o) FROM igf WHERE igf.message_id = ig.message_id), '') AS findings FROM ig")
CLIENT = "CASE " + " ".join(f"WHEN regexp_matches(x_mailer || ' ' || user_agent, '(?i){p}') THEN '{n}'" for n, p in R.MAIL_CLIENTS) + " ELSE 'Unknown' END"
S["f23_mail_clients"] = stmt(*HV, final=f"SELECT message_id, {CLIENT} AS client, regexp_replace(x_ip, '[\\[\\]\\s]', '', 'g') AS originating_ip FROM hv")
S["w08_first_rule_wins"] = stmt(*HV, final=f"SELECT message_id, {CLIENT} AS client, {P.suffix('lower(split_part(from_hdr, chr(64), -1))', R.GATEWAY_TLDS)} AS tld FROM hv")

# ---- received lines ------------------------------------------------------------------------
RECV = """
rc0 AS (SELECT message_id, value, row_number() OVER (PARTITION BY message_id ORDER BY pos DESC) AS seq FROM hdr WHERE lower(name) = 'received'),
rc AS (SELECT message_id, seq, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS t FROM rc0)"""
_ipx = r"\[(?:IPv6:)?([a-fA-F0-9:\.]+)\]|\b(?:\d{1,3}\.){3}\d{1,3}\b"
TIMELINE = f"""{RECV},
tl0 AS (SELECT *, CASE WHEN contains(t, ';') THEN trim(regexp_extract(t, '^(.*);', 1)) ELSE t END AS c, CASE WHEN contains(t, ';') THEN trim(split_part(t, ';', -1)) ELSE '' END AS timestamp_raw FROM rc),
tl1 AS (SELECT *, regexp_extract(c, '(?i)\\bfrom\\s+([^\\s()]+)', 1) AS from_host, regexp_extract(c, '(?i)\\bby\\s+([^\\s()]+)', 1) AS by_host, coalesce(nullif(regexp_extract(c, '{_ipx}', 1), ''), regexp_extract(c, '{_ipx}', 0)) AS from_ip,
  upper(regexp_extract(c, '(?i)\\bwith\\s+([A-Za-z0-9_-]+)', 1)) AS protocol, regexp_extract(c, '(?i)\\b(using\\s+TLS[^\\s;()]+|tls\\s+[^\\s;()]+|dkim=[^\\s;()]+|spf=[^\\s;()]+)', 0) AS auth_info, {P.epoch('timestamp_raw')} AS hop_epoch FROM tl0),
{P.ip_steps('tl1', P.IP_CLEAN('from_ip'), 'tl2').strip()},
tl AS (SELECT *, {P.TIMELINE_CLASS} AS ip_type, {P.TIMELINE_INTERNAL} AS is_internal FROM tl2)"""
_obs = """[CASE WHEN from_host = '' THEN 'Missing sender hostname' END, CASE WHEN is_internal THEN 'Private IP relay' END, CASE WHEN ip_type = 'IPv6' THEN 'IPv6 relay' END,
 CASE WHEN lower(from_host) IN ('', 'unknown', 'localhost') THEN 'Unknown hostname' END, CASE WHEN timestamp_raw = '' THEN 'Missing timestamp' END]"""
S["f24_hop_fields"] = stmt(MSG, HDR, TIMELINE, final=f"""SELECT message_id, seq, from_host, by_host, from_ip, protocol, auth_info, timestamp_raw, ip_type, is_internal,
 CASE WHEN is_internal THEN 'Internal Relay' WHEN from_ip <> '' THEN 'External Relay' ELSE 'Unknown Relay' END AS relay_type, array_to_string(list_filter({_obs}, lambda x: x IS NOT NULL), '|') AS observations FROM tl""")
_ipc = r"\[(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|[a-fA-F0-9:]+)\]|\b(?:\d{1,3}\.){3}\d{1,3}\b"
CHAIN = f"""{RECV},
cf0 AS (SELECT *, coalesce(nullif(regexp_extract(t, '(?i)from\\s+([^\\s]+(?:\\s+\\([^)]+\\))?)', 1), ''), 'Unknown') AS sending_host, coalesce(nullif(regexp_extract(t, '(?i)by\\s+([^\\s]+)', 1), ''), 'Unknown') AS receiving_host,
  coalesce(nullif(regexp_extract(t, '{_ipc}', 1), ''), regexp_extract(t, '{_ipc}', 0)) AS ip, coalesce(nullif(regexp_extract(t, '(?i)with\\s+([^\\s;]+)', 1), ''), 'SMTP') AS chain_protocol,
  contains(lower(t), 'tls') OR contains(lower(t), 'ssl') OR contains(lower(t), 'https') AS tls, {P.epoch("CASE WHEN contains(t, ';') THEN trim(split_part(t, ';', -1)) ELSE '' END")} AS ts FROM rc),
{P.ip_steps('cf0', 'trim(ip)', 'cf1').strip()},
cf AS (SELECT *, {P.HOP_CLASS} AS ip_category, {P.HOP_PRIVATE} AS ip_is_private FROM cf1),
cd AS (SELECT *, ts - last_value(ts IGNORE NULLS) OVER (PARTITION BY message_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS delay FROM cf),
rt AS (SELECT message_id, count(*) AS hops, coalesce(sum(CASE WHEN delay > 0 THEN delay ELSE 0 END), 0) AS transit, count(*) FILTER (ip_is_private) AS privates, count(*) FILTER (delay < -60) AS skews, count(*) FILTER (delay > 86400) AS slows FROM cd GROUP BY message_id)"""
S["f24_chain_fields"] = stmt(MSG, HDR, CHAIN, final="SELECT message_id, seq, sending_host, receiving_host, ip, chain_protocol, tls, ip_category, ip_is_private FROM cf")
S["a04_routing_totals"] = stmt(MSG, HDR, CHAIN, final="""SELECT message_id, coalesce(hops, 0) AS hop_count, cast(coalesce(transit, 0) AS bigint) AS total_transit_seconds, coalesce(privates, 0) AS private_relay_count, coalesce(skews + slows, 0) AS timing_issues,
 greatest(0, 100 - 15 * coalesce(skews + slows, 0) - CASE WHEN hops IS NULL THEN 10 ELSE 0 END) AS infrastructure_trust_score FROM msg LEFT JOIN rt USING (message_id)""")
S["f25_rfc_dates"] = stmt(*HV, "d AS (SELECT message_id, CASE WHEN contains(trim(regexp_replace(value, '\\s+', ' ', 'g')), ';') THEN trim(split_part(regexp_replace(value, '\\s+', ' ', 'g'), ';', -1)) ELSE '' END AS raw FROM hdr WHERE lower(name) = 'received' UNION ALL SELECT message_id, date_hdr FROM hv)",
    final=f"SELECT message_id, raw, {P.epoch('raw')} AS epoch FROM d")


def delay_text(s: str) -> str:
    m, r = f"cast(floor({s} / 60) AS bigint)", f"(cast(floor({s}) AS bigint) % 60)"
    return f"""CASE WHEN {s} IS NULL THEN 'Unknown' WHEN {s} < 0 THEN cast(cast(trunc(abs({s})) AS bigint) AS varchar) || 's (Clock Skew Anomaly)' WHEN {s} < 60 THEN cast(cast(floor({s}) AS bigint) AS varchar) || 's'
 WHEN {m} < 60 AND {r} = 0 THEN cast({m} AS varchar) || 'm' WHEN {m} < 60 THEN cast({m} AS varchar) || 'm ' || cast({r} AS varchar) || 's' ELSE cast({m} // 60 AS varchar) || 'h ' || cast({m} % 60 AS varchar) || 'm' END"""


S["f26_delay_text"] = f"SELECT event_id, seconds, {delay_text('seconds')} AS display FROM (SELECT event_id, cast(event_id * 37 % 200000 - 500 AS double) AS seconds FROM events)"

# hop delays over a table hp(message_id, seq, from_host, from_ip, hop_epoch)
DELAYS = """
dl0 AS (SELECT *, row_number() OVER w AS hop_no, lag(hop_epoch) OVER w AS p_ts, lag(from_ip) OVER w AS p_ip, lag(from_host) OVER w AS p_host,
  last_value(hop_epoch IGNORE NULLS) OVER (PARTITION BY message_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM hp WINDOW w AS (PARTITION BY message_id ORDER BY seq)),
dl AS (SELECT *, CASE WHEN hop_no = 1 THEN 0.0 ELSE cast(hop_epoch - p_ts AS double) END AS delay_seconds, cast(hop_epoch - known AS double) AS known_delay,
  coalesce(from_ip <> '' AND from_ip = p_ip, FALSE) OR coalesce(from_host <> '' AND from_host = p_host AND from_host NOT IN ('unknown', 'localhost'), FALSE) AS is_duplicate FROM dl0)"""
_EV = [view("hops", "hv_ev"), P.ip_steps("(SELECT *, coalesce(from_ip, '') AS fip FROM hv_ev)", "fip", "he").strip(), f"hp AS (SELECT message_id, seq, from_host, fip AS from_ip, hop_epoch, {P.TIMELINE_INTERNAL} AS is_internal FROM he)", DELAYS]
S["w01_hop_numbers"] = stmt(*_EV, final="SELECT message_id, seq, hop_no FROM dl")
S["w02_hop_delays"] = stmt(*_EV, final=f"""SELECT message_id, seq, delay_seconds, CASE WHEN hop_no = 1 THEN '0s (Initial Hop)' ELSE {delay_text('delay_seconds')} END AS delay_display,
 array_to_string(list_filter([CASE WHEN is_duplicate THEN 'Duplicate relay' END, CASE WHEN delay_seconds < 0 THEN 'Timestamp anomaly' END, CASE WHEN delay_seconds < 0 THEN 'Out-of-order timestamps' END, CASE WHEN hop_no > 1 AND delay_seconds IS NULL THEN 'Missing timestamp' END], lambda x: x IS NOT NULL), '|') AS observations FROM dl""")
S["w03_duplicate_relays"] = stmt(*_EV, final="SELECT message_id, seq, is_duplicate FROM dl")
S["w04_known_delays"] = stmt(*_EV, final="SELECT message_id, seq, known_delay, CASE WHEN known_delay < -60 THEN 'Chronological Clock Skew / Out-of-Order Timestamp' WHEN known_delay > 86400 THEN 'Excessive Delivery Transit Delay' END AS timing_finding FROM dl")


def summary(stamp: str) -> str:
    return f"""
sm0 AS (SELECT message_id, count(*) AS total_hops, count(*) FILTER (is_internal) AS internal_hops, max(delay_seconds) FILTER (hop_no > 1) AS max_delay, avg(delay_seconds) FILTER (hop_no > 1) AS avg_delay,
  arg_min_null({stamp}, hop_no) AS a_raw, arg_max_null({stamp}, hop_no) AS z_raw, arg_min_null(hop_epoch, hop_no) AS a_ts, arg_max_null(hop_epoch, hop_no) AS z_ts FROM dl GROUP BY message_id),
sm AS (SELECT message_id, total_hops, internal_hops, total_hops - internal_hops AS external_hops, max_delay, avg_delay, {delay_text('max_delay')} AS max_delay_display, {delay_text('avg_delay')} AS avg_delay_display,
  coalesce(nullif(a_raw, ''), 'Timestamp Unavailable') AS first_received_raw, coalesce(nullif(z_raw, ''), 'Timestamp Unavailable') AS final_delivery_raw,
  CASE WHEN total_hops > 1 THEN {delay_text('cast(z_ts - a_ts AS double)')} ELSE 'Unknown' END AS total_delivery_time FROM sm0)"""


S["a03_delivery_summary"] = stmt(*_EV, summary("cast(hop_epoch AS varchar)"), final="SELECT message_id, total_hops, internal_hops, external_hops, max_delay, round(avg_delay, 4) AS avg_delay, max_delay_display, first_received_raw, final_delivery_raw, total_delivery_time FROM sm")
S["c05_delivery_timeline"] = stmt(MSG, HDR, TIMELINE, "hp AS (SELECT message_id, seq, from_host, from_ip, hop_epoch, is_internal, timestamp_raw FROM tl)", DELAYS, summary("timestamp_raw"),
    final="""SELECT msg.message_id, coalesce(total_hops, 0) AS total_hops, total_hops IS NOT NULL AS has_timeline, CASE WHEN total_hops IS NULL THEN 'No delivery path available.' ELSE 'Reconstructed ' || cast(total_hops AS varchar) || ' mail server relay hops.' END AS summary_message,
 max_delay_display, avg_delay_display, first_received_raw, final_delivery_raw, total_delivery_time FROM msg LEFT JOIN sm USING (message_id)""")

# ---- header score --------------------------------------------------------------------------
HEADER = f"""{INTEGRITY},
{CHAIN},
hs AS (SELECT ig.*, coalesce(hops, 0) AS hops, coalesce(privates, 0) AS privates, coalesce(skews, 0) AS skews, coalesce(slows, 0) AS slows, greatest(0, 100 - spf_risk - dkim_risk - dmarc_risk - arc_risk) AS auth_score,
  greatest(0, 100 - spoofing_score) AS sender_trust_score, greatest(0, 100 - 15 * coalesce(skews + slows, 0) - CASE WHEN hops IS NULL THEN 10 ELSE 0 END) AS infrastructure_trust_score, {INTEGRITY_SCORE} AS integrity_score FROM ig LEFT JOIN rt USING (message_id)),
hf0 AS (SELECT message_id, unnest(list_filter([
  {{'o': 1, 'f': CASE WHEN spf IN ('FAIL', 'PERMERROR', 'SOFTFAIL') THEN 'SPF Authentication Failure (' || spf || ')' END, 's': CASE WHEN spf = 'SOFTFAIL' THEN 'Medium' ELSE 'High' END}},
  {{'o': 2, 'f': CASE WHEN dkim IN ('FAIL', 'PERMERROR') THEN 'DKIM Authentication Failure (' || dkim || ')' END, 's': 'High'}},
  {{'o': 3, 'f': CASE WHEN dmarc IN ('FAIL', 'PERMERROR') THEN 'DMARC Authentication Failure (' || dmarc || ')' END, 's': 'High'}},
  {{'o': 4, 'f': CASE WHEN arc = 'FAIL' THEN 'ARC Authentication Failure (FAIL)' END, 's': 'High'}},
  {{'o': 101, 'f': CASE WHEN reply_mismatch THEN 'Reply-To Mismatch' END, 's': CASE WHEN reply_domain <> from_domain THEN 'High' ELSE 'Medium' END}},
  {{'o': 102, 'f': CASE WHEN return_mismatch THEN 'Return-Path Domain Mismatch' END, 's': 'Medium'}},
  {{'o': 103, 'f': CASE WHEN name_holds_address THEN 'Display Name Email Spoofing' END, 's': 'High'}},
  {{'o': 104, 'f': CASE WHEN claimed_brand IS NOT NULL THEN 'Free Email Brand Impersonation' END, 's': 'Critical'}},
  {{'o': 299, 'f': CASE WHEN privates > 0 THEN 'Internal / Private IP Relay Detected in Path' END, 's': 'Info'}}], lambda x: x.f IS NOT NULL)) AS x FROM hs
  UNION ALL SELECT message_id, {{'o': 200 + i, 'f': 'Chronological Clock Skew / Out-of-Order Timestamp', 's': 'Medium'}} FROM (SELECT message_id, unnest(range(1, skews + 1)) AS i FROM hs)
  UNION ALL SELECT message_id, {{'o': 250 + i, 'f': 'Excessive Delivery Transit Delay', 's': 'Low'}} FROM (SELECT message_id, unnest(range(1, slows + 1)) AS i FROM hs)
  UNION ALL SELECT message_id, x FROM igf),
hf AS (SELECT message_id, x.o AS o, x.f AS finding, x.s AS severity, CASE x.s WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END AS weight FROM hf0)"""
HSCORE = "cast(floor(auth_score * cast(0.35 AS double) + sender_trust_score * cast(0.35 AS double) + infrastructure_trust_score * cast(0.15 AS double) + integrity_score * cast(0.15 AS double)) AS bigint)"
S["a16_header_score"] = stmt(*AU, HEADER, f"z AS (SELECT *, {HSCORE} AS header_security_score FROM hs)", final="""SELECT message_id, auth_score, sender_trust_score, infrastructure_trust_score, integrity_score, header_security_score,
 CASE WHEN header_security_score < 40 THEN 'High Risk / Spoofed' WHEN header_security_score < 75 THEN 'Suspicious' ELSE 'Legitimate' END AS header_verdict, coalesce((SELECT string_agg(finding, '|' ORDER BY weight DESC, o) FROM hf WHERE hf.message_id = z.message_id), '') AS findings FROM z""")
S["t04_severity_ranking"] = stmt(*AU, HEADER, final="SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY weight DESC, o) - 1 AS rank, finding, severity FROM hf")

# ---- texts ---------------------------------------------------------------------------------
S["f01_matching_text"] = stmt("src AS (SELECT doc_id, text FROM documents)", P.norm_steps("src", {"norm": "text"}), final="SELECT doc_id, md5(norm) AS norm_md5, length(norm) AS chars FROM nt")
_BODY = "CASE WHEN text_body <> '' THEN text_body ELSE html_body END"
NORM = P.norm_steps("hv", {"n_sub": "subject", "n_body": _BODY})
_N = "trim(n_sub || ' ' || n_body)"
S["a05_keyword_score"] = stmt(*HV, NORM, f"nn AS (SELECT message_id, {_N} AS norm FROM nt)", final=f"SELECT message_id, {P.keyword_score('norm')} AS keyword_score, array_to_string({P.categories_hit('norm')}, '|') AS categories FROM nn")
_kw = " UNION ALL ".join(f"SELECT message_id, {q(n)} AS category, {w} AS weight, list_filter({lst(kws)}, lambda k, i: contains(norm, {lst(P.matching_phrase(k) for k in kws)}[i])) AS ks FROM nn" for n, w, kws in R.KEYWORD_CATEGORIES)
S["f03_keyword_hits"] = stmt(*HV, NORM, f"nn AS (SELECT message_id, {_N} AS norm FROM nt)", final=f"SELECT message_id, category, weight, array_to_string(ks, '|') AS keywords FROM ({_kw}) WHERE len(ks) > 0")
_pts = ", ".join(f"{e} AS {k}" for k, e in P.lure_points("lt").items())
_tac = "list_filter([" + ", ".join(f"CASE WHEN {k} > 0 THEN {q(t)} END" for k, _, _, t, _ in R.LURES) + "], lambda x: x IS NOT NULL)"
S["a06_lure_score"] = stmt(*HV, "lx AS (SELECT message_id, lower(subject || ' ' || text_body) AS lt FROM hv)", f"ly AS (SELECT *, {_pts} FROM lx)", f"lz AS (SELECT *, {P.lure_score()} AS lure_score FROM ly)",
    final=f"SELECT message_id, authority, urgency, financial, secrecy, lure_score, CASE WHEN trim(lt) = '' THEN 'Minimal' WHEN lure_score >= 70 THEN 'Critical' WHEN lure_score >= 45 THEN 'High' WHEN lure_score >= 20 THEN 'Medium' ELSE 'Low' END AS lure_level, array_to_string({_tac}, '|') AS tactics FROM lz")
S["f05_lure_hits"] = stmt(MSG, "d AS (SELECT doc_id, lower(text) AS t FROM documents UNION ALL SELECT doc_id + 10000000, lower(text_body) FROM msg)",
    final="SELECT doc_id, " + ", ".join(f"len(list_filter({lst(terms)}, lambda w: contains(t, w))) AS {k}" for k, _, _, _, terms in R.LURES) + " FROM d")
CONTENT = f"ct AS (SELECT *, {P.plain_content('subject', 'text_body', 'html_body')} AS ctext FROM hv)"
S["f04_content_patterns"] = stmt(*HV, CONTENT, final=f"SELECT message_id, unnest({P.content_labels('ctext')}) AS label FROM ct")
S["w07_ordered_distinct"] = stmt(MSG, "t AS (SELECT message_id, regexp_split_to_array(lower(text_body), '[^a-z]+') AS ws FROM msg)", "u AS (SELECT message_id, w, min(i) AS i FROM (SELECT message_id, ws, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM t) GROUP BY message_id, w)",
    final="SELECT message_id, md5(string_agg(w, '|' ORDER BY i)) AS words_md5 FROM u GROUP BY message_id")

# ---- indicators ----------------------------------------------------------------------------
_asc = lambda t: f"regexp_replace({t}, '[À-ÖØ-öø-ɏ]', '_', 'g')"
def _rx(p: str) -> str:
    return p.replace("'", "''")
S["f07_indicator_matches"] = stmt(f"d AS (SELECT doc_id, {_asc('text')} AS t FROM documents)", final=f"""SELECT doc_id, array_to_string(regexp_extract_all(t, '{R.RE_IPV4}'), '|') AS ipv4, array_to_string(regexp_extract_all(t, '{R.RE_EMAIL}'), '|') AS emails,
 array_to_string(regexp_extract_all(t, '{R.RE_WALLET}'), '|') AS wallets, len(regexp_extract_all(t, '{R.RE_IPV6}')) AS ipv6 FROM d""")
_URLRE, _HREF = _rx(R.RE_URL_GATEWAY), _rx(R.RE_HREF)


def gateway_urls(text: str, html: str) -> str:
    found = f"list_concat(list_concat(regexp_extract_all({text}, '{_URLRE}'), regexp_extract_all({html}, '{_HREF}', 1)), regexp_extract_all({html}, '{_URLRE}'))"
    return f"""list_filter(list_transform({found}, lambda u: regexp_replace(replace(trim(u), '&amp;', '&'), '[.,;)>''"\\]]+$', '')), lambda u: u <> '')"""


URLS_OF = f"""
gu0 AS (SELECT message_id, {gateway_urls('text_body', 'html_body')} AS us FROM msg),
gu1 AS (SELECT message_id, u AS url, min(i) AS i FROM (SELECT message_id, unnest(us) AS u, unnest(range(1, len(us) + 1)) AS i FROM gu0) GROUP BY message_id, u),
gu AS (SELECT message_id, url, row_number() OVER (PARTITION BY message_id ORDER BY i) - 1 AS pos FROM gu1)"""
S["f06_gateway_urls"] = stmt(MSG, URLS_OF, final="SELECT message_id, pos, url FROM gu")
S["f06_page_urls"] = stmt("""msg AS (SELECT cast(page_id AS varchar) AS message_id, 'see ' || url AS text_body, '<a href="' || url || '&amp;z=1">x</a>' || html AS html_body FROM pages)""", URLS_OF, final="SELECT message_id, pos, url FROM gu")
_set = lambda e: f"array_to_string(list_sort(list_distinct({e})), '|')"
IND = f"""{URLS_OF},
it AS (SELECT message_id, {_asc("raw_headers || chr(10) || text_body || chr(10) || html_body")} AS t FROM msg),
ia AS (SELECT message_id, list_filter(list_concat(regexp_extract_all(t, '{R.RE_IPV4}'), regexp_extract_all(t, '{R.RE_IPV6}')), lambda a: NOT starts_with(a, '127.') AND a <> '0.0.0.0') AS ips,
  list_filter(regexp_extract_all(t, '{R.RE_DOMAIN}'), lambda d: length(d) <= 253 AND NOT ends_with(d, '.local')) AS doms, regexp_extract_all(t, '{R.RE_EMAIL}') AS mails, regexp_extract_all(t, '{R.RE_WALLET}') AS wals FROM it)"""
HASHES = f"""{view("attachment_payloads", "ap")}, hs0 AS (SELECT DISTINCT message_id, sha256(payload) AS h FROM ap), ha AS (SELECT message_id, string_agg(h, '|' ORDER BY h) AS hl FROM hs0 GROUP BY message_id)"""
S["a18_indicator_sets"] = stmt(MSG, IND, HASHES, final=f"""SELECT message_id, coalesce(hl, '') AS hashes, {_set('ips')} AS ip_addresses, {_set('doms')} AS domains, coalesce((SELECT string_agg(url, '|' ORDER BY url) FROM gu WHERE gu.message_id = ia.message_id), '') AS urls,
 {_set('mails')} AS email_addresses, {_set('wals')} AS crypto_wallets FROM ia LEFT JOIN ha USING (message_id)""")
S["a18_indicator_sightings"] = stmt(MSG, IND, HASHES, """il AS (SELECT DISTINCT message_id, 'ip' AS ioc_type, unnest(ips) AS ioc_value FROM ia UNION ALL SELECT DISTINCT message_id, 'domain', unnest(doms) FROM ia UNION ALL SELECT DISTINCT message_id, 'email', unnest(mails) FROM ia
  UNION ALL SELECT DISTINCT message_id, 'wallet', unnest(wals) FROM ia UNION ALL SELECT message_id, 'url', url FROM gu UNION ALL SELECT message_id, 'hash', h FROM hs0 WHERE message_id IN (SELECT message_id FROM msg))""", final="SELECT ioc_type, ioc_value, count(*) AS sightings FROM il GROUP BY ALL")
