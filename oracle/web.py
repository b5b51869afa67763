"""URL, redirect, address and network statements."""

from __future__ import annotations

from mailsleuth.functions import rules as R

from . import parts as P
from .parts import inlist, stmt, view

WEB: dict[str, str] = {}
S = WEB

URLS = view("urls", "uv")
DIST = "du AS (SELECT url, count(*) AS occurrences FROM uv GROUP BY url)"
PARTS = [URLS, DIST, P.url_steps("du")]

# ---- redirect chains -----------------------------------------------------------------------
_full = lambda c: f"CASE WHEN starts_with({c}, 'http://') OR starts_with({c}, 'https://') THEN {c} ELSE 'http://' || {c} END"
_host = lambda c: f"split_part(lower(regexp_extract({_full(c)}, '^[^:/?#]+://([^/?#]*)', 1)), ':', 1)"
CHAIN_A = f"""
ra0 AS (SELECT *, {_host('source_url')} AS sd, {_host('destination_url')} AS dd, lower(destination_url) AS du_l, split_part({_full('source_url')}, '://', 1) AS ss, split_part({_full('destination_url')}, '://', 1) AS ds FROM rh),
{P.ip_steps('ra0', 'dd', 'ra1').strip()},
ra2 AS (SELECT *, {P.IS_IP} AS is_ip, {P.token_brand('dd')} AS brand, {P.suffix('dd', R.UPLOAD_TLDS)} AS rt, first_value(sd) OVER w AS d0, lower(first_value({_full('source_url')}) OVER w) AS u0,
  sd IN {inlist(R.SHORTENERS)} OR dd IN {inlist(R.SHORTENERS)} OR {" OR ".join(f"ends_with(sd, '.{s}') OR ends_with(dd, '.{s}')" for s in R.SHORTENERS)} AS short FROM ra1 WINDOW w AS (PARTITION BY chain_id ORDER BY hop_no)),
ra3 AS (SELECT *, dd = d0 OR EXISTS (SELECT 1 FROM ra2 p WHERE p.chain_id = ra2.chain_id AND p.hop_no < ra2.hop_no AND p.dd = ra2.dd) AS loop_hit,
  du_l = u0 OR EXISTS (SELECT 1 FROM ra2 p WHERE p.chain_id = ra2.chain_id AND p.hop_no < ra2.hop_no AND p.du_l = ra2.du_l) AS url_hit FROM ra2),
ra4 AS (SELECT chain_id, min_by(source_url, hop_no) AS original_url, max_by(destination_url, hop_no) AS final_url, count(*) AS total_hops, bool_or(loop_hit) AS has_loop, bool_or(url_hit) AS url_loop, bool_or(sd <> dd) AS has_cross_domain,
  bool_or(ss = 'http' AND ds = 'https') AS has_upgrade, bool_or(ss = 'https' AND ds = 'http') AS has_downgrade, bool_or(short) AS has_shortener, bool_or(is_ip) AS has_ip_destination, bool_or(rt <> '') AS has_risky_tld,
  min_by(brand, hop_no) FILTER (brand IS NOT NULL) AS brand FROM ra3 GROUP BY chain_id),
ra AS (SELECT *, least(100, 40 * cast(has_loop AS int) + 35 * cast(has_downgrade AS int) + 30 * cast(has_ip_destination AS int) + 25 * cast(has_risky_tld AS int) + 15 * cast(has_shortener AS int) + 10 * cast(has_cross_domain AS int)
  + CASE WHEN total_hops > 3 THEN 15 ELSE 0 END) AS risk_score FROM ra4)"""
RH = view("redirect_hops", "rh")
S["w05_redirect_chains"] = stmt(RH, CHAIN_A, final="SELECT chain_id, original_url, final_url, total_hops, has_loop, url_loop, has_cross_domain, has_upgrade, has_downgrade, has_shortener, has_ip_destination, has_risky_tld, brand, risk_score FROM ra")
_bh = lambda c: f"lower(split_part(regexp_extract({c}, '^[^:/?#]+://([^/?#]*)', 1), ':', 1))"
CHAIN_B = f"""
rb0 AS (SELECT *, {_bh('source_url')} AS sd, lag({_bh('destination_url')}) OVER (PARTITION BY chain_id ORDER BY hop_no) AS pd, row_number() OVER (PARTITION BY chain_id, source_url ORDER BY hop_no) AS nth FROM rh),
rb1 AS (SELECT chain_id, count(*) AS redirect_count, bool_or(nth > 1) AS has_loop, count(*) FILTER (pd <> '' AND sd <> '' AND pd <> sd) AS cross_domain_count, count(*) FILTER (starts_with(source_url, 'https:') AND starts_with(destination_url, 'http:')) AS https_downgrades,
  min_by(source_url, hop_no) AS original_url FROM rb0 GROUP BY chain_id),
rb AS (SELECT *, least(100, 35 * cast(has_loop AS int) + CASE WHEN cross_domain_count > 0 THEN 25 ELSE 0 END + CASE WHEN https_downgrades > 0 THEN 30 ELSE 0 END + CASE WHEN redirect_count >= 3 THEN 20 ELSE 0 END) AS risk_score FROM rb1),
rr AS (SELECT original_url AS url, max(risk_score) AS redirect_risk FROM rb GROUP BY original_url)"""
S["w06_redirect_chains_by_source"] = stmt(RH, CHAIN_B, final="SELECT chain_id, redirect_count, has_loop, cross_domain_count, https_downgrades, original_url, risk_score FROM rb")

# ---- URL parts and rules -------------------------------------------------------------------
S["f08_url_parts"] = stmt(*PARTS, final="""SELECT url, is_valid, scheme, hostname, port, path, params, query, fragment, username, password,
 len(list_distinct(list_transform(list_filter(string_split(query, '&'), lambda p: contains(p, '=') AND length(substr(p, instr(p, '=') + 1)) > 0), lambda p: url_decode(split_part(p, '=', 1))))) AS query_param_count, normalized_url, length(normalized_url) AS url_length FROM up""")
S["f10_registered_domain"] = stmt(*PARTS, final="SELECT url, evaluated_host, root_domain, subdomain FROM up")
S["f09_numeric_hosts"] = stmt("""ev AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS h, event_id % 300 AS m FROM events)""",
    """nu AS (SELECT event_id, 'http://' || CASE WHEN event_id % 3 = 0 THEN '0x' || lower(to_hex(h)) WHEN event_id % 3 = 1 THEN cast((event_id * 2654435761) % 8589934592 AS varchar) ELSE '0' || CASE WHEN m >= 64 THEN cast(m // 64 AS varchar) || cast((m // 8) % 8 AS varchar) || cast(m % 8 AS varchar) WHEN m >= 8 THEN cast(m // 8 AS varchar) || cast(m % 8 AS varchar) ELSE cast(m AS varchar) END || '.1.2.3' END || '/' AS url FROM ev)""",
    P.url_steps("nu"), final="SELECT event_id, hostname, decoded_ip, numeric_ip_type FROM up")
S["f12_entropy"] = stmt(*PARTS, final=f"SELECT url, round({P.entropy('hostname')}, 2) AS host_entropy, round({P.entropy('path')}, 2) AS path_entropy, round({P.entropy('normalized_url')}, 2) AS url_entropy FROM up")
S["f13_query_payloads"] = stmt(*PARTS, final=f"SELECT url, {P.BASE64} AS base64_payload, array_to_string(list_distinct(regexp_extract_all(query, '(?i)(https?%3A%2F%2F[^\\s&]+|https?://[^\\s&]+)')), '|') AS nested_urls FROM up")
HOSTS = [*PARTS, "hosts AS (SELECT DISTINCT hostname FROM up)"]
_reg = " ".join(f"WHEN {P.root('hostname')} NOT IN {inlist(own)} AND (contains(hostname, '{b}') OR contains({P.lookalike_text('hostname')}, '{b}')) THEN '{b.title()}'" for b, own in R.LOOKALIKE_BRANDS)
S["f14_punycode_flag"] = stmt(*HOSTS, final="SELECT hostname, starts_with(hostname, 'xn--') OR contains(hostname, '.xn--') AS is_punycode FROM hosts")
S["f15_lookalike_hosts"] = stmt(*HOSTS, final=f"SELECT hostname, {P.lookalike_text('hostname')} AS plain, {P.lookalike('hostname')} AS brand, CASE WHEN hostname = '' THEN NULL {_reg} END AS brand_registered_mode FROM hosts")
AS = [URLS, DIST, P.host_steps("du", "asx")]
S["f16_token_brands"] = stmt(*AS, final='SELECT url, a_brand AS brand FROM asx')
S["f17_shortener_tld"] = stmt(*PARTS, final=f"""SELECT url, hostname IN {inlist(R.SHORTENERS)} OR root_domain IN {inlist(R.SHORTENERS)} AS gateway_shortener, hostname IN {inlist(R.SHORTENERS)} OR {" OR ".join(f"ends_with(hostname, '.{s}')" for s in R.SHORTENERS)} AS upload_shortener,
 {P.suffix('hostname', R.GATEWAY_TLDS)} AS gateway_tld, {P.suffix('hostname', R.UPLOAD_TLDS)} AS upload_tld FROM up""")
S["f18_url_reasons"] = stmt(*AS, f'rs AS (SELECT url, {P.REASONS} AS r FROM asx)', final="SELECT url, unnest(CASE WHEN len(r) = 0 THEN [NULL] ELSE r END) AS reason FROM rs")
S["f27_url_hashes"] = stmt(URLS, final="SELECT DISTINCT url, md5(url) AS md5, sha1(url) AS sha1, sha256(url) AS sha256 FROM uv")
S["a07_url_risk"] = stmt(RH, CHAIN_B, *PARTS, "upr AS (SELECT up.*, coalesce(redirect_risk, 0) AS redirect_risk FROM up LEFT JOIN rr USING (url))", P.risk_steps("upr", redirect="redirect_risk"),
    final="SELECT url, occurrences, cast(url_risk_score AS bigint) AS url_risk_score, risk_level, array_to_string(url_findings, '|') AS findings FROM ur")
S["a07_host_rollup"] = stmt(*PARTS, P.risk_steps(), final="SELECT hostname, count(*) AS urls, cast(sum(occurrences) AS bigint) AS occurrences, cast(max(url_risk_score) AS bigint) AS max_risk, round(avg(url_risk_score), 4) AS avg_risk FROM ur GROUP BY hostname")
S["j08_score_back"] = stmt(RH, CHAIN_B, *PARTS, "upr AS (SELECT up.*, coalesce(redirect_risk, 0) AS redirect_risk FROM up LEFT JOIN rr USING (url))", P.risk_steps("upr", redirect="redirect_risk"),
    final="SELECT message_id, pos, url, cast(url_risk_score AS bigint) AS url_risk_score, risk_level FROM uv JOIN ur USING (url)")
S["a08_message_url_penalty"] = stmt(*PARTS, P.risk_steps(), final="SELECT message_id, cast(least(45, sum(CASE WHEN url_risk_score >= 50 THEN 25 WHEN url_risk_score >= 25 THEN 10 ELSE 0 END)) AS bigint) AS url_penalty, count(*) AS urls_scored FROM uv JOIN ur USING (url) GROUP BY message_id")
S["t05_first_urls"] = stmt(URLS, final="SELECT message_id, pos, url FROM uv QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY pos) <= 25")
S["p08_fetch_safety"] = stmt(*PARTS, f"""fr AS (SELECT *, lower(regexp_extract(trim(url), '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS ws, {P.RESTRICTED} AS restricted, {P.IS_IP} AS lit FROM up)""",
    f"""fz AS (SELECT url, hostname, CASE WHEN url = '' THEN 'URL is missing or invalid.' WHEN ws NOT IN ('http', 'https') THEN 'Scheme ''' || ws || ''' is prohibited. Only HTTP and HTTPS are permitted.' WHEN hostname = '' THEN 'URL contains no hostname.'
  WHEN hostname IN {inlist(R.BLOCKED_HOSTS)} OR {" OR ".join(f"ends_with(hostname, '{s}')" for s in R.INTERNAL_SUFFIXES)} THEN 'Host ''' || hostname || ''' is an internal domain.' WHEN restricted THEN 'Target IP ' || hostname || ' is a restricted internal or private address.'
  WHEN lit THEN 'Valid public IP target.' END AS fetch_reason FROM fr)""", final="SELECT url, hostname, fetch_reason, fetch_reason IS NULL OR fetch_reason = 'Valid public IP target.' AS fetch_allowed FROM fz")
CF = """cfz AS (SELECT original_url AS url, max(risk_score) AS chain_risk, bool_or(has_loop) AS chain_loop, bool_or(has_downgrade) AS chain_downgrade, bool_or(has_ip_destination) AS chain_ip, bool_or(has_risky_tld) AS chain_tld, bool_or(brand IS NOT NULL) AS chain_brand,
  max_by(final_url, chain_id) AS last_url FROM ra GROUP BY original_url)"""
S["a17_url_verdict"] = stmt(RH, CHAIN_A, CF, *AS, f"""vj AS (SELECT a.*, coalesce(chain_risk, 0) AS chain_risk, coalesce(chain_loop, FALSE) AS chain_loop, coalesce(chain_downgrade, FALSE) AS chain_downgrade, coalesce(chain_ip, FALSE) AS chain_ip, coalesce(chain_tld, FALSE) AS chain_tld,
  coalesce(chain_brand, FALSE) AS chain_brand, coalesce({_host('last_url')}, '') AS last_host FROM asx a LEFT JOIN cfz USING (url))""",
    f"""vk AS (SELECT url, a_ip OR chain_ip AS rule_ip, a_brand IS NOT NULL OR {P.token_brand('last_host')} IS NOT NULL OR chain_brand AS rule_brand, a_tld <> '' OR {P.suffix('last_host', R.UPLOAD_TLDS)} <> '' OR chain_tld AS rule_tld, a_ent > 4.2 AS rule_entropy,
  chain_risk >= 30 OR chain_loop OR chain_downgrade AS rule_redirect, starts_with(a_url, 'https://') AND NOT chain_downgrade AS secure_scheme FROM vj)""",
    "vl AS (SELECT *, cast(rule_ip AS bigint) + cast(rule_brand AS bigint) + cast(rule_tld AS bigint) + cast(rule_entropy AS bigint) + cast(rule_redirect AS bigint) AS suspicious_rules FROM vk)",
    final="SELECT *, CASE WHEN suspicious_rules >= 2 THEN 'High Risk' WHEN suspicious_rules = 1 THEN 'Medium Risk' ELSE 'Low Risk' END AS verdict, CASE WHEN suspicious_rules >= 2 THEN 85 WHEN suspicious_rules = 1 THEN 45 ELSE 5 END AS risk_score FROM vl")

# ---- addresses and networks ----------------------------------------------------------------
IPV = [view("ips", "iv"), P.ip_steps(f"(SELECT *, {P.IP_CLEAN('ip')} AS c FROM iv)", "c", "ix").strip()]
S["f11_ip_classes"] = stmt(*IPV, final=f"""SELECT event_id, c, {P.TIMELINE_CLASS} AS timeline_class, {P.TIMELINE_INTERNAL} AS internal, {P.HOP_CLASS} AS hop_class, {P.HOP_PRIVATE} AS hop_private, {P.GEO_CLASS} AS geo_class, {P.URL_CLASS} AS url_class, {P.RESTRICTED} AS restricted FROM ix""")


def geo(src: str, ip_col: str) -> str:
    """CTEs that compare every public address with every network, digit by digit, and add the geo columns. IPv4 numbers
    are compared without their lower bits; IPv6 keys by whole hex digits and the rest of the next one."""
    digit = lambda k: f"((instr('0123456789abcdef', substr({k}, bits // 4 + 1, 1)) - 1) >> (4 - bits % 4))"
    pick = lambda cols, cond, name: "max_by({" + ", ".join(f"'{c}': {c}" for c in cols) + f"}}, (bits, -rn)) FILTER ({cond}) AS {name}"
    missing = lambda side, cols: ", ".join(f"coalesce({side}.{c}, miss) AS {c}" for c in cols)
    return f"""
na AS (SELECT *, split_part(network, '/', 1) AS base, CASE WHEN contains(network, '/') THEN try_cast(split_part(network, '/', 2) AS int) END AS bits FROM nw),
{P.ip_steps("na", "base", "nb").strip()},
nc AS (SELECT * EXCLUDE (ip_n, ip_k, ip_t), ip_n AS net_n, ip_k AS net_k, row_number() OVER (ORDER BY country, country_code, region, city, asn, organization, network) AS rn FROM nb WHERE bits >= 0 AND ((ip_n IS NOT NULL AND bits <= 32) OR (ip_k IS NOT NULL AND bits <= 128))),
gc AS (SELECT *, {P.GEO_CLASS} AS address_type, CASE WHEN ip_k IS NOT NULL THEN 6 ELSE 4 END AS ip_version, coalesce(cast(ip_n AS varchar), ip_k) AS ip_id FROM {src}),
gp AS (SELECT DISTINCT ip_id, ip_n, ip_k FROM gc WHERE address_type = 'public'),
gl AS (SELECT ip_id, {pick(["country", "country_code", "region", "city", "latitude", "longitude", "timezone", "build_date"], "city <> 'Unknown' OR country <> 'Unknown'", "pl")},
    {pick(["asn", "organization", "network", "build_date"], "asn IS NOT NULL OR organization <> 'Unknown'", "ow")}
  FROM gp JOIN nc ON (gp.ip_n IS NOT NULL AND net_n IS NOT NULL AND (gp.ip_n >> (32 - bits)) = (net_n >> (32 - bits)))
    OR (gp.ip_k IS NOT NULL AND net_k IS NOT NULL AND left(gp.ip_k, bits // 4) = left(net_k, bits // 4) AND (bits % 4 = 0 OR {digit("gp.ip_k")} = {digit("net_k")})) GROUP BY ip_id),
gz AS (SELECT gc.*, CASE WHEN address_type = 'public' THEN 'Unknown' ELSE 'Unavailable' END AS miss, pl, ow FROM gc LEFT JOIN gl ON gl.ip_id = gc.ip_id AND gc.address_type = 'public'),
ge AS (SELECT *, {missing("pl", ["country", "country_code", "region", "city", "timezone"])}, pl.latitude AS latitude, pl.longitude AS longitude, cast(ow.asn AS bigint) AS asn, {missing("ow", ["organization", "network"])},
  coalesce(pl.build_date, ow.build_date) AS build_date, CASE WHEN pl IS NOT NULL OR ow IS NOT NULL THEN 'table' ELSE 'none' END AS source, CASE WHEN pl IS NOT NULL OR ow IS NOT NULL THEN 'ok' ELSE 'unavailable' END AS status,
  CASE WHEN pl IS NOT NULL AND ow IS NOT NULL THEN 'network table (City + ASN)' WHEN pl IS NOT NULL THEN 'network table City' WHEN ow IS NOT NULL THEN 'network table ASN' WHEN coalesce({ip_col}, '') = '' OR address_type = 'public' THEN 'None' ELSE 'None (Non-Public IP)' END AS provider_used FROM gz)"""


_flag = "CASE code " + " ".join(f"WHEN '{c}' THEN '{f}'" for c, f in R.COUNTRY_FLAGS.items()) + " ELSE CASE WHEN pub THEN '🌐' ELSE '🏠' END END"
LABEL = f"""
lb0 AS (SELECT *, address_type = 'public' AS pub, CASE WHEN country_code NOT IN ('Unknown', 'Unavailable') THEN country_code WHEN address_type = 'public' THEN 'US' ELSE 'LOCAL' END AS code FROM ge),
lb AS (SELECT *, CASE WHEN NOT pub THEN '🏠 Private Subnet (' || CASE address_type WHEN 'link-local' THEN 'Link-Local' ELSE upper(left(address_type, 1)) || substr(address_type, 2) END || ')'
  WHEN city <> 'Unknown' AND country <> 'Unknown' THEN {_flag} || ' ' || city || ', ' || country || ' (' || replace(organization, 'Unknown', 'Internet Service Provider') || ')'
  ELSE {_flag} || ' Public Internet IP Node (' || replace(organization, 'Unknown', 'Internet Service Provider') || ')' END AS location_display FROM lb0)"""
NW = view("networks", "nw")
S["j05_network_lookup"] = stmt(*IPV, NW, geo("ix", "ip"), final="SELECT event_id, c AS clean_ip, address_type, ip_version, country, country_code, region, city, latitude, longitude, timezone, asn, organization, network, build_date, source, status, provider_used FROM ge")
S["f31_location_labels"] = stmt(*IPV, NW, geo("ix", "ip"), LABEL, final=f"""SELECT event_id, c AS clean_ip, location_display, CASE WHEN NOT pub THEN 'Local / Internal Network' WHEN city <> 'Unknown' THEN city ELSE 'Public Gateway Node' END AS display_city,
 CASE WHEN NOT pub THEN 'Private Subnet' WHEN country <> 'Unknown' THEN country ELSE 'Public Internet' END AS display_country, code AS display_code, CASE WHEN NOT pub THEN 'Intranet' WHEN region <> 'Unknown' THEN region ELSE 'Global Subnet' END AS display_region,
 CASE WHEN NOT pub THEN 'Private Subnet' WHEN organization <> 'Unknown' THEN organization ELSE 'Internet Service Provider' END AS display_owner, {_flag} AS flag FROM lb""")
from .mail import IND  # noqa: E402

S["c07_geo_context"] = stmt(P.MSG, IND, "ci AS (SELECT message_id, list_sort(list_distinct(ips)) AS l FROM ia)", "cj AS (SELECT message_id, i - 1 AS pos, l[i] AS ip FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM ci))",
    P.ip_steps("cj", P.IP_CLEAN("ip"), "ix"), NW, geo("ix", "ip"), LABEL, final="""SELECT message_id, pos, ip, address_type, ip_version, CASE WHEN NOT pub THEN 'Local / Internal Network' WHEN city <> 'Unknown' THEN city ELSE 'Public Gateway Node' END AS display_city,
 CASE WHEN NOT pub THEN 'Intranet' WHEN region <> 'Unknown' THEN region ELSE 'Global Subnet' END AS display_region, CASE WHEN NOT pub THEN 'Private Subnet' WHEN country <> 'Unknown' THEN country ELSE 'Public Internet' END AS display_country, timezone, network, location_display FROM lb""")
