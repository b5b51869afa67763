"""DuckDB fragments shared by the oracle statements: views, header rows, address and URL steps."""

from __future__ import annotations

import ipaddress

from mailsleuth.functions import rules as R
from mailsleuth.plans.fixtures import view_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def inlist(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def matching_phrase(phrase: str) -> str:
    """A rule phrase as the texts are compared: look-alike digits as letters, signs as blanks, single letters that
    stand in a row joined to one word."""
    letters = dict(zip(R.LEET_FROM, R.LEET_TO, strict=True))
    plain = "".join(letters.get(c, c) for c in phrase.lower())
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in plain).split()
    out: list[str] = []
    for i, w in enumerate(words):
        join = i > 0 and len(w) == 1 and len(words[i - 1]) == 1
        out = [*out[:-1], out[-1] + w] if join else [*out, w]
    return " ".join(out)


def view(name: str, alias: str | None = None) -> str:
    return f"{alias or name + '_v'} AS ({view_sql(name)})"


def stmt(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + final


# ---- header rows ---------------------------------------------------------------------------

HDR = r"""
lines AS (SELECT message_id, list_filter(regexp_split_to_array(regexp_replace(raw_headers, '\r?\n[ \t]+', ' ', 'g'), '\r?\n'), lambda l: regexp_matches(l, '^[!-9;-~]+:')) AS ls FROM msg),
hdr AS (SELECT message_id, i - 1 AS pos, split_part(ls[i], ':', 1) AS name, trim(substr(ls[i], instr(ls[i], ':') + 1)) AS value
        FROM (SELECT message_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines))"""


def _first(name: str, out: str) -> str:
    return f"coalesce(min_by(value, pos) FILTER (lower(name) = '{name}'), '') AS {out}"


def addr(v: str) -> str:
    return f"CASE WHEN contains({v}, '<') THEN trim(regexp_extract({v}, '<([^>]*)>?[^<]*$', 1)) ELSE trim({v}) END"


def dom(a: str) -> str:
    return f"CASE WHEN contains({a}, '@') THEN lower(split_part({a}, '@', -1)) ELSE '' END"


_HV = f"""
hv0 AS (SELECT message_id, {_first('from', 'from_hdr')}, {_first('reply-to', 'reply_to')}, {_first('return-path', 'return_path')}, {_first('subject', 'subject')},
  {_first('date', 'date_hdr')}, {_first('message-id', 'mid_hdr')}, {_first('authentication-results', 'auth_first')}, {_first('dkim-signature', 'sig')},
  {_first('arc-seal', 'arc_seal')}, {_first('received-spf', 'rspf')}, {_first('x-mailer', 'x_mailer')}, {_first('user-agent', 'user_agent')}, {_first('x-originating-ip', 'x_ip')},
  coalesce(string_agg(value, ' ; ' ORDER BY pos) FILTER (lower(name) = 'authentication-results'), '') AS auth_all,
  count(*) FILTER (lower(name) = 'from') AS n_from, count(*) FILTER (lower(name) = 'subject') AS n_subject, count(*) FILTER (lower(name) = 'date') AS n_date,
  count(*) FILTER (lower(name) = 'message-id') AS n_mid, count(*) FILTER (lower(name) = 'received') AS hop_count FROM hdr GROUP BY message_id),
hv1 AS (SELECT msg.*, hv0.* EXCLUDE (message_id), {addr('from_hdr')} AS from_addr, {addr('reply_to')} AS reply_addr, {addr('return_path')} AS return_addr,
  CASE WHEN contains(from_hdr, '<') THEN regexp_replace(split_part(from_hdr, '<', 1), '^[" ]+|[" ]+$', '', 'g') ELSE '' END AS from_name FROM msg JOIN hv0 USING (message_id)),
hv AS (SELECT *, {dom('from_addr')} AS from_domain, {dom('reply_addr')} AS reply_domain, {dom('return_addr')} AS return_domain FROM hv1)"""


def _claimed() -> str:
    cases = " ".join(
        f"WHEN contains(nm, '{b}') AND NOT (" + " OR ".join(f"contains(nm, '{d}')" for d in own) + f") THEN '{b.title()}'" for b, own in R.DISPLAY_NAME_BRANDS)
    return f"CASE WHEN from_domain NOT IN {inlist(R.FREE_MAIL_DOMAINS)} THEN NULL {cases} END"


_SENDER = f"""
sid0 AS (SELECT *, lower(from_name) AS nm, reply_addr <> '' AND from_addr <> '' AND lower(reply_addr) <> lower(from_addr) AS reply_mismatch,
  return_domain <> '' AND from_domain <> '' AND return_domain <> from_domain AS return_mismatch,
  regexp_extract(lower(from_name), '([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}})', 1) AS inner_addr FROM hv),
sid1 AS (SELECT *, inner_addr <> '' AND split_part(inner_addr, '@', -1) <> from_domain AS name_holds_address, {_claimed()} AS claimed_brand FROM sid0),
sid AS (SELECT *, (CASE WHEN reply_mismatch THEN CASE WHEN reply_domain <> from_domain THEN 35 ELSE 15 END ELSE 0 END) + (CASE WHEN return_mismatch THEN 20 ELSE 0 END)
  + (CASE WHEN name_holds_address THEN 40 ELSE 0 END) + (CASE WHEN claimed_brand IS NOT NULL THEN 40 ELSE 0 END) AS spoofing_score FROM sid1)"""


def auth_cols(t: str, p: str = "") -> str:
    """Status, reason, domain, risk per protocol of a lower-case Authentication-Results text."""
    spf = r"\bspf=(pass|fail|softfail|neutral|none|permerror|temperror)\b(?:\s+\(([^)]+)\))?"
    dkim = r"\bdkim=(pass|fail|neutral|none|permerror|temperror)\b(?:\s+header\.i=([^\s;]+))?"
    dmarc = r"\bdmarc=(pass|fail|bestguesspass|none|permerror|temperror)\b(?:\s+\(([^)]+)\))?"
    x = lambda pat, i: f"regexp_extract({t}, '{pat}', {i})"
    where = r"domain\s+of\s+([^\s;]+)|smtp\.mailfrom=([^\s;]+)"
    return f"""upper({x(spf, 1)}) AS {p}spf_m, {x(spf, 2)} AS {p}spf_note, coalesce(nullif({x(where, 1)}, ''), {x(where, 2)}) AS {p}spf_dom,
  upper({x(dkim, 1)}) AS {p}dkim_m, {x(dkim, 2)} AS {p}dkim_dom, replace(upper({x(dmarc, 1)}), 'BESTGUESS', '') AS {p}dmarc_m, {x(dmarc, 2)} AS {p}dmarc_note,
  {x('header[.]from=([^ ;]+)', 1)} AS {p}dmarc_dom, upper({x('p=([a-z]+)', 1)}) AS {p}dmarc_pol, upper({x(r'\barc=(pass|fail|none)\b', 1)}) AS {p}arc_m"""


_risk = lambda s, hi, lo: f"CASE {s} WHEN 'PASS' THEN 0 WHEN 'FAIL' THEN {hi} WHEN 'PERMERROR' THEN {hi} ELSE {lo} END"
_AUTH = f"""
au0 AS (SELECT *, {auth_cols('lower(auth_all)')}, upper(regexp_extract(lower(rspf), '\\b(pass|fail|softfail|neutral|none|permerror|temperror)\\b', 1)) AS rs,
  regexp_extract(sig, '\\bd=([a-zA-Z0-9.-]+)', 1) AS sig_d FROM sid),
au1 AS (SELECT *, spf_m IN ('', 'NONE') AND rs <> '' AS use_rs, dkim_m IN ('', 'NONE') AND sig <> '' AS use_sig, arc_m IN ('', 'NONE') AND arc_seal <> '' AS use_seal FROM au0),
au AS (SELECT *,
  CASE WHEN use_rs THEN rs WHEN spf_m = '' THEN 'NONE' ELSE spf_m END AS spf, CASE WHEN use_rs THEN {_risk('rs', 25, 10)} WHEN spf_m = '' THEN 0 ELSE {_risk('spf_m', 25, 10)} END AS spf_risk,
  CASE WHEN use_rs THEN 'SPF result of the Received-SPF header: ' || rs WHEN spf_m = '' THEN 'The receiver states no SPF result.' WHEN spf_note <> '' THEN spf_note ELSE 'SPF result: ' || spf_m END AS spf_reason,
  CASE WHEN use_rs THEN from_domain WHEN spf_m = '' THEN '' ELSE spf_dom END AS spf_domain,
  CASE WHEN use_sig THEN 'PASS' WHEN dkim_m = '' THEN 'NONE' ELSE dkim_m END AS dkim, CASE WHEN use_sig OR dkim_m = '' THEN 0 ELSE {_risk('dkim_m', 25, 10)} END AS dkim_risk,
  CASE WHEN use_sig THEN sig_d WHEN dkim_m = '' THEN '' ELSE dkim_dom END AS dkim_domain,
  CASE WHEN dmarc_m = '' THEN 'NONE' ELSE dmarc_m END AS dmarc, CASE WHEN dmarc_m = '' THEN 0 ELSE {_risk('dmarc_m', 30, 15)} END AS dmarc_risk,
  CASE WHEN dmarc_m = '' THEN '' WHEN dmarc_pol = '' THEN 'NONE' ELSE dmarc_pol END AS dmarc_policy,
  CASE WHEN use_seal THEN 'PASS' WHEN arc_m = '' THEN 'NONE' ELSE arc_m END AS arc, CASE WHEN use_seal OR arc_m IN ('', 'PASS') THEN 0 ELSE 15 END AS arc_risk FROM au1)"""

# ---- dates ---------------------------------------------------------------------------------


def epoch(c: str) -> str:
    """RFC 2822 text to epoch seconds with strptime."""
    core = f"regexp_replace(regexp_replace(trim({c}), '^[A-Za-z]+,?\\s+', ''), '\\s*\\(.*\\)$', '')"
    core = f"regexp_replace({core}, ' (GMT|UTC|UT|Z)$', ' +0000')"
    return f"cast(epoch(try_strptime({core}, '%d %b %Y %H:%M:%S %z')) AS bigint)"


# ---- addresses -----------------------------------------------------------------------------

_OCT = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"{_OCT}(?:\.{_OCT}){{3}}"


def _v6() -> str:
    h = "[0-9a-f]{1,4}"
    forms = [f"{h}(?::{h}){{7}}", f"::(?:{h}(?::{h}){{0,6}})?", f"{h}(?::{h}){{6}}::"]
    forms += [f"{h}(?::{h}){{{n - 1}}}::(?:{h}(?::{h}){{0,{6 - n}}})?" for n in range(1, 7)]
    return "(?:" + "|".join(forms) + ")"


V6 = _v6()


def ip_steps(src: str, text: str, out: str) -> str:
    """CTEs that add ip_n (number) and ip_k (32 hex digits) of an address text."""
    return f"""
{out}_a AS (SELECT *, lower(coalesce({text}, '')) AS ip_t FROM {src}),
{out}_b AS (SELECT *, CASE WHEN regexp_full_match(ip_t, '{V4}') THEN list_reduce(list_transform(string_split(ip_t, '.'), lambda x: cast(x AS bigint)), lambda a, b: a * 256 + b) END AS ip_n,
  CASE WHEN regexp_full_match(ip_t, '{V6}') THEN list_filter(string_split(split_part(ip_t, '::', 1), ':'), lambda x: x <> '') END AS ip_l,
  CASE WHEN contains(ip_t, '::') THEN list_filter(string_split(split_part(ip_t, '::', 2), ':'), lambda x: x <> '') ELSE [] END AS ip_r FROM {out}_a),
{out} AS (SELECT * EXCLUDE (ip_l, ip_r), CASE WHEN ip_l IS NOT NULL THEN array_to_string(list_transform(list_concat(list_concat(ip_l, list_transform(range(8 - len(ip_l) - len(ip_r)), lambda x: '0')), ip_r), lambda x: lpad(x, 4, '0')), '') END AS ip_k FROM {out}_b)"""


def _in4(b):
    n = ipaddress.ip_network(b)
    return f"ip_n BETWEEN {int(n[0])} AND {int(n[-1])}"


def _in6(b):
    n = ipaddress.ip_network(b)
    return f"ip_k BETWEEN '{int(n[0]):032x}' AND '{int(n[-1]):032x}'"


def flag(name: str) -> str:
    four = {"loopback": [["127.0.0.0/8"], []], "private": [R.IPV4_PRIVATE, R.IPV4_PRIVATE_EXCEPT], "link_local": [["169.254.0.0/16"], []], "reserved": [["240.0.0.0/4"], []],
            "multicast": [["224.0.0.0/4"], []], "unspecified": [["0.0.0.0/32"], []], "shared": [["100.64.0.0/10"], []]}[name]
    six = {"loopback": [["::1/128"], []], "private": [R.IPV6_PRIVATE, R.IPV6_PRIVATE_EXCEPT], "link_local": [["fe80::/10"], []], "reserved": [R.IPV6_RESERVED, []],
           "multicast": [["ff00::/8"], []], "unspecified": [["::/128"], []], "shared": [[], []]}[name]
    def build(pair, f):
        yes, no = pair
        if not yes:
            return "FALSE"
        return "(" + " OR ".join(f(b) for b in yes) + ")" + ("" if not no else " AND NOT (" + " OR ".join(f(b) for b in no) + ")")
    return f"(CASE WHEN ip_n IS NOT NULL THEN {build(four, _in4)} WHEN ip_k IS NOT NULL THEN {build(six, _in6)} ELSE FALSE END)"


IS_IP = "(ip_n IS NOT NULL OR ip_k IS NOT NULL)"
TIMELINE_CLASS = f"CASE WHEN NOT {IS_IP} THEN 'Unknown' WHEN ip_k IS NOT NULL THEN 'IPv6' WHEN {flag('loopback')} THEN 'Loopback' WHEN {flag('link_local')} THEN 'Link-Local' WHEN {flag('reserved')} THEN 'Reserved' WHEN {flag('private')} THEN 'Private IP' ELSE 'Public IP' END"
TIMELINE_INTERNAL = f"({flag('private')} OR {flag('loopback')} OR {flag('link_local')} OR {flag('reserved')} OR {flag('unspecified')})"
HOP_CLASS = f"CASE WHEN ip_t = '' THEN 'Unknown' WHEN NOT {IS_IP} THEN 'Invalid' WHEN {flag('loopback')} THEN 'Loopback' WHEN {flag('private')} THEN 'Private RFC1918' WHEN {flag('link_local')} THEN 'Link-Local' WHEN {flag('reserved')} THEN 'Reserved' WHEN {flag('multicast')} THEN 'Multicast' WHEN ip_k IS NOT NULL THEN 'IPv6 Public' ELSE 'Public IPv4' END"
HOP_PRIVATE = f"({flag('private')} OR {flag('loopback')} OR {flag('link_local')} OR {flag('reserved')})"
GEO_CLASS = f"CASE WHEN NOT {IS_IP} THEN 'unknown' WHEN {flag('loopback')} THEN 'loopback' WHEN {flag('link_local')} THEN 'link-local' WHEN {flag('multicast')} THEN 'multicast' WHEN {flag('reserved')} OR {flag('unspecified')} THEN 'reserved' WHEN {flag('private')} THEN 'private' WHEN {flag('shared')} THEN 'unknown' ELSE 'public' END"
URL_CLASS = f"CASE WHEN NOT {IS_IP} THEN 'Domain' WHEN {flag('loopback')} THEN 'Loopback' WHEN {flag('private')} THEN 'Private RFC1918' ELSE 'Public IPv4' END"
RESTRICTED = f"({flag('private')} OR {flag('loopback')} OR {flag('link_local')} OR {flag('reserved')} OR {flag('multicast')} OR {flag('unspecified')})"
IP_CLEAN = lambda c: f"regexp_replace(coalesce({c}, ''), '^[\\[\\]() ]+|[\\[\\]() ]+$', '', 'g')"

# ---- URLs ----------------------------------------------------------------------------------


def entropy(s: str) -> str:
    p = f"((length({s}) - length(replace({s}, c, ''))) / cast(length({s}) AS double))"
    return f"(CASE WHEN length({s}) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({s}, '')), lambda c: CASE WHEN c = '' THEN 0.0 ELSE -{p} * log2({p}) END)) END)"


def suffix(h: str, items) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({h}, '{s}') THEN '{s}'" for s in items) + " ELSE '' END"


_digits = lambda text, base: f"list_reduce(list_transform(string_split({text}, ''), lambda c: cast(instr('0123456789abcdef', c) - 1 AS bigint)), lambda a, b: a * {base} + b)"
_quad = lambda n: "(" + " || '.' || ".join(f"cast((({n}) >> {s}) & 255 AS varchar)" for s in (24, 16, 8, 0)) + ")"


def numeric_host(h: str) -> str:
    hexa, deci = f"regexp_extract({h}, '^0x0*([0-9a-f]{{1,8}})$', 1)", f"regexp_extract({h}, '^0*([0-9]{{1,10}})$', 1)"
    octs = f"list_transform(string_split({h}, '.'), lambda p: {_digits('p', 8)})"
    return f"""CASE WHEN {hexa} <> '' THEN {_quad(_digits(hexa, 16))} WHEN {deci} <> '' AND try_cast({deci} AS bigint) <= 4294967295 THEN {_quad(f'try_cast({deci} AS bigint)')}
  WHEN regexp_full_match({h}, '[0-7]+([.][0-7]+){{3}}') AND regexp_matches({h}, '(^|[.])0[0-7]') AND list_max({octs}) <= 255 THEN array_to_string({octs}, '.') END"""


def root(h: str) -> str:
    two = inlist(R.TWO_PART_SUFFIXES)
    parts = f"string_split({h}, '.')"
    return f"CASE WHEN len({parts}) >= 3 AND array_to_string({parts}[-2:], '.') IN {two} THEN array_to_string({parts}[-3:], '.') WHEN len({parts}) >= 2 THEN array_to_string({parts}[-2:], '.') ELSE '' END"


def url_steps(src: str, out: str = "up") -> str:
    """CTEs that add the components of column ``url``."""
    return f"""
{out}1 AS (SELECT *, CASE WHEN regexp_matches(trim(coalesce(url, '')), '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN trim(url) ELSE 'http://' || trim(coalesce(url, '')) END AS full_url FROM {src}),
{out}2 AS (SELECT *, lower(split_part(full_url, '://', 1)) AS scheme, split_part(full_url, '#', 1) AS no_frag, CASE WHEN contains(full_url, '#') THEN substr(full_url, instr(full_url, '#') + 1) ELSE '' END AS fragment FROM {out}1),
{out}3 AS (SELECT *, CASE WHEN contains(no_frag, '?') THEN substr(no_frag, instr(no_frag, '?') + 1) ELSE '' END AS query, substr(split_part(no_frag, '?', 1), instr(full_url, '://') + 3) AS after FROM {out}2),
{out}4 AS (SELECT *, split_part(after, '/', 1) AS nl, CASE WHEN contains(after, '/') THEN substr(after, instr(after, '/')) ELSE '' END AS raw_path FROM {out}3),
{out}5 AS (SELECT *, CASE WHEN raw_path = '' THEN '/' ELSE regexp_replace(raw_path, ';[^/]*$', '') END AS path, regexp_extract(raw_path, ';([^/]*)$', 1) AS params,
  CASE WHEN contains(nl, '@') THEN regexp_extract(nl, '^(.*)@', 1) ELSE '' END AS userinfo, split_part(nl, '@', -1) AS hostport FROM {out}4),
{out}6 AS (SELECT *, split_part(userinfo, ':', 1) AS username, CASE WHEN contains(userinfo, ':') THEN substr(userinfo, instr(userinfo, ':') + 1) ELSE '' END AS password,
  lower(CASE WHEN starts_with(hostport, '[') THEN regexp_extract(hostport, '^.([^\\]]*)', 1) ELSE split_part(hostport, ':', 1) END) AS hostname,
  CASE WHEN starts_with(hostport, '[') THEN regexp_extract(hostport, '\\]:(.*)$', 1) WHEN contains(hostport, ':') THEN substr(hostport, instr(hostport, ':') + 1) ELSE '' END AS port_text FROM {out}5),
{out}7 AS (SELECT *, CASE WHEN regexp_full_match(port_text, '[0-9]{{1,9}}') THEN cast(port_text AS int) END AS port, {numeric_host('hostname')} AS decoded_ip FROM {out}6),
{out}8 AS (SELECT *, length(trim(coalesce(url, ''))) > 0 AND contains(nl, '[') = contains(nl, ']') AND (port_text = '' OR coalesce(port <= 65535, FALSE)) AS is_valid, username <> '' OR password <> '' AS has_credentials,
  CASE WHEN decoded_ip IS NULL THEN NULL WHEN starts_with(hostname, '0x') THEN 'Hexadecimal IP' WHEN regexp_full_match(hostname, '[0-9]+') THEN 'Decimal Integer IP' ELSE 'Octal IP' END AS numeric_ip_type,
  coalesce(decoded_ip, hostname) AS evaluated_host FROM {out}7),
{ip_steps(out + '8', 'evaluated_host', out + '9').strip()},
{out}10 AS (SELECT *, {IS_IP} AS is_ip, {URL_CLASS} AS ip_category, CASE WHEN {IS_IP} THEN '' ELSE {root('evaluated_host')} END AS root_domain FROM {out}9),
{out} AS (SELECT *, CASE WHEN root_domain = '' THEN '' ELSE substr(evaluated_host, 1, greatest(0, length(evaluated_host) - length(root_domain) - 1)) END AS subdomain,
  scheme || '://' || evaluated_host || CASE WHEN port IS NULL OR port IN (0, 80, 443) THEN '' ELSE ':' || cast(port AS varchar) END || path || CASE WHEN params = '' THEN '' ELSE ';' || params END
  || CASE WHEN query = '' THEN '' ELSE '?' || query END || CASE WHEN fragment = '' THEN '' ELSE '#' || fragment END AS normalized_url FROM {out}10)"""


def lookalike_text(h: str) -> str:
    for a, b in R.LOOKALIKE_SUBSTITUTIONS:
        h = f"replace({h}, '{a}', '{b}')"
    return h


def lookalike(h: str) -> str:
    cases = " ".join(f"WHEN lower({h}) NOT IN {inlist(own)} AND (contains(lower({h}), '{b}') OR contains({lookalike_text(f'lower({h})')}, '{b}')) THEN '{b.title()}'" for b, own in R.LOOKALIKE_BRANDS)
    return f"CASE WHEN {h} = '' THEN NULL {cases} END"


def token_brand(h: str) -> str:
    host = f"split_part(lower({h}), ':', 1)"
    def legit(b):
        return " OR ".join(f"{host} = '{b}.{t}' OR ends_with({host}, '.{b}.{t}')" for t in ("com", "org", "net"))
    return "CASE " + " ".join(f"WHEN list_contains(regexp_split_to_array({host}, '[^a-z0-9]'), '{b}') AND NOT ({legit(b)}) THEN '{b.capitalize()}'" for b in R.TOKEN_BRANDS) + " END"


BASE64 = r"""(len(list_filter(string_split(query, '&'), lambda p: contains(p, '=') AND regexp_full_match(substr(p, instr(p, '=') + 1), '[a-zA-Z0-9+/=]{16,}')
  AND length(substr(p, instr(p, '=') + 1)) % 4 = 0 AND (contains(CASE WHEN regexp_full_match(substr(p, instr(p, '=') + 1), '[a-zA-Z0-9+/]{14,}={0,2}') AND length(substr(p, instr(p, '=') + 1)) % 4 = 0 THEN cast(from_base64(substr(p, instr(p, '=') + 1)) AS varchar) ELSE '' END, 'http')
  OR contains(CASE WHEN regexp_full_match(substr(p, instr(p, '=') + 1), '[a-zA-Z0-9+/]{14,}={0,2}') AND length(substr(p, instr(p, '=') + 1)) % 4 = 0 THEN cast(from_base64(substr(p, instr(p, '=') + 1)) AS varchar) ELSE '' END, '@')))) > 0)"""


def risk_steps(src: str = "up", out: str = "ur", redirect: str = "0") -> str:
    """CTEs that add url_risk_score and risk_level after ``url_steps``."""
    short = inlist(R.SHORTENERS)
    return f"""
{out}1 AS (SELECT *, {entropy('normalized_url')} AS url_entropy, {entropy('hostname')} AS host_entropy, {entropy('path')} AS path_entropy, {BASE64} AS base64_payload,
  len(list_filter(string_split(hostname, '.'), lambda l: starts_with(l, 'xn--'))) > 0 AS is_punycode, {lookalike('hostname')} AS lookalike,
  hostname IN {short} OR root_domain IN {short} AS is_shortener, {suffix('hostname', R.GATEWAY_TLDS)} AS tld, {suffix('lower(path)', R.URL_DOWNLOADS)} AS download_suffix FROM {src}),
{out}2 AS (SELECT *, host_entropy > 4.8 OR path_entropy > 5.2 AS is_high_entropy FROM {out}1),
{out}3 AS (SELECT *, list_filter([{{'p': CASE WHEN has_credentials THEN 50 END, 't': 'Embedded Credentials in URL'}},
   {{'p': CASE WHEN numeric_ip_type IS NOT NULL THEN 35 END, 't': 'Obfuscated ' || numeric_ip_type || ' Target'}},
   {{'p': CASE WHEN numeric_ip_type IS NULL AND is_ip THEN 30 END, 't': 'Raw IP Address URL Target'}},
   {{'p': CASE WHEN lookalike IS NOT NULL THEN 40 END, 't': 'Brand Impersonation Target: ' || lookalike}},
   {{'p': CASE WHEN is_punycode THEN 35 END, 't': 'Punycode (IDN) Encoded Domain Target'}},
   {{'p': CASE WHEN tld <> '' THEN 20 END, 't': 'Suspicious Top-Level Domain (' || tld || ')'}},
   {{'p': CASE WHEN is_shortener THEN 15 END, 't': 'URL Shortener Service Detected'}},
   {{'p': CASE WHEN is_high_entropy THEN 15 END, 't': 'High Shannon Entropy / Randomness'}},
   {{'p': CASE WHEN base64_payload THEN 20 END, 't': 'Base64 Encoded Query Parameter Payload'}},
   {{'p': CASE WHEN download_suffix <> '' THEN 30 END, 't': 'Direct Executable / Archive File Download (' || download_suffix || ')'}}], lambda r: r.p IS NOT NULL AND is_valid) AS found FROM {out}2),
{out}4 AS (SELECT *, CASE WHEN is_valid THEN least(100, coalesce(list_sum(list_transform(found, lambda r: r.p)), 0) + {redirect}) ELSE 0 END AS url_risk_score, list_transform(found, lambda r: r.t) AS url_findings FROM {out}3),
{out} AS (SELECT *, CASE WHEN url_risk_score >= 70 THEN 'Critical' WHEN url_risk_score >= 50 THEN 'High' WHEN url_risk_score >= 25 THEN 'Medium' WHEN url_risk_score >= 10 THEN 'Low' ELSE 'Safe' END AS risk_level FROM {out}4)"""


UPLOAD_URL = "CASE WHEN starts_with(trim(url), 'http://') OR starts_with(trim(url), 'https://') THEN trim(url) ELSE 'http://' || trim(url) END"


def host_steps(src: str, out: str = "as") -> str:
    """CTEs with the upload-profile pieces of column ``url``: a_net, a_host, a_pq, and a_ip."""
    colons = "(length(a_net) - length(replace(a_net, ':', '')))"
    return f"""
{out}1 AS (SELECT *, {UPLOAD_URL} AS a_url FROM {src}),
{out}2 AS (SELECT *, regexp_extract(a_url, '^[^:/?#]+://([^/?#]*)', 1) AS a_net, regexp_extract(a_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS a_path, regexp_extract(a_url, '^[^?#]*([?][^#]+)', 1) AS a_query FROM {out}1),
{out}3 AS (SELECT *, split_part(lower(a_net), ':', 1) AS a_host, lower(regexp_replace(a_path, ';[^/]*$', '') || a_query) AS a_pq,
  CASE WHEN starts_with(a_net, '[') THEN regexp_extract(a_net, '^.([^\\]]*)', 1) WHEN {colons} = 1 THEN split_part(a_net, ':', 1) ELSE a_net END AS a_lit FROM {out}2),
{ip_steps(out + '3', 'a_lit', out + '4').strip()},
{out} AS (SELECT *, {IS_IP} AS a_ip, {token_brand('a_host')} AS a_brand, {suffix('a_host', R.UPLOAD_TLDS)} AS a_tld, round({entropy('a_host')}, 2) AS a_ent,
  list_filter({lst(R.PATH_WORDS)}, lambda w: contains(a_pq, w)) AS a_words,
  a_host IN {inlist(R.SHORTENERS)} OR {" OR ".join(f"ends_with(a_host, '.{s}')" for s in R.SHORTENERS)} AS a_short FROM {out}4)"""


REASONS = """list_filter([CASE WHEN a_ip OR starts_with(a_host, '0x') OR regexp_full_match(a_host, '[0-9]+') THEN 'URL uses an IP address instead of a domain name.' END,
  CASE WHEN a_brand IS NOT NULL THEN 'Appears to impersonate ' || a_brand || '.' WHEN starts_with(a_host, 'xn--') THEN 'URL uses Punycode (IDN) encoding, a potential homograph attack.' END,
  CASE WHEN a_tld <> '' THEN 'Uses a high-risk top-level domain (' || a_tld || ').' WHEN a_short THEN 'URL shortener service (' || a_host || ') conceals destination.' END,
  CASE WHEN a_ent > 4.2 THEN 'Domain name has unusually high entropy (' || cast(a_ent AS varchar) || '), suggesting a random or generated domain.' END,
  CASE WHEN len(a_words) >= 2 OR (len(a_words) = 1 AND (a_ip OR a_brand IS NOT NULL OR a_tld <> '' OR a_ent > 4.2)) THEN 'URL path contains suspicious keywords (''' || array_to_string(a_words, ''', ''') || ''').' END], lambda r: r IS NOT NULL)"""

# ---- texts ---------------------------------------------------------------------------------


def norm_steps(src: str, exprs: dict[str, str], out: str = "nt") -> str:
    """CTEs that add the matching text of each expression, joined token by token."""
    cols = ", ".join(f"list_filter(string_split(trim(regexp_replace(regexp_replace(translate(lower(coalesce({e}, '')), '{R.LEET_FROM}', '{R.LEET_TO}'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: t <> '') AS {n}_tok" for n, e in exprs.items())
    joined = ", ".join(f"array_to_string(list_transform({n}_tok, lambda t, i: CASE WHEN i = 1 THEN t WHEN length(t) = 1 AND length({n}_tok[i - 1]) = 1 THEN t ELSE ' ' || t END), '') AS {n}" for n in exprs)
    return f"{out}_t AS (SELECT *, {cols} FROM {src}),\n{out} AS (SELECT *, {joined} FROM {out}_t)"


def category_count(t: str, kws) -> str:
    return f"len(list_filter({lst(matching_phrase(k) for k in kws)}, lambda k: contains({t}, k)))"


def keyword_score(t: str) -> str:
    return f"least({R.KEYWORD_CAP}, " + " + ".join(f"CASE WHEN {category_count(t, kws)} > 0 THEN {w} ELSE 0 END" for _, w, kws in R.KEYWORD_CATEGORIES) + ")"


def categories_hit(t: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {category_count(t, kws)} > 0 THEN {q(n)} END" for n, _, kws in R.KEYWORD_CATEGORIES) + "], lambda c: c IS NOT NULL)"


def lure_points(t: str) -> dict[str, str]:
    return {k: f"least(100, {p} * len(list_filter({lst(terms)}, lambda w: contains({t}, w))))" for k, p, _, _, terms in R.LURES}


def lure_score(names=("authority", "urgency", "financial", "secrecy"), prefix: str = "") -> str:
    w = {k: x for k, _, x, _, _ in R.LURES}
    return "least(100, cast(floor(" + " + ".join(f"{prefix}{n} * cast({w[n]} AS double)" for n in names) + ") AS bigint))"


def content_labels(t: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({t}, '(?i){p}') THEN {q(l)} END" for l, p in R.CONTENT_PATTERNS) + "], lambda c: c IS NOT NULL)"


def plain_content(*parts: str) -> str:
    joined = " || chr(10) || ".join(f"coalesce({p}, '')" for p in parts)
    return f"trim(regexp_replace(replace(replace({joined}, '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"


MSG = view("messages", "msg")
HV = [MSG, HDR, _HV]
SID = [*HV, _SENDER]
AU = [*SID, _AUTH]
