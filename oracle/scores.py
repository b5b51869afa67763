"""Penalty and composite score statements."""

from __future__ import annotations

from mailsleuth.functions import rules as R

from . import parts as P
from .mail import CONTENT, HEADER, HSCORE, NORM, URLS_OF, _rx, dangerous, doubled, ext, safe_name
from .parts import AU, HV, MSG, inlist, lst, q, stmt, view
from .web import CHAIN_B, RH

SCORES: dict[str, str] = {}
S = SCORES

# ---- attachments ---------------------------------------------------------------------------
_nm = safe_name("o", "o")
ATT = f"""
at0 AS (SELECT message_id, o, i FROM (SELECT message_id, string_split(attachment_names, ';') AS os FROM msg WHERE attachment_names <> ''), unnest(os) WITH ORDINALITY AS u(o, i)),
at1 AS (SELECT *, {_nm} AS s FROM at0),
at2 AS (SELECT *, {dangerous('s', 'o')} AS dang, {doubled('s')} AS dbl FROM at1),
at3 AS (SELECT message_id, sum(CASE WHEN dang THEN 35 ELSE 0 END + CASE WHEN dbl THEN 30 ELSE 0 END) AS pts,
  string_agg(concat_ws('|', CASE WHEN dang THEN 'Attachment ''' || s || ''' has executable/dangerous extension (' || {ext('s')} || ')' END, CASE WHEN dbl THEN 'Attachment ''' || s || ''' uses double extension deception (.' || lower(string_split(s, '.')[-2]) || {ext('s')} || ')' END), '|' ORDER BY i) FILTER (dang OR dbl) AS texts,
  count(*) FILTER (dang) + count(*) FILTER (dbl) AS n, count(*) FILTER ({" OR ".join(f"ends_with(lower(o), '{e}')" for e in R.UPLOAD_EXECUTABLES)}) AS execs FROM at2 GROUP BY message_id)"""
S["f19_file_names"] = stmt(MSG, view("attachment_payloads", "ap"), "fn AS (SELECT message_id, pos, original_filename AS o FROM ap UNION ALL SELECT message_id, i - 1, o FROM (SELECT message_id, string_split(attachment_names, ';') AS os FROM msg WHERE attachment_names <> ''), unnest(os) WITH ORDINALITY AS u(o, i))",
    f"fs AS (SELECT *, {safe_name('o', q('attachment.bin'))} AS s FROM fn)", final=f"""SELECT message_id, pos, o AS original_filename, s AS safe_name, {ext('s')} AS suffix, {dangerous('s', 'o')} AS dangerous, {doubled('s')} AS double_suffix,
 {" OR ".join(f"ends_with(lower(o), '{e}')" for e in R.UPLOAD_EXECUTABLES)} AS executable FROM fs""")

# ---- gateway penalties ---------------------------------------------------------------------
_tail = lambda c: f"regexp_replace(lower(split_part({c}, '@', -1)), '^[> ]+|[> ]+$', '', 'g')"
_brand = "CASE " + " ".join(f"WHEN contains(bare, '{b}') AND NOT contains(gd, '{b}') THEN '{b}'" for b in R.POPULAR_SENDER_BRANDS) + " END"
PEN = f"""
pf0 AS (SELECT *, CASE WHEN NOT contains(from_hdr, '@') THEN '' WHEN contains(from_hdr, '<') THEN {_tail("split_part(from_hdr, '<', 2)")} ELSE {_tail('from_hdr')} END AS gd,
  CASE WHEN NOT contains(from_hdr, '@') THEN from_hdr WHEN contains(from_hdr, '<') THEN regexp_replace(split_part(from_hdr, '<', 1), '^[ "]+|[ "]+$', '', 'g') ELSE '' END AS gname,
  CASE WHEN contains(reply_to, '@') THEN {_tail('reply_to')} ELSE '' END AS gr FROM hs),
pf1 AS (SELECT *, regexp_replace(lower(gname), '[^a-z0-9]', '', 'g') AS bare, {P.lookalike('gd')} IS NOT NULL OR starts_with(gd, 'xn--') AS homo, gr <> '' AND gd <> '' AND gr <> gd AS rmis, {P.suffix('gd', R.GATEWAY_TLDS)} AS gtld,
  {P.auth_cols('lower(auth_first)', 'g_')}, lower(subject || ' ') AS lt, {P.plain_content('subject', 'text_body', 'html_body')} AS ctext,
  return_path <> '' AND from_hdr <> '' AND {_tail('return_path')} <> '' AND {_tail('from_hdr')} <> '' AND {_tail('return_path')} <> {_tail('from_hdr')} AS rp_apart FROM pf0),
pf2 AS (SELECT *, {_brand} AS nbrand, {", ".join(f"{e} AS lp_{k}" for k, e in P.lure_points('lt').items())}, {P.content_labels('ctext')} AS labels, coalesce(nullif(g_spf_m, ''), 'NONE') AS gspf, coalesce(nullif(g_dkim_m, ''), 'NONE') AS gdkim, coalesce(nullif(g_dmarc_m, ''), 'NONE') AS gdmarc,
  (SELECT count(*) FROM hf WHERE hf.message_id = pf1.message_id) + cast(rp_apart AS int) AS n_header FROM pf1),
pf AS (SELECT *, {P.lure_score(prefix='lp_')} AS lure, least(35, 12 * n_header) AS header_penalty,
  (CASE WHEN gspf IN ('FAIL', 'SOFTFAIL') THEN 20 ELSE 0 END) + (CASE WHEN gdkim = 'FAIL' THEN 20 ELSE 0 END) + (CASE WHEN gdmarc = 'FAIL' THEN 25 ELSE 0 END) AS auth_penalty,
  (CASE WHEN homo THEN 30 ELSE 0 END) + (CASE WHEN nbrand IS NOT NULL THEN 35 ELSE 0 END) + (CASE WHEN rmis THEN 20 ELSE 0 END) + (CASE WHEN gtld <> '' THEN 15 ELSE 0 END) AS sender_penalty FROM pf2),
pz AS (SELECT *, least(40, lure // 2 + 5 * len(labels)) AS content_penalty FROM pf)"""
GP = [*AU, HEADER, PEN]
S["a10_header_penalty"] = stmt(*GP, final="SELECT message_id, header_penalty FROM pz")
S["a11_auth_penalty"] = stmt(*GP, final="SELECT message_id, gspf AS spf, gdkim AS dkim, gdmarc AS dmarc, auth_penalty FROM pz")
S["a12_sender_penalty"] = stmt(*GP, final="SELECT message_id, gd AS g_from_domain, gname AS g_display_name, homo AS g_homograph, nbrand AS g_name_brand, rmis AS g_reply_mismatch, gtld AS g_tld, sender_penalty FROM pz")
S["a13_content_penalty"] = stmt(*GP, final="SELECT message_id, lure AS lure_score, array_to_string(labels, '|') AS labels, content_penalty FROM pz")
S["a13_content_penalty_full"] = stmt(*HV, CONTENT, "cl AS (SELECT *, lower(subject || ' ' || text_body) AS lt FROM ct)", f"cm AS (SELECT message_id, {', '.join(f'{e} AS {k}' for k, e in P.lure_points('lt').items())}, {P.content_labels('ctext')} AS labels FROM cl)",
    f"cn AS (SELECT *, {P.lure_score()} AS lure_score FROM cm)", final="SELECT message_id, lure_score, least(40, lure_score // 2 + 5 * len(labels)) AS content_penalty FROM cn")



def gateway_urls(full: bool) -> list[str]:
    """The URLs of the messages and what they add; with their captured redirects if ``full``."""
    risk = [RH, CHAIN_B, "upr AS (SELECT up.*, coalesce(redirect_risk, 0) AS redirect_risk FROM up LEFT JOIN rr USING (url))", P.risk_steps("upr", redirect="redirect_risk")] if full else [P.risk_steps()]
    return [URLS_OF, "gq AS (SELECT * FROM gu)", P.url_steps("gq", "up"), *risk,
            """gs AS (SELECT message_id, least(45, sum(CASE WHEN url_risk_score >= 50 THEN 25 WHEN url_risk_score >= 25 THEN 10 ELSE 0 END)) AS url_pts, sum(len(url_findings)) AS n_url,
  string_agg(array_to_string(list_transform(url_findings, lambda t: 'URL [' || url || ']: ' || t), '|'), '|' ORDER BY pos) FILTER (len(url_findings) > 0) AS url_texts FROM ur GROUP BY message_id)"""]


_rowf = """concat_ws('|', (SELECT string_agg(finding, '|' ORDER BY weight DESC, o) FROM hf WHERE hf.message_id = pz.message_id), CASE WHEN rp_apart THEN 'Return-Path domain (' || RPT || ') mismatch with From domain (' || FDT || ')' END,
  CASE WHEN gspf IN ('FAIL', 'SOFTFAIL') THEN 'SPF authentication status: ' || gspf END, CASE WHEN gdkim = 'FAIL' THEN 'DKIM signature validation FAILED' END, CASE WHEN gdmarc = 'FAIL' THEN 'DMARC alignment validation FAILED' END,
  CASE WHEN homo THEN 'Sender domain uses Punycode/IDN visual homograph: ' || gd END, CASE WHEN nbrand IS NOT NULL THEN 'Display Name impersonation detected: ''' || gname || ''' claims brand ''' || nbrand || ''' but domain is ''' || gd || '''' END,
  CASE WHEN rmis THEN 'Reply-To domain (' || gr || ') does not match From domain (' || gd || ')' END, CASE WHEN gtld <> '' THEN 'Sender domain uses suspicious TLD: ' || gtld END,
  nullif(array_to_string(list_transform(labels, lambda l: 'Content indicator detected: ' || l), '|'), ''), url_texts, texts, link_texts)""".replace("RPT", _tail("return_path")).replace("FDT", _tail("from_hdr"))
def attached_steps() -> str:
    """Links inside PDF text and image bytes per attachment row of ``ap``."""
    pdf = f"list_transform(regexp_extract_all(payload, '{_rx(R.RE_URL_PDF)}'), lambda u: regexp_replace(u, '[.,;!?)>]+$', ''))"
    pdf = f"list_transform({pdf}, lambda u: CASE WHEN starts_with(u, 'www.') THEN 'http://' || u ELSE u END)"
    img = f"list_filter(list_transform(regexp_extract_all(payload, '{_rx(R.RE_URL_IMAGE)}'), lambda u: regexp_replace(u, '[\\x00-\\x1f\\s\"'';,)>]+$', '')), lambda u: contains(u, 'http://') OR contains(u, 'https://'))"
    first = lambda e: f"list_filter({e}, lambda u, i: u <> '' AND list_position({e}, u) = i)"
    is_img = "contains(lower(mime_type), 'image') OR " + " OR ".join(f"ends_with(lower(original_filename), '{s}')" for s in R.IMAGE_SUFFIXES)
    return f"""
al0 AS (SELECT *, CASE WHEN mime_type = 'application/pdf' OR ends_with(lower(original_filename), '.pdf') THEN {pdf} ELSE [] END AS pdf_raw, CASE WHEN {is_img} THEN {img} ELSE [] END AS img_raw FROM ap),
al AS (SELECT message_id, pos, original_filename, {first('pdf_raw')} AS pdf_urls, {first('img_raw')} AS qr_urls FROM al0),
ax AS (SELECT message_id, sum(CASE WHEN len(pdf_urls) > 0 THEN 1 ELSE 0 END) AS pdf_parts FROM al WHERE len(pdf_urls) > 0 OR len(qr_urls) > 0 GROUP BY message_id),
ay AS (SELECT DISTINCT message_id, unnest(list_concat(pdf_urls, qr_urls)) AS url FROM al)"""


NO_LINKS = "lf AS (SELECT NULL AS message_id, 0 AS link_pts, NULL AS link_texts WHERE FALSE)"
LINKS = """lf AS (SELECT message_id, sum(CASE WHEN len(pdf_urls) > 0 THEN 15 ELSE 0 END + CASE WHEN len(qr_urls) > 0 THEN 35 ELSE 0 END) AS link_pts,
  string_agg(concat_ws('|', CASE WHEN len(pdf_urls) > 0 THEN 'PDF ''' || original_filename || ''' holds links (' || len(pdf_urls) || '): ' || array_to_string(pdf_urls[1:3], ', ') END, CASE WHEN len(qr_urls) > 0 THEN 'Image ''' || original_filename || ''' leads to ' || qr_urls[1] END), '|' ORDER BY pos) AS link_texts
  FROM al WHERE len(pdf_urls) > 0 OR len(qr_urls) > 0 GROUP BY message_id)"""


def gate(full: bool) -> list[str]:
    """The gateway score; with redirects and payloads if ``full``."""
    return [*GP, *gateway_urls(full), ATT, *([view("attachment_payloads", "ap"), attached_steps(), LINKS] if full else [NO_LINKS]), f"""g0 AS (SELECT pz.*, cast(coalesce(url_pts, 0) AS bigint) AS url_penalty, cast(least(45, coalesce(pts, 0) + coalesce(link_pts, 0)) AS bigint) AS attachment_penalty, nullif({_rowf}, '') AS ftext
  FROM pz LEFT JOIN gs USING (message_id) LEFT JOIN at3 USING (message_id) LEFT JOIN lf USING (message_id))""",
        "g1 AS (SELECT *, least(100, header_penalty + auth_penalty + sender_penalty + content_penalty + url_penalty + attachment_penalty) AS risk_score, CASE WHEN ftext IS NULL THEN [] ELSE string_split(ftext, '|') END AS fl FROM g0)",
        """g AS (SELECT *, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN risk_score >= 60 THEN 'QUARANTINE' WHEN risk_score >= 30 THEN 'REVIEW' ELSE 'ALLOW' END AS recommendation,
  CASE WHEN risk_score <= 29 THEN 'ALLOW' WHEN risk_score <= 64 THEN 'REVIEW' WHEN risk_score <= 95 THEN 'QUARANTINE' ELSE 'REJECT' END AS decision FROM g1)"""]
GATE = gate(False)
S["a09_attachment_penalty"] = stmt(MSG, ATT, view("attachment_payloads", "ap"), attached_steps(), LINKS, final="SELECT message_id, cast(least(45, coalesce(pts, 0) + coalesce(link_pts, 0)) AS bigint) AS attachment_penalty, concat_ws('|', texts, link_texts) AS findings FROM msg LEFT JOIN at3 USING (message_id) LEFT JOIN lf USING (message_id)")
S["a14_gateway_score"] = stmt(*gate(True), final="SELECT message_id, header_penalty, auth_penalty, sender_penalty, content_penalty, url_penalty, attachment_penalty, risk_score, severity, recommendation, decision, len(fl) AS findings, array_to_string(fl, '|') AS top_findings FROM g")
_BOX = "bx AS (SELECT 'user' || cast(doc_id % 7 AS varchar) || '@corp.example.com' AS user_email, message_id, risk_score, severity, CASE WHEN risk_score >= 65 THEN 'TRASHED' ELSE 'ALLOWED' END AS action_taken, CASE WHEN risk_score >= 65 THEN 'POST_DELIVERY_QUARANTINED' END AS audit_action FROM g)"
S["st2_scoring_stream"] = stmt(*GATE, final="SELECT message_id, risk_score, severity, decision, CASE decision WHEN 'ALLOW' THEN 'READY_FOR_RELAY' WHEN 'REVIEW' THEN 'REVIEW' WHEN 'QUARANTINE' THEN 'QUARANTINED' ELSE 'REJECTED' END AS final_status FROM g")
_Q = "'QUAR-' || strftime(received_at, '%Y%m%d') || '-' || left(sha256(message_id || '|default'), 8)"
S["st2_attachments"] = stmt(MSG, ATT, final=f"""SELECT message_id, sha256('bytes of ' || o) AS sha256, min(i) - 1 AS pos, cast(strlen('bytes of ' || o) AS bigint) AS size_bytes, o AS original_filename, {safe_name('o', 'o')} AS filename FROM at0 GROUP BY message_id, o""")
S["st2_quarantine"] = stmt(*GATE, final=f"""SELECT message_id, 'default' AS tenant_id, {_Q} AS quarantine_id, from_hdr AS original_sender, 'User <user' || cast(doc_id % 40 AS varchar) || '@corp.example.com>' AS recipient, subject, cast(risk_score AS bigint) AS risk_score, severity, 'QUARANTINED' AS status
 FROM g WHERE decision = 'QUARANTINE'""")
S["st2_audit"] = stmt(*GATE, final=f"""SELECT message_id, 'default' AS tenant_id, decision AS action, 'system' AS actor_id, cast(risk_score AS bigint) AS risk_score, CASE WHEN decision = 'QUARANTINE' THEN {_Q} ELSE '' END AS quarantine_id,
 'Risk score ' || risk_score || CASE decision WHEN 'ALLOW' THEN ' is within ALLOW threshold (0-29)' WHEN 'REVIEW' THEN ' requires analyst REVIEW (30-64)' WHEN 'QUARANTINE' THEN ' triggered QUARANTINE policy (65-95)' ELSE ' triggered REJECT policy (96-100)' END AS reason_head FROM g""")
S["st2_scans"] = stmt(*GATE, final="SELECT DISTINCT from_hdr AS sender, subject FROM g")
S["c06_mailbox_rescan"] = stmt(*GATE, _BOX, final="SELECT * FROM bx")
S["a19_rescan_totals"] = stmt(*GATE, _BOX, final="SELECT user_email, count(*) AS total_scanned, count(*) FILTER (action_taken = 'TRASHED') AS total_remediated FROM bx GROUP BY ROLLUP (user_email)")

_FIND = """
uf AS (SELECT message_id, CASE WHEN o < 100 THEN 'auth' WHEN o < 200 THEN 'sender' WHEN o < 300 THEN 'routing' ELSE 'integrity' END AS source, finding FROM hf UNION ALL SELECT message_id, 'content', unnest(labels) FROM pz
  UNION ALL SELECT message_id, 'url', unnest(list_transform(url_findings, lambda t: 'URL [' || url || ']: ' || t)) FROM ur UNION ALL SELECT message_id, 'attachment', unnest(string_split(texts, '|')) FROM at3
  UNION ALL SELECT message_id, 'attachment', unnest(string_split(link_texts, '|')) FROM lf WHERE message_id IN (SELECT message_id FROM msg))"""
S["u02_findings_union"] = stmt(*GP, *gateway_urls(True), ATT, view("attachment_payloads", "ap"), attached_steps(), LINKS, _FIND, final="SELECT source, finding, count(*) AS messages FROM uf GROUP BY ALL")

# ---- upload profile ------------------------------------------------------------------------
_body = "CASE WHEN text_body <> '' THEN text_body ELSE html_body END"
_up_re = _rx(R.RE_URL_UPLOAD)


AP = view("attachment_payloads", "ap")
S["c08_attachment_links"] = stmt(AP, attached_steps(), final="SELECT message_id, pos, original_filename, array_to_string(pdf_urls, '|') AS pdf_urls, array_to_string(qr_urls, '|') AS qr_urls, CASE WHEN len(qr_urls) > 0 THEN 45 ELSE 0 END AS quishing_score FROM al WHERE len(pdf_urls) > 0 OR len(qr_urls) > 0")
_IMG = "contains(lower(mime_type), 'image') OR " + " OR ".join(f"ends_with(lower(original_filename), '{x}')" for x in R.IMAGE_SUFFIXES)
_UBODY = f"ub AS (SELECT message_id, string_agg(payload, chr(10) ORDER BY pos) AS body FROM ap WHERE NOT (mime_type = 'application/pdf' OR ends_with(lower(original_filename), '.pdf') OR {_IMG}) GROUP BY message_id)"
_UB = f"{_UBODY}, uu AS (SELECT DISTINCT message_id, unnest(regexp_extract_all(body, '{_up_re}')) AS url FROM ub)"
S["j06_url_origin"] = stmt(AP, attached_steps(), _UB, final="""SELECT message_id, url, CASE WHEN ay.url IS NOT NULL THEN 'PDF attachment' ELSE 'message body' END AS origin, uu.url IS NOT NULL AS in_body FROM uu FULL JOIN ay USING (message_id, url)""".replace("SELECT message_id, url,", "SELECT coalesce(uu.message_id, ay.message_id) AS message_id, coalesce(uu.url, ay.url) AS url,").replace("USING (message_id, url)", "ON uu.message_id = ay.message_id AND uu.url = ay.url"))
S["u01_url_union"] = stmt(AP, attached_steps(), _UBODY, f"""ul AS (SELECT message_id, regexp_extract_all(body, '{_up_re}') AS l FROM ub), ux AS (SELECT message_id, unnest(l) AS url, unnest(range(1, len(l) + 1)) AS i FROM ul
 UNION ALL SELECT message_id, url, 10000000 + row_number() OVER (PARTITION BY message_id ORDER BY url) FROM ay), uy AS (SELECT message_id, url, min(i) AS i FROM ux GROUP BY ALL)""", final="SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY i) - 1 AS pos, url FROM uy")


def upload(with_attached: bool) -> list[str]:
    more = "UNION SELECT message_id, url FROM ay WHERE message_id IN (SELECT message_id FROM msg)" if with_attached else ""
    bad = "len(r) > 0 OR EXISTS (SELECT 1 FROM ay WHERE ay.message_id = wr.message_id AND ay.url = wr.url)" if with_attached else "len(r) > 0"
    pdf = "coalesce((SELECT pdf_parts FROM ax WHERE ax.message_id = wn.message_id), 0)" if with_attached else "0"
    return [*AU, *([AP, attached_steps()] if with_attached else []), P.norm_steps("au", {"n_sub": "subject", "n_body": _body}), "wn AS (SELECT *, trim(n_sub || ' ' || n_body) AS norm FROM nt)",
            f"wu AS (SELECT DISTINCT message_id, unnest(regexp_extract_all({_body}, '{_up_re}')) AS url FROM msg {more})", P.host_steps("wu", "wa"), f"wr AS (SELECT message_id, url, {P.REASONS} AS r FROM wa)",
            f"wb AS (SELECT message_id, count(*) FILTER ({bad}) AS bad FROM wr GROUP BY message_id)", ATT,
            f"""w0 AS (SELECT wn.*, 25 * cast(reply_mismatch AS int) AS reply_points, {P.keyword_score('norm')} AS keyword_points, {P.categories_hit('norm')} AS kc, 35 * coalesce(execs, 0) AS exec_points, 20 * {pdf} AS pdf_points, 25 * coalesce(bad, 0) AS url_points,
  (CASE WHEN spf IN ('FAIL', 'PERMERROR') THEN 25 ELSE 0 END) + (CASE WHEN dkim IN ('FAIL', 'PERMERROR') THEN 25 ELSE 0 END) + (CASE WHEN dmarc IN ('FAIL', 'PERMERROR') THEN 30 ELSE 0 END) AS auth_points,
  25 * (cast(name_holds_address AS int) + cast(claimed_brand IS NOT NULL AS int)) AS spoof_points FROM wn LEFT JOIN wb USING (message_id) LEFT JOIN at3 USING (message_id))""",
            "w1 AS (SELECT *, cast(least(100, reply_points + keyword_points + exec_points + pdf_points + url_points + auth_points + spoof_points) AS bigint) AS risk_score FROM w0)",
            "wz AS (SELECT *, CASE WHEN risk_score >= 50 THEN 'High Risk' WHEN risk_score >= 20 THEN 'Medium Risk' ELSE 'Low Risk' END AS verdict FROM w1)"]


S["a15_upload_score"] = stmt(*upload(False), final="""SELECT message_id, reply_points, keyword_points, exec_points, url_points, auth_points, spoof_points, risk_score, verdict, array_to_string(list_filter(list_concat(list_concat([CASE WHEN reply_points > 0 THEN 'Header anomaly' END], kc),
 [CASE WHEN exec_points > 0 THEN 'Executable attachments' END, CASE WHEN url_points > 0 THEN 'Suspicious URL' END, CASE WHEN auth_points > 0 THEN 'Authentication failure' END, CASE WHEN spoof_points > 0 AND reply_points = 0 THEN 'Header anomaly' END]), lambda c: c IS NOT NULL), '|') AS categories FROM wz""")
S["a15_upload_score_attachments"] = stmt(*upload(True), final="SELECT message_id, cast(pdf_points AS bigint) AS pdf_points, url_points, risk_score, verdict FROM wz")
