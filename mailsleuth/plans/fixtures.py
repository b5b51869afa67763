"""Mail-shaped views derived from the star-schema test tables.

Each view is one SQL text that both Spark and DuckDB accept, with ``{table}``
placeholders for the base tables. They stand in for the landed tables of a real
deployment (messages, hops, URLs, scans, ...), so all rows of the base table and
the whole of every text take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _rfc_date(ts: str, weekday: bool) -> str:
    two = lambda part: f"lpad(cast(cast(extract({part} FROM {ts}) AS int) AS string), 2, '0')"
    day = "'Mon, ' || " if weekday else ""
    return (f"{day}cast(extract(day FROM {ts}) AS string) || "
            f"CASE extract(month FROM {ts}) WHEN 1 THEN ' Jan ' WHEN 2 THEN ' Feb ' ELSE ' Dec ' END || "
            f"cast(extract(year FROM {ts}) AS string) || ' ' || {two('hour')} || ':' || {two('minute')} || ':' || {two('second')}")


_NL = "chr(13) || chr(10)"
_TEMPLATES = """
 (0,'Ana Ruiz <ana@corp.example.com>','','ana@corp.example.com','Weekly notes','See you on Monday. https://wiki.example.org/notes','','mx; spf=pass (mx: domain of ana@corp.example.com designates 198.51.100.7 as permitted sender) smtp.mailfrom=ana@corp.example.com; dkim=pass header.i=@corp.example.com; dmarc=pass (p=REJECT sp=REJECT) header.from=corp.example.com','','X-Mailer: Microsoft Outlook 16.0','corp.example.com'),
 (1,'IT Desk <desk@helpme.example.net>','','desk@helpme.example.net','Account alert','Please ver1fy y0ur acc0unt within 24 hours: http://3232235777/login?verify=1','','mx; spf=softfail; dkim=none; dmarc=none','','User-Agent: PHPMailer 6.1','helpme.example.net'),
 (2,'PayPal Support <case@paypal-help.example.top>','pay@other.example.com','b@bulk.example.com','Urgent final notice','Update your password now, your account will be suspended. https://paypal-help.top/verify/login http://paypai.com/a','<a href="https://paypal-help.top/verify/login">open</a>','mx; spf=fail (bad host) smtp.mailfrom=b@bulk.example.com; dkim=fail; dmarc=fail (p=quarantine) header.from=paypal-help.example.top','','','bulk.example.com'),
 (3,'Chief Executive <ceo.office@gmail.com>','CEO Desk <ceo@other.example.com>','ceo.office@gmail.com','Wire transfer today only','Keep this confidential, send the routing number. Are you available right now?','','mx; spf=pass; dkim=pass; dmarc=none','','X-Mailer: iPhone Mail (20A)','gmail.com'),
 (4,'Billing <bill@vendor.example.com>','','bill@vendor.example.com','Overdue invoice','Invoice attached, outstanding balance. Overdue payment of 40 EUR. https://cdn.vendor.example.com/i.pdf','','mx; spf=pass; dkim=pass; dmarc=pass','invoice.pdf.exe','','vendor.example.com'),
 (5,'Parcel <p@parcel.example.click>','p@parcel.example.click','p@parcel.example.click','Package on hold','Customs fee required: v e r i f y now. https://bit.ly/3abcd','<img src="https://cdn.example.org/x.png">','mx; spf=neutral','label.docm;photo.png','User-Agent: Thunderbird 115','mail.parcel.example.click'),
 (6,'Ops <ops@corp.example.com>','','ops@corp.example.com','Backup report','Host 203.0.113.9 done, peers 2001:4860:4860:0:0:0:0:8888 and 8.8.4.4. Wallet 0x52908400098527886E0F7030069857D2E4169EE7. Log at http://0x7f000001/status','','','report.pdf','','corp.example.com'),
 (7,'','','','','','','','','',''),
 (8,'"PayPal Security" <alerts@gmail.com>','','alerts@gmail.com','Security alert','Unusual login attempt seen. Confirm your identity at https://micr0soft-login.com/signin/verify','<p>Verify&nbsp;your password</p><a href="https://micr0soft-login.com/signin/verify">go</a>','mx; spf=pass; dkim=permerror; dmarc=permerror','','','gmail.com'),
 (9,'"billing@apple.com" <x9@freehost.example.xyz>','','bounce@freehost.example.xyz','Your receipt','Click here: https://admin:secret123@login.example.xyz/reset?next=aHR0cDovL2V2aWwuZXhhbXBsZS5jb20v','','mx; spf=temperror; dkim=neutral; arc=fail','','X-Mailer: swiftmailer','other.example.net'),
 (10,'Lottery <win@xn--e1afmkfd.xn--p1ai>','','win@xn--e1afmkfd.xn--p1ai','You have won','Claim your prize at http://xn--e1afmkfd.xn--p1ai/claim and http://malicious.xyz/a.exe','','mx; arc=pass; dmarc=bestguesspass','prize.jpg.scr;notes.txt','','xn--e1afmkfd.xn--p1ai'),
 (11,'HR Director <hr@corp.example.com>','','hr@corp.example.com','Payroll update needed','Update direct deposit and payroll account, process payment. Do not discuss. I am in a meeting.','','','../../etc/payroll.xlsm','','corp.example.com'),
 (12,'root','','','Cron','Unauthorized access attempt from 192.0.2.44 and 0177.0.0.1 http://0177.0.0.1/x','','mx; spf=none','','','broken'),
 (13,'Newsletter <news@arnazon.com>','unsubscribe@lists.example.org','bounce@lists.example.org','Deals','Immediate payment pending. See http://www.google.com/url and https://office365-login.com/a https://t.co/zz','<a href="https://office365-login.com/a?x=1&amp;y=2">deal</a>','mx; spf=pass; dkim=pass header.i=@lists.example.org; dmarc=fail','','X-Mailer: python-mailer','lists.example.org'),
 (14,'Legal <legal@firm.example.co.uk>','','legal@firm.example.co.uk','Court summons attached','Legal action will be taken. Pay in bitcoin 1BoatSLRHtKNngkdXEeobR76b53LETtpyT now. https://docs.firm.example.co.uk:8443/a?b=1#top','','mx; spf=pass','summons.zip','','firm.example.co.uk'),
 (15,'Friend <pal@mail.example.org>','','pal@mail.example.org','Photos','Here are the photos. http://10.0.0.5/album http://[2001:db8::5]/p http://photos.example.org/a%20b/?q=1','','mx; spf=pass; dkim=pass','holiday.jpeg','','mail.example.org')
"""

_RECEIVED = f"""
 CASE WHEN d.doc_id % 4 >= 1 THEN 'Received: from relay' || cast(d.doc_id % 5 AS string) || '.example.net (relay.example.net [198.51.100.' || cast(d.doc_id % 250 AS string) || '])' || {_NL} ||
   ' by mx.corp.example.com with ESMTPS (using TLSv1.3) id q' || cast(d.doc_id AS string) || ';' || {_NL} || ' ' || {_rfc_date("(r.at + interval '20' second)", True)} || ' +0000 (UTC)' || {_NL} ELSE '' END ||
 CASE WHEN d.doc_id % 4 >= 2 THEN 'Received: from [10.0.0.' || cast(d.doc_id % 250 AS string) || '] (helo=localhost) by relay.example.net with SMTP; ' ||
   {_rfc_date("(r.at + CASE WHEN d.doc_id % 7 = 0 THEN interval '5' second ELSE interval '7205' second END)", False)} || ' +0200' || {_NL} ELSE '' END ||
 CASE WHEN d.doc_id % 4 = 3 THEN 'Received: from mail.sender.example.com ([IPv6:2001:db8::' || cast(d.doc_id % 10 AS string) || ']) by edge.example.net with esmtpa id z' ||
   CASE WHEN d.doc_id % 11 = 0 THEN '' WHEN d.doc_id % 13 = 0 THEN '; yesterday' ELSE '; ' || {_rfc_date("r.at", True)} || ' GMT' END || {_NL} ELSE '' END
"""

MESSAGES = f"""
SELECT 'm' || cast(d.doc_id AS string) AS message_id, r.at AS received_at,
  CASE WHEN t.return_path <> '' THEN 'Return-Path: <' || t.return_path || '>' || {_NL} ELSE '' END ||
  {_RECEIVED} ||
  CASE WHEN t.auth <> '' THEN 'Authentication-Results: ' || replace(t.auth, '; ', ';' || {_NL} || chr(9)) || {_NL} ELSE '' END ||
  CASE WHEN t.k = 11 THEN 'Received-SPF: softfail (mx: transitioning) client-ip=192.0.2.1' || {_NL} || 'DKIM-Signature: v=1; a=rsa-sha256; d=corp.example.com; s=s1' || {_NL} || 'ARC-Seal: i=1; cv=none' || {_NL} ELSE '' END ||
  CASE WHEN t.from_hdr <> '' THEN 'From: ' || t.from_hdr || {_NL} ELSE '' END ||
  'To: User <user' || cast(d.doc_id % 40 AS string) || '@corp.example.com>, team@corp.example.com, ,' || {_NL} ||
  CASE WHEN d.doc_id % 3 = 0 THEN 'Cc: audit@corp.example.com' || {_NL} ELSE '' END ||
  CASE WHEN t.reply_to <> '' THEN 'Reply-To: ' || t.reply_to || {_NL} ELSE '' END ||
  CASE WHEN t.k <> 7 THEN 'Subject: ' || t.subject || {_NL} ELSE '' END ||
  CASE WHEN t.k = 13 THEN 'Subject: second subject' || {_NL} ELSE '' END ||
  CASE WHEN t.k NOT IN (7, 12) THEN 'Date: ' || {_rfc_date("r.at", True)} || ' +0000' || {_NL} ELSE '' END ||
  CASE WHEN t.mid = 'broken' THEN 'Message-ID: not-an-id' || {_NL} WHEN t.mid <> '' THEN 'Message-ID: <id' || cast(d.doc_id AS string) || '@' || t.mid || '>' || {_NL} ELSE '' END ||
  CASE WHEN t.mailer <> '' THEN t.mailer || {_NL} ELSE '' END ||
  CASE WHEN d.doc_id % 6 = 0 THEN 'X-Originating-IP: [203.0.113.' || cast(d.doc_id % 200 AS string) || ']' || {_NL} ELSE '' END AS raw_headers,
  d.text || ' ' || t.phrase AS text_body, t.html AS html_body, t.att AS attachment_names, d.doc_id
FROM {{documents}} d
JOIN (VALUES {_TEMPLATES}) AS t(k, from_hdr, reply_to, return_path, subject, phrase, html, auth, att, mailer, mid) ON d.doc_id % 16 = t.k
"""
# the receive time is a function of doc_id alone
MESSAGES = MESSAGES.replace("r.at", "(timestamp '2024-01-01 00:00:00' + (d.doc_id % 43200) * interval '1' minute)")

HOPS = """
SELECT 'h' || cast(user_id AS string) || '-' || cast(cast(ts AS date) AS string) AS message_id, event_id AS seq,
       'mx' || cast(event_id % 5 AS string) || '.example.net' AS from_host,
       CASE event_type WHEN 'error' THEN '10.0.0.' || cast(user_id % 250 AS string) WHEN 'view' THEN '198.51.100.' || cast(user_id % 250 AS string)
            WHEN 'click' THEN '8.8.4.' || cast(user_id % 3 AS string) WHEN 'purchase' THEN '169.254.1.1' ELSE NULL END AS from_ip,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE (cast(((extract(year FROM ts) - 1970) * 365 + floor((extract(year FROM ts) - 1969) / 4) + extract(doy FROM ts) - 1) * 86400 + extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(cast(extract(second FROM ts) AS double)) AS bigint)) - CASE WHEN event_id % 7 = 0 THEN 21600 ELSE 0 END END AS hop_epoch
FROM {events}
"""

REDIRECT_HOPS = """
SELECT chain_id, hop_no, source_url, destination_url, status_code FROM (
  SELECT (page_id - page_id % 4) AS chain_id, page_id % 4 + 1 AS hop_no, url AS source_url,
         CASE WHEN page_id % 12 = 2 THEN 'http://192.168.1.1/login' WHEN page_id % 20 = 1 THEN 'https://bit.ly/x' || cast(page_id AS string)
              WHEN page_id % 24 = 3 THEN 'http://paypal.login.example.top/a' WHEN page_id % 28 = 9 THEN replace(url, 'http://', 'https://')
              ELSE lead(url) OVER (PARTITION BY page_id - page_id % 4 ORDER BY page_id) END AS destination_url,
         CASE WHEN page_id % 2 = 0 THEN 301 ELSE 302 END AS status_code
  FROM {pages}) x WHERE destination_url IS NOT NULL
UNION ALL SELECT * FROM (VALUES (-1, 1, 'https://bit.ly/3abcd', 'http://parcel.example.click/a', 301), (-1, 2, 'http://parcel.example.click/a', 'https://login.example.top/b', 302), (-1, 3, 'http://other.example.org/c', 'http://192.168.7.9/login', 302),
  (-2, 1, 'https://t.co/zz', 'http://t.co/zz', 302), (-2, 2, 'http://t.co/zz', 'https://office365-login.com/a', 302)) AS t(chain_id, hop_no, source_url, destination_url, status_code)
"""

USERS = """
SELECT c_custkey AS user_id, c_name AS username, lower(c_name) || '@corp.example.com' AS email,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' WHEN c_custkey % 3 = 0 THEN 'analyst' ELSE 'user' END AS role,
       timestamp '2023-01-01 00:00:00' + (c_custkey % 43200) * interval '1' minute AS created_at
FROM {customer}
"""

# literal networks, and one of each version for every supplier, so that the table grows with the data
NETWORKS = """
SELECT * FROM (VALUES ('8.8.4.0/24','US','United States','California','Mountain View',cast(37.4 AS double),cast(-122.1 AS double),'America/Los_Angeles',64500,'Example Net A','2024-01-02'),
 ('8.8.0.0/16','US','United States','Illinois','Chicago',41.9,-87.6,'America/Chicago',64500,'Example Net A','2024-01-02'),
 ('152.143.9.9/16','DE','Germany','Berlin','Berlin',52.5,13.4,'Europe/Berlin',64501,'Example Net B',NULL),
 ('64.0.0.0/2','GB','United Kingdom','Unknown','Unknown',NULL,NULL,'Europe/London',NULL,'Unknown','2024-01-03'),
 ('192.0.0.0/3','Unknown','Unknown','Unknown','Unknown',NULL,NULL,'Unknown',64502,'Example Net C','2024-01-04'),
 ('2000::/3','Unknown','Unknown','Unknown','Unknown',NULL,NULL,'Unknown',64510,'Example Six','2024-01-05'),
 ('2606:4700::/32','US','United States','Unknown','Unknown',NULL,NULL,'Unknown',64511,'Example Six A',NULL),
 ('2606:4700:4700::/48','US','United States','California','San Francisco',37.8,-122.4,'America/Los_Angeles',NULL,'Unknown','2024-01-06'),
 ('2606:4700:4700::1111/128','AU','Australia','Queensland','Brisbane',-27.5,153.0,'Australia/Brisbane',64512,'Example Six B',NULL),
 ('2a00:1450:ffff::1/29','IE','Ireland','Leinster','Dublin',53.3,-6.3,'Europe/Dublin',64513,'Example Six C',NULL),
 ('4000::/2','ZZ','Nowhere','Unknown','Unknown',NULL,NULL,'Unknown',NULL,'Unknown',NULL),
 ('0.0.0.0/0','Unknown','Unknown','Unknown','Unknown',NULL,NULL,'Unknown',64599,'Example Rest',NULL), ('300.1.1.0/24','XX','X','X','X',NULL,NULL,'X',1,'X',NULL), ('9.9.9.0/33','XX','X','X','X',NULL,NULL,'X',1,'X',NULL), ('9.9.9.9','XX','X','X','X',NULL,NULL,'X',1,'X',NULL)
) AS n(network,country_code,country,region,city,latitude,longitude,timezone,asn,organization,build_date)
UNION ALL SELECT cast(s_suppkey % 223 + 1 AS string) || '.' || cast(s_suppkey * 7 % 256 AS string) || '.0.0/' || cast(13 + s_suppkey % 4 AS string), 'FR', 'France', 'Unknown', 'City ' || cast(s_suppkey % 90 AS string), NULL, NULL, 'Unknown', CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 60000 + s_suppkey % 400 END, 'Unknown', NULL FROM {supplier}
UNION ALL SELECT '2a02:' || cast(s_suppkey % 1000 AS string) || ':' || cast(s_suppkey * 13 % 9000 AS string) || '::/' || cast(31 + s_suppkey % 18 AS string), 'SE', 'Sweden', 'Unknown', CASE WHEN s_suppkey % 2 = 0 THEN 'Unknown' ELSE 'Stad ' || cast(s_suppkey % 70 AS string) END, NULL, NULL, 'Europe/Stockholm', 61000 + s_suppkey % 500, 'Six ' || cast(s_suppkey % 9 AS string), NULL FROM {supplier}
"""

IPS = """
SELECT event_id, CASE WHEN event_id % 8 < 6 THEN cast((h >> 24) & 255 AS string) || '.' || cast((h >> 16) & 255 AS string) || '.' || cast((h >> 8) & 255 AS string) || '.' || cast(h & 255 AS string)
  WHEN event_id % 8 = 6 THEN CASE cast(floor(event_id / 8) AS bigint) % 22 WHEN 0 THEN '::1' WHEN 1 THEN '::' WHEN 2 THEN 'fe80::1' WHEN 3 THEN '2001:db8::5' WHEN 4 THEN '2606:4700:4700::1111'
      WHEN 5 THEN 'ff02::1' WHEN 6 THEN 'fd00:1::2' WHEN 7 THEN '2002:c000:204::1' WHEN 8 THEN '4000::1' WHEN 9 THEN '2001:4860:4860:0:0:0:0:8888' WHEN 10 THEN '64:ff9b:1::9' WHEN 11 THEN '1:2:3' WHEN 12 THEN '100::7'
      WHEN 13 THEN '2001:20::1' WHEN 14 THEN '[2a00:1450::8a]' WHEN 15 THEN '2a02:' || cast(user_id % 1000 AS string) || '::' || cast(event_id % 9999 AS string)
      WHEN 16 THEN '2A02:' || cast(user_id % 1000 AS string) || ':' || cast(user_id * 13 % 9000 AS string) || ':0:0:0:0:5' WHEN 17 THEN '2606:4700:4700:1::1' WHEN 18 THEN '2606:4700:9999::1' WHEN 19 THEN '2a00:1457:ffff::' WHEN 20 THEN '2a00:1458::' ELSE '2001:db8:::1' END
  ELSE CASE cast(floor(event_id / 8) AS bigint) % 20 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '192.168.1.100' WHEN 2 THEN '10.0.0.1' WHEN 3 THEN '172.16.0.1' WHEN 4 THEN '169.254.1.1' WHEN 5 THEN '224.0.0.1' WHEN 6 THEN '240.0.0.1'
      WHEN 7 THEN '100.64.3.4' WHEN 8 THEN '0.0.0.0' WHEN 9 THEN '255.255.255.255' WHEN 10 THEN '192.0.0.9' WHEN 11 THEN '192.0.0.8' WHEN 12 THEN '198.51.100.7' WHEN 13 THEN '01.2.3.4' WHEN 14 THEN 'mail.example.com'
      WHEN 15 THEN '' WHEN 16 THEN NULL WHEN 17 THEN '8.8.8.8' WHEN 18 THEN '8.8.4.' || cast(user_id % 250 AS string) ELSE '[152.143.2.9]' END END AS ip
FROM (SELECT event_id, user_id, (event_id * 2654435761) % 4294967296 AS h FROM {events}) e
"""

URLS = """
SELECT 'm' || cast(cast(floor(event_id / 40) AS bigint) AS string) AS message_id, event_id % 40 AS pos,
  CASE event_id % 24 WHEN 0 THEN 'http://0x7F000001/status' WHEN 1 THEN 'http://2130706433/login' WHEN 2 THEN 'http://0177.0.0.1/a'
   WHEN 3 THEN 'http://admin:secret123@host' || cast(user_id % 50 AS string) || '.example.com/x' WHEN 4 THEN 'http://xn--e1afmkfd.xn--p1ai/claim'
   WHEN 5 THEN 'https://micr0soft-login.com/signin/verify?u=' || cast(user_id AS string) WHEN 6 THEN 'http://paypaI.com/a' WHEN 7 THEN 'https://bit.ly/' || cast(user_id % 20 AS string)
   WHEN 8 THEN 'http://malicious.xyz/pay/load' || cast(user_id % 9 AS string) || '.exe' WHEN 9 THEN 'https://fonts.googleapis.com/css?family=A' WHEN 10 THEN 'http://purchase.com/cart;v=1/item;s=2?id=' || cast(event_id AS string)
   WHEN 11 THEN 'https://docs.firm.example.co.uk:8443/a?b=1&b=2&c=#top' WHEN 12 THEN 'http://10.0.' || cast(user_id % 200 AS string) || '.7/album' WHEN 13 THEN 'http://[2001:db8::' || cast(user_id % 9 AS string) || ']/p'
   WHEN 14 THEN 'http://8.8.8.8:8080/login/verify' WHEN 15 THEN 'https://track.example.org/r?next=aHR0cDovL2V2aWwuZXhhbXBsZS5jb20v&u=https%3A%2F%2Fbad.example.com'
   WHEN 16 THEN 'www.example.org/path/login' WHEN 17 THEN 'http://q7x9z2kf8w3v5b1n6m4j0hgtrpdlsyca.example-cdn.net/' WHEN 18 THEN 'https://login.example.com:notaport/a' WHEN 19 THEN 'ftp://files.example.com/pub/tool.zip'
   WHEN 20 THEN 'http://printer.local/admin' WHEN 21 THEN 'https://secure.apple.example.top/verify/login' WHEN 22 THEN 'http://T.CO/Zz' ELSE 'https://news' || cast(user_id % 300 AS string) || '.example.com/story/' || cast(event_id % 500 AS string) || '?ref=x' END AS url
FROM {events}
UNION ALL SELECT 'p' || cast(page_id AS string), 0, url FROM {pages}
"""

SCANS = """
SELECT o_orderkey AS scan_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS user_id,
  'sender' || cast(o_custkey % 60 AS string) || '@' || CASE o_orderkey % 5 WHEN 0 THEN 'vendor.example.com' WHEN 1 THEN 'paypal-help.example.top' WHEN 2 THEN 'Corp.example.com' WHEN 3 THEN 'bulk' || cast(o_custkey % 30 AS string) || '.example.net' ELSE 'gmail.com' END AS sender,
  'user' || cast(o_orderkey % 90 AS string) || '@corp.example.com' AS receiver,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'Order note ' || o_orderpriority || ' for ' || cast(o_custkey % 40 AS string) END AS subject,
  CASE WHEN o_orderkey % 9 = 0 THEN 'reply@other.example.com' ELSE '' END AS reply_to,
  CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'https://bit.ly/a' || cast(o_custkey % 25 AS string) WHEN 2 THEN 'http://malicious.xyz/a.exe;https://cdn.example.org/x;https://a.example.org/1;https://b.example.org/2'
       WHEN 3 THEN 'https://shop' || cast(o_custkey % 12 AS string) || '.example.com/p' ELSE 'http://10.0.0.' || cast(o_custkey % 200 AS string) || '/login' END AS urls_text,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '198.51.100.' || cast(o_custkey % 100 AS string) WHEN 2 THEN 'vendor.example.com;malicious.xyz' ELSE '8.8.4.' || cast(o_custkey % 100 AS string) || ';shop.example.com' END AS iocs_text,
  cast(floor(o_totalprice) AS bigint) % 101 AS risk_score,
  CASE WHEN cast(floor(o_totalprice) AS bigint) % 101 >= 50 THEN 'High Risk' WHEN cast(floor(o_totalprice) AS bigint) % 101 >= 20 THEN 'Medium Risk' ELSE 'Low Risk' END AS verdict,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Credential harvesting / account security;Suspicious URL' WHEN 2 THEN 'Invoice / wire fraud (BEC)' WHEN 3 THEN 'Header anomaly' ELSE 'Urgency / pressure tactics;Suspicious URL' END AS categories_text,
  CASE WHEN o_orderkey % 10 = 3 THEN 'Display Name Email Spoofing: name holds another address;Reply-To address does not match From address.' WHEN o_orderkey % 10 < 3 THEN 'SPF authentication check failed.' ELSE '' END AS findings_text,
  o_orderdate + (o_orderkey % 1440) * interval '1' minute AS scan_time
FROM {orders}
"""

ATTEMPTS = """
SELECT 'q' || cast(cast(floor(event_id / 4) AS bigint) AS string) AS message_id, event_id % 4 + 1 AS attempt_no, ts AS attempted_at,
  CASE WHEN event_type IN ('error', 'click', 'view') THEN 'failed' ELSE 'ok' END AS outcome, 'err ' || event_type AS error_text FROM {events}
"""

ENFORCEABLE = """
SELECT 'o' || cast(o_orderkey AS string) AS message_id, 't' || cast(o_custkey % 5 AS string) AS tenant_id,
  'sender' || cast(o_custkey AS string) || '@example.com' AS from_addr, 'user' || cast(o_orderkey % 90 AS string) || '@corp.example.com' AS recipient, 'Note ' || o_orderpriority AS subject,
  cast(floor(o_totalprice) AS bigint) % 101 AS risk_score,
  CASE WHEN cast(floor(o_totalprice) AS bigint) % 101 >= 80 THEN 'CRITICAL' WHEN cast(floor(o_totalprice) AS bigint) % 101 >= 60 THEN 'HIGH' WHEN cast(floor(o_totalprice) AS bigint) % 101 >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'SPF authentication status: FAIL;Sender domain uses suspicious TLD: .top;Header anomaly;Other' END AS findings_text,
  CASE WHEN o_orderkey % 8 = 0 THEN 'DELIVERED' WHEN o_orderkey % 8 = 1 THEN 'REVIEW' ELSE 'READY_FOR_ANALYSIS' END AS status,
  CASE WHEN o_orderkey % 50 = 7 THEN 'risk model unavailable' ELSE NULL END AS evaluation_error,
  o_orderdate AS decided_at
FROM {orders}
"""

RELEASE_REQUESTS = """
SELECT event_id AS request_id, 'o' || cast(event_id % 7000 AS string) AS message_id, 't' || cast(user_id % 5 AS string) AS tenant_id,
  'admin' || cast(user_id % 10 AS string) AS requested_by, ts AS requested_at, CASE WHEN event_type = 'signup' THEN 'REJECT' WHEN event_type = 'view' THEN 'RELEASE_REVIEW' ELSE 'RELEASE' END AS action FROM {events}
"""

RELAY_OUTCOMES = """
SELECT 'o' || cast(l_orderkey AS string) AS message_id, l_linenumber AS attempt_no, CASE WHEN l_returnflag = 'R' THEN 451 WHEN l_returnflag = 'A' THEN 500 ELSE 250 END AS smtp_code,
  'relay' || cast(l_suppkey % 4 AS string) || '.example.net' AS relay_host, l_shipdate AS attempted_at FROM {lineitem}
"""

REPUTATION = """
SELECT * FROM (
 SELECT 'domain' AS ioc_type, 'bulk' || cast(s_suppkey % 30 AS string) || '.example.net' AS ioc_value, CASE s_suppkey % 4 WHEN 0 THEN 'ip_feed' WHEN 1 THEN 'url_feed' WHEN 2 THEN 'payload_feed' ELSE 'multi_feed' END AS provider,
   s_suppkey % 3 AS malicious, s_suppkey % 2 AS suspicious, s_suppkey % 5 AS harmless, 0 AS unknown, cast(0.8 AS double) + cast(s_suppkey % 10 AS double) / 100 AS confidence, timestamp '2024-01-01 00:00:00' + (s_suppkey % 48) * interval '1' hour AS expires_at FROM {supplier}
 UNION ALL SELECT 'ip', '198.51.100.' || cast(s_suppkey % 100 AS string), CASE s_suppkey % 3 WHEN 0 THEN 'ip_feed' WHEN 1 THEN 'url_feed' ELSE 'multi_feed' END, 1 + s_suppkey % 2, 0, 0, 0, cast(0.9 AS double), timestamp '2024-01-01 00:00:00' + (s_suppkey % 48) * interval '1' hour FROM {supplier}
 UNION ALL SELECT 'domain', 'malicious.xyz', 'url_feed', 3, 1, 0, 0, cast(0.85 AS double), timestamp '2024-01-05 00:00:00' FROM {region}
) r
"""

ATTACHMENT_PAYLOADS = """
SELECT 'm' || cast(cast(floor(page_id / 25) AS bigint) AS string) AS message_id, page_id % 25 AS pos,
  CASE page_id % 6 WHEN 0 THEN 'scan.png' WHEN 1 THEN 'report.pdf' WHEN 2 THEN '..' || chr(92) || 'up' || chr(92) || 'tool.exe' WHEN 3 THEN 'a:b?c.txt' WHEN 4 THEN 'photo.JPEG' ELSE '' END AS original_filename,
  CASE page_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf' WHEN 4 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime_type,
  CASE WHEN page_id % 5 = 0 THEN html WHEN page_id % 7 = 0 THEN 'same payload' ELSE 'see ' || url || ' or www.example.org/qr, and ' || url || ') ' || html END AS payload
FROM {pages}
"""

LEGACY_SCANS = """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 < 3 THEN o_custkey ELSE NULL END AS user_id,
  CASE o_orderkey % 9 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL WHEN 2 THEN '-5' WHEN 3 THEN '400' ELSE cast(o_orderkey % 101 AS string) END AS risk_score,
  CASE o_orderkey % 4 WHEN 0 THEN 'High Risk' WHEN 1 THEN 'weird' ELSE NULL END AS verdict,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'Note ' || cast(o_orderkey AS string) END AS subject,
  CASE o_orderkey % 3 WHEN 0 THEN '2024-03-01T10:00:00Z' WHEN 1 THEN '2024-03-01 12:30:00+02:00' ELSE '2024-03-01 09:15:00' END AS scan_time_text,
  CASE o_orderkey % 3 WHEN 0 THEN '["a","b"]' WHEN 1 THEN 'broken [' ELSE NULL END AS categories_json
FROM {orders}
"""

VIEWS = {
    "messages": MESSAGES, "hops": HOPS, "redirect_hops": REDIRECT_HOPS, "users": USERS,
    "networks": NETWORKS, "ips": IPS, "urls": URLS, "scans": SCANS, "attempts": ATTEMPTS,
    "enforceable": ENFORCEABLE, "release_requests": RELEASE_REQUESTS,
    "relay_outcomes": RELAY_OUTCOMES, "reputation": REPUTATION,
    "attachment_payloads": ATTACHMENT_PAYLOADS, "legacy_scans": LEGACY_SCANS,
}


def view_sql(name: str) -> str:
    """The view as plain SQL over the base tables registered under their own names."""
    return VIEWS[name].format(**{t: t for t in BASE_TABLES})


TEXT_TABLES = ("documents", "pages")


PARTITIONS = "mailsleuth.text.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Where the session asks for a number of partitions, deal text tables to that many: one small file is else one
    task. Large tables are read as they are split; the setting is never derived from the data."""
    wanted = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df


class Views:
    """Spark side of the views; a view is read lazily and only its base tables are opened."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, table: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        return spread(df) if table in TEXT_TABLES else df

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[name]
        used = [t for t in BASE_TABLES if "{" + t + "}" in text]
        return self.spark.sql(text, **{t: self.base(t) for t in used})
