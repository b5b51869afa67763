"""Threat graph, campaigns, playbooks, detection rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R
from .analyst import list_of
from ..session import stored
from .components import components, grow_components, kept_components


def _domain(sender: Column) -> Column:
    t = F.trim(sender)
    return F.when(F.contains(t, F.lit("@")), F.substring_index(t, "@", -1)).otherwise(t)


def _host(url: Column) -> Column:
    return F.substring_index(F.replace(F.replace(url, F.lit("http://"), F.lit("")), F.lit("https://"), F.lit("")), "/", 1)


def _domain_id(sender: Column) -> Column:
    return F.concat(F.lit("domain_"), F.lower(_domain(sender)))


def _recipient_id(receiver: Column) -> Column:
    return F.concat(F.lit("recip_"), F.lower(receiver))


def _url_id(host: Column) -> Column:
    return F.concat(F.lit("url_"), F.lower(host))


def _mentions(scans: DataFrame, url_cap: int | None, *carried: str) -> DataFrame:
    """(scan, node) rows of all four node kinds from one scan of the table, with ``carried`` columns."""
    d = _domain(F.col("sender"))
    label = F.when(
        F.coalesce("subject", F.lit("")) == "", F.concat(F.lit("Email #"), F.col("scan_id").cast("string"))).otherwise(F.col("subject"))
    node = lambda kind, node_id, text, risk, edge: F.struct(F.lit(kind).alias("node_group"), node_id.alias("node_id"), text.alias("label"), risk.alias("risk"), F.lit(edge).alias("edge"))
    sender_risk = F.when(F.col("verdict").isin("High Risk", "Medium Risk"), F.col("verdict")).otherwise("Low Risk")
    url_risk = F.when(F.col("verdict") == "High Risk", "High Risk").otherwise("Medium Risk")
    nodes = F.concat(
        F.array(node("email", F.concat(F.lit("email_"), F.col("scan_id").cast("string")), label, F.col("verdict"), None)),
        F.when(F.coalesce("sender", F.lit("")) != "", F.array(node("domain", _domain_id(F.col("sender")), d, sender_risk, "SENT_BY"))).otherwise(F.array()),
        F.when(F.coalesce("receiver", F.lit("")) != "", F.array(node("recipient", _recipient_id(F.col("receiver")), F.col("receiver"), F.lit("Safe"), "TARGETS"))).otherwise(F.array()),
        F.transform(list_of("urls_text") if url_cap is None else F.slice(list_of("urls_text"), 1, url_cap), lambda u: node("url", _url_id(_host(u)), _host(u), url_risk, "CONTAINS_LINK")))
    return scans.select("scan_id", "scan_time", *carried, F.posexplode(nodes).alias("pos", "n")).select("scan_id", "scan_time", *carried, "pos", "n.*")


def graph_nodes(scans: DataFrame, url_cap: int | None = None) -> DataFrame:
    """Distinct nodes; attributes come from the newest scan that mentions the node. A hub that every
    scan mentions is combined on the map side (max_by), never sorted as one group."""
    m = _mentions(scans, url_cap)
    best = F.max_by(F.struct("node_group", "label", "risk"), F.struct("scan_time", "scan_id", -F.col("pos")))
    return m.groupBy("node_id").agg(best.alias("a"), F.count_distinct("scan_id").alias("emails")).select("node_id", "a.*", "emails")


def graph_edges(scans: DataFrame, url_cap: int | None = None) -> DataFrame:
    m = _mentions(scans, url_cap).where(F.col("edge").isNotNull())
    return m.select(F.concat(F.lit("email_"), F.col("scan_id").cast("string")).alias("src"), F.col("node_id").alias("dst"), F.col("edge").alias("label")).distinct()


def newest_scans(scans: DataFrame, n: int | None) -> DataFrame:
    """The graph page shows the newest scans only; None takes all."""
    return scans if n is None else scans.orderBy(F.col("scan_time").desc(), F.col("scan_id").desc()).limit(n)


def capped_graph(scans: DataFrame, max_scans: int | None = None, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the page; edges to nodes that were cut are dropped with them."""
    picked = newest_scans(scans, max_scans)
    nodes, edges = graph_nodes(picked), graph_edges(picked)
    if max_nodes is None:
        return nodes, edges
    nodes = nodes.orderBy("node_group", "node_id").limit(max_nodes)
    keep = nodes.select("node_id")
    return nodes, edges.join(keep.select(F.col("node_id").alias("src")), "src", "left_semi").join(keep.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst", "label")


def graph_summary(scans: DataFrame) -> DataFrame:
    nodes = graph_nodes(scans).agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if(F.col("risk") == "High Risk").alias("high_risk_nodes"), F.count_if(F.col("node_group") == "email").alias("total_emails"))
    edges = graph_edges(scans).agg(F.count(F.lit(1)).alias("total_edges"))
    return nodes.select("total_emails", "total_nodes", edges.scalar().alias("total_edges"), "high_risk_nodes")


def campaigns(scans: DataFrame, url_cap: int | None = None) -> DataFrame:
    """Nodes that connect more than one mail, with the mails' numbers and risk."""
    m = _mentions(scans, url_cap, "risk_score", "verdict").where(F.col("edge").isNotNull())
    g = m.groupBy("node_id", "node_group").agg(
        F.count_distinct("scan_id").alias("emails"), F.max("risk_score").alias("max_risk"), F.count_if(F.col("verdict") == "High Risk").alias("high_risk_mentions"),
        F.min("scan_time").alias("first_seen"), F.max("scan_time").alias("last_seen"))
    return g.where(F.col("emails") > 1)


def _scan_nodes(scans: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(scan_id, nodes): the distinct node ids of the wanted kinds that a row mentions, sorted; row-local."""
    some = lambda kind, column, ids: [F.when(F.coalesce(column, F.lit("")) != "", ids).otherwise(F.array())] if kind in kinds else []
    ids = [*some("domain", "sender", F.array(_domain_id(F.col("sender")))), *some("recipient", "receiver", F.array(_recipient_id(F.col("receiver")))),
           *([F.transform(list_of("urls_text"), lambda u: _url_id(_host(u)))] if "url" in kinds else [])]
    return scans.select("scan_id", F.coalesce(F.array_sort(F.array_distinct(F.concat(F.array().cast("array<string>"), *ids))), F.array().cast("array<string>")).alias("nodes"))


def _node_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct sets of nodes (nodes, low) and the nodes (node_id, low) with the smallest scan of each. Both are combined
    before the shuffle, so that a node of very many mails is one row a task."""
    sets = stored(rows.where(F.col("scan_id").isNotNull() & (F.size("nodes") > 0)).groupBy("nodes").agg(F.min("scan_id").alias("low")), "node-sets")
    return sets, stored(sets.select(F.explode("nodes").alias("node_id"), "low").groupBy("node_id").agg(F.min("low").alias("low")), "node-roots")


def _node_links(sets: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes of one set, every node named by the scan that ``ends`` (node_id, low) gives it. Nodes that have
    the same scan share that mail, so they are rightly one vertex."""
    pairs = sets.select(F.col("nodes")[0].alias("x"), F.explode(F.slice("nodes", F.lit(2), F.size("nodes"))).alias("y")).distinct()
    end = lambda c, to: ends.select(F.col("node_id").alias(c), F.col("low").alias(to))
    return stored(pairs, "node-pairs").join(end("x", "a"), "x").join(end("y", "b"), "y").where("a <> b").select("a", "b").distinct()


def _components_of_scans(rows: DataFrame, node_roots: DataFrame) -> DataFrame:
    """(scan_id, component) from the component of a row's first node, its others being in the same. Rows of one id tie their
    components together; that takes a further round of components only where there are such."""
    first = rows.select("scan_id", F.get("nodes", F.lit(0)).alias("node_id"))
    at = stored(first.join(node_roots, "node_id", "left").select("scan_id", F.when(F.col("scan_id").isNotNull(), F.coalesce("root", "scan_id")).alias("root")), "scan-roots")
    each = stored(at.groupBy("scan_id").agg(F.min("root").alias("root"), F.max("root").alias("last")), "scan-components")
    apart = each.where("root <> last")
    if not apart.take(1):
        return each.select("scan_id", F.col("root").alias("component"))
    tied = stored(apart.select("scan_id", F.col("root").alias("b")), "repeated-scans")
    more = components(at.join(tied, "scan_id").select(F.col("root").alias("a"), "b"), "repeated").select(F.col("v").alias("root"), F.col("root").alias("top"))
    return each.join(more, "root", "left").select("scan_id", F.coalesce("top", "root").alias("component"))


def campaign_components(scans: DataFrame, kinds: tuple[str, ...] = ("domain", "url")) -> DataFrame:
    """Connected groups of mails over shared nodes: (scan_id, component), component = smallest scan id.

    The graph is that of the nodes, linked where a mail has both, not of the mails: however many mails share a node, it is one
    vertex, named by its smallest scan. A mail takes the component of its first node by a join of two stored tables."""
    rows = stored(_scan_nodes(scans, kinds), "scan-nodes")
    sets, ends = _node_sets(rows)
    roots = components(_node_links(sets, ends), "campaigns")
    node_roots = stored(ends.join(roots.withColumnRenamed("v", "low"), "low", "left").select("node_id", F.coalesce("root", "low").alias("root")), "node-components")
    return _components_of_scans(rows, node_roots)


NODE_ROW = "node_id string, scan_id long, step long"


def grow_campaigns(nodes, parents, scans: DataFrame, batch_id: int, kinds: tuple[str, ...] = ("domain", "url")) -> None:
    """Add a batch of scans to the kept campaigns: ``nodes`` (a ``KeyedTable`` of the row above, by ``node_id``) keeps one scan
    of every node, ``parents`` the forest of ``grow_components`` over these scans. A batch writes its new nodes and what
    it ties together, and, where it has a smaller scan of a known node, that one; no row for every scan.
    A batch that broke off between the two tables is completed by its replay, which finds the same nodes."""
    sets, own = _node_sets(_scan_nodes(scans, kinds))
    known = nodes.read(own).select("node_id", F.col("scan_id").alias("known"))
    own = stored(own.join(known, "node_id", "left").select("node_id", "known", "low"), "node-scans")
    nodes.upsert(own.where("known IS NULL").select("node_id", F.col("low").alias("scan_id"), F.lit(batch_id).cast("long").alias("step")), batch_id)
    smaller = own.where("low < known").select(F.col("known").alias("a"), F.col("low").alias("b"))
    grow_components(parents, _node_links(sets, own.select("node_id", F.coalesce("known", "low").alias("low"))).unionByName(smaller), batch_id)


def kept_campaigns(nodes, parents, scans: DataFrame, kinds: tuple[str, ...] = ("domain", "url")) -> DataFrame:
    """(scan_id, component) of scans that have been added, as ``campaign_components`` gives it, from the two kept tables."""
    kept, roots = stored(nodes.read().select("node_id", F.col("scan_id").alias("v")), "kept-nodes"), kept_components(parents)
    node_roots = stored(kept.join(roots, "v", "left").select("node_id", F.coalesce("root", "v").alias("root")), "node-components")
    return _components_of_scans(stored(_scan_nodes(scans, kinds), "scan-nodes"), node_roots)


# ---- response ------------------------------------------------------------------------------

def playbook_ids(score: Column, verdict: Column, categories: Column, findings_text: Column) -> Column:
    holds = lambda *words: F.exists(categories, lambda c: _any(c, words))
    hit = [("PB-101", (score >= 50) | (verdict == "High Risk")),
           ("PB-102", holds("Credential", "Password", "URL") | F.contains(findings_text, F.lit("Display Name Email Spoofing"))),
           ("PB-103", holds("Invoice", "BEC", "Financial"))]
    ids = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in hit]))
    return F.when(F.size(ids) == 0, F.array(F.lit("PB-100"))).otherwise(ids)


def _any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def playbooks(scans: DataFrame) -> DataFrame:
    """(scan_id, playbook_ids, actions): triggered playbooks and their actions in playbook order."""
    df = scans.withColumn("playbook_ids", playbook_ids(F.col("risk_score"), F.col("verdict"), list_of("categories_text"), F.coalesce("findings_text", F.lit(""))))
    texts = F.map_from_arrays(F.array(*[F.lit(p[0]) for p in R.PLAYBOOKS]), F.array(*[F.array(*[F.lit(a) for a in p[4]]) for p in R.PLAYBOOKS]))
    return df.select("scan_id", "playbook_ids", F.array_distinct(F.flatten(F.transform("playbook_ids", lambda i: texts[i]))).alias("actions"))


def scan_blocklist(scans: DataFrame, n: int | None = None) -> DataFrame:
    """Per scan: indicator domains without the sender's own, addresses and URLs (None: all, else n of each); sorted,
    so the same scan always gives the same list."""
    cut = lambda c: c if n is None else F.slice(c, 1, n)
    iocs = list_of("iocs_text")
    is_ip = lambda v: v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    own = F.lower(_domain(F.col("sender")))
    domains = F.array_sort(F.array_except(F.filter(iocs, lambda v: ~is_ip(v)), F.array(own)))
    return scans.select("scan_id", cut(domains).alias("domains"), cut(F.array_sort(F.array_distinct(F.filter(iocs, is_ip)))).alias("ips"),
                        cut(list_of("urls_text")).alias("urls"))


def fleet_blocklist(scans: DataFrame, min_score: int = 50) -> DataFrame:
    """Indicators of all triggered scans with their sightings."""
    hit = scans.where(F.col("risk_score") >= min_score)
    own = F.lower(_domain(F.col("sender")))
    values = F.array_distinct(F.filter(list_of("iocs_text"), lambda v: v != own))
    return hit.select("scan_id", F.explode(values).alias("ioc_value")).groupBy("ioc_value").agg(F.count(F.lit(1)).alias("sightings"))


def _rule_name(text: Column, prefix: str) -> Column:
    clean = F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9_]", "_"), "^_+|_+$", "")
    return F.concat(F.lit(prefix), F.when(clean == "", "phishing_email_detection").otherwise(clean))


def detection_rules(scans: DataFrame, product: str = "mailsleuth", prefix: str = "MailSleuth_Phish_") -> DataFrame:
    """One YARA and one Sigma text per scan. The Sigma id is a digest of the subject, so it is stable."""
    esc = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    subject = F.when(F.coalesce("subject", F.lit("")) == "", "Phishing Email Indicator").otherwise(F.trim("subject"))
    sender = F.trim(F.coalesce("sender", F.lit("")))
    finds = F.filter(F.transform(list_of("findings_text"), lambda f: F.trim(F.regexp_replace(f, r"[^a-zA-Z0-9\s]", ""))), lambda f: f != "")
    kinds = F.concat(F.array(F.struct(F.lit("subj").alias("k"), subject.alias("v"))),
                     F.when(sender != "", F.array(F.struct(F.lit("from").alias("k"), sender.alias("v")))).otherwise(F.array()),
                     F.transform(list_of("urls_text"), lambda u: F.struct(F.lit("url").alias("k"), u.alias("v"))),
                     F.transform(finds, lambda f: F.struct(F.lit("finding").alias("k"), f.alias("v"))))
    strings = F.array_join(F.transform(kinds, lambda s, i: F.concat(F.lit("        $"), s["k"], F.lit("_"), (i + 1).cast("string"), F.lit(' = "'), esc(s["v"]), F.lit('" nocase'))), "\n")
    name, score = _rule_name(subject, prefix), F.col("risk_score").cast("string")
    yara = F.concat(F.lit("rule "), name, F.lit(" {\n    meta:\n        description = \"Detection rule derived from a scanned e-mail\"\n        author = \""), F.lit(product),
                    F.lit("\"\n        severity = \""), F.col("verdict"), F.lit("\"\n        score = "), score, F.lit("\n\n    strings:\n"), strings, F.lit("\n\n    condition:\n        any of them\n}\n"))
    quote = lambda c: F.replace(c, F.lit('"'), F.lit(""))
    sigma = F.concat(F.lit("title: Phishing Email Indicator - "), F.regexp_replace(subject, r"[^a-zA-Z0-9\s_-]", ""), F.lit("\nid: "), F.substring(F.sha2(subject, 256), 1, 32),
                     F.lit("\nstatus: experimental\nauthor: "), F.lit(product), F.lit("\ntags:\n    - attack.initial_access\n    - attack.t1566.001\nlogsource:\n    category: email\n    product: m365\ndetection:\n"
                     "    selection_subject:\n        EmailSubject|contains: \""), quote(subject), F.lit("\"\n    selection_sender:\n        SenderAddress|contains: \""), quote(sender),
                     F.lit("\"\n    condition: selection_subject or selection_sender\nlevel: "), F.when(F.col("risk_score") >= 50, "high").otherwise("medium"), F.lit("\n"))
    return scans.select("scan_id", name.alias("rule_name"), yara.alias("yara"), sigma.alias("sigma"))
