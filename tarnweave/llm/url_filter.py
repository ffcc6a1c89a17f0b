"""URL filters: host and path rules, then link-graph propagation for what no rule covers.

Rules fit a host and its subdomains where the path starts with the rule's; the longest
wins. Every host some of whose pages a rule allows (blocks) is a trusted (blocked) seed; its
weight is the share of its pages that rules allow (block), so a host's size plays no part.
Trust is personalised PageRank from trusted seeds along host edges; distrust is the same
from blocked seeds along reversed edges. A host is blocked where its distrust, as a
multiple of the mean host's share, reaches ``least`` and exceeds its trust; a host that
neither reaches has no mass of either kind and is allowed.

Host edges come from absolute and protocol-relative links in the pages, one an ordered pair
of hosts (relative links stay on their host). In the graph a host is known without user and
port; what is returned is as the url spells it. All state is kept by host in DataFrames;
rounds are written to the shared folder and go on until the masses move by less than
``tolerance`` in all (``rounds`` is a bound that damping makes sure to suffice; going beyond
raises).

Defined results: a null url, or one without ``://``, has empty host and path and is
allowed; no seeds, or no edges, leave only the seeds judged; ties of equal rules go to the
earlier one, of equal masses to allow; repeated rows are judged alike; very long pages are
read whole; an empty table gives an empty result; other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import blocked, blocked_matvec
from ..plans.lineage import dealt
from .common import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute or scheme-relative targets of links; group 1 is the host.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (up to ``?``, ``#`` or the end)."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null. Rules are (verdict, host, path); the earlier wins a tie."""
    fits = []
    for k, (verdict, name, prefix) in enumerate(rules):
        text = name + prefix
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        fits.append(F.when(fit, F.struct(F.lit(len(text)).alias("length"), F.lit(-k).alias("k"), F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))))
    return reduce(lambda a, b: F.when(a.isNull() | (b > a), b).otherwise(a), fits[1:], fits[0]) if len(fits) > 1 else fits[0]


def known_as(host: Column) -> Column:
    """A host in the graph: lower case, no user, no port."""
    return F.regexp_replace(F.translate(host, _UPPER, _LOWER), r"^[^@]*@|:\d+$", "")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (src, dst) between different hosts."""
    host, _ = split_url(F.col(url_col))
    links = pages.select(known_as(host).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", known_as(F.col("dst")).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").distinct()


def rounds_for(damping: float, tolerance: float) -> int:
    """Rounds after which masses move by less than ``tolerance``: a round moves them by at most ``damping`` times what the one before did, the first by 2."""
    return math.ceil(math.log(tolerance / 2) / math.log(damping)) + 1


def propagate(hosts: DataFrame, edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(host, mass): personalised PageRank of ``seeds`` (host, weight; weights sum to 1); what dead ends hold goes back to the seeds.

    The edges are dealt by source once, those of hub hosts evenly beside them; a round shuffles pre-aggregated sums and the hosts' masses,
    and its write counts how far masses moved and what dead ends hold.
    """
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    matrix = blocked(edges.join(out, "src").select(F.col("dst").alias("row"), F.col("src").alias("col"), (F.lit(1.0) / F.col("degree")).alias("val")), scratch)
    held = F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("mass"))), F.lit(0.0))  # by dead ends
    base = hosts.join(seeds, "host", "left").join(out.withColumnRenamed("src", "host"), "host", "left").select("host", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("degree", F.lit(0)).alias("degree"))
    base, seen = scratch.cut_counting(base.withColumn("mass", F.col("weight")), stuck=held)
    now, base = base.select("host", "mass"), dealt(base.select("host", "weight", "degree"), "host")
    previous, left, moved, stuck = None, rounds_for(damping, tolerance), 1.0, seen["stuck"]
    while moved >= tolerance:
        if not left:
            raise RuntimeError(f"masses still move by {moved}, which damping rules out")
        left -= 1
        got = blocked_matvec(matrix, now.select(F.col("host").alias("id"), F.col("mass").alias("value"))).select(F.col("id").alias("host"), F.col("value").alias("got"))
        after = base.join(now.withColumnRenamed("mass", "old"), "host").join(got, "host", "left").withColumn(
            "mass", F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(stuck) * F.col("weight")) + F.lit(1 - damping) * F.col("weight")
        )
        after, seen = scratch.cut_counting(after, ["host", "mass"], moved=F.coalesce(F.sum(F.abs(F.col("mass") - F.col("old"))), F.lit(0.0)), stuck=held)
        moved, stuck = seen["moved"], seen["stuck"]
        if previous is not None:
            scratch.drop(previous)
        now = previous = after
    base.unpersist()
    matrix.unpersist()
    return now


def judge_hosts(ruled: DataFrame, edges: DataFrame, scratch: Scratch, least: float = 1.0, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, allowed, blocked, trust, distrust, host_verdict) of every host that has a page or a link. ``ruled``: node (host) and verdict (null without a rule) of each page."""
    share = lambda verdict: (F.count_if(F.col("verdict") == verdict) / F.count(F.lit(1))).alias(verdict + "ed")
    pages = ruled.where("node <> ''").groupBy(F.col("node").alias("host")).agg(share("allow"), share("block"))
    linked = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    hosts = scratch.cut(pages.join(linked, "host", "full").select("host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("allowed", "blocked")]))
    n_hosts, allowed, blocked = hosts.agg(F.count(F.lit(1)), F.sum("allowed"), F.sum("blocked")).first()
    masses = []
    for kind, total, graph in (("allowed", allowed, edges), ("blocked", blocked, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))):
        seeds = hosts.where(F.col(kind) > 0).select("host", (F.col(kind) / F.lit(total or 1.0)).alias("weight"))
        masses.append(propagate(hosts.select("host"), graph, seeds, scratch, damping, tolerance))
    trust, distrust = masses[0].withColumnRenamed("mass", "trust"), masses[1].withColumnRenamed("mass", "distrust")
    bad = (F.col("distrust") * n_hosts >= least) & (F.col("distrust") > F.col("trust"))
    judged = hosts.join(trust, "host").join(distrust, "host").withColumn("host_verdict", F.when(bad, "block").otherwise("allow"))
    return judged.withColumnRenamed("host", "node")


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 1.0, damping: float = 0.85, tolerance: float = 1e-6
) -> DataFrame:
    """One row an input row: id, host, path, rule (null without one), verdict, trust and distrust of the host."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    ruled = ruled.select("id", "host", "path", known_as(F.col("host")).alias("node"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    edges = scratch.cut(host_edges(pages, url_col, html_col))
    hosts = judge_hosts(ruled, edges, scratch, least, damping, tolerance).drop("allowed", "blocked")
    return ruled.join(hosts, "node", "left").select("id", "host", "path", "rule", F.coalesce("verdict", "host_verdict", F.lit("allow")).alias("verdict"), "trust", "distrust")
