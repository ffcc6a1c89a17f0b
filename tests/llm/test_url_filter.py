import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.llm.queries import URL_RULES
from tarnweave.llm.url_filter import best_rule, host_edges, judge_urls, propagate, rounds_for, split_url
from tarnweave.plans.lineage import Scratch


def test_split_and_rules(spark):
    urls = {
        "http://WWW.Example.com/en/7?x": ("www.example.com", "/en/7", "example.com/en/7"), "https://a.com/en/1#f": ("a.com", "/en/1", "com/en/"), "a.b": ("", "", None), None: ("", "", None),
        "http://h.net?de=/de/": ("h.net", "", None), "x://m.example.net/de/81": ("m.example.net", "/de/81", "example.net/de/8"), "http://notexample.com/en": ("notexample.com", "/en", None),
        "http://u.org/es/http://v.net/de/": ("u.org", "/es/http://v.net/de/", "org/es/"), "http://": ("", "", None), "http://com/en/": ("com", "/en/", "com/en/"), "http://myexample.com/en/7": ("myexample.com", "/en/7", "com/en/"),
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = split_url(F.col("url"))
    df = df.select("url", host.alias("h"), path.alias("p"))
    got = {r.url: (r.h, r.p, r.r) for r in df.select("url", "h", "p", best_rule(F.col("h"), F.col("p"), URL_RULES)["rule"].alias("r")).collect()}
    assert got == urls


def test_propagation(spark):
    link = lambda *hosts: "".join(f"<a class=x href='http://{h}/y'>t</a>" for h in hosts)
    pages = [
        (1, "http://good.example.net/de/1", link("fine.org", "good.example.net")), (2, "http://fine.org/x", link("plain.org")), (3, "http://plain.org/x", ""),
        (4, "http://bad.com/en/1", ""), (5, "http://farm.org/a", link("bad.com", "BAD.com:80")), (6, "http://feeder.org/a", link("farm.org")), (7, "http://alone.org/a", None), (8, None, link("bad.com")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {tuple(r) for r in host_edges(df).collect()} == {("good.example.net", "fine.org"), ("fine.org", "plain.org"), ("farm.org", "bad.com"), ("feeder.org", "farm.org")}
    got = {r.id: r for r in judge_urls(df, URL_RULES, tolerance=0.02).collect()}
    assert {k: v.verdict for k, v in got.items()} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow", 8: "allow"}
    assert {k: v.rule for k, v in got.items() if v.rule} == {1: "net/de/", 4: "com/en/"}
    # mass by hand: a seed, one step on, two steps on, what dead ends hold going back to the seed
    trust = {h: next(r.trust for r in got.values() if r.host == h) for h in ("good.example.net", "fine.org", "plain.org")}
    assert abs(trust["fine.org"] - 0.85 * trust["good.example.net"]) < 0.02 and abs(trust["plain.org"] - 0.85 * trust["fine.org"]) < 0.02
    assert abs(sum(trust.values()) - 1) < 1e-6


def test_masses_against_matrix(spark):
    rng = random.Random(6)
    hosts = [f"h{k}" for k in range(30)]
    edges = {(a, b) for a, b in ((rng.choice(hosts), rng.choice(hosts[:25])) for _ in range(60)) if a != b}
    weight = {h: rng.random() for h in hosts[:7]}
    seed = np.array([weight.get(h, 0) for h in hosts]) / sum(weight.values())
    step = np.zeros((30, 30))
    for a, b in edges:
        step[hosts.index(b), hosts.index(a)] = 1 / sum(x == a for x, _ in edges)
    step += np.outer(seed, step.sum(0) == 0)  # dead ends give back to the seeds
    want = np.linalg.solve(np.eye(30) - 0.85 * step, 0.15 * seed)
    tables = [spark.createDataFrame(x, y) for x, y in (([(h,) for h in hosts], "host string"), (sorted(edges), "src string, dst string"), ([(h, float(w)) for h, w in zip(hosts, seed) if w], "host string, weight double"))]
    got = {r.host: r.mass for r in propagate(*tables, Scratch(spark, "test"), tolerance=1e-3).collect()}
    assert [got[h] for h in hosts] == pytest.approx(want.tolist(), abs=1e-3)
    assert rounds_for(0.85, 1e-6) < 100


def test_hosts_that_rules_touch_in_part_are_seeds(spark):
    """Pages of a host that no rule covers are judged by what rules say of its other pages, and of hosts that link to or from it."""
    pages = [
        (1, "http://a.com/en/1", ""), (2, "http://a.com/en/2", ""), (3, "http://a.com/fr/1", ""), (4, "http://b.net/de/1", ""), (5, "http://b.net/en/1", "<a href=//user@C.org:81/x>"),
        (6, "http://c.org/en/1", "<a href='/en/2'>"), (7, "http://user@d.org:8080/en/1", "<a href='https://a.com/'>"), (8, "http://D.org/es/1", ""), (9, "http://c.org/es/1", ""), *((20 + k, f"http://c.org/en/{k}", "") for k in range(20)),
    ]
    got = {r.id: r for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES, tolerance=1e-2).collect()}
    assert got[3].verdict == "block" and got[3].rule is None and got[3].distrust > got[3].trust  # two of three pages are blocked
    assert got[5].verdict == "allow" and got[5].trust > got[5].distrust  # half of its pages are allowed
    assert got[7].verdict == "block" and got[7].host == "user@d.org:8080"  # d.org: half of its pages are blocked, and it links to a blocked host
    assert got[9].verdict == "block" and got[6].verdict == "allow" and got[6].trust > got[6].distrust > 0  # one page of 22, and a trusted host links to it


def test_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, host string, verdict string")
    assert judge_urls(empty, URL_RULES).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "", ""), (1, "", "")], "page_id long, url string, html string")
    assert [(r.host, r.path, r.rule, r.verdict) for r in judge_urls(odd, URL_RULES).collect()] == [("", "", None, "allow")] * 3
