import hashlib
import random

import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from tarnweave.llm.exact_dedup import NODE_BYTES, PatriciaTrie, _tries, drop_exact_duplicates, mark_duplicates, trie_owners


@given(st.lists(st.tuples(st.binary(max_size=6), st.one_of(st.none(), st.integers(0, 9)))), st.booleans(), st.sampled_from([1, 700, 1 << 20]))
def test_trie_against_a_dictionary(rows, smallest, budget):
    """What is spilled and what stays, merged in a second trie, is what a dictionary holds."""
    trie, behind, want = PatriciaTrie(smallest), PatriciaTrie(smallest), {}
    for text, owner in rows:
        trie.insert(text, owner)
        want.setdefault(text, []).append(owner)
        while trie.held > budget:
            for row in trie.spill(budget // 2):
                behind.insert(*row)
    assert trie.held == weight(trie)
    for row in trie.drain():
        behind.insert(*row)
    assert behind.held == weight(behind)
    got = {t: (o, n, m) for t, o, n, m in behind.drain()}
    pick = min if smallest else max
    best = {t: pick((x for x in ids if x is not None), default=None) for t, ids in want.items()}
    assert got == {t: (best[t], len(ids), ids.count(best[t])) for t, ids in want.items()}


def weight(trie):
    nodes = [trie.root]
    for node in nodes:
        nodes.extend(node.children.values())
        assert node is trie.root or node.end or node.children
    return sum(n.cost() for n in nodes[1:])


def test_prefixes_are_shared():
    trie = PatriciaTrie()
    for k in range(500):
        trie.insert(b"the same long opening " * 100 + b"%03d" % k, k)
    assert trie.held < 2200 + 600 * (NODE_BYTES + 4)
    gone = [t for t, *_ in trie.spill(trie.held // 2)]
    assert 100 < len(gone) < 400 and len(gone) + len(list(trie.drain())) == 500


def test_tries_of_the_table_share_and_spill(spark, monkeypatch):
    """Through the merging stage: several texts a trie, spills on the way, and each text once."""
    texts = sorted({f"head {k % 7} " + "x" * (k % 40) + str(k % 300) for k in range(1200)})
    rows = sorted((len(bin(len(t))) - 2, hash(t) >> 1, t.encode(), n, 1, 1) for t in texts for n in range(3))
    schema = pa.schema([("body", pa.binary()), ("owner", pa.int64()), ("size", pa.int64()), ("owned", pa.int64())])
    made, spilled = [], []
    start, spill = PatriciaTrie.__init__, PatriciaTrie.spill
    monkeypatch.setattr(PatriciaTrie, "__init__", lambda self, *a: (made.append(1), start(self, *a))[1])
    monkeypatch.setattr(PatriciaTrie, "spill", lambda self, upto: (spilled.append(1), spill(self, upto))[1])
    columns = [pa.array(c) for c in zip(*rows)]
    batch = pa.RecordBatch.from_arrays(columns, names=list("abcdef"))
    halves = [batch.slice(0, 1000), batch.slice(1000)]
    for budget in (2000, 1 << 25):
        made.clear(), spilled.clear()
        got = [r for b in _tries(True, budget, True, schema)(iter(halves)) for r in b.to_pylist()]
        assert sorted((r["body"].decode(), r["owner"], r["size"], r["owned"]) for r in got) == [(t, 0, 3, 1) for t in texts]
        assert len(made) < len(texts) / 5 and bool(spilled) == (budget == 2000)
    local = [r for b in _tries(True, 2000, False, schema)(iter(halves)) for r in b.to_pylist()]
    assert sum(r["size"] for r in local) == len(rows) and spilled
    docs = spark.createDataFrame([(n, t) for t in texts for n in range(3)], "doc_id long, text string")
    got = trie_owners(docs.repartition(3), budget=2000).collect()  # workers do not see the counters; the rows must be right
    assert sorted((r.body.decode(), r.owner, r.size, r.owned) for r in got) == [(t, 0, 3, 1) for t in texts]


def test_marks(spark):
    rng = random.Random(3)
    rows = [(d, "abc " * rng.randint(0, 6) + rng.choice(["", "x", "y"])) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    for smallest, pick in ((True, min), (False, max)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in mark_duplicates(docs, smallest=smallest, budget=300).collect()}
        assert got == {d: (pick(groups[t]), len(groups[t]), pick(groups[t]) == d, hashlib.sha256(t.encode()).hexdigest()) for d, t in rows}


def test_edges(spark, nasty, nothing):
    got = mark_duplicates(nasty, smallest=False).collect()
    assert len(got) == nasty.count()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id in (1, 2)} == {(2, 2)}
    assert sorted((r.doc_id or 0, r.kept) for r in got if r.group_size == 4) == [(0, False), (5, False), (6, True), (6, True)]
    kept = drop_exact_duplicates(nasty)
    assert kept.columns == nasty.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == nasty.select("text").na.fill("").distinct().count()
    # an owner that stands twice stays once
    twice = spark.createDataFrame([(1, "a", "p"), (1, "a", "q"), (2, "a", "r"), (None, "b", "s"), (None, "b", "s")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id or 0, r.text) for r in drop_exact_duplicates(twice).collect()) == [(0, "b"), (1, "a")]
    assert mark_duplicates(nothing).count() == 0 and drop_exact_duplicates(nothing).count() == 0
    # identifiers of any type that has an order
    named = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("c", None)], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.keep_id, r.group_size) for r in mark_duplicates(named).collect()) == [("", "a", 3), ("a", "a", 3), ("b", "a", 3), ("c", "c", 1)]
