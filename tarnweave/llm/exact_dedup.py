"""Exact dedup through Patricia-trie owners.

Texts are partitioned by length and content hash. A task inserts the full byte
strings of its input split into compressed radix tries, one a length band (the
bits of the length), and emits one row a distinct text (so a hot text leaves each
split about once). After a shuffle on length and hash a task gets its rows in order of band and
hash and merges them in tries, one a length band and hash range, where texts share their
prefixes. Terminal nodes hold the owner's identifier. A trie that outgrows its budget
spills by subtree, the largest first: in front of the shuffle a spilled row is merged behind
it; behind the shuffle a trie spills only between two hashes, when all of its texts are
complete, so spilled rows are results. Spilled subtrees leave with the task's output;
nothing is put on a local disk. A trie holds no more than its budget and one text (or the texts of one
length that collide in all 64 bits of the hash).

Defined results: null text counts as empty; null identifiers never own a text
unless all of its rows have none; rows that repeat an owner's identifier and
text are all marked kept by ``trie_owners`` and reduced to one by
``drop_exact_duplicates``; identifiers are compared in their own type (numbers, strings by
code points); very long texts are compared whole; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, small_batches

#: Bytes that a trie holds before it spills, and hash ranges of a length band.
TRIE_BYTES, RANGE_BITS = 32 << 20, 4
#: Rough bytes of a node beside its edge.
NODE_BYTES = 200
OUT_ROWS, OUT_BYTES = 4096, 4 << 20


class Node:
    __slots__ = ("edge", "children", "owner", "size", "owned", "end")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.end = edge, {}, False
        self.owner, self.size, self.owned = None, 0, 0

    def cost(self) -> int:
        return len(self.edge) + NODE_BYTES


class PatriciaTrie:
    """Compressed radix trie over byte strings; a terminal keeps owner, rows, and rows of the owner."""

    def __init__(self, smallest: bool = True):
        self.root, self.smallest, self.held = Node(b""), smallest, 0

    def _merge(self, node: Node, owner, size: int, owned: int) -> None:
        if not node.end:
            node.end, node.owner, node.size, node.owned = True, owner, size, owned
            return
        node.size += size
        if node.owner == owner:
            node.owned += owned
        elif node.owner is None or owner is not None and (owner < node.owner) == self.smallest:
            node.owner, node.owned = owner, owned

    def insert(self, text: bytes, owner, size: int = 1, owned: int = 1) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.held += child.cost()
                node = child
                break
            edge = child.edge
            if text.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            low, high = 1, min(len(edge), len(text) - at)
            while low < high:  # longest common part, by halving
                mid = (low + high + 1) // 2
                if text.startswith(edge[:mid], at):
                    low = mid
                else:
                    high = mid - 1
            middle = Node(edge[:low])
            child.edge = edge[low:]
            middle.children[child.edge[0]] = child
            node.children[text[at]] = middle
            self.held += NODE_BYTES
            node, at = middle, at + low
        self._merge(node, owner, size, owned)

    @staticmethod
    def walk(node: Node, prefix: bytes) -> Iterator[tuple]:
        """(text, owner, size, owned) of every terminal of a subtree; ``prefix`` ends with the node's edge."""
        stack = [(node, prefix)]
        while stack:
            node, text = stack.pop()
            if node.end:
                yield text, node.owner, node.size, node.owned
            stack.extend((c, text + c.edge) for c in node.children.values())

    def spill(self, upto: int) -> Iterator[tuple]:
        """Cut off the largest subtrees, and give their terminals, until at most ``upto`` bytes are held."""
        above, order = {}, [self.root]
        for node in order:  # parents first
            for first, child in node.children.items():
                above[child] = node, first
                order.append(child)
        weight = {}
        for node in reversed(order):
            weight[node] = node.cost() + sum(weight[c] for c in node.children.values())
        heap = [(-weight[c], i, c, c.edge) for i, c in enumerate(self.root.children.values())]
        heapq.heapify(heap)
        ticket = len(heap)
        while heap and self.held > upto:
            _, _, node, text = heapq.heappop(heap)
            if weight[node] - node.cost() >= self.held - upto:  # its parts are enough: look among them
                for c in node.children.values():
                    heapq.heappush(heap, (-weight[c], ticket, c, text + c.edge))
                    ticket += 1
                continue
            yield from self.walk(node, text)
            self.held -= weight[node]
            parent, first = above[node]
            del parent.children[first]
            while parent is not self.root and not parent.end and not parent.children:  # nothing hangs on it any more
                self.held -= parent.cost()
                grand, first = above[parent]
                del grand.children[first]
                parent = grand

    def drain(self) -> Iterator[tuple]:
        """All terminals, and the trie is empty."""
        yield from self.walk(self.root, b"")
        self.root, self.held = Node(b""), 0


def _tries(smallest: bool, budget: int, merging: bool, schema: pa.Schema):
    """Rows (band, hash, body, owner, size, owned) merged in tries.

    ``merging``: rows come by band and hash; a trie ends with its band and hash range and spills between hashes.
    Otherwise rows come in any order; all bands' tries are held together, and the largest spills when they outgrow the budget.
    """

    def run(batches):
        tries, out, out_bytes, last = {}, [], 0, None

        def emit():
            nonlocal out, out_bytes
            arrays = [pa.array(x, f.type) for x, f in zip(zip(*out), schema)]
            out, out_bytes = [], 0
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        def given(rows):
            nonlocal out_bytes
            for row in rows:
                out.append(row)
                out_bytes += len(row[0])
                if out_bytes > OUT_BYTES or len(out) >= OUT_ROWS:
                    yield emit()

        for b in batches:
            bands, hashes, bodies = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            for i, (band, digest, owner, size, owned) in enumerate(zip(bands, hashes, *(b.column(c).to_pylist() for c in (3, 4, 5)))):
                if merging:
                    key, place = (band, digest >> (64 - RANGE_BITS)), (band, digest)
                    if place != last:
                        if key not in tries:
                            for trie in tries.values():
                                yield from given(trie.drain())
                            tries = {key: PatriciaTrie(smallest)}
                        while tries[key].held > budget:
                            yield from given(tries[key].spill(budget // 2))
                        last = place
                else:
                    key = band
                    if key not in tries:
                        tries[key] = PatriciaTrie(smallest)
                    while (total := sum(t.held for t in tries.values())) > budget:
                        most = max(tries.values(), key=lambda t: t.held)
                        yield from given(most.spill(max(0, most.held - total + budget // 2)))
                tries[key].insert(bodies[i].as_py(), owner, size, owned)
        for trie in tries.values():
            yield from given(trie.drain())
        if out:
            yield emit()

    return run


def trie_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smallest: bool = True, budget: int = TRIE_BYTES) -> DataFrame:
    """One row a distinct text: body, owner, size (rows), owned (rows that carry the owner's identifier)."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    schema = T.StructType(
        [T.StructField("body", T.BinaryType()), T.StructField("owner", docs.schema[id_col].dataType), T.StructField("size", T.LongType()), T.StructField("owned", T.LongType())]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def placed(rows: DataFrame) -> DataFrame:
        band = F.length(F.bin(F.octet_length("body"))).alias("band")
        return rows.select(band, F.xxhash64("body").alias("hash"), "body", "owner", "size", "owned")

    one = F.lit(1).cast("long")
    flat = docs.select(body.alias("body"), F.col(id_col).alias("owner"), one.alias("size"), one.alias("owned"))
    local = placed(flat).mapInArrow(_tries(smallest, budget, False, arrow), schema)
    dealt = placed(local).repartition(F.octet_length("body"), "hash").sortWithinPartitions("band", "hash")
    return dealt.mapInArrow(_tries(smallest, budget, True, arrow), schema)


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smallest: bool = True, budget: int = TRIE_BYTES) -> DataFrame:
    """One row an input row: id, keep_id, group_size, kept, text_sha256 (and owned, how many rows the owner has)."""
    owners = trie_owners(docs, id_col, text_col, smallest, budget).select(
        F.sha2(F.col("body"), 256).alias("text_sha256"), F.col("owner").alias("keep_id"), F.col("size").alias("group_size"), "owned"
    )
    rows = docs.select(F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("text_sha256"))
    return rows.join(owners, "text_sha256").select(
        F.col(id_col), "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "owned"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smallest: bool = True) -> DataFrame:
    """``docs`` with one row of each text, columns unchanged.

    Where several rows share the owner's identifier and text, the one that is first by
    the hash of all its columns stays (any one, if they are wholly equal).
    """
    sha = fresh(docs, "_sha")
    owners = trie_owners(docs, id_col, text_col, smallest)
    own = owners.select(F.sha2(F.col("body"), 256).alias(sha), F.col("owner").alias(sha + "o"), F.col("owned").alias(sha + "n"))
    rows = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    kept = rows.join(own, [sha]).where(F.col(id_col).eqNullSafe(F.col(sha + "o")))
    once = kept.where(F.col(sha + "n") == 1).select(*docs.columns)
    rank = Window.partitionBy(sha, id_col).orderBy(F.xxhash64(*docs.columns))
    twice = kept.where(F.col(sha + "n") > 1).withColumn(sha + "r", F.row_number().over(rank)).where(F.col(sha + "r") == 1).select(*docs.columns)
    return once.unionByName(twice)
