"""DuckDB SQL for the registered queries. Iterations are unrolled into chains of materialised steps."""

from __future__ import annotations

from ..operators.clustering import OVERSAMPLING, ROUNDS
from .queries import BETA, EPSILON, K, KS, LLOYD_STEPS, MAX_DF, MIN_DF, REST, RESTARTS, STEPS

PASSES, CAP = 16, 16

RAW = """raw AS (SELECT o_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) AS dst FROM orders WHERE o_orderpriority = '1-URGENT'),
edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM raw)"""
NODES = "nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"
MATRIX = "matrix AS (SELECT dst AS row, src AS col, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS val FROM edges)"
VECTOR = "vec AS (SELECT c_custkey AS id, c_acctbal AS value FROM customer)"
PARTIALS = f"WITH {RAW}, {MATRIX}, {VECTOR}, parts AS (SELECT row, val * coalesce(value, 0.0) AS part FROM matrix LEFT JOIN vec ON id = col)"


LAST = f"a{LLOYD_STEPS}"


def _degrees(edges: str) -> str:
    return f"""SELECT id, sum(o)::BIGINT AS outs, sum(i)::BIGINT AS ins, max(l) AS loop FROM (
        SELECT src AS id, 1 AS o, 0 AS i, src = dst AS l FROM {edges} UNION ALL SELECT dst, 0, 1, src = dst FROM {edges}) GROUP BY id"""


def _alive(edges: str) -> str:
    return f"SELECT id FROM ({_degrees(edges)}) WHERE outs > 0 AND NOT (outs = 1 AND ins = 1 AND loop)"


def _peel() -> str:
    steps = [RAW, "e0 AS MATERIALIZED (SELECT * FROM edges)"]
    for k in range(PASSES):
        steps.append(f"a{k + 1} AS MATERIALIZED ({_alive(f'e{k}')})")
        steps.append(f"e{k + 1} AS MATERIALIZED (SELECT src, dst FROM e{k} WHERE dst IN (SELECT id FROM a{k + 1}))")
    return ", ".join(steps)


def _ranks(steps: int) -> str:
    """r0 .. r<steps>, each with the ranks after so many steps."""
    last = f"e{PASSES}"
    out = [
        _peel(),
        f"ids AS MATERIALIZED (SELECT src AS id FROM {last} UNION SELECT dst FROM {last})",
        f"m AS MATERIALIZED (SELECT dst AS row, src AS col, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS val FROM {last})",
        "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS value FROM ids)",
    ]
    for k in range(steps):
        out.append(
            f"r{k + 1} AS MATERIALIZED (SELECT ids.id, {BETA} * coalesce(s.value, 0.0) + {1 - BETA} / (SELECT count(*) FROM ids) AS value FROM ids "
            f"LEFT JOIN (SELECT row AS id, sum(val * r.value) AS value FROM m JOIN r{k} r ON r.id = m.col GROUP BY row) s ON s.id = ids.id)"
        )
    return ", ".join(out)


def _changes(steps: int) -> str:
    parts = [f"SELECT {k} AS step, (SELECT sum(abs(a.value - b.value)) FROM r{k} a JOIN r{k - 1} b USING (id)) AS change" for k in range(2, steps + 1)]
    return "changes AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def _converged() -> str:
    every = " UNION ALL ".join(f"SELECT {k} AS step, id, value FROM r{k}" for k in range(2, CAP + 1))
    return f"WITH {_ranks(CAP)}, {_changes(CAP)}, every AS ({every}), picked AS (SELECT id, round(value, 9) AS value FROM every WHERE step = (SELECT min(step) FROM changes WHERE change < {EPSILON}))"


def _push(cap: int = 48) -> str:
    """Residual steps, unrolled; those after the last active node change nothing."""
    last = f"e{PASSES}"
    out = [
        _peel(),
        f"ids AS MATERIALIZED (SELECT src AS id FROM {last} UNION SELECT dst FROM {last})",
        f"m AS MATERIALIZED (SELECT dst AS row, src AS col, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS val FROM {last})",
        f"least AS MATERIALIZED (SELECT {REST} / count(*) AS least FROM ids)",
        f"p0 AS MATERIALIZED (SELECT id, 0.0::DOUBLE AS rank, {1 - BETA} / (SELECT count(*) FROM ids) AS residual FROM ids)",
    ]
    for k in range(cap):
        out.append(
            f"p{k + 1} AS MATERIALIZED (SELECT id, rank + CASE WHEN residual > least THEN residual ELSE 0 END AS rank, CASE WHEN residual > least THEN 0 ELSE residual END + {BETA} * coalesce(got, 0.0) AS residual "
            f"FROM p{k} CROSS JOIN least LEFT JOIN (SELECT row AS id, sum(val * residual) AS got FROM m JOIN p{k} s ON s.id = m.col CROSS JOIN least WHERE residual > least GROUP BY row) g USING (id))"
        )
    return "WITH " + ", ".join(out)


TOKENS = "toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents)"
TF = f"{TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL)"
DF = f"{TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
KEPT = f"{DF}, kept AS (SELECT * FROM df WHERE df >= {MIN_DF} AND df <= {MAX_DF} * (SELECT count(*) FROM documents))"
WEIGHTS = f"""{KEPT}, w AS (SELECT doc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM tf JOIN kept USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM w)"""
DOCS = f"docs AS (SELECT doc_id, 'doc ' || doc_id AS title, lang AS category, text, substr(source, 4)::INT % {K} AS cluster FROM documents)"
HIST = f"{DOCS}, hist AS (SELECT cluster, category, count(*) AS n FROM docs GROUP BY ALL)"


def _uniform(parts: str) -> str:
    return f"((('0x' || substr(md5({parts}), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)})"


def _random_start(p: str, k: int, seed: int) -> list[str]:
    u = _uniform(f"'{seed}:' || vec_id")
    return [f"{p}picks AS MATERIALIZED (SELECT vec_id AS id, (row_number() OVER (ORDER BY {u}, vec_id) - 1)::INT AS cluster FROM embeddings QUALIFY cluster < {k})"]


def _plus_plus_start(p: str, k: int, seed: int) -> list[str]:
    out = [f"{p}near0 AS MATERIALIZED (SELECT vec_id AS id, 1.0::DOUBLE AS far FROM embeddings)"]
    for j in range(k):
        u = _uniform(f"'{seed}:{j}:' || id")
        out.append(f"{p}pick{j} AS MATERIALIZED (SELECT id FROM {p}near{j} WHERE far > 0 ORDER BY -ln({u}) / far, id LIMIT 1)")
        least = "d" if j == 0 else "least(far, d)"
        out.append(
            f"{p}near{j + 1} AS MATERIALIZED (SELECT id, {least} AS far FROM {p}near{j} JOIN (SELECT a.id, sum((a.v - b.v) * (a.v - b.v)) AS d "
            f"FROM {p}pts a JOIN (SELECT dim, v FROM {p}pts WHERE id = (SELECT id FROM {p}pick{j})) b USING (dim) GROUP BY a.id) USING (id))"
        )
    out.append(f"{p}picks AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT id, {j}::INT AS cluster FROM {p}pick{j}" for j in range(k)) + ")")
    return out


def _best(start) -> str:
    runs = range(RESTARTS)
    steps = ", ".join(_lloyd(K, LLOYD_STEPS, f"s{r}", start, r) for r in runs)
    every = " UNION ALL ".join(f"SELECT {r} AS run, id, cluster, d FROM s{r}a{LLOYD_STEPS}" for r in runs)
    return f"""WITH {steps}, every AS MATERIALIZED ({every}), costs AS (SELECT run, round(sum(d), 9) AS cost FROM every GROUP BY run)
        SELECT id AS vec_id, run::INT AS run, cluster, round(d, 6) AS sq_dist FROM every WHERE run = (SELECT run FROM costs ORDER BY cost, run LIMIT 1)"""


def _lloyd(k: int, steps: int = LLOYD_STEPS, name: str = "", start=None, seed: int = 0) -> str:
    p = name
    out = [
        f"{p}pts AS MATERIALIZED (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)",
    ]
    if start is None:
        out.append(f"{p}c0 AS MATERIALIZED (SELECT (dense_rank() OVER (ORDER BY id) - 1)::INT AS cluster, dim, v FROM {p}pts WHERE id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {k}))")
    else:
        out += start(p, k, seed)
        out.append(f"{p}c0 AS MATERIALIZED (SELECT cluster, dim, v FROM {p}pts JOIN {p}picks USING (id))")
    for s in range(steps + 1):
        out.append(
            f"{p}a{s} AS MATERIALIZED (SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT id, cluster, sum((p.v - c.v) * (p.v - c.v)) AS d "
            f"FROM {p}pts p JOIN {p}c{s} c USING (dim) GROUP BY ALL) GROUP BY id)"
        )
        if s < steps:
            out.append(f"{p}c{s + 1} AS MATERIALIZED (SELECT cluster, dim, avg(v) AS v FROM {p}pts JOIN {p}a{s} USING (id) GROUP BY ALL)")
    return ", ".join(out)


def _sparse(ks: tuple[int, ...], seeds: tuple[int, ...], steps: int = LLOYD_STEPS, oversampled: bool = False) -> str:
    """Lloyd's steps on the TF-IDF cells, all runs together: s<steps> has the last assignment, z<steps> the last centroids."""
    runs = ", ".join(f"({r}, {k}, {seed})" for r, (k, seed) in enumerate(zip(ks, seeds)))
    u = _uniform("seed || ':' || doc_id")
    out = [
        f"{WEIGHTS}, runs(run, k, seed) AS (VALUES {runs})",
        "cells AS MATERIALIZED (SELECT * FROM tfidf), squares AS MATERIALIZED (SELECT doc_id, coalesce(sum(tfidf * tfidf), 0.0) AS square FROM documents LEFT JOIN cells USING (doc_id) GROUP BY doc_id)",
    ]
    if oversampled:
        out += [
            "dots AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.tfidf * b.tfidf) AS dot FROM cells a JOIN cells b USING (term) GROUP BY ALL)",
            "dist AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, CASE WHEN x.doc_id = y.doc_id THEN 0.0 ELSE greatest(round(x.square + y.square - 2 * coalesce(dot, 0.0), 9), 0.0) END AS d FROM squares x JOIN squares y ON true LEFT JOIN dots ON a = x.doc_id AND b = y.doc_id)",
            "ids AS (SELECT doc_id AS id FROM squares)", _oversampled("dist", "ids", ks[0], len(ks)).replace("picks AS", "drawn AS"), "picks AS MATERIALIZED (SELECT run, cluster, id AS doc_id FROM drawn)",
        ]
    else:
        out.append(f"picks AS MATERIALIZED (SELECT run, (row_number() OVER (PARTITION BY run ORDER BY {u}, doc_id) - 1)::INT AS cluster, k, doc_id FROM documents, runs QUALIFY cluster < k)")
    out += [
        "z0 AS MATERIALIZED (SELECT run, cluster, term, tfidf AS v FROM picks JOIN cells USING (doc_id))",
    ]
    for s in range(steps + 1):
        out.append(f"norms{s} AS MATERIALIZED (SELECT run, cluster, coalesce(sum(v * v), 0.0) AS norm FROM picks LEFT JOIN z{s} USING (run, cluster) GROUP BY ALL)")
        out.append(f"dots{s} AS MATERIALIZED (SELECT doc_id, run, cluster, sum(tfidf * v) AS dot FROM cells JOIN z{s} USING (term) GROUP BY ALL)")
        out.append(
            f"s{s} AS MATERIALIZED (SELECT doc_id, run, arg_min(cluster, (round(norm - 2 * coalesce(dot, 0.0), 9), cluster)) AS cluster, "
            f"greatest(any_value(square) + min(round(norm - 2 * coalesce(dot, 0.0), 9)), 0.0) AS d FROM squares JOIN norms{s} ON true LEFT JOIN dots{s} USING (doc_id, run, cluster) GROUP BY doc_id, run)"
        )
        if s < steps:
            out.append(f"sizes{s} AS MATERIALIZED (SELECT run, cluster, count(*) AS size FROM s{s} GROUP BY ALL)")
            out.append(
                f"z{s + 1} AS MATERIALIZED (SELECT run, cluster, term, sum(tfidf) / any_value(size) AS v FROM cells JOIN s{s} USING (doc_id) JOIN sizes{s} USING (run, cluster) GROUP BY run, cluster, term "
                f"UNION ALL SELECT run, cluster, term, v FROM z{s} ANTI JOIN sizes{s} USING (run, cluster))"
            )
    return ", ".join(out)


def _oversampled(dist: str, ids: str, k: int, runs: int) -> str:
    """picks(run, cluster, id): oversampling rounds and weighted draws, over a relation dist(a, b, d) of all pairs and one ids(id)."""
    clock = lambda label, weight: f"-ln({_uniform(f"run || ':{label}:' || id")}) / {weight}"
    out = [
        f"seeds AS (SELECT range::INT AS run FROM range({runs}))",
        f"far0 AS MATERIALIZED (SELECT run, id, 1.0::DOUBLE AS far FROM {ids}, seeds)",
    ]
    for t in range(ROUNDS + 1):
        many = 1 if t == 0 else OVERSAMPLING * k
        out.append(f"new{t} AS MATERIALIZED (SELECT run, id FROM far{t} WHERE far > 0 QUALIFY row_number() OVER (PARTITION BY run ORDER BY {clock(t, 'far')}, id) <= {many})")
        least = "min(d)" if t == 0 else "least(any_value(far), min(d))"
        out.append(f"far{t + 1} AS MATERIALIZED (SELECT run, f.id, {least} AS far FROM far{t} f JOIN new{t} n USING (run) JOIN {dist} ON a = f.id AND b = n.id GROUP BY run, f.id)")
    out.append("held AS MATERIALIZED (" + " UNION ".join(f"SELECT run, id FROM new{t}" for t in range(ROUNDS + 1)) + ")")
    out.append(f"own AS (SELECT run, a, arg_min(b, (round(d, 9), b)) AS id FROM held JOIN {dist} ON b = id GROUP BY run, a)")
    out.append("left0 AS MATERIALIZED (SELECT run, id, count(*)::DOUBLE AS weight, 1.0::DOUBLE AS far FROM own GROUP BY run, id)")
    for j in range(k):
        out.append(f"draw{j} AS MATERIALIZED (SELECT run, id FROM left{j} WHERE weight * far > 0 QUALIFY row_number() OVER (PARTITION BY run ORDER BY {clock(f'w{j}', '(weight * far)')}, id) = 1)")
        least = "d" if j == 0 else "least(far, d)"
        out.append(f"left{j + 1} AS MATERIALIZED (SELECT run, l.id, weight, {least} AS far FROM left{j} l JOIN draw{j} n USING (run) JOIN {dist} ON a = l.id AND b = n.id)")
    out.append("picks AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT run, {j}::INT AS cluster, id FROM draw{j}" for j in range(k)) + ")")
    return ", ".join(out)


def _kmeans_parallel() -> str:
    points = "pts AS MATERIALIZED (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"
    pairs = "dist AS MATERIALIZED (SELECT a.id AS a, b.id AS b, sum((a.v - b.v) * (a.v - b.v)) AS d FROM pts a JOIN pts b USING (dim) GROUP BY ALL)"
    out = [points, pairs, "ids AS (SELECT vec_id AS id FROM embeddings)", _oversampled("dist", "ids", K, RESTARTS), "c0 AS MATERIALIZED (SELECT run, cluster, dim, v FROM picks JOIN pts USING (id))"]
    for s in range(LLOYD_STEPS + 1):
        out.append(
            f"a{s} AS MATERIALIZED (SELECT run, id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT run, p.id, cluster, sum((p.v - c.v) * (p.v - c.v)) AS d FROM pts p JOIN c{s} c USING (dim) GROUP BY ALL) GROUP BY run, id)"
        )
        if s < LLOYD_STEPS:
            out.append(f"c{s + 1} AS MATERIALIZED (SELECT run, cluster, dim, avg(v) AS v FROM pts JOIN a{s} USING (id) GROUP BY ALL)")
    return f"""WITH {", ".join(out)}, costs AS (SELECT run, round(sum(d), 9) AS cost FROM {LAST} GROUP BY run)
        SELECT id AS vec_id, run::INT AS run, cluster, round(d, 6) AS sq_dist FROM {LAST} WHERE run = (SELECT run FROM costs ORDER BY cost, run LIMIT 1)"""


def _docs_kmeans(oversampled: bool) -> str:
    return f"""WITH {_sparse((K,) * RESTARTS, tuple(range(RESTARTS)), LLOYD_STEPS, oversampled)}, costs AS (SELECT run, round(sum(d), 9) AS cost FROM s{LLOYD_STEPS} GROUP BY run),
    best AS MATERIALIZED (SELECT run FROM costs ORDER BY cost, run LIMIT 1),
    docs AS MATERIALIZED (SELECT doc_id, cluster, lang AS category, text FROM s{LLOYD_STEPS} JOIN documents USING (doc_id) WHERE run = (SELECT run FROM best)),
    hist AS MATERIALIZED (SELECT cluster, category, count(*) AS n FROM docs GROUP BY ALL)"""


DOCS_KMEANS = _docs_kmeans(False)
ENTROPIES = """p AS (SELECT cluster, n, n / sum(n) OVER (PARTITION BY cluster) AS p FROM hist), h AS (SELECT cluster, sum(-p * log2(p)) AS h, sum(n) AS n FROM p GROUP BY cluster),
        g AS (SELECT n / sum(n) OVER () AS p FROM (SELECT sum(n) AS n FROM hist GROUP BY category))"""

CORPUS = r"""WITH t AS (SELECT doc_id, lang, regexp_replace(regexp_replace(coalesce(text, ''), '\n+', chr(10), 'g'), '^\n|\n$', '', 'g') AS body FROM documents)
        SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, 'doc ' || doc_id AS title, coalesce(nullif(lang, ''), 'none') AS category, CASE WHEN body = '' THEN '' ELSE body || chr(10) END AS text FROM t"""

ORACLES = {
    "graph_edges": f"WITH {RAW} SELECT * FROM edges",
    "graph_nodes": f"WITH {RAW}, {NODES} SELECT id FROM nodes",
    "out_degree": f"WITH {RAW} SELECT src AS id, count(*) AS degree FROM edges GROUP BY src",
    "in_degree": f"WITH {RAW} SELECT dst AS id, count(*) AS degree FROM edges GROUP BY dst",
    "node_degrees": f"WITH {RAW} {_degrees('edges')}",
    "stochastic_matrix": f"WITH {RAW}, {MATRIX} SELECT row, col, round(val, 12) AS val FROM matrix",
    "stochastic_matrix_weighted": f"WITH {RAW}, g AS (SELECT src, dst, count(*) AS n FROM raw GROUP BY ALL) SELECT dst AS row, src AS col, round(n::DOUBLE / sum(n) OVER (PARTITION BY src), 12) AS val FROM g",
    "matrix_column_sums": f"WITH {RAW}, {MATRIX} SELECT col, round(sum(val), 9) AS total FROM matrix GROUP BY col",
    "matvec_partials": f"{PARTIALS} SELECT row, round(part, 6) AS part FROM parts",
    "matvec": f"{PARTIALS} SELECT row AS id, round(sum(part), 6) AS value FROM parts GROUP BY row",
    "matvec_total": f"{PARTIALS} SELECT round(sum(part), 3) AS total, count(DISTINCT row) AS n FROM parts",
    "deadend_pass": f"WITH {RAW} SELECT src, dst FROM edges WHERE dst IN ({_alive('edges')})",
    "surviving_nodes": f"WITH {RAW} {_alive('edges')}",
    "isolated_self_loops": f"WITH {RAW}, n AS (SELECT -1 - n_nationkey::BIGINT AS n, n_nationkey FROM nation), "
    "every AS (SELECT src, dst FROM edges UNION ALL SELECT n, n FROM n UNION ALL SELECT n, n - 1 FROM n WHERE n_nationkey % 4 = 0) "
    f"SELECT id FROM ({_degrees('every')}) WHERE outs = 1 AND ins = 1 AND loop",
    "successor_lists": f"WITH {RAW} SELECT src AS id, (dst // {1 << 20})::BIGINT AS block, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS successors FROM edges GROUP BY 1, 2",
    "kmeans_random": _best(_random_start),
    "kmeans_plus_plus": _best(_plus_plus_start),
    "edges_text": f"WITH {RAW} SELECT src, dst FROM edges",
    "matrix_vector_text": f"{PARTIALS} SELECT row AS id, round(sum(part), 6) AS value FROM parts GROUP BY row",
    "key_values_text": f"WITH {RAW} SELECT src::VARCHAR AS key, count(*)::VARCHAR AS value FROM edges GROUP BY src",
    "result_vector_text": "SELECT n_regionkey::BIGINT AS id, count(*)::DOUBLE AS value FROM nation GROUP BY n_regionkey",
    "corpus_text": CORPUS,
    "corpus_records": CORPUS,
    "listing_text": f"WITH {DOCS}, l AS (SELECT cluster, string_agg(title || '(' || category || ')', ', ' ORDER BY doc_id) AS listing FROM docs GROUP BY cluster) "
    "SELECT 'Cluster ' || cluster AS line FROM l UNION ALL SELECT listing FROM l",
    "remove_deadends": f"WITH {_peel()} SELECT src, dst FROM e{PASSES}",
    "deadend_pass_counts": f"WITH {_peel()}, c AS ("
    + " UNION ALL ".join([f"SELECT 0 AS pass, (SELECT count(*) FROM (SELECT src FROM e0 UNION SELECT dst FROM e0)) AS nodes, 0 AS edges"] + [f"SELECT {k}, (SELECT count(*) FROM a{k}), (SELECT count(*) FROM e{k})" for k in range(1, PASSES + 1)])
    + "), l AS (SELECT *, lag(nodes) OVER (ORDER BY pass) AS before FROM c) SELECT pass::INT AS pass, nodes, edges::BIGINT AS edges FROM l WHERE pass > 0 AND pass <= (SELECT min(pass) FROM l WHERE nodes = before)",
    "initial_vector": f"WITH {RAW}, {NODES} SELECT id, round(1.0::DOUBLE / (SELECT count(*) FROM nodes), 12) AS value FROM nodes",
    "teleport_step": f"WITH {RAW}, {NODES}, {MATRIX}, s AS (SELECT row AS id, sum(val / (SELECT count(*) FROM nodes)) AS v FROM matrix GROUP BY row) "
    f"SELECT nodes.id, round({BETA} * coalesce(v, 0.0) + {1 - BETA} / (SELECT count(*) FROM nodes), 12) AS value FROM nodes LEFT JOIN s ON s.id = nodes.id",
    "pagerank_10": f"WITH {_ranks(STEPS)} SELECT id, round(value, 9) AS value FROM r{STEPS}",
    "pagerank_converged": f"{_converged()} SELECT id, value FROM picked",
    "pagerank_topk": f"{_converged()} SELECT id, value FROM picked ORDER BY value DESC, id LIMIT 10",
    "pagerank_l1_trace": f"WITH {_ranks(STEPS)}, {_changes(STEPS)} SELECT step::INT AS step, round(change, 9) AS change FROM changes",
    "doc_word_size": r"SELECT doc_id, len(regexp_extract_all(text, '\w+')) AS word_size FROM documents",
    "doc_first_sentence": "SELECT doc_id, split_part(text, '.', 1) AS sentence FROM documents",
    "doc_snippet": "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS snippet FROM documents",
    "doc_display": f"WITH {DOCS} SELECT doc_id, concat_ws(chr(10), title, category, text) AS display FROM docs",
    "tokens": "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents) SELECT doc_id, (generate_subscripts(w, 1) - 1)::INT AS pos, unnest(w) AS term FROM t",
    "term_frequency": f"WITH {TF} SELECT doc_id, term, tf FROM tf",
    "term_frequency_stop_words": f"WITH {TF} SELECT doc_id, term, tf FROM tf WHERE term NOT IN ('january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december', 'the', 'and', 'with')",
    "document_frequency": f"WITH {DF} SELECT term, df FROM df",
    "vocabulary": f"WITH {KEPT} SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df FROM kept",
    "tfidf": f"WITH {WEIGHTS} SELECT doc_id, term, round(tfidf, 6) AS tfidf FROM tfidf",
    "kmeans_assign": f"WITH {_lloyd(K)} SELECT id AS vec_id, cluster, round(d, 6) AS sq_dist FROM {LAST}",
    "kmeans_bounded": f"WITH {_lloyd(K)} SELECT id AS vec_id, cluster, round(d, 6) AS sq_dist FROM {LAST}",
    "pagerank_resumed": f"{_converged()} SELECT id, value FROM picked",
    "kmeans_centroids": f"WITH {_lloyd(K)} SELECT cluster, dim::INT AS dim, round(avg(v), 6) AS value FROM pts JOIN {LAST} USING (id) GROUP BY cluster, dim",
    "kmeans_sse": f"WITH {_lloyd(K)} SELECT round(sum(d), 6) AS sse FROM {LAST}",
    "sse_vs_k": "WITH " + ", ".join(_lloyd(k, LLOYD_STEPS, f"k{k}") for k in KS) + " " + " UNION ALL ".join(f"SELECT {k}::INT AS k, (SELECT round(sum(d), 6) FROM k{k}{LAST}) AS sse" for k in KS),
    "matvec_hub": f"""WITH raw AS (SELECT o_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) AS dst FROM orders WHERE o_orderpriority = '1-URGENT'
        UNION ALL SELECT -1, l_orderkey * 8 + l_linenumber FROM lineitem UNION ALL SELECT o_orderkey * 8, -2 FROM orders), edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM raw), {MATRIX}
        SELECT row AS id, round(sum(val * (1 + ((col % 10) + 10) % 10)), 9) AS value FROM matrix GROUP BY row""",
    "pagerank_push": f"{_push()} SELECT id, round(rank + residual, 12) AS value FROM p48",
    "pagerank_push_steps": f"{_push()} SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT {k + 1}::INT AS step, (SELECT count(*) FROM p{k}, least WHERE residual > least) AS active" for k in range(48))
    + ") WHERE active > 0",
    "docs_kmeans": f"{DOCS_KMEANS} SELECT doc_id, run::INT AS run, cluster, round(d, 9) AS sq_dist FROM s{LLOYD_STEPS} WHERE run = (SELECT run FROM best)",
    "docs_kmeans_parallel": f"{_docs_kmeans(True)} SELECT doc_id, run::INT AS run, cluster, round(d, 9) AS sq_dist FROM s{LLOYD_STEPS} WHERE run = (SELECT run FROM best)",
    "kmeans_parallel": _kmeans_parallel(),
    "docs_kmeans_purity": f"""{DOCS_KMEANS}, {ENTROPIES} SELECT round((SELECT sum(top) / sum(n) FROM (SELECT max(n) AS top, sum(n) AS n FROM hist GROUP BY cluster)), 9) AS purity,
        round((SELECT sum(h * n) / sum(n) FROM h), 9) AS weighted, round((SELECT sum(h) FROM h), 9) AS summed, round((SELECT sum(-p * log2(p)) FROM g), 9) AS overall""",
    "docs_kmeans_top_docs": rf"{DOCS_KMEANS}, sized AS (SELECT cluster, doc_id, len(regexp_extract_all(text, '\w+')) AS word_size FROM docs) "
    "SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY word_size DESC, doc_id)::INT AS place, doc_id, word_size FROM sized QUALIFY place <= 10",
    "docs_kmeans_top_terms": f"""{DOCS_KMEANS}, r AS (SELECT cluster, term, round(v, 9) AS weight FROM z{LLOYD_STEPS} WHERE run = (SELECT run FROM best))
        SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term)::INT AS place, term, round(weight, 6) AS weight FROM r QUALIFY place <= 10""",
    "docs_sse_vs_k": f"WITH {_sparse(KS, (0,) * len(KS))} SELECT (run + {KS[0]})::INT AS k, round(sum(d), 9) AS sse FROM s{LLOYD_STEPS} GROUP BY run",
    "cluster_members": f"WITH {DOCS} SELECT cluster, doc_id, count(*) OVER (PARTITION BY cluster) AS size FROM docs",
    "cluster_histogram": f"WITH {HIST} SELECT * FROM hist",
    "cluster_modes": f"WITH {HIST} SELECT cluster, category, n FROM hist QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) = 1",
    "cluster_purity": f"WITH {HIST} SELECT round(sum(top) / sum(n), 9) AS purity FROM (SELECT max(n) AS top, sum(n) AS n FROM hist GROUP BY cluster)",
    "cluster_entropy": f"""WITH {HIST}, p AS (SELECT cluster, n, n / sum(n) OVER (PARTITION BY cluster) AS p FROM hist),
        h AS (SELECT cluster, sum(-p * log2(p)) AS h, sum(n) AS n FROM p GROUP BY cluster),
        g AS (SELECT n / sum(n) OVER () AS p FROM (SELECT sum(n) AS n FROM hist GROUP BY category))
        SELECT round((SELECT sum(h * n) / sum(n) FROM h), 9) AS weighted, round((SELECT sum(h) FROM h), 9) AS summed, round((SELECT sum(-p * log2(p)) FROM g), 9) AS overall""",
    "categories": "SELECT DISTINCT lang AS category FROM documents WHERE length(lang) > 0",
    "majority_share": "SELECT round(max(n) / sum(n), 9) AS share FROM (SELECT count(*) AS n FROM documents GROUP BY lang)",
    "cluster_top_docs": rf"WITH {DOCS}, s AS (SELECT cluster, doc_id, len(regexp_extract_all(text, '\w+')) AS word_size FROM docs) "
    "SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY word_size DESC, doc_id)::INT AS place, doc_id, word_size FROM s QUALIFY place <= 10",
    "cluster_top_terms": f"""WITH {WEIGHTS}, {DOCS}, sizes AS (SELECT cluster, count(*) AS size FROM docs GROUP BY cluster),
        m AS (SELECT cluster, term, round(sum(tfidf) / any_value(size), 9) AS weight FROM tfidf JOIN docs USING (doc_id) JOIN sizes USING (cluster) GROUP BY cluster, term)
        SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, term)::INT AS place, term, round(weight, 6) AS weight FROM m QUALIFY place <= 10""",
    "cluster_listing": f"WITH {DOCS} SELECT cluster, string_agg(title || '(' || category || ')', ', ' ORDER BY doc_id) AS listing FROM docs GROUP BY cluster",
}
