"""DuckDB SQL that is too long to stand beside its query."""

from __future__ import annotations

from collections.abc import Sequence

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mass(name: str, edges: str, kind: str, rounds: int, damping: float) -> list[str]:
    """<name>0 .. <name><rounds>: personalised PageRank, unrolled."""
    out = [
        f"{name}d AS MATERIALIZED (SELECT src, count(*) AS degree FROM {edges} GROUP BY src)",
        f"{name}s AS MATERIALIZED (SELECT host, CASE WHEN {kind} > 0 THEN {kind} / sum({kind}) OVER () ELSE 0.0::DOUBLE END AS weight, coalesce(degree, 0) AS degree FROM hosts LEFT JOIN {name}d ON src = host)",
        f"{name}0 AS MATERIALIZED (SELECT host, weight AS mass FROM {name}s)",
    ]
    for k in range(rounds):
        out.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT s.host, {damping} * (coalesce(got, 0.0) + weight * coalesce((SELECT sum(mass) FROM {name}{k} JOIN {name}s USING (host) WHERE degree = 0), 0.0)) + {1 - damping} * weight AS mass "
            f"FROM {name}s s LEFT JOIN (SELECT dst, sum(mass / degree) AS got FROM {edges} JOIN {name}s ON {name}s.host = src JOIN {name}{k} m ON m.host = src GROUP BY dst) ON dst = s.host)"
        )
    return out


def judge_urls_sql(rules: Sequence[tuple[str, str, str]], link: str, rounds: int, damping: float = 0.85, least: float = 1.0) -> str:
    values = ", ".join(f"({k}, '{v}', '{h}', '{p}')" for k, (v, h, p) in enumerate(rules))
    known = f"regexp_replace(translate({{}}, '{_UPPER}', '{_LOWER}'), '^[^@]*@|:[0-9]+$', '', 'g')"
    pattern = link.removeprefix("(?i)").replace("'", "''")
    steps = [
        "rests AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"parts AS MATERIALIZED (SELECT row_number() OVER () AS row_id, page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)",
        f"rules(k, verdict, name, prefix) AS (VALUES {values})",
        "fits AS (SELECT row_id, name || prefix AS rule, verdict FROM parts JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix) "
        "QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY length(name || prefix) DESC, k) = 1)",
        f"ruled AS MATERIALIZED (SELECT row_id, page_id, host, path, rule, verdict, {known.format('host')} AS node FROM parts LEFT JOIN fits USING (row_id))",
        f"links AS (SELECT {known.format('host')} AS src, unnest(regexp_extract_all(html, '{pattern}', 1, 'i')) AS target FROM parts)",
        f"named AS (SELECT src, {known.format('target')} AS dst FROM links)",
        "edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM named WHERE src <> '' AND dst <> '' AND src <> dst)",
        "back AS MATERIALIZED (SELECT dst AS src, src AS dst FROM edges)",
        "counted AS (SELECT node AS host, count_if(verdict = 'allow') / count(*) AS allowed, count_if(verdict = 'block') / count(*) AS blocked FROM ruled WHERE node <> '' GROUP BY node)",
        "hosts AS MATERIALIZED (SELECT host, coalesce(allowed, 0.0::DOUBLE) AS allowed, coalesce(blocked, 0.0::DOUBLE) AS blocked FROM counted FULL JOIN (SELECT src AS host FROM edges UNION SELECT dst FROM edges) USING (host))",
        *_mass("t", "edges", "allowed", rounds, damping),
        *_mass("b", "back", "blocked", rounds, damping),
        f"judged AS (SELECT host, b.mass * (SELECT count(*) FROM hosts) >= {least} AND b.mass > t.mass AS bad FROM t{rounds} t JOIN b{rounds} b USING (host))",
    ]
    return "WITH " + ", ".join(steps) + " SELECT page_id, ruled.host, path, rule, coalesce(verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM ruled LEFT JOIN judged ON judged.host = ruled.node"


def resample_sql(share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42, buckets: int = 10_000) -> str:
    """Importance resampling; CRC32 byte by byte over the distinct runs, with the table made by its own rule."""
    digit = "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    word = r"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(upper=_UPPER, lower=_LOWER)
    run = lambda table, key: f"""SELECT {key} AS id, array_to_string(w[p:p + k - 1], ' ') AS run FROM (SELECT {key}, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM {table}, (VALUES (1), (2), (3)) ks(k))"""
    return f"""WITH crc_table AS MATERIALIZED (SELECT list(list_reduce(range(8), {digit}, b) ORDER BY b) AS t FROM range(256) r(b)),
        d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, {word} AS w FROM documents),
        q AS MATERIALIZED (SELECT row_number() OVER () AS row_id, {word} AS w FROM benchmark),
        d_runs AS MATERIALIZED ({run("d", "row_id")}), q_runs AS MATERIALIZED ({run("q", "row_id")}),
        names AS (SELECT DISTINCT run FROM (SELECT run FROM d_runs UNION ALL SELECT run FROM q_runs)),
        coded AS (SELECT run, list_transform(range(octet_length(encode(run))), lambda k: ('0x' || substr(hex(encode(run)), 2 * k + 1, 2))::BIGINT) AS bytes FROM names),
        hashed AS MATERIALIZED (SELECT run, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {buckets} AS bucket FROM coded, crc_table),
        d_hits AS MATERIALIZED (SELECT id, bucket, count(*) AS n FROM d_runs JOIN hashed USING (run) GROUP BY ALL),
        s AS (SELECT bucket, sum(n) AS n FROM d_hits GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM q_runs JOIN hashed USING (run) GROUP BY bucket),
        g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets})::DOUBLE
            / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets})::DOUBLE)))::BIGINT AS gain FROM range({buckets}) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
        w AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM d_hits JOIN g USING (bucket) GROUP BY id),
        scored AS (SELECT row_id, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
            + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w ON id = row_id),
        drawn AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= {least_words}
            QUALIFY rank <= (SELECT count(*) FROM scored WHERE n_words >= {least_words}) * {share[0]} // {share[1]})
        SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, rank::BIGINT AS rank FROM scored LEFT JOIN drawn USING (row_id)"""


def hard_negatives_sql(positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> str:
    """Hard negatives of the anchors by a join of them with all rows."""
    return f"""WITH r AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (SELECT a.uid, a.vec_id AS anchor_id, b.uid AS other, b.vec_id, b.label = a.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.uid <> b.uid),
        p AS (SELECT uid, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, other) <= {positives}),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.uid, p.other ORDER BY s.score DESC, s.vec_id) AS rank
            FROM p JOIN s USING (uid) WHERE NOT same AND {low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {negatives}"""


def embedding_links_sql(threshold: float) -> str:
    """Links by all pairs of usable vectors, components by the closure of reachability."""
    return f"""WITH RECURSIVE r AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
        u AS MATERIALIZED (SELECT * FROM r WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0),
        l AS MATERIALIZED (SELECT a.uid AS a, b.uid AS b FROM u a JOIN u b ON a.uid <> b.uid WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= {threshold}),
        reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
        least AS (SELECT a AS uid, min(vec_id) AS least FROM reach JOIN r ON r.uid = b GROUP BY a), degree AS (SELECT a AS uid, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
        FROM r LEFT JOIN least USING (uid) LEFT JOIN degree USING (uid)"""
