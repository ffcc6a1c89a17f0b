"""Secret scans: three fixed patterns, and a character Markov model for the rest.

Everything on the main path is a built-in expression: all matches of a pattern come from
``regexp_extract_all``, their places from the lengths of the pieces that ``split`` leaves
between them. Positions count code points, ends are exclusive.

The model: first-order chains of characters, one fitted to labelled random strings and
one to labelled ordinary identifiers (add-one smoothed counts, taken with DataFrame
operations). A run of token characters is a secret if the log-likelihood ratio of its
steps reaches ``min_score`` and it overlaps no span of the fixed patterns. Runs of
``min_run`` characters and more are scored, 12 as in the pattern of assignments; the ratio
grows with the length, so a short run has to look the more random.

Defined results: null text counts as empty (no spans, the digest of the empty string);
rows are judged one by one, so ties, repeated rows and null identifiers need no rule; very
long texts are read whole; an empty table gives an empty result; other columns are not looked
at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns in the order in which kinds are listed.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",  # maximal runs; shorter ones would be dropped anyway
}
RUN = r"[A-Za-z0-9+/=_-]{%d,}"
_FIRST, _WIDTH = ord("+"), ord("z") - ord("+") + 1

#: Words of four languages from which ordinary identifiers are put together (the default samples; ``scan`` takes others).
IDENTIFIER_WORDS = (
    "account active address amount array author balance begin buffer cache channel child client close code color column comment config connection content "
    "count create current customer data date default delete device direction display document element error event factory field filter first folder format function "
    "group handler header history image index input item label language layout length level line list local manager match message method model module name network "
    "number object offset option order output page parameter path point position process product profile project query random range record request response "
    "abfrage adresse aenderung anzahl auswahl benutzer bestellung datei eingabe fehler groesse kunde laenge nachricht rechnung schluessel spalte speicher verbindung zeichen "
    "adresse affichage bouton chemin cle commande compteur connexion donnees echec fenetre fichier ligne longueur niveau nombre requete reseau taille utilisateur "
    "archivo ayuda boton cadena cantidad carpeta cliente columna consulta contrasena direccion fecha lista mensaje nivel numero pedido precio usuario valor"
).split()


def labelled_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(token, random): ``n`` random strings over usual key alphabets, and ``n`` identifiers of one to four joined words."""
    words = F.array(*[F.lit(w) for w in IDENTIFIER_WORDS])
    pick = lambda *at: F.pmod(F.xxhash64("id", *[F.lit(x) if isinstance(x, (int, str)) else x for x in at]), F.lit(1 << 30)).cast("int")
    alphabets = F.array(
        F.lit("0123456789abcdef"),
        F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
        F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"),
        F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    )
    base = spark.range(n, numPartitions=4)
    alphabet = F.element_at(alphabets, F.pmod(F.col("id"), F.lit(5)).cast("int") + 1)
    letters = F.transform(F.sequence(F.lit(1), 16 + F.pmod(pick("length"), F.lit(33))), lambda i: F.substring(alphabet, F.pmod(pick("char", i), F.length(alphabet)) + 1, F.lit(1)))
    strings = base.select(F.array_join(letters, "").alias("token"), F.lit(True).alias("random"))
    chosen = F.transform(F.sequence(F.lit(1), 1 + F.pmod(pick("words"), F.lit(4))), lambda i: F.element_at(words, F.pmod(pick("word", i), F.size(words)) + 1))
    style = F.pmod(F.col("id"), F.lit(5))
    joined = (
        F.when(style == 0, F.array_join(chosen, "_"))
        .when(style == 1, F.array_join(F.transform(chosen, lambda w: F.initcap(w)), ""))
        .when(style == 2, F.array_join(chosen, ""))
        .when(style == 3, F.upper(F.array_join(chosen, "_")))
        .otherwise(F.array_join(chosen, "-"))
    )
    return strings.unionByName(base.select(joined.alias("token"), F.lit(False).alias("random")))


def fit_markov(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all steps between two token characters, row by row (at most 80 x 80 counts reach the driver)."""
    chars = F.split("token", "")
    steps = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.length("token"), F.lit(1))), lambda a, b: F.struct((F.ascii(a) - _FIRST).alias("a"), (F.ascii(b) - _FIRST).alias("b")))
    counted = samples.where(F.length("token") > 1).select("random", F.explode(steps).alias("s")).where("s.b IS NOT NULL").groupBy("random", "s.a", "s.b").count()
    counts = {k: [[1.0] * _WIDTH for _ in range(_WIDTH)] for k in (True, False)}
    for random, a, b, n in counted.collect():
        if 0 <= a < _WIDTH and 0 <= b < _WIDTH:
            counts[random][a][b] += n
    out = []
    for a in range(_WIDTH):
        yes, no = sum(counts[True][a]), sum(counts[False][a])
        out += [math.log(counts[True][a][b] / yes) - math.log(counts[False][a][b] / no) for b in range(_WIDTH)]
    return out


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where it is used inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _places(text: Column, pattern: str, hits: Column) -> Column:
    """Start of each match: lengths before it, summed in blocks of 256 so that very many matches stay cheap."""
    zero = F.lit(0)
    add = lambda x: F.aggregate(x, zero, lambda s, v: s + v)
    # lengths that lie before match i and behind match i - 1, with match i - 1 itself
    steps = F.zip_with(F.split(text, pattern, -1), F.concat(F.array(F.lit("")), hits), lambda g, h: F.length(g) + F.length(h))
    blocks = lambda x: F.transform(F.sequence(zero, F.floor((F.size(x) - 1) / 256).cast("int")), lambda j: add(F.slice(x, j * 256 + 1, F.lit(256))))
    before = lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda j: add(F.slice(x, F.lit(1), j - 1)))

    def at(steps: Column, before: Column) -> Column:
        return F.transform(F.sequence(zero, F.size(hits) - 1), lambda i: F.element_at(before, F.shiftright(i, 8) + 1) + add(F.slice(steps, F.shiftright(i, 8) * 256 + 1, i % 256 + 1)))

    return _let(steps, lambda x: _let(blocks(x), lambda y: _let(before(y), lambda z: at(x, z))))


def _spans(text: Column, kind: str, pattern: str, rank: int, keep=None) -> Column:
    """Array of (start, rank, end, kind, hit) of all leftmost matches that pass ``keep``; places are taken only where one does."""
    span = lambda s, h: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(h)).alias("end"), F.lit(kind).alias("kind"), h.alias("hit"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hit:string>>")

    def found(hits: Column) -> Column:
        placed = F.zip_with(_places(text, pattern, hits), hits, span)
        if keep is None:
            return F.when(F.size(hits) > 0, placed).otherwise(none)
        return F.when(F.exists(hits, keep), F.filter(placed, lambda x: keep(x["hit"]))).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None, min_run: int = 12, min_score: float = 12.0
) -> DataFrame:
    """One row an input row: id, base and found (arrays of start, rank, end, kind, hit, in order of place)."""
    spark = docs.sparkSession
    ratios = fit_markov(labelled_samples(spark) if samples is None else samples)
    table = F.expr("array(" + ",".join(f"{x:.6f}D" for x in ratios) + ")")
    text = F.col("body")
    value = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
    base = F.concat(
        _spans(text, "assign", PATTERNS["assign"], 1, lambda x: F.length(F.regexp_replace(x, F.lit(value), F.lit(""))) >= 12),
        _spans(text, "access", PATTERNS["access"], 2, lambda x: F.length(x) >= 18),
        _spans(text, "hex", PATTERNS["hex"], 3),
    )

    def score(token: Column) -> Column:
        codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - _FIRST)
        step = lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.coalesce(F.element_at(table, s["last"] * _WIDTH + x + 1), F.lit(0.0))).alias("sum"))
        walk = lambda x: F.aggregate(F.slice(x, F.lit(2), F.size(x)), F.struct(F.element_at(x, 1).alias("last"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])
        return _let(codes, walk)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.select("id", F.array_sort(base).alias("base"), _spans(text, "markov", RUN % min_run, 4, lambda x: score(x) >= min_score).alias("runs"))
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return rows.select("id", "base", F.array_sort(F.concat("base", free)).alias("found"))


def listed(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
