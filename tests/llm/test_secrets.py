import random
import re

from pyspark.sql import functions as F

from tarnweave.llm.secrets import fit_markov, labelled_samples, listed, scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def test_base_spans_against_brute_force(spark):
    rng = random.Random(3)
    bits = ["password", "Token", "API_KEY", "apikey", "secret", "=", ": ", '"', "'", " ", "\n", "abcdefghijkl", "AKIA", "ABCDEFGH123456", "0123456789abcdef", "é", "\U0001f600", "x", "AKIAKIA"]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(300)), "token=secret: abcdefghijklmno", "deadbeefdeadbeef " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.b for r in scan(docs).select("id", listed("base").alias("b")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_markov_spans(spark):
    key, name = "gA7xQ2mZ9vK4pR8tW1yB6nC3", "customer_account_balance_history"
    texts = [f"use {key} here", f"call {name} and thouontionerstedblehendathe", f"token={key}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.f for r in scan(docs).select("id", listed("found").alias("f")).collect()}
    assert got == {0: "markov:4:28", 1: "", 2: "assign:0:30"}


def test_markov_spans_against_brute_force(spark):
    """Every run of 12 token characters or more, scored step by step; those that reach the score and overlap no base span."""
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    bits = [" ", "\n", "é", "token=", "customer_order_list", "Zeichenlaenge", "numero-usuario", "=", "0123456789abcdef"]
    pick = lambda: rng.choice(bits) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(8, 24)))
    texts = ["".join(pick() for _ in range(rng.randint(1, 12))) for _ in range(200)]
    samples = labelled_samples(spark, 1000).persist()
    ratios, want = fit_markov(samples), {}
    for i, text in enumerate(texts):
        base = [tuple(map(int, x.split(":")[1:])) for x in brute(text).split(",") if x]
        runs = [m for m in re.finditer("[A-Za-z0-9+/=_-]{12,}", text)]
        good = [m for m in runs if sum(ratios[(ord(a) - 43) * 80 + ord(b) - 43] for a, b in zip(m[0], m[0][1:])) >= 12]
        want[i] = {(m.start(), m.end()) for m in good if not any(a < m.end() and m.start() < b for a, b in base)}
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), samples=samples).select("id", "found").collect()
    assert {r.id: {(s.start, s.end) for s in r.found if s.kind == "markov"} for r in got} == want and sum(map(len, want.values())) > 50


def test_words_of_four_languages_are_no_secrets(spark):
    names = ["kunden_rechnung_nummer", "AnzahlDerBestellungen", "utilisateur-connexion", "longueurDuFichier", "direccionDelCliente", "lista_de_precios", "Verbindungsfehler", "thouontionerstedblehendathe", "internationalization"]
    docs = spark.createDataFrame([(0, " ".join(names))], "doc_id long, text string")
    assert [r.n for r in scan(docs).select(F.size("found").alias("n")).collect()] == [0]


def test_held_out_samples(spark):
    samples = labelled_samples(spark, 1200).where(F.length("token") >= 16).persist()
    train, test = samples.where("xxhash64(token) % 4 <> 0"), samples.where("xxhash64(token) % 4 = 0")
    ratios = fit_markov(train)
    right = total = 0
    for token, random_ in test.collect():
        score = sum(ratios[(ord(a) - 43) * 80 + ord(b) - 43] for a, b in zip(token, token[1:]))
        right += (score > 0) == random_
        total += 1
    assert total > 200 and right / total > 0.97


def test_edges(spark, nasty, nothing):
    got = scan(nasty).select("id", listed("base").alias("b")).collect()
    assert len(got) == nasty.count() and {r.b for r in got if r.id == 10} == {"assign:0:25"}
    assert {r.b for r in got if r.id in (1, 2, 3)} == {""}
    assert scan(nothing).count() == 0
