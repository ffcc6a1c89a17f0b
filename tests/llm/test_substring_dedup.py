import hashlib
import random

import pytest

from tarnweave.llm.common import WordHasher
from tarnweave.llm.substring_dedup import _rows, remove_repeats


def brute(rows, window):
    first, out = {}, []
    docs = sorted((d, (t or "").split(" ") if t else []) for d, t in rows)
    for d, w in docs:
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    for d, w in docs:
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] != (d, i) for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"start": 2}, {"hot": 2}, {"start": 4, "hot": 1}])
def test_against_brute_force(spark, options):
    rng = random.Random(4)
    common = [str(rng.randint(0, 5)) for _ in range(30)]
    rows = []
    for d in range(60):
        w = [str(rng.randint(0, 3 if d % 3 else 400)) for _ in range(rng.randint(0, 60))]
        if d % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = common[rng.randint(0, 5) :]
        rows.append((d, " ".join(w) or None))
    rows.append((60, " ".join(["a"] * 50)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in remove_repeats(docs, 8, **options).collect()) == brute(rows, 8)


def test_long_words_and_segments(spark):
    text = " ".join(["y" * 3000 + str(i) for i in range(1000)])  # above one segment of the hasher
    docs = spark.createDataFrame([(1, text), (2, "z " + text.replace(" ", "\n"))], "doc_id long, text string")
    got = {r.id: r for r in remove_repeats(docs, 20).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].kept) == (0, 1000, "z")


def test_words_that_polynomial_hashes_confuse(spark):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word} {rest}")], "doc_id long, text string")
    assert {r.id: r.n_removed for r in remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 20}


def test_hashes_of_words():
    rng = random.Random(5)
    words = list({"".join(rng.choice("ab") for _ in range(n)) for n in range(1, 200) for _ in range(60)})
    text = " ".join(words).encode()
    got = WordHasher().word_hashes(text)
    assert len(set(got.tolist())) == len(words)
    assert got.tolist() == [int(WordHasher().word_hashes(w.encode())[0]) for w in words]
    assert not set(got.tolist()) & set(WordHasher(11).word_hashes(text).tolist())


def test_very_many_rows_without_identifier(spark):
    docs = spark.range(200_000).selectExpr("CAST(NULL AS long) AS doc_id", "concat('text ', id) AS text")
    assert _rows(docs, "doc_id", "text").select("tid").distinct().count() == 200_000


def test_one_document_with_very_many_runs(spark):
    """A representative that one document alone has often is a hot one too."""
    rng = random.Random(6)
    same = " ".join(f"s{k}" for k in range(6))
    rows = [(1, " ".join(f"{rng.randrange(10**6)} {same}" for _ in range(300))), (2, " ".join(f"x {same}" for _ in range(9)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in remove_repeats(docs, 8, hot=20).collect()) == brute(rows, 8)


def test_edges(spark, nasty, nothing):
    got = remove_repeats(nasty, 4).collect()
    assert len(got) == nasty.count()
    by = lambda d: sorted((r.n_words, r.n_removed) for r in got if r.id == d)
    assert by(1) == by(2) == by(3) == [(0, 0)]
    # the null identifier is the smallest, so it owns the shared text; repeated rows count as one
    assert by(None) == [(4, 0), (5, 0)] and by(5) == [(4, 4)] and by(6) == [(4, 4), (4, 4), (6, 0)]
    assert by(4) == [(60_000, 0)] and by(7) == [(1, 0)]
    assert remove_repeats(nothing).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(nothing, 20, start=7)
