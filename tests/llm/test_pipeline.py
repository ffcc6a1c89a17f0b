import random

import pytest

import corpus_pipeline
from tarnweave.llm.queries import ORACLES, QUERIES


def test_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n))
    item = " ".join(word() for _ in range(40))
    rows, kind = [], {}
    for d in range(300):
        t, kind[d] = text(12), "clean"
        if d % 10 == 1:
            t, kind[d] = text(12).upper().replace(" ", "!! ").replace(".", "$$$"), "bad"
        elif d % 10 == 3 and kind[d - 3] == "clean":
            t, kind[d] = rows[d - 3][1], "copy"
        elif d % 10 == 5 and kind[d - 1] == "clean":
            t, kind[d] = rows[d - 1][1].replace(" a", " b", 1) + " tail", "near"
        elif d % 10 == 7:
            t, kind[d] = text(6) + "\n" + item + "\n" + text(6), "leak"
        rows.append((d, t, "en", f"src{d % 3}", len(t)))
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(d, int(kind[d] != "bad"), 0) for d in range(0, 300) if d % 10 in (0, 1, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), kind


def test_stages(spark, folder):
    at, kind = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    for (name, stage), gone in zip(corpus_pipeline.STAGES, ("bad", "copy", "near", "leak")):
        before = {r[0] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, at)
        assert docs.columns == columns, name
        after = {r[0] for r in docs.select("doc_id").collect()}
        assert {kind[d] for d in before - after} == {gone} and gone not in {kind[d] for d in after}, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    mixed = corpus_pipeline.STAGES[4][1](spark, docs, at).collect()
    ran = corpus_pipeline.run(spark, at).collect()
    assert sorted(mixed) == sorted(ran)
    assert {r.doc_id for r in ran} <= {d for d, k in kind.items() if k == "clean"} and all(r.taken in (r.size, 2 * r.size) for r in ran)
    sizes = {r.source: r.source_size for r in ran}
    assert sum(r.taken for r in ran) == pytest.approx(1.5 * sum(sizes.values()), abs=3)


def test_stages_on_odd_tables(spark, folder, nasty, nothing):
    """Which rows of the odd table each stage keeps, by doc_id; the mix takes rows once or twice, those without words as nothing."""
    at, _ = folder
    every = [r.doc_id for r in nasty.select("doc_id").collect()]
    kept = {
        "exact dedup": [1, 3, 4, 5, 6, 7, 8, 9, 10, None],  # null is empty, of equal texts the least doc_id stays
        "SimHash near-dedup": [1, 4, 5, 6, 7, 8, 10, None],  # and texts without words are one group
        "benchmark decontamination": every,
    }
    order = lambda ids: sorted(ids, key=repr)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, at).count() == 0
        out = stage(spark, nasty, at)
        rows = out.collect()
        if name in kept:
            assert order(r.doc_id for r in rows) == order(kept[name]), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == nasty.columns
            given = [repr(r) for r in nasty.collect()]
            assert all(given.count(repr(r)) for r in rows)
        else:
            assert rows and all(r.taken == r.epochs * r.size and r.epochs in (1, 2) for r in rows)
    # the quality stage keeps equal texts together
    good = corpus_pipeline.STAGES[0][1](spark, nasty, at).collect()
    same = [r for r in good if r.text == "same text here again"]
    assert len(same) in (0, 4)
