import random

import pytest
from pyspark.sql import functions as F

from tarnweave.sources.records import NAME, blank_line_records, lines, read_records, register, write_listing_runs
from tarnweave.sources.text import read_corpus, write_listing


def some_file(seed, n=30):
    rng = random.Random(seed)
    line = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 9))).replace("  ", " a").strip() or "x"
    records = ["\n".join(line() for _ in range(rng.randint(1, 5))) for _ in range(n)]
    return "\n" * rng.randint(0, 3) + "".join(r + "\n" * rng.randint(2, 5) for r in records[:-1]) + records[-1] + "\n" * rng.randint(0, 2), records


@pytest.mark.parametrize("seed", range(6))
def test_ranges_split_anywhere(tmp_path, seed):
    text, records = some_file(seed)
    data = text.encode()
    path = tmp_path / "f"
    path.write_bytes(data)
    for size in (1, 2, 3, 7, 64, len(data)):
        with path.open("rb") as f:
            got = [r for at in range(0, len(data), size) for r in blank_line_records(f, at, min(len(data), at + size))]
            assert [g.decode() for g in got] == records
            assert [x for at in range(0, len(data), size) for x in lines(f, at, min(len(data), at + size))] == data.removesuffix(b"\n").split(b"\n")


def test_same_rows_as_the_text_reader(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}").write_text(some_file(k)[0] + "\n")
    (tmp_path / "_SUCCESS").write_text("")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for labeled in (True, False):
        want = rows(read_corpus(spark, str(tmp_path), labeled))
        assert len(want) == 90
        for size in (64, 1 << 20):
            assert rows(read_records(spark, str(tmp_path), labeled, size)) == want
    register(spark)
    (tmp_path / "pairs").mkdir()
    (tmp_path / "pairs" / "a").write_text("k\tv\tw\nalone\n\n5\t\n")
    pairs = spark.read.format(NAME).option("kind", "pairs").option("splitBytes", 3).load(str(tmp_path / "pairs"))
    assert sorted((r.key, r.value) for r in pairs.collect()) == [("", ""), ("5", ""), ("alone", ""), ("k", "v\tw")]
    (tmp_path / "empty").mkdir()
    assert read_records(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="kind"):
        spark.read.format(NAME).option("kind", "other").load(str(tmp_path))


def content(folder):
    return "".join(f.read_text() for f in sorted(folder.glob("part-*")))


def test_listing_runs(spark, tmp_path):
    """Byte for byte the listing, from several files, with a cluster that goes over many of them, empty titles and repeated rows."""
    rows = [(i, 1 if i % 9 else i % 2 * 2, "" if i % 11 == 0 else f"t{i}", None if i % 7 == 0 else "c") for i in range(400)] + [(5, 1, "t5", "c")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, cluster int, title string, category string").repartition(5)
    write_listing(docs, str(tmp_path / "one"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_listing_runs(docs, str(tmp_path / "runs"))
        assert len(list((tmp_path / "runs").glob("part-*"))) > 2
        assert content(tmp_path / "runs") == content(tmp_path / "one")
        write_listing_runs(docs.where("cluster = 2"), str(tmp_path / "runs"))  # what was there goes
        assert content(tmp_path / "runs").startswith("Cluster 2\n") and content(tmp_path / "runs").count("\n") == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    write_listing_runs(docs.where(F.lit(False)), str(tmp_path / "none"))
    assert content(tmp_path / "none") == ""


def test_ranges_grow_with_the_files(tmp_path, monkeypatch):
    from tarnweave.sources import records as R

    (tmp_path / "f").write_bytes(b"a\nb\nc\n\n" * 100)
    monkeypatch.setattr(R, "MAX_SPLITS", 5, raising=False)
    parts = R.RecordReader({"path": str(tmp_path), "splitbytes": "10"}).partitions()
    assert len(parts) == 5 and (parts[0].begin, parts[-1].end) == (0, 700)
