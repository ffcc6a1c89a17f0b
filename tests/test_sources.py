import pytest

from tarnweave import cli
from tarnweave.sources import text as S


def test_vector_and_matrix_in_one_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 1 0.5\n1\t0.1\nfoo\n2  2\t0.25 \n2 3 4 5\n\nx y\n")
    assert {tuple(r) for r in S.read_matrix(spark, str(tmp_path)).collect()} == {(1, 1, 0.5), (2, 2, 0.25)}
    assert {tuple(r) for r in S.read_vector(spark, str(tmp_path)).collect()} == {(1, 0.1)}


def test_edges(spark, tmp_path):
    (tmp_path / "g.txt").write_text("1\t2\n2 3\n")
    assert {tuple(r) for r in S.read_edges(spark, str(tmp_path)).collect()} == {(1, 2), (2, 3)}
    assert S.read_edges(spark, str(tmp_path), "string").dtypes == [("src", "string"), ("dst", "string")]
    (tmp_path / "h.txt").write_text("only\n")
    with pytest.raises(Exception, match="expected 2 fields"):
        S.read_edges(spark, str(tmp_path), strict=True).collect()


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id long, value double")
    S.write_key_values(v, str(tmp_path / "v"))
    assert S.read_result_vector(spark, str(tmp_path / "v")) == {1: 0.5, 2: 0.25}
    m = spark.createDataFrame([(1, 2, 0.5)], "row long, col long, val double")
    S.write_values(m, str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["1 2 0.5"]
    (tmp_path / "kv.txt").write_text("a\tb\tc\nd\n")
    assert [tuple(r) for r in S.read_key_values(spark, str(tmp_path / "kv.txt")).collect()] == [("a", "b\tc"), ("d", "")]


def test_corpus(spark, tmp_path):
    (tmp_path / "c.txt").write_text("T1\nmusic\nl1 a.\nl2\n\n\nT2\nsports\nx\n\nT3\npol")
    got = [tuple(r) for r in S.read_corpus(spark, str(tmp_path / "c.txt")).orderBy("doc_id").collect()]
    assert got == [(0, "T1", "music", "l1 a.\nl2\n"), (1, "T2", "sports", "x\n"), (2, "T3", "pol", "")]
    got = S.read_corpus(spark, str(tmp_path / "c.txt"), labeled=False).orderBy("doc_id").first()
    assert tuple(got) == (0, "T1", None, "music\nl1 a.\nl2\n")


def test_listing(spark, tmp_path):
    a = spark.createDataFrame([(2, 0, "B", "y"), (1, 0, "A", "x"), (3, 1, "", "z")], "doc_id long, cluster int, title string, category string")
    assert {r[0]: r[1] for r in S.cluster_listing(a).collect()} == {0: "A(x), B(y)", 1: ""}
    S.write_listing(a, str(tmp_path / "l"))
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["Cluster 0", "A(x), B(y)", "Cluster 1", ""]


@pytest.mark.parametrize("algorithm", cli.ALGORITHMS)
def test_cli(spark, tmp_path, algorithm):
    words = {"music": "guitar drum song melody", "sports": "goal match team score"}
    records = [f"t{i}\n{c}\n{w} {w.split()[i % 4]}\n" for i in range(8) for c, w in words.items()]
    (tmp_path / "c.txt").write_text("\n".join(records))
    report = cli.main([str(tmp_path / "c.txt"), "--algorithm", algorithm, "--k", "2", "--min-df", "1", "--max-df", "0.9", "--output", str(tmp_path / "out")], spark)
    assert report["purity"] == 1 and report["entropy"] == 0
    assert report["top_docs"].count() == 16
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["x", "--algorithm", "other"])
