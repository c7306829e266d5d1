import pytest
from pyspark.errors import PySparkException

from spectral_topics.sources import text


@pytest.fixture
def write(tmp_path):
    def make(*lines):
        path = tmp_path / "in.txt"
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    return make


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bag_of_words(spark, write):
    path = write("12 2 3:1 7:2.5", "13 0", "  14\t1   3:-1 ", "17 2 3:1 3:4", "18 5 3:1e2")
    docs, tokens = text.read_bow_text(spark, path)
    assert rows(docs) == [(12,), (13,), (14,), (17,), (18,)]
    assert rows(tokens) == [(12, 3, 1.0), (12, 7, 2.5), (14, 3, -1.0), (17, 3, 1.0), (17, 3, 4.0), (18, 3, 100.0)]


@pytest.mark.parametrize("bad", ["", "15", "x 1 3:1"])
def test_bad_line(spark, write, bad):
    path = write("12 1 3:1", bad, "13 1 4:1")
    docs, tokens = text.read_bow_text(spark, path)
    with pytest.raises(PySparkException, match="not a bag-of-words line"):
        docs.count()
    docs, tokens = text.read_bow_text(spark, path, mode="permissive")
    assert rows(docs) == [(12,), (13,)] and rows(tokens) == [(12, 3, 1.0), (13, 4, 1.0)]
    assert tuple(text.bow_text_quality(spark, path).first()) == (3, 1, 0)


@pytest.mark.parametrize("bad", ["bad", "x:1", "3:", "3:y", ":1"])
def test_bad_token(spark, write, bad):
    path = write(f"14 2 {bad} 5:2")
    docs, tokens = text.read_bow_text(spark, path)
    assert docs.count() == 1
    with pytest.raises(PySparkException, match="malformed token"):
        tokens.count()
    assert rows(text.read_bow_text(spark, path, mode="permissive")[1]) == [(14, 5, 2.0)]
    assert tuple(text.bow_text_quality(spark, path).first()) == (1, 0, 1)


def test_unknown_mode(spark, write):
    with pytest.raises(ValueError):
        text.read_bow_text(spark, write("1 0"), mode="lenient")


def test_dense_rows(spark, write):
    path = write("0 0.5 1.25 -3", "2\t7")
    assert rows(text.read_rows_text(spark, path)) == [(0, [0.5, 1.25, -3.0]), (2, [7.0])]
    with pytest.raises(PySparkException, match="not a matrix row"):
        text.read_rows_text(spark, write("0 1", "5")).count()
    assert rows(text.read_rows_text(spark, write("0 1", "5", "6 x"), mode="permissive")) == [(0, [1.0])]


def test_saved_matrix(spark, write):
    path = write("0\t\t0.5,0.25,", "1\t3.5\t1,oops,2")
    assert rows(text.read_matrix_text(spark, path)) == [(0, [0.5, 0.25]), (1, [1.0, 2.0])]
    with pytest.raises(PySparkException, match="not a saved matrix row"):
        text.read_matrix_text(spark, write("0\t1")).count()


def test_written_matrix_is_in_row_order(spark, tmp_path):
    frame = spark.createDataFrame([(i, [i / 8, -1.0]) for i in reversed(range(50))], "row_id long, vec array<double>")
    path = str(tmp_path / "out")
    text.write_matrix_text(frame, path, files=3)
    parts = sorted((tmp_path / "out").glob("part-*"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert lines == [f"{i}\t{i / 8:.6f}\t-1.000000" for i in range(50)]
    assert rows(text.read_rows_text(spark, path)) == [(i, [i / 8, -1.0]) for i in range(50)]
