from pyspark.sql import functions as F

from tessera.sources import documents as D
from tessera.sources import plugins as X
from tessera.streaming import ingest as I


def test_chunks_survive_json_lines(spark, tmp_path):
    rows = [("a", "d", 0, ["T", "x"], None, "text", "line sep \"q\"", "e", 3, None), ("b", None, None, None, 4, "table", None, None, None, ("matched", True, 1, 2))]
    df = spark.createDataFrame(rows, D.CHUNK_SCHEMA)
    D.write_chunks(df, str(tmp_path / "c"))
    assert '"page":null' in spark.read.text(str(tmp_path / "c")).where(F.col("value").contains('"a"')).first()[0]
    back = {r["chunk_id"]: r for r in D.read_chunks(spark, str(tmp_path / "c")).collect()}
    assert back["a"]["content"] == rows[0][6] and back["a"]["page"] is None and back["b"]["page"] == 4


def test_files_by_content(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"one")
    (tmp_path / "sub" / "._b.pdf").write_bytes(b"no")
    (tmp_path / "c.pdf").write_bytes(b"two")
    files = D.scan_files(spark, str(tmp_path))
    assert files.count() == 3 and files.select("doc_id").distinct().count() == 2
    known = files.where(F.col("path").endswith("c.pdf")).select("doc_id")
    assert D.new_files(files, known).count() == 1


def test_metadata(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "metadata.json").write_text('{\n "doc_id": "d",\n "title": "T"\n}')
    assert D.read_metadata(spark, str(tmp_path / "*" / "metadata.json")).first()["title"] == "T"


def test_ladder_of_failures(spark):
    class Broken(X.Extractor):
        name = "broken"

        def extract(self, path, first, last):
            if last - first > 40:
                raise ValueError("too large")
            return f"{first}-{last}"

    class Plain(X.Extractor):
        name = "plain"

        def extract(self, path, first, last):
            return "text " * 5000

    assert X.windows(200) == [(0, 79), (80, 159), (160, 199)] and X.windows(100) == [(0, 99)]
    assert X.extract_window(Broken(), "p", 0, 30)[0] == "ok"
    assert X.extract_window(Broken(), "p", 0, 79)[:2] == ("ok", "0-39\n\n40-79")
    assert X.extract_window(Broken(), "p", 0, 79, Plain())[0] == "degraded"
    assert X.extract_window(Broken(), "p", 0, 199)[0] == "missing"
    rows = [("d", "p", 0, 30), ("d", "p", 31, 200), ("e", "p", 0, 10)]
    done = X.extract_segments(spark.createDataFrame(rows, "doc_id string, path string, first int, last int"), Broken())
    out = {r["doc_id"]: r for r in X.assemble(done).collect()}
    assert out["d"]["missing"] == [31] and out["e"]["text"] == "0-10" and out["d"]["text"].startswith("0-30")
    assert X.choose("auto").name == "text"


def test_streams_take_each_key_once_and_again_nothing(spark, tmp_path):
    src = str(tmp_path / "src")
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    df.write.parquet(src)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):
        I.ingest(spark, src, out, state, "k")
        assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int").write.mode("append").parquet(src)
    I.ingest(spark, src, out, state, "k")
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    target = str(tmp_path / "target")
    for _ in range(2):
        I.merge_batches(I.stream_table(spark, src), target, str(tmp_path / "merge"), "k")
    assert spark.read.parquet(target).count() == 3
