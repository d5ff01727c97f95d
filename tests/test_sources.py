import subprocess
import sys
from pathlib import Path

import pytest

from suffloom.functions.codecs import uint40_decode
from suffloom.functions.kernel import suffix_array
from suffloom.operators import suffix_array as sa
from suffloom.sources import chunks, sa5
from suffloom.streaming.incremental import index_stream

TEXT = b"she sells sea shells by the sea shore\0\xff" * 5


def test_sa5_files_join_to_the_array(spark, tmp_path):
    df = spark.createDataFrame([(0, bytearray(TEXT))], "text_id bigint, bytes binary")
    path = str(tmp_path / "out.sa5")
    sa5.write_sa5(sa.suffix_array(df), path, partitions=3)
    raw = b"".join(p.read_bytes() for p in sorted(Path(path).glob("part-*")))
    assert uint40_decode(raw).tolist() == suffix_array(TEXT).tolist()
    assert [r["pos"] for r in sa5.read_sa5(spark, path).orderBy("rank").collect()] == suffix_array(TEXT).tolist()
    with pytest.raises(Exception, match="already"):
        sa5.write_sa5(sa.suffix_array(df), path)
    sa5.write_sa5(sa.suffix_array(df), path, mode="overwrite")
    assert sa5.read_sa5(spark, path).count() == len(TEXT)


def test_missing_ranks_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1), (2, 0)], "rank bigint, pos bigint")
    with pytest.raises(Exception, match="consecutive|missing"):
        sa5.write_sa5(rows, str(tmp_path / "bad.sa5"))


def test_files_as_texts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("b", b"xyx"), ("a", TEXT), ("c", b"")):
        (tmp_path / "in" / name).write_bytes(text)
    got = {r["text_id"]: bytes(r["bytes"]) for r in sa5.read_texts(spark, str(tmp_path / "in")).collect()}
    assert got == {0: TEXT, 1: b"xyx"}  # Spark leaves empty files out; they have no suffixes


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_chunked_files(spark, tmp_path, size):
    (tmp_path / "in").mkdir()
    texts = [TEXT[:50] if size == 1 else TEXT, b"banana" * 3, b"", b"\0"]
    for i, t in enumerate(texts):
        (tmp_path / "in" / f"f{i}").write_bytes(t)
    got = {}
    for r in sa.of_chunks(chunks.read_chunks(spark, str(tmp_path / "in"), size)).collect():
        got.setdefault(r["text_id"], {})[r["rank"]] = (r["pos"], r["n"], r["sym"], r["prev"])
    for i, t in enumerate(texts):
        want = {k: (int(p), len(t), t[p], t[p - 1] if p else 0) for k, p in enumerate(suffix_array(t))}
        assert got.get(i, {}) == want


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(0, bytearray(TEXT)), (1, bytearray(b"abab"))], "text_id bigint, bytes binary")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    index_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert [r["pos"] for r in got.where("text_id = 0").orderBy("rank").collect()] == suffix_array(TEXT).tolist()


def test_command_line(tmp_path):
    (tmp_path / "t").write_bytes(TEXT)
    root = Path(__file__).resolve().parent.parent
    run = subprocess.run([sys.executable, "-m", "suffloom.cli", str(tmp_path / "t"), "-m", "1Gi"], cwd=root, capture_output=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "t.sa5").glob("part-*")))
    assert uint40_decode(raw).tolist() == suffix_array(TEXT).tolist()
