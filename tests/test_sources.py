"""FASTQ, FASTA, SAM text, the command line and the stream."""

import os
import subprocess
import sys

import pytest

from seqloom import config
from seqloom.plans import pipeline
from seqloom.sources import fastq
from seqloom.streaming.collapse import running_counts


def _write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def test_any_chunking_gives_the_same_records(tmp_path):
    data = b"".join(b"@r%d some text\nACGTAC\n+\n%s\n" % (k, q) for k, q in enumerate([b"@+IIII", b"+@@@@I", b"IIIIII", b"@@@@@@", b"++++++"] * 3))
    path = _write(tmp_path, "a.fastq", data.rstrip(b"\n"))
    whole = list(fastq.records(path, 0, len(data)))
    assert len(whole) == 15 and whole[0] == ("r0 some text", "ACGTAC", "@+IIII")
    for chunk in (1, 3, 7, 20, 64):
        got = [r for at in range(0, len(data), chunk) for r in fastq.records(path, at, at + chunk)]
        assert got == whole


def test_line_ends_empty_and_truncated(spark, tmp_path):
    crlf = _write(tmp_path, "c.fastq", b"@a\r\nACGT\r\n+\r\nIIII\r\n")
    empty = _write(tmp_path, "e.fastq", b"")
    assert [tuple(r) for r in fastq.scan(spark, [empty, crlf]).collect()] == [(1, "a", "ACGT", "IIII")]
    with pytest.raises(ValueError):
        list(fastq.records(_write(tmp_path, "t.fastq", b"@a\nACGT\n+\n"), 0, 10))
    with pytest.raises(FileNotFoundError):
        fastq.scan(spark, [str(tmp_path / "missing.fastq")])


def test_command_line(tmp_path):
    got = config.parse(["-r", "a", "-r", "b", "-g", "g", "-o", "x", "-u", "-e", "1"])
    assert (got.reads, got.unified, got.errors, got.hits, got.complexity) == (["a", "b"], True, 1, 5, 6)
    for bad in (["-g", "g", "-o", "x"], ["-r", "a", "-g", "g"], ["-r", "a", "-r", "b", "-g", "g", "-o", "x"], ["-r", "a", "-g", "g", "-o", "x", "-o", "y", "-u"]):
        with pytest.raises(ValueError):
            config.parse(bad)
    with pytest.raises(SystemExit):
        config.parse(["--what"])


def test_files_to_sam(spark, tmp_path):
    genome = "GATTACAGGCTTAACCGTACGATCGGATTC"
    fa = _write(tmp_path, "g.fa", f">one first\n{genome[:20]}\n{genome[20:]}\n>two\nCCCCGGGGAAATTTTCC\n".encode())
    fq = _write(tmp_path, "r.fastq", f"@x\n{genome[5:20]}\n+\n{'I' * 15}\n".encode())
    out, dump = str(tmp_path / "out"), str(tmp_path / "dump")
    pipeline.run(spark, config.parse(["-r", fq, "-g", fa, "-o", out, "-c", dump]))
    lines = [line for f in sorted(os.listdir(out)) if f.endswith(".txt") for line in open(f"{out}/{f}").read().splitlines()]
    assert lines[:3] == ["@HD\tVN:1.6\tSO:unsorted", "@SQ\tSN:one\tLN:30", "@SQ\tSN:two\tLN:17"]
    assert len(lines) == 4 and lines[3].split("\t")[:6] == ["x", "0", "one", "6", "40", "15="] and lines[3].endswith("NH:i:1\tHI:i:1\tIH:i:1\tNM:i:0")
    assert spark.read.text(dump).first()[0] == "@read1__1"


def test_command_line_runs_anywhere(tmp_path):
    """From another folder, without the package on the workers' path; arrival order names a unified line."""
    genome = "GATTACAGGCTTAACCGTACGATCGGATTC"
    fa = _write(tmp_path, "g.fa", f">one>x first\n{genome}\n>one\nCCCCGGGGAAATTTTCC\n".encode())
    fq = _write(tmp_path, "r.fastq", "".join(f"@{n}\n{genome[5:20]}\n+\n{'I' * 15}\n" for n in ("z", "a")).encode())
    out = str(tmp_path / "out")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.path.insert(0, {root!r}); from seqloom.plans import pipeline; pipeline.main(sys.argv[1:])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    subprocess.run([sys.executable, "-c", code, "-r", fq, "-g", fa, "-o", out, "-u"], check=True, cwd=str(tmp_path), env=env)
    lines = [line for f in sorted(os.listdir(out)) if f.endswith(".txt") for line in open(f"{out}/{f}").read().splitlines()]
    assert lines[1:3] == ["@SQ\tSN:one>x\tLN:30", "@SQ\tSN:one\tLN:17"] and lines[3].split("\t")[:3] == ["z_2", "0", "one>x"]


def test_blocks_and_folders(spark, tmp_path):
    data = b"".join(b"@r%d\nACGTACGTAC\n+\nIIIIIIIIII\n" % k for k in range(300))
    (tmp_path / "s").mkdir()
    for name, part in (("b", data[: data.index(b"@r100\n")]), ("a", data[data.index(b"@r100\n") :]), ("_hidden", b"junk")):
        (tmp_path / "s" / name).write_bytes(part)
    whole = list(fastq.records(_write(tmp_path, "w.fastq", data), 0, len(data)))
    for block in (1, 5, 64, 1000):
        assert list(fastq.records(str(tmp_path / "w.fastq"), 0, len(data), block)) == whole
    both = fastq.scan(spark, [str(tmp_path / "s"), str(tmp_path / "w.fastq")], chunk=500, places=True).orderBy("sample", "at").collect()
    got = [g for g in both if g["sample"] == 1]
    assert [(g["name"], g["seq"], g["qual"]) for g in got] == whole
    assert [(g["name"], g["seq"], g["qual"]) for g in both if g["sample"] == 0] == whole[100:] + whole[:100]
    assert [data[g["at"] : g["at"] + 1] for g in got] == [b"@"] * 300
    with pytest.raises(ValueError):
        list(fastq.records(_write(tmp_path, "m.fastq", b"@a\nACGT\n-\nIIII\n"), 0, 20))


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([(0, "a", "ACGTACGTAC", "I" * 10), (1, "b", "ACGTACGTAC", "I" * 10)], "sample int, name string, seq string, qual string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sample int, name string, seq string, qual string").parquet(str(tmp_path / "in"))
    query = running_counts(stream, 2, "running", str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("running").collect()] == [("ACGTACGTAC", 1, 1)]
