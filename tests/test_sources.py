"""Archives as a data source, the artifact as lines, and the command line."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from codestrata import __main__ as command
from codestrata.operators import artifact
from codestrata.plans.analysis import Analysis
from codestrata.sources import archives, repository
from tests.test_artifact import FILES, made


def _zip(path, entries):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries:
            z.writestr(name, body)


def test_archive_source_equals_read_zip(spark, tmp_path):
    entries = [(f"top/d{i % 3}/f{i}.py", f"x = {i}\n" * (i + 1)) for i in range(40)] + [("top/big.py", "y" * 5000)]
    _zip(f"{tmp_path}/one.zip", entries)
    _zip(f"{tmp_path}/two.zip", [("a.py", "1"), ("b\\c.py", "2"), ("d/", "")])
    archives.register(spark)
    read = lambda **o: spark.read.format("repository_archive").options(partitionBytes=500, fileBytes=4000, **o).load(str(tmp_path))
    found = read()
    assert found.where("repo = 'one'").select(F.spark_partition_id()).distinct().count() > 3
    raw = spark.read.format("binaryFile").load(f"{tmp_path}/*.zip").select(F.regexp_extract("path", r"([^/]*)\.zip$", 1).alias("repo"), "content")
    want = repository.read_zip(raw, repository.Limits(file_bytes=4000))
    key = lambda df: sorted((r.repo, r.path, bytes(r.content), r.bytes, r.symlink) for r in df.select("repo", "path", "content", "bytes", "symlink").collect())
    assert key(found) == key(want) and len(key(found)) == 43
    assert {bytes(r.content) for r in read(contents="false").collect()} == {b""}
    assert sorted(r.path for r in read().where("path LIKE 'd1/%' AND repo = 'one'").collect()) == sorted(n[4:] for n, _ in entries if n.startswith("top/d1/"))
    assert [r.path for r in read().where("path = 'a.py'").collect()] == ["a.py"]
    files, skipped = repository.discover(found, repository.Limits(file_bytes=4000))
    assert files.count() == 42 and [tuple(r) for r in skipped.collect()] == [("one", "big.py", "file_size_limit")]


def test_archive_source_fails_on_bad_archives(spark, tmp_path):
    archives.register(spark)
    for i, (entries, options, error) in enumerate([([("../x.py", "1")], {}, "PATH_TRAVERSAL_DETECTED"), ([("a.py", "1")], {"archiveBytes": 10}, "ARCHIVE_TOO_LARGE"), ([("a.py", "12345")], {"extractedBytes": 4}, "EXTRACTED_TOO_LARGE")]):
        _zip(f"{tmp_path}/{i}.zip", entries)
        with pytest.raises(Exception, match=error):
            spark.read.format("repository_archive").options(**options).load(f"{tmp_path}/{i}.zip").collect()


def test_document_of_lines_equals_the_artifact(spark, tmp_path):
    a = Analysis(made(spark))
    artifact.write_lines(artifact.artifact_lines(a), f"{tmp_path}/lines")
    want = {r.repo: json.loads(r.json) for r in a.artifact().collect()}
    for repo in ("r", "q"):
        out = io.StringIO()
        artifact.write_document(artifact.read_lines(spark, f"{tmp_path}/lines", repo), out)
        got = json.loads(out.getvalue())
        assert {k: v for k, v in got.items() if k != "generatedAt"} == {k: v for k, v in want[repo].items() if k != "generatedAt"}
    out = io.StringIO()
    artifact.write_document(artifact.read_lines(spark, f"{tmp_path}/lines", "unknown"), out)
    assert out.getvalue() == ""


def test_command_line(spark, tmp_path, capsys):
    root = f"{tmp_path}/tree"
    for _, path, text in FILES[:3]:
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text)
    assert command.main(["analyse", root, "--name", "shop", "--out", f"{tmp_path}/out"]) == 0
    with open(f"{tmp_path}/out.json") as f:
        assert json.load(f)["repository"]["fileCount"] == 3
    assert command.main(["impact", root, "load"]) == 0 and command.main(["export", root, "--format", "dot"]) == 0
    said = capsys.readouterr().out
    assert "shop: 3 files" in said and "api/main.py" in said and "digraph" in said
