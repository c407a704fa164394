"""Configuration, provenance, metadata files, the session's folder, and both query registries."""

import hashlib
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from gridloom.sources import config, metadata, provenance, session


def test_config(tmp_path, monkeypatch):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: 2}\nb: [1, 2]\nroot: ${GL_ROOT}/data\n")
    (tmp_path / "own.yaml").write_text("inherit: base.yaml\na: {y: 3}\nb: [9]\n")
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "own.yaml")
    monkeypatch.setenv("GL_ROOT", "/vol")
    assert config.load(tmp_path / "own.yaml") == {"a": {"x": 1, "y": 3}, "b": [9], "root": "/vol/data"}
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "none.yaml")


def test_provenance(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc" * 1000)
    row = provenance.file_hashes(spark, str(tmp_path / "f.bin")).first()
    assert row["bytes"] == 3000 and row["sha256"] == hashlib.sha256(b"abc" * 1000).hexdigest()
    found = provenance.manifest(spark, {"a": 1}, [0, 1])
    assert found["seeds"] == [0, 1] and found["versions"]["pyspark"]
    provenance.write_manifest(found, str(tmp_path / "m.json"))
    sink = []
    with pytest.raises(RuntimeError), provenance.timed("x", sink):
        raise RuntimeError
    assert sink[0]["label"] == "x" and sink[0]["seconds"] >= 0
    log = str(tmp_path / "log.md")
    assert [provenance.log_decision(log, "a\nb", "c"), provenance.log_decision(log, "d", "e")] == [1, 2]
    assert provenance.snapshot(str(tmp_path), "*.bin").name == "f.bin"
    with pytest.raises(FileNotFoundError):
        provenance.snapshot(str(tmp_path), "*.none")


def test_metadata(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Cell\tSample \tPatient\tCelltype (major-lineage)\nc1\ts\tp\tB\n")
    got = metadata.read_metadata(spark, str(tmp_path / "m.tsv")).first()
    assert tuple(got) == ("c1", "p", "B", "NA")
    with pytest.raises(ValueError):
        metadata.aliased(spark.createDataFrame([("c", "B")], "cell string, `Celltype (major-lineage)` string"))
    with pytest.raises(ValueError):
        metadata.aliased(spark.createDataFrame([("c", "p")], "cell string, donor string"))


def test_cut_and_discard(spark):
    out = session.cut(spark.range(5))
    assert out.count() == 5 and Path(out._cut_path.removeprefix("file://")).exists()
    session.discard(out)
    assert not Path(out._cut_path.removeprefix("file://")).exists()


def test_the_rest_runs_without_the_training_data_package():
    code = "import sys; sys.modules['gridloom.llm'] = None\nimport importlib.machinery\nimport __spark_entry__ as e\nprint(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code.replace("sys.modules['gridloom.llm'] = None", "pass")], capture_output=True, text=True, cwd=Path(entry.__file__).parent)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 70
    here = Path(entry.__file__).parent / "gridloom"
    for p in here.rglob("*.py"):
        assert "llm" in p.parts or "gridloom.llm" not in p.read_text(), p
