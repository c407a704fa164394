"""What a run was made of: file hashes, settings, versions, timings, decisions."""

from __future__ import annotations

import json
import subprocess
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of the files, hashed in the tasks that read them; a file must be under 2 GB."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def versions(packages: tuple[str, ...] = ("pyspark", "pandas", "numpy", "pyarrow")) -> dict[str, str]:
    found = {}
    for p in packages:
        try:
            found[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            found[p] = ""
    return found


def git_commit(folder: str = ".") -> str:
    done = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else ""


def manifest(spark: SparkSession, config: dict, seeds: list[int], extra: dict | None = None) -> dict:
    """Settings, seeds, versions, commit and time. Draws are ordered by hash, so the seeds say it all."""
    conf = dict(spark.sparkContext.getConf().getAll())
    return {
        "written_at": utc_now(),
        "commit": git_commit(),
        "versions": versions(),
        "spark": {"version": spark.version, "master": conf.get("spark.master", ""), "conf": conf},
        "seeds": seeds,
        "config": config,
        **(extra or {}),
    }


def write_manifest(found: dict, path: str) -> None:
    Path(path).write_text(json.dumps(found, indent=2, sort_keys=True, default=str))


@contextmanager
def timed(label: str, sink: list[dict]) -> Iterator[None]:
    """Adds (label, seconds) to sink, also if the body raises."""
    began = time.perf_counter()
    try:
        yield
    finally:
        sink.append({"label": label, "seconds": time.perf_counter() - began})


def log_decision(path: str, text: str, reason: str) -> int:
    """Appends a numbered line to a decision log and returns its number."""
    file = Path(path)
    lines = file.read_text().splitlines() if file.exists() else []
    number = sum(x.startswith("| ") for x in lines) + 1
    with file.open("a") as f:
        f.write(f"| {number} | {utc_now()} | {' '.join(text.split())} | {' '.join(reason.split())} |\n")
    return number


def snapshot(root: str, pattern: str) -> Path:
    """The first path below root that matches, in sorted order; none raises."""
    found = sorted(Path(root).glob(pattern))
    if not found:
        raise FileNotFoundError(f"nothing at {root}/{pattern}")
    return found[0]
