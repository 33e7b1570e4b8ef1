"""Configuration files, alignment matrices, dataset manifests and records of where results come from."""

from __future__ import annotations

import copy
import hashlib
import json
import os
import shutil
import subprocess
import sys
import tomllib
from collections.abc import Iterable, Mapping
from datetime import UTC, datetime
from importlib import metadata
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_toml(path: str | Path, defaults: Mapping[str, Mapping[str, Any]] | None = None, resolve: Iterable[str] = ()) -> dict[str, Any]:
    """A TOML file over defaults, section by section; a section that the defaults lack is an error.

    resolve: "section.key" entries that are paths relative to the file.
    """
    place = Path(path).expanduser().resolve()
    with open(place, "rb") as f:
        out = tomllib.load(f)
    if defaults is not None:
        if strange := sorted(out.keys() - defaults.keys()):
            raise ValueError(f"unknown sections: {', '.join(strange)}")
        out = {name: copy.deepcopy(dict(values)) | out.get(name, {}) for name, values in defaults.items()}
    for section, key in (name.split(".") for name in resolve):
        if (value := out.get(section, {}).get(key)) is not None:
            out[section][key] = str((place.parent / value).resolve())
    return out


def alignment(values: Mapping[str, Any]) -> np.ndarray:
    """The 4x4 matrix of an alignment entry; it must have been validated."""
    numbers = np.asarray(values["matrix"], np.float64).reshape(-1)
    if not values.get("validated", False) or numbers.size != 16 or not np.isfinite(numbers).all():
        raise ValueError("an alignment needs 16 finite values and must be validated")
    return numbers.reshape(4, 4)


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def sha256_json(value: Any) -> str:
    """Of the canonical form: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_json(path: str | Path, value: Any) -> None:
    """Written beside and moved into place, so that readers see the old file or the new one."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(value, indent=2) + "\n", encoding="utf-8")
    os.replace(part, target)


def read_manifest(spark: SparkSession, path: str, version: int | str, verify: bool = False) -> DataFrame:
    """One row a chunk of a complete JSON manifest whose totals are the sums of its chunks; verify: checksums too."""
    value = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))  # a manifest, one small file
    chunks = value.get("chunks") or []
    if str(value.get("schema_version", value.get("version"))) != str(version) or value.get("status") != "complete" or not chunks:
        raise ValueError("the manifest is of another version, not complete, or empty")
    for k in ("frames", "points"):
        if k in value.get("totals", {}) and value["totals"][k] != sum(c[k] for c in chunks):
            raise ValueError(f"{k} of the chunks don't sum to the total")
    rows = [{k: v for k, v in c.items() if k not in ("labels", "files")} | {"chunk_index": i} | c.get("labels", {}) for i, c in enumerate(chunks)]
    out = spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    if verify:
        base = path.rsplit("/", 1)[0]
        listed = [(f["path"], f.get("sha256")) for c in chunks for f in c.get("files") or [c]]
        files = spark.read.format("binaryFile").load([f"{base}/{p}" for p, _ in listed])
        files = files.select(F.substring_index("path", f"/{base.rsplit('/', 1)[-1]}/", -1).alias("path"), F.sha2("content", 256).alias("_sha"))
        wrong = spark.createDataFrame(listed, "path string, sha256 string").join(files, "path", "left").where("not (sha256 <=> _sha)")
        if wrong.take(1):
            raise ValueError("a file's checksum is wrong")
    return out


def code_state(root: str | Path) -> dict[str, Any] | None:
    """The commit that a folder is at and whether files differ from it; None where that can't be told."""
    if not shutil.which("git"):
        return None
    asked = subprocess.run(["git", "describe", "--always", "--exclude=*", "--abbrev=40", "--dirty"], cwd=root, capture_output=True, text=True)
    commit, changed, _ = asked.stdout.strip().partition("-dirty")
    return {"commit": commit, "dirty": bool(changed)} if asked.returncode == 0 else None


def provenance(config: Mapping[str, Any], sources: Iterable[str | Path], packages: Iterable[str] = ("numpy", "pyarrow", "pyspark"), root: str | Path = ".") -> dict[str, Any]:
    """What a result was made from: configuration and sources with hashes, versions, the state of the code, and when."""
    versions = {}
    for p in packages:
        try:
            versions[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            versions[p] = None
    return {
        "started_utc": datetime.now(UTC).isoformat(),
        "python": sys.version.split()[0],
        "packages": versions,
        "git": code_state(root),
        "config": dict(config),
        "config_sha256": sha256_json(config),
        "sources": [{"path": str(Path(s).resolve()), "sha256": sha256_file(s)} for s in sources],
    }
