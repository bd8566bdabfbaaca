"""Configuration, run hashes, packages of files and protected outputs.

These are small things of the driver; file contents are hashed by Spark where they are many (`files.manifest`).
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import wave
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import inventory
from tonelake.sources import files


def load_config(path: str, defaults: dict | None = None, paths: tuple[str, ...] = ()) -> dict:
    """A YAML or JSON configuration over defaults (maps are merged); entries of `paths` become absolute against the file's folder."""
    text = Path(path).read_text(encoding="utf-8-sig")
    if path.endswith(".json"):
        own = json.loads(text)
    else:
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise RuntimeError("YAML configurations need the yaml package; JSON ones do not") from e
        own = yaml.safe_load(text)
    if own is not None and not isinstance(own, dict):
        raise ValueError(f"{path} is no map")
    out = merged(defaults or {}, own or {})
    for key in paths:
        at, *rest = key.split(".")[::-1]
        node = out
        for k in reversed(rest):
            node = node.get(k, {})
        if isinstance(node.get(at), str) and not Path(node[at]).is_absolute():
            node[at] = str((Path(path).resolve().parent / node[at]).resolve())
    return out


def merged(base: dict, over: dict) -> dict:
    """`over` on top of `base`, maps key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def run_hash(config: dict) -> str:
    """First 16 hex digits of the SHA-256 of a configuration with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode("utf-8")).hexdigest()[:16]


def save_run(df: DataFrame, path: str, run: str, config: dict) -> None:
    """Appends a unit of work under the run's tag and its configuration's hash."""
    df.withColumns({"run": F.lit(run), "config": F.lit(run_hash(config))}).write.mode("append").partitionBy("run", "config").parquet(path)


def saved_run(spark: SparkSession, path: str, run: str, config: dict) -> DataFrame | None:
    """The units saved under this tag with this very configuration; None before the first."""
    if not files.exists(spark, path):
        return None
    # hashes may look like numbers, so partition values stay text
    saved = spark.read.option("mergeSchema", True).parquet(path)
    return saved.where((F.col("run").cast("string") == run) & (F.col("config").cast("string") == run_hash(config))).drop("run", "config")


def listing(spark: SparkSession, root: str, pruned: tuple[str, ...] = ("archive",)) -> DataFrame:
    """(path, bytes) of the files under a folder in order, without those below pruned folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    for name in pruned:
        found = found.where(~F.lower("path").rlike(f"/{name.lower()}(/|$)"))
    return found.orderBy("path")


def package(root: str, target: str, pruned: tuple[str, ...] = ("archive",)) -> list[tuple[str, int, str]]:
    """Writes the files under a folder of this machine into a ZIP with a manifest; returns (path, bytes, sha256) in order. Times are fixed, so equal files give equal packages."""
    out = []
    base = Path(root)
    names = sorted(p for p in base.rglob("*") if p.is_file() and not set(x.lower() for x in p.relative_to(base).parts[:-1]) & set(pruned) and p.resolve() != Path(target).resolve())
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        def put(name: str, content: bytes) -> None:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)

        for p in names:
            content = p.read_bytes()
            out.append((p.relative_to(base).as_posix(), len(content), hashlib.sha256(content).hexdigest()))
            put(out[-1][0], content)
        put("manifest.csv", ("path,bytes,sha256\n" + "".join(f"{a},{b},{c}\n" for a, b, c in out)).encode("utf-8"))
    return out


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two manifests: protected outputs must give no row."""
    return inventory.table_diff(before.select("path", "sha256"), after.select("path", "sha256"), "path")


def update_table(spark: SparkSession, path: str, changes: DataFrame, on: list[str], target: str) -> None:
    """A table with some columns replaced where `changes` has the key, written to another path; keys that are new are refused."""
    own = spark.read.parquet(path)
    news = [c for c in changes.columns if c not in on]
    if changes.join(own, on, "left_anti").limit(1).count():
        raise ValueError("changes of keys that the table does not hold")
    marked = changes.select(*on, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in news))
    both = own.join(marked, on, "left")
    # a null in the changes replaces too
    both.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in news else F.col(c) for c in own.columns), *(F.col(f"_new_{c}").alias(c) for c in news if c not in own.columns)).write.mode("overwrite").parquet(target)


def encode_wav(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A PCM wave file of 16 or 24 bits, or of 32-bit floats; samples (channels x frames) are clipped to -1..1."""
    x = np.clip(np.atleast_2d(np.asarray(samples, dtype=np.float64)), -1.0, 1.0).T
    if bits == 32:
        body = x.astype("<f4").tobytes()
        head = struct.pack("<HHIIHH", 3, x.shape[1], rate, rate * x.shape[1] * 4, x.shape[1] * 4, 32)
        return b"RIFF" + struct.pack("<I", 4 + 8 + len(head) + 8 + len(body)) + b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(body)) + body
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(bits // 8)
        w.setframerate(rate)
        whole = np.ascontiguousarray(np.round(x * ((1 << (bits - 1)) - 1)).astype("<i4"))
        w.writeframes(whole.astype("<i2").tobytes() if bits == 16 else whole.view(np.uint8).reshape(*whole.shape, 4)[:, :, :3].tobytes())
    return out.getvalue()


def decode_float_wav(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples by channel) of a wave file of 32- or 64-bit floats; raises ValueError for anything else."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
        elif name == b"data":
            if form is None or form[0] != 3 or form[5] not in (32, 64):
                raise ValueError("no float samples")
            x = np.frombuffer(content[at + 8 : at + 8 + size], f"<f{form[5] // 8}").astype(np.float64)
            return form[2], x.reshape(-1, form[1]).T
        at += 8 + size + size % 2
    raise ValueError("no data")


def resampled(x: np.ndarray, rate: int, target: int, half: int = 16) -> np.ndarray:
    """A signal at another rate by a polyphase windowed-sinc filter for the reduced ratio of the rates."""
    from math import gcd

    g = gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        return np.asarray(x, dtype=float).copy()
    cutoff = 1.0 / max(up, down)
    t = np.arange(-half * max(up, down), half * max(up, down) + 1)
    taps = cutoff * np.sinc(cutoff * t) * np.hanning(len(t)) * up
    centre = len(t) // 2
    n = -(-len(x) * up // down)
    out = np.zeros(n)
    for phase in range(up):  # one short filter per phase
        part = taps[phase::up]
        full = np.convolve(x, part)
        k = np.arange(n)
        place = k * down + centre
        mine = place % up == phase
        at = place[mine] // up
        ok = at < len(full)
        idx = np.flatnonzero(mine)[ok]
        out[idx] = full[at[ok]]
    return out
