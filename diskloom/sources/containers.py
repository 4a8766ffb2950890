"""Disk-image containers: detection, decoding in Arrow batches, and ZIP export."""

from __future__ import annotations

import gzip
import io
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE_SIZE = 901_120
DECODED = "ingest_seq long, name string, container string, content binary, error string"


def detect(filename: Column, content: Column) -> Column:
    """adf, adz, dms or zip by extension, else by leading bytes, else by the size of a plain image; null if unknown."""
    extension = F.lower(F.regexp_extract(filename, r"(?s)\.([^.]*)\z", 1))
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(extension.isin("adf", "adz", "dms", "zip"), extension).when(head.startswith("1F8B"), "adz").when(head.startswith("504B"), "zip").when(head == "444D5321", "dms")
        .when(F.length(content) == IMAGE_SIZE, "adf")
    )


def _adf(name: str, data: bytes) -> list[tuple[str, bytes]]:
    return [(name, data)]


def _adz(name: str, data: bytes) -> list[tuple[str, bytes]]:
    return [(name, gzip.decompress(data))]


def _zip(name: str, data: bytes) -> list[tuple[str, bytes]]:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for entry in z.infolist():
            low = entry.filename.lower()
            if low.endswith(".adf"):
                out.append((entry.filename, z.read(entry)))
            elif low.endswith(".adz"):
                out.append((entry.filename, gzip.decompress(z.read(entry))))
    if not out:
        raise ValueError("no disk image in the archive")
    return out


def _dms(name: str, data: bytes) -> list[tuple[str, bytes]]:
    if not shutil.which("xdms"):
        raise ValueError("xdms isn't installed")
    with tempfile.TemporaryDirectory() as folder:
        source = Path(folder) / "input.dms"
        source.write_bytes(data)
        subprocess.run(["xdms", "u", str(source)], cwd=folder, check=True, capture_output=True, timeout=60)
        return [(name, (Path(folder) / "input.adf").read_bytes())]


#: Decoders by container; more can be registered.
DECODERS: dict[str, Callable[[str, bytes], list[tuple[str, bytes]]]] = {"adf": _adf, "adz": _adz, "zip": _zip, "dms": _dms}


def decode(uploads: DataFrame) -> DataFrame:
    """Images in uploads (``ingest_seq``, ``filename``, ``content``): one row per image, or one with ``error`` (and no content).

    Archive entries keep their folder in the name and are recorded as zip;
    entries decoded before a later one fails are dropped with it.
    """
    decoders = dict(DECODERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for seq, name, kind, data in zip(frame["ingest_seq"], frame["filename"], frame["container"], frame["content"], strict=True):
                try:
                    if kind not in decoders:
                        raise ValueError("unknown container")
                    out += [(seq, n, kind, d, None) for n, d in decoders[kind](name, bytes(data))]
                except Exception as e:
                    out.append((seq, name, kind, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["ingest_seq", "name", "container", "content", "error"])

    return uploads.select("ingest_seq", "filename", detect(F.col("filename"), F.col("content")).alias("container"), "content").mapInPandas(run, DECODED)


def walk(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """``path``, ``content`` of every admissible file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").where(F.col("path").rlike(r"(?i)\.(adf|adz|dms|zip)\z"))


def zip_export(files: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One stored ZIP per group of ``keys``, from ``canonical`` and ``content``; a group is the disks of one set, whose number is declared and small."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
            for name, data in sorted(zip(group["canonical"], group["content"], strict=True), key=lambda x: x[0]):
                z.writestr(zipfile.ZipInfo(name), bytes(data))
        return pd.DataFrame({k: [group[k].iloc[0]] for k in keys} | {"archive": [buffer.getvalue()]})

    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.select(*keys, "canonical", "content").groupBy(*keys).applyInPandas(pack, f"{kinds}, archive binary")


def zip_each(files: DataFrame, broken: int = 0) -> DataFrame:
    """Every file (``ingest_seq``, ``filename``, ``content``) as an archive of its own, of the same columns: the file, the same gzipped beside it, and a text.

    With ``broken`` the archives whose number it divides are cut short.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for seq, name, data in zip(frame["ingest_seq"], frame["filename"], frame["content"], strict=True):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
                    for entry, packed in ((name, bytes(data)), (name[:-4] + ".adz", gzip.compress(bytes(data) + b"+")), ("readme.txt", b"no image")):
                        z.writestr(zipfile.ZipInfo(entry), packed)
                whole = buffer.getvalue()
                out.append(whole[:40] if broken and seq % broken == 0 else whole)
            yield pd.DataFrame({"ingest_seq": frame["ingest_seq"], "filename": frame["filename"] + ".zip", "content": out})

    return files.select("ingest_seq", "filename", "content").mapInPandas(run, "ingest_seq long, filename string, content binary")
