"""Helpers shared by the operators: table access, the shared folder, files, words and hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# rows and bytes of one Arrow batch, so that a worker holds a few MB of text at a time
BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "2097152"}
# entries of a per-worker cache; a full cache is emptied, which costs time and changes no result
CACHE_ENTRIES = 400_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# folder of the operator that is being built, if it deletes what it stores on the way
_OPEN_LABELS: list[str] = []
_WORD = re.compile(r"[^\W_]+")


def prepare(spark: SparkSession) -> SparkSession:
    """Set the Arrow batch limits; the rest of the session stays as it is."""
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a folder of its own (tests); a cluster is refused.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(named)
        named = context.getCheckpointDir()
    return named.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new name inside the shared folder."""
    return "/".join([shared_folder(spark), *_OPEN_LABELS[-1:], f"{label}-{uuid.uuid4().hex}"])


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing before it."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(build):
    """Run ``build`` (a DataFrame maker), store its result and delete what it stored on the way."""

    @functools.wraps(build)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        outer = _OPEN_LABELS[:]
        folder = f"work-{uuid.uuid4().hex}"
        _OPEN_LABELS.append(folder)
        try:
            result = build(df, *args, **kwargs)
        finally:
            _OPEN_LABELS[:] = outer
        result = stored(result, build.__name__)
        system, path = file_system(f"{shared_folder(df.sparkSession)}/{folder}")
        system.delete_dir_contents(path, missing_dir_ok=True)
        return result

    return run


def file_system(uri: str):
    """The file system and path of a folder named by a URI or a plain path."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)
    return system, path


def held_out(column) -> "F.Column":
    """Rows kept away from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# what this worker process holds between tasks: one model at a time, as an idle worker keeps its memory
_RESIDENT: dict = {}


def resident(key, build):
    """The model of this worker process under ``key``, built once; it takes the place of any other."""
    if key not in _RESIDENT:
        release()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def release() -> None:
    """Give up what earlier operators left in this worker process, to the system where its allocator can."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


class WordHashes(dict):
    """64-bit hash of each word, remembered up to ``CACHE_ENTRIES`` words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words in order; fewer words make one shingle, none make none."""
    if not len(words):
        return words
    size = min(size, len(words))
    end = len(words) - size + 1
    total = mix(words[:end] + np.uint64(size))
    for k in range(1, size):
        total = mix(total * _GOLDEN + words[k : k + end])
    return total


def plain_words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall(text.lower()) if text else []
