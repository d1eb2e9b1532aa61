"""Helpers that the corpus operators share: durable intermediates, word counts and safe column names."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: space, and tab to carriage return.
WS_CLASS = "[\\x20\\x09-\\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
ASCII_WS = str.maketrans({c: " " for c in WS_CHARS})


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``. Where none is named, a fresh folder of this machine, in local mode only:
    on a cluster that would scatter the parts over machines, so it is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("name a shared folder in spark.checkpoint.dir")
            folder = tempfile.mkdtemp(prefix="framewright-ckpt-")
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder: later uses read the copy, so a lost executor costs a re-read and not the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows (of a few bytes each); a larger one is left to Spark's joins."""
    return F.broadcast(df) if df.count() <= most else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that ``df`` doesn't have (compared without case, as Spark resolves them)."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def word_count(text: Column) -> Column:
    """Number of runs of characters outside ``WS_CLASS``; null counts as empty. JVM expressions only.

    Every part is evaluated for each row, so that the code generator computes the squeezed text once.
    """
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WS_CLASS + "+", " "))
    return (F.octet_length(squeezed) - F.octet_length(F.replace(squeezed, F.lit(" "), F.lit(""))) + (squeezed != "").cast("int")).cast("long")


def split_words(text: str | None) -> list[str]:
    """The words of ``word_count`` in Python."""
    return [w for w in text.translate(ASCII_WS).split(" ") if w] if text else []


def salted_left_join(rows: DataFrame, named: DataFrame, key: str, salt_on: str) -> DataFrame:
    """``rows`` left joined with ``named`` (one row for each ``key``), however many rows share a key or have none.

    The key is extended by a salt of ``salt_on``; ``named`` is repeated only for the (key, salt) that occur, which Spark finds with a
    map-side distinct. Rows whose key is null don't take part in the shuffle of one key: their salt spreads them.
    """
    salts = partitions(rows.sparkSession) * 4
    salted = rows.withColumn("salt__", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    present = salted.filter(F.col(key).isNotNull()).select(key, "salt__").distinct()
    return salted.join(present.join(named, key), [key, "salt__"], "left").drop("salt__")


#: Resolution of the hash thresholds below.
_FINE = 1 << 40


def share_below(h: Column, share: Column) -> Column:
    """True for about ``share`` of all hashes ``h``, the same ones each time."""
    return F.pmod(h, F.lit(_FINE)) < F.least(share, F.lit(1.0)) * float(_FINE)


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, chosen by the hash of ``key``. Rows above a hash threshold are left out while the table is read, so that the tasks together
    send the driver about 1.5 n rows however many tasks there are."""
    h = F.xxhash64(key)
    return df.filter(share_below(h, F.lit(1.5 * n / max(1, df.count())))).orderBy(h, key).limit(n)


@lru_cache(maxsize=1)
def one_blas_thread() -> None:
    """Keep this process's matrix products on one thread: a Spark task has one core, and small products on many threads only wait for each other."""
    try:
        with open("/proc/self/maps") as f:
            libraries = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:  # no such file on this system; the environment's setting holds
        return
    for path in sorted(libraries):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """What a worker process keeps from task to task under ``key``; one operator's at a time, so that a process that serves several stages doesn't hold them all."""
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def drop_kept() -> None:
    """Forget what earlier tasks of other operators left in this worker: one that keeps nothing itself must not hold their caches beside its own work."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def task(run: Callable) -> Callable:
    """``run`` over batches, in one thread, giving freed memory back to the system after each batch and at the end: an executor's processes outlive their tasks
    and share its memory with the JVM."""

    def work(batches: Iterator) -> Iterator:
        one_blas_thread()

        def fed() -> Iterator:
            for b in batches:
                yield b
                del b
                give_back()

        try:
            yield from run(fed())
        finally:
            give_back()

    return work


def give_back() -> None:
    """Return freed memory to the system, which worker processes otherwise hold for as long as they live."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
