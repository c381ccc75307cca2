"""Helpers of the operators: input columns, staged tables, cached word hashing
and cached tokenization."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import unicodedata
import uuid
import zipfile
from collections.abc import Callable
from hashlib import blake2b
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapcast.session import ensure_checkpoint_dir

#: Words per shingle and the similarity that makes a near duplicate.
SHINGLE, SIMILAR = 5, 0.8
#: Entries a per-process cache holds before it is emptied (bounded memory).
CACHE_ENTRIES, TOKEN_ENTRIES = 500_000, 800_000
#: What this process keeps between tasks, and how to empty it.
_KEPT: dict[str, Callable[[], None]] = {}
_OWNER: tuple[str, ...] = ()


def keeps(name: str, clear: Callable[[], None]) -> None:
    """Say that this process keeps something between tasks under a name."""
    _KEPT[name] = clear


def claim(*names: str) -> None:
    """Called as a task starts: empties what workers that are used again still
    keep for other operators, and gives free memory back to the machine. What
    a stage's tasks share stays."""
    global _OWNER
    if names == _OWNER:
        return
    _OWNER = names
    for name, clear in _KEPT.items():
        if name not in names:
            clear()
    release()


def release() -> None:
    """Give memory that is free in this process back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def worker_task(*names: str):
    """For functions over a task's batches: the task claims these names as it
    starts, and gives its free memory back as it ends, for workers wait for
    their next task beside others."""

    def decorated(run: Callable) -> Callable:
        def task(batches):
            claim(*names)
            try:
                yield from run(batches)
            finally:
                release()
        return task
    return decorated


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python
    workers import it, and keep their caches between tasks."""
    sc = spark.sparkContext
    if getattr(sc, "_tapcast_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="tapcast-py-")) / "tapcast_package.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    sc._tapcast_shipped = True


def doc_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text binary): UTF-8 bytes, a null text as empty. Other
    columns go, so their names can't clash with an operator's."""
    ship_package(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col)).alias("text"))


def utf8(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def mix(a: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (splitmix), vectorised."""
    a = np.asarray(a, np.uint64)
    b = a >> np.uint64(30)
    b ^= a
    b *= np.uint64(0xBF58476D1CE4E5B9)
    b ^= b >> np.uint64(27)
    b *= np.uint64(0x94D049BB133111EB)
    b ^= b >> np.uint64(31)
    return b


class _WordHashes(dict):
    """Chunk without white space -> 8-byte hashes of its words, joined."""

    words = re.compile(r"\w+")

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = self.words.findall(chunk.decode("utf-8", "replace").lower())
        out = b"".join(blake2b(w.encode(), digest_size=8).digest() for w in found)
        if len(chunk) <= 64:
            self[chunk] = out
        return out


_WORDS = _WordHashes()
keeps("words", _WORDS.clear)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the lower-cased words (runs of letters, digits and
    underscores) of a whole text. ASCII letters are lowered before the cache
    is asked; white space never lies within a word."""
    return np.frombuffer(b"".join(map(_WORDS.__getitem__, text.lower().split())), np.uint64)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, their one run."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i:n - k + 1 + i])
    return h


def multiset_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two multisets of hashes; two empty ones: 1."""
    if len(a) + len(b) == 0:
        return 1.0
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], m[j]).sum()
    return float(both / (len(a) + len(b) - both))


#: ASCII marks that may end a chunk; they never join a letter before them.
_MARKS = b".,;:!?|%$&*#\"()"


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenEncoder(dict):
    """Whole texts to ids of a ``tokenizers`` file without special tokens.

    The tokenizer drops white space and never merges across it, so a text's
    ids are those of its chunks, which this dictionary caches as little-endian
    unsigned 32-bit bytes. ``lower`` says that the file lower-cases (then
    ASCII letters are lowered before the cache is asked). A chunk of one run
    of normalized lower-case letters goes to the BPE model directly; anything
    else runs through the whole tokenizer. The special tokens' strings are
    ordinary text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.chars = str.maketrans({chr(b): c for b, c in _byte_chars().items()})

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.lower().split()))

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= TOKEN_ENTRIES:
            self.clear()
        core = chunk.rstrip(_MARKS)
        if 0 < len(core) < len(chunk) and core.decode("utf-8", "replace")[-1].isalpha():
            return self.kept(chunk, self[core] + self[chunk[len(core):]])
        s = chunk.decode("utf-8", "replace")
        if s.isalpha() and s == s.lower() and unicodedata.is_normalized("NFC", s):
            got = [t.id for t in self.tok.model.tokenize(chunk.decode("latin-1").translate(self.chars))]
        else:
            got = self.tok.encode(s, add_special_tokens=False).ids
        return self.kept(chunk, np.array(got, "<u4").tobytes())

    def kept(self, chunk: bytes, out: bytes) -> bytes:
        if len(chunk) <= 64:
            self[chunk] = out
        return out


_ENCODERS: dict[str, TokenEncoder] = {}
keeps("tokens", _ENCODERS.clear)


def token_encoder(path: str) -> TokenEncoder:
    """This process's encoder for the file; other operators' tasks drop it."""
    claim("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = TokenEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
