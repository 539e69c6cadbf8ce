"""Quality rules: zstandard ratios of whole documents and of fixed chunks, within bands that depend on the length.

A ratio is compressed bytes by bytes. Repetitive text compresses below the lower limit of its band, random or encoded
text stays above the upper one. The whole document is judged by the band of its length. Of its chunks of ``CHUNK`` bytes, a
document may have up to ``BAD_SHARE`` outside the band of their length: a repeated stretch or a block of encoded data inside
an ordinary document rejects it only if it is a good part of it. Hexadecimal data compresses like prose; so a document may
have up to ``BAD_SHARE`` of its bytes in words in which letters and digits change places twice or more.

Base rules come first: at least ``MIN_WORDS`` words, and at most ``REPEAT_PERCENT`` of the words inside 8-word windows that
occur twice or more.

Defined results: a null or empty text has no words, fails the base rules and has null ratios; repeated rows are judged each;
a null id stays null; extra columns are left out by ``judge``, kept by ``kept_documents``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import documents, in_arrow, slices

MIN_WORDS = 20
REPEAT_WORDS = 8
REPEAT_PERCENT = 30
CHUNK = 4096
BAD_SHARE = 0.25
LEVEL = 3
#: (bytes up to, lowest, highest ratio). Short texts compress less, and the frame's own bytes weigh more. The
#: limits lie between what prose gives and what base64 gives at the band's upper end: see README.
BANDS = (
    (160, 0.55, 1.00),
    (192, 0.55, 0.945),
    (256, 0.50, 0.90),
    (384, 0.45, 0.83),
    (512, 0.45, 0.80),
    (768, 0.42, 0.76),
    (1024, 0.42, 0.74),
    (2048, 0.36, 0.70),
    (4096, 0.36, 0.68),
    (16384, 0.32, 0.65),
    (None, 0.28, 0.64),
)
#: A word of encoded data: letters and digits change places twice or more. Hexadecimal digits compress like prose.
_CODED = re.compile(rb"[A-Za-z][0-9]+[A-Za-z]|[0-9][A-Za-z]+[0-9]")
SYMBOLS = b"#*$%&|<>"
SHAPE = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, worst_chunk double, bad_chunks long, n_chunks long, base_failed boolean, kept boolean"
)
NAMES = [c.split()[0] for c in SHAPE.split(", ")]
_OTHER = bytes(set(range(256)) - set(SYMBOLS))
_NO_START = bytes([*range(0x09, 0x0E), 0x20, *range(0x80, 0xC0)])


def in_band(size: int, ratio: float) -> bool:
    low, high = next((lo, hi) for to, lo, hi in BANDS if to is None or size <= to)
    return low <= ratio <= high


def repeated_words(words: list[bytes], width: int = REPEAT_WORDS) -> int:
    """Words inside windows of ``width`` words that are found twice or more. Windows are compared by equality of words."""
    if len(words) <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    rank = ids  # rank[i] is the same for equal runs of 1, 2, 4, ... words
    size = 1
    while size < width:
        step = min(size, width - size)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        size += step
    often = np.bincount(rank)[rank] > 1
    if not often.any():
        return 0
    change = np.zeros(len(words) + 1, np.int64)
    change[: len(rank)] += often
    change[width : width + len(rank)] -= often
    return int(np.count_nonzero(np.cumsum(change)))


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = data.split(b"\n")
    if len(lines) == 1:
        return 0
    counts = Counter(line for line in lines if line and not line.isspace())
    return sum(counts.values()) - len(counts)


def coded(words: list[bytes]) -> int:
    """Bytes in words of encoded data."""
    return sum(len(w) for w in words if _CODED.search(w))


def measure(data: bytes | None, press: zstandard.ZstdCompressor) -> tuple:
    data = data or b""
    words = data.split()
    n = len(words)
    repeat = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n
    ratio = worst = None
    bad = chunks = 0
    kept = not base_failed
    if data:
        ratio = len(press.compress(data)) / len(data)
        kept = kept and in_band(len(data), ratio) and coded(words) <= BAD_SHARE * len(data)
        if len(data) > CHUNK:
            parts = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
            if len(parts[-1]) < CHUNK // 4:
                parts[-2:] = [b"".join(parts[-2:])]
            sizes = [len(press.compress(p)) / len(p) for p in parts]
            chunks, bad = len(parts), sum(not in_band(len(p), r) for p, r in zip(parts, sizes))
            worst = min(sizes)
            kept &= bad <= BAD_SHARE * chunks
    return (
        n,
        len(data.translate(None, _NO_START)),
        len(data.translate(None, _OTHER)),
        duplicate_lines(data),
        repeat,
        ratio,
        worst,
        bad,
        chunks,
        base_failed,
        kept,
    )


def judge(docs: DataFrame) -> DataFrame:
    """The figures and the verdict of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        kinds = [*[pa.int64()] * 5, pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        for batch in batches:
            for at, texts in slices(batch):
                columns = zip(*(measure(t, press) for t in texts))
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.record_batch([batch.column("doc_id").slice(at, len(texts)), *arrays], NAMES)

    return in_arrow(documents(docs), run, SHAPE)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose text the rules keep."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for at, texts in slices(batch):
                stays = [measure(t, press)[-1] for t in texts]
                yield batch.slice(at, len(texts)).filter(pa.array(stays, pa.bool_()))

    return in_arrow(docs.select(*(F.col(f"`{c}`") for c in names)), run, docs.schema)
