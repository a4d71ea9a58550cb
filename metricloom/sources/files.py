"""SHA-256 and content facts of files of any size, read in byte ranges.

SHA-256 takes a file in order, but its state is a few words.  A round reads one range of every file that is
not done, one task a range, and hands the states after it to the next round; so no task reads more
than a range, however large a file is, and the driver holds one small state a file.

Ranges come from Hadoop's reader of fixed-length records, which refuses an end shorter than a record.
So ranges get smaller towards the end of a file, and the last of them is read byte by byte.
"""

from __future__ import annotations

import codecs
import ctypes
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cache, partial

from pyspark.sql import SparkSession

#: bytes that one task reads of a file
RANGE = 256 << 20
_RECORD = 1 << 20
_FORMAT = "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat"
_INPUT = "mapreduce.input.fileinputformat."
#: Hadoop's readers unpack files with these names and leave out hidden ones
_PACKED = (".bz2", ".deflate", ".gz", ".lz4", ".passthrough", ".snappy", ".zst")
_HIDDEN = ("_", ".")
_BLANKS = "\ufeff \t\r\n\f\v"
_BOOK = b"xl/workbook.xml"
_CONTEXT = 112  # bytes of OpenSSL's SHA256_CTX


@cache
def _openssl() -> ctypes.CDLL:
    """The library behind ``hashlib``, whose own objects keep their state to themselves."""
    import _hashlib  # absent from a Python without OpenSSL

    library = ctypes.CDLL(_hashlib.__file__)
    library.SHA256_Init.argtypes = [ctypes.c_void_p]
    library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    library.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    return library


def sha256_start() -> bytes:
    context = ctypes.create_string_buffer(_CONTEXT)
    _openssl().SHA256_Init(context)
    return context.raw


def sha256_after(state: bytes, chunks: Iterable[bytes]) -> bytes:
    context = ctypes.create_string_buffer(state, _CONTEXT)
    for chunk in chunks:
        _openssl().SHA256_Update(context, chunk, len(chunk))
    return context.raw


def sha256_hex(state: bytes) -> str:
    out = ctypes.create_string_buffer(32)
    _openssl().SHA256_Final(out, ctypes.create_string_buffer(state, _CONTEXT))
    return out.raw.hex()


@cache
def resumable() -> bool:
    """Whether this Python's OpenSSL gives its state away."""
    try:
        state = sha256_after(sha256_after(sha256_start(), [b"a" * 100]), [b"b" * 100])
    except (AttributeError, ImportError, OSError):
        return False
    return sha256_hex(state) == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest()


@dataclass(frozen=True)
class State:
    """What is known of a file after its first ``size`` bytes."""

    digest: bytes
    size: int = 0
    head: bytes = b""
    rest: bytes = b""  # bytes that the next range may complete to a character or to a name
    workbook: bool = False
    plain: bool = True  # UTF-8 without NUL so far
    start: str = ""  # the first character that is no blank

    def after(self, chunk: bytes) -> State:
        """The facts after one more chunk; the digest is kept apart."""
        head, data = (self.head + chunk[:4])[:4], self.rest + chunk
        known = replace(self, size=self.size + len(chunk), head=head)
        if len(head) < 4:  # too short to tell the kind
            return replace(known, rest=data)
        if head == b"PK\x03\x04":
            return replace(known, workbook=self.workbook or _BOOK in data, rest=data[1 - len(_BOOK) :])
        if head == b"PAR1" or not self.plain:
            return replace(known, rest=b"")
        return known._text(data)

    def _text(self, data: bytes) -> State:
        try:
            text, used = codecs.utf_8_decode(data, "strict", False)
        except UnicodeDecodeError:
            return replace(self, plain=False, rest=b"")
        start = self.start or text.lstrip(_BLANKS)[:1]
        return replace(self, plain=b"\0" not in data, start=start, rest=data[used:])

    def done(self) -> State:
        """The facts of a file that ends here: an open character is none."""
        return replace(self, plain=self.plain and not self.rest)


def _advance(index: int, records: Iterator[tuple[int, bytes]], states: dict[int, State]):
    state = states[index]

    def chunks() -> Iterator[bytes]:
        nonlocal state
        for chunk in _joined(records, state.size):
            state = state.after(chunk)
            yield chunk

    digest = sha256_after(state.digest, chunks())
    yield index, replace(state, digest=digest)


def _joined(records: Iterator[tuple[int, bytes]], at: int) -> Iterator[bytes]:
    """The records as chunks of a fair size, checked to follow each other from ``at``."""
    held = bytearray()
    for place, record in records:
        if place != at:
            raise ValueError(f"Bytes from {place} where {at} was next.")
        held += record
        at += len(record)
        if len(held) >= _RECORD:
            yield bytes(held)
            held.clear()
    if held:
        yield bytes(held)


def _ranges(size: int, step: int) -> int:
    """Full ranges of Hadoop's cut of a file; its last range is up to a tenth longer."""
    count = max(size // step - 1, 0)
    while (size - count * step) / step > 1.1:
        count += 1
    return count


def pattern(path: str) -> str:
    """A path for readers that take patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def can_cut(path: str) -> bool:
    """Whether ranges of a file can be read as they are."""
    name = path.rsplit("/", 1)[-1]
    return resumable() and not name.startswith(_HIDDEN) and not name.endswith(_PACKED)


def facts(spark: SparkSession, sizes: dict[str, int], step: int = RANGE) -> dict[str, State]:
    """The final state of every file of ``sizes``, each longer than ``step``; see ``can_cut``."""
    states = {path: State(sha256_start()) for path in sizes}
    if not states:
        return states
    while True:
        record = min(step, _RECORD)
        _read(spark, sizes, states, step, record, last=False)
        if step <= _RECORD:
            break
        step = max(step // 4, _RECORD)
    _read(spark, sizes, states, step, 1, last=True)
    for path, state in states.items():
        if state.size != sizes[path]:
            raise ValueError(f"{state.size} of {sizes[path]} bytes of {path} were read.")
    return {path: state.done() for path, state in states.items()}


def _read(spark: SparkSession, sizes: dict[str, int], states: dict[str, State], step: int, record: int, last: bool) -> None:
    """Take every file through the full ranges of ``step`` bytes it has not had, or through its last range."""
    inputs = [re.sub(r"([\\,])", r"\\\1", pattern(path)) for path in sizes]
    conf = {
        f"{_INPUT}inputdir": ",".join(inputs), f"{_INPUT}list-status.num-threads": "1",
        f"{_INPUT}split.minsize": str(step), f"{_INPUT}split.maxsize": str(step),
        "fixedlengthinputformat.record.length": str(record),
    }
    context = spark.sparkContext
    kinds = ("org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable")
    ranges = context.newAPIHadoopRDD(_FORMAT, *kinds, conf=conf)
    first, full, total = {}, {}, 0
    for path, size in sizes.items():
        first[path], full[path] = total, _ranges(size, step)
        total += full[path] + 1
    if ranges.getNumPartitions() != total:
        raise ValueError(f"{ranges.getNumPartitions()} ranges where {total} were expected.")
    while True:
        due = {
            first[path] + state.size // step: path
            for path, state in states.items()
            if state.size < (sizes[path] if last else full[path] * step)
        }
        if not due:
            return
        begun = {index: states[path] for index, path in due.items()}
        advanced = ranges.mapPartitionsWithIndex(partial(_advance, states=begun))
        for index, state in context.runJob(advanced, iter, sorted(due)):
            states[due[index]] = state
