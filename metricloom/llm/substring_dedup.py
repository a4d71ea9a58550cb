"""Removal of repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words; its minimiser is the smallest hash among the runs of
``RUN`` words in it.  Consecutive windows of a document that share a minimiser travel as one
packed string (a super-k-mer) to the bucket of that minimiser, so equal windows always meet.
In a bucket the strings are sorted by document and place; a window seen before is a repeat.
Windows are compared by their words, not by hashes.

A slim pass first counts the strings of every minimiser, in a bitmap of ``2 ** PLACES`` places; a string
whose place holds no other, and in which the minimiser stands once, repeats nothing and does not
travel.  Minimisers that share a place only travel in vain.

Skew: copies of a string within a batch are settled before the shuffle (all but the earliest
are repeats as a whole).  Minimisers that hold more than one of ``HOT_SHARE`` strings of a
sample of documents (fewer than ``HOT_SHARE`` of them) are split: their windows travel one by
one, to the bucket of the window.  A bucket that still holds more than ``SEEN`` different
windows passes the rest on to an aggregation by window.  Both ways give the same result.

Order of places: id, then a 64-bit hash of the text (for rows that share an id), then the word.

Results for unusual input: NULL and empty texts have no words; texts shorter than a window
keep all words; NULL ids count as the smallest; rows that repeat id and text are one document,
whose windows repeat only what stands elsewhere or earlier in it, and share one answer.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import id_of, in_batches, real_id, text_of, written

WINDOW = 20
RUN = 3
#: Windows in one packed string at most (long repetitions of a few words are cut here).
LONGEST = 256
HOT_SHARE = 2000
#: Strings of a minimiser in the sample from which it is looked at.
HOT_LEAST = 200
#: Text bytes packed at once.
PIECE = 4_000_000
#: One document of so many is in the sample.
SAMPLE = 16
#: Places of the bitmap of minimisers, and of a segment of it, as powers of two.
PLACES, SEGMENT = 28, 20
#: Different windows a task keeps of one bucket.
SEEN = 300_000
#: Word hashes a task remembers.
MEMORY = 500_000
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_SHIPPED = "bucket long, packed binary, id long, mark long, first int, windows int, inner boolean"
_FOUND = "id long, mark long, first int, windows int, window binary"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _runs(one: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``RUN`` words."""
    last = len(one) - RUN + 1
    run = one[:last].copy()
    for i in range(1, RUN):
        run = (run ^ (run >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + one[i : last + i]
    return (run ^ (run >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def super_kmers(words: list[bytes], hashes: dict) -> tuple[np.ndarray, ...]:
    """Minimiser, first window and number of windows of every stretch, and whether the
    minimiser stands at several places of it (only then can windows inside it be equal).
    """
    n = len(words)
    if n < WINDOW:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    run = _runs(one)
    view = np.lib.stride_tricks.sliding_window_view(run, WINDOW - RUN + 1)
    places = view.argmin(axis=1) + np.arange(len(view))
    least = run[places]
    new = np.concatenate([[True], least[1:] != least[:-1]])
    starts = np.flatnonzero(new)
    counts = np.diff(np.concatenate([starts, [len(least)]]))
    if counts.max() > LONGEST:
        starts = np.concatenate(
            [np.arange(s, s + c, LONGEST) for s, c in zip(starts.tolist(), counts.tolist(), strict=True)]
        )
        counts = np.diff(np.concatenate([starts, [len(least)]]))
    moved = np.concatenate([[0], np.cumsum(places[1:] != places[:-1])])
    inner = moved[starts] != moved[starts + counts - 1]
    return least[starts], starts, counts, inner


def _places(least: np.ndarray) -> np.ndarray:
    """Places of minimisers in the bitmap; those that share a bucket share a place."""
    return (least >> np.uint64(24)) & np.uint64((1 << PLACES) - 1)


def _word_hashes(texts: list[bytes], hashes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of some texts and the text that it stands in, over all bytes at once."""
    raw = np.frombuffer(b"\n".join(texts), np.uint8)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins)
    offsets = np.concatenate([np.cumsum(inside)[starts] - 1, [np.count_nonzero(inside)]])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[inside])]
    ).dictionary_encode()
    kinds = np.fromiter(map(hashes.__getitem__, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return kinds[words.indices.to_numpy()] if len(starts) else kinds, np.searchsorted(bounds, starts, "right") - 1


def _stretches(one: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser and number of windows of every stretch of texts that stand one after the other."""
    run = _runs(one)
    least, width = run, 1
    while 2 * width <= WINDOW - RUN + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = WINDOW - RUN + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    whole = text[: len(least)] == text[WINDOW - 1 :]
    new = whole.copy()
    new[1:] &= ~(whole[:-1] & (text[1 : len(least)] == text[: len(least) - 1]) & (least[1:] == least[:-1]))
    starts = np.flatnonzero(new)
    before = np.concatenate([[0], np.cumsum(whole)])
    return least[starts], np.diff(before[np.append(starts, len(least))])


def _counted_places(batches):
    """Places of the minimisers of all strings, by segment, with counts up to 2."""
    hashes = _Hashes()
    for _, _, texts in _pieces(batches):
        one, text = _word_hashes([t.encode("utf-8", "surrogatepass") for t in texts], hashes)
        if len(one) < WINDOW:
            continue
        least, windows = _stretches(one, text)
        # a stretch that is cut is several strings
        least = np.concatenate([least, least[windows > LONGEST]])
        places, counts = np.unique(_places(least), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((places >> np.uint64(SEGMENT)).astype(np.int16)),
                pa.array((places & np.uint64((1 << SEGMENT) - 1)).astype(np.int32)),
                pa.array(np.minimum(counts, 2).astype(np.int8)),
            ],
            names=["segment", "place", "n"],
        )


def _segments(batches):
    """Bits of the places that hold two strings or more, for the segments of a partition."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        segments, places, n = (batch[c].to_numpy() for c in ("segment", "place", "n"))
        order = np.argsort(segments, kind="stable")
        cuts = np.flatnonzero(np.diff(segments[order])) + 1
        for some in np.split(order, cuts):
            if len(some):
                known = counts.setdefault(int(segments[some[0]]), np.zeros(1 << SEGMENT, np.uint8))
                at, inverse = np.unique(places[some], return_inverse=True)
                known[at] = np.minimum(known[at] + np.bincount(inverse, weights=n[some]), 2)
    for segment, known in counts.items():
        bits = np.packbits(known > 1, bitorder="little").tobytes()
        yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int16()), "bits": pa.array([bits], pa.binary())})


def shared_places(rows: DataFrame) -> np.ndarray:
    """The bitmap of minimisers that more than one string has; its size does not grow with the input."""
    places = rows.select("id", "mark", "text").mapInArrow(_counted_places, "segment short, place int, n byte")
    bits = np.zeros(1 << (PLACES - 3), np.uint8)
    width = 1 << (SEGMENT - 3)
    for r in places.repartition("segment").mapInArrow(_segments, "segment short, bits binary").toLocalIterator():
        bits[r.segment * width : (r.segment + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return bits


def _packed(ids: list, marks: list, texts: list, hashes: dict, hot: frozenset, bits: np.ndarray):
    """Rows to ship: packed strings, each once, and settled repeats without a string."""
    split = np.array(list(hot), np.uint64)
    earliest: dict[bytes, list] = {}
    settled: list[tuple] = []

    def meet(packed, bucket, place, count, inner):
        old = earliest.get(packed)
        if old is None:
            earliest[packed] = [bucket, place, count, inner]
        elif place < old[1]:
            settled.append((*old[1], count))
            old[1] = place
        elif place > old[1]:
            settled.append((*place, count))

    for key, mark, text in zip(ids, marks, texts, strict=True):
        words = text.encode("utf-8", "surrogatepass").split()
        least, starts, counts, inner = super_kmers(words, hashes)
        at = _places(least)
        ships = inner | ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0) | np.isin(least, split)
        least, starts, counts, inner = least[ships], starts[ships], counts[ships], inner[ships]
        if not len(starts):
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        froms, tos = begins[starts].tolist(), ends[starts + counts + WINDOW - 2].tolist()
        for bucket, first, count, twice, a, b in zip(
            least.tolist(), starts.tolist(), counts.tolist(), inner.tolist(), froms, tos, strict=True
        ):
            if bucket in hot:
                for i in range(first, first + count):
                    window = joined[begins[i] : ends[i + WINDOW - 1]]
                    meet(window, xxhash.xxh64_intdigest(window, 1), (key, mark, i), 1, False)
            else:
                meet(joined[a:b], bucket, (key, mark, first), count, twice)
    return earliest, settled


def _pieces(batches):
    """Slices of the batches of about ``PIECE`` bytes of text, as columns."""
    for batch in batches:
        ids, marks, texts, size = [], [], [], 0
        for key, mark, text in zip(batch["id"].to_pylist(), batch["mark"].to_pylist(), batch["text"], strict=True):
            ids.append(key)
            marks.append(mark)
            texts.append(text.as_py())
            size += len(texts[-1])
            if size > PIECE:
                yield ids, marks, texts
                ids, marks, texts, size = [], [], [], 0
        if ids:
            yield ids, marks, texts


def _shipped(known):
    def run(batches):
        hashes, (hot, bits) = _Hashes(), known.value
        for ids, marks, texts in _pieces(batches):
            earliest, settled = _packed(ids, marks, texts, hashes, hot, bits)
            kept = list(earliest.values())
            # settled repeats have no string; any bucket will do
            buckets = [k[0] for k in kept] + [xxhash.xxh64_intdigest(repr(s).encode()) for s in settled]
            places = [k[1] for k in kept] + [s[:3] for s in settled]
            rows = {
                # fewer random bytes to ship; minimisers that share the rest share a bucket
                "bucket": pa.array(np.array(buckets, np.uint64) >> np.uint64(24), pa.int64()),
                "packed": pa.array([*earliest, *[None] * len(settled)], pa.binary()),
                "id": pa.array([p[0] for p in places], pa.int64()),
                "mark": pa.array([p[1] for p in places], pa.int64()),
                "first": pa.array([p[2] for p in places], pa.int32()),
                "windows": pa.array([k[2] for k in kept] + [s[3] for s in settled], pa.int32()),
                "inner": pa.array([k[3] for k in kept] + [False] * len(settled), pa.bool_()),
            }
            if buckets:
                yield pa.RecordBatch.from_pydict(rows)

    return run


def _sampled(batches):
    """Minimisers of the sample, counted by task."""
    hashes = _Hashes()
    for batch in batches:
        minimisers = Counter()
        for text in batch["text"]:
            words = text.as_py().encode("utf-8", "surrogatepass").split()
            minimisers.update(super_kmers(words, hashes)[0].view(np.int64).tolist())
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array([*minimisers], pa.int64()), "n": pa.array([*minimisers.values()], pa.int64())}
        )


def sampled(rows: DataFrame, sample: int = SAMPLE, least: int = HOT_LEAST) -> frozenset:
    """Minimisers of more than one of ``HOT_SHARE`` strings."""
    some = rows.where(F.pmod(F.xxhash64("id", "mark"), F.lit(sample)) == 0).select("text")
    counts = some.mapInArrow(_sampled, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    strings = written(counts.where("n > 1"), "minimisers")
    total = strings.agg(F.sum("n")).first()[0] or 0
    hot = strings.where((F.col("n") >= least) & (F.col("n") * HOT_SHARE > total)).select("bucket").collect()
    return frozenset(r.bucket % (1 << 64) for r in hot)


class _Bucket:
    """Windows of one bucket, in order of place."""

    def __init__(self, seen: int = SEEN):
        self.seen = seen
        self.strings: set[bytes] = set()
        self.windows: set[bytes] = set()
        self.last = None

    def meet(self, packed: bytes, place: tuple, count: int, out: list) -> None:
        if place == self.last:
            return
        self.last = place
        if packed in self.strings:
            out.append((*place, count, None))
            return
        edge = [-1, *np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist(), len(packed)]
        key, mark, first = place
        open_at = -1
        for i in range(count):
            window = packed[edge[i] + 1 : edge[i + WINDOW]]
            if window in self.windows:
                if open_at < 0:
                    open_at = i
                continue
            if open_at >= 0:
                out.append((key, mark, first + open_at, i - open_at, None))
                open_at = -1
            if len(self.windows) < self.seen:
                self.windows.add(window)
            else:
                out.append((key, mark, first + i, 1, window))
        if open_at >= 0:
            out.append((key, mark, first + open_at, count - open_at, None))
        if len(self.windows) < self.seen:
            self.strings.add(packed)


def _repeats(seen: int):
    """Repeated windows of the buckets of a partition sorted by bucket and place."""

    def run(batches):
        bucket, state = None, None
        for batch in batches:
            keys = batch["bucket"].to_numpy()
            out: list[tuple] = []
            settled = np.asarray(batch["packed"].is_null())
            inner = batch["inner"].to_numpy(zero_copy_only=False)
            # a row alone in its bucket repeats nothing unless inside itself
            same = keys[1:] == keys[:-1]
            alone = ~(np.concatenate([[len(keys) > 0 and keys[0] == bucket], same]) | np.concatenate([same, [False]])) & ~inner & ~settled
            alone[-1:] = False  # its bucket may go on in the next batch
            rows = batch.filter(pa.array(~alone))
            columns = [rows[n].to_pylist() for n in ("bucket", "packed", "id", "mark", "first", "windows")]
            for key, packed, who, mark, first, count in zip(*columns, strict=True):
                if packed is None:
                    out.append((who, mark, first, count, None))
                    continue
                if key != bucket:
                    bucket, state = key, _Bucket(seen)
                state.meet(packed, (who, mark, first), count, out)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                    ["id", "mark", "first", "windows", "window"],
                )

    return run


def repeated(rows: DataFrame, seen: int = SEEN, sample: int = SAMPLE, least: int = HOT_LEAST) -> DataFrame:
    """id, mark, first and windows: stretches of windows that also start earlier.

    ``rows`` has id, mark and text.
    """
    known = rows.sparkSession.sparkContext.broadcast((sampled(rows, sample, least), shared_places(rows)))
    shipped = rows.mapInArrow(_shipped(known), _SHIPPED)
    dealt = shipped.repartition("bucket").sortWithinPartitions("bucket", "id", "mark", "first")
    found = written(dealt.mapInArrow(_repeats(seen), _FOUND), "repeats")
    place = F.struct("id", "mark", "first")
    left = found.where("window IS NOT NULL")
    earliest = left.groupBy("window").agg(F.min(place).alias("earliest"))
    later = left.join(earliest.hint("merge"), "window").where(place > F.col("earliest"))
    columns = ["id", "mark", "first", "windows"]
    return found.where("window IS NULL").select(*columns).unionByName(later.select(*columns))


def _kept(batch: pa.RecordBatch, texts: bool) -> pa.RecordBatch:
    counts, removed, results = [], [], []
    for text, stretches in zip(batch["text"], batch["stretches"].to_pylist(), strict=True):
        words = text.as_py().encode("utf-8", "surrogatepass").split()
        gone = 0
        if stretches:
            edges = np.zeros(len(words) + 1, np.int64)
            for s in stretches:
                edges[s["first"]] += 1
                edges[s["first"] + s["windows"] + WINDOW - 1] -= 1
            stay = np.cumsum(edges[:-1]) == 0
            gone = int(len(words) - stay.sum())
            kept = [words[i] for i in np.flatnonzero(stay).tolist()]
        else:
            kept = words
        joined = b" ".join(kept)
        counts.append(len(words))
        removed.append(gone)
        results.append(joined.decode("utf-8", "surrogatepass") if texts else hashlib.sha256(joined).hexdigest())
    return pa.RecordBatch.from_arrays(
        [batch["id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(results, pa.string())],
        ["id", "n_words", "n_removed", "result"],
    )


def _answers(docs: DataFrame, texts: bool, **limits: int) -> DataFrame:
    rows = docs.select(id_of().alias("id"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text"))
    stretches = repeated(rows, **limits).groupBy("id", "mark").agg(
        F.collect_list(F.struct("first", "windows")).alias("stretches")
    )
    both = rows.hint("merge").join(stretches.hint("merge"), ["id", "mark"], "left")
    schema = "id long, n_words long, n_removed long, result string"
    return both.select("id", "text", "stretches").mapInArrow(in_batches(_kept, texts), schema)


def substring_dedup(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    ``limits`` (seen, sample, least) choose between ways of equal result; see :func:`repeated`.
    """
    return _answers(docs, False, **limits).select(
        real_id("id"), "n_words", "n_removed", F.col("result").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the text of the words that stay, joined by single spaces."""
    return _answers(docs, True).select(real_id("id"), F.col("result").alias("text"))
