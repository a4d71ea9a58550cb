"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code point.  An
n-gram vector binds the vectors of its letters, each permuted (rotated) by its place, by
multiplication; a text vector bundles (adds) the vectors of its n-grams, and a language
prototype bundles the normalised text vectors of its training documents.  A document gets
the language of the prototype with the largest cosine.

Texts are lower-cased; every run of other characters than letters is one space, and one
space stands at either end.  Whole texts are read, in pieces of bounded size.

Results for unusual input: NULL, empty and letterless texts give ``und`` with score 0;
without any training document every text does; equal cosines go to the first language in
code point order; rows with NULL ids count as remainder 0; repeated rows repeat their answer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import ROW, bounded_sample, crc_remainder, in_batches, unwrapped, wrapped

UNDETERMINED = "und"
#: Letters per piece of a long text.
PIECE = 200_000
#: n-gram vectors that a task keeps; beyond it the store starts afresh.
STORE = 40_000
#: Texts bundled by one matrix product.
TOGETHER = 128
_CODES = 0x110000
_GAP, _RARE = 1, -1


@dataclass(frozen=True)
class Space:
    """The random space: dimensions, n-gram length and seed."""

    dimensions: int = 512
    gram: int = 3
    seed: int = 17


class Encoder:
    """Text vectors; keeps the n-gram vectors it has bound so far.

    The letters met first get small numbers, so that an n-gram of them is found by its place
    in a dense table of 2 million entries.  A text with letters beyond these (an alphabet of
    thousands) bundles its n-grams one by one, with the same result.
    """

    def __init__(self, space: Space):
        self.space = space
        self.base = int((1 << 21) ** (1 / space.gram) + 1e-9)
        self.place = np.zeros(_CODES, np.int16)
        self.place[32] = _GAP
        self.code_of = [0, 32]
        self.letters: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.row_of = np.full(self.base**self.space.gram, -1, np.int32)
        self.size = 0
        self.vectors = np.empty((1024, self.space.dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        vector = self.letters.get(code)
        if vector is None:
            draw = np.random.default_rng((self.space.seed, code))
            vector = draw.integers(0, 2, self.space.dimensions).astype(np.float32) * 2 - 1
            self.letters[code] = vector
        return vector

    def bound(self, codes) -> np.ndarray:
        """The n-gram vector: letters rotated by their place, multiplied."""
        vector = np.ones(self.space.dimensions, np.float32)
        for place, code in enumerate(codes):
            vector *= np.roll(self.letter(int(code)), place)
        return vector

    def _number_letters(self, codes: np.ndarray) -> np.ndarray:
        places = self.place[codes]
        if (places == 0).any():
            for code in np.unique(codes[places == 0]).tolist():
                if not chr(code).isalpha():
                    self.place[code] = _GAP
                elif len(self.code_of) < self.base:
                    self.place[code] = len(self.code_of)
                    self.code_of.append(code)
                else:
                    self.place[code] = _RARE
            places = self.place[codes]
        return places

    def _rows(self, places: np.ndarray) -> np.ndarray:
        """Rows of the n-grams in the store, bound on first use."""
        count = len(places) - self.space.gram + 1
        keys = np.zeros(count, np.int64)
        for i in range(self.space.gram):
            keys *= self.base
            keys += places[i : i + count]
        rows = self.row_of[keys]
        if (rows < 0).any():
            for key in np.unique(keys[rows < 0]).tolist():
                if self.size == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                digits, rest = [], key
                for _ in range(self.space.gram):
                    rest, digit = divmod(rest, self.base)
                    digits.append(self.code_of[digit])
                self.vectors[self.size] = self.bound(reversed(digits))
                self.row_of[key] = self.size
                self.size += 1
            rows = self.row_of[keys]
        return rows

    def _one_by_one(self, codes: np.ndarray) -> np.ndarray:
        count = len(codes) - self.space.gram + 1
        grams = np.stack([codes[i : i + count] for i in range(self.space.gram)], 1)
        total = np.zeros(self.space.dimensions, np.float32)
        for gram, number in zip(*np.unique(grams, axis=0, return_counts=True), strict=True):
            total += self.bound(gram) * np.float32(number)
        return total

    def _pieces(self, text: str):
        """(codes, places) of the text's letters and single spaces, in overlapping pieces."""
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        places = self._number_letters(codes)
        gap = places == _GAP
        stay = ~gap
        stay[0] = True
        stay[1:] |= ~gap[:-1]
        if stay.sum() <= 1:
            return
        codes, places, gap = codes[stay], places[stay], gap[stay]
        codes = np.where(gap, 32, codes)
        overlap = self.space.gram - 1
        for start in range(0, max(1, len(codes) - overlap), PIECE):
            part, numbers = codes[start : start + PIECE + overlap], places[start : start + PIECE + overlap]
            if len(part) <= overlap:
                part = np.concatenate([part, np.full(overlap + 1 - len(part), 32, part.dtype)])
                numbers = np.concatenate([numbers, np.full(overlap + 1 - len(numbers), _GAP, numbers.dtype)])
            yield part, numbers

    def encode(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors of the texts as rows; zero rows for texts without letters."""
        out = np.zeros((len(texts), self.space.dimensions), np.float32)
        for start in range(0, len(texts), TOGETHER):
            counted = []
            for i, text in enumerate(texts[start : start + TOGETHER], start):
                if self.size > STORE:
                    self._bundle(counted, out)
                    counted = []
                    self._clear()
                for codes, places in self._pieces(text or ""):
                    if (places == _RARE).any():
                        out[i] += self._one_by_one(codes)
                    else:
                        counted.append((i, np.bincount(self._rows(places))))
            self._bundle(counted, out)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)

    def _bundle(self, counted: list, out: np.ndarray) -> None:
        for start in range(0, len(counted), TOGETHER):
            some = counted[start : start + TOGETHER]
            numbers = np.zeros((len(some), self.size), np.float32)
            for k, (_, n) in enumerate(some):
                numbers[k, : len(n)] = n
            np.add.at(out, [i for i, _ in some], numbers @ self.vectors[: self.size])


@dataclass(frozen=True)
class Profiles:
    """Languages in code point order and their unit prototype vectors."""

    space: Space
    languages: tuple[str, ...]
    prototypes: np.ndarray

    def __post_init__(self):
        object.__setattr__(self, "encoder", Encoder(self.space))

    def __getstate__(self):  # the encoder's store stays where it is
        return (self.space, self.languages, self.prototypes)

    def __setstate__(self, state):
        for name, value in zip(("space", "languages", "prototypes"), state, strict=True):
            object.__setattr__(self, name, value)
        self.__post_init__()

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and cosine, cut to 0 to 1, of every text."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        vectors = self.encoder.encode(texts)
        cosines = vectors @ self.prototypes.T
        best = cosines.argmax(axis=1)
        known = vectors.any(axis=1)
        scores = np.where(known, cosines.max(axis=1).clip(0, 1), 0.0)
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], scores.tolist()


def training_sample(
    docs: DataFrame, usable: Column, per_language: int, total: int
) -> DataFrame:
    """Labelled training rows: at most ``per_language`` of each of the 1000 most frequent languages
    and ``total`` in all.  Rows are taken in the order of a hash of their id, the languages in turn.  The ids are
    chosen on slim rows; their texts are then fetched by a broadcast of at most ``total`` ids.
    """
    slim = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    ranked = bounded_sample(slim.select("doc_id", "lang"), "lang", F.col("doc_id"), per_language)
    chosen = ranked.orderBy("place", "lang", "doc_id").limit(total).select("doc_id").distinct()
    return slim.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")


def _partial_sums(space: Space):
    """Sums of text vectors by language of one task's rows."""

    def run(batches):
        encoder, sums = Encoder(space), {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for lang, vector in zip(langs, encoder.encode(batch["text"].to_pylist()), strict=True):
                sums[lang] = sums.get(lang, 0) + vector.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict(
                {"lang": list(sums), "vector": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))}
            )

    return run


def fit(
    docs: DataFrame,
    usable: Column,
    space: Space = Space(),
    per_language: int = 2000,
    total: int = 20_000,
) -> Profiles:
    """Prototypes from a bounded sample of the labelled documents (see :func:`training_sample`).

    The driver gets one vector for each language and task of the sample: at most ``total``.
    """
    sample = training_sample(docs, usable, per_language, total)
    sums = sample.mapInArrow(_partial_sums(space), "lang string, vector array<double>")
    vectors: dict[str, np.ndarray] = {}
    for lang, vector in sums.collect():
        vectors[lang] = vectors.get(lang, 0) + np.array(vector)
    languages = sorted(lang for lang, v in vectors.items() if np.linalg.norm(v) > 0)
    rows = [vectors[lang] / np.linalg.norm(vectors[lang]) for lang in languages]
    matrix = np.array(rows, np.float32).reshape(len(languages), space.dimensions)
    return Profiles(space, tuple(languages), matrix)


def _predicted(batch: pa.RecordBatch, profiles) -> pa.RecordBatch:
    languages, scores = profiles.value.predict(batch["text"].to_pylist())
    return pa.RecordBatch.from_arrays(
        [*batch.columns[:-1], pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
        [*batch.schema.names[:-1], "lang_pred", "score"],
    )


def predict(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default all) with ``lang_pred`` and ``score``.

    The prediction reads the column ``text`` only.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != "text"]
    slim = docs.select(*keep, F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    lead = f"{schema}, " if schema else ""
    return slim.mapInArrow(in_batches(_predicted, shared), f"{lead}lang_pred string, score double")


def language_id(docs: DataFrame, space: Space = Space()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Documents whose crc32 remainder by 4 is 2 are held out of the training.
    """
    held_out = crc_remainder(4) == 2
    profiles = fit(docs, ~held_out, space)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return predict(rows, profiles, ["doc_id", "held_out"])


def with_known_language(docs: DataFrame, least: float = 0.0, space: Space = Space()) -> DataFrame:
    """The rows whose language is determined with a cosine of at least ``least``."""
    profiles = fit(docs, crc_remainder(4) != 2, space)
    rows = predict(wrapped(docs, text=F.col("text").cast("string")), profiles, [ROW])
    good = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)
    return unwrapped(rows.where(good))
