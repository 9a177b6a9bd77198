"""Language identification by hyperdimensional profiles.

Every letter (code point) has a random bipolar vector of its own, a hash. The vectors of an n-gram's letters,
each rotated by its place, are multiplied (bound) into the n-gram's vector;
n-gram vectors add up (are bundled) to the text's. The prototype of a language
is the mean of its texts' vectors, and a text is given the language whose
prototype has the largest cosine with it, both taken from the centre of all
prototypes. Bundling is linear, so a slice of texts is one product of its n-gram
counts with the n-gram vectors.

Fitting takes at most FIT_ROWS texts of known language, the first in the order
of a hash of their ids; their vectors are summed where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tracklane.llm.common import bounded_batches, fold, tidied
from tracklane.llm.textvec import mix, slices

FIT_ROWS = 20_000
DIMENSIONS = 512
GRAM = 3
#: A blank and a-z.
SYMBOLS = 27
#: Bits of a code point; the letters of an n-gram are packed into one number.
CODE_BITS = 21
#: Texts, and distinct n-grams of them, whose counts are held at once.
SLICE_TEXTS = 512
GRAMS_AT_ONCE = 8192
#: Cosines are turned into a score by a softmax with this factor.
SHARPNESS = 12.0
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    table = np.zeros(0x110000, dtype=bool)
    table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
    return table


@lru_cache(maxsize=1)
def latin_vectors() -> np.ndarray:
    """Bipolar vectors of a blank and of a-z."""
    return np.random.default_rng(20240229).integers(0, 2, (SYMBOLS, DIMENSIONS), dtype=np.int8) * 2 - 1


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """A bipolar vector for each code point (0: a blank); those of letters beyond a-z have a hash of code point and dimension for signs."""
    cells = codes.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS) + np.arange(DIMENSIONS, dtype=np.uint64)
    out = (mix(cells + np.uint64(20240229)) >> np.uint64(40) & np.uint64(1)).astype(np.int8) * 2 - 1
    latin = (codes >= 97) & (codes < 123)
    out[latin] = latin_vectors()[codes[latin] - 96]
    out[codes == 0] = latin_vectors()[0]
    return out.astype(np.int8)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """A row for each packed n-gram: the product of its letters' vectors, rotated by their places."""
    out = np.ones((len(grams), DIMENSIONS), dtype=np.int8)
    for place in range(GRAM):
        own, at = np.unique(grams >> (CODE_BITS * (GRAM - 1 - place)) & ((1 << CODE_BITS) - 1), return_inverse=True)
        out *= np.roll(letter_vectors(own), GRAM - 1 - place, axis=1)[at]
    return out


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and its number of letters."""
    lower = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in lower], dtype=np.int64)
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols = np.where(letters()[codes], codes, 0).astype(np.int64)  # 0: a run of anything but letters
    owner = np.repeat(np.arange(len(texts)), sizes)
    count = np.bincount(owner[symbols > 0], minlength=len(texts))
    # runs of other characters become one blank
    again = np.zeros(len(symbols), dtype=bool)
    again[1:] = (symbols[1:] == 0) & (symbols[:-1] == 0) & (owner[1:] == owner[:-1])
    symbols, owner = symbols[~again], owner[~again]
    gram = np.zeros(max(len(symbols) - GRAM + 1, 0), dtype=np.int64)
    for place in range(GRAM):
        gram = gram << CODE_BITS | symbols[place : place + len(gram)]
    whole = owner[: len(gram)] == owner[GRAM - 1 :] if len(gram) else np.zeros(0, dtype=bool)
    gram, of = gram[whole], owner[: len(whole)][whole]
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    order = np.argsort(gram)
    gram, of = gram[order], of[order]
    begins = np.flatnonzero(np.diff(gram, prepend=-1))
    column = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(gram))))
    for first in range(0, len(begins), GRAMS_AT_ONCE):
        last = min(first + GRAMS_AT_ONCE, len(begins))
        rows = slice(begins[first], begins[last] if last < len(begins) else len(gram))
        wide = last - first
        counts = np.bincount(of[rows] * wide + column[rows] - first, minlength=len(texts) * wide).reshape(len(texts), wide).astype(np.float32)
        out += counts @ gram_vectors(gram[begins[first:last]]).astype(np.float32)
    return out, count


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """A prototype for each language of docs (doc_id, text, lang), from at most fit_rows rows with text and language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")  # at most fit_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for start, end in slices(batch.column(0), SLICE_TEXTS):
                vectors, n_letters = bundles(batch.column(0).slice(start, end - start).to_pylist())
                vectors = unit(vectors) * (n_letters > 0)[:, None]
                for lang in set(langs[start:end].tolist()):
                    own = vectors[langs[start:end] == lang]
                    sums[lang] = sums.get(lang, 0) + own.astype(np.float64).sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "total"])

    rows = bounded_batches(sample.select("text", "lang")).mapInArrow(tidied(run), "lang string, total binary").collect()  # a vector for each language and task
    totals: dict[str, np.ndarray] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], bytes(r["total"]))):
        totals[r["lang"]] = totals.get(r["lang"], 0) + np.frombuffer(r["total"], dtype=np.float64)
    return {lang: unit(v) for lang, v in totals.items() if np.linalg.norm(v) > 0}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with a language and its score; columns of these names are replaced, all others stay.

    Text that is null or has no letter is `und` with score 0, as is all text
    without prototypes. Rows are judged each on its own, whatever their ids.
    """
    docs = docs.drop(lang_col, score_col)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((list(prototypes), np.array(list(prototypes.values()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, profiles = shared.value
        if langs:
            centre = profiles.mean(axis=0) if len(langs) > 1 else 0.0
            directions = unit(profiles - centre)
        for batch in batches:
            predicted, scores = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            texts = batch.column(names.index("text"))
            for start, end in slices(texts, SLICE_TEXTS) if langs else ():
                vectors, n_letters = bundles([t or "" for t in texts.slice(start, end - start).to_pylist()])
                cosines = unit(unit(vectors) - centre) @ directions.T
                power = np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)))
                best = cosines.argmax(axis=1)
                some = np.flatnonzero(n_letters > 0)
                predicted[start + some] = np.array(langs, dtype=object)[best[some]]
                scores[start + some] = (power.max(axis=1) / power.sum(axis=1))[some]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predicted, pa.string()), pa.array(scores)], names=[*names, lang_col, score_col])

    schema = StructType([*docs.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType())])
    return bounded_batches(docs).mapInArrow(tidied(run), schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from: those whose fold of 4 is not 2."""
    return docs.where(fold(F.col("doc_id"), 4) != 2)
