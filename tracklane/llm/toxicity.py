"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of a lexicon, second-person proximity, capitals,
punctuation and obfuscation rates. The lexicon is learned from labelled rows:
words and word beginnings (so inflected forms count) that are far more frequent
in toxic texts. Fitting takes at most FIT_ROWS labelled rows and FIT_BYTES of
their texts (whole ones), the first in the order of a hash of their ids, in one
task; scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tracklane.llm.boosting import Trees, isotonic
from tracklane.llm.common import bounded_batches, discard, fold, staged, tidied
from tracklane.llm.neardup import FAR, PERCENT, SIGNATURE, signatures
from tracklane.llm.textvec import Words, mix, shingles, slices

FIT_ROWS = 16_000
#: Bytes of text that the model is fitted on at most.
FIT_BYTES = 128 << 20
#: A text of more than this part of the sample's bytes is not learned from.
TEXT_SHARE = 8
THRESHOLD = 0.7
#: Bytes of the word beginnings that the lexicon holds beside whole words (0).
LENGTHS = (0, 4, 6, 8)
LEXICON_SIZE = 3000
LEAST_TOXIC_DOCS = 3
LEAST_WEIGHT = 2.5
NEAR = 5
FOLDS = 3
#: Places of a signature in which candidates for copies agree.
BAND = 3
#: Texts that are signed at once.
SIGNED_AT_ONCE = 500

# Second-person words in lower case.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "tu", "te", "ti", "toi", "ton", "ta", "tes", "vous", "votre", "vos",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "usted", "ustedes", "vosotros", "tuyo", "tus", "os",
)

_KIND = np.zeros(256, dtype=np.uint8)  # bits: 1 capital, 2 punctuation, 4 "!" or "?", 8 letter, 16 digit or mark that stands in for letters
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (65 <= _b <= 90) | 2 * (33 <= _b <= 126 and not _c.isalnum()) | 4 * (_c in "!?") | 8 * (_b >= 128 or _c.isalpha()) | 16 * (_c in "0123456789@$*!+#%")


def _total(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def terms(words: Words) -> dict[int, np.ndarray]:
    """Hashes of each word and of its beginnings; a word without a longer beginning has 0 there. Marks around a word don't count."""
    letter = (_KIND[words.data] & 8) > 0
    ahead = np.zeros(len(letter) + 1, dtype=np.int64)
    np.cumsum(letter, out=ahead[1:])
    at = np.flatnonzero(letter)
    first, last = ahead[words.starts], ahead[words.ends]
    some = last > first
    begin = np.where(some, at[np.minimum(first, max(len(at) - 1, 0))] if len(at) else 0, words.starts)
    end = np.where(some, at[np.maximum(last - 1, 0)] + 1 if len(at) else 0, words.starts)
    found = {}
    for n in LENGTHS:
        stop = end if n == 0 else begin + n
        hashed = words.range_hashes(begin, np.minimum(stop, end))
        found[n] = np.where(some & (stop <= end) & ((n == 0) | (stop < end)), mix(hashed + np.uint64(n)), np.uint64(0))
    return found


class Lexicon:
    """Sorted term hashes and their weights: log of the ratio of a term's shares of toxic and of other texts."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray) -> None:
        self.keys, self.weights = keys, weights

    @classmethod
    def learn(cls, per_doc: list[np.ndarray], copy_of: np.ndarray, toxic: np.ndarray) -> Lexicon:
        """per_doc: each text's distinct terms. copy_of: equal for texts that are copies, of which the first counts."""
        distinct = np.sort(np.unique(copy_of, return_index=True)[1])
        y = toxic[distinct]
        keys, hits = np.unique(np.concatenate([per_doc[i] for i in distinct if toxic[i]] or [np.zeros(0, np.uint64)]), return_counts=True)
        keys, hits = keys[hits >= LEAST_TOXIC_DOCS], hits[hits >= LEAST_TOXIC_DOCS]
        misses = np.zeros(len(keys), dtype=np.int64)
        for i in distinct if len(keys) else ():
            if not toxic[i]:
                at = np.minimum(np.searchsorted(keys, per_doc[i]), len(keys) - 1)
                misses[at[keys[at] == per_doc[i]]] += 1
        weights = np.log((hits + 0.5) / (y.sum() + 1)) - np.log((misses + 0.5) / (len(y) - y.sum() + 1))
        keep = np.flatnonzero((weights >= LEAST_WEIGHT) & (keys != 0))
        keep = np.sort(keep[np.argsort(-weights[keep] * np.sqrt(hits[keep]), kind="stable")[:LEXICON_SIZE]])
        return cls(keys[keep], weights[keep])

    def look_up(self, values: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(values))
        at = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        return np.where(self.keys[at] == values, self.weights[at], 0.0)


def copies(sets: list[np.ndarray]) -> np.ndarray:
    """For each set of shingles the place of the first one it copies, or its own: equal, or a similarity of PERCENT, confirmed on whole sets.

    Only texts that agree in BAND places of their signatures are compared; at the
    least similarity one in a million pairs agrees nowhere.
    """
    own = np.arange(len(sets))
    full = [i for i, x in enumerate(sets) if len(x)]
    signed = np.zeros((len(sets), SIGNATURE), dtype=np.uint8)
    for k in range(0, len(full), SIGNED_AT_ONCE):
        part = full[k : k + SIGNED_AT_ONCE]
        begins = np.cumsum([0, *(len(sets[i]) for i in part)])[:-1]
        signed[part] = signatures(np.concatenate([sets[i] for i in part]), begins)
    kept: dict[tuple[int, bytes], list[int]] = {}
    for i in full:
        bands = [(k, signed[i, k : k + BAND].tobytes()) for k in range(0, SIGNATURE, BAND)]
        met = np.unique(np.fromiter((j for band in bands for j in kept.get(band, ())), dtype=np.int64))
        met = met[(signed[met] != signed[i]).sum(axis=1) <= FAR]
        for j in met.tolist():
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= PERCENT * (len(sets[i]) + len(sets[j]) - both):
                own[i] = j
                break
        else:
            for band in bands:
                kept.setdefault(band, []).append(i)
    return own


def features(words: Words, found: dict[int, np.ndarray], lexicon: Lexicon) -> np.ndarray:
    """Dense features of each text; texts without words are zeros."""
    n = np.maximum(words.counts, 1)
    kind = _KIND[words.raw]
    columns = []
    begins = words.first_word
    per_doc = lambda x: np.bincount(words.doc, x, len(n))
    best = np.zeros(len(words.starts))
    for length in LENGTHS:
        weight = lexicon.look_up(found[length])
        best = np.maximum(best, weight)
        columns += [per_doc(weight > 0) / n]
    hits = per_doc(best > 0)
    strong = np.zeros(len(n))
    np.maximum.at(strong, words.doc, best)
    columns += [hits, hits / n, per_doc(best) / n, strong, np.sqrt(hits) * strong]
    you = np.isin(words.hashes, _you())
    near = np.zeros(len(you) + 1)
    np.cumsum(you, out=near[1:])
    place = np.arange(len(you))
    low = np.maximum(place - NEAR, begins[words.doc])
    high = np.minimum(place + NEAR + 1, begins[words.doc] + words.counts[words.doc])
    columns += [per_doc(you) / n, per_doc((best > 0) & (near[high] > near[low])) / n]
    size = np.maximum(np.diff(words.offsets), 1)
    letters = np.maximum(_total(kind & 8 > 0, words.offsets), 1)
    columns += [_total(kind & 1, words.offsets) / letters, _total(kind & 2 > 0, words.offsets) / size, _total(kind & 4 > 0, words.offsets) / size]
    hidden = np.zeros(len(kind), dtype=bool)
    if len(kind) > 2:
        hidden[1:-1] = (kind[1:-1] & 16 > 0) & (kind[:-2] & 8 > 0) & (kind[2:] & 8 > 0)
    columns += [_total(hidden, words.offsets) / n, np.log1p(words.counts)]
    return np.stack(columns, axis=1)


_SECOND: list[np.ndarray] = []


def _you() -> np.ndarray:
    if not _SECOND:
        _SECOND.append(Words(pa.array(SECOND_PERSON)).hashes)
    return _SECOND[0]


def fit(texts: pa.Array, toxic: np.ndarray) -> bytes:
    """The model of labelled texts, as bytes. Features for the trees come from lexicons that did not see their text."""
    per_doc, sets = [], []
    for start, end in slices(texts):
        words = Words(texts.slice(start, end - start))
        stacked = np.stack(list(terms(words).values()), axis=1)
        cuts = np.append(words.first_word, len(words.starts))
        for i in range(len(words.counts)):
            own = np.unique(stacked[cuts[i] : cuts[i + 1]])
            per_doc.append(own[own != 0])
        values, at = shingles(words)
        sets += [values[i:j].copy() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    copy_of = copies(sets)
    sets.clear()
    group = np.arange(len(per_doc)) % FOLDS
    lexicons = []
    for f in range(FOLDS):
        others = np.flatnonzero(group != f)
        lexicons.append(Lexicon.learn([per_doc[i] for i in others], copy_of[others], toxic[others]))
    rows = []
    for start, end in slices(texts):
        words = Words(texts.slice(start, end - start))
        found = terms(words)
        each = np.stack([features(words, found, lexicon) for lexicon in lexicons])
        rows.append(each[group[start:end], np.arange(end - start)])
    x = np.concatenate(rows)
    held = np.zeros(len(x))
    for f in range(FOLDS):
        rest = group != f
        held[group == f] = Trees.fit(x[rest], toxic[rest]).margin(x[group == f])
    trees = Trees.fit(x, toxic)
    knots = isotonic(held, toxic)
    lexicon = Lexicon.learn(per_doc, copy_of, toxic)
    out = io.BytesIO()
    np.savez(out, keys=lexicon.keys, weights=lexicon.weights, start=trees.start, feature=trees.feature, cut=trees.cut, leaf=trees.leaf, knot_x=knots[0], knot_y=knots[1])
    return out.getvalue()


class Model:
    def __init__(self, data: bytes) -> None:
        m = np.load(io.BytesIO(data))
        self.lexicon = Lexicon(m["keys"], m["weights"])
        self.trees = Trees(float(m["start"]), m["feature"], m["cut"], m["leaf"])
        self.knots = m["knot_x"], m["knot_y"]

    def score(self, texts: pa.Array) -> np.ndarray:
        """Calibrated probabilities; a little of the raw score keeps equal steps in order."""
        out = np.zeros(len(texts))
        for start, end in slices(texts):
            words = Words(texts.slice(start, end - start))
            margin = self.trees.margin(features(words, terms(words), self.lexicon))
            out[start:end] = 0.99 * np.interp(margin, *self.knots) + 0.01 / (1 + np.exp(-margin))
        return out


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> bytes | None:
    """The model from at most fit_rows labelled rows with at most fit_bytes of text; None without any.

    A doc_id with several labels is toxic if one of them says so; null labels,
    ids and texts are left out, as are single texts above fit_bytes / TEXT_SHARE.
    Of rows that repeat a doc_id the one of the least hash is taken. Rows are
    chosen by their hashes and sizes; only texts chosen move.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= fit_bytes // TEXT_SHARE).join(F.broadcast(chosen), "doc_id")  # at most fit_rows ids
    held = staged(texts.select("*", F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")), "labelled")
    one = held.groupBy("doc_id").agg(F.min(F.struct("h", "row", "bytes")).alias("r")).select("r.*")
    in_order = Window.orderBy("h", "row").rowsBetween(Window.unboundedPreceding, 0)  # three numbers for each of at most fit_rows ids
    taken = one.withColumn("sum", F.sum("bytes").over(in_order)).where(F.col("sum") <= fit_bytes).select("row")
    ordered = held.join(F.broadcast(taken), "row").select("text", "toxic", "h", "row").coalesce(1).sortWithinPartitions("h", "row").select("text", "toxic")  # the sample alone, in one task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            if b.num_rows:
                texts.append(b.column(0))
                toxic.append(b.column(1).to_numpy() > 0)
        if texts:
            whole = pa.concat_arrays(texts)
            texts.clear()
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array([fit(whole, np.concatenate(toxic).astype(np.float64))], pa.binary())], names=["model"])

    rows = bounded_batches(ordered).mapInArrow(tidied(run), "model binary").collect()  # one model of bounded size
    discard(held)
    return bytes(rows[0]["model"]) if rows else None


def score(docs: DataFrame, model: bytes | None, threshold: float = THRESHOLD, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with a score (0 to 1) and a prediction; columns of these names are replaced, all others stay.

    Null and empty texts are scored like a text without words; rows are scored
    each on its own, whatever their ids. Without a model all scores are 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score_col, predicted_col)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(shared.value) if shared.value else None
        for batch in batches:
            s = scorer.score(batch.column(names.index("text"))) if scorer else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, score_col, predicted_col])

    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType()), StructField(predicted_col, IntegerType())])
    return bounded_batches(docs).mapInArrow(tidied(run), schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: those whose fold of 3 is not 1."""
    return labels.where(fold(F.col("doc_id"), 3) != 1)
