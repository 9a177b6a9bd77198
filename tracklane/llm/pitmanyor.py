"""LM scoring with a hierarchical Pitman-Yor model.

Restaurants: one for each word of the training texts as the word before (the
start of a text is the end mark as the word before); they share one parent,
the word distribution, whose own base is uniform over the V known words and
one unknown word. Customers are the training tokens; every table of a context
restaurant is a customer of the parent. Only words never seen in training have
no restaurant: after them the parent decides.

Seating is sampled by Gibbs sweeps. A sweep takes all customers of a dish out
of each restaurant and seats them again, given the numbers of tables of the
restaurant and of the dish after the sweep before: one by one, and from EXACT
customers on in groups of GROWTH, whose number of new tables is drawn from a
binomial at the group's middle. In the BURN_IN sweeps the two strengths (one for
all contexts, one for the parent) are drawn too, from their posterior on a
grid. Predictive probabilities are averaged over the SAMPLES sweeps after that.
Random numbers are hashes of word, context, sweep and customer, so lost tasks
come out the same.

Data flow. Words are 63-bit, pairs 64-bit hashes. Each task counts its pairs of
context and word and sends them, packed, to shards of the pair's hash, so no
pair, word or context is ever gathered whole in one place. A pair seen once
always has one table, so sweeps work on the others only. What they need of
their two words comes, for the HEAD_WORDS most frequent words, from bounded
arrays that the driver holds and broadcasts; for all others from joins. To
score, tokens of head words are resolved in their task but for the pair's own
table numbers, which they are sent to meet in the pair's shard; tokens with
other words are joined with these, too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.llm.blobs import Places, packed, rows_of, unpacked
from tracklane.llm.common import bounded_batches, discard, fold, released, staged, tidied
from tracklane.llm.grouping import gathered, whole_groups
from tracklane.llm.textvec import Words, mix, slices

HEAD_WORDS = 1 << 20
HEAD_PAIRS = 1 << 20
#: Contexts whose whole distributions head() gives.
SHOWN_CONTEXTS = 32
#: Tokens that a task counts at once, and that it asks for at once.
TOKENS_AT_ONCE, ASKED_AT_ONCE = 4_000_000, 1_500_000
#: Characters of training text for each shard of pairs.
SHARD_CHARS = 16_000_000
#: Ranges of head words in which sums are added up.
RANGES = 64
#: Bytes of an Arrow batch of packed rows.
BLOB_BYTES = 8 << 20
BURN_IN, SAMPLES = 2, 3
EXACT = 64
GROWTH = 0.05
#: The strengths before the first sweep, and those that are drawn from.
STRENGTH, BASE_STRENGTH = 1.0, 10.0
STRENGTHS = np.geomspace(0.01, 10_000, 121)

_U = np.uint64
#: Words are known by 63 bits of a hash. END is both the last word of a text and the context of its first.
END = _U(0x7C3A5D1E9B24F680) >> _U(1)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, text) of each token, and each text's number of tokens; every text ends with END."""
    words = Words(column)
    counts = words.counts + 1
    total = int(counts.sum())
    doc = np.repeat(np.arange(len(counts)), counts)
    last = np.cumsum(counts) - 1
    word = np.empty(total, dtype=np.uint64)
    inner = np.ones(total, dtype=bool)
    inner[last] = False
    word[inner] = words.hashes >> _U(1)
    word[last] = END
    context = np.empty(total, dtype=np.uint64)
    context[1:] = word[:-1]
    context[last - counts + 1] = END
    return word, context, doc, counts


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(context) * _U(3) + word)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and where in it each distinct key begins."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = own[1:] != own[:-1]
    return order, np.flatnonzero(new)


def _dealt(keys: np.ndarray, shard_bits: int) -> list[tuple[int, int, int]]:
    """(shard, start, end) of the shards that sorted keys fall into."""
    shard = (keys >> _U(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    return list(zip(shard[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=False))


def _counted(docs: DataFrame, shard_bits: int) -> DataFrame:
    """Per shard of pairs: once (steps between the sorted keys of pairs seen once), several (context, word, count), words (key and five sums)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def shards() -> Iterator[pa.RecordBatch]:
            line = np.concatenate([np.array([END]), *parts])  # every text ends with END, so a token's context is the token before it
            parts.clear()
            u, w = line[:-1], line[1:]
            keys = pair_keys(u, w)
            order, at = _groups(keys)
            n, first = np.diff(np.append(at, len(keys))), order[at]
            del order, at
            keys, u, w = keys[first], u[first], w[first]
            del line, first
            dealt = _dealt(keys, shard_bits)
            del keys
            for shard, start, end in dealt:
                by_context = start + np.argsort(u[start:end])  # equal contexts side by side pack well
                blob = packed(u[by_context], w[by_context], n[by_context])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "blob"])

        for batch in batches:
            for start, end in slices(batch.column(0)):
                word, _, _, _ = tokens(batch.column(0).slice(start, end - start))
                parts.append(word)
                held += len(word)
                if held > TOKENS_AT_ONCE:
                    yield from shards()
                    held = 0
        if parts:
            yield from shards()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["shard"]):
            blobs = table.column("blob")
            for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                u, w, n = (np.concatenate(x) for x in zip(*[unpacked(blobs[k].as_py(), _U, _U, np.int64) for k in range(start, end)], strict=True))
                keys = pair_keys(u, w)
                order, begins = _groups(keys)
                n, first = np.add.reduceat(n[order], begins), order[begins]
                keys, u, w = keys[first], u[first], w[first]
                more = n > 1
                both = np.concatenate([w, u])
                order, begins = _groups(both)
                of = np.empty(len(both), dtype=np.int64)
                of[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(both))))
                sums = [np.bincount(of[: len(w)], x, len(begins)).astype(np.int64) for x in (n, None, ~more)] + [np.bincount(of[len(w) :], x, len(begins)).astype(np.int64) for x in (None, ~more)]
                kw_order = [sums[0], sums[1], sums[3], sums[2], sums[4]]
                row = [[table.column("shard")[start].as_py()], [packed(np.diff(keys[~more], prepend=_U(0)))], [packed(u[more], w[more], n[more])], [packed(both[order[begins]], *kw_order)]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], names=["shard", "once", "several", "words"])

    parts = bounded_batches(docs.select("text")).mapInArrow(tidied(count), "shard long, blob binary")
    return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidied(merge), "shard long, once binary, several binary, words binary")


def uniform(*parts: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1), a hash of the parts."""
    x = np.zeros(1, dtype=np.uint64)
    for p in parts:
        x = mix(x * _U(0x9E3779B97F4A7C15) + np.asarray(p, dtype=np.uint64) + _U(1))
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Draws from the binomial, by uniform numbers u and v: by inversion for means up to 12, else by its normal limit."""
    p = np.minimum(p, 1 - 1e-12)
    mean = n * p
    out = np.clip(np.rint(mean + np.sqrt(mean * (1 - p) * -2 * np.log1p(-u)) * np.cos(2 * np.pi * v)), 0, n)
    low = np.flatnonzero(mean <= 12)
    size, odds, mass, left = n[low].astype(float), (p / (1 - p))[low], np.exp(n[low] * np.log1p(-p[low])), u[low].copy()
    out[low] = 0
    k = 0
    while len(low):
        more = (left >= mass) & (k < size) & (k < 200)
        left = left - mass
        low, size, odds, mass, left = low[more], size[more], odds[more], mass[more], left[more]
        mass = mass * odds * (size - k) / (k + 1)
        k += 1
        out[low] = k
    return out


def seat(customers: np.ndarray, mass: np.ndarray, discount: float, word: np.ndarray, context: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish after its customers have sat down; mass: weight of a new table."""
    order = np.argsort(-customers, kind="stable")
    c, a, w, u = customers[order], mass[order], word[order], context[order]
    t = np.minimum(c, 1).astype(np.float64)
    i = 1
    while True:
        active = int(np.searchsorted(-c, -i, side="left"))  # those with more than i customers
        if not active:
            break
        if i < EXACT:
            step, new = 1, a[:active] / (a[:active] + i - discount * t[:active])
            t[:active] += uniform(w[:active], u[:active], sweep, i) < new
        else:
            step = max(1, int(i * GROWTH))
            n = np.minimum(step, c[:active] - i)
            new = a[:active] / (a[:active] + i + (n - 1) / 2 - discount * t[:active])
            t[:active] += binomial(n, new, uniform(w[:active], u[:active], sweep, i), uniform(w[:active], u[:active], sweep, i, 1))
        i += step
    out = np.empty_like(t)
    out[order] = t
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after eight steps up."""
    x = np.asarray(x, dtype=np.float64)
    shift = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def drawn_strength(tables: tuple[np.ndarray, np.ndarray], customers: tuple[np.ndarray, np.ndarray], discount: float, u: float) -> float:
    """A strength from its posterior on STRENGTHS, given histograms (values, how often) of tables and customers of restaurants."""
    log_p = np.zeros(len(STRENGTHS))
    for k, s in enumerate(STRENGTHS):
        t, times = tables
        log_p[k] += (times * ((t - 1) * math.log(discount) + _log_gamma(s / discount + t) - _log_gamma(s / discount + 1))).sum()
        c, times = customers
        log_p[k] -= (times * (_log_gamma(s + c) - _log_gamma(s + 1))).sum()
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return float(STRENGTHS[min(np.searchsorted(p, u * p[-1]), len(p) - 1)])


def _discount(once: float, twice: float) -> float:
    """n1 / (n1 + 2 n2), from the numbers of keys seen once and twice."""
    return min(0.95, max(0.05, (once + 0.5) / (once + 2 * twice + 1)))


def _level(n: np.ndarray) -> np.ndarray:
    """16 levels for each power of two."""
    return np.floor(np.log2(n) * 16).astype(np.int64)


def _least(sizes: dict[int, int], limit: int) -> int:
    """The least n such that at most `limit` keys have as much; sizes: keys of each level."""
    total, least = 0, max(sizes, default=0) + 1
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > limit:
            break
        total, least = total + sizes[k], k
    return math.ceil(2 ** (least / 16) - 1e-9)


def _histogram(values: np.ndarray, more: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct positive values and how often they occur, with those of more."""
    own, times = np.unique(values, return_counts=True)
    counts = dict(zip(own.tolist(), times.tolist(), strict=True))
    for k, n in more.items():
        counts[k] = counts.get(k, 0) + n
    kept = sorted(k for k in counts if k > 0)
    return np.array(kept, dtype=np.float64), np.array([counts[k] for k in kept], dtype=np.float64)


class Head:
    """The most frequent words: sorted hashes, counts, and tables before the first sweep and after each: t of each as a context, p as a dish of contexts, t0 in the parent."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, once_u: np.ndarray, once_w: np.ndarray, t: np.ndarray, p: np.ndarray) -> None:
        self.keys, self.counts, self.once_u, self.once_w = keys, counts, once_u, once_w
        self.t, self.p, self.t0 = [t], [p], [np.ones(len(keys), np.int64)]


class Model:
    """What training gives: N, V, arrays of the head words, a table of the other words, and shards of pairs."""

    def __init__(self, docs: DataFrame) -> None:
        """docs: the training texts (null: empty)."""
        self.spark = spark = docs.sparkSession
        docs = docs.select(F.coalesce("text", F.lit("")).alias("text"))
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        self.shard_bits = max(4, math.ceil(math.log2(chars / SHARD_CHARS + 1)))
        self.counted = staged(_counted(docs, self.shard_bits), "counted", BLOB_BYTES)
        released(spark)
        words = staged(self._words(), "words", BLOB_BYTES)
        released(spark)
        size = words.agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.sum("ku").alias("pairs"), F.sum("su").alias("once")).first()
        self.vocabulary, self.tokens = size["v"], size["n"] or 0
        self.h = 1.0 / (self.vocabulary + 1)
        level = F.floor(F.log2("n") * 16).cast("long")
        self.least = _least({r["level"]: r["count"] for r in words.groupBy(level.alias("level")).count().collect()}, HEAD_WORDS)  # 16 rows for each power of two
        self.own = self._head(words)
        self.keys = spark.sparkContext.broadcast(self.own.keys)
        # before the first sweep each pair has one table, and each word one in the parent
        self.fresh: list[float] = []
        self._split()
        self._part(words.where(F.col("n") < self.least))
        discard(words)
        twice = self.twice
        self.d, self.d0 = _discount(size["once"] or 0, twice), _discount(size["n1"], size["n2"])
        self.strength, self.base_strength = STRENGTH, BASE_STRENGTH
        self.totals: list[tuple[int, int]] = []  # before the first sweep and after each: tables of all contexts, and of the parent
        self._totalled(self.n_idle)
        for k in range(BURN_IN + SAMPLES):
            self._sweep(k)
            if k < BURN_IN:
                self._draw_strengths(k)
                self.own.t[k] = self.own.p[k] = self.own.t0[k] = None  # not needed any more
            released(spark)
        self._frequent()
        self._finish_tail()

    def _head(self, words: DataFrame) -> Head:
        first = words.where(F.col("n") >= self.least).select("key", "n", "su", "sw", "ku", "kw").toArrow()  # at most HEAD_WORDS rows
        columns = [c.to_numpy() for c in first.columns]
        order = np.argsort(columns[0])
        return Head(columns[0][order].astype(np.uint64), *(c[order] for c in columns[1:]))

    def _words(self) -> DataFrame:
        """(key, n, kw, ku, sw, su) of each word: its count, its contexts and its followers, and those of them seen once with it."""
        names, bits = ["key", "n", "kw", "ku", "sw", "su"], self.shard_bits

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                columns = unpacked(row["words"], _U, *[np.int64] * 5)
                rows = [(shard, packed(*(c[a:b] for c in columns))) for shard, a, b in _dealt(columns[0] << _U(1), bits)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, at in whole_groups(batches, ["shard"]):
                blobs = table.column("blob")
                for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    key, *sums = (np.concatenate(x) for x in zip(*[unpacked(blobs[k].as_py(), _U, *[np.int64] * 5) for k in range(start, end)], strict=True))
                    order, begins = _groups(key)
                    columns = [key[order[begins]].view(np.int64), *(np.add.reduceat(c[order], begins) for c in sums)]
                    for k in range(0, len(begins), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in columns], names=names)

        parts = self.counted.select("words").mapInArrow(tidied(deal), "shard long, blob binary")
        return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidied(merge), ", ".join(f"{n} long" for n in names))

    def _split(self) -> None:
        """Pairs seen several times: those of two head words packed by their places (near), the others as rows (far)."""
        shared = self.keys

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places = Places(shared.value, 63)
            for row in rows_of(batches):
                u, w, n = unpacked(row["several"], _U, _U, np.int64)
                at_u, at_w = places(u), places(w)
                near = (at_u >= 0) & (at_w >= 0)
                levels, times = np.unique(_level(n), return_counts=True)
                blob = packed(at_u[near].astype(np.int32), at_w[near].astype(np.int32), n[near], np.zeros(near.sum(), np.float32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]], pa.int64()),
                        pa.array([blob], pa.binary()),
                        pa.array([packed(u[~near], w[~near], n[~near])], pa.binary()),
                        pa.array([int((~near).sum())], pa.int64()),
                        pa.array([packed(levels, times)], pa.binary()),
                        pa.array([int((n == 2).sum())], pa.int64()),
                    ],
                    names=["shard", "near", "far", "n_far", "levels", "twice"],
                )

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                u, w, n = unpacked(row["far"], np.int64, np.int64, np.int64)
                for k in range(0, len(u), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in (u, w, n)], names=["u", "w", "n"])

        def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpacked(row["levels"], np.int64, np.int64)], names=["level", "times"])

        split = staged(self.counted.select("shard", "several").mapInArrow(tidied(run), "shard long, near binary, far binary, n_far long, levels binary, twice long"), "split", BLOB_BYTES)
        self.once = staged(self.counted.select("shard", "once"), "once")
        discard(self.counted)
        self.near, self.near_staged = split.select("shard", F.col("near").alias("blob")), split
        levels = split.select("levels").mapInArrow(histogram, "level long, times long").groupBy("level").agg(F.sum("times").alias("times"))
        self.least_pair = _least({r["level"]: r["times"] for r in levels.collect()}, HEAD_PAIRS)  # 16 rows for each power of two
        r = split.agg(F.sum("twice").alias("twice"), F.sum("n_far").alias("n_far")).first()
        self.twice, n_far = r["twice"] or 0, r["n_far"] or 0
        self.far = staged(split.select("far").where("n_far > 0").mapInArrow(tidied(rows), "u long, w long, n long"), "far", BLOB_BYTES) if n_far else None

    def _part(self, tail: DataFrame) -> None:
        """The words outside the head: busy ones have far pairs, and their tables change; idle ones have one table for each pair, so only the parent seats them."""
        start = [F.col("key"), "n", "sw", "su", F.array("ku").alias("t"), F.array("kw").alias("p"), F.array(F.lit(1).cast("long")).alias("t0")]
        self.busy, idle = None, tail
        if self.far is not None:
            keys = self.far.select(F.explode(F.array("u", "w")).alias("key")).distinct()
            self.busy = staged(tail.join(keys, "key", "left_semi").select(*start), "busy")
            idle = tail.join(keys, "key", "left_anti")
        self.idle = staged(idle.select("key", "n", F.col("su").alias("t"), F.col("sw").alias("p")), "idle")
        r = self.idle.agg(F.count(F.lit(1)), F.sum("p"), F.count_if(F.col("p") == 1)).first()
        self.n_idle, self.idle_p, self.idle_once = r[0], r[1] or 0, r[2]

    def _totalled(self, idle_t0: int) -> None:
        r = self.busy.agg(F.sum(F.element_at("p", -1)), F.sum(F.element_at("t0", -1))).first() if self.busy is not None else (0, 0)
        self.totals.append((int(self.own.p[-1].sum()) + self.idle_p + (r[0] or 0), int(self.own.t0[-1].sum()) + idle_t0 + (r[1] or 0)))

    def _idle_t0(self, k: int) -> int:
        """Tables in the parent, after sweep k, of the idle words; those with one customer have one."""
        fresh, d0 = self.fresh[k], self.d0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in gathered(batches, 200_000):
                key, p = (batch.column(c).to_numpy() for c in ("key", "p"))
                total += int(seat(p, np.full(len(p), fresh), d0, key.astype(np.uint64), np.full(len(p), 99), k).sum())
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["t0"])

        several = self.n_idle - self.idle_once
        more = self.idle.where("p > 1").select("key", "p").mapInArrow(run, "t0 long").agg(F.sum("t0")).first()[0] if several else 0
        return self.idle_once + (more or 0)

    def _finish_tail(self) -> None:
        """tail (key, n, ms, p0s): of all words outside the head, the weights and probabilities of the parent in each sample."""
        d, d0, strength, base, h = self.d, self.d0, self.strength, self.base_strength, self.h
        steps = range(BURN_IN + 1, BURN_IN + SAMPLES + 1)
        fresh, totals, new = self.fresh, self.totals, [self.new_word(k) for k in range(len(self.totals))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in gathered(batches, 100_000):
                key, n, t, p = (batch.column(c).to_numpy() for c in ("key", "n", "t", "p"))
                ms = np.repeat((strength + d * t)[:, None], SAMPLES, axis=1)
                p0s = np.empty((len(p), SAMPLES))
                for s, k in enumerate(steps):
                    t0 = seat(p, np.full(len(p), fresh[k - 1]), d0, key.astype(np.uint64), np.full(len(p), 99), k - 1)
                    p0s[:, s] = np.maximum(p - d0 * t0, 0) / (base + totals[k][0]) + new[k]
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), SAMPLES).cast(pa.list_(pa.float64())) for x in (ms, p0s)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), *lists], names=["key", "n", "ms", "p0s"])

        idle = self.idle.mapInArrow(run, "key long, n long, ms array<double>, p0s array<double>")
        if self.busy is not None:
            sides = self.contexts(steps).withColumnRenamed("u", "key").withColumnRenamed("customers", "n").join(self.dishes(steps).select(F.col("w").alias("key"), "p0s"), "key")
            idle = idle.unionByName(sides.select("key", "n", "ms", "p0s"))
        self.tail = staged(idle, "tail")

    def _draw_strengths(self, k: int) -> None:
        both = self.idle.select("n", "t")
        if self.busy is not None:
            both = both.unionByName(self.busy.select("n", F.element_at("t", -1).alias("t")))
        counts = {c: {r[c]: r["count"] for r in both.groupBy(c).count().collect()} for c in ("n", "t")}  # values are below the head's counts
        u, v = (float(uniform(k, x)[0]) for x in (101, 102))
        if self.tokens:
            self.strength = drawn_strength(_histogram(self.own.t[-1], counts["t"]), _histogram(self.own.counts, counts["n"]), self.d, u)
            one = np.ones(1)
            p, t0 = self.totals[-1]
            self.base_strength = drawn_strength((one * t0, one), (one * p, one), self.d0, v)

    def new_word(self, k: int) -> float:
        """The parent's probability of the unknown word after k sweeps."""
        t, t0 = self.totals[k]
        return (self.base_strength + self.d0 * t0) / (self.base_strength + t) * self.h

    def head_weight(self, k: int) -> np.ndarray:
        """Each head word's weight of the parent, as a context after k sweeps, times its customers and strength."""
        return self.strength + self.d * self.own.t[k]

    def head_dish(self, k: int) -> np.ndarray:
        """Each head word's probability in the parent after k sweeps."""
        return np.maximum(self.own.p[k] - self.d0 * self.own.t0[k], 0) / (self.base_strength + self.totals[k][0]) + self.new_word(k)

    def contexts(self, steps: range) -> DataFrame:
        """(u, customers, ms) of the busy words outside the head, as head_weight."""
        return self.busy.select(F.col("key").alias("u"), F.col("n").alias("customers"), F.array(*[F.lit(self.strength) + F.lit(self.d) * F.get("t", F.lit(k)) for k in steps]).alias("ms"))

    def dishes(self, steps: range) -> DataFrame:
        """(w, known, p0s) of the busy words outside the head, as head_dish."""

        def p0(k: int) -> Column:
            return F.greatest(F.get("p", F.lit(k)) - self.d0 * F.get("t0", F.lit(k)), F.lit(0.0)) / (self.base_strength + self.totals[k][0]) + self.new_word(k)

        return self.busy.select(F.col("key").alias("w"), F.col("n").alias("known"), F.array(*[p0(k) for k in steps]).alias("p0s"))

    def _sweep(self, k: int) -> None:
        """Seats all customers again: of the pairs of head words, of other pairs, and of the parent."""
        d, d0, size = self.d, self.d0, len(self.own.keys)
        fresh = (self.base_strength + d0 * self.totals[k][1]) * self.h
        self.fresh.append(fresh)
        shared, keys = self.spark.sparkContext.broadcast((self.head_weight(k), self.head_dish(k))), self.keys
        cuts = np.linspace(0, size, RANGES + 1).astype(np.int64)
        sampled = k >= BURN_IN

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, p0 = shared.value
            word = keys.value
            sums = [np.zeros(size), np.zeros(size)]
            for row in rows_of(batches):
                u, w, n, total = unpacked(row["blob"], np.int32, np.int32, np.int64, np.float32)
                t = seat(n, m[u] * p0[w], d, word[w], word[u], k)
                for x, at in zip(sums, (u, w), strict=True):
                    x += np.bincount(at, t, size)
                if sampled:
                    yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), pa.array([-1], pa.int32()), pa.array([packed(u, w, n, total + t.astype(np.float32))], pa.binary())], names=["shard", "part", "blob"])
            t, p = (x.astype(np.int64) for x in sums)
            blobs = [packed(t[a:b], p[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([0] * RANGES, pa.int64()), pa.array(range(RANGES), pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "part", "blob"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[np.ndarray]] = {}
            for row in rows_of(batches):
                own = unpacked(row["blob"], np.int64, np.int64)
                held[row["part"]] = [a + b for a, b in zip(held[row["part"]], own, strict=True)] if row["part"] in held else own
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([packed(*x) for x in held.values()], pa.binary())], names=["part", "blob"])

        swept = staged(self.near.mapInArrow(tidied(near), "shard long, part int, blob binary"), "swept", BLOB_BYTES)
        added = staged(swept.where("part >= 0").select("part", "blob").repartition("part").mapInArrow(tidied(add), "part int, blob binary"), "added", BLOB_BYTES)
        sums = {r["part"]: unpacked(bytes(r["blob"]), np.int64, np.int64) for r in added.collect()}  # two numbers for each head word
        t = self.own.once_u + (np.concatenate([sums[i][0] for i in range(RANGES)]) if sums else 0)
        p = self.own.once_w + (np.concatenate([sums[i][1] for i in range(RANGES)]) if sums else 0)
        discard(added)
        if sampled:
            discard(self.near_staged)
            self.near, self.near_staged = swept.where("part < 0").select("shard", "blob"), swept
        else:
            discard(swept)
        seated = self._seated_far(k, shared) if self.far is not None else None
        if seated is not None:
            extra = seated.where("head").select("key", "as_u", "as_w").toArrow()  # at most a row for each head word
            at = np.searchsorted(self.own.keys, extra.column("key").to_numpy().astype(np.uint64))
            t[at] += extra.column("as_u").to_numpy()
            p[at] += extra.column("as_w").to_numpy()
        self.own.t.append(t)
        self.own.p.append(p)
        self.own.t0.append(seat(p, np.full(size, fresh), d0, self.own.keys, np.full(size, 99), k).astype(np.int64))

        def parent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p, key = batch.column("last_p").to_numpy(), batch.column("key").to_numpy()
                t0 = seat(p, np.full(len(p), fresh), d0, key.astype(np.uint64), np.full(len(p), 99), k)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t0.astype(np.int64))], names=[*batch.schema.names, "last_t0"])

        if seated is not None:
            more = lambda base, c: F.col(base) + F.coalesce(F.col(c), F.lit(0)).cast("long")
            joined = self.busy.join(seated.where("not head").drop("head"), "key", "left").select("key", "n", "sw", "su", "t", "p", "t0", more("su", "as_u").alias("last_t"), more("sw", "as_w").alias("last_p"))
            kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields)
            with_parent = joined.mapInArrow(parent, f"{kinds}, last_t0 long")
            out = staged(with_parent.select("key", "n", "sw", "su", *[F.concat(c, F.array(f"last_{c}")).alias(c) for c in ("t", "p", "t0")]), "busy")
            discard(self.busy, seated)
            self.busy = out
        self._totalled(self._idle_t0(k))
        shared.destroy()

    def _sided(self, rows: DataFrame, steps: range) -> DataFrame:
        """rows (u, w, ..) of far pairs with what the words outside the head bring; nulls where a word is in the head."""
        return rows.join(self.contexts(steps), "u", "left").join(self.dishes(steps), "w", "left")

    def _seated_far(self, k: int, shared) -> DataFrame:
        """(key, head, as_u, as_w): tables of the far pairs by word, each as context and as dish."""
        d, keys = self.d, self.keys

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places = Places(keys.value, 63)
            m, p0 = shared.value
            for batch in gathered(batches, 200_000):
                u, w, n = (batch.column(c).to_numpy() for c in ("u", "w", "n"))
                at_u, at_w = places(u.astype(np.uint64)), places(w.astype(np.uint64))
                t = seat(n, _side(batch.column("ms"), m[:, None], at_u)[:, 0] * _side(batch.column("p0s"), p0[:, None], at_w)[:, 0], d, w.astype(np.uint64), u.astype(np.uint64), k)
                for key, at, place in ((u, at_u, 1), (w, at_w, 2)):
                    own, first, of = np.unique(key, return_index=True, return_inverse=True)
                    sums = [pa.array(np.bincount(of, t, len(own)).astype(np.int64)), pa.array(np.zeros(len(own), np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(at[first] >= 0), *(sums if place == 1 else sums[::-1])], names=["key", "head", "as_u", "as_w"])

        rows = self._sided(self.far, range(k, k + 1)).select("u", "w", "n", "ms", "p0s")
        sums = rows.mapInArrow(tidied(run), "key long, head boolean, as_u long, as_w long").groupBy("key", "head").agg(F.sum("as_u").alias("as_u"), F.sum("as_w").alias("as_w"))
        return staged(sums, "far_sums")

    def numerators(self) -> DataFrame:
        """(dest, kind, row_id, blob) by shard: steps between the sorted keys of pairs seen once (kind 0); keys and customers less discounted tables, averaged, of others (kind 1)."""
        d, keys = self.d, self.keys
        zero = F.lit(None).cast("long").alias("row_id")
        once = self.once.select(F.col("shard").alias("dest"), F.lit(0).alias("kind"), zero, F.col("once").alias("blob"))
        bits = self.shard_bits

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            word = keys.value
            for row in rows_of(batches):
                u, w, n, total = unpacked(row["blob"], np.int32, np.int32, np.int64, np.float32)
                key = pair_keys(word[u], word[w])
                yield pa.RecordBatch.from_arrays([pa.array([row["dest"]], pa.int64()), pa.array([packed(key, _short(n - d * total / SAMPLES))], pa.binary())], names=["dest", "blob"])

        out = once.unionByName(self.near.withColumnRenamed("shard", "dest").mapInArrow(tidied(near), "dest long, blob binary").select("dest", F.lit(1).alias("kind"), zero, "blob"))
        if self.far is None:
            return out
        steps = range(BURN_IN, BURN_IN + SAMPLES)
        sides = self.spark.sparkContext.broadcast((np.stack([self.head_weight(k) for k in steps], 1), np.stack([self.head_dish(k) for k in steps], 1)))

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places = Places(keys.value, 63)
            m, p0 = sides.value
            for batch in gathered(batches, 200_000):
                u, w, n = (batch.column(c).to_numpy() for c in ("u", "w", "n"))
                u, w = u.astype(np.uint64), w.astype(np.uint64)
                mass = _side(batch.column("ms"), m, places(u)) * _side(batch.column("p0s"), p0, places(w))
                total = sum(seat(n, mass[:, s], d, w, u, BURN_IN + s) for s in range(SAMPLES))
                key = pair_keys(u, w)
                order = np.argsort(key)
                key, numerator = key[order], _short((n - d * total / SAMPLES)[order])
                rows = [(shard, packed(key[a:b], numerator[a:b])) for shard, a, b in _dealt(key, bits)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["dest", "blob"])

        return out.unionByName(self._sided(self.far, steps).select("u", "w", "n", "ms", "p0s").mapInArrow(tidied(far), "dest long, blob binary").select("dest", F.lit(1).alias("kind"), zero, "blob"))

    def _frequent(self) -> None:
        """Sorted keys and numerators of at most HEAD_PAIRS pairs of head words, the most frequent."""
        d, keys, least = self.d, self.keys, self.least_pair

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            word = keys.value
            for row in rows_of(batches):
                u, w, n, total = unpacked(row["blob"], np.int32, np.int32, np.int64, np.float32)
                some = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(pair_keys(word[u[some]], word[w[some]]).view(np.int64)), pa.array((n - d * total / SAMPLES)[some].astype(np.float32))], names=["key", "numerator"])

        t = staged(self.near.mapInArrow(tidied(run), "key long, numerator float"), "frequent", BLOB_BYTES)
        rows = t.toArrow()
        discard(t)
        key = rows.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        self.pairs = key[order], rows.column("numerator").to_numpy()[order]

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """(weights of the parent, probabilities in the parent) of the head words in each sample."""
        steps = range(BURN_IN + 1, BURN_IN + SAMPLES + 1)
        return np.stack([self.head_weight(k) for k in steps], 1), np.stack([self.head_dish(k) for k in steps], 1)

    def _shown(self) -> np.ndarray:
        """Places of the SHOWN_CONTEXTS most frequent contexts, by hash."""
        return np.sort(np.argsort(-self.own.counts, kind="stable")[:SHOWN_CONTEXTS])

    def unknown(self) -> np.ndarray:
        """Averaged probability of the unknown word in each of the contexts shown."""
        at, (m, _) = self._shown(), self.samples()
        new = np.array([self.new_word(k) for k in range(BURN_IN + 1, BURN_IN + SAMPLES + 1)])
        return (m[at] * new).mean(axis=1) / (self.strength + self.own.counts[at])

    def head(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(least count of a head word, its words sorted, their counts, log10 probabilities by the contexts shown)."""
        at, (m, p0) = self._shown(), self.samples()
        words, places = self.own.keys, np.arange(len(at) * len(self.own.keys))
        context, word = np.repeat(words[at], len(words)), np.tile(words, len(at))
        key = pair_keys(context, word)
        order = np.argsort(key)
        asked = [(shard, 2, 0, bytearray(packed(context[order[a:b]], word[order[a:b]], order[a:b].astype(np.uint32)))) for shard, a, b in _dealt(key[order], self.shard_bits)]
        numerator = np.zeros(len(places))
        if asked:
            requests = self.spark.createDataFrame(asked, "dest long, kind int, row_id long, blob binary")
            found = staged(_answers(self.numerators().unionByName(requests), self.d), "shown", BLOB_BYTES).where("u is not null").select("row_id", "num").toArrow()
            numerator[found.column("row_id").to_numpy()] = found.column("num").to_numpy()
        backed = (m[at][:, None] * p0[None]).mean(axis=2)
        logs = np.log10((numerator.reshape(len(at), -1) + backed) / (self.strength + self.own.counts[at])[:, None]).T
        return self.least, words, self.own.counts, logs.astype(np.float32)


def _short(x: np.ndarray) -> np.ndarray:
    """Positive numbers to 16 binary digits, as whole numbers of three bytes."""
    return (x.astype(np.float32).view(np.uint32) + np.uint32(128)) >> np.uint32(8)


def _long(x: np.ndarray) -> np.ndarray:
    return (x << np.uint32(8)).view(np.float32)


def _side(column: pa.Array, head: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of numbers of one side of pairs: those of head words by their places, others from the joined column; nulls become NaN."""
    width = head.shape[1]
    out = np.full((len(at), width), np.nan)
    some = np.flatnonzero(np.asarray(column.is_valid()))
    if len(some):
        out[some] = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    near = np.flatnonzero(at >= 0)
    out[near] = head[at[near]]
    return out


def _answers(requests: DataFrame, d: float) -> DataFrame:
    """Requests meet their shard's pairs.

    requests: dest, kind, row_id, blob, and ids if there are any of kind 4. Kind
    2 (context, word and text of a token with a word outside the head) gives
    (row_id, u, w, num). Kind 3 (key, backed-off mass and text of tokens of two head words)
    gives (row_id, blob) with the scores of texts, row_id being that of the
    chunk's first text. Kind 4 (texts' own sums and ids) passes through.
    """
    with_ids = "ids" in requests.columns
    id_type = requests.schema["ids"].dataType.elementType.simpleString() if with_ids else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pairs, numerator, parts = None, None, None, []

        def look_up(keys: np.ndarray) -> np.ndarray:
            order = np.argsort(keys)  # neighbours in the table follow one another
            out = np.empty(len(keys))
            out[order] = numerator[pairs(keys[order])]
            return out

        def out(n: int, id_kind: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
            kinds = {"row_id": pa.int64(), "kind": pa.int32(), "blob": pa.binary(), "ids": pa.list_(id_kind), "u": pa.int64(), "w": pa.int64(), "num": pa.float32()}
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kind) for c, kind in kinds.items()], names=list(kinds))

        for batch in batches:
            id_kind = batch.column("ids").type.value_type if with_ids else pa.int64()
            for k, row in enumerate(rows_of([batch.select(["dest", "kind", "row_id", "blob"])])):
                first, kind = row["row_id"], row["kind"]
                if row["dest"] != shard:
                    shard, pairs, parts = row["dest"], None, [(np.zeros(0, _U), np.zeros(0))]
                if kind == 0:
                    keys = np.cumsum(unpacked(row["blob"], _U)[0], dtype=_U)
                    parts.append((keys, np.full(len(keys), 1 - d)))
                    continue
                if kind == 1:
                    keys, value = unpacked(row["blob"], _U, np.uint32)
                    parts.append((keys, _long(value)))
                    continue
                if pairs is None and kind < 4:
                    keys, numerator = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order, parts = np.argsort(keys), []
                    pairs, numerator = Places(keys[order]), np.append(numerator[order], 0.0)  # the last for those not found
                if kind == 2:
                    u, w, doc = unpacked(row["blob"], _U, _U, np.uint32)
                    num = look_up(pair_keys(u, w)).astype(np.float32)
                    for at in range(0, len(u), 100_000):
                        some = slice(at, at + 100_000)
                        columns = {"row_id": first + doc[some].astype(np.int64), "u": u[some].view(np.int64), "w": w[some].view(np.int64), "num": num[some]}
                        yield out(len(columns["u"]), id_kind, **{c: pa.array(x) for c, x in columns.items()})
                    continue
                held = {"row_id": pa.array([first]), "kind": pa.array([kind], pa.int32())}
                if kind == 3:
                    key, mass, doc = unpacked(row["blob"], _U, np.uint32, np.uint32)
                    sums = np.bincount(doc, np.log10(look_up(key) + _long(mass)))
                    own = np.flatnonzero(np.bincount(doc))
                    yield out(1, id_kind, **held, blob=pa.array([packed(own.astype(np.uint32), sums[own])], pa.binary()))
                else:
                    yield out(1, id_kind, **held, blob=pa.array([row["blob"]], pa.binary()), ids=batch.column("ids").slice(k, 1))

    schema = f"row_id long, kind int, blob binary, ids array<{id_type}>, u long, w long, num float"
    return requests.repartition("dest").sortWithinPartitions("dest", "kind").mapInArrow(tidied(run), schema)


def _texts(answers: DataFrame) -> DataFrame:
    """(row_id, doc_id, n_tokens, known, base, score) of each text, from the rows of kinds 3 and 4 of its chunk."""
    id_type = answers.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, ids = None, None, None

        def whole() -> pa.RecordBatch:
            doc, counts, known, base, total = held
            return pa.RecordBatch.from_arrays([pa.array(first + doc.astype(np.int64)), ids, *(pa.array(x) for x in (counts, known, base, total))], names=["row_id", "doc_id", "n_tokens", "known", "base", "score"])

        for batch in batches:
            for k in range(batch.num_rows):
                row_id, kind, blob = (batch.column(c)[k].as_py() for c in ("row_id", "kind", "blob"))
                if kind == 4:  # comes first
                    if held:
                        yield whole()
                    first, held, ids = row_id, unpacked(blob, np.uint32, np.int64, np.int64, np.float64, np.float64), batch.column("ids")[k].values
                else:
                    own, sums = unpacked(blob, np.uint32, np.float64)
                    held[4][np.searchsorted(held[0], own)] += sums
        if held:
            yield whole()

    chunks = answers.where("blob is not null").select("row_id", "kind", "blob", "ids")
    return chunks.repartition("row_id").sortWithinPartitions("row_id", F.desc("kind")).mapInArrow(tidied(run), f"row_id long, doc_id {id_type}, n_tokens long, known long, base double, score double")


def _asked(docs: DataFrame, model: Model) -> DataFrame:
    """What the texts (row_id, doc_id, text) ask of the shards, and what is known of them at once, as _answers takes it."""
    spark = docs.sparkSession
    scale = float(model.tokens + 0.5 * (model.vocabulary + 1))
    m, p0 = model.samples()
    base, denominator = np.log10((model.own.counts + 0.5) / scale), np.log10(model.strength + model.own.counts)
    shared = spark.sparkContext.broadcast((m.astype(np.float32), p0.astype(np.float32), base, denominator.astype(np.float32), *model.pairs))
    keys, bits = model.keys, model.shard_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, p0, base, denominator, pair, numerator = shared.value
        words, pairs, numerator = Places(keys.value, 63), Places(pair), np.append(numerator, 0)
        held: list[tuple] = []

        def sent() -> Iterator[pa.RecordBatch]:
            first = int(held[0][0][0])
            rows = []
            sums = [np.concatenate(x) for x in zip(*[h[:5] for h in held], strict=True)]
            shard = int(mix(np.array([first], dtype=np.uint64))[0] >> _U(64 - bits))
            rows.append((shard, 4, first, packed((sums[0] - first).astype(np.uint32), *sums[1:])))
            key, mass, text = (np.concatenate([h[5][k] for h in held]) for k in range(3))
            order = np.argsort(key)
            key, mass, text = key[order], mass[order], (text[order] - first).astype(np.uint32)
            for shard, a, b in _dealt(key, bits):
                by_text = a + np.argsort(text[a:b])
                rows.append((shard, 3, first, packed(key[by_text], mass[by_text], text[by_text])))
            u, w, text = (np.concatenate([h[6][k] for h in held]) for k in range(3))
            key = pair_keys(u, w)
            order = np.argsort(key)
            u, w, text = u[order], w[order], (text[order] - first).astype(np.uint32)
            for shard, a, b in _dealt(key[order], bits):
                by_text = a + np.argsort(text[a:b])
                rows.append((shard, 2, first, packed(u[by_text], w[by_text], text[by_text])))
            for k in range(0, len(rows), 16):
                part = list(zip(*rows[k : k + 16], strict=True))
                own = pa.concat_arrays([h[7] for h in held]) if not k else pa.nulls(0, held[0][7].type)  # the first row is that of kind 4
                ids = pa.ListArray.from_arrays(pa.array([0, *[len(own)] * len(part[0])], pa.int32()), own, mask=pa.array([bool(k or i) for i in range(len(part[0]))]))
                columns = [pa.array(part[0], pa.int64()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.binary()), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["dest", "kind", "row_id", "blob", "ids"])

        n_held = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, end in slices(batch.column(2)):
                word, context, doc, counts = tokens(batch.column(2).slice(start, end - start))
                n = len(counts)
                at = words(word)
                before = np.empty_like(at)
                before[1:] = at[:-1]
                ends = words(np.array([END], dtype=np.uint64))[0]
                before[np.cumsum(counts) - counts] = ends
                known = at >= 0
                near = known & (before >= 0)
                rest = np.flatnonzero(~near)
                near = np.flatnonzero(near)
                key = pair_keys(context[near], word[near])
                mass = np.einsum("ij,ij->i", m[before[near]], p0[at[near]]) / SAMPLES
                hit = pairs(key)
                found = hit >= 0
                score = -np.bincount(doc[near], denominator[before[near]], n)
                score += np.bincount(doc[near[found]], np.log10(numerator[hit[found]] + mass[found]), n)
                left = ~found
                held.append(
                    (
                        ids[start:end],
                        counts.astype(np.int64),
                        np.bincount(doc[known], minlength=n).astype(np.int64),
                        np.bincount(doc[known], base[at[known]], n).astype(np.float64),
                        score.astype(np.float64),
                        (key[left], _short(mass[left]), ids[start + doc[near[left]]]),
                        (context[rest], word[rest], ids[start + doc[rest]]),
                        batch.column(1).slice(start, end - start),
                    )
                )
                n_held += len(word)
                if n_held > ASKED_AT_ONCE:
                    yield from sent()
                    held.clear()
                    n_held = 0
        if held:
            yield from sent()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return bounded_batches(docs).mapInArrow(tidied(run), f"dest long, kind int, row_id long, blob binary, ids array<{id_type}>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty: its one token is the end. Rows are scored each on their
    own, so repeated rows and null ids are given as often as they come. Without
    training tokens every token is unknown. Other columns are not touched.
    """
    scale = float(model.tokens + 0.5 * (model.vocabulary + 1))
    d, strength = model.d, model.strength
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    requests = _asked(rows, model).unionByName(model.numerators(), allowMissingColumns=True)
    answers = staged(_answers(requests, d), "answers", BLOB_BYTES)
    released(docs.sparkSession)
    steps = range(BURN_IN + 1, BURN_IN + SAMPLES + 1)
    new = [model.new_word(k) for k in steps]
    sides = docs.sparkSession.sparkContext.broadcast((*(x.astype(np.float32) for x in model.samples()), model.own.counts))
    keys = model.keys

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(keys.value, 63)
        m, p0, counts = sides.value
        for batch in gathered(batches, 200_000):
            u, w = (batch.column(c).to_numpy().astype(np.uint64) for c in ("u", "w"))
            at_u, at_w = places(u), places(w)
            weight, dish = _side(batch.column("ms"), m, at_u), _side(batch.column("p0s"), p0, at_w)
            weight[np.isnan(weight[:, 0])] = strength
            strange = np.isnan(dish[:, 0])
            dish[strange] = new
            customers = batch.column("customers").fill_null(0).to_numpy().astype(np.float64)
            customers[at_u >= 0] = counts[at_u[at_u >= 0]]
            known = batch.column("known").fill_null(0).to_numpy()
            p = (batch.column("num").to_numpy() + (weight * dish).mean(axis=1)) / (strength + customers)
            late = at_w < 0  # the head's own words are in the sums already
            base = np.where(late, np.log10((known + 0.5) / scale), 0.0)
            row, of = np.unique(batch.column("row_id").to_numpy(), return_inverse=True)
            out = [np.bincount(of, late & (known > 0), len(row)).astype(np.int64), np.bincount(of, base, len(row)), np.bincount(of, np.log10(p), len(row))]
            yield pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(x) for x in out)], names=["row_id", "known", "base", "score"])

    rest = answers.where("u is not null").select("row_id", "u", "w", "num")
    contexts = model.tail.select(F.col("key").alias("u"), F.col("n").alias("customers"), "ms")
    dishes = model.tail.select(F.col("key").alias("w"), F.col("n").alias("known"), "p0s")
    tail = rest.join(contexts, "u", "left").join(dishes, "w", "left").mapInArrow(tidied(finish), "row_id long, known long, base double, score double")
    texts = staged(_texts(answers), "texts", BLOB_BYTES)
    sums = texts.unionByName(staged(tail, "tail"), allowMissingColumns=True)
    total = sums.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "known", "base", "score")])  # one row has the id
    return total.select(
        "doc_id",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        F.col("base").cast("double").alias("base_score"),
        F.col("score").cast("double").alias("score"),
    )


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from: those whose fold of 5 is not 1."""
    return docs.where(fold(F.col("doc_id"), 5) != 1)
