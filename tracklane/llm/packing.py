"""Best-fit packing of tokenised documents into fixed-length sequences by minimum bin slack.

Only lengths matter to the packing, and there are at most `capacity` of them.
So the histogram of all piece lengths (at most `capacity` rows) is all that the
driver sees. There, each bin is opened with the longest length left; a subset-sum
dynamic programme over bitsets finds the fullest feasible combination of the
lengths left; and that combination is removed as often as the counts allow.
Pieces then get their places by rank within their length: ranks are running
counts over hash buckets, so a length that a third of all pieces share is spread
over many tasks.
"""

from __future__ import annotations

import re
import struct
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import bounded_batches, buckets_for, hash_bucket, return_memory, running_sum, staged

CAPACITY = 4096
END_ID = 1
#: Distinct words that a worker keeps the ids of, in each of two generations.
CACHED_WORDS = 300_000
#: Unknown words that go to the tokenizer as one text, for its cost per call.
JOINED_WORDS = 200
#: Seconds after its last task at which a worker forgets what it has learned.
IDLE_SECONDS = 20.0

#: Blanks that the tokenizer drops and that no token spans.
_BLANKS = bytes.maketrans(b"\t\n\r", b"   ")

#: Letters that are their own normal form and that one letter replaces in lower case, then punctuation that
#: begins no special token and no contraction.
_LATIN = re.compile(r"""([A-Za-z\u00c0-\u012f\u0132-\u01c3]+)([!"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)""")

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def _split(word: bytes) -> tuple[bytes, bytes]:
    """A word's core and tail with the same ids end to end: the tokenizer takes Latin letters in lower case, and
    cuts between them and the punctuation after them."""
    if (m := _LATIN.fullmatch(word.decode())) and m[1].isalpha():
        return m[1].lower().encode(), m[2].encode()
    return word, b""


class _Kept:
    """This worker process's encoder. What it has learned serves the tasks that follow at once, but not idle workers' memory."""

    path: str | None = None
    encoder: WordEncoder | None = None
    timer: threading.Timer | None = None
    lock = threading.Lock()


def borrow_encoder(path: str, cached_words: int = CACHED_WORDS) -> WordEncoder:
    with _Kept.lock:
        if _Kept.timer:
            _Kept.timer.cancel()
        encoder = _Kept.encoder if _Kept.path == path else None
        _Kept.encoder = None
    encoder = encoder or WordEncoder(path)
    encoder.cached_words = cached_words
    return encoder


def return_encoder(path: str, encoder: WordEncoder, idle_seconds: float) -> None:
    def drop() -> None:
        with _Kept.lock:
            _Kept.encoder = None
        return_memory()

    with _Kept.lock:
        _Kept.path, _Kept.encoder = path, encoder
        _Kept.timer = threading.Timer(idle_seconds, drop)
        _Kept.timer.daemon = True
        _Kept.timer.start()


class WordEncoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes.

    The tokenizer normalises, splits and merges within runs of non-blank
    characters only, so a text's ids are its words' ids end to end, and each
    distinct word needs the tokenizer once. Words are kept in two generations:
    when the young one is full it becomes the old one, so frequent words stay
    and memory is bounded.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.cached_words = CACHED_WORDS
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _held(self, word: bytes) -> bytes | None:
        if (ids := self.young.get(word)) is None and (ids := self.old.get(word)) is not None:
            self.young[word] = ids
        return ids

    def _learn(self, words: set[bytes]) -> None:
        if len(self.young) + len(words) > self.cached_words:
            self.young, self.old = {}, self.young
        fresh, made = set(), []
        for w in words:
            if self._held(w) is None:
                core, tail = _split(w)
                if self._held(core) is None:
                    fresh.add(core)
                if core != w:
                    made.append((w, core, tail))
        known = list(fresh)
        for at in range(0, len(known), JOINED_WORDS * 50):
            self._tokenize(known[at : at + JOINED_WORDS * 50])
        for w, core, tail in made:
            if tail not in self.young:
                self._tokenize([tail])
            self.young[w] = self.young[core] + self.young[tail]

    def _tokenize(self, words: list[bytes]) -> None:
        """Learns the ids of words: those of Latin letters from the merges alone, all others by the whole tokenizer."""
        merge, level, others = self.tokenizer.model.tokenize, self.bytes.pre_tokenize_str, []
        for w in words:
            if w.isalpha() and w.islower():
                mapped = w.decode()
            elif (m := _LATIN.fullmatch(w.decode())) and m[1].isalpha() and not m[2]:
                mapped = level(m[1].lower())[0][0]
            else:
                others.append(w)
                continue
            self.young[w] = struct.pack(f"<{len(t := merge(mapped))}I", *[x.id for x in t])
        if others:
            self._tokenize_joined(others)

    def _tokenize_joined(self, words: list[bytes]) -> None:
        groups = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        spelled = [[w.decode() for w in g] for g in groups]
        for group, names, e in zip(groups, spelled, self.tokenizer.encode_batch([" ".join(g) for g in spelled], add_special_tokens=False), strict=True):
            ends = np.cumsum([len(w) + 1 for w in names])
            ids = np.array(e.ids, dtype="<u4").tobytes()
            word = np.searchsorted(ends, np.array([o[0] for o in e.offsets], dtype=np.int64), side="right")
            cuts = (4 * np.searchsorted(word, np.arange(len(group) + 1))).tolist()
            for k, w in enumerate(group):
                self.young[w] = ids[cuts[k] : cuts[k + 1]]

    def encode(self, text: str) -> bytes:
        words = text.encode("utf-8", "replace").translate(_BLANKS).split(b" ")
        try:
            return b"".join([self.young[w] for w in words])
        except KeyError:
            self._learn(set(words))
            return b"".join([self.young[w] for w in words])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, idle_seconds: float = IDLE_SECONDS, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Tokenised pieces of documents: doc_id, piece, start, length, ids_crc32, and ids (binary) if with_ids.

    A document is its ids and then end_id; longer ones are cut into pieces of
    `capacity` tokens, the last of which may be shorter. Null and empty texts
    are one piece that holds end_id alone. A worker keeps the ids of up to twice
    cached_words words, and for idle_seconds after its last task.
    """
    out_schema = PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()) + (", ids binary" if with_ids else "")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = borrow_encoder(tokenizer_path, cached_words)
        for batch in batches:
            rows, number, starts, lengths, crcs, blobs = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(row)
                    number.append(k)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    if with_ids:
                        blobs.append(part)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(blobs, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        return_encoder(tokenizer_path, encoder, idle_seconds)

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, out_schema)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths with multiplicities whose sum is the largest that fits into room.

    counts: pieces left of each length. reach's bit s is set if s tokens can be
    filled. Lengths come in from the longest down, in binary portions of their
    counts, until the room can be filled exactly or no length is left.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, portion = min(counts[length], room // length), 1
        while left > 0:
            n = min(portion, left)
            steps.append((reach, length, n))
            reach |= (reach << (length * n)) & mask
            left, portion = left - n, portion * 2
        if reach >> room:
            break
    fill = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, length, n in reversed(steps):
        if not before >> fill & 1:
            chosen[length] = chosen.get(length, 0) + n
            fill -= length * n
    return list(chosen.items())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ranks: (length, first rank, ranks, per sequence, first sequence, offset), from the counts of all lengths."""
    left = {n: c for n, c in histogram.items() if c > 0}
    next_rank = dict.fromkeys(left, 0)
    places, sequence = [], 0
    while left:
        first = max(left)
        rest = left | {first: left[first] - 1}
        combination = dict(fullest({n: c for n, c in rest.items() if c}, capacity - first))
        combination[first] = combination.get(first, 0) + 1
        times = min(left[n] // k for n, k in combination.items())
        offset = 0
        for n, k in combination.items():
            places.append((n, next_rank[n], k * times, k, sequence, offset))
            next_rank[n] += k * times
            offset += n * k
            left[n] -= k * times
            if not left[n]:
                del left[n]
        sequence += times
    return places


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...), whose other columns stay.

    Sequences are filled without gaps from offset 0. The order of equal lengths
    is that of a hash of doc_id and piece, so reruns agree; repeated rows keep
    their own places. An empty table gives an empty result.
    """
    spark = cut.sparkSession
    cut = staged(cut, "pieces")
    buckets = buckets_for(cut.count())
    histogram = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    places = np.array(plan(histogram, capacity) or np.zeros((0, 6)), dtype=np.int64)
    places = places[np.lexsort((places[:, 1], places[:, 0]))] if len(places) else places
    shared = spark.sparkContext.broadcast(places)  # a few places for each of at most `capacity` lengths
    span = 1 << 44
    digest = F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("piece").cast("string")).cast("binary")), 1, 16)
    ranked = running_sum(
        cut.withColumn("h", digest).withColumn("bucket", hash_bucket(F.col("h"), buckets)).withColumn("one", F.lit(1).cast("long")),
        ["length"],
        "bucket",
        ["h", "doc_id", "piece"],
        "one",
        "rank",
    ).select(*cut.columns, (F.col("rank") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = p[:, 0] * span + p[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = p[np.searchsorted(keys, length * span + rank, side="right") - 1]
            turn, slot = np.divmod(rank - row[:, 1], row[:, 3])
            names = [n for n in batch.schema.names if n != "rank"]
            columns = [batch.column(n) for n in names] + [pa.array(row[:, 4] + turn), pa.array(row[:, 5] + slot * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pack() over pieces(with_ids=True): sequence_id, length, ids (binary)."""
    part = F.struct("offset", "ids")
    joined = F.aggregate(F.sort_array(F.collect_list(part)), F.lit(b""), lambda a, x: F.concat(a, x["ids"]))  # at most `capacity` tokens
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
