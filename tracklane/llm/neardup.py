"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures, confirmed on whole shingle sets.

1. A pass over whole texts gives each document's set of 2-word shingles: its
   size, a 128-bit digest of the set and a signature of SIGNATURE b-bit minima
   (b = 8). Equal sets are one class, found by a pre-aggregated group-by; its
   least doc_id stands for it from here on.
2. Signatures are split into CHUNKS chunks. By the pigeonhole principle two
   signatures at distance up to 2 * CHUNKS - 1 have a chunk with at most one
   error; so each chunk is indexed once for each position left out, and all
   such pairs share an index entry. (At a Jaccard similarity of 0.8 a pair with
   a larger distance is still found unless every chunk has two errors or more:
   2.4e-5 of such pairs are missed, fewer above.)
3. Documents that share an entry and whose signatures differ in at most
   FAR positions are joined into candidate clusters, first by the entries of
   some chunks, then, where these left them apart, by all others. Entries give
   a spanning forest of their close pairs, never all pairs; entries with many
   documents are worked on in pairs of blocks.
4. Whole sets of the documents in clusters are built again from their texts,
   and each cluster's links are confirmed exactly, in pairs of blocks, which
   give spanning forests of the confirmed links. Their components are the
   result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import bounded_batches, staged, tidied
from tracklane.llm.graph import Forest, components
from tracklane.llm.grouping import whole_groups
from tracklane.llm.textvec import Words, mix, shingles, slices

CHUNKS, CHUNK = 10, 6
SIGNATURE = CHUNKS * CHUNK
#: Signature distance above which a pair is not a candidate: at similarity 0.8, 1e-7 of pairs are farther apart.
FAR = 28
#: Percent of the union that the intersection has at least.
PERCENT = 80
#: Chunks that are worked on first: from the others, members that these link with one document need no links more.
FIRST_CHUNKS = range(2)
ENTRY_BLOCK = 8192
CLUSTER_BLOCK = 1024
CLUSTER_SHINGLES = 2_000_000
#: Ids that may be broadcast (8 bytes each); beyond that a shuffled join selects the texts.
BROADCAST_IDS = 1_000_000

_FACTORS = mix(np.arange(1000, 1000 + SIGNATURE, dtype=np.uint64)) | np.uint64(1)


def signatures(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """b-bit minima (b = 8), one row of SIGNATURE bytes for each nonempty set."""
    out = np.empty((len(begins), SIGNATURE), dtype=np.uint8)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = mix(np.minimum.reduceat(values * factor, begins)) >> np.uint64(56)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, fp1, fp2 (digest of the set), signature; the last three null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1)):
                part = batch.slice(start, end - start)
                values, at = shingles(Words(part.column(1)))
                sizes = np.diff(at)
                full = sizes > 0
                f1, f2 = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                signed = [None] * len(sizes)
                if full.any():
                    begins = at[:-1][full]
                    f1[full] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5)), begins).view(np.int64)
                    f2[full] = np.bitwise_xor.reduceat(mix(values * np.uint64(0x2545F4914F6CDD1D)), begins).view(np.int64)
                    for row, s in zip(np.flatnonzero(full).tolist(), signatures(values, begins), strict=True):
                        signed[row] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(f1, mask=~full), pa.array(f2, mask=~full), pa.array(signed, pa.binary())],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "signature"],
                )

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(tidied(run), "doc_id long, n_shingles long, fp1 long, fp2 long, signature binary")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SIGNATURE)


def index_entries(classes: DataFrame, chunks: range = range(CHUNKS)) -> DataFrame:
    """(entry, rep): for each of the chunks and each of its positions left out, a hash of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signed = matrix(batch.column(1)).astype(np.uint64)
            for chunk in chunks:
                own = [signed[:, chunk * CHUNK + k] << np.uint64(8 * k) for k in range(CHUNK)]
                whole = np.bitwise_or.reduce(own)
                for left_out in range(CHUNK):
                    entry = mix((whole ^ own[left_out]) | np.uint64((chunk * CHUNK + left_out + 1) << 56))
                    yield pa.RecordBatch.from_arrays([pa.array(entry.view(np.int64)), batch.column(0)], names=["entry", "rep"])

    return classes.select("rep", "signature").mapInArrow(run, "entry long, rep long")


def block_pairs(df: DataFrame, key: str, blocks: str) -> DataFrame:
    """Deals the rows of a key to `blocks` blocks and repeats each row for every pair of blocks with its own."""
    own = F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
    pair = lambda j: F.struct(F.least(F.col("own"), j).alias("low"), F.greatest(F.col("own"), j).alias("high"))
    each = F.transform(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1), pair)
    return df.withColumn("own", own).withColumn("pair", F.explode(each)).select("*", "pair.*").drop("own", "pair", blocks)


def reached(first: int, waiting: np.ndarray, near) -> list[tuple[int, np.ndarray]]:
    """Breadth-first search from `first` through `waiting`: near(u, others) marks the others that u is linked with."""
    found, queue = [], [first]
    while queue and len(waiting):
        u = queue.pop()
        hit = near(u, waiting)
        if hit.any():
            found.append((u, waiting[hit]))
            queue.extend(waiting[hit].tolist())
            waiting = waiting[~hit]
    return found


def forest(n: int, near) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the links among 0..n-1, as stars."""
    waiting = np.arange(n)
    while len(waiting) > 1:
        first, waiting = int(waiting[0]), waiting[1:]
        stars = reached(first, waiting, near)
        for star in stars:
            yield star
            waiting = np.setdiff1d(waiting, star[1], assume_unique=True)


def close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest, between roots, of the close pairs of all entries (and pairs of blocks) in the partition."""
    known = Forest()
    for table, at in whole_groups(batches, ["entry", "low", "high"]):
        rep, signed = table.column("root").to_numpy(), matrix(table.column("signature"))
        head = np.repeat(at[:-1], np.diff(at))
        close = (signed != signed[head]).sum(axis=1) <= FAR
        a, b = [rep[head[close]]], [rep[close]]
        rest = np.add.reduceat(~close, at[:-1])
        for g in np.flatnonzero(rest):  # members that are not close to the first
            rows = np.arange(at[g], at[g + 1])
            part = signed[rows]
            for u, others in forest(len(rows), lambda u, w, part=part: (part[w] != part[u]).sum(axis=1) <= FAR):
                a.append(np.full(len(others), rep[rows[u]]))
                b.append(rep[rows[others]])
        yield known.fresh(np.concatenate(a), np.concatenate(b))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from products of 0/1 matrices over the shared values, some columns at a time."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        for start in range(0, int(column[-1]) + 1, 4096):
            lo, hi = np.searchsorted(column, [start, start + 4096])
            dense = np.zeros((len(sets), 4096), dtype=np.float32)
            dense[owner[lo:hi], column[lo:hi] - start] = 1
            out += dense @ dense.T
    return out


def confirmed(sets: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """A spanning forest, as stars, of the pairs whose intersection is at least PERCENT of their union."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if len(sets) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, np.array([1]))] if 100 * shared >= PERCENT * (sizes.sum() - shared) else []
    shared = common_counts(sets).astype(np.int64)
    linked = 100 * shared >= PERCENT * (sizes[:, None] + sizes[None, :] - shared)
    return list(forest(len(sets), lambda u, w: linked[u, w]))


def exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the confirmed links of all clusters (and pairs of blocks) in the partition."""
    known = Forest()
    for table, at in whole_groups(batches, ["root", "low", "high"]):
        rep, sets = table.column("rep").to_numpy(), table.column("shingles")
        a, b = [], []
        for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            ids, first = np.unique(rep[start:end], return_index=True)  # repeated rows bring the same set again
            if len(ids) > 1:
                own = sets.slice(start, end - start).take(pa.array(first))
                for u, others in confirmed([np.frombuffer(x.as_py(), dtype=np.uint64) for x in own]):
                    a.append(np.full(len(others), ids[u]))
                    b.append(ids[others])
        if a:
            yield known.fresh(np.concatenate(a), np.concatenate(b))


def whole_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, fp1, shingles as binary) of the documents whose id is a rep in members."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    wanted = members.select("rep")
    texts = texts.join(F.broadcast(wanted) if members.count() <= BROADCAST_IDS else wanted, "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(1)):
                part = batch.slice(start, end - start)
                values, at = shingles(Words(part.column(1)))
                sizes = np.diff(at)
                full = np.flatnonzero(sizes > 0)
                if len(full):
                    f1 = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5)), at[:-1][full]).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(full)), pa.array(f1), pa.array([values[at[i] : at[i + 1]].tobytes() for i in full.tolist()], pa.binary())],
                        names=["rep", "fp1", "shingles"],
                    )

    return bounded_batches(texts).mapInArrow(tidied(run), "rep long, fp1 long, shingles binary")


def close_links(classes: DataFrame, chunks: range) -> DataFrame:
    """Links between the roots of classes (rep, root, signature) that share an entry of the chunks and are close."""
    entries = index_entries(classes, chunks)
    shared = entries.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / ENTRY_BLOCK)).drop("n")
    met = block_pairs(entries.join(shared, "entry"), "entry", "blocks").join(classes.select("rep", "root", "signature"), "rep")
    keys = ["entry", "low", "high"]
    return met.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "root", "signature").mapInArrow(tidied(close_pairs), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Documents without words have no shingles, are their own component and are
    kept. Rows with a null doc_id are compared like others, but cannot stand
    for a class: with no other member they have a null component and are kept.
    Rows that repeat a doc_id are members of one class if their texts' sets are
    equal; otherwise each row takes the component of its own set.
    """
    prints = staged(fingerprints(docs), "fingerprints")
    classes = staged(
        prints.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy("fp1", "fp2")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.min("signature").alias("signature")),
        "classes",
    )
    first = staged(close_links(classes.withColumn("root", F.col("rep")), FIRST_CHUNKS), "first")
    least = first.groupBy(F.greatest("a", "b").alias("rep")).agg(F.min(F.least("a", "b")).alias("root"))
    rooted = staged(classes.join(least, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "rooted")
    met = staged(first.union(close_links(rooted, range(FIRST_CHUNKS.stop, CHUNKS))), "met")  # written, so that no task holds two Python workers
    clusters = components(met)
    members = staged(clusters.withColumnRenamed("node", "rep").join(classes.select("rep", "fp1", "n_shingles"), "rep"), "members")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.select("root", F.greatest(F.ceil(F.col("n") / CLUSTER_BLOCK), F.ceil(F.col("s") / CLUSTER_SHINGLES)).alias("blocks"))
    dealt = block_pairs(members.join(sizes, "root"), "root", "blocks").select("rep", "fp1", "root", "low", "high")
    keys = ["root", "low", "high"]
    with_sets = dealt.join(whole_sets(docs, members), ["rep", "fp1"])
    linked = with_sets.repartition(*keys).sortWithinPartitions(*keys, "rep").select(*keys, "rep", "shingles").mapInArrow(tidied(exact_links), "a long, b long")
    roots = components(staged(linked, "linked"))
    of_class = classes.select("fp1", "fp2", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp1", "fp2", F.coalesce("root", "rep").alias("root"))
    placed = prints.drop("signature").join(of_class, ["fp1", "fp2"], "left").withColumn("component_id", F.coalesce("root", "doc_id"))
    return placed.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
