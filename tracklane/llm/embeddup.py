"""Embedding near-duplicates by sorted projection passes.

1. Equal vectors are one class (pre-aggregated group-by on a 128-bit digest);
   the least vec_id stands for it, with its number of rows.
2. In each pass, vectors are ordered lexicographically by KEY_BITS concatenated
   hyperplane hashes and compared with their next WINDOW neighbours by sketches
   of SKETCH_BITS further hashes. The order is a range sort over all passes;
   windows go on over the borders of its partitions. Close pairs are joined, as
   a spanning forest per partition. Two vectors of a pair at the threshold agree
   in a hash 0.899 of the time, wherever they lie, and meet in a pass if they do
   in the first log2(n / WINDOW) of n classes; the number of passes grows with
   n so that at most MISSED of such pairs meet in none (25 passes for 50,000
   classes, 82 for 50 million).
3. Where more than WINDOW neighbours agree in all of the first hashes that
   spread n classes evenly, a window does not reach all of them: such dense runs
   are compared whole, in pairs of blocks.
4. The components of all passes are the candidate clusters. In each, all pairs
   are verified by cosine in double precision, in pairs of blocks, which give
   each vector's number of links and a spanning forest of them; no pairs are
   written out. The components of the verified links are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklane.llm.common import released, staged
from tracklane.llm.graph import Forest, components
from tracklane.llm.grouping import whole_groups
from tracklane.llm.neardup import block_pairs, forest

THRESHOLD = 0.95
#: Passes at least.
PASSES = 24
#: Pairs at the threshold that may meet in no pass.
MISSED = 1e-4
KEY_BITS = 64
SKETCH_BITS = 256
#: Differing sketch bits up to which a pair is a candidate: six deviations above the mean at the threshold.
SKETCH_FAR = 55
#: Neighbours that a vector is compared with in a pass.
WINDOW = 32
CLUSTER_BLOCK = 1024


def planes(dim: int, seed: int, bits: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, bits]).standard_normal((dim, bits))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; they are scaled first, so no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) for each length of list in the column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield dim, rows, flat.astype(np.float64).reshape(len(rows), dim)


def plan(classes: int, passes: int = PASSES) -> tuple[int, int]:
    """(hashes that a pair must agree in to meet, passes): as many passes as leave MISSED of the pairs at the threshold apart, and no fewer than given."""
    bits = min(KEY_BITS, max(0, math.ceil(math.log2(max(classes, 1) / WINDOW))))
    meets = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return bits, max(passes, math.ceil(math.log(MISSED) / math.log1p(-meets)) if meets < 1 else 1)


def sorted_keys(classes: DataFrame, passes: int) -> DataFrame:
    """(part, key, rep, sketch) of each class in each pass; part stands for pass and dimension, keys are in signed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, vectors in by_dimension(batch.column(1)):
                rep = batch.column(0).take(pa.array(rows))
                vectors = unit(vectors)
                sketch = pa.array([s.tobytes() for s in np.packbits(vectors @ planes(dim, 0, SKETCH_BITS) > 0, axis=1)], pa.binary())
                for p in range(passes):
                    bits = np.packbits(vectors @ planes(dim, p + 1, KEY_BITS) > 0, axis=1)
                    key = bits.view(">u8").astype(np.uint64).ravel() ^ np.uint64(1 << 63)
                    part = pa.array(np.full(len(rows), dim << 20 | p, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([part, pa.array(key.view(np.int64)), rep, sketch], names=["part", "key", "rep", "sketch"])

    return classes.select("rep", "vector").mapInArrow(run, "part long, key long, rep long, sketch binary")


def _bits(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(rows, -1)


def _close(sketch: np.ndarray, part: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs among each row's WINDOW successors of the same part."""
    a, b = [rep[:0]], [rep[:0]]
    for step in range(1, min(WINDOW, len(rep) - 1) + 1):
        near = np.flatnonzero((np.bitwise_count(sketch[step:] ^ sketch[:-step]).sum(axis=1) <= SKETCH_FAR) & (part[step:] == part[:-step]))
        a.append(rep[near])
        b.append(rep[near + step])
    return np.concatenate(a), np.concatenate(b)


LINKS = "a long, b long, task long, place long, back long, part long, rep long, sketch binary, prefix long, size long"
_LINK_TYPES = [(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in LINKS.split(", ")]


def _links_row(n: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    arrays = [pa.nulls(n, kind) if name not in columns else pa.array(x, kind) if isinstance(x := columns[name], np.ndarray) else x for name, kind in _LINK_TYPES]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in _LINK_TYPES])


def window_links(entries: DataFrame, bits: int) -> DataFrame:
    """Of each partition of the range sort: links (a, b) among neighbours, its first and last WINDOW rows (task, place from the start, back from the end) and its runs (part, prefix, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, seen, task = Forest(), None, 0, None
        runs: tuple[int, int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("task")[0].as_py()
            if seen < WINDOW:
                first = batch.slice(0, WINDOW - seen)
                n = first.num_rows
                yield _links_row(n, task=np.full(n, task), place=np.arange(seen, seen + n), **{c: first.column(c) for c in ("part", "rep", "sketch")})
            prefix = batch.column("key").to_numpy() >> np.int64(KEY_BITS - bits) if bits else np.zeros(batch.num_rows, np.int64)
            part = batch.column("part").to_numpy()
            cuts = np.flatnonzero((np.diff(prefix, prepend=prefix[0]) != 0) | (np.diff(part, prepend=part[0]) != 0))
            begins = np.concatenate([[0], cuts])
            sizes = np.diff(np.append(begins, len(prefix)))
            found = list(zip(part[begins].tolist(), prefix[begins].tolist(), sizes.tolist(), strict=True))
            if runs and runs[:2] == found[0][:2]:
                found[0] = (*runs[:2], runs[2] + found[0][2])
            elif runs:
                found.insert(0, runs)
            runs = found.pop()
            if found:  # a run may go on in the next partition, so short ones count too at either end
                yield _links_row(len(found), **{c: np.array([x[k] for x in found]) for k, c in enumerate(("part", "prefix", "size"))})
            table = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks()
            rep = table.column("rep").to_numpy()
            joined = known.fresh(*_close(_bits(table.column("sketch"), len(rep)), table.column("part").to_numpy(), rep))
            yield _links_row(joined.num_rows, a=joined.column(0), b=joined.column(1))
            held = table.slice(max(0, len(rep) - WINDOW)).combine_chunks().to_batches()[0]
            seen += batch.num_rows
        if held is not None:
            n = held.num_rows
            yield _links_row(n, task=np.full(n, task), back=np.arange(n)[::-1].copy(), **{c: held.column(c) for c in ("part", "rep", "sketch")})
            yield _links_row(1, **{c: np.array([runs[k]]) for k, c in enumerate(("part", "prefix", "size"))})

    ordered = entries.repartitionByRange("part", "key").sortWithinPartitions("part", "key", "rep")
    return ordered.withColumn("task", F.spark_partition_id().cast("long")).mapInArrow(run, LINKS)


def border_links(found: DataFrame) -> DataFrame:
    """Links over the borders of partitions: at each, the WINDOW rows before it meet the WINDOW rows after it."""
    ends = found.where("task is not null")
    sizes = {r["task"]: r["n"] for r in ends.where("place is not null").groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition, WINDOW at most
    order = sorted(sizes)
    reach: list[tuple[int, int, int, int]] = []  # task, border (before the task of this rank), rows of its end, rows of its start that belong there
    for k in range(1, len(order)):
        for step, side in ((-1, 0), (1, 1)):
            left, at = WINDOW, k - 1 if step < 0 else k
            while left > 0 and 0 <= at < len(order):
                taken = min(left, sizes[order[at]])
                reach.append((order[at], k, taken if side == 0 else 0, taken if side == 1 else 0))
                left, at = left - taken, at + step
    if not reach:
        return found.select("a", "b").where("false")
    borders = found.sparkSession.createDataFrame(reach, "task long, border long, from_end long, from_start long")
    met = ends.join(F.broadcast(borders), "task").where("back < from_end or place < from_start")  # about two rows for each partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forest()
        for table, at in whole_groups(batches, ["border"]):
            rep, part = table.column("rep").to_numpy(), table.column("part").to_numpy()
            sketch = _bits(table.column("sketch"), len(rep))
            for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield known.fresh(*_close(sketch[start:end], part[start:end], rep[start:end]))

    place = F.when(F.col("back").isNotNull(), -F.col("back")).otherwise(F.col("place"))
    return met.withColumn("place", place).repartition("border").sortWithinPartitions("border", "task", "place").select("border", "part", "rep", "sketch").mapInArrow(run, "a long, b long")


def dense_links(entries: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """Links within the runs of more than WINDOW + 1 classes that agree in the first hashes; runs above CLUSTER_BLOCK in pairs of blocks."""
    runs = found.where("prefix is not null").groupBy("part", "prefix").agg(F.sum("size").alias("size")).where(F.col("size") > WINDOW + 1)
    prefix = F.shiftright("key", KEY_BITS - bits) if bits else F.lit(0).cast("long")
    rows = entries.withColumn("prefix", prefix).join(runs, ["part", "prefix"]).withColumn("run", F.xxhash64("part", "prefix"))
    sized = rows.select("run", "rep", "sketch", F.ceil(F.col("size") / CLUSTER_BLOCK).alias("blocks"))
    keys = ["run", "low", "high"]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forest()
        for table, at in whole_groups(batches, keys):
            rep = table.column("rep").to_numpy()
            sketch = _bits(table.column("sketch"), len(rep))
            for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own, ids = sketch[start:end], rep[start:end]
                stars = list(forest(len(ids), lambda u, w, own=own: np.bitwise_count(own[w] ^ own[u]).sum(axis=1) <= SKETCH_FAR))
                if stars:
                    yield known.fresh(np.concatenate([np.repeat(ids[u], len(others)) for u, others in stars]), np.concatenate([ids[others] for _, others in stars]))

    return block_pairs(sized, "run", "blocks").repartition(*keys).sortWithinPartitions(*keys, "rep").select(*keys, "rep", "sketch").mapInArrow(links, "a long, b long")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of blocks: (a, b) a spanning forest of verified links, and (a, null, links) each member's linked rows.

    A member counts links with its own block in the pair of that block with
    itself, and with the other block in every other pair.
    """
    for table, at in whole_groups(batches, ["root", "low", "high"]):
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        rep, rows, own = (table.column(c).to_numpy() for c in ("rep", "rows", "own"))
        vectors = table.column("vector").combine_chunks()
        out = ([], [], [])
        for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if end - start < 2:
                continue
            part = vectors.slice(start, end - start)
            x = unit(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(end - start, -1))
            linked = x @ x.T >= THRESHOLD
            np.fill_diagonal(linked, False)
            for u, others in forest(end - start, lambda u, w, linked=linked: linked[u, w]):
                out[0].extend([rep[start + u]] * len(others))
                out[1].extend(rep[start + others].tolist())
                out[2].extend([None] * len(others))
            counted = linked if low[start] == high[start] else linked & (own[start:end, None] != own[None, start:end])
            links = counted @ rows[start:end]
            some = np.flatnonzero(links)
            out[0].extend(rep[start + some].tolist())
            out[1].extend([None] * len(some))
            out[2].extend(links[some].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "links"])


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Null, empty and zero vectors, and those with null or non-finite components,
    are linked with nothing; so are rows with a null id, whose component is null
    and which are kept. Vectors of different lengths are never linked. Rows are
    counted as they come: rows that repeat an id are vectors of their own.
    """
    value = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = staged(
        table.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, value).alias("vector")).select(
            "*", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("fp1"), F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), "vector")).alias("fp2")
        ),
        "vectors",
    )
    digests = ["fp1", "fp2"]
    classes = staged(
        rows.where("fp1 is not null").groupBy(*digests).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.min("vector").alias("vector")),
        "classes",
    )
    bits, passes = plan(classes.count())
    entries = staged(sorted_keys(classes, passes), "entries")
    found = staged(window_links(entries, bits), "windows")
    released(table.sparkSession)
    near = found.where("a is not null").select("a", "b")
    clusters = components(near.unionByName(border_links(found)).unionByName(dense_links(entries, found, bits)))
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK).alias("blocks"))
    members = clusters.withColumnRenamed("node", "rep").join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    keys = ["root", "low", "high"]
    dealt = block_pairs(members.withColumnRenamed("own", "mine"), "root", "blocks").withColumnRenamed("mine", "own").join(classes.select("rep", "rows", "vector"), "rep")
    checked = staged(
        dealt.repartition(*keys).sortWithinPartitions(*keys, "rep").select(*keys, "rep", "own", "rows", "vector").mapInArrow(_verified, "a long, b long, links long"),
        "verified",
    )
    roots = components(checked.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    counts = checked.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    of_class = classes.select(*digests, "rep", "rows").join(counts, "rep", "left").join(roots, "rep", "left")
    of_class = of_class.select(*digests, (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    placed = rows.select("vec_id", *digests).join(of_class, digests, "left")
    component = F.coalesce("root", "vec_id")
    return placed.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
