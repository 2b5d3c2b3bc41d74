"""Near-duplicate embeddings by iterative quantisation.

1. Equal vectors of a label are one class (its smallest id, its size); vectors that cannot be compared stay alone.
2. For each length of vectors a rotation is learnt by iterative quantisation on what a bounded sample of the classes has of that
   length: it turns the centred principal axes so that signs lose least, which gives balanced binary codes. A length of which the
   sample has fewer vectors than bits, or that lies in a narrow cone (see CONE), gets a random rotation, whose codes are less
   balanced but meet as well.
3. Multi-index Hamming tables: the code's `PARTS` substrings are taken `PICK` at a time, a table each. Two codes meet in a table
   if they agree in its substrings, so every pair within a Hamming distance of PARTS - PICK meets, and most pairs beyond.
4. Candidates of a table's bucket are compared by the original vectors in double precision. A pair counts in the first table
   where it meets, and nowhere else. Buckets beyond `BLOCK` classes are cut into blocks and each pair of blocks is one group, so
   a bucket of any size is dealt to many tasks and all its pairs are compared; what leaves a task is a count and one link for a
   class, not the pairs.
5. Links of tasks are joined to components.

Labels that differ or are null never link, nor do vectors of different lengths. Null, empty and zero vectors and those with null or
non-finite components link with nothing. Repeated vec_ids are separate vectors of one id: they are
returned once each, and their links are counted alike. An empty table gives no row. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicask.llm.common import shared_dir, store, table
from lexicask.llm.components import components

BITS, PARTS, PICK = 64, 8, 2
#: Vectors that the rotation is fitted on, at most.
SAMPLE = 20_000
#: Variance of unit vectors around their mean below which codes are taken about the origin by a random rotation: in so narrow a cone
#: vectors that are close to each other can lie on opposite sides of the mean.
CONE = 0.36
#: Classes of a bucket that one group compares, at most.
BLOCK = 1024
TABLES = list(combinations(range(PARTS), PICK))


def fit(sample: np.ndarray, bits: int = BITS, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) of iterative quantisation over rows of unit vectors."""
    d = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
    centred = sample - mean
    rng = np.random.default_rng(5)
    if len(sample) < bits or 1 - mean @ mean < CONE:
        return np.zeros(d), np.linalg.qr(rng.standard_normal((max(d, bits), max(d, bits))))[0][:d, :bits]
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, : min(bits, d)]
    if axes.shape[1] < bits:  # fewer dimensions than bits: further directions are random ones of the same space
        axes = np.concatenate([axes, np.linalg.qr(rng.standard_normal((d, d)))[0][:, rng.integers(0, d, bits - axes.shape[1])]], axis=1)
    flat = centred @ axes
    turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = (u @ vt).T
    return mean, axes @ turn


def codes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """PARTS bytes of each unit vector's code."""
    return np.packbits((vectors - mean) @ projection >= 0, axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray, d: int | None = None) -> np.ndarray:
    """Lists of numbers as rows; shorter lists end in zeros. d: the length of all lists, where it is known."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten(), dtype=np.float64)
    if d is None:
        sizes = np.diff(column.offsets.to_numpy())
        d = int(sizes.max(initial=1))
        if (sizes != d).any():
            out = np.zeros((len(sizes), d))
            out[np.arange(d)[None, :] < sizes[:, None]] = values
            return out
    return values.reshape(-1, d)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component of the links a - b over nodes 0 .. n - 1."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def classes(vectors: DataFrame) -> DataFrame:
    """rep (smallest vec_id), size, label and embedding of each set of equal vectors of a label that can be compared."""
    e = F.col("embedding").cast("array<double>")
    sound = F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    own = vectors.select(F.col("vec_id").cast("long"), F.col("label"), e.alias("embedding")).filter(F.col("label").isNotNull() & sound & F.col("vec_id").isNotNull())
    return own.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))


def near_duplicates(vectors: DataFrame, least: float = 0.98, bits: int = BITS, sample: int = SAMPLE, work: str | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors."""
    spark = vectors.sparkSession
    work = work or shared_dir(spark)
    unique = store(classes(vectors), f"{work}/classes")
    rows = unique.select("embedding", F.xxhash64("rep").alias("_o")).orderBy("_o").limit(sample).select("embedding").toPandas()["embedding"].tolist()  # bounded by `sample`
    models: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in sorted({len(x) for x in rows}):
        known = np.array([x for x in rows if len(x) == d], dtype=np.float64).reshape(-1, d)
        with np.errstate(over="ignore", under="ignore"):
            known = known / np.abs(known).max(axis=1, keepdims=True)
            known /= np.linalg.norm(known, axis=1, keepdims=True)
        models[d] = fit(known, bits)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column("embedding")))
            for d in np.unique(sizes).tolist():
                if d not in models:
                    models[d] = fit(np.zeros((0, d)), bits)
                mean, projection = models[d]
                same = batch.filter(pa.array(sizes == d))
                for a in range(0, same.num_rows, 2048):
                    some = same.slice(a, 2048)
                    v = _matrix(some.column("embedding"), d)
                    v = v / np.abs(v).max(axis=1, keepdims=True)
                    v /= np.linalg.norm(v, axis=1, keepdims=True)
                    unit = pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), d).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([some.column("rep"), some.column("size"), some.column("label"), unit, pa.array([x.tobytes() for x in codes(v, mean, projection)], pa.binary())], names=["rep", "size", "label", "unit", "code"])

    # the length is a part of the label from here on
    named = F.concat_ws("/", F.size("embedding"), F.col("label").cast("string")).alias("label")
    own = unique.select("rep", "size", named, "embedding")
    index = own.mapInArrow(coded, "rep long, size long, label string, unit array<double>, code binary")
    index = store(index, f"{work}/index")
    pieces = F.array(*[F.struct(F.lit(t).alias("t"), F.concat(*[F.substring("code", p + 1, 1) for p in parts]).alias("key")) for t, parts in enumerate(TABLES)])
    buckets = index.select("rep", "label", "code", F.explode(pieces).alias("x")).select("rep", "label", "x.t", "x.key")
    # a bucket's blocks: sizes are counted without the vectors; only buckets of two or more go on
    counted = buckets.groupBy("label", "t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = counted.filter(F.col("n") > BLOCK).select("label", "t", "key", F.expr(f"CAST((n + {BLOCK} - 1) div {BLOCK} AS INT)").alias("blocks"))
    few = counted.filter(F.col("n") <= BLOCK).select("label", "t", "key", F.lit(1).alias("blocks"))
    met = buckets.join(few.unionAll(crowded), ["label", "t", "key"])
    block = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("b")).alias("i"), F.greatest(o, F.col("b")).alias("j")))
    dealt = met.withColumn("b", block).select("rep", "t", F.xxhash64("label", "t", "key").alias("h"), "b", F.explode(pairs).alias("g")).select("rep", "t", "h", "b", "g.i", "g.j")
    full = dealt.join(index, "rep")
    grouped = full.repartition("h", "i", "j").sortWithinPartitions("h", "t", "i", "j", "b", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        links: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[pa.RecordBatch] = []

        def settle():
            """The counts and links so far; a class and its smallest linked neighbour of these groups for each."""
            ids = np.fromiter(counts, np.int64, len(counts))
            n = np.fromiter(counts.values(), np.int64, len(counts))
            if not len(ids):
                return None
            a = np.concatenate([x for x, _ in links])
            b = np.concatenate([y for _, y in links])
            order = np.sort(ids)
            root = _roots(len(order), np.searchsorted(order, a), np.searchsorted(order, b))
            out = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(order[root[np.searchsorted(order, ids)]])], names=["rep", "n", "root"])
            counts.clear()
            links.clear()
            return out

        def run(t):
            rep, size = t.column("rep").to_numpy(), t.column("size").to_numpy()
            unit = _matrix(t.column("unit"))
            code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(rep), -1)
            b, i, j, first = (t.column(c).to_numpy() for c in ("b", "i", "j", "t"))
            same = np.zeros(len(rep), np.int64)  # group number
            label = np.unique(np.array(t.column("label").to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
            keys = np.stack([t.column("h").to_numpy(), first, i, j, label], axis=1)
            same[1:] = np.cumsum((keys[1:] != keys[:-1]).any(axis=1))
            bounds = np.flatnonzero(np.diff(same, prepend=-1))
            sizes = np.diff(np.append(bounds, len(rep)))
            small = np.repeat(sizes <= 32, sizes)
            step = 1
            while True:  # small groups of all the rows together: each row with the one `step` after it
                x = np.flatnonzero((same[:-step] == same[step:]) & small[:-step]) if step < len(rep) else np.zeros(0, int)
                if not len(x):
                    break
                found(rep, size, code, first, b, i, j, x, x + step, np.einsum("ij,ij->i", unit[x], unit[x + step]))
                step += 1
            for start, n in zip(bounds[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
                for a in range(start, start + n, 512):
                    z = min(a + 512, start + n)
                    dots = unit[a:z] @ unit[a : start + n].T
                    x, y = np.nonzero(dots >= least - 1e-9)
                    keep = y > x
                    x, y = x[keep] + a, y[keep] + a
                    found(rep, size, code, first, b, i, j, x, y, np.einsum("ij,ij->i", unit[x], unit[y]))

        def found(rep, size, code, first, b, i, j, x, y, cosine):
            good = cosine >= least
            good &= (i[x] == j[x]) | (b[x] != b[y])  # within a block only in its own group
            x, y = x[good], y[good]
            if not len(x):
                return
            equal = code[x] == code[y]
            at = np.full(len(x), len(TABLES))
            for k in range(len(TABLES) - 1, -1, -1):
                at[equal[:, list(TABLES[k])].all(axis=1)] = k
            good = at == first[x]
            x, y = x[good], y[good]
            for p, q in ((x, y), (y, x)):
                ids, which = np.unique(rep[p], return_inverse=True)
                for one, n in zip(ids.tolist(), np.bincount(which, weights=size[q]).astype(np.int64).tolist()):
                    counts[one] = counts.get(one, 0) + n
            links.append((rep[x], rep[y]))

        for batch in batches:
            # groups end with a change of (h, t, i, j); the last one waits for the next batch
            held.append(batch)
            if sum(x.num_rows for x in held) < 8192:
                continue
            t = pa.Table.from_batches(held)
            keys = np.stack([t.column(c).to_numpy() for c in ("h", "t", "i", "j")], axis=1)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if len(change):
                run(t.slice(0, int(change[-1]) + 1))
                held = t.slice(int(change[-1]) + 1).to_batches()
            if sum(len(x) for x, _ in links) > 2_000_000:
                yield settle()
        if held:
            run(pa.Table.from_batches(held))
        if (out := settle()) is not None:
            yield out

    linked = store(grouped.mapInArrow(compare, "rep long, n long, root long"), f"{work}/linked")
    counts = linked.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")), f"{work}/components")
    summary = unique.join(counts, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    summary = summary.select("label", "embedding", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    back = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    joined = back.join(summary, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
