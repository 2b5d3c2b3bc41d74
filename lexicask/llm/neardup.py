"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

Words are runs of non-white characters, A-Z lower-cased; a shingle is five consecutive words (a shorter text is one shingle). Its
weight in a text is its count there times its inverse document frequency, the mean of ln(1 + texts / texts with the word) over its
words. Word document frequencies cover all texts and are counted in a hashed table of fixed size, so the table that every task
receives does not grow; words that share a cell count as one. Two texts are similar by the weighted Jaccard similarity
sum of min weights / sum of max weights.

1. Texts with equal words form one exact class; only its smallest doc_id goes on.
2. `SAMPLES` consistent weighted samples of each text, in bands of `ROWS`: texts that share a band meet.
3. Buckets up to `FEW` texts give all their pairs; in a larger one each text meets a centre that differs from bucket to bucket.
   Pairs whose samples agree too rarely to be similar (see SCREEN) go, and one pair for each text, the one that agrees most, is
   verified on the texts. What is linked so far is one class.
4. Texts of larger buckets are also joined by prefixes, which misses no pair: a text's shingles in one order of all, the rare ones
   first, up to where the rest weighs less than `SIMILAR` of the whole. Two similar texts share a shingle of both prefixes, and at
   the first one they share, what both have left must hold all that they have in common: pairs that have not enough left go, which
   is nearly all pairs that share a passage and little else. A prefix shingle of more than `FEW` texts is cut into blocks of
   `BLOCK` texts, and every pair of blocks compares its texts of different classes (of the links verified so far) by what they
   have left and by `LONG` further samples.
5. Of all pairs of both ways whose texts are not yet in one class, in `ROUNDS` rounds each text verifies the one that agrees most, which
   joins most of a large group by few pairs; then every pair that is still between classes is verified.
6. Verified links are joined to classes, each step's on the classes of the steps before; a class is named by its smallest doc_id.

Defined results: null texts and texts without words are similar to nothing; rows of one doc_id are one
document, kept or dropped together, which is similar to whatever any of its texts is similar to; null doc_ids are left out of the comparison and kept; an empty table gives no row. Only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicask.llm.common import discard, mixed, shared_dir, slices, store, table, words_of
from lexicask.llm.components import components, components_of_few

SHINGLE, SIMILAR = 5, 0.8
SAMPLES, ROWS = 30, 3
BANDS = SAMPLES // ROWS
#: Cells of the table of word document frequencies.
CELLS = 1 << 18
FEW = 24
#: Cells of the table of shingle counts that orders shingles, and texts of a block of a crowded prefix shingle.
ORDER_CELLS, BLOCK = 1 << 20, 512
#: Samples that must agree for a pair to be verified: of 30 at similarity 0.8, fewer than 15 agree once in 10,000 pairs.
SCREEN = 15
#: Samples (of 8 bits) of the texts of larger buckets, and how many must agree: at 0.8 fewer do once in 10,000 pairs.
LONG, LONG_SCREEN = 128, 85
#: Rounds in which each text tries its best pair with another class, before all pairs between classes are tried.
ROUNDS = 2
#: Documents that are hashed together.
GROUP = 512
STEP = np.uint64(0x9E3779B97F4A7C15)


def word_cells(column: pa.Array) -> np.ndarray:
    """Texts of a batch that have a word in each cell."""
    h, row, n = words_of(column)
    cell = (h >> np.uint64(40)) & np.uint64(CELLS - 1)
    pairs = np.unique(row.astype(np.uint64) * np.uint64(CELLS) + cell)
    return np.bincount((pairs & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)


def document_frequencies(docs: DataFrame, cells_of=word_cells, size: int = CELLS) -> tuple[int, np.ndarray]:
    """Texts, and texts with a word in each cell: partial tables are added by cell block on the executors."""
    width = 4096

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for some in slices(batch, GROUP):
                cells += cells_of(some.column("text"))
                n += some.num_rows
        if n:
            blocks = [cells[k : k + width].tobytes() for k in range(0, size, width)] + [np.array([n], np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int64()), pa.array(blocks, pa.binary())], names=["k", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(part, np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["k", "part"])

    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "k long, part binary")
    rows = partial.repartition("k").mapInArrow(add, "k long, part binary").collect()  # `size` numbers, whatever the input
    cells = np.zeros(size, np.int64)
    total = 0
    for k, part in rows:
        part = np.frombuffer(part, np.int64)
        if k * width < size:
            cells[k * width : k * width + width] = part
        else:
            total = int(part[0])
    return total, cells


def idf_table(total: int, cells: np.ndarray) -> np.ndarray:
    return np.log1p(total / np.maximum(cells, 1)).astype(np.float32)


def shingles(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: distinct shingles (hash, weight) in the order of the hashes, how many, and two hashes of its words (0 words: 0)."""
    h, row, n = words_of(column)
    w = idf[((h >> np.uint64(40)) & np.uint64(CELLS - 1)).astype(np.int64)] if len(h) else np.zeros(0, np.float32)
    first = np.cumsum(n) - n
    place = np.arange(len(h)) - first[row] if len(h) else np.zeros(0, np.int64)
    size = np.minimum(SHINGLE, n)
    begin = place <= (n - size)[row] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(begin)
    long = np.pad(h, (0, SHINGLE))
    value, weight = np.zeros(len(at), np.uint64), np.zeros(len(at), np.float64)
    wide = np.pad(w, (0, SHINGLE))
    of = size[row[at]] if len(at) else np.zeros(0, np.int64)
    for k in range(SHINGLE):
        inside = k < of
        value = np.where(inside, mixed(value * STEP + long[at + k] + np.uint64(k + 1)), value)
        weight += np.where(inside, wide[at + k], 0)
    weight /= np.maximum(of, 1)
    r = row[at] if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((value, r))
    r, value, weight = r[order], value[order], weight[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (value[1:] != value[:-1])
    start = np.flatnonzero(new)
    tf = np.diff(np.append(start, len(r)))
    some = np.flatnonzero(n)
    whole = np.zeros((2, len(n)), np.uint64)
    if len(some):
        odd = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * STEP
        whole[0, some] = np.add.reduceat(mixed(h ^ odd), first[some]) | np.uint64(1)
        whole[1, some] = np.add.reduceat(mixed(h + odd), first[some]) | np.uint64(1)
    return value[start], weight[start] * tf, np.bincount(r[start], minlength=len(n)).astype(np.int64), whole[0], whole[1]


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) and its logarithm, in an order that does not matter: r, 1 / r and ln c by 16 bits."""
    rng = np.random.default_rng(11)
    r, c = rng.gamma(2.0, 1.0, 1 << 16), rng.gamma(2.0, 1.0, 1 << 16)
    return r, 1 / r, np.log(c)


_TABLES: list[np.ndarray] = []


def samples(value: np.ndarray, weight: np.ndarray, count: np.ndarray, number: int = SAMPLES) -> np.ndarray:
    """`number` consistent weighted samples (unsigned 32-bit) of each text that has shingles, in rows."""
    if not _TABLES:
        _TABLES.extend(_draws())
    R, RI, LC = _TABLES
    some = np.flatnonzero(count)
    sizes = count[some]
    start = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(some)), sizes)
    out = np.zeros((len(some), number), np.uint32)
    if not len(some):
        return out
    ln = np.log(weight)
    low = np.uint64(0xFFFF)
    for k in range(number):
        x = mixed(value + np.uint64((k + 1) * int(STEP) % (1 << 64)))
        i = (x & low).astype(np.int64)
        beta = (x >> np.uint64(32)) * (1.0 / (1 << 32))
        t = np.floor(ln * RI[i] + beta)
        a = LC[((x >> np.uint64(16)) & low).astype(np.int64)] - R[i] * (t - beta + 1)
        least = np.minimum.reduceat(a, start)
        hit = np.flatnonzero(a == np.repeat(least, sizes))
        hit = hit[np.searchsorted(row[hit], np.arange(len(some)))]
        out[:, k] = (mixed(value[hit] + t[hit].astype(np.int64).astype(np.uint64) * STEP) >> np.uint64(32)).astype(np.uint32)
    return out


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, h1 and h2 (hashes of the words), sig (SAMPLES ints) and bands (BANDS longs) of each text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, GROUP):
                value, weight, count, h1, h2 = shingles(some.column("text"), idf)
                sig = samples(value, weight, count)
                keep = np.flatnonzero(count)
                bands = np.zeros((len(keep), BANDS), np.uint64)
                for b in range(BANDS):
                    key = np.full(len(keep), b + 1, np.uint64)
                    for k in range(b * ROWS, b * ROWS + ROWS):
                        key = mixed(key * STEP + sig[:, k])
                    bands[:, b] = key
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]) for x in (sig.view(np.int32), bands.view(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(keep)), pa.array(h1[keep].view(np.int64)), pa.array(h2[keep].view(np.int64)), lists[0].cast(pa.list_(pa.int32())), lists[1].cast(pa.list_(pa.int64()))],
                    names=["doc_id", "h1", "h2", "sig", "bands"],
                )

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    return own.mapInArrow(run, "doc_id long, h1 long, h2 long, sig array<int>, bands array<long>")


def long_signatures(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """rep and sig, LONG samples of 8 bits, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, GROUP):
                value, weight, count, _, _ = shingles(some.column("text"), idf)
                sig = (samples(value, weight, count, LONG) & np.uint32(0xFF)).astype(np.uint8).view(np.int8)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(sig.reshape(-1)), LONG).cast(pa.list_(pa.int8()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(np.flatnonzero(count))), lists], names=["rep", "sig"])

    return texts.select("doc_id", "text").mapInArrow(run, "rep long, sig array<tinyint>")


def _pairs(buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pairs of small buckets (key, rep, ...), and the rows of larger ones with the bucket's centre."""
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min_by("rep", F.xxhash64("rep", "key")).alias("centre")).filter("n > 1")
    met = buckets.join(sizes, "key")
    lists = met.filter(F.col("n") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("m"))
    inner = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    small = lists.select(F.explode(inner).alias("p")).select("p.a", "p.b")
    return small, met.filter(F.col("n") > FEW)


def agreeing(x: F.Column, y: F.Column) -> F.Column:
    """How many samples of two texts agree."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda n, p: n + p)


def candidates(reps: DataFrame, work: str) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b of rep that meet, and the texts (rep) of buckets that were too large to give all theirs. reps: rep, sig, bands."""
    level = reps.select("rep", F.explode("bands").alias("key"))
    small, large = _pairs(level)
    large = store(large.select("rep", "centre"), f"{work}/large")
    stars = large.filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
    return small.unionAll(stars).distinct(), large.select("rep").distinct()


def prefixes(texts: DataFrame, idf: np.ndarray, similar: float) -> DataFrame:
    """rep and key, a hash of each shingle of the text's prefix, with what the text weighs (whole) and what its shingles from this one on weigh (rest)."""

    def cells_of(column: pa.Array) -> np.ndarray:
        value = shingles(column, idf)[0]
        return np.bincount((value >> np.uint64(44)).astype(np.int64), minlength=ORDER_CELLS)

    # the order only has to be one and the same for all texts: shingles of one cell count together, and their hashes decide
    seen = document_frequencies(texts, cells_of, ORDER_CELLS)[1].astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, GROUP):
                value, weight, count, _, _ = shingles(some.column("text"), idf)
                row = np.repeat(np.arange(some.num_rows), count)
                order = np.lexsort((value, seen[(value >> np.uint64(44)).astype(np.int64)], row))
                weight = weight[order]
                upto = np.cumsum(weight)
                whole = np.bincount(row, weights=weight, minlength=some.num_rows)
                before = upto - weight - (np.cumsum(whole) - whole)[row]
                # a shingle is in if what begins with it could still be enough by itself
                keep = np.flatnonzero(whole[row] - before >= (similar - 1e-6) * whole[row])
                rest = whole[row] - before
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(row[keep])), pa.array(value[order][keep].view(np.int64)), pa.array(whole[row[keep]]), pa.array(rest[keep])], names=["rep", "key", "whole", "rest"])

    return texts.select("doc_id", "text").mapInArrow(run, "rep long, key long, whole double, rest double")


def crowded_pairs(met: DataFrame, similar: float, every: bool) -> DataFrame:
    """Pairs a < b, with the samples that agree and both classes, of texts of different classes that share a prefix shingle from which on both have enough left and whose samples agree often enough.

    met: rep, key, whole, rest, sig, class and n (texts of the key). Not every: of each text and key, or pair of blocks, the pair that agrees most.
    """
    share = similar / (1 + similar) - 1e-6  # of both weights together, what similar texts have in common
    lists = met.filter(F.col("n") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "class", "whole", "rest", "sig"))).alias("m"))
    enough = lambda a, b: (b["rep"] > a["rep"]) & (a["class"] != b["class"]) & (F.least(a["rest"], b["rest"]) >= share * (a["whole"] + b["whole"]))
    pair = lambda a, b: F.struct(agreeing(a["sig"], b["sig"]).alias("agree"), a["rep"].alias("a"), b["rep"].alias("b"), a["class"].alias("ca"), b["class"].alias("cb"))
    of_one = lambda a: F.filter(F.transform(F.filter("m", lambda b: enough(a, b)), lambda b: pair(a, b)), lambda p: p["agree"] >= LONG_SCREEN)
    if every:
        inner = F.flatten(F.transform("m", of_one))
    else:
        inner = F.filter(F.transform("m", lambda a: F.array_max(of_one(a))), lambda p: p.isNotNull())
    columns = ["a", "b", "agree", "ca", "cb"]
    small = lists.select(F.explode(inner).alias("p")).select("p.*").select(columns)
    blocks = F.expr(f"CAST((n + {BLOCK} - 1) div {BLOCK} AS INT)")
    own = met.filter(F.col("n") > FEW).withColumn("blocks", blocks).withColumn("at", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    meetings = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("at")).alias("i"), F.greatest(o, F.col("at")).alias("j")))
    given = ["key", "rep", "class", "whole", "rest", "sig", "at"]
    dealt = own.select(*given, F.explode(meetings).alias("g")).select(*given, "g.i", "g.j")

    def compare(group: pa.Table) -> pa.Table:
        rep, kind, at, whole, rest = (group.column(c).to_numpy() for c in ("rep", "class", "at", "whole", "rest"))
        sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, LONG)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for k in range(0, len(left), BLOCK):
            some = left[k : k + BLOCK]
            x, y = np.nonzero(np.minimum(rest[some][:, None], rest[right]) >= share * (whole[some][:, None] + whole[right]))
            x, y = some[x], right[y]
            good = (kind[x] != kind[y]) & ((rep[x] < rep[y]) | (i != j))
            x, y = x[good], y[good]
            agree = np.zeros(len(x), np.int32)
            for s in range(LONG):
                agree += sig[x, s] == sig[y, s]
            good = agree >= LONG_SCREEN
            x, y, agree = x[good], y[good], agree[good]
            if not every:  # the first of each text when those that agree most come first
                down = np.lexsort((y, x, -agree))
                take = np.union1d(np.unique(x[down], return_index=True)[1], np.unique(y[down], return_index=True)[1])
                x, y, agree = x[down][take], y[down][take], agree[down][take]
            found.append((x, y, agree))
        x, y, agree = (np.concatenate(z) for z in zip(*found))
        x, y = np.where(rep[x] < rep[y], x, y), np.where(rep[x] < rep[y], y, x)
        return pa.table({"a": rep[x], "b": rep[y], "agree": agree, "ca": kind[x], "cb": kind[y]})

    return small.unionAll(dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long, agree int, ca long, cb long")).distinct()


def meetings_of(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of keyed (rep, key, ...) whose key has texts of more than one class, with their class and the texts of the key (n)."""
    now = keyed.drop("class", "n").join(classes.withColumnRenamed("id", "rep"), "rep", "left").withColumn("class", F.coalesce("component", "rep")).drop("component")
    sizes = now.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("key", "n")
    return now.join(sizes, "key")


def apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs a, b, ... of texts of different classes, with both classes (ca, cb)."""
    of = lambda c: classes.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    found = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return found.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).filter("ca <> cb")


def merged(so_far: DataFrame, links: DataFrame, work: str) -> DataFrame:
    """so_far (id, component) after further links a, b, both stored: only the links between its classes are followed, if there are many."""
    few = components_of_few(links.select("a", "b").unionAll(so_far.select(F.col("id").alias("a"), F.col("component").alias("b"))), work)
    if few is not None:
        return few
    between = apart(links.select("a", "b"), so_far)
    joined = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")), f"{work}/rounds").withColumnRenamed("component", "into")
    old = so_far.join(joined.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("into", "component").alias("component"))
    new = joined.join(so_far.select("id"), "id", "left_anti").select("id", F.col("into").alias("component"))
    return store(old.unionAll(new), f"{work}/merged")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similar: float) -> DataFrame:
    """Pairs a, b with their similarity, where it reaches `similar`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column):
            value, weight, count, _, _ = shingles(column, idf)
            stop = np.cumsum(count)
            return [(value[s - c : s], weight[s - c : s]) for s, c in zip(stop.tolist(), count.tolist())]

        for batch in batches:
            for some in slices(batch, column="tb"):
                found = []
                for (va, wa), (vb, wb) in zip(sets(some.column("ta")), sets(some.column("tb")), strict=True):
                    i = np.searchsorted(vb, va)
                    i[i == len(vb)] = 0
                    both = vb[i] == va
                    least = np.minimum(wa[both], wb[i[both]]).sum()
                    found.append(least / (wa.sum() + wb.sum() - least))
                similarity = np.array(found)
                keep = pa.array(np.flatnonzero(similarity >= similar))
                yield pa.RecordBatch.from_arrays([some.column("a").take(keep), some.column("b").take(keep), pa.array(similarity).take(keep)], names=["a", "b", "similarity"])

    # both sides grow with the corpus, so neither is broadcast
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, similarity double")


def texts_of(pairs: DataFrame, crowd: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text and whether it is in crowd, of every document in a pair or in crowd: the one shuffle of all texts."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), F.lit(False).alias("crowded")).unionAll(crowd.select("rep", F.lit(True)))
    ids = ids.groupBy("doc_id").agg(F.max("crowded").alias("crowded"))
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return own.join(ids.hint("merge"), "doc_id")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, work: str | None = None) -> DataFrame:
    """doc_id and class_id (smallest doc_id of its class) of each doc_id whose text has words. All tables but the result's are deleted again."""
    spark = docs.sparkSession
    work = work or shared_dir(spark)
    steps = f"{work}/steps"
    idf = idf_table(*document_frequencies(docs))
    signed = store(signatures(docs, idf), f"{steps}/signed")
    reps = store(signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), f"{steps}/reps")
    met, crowd = candidates(reps.select("rep", "bands"), steps)
    a, b = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    pairs = store(met.join(a, "a").join(b, "b").select("a", "b", agreeing(F.col("sa"), F.col("sb")).alias("agree")).filter(F.col("agree") >= SCREEN), f"{steps}/pairs")
    texts = store(texts_of(pairs, crowd, docs), f"{steps}/texts")
    # one pair for each text first: the one that agrees most
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")).select("a", "b")
    links = store(verified(best, texts, idf, similar), f"{steps}/first")
    classes = components(links, f"{steps}/first_rounds")
    keyed = store(prefixes(texts.filter("crowded"), idf, similar), f"{steps}/prefixes")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    keyed = keyed.join(shared, "key").join(store(long_signatures(texts.filter("crowded"), idf), f"{steps}/long"), "rep")
    tried = best
    for k in range(ROUNDS + 1):
        every = k == ROUNDS
        keyed = store(meetings_of(keyed, classes), f"{steps}/keyed{k}")
        ways = ((apart(pairs, classes), SAMPLES), (crowded_pairs(keyed, similar, every), LONG))
        met, more = (way.select("a", "b", (F.col("agree") / n).alias("agree")) for way, n in ways)
        now = met.unionAll(more)
        if not every:  # of each text the pair that agrees most
            most = F.max_by(F.struct("a", "b"), F.struct("agree", "a", "b")).alias("p")
            now = now.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(most).select("p.a", "p.b").distinct()
        now = store(now.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), f"{steps}/{k}")
        links = store(verified(now, texts, idf, similar), f"{steps}/{k}_links")
        classes, tried = merged(classes, links, f"{steps}/{k}_step"), tried.unionAll(now)
    named = classes.withColumnRenamed("id", "rep")
    members = signed.select("doc_id", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"])
    found = members.join(named, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id")).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    found = store(found, f"{work}/members")
    discard(spark, steps)
    return found


def stage(docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, without those that are not the smallest doc_id of their class."""
    classes = near_duplicates(docs)
    dropped = classes.filter("doc_id <> class_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = near_duplicates(docs)
    joined = docs.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
