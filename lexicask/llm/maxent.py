"""Scoring texts by a hashed maximum-entropy language model with a class-factored softmax.

A word is a run of non-white characters, A-Z lower-cased, and each text ends in one end token. A word's class is given by its first
two bytes and its subclass by its first four, which history can tell (spelling goes by language and kind of word); ten bits of a
word's hash hold both. The model is

    P(word | history) = P(class | history) * P(subclass | class, history) * P(word | class, subclass)

The first two are softmaxes over sums of weights of hashed features: the word before, the word before that (skip), the bigram of
both, and a bias that holds the class's share of the training tokens. The third is the word's add-one share of its subclass.

1. Texts are read once into chunks of about CHUNK bytes: the chunk's distinct word hashes, and its tokens as places among them.
2. Exact training counts of all words: each chunk deals its distinct words to ranges of the hash; a range adds its words up and
   sends every chunk the totals of its own words. So no task and no table that is sent around holds the vocabulary, and what is
   gathered grows with the corpus.
3. Distributed gradient updates: in each round every chunk starts from the same weights and the same AdaGrad sums, takes steps over
   the training positions of its turn (each `TURNS`th; every position has a turn), and returns its change; changes are averaged by
   the positions behind them, in two levels of tasks, and the sums that are carried on make later steps smaller.
4. Every token is scored in sparse numpy batches.

A text is held out if crc32 of its doc_id as text has the remainder 2 modulo 7 (null doc_id: the empty text). Defined results: a
null or empty text is the end token alone; repeated rows are separate texts; a text longer than a chunk is a chunk by itself; an
empty table gives no row; without training texts all words are unseen. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicask.llm.common import FIRST, mixed, shared_dir, slices, store, table, words_and_heads

CHUNK = 4 << 20
CLASSES = 32  # and subclasses of each
BUCKETS = CLASSES * CLASSES
FEATURES = 1 << 15
#: Each turn takes another share of the training positions; all turns run, so every position is learnt from once.
TURNS, RATE = 2, 0.3
ROUNDS = TURNS
#: Positions of one gradient step.
STEP_SIZE = 2048
#: Parts in which a change of the weights is added up.
BLOCKS = 16
#: Tokens of one numpy batch.
BATCH = 8192
END = np.uint64(0x5EED0F7E87A11EAD)
STEP = np.uint64(0x9E3779B97F4A7C15)
CHUNKS = "chunk long, doc_ids array<long>, lengths array<long>, held array<boolean>, hashes binary, counts binary, tokens binary"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def chunks(docs: DataFrame, most: int = CHUNK) -> DataFrame:
    """Rows of CHUNKS, of about `most` bytes of text; counts are of the training texts of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 32, 0
        schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("hashes", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())])
        ids, lengths, words, size = [], [], [], 0

        def close():
            held = [held_out(x) for x in ids]
            n = np.array(lengths)
            unique, place = np.unique(np.concatenate(words), return_inverse=True)
            trained = place[np.repeat(~np.array(held), n)]
            counts = np.bincount(trained, minlength=len(unique)).astype(np.int32)
            row = {"chunk": base + seq, "doc_ids": ids, "lengths": lengths, "held": held, "hashes": unique.tobytes(), "counts": counts.tobytes(), "tokens": place.astype(np.uint32).tobytes()}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for some in slices(batch, most=most):
                h, _, n, heads = words_and_heads(some.column("text"))
                h = named(h, heads)
                ids += some.column("doc_id").to_pylist()
                lengths += (n + 1).tolist()
                words.append(np.insert(h, np.cumsum(n), END))
                size += some.column("text").nbytes
                if size >= most:
                    yield close()
                    seq, ids, lengths, words, size = seq + 1, [], [], [], 0
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNKS)


def totals(read: DataFrame, ranges: int) -> DataFrame:
    """chunk, part, counts: the training counts of the chunk's words in each range of the hash; chunk null: tokens and distinct words of each bucket."""
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "hashes", "counts"))):
                h, c = np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int32)
                cuts = np.searchsorted(h, edges).tolist()
                parts = [(p, a, b) for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(h)])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(parts), pa.int64()), pa.array([p for p, _, _ in parts], pa.int64()), pa.array([h[a:b].tobytes() for _, a, b in parts], pa.binary()), pa.array([c[a:b].tobytes() for _, a, b in parts], pa.binary())],
                    names=["chunk", "part", "hashes", "counts"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("counts", pa.binary())])
        now, rows = None, []

        def close():
            hashes = [np.frombuffer(h, np.uint64) for _, h, _ in rows]
            unique, place = np.unique(np.concatenate(hashes), return_inverse=True)
            counts = np.concatenate([np.frombuffer(c, np.int32) for _, _, c in rows])
            total = np.bincount(place, weights=counts, minlength=len(unique)).astype(np.int64)
            bucket = buckets_of(unique)
            sums = np.stack([np.bincount(bucket, weights=total, minlength=BUCKETS), np.bincount(bucket, weights=total > 0, minlength=BUCKETS)]).astype(np.int64)
            stops = np.cumsum([len(h) for h in hashes])
            own = [total[place[b - len(h) : b]].tobytes() for h, b in zip(hashes, stops.tolist())]
            return pa.RecordBatch.from_arrays([pa.array([*(c for c, _, _ in rows), None], pa.int64()), pa.array([now] * (len(rows) + 1), pa.int64()), pa.array([*own, sums.tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for chunk, part, h, c in zip(*(batch.column(x).to_pylist() for x in ("chunk", "part", "hashes", "counts"))):
                if rows and part != now:
                    yield close()
                    rows = []
                now = part
                rows.append((chunk, h, c))
        if rows:
            yield close()

    dealt = read.select("chunk", "hashes", "counts").mapInArrow(deal, "chunk long, part long, hashes binary, counts binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(add, "chunk long, part long, counts binary")


def named(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Words' hashes with the class and subclass of their first bytes in the lowest bits."""
    at = np.uint64(64 - (BUCKETS.bit_length() - 1) // 2)
    klass = (mixed((heads & FIRST[2]) + STEP) >> at) * np.uint64(CLASSES)
    return hashes & ~np.uint64(BUCKETS - 1) | klass | mixed((heads & FIRST[4]) * STEP + STEP) >> at


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    """Class and subclass of words, as class * CLASSES + subclass."""
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _added(rows: DataFrame, column: str, kind, length: int, tasks: int = 64) -> np.ndarray:
    """The sum of equally long arrays in a binary column: added in at most `tasks` tasks, then on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, kind)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, kind)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=[column])

    parts = rows.select(column).coalesce(tasks).mapInArrow(add, f"{column} binary").collect()
    return sum((np.frombuffer(x[0], kind) for x in parts), np.zeros(length, kind))


class Weights:
    """bias: shares of classes and of subclasses; first, second: rows of a feature's weights of the classes and subclasses."""

    def __init__(self, tokens: np.ndarray):
        n = tokens.reshape(CLASSES, CLASSES) + 1.0
        self.bias1 = np.log(n.sum(axis=1) / n.sum()).astype(np.float32)
        self.bias2 = np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)
        self.first = np.zeros((FEATURES, CLASSES), np.float32)
        self.second = np.zeros((FEATURES, CLASSES), np.float32)
        self.squares = np.full((2, FEATURES), 1e-1, np.float32)  # AdaGrad sums of both tables' rows, carried from round to round


def _features(words: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Hashes of the three features of each token. start: whether a token is the first of its text."""
    one = np.concatenate([[END], words[:-1]]) if len(words) else words
    one = np.where(start, END, one)
    two = np.concatenate([[END], one[:-1]]) if len(words) else words
    two = np.where(start, END, two)
    return [mixed(one + STEP), mixed(two ^ STEP), mixed(one * np.uint64(31) + two)]


def _rows(features: list[np.ndarray], at: np.ndarray, klass: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    low = np.uint64(FEATURES - 1)
    own = [f[at] for f in features]
    k = klass.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return [(f & low).astype(np.int64) for f in own], [(((f ^ k) * STEP) >> np.uint64(40) & low).astype(np.int64) for f in own]


def _exponents(table_: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Sums of the features' weights and the bias, less the largest of each row."""
    z = table_.take(rows[0], axis=0)
    for r in rows[1:]:
        z += table_.take(r, axis=0)
    z += bias
    most, width = z, CLASSES
    while width > 1:  # by halves: a maximum along so short a row is slow
        width //= 2
        most = np.maximum(most[:, :width], most[:, width:])
    z -= most
    return z


def _shares(table_: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Probabilities."""
    z = _exponents(table_, rows, bias)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _softmax(table_: np.ndarray, rows: list[np.ndarray], bias: np.ndarray, right: np.ndarray | None = None) -> np.ndarray:
    """Log-probabilities; with right, only that of the right class of each row."""
    z = _exponents(table_, rows, bias)
    own = z.copy() if right is None else z[np.arange(len(z)), right].astype(np.float64)
    below = np.log(np.exp(z, out=z).sum(axis=1))
    return own - (below[:, None] if right is None else below)


def _tokens(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, places, bucket of each token and whether it starts a text."""
    unique = np.frombuffer(row["hashes"], np.uint64)
    place = np.frombuffer(row["tokens"], np.uint32)
    lengths = np.array(row["lengths"], np.int64)
    start = np.zeros(len(place), bool)
    start[np.cumsum(lengths) - lengths] = True
    return unique[place], place, buckets_of(unique)[place], start


def _learn(row, weights: Weights, turn: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The change of both tables and of their AdaGrad sums after one pass over the training positions of this turn, and their number."""
    words, _, bucket, start = _tokens(row)
    features = _features(words, start)
    train = np.repeat(~np.array(row["held"], bool), row["lengths"])
    at = np.flatnonzero(train & (np.arange(len(words)) % TURNS == turn % TURNS))
    rng = np.random.default_rng(turn)
    rng.shuffle(at)
    tables, squares = [weights.first.copy(), weights.second.copy()], weights.squares.copy()
    for a in range(0, len(at), STEP_SIZE):
        some = at[a : a + STEP_SIZE]
        klass, sub = bucket[some] // CLASSES, bucket[some] % CLASSES
        both = _rows(features, some, klass)
        for table_, square, rows, bias, right in zip(tables, squares, both, (weights.bias1, weights.bias2[klass]), (klass, sub)):
            slope = _shares(table_, rows, bias)
            slope[np.arange(len(some)), right] -= 1
            every = np.concatenate(rows)
            order = np.argsort(every.astype(np.uint16), kind="stable")  # a radix sort: FEATURES is 2 ** 16 at most
            every, order = every[order], order % len(some)
            first = np.flatnonzero(np.diff(every, prepend=-1))
            often = np.diff(first, append=len(every)) > 1
            # most rows are met once in a step; only the slopes of the others have to be added up
            repeated = np.repeat(often, np.diff(first, append=len(every)))
            once, more = first[~often], np.flatnonzero(repeated)
            which = every[np.concatenate([once, first[often]])]
            slopes = np.empty((len(which), CLASSES), np.float32)
            np.take(slope, order[once], axis=0, out=slopes[: len(once)], mode="clip")
            if len(more):
                begins = np.flatnonzero(np.diff(every[more], prepend=-1))
                np.add.reduceat(slope.take(order[more], axis=0), begins, axis=0, out=slopes[len(once) :])
            square[which] += np.einsum("ij,ij->i", slopes, slopes) / CLASSES
            slopes *= (RATE / np.sqrt(square[which]))[:, None]
            table_[which] = np.subtract(table_.take(which, axis=0), slopes, out=slopes)
    return np.stack([tables[0] - weights.first, tables[1] - weights.second]), squares - weights.squares, len(at)


def train(read: DataFrame, tokens: np.ndarray) -> Weights:
    """Weights after ROUNDS of averaged local updates over all chunks."""
    spark, weights = read.sparkSession, Weights(tokens)
    size = 2 * FEATURES * CLASSES
    cuts = [(size + 2 * FEATURES) * k // BLOCKS for k in range(BLOCKS + 1)]
    groups = max(1, round(read.rdd.getNumPartitions() ** 0.5))
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(weights)  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total, positions = np.zeros(size + 2 * FEATURES, np.float32), 0
            for batch in batches:
                for k in range(batch.num_rows):
                    change, squares, n = _learn({c: batch.column(c)[k].as_py() for c in batch.schema.names}, sent.value, turn)
                    total[:size] += change.reshape(-1) * n
                    total[size:] += squares.reshape(-1) * n
                    positions += n
            if positions:
                mean = np.clip(total / positions, -60000, 60000).astype(np.float16)
                rows = [pa.array(range(BLOCKS), pa.int64()), pa.array([TaskContext.get().partitionId() % groups] * BLOCKS, pa.int64()), pa.array([positions] * BLOCKS, pa.int64()), pa.array([mean[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names=["k", "g", "n", "x"])

        change, positions = _averaged(read.select("lengths", "held", "hashes", "tokens").mapInArrow(run, "k long, g long, n long, x binary"), cuts)
        if positions:
            tables = change[:size].reshape(2, FEATURES, CLASSES)
            weights.first += tables[0]
            weights.second += tables[1]
            weights.squares += change[size:].reshape(2, FEATURES)
    return weights


def _averaged(parts: DataFrame, cuts: list[int]) -> tuple[np.ndarray, int]:
    """The mean of the tasks' arrays by their positions n, and all positions. Arrays come cut into blocks (k, g, n, x): a block is averaged in groups of tasks first, then the groups."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            for k, g, n, x in zip(*(batch.column(c).to_pylist() for c in ("k", "g", "n", "x"))):
                before, total = sums.get((k, g), (0, 0.0))
                sums[k, g] = before + n, total + np.frombuffer(x, np.float16 if len(x) == 2 * (cuts[k + 1] - cuts[k]) else np.float32).astype(np.float64) * n
        rows = [(k, 0, n, (x / n).astype(np.float32).tobytes()) for (k, _), (n, x) in sums.items()]
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["k", "g", "n", "x"])

    kind = "k long, g long, n long, x binary"
    change, positions = np.zeros(cuts[-1], np.float32), 0
    for k, _, n, x in parts.repartition("k", "g").mapInArrow(add, kind).repartition("k").mapInArrow(add, kind).collect():  # one model
        change[cuts[k] : cuts[k + 1]], positions = np.frombuffer(x, np.float32), n
    return change, positions


def scores(docs: DataFrame, work: str | None = None, most: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    spark = docs.sparkSession
    work = work or shared_dir(spark)
    read = store(chunks(docs, most), f"{work}/chunks", "zstd")
    found = store(totals(read, max(16, int(16 * read.count() ** 0.5))), f"{work}/totals")
    sums = _added(found.filter("chunk IS NULL"), "counts", np.int64, 2 * BUCKETS).reshape(2, BUCKETS)
    n, v = int(sums[0].sum()), int(sums[1].sum())
    sent = spark.sparkContext.broadcast(train(read, sums[0]))
    below = np.log10(sums[0] + sums[1] + 1.0)
    base_below = float(np.log10(n + v + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, ln10 = sent.value, np.log(10.0)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                counts = np.concatenate([np.frombuffer(x["counts"], np.int64) for x in row["own"]])
                words, place, bucket, start = _tokens(row)
                c = counts[place]
                up = np.log10(counts + 1.0)[place]
                value = up - below[bucket]
                features = _features(words, start)
                for a in range(0, len(words), BATCH):
                    at = np.arange(a, min(a + BATCH, len(words)))
                    klass, sub = bucket[at] // CLASSES, bucket[at] % CLASSES
                    rows1, rows2 = _rows(features, at, klass)
                    value[at] += (_softmax(weights.first, rows1, weights.bias1, klass) + _softmax(weights.second, rows2, weights.bias2[klass], sub)) / ln10
                lengths = np.array(row["lengths"], np.int64)
                first = np.cumsum(lengths) - lengths
                add = lambda x, first=first: np.add.reduceat(x, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(lengths), n, np.int64)), pa.array(add(up) - lengths * base_below), pa.array(add(value))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    own = found.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "counts"))).alias("own"))
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return read.drop("counts").join(own, "chunk").select("doc_ids", "lengths", "held", "hashes", "tokens", "own").mapInArrow(run, kind)


def op8_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
