"""A stored index: immutable generations of sorted Parquet, and numbered manifests that make a commit visible at once.

    <path>/manifest/<version>.json   fields and features, buckets, generations, next free doc_id
    <path>/data/<generation>/postings | token_stats | doc_stats

A reader takes the newest manifest once and sees only its generations. A writer puts a new generation beside the old ones and
then creates the next manifest, which fails if another writer was first. Postings are range-sorted by (field, bucket, token,
doc_id), so a token that most documents hold is spread over files, and lookups prune by partition and by file statistics.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicask.functions.text import format_bytes
from lexicask.operators import build, lookup, search
from lexicask.schema import DOC_STATS, POSTINGS, TOKEN_STATS, Features


#: Statistics of one generation.
STORED_STATS = "field string, token string, doc_frequency long, term_frequency long, first_docid long"


class IndexRefused(ValueError):
    """A request that the index's manifest does not allow."""


@dataclass(frozen=True)
class Manifest:
    features: dict[str, int]
    buckets: int = 16
    generations: tuple[str, ...] = ()
    next_docid: int = 0
    n_docs: int = 0
    version: int = 0
    #: The last committed batch of each stream.
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(self.__dict__ | {"generations": list(self.generations)}, sort_keys=True)


class _Files:
    """The few file operations the manifest needs, by Hadoop's file system of the path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.Path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.Path(path))

    def delete(self, path: str) -> bool:
        return self.fs.delete(self.Path(path), True)

    def names(self, path: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.Path(path))] if self.exists(path) else []

    def sizes(self, path: str) -> list[tuple[str, int]]:
        if not self.exists(path):
            return []
        found, files = [], self.fs.listFiles(self.Path(path), True)
        while files.hasNext():
            x = files.next()
            found.append((x.getPath().toString(), x.getLen()))
        return found

    def read(self, path: str) -> str:
        stream = self.fs.open(self.Path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a whole file under a name that must be new: written aside, then renamed by a call that refuses to overwrite (in one step, where the file system can)."""
        part = self.Path(f"{path}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        keep = self.gateway.new_array(fs.Options.Rename, 0)
        try:
            fs.FileContext.getFileContext(part.makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toUri(), self.conf).rename(part, self.Path(path), keep)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            raise IndexRefused("another writer has committed meanwhile") from None
        finally:
            self.fs.delete(part, False)


class Index:
    """One set of fields over one space of doc_ids."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest
        self.files = _Files(spark, path)

    # -- catalog

    @classmethod
    def open(cls, spark: SparkSession, path: str, features: dict[str, Features] | None = None, buckets: int = 16) -> Index:
        """The index at path as it is now; a new one if there is none and features are given. Features must be those it was made with."""
        files, path = _Files(spark, path), path.rstrip("/")
        versions = [int(x[:-5]) for x in files.names(f"{path}/manifest") if x.endswith(".json")]
        if not versions:
            if features is None:
                raise IndexRefused(f"no index at {path}")
            manifest = Manifest({k: int(v) for k, v in features.items()}, buckets)
            files.create(f"{path}/manifest/{0:012d}.json", manifest.text())
            return cls(spark, path, manifest)
        raw = json.loads(files.read(f"{path}/manifest/{max(versions):012d}.json"))
        manifest = Manifest(**raw | {"generations": tuple(raw["generations"])})
        if features is not None and {k: int(v) for k, v in features.items()} != manifest.features:
            raise IndexRefused(f"the index has the features {manifest.features}")
        return cls(spark, path, manifest)

    def features(self, name: str) -> Features:
        if name not in self.manifest.features:
            raise IndexRefused(f"no field {name}")
        return Features(self.manifest.features[name])

    def _commit(self, manifest: Manifest) -> Index:
        manifest = replace(manifest, version=self.manifest.version + 1)
        self.files.create(f"{self.path}/manifest/{manifest.version:012d}.json", manifest.text())
        return Index(self.spark, self.path, manifest)

    # -- reading

    def _table(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/data/{g}/{name}").select(*empty.columns) for g in self.manifest.generations]
        return reduce(DataFrame.unionAll, parts) if parts else empty

    def _stored(self) -> DataFrame:
        return self._table("postings", POSTINGS + ", bucket int")

    def postings(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _of_tokens(self, *tokens: str) -> DataFrame:
        """Postings in the buckets of these tokens: the filter is a constant that prunes partitions."""
        buckets = [F.pmod(F.xxhash64(F.lit(t)), F.lit(self.manifest.buckets)).cast("int") for t in dict.fromkeys(tokens)]
        return self._stored().filter(F.col("bucket").isin(*buckets)).drop("bucket")

    def token_stats(self) -> DataFrame:
        """Statistics over all generations: each keeps its own sums."""
        deltas = self._table("token_stats", STORED_STATS)
        sums = deltas.groupBy("field", "token").agg(F.sum("doc_frequency").alias("doc_frequency"), F.sum("term_frequency").alias("term_frequency"), F.min("first_docid").alias("_first"))
        return build.with_single(sums)

    def doc_stats(self) -> DataFrame:
        return self._table("doc_stats", DOC_STATS)

    def blocks(self) -> DataFrame:
        return build.blocks(self.postings())

    def lookup(self, name: str, token: str, ordered: bool = False) -> DataFrame:
        return lookup.lookup(self._of_tokens(token), name, token, self.features(name), ordered)

    def seek(self, name: str, token: str, target: int) -> DataFrame:
        return self.lookup(name, token).filter(F.col("doc_id") >= target).orderBy("doc_id").limit(1)

    def seek_batch(self, targets: DataFrame) -> DataFrame:
        """As lookup.seek_batch. Only buckets of the targets' tokens are read: their numbers, at most `buckets`, are looked up first."""
        bucket = F.pmod(F.xxhash64("token"), F.lit(self.manifest.buckets)).cast("int")
        used = [r[0] for r in targets.select(bucket.alias("b")).distinct().collect()]
        return lookup.seek_batch(self._stored().filter(F.col("bucket").isin(used) if used else F.lit(False)).drop("bucket"), targets)

    # -- search: every query reads the buckets of its tokens only

    def bm25(self, name: str, tokens: list[str]) -> DataFrame:
        if not self.features(name).has_term_frequency:
            raise IndexRefused(f"{name} has no term frequencies")
        return search.bm25(self._of_tokens(*tokens), self.doc_stats(), self.manifest.n_docs, name, tokens)

    def phrase(self, name: str, tokens: list[str]) -> DataFrame:
        if not self.features(name).has_positions:
            raise IndexRefused(f"{name} has no positions")
        return search.phrase(self._of_tokens(*tokens), name, tokens)

    def any_of(self, name: str, tokens: list[str]) -> DataFrame:
        return search.any_of(self._of_tokens(*tokens), name, tokens)

    def all_of(self, name: str, tokens: list[str]) -> DataFrame:
        return search.all_of(self._of_tokens(*tokens), name, tokens)

    def boolean(self, docs: DataFrame, name: str, must: list[str] = (), should: list[str] = (), must_not: list[str] = ()) -> DataFrame:
        """docs: doc_id of the documents that are asked about."""
        return search.boolean(docs, self._of_tokens(*must, *should, *must_not), name, must, should, must_not)

    def size_hint(self, name: str, token: str) -> int:
        """Documents of a token, 0 if it is unknown."""
        row = self.token_stats().filter((F.col("field") == name) & (F.col("token") == token)).first()
        return row["doc_frequency"] if row else 0

    # -- writing

    def append_occurrences(self, occurrences: DataFrame, doc_ids: DataFrame, batch: tuple[str, int] | None = None) -> Index:
        """Commit one generation: the occurrences (field, doc_id, pos, token) of new documents. doc_ids (doc_id) holds all of them, also those without tokens.

        Their ids must be new, that is at least next_docid, and distinct. batch: a stream's name and the number of its batch; one
        that is not beyond the stream's last committed batch changes nothing.
        """
        return self._append(lambda names, level: build.postings(occurrences.filter(F.col("field").isin(*names)), level), lambda names: build.doc_stats(occurrences.filter(F.col("field").isin(*names))), doc_ids, batch)

    def append(self, docs: DataFrame, fields: dict[str, Column | str], batch: tuple[str, int] | None = None) -> Index:
        """Commit documents (doc_id and the texts of the fields, whole columns or expressions) in one generation. Postings are grouped within each document's row."""
        if set(fields) != set(self.manifest.features):
            raise IndexRefused(f"the index has the fields {sorted(self.manifest.features)}")
        own = lambda names: {n: fields[n] for n in names}
        return self._append(lambda names, level: build.document_postings(docs, own(names), level), lambda names: build.doc_stats(build.occurrences(docs, own(names))), docs.select("doc_id"), batch)

    def _append(self, postings, lengths_of, doc_ids: DataFrame, batch: tuple[str, int] | None) -> Index:
        if batch is not None and batch[1] <= self.manifest.batches.get(batch[0], -1):
            return self
        facts = doc_ids.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("named")).first()
        if facts["n"] == 0:
            return self
        if facts["named"] < facts["n"] or facts["low"] < self.manifest.next_docid:
            raise IndexRefused(f"doc_ids must not be null and start at {self.manifest.next_docid} or later")
        if facts["high"] - facts["low"] + 1 < facts["n"] or doc_ids.groupBy("doc_id").count().filter("count > 1").limit(1).count():
            raise IndexRefused("doc_ids must be distinct")
        generation = f"gen-{self.manifest.version + 1:012d}-{uuid.uuid4().hex[:8]}"
        base = f"{self.path}/data/{generation}"
        at: dict[Features, list[str]] = {}
        for name, level in self.manifest.features.items():
            at.setdefault(Features(level), []).append(name)
        parts = None
        for level, names in at.items():  # fields of one level are one pass over the texts
            p = postings(names, level)
            parts = p if parts is None else parts.unionAll(p)
        self._write_postings(parts, base)
        self._write_stats(base)
        lengths = self._generation(base).filter(~F.col("field").isin(*at.get(Features.DOC, []))).groupBy("field", "doc_id").agg(F.sum("tf").alias("doc_len"))
        if Features.DOC in at:  # only here frequencies are not kept
            lengths = lengths.unionAll(lengths_of(at[Features.DOC]))
        lengths.write.partitionBy("field").parquet(f"{base}/doc_stats")
        m = self.manifest
        batches = m.batches | ({batch[0]: batch[1]} if batch is not None else {})
        return self._commit(replace(m, generations=(*m.generations, generation), next_docid=facts["high"] + 1, n_docs=m.n_docs + facts["n"], batches=batches))

    def _write_postings(self, postings: DataFrame, base: str) -> None:
        key = ["field", "bucket", "token", "doc_id"]
        placed = postings.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(self.manifest.buckets)).cast("int"))
        placed.repartitionByRange(*key).sortWithinPartitions(*key).write.partitionBy("field", "bucket").parquet(f"{base}/postings")

    def _generation(self, base: str) -> DataFrame:
        return self.spark.read.schema(POSTINGS + ", bucket int").parquet(f"{base}/postings")

    def _write_stats(self, base: str) -> None:
        sums = self._generation(base).groupBy("field", "token").agg(F.count("*").alias("doc_frequency"), F.sum("tf").alias("term_frequency"), F.min("doc_id").alias("first_docid"))
        sums.repartitionByRange("field", "token").sortWithinPartitions("field", "token").write.partitionBy("field").parquet(f"{base}/token_stats")

    # -- administration

    def stat(self) -> DataFrame:
        """field, section, bytes, size (as text) and rows of the current generations."""
        sizes: dict[tuple[str, str], int] = {}
        for g in self.manifest.generations:
            for name, size in self.files.sizes(f"{self.path}/data/{g}"):
                if name.endswith(".parquet") and "/field=" in name:
                    section = next(s for s in ("postings", "token_stats", "doc_stats") if f"/{s}/" in name)
                    of = unquote(name.split("/field=")[1].split("/")[0])
                    sizes[of, section] = sizes.get((of, section), 0) + size
        found = self.spark.createDataFrame([(f, s, n) for (f, s), n in sorted(sizes.items())], "field string, section string, bytes long")
        kinds = (("postings", POSTINGS), ("token_stats", STORED_STATS), ("doc_stats", DOC_STATS))
        rows = reduce(DataFrame.unionAll, [self._table(s, kind).groupBy("field").agg(F.count("*").alias("rows")).select("field", F.lit(s).alias("section"), "rows") for s, kind in kinds])
        return found.withColumn("size", format_bytes(F.col("bytes"))).join(rows, ["field", "section"]).select("field", "section", "bytes", "size", "rows")

    def compact(self) -> Index:
        """All generations in one new generation; readers of the old manifest keep their files until vacuum()."""
        m = self.manifest
        if len(m.generations) < 2:
            return self
        generation = f"gen-{m.version + 1:012d}-{uuid.uuid4().hex[:8]}"
        base = f"{self.path}/data/{generation}"
        self._write_postings(self.postings(), base)
        self._write_stats(base)
        self.doc_stats().write.partitionBy("field").parquet(f"{base}/doc_stats")
        return self._commit(replace(m, generations=(generation,)))

    def vacuum(self) -> int:
        """Delete generations that the newest manifest does not name; how many."""
        gone = [g for g in self.files.names(f"{self.path}/data") if g not in self.manifest.generations]
        return sum(self.files.delete(f"{self.path}/data/{g}") for g in gone)


def drop(spark: SparkSession, path: str) -> str:
    """Delete an index: "dropped", or "skipped" if there is none."""
    files = _Files(spark, path)
    if not files.exists(f"{path.rstrip('/')}/manifest"):
        return "skipped"
    files.delete(path)
    return "dropped"
