"""Ranked retrieval: BM25 over an inverted index, exact vector search, rank fusion.

Every ranked list has the columns ``(query_id, doc_id, score, rank)``; ranks
start at 1, ties go to the smaller doc_id, and scores are compared at six
decimals so that the order does not hang on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.functions.text import term_bag
from rankmill.session import Scratch, spread

def top_k(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The best ``k`` of each query; the limit is applied before the shuffle as well."""
    s = scored.withColumn("score", F.round("score", digits))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


#: Documents in one block of an index, and queries for which a task is worth reading all blocks.
BLOCK_DOCS, TASK_QUERIES = 16_384, 512

_BLOCK = "doc_id array<long>, len array<int>, term array<string>, df array<int>, docs binary, tf binary"


@dataclass
class BM25Index:
    blocks: DataFrame  # one row per block of documents: ids, lengths, terms in order with their numbers of documents, and per posting the place of its document and its count
    terms: DataFrame  # term, df, idf
    stats: DataFrame  # n_docs, avg_len (one row)
    k1: float
    b: float

    @property
    def tf(self) -> DataFrame:
        """``(term, doc_id, len, tf)``: the postings one by one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _block_rows(batches):
                at, owner = np.frombuffer(x["docs"], np.int32), np.repeat(np.arange(len(x["df"])), x["df"])
                for i in range(0, len(at), 100_000):
                    d = at[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([x["term"].take(pa.array(owner[i : i + 100_000])), x["doc_id"].take(pa.array(d)), pa.array(x["len"][d]), pa.array(np.frombuffer(x["tf"], np.int32)[i : i + 100_000].astype(np.int64))], ["term", "doc_id", "len", "tf"])

        return self.blocks.mapInArrow(run, "term string, doc_id long, len int, tf long")

    def save(self, path: str) -> None:
        """Writes the index below ``path``."""
        self.blocks.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
        _write_terms(self.terms, path)
        self.stats.select("n_docs", "avg_len", F.lit(float(self.k1)).alias("k1"), F.lit(float(self.b)).alias("b")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BM25Index:
        """The index that ``save`` wrote; nothing but its one row of totals is read until it is searched."""
        try:
            stats = spark.read.schema("n_docs long, avg_len double, k1 double, b double").parquet(f"{path}/stats")
            k1, b = stats.select("k1", "b").first()
        except (AnalysisException, TypeError) as e:
            raise FileNotFoundError(f"no index in {path}; build and save one first") from e
        return cls(spark.read.schema(_BLOCK).parquet(f"{path}/blocks"), spark.read.schema("term string, df long, idf double").parquet(f"{path}/terms"), stats.select("n_docs", "avg_len"), k1, b)

    def postings(self) -> DataFrame:
        """``(term, doc_id, weight)``: a term's whole weight in a document."""
        norm = self.k1 * (1 - self.b + self.b * F.col("len") / F.col("avg_len"))
        return self.tf.join(self.terms, "term").crossJoin(F.broadcast(self.stats)).withColumn("weight", F.col("idf") * F.col("tf") / (F.col("tf") + norm))  # one row


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            x = {n: b.column(n)[i] for n in b.schema.names}
            yield {n: v.as_py() if n in ("docs", "tf") else v.values if n in ("doc_id", "term") else np.asarray(v.values) for n, v in x.items()}


def build_bm25(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, mode: str = "code", to: str | None = None) -> BM25Index:
    """An inverted index in blocks of documents, each written where its documents lie; ``docs`` has one row per document.

    Documents without terms count in N and in the mean length.  With ``to`` the
    index is written there once, as ``save`` would write it.
    """

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        bags = t["terms"].combine_chunks()
        lens = np.diff(np.asarray(bags.offsets))
        coded = bags.flatten().dictionary_encode()
        # postings in order of their term's first place, then of the document
        pairs, tf = np.unique(np.asarray(coded.indices).astype(np.int64) * len(lens) + np.repeat(np.arange(len(lens)), lens), return_counts=True)
        df = np.bincount(pairs // max(1, len(lens)), minlength=len(coded.dictionary))
        row = [t["doc_id"].combine_chunks(), pa.array(lens.astype(np.int32)), coded.dictionary, pa.array(df.astype(np.int32))]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row]
        blobs = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (pairs % max(1, len(lens)), tf)]
        return pa.RecordBatch.from_arrays(lists + blobs, ["doc_id", "len", "term", "df", "docs", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for x in batches:
            for at in range(0, x.num_rows, 1024):
                parts.append(x.slice(at, 1024))
                n += parts[-1].num_rows
                if n >= BLOCK_DOCS:
                    yield block(parts)
                    parts, n = [], 0
        if n:
            yield block(parts)

    spark = docs.sparkSession
    place = to or Scratch(spark, "bm25").path
    docs.select(F.col(id_col).cast("long").alias("doc_id"), term_bag(text_col, mode).alias("terms")).mapInArrow(run, _BLOCK).write.mode("overwrite").option("compression", "zstd").parquet(f"{place}/blocks")
    blocks = spark.read.schema(_BLOCK).parquet(f"{place}/blocks")
    total = blocks.agg(F.coalesce(F.sum(F.size("doc_id")), F.lit(0)).cast("long").alias("n_docs"), F.sum(F.aggregate("len", F.lit(0).cast("long"), lambda a, v: a + v)).alias("n_terms"))
    total.select("n_docs", (F.col("n_terms") / F.col("n_docs")).alias("avg_len"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b")).coalesce(1).write.mode("overwrite").parquet(f"{place}/stats")
    stats = spark.read.schema("n_docs long, avg_len double").parquet(f"{place}/stats")
    terms = blocks.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy(F.col("x.term").alias("term")).agg(F.sum("x.df").alias("df")).crossJoin(F.broadcast(stats))  # one row
    terms = terms.select("term", "df", F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    if to is None:
        return BM25Index(blocks, terms, stats, k1, b)
    _write_terms(terms, to)
    return BM25Index.load(spark, to)


def _write_terms(terms: DataFrame, path: str) -> None:
    terms.sortWithinPartitions("term").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/terms")


def _grid(queries: DataFrame, n: int, least: int = 1) -> tuple[DataFrame, int]:
    """``queries`` in slices, and the number of groups that the searched files are dealt to; a task has one slice and one group (``part``).

    With enough queries to employ all tasks there is one group: every task
    reads all files, and nothing but final lists leaves it.
    """
    cores = max(1, queries.sparkSession.sparkContext.defaultParallelism)
    slices = max(least, min(cores, -(-n // TASK_QUERIES)), -(-n // (16 * TASK_QUERIES)), 1)
    groups = -(-cores // slices)
    rows = queries.withColumn("part", F.explode(F.array(*[F.lit(g) for g in range(groups)])))
    return rows.repartitionById(slices * groups, (F.pmod(F.xxhash64("query_id"), F.lit(slices)) * groups + F.col("part")).cast("int")), groups


def _ranked(found: DataFrame, groups: int, k: int) -> DataFrame:
    """The lists as tasks made them, if each had a query's documents all to itself; else the best of several tasks' lists."""
    return found if groups == 1 else top_k(found, k)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """A task's rows, all of one group."""
    rows = [b for b in batches if b.num_rows]
    if rows:
        t = pa.Table.from_batches(rows)
        yield t["part"][0].as_py(), t.drop_columns("part").combine_chunks()


def pack(ids: np.ndarray, scores: np.ndarray) -> bytes:
    """A ranked list in few bytes: scores of six decimals as differences of whole numbers, ids and numbers by their bytes' places, compressed."""
    with np.errstate(all="ignore"):
        whole = np.rint(scores * 1e6)
        exact = bool((np.abs(whole) < 2.0**52).all() and (whole / 1e6 == scores).all())
    numbers = np.diff(whole.astype(np.int64), prepend=0) * -1 if exact else scores.view(np.int64)
    planes = np.stack([ids.astype(np.int64), numbers]).view(np.uint8).reshape(2 * len(ids), 8).T.tobytes()
    return bytes([exact]) + len(ids).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and scores that ``pack`` was given."""
    n = int.from_bytes(packed[1:5], "little")
    planes = np.frombuffer(pa.decompress(packed[5:], 16 * n, "zstd", asbytes=True), np.uint8)
    ids, numbers = np.ascontiguousarray(planes.reshape(8, 2 * n).T).view(np.int64).reshape(2, n)
    return ids, np.cumsum(-numbers) / 1e6 if packed[0] else numbers.view(np.float64)


def _packed(names: pa.Array, lists: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A row per query that has documents."""
    blobs = pa.array([pack(d, s) if len(d) else None for d, s in lists], pa.binary())
    for at in range(0, len(names), 2048):
        yield pa.RecordBatch.from_arrays([names.slice(at, 2048), blobs.slice(at, 2048)], ["query_id", "found"]).filter(pc.is_valid(blobs.slice(at, 2048)))


def _open(file: str) -> pq.ParquetFile:
    fs, path = pafs.FileSystem.from_uri(file)
    return pq.ParquetFile(fs.open_input_file(path))


def _array(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


def _order(ids: pa.Array) -> np.ndarray:
    """Ids as numbers to be compared; NULL comes first."""
    return np.asarray(ids.fill_null(np.iinfo(np.int64).min))


def search_bm25(index: BM25Index, queries: DataFrame, k: int = 100, mode: str = "code", seeds: int = 3, direct: int = 20_000_000, packed: bool = False) -> DataFrame:
    """Ranked documents for ``queries(query_id, query_text)``; only documents with a matching term come out.

    A term that a query repeats counts as often.  A task takes a slice of the
    queries through one block of the index after another and keeps each query's
    best ``k`` so far, so no list of hits is ever written.  All hits are added
    up; ``seeds`` and ``direct`` steered a search that left some out, and the
    result never hung on them.  ``packed`` gives lists as tasks made them, one
    in a row ``(query_id, found)`` (see ``pack``); a query may have several,
    of different documents, whose best ``k`` are its list.
    """
    q = queries.select("query_id", F.explode(term_bag("query_text", mode)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    q = q.join(index.terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    placed, groups = _grid(q, queries.count())
    files, k1, b = sorted(index.blocks.inputFiles()), index.k1, index.b
    mean = index.stats.first()["avg_len"] or 1.0

    def best(t: pa.Table, mine: list[str]) -> Iterator[pa.RecordBatch]:
        named, coded = (_array(t[c]).dictionary_encode("encode") for c in ("query_id", "term"))
        at, words = np.asarray(named.indices), np.asarray(coded.indices)
        order, names = np.argsort(at, kind="stable"), named.dictionary
        words, weights, starts = words[order], np.asarray(t["weight"])[order], np.r_[0, np.cumsum(np.bincount(at, minlength=len(names)))]
        scores, ids, least = [np.zeros(0)] * len(names), [np.zeros(0, np.int64)] * len(names), np.full(len(names), 5e-324)
        null = np.iinfo(np.int64).min
        for x in (x for f in mine for x in _block_rows(_open(f).iter_batches(batch_size=1))):
            own, n = _order(x["doc_id"]), len(x["doc_id"])
            docs, tf, df, ends = np.frombuffer(x["docs"], np.int32).astype(np.int64), np.frombuffer(x["tf"], np.int32), x["df"], np.r_[0, np.cumsum(x["df"])]
            if not len(df):
                continue
            part = tf / (tf + (k1 * (1 - b + b * x["len"] / mean))[docs])
            most, frequent = np.maximum.reduceat(part, ends[:-1]), 8 * df > n
            place = np.asarray(pc.index_in(coded.dictionary, value_set=x["term"]).fill_null(-1))
            whole: dict[int, np.ndarray] = {}  # frequent terms as whole rows
            for p in place[place >= 0][frequent[place[place >= 0]]].tolist():
                whole[p] = np.bincount(docs[ends[p] : ends[p + 1]], part[ends[p] : ends[p + 1]], n)
            for i in range(len(names)):
                p, v = place[words[starts[i] : starts[i + 1]]], weights[starts[i] : starts[i + 1]]
                p, v = p[p >= 0], v[p >= 0]
                if not len(p):
                    continue
                often = frequent[p]
                rare, total = p[~often], np.zeros(n)
                if len(rare):
                    cuts = list(zip(ends[rare].tolist(), ends[rare + 1].tolist(), strict=True))
                    total = np.bincount(np.concatenate([docs[c:e] for c, e in cuts]), np.concatenate([part[c:e] for c, e in cuts]) * np.repeat(v[~often], df[rare]), n)
                # frequent terms are added to all documents as long as they could make up a place in the list by themselves, then only to those that can still reach one
                p, v = p[often], v[often]
                reach = v * most[p]
                order = np.argsort(-reach)
                left = np.r_[np.cumsum(reach[order][::-1])[::-1], 0.0] * (1 + 1e-9)
                added = int((left[:-1] >= least[i]).sum())
                for j in order[:added]:
                    total += v[j] * whole[p[j]]
                found = np.flatnonzero(total >= least[i] - left[added])
                s = total[found]
                for nth, j in enumerate(order[added:], added + 1):
                    s += v[j] * whole[p[j]][found]
                    if nth == len(order) or len(s) > 4 * k and (nth - added) % 3 == 1:
                        high = np.flatnonzero(s >= least[i] - left[nth])
                        found, s = found[high], s[high]
                if not len(found):
                    continue
                if len(s) > 4 * k:
                    high = s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-6
                    found, s = found[high], s[high]
                s, d = np.r_[scores[i], np.round(s, 6)], np.r_[ids[i], own[found]]
                top = np.lexsort((d, -s))[:k]
                scores[i], ids[i] = s[top], d[top]
                if len(top) == k:
                    least[i] = max(5e-324, s[top[-1]] - 1e-6)
        if packed:
            yield from _packed(names, zip(ids, scores, strict=True))
            return
        for a in range(0, len(names), 512):
            d = np.concatenate(ids[a : a + 512])
            owner = np.repeat(np.arange(a, min(a + 512, len(names))), [len(x) for x in ids[a : a + 512]])
            rank = np.arange(1, len(owner) + 1) - np.searchsorted(owner, owner)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(owner)), pa.array(d, mask=d == null), pa.array(np.concatenate(scores[a : a + 512])), pa.array(rank.astype(np.int32))], ["query_id", "doc_id", "score", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _parts(batches):
            yield from best(t, files[part::groups])

    kind = queries.schema["query_id"].dataType.simpleString()
    if packed:
        return placed.mapInArrow(run, f"query_id {kind}, found binary")
    return _ranked(placed.mapInArrow(run, f"query_id {kind}, doc_id long, score double, rank int"), groups, k)


# --- dense ---


def hash_embed(dim: int = 256, mode: str = "code"):
    """A deterministic encoder that needs no model: signed feature hashing of the terms, unit length.

    A batch of texts is added up as one array, and each of its terms is hashed once.
    """

    @F.arrow_udf("array<double>")
    def encode(bags: pa.Array) -> pa.Array:
        coded = bags.flatten().dictionary_encode()
        hashed = np.array([int.from_bytes(md5(t.encode()).digest()[:4], "big") for t in coded.dictionary.to_pylist()], np.int64)
        flat = hashed[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(bags)), np.asarray(pc.list_value_length(bags)))
        v = np.bincount(owner * dim + flat % dim, np.where((flat >> 20) & 1, 1.0, -1.0), len(bags) * dim).reshape(len(bags), dim)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        out = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(bags) * dim + 1, dim), pa.int32()), pa.array(out.ravel()))

    return lambda text: encode(term_bag(text, mode))


def hash_vectors(index: BM25Index, dim: int = 256) -> DataFrame:
    """``(doc_id, embedding)`` of ``hash_embed`` for an index's documents, from its counts: no text is read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _block_rows(batches):
            h = np.repeat(np.array([int.from_bytes(md5(t.encode()).digest()[:4], "big") for t in x["term"].to_pylist()], np.int64), x["df"])
            docs, v = np.frombuffer(x["docs"], np.int32).astype(np.int64), np.where((h >> 20) & 1, 1.0, -1.0) * np.frombuffer(x["tf"], np.int32)
            order = np.argsort(docs, kind="stable")
            docs, h, v = docs[order], h[order], v[order]
            for a in range(0, len(x["doc_id"]), 2048):
                n = min(2048, len(x["doc_id"]) - a)
                own = slice(*np.searchsorted(docs, (a, a + n)))
                m = np.bincount((docs[own] - a) * dim + h[own] % dim, v[own], n * dim).reshape(n, dim)
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                out = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                yield pa.RecordBatch.from_arrays([x["doc_id"].slice(a, n), pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim), pa.int32()), pa.array(out.ravel()))], ["doc_id", "embedding"])

    return index.blocks.mapInArrow(run, "doc_id long, embedding array<double>")


@cache
def _loaded(make: Callable) -> Callable:
    return make()


def model_encoder(make: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "", batch: int = 64):
    """An encoder around a sentence model: ``make`` loads it once per worker process and gives a function of a list of texts.

    ``prefix`` goes before each text, as some models want of queries.  Vectors are
    brought to unit length; a NULL text is encoded as an empty one.
    """

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        model, out = _loaded(make), []
        rows = [prefix + (t or "") for t in texts]
        for at in range(0, len(rows), batch):
            v = np.asarray(model(rows[at : at + batch]), np.float32)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            out += list(np.divide(v, n, out=np.zeros_like(v), where=n > 0))
        return pd.Series(out)

    return lambda text: encode(F.col(text) if isinstance(text, str) else text)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Writes ``vectors(doc_id, embedding)`` as they lie."""
    vectors.select("doc_id", "embedding").write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path).select("doc_id", "embedding")
    except AnalysisException as e:
        raise FileNotFoundError(f"no vectors in {path}; encode and save them first") from e


def normalised(col: Column) -> Column:
    """A vector at unit length, in doubles."""
    x = F.transform(col, lambda v: v.cast("double"))
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(x, lambda v: F.when(n > 0, v / n).otherwise(0.0))


def search_dense(vectors: DataFrame | str, queries: DataFrame, k: int = 100, slice_bytes: int = 32 << 20, chunk_bytes: int = 16 << 20, packed: bool = False) -> DataFrame:
    """Exact top k by inner product of ``vectors(doc_id, embedding)`` for ``queries(query_id, embedding)``.

    Vectors that ``save_vectors`` wrote are named by their path and read where
    they lie; others are written to the shared folder.  A task takes a slice of the
    queries, of bounded size, through one chunk of them after another and keeps
    each query's best ``k`` so far, so only final lists are shuffled.  Vectors
    that are NULL, or of another length than the queries', match nothing.
    ``packed`` is that of ``search_bm25``.
    """
    q = queries.filter("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n, dim = q.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dim = dim or 1
    if isinstance(vectors, str):
        files = sorted(load_vectors(queries.sparkSession, vectors).inputFiles())
    else:
        rows = vectors.filter(F.col("embedding").isNotNull() & F.col("doc_id").isNotNull() & (F.size("embedding") == dim)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        files = sorted(Scratch(vectors.sparkSession, "vectors").write(spread(rows)).inputFiles())
    placed, groups = _grid(q.filter(F.size("embedding") == dim), n, -(-n * dim * 8 // slice_bytes))

    def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.asarray(a.flatten(), np.float64).reshape(len(a), dim)

    def chunks(mine: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, vs, size = [], [], 0
        for b in (b for f in mine for b in _open(f).iter_batches(batch_size=max(1, chunk_bytes // (8 * dim)))):
            fit = pc.and_(pc.is_valid(b.column("doc_id")), pc.fill_null(pc.equal(pc.list_value_length(b.column("embedding")), dim), False))
            b = b.filter(fit)
            if b.num_rows:
                ids.append(np.asarray(b.column("doc_id")).astype(np.int64))
                vs.append(matrix(b.column("embedding")))
                size += vs[-1].nbytes
            if size >= chunk_bytes:
                yield np.concatenate(ids), np.concatenate(vs)
                ids, vs, size = [], [], 0
        if size:
            yield np.concatenate(ids), np.concatenate(vs)

    def best(t: pa.Table, mine: list[str]) -> Iterator[pa.RecordBatch]:
        (names, owner), m = np.unique(np.asarray(t["query_id"]), return_inverse=True), matrix(t["embedding"])
        kept, least = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full((len(names), 1), -np.inf)
        found, waiting = [kept], 0

        def merge() -> None:
            nonlocal kept, found, waiting
            row, ids, s = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((ids, -s, row))
            row, ids, s = row[order], ids[order], s[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            kept = row[nth < k], ids[nth < k], s[nth < k]
            last = nth == k - 1
            least[row[last], 0] = s[last] - 1e-6
            found, waiting = [kept], 0

        # single precision finds what may belong to a list, double precision decides
        short, lengths = m.astype(np.float32), np.linalg.norm(m, axis=1)[:, None]

        def hits(ids: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
            columns, longest = v.T.astype(np.float32), np.linalg.norm(v, axis=1).max()
            for at in range(0, len(m), 256):
                part, bound = m[at : at + 256], least[owner[at : at + 256]]
                with np.errstate(all="ignore"):
                    error = (dim + 8) * 2.0**-23 * lengths[at : at + 256] * longest + 1e-30
                    rough = short[at : at + 256] @ columns
                if not (np.isfinite(error).all() and np.isfinite(rough).all()):
                    rough, error = part @ v.T, 0.0
                    rough[np.isnan(rough)] = -np.inf  # takes no place in a list
                if len(ids) > k and np.isneginf(bound).any():
                    bound = np.maximum(bound, np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k, None] - 1e-6 - error)
                row, col = np.divmod(np.flatnonzero(rough >= (bound - error).astype(rough.dtype)), len(ids))
                s = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", part[row[c : c + 8192]], v[col[c : c + 8192]]) for c in range(0, len(row), 8192))])
                high = s >= bound[row, 0]
                yield owner[row[high] + at], ids[col[high]], s[high]

        for ids, v in chunks(mine):
            for row, d, s in hits(ids, v):
                found.append((row, d, np.round(s, 6) + 0.0))
                waiting += len(row)
                if waiting > max(len(kept[0]), 1_000_000):
                    merge()
            if waiting > len(kept[0]) // 2:
                merge()
        merge()
        if packed:
            ends = np.searchsorted(kept[0], np.arange(len(names) + 1))
            yield from _packed(pa.array(names), ((kept[1][a:b], kept[2][a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)))
            return
        for at in range(0, len(kept[0]), 100_000):
            row, ids, s = (x[at : at + 100_000] for x in kept)
            rank = np.arange(at + 1, at + len(row) + 1) - np.searchsorted(kept[0], row)
            yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids), pa.array(s), pa.array(rank.astype(np.int32))], ["query_id", "doc_id", "score", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in _parts(batches):
            yield from best(t, files[part::groups])

    if packed:
        return placed.mapInArrow(run, "query_id long, found binary")
    return _ranked(placed.mapInArrow(run, "query_id long, doc_id long, score double, rank int"), groups, k)


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


# --- fusion ---


def fuse_rrf(lists: list[DataFrame], k: int = 60, top: int = 100) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: the sum of 1 / (k + rank).

    Equal sums keep the order of the first list, then of the second, and so on.
    """
    tagged = [x.select("query_id", "doc_id", F.lit(i).alias("which"), "rank") for i, x in enumerate(lists)]
    ranks = [F.min(F.when(F.col("which") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(lists))]
    per = reduce(DataFrame.unionByName, tagged).repartition("query_id").groupBy("query_id", "doc_id").agg(*ranks)  # one shuffle serves the ranking as well
    score = reduce(lambda a, b: a + b, [F.coalesce(1.0 / (k + F.col(f"r{i}")), F.lit(0.0)) for i in range(len(lists))])
    per = per.withColumn("score", F.round(score, 12))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *[F.asc_nulls_last(f"r{i}") for i in range(len(lists))], "doc_id")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "doc_id", "score", "rank")


def confidence_gate(dense: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Per query the best score of the whole dense list, and whether it opens the gate."""
    return dense.groupBy("query_id").agg(F.max("score").alias("top_score")).withColumn("gate", F.when(F.col("top_score") >= threshold, "open").otherwise("closed"))


def with_documents(ranked: DataFrame, corpus: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Titles and snippets of ranked documents; a missing one is shown as ``?`` or left out."""
    docs = corpus.groupBy("doc_id").agg(F.min("title").alias("title"), F.min("answer_body").alias("body"))
    out = ranked.join(docs, "doc_id", "left" if keep_missing else "inner")
    return out.withColumn("title", F.coalesce("title", F.lit("?"))).withColumn("body", F.coalesce("body", F.lit("")))


def search_hybrid(index: BM25Index, vectors: DataFrame | str, encode, queries: DataFrame, model, k: int = 4, pool: int = 100, rrf_k: int = 5) -> DataFrame:
    """The best ``k`` documents per query out of both lists, ordered by a ranking model, with the dense list's best score, ``top_score``, which is the confidence."""
    from rankmill.operators.ltr import candidates, rerank

    dense = search_dense(vectors, queries.select("query_id", encode("query_text").alias("embedding")), pool, packed=True)
    return rerank(candidates(search_bm25(index, queries, pool, packed=True), dense, None, rrf_k, pool), model, k)
