"""Near-duplicate records with small edits, insertions or reordering.

Each text is the set of its runs of ``run`` consecutive words.  ``rows *
bands`` universal hash minima are taken of it; ``rows`` minima make a band, and
texts that agree in at least ``agree`` bands are candidates, which is the
signature check.  Candidates are verified on the whole sets, verified links are
joined to groups by alternating large-star and small-star.

With 4 rows, 80 bands and 2 agreeing bands, a pair of likeness 0.6 is found
with probability 0.9998, one of 0.65 with 0.999999.  A band's value keeps 48
bits, since two chance agreements of one pair are needed to make it a candidate.
Exact copies are collapsed to one representative first.  A band value shared by more than ``block``
representatives is split into blocks, and blocks are paired in separate tasks,
so no task holds an unbounded group.  Copies listed as such are joined by a
broadcast only below ``broadcast_rows`` rows, else by a shuffle.

Defined cases: a text that is NULL or has fewer than ``run`` words is like no
other; rows repeated under one id count once (of differing texts the one with
the least hash counts); NULL ids are skipped; empty tables give no rows; other
columns are never read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.components import components
from rankmill.llm.words import likeness, mix, runs_of_texts, sets_of_runs
from rankmill.session import Scratch, parallelism
from rankmill.sources.tables import load


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    run: int = 5
    rows: int = 4
    bands: int = 80
    agree: int = 2
    block: int = 2000
    broadcast_rows: int = 100_000
    seed: int = 11


def band_values(runs: np.ndarray, counts: np.ndarray, s: Settings, salt: int) -> np.ndarray:
    """One 64-bit value per text and band from the minima of its runs; ``counts`` are all positive.

    A minimum is taken of multiply-add hashes of 32 bits, in blocks that stay in the cache.
    """
    rng = np.random.default_rng(s.seed)
    mul = rng.integers(1, 1 << 62, s.rows * s.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 62, s.rows * s.bands, dtype=np.uint64)
    out = np.zeros((len(counts), s.bands), np.uint64)
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - counts[at] + 16_384)))
        lo, hi = ends[at] - counts[at], ends[to - 1]
        x, starts = runs[lo:hi], ends[at:to] - counts[at:to] - lo
        for b in range(s.bands):
            v = np.full(to - at, salt * 1000 + b + 1, np.uint64)
            for k in range(b * s.rows, (b + 1) * s.rows):
                v = mix(v + np.minimum.reduceat((x * mul[k] + add[k]) >> np.uint64(32), starts))
            out[at:to, b] = v >> np.uint64(16)
        at = to
    return out


def _texts(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``(id, f0, f1, ...)``; a field that ends the first one is given as its length only."""
    return df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])


def text_classes(texts: DataFrame, n_fields: int, run: int) -> DataFrame:
    """``(field, id, h, rows)``: the hash that stands for an id's text, and in how many rows it has one; texts of fewer than ``run`` words are left out."""
    enough = r"([\p{L}\p{N}_]+[^\p{L}\p{N}_]+){%d}[\p{L}\p{N}_]" % (run - 1) if run > 1 else r"[\p{L}\p{N}_]"
    long = texts.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.when(F.col(f"f{i}").rlike(enough), F.xxhash64(f"f{i}")).alias("h")) for i in range(n_fields)])).alias("x")).select("id", "x.*")
    one = long.filter("h is not null").groupBy("field", "id").agg(F.min("h").alias("h"), F.count("*").alias("rows"))
    return one


def _once(texts: DataFrame, one: DataFrame, n_fields: int, s: Settings, scratch: Scratch) -> DataFrame:
    """``texts`` with one row per id: of an id's repeated rows, each field is the text with the least hash, as in ``text_classes``."""
    again = scratch.write(one.filter("rows > 1").select("id").distinct())
    few = F.broadcast(again) if again.count() <= s.broadcast_rows else again
    merged = texts.join(few, "id", "left_semi").groupBy("id").agg(*[F.min_by(f"f{i}", F.xxhash64(f"f{i}")).alias(f"f{i}") for i in range(n_fields)])
    return texts.join(few, "id", "left_anti").unionByName(merged)


def _bands(texts: DataFrame, n_fields: int, skip_cols: list[str], s: Settings) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for i in range(n_fields):
                t = [None if skip else x for x, skip in zip(batch.column(f"f{i}").to_pylist(), batch.column(skip_cols[i]).to_pylist(), strict=True)]
                runs, counts = runs_of_texts(t, s.run)
                have = np.flatnonzero(counts)
                if not len(have):
                    continue
                keys = band_values(runs, counts[have], s, i)
                who = np.repeat(ids[have], s.bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(who), pa.array(np.full(len(who), i, np.int32))], ["key", "id", "field"])

    return texts.mapInArrow(make, "key long, id long, field int")


def _pairs_in_buckets(block: int):
    """Over rows sorted by key: pairs of ids that share a key; keys with more than ``block`` ids come out as blocks instead."""

    def emit(key: np.ndarray, ids: np.ndarray, field: np.ndarray) -> tuple[np.ndarray, ...]:
        first = np.r_[True, key[1:] != key[:-1]]
        size = np.diff(np.r_[np.flatnonzero(first), len(key)])
        later = np.repeat(size, size) - 1 - (np.arange(len(key)) - np.repeat(np.flatnonzero(first), size))
        a = np.repeat(np.arange(len(key)), later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        x, y, f = ids[a], ids[b], field[a]
        ok = x != y
        return np.minimum(x, y)[ok], np.maximum(x, y)[ok], f[ok]

    def batch(a, b, f, kind, key) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(f.astype(np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(np.zeros(n, np.int64) if key is None else key)], ["a", "b", "field", "kind", "key"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ids = np.zeros(0, np.int64)
        field = np.zeros(0, np.int32)
        hot, part = None, 0  # the key now being cut into blocks
        for r in batches:
            key = np.r_[key, r.column("key").to_numpy()]
            ids = np.r_[ids, r.column("id").to_numpy()]
            field = np.r_[field, r.column("field").to_numpy()]
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            done = (key[:cut], ids[:cut], field[:cut])
            key, ids, field = key[cut:], ids[cut:], field[cut:]
            yield from finish(*done, hot, part)
            if cut:
                hot, part = None, 0
            while len(key) > block:
                hot = int(key[0])
                yield batch(ids[:block], np.full(block, part), field[:block], 1, key[:block])
                key, ids, field, part = key[block:], ids[block:], field[block:], part + 1
        yield from finish(key, ids, field, hot, part)

    def finish(key, ids, field, hot, part) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        if hot is not None and key[0] == hot:
            n = int(np.searchsorted(key, hot, side="right"))
            yield batch(ids[:n], np.full(n, part), field[:n], 1, key[:n])
            key, ids, field = key[n:], ids[n:], field[n:]
        if not len(key):
            return
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        for s0, n in zip(starts[size > block], size[size > block], strict=True):
            where = slice(s0, s0 + n)
            yield batch(ids[where], np.arange(n) // block, field[where], 1, key[where])
        few = np.repeat((size > 1) & (size <= block), size)
        a, b, f = emit(key[few], ids[few], field[few]) if few.any() else (ids[:0], ids[:0], field[:0])
        for at in range(0, len(a), 200_000):
            yield batch(a[at : at + 200_000], b[at : at + 200_000], f[at : at + 200_000], 0, None)

    return make


def _block_pairs(hot: DataFrame) -> DataFrame:
    """Candidate pairs of the band values that were cut into blocks: every pair of blocks is a task of its own."""
    n = hot.groupBy("key").agg((F.max("b") + 1).alias("n"))
    tasks = hot.join(n, "key").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("key", "a", "b", "field", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["b"] == pdf["x"]]
        right = pdf[pdf["b"] == pdf["y"]]
        i, j = np.meshgrid(left["a"].to_numpy(), right["a"].to_numpy())
        i, j = i.ravel(), j.ravel()
        ok = i < j if (pdf["x"].iloc[0] == pdf["y"].iloc[0]) else i != j
        return pd.DataFrame({"a": np.minimum(i, j)[ok], "b": np.maximum(i, j)[ok], "field": pdf["field"].iloc[0]})

    return tasks.groupBy("key", "x", "y").applyInPandas(make, "a long, b long, field int")


def _verified(pairs: DataFrame, texts: DataFrame, n_fields: int, s: Settings, scratch: Scratch) -> DataFrame:
    """``(field, a, b, likeness)`` of the candidates at or above the threshold, on the whole sets of runs."""
    ends = pairs.select(F.col("a").alias("id"), "field").unionByName(pairs.select(F.col("b").alias("id"), "field"))
    wanted = scratch.write(ends.groupBy("id").agg(*[F.max(F.col("field") == i).alias(f"w{i}") for i in range(n_fields)]))
    few = wanted.count() <= s.broadcast_rows
    these = texts.join(F.broadcast(wanted) if few else wanted, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for i in range(n_fields):
                want = batch.column(f"w{i}").to_pylist()
                t = [x if w else None for x, w in zip(batch.column(f"f{i}").to_pylist(), want, strict=True)]
                runs, counts = sets_of_runs(*runs_of_texts(t, s.run))
                have = np.flatnonzero(counts)
                cut = np.cumsum(counts)
                blobs = [runs[cut[k] - counts[k] : cut[k]].astype("<u8").tobytes() for k in have]
                yield pa.RecordBatch.from_arrays([pa.array(ids[have]), pa.array(np.full(len(have), i, np.int32)), pa.array(blobs, pa.binary())], ["id", "field", "runs"])

    # sets are kept by id, not by pair: each is computed once, whatever the number of its candidates
    own = scratch.write(these.mapInArrow(sets, "id long, field int, runs binary"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            value = [likeness(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            out = pd.DataFrame({"field": pdf["field"], "a": pdf["a"], "b": pdf["b"], "likeness": np.asarray(value, float)})
            yield out[out["likeness"] >= s.threshold - 1e-12]

    one = own.select(F.col("id").alias("a"), "field", F.col("runs").alias("x"))
    two = own.select(F.col("id").alias("b"), "field", F.col("runs").alias("y"))
    joined = pairs.join(one, ["a", "field"]).join(two, ["b", "field"]).select("field", "a", "b", "x", "y")
    return joined.mapInPandas(compare, "field int, a long, b long, likeness double")


@dataclass
class Near:
    """Links between class representatives, and each record's class."""

    links: DataFrame  # field, a, b, likeness
    members: DataFrame  # field, id, rep
    scratch: Scratch


def near_duplicates(df: DataFrame, id_col: str, fields: list[str], settings: Settings) -> Near:
    """All pairs of different texts at or above the threshold, per field, as representatives plus membership."""
    s, spark = settings, df.sparkSession
    scratch = Scratch(spark, "near")
    texts = _texts(df, id_col, fields)
    n = len(fields)
    one = scratch.write(text_classes(texts, n, s.run))
    least = one.groupBy("field", "h").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    texts = _once(texts, one, n, s, scratch)
    members = scratch.write(one.join(least.filter("n > 1"), ["field", "h"], "left").select("field", "id", "h", F.coalesce("rep", "id").alias("rep")))
    copies = scratch.write(members.filter("id <> rep").groupBy("id").agg(*[F.max(F.col("field") == i).alias(f"s{i}") for i in range(n)]))
    small = copies.count() <= s.broadcast_rows
    marked = texts.join(F.broadcast(copies) if small else copies, "id", "left")
    rows = _bands(marked, n, [f"s{i}" for i in range(n)], s)
    # a task sorts at most about 64 MB of band values, so their number grows with the input
    tasks = max(parallelism(spark), -(-one.count() * s.bands * 16 // (64 << 20)))
    sorted_rows = rows.repartition(tasks, "key").sortWithinPartitions("key")
    out = scratch.write(sorted_rows.mapInArrow(_pairs_in_buckets(s.block), "a long, b long, field int, kind int, key long").groupBy("field", "a", "b", "kind", "key").agg(F.count("*").alias("n")))
    pairs = out.filter("kind = 0").select("field", "a", "b", "n")
    hot = out.filter("kind = 1").select("field", "a", "b", "key")
    if hot.limit(1).count():
        more = _block_pairs(hot).groupBy("field", "a", "b").agg(F.count("*").alias("n")).select("field", "a", "b", "n")
        pairs = pairs.unionByName(more)
    candidates = scratch.write(pairs.groupBy("field", "a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= s.agree).select("field", "a", "b"))
    scratch.drop(out)
    del rows, sorted_rows, out, pairs, hot
    gc.collect()  # so that Spark can delete the shuffle files of the bands
    spark.sparkContext._jvm.System.gc()
    links = scratch.write(_verified(candidates, texts, n, s, scratch))
    return Near(links, members.select("field", "id", "rep"), scratch)


def all_pairs(near: Near) -> DataFrame:
    """``(field, id_a, id_b)``: the links with copies written out, and the pairs of copies themselves."""
    m = near.members
    shared = m.groupBy("field", "rep").agg(F.count("*").alias("n")).filter("n > 1").select("field", "rep")
    copied = m.join(shared, ["field", "rep"], "left_semi")
    a, b = copied.select("field", "rep", F.col("id").alias("x")), copied.select("field", "rep", F.col("id").alias("y"))
    same = a.join(b, ["field", "rep"]).filter("x < y").select("field", F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    left, right = m.select("field", F.col("rep").alias("a"), F.col("id").alias("x")), m.select("field", F.col("rep").alias("b"), F.col("id").alias("y"))
    cross = near.links.join(left, ["field", "a"]).join(right, ["field", "b"]).select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return cross.unionByName(same)


def groups(near: Near) -> DataFrame:
    """``(field, id, group_id, n_links)``: one row per record that has a near duplicate or a copy."""
    m = near.members
    size = m.groupBy("field", "rep").agg(F.count("*").alias("copies"))
    ends = near.links.select("field", F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(near.links.select("field", F.col("b").alias("rep"), F.col("a").alias("other")))
    linked = ends.join(size.withColumnsRenamed({"rep": "other", "copies": "n"}), ["field", "other"]).groupBy("field", "rep").agg(F.sum("n").alias("n"))
    # a node of the graph is (field, rep) packed into one number: ids keep their order inside a field
    named = near.links.select(F.struct("field", F.col("a").alias("rep")).alias("a"), F.struct("field", F.col("b").alias("rep")).alias("b"))
    comp = components(named, near.scratch).select("node.field", "node.rep", F.col("component.rep").alias("component"))
    per = size.join(linked, ["field", "rep"], "left").join(comp, ["field", "rep"], "left").select(
        "field", "rep", F.coalesce("component", "rep").alias("group_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return m.join(per.filter("n_links > 0"), ["field", "rep"]).select("field", "id", "group_id", "n_links")


FIELDS = ["text", "answer_body"]
#: Likeness of runs of three words, as the test data states it.
P7 = Settings(threshold=0.6, run=3)


def _name(df: DataFrame) -> DataFrame:
    return df.withColumn("field", F.element_at(F.array(*map(F.lit, FIELDS)), F.col("field") + 1)).withColumnRenamed("field", "field_name")


def _near(spark: SparkSession, folder: str) -> Near:
    return near_duplicates(load(spark, folder, "corpus").select("doc_id", *FIELDS), "doc_id", FIELDS, P7)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every two corpus documents whose text or answer body is nearly the same."""
    return _name(all_pairs(_near(spark, folder)))


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that has a near duplicate, with its group and number of links."""
    return _name(groups(_near(spark, folder)))


QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups}
SQL: dict[str, str] = {
    "p7_found": r"""with t as (select 'text' as field_name, doc_id as id, min(text) as s from corpus group by doc_id union all select 'answer_body', doc_id, min(answer_body) from corpus group by doc_id),
w as (select field_name, id, regexp_extract_all(lower(s), '[\p{L}\p{N}_]+') as w from t),
r as (select distinct field_name, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as run from w where len(w) >= 3),
n as (select field_name, id, count(*) as n from r group by all),
c as (select a.field_name, a.id as id_a, b.id as id_b, count(*) as c from r a join r b on a.field_name = b.field_name and a.run = b.run and a.id < b.id group by all)
select c.field_name, id_a, id_b from c join n x on x.field_name = c.field_name and x.id = id_a join n y on y.field_name = c.field_name and y.id = id_b where c / (x.n + y.n - c) >= 0.6""",
}
SQL["p7_groups"] = f"""with recursive found as ({SQL["p7_found"]}),
e as (select field_name, id_a as a, id_b as b from found union all select field_name, id_b, id_a from found),
reach as (select distinct field_name, a as id, a as r from e union select reach.field_name, reach.id, e.b from reach join e on e.field_name = reach.field_name and e.a = reach.r),
links as (select field_name, a as id, count(*) as n_links from e group by all)
select field_name, id, min(r) as group_id, n_links from reach join links using (field_name, id) group by field_name, id, n_links"""
