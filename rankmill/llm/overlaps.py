"""Same or near-same records across splits.

Evaluation records are put into shards of bounded size, and each shard into a
compressed full-text index (``fm_index``), which is written to the shared
folder.  Training records are streamed, in the partitions in which they lie and
without a shuffle, through backward search on one shard after another: every
window of ``run`` words gives its number of occurrences in the shard.

From those counts follows which windows must be located.  A record with x
distinct windows that has a likeness of t with another shares at least t * x of
them, so at least one of any x - ceil(t * x) + 1; the rarest are taken, where
absent ones come first.  Most records lack enough windows to need no lookup at
all.  Located windows name candidates.  A candidate must have been met in as
many windows as the threshold asks for beyond those not looked up; the others
are never compared.  What remains is walked out of the index and compared on
whole sets, and neighbouring windows are merged into maximal matches and
covered spans.

The evaluation side is the stated query set: cost is training words times
shards, and nothing grows with the number of pairs that don't match.

Defined cases: NULL or empty texts and texts of fewer than ``run`` words match
nothing; equal evaluation texts are indexed once and written out at the end;
repeated rows give one pair; NULL ids and NULL splits are skipped; empty tables
give no rows.  One text longer than a shard makes a shard of its own.
"""

from __future__ import annotations

import html
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.llm.fm_index import FMIndex
from rankmill.llm.words import hash_words, likeness, run_hashes, sets_of_runs, words
from rankmill.session import Scratch
from rankmill.sources.tables import load


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    run: int = 5
    shard_chars: int = 8_000_000
    chunk_words: int = 2_000_000
    located: int = 2_000_000  # occurrences looked up at a time
    unescape: bool = False


def _tokens(text: str | None, s: Settings) -> list[str]:
    return words(html.unescape(text) if s.unescape and text else text)


def build_shards(evaluation: DataFrame, s: Settings, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(shard, blob)`` and ``(rep, id)`` of ``evaluation(id, text)``."""
    rows = evaluation.filter("id is not null and text is not null").withColumn("h", F.xxhash64("text"))
    texts = rows.groupBy("h").agg(F.min("id").alias("rep"), F.any_value("text").alias("text"))
    members = scratch.write(rows.select("h", "id").distinct().join(texts.select("h", "rep"), "h").select("rep", "id"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(chars / s.shard_chars))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = [_tokens(t, s) for t in pdf["text"]]
        h, n = hash_words([w for t in tokens for w in t]), np.fromiter(map(len, tokens), np.int64, len(tokens))
        ix = FMIndex.build(h, n, pdf["rep"].to_numpy(), sets_of_runs(*_runs(h, n, s.run)[:2])[1])
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "blob": [ix.dump()]})

    made = texts.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, blob binary")
    return scratch.write(made), members


def _read_shards(files: list[str]) -> Iterator[FMIndex]:
    for f in files:
        fs, path = pafs.FileSystem.from_uri(f)
        for batch in pq.ParquetFile(path, filesystem=fs).iter_batches(batch_size=1, columns=["blob"]):
            for blob in batch.column(0):
                yield FMIndex.load(blob.as_py())


def _matches(a: np.ndarray, b: np.ndarray, run: int) -> tuple[int, int, int]:
    """Maximal matches of two texts, from the hashes of their runs in order: their number, words covered in the first, longest."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    n = hi - lo
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    diag = np.lexsort((i, j - i))
    i, d = i[diag], (j - i)[diag]
    first = np.r_[True, (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1])]
    starts = np.flatnonzero(first)
    size = np.diff(np.r_[starts, len(i)])
    cover = np.zeros(len(a) + run, np.int64)
    np.add.at(cover, i[starts], 1)
    np.add.at(cover, i[starts] + size + run - 1, -1)
    return len(starts), int((np.cumsum(cover) > 0).sum()), int(size.max()) + run - 1


def _runs(h: np.ndarray, n: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts whose word hashes lie in a row, their number per text, and where each begins."""
    have = np.maximum(n - run + 1, 0)
    at = np.repeat(np.cumsum(n) - n - (np.cumsum(have) - have), have) + np.arange(have.sum())
    runs = run_hashes(h, run)
    return runs[at] if len(runs) else runs, have, at


class _Chunk:
    """Some training texts: words in a row, and distinct windows per text."""

    def __init__(self, ids: list[int], tokens: list[list[str]], s: Settings):
        self.ids = np.asarray(ids, np.int64)
        n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.words = hash_words([w for t in tokens for w in t])
        self.owner = np.repeat(np.arange(len(n)), n)
        self.runs, have, self.at = _runs(self.words, n, s.run)
        self.sets, self.sizes = sets_of_runs(self.runs, have)
        self.cut = np.r_[0, np.cumsum(self.sizes)]
        self.ends = np.r_[0, np.cumsum(have)]

    def search(self, ix: FMIndex, s: Settings) -> Iterator[tuple]:
        if not len(self.at):
            return
        lo, hi = ix.windows(ix.codes(self.words), s.run)
        lo, count, owner = lo[self.at], (hi - lo)[self.at], self.owner[self.at]
        there = count > 0
        lo, count, owner = lo[there], count[there], owner[there]
        order = np.lexsort((lo, count, owner))  # rarest first inside a text; equal windows next to each other
        lo, count, owner = lo[order], count[order], owner[order]
        new = np.r_[True, (lo[1:] != lo[:-1]) | (owner[1:] != owner[:-1])][: len(lo)]
        lo, count, owner = lo[new], count[new], owner[new]
        present = np.bincount(owner, minlength=len(self.ids))
        need = self.sizes - np.ceil(s.threshold * self.sizes - 1e-9).astype(np.int64) + 1 - (self.sizes - present)
        nth = np.arange(len(owner)) - (np.cumsum(present) - present)[owner]
        take = nth < need[owner]
        lo, count, owner = lo[take], count[take], owner[take]
        if not len(lo):
            return
        spare = present - np.minimum(need, present)  # windows in the shard that are not looked up
        for t, e in self._candidates(ix, lo, count, owner, spare, s):
            known = dict(zip(np.unique(e).tolist(), ix.extract(np.unique(e)), strict=True))
            runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i, j in zip(t.tolist(), e.tolist(), strict=True):
                if j not in runs:
                    r = run_hashes(known[j], s.run)
                    runs[j] = (r, np.unique(r))
                r, distinct = runs[j]
                value = likeness(self.sets[self.cut[i] : self.cut[i + 1]], distinct)
                if value >= s.threshold - 1e-12:
                    yield (int(self.ids[i]), int(ix.ids[j]), value, *_matches(self.runs[self.ends[i] : self.ends[i + 1]], r, s.run))

    def _candidates(self, ix: FMIndex, lo, count, owner, spare, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (training text, evaluation text) that can reach the threshold, a bounded number of occurrences at a time.

        A pair with sets of x and y windows shares at least t / (1 + t) * (x + y) of
        them.  At most ``spare`` of these were not looked up, so the rest must have
        been met; and neither set is smaller than t times the other.  Only pairs that
        pass are walked out of the index.
        """
        ends = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) + 1  # lookups of one text stay together
        total = np.cumsum(count)
        start = 0
        while start < len(owner):
            base = total[start - 1] if start else 0
            stop = int(ends[max(np.searchsorted(ends, np.searchsorted(total, base + s.located, "right"), "right") - 1, np.searchsorted(ends, start, "right"))])
            n, o = count[start:stop], owner[start:stop]
            rows = np.repeat(lo[start:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            text = ix.text_at(ix.locate(rows))
            # a window that occurs twice in one text counts once
            met = np.unique(np.repeat(np.arange(start, stop), n) * len(ix.starts) + text)
            pair, hits = np.unique(owner[met // len(ix.starts)] * len(ix.starts) + met % len(ix.starts), return_counts=True)
            t, e = pair // len(ix.starts), pair % len(ix.starts)
            x, y = self.sizes[t], ix.sizes[e]
            least = np.ceil(s.threshold / (1 + s.threshold) * (x + y) - 1e-9)
            ok = (np.minimum(x, y) >= s.threshold * np.maximum(x, y) - 1e-9) & (hits >= least - spare[t])
            if ok.any():
                yield t[ok], e[ok]
            start = stop


def stream(training: DataFrame, shards: DataFrame, s: Settings) -> DataFrame:
    """``(train_id, rep, likeness, n_spans, n_covered, longest)`` of ``training(id, text)`` against the shards."""
    files = sorted(shards.inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        def finish(ids: list, tokens: list) -> pd.DataFrame:
            chunk = _Chunk(ids, tokens, s)
            found = [x for ix in _read_shards(files) for x in chunk.search(ix, s)] if ids else []
            return pa.RecordBatch.from_pandas(
                pd.DataFrame(found, columns=["train_id", "rep", "likeness", "n_spans", "n_covered", "longest"]).astype({"train_id": "int64", "rep": "int64", "likeness": "float64", "n_spans": "int32", "n_covered": "int32", "longest": "int32"}),
                preserve_index=False,
            )

        ids, tokens, n = [], [], 0
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = _tokens(t, s)
                if len(w) >= s.run:
                    ids.append(i)
                    tokens.append(w)
                    n += len(w)
                if n >= s.chunk_words:
                    yield finish(ids, tokens)
                    ids, tokens, n = [], [], 0
        yield finish(ids, tokens)

    rows = training.filter("id is not null and text is not null").select("id", "text")
    return rows.mapInArrow(run, "train_id long, rep long, likeness double, n_spans int, n_covered int, longest int")


def cross_split_overlaps(training: DataFrame, evaluation: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """``(train_id, eval_id, likeness, n_spans, n_covered, longest)`` of all pairs at or above the threshold."""
    shards, members = build_shards(evaluation, s, scratch)
    found = scratch.write(stream(training, shards, s))
    pairs = found.join(members, "rep").withColumnRenamed("id", "eval_id").filter("train_id <> eval_id")
    return pairs.groupBy("train_id", "eval_id").agg(*[F.max(c).alias(c) for c in ("likeness", "n_spans", "n_covered", "longest")])


TITLE = Settings(threshold=0.7, run=1, unescape=True)
TEXT = Settings(threshold=0.7, run=3)


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "overlaps")
    splits = load(spark, folder, "splits").filter("query_id is not null and split is not null").select("query_id", F.when(F.col("split") == "train", True).when(F.col("split").isin("val", "test"), False).alias("train")).filter("train is not null")
    titles = load(spark, folder, "questions").select(F.col("id").alias("query_id"), F.col("id"), F.col("title").alias("text"))
    texts = load(spark, folder, "corpus").select(F.col("question_id").alias("query_id"), F.col("doc_id").alias("id"), "text")
    out = []
    for name, rows, s in (("title", titles, TITLE), ("text", texts, TEXT)):
        rows = scratch.write(rows.join(splits, "query_id").select("id", "text", "train"))
        pairs = cross_split_overlaps(rows.filter("train").drop("train"), rows.filter("not train").drop("train"), s, scratch)
        out.append(pairs.withColumn("field_name", F.lit(name)))
    return out[0].unionByName(out[1])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of titles or texts, one of train and one of val or test, that are nearly the same."""
    return _overlaps(spark, folder).select("field_name", F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per field, evaluation split and first tag of the evaluation question."""
    found = _overlaps(spark, folder)
    docs = load(spark, folder, "corpus").select(F.col("doc_id").alias("eval_id"), "question_id").distinct()
    text = found.filter("field_name = 'text'").join(docs, "eval_id").withColumnRenamed("question_id", "query_id")
    title = found.filter("field_name = 'title'").withColumn("query_id", F.col("eval_id"))
    tags = load(spark, folder, "questions").groupBy(F.col("id").alias("query_id")).agg(F.min(F.expr("nullif(split_part(tags, '|', 2), '')")).alias("first_tag"))
    rows = title.select("field_name", "query_id", "train_id", "eval_id", "n_covered", "longest").unionByName(text.select("field_name", "query_id", "train_id", "eval_id", "n_covered", "longest"))
    rows = rows.join(load(spark, folder, "splits").select("query_id", "split"), "query_id").join(tags, "query_id", "left")
    return rows.groupBy("field_name", "split", "first_tag").agg(
        F.count("*").alias("n_pairs"), F.countDistinct("eval_id").alias("n_evaluation"), F.countDistinct("train_id").alias("n_train"), F.sum("n_covered").alias("n_words"), F.max("longest").alias("longest"))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts}
#: The references that the tables' titles hold, for the SQL, which cannot decode all.
_DECODED = "replace(replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&amp;', '&')"
SQL: dict[str, str] = {
    "p1_found": r"""with s as (select query_id, split = 'train' as train from splits where split in ('train', 'val', 'test')),
t as (select distinct 'title' as field_name, 1 as k, id, DECODED as s, train from questions join s on s.query_id = id union all select distinct 'text', 3, doc_id, text, train from corpus join s on s.query_id = question_id),
w as (select *, regexp_extract_all(lower(s), '[\p{L}\p{N}_]+') as w, row_number() over () as tid from t where s is not null),
r as (select distinct field_name, id, tid, train, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as run from w where len(w) >= k),
n as (select tid, count(*) as n from r group by tid),
c as (select a.field_name, a.tid as ta, b.tid as tb, a.id as x, b.id as y, count(*) as c from r a join r b on a.field_name = b.field_name and a.run = b.run and a.train and not b.train group by all)
select distinct field_name, least(x, y) as id_a, greatest(x, y) as id_b from c join n p on p.tid = ta join n q on q.tid = tb where x <> y and c / (p.n + q.n - c) >= 0.7""".replace("DECODED", _DECODED),
}
