"""Evaluation passages that leak into training documents.

Documents and items are cut into all windows of ``window`` words.  A CGK random
walk embeds a window, a string over words, into one three times as long: at
step j the current word is written and the walk moves on if the word's j-th
random bit is set, so strings at a small edit distance come out at a small
Hamming distance.  ``repeats`` times, ``samples`` positions of the embedding
make a hash; windows that share one are candidates, and candidates are verified
on the words themselves by edit distance.

Windows equal word by word embed equally, so with ``max_edits`` 0 one repeat has
full recall.  With one word replaced, put in or left out, close to half of the
pairs agree in a repeat; ``repeats_for`` gives the number for a target recall.
A candidate is verified by the edit distance between the item's window and the
document's words from there on, wherever they end within ``max_edits`` words.

The items are put into shards of bounded size in the shared folder; documents
are streamed past them in the partitions in which they lie, without a shuffle.
Only verified matches leave a task, merged to one row per document and item.

Defined cases: NULL or short texts and items of fewer than ``window`` words
match nothing; NULL ids are skipped; equal items are reported each; repeated
rows count once; empty tables give no rows.
"""

from __future__ import annotations

import io
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

from rankmill.llm.words import hash_words, mix, words
from rankmill.session import Scratch
from rankmill.sources.tables import load

#: Least share of windows with one word replaced, put in or left out that agree in one repeat, measured on random windows (see the tests).
AGREE_ONE_EDIT = 0.33


def repeats_for(recall: float, max_edits: int) -> int:
    """Repeats that reach the recall for windows ``max_edits`` apart."""
    if max_edits == 0:
        return 1
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - AGREE_ONE_EDIT**max_edits)))


@dataclass(frozen=True)
class Settings:
    window: int = 12
    max_edits: int = 0
    samples: int = 5
    repeats: int = 1
    seed: int = 5
    shard_chars: int = 8_000_000
    chunk_words: int = 1_000_000


def embed_keys(h: np.ndarray, starts: np.ndarray, s: Settings, repeat: int) -> np.ndarray:
    """The sampled hash of the CGK embedding of each window that begins at ``starts``."""
    rng = np.random.default_rng([s.seed, repeat])
    length = 3 * s.window
    # one sample out of each equal part of the steps in which a walk is inside its window, so that a hash spans it
    parts = np.array_split(np.arange(min(length, 2 * s.window)), min(s.samples, length))
    wanted = np.array([rng.choice(p) for p in parts])
    bits = mix(h ^ np.uint64(rng.integers(1, 1 << 62)))
    at = np.zeros(len(starts), np.int64)
    key = np.full(len(starts), np.uint64(repeat + 1))
    for j in range(int(wanted[-1]) + 1):
        inside = at < s.window
        here = np.minimum(starts + at, len(h) - 1)
        if j in wanted:
            key = mix(key + np.where(inside, h[here], np.uint64(j)))
        at += np.where(inside, (bits[here] >> np.uint64(j % 64)) & np.uint64(1), 0).astype(np.int64)
    return key


def edit_distance(a: np.ndarray, b: np.ndarray, slack: int = 0) -> np.ndarray:
    """Word edit distance of each row of ``a`` from the same row of ``b``, whose last words, ``slack`` on each side of the length of ``a``, may be left out."""
    n, w = a.shape
    row = np.tile(np.arange(b.shape[1] + 1, dtype=np.int16), (n, 1))
    for i in range(1, w + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, b.shape[1] + 1):
            new[:, j] = np.minimum(np.minimum(row[:, j] + 1, new[:, j - 1] + 1), row[:, j - 1] + (a[:, i - 1] != b[:, j - 1]))
        row = new
    return row[:, -1] if not slack else row[:, max(w - slack, 0) :].min(axis=1)


def _window_starts(counts: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window, and which text it is of, for texts in a row."""
    have = np.maximum(counts - w + 1, 0)
    starts = np.cumsum(counts) - counts
    at = np.repeat(starts - (np.cumsum(have) - have), have) + np.arange(have.sum())
    return at, np.repeat(np.arange(len(counts)), have)


def build_shards(items: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """Shards of ``items(id, text)``: words and, per repeat, windows in order of their hash."""
    rows = items.filter("id is not null and text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(chars / s.shard_chars))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = [words(t) for t in pdf["text"]]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        h = hash_words([w for t in tokens for w in t])
        at, owner = _window_starts(counts, s.window)
        arrays = {"words": h, "ids": pdf["id"].to_numpy(np.int64), "counts": counts, "at": at, "owner": owner}
        for r in range(s.repeats):
            key = embed_keys(h, at, s, r) if len(at) else np.zeros(0, np.uint64)
            order = np.argsort(key, kind="stable")
            arrays |= {f"key{r}": key[order], f"order{r}": order}
        to = io.BytesIO()
        np.savez(to, **arrays)
        return pd.DataFrame({"shard": [0], "blob": [to.getvalue()]})

    by = F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int")
    return scratch.write(rows.select("id", "text").distinct().withColumn("shard", by).groupBy("shard").applyInPandas(build, "shard int, blob binary"))


def _read(files: list[str]) -> Iterator[dict]:
    for f in files:
        fs, path = pafs.FileSystem.from_uri(f)
        for batch in pq.ParquetFile(path, filesystem=fs).iter_batches(batch_size=1, columns=["blob"]):
            for blob in batch.column(0):
                with np.load(io.BytesIO(blob.as_py())) as z:
                    yield {k: z[k] for k in z.files}


def _search(h: np.ndarray, counts: np.ndarray, shard: dict, s: Settings) -> pd.DataFrame:
    """Verified window matches of texts in a row against a shard: document window, item window, edits."""
    at, owner = _window_starts(counts, s.window)
    got, ends = [], np.cumsum(counts)
    step = np.arange(s.window)
    for r in range(s.repeats):
        key = embed_keys(h, at, s, r)
        lo = np.searchsorted(shard[f"key{r}"], key, "left")
        n = np.searchsorted(shard[f"key{r}"], key, "right") - lo
        hit = np.flatnonzero(n)
        for part in np.array_split(hit, max(1, int(n[hit].sum()) // 200_000)):
            m = n[part]
            doc = np.repeat(part, m)
            item = shard[f"order{r}"][np.repeat(lo[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            a, b = h[at[doc][:, None] + step], shard["words"][shard["at"][item][:, None] + step]
            edits = (a != b).sum(axis=1).astype(np.int16)  # words replaced: an upper bound of the edit distance
            far = np.flatnonzero(edits > s.max_edits) if s.max_edits else edits[:0]
            if len(far):  # with words put in or left out the document's stretch is longer or shorter
                reach = at[doc[far]][:, None] + np.arange(s.window + s.max_edits)
                inside = reach < ends[owner[doc[far]]][:, None]  # no words of the next text
                longer = np.where(inside, h[np.minimum(reach, len(h) - 1)], np.uint64(0))
                edits[far] = edit_distance(b[far], longer, s.max_edits)
            ok = edits <= s.max_edits
            got.append(pd.DataFrame({"doc": owner[doc][ok], "at": at[doc][ok], "item": shard["owner"][item][ok], "iat": shard["at"][item][ok], "edits": edits[ok]}))
    return pd.concat(got).drop_duplicates(["at", "iat"])


def _merge(found: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """One row per document and item: windows, words of the longest exact run (0: none), least edits."""
    f = found.sort_values(["doc", "item", "at", "iat"])
    exact = f[f["edits"] == 0].assign(d=lambda x: x["at"] - x["iat"]).sort_values(["doc", "item", "d", "at"])
    new = (exact[["doc", "item", "d"]] != exact[["doc", "item", "d"]].shift()).any(axis=1) | (exact["at"] != exact["at"].shift() + 1)
    runs = exact.groupby(["doc", "item", new.cumsum().rename("run")]).size().groupby(["doc", "item"]).max() + s.window - 1
    out = f.groupby(["doc", "item"]).agg(n_windows=("at", "nunique"), edits=("edits", "min"))
    return out.join(runs.rename("longest")).fillna({"longest": 0}).reset_index()


def find_leaks(documents: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """``(doc_id, item_id, n_windows, longest, edits)`` for ``documents(id, text)`` and ``items(id, text)``."""
    scratch = Scratch(documents.sparkSession, "leaks")
    files = sorted(build_shards(items, s, scratch).inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(ids: list, tokens: list) -> Iterator[pa.RecordBatch]:
            counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
            h = hash_words([w for t in tokens for w in t])
            for shard in _read(files) if tokens else ():
                if not len(shard["at"]):
                    continue
                found = _search(h, counts, shard, s)
                if len(found):
                    m = _merge(found, s)
                    yield pa.RecordBatch.from_pandas(pd.DataFrame({
                        "doc_id": np.asarray(ids, np.int64)[m["doc"]], "item_id": shard["ids"][m["item"]], "n_windows": m["n_windows"].astype("int32"),
                        "longest": m["longest"].astype("int32"), "edits": m["edits"].astype("int32"),
                    }), preserve_index=False)

        ids, tokens, n = [], [], 0
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words(t)
                if len(w) >= s.window:
                    ids.append(i)
                    tokens.append(w)
                    n += len(w)
                if n >= s.chunk_words:
                    yield from finish(ids, tokens)
                    ids, tokens, n = [], [], 0
        yield from finish(ids, tokens)

    rows = documents.filter("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), "text")
    found = rows.mapInArrow(run, "doc_id long, item_id long, n_windows int, longest int, edits int")
    return found.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("longest").alias("longest"), F.min("edits").alias("edits"))


EXACT = Settings()
#: Windows in which one word was replaced, put in or left out count too.
NEAR = Settings(max_edits=1, repeats=repeats_for(0.99, 1))


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs, load(spark, folder, "eval_passages").select(F.col("item_id").alias("id"), F.col("passage").alias("text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an item's passage."""
    return find_leaks(*_inputs(spark, folder), EXACT).select("item_id", "doc_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items that leaked exactly or but for one word, with the number of documents."""
    found = find_leaks(*_inputs(spark, folder), NEAR)
    items = load(spark, folder, "eval_passages").select("item_id", "split", "lang").distinct()
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.count_if(F.col("longest") > 0).alias("n_exact"), F.max("longest").alias("longest")).join(items, "item_id")


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
_GRAMS = "unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i : i + 11], ' '))) as g"
SQL: dict[str, str] = {
    "p8_found": rf"""with d as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as w from documents), p as (select item_id, regexp_extract_all(lower(passage), '[\p{{L}}\p{{N}}_]+') as w from eval_passages),
x as (select distinct doc_id, {_GRAMS} from d where len(w) >= 12), y as (select distinct item_id, {_GRAMS} from p where len(w) >= 12)
select distinct item_id, doc_id from x join y using (g)""",
}
