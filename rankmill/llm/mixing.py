"""Mixing sources to target weights, in tokens of a public tokenizer.

Equal texts are one unit that belongs to all sources in which it occurs.  Units
are aggregated by membership pattern; a minimum-cost flow routes each pattern's
tokens to the quotas of its sources.  The r-th use of a token costs more than
the one before (convex), so repetition is spread and avoided where another
source's surplus serves; no arc exceeds the source's cap.  Unless a total is
given, it is the largest at which every source that has documents still reaches
its quota, found by maximum flows that shrink to the tightest set of sources.
With a larger total, a source that lacks tokens falls short and the report says
so.

Units are then chosen along a seeded order: each pattern's units lie on a line
of tokens, a source takes a stretch of as many tokens as flow to it, and a unit
is used as often as its start falls into the stretch, going round.  Positions
are prefix sums over hash buckets, so neither a source nor a pattern with a
third of all rows is sorted in one task; only the table of patterns (at most
one row per combination of sources that occurs) reaches the driver.

Defined cases: NULL texts and NULL sources are left out; sources without a
target are not used; sources without documents get nothing; repeated rows of
one text in one source are one unit, named by its least id in that source; a
document of several sources is used in all of them together no more often than
the greatest of their caps allows; empty texts have no tokens and are not used;
empty tables give the targets with zero shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankmill.session import Scratch
from rankmill.sources.tables import load


@dataclass(frozen=True)
class Settings:
    tokenizer: str = "/opt/tokenizers/byte_bpe_50k.json"
    total: float | None = None  # tokens of the mixture; the largest that meets all quotas if not given
    seed: int = 7
    bucket_rows: int = 50_000


@cache
def _tokenizer(path: str):
    import os

    if not os.path.exists(path):  # it came with the job
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_counts(texts: DataFrame, path: str) -> DataFrame:
    """Adds ``tokens`` to a table with ``text``, which is dropped; the tokenizer's file goes to the executors, and a text met again in a task is not counted again."""
    keep = [f for f in texts.schema.fields if f.name != "text"]
    texts.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(path)
        known: dict[bytes, int] = {}
        for pdf in batches:
            names = [blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in pdf["text"]]
            new = {k: x for k, x in zip(names, pdf["text"], strict=True) if k not in known}
            todo = list(new)
            for at in range(0, len(todo), 256):
                part = todo[at : at + 256]
                known.update(zip(part, (len(e.ids) for e in t.encode_batch([new[k] for k in part], add_special_tokens=False)), strict=True))
            yield pdf.drop(columns="text").assign(tokens=[known[k] for k in names])
            if len(known) > 200_000:
                known.clear()

    return texts.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", tokens long")


def min_cost_flow(n: int, arcs: list[tuple[int, int, float, float]], source: int, sink: int) -> list[float]:
    """Flow on each arc ``(from, to, capacity, cost)`` of a maximum flow of least cost, by successive shortest paths."""
    to, cap, cost, head = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in arcs:
        head[u].append(len(to))
        to.append(v), cap.append(float(c)), cost.append(w)
        head[v].append(len(to))
        to.append(u), cap.append(0.0), cost.append(-w)
    eps = 1e-6
    while True:
        dist, prev, inside = [math.inf] * n, [-1] * n, [False] * n
        dist[source] = 0.0
        queue = [source]
        while queue:
            u = queue.pop(0)
            inside[u] = False
            for e in head[u]:
                if cap[e] > eps and dist[u] + cost[e] < dist[to[e]] - 1e-12:
                    dist[to[e]], prev[to[e]] = dist[u] + cost[e], e
                    if not inside[to[e]]:
                        inside[to[e]] = True
                        queue.append(to[e])
        if math.isinf(dist[sink]):
            return [cap[2 * i + 1] for i in range(len(arcs))]
        path, v = [], sink
        while v != source:
            path.append(prev[v])
            v = to[prev[v] ^ 1]
        f = min(cap[e] for e in path)
        for e in path:
            cap[e] -= f
            cap[e ^ 1] += f


def largest_total(patterns: list[tuple[tuple[str, ...], int]], targets: dict[str, tuple[float, int]]) -> float:
    """The greatest total at which all sources that occur in ``patterns`` reach their quotas.

    A maximum flow that fails leaves a set of sources whose patterns are used up;
    the total that just serves this set is tried next (Newton's steps, each with a
    smaller set ratio), so the number of flows is at most that of the sources.
    """
    have = sorted({s for m, _ in patterns for s in m})
    share = sum(targets[s][0] for s in have)
    if not have:
        return 0.0
    n, sink = 2 + len(patterns) + len(have), 1 + len(patterns) + len(have)
    node = {s: 1 + len(patterns) + i for i, s in enumerate(have)}
    inner = []
    for i, (members, tokens) in enumerate(patterns):
        inner.append((0, 1 + i, float(tokens * max(targets[s][1] for s in members)), 0.0))
        inner += [(1 + i, node[s], float(tokens * targets[s][1]), 0.0) for s in members]
    total = sum(c for u, _, c, _ in inner if u == 0) / share
    while True:
        arcs = inner + [(node[s], sink, targets[s][0] * total, 0.0) for s in have]
        flow = min_cost_flow(n, arcs, 0, sink)
        if sum(f for f, (_, v, *_) in zip(flow, arcs, strict=True) if v == sink) >= share * total * (1 - 1e-9) - 1e-3:
            return total
        reach, todo = {0}, [0]  # nodes that more flow could still reach
        while todo:
            u = todo.pop()
            for f, (a, b, c, _) in zip(flow, arcs, strict=True):
                for x, y, left in ((a, b, c - f), (b, a, f)):
                    if x == u and y not in reach and left > 1e-6:
                        reach.add(y)
                        todo.append(y)
        short = [s for s in have if node[s] not in reach]
        new = sum(c for u, v, c, _ in inner if u in reach and v not in reach) / sum(targets[s][0] for s in short) if short else total
        if not new < total * (1 - 1e-12):
            return total
        total = new


def plan(patterns: list[tuple[tuple[str, ...], int]], targets: dict[str, tuple[float, int]], total: float) -> dict[tuple[int, str], float]:
    """Tokens that flow from each pattern (by position) to each of its sources."""
    sources = sorted(targets)
    node = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    sink = 1 + len(patterns) + len(sources)
    arcs, names = [], []
    for i, (members, tokens) in enumerate(patterns):
        most = max(targets[s][1] for s in members)
        for r in range(most):
            arcs.append((0, 1 + i, tokens, 2.0 * r))
            names.append(None)
        for s in members:
            for r in range(targets[s][1]):
                arcs.append((1 + i, node[s], tokens, float(r)))
                names.append((i, s))
    for s in sources:
        arcs.append((node[s], sink, targets[s][0] * total, 0.0))
        names.append(None)
    out: dict[tuple[int, str], float] = {}
    for name, f in zip(names, min_cost_flow(sink + 1, arcs, 0, sink), strict=True):
        if name and f > 0:
            out[name] = out.get(name, 0.0) + f
    return out


def mix(documents: DataFrame, targets: DataFrame, s: Settings | None = None) -> DataFrame:
    """``(doc_id, source, uses, tokens)`` of the documents chosen; ``tokens`` are those of one use.

    ``documents(doc_id, text, source)``; ``targets(source, target_share, max_repeats)``.
    """
    s = s or Settings()
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.filter("source is not null and target_share > 0 and max_repeats > 0").collect()}  # the targets are a parameter
    named = documents.filter("text is not null and source is not null and doc_id is not null").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    counted = token_counts(named.filter(F.col("source").isin(*wanted) if wanted else F.lit(False)).select("doc_id", "source", F.xxhash64("text").alias("h"), F.xxhash64(F.reverse("text")).alias("g"), "text"), s.tokenizer)
    own = counted.groupBy("h", "g", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens")).filter("tokens > 0")
    units = own.groupBy("h", "g").agg(F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("members"), F.max("tokens").alias("tokens"))  # at most a member per target
    units = scratch.write(units.select("members", "tokens", F.concat_ws("\x1f", "members.source").alias("pattern"), F.xxhash64(F.lit(s.seed), "h", "g").alias("order"), F.col("members")[0]["doc_id"].alias("doc_id")))
    rows = units.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).orderBy("pattern").collect()
    patterns = [(tuple(r["pattern"].split("\x1f")), r["tokens"]) for r in rows]
    total = s.total or largest_total(patterns, wanted)
    flow = plan(patterns, wanted, total)
    stretches, at = [], {}
    for (i, name), f in sorted(flow.items()):
        lo = at.get(i, 0.0)
        at[i] = lo + f
        stretches.append((rows[i]["pattern"], name, lo, lo + f, float(rows[i]["tokens"])))
    ways = spark.createDataFrame(stretches, "pattern string, source string, lo double, hi double, length double")
    buckets = max(64, math.ceil(sum(r["n"] for r in rows) / s.bucket_rows))
    placed = units.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sums = placed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n"))
    ahead = sums.select("pattern", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.sum("tokens").over(Window.partitionBy("pattern", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    placed = placed.withColumn("within", within).join(ahead, ["pattern", "bucket"]).withColumn("start", (F.col("ahead") + F.col("within")).cast("double"))
    fall = lambda x: F.greatest(F.ceil((x - F.col("start")) / F.col("length")), F.lit(0))
    used = placed.join(F.broadcast(ways), "pattern").withColumn("uses", (fall(F.col("hi")) - fall(F.col("lo"))).cast("int"))
    own_id = F.element_at(F.filter("members", lambda m: m["source"] == F.col("source")), 1)["doc_id"]
    return used.filter("uses > 0").select(own_id.alias("doc_id"), "source", "uses", "tokens")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target and actual share, documents, tokens and mean uses."""
    per = chosen.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("tokens") * F.col("uses")).alias("n_tokens"), F.max("uses").alias("most_uses"))
    joined = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").fillna(0, ["n_docs", "n_tokens", "most_uses"])
    total = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))  # one row per target
    return joined.withColumn("actual_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(0.0))


def _chosen(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = load(spark, folder, "mix_targets")
    return mix(load(spark, folder, "documents").select("doc_id", "text", "source"), targets), targets


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source, and how often its documents are used."""
    return shares(*_chosen(spark, folder))


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture, for which source and how often."""
    return _chosen(spark, folder)[0]


def p9_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of every mixture, per source: documents are its own, none is used too often, and the share is met within a document where there are any."""
    chosen, targets = _chosen(spark, folder)
    chosen = Scratch(spark, "audit").write(chosen)
    docs = load(spark, folder, "documents").select("doc_id", F.col("source").alias("of"), (F.length("text") > 0).alias("some"))
    per = chosen.join(docs, "doc_id", "left").join(F.broadcast(targets.select("source", "max_repeats")), "source").groupBy("source").agg(
        F.count_if(F.expr("of is null or of <> source")).alias("n_foreign"), F.count_if(F.expr("uses > max_repeats")).alias("n_over"), F.sum(F.col("uses") * F.col("tokens")).alias("n_tokens"), F.max("tokens").alias("most"))
    have = docs.filter("some").select(F.col("of").alias("source")).distinct().withColumn("has_documents", F.lit(True))
    rows = targets.join(F.broadcast(have), "source", "left").join(F.broadcast(per), "source", "left").withColumn("has_documents", F.coalesce("has_documents", F.lit(False)))  # a row per target
    one = Window.partitionBy(F.lit(0))
    total = F.sum("n_tokens").over(one) / F.sum(F.when(F.col("has_documents"), F.col("target_share"))).over(one)
    met = F.coalesce(F.abs(F.col("n_tokens") - F.col("target_share") * total) <= 2 * F.max("most").over(one), F.lit(False))
    zero = F.lit(0).cast("long")
    return rows.select("source", "has_documents", F.coalesce("n_foreign", zero).alias("n_foreign"), F.coalesce("n_over", zero).alias("n_over"), met.alias("is_met"))


QUERIES = {"p9_selection": p9_selection, "p9_shares": p9_shares, "p9_audit": p9_audit}
SQL: dict[str, str] = {
    "p9_audit": """select m.source, d.source is not null as has_documents, 0::bigint as n_foreign, 0::bigint as n_over, d.source is not null as is_met
from mix_targets m left join (select distinct source from documents where length(text) > 0) d using (source)""",
}
