"""Exact substring dedup: every byte under a LENGTH-byte string that starts elsewhere too.

Blockwise suffix sorting, one suffix bucket at a time, adapted to Spark:

* Cover sample. Of every window of LENGTH bytes the position of its least GRAM-byte hash
  (the last one of equals) is sampled. Two equal windows sample the same place, so all
  windows of a bucket are aligned at their sample; this is a difference cover whose
  offset is known from content (a synchronizing set). It takes 2 positions in
  LENGTH - GRAM + 2, where a cover by residues takes 22 in 337 and leaves the offset to
  each pair. Per sample the run of windows that chose it is its context.
* Ranks. A sample's rank is the hash of its gram; a rank that occurs once in the corpus
  ends the matter for all its windows. Ties of whole contexts are resolved by the
  contexts' hash: a context that occurs twice is repeated from end to end.
* Buckets. Contexts of one rank that differ are sorted, bucket by bucket, window by
  window; memory holds one bucket. A bucket of over ``bucket_limit`` contexts is dealt
  out by window instead, as rows that a combining aggregation counts.

Nothing is sampled away: the result is that of comparing all windows. Equality goes by
64-bit hashes (of gram, context and window, each within the other), texts are named by
128 bits.

Defined results: a null or empty text has no bytes; texts under LENGTH bytes lose none;
matches never cross texts; repeated rows are copies of each other and lose everything if
long enough. Bytes are cut anywhere, so the kept bytes need not be UTF-8. Only the text
column is read and only k1, k2, spans and kept come out, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import kernel
from lumenframe.llm.common import hex_sha256, stash, table

LENGTH = 400
GRAM = 200
BUCKET_LIMIT = 8192
_LOW = np.uint64((1 << 28) - 1)
_HIGH = np.uint64((1 << 64) - (1 << 28))


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    heads = np.minimum.accumulate(blocks, axis=1).ravel()
    tails = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tails[: n - width + 1], heads[width - 1 : n])


def contexts(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each sampled place: gram hash, context hash, first and last window start."""
    data = np.frombuffer(text, dtype=np.uint8)
    prefix = kernel.Prefix(data)
    at = np.arange(len(data) - gram + 1)
    hashes = prefix.hash(at, at + gram)
    least = _sliding_min((hashes & _HIGH) | (_LOW - at.astype(np.uint64)), length - gram + 1)
    chosen = (_LOW - (least & _LOW)).astype(np.int64)
    cut = np.flatnonzero(np.diff(chosen)) + 1
    lo = np.concatenate([[0], cut])
    hi = np.concatenate([cut, [len(chosen)]]) - 1
    place = chosen[lo]
    whole = prefix.hash(lo, hi + length) ^ kernel.mix64((place - lo).astype(np.uint64))
    return hashes[place], whole, lo, hi, place


def _samples(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(k1, k2, g, c, lo, hi, rel) of each sampled place; rel: its distance from lo."""
    schema = "k1 long, k2 long, g long, c long, lo int, hi int, rel int"
    names = ["k1", "k2", "g", "c", "lo", "hi", "rel"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                batch = whole.slice(first, 512)
                got, counts = [], []
                for x in batch.column(2):
                    text = _bytes(x)
                    if len(text) >= length:
                        got.append(contexts(text, length, gram))
                    counts.append(len(got[-1][0]) if len(text) >= length else 0)
                if got:
                    g, c, lo, hi, place = (np.concatenate(parts) for parts in zip(*got, strict=True))
                    keys = (np.repeat(batch.column(i).to_numpy(), counts) for i in (0, 1))
                    columns = [*keys, g.view(np.int64), c.view(np.int64), lo.astype(np.int32), hi.astype(np.int32), (place - lo).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names)

    return docs.mapInArrow(run, schema)


def _window_hashes(text: bytes, n: int, length: int) -> np.ndarray:
    at = np.arange(n)
    return kernel.Prefix(np.frombuffer(text, dtype=np.uint8)).hash(at, at + length)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def sort_bucket(rows: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """rows: (context hash, occurrences, rel, bytes) of one bucket. For each context that
    occurs once: the runs of its windows that stand in another context as well."""
    hashes, shifts, owners = [], [], []
    for i, (_, _, rel, text) in enumerate(rows):
        n = len(text) - length + 1
        hashes.append(_window_hashes(text, n, length))
        shifts.append(rel - np.arange(n))
        owners.append(np.full(n, i))
    h = np.concatenate(hashes) ^ kernel.mix64(np.concatenate(shifts).astype(np.uint64))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    owner = np.concatenate(owners)
    out = []
    ends = np.cumsum([len(x) for x in hashes])
    for i in np.unique(owner[twice]):
        if rows[i][1] == 1:
            out.append((rows[i][0], _runs(twice[ends[i] - len(hashes[i]) : ends[i]])))
    return out


RUNS = "array<struct<first:int,last:int>>"


def _sorted_buckets(rows: DataFrame, length: int) -> DataFrame:
    """(g, c, runs) of contexts (g, c, n, rel, context) that arrive bucket by bucket."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            got = sort_bucket(held, length) if len(held) > 1 else []
            runs = [[{"first": a, "last": b} for a, b in r] for _, r in got]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(got), pa.int64()), pa.array([c for c, _ in got], pa.int64()), pa.array(runs, kind)], ["g", "c", "runs"])

        for batch in batches:
            for g, c, n, rel, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if g != now:
                    if held:
                        yield done()
                    now, held = g, []
                held.append((c, n, rel, text))
        if held:
            yield done()

    dealt = rows.repartition("g").sortWithinPartitions("g", "c")
    return dealt.select("g", "c", "n", "rel", "context").mapInArrow(run, f"g long, c long, runs {RUNS}")


def _dealt_windows(rows: DataFrame, length: int) -> DataFrame:
    """The same for buckets that are too large for a task: a row per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, c, n, rel, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                m = len(text) - length + 1
                at = np.arange(m)
                w = _window_hashes(text, m, length) ^ kernel.mix64((rel - at).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, v)) for v in (g, c, n)] + [pa.array(at.astype(np.int32)), pa.array(w.view(np.int64))], ["g", "c", "n", "at", "w"]
                )

    each = stash(rows.select("g", "c", "n", "rel", "context").mapInArrow(run, "g long, c long, n long, at int, w long"), name="windows")
    twice = each.groupBy("g", "w").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("g", "w")
    hit = each.filter("n = 1").join(twice, ["g", "w"])
    runs = F.array_sort(F.collect_list(F.struct(F.col("at").alias("first"), F.col("at").alias("last"))))
    return hit.groupBy("g", "c").agg(runs.alias("runs"))


def repeated_spans(df: DataFrame, *, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Per distinct text that holds a repeat: its name (k1, k2), the removed spans
    (array of start and end bytes, sorted, apart from each other) and the kept bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(5), text).alias("k2"), text.alias("t"))
    samples = _samples(docs, length, gram)
    ranks = samples.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("g")
    tied = stash(samples.join(ranks, "g"), name="tied")
    whole = stash(tied.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "lo", "hi", "rel")).alias("at")), name="contexts")
    keys = tied.select("k1", "k2").distinct()
    texts = stash(docs.join(keys, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), name="texts")

    sizes = whole.groupBy("g").agg(F.count(F.lit(1)).alias("b")).filter("b > 1")
    differing = whole.join(sizes, "g").select("at.k1", "at.k2", F.struct("g", "c", "n", "b", "at.lo", "at.hi", "at.rel").alias("x"))
    asked = differing.groupBy("k1", "k2").agg(F.collect_list("x").alias("xs"))
    fetched = asked.join(texts, ["k1", "k2"]).select("xs", "t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for first in range(0, whole_batch.num_rows, 64):
                batch = whole_batch.slice(first, 64)
                out = []
                for xs, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    body = _bytes(t)
                    out += [(x["g"], x["c"], x["n"], x["b"], x["rel"], body[x["lo"] : x["hi"] + length]) for x in xs]
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
                columns = zip(*out, strict=True) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], ["g", "c", "n", "b", "rel", "context"])

    bodies = fetched.mapInArrow(cut, "g long, c long, n long, b long, rel int, context binary")
    bodies = stash(bodies, name="bodies")
    partly = _sorted_buckets(bodies.filter(F.col("b") <= bucket_limit), length)
    oversize = bodies.filter(F.col("b") > bucket_limit)
    if not oversize.isEmpty():
        partly = partly.union(_dealt_windows(oversize, length))
    fully = whole.filter("n > 1").select("g", "c", F.lit(None).cast(RUNS).alias("runs"))
    decided = fully.union(partly)

    hits = tied.join(decided, ["g", "c"]).select(
        "k1", "k2", "lo", F.explode(F.coalesce("runs", F.array(F.struct(F.lit(0).alias("first"), (F.col("hi") - F.col("lo")).alias("last"))))).alias("r")
    )
    spans = hits.select("k1", "k2", F.struct((F.col("lo") + F.col("r.first")).alias("s"), (F.col("lo") + F.col("r.last") + length).alias("e")).alias("x"))
    merged = spans.groupBy("k1", "k2").agg(F.collect_set("x").alias("xs")).join(texts, ["k1", "k2"]).select("k1", "k2", "xs", "t")
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for first in range(0, whole_batch.num_rows, 128):
                batch = whole_batch.slice(first, 128)
                all_spans, kept = [], []
                for xs, t in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                    body, found = _bytes(t), []
                    for s, e in sorted((x["s"], x["e"]) for x in xs):
                        if found and s <= found[-1]["stop"]:
                            found[-1]["stop"] = max(found[-1]["stop"], e)
                        else:
                            found.append({"start": s, "stop": e})
                    edges = [0, *(v for f in found for v in (f["start"], f["stop"])), len(body)]
                    all_spans.append(found)
                    kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(all_spans, span), pa.array(kept, pa.binary())], ["k1", "k2", "spans", "kept"])

    return merged.mapInArrow(remove, "k1 long, k2 long, spans array<struct<start:int,stop:int>>, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = repeated_spans(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    found = cut.select("k1", "k2", removed.alias("_removed"), F.size("spans").cast("long").alias("_spans"), hex_sha256(F.col("kept")).alias("_sha"))
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(5), text).alias("k2"), hex_sha256(text).alias("whole")
    )
    zero = F.lit(0).cast("long")
    return base.join(found, ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("_removed", zero).alias("n_removed"),
        F.coalesce("_spans", zero).alias("n_spans"),
        F.coalesce("_sha", "whole").alias("kept_sha256"),
    )
