"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds its 5-word shingles (64-bit hashes). Documents with equal sets
form a class first; only classes go on, so copies never meet in a bucket. A class has
``COORDINATES`` minwise tokens. Independent trees branch classes by them:

* the root of tree t sends a class to the child named by its t-th token;
* a node with at most ``SMALL`` classes is compared exhaustively;
* a larger node is branched again by one or, in a share of nodes, two further tokens,
  chosen by a hash of the node's path, so that a pair at the threshold is expected to
  go on in as many children as it came from; repeated trees give the recall;
* a node still large at ``DEPTH`` holds classes that agree in many tokens. It gives a
  star from its most typical class, which absorbs a group of near copies at once. Members
  that the star leaves apart can link with another member only if they share enough of
  the shingles by which they differ from the centre; these pairs are found exactly from
  the rarest of those (``links.beyond_centers``), so no link of a node is lost and pairs
  don't grow with the square of a group.

Pairs whose tokens agree too rarely for the threshold are dropped (a pair at the
threshold stays with a chance over 1 - 1e-4), the others are confirmed on full sets.
Links are joined by distributed components.

Recall for one pair at similarity 0.85: it meets at a root's child of one of TREES = 10
trees with 1 - 0.15^10 = 1 - 6e-9; where those children are large, branching keeps the
expected number of shared nodes, and over ten trees a miss stays under 1e-3; such a
pair is usually joined through others of its group as well. The share of nodes that are
branched twice follows the threshold; at 0.8 a root is missed with 0.2^10 = 1e-7.

Defined results: null, empty and blank texts have no set, link with nothing and are
kept. Null ids: a component takes its least id that isn't null. Rows with equal sets
are one class, repeated rows too; ``kept`` marks rows whose id is the component's. A
very long text is worked on whole, by itself, in one task's memory. An empty table gives
an empty result. Only the id and text columns are read and only the four named columns
come out, so other columns, whatever their names, can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm import kernel
from lumenframe.llm.common import scratch, stash, table
from lumenframe.llm.links import bucket_components

COORDINATES = 40
TREES = 10
DEPTH = 6
#: A node of at most so many classes is compared exhaustively.
SMALL = 10
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
TOKEN_BYTES = 4


def _least_agreement(percent: int) -> int:
    """Tokens that agree at the threshold, less 4.2 deviations."""
    p = percent / 100
    return max(1, int(COORDINATES * p - 4.2 * (COORDINATES * p * (1 - p)) ** 0.5))


def _twice(percent: int) -> int:
    """The percentage of nodes that are branched twice: 1 / threshold - 1."""
    return -(-100 * (100 - percent) // percent)


def _utf8(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def signatures(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, the set's digest (d1, d2) and tokens (binary)."""
    schema = T.StructType(
        [
            df.schema[id_col],
            T.StructField("n_shingles", T.LongType()),
            T.StructField("d1", T.LongType()),
            T.StructField("d2", T.LongType()),
            T.StructField("tokens", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = kernel.constants(COORDINATES, 5) | np.uint64(1)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                sets = list(kernel.shingle_sets(_utf8(batch.column(1))))
                n = np.array([len(s) for s in sets], dtype=np.int64)
                d1, d2, tokens = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), [b""] * len(n)
                full = np.flatnonzero(n)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    d1[full] = np.add.reduceat(kernel.mix64(every ^ np.uint64(0x1234567)), starts)
                    d2[full] = np.add.reduceat(kernel.mix64(every + np.uint64(0x7654321)), starts)
                    least = np.empty((len(full), COORDINATES), dtype="<u4")
                    for k in range(COORDINATES):
                        least[:, k] = np.minimum.reduceat(every * factors[k], starts) >> np.uint64(32)
                    for row, i in enumerate(full):
                        tokens[i] = least[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(tokens, pa.binary())],
                    schema.names,
                )

    return df.select(id_col, text_col).mapInArrow(run, schema)


def _token(k):
    return F.substring("tokens", k * TOKEN_BYTES + 1, TOKEN_BYTES) if isinstance(k, int) else F.substr("tokens", k * TOKEN_BYTES + 1, F.lit(TOKEN_BYTES))


def tree_nodes(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Members (bucket, id, n) of all nodes to be compared. classes: (cid, tokens)."""
    roots = F.array(*(F.xxhash64(F.lit(t), _token(t)) for t in range(TREES)))
    level = classes.select(F.explode(roots).alias("bucket"), F.col("cid").alias("id"))
    tokens = classes.select(F.col("cid").alias("id"), "tokens")
    done = None
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = stash(level.join(sizes, "bucket"), name="nodes")
        ready = shared if depth == DEPTH else shared.filter(F.col("n") <= SMALL)
        ready = ready.select("bucket", "id", "n")
        done = ready if done is None else done.union(ready)
        if depth == DEPTH:
            break
        large = shared.filter(F.col("n") > SMALL).drop("n")
        if large.isEmpty():
            break
        if depth == 1:
            # from here on the tokens go with the members of large nodes
            large = large.join(tokens, "id")
        free = COORDINATES - TREES
        path = F.xxhash64("bucket", F.lit(depth))
        one = F.pmod(path, F.lit(free)) + TREES
        step = F.pmod(F.shiftright(path, 16), F.lit(free - 1)) + 1
        two = F.pmod(one - TREES + step, F.lit(free)) + TREES
        again = F.pmod(F.shiftright(path, 40), F.lit(100)) < _twice(percent)
        chosen = F.explode(F.when(again, F.array(one, two)).otherwise(F.array(one)))
        branched = large.withColumn("k", chosen)
        level = branched.select(F.xxhash64("bucket", "k", _token(F.col("k").cast("int"))).alias("bucket"), "id", "tokens")
    return done


def _agreeing(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs with tokens that agree in at least ``least`` coordinates."""
    one = classes.select(F.col("cid").alias("a"), F.col("tokens").alias("ta"), F.col("n_shingles").alias("na"))
    two = classes.select(F.col("cid").alias("b"), F.col("tokens").alias("tb"), F.col("n_shingles").alias("nb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(i)), dtype="<u4").reshape(-1, COORDINATES) for i in (2, 3))
            close = (x == y).sum(1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(close)) for i in (0, 1)], ["a", "b"])

    return joined.mapInArrow(run, schema)


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id and kept."""
    with scratch(df.sparkSession) as keep:
        rows = keep(stash(signatures(df, id_col=id_col, text_col=text_col).withColumn("cid", F.xxhash64("n_shingles", "d1", "d2")), name="signatures"))
        full = rows.filter("n_shingles > 0")
        copies = full.groupBy("cid").agg(F.count(F.lit(1)).alias("weight"), F.min(id_col).alias("least"), F.first(F.struct("tokens", "n_shingles", F.col(id_col).alias("sample_id"))).alias("one"))
        classes = stash(copies.select("cid", "weight", "least", "one.*"), name="classes")
        weights = classes.select(F.col("cid").alias("id"), "weight")
        nodes = tree_nodes(classes, percent)
        seen = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("seen"))
        nodes = stash(nodes.join(seen.join(weights, "id"), "id"), name="members")

        def verify(pairs: DataFrame) -> DataFrame:
            close = stash(_agreeing(pairs, classes, _least_agreement(percent)), name="close")
            wanted = close.select(F.col("a").alias("id")).union(close.select(F.col("b").alias("id"))).distinct()
            return _confirmed(close, stash(sets(wanted), name="sets"), percent)

        def sets(wanted: DataFrame) -> DataFrame:
            ids = wanted.join(classes.select(F.col("cid").alias("id"), "sample_id"), "id").select(F.col("id").alias("cid"), F.col("sample_id").alias(id_col))
            return _sets_of(df.select(id_col, text_col), ids, id_col)

        found, _ = bucket_components(nodes, verify, sets, percent=percent, small=SMALL)
        placed = classes.select("cid", "least").join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        heads = placed.groupBy("component").agg(F.min("least").alias("component_id"))
        named = keep(stash(placed.join(heads, "component").select("cid", "component_id"), name="named"))
    out = rows.select(id_col, "n_shingles", "cid").join(named, "cid", "left")
    component = F.when(F.col("n_shingles") == 0, F.col(id_col)).otherwise(F.col("component_id"))
    return out.select(
        id_col,
        "n_shingles",
        component.alias("component_id"),
        (F.col(id_col).eqNullSafe(component)).alias("kept"),
    )


def _sets_of(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """(id, s): the full set of each wanted class, from its sample document."""
    got = ids.join(docs, ids[id_col].eqNullSafe(docs[id_col])).select("cid", docs.columns[1])
    schema = "id long, s array<long>, n long, d1 long, d2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                sets = list(kernel.shingle_sets(_utf8(batch.column(1))))
                ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                flat = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
                digests = np.array([_digest(s) for s in sets], dtype=np.uint64).reshape(-1, 3).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat), *(pa.array(digests[:, k]) for k in range(3))], ["id", "s", "n", "d1", "d2"]
                )

    # a repeated id with another text would bring another set: the digest tells
    made = got.mapInArrow(run, schema)
    return made.filter(F.col("id") == F.xxhash64("n", "d1", "d2")).select("id", "s").dropDuplicates(["id"])


def _digest(s: np.ndarray) -> tuple[int, int, int]:
    d1 = kernel.mix64(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64)
    d2 = kernel.mix64(s + np.uint64(0x7654321)).sum(dtype=np.uint64)
    return len(s), int(d1), int(d2)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that link by their full sets."""
    one = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = x.values.to_numpy(), y.values.to_numpy()
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=PERCENT).select("doc_id", "n_shingles", "component_id", "kept")
