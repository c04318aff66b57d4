"""Parts that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, also used for checkpoints.

    Only a local session that names none (tests) gets a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="spark-ckpt-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(current)
    return current


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, with its lineage cut off."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table and read back: Spark takes its size from the files.

    What ``settled`` returns keeps the estimate of its plan, and a join's is the product of its sides'. In a loop
    that joins what it has made the digits of that number double each time, until the driver holds nothing else.
    """
    folder = new_folder(df.sparkSession, "stored")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def crc_of(column: str) -> F.Column:
    """crc32 of a number's decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in short runs of rows, so that few texts are held in two forms at once.

    At the end what Arrow holds unused goes back, since a worker lives on through tasks of other kinds.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def in_groups(sizes: Sequence[int], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes together; a larger row stands alone."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


class ChunkTable:
    """Distinct chunks of text and what ``encode`` makes of them, filled as chunks come up.

    After ``limit`` encoded chunks only the older half stays (frequent chunks come up
    early; ``trimmed`` is told what stays), and chunks over ``longest`` bytes are not
    kept, so that memory is bounded; neither changes results.
    """

    def __init__(self, encode: Callable[[list], Sequence], limit: int = 300_000, longest: int = 256, trimmed: Callable[[Iterable], None] | None = None):
        self.encode, self.limit, self.longest, self.trimmed = encode, limit, longest, trimmed
        self.known: dict[bytes | str, object] = {}
        self.made = 0

    def look_up(self, rows: list[list], collect: Callable = list) -> list:
        """The encoded form of each chunk of each row, in place."""
        if self.made > self.limit:
            self.known = dict(islice(self.known.items(), self.limit // 2))
            self.made = len(self.known)
            if self.trimmed:
                self.trimmed(self.known.values())
        missing = list(set().union(*rows).difference(self.known))
        self.made += len(missing)
        large: dict[bytes | str, object] = {}
        for chunk, value in zip(missing, self.encode(missing) if missing else []):
            (self.known if len(chunk) <= self.longest else large)[chunk] = value
        get = self.known.__getitem__ if not large else lambda chunk: large[chunk] if chunk in large else self.known[chunk]
        return [collect(map(get, row)) for row in rows]


class Forest:
    """Union-find over 0..n-1 for arrays of pairs; a root is the smallest index of its set."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        root = self.parent[i]
        while True:
            above = self.parent[root]
            if np.array_equal(above, root):
                return root
            root = above

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.roots(i), self.roots(j)
        while True:
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            a, b = self.roots(a), self.roots(b)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of every member that is not a root."""
        every = np.arange(len(self.parent))
        root = self.roots(every)
        member = np.flatnonzero(root != every)
        return member, root[member]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the component's smallest node.

    Each round points every node at its smallest neighbour, follows the pointers to
    local minima, and contracts: at least half of the nodes that still have edges
    vanish. Only key columns travel; joins on a hub's key are plain joins that
    adaptive execution splits, and minima are combined before the shuffle.
    """
    graph = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = stored(graph.select(F.col("a").alias("node")).union(graph.select("b")).distinct().withColumn("root", F.col("node")))
    while not graph.isEmpty():
        both = graph.union(graph.select("b", "a"))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        while True:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = stored(parent.join(above, "up").select("node", "up", "top"))
            parent = jumped.select("node", F.col("top").alias("up"))
            if jumped.filter("up <> top").isEmpty():
                break
        ends = parent.select(F.col("node").alias("root"), "up")
        labels = stored(labels.join(ends, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        one = graph.join(parent.select(F.col("node").alias("a"), F.col("up").alias("c")), "a").select("b", "c")
        two = one.join(parent.select(F.col("node").alias("b"), F.col("up").alias("d")), "b").select("c", "d")
        graph = stored(two.filter("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct())
    return labels
