"""Near-duplicate detection: MinHash with tensored banding and exact verification.

A document's set is its distinct runs of five words.  Two small collections of
hashes, A and B, are computed: each holds `halves` keys made of ROWS minhashes.
The halves * halves table keys are the pairs (A_i, B_j), so that many tables cost
only 2 * halves * ROWS minhashes.  Two sets are candidates if they share a table
key, that is some A_i and some B_j; at similarity s a link is missed with
probability 1 - (1 - (1 - s**ROWS)**halves)**2.  The number of halves is the least
that keeps this at MISS or below at the threshold asked for (`half_count`: 9 at 0.85,
missing 1.95e-5; 12 at 0.8, missing 9.5e-6).

Exact copies collapse first: documents with equal sets are one class.  Classes
that share an A_i meet in its group, where they are candidates if they share a
B_j too.  Pairs whose sizes rule a link out, or whose signatures agree in fewer of
SIGNATURE places than `least_agreement` asks (a link at the threshold does so
with probability below FILTER_MISS) are passed over, and each pair is taken
in its first shared A_i only.  Classes without a pair left drop out; only for the
others are full sets made and sent, and pairs confirmed on them.

A group larger than a block is dealt out as pairs of blocks, so that no task
gathers it whole; a block returns the links that join its parts (a spanning
forest), never all pairs.  Links of all blocks give components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .components import components
from .scratch import Scratch, bounded, few

ROWS, SIGNATURE = 2, 64
#: Greatest probabilities that the tables and the signature filter miss a link at the threshold.
MISS, FILTER_MISS = 2e-5, 1e-8
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
BLOCK = ["level", "half", "p", "q"]
_A = tc._random_words("minhash-a", SIGNATURE) | tc.U64(1)
_B = tc._random_words("minhash-b", SIGNATURE)


def half_count(share: int) -> int:
    """Half keys a collection that keep the tables' miss at similarity share / 100 at MISS or below."""
    for n in range(1, SIGNATURE // (2 * ROWS) + 1):
        if 1 - (1 - (1 - (share / 100) ** ROWS) ** n) ** 2 <= MISS:
            return n
    raise ValueError(f"{SIGNATURE} minhashes are too few for a share of {share}")


def least_agreement(share: int) -> int:
    """Equal signature places below which a pair at similarity share / 100 falls with probability under FILTER_MISS."""
    s, below = share / 100, 0.0
    for n in range(SIGNATURE):
        below += math.comb(SIGNATURE, n) * s**n * (1 - s) ** (SIGNATURE - n)
        if below >= FILTER_MISS:
            return n
    return SIGNATURE


#: Half keys at op9's threshold.
HALVES = half_count(85)


def _half_keys(signature: np.ndarray, first: int, n: int) -> np.ndarray:
    """`n` keys of ROWS minhashes each, from column `first` on."""
    keys = np.zeros((len(signature), n), tc.U64)
    for r in range(ROWS):
        keys = tc.mix(keys + signature[:, first + r : first + ROWS * n : ROWS])
    return keys


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _fingerprints(size: int, n: int, carried: tuple[str, ...] = ()):
    """With `n` half keys a collection and a signature, or with the full sets where n is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for i, j, values, bounds in tc.document_shingles(text, size):
                sets = [np.unique(values[bounds[k] : bounds[k + 1]]) for k in range(j - i)]
                out = {"doc_id": batch.column("doc_id")[i:j], "n_shingles": pa.array([len(x) for x in sets], pa.int64()), "digest": pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary())}
                if n:
                    signature = tc.minima(values, bounds, _A, _B)
                    out |= {"a": _lists(_half_keys(signature, 0, n)), "b": _lists(_half_keys(signature, ROWS * n, n))}
                    short = np.ascontiguousarray((signature >> tc.U64(32)).astype("<u4"))
                    out["signature"] = pa.array([x.tobytes() for x in short], pa.binary())
                else:
                    out["shingles"] = pa.array([x.tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_pydict(out | {c: batch.column(c)[i:j] for c in carried})

    return run


def _joined(sets: list[np.ndarray], x: int, y: int, share: int) -> bool:
    """Whether 100 * intersection >= share * union."""
    small, large = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= share * (len(small) + len(large) - both)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block after the other, of batches in the order of blocks."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in BLOCK], 1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for i, j in zip(edges, edges[1:]):
            if held and (keys[i] != key).any():
                yield pa.Table.from_batches(held)
                held = []
            key = keys[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _near(block: pa.Table, share: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a block the later rows that may be linked with it, likelier ones first."""
    n = len(block)

    def wide(name: str) -> np.ndarray:
        return block[name].combine_chunks().flatten().to_numpy().reshape(n, -1)

    level, p, q = (block[c][0].as_py() for c in ("level", "p", "q"))
    size, part, a, b = block["n_shingles"].to_numpy(), block["part"].to_numpy(), wide("a"), wide("b")
    signature = np.frombuffer(b"".join(block["signature"].to_pylist()), "<u4").reshape(n, SIGNATURE)
    enough = least_agreement(share)
    for x in range(n - 1):
        y = slice(x + 1, n)
        ok = (100 * np.minimum(size[y], size[x]) >= share * np.maximum(size[y], size[x])) & (b[y] == b[x]).any(1)
        if p != q:
            ok &= part[y] != part[x]
        if level:
            ok &= ~(a[y, :level] == a[x, :level]).any(1)
        later = x + 1 + np.flatnonzero(ok)
        if len(later):
            agree = (signature[later] == signature[x]).sum(1)
            order = np.argsort(-agree, kind="stable")
            later = later[order[: int((agree >= enough).sum())]]
            if len(later):
                yield x, later


def _survivors(share: int):
    """The rows of each block that have a pair left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _by_block(batches):
            on = np.zeros(len(block), bool)
            for x, later in _near(block, share):
                on[x] = on[later] = True
            if on.any():
                yield from block.filter(pa.array(on)).to_batches()

    return run


def _forest(block: pa.Table, share: int) -> list[tuple[int, int]]:
    """Links between the rows of one block that join its parts."""
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in block["shingles"]]
    vid = block["vid"].to_pylist()
    parent = list(range(len(vid)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for x, later in _near(block, share):
        for z in later.tolist():
            p, q = root(x), root(z)
            if p != q and _joined(sets, x, z, share):
                parent[max(p, q)] = min(p, q)
                links.append((vid[x], vid[z]))
    return links


def _verified(share: int):
    """The links of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _by_block(batches):
            links = _forest(block, share)
            yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, share: int = 85, size: int = 5, id_col: str = "doc_id", text_col: str = "text", place: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    Rows are linked if 100 * intersection >= `share` * union of their sets of
    `size`-word runs (a share that the minhashes cannot find at MISS is refused);
    component_id is the least id of the component, and kept says whether the row
    has that id.

    Null or empty texts and texts without words have no shingles and link with
    nothing.  A text with fewer than `size` words has one shingle.  Repeated rows
    are copies of each other.  A row without an id takes no part: its
    component_id is null and kept is true.  Extra columns are not read.  With
    `place`, a string that tells rows apart, it is returned as a further column.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "neardup")
    n = half_count(share)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([] if place is None else [place.cast("string").alias("place")]))
    carried = ("place",) * (place is not None)
    schema = "doc_id long, n_shingles long, digest binary, a array<long>, b array<long>, signature binary" + ", place string" * len(carried)
    prints = work.save(docs.mapInArrow(_fingerprints(size, n, carried), schema), "prints")
    rows = prints.count()

    classes = prints.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), *(F.any_value(c).alias(c) for c in ("n_shingles", "a", "b", "signature")))
    classes = work.save(classes.withColumn("vid", F.monotonically_increasing_id()), "classes", rows=rows)

    # Groups of classes that share an A_i, dealt out as pairs of blocks.
    halves = classes.select("vid", "n_shingles", F.posexplode("a").alias("level", "half"))
    groups = halves.groupBy("level", "half").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("all"))
    groups = groups.where("members > 1").withColumn("parts", F.expr(f"cast(ceil(greatest(members / {BLOCK_SETS}, all / {BLOCK_SHINGLES})) as int)"))
    placed = halves.select("vid", "level", "half").join(groups.select("level", "half", "parts"), ["level", "half"]).withColumn("part", F.expr("cast(pmod(xxhash64(vid), parts) as int)"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    placed = placed.select("level", "half", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "vid", "part")
    blocks = placed.join(classes.drop("first_id"), "vid").repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    row = "level int, half long, p int, q int, vid long, part int, digest binary, n_shingles long, a array<long>, b array<long>, signature binary"
    left = work.save(blocks.select(*(c.split()[0] for c in row.split(", "))).mapInArrow(_survivors(share), row), "left", rows=rows)
    pairs = left.count()

    # Full sets of the classes left, of one document each.
    wanted, count = bounded(left.select("vid", "digest").distinct().join(classes.select("vid", F.col("first_id").alias("doc_id")), "vid"), work, "wanted", rows=pairs)
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id").distinct().transform(count), "doc_id", "left_semi")
    sets = texts.mapInArrow(_fingerprints(size, 0), "doc_id long, n_shingles long, digest binary, shingles binary").select("doc_id", "digest", "shingles")
    sets = sets.join(wanted.transform(count), ["doc_id", "digest"]).dropDuplicates(["vid"]).select("vid", "shingles")
    blocks = left.join(sets, "vid").repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    links = work.save(blocks.select(*left.columns, "shingles").mapInArrow(_verified(share), "u long, v long"), "links", rows=pairs)
    work.drop("left", "wanted")

    roots = components(links, work, rows=pairs)
    work.drop("links")
    heads = roots.join(classes.select(F.col("vid").alias("node"), "first_id"), "node")
    least = heads.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = heads.join(least, "root").select(F.col("node").alias("vid"), "least_id")
    named = classes.select("vid", "digest", "first_id").join(named, "vid", "left").select("digest", F.coalesce("least_id", "first_id").alias("least_id"))
    # Rows without a set have no class to look up.
    key = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest"))
    out = prints.select("doc_id", "n_shingles", key.alias("digest"), *carried).join(named, "digest", "left")
    component = F.coalesce("least_id", "doc_id")
    return few(out, rows).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *carried)
