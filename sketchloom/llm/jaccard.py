"""Groups of texts whose shingle sets have a Jaccard similarity of at least a threshold, decided on the sets themselves.

1. A text's set is the distinct XXH64 hashes of its shingles. Texts of equal sets are one node, named by XXH3 of the
   sorted set.
2. Candidates by prefix: of n hashes in ascending order the first n - ceil(t n) + 1 are a node's keys. Two sets of
   similarity t or more share one, whatever their length, so no pair is lost. Keys of a single node are taken out
   before fingerprints are joined on.
3. Nodes of one key are compared by the bit-sliced fingerprints of `simhash`, made of the distinct shingles. RADIUS lies
   six standard deviations beyond what two sets of similarity 0.8 can differ by (0.1875 of the bits at 4 of 5 shingles,
   0.151 in long texts). What is left are coarse groups.
4. Each node of a coarse group of two or more travels once, as its text, to the task that has the group; groups of over
   `most` shingles are dealt out as pairs of tiles, so a task's memory is bounded and no pair is left out.
5. In a task a group is searched breadth-first: overlaps of one set with all sets not yet reached are counted over an
   inverted index and held against the threshold in integers. Components of the resulting links are the groups.

Defined results: null and empty texts have the empty set and are one node, similar to nothing else; texts with fewer
words than the shingle length are one shingle; null ids take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sieve_of, sifted, text_slices
from .graph import connected_components
from .simhash import linked_in_buckets, majority_bits, shingle_hashes

BITS, RADIUS = 512, 150


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(text, k))


def node_of(own: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def similar_links(sets: list[np.ndarray], at_least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, root) as indices into `sets`: two sets have one root if a chain of similar sets joins them."""
    m, num, den = len(sets), at_least.numerator, at_least.denominator
    size = np.fromiter(map(len, sets), np.int64, m)
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(m), size)
    root = np.full(m, -1)

    def index() -> tuple[np.ndarray, np.ndarray]:
        """Postings of the sets not yet reached: owners by shingle, and where each shingle's begin."""
        rest = root[owner] < 0
        order = np.argsort(code[rest], kind="stable")
        return owner[rest][order], np.concatenate([[0], np.cumsum(np.bincount(code[rest], minlength=len(names)))])

    (posted, start), left, indexed = index(), m, m
    for s in range(m):
        if root[s] >= 0:
            continue
        root[s], left, queue = s, left - 1, [s]
        while queue and left:
            if 2 * left < indexed:
                (posted, start), indexed = index(), left
            x = queue.pop()
            own = code[cut[x] : cut[x + 1]]
            n = start[own + 1] - start[own]
            at = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(posted[at], minlength=m)
            new = np.flatnonzero((den * both >= num * (size[x] + size - both)) & (root < 0) & (both > 0))
            root[new] = s
            left -= len(new)
            queue += new.tolist()
    child = np.flatnonzero(root != np.arange(m))
    return child, root[child]


def _heads(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, off in text_slices(batch, "t", 1_000_000):
            data = raw.tobytes()
            sets = [shingle_set(data[a:b], k) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            fp = majority_bits(np.concatenate(sets), n, BITS // 64)
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "node": pa.array(map(node_of, sets), pa.int64()), "n": pa.array(n), "fp": pa.array([r.tobytes() for r in fp], pa.binary())})


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, at_least: Fraction) -> Iterator[pa.RecordBatch]:
    """The keys of each node, once a task."""
    seen: set[int] = set()
    for batch in batches:
        for part, _, _ in text_slices(batch, "t", 1_000_000):
            keys, nodes = [np.zeros(0, np.uint64)], []
            for t in part.column("t"):
                own = shingle_set(t.as_py().encode(), k)
                if len(own) and (node := node_of(own)) not in seen:
                    seen.add(node)
                    keys.append(own[: len(own) - ceil(at_least * len(own)) + 1])
                    nodes.append(node)
            who = np.repeat(np.array(nodes, np.int64), [len(x) for x in keys[1:]])
            yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate(keys).view(np.int64)), "node": pa.array(who)})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, node): those whose key has another node, each once. The last row waits for the next batch."""
    none = np.zeros(0, np.int64)
    h, node, last = none, none, None
    for batch in _and_end(batches):
        if batch is not None:
            h, node = (np.concatenate([x, np.asarray(batch.column(c))]) for x, c in ((h, "h"), (node, "node")))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
            h, node = h[new[: len(h)]], node[new[: len(h)]]
        if not len(h):
            continue
        same = h[1:] == h[:-1]
        shared = np.concatenate([[last == h[0]], same]) | np.concatenate([same, [False]])
        done = len(h) - (batch is not None)
        yield pa.RecordBatch.from_pydict({"h": pa.array(h[:done][shared[:done]]), "node": pa.array(node[:done][shared[:done]])})
        last = h[done - 1] if done else last
        h, node = h[done:], node[done:]


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _verified(batches: Iterator[pa.RecordBatch], k: int, at_least: Fraction) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; each key's texts are held together."""

    def links() -> pa.RecordBatch:
        a, b = similar_links([shingle_set(t, k) for t in texts], at_least) if len(texts) > 1 else ([], [])
        of = np.array(nodes, np.int64)
        return pa.RecordBatch.from_pydict({"a": pa.array(of[np.asarray(a, np.int64)]), "b": pa.array(of[np.asarray(b, np.int64)])})

    now, nodes, texts = None, [], []
    for batch in batches:
        for key, node, t in zip(batch.column("key"), batch.column("node").to_pylist(), batch.column("t"), strict=True):
            if (key := key.as_py()) != now:
                if len(nodes) > 1:
                    yield links()
                now, nodes, texts = key, [], []
            nodes.append(node)
            texts.append(t.as_py().encode())
    if len(nodes) > 1:
        yield links()


def _base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def verified_links(base: DataFrame, members: DataFrame, shingle: int, at_least: Fraction, most: int) -> DataFrame:
    """a, b: links of similar nodes. members: node, id of one text of it, n shingles, root of its coarse group."""
    spark = base.sparkSession
    sizes = members.groupBy("root").agg(F.count("*").alias("nodes"), F.sum("n").alias("all")).where("nodes > 1")
    tiles = F.ceil(F.col("all") / most).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.greatest(tiles, F.lit(1))).cast("int")
    number = lambda x, width=8: F.unhex(F.lpad(F.hex(x), width, "0"))
    key = lambda i, j: F.concat(number(F.col("root"), 16), number(i), number(j))
    both = F.transform(F.sequence(F.lit(0), F.greatest(tiles - 1, F.lit(0))), lambda j: key(F.least(mine, j), F.greatest(mine, j)))
    sent = members.join(sizes, "root").select("id", "node", F.explode(both).alias("key"))
    sent = materialize(sent)
    texts = sifted(base, "id", sieve_of(sent.select("id")), True).join(sent, "id").select("key", "node", "t")  # the other texts stay where they are
    texts = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    return texts.mapInArrow(lambda b: _verified(b, shingle, at_least), "a long, b long")


def candidate_links(base: DataFrame, nodes: DataFrame, shingle: int, at_least: Fraction, tile: int = 4096) -> DataFrame:
    """a, b: a forest over the nodes that share a key and lie within the radius. nodes: node, fp."""
    keys = base.mapInArrow(lambda b: _prefixes(b, shingle, at_least), "h long, node long")
    keys = keys.repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h").sortWithinPartitions("h", "node")
    shared = materialize(keys.mapInArrow(_shared, "h long, node long"))
    keyed = shared.join(nodes, "node").select("node", "fp", F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("key"))
    return linked_in_buckets(keyed, RADIUS, tile)


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, at_least: Fraction = Fraction(4, 5), most: int = 1_000_000, tile: int = 4096) -> DataFrame:
    """id, component_id: one row per row of `docs`; the ids must be unique integers. `at_least` from 0.8 up."""
    base = _base(docs, doc_id, text)
    heads = materialize(base.mapInArrow(lambda b: _heads(b, shingle), "id long, node long, n long, fp binary"))
    nodes = materialize(heads.groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("fp").alias("fp")))
    coarse = connected_components(candidate_links(base, nodes.select("node", "fp"), shingle, at_least, tile))
    coarse = materialize(coarse.union(coarse.select("b", "b")).distinct())
    members = materialize(nodes.join(coarse, nodes["node"] == coarse["a"]).select("node", "id", "n", F.col("b").alias("root")))
    roots = connected_components(verified_links(base, members, shingle, at_least, most))
    return heads.join(roots, heads["node"] == roots["a"], "left").select("id", F.coalesce("b", "node").alias("component_id"))
