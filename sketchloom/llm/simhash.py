"""SimHash near-duplicate grouping with bit-sliced comparison.

1. Fingerprints: each shingle's XXH64 (further lanes of 64 bits are mixed from it); a bit is 1 if it is set in over
   half of the shingles, repeats included. Counting is done on byte lanes, many documents at a time.
2. Equal fingerprints are one node from here on, so copies never form pairs.
3. Candidates: fingerprints are cut into blocks of 16 bits and filed under keys of one or more blocks. With `choose`
   blocks out of n, every pair within radius n / 16 bits - choose shares a key (pigeonhole), so the search is exact.
   With one block per key and a larger radius it is banded: `band_recall` gives the chance of a shared key.
4. Buckets are compared bit-sliced: bit planes of 64 fingerprints stand as words; the distances of one fingerprint to
   64 others are counted at once in carry-save counters, and a block is abandoned once all its lanes exceed the
   radius. Buckets above `tile` rows are dealt out as pairs of tiles, so a task's memory is bounded and no pair lost.
5. Links leave a bucket as a spanning forest, never as all pairs; components come from star rounds.

Defined results: null and empty texts have fingerprint zero and link like any other; texts with fewer words than the
shingle length are one shingle; repeated rows share a node; null ids take part, and a component's id is its smallest
non-null id (null if there is none); a very long text is read whole, in pieces of words; an empty table gives an empty
result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_slices
from .graph import connected_components

#: A byte value as eight byte-wide counters, one for each of its bits.
_SPREAD = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)).copy().view(np.uint64).ravel()
BLOCK_BITS = 16


def _mix(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; further lanes are mixed from it (splitmix64 finaliser)."""
    if lane == 0:
        return h
    z = h + np.uint64((lane * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: Bytes of a text that are split into words at once.
_PIECE = 4_000_000


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each k-word shingle of the lower-cased text; fewer words make one shingle, none make none."""
    out, tail, a, total = [np.zeros(0, np.uint64)], [], 0, 0
    while a < len(text):
        b = a + _PIECE
        while b < len(text) and text[b : b + 1] not in b" \t\n\r\x0b\x0c":  # words stay whole
            b += 1
        new = text[a:b].lower().split()
        total, words, a = total + len(new), tail + new, b
        if len(words) >= k:
            out.append(_hashes(words, k, seed))
        tail = words[-(k - 1) :] if k > 1 else []
    if 0 < total < k:
        out.append(_hashes(tail, total, seed))
    return np.concatenate(out)


def _hashes(words: list[bytes], k: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = len(words) - k + 1
    return np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, n)


def majority_bits(h: np.ndarray, counts: np.ndarray, lanes: int) -> np.ndarray:
    """Fingerprints of documents whose hashes stand one after the other in `h`: rows of lanes * 8 big-endian bytes."""
    out = np.zeros((len(counts), lanes * 8), np.uint8)
    live = np.flatnonzero(counts)
    if not len(live):
        return out
    n = counts[live]
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    pieces = -(-n // 255)  # a byte-wide counter holds 255
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    cut = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for lane in range(lanes):
        raw = _mix(h, lane).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            part = np.add.reduceat(_SPREAD[raw[:, b]], cut).view(np.uint8).reshape(-1, 8)
            set_in = np.add.reduceat(part.astype(np.int64), first, axis=0)
            out[live, lane * 8 + 7 - b] = np.packbits(2 * set_in > n[:, None], axis=1, bitorder="little")[:, 0]
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int, lanes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, off in text_slices(batch, "t", 1_000_000):
            data = raw.tobytes()
            each = [shingle_hashes(data[a:b], k) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            h = np.concatenate([np.zeros(0, np.uint64), *each])
            fp = majority_bits(h, counts, lanes)
            yield pa.RecordBatch.from_pydict({"id": part.column("id"), "fp": pa.array([r.tobytes() for r in fp], pa.binary())})


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 64) -> DataFrame:
    """id, fp: one row per document, fp as bits / 8 bytes."""
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(lambda b: _fingerprints(b, shingle, bits // 64), f"id {kind}, fp binary")


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """Fingerprints (rows a multiple of 64, bytes) -> words[block, bit]: bit j of a word is row j of the block."""
    bits = np.unpackbits(fp, axis=1)
    blocks = bits.reshape(len(fp) // 64, 64, -1)
    return np.ascontiguousarray(np.packbits(blocks, axis=1, bitorder="little").transpose(0, 2, 1)).view(np.uint64)[:, :, 0]


def sliced_within(planes: np.ndarray, bits: np.ndarray, rows: np.ndarray, blocks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (row, block): a word whose bit j is 1 if row j of the block is within the radius of the row.

    planes: words[block, bit]; bits: 0/1 per row and bit. Returns the indices of the pairs that are not abandoned and
    their words. The counters start so far from overflow that one carries out exactly when the radius is exceeded.
    """
    n_bits, width = planes.shape[1], max(1, radius.bit_length())
    if (1 << width) < radius + 1:
        width += 1
    start = (1 << width) - 1 - radius
    alive = np.arange(len(rows))
    counter = [np.full(len(rows), np.uint64(2**64 - 1) if start >> k & 1 else np.uint64(0)) for k in range(width)]
    over = np.zeros(len(rows), np.uint64)
    for p in range(n_bits):
        carry = planes[blocks, p] ^ (np.uint64(0) - bits[rows, p].astype(np.uint64))
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if p % 16 == 15 and p + 1 < n_bits:  # abandon what is beyond the radius in every lane
            keep = np.flatnonzero(~over)
            if len(keep) < 0.9 * len(over):
                alive, over, rows, blocks = alive[keep], over[keep], rows[keep], blocks[keep]
                counter = [c[keep] for c in counter]
    return alive, ~over


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each one's component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def _bucket_links(keys: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets (rows sorted by bucket number `keys`) as a spanning forest: child and root nodes."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([edge, [len(keys)]]))
    big = size > 1
    if not big.any():
        return node[:0], node[:0]
    edge, size = edge[big], size[big]
    end = np.repeat(np.cumsum(size), size)  # of each row's bucket; buckets stand one after the other
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    source = np.repeat(edge, size) + within
    rows_all = len(source)
    packed = np.zeros((-(-rows_all // 64) * 64, fp.shape[1]), np.uint8)
    packed[:rows_all] = fp[source]
    planes, bits = bit_planes(packed), np.unpackbits(packed[:rows_all], axis=1)
    pairs = (end - 1) // 64 - np.arange(rows_all) // 64 + 1  # this row against its own block and those after it in the bucket
    to, at = [], []
    begin = 0
    total = np.cumsum(pairs)
    while begin < rows_all:
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
        n = pairs[begin:stop]
        rows = np.repeat(np.arange(begin, stop), n)
        blks = rows // 64 + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        alive, word = sliced_within(planes, bits, rows, blks, radius)
        rows, blks = rows[alive], blks[alive]
        word = word & _lanes(end[rows] - blks * 64) & ~_lanes(rows + 1 - blks * 64)  # later rows of the same bucket
        hit = np.flatnonzero(word)
        on = np.unpackbits(word[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, j = np.nonzero(on)
        to.append(rows[hit][i])
        at.append(blks[hit][i] * 64 + j)
        begin = stop
    a, b = np.concatenate(to), np.concatenate(at)
    root = local_roots(rows_all, a, b)
    child = np.flatnonzero(root != np.arange(rows_all))
    return node[source][child], node[source][root[child]]


def _lanes(n: np.ndarray) -> np.ndarray:
    """Words with the n lowest bits set, n cut to 0 .. 64."""
    n = np.clip(n, 0, 64).astype(np.uint64)
    return np.where(n == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


def _linked(batches: Iterator[pa.RecordBatch], radius: int, most_rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole buckets are compared some ten thousand rows at a time."""

    def flush(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        key = t["key"].combine_chunks().dictionary_encode() if t.num_rows else None
        code = np.asarray((key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key).indices)
        fp = np.frombuffer(b"".join(t["fp"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        a, b = _bucket_links(code, fp, np.asarray(t["node"]), radius)
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) >= most_rows:
            t = pa.Table.from_batches(held)
            tail = t["key"][-1].as_py()
            keys = t["key"].to_pylist()
            cut = len(keys)
            while cut and keys[cut - 1] == tail:
                cut -= 1
            if cut:
                yield flush(t.slice(0, cut).to_batches())
                held = t.slice(cut).to_batches()
    if held:
        yield flush(held)


def band_recall(similarity: float, bits: int, choose: int = 1) -> float:
    """Chance that two texts of this shingle-set similarity share a key (`choose` = 1, independent bits)."""
    cos = 2 * similarity / (1 + similarity)
    same = (1 - np.arccos(cos) / np.pi) ** (BLOCK_BITS * choose)
    return float(1 - (1 - same) ** (bits // BLOCK_BITS // choose))


def linked_in_buckets(keyed: DataFrame, radius: int, tile: int = 4096) -> DataFrame:
    """a, b: links of the nodes of one key whose fingerprints lie within the radius. keyed: node, fp, key (binary)."""
    hot = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile))  # few; its size decides how it is joined
    n = F.coalesce(F.col("n"), F.lit(0))
    tiles = F.ceil(n / tile).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.greatest(tiles, F.lit(1))).cast("int")
    number = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    both = F.transform(F.sequence(F.lit(0), F.greatest(tiles - 1, F.lit(0))), lambda j: F.concat("key", number(F.least(mine, j)), number(F.greatest(mine, j))))
    pairs = keyed.join(hot, "key", "left").select("node", "fp", F.explode(F.when(n <= tile, F.array("key")).otherwise(both)).alias("key"))
    pairs = pairs.repartition(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    return pairs.mapInArrow(lambda b: _linked(b, radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 64, radius: int = 2, choose: int = 2, tile: int = 4096
) -> DataFrame:
    """id, fp, component_id: one row per document; component_id is the smallest id reachable over links."""
    spark = docs.sparkSession
    fps = materialize(fingerprints(docs, doc_id, text, shingle, bits))
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    sets = list(combinations(range(bits // BLOCK_BITS), choose))
    block = lambda i: F.substring("fp", 2 * i + 1, 2)
    keyed = nodes.select("node", "fp", F.posexplode(F.array(*[F.concat(*[block(i) for i in s]) for s in sets])).alias("set", "part"))
    keyed = keyed.select("node", "fp", F.concat(F.substring(F.unhex(F.lpad(F.hex("set"), 8, "0")), 3, 2), "part").alias("key"))
    links = linked_in_buckets(keyed, radius, tile)
    roots = connected_components(links)
    own = nodes.join(roots, nodes["node"] == roots["a"], "left").select("fp", "least", F.coalesce("b", "node").alias("root"))
    own = materialize(own)
    smallest = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("id", "fp", "component_id")
