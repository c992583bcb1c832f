"""Suffix-array dedup: remove every byte that lies in a string of `width` bytes that also starts anywhere else.

The suffix array is built by the difference-cover algorithm (modulo 3): name the triples at positions 1 and 2 modulo 3
by sorting them, recurse on the string of names, rank the remaining suffixes by their first symbol and the rank that
follows, and merge. Recursion ends once a name spans `width` bytes, since no longer prefix matters. Suffixes that are
neighbours in the order are then compared over their first `width` bytes.

To distribute it, the text is cut by content into overlapping neighbourhoods, so that equal strings meet:

1. Every string of `width` bytes has an anchor, the k-gram in it with the least hash. The strings of one anchor start
   at consecutive bytes; together they are the anchor's neighbourhood, `width` to 2 * `width` bytes or so. Equal
   strings have equal anchors at equal places, so strings under an anchor hash that occurs once are unique.
2. For anchor hashes that occur more than once the neighbourhoods are fetched from the texts. Equal neighbourhoods are
   merged and counted; of a neighbourhood that occurs twice, every string is repeated.
3. Distinct neighbourhoods are dealt out by anchor hash. Each task sorts the suffixes of whole groups, about a million
   bytes at a time, and reports the strings that two neighbourhoods share. Neighbourhoods that meet no other of their
   anchor need no sorting. A group of more than `hot_bytes` is cut again by longer anchors inside it (`LEVELS`), the
   last being the strings themselves; a group of up to `hot_bytes` meets in one task.
4. Repeated strings are carried back to all occurrences and merged to byte runs per distinct text.

In a periodic run (one byte or a short phrase over and over) each string starts again one period later, so all of them
are repeated there and then; only those of the first period stay, for other texts to meet.

Texts are moved twice, compressed, each distinct text once; copies only count. Hashes only bring candidates together,
so their collisions cost time but change no result; texts and neighbourhoods are told apart by 128-bit digests.

Defined results: a null text counts as empty; texts shorter than `width` lose nothing; matches never cross texts and
may overlap themselves; repeated rows count as copies of each other, so they go entirely if they are long enough; equal
and null ids are rows like others; an empty table gives an empty result; a very long text is read whole, in pieces;
extra columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, text_slices, work_dir, write_out

KGRAM = 48
#: Anchors inside hot groups, as shares of the width.
LEVELS = (0.6, 1.0)
_BASE = 0x9E3779B97F4A7C15
_PIECE = 2_000_000
#: Bytes of neighbourhoods that are sorted at once; a larger group of one anchor is a block of its own.
_BLOCK = 1_000_000
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0][0]) < n:
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, _PIECE + 1000), b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[0] = (out[0], out[1])
    return _powers[0]


def kgram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-gram."""
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(raw) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from minima of windows that double."""
    n, s, m = len(x) - w + 1, 1, x
    while 2 * s <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[:n], m[w - s : w - s + n])


def periodic_runs(raw: np.ndarray, anchors: np.ndarray, same: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(start, stop, period): the strings that start in [start, stop) start again one period later, in the same text.

    anchors: places of a text's anchors one after the other; same: whether the next one has an equal hash, not far away;
    first, last: the first and the last string of each.
    """
    out = []
    gap = np.diff(anchors)
    pair = np.flatnonzero(same)
    if not len(pair):
        return out
    cut = np.flatnonzero((np.diff(pair) != 1) | (gap[pair[1:]] != gap[pair[:-1]])) + 1
    for chain in np.split(pair, cut):
        p, a, b = int(gap[chain[0]]), int(first[chain[0]]), int(last[chain[-1] + 1]) + width
        alike = raw[a : b - p] == raw[a + p : b]
        for s, e in zip(*_runs(alike), strict=True):
            if e - s >= width:
                out.append((a + int(s), a + int(e) - width + 1, p))
    return out


def anchor_ranges(raw: np.ndarray, off: np.ndarray, width: int, k: int, spans: list[tuple[int, int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: its hash, its text's number, the first string that has it (relative to the text), and how many more.

    off: offsets of the texts in `raw`. With `spans`, strings that repeat one of their own text's by period are left
    out, and (text, from, to) of the bytes that they and what they repeat cover is appended to it.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < width:
        return none, none, none, none
    h = kgram_hashes(raw, k)
    low = np.uint64((1 << 24) - 1)
    least = (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), width - k + 1) & low).astype(np.int64)  # ties: the first
    fits, begins = np.ones(len(raw), bool), np.zeros(len(raw) + 1, bool)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        fits[max(a, b - width + 1) : b] = False  # strings do not leave their text
        begins[a] = True

    def groups() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Strings, their anchors, and where a new group of strings with one anchor begins."""
        starts = np.flatnonzero(fits)
        at = least[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (np.diff(starts) != 1) | begins[starts[1:]]
        return starts, at, np.flatnonzero(new)

    starts, at, first = groups()
    if not len(starts):
        return none, none, none, none
    if spans is not None:
        text = np.searchsorted(off, starts[first], "right") - 1
        spot = at[first]
        same = (h[spot[1:]] == h[spot[:-1]]) & (np.diff(spot) <= width - k) & (text[1:] == text[:-1])
        last = starts[np.append(first[1:], len(starts)) - 1]
        found = periodic_runs(raw, spot, same, starts[first], last, width)
        for a, b, p in found:
            fits[a + p : b + p] = False
            t = int(np.searchsorted(off, a, "right")) - 1
            spans.append((t, a - int(off[t]), b - 1 + p + width - int(off[t])))
        if found:
            starts, at, first = groups()
    count = np.diff(np.append(first, len(starts)))
    text = np.searchsorted(off, starts[first], "right") - 1
    return h[at[first]].view(np.int64), text, starts[first] - off[text], count - 1


def _anchors(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """h, e, at, more: an anchor's hash, its text's digest, its first string and how many follow.

    Rows without a hash tell bytes that repeat within the text: from `at`, and how many.
    """
    for batch in batches:
        for part, raw, off in text_slices(batch, "t", _PIECE):
            for lo in range(0, max(1, len(raw)), _PIECE) if len(off) == 2 else (0,):
                # a very long text stands alone and is done piece by piece; pieces share the bytes of their last strings
                cut = raw[lo : lo + _PIECE + width - 1] if len(off) == 2 else raw
                spans: list[tuple[int, int, int]] = []
                h, text, at, more = anchor_ranges(cut, np.array([0, len(cut)]) if len(off) == 2 else off, width, k, spans)
                text = np.concatenate([text, np.array([t for t, _, _ in spans], np.int64)])
                at = np.concatenate([at, np.array([a for _, a, _ in spans], np.int64)])
                more = np.concatenate([more, np.array([b - a for _, a, b in spans], np.int64)])
                hash_ = pa.array(np.append(h, np.zeros(len(spans), np.int64)), mask=np.arange(len(text)) >= len(h))
                yield pa.RecordBatch.from_pydict({"h": hash_, "e": part.column("e").take(pa.array(text)), "at": pa.array(at + lo), "more": pa.array(more.astype(np.int32))})


def ranks(t: np.ndarray, span: int, width: int) -> np.ndarray:
    """Order of the suffixes of `t` (symbols from 1, below 2**31): a number for each, smaller for smaller suffixes.

    A symbol stands for `span` bytes. Suffixes that agree on `width` bytes may get equal numbers. Numbers count the
    suffixes before, so that those of the three residues compare with each other.
    """
    n = len(t)
    pad = np.concatenate([t.astype(np.uint64), np.zeros(3, np.uint64)])
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    triple = _pack(pad[sample], pad[sample + 1], pad[sample + 2])
    names, distinct = _first_of_equal(triple)
    if distinct == len(names) or 3 * span >= width:
        below = names
    else:
        # the names of residue 1, then a separator, then those of residue 2
        string = np.concatenate([names[: len(one)] + 1, [0], names[len(one) :] + 1])
        r = ranks(string, 3 * span, width)
        below = np.concatenate([r[: len(one)], r[len(one) + 1 :]]) - 1  # the separator is before them all
    rank = np.zeros(n + 3, np.uint64)
    rank[sample] = below + 1
    a0 = pad[zero] << np.uint64(32) | rank[zero + 1]
    a1 = pad[one] << np.uint64(32) | rank[one + 1]
    both = np.concatenate([zero, two])
    b0, b2 = np.split(_pack(pad[both], pad[both + 1], rank[both + 2]), [len(zero)])
    out = np.zeros(n, np.int64)
    same0, less01, less10 = _counts(a0, a1)
    _, less02, less20 = _counts(b0, b2)
    out[zero] = same0 + less01 + less02
    out[one] = below[: len(one)] + less10
    out[two] = below[len(one) :] + less20
    return out


def _pack(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """One number for each triple, in the order of the triples."""
    if max((int(a.max()) for a in (x, y, z) if len(a)), default=0) < 1 << 21:
        return x << np.uint64(42) | y << np.uint64(21) | z
    return _first_of_equal(x << np.uint64(32) | y)[0].astype(np.uint64) << np.uint64(32) | z


def _first_of_equal(key: np.ndarray) -> tuple[np.ndarray, int]:
    """For each key the number of smaller ones; and how many different keys there are."""
    order = np.argsort(key)
    s = key[order]
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    out = np.empty(len(key), np.int64)
    out[order] = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    return out, int(first.sum())


def _counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each x: smaller x, smaller y; for each y: smaller x. One sort of both."""
    both = np.concatenate([x, y])
    order = np.argsort(both)
    s = both[order]
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    is_x = order < len(x)
    head = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    before_x = np.concatenate([[0], np.cumsum(is_x)])[head] if len(s) else head
    less_x, less = np.empty(len(both), np.int64), np.empty(len(both), np.int64)
    less_x[order], less[order] = before_x, head
    return less_x[: len(x)], (less - less_x)[: len(x)], less_x[len(x) :]


def repeated_starts(data: bytes, starts: np.ndarray, width: int) -> np.ndarray:
    """Of `starts` (positions in `data` with `width` bytes to go), whether their string is at another start too."""
    raw = np.frombuffer(data, np.uint8)
    order = starts[np.argsort(ranks(raw.astype(np.int64) + 1, 1, width)[starts], kind="stable")]
    a, b = order[:-1], order[1:]
    pair = np.arange(len(a))
    steps = [*range(0, width - 7, 8), *([width - 8] if width >= 8 else [])]
    words = np.ndarray((max(0, len(raw) - 7),), np.uint64, raw.tobytes(), 0, (1,)) if width >= 8 else raw
    for s in steps if width >= 8 else range(width):  # compare neighbours, dropping pairs at their first difference
        same = words[a + s] == words[b + s]
        a, b, pair = a[same], b[same], pair[same]
    hit = np.zeros(len(raw) + 1, bool)
    hit[order[pair]] = True
    hit[order[pair + 1]] = True
    return hit[starts]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _shared(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, body) sorted by h -> c and the runs of its strings that another neighbourhood of its anchor has."""

    def solve(groups: list[dict[bytes, bytes]]) -> pa.RecordBatch:
        cs = [c for g in groups for c in g]
        bodies = [b for g in groups for b in g.values()]
        size = np.array([len(b) for b in bodies], np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        n = size - width + 1
        starts = np.repeat(off[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = repeated_starts(b"".join(bodies), starts, width)
        out_c, out_r = [], []
        at = np.concatenate([[0], np.cumsum(n)])
        for j in np.unique(np.searchsorted(at, np.flatnonzero(hit), "right") - 1):
            s, e = _runs(hit[at[j] : at[j + 1]])
            out_c.append(cs[j])
            out_r.append(np.stack([s, e], 1).ravel().tolist())
        return pa.RecordBatch.from_pydict({"c": pa.array(out_c, pa.binary()), "runs": pa.array(out_r, pa.list_(pa.int64()))})

    groups: list[dict[bytes, bytes]] = []
    held, now, group = 0, None, {}
    for batch in batches:
        for h, c, body in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "body")), strict=True):
            if h != now:
                if len(group) > 1:
                    groups.append(group)
                    held += sum(map(len, group.values()))
                    if held >= _BLOCK:
                        yield solve(groups)
                        groups, held = [], 0
                now, group = h, {}
            group[c] = body
    if len(group) > 1:
        groups.append(group)
    if groups:
        yield solve(groups)


def _neighbourhoods(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Texts with the places of their repeated anchors -> an occurrence each; a body once a task for each digest."""
    from xxhash import xxh3_128_digest

    unpack = zstandard.ZstdDecompressor()
    seen: set[bytes] = set()
    cols = {"c": pa.binary(), "h": pa.int64(), "e": pa.binary(), "at": pa.int64(), "more": pa.int32(), "m": pa.int64(), "body": pa.binary()}
    rows: list[tuple] = []
    for batch in batches:
        for e, z, places in zip(batch.column("e").to_pylist(), batch.column("z").to_pylist(), batch.column("places").to_pylist(), strict=True):
            raw = unpack.decompress(z)
            for p in places:
                body = raw[p["at"] : p["at"] + p["more"] + width]
                if len(body) < width:
                    continue
                c = xxh3_128_digest(body)
                new = c not in seen
                if new:
                    seen.add(c)
                rows.append((c, p["h"], e, p["at"], len(body) - width, p["m"], body if new else None))
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(cols.items())})
                rows = []
    yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(cols.items())})


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Compressed texts and their removed bytes -> digests (and what is left)."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for e, z, runs in zip(batch.column("e").to_pylist(), batch.column("z").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            raw = unpack.decompress(z)
            runs = merge_runs([(r["a"], r["b"]) for r in runs or ()])
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            left = b"".join([*kept, raw[at:]])
            rows.append((e, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(left).hexdigest(), left if with_text else None))
        names = ("e", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(zip(names, kinds, strict=True))})


def _told(shared: DataFrame, twice: DataFrame) -> DataFrame:
    """c and the runs of its repeated strings; null runs mean all of them."""
    w = twice.select(F.col("c").alias("c2"))
    both = shared.groupBy("c").agg(F.first("runs").alias("runs")).join(w, F.col("c") == F.col("c2"), "full")
    return both.select(F.coalesce("c", "c2").alias("c"), F.when(F.col("c2").isNull(), F.col("runs")).alias("runs"))


def _inner_anchors(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Neighbourhoods of a hot anchor, cut by longer anchors: h, c, at, more, e (digest) and piece of each part."""
    from xxhash import xxh3_128_digest, xxh64_intdigest

    for batch in batches:
        for part, raw, off in text_slices(batch, "body", _PIECE):
            h, text, at, more = anchor_ranges(raw, off, width, k)
            outer, cs, data = part.column("h").to_pylist(), part.column("c").to_pylist(), raw.tobytes()
            pieces = [data[off[t] + a : off[t] + a + n + width] for t, a, n in zip(text.tolist(), at.tolist(), more.tolist(), strict=True)]
            keys = [xxh64_intdigest(x.to_bytes(8, "little", signed=True), outer[t] & (2**64 - 1)) - 2**63 for x, t in zip(h.tolist(), text.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "h": pa.array(keys, pa.int64()), "c": pa.array([cs[t] for t in text.tolist()], pa.binary()), "at": pa.array(at), "more": pa.array(more),
                "e": pa.array([xxh3_128_digest(outer[t].to_bytes(8, "little", signed=True) + p) for t, p in zip(text.tolist(), pieces, strict=True)], pa.binary()), "piece": pa.array(pieces, pa.binary()),
            })


def _shared_runs(bodies: DataFrame, width: int, hot_bytes: int, keep, level: int = 0) -> DataFrame:
    """bodies (h, c, body; repeats allowed) -> c and the runs of its strings that another body of its h has."""
    spark = bodies.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = lambda df: df.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(lambda b: _shared(b, width), "c binary, runs array<bigint>")
    if level == len(LEVELS):
        return sort(bodies)  # groups of equal strings: one body each
    hot = keep(bodies.groupBy("h").agg(F.sum(F.octet_length("body")).alias("n")).where(F.col("n") > hot_bytes).select("h"))
    if not hot.count():
        return sort(bodies)
    cold = sort(bodies.join(hot, "h", "left_anti"))
    k = max(1, int(width * LEVELS[level]))
    texts = bodies.join(hot, "h", "left_semi").dropDuplicates(["c"])
    cut = keep(texts.mapInArrow(lambda b: _inner_anchors(b, width, k), "h long, c binary, at long, more long, e binary, piece binary"))
    often = keep(cut.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    cut = cut.join(often, "h")
    inner = _shared_runs(cut.select("h", F.col("e").alias("c"), F.col("piece").alias("body")).dropDuplicates(["c"]), width, hot_bytes, keep, level + 1)
    told = keep(_told(inner, cut.groupBy(F.col("e").alias("c")).agg(F.count("*").alias("w")).where("w > 1")))
    spots = cut.select("c", "e", "at", "more").join(told.select(F.col("c").alias("e"), "runs"), "e")
    runs = F.when(F.col("runs").isNull(), F.array(F.col("at"), F.col("at") + F.col("more") + 1)).otherwise(F.transform("runs", lambda x: x + F.col("at")))
    back = spots.select("c", runs.alias("r")).groupBy("c").agg(F.flatten(F.collect_list("r")).alias("runs"))
    return cold.unionByName(back)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 200, kgram: int = KGRAM, with_text: bool = False, hot_bytes: int = 1_000_000) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the remaining bytes) of every document."""
    if not 1 <= kgram <= width:
        raise ValueError("kgram must be between 1 and width")
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(doc_id).alias("id"), body.alias("t"))
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(work_dir(spark))
        return write_out(df, paths[-1])

    # 1. anchors; equal texts give equal rows, which only count
    digest = F.unhex(F.md5("t")).alias("e")
    keyed = base.select(digest, "t").where(F.octet_length("t") >= width)
    anchors = keep(keyed.mapInArrow(lambda b: _anchors(b, width, kgram), "h long, e binary, at long, more int").groupBy("h", "e", "at", "more").agg(F.count("*").alias("m")))
    periods = keep(anchors.where("h is null").select("e", "at", "more"))
    # written out, so that the join deals both sides itself and can split a hot anchor's rows
    often = keep(anchors.groupBy("h").agg(F.sum("m").alias("n")).where("n > 1 and h is not null").select("h"))
    repeated = keep(anchors.join(often, "h").select("h", "e", "at", "more", "m"))
    for p in (paths[0], paths[2]):
        drop_path(spark, p)

    # 2. neighbourhoods, from each distinct text once
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = [z.compress((x.as_py() or "").encode()) for x in batch.column("t")]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c != "t"} | {"z": pa.array(out, pa.binary())})

    packed = base.select(digest, "t").mapInArrow(pack, "e binary, z binary")
    places = repeated.groupBy("e").agg(F.collect_list(F.struct("h", "at", "more", "m")).alias("places"))
    found = keep(packed.dropDuplicates(["e"]).join(places, "e").select("e", "z", "places").mapInArrow(lambda b: _neighbourhoods(b, width), "c binary, h long, e binary, at long, more int, m long, body binary"))

    # 3. suffix arrays over the distinct neighbourhoods of an anchor
    shared = keep(_shared_runs(found.where("body is not null").select("h", "c", "body"), width, hot_bytes, keep))

    # 4. back to the occurrences: whole neighbourhoods that occur twice, and the runs of the others
    told = _told(shared, found.groupBy("c").agg(F.sum("m").alias("w")).where("w > 1"))
    told = keep(told)
    spots = found.select("c", "e", "at", "more").join(told, "c")
    pairs = F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda i: F.struct((F.col("at") + F.get("runs", i)).alias("a"), (F.col("at") + F.get("runs", i + 1) + width - 1).alias("b")))
    whole = F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("more") + width).alias("b")))
    inside = periods.select("e", F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("more")).alias("b"))).alias("r"))
    gone = spots.select("e", F.when(F.col("runs").isNull(), whole).otherwise(pairs).alias("r")).unionByName(inside)
    gone = keep(gone.groupBy("e").agg(F.flatten(F.collect_list("r")).alias("runs")))
    for p in [paths[1], *paths[3:-1]]:
        drop_path(spark, p)
    cut = packed.dropDuplicates(["e"]).join(gone, "e", "left").select("e", "z", "runs")
    done = cut.mapInArrow(lambda b: _cut(b, with_text), "e binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    done = done if with_text else keep(done.drop("kept"))  # a narrow table, so copies can be joined to it evenly
    return base.select("id", digest).join(done, "e").drop("e")
