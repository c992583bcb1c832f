"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Texts are normalised to words; each word of the benchmark has a number, and the automaton's letters are the two digits
of that number, so that a node stands for half a word and not for a byte. It holds every window of the benchmark and
scans each document once; words that the benchmark lacks lead back to the root. Match ends are word numbers and, for
spans, are mapped to byte offsets of the original text. Long texts are scanned in pieces that share `window` - 1 words.

The benchmark goes to the executors in shards of at most about `shard_bytes` of normalised text, one automaton each; a
worker holds one automaton at a time (measured: some 190 MB for 1.1 MB of text). A usual benchmark is one shard. A larger
one is scanned shard by shard and the hits of a document are united by its row id.

Defined results: null or wordless texts have no words, no hits and are not contaminated; an item without words has no
windows; a null item id marks words but is not listed; repeated items or windows count once per id; repeated documents
are judged alike; an empty benchmark leaves everything clean, an empty table gives an empty result; a very long text or
item is read whole; extra columns of the documents are kept untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UID, first_free, materialize

#: Word bytes after lower-casing A-Z: digits, a-z and everything outside ASCII; each other byte becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_IS_WORD = np.array([c != 32 for c in _FOLD])


def words_of(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_FOLD).split()


#: Bytes of a text that are scanned at once, and words of an item that travel together.
_PIECE, _ITEM_WORDS = 4_000_000, 20_000


class Windows:
    """The automaton over all windows of n words of some items (id, words); a shorter item is one window."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        coded = [(item, np.array([self.number.setdefault(w, len(self.number) + 1) for w in words.encode().split()], np.int64)) for item, words in items]
        self.base = int(np.ceil(np.sqrt(len(self.number) + 1)))
        seen: dict[tuple[int, ...], int] = {}
        self.length: list[int] = []
        owners: list[tuple[str | None, ...]] = []
        for item, code in coded:
            letters = self.letters(code)
            for i in range(max(1, len(code) - n + 1) if len(code) else 0):
                key = tuple(letters[2 * i : 2 * (i + n)])
                at = seen.setdefault(key, len(owners))
                if at == len(owners):
                    owners.append((item,))
                    self.length.append(len(key) // 2)
                elif item not in owners[at]:
                    owners[at] += (item,)
        self.shortest = min(self.length, default=0)
        same: dict[tuple[str | None, ...], frozenset[str]] = {}
        self.owners = [same.setdefault(o, frozenset(x for x in o if x is not None)) for o in owners]
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, at in seen.items():
            self.auto.add_word(key, at)
        del seen
        self.auto.make_automaton()

    def letters(self, code: np.ndarray) -> list[int]:
        """Two letters for each word number; the two digits have letters of their own, so matches keep in step."""
        high, low = np.divmod(code, self.base)
        return np.stack([high, low + self.base], 1).ravel().tolist()

    def scan(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset[str]]]:
        """(first word, one past the last, items) of each window found."""
        code = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        if not self.length or np.count_nonzero(code) < self.shortest:
            return
        for end, at in self.auto.iter(tuple(self.letters(code))):
            stop = end // 2 + 1
            yield stop - self.length[at], stop, self.owners[at]


#: The automaton that this worker holds; a worker serves many tasks of one shard after the other.
_held: dict[str, Windows] = {}


def _windows(items: list[tuple[str | None, str]], n: int) -> Windows:
    key = hashlib.sha1(repr((n, items)).encode()).hexdigest()
    if key not in _held:
        _held.clear()
        _held[key] = Windows(items, n)
    return _held[key]


def _pieces(raw: bytes, n: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Words of a text piece by piece: the number of the piece's first word, how many words are new, and its words."""
    folded, a, total, tail = raw.translate(_FOLD), 0, 0, []
    while a < len(folded):
        b = folded.find(b" ", a + _PIECE)
        b = len(folded) if b < 0 else b
        new = folded[a:b].split()
        yield total - len(tail), len(new), tail + new
        total, tail, a = total + len(new), (tail + new)[-(n - 1) :] if n > 1 else [], b


def _scan(batches: Iterator[pa.RecordBatch], items: list[tuple[str | None, str]], n: int, text: str, with_spans: bool) -> Iterator[pa.RecordBatch]:
    """Adds n_words, hits (runs of hit words as start and end word numbers), items and, if asked, spans."""
    windows = _windows(items, n)
    for batch in batches:
        counts, hits, found, spans = [], [], [], []
        for value in batch.column(text):
            raw = (value.as_py() or "").encode()
            total, ends, owners = 0, set(), set()
            for first, new, words in _pieces(raw, n):
                total += new
                for a, b, who in windows.scan(words):
                    ends.add((first + a, first + b))
                    owners |= who
            runs: list[list[int]] = []
            for a, b in sorted(ends):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            counts.append(total)
            hits.append([{"start": a, "end": b} for a, b in runs])
            found.append(sorted(owners))
            if with_spans:
                spans.append(_original(raw, runs))
        out = {name: batch.column(name) for name in batch.schema.names if name != text or with_spans}
        run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out |= {"__n": pa.array(counts, pa.int64()), "__hits": pa.array(hits, run), "__items": pa.array(found, pa.list_(pa.string()))}
        if with_spans:
            out["__spans"] = pa.array(spans, run)
        yield pa.RecordBatch.from_pydict(out)


def _items(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Items as their words; a very long one as parts that share n - 1 words, which have the same windows."""
    for batch in batches:
        ids, parts = [], []
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            words = words_of(t.as_py())
            for a in range(0, max(1, len(words) - n + 1) if words else 0, _ITEM_WORDS):
                ids.append(i)
                parts.append(b" ".join(words[a : a + _ITEM_WORDS + n - 1]).decode(errors="surrogateescape"))
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "words": pa.array(parts, pa.string())})


def _original(raw: bytes, runs: list[list[int]]) -> list[dict[str, int]]:
    """Byte offsets in the original text of runs of words."""
    if not runs:
        return []
    edge = np.diff(np.concatenate([[False], _IS_WORD[np.frombuffer(raw, np.uint8)], [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in runs]


_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, keep: list[str] | None = None, with_spans: bool = False, shard_bytes: int = 1 << 20
) -> DataFrame:
    """The columns `keep` of `docs` (default: all but the text) plus n_words, n_hit, hit_words, item_ids and spans.

    `with_spans` keeps the text and adds `spans`: byte ranges of the original text that the hit words cover.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    bench = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    bench = materialize(bench.mapInArrow(lambda b: _items(b, window), "id string, words string").distinct())
    total = bench.agg(F.coalesce(F.sum(F.octet_length("words") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))

    names = {c: first_free(keep, f"c{i}_") for i, c in enumerate(keep)}  # keeps callers' names out of the way
    body = first_free(list(names.values()), "t_")
    base = docs.select(*[F.col(c).alias(v) for c, v in names.items()], F.col(text).cast("string").alias(body))
    if shards > 1:
        base = materialize(base.withColumn(UID, F.monotonically_increasing_id()))
    fields = [f for f in base.schema.fields if f.name != body or with_spans]
    schema = T.StructType([*fields, T.StructField("__n", T.LongType()), T.StructField("__hits", _RUNS), T.StructField("__items", T.ArrayType(T.StringType())), *([T.StructField("__spans", _RUNS)] if with_spans else [])])

    def scan(k: int) -> DataFrame:
        part = bench.where(F.pmod(F.xxhash64("id", "words"), F.lit(shards)) == k) if shards > 1 else bench
        items = sorted(((r["id"], r["words"]) for r in part.collect()), key=repr)  # at most about shard_bytes
        return base.mapInArrow(lambda batches: _scan(batches, items, window, body, with_spans), schema)

    out = scan(0)
    if shards > 1:
        first = [c.name for c in fields if c.name != UID]
        for k in range(1, shards):
            out = out.unionByName(scan(k))
        merge = F.expr(
            "aggregate(array_sort(flatten(collect_list(__hits))), cast(array() as array<struct<start:bigint,end:bigint>>), (s, x) -> "
            "if(size(s) > 0 and x.start <= element_at(s, -1).end, concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).start as start, greatest(element_at(s, -1).end, x.end) as end))), concat(s, array(x))))"
        )
        aggs = [F.first(c).alias(c) for c in first] + [F.first("__n").alias("__n"), merge.alias("__hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items")]
        if with_spans:
            aggs.append(F.expr("array_sort(flatten(collect_list(__spans)))").alias("__spans"))
        out = out.groupBy(UID).agg(*aggs)
    n_hit = F.aggregate("__hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(
        *[F.col(v).alias(c) for c, v in names.items()],
        *([F.col(body).alias(text)] if with_spans else []),
        F.col("__n").alias("n_words"),
        n_hit.alias("n_hit"),
        F.col("__hits").alias("hit_words"),
        F.col("__items").alias("item_ids"),
        *([F.col("__spans").alias("spans")] if with_spans else []),
    )


def is_contaminated(share: int = 20):
    """The rule on n_hit and n_words: hit at all, and at least one word in `share`."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
