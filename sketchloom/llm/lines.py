"""Line dedup with a fixed-depth log-template tree.

A line's path in the tree is its token count and its first `depth` tokens. In the leaf that the path leads to, lines
differ at some positions and agree at others: a token is constant there if at least `min_docs` documents of the leaf
have it at its position. A line's template keeps the constant tokens and generalises the others, and all tokens that
hold a digit, to fields. A template with word fields stands only if

* the line has `min_tokens` tokens or more, and three fifths of them are constant, and
* no two word fields stand side by side: a field is a name or a value, not a clause of prose.

Otherwise the line's template is the line itself, with tokens that hold a digit as fields if half of its tokens hold
none. A template recurs if lines of at least `min_docs` documents follow it, or `long_docs` documents if it has no field
and `long_tokens` tokens or more. Lines of recurring templates are dropped, either everywhere or (`keep_first`)
everywhere but in the document with the smallest id.

Counts decide, not the order in which lines come, so the result does not depend on how the rows are dealt out, and no
task needs to see a whole leaf. Tokens of a leaf and templates are 64-bit hashes; each document sends each once, and
counts are summed in the task before the shuffle, so a line or a leaf that is in every document costs one row a task.
Leaves are counted first: only tokens of leaves that `min_docs` documents have can be constant. Leaves, constant tokens
and recurring templates go to the scans as sorted arrays while they are at most `broadcast_rows`; beyond that each
document is joined to its own. Texts are parsed in pieces of whole lines.

Defined results: a null text stays null and has no lines; lines are separated by a line feed, tokens by ASCII white
space; a line without tokens is never dropped; a text of which every line goes becomes empty, and the row stays;
repeated rows count as documents of their own; ids may have any type that Spark orders; null ids come last in the
order for `keep_first`; an empty table gives an empty result; a very long text or line is read whole; extra columns are
kept, and the two added ones get an underscore if a column has the name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UID, first_free, materialize, mixed, text_slices, token_hashes, words_of

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_FIELD, _LEAF, _PLACE = np.uint64(0x51ED270B7C5A1D3F), np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are parsed at once.
_PIECE = 2_000_000


@dataclass(frozen=True)
class TemplateTree:
    depth: int = 2
    min_tokens: int = 4
    min_docs: int = 5
    long_tokens: int = 50
    long_docs: int = 2


class Lines:
    """The lines and tokens of a run of texts. off: offsets of the texts in `raw`."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        feeds = np.flatnonzero(raw == 10)
        doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, feeds, "right") - 1])
        start = np.concatenate([off[:-1], feeds + 1])
        order = np.lexsort((start, doc))
        self.start, self.doc = start[order], doc[order]
        stop = off[self.doc + 1]
        stop[:-1] = np.where(self.doc[1:] == self.doc[:-1], self.start[1:] - 1, stop[:-1])
        self.stop = stop
        self.raw, (self.at, self.end) = raw, words_of(raw, off)
        self.line = np.searchsorted(self.start, self.at, "right") - 1  # the last line that starts there: those before are empty
        self.n = np.bincount(self.line, minlength=len(self.start))
        self.first = np.cumsum(self.n) - self.n
        self.place = np.arange(len(self.at)) - self.first[self.line]

    def tokens(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For some tokens: their hash at their place, that of a field there, and whether they hold a digit."""
        at, end = self.at[which], self.end[which]
        spot = mixed(self.place[which].astype(np.uint64) * _PLACE)
        digit = np.add.reduceat(np.append(_DIGIT[self.raw], False), np.stack([at, end], 1).ravel(), dtype=np.int32)[::2] > 0 if len(at) else np.zeros(0, bool)
        return mixed(token_hashes(self.raw, at, end) ^ spot), mixed(_FIELD ^ spot), digit

    def sums(self, value: np.ndarray) -> np.ndarray:
        """Sums over the tokens of each line."""
        total = np.concatenate([np.zeros(1, value.dtype), np.cumsum(value)])
        return total[self.first + self.n] - total[self.first]

    def leaves(self, tree: TemplateTree) -> np.ndarray:
        """The leaf of each line."""
        leaf = self.n.astype(np.uint64) * _LEAF
        for k in range(tree.depth):
            has = np.flatnonzero(self.n > k)
            own, field, digit = self.tokens(self.first[has] + k)
            leaf[has] += np.where(digit, field, own)
        return mixed(leaf)

    def leaf_tokens(self, tree: TemplateTree, busy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that may become word fields, and their keys in their leaves. busy: sorted leaves that enough documents have."""
        leaf = self.leaves(tree)
        open_ = (self.n >= tree.min_tokens) & (_in(busy, leaf) >= 0)
        which = np.flatnonzero(open_[self.line] & (self.place >= tree.depth))
        own, _, digit = self.tokens(which)
        which, own = which[~digit], own[~digit]
        return which, mixed(leaf[self.line[which]] + own)

    def templates(self, tree: TemplateTree, fields: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each line: its plain template, its template with word fields, whether that stands; whether it is long and fixed.

        fields: the tokens that are word fields.
        """
        own, field, digit = self.tokens(np.arange(len(self.at)))
        masked = np.where(digit, field, own)
        size = self.n.astype(np.uint64) * _LEAF + np.uint64(1)
        digits = self.sums(digit.astype(np.int64))
        fixed = 2 * (self.n - digits) < self.n  # too many digits to tell anything
        shown = self.sums(masked)
        plain = mixed(np.where(fixed, self.sums(own), shown) + size)
        words = np.bincount(self.line[fields], minlength=len(self.n))
        side = np.zeros(len(self.n), bool)
        beside = np.flatnonzero(np.diff(fields) == 1)
        side[self.line[fields[beside]][self.line[fields[beside]] == self.line[fields[beside + 1]]]] = True
        np.add.at(shown, self.line[fields], field[fields] - own[fields])
        return plain, mixed(shown + size), (words > 0) & ~side & (5 * (self.n - digits - words) >= 3 * self.n), (self.n >= tree.long_tokens) & (fixed | (digits == 0))


def _pieces(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[Lines, int]]:
    """The lines of a run of texts, and their byte offset in it; one very long text comes in pieces of whole lines."""
    if len(off) != 2 or len(raw) <= 2 * _PIECE:
        yield Lines(raw, off), 0
        return
    a = 0
    while a <= len(raw):
        ahead = np.flatnonzero(raw[a + _PIECE :] == 10)[:1] if a + _PIECE < len(raw) else []
        b = a + _PIECE + int(ahead[0]) if len(ahead) else len(raw)
        yield Lines(raw[a:b], np.array([0, b - a])), a
        a = b + 1  # the feed between pieces belongs to neither


def _once(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each different (doc, key) is first."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return order[new]


def _documents(batches: Iterator[pa.RecordBatch], keys_of, hold: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """p, n: keys that `keys_of` gives for tokens or lines, and in how many documents they are."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        p, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        return pa.RecordBatch.from_pydict({"p": pa.array(p.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    for batch in batches:
        for part, raw, off in text_slices(batch, "t", _PIECE):
            got = [keys_of(piece, part) for piece, _ in _pieces(raw, off)]
            key, doc = np.concatenate([k for k, _ in got]), np.concatenate([d for _, d in got])
            held.append(key[_once(doc, key)])
            if sum(map(len, held)) >= hold:
                yield out()
                held = []
    yield out()


def _exploded(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
    """p, u: each document's keys."""
    for batch in batches:
        for part, raw, off in text_slices(batch, "t", _PIECE):
            u = np.asarray(part.column(UID))
            for piece, _ in _pieces(raw, off):
                key, doc = keys_of(piece, part)
                yield pa.RecordBatch.from_pydict({"p": pa.array(key.view(np.int64)), "u": pa.array(u[doc])})


def _in(sorted_keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the keys in a sorted array, -1 where they are not in it."""
    if not len(sorted_keys):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == key, at, -1)


class Keys:
    """A set of keys as a sorted array: one for all rows, sent to the workers, or for each row in a column of its own."""

    def __init__(self, name: str, sent=None):
        self.name, self.sent = name, sent

    def of(self, part: pa.RecordBatch) -> np.ndarray:
        return self.sent.value if self.sent is not None else np.unique(np.asarray(part.column(self.name).flatten(), dtype=np.int64).view(np.uint64))


def _line_templates(part: pa.RecordBatch, raw: np.ndarray, off: np.ndarray, tree: TemplateTree, busy: Keys, constant: Keys):
    """For each piece of a run: its lines, its offset and what `Lines.templates` gives."""
    leaves, tokens = busy.of(part), constant.of(part)
    for piece, at in _pieces(raw, off):
        which, key = piece.leaf_tokens(tree, leaves)
        yield piece, at, piece.templates(tree, which[_in(tokens, key) < 0])


def _templates(batches: Iterator[pa.RecordBatch], tree: TemplateTree, busy: Keys, constant: Keys, who: str) -> Iterator[pa.RecordBatch]:
    """h, id, long: each document's templates once, with its column `who`."""
    for batch in batches:
        for part, raw, off in text_slices(batch, "t", _PIECE):
            keys, docs, longs = [], [], []
            for piece, _, (plain, general, stands, long) in _line_templates(part, raw, off, tree, busy, constant):
                some = piece.n > 0
                keys += [plain[some], general[stands]]
                docs += [piece.doc[some], piece.doc[stands]]
                longs += [long[some], np.zeros(stands.sum(), bool)]
            key, doc, long = np.concatenate(keys), np.concatenate(docs), np.concatenate(longs)
            first = _once(doc, key)
            yield pa.RecordBatch.from_pydict({"h": pa.array(key[first].view(np.int64)), "id": part.column(who).take(pa.array(doc[first])), "long": pa.array(long[first])})


def _edited(raw: bytes, lines: list[tuple[int, int, bool]]) -> str:
    return b"\n".join(raw[a:b] for a, b, gone in lines if not gone).decode()


def _dropped(part: pa.RecordBatch, raw: np.ndarray, off: np.ndarray, tree: TemplateTree, busy: Keys, constant: Keys, keys: np.ndarray, firsts: pa.Array, keep_first: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The edited texts, and each document's number of lines and of dropped lines."""
    ids, n_docs = part.column("id"), len(off) - 1
    lines, gone, many = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64), len(off) == 2 and len(raw) > 2 * _PIECE
    spans: dict[int, list[tuple[int, int, bool]]] = {}
    for piece, shift, (plain, general, stands, _) in _line_templates(part, raw, off, tree, busy, constant):
        drop = np.zeros(len(piece.n), bool)
        for key, may in ((plain, piece.n > 0), (general, stands)):
            at = _in(keys, key)
            hit = np.flatnonzero((at >= 0) & may)
            if keep_first and len(hit):
                first, mine = firsts.take(pa.array(at[hit])), ids.take(pa.array(piece.doc[hit]))
                same = np.asarray(pc.fill_null(pc.equal(first, mine), False)) | (np.asarray(first.is_null()) & np.asarray(mine.is_null()))
                hit = hit[~same]
            drop[hit] = True
        lines += np.bincount(piece.doc, minlength=n_docs)
        gone += np.bincount(piece.doc[drop], minlength=n_docs)
        touched = np.zeros(n_docs, bool)
        touched[piece.doc[drop]] = True
        for i in np.flatnonzero(touched[piece.doc] | many).tolist():
            spans.setdefault(int(piece.doc[i]), []).append((shift + int(piece.start[i]), shift + int(piece.stop[i]), bool(drop[i])))
    data = raw.tobytes() if gone.any() else b""
    texts = part.column("t").to_pylist() if gone.any() else part.column("t")
    for d in np.flatnonzero(gone).tolist():
        texts[d] = _edited(data, spans[d])
    known = np.asarray(part.column("t").is_valid())
    return pa.array(texts, pa.string()) if gone.any() else texts, np.where(known, lines, 0), gone


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_first: bool = False, tree: TemplateTree = TemplateTree(), broadcast_rows: int = 4_000_000) -> DataFrame:
    """The columns of `docs` with lines of recurring templates taken out of the text, plus n_lines and n_dropped."""
    spark = docs.sparkSession
    lines_name, dropped_name = first_free(docs.columns, "n_lines"), first_free(docs.columns, "n_dropped")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rest = {n: c for n, c in zip(names, docs.columns, strict=True) if c != text}
    flat = docs.select(*[F.col(c).alias(n) for n, c in rest.items()], F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"))
    kind = flat.schema["id"].dataType.simpleString()

    def frequent(keys_of, name: str) -> Keys:
        """The keys that at least `min_docs` documents have."""
        nonlocal flat
        columns = [c for c in flat.columns if c in ("t", "busy")]
        counts = flat.select(*columns).mapInArrow(lambda b: _documents(b, keys_of), "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
        keys = materialize(counts.where(F.col("n") >= tree.min_docs).select("p"))
        if keys.count() <= broadcast_rows:
            return Keys(name, spark.sparkContext.broadcast(np.sort(np.asarray(keys.toArrow()["p"], dtype=np.int64).view(np.uint64))))
        if UID not in flat.columns:
            flat = materialize(flat.withColumn(UID, F.monotonically_increasing_id()))
        own = flat.select(UID, *columns).mapInArrow(lambda b: _exploded(b, keys_of), "p long, u long").join(keys, "p").groupBy("u").agg(F.collect_set("p").alias(name))
        flat = materialize(flat.join(own, flat[UID] == own["u"], "left").drop("u"))
        return Keys(name)

    def line_keys(piece: Lines, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        some = piece.n >= tree.min_tokens
        return piece.leaves(tree)[some], piece.doc[some]

    busy = frequent(line_keys, "busy")

    def token_keys(piece: Lines, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        which, key = piece.leaf_tokens(tree, busy.of(part))
        return key, piece.doc[piece.line[which]]

    constant = frequent(token_keys, "constant")
    told = flat.mapInArrow(lambda b: _templates(b, tree, busy, constant, "id"), f"h long, id {kind}, long boolean")
    told = told.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("long").alias("long"))
    recurring = materialize(told.where((F.col("n") >= tree.min_docs) | (F.col("long") & (F.col("n") >= tree.long_docs))).select("h", "first"))

    kept = [f for f in flat.schema.fields if f.name in rest]
    schema = T.StructType([*kept, T.StructField("t", T.StringType()), T.StructField("nl", T.LongType()), T.StructField("nd", T.LongType())])

    def edit(part: pa.RecordBatch, raw, off, keys: np.ndarray, firsts: pa.Array) -> pa.RecordBatch:
        texts, lines, gone = _dropped(part, raw, off, tree, busy, constant, keys, firsts, keep_first)
        return pa.RecordBatch.from_pydict({f.name: part.column(f.name) for f in kept} | {"t": texts, "nl": pa.array(lines), "nd": pa.array(gone)})

    if recurring.count() <= broadcast_rows:
        got = recurring.toArrow()  # at most broadcast_rows
        keys = np.asarray(got["h"], dtype=np.int64).view(np.uint64)
        order = np.argsort(keys)
        found = spark.sparkContext.broadcast((keys[order], got["first"].combine_chunks().take(pa.array(order))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, raw, off in text_slices(batch, "t", _PIECE):
                    yield edit(part, raw, off, *found.value)

        out = flat.mapInArrow(run, schema)
    else:
        if UID not in flat.columns:
            flat = materialize(flat.withColumn(UID, F.monotonically_increasing_id()))
        at = flat.mapInArrow(lambda b: _templates(b, tree, busy, constant, UID), "h long, id long, long boolean").join(recurring, "h")
        mine = at.groupBy(F.col("id").alias("u")).agg(F.collect_list(F.struct("h", "first")).alias("recurring"))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, raw, off in text_slices(batch, "t", _PIECE):
                    pairs = part.column("recurring").flatten()
                    keys = np.asarray(pairs.field("h"), dtype=np.int64).view(np.uint64)
                    keys, one = np.unique(keys, return_index=True)
                    yield edit(part, raw, off, keys, pairs.field("first").take(pa.array(one)))

        out = flat.join(mine, flat[UID] == mine["u"], "left").mapInArrow(apply, schema)
    back = {c: n for n, c in rest.items()}
    return out.select(*[(F.col("t") if c == text else F.col(back[c])).alias(c) for c in docs.columns], F.col("nl").alias(lines_name), F.col("nd").alias(dropped_name))
