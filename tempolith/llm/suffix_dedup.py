"""Exact removal of long byte strings that occur more than once.

Every window of ``span`` bytes is assigned to an anchor inside it: the leftmost least of its
gram hashes, so equal windows have equal anchors at equal offsets.  A shuffle by anchor hash
brings the places of an anchor together.  Places whose whole context (all windows of the
anchor) recurs are settled at once, map-side where both lie in one buffer; contexts are held
equal by a cryptographic digest of their bytes (128 bits of BLAKE2b), never by the rolling
hash.  For anchors with different contexts one place of each context sends its bytes, and two
hash-compared suffix sorts, of what follows and of what precedes the anchor, give the windows
that recur: those that share both a prefix class and a suffix class, checked byte by byte.

Anchors with more contexts than ``group_limit`` are split until every part is sorted in the
same way: a context is cut into parts that hold the windows beginning a certain range of bytes
before the anchor, and parts stay together only if they share the bytes that all windows of
their range have.  Equal parts are settled like equal contexts; ranges narrow fourfold each
time, down to single windows, whose parts are all equal.  So no task sorts an unbounded group.
Texts are keyed by 96 bits of their MD5, so a lost executor's work can be redone in any
partitioning.

Defined cases: null texts are empty; texts shorter than span are kept whole; copies of a text
count as other places; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .suffix_sort import PrefixHashes, sort_suffixes

#: Bytes of a gram, and of text that is worked on at once.
GRAM, BUFFER = 64, 1 << 21
_PLACE_BITS = np.uint64(28)
#: How many windows of a context a part has, each time a group is too large.
_WIDTHS = (64, 16, 4, 1)
_ROW = "kind int, h long, c long, d long, key binary, lo long, size int, off int, many boolean"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = len(x) - width + 1
    rows = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    head = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def text_key(text: bytes) -> bytes:
    return hashlib.md5(text).digest()[:12]


def _segments(texts: list[bytes], span: int) -> Iterator[tuple[bytes, int, bytes]]:
    """(key, offset, bytes) of texts of at least span bytes; very long ones in overlapping parts."""
    for text in texts:
        if len(text) >= span:
            key = text_key(text)
            for at in range(0, len(text) - span + 1, BUFFER):
                yield key, at, text[at : at + BUFFER + span - 1]


def _digests(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of each piece, as two columns."""
    both = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in pieces]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _anchors(parts: list[tuple[bytes, int, bytes]], span: int):
    """Anchors of a buffer: part, start and size of the context, offset in it and hash of the anchor, digest of the context."""
    joined = b"".join(p[2] for p in parts)
    text = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(p[2]) for p in parts])
    rolled = PrefixHashes(text)
    n = len(text)
    at = np.arange(n - GRAM + 1)
    grams = _mix((rolled.sums[GRAM:] - rolled.sums[:-GRAM]) * rolled.down[: n - GRAM + 1])
    keyed = (grams >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
    anchor = (_sliding_min(keyed, span - GRAM + 1) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    valid = np.ones(n - span + 1, bool)
    for end in ends[:-1]:
        valid[max(0, end - span + 1) : end] = False
    windows = np.flatnonzero(valid)
    anchor = anchor[windows]
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    last = np.append(first[1:], len(windows)) - 1
    lo, size, place = windows[first], windows[last] - windows[first] + span, anchor[first]
    c, d = _digests([joined[a:b] for a, b in zip(lo.tolist(), (lo + size).tolist())])  # equal bytes have equal anchors
    return np.searchsorted(ends, lo, side="right"), lo, size, place - lo, grams[place].view(np.int64), c, d


def _batch(kind, h, c, d, key, lo, size, off, many) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(kind, pa.int32()), pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(key, pa.binary()),
            pa.array(lo, pa.int64()), pa.array(size, pa.int32()), pa.array(off, pa.int32()), pa.array(many, pa.bool_()),
        ],
        ["kind", "h", "c", "d", "key", "lo", "size", "off", "many"],
    )


def _buffer_rows(parts: list[tuple[bytes, int, bytes]], span: int) -> pa.RecordBatch:
    """Kind 0: a place of each (anchor, context) of the buffer, kind 1: byte ranges that recur in it."""
    part, lo, size, off, h, c, d = _anchors(parts, span)
    shift = np.array([p[1] for p in parts]) - np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])[:-1]])
    keys = np.array([p[0] for p in parts], object)
    order = np.lexsort((d, c, h))
    new = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in (h, c, d)], axis=0))
    count = np.diff(np.append(np.flatnonzero(new), len(order)))
    again = np.zeros(len(order), bool)
    again[order] = np.repeat(count > 1, count)
    first = order[new]
    # neighbouring places that recur are one range
    r = np.flatnonzero(again)
    end = lo[r] + size[r]
    start = np.append(True, (lo[r][1:] > end[:-1]) | (part[r][1:] != part[r][:-1])) if len(r) else np.zeros(0, bool)
    a, b = r[start], r[np.append(start[1:], True)] if len(r) else r
    ranges = len(a)
    spread = np.array([int.from_bytes(k[:8], "little", signed=True) for k in keys[part[a]]], np.int64)
    return _batch(
        np.repeat([0, 1], [len(first), ranges]),
        np.concatenate([h[first], spread]),
        np.concatenate([c[first], np.zeros(ranges, np.int64)]),
        np.concatenate([d[first], np.zeros(ranges, np.int64)]),
        [*keys[part[first]], *keys[part[a]]],
        np.concatenate([(lo + shift[part])[first], (lo + shift[part])[a]]),
        np.concatenate([size[first], lo[b] + size[b] - lo[a]]),
        np.concatenate([off[first], np.zeros(ranges, np.int64)]),
        np.concatenate([count > 1, np.zeros(ranges, bool)]),
    )


def places(docs: DataFrame, span: int) -> DataFrame:
    """Rows of _buffer_rows over docs.text."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in _segments([t for t in batch.column(0).cast(pa.binary()).to_pylist() if t], span):
                held.append(part)
                size += len(part[2])
                if size >= BUFFER:
                    yield _buffer_rows(held, span)
                    held, size = [], 0
        if held:
            yield _buffer_rows(held, span)

    return docs.select("text").mapInArrow(run, _ROW)


def settle(rows: DataFrame) -> DataFrame:
    """Kind 1: ranges that recur; kind 2: a place of each context of anchors with several contexts."""

    def run(batches):
        carried, same_before = None, False  # the last row waits for its successor
        h_before, pending = None, None

        def work(t: pa.Table, last: bool):
            nonlocal carried, same_before, h_before, pending
            h, c, d = (t.column(x).to_numpy() for x in ("h", "c", "d"))
            n = len(h)
            new_c = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1]))
            new_c[0] = not same_before
            new_h = np.append(h_before is None or h[0] != h_before, h[1:] != h[:-1])
            again = ~new_c | np.append(~new_c[1:], False) | t.column("many").to_numpy(zero_copy_only=False)
            done = n if last else n - 1
            reps = np.flatnonzero(new_c[:done])
            chosen, extra = [], None
            if len(reps):
                if pending is not None and not new_h[reps[0]]:
                    extra = pending
                pending = None
                follows = np.append(~new_h[reps[1:]], False)
                chosen = reps[~new_h[reps] | follows]
                if new_h[reps[-1]] and not follows[-1]:
                    pending = t.slice(reps[-1], 1)
            if not last:
                carried, same_before = t.slice(n - 1), not new_c[n - 1]
                h_before = h[n - 2] if n > 1 else h_before
            parts = []
            hit = np.flatnonzero(again[:done])
            for kind, index in ((1, hit), (2, chosen)):
                if len(index):
                    part = t.take(pa.array(index))
                    parts.append(part.set_column(0, "kind", pa.array(np.full(len(index), kind), pa.int32())))
            if extra is not None:
                parts.append(extra.set_column(0, "kind", pa.array([2], pa.int32())))
            return parts

        for batch in batches:
            t = pa.Table.from_batches([batch])
            ready = np.asarray(t.column("kind")) == 1
            if ready.any():
                yield from t.filter(pa.array(ready)).to_batches()
                t = t.filter(pa.array(~ready))
            if carried is not None:
                t = pa.concat_tables([carried, t])
                carried = None
            if t.num_rows:
                for part in work(t.combine_chunks(), False):
                    yield from part.to_batches()
        if carried is not None:
            t, carried = carried, None
            for part in work(t.combine_chunks(), True):
                yield from part.to_batches()

    return rows.repartition("h").sortWithinPartitions("h", "c", "d").mapInArrow(run, _ROW)


def recurring_windows(contexts: list[bytes], off: np.ndarray, anchor: np.ndarray, span: int) -> np.ndarray:
    """For contexts in the order of their anchors: whether the window d bytes before the anchor recurs, [i, d]."""
    size = np.array([len(x) for x in contexts])
    text = np.frombuffer(b"".join(contexts), np.uint8)
    start = np.cumsum(size) - size
    n, most = len(contexts), span - GRAM + 1
    classes = []
    for body, begin, length in ((text, start + off, size - off), (text[::-1].copy(), len(text) - start - off, off)):
        order, lcp = sort_suffixes(body, begin, np.minimum(length, span), anchor)
        classes.append((order, lcp))
    again = np.zeros((n, most), bool)
    least = off - (size - span)
    for d in range(most):
        live = np.flatnonzero((least <= d) & (d <= off))
        if len(live) < 2:
            continue
        pair = np.zeros(n, np.int64)
        for (order, lcp), need in zip(classes, (span - d, d)):
            number = np.empty(n, np.int64)
            number[order] = np.cumsum(lcp < need)
            pair = pair * (n + 1) + number
        _, back, count = np.unique(pair[live], return_inverse=True, return_counts=True)
        again[live, d] = count[back] > 1
    return again


def _ranges(again: np.ndarray, keys: list[bytes], lo: np.ndarray, off: np.ndarray, span: int) -> pa.RecordBatch:
    """Byte ranges of the windows that recur."""
    flipped = again[:, ::-1].astype(np.int8)
    edge = np.diff(np.pad(flipped, ((0, 0), (1, 1))), axis=1)
    i, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    first = lo[i] + off[i] - (again.shape[1] - 1 - a)
    return pa.RecordBatch.from_arrays([pa.array([keys[x] for x in i], pa.binary()), pa.array(first, pa.int64()), pa.array(b - a - 1 + span, pa.int32())], ["key", "lo", "size"])


def _with_contexts(docs: DataFrame, needs: DataFrame) -> DataFrame:
    """needs with the bytes of their contexts."""
    grouped = needs.groupBy("key").agg(F.collect_list(F.struct("h", "lo", "size", "off")).alias("needs"))
    texts = docs.select(F.unhex(F.substring(F.md5("text"), 1, 24)).alias("key"), "text").dropDuplicates(["key"])

    def cut(batches):
        for batch in batches:
            h, keys, lo, off, ctx = [], [], [], [], []
            for key, text, needs_ in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                for x in needs_:
                    h.append(x["h"])
                    keys.append(key)
                    lo.append(x["lo"])
                    off.append(x["off"])
                    ctx.append(text[x["lo"] : x["lo"] + x["size"]])
                    if len(h) >= 10_000:
                        yield out(h, keys, lo, off, ctx)
                        h, keys, lo, off, ctx = [], [], [], [], []
            if h:
                yield out(h, keys, lo, off, ctx)

    def out(h, keys, lo, off, ctx):
        return pa.RecordBatch.from_arrays(
            [pa.array(h, pa.int64()), pa.array(keys, pa.binary()), pa.array(lo, pa.int64()), pa.array(off, pa.int32()), pa.array(ctx, pa.binary())],
            ["h", "key", "lo", "off", "ctx"],
        )

    return texts.join(grouped, "key").select("key", "text", "needs").mapInArrow(cut, "h long, key binary, lo long, off int, ctx binary")


def _compare(contexts: DataFrame, span: int) -> DataFrame:
    """(key, lo, size) of windows that recur in contexts of one anchor, by suffix sorts over whole groups."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def work(t: pa.Table):
            h = t.column(0).to_numpy()
            keys, lo, off = t.column(1).to_pylist(), t.column(2).to_numpy(), t.column(3).to_numpy().astype(np.int64)
            again = recurring_windows(t.column(4).to_pylist(), off, h, span)
            return _ranges(again, keys, lo, off, span)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < BUFFER:
                continue
            t = pa.Table.from_batches(held)
            h = t.column(0).to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if whole:
                yield work(t.slice(0, whole))
            held, size = t.slice(whole).combine_chunks().to_batches(), 0
        if held and sum(b.num_rows for b in held):
            yield work(pa.Table.from_batches(held))

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "key binary, lo long, size int")


def _narrowed(contexts: DataFrame, span: int, width: int) -> DataFrame:
    """Places of parts of contexts: the windows that begin p * width to p * width + width - 1 bytes before the anchor.

    Parts of one p that have a window in common share the bytes that every window of p has; h is a hash of those.
    """
    most = span - GRAM

    def run(batches):
        for batch in batches:
            h, key, at, off_, bodies = [], [], [], [], []
            for k, lo, off, ctx in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                least = off - (len(ctx) - span)
                for p in range(least // width, off // width + 1):
                    near, far = p * width, min(p * width + width - 1, most)
                    first, last = max(near, least), min(far, off)
                    shared = b"%d " % p + ctx[off - near : off + span - far]
                    h.append(int.from_bytes(hashlib.blake2b(shared, digest_size=8).digest(), "little", signed=True))
                    key.append(k)
                    at.append(lo + off - last)
                    off_.append(last)
                    bodies.append(ctx[off - last : off + span - first])
            if h:
                yield _batch(np.zeros(len(h), np.int32), h, *_digests(bodies), key, at, [len(x) for x in bodies], off_, np.zeros(len(h), bool))

    return contexts.mapInArrow(run, _ROW)


def repeated_ranges(docs: DataFrame, *, span: int = 200, group_limit: int = 30_000) -> DataFrame:
    """(key, ranges): the byte ranges, as start and stop, that windows occurring elsewhere cover, for texts with any."""
    settled = materialize(settle(places(docs, span)), "suffix-places")
    ranges, needs = settled.where("kind = 1").select("key", "lo", "size"), settled.where("kind = 2")
    for width in _WIDTHS:
        large = materialize(needs.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > group_limit).select("h"), "suffix-large")
        if large.isEmpty():
            break
        ranges = ranges.union(_compare(_with_contexts(docs, needs.join(large, "h", "left_anti")), span))
        settled = materialize(settle(_narrowed(_with_contexts(docs, needs.join(large, "h", "left_semi")), span, width)), "suffix-places")
        ranges, needs = ranges.union(settled.where("kind = 1").select("key", "lo", "size")), settled.where("kind = 2")
    ranges = ranges.union(_compare(_with_contexts(docs, needs), span))
    return ranges.distinct().groupBy("key").agg(F.collect_list(F.struct("lo", "size")).alias("ranges"))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = 200, group_limit: int = 30_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary: the bytes that are left) of every document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    found = repeated_ranges(slim.where(F.octet_length("text") >= span).select("text"), span=span, group_limit=group_limit)
    keyed = slim.withColumn("key", F.unhex(F.substring(F.md5("text"), 1, 24)))
    doc_type = slim.schema[0].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            n_bytes, removed, spans, kept = [], [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                left, at, gone, runs = [], 0, 0, 0
                for lo, size in sorted((r["lo"], r["size"]) for r in ranges or ()):
                    if lo > at or not runs:
                        left.append(text[at:lo])
                        runs += 1
                        at = lo
                    gone += max(0, lo + size - at)
                    at = max(at, lo + size)
                left.append(text[at:])
                n_bytes.append(len(text))
                removed.append(gone)
                spans.append(runs)
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = keyed.join(found, "key", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(cut, f"doc_id {doc_type}, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    """without_repeats with the SHA-256 of the kept bytes in their place."""
    return without_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
