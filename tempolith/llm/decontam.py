"""Benchmark decontamination.

The benchmark's normalised word windows form a hash set that is broadcast in blocks of at
most ``block_words`` words; each block scans every document once, map-side, so no document
is shuffled and no broadcast grows with the corpus.  An index is a sorted array of window
hashes beside the packed words, about 30 bytes a word and so 120 MB a block; what one block
finds is written before the next one is read, so a worker holds one index.  A rolling hash
proposes windows, and the words themselves verify every hit.

Defined cases: a null text or item has no words; items with the same id count once; an
empty benchmark hits nothing; windows of a null item id are hits without a name to report.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize

#: Bytes of words stay (A-Z lower-cased), all others become spaces.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD_RE = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Slots of the filter for each window.
_SLOTS = 16
_MULT = np.random.default_rng(20240).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SCAN_TYPE = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>"


def split_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, lower-cased letters and non-ASCII characters."""
    return text.translate(_WORD_BYTES).split() if text else []


class WindowIndex:
    """Windows of one benchmark block (item or None, words joined by spaces): filter, sorted hashes, packed words."""

    def __init__(self, segments: list[tuple[str | None, bytes]], ngram: int):
        self.items = [item for item, _ in segments]
        self.text = b" ".join(words for _, words in segments)
        base, count, offsets, found = 0, 0, [], {}
        for number, (_, words) in enumerate(segments):
            each = words.split()
            size = min(ngram, len(each))
            lengths = np.fromiter(map(len, each), np.int64, len(each))
            offsets.append((base + np.cumsum(lengths + 1) - lengths - 1).astype(np.int64))
            hashes = self._hashes(np.fromiter(map(hash, each), np.int64, len(each)).view(np.uint64), size)
            found.setdefault(size, []).append((hashes, np.arange(count, count + len(hashes), dtype=np.int32), np.full(len(hashes), number, np.int32)))
            count += len(each)
            base += len(words) + 1
        self.starts = np.append(np.concatenate(offsets), base) if offsets else np.zeros(1, np.int64)
        self.tables = {}
        for size, parts in found.items():
            hashes, first, item = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            shift = np.uint64(64 - max(10, int(_SLOTS * len(hashes) - 1).bit_length()))
            bits = np.zeros((1 << int(64 - shift)) >> 3, np.uint8)
            slots = (hashes >> shift).astype(np.int64)
            np.bitwise_or.at(bits, slots >> 3, np.left_shift(1, slots & 7).astype(np.uint8))
            self.tables[size] = (shift, bits, hashes, first[order], item[order])

    @staticmethod
    def _hashes(words: np.ndarray, size: int) -> np.ndarray:
        """A hash of every run of ``size`` words."""
        n = len(words) - size + 1
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += words[k : k + n] * _MULT[k % 64]
        total ^= total >> np.uint64(32)
        total *= _MULT[0]
        return total

    def hits(self, words: list[bytes]) -> list[tuple[int, int, set[str]]]:
        """(first word, words, items) of every benchmark window in the text."""
        found = []
        each = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        for size, (shift, bits, hashes, first, item) in self.tables.items():
            if len(words) < size:
                continue
            own = self._hashes(each, size)
            slots = (own >> shift).astype(np.int64)
            maybe = np.flatnonzero(bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
            low, high = np.searchsorted(hashes, own[maybe], "left"), np.searchsorted(hashes, own[maybe], "right")
            for i, a, b in zip(maybe.tolist(), low.tolist(), high.tolist()):
                if a == b:
                    continue
                window = b" ".join(words[i : i + size])
                items = {self.items[item[k]] for k in range(a, b) if self.text[self.starts[first[k]] : self.starts[first[k] + size] - 1] == window}
                if items:
                    found.append((i, size, items - {None}))
        return found


_indexes: dict[tuple[str, int], WindowIndex] = {}


def _index(broadcast, ngram: int) -> WindowIndex:
    key = (broadcast.value[0], ngram)
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = WindowIndex(broadcast.value[1], ngram)
    return _indexes[key]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, ngram: int, block_words: int) -> Iterator[list]:
    """Benchmark segments streamed to the driver in blocks of bounded size."""
    block, held = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    for row in rows.where("text is not null").toLocalIterator():
        words = split_words(row.text.encode())
        step = max(1, block_words - ngram + 1)
        for start in range(0, max(1, len(words) - ngram + 1) if words else 0, step):
            part = words[start : start + step + ngram - 1]
            if block and held + len(part) > block_words:
                yield block
                block, held = [], 0
            block.append((row.item, b" ".join(part)))
            held += len(part)
    if block:
        yield block


def _spans(text: bytes, words: list[bytes], hit: np.ndarray) -> list[dict]:
    """Character spans of maximal runs of hit words."""
    places = [m.span() for m in _WORD_RE.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    out, at, chars = [], 0, 0
    for a, b in zip(edge[::2], edge[1::2]):
        lo, hi = places[a][0], places[b - 1][1]
        chars += len(text[at:lo].decode())
        start = chars
        chars += len(text[lo:hi].decode())
        out.append({"start": start, "stop": chars})
        at = hi
    return out


def scan_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    ngram: int = 8,
    block_words: int = 4_000_000,
) -> DataFrame:
    """docs with one struct column more (named ``scan``, or ``scan_`` where that is taken).

    It holds n_words, n_hit (words inside any occurrence of a benchmark window), items (sorted
    ids of the items hit) and spans (code-point ranges of maximal hit runs).
    """
    spark = docs.sparkSession
    state, out = fresh(docs, "hits"), fresh(docs, "scan")
    blocks = _blocks(benchmark, item_col, item_text_col, ngram, block_words)
    df, block, number = docs, next(blocks, []), 0
    while True:
        following = next(blocks, None)
        broadcast = spark.sparkContext.broadcast((uuid.uuid4().hex, block))
        last = following is None
        has_state = number > 0

        def scan(batches, broadcast=broadcast, last=last, has_state=has_state):
            index = _index(broadcast, ngram)
            for batch in batches:
                names = batch.schema.names
                texts = batch.column(names.index(text_col)).cast(pa.binary()).to_pylist()
                before = batch.column(names.index(state)).to_pylist() if has_state else [None] * len(texts)
                states, rows = [], []
                for text, was in zip(texts, before):
                    words = split_words(text)
                    found = (pickle.loads(was) if was else []) + index.hits(words)
                    if not last:
                        states.append(pickle.dumps(found) if found else None)
                        continue
                    if not found:
                        rows.append((len(words), 0, [], []))
                        continue
                    mark = np.zeros(len(words) + 1, np.int64)
                    items: set[str] = set()
                    for start, size, ids in found:
                        mark[start] += 1
                        mark[start + size] -= 1
                        items |= ids
                    hit = np.cumsum(mark)[:-1] > 0
                    rows.append((len(words), int(hit.sum()), sorted(items), _spans(text, words, hit)))
                kept = [(n, c) for n, c in zip(names, batch.columns) if n != state]
                if last:
                    n_words, n_hit, items_, spans = zip(*rows) if rows else ((), (), (), ())
                    span_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                    made = pa.StructArray.from_arrays(
                        [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items_, pa.list_(pa.string())), pa.array(spans, span_type)],
                        ["n_words", "n_hit", "items", "spans"],
                    )
                    kept.append((out, made))
                else:
                    kept.append((state, pa.array(states, pa.binary())))
                yield pa.RecordBatch.from_arrays([c for _, c in kept], [n for n, _ in kept])

        fields = list(docs.schema.fields)
        if last:
            fields.append(T.StructField(out, T.StructType.fromDDL(SCAN_TYPE)))
        else:
            fields.append(T.StructField(state, T.BinaryType()))
        df = df.mapInArrow(scan, T.StructType(fields))
        if last:
            return df
        df = materialize(df, "benchmark-hits")  # one index at a time
        block, number = following, number + 1


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    min_items: int = 2,
    ngram: int = 8,
    **names,
) -> DataFrame:
    """docs without contaminated documents; what is left loses its hit spans.

    A document that holds windows of ``min_items`` items or more goes.  In the others each hit
    run of words is cut out.  Columns stay as they are; documents without hits are untouched.
    """
    scan = fresh(docs, "scan")
    seen = scan_benchmark(docs, benchmark, text_col=text_col, ngram=ngram, **names).where(F.size(f"{scan}.items") < min_items)
    # keep the text between one span and the next
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(f"{scan}.spans")),
        lambda i: F.substring(
            F.col(text_col),
            F.when(i == 0, 0).otherwise(F.get(f"{scan}.spans", i - 1)["stop"]) + 1,
            F.when(i == F.size(f"{scan}.spans"), F.char_length(text_col)).otherwise(F.get(f"{scan}.spans", i)["start"])
            - F.when(i == 0, 0).otherwise(F.get(f"{scan}.spans", i - 1)["stop"]),
        ),
    )
    cut = F.when(F.size(f"{scan}.spans") == 0, F.col(text_col)).otherwise(F.array_join(pieces, ""))
    return seen.select(*[cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", min_items: int = 2) -> DataFrame:
    """One row per document: words, hit words, items hit and their digest, and the verdict."""
    seen = scan_benchmark(docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark)
    return seen.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        F.col("scan.n_hit").alias("n_hit"),
        F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("scan.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("scan.items") >= min_items).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: contamination_report in DuckDB's SQL.
REPORT_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
windows as (select distinct item, least(8, len(w)) as k, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') as win
  from b, unnest(range(1, greatest(1, len(w) - 7) + 1)) as t(i) where len(w) > 0),
sizes as (select distinct k from windows),
own as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as win from d, sizes, unnest(range(1, len(w) - k + 2)) as t(i)),
hits as (select distinct doc_id, i, k, item from own join windows using (k, win)),
places as (select doc_id, count(distinct p) as n_hit from hits, unnest(range(i, i + k)) as u(p) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item from hits where item is not null) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join places using (doc_id) left join items using (doc_id)
"""
