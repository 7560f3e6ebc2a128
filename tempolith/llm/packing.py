"""Sequence packing by minimum bin slack.

Each task packs its own documents, so nothing is shuffled.  Whole windows are cut from long
documents; the remainders of a block of documents form a multiset of lengths.  For the
longest remainder a subset-sum over the others, kept as the bits of one integer, finds the
multiset that fills the window closest to capacity; backtracking through the stages gives the
counts, and the same pattern is used as often as the counts allow.  Windows with slack return
their pieces to the next block; in the last block such pieces are cut to fill windows, and
the task's last window is cut at powers of two, so that none is padded.

Defined cases: a null or empty text is the end token alone; repeated documents are packed
as often as they occur; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
#: Characters for which NFC is the identity and all libraries agree on classes and cases.
_PLAIN = regex.compile(r"[!-~¡-ɏ]*")
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of white-space-delimited chunks, cached.

    Chunks of plain characters go through the same merges in tiktoken's faster form, where the
    end of a word is a NUL byte; others, and all chunks under a tokenizer of another build, go
    to the tokenizers library.
    """

    #: Chunks that are kept, and the bytes of the longest that is.
    entries, longest = 400_000, 256

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}
        self.fast = self._fast(path)

    def _fast(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        wanted = {"type": "BPE", "dropout": None, "unk_token": None, "end_of_word_suffix": "</w>", "ignore_merges": False}
        split = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        if (
            any(model.get(k) != v for k, v in wanted.items())
            or any(vocab.get(a + b) != 512 + i for i, (a, b) in enumerate(merges))
            or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]
            or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": split}
        ):
            return None
        special = {t["content"] for t in spec["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {}
        for token, i in vocab.items():
            if token not in special:
                end = token.endswith("</w>") and token != "</w>"
                ranks[bytes(byte_of[c] for c in (token[:-4] if end else token)) + b"\0" * end] = i
        self.line = ranks.get(b"\n\0")
        if len(ranks) != len(vocab) - len(special & set(vocab)) or self.line is None:
            return None
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def _learn(self, chunks: list[bytes]) -> None:
        texts = [c.decode() for c in chunks]
        plain = [i for i, t in enumerate(texts) if "<|" not in t and _PLAIN.fullmatch(t)] if self.fast else []
        if plain:
            pieces = _WORDS.findall("\n".join([texts[i].lower() for i in plain]) + "\n")
            ids = np.array(self.fast.encode_ordinary("\0".join(pieces) + "\0"), "<u4")
            starts = [0, *(np.flatnonzero(ids == self.line) + 1).tolist()]
            raw = ids.tobytes()
            for i, a, b in zip(plain, starts[:-1], starts[1:], strict=True):
                self.cache[chunks[i]] = raw[4 * a : 4 * b - 4]
        rest = sorted(set(range(len(chunks))).difference(plain))
        for i, found in zip(rest, self.full.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
            self.cache[chunks[i]] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian ids of each text."""
        get = self.cache.get
        for text in texts:
            chunks = text.split()
            found = list(map(get, chunks))
            if None in found:
                if len(self.cache) > self.entries:
                    self.cache.clear()
                    self._learn(list(set(chunks)))
                else:
                    self._learn(list({c for c, ids in zip(chunks, found) if ids is None}))
                found = list(map(get, chunks))
                for chunk in [c for c in chunks if len(c) > self.longest]:
                    self.cache.pop(chunk, None)
            yield b"".join(found)


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def fill_window(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum is the closest to room from below, as {length: count}.

    lengths: the keys of counts with a count, in falling order.
    """
    mask, reach, stages = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room or not counts.get(length):
            continue
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            stages.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    target, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(stages):
        if not before >> target & 1:
            target -= length * take
            used[length] += take
    return used


def window_patterns(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """({length: count}, times) until counts, which is used up, is empty."""
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        used = fill_window(counts, lengths, capacity - longest)
        used[longest] += 1
        counts[longest] += 1
        times = min(counts[n] // c for n, c in used.items())
        for n, c in used.items():
            counts[n] -= c * times
        if any(not counts[n] for n in used):
            lengths = [n for n in lengths if counts[n]]
        yield dict(used), times


class Packer:
    """Packs pieces (doc, start, ids, doc_tokens) of one task; gives rows of the output."""

    def __init__(self, capacity: int, first_id: int, block_tokens: int):
        self.capacity, self.next_id, self.block_tokens = capacity, first_id, block_tokens
        self.pool: dict[int, list] = defaultdict(list)
        self.held = 0

    def _emit(self, pieces: list) -> list:
        rows, offset = [], 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids) // 4, ids, total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1
        return rows

    def add(self, doc, ids: bytes) -> list:
        rows, total = [], len(ids) // 4
        whole = total // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            rows += self._emit([(doc, start, ids[4 * start : 4 * (start + self.capacity)], total)])
        if whole < total:
            self.pool[total - whole].append((doc, whole, ids[4 * whole :], total))
            self.held += total - whole
        if self.held >= self.block_tokens:
            rows += self._pack()
        return rows

    def _pack(self) -> list:
        rows, slack = [], []
        for used, times in window_patterns({n: len(p) for n, p in self.pool.items()}, self.capacity):
            full = sum(n * c for n, c in used.items()) == self.capacity
            for _ in range(times):
                pieces = [self.pool[n].pop() for n, c in used.items() for _ in range(c)]
                if full:
                    rows += self._emit(pieces)
                else:
                    slack += pieces
        self.pool.clear()
        for piece in slack:
            self.pool[len(piece[2]) // 4].append(piece)
        self.held = sum(len(p[2]) // 4 for p in slack)
        return rows

    def finish(self) -> list:
        """The rest: MBS as far as windows fill, then cuts."""
        rows = self._pack()
        left = [p for n in sorted(self.pool, reverse=True) for p in self.pool[n]]
        rest = sum(len(p[2]) // 4 for p in left)
        window, room = [], min(self.capacity, 1 << (rest.bit_length() - 1) if rest else 0)
        for doc, start, ids, total in left:
            while ids:
                part, ids = ids[: 4 * room], ids[4 * room :]
                window.append((doc, start, part, total))
                start += len(part) // 4
                room -= len(part) // 4
                rest -= len(part) // 4
                if not room:
                    rows += self._emit(window)
                    window, room = [], min(self.capacity, 1 << (rest.bit_length() - 1) if rest else 0)
        return rows


def pack_sequences(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    block_tokens: int = 2_000_000,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``block_tokens`` bounds what a task holds at once.  Every sequence has ``capacity`` tokens,
    but for each task's last ones, which have powers of two.
    """

    def pack(batches):
        encoder = _encoder(tokenizer_path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33, block_tokens)
        end = np.array([end_id], "<u4").tobytes()

        def batch_of(rows):
            cols = list(zip(*rows))
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        kind, held = None, []
        for batch in batches:
            kind = batch.column(0).type
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                held += packer.add(doc, ids + end)
                if len(held) > 5_000:
                    yield batch_of(held)
                    held = []
        held += packer.finish()
        if held:
            yield batch_of(held)

    doc_type = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        pack, f"doc_id {doc_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def piece_report(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """pack_sequences with the checksum of each piece's ids in place of the ids."""
    return pack_sequences(docs, tokenizer_path, **options).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
