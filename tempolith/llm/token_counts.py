"""Token counts by a two-tier look-up, without a shuffle.

A text is cut where no vocabulary piece can reach across: before a run of spaces and around
line ends.  The lengths of frequent pre-tokens, taken from a bounded sample of documents, are
broadcast as one compact table; what the table misses is encoded by the library itself, in
batches, through a cache each worker keeps.  The table only saves work: counts do not depend
on it.  Texts with shapes the cut does not cover go to the library whole.

Defined cases: null and empty texts have 0 bytes and 0 tokens.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_models: dict[str, object] = {}
_cache: dict[str, dict[str, int]] = {}
#: Entries a worker's cache may hold before it starts anew, and the characters of the longest that is kept.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 256


def _model(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def _separable(model) -> bool:
    """Whether no piece crosses a space or holds a line feed, and texts gain one leading space."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces) and model.encode("a", out_type=str)[0].startswith("▁")


def _cut(text: str) -> list[str] | None:
    """Pre-tokens; one that begins with a line feed has no space before it, all others have one.

    None where the text must go to the library whole.
    """
    if "  " in text or text[0] == " " or "▁" in text or "\0" in text:
        return None
    return text.replace("\n", " \n").split(" ")


def _lengths(model, pieces: list[str]) -> list[int]:
    """Tokens of each pre-token; the library puts a space before each text, which line feeds lack."""
    return [len(ids) - p.startswith("\n") if p else 1 for p, ids in zip(pieces, model.encode(pieces, num_threads=1))]


def frequent_lengths(docs: DataFrame, model_path: str, text_col: str, sample_docs: int, entries: int) -> dict[str, int]:
    """Lengths of the ``entries`` most frequent pre-tokens of at most ``sample_docs`` documents."""
    counts: Counter[str] = Counter()
    rows = docs.select(F.substring(F.col(text_col).cast("string"), 1, 20_000).alias("t")).where("t <> ''")
    for row in rows.take(sample_docs):  # runs as few tasks as it takes, and shuffles nothing
        counts.update(_cut(row.t) or ())
    pieces = [p for p, _ in counts.most_common(entries) if len(p) <= 64]
    return dict(zip(pieces, _lengths(_model(model_path), pieces))) if pieces else {}


def count_tokens(
    docs: DataFrame,
    model_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    sample_docs: int = 2_000,
    table_entries: int = 50_000,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each document.

    ``model_path`` names a sentencepiece model that driver and executors can open.  The sample
    behind the table is at most ``sample_docs`` documents of 20,000 code points each.
    """
    spark = docs.sparkSession
    table = frequent_lengths(docs, model_path, text_col, sample_docs, table_entries) if _separable(_model(model_path)) else None
    shared = spark.sparkContext.broadcast(table)

    def count(batches):
        model, frequent = _model(model_path), shared.value
        cache = _cache.setdefault(model_path, {})
        for batch in batches:
            n_bytes, n_tokens = [], []
            texts = batch.column(1).to_pylist()
            cuts, missing, whole = [], set(), []
            for i, text in enumerate(texts):
                parts = _cut(text) if text and frequent is not None else None
                if text and parts is None:
                    whole.append(i)
                cuts.append(parts)
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            get, known = frequent.get if frequent is not None else None, cache.get
            for i, parts in enumerate(cuts):
                if parts is None:
                    n_tokens.append(0)
                    continue
                lengths = list(map(get, parts))
                total = 0
                if None in lengths:
                    missed = [p for p, n in zip(parts, lengths) if n is None]
                    total = sum(n for n in lengths if n is not None)
                    found = list(map(known, missed))
                    if None in found:
                        new = list({p for p, n in zip(missed, found) if n is None})
                        cache.update(zip(new, _lengths(model, new)))
                        found = list(map(known, missed))
                        for piece in [p for p in new if len(p) > CACHE_CHARS]:
                            del cache[piece]
                    total += sum(found)
                else:
                    total = sum(lengths)
                n_tokens.append(total)
            for i in whole:
                n_tokens[i] = len(model.encode(texts[i], num_threads=1))
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            counts = np.array(n_tokens, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
