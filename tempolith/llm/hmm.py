"""Hidden Markov language model: training by Baum-Welch, exact scoring by the forward recursion.

Word counts of all training texts are aggregated first.  Words seen ``least_count`` times or
more, which grow in number with the corpus until they fill the table of TABLE_WORDS, and the
end mark have emission probabilities of their own; all other words share one emission class,
within which a word has its smoothed relative frequency (one unit of mass is left for unknown
words), so the model is a distribution over all texts.  A start found on a bounded sample of
documents, of long ones a piece from a place that a hash draws, is followed by Baum-Welch
passes over all training texts: each task sums expected counts over its documents, and Spark
adds them up by word.  Scores run the scaled forward recursion over whole texts, many documents
at a time; counts of words beyond a broadcast table of bounded size come from a join with all
word counts.

Defined cases: null and empty texts are the end mark alone; a null id counts as held out;
repeated rows each count and each get a row; without training texts every word is unknown.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn, materialize

#: Words of the broadcast count table, and the bytes a word in it may have.
TABLE_WORDS, WORD_BYTES = 200_000, 64
#: Mass that each count gets, as in the base score.
ADD = 0.1
_FLUSH = 300_000
_BUFFER = 400_000


@dataclass
class Model:
    """start (K), moves (K x K) and emits (K x (M + 2)): M words, the end mark, all other words."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


@dataclass
class Vocabulary:
    """The most frequent words with their counts, and totals over all training tokens."""

    words: list[bytes]
    counts: np.ndarray
    own: int
    tokens: int
    types: int
    ends: int

    def __post_init__(self):
        self.place = dict(zip(self.words, range(len(self.words))))
        self.rest = self.tokens - self.ends - int(self.counts[: self.own].sum())
        self.rest_types = max(0, self.types - (self.ends > 0) - min(self.own, len(self.words)))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word in the table, -1 outside."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def symbols(self, places: np.ndarray) -> np.ndarray:
        """Emission symbols of a text, end mark included."""
        out = np.append(places, self.own)
        out[:-1][(places < 0) | (places >= self.own)] = self.own + 1
        return out


def split_words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


@dataclass
class _Layout:
    """Documents side by side, longest first: step t holds the first widths[t] of them."""

    flat: np.ndarray
    order: np.ndarray
    offsets: list[int]
    rank: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> _Layout:
        lengths = np.array([len(d) for d in docs])
        order = np.argsort(-lengths, kind="stable")
        steps = int(lengths.max())
        widths = len(docs) - np.cumsum(np.bincount(lengths, minlength=steps + 1))[:steps]
        offsets = np.concatenate([[0], np.cumsum(widths)])
        rank_of = np.empty(len(docs), np.int64)
        rank_of[order] = np.arange(len(docs))
        starts = np.cumsum(lengths) - lengths
        t = np.arange(lengths.sum()) - np.repeat(starts, lengths)
        r = np.repeat(rank_of, lengths)
        to = offsets[t] + r
        flat, rank = np.empty(len(to), np.int64), np.empty(len(to), np.int64)
        flat[to], rank[to] = np.concatenate(docs), r
        return cls(flat, order, offsets.tolist(), rank)


def _forward(model: Model, lay: _Layout, keep: bool = False):
    """Scale factors of every token, and the scaled forward values if they are kept."""
    emit = np.ascontiguousarray(model.emits.T)[lay.flat]
    scale = np.empty(len(lay.flat))
    moves, before = model.moves, None
    for a, b in zip(lay.offsets, lay.offsets[1:]):
        now = emit[a:b]
        now *= model.start if before is None else before[: b - a] @ moves
        total = now.sum(1)
        now /= total[:, None]
        scale[a:b] = total
        before = now
    return scale, emit if keep else None


def log10_likelihoods(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each symbol sequence."""
    if not docs:
        return np.zeros(0)
    lay = _Layout.of(docs)
    scale, _ = _forward(model, lay)
    out = np.empty(len(docs))
    out[lay.order] = np.bincount(lay.rank, np.log10(scale), minlength=len(docs))
    return out


def expected_counts(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (start, moves, emits) over the sequences: the E step."""
    k = len(model.start)
    lay = _Layout.of(docs)
    scale, alpha = _forward(model, lay, keep=True)
    table = np.ascontiguousarray(model.emits.T)
    moves, offsets = np.zeros((k, k)), lay.offsets
    follow = np.zeros((0, k))
    for t in range(len(offsets) - 2, -1, -1):
        a, b = offsets[t], offsets[t + 1]
        now, n = alpha[a:b], len(follow)
        beta = np.ones((b - a, k))
        if n:
            beta[:n] = follow @ model.moves.T
            moves += now[:n].T @ follow
        follow = table[lay.flat[a:b]] * beta / scale[a:b, None]
        now *= beta
    emits = np.stack([np.bincount(lay.flat, alpha[:, i], minlength=model.emits.shape[1]) for i in range(k)])
    return alpha[: offsets[1]].sum(0), moves * model.moves, emits


def maximise(start: np.ndarray, moves: np.ndarray, emits: np.ndarray, share: np.ndarray, prior: float = 20.0) -> Model:
    """The M step; share is the overall distribution of symbols, worth ``prior`` counts a state."""
    start, moves = start + 1.0, moves + 1.0
    emits = emits + prior * share
    return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))


def _buffers(texts: Iterator[bytes | None], vocabulary: Vocabulary) -> Iterator[list[np.ndarray]]:
    """Symbol sequences in lists of about _BUFFER tokens."""
    held, size = [], 0
    for text in texts:
        held.append(vocabulary.symbols(vocabulary.places(split_words(text))))
        size += len(held[-1])
        if size >= _BUFFER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _topics(docs: list[np.ndarray], share: np.ndarray, states: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Emissions of a mixture in which each text has one state, from distant texts as seeds."""
    flat, owner = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    width = 1024
    vectors = np.sqrt(np.bincount(owner * width + flat % width, minlength=len(docs) * width).reshape(-1, width))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    seeds, far = [int(rng.integers(len(docs)))], np.ones(len(docs))
    while len(seeds) < states:
        far = np.minimum(far, np.maximum(0.0, 1 - vectors @ vectors[seeds[-1]])) + 1e-9
        seeds.append(int(rng.choice(len(docs), p=far / far.sum())))
    weight = np.zeros((len(docs), states))
    weight[np.arange(len(docs)), np.argmax(vectors @ vectors[seeds].T, 1)] = 1.0
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]])
    for _ in range(rounds):
        emits = np.stack([np.bincount(flat, weight[owner, k], minlength=len(share)) for k in range(states)]) + 200.0 * share
        emits /= emits.sum(1, keepdims=True)
        fit = np.add.reduceat(np.log(emits).T[flat], starts) + np.log(weight.mean(0) + 1e-3)
        weight = np.exp(fit - fit.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
    return emits


def warm_start(texts: list[bytes], vocabulary: Vocabulary, share: np.ndarray, states: int, rounds: int, seed: int) -> Model:
    """A first model from a bounded sample of texts: states of a mixture over texts, which then may change inside a text."""
    rng = np.random.default_rng(seed)
    parts = list(_buffers(iter(texts), vocabulary))
    emits = _topics([d for p in parts for d in p], share, states, rounds, rng) if parts else np.tile(share, (states, 1))
    emits = emits * rng.uniform(0.98, 1.02, emits.shape)  # equal states would stay equal
    emits /= emits.sum(1, keepdims=True)
    moves = 0.9 * np.eye(states) + 0.1 / states
    model = Model(np.full(states, 1 / states), moves, emits)
    for _ in range(rounds // 2 if parts else 0):
        sums = [expected_counts(model, p) for p in parts]
        model = maximise(*(sum(s) for s in zip(*sums)), share)
    return model


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n): counts of all words of docs.text, summed map-side first."""

    def count(batches):
        seen: Counter[bytes] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(split_words(text))
                if len(seen) > _FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _vocabulary(counts: DataFrame, ends: int, least_count: int) -> Vocabulary:
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # a histogram of logarithmic counts says above which count there are few enough words
    short = counts.where(F.octet_length("word") <= WORD_BYTES).withColumn("bin", F.floor(F.log2("n") * 64))
    least, room = 1 << 30, TABLE_WORDS
    for b, words in sorted(((r.bin, r.v) for r in short.groupBy("bin").agg(F.count("*").alias("v")).collect()), reverse=True):
        if words > room:
            break
        least, room = b, room - words
    top = short.where(F.col("bin") >= least).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words, numbers = top.column("word").to_pylist(), top.column("n").to_numpy().astype(np.int64)
    return Vocabulary(words, numbers, int((numbers >= least_count).sum()), (totals.n or 0) + ends, totals.v + (ends > 0), ends)


def train(train_docs: DataFrame, vocabulary: Vocabulary, *, states: int, passes: int, sample_docs: int, sample_chars: int, rounds: int, seed: int) -> Model:
    """Baum-Welch over all of train_docs.text, from a start on sample_docs texts, or pieces of sample_chars of longer ones."""
    spark, own = train_docs.sparkSession, vocabulary.own
    share = np.concatenate([vocabulary.counts[:own], [vocabulary.ends, vocabulary.rest]]).astype(float) + ADD
    share /= share.sum()
    room = F.greatest(F.length("text") - sample_chars + 1, F.lit(1))
    small = train_docs.select("doc_id", F.substring("text", (F.pmod(F.xxhash64("text"), room) + 1).cast("int"), F.lit(sample_chars)).alias("text"))
    key = F.struct("doc_id", "text")
    texts = drawn(small, key, sample_docs, vocabulary.ends).select("text").toArrow().column(0).cast(pa.binary()).to_pylist()
    model = warm_start(texts, vocabulary, share, states, rounds, seed)
    vocabulary_ = spark.sparkContext.broadcast(vocabulary)
    names = ["row", *[f"k{i}" for i in range(states)]]
    for _ in range(passes):
        model_ = spark.sparkContext.broadcast(model)

        def expect(batches, model_=model_):
            now = model_.value
            sums = [np.zeros_like(x) for x in (now.start, now.moves, now.emits)]
            texts = (t for batch in batches for t in batch.column(0).cast(pa.binary()).to_pylist())
            for docs in _buffers(texts, vocabulary_.value):
                for total, part in zip(sums, expected_counts(now, docs)):
                    total += part
            rows = np.concatenate([sums[0][None, :], sums[1], sums[2].T])
            some = np.flatnonzero(rows.sum(1) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(rows[some, i]) for i in range(states)]], names)

        schema = "row long, " + ", ".join(f"{n} double" for n in names[1:])
        summed = train_docs.select("text").mapInArrow(expect, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names[1:]])
        got = summed.toArrow()
        rows = np.zeros((1 + states + own + 2, states))
        rows[got.column("row").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names[1:]], 1)
        model = maximise(rows[0], rows[1 : 1 + states], rows[1 + states :].T, share)
    return model


def score_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = 8,
    least_count: int = 5,
    passes: int = 2,
    sample_docs: int = 1_500,
    sample_chars: int = 16_384,
    rounds: int = 12,
    seed: int = 11,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Documents whose id has a crc32 divisible by 10 are held out of all counts.  What reaches the
    driver is bounded: the sample (sample_docs x sample_chars), TABLE_WORDS counts, and
    (TABLE_WORDS + states) x states expected counts a pass.
    """
    spark = docs.sparkSession
    held = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out")
    slim = docs.select(F.col(id_col).alias("doc_id"), held, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    learn = slim.where("not held_out")
    counts = materialize(word_counts(learn), "word-counts")
    ends = learn.count()
    vocabulary = _vocabulary(counts, ends, least_count)
    model = train(learn, vocabulary, states=states, passes=passes, sample_docs=sample_docs, sample_chars=sample_chars, rounds=rounds, seed=seed)
    shared = spark.sparkContext.broadcast((vocabulary, model))
    base_mass = vocabulary.tokens + ADD * (vocabulary.types + 1)
    rest_mass = vocabulary.rest + ADD * (vocabulary.rest_types + 1)

    def score(batches):
        vocabulary, model = shared.value
        uid = TaskContext.get().partitionId() << 33
        numbers = np.append(vocabulary.counts, 0)
        base_of = np.append(np.log10((vocabulary.counts + ADD) / base_mass), 0.0)
        rest_of = np.append(np.log10((vocabulary.counts + ADD) / rest_mass), 0.0)
        rest_of[: vocabulary.own] = 0.0
        end_base = np.log10((vocabulary.ends + ADD) / base_mass)
        held: list[tuple] = []
        size, kind = 0, None

        def rows():
            scores = log10_likelihoods(model, [h[3] for h in held])
            uids, words, times = [], [], []
            for h, s in zip(held, scores):
                uids.append(h[0])
                words.append(b" %d" % h[0])
                times.append(0)
                uids += [h[0]] * len(h[4])
                words += list(h[4])
                times += list(h[4].values())
            first = np.cumsum([0] + [1 + len(h[4]) for h in held])[:-1]
            gap = lambda values, t: pa.array(values, t).take(pa.array(place, pa.int64()))
            place = np.full(len(uids), -1, np.int64)
            place[first] = np.arange(len(held))
            place = [p if p >= 0 else None for p in place.tolist()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(uids, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int64()),
                    gap([h[1] for h in held], kind), gap([h[2] for h in held], pa.bool_()),
                    gap([len(h[3]) for h in held], pa.int64()), gap([h[5] for h in held], pa.int64()),
                    gap([h[6] for h in held], pa.float64()), gap([h[7] + s for h, s in zip(held, scores)], pa.float64()),
                ],
                ["uid", "word", "times", "doc_id", "held_out", "n_tokens", "known", "base", "score"],
            )

        for batch in batches:
            kind = batch.column(0).type
            for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                words = split_words(text)
                places = vocabulary.places(words)
                missed = Counter([words[i] for i in np.flatnonzero(places < 0)])
                known = int((numbers[places] > 0).sum()) + (vocabulary.ends > 0)
                held.append((uid, doc, out, vocabulary.symbols(places), missed, known, float(base_of[places].sum() + end_base), float(rest_of[places].sum())))
                uid += 1
                size += len(words) + 1
                if size >= _BUFFER:
                    yield rows()
                    held.clear()
                    size = 0
        if held:
            yield rows()

    doc_type = slim.schema[0].dataType.simpleString()
    rows = slim.mapInArrow(
        score, f"uid long, word binary, times long, doc_id {doc_type}, held_out boolean, n_tokens long, known long, base double, score double"
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    share = lambda mass: F.col("times") * F.log10((n + ADD) / F.lit(mass))
    joined = rows.join(counts, "word", "left")
    return (
        joined.groupBy("uid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            (F.max("known") + F.sum(F.when(n > 0, F.col("times")).otherwise(0))).alias("n_known"),
            (F.max("base") + F.sum(F.when(F.col("times") > 0, share(base_mass)).otherwise(0.0))).alias("base_score"),
            (F.max("score") + F.sum(F.when(F.col("times") > 0, share(rest_mass)).otherwise(0.0))).alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")
    )
