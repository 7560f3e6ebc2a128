"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are reduced to distinct ones first, so copies cost one row.  Bits that correlate
share a partition; if two fingerprints differ in at most tau bits, then for thresholds t_i
that add up to tau - m + 1 over m partitions some partition differs in at most t_i bits.  A
dynamic program over estimated candidate counts allocates the t_i (-1: not probed).  Probing
looks up every value within t_i of a fingerprint's bits, and candidates are verified on all
64 bits.  Large buckets are compared block by block in many tasks, and every comparison
emits a forest of links, not all pairs.  Estimates steer cost alone: links are exact.

near_duplicate_classes links fingerprints of one kind that differ in at most tau bits.
drop_near_duplicates wants more: every pair of texts whose five-word shingles have a Jaccard
similarity of 0.8 or more.  About 10 of 64 bits of such a pair differ, and probing for so many
would compare a fixed share of all pairs.  So TABLES independent fingerprints of the distinct
pairs of words, which edits change less, are each probed by the same plan for PROBE_TAU bits;
what meets in any bucket is a candidate and is verified on its shingles.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; a
null doc_id is never a component's id unless all its ids are null; repeated rows stay.  To
drop_near_duplicates a text of fewer words than a shingle is one shingle of all its words, and
distinct texts are told apart by 64-bit hashes of their lower-case words.
"""

from __future__ import annotations

from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drawn, fresh, keep_rows, materialize, row_key
from .components import component_roots

BITS = 64
#: Distinct fingerprints the estimates are drawn from.
SAMPLE = 4_096
#: Fingerprints of one bucket that are compared in one block.
BLOCK = 1_024
#: Independent fingerprints of drop_near_duplicates, the words of their shingles, and the bits they are probed for.
TABLES, PROBE_WORDS, PROBE_TAU = 12, 2, 2
#: Leading fingerprints of those that a comparison before the texts looks at, and the most bits they may differ in:
#: 0.15 of the bits of a pair of similarity 0.8 differ, within 6 deviations at most 0.28, and 0.45 of an unrelated pair's.
LOOSE, LOOSE_TAU = 4, 72
#: Texts of one bucket that are compared in one block.
TEXT_BLOCK = 1_024
_SEED = 42
_STEP = 1 << 15
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_XOR, _TIMES = np.random.default_rng(_SEED).integers(0, 1 << 64, (2, TABLES), np.uint64) | np.uint64(1)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash over XXH64 hashes of word shingles, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), _SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    ones, total, digest = np.zeros(BITS, np.int64), 0, xxhash.xxh64_intdigest
    while part := [digest(g, _SEED) for g in islice(grams, _STEP)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long, a row for each document."""

    def compute(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t, shingle) for t in texts], "<u8").view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(compute, f"id {kind}, fp long")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of almost equal size, correlated bits together."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(0)
    spread = np.sqrt((bits**2).sum(0))
    together = np.abs(bits.T @ bits) / np.maximum(np.outer(spread, spread), 1e-9)
    free, groups = set(range(BITS)), []
    for left in range(parts, 0, -1):
        order = sorted(free)
        sub = together[np.ix_(order, order)] - 2 * np.eye(len(order))
        group = [order[int(np.unravel_index(np.argmax(sub), sub.shape)[0])]]
        while len(group) < len(free) // left:
            rest = sorted(free.difference(group))
            group.append(rest[int(np.argmax(together[np.ix_(rest, group)].mean(1)))])
        groups.append(sorted(group))
        free.difference_update(group)
    return groups


def _close(sample: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most 0..most bits of the group."""
    mask = np.uint64(sum(1 << b for b in group))
    part = sample & mask
    seen = np.zeros(most + 1)
    for i in range(0, len(part), 256):
        far = np.bitwise_count(part[i : i + 256, None] ^ part[None, :])
        seen += [(far <= e).sum() for e in range(most + 1)]
    pairs = max(1, len(part) * (len(part) - 1))
    # independent bits give a floor where the sample shows no pair
    ways = np.array([1.0] + [0.0] * most)
    for b in group:
        p = float(((sample >> np.uint64(b)) & np.uint64(1)).mean())
        same = min(max(p * p + (1 - p) * (1 - p), 0.5), 1 - 1e-6)
        ways = ways * same + np.concatenate([[0.0], ways[:-1]]) * (1 - same)
    return [max((s - len(part)) / pairs, f) for s, f in zip(seen, np.cumsum(ways))]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of -1 or more that add up to total at the least cost; costs[i][t + 1] is that of t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for spent, (price, chosen) in best.items():
            for t in range(-1, len(cost) - 1):
                option = (price + cost[t + 1], [*chosen, t])
                if spent + t not in following or option < following[spent + t]:
                    following[spent + t] = option
        best = following
    return best[total]


def plan_probes(sample: np.ndarray, count: int, tau: int) -> list[tuple[int, list[int]]]:
    """(mask, flips) of each partition that is probed; flips are what to xor for its probes."""
    best = None
    for parts in range(2, tau + 2):
        groups = group_bits(sample, parts)
        costs = []
        for g in groups:
            shares = _close(sample, g, tau)
            probes = [sum(comb(len(g), k) for k in range(t + 1)) for t in range(tau + 1)]
            # a candidate costs a comparison, a probe a shuffled row
            costs.append([0.0] + [0.05 * shares[t] * count * count / 2 + 2.0 * probes[t] * count for t in range(tau + 1)])
        price, chosen = allocate(costs, tau - parts + 1)
        if best is None or price < best[0]:
            best = (price, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [
        (signed(sum(1 << b for b in g)), [signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(g, k)])
        for g, t in best[1]
    ]


def _forest(fps: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a chain of pairs within tau joins among a block's fingerprints."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= tau
    label = np.arange(len(fps))
    while True:
        following = np.where(near, label[None, :], len(fps)).min(1)
        following = following[following]
        if (following == label).all():
            break
        label = following
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def links(distinct: DataFrame, tau: int) -> DataFrame:
    """(u, v) links whose chains connect all of distinct.fp that differ in at most tau bits."""
    count = distinct.count()
    sample = drawn(distinct.select("fp"), F.col("fp"), SAMPLE, count).toArrow().column("fp").to_numpy().astype(np.int64).view(np.uint64)
    if count < 2:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("false")
    parts = [
        distinct.select(
            F.lit(i).alias("part"),
            F.explode(F.array(*[F.lit(f) for f in flips])).alias("flip"),
            F.col("fp").bitwiseAND(F.lit(mask)).alias("own"),
            "fp",
        )
        for i, (mask, flips) in enumerate(plan_probes(sample, count, tau))
    ]
    probes = parts[0]
    for p in parts[1:]:
        probes = probes.union(p)
    probes = probes.select("part", F.col("own").bitwiseXOR(F.col("flip")).alias("key"), "fp", (F.col("flip") == 0).cast("int").alias("own"))
    sizes = probes.groupBy("part", "key").agg(F.count("*").alias("n"), F.sum("own").alias("own_n")).where("n > 1 and own_n > 0")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = (
        probes.join(sizes, ["part", "key"])
        .select("part", "key", "fp", blocks.alias("blocks"))
        .withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(1)), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", "key", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), "fp")
    )
    keys = ["part", "key", "b1", "b2"]

    def compare(batches):
        """Sorted rows; a group that a batch leaves open waits for the next one."""

        def close(table):
            cols = [table.column(k).to_numpy() for k in range(5)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            us, vs = [], []
            fps = cols[4].view(np.uint64)
            bounds = [0, *change.tolist(), len(fps)]
            sizes = np.diff(bounds)
            two = np.array(bounds[:-1])[sizes == 2]
            if len(two):
                ok = np.bitwise_count(fps[two] ^ fps[two + 1]) <= tau
                us.append(fps[two[ok]])
                vs.append(fps[two[ok] + 1])
            for a, b, n in zip(bounds, bounds[1:], sizes):
                if n > 2:
                    u, v = _forest(np.unique(fps[a:b]), tau)
                    us.append(u)
                    vs.append(v)
            u, v = np.concatenate([*us, np.zeros(0, np.uint64)]), np.concatenate([*vs, np.zeros(0, np.uint64)])
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        open_rows = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if open_rows is not None:
                table = pa.concat_tables([open_rows, table]).combine_chunks()
            if not table.num_rows:
                continue
            cols = [table.column(k).to_numpy() for k in range(4)]
            last = np.all([c == c[-1] for c in cols], axis=0)
            start = table.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
            if start:
                yield close(table.slice(0, start).combine_chunks())
            open_rows = table.slice(start).combine_chunks()
        if open_rows is not None and open_rows.num_rows:
            yield close(open_rows)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "u long, v long")


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 3) -> DataFrame:
    """(id, fp, component): every document with the least id its fingerprint's links reach."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = component_roots(links(distinct.select("fp"), tau), "simhash-links")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(rooted, "simhash-roots")
    # only components of several fingerprints need another look at their least id
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    labels = named.join(least, "root").select("fp", "component")
    return prints.join(labels, "fp").select("id", "fp", "component")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = near_duplicate_classes(docs)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def text_hash(text: bytes | None) -> int:
    """64-bit hash of a text's lower-case words."""
    return xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split()), _SEED)


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of ``width`` words."""
    words = (text or b"").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), _SEED)], np.uint64)
    each = np.array([xxhash.xxh64_intdigest(w, _SEED) for w in words], np.uint64)
    runs = len(each) - width + 1
    total = np.zeros(runs, np.uint64)
    for i in range(width):
        total = (total ^ each[i : i + runs]) * _GOLDEN
        total ^= total >> np.uint64(29)
    return np.unique(total)


def table_prints(grams: np.ndarray) -> np.ndarray:
    """TABLES independent 64-bit SimHashes of distinct shingles."""
    ones = np.zeros(TABLES * BITS, np.int64)
    for i in range(0, len(grams), 255):  # so many ones fit a byte
        h = (grams[i : i + 255, None] ^ _XOR) * _TIMES
        h = (h ^ (h >> np.uint64(32))) * _GOLDEN
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")


def shingle_forest(grams: list[np.ndarray], tenths: int, label: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what a chain of pairs of similarity tenths / 10 or more joins, beside what has one label already."""
    ids, at = np.unique(np.concatenate(grams), return_inverse=True)
    sizes = np.array([len(g) for g in grams])
    starts = np.cumsum(sizes) - sizes
    label, found = label.copy(), []
    for i in range(len(grams) - 1):
        if (label == label[0]).all():
            break
        mine = np.zeros(len(ids), bool)
        mine[at[starts[i] : starts[i] + sizes[i]]] = True
        both = np.add.reduceat(mine[at].astype(np.int64), starts)
        near = (10 * both >= tenths * (sizes[i] + sizes - both)) & (label != label[i])
        for j in np.flatnonzero(near).tolist():
            if label[j] != label[i]:
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def _grouped(batches, keys: int):
    """Rows of sorted batches as (key, rows of a group); a group that a batch leaves open goes on in the next one."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if len(held) > 1:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if len(held) > 1:
        yield now, held


def _in_blocks(rows: DataFrame, n: str, block: int) -> DataFrame:
    """rows (part, key, hash, ...) of buckets of n rows, dealt to the pairs of their bucket's blocks (b1, b2)."""
    blocks = rows.withColumn("_blocks", F.ceil(F.col(n) / block).cast("int")).drop(n)
    mine = blocks.withColumn("_mine", F.pmod(F.xxhash64("hash", F.lit(1)), "_blocks").cast("int"))
    both = mine.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return both.withColumns({"b1": F.least("_mine", "_other"), "b2": F.greatest("_mine", "_other")}).drop("_blocks", "_mine", "_other")


def _buckets(distinct: DataFrame, plans: list[tuple[int, int, list[int]]]) -> DataFrame:
    """(part, key, hash) of the buckets of plans (table, mask, flips) in which texts meet that are close by their leading fingerprints."""
    probes = [
        F.struct(F.lit(i).alias("part"), F.get("prints", F.lit(t)).bitwiseAND(F.lit(mask)).alias("own"), F.array(*[F.lit(f) for f in flips]).alias("flips"))
        for i, (t, mask, flips) in enumerate(plans)
    ]
    each = distinct.select("hash", F.explode(F.array(*probes)).alias("p")).select("hash", "p.part", "p.own", F.explode("p.flips").alias("flip"))
    members = each.select("part", F.col("own").bitwiseXOR(F.col("flip")).alias("key"), "hash", (F.col("flip") == 0).cast("int").alias("own"))
    sizes = members.groupBy("part", "key").agg(F.count("*").alias("n"), F.sum("own").alias("own_n")).where("n > 1 and own_n > 0").drop("own_n")
    leading = distinct.select("hash", *[F.get("prints", F.lit(i)).alias(f"f{i}") for i in range(LOOSE)])
    met = members.drop("own").join(sizes, ["part", "key"])
    dealt = _in_blocks(met.join(leading, "hash"), "n", BLOCK).select("part", "key", "b1", "b2", "hash", *[f"f{i}" for i in range(LOOSE)])

    def compare(batches):
        for key, rows in _grouped(batches, 4):
            values = np.array(rows, np.int64)
            prints = values[:, 1:].view(np.uint64)
            near = np.zeros((len(rows), len(rows)), np.uint16)
            for i in range(LOOSE):
                near += np.bitwise_count(prints[:, None, i] ^ prints[None, :, i])
            some = np.flatnonzero((near <= LOOSE_TAU).sum(1) > 1)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(some), pa.int32()), pa.array([key[1]] * len(some), pa.int64()), pa.array(values[some, 0])], ["part", "key", "hash"])

    group = ["part", "key", "b1", "b2"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_merged(compare), "part int, key long, hash long").distinct()


def _merged(work):
    """work over batches, its small results put together."""

    def run(batches):
        held, rows = [], 0
        for made in work(batches):
            held.append(made)
            rows += made.num_rows
            if rows >= 10_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _verified(texts: DataFrame, met: DataFrame, roots: DataFrame | None, shingle: int, tenths: int) -> DataFrame:
    """(u, v) links of hashes that meet (part, key, hash) in buckets and are of different roots: texts has (hash, text), repeats allowed."""
    rooted = met.withColumn("root", F.col("hash"))
    if roots is not None:
        known = broadcast_if_small(roots.select(F.col("node").alias("hash"), F.col("root").alias("known")), 1_000_000)
        rooted = met.join(known, "hash", "left").withColumn("root", F.coalesce("known", "hash")).drop("known")
    sets = rooted.groupBy("part", "key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("hash")).alias("s1"), F.bit_xor(F.xxhash64("hash", F.lit(1))).alias("s2"), F.min("root").alias("lo"), F.max("root").alias("hi")
    ).where("n > 1 and lo < hi")
    # many buckets show the same few texts together: one for each set of texts
    once = sets.groupBy("n", "s1", "s2").agg(F.min(F.struct("part", "key")).alias("b")).select("b.part", "b.key", "n")
    shared = materialize(rooted.join(once, ["part", "key"]), "simhash-buckets")
    wanted = broadcast_if_small(materialize(shared.select("hash").distinct(), "simhash-wanted"), 1_000_000)
    read = texts.join(wanted, "hash", "left_semi").groupBy("hash").agg(F.min("text").alias("text"))
    dealt = _in_blocks(shared, "n", TEXT_BLOCK).join(read, "hash").select("part", "key", "b1", "b2", "hash", "root", F.col("text").cast("binary").alias("text"))

    def compare(batches):
        for _, rows in _grouped(batches, 4):
            found = shingle_forest([shingles(t, shingle) for _, _, t in rows], tenths, np.array([r for _, r, _ in rows]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rows[x[i]][0] for x in found], pa.int64()) for i in range(2)], ["u", "v"])

    group = ["part", "key", "b1", "b2"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_merged(compare), "u long, v long")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, tenths: int = 8) -> DataFrame:
    """docs with one row of each component of texts whose shingles' similarity is tenths / 10 or more.

    The row of the least (id, hash of the text, hash of the row) stays, null ids last.  The first
    two tables are probed and linked before the others, which then skip buckets of one component.
    """
    who = fresh(docs, "kept_row")
    keyed = docs.withColumn(who, row_key(docs, id_col, text_col))
    text = F.col(text_col).cast("string").alias("text")

    def compute(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            hashes = pa.array(np.array([text_hash(t) for t in texts], np.uint64).view(np.int64))
            prints = pa.array([table_prints(shingles(t, PROBE_WORDS)).view(np.int64) for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), hashes, prints], ["who", "hash", "prints"])

    def hashed(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(np.array([text_hash(t) for t in texts], np.uint64).view(np.int64)), batch.column(0)], ["hash", "text"])

    kind = keyed.select(who).schema[0].dataType.simpleString()
    prints = keyed.select(F.col(who).alias("who"), text).mapInArrow(compute, f"who {kind}, hash long, prints array<long>")
    distinct = materialize(prints.groupBy("hash").agg(F.min("who").alias("who"), F.first("prints").alias("prints")), "simhash-tables")
    texts, keys = docs.select(text).mapInArrow(hashed, "hash long, text string"), distinct.select("hash", "prints")
    count = distinct.count()
    if count:
        sample = np.array(drawn(keys, F.col("hash"), SAMPLE // 2, count).select("prints").toArrow().column("prints").to_pylist(), np.int64).view(np.uint64)
        plans = [(t, mask, flips) for t in range(TABLES) for mask, flips in plan_probes(sample[:, t], count, PROBE_TAU)]
    roots = None
    for part in ([p for p in plans if p[0] < 2], [p for p in plans if p[0] >= 2]) if count > 1 else ():
        found = _verified(texts, materialize(_buckets(keys, part), "simhash-met"), roots, shingle, tenths)
        if roots is not None:
            found = found.union(roots.select("node", "root"))
        roots = materialize(component_roots(found, "simhash-links"), "simhash-roots")
    named = distinct if roots is None else distinct.join(roots, distinct.hash == roots.node, "left")
    root = F.col("hash") if roots is None else F.coalesce("root", "hash")
    return keep_rows(keyed, who, named.groupBy(root).agg(F.min("who").alias("who")).select("who"))
