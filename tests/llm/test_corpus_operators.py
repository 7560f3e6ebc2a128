"""SimHash, suffix dedup, quality rules, language model, HTML and the pipeline against plain restatements."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tempolith.llm import components, hmm, html_extract, html_pages, quality_rules, simhash, suffix_dedup, suffix_sort

from .test_text_operators import EDGES, SF, docs, lower


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def roots_of(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    want = roots_of([x for x in links if x[0] != x[1]], {n for x in links for n in x})
    got = {r.node: r.root for r in components.component_roots(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert all(got.get(n, n) == r for n, r in want.items())


def test_simhash_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b")], "doc_id bigint, text string"))

    def fingerprint(text):
        w = split(lower(text or ""))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))

    rows = df.collect()
    fps = {r.doc_id: fingerprint(r.text) for r in rows}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = roots_of(near, fps)
    got = {r.doc_id: r for r in simhash.fingerprint_report(df).collect()}
    assert len(got) == len(rows) and near
    assert all(got[k].fingerprint == f"{fps[k]:016x}" and got[k].component_id == want[k] for k in fps)


def test_links_survive_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = np.random.default_rng(4)
    fps = {0}
    for _ in range(60):
        fps.add(sum(1 << int(b) for b in rng.integers(0, 64, 2)))
    fps |= {int(x) for x in rng.integers(0, 2**62, 200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), 3).collect()
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert roots_of([tuple(x) for x in links], signed) == roots_of(near, signed)


def test_allocation_is_the_cheapest():
    costs = [[0.0, 5.0, 9.0, 20.0], [0.0, 1.0, 30.0, 40.0], [0.0, 4.0, 4.5, 50.0]]
    price, chosen = simhash.allocate(costs, 1)
    every = [(sum(c[t + 1] for c, t in zip(costs, ts)), list(ts)) for ts in np.ndindex(4, 4, 4) for ts in [[t - 1 for t in ts]] if sum(ts) == 1]
    assert price == min(every)[0] and sum(chosen) == 1


def test_near_duplicates_leave_one(spark):
    text = "one two three four five six seven eight nine ten"
    df = docs(spark, [(3, text), (1, text), (2, "other words are here to stay for long"), (1, text), (None, "alone in the dark with no id at all")])
    kept = simhash.drop_near_duplicates(df)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, text), (2, "other words are here to stay for long"), (0, "alone in the dark with no id at all")])
    assert kept.columns == df.columns and simhash.fingerprint_report(docs(spark, [])).count() == 0


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    start = rng.integers(0, 380, 150)
    length = np.minimum(rng.integers(0, 40, 150), 400 - start)
    group = np.sort(rng.integers(0, 5, 150))
    order, lcp = suffix_sort.sort_suffixes(text, start, length, group)
    string = lambda i: text[start[i] : start[i] + length[i]].tobytes()
    for g in range(5):
        own = [i for i in order if group[i] == g]
        assert [string(i) for i in own] == sorted(string(i) for i in np.flatnonzero(group == g))
    for a, b, n in zip(order, order[1:], lcp[1:]):
        if group[a] == group[b]:
            same = next((k for k, (x, y) in enumerate(zip(string(a), string(b))) if x != y), min(len(string(a)), len(string(b))))
            assert n == same


def test_suffix_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    base = [bytes(rng.integers(97, 123, int(n)).astype(np.uint8)).decode() for n in rng.integers(150, 900, 30)]
    shared = "é" + base[0][:260]
    texts = base + [shared + b[:100] for b in base[:8]] + [b[:120] + shared + b[120:300] for b in base[8:16]] + ["ab" * 400, "x" * 500, base[1], base[1], base[2][:199], base[2][:199], base[3][50:280], None, ""]
    span, seen = 200, Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        seen.update(b[p : p + span] for p in range(len(b) - span + 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for limit in (100_000, 2):  # suffix sorts of whole groups, and of split ones
        got = {r.doc_id: r for r in suffix_dedup.repeat_report(df, group_limit=limit).collect()}
        assert len(got) == len(texts)
        for i, b in enumerate(raw):
            gone = np.zeros(len(b) + 2, int)
            for p in range(len(b) - span + 1):
                if seen[b[p : p + span]] > 1:
                    gone[p + 1] += 1
                    gone[p + span + 1] -= 1
            gone = np.cumsum(gone)[: len(b) + 1] > 0
            kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
            want = (len(b), int(gone[1:].sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    assert suffix_dedup.repeat_report(docs(spark, [])).count() == 0 and suffix_dedup.repeat_report(docs(spark)).count() == len(EDGES)


def test_suffix_dedup_of_a_text_beyond_the_buffer(spark):
    """Repeats across the border of two parts of one text, and of that text in a short one."""
    rng = np.random.default_rng(8)
    text = rng.integers(97, 123, suffix_dedup.BUFFER + 5000).astype(np.uint8).tobytes().decode()
    edge = suffix_dedup.BUFFER
    text = text[:1000] + text[edge - 150 : edge + 250] + text[1400:]
    other = "short " + text[edge - 90 : edge + 130] + " tail"
    got = {r.doc_id: r for r in suffix_dedup.repeat_report(spark.createDataFrame([(1, text), (2, other), (3, text[:199])], "doc_id bigint, text string")).collect()}
    kept = text[:1000] + text[1400 : edge - 150] + text[edge + 250 :]
    assert (got[1].n_removed, got[1].n_spans, got[1].kept_sha256) == (800, 2, hashlib.sha256(kept.encode()).hexdigest())
    assert (got[2].n_removed, got[2].n_spans) == (220, 1) and got[3].n_removed == 0


def test_suffix_dedup_holds_no_collision_for_a_repeat(monkeypatch):
    """With four values for all hashes of grams, and one for all rolling hashes, only equal bytes recur."""
    rng = np.random.default_rng(9)
    passage = rng.integers(97, 123, 700).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 123, 1500).astype(np.uint8).tobytes() for _ in range(4)]
    texts[3] = texts[3][:300] + passage + texts[3][300:] + passage
    monkeypatch.setattr(suffix_dedup, "_mix", lambda h: (h & np.uint64(3)) << np.uint64(40))
    rows = suffix_dedup._buffer_rows(list(suffix_dedup._segments(texts, 200)), 200).to_pylist()
    assert len({r["h"] for r in rows if r["kind"] == 0}) <= 4
    marked = [(r["key"], r["lo"], r["lo"] + r["size"]) for r in rows if r["kind"] == 1]
    assert marked and all(k == suffix_dedup.text_key(texts[3]) and (300 <= a and b <= 1000 or 1800 + 700 <= b and 1800 <= a) for k, a, b in marked)
    monkeypatch.setattr(suffix_sort.PrefixHashes, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    text = rng.integers(97, 99, 300).astype(np.uint8)
    start, length = rng.integers(0, 260, 60), np.full(60, 40)
    order, lcp = suffix_sort.sort_suffixes(text, start, length, np.zeros(60, int))
    strings = [text[a : a + 40].tobytes() for a in start[order]]
    assert strings == sorted(strings) and all((n == 40) == (x == y) for x, y, n in zip(strings, strings[1:], lcp[1:]))


def test_least_determinant_against_all_subsets(spark, monkeypatch):
    """Groups of 12 vectors, 3 of them far out: no half of six rows has a much smaller determinant than the one found."""
    from itertools import combinations

    monkeypatch.setattr(quality_rules, "SUBSET_ROWS", 6)  # of groups this small
    monkeypatch.setattr(quality_rules, "SUBSETS", 30)

    names, floors = [f for f, _ in quality_rules.FEATURES], np.array([f for _, f in quality_rules.FEATURES]) * quality_rules.UNIT
    rng = np.random.default_rng(21)
    mix = rng.normal(size=(5, 5)) * 40
    groups = {f"g{i}": np.rint(np.vstack([rng.normal(size=(9, 5)) @ mix, 3000 + 40 * rng.normal(size=(3, 5))])).astype(int) for i in range(6)}
    rows = [(g, *map(int, v)) for g, x in groups.items() for v in x] + [("few", 1, 2, 3, 4, 5)]
    schema = "_group string, " + ", ".join(f"_x_{n} bigint" for n in names)
    found = {r["_group"]: r for r in quality_rules.least_determinant(spark.createDataFrame(rows, schema), 10).collect()}
    assert sorted(found) == sorted(groups)
    gaps = []
    for g, x in groups.items():
        least = min(np.linalg.slogdet(np.cov(x[list(c)].T, bias=True) + np.diag(floors**2))[1] for c in combinations(range(12), 6))
        gaps.append(found[g]["_logdet"] - least)
        assert abs(found[g]["_mu_0"] - x[:9, 0].mean()) < 200
    assert min(gaps) > -1e-6 and np.median(gaps) < 1e-6 and max(gaps) < 0.5, gaps


def test_chi_squared_points():
    assert math.isclose(quality_rules.chi2_point(0.999, 5), 20.515, abs_tol=1e-3) and math.isclose(quality_rules.chi2_point(0.5, 5), 4.3515, abs_tol=1e-3)


def test_quality_rules_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(240):
        w = list(rng.choice(vocabulary, int(rng.integers(20, 400))))
        if i % 12 == 0:
            w = [x + "###" for x in w]
        if i % 15 == 0:
            w = w[:5] * (len(w) // 5)
        rows.append((i, "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)), "en" if i % 3 else "fr", f"s{i % 2}"))
    rows += [(900, None, "en", "s0"), (901, "", None, None), (902, "a b a b a b", "en", "s9")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc.doc_id: r for r in quality_rules.judge(df, min_group=60).collect()}
    order, cutoff = [], quality_rules.chi2_point(0.9999, 5)
    for i, text, lang, source in rows:
        w = split(text)
        lines = [x for x in (text or "").split("\n") if split(x)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        chars, signs, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), chars, signs, dup, len(covered), failed)
        assert (r.distance2 is None) == failed and r.kept == (not failed and r.distance2 <= cutoff)
        if not failed:
            order.append((i % 12 == 0, r.kept))
    # estimates from 60 rows, under the default's 200, take some of the tail of the lengths for outliers
    assert not any(kept for odd, kept in order if odd) and sum(kept for odd, kept in order if not odd) > 0.9 * sum(not odd for odd, _ in order)


def test_quality_rules_cases(spark):
    df = docs(spark)
    kept = quality_rules.keep_regular(df)
    assert kept.count() == 0 and kept.columns == df.columns and quality_rules.quality_report(docs(spark, [])).count() == 0
    assert quality_rules.quality_report(df).count() == len(EDGES)


def tiny_model():
    rng = np.random.default_rng(9)
    norm = lambda a: a / a.sum(-1, keepdims=True)
    return hmm.Model(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 6))))


def test_forward_recursion_equals_enumeration():
    from itertools import product

    m, rng = tiny_model(), np.random.default_rng(10)
    seqs = [rng.integers(0, 6, n) for n in (5, 1, 3, 5)]
    want = []
    for s in seqs:
        total = 0.0
        for path in product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emits[path[0], s[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= m.moves[a, b] * m.emits[b, x]
            total += p
        want.append(math.log10(total))
    assert np.allclose(hmm.log10_likelihoods(m, seqs), want)


def test_baum_welch_counts_and_progress():
    m, rng = tiny_model(), np.random.default_rng(11)
    seqs = [rng.integers(0, 4, int(n)) for n in rng.integers(1, 30, 40)]
    start, moves, emits = hmm.expected_counts(m, seqs)
    assert np.isclose(start.sum(), 40) and np.isclose(moves.sum(), sum(len(s) - 1 for s in seqs)) and np.allclose(emits.sum(0), np.bincount(np.concatenate(seqs), minlength=6))
    share, last = np.full(6, 1 / 6), -np.inf
    for _ in range(5):
        now = hmm.log10_likelihoods(m, seqs).sum()
        assert now >= last - 1e-6
        last, m = now, hmm.maximise(*hmm.expected_counts(m, seqs), share, prior=0.0)


def test_language_model_report(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "unseenword")], "doc_id bigint, text string"))
    rows = df.collect()
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in rows}
    counts = Counter(t for i, w in tokens.items() if not out(i) for t in w)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in hmm.score_documents(df, least_count=3, passes=1).collect()}
    for i, w in tokens.items():
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(i), len(w), sum(counts[t] > 0 for t in w), n) and math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.score_documents(docs(spark, [])).count() == 0 and hmm.score_documents(docs(spark), passes=1).count() == len(EDGES)


def test_words_with_emissions_grow_with_the_corpus(spark):
    small = spark.createDataFrame([(i, "often " * 3 + f"rare{i}") for i in range(4)], "id bigint, text string")
    counts = hmm.word_counts(small.union(spark.createDataFrame([(9, "twice twice " + "x" * 80)], "id bigint, text string")))
    one = hmm._vocabulary(counts, 5, least_count=2)
    assert one.own == 2 and one.words[:2] == [b"often", b"twice"] and one.rest == 5 and one.rest_types == 5
    assert hmm._vocabulary(counts, 5, least_count=1).own == 6  # the word over WORD_BYTES stays outside the table


def test_states_differ_where_all_texts_are_longer_than_the_sample(spark):
    rng = np.random.default_rng(12)
    text = lambda i: " ".join(f"{'ab'[i % 2]}{int(x)}" for x in rng.integers(0, 40, 500))
    df = spark.createDataFrame([(i, text(i)) for i in range(40)], "doc_id bigint, text string")
    total = lambda states: hmm.score_documents(df, states=states, sample_chars=300, passes=2).agg(F.sum("score")).first()[0]
    one, two = total(1), total(2)
    assert two > one + 0.25 * 40 * 500  # up to log10(2) a word


def test_html_extraction(spark):
    field = html_extract.fit(html_pages.labelled_pages(250, seed=1), rounds=120)
    right = total = 0
    for html, main in html_pages.labelled_pages(150, seed=77):
        blocks = html_extract.leaf_blocks(html)
        assert main <= {b.text for b in blocks}
        labels = field.decode(html_extract.block_features(blocks))
        right += sum((b.text in main) == bool(k) for b, k in zip(blocks, labels))
        total += len(blocks)
    assert right / total > 0.98
    page = "<html><head><title>t</title><script>'<p>x</p>'</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One <b>bold</b>\n two.<p>Three &lt;x&gt; words here, and more.</article><!-- <p>no</p> --><footer>&copy; 2024 me</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "a < b <i"), (6, None, "<p"), (6, None, "<p")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), field).collect()
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == "A & B\n\nOne bold two.\n\nThree <x> words here, and more." and texts[2] == texts[3] == texts[6] == "" and len(got) == 7
    assert all(r.n_chars == len(r.text) for r in got)


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(12)
    field = html_extract.ChainField(rng.normal(size=(len(html_extract.FEATURES), 2)), rng.normal(size=(2, 2)))
    features = [list(map(int, rng.integers(0, len(html_extract.FEATURES), 4))) for _ in range(7)]
    score = lambda y: sum(field.emit[f, k].sum() for f, k in zip(features, y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))
    assert field.decode(features) == list(max(product((0, 1), repeat=7), key=score))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    source.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs_, kept = source, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs_, str(tmp_path))
        assert made.columns == source.columns
        made.write.parquet(str(tmp_path / name))
        docs_ = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs_.collect()}
    judged = {r.doc_id for r in quality_rules.quality_report(source).where("kept").collect()}
    assert set(kept["quality_rules"]) == judged
    assert set(kept["line_dedup"]) == judged
    from .test_near_copies import expected

    assert set(kept["simhash_near_dedup"]) == expected(list(kept["line_dedup"].items()))
    assert set(kept["benchmark_decontamination"]) <= set(kept["simhash_near_dedup"])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["benchmark_decontamination"])
    assert packed.where(F.crc32("ids") != F.col("ids_crc32")).count() == 0
