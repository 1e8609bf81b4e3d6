"""Near-duplicates, components, suffix dedup, decontamination, mixing."""

import hashlib
import itertools
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from pagelore.llm import components, decontaminate, minhash, mixing, suffix, suffix_radix
from tests.llm.helpers import DOCS, awkward, collected, documents, prose


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def family(first, base, n, share):
    return [(first + k, edited(base, first + k, share * (k % 4) / 3)) for k in range(n)]


def plain_groups(texts, words, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in texts if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    out = [(i, len(s), find(i), find(i) == i) for i, s in sets]
    return out + [(None, len(shingles(t)), None, True) for i, t in texts if i is None]


NAMES = ("doc_id", "n_shingles", "component_id", "kept")


def texts_with_families():
    texts = awkward() + family(100, prose(50, 150, 3000), 14, 0.06) + family(200, prose(51, 80, 3000), 9, 0.03)
    return texts + [(300 + k, prose(52, 90)) for k in range(5)] + [(400, "ONE"), (401, "One TWO")]


def test_near_duplicates_match_brute_force(spark):
    texts = texts_with_families()
    for words, percent in ((3, 85), (5, 80)):
        got = minhash.near_duplicates(documents(spark, texts, "component_id", "kept", "bands"), minhash.MinHashConfig(words=words, percent=percent))
        assert collected(got, *NAMES) == sorted(plain_groups(texts, words, percent), key=repr)


def test_large_clusters_go_by_rounds(spark):
    texts = texts_with_families()
    config = minhash.MinHashConfig(words=3, percent=85, cluster_shingles=200, round_nodes=5)
    assert collected(minhash.near_duplicates(documents(spark, texts), config), *NAMES) == sorted(plain_groups(texts, 3, 85), key=repr)


def test_rounds_end_when_unsent_nodes_are_joined(spark, monkeypatch):
    base = list(range(1, 61))
    rows = [(k, 0, np.array([*base, 100 + k], dtype=np.uint64).tobytes()) for k in range(20)]
    rows.append((50, 0, np.arange(500, 560, dtype=np.uint64).tobytes()))
    stored, names = minhash.materialize, []
    monkeypatch.setattr(minhash, "materialize", lambda df, name: names.append(name) or stored(df, name))
    sets = spark.createDataFrame(rows, "doc_id long, cluster long, hashes binary")
    got = minhash._settle_large(sets, minhash.MinHashConfig(words=3, percent=85, round_nodes=2))
    assert {r.node: r.root for r in got.collect()} == {**{k: 0 for k in range(20)}, 50: 50}
    assert names.count("sent") <= 3


def test_near_duplicates_of_an_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_a_dissimilar_centre_loses_no_link():
    rng = random.Random(9)
    sets = []
    base = [rng.getrandbits(63) for _ in range(60)]
    for k in range(40):
        sets.append(np.unique(np.array(base[: 60 - k % 9] + [rng.getrandbits(63) for _ in range(k % 7)], dtype=np.uint64)))
    ids = np.array(rng.sample(range(1000), 40))
    got = minhash.link_cluster(ids, sets, 85)
    want = {int(i): int(i) for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids.tolist(), sets):
            for j, b in zip(ids.tolist(), sets):
                shared = len(set(a.tolist()) & set(b.tolist()))
                if 100 * shared >= 85 * (len(a) + len(b) - shared) and want[j] < want[i]:
                    want[i] = want[j]
                    changed = True
    assert got.tolist() == [want[int(i)] for i in ids]


def test_densified_bins_estimate_similarity():
    config = minhash.MinHashConfig()
    rng = np.random.default_rng(4)
    pool = rng.integers(1 << 63, size=24, dtype=np.uint64)
    bands = minhash.OnePermutation(minhash.MinHashConfig(band_rows=1))
    a, b = np.unique(minhash.mix64(pool[:20])), np.unique(minhash.mix64(pool[4:]))
    assert abs((bands(a) == bands(b)).mean() - 16 / 24) < 0.25
    assert len(minhash.OnePermutation(config)(a[:1])) == config.bins // config.band_rows


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def plain_suffixes(texts, depth=100):
    first = {}
    docs = [(i, (t or "").encode()) for i, t in texts if i is not None]
    for i, b in docs:
        for p in range(len(b) - depth + 1):
            first[b[p : p + depth]] = min(first.get(b[p : p + depth], (i, p)), (i, p))
    out = []
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b) + 1)
        if i is not None:
            for p in range(len(b) - depth + 1):
                if first[b[p : p + depth]] < (i, p):
                    gone[p : p + depth] = b"\1" * depth
        spans = sum(gone[p] and not gone[p - 1] for p in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts_with_passages():
    passage, line = prose(60, 60, 5000), prose(61, 14, 5000)
    texts = [(k, prose(k, 40, 5000) + passage[: 300 - k] + prose(900 + k, 30, 5000)) for k in range(30, 60)]
    texts += [(k, line + prose(k, 50, 5000)) for k in range(70, 95)]
    texts += [(96, passage + " and again " + passage), (97, "ab" * 400), (98, "ab" * 200 + "c" + "ab" * 150), (99, "é" * 130), (-5, "日本" * 60 + passage)]
    return awkward() + texts


def test_repeated_bytes_match_brute_force(spark):
    texts = texts_with_passages()
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = sorted(plain_suffixes(texts), key=repr)
    docs = documents(spark, texts, "spans", "digit", "_starts", "_stops", "_id")
    assert collected(suffix.suffix_dedup_report(docs), *names) == want
    # Large groups take the pass over the cluster, and many rows are not sent to all executors.
    tight = suffix.SuffixConfig(group_rows=5, broadcast_rows=1)
    assert collected(suffix.suffix_dedup_report(docs, tight), *names) == want


def test_radix_passes_give_the_same_runs(spark):
    texts = [t for t in texts_with_passages() if t[0] is not None]
    docs = documents(spark, texts)
    names = ("doc_id", "from_byte", "to_byte")
    want = collected(suffix.repeated_bytes(docs)[0], *names)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for passes, rows in ((1, 10_000), (2, 7), (4, 10_000)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert collected(suffix_radix.repeated_bytes(docs, passes=passes), *names) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert suffix_radix.repeated_bytes(spark.createDataFrame([], DOCS)).collect() == []


def test_first_pass_carries_over_batches(spark):
    texts = texts_with_passages()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in (1, 2, 7):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = collected(suffix.suffix_dedup_report(documents(spark, texts)), "doc_id", "n_removed", "kept_sha256")
            assert got == sorted([(r[0], r[2], r[4]) for r in plain_suffixes(texts)], key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_cut_texts_stay_whole_characters(spark):
    texts = texts_with_passages()
    rows = suffix.remove_repeats(documents(spark, texts, "extra", "_starts", "_id", "_cut", "row")).collect()
    assert {"doc_id", "text", "lang", "source", "n_chars", "extra", "_starts", "_id", "_cut", "row"} == set(rows[0].asDict())
    kept = {r.doc_id: r.text for r in rows}
    assert kept[2] is None and kept[3] == "" and kept[-5].startswith("日本") and kept[-5].endswith(dict(texts)[-5][120:])
    assert 97 in kept and len(kept[97]) < 200
    assert suffix.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit("clash"))


def test_contaminated_documents_are_found(spark):
    bench = [(1, prose(70, 40, 9000)), (2, prose(71, 16, 9000)), (3, "alpha beta gamma"), (4, None), (5, ""), (None, prose(72, 30))]
    first, second = bench[0][1], bench[1][1]
    swapped = " ".join("zz" if k % 9 == 4 else w for k, w in enumerate(first.split()))
    texts = awkward() + [
        (50, prose(80, 60) + " " + first + " " + prose(81, 40)), (51, "Start. " + swapped.upper() + "!"), (52, second), (53, prose(82, 400)),
        (54, " ".join(first.split()[20:]) + " " + prose(83, 30)), (55, "so alpha, beta gamma."), (56, "alpha beta delta gamma"), (50, prose(80, 60) + " " + first),
        (57, " ".join(first.split()[:6]) + " " + prose(84, 50)),
    ]
    docs = documents(spark, texts, "item_id", "seed", "w")
    want = {(50, 1), (51, 1), (52, 2), (54, 1), (55, 3)}
    got = decontaminate.contaminated(docs, items(spark, bench)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    shuffled = decontaminate.contaminated(docs, items(spark, bench), decontaminate.SeedConfig(broadcast_seeds=0)).collect()
    assert collected_rows(shuffled) == collected_rows(got)
    by = {(r.doc_id, r.item_id): r for r in got}
    assert by[50, 1].n_matched == 40 and by[51, 1].n_aligned == 40 and by[51, 1].n_matched == 40 - sum(k % 9 == 4 for k in range(40))


def test_masks_leave_a_clean_seed_for_every_allowed_change():
    config = decontaminate.SeedConfig()
    for n in range(1, 14):
        wrong = n - -(-80 * n // 100)
        seen = [{k + o for o, c in enumerate(m) if c == "1"} for m in config.masks_of(n) for k in range(n - len(m) + 1)]
        for changed in itertools.combinations(range(n), wrong):
            assert any(s.isdisjoint(changed) for s in seen), (n, changed)


def test_every_allowed_change_is_found(spark):
    bench, texts = [], []
    for n in [*range(1, 14), 20]:
        item = [f"i{n}x{k}" for k in range(n)]
        bench.append((n, " ".join(item)))
        part = item[3:16] if n == 20 else item
        allowed = len(part) - -(-80 * len(part) // 100)
        for wrong in (allowed, allowed + 1):
            for changed in itertools.combinations(range(len(part)), wrong):
                text = " ".join("other" if k in changed else w for k, w in enumerate(part))
                texts.append((1000 * len(texts) + 10 * n + (wrong > allowed), f"before {text} after"))
    for config in (decontaminate.SeedConfig(), decontaminate.SeedConfig(broadcast_seeds=0)):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, texts), items(spark, bench), config).collect()}
        assert got == {(i, i % 1000 // 10) for i, _ in texts if not i % 10}


def test_seeds_of_long_items_carry_no_words(spark):
    config = decontaminate.SeedConfig()
    known = decontaminate.item_words(items(spark, [(1, prose(73, 3000, 90_000)), (1, prose(73, 3000, 90_000)), (2, "alpha beta")]))
    seeds = decontaminate.item_seeds(known, config)
    assert sorted(t for _, t in seeds.dtypes) == ["bigint", "bigint", "int", "int"]
    assert seeds.count() == sum(3000 - len(m) + 1 for m in config.masks) + 1
    text = " ".join(prose(73, 3000, 90_000).split()[500:2500])
    for tight in (config, decontaminate.SeedConfig(broadcast_bytes=0)):
        docs = documents(spark, [(5, text), (6, "so alpha beta"), (7, prose(74, 50))])
        got = decontaminate.contaminated(docs, items(spark, [(1, prose(73, 3000, 90_000)), (2, "alpha beta")]), tight).collect()
        assert collected_rows(got) == [(5, 1, -500, 2000, 2000, 13), (6, 2, 1, 2, 2, 2)]


def collected_rows(rows):
    return sorted(tuple(r) for r in rows)


def test_decontamination_of_empty_tables(spark):
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(empty, items(spark, [(1, prose(1, 20))])).collect() == []
    assert decontaminate.contaminated(documents(spark, awkward()), none).collect() == []


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped.update({s: 2.0 * sizes[s] for s in over})


def test_mix_meets_its_targets(spark):
    rng = random.Random(12)
    rows = [(k, prose(k, int(rng.paretovariate(1.1) * 20) % 900), None, rng.choice(["b", "a", None, "ü", "B", "tiny"] if k < 80 else ["b", "ü", None]), 0) for k in range(700)]
    rows += [(900, None, None, "a", 0), (901, "", None, "nothing", 0), (3, "repeated", None, "a", 0), (3, "repeated", None, "a", 0), (None, "x y z", None, "b", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    config = mixing.MixConfig(fan_in=8, group=60)
    got = mixing.mix(docs, config).collect()
    assert len(got) == len(rows) and collected_rows_of(got) == collected_rows_of(mixing.mix(docs, config).collect())
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len((text or "").split())
    for r in got:
        assert r.source_size == sizes[r.source] and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    want = plain_targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) for r in got)
    for s in sizes:
        small = sorted(r.size for r in got if r.source == s and r.size)
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], small[0] if small else 0), (s, taken[s], want[s])


def collected_rows_of(rows):
    return sorted((repr(tuple(r)) for r in rows))


def test_mix_expectation_is_kept(spark):
    rows = [(k, "w " * (5 + k % 7), None, f"s{k % 3}", 0) for k in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    runs = [mixing.mix(docs, mixing.MixConfig(seed=s, fan_in=4, group=10)).collect() for s in range(8)]
    assert len({tuple(sorted((r.doc_id, r.copies) for r in run)) for run in runs}) > 4
    for source in ("s1", "s2"):
        part = [r for run in runs for r in run if r.source == source]
        mean = sum(r.copies for r in part) / len(part)
        assert abs(mean - part[0].target / part[0].source_size) < 0.05


def test_every_fraction_is_settled_by_an_exchange(spark):
    """All documents of a group but one come out whole, large ones too; the one is no larger than what lies behind it."""
    sizes = [60, 55, 50, 45, 40, 31, 17, 9, 8, 5, 3, 2, 1]
    rows = [(k, "w " * n, None, "s", 0) for k, n in enumerate(sizes)] + [(99, "w " * 500, None, "t", 0)]
    for seed in range(12):
        got = mixing.mix(spark.createDataFrame(rows, DOCS), mixing.MixConfig(percent=70, seed=seed)).collect()
        mine = [r for r in got if r.source == "s"]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 31 and len(got) == len(rows)


def test_mix_of_an_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
