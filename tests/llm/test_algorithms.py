"""Splits, overlaps, neighbours, percentiles, packing and mixing against brute force on small fixtures."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadweave.llm import mixing, near_copies, neighbours, overlap, packing, quantiles, splits

REGISTER = "register_id long, LCLid string, stdorToU string, meter_serial string, account_ref string, previous_lclid string, acorn_group string, registered_at timestamp"


def register(rows):
    return [(i, hh, None, m, a, p, None, None) for i, (hh, m, a, p) in enumerate(rows)]


def brute_groups(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def key(x):
        c = "".join(ch for ch in (x or "") if ch.isalnum()).upper()
        return c if any(ch in "123456789" for ch in c) else None

    clean = [((hh or "").strip().upper(), key(m), key(a), (p or "").strip().upper()) for hh, m, a, p in rows]
    known = {c[0] for c in clean if c[0]}
    by = defaultdict(set)
    for hh, m, a, p in clean:
        if not hh:
            continue
        find(hh)
        for k in (("m", m), ("a", a)):
            if k[1]:
                by[k].add(hh)
        if p in known:
            parent[find(hh)] = find(p)
    for group in by.values():
        first = next(iter(group))
        for h in group:
            parent[find(h)] = find(first)
    sets = defaultdict(set)
    for h in known:
        sets[find(h)].add(h)
    return {(h, min(s)) for s in sets.values() if len(s) > 1 for h in s}


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([f"mac{i:06d}", f" MAC{i:06d} "]), rng.choice([None, "N/A", "", "0000000", f"A-{rng.randrange(90)}", f"a {rng.randrange(90)}"]), rng.choice([None, "TBC", f"85 {rng.randrange(400)}"]), rng.choice([None, None, f"MAC{rng.randrange(400):06d}", "MAC999999"])) for i in (rng.randrange(200) for _ in range(260))]
    rows += [(f"MAC{i:06d}", None, None, f"mac{i + 1:06d}") for i in range(500, 580)]  # a long chain
    rows += [(f"MAC{i:06d}", "HUB 1", None, None) for i in range(700, 800)] + [(None, "A1", "85 1", None), ("  ", "A1", None, None)]
    got = {tuple(r) for r in splits.linked_households(spark.createDataFrame(register(rows), REGISTER)).collect()}
    assert got == brute_groups(rows)


def test_rendezvous_keeps_shares_and_moves_little(spark):
    ids = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    a = ids.select("k", splits.rendezvous(F.col("k"), {"train": 0.8, "test": 0.2}).alias("s"))
    share = a.where("s = 'train'").count() / 4000
    assert abs(share - 0.8) < 0.03
    b = ids.select("k", splits.rendezvous(F.col("k"), {"train": 0.8, "test": 0.2, "none": 0.0, "more": 0.1}).alias("t"))
    moved = a.join(b, "k").where("s <> t")
    assert moved.where("t <> 'more'").count() == 0
    with pytest.raises(ValueError):
        splits.rendezvous(F.col("k"), {"train": 0.0})


def test_split_days_and_empty_register(spark):
    readings = spark.createDataFrame([("MAC000001", "a", "2013-01-01"), (" mac000002", "b", "2013-01-01"), (None, "b", "2013-01-02"), (None, "c", "2013-01-02"), ("MAC000001", "a", None)], "LCLid string, source_file string, d string").withColumn("date", F.to_date("d"))
    reg = spark.createDataFrame(register([("MAC000001", "M1", None, None), ("MAC000002", "m-1", None, None)]), REGISTER)
    out = splits.split_household_days(readings, reg, {"train": 0.5, "test": 0.5}).collect()
    assert len(out) == 3 and len({r["split"] for r in out}) == 1 and {r["group_lclid"] for r in out} == {"MAC000001"}
    assert splits.linked_households(spark.createDataFrame([], REGISTER)).collect() == []


PROFILE = "profile_id long, kwh array<double>, source string, split string, extra string"


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(7)
    base = [[round(rng.lognormvariate(-2, 0.8), 3) for _ in range(48)] for _ in range(60)]
    rows = []
    for i in range(400):
        v = list(rng.choice(base))
        for j in range(48):
            v[j] = round(v[j] + rng.choice([0, 0.005, -0.005, 0.002]), 3)
        for j in rng.sample(range(48), rng.choice([0, 0, 3, 4, 5])):
            v[j] += 0.4
        if rng.random() < 0.2:
            v = list(rng.choice(base))
        if rng.random() < 0.05:
            v = rng.choice([None, v[:40], [None, *v[1:]], [0.1] * 48, [float("nan"), *v[1:]]])
        rows.append((i, v, rng.choice(["A b", "a-b", "A_B", None]), rng.choice(["train", "train", "validation", "TEST ", None]), "x"))
    df = spark.createDataFrame(rows, PROFILE)
    ok = [r for r in rows if r[1] and len(r[1]) == 48 and None not in r[1] and all(x == x for x in r[1]) and len(set(r[1])) >= 5 and r[3]]
    train = [r for r in ok if r[3] == "train"]
    want = {tuple(sorted((t[0], e[0]))) for t in train for e in ok if e[3] != "train" and sum(abs(a - b) <= 0.0055 + 1e-9 for a, b in zip(t[1], e[1])) >= 44}
    got = [tuple(r) for r in overlap.overlapping_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    counts = overlap.overlap_counts(df).collect()
    assert sum(r["n_pairs"] for r in counts) == len(want) and {r["source"] for r in counts} <= {"a_b", None}
    assert overlap.overlapping_pairs(spark.createDataFrame([], PROFILE)).collect() == []


def brute_neighbours(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 6 and None not in v and np.isfinite(v).all()]
    near = {}
    for i, v in ok:
        d = sorted((round(float(((v - w) ** 2).sum()), 6), j) for j, w in ok if j != i)
        near[i] = d[:k]
    return ok, near


def test_overlap_candidates_stay_near_the_true_pairs(spark):
    """Flat low loads share their cells: without the band's values every training and evaluation profile of a cell would meet."""
    rng = random.Random(8)
    low = [[0.02 + 0.06 * rng.random() for _ in range(48)] for _ in range(240)]
    rows = [(i, v, "a", "train" if i % 2 else "test") for i, v in enumerate(low)]
    for i in range(0, 40, 2):  # twenty near copies
        rows.append((1000 + i, [x + 0.004 * rng.uniform(-1, 1) for x in low[i]], "a", "train"))
    df = spark.createDataFrame(rows, "profile_id long, kwh array<double>, source string, split string")
    r = overlap.records(df)
    true, candidates = overlap.overlap_classes(r).count(), overlap.overlap_candidates(r.representatives()).count()
    assert true >= 20 and candidates <= 3 * true


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(3)
    base = rng.uniform(0.5, 3, (40, 6))
    rows = []
    for i in range(600):
        v = base[rng.integers(40)] * (1 + rng.choice([0, 0.01, 0.2]) * rng.normal(size=6))
        rows.append((i, [round(float(x), 3) for x in v]))
    rows += [(600 + i, rows[0][1]) for i in range(40)]  # many copies
    rows += [(700, None), (701, [1.0] * 5), (702, [None] * 6), (703, [float("nan")] * 6), (704, [0.0] * 6), (705, [0.0] * 6)]
    return rows


def test_close_pairs_equal_brute_force(spark, samples):
    df = spark.createDataFrame([(i, v, "c") for i, v in samples], "sample_id long, kwh array<double>, _id string")
    ok, near = brute_neighbours(samples, 5)
    norm = {i: float(np.linalg.norm(v)) for i, v in ok}
    vec = dict(ok)
    want = {(min(i, j), max(i, j)) for i, d in near.items() for _, j in d if np.linalg.norm(vec[i] - vec[j]) <= 0.1 * min(norm[i], norm[j]) * (1 + 1e-12)}
    got = [tuple(r) for r in neighbours.close_pairs(df, width=6, k=5).collect()]
    assert len(got) == len(set(got))
    assert len(set(got) & want) >= 0.995 * len(want) and not set(got) - want


def test_nearest_recall_and_blocks(spark, samples):
    df = spark.createDataFrame(samples, "sample_id long, kwh array<double>")
    _, near = brute_neighbours(samples, 5)
    got = defaultdict(list)
    for r in neighbours.nearest_samples(df, width=6, k=5, nprobe=4, every=1).collect():
        got[r["sample_id"]].append(r["neighbour_id"])
    hits = sum(len(set(got[i]) & {j for _, j in d}) for i, d in near.items())
    assert hits >= 0.9 * sum(map(len, near.values()))
    v = df.select(F.col("sample_id").alias("_id"), F.col("kwh").alias("_v")).where(neighbours.finite_vector(F.col("_v"), 6))
    whole = {tuple(r)[:2] for r in neighbours.knn(v, v, 6, 3, nprobe=3).collect()}
    cut = {tuple(r)[:2] for r in neighbours.knn(v, v, 6, 3, nprobe=3, block_rows=16).collect()}
    assert whole == cut and len(whole) == 3 * v.count()
    empty = spark.createDataFrame([], "sample_id long, kwh array<double>")
    assert neighbours.close_pairs(empty, width=6).collect() == []


def test_summaries_keep_the_stated_error_in_any_order():
    rng = np.random.default_rng(0)
    for n, shape in ((300, "log"), (20_000, "log"), (20_000, "sorted"), (60_000, "ties")):
        x = rng.lognormal(size=n)
        x = {"log": x, "sorted": np.sort(x)[::-1], "ties": np.round(x, 1)}[shape]
        parts = [quantiles.Ladder(32) for _ in range(9)]
        for i, part in enumerate(np.array_split(x, 9)):
            for piece in np.array_split(part, 5):
                parts[i].add(piece)
        rng.shuffle(parts)
        total = quantiles.Ladder(32)
        for p in parts:
            total.merge(p)
        assert total.n == n == total.items()[1][-1]
        s = np.sort(x)
        for q in (0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999):
            (v,) = total.quantiles([q])
            lo, hi, r = np.searchsorted(s, v, "left") + 1, np.searchsorted(s, v, "right"), max(1, int(np.ceil(q * n)))
            err = max(lo - r, r - hi, 0)
            assert err <= np.ceil(quantiles.relative_error(32) * (n - r + 1)) and (n > 384 or err == 0)


@pytest.mark.parametrize("order", ["random", "ascending", "descending"])
def test_the_stated_error_holds_however_many_values_come(order):
    """A level's sections grow with its counter; with a fixed number the error at the protected end would grow with n."""
    n = 4_000_000
    x = np.random.default_rng(5).lognormal(size=n)
    s = np.sort(x)
    x = {"random": x, "ascending": s, "descending": s[::-1]}[order]
    one, merged = quantiles.Ladder(32), quantiles.Ladder(32)
    one.add(x)
    for part in np.array_split(x, 30):
        day = quantiles.Ladder(32)
        day.add(part)
        merged.merge(day)
    for ladder in (one, merged):
        assert ladder.n == n == ladder.items()[1][-1] and sum(map(len, ladder.levels)) < 16_000
        for q in (0.5, 0.9, 0.99, 0.999, 0.9999):
            r, at = int(np.ceil(q * n)), int(np.searchsorted(s, ladder.quantiles([q])[0])) + 1
            assert abs(at - r) <= quantiles.relative_error(32) * (n - r + 1)


def test_monthly_percentiles(spark):
    rows = [("MAC000001", "f", 3, "2013-03-%02d" % (1 + i % 9), f"{i / 100:.2f}") for i in range(200)] + [("mac000001", "f", 3, "2013-03-01", t) for t in ("Null", "-4", "99", "NaN")] + [(None, "f", 3, "2013-03-02", "1.0"), (None, "g", 3, "2013-03-02", "1.0"), ("MAC000001", "f", None, "2013-03-01", "1")]
    df = spark.createDataFrame(rows, "LCLid string, source_file string, month int, d string, kwh string").withColumn("date", F.to_date("d"))
    parts = quantiles.daily_summaries(df, open_groups=2)
    days = quantiles.merge_days(parts)
    assert days.count() == 9 and days.agg(F.sum("n")).first()[0] == 201
    a = {r["q"]: r["value"] for r in quantiles.monthly_percentiles(days, [0.5, 0.95]).collect()}
    want = sorted([i / 100 for i in range(200)] + [1.0])
    assert a == {0.5: want[100], 0.95: want[190]}
    halves = quantiles.merge_days(parts.where("day < '2013-03-05'")).unionByName(quantiles.merge_days(parts.where("day >= '2013-03-05'")))
    assert {r["q"]: r["value"] for r in quantiles.monthly_percentiles(halves, [0.5, 0.95]).collect()} == a
    assert quantiles.monthly_percentiles(quantiles.daily_summaries(df.limit(0)), [0.5]).collect() == []


DOCS = "doc_id long, text string, source string, container string"


def test_packing_keeps_every_token_and_every_rule(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["meter", "kwh", "Zähler", "flat"]) for _ in range(rng.choice([0, 3, 20, 60, 200]))) for _ in range(150)]
    rows = [(i, t, rng.choice(["A b", "a_b", None]), "x") for i, t in enumerate(texts)] + [(900 + i, "Same Text, here!", "c", "x") for i in range(60)] + [(990, None, None, "x"), (991, "", "c", "x")]
    sized = packing.sized_documents(spark.createDataFrame(rows, DOCS))
    size = {r["doc_id"]: r["_tokens"] for r in sized.collect()}
    cluster = {r["doc_id"]: r["_cluster"] for r in sized.collect()}
    placed = packing.pack(sized, {"small": 64}, group_rows=10_000).collect()
    tokens, bins = defaultdict(int), defaultdict(list)
    for r in placed:
        tokens[r["doc_id"]] += r["n_tokens"]
        bins[r["container_id"]].append(r)
        assert r["n_tokens"] <= 64 and (r["piece"] == 0 or size[r["doc_id"]] > 64)
    assert tokens == size and sum(size.values()) > 0
    need = -(-sum(size.values()) // 64)
    for b in bins.values():
        assert sum(r["n_tokens"] for r in b) <= 64 and sorted(r["place"] for r in b) == list(range(len(b)))
        seen = defaultdict(int)
        for r in b:
            seen[cluster[r["doc_id"]]] += 1
        total = defaultdict(int)
        for r in placed:
            total[cluster[r["doc_id"]]] += 1
        assert all(n <= max(1, -(-total[c] // need)) for c, n in seen.items())
    assert len(bins) <= need * 11 / 9 + 1  # the bound of best fit in decreasing order
    mixed = packing.pack(sized, {"small": 64}, apart=["c"]).collect()
    source = {r["doc_id"]: r["_source"] for r in sized.collect()}
    together = defaultdict(set)
    for r in mixed:
        together[r["container_id"]].add(source[r["doc_id"]] == "c")
    assert all(len(x) == 1 for x in together.values())
    assert packing.pack(sized.limit(0), {"small": 64}).collect() == []
    with pytest.raises(ValueError):
        packing.pack(sized, {"none": 0})


def test_best_fit_takes_the_tightest_compatible_bin():
    b = packing.Bins(10, {}, {})
    assert [b.put(6, 1, 1), b.put(7, 1, 2), b.put(3, 1, 3), b.put(3, 1, 2), b.put(1, 1, 3)] == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 2)]


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 120]))]
        texts.append(" ".join(base))
        for edits in rng.sample([0, 1, 2, 6], 2):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).upper() + "!" if edits == 0 else " ".join(copy))
    rows = list(enumerate([*texts, None, "", " . "]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r["doc_id"]: r["k"] for r in df.select("doc_id", near_copies.text_key(F.col("text")).alias("k")).collect()}

    def sets(t):
        w = t.lower().replace("!", "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    own = [sets(t) for t in texts]
    root = {keys[i]: keys[i] for i in range(len(texts))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if keys[i] != keys[j] and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
                a, b = sorted((find(keys[i]), find(keys[j])))
                root[b] = a
    want = {k: find(k) for k in root}
    sizes = defaultdict(int)
    for r in want.values():
        sizes[r] += 1
    got = {r["_t"]: r["_root"] for r in near_copies.near_copy_clusters(df).collect()}
    assert got == {k: r for k, r in want.items() if sizes[r] > 1} and got


def _near(spark, texts, **how):
    """Clusters of places in `texts`."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r["_t"]: r["_root"] for r in near_copies.near_copy_clusters(df, **how).collect()}
    clusters = defaultdict(set)
    for r in df.select("doc_id", near_copies.text_key(F.col("text")).alias("k")).collect():
        if r["k"] in root:
            clusters[root[r["k"]]].add(r["doc_id"])
    return sorted(map(sorted, clusters.values()))


def _words(name, n):
    return " ".join(f"{name}x{i}" for i in range(n))


def test_no_pair_at_the_threshold_is_missed(spark):
    """8 of 10 shingles in common, in 1500 pairs, and prefixes of a text just over and under it, of unequal bitmaps."""
    texts = [f"{_words(f'p{i}', 12)} {end}" for i in range(1500) for end in "ab"]
    texts += [_words("long", 140), _words("long", 115), _words("other", 140), _words("other", 112)]
    assert _near(spark, texts) == [[i, i + 1] for i in range(0, 3002, 2)]


def test_near_copies_among_texts_of_one_template(spark):
    """Two texts are near each other and none is near the 15 longer texts of their template; 12 more are one cluster."""
    texts, want = [], []
    for c in range(20):
        core = _words(f"c{c}", 40)
        want.append([len(texts) + 7, len(texts) + 8])
        texts += [f"{core} {_words(f'c{c}t{i}', 4 if i in (7, 8) else 6)}" for i in range(17)]
    want.append(list(range(len(texts), len(texts) + 12)))
    texts += [f"{_words('copy', 40)} tail{i}" for i in range(12)] + [f"{_words('copy', 40)} {_words(f'far{i}', 12)}" for i in range(12)]
    assert _near(spark, texts) == want
    assert _near(spark, texts * 2, most=3, block=2) == [[i + k for k in (0, len(texts)) for i in w] for w in want]


def test_each_bitmap_keeps_its_conflicts_out(spark):
    """Without the source bitmap notes and mail would mix, without the cluster bitmap near copies would."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, base + f" tail{i}", "mail", "x") for i in range(6)] + [(10 + i, f"short {i}", ("note", "mail", "chat")[i % 3], "x") for i in range(60)] + [(None, f"nameless {i}", "mail", "x") for i in range(30)]
    documents = spark.createDataFrame(rows, DOCS)
    sized = packing.sized_documents(documents)
    near = packing.cluster_near_copies(sized, documents)
    assert len({r["_cluster"] for r in near.collect() if (r["doc_id"] or 99) < 6}) == 1
    source = {r[0]: r[2] for r in rows}
    # a cluster may be in a bin as often as its size forces
    allowed = -(-6 // -(-sum(r["_tokens"] for r in sized.collect()) // 600))
    for one, apart, mixed, together in ((near, ["note"], False, False), (near, [], True, False), (sized, ["note"], False, True)):
        bins = defaultdict(list)
        for r in packing.pack(one, {"c": 600}, apart=apart).collect():
            bins[r["container_id"]].append(r["doc_id"])
        assert any(len({source[i] == "note" for i in b}) > 1 for b in bins.values()) == mixed
        copies = max(sum((i if i is not None else 99) < 6 for i in b) for b in bins.values())
        assert (copies > allowed) == together
        assert sum(map(len, bins.values())) == len(rows)


def test_a_cluster_of_many_copies_is_packed_in_time():
    b = packing.Bins(256, {}, {})
    t = time.monotonic()
    for i in range(20_000):
        b.put(100, 0, i % 2)
    assert time.monotonic() - t < 20 and len(b.filled) == 10_000


def test_mixing_meets_weights_within_repeats(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 6 + ["b"] * 3 + ["c", "zzz"]), rng.randrange(1, 50)) for i in range(3000)] + [(5000, "a", 0)]
    sized = spark.createDataFrame(rows, "doc_id long, _source string, _tokens long")
    plan = {"a": (0.3, 1), "b": (0.3, 2), "c": (0.3, 3), "gone": (0.1, 2)}
    drawn = mixing.draw_mix(sized, plan, bucket_tokens=500)
    got = drawn.collect()
    report = {r["source"]: r for r in mixing.mix_report(drawn, plan).collect()}
    assert report["gone"]["n_tokens"] == 0 and all(abs(report[s]["actual_share"] - 1 / 3) < 0.02 for s in "abc")
    assert max(r["repeat"] for r in got if r["source"] == "c") == 3 and max(r["repeat"] for r in got if r["source"] == "a") == 1
    assert len({(r["doc_id"], r["repeat"]) for r in got}) == len(got)
    finish = [r["virtual_finish"] for r in got]
    assert finish == sorted(finish)
    # the same documents whatever the buckets, and running sums as in one pass
    one = {(r["doc_id"], r["repeat"]): r["virtual_finish"] for r in mixing.draw_mix(sized, plan, bucket_tokens=10**9).collect()}
    assert one == pytest.approx({(r["doc_id"], r["repeat"]): r["virtual_finish"] for r in got})
    small = mixing.draw_mix(sized, plan, budget=1000)
    assert 850 < small.agg(F.sum("n_tokens")).first()[0] <= 1000
    assert mixing.draw_mix(sized.limit(0), plan).collect() == []
