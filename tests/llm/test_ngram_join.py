import re

import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from quilt.llm import ngram_join as N
from quilt.llm import segments
from quilt.llm.components import connected_components
from quilt.llm.shingles import shingle_sets


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, k):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, k, num, den):
    """rows of (id, text) -> sorted list of (id, n, component)."""
    sets = [shingles(t, k) for _, t in rows]
    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in index[x]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, both in near.items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            r = find(i)
            least[r] = min(least.get(r, x), x)
    return sorted(
        ((x, len(s), least.get(find(i)) if s else x) for i, ((x, _), s) in enumerate(zip(rows, sets))), key=repr
    )


def run(spark, rows, spec, parts=5):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    out = N.jaccard_components(df.withColumn("_node", F.lit(1)).withColumn("n_shingles", F.lit("x")), spec)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def near_rows(seed=0, copies=12):
    """Bases of many lengths with copies that lie around the threshold."""
    rng = np.random.default_rng(seed)
    rows = []
    for size in (1, 2, 3, 5, 9, 14, 20, 33, 60, 120, 400):
        base = [f"w{rng.integers(10**6)}" for _ in range(size)]
        for c in range(copies):
            w = list(base)
            for _ in range(rng.integers(0, max(2, size // 12 + 1))):
                w[rng.integers(len(w))] = f"x{rng.integers(10**6)}"
            if c % 4 == 1:
                w = w + [f"y{rng.integers(10**6)}" for _ in range(size // 25)]
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("spec", [N.Jaccard(3, 90, 100), N.Jaccard(5, 80, 100), N.Jaccard(2, 70, 100)])
def test_against_brute_force(spark, spec):
    rows = near_rows(spec.width)
    assert run(spark, rows, spec) == brute(rows, spec.width, spec.num, spec.den)


def test_one_deletion_scheme_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "allocate", lambda spec, sizes: frozenset(range(len(N.BOUNDS))))
    monkeypatch.setattr(segments, "BLOCK", 3)
    rows = near_rows(7)
    spec = N.Jaccard(3, 90, 100)
    assert run(spark, rows, spec) == brute(rows, 3, 90, 100)


def test_allocation_follows_the_size_of_the_corpus():
    spec = N.Jaccard()
    band = N.band_of(500)
    assert band not in N.allocate(spec, {band: 1000})
    assert band in N.allocate(spec, {band: 10**12})


def test_documents(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in N.jaccard_components(df, N.Jaccard(3, 90, 100)).collect()), key=repr)
    assert got == brute(rows, 3, 90, 100)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (5, "one two"), (None, "one two"),
        (6, "Äb c d"), (7, "äb c d"), (8, long), (9, long + " end"), (None, "alone here now"), (10, "one\x1ftwo"),
    ]
    assert run(spark, rows, N.Jaccard(3, 90, 100)) == brute(rows, 3, 90, 100)
    assert run(spark, [], N.Jaccard()) == []


def test_shingle_sets_equal_python():
    texts = ["a b c a b c", "", "x", "A b  C\td", None or "", "ß ü ß ü ß"]
    _, n = shingle_sets(texts, 3)
    assert n.tolist() == [len(shingles(t, 3)) for t in texts]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    df = spark.createDataFrame(path + star + [(5, 5), (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in connected_components(df, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert connected_components(df.where("a > 10000"), "a", "b").count() == 0


def test_many_ranges_and_a_join_beyond_the_broadcast(spark, monkeypatch):
    """Signatures dealt to many ranges, and more shared ones than may be broadcast."""
    monkeypatch.setattr(N, "RANGE_SIGNATURES", 50)
    monkeypatch.setattr(N, "SIGNATURE_BYTES", 0)
    for spec in (N.Jaccard(3, 90, 100), N.Jaccard(5, 80, 100)):
        rows = near_copies()
        assert run(spark, rows, spec) == brute(rows, spec.width, spec.num, spec.den)


def near_copies(n=150, seed=21):
    """Chains and stars of near copies, exact copies and texts of their own."""
    import random

    rng = random.Random(seed)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randint(3, 200))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
        if rng.random() < 0.3:
            base[rng.randrange(len(base))] = w
    return rows


def test_chains_of_near_copies(spark):
    """Links that no common hub shows are found as well."""
    for seed in (1, 2, 3):
        rows = near_copies(seed=seed)
        assert run(spark, rows, N.Jaccard(5, 80, 100)) == brute(rows, 5, 80, 100)


@pytest.mark.parametrize("pairs", [20_000, 0])
def test_pairs_of_a_block_against_all_pairs(monkeypatch, pairs):
    """Also with images that stand for several shingles of a set."""
    monkeypatch.setattr(N, "FINDER_PAIRS", pairs)
    monkeypatch.setattr(N, "FINDER_CELLS", 500)
    rng = np.random.default_rng(5)
    for num in (80, 90, 67):
        spec = N.Jaccard(5, num, 100)
        base = [rng.integers(0, 3000, rng.integers(3, 60)) for _ in range(8)]
        common = rng.integers(0, 3000, 30)
        sets = []
        for _ in range(120):
            s = np.unique(base[rng.integers(8)])
            s = np.concatenate((s[rng.random(len(s)) > 0.08], rng.integers(0, 3000, rng.integers(0, 4)), common if rng.random() < 0.4 else common[:0]))
            sets.append(np.unique(s))
        sets = [s if len(s) else np.array([1]) for s in sets]
        image = rng.integers(0, 2**31, 3000).astype(np.int32)
        image[rng.integers(0, 3000, 600)] = 7  # many shingles with one image
        roots = [i % 5 for i in range(len(sets))]
        got = set(N._finder(spec)([10 + i for i in range(len(sets))], roots, [image[s] for s in sets]))
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                inter = len(np.intersect1d(a, b))
                if roots[i] != roots[j] and 100 * inter >= num * (len(a) + len(b) - inter):
                    assert (10 + j, 10 + i) in got
        assert all(roots[a - 10] != roots[b - 10] and a < b for a, b in got)


def test_tables_of_the_join_stay_out_of_the_driver(spark, monkeypatch):
    """Shared signatures and hubs go to the tasks by files; the links are the same
    when they are too many for that."""
    from pyspark import SparkContext

    def refused(*_):
        raise AssertionError("passed through the driver")

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} x{i % 7}") for i in range(30)] + [(50, "alone here now"), (51, None)]
    spec = N.Jaccard(width=3, num=80, den=100)
    with monkeypatch.context() as m:
        m.setattr(SparkContext, "broadcast", refused)
        m.setattr(N.DataFrame, "toArrow", refused)
        got = run(spark, rows, spec)
        assert got == brute(rows, 3, 80, 100)
    monkeypatch.setattr(N, "SIGNATURE_BYTES", 0)
    assert run(spark, rows, spec) == got


def test_arrays_of_a_table_without_rows(spark):
    from quilt.llm.common import save_arrays

    rows, read = save_arrays(spark.range(9).selectExpr("7 - id as k", "id as v").where("k > 3"), "some")
    k, v = read()
    assert rows.count() == 4 and k.tolist() == [4, 5, 6, 7] and v.tolist() == [3, 2, 1, 0]
    none, read = save_arrays(spark.range(9).selectExpr("id as k", "id as v").where("k > 30"), "none")
    hit, values = N._looked_up(read)(np.arange(3))
    assert none.count() == 0 and not hit.any() and not len(values)


def shingle_hashes(rng, n):
    return rng.integers(0, 2**64, n, dtype=np.uint64)


def pairs_of_sets(seed=9):
    """Sets of many sizes with partners that lie around the threshold, or far away."""
    rng = np.random.default_rng(seed)
    pairs = []
    for size in (1, 2, 9, 40, 63, 64, 120, 127, 128, 250, 257, 511, 520, 2100):
        for share in (0.7, 0.85, 0.89, 0.9, 0.95, 1.0):
            a = shingle_hashes(rng, size)
            own = rng.random(size) < share
            pairs.append((a, np.concatenate((a[own], shingle_hashes(rng, int((~own).sum()) + size // 30)))))
        pairs.append((shingle_hashes(rng, size), shingle_hashes(rng, size)))
    return [(a, b) for a, b in pairs if len(b)]


@pytest.mark.parametrize("cells", [1 << 20, 300])
def test_sketches_lose_no_link_and_tell_strangers(monkeypatch, cells):
    monkeypatch.setattr(N, "SKETCH_CELLS", cells)
    pairs = pairs_of_sets()
    flat = np.concatenate([s for p in pairs for s in p])
    made = N.sketches(flat, np.array([len(s) for p in pairs for s in p]))
    for spec in (N.Jaccard(5, 80, 100), N.Jaccard(3, 90, 100)):
        got = N._can_link(spec, made[::2], made[1::2])
        for (a, b), kept in zip(pairs, got.tolist(), strict=True):
            both = len(np.intersect1d(a, b))
            if spec.den * both >= spec.num * (len(a) + len(b) - both):
                assert kept
            if not both:
                assert not kept
        # in a block: whoever has a possible partner of another root stays
        for roots in ([i // 2 for i in range(len(made))], [i % 2 for i in range(len(made))]):
            some = [i for i in range(len(made)) if len(made[i]) < 200]
            stay = set(N._thinner(spec)([100 + i for i in some], [roots[i] for i in some], [made[i] for i in some]))
            for k, near in enumerate(got.tolist()):
                if near and 2 * k in some and 2 * k + 1 in some and roots[2 * k] != roots[2 * k + 1]:
                    assert {100 + 2 * k, 101 + 2 * k} <= stay
            if roots[1] == 0:  # partners have one root: all others are strangers
                assert all(len(made[x - 100]) < 200 and int.from_bytes(made[x - 100][:4], "little") < 20 for x in stay)


def test_full_places_of_a_sketch():
    """Counts of 255 and more stay a lower bound, also on fewer places."""
    spec = N.Jaccard(5, 80, 100)
    same = np.zeros(40_000, np.uint64)  # (all on one place)
    made = N.sketches(np.concatenate((same, same[:9000], same[:8000])), np.array([40_000, 9000, 8000]))
    assert len(made[0]) > len(made[1]) > 4 + N.SKETCH_PLACES
    assert N._can_link(spec, made[1:2], made[2:]).all() and not N._can_link(spec, made[:1], made[1:2]).any()
    assert N._folded(made, N.SKETCH_PLACES)[1].max() == 255


def test_strangers_of_a_common_segment_stay_out_of_the_comparison(spark, monkeypatch):
    """Texts that share common segments, and little else, are neither compared by
    their shingles nor do these travel."""
    rng = np.random.default_rng(4)
    common = [" ".join(f"c{k}_{i}" for i in range(12)) for k in range(9)]
    rows = []
    for i in range(160):
        own = [f"w{rng.integers(10**6)}" for _ in range(60)]
        at = rng.integers(0, 9, 4)
        rows.append((i, " ".join([*own[:30], *(common[k] for k in at), *own[30:]])))
    rows += [(200, rows[0][1] + " x"), (201, rows[7][1] + " y z"), (202, rows[7][1].replace("w", "v"))]
    seen = []
    real = N._verify
    monkeypatch.setattr(N, "_verify", lambda pairs, sets, spec: seen.append((pairs.count(), sets.count())) or real(pairs, sets, spec))
    spec = N.Jaccard(5, 80, 100)
    assert run(spark, rows, spec) == brute(rows, 5, 80, 100)
    assert sum(p for p, _ in seen) < 10 and max(s for _, s in seen) < 10, seen


@pytest.mark.parametrize("word_bits", [22, 3])
def test_bits_tell_the_shared_signatures(spark, monkeypatch, word_bits):
    """None is missed, and with bits enough few others pass."""
    monkeypatch.setattr(N, "WORD_BITS", word_bits)
    rng = np.random.default_rng(3)
    sigs = np.concatenate((rng.integers(-(2**63), 2**63 - 1, 300), [0, -1, 2**63 - 1, -(2**63)]))
    shared = spark.createDataFrame([(int(x), 2) for x in sigs], "_sig bigint, _rows bigint")
    look_up = N._may_be_shared(shared)
    assert look_up(sigs).all()
    other = look_up(rng.integers(-(2**63), 2**63 - 1, 2000))
    assert other.sum() < (10 if word_bits == 22 else 1500)


def test_rarest_signatures_of_a_row():
    each = np.array([1, 0, 0, 1, 0, 1, 1, 3])
    sig = np.array([7, 5, 9, 7, 3, 2, 8, 4])
    rows = np.array([4, 2, 2, 4, 9, 3, 2, 6])
    drop = np.array([1, 2, 0, 1], np.int32)
    kept = sorted((int(each[i]), int(sig[i])) for i in N._rarest(each, sig, rows, drop))
    assert kept == [(0, 5), (0, 9), (1, 8)]
    none = np.zeros(0, np.int64)
    assert len(N._rarest(none, none, none, drop)) == 0
