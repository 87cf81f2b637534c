from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from cases import ascii_lower, empty, frame, rows, words

from sparkjson.llm.components import components
from sparkjson.llm.ngram_join import block_links, fold, ngram_components, parity_bits, similar
from sparkjson.llm.substring import COVER, PERIOD, remove_repeats
from sparkjson.llm.wordhash import steps


def brute_components(docs, n, num, den):
    sets = []
    for _, text in docs:
        ws = words(ascii_lower(text))
        sets.append({tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set())
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                if x != y:
                    parent[x] = y
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(docs):
        least[root(k)] = min(least[root(k)], i)
    return Counter((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(docs))


def test_ngram_join_against_all_pairs(spark):
    # one id with two texts can join two groups by its id alone; the join works on texts, so such rows stand apart here
    docs = [(r[0], r[1]) for r in rows() if r[0] != 500]
    for n, num, den in ((4, 85, 100), (5, 80, 100)):
        got = ngram_components(frame(spark).where("doc_id <> 500"), ngram=n, num=num, den=den).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(docs, n, num, den)


def test_ngram_join_empty_and_null_ids(spark):
    assert ngram_components(empty(spark)).collect() == []
    got = ngram_components(frame(spark, with_null_id=True)).where("doc_id IS NULL").collect()
    assert [r.component_id for r in got] == [None]


def test_parity_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    for n in (1, 40, 63, 64, 200, 1000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], rng.integers(0, 2**63, n // 3 + 1, dtype=np.uint64)]))
        p, q = parity_bits(a), parity_bits(b)
        w = min(len(p), len(q))
        assert np.bitwise_count(fold(p, w) ^ fold(q, w)).sum() <= len(np.setxor1d(a, b))


def test_block_links_find_all_components():
    rng = np.random.default_rng(1)
    base, sets = rng.integers(0, 2**63, 120, dtype=np.uint64), []
    for k in range(60):
        s = base.copy()
        s[rng.choice(120, k // 3, replace=False)] = rng.integers(0, 2**63, k // 3, dtype=np.uint64)
        sets.append((k, np.unique(s)))
    want = {(a, b) for a, x in sets for b, y in sets if a < b and similar(x, y, 85, 100)}
    links = {tuple(sorted(p)) for p in block_links(sets, 85, 100, [0] * 60)}
    assert links <= want

    def groups(edges):
        parent = list(range(60))
        root = lambda k: k if parent[k] == k else root(parent[k])
        for a, b in edges:
            parent[root(a)] = root(b)
        return Counter(tuple(x for x in range(60) if root(x) == root(k)) for k in range(60))

    assert groups(links) == groups(want)
    halves = [k % 2 for k in range(60)]
    across = {tuple(sorted(p)) for p in block_links(sets, 85, 100, halves)}
    assert groups(across) == groups({p for p in want if (p[0] + p[1]) % 2})


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def brute_repeats(docs):
    places = defaultdict(list)
    split = [(i, words(t)) for i, t in docs]
    for k, (i, ws) in enumerate(split):
        for s in range(len(ws) - 19):
            places[tuple(ws[s : s + 20])].append((i, s, k))
    gone = defaultdict(set)
    for at in places.values():
        first = min((i, s) for i, s, _ in at)
        for i, s, k in at:
            if (i, s) > first:
                gone[k] |= set(range(s, s + 20))
    return Counter((i, len(ws), len(gone[k]), " ".join(w for j, w in enumerate(ws) if j not in gone[k])) for k, (i, ws) in enumerate(split))


def test_remove_repeats_against_brute_force(spark):
    docs = [(r[0], r[1]) for r in rows() if r[0] != 500]
    got = remove_repeats(frame(spark).where("doc_id <> 500")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(docs)


def test_remove_repeats_empty_and_null_ids(spark):
    assert remove_repeats(empty(spark)).collect() == []
    got = remove_repeats(frame(spark, with_null_id=True)).where("doc_id IS NULL").collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(60, 0)]


def shared_ids():
    """Unrelated texts of one id, of which one is a near copy of a smaller id, and copies of both; repeats in texts of unequal length."""
    prose = lambda a, n: " ".join(f"w{a}x{k}" for k in range(n))
    first, second = prose(1, 60), prose(2, 60)
    docs = [(1, first), (5, first + " end"), (5, second), (6, second), (7, second + " end"), (8, prose(3, 30) + " " + prose(4, 40)), (9, prose(4, 40)), (9, prose(5, 200))]
    return docs + [(9, prose(6, 100) + " " + prose(4, 40)), (9, prose(4, 40)), (9, prose(4, 40) + " " + prose(7, 9))]


def test_ngram_join_tells_texts_of_one_id_apart(spark):
    docs = shared_ids() + [(r[0], r[1]) for r in rows()]
    got = ngram_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), ngram=4, num=80, den=100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(docs, 4, 80, 100)


def test_remove_repeats_tells_texts_of_one_id_apart(spark):
    docs = shared_ids() + [(r[0], r[1]) for r in rows()]
    for parts in (1, 3):
        got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(docs)


def twins(n=2048):
    """A word over a and b and its complement, which every polynomial modulo 2**64 with an odd base takes for equal."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_words_that_fool_polynomials_differ(spark):
    a, b = twins()
    rest = " ".join(f"r{k}" for k in range(19))
    for docs in ([(1, a), (2, b)], [(1, f"{rest} {a}"), (2, f"{rest} {b}")], [(1, " ".join(a)), (2, " ".join(b))]):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(df).collect()) == brute_components(docs, 4, 85, 100)
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df).collect()) == brute_repeats(docs)


def test_window_hashes_tell_all_windows_apart():
    texts = [r[1] for r in rows()] + ["y" * 300 + " z", "y" * 299 + "x z", "a b", "b a", "a\0 b", "a b\0"]
    for lane in (0, 1):
        for width in (1, 4, 5, 8, 20):
            seen = {}
            for keys, found in steps(pa.array(range(len(texts))), pa.array(texts)):
                hashes = found.windows(width, lane)
                for k, at, end in zip(keys, found.at, found.at[1:], strict=False):
                    ws = words(texts[k])
                    assert end - at == len(ws)
                    for i in range(len(ws) - width + 1):
                        assert seen.setdefault(tuple(ws[i : i + width]), hashes[at + i]) == hashes[at + i]
            assert len(set(seen.values())) == len(seen)
