"""Links against a comparison of all pairs, ball hashing over several bucket widths, near-duplicates by exact similarity."""

import numpy as np
import pytest
import xxhash
from fixtures import SENTENCE, docs, edited, empty, sentences

from ledgerlens.llm import simhash


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def planted(seed, n=150):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for i in range(60):  # neighbours at 0 to 6 bits of earlier ones, some in chains
        flips = rng.choice(64, rng.integers(0, 7), replace=False)
        fps[n - 60 + i] = fps[rng.integers(0, n - 60 + i)] ^ np.uint64(sum(1 << int(b) for b in flips))
    return np.unique(fps)


@pytest.mark.parametrize("bits", [0, 3, 6, 9, 12])
def test_buckets_meet_every_pair_within_the_radius(bits, monkeypatch):
    fps = planted(bits)
    monkeypatch.setattr(simhash, "SLICE", 20_000)  # several slices in a bucket
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4])
    pairs = []
    steps = np.unique(simhash.ball(bits)[1])
    own = simhash.bucket_of(fps, simhash.ball(bits)[2])
    for bucket in range(1 << bits):
        here = fps[np.isin(own ^ bucket, steps)]
        for rows, begin in simhash.shared_variants(here, bucket, bits) if len(here) else ():
            for group in np.split(rows, begin[1:]):
                found = [int(np.searchsorted(fps, here[i])) for i in group]
                assert all(int(fps[found[0]] ^ fps[x]).bit_count() <= 4 for x in found)
                pairs += [(found[0], x) for x in found[1:]]
    assert roots(len(fps), pairs) == want


def test_sizes_keep_tasks_bounded():
    assert simhash.bits_for(10_000, 6) == 6
    for n in (10**7, 10**9, 10**11):
        bits = simhash.bits_for(n, 6)
        assert n * min(1.0, 2081 / 2**bits) <= simhash.HOLD


def test_linked(spark):
    texts = sentences(4, 12, 200)
    rows = [(100 + i, t, "en") for i, t in enumerate(texts + [edited(t, 1, i) for i, t in enumerate(texts)] + texts[:3])]
    df = docs(spark).unionByName(docs(spark, rows))
    got = {(r.doc_id, r.fp): r.component for r in simhash.linked(df).collect()}
    all_rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()]
    assert {(i, f - (f >> 63 << 64)) for i, f in all_rows} == set(got)
    fps = [f for _, f in all_rows]
    root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    low = {}
    for (i, _), r in zip(all_rows, root):
        low[r] = min(low.get(r, 10**9), 10**9 if i is None else i)
    for (i, f), r in zip(all_rows, root):
        assert (got[i, f - (f >> 63 << 64)] if got[i, f - (f >> 63 << 64)] is not None else 10**9) == low[r]
    assert got[4, 0] == got[5, 0] == got[6, 0] == 4


def test_drop_near_duplicates(spark):
    texts = sentences(9, 8, 150)
    chain = [texts[0]]
    for i in range(4):
        chain.append(edited(chain[-1], 2, i))
    group = [edited(texts[1], 1, 50 + i) for i in range(25)]
    rows = [(1000 + i, t, "en") for i, t in enumerate(texts + chain[1:] + group + [edited(texts[2], 60, 1), texts[3], texts[3]])]
    df = docs(spark).unionByName(docs(spark, rows)).unionByName(docs(spark, rows[-1:]))
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns and out.where("fp != 'extra-fp'").count() == 0
    all_rows = [(r.doc_id, set(simhash.shingle_set((r.text or "").encode()).tolist())) for r in df.collect()]
    sim = [(i, j) for i in range(len(all_rows)) for j in range(i)
           if len(all_rows[i][1] & all_rows[j][1]) >= 0.8 * len(all_rows[i][1] | all_rows[j][1])]
    best = {}
    for (i, _), r in zip(all_rows, roots(len(all_rows), sim)):
        best[r] = min(best.get(r, 10**9), 10**9 if i is None else i)
    assert sorted(10**9 if r.doc_id is None else r.doc_id for r in out.select("doc_id").collect()) == sorted(best.values())


def test_empty(spark):
    assert simhash.linked(empty(spark)).count() == 0 and simhash.drop_near_duplicates(empty(spark)).count() == 0
    assert simhash.linked(docs(spark, [(1, SENTENCE, "en")])).count() == 1


def kept_by_all_pairs(df):
    rows = [(r.doc_id, set(simhash.shingle_set((r.text or "").encode()).tolist())) for r in df.collect()]
    sim = [(i, j) for i in range(len(rows)) for j in range(i) if len(rows[i][1] & rows[j][1]) >= 0.8 * len(rows[i][1] | rows[j][1])]
    return sorted({r: rows[r][0] for r in roots(len(rows), sim)}.values())


def test_copies_alike_only_through_their_base(spark):
    base = sentences(31, 1, 330, 4000)[0]
    rows = [(i, edited(base, 6, i), "en") for i in range(60)] + [(60, base, "en")]
    df = docs(spark, rows)
    assert kept_by_all_pairs(df) == [0]
    assert [r.doc_id for r in simhash.drop_near_duplicates(df).collect()] == [0]


def test_edited_blocks(spark):
    rows = []
    for i, text in enumerate(sentences(32, 12, 300, 4000)):
        more, w = sentences(100 + i, 1, 60, 4000)[0].split(), text.split()
        rows += [(10 * i, text, "en"), (10 * i + 1, " ".join(w + more[:20 + 4 * i]), "en"), (10 * i + 2, " ".join(w[:240 + 3 * i]), "en"),
                 (10 * i + 3, " ".join(w[:100] + more[:15 + 2 * i] + w[115 + 2 * i:]), "en")]
    df = docs(spark, rows)
    want = kept_by_all_pairs(df)
    assert 12 <= len(want) < 20 and sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == want


@pytest.mark.parametrize("bits", [0, 4, 9])
def test_a_node_is_told_its_smallest_neighbour_by_few_buckets(bits, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 50_000)
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.concatenate([[x ^ np.uint64(sum(1 << int(b) for b in rng.choice(8, rng.integers(0, 5), replace=False))) for _ in range(60)] for x in base])
    nodes = rng.permutation(len(fps)).astype(np.int64) + 100  # many have a fingerprint in common
    batch = simhash.pa.RecordBatch.from_arrays([simhash.pa.array(np.zeros(len(fps), dtype=np.int32)), simhash.pa.array(fps.view(np.int64)), simhash.pa.array(nodes)],
                                               names=["table", "fp", "node"])
    dealt = simhash.pa.Table.from_batches(simhash._deal(bits)([batch]))
    told = [simhash._link(bits, False)(dealt.slice(i, 1)) for i in range(len(dealt))]
    low = {}
    for t in told:
        for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist()):
            low[b] = min(a, low.get(b, a))
    want = {}
    for i, x in enumerate(fps):
        near = [int(nodes[j]) for j, y in enumerate(fps) if nodes[j] < nodes[i] and int(x ^ y).bit_count() <= 4]
        if near:
            want[int(nodes[i])] = min(near)
    assert low == want and sum(map(len, told)) < 8 * len(fps)


def test_parities_tell_no_more_differences_than_there_are():
    rng = np.random.default_rng(3)
    for shared in (0, 1, 40, 300):
        x, y, z = (rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) for n in (30, 70, shared))
        a, b = (np.unique(np.concatenate((s, z))) for s in (x, y))
        bits = np.bitwise_count((simhash.parities(a) ^ simhash.parities(b)).view(np.uint64)).sum()
        assert 20 < bits <= len(np.setxor1d(a, b))
    assert not simhash.parities(a[:0]).any()


def test_few_of_the_sets_that_share_a_rare_shingle_are_compared(spark, monkeypatch):
    lines = sentences(7, 41, 40, 4000)
    rows = [(i, f"{lines[40]} {x}", "en") for i, x in enumerate(lines[:40])]  # unlike but for a line; each has a twin
    rows += [(100 + i, edited(t, 1, i), "en") for i, (_, t, _) in enumerate(rows)]
    compared = []
    verified = simhash._verified

    def counted(pairs, sets, least):
        compared.append(pairs.count())
        return verified(pairs, sets, least)

    monkeypatch.setattr(simhash, "_verified", counted)
    df = docs(spark, rows)
    out = sorted(r.doc_id for r in simhash.drop_near_duplicates(df, least=0.5).collect())
    kept = [(r.doc_id, set(simhash.shingle_set(r.text.encode()).tolist())) for r in df.collect()]
    sim = [(i, j) for i in range(len(kept)) for j in range(i) if len(kept[i][1] & kept[j][1]) >= 0.5 * len(kept[i][1] | kept[j][1])]
    assert out == sorted({r: kept[r][0] for r in roots(len(kept), sim)}.values())
    assert sum(compared[1:]) <= 80
