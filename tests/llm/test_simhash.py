"""SimHash groups against a plain fingerprint and all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cadenza.llm import bytekit as bk
from cadenza.llm import simhash
from cadenza.llm.queries import QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, ids, limit=4):
    """The least non-null id of each print's component, over all pairs."""
    u = sorted(set(prints))
    root = list(range(len(u)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    arr = np.array(u, np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= limit) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    at = {f: find(i) for i, f in enumerate(u)}
    low = {}
    for f, d in zip(prints, ids, strict=True):
        if d is not None:
            low[at[f]] = min(low.get(at[f], d), d)
    return [low.get(at[f]) for f in prints]


def test_xxh64_of_all_lengths():
    rnd = np.random.default_rng(0)
    buf = rnd.integers(0, 256, 4000, dtype=np.uint8)
    start = rnd.integers(0, 3000, 500)
    end = start + np.arange(500) * 2 % 331
    want = [xxhash.xxh64_intdigest(buf.tobytes()[s:e], 42) for s, e in zip(start, end, strict=True)]
    assert [int(x) for x in bk.xxh64(buf, start, end, 42)] == want


TEXTS = ["", None, "one", "A b  C", "a\tb c d", "É Ünder STRASSE ß x\x0by \n z", " lead and trail ", "a b c d " * 3000, "漢字 かな ok then", "x" * 5000 + " y z w v", "no break space stays one two three"]


def test_fingerprints_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 100)  # long texts in several blocks
    got = [int(f) for t in bk.slices(pa.array(TEXTS), 64) for f in simhash.fingerprints_of(*simhash.shingle_hashes(t), len(t))]
    assert got == [plain_fingerprint(t) for t in TEXTS]


def prints_of_every_kind():
    """Random prints, chains of single flips, dense clusters and pairs at every distance."""
    rnd = random.Random(4)
    flip = lambda x, k: x ^ sum(1 << b for b in rnd.sample(range(64), k))
    out = [rnd.getrandbits(64) for _ in range(600)]
    out += [flip(x, 1 + i % 8) for i, x in enumerate(out[:200])]
    chain = [rnd.getrandbits(64)]
    for _ in range(40):
        chain.append(flip(chain[-1], 4))
    centre = rnd.getrandbits(64)
    return sorted({*out, *chain, *(flip(centre, rnd.randint(0, 4)) for _ in range(500)), 0, (1 << 64) - 1, 1, 31})


PLANS = {"computed": None, "two": [(list(range(0, 64, 2)), 2), (list(range(1, 64, 2)), 1)], "three": [(list(range(10)), -1), (list(range(10, 40)), 3), (list(range(40, 64)), 0)]}


@pytest.mark.parametrize(("plan", "bucket"), [("computed", 1 << 14), ("computed", 8), ("two", 1 << 14), ("three", 8)])
def test_links_join_what_all_pairs_join(spark, plan, bucket):
    prints = prints_of_every_kind()
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    chosen = PLANS[plan] and [(b, t) for b, t in PLANS[plan] if t >= 0]
    links = simhash.close_links(spark.createDataFrame([(x,) for x in signed], "fp long"), chosen, bucket).collect()
    bits = {s: p for s, p in zip(signed, prints, strict=True)}
    assert all((bits[r.a] ^ bits[r.b]).bit_count() <= 4 for r in links)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in links:
        a, b = find(bits[r.a]), find(bits[r.b])
        root[max(a, b)] = min(a, b)
    low = plain_groups(prints, prints)
    assert [find(p) for p in prints] == low


def test_allocation_is_the_cheapest():
    from itertools import product

    rnd = random.Random(1)
    for _ in range(50):
        costs = [[0.0, *sorted(rnd.random() * 10 for _ in range(5))] for _ in range(rnd.randint(1, 5))]
        cost, chosen = simhash.allocate(costs, 4)
        best = min(sum(c[t + 1] for c, t in zip(costs, ts, strict=True)) for ts in product(range(-1, 5), repeat=len(costs)) if sum(t + 1 for t in ts) == 5)
        assert abs(cost - best) < 1e-9 and sum(t + 1 for t in chosen) == 5


def test_parts_hold_all_bits_and_keep_correlated_ones_together():
    rnd = np.random.default_rng(2)
    on = rnd.integers(0, 2, (3000, 64))
    on[:, 1::4] = on[:, 0::4]  # bit 4i + 1 repeats bit 4i
    parts = simhash.correlated_parts(3000, on.T @ on, 4)
    assert sorted(b for p in parts for b in p) == list(range(64)) and {len(p) for p in parts} == {16}
    assert sum(b in p and b + 1 in p for p in parts for b in range(0, 64, 4)) >= 13  # a part that is full may cut one pair


def test_odd_rows(spark):
    same = "one two three four five six"
    rows = [(1, None), (5, ""), (None, same), (None, None), (3, same), (3, same), (4, "  \n "), (9, same.upper()), (None, "alone as can be here")]
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, fp int, root string, component_id int")
    got = sorted(simhash.simhash_groups(df).collect(), key=str)
    prints = [plain_fingerprint(t) for _, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, prints, plain_groups(prints, [d for d, _ in rows]), strict=True)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in docs]
    low = plain_groups(prints, [r.doc_id for r in docs])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op13_simhash_pigeonhole"](spark, sf).collect()}
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(docs, prints, low, strict=True)}


def test_keys_longer_than_an_arrow_batch(spark):
    """All rows of a batch may belong to one key, which is then not complete."""
    assert [len(x) for x in simhash.forest(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), 4)] == [0, 0]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        prints = [(i << 20) | 5 for i in range(64)]
        links = simhash.close_links(spark.createDataFrame([(x,) for x in prints], "fp long"), [(list(range(20)), 0), (list(range(40, 64)), 3)]).collect()
    finally:
        spark.conf.set(size, was)
    near = {x: x for x in prints}
    for _ in prints:
        for r in links:
            near[r.a] = near[r.b] = min(near[r.a], near[r.b])
    assert set(near.values()) == {5}


def test_large_keys_are_split_before_neighbours_are_tried(spark, monkeypatch):
    """A key of 3,000 fingerprints that differ elsewhere comes down to small keys; no fingerprint goes to its 2,081 neighbours."""
    monkeypatch.setattr(simhash, "_meeting_links", lambda fps: pytest.fail("not split"))
    rnd = random.Random(8)
    prints = [rnd.getrandbits(50) << 13 for _ in range(1500)]
    prints = sorted({*prints, *(p ^ (1 << rnd.randrange(13, 63)) ^ (1 << rnd.randrange(13, 63)) for p in prints)})
    plan = [(list(range(13)), 0), *((list(range(13 + 13 * i, min(26 + 13 * i, 64))), 0) for i in range(4))]
    links = simhash.close_links(spark.createDataFrame([(p,) for p in prints], "fp long"), plan, 64).collect()
    low = plain_groups(prints, prints)
    near = {p: p for p in prints}
    for _ in range(20):
        for r in links:
            near[r.a] = near[r.b] = min(near[r.a], near[r.b])
    assert [near[p] for p in prints] == low
