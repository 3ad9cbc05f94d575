"""Exact dedup and SimHash near-dedup against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from gridwright.llm import components, exact_dedup, simhash_dedup

SCHEMA = "doc_id bigint, text string, lang string, ROW string, digest string, fp long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", 7) for i, t in rows], SCHEMA)


ODD = [(1, "a b"), (2, "a  b"), (3, "a\t\nb"), (4, None), (5, ""), (None, "a b"), (3, "a b"), (7, " a b"), (8, "z" * 200_000),
       (9, "z" * 200_000), (10, "a b"), (None, "lonely"), (6, "twice"), (6, "twice")]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_dedup(spark, counters):
    rng = random.Random(1)
    rows = ODD + [(100 + k, "hot copy" if k % 3 == 0 else f"text {rng.randint(0, 40)}") for k in range(300)]
    got = exact_dedup.exact_dedup(frame(spark, rows).repartition(5), counters).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    for r in got:
        ids = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        real = [i for i in ids if i is not None]
        assert r["keep_id"] == (min(real) if real else None) and r["group_size"] == len(ids)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in got) == len(groups)


def test_drop_copies_keeps_rows_whole(spark):
    d = frame(spark, ODD)
    got = exact_dedup.drop_copies(d)
    assert got.columns == d.columns
    assert sorted((r["doc_id"] or 0, norm(r["text"])) for r in got.collect()) == sorted(
        {(min([i for i, u in ODD if norm(u) == norm(t) and i is not None], default=0), norm(t)) for _, t in ODD})


def test_misra_gries_keeps_every_heavy_key():
    rng = random.Random(2)
    keys = ["a"] * 400 + ["b"] * 250 + [f"k{rng.randint(0, 200)}" for _ in range(350)]
    rng.shuffle(keys)
    for counters in (1, 2, 3, 9):
        held = exact_dedup.misra_gries(iter(keys), counters)
        assert len(held) <= counters
        assert all(k in held for k in set(keys) if keys.count(k) > len(keys) / (counters + 1))


def brute_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                root[find(b)] = find(a)
    return {n: find(n) for n in nodes}


def test_fingerprint():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 5, 50):
        t = " ".join(rng.choice(["Alpha", "béta", "ÉÉ", "x"]) for _ in range(n))
        assert simhash_dedup.fingerprint(t) == brute_fp(t)
    assert simhash_dedup.fingerprint(None) == 0
    long = " ".join(str(k % 977) for k in range(40_000))
    assert simhash_dedup.fingerprint(long) == brute_fp(long)


@pytest.mark.parametrize("segments,limit", [(16, 256), (16, 2), (8, 256), (32, 3)])
def test_links_connect_what_is_within_two_bits(spark, segments, limit):
    rng = random.Random(4)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randint(0, 63)
            fps.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    d = spark.createDataFrame([(signed(v),) for v in fps], "fp bigint")
    links = simhash_dedup.links(d, 2, segments, limit)
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in links.collect())
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = brute_components([signed(v) for v in fps], lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    same = lambda m: sorted(tuple(sorted(n for n in want if m.get(n, n) == r)) for r in {m.get(n, n) for n in want})
    assert same(got) == same(want)


def test_components_of_chains_and_stars(spark):
    e = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}, 200: 200, 300: 200}


def test_simhash_dedup(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("the of and to in is it as at by".split()) + str(rng.randint(0, 99)) for _ in range(400))
            for _ in range(6)]
    rows = ODD + [(1000 + 10 * k + j, b if j < 2 else b + " tail" + str(j)) for k, b in enumerate(base) for j in range(6)]
    got = simhash_dedup.simhash_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_components(sorted({brute_fp(t) for _, t in rows}), lambda a, b: bin(a ^ b).count("1") <= 2)
    low = {}
    for i, t in rows:
        if i is not None:
            r = want[brute_fp(t)]
            low[r] = min(low.get(r, i), i)
    expected = sorted((str(i), f"{brute_fp(t):016x}", str(low.get(want[brute_fp(t)]))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == expected
    kept = simhash_dedup.drop_near_copies(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert kept.count() == len(set(want.values()))


def test_empty_tables(spark):
    d = frame(spark, [])
    assert exact_dedup.exact_dedup(d).count() == 0 and simhash_dedup.simhash_dedup(d).count() == 0
    assert exact_dedup.drop_copies(d).count() == 0 and simhash_dedup.drop_near_copies(d).count() == 0


def test_extra_columns_do_not_clash(spark):
    d = frame(spark, [(1, "a b c"), (2, "a b c")]).withColumn("_tk", F.lit("mine")).withColumn("_score", F.lit(1.5))
    got = exact_dedup.drop_copies(d)
    assert got.columns == d.columns and [(r["doc_id"], r["_tk"]) for r in got.collect()] == [(1, "mine")]
