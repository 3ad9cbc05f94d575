"""Phrase collocations, quality rules and centroid clustering against brute
force, and the shape of their plans."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.llm import clustering, collocations, quality_rules

PYTHON = re.compile(r"Python|Pandas|Arrow")
DOCS = "doc_id bigint, text string, lang string, n_words string, W string, doc long, phrase string, gid int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", 7, "z", 3) for i, t, lang in rows], DOCS)


# ---------------------------------------------------------------- collocations

_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, min_count, top, max_words=5):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < min_count:
            continue
        inside = (g for (g_lang, g), c in f.items() if g_lang == lang and len(g) > len(p) and 100 * c >= 100 * a and c >= min_count
                  and any(g[i:i + len(p)] == p for i in range(len(g) - len(p) + 1)))
        if any(True for _ in inside):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in sorted({o[0] for o in out}):
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(o[0], k, *o[1:]) for k, o in enumerate(mine[:top], 1)]
    return sorted(ranked)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(12)] + ["É", "é", "a", "A", "x-y", " ", "%_"]
    rows = [(1, None, "en"), (2, "", None), (3, "   \t ", "en"), (4, ".,;:!?\n\r\x0b\x0c", "de"), (5, "One", "en"),
            (6, "long " * 30_000 + "tail", "fr"), (7, "a a a a a a a", None), (7, "a a a a a a a", None), (None, "W1 w2, w3", "en")]
    for i in range(160):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(0, 9))) for _ in range(rng.randint(0, 4))]
        if i % 3 == 0:
            parts.append("The Quick\tbrown  fox jumps over")
        rows.append((100 + i, rng.choice([". ", ",", "\n", " ; "]).join(parts), rng.choice(["en", "en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("most", [collocations.BROADCAST_GROUPS, 0])
def test_collocations_equal_brute_force(spark, phrase_rows, most):
    got = collocations.collocations(docs_frame(spark, phrase_rows).repartition(5), min_count=4, top=60, broadcast_groups=most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(phrase_rows, 4, 60)


def test_collocations_exact_past_64_bits(spark):
    big = 3_000_000_000
    groups = [spark.createDataFrame([(1, "en", "a", big, None, None, [big], [big]), (2, "en", "b", big + 1, None, None, [big + 1], [big + 1])],
                                    "gid long, lang string, phrase string, count long, head long, tail long, heads array<long>, tails array<long>"),
              spark.createDataFrame([(3, "en", "a b", big - 7, 1, 2, [big, big - 7], [big + 1, big - 7])],
                                    "gid long, lang string, phrase string, count long, head long, tail long, heads array<long>, tails array<long>")]
    n = 9_000_000_000_000_000
    row = collocations.candidates(groups, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert row["score"] == 1000 * (big - 7) * n // (big * (big + 1))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_frame(spark, [])).collect() == []
    assert collocations.collocations(docs_frame(spark, [(1, None, None)]), min_count=1).collect() == []


def test_occurrences_join_in_place(spark, phrase_rows):
    """The merge-join of a stored relation with itself shuffles nothing."""
    d = docs_frame(spark, phrase_rows).select(F.monotonically_increasing_id().alias("doc"), F.length("text").alias("at"), F.lit(1).alias("gid"))
    rel = collocations._Relation(d.repartition(8, "doc"), 8)
    with collocations._joined_in_place(spark):
        a, b = rel.rows().alias("a"), rel.rows().alias("b")
        plan = a.hint("merge").join(b, F.expr("a.doc = b.doc and a.at + 1 = b.at"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    rel.drop()
    assert not spark.catalog.tableExists(rel.name)


# --------------------------------------------------------------- quality rules

def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = Counter(wins)
    covered = {i + k for i, x in enumerate(wins) if count[x] > 1 for k in range(5)}
    base = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), base


ODD_TEXTS = [None, "", " \n\t\x0b\x0c\r", "one", "a b c d e", "a b c d e a b c d e", "x " * 12, "a b c d e f " * 3, "a b c d\x00 e! a b c d\x00 e",
             "1 2 3 4 5 1 2 3 4 51 2 3 4 5 1", "a b c d e f g h i j k", "\U0001f600 " * 11, "#*$%&|<> ok", "l1\nl1\n\nl1 \nl2", "- a\n- b\n* c...\n",
             "word " * 60_000, " ".join(f"w{k}" for k in range(60_000)), " ".join(f"w{k % 30_000}" for k in range(60_000))]


def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ODD_TEXTS + [rng.choice([" ", "\n", "\t "]).join(rng.choices("a b c the of % # | é".split(), k=rng.randint(0, 60)))
                         for _ in range(200)]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(3, "one", "en"), (None, "one", "en")]
    got = quality_rules.quality(docs_frame(spark, rows))
    assert not PYTHON.search(got._jdf.queryExecution().executedPlan().toString())
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    seen = [(r["doc_id"], *(r[n] for n in names)) for r in got.collect()]
    assert Counter(seen) == Counter((k, *brute_quality(t)) for k, t, _ in rows)


def test_thresholds_decide(spark):
    prose = "the cat and the dog went to a house that was not far from the river "
    cases = {"clean": prose * 1 + "and it was good", "symbols": "the %% and ## of $$ cat || in & it * is # a <> on", "short": "the cat",
             "digits": "1 2 3 4 5 6 7 8 9 10 11 12 13 the", "letters": "q w e r t z u i o p a the s", "list": "\n".join(f"- the item of it k{k}" for k in range(20)),
             "dots": "\n".join(f"and the item {k}..." for k in range(20)), "lines": "the same line of it\n" * 4 + "and one more line that was here now"}
    rows = [(k, t, None) for k, t in enumerate(cases.values())]
    got = {r["doc_id"]: r for r in quality_rules.quality(docs_frame(spark, rows)).collect()}
    failed = {name: got[k]["failed"] for k, name in enumerate(cases)}
    assert got[0]["kept"] and failed["clean"] == []
    assert "symbols" in failed["symbols"] and not got[1]["kept"] and not got[1]["base_failed"]
    assert got[2]["base_failed"] and not got[2]["kept"]
    assert "words with letters" in failed["digits"] and "word length" in failed["letters"]
    assert failed["list"] == ["bullet lines"] and failed["dots"] == ["ellipsis lines"] and "repeated lines" in failed["lines"]
    only = quality_rules.quality(docs_frame(spark, rows), thresholds=(("any", "n_words", "n_words", None, 999),))
    assert not any(r["kept"] for r in only.collect())
    assert quality_rules.quality(docs_frame(spark, [])).collect() == []


# ------------------------------------------------------------------ clustering

VECS = "vec_id bigint, embedding array<double>, cluster string, v int, D string"


def brute_clusters(rows, clusters, rounds, size):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows
            if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:clusters]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in kept:
            mine[near(v)[1]].append(v)
        for k, vs in mine.items():
            cents[k] = [sum(col) // len(vs) for col in zip(*vs)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    per = Counter()
    for _, k, d in out:
        per[k] += d
    return sorted(((i, k, d, per[k], sum(per.values()), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest())
                   for i, k, d in out), key=repr)


def vector_frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, e, "x", 5, "y") for i, e in rows], VECS).repartition(parts)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_clusters_equal_brute_force(spark, scale):
    rng = random.Random(7)
    rows = [(k, [rng.gauss(k % 4, 1) * scale for _ in range(6)]) for k in range(120)]
    rows += [(3, rows[3][1]), (None, [0.0] * 6), (500, [0.0] * 6), (501, [-0.001] * 6), (502, None), (503, []), (504, [1.0] * 5), (505, [1.0] * 7),
             (506, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (507, [float("nan")] * 6), (508, [float("inf")] + [0.0] * 5)]
    for clusters in (1, 7):
        got = clustering.cluster(vector_frame(spark, rows), clusters=clusters, rounds=3, size=6)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows, clusters, 3, 6)


def test_few_or_no_vectors(spark):
    assert clustering.cluster(vector_frame(spark, []), size=6).collect() == []
    rows = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [9.0, -9.0])]
    got = clustering.cluster(vector_frame(spark, rows), clusters=40, size=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows, 40, 5, 2)


def test_inertia_past_bigint_is_null(spark):
    got = clustering.cluster(vector_frame(spark, [(1, [4e9] * 2), (2, [-4e9] * 2), (3, [4e9] * 2)]), clusters=1, size=2).collect()
    assert [r["inertia"] for r in got] == [None] * 3 and all(r["cluster"] == 0 for r in got)


def test_search_rejects_and_stays_exact():
    rng = np.random.default_rng(1)
    for spread in (1, 30, 1 << 22):
        c = rng.integers(-spread, spread + 1, (50, 16))
        x = np.concatenate([rng.integers(-spread, spread + 1, (400, 16)), c[:9], c[:9] + 1])
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        no, best, computed = clustering.nearest(x, c)
        assert (best == d.min(axis=1)).all() and (no == d.argmin(axis=1)).all()
        big_no, big, _ = clustering.nearest(x.astype(object), c.astype(object))
        assert (big_no == no).all() and (big == best).all()
        assert computed < len(x) * len(c)
    near = np.concatenate([c[:20] + k for k in (0, 1, -1)])  # vectors close to a centroid: most distances are never computed
    assert clustering.nearest(near, c)[2] < 0.5 * len(near) * len(c)
