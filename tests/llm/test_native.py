"""Decontamination, URL filter, line dedup and license scan against brute
force, and that their plans hold no Python."""

import itertools
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridwright.llm import decontaminate, license_scan, line_dedup, passages, url_rules
from gridwright.llm.queries import URL_RULES

PYTHON = re.compile(r"Python|Pandas|Arrow")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(rng, n, size=400):
    return [f"w{rng.randint(0, size)}" for _ in range(n)]


def tokens(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def grams(w):
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute_leaks(docs, items):
    out = set()
    for (i, text), (k, item) in itertools.product(docs, items):
        w, v = tokens(text), tokens(item)
        if k is None or len(v) < 5:
            continue
        y = grams(v)
        for s in range(max(1, len(w) - 4)):
            x = grams(w[s:s + len(v)])
            if sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                out.add((i, k))
                break
    return out


@pytest.fixture(scope="module")
def leak_case(spark):
    rng = random.Random(1)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([5, 6, 15, 30, 59, 59, 80])]
    items += [(90, "too short item"), (91, None), (None, items[3][1]), (92, "a b a b a b a b a b a b")]
    docs = []
    for i in range(60):
        w = words(rng, rng.randint(0, 120))
        k, item = items[i % 7]
        v = item.split()
        if i % 3 == 0:
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = v
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, items[4][1].upper().replace(" ", ",\n ")), (None, items[2][1]), (0, docs[0][1]),
             (103, "a b a b a b a b a b a b a b"), (104, " ".join(words(rng, 30_000)) + " " + items[5][1])]
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, n string, start int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, doc_id string")
    return d, b, brute_leaks(docs, items)


@pytest.mark.parametrize("literals", [passages.LITERALS, 0])
def test_leaks(leak_case, literals):
    d, b, want = leak_case
    got = decontaminate.leaks(d, b, literals=literals)
    rows = got.collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    assert all(r["similarity"] >= 0.8 and r["bits"] <= decontaminate.RADIUS for r in rows)
    assert not PYTHON.search(plan(got))


@pytest.mark.parametrize("literals", [passages.LITERALS, 0])
def test_leaks_in_another_order(spark, literals):
    rng = random.Random(10)
    items = [(k, " ".join(words(rng, n, 10_000))) for k, n in enumerate([100, 60, 80])]
    docs = []
    for k, turn in ((0, 30), (0, 70), (1, 20), (1, 45), (2, 11), (2, 40)):
        v = items[k][1].split()
        w = words(rng, rng.randint(0, 60), 10_000)
        docs.append((len(docs), " ".join(w + v[turn:] + v[:turn] + w[:len(docs) * 9])))
    want = brute_leaks(docs, items)
    assert len(want) == len(docs)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b, literals=literals).collect()} == want


def test_drop_contaminated(leak_case):
    d, b, want = leak_case
    kept = decontaminate.drop_contaminated(d, b)
    bad = {i for i, _ in want}
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in d.collect() if r["doc_id"] not in bad)
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0
    assert decontaminate.decontaminate(d, b.limit(0)).count() == 0


def test_candidates_grow_with_shared_shingles(spark):
    rng = random.Random(12)
    items = [(k, " ".join(words(rng, 30, 50_000))) for k in range(60)]  # one size, so nothing but shingles tells them apart
    docs = [(i, " ".join(words(rng, 20, 50_000) + items[i % 60][1].split()[i % 5:25])) for i in range(120)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    t = passages.passage_table(b, "item_id", "text")
    w = passages.hit_windows(d, t, "array(struct(i - p as start, n as size), struct(i as start, n as size))", keyed=True).cache()
    filed = t.select("key", "n", "sh", F.expr(decontaminate.simhash_sql("sh")).alias("fp"))
    opened = w.select("n", "win", "key").distinct().count()
    got = decontaminate.candidates(w, decontaminate.signed(w), filed)
    assert 0 < got.count() <= opened < 60 * w.select("win").distinct().count() / 20
    assert not PYTHON.search(plan(got))
    w.unpersist()


def test_multi_index_reaches_every_fingerprint_in_the_radius():
    rng = random.Random(2)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, decontaminate.RADIUS)):
            y ^= 1 << b
        assert any(bin((x ^ y) >> 8 * k & 255).count("1") <= decontaminate.FLIPS for k in range(decontaminate.BLOCKS))


def test_licenses(spark):
    rng = random.Random(3)
    texts = [t for _, t in license_scan.NOTICES]
    docs = []
    for i in range(45):
        w = " ".join(words(rng, rng.randint(0, 90)))
        docs.append((i, f"{w} {texts[i % len(texts)]} {w}" if i % 2 else w))
    docs += [(100, None), (101, ""), (102, texts[0].upper()), (None, texts[3]), (1, docs[1][1]),
             (103, " ".join(texts[6].split()[:-4])), (104, " ".join(texts[6].split()[::2]))]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, license string")
    got = license_scan.scan(d, license_scan.notices(spark))
    want = set()
    for i, t in docs:
        w = tokens(t)
        for k, tpl in enumerate(texts):
            v = tokens(tpl)
            y = set(grams(v))
            if any(len(y & set(grams(w[s:s + len(v)]))) >= 0.8 * len(y) for s in range(max(1, len(w)))):
                want.add((i, k))
    rows = got.collect()
    assert want <= {(r["doc_id"], r["template_id"]) for r in rows}
    assert all(r["containment"] >= 0.8 for r in rows)
    for r in rows:  # a window is twice as long as the template, so it may hold a passage with more gaps
        t = next(t for i, t in docs if i == r["doc_id"])
        w = tokens(t)
        y = set(grams(tokens(texts[r["template_id"]])))
        assert len(y & set(grams(w))) >= 0.8 * len(y)
    assert not PYTHON.search(plan(got))
    assert license_scan.scan(d.limit(0), license_scan.notices(spark)).count() == 0


def test_licenses_with_words_put_in(spark):
    rng = random.Random(11)
    texts = [(k, t) for k, (_, t) in enumerate(license_scan.NOTICES) if len(tokens(t)) > 25]
    docs = []
    for before in range(0, 90, 3):
        k, t = texts[before % len(texts)]
        v = t.split()
        at = rng.randint(5, len(v) - 5)
        v[at:at] = words(rng, rng.randint(8, len(v) - 8))
        docs.append((before, " ".join(words(rng, before) + v + words(rng, 60))))
    want = set()
    for i, t in docs:
        w = tokens(t)
        for k, tpl in enumerate(x for _, x in license_scan.NOTICES):
            v = tokens(tpl)
            y = set(grams(v))
            if any(len(y & set(grams(w[s:s + 2 * len(v)]))) >= 0.8 * len(y) for s in range(len(w))):
                want.add((i, k))
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), license_scan.notices(spark)).collect()
    assert {(r["doc_id"], r["template_id"]) for r in got} == want and len(want) >= len(docs)
    assert all(r["places"] >= 1 for r in got)


def test_band_settings():
    for n in (5, 8, 12, 60):
        own = n - 4
        shared = -(-8 * own // 10)
        j = shared / (own + 2 * n - 4 - shared)
        assert j >= 1 or 1 - (1 - j) ** license_scan.bands_for(n) >= license_scan.PROBABILITY


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_near_lines(spark):
    rng = random.Random(4)
    lines = set()
    for _ in range(25):
        base = "".join(rng.choice("abcdé 🙂") for _ in range(rng.randint(3, 40)))
        for _ in range(5):
            b = list(base)
            for _ in range(rng.randint(0, 3)):
                q, o = rng.randint(0, len(b)), rng.randint(0, 2)
                if o == 0:
                    b.insert(q, "x")
                elif q < len(b):
                    b[q:q + 1] = [] if o == 1 else ["y"]
            lines.add("".join(b))
    lines = sorted(lines)
    d = spark.createDataFrame([(x,) for x in lines + lines[::3]], "line string")
    for edits, least in ((1, 2), (2, 3), (2, 24), (3, 4)):
        pairs = line_dedup.near_pairs(d, edits, least)
        rows = pairs.collect()
        got = {tuple(sorted((lines.index(r["p"]), lines.index(r["t"])))): r["edits"] for r in rows}
        assert len(got) == len(rows) and all(len(r["p"]) <= len(r["t"]) for r in rows)
        want = {}
        for (i, x), (j, y) in itertools.combinations(enumerate(lines), 2):
            if min(len(x), len(y)) >= max(least, edits + 1) and abs(len(x) - len(y)) <= edits and (e := distance(x, y)) <= edits:
                want[i, j] = e
        assert got == want, (edits, least)
    assert not PYTHON.search(plan(line_dedup.near_pairs(d, 2, 3)))


def edited(rng, line, n):
    b = list(line)
    for _ in range(n):
        q, o = rng.randint(0, len(b)), rng.randint(0, 2)
        b[q:q + (o > 0)] = "" if o == 1 else rng.choice("qzü")
    return "".join(b)


def allowed(n):
    return max([k for low, k in line_dedup.EDITS if n >= low], default=0)


def check_own_edits(spark, lines):
    got = {tuple(sorted((r["p"], r["t"]))): r["edits"] for r in line_dedup.near_pairs(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    want = {}
    for x, y in itertools.combinations(sorted(lines), 2):
        k = allowed(min(len(x), len(y)))
        if abs(len(x) - len(y)) <= k and (e := distance(x, y)) <= k:
            want[x, y] = e
    assert got == want
    return want


def test_near_lines_longer_lines_allow_more_edits(spark):
    rng = random.Random(8)
    lines = set()
    for size in (38, 41, 59, 62, 79, 85, 158, 165, 240, 318, 330, 420, 640):
        base = "".join(rng.choice("abcdefg ") for _ in range(size))
        lines |= {base} | {edited(rng, base, rng.randint(1, 14)) for _ in range(5)}
    want = check_own_edits(spark, lines)
    assert max(want.values()) > 8 and sum(e > 2 for e in want.values()) > 40
    word = "the committee has published its yearly report on the state of the rivers and lakes of the northern districts, " * 2
    assert len(word) > 200 and list(check_own_edits(spark, {word, word.replace("published", "withdrawn", 1)}).values()) == [9]


def test_near_lines_link_short_lines(spark):
    rng = random.Random(9)
    lines = {"All rights reserved.", "All rights reservd.", "Al rights reserved", "abc", "abd", "shorx", "short"}
    for size in (3, 5, 6, 7, 9, 10, 12, 15, 19, 22, 23, 24):
        base = "".join(rng.choice("abcd ") for _ in range(size))
        lines |= {base} | {edited(rng, base, rng.randint(1, 3)) for _ in range(5)}
    hot = "common words"  # one segment shared by many different lines
    lines |= {hot + "".join(rng.choice("xyz") for _ in range(6)) for _ in range(60)}
    want = check_own_edits(spark, {x for x in lines if x})
    assert ("All rights reservd.", "All rights reserved.") in want and ("abc", "abd") not in want
    assert sum(len(x) < 24 for x, _ in want) > 60


def shuffle_blocks(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for i in range(blocks.size()) if (name := blocks.apply(i).name()).startswith("shuffle_")}


def test_near_lines_leave_no_shuffle_files(spark):
    rng = random.Random(10)
    d = spark.createDataFrame([("".join(rng.choice("abcdefg ") for _ in range(200)),) for _ in range(200)], "line string")
    before = shuffle_blocks(spark)
    pairs = line_dedup.near_pairs(d)  # its keys are joined by now, not yet its texts
    end = time.time() + 20
    while (left := shuffle_blocks(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and pairs.count() == 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_parts_hold_every_segment_once(spark):
    line = spark.range(1).select(F.col("id").alias("h"), F.expr("encode(repeat('abcdefghij', 40), 'UTF-32') as wide"), F.lit(400).alias("size"))
    filed = [line_dedup._filed(line, line_dedup.EDITS, part).count() for part in range(line_dedup.PARTS)]
    assert sum(filed) == 36 and max(filed) <= 16  # 13 segments, 36 substrings of them


def test_near_lines_with_long_equal_ends(spark):
    rng = random.Random(11)
    base = "".join(rng.choice("abcdefg é🙂") for _ in range(4100))  # longer than lengths are told apart beside a key
    lines = {base, base[:2050] + "x" + base[2050:], base[:-1], "y" + base, base[:40] + "zz" + base[42:4000]}
    assert len(check_own_edits(spark, lines)) == 6
    pairs = spark.createDataFrame([("", "", 0, 0), ("", "ab", 2, 2), ("", "ab", 1, -1), ("aaa", "aaaa", 1, 1), ("abab", "ab", 2, 2), ("ab", "ab", 0, 0),
                                   ("abcab", "abab", 1, 1), ("éab🙂", "éb🙂", 1, 1)], "p string, t string, k int, want int")
    assert pairs.filter(F.expr(line_dedup.distance_sql("p", "t", "k")) != F.col("want")).count() == 0


def test_near_lines_of_any_alphabet(spark):
    rng = random.Random(12)
    lines = set()
    for size in (8, 14, 45, 65, 90, 170, 330):
        for letters in ("abcdef ", "abcdé ß ", "aœ—ч🙂b ", "abcé\x1a "):
            base = "".join(rng.choice(letters) for _ in range(size))
            near = {edited(rng, base, rng.randint(1, 12)) for _ in range(3)}
            lines |= {base, base[:4] + "\x1a" + base[4:], base[:3] + "\u2014" + base[4:], "\ufeff" + base, base[:-2] + "é" + base[-2:]} | near
    want = check_own_edits(spark, lines)
    latin = lambda x: max(x) < "\u0100"
    assert sum(latin(x) != latin(y) for x, y in want) > 20 and sum(x.isascii() != y.isascii() for x, y in want) > 20


def test_letters_of_the_halves_are_compared(spark, monkeypatch):
    stored, rows = line_dedup.written, {}

    def written(df, name, *rest):
        rows[name] = stored(df, name, *rest)
        return rows[name]

    monkeypatch.setattr(line_dedup, "written", written)
    words = "the quick brown foxes run along a riverside towards some distant hills "
    moved = words + "committee rooms " + words, words + words + "committee rooms "  # as many of each letter, 16 moved by half a line
    near = words * 2 + "one", words * 2 + "two"
    d = spark.createDataFrame([(x,) for x in moved + near], "line string")
    assert {(r["p"], r["t"]) for r in line_dedup.near_pairs(d).collect()} == {near}
    assert rows["line-candidates"].count() == 1  # both pairs share keys and letters; one goes on to the texts


def test_letter_codes(spark):
    d = spark.range(40).select(F.col("id").cast("int").alias("n"), F.expr("repeat('e', cast(id as int))").alias("l"))
    d = d.select("n", F.expr(line_dedup.code_sql("l", 0)).alias("c"))
    gaps = d.alias("x").crossJoin(d.alias("y")).selectExpr("abs(x.n - y.n) as apart", "bit_count(x.c ^ y.c) as got").collect()
    assert all(r["got"] == min(r["apart"] % 8, -r["apart"] % 8) for r in gaps)


def test_few_class_checks_name_every_class(spark):
    steps = line_dedup.thresholds(line_dedup.EDITS)
    line = spark.range(1, 700).select(F.col("id").alias("h"), F.col("id").cast("int").alias("size"),
                                      F.expr("cast(repeat('a', 700) as binary) as thin"))
    got = [r["v"] for part in range(line_dedup.PARTS) for r in line_dedup._looked(line, steps, part).collect()]
    size = lambda q: q >> max(0, q.bit_length() - 3) << max(0, q.bit_length() - 3)
    want = 0
    for n in range(1, 700):
        classes = {(k, size(m // (k + 1))) for m in range(max(1, n - 12), n + 1) if (k := allowed(m)) and n - m <= k}
        for k, q in classes:
            for i in range(1, k + 2):
                e = i if i <= (k + 2) // 2 else i - (k + 2) // 2
                a = max(1, min(math.ceil(math.sqrt(2 * e - 1)), q // line_dedup.APART))
                want += 1 + (e - 1) // a + (e + a - 2) // a
    assert len(got) == want


def test_lines_are_trimmed_at_both_ends(spark):
    rng = random.Random(13)
    lines = ["".join(rng.choice(" \t\x0b\x0c\ra\xa0é") for _ in range(rng.randint(0, 7))) for _ in range(300)]
    got = {r["line_no"]: r["line"] for r in line_dedup.lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id bigint, text string")).collect()}
    assert got == {k: y for k, x in enumerate(lines) if (y := x.strip(" \t\x0b\x0c\r"))}


def test_line_dedup(spark):
    a, b = "the same line with enough letters", "the same line with enuff letters"
    rows = [(1, f"{a}\nshort\n\n  {a}  \nother words that stand here alone"), (2, f"{b}\nshort\nshorx"), (None, a), (3, None), (4, ""),
            (5, a[:-1] + "z"), (0, "short")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, line string")
    got = {(r["doc_id"], r["line_no"]): r for r in line_dedup.line_dedup(d).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 3), (1, 4), (2, 0), (2, 1), (2, 2), (None, 0), (5, 0), (0, 0)}
    assert got[1, 0]["class_id"] == got[1, 3]["class_id"] == got[None, 0]["class_id"] == got[5, 0]["class_id"]
    assert got[1, 0]["copies"] == 3 and got[1, 0]["links"] == 1 + (distance(a, b) <= 2)
    assert got[2, 2]["class_id"] != got[2, 1]["class_id"] == got[1, 1]["class_id"] == got[0, 0]["class_id"]
    assert {k for k, r in got.items() if r["kept"]} >= {(1, 0), (0, 0), (2, 2), (1, 4)} and not got[None, 0]["kept"]
    assert line_dedup.line_dedup(d.limit(0)).count() == 0


def fits(h, p, rules):
    found = [(len(rh + rp), rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
    return max(found)[1:] if found else None


URLS = [None, "", "no scheme", "://x.com/a", "http://", "https://WWW.Example.com/en/1?q=/de/", "http://example.com/en/",
        "http://notexample.com/en/1", "http://a.net/es/2#://b.com/", "http://a.net?x://y/fr/", "ftp://net/fr/9", "http://É.com/É",
        "http://x.example.com/fr/1", "http://comx/", "http://b.org/en/1?a&&b=2&a=3", "http://b.org/en/1?a&&b=2&a=3"]


def test_url_rules(spark):
    rng = random.Random(5)
    urls = URLS + [f"http://{rng.choice(['m', 'www', 'x'])}.s{rng.randint(0, 3)}.{rng.choice(['com', 'net', 'org'])}/"
                   f"{rng.choice(['en', 'fr', 'es'])}/{rng.randint(0, 999)}" for _ in range(300)]
    d = spark.createDataFrame([(k % 310, u, "x") for k, u in enumerate(urls)], "page_id bigint, url string, host string")
    out = url_rules.filter_urls(d, URL_RULES)
    got = out.collect()
    assert len(got) == len(urls)
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    want = []
    for k, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        h, p = (low(m[1]), m[2]) if m else ("", "")
        r = fits(h, p, URL_RULES)
        want.append((k % 310, h, p, r and r[0], r and r[1]))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["host"], r["path"], r["rule"], r["rule"] and r["verdict"]))
                                            for r in got)
    assert all(r["verdict"] == "allow" for r in got if not r["host"])
    assert {r["verdict"] for r in got} == {"allow", "block"} and not PYTHON.search(plan(out))
    assert url_rules.filter_urls(d.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_rules.filter_urls(d, []).collect()} == {"allow"}


def test_mined_rules_and_match(spark):
    rng = random.Random(6)
    rows = [(sorted({f"h:{rng.choice('abcd')}", f"p:{rng.choice('xyz')}", f"q:{rng.choice('mn')}"}),) for _ in range(400)]
    rows = [(t, "block" if "h:a" in t and "p:x" in t or "q:m" in t and "h:b" in t else "allow") for t, in rows]
    d = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    rules = url_rules.mine(d, 0.01, 0.8).collect()
    for r in rules:
        has = [v for t, v in rows if set(r["antecedent"]) <= set(t)]
        assert abs(sum(v == r["verdict"] for v in has) / len(has) - r["confidence"]) < 1e-6 and r["confidence"] >= 0.8
        assert not any(set(s["antecedent"]) < set(r["antecedent"]) and s["verdict"] == r["verdict"] and
                       s["confidence"] >= r["confidence"] for s in rules)
    sets = d.select("tokens").distinct()
    got = {tuple(r["tokens"]): r["verdict"] for r in url_rules.match(sets, url_rules.mine(d, 0.01, 0.8)).collect()}
    for t in {tuple(t) for t, _ in rows}:
        fit = [r for r in rules if set(r["antecedent"]) <= set(t)]
        best = max(fit, key=lambda r: (r["confidence"], r["support"], r["n"], r["rule_id"]))["verdict"] if fit else None
        assert got.get(t) == best


def test_plans_of_the_native_queries(spark, sf_small):
    from gridwright.llm import queries
    for name in ("op5_decontamination", "op6_url_filter", "op8_line_dedup", "op9_license_scan"):
        assert not PYTHON.search(plan(queries.QUERIES[name](spark, sf_small))), name


def test_urls_with_many_parts_end(spark):
    long = [f"http://a.com/{'/'.join(f'part{chr(97 + k % 26)}{chr(97 + k // 26)}' for k in range(n))}" for n in (7, 40, 40)]
    long[2] += "/tail?q=1"
    d = spark.createDataFrame(list(enumerate(long)) + [(9, "http://a.org/partaa/x")], "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.filter_urls(d, [("block", "a.com", "/")]).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 9: "block"}  # "partaa" and host part "a" stand in blocked urls only


def brute_rules(rows, support, confidence):
    """Every token set above the limits that no part of it makes needless."""
    least = max(support * len(rows), 2)
    found = {}
    for t, _ in rows:
        for n in range(1, len(t) + 1):
            for part in itertools.combinations(t, n):
                if part not in found:
                    has = [v for u, v in rows if set(part) <= set(u)]
                    found[part] = {v: (c, len(has)) for v, c in Counter(has).items() if c >= least and c / len(has) >= confidence}
    return {(p, v) for p, by in found.items() for v, (c, n) in by.items()
            if not any(set(q) < set(p) and v in found[q] and found[q][v][0] / found[q][v][1] >= c / n for q in found)}


def test_all_rules_are_found(spark):
    rng = random.Random(8)
    rows = [(sorted({f"h:{rng.choice('ab')}", f"p:{rng.choice('uvwxyz')}", f"p:{rng.choice('uvwxyz')}", f"q:{rng.choice('klmn')}"}),
             rng.choice(["allow", "block", "block"])) for _ in range(60)]
    d = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(r["antecedent"]), r["verdict"]) for r in url_rules.mine(d, 0.01, 0.8).collect()}
    assert got == brute_rules(rows, 0.01, 0.8) and len(got) > 5
    same = spark.createDataFrame([(["a", "b", "c"], "x"), (["a", "b", "d"], "x"), (["c", "e", "f"], "y")], "tokens array<string>, verdict string")
    assert {r["token"]: r["like"] for r in url_rules.alike(same).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "e"}
