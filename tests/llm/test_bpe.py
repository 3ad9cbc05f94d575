"""BPE by tree concatenation: always the ids of the whole-text encoding."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridwright.llm import bpe
from gridwright.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
PIECES = list("abcdeé'!? \n\tſİßñ́あ😀12") + ["<|endoftext|>", "'re", "'s", "the ", "tion", "\x85", "\xa0"]


def texts():
    rng = random.Random(1)
    out = [None, "", " ", "\n\t ", "a" * 3000, "!" * 2500, "the" * 1200, "ab" * 900 + "!" * 900 + "xyz" * 400, "<|endoftext|>" * 200]
    out += ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 700))) for _ in range(60)]
    out += ["".join(rng.choice("abc thein") for _ in range(1500)) for _ in range(10)]
    return out


@pytest.mark.parametrize("leaf", [30, 400])
def test_tree_is_exact(leaf):
    c = bpe.Codec(PATH)
    for t in texts():
        t = t or ""
        want = c.tok.encode(t, add_special_tokens=False).ids
        assert list(c.ids(t)) == want
        cuts = bpe.halves(len(t), leaf)
        assert [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and cuts[0][0] == 0 and cuts[-1][1] == len(t)
        whole, (ids, begins, ends) = bpe.concatenate(c, [(t[a:b], c.spans(t[a:b])) for a, b in cuts])
        assert whole == t and ids.tolist() == want
        assert list(zip(begins.tolist(), ends.tolist())) == c.tok.encode(t, add_special_tokens=False).offsets
        assert c.decode(np.array(want, np.int32)) == c.tok.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encode(spark, name):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(None, "no id", "x"), (4, "a" * 3000, "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    tok = Tokenizer.from_file(vocabulary(name))
    for leaf in (20, 200, bpe.LEAF_CHARS):  # three levels of tasks, two, none
        got = bpe.encode(d, vocabulary(name), leaf)
        want = sorted((str(i), tok.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
        assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got.collect()) == want
    for r in bpe.digests(got).collect():
        e = next(ids for i, ids in want if i == str(r["doc_id"]))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(e), sha(" ".join(map(str, e))), sha(tok.decode(e, skip_special_tokens=False)))
    assert bpe.encode(d.limit(0), vocabulary(name)).count() == 0


def test_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "RUNS", 3)
    monkeypatch.setattr(bpe, "PARTS", 2)
    c = bpe.Codec(PATH)
    for t in ("one two three four", "five six", "one seven two", "one two three four"):
        assert list(c.ids(t)) == c.tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_letter_of_the_short_way(name):
    c, rng = bpe.Codec(vocabulary(name)), random.Random(4)
    letters = [chr(k) for k in range(0x250) if bpe._PLAIN.fullmatch(chr(k))]
    signs = [chr(k) for k in range(33, 127) if not chr(k).isalnum()]
    words = letters + [a + b for a in letters for b in rng.sample(letters, 8)]
    words += ["".join(rng.choices(letters, k=rng.randint(1, 9)) + rng.choices(signs, k=rng.randint(0, 3))) for _ in range(3000)]
    for w in words:
        assert c.ids(w).tolist() == c.tok.encode(w, add_special_tokens=False).ids, w


def test_join_looks_only_near_the_cut():
    c = bpe.Codec(PATH)
    half = "some words of a text, repeated. " * 40_000
    x, y = (half, c.spans(half)), (half[7:], c.spans(half[7:]))
    seen = []
    spans, c.spans = c.spans, lambda t, at=0: seen.append(len(t)) or spans(t, at)
    text, (ids, _, _) = bpe.concatenate(c, [x, y])
    assert sum(seen) < 2000 and ids.tolist() == c.tok.encode(text, add_special_tokens=False).ids


def test_a_task_holds_one_codec(spark):
    d = spark.createDataFrame([(1, "some words of a text " * 40), (2, "short")], "doc_id bigint, text string")
    got = bpe.encode(d, PATH, 100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 2 and plan.count("MapInArrow") == 2  # short texts and leaves; the last join decodes
    tok = Tokenizer.from_file(PATH)
    for r in got.collect():
        ids = tok.encode({1: "some words of a text " * 40, 2: "short"}[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == tok.decode(ids, skip_special_tokens=False)
