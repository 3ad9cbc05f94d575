"""BPE encoding and decoding with a public vocabulary, whole texts.

Text between white space is encoded once per distinct run and worker (no
token of this kind of vocabulary spans white space). Long text takes the
tree: it is halved until pieces are at most ``leaf_chars`` long, the pieces are
encoded as rows of their own, in parallel, and neighbours are joined level by
level, ``FAN`` parts a task. A cut may fall anywhere, so around each join a window is encoded again
and grown until it shows ``AGREE`` tokens in a row that are the same tokens,
at the same places, as in the left side, and the same for the right side; the
join then takes left tokens, window tokens, right tokens. If the window has
grown over both sides it is the answer itself.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import written

LEAF_CHARS = 65_536
FAN = 8  # parts of a text that one task joins, pair by pair, before the next level
WINDOW = 64
AGREE = 3
# Runs and pieces held per worker, and their length; a full cache keeps what it has, so a worker holds some 70 MB.
RUNS, PARTS, LONGEST = 100_000, 250_000, 200
_RUN = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # str.split() splits there too
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@\\[-`{-~]*)")
# The byte alphabet of byte-level vocabularies, by its rule: printable Latin-1 stands for itself, the other bytes
# for the characters from 256 on, in order.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTES = {b: 256 + k for k, b in enumerate(_OTHERS)}
_loaded: dict = {}


class Codec:
    """A tokenizers file with a cache of encoded runs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.cache: dict[str, bytes] = {}  # 32-bit ids of runs
        self.parts: dict[str, bytes] = {}  # and of the pieces that runs are split into
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.pieces = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.pieces[i] = t
        # text can be taken run by run when white space leaves no trace in the tokens
        specials = self.tok.get_added_tokens_decoder().values()
        self.specials = [t.content for t in specials]
        apart = self.tok.encode("x", add_special_tokens=False).ids + self.tok.encode("y", add_special_tokens=False).ids
        self.by_runs = (self.tok.normalizer is not None and self.tok.pre_tokenizer is not None and self.tok.post_processor is None
                        and all(_RUN.fullmatch(t.content) and not t.lstrip and not t.rstrip for t in specials) and all(
            self.tok.encode(f" x{gap}y{gap}", add_special_tokens=False).ids == apart for gap in (" ", "  ", "\n", "\t \r\x0b\x0c")))

        # and a plain word takes a short way when the file's normaliser and splitter treat letters as that way does
        probe = "AÀÖØÞßzöøÿ"
        self.plain = self.by_runs and all(
            [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(probe + stop))]
            == [probe.lower().encode().decode("latin-1").translate(_BYTES)] + [stop] * bool(stop) for stop in ("", ".", ",", "###", "?!)", '"', "|", "_-"))

    def spans(self, text: str, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in the text each token begins and ends, ``at`` added."""
        e = self.tok.encode(text, add_special_tokens=False)
        places = np.array(e.offsets, np.int32).reshape(-1, 2) + np.int32(at)
        return np.array(e.ids, np.int32), places[:, 0], places[:, 1]

    def ids(self, text: str) -> np.ndarray:
        if not self.by_runs:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int32)
        runs = _RUN.findall(text) if _OTHER_SPACE.search(text) else text.split()
        cache = self.cache
        return np.frombuffer(b"".join([cache[r] if r in cache else self.run(r) for r in runs]), np.int32)

    def run(self, run: str) -> bytes:
        """Ids of one run: the file's normaliser and splitter, then its merges
        on each piece that is new. A run that may hold a special token goes
        through the whole tokenizer."""
        if any(s in run for s in self.specials):
            return np.array(self.tok.encode(run, add_special_tokens=False).ids, np.int32).tobytes()
        plain = _PLAIN.fullmatch(run) if self.plain else None
        if plain:  # letters that have one lower case and are stable under NFC, then ASCII signs
            pieces = [plain[1].lower().encode().decode("latin-1").translate(_BYTES)] + [plain[2]] * bool(plain[2])
        else:
            pieces = [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(run))]
        found = []
        for piece in pieces:
            ids = self.parts.get(piece)
            if ids is None:
                ids = array("i", [t.id for t in self.tok.model.tokenize(piece)]).tobytes()
                if len(self.parts) < PARTS and len(piece) <= LONGEST:
                    self.parts[piece] = ids
            found.append(ids)
        all_ids = b"".join(found)
        if len(self.cache) < RUNS and len(run) <= LONGEST:
            self.cache[run] = all_ids
        return all_ids

    def decode(self, ids: np.ndarray) -> str:
        if self.tok.decoder is not None:
            return self.tok.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.pieces.__getitem__, ids.tolist()))  # without a decoder: the tokens, joined by one space

    def join(self, text: str, cut: int, left: tuple, right: tuple) -> tuple:
        """Tokens of ``text`` from those of its parts before and after ``cut``
        (ids, begins and ends, places counted in ``text``). A window begins
        and ends at token ends of the two sides; only tokens it covers are
        compared."""
        size, n = WINDOW, len(right[0])
        while True:
            i = max(0, int(np.searchsorted(left[1], cut - size, "right")) - 1)
            j = min(n, int(np.searchsorted(right[2], cut + size, "left")) + 1)
            a = int(left[1][i]) if i > 0 else 0
            b = int(right[2][j - 1]) if j < n else len(text)
            w = self.spans(text[a:b], a)
            x = (0, 0) if a == 0 else _meet([p[i:] for p in left], w, lambda t: t[2] < cut, False)
            y = (len(w[0]), n) if b == len(text) else _meet(w, [p[:j] for p in right], lambda t: t[1] > cut, True)
            if x and y:
                keep = 0 if a == 0 else i + x[0]
                return tuple(np.concatenate([p[:keep], q[x[1]:y[0]], r[y[1]:]]) for p, q, r in zip(left, w, right))
            size *= 2


def _meet(x, y, inside, behind: bool) -> tuple[int, int] | None:
    """Indices (in x, in y) of a place where both show the same ``AGREE``
    tokens in a row, all ``inside``: before the first such run, or behind
    the last one."""
    at = {t: k for k, t in enumerate(zip(*(p.tolist() for p in y))) if inside(t)}
    run, prev, found = 0, None, None
    for k, t in enumerate(zip(*(p.tolist() for p in x))):
        m = at.get(t)
        run = 0 if m is None else run + 1 if run and m == prev + 1 else 1
        prev = m
        if run >= AGREE:
            if not behind:
                return k + 1 - run, m + 1 - run
            found = k + 1, m + 1
    return found


def halves(n: int, leaf: int) -> list[tuple[int, int]]:
    """Places of the leaves when ``n`` characters are halved down to ``leaf``."""
    out, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            out.append((a, b))
        else:
            m = (a + b) // 2
            todo += [(m, b), (a, m)]
    return out


def concatenate(codec: Codec, parts: list[tuple[str, tuple]]) -> tuple[str, tuple]:
    """Joins neighbours ``(text, (ids, begins, ends))`` pairwise, level by
    level; places are counted from the begin of each part."""
    while len(parts) > 1:
        up = []
        for k in range(0, len(parts) - 1, 2):
            (s, x), (t, (ids, begins, ends)) = parts[k], parts[k + 1]
            at = np.int32(len(s))
            up.append((s + t, codec.join(s + t, len(s), x, (ids, begins + at, ends + at))))
        parts = up + parts[len(parts) - len(parts) % 2:]
    return parts[0]


def codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


_OUT = "doc_id bigint, ids array<int>, decoded string"


def _short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for k in range(0, b.num_rows, 64):  # what is held and goes back at once stays small
                ids = [c.ids(t or "") for t in b.column(1).slice(k, 64).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(k, 64), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                     pa.array([c.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])
    return run


def _cut(leaf_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                for k, (p, q) in enumerate(halves(len(text), leaf_chars)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.int64()), pa.array([doc_id], pa.int64()), pa.array([k], pa.int32()),
                         pa.array([text[p:q]], pa.string())], names=["row", "doc_id", "part", "piece"])
    return run


_PART = "row bigint, doc_id bigint, part int, piece string, ids binary, begins binary, ends binary"


def _leaf(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for k in range(b.num_rows):
                coded = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in c.spans(b.column(3)[k].as_py())]
                yield pa.RecordBatch.from_arrays([x.slice(k, 1) for x in b.columns] + coded,
                                                 names=["row", "doc_id", "part", "piece", "ids", "begins", "ends"])
    return run


def _joined(path: str):
    def run(parts):
        import pandas as pd
        d = parts.sort_values("part")
        text, coded = concatenate(codec(path), [(t, tuple(np.frombuffer(x, np.int32) for x in xs))
                                                for t, *xs in zip(d["piece"], d["ids"], d["begins"], d["ends"])])
        ids, begins, ends = (np.ascontiguousarray(x).tobytes() for x in coded)
        return pd.DataFrame({"row": d["row"].iloc[:1], "doc_id": d["doc_id"].iloc[:1], "part": d["part"].iloc[:1] // FAN,
                             "piece": [text], "ids": [ids], "begins": [begins], "ends": [ends]})
    return run


def _whole(path: str):
    """The last join of a text and what its ids decode to, in one Python
    worker: a step behind it would hold a second one with a codec of its own."""
    joined = _joined(path)

    def run(parts):
        import pandas as pd
        d = joined(parts)
        ids = np.frombuffer(d["ids"].iloc[0], np.int32)
        return pd.DataFrame({"doc_id": d["doc_id"], "ids": [ids], "decoded": [codec(path).decode(ids)]})
    return run


def encode(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``doc_id, ids, decoded`` for every row: the ids of the whole text (no
    special tokens added, no truncation or padding) and the text they decode
    to. ``path`` must name a file that every executor has.

    Null text counts as empty: no ids, decoded text empty. Repeated rows give
    repeated results, rows with one doc_id a result each; an empty table gives an empty one; other columns are
    ignored. The strings of special tokens in a text become these tokens, as
    the tokenizers library does by default."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = F.length(F.coalesce(F.col("text"), F.lit("")))
    short = d.filter(size <= leaf_chars).mapInArrow(_short(path), _OUT)
    # written before they are dealt out: a row's number must stay the same if a task runs again
    leaves = written(d.filter(size > leaf_chars).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
                     .mapInArrow(_cut(leaf_chars), "row bigint, doc_id bigint, part int, piece string"), "bpe-leaves")
    last = leaves.agg(F.max("part")).first()[0]
    if last is None:
        return short
    parts = leaves.repartition("row", "part").mapInArrow(_leaf(path), _PART)
    while last:
        last //= FAN
        level = parts.groupBy("row", F.expr(f"part div {FAN}").alias("up"))
        parts = level.applyInPandas(_joined(path), _PART) if last else level.applyInPandas(_whole(path), _OUT)
    return short.unionByName(parts)


def digests(coded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode``'s rows."""
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
