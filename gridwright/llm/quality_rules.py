"""Quality rules, SQL functions only: a threshold table compiled into one
projection.

A row of the table limits one ratio of two measures of a text, in thousandths:
``(name, measure, per measure, least, most)``. The measures are expressions
over the text; each rule becomes one comparison of integers
(``1000 * measure < least * per``), so no rounding decides. Everything is
computed row by row: no shuffle, no user function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 5          # words of a window that may repeat
MIN_WORDS = 10
MAX_REPEATED = 20   # percent of the words that may lie in repeated windows

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which",
    "fr": "le la les de des du un une et à en est que qui dans pour pas par sur au aux plus ce se ne avec il elle son sa",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an er aus bei nach wird",
    "es": "el la los las de y en que un una por con no se del al lo es para su como más pero sus le ya o este sí porque",
}

#: name, measure, per measure, least and most in thousandths (None: no limit)
THRESHOLDS = (
    ("word length", "word_chars", "n_words", 2_000, 20_000),
    ("symbols", "n_symbols", "n_words", None, 300),
    ("words with letters", "n_letter_words", "n_words", 600, None),
    ("stop words", "n_stop_words", "n_words", 10, None),
    ("repeated lines", "n_dup_lines", "n_lines", None, 500),
    ("bullet lines", "n_bullet_lines", "n_lines", None, 900),
    ("ellipsis lines", "n_ellipsis_lines", "n_lines", None, 300),
)

_SPACE = r"\\x20\\x09-\\x0D"  # inside an SQL text


def _bind(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeated_words_sql(w: str, window: int = WINDOW) -> str:
    """SQL: how many words of the list ``w`` lie in a run of ``window`` words
    found twice or more in it.

    Hashes of the windows decide most texts: all different means no repeat.
    Otherwise the windows are sorted as text with their place behind them, so
    that equal ones are neighbours; words hold no space, so a common start up
    to the fifth space means equal windows. The places found, in order, cover
    ``window`` words each, or as many as lie before the next place."""
    items = ", ".join(f"get({w}, i + {k})" for k in range(window))
    places = f"sequence(0, size({w}) - {window})"
    text = f"concat_ws(' ', {items}, cast(i as string))"
    start = f"substring_index(x, ' ', {window})"
    found = (f"filter(transform(sequence(0, size(k) - 1), j -> if(get(k, j) <=> get(k, j - 1) or get(k, j) <=> get(k, j + 1), "
             f"cast(substring_index(get(s, j), ' ', -1) as int), null)), x -> x is not null)")
    cover = f"{window} + aggregate(sequence(0, size(p) - 1), 0, (n, j) -> n + least({window}, coalesce(get(p, j + 1) - get(p, j), 0)))"
    covered = _bind(f"sort_array({found})", "p", f"if(size(p) = 0, 0, {cover})")
    exact = _bind(f"sort_array(transform({places}, i -> {text}))", "s", _bind(f"transform(s, x -> {start})", "k", covered))
    hashes = f"transform({places}, i -> xxhash64({items}))"
    return (f"if(size({w}) <= {window}, 0, "
            + _bind(hashes, "h", f"if(size(array_distinct(h)) = size(h), 0, {exact})") + ")")


def measures_sql(text: str, window: int = WINDOW) -> str:
    """SQL: struct of all measures of ``text``."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
    of_words = (f"struct(size(w) as n_words, length(array_join(w, '')) as word_chars, {repeated_words_sql('w', window)} as n_repeat_words, "
                f"size(filter(w, x -> lower(x) in ({stop}))) as n_stop_words, "
                f"size(filter(w, x -> x rlike '\\\\p{{L}}')) as n_letter_words)")
    split = f"if(t = '', array(), split(t, '[{_SPACE}]+'))"
    trimmed = "trim(both ' \\t\\n\\u000B\\u000C\\r' from x)"
    words = _bind(trimmed, "t", _bind(split, "w", of_words))
    lines = _bind(f"filter(split(x, '\\n'), y -> y rlike '[^{_SPACE}]')", "y",
                  f"struct(size(y) as n_lines, size(y) - size(array_distinct(y)) as n_dup_lines, "
                  f"size(filter(y, z -> z rlike '^[{_SPACE}]*[-*\\u2022]')) as n_bullet_lines, "
                  f"size(filter(y, z -> z rlike '(\\\\.\\\\.\\\\.|\\u2026)[{_SPACE}]*$')) as n_ellipsis_lines)")
    symbols = "length(x) - length(regexp_replace(x, '[#*$%&|<>]+', ''))"
    return _bind(f"coalesce({text}, '')", "x", f"struct({symbols} as n_symbols, {words} as w, {lines} as l)")


def quality(docs: DataFrame, thresholds=THRESHOLDS, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED,
            window: int = WINDOW) -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``failed`` (names of the
    rules of ``thresholds`` that fail, in order) and ``kept`` for every row.

    Null text counts as empty; an empty text has no word, fails the base and no
    rule of the table. Repeated rows and rows with one id are judged each for
    itself, ties of a limit pass; texts of any length are read whole; an empty
    table gives an empty result; other columns are ignored."""
    counted = docs.select("doc_id", F.expr(measures_sql("text", window)).alias("m"))
    parts = {"w": ("n_words", "word_chars", "n_repeat_words", "n_stop_words", "n_letter_words"),
             "l": ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")}
    flat = counted.select("doc_id", F.col("m.n_symbols").cast("bigint").alias("n_symbols"),
                          *[F.col(f"m.{p}.{n}").cast("bigint").alias(n) for p, names in parts.items() for n in names])
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    fails = []
    for name, measure, per, least, most in thresholds:
        low = F.lit(False) if least is None else 1000 * F.col(measure) < least * F.col(per)
        high = F.lit(False) if most is None else 1000 * F.col(measure) > most * F.col(per)
        fails.append(F.when(low | high, F.lit(name)))
    return (flat.withColumn("base_failed", base).withColumn("failed", F.array_compact(F.array(*fails)))
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)))
