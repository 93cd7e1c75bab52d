"""Quality rules (operator 1) by weak supervision.

Eight rules look at each whole text and vote good (1), bad (0) or abstain (2). A
text's votes are one number in base 3, so the corpus is summed up by at most 3^8
counts, whatever its size. Expectation-maximisation on these counts estimates the
share of good texts and each rule's accuracy on either kind; the posterior
probability of every vote pattern then decides, in place of all rules having to pass.

Defined results: null and empty texts have no words, fail the base rule and are not
kept, and take no part in the estimates; texts of any length are read whole; equal
texts get equal results; an empty table gives an empty result; with no text that
passes the base rule the prior estimates hold; further columns of any name are
carried by ``kept_rows``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, materialise, own, read, tidied

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
BAD, GOOD, ABSTAIN = 0, 1, 2
RULES = ("symbols", "capitals", "repeats", "lines", "exclamations", "lengths", "stop_words", "letters")
#: Common short words of the corpus' languages (fixed values).
STOP_WORDS = frozenset(
    word.encode()
    for word in (
        "the of and to in is that it for was on are as with his be at by this or from an "
        "de la le les des et un une du en que qui dans pour par sur au ne se ce "
        "der die das und ist von zu den mit sich auf für nicht dem ein eine auch "
        "el los las y del su con al lo como más pero sus"
    ).split()
)
#: (bad from, good up to) of a rule's measure; between them it abstains. Rules that want much of something have them the other way round.
LIMITS = {"symbols": (0.2, 0.02), "capitals": (0.6, 0.3), "repeats": (0.10, 0.02), "lines": (0.3, 0.0), "exclamations": (0.3, 0.05), "stop_words": (0.005, 0.05), "letters": (0.6, 0.75)}
#: Estimates before any text is seen, and how many texts they count for.
PRIOR_GOOD, PRIOR_ACCURACY, PRIOR_TEXTS = 0.8, 0.85, 20.0
LEAST_ACCURACY, ROUNDS = 0.02, 200
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    times = Counter(grams)
    total = end = 0
    for i, gram in enumerate(grams):
        if times[gram] > 1:
            total += i + window - max(i, end)
            end = i + window
    return total


def measure(text: str) -> tuple[list[int], int, bool]:
    """The base features, the votes as a number, and whether the base rule fails."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACE_CHARS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    lines = dup_lines = 0
    for line in text.split("\n"):
        if line.strip(SPACE_CHARS):
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    return [n, chars, symbols, dup_lines, repeats], _votes(text, words, chars, symbols, dup_lines / max(1, lines), repeats), failed


def _votes(text: str, words: list[bytes], chars: int, symbols: int, dup_share: float, repeats: int) -> int:
    n = max(1, len(words))
    upper, letters = _letters(text)
    length = chars / n
    vote = {
        "symbols": _low(symbols / n, "symbols"),
        "capitals": _low(upper / max(1, letters), "capitals"),
        "repeats": _low(repeats / n, "repeats"),
        "lines": _low(dup_share, "lines"),
        "exclamations": _low(text.count("!") / n, "exclamations"),
        "lengths": GOOD if 3 <= length <= 10 else BAD if length < 2 or length > 20 else ABSTAIN,
        "stop_words": ABSTAIN if n < 20 else _high(sum(w in STOP_WORDS for w in words) / n, "stop_words"),
        "letters": _high(letters / max(1, chars), "letters"),
    }
    return sum(vote[rule] * 3**i for i, rule in enumerate(RULES))


def _low(x: float, rule: str) -> int:
    bad, good = LIMITS[rule]
    return GOOD if x <= good else BAD if x >= bad else ABSTAIN


def _high(x: float, rule: str) -> int:
    bad, good = LIMITS[rule]
    return GOOD if x >= good else BAD if x <= bad else ABSTAIN


def _letters(text: str) -> tuple[int, int]:
    """Upper-case letters and all letters."""
    if text.isascii():
        codes = np.frombuffer(text.encode(), np.uint8)
        upper = int(((codes >= 65) & (codes <= 90)).sum())
        return upper, upper + int(((codes >= 97) & (codes <= 122)).sum())
    lower, up = text.lower(), text.upper()
    if len(lower) == len(up) == len(text):
        t, l, u = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (text, lower, up))
        cased = l != u
        return int((cased & (t != l)).sum()), int(cased.sum()) + sum(c.isalpha() and c.lower() == c.upper() for c in set(text) if ord(c) > 0x2AF)
    return sum(c.isupper() for c in text), sum(c.isalpha() for c in text)


def posteriors(counts: dict[int, int]) -> dict[int, float]:
    """Posterior probability of good for each vote pattern, by expectation-maximisation on the patterns' counts."""
    patterns = sorted(counts)
    if not patterns:
        return {}
    votes = np.array([[p // 3**i % 3 for i in range(len(RULES))] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    said_good, said_bad = (votes == GOOD).astype(float), (votes == BAD).astype(float)
    good, right_good, right_bad = PRIOR_GOOD, np.full(len(RULES), PRIOR_ACCURACY), np.full(len(RULES), PRIOR_ACCURACY)
    q = np.zeros(len(patterns))
    for _ in range(ROUNDS):
        as_good = np.log(good) + said_good @ np.log(right_good) + said_bad @ np.log(1 - right_good)
        as_bad = np.log(1 - good) + said_bad @ np.log(right_bad) + said_good @ np.log(1 - right_bad)
        before, q = q, 1 / (1 + np.exp(np.clip(as_bad - as_good, -700, 700)))
        if np.abs(q - before).max() < 1e-9:
            break
        w, v = n * q, n * (1 - q)
        good = float(np.clip((w.sum() + PRIOR_TEXTS * PRIOR_GOOD) / (n.sum() + PRIOR_TEXTS), 0.05, 0.99))
        right_good = ((w @ said_good) + PRIOR_TEXTS * PRIOR_ACCURACY) / (w @ (said_good + said_bad) + PRIOR_TEXTS)
        right_bad = ((v @ said_bad) + PRIOR_TEXTS * PRIOR_ACCURACY) / (v @ (said_good + said_bad) + PRIOR_TEXTS)
        right_good, right_bad = (np.clip(x, LEAST_ACCURACY, 0.995) for x in (right_good, right_bad))
    return dict(zip(patterns, q.tolist(), strict=True))


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in FEATURES] + [T.StructField("base_failed", T.BooleanType()), T.StructField(own("pattern"), T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(x.as_py() or "") for x in batch.column(1)]
            columns = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([f[2] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.int32())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)


def _pattern_counts(rows: DataFrame) -> dict[int, int]:
    return {p: n for p, n in rows.where(~F.col("base_failed")).groupBy(own("pattern")).count().collect()}


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the base features, base_failed, p_good and kept."""
    rows = materialise(measured(docs, id_col, text_col), "quality")
    table = list(posteriors(_pattern_counts(rows)).items())
    known = docs.sparkSession.createDataFrame(table, f"{own('pattern')} int, p_good double")
    out = rows.join(F.broadcast(known), own("pattern"), "left")  # 3^8 rows at most
    return out.select(id_col, *FEATURES, "base_failed", "p_good", (~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= 0.5)).alias("kept"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with docs' columns. Texts are read twice and never moved or stored."""
    table = posteriors(_pattern_counts(measured(docs, id_col, text_col)))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(x.as_py() or "") for x in batch.column(at)]
            yield batch.filter(pa.array([not failed and table.get(pattern, 0.0) >= 0.5 for _, pattern, failed in found], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES: dict[str, str] = {}
