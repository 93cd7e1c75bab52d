"""Phrase collocation mining (operator 12): candidates from sketches, counted by automata.

Texts are lower-cased (A-Z) and cut into pieces at PIECE_ENDS, pieces into words. A
phrase is 2 to LONGEST neighbouring words of a piece. Everything is by language.

1. Sketches. A count-min sketch of one wide row an order (number of words) bounds every
   phrase's count from above: occurrences are counted by hash in CELLS cells. Tasks count
   chunks of text and send the cells they met in blocks; a block's counts are added as
   they stream through one task and kept as one bit a cell, whether the sum reaches the
   least count. The first pass has words and pairs, the second the longer phrases whose
   pairs all reach it.
2. Candidates of a chunk are its phrases that reach the least count by all sketches, so
   every phrase that has it in the corpus is a candidate in each chunk where it occurs.
3. The candidates of a chunk compile into an Aho-Corasick automaton of phrases between
   spaces, which counts all occurrences in the chunk, overlapping ones too. A chunk's
   matches must be as many as the places its candidates came from; were two phrases of
   one 64-bit hash, they would not be, and candidates are then taken by their texts.
4. Counts are summed over chunks, and thresholds applied to the sums. A task sends its
   phrases packed in BLOCKS blocks a language by their hash, as phrases that are rare in
   the corpus are sent by nearly every task they occur in and rows of their own would be
   most of the cost; blocks are sorted, and a task adds up one block at a time.

So memory is bounded by a chunk and the sketches' bits (CELLS / 8 bytes an order, which
is what is broadcast), work is linear in the texts at any size, and results are exact
whatever the sketches do: a corpus that fills CELLS makes more candidates only.

A cut of a candidate into its first k words (l times) and the rest (r times) scores
floor(1000 a n / (l r)), in decimals of 38 digits; the least score counts, the smallest
k among equal ones. A candidate goes if a longer one has it inside and occurs as often;
as counts only fall along longer phrases, those one word longer tell.

Defined results: a null text counts as empty, a null language as "und"; a language
without phrases has no rows; equal texts count each; phrases that tie on score and
count stand by their UTF-8 bytes; very long texts are cut at ends of pieces, a piece is
never cut; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, read, temporary, tidied

LONGEST = 5
LEAST = 100
TOP = 2000
#: A longer phrase that occurs as often as so many hundredths of a candidate's count hides it.
HIDES = 100
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
#: Cells of a sketch, and of a block of it.
CELL_BITS, BLOCK_BITS = 25, 16
#: Bytes of text that are searched at once; phrases that a task holds before it sends their counts; salts of a language's ranking.
CHUNK = 8 << 20
HELD = 300_000
SALTS = 64
#: Blocks of a language's phrases, of which a task adds up one at a time.
BLOCKS = 512

#: A-Z to lower case, ends of pieces to line feeds, tabs to spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in PIECE_ENDS else 32 if c == 9 else c for c in range(256))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def normal(text: str) -> bytes:
    """The words between single spaces, with a line feed between spaces where a piece ends."""
    found = text.encode("utf-8", "replace").translate(_TABLE).replace(b"\n", b" \n ")
    return b" " + b" ".join(w for w in found.split(b" ") if w) + b" " if b"  " in found else b" " + found.strip(b" ") + b" "


def _parts(data: bytes, size: int) -> Iterator[bytes]:
    """A normal text in parts of about size bytes, cut at ends of pieces."""
    start = 0
    while len(data) - start > size:
        cut = data.find(b" \n ", start + size)
        if cut < 0:
            break
        yield data[start : cut + 1]
        start = cut + 2
    yield data[start:]


def chunks(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[tuple[str, bytes]]:
    """(language, normal texts with piece ends between) of about size bytes in all languages; columns are text and language."""
    size = size or CHUNK
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            for part in _parts(normal(text.as_py() or ""), size):
                if part.strip(b" \n"):
                    held.setdefault("und" if (name := lang.as_py()) is None else name, []).append(part)
                    total += len(part)
                if total >= size:
                    yield from ((name, b"\n".join(texts)) for name, texts in held.items())
                    held, total = {}, 0
    yield from ((name, b"\n".join(texts)) for name, texts in held.items())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a chunk: where they start and end, their pieces, and hashes of the phrases that begin with each."""

    def __init__(self, lang: str, data: bytes) -> None:
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        gap = (raw == 32) | (raw == 10)
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(raw == 10), self.starts)
        seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        eights = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))
        long = self.ends - self.starts
        h = _mixed(long.astype(np.uint64) ^ seed)
        at = np.arange(len(long))
        for k in range(0, int(long.max(initial=0)), 8):
            at = at[long[at] > k]
            left = np.minimum(long[at] - k, 8).astype(np.uint64)
            # Bytes beyond the word are shifted out.
            eight = eights[self.starts[at] + k] << (np.uint64(64) - np.uint64(8) * left)
            h[at] = _mixed(h[at] * _MIX[1] + eight)
        self.hashes = [h]

    def __len__(self) -> int:
        return len(self.starts)

    def hash(self, order: int) -> np.ndarray:
        """Of the phrase of so many words from each word on; the last ones have none."""
        while len(self.hashes) < order:
            before = self.hashes[-1]
            m = len(self.hashes)
            self.hashes.append(_mixed(before[:-1] * _MIX[0] + self.hashes[0][m : m + max(0, len(before) - 1)]) if len(before) else before)
        return self.hashes[order - 1]

    def whole(self, order: int) -> np.ndarray:
        """Whether the phrase from each word on lies within a piece."""
        n = max(0, len(self) - order + 1)
        return self.piece[:n] == self.piece[order - 1 : order - 1 + n]

    def phrase(self, at: int, order: int) -> bytes:
        """With the spaces around it."""
        return self.data[self.starts[at] - 1 : self.ends[at + order - 1] + 1]


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Bounds:
    """One bit a cell for each order that was counted: whether the least count may be reached."""

    def __init__(self, bits: dict[int, bytes]) -> None:
        self.bits = {order: np.frombuffer(b, np.uint8) for order, b in bits.items()}

    def reach(self, h: np.ndarray, order: int) -> np.ndarray:
        cells = _cells(h)
        return (self.bits[order][cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)

    def candidates(self, words: Words, orders: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each order up to orders whether the phrase from each word on may reach the least count: by its own sketch, if there is one, and its parts'."""
        before = None
        for order in range(1, orders + 1):
            ok = words.whole(order)
            if before is not None:
                n = len(ok)
                ok = ok & before[:n] & before[1 : n + 1]
            if order in self.bits:
                ok = ok & self.reach(words.hash(order), order)
            yield order, ok
            before = ok


def _sketch(docs: DataFrame, orders: range, known: dict[int, bytes], least: int) -> dict[int, bytes]:
    """For each order the bits of its cells whose sum reaches least."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)
    limit = min(least, 127)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(shared.value)
        for lang, data in chunks(batches):
            words = Words(lang, data)
            kept = dict(bounds.candidates(words, orders[-1])) if known else {order: words.whole(order) for order in orders}
            for order in orders:
                cells, n = np.unique(_cells(words.hash(order)[kept[order]]), return_counts=True)
                block = cells >> BLOCK_BITS
                cuts = np.flatnonzero(np.diff(block)) + 1
                offsets, sums = (cells & ((1 << BLOCK_BITS) - 1)).astype(np.uint16), np.minimum(n, limit).astype(np.uint8)
                begins = np.concatenate([[0], cuts]) if len(cells) else cuts
                stops = np.concatenate([cuts, [len(cells)]]) if len(cells) else cuts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(begins), order, np.int32)), pa.array(block[begins].astype(np.int32)), *[pa.array([a[x:y].tobytes() for x, y in zip(begins, stops, strict=True)], pa.binary()) for a in (offsets, sums)]],
                    names=["order", "block", "cells", "n"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for order, block, cells, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums = held.setdefault((order, block), np.zeros(1 << BLOCK_BITS, np.uint8))
                at = np.frombuffer(cells, np.uint16)
                sums[at] = np.minimum(sums[at] + np.frombuffer(n, np.uint8), limit)
        if held:
            bits = [np.packbits(s >= limit, bitorder="little").tobytes() for s in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array(bits, pa.binary())], names=["order", "block", "bits"])

    # Sums stop at limit, so 127 is enough for any greater least count: the bound is then looser.
    met = docs.mapInArrow(tidied(count), "order int, block int, cells binary, n binary")
    summed = met.repartition(partitions(spark), "order", "block").mapInArrow(tidied(add), "order int, block int, bits binary")
    found = {order: bytearray(1 << CELL_BITS >> 3) for order in orders}
    width = 1 << BLOCK_BITS >> 3
    for row in summed.collect():  # CELLS / 8 bytes an order at most
        found[row["order"]][row["block"] * width : (row["block"] + 1) * width] = row["bits"]
    shared.unpersist()
    return known | {order: bytes(b) for order, b in found.items()}


def scanned(lang: str, data: bytes, bounds: Bounds, longest: int) -> Iterator[tuple[str, int]]:
    """The candidates of a chunk, between spaces, and how often each occurs in it."""
    words = Words(lang, data)
    places = {order: np.flatnonzero(ok) for order, ok in bounds.candidates(words, longest)}
    phrases: set[bytes] = set()
    for order, at in places.items():
        _, first = np.unique(words.hash(order)[at], return_index=True)
        phrases.update(words.phrase(i, order) for i in at[first])
    text = data.decode("utf-8", "replace")
    counts = _matches(text, phrases)
    if sum(counts.values()) != sum(map(len, places.values())):
        counts = _matches(text, {words.phrase(i, order) for order, at in places.items() for i in at})
    yield from counts.items()


def _matches(text: str, phrases: set[bytes]) -> Counter[str]:
    """Overlapping occurrences of phrases that are guarded by spaces."""
    if not phrases:
        return Counter()
    known = [p.decode("utf-8", "replace") for p in phrases]
    automaton = ahocorasick.Automaton()
    for i, phrase in enumerate(known):
        automaton.add_word(phrase, i)
    automaton.make_automaton()
    return Counter({known[i]: n for i, n in Counter(map(itemgetter(1), automaton.iter(text))).items()})


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase and f of all phrases of 1 to longest words that occur least times at least; the empty phrase has the number of all words. A table in the shared folder."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    spark = docs.sparkSession
    bits = _sketch(texts, range(1, min(2, longest) + 1), {}, least)
    if longest > 2:
        bits = _sketch(texts, range(3, longest + 1), bits, least)
    shared = spark.sparkContext.broadcast(bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(shared.value)
        held: Counter[tuple[str, str]] = Counter()

        def out() -> pa.RecordBatch:
            packed: dict[tuple[str, int], list[tuple[str, int]]] = {}
            for (lang, phrase), n in held.items():
                packed.setdefault((lang, crc32(phrase.encode()) % BLOCKS), []).append((phrase, n))
            rows = packed.values()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in packed], pa.string()), pa.array([k[1] for k in packed], pa.int32()), pa.array(["\n".join(p for p, _ in r) for r in rows], pa.string()), pa.array([[n for _, n in r] for r in rows], pa.list_(pa.int64()))],
                names=["lang", "block", "phrases", "n"],
            )

        for lang, data in chunks(batches):
            held[lang, ""] += len(data.split())
            for phrase, n in scanned(lang, data, bounds, longest):
                held[lang, phrase[1:-1]] += n
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((lang.as_py(), block.as_py(), phrases.as_py(), n.as_py()) for batch in batches for lang, block, phrases, n in zip(*batch.columns, strict=True))
        for (lang, _), parts in groupby(rows, itemgetter(0, 1)):
            sums: Counter[str] = Counter()
            for _, _, phrases, n in parts:
                sums.update(dict(zip(phrases.split("\n"), n, strict=True)))
            kept = [(p, n) for p, n in sums.items() if n >= least or not p]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["lang", "phrase", "f"])

    packed = texts.mapInArrow(tidied(scan), "lang string, block int, phrases string, n array<long>")
    blocks = packed.repartition(partitions(spark), "lang", "block").sortWithinPartitions("lang", "block")
    return materialise(blocks.mapInArrow(tidied(add), "lang string, phrase string, f long"), "phrases")


#: floor(1000 a n / (l r)), exact for products of up to 38 digits; beyond them Spark raises.
_SCORE = "(1000BD * cast(a AS decimal(19)) * cast(n AS decimal(19))) div (cast(l AS decimal(19)) * cast(r AS decimal(19)))"


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, hides: int = HIDES) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score. A table in the shared folder."""
    with temporary():
        counts = phrase_counts(docs, text_col, lang_col, longest, least)
        words = F.split("phrase", " ")
        long = counts.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))
        shorter = lambda start: F.array_join(F.slice("words", start, F.size("words") - 1), " ")
        inside = long.where(F.size("words") > 2).select("lang", F.explode(F.array(shorter(1), shorter(2))).alias("phrase"), F.col("a").alias("longer"))
        kept = long.join(inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < hides * F.col("a"))).drop("longer")
        kept = kept.join(counts.where("phrase = ''").select("lang", F.col("f").alias("n")), "lang")
        cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice("words", 1, k), " ").alias("first"), F.array_join(F.slice("words", k + 1, F.size("words")), " ").alias("rest"))
        cuts = kept.withColumn("cut", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut))).select("lang", "phrase", "a", "n", "cut.*")
        of = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
        scored = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
        scored = scored.withColumn("score", F.expr(_SCORE))
        least_cut = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.max("a").alias("a"), F.max("n").alias("n"))
        rows = least_cut.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
        # The first of each salt, then the first of these: a language is never one task's as a whole.
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        for by in (("lang", "salt"), ("lang",)):
            rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return materialise(rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


_FROM = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i:i + {m - 1}], ' ') AS phrase, {m} AS m FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM w WHERE len(w) >= {m})" for m in range(1, LONGEST + 1))
_RANGES = ", ".join(f"({i}, {j})" for i in range(1, LONGEST) for j in range(2, LONGEST + 1))
QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {
    "op12_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS ({_FROM}),
f AS (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= {LEAST}),
s AS (SELECT DISTINCT lang, array_to_string(w[x.i:x.i + x.k - 1], ' ') AS phrase, a AS longer FROM c JOIN (VALUES {_RANGES}) x(i, k) ON x.k < m AND x.i + x.k - 1 <= m),
d AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN s ON s.lang = c.lang AND s.phrase = c.phrase WHERE 100 * s.longer >= {HIDES} * c.a),
k AS (SELECT c.lang, c.phrase, a, n, k, l.f AS l, r.f AS r, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN n USING (lang) JOIN range(1, {LONGEST}) t(k) ON k < m JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')
  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = c.lang AND d.phrase = c.phrase)),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
""",
}
