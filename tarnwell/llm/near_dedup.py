"""MinHash near-dedup (operator 8) by Order MinHash.

The items of a text are its shingles of five words, each labelled with how often it
has occurred before, so that repeats count. A sketch takes the PER_SKETCH items of
least hash and keeps them in text order; texts that share a sketch are candidates.
Unlike plain MinHash a sketch agrees only if the items also stand in the same order.

Candidates are verified on whole texts: the similarity of two texts with m and n
shingles of which c align in order is c / (m + n - c), and a link needs 0.8 or more.
c is a longest common subsequence, aligned within the band that a link can leave.

No bucket's pairs are listed. In rounds of stars each text of a bucket meets one text of
it: first the one that shares most buckets with most texts, then, in buckets that hold
more than one component, the one like that outside the bucket's largest component. What
is left are buckets of several components. A text has met nobody else there, so all
texts outside the largest component meet all texts of the bucket, in blocks: buckets
are cut into parts of about PART texts, and a task has two parts and their signatures.
Of a block's pairs that may be similar first the BEST of each text are verified, which
joins most components, and then, in what is still open, all others. Pairs of one
component never meet, so what is listed are a few pairs a text and the pairs that come
close to 0.8 without reaching it.

Before texts are moved, a pair's signatures (the least item of each of BINS ranges of
hashes, 1 byte each, and the number of items; FINE_BINS of them for blocks) must allow
0.8 within SIGMAS standard deviations. No pair is verified twice. Classes are the links'
connected components.

Equal texts (white space apart) are one text here and one class; their rows are
counted by partial aggregates, so a hot group is not one task's work.

Defined results: null and empty texts are equal to each other and near nothing else;
a text of one to four words is one shingle; a null doc_id is never a class's id if
it has another; of repeated rows (same doc_id, equal text) one is kept; texts of any
length are sketched and aligned whole, in memory in proportion to them; an empty
table gives an empty result; ``near_deduplicated`` carries further columns of any
name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import collapsed, materialise, own, read, temporary, tidied, whole_text
from .components import extended

SHINGLE, SIMILARITY = 5, 0.8
#: Two texts at similarity 0.8 share a sketch with probability about 0.6, so 12 sketches miss one pair in 60,000.
SKETCHES, PER_SKETCH = 12, 2
#: Bytes of a signature and of the finer one for blocks, and standard deviations by which an estimate may fall below SIMILARITY.
BINS, FINE_BINS, SIGMAS = 256, 2048, 4.5
#: Rounds of stars; texts of a part of a large bucket; pairs of each text that a block offers in its first round.
STARS, PART, BEST = 2, 1000, 4
#: Pairs of signatures compared at once.
AT_ONCE = 20_000
#: Texts' ids (40 bytes each) that may be broadcast; more of them are joined by a shuffle.
BROADCAST_IDS = 250_000
#: Pairs and bytes of texts of a cell of pairs to verify, and cells of a side at least.
CELL_PAIRS, CELL_BYTES, LEAST_SIDE = 4000, 32 << 20, 4
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1) | 1 for i in range(max(SHINGLE, SKETCHES))], np.uint64)
UID, ID, TEXT, RAW = own("uid"), own("id"), own("text"), own("raw")


def text_id(text_col: str) -> Column:
    """16 bytes that stand for the text with white space collapsed and trimmed."""
    return F.unhex(F.substring(F.sha2(F.trim(collapsed(whole_text(text_col))), 256), 1, 32))


def _raw(text_col: str) -> Column:
    """A quick hash by which a row of a given id is found again."""
    return F.xxhash64(whole_text(text_col))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def items(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Hashes of the text's shingles with their occurrence labels, in text order."""
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.array([known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in words], np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    shingles = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        shingles += hashed[i : i + n] * _ODD[i]
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    since = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    label = np.empty(n, np.uint64)
    label[order] = since
    return _mixed(shingles + label * np.uint64(0xD6E8FEB86659FD93))


def sketches(found: np.ndarray) -> list[int]:
    """One number per sketch, from its PER_SKETCH least items in text order; none for an empty text."""
    out = []
    for i in range(SKETCHES if len(found) else 0):
        hashed = (found ^ _ODD[-1 - i]) * _ODD[i]
        least = np.sort(np.argpartition(hashed, PER_SKETCH - 1)[:PER_SKETCH]) if len(found) > PER_SKETCH else np.arange(len(found))
        key = xxhash.xxh64_intdigest(hashed[least].tobytes(), seed=i + 1)
        out.append(key - (key >> 63 << 64))
    return out


def signature(found: np.ndarray, bins: int = BINS) -> bytes:
    """One byte for each of bins equal ranges of hashes: 1 to 255 from the range's least item, 0 without one; then the number of items in 4 bytes."""
    ranked = np.sort(found)
    at = np.searchsorted(ranked.astype(np.float64) / 2.0**64, np.arange(bins + 1) / bins)
    out = np.zeros(bins, np.uint8)
    some = at[:-1] < at[1:]
    out[some] = 1 + ranked[at[:-1][some]] % np.uint64(255)
    return out.tobytes() + len(found).to_bytes(4, "little")


def _sizes(signatures: np.ndarray) -> np.ndarray:
    return signatures[:, -4:].copy().view("<u4")[:, 0].astype(np.float64)


def compared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of two arrays of signatures: whether the similarity may be SIMILARITY or more, and the share of ranges that agree.

    The ranges' least items are drawn without replacement from the union of both texts'
    items, whose size at SIMILARITY follows from theirs; of short texts nearly all are seen.
    """
    size = _sizes(a) + _sizes(b)
    a, b = a[:, :-4], b[:, :-4]
    used = ((a | b) != 0).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    union = np.maximum(size / (1 + SIMILARITY), 2)
    unseen = np.clip((union - used) / (union - 1), 0, 1)
    return same >= SIMILARITY * used - SIGMAS * np.sqrt(SIMILARITY * (1 - SIMILARITY) * used * unseen) - 1, same / np.maximum(used, 1)


def may_be_similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return compared(a, b)[0]


def _matrix(column: pa.Array, bins: int = BINS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, bins + 4)


def _shingled(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return list(zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [tuple(words)] if words else []


def aligned(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence that pairs places at most band apart, bit-parallel."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return start + end
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, window = full, (1 << 2 * band + 1) - 1
    for j, x in enumerate(b):
        if (match := where.get(x)) is None:
            continue
        match &= window << j - band if j >= band else window >> band - j
        u = row & match
        row = (row + u | row - u) & full
    return start + end + len(a) - row.bit_count()


class Comparer:
    """Compares texts by their shingles; those of recent texts are held, up to HELD of them beside one pair's."""

    HELD = 200_000

    def __init__(self) -> None:
        self.codes: dict[tuple, int] = {}
        self.held: dict[bytes, tuple[list[int], frozenset[int]]] = {}

    def shingles(self, text: bytes) -> tuple[list[int], frozenset[int]]:
        """A number for each shingle, and the numbers of shingles labelled with how often they occurred before."""
        if (found := self.held.get(text)) is None:
            codes, seen = self.codes, Counter()
            order, labelled = [], []
            for x in _shingled(text.split()):
                order.append(codes.setdefault(x, len(codes)))
                labelled.append(order[-1] if not seen[x] else codes.setdefault((x, seen[x]), len(codes)))
                seen[x] += 1
            found = self.held[text] = order, frozenset(labelled)
        return found

    def similar(self, a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
        """Whether two texts' shingles align to a similarity of at least least."""
        if len(self.codes) > self.HELD:
            self.codes.clear()
            self.held.clear()
        x, y = self.shingles(a), self.shingles(b)
        if not x[0] or not y[0]:
            return not x[0] and not y[0]
        enough = lambda c: c >= least * (len(x[0]) + len(y[0]) - c) - 1e-9
        if not enough(min(len(x[0]), len(y[0]))) or not enough(len(x[1] & y[1])):
            return False
        needed = int(least * (len(x[0]) + len(y[0])) / (1 + least))
        return enough(aligned(x[0], y[0], max(len(x[0]), len(y[0])) - needed + 1))


def similar(a: list[bytes], b: list[bytes], least: float = SIMILARITY) -> bool:
    """Whether two texts' shingles align to a similarity of at least least."""
    return Comparer().similar(b" ".join(a), b" ".join(b), least)


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """ID, UID, the sketches and the signature of each row of docs."""
    schema = T.StructType([T.StructField(ID, docs.schema[id_col].dataType), T.StructField(UID, T.BinaryType()), T.StructField(RAW, T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            keys, signatures = [], []
            for value in batch.column(3):
                found = items((value.as_py() or "").encode("utf-8", "replace").split(), known)
                keys.append(sketches(found))
                signatures.append(signature(found))
                if len(known) > 500_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], names=schema.names)

    return docs.select(F.col(id_col).alias(ID), text_id(text_col).alias(UID), _raw(text_col).alias(RAW), F.col(text_col).alias(TEXT)).mapInArrow(tidied(run), schema)


def _texts(docs: DataFrame, rows: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(UID, TEXT, size) of the texts in needed (column UID, distinct), written."""
    few = needed.count() <= BROADCAST_IDS
    hint = F.broadcast if few else lambda x: x
    wanted = rows.join(hint(needed), UID, "left_semi").groupBy(UID).agg(F.min(F.struct(ID, RAW)).alias("w")).select(UID, "w.*")
    with_text = docs.select(F.col(id_col).alias("i"), _raw(text_col).alias("r"), whole_text(text_col).alias(TEXT))
    return materialise(with_text.join(hint(wanted), F.col("i").eqNullSafe(F.col(ID)) & (F.col("r") == F.col(RAW))).select(UID, TEXT, F.octet_length(TEXT).alias("size")).dropDuplicates([UID]), "texts")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b; distinct) whose texts are similar.

    Pairs are dealt to a square of cells, by the hash of a and the hash of b. A cell gets each
    of its texts once, so a text moves at most 2 * side times however many pairs it is in,
    and the pairs of one text are spread over side cells or more.
    """
    n = pairs.count()
    count, size = texts.agg(F.count(F.lit(1)), F.sum("size")).first()
    side = max(LEAST_SIDE, math.ceil(math.sqrt(max(n / CELL_PAIRS, 2 * n * (size or 0) / max(count, 1) / CELL_BYTES))))
    line = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    placed = pairs.select((line("a") * side + line("b")).alias("cell"), "a", "b")
    wanted = placed.select("cell", F.explode(F.array("a", "b")).alias(UID)).distinct()
    given = wanted.join(texts, UID).select(F.col("cell").alias("of"), UID, TEXT)

    def run(met: pa.Table, of_cell: pa.Table) -> pa.Table:
        compare = Comparer()
        held = {u: t.as_py().encode("utf-8", "replace") for u, t in zip(of_cell.column(UID).to_pylist(), of_cell.column(TEXT), strict=True)}
        met = met.select(["a", "b"]).sort_by([("a", "ascending"), ("b", "ascending")])
        ok = [compare.similar(held[x], held[y]) for x, y in zip(met.column("a").to_pylist(), met.column("b").to_pylist(), strict=True)]
        return met.filter(pa.array(ok, pa.bool_()))

    return placed.groupBy("cell").cogroup(given.groupBy("of")).applyInArrow(run, "a binary, b binary")


class _Search:
    """What a search for links has found: the texts it holds, the pairs it has tried, the components."""

    def __init__(self, docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> None:
        self.of = docs, rows, id_col, text_col
        self.texts: DataFrame | None = None
        self.tried: DataFrame | None = None
        self.labels: DataFrame | None = None

    def hold(self, needed: DataFrame) -> DataFrame:
        """The texts held, with those of needed (column UID, distinct)."""
        docs, rows, id_col, text_col = self.of
        if self.texts is not None:
            needed = needed.join(self.texts.select(UID), UID, "left_anti")
        more = _texts(docs, rows, materialise(needed, "needed"), id_col, text_col)
        self.texts = more if self.texts is None else self.texts.unionByName(more)
        return self.texts

    def verify(self, met: DataFrame) -> None:
        """Add the links among pairs (a, b), repeated ones too."""
        pairs = met.distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        texts = self.hold(pairs.select(F.explode(F.array("a", "b")).alias(UID)).distinct())
        found = materialise(_verified(pairs, texts), "links")
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        if not found.isEmpty():
            self.labels = extended(self.labels, found)


def linked(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """Labels (id, label) of the texts that have links; rows: of sketched(), written."""
    once = rows.select(UID, "keys", "sig").dropDuplicates([UID])
    members = once.select(UID, F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Signatures are wide: only members of shared buckets get theirs.
    shared = materialise(members.join(buckets, "key").join(once.select(UID, "sig"), UID), "members")
    if shared.isEmpty():
        return None
    search = _Search(docs, rows, id_col, text_col)
    degree = shared.groupBy(UID).agg(F.sum("n").alias("degree"))
    search.verify(_starred(shared.withColumn("label", F.col(UID)).withColumn("outside", F.lit(True)), degree))
    for _ in range(STARS - 1):
        search.verify(_starred(_opened(shared, search.labels), degree))
    left = _opened(shared, search.labels)
    if left.isEmpty():
        return search.labels
    wanted = left.select(UID).distinct()
    fine = materialise(_fine(search.hold(wanted).join(wanted, UID, "left_semi")), "fine")
    search.verify(_blocks(left, once, fine, BEST))
    left = _opened(shared, search.labels)
    if not left.isEmpty():
        search.verify(_blocks(left, once, fine, None))
    return search.labels


def _opened(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of the buckets that hold more than one component: with their label, the size of the bucket's largest component, and whether they are outside it.

    The pair of a bucket of two has met in the first star.
    """
    rows = shared.where("n > 2")
    if labels is None:
        rows = rows.withColumn("label", F.col(UID))
    else:
        rows = rows.join(labels.withColumnRenamed("id", UID), UID, "left").withColumn("label", F.coalesce("label", UID))
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    rows = rows.join(largest.select("key", F.col("top.c").alias("top_n"), F.col("top.label").alias("top")), "key")
    return materialise(rows.withColumn("outside", F.col("label") != F.col("top")).drop("top"), "open")


def _starred(rows: DataFrame, degree: DataFrame) -> DataFrame:
    """Pairs (a, b), repeated ones too, of each text with its bucket's centre, if that has another label.

    The centre is the text outside the largest component that shares most buckets with most texts: of a family of copies rather the original than a variant.
    """
    centres = rows.where("outside").join(degree, UID).groupBy("key").agg(F.max(F.struct("degree", UID, "sig", "label")).alias("f"))
    centres = centres.select("key", F.col(f"f.{UID}").alias("first"), F.col("f.sig").alias("first_sig"), F.col("f.label").alias("first_label"))
    both = rows.select(UID, "key", "sig", "label").join(centres, "key").where(F.col("label") != F.col("first_label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = may_be_similar(_matrix(batch.column(2)), _matrix(batch.column(3)))
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select(F.least("first", UID).alias("a"), F.greatest("first", UID).alias("b"), "sig", "first_sig").mapInArrow(tidied(run), "a binary, b binary")


def _fine(texts: DataFrame) -> DataFrame:
    """(UID, sig) with the finer signatures of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            found = [signature(items(t.as_py().encode("utf-8", "replace").split(), known), FINE_BINS) for t in batch.column(1)]
            if len(known) > 500_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=[UID, "sig"])

    return texts.select(UID, TEXT).mapInArrow(tidied(run), f"{UID} binary, sig binary")


def _best(i: np.ndarray, j: np.ndarray, share: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the most of greatest share of either end."""
    ends, share = np.r_[i, j], np.r_[share, share]
    order = np.lexsort((-share, ends))
    ranked = ends[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    place = np.arange(len(ends))
    rank = np.empty(len(ends), np.int64)
    rank[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return (rank[: len(i)] < most) | (rank[len(i) :] < most)


def _blocks(rows: DataFrame, once: DataFrame, fine: DataFrame, most: int | None) -> DataFrame:
    """Pairs (a, b) that may be similar, of texts that share a bucket but no component; most: the best of each text and block only.

    In a bucket of over PART texts the parts of texts outside the largest component meet
    themselves and all other parts; each pair of parts is a group of its own. A pair meets
    in the first bucket it shares only: that one is open too, unless it is the pair's own.
    """
    rows = rows.select("key", UID, "label", "outside", "n", "top_n").join(once.select(UID, "keys"), UID).join(fine, UID)
    outer, inner = F.ceil((F.col("n") - F.col("top_n")) / PART), F.ceil(F.col("top_n") / PART)
    small, drawn, to = F.col("n") <= PART, F.xxhash64(UID, F.lit(1)), lambda x: F.sequence(F.lit(0).cast("long"), x)
    rows = rows.withColumn("part", F.when(small, F.lit(0).cast("long")).when(F.col("outside"), F.pmod(drawn, outer)).otherwise(outer + F.pmod(drawn, inner)))
    rows = rows.withColumn("other", F.explode(F.when(small, to(F.lit(0).cast("long"))).when(F.col("outside"), to(outer + inner - 1)).otherwise(to(outer - 1))))
    rows = rows.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", UID, F.xxhash64("label").alias("label"), F.array_position("keys", F.col("key")).alias("place"), "keys", "sig")

    def run(block: pa.Table) -> pa.Table:
        uid, label, part = block.column(UID).to_pylist(), block.column("label").to_numpy(), block.column("part").to_numpy()
        sig, keys = _matrix(block.column("sig"), FINE_BINS), np.array(block.column("keys").to_pylist(), np.int64)
        place, size = block.column("place").to_numpy() - 1, _sizes(sig)
        within = block.column("low")[0] == block.column("high")[0]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        rows_at_once = max(1, AT_ONCE // len(uid))
        for low in range(0, len(uid), rows_at_once):
            left = np.arange(low, min(low + rows_at_once, len(uid)))
            meets = label[left, None] != label
            meets &= left[:, None] < np.arange(len(uid)) if within else part[left, None] < part
            meets &= np.minimum(size[left, None], size) >= SIMILARITY * np.maximum(size[left, None], size) - 1e-6
            i, j = np.nonzero(meets)
            i = left[i]
            first = (keys[i] == keys[j]).argmax(1) == place[i]
            i, j = i[first], j[first]
            ok, share = compared(sig[i], sig[j])
            found.append((i[ok], j[ok], share[ok]))
        i, j, share = (np.concatenate(x) for x in zip(*found, strict=True))
        if most is not None and len(i):
            best = _best(i, j, share, most)
            i, j = i[best], j[best]
        pairs = [(min(uid[x], uid[y]), max(uid[x], uid[y])) for x, y in zip(i, j, strict=True)]
        return pa.table([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

    return rows.groupBy("key", "low", "high").applyInArrow(run, "a binary, b binary")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Sketched rows, and (UID, class_id, class_size) of each text."""
    rows = materialise(sketched(docs, id_col, text_col), "sketches")
    per_text = rows.groupBy(UID).agg(F.min(ID).alias("low"), F.count(F.lit(1)).alias("n"))
    with temporary():
        labels = linked(docs, rows, id_col, text_col)
        if labels is None:
            classes = per_text.select(UID, F.col("low").alias("class_id"), F.col("n").alias("class_size"))
        else:
            per_text = per_text.join(labels.withColumnRenamed("id", UID), UID, "left").withColumn("label", F.coalesce("label", UID))
            of_class = per_text.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
            classes = per_text.join(of_class, "label").select(UID, "class_id", "class_size")
        return rows, materialise(classes, "classes", keep=True)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, class_id (the class's smallest id), class_size and kept."""
    rows, classes = _classes(docs, id_col, text_col)
    found = rows.select(ID, UID).join(classes, UID)
    first = F.col(ID).eqNullSafe(F.col("class_id"))
    kept = found.where(first).withColumn("kept", F.row_number().over(Window.partitionBy(UID, ID).orderBy(F.lit(1))) == 1)
    # Two texts of one class can have the same id; the text of least id then stays.
    ties = kept.where("kept").groupBy("class_id", ID).agg(F.min(UID).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    if not ties.isEmpty():
        kept = kept.join(ties.select(ID, "least"), ID, "left").withColumn("kept", F.col("kept") & (F.col("least").isNull() | (F.col(UID) == F.col("least"))))
    out = kept.select(ID, "class_id", "class_size", "kept").unionByName(found.where(~first).select(ID, "class_id", "class_size", F.lit(False).alias("kept")))
    return out.withColumnRenamed(ID, id_col)


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with docs' columns."""
    _, classes = _classes(docs, id_col, text_col)
    classes = classes.select(F.col(UID), F.col("class_id").alias(own("class")))
    rows = docs.withColumn(UID, text_id(text_col)).join(classes, UID).where(F.col(id_col).eqNullSafe(F.col(own("class"))))
    order = [F.col(UID)] + [F.col(c).cast("string").asc_nulls_last() for c, kind in docs.dtypes if kind in ("string", "bigint", "int", "double")]
    ranked = rows.withColumn(own("rank"), F.row_number().over(Window.partitionBy(own("class"), id_col).orderBy(*order)))
    return ranked.where(F.col(own("rank")) == 1).select(docs.columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"))


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLES: dict[str, str] = {}
