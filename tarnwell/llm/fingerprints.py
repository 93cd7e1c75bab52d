"""Document fingerprints (operator 11): quartile bucket digests.

Each byte of a text makes a triplet with the bytes GAPS after it, the text taken as a
ring so that short texts have as many triplets as bytes. Triplets are hashed and
counted in BUCKETS buckets, and each bucket is coded by the quartiles of all buckets'
counts that it exceeds (0 to 3). Bytes with gaps between tell texts of one language
apart better than neighbouring ones, whose counts follow the language. A fingerprint
is hexadecimal: two digits for the length in quarter octaves, then a digit for each
two buckets. The difference of two is the sum of the codes' differences and 8 for each
step of length, bounded by the number of buckets or by what both codes hold together,
if that is less; likeness is 1 less the difference by its bound.

Each document meets the next one in the order of the ids: documents go to ranges of
ids once, with their texts, and each task walks its range with one text in hand. The
first and last texts of ranges, two a task, are matched in a second small join.

Defined results: a null text counts as empty; all empty texts have one fingerprint,
which is like itself only; null ids come first; rows of one id stand by the xxhash64
of their text, equal rows in any order; the only document is its own next one; very
long texts are counted a MiB at a time; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, own, partitions, read, tidied, whole_text

#: Buckets of triplet counts; bytes of a triplet, relative to its first; weight of a step of length.
BITS = 9
BUCKETS = 1 << BITS
GAPS = (0, 3, 7)
STEP_WEIGHT = 8
#: Knuth's multiplier, 2^32 by the golden ratio.
MULTIPLIER = 2654435761
#: Bytes that are counted at once.
CHUNK = 1 << 20


def _counts(data: bytes) -> np.ndarray:
    found = np.zeros(BUCKETS, np.int64)
    reach = GAPS[-1]
    ring = np.resize(np.frombuffer(data, np.uint8), len(data) + reach) if data else np.zeros(0, np.uint8)
    for start in range(0, len(data), CHUNK):
        n = min(CHUNK, len(data) - start)
        part = ring[start : start + n + reach].astype(np.uint32)
        triplets = part[:n] | part[GAPS[1] : GAPS[1] + n] << np.uint32(8) | part[reach : reach + n] << np.uint32(16)
        found += np.bincount(triplets * np.uint32(MULTIPLIER) >> np.uint32(32 - BITS), minlength=BUCKETS)
    return found


def _length_code(n: int) -> int:
    """Quarters of octaves: 1 for one byte, 0 for none."""
    octave = n.bit_length() - 1
    return 1 + 4 * octave + ((n << 2 >> octave) & 3) if n else 0


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "replace")
    counts = _counts(data)
    cuts = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > cuts).sum(axis=1).reshape(-1, 4)
    return f"{_length_code(len(data)):02x}" + (codes @ np.array([64, 16, 4, 1])).astype(np.uint8).tobytes().hex()


def _codes(print_: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(print_), np.uint8)
    return int(raw[0]), (raw[1:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).astype(np.int64).ravel()


def likeness(one: str, other: str) -> float:
    """1 for equal fingerprints, 0 for those that differ by the bound or more."""
    (length, codes), (its_length, its_codes) = _codes(one), _codes(other)
    difference = int(np.abs(codes - its_codes).sum()) + STEP_WEIGHT * abs(length - its_length)
    bound = max(1, min(BUCKETS, int(codes.sum() + its_codes.sum())))
    return 1.0 - min(difference, bound) / bound


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and fingerprint."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.string())], names=schema.names)

    return docs.select(F.col(id_col), whole_text(text_col).alias(own("text"))).mapInArrow(tidied(run), schema)


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by the first of what follows."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


ID, TEXT, TIE, PART, NEXT, LAST, FIRST = (own(c) for c in ("id", "text", "tie", "part", "next", "last", "first"))
_RESULT = {"n_chars": T.LongType(), "edited_sha256": T.StringType(), "fingerprint": T.StringType(), "edited_fingerprint": T.StringType(), "near_edited": T.DoubleType(), "near_next": T.DoubleType()}
_ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}


def _compared(text: str, mark: str, following: str, its_mark: str) -> tuple:
    new = edited(text, following)
    other = mark if new == text else fingerprint(new)
    return len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), mark, other, likeness(mark, other), likeness(mark, its_mark)


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], _ARROW[kind]) for i, kind in enumerate(_RESULT.values())]


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, fingerprint, that of its edited text, and the likeness of both and of the next document's."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias(ID), whole_text(text_col).alias(TEXT)).withColumn(TIE, F.xxhash64(TEXT))
    ranges = rows.repartitionByRange(4 * partitions(spark), ID, TIE).sortWithinPartitions(ID, TIE).select(ID, TEXT, F.spark_partition_id().alias(PART))
    walked = T.StructType([T.StructField(ID, kind), *[T.StructField(c, k) for c, k in _RESULT.items()], T.StructField(PART, T.IntegerType()), T.StructField(FIRST, T.StringType()), T.StructField(LAST, T.StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = ident = None
        mark, part = "", 0
        for batch in batches:
            ids, found = [], []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                its_mark = mark if text == held else fingerprint(text)
                if held is None:
                    first, part = text, batch.column(2)[0].as_py()
                else:
                    ids.append(ident)
                    found.append(_compared(held, mark, text, its_mark))
                held, mark, ident = text, its_mark, batch.column(0)[i]
            none = pa.nulls(len(ids), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], batch.column(0).type), *_columns(found), pa.nulls(len(ids), pa.int32()), none, none], names=walked.names)
        if held is not None:
            empty = [pa.nulls(1, _ARROW[k]) for k in _RESULT.values()]
            yield pa.RecordBatch.from_arrays([pa.array([ident.as_py()], ident.type), *empty, pa.array([part], pa.int32()), pa.array([first]), pa.array([held])], names=walked.names)

    done = materialise(ranges.mapInArrow(tidied(walk), walked), "fingerprints")
    edges = done.where(F.col(PART).isNotNull())
    # A row for each range, of its number only: the next range that has documents, and after the last the first.
    order = Window.orderBy(PART)
    following = edges.select(PART, F.coalesce(F.lead(PART).over(order), F.first(PART).over(order)).alias(NEXT))
    pairs = edges.select(PART, ID, LAST).join(following, PART).join(edges.select(F.col(PART).alias(NEXT), FIRST), NEXT).select(ID, LAST, FIRST)
    schema = T.StructType([T.StructField(ID, kind), *[T.StructField(c, k) for c, k in _RESULT.items()]])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns([_compared(a, fingerprint(a), b, fingerprint(b)) for a, b in texts])], names=schema.names)

    inner = done.where(F.col(PART).isNull()).select(ID, *_RESULT)
    return inner.unionByName(pairs.mapInArrow(tidied(match), schema)).withColumnRenamed(ID, id_col)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_and_next(read(spark, sf_dir, "documents"))


QUERIES = {"op11_document_fingerprints": op11_document_fingerprints}
ORACLES = {
    "op11_document_fingerprints": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nx FROM d),
e AS (SELECT doc_id, t, nx, length(t) AS n, left(t, length(t) - length(t) // 4) || left(nx, length(t) // 4) AS et FROM p),
x AS (SELECT row_number() OVER () AS k, t FROM (SELECT t FROM e UNION SELECT et FROM e)),
b AS (SELECT k, list_transform(regexp_extract_all(hex(t), '..'), lambda h: ('0x' || h)::UBIGINT) AS b FROM x),
h AS (SELECT k, unnest(list_transform(range(len(b)), lambda i: ((b[i + 1] + 256 * b[(i + {GAPS[1]}) % len(b) + 1] + 65536 * b[(i + {GAPS[2]}) % len(b) + 1]) * {MULTIPLIER}) % 4294967296 >> {32 - BITS})) AS bucket FROM b),
c AS (SELECT k, bucket, count(*) AS n FROM h GROUP BY ALL),
l AS (SELECT x.k, list(coalesce(n, 0) ORDER BY r.range) AS n FROM x CROSS JOIN range({BUCKETS}) r LEFT JOIN c ON c.k = x.k AND c.bucket = r.range GROUP BY x.k),
q AS (SELECT k, n, list_sort(n) AS s FROM l),
z AS (SELECT k, list_transform(n, lambda v: (v > s[{BUCKETS // 4}])::INT + (v > s[{BUCKETS // 2}])::INT + (v > s[{3 * BUCKETS // 4}])::INT) AS z FROM q),
f AS (SELECT t, z, CASE WHEN len(b) = 0 THEN 0 ELSE 1 + 4 * (length(bin(len(b))) - 1) + ((len(b) << 2) >> (length(bin(len(b))) - 1)) % 4 END AS len FROM x JOIN z USING (k) JOIN b USING (k)),
m AS (SELECT *, printf('%02x', len) || list_aggregate(list_transform(range({BUCKETS // 2}), lambda i: substr('0123456789abcdef', 4 * z[2 * i + 1] + z[2 * i + 2] + 1, 1)), 'string_agg', '') AS mark FROM f),
g AS (SELECT doc_id, e.n AS n_chars, sha256(et) AS edited_sha256, o.mark AS fingerprint, w.mark AS edited_fingerprint,
  list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: abs(o.z[i] - w.z[i]))) + {STEP_WEIGHT} * abs(o.len - w.len) AS de, greatest(1, least({BUCKETS}, list_sum(o.z) + list_sum(w.z))) AS be,
  list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: abs(o.z[i] - v.z[i]))) + {STEP_WEIGHT} * abs(o.len - v.len) AS dn, greatest(1, least({BUCKETS}, list_sum(o.z) + list_sum(v.z))) AS bn
  FROM e JOIN m o ON o.t = e.t JOIN m w ON w.t = e.et JOIN m v ON v.t = e.nx)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, 1.0::DOUBLE - least(de, be)::DOUBLE / be::DOUBLE AS near_edited, 1.0::DOUBLE - least(dn, bn)::DOUBLE / bn::DOUBLE AS near_next FROM g
""",
}
