"""SentencePiece encoding and decoding (operator 7) on a relational lattice.

1. Texts, with their leading space, are cut into chunks at which no piece can cross:
   before spaces and line feeds, and before signs that no piece of the table has after
   the word's last character.
2. Each distinct chunk is exploded into its substrings of at most the longest
   piece's length, which are equi-joined to the piece table (its size is bounded by
   the vocabulary, so it is broadcast). The matches are the lattice's edges.
3. Edges are grouped by chunk and folded with Spark's higher-order ``aggregate``.
   For a unigram model that is Viterbi: the path of greatest total score. For a BPE
   model Viterbi gives other pieces than the model's own (it maximises a sum, BPE
   merges greedily), so the fold merges instead: of all neighbouring spans that an
   edge covers, the one of best score, the first of equal ones, until none is left.
   That is the model's definition, and results equal the public library's. One pass
   over the edges in the order of their scores does it, with the bounds of the spans
   as bits of a number, unless a merge makes room for an edge that is past; chunks
   where that happens are noticed and folded merge by merge.
   Characters without a piece become their bytes.
4. Texts never move. A block is BLOCK_ROWS rows of a file, known by the file's path and
   the rows' places in it, however the file is split into tasks (other input than
   Parquet files is written first). A first pass over the texts gives each block's
   distinct chunks. The ids of the chunks that most blocks have, at most COMMON, go to
   one dictionary that every task holds; the others are joined to the chunks that
   blocks ask for and written by block to the shared folder. A second pass over the
   texts looks ids up in both. A lost task reads its dictionaries again.

Chunks of more than LONGEST characters (text without spaces), whose bounds would not
fit a number's bits, get the same merges with a heap, in place.

Defined results: null and empty texts have no pieces; a text's own U+2581 is a space
to the model, so it decodes to one and round_trip is false; repeated rows are encoded
each; an empty table gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, new_folder, own, partitions, read, store, temporary, tidied, whole_text

MARK = "▁"
#: Spaces and a word with what its last character can join, spaces and what follows, a line feed, spaces at an end.
CHUNK = r" *(?:\w+(?:(?:{joined})[^ \n]*)?|[^\w \n][^ \n]*)|\n| +"
#: Characters of a chunk of the lattice, and chunks of one of its tasks.
LONGEST, CHUNKS_PER_TASK = 60, 30_000
#: Characters by which the longest piece from a place is known.
PREFIX = 3
#: Rows of a block, and chunks of the dictionary that every task holds.
BLOCK_ROWS, COMMON = 8192, 400_000
#: Distinct chunks after which a task hands on what it holds, answers a task of the join by block should have, and bytes of texts taken at once.
GATHERED_AT_ONCE, ANSWERS_PER_TASK, TEXT_BYTES = 500_000, 1_000_000, 4 << 20
_FALLBACK = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
BLOCK, ID, TEXT = own("block"), own("id"), own("text")


@dataclass(frozen=True)
class Pieces:
    """A model as a table: (piece, id, score) in its own spelling, its kind, and the id of byte 0 or of unknown characters."""

    rows: tuple[tuple[str, int, float], ...]
    kind: str
    first_byte: int | None
    unknown: int
    names: tuple[str, ...]

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)

    @cached_property
    def joins(self) -> dict[str, str]:
        """Signs by the word characters that some piece has before them, both as the inside of a character class."""
        before: dict[str, set[str]] = {}
        for piece, _, _ in self.rows:
            for x, y in zip(piece, piece[1:], strict=False):
                if re.match(r"\w", x) and not re.match(r"\w", y):
                    before.setdefault(y, set()).add(x)
        alike: dict[str, str] = {}
        for y, x in sorted(before.items()):
            of = re.escape("".join(sorted(x)))
            alike[of] = alike.get(of, "") + re.escape(y)
        return alike

    @property
    def chunk(self) -> str:
        """The regular expression of chunks: a sign stays with a word only if some piece has it after the word's last character."""
        return CHUNK.format(joined="|".join(f"[{y}](?<=[{x}][{y}])" for x, y in self.joins.items()) or "(?!)")

    @cached_property
    def table(self) -> dict[str, tuple[int, float]]:
        """(id, score) by piece, spelled with spaces."""
        return {p.replace(MARK, " "): (i, s) for p, i, s in self.rows}

    @property
    def longest_by_prefix(self) -> list[tuple[str, int]]:
        """The length of the longest piece with each beginning of PREFIX characters, spelled with spaces."""
        found: dict[str, int] = {}
        for p in self.table:
            if len(p) >= PREFIX:
                found[p[:PREFIX]] = max(len(p), found.get(p[:PREFIX], 0))
        return sorted(found.items())

    @property
    def ranked(self) -> list[tuple[str, int, float, int, bool]]:
        """(piece, id, score, rank, late), spelled with spaces: best score first; late: some two pieces that make it up have no better score, so it may become possible after its turn."""
        scores = {p: s for p, (_, s) in self.table.items()}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        cuts = lambda p: ((p[:k], p[k:]) for k in range(1, len(p)))
        late = lambda p, s: any(x in scores and y in scores and any(len(z) > 1 and scores[z] <= s for z in (x, y)) for x, y in cuts(p))
        return [(p, i, s, rank[s], late(p, s)) for p, (i, s) in self.table.items()]


def load(path: str, kind: str = "bpe") -> Pieces:
    """A public model file. kind: bpe or unigram."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.vocab_size())
    rows = tuple((model.id_to_piece(i), i, model.get_score(i)) for i in every if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)))
    if any("\n" in p or MARK in p.lstrip(MARK) for p, _, _ in rows):
        raise ValueError("a piece crosses chunks; this model needs other chunks")
    first = next((i for i in every if model.is_byte(i)), None)
    return Pieces(rows, kind, first, model.unk_id(), tuple(model.id_to_piece(i) for i in every))


def standard() -> Pieces:
    import public_tokenizers

    return load(public_tokenizers.path("piece_bpe_32k.model"))


#: The score or id of a span from x to y, null without an edge. Columns k, s and i hold the edges' keys, scores and ids.
_AT = "get({of}, int(array_position(k, 64 * {x} + {y} - {x})) - 1)"


def _bpe_bounds() -> Column:
    """Fold of the merges: the bounds b of the final spans. Columns n, k, s.

    Beside the bounds the state holds what a merge across each would score, so a step
    looks up the two that change. Folds have no let; an inner fold over one value names it.
    """
    at = lambda x, y: _AT.format(of="s", x=f"get(q.b, p {x})", y=f"get(q.b, p {y})")
    merged = f"""named_struct(
        'b', concat(slice(q.b, 1, p - 1), slice(q.b, p + 1, size(q.b))),
        'c', concat(slice(q.c, 1, greatest(p - 2, 0)), array({at("- 3", "")}, {at("- 2", "+ 1")}), slice(q.c, p + 2, size(q.c))),
        'more', true)"""
    step = f"aggregate(array(int(coalesce(array_position(t.c, array_max(t.c)), 0))), t, (q, p) -> if(p = 0, named_struct('b', q.b, 'c', q.c, 'more', false), {merged}))"
    start = _AT.format(of="s", x="(j - 1)", y="(j + 1)")
    first = f"named_struct('b', sequence(0, n), 'c', transform(sequence(0, n), j -> if(j = 0 or j = n, null, {start})), 'more', true)"
    return F.expr(f"aggregate(sequence(1, n), {first}, (t, i) -> if(t.more, {step}, t), t -> t.b)")


def _viterbi_bounds(unknown_score: float) -> Column:
    """Fold of the best paths by end; then the best path backwards."""
    score = _AT.format(of="s", x="j", y="i")
    offers = f"""transform(filter(sequence(greatest(0, i - longest), i - 1), j -> {score} is not null or j = i - 1),
        j -> named_struct('total', t[j].total + coalesce({score}, {unknown_score}D), 'from', j))"""
    best = f"aggregate(sequence(1, n), array(named_struct('total', 0D, 'from', 0)), (t, i) -> concat(t, array(array_max({offers}))))"
    return F.expr(f"aggregate(array({best}), array(n), (z, t) -> aggregate(sequence(1, n), array(n), (b, i) -> if(b[0] = 0, b, concat(array(t[b[0]].from), b))))")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def lattice(chunks: DataFrame, pieces: Pieces) -> DataFrame:
    """chunks: distinct, column chunk, of LONGEST characters at most. All edges (chunk, start, length, id, score, rank, late), and single characters that have no piece (id null)."""
    table = chunks.sparkSession.createDataFrame(pieces.ranked, "piece string, id int, score double, rank int, late boolean")
    longest = chunks.sparkSession.createDataFrame(pieces.longest_by_prefix, "prefix string, longest int")
    starts = chunks.select("chunk", F.length("chunk").alias("n")).select("chunk", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    # No substring is longer than the longest piece with its first characters.
    starts = starts.withColumn("prefix", F.expr(f"substring(chunk, start + 1, {PREFIX})")).join(F.broadcast(longest), "prefix", "left")
    ends = starts.select("chunk", "start", F.explode(F.sequence(F.lit(1), F.least(F.coalesce("longest", F.lit(PREFIX - 1)), F.col("n") - F.col("start")))).alias("length"))
    spans = ends.select("chunk", "start", "length", F.expr("substring(chunk, start + 1, length)").alias("piece"))
    return spans.join(F.broadcast(table), "piece", "left").where("id is not null or length = 1").select("chunk", "start", "length", "id", "score", "rank", "late")


#: An edge as a number, in the order of merges: rank (20 bits; single characters last), start (6), length (6), id (20; NONE without a piece), late (1).
NONE = (1 << 20) - 1
_PACKED = f"shiftleft(bigint(if(length = 1, {NONE}, rank)), 33) | shiftleft(bigint(start), 27) | shiftleft(bigint(length), 21) | shiftleft(bigint(coalesce(id, {NONE})), 1) | bigint(late and length > 1 and id is not null)"
_START, _LENGTH, _ID = "int(shiftright(x, 27) & 63)", "int(shiftright(x, 21) & 63)", f"int(shiftright(x, 1) & {NONE})"
#: By start and length as 12 bits: the bits of an edge's two bounds, and of the places between them (starts of which no bound fits 62 bits have none).
_AT_12, _ENDS, _MID = "int(shiftright(x, 21) & 4095)", *(
    "array(" + ", ".join(f"{bits(at >> 6, at & 63)}L" if (at >> 6) + (at & 63) < 62 else "0L" for at in range(4096)) + ")"
    for bits in (lambda start, length: ((1 << length) | 1) << start, lambda start, length: ((1 << length) - 2) << start if length else 0)
)
_EDGE = f"named_struct('o', x, 'ends', get({_ENDS}, {_AT_12}), 'mid', get({_MID}, {_AT_12}))"


def _one_pass() -> Column:
    """Fold of the edges of column m in their order: the bits of the bounds, with bit 62 set where a merge made an earlier, late edge possible."""
    able = lambda of, x: f"(({of} & {x}.ends) = {x}.ends and bit_count({of} & {x}.mid) = 1)"
    after = "aggregate(array(b & ~x.mid), b, (q, p) -> if(exists(late, y -> y.o < x.o and " + able("p", "y") + "), p | shiftleft(1L, 62), p))"
    return F.expr(f"aggregate(m, shiftleft(1L, n + 1) - 1L, (b, x) -> if({able('b', 'x')}, {after}, b))")


def _merged_bits(edges: DataFrame) -> DataFrame:
    """(chunk, m, c, bits): each chunk's edges of two and more characters, its single characters, and the bits of its final bounds."""
    grouped = edges.groupBy("chunk").agg(F.sort_array(F.collect_list(F.expr(_PACKED))).alias("e"))
    # Every character has an edge of its own, and these are last.
    grouped = grouped.select("chunk", F.length("chunk").alias("n"), "e")
    grouped = grouped.select("chunk", "n", F.expr(f"transform(slice(e, 1, size(e) - n), x -> {_EDGE})").alias("m"), F.expr("slice(e, size(e) - n + 1, n)").alias("c"))
    grouped = grouped.withColumn("late", F.expr("filter(m, y -> (y.o & 1L) = 1L)")).withColumn("bits", _one_pass())
    again = F.expr("bits >= shiftleft(1L, 62)")
    known = "transform(m, y -> y.o)"
    grouped = grouped.withColumn("k", F.when(again, F.expr(f"transform({known}, x -> 64 * {_START} + {_LENGTH})"))).withColumn("s", F.when(again, F.expr(f"transform({known}, x -> -shiftright(x, 33))")))
    by_merge = F.aggregate(_bpe_bounds(), F.lit(0).cast("long"), lambda t, i: t.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return grouped.select("chunk", "m", "c", F.when(again, by_merge).otherwise(F.col("bits")).alias("bits"))


def _unknown(pieces: Pieces, at: str) -> str:
    """SQL of the ids of a character without a piece."""
    if pieces.first_byte is None:
        return f"array({pieces.unknown})"
    char = f"substring(chunk, {at} + 1, 1)"
    return f"transform(sequence(1, octet_length({char})), o -> {pieces.first_byte} + int(conv(substring(hex({char}), 2 * o - 1, 2), 16, 10)))"


def _folded_bpe(edges: DataFrame, pieces: Pieces) -> DataFrame:
    placed = lambda x: f"(shiftright({x}, 27) & 63) << 20 | (shiftright({x}, 1) & {NONE})"
    merged_ones = f"transform(filter(m, x -> (bits & x.ends) = x.ends and (bits & x.mid) = 0), x -> {placed('x.o')})"
    single = f"transform(filter(c, x -> (shiftright(bits, {_START}) & 3) = 3), x -> {placed('x')})"
    cut = _merged_bits(edges).select("chunk", F.sort_array(F.expr(f"concat({merged_ones}, {single})")).alias("c"))
    known = f"int(z & {NONE})"
    ids = f"if(exists(c, z -> {known} = {NONE}), flatten(transform(c, z -> if({known} = {NONE}, {_unknown(pieces, 'int(shiftright(z, 20))')}, array({known})))), transform(c, z -> {known}))"
    return cut.select("chunk", F.expr(ids).alias("ids"))


def _folded_unigram(edges: DataFrame, pieces: Pieces) -> DataFrame:
    key = 64 * F.col("start") + F.col("length")
    edge = F.when(F.col("id").isNotNull(), F.struct(key.alias("k"), F.col("score").alias("s"), F.col("id").alias("i")))
    grouped = edges.groupBy("chunk").agg(F.collect_list(edge).alias("e"))
    grouped = grouped.select("chunk", F.length("chunk").alias("n"), F.lit(pieces.longest).alias("longest"), F.col("e.k").alias("k"), F.col("e.s").alias("s"), F.col("e.i").alias("i"))
    cut = grouped.withColumn("b", _viterbi_bounds(min(s for _, _, s in pieces.rows) - 10.0))
    found = _AT.format(of="i", x="x", y="get(b, y + 1)")
    ids = f"flatten(transform(slice(b, 1, size(b) - 1), (x, y) -> if({found} is null, {_unknown(pieces, 'x')}, array({found}))))"
    return cut.select("chunk", F.expr(ids).alias("ids"))


def folded(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """(chunk, ids) for each chunk of a lattice."""
    return _folded_bpe(edges, pieces) if pieces.kind == "bpe" else _folded_unigram(edges, pieces)


def merged(chunk: str, table: dict[str, tuple[int, float]], pieces: Pieces) -> list[int]:
    """The ids of one chunk of a BPE model, with a heap; for long chunks."""
    spans = list(chunk)
    before, after = list(range(-1, len(spans) - 1)), [*range(1, len(spans)), -1]
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if i >= 0 and j >= 0 and (found := table.get(both := spans[i] + spans[j])):
            heapq.heappush(heap, (-found[1], i, j, both))

    for i in range(len(spans) - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if spans[i] and spans[j] and after[i] == j and spans[i] + spans[j] == both:
            spans[i], spans[j], after[i] = both, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
    return [i for s in spans if s for i in ((table[s][0],) if s in table else tuple(pieces.first_byte + b for b in s.encode()) if pieces.first_byte is not None else (pieces.unknown,))]


def best_path(chunk: str, table: dict[str, tuple[int, float]], pieces: Pieces) -> list[int]:
    """The ids of one chunk of a unigram model; for long chunks."""
    unknown, longest = min(s for _, s in table.values()) - 10.0, pieces.longest
    best: list[tuple[float, int]] = [(0.0, 0)]
    for i in range(1, len(chunk) + 1):
        best.append(max((best[j][0] + (table[chunk[j:i]][1] if chunk[j:i] in table else unknown), j) for j in range(max(0, i - longest), i) if chunk[j:i] in table or j == i - 1))
    out, i = [], len(chunk)
    while i:
        s = chunk[best[i][1] : i]
        out.append([table[s][0]] if s in table else [pieces.first_byte + b for b in s.encode()] if pieces.first_byte is not None else [pieces.unknown])
        i = best[i][1]
    return [i for ids in reversed(out) for i in ids]


def words_of(texts: pa.Array) -> pa.ListArray:
    """Each text, its leading space included, cut before runs of spaces and before line feeds, which no chunk crosses.

    Words come without their first space, unless they begin with a line feed, and have
    the mark for further spaces. Empty texts have none.
    """
    texts = pc.replace_with_mask(texts, pc.equal(texts, ""), pa.scalar(None, pa.string()))
    if any(pc.any(found).as_py() for found in (pc.match_substring(texts, "  "), pc.match_substring(texts, MARK), pc.starts_with(texts, " "))):
        texts = pc.binary_join_element_wise("", pc.replace_substring(texts, MARK, " "), " ")
        texts = pc.replace_substring(pc.replace_substring(texts, "  ", " " + MARK), MARK + " ", 2 * MARK)
        texts = pc.replace_substring_regex(texts, "^ ", "", max_replacements=1)
    return pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")


#: Letters and what follows from an ASCII sign on.
_LETTERS_SIGN = r"^(?P<letters>\p{L}+)(?P<rest>[!-/:-@\[-^`{-~].*)$"


def chunker(pieces: Pieces) -> Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray]]:
    """A function of an array of words of words_of: chunks, their places word by word, and how many each word has.

    Letters alone are one chunk, and letters with a sign that no piece joins to them
    are two; only other words are searched by the regular expression one by one.
    """
    find = re.compile(pieces.chunk).findall
    joined = r"^\p{L}*(?:" + "|".join(f"[{x}][{y}]" for x, y in pieces.joins.items()) + ")" if pieces.joins else "^$"

    def cut(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        whole = pc.utf8_is_alpha(words)
        apart = pc.extract_regex(words, _LETTERS_SIGN)
        two = pc.and_(pc.is_valid(apart), pc.invert(pc.match_substring_regex(words, joined)))
        halves = apart.filter(two)
        others = [find(spelled(w)) for w in words.filter(pc.invert(pc.or_(whole, two))).to_pylist()]
        spaced = lambda x: pc.binary_join_element_wise("", x, " ")
        pool = pa.concat_arrays([spaced(words.filter(whole)), spaced(halves.field("letters")), halves.field("rest"), pa.array(list(chain.from_iterable(others)), pa.string())])
        one, both = (x.to_numpy(zero_copy_only=False) for x in (whole, two))
        several = np.flatnonzero(~(one | both))
        counts = np.where(both, 2, 1)
        counts[several] = [len(x) for x in others]
        starts, n_one, n_two = np.cumsum(counts) - counts, int(one.sum()), int(both.sum())
        places = np.empty(int(counts.sum()), np.int64)
        places[starts[one]] = np.arange(n_one)
        places[starts[both]] = n_one + np.arange(n_two)
        places[starts[both] + 1] = n_one + n_two + np.arange(n_two)
        rest = _ranges(starts[several], counts[several])
        places[rest] = n_one + 2 * n_two + np.arange(len(rest))
        return pool, places, counts

    return cut


def spelled(word: str) -> str:
    word = word.replace(MARK, " ")
    return word if word[:1] == "\n" else " " + word


def slices(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about TEXT_BYTES of column texts and of one BLOCK (column 0) each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // TEXT_BYTES
    block = batch.column(0).to_numpy()
    cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0)) + 1
    for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if end > start:
            yield batch.slice(start, end - start)


def located(docs: DataFrame, id_col: str, text_col: str, block_rows: int) -> DataFrame:
    """ID, TEXT and BLOCK, which depends on a row's file and place there only."""
    row = [F.col(id_col).alias(ID), whole_text(text_col).alias(TEXT)]

    def placed(of: DataFrame, columns: list[Column]) -> DataFrame:
        at = of.metadataColumn("_metadata")
        return of.select(*columns, F.xxhash64(at["file_path"], F.floor(at["row_index"] / block_rows)).alias(BLOCK))

    try:
        found = placed(docs, row)
        _ = found.schema
        return found
    except AnalysisException:  # no Parquet files below, or several of them
        return placed(materialise(docs.select(*row), "texts"), [F.col(ID), F.col(TEXT)])


def _widespread(distinct: DataFrame) -> DataFrame | None:
    """The chunks that most blocks have: all above a number of blocks, in steps of a quarter of its power of two, COMMON chunks at most."""
    level = F.floor(4 * F.log2("n"))
    total, least = 0, None
    for at, n in sorted(distinct.where("n > 1").groupBy(level.alias("level")).count().collect(), reverse=True):
        total += n
        if total > COMMON:
            break
        least = at
    return None if least is None else distinct.where((F.col("n") > 1) & (level >= least)).select("chunk")


def dictionaries(texts: DataFrame, pieces: Pieces) -> str:
    """A shared folder with (chunk, ids, same) of all chunks but the long ones, widespread ones in common, others by BLOCK; same: whether the ids decode to the chunk."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(pieces)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = chunker(shared.value)
        chunks: list[pa.Array] = []
        block = None

        def handed() -> pa.RecordBatch:
            asked = pa.concat_arrays(chunks).unique()
            asked = asked.filter(pc.less_equal(pc.utf8_length(asked), LONGEST))
            chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), block, np.int64)), asked], names=["block", "chunk"])

        for batch in (part for whole in batches for part in slices(whole, 1)):
            if chunks and (batch.column(0)[0].as_py() != block or sum(map(len, chunks)) > GATHERED_AT_ONCE):
                yield handed()
            block = batch.column(0)[0].as_py()
            chunks.append(cut(words_of(batch.column(1)).flatten().unique())[0].unique())
        if chunks:
            yield handed()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([decoded_bytes([i], shared.value) for i in range(len(shared.value.names))], pa.binary())
        for batch in batches:
            ids = batch.column(1)
            spans = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), names.take(ids.flatten()))
            same = pc.equal(pc.binary_join(spans, pa.scalar(b"")), batch.column(0).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, same], names=["chunk", "ids", "same"])

    folder = new_folder(spark, "dictionaries")
    with temporary():
        asked = materialise(texts.select(BLOCK, TEXT).mapInArrow(tidied(gather), "block long, chunk string"), "chunks", "zstd")
        distinct = materialise(asked.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")), "distinct", "zstd")
        parts = max(partitions(spark), distinct.count() // CHUNKS_PER_TASK + 1)
        with _setting(spark, _FALLBACK, str(4 * CHUNKS_PER_TASK)):
            found = folded(lattice(distinct.select("chunk").repartition(parts, "chunk"), pieces), pieces)
            ids = materialise(found.mapInArrow(tidied(check), "chunk string, ids array<int>, same boolean"), "lattice", "zstd")
        if (common := _widespread(distinct)) is not None:
            # At most COMMON chunks of LONGEST characters, in a few files, as every task reads them.
            ids.join(F.broadcast(common), "chunk", "left_semi").repartition(4).write.parquet(f"{folder}/common")
            asked = asked.join(F.broadcast(common), "chunk", "left_anti")
        parts = max(partitions(spark), asked.count() // ANSWERS_PER_TASK + 1)
        asked.join(ids, "chunk").repartition(parts, "block").write.partitionBy("block").parquet(f"{folder}/blocks")
    return folder


@dataclass(frozen=True)
class Answers:
    """A table of chunks, their ids, how many each has, and whether they decode to it."""

    chunks: pa.Array
    values: np.ndarray
    lengths: np.ndarray
    same: np.ndarray

    @staticmethod
    def read(folder: str) -> Answers:
        fs, path = store(folder)
        # A block of long or widespread chunks only has no folder.
        files = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".parquet"))
        tables = [pq.read_table(fs.open_input_file(f), columns=["chunk", "ids", "same"]) for f in files]
        chunks = pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for t in tables for c in t.column("chunk").chunks)])
        values, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for ids in (c for t in tables for c in t.column("ids").chunks):
            values.append(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False))
            lengths.append(np.diff(ids.offsets.to_numpy()).astype(np.int64))
        return Answers(chunks, np.concatenate(values), np.concatenate(lengths), np.concatenate([np.zeros(0, bool), *(t.column("same").to_numpy() for t in tables)]))


#: The common answers of the folder that the task in this process has read.
_COMMON: dict[str, Answers] = {}


def _common(folder: str) -> Answers:
    if folder not in _COMMON:
        _COMMON.clear()
        _COMMON[folder] = Answers.read(folder)
    return _COMMON[folder]


class Dictionary:
    """The chunks of one block; those in neither table are folded as they come."""

    def __init__(self, folder: str, block: int, pieces: Pieces) -> None:
        self.pieces = pieces
        self.common, self.own = _common(f"{folder}/common"), Answers.read(f"{folder}/blocks/block={block}")
        self.chunks = pa.concat_arrays([self.common.chunks, self.own.chunks])
        self.values, self.lengths, self.same = (np.concatenate([getattr(self.common, x), getattr(self.own, x)]) for x in ("values", "lengths", "same"))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.folded: dict[str, int] = {}

    def _places(self, chunks: pa.Array) -> np.ndarray:
        found = pc.index_in(chunks, value_set=self.chunks)
        missing = found.is_null().to_numpy(zero_copy_only=False)
        places = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if missing.any():
            others = chunks.filter(pa.array(missing)).to_pylist()
            if new := [c for c in others if c not in self.folded]:
                self._fold(new)
            places[missing] = [self.folded[c] for c in others]
        return places

    def _fold(self, new: list[str]) -> None:
        ids = [(merged if self.pieces.kind == "bpe" else best_path)(c, self.pieces.table, self.pieces) for c in new]
        lengths = np.array([len(i) for i in ids], np.int64)
        self.folded.update(zip(new, range(len(self.lengths), len(self.lengths) + len(new)), strict=True))
        self.starts = np.r_[self.starts, len(self.values) + np.cumsum(lengths) - lengths]
        self.values = np.r_[self.values, np.fromiter(chain.from_iterable(ids), np.int32)]
        self.lengths = np.r_[self.lengths, lengths]
        self.same = np.r_[self.same, np.array([decoded_bytes(i, self.pieces) == c.encode() for c, i in zip(new, ids, strict=True)], bool)]

    def ids(self, chunks: pa.Array, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of counts chunks at places: all their ids, how many each has, and whether it decodes to itself."""
        coded = chunks.dictionary_encode()
        at = self._places(coded.dictionary)[coded.indices.to_numpy()[places]]
        n = self.lengths[at]
        ends = np.r_[0, np.cumsum(counts)]
        return self.values[_ranges(self.starts[at], n)], np.diff(np.r_[0, np.cumsum(n)][ends]), np.diff(np.r_[0, np.cumsum(~self.same[at])][ends]) == 0


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of ranges that start and are so long, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def decoded_bytes(ids: list[int], pieces: Pieces) -> bytes:
    """UTF-8 of the pieces of a list of ids, the leading space included."""
    first = pieces.first_byte
    return b"".join(bytes([i - first]) if first is not None and first <= i < first + 256 else pieces.names[i].replace(MARK, " ").encode() for i in ids)


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    """The text of a list of ids."""
    text = decoded_bytes(ids, pieces).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def encoded(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of docs: its id, ids, n_pieces and round_trip (whether the ids decode to the text). Docs are read twice."""
    spark = docs.sparkSession
    texts = located(docs, id_col, text_col, block_rows)
    folder = dictionaries(texts, pieces)
    shared = spark.sparkContext.broadcast(pieces)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def encode(batch: pa.RecordBatch, known: Dictionary, chunks_of: Callable) -> pa.RecordBatch:
        texts = batch.column(2)
        words = words_of(texts)
        coded = words.flatten().dictionary_encode()
        of_words, lengths, same = known.ids(*chunks_of(coded.dictionary))
        word = coded.indices.to_numpy()
        n = lengths[word]
        found = of_words[_ranges((np.cumsum(lengths) - lengths)[word], n)]
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy())]
        cut = np.r_[0, np.cumsum(n)][ends]
        wrong = np.diff(np.r_[0, np.cumsum(~same[word])][ends])
        # Chunks that decode to themselves make up the text unless it has the mark itself; other texts are decoded.
        trip = ~pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(wrong):
            trip[i] = decode_ids(found[cut[i] : cut[i + 1]].tolist(), known.pieces) == texts[int(i)].as_py()
        lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(found))
        return pa.RecordBatch.from_arrays([batch.column(1), lists, pa.array(np.diff(cut), pa.int64()), pa.array(trip, pa.bool_())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = known = None
        chunks_of = chunker(shared.value)
        for batch in (part for whole in batches for part in slices(whole, 2)):
            if (of := batch.column(0)[0].as_py()) != block or known is None:
                known = None
                block, known = of, Dictionary(folder, of, shared.value)
            yield encode(batch, known, chunks_of)
        _COMMON.clear()

    return texts.select(BLOCK, ID, TEXT).mapInArrow(tidied(run), schema)


def decoded(rows: DataFrame, pieces: Pieces, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows with a column ids."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_ids(v.as_py() or [], shared.value) for v in batch.column(1)], pa.string())], names=schema.names)

    return rows.select(id_col, "ids").mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), standard())


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLES: dict[str, str] = {}
