"""Secret scans (operator 6): fixed patterns, and novelty under a primed zstandard.

A candidate is a string of at least SHORTEST characters that values are made of, which
starts within REACH characters after a sensitive word (both are parameters); of a string
that holds sensitive words itself, the values behind its key separators. Its novelty is the number of bytes by which the
compressed surrounding code grows when the candidate is put back into it, over the
candidate's length. The compressor is primed with a dictionary trained on common
identifiers and words: their parts are known, and letters cost what they cost in such
text. Names, paths and words are in the dictionary or the surroundings or have usual
letters and cost little; keys cost nearly a byte a character, whatever they are made of.
Below USUAL characters the fixed costs of a match hide the difference: there a candidate
has to cost what random strings of its length cost, and to turn between letters, capitals
and digits TURNS times, since words and names of that length can cost as much.
Candidates are found in one pass, in time linear in the text.

Spans are code points, end exclusive, of kinds assign, access, hex (the fixed
patterns, whole matches) and novel (the method's own; only where no fixed span lies).

Defined results: null and empty texts have no spans; texts are scanned whole;
equal texts give equal spans; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate, islice, takewhile

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import read

#: Fixed patterns; ASCII letters in either case in the first only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"(?:key|secret|token|passw|passphrase|credential|auth|bearer|private)", re.I | re.A)
#: Characters of a candidate at least, and from which on NOVELTY decides alone.
SHORTEST, USUAL = 12, 16
#: Signs between a key and its value, other than the key separator.
SIGNS = re.compile(r"[+/_.=~-]+")
#: Characters after a sensitive word in which a candidate starts, and of surroundings on either side.
REACH, AROUND = 96, 256
NOVELTY, LEVEL = 0.62, 3
#: Identifiers and words that code and configuration are full of (fixed values).
COMMON = (
    "public private protected static final class interface return import export function const let var "
    "string boolean integer double float object array length index value values default config configuration "
    "username password secret token apikey api_key access_key secret_key private_key client_id client_secret "
    "authorization bearer credentials session cookie header request response content-type application/json "
    "https://www.example.com/path/index.html localhost 127.0.0.1 database connection postgres mysql redis "
    "environment variable getenv setenv process.env os.environ process.argv module.exports "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 changeme placeholder example dummy "
    "your_api_key_here xxxxxxxxxxxxxxxx 0000000000000000 1111111111111111 the and that with from this have "
)
#: Words of running text, for its letters (fixed values).
PROSE = (
    "the of and to in that was for with they this have from one had word but not what all were when your there use each which their will other about many then them these some would make like into time look two more write number way could people than first water been call who find long down day did get come made may part over new sound take only little work know place year live back give most very after thing our just name good sentence man think great where help through much before line right mean old any same tell following came want show also around "
    "der die und das ist nicht ein eine werden auch nach wird sich mit von haben sein wissenschaft gesellschaft entwicklung "
    "les des une que pour dans est qui avec sur pas plus sont leur nous cette comme tout elle deux entre mouvement "
    "los las del por con para como pero sus este cuando muy sin sobre ser tiene hasta donde desde todo estados"
)
#: What every measured text begins with, so that short ones do not pay for the first match.
FRAME = b"default config value: response header, session cookie; const string = getenv("
#: Size of the trained dictionary, and the texts of words in seeded order that it is trained on.
DICTIONARY_BYTES, TRAINED_ON, SEED = 8192, 400, 7


#: Turns between small letters, capitals and digits, but for the small letter that follows a capital, and how many a short candidate has.
TURN, TURNS = re.compile(r"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[0-9]|(?<=[0-9])[A-Za-z]"), 4
#: Seeded random strings that short candidates are compared with, and the share of them that cost less than is asked.
DRAWN, BELOW = 64, 0.05


@cache
def _candidate(shortest: int) -> re.Pattern[str]:
    return re.compile(rf"[A-Za-z0-9+/_.=~-]{{{shortest},}}")


@cache
def _dictionary() -> zstandard.ZstdCompressionDict:
    draw, names, words = random.Random(SEED), COMMON.split(), 2 * PROSE.split()
    half = len(names) // 2
    texts = [" ".join([*(names[:half] if i % 2 else names[half:]), *draw.sample(words, 60)]) for i in range(TRAINED_ON)]
    return zstandard.train_dictionary(DICTIONARY_BYTES, [t.encode() for t in texts], level=LEVEL)


def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(), write_content_size=False, write_checksum=False)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return spans + [(*m.span(), "hex") for m in HEX.finditer(text)]


def _surroundings(part: Callable[[int], str], value: str) -> str:
    """Text beside a value without the value's other occurrences, so wide that none is cut within the nearest AROUND characters."""
    width = AROUND + len(value)
    while True:
        beside = part(width)
        found = beside.replace(value, "")
        if len(found) >= AROUND + len(value) - 1 or len(beside) < width:
            return found
        width *= 2


def novelty(text: str, start: int, end: int, compressor: zstandard.ZstdCompressor) -> float:
    """Compressed bytes a character: what the value adds to its surroundings, or its own, whichever is less. Letters of upper case only are taken in lower case."""
    value = text[start:end]
    before = _surroundings(lambda width: text[max(0, start - width) : start], value)[-AROUND:].encode("utf-8", "replace")
    after = _surroundings(lambda width: text[end : end + width], value)[:AROUND].encode("utf-8", "replace")
    found = (value.lower() if value.isupper() and not any(c.isdigit() for c in value) else value).encode()
    size = lambda data: len(compressor.compress(FRAME + data))
    return min(size(before + after + found) - size(before + after), size(found) - size(b"")) / len(found)


@cache
def random_novelty(length: int) -> float:
    """What nearly all random strings of letters and digits of a length cost a character, by themselves."""
    draw, compressor, signs = random.Random(SEED + length), _compressor(), string.ascii_letters + string.digits
    base = len(compressor.compress(FRAME))
    costs = sorted(len(compressor.compress(FRAME + "".join(draw.choices(signs, k=length)).encode())) - base for _ in range(DRAWN))
    return costs[int(BELOW * DRAWN)] / length


def is_novel(text: str, start: int, end: int, compressor: zstandard.ZstdCompressor) -> bool:
    """Whether a candidate costs as much as keys do."""
    if end - start >= USUAL:
        return novelty(text, start, end, compressor) >= NOVELTY
    return len(TURN.findall(text[start:end])) >= TURNS and novelty(text, start, end, compressor) >= random_novelty(end - start)


def _values(text: str, start: int, end: int, ends: list[int], shortest: int, reach: int) -> list[tuple[int, int]]:
    """Candidates of a run (start to end) that holds sensitive words, which end at ends: what follows a word's key separators, or else the word's own.

    Of words whose own values end together only the first and the last word's count.
    """
    padding = end - (len(text[start:end]) - len(text[start:end].rstrip("=")))
    cuts = [i for i in range(start, end) if text[i] == "="]
    stops = [c for c in cuts if c < padding] + [end]
    behind = [(c + 1, stop) for c, stop in zip([c for c in cuts if c < padding], stops[1:], strict=True) if stop - c > shortest and text[c + 1] != "="]
    found: set[tuple[int, int]] = set()
    own: dict[int, list[tuple[int, int]]] = {}
    for word in ends:
        if end - word < shortest:
            break
        at = bisect_right(behind, (word, end))
        if at < len(behind):
            found.update(takewhile(lambda v, limit=word + reach: v[0] < limit, islice(behind, at, None)))
        elif signs := SIGNS.match(text, word, end):
            value = signs.end(), stops[bisect_left(stops, signs.end())]
            if value[1] - value[0] >= shortest and value[0] < word + reach:
                own.setdefault(value[1], []).append(value)
    for values in own.values():
        found |= {values[0], values[-1]}
    return sorted(found)


def candidates(text: str, shortest: int = SHORTEST, reach: int = REACH) -> list[tuple[int, int]]:
    """Runs of shortest characters or more that start within reach characters after a sensitive word, and the values in runs that hold one; in time linear in the text."""
    words = [m.end() for m in SENSITIVE.finditer(text)]
    found: list[tuple[int, int]] = []
    seen = 0
    for run in _candidate(shortest).finditer(text) if words else ():
        start, end = run.span()
        while seen < len(words) and words[seen] <= start:
            seen += 1
        if seen and start - words[seen - 1] < reach:
            found.append((start, end))
        inside = seen
        while seen < len(words) and words[seen] <= end:
            seen += 1
        if inside < seen:
            found += _values(text, start, end, words[inside:seen], shortest, reach)
    return sorted(set(found), key=lambda s: (s[0], -s[1]))


def novel_spans(text: str, taken: list[tuple[int, int, str]], compressor: zstandard.ZstdCompressor, shortest: int = SHORTEST, reach: int = REACH) -> list[tuple[int, int, str]]:
    """Incompressible candidates after sensitive words, outside the spans that are there and not within one another."""
    fixed = sorted((s, e) for s, e, _ in taken)
    starts, ends = [s for s, _ in fixed], list(accumulate((e for _, e in fixed), max))
    out: list[tuple[int, int, str]] = []
    for start, end in candidates(text, shortest, reach):
        before = bisect_left(starts, end)
        if (before and ends[before - 1] > start) or (out and out[-1][1] >= end):
            continue
        if is_novel(text, start, end, compressor):
            out.append((start, end, "novel"))
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, reach: int = REACH) -> DataFrame:
    """One row per row of docs: counts by kind, a digest of the fixed spans, all spans. shortest and reach bound candidates of the kind novel only."""
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")]
        + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
        + [T.StructField("n_novel", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor()
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = novel_spans(text, base, compressor, shortest, reach)
                kinds = [s[2] for s in base]
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more), len(more)))
            columns = [pa.array([r[i] for r in rows], pa.string() if i in (3, 4) else pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES: dict[str, str] = {}
