"""Readers and sinks: data files by suffix, catalogs, JSON lines, document folders."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.sources.stores import store

#: Missing-value spellings of CSV cells (fixed values).
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "<NA>", "#N/A")
SUFFIXES = (".csv", ".json", ".jsonl", ".ndjson", ".parquet")
DOCUMENTS = (".md", ".txt", ".pdf", ".docx", ".rtf")
DOCUMENT_LIMIT = 200_000


def read_one(spark: SparkSession, path: str) -> DataFrame:
    """One file by suffix: parquet, csv with header, JSON lines or a JSON array."""
    suffix = "." + path.rstrip("/").rpartition(".")[2].lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        return _tidied(spark.read.csv(path, header=True, inferSchema=True, nullValue="NA"))
    if suffix in (".jsonl", ".ndjson"):
        return spark.read.json(path)
    if suffix == ".json":
        return spark.read.json(path, multiLine=True)
    raise ValueError(f"unsupported file: {path}")


def _tidied(df: DataFrame) -> DataFrame:
    """Strings that mean a missing value become null."""
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"})


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every supported file of a folder by stem, in sorted order; a later suffix wins; sub-folders that are not parquet tables are skipped. Each is a temporary view too."""
    fs, root = store(folder)
    found = {}
    for info in sorted(fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)), key=lambda i: i.base_name):
        stem, dot, kind = info.base_name.rpartition(".")
        if stem and dot + kind.lower() in SUFFIXES and (info.is_file or kind.lower() == "parquet"):
            found[stem] = read_one(spark, f"{folder.rstrip('/')}/{info.base_name}")
            found[stem].createOrReplaceTempView(stem)
    return found


def write_text(folder: str, name: str, text: str) -> None:
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}") as out:
        out.write(text.encode())


def read_texts(folder: str, suffix: str) -> dict[str, str]:
    """The files of a folder with this suffix, by stem."""
    fs, path = store(folder)
    found = {}
    for info in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):
        if info.is_file and info.base_name.endswith(suffix):
            with fs.open_input_file(info.path) as file:
                found[info.base_name.removesuffix(suffix)] = file.read().decode()
    return found


def write_joined(df: DataFrame, path: str) -> DataFrame:
    """Write a joined frame and read it back, which cuts its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append_jsonl(path: str | Path, row: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8") as out:
        out.write(json.dumps(row, default=str) + "\n")


def read_jsonl(path: str | Path) -> list[dict]:
    """Rows of a log; lines that do not parse are skipped."""
    rows = []
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else ():
        try:
            rows.append(json.loads(line))
        except ValueError:
            continue
    return [r for r in rows if isinstance(r, dict)]


def log_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log as a table; malformed lines give null rows, which are left out."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return df.where(F.coalesce(*[F.col(c).isNotNull() for c in df.columns[:1]], F.lit(False)))


def documents(spark: SparkSession, paths: str | Iterable[str], limit: int | None = None) -> DataFrame:
    """path, suffix, n_chars, text, error, truncated of each document; formats without a parser are listed with an error.

    Texts are whole unless a limit (DOCUMENT_LIMIT is the usual one) is given.
    """
    raw = spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = raw.select("path", suffix.alias("suffix"), "content").where(F.col("suffix").isin(*DOCUMENTS))
    plain, packed = F.col("suffix").isin(".md", ".txt"), F.col("suffix").isin(".docx", ".rtf")
    text = F.when(plain, F.coalesce(F.expr("try_validate_utf8(cast(content as string))"), F.decode("content", "ISO-8859-1")))
    text = F.when(packed, _parsed(F.col("suffix"), F.col("content"))).otherwise(F.regexp_replace(text, "^\ufeff", ""))
    rows = rows.withColumn("text", text).withColumn("truncated", F.coalesce(F.length("text") > F.lit(limit), F.lit(False)))
    missing = F.when(~plain & ~packed, F.concat(F.lit("parser_missing:"), F.substring("suffix", 2, 10)))
    error = F.coalesce(missing, F.when(packed & F.col("text").isNull(), F.concat(F.lit("parser_failed:"), F.substring("suffix", 2, 10))))
    kept = F.col("text") if limit is None else F.substring("text", 1, limit)
    return rows.select("path", "suffix", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), kept.alias("text"), error.alias("error"), "truncated")


@F.pandas_udf(T.StringType())
def _parsed(suffix: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([parsed_text(s, bytes(c)) for s, c in zip(suffix, content, strict=True)], dtype=object)


def parsed_text(suffix: str, content: bytes) -> str | None:
    """The paragraphs of a .docx or .rtf file; None if it is none."""
    try:
        return docx_text(content) if suffix == ".docx" else rtf_text(content) if suffix == ".rtf" else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, UnicodeError, ValueError):
        return None


def docx_text(content: bytes) -> str:
    """Text runs, tabs and breaks of a document's main part, a line for each paragraph."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    marks = {f"{name}tab": "\t", f"{name}br": "\n", f"{name}cr": "\n"}
    return "\n".join("".join(e.text or "" if e.tag == f"{name}t" else marks.get(e.tag, "") for e in p.iter()) for p in root.iter(f"{name}p"))


#: Groups of an .rtf file that are not text, and control words that are signs (fixed values).
RTF_HIDDEN = frozenset({"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "object", "themedata"})
RTF_SIGNS = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "\u2014", "endash": "\u2013", "bullet": "\u2022", "lquote": "\u2018", "rquote": "\u2019", "ldblquote": "\u201c", "rdblquote": "\u201d", "cell": "\t", "row": "\n"}
_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.I)


def rtf_text(content: bytes) -> str:
    """The visible text of an .rtf file."""
    source = content.decode("latin-1")
    if not source.startswith("{\\rtf"):
        raise ValueError("not an .rtf file")
    out: list[str] = []
    hidden, skip, width = False, 0, 1
    stack: list[tuple[bool, int]] = []
    for word, number, code, sign, brace, plain in _RTF.findall(source):
        if brace == "{":
            stack.append((hidden, width))
        elif brace == "}":
            hidden, width = stack.pop() if stack else (False, 1)
        elif sign == "*" or word.lower() in RTF_HIDDEN:
            hidden = True
        elif word == "uc":
            width = int(number or 1)
        elif hidden:
            continue
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            skip = width
        elif word:
            out.append(RTF_SIGNS.get(word, ""))
        elif code:
            out.append("" if skip else bytes([int(code, 16)]).decode("cp1252", "replace"))
            skip = max(0, skip - 1)
        elif sign:
            out.append({"~": "\u00a0", "_": "\u2011", "-": ""}.get(sign, sign if sign in "\\{}" else ""))
        elif plain:
            out.append(plain[skip:])
            skip = max(0, skip - len(plain))
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


def latest_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert of an index: of rows with one key the one with the greatest order stays, by a combining aggregate."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row"))
    return best.select("row.*")


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with one key the one with the least order, by a combining aggregate."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def pair_upsert(held: DataFrame, new: DataFrame, a: str, b: str, strength: str, most: int) -> DataFrame:
    """Unordered pairs: new ones replace those held; the strongest stay."""
    ordered = lambda df: df.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), *[c for c in df.columns if c not in (a, b)])
    held, new = ordered(held), ordered(new)
    return new.unionByName(held.join(new.select(a, b), [a, b], "left_anti")).orderBy(F.desc(strength), a, b).limit(most)
