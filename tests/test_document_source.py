"""Folders of documents as a data source."""

import json

import pytest

from tarnwell.sources import document_source as source


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    (root / "deep").mkdir()
    (root / "a.txt").write_bytes("été".encode("latin-1"))
    (root / "deep" / "b.md").write_text("﻿# title", "utf-8")
    (root / "c.docx").write_bytes(b"not a zip file")
    (root / "d.pdf").write_bytes(b"%PDF")
    (root / "e.bin").write_bytes(b"x")
    (root / "f.rtf").write_text(r"{\rtf1 plain \b bold\b0\par}")
    lines = [json.dumps({"i": i, "pad": "x" * (i * 37 % 400)}) for i in range(200)]
    (root / "log.jsonl").write_text("\n".join(lines[:150]) + "\n\n" + "\n".join(lines[150:]))
    return root, lines


def test_documents(spark, folder):
    root, lines = folder
    source.register(spark)
    rows = {r["path"].rpartition("/")[2]: r for r in spark.read.format("documents").load(str(root)).where("line IS NULL").collect()}
    assert {k: r["text"] for k, r in rows.items()} == {"a.txt": "été", "b.md": "# title", "c.docx": None, "d.pdf": None, "f.rtf": rows["f.rtf"]["text"]}
    assert rows["f.rtf"]["text"].split() == ["plain", "bold"] and (rows["c.docx"]["error"], rows["d.pdf"]["error"]) == ("parser_failed:docx", "parser_missing:pdf")


@pytest.mark.parametrize("pack", [1, 100, 1000, 1 << 20])
def test_lines_by_ranges_of_bytes(spark, folder, pack, monkeypatch):
    root, lines = folder
    monkeypatch.setattr(source, "READ", 64)
    reader = source.DocumentReader(str(root), pack)
    reader.rules = [("suffix", lambda x, y: x == y, ".jsonl")]
    parts = reader.partitions()
    rows = [r for p in parts for r in reader.read(p)]
    assert [r[4] for r in rows] == lines and len({r[3] for r in rows}) == 200
    assert len(parts) == max(1, -(-rows[0][2] // pack))


def test_ruled_out_files_are_not_opened(spark, folder):
    root, lines = folder
    source.register(spark)
    df = spark.read.format("documents").option("pack", 1).load(str(root))
    few = df.where("suffix = '.txt'")
    assert few.rdd.getNumPartitions() == 1 and few.count() == 1
    assert df.where("suffix IN ('.txt', '.md') AND bytes < 1000").rdd.getNumPartitions() == 2
    big = spark.read.format("documents").option("pack", 2000).load(str(root)).where("suffix = '.jsonl'")
    assert big.rdd.getNumPartitions() > 5 and sorted(r["text"] for r in big.collect()) == sorted(lines)
