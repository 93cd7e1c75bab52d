"""Fingerprints, collocations and manifests against plain Python, with the awkward cases."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tarnwell.llm import collocations, fingerprints, manifest

from .helpers import awkward, clashing, empty


# --- fingerprints -------------------------------------------------------------------


def plain_fingerprint(text):
    data = text.encode()
    counts = [0] * fingerprints.BUCKETS
    for i in range(len(data)):
        x, y, z = (data[(i + gap) % len(data)] for gap in fingerprints.GAPS)
        counts[(x + 256 * y + 65536 * z) * fingerprints.MULTIPLIER % 2**32 >> 32 - fingerprints.BITS] += 1
    ordered = sorted(counts)
    cuts = [ordered[fingerprints.BUCKETS * q // 4 - 1] for q in (1, 2, 3)]
    codes = [sum(c > cut for cut in cuts) for c in counts]
    n, octave = len(data), len(data).bit_length() - 1
    length = 0 if not n else 1 + 4 * octave + int(4 * n / 2**octave) % 4
    return length, codes


def plain_likeness(one, other):
    (a, x), (b, y) = plain_fingerprint(one), plain_fingerprint(other)
    bound = max(1, min(fingerprints.BUCKETS, sum(x) + sum(y)))
    return 1 - min(bound, sum(abs(p - q) for p, q in zip(x, y, strict=True)) + fingerprints.STEP_WEIGHT * abs(a - b)) / bound


@pytest.mark.parametrize("text", ["", "a", "ab", "é", "one two three", "x" * 5000, "日本語 text " * 40])
def test_fingerprint_of_a_text(text, monkeypatch):
    length, codes = plain_fingerprint(text)
    expected = f"{length:02x}" + "".join(f"{4 * a + b:x}" for a, b in zip(codes[::2], codes[1::2], strict=True))
    assert fingerprints.fingerprint(text) == expected
    monkeypatch.setattr(fingerprints, "CHUNK", 64)
    assert fingerprints.fingerprint(text) == expected


def test_likeness_tells_edits_from_other_texts():
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(draw.choices(words, k=draw.randint(80, 400))) for _ in range(60)]
    marks = [fingerprints.fingerprint(t) for t in texts]
    near = [fingerprints.likeness(m, fingerprints.fingerprint(fingerprints.edited(t, texts[i - 1]))) for i, (t, m) in enumerate(zip(texts, marks, strict=True))]
    far = [fingerprints.likeness(a, b) for a, b in zip(marks, marks[1:], strict=False)]
    assert min(near) > max(far) and all(fingerprints.likeness(m, m) == 1 for m in marks)
    assert fingerprints.likeness(marks[0], marks[1]) == plain_likeness(texts[0], texts[1])


def test_edited_and_next(spark):
    docs = awkward(spark)
    order = sorted([r for r in docs.collect()], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    nulls = [r for r in order if r["doc_id"] is None]
    rows = fingerprints.edited_and_next(clashing(docs)).collect()
    assert len(rows) == 12 and {r["doc_id"] for r in rows} == {r["doc_id"] for r in order}
    # The two rows without id stand by a hash; either order is tried.
    outcomes = []
    for turn in (nulls, nulls[::-1]):
        texts = [(r["doc_id"], r["text"] or "") for r in turn + order[len(nulls) :]]
        outcome = []
        for i, (ident, text) in enumerate(texts):
            following = texts[(i + 1) % len(texts)][1]
            k = len(text) // 4
            new = text[: len(text) - k] + following[:k]
            outcome.append((ident, len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprints.fingerprint(text), fingerprints.fingerprint(new), plain_likeness(text, new), plain_likeness(text, following)))
        outcomes.append(sorted(outcome, key=repr))
    assert sorted((tuple(r) for r in rows), key=repr) in outcomes
    one = docs.where("doc_id = 10")
    assert fingerprints.edited_and_next(one).first()["near_next"] == 1 and fingerprints.edited_and_next(empty(spark)).count() == 0
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(clashing(docs)).collect()}
    assert all(plain[r["doc_id"]] == r["fingerprint"] for r in rows if r["doc_id"] is not None)


# --- collocations -------------------------------------------------------------------


def plain_collocations(rows, least, top, longest=5):
    out = []
    for lang in {l if l is not None else "und" for _, l in rows}:
        f, n = Counter(), 0
        for text, name in rows:
            if (name if name is not None else "und") != lang:
                continue
            lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                for m in range(1, longest + 1):
                    f.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
        found = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            inside = lambda long, phrase=phrase: any(long[i : i + len(phrase)] == phrase for i in range(len(long) - len(phrase) + 1))
            if any(len(q) > len(phrase) and b >= least and 100 * b >= 100 * a and inside(q) for q, b in f.items()):
                continue
            score, _, l, r = min((1000 * a * n // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]]) for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed=4, texts=260):
    draw = random.Random(seed)
    words = ["the", "of", "a", "rare", "ÉTÉ", "x-y", "\x01odd", "日本"] + [f"w{i}" for i in range(12)]
    rows = []
    for i in range(texts):
        parts = [draw.choice([draw.choice(words), "over and over and over", "New York City hall", "a a a a a"]) for _ in range(draw.randint(0, 25))]
        rows.append(("".join(p + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", ";x"]) for p in parts), ("en", "de", None)[i % 3]))
    return [*rows, (None, "en"), ("", "en"), (" . ,\n", None), ("the of " * 3000, "de"), ("only", "nl")]


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_collocations(spark, monkeypatch, chunk):
    monkeypatch.setattr(collocations, "chunks", lambda batches, whole=collocations.chunks: whole(batches, chunk))
    rows = corpus()
    docs = clashing(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    for least, top in ((12, 2000), (40, 5)):
        found = collocations.collocations(docs, least=least, top=top).collect()
        assert sorted(tuple(r) for r in found) == plain_collocations(rows, least, top)
    assert len(found) > 8


def test_collocations_need_no_good_hash(spark, monkeypatch):
    """Phrases of one hash are found to be too few and counted by their texts."""
    rows = corpus(5, 60)
    expected = Counter()
    for text, lang in rows:
        if lang == "en":
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
                words = re.findall(r"[^\x20\x09]+", piece)
                for m in (1, 2, 3):
                    expected.update(" ".join(words[i : i + m]) for i in range(len(words) - m + 1))
    data = b"\n".join(collocations.normal(t or "") for t, lang in rows if lang == "en")
    monkeypatch.setattr(collocations, "_mixed", lambda h: h % 3)
    found = dict(collocations.scanned("en", data, collocations.Bounds({}), 3))
    assert {k[1:-1]: v for k, v in found.items()} == expected


def test_long_texts_are_cut_between_pieces():
    text = ". ".join(f"piece {i} of many words" for i in range(500))
    parts = list(collocations._parts(collocations.normal(text), 100))
    assert len(parts) > 50 and all(p[:1] == p[-1:] == b" " for p in parts)
    assert b" \n".join(parts).split() == collocations.normal(text).split()


def test_collocations_of_nothing(spark):
    assert collocations.collocations(empty(spark)).count() == 0


# --- manifest -----------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    values = [None if v is None else str(v) for v in row]
    return digest(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def plain_tree(leaves):
    """The last node and for each leaf its sides, level by level."""
    sides, place = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        runs = [leaves[i : i + 16] for i in range(0, len(leaves), 16)]
        for path, (i, at) in zip(sides, enumerate(place), strict=True):
            run = runs[at // 16]
            path.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
            place[i] = at // 16
        leaves = [digest(*run) for run in runs]
    return leaves[0], sides


def plain_manifest(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))):
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([plain_leaf(r) for r in groups[s]]) for s in names}
    root, above = plain_tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for row, path in zip(groups[s], trees[s][1], strict=True):
            path = path + up
            other = list(row)
            if row[0] is not None and crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                other[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
            node = plain_leaf(other)
            for before, after in path:
                node = digest(before, node, after)
            out.append((row[0], plain_leaf(row), trees[s][0], root, digest(*[x for pair in path for x in pair]), node, node == root))
    return sorted(out, key=repr)


def changed():
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return {"text": F.when(hit, F.translate("text", manifest.UPPER, manifest.LOWER)).otherwise(F.col("text"))}


@pytest.mark.parametrize("sources", [1, 3, 40])
def test_manifest(spark, sources):
    draw = random.Random(sources)
    rows = [(i * 7 % 1000, draw.choice([None, *[f"é{s}" for s in range(sources)]]), draw.choice(["en", None]), draw.choice([None, i]), draw.choice([None, "", "Some Text é", "none"])) for i in range(700)]
    rows += [(5000 + i, "hot", "en", 1, f"Hot {i}") for i in range(400)] + [(6000, "lone", "en", 1, "Lone")]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    docs = clashing(spark.createDataFrame(rows, schema).repartition(5))
    found = manifest.manifest(docs, changed=changed())
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_manifest(rows)
    assert 0 < found.where("verified").count() < len(rows)


def test_manifest_of_awkward_rows(spark):
    docs = awkward(spark).select(*manifest.FIELDS)
    rows = [tuple(r) for r in docs.collect()]
    found = manifest.manifest(clashing(docs), changed=changed()).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_manifest(rows)
    one = manifest.manifest(docs.where("doc_id = 1")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"] and one["proof_sha256"] == digest("")
    assert manifest.manifest(empty(spark), changed=changed()).count() == 0
