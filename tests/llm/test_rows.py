"""Operators that look at one text at a time, and the ones that fit a model, against plain Python."""

import hashlib
import re
from pathlib import Path

import numpy as np
import pytest

from tarnwell.llm import license_scan, quality_classifier, quality_rules, secret_scan, toxicity

from .helpers import SENTENCE, awkward, clashing, empty


def brute_repeats(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return len(hit)


@pytest.mark.parametrize("text", ["", "a b", "a b c d e f " * 3, "x\nx\n\nx y\nx y", SENTENCE * 2 + "tail", "a a a a a a a a", "A#b $5 <i>"])
def test_base_features(text):
    (n, chars, symbols, dup, repeats), _, failed = quality_rules.measure(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    assert n == len(words) and chars == sum(map(len, words)) and symbols == len(re.findall(r"[#*$%&|<>]", text))
    assert dup == sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    assert repeats == brute_repeats(words)
    assert failed == (n < 10 or 100 * repeats > 20 * n)


def test_posteriors_separate_and_do_not_depend_on_order():
    good, bad = sum(1 * 3**i for i in range(8)), sum((0 if i in (0, 1, 3, 4, 6) else 1) * 3**i for i in range(8))
    found = quality_rules.posteriors({good: 900, bad: 100})
    assert found[good] > 0.9 > 0.5 > found[bad]
    assert quality_rules.posteriors({bad: 100, good: 900}) == found
    assert quality_rules.posteriors({}) == {}


def test_quality_rules_rows(spark):
    docs = awkward(spark)
    rows = quality_rules.judged(clashing(docs)).collect()
    assert len(rows) == docs.count() and not any(r["kept"] for r in rows if r["n_words"] < 10)
    kept = quality_rules.kept_rows(clashing(docs))
    assert kept.columns == clashing(docs).columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality_rules.judged(empty(spark)).count() == quality_rules.kept_rows(empty(spark)).count() == 0


def test_licenses(spark):
    mit = license_scan._MIT
    docs = spark.createDataFrame([(1, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ,")), (2, "text\nReleased under the MIT Licence!\nmore"), (3, None), (4, mit + " changed")], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in license_scan.licenses(clashing(docs)).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, ""), 4: (None, "")}
    assert license_scan.licenses(empty(spark)).count() == 0


def test_licenses_of_a_given_table(spark):
    full = "GNU GENERAL PUBLIC LICENSE\nVersion 3\n" + SENTENCE * 400
    docs = spark.createDataFrame([(1, full.lower()), (2, license_scan._MIT), (3, full + "more")], "doc_id long, text string")
    of = lambda **table: {r["doc_id"]: r["license"] for r in license_scan.licenses(docs, **table).collect()}
    assert of() == {1: None, 2: "MIT", 3: None}
    assert of(entire_texts=(*license_scan.LICENSES, ("GPL-3.0", full))) == {1: "GPL-3.0", 2: "MIT", 3: None}


def test_secret_spans(spark):
    key = "q9Xz7Lw2Rk8Tn4Vb6Yp1"
    text = f'é api_key = "{key}" and AKIA{"A1B2C3D4E5F6"} then {"0f" * 20}'
    base = secret_scan.base_spans(text)
    assert [k for _, _, k in base] == ["assign", "access", "hex"]
    assert text[base[0][0] : base[0][1]].startswith("api_key") and text[base[2][0] : base[2][1]] == "0f" * 20
    docs = spark.createDataFrame([(1, text), (2, None), (3, "token = short"), (4, f"bearer {key}"), (5, "bearer authorization_header")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in secret_scan.secrets(clashing(docs)).collect()}
    assert rows[1]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
    assert rows[2]["spans"] == rows[3]["spans"] == rows[5]["spans"] == "" and rows[4]["n_novel"] == 1
    assert secret_scan.secrets(empty(spark)).count() == 0


def test_secret_spans_drop_failing_matches_without_looking_again():
    assert secret_scan.base_spans("token = token = abcdefgh12") == []
    assert secret_scan.base_spans("ſecret = abcdefgh12") == []  # only ASCII letters fold


def _novel(text):
    return [text[s:e] for s, e, _ in secret_scan.novel_spans(text, secret_scan.base_spans(text), secret_scan._compressor())]


@pytest.mark.parametrize("before", ["AWS_SECRET_ACCESS_KEY=", "private_key=", "auth=", "export DB_AUTH=", "x.private_key==", "bearer-", "auth_", "private/"])
def test_novel_values_behind_a_sensitive_word(before):
    for value in ("wJalrXUt7nFEMI/K7MDENG/bPx2RfiCYzQ8", "q9Xz7Lw2Rk8Tn4Vb6Yp1", "q9Xz7Lw2Rk8Tn4Vb6Yp1Zg=="):
        assert _novel(f"{before}{value}\nnext line") == [value]
    assert _novel(f"{before}short1") == [] == _novel(f"{before}authorization_header")


@pytest.mark.parametrize("gap", [0, 10, 48, 49, 50, 62])
def test_novel_values_up_to_reach(gap):
    key = "q9Xz7Lw2Rk8Tn4Vb6Yp1"
    assert _novel("bearer " + " " * gap + key) == [key]
    assert _novel("bearer" + " " * secret_scan.REACH + key) == []


@pytest.mark.parametrize("gap", [1, 100, 215, 225, 245])
def test_novel_values_that_stand_twice(gap):
    key = "q9Xz7Lw2Rk8Tn4Vb6Yp1"
    assert _novel(f"bearer {key}" + "\n" * gap + f"bearer {key}") == [key, key]
    assert _novel((f"bearer {key}" + " " * (gap % 7) + "\n") * 40) == [key] * 40


@pytest.mark.parametrize("before", ["private bearer ", "auth_", "MY_AUTH="])
def test_novel_values_of_letters_only_but_no_words(before):
    for value in ("QJMUayYVGZiHdExKJmGAFwAwOlJLlfZJZqcRxBtV", "nrudfuxjdxkxqpzvjwkxhbgyqvmcfjzkwpxdbqgh"):
        assert _novel(f"{before}{value}\nnext") == [value]
    for word in ("Donaudampfschifffahrtsgesellschaft", "internationalization", "get_private_key_from_environment", "einheitliche_schnittstelle"):
        assert _novel(f"{before}{word}\nnext") == []


def test_novel_short_values_and_parameters():
    for value in ("q9Xz7Lw2Rk8T", "4f9a0c7e1b3d52", "Zk3vQ81xPw0Lm"):
        assert _novel(f"my private bearer {value}\nnext") == [value]
    code = "user token max_tokens2 secretKeyFactory utf8_general_ci md5sumChecker apiV2Endpoint base64Decode oauth2Provider version_12.345 2024-11-27T10:00"
    assert _novel(code) == []
    compressor, text = secret_scan._compressor(), f"bearer{' ' * 200}q9Xz7Lw2Rk8Tn4Vb6Yp1 and auth H4jW8sB2Dm"
    spans = lambda **bounds: [text[s:e] for s, e, _ in secret_scan.novel_spans(text, [], compressor, **bounds)]
    assert spans() == [] and spans(reach=300) == ["q9Xz7Lw2Rk8Tn4Vb6Yp1"] and spans(shortest=10) == ["H4jW8sB2Dm"]


def test_novelty_asked_of_short_values_is_that_of_random_ones():
    import random
    import string

    draw, compressor = random.Random(1), secret_scan._compressor()
    for length in range(12, secret_scan.USUAL):
        values = ["".join(draw.choices(string.ascii_letters + string.digits, k=length)) for _ in range(100)]
        assert sum(secret_scan.novelty(f"bearer {v} and", 7, 7 + length, compressor) >= secret_scan.random_novelty(length) for v in values) >= 90


def _quick(text):
    import time

    began = time.perf_counter()
    found = _novel(text)
    assert time.perf_counter() - began < 5
    return found


def test_novel_values_of_very_long_texts_take_linear_time():
    key, million = "q9Xz7Lw2Rk8Tn4Vb6Yp1", 1_000_000
    assert _quick("key" * (million // 3)) == [] == _quick("key_" * (million // 4)) == _quick("key =" * (million // 5))
    assert _quick("key=" * (million // 4) + key) == [key]
    assert _quick("token " * (million // 6) + key) == [key]
    assert _quick("a" * million + f" bearer {key} " + "b" * million) == [key]
    assert len(_quick(f"bearer {key}\n" * 3000)) == 3000


def test_novel_values_of_runs_with_several_words():
    key = "q9Xz7Lw2Rk8Tn4Vb6Yp1"
    assert _novel(f"secret_of_auth_{key}") in ([key], [f"of_auth_{key}"])
    # The second string starts within reach of the first word, so it is taken whole.
    assert _novel(f"a_key={key}&b_auth={key[::-1]}") == [key, f"b_auth={key[::-1]}"]
    assert _novel(f"a_key={key}&{'b ' * 40}b_auth={key[::-1]}") == [key, key[::-1]]


def _spans_by_the_rules(text):
    """The fixed spans, read from the rules sign by sign."""
    words = ("password", "passwd", "secret", "token", "apikey", "api_key")
    low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

    def run(at, signs):
        while at < len(text) and text[at] in signs:
            at += 1
        return at

    def assign(at):
        for word in words:
            if low.startswith(word, at):
                for quote in (1, 0):
                    p = at + len(word)
                    if quote:
                        if text[p : p + 1] not in ('"', "'"):
                            continue
                        p += 1
                    p = run(p, " ")
                    if text[p : p + 1] not in (":", "="):
                        continue
                    p = run(p + 1, " ")
                    p += text[p : p + 1] in ('"', "'") and bool(text[p : p + 1])
                    if (end := run(p, value)) > p:
                        return end, end - p >= 8
        return None

    found, at = [], 0
    while at < len(text):
        if got := assign(at):
            if got[1]:
                found.append((at, got[0], "assign"))
            at = got[0]
        else:
            at += 1
    at = 0
    while at < len(text):
        end = run(at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) if text.startswith("AKIA", at) else at
        if end > at + 4 and end - at >= 16:
            found.append((at, end, "access"))
        at = end if end > at + 4 else at + 1
    at = 0
    while at < len(text):
        end = run(at, set("0123456789abcdef"))
        if end - at >= 32:
            found.append((at, end, "hex"))
        at = max(end, at + 1)
    return sorted(found)


def test_base_spans_follow_the_rules():
    import random

    draw = random.Random(8)
    parts = ["token", "Secret", "PASSWORD", "passwd", "api_key", "apikey", '"', "'", " ", ":", "=", "==", "abcdefgh", "x1+/_.-", "AKIA", "A1B2C3D4E5F6", "0f" * 16, "0f" * 3, "é", "ſ", "\n", "\u212a"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 14)))
        assert sorted(secret_scan.base_spans(text)) == _spans_by_the_rules(text), text


def test_secret_rows_of_awkward_texts(spark):
    rows = secret_scan.secrets(clashing(awkward(spark))).collect()
    assert len(rows) == 12 and all(r["spans"] == "" for r in rows)


def test_licenses_in_their_published_layouts(spark):
    """Wrapped lines, holders, list marks and headings as the licences are published."""
    isc = "ISC License\n\nCopyright (c) 2004-2010 by Some Consortium\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n" + "\n".join(_wrapped(license_scan._ISC_WARRANTY, 70))
    bsd = "Copyright (c) 1998, Regents of a University\nAll rights reserved.\n\n" + "\n".join(_wrapped(f"{license_scan._BSD_HEAD}\n{license_scan._BSD_3}\n{license_scan._BSD_TAIL}".replace("COPYRIGHT HOLDER OR", "COPYRIGHT\nOWNER OR"), 60)).replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    mit = "The MIT License (MIT)\n\nCopyright © 2015 Somebody <a@b.example>\n\n" + "\n".join(_wrapped(license_scan._MIT.replace("sublicense", "sub-license"), 64))
    holders = "Copyright Somebody\n\n" + license_scan._MIT
    rows = [(1, isc), (2, bsd), (3, mit), (4, holders), (5, mit.replace("THE SOFTWARE IS", "THE  SOFTWARE\tIS")), (6, isc * 2), (7, "x " * 300_000 + mit)]
    got = {r["doc_id"]: r["license"] for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "ISC", 2: "BSD-3-Clause", 3: "MIT", 4: None, 5: "MIT", 6: None, 7: None}


def _wrapped(text, width):
    import textwrap

    return [line for part in text.split("\n") for line in textwrap.wrap(part, width)]


def test_license_rows_of_awkward_texts(spark):
    rows = license_scan.licenses(clashing(awkward(spark))).collect()
    assert len(rows) == 12 and {r["license"] for r in rows} == {None}
    by = {r["doc_id"]: r["canon_sha256"] for r in rows}
    assert by[3] == by[4] == by[9] and by[1] == by[2] and len({r["canon_sha256"] for r in rows if r["doc_id"] == 6}) == 1


def _labelled(spark, bad):
    docs = [(i, SENTENCE + f"number{i} " + (bad if i % 3 == 0 else "kind")) for i in range(240)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = _labelled(spark, "you moron")
    model = toxicity.fitted(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = {r["doc_id"]: r for r in toxicity.graded(clashing(docs), model).collect()}
    assert all(rows[i]["toxic"] == (i % 3 == 0) for i in rows)
    assert all(0 <= r["expected_severity"] <= toxicity.GRADES - 1 for r in rows.values())
    odd = toxicity.graded(awkward(spark), model).collect()
    assert len(odd) == 12 and not any(r["toxic"] for r in odd)
    assert toxicity.graded(empty(spark), toxicity.fit([], {})).count() == 0


def test_quality_classifier(spark):
    docs, labels = _labelled(spark, "BUY!!! NOW$$$ " * 4)
    model = quality_classifier.fitted(docs, labels)
    rows = quality_classifier.scored(clashing(docs), model).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 != 0) for r in rows if r["held_out"]]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.scored(awkward(spark), model).collect())
    again = quality_classifier.scored(docs.repartition(3), quality_classifier.fitted(docs, labels))
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {r["doc_id"]: r["score"] for r in rows}
    assert quality_classifier.scored(empty(spark), quality_classifier.Model(None)).count() == 0


#: Files of the machine's licence texts and their names.
FULL = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}


def test_long_licences_by_their_digests(spark):
    """The published texts: whole, without the appendix, and with other case, spaces and line breaks; halves are none."""
    mark = "END OF TERMS AND CONDITIONS"
    rows = []
    for file, name in FULL.items():
        path = Path("/usr/share/common-licenses") / file
        if path.exists():
            text = path.read_text()
            rows += [(name, text), (name, text[: text.find(mark) + len(mark)] if mark in text else text), (name, text.upper().replace(" ", "  ")), (name, text.replace("\n", "\r\n")), (None, text[: len(text) // 2])]
    if not rows:
        pytest.skip("this machine has no licence texts")
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r["license"] for r in license_scan.licenses(docs).collect()}
    assert [found[i] for i in range(len(rows))] == [n for n, _ in rows]
    assert license_scan.licenses(docs, digests=()).where("license IS NOT NULL").count() == 0
