"""Operators over groups of rows, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import exact_dedup, mixing, near_dedup, sentencepiece, warc

from .helpers import awkward, clashing, empty


def test_exact_groups(spark):
    docs = awkward(spark)
    rows = exact_dedup.exact_groups(clashing(docs)).collect()
    assert len(rows) == 12
    sets = {}
    for r in docs.collect():
        sets.setdefault(" ".join((r["text"] or "x").split()) if r["text"] and r["text"].strip() else (r["text"] or "").strip() and "", []).append(r["doc_id"])
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text_sha256"], []).append(r)
    for group in by_text.values():
        ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
        assert sum(r["kept"] for r in group) == 1
        assert {r["keep_id"] for r in group} == {min(ids) if ids else None} and {r["group_size"] for r in group} == {len(group)}
    kept = exact_dedup.deduplicated(clashing(docs))
    assert kept.count() == len(by_text) and kept.columns == clashing(docs).columns
    assert exact_dedup.exact_groups(empty(spark)).count() == exact_dedup.deduplicated(empty(spark)).count() == 0


def test_exact_groups_compare_full_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_digest", lambda text: F.lit("same"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_groups(docs).collect()} == {(1, 1), (2, 2), (3, 1)}


def brute_mix(docs):
    """Water-filling by repeated clamping."""
    size = {}
    for source, n in docs:
        size[source] = size.get(source, 0) + n
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target = 1.5 * sum(size.values()), {}
    while len(target) < len(size):
        free = [s for s in size if s not in target]
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > 2 * size[s]]
        target |= {s: 2.0 * size[s] for s in above} if above else {s: level * weight[s] for s in free}
    return target


def test_mix_meets_targets(spark):
    draw = random.Random(5)
    rows = [(i, "w " * draw.randint(0, 60), draw.choice(["a", "b", "c", "d", "é", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(clashing(docs)).collect()
    target = brute_mix([(s, len(t.split())) for _, t, s in rows])
    source = {i: s for i, _, s in rows}
    taken = dict.fromkeys(target, 0)
    for r in plan:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 61 for s in target)
    mixed = mixing.mixed(clashing(docs))
    assert mixed.columns == clashing(docs).columns
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in plan for _ in range(r["repeats"]))
    assert sorted(mixing.mix_plan(docs.repartition(7)).collect()) == sorted(plan)


def test_mix_awkward(spark):
    assert mixing.mix_plan(awkward(spark)).count() == 12
    assert mixing.mix_plan(empty(spark)).count() == mixing.mixed(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {r["target"] for r in mixing.mix_plan(nothing).collect()} == {0.0}


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ([draw.randint(0, 6) for _ in range(draw.randint(0, 30))] for _ in range(2))
        assert near_dedup.aligned(a, b, 40) == brute_lcs(a, b)


def _near_docs():
    draw = random.Random(2)
    rows = []
    for family in range(12):
        base = [f"w{draw.randint(0, 9999)}" for _ in range(draw.choice([30, 120, 400]))]
        for _ in range(draw.randint(1, 6)):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 60))):
                text[draw.randrange(len(text))] = f"x{draw.randint(0, 9999)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_near_classes_equal_brute_force(spark):
    rows = _near_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = list(range(len(rows)))
    words = [t.encode().split() for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similar(words[i], words[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == dict(enumerate(label))
    kept = near_dedup.near_deduplicated(clashing(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label)) and kept.columns == clashing(docs).columns


def test_near_classes_find_a_pair_hidden_in_large_buckets(spark):
    """The pair shares only buckets of over 257 texts, where it is further apart than the windows of 16 and 256 reach."""
    draw, apart = random.Random(7), random.Random(197)
    new = lambda d, n: [f"w{d.randint(0, 999_999)}" for _ in range(n)]
    passage = new(draw, 85)
    texts = [passage + new(draw, 15) for _ in range(900)]
    tail = new(apart, 15)
    texts += [passage + tail, passage + tail[:8] + new(apart, 7)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == {i: min(i, 900) for i in range(902)}


def _classes_by_brute_force(texts):
    """Components over all pairs of texts that are similar."""
    compare = near_dedup.Comparer()
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    held = [t.encode() for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and compare.similar(held[i], held[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("part", [60, 1000])
def test_near_classes_of_a_large_family_and_a_common_passage(spark, monkeypatch, part):
    """500 variants of one text, many near the edge of 0.8, and 300 texts that share a passage only; cut into parts and not. Few pairs are listed."""
    monkeypatch.setattr(near_dedup, "PART", part)
    listed = []
    verified = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, texts: listed.append(pairs.count()) or verified(pairs, texts))
    draw = random.Random(21)
    new = lambda n: [f"w{draw.randint(0, 999_999)}" for _ in range(n)]
    base, passage = new(150), new(110)
    texts = []
    for _ in range(500):
        text = list(base)
        for at in draw.sample(range(len(text)), draw.randint(0, 6)):
            text[at] = new(1)[0]
        texts.append(" ".join(text))
    texts += [" ".join(passage + new(45)) for _ in range(300)]
    draw.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()}
    assert got == _classes_by_brute_force(texts)
    assert sum(listed) < 20 * len(texts)


def test_near_signatures_let_similar_texts_through():
    """Pairs at 0.8 and a little above, of short and long texts, by both kinds of signatures."""
    draw = random.Random(5)
    for n in (12, 60, 400, 3000):
        for _ in range(40):
            text = [f"w{draw.randint(0, 10**9)}" for _ in range(n)]
            other = list(text)
            while True:
                changed = list(other)
                changed[draw.randrange(n)] = f"x{draw.randint(0, 10**9)}"
                if not near_dedup.similar([w.encode() for w in text], [w.encode() for w in changed]):
                    break
                other = changed
            for bins in (near_dedup.BINS, near_dedup.FINE_BINS):
                a, b = (np.frombuffer(near_dedup.signature(near_dedup.items([w.encode() for w in t], {}), bins), np.uint8)[None, :] for t in (text, other))
                assert near_dedup.may_be_similar(a, b)[0]


def test_near_awkward(spark):
    rows = near_dedup.near_classes(awkward(spark)).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[5]["class_id"] == by_id[6]["class_id"] == 5 and by_id[3]["class_id"] == by_id[4]["class_id"] == by_id[9]["class_id"] == 3
    assert sum(r["kept"] for r in rows) == near_dedup.near_deduplicated(awkward(spark)).count() == 6
    assert near_dedup.near_classes(empty(spark)).count() == near_dedup.near_deduplicated(empty(spark)).count() == 0


def test_sentencepiece_equals_the_library(spark):
    import public_tokenizers
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = awkward(spark).unionByName(spark.createDataFrame([(20, "nospaces" * 40, "", "", 0), (21, "  two   spaces \n\n and\ttabs ", "", "", 0)], awkward(spark).schema))
    pieces = sentencepiece.standard()
    rows = sentencepiece.encoded(clashing(docs), pieces)
    texts = sorted((r["text"] or "") for r in docs.collect())
    assert sorted(tuple(r["ids"]) for r in rows.collect()) == sorted(tuple(model.encode(t)) for t in texts)
    assert sorted(r["text"] for r in sentencepiece.decoded(rows, pieces).collect()) == sorted(t.replace("▁", " ") for t in texts)
    assert sentencepiece.encoded(empty(spark), pieces).count() == 0


def test_sentencepiece_does_not_depend_on_splits(spark, tmp_path, monkeypatch):
    """Files are split otherwise in the second pass; widespread, own and long chunks, and ones that no table has."""
    import public_tokenizers
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    draw = random.Random(11)
    texts = [" ".join(f"w{draw.randint(0, 400)}x{draw.randint(0, 9)}" + draw.choice(["", ",", "  ", "\n"]) for _ in range(60)) for _ in range(400)] + ["a" * 5000, "日本" * 60]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.option("parquet.block.size", "8192").parquet(f"{tmp_path}/docs")
    docs, pieces = spark.read.parquet(f"{tmp_path}/docs"), sentencepiece.standard()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for common in (sentencepiece.COMMON, 50):
        monkeypatch.setattr(sentencepiece, "COMMON", common)
        try:
            rows = sentencepiece.encoded(docs, pieces, block_rows=64)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
            assert {r["doc_id"]: list(r["ids"]) for r in rows.collect()} == {i: model.encode(t) for i, t in enumerate(texts)}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_merges_in_one_pass_or_one_by_one(spark):
    """Scores that make late merges possible: both folds, the heap and a plain loop agree."""
    draw = random.Random(4)
    names = [*"abcd", "ab", "bc", "cd", "abc", "bcd", "abcd", "aa", "aab", "da", "dab"]
    for _ in range(6):
        scores = draw.sample(range(100), len(names))
        pieces = sentencepiece.Pieces(tuple((p, i + 1, -float(s)) for i, (p, s) in enumerate(zip(names, scores, strict=True))), "bpe", None, 0, ("<unk>", *names))
        chunks = sorted({"".join(draw.choice("abcde") for _ in range(draw.randint(1, 9))) for _ in range(60)})

        def plain(text):
            spans = list(text)
            while able := [(-pieces.table[x + y][1], i) for i, (x, y) in enumerate(zip(spans, spans[1:], strict=False)) if x + y in pieces.table]:
                i = min(able)[1]
                spans[i : i + 2] = [spans[i] + spans[i + 1]]
            return [pieces.table[s][0] if s in pieces.table else 0 for s in spans]

        frame = spark.createDataFrame([(c,) for c in chunks], "chunk string")
        got = {r["chunk"]: list(r["ids"]) for r in sentencepiece.folded(sentencepiece.lattice(frame, pieces), pieces).collect()}
        assert got == {c: plain(c) for c in chunks} == {c: sentencepiece.merged(c, pieces.table, pieces) for c in chunks}


def test_viterbi_fold_equals_all_paths(spark):
    draw = random.Random(3)
    names = ["▁", *"abc", "ab", "bc", "abc", "▁a", "ca", "▁ab"]
    pieces = sentencepiece.Pieces(tuple((p, i + 1, -draw.random() * 5) for i, p in enumerate(names)), "unigram", None, 0, ("<unk>", *names))
    table = {p.replace("▁", " "): (i, s) for p, i, s in pieces.rows}
    low = min(s for _, s in table.values()) - 10
    chunks = [" " + "".join(draw.choice("abcd") for _ in range(draw.randint(1, 7))) for _ in range(40)]

    def best(text):
        if not text:
            return 0.0
        return max((table[text[:k]][1] if text[:k] in table else low) + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in table or k == 1)

    frame = spark.createDataFrame([(c,) for c in sorted(set(chunks))], "chunk string")
    for r in sentencepiece.folded(sentencepiece.lattice(frame, pieces), pieces).collect():
        scores = {i: s for i, s in table.values()} | {0: low}
        assert sum(scores[i] for i in r["ids"]) == pytest.approx(best(r["chunk"]))
        assert sum(scores[i] for i in sentencepiece.best_path(r["chunk"], table, pieces)) == pytest.approx(best(r["chunk"]))


def test_warc_round_trip(spark):
    rows = [(1, "http://a.example.com/x", "<p>one</p>"), (2, "https://b.example.com/y?q=1", "<p>one</p>"), (3, None, None), (4, "http://a.example.com/x", "é\r\n\r\nWARC/1.1\r\n"), (5, "http://z.example.com", ""), (None, "http://n.example.com", "null id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.capture(clashing(pages))
    got = {r["page_id"]: r for r in made.records().collect()}
    assert len(got) == 6
    assert got["2"]["record_type"] == "response" and (got["1"]["record_type"], got["1"]["refers_to"]) == ("revisit", "2")
    assert (got["3"]["record_type"], got["3"]["refers_to"], got["5"]["record_type"]) == ("revisit", "5", "response")
    assert bytes(got["4"]["payload"]).decode() == rows[3][2]
    assert sorted(f["page_id"] for f in made.lookup("http://a.example.com/x")) == ["1", "4"] and list(made.lookup("http://none.example.com/")) == []
    assert [f["page_id"] for f in made.lookup("http://n.example.com")] == [None]
    assert warc.capture(spark.createDataFrame([], pages.schema)).records().count() == 0


def test_warc_lookup_searches_ranges_and_blocks(spark, monkeypatch):
    """A hot URL over several blocks and ranges, repeated rows, and keys before, between and after."""
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 3)
    urls = ["http://hot.example.com/"] * 40 + [f"http://h{i % 9}.example.com/p{i}" for i in range(40)]
    rows = [(i, u, f"<p>{i % 50}</p>") for i, u in enumerate(urls)] + [(79, urls[79], "<p>29</p>")]
    made = warc.capture(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for u in {*urls, "http://a.example.com/", "http://h3.example.com/p3x", "http://zz.example.org/"}:
        assert sorted(f["page_id"] for f in made.lookup(u)) == sorted(str(i) for i, x, _ in rows if x == u)
    heads = []
    for row in warc.read_blocks(made.directory, made.folder).collect():
        heads.append(warc.parse(__import__("zlib").decompress(warc.read_range(made.folder, row["archive"], row["offset"], row["length"]), 31))[0])
    assert len({h["WARC-Record-ID"] for h in heads}) == len(rows)
    by_page = {h["X-Page-ID"]: h for h in heads}
    assert all(h["WARC-Refers-To-Target-URI"] == by_page[h["X-Refers-To-Page-ID"]]["WARC-Target-URI"] for h in heads if h["WARC-Type"] == "revisit")


def test_surt():
    assert warc.surt("http://www.Example.com:80/a/b?c=d") == "com,example,www)/a/b?c=d"
    assert np.all([warc.surt(None) == "", warc.surt("http://x.org:8080") == "org,x:8080)/"])


@pytest.mark.parametrize(("few", "part", "url"), [(0, 4096, 8192), (0, 4, 8192), (0, 4096, 5), (32 << 20, 4096, 8192)])
def test_warc_records_do_not_depend_on_how_groups_are_met(spark, monkeypatch, few, part, url):
    """Half of all pages have one payload; groups are broadcast, found by the bitmap, or met in a shuffle."""
    for name, value in (("FEW_BYTES", few), ("LARGE_PART", part), ("URL_BYTES", url), ("BITMAP_BITS", 16)):
        monkeypatch.setattr(warc, name, value)
    body = lambda i: None if i % 2 else "" if i % 20 == 0 else f"twice {i // 4}" if i % 3 else f"single {i}"
    rows = [(i if i % 7 else None, f"http://h{i % 5}.org/{i}", body(i)) for i in range(400)] + [(398, "http://h.org/again", body(398)), (None, "u", "none"), (None, "v", "none")]
    got = [(r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in warc.capture(clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))).records().collect()]
    best = {}
    for i, _, html in rows:
        if i is not None:
            best[html or ""] = max(best.get(html or "", -1), i)
    text = lambda i: None if i is None else str(i)
    keep = lambda i, html: best.get(html or "") if best.get(html or "") != i else None
    want = [(text(i), u, "revisit" if keep(i, html) is not None else "response", text(keep(i, html))) for i, u, html in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_warc_payloads_of_single_and_frequent_groups_stay(spark, monkeypatch):
    """Of 200 empty payloads, 200 single ones and 50 pairs only the pairs, and single ones by chance, pass the exchange."""
    monkeypatch.setattr(warc, "FEW_BYTES", 0)
    monkeypatch.setattr(warc, "LARGE_PART", 10)
    rows = [("", i, f"u{i}", "hot") for i in range(200)] + [(f"{i}", i, f"u{i}", "x") for i in range(200)] + [(f"pair {i % 50}", i, f"u{i}", "y") for i in range(100)]
    frame = spark.createDataFrame(rows, [warc.KEY, warc.ID, warc.URL, warc.BODY])
    groups = frame.groupBy(warc.KEY).agg(F.max(warc.ID).alias(warc.KEEP), F.max(warc.URL).alias(warc.KEEP_URL), F.count("*").alias(warc.ROWS)).where(F.col(warc.ROWS) > 1)
    asked, original = [], type(frame).unionByName
    monkeypatch.setattr(type(frame), "unionByName", lambda self, other: (asked.append((self, other)), original(self, other))[1])
    made = warc.with_groups(frame, groups)
    assert made.count() == 500 and made.where(F.col(warc.KEEP).isNotNull()).count() == 300
    stays, moves = asked[0]
    assert 100 <= moves.count() <= 105 and moves.where(f"{warc.BODY} = 'y'").count() == 100
    assert stays.count() + moves.count() == 500 and stays.where(F.col(warc.KEEP).isNotNull()).count() == 200
