"""The pipeline against a plain version of its stages, and on awkward and empty tables."""

import random

import pytest

from tarnwell.llm import mixing, near_dedup, quality_rules

from .helpers import awkward, clashing, empty


def _documents(spark, folder, docs):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


def _texts():
    draw = random.Random(9)
    common = ["the", "and", "of", "to", "in", "that", "was", "for", "with"]
    rows = []
    for _ in range(40):
        words = [draw.choice(common) if i % 3 == 0 else f"{draw.choice('abcdefg')}ord{draw.choice('klmnop')}{draw.choice('aeiou')}n{draw.randint(0, 99) if i % 11 == 0 else ''}" for i in range(80)]
        rows.append(" ".join(words))
        for kind in range(draw.randint(0, 3)):
            near = list(words)
            near[draw.randrange(80)] = "another"
            rows.append("  ".join(words) if kind == 0 else " ".join(near))
    return [(i, t, "en", draw.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(rows + ["$$$ !!! ### " * 30, "short", None, ""])]


def _expected(rows):
    """Documents left by the first three stages, stage by stage in plain loops."""
    found = {i: quality_rules.measure(t or "") for i, t, *_ in rows}
    passed = [i for i in found if not found[i][2]]
    patterns = [found[i][1] for i in passed]
    good = quality_rules.posteriors({p: patterns.count(p) for p in set(patterns)})
    kept = [i for i in passed if good[found[i][1]] >= 0.5]
    text = {i: t or "" for i, t, *_ in rows}
    first = {}
    for i in sorted(kept):
        first.setdefault(" ".join(text[i].split()), i)
    left = sorted(first.values())
    label = {i: i for i in left}
    for a in left:
        for b in left:
            if a < b and near_dedup.similar(text[a].encode().split(), text[b].encode().split()):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    return sorted(set(label.values()))


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import public_tokenizers
    import sentencepiece as library

    import corpus_pipeline

    model = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = _texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.run(spark, _documents(spark, tmp_path, docs)).collect()
    left = _expected(rows)
    taken = {i: sum(r["doc_id"] == i for r in out) for i in left}
    assert set(r["doc_id"] for r in out) <= set(left) and all(n <= 2 for n in taken.values())
    survivors = docs.where(docs.doc_id.isin(left))
    assert taken == {r["doc_id"]: r["repeats"] for r in mixing.mix_plan(survivors).collect()}
    texts = {i: t for i, t, *_ in rows}
    assert all(list(r["ids"]) == model.encode(texts[r["doc_id"]]) and r["round_trip"] for r in out)


@pytest.mark.parametrize("make", [awkward, empty, lambda spark: clashing(awkward(spark))])
def test_stages_take_awkward_documents(spark, make):
    """Each stage but the last keeps the columns; nulls, empty, long and repeated texts and clashing names do no harm; an empty table stays empty."""
    import corpus_pipeline

    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert out.count() <= 2 * docs.count()
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert encoded.count() == docs.count()


@pytest.mark.parametrize("name", ["quality rules", "minhash near-dedup", "sentencepiece encoding"])
def test_stages_bound_the_batches_of_texts(spark, name):
    """After a stage that goes through Python, 10 MB of texts come in batches of about BATCH_BYTES, and a session's own bound stays."""
    import pyarrow as pa

    import corpus_pipeline
    from tarnwell.llm.common import BATCH_BYTES

    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 1000, 1, 1).selectExpr("id", "repeat('word ', 2000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        dict(corpus_pipeline.STAGES)[name](spark, empty(spark), "")
        found = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in found) == 1000 and max(r["size"] for r in found) < 1.25 * BATCH_BYTES
        spark.conf.set(key, "1234567")
        dict(corpus_pipeline.STAGES)[name](spark, empty(spark), "")
        assert spark.conf.get(key) == "1234567"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
