"""The pipeline, stage by stage, against brute force, with null and repeated ids, odd texts, clashing names and an empty table."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_operators import ODD, SF, components
from tokenizers import Tokenizer

import corpus_pipeline
from codeloom.llm import pii, quality, rules

WORD = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    some = [tuple(r) for r in plain.orderBy("doc_id").collect()]
    odd = [(5000 + i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    more = [(None, some[3][1], "en", "s", 1), (None, None, None, None, None), some[5], some[5], (some[7][0], some[9][1] + " and more", "en", "s", 2)]
    made = spark.createDataFrame([*some, *odd, *more], plain.schema)
    return made.selectExpr("*", "text as pii_spans", "doc_id as row0", "true as kept", "1 as c0")


def test_every_stage_like_brute_force(spark, docs):
    known = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lab = spark.read.parquet(f"{SF}/labels.parquet").collect()
    grade = {r["doc_id"]: 0 if r["quality"] < 1 else 1 if r["toxic"] else 2 for r in lab}
    features = quality.Features()
    ordinal = quality.train([(grade[i], a.astype(np.int64), x.astype(np.float32).astype(float)) for i in sorted(grade) for a, x in [features(known[i]["text"] or "")] if len(a)])

    def tail(text):
        a, x = features(text or "")
        if not len(a):
            return 0.0
        a, x = quality.with_strong(ordinal.strong, a, x)
        return float(ordinal.above(np.array([ordinal.weights[a] @ x]))[0, 1])

    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality classifier", "quality rules", "near duplicates", "personal data", "packing"]
    first = stages["quality classifier"](spark, docs, SF)
    assert first.columns == docs.columns
    assert rows(first) == collections.Counter({r: n for r, n in rows(docs).items() if tail(r[1]) >= 0.5})

    # the forest is grown here from the same rows, its trees are walked one node at a time
    table = sorted((i, int(g >= 1), *rules.measure(known[i]["text"])[1]) for i, g in grade.items())
    forest = rules.grow(np.array([r[2:] for r in table], float), np.array([r[1] for r in table], float))

    def good(text):
        (n, _, _, _, repeat), x = rules.measure(text)
        total = forest.start
        for at in forest.roots.tolist():
            while forest.left[at] != at:
                at = int(forest.left[at] if x[forest.feature[at]] <= forest.cut[at] else forest.right[at])
            total += forest.value[at]
        return n >= 10 and 100 * repeat <= 20 * n, total >= 0

    second = stages["quality rules"](spark, docs, SF)
    assert rows(second) == collections.Counter({r: n for r, n in rows(docs).items() if all(good(r[1]))})
    assert any(base and not trees for base, trees in map(good, (r[1] for r in rows(docs))))  # the forest has a say of its own

    third = stages["near duplicates"](spark, docs, SF)
    order = sorted((tuple(r) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    linked = components({i: r[1] or "" for i, r in enumerate(order)})
    assert rows(third) == collections.Counter(r for i, r in enumerate(order) if linked[i][2])

    fourth = stages["personal data"](spark, docs, SF)
    assert fourth.columns == docs.columns
    assert rows(fourth) == collections.Counter((r[0], r[1] and pii.replace(r[1])[0], *r[2:]) for r in (tuple(x) for x in docs.collect()))

    tokenizer, want = Tokenizer.from_file(WORD), collections.Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for i, at in enumerate(range(0, len(ids), 4096)):
            want[r["doc_id"], i, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in stages["packing"](spark, docs, SF).collect()) == want


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(got.select(*key)) == rows(docs.select(*key)) and got.count() > 0


def test_no_documents(spark, docs):
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_two_columns_of_one_name_are_refused(docs):
    with pytest.raises(ValueError, match="pii_spans"):
        pii.surrogates(docs)
    assert pii.surrogates(docs, spans="found").columns == [*docs.columns, "found"]


def test_rows_of_one_doc_id_are_learnt_from_once(spark):
    """Else the driver gets every copy of a labelled document, however many there are."""
    docs, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    copies = docs.union(docs).union(docs)
    one, same = quality.fit(docs, lab), quality.fit(copies, lab)
    assert np.array_equal(one.weights, same.weights) and np.array_equal(one.thresholds, same.thresholds) and np.array_equal(one.strong, same.strong)
    forest, other = rules.fit(docs, lab), rules.fit(copies, lab)
    assert forest.start == other.start and all(np.array_equal(getattr(forest, k), getattr(other, k)) for k in ("feature", "cut", "left", "right", "value", "roots"))
