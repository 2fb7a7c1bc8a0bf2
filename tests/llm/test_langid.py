import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lantern.llm import langid

SCHEMA = "doc_id long, text string, lang string, score int, lang_pred string"
WORDS = {"en": "the of and to in that with this from have which were their".split(), "fr": "le la les des une dans pour que qui avec été où".split(), "de": "der die das und nicht mit für über ein schön wird".split()}


def rows(n=240, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.choice([6, 40, 300]))), lang, 1, "x"))
    return out


def test_held_out_accuracy_and_defined_results(spark):
    made = rows()
    more = [(1000, None, "en", 1, "x"), (1001, "123 !!", "fr", 1, "x"), (1002, "", None, 1, "x"), (None, "the of and", "en", 1, "x"), (5, made[5][1], "en", 1, "x")]
    docs = spark.createDataFrame(made + more, SCHEMA)
    model = langid.fit(langid.learnable(docs), sample=50)
    got = langid.identified(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    found = {r.doc_id: r for r in got.withColumn("out", langid.held_out()).collect()}
    for i in (1000, 1001, 1002):
        assert (found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True)
    held = [x for x in made if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert all(found[x[0]].out for x in held) and sum(r.out for r in found.values()) == len(held) + sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in (1000, 1001, 1002))
    assert np.mean([found[x[0]].lang_pred == x[2] for x in held]) > 0.97
    assert not any(found[x[0]].rejected for x in held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_far_texts_are_rejected(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    far = spark.createDataFrame([(1, "zzkq " * 200, None, 1, "x"), (2, "the of and with this", None, 1, "x")], SCHEMA)
    got = {r.doc_id: r.rejected for r in langid.identified(far, langid.fit(docs.select("doc_id", "text", "lang"))).collect()}
    assert got == {1: True, 2: False}


def test_model_does_not_depend_on_order_or_partitions(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    a, b = (langid.fit(d.select("doc_id", "text", "lang"), sample=30) for d in (docs, docs.repartition(7).orderBy(F.desc("doc_id"))))
    assert a["langs"] == b["langs"] and np.array_equal(a["centres"], b["centres"])


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "the", None, 1, "x")], SCHEMA)
    assert [r.lang_pred for r in langid.identified(docs, langid.fit(docs)).collect()] == ["und"]
    assert langid.identified(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
