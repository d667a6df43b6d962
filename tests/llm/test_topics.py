import random

import numpy as np
from pyspark.sql import functions as F

from quilt.llm import mixing as M
from quilt.llm import topics as T
from quilt.llm.common import prefix_sums
from quilt.llm.tokens import public_path

SUBJECTS = {
    "sea": "ship wave harbour sail storm anchor tide fish deck captain".split(),
    "law": "court judge appeal statute clause verdict jury counsel trial bench".split(),
    "cook": "onion garlic butter simmer oven flour pepper whisk broth bake".split(),
}


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    names = list(SUBJECTS)
    return [
        (i, " ".join(rng.choice(SUBJECTS[names[i % 3]] if rng.random() < 0.7 else "the of and to in a".split()) for _ in range(40)), "s", "en", names[i % 3])
        for i in range(n)
    ]


def test_texts_of_one_subject_share_a_topic(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, topic string").repartition(4)
    got = {}
    for r in M.mix_to_targets(df.drop("topic")).collect():
        got.setdefault(rows[r["doc_id"]][4], {}).setdefault(r["topic"], 0)
        got[rows[r["doc_id"]][4]][r["topic"]] += 1
    # with more centres than subjects a subject may have several, but none is shared
    best = {t: max(got, key=lambda s: got[s].get(t, 0)) for s in got for t in got[s]}
    right = sum(got[best[t]][t] for t in best)
    assert right >= 0.95 * len(rows) and set(best.values()) == set(SUBJECTS)


def test_topics_do_not_depend_on_the_order_of_rows(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string, source string, lang string, topic string")
    a, b = T.fit_topics(df.repartition(5)), T.fit_topics(df.orderBy(F.desc("doc_id")).coalesce(1))
    assert np.allclose(a.centres, b.centres, atol=1e-5)
    some = [r[1] for r in corpus(30, 7)]
    assert a.of(some) == b.of(some)


def test_odd_texts(spark):
    df = spark.createDataFrame(corpus(30), "doc_id bigint, text string, source string, lang string, topic string")
    t = T.fit_topics(df)
    got = t.of(["", None, " \n\t", "ship", "zzz unseen", "ship " * 100_000])
    assert got[:3] == [T.EMPTY] * 3 and got[3] == got[5] and got[4].startswith("topic")
    none = T.fit_topics(df.where("false"))
    assert none.of(["ship", ""]) == [T.EMPTY, T.EMPTY]
    same = spark.createDataFrame([(i, "one and the same") for i in range(50)], "doc_id bigint, text string")
    assert len(T.fit_topics(same).centres) == 1


def test_tokens_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = public_path("word_bpe_49k.json")
    rows = corpus(20) + [(100, None, "s", "en", "x"), (101, "", "s", "en", "x"), (102, "naïve 你好 <|endoftext|>", "s", None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, topic string")
    plain = Tokenizer.from_file(path)
    want = {r[0]: len(plain.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in M.mix_to_targets(df, tokenizer=path).collect()} == want
    given = M.mix_to_targets(df, topic=F.col("topic"), tokens=F.col("doc_id") + 5).collect()
    assert all(r["n_tokens"] == r["doc_id"] + 5 and r["topic"] == rows[min(r["doc_id"], 20)][4] or r["doc_id"] >= 100 for r in given)


def test_prefix_sums_over_many_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(50) if rng.random() < 0.95 else None, i, rng.randrange(9), rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int, n bigint, w double").repartition(7)
    got = {r["i"]: r for r in prefix_sums(df, [F.asc_nulls_first("k"), F.desc("i")], {"before": "n", "light": "w"}).collect()}
    n, w = 0, 0.0
    for k, i, x, y in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], -r[1])):
        assert got[i]["before"] == n and abs(got[i]["light"] - w) < 1e-9
        n, w = n + x, w + y
    assert prefix_sums(df.where("false"), [F.asc("k")], {"before": "n"}).collect() == []


def test_topics_are_learnt_from_every_text(spark):
    rows = corpus(9000, 3)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, topic string").repartition(6)
    got = T.fit_topics(df.select("doc_id", "text"))
    counts = T.word_counts([r[1] for r in rows])
    weight = np.log((len(rows) + 1) / ((counts > 0).sum(axis=0) + 1)) + 0.1
    assert np.allclose(got.weight, weight, atol=1e-5)
    # rounds end where each centre is the mean of all texts that are nearest to it
    x = np.sqrt(counts).astype(np.float16) * got.weight
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = np.argmax(x @ got.centres.T, axis=1)
    for k, centre in enumerate(got.centres):
        mean = x[own == k].sum(axis=0)
        assert (mean / np.linalg.norm(mean)) @ centre / T.UNIT > 0.99


def test_a_topic_of_few_texts_is_found(spark):
    # 2 of 6,000 texts: most samples of them have none
    rows = [(i, "ship wave harbour sail storm anchor") for i in range(5998)] + [(i, "court judge appeal statute") for i in (5998, 5999)]
    t = T.fit_topics(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert len(t.centres) == 2 and t.of([rows[0][1]]) != t.of([rows[-1][1]])


def test_rounds_read_the_vectors_from_their_files(spark):
    """The rounds' jobs are over one row a file; vectors and sums are those of the rows."""
    x = np.random.default_rng(5).integers(0, 200, (40, T.WIDTH)).astype(np.int16)
    blocks = [(bytearray(x[i : i + T.BLOCK].tobytes()),) for i in range(0, 40, T.BLOCK)]
    rows, read = T._in_files(spark.createDataFrame(blocks, "x binary").repartition(3))
    assert rows.count() <= 3 and rows.columns == ["id"]
    sums = T._sums(rows, read, lambda v: v.sum(axis=0), T.WIDTH)
    assert (sums == x.sum(axis=0)).all()
    most, one = T._most(rows, read, lambda v: v[:, 0])
    assert most == x[:, 0].max() and one[0] == most
