import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF01
from pyspark.sql import functions as F

from quilt.llm import language_id as L
from quilt.llm.queries import QUERIES

WORDS = {
    "en": "the house and river people walk every morning with small dogs along this street because water".split(),
    "de": "das haus und fluss menschen gehen jeden morgen mit kleinen hunden entlang dieser straße weil wasser".split(),
    "el": "το σπίτι και ποτάμι άνθρωποι περπατούν κάθε πρωί με μικρά σκυλιά κατά μήκος του δρόμου".split(),
    "zh": "房子 和 河流 人们 每天 早上 带着 小狗 沿着 街道 散步 因为 水".split(),
}


class Plain:
    """The trees by plain dictionaries: contexts to counts of their next bytes."""

    def __init__(self, texts):
        self.at = defaultdict(Counter)
        for text in texts:
            for run in L.runs_of(text):
                s = L.spelled(run)
                for i in range(1, len(s or b"")):
                    for k in range(min(i, L.ORDER) + 1):
                        self.at[s[i - k : i]][s[i]] += 1

    def bits(self, context, byte):
        got = self.at.get(context)
        if got and got[byte]:
            return math.log2((sum(got.values()) + len(+got)) / got[byte])
        escape = math.log2((sum(got.values()) + len(+got)) / len(+got)) if got else 0.0
        return escape + (self.bits(context[1:], byte) if context else 8.0)

    def text(self, text):
        total = 0.0
        for run in L.runs_of(text):
            s = L.spelled(run)
            total += sum(self.bits(s[max(0, i - L.ORDER) : i], s[i]) for i in range(1, len(s or b"")))
        return total


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    langs = list(WORDS)
    return [
        (i, " ".join(rng.choice(WORDS[langs[i % 4]]) for _ in range(rng.randrange(1, 25))), langs[i % 4], "s", 1.5)
        for i in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, gram string, score double")


@pytest.fixture(scope="module")
def trees(spark):
    return L.fit(frame(spark, corpus()).repartition(3), F.lit(True))


def test_code_lengths_equal_plain_trees(trees, monkeypatch):
    plain = {l: Plain([r[1] for r in corpus() if r[2] == l]) for l in trees.langs}
    odd = ["", "the", "xyzzy ÿÿ", "ThE HOUSE!", "房子x", "\x00a\x7f", "a" * 500, "123 ... a1", "straße" * 40, "σκυλιά, (water)"]
    for block in (L.BLOCK, 7):
        monkeypatch.setattr(L, "BLOCK", block)
        got = L.Speller(trees).texts(odd + [r[1] for r in corpus(20, 5)])
        for text, bits in zip(odd + [r[1] for r in corpus(20, 5)], got, strict=True):
            if bits is None:
                assert not any(c.isalpha() for c in text)
            else:
                assert np.allclose(bits, [plain[l].text(text) for l in trees.langs], rtol=1e-10)


def test_each_context_gives_a_distribution(trees):
    """Over all 256 next bytes, the probabilities add up to one at most (seen
    bytes keep their share of what lies below an escape), and none is zero."""
    one = np.array([[x] for x in range(256)], np.uint8)
    for context in (b" t", b" the", b" ", "σ".encode()):
        bits = trees.spell([context + bytes(x) for x in one])
        first = trees.spell([context])
        p = np.exp2(-(bits - first))
        assert (p > 0).all() and (p.sum(axis=0) <= 1 + 1e-9).all()


def test_predictions(spark, trees):
    rows = corpus(60, 7)
    got = {r["doc_id"]: r for r in L.predict(frame(spark, rows), trees, [F.col("lang").alias("want")]).collect()}
    assert all(r["lang_pred"] == r["want"] and 0 < r["score"] <= 1 for r in got.values())


def test_odd_rows(spark, trees):
    rows = [(1, None, None, None, None), (2, "", "en", "g", 1.0), (3, "123 -- !", "en", "g", 1.0), (None, "the river", None, "g", None),
            (4, "the river", "de", "g", 1.0), (4, "the river", "en", "g", 2.0), (5, "ЖЖЖ", "en", "g", 0.0), (6, "x" * 400_000, "en", "g", 0.0)]
    got = L.predict(frame(spark, rows), trees).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "lang_pred", "score"}
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["lang_pred"], r["score"]))
    for i in (1, 2, 3):
        assert by[i] == {("und", 0.0)}
    assert by[4] == by[None] and {x for x, _ in by[4]} == {"en"}
    assert all(x in trees.langs for i in (5, 6) for x, _ in by[i])
    assert L.predict(frame(spark, []), trees).collect() == []


def test_nothing_to_learn_from(spark):
    for rows in ([], [(1, "12", "en", "g", 1.0), (2, None, "de", "g", 1.0), (3, "word", None, "g", 1.0)]):
        trees = L.fit(frame(spark, rows), F.lit(True))
        assert trees is None
        assert [r["lang_pred"] for r in L.predict(frame(spark, [(1, "word", "en", "g", 1.0)]), trees).collect()] == ["und"]


def test_only_usable_rows_teach(spark):
    rows = corpus(80)
    wrong = [(1000 + i, r[1], "qq", "g", 1.0) for i, r in enumerate(rows)]
    trees = L.fit(frame(spark, rows + wrong), F.col("doc_id") < 1000)
    assert trees.langs == sorted(WORDS)


def test_smaller_trees_stay_whole(spark):
    """Fewer nodes: every suffix is still there, and predictions hold."""
    full = L.fit(frame(spark, corpus()), F.lit(True))
    small = L.fit(frame(spark, corpus()), F.lit(True), max_nodes=len(full.grams) // 3)
    assert 0 < len(small.grams) <= len(full.grams) // 3 and np.isin(small.grams, full.grams).all()
    assert np.isfinite(small.bits).all()
    rows = corpus(60, 9)
    assert all(r["lang_pred"] == r["want"] for r in L.predict(frame(spark, rows), small, [F.col("lang").alias("want")]).collect())


def test_flushing_counts_changes_nothing(spark, monkeypatch):
    rows = frame(spark, corpus(60)).coalesce(1).select(F.col("lang").alias("_lang"), F.col("text").alias("_text"))
    want = sorted(map(tuple, L.count_contexts(rows).collect()))
    monkeypatch.setattr(L, "MEMO_CHARS", 50)
    assert sorted(map(tuple, L.count_contexts(rows).collect())) == want


def test_held_out_accuracy_on_the_table(spark):
    got = QUERIES["op13_language_id"](spark, SF01)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert 100 < len(held) < 300
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
