import random

import numpy as np
import pytest
from conftest import SF01
from pyspark.sql import functions as F

from quilt.llm import toxicity as T

SF1 = SF01.replace("0.01", "0.1")
BAD = ["idiot", "stupid", "pathetic", "moron", "scum"]
CLEAN = "the table stands near window and people walk along river every morning with their small dogs".split()


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(40)]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    l = spark.createDataFrame(labels + [(9999, 1), (3, None), (None, 1)], "doc_id bigint, toxic int")
    return T.fit(d, l, T.fold() != 0)


def scores(spark, model, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("evidence", F.lit("x")).withColumn("_text", F.lit(1))
    return {r["doc_id"]: r for r in T.score(df, model).collect()}


def test_char_counts_equal_plain_counting():
    texts = ["Ab c!", "", "ßü x\n\ny", "中文 a"]
    want = {}
    for t in texts:
        k = [0, *(T.char_class(c) for c in t.lower()), 0]
        for a, b, c in zip(k, k[1:], k[2:]):
            want[(a, b, c)] = want.get((a, b, c), 0) + 1
    got = T.trigram_counts(texts)
    for (a, b, c), n in want.items():
        if b:  # windows centred on a non-letter also count between texts
            assert got[(a * 64 + b) * 64 + c] == n


def test_disguised_words_are_restored(model):
    d = T.Decoder(model.log_p)
    for token, word in [
        ("1d10t", "idiot"), ("st*pid", "stupid"), ("p4th3t1c", "pathetic"), ("m0ron", "moron"), ("$cum", "scum"),
        ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("idiiiiot", "idiot"), ("sssstupid", "stupid"), ("window", "window"),
    ]:
        assert d.decode(token) == word, token
    assert d.decode("12345") == "" and d.decode("") == ""


def test_brute_force_over_the_lattice(model):
    """Viterbi's reading scores as the best of all readings."""
    d = T.Decoder(model.log_p)
    d.decode("a")

    def best(token):
        found = [-np.inf, ""]

        def walk(i, a, b, score, out):
            if i == len(token):
                score += d.lists[a][b][0]
                if score > found[0]:
                    found[:] = [score, out]
                return
            ch = token[i]
            options = [(ch, 0.0)] if ch.isalpha() else [(c, T.COST_SIGN) for c in T.LOOKALIKE.get(ch, "")]
            if i and ch == token[i - 1] and ch.isalpha():
                walk(i + 1, a, b, score + T.COST_DROP_REPEAT, out)
            elif ch in T.SEPARATORS:
                walk(i + 1, a, b, score + T.COST_DROP_SEPARATOR, out)
            elif not options:
                walk(i + 1, a, b, score, out)
            for letter, cost in options:
                k = T.char_class(letter)
                walk(i + 1, b, k, score + cost + d.lists[a][b][k], out + letter)

        walk(0, 0, 0, 0.0, "")
        return found[1]

    for token in ["1d1*t", "m00rr0n", "s-t.u_p1d", "w1nd0w", "||aa11", "p@th€tic", "xx??yy"]:
        assert d.decode(token) == best(token)


def test_scores(spark, model):
    long = " ".join(CLEAN * 20000)
    rows = [
        (1, "the table stands near window"), (2, "you stupid idiot moron"), (3, "you 5tup1d 1d10t m0r0n"), (4, None), (5, ""),
        (6, "s t u p i d and p a t h e t i c and m o r o n"), (7, long), (8, long + " stupid idiot scum moron"),
        (9, "a a a a a a a"), (None, "stupid idiot moron"), (2, "you stupid idiot moron"),
    ]
    got = scores(spark, model, rows)
    assert {k: r["predicted"] for k, r in got.items()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1, 7: 0, 8: 1, 9: 0, None: 1}
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == bool(r["predicted"]) for r in got.values())
    kept = T.keep_clean(spark.createDataFrame(rows, "doc_id bigint, text string"), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 7, 9]
    assert kept.columns == ["doc_id", "text"]


def test_held_out_accuracy(spark, model):
    docs, labels = corpus(400, seed=77)
    got = scores(spark, model, docs)
    assert np.mean([got[i]["predicted"] == y for i, y in labels]) >= 0.98


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    for rows in ([], [(1, 1)], [(1, None)]):
        m = T.fit(d, spark.createDataFrame(rows, "doc_id bigint, toxic int"), F.lit(True))
        assert T.score(d, m).first()["predicted"] == 0
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    m = T.fit(empty, spark.createDataFrame([], "doc_id bigint, toxic int"), F.lit(True))
    assert T.score(empty, m).count() == 0


def test_documents_held_out(spark):
    from quilt.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op10_toxicity_channel"](spark, SF1).collect()}
    labels = spark.read.parquet(f"{SF1}/labels.parquet").collect()
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert np.mean([p == y for p, y in held]) >= 0.95
    # (a constant would be right for nine in ten)
    caught = [p for p, y in held if y == 1]
    left = [p for p, y in held if y == 0]
    assert sum(caught) >= 0.9 * len(caught) and sum(left) <= 0.02 * len(left)


def test_disguises_reach_the_decoder(spark, model):
    """Each variant is scored in a text, and must not read as clean."""
    around = "the table stands near {} and people walk"
    variants = [
        "stu-pid idi-ot", "st_upid id_iot", "stu.pid mo.ron", "stuupid idiiot", "mor0on stu+pid", "1d10+ $cum", "5tupid m0ron",
        "s  t  u  p  i  d and m  o  r  o  n", "s\tt\tu\tp\ti\td and m\to\tr\to\tn", "s\nt\nu\np\ni\nd and i\nd\ni\no\nt",
        "a s t u p i d and a m o r o n", "s t u p i d   i d i o t",
    ]
    plain = {"-": "well-known book.keeper", "+": "c++ tree, moon (a) b. c"}
    rows = list(enumerate(around.format(v) for v in variants))
    got = scores(spark, model, rows + [(100 + i, around.format(v)) for i, v in enumerate(plain.values())])
    assert [variants[i] for i in range(len(variants)) if not got[i]["predicted"]] == []
    assert [got[100 + i]["predicted"] for i in range(len(plain))] == [0] * len(plain)


def test_short_tokens_and_spaced_short_words(model):
    seen = lambda text: set(T.Restorer(T.Decoder(model.log_p), lambda w: True)(text))
    assert "ass" in seen("a$$") and "ass" in seen("a55") and "ass" in seen("you a s s")
    assert "scum" in seen("s c u m") and "stupid" in seen("are a s t u p i d")


@pytest.mark.parametrize("kind", ["overlapping", "long-tailed", "separable", "constant", "rare", "reversed"])
@pytest.mark.parametrize("scale", [1.0, 1.2, 1.5, 2.0, 50.0])
@pytest.mark.parametrize("weighting", [(1.0, 1.0), (25.0, 1.0), (1.0, 40.0)])
def test_the_curve_settles_on_any_evidence(kind, scale, weighting):
    rng = np.random.default_rng(5)
    n = 4000
    y = (rng.random(n) < (0.01 if kind == "rare" else 0.12)).astype(float)
    x = {
        "overlapping": lambda: rng.gamma(1.5, 2, n) + 1.5 * y,
        "long-tailed": lambda: rng.lognormal(0, 1.6, n) * (1 + 2 * y),
        "separable": lambda: rng.random(n) + 3 * y,
        "constant": lambda: np.full(n, 2.5),
        "rare": lambda: rng.gamma(2.0, 1.0, n) + 6 * y,
        "reversed": lambda: rng.gamma(2.0, 1.0, n) - y,
    }[kind]() * scale
    w = np.array(weighting)[y.astype(int)]
    slope, intercept = T._logistic(x, y, w)
    assert np.isfinite([slope, intercept]).all() and 0 <= slope * x.std() < 60 and abs(intercept) < 60
    # no worse than the best constant, and at a minimum of the penalised loss
    def loss(a, b):
        m = a * x + b
        return (w * (np.logaddexp(0, m) - y * m)).sum()
    share = np.average(y, weights=w)
    assert loss(slope, intercept) <= loss(0, np.log(share / (1 - share))) + 0.5
    if kind not in ("constant", "reversed"):
        assert slope > 0
        if kind == "separable":
            p = 1 / (1 + np.exp(-(slope * x + intercept)))
            assert (p[y == 1] >= 0.5).mean() > 0.8 and (p[y == 0] < 0.5).mean() > 0.95
    else:
        assert slope == 0


def test_overlapping_labels_give_a_prediction_that_varies(spark):
    """A third of the toxic documents hold no toxic word and some clean ones do."""
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(CLEAN) for _ in range(30)]
        toxic = int(i % 6 == 0)
        if toxic and i % 3 == 0 and i % 18 or i % 41 == 0:
            words.insert(rng.randrange(30), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = T.fit(d, spark.createDataFrame(labels, "doc_id bigint, toxic int"), T.fold() != 0)
    got = [r["predicted"] for r in T.score(d, model).collect()]
    assert 0 < sum(got) < 300
    empty = {r["doc_id"]: r for r in T.score(spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string"), model).collect()}
    assert all(r["predicted"] == 0 for r in empty.values())


def test_length_is_no_evidence(spark):
    """Short texts with one toxic word or two, among long clean ones whose words
    differ a little in how often they stand in toxic texts."""
    rng = random.Random(12)
    rare = [f"{a}{b}" for a in ("bran", "clot", "drif", "emb", "flin", "gras") for b in ("ker", "tle", "mond", "sup", "wick", "yard")]
    docs, labels = [], []
    for i in range(1500):
        toxic = int(i % 8 == 0)
        long = rng.random() < (0.5 if toxic else 0.3)
        words = [rng.choice(CLEAN + rare) for _ in range(400 if long else 25)]
        if toxic:
            for w in rng.sample(BAD, rng.randint(1, 2)):
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    model = T.fit(d, spark.createDataFrame(labels, "doc_id bigint, toxic int"), T.fold() != 0)
    wrong = [r["doc_id"] for r in T.score(d, model).collect() if r["predicted"] != labels[r["doc_id"]][1]]
    assert len(wrong) < 15, wrong


def _plain_decode(log_p, token, split=False):
    """Viterbi search with every state in a table, whatever the token."""
    if not any(c.isalpha() for c in token):
        return ""
    states, before = {(0, 0): (0.0, "")}, ""
    for ch in token:
        options = [(ch, 0.0)] if ch.isalpha() else [(c, T.COST_SIGN) for c in T.LOOKALIKE.get(ch, "")]
        if split and ch == " ":
            options = [(ch, T.COST_WORD_END)]
        drop = T.COST_DROP_REPEAT if ch == before and ch.isalpha() else (
            T.COST_DROP_SEPARATOR if ch in T.SEPARATORS else None
        )
        following = dict(states) if not options and drop is None else {}
        for state, (score, text) in states.items():
            ways = [(state, score + drop, text)] if drop is not None else []
            for x, cost in options:
                k = T.char_class(x)
                ways.append(((state[1], k), score + cost + float(log_p[state[0]][state[1]][k]), text + x))
            for after, total, found in ways:
                if after not in following or total > following[after][0]:
                    following[after] = (total, found)
        states, before = following, ch
    return max(states.items(), key=lambda s: s[1][0] + float(log_p[s[0][0]][s[0][1]][0]))[1][1]


def test_decoder_reads_as_the_plain_search():
    rng = random.Random(5)
    log_p = np.log(np.random.default_rng(5).dirichlet(np.ones(64), (64, 64))).astype(np.float32)
    decoder = T.Decoder(log_p)
    signs = "abcdeeilostyé0123@$!|+€*#(.-_~' ^:,%?中ßñ\U0001d4d0"
    for _ in range(3000):
        token = "".join(rng.choice(signs) for _ in range(rng.randint(1, 12)))
        for split in (False, True):
            assert decoder.decode(token, split) == _plain_decode(log_p, token, split), token
    # words of plain letters are not searched
    calls = []
    decoder.decode = lambda token, split=False: calls.append(token) or token
    restore = T.Restorer(decoder, lambda w: 1.0)
    assert set(restore("plain words a b here")) == {"plain", "words", "a", "b", "here"} and not calls
