import hashlib
import random
import re

from conftest import SF001
from pyspark.sql import functions as F

from quilt.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_patterns_equal_plain_expressions():
    rng = random.Random(9)
    pool = ["a@b.c", "@", ".", "-", "_", "x", "Z9", "4111 1111 1111 1111", "4539-1488-0343-6467", "0", "255", "256", "1.2.3.4", "+1 (017) 555-7713", "+", "(", ")", " ", "\n", "é", "%", "٣"]
    for _ in range(30000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 150_000, "+1" * 100_000, "a." * 150_000):
        pii.base_spans(text)


def test_documents_against_plain_expressions(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet").withColumn("base", F.lit(1)).withColumn("_h1", F.lit(1))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = pii.find_pii(df).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r["doc_id"]] or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert r["spans"].startswith(told)


def corpus():
    """'Zanzibar' stands only near one address, 'hello' everywhere."""
    rows = [(i, f"hello word{i} some words here Zanzibar and x@y.org end{i}") for i in range(5)]
    rows += [(10 + i, f"hello plain{i} some words here and nothing") for i in range(200)]
    rows += [(500, "Zanzibar alone"), (501, None), (502, ""), (None, "zanzibar 1.2.3.4"), (502, "repeat x@y.org"), (502, "repeat x@y.org")]
    rows.append((503, "hello " * 50_000 + "\n" + "q" * 100_000))
    return rows


def check_terms(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string").repartition(4)
    rows = pii.find_pii(df).collect()
    terms = {r["doc_id"]: r["n_term"] for r in rows if r["doc_id"] != 502}
    assert all(terms[i] == 1 for i in (*range(5), 500, None))
    assert all(terms[10 + i] == 0 for i in range(200)) and terms[501] == 0 and terms[503] == 0
    one = next(r for r in rows if r["doc_id"] == 3)
    text = dict((k, v) for k, v in corpus() if k is not None)[3]
    spans = [s.split(":") for s in one["spans"].split(",")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in spans] == [("email", "x@y.org"), ("term", "Zanzibar")]
    assert len(rows) == len(corpus())


def test_terms_that_disclose(spark):
    check_terms(spark)


def test_copies_of_a_line_count_once(spark):
    rows = [(i, "rare Quetzal text with x@y.org") for i in range(50)] + [(100 + i, f"plain {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert pii.disclosing_terms(df).count() == 0


def test_terms_by_a_join_as_by_a_broadcast(spark, monkeypatch):
    """More terms than may go to every task: the same spans and the same text."""
    rows = [(i, f"hello word{i} Quetzal Zanzibar Xylophone x@y.org end{i} İstanbul") for i in range(5)]
    rows += [(10 + i, f"hello plain{i} some words") for i in range(200)] + [(5, "zanzibar\nQUETZAL, 1.2.3.4"), (5, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    one = sorted(map(str, pii.find_pii(df, with_text=True).collect()))
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 1)
    assert sorted(map(str, pii.find_pii(df, with_text=True).collect())) == one
    assert sum("term:" in r for r in one) == 6 and any("\\n" in r and "[ip]" in r and "QUETZAL" not in r for r in one)


def test_address_parts_of_many_zeros():
    assert pii.base_spans("0" * 5000 + ".1.2.3") == [("ip", 0, 5006)]
    assert pii.base_spans("0.0.0." + "0" * 9000) == [("ip", 0, 9006)] and pii.base_spans("1.2.3.0256") == []


def test_lines_of_many_entities_take_linear_time():
    import time

    for text in (" ".join(f"user{i}@host{i}.org met" for i in range(8000)), "\n".join(f"user{i}@host{i}.org met" for i in range(8000))):
        began = time.time()
        got = pii.contexts(text)
        assert len(got) == 8000 and time.time() - began < 2
        began = time.time()
        spans = pii.term_spans(text, pii.base_spans(text), {"met": 1.0})
        assert len(spans) == 8000 and time.time() - began < 2


def plain_contexts(text):
    """The words near each entity by plain loops."""
    spans, out = pii.base_spans(text), []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        lo, hi = text.rfind("\n", 0, a) + 1, (text.find("\n", b) + 1 or len(text) + 1) - 1
        free = [m for m in pii.TERM.finditer(text, lo, hi) if not any(x < m.end() and m.start() < y for _, x, y in spans)]
        before, after = [m for m in free if m.end() <= a], [m for m in free if m.start() >= b]
        out.append(sorted({m.group().lower() for m in before[-pii.WINDOW :] + after[: pii.WINDOW]}))
    return out


def test_near_words_against_plain_loops():
    rng = random.Random(3)
    pool = ["word", "Name", "a@b.cd", "1.2.3.4", "+1 (017) 555-7713", "\n", "xy", "déjà", "4111 1111 1111 1111", "long" * 200, "9.9.9.9.9"]
    for _ in range(2000):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(1, 60)))
        assert [n for *_, n in pii.contexts(text)] == plain_contexts(text), text


def test_sanitised_text(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    got = {r["doc_id"]: r["clean_text"] for r in pii.find_pii(df, with_text=True).collect()}
    assert "x@y.org" not in got[2] and "Zanzibar" not in got[2] and got[2].startswith("hello word2 some words here ")
    assert "[email]" in got[2] and got[12] == "hello plain2 some words here and nothing"


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
