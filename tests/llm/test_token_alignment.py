import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF001

from quilt.llm import token_alignment as T
from quilt.llm.queries import QUERIES
from quilt.llm.tokens import public_path

A, B = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TRICKY = [
    "", None, " ", "  two  blanks ", "one", "héllo wörld\n\tx 你好😀 y", "a<|endoftext|>b <s> </s> <0x41> <unk>", "▁a", "x y 　 z",
    "tab\t tab", "ends in blank ", "😀😀👩‍👩‍👧 é́", "it's they'll 12,345.67", "\x00\x01 \x1c \x7f", "ñandú  canción", "\r\n\r\n  x", "日本語のテキスト です",
    "same same same", "same same same", "a" * 3000, "ẞ ﬁ ǅ", "퟿ \U0010ffff", "क्षि ज्ञ", "don 't", " ́x",
]


@pytest.fixture(scope="module")
def one():
    return T.Aligner(A, B)


def plain(one, text):
    """Both tokenizations of the whole text by decoded bytes alone, or None."""
    if not text:
        return None
    import re

    a = one.a.encode(" " + text, add_special_tokens=False).ids
    b = one.b.encode(text)
    letters = {c: i for i, c in enumerate(T._LETTERS)}
    ab = [bytes(letters[c] for c in one.a.id_to_token(i)) for i in a]
    bb = []
    for i in b:
        p = one.b.id_to_piece(i)
        bb.append(bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
    data = (" " + text).encode()
    if b"".join(ab) != data or b"".join(bb) != data:
        return None

    def spans(ids, parts):
        out, at = [], 0
        for i, p in zip(ids, parts):
            out.append((i, at, at + len(p)))
            at += len(p)
        return out

    return spans(a, ab), spans(b, bb)


def brute(one, texts):
    held = Counter()
    all_links = []
    rows = []
    for text in texts:
        got = plain(one, text)
        if got is None:
            rows.append(None)
            all_links.append([])
            continue
        a, b = got
        links = [(x, y) for x, s, e in a for y, u, v in b if max(s, u) < min(e, v)]
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in both:
            groups.append(
                ",".join(str(i) for i, s, e in a if start <= s and e <= end) + "|" + ",".join(str(i) for i, s, e in b if start <= s and e <= end)
            )
            start = end
        held.update(set(links))
        rows.append((len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        all_links.append(links)
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for row, links in zip(rows, all_links):
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((*row[:4], sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), row[4]))
    return out


def table(spark, texts):
    rows = [(i, t, "n", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, pair string, n_a int, _id int").repartition(3)


def corpus(n=40, seed=3):
    rng = random.Random(seed)
    words = "the cat, naïve Straße 你好 running😀 e-mail 3.14 don't Überraschung camión\n\tx  y zebra's <s> ▁".split(" ")
    return TRICKY + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("max_pairs", [T.MAX_PAIRS, 0])
def test_against_whole_texts_and_plain_loops(spark, one, max_pairs):
    texts = corpus()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in T.align_tokens(table(spark, texts), A, B, max_pairs=max_pairs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(one, texts)


def test_units_align_as_whole_texts(one):
    """Cut at blanks or not, the tokens and their ends are the same."""
    assert one.cuts
    for text in corpus(200, 9):
        if not text:
            continue
        (whole,), parts = one.spans([text]), one.spans(one.units(text))
        assert (whole is None) == any(p is None for p in parts), text
        if whole is None:
            assert plain(one, text) is None
            continue
        a, b, shift = [], [], 0
        for p in parts:
            a += [(i, e + shift) for i, e in zip(p.a, p.a_ends)]
            b += [(i, e + shift) for i, e in zip(p.b, p.b_ends)]
            shift += p.a_ends[-1]
        assert a == list(zip(whole.a, whole.a_ends)) and b == list(zip(whole.b, whole.b_ends)), text
        x, y = plain(one, text)
        assert a == [(i, e) for i, _, e in x] and b == [(i, e) for i, _, e in y]


def test_links_and_groups_of_a_small_case(one):
    spans = T.Spans(*map(np.array, ([1, 2, 3], [7, 8, 9], [2, 5, 8], [3, 5, 8])))
    got = T.cut(one, spans, np.array([5, 8]))
    assert got.written == ["1,2|7,8;", "3|9;"] and got.figures.tolist() == [[2, 2, 1, 3], [1, 1, 1, 1]]
    assert [divmod(x, 1 << T.ID_BITS) for x in got.links.tolist()] == [(1, 7), (2, 7), (2, 8), (3, 9)] and got.first.tolist() == [0, 3, 4]


def test_small_memos_and_chunks_change_nothing(spark, one, monkeypatch):
    monkeypatch.setattr(T, "MEMO_UNITS", 4)
    monkeypatch.setattr(T, "MEMO_CHARS", 3)
    monkeypatch.setattr(T, "CHUNK_UNITS", 3)
    monkeypatch.setattr(T, "TEXTS", 4)
    texts = corpus(15, 5)
    units = T.Units(one)
    got = [units.texts(texts[i : i + 4]) for i in range(0, len(texts), 4)]
    want = brute(one, texts)
    assert [tuple(r) for g in got for r in g[0].tolist()] == [w[:4] for w in want]
    assert [d for g in got for d in g[1]] == [w[6] for w in want]


def test_empty_table(spark):
    out = T.align_tokens(spark.createDataFrame([], "doc_id bigint, text string"), A, B)
    assert out.collect() == [] and out.columns == ["doc_id", *COLUMNS]
    nothing = T.align_tokens(spark.createDataFrame([(1, None), (None, ""), (1, "▁")], "doc_id bigint, text string"), A, B).collect()
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in nothing) and len(nothing) == 3


def test_query_on_the_table(spark, one):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_token_alignment"](spark, SF001).collect()}
    assert len(got) == len(docs)
    docs = sorted(docs, key=lambda r: len(r["text"] or ""))
    short = [r for r in docs if len(r["text"] or "") < 1500]
    # counts need all texts; the rest is held against plain loops on the short ones
    for r, want in zip(short, brute(one, [r["text"] for r in short])):
        assert got[r["doc_id"]][:4] == want[:4] and got[r["doc_id"]][6] == want[6]
