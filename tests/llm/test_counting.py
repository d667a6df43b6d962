import random

import numpy as np
import pyarrow as pa
import pytest

from quilt.llm import topics
from quilt.llm.tokens import Encoder, public_path


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_are_those_of_the_ids(name):
    rng = random.Random(3)
    signs = "abcXYZÀéñÿ0159 '  \t\n.,!?-_sdtrevm's're中ё \x85\xa0\x1c\x1f#$"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["", "don't we'll <unk> <s> </s> [PAD]", "'s 'S 'LL I'VE", "a\x1cb c\x1fd", "x" * 300]
    encoder = Encoder(public_path(name))
    want = [len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert encoder.count(texts) == want
    assert encoder.count(texts) == want  # from memory
    if name.startswith("word"):  # numbers alone are held for plain texts
        plain = Encoder(public_path(name))
        plain.count(["plain words, plain words"])
        assert plain.word_sizes and not plain.pieces and not plain.memo


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_vectors_are_read_where_they_lie(kind):
    x = np.random.default_rng(4).integers(0, 200, (6, topics.WIDTH)).astype(np.int16)
    column = pa.array([x[:1].tobytes(), x[1:3].tobytes(), x[3:].tobytes()], kind)
    assert (topics._units(column) == x).all() and (topics._units(column.slice(1, 1)) == x[1:3]).all()
    assert topics._units(pa.array([], kind)).shape == (0, topics.WIDTH)
    halves = pa.array([b"\0" * 2 * topics.WIDTH, None, x[0].astype(np.float16).tobytes()], kind)
    assert (topics._unpacked(halves.drop_null())[1] == x[0]).all()


def test_common_units_stay_in_a_full_memo(monkeypatch):
    from quilt.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_UNITS", 100)
    encoder = Encoder(public_path("word_bpe_49k.json"))
    learnt = []
    tokenized = encoder._tokenized
    monkeypatch.setattr(encoder, "_tokenized", lambda units: learnt.extend(units) or tokenized(units))
    texts = [f"often {a}{b}zq," for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    want = [len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert encoder.count(texts) == want
    assert learnt.count("often") == 1 and len(encoder.word_sizes) <= 110
    learnt.clear()
    assert [len(x) // 4 for x in encoder.encode(texts)] == want
    assert learnt.count("often") == 1 and len(encoder.pieces) <= 110


def test_a_unit_is_remembered_once_alone_and_in_words():
    encoder = Encoder(public_path("word_bpe_49k.json"))
    first = encoder.count(["qwyx, qwyx"])
    assert sorted(encoder.word_sizes) == [",", "qwyx", "qwyx,"] and encoder.count(["qwyx , qwyx"]) == first
