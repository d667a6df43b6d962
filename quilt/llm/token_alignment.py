"""Alignment of two tokenizers' tokens over each text.

Tokenizer A is a file of the ``tokenizers`` library, B a ``sentencepiece`` model.
The text that both cut is a blank and the text (B adds the blank itself).

Spans give the coarse cuts: A's character offsets, taken to bytes, and the spans
of B's encoding proto. A token that shares a character with its neighbour (a part
of a multibyte character, or a byte-fallback token) ends where its decoded bytes
end. Every span is then held against the decoded bytes of its token, so a text
that a tokenizer changes (normalised, or an own sign in place of a blank) is told.

Encoding costs most and words repeat, so a text is cut at each single blank
between other signs where both tokenizers provably start anew (A: byte-level with
the usual pattern and no normaliser; B: no normalisation, and no piece that goes
on after a blank), and a task aligns each new unit once, many at a time and in
arrays. Any other pair of tokenizers aligns whole texts.

Texts are encoded in one pass, which writes each text's figures with its different
pairs of ids and how often each is linked. From these the pairs' texts are counted
(partial sums per task, then a shuffle of pairs), and the counts are added up over
each text's pairs: by a broadcast of the pair counts while there are at most
``max_pairs`` of them, and by a shuffled join beyond.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import map_batches, save, shared_folder, slices
from quilt.llm.tokens import _kind, _LETTERS

# Pair counts that may be broadcast: 17 bytes each.
MAX_PAIRS = 4_000_000
# Units that a task remembers, up to so many characters each.
MEMO_UNITS, MEMO_CHARS = 300_000, 64
# Units, and their characters, that are encoded as one text.
CHUNK_UNITS, CHUNK_CHARS = 256, 1 << 16
# Texts that are worked on at a time, and the bits of an id of B in a pair.
TEXTS = 512
ID_BITS = 22

# (a blank may stand between these, with no other white space beside it)
_CUT = re.compile(r"(?<=\S) (?=\S)")


@dataclass
class Spans:
    """Both tokenizations of a text; ends are byte offsets, the last one the
    length of the blank and the text."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray


def _refined(coarse: np.ndarray, lengths: np.ndarray, inside: np.ndarray) -> np.ndarray | None:
    """Ends of tokens from coarse cuts: a token that ends ``inside`` a character
    (its span tells no byte) ends where the decoded bytes since the last cut do.
    None if a coarse cut and the decoded bytes disagree."""
    decoded = np.cumsum(lengths)
    ends = np.where(inside, decoded, coarse)
    return ends if (lengths > 0).all() and (ends == decoded).all() else None


class Aligner:
    """The two tokenizers of a process."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        code = {c: b for b, c in enumerate(_LETTERS)}
        vocabulary = self.a.get_vocab(True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            if all(c in code for c in t):
                self.a_bytes[i] = bytes(code[c] for c in t)
        n = self.b.get_piece_size()
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(n)
        ]
        if max(len(self.a_bytes), n) > 1 << ID_BITS or TEXTS > 1 << (62 - 2 * ID_BITS):
            raise ValueError("vocabularies of at most 2^22 ids")
        self.a_length, self.b_length = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(n)])
        # ids as they are written, with the sign that follows
        self.a_written, self.b_written = (
            np.array([[f"{i}{sign}" for i in range(len(t))] for sign in signs], object)
            for t, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))
        )
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        model = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        anew = not norm.precompiled_charsmap and not norm.normalization_rule_tsv and norm.add_dummy_prefix and (
            not norm.remove_extra_whitespaces and norm.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        )
        inner = any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(n))
        bpe = model.trainer_spec.model_type == model.trainer_spec.BPE
        self.cuts = _kind(spec) == "byte" and not spec.get("post_processor") and anew and bpe and not inner

    def units(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def spans(self, texts: list[str]) -> list[Spans | None]:
        """None where a tokenizer's bytes are not those of the blank and the text."""
        ours = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        theirs = self.b.encode(texts, return_type="proto", num_threads=1)
        return [self._spans(t, x, y) for t, x, y in zip(texts, ours, theirs, strict=True)]

    def _spans(self, text: str, ours, theirs) -> Spans | None:
        data = b" " + text.encode("utf-8", "surrogatepass")
        pieces = theirs.pieces
        a, b = ours.ids, [p.id for p in pieces]
        if not a or not b or b"".join(map(self.a_bytes.__getitem__, a)) != data:
            return None
        if b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a, b = np.array(a), np.array(b)
        # A's cuts: the bytes where its characters end, unless the next token
        # begins in the same character
        offsets = np.fromiter(chain.from_iterable(ours.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        ends = offsets[:, 1]
        if len(data) > len(text) + 1:
            lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            ends = np.append(lead, len(data))[ends]
        shared = np.append(offsets[1:, 0] < offsets[:-1, 1], False)
        a_ends = _refined(ends, self.a_length[a], shared)
        # B's cuts: the ends of its spans (behind the blank that it added)
        b_ends = _refined(np.array([p.end for p in pieces]) + 1, self.b_length[b], self.b_is_byte[b])
        return None if a_ends is None or b_ends is None else Spans(a, b, a_ends, b_ends)


@dataclass
class Cut:
    """What a run of units gave: a row of figures for each unit, its groups as
    they are written (each with a ';' behind it), and its links in order, as A id
    * 2^ID_BITS + B id, from ``first`` on."""

    figures: np.ndarray  # n_a, n_b, n_groups, n_links
    written: list[str]
    links: np.ndarray
    first: np.ndarray


def cut(one: Aligner, spans: Spans, unit_ends: np.ndarray) -> Cut:
    """Groups and links of a text's units; both tokenizers end at each unit's end."""
    mark = np.zeros(int(unit_ends[-1]) + 1, np.int8)
    mark[spans.a_ends] = 1
    mark[spans.b_ends] += 2
    both, groups = np.flatnonzero(mark), np.flatnonzero(mark == 3)  # each stretch up to one of ``both`` is a link
    a_at, b_at, at = (np.cumsum(m) for m in (mark & 1, mark >> 1, mark == 3))  # tokens, groups that end so far
    links = (spans.a[a_at[both - 1]].astype(np.int64) << ID_BITS) | spans.b[b_at[both - 1]]
    upto = [x[unit_ends] for x in (a_at, b_at, at)] + [np.searchsorted(both, unit_ends, side="right")]
    figures = np.stack([np.diff(u, prepend=0) for u in upto], axis=1)
    # the ids of a group: A's, then B's
    a_group, b_group = at[spans.a_ends - 1], at[spans.b_ends - 1]
    a_last, b_last = mark[spans.a_ends] == 3, mark[spans.b_ends] == 3
    a_upto, b_upto = a_at[groups], b_at[groups]
    row = np.empty(len(spans.a) + len(spans.b), object)
    row[np.arange(len(spans.a)) + np.concatenate(([0], b_upto[:-1]))[a_group]] = one.a_written[a_last.astype(int), spans.a]
    row[np.arange(len(spans.b)) + a_upto[b_group]] = one.b_written[b_last.astype(int), spans.b]
    row, ends = row.tolist(), (upto[0] + upto[1]).tolist()
    written = ["".join(row[i:j]) for i, j in zip([0, *ends[:-1]], ends)]
    return Cut(figures, written, links, np.concatenate(([0], upto[3])))


class Units:
    """The figures, groups and links of units, each aligned once and remembered."""

    def __init__(self, one: Aligner):
        self.one = one
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}  # -1: the tokens do not spell the unit
        self.figures, self.written = [np.zeros((0, 4), np.int64)], []
        self.links, self.sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.count = 0

    def learn(self, units: list[str]) -> None:
        chunks, alone, size = [[]], [], 0
        for u in units:
            # (units with white space at an end would not start anew after another)
            if not self.one.cuts or u[:1].isspace() or u[-1:].isspace() or not u:
                alone.append([u])
                continue
            if chunks[-1] and (len(chunks[-1]) >= CHUNK_UNITS or size + len(u) > CHUNK_CHARS):
                chunks.append([])
                size = 0
            chunks[-1].append(u)
            size += len(u)
        chunks = [c for c in chunks + alone if c]
        again = []
        for chunk, spans in zip(chunks, self.one.spans([" ".join(c) for c in chunks]), strict=True):
            if spans is not None:
                self._take(chunk, spans)
            elif len(chunk) == 1:
                self.place[chunk[0]] = -1
            else:
                again += chunk
        for u, spans in zip(again, self.one.spans(again) if again else []):
            if spans is None:
                self.place[u] = -1
            else:
                self._take([u], spans)

    def _take(self, chunk: list[str], spans: Spans) -> None:
        ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) + 1 for u in chunk])
        got = cut(self.one, spans, ends)
        self.place.update(zip(chunk, range(self.count, self.count + len(chunk))))
        self.count += len(chunk)
        self.figures.append(got.figures)
        self.written += got.written
        self.links.append(got.links)
        self.sizes.append(np.diff(got.first))

    def texts(self, texts: list[str | None]):
        """For each text a row of figures and the digest of its groups; for all of
        them the different (text, pair) and how often each is linked."""
        if len(self.place) > MEMO_UNITS:
            self.clear()
        units = [self.one.units(t) if t else [] for t in texts]
        new = set().union(*units).difference(self.place)
        if new:
            self.learn(list(new))
            self.figures, self.links = [np.concatenate(self.figures)], [np.concatenate(self.links)]
            self.sizes = [np.concatenate(self.sizes)]
        places = [list(map(self.place.__getitem__, u)) for u in units]
        spelled = [bool(p) and min(p) >= 0 for p in places]
        places = [p if ok else [] for p, ok in zip(places, spelled)]
        many = [len(p) for p in places]
        text = np.repeat(np.arange(len(texts)), many)
        at = np.fromiter(chain.from_iterable(places), np.int64, len(text))
        ends = np.concatenate(([0], np.cumsum(many)))
        summed = np.concatenate((np.zeros((1, 4), np.int64), np.cumsum(self.figures[0][at], axis=0)))
        figures = np.diff(summed[ends], axis=0)
        digests = [
            hashlib.sha256("".join(map(self.written.__getitem__, p))[:-1].encode()).hexdigest() if ok else ""
            for p, ok in zip(places, spelled)
        ]
        # the links of each unit that stands in a text
        sizes = self.sizes[0][at]
        start = (np.cumsum(self.sizes[0]) - self.sizes[0])[at]
        each = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        key = np.sort((np.repeat(text, sizes) << 2 * ID_BITS) | self.links[0][each])
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
        times = np.diff(first, append=len(key))
        owner, pairs = key[first] >> 2 * ID_BITS, key[first] & ((1 << 2 * ID_BITS) - 1)
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        forget = [u for u in new if len(u) > MEMO_CHARS]
        for u in forget:  # (their rows go with the next clearing)
            del self.place[u]
        if self.count > 2 * MEMO_UNITS:
            self.clear()
        return figures, digests, pairs, times, ends


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this process for two tokenizer files."""
    key = (a_path, b_path)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_path, b_path)
    return _ALIGNERS[key]


_FIELDS = ("n_a", "n_b", "n_groups", "n_links")


def encode(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each row of (_id, _text): the figures, the digest, and the different
    pairs with how often each is linked."""
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        units = Units(aligner(a_path, b_path))
        for batch in slices(batches, TEXTS):
            figures, digests, pairs, times, ends = units.texts(batch.column("_text").to_pylist())
            lists = (pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v.astype(t))) for v, t in ((pairs, np.int64), (times, np.int32)))
            yield pa.RecordBatch.from_pydict({
                "_id": batch.column("_id"), **{f: pa.array(figures[:, i]) for i, f in enumerate(_FIELDS)},
                "groups_sha256": pa.array(digests, pa.string()), **dict(zip(("pairs", "times"), lists)),
            })

    names = ", ".join(f"{f} bigint" for f in _FIELDS)
    return rows.mapInArrow(run, f"_id {kind}, {names}, groups_sha256 string, pairs array<bigint>, times array<int>")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(pair, n, best): for each linked pair of ids the texts that hold it, and
    whether no pair of its A id is in more."""
    summed = save(encoded.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    with_a = summed.withColumn("a", F.shiftright("pair", ID_BITS))
    most = with_a.groupBy("a").agg(F.max("n").alias("most"))  # at most one row for each id of A
    return with_a.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = MAX_PAIRS,
) -> DataFrame:
    """One row per row of ``docs``: the id, n_a and n_b (tokens), n_groups,
    n_links, n_best (links whose pair is in no fewer texts than any pair of its A
    id), count_sum (over the links, the texts that hold their pair) and
    groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).

    Null and empty texts, and texts whose tokens do not spell a blank and the text
    in bytes, have zeros and an empty digest, and count for no pair. Rows that
    repeat an id or a text count each; strings of special tokens are plain text;
    long texts are read whole, units of more than MEMO_CHARS characters without
    being remembered; an empty table gives an empty result; other columns are not
    read."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    path = shared_folder(spark, "alignment")
    encode(rows, a_path, b_path).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    encoded = spark.read.parquet(path)
    pairs = save(pair_counts(encoded))
    joined = _by_broadcast if pairs.count() <= max_pairs else _by_shuffle
    return joined(encoded, pairs).select(F.col("_id").alias(id_col), *_FIELDS, "n_best", "count_sum", "groups_sha256")


def _by_broadcast(encoded: DataFrame, pairs: DataFrame) -> DataFrame:
    table = pairs.toArrow()
    keys = table["pair"].to_numpy()
    order = np.argsort(keys)
    held = encoded.sparkSession.sparkContext.broadcast(
        (keys[order], table["n"].to_numpy()[order], table["best"].to_numpy(zero_copy_only=False)[order])
    )

    def add(batch):
        keys, n, best = held.value
        found, times = batch.column("pairs"), batch.column("times")
        sizes = np.diff(np.asarray(found.offsets))
        at = np.searchsorted(keys, found.flatten().to_numpy(zero_copy_only=False))
        k = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        summed = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(np.stack((k * best[at], k * n[at]), axis=1), axis=0)))
        sums = np.diff(summed[ends], axis=0)
        return {
            **{c: batch.column(c) for c in ("_id", *_FIELDS, "groups_sha256")},
            "n_best": pa.array(sums[:, 0]), "count_sum": pa.array(sums[:, 1]),
        }

    kind = encoded.schema["_id"].dataType.simpleString()
    names = ", ".join(f"{f} bigint" for f in _FIELDS)
    rows = encoded.select("_id", *_FIELDS, "groups_sha256", "pairs", "times")
    return map_batches(rows, add, f"_id {kind}, {names}, groups_sha256 string, n_best bigint, count_sum bigint")


def _by_shuffle(encoded: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same without a broadcast: each text's pairs meet the counts in a join."""
    each = encoded.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    each = each.select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("bigint").alias("k"))
    sums = each.join(pairs, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum")
    )
    zero = F.lit(0).cast("bigint")
    return encoded.drop("pairs", "times").join(sums, "_row", "left").withColumns({
        "n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero),
    })
