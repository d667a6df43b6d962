"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of variable order: how often each byte
followed each context of up to ORDER bytes. A byte costs log2((N + D) / n) in the
longest context that has it (n: its count there, N: all counts, D: different
bytes); each longer context that is known but lacks it first costs an escape,
log2((N + D) / D); a byte no context has costs 8 bits below the empty context. The
statistics are frozen before any text is scored, and a text's language is the one
whose tree spells it in the fewest bits.

What is spelled are the lower-cased runs of signs between white space that hold a
letter, without ASCII punctuation at either end, each between two blanks; contexts
stay inside a run. So a run costs the same wherever it stands, and a process works
the bits of each different run out once, for all languages together.

Counts cover every learnable text. The trees keep the contexts counted at least t
times over all languages, with t the least power of two at which a model has at
most MAX_NODES nodes and MAX_CELLS counts (a bound of the model's size; every
suffix of a kept context is kept, as it is counted no less often).
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import save, slices

ORDER = 4
MAX_NODES, MAX_CELLS = 1_000_000, 4_000_000
MEMO_RUNS, MEMO_CHARS = 200_000, 20_000_000
BLOCK = 1 << 18  # bytes that are looked up at once

_PUNCTUATION = string.punctuation


def runs_of(text: str) -> list[str]:
    return text.lower().split()


def spelled(run: str) -> bytes | None:
    """What is spelled of a run; None without a letter."""
    run = run.strip(_PUNCTUATION)
    return b" " + run.encode("utf-8", "surrogatepass") + b" " if any(map(str.isalpha, run)) else None


def _layout(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and for each the bytes before it in its part, at most ORDER."""
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    data = np.frombuffer(b"".join(parts), np.uint8)
    return data, np.minimum(np.arange(len(data)) - starts, ORDER)


def _grams(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The byte at each place with the k before it, as one number: a leading 1,
    so that lengths differ, then the bytes. Without its last byte: its context."""
    out = np.ones(len(at), np.int64)
    for i in range(k, -1, -1):
        out = (out << 8) | data[at - i]
    return out


def gram_counts(parts: list[bytes], times: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Every context with its next byte, and how often, over the parts' bytes
    after their first blank."""
    data, depth = _layout(parts)
    weight = np.repeat(np.array(times, np.int64), [len(p) for p in parts])
    codes, sums = [], []
    for k in range(ORDER + 1):
        at = np.flatnonzero(depth >= max(k, 1))
        got, back = np.unique(_grams(data, at, k), return_inverse=True)
        codes.append(got)
        sums.append(np.bincount(back, weights=weight[at], minlength=len(got)).astype(np.int64))
    return np.concatenate(codes), np.concatenate(sums)


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted numbers in the sorted table, and which are there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


@dataclass
class Trees:
    """The frozen trees of all languages. ``bits``: of the last byte of a gram in
    its context, escapes that lead to it included; ``escapes``: of each context,
    0 for a language that does not know it."""

    langs: list[str]
    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray

    @staticmethod
    def freeze(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Trees:
        """From counts of (language number, gram)."""
        grams, row = np.unique(gram, return_inverse=True)
        counts = np.zeros((len(grams), len(langs)))
        counts[row, lang] = n
        contexts, of = np.unique(grams >> 8, return_inverse=True)
        total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
        np.add.at(total, of, counts)
        np.add.at(kinds, of, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escapes = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            bits = np.log2((total + kinds)[of] / counts)
        # orders upwards: an unseen byte costs the escape and its cost one order below
        length = (np.frexp(grams.astype(float))[1] - 1) // 8
        for k in range(1, ORDER + 2):
            here = np.flatnonzero(length == k)
            if k == 1:
                below = np.full((len(here), len(langs)), 8.0)
            else:
                mask = np.int64((1 << 8 * (k - 1)) - 1)
                at, known = _find(grams, (grams[here] & mask) | (mask + 1))
                assert known.all()
                below = bits[at]
            bits[here] = np.where(counts[here] > 0, bits[here], escapes[of[here]] + below)
        return Trees(langs, grams, bits, contexts, escapes)

    def spell(self, parts: list[bytes]) -> np.ndarray:
        """Bits of each part in each language."""
        out = np.zeros((len(parts), len(self.langs)))
        if not parts:
            return out
        data, depth = _layout(parts)
        ends = np.cumsum([len(p) for p in parts])
        for a in range(0, len(data), BLOCK):
            at = np.arange(a, min(a + BLOCK, len(data)))
            at = at[depth[at] > 0]  # the first blank is given
            cost, left = np.zeros((len(at), len(self.langs))), np.arange(len(at))
            for k in range(ORDER, -1, -1):
                deep = depth[at[left]] >= k
                here = left[deep]
                code = _grams(data, at[here], k)
                where, known = _find(self.grams, code)
                cost[here[known]] += self.bits[where[known]]
                lost = here[~known]
                where, is_context = _find(self.contexts, code[~known] >> 8)
                cost[lost[is_context]] += self.escapes[where[is_context]]
                left = np.concatenate((left[~deep], lost))
            cost[left] += 8.0
            if len(at):
                part = np.searchsorted(ends, at, side="right")
                first = np.flatnonzero(np.diff(part, prepend=-1))
                out[part[first]] += np.add.reduceat(cost, first, axis=0)
        return out


class Speller:
    """Bits of whole texts; runs seen before are looked up."""

    def __init__(self, trees: Trees):
        self.trees, self.memo, self.size = trees, {}, 0
        self.rows = np.zeros((0, len(trees.langs)))

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """None for a text without a letter."""
        if len(self.memo) > MEMO_RUNS or self.size > MEMO_CHARS:
            self.memo, self.size, self.rows = {}, 0, self.rows[:0]
        runs = [runs_of(t) if t else [] for t in texts]
        new = list(set().union(*runs).difference(self.memo))
        parts = [spelled(r) for r in new]
        kept = [i for i, p in enumerate(parts) if p is not None]
        at = len(self.rows)
        self.memo.update(dict.fromkeys(new, -1))
        self.memo.update((new[i], at + j) for j, i in enumerate(kept))
        self.size += sum(map(len, new))
        if kept:
            self.rows = np.concatenate((self.rows, self.trees.spell([parts[i] for i in kept])))
        out: list[np.ndarray | None] = []
        for r in runs:
            rows = np.fromiter(map(self.memo.__getitem__, r), np.int64, len(r))
            rows = rows[rows >= 0]
            out.append(self.rows[rows].sum(axis=0) if len(rows) else None)
        return out


def count_contexts(texts: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (_lang, _text): summed in each task, then
    in a shuffle of grams."""

    def count(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def flush():
            for lang, found in held.items():
                kept = [(p, n) for r, n in found.items() if (p := spelled(r)) is not None]
                for i in range(0, len(kept), 50_000):
                    codes, sums = gram_counts(*map(list, zip(*kept[i : i + 50_000])))
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(codes), pa.string()), "gram": pa.array(codes), "n": pa.array(sums),
                    })
            held.clear()

        chars = 0
        for batch in slices(batches):
            for lang, text in zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist()):
                held[lang].update(runs_of(text))
                chars += len(text)
                if chars > MEMO_CHARS:
                    yield from flush()
                    chars = 0
        yield from flush()

    return texts.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame, usable: Column, lang_col: str = "lang", text_col: str = "text", max_nodes: int = MAX_NODES,
) -> Trees | None:
    """Trees learnt from all rows where ``usable`` with a text and a language;
    None if there is no letter to learn from."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")
    )
    counts = save(count_contexts(rows))
    langs = sorted(r[0] for r in counts.where(f"gram >= 256 AND gram < 512").select("lang").distinct().collect())
    if not langs:
        return None
    totals = counts.groupBy("gram").agg(F.sum("n").alias("total"))
    # grams by the power of two that their total reaches: at most 64 rows
    reach = dict(totals.groupBy(F.floor(F.log2("total")).alias("b")).count().collect())
    room, t = min(max_nodes, MAX_CELLS // len(langs)), 64
    while t > 0 and sum(n for b, n in reach.items() if b >= t - 1) <= room:
        t -= 1
    kept = counts if t == 0 else counts.join(totals.where(F.col("total") >= 2**t).select("gram"), "gram")
    number = {x: i for i, x in enumerate(langs)}
    table = kept.select("lang", "gram", "n").toArrow()  # at most MAX_CELLS rows
    lang = np.array([number[x] for x in table["lang"].to_pylist()], np.int64)
    return Trees.freeze(langs, lang, table["gram"].to_numpy(), table["n"].to_numpy())


def predict(
    docs: DataFrame, trees: Trees | None, keep: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: the id, ``lang_pred`` (fewest bits; ties to
    the language that sorts first) and ``score``, the share of that language in
    2^-bits over all, 0 to 1; then the columns ``keep``.

    Null texts and texts without a letter give ``und`` and score 0, and so do all
    without trees. Every run of a text counts, however long the text; equal texts
    get equal results; rows may repeat; an empty table gives an empty result;
    other columns are not read."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(keep or []))
    more = rows.columns[2:]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        speller = Speller(held.value) if held.value else None
        for batch in slices(batches):
            texts = batch.column("_text").to_pylist()
            names, scores = [], []
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                for bits in speller.texts(part) if speller else [None] * len(part):
                    if bits is None:
                        names.append("und")
                        scores.append(0.0)
                    else:
                        best = int(np.argmin(bits))
                        names.append(speller.trees.langs[best])
                        scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
            yield pa.RecordBatch.from_pydict({
                "_id": batch.column("_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()),
                **{c: batch.column(c) for c in more},
            })

    schema = ", ".join([f"_id {kinds['_id']}", "lang_pred string", "score double", *(f"`{c}` {kinds[c]}" for c in more)])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
