"""Toxicity by noisy-channel deobfuscation.

Three parts, each learnt here:

* a character language model: counts of three successive characters over every
  text of the table, letters in 63 classes, so the model is one bounded table
  however large the corpus;
* the channel: what an author may have done to a word (a look-alike sign for a
  letter, separators between letters, letters repeated or masked), with a cost
  for each. A suspicious token becomes a lattice of possible letters, and
  Viterbi search takes its most probable reading under channel and model;
* a scorer: words and word beginnings whose document frequency differs between
  the labels beyond chance, from labelled rows, and a logistic curve over the
  evidence of a text's strongest words. Texts are scored on their restored words.

Language, source and ids never enter a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import save, slices
from quilt.llm.tokens import forget

# Look-alikes of letters (fixed values). '*' and '#' mask any vowel.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "*": "aeiou", "#": "aeiou",
}
WORDS_OF_ONE = set("aeiouyàéó")  # letters that are words in some language (fixed values)
SEPARATORS = set(" .-_*~'`^:,")
COST_SIGN, COST_DROP_REPEAT, COST_DROP_SEPARATOR = -0.7, -0.7, -0.2
COST_WORD_END = -1.0  # of a blank in a spaced run that is a blank after all

CLASSES = 64  # 0: no letter; 1..26: a..z; the rest: other letters, by code point
FEATURE_LENGTHS = (4, 5, 6)
# Labelled rows to learn from, per label, and features kept: bounds of the model.
MAX_ROWS_PER_LABEL = 20_000
MAX_FEATURES = 20_000
MEMO_TOKENS = 240_000
STRONGEST = 3  # words of a text whose evidence counts

_LETTER = r"[^\W\d_]"
_WORDS = re.compile(rf"{_LETTER}+")
_SIGNS = re.escape("0123456789@$!|+€£¡(*#")
_EDGE = ".,;:?\"')]}<>"
# A letter beside a sign that may stand for one or part two, or beside itself;
# whether it is a disguise is for the decoder to weigh.
_SUSPICIOUS = re.compile(
    rf"{_LETTER}[{_SIGNS}.\-_~'`^:,]|[{_SIGNS}.\-_~'`^:,]{_LETTER}|({_LETTER})\1"
)
_REPEATED = re.compile(rf"({_LETTER})\1")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_GAP = re.compile(r"\s+")


def _class_table() -> np.ndarray:
    table = np.zeros(0x3000, np.uint8)
    for c in range(len(table)):
        ch = chr(c)
        if "a" <= ch <= "z":
            table[c] = c - 96
        elif ch.isalpha():
            table[c] = 27 + c % (CLASSES - 27)
    return table


_TABLE = _class_table()


def char_class(ch: str) -> int:
    c = ord(ch)
    return int(_TABLE[c]) if c < len(_TABLE) else (27 + c % (CLASSES - 27) if ch.isalpha() else 0)


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts by a * 64**2 + b * 64 + c; every text stands between non-letters."""
    joined = ("\n" + "\n\n".join(texts) + "\n").lower()
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.minimum(code, len(_TABLE) - 1)
    k = _TABLE[known].astype(np.int32)
    for i in np.flatnonzero(code >= len(_TABLE)):
        k[i] = char_class(chr(code[i]))
    tri = (k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:]
    return np.bincount(tri, minlength=CLASSES**3)


def fit_char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(c | a b) over all texts, interpolated with the shorter contexts."""

    def count(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in slices(batches):
            texts = [t for t in batch.column(0).to_pylist() if t]
            for i in range(0, len(texts), 256):
                total += trigram_counts(texts[i : i + 256])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"tri": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    table = (
        docs.select(text_col).mapInArrow(count, "tri bigint, n bigint")
        .groupBy("tri").agg(F.sum("n").alias("n"))
    )
    n = np.zeros(CLASSES**3)
    for tri, k in table.collect():  # at most 64**3 rows
        n[tri] = k
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    one = (n.sum((0, 1)) + 1) / (n.sum() + CLASSES)
    two = n.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    three = (n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5)
    return np.log(three).astype(np.float32)


@dataclass
class Decoder:
    """Viterbi search over the lattice of a token."""

    log_p: np.ndarray
    lists: list = field(default=None, repr=False)
    rows: list = field(default=None, repr=False)
    signs: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"log_p": self.log_p, "lists": None, "rows": None, "signs": {}}

    def _sign(self, ch: str) -> tuple:
        """What a sign may stand for (letter, cost, class), whether it is a letter,
        and the cost of leaving it out (None: it stays)."""
        letter = ch.isalpha()
        options = [(ch, 0.0)] if letter else [(c, COST_SIGN) for c in LOOKALIKE.get(ch, "")]
        found = [(x, cost, char_class(x)) for x, cost in options], letter, COST_DROP_SEPARATOR if ch in SEPARATORS else None
        if len(self.signs) < CLASSES**2:
            self.signs[ch] = found
        return found

    def decode(self, token: str, split: bool = False) -> str:
        """The most probable word behind a lower-case token; '' if it holds no
        letter. With ``split`` a blank may also end a word, and the words come
        joined by blanks. Linear in the token's length."""
        if self.lists is None:
            self.lists = self.log_p.tolist()
            self.rows = [last for first in self.lists for last in first]
        log_p, known = self.rows, self.signs
        signs = [known.get(ch) or self._sign(ch) for ch in token]
        if not any(sign[1] for sign in signs):
            return ""
        # a state: the classes of the last two letters, as one number; its value:
        # score and text links. While there is one only, it is held in variables.
        state, score, link, states = 0, 0.0, None, None
        before = ""
        for ch, (options, is_letter, drop) in zip(token, signs):
            if is_letter:
                if ch == before:
                    drop = COST_DROP_REPEAT  # (a repeat may be left out)
                elif states is None and drop is None:
                    k = options[0][2]
                    score += log_p[state][k]
                    state, link, before = state % CLASSES * CLASSES + k, (link, ch), ch
                    continue
            elif split and ch == " ":
                options = [(ch, COST_WORD_END, 0)]
            before = ch
            if not options and drop is None:
                continue  # an unknown sign ends nothing and says nothing
            following: dict = {}
            for state, (score, link) in states.items() if states else ((state, (score, link)),):
                if drop is not None:
                    held = following.get(state)
                    if held is None or score + drop > held[0]:
                        following[state] = (score + drop, link)
                last, context = log_p[state], state % CLASSES * CLASSES
                for letter, cost, k in options:
                    total = score + cost + last[k]
                    held = following.get(context + k)
                    if held is None or total > held[0]:
                        following[context + k] = (total, (link, letter))
            states = following
            if len(states) == 1:
                (state, (score, link)), = states.items()
                states = None
        if states:
            link = max(states.items(), key=lambda s: s[1][0] + log_p[s[0]][0])[1][1]
        out = []
        while link:
            out.append(link[1])
            link = link[0]
        return "".join(reversed(out))


def features_of(word: str) -> list[str]:
    return ["=" + word] + [word[:k] for k in FEATURE_LENGTHS if len(word) >= k]


class Restorer:
    """The distinct words of a text, restored, mapped by ``keep`` (word -> value
    or None); only words with a value are returned."""

    def __init__(self, decoder: Decoder, keep):
        self.decoder, self.keep, self.memo = decoder, keep, {}

    def _token(self, token: str) -> tuple:
        if token.isalpha():  # a word as it stands; only repeats can disguise it
            words = {token, self.decoder.decode(token)} if _REPEATED.search(token) else (token,)
        else:
            words = set(_WORDS.findall(token))
            core = token.strip(_EDGE)
            if _SUSPICIOUS.search(core):
                words.update(map(self.decoder.decode, {core, core.strip("#%&*$!")}))
        return tuple([(w, v) for w in words if w and (v := self.keep(w)) is not None])

    def _run_words(self, run: str) -> set:
        """The words of a run of single signs: of each part between its wider
        gaps the letters as one word, without a word of one letter at either
        end, and as the words that the model reads."""
        gaps = set(map(len, _GAP.findall(run)))
        parts = re.split(rf"\s{{{min(gaps) + 1},}}", run) if len(gaps) > 1 else [run]
        words = set()
        for part in parts:
            part = _GAP.sub(" ", part)
            words.add(self.decoder.decode(part))
            if len(part) >= 7:
                words.update(self.decoder.decode(x) for x, end in ((part[2:], part[0]), (part[:-2], part[-1])) if end in WORDS_OF_ONE)
            words.update(self.decoder.decode(part, split=True).split(" "))
        return {x for w in words for x in (w, *_WORDS.findall(w)) if x}

    def __call__(self, text: str) -> dict:
        text = text.lower()
        memo, found = self.memo, {}
        if len(memo) > MEMO_TOKENS:
            memo.clear()
        tokens = text.split()
        single = bytes([len(token) == 1 for token in tokens])
        tokens = list(set(tokens))
        got = list(map(memo.get, tokens))
        if None in got:
            for i, known in enumerate(got):
                if known is None:
                    got[i] = memo[tokens[i]] = self._token(tokens[i])
        for words in filter(None, got):
            found.update(words)
        for run in _SPACED.findall(text) if b"\1\1\1" in single else ():
            for w in self._run_words(run):
                if (v := self.keep(w)) is not None:
                    found[w] = v
        return found


@dataclass
class ToxicityModel:
    """What ``fit`` learnt. ``weights``: evidence of each feature."""

    log_p: np.ndarray
    weights: dict[str, float]
    slope: float
    intercept: float

    def evidence(self, word: str) -> float | None:
        """Of the word's features, the strongest evidence."""
        weight = self.weights.get
        best = weight("=" + word)
        for k in FEATURE_LENGTHS:
            if len(word) < k:
                break
            w = weight(word[:k])
            if w is not None and (best is None or w > best):
                best = w
        return best

    def probability(self, evidence: float) -> float:
        z = self.intercept + self.slope * evidence
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _summer(model: ToxicityModel):
    """The evidence of texts: that of their strongest words, summed. (Over all
    words, the many weak ones of a long text would outweigh a short text's plain
    ones.) What it remembers goes with the task, and has the process to itself."""
    forget()
    restore = Restorer(Decoder(model.log_p), model.evidence)
    return lambda texts: [math.fsum(sorted(restore(t).values())[-STRONGEST:]) if t else 0.0 for t in texts]


RIDGE = 0.1  # of the slope per standard deviation of the evidence


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the weighted logistic curve of ``y`` over ``x``.
    Newton steps on the standardised evidence, halved until the penalised loss
    falls: the loss is strictly convex, so the fit always settles, on separable
    and overlapping labels alike. Evidence that is the same everywhere, or that
    falls with the label, gets slope 0 and the share of the labels."""
    mean, sd = float(np.average(x, weights=w)), float(np.sqrt(np.cov(x, aweights=w, ddof=0)))
    share = float(np.average(y, weights=w))
    flat = math.log((share * w.sum() + 0.5) / ((1 - share) * w.sum() + 0.5))
    if not sd > 1e-12 * (1 + abs(mean)):
        return 0.0, flat
    z = np.column_stack(((x - mean) / sd, np.ones(len(x))))
    ridge = np.diag([RIDGE, 1e-3])

    def loss(v):
        m = z @ v
        return float((w * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * v @ ridge @ v)

    v = np.array([0.0, flat])
    held = loss(v)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -500, 500)))
        g = z.T @ (w * (p - y)) + ridge @ v
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, g)
        size = 1.0
        while size > 1e-10 and loss(v - size * step) > held - 1e-4 * size * float(g @ step):
            size /= 2
        if size <= 1e-10:
            break  # no lower loss within rounding
        v = v - size * step
        held = loss(v)
        if np.abs(size * step).max() < 1e-10:
            break
    if v[0] <= 0:
        return 0.0, flat
    return float(v[0] / sd), float(v[1] - v[0] * mean / sd)


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic",
    id_col: str = "doc_id", text_col: str = "text",
) -> ToxicityModel:
    """Learn from ``labels`` (id, 0/1 label) where ``usable``; null labels do not
    count. At most MAX_ROWS_PER_LABEL rows of each label, drawn by a hash of the
    id, train the scorer; the character model counts all texts. Without usable
    rows of both labels no word is evidence, and every text scores low."""
    log_p = fit_char_model(docs, text_col)
    known = labels.where(usable & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")
    )
    totals = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    drawn = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(MAX_ROWS_PER_LABEL)
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = save(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(F.broadcast(drawn), "_id").select("_text", "_y")  # bounded: both parts are limited
    )
    decoder = Decoder(log_p)

    def count(batches):
        restore = Restorer(decoder, lambda w: True)
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for batch in slices(batches):
            for text, y in zip(batch.column("_text").to_pylist(), batch.column("_y").to_pylist(), strict=True):
                n[y] += 1
                (toxic if y else clean).update({f for w in restore(text or "") for f in features_of(w)})
        names = list(toxic.keys() | clean.keys()) + [""]
        toxic[""], clean[""] = n[1], n[0]
        yield pa.RecordBatch.from_pydict({
            "f": pa.array(names), "t": pa.array([toxic[x] for x in names], pa.int64()),
            "c": pa.array([clean[x] for x in names], pa.int64()),
        })

    counts = save(
        rows.mapInArrow(count, "f string, t bigint, c bigint")
        .groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t >= 3 or f = ''")
    )
    n_toxic, n_clean = next(((r.t, r.c) for r in counts.where("f = ''").collect()), (0, 0))
    if not n_toxic or not n_clean:
        return ToxicityModel(log_p, {}, 1.0, -4.0)
    # twice the log-likelihood ratio, against chance over all tried features
    t, c, nt, nc = F.col("t"), F.col("c"), F.lit(float(n_toxic)), F.lit(float(n_clean))
    rate, all_ = (t + c) / (nt + nc), F.col("t") + F.col("c")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    gain = 2 * (
        part(t, rate * nt) + part(c, rate * nc)
        + part(nt - t, (1 - rate) * nt) + part(nc - c, (1 - rate) * nc)
    )
    tried = counts.count()
    bar = 2 * math.log(max(tried, 2)) + 2
    weight = F.log((t + 0.5) / (nt + 1)) - F.log((c + 0.5) / (nc + 1))
    best = (
        counts.where("f != ''").where(all_ < nt + nc).withColumn("g", gain).withColumn("w", weight)
        .where((F.col("g") > bar) & (F.col("w") > 1.0))
        .orderBy(F.desc("g"), "f").limit(MAX_FEATURES).select("f", "w").collect()
    )
    model = ToxicityModel(log_p, {r.f: r.w for r in best}, 1.0, -4.0)
    scored = _evidence(rows, model, ["_y"]).select("_y", "evidence").collect()  # bounded as the drawn rows
    x = np.array([r.evidence for r in scored])
    y = np.array([r._y for r in scored], float)
    share = np.array([totals[0] / n_clean, totals[1] / n_toxic])  # undo the draw
    model.slope, model.intercept = _logistic(x, y, share[y.astype(int)])
    return model


def _evidence(rows: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """``keep`` and the evidence of ``_text``."""

    def run(batches):
        sums = _summer(model)
        for batch in slices(batches):
            found = pa.array(sums(batch.column("_text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in keep}, "evidence": found})

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "_text").mapInArrow(run, f"{kinds}, evidence double")


def score(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``score`` in 0 to 1 and ``predicted``
    (1 if the score is at least 0.5); with ``row_col`` also that column. Null
    and empty texts and texts without evidence get the lowest score; equal texts
    get equal scores; long texts are read whole; an empty table gives an empty
    result; other columns are not read."""
    keep = ["_id"] + (["_row"] if row_col else [])
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
        *([F.col(row_col).alias("_row")] if row_col else []),
    )
    z = F.lit(model.intercept) + F.lit(model.slope) * F.col("evidence")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return _evidence(rows, model, keep).select(
        F.col("_id").alias(id_col), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"),
        *([F.col("_row").alias(row_col)] if row_col else []),
    )


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that ``score`` predicts as 0."""

    def run(batches):
        sums = _summer(model)
        for batch in slices(batches):
            found = sums(batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([model.intercept + model.slope * x < 0 for x in found]))

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5
