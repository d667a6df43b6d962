"""Personal data: patterns, and terms that disclose what the patterns protect.

The protected entities are the values that the patterns find. A corpus can give
an entity away without showing it: by terms that occur with it and hardly
without it. For an entity c and a term t near it, over the distinct lines of
the corpus (copies of a line count once),

    PMI(c, t) = log(N n(c,t) / (n(c) n(t)))    IC(c) = log(N / n(c))

and t discloses the share PMI / IC of what there is to know of c. Terms with
enough support whose share exceeds a threshold are generalised to their form,
above a second threshold removed, wherever they occur.

Tables of terms go to every task while they are small; larger ones meet the terms
of the lines or texts in a join, and each text is rewritten from its own hits.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import save, slices

# Patterns of the four kinds (fixed values). Those for addresses and numbers do
# not start inside a run of digits, where no match could begin anyway.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]{3,}")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

WINDOW = 12  # words of its line on either side of an entity that count as near
MIN_LINES = 3  # distinct lines that must show a term with an entity
GENERALISE, REMOVE = 0.75, 0.95  # shares of disclosure
BROADCAST_TERMS = 200_000  # terms (some 60 bytes each) that may go to every task


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their '@', so in linear time."""
    out, cursor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            cursor = m.end()
        at = text.find("@", max(at + 1, cursor))
    return out


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [
        ("ip", *m.span()) for m in IP.finditer(text)
        # (a part may have thousands of zeros before its value)
        if all(len(v := p.lstrip("0")) <= 3 and int(v or "0") <= 255 for p in m.group().split("."))
    ]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub(r"[\x20-]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _words(text: str, lo: int, hi: int, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, lower-cased word) of the words between ``lo`` and ``hi`` that meet
    none of the spans, which are in order of their starts: one pass over both."""
    out, i, covered = [], 0, -1
    for m in TERM.finditer(text, lo, hi):
        a, b = m.span()
        while i < len(spans) and spans[i][1] < b:
            covered = max(covered, spans[i][2])
            i += 1
        if covered <= a:
            out.append((a, b, m.group().lower()))
    return out


def contexts(text: str) -> list[tuple[int, int, list[str]]]:
    """(entity, line, near terms) of every line that shows an entity: the WINDOW
    nearest words on each side that are no part of an entity. Each line is read
    once, however many entities it shows."""
    spans = sorted(base_spans(text), key=lambda s: (s[1], s[2]))
    out, i = [], 0
    while i < len(spans):
        lo, hi = text.rfind("\n", 0, spans[i][1]) + 1, text.find("\n", spans[i][2])
        hi = hi if hi >= 0 else len(text)
        j = i
        while j < len(spans) and spans[j][1] < hi:  # (no span goes over a line's end)
            j += 1
        words, line = _words(text, lo, hi, spans[i:j]), _digest(text[lo:hi])
        starts = [w[0] for w in words]
        for kind, a, b in spans[i:j]:
            left, right = bisect_left(starts, a), bisect_left(starts, b)
            near = {w for *_, w in words[max(0, left - WINDOW) : left] + words[right : right + WINDOW]}
            value = re.sub(r"[\x20().-]", "", text[a:b].lower()) if kind in ("card", "phone") else text[a:b].lower()
            out.append((_digest(f"{kind}:{value}"), line, sorted(near)))
        i = j
    return out


def terms_of(text: str) -> set[str]:
    return set(map(str.lower, TERM.findall(text)))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def disclosing_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, disclosure): the largest share of an entity that a term gives
    away, for the terms above GENERALISE. Statistics run over all lines."""
    texts = _texts(docs, text_col)

    def near(batch_iter):
        for batch in slices(batch_iter):
            rows = [c for t in batch.column(0).to_pylist() for c in contexts(t)]
            yield pa.RecordBatch.from_pydict({
                "entity": pa.array([r[0] for r in rows], pa.int64()), "line": pa.array([r[1] for r in rows], pa.int64()),
                "terms": pa.array([r[2] for r in rows], pa.list_(pa.string())),
            })

    shown = save(texts.mapInArrow(near, "entity bigint, line bigint, terms array<string>").distinct())
    entities = shown.groupBy("entity").agg(F.countDistinct("line").alias("n_c")).where(F.col("n_c") >= MIN_LINES)
    together = save(
        shown.select("entity", "line", F.explode("terms").alias("term")).distinct()
        .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct")).where(F.col("n_ct") >= MIN_LINES)
        .join(entities, "entity")
    )
    lines = texts.select(F.explode(F.split("_text", "\n")).alias("line"))
    total = float(lines.agg(F.approx_count_distinct("line")).first()[0])
    n = F.lit(max(total, 2.0))
    # every line of an entity is a line, so an estimate below n(c) is raised
    known = F.greatest(n, F.col("n_c") + 1) / F.col("n_c")
    # PMI >= GENERALISE * IC means n(t) <= n(c,t) * (N / n(c)) ** (1 - GENERALISE):
    # a term on more lines than that discloses nothing, whatever its exact count
    most = F.ceil(F.col("n_ct") * F.pow(known, F.lit(1 - GENERALISE))) + 1
    candidates = save(together.groupBy("term").agg(F.max(most).cast("long").alias("most")))
    n_candidates = candidates.count()
    if not n_candidates:
        return docs.sparkSession.createDataFrame([], "term string, disclosure double")
    if n_candidates <= BROADCAST_TERMS:
        look = {r["term"]: r["most"] for r in candidates.collect()}
        found = texts.mapInArrow(_lines_with(look), "term string, line bigint").distinct()
    else:
        every = texts.mapInArrow(_lines_with(None), "term string, line bigint").distinct()
        found = every.join(candidates.select("term"), "term")
    counted = (
        save(found).groupBy("term").agg(F.count("line").alias("n_t"), F.max(F.col("line").isNull()).alias("common"))
        .where("not common").drop("common")
    )
    share = F.log(known * F.col("n_ct") / F.col("n_t")) / F.log(known)
    return save(
        together.join(counted, "term").withColumn("share", share)
        .groupBy("term").agg(F.max("share").alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    )


def _lines_with(terms: dict[str, int] | None):
    """(term, line) for the lines that hold each term; a term with more distinct
    lines in one task than ``terms`` allows gets one row with a null line. Without
    ``terms``, of every term."""

    def run(batches):
        seen: dict[str, set | None] = {}
        held_back = 0

        def rows():
            flat = [(t, x) for t, held in seen.items() for x in ([None] if held is None else held)]
            for i in range(0, len(flat), 100_000):
                part = flat[i : i + 100_000]
                yield pa.RecordBatch.from_pydict({
                    "term": pa.array([r[0] for r in part], pa.string()), "line": pa.array([r[1] for r in part], pa.int64()),
                })

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if terms is not None and terms.keys().isdisjoint(terms_of(text)):
                    continue
                for line in text.split("\n"):
                    hit = terms_of(line) if terms is None else terms.keys() & terms_of(line)
                    open_ = [t for t in hit if seen.get(t, ()) is not None]
                    if open_:
                        digest = _digest(line)
                        for t in open_:
                            held = seen.setdefault(t, set())
                            held.add(digest)
                            held_back += 1
                            if terms is not None and len(held) > terms[t]:
                                seen[t] = None
            if terms is None and held_back > 500_000:
                yield from rows()
                seen, held_back = {}, 0
        yield from rows()

    return run


def term_spans(text: str, base: list, terms: dict) -> list[tuple[str, int, int]]:
    """The words that are ``terms`` and meet no base span."""
    if not terms or terms.keys().isdisjoint(terms_of(text)):
        return []
    spans = sorted(base, key=lambda s: (s[1], s[2]))
    return [("term", a, b) for a, b, w in _words(text, 0, len(text), spans) if w in terms]


def sanitised(text: str, spans: list, terms: dict) -> str:
    """The text with base values replaced by their kind, and terms by their form
    or, above REMOVE, by nothing."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            continue
        word = text[a:b]
        if kind != "term":
            put = f"[{kind}]"
        elif terms[word.lower()] >= REMOVE:
            put = ""
        else:
            put = "[number]" if word.isdigit() else "[name]" if word[0].isupper() else "[term]"
        out += [text[at:a], put]
        at = b
    return "".join(out) + text[at:]


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_email``, ``n_ip``, ``n_card``,
    ``n_phone``, ``base_sha256`` (of the base spans as kind:start:end, comma-
    joined), ``spans`` (those and the added ``term`` spans) and ``n_term``; with
    ``with_text`` also the sanitised ``clean_text``, however many terms disclose.

    Null and empty texts have no spans; rows that repeat an id are separate
    documents; long texts and lines of many entities are read whole, in time
    linear in their length; an empty table gives an empty result; other columns
    are not read."""
    terms = disclosing_terms(docs, text_col)
    n_terms = terms.count()
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if n_terms <= BROADCAST_TERMS:
        every = {r["term"]: r["disclosure"] for r in terms.collect()}
        rows = base.withColumn("_hits", F.lit(None).cast("map<string,double>"))
    else:
        every, rows = None, _with_hits(base, terms)
    kind = base.schema["_id"].dataType.simpleString()
    columns = ("n_email", "n_ip", "n_card", "n_phone", "base", "terms", "n_term", "clean_text")

    def scan(batches):
        for batch in slices(batches):
            out: dict = {c: [] for c in columns}
            for text, hits in zip(batch.column("_text").to_pylist(), batch.column("_hits").to_pylist(), strict=True):
                look = dict(hits or ()) if every is None else every
                found = base_spans(text)
                more = term_spans(text, found, look)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in found))
                out["base"].append(told(found))
                out["terms"].append(told(more))
                out["n_term"].append(len(more))
                out["clean_text"].append(sanitised(text, found + more, look) if with_text else None)
            kinds = {c: pa.int64() if c.startswith("n_") else pa.string() for c in out}
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id")} | {c: pa.array(v, kinds[c]) for c, v in out.items()})

    schema = ", ".join([f"_id {kind}", *(f"{c} {'bigint' if c.startswith('n_') else 'string'}" for c in columns)])
    parts = F.array_remove(F.array("base", "terms"), "")
    return rows.select("_id", "_text", "_hits").mapInArrow(scan, schema).select(
        F.col("_id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), F.array_join(parts, ",").alias("spans"), "n_term",
        *(["clean_text"] if with_text else []),
    )


def _with_hits(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows with the disclosing terms of their texts (``_hits``): the different
    terms of each different text meet the table of terms in a join."""
    keyed = rows.withColumn("_key", F.struct(F.xxhash64("_text").alias("a"), F.xxhash64("_text", F.lit(1)).alias("b")))

    def words(batches):
        for batch in slices(batches):
            found = [sorted(terms_of(t)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"_key": batch.column("_key"), "terms": pa.array(found, pa.list_(pa.string()))})

    texts = keyed.select("_key", "_text").mapInArrow(words, "_key struct<a: bigint, b: bigint>, terms array<string>")
    held = texts.select("_key", F.explode("terms").alias("term")).join(terms, "term").distinct()
    hits = save(held.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("_hits")))
    # (a list is as long as its text's different words at most)
    return keyed.join(hits, "_key", "left").drop("_key")
