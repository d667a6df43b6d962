"""Mixing sources to target weights by iterative proportional fitting (raking).

The corpus is reduced to cells of (source, language, topic) with their tokens.
Cell weights are raked in turn to the target share of every source, language
and topic until the margins agree; the fitted weights become sampling
probabilities under a token budget (no document is taken more than once: cells
that would need more are taken whole, and the rest of the budget is spread over
the others); each document is then drawn by a hash of its id. Documents are read
once for the cells and once for the draw and never shuffled; the raking runs on
the cell table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilt.llm.common import SLICE_ROWS, join_ids, prefix_sums, save, save_files, slices
from quilt.llm.tokens import encoder, forget
from quilt.llm.topics import Topics, fit_packed, packed, with_topic

DIMENSIONS = ("source", "lang", "topic")


def text_tokens(text: Column) -> Column:
    """Tokens of a text, as its words (blank- or line-separated, at least one)."""
    text = F.coalesce(text, F.lit(""))
    return (F.size(F.split(text, " ")) + F.size(F.split(text, "\n")) - 1).cast("long")


def tempered_targets(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """Shares proportional to tokens ** exponent: below 1, small values gain."""
    one = cells.groupBy(dimension).agg(F.sum("tokens").alias("t"))
    raised = F.pow(F.col("t").cast("double"), F.lit(exponent))
    total = one.agg(F.sum(raised).alias("total"))
    return one.crossJoin(F.broadcast(total)).select(dimension, (raised / F.col("total")).alias("target"))


def given_targets(cells: DataFrame, dimension: str, shares: dict) -> DataFrame:
    """Shares by value, made to sum to 1 over the values that occur; a value
    without a share gets none."""
    total = sum(shares.values())
    rows = [(None if k is None else str(k), float(v) / total) for k, v in shares.items()]
    table = cells.sparkSession.createDataFrame(rows, "value string, target double")
    one = cells.groupBy(dimension).agg(F.sum("tokens").alias("t"))
    return one.join(table, F.col(dimension).cast("string").eqNullSafe(F.col("value")), "left").select(
        dimension, F.coalesce("target", F.lit(0.0)).alias("target")
    )


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], dimensions=DIMENSIONS,
    tolerance: float = 1e-6, sweeps: int = 5, max_rounds: int = 12,
) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``, summing to 1. Sweeps over
    the dimensions until no margin is off by more than ``tolerance``, or for
    ``sweeps * max_rounds`` sweeps where the targets contradict each other."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    fitted = cells.withColumn("weight", F.col("tokens") / F.lit(total))
    for d in dimensions:
        value = F.col(d).eqNullSafe(F.col("_value"))
        fitted = fitted.join(
            targets[d].select(F.col(d).alias("_value"), F.col("target").alias(f"_{d}")), value
        ).drop("_value")
    fitted = save(fitted)
    for _ in range(max_rounds):
        for _ in range(sweeps):
            for d in dimensions:
                margin = F.sum("weight").over(Window.partitionBy(d))
                fitted = fitted.withColumn(
                    "weight", F.when(margin > 0, F.col("weight") * F.col(f"_{d}") / margin).otherwise(F.lit(0.0))
                )
        fitted = save(fitted)
        worst = 0.0
        for d in dimensions:
            off = fitted.groupBy(d).agg(F.abs(F.sum("weight") - F.max(f"_{d}")).alias("off"))
            worst = max(worst, off.agg(F.max("off")).first()[0] or 0.0)
        if worst <= tolerance:
            break
    return fitted.select(*dimensions, "tokens", "weight")


def calibrate(fitted: DataFrame, budget: float) -> DataFrame:
    """``probability`` per cell: as the weight per token, scaled so that the
    expected tokens are ``budget`` of all, none above 1. Cells are taken whole
    from the largest ratio down while the common scale would exceed 1."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))
    total = fitted.agg(F.sum("tokens")).first()[0] or 0
    others = [c for c in fitted.columns if c not in ("tokens", "weight")]
    # sums over the cells below, which come after (summed from below: a difference
    # of sums would lose weights far smaller)
    table = prefix_sums(fitted.withColumn("_ratio", ratio), [F.asc("_ratio"), *map(F.desc, others)], {"_below": "tokens", "_light": "weight"})
    before = F.lit(total) - F.col("_below") - F.col("tokens")
    left, weight = F.lit(budget) * F.lit(total) - before, F.col("_light") + F.col("weight")
    table = table.withColumn("_scale", F.when(weight > 0, left / weight).otherwise(F.lit(0.0)))
    table = save(table.withColumn("_whole", F.col("_scale") * F.col("_ratio") >= 1))
    # the scale at the first cell that is not taken whole holds for all below it
    top = table.where(~F.col("_whole")).agg(F.max(F.struct("_ratio", "_scale")).alias("m")).first()["m"]
    scale = F.lit(float(top["_scale"]) if top else 0.0)
    return table.withColumn(
        "probability",
        F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("_whole"), F.lit(1.0))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scale * F.col("_ratio")))),
    ).drop("_ratio", "_scale", "_whole", "_below", "_light")


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    bits = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.shiftrightunsigned(bits, 11) / F.lit(float(1 << 53))


def describe(docs: DataFrame, tokenizer: str | None, topic: Column | None, tokens: Column | None, text_col: str) -> DataFrame:
    """``docs`` with ``topic`` and ``n_tokens`` in place of the text: given columns,
    or the vector ``_vec`` that topics are learnt from, and the ids that the
    tokenizer makes of the text with one at its end."""
    learn, count = topic is None, tokens is None and tokenizer is not None
    given = {"n_tokens": tokens if tokens is not None else F.lit(None).cast("long")}
    given["_vec" if learn else "topic"] = F.lit(None).cast("binary") if learn else topic
    if tokens is None and tokenizer is None:
        given["n_tokens"] = text_tokens(F.col(text_col))
    rows = docs.withColumns(given)
    kept = rows.drop(text_col)
    if not (learn or count):
        return kept

    def run(batches):
        ids = encoder(tokenizer).count if count else None
        for batch in slices(batches):
            # (texts do not come back: the executor would hold them twice)
            new = dict(zip(batch.schema.names, batch.columns))
            texts = new.pop(text_col).to_pylist()
            if learn:
                new["_vec"] = packed(texts)
            if count:
                new["n_tokens"] = pa.array([n + 1 for n in ids([t or "" for t in texts])], pa.int64())
            yield pa.RecordBatch.from_pydict(new)

    return rows.mapInArrow(run, kept.schema)


def topic_of(text: Column, topics: Topics) -> Column:
    """The learnt topic of a text. The text alone goes to Python, and the topic alone
    comes back. No ids are made from here on: what the encoder holds is let go."""

    @F.arrow_udf("string")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        for some in texts:
            parts = [topics.of(some.slice(i, SLICE_ROWS).to_pylist()) for i in range(0, len(some), SLICE_ROWS)]
            yield pa.array([x for part in parts for x in part], pa.string())

    return of(text)


def _with_probability(rows: DataFrame, budget: float, exponent: float, shares: dict[str, dict] | None) -> DataFrame:
    """``rows`` (with source, lang, topic, n_tokens) and their ``probability``."""
    cells = save(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    return _probable(rows, cells, budget, exponent, shares)


def _probable(rows: DataFrame, cells: DataFrame, budget: float, exponent: float, shares: dict[str, dict] | None) -> DataFrame:
    targets = {
        d: given_targets(cells, d, shares[d]) if shares and d in shares else tempered_targets(cells, d, exponent)
        for d in DIMENSIONS
    }
    fitted = save(calibrate(rake(cells, targets), budget))
    keyed = fitted.select(F.struct(*DIMENSIONS).alias("_cell"), "probability")
    return join_ids(rows.withColumn("_cell", F.struct(*DIMENSIONS)), keyed, ["_cell"], fitted.count())


def mix_to_targets(
    docs: DataFrame, budget: float = 0.8, exponent: float = 0.5, seed: int = 17,
    shares: dict[str, dict] | None = None, topic: Column | None = None, tokens: Column | None = None,
    tokenizer: str | None = None, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: the id, source, lang, topic, ``n_tokens``,
    ``probability`` and ``kept``.

    ``shares`` gives target shares by value for some dimensions; the others are
    tempered by ``exponent``. Topics are learnt (see ``topics``) unless ``topic``
    gives them; tokens are those of ``tokenizer`` (a file), of the column
    ``tokens``, or words. Nulls in source or lang are a value like any other; null
    and empty texts count one token and the topic ``empty``; long texts are read
    whole; rows that repeat an id share its draw; an empty table gives an empty
    result; other columns are not read."""
    slim = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.col(text_col).alias("_text"),
        *([topic.alias("_topic")] if topic is not None else []), *([tokens.cast("long").alias("_tokens")] if tokens is not None else []),
    )
    rows = describe(slim, tokenizer, None if topic is None else F.col("_topic"), None if tokens is None else F.col("_tokens"), "_text")
    if topic is None:
        rows = save_files(rows.select("_id", "source", "lang", "n_tokens", "_vec"), "vectors")
        rows = with_topic(rows, fit_packed(rows))
    rows = save(rows.select("_id", "source", "lang", "topic", "n_tokens"))
    return _with_probability(rows, budget, exponent, shares).select(
        F.col("_id").alias(id_col), "source", "lang", "topic", "n_tokens", "probability",
        (draw("_id", seed) < F.col("probability")).alias("kept"),
    )


def sample_mix(
    docs: DataFrame, budget: float = 0.8, exponent: float = 0.5, seed: int = 17,
    shares: dict[str, dict] | None = None, tokenizer: str | None = None, id_col: str = "doc_id", source_col: str = "source",
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, whole, that ``mix_to_targets`` keeps. Texts are read
    once for the cells and once, with their topic alone, for the draw."""
    slim = docs.select(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.col(text_col).alias("_text"))
    slim = describe(slim, tokenizer, None, None, "_text").select("source", "lang", "n_tokens", "_vec")
    vectors = save_files(slim, "vectors")
    learnt = fit_packed(vectors)
    cells = with_topic(vectors, learnt).groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(
        whole.alias("_doc"), F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
        F.col(lang_col).alias("lang"), topic_of(F.col(text_col), learnt).alias("topic"),
    )
    kept = _probable(rows, save(cells), budget, exponent, shares).where(draw("_id", seed) < F.col("probability"))
    return kept.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
