"""Chain-prefix prompts, task templates, batch scoring and answer parsing (L1-L4)."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadspark.functions.html import html_to_source
from threadspark.operators.threads import Reach, chain_members, reach, with_leaf
from threadspark.session import materialize

# Prompt line formats (rank 0, then every later rank).
ROOT_LINE = ("Post by ", ", title: ", ", initial comment: ", " \n")
REPLY_LINE = ("Responded to by ", ", comment: ", " \n")
TEMPLATE_SEP = " \n "
#: Repeated leaf ids up to which they are broadcast.
REPEATED_ROWS = 100_000


def _txt(c: Column, null_text: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(null_text))


def unit_line(user: Column, title: Column, source: Column, is_post: Column, null_text: str = "nan") -> Column:
    """The prompt line of a unit: a post opens a chain, any other unit responds."""
    a, b, c, d = ROOT_LINE
    e, f, g = REPLY_LINE
    user = _txt(user, null_text)
    root = F.concat(F.lit(a), user, F.lit(b), _txt(title, null_text), F.lit(c), source, F.lit(d))
    return F.when(is_post, root).otherwise(F.concat(F.lit(e), user, F.lit(f), source, F.lit(g)))


def reach_prompts(units: DataFrame, null_text: str = "nan") -> Reach:
    """Reach of ``units`` whose ``value`` is the prompt: the lines of the root-to-unit path.

    The HTML is rendered once per unit; prompts grow by pointer doubling (the ancestor's lines
    before the own ones), so no ancestor's text is looked up per descendant.
    """
    lines = with_leaf(units).select("id", "parent_id", "is_post", "user", "title", "_leaf", html_to_source(F.col("text")).alias("_src"))
    return reach(lines, unit_line(F.col("user"), F.col("title"), F.col("_src"), F.col("is_post"), null_text), leaf="_leaf")


def unit_prompts(units: DataFrame, reached: Reach | None = None, null_text: str = "nan") -> DataFrame:
    """L1 per unit: ``(id, prompt)``; every chain through a unit shares that prefix."""
    return (reached or reach_prompts(units, null_text)).nodes.select("id", F.col("value").alias("prompt"))


def chain_prompts(units: DataFrame, null_text: str = "nan") -> DataFrame:
    """L1 per chain row: ``(chain_id, id, chain_rank, prompt)``."""
    reached = reach_prompts(units, null_text)
    members = materialize(chain_members(units, reached))  # ids only, read twice
    out = ["chain_id", "id", "chain_rank", "prompt"]
    inner = reached.inner.select("id", F.col("value").alias("prompt"))
    above = members.where(F.col("chain_id") != F.col("id")).join(inner, "id").select(*out)
    # a leaf ends one chain, its own, so its prompt, the longest, is not moved to find it; only ids that repeat end more
    ends = members.where(F.col("chain_id") == F.col("id")).groupBy(F.col("id").alias("_end")).agg(F.collect_list("chain_rank").alias("_ranks"))
    ends = materialize(ends.where(F.size("_ranks") > 1))
    ends = F.broadcast(ends) if ends.limit(REPEATED_ROWS + 1).count() <= REPEATED_ROWS else ends
    tips = reached.tips.where(F.col("id").isNotNull()).join(ends, F.col("id") == F.col("_end"), "left")
    ranks = F.coalesce("_ranks", F.array(F.col("depth").cast("int")))
    own = tips.select(F.col("id").alias("chain_id"), "id", F.explode(ranks).alias("chain_rank"), F.col("value").alias("prompt"))
    return above.unionByName(own.select(*out))


def apply_template(prompts: DataFrame, template: str, col: str = "prompt", out: str = "model_input") -> DataFrame:
    """L2: ``template + ' \\n ' + prompt``."""
    return prompts.withColumn(out, F.concat(F.lit(template), F.lit(TEMPLATE_SEP), F.col(col)))


SCORE_SCHEMA = T.StructType(
    [
        T.StructField("chain_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("input_chars", T.LongType()),
    ]
)


def score_prompts(
    inputs: DataFrame, model_fn: Callable[[list[str]], list[str]], col: str = "model_input"
) -> DataFrame:
    """L3: run a caller-supplied text model over prompt batches (Arrow batches via mapInPandas).

    ``model_fn`` maps a list of inputs to a list of outputs; it is loaded and
    called inside the executors, one Arrow batch at a time.
    """
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[col].astype(str).tolist()
            t0 = time.perf_counter()
            outs = model_fn(texts) if texts else []
            per = (time.perf_counter() - t0) / max(len(texts), 1)
            yield pd.DataFrame(
                {
                    "chain_id": pdf["chain_id"].astype(str),
                    "id": pdf["id"].astype(str),
                    "output": pd.Series(outs, dtype="object"),
                    "seconds": per,
                    "input_chars": pdf[col].str.len().astype("int64"),
                }
            )

    return inputs.select("chain_id", "id", col).mapInPandas(run, SCORE_SCHEMA)


def parse_answers(df: DataFrame, col: str = "output", n: int = 20) -> DataFrame:
    """L4: ``A1..An`` answer lines -> DOUBLE columns ``a1..an`` (null when missing)."""
    return df.select(
        "*",
        *[
            F.expr(
                f"try_cast(nullif(regexp_extract({col}, '(?m)^A{i}:\\\\s*([0-9]*\\\\.?[0-9]+)', 1), '') AS DOUBLE)"
            ).alias(f"a{i}")
            for i in range(1, n + 1)
        ],
    )
