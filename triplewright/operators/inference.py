"""Model calls in batches, with a model of one's own or a deterministic stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import Extraction
from ..functions import batching as B
from ..functions import text as X


def line_chunks(texts: DataFrame, size: int) -> DataFrame:
    """paper_id, chunk_no and text of size consecutive lines of sentences."""
    return texts.select("paper_id", F.posexplode(X.chunks(F.col("sentences"), size)).alias("chunk_no", "text"))


def prompts(chunked: DataFrame, examples: list[dict[str, str]] | None = None) -> DataFrame:
    return chunked.withColumn("prompt", B.role_prompt(F.col("text"), examples))


def stand_in(batch: list[str], options: dict | None = None) -> list[str]:
    """A triple of the first three words of each text's last line, whatever the options."""
    out = []
    for prompt in batch:
        words = prompt.replace("<|end_of_turn|>", " ").split("text is:")[-1].split("GPT4")[0].split()
        out.append(f"({words[0]}; {words[1]}; {words[2]})" if len(words) > 2 else "")
    return out


def with_back_off(model: Callable[[list[str]], list[str]], texts: list[str], size: int) -> list[str | None]:
    """Answers to all texts; a batch that runs out of memory is cut to 0.8 of its size, and at size 1 has no answer."""
    out: list[str | None] = []
    size = max(1, size)
    while len(out) < len(texts):
        batch = texts[len(out) : len(out) + size]
        try:
            out += model(batch)
        except MemoryError:
            if size == 1:
                out.append(None)
            size = max(1, int(0.8 * size))
    return out


def options(s: Extraction) -> dict:
    """What a model is told besides its batch: lengths, and the settings and seed of sampling if it is to sample."""
    told = {"max_new_tokens": s.max_new_tokens, "do_sample": s.use_sampling}
    return told | ({"temperature": s.temperature, "top_p": s.top_p, "repetition_penalty": s.repetition_penalty, "seed": s.seed} if s.use_sampling else {})


def gpu_profile(gpus: int = 1, cpus: int = 1, discovery: str = ""):
    """Resource profile of executors with GPUs, one task a GPU: each task then owns the device that its model is on."""
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    executor = ExecutorResourceRequests().cores(gpus * cpus).resource("gpu", gpus, discovery)
    return ResourceProfileBuilder().require(executor).require(TaskResourceRequests().cpus(cpus).resource("gpu", 1)).build


def generate(prompted: DataFrame, model: Callable[..., list[str]] = stand_in, batch: int = 16, column: str = "prompt", told: dict | None = None, profile=None) -> DataFrame:
    """All columns and output; the model is called with batches of batch prompts in each task, and with told if that is given.

    profile (see gpu_profile) says on which executors.
    """
    ask = partial(model, options=told) if told else model

    def answers(asked: pd.Series) -> pd.Series:
        return pd.Series(with_back_off(ask, asked.fillna("").tolist(), batch), index=asked.index, dtype=object)

    if profile is None:  # only the prompts leave the JVM

        def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from map(answers, it)

        return prompted.withColumn("output", F.pandas_udf(run, "string")(F.col(column)))

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            yield part.assign(output=answers(part[column]))

    return prompted.mapInPandas(rows, StructType([*prompted.schema.fields, StructField("output", StringType())]), profile=profile)


def extract(texts: DataFrame, settings: Extraction | None = None, model: Callable[..., list[str]] = stand_in, examples: list[dict[str, str]] | None = None, batch: int = 16, profile=None) -> DataFrame:
    """text, triplets, paper_id and chunk_no of each chunk of texts (paper_id, sentences).

    The model gets options() of the settings if they ask for sampling, else its batch alone.
    """
    s = settings or Extraction()
    asked = prompts(line_chunks(texts, s.num_lines_per_model_call), examples if s.use_fewshot_prompting else None)
    said = generate(asked, model, batch, told=options(s) if s.use_sampling else None, profile=profile)
    return said.select("text", B.answer(F.col("output"), s.model_type).alias("triplets"), "paper_id", "chunk_no")
