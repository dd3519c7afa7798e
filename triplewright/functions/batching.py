"""Sizes of model batches and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the request for triples, and the marker before an answer of each model.
REQUEST = "You will extract the subject-predicate-object triplets from the text and return them in the form [(subject_1; predicate_1; object_1), (subject_2; predicate_2; object_2), ..., (subject_n; predicate_n; object_n)]. We want the subjects and objects in the triplets to be specific, they cannot be pronouns or generic nouns. The first text is: \n "
NEXT = "The next text is: \n "
MARKERS = {
    "Nexusflow/Starling-LM-7B-beta": "GPT4 Correct Assistant:",
    "mistralai/Mistral-7B-Instruct-v0.2": "[/INST]",
    "google/gemma-2b-it": "<start_of_turn>model",
    "meta-llama/Meta-Llama-3-8B-Instruct": "assistant",
    "CohereForAI/c4ai-command-r-v01": "<|CHATBOT_TOKEN|>",
}


def heuristic_batch(parameters: Column, memory: Column, input_size: Column, new_tokens: Column) -> Column:
    """Texts a batch for a model of so many 10^9 parameters and GB of memory, at least 1."""
    part = F.ceil((input_size + new_tokens) / 2048)
    share = F.when(parameters < 5, 1).when(parameters < 10, 2).when(parameters < 20, 3).otherwise(4)
    return F.greatest(F.floor(memory / (share * part)), F.lit(1))


def estimated_batch(available: Column, needed: Column) -> Column:
    return F.greatest(F.floor(available / needed), F.lit(1))


def chat(text: Column, examples: list[dict[str, str]] | None) -> Column:
    """Messages of a prompt: the examples and the text, or the request with the text."""
    said = [F.struct(F.lit(m["role"]).alias("role"), F.lit(m["content"]).alias("content")) for m in examples or []]
    return F.array(*said, F.struct(F.lit("user").alias("role"), F.concat(F.lit(NEXT if examples else REQUEST), text).alias("content")))


def role_prompt(text: Column, examples: list[dict[str, str]] | None = None, output: Column | None = None) -> Column:
    """A prompt with spelt-out roles, for models without a chat template."""
    turn = lambda m: F.concat(F.when(m["role"] == "user", F.lit("GPT4 Correct User: ")).otherwise(F.lit("GPT4 Correct Assistant: ")), m["content"], F.lit("<|end_of_turn|>"))
    turns = F.array_join(F.transform(chat(text, examples), turn), "")
    return F.concat(turns, F.lit("GPT4 Correct Assistant:")) if output is None else F.concat(turns, F.lit("GPT4 Correct Assistant: "), output)


def answer(output: Column, model_type: str) -> Column:
    """What follows the last marker of the model."""
    if model_type not in MARKERS:
        raise ValueError(f"no answer marker is known for {model_type}")
    return F.substring_index(output, MARKERS[model_type], -1)


def over_length(prompt: Column, most: int) -> Column:
    """Number of prompts of more characters than most."""
    return F.count_if(F.length(prompt) > most)
