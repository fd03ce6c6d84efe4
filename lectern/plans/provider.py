"""Explanations from a language model: prompts, options and providers.

A provider is a function from a list of sentences, and a list of the system
messages they are asked under, to a list of explanations.
The default one is a pure formula, so that results are the same everywhere; a
provider for a model server is loaded only if its client is installed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.notes import ANALYSIS, FAILED, TRANSLATION, UNKNOWN_BOOK, WORDS

Provider = Callable[[list[str], list[str]], list[str]]

# Options of a request to the model server.
OPTIONS = {
    "num_gpu": 35, "num_thread": 12, "num_parallel": 2, "num_batch": 1536, "num_ctx": 12288, "repeat_penalty": 1.05, "repeat_last_n": 64,
    "temperature": 0.4, "seed": 42, "num_predict": 1536, "top_k": 60, "top_p": 0.85, "frequency_penalty": 0.05, "presence_penalty": 0.05,
    "mirostat": 2, "mirostat_tau": 3.0, "mirostat_eta": 0.1, "num_gqa": 8, "rope_frequency_base": 10000, "rope_frequency_scale": 1.0,
}

#: Instruction of our own; a file may replace it.
INSTRUCTION = f"为英文句子写一行中文说明，格式为“{ANALYSIS}…{TRANSLATION}…{WORDS}…”。"


@dataclass
class Prompt:
    """The system message: an instruction and the book the sentences come from."""

    instruction: str = INSTRUCTION
    options: dict = field(default_factory=lambda: dict(OPTIONS))

    @classmethod
    def load(cls, path: str) -> Prompt:
        """The instruction in a UTF-8 file; a missing file raises."""
        with open(path, encoding="utf-8") as f:
            return cls(f.read().strip())

    def system(self, book: Column | str) -> Column:
        return F.concat(F.lit(self.instruction + "\n\n这句话来自：“"), T.col(book), F.lit("”"))

    def messages(self, book: Column | str, sentence: Column | str) -> Column:
        """The chat: what the system says, then what the user asks."""
        said = [F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in (("system", self.system(book)), ("user", T.col(sentence)))]
        return F.array(*said)


def book_name(argument: str | None, title: Column | str) -> Column:
    """The given name, else the book's title, else the name of unknown books."""
    return T.first_of(F.lit(argument), T.col(title), F.lit(UNKNOWN_BOOK))


def stub_column(sentence: Column | str) -> Column:
    """The default explanation as a formula, without Python."""
    s = T.col(sentence)
    first = F.regexp_extract(s, r"(\p{L}+)", 1)
    return F.concat(F.lit(ANALYSIS + "全句共"), F.size(F.split(s, r"\s+")).cast("string"), F.lit("词。" + TRANSLATION + "（"), s, F.lit("）。" + WORDS), first)


def server(model: str, options: dict | None = None) -> Provider:
    """A provider that asks a local model server, one sentence at a time; failures become texts."""

    def ask(sentences: list[str], systems: list[str]) -> list[str]:
        import ollama  # only where it is installed

        out = []
        for s, system in zip(sentences, systems):
            try:
                messages = [{"role": "system", "content": system}, {"role": "user", "content": s}]
                reply = ollama.chat(model=model, messages=messages, options=OPTIONS if options is None else options)
                out.append((reply.message or {}).get("content") or "")
            except Exception as e:  # noqa: BLE001
                out.append(f"{FAILED}{e}")
        return out

    return ask


def explained(df: DataFrame, sentence: str = "sentence", provider: Provider | None = None, partitions: int | None = None, out: str = "note_content", system: Column | None = None) -> DataFrame:
    """``df`` with an explanation of each sentence and whether it failed.

    ``system`` is what the model is told first; by default it is told of an
    unknown book.  Equal sentences of equal system messages are asked once.
    ``partitions`` limits how many requests run at a time.
    """
    if provider is None:
        return df.withColumn(out, stub_column(sentence)).withColumn("note_error", F.lit(False))
    df = df.withColumn("_system", Prompt().system(F.lit(UNKNOWN_BOOK)) if system is None else system)
    asked = df.select(F.col(sentence).alias("_s"), F.col("_system").alias("_t")).distinct()
    asked = asked.repartition(partitions) if partitions else asked

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_s": b["_s"], "_t": b["_t"], out: provider(b["_s"].tolist(), b["_t"].tolist())})

    answers = asked.mapInPandas(run, f"_s string, _t string, {out} string")
    same = F.col(sentence).eqNullSafe(F.col("_s")) & F.col("_system").eqNullSafe(F.col("_t"))
    joined = df.drop(out, "note_error").join(answers, same, "left").drop("_s", "_t", "_system")
    return joined.withColumn("note_error", F.coalesce(F.startswith(out, F.lit(FAILED)), F.lit(False)))
