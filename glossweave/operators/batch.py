"""Budgeted batches for an external text translator, with retries, a breaker and answer matching.

The pieces that a task uses; ``rounds`` plans the batches and keeps the answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values ---------------------------------------------------------------------------
LOCAL_CHARS, CLOUD_CHARS, RETRIES, BREAK_AFTER, SECONDS_PER_CHAR, LEAST_SECONDS = 6_000, 12_000, 3, 3, 0.02, 30.0
# ----------------------------------------------------------------------------------------------


class Translator(Protocol):
    def translate(self, texts: list[str], hints: list[str], timeout: float) -> dict[str, str]:
        """Answers by source text; may leave texts out; raises on a hard failure. An attribute ``truncated`` that is true says that
        the last answer was cut off."""


@dataclass
class Profile:
    """How much effort mining may take: the thorough values are the default."""

    together: int = 2
    dice: float = 0.45
    longest: int = 20_000
    max_words: int = 3_000
    max_runs: int = 1_000
    rounds: int = 100

    @classmethod
    def fast(cls) -> Profile:
        return cls(3, 0.8, 300, 40, 20, 8)


@dataclass
class Guarded:
    """A translator with retries; after three hard failures in a row it stays open and answers nothing."""

    inner: Translator
    failures: int = 0
    calls: int = 0
    chars: int = 0

    @property
    def open(self) -> bool:
        return self.failures >= BREAK_AFTER

    def translate(self, texts: list[str], hints: list[str]) -> dict[str, str]:
        for _ in range(RETRIES):
            if self.open:
                break
            self.calls += 1
            self.chars += sum(map(len, texts))
            try:
                out = self.inner.translate(texts, hints, max(LEAST_SECONDS, SECONDS_PER_CHAR * sum(map(len, texts))))
            except Exception:
                self.failures += 1
            else:
                self.failures = 0
                return out
        return {}


def packs(texts: Iterable[str], limit: int) -> Iterator[list[str]]:
    """Texts in order, greedily packed to at most ``limit`` characters; a longer text is a batch of its own."""
    batch: list[str] = []
    used = 0
    for t in texts:
        if batch and used + len(t) > limit:
            yield batch
            batch, used = [], 0
        batch.append(t)
        used += len(t)
    if batch:
        yield batch


def strip_marks(answer: str) -> str:
    """Without the answer tag and one pair of outer quotes."""
    a = answer.replace("<SJPTS_TARGET>", "").replace("</SJPTS_TARGET>", "").strip()
    return a[1:-1] if len(a) > 1 and (a[0], a[-1]) in {('"', '"'), ("「", "」")} else a


def match_back(texts: list[str], answers: dict[str, str]) -> dict[str, str]:
    """Answers by exact text, else by trimmed text, else by text without marks."""
    trimmed = {k.strip(): v for k, v in reversed(answers.items())}
    bare = {strip_marks(k): v for k, v in reversed(answers.items())}
    out = {}
    for t in texts:
        hit = answers.get(t, trimmed.get(t.strip(), bare.get(strip_marks(t))))
        if hit and strip_marks(hit):
            out[t] = strip_marks(hit)
    return out


def fan_out(rows: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Give every row the answer of its text."""
    return rows.join(answers, keys, "left")


def tagged_answer(reply: Column) -> Column:
    """The text inside the answer tag without outer quotes, or null."""
    inner = F.regexp_extract(reply, r"(?s)<SJPTS_TARGET>(.*?)</SJPTS_TARGET>", 1)
    bare = F.regexp_replace(F.trim(inner), r'^"(.*)"$', "$1")
    return F.when(bare != "", bare)


def tolerant(source: Iterable, each: Callable, on_error: Callable[[Exception], None]) -> None:
    """Apply ``each``; an item's error is reported and skipped, the source's own error ends this source only."""
    it = iter(source)
    while True:
        try:
            item = next(it)
        except StopIteration:
            return
        except Exception as e:
            on_error(e)
            return
        try:
            each(item)
        except Exception as e:
            on_error(e)
