"""Providers of model calls and speech. The defaults are deterministic stand-ins that need no network; their results are no model output.

A provider of completions is called with a batch of prompts and gives per prompt its content and token counts; a missing
count is 0 and a missing total the sum. Calls may be repeated when a task is retried, so a provider must be idempotent
or use the key that it gets.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from skein.functions.audio import HEADER

#: Kinds of completion nodes (fixed values); they differ in the provider that is called.
KINDS = ("llm", "openai", "deepseek", "qwen", "zhipu", "step", "ai_ping")


@dataclass(frozen=True)
class Completion:
    content: str
    input_tokens: int | None = None
    output_tokens: int | None = None
    total_tokens: int | None = None
    parts: Sequence[str] = ()  #: what a stream delivers, in order; none where it comes as a whole

    def counts(self) -> tuple[int, int, int]:
        first, second = self.input_tokens or 0, self.output_tokens or 0
        return first, second, first + second if self.total_tokens is None else self.total_tokens


Complete = Callable[[str, float, str, Sequence[str]], Sequence[Completion]]
Speak = Callable[[str, str], bytes]


def echo(model: str, temperature: float, system: str, prompts: Sequence[str]) -> list[Completion]:
    """Gives each prompt back; tokens are words between blanks."""
    return [Completion(x, len(x.split()) + len(system.split()), len(x.split()), parts=re.findall(r"\s*\S+\s*?(?=\s|$)|\s+$", x)) for x in prompts]


def tone(chunk: str, voice: str) -> bytes:
    """A WAV whose samples are the bytes of the chunk."""
    body = chunk.encode()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", len(body) + HEADER - 8, b"WAVE", b"fmt ", 16, 1, 1, 24000, 24000, 1, 8, b"data", len(body))
    return head + body


#: Providers of completions by name; all kinds but the general one have the stand-in until another is registered.
_registry: dict[str, Complete] = {name: echo for name in KINDS if name != "llm"}


def register(name: str, complete: Complete) -> None:
    _registry[name] = complete


def completer(name: str | None) -> Complete | None:
    """The provider registered under a name, or None, which fails the run."""
    return _registry.get(name or "")
