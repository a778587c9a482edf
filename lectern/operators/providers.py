"""External models behind one protocol, with a deterministic offline stand-in."""

from __future__ import annotations

from typing import Protocol


class TextProvider(Protocol):
    def generate(self, prompt: str) -> str: ...


class SpeechProvider(Protocol):
    def look(self, prompt: str, url: str) -> str:
        return '{"klass": "illustrative", "description": "A picture."}'

    def speak(self, text: str) -> bytes: ...

    def transcribe(self, audio: bytes) -> str: ...


class VisionProvider(Protocol):
    def look(self, prompt: str, url: str) -> str: ...


class PageProvider(Protocol):
    def get(self, url: str) -> str: ...


class Busy(Exception):
    """A host asks to come back later; wait: seconds, where it says so."""

    def __init__(self, wait: float | None = None):
        super().__init__(f"busy, wait {wait}")
        self.wait = wait


class Offline:
    """Answers with the text after the prompt's last marker, or with nothing if it has none."""

    MARK = "\nTEXT:\n"

    def generate(self, prompt: str) -> str:
        return prompt.rpartition(self.MARK)[2]

    def look(self, prompt: str, url: str) -> str:
        return '{"klass": "illustrative", "description": "A picture."}'

    def speak(self, text: str) -> bytes:
        return f"[{text}]".encode()

    def transcribe(self, audio: bytes) -> str:
        return audio.decode()[1:-1]


def prompt(stage: str, text: str, **fields: str | None) -> str:
    """A stage's request: its fields, then the text to work on."""
    head = "".join(f"{k.upper()}: {v}\n" for k, v in fields.items() if v)
    return f"STAGE: {stage}\n{head}{Offline.MARK}{text}"
