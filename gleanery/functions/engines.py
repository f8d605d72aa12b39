"""Deterministic stand-in for a translation engine, for tests and checks."""

from __future__ import annotations


class EngineError(Exception):
    """Raised by an engine; ``code`` names the class of the error."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


class ReversingEngine:
    """Turns texts around; refuses one source language."""

    refused = "fr"

    def translate(self, source: str, target: str, texts: list[str]) -> list[str]:
        if source == self.refused:
            raise EngineError("unsupported-pair")
        return [t[::-1] for t in texts]
