"""Schemas, fixed values and interfaces of the evidence corpus."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Protocol

# The record format and its field precedence.
SECTIONS = {
    "abstract": ("lessonAbstract",),
    "driving_event": ("drivingEvent", "description_event"),
    "lesson": ("lesson", "lesson_learned"),
    "recommendation": ("recommendation",),
    "evidence": ("evidence",),
    "related_policy": ("relatedPolicy",),
}
NOT_CORE = "related_policy"
PLACEHOLDERS = ("", "none", "n/a", "not applicable", "null")
REFERENCE_ONLY = ("same as in lesson learned", "see lesson(s) learned", "see lesson learned")
SCHEMA_VERSION = 1

CELL = "struct<text:string,is_header:boolean,rowspan:string,colspan:string>"
RENDERED = (
    "struct<text:string,source_text_present:boolean,"
    f"tables:array<struct<number:int,caption:string,rows:array<array<{CELL}>>,text_outside_cells:array<string>>>,"
    "links:array<struct<text:string,reference:string,resolved_url:string,status:string>>,"
    "media:array<struct<number:int,tag:string,reference:string,resolved_url:string,alt:string,title:string,status:string>>,"
    "parser_diagnostics:array<struct<level:string,line:int,column:int,message:string>>,"
    "unrecognized_tags:array<string>,parse_failed:string>"
)
SPAN = "struct<section:string,start:int,end:int,split_large_block:boolean,table_fragment:boolean>"


@dataclass(frozen=True)
class ChunkConfig:
    """Budgets and templates of retrieval units; every value is part of a unit's identity."""

    model: str = "hashed-words"
    dimensions: int = 256
    policy: str = "whole-record-first"
    max_words: int = 1200
    max_input_bytes: int = 20000
    query_prefix: str = "task: search result | query: "
    record_label: str = "record"

    def __post_init__(self):
        if self.max_words < 32 or self.max_input_bytes < 512:
            raise ValueError("a budget below 32 words or 512 bytes cannot hold a titled unit")

    def as_dict(self) -> dict:
        return asdict(self)


class Embedder(Protocol):
    """Turns texts into vectors of ``dimensions`` numbers; runs inside executor tasks, so it must pickle."""

    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class Answer:
    """A generator's text (null if it gave none) and why it stopped, in its own words."""

    text: str | None
    finish_reason: str | None = None


class Generator(Protocol):
    """Answers prepared prompts; deployments supply one, the engine only prepares and stores. A plain text is an answer
    without a reason to stop."""

    def generate(self, prompts: list[str]) -> list[Answer | str | None]: ...


@dataclass(frozen=True)
class HashedWordEmbedder:
    """An offline embedder: words hashed into signed dimensions. Deterministic; for tests and dry runs."""

    dimensions: int = 256

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for text in texts:
            vector = [0.0] * self.dimensions
            for word in text.lower().split() or [""]:
                h = zlib.crc32(word.encode())
                vector[h % self.dimensions] += 1.0 if h & 0x80000000 else -1.0
            vector[0] += 1e-3
            out.append(vector)
        return out
