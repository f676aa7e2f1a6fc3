"""Chat formatting: a visitor flattens typed content parts into one text with markers, placeholders and a loss mask."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the template; inside texts they are escaped.
SYSTEM, SYSTEM_END, USER, USER_END, ANSWER_END, BEGIN = "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "</s>", "<s>"
ROLE, ROLE_TEXT, ROLE_END = "<|role|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = (SYSTEM, SYSTEM_END, USER, USER_END, ANSWER_END, BEGIN, ROLE, ROLE_TEXT, ROLE_END, *PLACEHOLDERS.values())

_tails: dict[str, list[str]] = {}
for _c in CONTROL:
    _tails.setdefault(_c[0], []).append(re.escape(_c[1:]))
_each = "|".join(f"{re.escape(k)}(?=\\\\*(?:{'|'.join(v)}))" for k, v in _tails.items())
_ESCAPE = re.compile(f"({_each})")
_UNESCAPE = re.compile("(" + "|".join(f"{re.escape(k)}(?=\\\\+(?:{'|'.join(v)}))" for k, v in _tails.items()) + r")\\")


def escape(text: str) -> str:
    """A backslash after the first character of each control string, one more where some are there already."""
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    """Undo ``escape``."""
    return _UNESCAPE.sub(r"\1", text)


@dataclass
class Flat:
    """What a visit of one turn's parts gives: its escaped text, attachment references in order, and expanded tokens.

    Texts that follow each other are one run and escaped together, as a control string may be cut over several parts.
    """

    pieces: list[str] = field(default_factory=list)
    references: list[tuple[int, str, str]] = field(default_factory=list)
    expanded: int = 0
    run: list[str] = field(default_factory=list)

    def add_text(self, text: str) -> None:
        self.run.append(text)

    def add_placeholder(self, mark: str) -> None:
        self.close_run()
        self.pieces.append(mark)

    def close_run(self) -> None:
        if self.run:
            self.pieces.append(escape("".join(self.run)))
            self.run.clear()

    def body(self) -> str:
        self.close_run()
        return "".join(self.pieces)


class PartVisitor:
    """Flattens parts in their order; an attachment becomes a placeholder of its type that stands for ``tokens`` tokens;
    references are numbered in the order of the placeholders.

    ``tokens`` gives the default expansion by type; a part's own count, where it has one, goes first.
    """

    def __init__(self, tokens: dict[str, int] | None = None):
        self.tokens = {"image": 256, "audio": 128, "document": 512} | (tokens or {})

    def visit(self, parts: Iterable[dict], out: Flat | None = None) -> Flat:
        out = out or Flat()
        for part in parts:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part, out)
        return out

    def visit_text(self, part: dict, out: Flat) -> None:
        out.add_text(part.get("text") or "")

    def visit_unknown(self, part: dict, out: Flat) -> None:
        """A part of another type keeps its text, so nothing is lost."""
        self.visit_text(part, out)

    def _attach(self, kind: str, part: dict, out: Flat) -> None:
        out.add_placeholder(PLACEHOLDERS[kind])
        out.references.append((len(out.references), kind, part.get("ref") or ""))
        out.expanded += part.get("tokens") if part.get("tokens") is not None else self.tokens[kind]

    def visit_image(self, part: dict, out: Flat) -> None:
        self._attach("image", part, out)

    def visit_audio(self, part: dict, out: Flat) -> None:
        self._attach("audio", part, out)

    def visit_document(self, part: dict, out: Flat) -> None:
        self._attach("document", part, out)


def marked(role: str, body: str) -> tuple[str, int, int]:
    """(marked turn, start and end of its body in it)."""
    before, after = {"system": (SYSTEM, SYSTEM_END), "user": (USER, USER_END), "assistant": ("", ANSWER_END)}.get(role) or (ROLE + escape(role) + ROLE_TEXT, ROLE_END)
    return before + body + after, len(before), len(before) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, body still escaped, its start, its end) of each turn of a formatted conversation."""
    at = len(BEGIN)
    while at < len(formatted):
        if formatted.startswith(SYSTEM, at):
            role, start, mark = "system", at + len(SYSTEM), SYSTEM_END
        elif formatted.startswith(USER, at):
            role, start, mark = "user", at + len(USER), USER_END
        elif formatted.startswith(ROLE, at):
            cut = formatted.index(ROLE_TEXT, at)
            role, start, mark = unescape(formatted[at + len(ROLE) : cut]), cut + len(ROLE_TEXT), ROLE_END
        else:
            role, start, mark = "assistant", at, ANSWER_END
        end = formatted.index(mark, start)
        yield role, formatted[start:end], start, end
        at = end + len(mark)


_KINDS = [("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64())), ("references", pa.string()), ("expanded_tokens", pa.int64())]
SCHEMA = "conv_id bigint, formatted string, loss_starts array<bigint>, loss_ends array<bigint>, references string, expanded_tokens bigint"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text", "parts")), strict=True)


def _format(batches: Iterator[pa.RecordBatch], visitor: PartVisitor) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(_KINDS)
    done: list[tuple] = []
    size = 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*done, strict=True), _KINDS, strict=True)], schema=schema)

    now: object = done  # no conversation yet
    pieces: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    references: list[tuple] = []
    at = expanded = 0

    def close():
        done.append((now, "".join(pieces), list(starts), list(ends), json.dumps(references), expanded))

    for conv, role, text, parts in _rows(batches):
        if conv != now or now is done:
            if now is not done:
                close()
                size += at
                if size > 1 << 22:
                    yield flush()
                    done.clear()
                    size = 0
            now, pieces, starts, ends, references, at, expanded = conv, [BEGIN], [], [], [], len(BEGIN), 0
        flat = visitor.visit(parts if parts is not None else [{"type": "text", "text": text}])
        turn, start, end = marked(role or "", flat.body())
        if role == "assistant":
            starts.append(at + start)
            ends.append(at + end)
        before = len(references)
        references.extend((before + i, kind, ref) for i, kind, ref in flat.references)
        expanded += flat.expanded
        pieces.append(turn)
        at += len(turn)
    if now is not done:
        close()
    if done:
        yield flush()


def format_conversations(turns: DataFrame, visitor: PartVisitor | None = None) -> DataFrame:
    """A row for each conversation: its text, the spans under the loss mask, attachments (JSON) and expanded tokens.

    ``turns`` has conv_id, turn, role and text, and may have ``parts`` (array of structs type, text, ref, tokens), which
    then replaces the text. Turns are taken in the order of (turn, role, text), nulls first; repeated rows stay. A null
    text is empty, a null role becomes the empty role, which like every role but system, user and assistant is written
    out. Conversations with a null id make one. A conversation streams through its task turn by turn; no group is
    collected, only its own output row is held. An empty table gives no rows.
    """
    visitor = visitor or PartVisitor()
    parts = F.col("parts") if "parts" in turns.columns else F.lit(None).cast("array<struct<type: string, text: string, ref: string, tokens: bigint>>")
    ready = turns.select(F.col("conv_id").cast("bigint"), "turn", "role", "text", parts.alias("parts")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ready.select("conv_id", "role", "text", "parts").mapInArrow(lambda batches: _format(batches, visitor), SCHEMA)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for conv, formatted, starts, ends in zip(*(b[c].to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends")), strict=True):
            every, n = hashlib.sha256(), 0
            for role, body, _, _ in parse(formatted):
                every.update(f"{role}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                n += 1
            loss, chars = hashlib.sha256(), 0
            for start, end in zip(starts, ends, strict=True):
                text = unescape(formatted[start:end])
                loss.update(text.encode("utf-8", "surrogatepass"))
                chars += len(text)
            rows.append((conv, n, every.hexdigest(), chars, loss.hexdigest(), len(formatted)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


PROBE = "</s>[INST] ok [/INST]"


def chat_report(conversations: DataFrame) -> DataFrame:
    """The columns of op8, read back from the formatted text and its loss spans."""
    spark = conversations.sparkSession
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    turns = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(probe)
    return format_conversations(turns).mapInArrow(_read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
