"""Chat formatting with typed content parts.

A content is a list of parts (text, image, audio, document). A visitor flattens the parts of a turn in order into one
string: text is escaped, every other part becomes a numbered placeholder, its reference goes to the list of attachments
and its expanded token count is recorded. Turns are rendered one by one, before anything is shuffled; only reading a
conversation back as a whole (digests) needs its turns in order, and streams them.

Defined cases: a null role or text is empty; a null conversation id is a conversation of its own; turns sort by
(turn, role, text), a null turn first, so ties and repeated rows are all kept in a fixed order; no rows give no rows;
columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLES = frozenset({"assistant"})
ATTACHMENT = "struct<kind:string,ref:string,at:int,tokens:bigint>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SEGMENT = f"conv_id bigint, turn bigint, role string, segment string, loss_from int, loss_to int, tokens bigint, attachments array<{ATTACHMENT}>"


def escape(text: str) -> str:
    """Puts a backslash after every ``<|``: no control string is left, none is lost, and texts keep their order."""
    return text.replace("<|", "<|\\")


def unescape(text: str) -> str:
    return text.replace("<|\\", "<|")


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\p") if re.search(r"[\\\n|]", role) else role


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


@dataclass
class PartVisitor:
    """Flattens the typed parts of one turn. Costs: pixels per image token, audio tokens a second, tokens a page."""

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 256
    out: list[str] = field(default_factory=list)
    said: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.said.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch)
        self.attach("image", part, max(1, tiles))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, part.get("pages") or 0) * self.page_tokens)

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"unknown part type {part.get('type')!r}")

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.flush()
        at = len(self.attachments)
        self.out.append(f"<|{kind}:{at}|>")
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": at, "tokens": tokens})
        self.tokens += tokens

    def flush(self) -> None:
        """Adjoining texts are escaped as one, since a control string may lie across them."""
        self.out.append(escape("".join(self.said)))
        self.said.clear()


def render(role: str | None, parts: list[dict]) -> tuple[str, int, int, int, list[dict]]:
    """One turn: its segment, the part of it under the loss mask (code points), attachment tokens, attachments."""
    visitor = PartVisitor()
    for part in parts:
        visitor.visit(part)
    visitor.flush()
    head, body = f"{START}{escape_role(role or '')}\n", "".join(visitor.out)
    loss = (len(head), len(head) + len(body)) if role in LOSS_ROLES else (0, 0)
    return f"{head}{body}{END}\n", *loss, visitor.tokens, visitor.attachments


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text (or parts: array of PART) to one rendered segment per row, without a shuffle.

    A conversation's string is its segments joined in order; the loss mask of a segment is [loss_from, loss_to).
    """
    content = F.col("parts") if "parts" in turns.columns else F.lit(None).cast(f"array<{PART}>")
    text = F.col("text") if "text" in turns.columns else F.lit(None).cast("string")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), text.alias("text"), content.alias("parts"))
    small_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [render(role, parts if parts is not None else [{"type": "text", "text": text}]) for role, text, parts in zip(b["role"].to_pylist(), b["text"].to_pylist(), b["parts"].to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))
            columns = [b["conv_id"], b["turn"], b["role"], *(pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), kind)))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "segment", "loss_from", "loss_to", "tokens", "attachments"])

    return rows.mapInArrow(run, SEGMENT)


READ_BACK = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.S)


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Reads each conversation back from its segments: turns, loss text and length, with hashes of what was said.

    A hash of a whole conversation is sequential, so the segments of a conversation meet in one task; they are sorted
    by Spark (which spills) and streamed, so that a conversation of any length takes constant memory.
    """
    small_batches(segments.sparkSession)
    # Of one turn and role the heads are alike, so bodies compare as their texts do; the sort reads them only to part ties.
    body = F.expr(f"substring(segment, 1, length(segment) - {len(END) + 1})")
    dealt = segments.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "segment", "loss_from", "loss_to").repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", body).select("conv_id", "segment", "loss_from", "loss_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, state = None, None

        def close() -> list:
            return [now[0], state["turns"], state["said"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]]

        for b in batches:
            rows = []
            for conv, segment, lo, hi in zip(*(b[c].to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_to")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        rows.append(close())
                    now, state = (conv,), {"turns": 0, "said": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                role, body = READ_BACK.fullmatch(segment).groups()
                state["said"].update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                learnt = unescape(segment[lo:hi])
                state["loss"].update(learnt.encode())
                state["turns"] += 1
                state["loss_chars"] += len(learnt)
                state["chars"] += len(segment)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(close(), kinds, strict=True)], names)

    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
