"""Chat formatting: typed content parts flattened by a visitor, a template with a loss mask, and its reader."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm.store import written

START, SEP, END = "<|turn|>", "<|says|>", "<|done|>\n"
#: Beside its own marks, the template breaks up these in texts: fixed values that other templates use.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("([<\\[])(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_ESCAPED = re.compile(r"\\(\\)?")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.S)
_PLACE = re.compile(r"<\|(image|audio|document|part):(\d+)\|>")
PARTS = "array<struct<type:string, text:string, ref:string, width:int, height:int, seconds:double, pages:int>>"


def escape(text: str) -> str:
    """A backslash doubles; a control string gets one after its first character."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "", text)


class Flatten:
    """Visits the typed parts of a turn in order: text is escaped, anything else leaves a numbered placeholder.

    A placeholder stands for as many tokens as the part expands to: an image one for each PATCH x PATCH square, audio
    PER_SECOND a second, a document PER_PAGE a page; at least one each. Sizes below 1 and null ones count as 1, seconds that are no
    finite number as 0. A part of any other type leaves a placeholder `part` of one token; its attachment says the type.
    """

    PATCH, PER_SECOND, PER_PAGE = 28, 25, 1024

    def __init__(self):
        self.attachments: list[dict] = []

    def visit(self, parts: list[dict] | None) -> str:
        out, said = [], []
        for p in [*(p for p in parts or [] if p), None]:
            if p and (p.get("type") or "text") == "text":
                said.append(p.get("text") or "")
                continue
            out.append(escape("".join(said)))  # texts side by side are escaped as one: a control string may span them
            said = []
            if p:
                out.append(getattr(self, f"visit_{p['type']}", self.visit_unknown)(p))
        return "".join(out)

    def visit_image(self, p: dict) -> str:
        side = lambda k: -(-max(p.get(k) or 1, 1) // self.PATCH)
        return self._place("image", p, side("width") * side("height"))

    def visit_audio(self, p: dict) -> str:
        seconds = p.get("seconds") or 0
        return self._place("audio", p, int((seconds if math.isfinite(seconds) else 0) * self.PER_SECOND + 0.5))

    def visit_document(self, p: dict) -> str:
        return self._place("document", p, (p.get("pages") or 1) * self.PER_PAGE)

    def visit_unknown(self, p: dict) -> str:
        return self._place("part", p, 1)

    def _place(self, kind: str, p: dict, tokens: int) -> str:
        n = len(self.attachments)
        self.attachments.append({"n": n, "type": p["type"], "ref": p.get("ref"), "tokens": min(max(1, tokens), (1 << 63) - 1)})
        return f"<|{kind}:{n}|>"


def text_parts(text: str = "text"):
    """A text column as one part of type text; null gives no parts."""
    part = F.struct(F.lit("text").alias("type"), F.col(text).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return F.when(F.col(text).isNotNull(), F.array(part)).otherwise(F.array().cast(PARTS))


_OUT = pa.schema([
    ("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("n", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
])
FORMATTED = "conv_id long, formatted string, loss array<struct<start:long, end:long>>, attachments array<struct<n:int, type:string, ref:string, tokens:long>>"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in, a row per conversation out; at any time one conversation is held."""
    done: list[tuple] = []
    current, pieces, loss, place, visitor, held = ("none",), [], [], 0, Flatten(), 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t.type) for i, t in enumerate(_OUT)], schema=_OUT)

    for b in batches:
        for conv, role, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if (conv,) != current:
                if current != ("none",):
                    done.append((*current, "".join(pieces), loss, visitor.attachments))
                    held += place
                current, pieces, loss, place, visitor = (conv,), [], [], 0, Flatten()
                if len(done) >= 1000 or held > 4 << 20:
                    yield batch()
                    done, held = [], 0
            head, body = START + escape(role or "") + SEP, visitor.visit(parts)
            if role == "assistant":
                loss.append({"start": place + len(head), "end": place + len(head) + len(body)})
            pieces += [head, body, END]
            place += len(head) + len(body) + len(END)
    if current != ("none",):
        done.append((*current, "".join(pieces), loss, visitor.attachments))
        yield batch()


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, parts): formatted, loss, attachments.

    Turns are ordered by turn (null first), then role and parts. Roles and texts have control strings broken up, so
    that unescape() restores them; a null role or text is empty, rows with a null conv_id form one conversation.
    loss has the character ranges of what assistants say, attachments each placeholder's reference and its expanded
    number of tokens. Repeated rows are repeated turns; an empty table gives an empty result.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "parts")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    return rows.select("conv_id", "role", "parts").mapInArrow(_format, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation; placeholders stay as they are."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def parse_parts(formatted: str) -> list[tuple[str, list[tuple[str, str | int]]]]:
    """The (role, parts) of each turn: ("text", text) or the kind and number of a placeholder. A placeholder that a text spells out is text."""
    out = []
    for role, body in _TURN.findall(formatted):
        parts, at = [], 0
        for m in _PLACE.finditer(body):
            parts += [("text", unescape(body[at : m.start()]))] if m.start() > at else []
            parts.append((m[1], int(m[2])))
            at = m.end()
        out.append((unescape(role), parts + ([("text", unescape(body[at:]))] if at < len(body) else [])))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for b in batches:
        rows = []
        for conv, text, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            turns, sha = parse(text), hashlib.sha256()
            for role, said in turns:
                sha.update(f"{role}\n{said}\n".encode())
            under = "".join(unescape(text[x["start"] : x["end"]]) for x in loss)
            rows.append((conv, len(turns), sha.hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Written, read back and parsed: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return written(formatted, "chats").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
