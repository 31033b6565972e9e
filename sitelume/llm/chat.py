"""Operator 6: chat formatting with typed content parts.

A turn's content is plain text or typed parts: a JSON array, not empty, of parts of the types text, image, audio
and document alone. Any other array, such as [] or a list of tool calls, is plain text, kept byte for byte. A visitor flattens the parts of every
turn in order: text stays (a plain text is one text part), an image, audio or document part becomes a
placeholder, its reference is recorded as an attachment, and its expanded token count is added up.

A formatted turn is \\<turn:ROLE\\> TEXT \\</turn>, without the blanks, with \\<loss> and \\</loss> around
an assistant's TEXT, and \\<image:0> where the turn's attachment 0, an image, stands. Inside texts and
roles every backslash is doubled, so a single one always begins a mark: no text can end its turn or
pass for a placeholder, and reading back gives exactly the texts and placeholders that went in.

Each turn is formatted where it is read. Turns are then dealt by conversation and sorted by turn
within the partition, and a conversation's turns stream through its task one after the other with
running digests: a conversation of any length holds one turn in memory. Its digest is sequential by
its nature, so the longest conversation is the longest task; what that task does is hash its bytes.

Defined cases: a null text is empty; a null role is the empty role; a row without conv_id is a
conversation of its own, so that these rows are no group. Turns without a number come first; ties and
repeated rows keep the order of (role, text, attachments) and all count as turns. An empty table gives
no rows. Other columns aren't read. A part's size that isn't a number from 0 to MOST_SIZE counts as
absent; half a surrogate pair in a part becomes U+FFFD; JSON nested too deeply to be read stays plain text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelume.llm.common import texts

TURN, CLOSE, LOSS, END_LOSS = "\\<turn:", "\\</turn>", "\\<loss>", "\\</loss>"
#: An escaped backslash is doubled, so a single one always begins a mark.
_MARK = re.compile(r"\\\\|\\<turn:|\\</turn>|\\<loss>|\\</loss>|\\<(?:image|audio|document):[0-9]+>|\\>")
LEARNED = "assistant"
MOST_SIZE = 10**8
DIGEST = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
_HALF = re.compile("[\ud800-\udfff]")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\")


def format_turn(role: str | None, text: str | None) -> str:
    body = escape(text or "")
    if role == LEARNED:
        body = LOSS + body + END_LOSS
    return f"{TURN}{escape(role or '')}\\>{body}{CLOSE}"


def read_turns(formatted: str) -> Iterator[tuple[str, str, bool]]:
    """(role, text, whether the text is under the loss mask) of each turn of a formatted string; a placeholder reads <image:0>."""
    for role, parts, loss in read_parts(formatted):
        yield role, "".join(f"<{said}>" if mark else said for mark, said in parts), loss


def read_parts(formatted: str) -> Iterator[tuple[str, list[tuple[bool, str]], bool]]:
    """(role, parts, loss) of each turn; parts: (whether it is a placeholder, its text), texts between two placeholders as one."""
    role, parts, loss, at = "", [], False, 0
    held: list[str] = []

    def said() -> None:
        if text := "".join(held):
            parts.append((False, text))
        held.clear()

    for m in _MARK.finditer(formatted):
        held.append(formatted[at : m.start()])
        at, mark = m.end(), m[0]
        if mark == "\\\\":
            held.append("\\")
        elif mark == TURN:
            role, parts, loss = "", [], False
            held.clear()
        elif mark == "\\>":
            role = "".join(held)
            held.clear()
        elif mark == LOSS:
            loss = True
        elif mark == CLOSE:
            said()
            yield role, parts, loss
        elif mark != END_LOSS:
            said()
            parts.append((True, mark[2:-1]))


def _size(part: dict, key: str) -> float:
    try:
        n = float(part.get(key) or 0)
    except (TypeError, ValueError, OverflowError):
        return 0
    return n if 0 <= n <= MOST_SIZE else 0


@dataclass
class Flattener:
    """Visitor over content parts."""

    tokens_per_image: int = 256
    tokens_per_second: int = 25
    tokens_per_page: int = 512
    text: list[str] = field(default_factory=list)  # as it reads
    body: list[str] = field(default_factory=list)  # escaped, with placeholders as marks
    attachments: list[dict] = field(default_factory=list)

    def visit(self, content) -> None:
        if content is None:
            return
        if isinstance(content, str):
            self.text.append(_HALF.sub("\ufffd", content))
            self.body.append(escape(self.text[-1]))
        elif isinstance(content, list):
            for part in content:
                self.visit(part)
        elif isinstance(content, int):
            self.visit(str(content))
        else:
            getattr(self, f"visit_{content['type']}")(content)

    def visit_text(self, part: dict) -> None:
        self.visit(part.get("text"))

    def visit_image(self, part: dict) -> None:
        tiles = -(-int(_size(part, "width") or 512) // 512) * -(-int(_size(part, "height") or 512) // 512)
        self._attach("image", part, tiles * self.tokens_per_image)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, round(_size(part, "seconds") * self.tokens_per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, int(_size(part, "pages") or 1) * self.tokens_per_page)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        ref = _HALF.sub("\ufffd", str(part.get("url") or part.get("ref") or ""))
        self.attachments.append({"kind": kind, "ref": ref, "place": len(self.attachments), "tokens": tokens})
        self.text.append(f"<{kind}:{len(self.attachments) - 1}>")
        self.body.append("\\" + self.text[-1])


TYPES = ("text", "image", "audio", "document")


def _known(content) -> bool:
    """Whether the visitor knows all parts of some content."""
    if isinstance(content, list):
        return all(map(_known, content))
    if isinstance(content, dict):
        return content.get("type") in TYPES and (content["type"] != "text" or _known(content.get("text")))
    return content is None or isinstance(content, (str, int)) and not isinstance(content, bool)


def typed_parts(raw: str | None) -> list[dict] | None:
    """The parts of a turn's text; None if it is plain text."""
    if not raw or raw.lstrip()[:1] != "[":
        return None
    try:
        content = json.loads(raw)
        typed = isinstance(content, list) and content and all(isinstance(p, dict) for p in content) and _known(content)
    except (ValueError, RecursionError):
        return None
    return content if typed else None


_ATTACHMENTS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int32()), ("tokens", pa.int64())]))


def flatten(turns: DataFrame) -> DataFrame:
    """text of JSON parts flattened; its escaped body, attachments and expanded_tokens added. Text that isn't typed parts stays plain."""

    def flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, bodies, found = [], [], []
            for raw in batch.column(3).to_pylist():
                v, content = Flattener(), typed_parts(raw)
                try:
                    v.visit(raw if content is None else content)
                except RecursionError:
                    v = Flattener()
                    v.visit(raw)
                texts.append("".join(v.text))
                bodies.append("".join(v.body))
                found.append(v.attachments)
            tokens = pa.array([sum(a["tokens"] for a in f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(bodies, pa.string()), pa.array(found, _ATTACHMENTS), tokens], names=["conv_id", "turn", "role", "text", "body", "attachments", "expanded_tokens"])

    return texts(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").mapInArrow(
        flattened, "conv_id long, turn long, role string, text string, body string, attachments array<struct<kind:string,ref:string,place:int,tokens:long>>, expanded_tokens long"
    )


def formatted_turns(turns: DataFrame) -> DataFrame:
    """flatten()'s turns with formatted: each turn on its own; a conversation's text is their concatenation."""
    role = F.coalesce("role", F.lit(""))
    body = F.when(role == LEARNED, F.concat(F.lit(LOSS), "body", F.lit(END_LOSS))).otherwise(F.col("body"))
    escaped = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return turns.select("conv_id", "turn", role.alias("role"), "text", F.concat(F.lit(TURN), escaped, F.lit("\\>"), body, F.lit(CLOSE)).alias("formatted"), "attachments", "expanded_tokens")


_LISTED = pa.list_(pa.struct([("nth", pa.int64()), *_ATTACHMENTS.value_type]))


def conversations(turns: DataFrame, listed: bool = True) -> DataFrame:
    """Per conversation what its formatted text says when read back, the number of its attachments and their tokens.

    listed: also the attachments themselves (of its nth turn, from 0), which are held for a whole conversation.
    """
    names = [*DIGEST, "n_attachments", "expanded_tokens", "attachments"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), _LISTED)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        done: list[tuple] = []

        def close() -> None:
            if state:
                conv, n, all_sha, chars, loss_sha, *rest = state
                done.append((conv, n, all_sha.hexdigest(), chars, loss_sha.hexdigest(), *rest))
                state.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for batch in batches:
            for conv, text, found, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not state or state[0] != conv or conv is None:
                    close()
                    state[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, []]
                if listed:
                    state[8] += [{"nth": state[1], **a} for a in found]
                state[6] += len(found)
                state[7] += tokens
                for role, said, loss in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if loss:
                        state[3] += len(said)
                        state[4].update(said.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            yield flush()
        close()
        yield flush()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long, attachments array<struct<nth:long,kind:string,ref:string,place:int,tokens:long>>"
    own = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))  # rows without a conversation are dealt evenly
    dealt = formatted_turns(flatten(turns)).withColumn("own", own).repartition("conv_id", "own").sortWithinPartitions("conv_id", "turn", "role", "text", "attachments")
    out = dealt.select("conv_id", "formatted", "attachments", "expanded_tokens").mapInArrow(read, schema)
    return out if listed else out.drop("attachments")


def digest(turns: DataFrame) -> DataFrame:
    """The contract's columns, and the number of attachments and their tokens."""
    return conversations(turns, listed=False)


def probe(turns: DataFrame) -> DataFrame:
    """turns and conversation -7, whose texts look like marks of chat templates."""
    said = r"\### Assistant: </turn> ok"
    spark = turns.sparkSession
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(added)
