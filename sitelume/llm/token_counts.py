"""Operator 8: token counts of fields and sections by offset-mapped attribution.

A document is its fields one behind the other, each ended by a line break, and is encoded once
and whole. A byte-level token's length is known from its id, so running sums give every token's
span; spans are interval-joined to the sections by binary search. Each token is allocated to one
section, and a token that crosses a boundary goes by an explicit rule:

    most   to the section with most of its bytes, the earlier one of a tie (the default)
    start  to the section of its first byte
    end    to the section of its last byte

so the sections' counts add up to the document's. The sections of a field are its paragraphs,
that is, lines together with the line breaks behind them. Nothing is shuffled, and a document is
gathered in no place but its own row.

Defined cases: a null field is empty and still has one section with its line break. Null doc_ids
and repeated rows stay, with all their sections. An empty table gives no rows. The string of a
special token is one token. Only doc_id and the fields are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelume.llm import common, packing

RULES = ("most", "start", "end")
SECTIONS_A_BATCH = 20_000  # rows of an output batch, or one document's


@lru_cache(maxsize=2)
def token_bytes(vocabulary: str) -> np.ndarray:
    """Bytes of each token."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        file = json.load(f)
    size = {i: len(token) for token, i in file["model"]["vocab"].items()}  # a character of the file stands for a byte
    size |= {t["id"]: len(t["content"].encode()) for t in file["added_tokens"]}
    out = np.zeros(max(size) + 1, np.int64)
    out[list(size)] = list(size.values())
    return out


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section; ends: of tokens, bounds: ends of sections (bytes)."""
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends, side="left")
    to = {"start": first, "end": last}.get(rule)
    crossing = first != last
    if to is None:
        to = first.copy()
        for t in np.flatnonzero(crossing).tolist():
            inner = np.arange(first[t], last[t] + 1)
            left = np.maximum(np.where(inner > 0, bounds[inner - 1], 0), starts[t])
            to[t] = inner[np.argmax(np.minimum(bounds[inner], ends[t]) - left)]
    n = len(bounds)
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def paragraphs(text: str) -> list[str]:
    """Lines with their line breaks; blank lines belong to the line before."""
    out: list[str] = []
    for line in text.split("\n"):
        if out and not line.strip():
            out[-1] += line + "\n"
        else:
            out.append(line + "\n")
    return out


def attributed(docs: DataFrame, fields: tuple[str, ...] = ("source", "lang", "text"), rule: str = "most", vocabulary: str = packing.VOCABULARY) -> DataFrame:
    """doc_id, field, section (from 0 within the field), start and length in code points of the field, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = ["doc_id", "field", "section", "start", "length", "n_tokens", "n_crossing"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = packing.encoder(vocabulary), token_bytes(vocabulary)
        types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

        def flush(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [(f, k, p) for f, v in zip(fields, row[1:], strict=True) for k, p in enumerate(paragraphs(v or ""))]
                bounds = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for *_, p in parts])
                ids = encode("".join(p for *_, p in parts))
                tokens, crossing = allocate(np.cumsum(size[np.array(ids, np.int64)]), bounds, rule)
                lengths = np.array([len(p) for *_, p in parts])
                starts = np.cumsum(lengths) - lengths
                field_start: dict[str, int] = {}
                for (f, _, _), s in zip(parts, starts.tolist(), strict=True):
                    field_start.setdefault(f, s)
                out[0] += [row[0]] * len(parts)
                out[1] += [f for f, *_ in parts]
                out[2] += [k for _, k, _ in parts]
                out[3] += [s - field_start[f] for (f, *_), s in zip(parts, starts.tolist(), strict=True)]
                out[4] += lengths.tolist()
                out[5] += tokens.tolist()
                out[6] += crossing.tolist()
                if len(out[0]) >= SECTIONS_A_BATCH:
                    yield flush(out)
                    out = [[] for _ in names]
            yield flush(out)

    few = common.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f).cast("string").alias(f) for f in fields))
    return few.mapInArrow(counted, "doc_id long, field string, section int, start long, length long, n_tokens long, n_crossing long")
