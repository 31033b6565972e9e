"""Operator 3: secret scan by one combined deterministic automaton.

The rules' regexes become one automaton (automaton.py) that scans all rules in a single pass over
the bytes. The pass is run in lockstep: a batch of texts is cut into pieces behind bytes after
which every state is the first one, and one array operation moves all pieces a byte on. When fewer
than LEAST_LIVE pieces are left, as in a text that offers no place to cut, each is walked to its end
on the transition arrays, byte by byte; so no text costs more than that a byte. Whenever
a rule's match ends, the rule's backward automaton finds where it began, and the rule's own
length condition accepts or drops it.

A failing match is dropped without a retry inside it. Rules are leftmost and non-overlapping
each; different rules may overlap. Nothing is shuffled; memory is bounded by the Arrow batch.

Defined cases: null and empty texts have no spans. Null doc_ids and repeated rows stay, one result
row per input row. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitelume.llm import automaton
from sitelume.llm.common import texts

PIECE = 2048
LEAST_LIVE = 48  # pieces; an array operation costs about as much as so many single steps
BLOCK_BYTES = 8 << 20
WALKED = 1 << 16


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # characters of group 1 if there is one, else of the match
    ignore_case: bool = False


_SEPARATOR = "[\"']?\\x20*[:=]\\x20*[\"']?"
#: The keyword's letters match in either case; the value is written out with both.
RULES = (
    Rule("assign", "(?:password|passwd|secret|token|api_?key)" + _SEPARATOR + "([A-Za-z0-9+/_.=-]+)", 8, True),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32,}", 32),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("stripe", "[rs]k_(?:live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
)
BASE_KINDS = ("assign", "access", "hex")


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        trees = [automaton.parse(r.pattern.replace("(?:", "("), r.ignore_case) for r in rules]
        self.rules = rules
        self.forward = automaton.compile_rules(trees)
        self.back = [automaton.backward(t) for t in trees]
        self.next, self.ended = self.forward.following.tolist(), self.forward.ended.tolist()
        self.exact = [re.compile(r.pattern.encode(), re.I if r.ignore_case else 0) for r in rules]

    def pieces(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bounds of pieces: each text's start, and the first reset byte's end past every PIECE bytes."""
        reset = np.flatnonzero(np.frombuffer(self.forward.resets, np.uint8)[data]) + 1
        if not len(reset):
            return np.append(starts, len(data))
        wanted = np.arange(PIECE, len(data), PIECE)
        k = np.searchsorted(reset, wanted)
        return np.unique(np.concatenate([starts, reset[k[k < len(reset)]], [len(data)]]))

    def events(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, bits of rules) of every match, in order; raw has a newline behind each text."""
        a = self.forward
        data = np.frombuffer(raw, np.uint8)
        classes = np.frombuffer(raw.translate(a.classes), np.uint8)
        bounds = self.pieces(data, starts)
        at, size = bounds[:-1], np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        at, size = at[order], size[order]
        state = np.zeros(len(at), np.int32)
        ends, bits = [], []
        live = len(at)
        shrinks = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for j, live in enumerate(shrinks.tolist()):
            if live < LEAST_LIVE:
                for k in range(live):
                    self.walk(classes, int(at[k]) + j, int(at[k] + size[k]), int(state[k]), ends, bits)
                break
            here = at[:live] + j
            k = state[:live] + classes[here]
            hit = a.ended[k]
            if hit.any():
                w = np.flatnonzero(hit)
                ends.append(here[w])
                bits.append(hit[w])
            state[:live] = a.following[k]
        if not ends:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        end, bit = np.concatenate(ends), np.concatenate(bits)
        order = np.argsort(end, kind="stable")
        return end[order], bit[order]

    def walk(self, classes: np.ndarray, start: int, stop: int, state: int, ends: list, bits: list) -> None:
        """The rest of one piece, a byte a step, by WALKED bytes at once."""
        following, ended = self.next, self.ended
        for a in range(start, stop, WALKED):
            found, hit = [], []
            for i, c in enumerate(classes[a : min(a + WALKED, stop)].tolist(), a):
                k = state + c
                if ended[k]:
                    found.append(i)
                    hit.append(ended[k])
                state = following[k]
            if found:
                ends.append(np.array(found, np.int64))
                bits.append(np.array(hit, np.int32))

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Per text its spans (start, rule, end) in code points, sorted."""
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        lengths = np.array([len(c) + 1 for c in coded], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        first = 0
        while first < len(coded):  # blocks of BLOCK_BYTES, at least one text each
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES)) - 1)
            raw = b"\n".join(coded[first:last]) + b"\n"
            starts = offsets[first:last] - offsets[first]
            self._spans(raw, starts, first, coded, texts, out)
            first = last
        return out

    def _spans(self, raw: bytes, starts: np.ndarray, first: int, coded: list[bytes], texts: list, out: list) -> None:
        done: dict[tuple[int, int], int] = {}
        points: dict[int, np.ndarray] = {}  # of texts with wide characters: code points before each byte
        for end, bits in zip(*(x.tolist() for x in self.events(raw, starts)), strict=True):
            i = int(np.searchsorted(starts, end, side="right")) - 1
            data, stop = coded[first + i], end - int(starts[i])
            for k, rule in enumerate(self.rules):
                if bits >> k & 1:
                    start = self.back[k].start_of(data, stop, done.get((i, k), 0))
                    done[i, k] = stop
                    m = self.exact[k].fullmatch(data, start, stop)
                    if m and len(m[m.re.groups]) >= rule.least:
                        if len(texts[first + i]) != len(data):
                            if i not in points:
                                points[i] = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                            out[first + i].append((int(points[i][start]), k, int(points[i][stop])))
                        else:
                            out[first + i].append((start, k, stop))
        for i in {i for i, _ in done}:
            out[first + i].sort()


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts and digests of the base kinds, and all spans as kind:start:end."""
    kinds = [r.kind for r in rules]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(rules)
        for batch in batches:
            found = s.scan(batch.column(1).to_pylist())
            text = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
            base = [[x for x in spans if kinds[x[1]] in BASE_KINDS] for spans in found]
            counts = [pa.array([sum(kinds[x[1]] == kind for x in b) for b in base], pa.int64()) for kind in BASE_KINDS]
            digest = pa.array([hashlib.sha256(text(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array(map(text, found), pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return texts(docs).select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
