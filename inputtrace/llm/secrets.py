"""Secrets by pattern, and by entropy.

Three patterns give the base spans. Beside them, each character class cuts a text into candidate
strings, the longest runs of its characters; a window slides over a candidate, and its Shannon
entropy follows from the counts of its characters, which change by one character in and one out a
step. Windows of high entropy are joined into spans. Candidates that an allow list knows to be
harmless, and spans inside a base span, are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inputtrace.llm.common import carried, mapped, numbered, table

# Fixed by the query's contract.
KEYWORD = re.compile(b"password|passwd|secret|token|api_?key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(b"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
BASE = ("assign", "access", "hex")
LOWER_HEX = b"0123456789abcdef"


class CharClass(NamedTuple):
    """A kind of candidate: its characters, the window's length, the least entropy in bits."""

    kind: str
    characters: bytes
    window: int
    least: float


UPPERS, LOWERS, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
CLASSES = (
    CharClass("entropy_hex", DIGITS + b"abcdefABCDEF", 32, 3.0),
    CharClass("entropy_alnum", DIGITS + LOWERS, 24, 3.75),
    CharClass("entropy_base64", DIGITS + UPPERS + LOWERS + b"+/_-", 24, 4.0),
)

# Harmless candidates: numbers; words and numbers of up to four digits, joined; identifiers; alphabets
# and placeholders, told by what they hold in any case.
ALLOWED = (
    rb"[0-9]+",
    rb"(?:[A-Za-z]?[a-z]*|[A-Z]+|[0-9]{1,4})(?:[-+/_](?:[A-Za-z]?[a-z]*|[A-Z]+|[0-9]{1,4}))*",
    rb"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
)
HARMLESS = (b"example", b"placeholder", b"0123456789abcdef", b"abcdefghijklmnop", b"xxxxxxxx")

SCALE = 1 << 20


@cache
def _weights(window: int) -> list[int]:
    """c log2 c of each count, in whole steps, so that sums of changes are exact."""
    return [0] + [round(c * math.log2(c) * SCALE) for c in range(1, window + 1)]


def _most(window: int, least: float) -> int:
    """The largest sum of weights that a window of at least this entropy has."""
    return math.floor((math.log2(window) - least) * window * SCALE)


def hot_spans(run: bytes, window: int, least: float) -> list[tuple[int, int]]:
    """The joined windows of the run whose entropy is at least `least`."""
    weight, most = _weights(window), _most(window, least)
    counts = [0] * 256
    total = 0
    spans: list[list[int]] = []
    for end, new in enumerate(run, 1):
        count = counts[new]
        counts[new] = count + 1
        total += weight[count + 1] - weight[count]
        if end < window:
            continue
        if total <= most:
            if spans and spans[-1][1] >= end - window:
                spans[-1][1] = end
            else:
                spans.append([end - window, end])
        old = run[end - window]
        count = counts[old]
        counts[old] = count - 1
        total += weight[count - 1] - weight[count]
    return [(a, b) for a, b in spans]


def runs(data: np.ndarray, member: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The longest runs of a class's bytes, those of `least` bytes or more."""
    edge = np.flatnonzero(np.diff(member[data].view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def _member(characters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters)] = True
    return found


class Scanner:
    """Spans of one text after another."""

    def __init__(self, classes: Sequence[CharClass], allowed: Sequence[bytes], harmless: Sequence[bytes]):
        self.classes = [(c, _member(c.characters)) for c in classes]
        self.hex = _member(LOWER_HEX)
        self.allowed = re.compile(b"|".join(b"(?:%s)" % a for a in allowed)) if allowed else None
        self.harmless = harmless
        self.order = {kind: i for i, kind in enumerate([*BASE, *(c.kind for c in classes)])}

    def assigned(self, text: bytes) -> Iterator[tuple[int, int]]:
        low, at = text.lower(), 0
        while (word := KEYWORD.search(low, at)) is not None:
            found = ASSIGN.match(text, word.start())
            at = found.end() if found else word.start() + 1
            if found and found.end(2) - found.start(2) >= LEAST_ASSIGN:
                yield found.span()

    def suppressed(self, run: bytes) -> bool:
        if self.allowed is not None and self.allowed.fullmatch(run):
            return True
        low = run.lower()
        return any(h in low for h in self.harmless)

    def spans(self, text: bytes) -> list[tuple[str, int, int]]:
        """All spans in code points, by start, then kind."""
        if not text:
            return []
        data = np.frombuffer(text, np.uint8)
        found = [("assign", a, b) for a, b in self.assigned(text)]
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        found += [("hex", a, b) for a, b in runs(data, self.hex, LEAST_HEX)]
        base = list(found)
        for kind, member in self.classes:
            for start, end in runs(data, member, kind.window):
                run = text[start:end]
                if self.suppressed(run):
                    continue
                for a, b in hot_spans(run, kind.window, kind.least):
                    a, b = a + start, b + start
                    if not any(x <= a and b <= y for _, x, y in base):
                        found.append((kind.kind, a, b))
        if found and not text.isascii():
            units = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            found = [(kind, int(units[a]), int(units[b])) for kind, a, b in found]
        return sorted(found, key=lambda f: (f[1], self.order[f[0]], f[2]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def secret_spans(
    docs: DataFrame, text: str = "text", carry: Sequence[str] = (), classes: Sequence[CharClass] = CLASSES,
    allowed: Sequence[bytes] = ALLOWED, harmless: Sequence[bytes] = HARMLESS,
) -> DataFrame:
    """Columns of `carry` and spans: where each text may hold a secret, as kind, start and end in
    code points, end exclusive, by start and then by kind.

    Base kinds are `assign` (the whole match), `access` and `hex`, leftmost without overlap within
    a kind; the allow list does not touch them. Kinds may overlap each other. Spans of a class of
    characters cover the candidate's windows of enough entropy; spans that lie in a base span are
    left out; ties go by the order of kinds. Null and empty texts have no spans, repeated rows are
    alike, no rows give no rows. Whole texts of any length."""
    rows = numbered(docs, text, carry).select("text", "doc")
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed, harmless)
        for batch in batches:
            found = [scanner.spans(value.as_buffer().to_pybytes()) for value in batch.column(0)]
            told = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(told, shape)], ["doc", "spans"])

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, spans {SPANS}"
    return mapped(rows, run, schema).select(*carried(carry), "spans")


def told(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def op12_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"), carry=["doc_id"])
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = F.sha2(told(of(*BASE)), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, told(F.col("spans")).alias("spans"))
