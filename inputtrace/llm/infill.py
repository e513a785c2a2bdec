"""Fill-in-the-middle by piece tables.

A document is never edited. It is a list of descriptors (buffer, start, end) over two immutable
buffers: the bytes of its text, and the sentinels. Cutting splits a descriptor, an arrangement
permutes descriptors, and the inverse permutation puts a rearranged text back. Hashes stream over
the descriptors, so the text is not copied for them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inputtrace.llm.common import carried, mapped, numbered, table

# Fixed values of the format: sentinels, and the order of the parts in each form.
SENTINELS = b"<P><S><M>"
SENTINEL = re.compile(b"<[PSM]>")
PREFIX, MIDDLE, SUFFIX, P, S, M = range(6)  # places in a cut table: its three parts, then the sentinels
FORMS = {"psm": (P, PREFIX, S, SUFFIX, M, MIDDLE), "spm": (S, SUFFIX, P, PREFIX, M, MIDDLE)}
PLAIN = "plain"

TEXT, MARKS = 0, 1  # buffers
Piece = tuple[int, int, int]


class PieceTable:
    """Descriptors over a text's bytes and the sentinels."""

    def __init__(self, text, pieces: Sequence[Piece]):
        self.buffers, self.pieces = (memoryview(text), memoryview(SENTINELS)), list(pieces)

    @classmethod
    def of(cls, text) -> PieceTable:
        return cls(text, [(TEXT, 0, len(text))])

    def cut(self, at: int) -> None:
        """Split the last descriptor of the text at this byte; either half may be empty."""
        buffer, start, end = self.pieces.pop()
        self.pieces += [(buffer, start, at), (buffer, at, end)]

    def mark(self) -> None:
        """Add a descriptor for each sentinel."""
        self.pieces += [(MARKS, i, i + 3) for i in range(0, len(SENTINELS), 3)]

    def arranged(self, order: Sequence[int]) -> PieceTable:
        table = PieceTable(b"", [self.pieces[i] for i in order])
        table.buffers = self.buffers
        return table

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, end in self.pieces:
            yield self.buffers[buffer][start:end]

    def sha256(self) -> str:
        found = hashlib.sha256()
        for part in self.stream():
            found.update(part)
        return found.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.stream())


def inverse(order: Sequence[int]) -> list[int]:
    found = [0] * len(order)
    for place, i in enumerate(order):
        found[i] = place
    return found


class Units:
    """Code points of UTF-8 bytes: how many there are, and at which byte one begins."""

    def __init__(self, text):
        data = np.frombuffer(text, np.uint8)
        self.size = len(data)
        self.starts = None
        if self.size and data.max() > 127:
            self.starts = np.flatnonzero((data & 0xC0) != 0x80)
        self.n = self.size if self.starts is None else len(self.starts)

    def byte(self, unit: int) -> int:
        if unit >= self.n:
            return self.size
        return unit if self.starts is None else int(self.starts[unit])


def form_of(text, n: int, h3: int, h4: int, plain_from: int, spm_below: int) -> str:
    if not n or h3 % 100 >= plain_from or SENTINEL.search(text):
        return PLAIN
    return "spm" if h4 % 100 < spm_below else "psm"


def cut(text, units: Units, h1: int, h2: int) -> tuple[PieceTable, int, int]:
    """The text as prefix, middle, suffix and sentinels; characters of the first two."""
    first, second = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    cuts = PieceTable.of(text)
    cuts.cut(units.byte(first))
    cuts.cut(units.byte(second))
    cuts.mark()
    return cuts, first, second - first


def restored(output, form: str) -> PieceTable | None:
    """The text's pieces in their order again, over the bytes of an output of this form; none if
    the output is not of that form.

    The sentinels are found in the output. No text that was cut holds one, and none overlaps
    another or a part's end, so each is found where it was put."""
    if form == PLAIN:
        return PieceTable.of(output)
    cuts, at = [], 0
    for mark in SENTINEL.finditer(output):
        cuts += [(TEXT, at, mark.start()), (TEXT, mark.start(), mark.end())]
        at = mark.end()
    cuts = cuts[1:] + [(TEXT, at, len(output))]  # an output begins with a sentinel
    order = FORMS.get(form)
    if order is None or len(cuts) != len(order):
        return None
    return PieceTable(output, cuts).arranged(inverse(order)[: SUFFIX + 1])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: groups of eight digits of SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def _texts(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each text, over the batch's own buffer."""
    for value in column:
        yield memoryview(value.as_buffer())


def _infilled(
    docs: DataFrame, text: str, doc_id: str, seed: int, plain_from: int, spm_below: int, carry: Sequence[str],
    told: dict[str, pa.DataType], tell: Callable[[PieceTable, str], tuple],
) -> DataFrame:
    """The lengths and form of each text, and what `tell` says of its arranged descriptors."""
    rows = numbered(docs, text, [*dict.fromkeys([doc_id, *carry])])
    lengths = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
    columns = lengths | told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = zip(*(batch.column(i).to_pylist() for i in range(2, 6)))
            found: list[tuple] = []
            for data, (h1, h2, h3, h4) in zip(_texts(batch.column(0)), numbers):
                units = Units(data)
                form = form_of(data, units.n, h3, h4, plain_from, spm_below)
                before = middle = None
                made = PieceTable.of(data)
                if form != PLAIN:
                    cuts, before, middle = cut(data, units, h1, h2)
                    made = cuts.arranged(FORMS[form])
                found.append((units.n, form, before, middle, *tell(made, form)))
            arrays = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column(1), *arrays], ["doc", *columns])

    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join([f"doc {rows.schema['doc'].dataType.simpleString()}", *(f"{c} {names[k]}" for c, k in columns.items())])
    given = rows.select("text", "doc", *draws(F.col("doc").getField(doc_id), seed))
    return mapped(given, run, schema).select(*carried(carry), *columns)


def rearrange(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 1, plain_from: int = 90,
    spm_below: int = 20, carry: Sequence[str] = (),
) -> DataFrame:
    """Columns of `carry`, and n, form, prefix_chars, middle_chars, output: each text cut at two
    places and rearranged for filling in the middle.

    The places and the form follow from the seed and the row's id, so a row gives the same on every
    run, and repeated rows are alike; a null id counts as empty text. Null and empty texts, texts
    that hold a sentinel, and a share of all texts stay as they are: form plain, no lengths. A cut
    may fall on either end, or both on one place (ties), which leaves parts empty. Whole texts of
    any length; no rows give no rows."""
    made = _infilled(
        docs, text, doc_id, seed, plain_from, spm_below, carry,
        {"output": pa.binary()}, lambda pieces, form: (pieces.bytes(),),
    )
    return made.withColumn("output", F.col("output").cast("string"))


def restore(docs: DataFrame, output: str = "output", form: str = "form", carry: Sequence[str] = ()) -> DataFrame:
    """Columns of `carry` and restored: the exact text of each output. A null output gives the empty
    text, a null form counts as plain, and an output that is not of its form gives null."""
    rows = numbered(docs, output, [*dict.fromkeys([form, *carry])])
    given = rows.select("text", "doc", F.coalesce(F.col("doc").getField(form), F.lit(PLAIN)).alias("form"))

    def text_of(data, form: str) -> bytes | None:
        pieces = restored(data, form)
        return pieces and pieces.bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(*row) for row in zip(_texts(batch.column(0)), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.binary())], ["doc", "restored"])

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, restored binary"
    return mapped(given, run, schema).select(*carried(carry), F.col("restored").cast("string").alias("restored"))


def digests(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 1, plain_from: int = 90,
    spm_below: int = 20, carry: Sequence[str] = (),
) -> DataFrame:
    """As `rearrange`, with hashes in place of the output: output_sha256 streamed over the arranged
    descriptors, restored_sha256 over those that `restored` finds in the output's bytes alone."""
    return _infilled(
        docs, text, doc_id, seed, plain_from, spm_below, carry,
        {"output_sha256": pa.string(), "restored_sha256": pa.string()},
        lambda pieces, form: (pieces.sha256(), restored(pieces.bytes(), form).sha256()),
    )


def op11_piece_table_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), carry=["doc_id"])


OP11_SQL = """
with drawn as (
    select doc_id, coalesce(text, '') as body, length(coalesce(text, '')) as n,
        sha256('1:' || coalesce(doc_id::varchar, '')) as h
    from documents
), placed as (
    select *,
        least(('0x' || substr(h, 1, 8))::bigint % (n + 1), ('0x' || substr(h, 9, 8))::bigint % (n + 1)) as a,
        greatest(('0x' || substr(h, 1, 8))::bigint % (n + 1), ('0x' || substr(h, 9, 8))::bigint % (n + 1)) as b,
        case
            when n = 0 or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>')
                or ('0x' || substr(h, 17, 8))::bigint % 100 >= 90 then 'plain'
            when ('0x' || substr(h, 25, 8))::bigint % 100 < 20 then 'spm'
            else 'psm'
        end as form
    from drawn
)
select doc_id, n::bigint as n, form,
    case when form <> 'plain' then a::bigint end as prefix_chars,
    case when form <> 'plain' then (b - a)::bigint end as middle_chars,
    sha256(case form
        when 'plain' then body
        when 'psm' then '<P>' || substr(body, 1, a) || '<S>' || substr(body, b + 1) || '<M>' || substr(body, a + 1, b - a)
        else '<S>' || substr(body, b + 1) || '<P>' || substr(body, 1, a) || '<M>' || substr(body, a + 1, b - a)
    end) as output_sha256,
    sha256(body) as restored_sha256
from placed
"""
