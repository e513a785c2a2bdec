"""Token sequences: truncation, prompt masking and padded batches, as array expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the label of positions that do not count.
IGNORED = -100


def truncate_tokens(ids: Column, max_length: int = 8192) -> Column:
    return F.slice(ids, 1, max_length)


def find_prompt_len(ids: Column, marker: list[int]) -> Column:
    """End of the last occurrence of the marker, 0 where there is none."""
    m = len(marker)
    # The sequence beside itself, shifted: a place matches if all its elements do. Nothing but
    # the lambda's own arguments is used inside it, else the ids would be computed per place.
    places = F.greatest(F.size(ids) - (m - 1), F.lit(0))
    beside = F.arrays_zip(*[F.slice(ids, k + 1, places).alias(f"t{k}") for k in range(m)])

    def end(place: Column, i: Column) -> Column:
        same = [place[f"t{k}"] == token for k, token in enumerate(marker)]
        return F.when(reduce(lambda a, b: a & b, same), i + m)

    return F.coalesce(F.array_max(F.transform(beside, end)), F.lit(0))


def mask_labels(ids: Column, prompt_len: Column) -> Column:
    """The ids as labels, the prompt replaced by the ignored label."""
    return F.concat(F.array_repeat(F.lit(IGNORED), prompt_len), F.slice(ids, prompt_len + 1, F.size(ids)))


def prompt_slice(ids: Column, labels: Column) -> Column:
    """The ids at ignored positions: what generation starts from."""
    ignored = F.filter(F.arrays_zip(ids.alias("id"), labels.alias("label")), lambda z: z["label"] == IGNORED)
    return F.transform(ignored, lambda z: z["id"])


def _padded(values: Column, width: Column, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), width - F.size(values)))


def collate_batch(examples: DataFrame, pad_id: int = 0, modality: str | None = None) -> DataFrame:
    """Pad ``ids`` and ``labels`` to the longest of their ``batch_id`` and add the mask.

    A batch has a fixed number of rows, so its window is bounded. ``modality`` names a further
    sequence to pad with 0.
    """
    widest = F.max(F.size("ids")).over(Window.partitionBy("batch_id"))
    width = F.col("_width")
    columns = {
        "attention_mask": _padded(F.transform("ids", lambda _: F.lit(1)), width, 0),
        "labels": _padded(F.col("labels"), width, IGNORED),
        "ids": _padded(F.col("ids"), width, pad_id),
    }
    if modality:
        columns[modality] = _padded(F.col(modality), width, 0)
    return examples.withColumn("_width", widest).withColumns(columns).drop("_width")
