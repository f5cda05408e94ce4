"""How many spectra a scorer can take at once: a memory model as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes set aside, share of the rest that is used, reserves for encoder activations and for each item.
SET_ASIDE, USED, ENCODER_RESERVE, ITEM_RESERVE = 1.5 * 1024**3, 0.95, 1.5, 1.15


@dataclass(frozen=True)
class Shape:
    """Sizes of a scorer; the defaults are a small one."""

    encoder_hidden: int = 512
    encoder_feed: int = 1024
    encoder_heads: int = 8
    decoder_hidden: int = 512
    decoder_feed: int = 1024
    decoder_layers: int = 9


def item_bytes(beams: Column, shape: Shape, vocabulary: int = 29, length: int = 100, peaks: int = 300, width: int = 2) -> Column:
    """Bytes of one spectrum: encoder states, caches of both directions, activations and the buffers of a beam search (none for greedy, beams = 0)."""
    lanes, searched = F.greatest(beams, F.lit(1)).cast("double"), F.when(beams >= 1, 1.0).otherwise(0.0)
    cache = 4 * length * shape.decoder_layers * shape.decoder_hidden * width * (1 + searched)
    lane = peaks * shape.encoder_hidden * width + cache + shape.decoder_feed * width
    encoder = ENCODER_RESERVE * (4 * shape.encoder_heads * (peaks + 1) ** 2 + (peaks + 1) * shape.encoder_feed * width)
    steps = length + 2
    history = 8 * steps + 4 * steps * vocabulary + 4 + 8 * steps * steps + 4 * steps + 4
    return lanes * (lane + 2 * searched * history) + F.lit(float(encoder))


def batch_size(memory: Column, beams: Column, shape: Shape | None = None, **sizes: int) -> Column:
    """Items that fit into memory bytes, a multiple of 8, or 1 where not even that fits."""
    usable = F.greatest(memory - F.lit(SET_ASIDE), F.lit(0.0)) * USED
    fit = F.floor(usable / (item_bytes(beams, shape or Shape(), **sizes) * ITEM_RESERVE))
    return F.greatest(F.floor(fit / 8) * 8, F.lit(1).cast("long"))
