"""Spectral evidence of segments of any length: a segment comes in pieces, is cut into blocks that overlap, and what is measured of
it are sums over blocks. No row and no task holds a segment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.functions.ordering import running_sum
from tracegrain.functions.store import exact_percentiles, stored

from . import spectral

SAMPLES = 1 << 16


def sample_blocks(pieces: DataFrame, keys: list[str], size: int = SAMPLES) -> DataFrame:
    """``keys``, block, from, x, n, fs: the samples of each block of ``size`` of a segment and as many of the next as frames and lags
    reach over (two seconds, 256 samples at least), ``from`` the place of the first of them.

    ``pieces``: keys, ordinal, values (a packet's samples, few), fs. Ordinals count up along a segment.
    """
    placed = stored(running_sum(pieces.where(F.size("values") > 0), keys, "ordinal", F.size("values"), "at", inclusive=False), "pieces")
    whole = placed.groupBy(*keys).agg(F.sum(F.size("values")).alias("n"), F.first("fs").alias("fs"))
    over = F.greatest(F.lit(256), F.ceil(F.col("fs") / spectral.LOW_HZ) + 2)
    first = F.greatest(F.lit(0), F.floor((F.col("at") - over) / size))
    dealt = placed.select(*keys, "at", "values", F.explode(F.sequence(first, F.floor((F.col("at") + F.size("values") - 1) / size))).alias("block"))
    rows = dealt.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("at", "values"))).alias("v"))
    return rows.select(*keys, "block", F.col("v")[0]["at"].alias("from"), F.flatten(F.transform("v", lambda s: s["values"])).alias("x")).join(whole, keys)


def _spread(blocks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, mid, spread: a segment's median and the median distance from it, exact."""
    own = F.slice("x", (F.col("block") * size - F.col("from") + 1).cast("int"), F.lit(size))
    samples = blocks.select(*keys, F.explode(own).alias("x"))
    mid = stored(exact_percentiles(samples, keys, "x", {"mid": 0.5}), "mids")
    off = samples.join(mid, keys).select(*keys, F.abs(F.col("x") - F.col("mid")).alias("d"))
    return stored(mid.join(exact_percentiles(off, keys, "d", {"spread": 0.5}), keys), "spreads")


def _lags(n: int, fs: float) -> tuple[int, int]:
    first = max(1, int(fs / spectral.HIGH_HZ))
    return first, min(n - 1, max(first + 1, int(fs / spectral.LOW_HZ)))


def _sums(blocks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, kind, pos, v: over all blocks, the sums of the frames' power at each frequency (kind 0), and of products of samples
    that lie ``pos`` apart (kind 1). ``blocks`` have mid and spread too. A block's numbers are handed on before the next one is
    looked at, so that a worker holds one block's beside a batch, however many blocks a batch has."""
    kinds = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)

    def measure(batches):
        for batch in batches:
            lists = batch.column("x")
            flat, at_row = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            for i, (block, at, n, fs, mid, spread) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "from", "n", "fs", "mid", "spread")), strict=True)):
                if n < spectral.LEAST_SAMPLES or not fs > 0:
                    continue
                c = (flat[at_row[i] : at_row[i + 1]] - mid) / (1.0 if spread < spectral.FLAT else 1.4826 * spread)
                begin, end = block * size, min(n, (block + 1) * size)
                frame = spectral.frame_length(n, 256)
                hop = frame - frame // 2
                starts = np.arange(-(-begin // hop) * hop, min(end, n - frame + 1), hop) - at
                parts = []
                if len(starts):
                    z, _ = spectral.spectra_of(np.lib.stride_tricks.sliding_window_view(c, frame)[starts][None])
                    parts.append((0, (np.abs(z[0]) ** 2).sum(axis=0)))
                own, reach = c[begin - at : end - at], _lags(n, fs)[1]
                ahead = c[begin - at :]
                parts.append((1, np.array([own[: max(0, len(ahead) - k)] @ ahead[k : k + len(own)] for k in range(reach + 1)])))
                for what, found in parts:
                    of = pa.array(np.full(len(found), i, np.int32))
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(of) for k in range(len(keys))], pa.array(np.full(len(found), what, np.int32)), pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], names=[*keys, "kind", "pos", "v"])

    rows = blocks.select(*keys, "block", "from", "x", "n", "fs", "mid", "spread")
    return rows.mapInArrow(measure, f"{kinds}, kind int, pos int, v double").groupBy(*keys, "kind", "pos").agg(F.sum("v").alias("v"))


def block_facts(pieces: DataFrame, keys: list[str], size: int = SAMPLES) -> DataFrame:
    """``keys``, fs, n and the facts that ``spectral.measure_segments`` tells of whole segments, equal to these up to the order of
    sums; null under LEAST_SAMPLES samples. ``pieces`` as for ``sample_blocks``; an empty table gives no rows.

    Most segments are one block, all of whose samples are there: these go through the kernel as they are. Only what is known of the
    blocks of longer ones becomes rows, to be summed up.
    """
    every = stored(sample_blocks(pieces, keys, size), "sample-blocks")
    whole = spectral.measured(every.where(F.col("n") <= size).select(*keys, "fs", F.col("x").alias("values")), ["values"], spectral.measure_segments, spectral.SEGMENT_FACTS, spectral.LEAST_SAMPLES)
    many = _many_block_facts(every.where(F.col("n") > size), keys, size)
    return many.unionByName(whole.select(many.columns))


def _many_block_facts(blocks: DataFrame, keys: list[str], size: int) -> DataFrame:
    spread = _spread(blocks, keys, size)
    sums = _sums(blocks.join(spread, keys), keys, size)
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "v")))), lambda s: s["v"])
    whole = sums.groupBy(*keys).agg(of(0).alias("power_sums"), of(1).alias("products"))  # a few hundred numbers a segment
    named = blocks.where("block = 0").select(*keys, "n", "fs").join(spread, keys).join(whole, keys, "left")
    facts = [f for f in spectral.SEGMENT_FACTS if f != "spread"]
    kinds = ", ".join(f"`{k}` {named.schema[k].dataType.simpleString()}" for k in keys)

    def tell(batches):
        for batch in batches:
            found = {f: [] for f in facts}
            for n, fs, power, products in zip(*(batch.column(c).to_pylist() for c in ("n", "fs", "power_sums", "products")), strict=True):
                told = _told(n, fs, np.array(power), np.array(products)) if power else {}
                for f in facts:
                    found[f].append(told.get(f, np.nan))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "fs")), batch.column("n").cast(pa.int32()), batch.column("spread"), *(pa.array(v, pa.float64(), mask=np.isnan(v)) for v in (np.array(found[f], float) for f in facts))], names=[*keys, "fs", "n", "spread", *facts])

    return named.mapInArrow(tell, f"{kinds}, fs double, n int, spread double, {', '.join(f'{f} double' for f in facts)}")


def _told(n: int, fs: float, power: np.ndarray, products: np.ndarray) -> dict[str, float]:
    frame = spectral.frame_length(n, 256)
    frames = (n - frame) // (frame - frame // 2) + 1
    p = power / frames / (fs * spectral.window_energy(frame))
    p[1 : None if frame % 2 else -1] *= 2
    first, last = _lags(n, fs)
    acf = products / (products[0] or 1.0)
    lag = first + int(np.argmax(acf[first : last + 1])) if last > first else None
    facts = spectral.band_facts(np.fft.rfftfreq(frame)[None] * fs, p[None])
    return {k: float(v[0]) for k, v in facts.items()} | {"acf_lag": np.nan if lag is None else lag, "acf_height": np.nan if lag is None else acf[lag]}


def periodicity(pieces: DataFrame, keys: list[str], size: int = SAMPLES) -> DataFrame:
    """``spectral.segment_periodicity`` of segments in pieces."""
    return spectral.told_periodicity(block_facts(pieces, keys, size), keys)
