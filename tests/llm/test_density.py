import random

import numpy as np
import pytest

from lantern.llm import common, packing


def twin(lengths, capacity, open_bins):
    """The same rule with lists: windows longest first, the fullest bin that fits, the fullest closes."""
    bins, out, next_ = [], [None] * len(lengths), 0  # (free, arrival, number) of open bins
    tick = 0
    for a in range(0, len(lengths), open_bins):
        window = range(a, min(len(lengths), a + open_bins))
        for k in sorted(window, key=lambda k: -lengths[k]):
            n, tick = lengths[k], tick + 1
            fits = [b for b in bins if b[0] >= n]
            if fits:
                room = min(b[0] for b in fits)
                chosen = max((b for b in fits if b[0] == room), key=lambda b: b[1])  # the youngest of equals
                bins.remove(chosen)
                number = chosen[2]
            else:
                room, number, next_ = capacity, next_, next_ + 1
                if n < capacity and len(bins) == open_bins:
                    least = min(b[0] for b in bins)
                    bins.remove(max((b for b in bins if b[0] == least), key=lambda b: b[1]))
            if room > n:
                bins.append((room - n, tick, number))
            out[k] = number, capacity - room
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packer_equals_its_plain_twin(seed):
    r = random.Random(seed)
    lengths = [min(64, 1 + int(r.expovariate(1 / r.choice([5, 20, 60])))) for _ in range(700)]
    for open_bins in (1, 3, 16, 1024):
        packer, got = packing.Packer(64, open_bins), []
        for a in range(0, len(lengths), open_bins):
            got += packer.place_all(lengths[a : a + open_bins])
        assert got == twin(lengths, 64, open_bins)


def sizes(n, seed=1):
    """Lengths as those of texts: many of a few hundred tokens, some whole sequences."""
    r = np.random.default_rng(seed)
    x = np.minimum(2048, 1 + r.lognormal(6.0, 0.9, n)).astype(int)
    x[r.random(n) < 0.05] = 2048
    return x


@pytest.mark.parametrize("n", [300_000, 1_000_000])
def test_density_holds_at_scale(n):
    lengths = sizes(n)
    packer = packing.Packer(packing.MAX_TOKENS, packing.OPEN_BINS)
    for a in range(0, n, packing.OPEN_BINS):
        packer.place_all(lengths[a : a + packing.OPEN_BINS].tolist())
    assert packer.next <= 1.003 * lengths.sum() / packing.MAX_TOKENS


def test_density_of_a_table_in_several_tasks(spark):
    lengths = np.sort(sizes(120_000))[::-1]  # whatever the order of the table
    rows = spark.createDataFrame([(k, 0, 0, int(n), k * 2654435761 % (1 << 32)) for k, n in enumerate(lengths)], packing.PIECES)
    got = packing.pack(common.written(rows, "t"), pieces_per_task=50_000)
    held = got.groupBy("sequence_id").agg({"length": "sum"}).toPandas()
    assert held["sum(length)"].sum() == lengths.sum() and held["sum(length)"].max() <= packing.MAX_TOKENS
    assert len(held) <= 1.01 * lengths.sum() / packing.MAX_TOKENS


def test_windows_cut_batches_anew():
    import pyarrow as pa

    batches = [pa.record_batch({"x": pa.array(range(a, b), pa.int64())}) for a, b in ((0, 3), (3, 3), (3, 11), (11, 12))]
    got = [w["x"].to_pylist() for w in packing._windows(iter(batches), 5)]
    assert got == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11]] and not list(packing._windows(iter([]), 5))
