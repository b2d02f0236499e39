"""SimHash near-duplicates by the general pigeonhole principle.

A document's 64-bit fingerprint takes the majority of each bit over the XXH64
hashes of its word shingles. Fingerprints within ``distance`` bits are linked,
found so (Qin et al., GPH, 2018): correlated bits are grouped into partitions;
for each probing fingerprint a dynamic programme gives every partition a
threshold of its own, from -1 (skip it) upwards, such that thresholds plus one
sum to ``distance`` + 1 and the estimated candidates are fewest; any fingerprint
in range then lies within the threshold of some partition, so probing the values
in those balls and verifying misses none. A partition value shared by many rows
is expensive, so probes go elsewhere; no bucket is capped.

Cases: a null text is empty; texts without words have fingerprint zero and link
like others; fewer words than a shingle hash as one; repeated rows and equal
fingerprints share one node; null identifiers sort last; of rows that repeat a
component's smallest identifier ``keep_one`` keeps the one whose text hashes lowest,
with rows that repeat its text too; an empty table gives an empty result; other
columns may have any names. Only the identifier and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import drop_written, slices, text_or_empty, tidy, written
from crestline.llm.components import connected_components
from crestline.llm.ownership import owned, row_hash, without_rows

SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z, and the ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    n, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)], np.uint64)
        counts += _bits(hashes).sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        counts += _bits(hashes[at : at + _CHUNK]).sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _bits(values: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each value, bit 0 first."""
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, row (a hash of the text) and fp (a signed long of the same bits) of every row."""

    def run(batches):
        for batch in slices(batches):
            values = np.array([fingerprint(x, width) for x in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(values)], ["doc_id", "row", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text_col).alias("row"), text_or_empty(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(tidy(run), "doc_id long, row long, fp long")


def _column(batch: pa.RecordBatch, i: int = 0) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _counted(fps: DataFrame, run, schema: str, keys: list[str]) -> list:
    """Sum partial counts from every task; the result's size is fixed by its keys."""
    return fps.mapInArrow(tidy(run), f"{schema}, n long").groupBy(*keys).agg(F.sum("n").alias("n")).collect()


def group_bits(fps: DataFrame, widths: list[int]) -> np.ndarray:
    """An order of the 64 bits in which each run of ``widths`` holds bits that go together.

    From the 64 x 64 counts of bits set together over all fingerprints: a group
    starts at the bit with the strongest remaining link and takes the bit most
    correlated with its members until it is full.
    """

    def run(batches):
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                bits = _bits(_column(batch)[at : at + _CHUNK]).astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
        i, j = np.indices((64, 64))
        yield pa.record_batch([pa.array(x.ravel().astype(t)) for x, t in ((i, "int32"), (j, "int32"), (total, "int64"))], ["i", "j", "n"])

    both = np.zeros((64, 64))
    for r in _counted(fps, run, "i int, j int", ["i", "j"]):
        both[r.i, r.j] = r.n
    n = max(1.0, float(fps.count()))
    mean = np.diag(both) / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tied = np.abs((both / n - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    left, order = set(range(64)), []
    for width in widths:
        group = [max(sorted(left), key=lambda b: max((tied[b, x] for x in left), default=0))]
        left.discard(group[0])
        while len(group) < width:
            best = max(sorted(left), key=lambda b: tied[b, group].sum())
            group.append(best)
            left.discard(best)
        order += group
    return np.array(order)


def _blocks(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Eight bytes for each value: its bits in ``order``."""
    return np.packbits(_bits(values)[:, order], axis=1, bitorder="little")


def block_counts(fps: DataFrame, order: np.ndarray) -> np.ndarray:
    """How many fingerprints have each value of each 8-bit block, 8 x 256."""

    def run(batches):
        total = np.zeros((8, 256), np.int64)
        for batch in batches:
            blocks = _blocks(_column(batch), order)
            for b in range(8):
                total[b] += np.bincount(blocks[:, b], minlength=256)
        b, v = np.indices((8, 256))
        yield pa.record_batch([pa.array(x.ravel().astype(t)) for x, t in ((b, "int32"), (v, "int32"), (total, "int64"))], ["b", "v", "n"])

    out = np.zeros((8, 256))
    for r in _counted(fps, run, "b int, v int", ["b", "v"]):
        out[r.b, r.v] = r.n
    return out


def allocate(near: np.ndarray, rows: float, parts: list[list[int]], distance: int, probe_cost: float = 2.0) -> np.ndarray:
    """The threshold of each partition for each query, n x partitions.

    ``near``: n x 8 x (distance + 1), the share of fingerprints whose block lies
    at that distance from the query's. Blocks of a partition are taken as
    independent for the estimate; thresholds only steer the work, never the result.
    """
    n, budget = len(near), distance + 1
    best = np.full((n, budget + 1), np.inf)
    best[:, 0] = 0
    picks = np.zeros((len(parts), n, budget + 1), np.int64)
    for p, blocks in enumerate(parts):
        at = near[:, blocks[0]]
        for b in blocks[1:]:
            at = np.stack([sum(at[:, i] * near[:, b, r - i] for i in range(r + 1)) for r in range(distance + 1)], axis=1)
        within = np.cumsum(at, axis=1) * rows
        cost = [np.zeros(n)] + [within[:, t] + probe_cost * _ball_size(8 * len(blocks), t) for t in range(budget)]
        new = np.full_like(best, np.inf)
        for total in range(budget + 1):
            for units in range(total + 1):
                tried = best[:, total - units] + cost[units]
                better = tried < new[:, total]
                new[better, total] = tried[better]
                picks[p, better, total] = units
        best = new
    out, left = np.zeros((n, len(parts)), np.int64), np.full(n, budget)
    for p in reversed(range(len(parts))):
        units = picks[p, np.arange(n), left]
        out[:, p] = units - 1
        left -= units
    return out


def _ball_size(width: int, radius: int) -> int:
    total = term = 1
    for i in range(radius):
        term = term * (width - i) // (i + 1)
        total += term
    return total


def _ball(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``radius`` bits set."""
    found = [0]
    level = [0]
    for _ in range(radius):
        level = [x | 1 << b for x in level for b in range(x.bit_length(), width)]
        found += level
    return np.array(found, np.int64)


def _partition_values(blocks: np.ndarray, part: list[int]) -> np.ndarray:
    value = np.zeros(len(blocks), np.int64)
    for k, b in enumerate(part):
        value |= blocks[:, b].astype(np.int64) << (8 * k)
    return value


def partitions_for(rows: int) -> list[list[int]]:
    """Blocks of each partition: wider ones for more fingerprints, so that buckets stay small."""
    sizes = [2, 2, 2, 2] if rows < 1 << 21 else [3, 3, 2] if rows < 1 << 30 else [4, 4]
    starts = np.cumsum([0, *sizes])
    return [list(range(a, a + s)) for a, s in zip(starts, sizes, strict=False)]


def near_links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct ``fps.fp`` that differ in at most ``distance`` bits.

    ``fps`` should be a written table with one row per fingerprint: it is read
    for the bit correlations, the block counts, the index and the probes.
    """
    rows = fps.count()
    parts = partitions_for(rows)
    order = group_bits(fps, [8 * len(p) for p in parts])
    counts = block_counts(fps, order)
    apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
    share = np.stack([np.stack([(apart == r) @ counts[b] for r in range(distance + 1)], axis=1) for b in range(8)]) / max(1, rows)

    def batch_of(part, value, fp) -> pa.RecordBatch:
        return pa.record_batch([pa.array(part, pa.int32()), pa.array(value, pa.int64()), pa.array(fp, pa.int64())], ["part", "value", "fp"])

    def index(batches):
        for batch in batches:
            blocks, fp = _blocks(_column(batch), order), _column(batch).view(np.int64)
            for p, part in enumerate(parts):
                yield batch_of(np.full(len(fp), p, np.int32), _partition_values(blocks, part), fp)

    def probe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                values = _column(batch)[at : at + 2000]
                blocks, fp = _blocks(values, order), values.view(np.int64)
                thresholds = allocate(np.stack([share[b][blocks[:, b]] for b in range(8)], axis=1), rows, parts, distance)
                for p, part in enumerate(parts):
                    value = _partition_values(blocks, part)
                    for t in range(distance + 1):
                        if (chosen := thresholds[:, p] == t).any():
                            ball = _ball(8 * len(part), t)
                            yield batch_of(np.full(chosen.sum() * len(ball), p, np.int32), (value[chosen][:, None] ^ ball[None, :]).ravel(), np.repeat(fp[chosen], len(ball)))

    schema = "part int, value long, fp long"
    only = fps.select("fp")
    probes = only.mapInArrow(tidy(probe), schema).withColumnRenamed("fp", "a")
    indexed = only.mapInArrow(tidy(index), schema).withColumnRenamed("fp", "b")
    # both ends of a pair probe, so one of the two findings is enough
    verified = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return probes.join(indexed, ["part", "value"]).where(verified).select("a", "b").distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, row, fp, component_id (the smallest identifier reachable) and stays of every row."""
    rows = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(rows.select("fp").distinct(), "nodes")
    roots = connected_components(near_links(nodes, distance), "a", "b")
    drop_written(nodes)
    return owned(rows.withColumnRenamed("fp", "node"), roots).withColumnRenamed("node", "fp")


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return near_components(docs, id_col, text_col, width, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs``, with all columns, that own a component."""
    return without_rows(docs, near_components(docs, id_col, text_col, width, distance), id_col, text_col)
