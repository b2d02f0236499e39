"""Exact deduplication by Patricia tries that own the distinct texts.

Partitions are dealt by length and content hash; in each, whole byte strings go
into a compressed radix trie whose terminal nodes hold the smallest identifier,
the number of rows that have it, and the number of all rows. A task first folds
its own rows into such a trie, so a group of copies sends one string from each
task, however large it is.

Cases: a null text counts as empty; empty texts are copies of one another; rows
with a null identifier belong to their group, but stay (``kept``) only if no row
of it has one; of rows that repeat the smallest identifier with an equal text one
stays; an empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import SPACE, filesystem, scratch, text_or_empty, tidy, unused, written

_HEAD = struct.Struct("<?qqqI")
#: What a node takes besides its label, in bytes, by measurement.
_NODE = 200


class _Node:
    __slots__ = ("children", "count", "label", "smallest", "ties")

    def __init__(self, label: bytes):
        self.label, self.children, self.count, self.smallest, self.ties = label, {}, 0, None, 0


def _shared(label: bytes, key: bytes, at: int) -> int:
    """How many leading bytes of ``label`` equal ``key[at:]``."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _least(a: tuple[int | None, int], b: tuple[int | None, int]) -> tuple[int | None, int]:
    """The smaller identifier and how many rows have it; null is the largest."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1]
    return a if b[0] is None or a[0] is not None and a[0] < b[0] else b


class RadixTrie:
    """Distinct byte strings with the smallest identifier and count of each."""

    def __init__(self):
        self.root, self.bytes = _Node(b""), 0

    def add(self, key: bytes, smallest: int | None, ties: int = 1, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = _Node(key[at:])
                self.bytes += len(child.label) + _NODE
                node = child
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = _shared(child.label, key, at)
            fork = node.children[key[at]] = _Node(child.label[:n])
            fork.children[child.label[n]] = child
            child.label = child.label[n:]
            self.bytes += _NODE
            node, at = fork, at + n
        node.smallest, node.ties = (smallest, ties) if not node.count else _least((node.smallest, node.ties), (smallest, ties))
        node.count += count

    def items(self, top: int | None = None) -> Iterator[tuple[bytes, int | None, int, int]]:
        """All strings, or those below one branch of the root."""
        stack = [(b"", self.root)] if top is None else [(b"", self.root.children[top])]
        while stack:
            prefix, node = stack.pop()
            key = prefix + node.label
            if node.count:
                yield key, node.smallest, node.ties, node.count
            stack.extend((key, x) for x in node.children.values())

    def cut(self, top: int) -> None:
        """Drop one branch of the root."""
        stack = [self.root.children.pop(top)]
        while stack:
            node = stack.pop()
            self.bytes -= len(node.label) + _NODE
            stack.extend(node.children.values())

    def weights(self) -> dict[int, int]:
        """Bytes below each branch of the root."""
        out = {}
        for top, child in self.root.children.items():
            stack, total = [child], 0
            while stack:
                node = stack.pop()
                total += len(node.label) + _NODE
                stack.extend(node.children.values())
            out[top] = total
        return out


class _Spill:
    """A branch's strings in a file of the shared folder, until their turn comes."""

    def __init__(self, folder: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.path)

    def put(self, key: bytes, smallest: int | None, ties: int, count: int) -> None:
        self.out.write(_HEAD.pack(smallest is None, smallest or 0, ties, count, len(key)) + key)

    def items(self) -> Iterator[tuple[bytes, int | None, int, int]]:
        self.out.close()
        with self.fs.open_input_stream(self.path, buffer_size=1 << 20) as got:
            while head := got.read(_HEAD.size):
                none, smallest, ties, count, n = _HEAD.unpack(head)
                yield got.read(n), None if none else smallest, ties, count

    def drop(self) -> None:
        self.fs.delete_file(self.path)


def owners_of(rows: Iterator[tuple[bytes, int | None, int, int]], most: int, folder: str) -> Iterator[tuple[bytes, int | None, int, int]]:
    """Fold ``rows`` (string, smallest, ties, count) into one per distinct string within about ``most`` bytes.

    When the trie outgrows that, its heaviest branch goes to a spill file, and so
    do later strings of the branch; each file is then folded by itself, branching
    at the first byte at which its strings differ.
    """
    trie, spilled, skip = RadixTrie(), {}, None
    pending = [(rows, b"")]
    while pending:
        source, skip = pending.pop()
        trie, spilled = RadixTrie(), {}
        source_rows = source.items() if isinstance(source, _Spill) else source
        for key, *value in source_rows:
            rest = key[len(skip) :]
            if rest and (file := spilled.get(rest[0])):
                file.put(key, *value)
                continue
            trie.add(rest, *value)
            while trie.bytes > most and trie.root.children:
                weights = trie.weights()
                top = max(weights, key=weights.get)
                spilled[top] = file = _Spill(folder)
                for x, *value in trie.items(top):
                    file.put(skip + x, *value)
                trie.cut(top)
        for x, *value in trie.items():
            yield (skip + x, *value)
        if isinstance(source, _Spill):
            source.drop()
        for file in spilled.values():
            common = None
            for key, *_ in file.items():
                common = key if common is None else common[: _shared(common, key, 0)]
            pending.append((file, common))


def _combine(most: int):
    """Fold a task's rows, giving up what it holds whenever that exceeds ``most`` bytes."""

    def run(batches):
        trie = RadixTrie()
        for batch in batches:
            for key, smallest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                trie.add(key, smallest)
                if trie.bytes > most:
                    yield from _rows(trie.items())
                    trie = RadixTrie()
        yield from _rows(trie.items())

    return run


def _rows(items, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``most`` bytes of strings."""
    held, size = [], 0
    for x in items:
        held.append(x)
        size += len(x[0]) + 32
        if size > most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held) -> pa.RecordBatch:
    keys, *numbers = zip(*held, strict=True)
    return pa.record_batch([pa.array(keys, pa.binary()), *(pa.array(x, pa.int64()) for x in numbers)], ["key", "smallest", "ties", "count"])


def _reduce(most: int, folder: str):
    def run(batches):
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        held = []
        for key, *value in owners_of(rows, most, folder):
            held.append((hashlib.sha256(key).hexdigest(), len(key), *value))
            if len(held) == 10_000:
                yield _owners(held)
                held = []
        if held:
            yield _owners(held)

    return run


_OWNERS = "text_sha256 string, n_bytes long, keep_id long, ties long, group_size long"


def _owners(held) -> pa.RecordBatch:
    digests, *numbers = zip(*held, strict=True)
    return pa.record_batch([pa.array(digests, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], [x.split()[0] for x in _OWNERS.split(", ")])


def normalised(text_col: str) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", combine_bytes: int = 32 << 20, trie_bytes: int = 96 << 20) -> DataFrame:
    """One row per distinct text: text_sha256, n_bytes, keep_id, ties (rows with that identifier), group_size.

    ``combine_bytes`` and ``trie_bytes`` bound a task's memory before and after
    the shuffle; beyond them rows are passed on early, or branches spilled.
    """
    spark = docs.sparkSession
    texts = docs.select(normalised(text_col).cast("binary").alias("key"), F.col(id_col).cast("long").alias("smallest"))
    combined = texts.mapInArrow(tidy(_combine(combine_bytes)), "key binary, smallest long, ties long, count long")
    dealt = combined.repartition(F.length("key"), F.xxhash64("key"))
    return dealt.mapInArrow(tidy(_reduce(trie_bytes, scratch(spark, "spill"))), _OWNERS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """Every row's owner: doc_id, keep_id, group_size, kept, text_sha256.

    Rows find their owner by SHA-256 and length of the normalised text; which
    texts are equal was decided on whole byte strings, in the tries. Rows with the
    owner's own identifier come from the tries, which counted them: one that is
    kept, and any others.
    """
    norm = normalised(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(norm, 256).alias("text_sha256"), F.length(norm).cast("long").alias("n_bytes"))
    found = written(owners(docs, id_col, text_col, **bounds), "owners")
    gone = rows.join(found, ["text_sha256", "n_bytes"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    own = found.select("*", F.col("keep_id").alias("doc_id"), F.explode(F.sequence(F.lit(1).cast("long"), "ties")).alias("tie")).withColumn("kept", F.col("tie") == 1)
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return own.select(*names).unionByName(gone.select(*names))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all their columns.

    If rows tie, with the smallest identifier and equal texts, the one whose other
    columns hash lowest stays.
    """
    sha, n, keep = (unused(x, docs) for x in ("text_sha256", "n_bytes", "keep_id"))
    found = written(owners(docs, id_col, text_col, **bounds).toDF(sha, n, keep, "ties", "group_size"), "owners")
    norm = normalised(text_col).cast("binary")
    same = (F.sha2(norm, 256) == F.col(sha)) & (F.length(norm) == F.col(n)) & F.col(id_col).cast("long").eqNullSafe(F.col(keep))
    alone = docs.join(found.where("ties = 1").select(sha, n, keep), same, "left_semi")
    tied = found.where("ties > 1").select(sha, n, keep)
    if tied.isEmpty():
        return alone
    comparable = [x for x, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = docs.join(tied, same).groupBy(sha, n).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*comparable)).alias("row"))
    return alone.unionByName(one.select("row.*"))


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
