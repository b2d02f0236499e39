"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a text visits, at each position, the pieces that end there by the
automaton's output links, the longest first, and relaxes the best segmentation up
to that position from the best ones before.

In a unigram model the best has the highest sum of scores (Viterbi). A BPE
model's scores are merge ranks, not log-probabilities: their best sum is not what
the model encodes to. There the same pass relaxes by rank: the last piece at a
position is the one before which the best segmentation so far stays as it is
when both are merged by rank, which is unique, so the result equals the merges of
the whole text in linear time.

Words recur, so segmentations are kept by chunk: the text is cut before white
space marks that no piece holds after another character, and at line breaks if no
piece holds any. The memory of a task is bounded in bytes: a full store is emptied,
and long chunks aren't kept.

A model's table of normalised characters is applied as its library does, the
longest match first. Models with user-defined pieces, and BPE models with unused
ones, are refused with a ValueError before any task starts.

Cases: a null text has null ids, an empty one none; characters without a piece
become byte pieces, or the unknown piece if the model has none, one for a run of
them; decoding reverts encoding but for U+2581, which stands for a space, for
unknowns, and for what a model normalises; rows repeat as they are; an empty table
gives an empty result; other columns may have any names.
"""

from __future__ import annotations

import functools
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import slices, tidy

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


class _Store(dict):
    """Values by key, computed when missing, within about twice ``most`` bytes.

    A full store becomes the old one and a new one begins, so that what recurs
    is carried along and what doesn't goes after two rounds. ``cost`` gives the
    bytes of an entry; those of over a hundredth of ``most`` aren't kept.
    """

    def __init__(self, make, cost, most: int):
        self.make, self.cost, self.most, self.old, self.held = make, cost, most, {}, 0

    def forget(self) -> None:
        self.clear()
        self.old, self.held = {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        cost = self.cost(key, value)
        if cost * 100 <= self.most:
            if self.held + cost > self.most:
                self.old, self.held = dict(self), 0
                self.clear()
            self.held += cost
            self[key] = value
        return value


class CharacterMap:
    """A model's table of normalised characters: a double-array trie over UTF-8 and the strings it leads to."""

    def __init__(self, table: bytes):
        (size,) = struct.unpack_from("<I", table)
        self.units, self.strings = struct.unpack_from(f"<{size // 4}I", table, 4), table[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest entry that the bytes from ``at`` on begin with."""
        units, found = self.units, None
        place = self._offset(units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            unit = units[place]
            if unit & 0x800000FF != data[i]:
                break
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[place] & 0x7FFFFFFF
        return found and (found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])])

    def __call__(self, text: str) -> str:
        data, out, at = text.encode(errors="replace"), [], 0
        while at < len(data):
            if found := self.longest(data, at):
                out.append(found[1])
                at += found[0]
            else:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                out.append(data[at : at + n])
                at += n
        return b"".join(out).decode()


class Automaton:
    """Aho-Corasick: goto, failure and output links over the pieces' characters.

    ``outputs[state]`` is what its output links lead to: (id, length) of all pieces
    that end here, the longest first. Moves along failure links are remembered.
    """

    def __init__(self, ids: dict[str, int], remembered: int = 300_000):
        self.forward: list[dict[str, int]] = [{}]
        self.outputs: list[tuple[tuple[int, int], ...]] = [()]
        self.left = remembered
        for piece, i in ids.items():
            state = 0
            for char in piece:
                if char not in self.forward[state]:
                    self.forward[state][char] = len(self.forward)
                    self.forward.append({})
                    self.outputs.append(())
                state = self.forward[state][char]
            self.outputs[state] = ((i, len(piece)),)
        self.failure = [0] * len(self.forward)
        level = list(self.forward[0].values())
        while level:  # by depth, so that a failure link's own outputs are complete
            deeper = []
            for state in level:
                for char, child in self.forward[state].items():
                    back = self.failure[state]
                    while back and char not in self.forward[back]:
                        back = self.failure[back]
                    self.failure[child] = self.forward[back].get(char, 0)
                    self.outputs[child] += self.outputs[self.failure[child]]
                    deeper.append(child)
            level = deeper

    def step(self, state: int, char: str) -> int:
        """Where a character leads that continues no piece from this state."""
        back = state
        while back and char not in self.forward[back]:
            back = self.failure[back]
        to = self.forward[back].get(char, 0)
        if to and self.left:
            self.left -= 1
            self.forward[state][char] = to
        return to


class Codec:
    """A model's encoder and decoder."""

    def __init__(self, model: bytes, kept_bytes: int = 48 << 20):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        table = proto.normalizer_spec.precompiled_charsmap
        self.mapped = CharacterMap(table) if table else None
        self.bpe = proto.trainer_spec.model_type == _BPE
        if proto.trainer_spec.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.strip = proto.normalizer_spec.remove_extra_whitespaces
        self.ids, self.scores, self.bytes, self.unknown = {}, {}, {}, 0
        self.out: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type in (_NORMAL, _USER):
                self.ids[p.piece] = i
                self.scores[p.piece] = p.score
            elif p.type == _UNKNOWN:
                self.unknown = i
            elif p.type == _BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
            self.out.append(bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else b"" if p.type == _CONTROL else " ⁇ ".encode() if p.type == _UNKNOWN else p.piece.replace(MARK, " ").encode())
        if any(p.type == _USER for p in proto.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        if self.bpe and any(p.type == _UNUSED for p in proto.pieces):
            raise ValueError("BPE models with unused pieces are not supported")
        self.by_id = [p.score for p in proto.pieces]
        self.by_id_single = np.array(self.by_id, np.float32)  # the library adds up in single precision
        self.unknown_score = np.float32(min(self.scores.values(), default=0.0)) - np.float32(10)
        if self.bpe:  # pieces that their own merges don't reach are never the outcome
            split = {p: merges(p, self.scores) for p in self.scores}
            self.scores = {p: v for p, v in self.scores.items() if split[p] is not None}
            self.right = {self.ids[p]: _spine(p, split, self.scores, 1) for p in self.scores}
            self.left = {self.ids[p]: _spine(p, split, self.scores, 0) for p in self.scores}
        self.automaton = Automaton({p: self.ids[p] for p in self.scores})
        self.pieces = [p.piece for p in proto.pieces]
        inner = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        breaks = "" if any("\n" in p for p in self.ids) else "\n"
        self.chunks = re.compile(r"(?s:.+)" if inner else rf"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + ("|\n" if breaks else ""))
        self.single = {p: self.ids[p] for p in self.scores if len(p) == 1}
        self.kept_bytes = kept_bytes
        self._stores()

    def _stores(self) -> None:
        self.fits = _Store(self._fits, lambda key, value: 120, self.kept_bytes)
        self.store = _Store(lambda chunk: array("i", self._ids(chunk)).tobytes(), lambda chunk, ids: 200 + 4 * len(chunk) + len(ids), self.kept_bytes)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("fits", "store")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._stores()

    def _fits(self, key: int) -> bool:
        """Whether two neighbours stay apart when their characters are merged by rank.

        They don't if some part at the first's end and some part at the second's
        start, both there at the same time, join to a piece of better rank than
        what either goes into next. Of merges of equal rank the one on the left is
        first, so parts that were just made at that rank join to the left before the right.
        """
        a, b = key >> 24, key & 0xFFFFFF
        starts = self.left.get(b) or [(self._name(b), np.inf, -np.inf)]
        for x, made, used in self.right.get(a) or [(self._name(a), np.inf, -np.inf)]:
            for y, made_y, used_y in starts:
                score = self.scores.get(x + y)
                if score is not None and used < score <= made and used_y <= score <= made_y:
                    return False
        return True

    def _name(self, i: int) -> str:
        return self.pieces[i] if i < len(self.pieces) else chr(i - len(self.pieces))

    def segment(self, text: str) -> list[int]:
        """The pieces of the best segmentation of a text in which marks stand for spaces.

        A character that is no piece is one for itself, with a number beyond the ids.
        """
        last, size = (self._by_rank if self.bpe else self._by_score)(text)
        out, stop = [], len(text)
        while stop:
            out.append(last[stop])
            stop -= size[stop]
        out.reverse()
        return out

    def _by_rank(self, text: str) -> tuple[list[int], list[int]]:
        """For each position the last piece of the best segmentation up to it, and that piece's length, in a BPE model."""
        forward, outputs, step, fits = self.automaton.forward, self.automaton.outputs, self.automaton.step, self.fits
        last, size, state = [-1], [0], 0
        add_last, add_size = last.append, size.append
        for stop, char in enumerate(text, 1):
            state = forward[state].get(char) or step(state, char)
            for i, n in outputs[state]:
                if stop == n or fits[last[-n] << 24 | i]:  # the n-th last is that of position stop - n
                    break
            else:
                if char in self.single:
                    raise AssertionError(f"no segmentation of {text[:stop]!r}")
                i, n = len(self.pieces) + ord(char), 1
            add_last(i)
            add_size(n)
        return last, size

    def _by_score(self, text: str) -> tuple[list[int], list[int]]:
        """The same in a unigram model, by relaxing the highest sum of scores."""
        forward, outputs, step = self.automaton.forward, self.automaton.outputs, self.automaton.step
        by_id, single, none = self.by_id_single, self.single, len(self.pieces)
        last, size, state, stop = [-1] * (len(text) + 1), [0] * (len(text) + 1), 0, 0
        best = [np.float32(0)] + [np.float32(-np.inf)] * len(text)
        for char in text:
            stop += 1
            state = forward[state].get(char) or step(state, char)
            for i, n in outputs[state] if char in single else (*outputs[state], (none + ord(char), 1)):
                score = best[stop - n] + (by_id[i] if i < none else self.unknown_score)
                if score > best[stop]:
                    best[stop], last[stop], size[stop] = score, i, n
        return last, size

    def _ids(self, chunk: str) -> list[int]:
        found, none = self.segment(chunk), len(self.pieces)
        if max(found) < none:
            return found
        out = []
        for i in found:
            if i < none:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in self._name(i).encode()]
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit little-endian integers."""
        if self.mapped:
            text = self.mapped(text)
        if self.strip:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return b""
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        packed = b"".join(map(self.store.__getitem__, self.chunks.findall(marked)))
        if not self.bytes and self.unknown in (ids := memoryview(packed).cast("i").tolist()):
            ids = [i for i, before in zip(ids, [None, *ids], strict=False) if i != self.unknown or before != i]
            packed = struct.pack(f"<{len(ids)}i", *ids)
        return packed

    def forget(self) -> None:
        """Give up what is stored, at a task's end: the worker may idle beside other stages."""
        self.store.forget()
        self.fits.forget()

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def merges(piece: str, scores: dict[str, float]) -> tuple[str, str] | tuple[()] | None:
    """The two parts of which a piece's last merge by rank makes it; none of a character, None if merges don't reach it."""
    parts, last = list(piece), ()
    while len(parts) > 1:
        pairs = [(scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores]
        if not pairs:
            return None
        i = -max(pairs)[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return last


def _spine(piece: str, split: dict, scores: dict[str, float], side: int) -> list[tuple[str, float, float]]:
    """The parts at one end of a piece as merges build it: (part, score at which it is made, score at which it is used)."""
    out, used = [], -np.inf
    while True:
        parts = split.get(piece) or ()
        out.append((piece, scores[piece] if parts else np.inf, used))
        if not parts:
            return out
        used, piece = scores[piece], parts[side]


@functools.lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    """A model's codec, which the driver makes once and broadcasts; workers drop it when a later stage doesn't use it."""
    return Codec(model)


def read_model(path: str, most: int = 16 << 20) -> bytes:
    """The bytes of a model that is supported; larger files than ``most`` are refused."""
    with open(path, "rb") as file:
        data = file.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} has more than {most} bytes")
    sentencepiece.SentencePieceProcessor(model_proto=data)  # refuses what isn't a model
    codec(data)  # and this, what isn't supported
    return data


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, token_ids, n_tokens, and round_trip: whether decoding the ids gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(codec(read_model(model_path)))

    def run(batches):
        sp = shared.value
        for batch in slices(batches):
            offsets, data, same, held = [0], [], [], []
            for text in batch.column(1).to_pylist():
                held.append(text is None)
                packed = b"" if text is None else sp.encode(text)
                data.append(packed)
                offsets.append(offsets[-1] + len(packed) // 4)
                same.append(None if text is None else sp.decode(np.frombuffer(packed, "<i4").tolist()) == text)
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(data))])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(held))
            counts = pa.array([None if none else n for none, n in zip(held, np.diff(offsets).tolist(), strict=True)], pa.int32())
            yield pa.record_batch([batch.column(0), ids, counts, pa.array(same, pa.bool_())], ["doc_id", "token_ids", "n_tokens", "round_trip"])
        sp.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, token_ids array<int>, n_tokens int, round_trip boolean")


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and text of rows with token ids; null ids give a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(codec(read_model(model_path)))

    def run(batches):
        sp = shared.value
        for batch in batches:
            texts = [None if ids is None else sp.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(tidy(run), "doc_id long, text string")
