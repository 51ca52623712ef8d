"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

A model file is read on the driver; the executors get its tables with the
task.  A batch of texts is cut into words (a run of space marks and what
follows up to the next one; no piece of an accepted model crosses such a
border, so words merge independently), and every distinct word is encoded once.
All new words of a batch are laid end to end in one flat symbol array, and cut
further into runs wherever no piece can hold what stands on both sides: a piece
across two characters would be just the two, or hold one more neighbour of
theirs, and neither is part of any piece.

A round finds the smallest pair rank of every run by a segmented minimum and
merges all its leftmost occurrences that don't overlap at once, looks up only
the pairs that changed, and compacts the arrays; runs without a pair leave.  A
model's ranks need not be monotone: where a merge opens a pair that isn't worse
than the one merged, the merges to its right wait for the next round, so the
order is that of one merge at a time.  Rounds go on until no pair remains.

Defined cases: null text is encoded as the empty text, which has no ids and
decodes to the empty text; characters without a piece become byte pieces;
U+2581 in a text is a space mark, as in the library; very long texts and words
are processed whole; ids repeat as rows do; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

MARK = "▁"
#: Characters encoded at a time, and words kept between batches, by one task.
BATCH_CHARS = 1 << 19
CACHE_WORDS = 150_000
_NO_RANK = np.int64(1) << 31
_SHIFT = 21
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MARK_BITS = 20


def _mark(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - _MARK_BITS)).astype(np.int64)


def _fields(data: bytes):
    """(field number, value) pairs of a protobuf message."""

    def varint(i):
        shift = value = 0
        while True:
            c = data[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = 4 if kind == 5 else 8
            value, i = data[i : i + size], i + size
        yield key >> 3, value


@dataclass
class Model:
    """The parts of a SentencePiece BPE model that encoding and decoding need."""

    pieces: list[str]
    scores: np.ndarray
    kinds: list[int]
    dummy_prefix: bool = True
    unknown_surface: str = " ⁇ "
    byte_ids: np.ndarray = field(default_factory=lambda: np.full(256, -1, np.int32))

    @staticmethod
    def load(path: str) -> Model:
        """Reads a model; refuses kinds of model whose rules are not implemented."""
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds = [], [], []
        norm: dict[int, object] = {}
        train: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(own.get(3, _NORMAL))
            elif number == 2:
                train = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if train.get(3, 1) != 2:
            raise ValueError("only BPE models are supported")
        if norm.get(2) or norm.get(4, 1):
            raise ValueError("only models with identity normalisation that keep white space are supported")
        if train.get(24, 0) or set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("suffix white space and user-defined or unused pieces are not supported")
        if not train.get(35, 0) or any(re.search(f"[^{MARK}]{MARK}", p) for p, k in zip(pieces, kinds, strict=True) if k == _NORMAL):
            raise ValueError("only models with byte pieces and without pieces across words are supported")
        out = Model(pieces, np.array(scores, np.float32), kinds, bool(norm.get(3, 1)))
        if 44 in train:
            out.unknown_surface = train[44].decode()
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == _BYTE:
                out.byte_ids[int(p[1:-1], 16)] = i
        return out


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.size = n = len(model.pieces)
        ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == _NORMAL}
        # a symbol is a piece id, or n + code point for a character without a piece
        self.char = np.arange(0x110000, dtype=np.int64) + n
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        ranks = np.unique(-model.scores, return_inverse=True)[1]
        keys, merged, rank = [], [], []

        def symbol(s):
            return ids[s] if s in ids else n + ord(s) if len(s) == 1 else None

        for p, i in ids.items():
            for k in range(1, len(p)):
                u, v = symbol(p[:k]), symbol(p[k:])
                if u is not None and v is not None:
                    keys.append(u << _SHIFT | v)
                    merged.append(i)
                    rank.append(ranks[i])
        self._hash_pairs(np.array(keys, np.int64), np.array(merged, np.int64), np.array(rank, np.int64))
        self.small, self.inner = self._neighbours([p for p in ids if len(p) > 1])
        # what each piece adds to a decoded text, as bytes
        surface = []
        for p, k in zip(model.pieces, model.kinds, strict=True):
            surface.append(b"" if k == _CONTROL else bytes([int(p[1:-1], 16)]) if k == _BYTE else model.unknown_surface.encode() if k == _UNKNOWN else p.replace(MARK, " ").encode())
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surface])]).astype(np.int64)
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.is_byte = np.array(model.kinds) == _BYTE
        self._clear()

    def _clear(self):
        self.slot: dict[str, int] = {}
        self.word_ids: list[np.ndarray] = []
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    # -- merging ---------------------------------------------------------

    def _hash_pairs(self, keys, merged, rank):
        """A table of pairs with open addressing, at most an eighth full."""
        self.shift = np.uint64(64 - max(4, (8 * len(keys)).bit_length()))
        size = 1 << int(np.uint64(64) - self.shift)
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_rank = np.full(size, _NO_RANK)
        self.slot_made = np.full(size, -1, np.int64)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.slot_key[at[left]] == -1
            one = left[free][np.unique(at[left[free]], return_index=True)[1]]
            self.slot_key[at[one]], self.slot_rank[at[one]], self.slot_made[at[one]] = keys[one], rank[one], merged[one]
            left = left[self.slot_key[at[left]] != keys[left]]
            at[left] = (at[left] + 1) % size

    def _slot(self, q):
        return ((q.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def _pairs(self, left, right):
        """(rank, merged symbol) of symbol pairs."""
        q = (left << _SHIFT) | right
        at = self._slot(q)
        key = self.slot_key[at]
        off = np.flatnonzero((key != q) & (key != -1))
        while len(off):
            at[off] = (at[off] + 1) % len(self.slot_key)
            key = self.slot_key[at[off]]
            off = off[(key != q[off]) & (key != -1)]
        # where the search ended in an empty slot there is no pair, and that slot says so
        return self.slot_rank[at], self.slot_made[at]

    def pairs(self) -> dict[int, tuple[int, int]]:
        """All pairs: key to (rank, merged symbol)."""
        at = np.flatnonzero(self.slot_key >= 0)
        return {int(k): (int(r), int(m)) for k, r, m in zip(self.slot_key[at], self.slot_rank[at], self.slot_made[at], strict=True)}

    @staticmethod
    def _neighbours(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marks of the pieces of two characters, and of all three characters side by side in a piece.

        A mark is a bit at a hash; others that share it only make runs longer.
        """
        out = np.zeros((2, 1 << _MARK_BITS), bool)
        small = [ord(p[0]) << _SHIFT | ord(p[1]) for p in pieces if len(p) == 2]
        inner = [ord(p[k]) << 2 * _SHIFT | ord(p[k + 1]) << _SHIFT | ord(p[k + 2]) for p in pieces for k in range(len(p) - 2)]
        for marks, keys in zip(out, (small, inner), strict=True):
            marks[_mark(np.array(keys, np.int64))] = True
        return out[0], out[1]

    def _runs(self, char: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The number of each character's run: a run ends with its word, or where no piece crosses."""
        if not len(char):
            return word
        within = word[1:] == word[:-1]
        two = char[:-1] << _SHIFT | char[1:]
        inner = self.inner[_mark(char[:-2] << 2 * _SHIFT | two[1:])]
        inner &= within[:-1] & within[1:]
        crossed = self.small[_mark(two)]
        crossed[1:] |= inner
        crossed[:-1] |= inner
        return np.concatenate([[0], np.cumsum(~(crossed & within))])

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, flat, and where each word's begin."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        char = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.char[char]
        word = np.repeat(np.arange(len(words)), lens)
        run = self._runs(char, word)
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
        word_of = word[first]
        rank = np.full(len(sym), _NO_RANK)
        made = np.full(len(sym), -1, np.int64)
        inner = np.flatnonzero(run[1:] == run[:-1])
        rank[inner], made[inner] = self._pairs(sym[inner], sym[inner + 1])
        done_run, done_sym = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            count = np.diff(np.append(first, len(sym)))
            low = np.minimum.reduceat(rank, first)
            ended = low >= _NO_RANK
            if ended.any():
                leave = np.repeat(ended, count)
                done_run.append(run[leave])
                done_sym.append(sym[leave])
                stay = ~leave
                sym, run, rank, made = sym[stay], run[stay], rank[stay], made[stay]
                low, count = low[~ended], count[~ended]
                if not len(sym):
                    break
            # the leftmost occurrences that don't overlap: every other one of those that follow each other
            hit = np.flatnonzero(rank == np.repeat(low, count))
            new = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            begin = np.flatnonzero(new)
            at = hit[(np.arange(len(hit)) - np.repeat(begin, np.diff(np.append(begin, len(hit))))) % 2 == 0]
            own, best = run[at], rank[at]
            # the pairs that each merge opens, given the merges to its left: with the symbol before, and with the one behind
            joined = np.concatenate([[False], (at[1:] == at[:-1] + 2) & (own[1:] == own[:-1])])
            before = np.where(joined, at - 2, at - 1)
            has_left = (before >= 0) & (run[before] == own)
            left, left_made = np.full(len(at), _NO_RANK), np.full(len(at), -1, np.int64)
            k = np.flatnonzero(has_left)
            left[k], left_made[k] = self._pairs(np.where(joined[k], made[before[k]], sym[before[k]]), made[at[k]])
            right, right_made = np.full(len(at), _NO_RANK), np.full(len(at), -1, np.int64)
            k = np.flatnonzero(at + 2 < len(sym))
            k = k[run[at[k] + 2] == own[k]]
            right[k], right_made[k] = self._pairs(made[at[k]], sym[at[k] + 2])
            # merges to the right of one that opens a pair as good as its own wait
            opens = (left <= best) | (right <= best)
            if opens.any():
                before_it = np.cumsum(opens) - opens
                head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                since = before_it - np.repeat(before_it[head], np.diff(np.append(head, len(at))))
                go = since == 0
                at, before, has_left = at[go], before[go], has_left[go]
                left, left_made, right, right_made = left[go], left_made[go], right[go], right_made[go]
            sym[at] = made[at]
            rank[at], made[at] = right, right_made
            # a neighbour on the left that was merged too gets the pair of both
            rank[before[has_left]], made[before[has_left]] = left[has_left], left_made[has_left]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, run, rank, made = sym[keep], run[keep], rank[keep], made[keep]
        if not done_run:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        run, sym = np.concatenate(done_run), np.concatenate(done_sym)
        order = np.argsort(run, kind="stable")
        return sym[order], np.concatenate([[0], np.cumsum(np.bincount(word_of[run], minlength=len(words)))]).astype(np.int64)

    def _to_ids(self, sym, at):
        """Piece ids of symbols; characters without a piece become their bytes."""
        if not (sym >= self.size).any():
            return sym.astype(np.int32), at
        cp = sym - self.size
        width = np.where(cp < 0, 1, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))
        begin = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(sym, width)
        byte = self.model.byte_ids.astype(np.int64)
        for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            own = np.flatnonzero((width == n) & (cp >= 0))
            for k in range(n if len(own) else 0):
                part = cp[own] >> 6 * (n - 1 - k)
                out[begin[own] + k] = byte[part | lead] if k == 0 else byte[part & 63 | 0x80]
        return out.astype(np.int32), begin[at]

    # -- texts -----------------------------------------------------------

    def _words(self, text: str) -> list[str]:
        """Keys of a text's words: the word without its mark if it has exactly one, else the word itself."""
        text = text.replace(" ", MARK)
        if self.model.dummy_prefix:
            text = MARK + text
        if text[0] == MARK and text[-1] != MARK and MARK + MARK not in text:
            return text[1:].split(MARK)
        words = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)
        return [w[1:] if w[0] == MARK and len(w) > 1 and w[1] != MARK else w if w[0] == MARK else "\0" + w for w in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat int32 ids of all texts and where each text's begin."""
        if len(self.slot) > CACHE_WORDS:
            self._clear()
        docs = [self._words(t) if t else [] for t in texts]
        new: set[str] = set()
        for d in docs:
            new.update(d)
        fresh = [w for w in new if w not in self.slot]
        if fresh:
            sym, at = self.merge([w[1:] if w[0] == "\0" and len(w) > 1 and w[1:2] != MARK and not self.model.dummy_prefix else w if w[0] == MARK else MARK + w for w in fresh])
            ids, at = self._to_ids(sym, at)
            self.slot.update(zip(fresh, range(len(self.at) - 1, len(self.at) - 1 + len(fresh)), strict=True))
            self.at = np.concatenate([self.at, self.at[-1] + at[1:]])
            self.flat = np.concatenate([self.flat, ids])
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        get = self.slot.__getitem__
        slots = np.fromiter((s for d in docs for s in map(get, d)), np.int64, int(counts.sum()))
        size = self.at[slots + 1] - self.at[slots]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[slots] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        ends = np.concatenate([[0], end])[np.cumsum(counts)]
        return ids, np.concatenate([[0], ends])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of flat ids."""
        size = self.surface_at[ids + 1] - self.surface_at[ids]
        end = np.cumsum(size)
        data = self.surface[np.repeat(self.surface_at[ids] - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        cuts = np.concatenate([[0], end])[at]
        out = []
        for k in range(len(at) - 1):
            a, b = int(at[k]), int(at[k + 1])
            if a == b:
                out.append("")
                continue
            own = data[cuts[k] : cuts[k + 1]]
            lead = a
            while lead < b and self.model.kinds[ids[lead]] == _CONTROL:
                lead += 1
            strip = self.model.dummy_prefix and lead < b and self.model.kinds[ids[lead]] == _NORMAL and own[:1] == b" "
            try:
                text = own.decode()
            except UnicodeDecodeError:
                text = self._decode_loose(ids[a:b])
            out.append(text[1:] if strip else text)
        return out

    def _decode_loose(self, ids) -> str:
        """Runs of byte pieces that are not UTF-8: every byte outside a character becomes U+FFFD."""
        out, run = [], b""
        for i in [*ids.tolist(), -1]:
            own = self.surface[self.surface_at[i] : self.surface_at[i + 1]].tobytes() if i >= 0 else b""
            if i >= 0 and self.is_byte[i]:
                run += own
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            out.append(own.decode())
        return "".join(out)


def _codec(shared: dict) -> Codec:
    """One codec for a broadcast model in each Python worker; it stays with the broadcast value from task to task."""
    if "codec" not in shared:
        shared["codec"] = Codec(Model(**shared["model"]))
    return shared["codec"]


def slices(texts: list[str | None], limit: int = BATCH_CHARS):
    """Ranges of texts of about ``limit`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_decode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and the decoded text of every row.

    The model is a file of fixed size on the driver; its tables are broadcast.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast({"model": vars(Model.load(model_path))})
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids, at = codec.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(codec.decode(ids, at), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """n_tokens and digests of ids and decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(ids, "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode(F.col("decoded"), "UTF-8"), 256).alias("decoded_sha256"))


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode_decode(table(spark, sf_dir, "documents"), model_file()))
