"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text, with a mark for each blank and one before it, is cut wherever two characters stand side by side that no piece
has side by side. Over the lattice of a chunk's pieces, forward filtering sums the weights of all ways to
each place; backward sampling then draws pieces from the end, each by its share of that sum. Random numbers are a hash
of the row's key and the place in the text, so a row's segmentation is the same in every run and on every partition.
Characters that no piece covers become byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import _BACK, _STEP, U, _powers, mix, row_runs, text_buffers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Weights of a piece: 1 / (rank + OFFSET) ** SHARPNESS, by rank in the vocabulary (a BPE vocabulary has ranks, not chances).
OFFSET, SHARPNESS = 10.0, 1.5
#: Lattice edges that a worker keeps for words it has met.
KEPT_EDGES = 1_200_000
UNIT_BYTES = 1 << 18
#: Code points whose pairs are looked up in a table.
_NEAR = 1024


class Vocabulary:
    """Pieces in order of their ids, and the ids of the 256 byte pieces."""

    def __init__(self, pieces: list[str], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids

    def __hash__(self) -> int:
        return hash((len(self.pieces), self.pieces[-1], self.byte_ids[0]))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Vocabulary) and self.pieces == other.pieces


def load(model: str = MODEL) -> Vocabulary:
    """Read a SentencePiece model on the driver; a vocabulary has a fixed size."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    n = p.get_piece_size()
    if not all(p.is_byte(p.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
        raise ValueError(f"{model} has no byte pieces")
    special = {i for i in range(n) if p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}
    return Vocabulary(["" if i in special else p.id_to_piece(i) for i in range(n)], [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


@lru_cache(maxsize=2)
def _power_table(upto: int, back: bool) -> np.ndarray:
    return _powers(_BACK if back else _STEP, upto)


def powers(n: int, back: bool) -> np.ndarray:
    """Powers of the hash's base, or of its inverse."""
    return _power_table(1 << max(19, int(n).bit_length()), back)[:n]


class Lattices:
    """Lattices of the chunks met so far; nodes (a place of a chunk) and edges (a piece that ends there) in flat arrays."""

    def __init__(self, vocabulary: Vocabulary, sharpness: float = SHARPNESS):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        ids = [i for i, p in enumerate(vocabulary.pieces) if p]
        pairs = set()
        for rank, i in enumerate(ids):
            p = vocabulary.pieces[i].replace(BLANK, " ")
            self.find.add_word(p, rank)
            pairs.update(ord(x) << 21 | ord(y) for x, y in zip(p, p[1:], strict=False))
        self.find.make_automaton()
        if any(x >> 21 == 10 or x & 0x1FFFFF == 10 for x in pairs):
            raise ValueError("a piece holds a line feed with something else")
        # neighbours inside a piece: between any others a text may be cut
        self.pairs = np.asarray(sorted(pairs), np.int64)
        self.near = np.zeros((_NEAR, _NEAR), bool)
        for x in pairs:
            if x >> 21 < _NEAR and x & 0x1FFFFF < _NEAR:
                self.near[x >> 21, x & 0x1FFFFF] = True
        self.ids, self.sizes = np.asarray(ids, np.int32), np.asarray([len(vocabulary.pieces[i]) for i in ids], np.int64)
        self.weights = (np.arange(len(ids)) + OFFSET) ** -sharpness
        self.longest = int(self.sizes.max())
        self.byte_weight = (len(ids) + OFFSET) ** -sharpness
        self.byte_ids = np.asarray(vocabulary.byte_ids, np.int32)
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        kinds = {"last": np.int32, "first": np.int32, "upto": np.int64, "piece": np.int32, "step": np.int8}
        self.held = {k: np.empty(1 << 16, t) for k, t in kinds.items()}
        self.nodes = self.edges = 0

    def keep(self, name: str, used: int, values: np.ndarray) -> None:
        """Append to a flat array; its room doubles when it is full."""
        own, upto = self.held[name], used + len(values)
        if upto > len(own):
            own = np.empty(max(upto, 2 * len(own)), own.dtype)
            own[:used] = self.held[name][:used]
            self.held[name] = own
        own[used:upto] = values

    def cuts(self, char: np.ndarray) -> np.ndarray:
        """Where a text may be cut: starts of chunks that no piece reaches out of."""
        a, b = char[:-1], char[1:]
        low = (a < _NEAR) & (b < _NEAR)
        joined = self.near[np.where(low, a, 0), np.where(low, b, 0)] & low
        rare = np.flatnonzero(~low)
        if len(rare):
            want = a[rare].astype(np.int64) << 21 | b[rare]
            at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
            joined[rare] = self.pairs[at] == want
        return np.flatnonzero(np.concatenate([[True], ~joined]))

    def add(self, names: list[int], chunks: list[str]) -> None:
        """Forward filtering of new chunks, all of them a place at a time. Piece -1 - c is character c as bytes."""
        joined = "\n".join(chunks) + "\n"
        length = np.asarray(list(map(len, chunks)), np.int64)
        start = np.cumsum(length + 1) - length - 1
        begin = np.cumsum(length) - length
        flat = np.fromiter(chain.from_iterable(self.find.iter(joined)), np.int64)
        end, rank = flat[0::2], flat[1::2]
        size, piece, weight = self.sizes[rank], self.ids[rank], self.weights[rank]
        char = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        inside = np.ones(len(char), bool)
        inside[start + length] = False
        keep = inside[end]  # a line feed may be a piece; those put between chunks are none
        if not keep.all():
            end, size, piece, weight = end[keep], size[keep], piece[keep], weight[keep]
        alone = inside.copy()
        alone[end[size == 1]] = False
        more = np.flatnonzero(alone)
        if len(more):  # characters without a piece of their own become bytes
            end, size = np.concatenate([end, more]), np.concatenate([size, np.ones(len(more), np.int64)])
            piece = np.concatenate([piece, -1 - char[more].astype(np.int32)])
            weight = np.concatenate([weight, np.full(len(more), self.byte_weight)])
            order = np.argsort(end, kind="stable")
            end, size, piece, weight = end[order], size[order], piece[order], weight[order]
        chunk_of = np.repeat(np.arange(len(chunks)), length)
        to = (np.cumsum(inside) - 1)[end]
        level = to - begin[chunk_of[to]]
        longest = int(length.max())
        order = np.argsort(level.astype(np.int16) if longest < 32000 else level, kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(level, minlength=longest))])
        ways, share = np.zeros(int(length.sum())), np.empty(len(to))
        for j, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            edge = order[a:b]
            at, back = to[edge], size[edge]
            w = weight[edge] * np.where(back > j, 1.0, ways[at - np.minimum(back, j)])
            head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            total = np.add.reduceat(w, head)
            share[edge] = w / np.repeat(total, np.diff(np.append(head, len(at))))
            ways[at[head]] = total
            # long chunks are rescaled before their sums vanish; by then no piece reaches back to the start
            low = at[head][total < 1e-150] if j >= self.longest else at[:0]
            for k in range(self.longest) if len(low) else ():
                ways[low - k] *= 1e150
        # shares as 32-bit fractions that do not depend on what else is kept, longest piece first
        head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        fraction = np.floor(share * 2.0**32).astype(np.int64)
        total = np.cumsum(fraction)
        upto = total - np.repeat(total[head] - fraction[head], np.diff(np.append(head, len(to))))
        upto[np.append(head[1:], len(to)) - 1] = 1 << 32
        n = len(self.known)
        self.keep("last", n, self.nodes + begin + length - 1)
        self.keep("first", self.nodes, self.edges + head)
        for k, x in (("upto", upto), ("piece", piece), ("step", size)):
            self.keep(k, self.edges, x)
        self.known.update(zip(names, range(n, n + len(chunks)), strict=True))
        self.nodes += len(head)
        self.edges += len(to)

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts behind each other, and each text's number of them."""
        if self.edges > KEPT_EDGES:
            self.clear()
        # a blank before each text that is not empty, and a line feed between them
        joined = "".join([f" {t}\n" if t else "\n" for t in texts])
        if len(joined) == len(texts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        lengths = np.asarray([len(t) + 2 if t else 1 for t in texts], np.int64)
        ends = np.cumsum(lengths)
        char = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        start = self.cuts(char)
        length = np.diff(np.append(start, len(char)))
        between = np.searchsorted(start, ends - 1)  # the line feeds between texts are chunks of their own
        real = np.ones(len(start), bool)
        real[between] = False
        start, length = start[real], length[real]
        count = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
        with np.errstate(over="ignore"):
            total = np.zeros(len(char) + 1, U)
            np.cumsum((char.astype(U) + U(0x632BE59B)) * U(0xD1342543DE82EF95) * powers(len(char), False), out=total[1:])
            h = mix((total[start + length] - total[start]) * powers(len(char), True)[start] + length.astype(U))
        name, at, of = np.unique(h, return_index=True, return_inverse=True)
        names = name.tolist()
        places = list(map(self.known.get, names))
        if None in places:
            new = [i for i, x in enumerate(places) if x is None]
            a, n = start[at[new]].tolist(), length[at[new]].tolist()
            self.add([names[i] for i in new], [joined[x : x + m] for x, m in zip(a, n, strict=True)])
            places = list(map(self.known.get, names))
        of = np.asarray(places, np.int64)[of]
        last, first, upto, piece, step = (self.held[k] for k in ("last", "first", "upto", "piece", "step"))
        text = np.repeat(np.arange(len(texts)), count)
        place = start + length - (ends - lengths)[text]
        with np.errstate(over="ignore"):
            # the random number at a place depends on the text's key and the place alone
            seed = mix(keys.astype(np.int64).view(U))[text] + place.astype(U) * U(0x9E3779B97F4A7C15)
        node, left, at = last[of], length, np.arange(len(of), dtype=np.int32)
        drawn_at, drawn = [], []
        while len(at):
            u = (mix(seed) >> U(32)).astype(np.int64)
            edge = first[node]
            late = np.flatnonzero(u >= upto[edge])
            while len(late):
                edge[late] += 1
                late = late[u[late] >= upto[edge[late]]]
            drawn_at.append(at)
            drawn.append(piece[edge])
            size = step[edge].astype(np.int64)
            left = left - size
            go = np.flatnonzero(left > 0)
            with np.errstate(over="ignore"):
                seed = seed[go] - size[go].astype(U) * U(0x9E3779B97F4A7C15)
            at, node, left = at[go], node[go] - size[go], left[go]
        rounds = np.bincount(np.concatenate(drawn_at), minlength=len(of))
        begin = np.cumsum(rounds) - rounds
        out = np.empty(int(rounds.sum()), np.int32)
        for i, (a, d) in enumerate(zip(drawn_at, drawn, strict=True)):
            out[begin[a] + rounds[a] - 1 - i] = d
        per = np.bincount(text, rounds, len(texts)).astype(np.int64)
        if (out < 0).any():
            out, per = self._bytes(out, per)
        return out.astype(np.int32), per

    def _bytes(self, out: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        char = np.where(out < 0, -1 - out, 0)
        size = np.where(out < 0, 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF), 1)
        start = np.cumsum(size) - size
        wide = np.repeat(out, size)
        for c in np.unique(char[out < 0]).tolist():
            at = start[(out < 0) & (char == c)]
            for i, b in enumerate(chr(c).encode("utf-8", "replace")):
                wide[at + i] = self.byte_ids[b]
        text = np.repeat(np.arange(len(per)), per)
        return wide, np.bincount(text, size, len(per)).astype(np.int64)


@lru_cache(maxsize=1)
def _lattices(vocabulary: Vocabulary, sharpness: float) -> Lattices:
    return Lattices(vocabulary, sharpness)


def _encoded(own: Lattices, text: pa.Array, key: pa.Array) -> pa.Array:
    data, offsets = text_buffers(text)
    keys = key.to_numpy(zero_copy_only=False).astype(np.int64)
    ids, per = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a, b in row_runs(offsets, UNIT_BYTES):
        i, n = own.encode([data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace") for r in range(a, b)], keys[a:b])
        ids.append(i)
        per.append(n)
    cut = np.concatenate([[0], np.cumsum(np.concatenate(per))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(ids)), mask=text.is_null() if text.null_count else None)


class _Bytes:
    """The bytes that each piece stands for."""

    def __init__(self, v: Vocabulary):
        of_byte = {i: bytes([b]) for b, i in enumerate(v.byte_ids)}
        raw = [of_byte.get(i, p.replace(BLANK, " ").encode()) for i, p in enumerate(v.pieces)]
        self.length = np.asarray([len(x) for x in raw], np.int64)
        self.begin, self.data = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(raw), np.uint8)

    def decoded(self, column: pa.Array) -> pa.Array:
        cut = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        every = column.values.to_numpy(zero_copy_only=False)
        out: list[str] = []
        for a, b in row_runs(cut, 1 << 16):
            ids = every[cut[a] : cut[b]]
            size = self.length[ids]
            ends = np.concatenate([[0], np.cumsum(size)])
            flat = self.data[np.arange(ends[-1]) + np.repeat(self.begin[ids] - ends[:-1], size)].tobytes()
            at = ends[cut[a : b + 1] - cut[a]].tolist()
            # each text's first blank is the one put before it
            out += [flat[i + 1 : j].decode("utf-8", "replace") if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]
        return pa.array(out, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None)


# annotations of the functions below are read by Spark to tell their kind


def encoder(spark: SparkSession, vocabulary: Vocabulary, sharpness: float = SHARPNESS):
    """A function of (text, key: long) columns to an array of piece ids; null text to null."""
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = _lattices(sent.value, sharpness)
        for text, key in batches:
            yield _encoded(own, text, key)

    return F.arrow_udf(run, "array<int>")


def decoder(spark: SparkSession, vocabulary: Vocabulary):
    """A function of a column of piece ids to text; null to null."""
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _Bytes(sent.value)
        for column in batches:
            yield own.decoded(column)

    return F.arrow_udf(run, "string")


def round_trip(spark: SparkSession, vocabulary: Vocabulary, sharpness: float = SHARPNESS):
    """A function of (text, key) to pieces and the text decoded from them, in one worker."""
    sent = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own, raw = _lattices(sent.value, sharpness), _Bytes(sent.value)
        for text, key in batches:
            ids = _encoded(own, text, key)
            yield pa.StructArray.from_arrays([ids, raw.decoded(ids)], ["pieces", "back"])

    return F.arrow_udf(run, "pieces array<int>, back string")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "pieces", model: str = MODEL, sharpness: float = SHARPNESS, seed: int = 0) -> DataFrame:
    """``docs`` with ``out_col``: a sampled segmentation of each whole text as piece ids (replaced if it was there).

    Null text gives null, an empty text no pieces; texts are never cut off, however long. The row's key is its id: rows with one id and
    one text get one segmentation; null ids share a key. ``seed`` gives other samples. An empty table gives an empty result; all other
    columns stay, whatever their names.
    """
    key = F.xxhash64(F.col(id_col), F.lit(seed))
    return docs.withColumn(out_col, encoder(docs.sparkSession, load(model), sharpness)(F.col(text_col), key))


def decode_pieces(docs: DataFrame, pieces_col: str = "pieces", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with ``out_col``: the text its pieces stand for (replaced if it was there).

    Null pieces give null, none the empty text. Ids outside the vocabulary are an error. Repeated rows stay; an empty table gives an empty
    result. All other columns stay, whatever their names.
    """
    return docs.withColumn(out_col, decoder(docs.sparkSession, load(model))(F.col(pieces_col)))


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, sharpness: float = SHARPNESS, seed: int = 0) -> DataFrame:
    """``docs`` with ``pieces`` as from ``encode_texts`` and ``back``, the text decoded from them (both replaced if they were there).

    A null text gives null in both, an empty text no pieces and an empty text; whole texts are encoded, however long. Rows with one id and one
    text get one segmentation, repeated rows stay, null ids share a key. An empty table gives an empty result. All other columns stay,
    whatever their names, also such with dots.
    """
    both = round_trip(docs.sparkSession, load(model), sharpness)(F.col(text_col), F.xxhash64(F.col(id_col), F.lit(seed)))
    rows = docs.select(F.struct("*").alias("row"), both.alias("both")).select(F.col("row").dropFields("pieces", "back").alias("row"), "both")
    return rows.select("row.*", "both.pieces", "both.back")


def fallback_count(pieces: Column, vocabulary: Vocabulary) -> Column:
    """Byte pieces in a column of ids; their ids follow each other."""
    low, high = min(vocabulary.byte_ids), max(vocabulary.byte_ids)
    return F.size(F.filter(pieces, lambda x: (x >= low) & (x <= high)))
