"""Removal of repeated substrings: every byte in a string of 100 bytes that starts earlier, too.

Equal windows must meet, wherever their documents are. Each window is named by its anchor, the substring of half its
length with the least hash, so equal windows have equal anchors and neighbours mostly share one. Anchors are counted over
the corpus; windows whose anchor is there once are alone and go no further. The others travel, a run of windows with one
anchor as one piece of text, to the shard of their anchor; equal pieces are merged before and after. A shard's pieces are
one text, whose suffix array (induced sorting) and permuted common prefixes give the windows that are equal; of these the
first stays, and the places of the others travel back to their documents.

An anchor with very many different pieces is cut: by where it lies in the window, and by what surrounds it there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .suffix_array import permuted_prefixes, suffix_array
from .words import U, mix, packed, text_buffers, unpacked


@dataclass(frozen=True)
class Sizes:
    """Bytes of a window, of text kept together, worked on at a time (at most 2 ** 20), for which there is one bucket, and of a shard's
    text. An anchor with more than ``hot`` pieces is cut; its windows go by their place in it, ``span`` places together."""

    window: int = 100
    unit: int = 4 << 20
    block: int = 1 << 20
    bucket: int = 6 << 20
    shard: int = 1 << 19
    hot: int = 4096
    span: int = 7


SEPARATOR = 255
_LETTER = np.random.default_rng(8191).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_STEP = 0xD1342543DE82EF95
_PLACE = U((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=U)


_UP, _DOWN = _powers(_STEP, (1 << 20) + 1), _powers(pow(_STEP, -1, 2**64), (1 << 20) + 1)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def _short(h: np.ndarray) -> np.ndarray:
    """48 bits of an anchor's hash, for counting; anchors that share them are only compared in vain."""
    return mix(h ^ U(0x5DEECE66D)) >> U(16)


def _slices(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of all slices behind each other."""
    offsets = np.concatenate([[0], np.cumsum(length)])
    return data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)]


@dataclass
class Runs:
    """Windows next to each other with one anchor: row, first window, number, key, hash of the piece, place of its text in ``data``."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    piece: np.ndarray
    at: np.ndarray
    data: np.ndarray
    whole: np.ndarray


def _runs(data: np.ndarray, row: np.ndarray, first: np.ndarray, cut: np.ndarray, sizes: Sizes, hot: np.ndarray | None) -> Runs:
    """Runs of the parts of ``data`` (part i is ``cut[i]:cut[i + 1]``, of row ``row[i]`` from byte ``first[i]``). ``hot``: short names, sorted;
    runs of these anchors are cut, and get keys of their own; ``whole`` says which are not."""
    n, w, m = len(data), sizes.window, max(1, sizes.window // 2)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U)
        np.cumsum(_LETTER[data] * _UP[:n], out=total[1:])

        def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return mix((total[b] - total[a]) * _DOWN[a] + (b - a).astype(U) * U(0x9E3779B97F4A7C15))

        gram = mix((total[m:] - total[:-m]) * _DOWN[: n - m + 1])
        least = _least((gram & ~_PLACE) | np.arange(n - m + 1, dtype=U), w - m + 1)
    anchor = (least & _PLACE).astype(np.int64)
    part = np.repeat(np.arange(len(row), dtype=np.int32), np.diff(cut))
    valid = part[: n - w + 1] == part[w - 1 :]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    if hot is not None and len(hot):
        name = _short(gram[anchor])
        at = np.minimum(np.searchsorted(hot, name), len(hot) - 1)
        cut_here = hot[at] == name
        span = np.where(cut_here, (anchor - np.arange(len(anchor))) // sizes.span, -1)
        new[1:] |= span[1:] != span[:-1]
    last = np.ones(len(anchor), bool)
    last[:-1] = new[1:] | ~valid[1:]
    start, end = np.flatnonzero(valid & new), np.flatnonzero(valid & last) + 1
    key, whole = gram[anchor[start]], np.ones(len(start), bool)
    if hot is not None and len(hot):
        whole = ~cut_here[start]
        c = np.flatnonzero(~whole)
        low = span[start[c]] * sizes.span
        high = np.minimum(low + sizes.span - 1, w - m)
        with np.errstate(over="ignore"):  # what all windows with the anchor at these places have
            own = hashed(anchor[start[c]] - low, anchor[start[c]] - high + w)
            key[c] = mix(own ^ ((low + 1).astype(U) * U(0xA24BAED4963EE407)))
    of = part[start]
    return Runs(row[of], start - cut[of] + first[of], end - start, key, hashed(start, end - 1 + w), start, data, whole)


def _all_runs(data: np.ndarray, cut: np.ndarray, wanted: np.ndarray, sizes: Sizes, hot: np.ndarray | None = None) -> Iterator[Runs]:
    """Runs of the wanted rows, a block of bytes at a time; longer rows go in parts that overlap, so that each window is in one."""
    parts, size, w, block = [], 0, sizes.window, sizes.block

    def out() -> Runs:
        own = np.concatenate([data[cut[r] + a : cut[r] + b] for r, a, b in parts])
        row, first, end = (np.asarray(x, np.int64) for x in zip(*parts, strict=True))
        return _runs(own, row, first, np.concatenate([[0], np.cumsum(end - first)]), sizes, hot)

    for r in np.flatnonzero(wanted).tolist():
        length = int(cut[r + 1] - cut[r])
        for a in range(0, length - w + 1, block - w + 1):
            b = min(a + block, length)
            if parts and size + b - a > block:
                yield out()
                parts, size = [], 0
            parts.append((r, a, b))
            size += b - a
    if parts:
        yield out()


def _units(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of so many bytes of text at a time; row i of a unit has the number unit + i."""
        row = TaskContext.get().partitionId() << 40
        ids, order, lengths, digests, texts, size = [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal row
            n, unit = sum(map(len, lengths)), row
            row += n
            whole = pa.array([0, n], pa.int32())
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            lists = [pa.concat_arrays(ids), pa.concat_arrays(order), pa.array(np.concatenate(lengths)), pa.array(d[:, 0]), pa.array(d[:, 1])]
            return pa.RecordBatch.from_arrays([pa.array([unit]), *[pa.ListArray.from_arrays(whole, x) for x in lists], pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary())], ["unit", "doc_id", "ord", "n_bytes", "d0", "d1", "text"])

        for batch in batches:
            data, cut = text_buffers(batch.column(2))
            a = 0
            for i in range(len(batch)):
                own = data[cut[i] : cut[i + 1]].tobytes()
                digests.append(hashlib.sha256(own).digest()[:16])
                texts.append(own)
                size += len(own)
                if size >= most or i == len(batch) - 1:
                    ids.append(batch.column(0).slice(a, i + 1 - a))
                    order.append(batch.column(1).slice(a, i + 1 - a))
                    lengths.append(np.diff(cut[a : i + 2]))
                    a = i + 1
                if size >= most:
                    yield out()
                    ids, order, lengths, digests, texts, size = [], [], [], [], [], 0
        if ids:
            yield out()

    return run


class _Unit:
    """A unit as it is worked on."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, i: int, w: int) -> None:
        def get(name: str) -> np.ndarray:
            return np.asarray(batch[name][i].values)

        self.unit, self.size, self.order, self.d0, self.d1 = batch["unit"][i].as_py(), get("n_bytes"), get("ord"), get("d0"), get("d1")
        self.cut = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(pa.decompress(batch["text"][i].as_py(), int(self.cut[-1]), "zstd", asbytes=True), np.uint8) if self.cut[-1] else np.zeros(0, np.uint8)
        # of equal texts the first row; texts shorter than a window have nothing that could repeat
        long = np.flatnonzero(self.size >= w)
        by = long[np.lexsort((long, self.order[long], self.d1[long], self.d0[long]))]
        new = np.ones(len(by), bool)
        new[1:] = (self.d0[by[1:]] != self.d0[by[:-1]]) | (self.d1[by[1:]] != self.d1[by[:-1]])
        self.texts = by[new]
        self.long = long

    def wanted(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size), bool)
        out[rows] = True
        return out


def _dealt(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its keys, in order of the keys."""
    bucket = (key % U(buckets)).astype(np.int64)
    by = np.lexsort((key, bucket))
    found, at = np.unique(bucket[by], return_index=True)
    yield from zip(found.tolist(), np.split(by, at[1:]) if len(found) else [], strict=True)


def _anchor_counts(runs: Iterator[Runs]) -> tuple[np.ndarray, np.ndarray]:
    """Short names of all anchors, sorted, and the number of different pieces of each, up to 65535; 2 for one piece that is there more often."""
    name, piece = [np.zeros(0, U)], [np.zeros(0, U)]
    for r in runs:
        name.append(_short(r.key))
        piece.append(r.piece)
    name, piece = np.concatenate(name), np.concatenate(piece)
    by = np.lexsort((piece, name))
    name, piece = name[by], piece[by]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (piece[1:] != piece[:-1])
    found, n = np.unique(name[new], return_counts=True)
    several = np.unique(name, return_counts=True)[1] > 1
    return found, np.clip(n, 1 + several, 0xFFFF)


def _counted(buckets: int, sizes: Sizes):
    """Per unit and bucket: its anchors with counts, and its texts."""
    names = ["unit", "bucket", "n", "name", "count", "texts", "d0", "d1", "ord", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                u = _Unit(batch, i, sizes.window)
                name, count = _anchor_counts(_all_runs(u.data, u.cut, u.wanted(u.texts), sizes))
                a = dict(_dealt(name, buckets))
                t = dict(_dealt(u.d0[u.texts].view(U), buckets))
                none, rows = np.zeros(0, np.int64), []
                for b in sorted(a.keys() | t.keys()):
                    x, y = a.get(b, none), u.texts[t.get(b, none)]
                    rows.append((u.unit, b, len(x), packed(np.diff(name[x], prepend=U(0))), packed(count[x].astype(np.uint16)), len(y), packed(u.d0[y]), packed(u.d1[y]), packed(u.order[y]), packed(y)))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return run


def _judged(sizes: Sizes):
    def run(rows: pa.Table) -> pa.Table:
        """One bucket of anchors and texts of all units. flags: 0 an anchor that is alone, 1 one that is not, 2 one with very many pieces; first: texts
        of which no earlier row has the same."""
        get = {c: rows[c].to_pylist() for c in rows.column_names}
        n, k = get["n"], get["texts"]
        with np.errstate(over="ignore"):
            name = np.concatenate([np.cumsum(unpacked(x, i, U), dtype=U) for x, i in zip(get["name"], n, strict=True)])
        count = np.concatenate([unpacked(x, i, np.uint16) for x, i in zip(get["count"], n, strict=True)])
        _, inverse = np.unique(name, return_inverse=True)
        total = np.bincount(inverse, count)
        flag = ((total > 1).astype(np.uint8) + (total > sizes.hot).astype(np.uint8))[inverse] if len(name) else np.zeros(0, np.uint8)
        d0, d1, order, row = (np.concatenate([unpacked(x, i, np.int64) for x, i in zip(get[c], k, strict=True)]) for c in ("d0", "d1", "ord", "row"))
        unit = np.repeat(np.asarray(get["unit"], np.int64), k)
        by = np.lexsort((unit + row, order, d1, d0))
        first = np.zeros(len(by), np.uint8)
        if len(by):
            new = np.ones(len(by), bool)
            new[1:] = (d0[by[1:]] != d0[by[:-1]]) | (d1[by[1:]] != d1[by[:-1]])
            first[by[new]] = 1
        flags = [packed(x) for x in np.split(flag, np.cumsum(n)[:-1])]
        firsts = [packed(x) for x in np.split(first, np.cumsum(k)[:-1])]
        return pa.table({"unit": pa.array(get["unit"], pa.int64()), "bucket": pa.array(get["bucket"], pa.int64()), "n": pa.array(n, pa.int64()), "flag": pa.array(flags, pa.binary()), "texts": pa.array(k, pa.int64()), "first": pa.array(firsts, pa.binary())})

    return run


_PIECES = "unit long, bucket long, n long, key binary, piece binary, count binary, ord binary, d0 binary, row binary, start binary, size long, text binary, marks long, mark binary"


def _marks(row: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[int, bytes]:
    """Windows that go: of each row those from ``start`` on, ``count`` of them."""
    return len(row), packed(np.concatenate([row, start, count]).astype(np.int64))


def _shipped(buckets: int, sizes: Sizes):
    """The pieces of a unit that may be elsewhere, too, by bucket; windows that go already, as the unit has them twice or a whole text is elsewhere."""
    w = sizes.window
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in _PIECES.split(", ")])

    def run(unit: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(unit):
            return schema.empty_table()
        u = _Unit(unit, 0, w)
        runs = list(_all_runs(u.data, u.cut, u.wanted(u.texts), sizes))
        name, count = _anchor_counts(iter(runs))
        flag, stays = np.zeros(len(name), np.uint8), np.ones(len(u.texts), bool)
        said = {r["bucket"]: r for r in replies.to_pylist()}
        for b, x in _dealt(name, buckets):
            flag[x] = unpacked(said[b]["flag"], len(x), np.uint8)
        for b, x in _dealt(u.d0[u.texts].view(U), buckets):
            stays[x] = unpacked(said[b]["first"], len(x), np.uint8) == 1
        own = u.texts[stays]
        gone = np.setdiff1d(u.long, own)
        marks = [(gone, np.zeros(len(gone), np.int64), u.size[gone] - w + 1)]
        hot, several = name[flag == 2], name[flag > 0]
        cols: dict[str, list[np.ndarray]] = {c: [np.zeros(0, np.int64)] for c in ("row", "start", "count")} | {c: [np.zeros(0, U)] for c in ("key", "piece")}
        wanted = u.wanted(own)
        if len(hot):
            runs = list(_all_runs(u.data, u.cut, wanted, sizes, hot))
        for r in runs if len(several) else ():
            short = _short(r.key)
            go = ~r.whole | (several[np.minimum(np.searchsorted(several, short), len(several) - 1)] == short)
            go &= wanted[r.row]
            for c in cols:
                cols[c].append(getattr(r, c)[go])
        row, start, count, key, piece = (np.concatenate(x) for x in cols.values())
        # of equal pieces of the unit the first travels
        by = np.lexsort((start, row, u.d0[row], u.order[row], piece, key))
        row, start, count, key, piece = (x[by] for x in (row, start, count, key, piece))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])
        marks.append((row[~new], start[~new], count[~new]))
        row, start, count, key, piece = (x[new] for x in (row, start, count, key, piece))
        rows = []
        for b, x in _dealt(key, buckets):
            text = _slices(u.data, u.cut[row[x]] + start[x], count[x] + w - 1).tobytes()
            rows.append((u.unit, b, len(x), packed(np.diff(key[x], prepend=U(0))), packed(piece[x]), packed(count[x].astype(np.uint16)), packed(u.order[row[x]]), packed(u.d0[row[x]]), packed(row[x].astype(np.int32)), packed(start[x]), len(text), pa.compress(text, "zstd", asbytes=True), 0, b""))
        marks = [np.concatenate(x) for x in zip(*marks, strict=True)]
        if len(marks[0]):
            rows.append((u.unit, int(mix(np.asarray([u.unit]).astype(U))[0] % U(buckets)), 0, *[b""] * 7, 0, b"", *_marks(*marks)))
        return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def _repeats(text: np.ndarray, length: np.ndarray, age: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the pieces (``length`` bytes each, all different) that a piece of lower age has, too: piece, first window, number."""
    start = np.concatenate([[0], np.cumsum(length + 1)])
    t = np.full(start[-1], SEPARATOR, np.uint8)
    piece = np.repeat(np.arange(len(length)), length + 1)
    place = np.arange(len(t)) - start[piece]
    t[place < length[piece]] = text
    sa = suffix_array(t, 256)
    run = np.cumsum(permuted_prefixes(t, sa)[sa] < w)
    ok = place[sa] <= length[piece[sa]] - w
    sa, run = sa[ok], run[ok]
    if not len(sa):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.diff(run, prepend=-1))
    own = age[piece[sa]]
    oldest = np.repeat(np.minimum.reduceat(own, first), np.diff(first, append=len(run)))
    again = np.sort(sa[own > oldest])
    new = np.diff(again, prepend=-2) > 1
    new[1:] |= piece[again[1:]] != piece[again[:-1]]
    at = np.flatnonzero(new)
    return piece[again[at]], place[again[at]], np.diff(at, append=len(again))


def _matched(sizes: Sizes):
    w = sizes.window

    def run(rows: pa.Table) -> pa.Table:
        """The shards of one bucket: which windows of its pieces go."""
        unit = np.asarray(rows["unit"])
        n = np.asarray(rows["n"])

        def get(name: str, kind: type) -> np.ndarray:
            return np.concatenate([unpacked(x.as_py(), int(k), kind) for x, k in zip(rows[name], n, strict=True)])

        with np.errstate(over="ignore"):
            key = np.concatenate([np.cumsum(unpacked(x.as_py(), int(k), U), dtype=U) for x, k in zip(rows["key"], n, strict=True)])
        piece, count, order, d0, row, start = get("piece", U), get("count", np.uint16).astype(np.int64), get("ord", np.int64), get("d0", np.int64), get("row", np.int32).astype(np.int64), get("start", np.int64)
        of = np.repeat(np.arange(len(n)), n)
        text = np.frombuffer(b"".join(pa.decompress(x.as_py(), k, "zstd", asbytes=True) for x, k in zip(rows["text"], rows["size"].to_pylist(), strict=True) if k), np.uint8)
        at = np.concatenate([[0], np.cumsum(count + w - 1)])[:-1]
        by = np.lexsort((start, unit[of] + row, d0, order, piece, key))
        k, p = key[by], piece[by]
        new = np.ones(len(by), bool)
        new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
        later = by[~new]
        found = [(of[later], row[later], start[later], count[later])]
        own = by[new]
        # different pieces of an anchor, in the order of anchors; those that are alone have nothing to be compared with
        first = np.flatnonzero(np.concatenate([[True], key[own[1:]] != key[own[:-1]]])) if len(own) else np.zeros(0, np.int64)
        many = np.repeat(np.diff(first, append=len(own)) > 1, np.diff(first, append=len(own)))
        own = own[many]
        if len(own):
            border = np.flatnonzero(key[own[1:]] != key[own[:-1]]) + 1
            size = np.concatenate([[0], np.cumsum(count[own] + w)])
            cuts, a = [0], 0
            for b in [*border.tolist(), len(own)]:
                if size[b] - size[cuts[-1]] > sizes.shard and a > cuts[-1]:
                    cuts.append(a)
                a = b
            cuts.append(len(own))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                x = own[a:b]
                length = count[x] + w - 1
                age = np.empty(len(x), np.int64)
                age[np.lexsort((start[x], unit[of[x]] + row[x], d0[x], order[x]))] = np.arange(len(x))
                i, place, many = _repeats(_slices(text, at[x], length), length, age, w)
                found.append((of[x[i]], row[x[i]], start[x[i]] + place, many))
        of, row, start, count = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(unit[of], kind="stable")
        out = []
        if len(by):
            units, at = np.unique(unit[of[by]], return_index=True)
            out = [(u, *_marks(row[x], start[x], count[x])) for u, x in zip(units.tolist(), np.split(by, at[1:]), strict=True)]
        out += [(u, m, x) for u, m, x in zip(rows["unit"].to_pylist(), rows["marks"].to_pylist(), rows["mark"].to_pylist(), strict=True) if m]
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate((("unit", pa.int64()), ("marks", pa.int64()), ("mark", pa.binary())))})

    return run


def _cut(sizes: Sizes, keep: bool):
    w = sizes.window

    def run(unit: pa.Table, marks: pa.Table) -> pa.Table:
        """A unit's rows without the bytes that go."""
        u = _Unit(unit, 0, w)
        edge = np.zeros(len(u.data) + 1, np.int32)
        for n, x in zip(marks["marks"].to_pylist(), marks["mark"], strict=True):
            row, start, count = unpacked(x.as_py(), 3 * n, np.int64).reshape(3, n)
            a = u.cut[row] + start
            np.add.at(edge, a, 1)
            np.add.at(edge, a + count + w - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        row = np.repeat(np.arange(len(u.size)), u.size)
        begins, ends = gone.copy(), gone.copy()
        inner = row[1:] == row[:-1]
        begins[1:] &= ~(gone[:-1] & inner)
        ends[:-1] &= ~(gone[1:] & inner)
        a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        of = row[a]
        spans = np.bincount(of, minlength=len(u.size))
        offsets = pa.array(np.concatenate([[0], np.cumsum(spans)]).astype(np.int32))
        span = pa.StructArray.from_arrays([pa.array(a - u.cut[of]), pa.array(b - u.cut[of])], ["start", "end"])
        kept = []
        for i in range(len(u.size)):
            own = u.data[u.cut[i] : u.cut[i + 1]]
            kept.append((own[~gone[u.cut[i] : u.cut[i + 1]]] if spans[i] else own).tobytes())
        out = {
            "doc_id": unit["doc_id"].combine_chunks().flatten(), "n_bytes": pa.array(u.size), "n_removed": pa.array(np.bincount(row, gone, len(u.size)).astype(np.int64)), "n_spans": pa.array(spans.astype(np.int64)),
            "spans": pa.ListArray.from_arrays(offsets, span), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
        }
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if keep else {}))

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes(), keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans (start, end of what goes, in bytes), kept_sha256, with ``keep`` also kept.

    A byte goes if a string of ``sizes.window`` bytes of its document covers it that starts earlier, too: in a document of smaller id, or before
    in its own. Texts are UTF-8 bytes, whole, however long; a null text is empty, and an empty or shorter text keeps all. Ids are
    whole numbers; null comes after all others. Rows that repeat an id go by a digest of their texts; of rows the same in both, one is first.
    What is left of a text may begin or end inside a character and is binary. An empty table gives no row; other columns are ignored,
    whatever their names.
    """
    if sizes.window < 2:
        raise ValueError("window must be 2 or more")
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    order = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    rows = docs.select(F.col(id_col).alias("doc_id"), order.alias("ord"), F.col(text_col).alias("text"))
    units = stored(rows.mapInArrow(_units(sizes.unit), f"unit long, doc_id array<{kind}>, ord array<long>, n_bytes array<long>, d0 array<long>, d1 array<long>, text binary"), "units")
    size = units.agg(F.coalesce(F.sum(F.aggregate("n_bytes", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(16, -(-size // sizes.bucket))
    counts = units.mapInArrow(_counted(buckets, sizes), "unit long, bucket long, n long, name binary, count binary, texts long, d0 binary, d1 binary, ord binary, row binary")
    replies = counts.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_judged(sizes), "unit long, bucket long, n long, flag binary, texts long, first binary")
    by_unit = units.repartition(buckets, "unit").groupBy("unit")
    pieces = by_unit.cogroup(replies.repartition(buckets, "unit").groupBy("unit")).applyInArrow(_shipped(buckets, sizes), _PIECES)
    marks = stored(pieces.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_matched(sizes), "unit long, marks long, mark binary"), "marks")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string" + (", kept binary" if keep else "")
    return by_unit.cogroup(marks.repartition(buckets, "unit").groupBy("unit")).applyInArrow(_cut(sizes, keep), schema)
