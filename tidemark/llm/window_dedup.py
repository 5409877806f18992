"""Suffix-array dedup by depth-limited radix passes: every byte inside a repeated 100-byte string goes, but for the first occurrence.

Only suffixes at content-chosen anchors are ordered, and only as deep as the threshold. In each
100-byte window the K-gram of least hash is its anchor, so equal windows have equal anchors at
equal depth, and each anchor stands for the run of windows that it anchors.

Pass 1 orders anchors by the digit of K bytes at the anchor: a group of one is unique, as are
all its windows. Pass 2 orders by the digit of all bytes of the anchor's run of windows: an
equal group is a repeated stretch, settled at once. Pass 3 takes one anchor per distinct
stretch of a group and orders blocks of eight windows by the 93 bytes that the eight share,
carrying the seven bytes on either side; groups of one end here. Pass 4 orders the single
windows by all 100 bytes: equal groups are exactly the repeated windows.

Every pass is a shuffle by digit, a sort and a stream over sorted rows that remembers one row.
Map tasks settle what is equal in their own batch first, which keeps a stretch or a window that
a third of all documents hold to one row a batch. A digit or a core that many rows of a batch
share, unequal though they are, is known to be repeated: its rows are spread over all tasks as
open, and one row stands for them at the digit, so that no task gathers what lies around a
common line.

Digits are compared as 64-bit hashes of their bytes. A wrong group of passes 1 and 2 needs two
hashes (digit and stretch) to collide at once, one of passes 3 and 4 the hash of a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm._common import discard, text_or_empty, written
from tidemark.llm.textbytes import Chunk, RangeHash, chunks, mix, ramp

K = 32
GROUP = 8
TAG_BITS = 18  # of the text's hash, to tell apart rows of one doc_id
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


def anchored_runs(c: Chunk, hashes: RangeHash, length: int) -> tuple[np.ndarray, ...]:
    """Of a chunk's windows: anchor, first start, count of each run of windows that share an anchor."""
    h = mix(hashes.rolling(K))
    bits = _U(int(len(c.data)).bit_length())
    ranked = h >> bits << bits
    ranked |= np.arange(len(h), dtype=np.uint64)
    least = _sliding_min(ranked, length - K + 1)
    sizes = np.diff(c.bounds)
    full = np.flatnonzero(sizes >= length)
    per = sizes[full] - length + 1
    starts = np.repeat(c.bounds[full], per) + ramp(per)
    at = (least[starts] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    heads = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    return at[heads], starts[heads], np.diff(np.append(heads, len(at)))


def _pack(tag: np.ndarray, start: np.ndarray, count: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """One sortable long: tag, start, count (7 bits), depth of the anchor below the first start (7 bits)."""
    return tag << 45 | start << 14 | count << 7 | depth


_ANCHORS = "digit long, stretch long, doc_id long, at long, kind byte"
PLAIN, SETTLED, SPREAD, WITNESS = 0, 1, 2, 3  # a row as it is; found already; open and dealt by its stretch; only says that a digit is repeated
MANY = 16  # rows of a batch from which a digit or core is spread


def _first_of_equal(order: np.ndarray, same: np.ndarray, doc: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Of rows in an order by key, document and place: those that repeat the first one of their key. same: the key is that of the row before."""
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    out = np.zeros(len(order), dtype=bool)
    out[order] = same & ((doc[order] != doc[first]) | (packed[order] != packed[first]))
    return out


def _emit_anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tags = batch["doc_id"].to_numpy(), batch["tag"].to_numpy().astype(np.int64)
        parts = []
        for c in chunks(batch["text"]):
            if len(c.data) < length:
                continue
            hashes = RangeHash(c.data, 3)
            at, lo, n = anchored_runs(c, hashes, length)
            row = np.searchsorted(c.bounds, lo, side="right") - 1
            run = (n << 8 | (at - lo)).astype(np.uint64) * _ODD
            parts.append((mix(hashes(at, at + K)), mix(hashes(lo, lo + n - 1 + length) ^ run), c.first + row, lo - c.bounds[row], n, at - lo))
        if not parts:
            continue
        digit, stretch, row, lo, n, depth = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc, packed = ids[row], _pack(tags[row], lo, n, depth)
        # Equal stretches of this batch: all but the first are settled here.
        by_place = np.lexsort((packed, doc))
        both = (digit * _ODD + stretch)[by_place]
        order = by_place[np.argsort(both, kind="stable")]
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (digit[order[1:]] == digit[order[:-1]]) & (stretch[order[1:]] == stretch[order[:-1]])
        settled = _first_of_equal(order, same, doc, packed)
        keep = np.flatnonzero(~settled)
        digit, stretch = digit[keep], stretch[keep]
        values, number, count = np.unique(digit, return_inverse=True, return_counts=True)
        spread = (count >= MANY)[number]
        key = np.where(spread, mix(digit * _ODD + stretch), digit)
        yield _rows(_ANCHORS, key, stretch, doc[keep], packed[keep], np.where(spread, SPREAD, PLAIN).astype(np.int8))
        common = values[count >= MANY]
        if len(common):
            none = np.zeros(len(common), np.int64)
            yield _rows(_ANCHORS, common, mix(common), none, none, np.full(len(common), WITNESS, np.int8))
        # Settled runs that touch become one range, which only rides along: a digit of its own, the count in place of the stretch.
        s = np.flatnonzero(settled)
        if len(s):
            head = np.append(True, (row[s][1:] != row[s][:-1]) | (lo[s][1:] != lo[s][:-1] + n[s][:-1]))
            of = np.flatnonzero(head)
            count = np.add.reduceat(n[s], of)
            r, start = row[s][of], lo[s][of]
            place = _pack(tags[r], start, np.zeros_like(start), np.zeros_like(start))
            yield _rows(_ANCHORS, mix(ids[r].astype(np.uint64) * _ODD + start.astype(np.uint64)), count, ids[r], place, np.full(len(r), SETTLED, np.int8))


def _rows(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


class FirstsStream:
    """Reads sorted rows batch by batch and remembers one row: where keys change, and what the first row of the current key is."""

    def __init__(self):
        self.last: tuple | None = None
        self.first: tuple | None = None

    def step(self, keys: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(row begins a new key, row's place differs from that of its key's first row)."""
        n = len(keys[0])
        new = np.zeros(n, dtype=bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        new[0] = self.last is None or any(k[0] != x for k, x in zip(keys, self.last, strict=True))
        head = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        other = np.zeros(n, dtype=bool)
        for i, p in enumerate(place):
            of_first = p[head]
            if self.first is not None:
                of_first = np.where(head < 0, self.first[i], of_first)
            other |= p != of_first
        if head[-1] >= 0:
            self.first = tuple(p[head[-1]] for p in place)
        self.last = tuple(k[-1] for k in keys)
        return new, other


class SharedStream:
    """Of rows marked in a sorted stream, those whose key has at least two marked rows; holds back one row."""

    def __init__(self):
        self.held: tuple | None = None
        self.key = None
        self.many = False

    def step(self, key: np.ndarray, columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        n = len(key)
        if not n:
            return tuple(c[:0] for c in columns)
        joins_last = self.key is not None and key[0] == self.key
        new = np.append(not joins_last, key[1:] != key[:-1])
        group = np.cumsum(new) - (0 if joins_last else 1)
        sizes = np.bincount(group)
        if joins_last:
            sizes[0] += 2 if self.many else 1
        out = sizes[group] > 1
        front = self.held if joins_last and self.held is not None else None
        last = group[-1]
        tail_open = sizes[last] == 1  # one row so far, and it is this batch's last
        kept = [np.append(np.array([f], c.dtype), c[out]) if front is not None else c[out] for f, c in zip(front or columns, columns, strict=True)]
        self.key, self.many = key[-1], bool(sizes[last] > 1)
        self.held = tuple(c[-1] for c in columns) if tail_open else None
        return tuple(kept)


_FOUND = "doc_id long, at long, n long, open boolean"


def _settle_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes 1 and 2 over rows sorted by digit, stretch, document and place."""
    firsts, shared = FirstsStream(), SharedStream()
    for batch in batches:
        digit, stretch, doc, at = (batch[c].to_numpy() for c in ("digit", "stretch", "doc_id", "at"))
        kind = batch["kind"].to_numpy()
        rides = kind == SETTLED
        if rides.any():
            yield _found(doc[rides], at[rides], stretch[rides], False)
            digit, stretch, doc, at, kind = (x[~rides] for x in (digit, stretch, doc, at, kind))
        if not len(digit):
            continue
        new, other = firsts.step((digit, stretch), (doc, at))
        repeated = ~new & other
        yield _found(doc[repeated], at[repeated], at[repeated] >> 7 & 127, False)
        known = new & (kind == SPREAD)
        yield _found(doc[known], at[known], at[known] >> 7 & 127, True)
        new &= kind != SPREAD
        open_kind, open_doc, open_at = shared.step(digit[new], (kind[new], doc[new], at[new]))
        plain = open_kind == PLAIN
        yield _found(open_doc[plain], open_at[plain], open_at[plain] >> 7 & 127, True)


def _found(doc: np.ndarray, at: np.ndarray, n: np.ndarray, is_open: bool) -> pa.RecordBatch:
    return _rows(_FOUND, doc, at, n, np.full(len(doc), is_open))


_CORES = "core long, salt byte, doc_id long, at long, left long, right long"


def _packed_bytes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """GROUP - 1 bytes from each start, first byte lowest; zero outside the data."""
    out = np.zeros(len(start), dtype=np.uint64)
    for i in range(GROUP - 1):
        p = start + i
        ok = (p >= 0) & (p < len(data))
        out |= np.where(ok, data[np.where(ok, p, 0)], 0).astype(np.uint64) << _U(8 * i)
    return out


def _emit_cores(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Blocks of GROUP windows around the core that all of them hold, for every open run of a document."""
    core = length - GROUP + 1
    for batch in batches:
        ids, tags = batch["doc_id"].to_numpy(), batch["tag"].to_numpy().astype(np.int64)
        lists = batch["runs"]
        bounds, runs = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        parts = []
        for c in chunks(batch["text"]):
            a, b = bounds[c.first], bounds[c.first + c.n]
            packed = runs[a:b]
            row = np.repeat(np.arange(c.n), np.diff(bounds[c.first : c.first + c.n + 1]))
            lo, n, depth = packed >> 14 & 0x7FFFFFFF, packed >> 7 & 127, packed & 127
            anchor = c.bounds[row] + lo + depth
            low = (depth - n + 1) // GROUP
            per = depth // GROUP - low + 1
            j = np.repeat(low, per) + ramp(per)
            of = np.repeat(np.arange(len(packed)), per)
            start = anchor[of] - GROUP * j
            i = np.arange(GROUP)
            d = GROUP * j[:, None] + i
            present = ((d <= depth[of][:, None]) & (d > (depth - n)[of][:, None])) @ (1 << i)
            hashes = RangeHash(c.data, 3)
            key = mix(hashes(start, start + core) ^ _ODD)
            r = row[of]
            place = tags[c.first + r] << 40 | (start - c.bounds[r]) << 8 | present
            parts.append((key, ids[c.first + r], place, _packed_bytes(c.data, start - GROUP + 1), _packed_bytes(c.data, start + core)))
        if parts:
            key, doc, place, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
            values, number, count = np.unique(key, return_inverse=True, return_counts=True)
            salt = np.where((count >= MANY)[number], 1 + mix(left ^ mix(right)) % _U(127), 0).astype(np.int8)
            yield _rows(_CORES, key, salt, doc, place, left, right)
            common = values[count >= MANY]
            if len(common):  # a place without windows: it only says that the core is repeated
                none = np.zeros(len(common), np.int64)
                yield _rows(_CORES, common, none.astype(np.int8), none, none, none, none)


_WINDOWS = "window long, doc_id long, at long, settled boolean"


def _split_cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 3 over rows sorted by core and salt: the single windows of cores that occur at least twice, settled where the batch holds them twice."""
    shared = SharedStream()
    for batch in batches:
        columns = tuple(batch[c].to_numpy() for c in ("core", "doc_id", "at", "left", "right"))
        salted = batch["salt"].to_numpy() > 0
        plain = shared.step(columns[0][~salted], tuple(c[~salted] for c in columns))
        core, doc, at, left, right = (np.concatenate([x, c[salted]]) for x, c in zip(plain, columns, strict=True))
        left, right = left.view(np.uint64), right.view(np.uint64)
        parts = []
        for i in range(GROUP):
            has = (at >> i & 1).astype(bool)
            # window i reaches i bytes to the left of the core and GROUP - 1 - i to its right
            before = left[has] >> _U(8 * (GROUP - 1 - i)) if i else np.zeros(has.sum(), np.uint64)
            after = right[has] & _U((1 << 8 * (GROUP - 1 - i)) - 1)
            key = mix(mix(core[has].view(np.uint64) * _ODD + _U(i)) ^ mix(before * _ODD + _U(1)) ^ mix(after * _ODD + _U(2)) * _ODD)
            parts.append((key, doc[has], (at[has] >> 8) - i))
        key, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, doc, key))
        same = np.append(False, key[order[1:]] == key[order[:-1]]) if len(order) else np.zeros(0, bool)
        settled = _first_of_equal(order, same, doc, at)
        yield _rows(_WINDOWS, np.where(settled, mix(doc.view(np.uint64) * _ODD + at.view(np.uint64)), key), doc, at, settled)


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 4 over rows sorted by window, document and place."""
    firsts = FirstsStream()
    for batch in batches:
        window, doc, at = (batch[c].to_numpy() for c in ("window", "doc_id", "at"))
        if not len(window):
            continue
        other = batch["settled"].to_numpy(zero_copy_only=False).copy()
        plain = np.flatnonzero(~other)
        if len(plain):
            other[plain] = firsts.step((window[plain],), (doc[plain], at[plain]))[1]
        # back to the packing of the runs: tag, start, count
        tag, start = at[other] >> 32, at[other] & 0xFFFFFFFF
        yield _found(doc[other], _pack(tag, start, np.ones_like(tag), np.zeros_like(tag)), np.ones_like(tag), False)


_CUT = "n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"


def _cut(batches: Iterator[pa.RecordBatch], length: int, names: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"]
        lists = batch["marks"]
        bounds, marks = lists.offsets.to_numpy().astype(np.int64), lists.values
        at, n = (marks.field(c).to_numpy() for c in ("at", "n")) if len(marks) else (np.zeros(0, np.int64),) * 2
        here, all_removed, all_spans, kept, spans = [], [], [], [], []
        for c in chunks(texts, 1 << 22):
            for d in range(c.n):
                data = c.data[c.bounds[d] : c.bounds[d + 1]]
                a, b = bounds[c.first + d], bounds[c.first + d + 1]
                start = at[a:b] >> 14 & 0x7FFFFFFF
                change = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + n[a:b] - 1 + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                here.append(len(data))
                all_removed.append(int(gone.sum()))
                all_spans.append(len(edge) // 2)
                rest = data[~gone].tobytes() if a < b else data.tobytes()
                kept.append(rest if with_text else hashlib.sha256(rest).hexdigest().encode())
                spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)] if with_text else [])
        out = [batch[c] for c in names]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        more = [pa.array(here, pa.int64()), pa.array(all_removed, pa.int64()), pa.array(all_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)]
        yield pa.RecordBatch.from_arrays(out + more, names=[*names, "n_bytes", "n_removed", "n_spans", "kept", "spans"])


def repeated_ranges(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, tag, marks): marks are runs of window starts (at, n) whose windows also start earlier."""
    if not K + GROUP <= length <= 127:
        raise ValueError(f"length must be from {K + GROUP} to 127 bytes")
    tag = F.pmod(F.hash(text_or_empty()), F.lit(1 << TAG_BITS)).alias("tag")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), tag, text_or_empty().alias("text"))
    anchors = texts.mapInArrow(lambda x: _emit_anchors(x, length), _ANCHORS)
    found = written(
        anchors.repartition("digit").sortWithinPartitions("digit", "stretch", "doc_id", "at").mapInArrow(_settle_stretches, _FOUND), "windows-found"
    )
    key = ["doc_id", F.shiftrightunsigned("at", 45).cast("int").alias("tag")]
    runs = found.where("open").groupBy(*key).agg(F.collect_list("at").alias("runs"))
    cores = texts.join(runs, ["doc_id", "tag"]).select("doc_id", "tag", "text", "runs").mapInArrow(lambda x: _emit_cores(x, length), _CORES)
    windows = cores.repartition("core", "salt").sortWithinPartitions("core", "salt").mapInArrow(_split_cores, _WINDOWS)
    single = windows.repartition("window").sortWithinPartitions("window", "doc_id", "at").mapInArrow(_repeated_windows, _FOUND)
    marks = found.where("NOT open").unionByName(single).groupBy(*key).agg(F.collect_list(F.struct("at", "n")).alias("marks"))
    out = written(marks, "windows-marks")
    discard(found)
    return out


def dedup_windows(docs: DataFrame, length: int = 100, with_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept: the UTF-8 bytes left (their SHA-256 in hex without with_text), and spans removed.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document
    of smaller doc_id, or earlier in the same one. Null text counts as empty. Rows with a null
    doc_id are returned whole and repeat nothing. Equal rows of one doc_id are one document, so
    each gets the same result; unequal ones are told apart. Extra columns stay, except those
    named n_bytes, n_removed, n_spans, kept, spans, tag or marks. kept is binary: a cut may
    part the bytes of a character.
    """
    names = {"n_bytes", "n_removed", "n_spans", "kept", "spans", "tag", "marks"}
    base = docs.drop(*[c for c in docs.columns if c in names])
    tag = F.pmod(F.hash(text_or_empty()), F.lit(1 << TAG_BITS)).alias("tag")
    marks = repeated_ranges(base.select("doc_id", "text"), length)
    empty = F.array().cast("array<struct<at:long,n:long>>")
    joined = base.select("*", tag).join(marks, ["doc_id", "tag"], "left").withColumn("marks", F.coalesce("marks", empty)).drop("tag")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", " + _CUT
    kept_names = base.columns
    return joined.select(*kept_names, "marks").mapInArrow(lambda x: _cut(x, length, kept_names, with_text), schema)
