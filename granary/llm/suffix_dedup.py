"""Removal of repeated 100-byte strings by interval expansion on a Burrows-Wheeler transform.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in
a document with a smaller key, or earlier in the same document.  Strings are judged on
the input and never cross documents.

1. Anchors.  Every run of neighbouring string starts whose smallest 20-byte hash is the
   same makes one segment (the run and the ``length - 1`` bytes after it).  The choice
   depends on nothing but the string, so equal strings lie in segments of equal anchor
   hash, wherever they are.  Blocks of documents send anchor hashes (rather, hashes of the
   60 bytes on either side that a repeat must have in common) to ranges of hashes and
   learn which of them the corpus has twice.
2. Segments with such an anchor, each distinct one once per block with its earliest place,
   meet by anchor hash.  They are joined into a text, whose Burrows-Wheeler transform is
   expanded breadth-first: intervals of the suffix order, backward-extended by one byte a
   level, fix longest common prefixes in increasing order.  Expansion stops at
   ``length``: boundaries still open then separate suffixes with a common prefix of
   ``length`` or more, so the closed ones cut the order into classes of equal strings.
   The earliest place in a class stays; the others are sent back as ranges to remove.
3. Blocks visit their texts a last time, remove what came back, and digest the rest.

A 60-byte string that very many documents share in different contexts would gather all of
them at its anchor.  Such hot strings are told to the blocks as well, and on their sides every
100-byte string is exchanged by its own hash: first as a hash, then, if the corpus has it
twice, as a segment of one start.

No stage expands copies into pairs.  Known limits: segments meet by their 20-byte seed, while hot
is judged on 60 bytes, so a seed with very many contexts below ``hot`` gathers all their segments
in the task of its range; strings on hot sides that one part of a block has twice are told apart
by 64-bit hashes alone; a row that is repeated very often, in few input partitions, is dealt to
few blocks.

Defined results: null and empty texts, and texts shorter than ``length``, lose nothing; a
null key sorts before all others; equal rows count as one document and get one result
each; rows with the same key and different texts are told apart by start alone, and a
string at the same start of both follows the first; an empty table gives an empty result; extra columns are not
read.  The key must be an integer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from granary.llm import blocks as exchange
from granary.llm import features

LENGTH = 100
BLOCK_BYTES = 8 << 20
#: Bytes of a part of a block.
PART_BYTES = 2 << 20
#: Bytes of an anchor.
SEED = 20
#: Starts in a segment at most; only periodic text reaches it.
MOST_STARTS = 2048
#: Bytes of segments whose transform is built at once.
BATCH_BYTES = 700_000
#: Occurrences (two at most in a periodic stretch) from which a shared 60-byte string counts as hot.
HOT = 1 << 15
#: A byte that UTF-8 never has; it ends each segment.
STOP = 0xFF
_NULL = np.iinfo(np.int64).min


# ---------------------------------------------------------------- anchors


def _window_least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` neighbours, by block-wise running minima."""
    n = len(values) - size + 1
    whole = np.full(-(-len(values) // size) * size, ~np.uint64(0))
    whole[: len(values)] = values
    rows = whole.reshape(-1, size)
    after = np.minimum.accumulate(rows, 1).ravel()
    before = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(before[:n], after[size - 1 : size - 1 + n])


class Segments:
    """Segments of the texts of a block part, and what each must share with a repeat.

    Every string start has an anchor: the first place in its string of the smallest seed
    hash.  Neighbouring starts with one anchor are a run; neighbouring runs with one hash
    (periodic text) are a segment.  A string contains the 60 bytes that end with its anchor,
    or the 60 that begin with it, as the anchor lies right or left in it.  ``left`` and
    ``right`` are hashes of these by run (0 where no string of the run has them), so a start
    on a side whose hash the corpus has once has no repeat.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        seeds, span = len(data) - SEED + 1, length - SEED + 1
        self.half = (length - SEED) // 2
        self.first = self.last = self.at = self.text = np.zeros(0, np.int64)
        self.value = self.left = self.right = np.zeros(0, np.uint64)
        if seeds < span:
            return
        padded = np.append(data, np.zeros(8, np.uint8))
        eight = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1)).copy().view(np.uint64).ravel()
        h = eight[:seeds] * np.uint64(0x9E3779B97F4A7C15)
        h += eight[8 : 8 + seeds] * np.uint64(0xA24BAED4963EE407)
        h += (eight[12 : 12 + seeds] >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        h = features.mix(h)
        # Hash and place in one number: the minimum is the first place of the smallest hash.
        low = np.uint64((1 << int(seeds).bit_length()) - 1)
        at = (_window_least((h & ~low) | np.arange(seeds, dtype=np.uint64), span) & low).astype(np.int64)
        cut = np.append(True, at[1:] != at[:-1])
        cut[offsets[:-1][offsets[:-1] < len(at)]] = True
        first = np.flatnonzero(cut)
        at = at[first]
        text = np.searchsorted(offsets, first, "right") - 1
        last = np.minimum(np.append(first[1:], len(cut)), offsets[text + 1] - length + 1) - 1
        good = last >= first
        first, last, at, text = first[good], last[good], at[good], text[good]
        self.first, self.last, self.at, self.text, self.value = first, last, at, text, h[at]
        up, down = features._power(len(data))
        sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]))
        self.sums, self.down = sums, down
        begin, end = np.maximum(at - self.half, 0), np.minimum(at + SEED + self.half, len(data))
        around = lambda s, e, salt: features.mix((sums[e] - sums[s]) * down[s] + np.uint64(salt))
        self.left = np.where(first <= at - self.half, around(begin, at + SEED, 1), np.uint64(0))
        self.right = np.where(last >= at - self.half, around(at, end, 2), np.uint64(0))

    def strings(self, left: np.ndarray, right: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, text, hash) of every string on the marked sides."""
        first, last, text = self._sides(left, right)
        size = last - first + 1
        start = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        if not len(start):
            return start, start, np.zeros(0, np.uint64)
        h = features.mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.uint64(3))
        return start, np.repeat(text, size), h

    def _sides(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
        middle = self.at - self.half
        first = np.where(left, self.first, np.maximum(self.first, middle))
        last = np.where(right, self.last, np.minimum(self.last, middle))
        self.kept = keep = (left | right) & (last >= first)
        return first[keep], last[keep], self.text[keep]

    def pick(self, left: np.ndarray, right: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, end, text, hash) of segments of starts on sides that ``left`` and ``right`` mark as repeated."""
        first, last, text = self._sides(left, right)
        value = self.value[self.kept]
        if not len(first):
            return first, last, text, value
        new = np.append(True, (value[1:] != value[:-1]) | (first[1:] != last[:-1] + 1) | (text[1:] != text[:-1]))
        # Periodic text is cut into pieces of bounded size.
        head = np.flatnonzero(new)
        new |= np.append(True, np.diff((first - np.repeat(first[head], np.diff(np.append(head, len(first))))) // MOST_STARTS) > 0)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(first)) - 1
        # Smallest hashes crowd at zero; ranges of hashes need them spread.
        return first[head], last[tail] + length, text[head], features.mix(value[head])


def _parts(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive parts of a block's texts."""
    out, at = [], 0
    for part in features.parts(table["text"].combine_chunks(), PART_BYTES):
        data, offsets = features.raw(part)
        out.append((at, data, offsets))
        at += len(part)
    return out


# ---------------------------------------------------------------- transform


def _ranks(packed: np.ndarray, shift: int) -> np.ndarray:
    """Dense ranks from 1 of sorted packed keys, whose low ``shift`` bits hold a position."""
    key = packed >> shift
    rank = np.empty(len(key), np.int64)
    rank[packed & ((1 << shift) - 1)] = np.cumsum(np.append(1, key[1:] != key[:-1]))
    return rank


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Order of all suffixes by their first ``length`` bytes (at least 5), by prefix doubling.

    Key and position are packed into one number while both fit, since numbers sort faster
    than they can be argsorted.
    """
    n = len(text)
    shift = int(n).bit_length()
    padded = np.append(text, np.zeros(8, np.uint8))
    key = np.zeros(n, np.int64)
    for j in range(5):
        key = key << 8 | padded[j : j + n]
    known, place, short = 5, np.arange(n), 3 * shift <= 63
    if 40 + shift <= 63:
        packed = np.sort(key << shift | place)
        rank = _ranks(packed, shift)
        order = packed & ((1 << shift) - 1)
    else:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(1, np.diff(key[order]) != 0))
    while known < length and int(rank.max()) < n:
        step = min(known, length - known)
        pair = rank << shift
        pair[: n - step] |= rank[step:]
        if short:
            packed = np.sort(pair << shift | place)
            rank = _ranks(packed, shift)
            order = packed & ((1 << shift) - 1)
        else:
            order = np.argsort(pair)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(1, np.diff(pair[order]) != 0))
        known += step
    return order


def expand(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Boundaries of suffix classes with a common prefix of ``length``: True where a class begins.

    Breadth-first backward extension: level by level, the intervals of all strings of one
    length are extended by the byte before them.  The end of an interval that no shorter
    string has ended before has a longest common prefix of that level; only such intervals
    go on.  Bytes that end segments are never extended over.
    """
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    before = text[order - 1]  # the first suffix is preceded by the last byte, an end
    rows = np.argsort(before, kind="stable").astype(kind)  # row of each suffix that has one more byte in front
    byte = before[rows]
    turn = np.append(True, byte[1:] != byte[:-1])
    step = np.empty(n, kind)
    step[rows] = np.arange(n, dtype=kind)
    ended = np.zeros(n + 1, bool)
    ended[0] = ended[n] = True
    low, high = np.array([0], kind), np.array([n], kind)
    for _ in range(length):
        if not len(low):
            break
        size = high - low
        total = int(size.sum())
        flat = np.repeat(low - (np.cumsum(size, dtype=kind) - size), size) + np.arange(total, dtype=kind)
        owner = np.repeat(np.arange(len(low), dtype=kind), size)
        if total * 6 > n:  # wide levels: walk all suffixes in extended order
            whole = np.full(n, -1, kind)
            whole[flat] = owner
            group = whole[rows]
            change = turn.copy()
            change[1:] |= group[1:] != group[:-1]
            first = np.flatnonzero(change).astype(kind)
            last = np.append(first[1:], kind(n))
            good = (group[first] >= 0) & (byte[first] != STOP)
            low, high = first[good], last[good]
        else:
            packed = np.sort(step[flat].astype(np.int64) << 32 | owner)
            place, group = packed >> 32, packed & 0xFFFFFFFF
            letter = byte[place]
            first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (letter[1:] != letter[:-1])))
            last = np.append(first[1:], len(place)) - 1
            good = letter[first] != STOP
            low, high = place[first[good]].astype(kind), (place[last[good]] + 1).astype(kind)
        new = ~ended[high]
        low, high = low[new], high[new]
        ended[high] = True
    return ended[:n]


def _earlier(segments: list[bytes], key: np.ndarray, start: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(segment, from, to): starts of distinct segments whose string also starts earlier elsewhere."""
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
    order = suffix_order(text, length)
    heads = np.flatnonzero(expand(text, order, length))
    size = np.array([len(s) for s in segments])
    begin = np.cumsum(size + 1) - (size + 1)
    starts = size - length + 1
    seg = np.repeat(np.arange(len(segments)), starts)
    within = np.arange(len(seg)) - (np.cumsum(starts) - starts)[seg]
    place = begin[seg] + within
    # Places in the corpus as one number: documents in order, then starts.
    none = np.iinfo(np.int64).max
    code = np.full(len(text), none)
    code[place] = (np.unique(key, return_inverse=True)[1][seg] << 40) + start[seg] + within
    code = code[order]
    least = np.repeat(np.minimum.reduceat(code, heads), np.diff(np.append(heads, len(code))))
    late = np.zeros(len(text), bool)
    late[order[(code > least) & (code < none)]] = True
    # Neighbouring starts of one segment make one range.
    at = np.flatnonzero(late[place])
    if not len(at):
        return []
    cut = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (seg[at[1:]] != seg[at[:-1]])))
    end = np.append(cut[1:], len(at)) - 1
    return list(zip(seg[at[cut]].tolist(), within[at[cut]].tolist(), (within[at[end]] + 1).tolist(), strict=True))


def _runs(row: np.ndarray, start: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(row, from, to) of neighbouring string starts that are sorted by row and start."""
    if not len(row):
        return []
    cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)))
    end = np.append(cut[1:], len(row)) - 1
    return list(zip(row[cut].tolist(), start[cut].tolist(), (start[end] + length).tolist(), strict=True))


# ---------------------------------------------------------------- Spark

_SENT = "part int, block int, hashes binary, many binary"
_TOLD = "block int, kind int, hashes binary, hot binary"
_MET = "part int, block int, value binary, key binary, row binary, start binary, size binary, bytes binary, ranges binary"
_BACK = "block int, ranges binary"


def _visit(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block's rows, equal rows once; their keys (null: smallest); how often each is there."""
    table = table.combine_chunks()
    keys = pc.cast(table["key"], pa.int64()).fill_null(_NULL).to_numpy()
    texts = table["text"]
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[1:] == keys[:-1]) & (pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False) if len(keys) > 1 else False)
    rows = np.flatnonzero(~same)
    return table.take(pa.array(rows)), keys[rows], np.diff(np.append(rows, len(keys)))


def _known(table: pa.Table, kind: int, column: str) -> np.ndarray:
    """Sorted hashes that the rows of one kind tell a block."""
    mine = table.filter(pc.equal(table["kind"], kind))
    return np.sort(np.concatenate([*(exchange.unpack_sorted(x.as_py()) for x in mine[column]), np.zeros(0, np.uint64)]))


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among sorted ``known`` ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def remove_repeats(df: DataFrame, key: str, text: str, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every whole text.

    Sides of segments whose shared string occurs ``hot`` times or more are exchanged string by
    string, so that no such string gathers its contexts at one anchor.
    """
    dealt, n, _, opened = exchange.deal(df, key, text, block_bytes)

    def sent(block: int, hashes: list[np.ndarray]) -> pa.Table:
        h = np.sort(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        first = exchange.first_of_runs(h)
        many = np.diff(np.append(first, len(h)))[h[first] != 0]
        h = h[first][h[first] != 0]
        cuts = exchange.range_cuts(h, n)
        spans = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({
            "part": pa.array(np.arange(n, dtype=np.int32)), "block": pa.array(np.full(n, block, np.int32)),
            "hashes": pa.array([exchange.pack_sorted(h[s]) for s in spans], pa.binary()), "many": pa.array([exchange.pack(many[s]) for s in spans], pa.binary()),
        })

    def anchors(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        table, _, _ = _visit(opened(table))
        found = []
        for _, data, offsets in _parts(table):
            s = Segments(data, offsets, length)
            for h in (s.left, s.right) if len(s.first) else ():
                # A periodic stretch is one context: what repeats itself there need be told twice, not oftener.
                again = np.append(False, (h[1:] == h[:-1]) & (s.text[1:] == s.text[:-1]))
                found.append(h[~(again & np.append(False, again[:-1]))])
        return sent(block, found)

    def strings(table: pa.Table, told: pa.Table) -> pa.Table:
        hottest = _known(told, 0, "hot")
        if not table.num_rows or not len(hottest):
            return sent(0, []).slice(0, 0)
        block = table["block"][0].as_py()
        table, _, _ = _visit(opened(table))
        parts = [Segments(data, offsets, length) for _, data, offsets in _parts(table)]
        return sent(block, [s.strings(_among(hottest, s.left), _among(hottest, s.right), length)[2] for s in parts if len(s.first)])

    def repeated(table: pa.Table, kind: int) -> pa.Table:
        owners = table["block"].to_numpy().astype(np.int64)
        sent = [exchange.unpack_sorted(x.as_py()) for x in table["hashes"]]
        many = np.concatenate([exchange.unpack(x.as_py()) for x in table["many"]])
        h, block = np.concatenate(sent), np.repeat(owners, [len(s) for s in sent])
        by = np.argsort(h, kind="stable")
        h, many, block = h[by], many[by], block[by]
        first = exchange.first_of_runs(h)
        total = np.repeat(np.add.reduceat(many, first), np.diff(np.append(first, len(h)))) if len(h) else many
        columns = []
        for mine in (total > 1, (total >= hot) & (kind == 0)):
            mine = np.flatnonzero(mine)
            mine = mine[np.argsort(block[mine], kind="stable")]
            cuts = np.searchsorted(block[mine], np.arange(n + 1))
            columns.append(pa.array([exchange.pack_sorted(h[mine[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
        return pa.table({"block": pa.array(np.arange(n, dtype=np.int32)), "kind": pa.array(np.full(n, kind, np.int32)), "hashes": columns[0], "hot": columns[1]})

    def meet(table: pa.Table, told: pa.Table) -> pa.Table:
        columns: dict[str, list] = {c.split()[0]: [] for c in _MET.split(", ")}
        if table.num_rows:
            block = table["block"][0].as_py()
            table, keys, _ = _visit(opened(table))
            twice, hottest, again = _known(told, 0, "hashes"), _known(told, 0, "hot"), _known(told, 1, "hashes")
            seen: dict[tuple[int, bytes], tuple[int, int, int]] = {}
            late: list[tuple[int, int, int]] = []
            for row0, data, offsets in _parts(table):
                s, raw = Segments(data, offsets, length), data.tobytes()
                if not len(s.first):
                    continue
                hot_left, hot_right = _among(hottest, s.left), _among(hottest, s.right)
                begin, end, text, value = s.pick(_among(twice, s.left) & ~hot_left, _among(twice, s.right) & ~hot_right, length)
                start, owner = (begin - offsets[text]).tolist(), keys[row0 + text].tolist()
                for a, b, t, v, at, k in zip(begin.tolist(), end.tolist(), text.tolist(), value.tolist(), start, owner, strict=True):
                    name, place = (v, raw[a:b]), (k, at, row0 + t)
                    had = seen.setdefault(name, place)  # rows come in key order, so this is the earliest
                    if had[:2] < place[:2]:
                        late.append((place[2], place[1], place[1] + b - a))
                # Strings on hot sides, one by one; those that this part has had already go at once.
                begin, text, value = s.strings(hot_left, hot_right, length)
                mine = _among(again, value)
                begin, text, value = begin[mine], text[mine], value[mine]
                by = np.lexsort((begin, value))  # places of a part ascend, so the first of a hash is the earliest
                head = exchange.first_of_runs(value[by])
                first = np.repeat(by[head], np.diff(np.append(head, len(by))))
                place = begin - offsets[text]
                own = keys[row0 + text]
                gone = by[(own[first] != own[by]) | (place[first] != place[by])]
                gone = gone[np.argsort(begin[gone], kind="stable")]
                late += _runs(row0 + text[gone], place[gone], length)
                for i in by[head].tolist():
                    a = int(begin[i])
                    name, here = (int(value[i]), raw[a : a + length]), (int(own[i]), int(place[i]), row0 + int(text[i]))
                    if seen.setdefault(name, here)[:2] < here[:2]:
                        late.append((here[2], here[1], here[1] + length))
            value = np.array([k[0] for k in seen], np.uint64)
            texts = [k[1] for k in seen]
            places = np.array(list(seen.values()), np.int64).reshape(-1, 3)
            by = np.argsort(value, kind="stable")
            cuts = exchange.range_cuts(value[by], n)
            own = np.array(late, np.int64).reshape(-1, 3)
            for p in range(n):
                mine = by[cuts[p] : cuts[p + 1]]
                ranges = own if p == block else own[:0]
                if not len(mine) and not len(ranges):
                    continue
                row = {
                    "part": p, "block": block, "value": exchange.pack(value[mine].view(np.int64)), "key": exchange.pack(places[mine, 0]), "row": exchange.pack(places[mine, 2]), "start": exchange.pack(places[mine, 1]),
                    "size": exchange.pack(np.array([len(texts[i]) for i in mine], np.int64)), "bytes": b"".join(texts[i] for i in mine), "ranges": exchange.pack(ranges.ravel()),
                }
                for c, v in row.items():
                    columns[c].append(v)
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(columns.items(), kinds, strict=True)})

    def compare(table: pa.Table) -> pa.Table:
        back: dict[int, list[np.ndarray]] = {}
        value, key, row, start, block, texts = [], [], [], [], [], []
        for r in table.to_pylist():
            back.setdefault(r["block"], []).append(exchange.unpack(r["ranges"]))
            size = exchange.unpack(r["size"])
            ends = np.cumsum(size)
            texts += [r["bytes"][a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
            for to, name in ((value, "value"), (key, "key"), (row, "row"), (start, "start")):
                to.append(exchange.unpack(r[name]))
            block.append(np.full(len(size), r["block"], np.int64))
        value, key, row, start, block = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (value, key, row, start, block))
        # The same segment from several blocks: all but the earliest go whole.
        out: list[tuple[int, int, int, int]] = []
        groups: dict[tuple[int, bytes], int] = {}
        for i in np.lexsort((start, key)).tolist():
            head = groups.setdefault((int(value[i]), texts[i]), i)
            if head != i and (key[head], start[head]) != (key[i], start[i]):
                out.append((int(block[i]), int(row[i]), int(start[i]), int(start[i]) + len(texts[i])))
        distinct = np.array(sorted(groups.values(), key=lambda i: (value[i], key[i], start[i])), np.int64)
        sizes = np.array([len(texts[i]) for i in distinct], np.int64)
        at = 0
        while at < len(distinct):
            # Segments of one anchor stay together; batches grow to a bounded size.
            stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_BYTES)))
            while stop < len(distinct) and value[distinct[stop]] == value[distinct[stop - 1]]:
                stop += 1
            here = distinct[at:stop]
            for s, a, b in _earlier([texts[i] for i in here], key[here], start[here], length):
                i = here[s]
                out.append((int(block[i]), int(row[i]), int(start[i]) + a, int(start[i]) + b - 1 + length))
            at = stop
        for b, r, s, e in out:
            back.setdefault(b, []).append(np.array([r, s, e], np.int64))
        return pa.table({"block": pa.array(list(back), pa.int32()), "ranges": pa.array([exchange.pack(np.concatenate(v)) for v in back.values()], pa.binary())})

    def digest(table: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        table = opened(table)
        if table.num_rows:
            table, _, copies = _visit(table)
            ranges = np.concatenate([exchange.unpack(x.as_py()) for x in told["ranges"]] + [np.zeros(0, np.int64)]).reshape(-1, 3)
            ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
            cuts = np.searchsorted(ranges[:, 0], np.arange(table.num_rows + 1))
            keys = table["key"].to_pylist()
            for i, x in enumerate(table["text"].combine_chunks().cast(pa.large_binary())):
                content = x.as_py()
                mine = ranges[cuts[i] : cuts[i + 1], 1:]
                removed = spans = 0
                digester = hashlib.sha256()
                last = 0
                if len(mine):
                    reach = np.maximum.accumulate(mine[:, 1])
                    begin = np.flatnonzero(np.append(True, mine[1:, 0] > reach[:-1]))
                    for a, b in zip(mine[begin, 0].tolist(), reach[np.append(begin[1:], len(mine)) - 1].tolist(), strict=True):
                        digester.update(content[last:a])
                        removed, spans, last = removed + b - a, spans + 1, b
                digester.update(content[last:])
                rows += [(keys[i], len(content), removed, spans, digester.hexdigest())] * int(copies[i])
        kinds = [table.schema.field("key").type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table({c: pa.array(v, t) for c, v, t in zip((key, "n_bytes", "n_removed", "n_spans", "kept_sha256"), columns, kinds, strict=True)})

    by_part = lambda df, kind: exchange.to_owner(df, "part", n).groupBy("part").applyInArrow(lambda t: repeated(t, kind), _TOLD)
    told = by_part(dealt.groupBy("block").applyInArrow(anchors, _SENT), 0)
    again = by_part(dealt.groupBy("block").cogroup(exchange.to_owner(told, "block", n).groupBy("block")).applyInArrow(strings, _SENT), 1)
    met = dealt.groupBy("block").cogroup(exchange.to_owner(told.unionByName(again), "block", n).groupBy("block")).applyInArrow(meet, _MET)
    back = exchange.to_owner(met, "part", n).groupBy("part").applyInArrow(compare, _BACK)
    schema = f"`{key}` {dict(df.dtypes)[key]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return dealt.groupBy("block").cogroup(exchange.to_owner(back, "block", n).groupBy("block")).applyInArrow(digest, schema)
