"""Language-model scoring with a probabilistic suffix tree over words.

A context of up to ``depth`` words is grown level by level: every word sequence that occurs
``least`` times or more in training is counted, whatever the corpus is. Counts cover all
training texts. A context stays in the tree if its next-word distribution diverges from that of
its suffix: the log-likelihood gained must exceed the description length of its transitions.
Smoothing is absolute discounting towards the longest retained suffix, down to the smoothed
unigram distribution. A text's score follows the longest retained suffix of what came before each
word.

Texts become word hashes once. Every token then goes once through a shuffle, with the words before
it and its row's number, to the reducer of the word before it. All contexts that end in one word,
their transitions and the suffixes of these are there together, so a reducer counts, judges and
scores them level by level in numpy, and returns sums by row. Tasks send reducers blocks of tokens as
byte columns; one slice of the words before goes through the shuffle at a time, for less disk.

Hot words, those of ``HOT`` occurrences or a millionth of all, would crowd one reducer. What follows
them first goes to reducers by sequence, where it is counted; the driver gets one sum a hot context,
and then knows which stay. Only then do these tokens go on, by the shortest context that is not hot.

What a context adds to a text's score is one number a token: the log of the token's probability over
that in the suffix, or of the mass that the context passes on. The counts of frequent words, at most
``1 / word_share``, are broadcast; tokens of rarer words that occur ``least`` times are counted
in the shuffle before, and bring their counts along.

Words are 48-bit hashes, sequences 64-bit ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bitmap, bitmap_bits, in_bitmap, lean, read_documents
from .text import binary_column, chunks, mix64, row_sums, string_buffers, words

_U = np.uint64
_WORD_BYTES = 6
_WORD_MASK = _U((1 << 48) - 1)
END = _U(0x51ED270B35A1B2C7) & _WORD_MASK
DISCOUNT = 0.5
#: Parts of the contexts, a power of two, that go through a shuffle one after the other, for less disk at a time.
SLICES = 8
#: Tokens that a reducer takes, about, and those that a task gathers before it deals them out.
TASK_ROWS, FLUSH = 1 << 18, 1 << 18
#: Tokens in a block that is kept.
BLOCK = 1 << 16
#: Most frequent words in an index of hashes.
INDEXED = 1 << 16
#: Occurrences from which a sequence is hot, or a share of all tokens where that is more.
HOT, HOT_SHARE = 3 << 19, 1e-6
_PAIR = _U(0xD6E8FEB86659FD93)


class HashIndex:
    """Position of each of some distinct uint64 keys, -1 for others; open addressing in numpy."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(int(np.ceil(np.log2(max(keys.size, 1) * 3))), 4)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(keys.size, dtype=np.int32)
        slot = self._slot(keys)
        while left.size:
            free = left[self.at[slot] < 0]
            self.at[slot[self.at[slot] < 0]] = free
            done = self.at[slot] == left
            self.keys[slot[done]] = keys[left[done]]
            left, slot = left[~done], (slot[~done] + 1) & (self.keys.size - 1)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        slot = self._slot(x)
        at = self.at[slot]
        out = np.where(self.keys[slot] == x, at, -1)
        left = np.flatnonzero((at >= 0) & (out < 0))
        while left.size:
            slot[left] = (slot[left] + 1) & (self.keys.size - 1)
            s = slot[left]
            hit = (self.keys[s] == x[left]) & (self.at[s] >= 0)
            out[left[hit]] = self.at[s[hit]]
            left = left[(self.at[s] >= 0) & ~hit]
        return out


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's word hashes, six bytes a word, followed by the end token."""
    for batch in batches:
        for lo, hi, buf, offs in chunks(batch.column(2)):
            w = words(buf, offs)
            x = np.insert(w.hashes() & _WORD_MASK, w.offs[1:], END)
            packed = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :_WORD_BYTES]).reshape(-1)
            at = w.offs + np.arange(w.offs.size)
            out = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), binary_column(packed, at * _WORD_BYTES)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "tokens"])


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, row offsets) for runs of whole rows."""
    for lo, hi, buf, offs in chunks(column):
        yield lo, hi, _wide(buf), offs // _WORD_BYTES


def _wide(packed: np.ndarray) -> np.ndarray:
    """Words of six bytes each, one after the other, as integers."""
    n = packed.size // _WORD_BYTES
    padded = np.append(packed, np.zeros(8 - _WORD_BYTES, np.uint8))
    return np.ndarray((n,), np.uint64, padded, 0, (_WORD_BYTES,)) & _WORD_MASK


def _join(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Keys of sequences from their first words and the keys of what follows."""
    return mix64(c * _PAIR + t)


class _Counter:
    """Adds up keys, and keeps one value of each further column a key; what exceeds ``most`` distinct ones is handed on early."""

    def __init__(self, emit: Callable[..., Iterator[pa.RecordBatch]], most: int = 1 << 18):
        self.emit, self.most, self.parts, self.size = emit, most, [], 0

    def add(self, keys: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, np.ones(keys.size, np.int64), *more))
        self.size += keys.size
        if self.size > 3 * self.most:
            self._merge()
            if self.size > self.most:
                yield from self.flush()

    def _merge(self) -> None:
        if self.size:
            k, n, *more = (np.concatenate(x) for x in zip(*self.parts))
            order, first = _grouped(k)
            one = order[first]
            self.parts = [(k[one], np.add.reduceat(n[order], first), *(x[one] for x in more))]
        self.size = sum(x[0].size for x in self.parts)

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        if self.size:
            yield from self.emit(*self.parts[0])
        self.parts, self.size = [], 0


def _rows(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, columns[0].size, 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in columns], names=names)


def _values(blocks: list[pa.Array], kind: type) -> np.ndarray:
    """All values of some columns of blocks, one after the other."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(string_buffers(b)[0].tobytes(), kind) for b in blocks)])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Grouping goes by upper bits.
    total = _Counter(lambda k, n: _rows(["h", "n"], (k >> _U(16)).view(np.int64), n))
    for batch in batches:
        for _, _, x, _ in _tokens(batch.column(0)):
            yield from total.add(x << _U(16))
    yield from total.flush()


_BLOCKS = "p int, level int, base long, rows binary, v binary"


def _row(depth: int) -> np.dtype:
    """A token after the words before it, zero where the text has no more, and its row's number in its file, doubled, plus one if it is held out."""
    return np.dtype([("w", np.uint8, (depth + 1, _WORD_BYTES)), ("r", np.uint32)])


def _unpacked(rows: np.ndarray) -> list[np.ndarray]:
    """The token and the words before it, the nearest first, as one array each."""
    return [_word(rows, k) for k in range(rows["w"].shape[1])]


def _word(rows: np.ndarray, k: int) -> np.ndarray:
    """The word ``k`` places before each token, the token itself for 0."""
    at = (rows["w"].shape[1] - 1 - k) * _WORD_BYTES
    # The two bytes too many are those of the next field.
    return np.ndarray((rows.size,), np.uint64, np.ascontiguousarray(rows).view(np.uint8), at, (rows.itemsize,)) & _WORD_MASK


def _taken(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows at some places, moved as bytes: field by field takes twenty times as long."""
    return rows.view(f"V{rows.itemsize}").take(at).view(rows.dtype)


def _part(keys: np.ndarray) -> np.ndarray:
    return mix64(keys + _U(1))


def _deal(rows: np.ndarray, keys: np.ndarray, parts: int, level: int, base: int | np.ndarray | None, v: np.ndarray | None = None) -> pa.RecordBatch:
    """Blocks of rows, and of the numbers ``v`` of each, one for each part of the hashed keys that occurs; ``base`` is the file of all or, after the numbers, of each."""
    if isinstance(base, np.ndarray):
        base, v = -1, np.column_stack([v, base])
    part = (_part(keys) >> _U(32)) * _U(parts) >> _U(32)
    # Numbers of two bytes are sorted by counting.
    order = np.argsort(part.astype(np.uint16), kind="stable") if parts <= 1 << 16 else np.argsort(part)
    size = np.bincount(part.astype(np.int64), minlength=1)
    some = np.flatnonzero(size)
    offs = np.append(0, np.cumsum(size[some]))
    n = some.size
    more = pa.nulls(n, pa.binary()) if v is None else binary_column(v[order].reshape(-1), offs * (v.size // max(rows.size, 1)))
    out = [pa.array(some.astype(np.int32)), pa.array(np.full(n, level, np.int32)), pa.array([base] * n, pa.int64())]
    return pa.RecordBatch.from_arrays([*out, binary_column(_taken(rows, order).view(np.uint8), offs * rows.itemsize), more], names=["p", "level", "base", "rows", "v"])


def _blocks(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[int, int, int | np.ndarray | None, np.ndarray, np.ndarray | None]]:
    """(part, level, base, rows, numbers by row) of each block."""
    kind = _row(depth)
    for batch in batches:
        for p, level, base, rows, v in zip(*(batch.column(i) for i in range(5))):
            base, rows = base.as_py(), np.frombuffer(rows.as_buffer(), kind)
            v = np.frombuffer(v.as_buffer(), np.float64).reshape(rows.size, -1) if v.is_valid else None
            if base == -1:
                base, v = v[:, -1].astype(np.int64), v[:, :-1]
            yield p.as_py(), level.as_py(), base, rows, v


def _gathered(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(level, [rows, their numbers in the table, numbers]) of all blocks of one part and level; a number is nan where a block has none."""
    got = {}
    for p, level, base, rows, v in _blocks(batches, depth):
        got.setdefault((p, level), []).append((rows.view(np.uint8), base, rows.size, v))
    while got:
        (_, level), some = got.popitem()
        rows, base, size, v = zip(*some)
        rows = np.concatenate(rows).view(_row(depth))
        rid = (rows["r"] >> 1).astype(np.int64)
        rid += np.concatenate([np.broadcast_to(x, n) for x, n in zip(base, size)]) << 33
        width = max((x.shape[1] for x in v if x is not None), default=1)
        out = [rows, rid, np.concatenate([np.full((n, width), np.nan) if x is None else x for n, x in zip(size, v)])]
        del some, rows, rid, v
        # Who takes the arrays may free them.
        yield level, out


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each value among sorted keys, and whether it is one of them."""
    if not keys.size:
        return np.zeros(x.size, np.int64), np.zeros(x.size, bool)
    at = np.minimum(np.searchsorted(keys, x), keys.size - 1)
    return at, keys[at] == x


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal values follow one another, and where each value begins in it.

    Values with their positions as lower bits are sorted, which is much faster than an argsort.
    """
    bits = _U(max(int(x.size - 1).bit_length(), 1))
    packed = np.sort((x >> bits << bits) | np.arange(x.size, dtype=np.uint64))
    order = (packed & ((_U(1) << bits) - _U(1))).astype(np.int64)
    packed >>= bits
    y = x[order]
    other = y[1:] != y[:-1]
    mixed = packed[1:][other & (packed[1:] == packed[:-1])]
    if mixed.size:
        # Different values that agree in their upper bits.
        at = np.flatnonzero(_find(np.unique(mixed), packed)[1])
        order[at] = order[at][np.argsort(y[at])]
        y = x[order]
        other = y[1:] != y[:-1]
    return order, np.flatnonzero(np.append(np.ones(min(x.size, 1), bool), other))


def _is_rare(rare: tuple[np.ndarray, int, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Words with a bit in the bitmap, common ones left out: every rare word, and a few that need no count."""
    bits, log_bits, common = rare
    out = in_bitmap(bits, x, log_bits)
    at = np.flatnonzero(out)
    out[at] = ~_find(common, x[at])[1]
    return out


def _windows(shared, depth: int, take: str, slice_no: int, parts: int):
    """Blocks of the tokens of one kind: ``rare`` ones by token; ``hot`` ones, which follow a hot word, by sequence; others of one slice, by the word before."""

    def chosen(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        hot, rare = shared.value
        if take == "rare":
            return np.flatnonzero(_is_rare(rare, x))
        before = _find(hot[0]["keys"], x)[1] if take == "hot" else _part(x) & _U(SLICES - 1) == slice_no
        # The last word of a text comes before none.
        before[at[1:] - 1] = False
        pos = np.flatnonzero(before) + 1
        if take != "hot" and hot[0]["keys"].size:
            pos = pos[~_find(hot[0]["keys"], x[pos - 1])[1]]
        return pos if rare is None else pos[~_is_rare(rare, x[pos])]

    def windows(packed: np.ndarray, at: np.ndarray, pos: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The rows of tokens without their texts' numbers: stretches of the packed words."""
        kind = _row(depth)
        padded = np.zeros(packed.size + depth * _WORD_BYTES + kind["r"].itemsize, np.uint8)
        padded[depth * _WORD_BYTES :][: packed.size] = packed
        rows = np.ndarray((packed.size // _WORD_BYTES,), f"V{kind.itemsize}", padded, 0, (_WORD_BYTES,)).take(pos).view(kind)
        place = pos - at[text]
        early = np.flatnonzero(place < depth)
        for k in range(1, depth + 1):
            rows["w"][early[place[early] < k], depth - k] = 0
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            for base, own in held.items():
                rows = np.concatenate([x.view(np.uint8) for x in own]).view(_row(depth))
                key = _route(_unpacked(rows), rows, shared.value[0]) if take == "hot" else _word(rows, 0 if take == "rare" else 1)
                yield _deal(rows, key, parts, 1, base)

        held, size = {}, 0
        for batch in batches:
            rid, out = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, packed, at in chunks(batch.column(2)):
                x, at = _wide(packed), at // _WORD_BYTES
                pos = chosen(x, at)
                if not pos.size:
                    continue
                text = np.repeat(np.arange(hi - lo), np.diff(at))[pos]
                rows = windows(packed, at, pos, text)
                rows["r"] = ((rid[lo:hi] & ((1 << 33) - 1)) * 2 + out[lo:hi])[text]
                bases = rid[lo:hi] >> 33
                some = np.unique(bases).tolist()
                for base in some:
                    own = rows if len(some) == 1 else _taken(rows, np.flatnonzero(bases[text] == base))
                    if own.size:
                        held.setdefault(base, []).append(own)
                size += pos.size
                if size >= FLUSH:
                    yield from flush()
                    held, size = {}, 0
        if held:
            yield from flush()

    return run


def _route(w: list[np.ndarray], rows: np.ndarray, hot: list[dict]) -> np.ndarray:
    """The key of the shortest sequence before and with each token that is not hot; any key where all are."""
    j, key = w[0], np.zeros(rows.size, np.uint64)
    left = np.ones(rows.size, bool)
    for k in range(1, len(w)):
        j = _join(w[k], j)
        own = left & (w[k] != 0)
        warm = _find(hot[k]["keys"], j)[1]
        key[own] = j[own]
        key[left & (warm | (w[k] == 0))] = 0
        left = own & warm
    odd = np.flatnonzero(key == 0)
    key[odd] = mix64(rows["r"][odd].astype(np.uint64) + odd.astype(np.uint64) * _PAIR)
    return key


def _recounted(depth: int, parts: int):
    """The rows of rare tokens with their tokens' counts, those that follow no word left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (rows, rid, _) in _gathered(batches, depth):
            w = _unpacked(rows)
            order, first = _grouped(_part(w[0]))
            n = np.add.reduceat(1 - (rows["r"][order] & 1).astype(np.int64), first).astype(np.float64)
            count = np.empty(rows.size)
            count[order] = np.repeat(n, np.diff(np.append(first, rows.size)))
            own = np.flatnonzero(w[1] != 0)
            for at in range(0, own.size, BLOCK):
                some = own[at : at + BLOCK]
                yield _deal(_taken(rows, some), w[1][some], parts, 1, rid[some] >> 33, count[some][:, None])

    return run


def _again(shared, depth: int, take: str, slice_no: int, parts: int):
    """The rows of rare tokens, dealt as ``_windows`` deals the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, _ = shared.value
        for _, _, base, rows, v in _blocks(batches, depth):
            w = _unpacked(rows)
            own = _find(hot[0]["keys"], w[1])[1]
            if take != "hot":
                own = ~own & (_part(w[1]) & _U(SLICES - 1) == slice_no)
            if own.any():
                w, rows, base, v = [x[own] for x in w], _taken(rows, np.flatnonzero(own)), base[own], v[own]
                yield _deal(rows, _route(w, rows, hot) if take == "hot" else w[1], parts, 1, base, v)

    return run


def _hot_counts(shared, length: int):
    """Counts of the sequences of some words whose two parts are hot, with the keys of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = _Counter(lambda k, n, c, t: _rows(["s", "n", "c", "t"], k.view(np.int64), n, c.view(np.int64), t.view(np.int64)))
        for batch in batches:
            for _, _, x, at in _tokens(batch.column(0)):
                place = np.arange(x.size) - np.repeat(at[:-1], np.diff(at))
                h = x
                for k in range(1, length - 1):
                    h = _join(np.concatenate([x[:k], x[:-k]]), h)
                warm = _find(known, h)[1]
                pos = np.flatnonzero(warm[1:] & warm[:-1]) + 1
                pos = pos[place[pos] >= length - 1]
                yield from total.add(_join(x[pos - length + 1], h[pos]), h[pos - 1], h[pos])
        yield from total.flush()

    return run


def _level_of(w: list[np.ndarray], hot: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many of each token's contexts are hot, from the shortest on, and their positions among the hot sequences."""
    c, left, places = w[1], np.ones(w[0].size, bool), []
    level = np.zeros(w[0].size, np.int64)
    for k in range(1, len(w)):
        if k > 1:
            c = _join(w[k], c)
        at, found = _find(hot[k - 1]["keys"], c)
        left = left & found & (w[k] != 0)
        places.append(at)
        level += left
    return level, places


def _hot_counted(shared, depth: int, least: int):
    """The rows that follow hot words with the counts of their sequences after hot contexts, before these those of rare tokens; and, without a base, a row for each such sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, _ = shared.value
        for _, (rows, rid, v) in _gathered(batches, depth):
            w = _unpacked(rows)
            train = 1 - (rows["r"] & 1).astype(np.int64)
            level, _ = _level_of(w, hot)
            counts, j = v, w[0]
            for k in range(1, int(level.max()) + 1):
                j = _join(w[k], j)
                n = np.zeros(rows.size)
                at, known = _find(hot[k]["keys"], j)
                known &= level >= k
                n[known] = hot[k]["n"][at[known]]
                own = np.flatnonzero((level >= k) & ~known)
                counts = np.concatenate([counts, n[:, None]], axis=1)
                if not own.size:
                    continue
                order, first = _grouped(j[own])
                m = np.add.reduceat(train[own][order], first)
                counts[own[order], k] = np.repeat(m, np.diff(np.append(first, own.size)))
                one = own[order[first[m >= least]]]
                if one.size:
                    yield _deal(_taken(rows, one), np.zeros(one.size, np.uint64), 1, k, None, counts[one])
            for k in np.unique(level).tolist():
                for rare in (False, True):
                    own = np.flatnonzero((level == k) & (np.isnan(v[:, 0]) ^ rare))
                    for at in range(0, own.size, BLOCK):
                        some = own[at : at + BLOCK]
                        yield _deal(_taken(rows, some), np.zeros(some.size, np.uint64), 1, k, rid[some] >> 33, counts[some, 1 - rare : k + 1])

    return run


def _chances(words: tuple, w: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Smoothed probabilities of tokens, by their counts where these are given."""
    keys, n, floor = words
    ask = np.isnan(count)
    # Equal words are looked up once, in order: places far apart in the keys are slow to reach.
    order, first = _grouped(w[ask] << _U(16))
    x = w[ask][order[first]]
    at, known = _find(keys, x)
    out = count.copy()
    found = np.empty(order.size)
    found[order] = np.repeat(np.where(known, n[at], 0) if keys.size else np.zeros(x.size), np.diff(np.append(first, order.size)))
    out[ask] = found
    return (out + 0.1) / floor


def _through_hot(words: tuple, hot: list[dict], w: list[np.ndarray], v: np.ndarray, levels: int, least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each token's probability after its hot contexts, how much that adds to the score, and the contexts' positions."""
    _, places = _level_of(w, hot)
    if v.shape[1] == levels:
        v = np.insert(v, 0, np.nan, axis=1)
    below, more = _chances(words, w[0], v[:, 0]), np.zeros(w[0].size)
    for k in range(1, levels + 1):
        h, at, n = hot[k - 1], places[k - 1], v[:, k]
        often, stays, rest = n >= least, h["stays"][at], h["rest"][at]
        near = np.where(often, (n - DISCOUNT) / h["n"][at] + rest * below, below)
        more += np.where(stays, np.log10(np.where(often, near / below, rest)), 0.0)
        below = np.where(stays, near, below)
    return below, more, places


def _hot_sums(shared, depth: int, level: int, least: int, gains: bool):
    """For each hot context of some words: its transitions and their occurrences, or what they gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot = shared.value
        for _, _, _, rows, v in _blocks(batches, depth):
            w = _unpacked(rows)
            n = v[:, level]
            if gains:
                below, _, places = _through_hot(words, hot, w, v[:, :level], level - 1, least)
                at = places[level - 1]
                h = hot[level - 1]
                x = n * np.log(((n - DISCOUNT) / h["n"][at] + h["rest"][at] * below) / below)
            else:
                at, x = _level_of(w, hot)[1][level - 1], n
            own, back = np.unique(at, return_inverse=True)
            yield from _rows(["i", "k", "x"], own, np.bincount(back, minlength=own.size), np.bincount(back, weights=x, minlength=own.size))

    return run


def _judge_hot(spark: SparkSession, rows: DataFrame, words: tuple, hot: list[dict], least: int, cost: float) -> None:
    """Which hot contexts stay, and what they leave to their suffixes; other transitions are ``rows``, hot ones are hot sequences."""
    depth = len(hot) - 1
    smooth = _chances(words, hot[0]["keys"], hot[0]["n"].astype(np.float64))
    for k in range(1, depth + 1):
        h, kid = hot[k - 1], hot[k]
        if not h["keys"].size:
            break
        own = rows.filter(F.col("level") == k)

        def sums(gains: bool) -> tuple[np.ndarray, np.ndarray]:
            shared = spark.sparkContext.broadcast((words, hot))
            count, x = np.zeros(h["keys"].size), np.zeros(h["keys"].size)
            got = own.mapInArrow(lean(_hot_sums(shared, depth, k, least, gains)), "i long, k long, x double").groupBy("i").agg(F.sum("k").alias("k"), F.sum("x").alias("x"))
            i, *sums = _fetched(got)
            count[i], x[i] = sums
            shared.destroy()
            return count, x

        kids, seen = sums(False)
        at, suffix = _find(h["keys"], kid["c"])[0], _find(h["keys"], kid["t"])[0]
        kids += np.bincount(at, minlength=kids.size)
        seen += np.bincount(at, weights=kid["n"], minlength=kids.size)
        h["rest"] = 1 - (seen - DISCOUNT * kids) / h["n"]
        _, gain = sums(True)
        near = (kid["n"] - DISCOUNT) / h["n"][at] + h["rest"][at] * smooth[suffix]
        gain += np.bincount(at, weights=kid["n"] * np.log(near / smooth[suffix]), minlength=kids.size) + (h["n"] - seen) * np.log(h["rest"])
        h["stays"] = gain > cost * kids
        smooth = np.where(h["stays"][at], near, smooth[suffix])


def _past_hot(shared, depth: int, slice_no: int, parts: int, least: int):
    """Blocks by context of the rows of one slice whose next context is not hot, with their probabilities so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot = shared.value

        def flush():
            for level, own in held.items():
                rows, c, base, below = zip(*own)
                rows = np.concatenate([x.view(np.uint8) for x in rows]).view(_row(depth))
                yield _deal(rows, np.concatenate(c), parts, level, np.concatenate(base), np.concatenate(below)[:, None])

        held, size = {}, 0
        for _, level, base, rows, v in _blocks(batches, depth):
            if level == depth:
                continue
            c = _word(rows, 1)
            for k in range(2, level + 2):
                c = _join(_word(rows, k), c)
            own = np.flatnonzero((_part(c) & _U(SLICES - 1) == slice_no) & (_word(rows, level + 1) != 0))
            if own.size:
                rows = _taken(rows, own)
                below, _, _ = _through_hot(words, hot, _unpacked(rows), v[own], level, least)
                held.setdefault(level + 1, []).append((rows, c[own], base[own], below))
                size += own.size
            if size >= FLUSH:
                yield from flush()
                held, size = {}, 0
        if held:
            yield from flush()

    return run


def _hot_added(shared, depth: int, parts: int, least: int):
    """Blocks of (row, what hot contexts add to its score), as ``_added`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot = shared.value
        held, size = [], 0
        for _, level, base, rows, v in _blocks(batches, depth):
            _, more, _ = _through_hot(words, hot, _unpacked(rows), v, level, least)
            some = np.flatnonzero(more)
            held.append(((rows["r"][some] >> 1).astype(np.int64) + (base[some] << 33), more[some]))
            size += some.size
            if size >= FLUSH:
                yield _row_sums(*(np.concatenate(x) for x in zip(*held)), parts)
                held, size = [], 0
        if size:
            yield _row_sums(*(np.concatenate(x) for x in zip(*held)), parts)

    return run


def _gains(w: list[np.ndarray], train: np.ndarray, below: np.ndarray, start: int, least: int, cost: float, chances: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> np.ndarray:
    """What the contexts of ``start`` words or more add to the score of each token; all tokens after these contexts are given.

    ``below`` has the tokens' probabilities after shorter contexts; ``chances`` gives those of the
    tokens from their keys and counts, where ``below`` has counts.
    """
    depth = len(w) - 1
    out, at = np.zeros(w[0].size), None
    c, j = w[1], w[0]
    for k in range(2, start + 1):
        c = _join(w[k], c)
    for k in range(1, start):
        j = _join(w[k], j)
    for k in range(start, depth + 1):
        # At first, all tokens in their order.
        before = w[k] if at is None else w[k][at]
        if k > start:
            c = _join(before, c)
        inside = np.flatnonzero(before)
        if inside.size < before.size:
            at = inside if at is None else at[inside]
            before, c, j, below = before[inside], c[inside], j[inside], below[inside]
        if not before.size:
            break
        j = _join(before, j)
        order, first = _grouped(j)
        size = np.diff(np.append(first, order.size))
        one = order[first]
        # From here on, tokens in the order of their sequences.
        at = order if at is None else at[order]
        n = np.diff(np.append(0, np.cumsum(train[at], dtype=np.int64)[first + size - 1]))
        often = np.flatnonzero(n >= least)
        b = below[one]
        if k == 1 and chances is not None:
            b[often] = chances(w[0][at[first[often]]], b[often])
        # The contexts, each with its sequences side by side.
        by, head = _grouped(_part(c[one]))
        of = np.empty(by.size, np.int64)
        of[by] = np.repeat(np.arange(head.size), np.diff(np.append(head, by.size)))
        m = np.add.reduceat(n[by], head)
        kids = np.bincount(of[often], minlength=head.size)
        seen = np.bincount(of[often], weights=n[often], minlength=head.size)
        rest = 1 - (seen - DISCOUNT * kids) / np.maximum(m, 1)
        own = of[often]
        near = (n[often] - DISCOUNT) / m[own] + rest[own] * b[often]
        ratio = near / b[often]
        gain = np.bincount(own, weights=n[often] * np.log(ratio), minlength=head.size) + (m - seen) * np.log(rest)
        stays = gain > cost * kids
        value = np.where(stays, np.log10(rest), 0.0)[of]
        value[often] = np.where(stays[own], np.log10(ratio), 0.0)
        b[often] = np.where(stays[own], near, b[often])
        out[at] += np.repeat(value, size)
        if k == depth:
            break
        # Longer contexts can only stay if this one has a transition.
        more = (kids > 0)[of]
        alive = np.flatnonzero(np.repeat(more, size))
        below = np.repeat(b[more], size[more])
        at, c, j = at[alive], c[order[alive]], j[order[alive]]
    return out


def _added(shared, depth: int, least: int, cost: float, parts: int):
    """Blocks of (row, sum over its tokens of what their contexts add to the score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = shared.value
        for level, got in _gathered(batches, depth):
            rows, rid, v = got
            got.clear()
            w, train = _unpacked(rows), rows["r"] & 1 == 0
            del rows
            value = _gains(w, train, v[:, 0], level, least, cost, (lambda x, n: _chances(words, x, n)) if level == 1 else None)
            del w, train, v
            some = np.flatnonzero(value)
            if some.size:
                yield _row_sums(rid[some], value[some], parts)

    return run


def _row_sums(rid: np.ndarray, value: np.ndarray, parts: int) -> pa.RecordBatch:
    """Blocks of (row, sum of its values), one for each part of the rows that occurs."""
    order, first = _grouped(_part(rid.view(np.uint64)))
    some, sums = rid[order[first]], np.add.reduceat(value[order], first)
    part = ((_part(some.view(np.uint64)) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    size = np.bincount(part)
    there = np.flatnonzero(size)
    offs = np.append(0, np.cumsum(size[there]))
    return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), binary_column(some[order], offs), binary_column(sums[order], offs)], names=["p", "r", "v"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, sum) over a reducer's blocks."""
    got = [b for b in batches if b.num_rows]
    rows, back = np.unique(_values([b.column(1) for b in got], np.int64), return_inverse=True)
    yield from _rows(["rid", "v"], rows, np.bincount(back, weights=_values([b.column(2) for b in got], np.float64), minlength=rows.size))


def _bits(df: DataFrame, column: str, most: int = 27) -> tuple[np.ndarray, int]:
    """A bitmap of a column's values, 2**most bits (16 MB) at most, and the log2 of its size."""
    log_bits = bitmap_bits(df.count(), most=most)
    return bitmap(df, column, log_bits), log_bits


def _fetched(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size on the driver, without an object for each row."""
    got = df.toArrow()
    return [got.column(i).to_numpy() for i in range(got.num_columns)]


def _hot_sequences(train: DataFrame, vocab: DataFrame, total: int, depth: int) -> list[dict]:
    """For each length up to one more than ``depth`` the sequences of ``HOT`` occurrences or more: keys, counts, and keys of all but the last and all but the first word."""
    spark = train.sparkSession
    limit = max(HOT, HOT_SHARE * total)
    found = vocab.filter(F.col("n") >= limit).select(F.col("h").alias("s"), "n", F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("t"))
    out = []
    for length in range(1, depth + 2):
        if length > 1:
            shared = spark.sparkContext.broadcast(out[-1]["keys"])
            counts = train.mapInArrow(lean(_hot_counts(shared, length)), "s long, n long, c long, t long")
            found = counts.groupBy("s").agg(F.sum("n").alias("n"), F.min("c").alias("c"), F.min("t").alias("t")).filter(F.col("n") >= limit)
        if length == 1 or out[-1]["keys"].size:
            s, n, c, t = _fetched(found.select("s", "n", "c", "t"))
        else:
            s, n, c, t = (np.zeros(0, np.int64) for _ in range(4))
        s, c, t = (x.view(np.uint64) for x in (s, c, t))
        order = np.argsort(s)
        out.append({"keys": s[order], "n": n[order], "c": c[order], "t": t[order]})
    return out


def _additions(rows: DataFrame, vocab: DataFrame, words: tuple, rare: DataFrame, total: int, tokens: int, depth: int, least: int, ws: Workspace) -> DataFrame:
    """(rid, v): what the tree adds to the log10 probability of each text."""
    spark = rows.sparkSession
    #: Description length of a transition in nats.
    cost = 0.5 * float(np.log(max(total, 2)))
    hot = _hot_sequences(rows.filter("not held_out").select("tokens"), vocab, total, depth)
    texts = rows.select("rid", "held_out", "tokens")
    asked = rare.filter(F.col("n") >= least)
    n_rare = asked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shared = spark.sparkContext.broadcast((hot, (*_bits(asked, "h"), words[0]) if n_rare[0] else None))
    again = None
    if n_rare[0]:
        parts = _reducers(spark, 2 * n_rare[1])
        again = texts.mapInArrow(lean(_windows(shared, depth, "rare", 0, parts)), _BLOCKS).repartitionById(parts, F.col("p"))
        again = ws.write(again.mapInArrow(lean(_recounted(depth, 1)), _BLOCKS))
        ws.release()

    def windows(take: str, slice_no: int, parts: int) -> DataFrame:
        out = texts.mapInArrow(lean(_windows(shared, depth, take, slice_no, parts)), _BLOCKS)
        return out if again is None else out.union(again.mapInArrow(lean(_again(shared, depth, take, slice_no, parts)), _BLOCKS))

    after_hot = None
    if hot[0]["keys"].size:
        parts = _reducers(spark, float(hot[0]["n"].sum()))
        after_hot = ws.write(windows("hot", 0, parts).repartitionById(parts, F.col("p")).mapInArrow(lean(_hot_counted(shared, depth, least)), _BLOCKS))
        ws.release()
        found = ws.write(after_hot.filter("base is null"), small=True)
        _judge_hot(spark, found, words, hot, least, cost)
        ws.drop(found)
        after_hot = after_hot.filter("base is not null")
    judged = spark.sparkContext.broadcast((words, hot))
    parts = _reducers(spark, tokens / SLICES)
    out = None
    for i in range(SLICES):
        blocks = windows("slice", i, parts)
        if after_hot is not None:
            blocks = blocks.union(after_hot.mapInArrow(lean(_past_hot(judged, depth, i, parts, least)), _BLOCKS))
        sums = blocks.repartitionById(parts, F.col("p")).mapInArrow(lean(_added(judged, depth, least, cost, parts)), "p int, r binary, v binary")
        if after_hot is not None and i == 0:
            sums = sums.union(after_hot.mapInArrow(lean(_hot_added(judged, depth, parts, least)), "p int, r binary, v binary"))
        sums = ws.write(sums.repartitionById(parts, F.col("p")).mapInArrow(lean(_summed), "rid long, v double"))
        ws.release()
        out = sums if out is None else out.union(sums)
    return out.groupBy("rid").agg(F.sum("v").alias("v"))


def _reducers(spark: SparkSession, rows: float) -> int:
    """Reducers for about this many rows; parts are numbered by 32 bits of a key."""
    return int(min(max(rows / TASK_ROWS, spark.sparkContext.defaultParallelism), 1 << 24))


def _score(shared):
    """Each text's sums over the frequent words, and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, floor = shared.value
        # The most frequent words, found fast in little memory; others are looked up in order.
        top = np.argpartition(counts, -INDEXED)[-INDEXED:] if keys.size > INDEXED else np.arange(keys.size)
        index = HashIndex(keys[top])
        for batch in batches:
            for lo, hi, x, at in _tokens(batch.column(3)):
                word = index.find(x)
                word = np.where(word >= 0, top[word], -1) if top.size else word
                if top.size < keys.size:
                    left = np.flatnonzero(word < 0)
                    left = left[np.argsort(x[left])]
                    at_key, found = _find(keys, x[left])
                    word[left[found]] = at_key[found]
                known = word >= 0
                p = np.zeros(x.size)
                p[known] = np.log10((counts[word[known]] + 0.1) / floor)
                rare = ~known
                n = hi - lo
                rare_offs = np.concatenate([[0], np.cumsum(row_sums(rare, at))]).astype(np.int32)
                out = [
                    *(batch.column(i).slice(lo, n) for i in range(3)),
                    pa.array(np.diff(at)),
                    pa.array(row_sums(known, at)),
                    pa.array(row_sums(p, at)),
                    pa.ListArray.from_arrays(pa.array(rare_offs), pa.array(x[rare].view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(out, names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "rare"])

    return run


def _common(vocab: DataFrame, share: float, total: int, least: int) -> int:
    """The count from which words are broadcast: at most ``1 / share`` words have it, and all those of this share; below ``least`` none needs to."""
    limit = max(share * total, 1)
    have = vocab.filter(F.col("n") >= limit).count()
    lowest = limit
    for n, words in sorted(vocab.filter((F.col("n") < limit) & (F.col("n") >= least)).groupBy("n").count().collect(), reverse=True):
        have += words
        if have > 1 / share:
            break
        lowest = n
    return lowest


def score_texts(docs: DataFrame, held_out: Column, *, depth: int = 3, least: int = 2, cache_share: float = 5e-6, word_share: float = 4e-7) -> DataFrame:
    """Scores every whole text under a suffix tree learned from the rows that are not held out.

    Args:
        docs: a frame with ``doc_id`` and ``text``; other columns are only seen by ``held_out``.
        held_out: rows that do not train.
        depth: words of the longest context.
        least: training occurrences from which a sequence takes part, however large the table is;
            1 takes all.
        word_share: at most ``1 / word_share`` words are broadcast; it changes no result.
        cache_share: without effect, as sequences are not broadcast.

    One row per input row: ``doc_id``, ``held_out``, ``n_tokens`` (words and one end),
    ``n_known`` (tokens that occur in training), ``train_tokens``, ``base_score`` (log10
    probability under smoothed unigrams) and ``score`` (under the tree). Null texts count as
    empty: their only token is the end. Where a null doc_id makes ``held_out`` unknown, the row
    trains. Repeated rows train as often as they occur. Without training rows every token has the
    probability of the smoothing, which is 1. Words are equal if 48-bit hashes of them are: of ten
    million different words two agree with a chance of about a sixth.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix-tree")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    rows = rows.mapInArrow(lean(_tokenise), "doc_id long, held_out boolean, tokens binary")
    # Read several times, with the same number for each row.
    rows = ws.write(rows.withColumn("rid", F.monotonically_increasing_id())).select("rid", "doc_id", "held_out", "tokens")
    train = rows.filter("not held_out").select("tokens")
    vocab = ws.write(train.mapInArrow(lean(_count_words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = total + 0.1 * (distinct + 1)
    often = F.col("n") >= _common(vocab, word_share, total, least)
    h, n = _fetched(vocab.filter(often).select("h", "n"))
    order = np.argsort(h.view(np.uint64))
    known, others = (h.view(np.uint64)[order], n[order], floor), vocab.filter(~often)
    shared = spark.sparkContext.broadcast(known)
    scored = ws.write(rows.mapInArrow(lean(_score(shared)), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rare array<long>"))
    tokens = scored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    more = _additions(rows, vocab, known, others, total, tokens, depth, least, ws)
    rare = scored.select("rid", F.explode("rare").alias("h"))
    seen = rare.join(others, "h", "left")
    log_p = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(floor))
    extra = seen.groupBy("rid").agg(F.count("n").alias("k"), F.sum(log_p).alias("s"))
    out = scored.drop("rare").join(extra, "rid", "left").join(more, "rid", "left")
    return ws.keep(
        out.select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
            F.lit(int(total)).cast("long").alias("train_tokens"),
            (F.col("base_score") + F.coalesce("s", F.lit(0.0))).alias("base_score"),
            (F.col("base_score") + F.coalesce("s", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))).alias("score"),
        )
    )


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
