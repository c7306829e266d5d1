"""Sorting suffixes by their bytes, eight at a time, and choosing which suffixes need sorting.

Every string of ``length`` bytes holds the places of ``length - gram + 1`` grams. Its anchor is the
gram with the smallest hash (the first of several). Equal strings have equal anchors at the same
distance, so strings need only be compared with those that share their anchor, and the suffixes that
start at anchors stand for all others: about two in ``length - gram`` places are anchors.

A record is an anchor with its surroundings: all bytes of the strings that have this anchor, from
``left`` bytes before it. Bytes beyond are zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Places that a chunk of text may have, so that a place fits beside its gram's hash in 64 bits.
PLACE_BITS = 24
PLACES = np.uint64((1 << PLACE_BITS) - 1)


@dataclass(frozen=True)
class Shape:
    """Length of the strings that are compared, and of the grams that anchor them."""

    length: int = 100
    gram: int = 28

    @property
    def before(self) -> int:
        """Bytes kept before an anchor, a multiple of 8."""
        return -(-(self.length - self.gram) // 8) * 8

    @property
    def behind(self) -> int:
        """Bytes kept from an anchor on, a multiple of 8."""
        return -(-self.length // 8) * 8

    @property
    def width(self) -> int:
        return self.before + self.behind


@dataclass
class Records:
    """Anchored suffixes: ``rows`` has the bytes around each anchor."""

    rows: np.ndarray  # (n, width) bytes
    doc: np.ndarray  # document id
    tie: np.ndarray  # tells documents of one id apart
    start: np.ndarray  # of the first string with this anchor, in its document
    left: np.ndarray  # from that start to the anchor
    extra: np.ndarray  # further strings with this anchor, starting one byte later each

    def __len__(self) -> int:
        return len(self.doc)

    def take(self, which: np.ndarray) -> Records:
        return Records(*(getattr(self, f)[which] for f in FIELDS))

    def in_order(self) -> Records:
        """By document and place: of equal records the first is the earliest."""
        return self.take(np.lexsort((self.start, self.tie, self.doc)))


FIELDS = ("rows", "doc", "tie", "start", "left", "extra")


def joined(parts: list[Records]) -> Records:
    return Records(*(np.concatenate([getattr(p, f) for p in parts]) for f in FIELDS))


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on: words of eight bytes, mixed."""
    n = len(text) - gram + 1
    word = text.astype(np.uint64)
    for size in (1, 2, 4):
        word = (word[:-size] << np.uint64(8 * size)) | word[size:]
    hashed = np.zeros(n, np.uint64)
    for at in [*range(0, gram - 7, 8), gram - 8]:
        hashed ^= word[at : at + n]
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(31)
    return hashed * np.uint64(0xD6E8FEB86659FD93)


def anchors_of(text: np.ndarray, shape: Shape) -> np.ndarray:
    """The anchor's place for the string that starts at each place of ``text``."""
    n = len(text) - shape.gram + 1
    key = (gram_hashes(text, shape.gram) & ~PLACES) | np.arange(n, dtype=np.uint64)
    window = shape.length - shape.gram + 1
    size = 1
    while 2 * size <= window:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < window:
        key = np.minimum(key[: len(key) - (window - size)], key[window - size :])
    return (key & PLACES).astype(np.int64)


def records_of(texts: list[bytes], docs: np.ndarray, ties: np.ndarray, offsets: np.ndarray, shape: Shape) -> Records:
    """Records of texts; ``offsets`` are added to the places in each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    margin = shape.width
    buffer = np.frombuffer(bytes(margin) + b"".join(texts) + bytes(margin), np.uint8)
    text = buffer[margin : len(buffer) - margin]
    ends = np.cumsum(lengths)
    if len(text) < shape.length:
        return empty(shape)
    anchor = anchors_of(text, shape)
    left_in_doc = np.repeat(ends, lengths)[: len(anchor)] - np.arange(len(anchor))
    starts = np.flatnonzero(left_in_doc >= shape.length)
    if not len(starts):
        return empty(shape)
    anchor = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    first, anchor = starts[heads], anchor[heads]
    extra = np.diff(np.append(heads, len(starts))) - 1
    left = anchor - first
    around = np.lib.stride_tricks.sliding_window_view(buffer, shape.width)
    rows = around[anchor + margin - shape.before]
    column = np.arange(shape.width, dtype=np.int16)
    begin = (shape.before - left).astype(np.int16)[:, None]
    end = (shape.before - left + extra + shape.length).astype(np.int16)[:, None]
    rows = np.where((column >= begin) & (column < end), rows, np.uint8(0))
    doc = np.searchsorted(ends, first, side="right")
    start = first - (ends - lengths)[doc] + offsets[doc]
    return Records(rows, docs[doc], ties[doc], start, left.astype(np.uint8), extra.astype(np.uint8))


def empty(shape: Shape) -> Records:
    return Records(np.zeros((0, shape.width), np.uint8), *(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint8, np.uint8)))


def sort_suffixes(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort over columns of eight-byte words: the order, and where a differing row begins.

    Rows are split by their first word; rows that share it are sorted by the next one, and so on.
    Only rows that are still equal to another are looked at again. Equal rows keep their order.
    """
    n = len(words[0]) if words else 0
    order = np.arange(n)
    new = np.zeros(n, bool)
    new[:1] = True
    open_places = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    for word in words:
        if not len(open_places):
            break
        held = order[open_places]
        group = np.cumsum(new[open_places])
        value = word[held]
        by = np.lexsort((value, group)) if group[-1] > 1 else np.argsort(value, kind="stable")
        order[open_places] = held[by]
        value, group = value[by], group[by]
        new[open_places[1:]] |= (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        alone = new.copy()
        alone[:-1] &= new[1:]
        alone[-1] = new[-1]
        open_places = open_places[~alone[open_places]]
    return order, new


def big_endian_words(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of a byte matrix as numbers that compare as the bytes do."""
    return [np.ascontiguousarray(rows[:, at : at + 8]).view(">u8").ravel().astype(np.uint64) for at in range(0, rows.shape[1], 8)]


def suffix_words(records: Records, shape: Shape) -> list[np.ndarray]:
    """Sort keys of records: the bytes from the anchor on, then those before it, then the extent."""
    words = big_endian_words(records.rows)
    split = shape.before // 8
    return [*words[split:], *words[:split], records.left.astype(np.uint64) * np.uint64(256) + records.extra]


def equal_records(records: Records, shape: Shape) -> np.ndarray:
    """For each record in document order, whether an equal one stands before it. A quick sort by hash, then bytes are compared."""
    words = suffix_words(records, shape)
    hashed = np.zeros(len(records), np.uint64)
    for word in words:
        hashed = (hashed ^ word) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(32)
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    for word in words:
        same &= word[order[1:]] == word[order[:-1]]
    later = np.zeros(len(records), bool)
    # Only neighbours are compared: a record between two equal ones with its hash would hide the second, which then stays.
    later[order[1:]] = same & ~_same_place(records, order[1:], order[:-1])
    return later


def _same_place(records: Records, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (records.doc[a] == records.doc[b]) & (records.tie[a] == records.tie[b]) & (records.start[a] == records.start[b])


def later_in_groups(new: np.ndarray, order: np.ndarray, records_doc, records_tie, place) -> np.ndarray:
    """For each row, whether its group of equal rows has one in an earlier place.

    ``order`` lists the groups one after the other, each in document order. Rows that name the same
    place as the first of the group (a repeated row of the table) are not later.
    """
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    first = order[head]
    later = np.zeros(len(order), bool)
    same = (records_doc[order] == records_doc[first]) & (records_tie[order] == records_tie[first]) & (place[order] == place[first])
    later[order] = ~same
    return later


#: Strings that are spelled out at once.
BLOCK = 100_000


def repeated_strings(records: Records, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, tie, start, end)``: stretches of which every string of ``length`` bytes starts earlier too.

    All records with one anchor gram must be here. Records are sorted as suffixes from their
    anchors. Of equal records only the first may hold a string for the first time. First records
    that share a gram with a different one are spelled out into those of their strings that reach no
    further than the longest prefix shared with a neighbour; these strings are sorted in turn.
    """
    records = records.in_order()
    order, new = sort_suffixes(suffix_words(records, shape))
    later = later_in_groups(new, order, records.doc, records.tie, records.start)
    found = [(records.doc[later], records.tie[later], records.start[later], records.start[later] + records.extra[later] + shape.length)]
    heads = order[new]
    behind = records.rows[heads, shape.before :]
    # Bytes that a head shares with the one before it, from the anchor on: at least the gram, or they belong apart.
    common = np.zeros(len(heads) + 1, np.int64)
    differ = behind[1:] != behind[:-1]
    common[1:-1] = np.where(differ.any(axis=1), differ.argmax(axis=1), shape.behind)
    group = np.cumsum(common[:-1] < shape.gram)
    longest = np.maximum(common[:-1], common[1:])
    # A string that another record has too reaches no further behind the anchor than that.
    strings = np.clip(records.left[heads] + longest - shape.length + 1, 0, records.extra[heads].astype(np.int64) + 1)
    heads, group, strings = heads[strings > 0], group[strings > 0], strings[strings > 0]
    total = np.concatenate(([0], np.cumsum(strings)))
    ends = [*(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(heads)] if len(heads) else []
    at = 0
    for k, end in enumerate(ends):
        after = ends[k + 1] if k + 1 < len(ends) else None
        # Whole groups, as many as make a block.
        if after is None or total[after] - total[at] > BLOCK:
            place = np.argsort(heads[at:end])
            found.append(_spelled_out(records, heads[at:end][place], strings[at:end][place], shape))
            at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _spelled_out(records: Records, which: np.ndarray, count: np.ndarray, shape: Shape):
    """Repeated strings among the first ``count`` of each of the records ``which``, in document order."""
    row = np.repeat(which, count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place = records.start[row] + step
    flat = np.ascontiguousarray(records.rows)
    offset = row * shape.width + shape.before - records.left[row].astype(np.int64) + step
    strings = np.zeros((len(row), shape.behind), np.uint8)
    strings[:, : shape.length] = np.lib.stride_tricks.sliding_window_view(flat.ravel(), shape.length)[offset]
    order, new = sort_suffixes(big_endian_words(strings))
    later = later_in_groups(new, order, records.doc[row], records.tie[row], place)
    return records.doc[row[later]], records.tie[row[later]], place[later], place[later] + shape.length


def merge_spans(doc, tie, start, end):
    """Spans of each document in order, overlapping and touching ones as one."""
    order = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order], end[order]
    if not len(doc):
        return doc, tie, start, end
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    # Ends so far within a document: lift documents apart, so that one running maximum serves all.
    lift = (np.cumsum(other) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    new = other.copy()
    new[1:] |= start[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return doc[heads], tie[heads], start[heads], np.maximum.reduceat(end, heads)
