"""A structural index over batches of JSON texts, built with array operations.

All texts of a batch are laid end to end in one byte array. Quote, bracket and delimiter bitmaps,
string masks (parity of quotes by prefix sums) and nesting depth (prefix sums of brackets) are
computed for the whole batch at once; spans of containers and the links of members to their
containers follow from sorted depth keys.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_NUMBER = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_LITERALS = frozenset((b"true", b"false", b"null"))
_QUOTE, _BACKSLASH, _COLON, _COMMA = 34, 92, 58, 44
_OPEN_OBJECT, _CLOSE_OBJECT, _OPEN_ARRAY, _CLOSE_ARRAY = 123, 125, 91, 93
_SCALAR = 1  # the kind of a number, true, false or null; other tokens have their byte


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_STRUCTURAL, _SPACE, _ESCAPABLE, _HEX = _table(b"{}[]:,"), _table(b" \t\r\n"), _table(b'"\\/bfnrtu'), _table(b"0123456789abcdefABCDEF")


@dataclass
class StructuralIndex:
    """Tokens of the well-formed texts of a batch, in order of text and place.

    kind: the byte of a bracket, colon or comma, 34 for a string, 1 for another scalar.
    start, end: the token's span in ``data``; a container's end is that of its closing bracket.
    doc: the text's number. parent: the token number of the container's opening bracket, -1 at
    the top. key: the token number of the member's name, -1 for all but values in objects.
    value: whether the token is a value. valid: by text, whether it is one JSON document.
    """

    data: bytes
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    parent: np.ndarray
    key: np.ndarray
    value: np.ndarray
    valid: np.ndarray

    def raw(self, token: int) -> bytes:
        return self.data[self.start[token] : self.end[token]]

    def name_codes(self, names: list[bytes]) -> np.ndarray:
        """For every token the place in ``names`` of the name of the member it is the value of, else -1."""
        codes = np.full(self.kind.size, -1, dtype=np.int64)
        members = np.flatnonzero(self.key >= 0)
        first = self.start[self.key[members]] + 1
        length = self.end[self.key[members]] - 1 - first
        letters = np.frombuffer(self.data, dtype=np.uint8)
        for size in {len(name) for name in names}:
            at = np.flatnonzero(length == size)
            spelt = letters[first[at][:, None] + np.arange(size)]
            for number, name in enumerate(names):
                if len(name) == size:
                    codes[members[at[(spelt == np.frombuffer(name, dtype=np.uint8)).all(axis=1)]]] = number
        return codes

    def whole_numbers(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of those of ``tokens`` that are nothing but 1 to 15 digits, perhaps in quotes, and which they are."""
        quoted = self.kind[tokens] == _QUOTE
        first, length = self.start[tokens] + quoted, self.end[tokens] - self.start[tokens] - 2 * quoted
        values, plain = np.zeros(tokens.size, dtype=np.int64), np.zeros(tokens.size, dtype=bool)
        digits = np.frombuffer(self.data, dtype=np.uint8)
        for size in range(1, 16):
            at = np.flatnonzero(length == size)
            if at.size:
                found = digits[first[at][:, None] + np.arange(size)].astype(np.int64) - 48
                plain[at] = ((found >= 0) & (found <= 9)).all(axis=1)
                values[at] = found @ 10 ** np.arange(size - 1, -1, -1, dtype=np.int64)
        return values, plain


def build_index(texts: list[bytes]) -> StructuralIndex:
    """The structural index of ``texts``; texts that aren't one JSON document have no tokens."""
    data = b"\n".join(texts) + b"\n"
    a = np.frombuffer(data, dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    place = np.arange(a.size, dtype=np.int64)
    valid = np.ones(len(texts), dtype=bool)
    owner = lambda at: np.searchsorted(ends, at, side="right")

    # Quote bitmap: a quote after an odd run of backslashes is escaped.
    last_other = np.maximum.accumulate(np.where(a == _BACKSLASH, -1, place))
    escaped = np.zeros(a.size, dtype=bool)
    escaped[1:] = ((place[:-1] - last_other[:-1]) & 1).astype(bool)
    quote = (a == _QUOTE) & ~escaped
    seen = np.cumsum(quote, dtype=np.int64)
    before = np.concatenate(([0], seen[ends[:-1] - 1])) if len(texts) else np.zeros(0, dtype=np.int64)
    inside = ((seen - np.repeat(before, lengths)) & 1).astype(bool)  # the opening quote counts, the closing one doesn't
    if len(texts):
        valid[inside[ends - 1]] = False
    wrong = inside & ((a < 32) | (escaped & ~_ESCAPABLE[a]))
    valid[owner(np.flatnonzero(wrong))] = False
    unicode_escape = np.flatnonzero(inside & escaped & (a == 117))
    padded = np.concatenate((a, np.zeros(4, dtype=np.uint8)))
    for k in range(1, 5):
        valid[owner(unicode_escape[~_HEX[padded[unicode_escape + k]]])] = False

    # Bracket and delimiter bitmaps, and the spans of strings and other scalars.
    structural = _STRUCTURAL[a] & ~inside & ~quote
    plain = ~inside & ~quote & ~structural & ~_SPACE[a]
    plain_start = plain.copy()
    plain_start[1:] &= ~plain[:-1]
    plain_end = plain.copy()
    plain_end[:-1] &= ~plain[1:]
    opening = quote & inside
    start = np.flatnonzero(structural | opening | plain_start)
    kind = a[start].copy()
    kind[plain_start[start]] = _SCALAR
    end = start + 1
    quotes = np.flatnonzero(quote)
    strings = np.flatnonzero(opening[start])
    following = np.searchsorted(quotes, start[strings]) + 1
    end[strings] = np.concatenate((quotes, [a.size - 1]))[np.minimum(following, quotes.size)] + 1
    end[kind == _SCALAR] = np.flatnonzero(plain_end) + 1
    doc = owner(start)
    has_token = np.zeros(len(texts), dtype=bool)
    has_token[doc] = True
    valid &= has_token

    # Depth by prefix sums; a text whose depth falls below zero or doesn't return is out.
    opens, closes = (kind == _OPEN_OBJECT) | (kind == _OPEN_ARRAY), (kind == _CLOSE_OBJECT) | (kind == _CLOSE_ARRAY)
    depth = np.cumsum(opens.astype(np.int64) - closes)
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if doc.size else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.concatenate((first, [doc.size])))
    depth -= np.repeat(np.concatenate(([0], depth[first[1:] - 1])) if first.size else first, counts)
    if first.size:
        valid[doc[first][np.minimum.reduceat(depth, first) < 0]] = False
        valid[doc[first][depth[first + counts - 1] != 0]] = False
    keep = valid[doc]
    kind, start, end, doc, depth, opens, closes = (v[keep] for v in (kind, start, end, doc, depth, opens, closes))

    # The container of each token: the last bracket opened at its level, by sorted (text, level, place).
    token = np.arange(kind.size, dtype=np.int64)
    level = np.where(closes, depth + 1, np.where(opens, depth - 1, depth))
    span = int(depth.max(initial=0)) + 2
    size = kind.size + 1
    sort_key = lambda d, lev, t: (d * span + lev) * size + t
    opened = token[opens]
    keys = sort_key(doc[opened], depth[opened], opened)
    order = np.argsort(keys)
    keys, opened = keys[order], opened[order]
    at = np.searchsorted(keys, sort_key(doc, level, token)) - 1
    parent = np.where((level > 0) & (at >= 0), opened[np.maximum(at, 0)], -1) if opened.size else np.full(kind.size, -1)
    matches = token[closes]
    end[parent[matches]] = end[matches]

    # Grammar by neighbours within one text.
    previous = np.concatenate(([0], kind[:-1]))
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1])) if doc.size else np.zeros(0, dtype=bool)
    previous = np.where(new_doc, 0, previous)
    context = np.where(parent >= 0, kind[np.maximum(parent, 0)], 0)
    is_value = opens | (kind == _QUOTE) | (kind == _SCALAR)
    after_value = (previous == _QUOTE) | (previous == _SCALAR) | (previous == _CLOSE_OBJECT) | (previous == _CLOSE_ARRAY)
    after_open = (previous == _OPEN_OBJECT) | (previous == _OPEN_ARRAY)
    is_key = (context == _OPEN_OBJECT) & (kind == _QUOTE) & ((previous == _OPEN_OBJECT) | (previous == _COMMA))
    following_kind = np.concatenate((kind[1:], [0])) if kind.size else kind
    key_before = np.concatenate(([False], is_key[:-1])) if kind.size else is_key
    good_value = np.where(
        context == 0, new_doc, np.where(context == _OPEN_ARRAY, after_open | (previous == _COMMA), previous == _COLON)
    )
    good = np.where(
        is_key,
        following_kind == _COLON,
        np.where(
            is_value,
            good_value,
            np.where(
                kind == _COMMA,
                (context > 0) & after_value & ~key_before,
                np.where(
                    kind == _COLON,
                    key_before,
                    (after_value | after_open) & ~key_before & (context == kind - 2),  # } is { + 2, ] is [ + 2
                ),
            ),
        ),
    )
    valid[doc[~good]] = False
    checked: dict[bytes, bool] = {}
    for t in np.flatnonzero(kind == _SCALAR):
        text = data[start[t] : end[t]]
        fine = checked.get(text)
        if fine is None:
            fine = checked[text] = text in _LITERALS or _NUMBER.fullmatch(text) is not None
        if not fine:
            valid[doc[t]] = False

    value = is_value & ~is_key
    key = np.where(value & (context == _OPEN_OBJECT), token - 2, -1)
    live = valid[doc]
    if not live.all():
        renumber = np.cumsum(live) - 1
        kind, start, end, doc, value = (v[live] for v in (kind, start, end, doc, value))
        parent, key = (np.where(v[live] >= 0, renumber[np.maximum(v[live], 0)], -1) for v in (parent, key))
    return StructuralIndex(data, kind, start, end, doc, parent, key, value, valid)
