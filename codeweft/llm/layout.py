"""Layout statistics and word shingles of a text, computed over its bytes as arrays.

One pass of array operations over the UTF-8 bytes of a text gives what would
otherwise take a regular expression per statistic. Continuation bytes are no
characters of their own; characters beyond ASCII count as letters.
"""

from __future__ import annotations

import re

import numpy as np

#: Least length of a run of base64 or escape characters, and of a hexadecimal word, that counts as encoded.
RUN, HEX_WORD = 60, 16

_byte = np.arange(256)
_c = np.array([chr(i) for i in range(256)])


def _of(chars: str) -> np.ndarray:
    return np.isin(_c, list(chars)) & (_byte < 128)


_DIGIT = _of("0123456789")
_ALNUM = _DIGIT | _of("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (_byte >= 128)
_WORD = _ALNUM | _of("_$")
_SPACE = _of(" \t\n\r\f\v")
_HEX = _of("0123456789abcdefABCDEF")
_RUN = (_ALNUM & (_byte < 128)) | _of("+/=_-\\")
_CONT = (_byte >= 0x80) & (_byte < 0xC0)
_QUOTE = _of("\"'")

_BLOCK = re.compile(rb"/\*.*?(?:\*/|\Z)", re.S)
_LINE = re.compile(rb"[ \t\n]//[^\n]*")
_HASH = re.compile(rb"\n[ \t]*#[^\n]*")
_HEAD = re.compile(rb"\n[ \t]*(?:package|import)\s[^;{}\"]*;")


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _sums(mask: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(mask)))


def statistics(raw: bytes) -> tuple[int, int, float, float, float, float, float] | None:
    """(n_chars, max_line, mean_line, space, alnum, numeric, encoded); an empty text has none.

    ``space`` and ``alnum`` are shares of all characters. ``numeric``: share
    of the characters that are no white space which belong to words that begin
    with a digit or are quoted hexadecimal digits, with their sign and the
    comma behind. ``encoded``: share of all characters in runs of RUN or more
    base64 or escape characters, most of them alphanumeric, and in hexadecimal
    words of HEX_WORD or more.
    """
    b = np.frombuffer(raw, dtype=np.uint8)
    if not len(b):
        return None
    chars = _sums(~_CONT[b])
    n = int(chars[-1])
    # A line ends at a line feed, at a carriage return and line feed, or at a lone carriage return.
    cr = b == 13
    pair = np.concatenate(([False], cr[:-1])) & (b == 10)
    breaks = np.flatnonzero((b == 10) | cr & ~np.concatenate((pair[1:], [False])))
    at = np.concatenate(([0], breaks + 1))
    to = np.concatenate((breaks - pair[breaks], [len(b)]))
    lengths = chars[to] - chars[at]
    space, alnum = _SPACE[b], _ALNUM[b]
    n_space = int(space.sum())
    n_alnum = int((alnum & ~_CONT[b]).sum())

    s, e = _runs(_WORD[b])
    before = np.concatenate(([0], b))[s]
    after = np.concatenate((b, [0]))[e]
    all_hex = np.diff(_sums(~_HEX[b])[np.stack((s, e))], axis=0)[0] == 0 if len(s) else np.zeros(0, bool)
    quoted = all_hex & (e - s >= 2) & _QUOTE[before] & _QUOTE[after]
    number = _DIGIT[b[s]] | quoted
    extra = ((before == 45) | (before == 43)).astype(int) + (after == 44) + quoted * 2
    numeric = int(((e - s) + extra)[number].sum()) / max(n - n_space, 1)

    rs, re_ = _runs(_RUN[b])
    long = re_ - rs >= RUN
    rs, re_ = rs[long], re_[long]
    solid = _sums(_ALNUM[b])[re_] - _sums(_ALNUM[b])[rs] >= 0.6 * (re_ - rs) if len(rs) else np.zeros(0, bool)
    rs, re_ = rs[solid], re_[solid]
    hexes = all_hex & (e - s >= HEX_WORD) & (e - s < RUN)
    encoded = (int((re_ - rs).sum()) + int((e - s)[hexes].sum())) / max(n, 1)
    return n, int(lengths.max()), n / len(lengths), n_space / max(n, 1), n_alnum / max(n, 1), min(numeric, 1.0), min(encoded, 1.0)


def code_only(raw: bytes, java: bool) -> bytes:
    """The text without comments and, in Java, without package and import lines, which change when a file moves."""
    t = _BLOCK.sub(b" ", b"\n" + raw)
    t = _HASH.sub(b"\n", _LINE.sub(b"\n", t))
    return _HEAD.sub(b"\n", t) if java else t


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))), dtype=np.uint64)
        _powers[int(base)] = have
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(code: bytes, k: int = 5) -> tuple[int, np.ndarray] | None:
    """(hash of the sequence of words, sorted distinct hashes of every k words in a row); None without words.

    A text of fewer than ``k`` words has one shingle: all of them. A word's
    hash is a difference of prefix sums, so no word is taken out by itself.
    """
    b = np.frombuffer(code, dtype=np.uint8)
    s, e = _runs(_WORD[b])
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers_of(_P, len(b)), dtype=np.uint64)))
        words = _mix((prefix[e] - prefix[s]) * _powers_of(_P_INV, len(b))[s])
        n = len(words)
        whole = _mix(np.array([(words * _powers_of(np.uint64(0xD6E8FEB86659FD93), n)).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))[0]
        k = min(k, n)
        weights = _powers_of(np.uint64(0xD6E8FEB86659FD93), k)
        out = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            out += words[i : n - k + 1 + i] * weights[i]
    return int(whole.astype(np.int64)), np.unique(_mix(out))
