"""Fuzzy similarity of two short texts, 0..100.

The token work (sort, intersect, difference, join) and the weighting are
``Column`` code.  Only the base measure - the longest common subsequence - is a
vectorised Arrow function: it takes the whole batch, keeps its distinct pairs,
and advances all of them together with the published bit-parallel LCS
recurrence, one numpy step per character position.

Long texts are worked pair by pair.  Of the windows of the longer text only
those are compared whose upper bound beats the best one found, and the rows of
bits are cut into blocks, so memory grows with the texts, not their product.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from pagesift.functions.binding import let

_CELLS = 500_000  # 64-bit words handled per numpy step
_WORDS = 4  # shorter texts of more 64-bit words are long ...
_WIDTH = 4_096  # ... and so are pairs whose longer text has more characters
_BLOCK = 16_384  # bits of a long text's row that are worked at once


def _codes(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint32)
    for i, text in enumerate(texts):
        out[i, : len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _match_masks(short: list[str], long: list[str]) -> np.ndarray:
    """Per pair and position of the longer text: bits of the equal positions in the shorter one, in 64-bit words."""
    m, n = max(map(len, short)), max(map(len, long))
    a, b = _codes(short, m), _codes(long, n)
    masks = np.zeros((*b.shape, -(-m // 64)), np.uint64)
    for i in range(m):
        equal = (b == a[:, i : i + 1]) & (a[:, i : i + 1] != 0)
        masks[:, :, i // 64] |= equal.astype(np.uint64) << np.uint64(i % 64)
    return masks


def _lcs_windows(
    mask_at: Callable[[np.ndarray, np.ndarray], np.ndarray],
    words: int,
    sizes: np.ndarray,
    rows: np.ndarray,
    starts: np.ndarray,
    lengths: np.ndarray,
) -> np.ndarray:
    """LCS of the shorter text with ``long[start : start + length]`` for many (row, start) at once."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    state = np.full((len(rows), words), ones)
    for step in range(int(lengths.max(initial=0))):
        inside = step < lengths
        hits = np.where(inside[:, None], mask_at(rows, np.where(inside, starts + step, 0)), np.uint64(0)) & state
        carry = np.zeros(len(rows), np.uint64)
        for w in range(words):
            row, hit = state[:, w], hits[:, w]
            low = row + hit
            total = low + carry
            if w + 1 < words:
                carry = ((low < hit) | (total < low)).astype(np.uint64)
            state[:, w] = total | (row - hit)
    left = np.clip(sizes[:, None] - 64 * np.arange(words), 0, 64)
    used = np.where(left == 64, ones, (np.uint64(1) << (left % 64).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~state & used[rows]).sum(axis=1, dtype=np.int64)


def _best_lcs(short: list[str], long: list[str], windowed: bool) -> np.ndarray:
    """LCS of each pair, or its best value over the windows of the longer text."""
    size = np.array([len(s) for s in short], np.int64)
    width = np.array([len(t) for t in long], np.int64)
    counts = width - size + 1 if windowed else np.ones(len(short), np.int64)
    rows = np.repeat(np.arange(len(short)), counts)
    first = np.cumsum(counts) - counts
    starts = np.arange(len(rows)) - first[rows]
    lengths = (size if windowed else width)[rows]
    masks = _match_masks(short, long)
    found = _lcs_windows(lambda r, at: masks[r, at], masks.shape[2], size, rows, starts, lengths)
    return np.maximum.reduceat(found, first)


def _common_counts(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Per window of the longer text: characters that it has in common with the shorter one, in any order.

    ``short`` and ``long`` hold numbers of characters.  The count of the first
    window is carried along: a character that leaves counts if the window had
    no more of it than the shorter text, one that enters if it had fewer.
    """
    m, n = len(short), len(long)
    have = np.bincount(short, minlength=int(max(short.max(), long.max())) + 1)
    places = np.sort(long * (n + 1) + np.arange(n))  # by character, then by position

    def between(chars: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.searchsorted(places, chars * (n + 1) + high) - np.searchsorted(places, chars * (n + 1) + low)

    at = np.arange(n - m)
    leaves, enters = long[: n - m], long[m:]
    lost = between(leaves, at, at + m) <= have[leaves]
    won = between(enters, at + 1, at + m) < have[enters]
    first = np.minimum(have, np.bincount(long[:m], minlength=len(have))).sum()
    return first + np.concatenate([[0], np.cumsum(won.astype(np.int64) - lost)])


def _spread_bounds(bounds: np.ndarray) -> np.ndarray:
    """A window's LCS differs from its neighbour's by one at most, so a bound holds for others, plus their distance."""
    at = np.arange(len(bounds))
    bounds = np.minimum.accumulate(bounds - at) + at
    return np.minimum.accumulate((bounds + at)[::-1])[::-1] - at


def _best_window(bounds: np.ndarray, lcs: Callable[[np.ndarray], np.ndarray], at_once: int) -> int:
    """Largest ``lcs`` of any window; windows whose bound does not exceed the best value found are not compared."""
    best = 0
    bounds = _spread_bounds(bounds)
    while True:
        open_ = np.flatnonzero(bounds > best)
        if not len(open_):
            return best
        # The most promising window, and others evenly spaced: each one lowers the bounds of its neighbours.
        evenly = open_[:: -(-len(open_) // at_once)]
        tried = np.union1d(evenly, [open_[np.argmax(bounds[open_])]])
        found = lcs(tried)
        best = max(best, int(found.max()))
        bounds[tried] = found
        bounds = _spread_bounds(bounds)


def _lcs_in_blocks(short: np.ndarray, long: np.ndarray) -> int:
    """LCS with whole numbers as rows of bits; a block hands the next one its carry at each position."""
    carries, score = bytearray(len(long)), 0
    for start in range(0, len(short), _BLOCK):
        part = short[start : start + _BLOCK]
        size, full = len(part), (1 << len(part)) - 1
        masks = {
            int(c): int.from_bytes(np.packbits(part == c, bitorder="little").tobytes(), "little")
            for c in np.intersect1d(part, long)
        }
        row = full
        for i, char in enumerate(long.tolist()):
            hit = row & masks.get(char, 0)
            total = row + hit + carries[i]
            carries[i] = total >> size
            row = (total & full) | (row - hit)
        score += size - row.bit_count()
    return score


def _long_lcs(short: str, long: str, windowed: bool) -> int:
    """``_best_lcs`` of one pair of any length."""
    a, b = _codes([short], len(short))[0], _codes([long], len(long))[0]
    chars, numbers = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = numbers[: len(a)], numbers[len(a) :]
    m, words = len(a), -(-len(a) // 64)
    if not windowed:
        return _lcs_in_blocks(a, b)
    bounds = _common_counts(a, b)
    if words > _WORDS:
        each = lambda starts: np.array([_lcs_in_blocks(a, b[k : k + m]) for k in starts.tolist()])
        return _best_window(bounds, each, 8)
    # One row of bits per character of the pair: a row per position would grow with the longer text.
    masks = np.zeros((len(chars), words), np.uint64)
    at = np.arange(m)
    np.bitwise_or.at(masks, (a, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))

    def together(starts: np.ndarray) -> np.ndarray:
        rows, lengths = np.zeros(len(starts), np.int64), np.full(len(starts), m)
        return _lcs_windows(lambda _, i: masks[b[i]], words, np.array([m]), rows, starts, lengths)

    return _best_window(bounds, together, 1_024)


def similarity(pairs: list[tuple[str, str]], windowed: bool) -> np.ndarray:
    """round(100 * 2 * LCS / (len a + len b)) per pair; 0 when either text is empty.

    ``windowed`` compares the shorter text with every equal-length window of
    the longer one and keeps the best.
    """
    out = np.zeros(len(pairs), np.int64)
    ordered = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    words = {i: -(-len(a) // 64) for i, (a, _) in enumerate(ordered) if a}

    def score(part: list[int], best: np.ndarray) -> None:
        size = np.array([len(ordered[i][0]) for i in part])
        total = 2 * size if windowed else size + np.array([len(ordered[i][1]) for i in part])
        out[part] = np.rint(200 * best / total).astype(np.int64)

    large = [i for i in words if words[i] > _WORDS or len(ordered[i][1]) > _WIDTH]
    for i in large:
        score([i], np.array([_long_lcs(*ordered[i], windowed)]))
    small = sorted(words.keys() - set(large), key=lambda i: (words[i], len(ordered[i][1]), i))
    while small:
        # Pairs of similar length share a matrix, as wide as its last pair; its size is bounded.
        take = 0
        while take < len(small) and words[small[take]] == words[small[0]]:
            if take and (take + 1) * max(64, len(ordered[small[take]][1])) * words[small[0]] > _CELLS:
                break
            take += 1
        part, small = small[:take], small[take:]
        score(part, _best_lcs([ordered[i][0] for i in part], [ordered[i][1] for i in part], windowed))
    return out


@F.arrow_udf(ArrayType(IntegerType()))
def _ratios(left: pa.Array, right: pa.Array, windowed: pa.Array) -> pa.Array:
    """Similarity of ``left[i]`` and ``right[i]`` for the aligned arrays of each row."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(left.value_lengths().fill_null(0)))])
    a, b = left.flatten().to_pylist(), right.flatten().to_pylist()
    flags = np.repeat(np.asarray(windowed.to_pylist(), bool), np.diff(offsets))
    out = np.zeros(len(a), np.int64)
    for flag in (False, True):
        at = np.flatnonzero(flags == flag)
        pairs = [(a[i], b[i]) for i in at]
        distinct = list(dict.fromkeys(pairs))
        scores = dict(zip(distinct, similarity(distinct, flag).tolist()))
        out[at] = [scores[p] for p in pairs]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out, pa.int32()))


def _words(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda w: w != "")


def _join(*parts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *parts))


def weighted_ratio(a: Column, b: Column) -> Column:
    """The published weighted similarity: plain, token-sorted and token-set ratios.

    When one text is 1.5 times as long as the other, the token measures look
    for the shorter text inside the longer one and weigh less.
    """
    wa, wb = F.array_distinct(_words(a)), F.array_distinct(_words(b))
    sorted_a, sorted_b = F.array_join(F.sort_array(_words(a)), " "), F.array_join(F.sort_array(_words(b)), " ")
    common = F.array_join(F.sort_array(F.array_intersect(wa, wb)), " ")
    only_a = _join(common, F.array_join(F.sort_array(F.array_except(wa, wb)), " "))
    only_b = _join(common, F.array_join(F.sort_array(F.array_except(wb, wa)), " "))
    la, lb = F.length(a), F.length(b)
    stretch = F.greatest(la, lb) / F.greatest(F.least(la, lb), F.lit(1))
    long = stretch >= 1.5
    plain = F.get(_ratios(F.array(a), F.array(b), F.lit(False)), 0)
    token = _ratios(
        F.array(a, sorted_a, common, common, only_a),
        F.array(b, sorted_b, only_a, only_b, only_b),
        long,
    )
    scale = F.when(stretch > 8, F.lit(0.6)).otherwise(F.lit(0.9))
    best = let(F.struct(plain.alias("plain"), token.alias("t")), lambda r: _combine(r, long, scale))
    return F.when((la == 0) | (lb == 0), F.lit(0)).otherwise(F.bround(best).cast("int"))


def _combine(r: Column, long: Column, scale: Column) -> Column:
    whole, t = r["plain"], r["t"]
    token_set = F.greatest(F.get(t, 2), F.get(t, 3), F.get(t, 4))
    near = F.greatest(whole * 1.0, F.get(t, 1) * 0.95, token_set * 0.95)
    far = F.greatest(whole * 1.0, scale * F.get(t, 0), scale * 0.95 * F.get(t, 1), scale * 0.95 * token_set)
    return F.when(long, far).otherwise(near)


def score_adjustment(base: Column, query: Column, title: Column) -> Column:
    """What the ranking adds to the similarity: +1 exact word count above 95, -1 missing word, -30 short title."""
    qw, tw = _words(query), F.array_distinct(_words(title))
    return (
        F.when((base > 95) & (F.size(qw) == F.size(tw)), 1).otherwise(0)
        - F.when(F.size(F.array_except(qw, tw)) > 0, 1).otherwise(0)
        - F.when(F.length(title) < F.length(query), 30).otherwise(0)
    )
