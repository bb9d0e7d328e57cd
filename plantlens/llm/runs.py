"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a stretch of at least LEAST consecutive words, and at least twice its smallest period q (words q apart are identical), that no neighbouring word extends.
In a run each word but the last q equals the one q later, so max(LEAST, 2 q) - q words in a row do; for a block length b = 2^k
with 2 b - 1 not above that, one aligned block of b words lies in them. The scale b therefore serves the periods whose largest such b it is: every aligned
block is laid on the words that follow it, and the sum of squared differences of word numbers is taken for all distances at once as
sum x^2 + sum y^2 - 2 (x correlated with y), the correlation by a number-theoretic transform. Word numbers are dense in a batch of windows
and as many primes are used as the largest possible sum needs, so a sum that is 0 modulo all of them is 0: the result is exact.
The distances of zero sums are seeds; each is extended both ways by binary search over prefix hashes and the stretches that are long enough are compared word by
word. Of stretches with the same borders the smallest period is the run's.

A block with a word that does not come again within the scale's longest period cannot match and is not transformed. Words of many documents are worked on
together, divided by numbers that occur once, so no run crosses a document.

Defined results: null or empty text has no words and no runs; of equally long runs the one with the smallest start, then period, is
the greatest. Rows are judged one by one, so repeated rows, null ids and further columns of any name have no effect; an empty table gives no rows. A text is held
whole by one task, about 100 bytes of memory a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .words import PLAIN, Words, flat, slices, text_of

LEAST = 12
WORD = r"[^\x20\x09-\x0D]+"
PRIMES = ((3221225473, 5), (3489660929, 3), (2013265921, 31))  # fixed values: c 2^k + 1 below 2^32, and a generator of each
BATCH = 1 << 20  # numbers in one batch of transforms
HASH_BASE = 1_000_003


class Runs(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def power(base: int, count: int, prime: int) -> np.ndarray:
    """base^0 ... base^(count - 1) modulo the prime, by doubling."""
    out = np.ones(max(1, count), np.uint64)
    size = 1
    while size < count:
        step = np.uint64(pow(base, size, prime))
        out[size : 2 * size] = out[: min(size, count - size)] * step % np.uint64(prime)
        size *= 2
    return out


@lru_cache(maxsize=128)
def _turns(size: int, prime: int, root: int) -> tuple[np.ndarray, ...]:
    """Powers of the roots of unity for each stage of a transform of ``size``."""
    stages = []
    while size > 1:
        stages.append(power(pow(root, (prime - 1) // size, prime), size // 2, prime))
        size //= 2
    return tuple(stages)


def ntt(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long), in natural order."""
    many, size = rows.shape
    p = np.uint64(prime)
    done = 1
    for turn in _turns(size, prime, root):
        half = len(turn)
        pair = rows.reshape(many, 2, half, done)
        rows = np.empty((many, half, 2, done), np.uint64)
        rows[:, :, 0] = (pair[:, 0] + pair[:, 1]) % p
        rows[:, :, 1] = (pair[:, 0] + p - pair[:, 1]) % p * turn[None, :, None] % p
        done *= 2
    return rows.reshape(many, size)


def zero_distances(windows: np.ndarray, b: int) -> np.ndarray:
    """For each row and each distance, whether the first b numbers, the block, equal those that far on."""
    many, size = windows.shape
    names, numbers = np.unique(windows, return_inverse=True)
    y = numbers.reshape(many, size).astype(np.uint64)
    x = y[:, :b]
    bound, padded = b * len(names) ** 2, 1 << (size - 1).bit_length()
    zero = np.ones((many, size - b + 1), bool)
    product = 1
    for prime, root in PRIMES:
        p = np.uint64(prime)
        squares = np.zeros((many, size + 1), np.uint64)
        np.cumsum(y * y % p, axis=1, out=squares[:, 1:])
        sums = (squares[:, b:] - squares[:, : size - b + 1]) + squares[:, b : b + 1]
        left, right = np.zeros((many, padded), np.uint64), np.zeros((many, padded), np.uint64)
        right[:, :size] = y
        left[:, (-np.arange(b)) % padded] = x
        both = ntt(left, prime, root) * ntt(right, prime, root) % p
        back = ntt(both, prime, pow(root, -1, prime))[:, : size - b + 1] * np.uint64(pow(padded, -1, prime)) % p
        zero &= sums % p == 2 * back % p
        product *= prime
        if product > bound:
            return zero
    raise ValueError("a window of more words than three primes can tell apart")


def block_of(period: np.ndarray) -> np.ndarray:
    """Block length that serves a period."""
    most = (np.maximum(LEAST, 2 * period) - period + 1) // 2
    return 1 << (np.frexp(most.astype(float))[1] - 1)


def seeds(ids: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(place, distance, block length) of aligned blocks that occur again at a distance which their scale serves."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    gap = np.full(n, n, np.int64)
    again = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    periods = np.arange(1, longest // 2 + 1)
    lengths = block_of(periods)
    for b in np.unique(lengths).tolist():
        mine = periods[lengths == b]
        high, count = int(mine[-1]), n // b
        served = np.zeros(high + 1, bool)
        served[mine] = True
        at = np.flatnonzero(gap[: count * b].reshape(count, b).max(1) <= high) * b if count else np.zeros(0, np.int64)
        rows = max(1, BATCH // (1 << (high + b - 1).bit_length()))
        for low in range(0, len(at), rows):
            part = at[low : low + rows]
            place = part[:, None] + np.arange(high + b)
            windows = np.where(place < n, ids[np.minimum(place, n - 1)], -1 - place)  # beyond the end: numbers that occur once
            row, distance = np.nonzero(zero_distances(windows, b) & served)
            yield part[row], distance, b


class Matcher:
    """How far two places of a sequence agree, by prefix hashes; a hash can only make a stretch too long, which ``exact`` mends."""

    def __init__(self, ids: np.ndarray):
        prime, _ = PRIMES[0]
        self.ids, self.prime = ids, np.uint64(prime)
        self.powers = power(HASH_BASE, len(ids) + 1, prime)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum((ids.astype(np.uint64) + np.uint64(1)) % self.prime * self.powers[:-1] % self.prime, out=self.sums[1:])
        self.sums %= self.prime

    def same(self, low: np.ndarray, high: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether words low to high equal those ``shift`` later."""
        here = (self.sums[high] + self.prime - self.sums[low]) % self.prime * self.powers[shift] % self.prime
        return here == (self.sums[high + shift] + self.prime - self.sums[low + shift]) % self.prime

    def _reach(self, most: np.ndarray, test) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = test(middle)
            low, high = np.where(good, middle, low), np.where(good, high, np.minimum(high, middle - 1))
        return low

    def stretches(self, at: np.ndarray, shift: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """First word, and word after the last, of the stretch around the blocks in which words equal those ``shift`` later."""
        right = self._reach(len(self.ids) - shift - at - b, lambda k: self.same(at + b, at + b + k, shift))
        left = self._reach(at, lambda k: self.same(at - k, at, shift))
        return at - left, at + b + right

    def exact(self, at: int, shift: int, low: int, high: int) -> tuple[int, int]:
        """The stretch around ``at`` inside low to high, word by word."""
        differ = np.flatnonzero(self.ids[low:high] != self.ids[low + shift : high + shift]) + low
        k = int(np.searchsorted(differ, at))
        return (int(differ[k - 1]) + 1 if k else low), (int(differ[k]) if k < len(differ) else high)


def find_runs(ids: np.ndarray, longest: int) -> Runs:
    """All runs of the sequence, ordered by start, then period; periods up to half of ``longest``."""
    matcher, found = Matcher(ids), set()
    for at, shift, b in seeds(ids, longest):
        if not len(at):
            continue
        low, high = matcher.stretches(at, shift, b)
        long = high - low + shift >= np.maximum(LEAST, 2 * shift)
        stretches, first = np.unique(np.stack([low[long], high[long], shift[long]], axis=1), axis=0, return_index=True)
        for (l, h, q), place in zip(stretches.tolist(), at[long][first].tolist()):
            l, h = matcher.exact(place, q, l, h)
            if h - l + q >= max(LEAST, 2 * q):
                found.add((l, h + q, q))
    least: dict[tuple[int, int], int] = {}
    for l, r, q in found:
        least[l, r] = min(q, least.get((l, r), q))
    rows = sorted((l, q, r) for (l, r), q in least.items())
    start, period, end = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    return Runs(start, end, period)


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64()))), ("runs_sha256", pa.string()), ("collapsed", pa.large_string()),
    ("collapsed_sha256", pa.string()),
])
RESULT_DDL = (
    "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs array<array<bigint>>, runs_sha256 string, collapsed string, collapsed_sha256 string"
)


def _joined(words: Words, kept: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words, each with a space behind it, and the offsets of the documents."""
    number = np.flatnonzero(kept)
    size = words.end[number] - words.start[number]
    offsets = np.zeros(len(number) + 1, np.int64)
    np.cumsum(size + 1, out=offsets[1:])
    out = np.full(offsets[-1], 0x20, np.uint8)
    target = np.ones(offsets[-1], bool)
    target[offsets[1:] - 1] = False
    source = np.zeros(len(words.data) + 1, np.int32)
    np.add.at(source, words.start[number], 1)
    np.add.at(source, words.end[number], -1)
    out[target] = words.data[np.cumsum(source[:-1]) > 0]
    return out.tobytes(), offsets[np.searchsorted(number, words.first)]


def _scan(whole: bool):
    """Runs of each text of the batches; ``whole`` also hands out the runs and the collapsed text themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(*flat(text_of(batch)), PLAIN)
            counts, names = words.counts(), words.doc()
            base = words.first[:-1] + np.arange(batch.num_rows)  # place of each document's first word, one divider behind each document
            _, number = np.unique(words.hash, return_inverse=True)
            ids = len(words) + np.arange(len(words) + batch.num_rows, dtype=np.int64)  # dividers: numbers that occur once
            ids[np.arange(len(words)) + names] = number
            found = find_runs(ids, int(counts.max(initial=0)))
            owner = np.searchsorted(base, found.start, "right") - 1
            first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            drop = np.zeros(len(ids) + 1, np.int64)
            np.add.at(drop, found.start + found.period, 1)
            np.add.at(drop, found.end, -1)
            dropped = np.cumsum(drop[:-1])[np.arange(len(words)) + names] > 0
            text, offsets = _joined(words, ~dropped)
            start, length = found.start - base[owner], found.end - found.start
            docs = batch.column("doc_id").to_pylist()
            rows = []
            for d, doc in enumerate(docs):
                mine = range(first[d], first[d + 1])
                runs = [[int(start[k]), int(length[k]), int(found.period[k])] for k in mine]
                top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=[None] * 3)
                kept = text[offsets[d] : max(offsets[d], offsets[d + 1] - 1)]
                rows.append({
                    "doc_id": doc, "n_words": int(counts[d]), "n_runs": len(runs), "start": top[0], "length": top[1], "period": top[2],
                    "exponent_milli": 1000 * top[1] // top[2] if runs else None, "runs": runs if whole else None,
                    "runs_sha256": sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
                    "collapsed": kept.decode() if whole else None, "collapsed_sha256": sha256(kept).hexdigest(),
                })
            yield pa.RecordBatch.from_pylist(rows, RESULT)

    return run


def periodic(docs: DataFrame, whole: bool = True) -> DataFrame:
    """Runs of each document: their number, the longest, all of them with their digest, and the text without repetitions."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scan(whole), RESULT_DDL)


def plant(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a planted repetition in each tenth document: with h the check sum of the decimal id and g = h // 10, where
    h % 10 = 0 the words from a = g % n on repeat those from a on with period 1 + (n - a) // (3 + g % 8)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("bigint")
        return F.transform(words, lambda word, i: F.when(i < a, word).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int"))))

    # the words are bound once, as the only element of an array, and not split again for each of them
    words = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    planted = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")).otherwise(F.lit(""))), F.lit(0))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, planted).otherwise(F.col("text")).alias("text"))
