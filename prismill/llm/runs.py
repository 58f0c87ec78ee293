"""Periodic runs of words by the method of Kolpakov and Kucherov.

Per document: an LZ factorisation from a suffix automaton that is built word
by word (a factor is the longest sequence that also starts earlier, or a word
that stands for the first time); Main's algorithm at each border of factors,
for the runs that cross it; and runs that lie within a factor, copied from
the factor's earlier occurrence.

Only runs of ``TIMES`` periods and ``LEAST`` words or more are asked for, which
bounds the work at a border. In a run (start, end, q) all words from start + q
on stand q words earlier too, so the factor that holds word start + q and the
next one reach its end. A run that no factor holds with a word to spare on both
sides therefore touches a border of two factors whose sizes f and g satisfy
3q <= f + g, and has half its words or more on one side of it: a square that
starts or ends there. The extension functions of the right factor and of the
reversed left window name all such squares. Each is followed to both ends; one
inside a run found before whose period divides its own is that run again.

All neighbours in a run stand together again in it. So a pair of words that
stands once in its document parts the text: what the method works on are the
stretches of ``LEAST`` words or more without such a pair, with one automaton for
all of a document, begun again from its root for each stretch as for texts
apart. Its states grow with those words only. A document is one unit of work;
its memory is linear in its words.

Defined results
- null or empty text, or white space only: no words, no run, collapsed text is empty
- words are compared as written; a document of any length is read whole
- ties of the greatest exponent go to the smallest start, then to the smallest period
- repeated rows and ids give repeated results; the text of a null id is never altered
- columns other than id and text aren't read; an empty table gives an empty table
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismill.llm import wordhash
from prismill.llm.bpe import texts

#: A run has so many periods, and so many words, at least.
TIMES, LEAST = 4, 6

Run = tuple[int, int, int]


def stretches(h: np.ndarray) -> list[tuple[int, int]]:
    """The places (start, end) of all stretches of ``LEAST`` words or more in which each pair of neighbours stands again in the document, from the words' hashes: unequal hashes are unequal words."""
    if len(h) < LEAST:
        return []
    _, which, n = np.unique(wordhash.sequences(h, 2), return_inverse=True, return_counts=True)
    edge = np.diff((n[which] > 1).astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    long = last - first >= LEAST
    return list(zip(first[long].tolist(), last[long].tolist(), strict=True))


def factors(codes: list, places: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """The LZ factors (start, end, start of an earlier occurrence or -1) of these stretches, in order.

    The automaton holds the words before place i when the factor's match at ``at``
    is carried on by word i: a transition means an occurrence that ends before i.
    """
    after: list[dict[int, int]] = [{}]
    link, size, ends = [-1], [0], [-1]  # ends: where a state's sequences end first
    for first, end in places:
        last, begin, at = 0, first, 0
        for i in range(first, end):
            c = codes[i]
            step = after[at].get(c)
            if step is None:
                if at:
                    yield begin, i, ends[at] - (i - begin) + 1
                    begin, step = i, after[0].get(c)
                if step is None:
                    yield i, i + 1, -1
                    begin, step = i + 1, 0
            at = step

            known, new = after[last].get(c), len(after)
            if known is not None:  # only from the root of a further stretch on
                if size[known] == size[last] + 1:
                    last = known
                    continue
                p, copy, last = last, new, new
            else:
                after.append({})
                size.append(size[last] + 1)
                ends.append(i)
                link.append(0)
                p, last = last, new
                while p >= 0:
                    to = after[p]
                    known = to.get(c)
                    if known is not None:
                        break
                    to[c] = new
                    p = link[p]
                if p < 0:
                    continue
                if size[p] + 1 == size[known]:
                    link[new] = known
                    continue
                link[new] = copy = new + 1
            after.append(after[known].copy())
            size.append(size[p] + 1)
            ends.append(ends[known])
            link.append(link[known])
            link[known] = copy
            while p >= 0 and after[p].get(c) == known:
                after[p][c] = copy
                p = link[p]
            if at == known and i + 1 - begin <= size[copy]:
                at = copy
        if at:
            yield begin, end, ends[at] - (end - begin) + 1


def extensions(w: list) -> list[int]:
    """Of each place, how many words from there on equal those from the start on."""
    n = len(w)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(codes: list, border: int, before: int, behind: int) -> Iterator[tuple[tuple[int, int], int]]:
    """The runs that touch the border of two factors of these sizes, by Main's squares to its right and left: ((start, end), period)."""
    most = (before + behind) // (TIMES - 1)
    n, seen = len(codes), []
    for side in (1, -1):
        if side > 0:
            near = codes[border : border + min(behind, 2 * most)]
        else:
            near = codes[max(0, border - min(before + most, 2 * most)) : border][::-1]
        z = extensions(near)
        for q in range(1, min(most, len(near) // 2) + 1):
            if z[q] < q:
                continue
            start, end = (border, border + 2 * q) if side > 0 else (border - 2 * q, border)
            if any(q % p == 0 and s <= start and end <= e for s, e, p in seen):
                continue
            while start and codes[start - 1] == codes[start - 1 + q]:
                start -= 1
            while end < n and codes[end] == codes[end - q]:
                end += 1
            seen.append((start, end, q))
            if end - start >= max(LEAST, TIMES * q):
                yield (start, end), q


def runs(words: list[bytes], h: np.ndarray | None = None) -> list[Run]:
    """All runs (start, length, period) by start, then period. The words' hashes save time where they are known."""
    places = stretches(wordhash.hashed(words) if h is None else h)
    if not places:
        return []
    number: dict[bytes, int] = {}
    codes: list[int] = list(range(-len(words), 0))  # all different: a run can't go on beyond a stretch
    for first, last in places:
        codes[first:last] = [number.setdefault(w, len(number)) for w in words[first:last]]
    found: dict[tuple[int, int], int] = {}
    order: list[tuple[int, int]] = []

    def add(place: tuple[int, int], q: int) -> None:
        if place not in found:
            insort(order, place)
        found[place] = min(q, found.get(place, q))

    upto = before = 0  # where the last factor ends, and its size; no run goes on between stretches
    for begin, end, source in factors(codes, places):
        if begin > upto:
            if before >= LEAST - 1:
                for run in crossing(codes, upto, before, 0):
                    add(*run)
            before = 0
        size = end - begin
        if before + size >= LEAST - 1:
            for run in crossing(codes, begin, before, size):
                add(*run)
        if order and size >= LEAST + 2:
            shift, at = begin - source, bisect_left(order, (source + 1, 0))
            while at < len(order) and order[at][0] + shift < end:
                s, e = order[at]
                if e + shift < end:
                    add((s + shift, e + shift), found[s, e])
                at += 1
        upto, before = end, size
    if before >= LEAST - 1:
        for run in crossing(codes, upto, before, 0):
            add(*run)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(n: int, key: object) -> np.ndarray | None:
    """Of n words of a document, which ones stand in each place where its number says that a stretch repeats itself; None where it doesn't."""
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run has behind its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, size, q in found:
        edge[start + q] += 1
        edge[start + size] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


FIELDS = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def described(docs: DataFrame, key: str = "doc_id", text: str = "text", alter: bool = False) -> DataFrame:
    """Per row: key, n_runs, the run of the greatest exponent, and digests of all runs and of the text without their repetitions.

    With ``alter`` documents whose number says so get a repeating stretch first (see ``planted``).
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def one(text: str | None, h: np.ndarray, key: object) -> tuple:
        words = (text or "").encode().split()  # of bytes, split() knows no other white space than 9 to 13 and 32
        to = planted(len(words), key) if alter else None
        if to is not None:
            words, h = [words[i] for i in to.tolist()], h[to]
        found = runs(words, h)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
        return len(found), *top, sha(listed.encode()), sha(b" ".join(collapsed(words, found)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            rows = [one(t, h, next(keys)) for part in texts(batch.column(1)) for t, h in zip(part, wordhash.documents(part), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["key", *names])

    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = d.schema["key"].dataType.simpleString()
    return d.mapInArrow(run, f"key {kind}, {FIELDS}").withColumnRenamed("key", key)
