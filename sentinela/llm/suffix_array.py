"""Suffix arrays of byte texts by induced sorting, and permuted common prefixes.

Nong, Zhang and Chan's scheme: suffixes are classified as smaller or larger than their
successor, the substrings between leftmost-smaller positions are sorted by induction and
named, the string of names is sorted recursively, and all suffixes are induced from its order
in linear time. Over bytes a bucket's suffixes are induced together, as arrays. In the
recursion, over names, the substrings are sorted by radix and suffixes induced one at a time.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than the next one, and the leftmost of each such run."""
    n = len(text)
    smaller = np.zeros(n, bool)             # the last suffix is larger than the empty one
    if n > 1:
        differs = text[1:] != text[:-1]
        # Equal neighbours have the type of the next place where the text changes.
        change = np.where(differs, np.arange(n - 1), n - 1)
        change = np.minimum.accumulate(change[::-1])[::-1]
        rises = np.append(text[1:] > text[:-1], False)
        smaller[:-1] = rises[change]
    return smaller, np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _induce_bytes(text: np.ndarray, smaller: np.ndarray, left: np.ndarray) -> np.ndarray:
    """All suffixes, from the order of the leftmost-smaller ones. Whole buckets at a time."""
    n = len(text)
    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    heads = ends - counts
    tails = ends.copy()
    order = np.full(n, -1, np.int64)
    large = np.bincount(text[~smaller], minlength=256)
    by_letter = left[np.argsort(text[left], kind="stable")]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(text[left], minlength=256))])

    def deal(found: np.ndarray, letters: np.ndarray, places: np.ndarray, step: int) -> None:
        turn = np.argsort(letters, kind="stable")
        letters, amount = letters[turn], np.bincount(letters, minlength=256)
        rank = np.arange(len(found)) - (np.cumsum(amount) - amount)[letters]
        order[places[letters] + step * rank] = found[turn]
        places += step * amount

    fill = heads.copy()
    order[fill[text[n - 1]]] = n - 1        # induced by the empty suffix
    fill[text[n - 1]] += 1
    for letter in np.flatnonzero(counts):
        at = heads[letter]
        while at < fill[letter]:            # larger suffixes of this bucket bring more of them
            before = order[at:fill[letter]] - 1
            at = fill[letter]
            same = before[(before >= 0) & (text[before] == letter)]
            order[at:at + len(same)] = same
            fill[letter] += len(same)
        own = np.concatenate([order[heads[letter]:fill[letter]],
                              by_letter[cuts[letter]:cuts[letter + 1]]]) - 1
        own = own[own >= 0]
        letters = text[own]
        more = letters > letter
        deal(own[more], letters[more], fill, 1)
    fill = tails - 1
    for letter in np.flatnonzero(counts)[::-1]:
        at = tails[letter] - 1
        while at > fill[letter]:
            before = order[fill[letter] + 1:at + 1][::-1] - 1
            at = fill[letter]
            same = before[(before >= 0) & (text[before] == letter)]
            order[at - len(same) + 1:at + 1] = same[::-1]
            fill[letter] -= len(same)
        first = heads[letter] + large[letter]
        own = np.concatenate([order[fill[letter] + 1:tails[letter]][::-1],
                              order[heads[letter]:first][::-1]]) - 1
        own = own[own >= 0]
        letters = text[own]
        less = letters < letter
        deal(own[less], letters[less], fill, -1)
    return order


def _induce_names(names: list[int], smaller: np.ndarray, left: list[int], size: int) -> list[int]:
    """The same over an alphabet of ``size`` names, one suffix at a time.

    The lists are walked while they fill. A place before the first has a kind of its own, so that
    what is still empty needs no test.
    """
    counts = np.bincount(names, minlength=size)
    ends = np.cumsum(counts)
    order = [-1] * len(names)
    tails = (ends - 1).tolist()
    for at in reversed(left):
        name = names[at]
        order[tails[name]] = at
        tails[name] -= 1
    fill = (ends - counts).tolist()
    name = names[-1]
    order[fill[name]] = len(names) - 1
    fill[name] += 1
    wanted = (~smaller).tolist() + [False, False]
    for at in order:
        at -= 1
        if wanted[at]:
            name = names[at]
            place = fill[name]
            order[place] = at
            fill[name] = place + 1
    tails = (ends - 1).tolist()
    wanted = smaller.tolist() + [False, False]
    for at in reversed(order):
        at -= 1
        if wanted[at]:
            name = names[at]
            place = tails[name]
            order[place] = at
            tails[name] = place - 1
    return order


def _sorted_names(names: np.ndarray, smaller: np.ndarray, left: np.ndarray, size: int
                  ) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings of a string of names, by radix sort.

    Letters are compared three at a time, with their types, as arrays; only substrings that are
    still equal to another and not at their end go on.
    """
    n, base = len(names), 2 * size + 3
    letters = np.concatenate([2 * names + smaller + 1, np.zeros(3, np.int64)])
    length = np.append(left[1:], n) - left + 1
    rank = np.zeros(len(left), np.int64)
    open_, k = np.arange(len(left)), 0
    while len(open_):
        code = np.zeros(len(open_), np.int64)
        for step in range(k, k + 3):
            letter = letters[np.minimum(left[open_] + step, n)]
            code = code * base + np.where(step < length[open_], letter, 0)
        turn = np.lexsort((code, rank[open_]))
        open_, code = open_[turn], code[turn]
        old = rank[open_]
        group = np.append(True, old[1:] != old[:-1])
        new = group | np.append(True, code[1:] != code[:-1])
        places = np.arange(len(open_))
        first = np.maximum.accumulate(np.where(new, places, 0))
        rank[open_] = old + first - np.maximum.accumulate(np.where(group, places, 0))
        k += 3
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone & (length[open_] > k)]
    ranks, names_ = np.unique(rank, return_inverse=True)
    return names_, len(ranks)


def _named(text: np.ndarray, left: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings in text order, and how many there are."""
    n = len(text)
    length = np.empty(n, np.int64)
    length[left] = np.append(left[1:], n) - left + 1       # up to the next one, included
    a, b = ordered[:-1], ordered[1:]
    # The last substring meets the end of the text, so it equals no other.
    equal = (length[a] == length[b]) & (a != left[-1]) & (b != left[-1])
    open_, k = np.flatnonzero(equal), 0
    while len(open_):
        same = text[a[open_] + k] == text[b[open_] + k]
        equal[open_[~same]] = False
        k += 1
        open_ = open_[same]
        open_ = open_[length[a[open_]] > k]
    ranks = np.concatenate([[0], np.cumsum(~equal)])
    name = np.empty(n, np.int64)
    name[ordered] = ranks
    return name[left], int(ranks[-1]) + 1


def suffix_array(text: np.ndarray, size: int = 256) -> np.ndarray:
    """Start of every suffix, in ascending order; ``text`` has values below ``size``."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    smaller, left = classify(text)
    if size <= 256:
        def induce(start):
            return _induce_bytes(text, smaller, start)
    else:
        names = text.tolist()

        def induce(start):
            return np.array(_induce_names(names, smaller, start.tolist(), size))
    if not len(left):
        return induce(left)
    if size <= 256:
        is_left = np.zeros(n, bool)
        is_left[left] = True
        rough = induce(left)
        names_, count = _named(text, left, rough[is_left[rough]])
    else:
        names_, count = _sorted_names(text, smaller, left, size)
    if count == len(left):
        ordered = np.empty(count, np.int64)
        ordered[names_] = left
    else:
        ordered = left[suffix_array(names_, max(count, 257))]
    return induce(ordered)


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the text, the prefix its suffix shares with the one sorted before it.

    Only places whose left neighbours differ are compared (Kärkkäinen, Manzini and Puglisi);
    each other place has one less than the place before it.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    irreducible = (before <= 0) | (at == 0)
    inner = ~irreducible
    irreducible[inner] = text[at[inner] - 1] != text[before[inner] - 1]
    where = np.flatnonzero(irreducible & (before >= 0))
    # Eight bytes at a time.
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 1, 8), (1, 1))
    words = np.ascontiguousarray(words).view("<u8").ravel()
    shared = np.zeros(n, np.int64)
    open_ = where
    while len(open_):
        k = shared[open_]
        a, b = open_ + k, before[open_] + k
        inside = np.maximum(a, b) < n
        open_, a, b = open_[inside], a[inside], b[inside]
        apart = words[a] ^ words[b]
        full = apart == 0
        # Equal low bytes of the first difference.
        low = apart[~full] & (~apart[~full] + np.uint64(1))
        gained = np.full(len(open_), 8, np.int64)
        gained[~full] = np.log2(low.astype(np.float64)).astype(np.int64) // 8
        shared[open_] = np.minimum(shared[open_] + gained, n - np.maximum(open_, before[open_]))
        open_ = open_[full]
    level = np.where(irreducible, shared + at, -1)
    return np.maximum(np.maximum.accumulate(level) - at, 0)
