"""Word shingles of whole texts as sorted arrays of names."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

STEP = np.uint64(0x9E3779B97F4A7C15)
#: Texts taken together, and the bits that number them.
TOGETHER, TOGETHER_BITS = 64, 6
NAME_BITS = 64 - TOGETHER_BITS
NAME_MASK = np.uint64((1 << NAME_BITS) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_names(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of up to ``TOGETHER`` texts in a row, repeats included, as ``number of the text, name``.

    A-Z are lower-cased; words end at ASCII white space; a text of fewer words than a shingle has its whole sequence as one; a
    text without words has none.
    """
    split = [t.encode().lower().split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, total)
    owner = np.repeat(np.arange(len(texts)), counts)
    end, span = np.cumsum(counts)[owner], np.minimum(words, counts)[owner]
    at = np.flatnonzero(np.arange(total) + span <= end)
    span = span[at]
    h = span.astype(np.uint64)
    for k in range(words):
        if k and (short := span <= k).any():
            longer = at[~short]
            h[~short] = mix(h[~short] + ids[longer + k] + STEP)
        else:
            h = mix(h + ids[at + k] + STEP)
    return owner[at], h & NAME_MASK


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    out = []
    for k in range(0, len(texts), TOGETHER):
        part = texts[k : k + TOGETHER]
        owner, h = shingle_names(part, words)
        flat = np.sort(owner.astype(np.uint64) << np.uint64(NAME_BITS) | h)
        if len(flat):
            flat = flat[np.concatenate(([True], flat[1:] != flat[:-1]))]
        cuts = np.searchsorted(flat >> np.uint64(NAME_BITS), np.arange(len(part) + 1))
        flat = flat & NAME_MASK
        out += [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def set_name(names: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(names.tobytes()) - (1 << 63)


def signatures(sets: list[np.ndarray], numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
    """``owner, signature`` of every projection of every set that a set within the Jaccard bound may share.

    The shingle space is halved again and again by the bits of the names. If two sets have Jaccard similarity at least t = numerator /
    denominator in a part of the space, they have so in one of its halves that is not empty for both. In a part where their union is
    smaller than 1 / (1 - t), that means equal projections; with a larger union each has at least c = ceil(t (m + 1)) elements there, m
    being the largest union that forces equality. So a projection of 1 to m elements is a signature, and one of c or more is halved;
    a projection on the border does both. No pair within the bound is lost.
    """
    m = -(-denominator // (denominator - numerator)) - 1
    c = -(-numerator * (m + 1) // denominator)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix(flat * STEP), out=sums[1:])
    end = np.cumsum(sizes)
    start, owner = end - sizes, np.arange(len(sets))
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for depth in range(NAME_BITS + 1):
        keep = end > start
        start, end, owner = start[keep], end[keep], owner[keep]
        if not len(start):
            break
        size = end - start
        small = size <= m
        a, b = start[small], end[small]
        owners.append(owner[small])
        found.append(mix(mix(sums[b] - sums[a] + np.uint64(depth)) + (flat[a] >> np.uint64(NAME_BITS - depth)) * STEP))
        more = size >= c
        start, end, owner = start[more], end[more], owner[more]
        if not len(start) or depth == NAME_BITS:
            break
        ones = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(flat >> np.uint64(NAME_BITS - 1 - depth) & np.uint64(1), out=ones[1:])
        middle = end - (ones[end] - ones[start])
        start, end, owner = np.concatenate((start, middle)), np.concatenate((middle, end)), np.concatenate((owner, owner))
    return np.concatenate(owners), np.concatenate(found)


#: Parts of the shingle space that serve as pivots for all sets.
CELLS = 32


def profiles(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, how many of its shingles lie in each of ``CELLS`` parts of the space, at most 255."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    cell = (mix(flat) >> np.uint64(59)).astype(np.int64) + np.repeat(np.arange(len(sets)), sizes) * CELLS
    return np.minimum(np.bincount(cell, minlength=len(sets) * CELLS), 255).astype(np.uint8).reshape(len(sets), CELLS)


def sketch_bytes(n: np.ndarray) -> np.ndarray:
    """Bytes of the sketch of a set of ``n``: a bit or more for each element, a power of two, at least 8."""
    return np.maximum(1 << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64), 64) // 8


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """For each set, whether it has an odd number of shingles in each of as many parts of the space as its sketch has bits.

    Two sketches differ in at most as many bits as the sets have elements apart. A sketch is folded to half its bits by exclusive or of its halves.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    bits = 8 * sketch_bytes(sizes)
    end = np.cumsum(bits)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    part = (mix(flat) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(end - bits, sizes)
    body = np.packbits((np.bincount(part, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [body[b - a : b] for a, b in zip((bits // 8).tolist(), (end // 8).tolist())]


class Sketches:
    """Sketches of many sets, folded to every size among them."""

    def __init__(self, bodies: list[bytes]):
        self.width, self.at = np.array([len(b) for b in bodies], np.int64), {}
        before = None
        for w in np.unique(self.width)[::-1].tolist():
            own = np.flatnonzero(self.width == w)
            table = np.frombuffer(b"".join(bodies[k] for k in own), "<u8").reshape(-1, w // 8)
            if before is not None:
                own = np.concatenate((before[0], own))
                table = np.concatenate((np.bitwise_xor.reduce(before[1].reshape(len(before[1]), -1, w // 8), axis=1), table))
            before = own, table
            place = np.zeros(len(bodies), np.int64)
            place[own] = np.arange(len(own))
            self.at[w] = place, table

    def apart(self, k: int, others: np.ndarray) -> np.ndarray:
        """A lower bound of the elements that each of ``others`` and ``k`` do not share."""
        width = np.minimum(self.width[others], self.width[k])
        out = np.zeros(len(others), np.int64)
        for w in np.unique(width).tolist():
            place, table = self.at[w]
            here = width == w
            out[here] = np.bitwise_count(table[place[others[here]]] ^ table[place[k]]).sum(1, dtype=np.int64)
        return out
