"""Plain counterparts of the operators, for small tables."""

from __future__ import annotations

import hashlib
import zlib
from itertools import combinations


def shingles(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def groups(rows: list[tuple], width: int, percent: int) -> dict:
    """doc_id -> (n_shingles, component) by comparing every two sets that share a shingle."""
    sets = {i: shingles(t, width) for i, t in rows}
    holders: dict = {}
    for i, found in sets.items():
        for s in found:
            holders.setdefault(s, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {p for members in holders.values() for p in combinations(sorted(members), 2)}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def edits(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def dropped_lines(rows: list[tuple], least_words: int) -> dict:
    """doc_id -> numbers of the lines that an earlier line is a copy of."""
    out: dict = {}
    seen: set = set()
    by_size: dict = {}
    for i, text in sorted(rows):
        out[i] = []
        for number, line in enumerate((text or "").split("\n") if text is not None else []):
            words = line.encode().split()
            if not words:
                continue
            near = line in seen
            if not near and len(words) >= least_words:
                for size in (len(words) - 1, len(words), len(words) + 1):
                    near = near or any(
                        len(set(words) ^ set(other)) <= 2 and edits(words, other) <= 1 for other in by_size.get(size, []))
            if near:
                out[i].append(number)
            if line not in seen:
                seen.add(line)
                if len(words) >= least_words:
                    by_size.setdefault(len(words), []).append(words)
    return out


def edited(rows: list[tuple]) -> dict:
    """doc_id -> (characters, hash of the edited text, next doc_id)."""
    ordered = sorted(rows, reverse=True)
    out = {}
    for at, (i, text) in enumerate(ordered):
        following = ordered[(at + 1) % len(ordered)]
        third = len(text) // 3
        changed = text[:len(text) - third] + following[1][:third]
        out[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), following[0])
    return out


def phrase_set(text: str) -> set:
    data, found, begin = text.encode(), set(), 0
    for end in range(1, len(data) + 1):
        if data[begin:end] not in found:
            found.add(data[begin:end])
            begin = end
    return found


def smallest(text: str, model) -> tuple[str, float]:
    """The language whose dictionary gives the fewest bytes, and the margin, one compressor after the other."""
    import zstandard

    from emberlog.llm import language

    data, sizes = text.lower().encode(), []
    for name, raw in model.dictionaries.items():
        known = zstandard.ZstdCompressionDict(raw[:-language.LEAD], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=model.level)
        pack = zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False).compress
        lead, total = raw[-language.LEAD:], 0
        for at in range(0, len(data), model.piece):
            part = data[at:at + model.piece]
            total += len(pack(part)) if len(part) >= language.SHORT else len(pack(lead + part)) - len(pack(lead))
        sizes.append((max(0, total), name))
    (first, name), (second, _) = sorted(sizes, key=lambda x: x[0])[:2]
    return name, (second - first) / max(1, second)


def pseudo_likelihood(text: str | None, flat, known: list[str], counts: dict) -> tuple[int, float]:
    """Words and summed log-probability of a text, one word at a time."""
    import math

    import numpy as np

    from emberlog.llm import scoring

    tables, to_class, class_bias, to_word, word_bias = scoring.unpack(flat.astype(np.float64))
    base, index = scoring.WORDS - scoring.RARE, {w: i for i, w in enumerate(known)}
    words = (text or "").lower().split()
    spot = lambda w: index.get(w, base + zlib.crc32(w.encode()) % scoring.RARE)
    room = {}
    for w, n in counts.items():
        if w not in index:
            room[spot(w)] = room.get(spot(w), 0) + n
    total = 0.0
    for at, word in enumerate(words):
        hidden, places = 0.0, [k for k in range(-scoring.SIDE, scoring.SIDE + 1) if k]
        for table, k in zip(tables, places):
            hidden = hidden + table[spot(words[at + k]) if 0 <= at + k < len(words) else scoring.WORDS]
        hidden = np.tanh(hidden)
        c, w = divmod(spot(word), scoring.PER_CLASS)
        for logits, pick in ((hidden @ to_class + class_bias, c), (hidden @ to_word[c] + word_bias[c], w)):
            total += logits[pick] - np.log(np.exp(logits).sum())
        if word not in index:
            rest = room.get(spot(word), 0) + 1
            total += math.log(counts[word] / rest) if word in counts else (
                math.log(scoring.RARE / rest) - (len(word.encode()) + 1) * math.log(257))
    return len(words), total


def packed(lengths: list[int], sizes: tuple[int, ...], overhead: int) -> tuple[int, list[list[int]]]:
    """Cost and contents of the cheapest packing, by trying every open bin for every piece, longest piece first."""
    best = None
    for limit in sizes:
        bins, to_come = [], sum(lengths)  # a bin: [size, contents]
        for n in sorted(lengths, reverse=True):
            to_come -= n
            able = [b for b in bins if b[0] - sum(b[1]) >= n]
            if able:
                # The least room; of equal ones the bin that was opened first.
                min(able, key=lambda b: b[0] - sum(b[1]))[1].append(n)
                continue
            room = sum(b[0] - sum(b[1]) for b in bins)
            fits = [s for s in sizes if s >= n and (s <= limit or s == min(x for x in sizes if x >= n))]
            bins.append([min(fits, key=lambda s: (s + overhead) / min(s, n + max(0, to_come - room))), [n]])
        cost = sum(min(s for s in sizes if s >= sum(c)) + overhead for _, c in bins)
        if best is None or cost < best[0]:
            best = cost, [c for _, c in bins]
    return best
