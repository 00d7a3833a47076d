"""Irregular motifs at work on one stretch of text: weights, edits, hairpins and what is built of them.

Regular motifs, mismatch budgets included, are expressions of the JVM (see :mod:`.patterns`).  Here the first match at
each start is found by array arithmetic over all starts at once, or by backtracking where parts of several kinds are nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from ..alphabet import PAIRS, WOBBLE, reverse_complement
from .motif import Alt, AnyOne, Cls, Edge, Edit, Fuzzy, Hairpin, Named, Pattern, Pwm, Rep, Seq, columns, motif, nodes, normal

#: Hits: starts, ends, numbers by name, bounds (starts, ends) by label; absent ones are NaN and -1.
Found = tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], dict[str, tuple[np.ndarray, np.ndarray]]]


# --------------------------------------------------------------- arithmetic


def _parts(node) -> list | None:
    """A motif as a chain of blocks of fixed width and gaps: (kind, label, node), or None."""
    if isinstance(node, Seq):
        each = [_parts(p) for p in node.parts]
        return None if any(e is None for e in each) else [x for e in each for x in e]
    if isinstance(node, Named):
        inner = _parts(node.inner)
        return None if inner is None or len(inner) != 1 or inner[0][1] else [(inner[0][0], node.label, inner[0][2])]
    if isinstance(node, Rep) and node.run and isinstance(node.inner, AnyOne) and node.hi is not None:
        return [("gap", None, node)]
    if isinstance(node, (Fuzzy, Pwm)) or columns(node, True) is not None:
        return [("block", None, node)]
    return None


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1", "replace"), np.uint8)


def _misses(code: np.ndarray, allowed: list, n: int) -> np.ndarray:
    out = np.zeros(n, np.int16)
    for p, chars in enumerate(allowed):
        if chars is not None:
            wrong = np.ones(256, np.int16)
            wrong[np.frombuffer(chars.encode("latin-1"), np.uint8)] = 0
            out += wrong[code[p : p + n]]
    return out


def _weights(code: np.ndarray, pwm: Pwm, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = pwm.bounds()
    out = np.zeros(n)
    for p in range(pwm.width):
        table = np.full(256, low / pwm.width)
        for letter, w in pwm.rows:
            table[ord(letter)] = w[p]
        out += table[code[p : p + n]]
    return out, (out - low) / (high - low) if high != low else np.ones(n)


def _half_up(x):
    return np.floor(x * 1000 + 0.5) / 1000


def _chain(parts: list, nuc: bool):
    """First match at each start of blocks and gaps: validity is settled from the last part to the first, choices are then read off forwards."""

    def run(text: str) -> Found:
        code, size = _codes(text), len(text)
        valid = np.ones(size + 1, bool)
        steps = []
        for kind, label, node in reversed(parts):
            now, jump, numbers = np.zeros(size + 1, bool), np.zeros(size + 1, np.int64), None
            if kind == "gap":
                for g in range(int(node.hi), int(node.lo) - 1, -1):
                    if g > size:
                        continue
                    fresh = valid[g:] & ~now[: size + 1 - g]
                    now[: size + 1 - g] |= fresh
                    jump[: size + 1 - g][fresh] = g
            else:
                if isinstance(node, Pwm):
                    width, n = node.width, max(0, size - node.width + 1)
                    score, share = _weights(code, node, n)
                    ok, numbers = share >= node.threshold, ("pwm", score, share)
                else:
                    allowed = columns(node.inner if isinstance(node, Fuzzy) else node, nuc)
                    width, n = len(allowed), max(0, size - len(allowed) + 1)
                    miss = _misses(code, allowed, n)
                    ok = miss <= (node.k if isinstance(node, Fuzzy) else 0)
                    numbers = ("fuzzy", miss) if isinstance(node, Fuzzy) else None
                now[:n] = ok & valid[width : width + n]
                jump[:] = width
            steps.append((label, jump, numbers))
            valid = now
        starts = np.flatnonzero(valid[:size])
        at, numbers_of, bounds = starts.copy(), {}, {}
        for label, jump, numbers in reversed(steps):
            to = at + jump[at]
            if numbers and numbers[0] == "pwm":
                numbers_of |= {"score": _half_up(numbers[1][at]), "relative": _half_up(numbers[2][at])}
            elif numbers:
                numbers_of["mismatches"] = numbers_of.get("mismatches", 0.0) + numbers[1][at].astype(float)
            if label:
                bounds[label] = (at, to)
            at = to
        some = at > starts
        return starts[some], at[some], {k: v[some] for k, v in numbers_of.items()}, {k: (a[some], b[some]) for k, (a, b) in bounds.items()}

    return run


def _hairpins(node: Hairpin):
    """Stems from the longest to the shortest and loops from the widest to the narrowest; the first that pairs counts."""
    pairs = PAIRS | (WOBBLE if node.wobble else set())
    loops = range(int(node.loop.hi), int(node.loop.lo) - 1, -1)

    def run(text: str) -> Found:
        code, size = _codes(text), len(text)
        bad = np.ones((256, 256), np.int8)
        for a, b in pairs:
            bad[ord(a), ord(b)] = 0
        unpaired = {}  # by distance
        stem, loop = np.zeros(size, np.int32), np.zeros(size, np.int32)
        for length in range(node.hi, node.lo - 1, -1):
            for gap in loops:
                n = size - (2 * length + gap) + 1
                if n <= 0:
                    continue
                errors = np.zeros(n, np.int16)
                for k in range(length):
                    d = 2 * (length - k) + gap - 1
                    if d not in unpaired:
                        unpaired[d] = bad[code[: size - d], code[d:]]
                    errors += unpaired[d][k : k + n]
                fresh = np.flatnonzero((errors <= node.mismatches) & (stem[:n] == 0))
                stem[fresh], loop[fresh] = length, gap
        i = np.flatnonzero(stem)
        a = i + stem[i]
        b = a + loop[i]
        return i, b + stem[i], {}, {"stem5": (i, a), "loop": (a, b), "stem3": (b, b + stem[i])}

    return run


def _edits(node: Edit, nuc: bool):
    """Edit distances of the literal to all prefixes at all starts at once; the nearest counts, of equally near ones the longest."""
    want = _codes(normal(node.text, nuc))

    def run(text: str) -> Found:
        code, size, wide = _codes(text), len(text), len(want) + node.k
        padded = np.concatenate([code, np.zeros(wide + 1, np.uint8)])
        row = [np.full(size, c, np.int16) for c in range(wide + 1)]
        for r, letter in enumerate(want, 1):
            new = [np.full(size, r, np.int16)]
            for c in range(1, wide + 1):
                miss = (padded[c - 1 : c - 1 + size] != letter).astype(np.int16)
                new.append(np.minimum(np.minimum(row[c], new[-1]) + 1, row[c - 1] + miss))
            row = new
        best, width = np.full(size, node.k + 1, np.int16), np.zeros(size, np.int32)
        for c in range(wide, 0, -1):
            inside = np.arange(size) + c <= size
            better = inside & (row[c] < best)
            best[better], width[better] = row[c][better], c
        i = np.flatnonzero(width)
        return i, i + width[i], {"edits": best[i].astype(float)}, {}

    return run


# ------------------------------------------------------------- backtracking


def _steps(node, nuc: bool):
    """f(text, i, bound, first, last): all ends at i in priority order, with what was bound; anchors hold at first and last."""
    if isinstance(node, Seq):
        inner = [_steps(p, nuc) for p in node.parts]

        def chain(text, i, bound, first, last, k=0):
            if k == len(inner):
                yield i, bound
                return
            for j, b in inner[k](text, i, bound, first, last):
                yield from chain(text, j, b, first, last, k + 1)

        return chain
    if isinstance(node, Alt):
        inner = [_steps(p, nuc) for p in node.parts]
        return lambda text, i, bound, first, last: (x for f in inner for x in f(text, i, bound, first, last))
    if isinstance(node, Rep):
        one = _steps(node.inner, nuc)

        def repeat(text, i, bound, first, last, done=0):
            if node.hi is None or done < node.hi:
                for j, b in one(text, i, bound, first, last):
                    if j > i:
                        yield from repeat(text, j, b, first, last, done + 1)
            if done >= node.lo:
                yield i, bound

        def run(text, i, bound, first, last):
            j = i
            while j < len(text) and (node.hi is None or j - i < node.hi) and any(True for _ in one(text, j, {}, first, last)):
                j += 1
            for to in range(j, i + int(node.lo) - 1, -1):
                yield to, bound

        return run if node.run else repeat
    if isinstance(node, Named):
        inner = _steps(node.inner, nuc)
        return lambda text, i, bound, first, last: ((j, b | {node.label: (i, j)}) for j, b in inner(text, i, bound, first, last))
    if isinstance(node, Edge):
        return lambda text, i, bound, first, last: iter([(i, bound)] if i == (last if node.at_end else first) else [])
    if isinstance(node, Pattern):
        pattern = re.compile(node.text, re.I)

        def escape(text, i, bound, first, last):
            if m := pattern.match(text, i):
                yield m.end(), bound

        return escape
    if isinstance(node, Hairpin):
        loop_of = _steps(node.loop, nuc)
        pairs = PAIRS | (WOBBLE if node.wobble else set())

        def hairpin(text, i, bound, first, last):
            for size in range(node.hi, node.lo - 1, -1):
                if i + 2 * size > len(text):
                    continue
                for j, b in loop_of(text, i + size, bound, first, last):
                    other = text[j : j + size][::-1]
                    if len(other) == size and sum(x + y not in pairs for x, y in zip(text[i : i + size], other)) <= node.mismatches:
                        yield j + size, b | {"stem5": (i, i + size), "loop": (i + size, j), "stem3": (j, j + size)}

        return hairpin
    if isinstance(node, Edit):
        letters = normal(node.text, nuc)

        def edit(text, i, bound, first, last):
            window = text[i : i + len(letters) + node.k]
            row = list(range(len(window) + 1))
            for r, a in enumerate(letters, 1):
                new = [r]
                for c, b in enumerate(window, 1):
                    new.append(min(row[c] + 1, new[-1] + 1, row[c - 1] + (a != b)))
                row = new
            for d, c in sorted(((d, -c) for c, d in enumerate(row) if c and d <= node.k)):
                yield i - c, bound | {"$edits": bound.get("$edits", 0) + d}

        return edit
    if isinstance(node, Pwm):

        def pwm(text, i, bound, first, last):
            if i + node.width <= len(text):
                score, share = _weights(_codes(text[i : i + node.width]), node, 1)
                if share[0] >= node.threshold:
                    yield i + node.width, bound | {"$score": _half_up(score[0]), "$relative": _half_up(share[0])}

        return pwm
    # What is left has a fixed width: literals, codes, classes and fuzzy ones.
    fuzzy = isinstance(node, Fuzzy)
    negated = isinstance(node, Cls) and node.negated
    allowed = [normal(node.chars, nuc)] if negated else columns(node.inner if fuzzy else node, nuc)

    def fixed(text, i, bound, first, last):
        if i + len(allowed) <= len(text):
            wrong = sum(a is not None and (c in a) == negated for a, c in zip(allowed, text[i : i + len(allowed)]))
            if wrong <= (node.k if fuzzy else 0):
                yield i + len(allowed), bound | {"$mismatches": bound.get("$mismatches", 0) + wrong} if fuzzy else bound

    return fixed


def backtracking(node, nuc: bool):
    """f(text, first, last) -> hits, whatever the motif."""
    step = _steps(node, nuc)

    def run(text: str, first: int, last: int) -> Iterator[tuple[int, int, dict, list]]:
        for i in range(len(text) + 1):
            for j, b in step(text, i, {}, first, last):
                if j > i:
                    yield i, j, {k[1:]: v for k, v in b.items() if k[0] == "$"}, [(k, *v) for k, v in b.items() if k[0] != "$"]
                    break

    return run


# --------------------------------------------------------------------- all


class Kernel:
    """An irregular motif compiled for one alphabet; it finds regular ones as well, if slowly."""

    def __init__(self, node, nuc: bool):
        self.node, self.nuc = node, nuc
        self._general = backtracking(node, nuc)
        self._array, parts = None, _parts(node)
        if parts is not None and len({label for _, label, _ in parts if label}) == sum(bool(label) for _, label, _ in parts):
            self._array = _chain(parts, nuc)
        elif isinstance(node, Hairpin) and isinstance(node.loop, Rep) and node.loop.run and isinstance(node.loop.inner, AnyOne) and node.loop.hi is not None:
            self._array = _hairpins(node)
        elif isinstance(node, Edit):
            self._array = _edits(node, nuc)

    def general(self, text: str, first: int, last: int) -> Found:
        """Hits by backtracking; first and last are where the strand begins and ends, seen from the text."""
        hits = list(self._general(text, first, last))
        names = list(dict.fromkeys(k for h in hits for k in h[2]))
        labels = [x for x in dict.fromkeys(n for node in nodes(self.node) for n in ([node.label] if isinstance(node, Named) else ["stem5", "loop", "stem3"] if isinstance(node, Hairpin) else []))]
        bound = [{label: (a, b) for label, a, b in h[3]} for h in hits]
        at = lambda k: np.array([h[k] for h in hits], np.int64)
        place = lambda label, k: np.array([b[label][k] if label in b else -1 for b in bound], np.int64)
        return at(0), at(1), {n: np.array([h[2].get(n, np.nan) for h in hits], float) for n in names}, {x: (place(x, 0), place(x, 1)) for x in labels}

    def hits(self, text: str, first: int = 0, last: int | None = None) -> Found:
        """Hits in a text."""
        return self._array(text) if self._array else self.general(text, first, len(text) if last is None else last)

    @property
    def joinable(self) -> bool:
        """Whether texts may be searched end to end: paired stems cannot reach over a border that is as wide as the widest match."""
        return self._array is not None and isinstance(self.node, Hairpin) and not self.node.mismatches

    def of_many(self, texts: list[str]) -> list[Found]:
        """Hits of several texts, searched end to end."""
        border = "\0" * int(2 * self.node.hi + self.node.loop.hi + 1)
        begin = np.cumsum([0] + [len(t) + len(border) for t in texts])
        i, j, numbers, bounds = self.hits(border.join(texts))
        cut = np.searchsorted(i, begin)
        part = lambda x, k: x[cut[k] : cut[k + 1]] - begin[k]
        return [(part(i, k), part(j, k), {}, {label: (part(a, k), part(b, k)) for label, (a, b) in bounds.items()}) for k in range(len(texts))]

    def of_tile(self, text: str, own: tuple[int, int], base: int, n: int, strand: str, ready: tuple[Found | None, Found | None] = (None, None)) -> tuple[Found, np.ndarray, list[str]]:
        """Hits of a tile's own starts in forward positions of its text, whether each is forward, and the matched texts.

        A reverse hit belongs to the tile of its last forward letter; one that repeats a palindrome's forward hit is left out.
        ``ready`` has the hits of the text and of its reverse complement, where they are known.
        """
        size, both = len(text), self.nuc and strand == "both"
        parts, ahead, texts = [], [], []
        if strand != "-" or not self.nuc:
            i, j, numbers, bounds = found = ready[0] or self.hits(text, -base, n - base)
            mine = np.flatnonzero((own[0] <= i) & (i < own[1]))
            parts.append((i[mine], j[mine], {k: v[mine] for k, v in numbers.items()}, {k: (a[mine], b[mine]) for k, (a, b) in bounds.items()}))
            ahead.append(np.ones(len(mine), bool))
            texts += [text[a:b] for a, b in zip(i[mine].tolist(), j[mine].tolist())]
        if self.nuc and strand != "+":
            back = reverse_complement(text)
            i, j, numbers, bounds = ready[1] or self.hits(back, base + size - n, base + size)
            a, b = size - j, size - i
            keep = (own[0] < b) & (b <= own[1])
            if both:
                ends = np.full(size + 1, -1, np.int64)
                ends[found[0]] = found[1]
                for k in np.flatnonzero(keep & (ends[a] == b)).tolist():
                    keep[k] = back[i[k] : j[k]] != text[a[k] : b[k]]
            mine = np.flatnonzero(keep)
            turned = lambda x: np.where(x < 0, -1, size - x)
            parts.append((a[mine], b[mine], {k: v[mine] for k, v in numbers.items()}, {k: (turned(y[mine]), turned(x[mine])) for k, (x, y) in bounds.items()}))
            ahead.append(np.zeros(len(mine), bool))
            texts += [back[p:q] for p, q in zip(i[mine].tolist(), j[mine].tolist())]
        names, labels = dict.fromkeys(k for p in parts for k in p[2]), dict.fromkeys(k for p in parts for k in p[3])
        numbers = {k: np.concatenate([p[2].get(k, np.full(len(p[0]), np.nan)) for p in parts]) for k in names}
        none = lambda p: np.full(len(p[0]), -1, np.int64)
        bounds = {k: tuple(np.concatenate([p[3][k][e] if k in p[3] else none(p) for p in parts]) for e in (0, 1)) for k in labels}
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), numbers, bounds), np.concatenate(ahead), texts


@lru_cache(maxsize=4096)
def kernel(source: str, nuc: bool) -> Kernel:
    """A motif's source compiled, once a Python worker."""
    return Kernel(motif(source), nuc)


@lru_cache(maxsize=4096)
def taken_up(source: str, nuc: bool):
    """f(text) -> whether a motif can take up a text as a whole."""
    step = _steps(motif(source), nuc)
    return lambda text: any(j == len(text) for j, _ in step(text, 0, {}, 0, len(text)))
