"""Regular motifs as regular expressions of the JVM.

Motifs made of letters, classes, gaps, repeats, alternatives, anchors and mismatch budgets become one
expression.  The reverse strand is searched on the reversed text with the classes complemented, so that no text
is complemented before something is found in it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from itertools import combinations
from string import ascii_uppercase

from ..alphabet import COMPLEMENT, IUPAC
from .motif import Alt, AnyOne, Cls, Codes, Edge, Fuzzy, Lit, Named, Pattern, Rep, Seq, columns, normal, span

#: A mismatch budget with more placements than this is not spelt out (the position kernels count mismatches instead).
MOST_FORMS = 200
#: Marks around a text: its strand begins here, it doesn't; its strand ends here, it doesn't.
FIRST, INNER, LAST, OPEN = "\x02", "\x01", "\x03", "\x04"
NEVER = "(?!)"


class Irregular(Exception):
    """A motif, or a part of one, that no regular expression stands for."""


def mirrored(chars: str) -> str:
    """The letters whose complement is among the given ones."""
    return "".join(c for c in ascii_uppercase if COMPLEMENT.get(c, "N") in chars)


def _written(node, nuc: bool, one: Callable[[str | None, bool], str], start: str, end: str, groups: list | None) -> str:
    """A motif as an expression; ``one`` spells a set of letters (None: any) or its opposite, ``groups`` collects what is captured."""
    taken = 0  # capturing groups so far

    def forms(x: Fuzzy) -> str:
        allowed = columns(x.inner, nuc)
        free = [p for p, chars in enumerate(allowed) if chars is not None]
        wrong = min(int(x.k), len(free))
        if wrong < 0:
            return NEVER
        if math.comb(len(free), wrong) > MOST_FORMS:
            raise Irregular
        spelt = [one(chars, False) if chars is not None else one(None, False) for chars in allowed]
        ways = ["".join(one(None, False) if p in hidden else s for p, s in enumerate(spelt)) for hidden in map(set, combinations(free, wrong))]
        return f"(?:{'|'.join(ways)})"

    def located(kind: str, label: str, allowed: list | None, text: Callable[[], str]) -> str:
        """A part whose place is wanted: what follows its start and its own text are captured."""
        nonlocal taken
        groups.append((kind, label, taken + 1, [chars if chars is not None else ascii_uppercase for chars in allowed or []]))
        taken += 2
        return rf"(?=([\s\S]*))({text()})"

    def go(x, repeated: bool) -> str:
        nonlocal taken
        if isinstance(x, Lit):
            return "".join(one(c, False) for c in normal(x.text, nuc))
        if isinstance(x, Codes):
            return "".join(one(IUPAC[c], False) for c in x.text)
        if isinstance(x, Cls):
            return one(normal(x.chars, nuc), x.negated)
        if isinstance(x, AnyOne):
            return one(None, False)
        if isinstance(x, Edge):
            return end if x.at_end else start
        if isinstance(x, Seq):
            return "".join(go(p, repeated) for p in x.parts)
        if isinstance(x, Alt):
            return f"(?:{'|'.join(go(p, repeated) for p in x.parts)})" if x.parts else NEVER
        if isinstance(x, Rep):
            # The language skips empty rounds of a repetition, regular expressions don't.
            if not x.run and span(x.inner)[0] == 0:
                raise Irregular
            if x.hi is not None and x.hi < x.lo:
                return NEVER
            return f"(?:{go(x.inner, repeated or x.hi != 1)}){{{x.lo},{'' if x.hi is None else x.hi}}}"
        if isinstance(x, Named):
            return go(x.inner, repeated) if groups is None else located("label", x.label, None, lambda: go(x.inner, repeated))
        if isinstance(x, Fuzzy):
            if repeated:  # mismatches of earlier rounds would be lost
                raise Irregular
            return forms(x) if groups is None else located("fuzzy", "", columns(x.inner, nuc), lambda: forms(x))
        if isinstance(x, Pattern):
            taken += re.compile(x.text).groups
            return f"(?>(?i:{x.text}))"
        raise Irregular

    return go(node, False)


def _letter_set(mirror: bool) -> Callable[[str | None, bool], str]:
    """Sets of the letters A-Z; mirrored ones match what would be their complement."""

    def one(chars: str | None, negated: bool) -> str:
        if chars is None:
            return "[A-Z]"
        wanted = "".join(c for c in ascii_uppercase if (c in chars) != negated)
        wanted = mirrored(wanted) if mirror else wanted
        return NEVER if not wanted else wanted if len(wanted) == 1 else f"[{wanted}]"

    return one


def _any_text(chars: str | None, negated: bool) -> str:
    """Sets in texts that may hold other characters than letters."""
    if chars is None or (negated and not chars):
        return r"[\s\S]"
    escaped = re.sub(r"([\\\]\[^\-&])", r"\\\1", chars)
    return f"[^{escaped}]" if negated else f"[{escaped}]" if chars else NEVER


def whole(node, nuc: bool) -> str | None:
    """The expression that takes up a whole text of any characters, or None."""
    try:
        return rf"\A(?:{_written(node, nuc, _any_text, r'\A', r'\z', None)})\z"
    except Irregular:
        return None


def hatch(node) -> bool:
    """Whether a motif has a part written as a regular expression, which may look anywhere."""
    if isinstance(node, Pattern):
        return True
    inner = getattr(node, "parts", None) or [x for x in (getattr(node, "inner", None), getattr(node, "loop", None)) if x is not None]
    return any(map(hatch, inner))


def patterns(node, nuc: bool) -> dict | None:
    """forward, backward and located expressions of a regular motif and the groups of the last, or None.

    Texts are letters between marks (see FIRST, LAST). ``backward`` reads the reversed text; ``located`` reads a hit's
    own text. An expression that looks anywhere reads whole strands without marks and has no backward one.
    """
    free = hatch(node)
    if span(node)[0] == 0 and not free:  # of alternatives the first that isn't empty counts
        return None
    edges = (r"\A", r"\z") if free else (f"(?<={FIRST})", f"(?={LAST})")
    groups: list = []
    try:
        forward = _written(node, nuc, _any_text if free else _letter_set(False), *edges, None)
        backward = None if free or not nuc else _written(node, nuc, _letter_set(True), *edges, None)
        located = _written(node, nuc, _letter_set(False), f"(?<={FIRST})", f"(?={LAST})", groups)
    except Irregular:
        return None
    labels = [label for kind, label, _, _ in groups if kind == "label"]
    if len(set(labels)) < len(labels):
        return None
    return {"forward": forward, "backward": backward, "located": rf"\A[{INNER}{FIRST}](?:{located})" if groups else None, "groups": groups, "free": free}
