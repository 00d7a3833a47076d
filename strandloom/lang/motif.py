"""The motif language: s-expressions read into a tree of small nodes.

A motif is read on the driver once and handed to Spark as a pattern (see :mod:`.regex`) or to
the position kernels of the search (see :mod:`.kernels`).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from ..alphabet import IUPAC, reverse_complement


class MotifError(ValueError):
    """Whatever is wrong with a motif, raised before any Spark job starts."""


class Symbol(str):
    """A bare word."""


@dataclass(frozen=True)
class Lit:
    text: str


@dataclass(frozen=True)
class Codes:
    """IUPAC codes, one a position."""

    text: str


@dataclass(frozen=True)
class Cls:
    """One character out of (or outside of) a set."""

    chars: str
    negated: bool = False


@dataclass(frozen=True)
class AnyOne:
    pass


@dataclass(frozen=True)
class Edge:
    """The start or the end of the strand's text."""

    at_end: bool


@dataclass(frozen=True)
class Seq:
    parts: tuple
    shown: str | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Rep:
    """Greedy repetition; hi None means without bound. ``run`` marks a repetition of one character class."""

    inner: object
    lo: int
    hi: int | None
    run: bool = False


@dataclass(frozen=True)
class Named:
    label: str
    inner: object


@dataclass(frozen=True)
class Fuzzy:
    k: int
    inner: object


@dataclass(frozen=True)
class Edit:
    k: int
    text: str


@dataclass(frozen=True)
class Hairpin:
    lo: int
    hi: int
    loop: object
    wobble: bool = False
    mismatches: int = 0


@dataclass(frozen=True)
class Pwm:
    rows: tuple  # ((letter, (weights...)), ...) sorted by letter
    threshold: float = 0.8

    @property
    def width(self) -> int:
        return len(self.rows[0][1])

    def bounds(self) -> tuple[float, float]:
        low = high = 0.0
        for column in zip(*(w for _, w in self.rows)):
            low, high = low + min(column), high + max(column)
        return low, high

    def consensus(self) -> str:
        """The heaviest letter of each position; of equal ones the first in the alphabet."""
        return "".join(max(self.rows, key=lambda r, p=p: r[1][p])[0] for p in range(self.width))


@dataclass(frozen=True)
class Pattern:
    """The regular-expression escape hatch; its width is unknown."""

    text: str


# ------------------------------------------------------------------ reading

_TOKEN = re.compile(r"""\s*(?:(?P<comment>;[^\n]*)|(?P<quote>['`])|(?P<string>"(?:\\.|[^\\"])*")|(?P<word>[^\s()'`";]+)|(?P<paren>[()]))""", re.S)


def _tokens(source: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        line = source.count("\n", 0, at) + 1
        if not m:
            raise MotifError(f"line {line}: cannot read {source[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup != "comment":
            out.append((m.lastgroup, m.group(m.lastgroup), source.count("\n", 0, at) + 1))
    return out


def _atom(kind: str, text: str):
    if kind == "string":
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S)
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?", text):
        return float(text)
    return {"#t": True, "#f": False}.get(text, Symbol(text))


def read_all(source: str) -> list:
    """All forms of a text: lists, symbols, strings, numbers and booleans."""
    stack: list[list] = [[]]
    opened: list[int] = []
    quotes: list[tuple[int, int]] = []  # depth at which a quote waits for its form, and the line

    def put(form) -> None:
        while quotes and quotes[-1][0] == len(stack):
            quotes.pop()
            form = [Symbol("quote"), form]
        stack[-1].append(form)

    for kind, text, line in _tokens(source):
        if kind == "quote":
            quotes.append((len(stack), line))
        elif text == "(" and kind == "paren":
            stack.append([])
            opened.append(line)
        elif kind == "paren":
            if not opened:
                raise MotifError(f"line {line}: unexpected ')'")
            opened.pop()
            if quotes and quotes[-1][0] == len(stack):
                raise MotifError("unexpected end of input")
            put(stack.pop())
        else:
            put(_atom(kind, text))
    if opened:
        raise MotifError(f"line {opened[-1]}: missing ')'")
    if quotes:
        raise MotifError("unexpected end of input")
    return stack[0]


def read(source: str):
    """The one form of a text."""
    forms = read_all(source)
    if not forms:
        raise MotifError("unexpected end of input")
    if len(forms) > 1:
        raise MotifError("more than one expression")
    return forms[0]


def balanced(source: str) -> bool:
    """Whether each parenthesis is closed; never raises."""
    try:
        marks = [text for kind, text, _ in _tokens(source) if kind == "paren"]
    except MotifError:
        return False
    return marks.count("(") == marks.count(")")


# ----------------------------------------------------------------- building


def options(items: list) -> tuple[list, dict]:
    """Positional arguments and :key value pairs; a key at the end without a value is positional."""
    args, named, at = [], {}, 0
    while at < len(items):
        x = items[at]
        if isinstance(x, Symbol) and x.startswith(":") and len(x) > 1 and at + 1 < len(items):
            named[x[1:].replace("-", "_")] = items[at + 1]
            at += 2
        else:
            args.append(x)
            at += 1
    return args, named


def label_of(form) -> str:
    """The name in 'x, :x, "x" or x."""
    if isinstance(form, list) and len(form) == 2 and form[0] == "quote":
        return label_of(form[1])
    if not isinstance(form, str):
        raise MotifError(f"not a name: {form}")
    return form[1:] if form.startswith(":") and len(form) > 1 else str(form)


def prosite(pattern: str) -> Seq:
    """A PROSITE pattern: elements between dashes, x, [..], {..}, (n), (n,m), < and >."""
    parts: list = []
    for element in re.sub(r"\s+", "", re.sub(r"\.$", "", pattern.strip())).split("-"):
        m = re.fullmatch(r"(?P<start><)?(?P<what>\[[A-Z]+\]|\{[A-Z]+\}|[A-Zx])(\((?P<lo>\d+)(,(?P<hi>\d+))?\))?(?P<end>>)?", element)
        if not m:
            raise MotifError(f'prosite: cannot read element "{element}" in "{pattern}"')
        what = m["what"]
        node = AnyOne() if what == "x" else Cls(what[1:-1], what[0] == "{") if len(what) > 1 else Lit(what)
        if m["lo"]:
            node = Rep(node, int(m["lo"]), int(m["hi"] or m["lo"]), run=not isinstance(node, Lit))
        parts += [Edge(False)] * bool(m["start"]) + [node] + [Edge(True)] * bool(m["end"])
    return Seq(tuple(parts), f'(prosite "{pattern}")')


def pwm_from_sites(sites: list[str], threshold: float = 0.8, pseudocount: float = 0.5) -> Pwm:
    """Log-odds weights against an even background, in bits."""
    clean = [s.upper().replace("U", "T") for s in sites]
    if not clean:
        raise MotifError("pwm: no sites")
    if len({len(s) for s in clean}) > 1:
        raise MotifError("pwm: all sites must be the same length")
    columns = list(zip(*clean))
    total = [4 * pseudocount + sum(c.count(x) for x in "ACGT") for c in columns]
    rows = [(x, tuple(math.log2((c.count(x) + pseudocount) / t / 0.25) for c, t in zip(columns, total))) for x in "ACGT"]
    return Pwm(tuple(rows), threshold)


def pwm_of(rows: dict[str, list[float]], threshold: float = 0.8) -> Pwm:
    if len({len(w) for w in rows.values()}) != 1:
        raise MotifError("pwm: rows differ in length")
    return Pwm(tuple(sorted((k.upper().replace("U", "T", 1), tuple(map(float, w))) for k, w in rows.items())), threshold)


def _checked(op: str, args: list, at: int, kind, what: str):
    x = args[at] if at < len(args) else None
    ok = isinstance(x, kind) and not isinstance(x, (bool, Symbol))
    if not ok:
        raise MotifError(f"{op}: {what} must be a {'number' if kind is not str else 'string in quotes'}, got {x}")
    return x


def build(form, named: dict[str, object] | None = None):
    """A form as a tree of nodes; bare symbols are anchors or motifs of ``named``."""
    if isinstance(form, Symbol):
        fixed = {"at-start": Edge(False), "at-end": Edge(True), "any": AnyOne()}
        if form in fixed:
            return fixed[form]
        if named and form in named:
            return named[form]
        raise MotifError(f"unknown motif name: {form}")
    if isinstance(form, str):
        return Lit(form)
    if not isinstance(form, list):
        raise MotifError(f"not a motif: {form}")
    if not form:
        raise MotifError("empty motif")
    if not isinstance(form[0], Symbol):
        raise MotifError(f"a motif must start with a name, got {form[0]}")
    op = str(form[0])
    args, key = options(form[1:])

    def sub(at: int):
        if at >= len(args):
            raise MotifError(f"{op}: a motif is missing")
        return build(args[at], named)

    def number(at: int, what: str):
        return _checked(op, args, at, (int, float), what)

    def text(what: str, at: int = 0) -> str:
        return _checked(op, args, at, str, what)

    def between(at: int, lo=None, hi=None, same: bool = False):
        lo = number(at, "the minimum") if len(args) > at or lo is None else lo
        return lo, number(at + 1, "the maximum") if len(args) > at + 1 else lo if same else hi

    if op == "quote":
        return sub(0)
    if op == "seq":
        return Seq(tuple(build(a, named) for a in args))
    if op == "alt":
        listed = [y for a in args for y in (a if isinstance(a, list) and a and not isinstance(a[0], Symbol) else [a])]
        return Alt(tuple(build(a, named) for a in listed))
    if op == "literal":
        return Lit(text("the sequence"))
    if op in ("iupac", "dna", "rna"):
        codes = text("the pattern").upper()
        if bad := next((c for c in codes if c not in IUPAC), None):
            raise MotifError(f"iupac: {bad} is not a nucleotide code")
        return Codes(codes)
    if op in ("prosite", "protein"):
        return prosite(text("the pattern"))
    if op == "regex":
        try:
            re.compile(text("the pattern"))
        except re.error as e:
            raise MotifError(f"regex: {e}") from None
        return Pattern(text("the pattern"))
    if op in ("any-of", "none-of"):
        return Cls(text("the characters").upper(), op == "none-of")
    if op == "any":
        return AnyOne()
    if op in ("gap", "loop"):
        if op == "loop" and not isinstance(args[0] if args else None, int):
            return sub(0)
        return Rep(AnyOne(), *between(0, same=True), run=True)
    if op == "run":
        return Rep(Cls(text("the characters").upper()), *between(1, lo=1), run=True)
    if op == "repeat":
        inner, (lo, hi) = sub(0), between(1, lo=0)
        run = isinstance(inner, (Cls, AnyOne))
        if not run and hi is not None and hi < lo:
            raise MotifError("repeat: the maximum is below the minimum")
        return Rep(inner, lo, hi, run)
    if op == "opt":
        return Rep(sub(0), 0, 1)
    if op == "exactly":
        return Rep(sub(0), number(1, "the count"), number(1, "the count"))
    if op == "named":
        return Named(label_of(args[0] if args else None), sub(1))
    if op == "fuzzy":
        node = Fuzzy(number(0, "the mismatch budget"), sub(1))
        if columns(node.inner, True) is None:
            raise MotifError("fuzzy needs a motif of fixed width")
        return node
    if op == "edit":
        return Edit(number(0, "the edit budget"), text("the sequence", 1))
    if op == "revcomp-motif":
        return Lit(reverse_complement(text("the sequence").upper()))
    if op == "n-terminal":
        return Seq((Edge(False), sub(0)))
    if op == "c-terminal":
        return Seq((sub(0), Edge(True)))
    if op == "hairpin":
        stem = args[0] if args else None
        if not (isinstance(stem, list) and stem and stem[0] == "stem"):
            raise MotifError("hairpin: the first argument must be (stem min max)")
        sizes = [x for x in stem[1:] if isinstance(x, int)]
        if not sizes:
            raise MotifError("stem: the minimum must be a number")
        loop = Rep(AnyOne(), *between(1, same=True), run=True) if len(args) > 1 and isinstance(args[1], int) else sub(1)
        return Hairpin(sizes[0], sizes[-1], loop, bool(key.get("wobble")), key.get("mismatches", 0))
    if op == "pwm-from-sites":
        sites = args[0] if args else []
        if isinstance(sites, list) and sites and sites[0] == "quote" and isinstance(sites[0], Symbol):
            sites = sites[1]  # the quoted spelling is accepted as well
        if not all(isinstance(s, str) and not isinstance(s, Symbol) for s in sites):
            raise MotifError("pwm-from-sites: each site must be a string in quotes")
        return pwm_from_sites(sites, key.get("threshold", 0.8), key.get("pseudocount", 0.5))
    if op == "pwm":
        return pwm_of({label_of(r[0]): r[1:] for r in args[0]}, key.get("threshold", 0.8))
    raise MotifError(f"unknown motif form: ({op} ...)")


def motif(source: str, named: dict[str, object] | None = None):
    """Read and build one motif."""
    return build(read(source), named)


# ----------------------------------------------------------------- analysis


def columns(node, nuc: bool) -> list[str | None] | None:
    """The letters allowed at each position of a fixed-width node (None: any), or None if it has none."""
    if isinstance(node, Lit):
        return [c for c in normal(node.text, nuc)]
    if isinstance(node, Codes):
        return [IUPAC[c] for c in node.text]
    if isinstance(node, Cls) and not node.negated:
        return [normal(node.chars, nuc)]
    if isinstance(node, AnyOne):
        return [None]
    if isinstance(node, Named):
        return columns(node.inner, nuc)
    if isinstance(node, Seq):
        parts = [columns(p, nuc) for p in node.parts]
        return None if any(p is None for p in parts) else [x for p in parts for x in p]
    if isinstance(node, Rep) and node.run and node.lo == node.hi and (isinstance(node.inner, AnyOne) or not node.inner.negated):
        return columns(node.inner, nuc) * node.lo
    return None


def nodes(node):
    """All nodes of a motif, the outer ones first."""
    yield node
    for x in getattr(node, "parts", None) or [x for x in (getattr(node, "inner", None), getattr(node, "loop", None)) if x is not None]:
        yield from nodes(x)


def first_letters(node, nuc: bool) -> str | None:
    """The letters a match can begin with; None if it may be any, or if there is no telling."""
    if isinstance(node, (Lit, Codes, Cls)):
        allowed = columns(node, nuc)
        return allowed[0] if allowed else None
    if isinstance(node, Seq):
        for part in node.parts:
            if isinstance(part, Edge):
                continue
            return first_letters(part, nuc) if span(part)[0] > 0 else None
        return None
    if isinstance(node, Alt):
        each = [first_letters(p, nuc) for p in node.parts]
        return None if None in each or not each else "".join(sorted(set("".join(each))))
    if isinstance(node, Rep) and node.lo >= 1 or isinstance(node, Named):
        return first_letters(node.inner, nuc)
    if isinstance(node, Hairpin):
        # A stem's first letter pairs with another, if no mismatch is allowed.
        return None if node.mismatches or node.lo < 1 else "ACGT"
    return None


def check(source: str, alphabet: str) -> str | None:
    """What is wrong with a motif for records of an alphabet, for an editor to say; None if nothing is."""
    try:
        node = motif(source)
    except MotifError as e:
        return str(e)
    least, most = span(node)
    if most == 0:
        return "the motif takes up no letters"
    for x in nodes(node):
        if alphabet == "protein" and isinstance(x, (Codes, Hairpin, Pwm)):
            return f"{show(x)} needs a nucleic sequence"
        letters = x.text if isinstance(x, (Lit, Edit)) else x.chars if isinstance(x, Cls) else ""
        if alphabet != "protein" and (odd := next((c for c in letters.upper() if c not in "ACGTUN"), None)):
            return f"{odd} in {show(x)} is no base"
    return None


def normal(text: str, nuc: bool) -> str:
    """Upper case, and U as T in nucleic acids."""
    return text.upper().replace("U", "T") if nuc else text.upper()


def span(node) -> tuple[int, int | None]:
    """Least and greatest width; None means without bound."""
    if isinstance(node, (Lit, Codes)):
        return len(node.text), len(node.text)
    if isinstance(node, (Cls, AnyOne)):
        return 1, 1
    if isinstance(node, Edge):
        return 0, 0
    if isinstance(node, Seq):
        each = [span(p) for p in node.parts]
        return sum(a for a, _ in each), None if any(b is None for _, b in each) else sum(b for _, b in each)
    if isinstance(node, Alt):
        each = [span(p) for p in node.parts]
        return min((a for a, _ in each), default=0), None if any(b is None for _, b in each) else max((b for _, b in each), default=0)
    if isinstance(node, Rep):
        a, b = span(node.inner)
        return a * node.lo, None if node.hi is None or b is None else b * node.hi
    if isinstance(node, (Named, Fuzzy)):
        return span(node.inner)
    if isinstance(node, Edit):
        return max(0, len(node.text) - node.k), len(node.text) + node.k
    if isinstance(node, Hairpin):
        a, b = span(node.loop)
        return 2 * node.lo + a, None if b is None else 2 * node.hi + b
    if isinstance(node, Pwm):
        return node.width, node.width
    return 0, None


def _number(x) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def show(node) -> str:
    """The canonical text of a motif; a weight matrix shows as a summary."""
    if isinstance(node, Lit):
        return f'"{node.text}"'
    if isinstance(node, Codes):
        return f'(iupac "{node.text}")'
    if isinstance(node, Cls):
        return f'({"none-of" if node.negated else "any-of"} "{node.chars}")'
    if isinstance(node, AnyOne):
        return "any"
    if isinstance(node, Edge):
        return "at-end" if node.at_end else "at-start"
    if isinstance(node, Seq):
        return node.shown or f"(seq {' '.join(map(show, node.parts))})"
    if isinstance(node, Alt):
        return f"(alt {' '.join(map(show, node.parts))})"
    if isinstance(node, Rep):
        if node.run and isinstance(node.inner, AnyOne):
            return f"(gap {node.lo} {node.hi})" if node.hi is not None else f"(repeat any {node.lo})"
        return f"(repeat {show(node.inner)} {node.lo}{'' if node.hi is None else f' {node.hi}'})"
    if isinstance(node, Named):
        return f"(named '{node.label} {show(node.inner)})"
    if isinstance(node, Fuzzy):
        return f"(fuzzy {node.k} {show(node.inner)})"
    if isinstance(node, Edit):
        return f'(edit {node.k} "{node.text}")'
    if isinstance(node, Hairpin):
        more = " :wobble #t" * node.wobble + (f" :mismatches {node.mismatches}" if node.mismatches else "")
        return f"(hairpin (stem {node.lo} {node.hi}) {show(node.loop)}{more})"
    if isinstance(node, Pwm):
        return f"(pwm {node.consensus()} :width {node.width} :threshold {_number(node.threshold)})"
    return f'(regex "{node.text}")'
