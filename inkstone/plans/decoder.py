"""The decoding kernel: one Han run to words with readings, over a weighted lattice.

This is the in-memory half of the engine: a UDF calls it for each distinct run, with the
dictionary broadcast. ``operators.lattice`` does the same steps as DataFrame operators; the
tests hold the two to each other.

A lattice has, at each position, the dictionary's words of 2 to 16 characters from the
shortest on, then the character's readings by rank. An edge costs its word's cost plus its
rank; for readings each edge costs READING_CHARGE more, so fewer edges win there. Ties go to
the edge relaxed first.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from ..functions import phonology as p
from ..functions.glyphs import canonical
from ..functions.numerals import QUANTITY
from ..functions.phonology import Syllable
from .grouping import Word

LONGEST, READING_CHARGE, UNKNOWN_COST, BUCKETS, WORD_CHARGE = 16, 16, 32, 16, 4.62
Reading = tuple[Syllable, ...]


class Entry(NamedTuple):
    key: str
    reading: Reading
    taiwan: Reading | None = None
    pos: str = ""
    proper: bool = False
    boundaries: tuple[int, ...] = ()
    bucket: int = 0
    alternates: tuple[Reading, ...] = ()

    @property
    def cost(self) -> float:
        return (BUCKETS - 1 - self.bucket) + WORD_CHARGE


class Dictionary:
    """Entries by canonical key; picklable, so that it can be broadcast."""

    def __init__(self, entries: Iterable[Entry], idioms: Iterable[str] = ()):
        self.entries = {e.key: e for e in entries}
        self.idioms = frozenset(idioms)
        self.longest = min(LONGEST, max(map(len, self.entries), default=0))

    def get(self, word: str) -> Entry | None:
        return self.entries.get(canonical(word))

    def readings(self, character: str) -> list[Reading]:
        """The default, then the alternates, by likelihood."""
        entry = self.get(character)
        return [] if entry is None else [entry.reading, *entry.alternates]

    def has_prefix(self, text: str) -> bool:
        return any(k.startswith(canonical(text)) for k in self.entries)


class Edge(NamedTuple):
    start: int
    end: int
    text: str
    reading: Reading
    cost: float
    pos: str = ""
    proper: bool = False
    known: bool = True

    @property
    def reading_cost(self) -> float:
        return self.cost + READING_CHARGE

    def aligned(self) -> bool:
        return len(self.reading) == self.end - self.start


Lattice = list[list[Edge]]


def lattice(dictionary: Dictionary, run: str) -> Lattice:
    out: Lattice = []
    for at in range(len(run)):
        edges = []
        for size in range(2, min(dictionary.longest, len(run) - at) + 1):
            entry = dictionary.get(run[at : at + size])
            if entry is not None:
                edges.append(Edge(at, at + size, run[at : at + size], entry.reading, entry.cost, entry.pos, entry.proper))
        entry = dictionary.get(run[at])
        if entry is None:
            edges.append(Edge(at, at + 1, run[at], (), UNKNOWN_COST, known=False))
        else:
            edges += [Edge(at, at + 1, run[at], r, entry.cost + rank, entry.pos, entry.proper) for rank, r in enumerate(dictionary.readings(run[at]))]
        out.append(edges)
    return out


def cuts(edges: Lattice) -> list[int]:
    """Positions that no edge passes over."""
    n = len(edges)
    reach, out = 0, []
    for at in range(n + 1):
        if reach <= at:
            out.append(at)
        if at < n:
            reach = max([reach, *(e.end for e in edges[at])])
    return out


# ---- rules that forbid or force edges -------------------------------------------------
class _Context(NamedTuple):
    dictionary: Dictionary
    run: str

    def tag_before(self, at: int) -> str:
        word = self.word_before(at)
        return self.dictionary.get(word).pos if word else ""

    def word_before(self, at: int) -> str | None:
        return next((self.run[at - n : at] for n in range(min(4, at), 0, -1) if self.dictionary.get(self.run[at - n : at])), None)

    def tag_after(self, at: int) -> str:
        word = next((self.run[at : at + n] for n in range(4, 0, -1) if self.run[at : at + n] and self.dictionary.get(self.run[at : at + n])), None)
        return self.dictionary.get(word).pos if word else ""


def _is(reading: Reading, at: int, sound: tuple[str, str], tone: int) -> bool:
    return bool(reading) and reading[at].sound() == sound and reading[at].tone == tone


def modal_de(c: _Context, e: Edge) -> str | None:
    """得 read děi between a subject and what it governs."""
    if e.text == "得" and _is(e.reading, 0, ("d", "ei"), 3) and c.tag_before(e.start) in ("r", "d", "t") and c.tag_after(e.end)[:1] in ("v", "p", "d", "a") and c.tag_after(e.end):
        return "force"
    return None


def _teaching(c: _Context, at: int) -> bool:
    if c.tag_before(at).startswith("u"):
        return False
    return c.run[at + 1 : at + 2] in ("了", "过", "過", "着", "著", "得") or c.tag_after(at + 1) in ("r", "n", "nz", "nr", "nt", "ng")


def teaching_jiao(c: _Context, e: Edge) -> str | None:
    """教 read jiāo where something or someone is taught; untagged words that end in another 教 give way there."""
    jiao = _is(e.reading, -1, ("j", "iao"), 1)
    if e.text == "教":
        return "force" if _is(e.reading, 0, ("j", "iao"), 1) and _teaching(c, e.start) else None
    return "forbid" if not e.pos and e.text.endswith("教") and e.aligned() and not jiao and _teaching(c, e.end - 1) else None


def attested_erhua(c: _Context, e: Edge) -> str | None:
    """儿 is no syllable of its own where a word with the suffix ends in it."""
    if e.text != "儿" or not e.start:
        return None
    entry = c.dictionary.get(c.run[e.start - 1] + "儿")
    return "forbid" if entry and entry.reading and entry.reading[-1].erhua else None


def counted_measure(c: _Context, e: Edge) -> str | None:
    """After a quantity a measure word stands alone."""
    if e.end - e.start < 2 or not e.aligned():
        return None
    start = e.start
    while start and c.run[start - 1] in QUANTITY:
        start -= 1
    if start == e.start or c.run[start - 1 : start] == "第" and start:
        return None
    before = c.word_before(e.start)
    if before is not None and e.start - len(before) < start:
        return None
    first = c.dictionary.get(c.run[e.start])
    return "forbid" if first and first.pos == "q" and e.pos != "q" else None


RULES = (modal_de, teaching_jiao, attested_erhua, counted_measure)


def ruled(edges: Lattice, dictionary: Dictionary, run: str, rules=RULES) -> Lattice:
    """Without forbidden edges and rivals of forced ones; unchanged if no path would be left."""
    context = _Context(dictionary, run)
    kept: Lattice = []
    for own in edges:
        verdicts = [next((v for rule in rules if (v := rule(context, e))), None) for e in own]
        forced = {e.end for e, v in zip(own, verdicts, strict=True) if v == "force"}
        kept.append([e for e, v in zip(own, verdicts, strict=True) if v == "force" or v is None and e.end not in forced])
    open_ = [False] * len(edges) + [True]
    for at in range(len(edges) - 1, -1, -1):
        open_[at] = any(open_[e.end] for e in kept[at])
    return kept if open_[0] else edges


# ---- readings and word boundaries -----------------------------------------------------
class Unit(NamedTuple):
    """A character with its syllable, or a longer span whose reading isn't one each."""

    start: int
    end: int
    reading: Reading

    def key(self) -> tuple:
        return self.start, self.end, " ".join(p.write(s) for s in self.reading)


class Scored(NamedTuple):
    unit: Unit
    locked: bool
    alternatives: tuple[tuple[Unit, float], ...]  # with what each costs more than the best path


def units(e: Edge) -> list[Unit]:
    if not e.aligned():
        return [Unit(e.start, e.end, e.reading)]
    return [Unit(e.start + k, e.start + k + 1, (s,)) for k, s in enumerate(e.reading)]


def locks(edges: Lattice) -> list[Unit | None]:
    """For each position the unit that all edges over it agree on."""
    claims: list[dict] = [{} for _ in edges]
    for e in (e for own in edges for e in own):
        for u in units(e):
            for at in range(u.start, u.end):
                claims[at][u.key()] = u
    sole = [next(iter(c.items())) if len(c) == 1 else (None, None) for c in claims]
    return [u if u is not None and all(sole[k][0] == key for k in range(u.start, u.end)) else None for key, u in sole]


def path(edges: Lattice, start: int, end: int, charge: int) -> list[Edge]:
    """The cheapest edges from start to end; of equal costs the first reached."""
    best: list[tuple[float, Edge | None]] = [(float("inf"), None)] * (end - start + 1)
    best[0] = (0, None)
    for at in range(start, end):
        for e in edges[at]:
            if e.end <= end and (total := best[at - start][0] + (e.cost + charge if charge else e.cost)) < best[e.end - start][0]:
                best[e.end - start] = (total, e)
    out, at = [], end
    while at > start and (e := best[at - start][1]) is not None:
        out.append(e)
        at = e.start
    return out[::-1]


def _sweep(edges: Lattice, start: int, end: int) -> tuple[list[float], list[float]]:
    """Least costs from the start and to the end of a stretch, by position."""
    inf = float("inf")
    ahead, back = [0.0] + [inf] * (end - start), [inf] * (end - start) + [0.0]
    for at in range(start, end):
        for e in edges[at]:
            if e.end <= end:
                ahead[e.end - start] = min(ahead[e.end - start], ahead[at - start] + e.reading_cost)
    for at in range(end - 1, start - 1, -1):
        back[at - start] = min([e.reading_cost + back[e.end - start] for e in edges[at] if e.end <= end], default=inf)
    return ahead, back


def _claims(edges: Lattice, start: int, end: int) -> tuple[dict, float]:
    ahead, back = _sweep(edges, start, end)
    out: dict = {}
    for at in range(start, end):
        for e in edges[at]:
            if e.end <= end:
                through = ahead[at - start] + e.reading_cost + back[e.end - start]
                for u in units(e):
                    if u.key() not in out or through < out[u.key()][1]:
                        out[u.key()] = (u, through)
    return out, ahead[-1]


def read(edges: Lattice, with_scores: bool = False) -> list[Scored]:
    """The units of the run: locked stretches as they are, others along the cheapest path."""
    held, out = locks(edges), []
    at = cuts(edges)
    for start, end in zip(at, at[1:], strict=False):
        if all(held[k] is not None for k in range(start, end)):
            k = start
            while k < end:
                out.append(Scored(held[k], True, ()))
                k = held[k].end
            continue
        claims, best = _claims(edges, start, end) if with_scores else ({}, 0.0)
        for u in (u for e in path(edges, start, end, READING_CHARGE) for u in units(e)):
            others = sorted(((c, cost - best) for key, (c, cost) in claims.items() if key != u.key() and c.start < u.end and u.start < c.end), key=lambda x: x[1])
            out.append(Scored(u, held[u.start] is not None, tuple(others)))
    return out


def decode(dictionary: Dictionary, run: str, before: str = "", with_scores: bool = False, rules=RULES) -> list[tuple[Word, list[Scored]]]:
    """A run's words, each with its units; ``before`` is context whose words are left out."""
    edges, at = ruled(lattice(dictionary, before + run), dictionary, before + run, rules), len(before)
    if any(e.start < at < e.end and not e.aligned() for own in edges for e in own):
        edges, at, before = ruled(lattice(dictionary, run), dictionary, run, rules), 0, ""
    scored = [s for s in read(edges, with_scores) if s.unit.start >= at]
    starts = {e.start for e in path(edges, 0, len(edges), 0) if e.start >= at}
    groups: list[list[Scored]] = []
    for s in scored:
        if not groups or s.unit.start in starts:
            groups.append([])
        groups[-1].append(s)
    text, out = before + run, []
    for g in groups:
        own = text[g[0].unit.start : g[-1].unit.end]
        entry = dictionary.get(own)
        reading = tuple(s for x in g for s in x.unit.reading)
        out.append((Word(own, reading, entry.proper if entry else False, entry.pos if entry else "", entry is not None), g))
    return out


def greedy(dictionary: Dictionary, run: str) -> list[Word]:
    """The longest word from each position on."""
    out, at = [], 0
    while at < len(run):
        size = next((n for n in range(min(LONGEST, len(run) - at), 0, -1) if dictionary.get(run[at : at + n])), 0)
        entry = dictionary.get(run[at : at + size]) if size else None
        out.append(Word(run[at : at + size], entry.reading, entry.proper, entry.pos) if entry else Word(run[at], (), known=False))
        at += size or 1
    return out


def division(dictionary: Dictionary, word: str, reading: Reading) -> list[int] | None:
    """Sizes of the two words a longer word is made of: the evenest division, then the more frequent."""
    if len(word) < 3 or len(word) != len(reading):
        return None
    found = [((abs(at - len(word) / 2), max(a.cost, b.cost)), at) for at in range(1, len(word)) if (a := dictionary.get(word[:at])) and (b := dictionary.get(word[at:]))]
    return [min(found)[1], len(word) - min(found)[1]] if found else None
