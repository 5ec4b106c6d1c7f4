"""License scans: license texts and notices as templates with optional and replaceable regions, sought by a token automaton.

A template is wording with markup:

    <<beginOptional>> ... <<endOptional>>   may be left out; may be nested
    <<var;words=1..12>>                     any 1 to 12 words
    <<either;v2|version 2>>                 one of these wordings

All else is mandatory and must stand there word by word. Words are runs of ASCII letters (in lower case), digits and characters beyond ASCII; what
divides them is of no account. All templates are compiled into one nondeterministic automaton whose sets of states are made into a
deterministic one while texts are read (``STATES`` of them are remembered, then it starts anew), so a text costs one step a word. A passage is
accepted at the word where a template ends; its start is found by running the template backwards, and the shortest passage counts.

Phrases are plain wordings whose places are counted. Labels are those of the phrases found and those of the templates accepted. The score is 1 if a
template is accepted, 0.5 if only phrases are found (a mention is no grant) and else 0.

Each text is read once, in pieces of ``PIECE`` bytes, whatever its length; nothing is shuffled. Memory holds the piece, the last words
as far as the longest passage can reach, and the passages found.

Defined results: a null text is an empty one: no words, no labels, score 0, null places. Optional and replaceable regions at a template's ends say nothing and are
ignored; a template or phrase without mandatory words matches nothing. Overlapping places all count. Repeated rows give equal values.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches

PIECE = 1 << 20
STATES = 4000
#: Bytes of words stay, letters in lower case; all others divide words.
WORD_BYTES = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))
MARKUP = re.compile(r"<<(\w+)(?:;([^>]*))?>>|([^<]+|<)")
# an item of a template is a word, ("any", least, most) or ("one", [items, ...]); an optional region is one of its items and none
Items = list


def words_of(data: str) -> list[bytes]:
    return data.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def parse(template: str) -> Items:
    """The items of a template. Raises ValueError for markup that is not known or not closed."""
    open_: list[Items] = [[]]
    for m in MARKUP.finditer(template):
        kind, value, plain = m.groups()
        if plain:
            open_[-1] += words_of(plain)
        elif kind == "beginOptional":
            open_.append([])
        elif kind == "endOptional" and len(open_) > 1:
            done = open_.pop()
            open_[-1].append(("one", [done, []]))
        elif kind == "var" and (span := re.fullmatch(r"words=(\d+)\.\.(\d+)", value or "")) and int(span[1]) <= int(span[2]):
            open_[-1].append(("any", int(span[1]), int(span[2])))
        elif kind == "either" and value:
            open_[-1].append(("one", [words_of(x) for x in value.split("|")]))
        else:
            raise ValueError(f"bad markup {m[0]!r}")
    if len(open_) != 1:
        raise ValueError("an optional region is not closed")
    return open_[0]


def least_words(items: Items) -> int:
    return sum(1 if isinstance(x, bytes) else x[1] if x[0] == "any" else min(map(least_words, x[1])) for x in items)


def most_words(items: Items) -> int:
    return sum(1 if isinstance(x, bytes) else x[2] if x[0] == "any" else max(map(most_words, x[1])) for x in items)


def mandatory(items: Items) -> Items:
    """Without optional and replaceable regions at the ends; empty if nothing is mandatory."""
    says = lambda x: isinstance(x, bytes) or (x[0] == "one" and all(any(isinstance(w, bytes) for w in way) for way in x[1]))
    at = [k for k, x in enumerate(items) if says(x)]
    return items[at[0] : at[-1] + 1] if at else []


def backwards(items: Items) -> Items:
    return [x if isinstance(x, bytes) or x[0] == "any" else ("one", [backwards(way) for way in x[1]]) for x in reversed(items)]


class _State(dict):
    """A set of the automaton's states; maps a word's number to the next one."""

    __slots__ = ("accepts", "automaton", "members")

    def __missing__(self, word: int) -> _State:
        self[word] = out = self.automaton.after(self.members, word)
        return out


class Automaton:
    """All ``templates`` (their items) at once. With ``anew``, a passage may begin at every word."""

    def __init__(self, templates: list[Items], anew: bool = True):
        self.numbers: dict[bytes, int] = {}  # words that templates have; 0 is any other
        self.by_word: list[dict[int, int]] = []
        self.by_any: list[int | None] = []
        self.free: list[list[int]] = []
        self.ends: dict[int, int] = {}
        self.first = []
        for k, items in enumerate(templates):
            if items:
                start = self._new()
                self.first.append(start)
                self.ends[self._chain(start, items)] = k
        self.anew, self.states, self.start = anew, {}, None
        self.start = self._state(self._closed(self.first))

    def _new(self) -> int:
        self.by_word.append({})
        self.by_any.append(None)
        self.free.append([])
        return len(self.free) - 1

    def _chain(self, at: int, items: Items) -> int:
        for x in items:
            to = self._new()
            if isinstance(x, bytes):
                self.by_word[at][self.numbers.setdefault(x, len(self.numbers) + 1)] = to
            elif x[0] == "any":
                for k in range(x[2]):
                    if k >= x[1]:
                        self.free[at].append(to)
                    self.by_any[at] = at = self._new()
                self.free[at].append(to)
            else:
                for way in x[1]:
                    begin = self._new()
                    self.free[at].append(begin)
                    self.free[self._chain(begin, way)].append(to)
            at = to
        return at

    def _closed(self, states: list[int]) -> frozenset[int]:
        out, left = set(states), list(states)
        while left:
            for s in self.free[left.pop()]:
                if s not in out:
                    out.add(s)
                    left.append(s)
        return frozenset(out)

    def _state(self, members: frozenset[int]) -> _State:
        found = self.states.get(members)
        if found is None:
            if len(self.states) >= STATES:
                self.states.clear()
                if self.start is not None:
                    self.start = self._state(self.start.members)
            found = self.states[members] = _State()
            found.members, found.automaton, found.accepts = members, self, sorted({self.ends[s] for s in members if s in self.ends})
        return found

    def after(self, members: frozenset[int], word: int) -> _State:
        reached = [self.by_word[s][word] for s in members if word in self.by_word[s]] + [self.by_any[s] for s in members if self.by_any[s] is not None]
        return self._state(self._closed(reached + self.first * self.anew))


class Scanner:
    """``templates`` has (label, template), ``phrases`` (label, wording)."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]):
        items = [mandatory(parse(text)) for _, text in templates]
        base = [words_of(text) for _, text in phrases]
        self.labels, self.n_templates = [label for label, _ in [*templates, *phrases]], len(templates)
        self.lengths = [len(b) for b in base]
        self.all = Automaton(items + base)
        self.back = [Automaton([backwards(x)], anew=False) for x in items]
        self.reach = max(map(most_words, items), default=0)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int]]]:
        """The number of words; (phrase, start) of all places; (template, start, words) of all passages. Words count from 0."""
        data = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)
        places, passages, state, n, at = [], [], self.all.start, 0, 0
        number, tail = self.all.numbers.get, deque(maxlen=self.reach)
        while at < len(data):
            end = data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
            words = data[at:end].split()
            for k, word in enumerate(words):
                state = state[number(word, 0)]
                if state.accepts:
                    for t in state.accepts:
                        if t >= self.n_templates:
                            places.append((t - self.n_templates, n + k + 1 - self.lengths[t - self.n_templates]))
                        else:
                            length = self._length(t, words, k, tail)
                            passages.append((t, n + k + 1 - length, length))
            n += len(words)
            tail.extend(words[-self.reach :] if self.reach else ())
            at = end
        return n, places, passages

    def _length(self, t: int, words: list[bytes], k: int, tail: deque) -> int:
        """Words of the shortest passage of template ``t`` that ends with word ``k``; ``tail`` has the words before ``words``."""
        state, number = self.back[t].start, self.back[t].numbers.get
        for length in range(1, self.reach + 1):
            at = k + 1 - length
            state = state[number(words[at] if at >= 0 else tail[at], 0)]
            if state.accepts:
                return length
        raise AssertionError("an accepted passage has a start")

    def labels_of(self, places: list, passages: list) -> tuple[str, str, float]:
        """Labels of the phrases, all labels, and the score."""
        base = {self.labels[self.n_templates + p] for p, _ in places}
        own = {self.labels[t] for t, _, _ in passages}
        return ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else 0.5 if base else 0.0


_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, passages array<struct<label: string, start: long, length: long>>"


def find_licenses(docs: DataFrame, id_col: str, text_col: str, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]) -> DataFrame:
    """``id_col``, n_words, n_base, first_word and last_word (of all phrases' places), base_labels, labels, score, and the passages of the templates."""
    small_batches(docs.sparkSession)
    Scanner(templates, phrases)  # bad markup is reported here
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.llm.workers import kept

        scanner = kept("licenses", "scanner", lambda: Scanner(templates, phrases), repr((templates, phrases)))
        for b in batches:
            found = [scanner.scan(t.as_py()) for t in b.column(1)]
            starts = [[s for _, s in places] for _, places, _ in found]
            said = [scanner.labels_of(places, passages) for _, places, passages in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([len(s) for s in starts], pa.int64()),
                    pa.array([min(s, default=None) for s in starts], pa.int64()),
                    pa.array([max(s, default=None) for s in starts], pa.int64()),
                    *(pa.array([x[k] for x in said], pa.string()) for k in (0, 1)),
                    pa.array([x[2] for x in said], pa.float64()),
                    pa.array([[{"label": scanner.labels[t], "start": s, "length": n} for t, s, n in passages] for _, _, passages in found], kind),
                ],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "passages"],
            )

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {_OUT}")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
