"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss."""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACES, ship, text_chunks

KINDS = ["email", "ip", "card", "phone"]
RULE, MODEL = "rule", "model"

# Fixed patterns -------------------------------------------------------------------------------------------------------

# A run of digits is taken whole or not at all, so texts of digits alone stay linear.
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NO_DIGIT = bytes(c for c in range(256) if not 48 <= c < 58)
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def digits_of(text: bytes) -> bytes:
    return text.translate(None, _NO_DIGIT)


def luhn(digits: bytes) -> bool:
    places = [c - 48 for c in reversed(digits)]
    return (sum(places[::2]) + sum(_DOUBLED[c] for c in places[1::2])) % 10 == 0


def is_card(text: bytes) -> bool:
    digits = digits_of(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_quad(parts: list[bytes]) -> bool:
    return len(parts) == 4 and all(p.isdigit() and len(s := p.lstrip(b"0")) <= 3 and int(s or b"0") <= 255 for p in parts)


def _emails(text: bytes) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def rule_spans(text: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in bytes of what the patterns find: per kind leftmost, without overlaps or retries."""
    found = [(a, 0, b) for a, b in _emails(text)] if b"@" in text else []
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if is_quad(m[0].split(b"."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if is_card(m[0])]
    if b"+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


# Units and their features ---------------------------------------------------------------------------------------------

# Characters that part units as white space does; all others belong to a unit.
SEPARATORS = ",;:|\"'=<>/\\!?*&#${}~^`"
_TO_SPACE = bytes.maketrans((SPACES + SEPARATORS).encode(), b" " * len(SPACES + SEPARATORS))

# Words whose own identity counts; all others are known by their shape alone.
CUES = """
at dot (at) (dot) [at] [dot] com net org phone tel tel. telephone call mobile fax card visa mastercard amex credit mail
e-mail email contact ip host server address order number no no. id isbn version invoice year page item
""".split()
_LETTERS, _RUNS, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+"), re.compile(r"[0-9]")
_MAILISH = re.compile(r"[^\s@]+@[\w-]+(?:\.[\w-]+)+", re.ASCII)
_EDGES = "().[]-_+%"


def features(word: bytes) -> list[str]:
    """What the model sees of a unit: its shape with and without lengths, checks of its digits, and cue words."""
    text = word.decode("utf-8", "replace")
    low = text.lower()
    out = [f"word {low}"] if low in CUES else []
    shape = _LETTERS.sub("a", text)
    if not any(c in "0123456789@" for c in text):
        return [*out, f"shape {shape[:8]}"]
    digits = digits_of(word)
    out += [f"form {_DIGIT.sub('9', shape)[:32]}", f"shape {_RUNS.sub('9', shape)[:24]}", f"digits {min(len(digits), 20)}"]
    if "@" in text:
        out.append("mail" if _MAILISH.fullmatch(text.strip(_EDGES)) else "half a mail")
        return out
    bare = word.strip(_EDGES.encode())
    if is_quad(bare.replace(b"[.]", b".").split(b".")):
        out.append("quad")
    if 12 <= len(digits) <= 19 and not bare.translate(None, b"0123456789-"):
        out.append("luhn" if luhn(digits) else "no luhn")
    if text[0] in "+(":
        out.append(f"begins {text[0]}")
    return out


class Rows(dict):
    """Number of the feature row of each unit met, worked out when it is first asked for; forgets all when full."""

    MOST = 400_000

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known
        self.row_of: dict[tuple[int, ...], int] = {(): 0}
        self.sets: list[tuple[int, ...]] = [()]  # row 0 is also what lies beyond a text's ends

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        key = tuple(self.known[f] for f in features(word) if f in self.known)
        row = self.row_of.get(key)
        if row is None:
            row = self.row_of[key] = len(self.sets)
            self.sets.append(key)
        self[word] = row
        return row


@dataclass
class Units:
    """The units of several texts in a row: byte places, text number, feature row, and whether more than a space is before."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    row: np.ndarray
    gap: np.ndarray


def cut(buffer: bytes, text_starts: np.ndarray, rows: Rows) -> Units:
    """Units of the texts that begin at ``text_starts`` of ``buffer``, each closed by a white space."""
    spaced = buffer.translate(_TO_SPACE)
    words = spaced.split()
    inside = np.concatenate([[False], np.frombuffer(spaced, np.uint8) != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    row = np.fromiter(map(rows.__getitem__, words), np.int32, len(words))
    text = np.searchsorted(text_starts, start, side="right") - 1
    gap = np.ones(start.size, np.int64)
    raw = np.frombuffer(buffer, np.uint8)
    gap[1:] = (start[1:] - end[:-1] != 1) | (raw[end[:-1]] != 32) | (text[1:] != text[:-1])
    return Units(start, end, text, row, gap)


# The model ------------------------------------------------------------------------------------------------------------

# State 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
STATES = 1 + 2 * len(KINDS)


@dataclass
class Field:
    """Weights of a linear-chain conditional random field, and the number of every feature."""

    known: dict[str, int]
    own: np.ndarray  # feature x state
    before: np.ndarray  # the same for the unit before
    after: np.ndarray
    gap: np.ndarray  # 2 x state
    step: np.ndarray  # state x state
    first: np.ndarray
    last: np.ndarray

    def may_be_inside(self, units: Units, scores: np.ndarray) -> np.ndarray:
        """False for units that are outside on every best path over whole texts.

        Let a best path hold a longest run of inside states. With outside states in its place the path would lose what the
        run gains by its entry, its steps and its exit, and win the units' margins. So the margins less a step's most
        gain, summed over the run, are at most the rest; a unit that no such stretch covers is outside.
        """
        step = self.step[1:, 1:].max() - self.step[0, 0]
        enter = max(self.step[0, 1:].max() - self.step[0, 0], self.first[1:].max() - self.first[0])
        leave = max(self.step[1:, 0].max() - self.step[0, 0], self.last[1:].max() - self.last[0])
        cost = scores[:, 0] - scores[:, 1:].max(axis=1) - step
        # Sums from the first unit on; a wall between texts keeps stretches from crossing it.
        wall = 1e6 * units.text
        after, before = np.cumsum(cost) + wall, np.cumsum(cost) - cost + wall
        least = np.minimum.accumulate(after[::-1])[::-1] - np.maximum.accumulate(before)
        return least <= enter + leave - step + 1e-5

    def scores(self, units: Units, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        own, before, after = tables
        same = units.text[1:] == units.text[:-1]
        out = own[units.row] + self.gap[units.gap]
        out[1:] += before[np.where(same, units.row[:-1], 0)]
        out[:-1] += after[np.where(same, units.row[1:], 0)]
        return out

    def tables(self, sets: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed weights of every feature row, for the unit itself and as a neighbour."""
        picked = np.zeros((len(sets), len(self.known)))
        for i, s in enumerate(sets):
            picked[i, list(s)] = 1
        return picked @ self.own, picked @ self.before, picked @ self.after


def viterbi(scores: np.ndarray, step: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best states of equally long chains: ``scores`` is chain x unit x state, ``first`` and ``last`` chain x state."""
    chains, length, states = scores.shape
    best = scores[:, 0] + first
    back = np.empty((length, chains, states), np.int8)
    for t in range(1, length):
        reached = best[:, :, None] + step
        back[t] = reached.argmax(axis=1)
        best = reached.max(axis=1) + scores[:, t]
    out = np.empty((chains, length), np.int8)
    out[:, -1] = (best + last).argmax(axis=1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(chains), out[:, t]]
    return out


def decode(field: Field, units: Units, scores: np.ndarray) -> np.ndarray:
    """Best state of every unit, exactly as Viterbi over whole texts gives it.

    The chain parts at units that are outside on every best path. Only the stretches between them are searched, those
    of one length as one numpy batch.
    """
    states = np.zeros(units.start.size, np.int8)
    if not states.size:
        return states
    at = np.flatnonzero(field.may_be_inside(units, scores))
    if not at.size:
        return states
    begins = np.ones(at.size, bool)
    begins[1:] = (at[1:] != at[:-1] + 1) | (units.text[at[1:]] != units.text[at[:-1]])
    heads = np.flatnonzero(begins)
    sizes = np.diff(np.append(heads, at.size))
    heads = at[heads]
    text = units.text
    n = text.size
    for size in np.unique(sizes):
        for some in np.array_split(heads[sizes == size], max(1, int((sizes == size).sum() * size // 50_000))):
            if not some.size:
                continue
            tail = some + size - 1
            at_first = (some == 0) | (text[some - 1] != text[some])
            at_last = (tail == n - 1) | (text[np.minimum(tail + 1, n - 1)] != text[tail])
            first = np.where(at_first[:, None], field.first, field.step[0])
            last = np.where(at_last[:, None], field.last, field.step[:, 0])
            places = some[:, None] + np.arange(size)
            states[places] = viterbi(scores[places], field.step, first, last)
    return states


# An address with a sign, or with "at" in its place: then "dot" must be spelt out too unless "at" stands in brackets.
_ADDRESS = re.compile(
    rb"[^@]+@[^@]*\.[^@]+|\S+ ?[(\[]at[)\]] ?\S+(?: ?[(\[]dot[)\]] ?| dot |\.)\S+|\S+ at \S+(?: ?[(\[]dot[)\]] ?| dot )\S+", re.I
)


def _checked(text: bytes, start: int, end: int, kind: int) -> tuple[int, int] | None:
    """The span without punctuation at its edges, or None if it cannot be what the model takes it for."""
    span = text[start:end]
    lead = re.match(rb"(?:(?![+(]?[0-9])[^A-Za-z0-9\x80-\xff])*" if kind == 3 else rb"[^A-Za-z0-9\x80-\xff]*", span).end()
    start += lead
    end -= len(span) - lead - len(re.sub(rb"[^A-Za-z0-9\x80-\xff]+\Z", b"", span[lead:]))
    span = text[start:end]
    digits = digits_of(span)
    fits = (
        _ADDRESS.fullmatch(span) is not None,
        is_quad([p for p in re.split(rb"[^0-9]+", span) if p]) and not re.search(rb"[A-Za-z]{4}", span),
        is_card(span) and not re.search(rb"[^0-9 -]", span),
        7 <= len(digits) <= 15 and not re.search(rb"[A-Za-z\x80-\xff]", span),
    )
    return (start, end) if fits[kind] else None


def model_spans(field: Field, buffer: bytes, units: Units, states: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in bytes of the decoded spans that hold what their kind needs."""
    found = []
    inside = np.flatnonzero(states)
    runs: list[list[int]] = []
    for i in inside.tolist():
        s = int(states[i])
        kind, goes_on = (s - 1) // 2, s % 2 == 0
        if goes_on and runs and runs[-1][1] == i - 1 and runs[-1][2] == kind and units.text[i] == units.text[i - 1]:
            runs[-1][1] = i
        else:
            runs.append([i, i, kind])
    for a, b, kind in runs:
        span = _checked(buffer, int(units.start[a]), int(units.end[b]), kind)
        if span:
            found.append((span[0], kind, span[1]))
    return found


def joined(rules: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """All rule spans, and those of the model that touch none of them or hold one of their own kind as a part."""
    out = [(a, k, b, RULE) for a, k, b in rules]
    for a, k, b in more:
        touched = [r for r in rules if r[0] < b and a < r[2]]
        if all(r[1] == k and a <= r[0] and r[2] <= b and (a, b) != (r[0], r[2]) for r in touched):
            out.append((a, k, b, MODEL))
    return sorted(out)


# Training -------------------------------------------------------------------------------------------------------------

# Lines of the labelled table. Words in angle brackets are drawn anew for every copy; those of PERSONAL are labelled.
LINES = """
<w> <w> <w> <w> <w> <w>
<w> <w> <w>. <w> <w>, <w> at <w> <w>
<w> <w> at <w> <w> <w>. <w> <w>
<w> the dot <w> <w> <w> at a <w>
<w> <w> <mail> <w> <w>
<w> <w>. <mail>
<mail>
<oddmail>
<hidden>
<quad>
<hiddenquad>
<card>
<badcard>
<area>
<dashed>
<n>
<long>
email <mail>, <w> <w>
mail: <mail> <w>
<w> <oddmail> <w> <w>
contact <oddmail>
<w> <hidden> <w> <w>
write to <hidden>. <w> <w>
email <hidden>
<w> <w> <quad> <w> <w>
<w> <quad>
ip <quad>, <w> <w>
host <quad> <w>
<w> <w> <hiddenquad> <w>
server <hiddenquad>
<w> <w> <card> <w> <w>
<w> <card>
<card> <card>
<w> <card> <card> <w>
<w> <card> <badcard> <w>
<w> <badcard> <card> <w>
<w> <badcard> <badcard> <w>
<w> <badcard> <w> <w>
<w> <w> <badcard>
<w>. <badcard> <w> <w>
card <card> <w>
card number <badcard> <w>
<w> <card4> <w> <w>
visa <card4>
<w> <phone> <w> <w>
<w> <w>. <phone>
<phone>
<phone> <quad>
<phone> <card>
<phone> <badcard> <w>
<w> <phone> <quad> <w>
<w> <quad> <card> <w>
<w> <quad> <phone> <w>
<w> <card> <phone> <w>
<w> <mail> <phone> <w>
<w> <phone> <n> <w>
<w> <phone> <phone> <w>
<w> <phone>. <w> <w>
phone <local> <w>
call <local>, <w>
tel <local> <w> <w>
<w> <area> <w> <w>
<w> <w> <area>
call <area> <w>
phone: <area>
fax <dashed> <w>
<w> <dashed> <w> <w>
call <dashed>
<w> <abroad> <w> <w>
tel. <abroad>
mobile <abroad> <w>
<w> in <year> <w> <w>
<year> <w> <year> <w>
<w> <n> <w> <n>
<w> <n> <n> <n> <w>
page <n> of <n>
<w> <price> <w> <w>
<w> <date> <w>
<w> <date> <time> <w>
<w> <time> <w> <w>
version <version> <w>
<w> <version> <w> <w>
<w> <long> <w> <w>
order <long> <w>
id <long>
invoice no <long> <w>
item <part> <w>
order <part>, <w>
<w> <part> <w>
token = "<hex>" <w>
<w> <hex> <w>
<w> <mixed> <w> <w>
isbn <isbn> <w>
<w> <range> <w>
<w> (<n>) <w> <w>
<w> | <w> | <n> | <w>
<w>@<w> <w> <w>
<w> <w> @ <w>
<w> <percent> <w>
<w> +<n> <w> <w>
<w> <badquad> <w> <w>
<w> <w> dot com <w>
""".strip().splitlines()
PERSONAL = {
    "mail": 0, "oddmail": 0, "hidden": 0, "quad": 1, "hiddenquad": 1, "card": 2, "card4": 2, "phone": 3, "local": 3, "area": 3,
    "dashed": 3, "abroad": 3,
}
COPIES = 24
SYLLABLES = "an be ch der en fo gu hé in jo ka le mi ño ou pa que re st ti un vo wh xe yl zu ää ç ra so".split()
LABELLED = "text string, spans array<struct<kind string, start long, end long>>"


def _number(rng: random.Random, size: int) -> str:
    return "".join(rng.choices("0123456789", k=size))


def _card(rng: random.Random, valid: bool) -> str:
    while True:
        number = _number(rng, 16)
        if luhn(number.encode()) == valid:
            return number


def _word(rng: random.Random) -> str:
    word = "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
    return word.capitalize() if rng.random() < 0.15 else word


def _draw(name: str, rng: random.Random) -> str:
    """One value of a name in angle brackets."""
    n = lambda size: _number(rng, size)
    plain = lambda: re.sub(r"[^a-z]", "e", _word(rng).lower())
    quad = [str(rng.randint(0, 255)) for _ in range(4)]
    domain = f"{plain()}{rng.choice(['', n(1)])}.{rng.choice(['example.', ''])}{rng.choice(['com', 'org', 'net', 'de'])}"
    at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] ")])
    values = {
        "w": lambda: _word(rng) + rng.choice([""] * 8 + [".", "."]),
        "mail": lambda: f"{plain()}{rng.choice(['', '.', '_', '-'])}{rng.choice([n(2), plain()])}@{domain}",
        "oddmail": lambda: f"{rng.choice(['ñ', 'ü', 'é'])}{plain()}.{n(2)}@{domain}",
        "hidden": lambda: f"{plain()}{rng.choice(['.' + n(2), ''])}{at}{plain()}{dot}{rng.choice(['com', 'org', 'net'])}",
        "quad": lambda: ".".join(quad),
        "hiddenquad": lambda: "[.]".join(quad),
        "badquad": lambda: ".".join([str(rng.randint(256, 999)), *quad[1:]]),
        "card": lambda: _card(rng, True),
        "badcard": lambda: _card(rng, False),
        "card4": lambda: rng.choice(" -").join(re.findall("....", _card(rng, True))),
        "phone": lambda: f"+{rng.randint(1, 9)} ({n(3)}) {n(3)}-{n(4)}",
        "area": lambda: f"({n(3)}) {n(3)}-{n(4)}",
        "local": lambda: rng.choice([f"{n(3)}-{n(4)}", f"{n(3)} {n(4)}", f"0{n(3)} {n(7)}", n(10), f"{n(3)}.{n(3)}.{n(4)}"]),
        "dashed": lambda: f"{n(3)}-{n(3)}-{n(4)}",
        "abroad": lambda: f"+{rng.randint(10, 99)} {n(rng.randint(2, 4))} {n(rng.randint(6, 8))}",
        "year": lambda: str(rng.randint(1800, 2060)),
        "n": lambda: n(rng.randint(1, 5)),
        "price": lambda: rng.choice("$€") + f"{n(3)}.{n(2)}",
        "date": lambda: rng.choice([f"{rng.randint(1990, 2030)}-{n(2)}-{n(2)}", f"{n(2)}.{n(2)}.{n(4)}", f"{n(2)}/{n(2)}/{n(4)}"]),
        "time": lambda: f"{n(2)}:{n(2)}" + rng.choice(["", f":{n(2)}"]),
        "version": lambda: rng.choice([f"{n(1)}.{n(1)}.{n(2)}", f"{n(1)}.{n(2)}", f"v{n(1)}.{n(1)}"]),
        "long": lambda: n(rng.randint(6, 14)),
        "part": lambda: rng.choice([f"{n(3)}-{n(2)}", f"{n(3)}-{n(4)}-{n(2)}", f"{n(2)}-{n(6)}", f"{n(4)}-{n(4)}"]),
        "hex": lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([8, 32, 40]))),
        "mixed": lambda: plain() + n(3),
        "isbn": lambda: f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}",
        "range": lambda: f"{n(3)}-{n(3)}",
        "percent": lambda: f"{n(2)}.{n(1)}%",
    }
    return values[name]()


def labelled_examples(spark: SparkSession, copies: int = COPIES, seed: int = 17) -> DataFrame:
    """The small labelled table: ``text`` and its ``spans``, ``copies`` rows drawn for every line of ``LINES``."""
    rng, rows = random.Random(seed), []
    for line in LINES:
        for _ in range(copies):
            text, spans = "", []
            for i, part in enumerate(re.split(r"<(\w+)>", line)):
                value = _draw(part, rng) if i % 2 else part
                if i % 2 and part in PERSONAL:
                    spans.append((KINDS[PERSONAL[part]], len(text), len(text) + len(value)))
                text += value
            rows.append((text, spans))
    return spark.createDataFrame(rows, LABELLED)


def _gold(units: Units, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    states = np.zeros(units.start.size, np.int64)
    for i, (start, end, text) in enumerate(zip(units.start.tolist(), units.end.tolist(), units.text.tolist(), strict=True)):
        for a, kind, b in spans[text]:
            if start < b and a < end:
                goes_on = i and units.text[i - 1] == text and units.end[i - 1] > a
                states[i] = 1 + 2 * kind + bool(goes_on)
    return states


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def likelihood(field: Field, units: Units, gold: np.ndarray, scores: np.ndarray):
    """Log-likelihood of the gold states, and its slopes by unit scores, steps, first and last states.

    Forward and backward sums over all texts of one length at a time.
    """
    by_unit = np.zeros_like(scores)
    step, first, last = np.zeros_like(field.step), np.zeros_like(field.first), np.zeros_like(field.last)
    heads = np.flatnonzero(np.append(True, units.text[1:] != units.text[:-1]))
    sizes, total = np.diff(np.append(heads, units.text.size)), 0.0
    for size in np.unique(sizes):
        places = heads[sizes == size][:, None] + np.arange(size)
        s, y = scores[places], gold[places]
        chains = np.arange(places.shape[0])
        ahead = np.empty_like(s)
        ahead[:, 0] = s[:, 0] + field.first
        for t in range(1, size):
            ahead[:, t] = _logsum(ahead[:, t - 1, :, None] + field.step, 1) + s[:, t]
        whole = _logsum(ahead[:, -1] + field.last, 1)
        rest = np.empty_like(s)
        rest[:, -1] = field.last
        for t in range(size - 2, -1, -1):
            rest[:, t] = _logsum(field.step + (s[:, t + 1] + rest[:, t + 1])[:, None, :], 2)
        chance = np.exp(ahead + rest - whole[:, None, None])
        by_unit[places] = -chance
        first -= chance[:, 0].sum(axis=0)
        last -= chance[:, -1].sum(axis=0)
        for t in range(1, size):
            pair = ahead[:, t - 1, :, None] + field.step + (s[:, t] + rest[:, t])[:, None, :] - whole[:, None, None]
            step -= np.exp(pair).sum(axis=0)
            np.add.at(step, (y[:, t - 1], y[:, t]), 1)
        np.add.at(first, y[:, 0], 1)
        np.add.at(last, y[:, -1], 1)
        path = np.take_along_axis(s, y[:, :, None], 2).sum(axis=(1, 2)) + field.first[y[:, 0]] + field.last[y[:, -1]]
        total += float((path + field.step[y[:, :-1], y[:, 1:]].sum(axis=1) - whole)[chains].sum())
    by_unit[np.arange(gold.size), gold] += 1
    return total, by_unit, step, first, last


# Labelled rows that training takes, those with the least digests; the bundled table is far below.
MOST_LABELLED = 20_000


def train(labelled: DataFrame, rounds: int = 120, rate: float = 0.25, decay: float = 0.02) -> Field:
    """Weights that make the labelled spans likely: gradient steps on the whole labelled table, with a squared penalty.

    ``labelled`` has ``text`` and ``spans`` in code points; of a table with more than ``MOST_LABELLED`` rows those with
    the least digests count. Null texts and rows without a unit teach nothing; without any row the model finds nothing.
    """
    order = F.xxhash64("text")
    taken = labelled.where("text IS NOT NULL").orderBy(order, "text").limit(MOST_LABELLED).select("text", "spans").collect()
    raws = [r.text.encode() for r in taken]
    starts = np.cumsum([0, *[len(r) + 1 for r in raws]])
    spans = []
    for r, at in zip(taken, starts, strict=False):
        place = lambda c, t=r.text, at=at: int(at) + len(t[:c].encode())
        spans.append([(place(s.start), KINDS.index(s.kind), place(s.end)) for s in r.spans or [] if s.kind in KINDS])
    buffer = b"".join(r + b"\n" for r in raws)
    words = buffer.translate(_TO_SPACE).split()
    known = {f: i for i, f in enumerate(sorted({f for w in set(words) for f in features(w)}))}
    rows = Rows(known)
    units = cut(buffer, starts[:-1], rows)
    zeros = lambda *shape: np.zeros(shape)
    field = Field(known, zeros(len(known), STATES), zeros(len(known), STATES), zeros(len(known), STATES), zeros(2, STATES),
                  zeros(STATES, STATES), zeros(STATES), zeros(STATES))
    if not units.start.size:
        field.gap[:, 0] = 1.0
        return field
    gold = _gold(units, spans)
    picked = np.zeros((len(rows.sets), len(known)))
    for i, s in enumerate(rows.sets):
        picked[i, list(s)] = 1
    same = units.text[1:] == units.text[:-1]
    before = np.append(0, np.where(same, units.row[:-1], 0))
    after = np.append(np.where(same, units.row[1:], 0), 0)
    names = ["own", "before", "after", "gap", "step", "first", "last"]
    moving = {k: (zeros(*getattr(field, k).shape), zeros(*getattr(field, k).shape)) for k in names}

    def by_row(which: np.ndarray, slopes: np.ndarray, count: int) -> np.ndarray:
        return np.array([np.bincount(which, weights=slopes[:, s], minlength=count) for s in range(STATES)]).T

    for i in range(1, rounds + 1):
        scores = field.scores(units, field.tables(rows.sets))
        _, by_unit, *chain = likelihood(field, units, gold, scores)
        size = len(rows.sets)
        slopes = [picked.T @ by_row(w, by_unit, size) for w in (units.row, before, after)]
        slopes += [by_row(units.gap, by_unit, 2), *chain]
        for name, slope in zip(names, slopes, strict=True):
            w, (m, v) = getattr(field, name), moving[name]
            slope = slope - decay * w * len(raws) / 100
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            w += rate * (1 - i / (rounds + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return field


# The operator ---------------------------------------------------------------------------------------------------------


class Finder:
    """Spans of many texts at once: patterns and decoding over one buffer that holds them all."""

    def __init__(self, field: Field):
        self.field = field
        self.rows = Rows(field.known)
        self.tables = field.tables(self.rows.sets)

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int, str]]]:
        """Per text ``(start, kind, end, found by)`` in code points, by start, then kind as in ``KINDS``."""
        # No pattern and no unit holds a line end, so none crosses from text to text.
        buffer = b"\n".join([*texts, b""])
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        units = cut(buffer, starts, self.rows)
        if len(self.rows.sets) != self.tables[0].shape[0]:
            self.tables = self.field.tables(self.rows.sets)
        states = decode(self.field, units, self.field.scores(units, self.tables))
        rules: dict[int, list] = {}
        more: dict[int, list] = {}
        places = starts.tolist()
        for found, into in ((rule_spans(buffer), rules), (model_spans(self.field, buffer, units, states), more)):
            for a, kind, b in found:
                i = bisect_right(places, a) - 1
                into.setdefault(i, []).append((a - places[i], kind, b - places[i]))
        out: list[list[tuple[int, int, int, str]]] = [[] for _ in texts]
        for i in rules.keys() | more.keys():
            spans = joined(rules.get(i, []), more.get(i, []))
            out[i] = spans if texts[i].isascii() else _in_code_points(texts[i], spans)
        return out


def _in_code_points(text: bytes, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    at, count, place = 0, 0, {}
    for e in sorted({e for a, _, b, _ in spans for e in (a, b)}):
        count += len(text[at:e].decode("utf-8", "replace"))
        at, place[e] = e, count
    return [(place[a], k, place[b], by) for a, k, b, by in spans]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found_by", pa.string())]))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, text, spans array<struct<kind, start, end, found_by>>`` for every row of ``docs``.

    Starts and ends count code points, the end exclusive; spans stand by start, then by kind as in ``KINDS``. What the
    patterns find is always there (``rule``); the model adds spans that touch none of these, or that hold one of the
    same kind and more (``model``). A null text is empty and has no spans; its ``text`` comes out empty. Texts of any
    length are decoded whole: a task holds one text, or several of a megabyte together. Repeated rows come out as often
    as they went in, whatever their ids; equal scores take the first state. Other columns are not read. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value)
        for batch in batches:
            for part in text_chunks(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                found = [
                    [{"kind": KINDS[k], "start": a, "end": b, "found_by": by} for a, k, b, by in spans] for spans in finder.spans(texts)
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, SPANS)], ["doc_id", "text", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = "array<struct<kind string, start bigint, end bigint, found_by string>>"
    return rows.mapInArrow(run, f"doc_id long, text string, spans {kinds}")


def masked(found: DataFrame) -> DataFrame:
    """``doc_id, text``: the rows of ``find`` with every span replaced by its kind in angle brackets.

    Of spans that overlap, the part not yet replaced is.
    """
    start = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda done, s: F.struct(
            F.when(
                s["start"] >= done["at"],
                F.concat(
                    done["text"], F.substring(F.col("text"), done["at"].cast("int") + 1, (s["start"] - done["at"]).cast("int")),
                    F.lit("<"), s["kind"], F.lit(">"),
                ),
            ).otherwise(done["text"]).alias("text"),
            F.greatest(done["at"], s["end"]).alias("at"),
        ),
        lambda done: F.concat(done["text"], F.substring(F.col("text"), done["at"].cast("int") + 1, F.length(F.col("text")))),
    )
    return found.select("doc_id", start.alias("text"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of what the patterns find, and all spans, for every row; see ``find``."""
    found = find(docs, train(labelled_examples(docs.sparkSession)))
    base = F.filter("spans", lambda s: s["found_by"] == RULE)
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
