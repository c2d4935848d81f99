"""Personal data: base patterns, and a semi-Markov conditional random field that adds whole spans.

The field scores candidate segments of a run of tokens as wholes (shape, digit groups, Luhn, separators, dates, what stands
around, cue words before), for four kinds and "other"; dynamic programming over segments of at most MAX_TOKENS tokens
picks boundaries and kinds together. A run is a stretch of pieces with a digit or "@", with the words beside a lone "@";
tokens outside of runs are "other". Weights are fitted by exact gradients (forward-backward over segments) on
TRAIN_SENTENCES generated sentences: a fixed, documented bound, equal for every corpus.

Base spans always stay; the field sees only what is left between them, so none of its spans touches one.

Defined results: a null text is empty and has no spans. Repeated rows give equal results. Texts of any length are
searched whole, in time that grows with their length: a segment has at most MAX_CHARS characters, and each token
begins at most MAX_TOKENS of them.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tesserae.llm.common import ROWS, map_texts

KINDS = ("email", "ip", "card", "phone")
#: Tokens and characters of a segment at most, and segments whose scores are remembered.
MAX_TOKENS, MAX_CHARS, REMEMBERED = 16, 254, 1 << 16
TRAIN_SENTENCES, EPOCHS, SEED = 600, 4, 7

# --- base patterns -------------------------------------------------------------------------------------------------
# The possessive repeats and the look-behind give the matches of the plain patterns without their backtracking.

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- runs and segments ---------------------------------------------------------------------------------------------

#: White-space-separated pieces with a digit or "@", and what stands between neighbours of them on one line.
_RUN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:[ \t]{1,2}[^\s0-9@]*+[0-9@]\S*+)*+")
_BESIDE = re.compile(r"[ \t]{1,2}[^\s@]{1,64}")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
_RUNS_OF = re.compile(r"(.)\1+")
_GROUP = re.compile("[0-9]+")
_DATE = re.compile(r"(?:19|20)[0-9]{2}([-. ]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?![0-9])|(?:0[1-9]|[12][0-9]|3[01])([-.])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}(?![0-9])")
_CUES = (
    "mail email e-mail contact write mailto from", "ip host server address ping node gateway client peer", "card visa credit payment mastercard amex debit cc",
    "call tel phone mobile fax dial cell telephone text reach whatsapp 电话 手机", "order isbn id no invoice tracking ref date version total serial ticket account timestamp code part case batch",
)
_CUE = {w: k for k, ws in enumerate(_CUES) for w in ws.split()}
_MAIL_LOCAL, _MAIL_HOST, _NUMERIC = frozenset("._%+-"), frozenset(".-"), frozenset(" .()-")
_SIGNS = {c: "d" for c in range(48, 58)} | {c: "a" for c in (*range(65, 91), *range(97, 123))}


def _class(c: str) -> str:
    return "#" if not c or c.isspace() else "d" if c.isdigit() else "a" if c.isascii() and c.isalpha() else "u" if c.isalpha() else c


def _ends(tokens: list[str], i: int) -> Iterator[int]:
    """Last tokens + 1 of the segments that begin at token i: addresses with one "@", and numbers with their separators."""
    n, first = min(len(tokens), i + MAX_TOKENS), tokens[i]
    if first[0].isascii() and first[0].isalnum():
        at, j, chars = -1, i, 0
        while j < n and chars <= MAX_CHARS:
            t = tokens[j]
            chars += len(t)
            if t == "@" and at < 0:
                at = j
            elif not (t[0].isascii() and t[0].isalnum()):
                beside = t == " " and (at == j - 1 or at < 0 and tokens[j + 1 : j + 2] == ["@"])
                if not beside and t not in (_MAIL_LOCAL if at < 0 else _MAIL_HOST):
                    break
            elif at >= 0 and tokens[j - 1] == "." and t.isalpha() and tokens[j + 1 : j + 2] != ["-"]:
                yield j + 1
            j += 1
    if first in ("+", "(") or first[0] in "0123456789":
        digits = groups = opened = 0
        most = 6 if first[0] in "+(0" else 4
        for j in range(i, n):
            t = tokens[j]
            opened += t == "("
            if t[0] in "0123456789":
                digits, groups = digits + len(t), groups + 1
                if digits > 19 or groups > most or opened > 1:
                    break
                if digits >= 7 or groups == 4 and tokens[i + 1 : j : 2] == [".", ".", "."] and j == i + 6:
                    yield j + 1
            elif not (t in _NUMERIC or j == i) or tokens[j - 2 : j + 1] == [" ", " ", " "]:
                break


class Run:
    """Tokens of one run, and the candidate segments that start at each: (last + 1, key); the key holds all that features need."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.at = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        tokens = [text[a:b] for a, b in self.at]
        self.starts: list[list[tuple[int, tuple]]] = [[] for _ in self.at]
        for i, (a, _) in enumerate(self.at):
            around = None
            for j in _ends(tokens, i):
                b = self.at[j - 1][1]
                if b - a > MAX_CHARS:
                    break
                if around is None:
                    before = text[max(0, a - 32) : a].lower().split()
                    around = next((_CUE[w] for w in (x.strip(":.,;(#=") for x in before[:-3:-1]) if w in _CUE), -1), _class(text[a - 1 : a]) if a else "#"
                self.starts[i].append((j, (*_content(text[a:b]), *around, _class(text[b : b + 1]) + _class(text[b + 1 : b + 2]))))


def _content(s: str) -> tuple[str, str]:
    """Signs of a segment (letters and digits as classes; runs of them as one for addresses), and what its values tell."""
    signs = s.translate(_SIGNS)
    if "@" in s:
        return _RUNS_OF.sub(r"\1", signs), ""
    digits = "".join(_GROUP.findall(s))
    parts = s.split(".")
    octets = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    marks = "o" * octets + "l" * (12 <= len(digits) <= 19 and luhn(digits)) + "t" * bool(_DATE.match(s)) + "b" * (digits[:3] in ("978", "979")) + "z" * (digits[0] == "0")
    return signs.replace("  ", " "), marks


@functools.lru_cache(REMEMBERED)
def features(key: tuple) -> list[str]:
    """Features of a segment, without the kind."""
    signs, marks, cue, left, right = key
    seps = "".join(sorted({c for c in signs if c not in "ad"}))
    if "@" in signs:
        host = signs.partition("@")[2].strip()
        out = ["mail", f"host={host[:12]}", f"blank={' @' in signs}{'@ ' in signs}"]
    else:
        groups = [len(g) for g in re.findall("d+", signs)]
        out = [
            "number", f"signs={signs}", f"digits={sum(groups)}", f"groups={'-'.join(map(str, groups))}", f"n={len(groups)}", f"last={groups[-1]}", f"seps={seps}",
            f"plus={signs[0] == '+'}{min(sum(groups), 16) // 2}", f"digits={sum(groups)},cue={cue}", f"digits={sum(groups)},seps={seps}", f"open={signs.count('(') - signs.count(')')}",
            f"longest={max(groups)}", f"seps={seps},cue={cue}",
        ]
        out += [f"luhn={'l' in marks},{sum(groups) >= 14}", f"octets={'o' in marks}", f"date={'t' in marks}", f"book={'b' in marks}", f"zero={'z' in marks}"]
    return [*out, "bias", f"first={signs[0]}", f"left={left}", f"right={right}", f"right={right[0]}", f"cue={cue}"]


class Field:
    """Weights of (kind, feature), and of kind after kind; kind 0 is "other"."""

    LABELS = len(KINDS) + 1

    def __init__(self) -> None:
        self.weights: list[dict[str, float]] = [{} for _ in KINDS]
        self.steps = np.zeros((self.LABELS, self.LABELS))
        self.other = 0.0
        self.known: dict[tuple, list[float]] = {}

    def scores(self, key: tuple) -> list[float]:
        """Score of each kind for a segment."""
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            of = features(key)
            self.known[key] = [sum(w.get(f, 0.0) for f in of) for w in self.weights]
        return self.known[key]

    def decode(self, run: Run) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation's entities."""
        n, steps, labels, lo = len(run.at), self.steps.tolist(), range(self.LABELS), -math.inf
        best = [[lo] * self.LABELS for _ in range(n + 1)]
        back: dict = {}
        best[0][0] = 0.0
        for i, starts in enumerate(run.starts):
            row = best[i]
            came = [max(labels, key=lambda p: row[p] + steps[p][y]) for y in labels] if max(row[1:]) > lo else [0] * self.LABELS  # noqa: B023
            value = row[came[0]] + steps[came[0]][0] + self.other
            if value > best[i + 1][0]:
                best[i + 1][0] = value
                back[i + 1, 0] = (i, came[0])
            for j, key in starts:
                for y, score in enumerate(self.scores(key), 1):
                    value = row[came[y]] + steps[came[y]][y] + score
                    if value > best[j][y]:
                        best[j][y] = value
                        back[j, y] = (i, came[y])
        j, y, out = n, max(labels, key=lambda y: best[n][y]), []
        while j:
            i, prev = back[j, y]
            if y:
                out.append((run.at[i][0], y - 1, run.at[j - 1][1]))
            j, y = i, prev
        return out[::-1]

    def step(self, run: Run, truth: dict[tuple[int, int], int], rate: float, decay: float = 1e-3) -> None:
        """One gradient step on a run; truth: (first, last + 1) in tokens -> kind."""
        self.known.clear()
        n, lo = len(run.at), -1e30
        scores = [[(j, key, np.array(self.scores(key))) for j, key in starts] for starts in run.starts]
        alpha, beta = np.full((n + 1, self.LABELS), lo), np.full((n + 1, self.LABELS), lo)
        alpha[0, 0], beta[n] = 0.0, 0.0
        for i in range(n):
            into = np.logaddexp.reduce(alpha[i][:, None] + self.steps, axis=0)
            alpha[i + 1, 0] = np.logaddexp(alpha[i + 1, 0], into[0] + self.other)
            for j, _, s in scores[i]:
                alpha[j, 1:] = np.logaddexp(alpha[j, 1:], into[1:] + s)
        for i in range(n - 1, -1, -1):
            ways = [self.steps[:, 0] + self.other + beta[i + 1, 0]]
            ways += [np.logaddexp.reduce(self.steps[:, 1:] + s + beta[j, 1:], axis=1) for j, _, s in scores[i]]
            beta[i] = np.logaddexp.reduce(ways, axis=0)
        z = np.logaddexp.reduce(alpha[n])
        inside = {k for (a, b) in truth for k in range(a, b)}
        seen = np.zeros_like(self.steps)
        y0, k = 0, 0
        while k < n:
            hit = next(((b, y) for (a, b), y in truth.items() if a == k), None)
            y1, k = (hit[1], hit[0]) if hit else (0, k + 1)
            seen[y0, y1] += 1
            y0 = y1
        share = lambda x: np.exp(np.minimum(x - z, 0.0))
        other = 0.0
        for i in range(n):
            p = share(alpha[i] + self.steps[:, 0] + self.other + beta[i + 1, 0])
            seen[:, 0] -= p
            other += (i not in inside) - p.sum()
            for j, key, s in scores[i]:
                p = share(alpha[i][:, None] + self.steps[:, 1:] + s + beta[j, 1:])
                seen[:, 1:] -= p
                for y, (w, x) in enumerate(zip(self.weights, p.sum(0).tolist()), 1):
                    g = (truth.get((i, j)) == y) - x
                    if abs(g) > 1e-4:
                        for f in features(key):
                            w[f] = w.get(f, 0.0) * (1 - rate * decay) + rate * g
        self.other += rate * other
        self.steps += rate * seen


def made(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence with entities and with numbers that are none: (text, spans as (start, kind, end))."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    pick = lambda *makers: rng.choice(makers)()
    day = lambda: (f"{rng.choice(('19', '20'))}{d(2)}", f"{rng.randint(1, 12):02d}", f"{rng.randint(1, 28):02d}")
    clock = lambda: f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}"

    def card() -> str:
        body = rng.choice("3456") + d(rng.choice((14, 14, 14, 13)))
        body += next(c for c in "0123456789" if luhn(body + c))
        cuts = (0, 4, 10, 15) if len(body) == 15 else (0, 4, 8, 12, 16)
        return rng.choice(["", "", " ", "-", "."]).join(body[a:b] for a, b in zip(cuts, cuts[1:]))

    def mail() -> str:
        host = pick(lambda: f"{word()}.{rng.choice(['com', 'org', 'net', 'de', 'io'])}", lambda: f"mail{d(1)}.{word()}.com", lambda: f"{word()}-{word()}.co.uk")
        user = pick(lambda: f"{word()}.{word()}", lambda: f"{word()}{d(2)}", lambda: f"{word()}_{word()}", word, lambda: f"{word()}+{word()}")
        return user + rng.choice(["@", " @ ", " @ ", " @", "@ "]) + host

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return pick(
            lambda: f"+{d(rng.randint(1, 2))} ({a}) {b}-{c}", lambda: f"({a}) {b}-{c}", lambda: f"{a}-{b}-{c}", lambda: f"{a}.{b}.{c}", lambda: f"1-{a}-{b}-{c}", lambda: f"({a}) {b} {c}", lambda: f"({a}){b}-{c}",
            lambda: f"{a} {b} {c}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"0{d(3)} {d(rng.randint(5, 7))}", lambda: f"1 ({a}) {b}-{c}", lambda: f"+{d(2)} {d(2)} {d(4)} {d(4)}",
        )

    def loose() -> str:
        """Numbers that only a cue makes a telephone."""
        return rng.choice([a + b + c for a, b, c in [(d(3), d(3), d(4))]] + [f"{d(3)}-{d(4)}", f"{d(3)} {d(4)}", d(11)])

    none = (
        lambda: d(4), lambda: f"{d(1)}.{d(1)}", lambda: f"version {d(1)}.{d(1)}.{d(2)}", lambda: "-".join(day()), lambda: "-".join(day()) + f" {clock()}", lambda: "-".join(day()) + f"T{clock()}:{d(2)}",
        lambda: ".".join(day()[::-1]), lambda: ".".join(day()[::-1]) + f" {clock()}", lambda: "/".join(day()), lambda: "".join(day()), clock, lambda: f"${d(3)}.{d(2)}", lambda: d(rng.randint(5, 13)), lambda: d(10),
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: f"{d(3)},{d(3)},{d(3)}", lambda: f"@{word()}{d(2)}", lambda: f"{d(2)}-{d(2)}", lambda: f"{d(3)} {d(3)} {d(3)}",
        lambda: f"{d(1)}.{d(1)}.{d(1)}.{d(3)}{d(2)}", lambda: d(16), lambda: f"id{d(9)}", lambda: f"{rng.choice(['', 'ISBN ', 'isbn: '])}978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"ISBN {d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"978{d(10)}",
        lambda: f"{rng.choice(['', 'order ', 'order '])}{d(3)}-{d(7)}-{d(7)}", lambda: f"order {d(rng.randint(7, 12))}", lambda: f"{rng.choice(['no ', 'id ', 'ref ', 'ticket '])}{d(3)}-{d(4)}", lambda: f"{d(5)}-{d(4)}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(2)}.{d(4)}, -{d(3)}.{d(4)}", lambda: f"19{d(2)}-20{d(2)}", lambda: f"0.{d(rng.randint(5, 12))}", lambda: f"{word()} @ {d(1)}pm", lambda: f"{word()}@{word()}",
        lambda: f"{word()} @ {word()}", lambda: " ".join(d(rng.randint(1, 4)) for _ in range(rng.randint(3, 8))), lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(1)}{word()}{d(2)}", lambda: f"{d(4)}-{d(4)}", lambda: f"{d(2)} {d(3)} {d(3)}",
        lambda: f"{d(3)}-{d(3)}", lambda: f"{rng.choice(['serial', 'tracking', 'account', 'invoice', 'timestamp'])} {d(rng.choice((10, 11, 12)))}", lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(3)}" if rng.random() < 0.3 else f"{d(3)}.{d(3)}",
    )
    cues = ("mail", "ip", "card", "call")
    text, spans = "", []
    for _ in range(rng.randint(2, 4)):
        text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
        if rng.random() < 0.5:
            k = rng.randrange(4)
            s = (mail, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), card, phone)[k]()
            if k == 3 and rng.random() < 0.25:
                s = loose()
                text += rng.choice(["call", "tel", "phone", "mobile", "fax", "电话", "dial", "cell"]) + rng.choice([" ", ": "])
            elif rng.random() < 0.3:
                text += rng.choice([cues[k], *_CUES[k].split()]) + rng.choice([" ", ": "])
            if rng.random() < 0.1:
                text += rng.choice(["(", "<", "[", '"', "码"])
            spans.append((len(text), k, len(text) + len(s)))
        else:
            s = rng.choice(none)()
        text += s + rng.choice([" ", " ", ", ", ". ", "\n", "%%% ", "; ", ") ", "。"])
    return text, spans


def runs(text: str, start: int = 0, end: int | None = None) -> Iterator[Run]:
    """Runs between start and end that could hold an entity."""
    end, done = len(text) if end is None else end, start
    for m in _RUN.finditer(text, start, end):
        a, b = m.span()
        if b <= done:
            continue
        if text[a] == "@":
            # the word before a lone "@"
            k = a
            while k > done and a - k < 2 and text[k - 1] in " \t":
                k -= 1
            while k < a and k > done and a - k < 66 and not text[k - 1].isspace():
                k -= 1
            a = k
        if text[b - 1] == "@" and (after := _BESIDE.match(text, b, end)):
            b = after.end()
        done, run = b, Run(text, max(a, start), b)
        if any(run.starts):
            yield run


@functools.cache
def trained() -> Field:
    """The field, fitted on TRAIN_SENTENCES generated sentences; the same in every process."""
    field = Field()
    for epoch in range(EPOCHS):
        rng = random.Random(SEED)  # the same sentences each time, made anew rather than held
        for _ in range(TRAIN_SENTENCES):
            text, spans = made(rng)
            for run in runs(text):
                first, last = {a: i for i, (a, _) in enumerate(run.at)}, {b: i + 1 for i, (_, b) in enumerate(run.at)}
                known = {(i, j) for i, starts in enumerate(run.starts) for j, _ in starts}
                truth = {(first[a], last[b]): k + 1 for a, k, b in spans if a in first and b in last and (first[a], last[b]) in known}
                field.step(run, truth, 0.2 / (1 + epoch))
    field.known.clear()
    return field


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans; both as (start, kind, end), sorted."""
    base = base_spans(text)
    more, at = [], 0
    for a, _, b in [*base, (len(text), 0, len(text))]:
        if a > at:
            more += [s for run in runs(text, at, a) for s in field.decode(run)]
        at = max(at, b)
    return base, sorted(base + more)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, SHA-256 of the base spans, and all spans as kind:start:end."""
    field = trained()

    def columns_of(texts: list[str]) -> list[list]:
        found = [all_spans(t, field) for t in texts]
        counts = [[sum(s[1] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
        return [*counts, [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found], [_written(every) for _, every in found]]

    fields = {f"n_{k}": "long" for k in KINDS} | {"base_sha256": "string", "spans": "string"}
    return map_texts(docs, text, fields, lambda: columns_of)


def redacted(text: str, field: Field) -> str:
    """The text with each stretch of spans replaced by its first kind, as in [EMAIL]."""
    out, at = [], 0
    for a, k, b in all_spans(text, field)[1]:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with the spans of its text column replaced, and the length column, if there is one, renewed."""
    import pyarrow as pa

    field, names = trained(), docs.columns
    place, count = names.index(text), names.index(length) if length in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, ROWS) for x in batches for k in range(0, x.num_rows, ROWS)):
            new = [None if t is None else redacted(t, field) for t in b.column(place).to_pylist()]
            columns = list(b.columns)
            columns[place] = pa.array(new, pa.string())
            if count >= 0:
                columns[count] = pa.array([None if t is None else len(t) for t in new], b.column(count).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
