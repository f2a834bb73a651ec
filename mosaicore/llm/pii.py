"""Personal data: rules for plain forms, and a character-level bidirectional LSTM with a CRF for others.

Every text is read whole by the rules (`base_spans`).  The tagger then reads windows of 128
characters that overlap by half, wherever a digit of any script, an at sign, a bracketed "at" or the
word "dot" stands within reach: what is accepted of a kind always holds one of these (`holds`,
`TRIGGER`).  Each window is decoded by
Viterbi's algorithm over learnt transitions; its spans carry the mean posterior probability of
their tags.
Windows are reconciled globally, for a text as a whole: spans that run into the inner edge of a
window are joined to what the next window has of them, whatever their length, or left to the
window that holds them whole, and of all whole spans the set without overlaps that has the
largest total score is taken.  Rules' spans always stay; the tagger's are
added where they overlap none.  The form of a span is learnt, not matched by a pattern; asked for is
only what a kind consists of (an at, four octets, a card's digits with their check, a phone's digits).

The tagger is trained in numpy (stochastic gradients with Adam) on labelled spans: personal data
of many written forms, laid into text of a bounded sample of the documents, and
look-alikes such as dates, prices and version numbers, which carry no label.

Edge cases: null and empty texts have no spans; runs of digits may be of any length; very long texts are
tagged whole, some windows at a time; of equally good sets of spans the one found first is taken, the same in
every run; an empty table gives an empty result (the tagger is then trained on made-up words); repeated rows are
tagged each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaicore.llm.bytestext import text_arrays
from mosaicore.llm.common import bounded, first_by_hash, pick, tidied

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The rules' patterns. A run of digits is looked at from its first one: a later start of the same run fails where the first does.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def octet(part: str) -> bool:
    """Whether a run of digits, however long, is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The rules' spans by kind, then start: leftmost matches of each kind that do not overlap; failing ones are dropped."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL_CHARS:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                end = m.end()
    if not re.search("[0-9]", text):
        return out
    for m in IP.finditer(text):
        if all(map(octet, m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---------------------------------------------------------------- the tagger

WIDTH, STRIDE = 128, 64
#: Places on either side of a trigger that are read, and those that a word at their edge may add.
REACH, WORD_REACH = 80, 256
#: O, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Printable ASCII each by itself; white space, controls, letters, digits and others beyond ASCII by class; the pad.
SYMBOLS = 96 + 5
PAD = SYMBOLS - 1
#: Windows that are decoded at a time, and held at a time.
BATCH, CHUNK = 256, 4096
WORD_END = re.compile(r"\s")
#: One of these is in every span of the tagger (see `holds`), so it need not look elsewhere.
TRIGGER = re.compile(r"[\d@]|[\[({<]\s*at\b|\bdot\b", re.I)


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """The symbol of each code point."""
    table = np.full(0x110000, 99, np.uint8)  # others beyond ASCII
    for code in range(128, 0x110000):
        char = chr(code)
        if char.isdigit():
            table[code] = 98
        elif char.isalpha():
            table[code] = 97
    table[:128] = 95  # controls
    table[32:127] = np.arange(95)
    table[9:14] = table[0xA0] = 96
    return table


def encode(text: str) -> np.ndarray:
    """A symbol for each character."""
    return symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


@dataclass
class Tagger:
    """Weights: input rows by symbol and recurrent matrices of both directions, output layer, CRF transitions."""

    w: list[np.ndarray]
    u: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray

    @property
    def parts(self) -> list[np.ndarray]:
        return [*self.w, *self.u, self.out, self.bias, self.trans]


def allowed() -> np.ndarray:
    """Penalties of transitions: an inside tag follows begin or inside of its kind only."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        out[:, inside] = -1e4
        out[[inside - 1, inside], inside] = 0
    return out


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (time x batch x size) of symbols (time x batch); gates: in, forget, out, new."""
    t, n = x.shape
    size = u.shape[0]
    half = np.ones(4 * size, np.float32)
    half[: 3 * size] = 0.5  # a logistic gate of z is 1/2 + 1/2 tanh(z/2)
    coming, u = (w * half)[x], u * half
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    states, tape = np.empty((t, n, size), np.float32), []
    for k in range(t):
        z = h @ u
        z += coming[k]
        np.tanh(z, out=z)
        s, g = z[:, : 3 * size], z[:, 3 * size :]
        s *= 0.5
        s += 0.5
        before, c = c, s[:, size : 2 * size] * c + s[:, :size] * g
        tc = np.tanh(c)
        if keep:
            tape.append((h, before, s, g, tc))
        h = s[:, 2 * size :] * tc
        states[k] = h
    return states, tape


def lstm_back(x: np.ndarray, d: np.ndarray, u: np.ndarray, tape: list, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of w and u from those of the hidden states."""
    t, n = x.shape
    size = u.shape[0]
    dz, held = np.empty((t, n, 4 * size), np.float32), np.empty((t, n, size), np.float32)
    dh = dc = np.zeros(d.shape[1:], np.float32)
    for k in range(t - 1, -1, -1):
        held[k], before, s, g, tc = tape[k]
        i, f, o = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :]
        dh = dh + d[k]
        dc = dc + dh * o * (1 - tc * tc)
        own = dz[k]
        own[:, :size], own[:, size : 2 * size], own[:, 2 * size : 3 * size] = dc * g, dc * before, dh * tc
        own[:, : 3 * size] *= s * (1 - s)
        own[:, 3 * size :] = dc * i * (1 - g * g)
        dh, dc = own @ u.T, dc * f
    flat = dz.reshape(t * n, 4 * size)
    order = np.argsort(x.ravel(), kind="stable")
    own = x.ravel()[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    dw = np.zeros((rows, 4 * size), np.float32)
    dw[own[first]] = np.add.reduceat(flat[order], first, axis=0)
    return dw, held.reshape(t * n, size).T @ flat


def emissions(model: Tagger, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Scores (time x batch x tags) of symbols (time x batch)."""
    ahead, tape_a = lstm(x, model.w[0], model.u[0], keep)
    back, tape_b = lstm(x[::-1], model.w[1], model.u[1], keep)
    h = np.concatenate([ahead, back[::-1]], axis=2)
    return h @ model.out + model.bias, (h, tape_a, tape_b)


def both_ways(e: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward products, what came in at each place, and the log of the total, of emissions (time x batch x tags); mask marks real places."""
    t = len(e)
    top = e.max(axis=2, keepdims=True)
    x, step = np.exp(e - top), np.exp(trans)
    a, b, scale = np.empty_like(x), np.ones_like(x), np.ones((t, e.shape[1], 1), x.dtype)
    a[0] = x[0]
    for s in range(t):
        if s:
            a[s] = np.where(mask[s][:, None], (a[s - 1] @ step) * x[s], a[s - 1])
        scale[s] = a[s].sum(axis=1, keepdims=True)
        a[s] /= scale[s]
    came = x / scale
    for s in range(t - 2, -1, -1):
        b[s] = np.where(mask[s + 1][:, None], (came[s + 1] * b[s + 1]) @ step.T, b[s + 1])
    return a, b, came, (np.log(scale) + np.where(mask[:, :, None], top, 0)).sum(axis=(0, 2))


def posteriors(e: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The probability of each tag at each real place."""
    a, b, _, _ = both_ways(e, trans, mask)
    return a * b * mask[:, :, None]


def crf_gradient(e: np.ndarray, trans: np.ndarray, gold: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient of emissions, of transitions) of the mean negative log-likelihood."""
    n, k = e.shape[1:]
    a, b, came, z = both_ways(e, trans, mask)
    de = a * b * mask[:, :, None]
    place, row = np.nonzero(mask)
    tag = gold[place, row]
    de[place, row, tag] -= 1
    dt = np.exp(trans) * (a[:-1].reshape(-1, k).T @ (came[1:] * b[1:] * mask[1:, :, None]).reshape(-1, k))
    later = place > 0
    steps = gold[place[later] - 1, row[later]], tag[later]
    np.add.at(dt, steps, -1)
    score = e[place, row, tag].sum() + trans[steps].sum()
    return float((z.sum() - score) / n), de / n, dt / n


def train(samples: list[tuple[np.ndarray, np.ndarray]], size: int = 20, steps: int = 600, batch: int = 64, rate: float = 0.03, seed: int = 5) -> Tagger:
    """A tagger learnt from windows (symbols, tags) of WIDTH places; PAD marks places beyond the text.

    A batch is drawn from one quarter of the windows by length, and goes as far as the longest in it.
    """
    rng = np.random.default_rng(seed)
    scale = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    model = Tagger([scale(SYMBOLS, 4 * size) for _ in range(2)], [scale(size, 4 * size) for _ in range(2)], scale(2 * size, TAGS), np.zeros(TAGS, np.float32), allowed())
    for w in model.w:
        w[:, size : 2 * size] += 1  # remember at first
    samples = sorted(samples, key=lambda s: int((s[0] != PAD).sum()))
    x = np.stack([s for s, _ in samples]).T
    y = np.stack([t for _, t in samples]).T
    ends = (x != PAD).sum(axis=0)
    m1, m2 = [np.zeros_like(p) for p in model.parts], [np.zeros_like(p) for p in model.parts]
    for step in range(1, steps + 1):
        parts = min(4, x.shape[1])
        quarter = np.array_split(np.arange(x.shape[1]), parts)[step % parts]
        own = quarter[rng.integers(0, len(quarter), batch)]
        long = max(1, int(ends[own].max()))
        xs, ys = x[:long, own], y[:long, own]
        e, (h, tape_a, tape_b) = emissions(model, xs, keep=True)
        _, de, dt = crf_gradient(e, model.trans, ys, xs != PAD)
        dh = de @ model.out.T
        half = dh.shape[2] // 2
        dwa, dua = lstm_back(xs, dh[:, :, :half], model.u[0], tape_a, SYMBOLS)
        dwb, dub = lstm_back(xs[::-1], dh[::-1, :, half:], model.u[1], tape_b, SYMBOLS)
        grads = [dwa, dwb, dua, dub, h.reshape(-1, 2 * half).T @ de.reshape(-1, TAGS), de.sum(axis=(0, 1)), dt]
        slow = rate * min(1, 2 * (1 - step / (steps + 1)))
        norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))) / 2)
        for p, g, a, b in zip(model.parts, grads, m1, m2, strict=True):
            g = g / norm
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (slow * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def decode(model: Tagger, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best tags by Viterbi, posterior probability of each) of windows (windows x WIDTH)."""
    tags, sure = np.zeros(windows.shape, np.int8), np.zeros(windows.shape, np.float32)
    for at in range(0, len(windows), BATCH):
        x = windows[at : at + BATCH].T
        e, _ = emissions(model, x)
        real = x != PAD
        t, n, k = e.shape
        v, back = e[0], np.zeros((t, n, k), np.int8)
        for s in range(1, t):
            options = v[:, :, None] + model.trans
            back[s] = options.argmax(axis=1)
            v = np.where(real[s][:, None], options.max(axis=1) + e[s], v)
            back[s][~real[s]] = np.arange(k)
        best = v.argmax(axis=1)
        rows = np.arange(n)
        for s in range(t - 1, -1, -1):
            tags[at : at + n, s] = best
            best = back[s, rows, best]
        tags[at : at + n][~real.T] = 0
        some = np.flatnonzero((tags[at : at + n] > 0).any(axis=1))
        if len(some):
            p = posteriors(e[:, some], model.trans, real[:, some])
            sure[at + some] = np.take_along_axis(p, tags[at + some].T[:, :, None].astype(np.int64), axis=2)[:, :, 0].T
    return tags, sure


# ---------------------------------------------------------------- labelled spans

TEMPLATES: dict[str, tuple[str, ...]] = {
    "email": ("{w}@{w}.{t}", "{w}.{w}@{w}.{t}", "{w}{d}@{w}.{w}.{t}", "{w} @ {w}.{t}", "{w}[at]{w}.{t}", "{w} (at) {w}.{t}", "{w} [at] {w} [dot] {t}", "{w}.{D}@{w}{d}.{w}.{t}", "{w} (at) {w} (dot) {t}",
              "{w} [at] {w} [dot] {w} [dot] {t}", "{w}.{w} (at) {w} (dot) {w} (dot) {t}", "{w}.{w}{w} [at] {w}{w}.{w}.{t}", "{w}.{w}{w} (at) {w}{w}{w}.{t}", "{w}.{w}.{w} [at] {w}{w} [dot] {w} [dot] {w} [dot] {t}",
              "{w} at {w} dot {t}", "{w} dot {w} at {w} dot {t}", "{w} AT {w} DOT {t}", "{w}{D} at {w} dot {w} dot {t}"),
    "ip": ("{p}.{p}.{p}.{p}", "{p} . {p} . {p} . {p}", "{p}[.]{p}[.]{p}[.]{p}"),
    "card": ("{c4} {c4} {c4} {c4}", "{c4}-{c4}-{c4}-{c4}", "{c16}", "{c4}.{c4}.{c4}.{c4}", "{c4} {c6} {c5}"),
    "phone": ("+{d} ({D}) {D}-{Q}", "+{d}{D} {D} {Q}", "({D}) {D}-{Q}", "{D}-{D}-{Q}", "00{d}{d} {D} {Q}", "+{d}{d} {d}{d} {Q} {Q}", "1-{D}-{D}-{Q}"),
}
#: Forms by kind; those that look most like other text are practised more often.
HARD = ("{w} at {w} dot {t}", "{w} dot {w} at {w} dot {t}", "{w} @ {w}.{t}", "{w} (at) {w}.{t}", "{D}-{D}-{Q}", "00{d}{d} {D} {Q}", "{w}.{w}.{w} [at] {w}{w} [dot] {w} [dot] {w} [dot] {t}")
FORMS = [(k, t) for k, kind in enumerate(KINDS) for t in TEMPLATES[kind] for _ in range(1 + (t in HARD))]
LOOKALIKES = ("{d}", "{d}{d}", "{Q}", "{D}", "19{d}{d}", "20{d}{d}-0{d}-1{d}", "{d}.{d}", "v{d}.{d}.{d}", "${D}.{d}{d}", "{D},{D}", "{d}{d}:{d}{d}", "{d}{d}%", "@{w}", "{Q}-{d}{d}", "{D}/{D}", "{w}{d}", "{Q}{Q}", "No. {Q}", "{D} {D}", "({d})", "[{d}{d}]", "{w} at {w}", "look at {w}. dot", "the dot {w}", "{w} dot, {w}", "{D}{D}{D}{D}{D}", "{Q} {Q} {Q}", "{D}.{D}.{D}", "{d}.{d}.{d}.{D}{d}")
WORDS = ("the of and thion er erin onar ento les des que para der und ein ich as is to").split()

#: Letters about as often as in names.
LETTERS = "aaaaaeeeeeiiiooorrrnnnsssttlllddccmmhhuuppgbfvkywjzxq"


def luhn_number(rng: np.random.Generator, n: int) -> str:
    digits = "4" + "".join(map(str, rng.integers(0, 10, n - 2)))
    return next(digits + str(k) for k in range(10) if luhn(digits + str(k)))


def fill(template: str, rng: np.random.Generator, words: list[str]) -> str:
    """A template with words, digits and numbers of its kind put in."""
    card = luhn_number(rng, 15 if "{c5}" in template else 16)
    at = 0
    out = []
    for piece in re.split(r"(\{[^}]*\})", template):
        if piece == "{w}":
            piece = "".join(c for c in words[rng.integers(len(words))].lower() if c.isascii() and c.isalpha()) or "mail"
            if rng.random() < 0.5:  # names and hosts are seldom words of the texts
                piece = "".join(LETTERS[k] for k in rng.integers(0, len(LETTERS), rng.integers(2, 13)))
        elif piece == "{t}":
            piece = ("com", "org", "net", "edu", "de", "fr", "io")[rng.integers(7)]
        elif piece == "{p}":
            piece = str(rng.integers(256))
        elif piece[:2] == "{c":
            n = int(piece[2:-1])
            piece, at = card[at : at + n], at + n
        elif piece in ("{d}", "{D}", "{Q}"):
            piece = "".join(map(str, rng.integers(0, 10, {"{d}": 1, "{D}": 3, "{Q}": 4}[piece])))
        out.append(piece)
    text = "".join(out)
    if rng.random() < 0.06:  # digits of another script
        zero = (0xFF10, 0x0660, 0x0966)[rng.integers(3)]
        text = text.translate({48 + k: zero + k for k in range(10)})
    return text


def labelled(texts: list[str], count: int = 6000, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows with tags: forms of every kind and look-alikes laid into pieces of the texts."""
    rng = np.random.default_rng(seed)
    words = [w for t in texts for w in t.split()] or WORDS
    words = [words[k] for k in rng.integers(0, len(words), 14_000)]
    words += ["".join(LETTERS[k] for k in rng.integers(0, len(LETTERS), rng.integers(1, 11))) for _ in range(6_000)]  # and words that no text has
    out = []
    for _ in range(count):
        left = " ".join(words[k] for k in rng.integers(0, len(words), rng.integers(2, 9)))
        right = " ".join(words[k] for k in rng.integers(0, len(words), rng.integers(2, 9)))
        if rng.random() < 0.6:
            kind, template = FORMS[rng.integers(len(FORMS))]
            core = fill(template, rng, words)
        else:
            kind, core = -1, fill(LOOKALIKES[rng.integers(len(LOOKALIKES))], rng, words)
        gap = [(" ", ": ", ", ", "\n", "(")[k] for k in rng.integers(0, 5, 1)][0]
        after = (" ", ". ", ", ", "\n", "; ", "%%% ", "!! ")[rng.integers(7)]
        text = left + gap + core + after + right
        tags = np.zeros(len(text), np.int64)
        for name, a, b in base_spans(left + gap) + [(n, a + len(left + gap + core + after), b + len(left + gap + core + after)) for n, a, b in base_spans(right)]:
            tags[a:b] = 2 + 2 * KINDS.index(name)
            tags[a] -= 1
        at = len(left) + len(gap)
        if kind >= 0:
            tags[at : at + len(core)] = 2 + 2 * kind
            tags[at] -= 1
        low = max(0, min(at - int(rng.integers(0, max(1, WIDTH - min(len(core), WIDTH)))), len(text) - 1))
        if rng.random() < 0.1:  # the window's edge cuts the core
            low = max(0, at + int(rng.integers(0, len(core))) - WIDTH * int(rng.integers(2)))
        symbols = np.full(WIDTH, PAD)
        own = np.zeros(WIDTH, np.int64)
        piece = encode(text)[low : low + WIDTH]
        symbols[: len(piece)], own[: len(piece)] = piece, tags[low : low + WIDTH]
        inside = own[0]
        if inside and inside % 2 == 0:  # the window cuts a span: what is left of it begins here
            own[0] -= 1
        out.append((symbols, own))
    return out


@lru_cache(4)
def trained(texts: tuple[str, ...]) -> Tagger:
    return train(labelled(list(texts)))


def fit(docs: DataFrame, max_texts: int = 200, max_chars: int = 20_000) -> Tagger:
    """A tagger whose training text is that of the first `max_texts` rows by a hash of doc_id, at most `max_chars` characters of each."""
    rows = pick(docs, doc_id="doc_id", text="text").where("doc_id is not null")
    found = first_by_hash(rows.where("text is not null").select("doc_id", F.substring("text", 1, max_chars).alias("text")), max_texts, rows.select("doc_id").count())
    return trained(tuple(sorted(r.text for r in found)))


# ---------------------------------------------------------------- tagging of texts

#: Least posterior probability of the tags of an added span, on average.
LEAST_SURE = 0.6

PART = re.compile(r"[\w%+-]|\.(?=\w)")
AT = re.compile(r"@|[\[({<]\s*at\b|\bat\b(?=.*\bdot\b)", re.I | re.S)


def holds(kind: str, text: str) -> bool:
    """Whether a tagged string has what its kind consists of, in whatever form: an at of some kind, four octets, a card's or a phone's digits.

    The form is for the tagger to learn; this asks for content only, all of which holds a TRIGGER.
    """
    if kind == "email":
        return bool(AT.search(text))
    digits = re.sub(r"\D", "", text)
    if kind == "ip":
        parts = re.findall(r"\d+", text)
        return len(parts) == 4 and all(map(octet, parts))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def settled(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """A tagged place without the white space at its end; an address has whole words."""
    while b > a and text[b - 1].isspace():
        b -= 1
    if kind == "email":
        while a and PART.match(text, a - 1):
            a -= 1
        while b < len(text) and (text[b].isalnum() or text[b] in "_-"):
            b += 1
    return a, b


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within reach of a trigger, up to the ends of the words at their edges, merged."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if not out or a > out[-1][1]:
            word = WORD_END.search(text[max(0, a - WORD_REACH) : a][::-1])
            a -= word.start() if word else min(a, WORD_REACH)
        word = WORD_END.search(text, b, b + WORD_REACH)
        b = word.start() if word else min(len(text), b + WORD_REACH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def reconcile(spans: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (score, kind, start, end), the set without overlaps that has the largest total score."""
    spans = sorted({(k, a, b): s for s, k, a, b in sorted(spans)}.items(), key=lambda x: (x[0][2], x[0][1], x[0][0]))
    ends = [b for (_, _, b), _ in spans]
    best = [0.0]
    for i, ((_, a, _), s) in enumerate(spans):
        before = int(np.searchsorted(ends[:i], a, side="right"))
        best.append(max(best[-1], best[before] + s))
    out, i = [], len(spans)
    while i:
        (k, a, b), s = spans[i - 1]
        before = int(np.searchsorted(ends[: i - 1], a, side="right"))
        if best[before] + s > best[i - 1]:
            out.append((k, a, b))
            i = before
        else:
            i -= 1
    return out[::-1]


def tag(texts: list[str], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(rules' spans, all spans) of each text, by kind, then start."""
    found: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    cut: tuple[int, int, int, float] | None = None  # (kind, start, end, score) of the span at the end of the window before

    def windows() -> Iterator[tuple[np.ndarray, int, int, bool, bool]]:
        for i, text in enumerate(texts):
            for a, b in regions(text):
                symbols = np.append(encode(text[a:b]), np.full(WIDTH, PAD, np.uint8))
                for at in range(a, max(a + 1, b - STRIDE), STRIDE):
                    yield symbols[at - a : at - a + WIDTH], i, at, at == a, at + WIDTH >= b

    source = windows()
    while held_now := list(islice(source, CHUNK)):
        tags, sure = decode(model, np.stack([w[0] for w in held_now]))
        some = (tags > 0).any(axis=1)
        for w, (_, i, at, first, last) in enumerate(held_now):
            if first or not some[w]:
                cut = None
            if not some[w]:
                continue
            held, cut = cut, None
            row = tags[w]
            k = 0
            while k < WIDTH:
                if row[k] % 2 == 1:
                    end = k + 1
                    while end < WIDTH and row[end] == row[k] + 1:
                        end += 1
                    kind, start, total, whole = int(row[k]) // 2, at + k, float(sure[w, k:end].sum()), k > 0 or first
                    if not whole and held is not None and held[0] == kind and held[1] <= at:  # from the window before on
                        total, start, whole = held[3] + float(sure[w, held[2] - at : end].sum()), held[1], True
                        total *= (at + end - start) / (max(at + end, held[2]) - start)
                    if end == WIDTH and not last:
                        cut = (kind, start, at + end, total) if whole else None
                    elif whole and total / (at + end - start) >= LEAST_SURE:
                        found[i].append((total, kind, start, at + end))
                    k = end
                else:
                    k += 1
    out = []
    for text, own in zip(texts, found, strict=True):
        base = base_spans(text)
        every, done = list(base), 0
        for kind, a, b in reconcile(own):
            a, b = settled(KINDS[kind], text, a, b)
            if a >= done and all(b <= x or a >= y for _, x, y in base) and holds(KINDS[kind], text[a:b]):
                every.append((KINDS[kind], a, b))
                done = b
        every.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        out.append((base, every))
    return out


def tag_column(column: pa.Array, model: Tagger) -> Iterator[tuple[int, str, list[Span], list[Span]]]:
    """(row, text, rules' spans, all spans) of the texts of a column that may hold any."""
    for row, data, offsets in text_arrays(column):
        raw = data.tobytes()
        texts = (raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
        some = [(k, t) for k, t in enumerate(texts) if TRIGGER.search(t)]
        for (k, text), (base, every) in zip(some, tag([t for _, t in some], model), strict=True):
            yield row + k, text, base, every


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, base and spans (kind, start, end by code points; end exclusive) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base: list[list] = [[] for _ in range(batch.num_rows)]
            every: list[list] = [[] for _ in range(batch.num_rows)]
            for row, _, own, spans in tag_column(batch.column(1), sent.value):
                base[row], every[row] = ([{"kind": k, "start": a, "end": b} for k, a, b in x] for x in (own, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(every, kind)], names=["doc_id", "base", "spans"])

    rows = pick(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    spans = "array<struct<kind: string, start: long, end: long>>"
    return rows.mapInArrow(tidied(each), f"doc_id long, base {spans}, spans {spans}")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, the number of the rules' spans of each kind, their checksum and all spans as a string."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    found = find(docs, fit(docs))
    return found.select("doc_id", *(number(k).alias(f"n_{k}") for k in KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with [EMAIL] and the like for its spans; where some overlap, the first and of equal starts the longest names the whole."""
    out, done, last = [], 0, None
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if last is not None and a < done:
            done = max(done, b)
            continue
        out += [text[done:a], f"[{kind.upper()}]"]
        done, last = b, kind
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: Tagger) -> DataFrame:
    """The documents with personal data replaced in their texts, all columns as before (n_chars, if there is one, counted anew)."""
    names = docs.columns
    text_at = names.index("text")
    count_at = names.index("n_chars") if "n_chars" in names else None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            changed = {row: redacted(text, spans) for row, text, _, spans in tag_column(columns[text_at], sent.value) if spans}
            if changed:
                texts = columns[text_at].to_pylist()
                for row, text in changed.items():
                    texts[row] = text
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if count_at is not None:
                    own = columns[count_at].to_pylist()
                    for row, text in changed.items():
                        own[row] = len(text)
                    columns[count_at] = pa.array(own, columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return bounded(docs).mapInArrow(tidied(each), docs.schema)


def digest(spans: list[Span]) -> str:
    """The checksum of spans as `counts` gives it."""
    return hashlib.sha256(joined(spans).encode()).hexdigest()
