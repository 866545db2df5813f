"""Personal data: a character-level bidirectional LSTM with CRF transitions, beside exact patterns.

The patterns of the contract find the canonical forms; the model adds what they miss: telephone numbers without a leading +,
addresses whose at sign or dots are spelled, bracketed or spaced, defanged IP addresses, and cards and numbers whose neighbours
spoil the pattern. It is trained here, in numpy, from labelled spans that a seeded generator makes, and decoded over overlapping
windows; readings that touch a cut edge of their window give way to the neighbouring window's, and the rest are reconciled over
the whole text by weighted interval scheduling.

Windows overlap by LONGEST characters, so a span of up to LONGEST characters lies whole in one; longer ones may be cut and are
then not reported. A span that may be reported holds a digit, an at sign, or a spelled "at" with its dot (``_sound``), and a window
is read by itself, so windows without any of these need no decoding: leaving them out changes nothing.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .spans import Span, digest, joined

KINDS = ("email", "ip", "card", "phone")

# Patterns of the contract.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The contract's matches: leftmost, not overlapping within a kind, failing ones dropped without a retry."""
    found: list[Span] = []
    if "@" in text:
        found += _emails(text)
    if not _DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(p[-12:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return found


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> list[Span]:
    """_EMAIL's matches, found from each @ so that text without one costs nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


# ---------------------------------------------------------------- model
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_ALPHABET = "0123456789@.+-() :_%[]/,;\natdo{}<>"
CLASSES = len(_ALPHABET) + 5  # and: lower, upper, other letter, other, padding
LONGEST = 64  # characters of a span that lies whole in some window, wherever it stands
HIDDEN, WINDOW = 32, 2 * LONGEST
STRIDE = WINDOW - LONGEST
SEED, STEPS, BATCH, EXAMPLES = 7, 360, 64, 6000
DECODED = 1024  # windows that are read at a time: some 60 MB
LEAST = 0.7  # mean posterior of a reading that is reported


@functools.lru_cache(maxsize=1)
def _table() -> np.ndarray:
    t = np.full(256, len(_ALPHABET) + 3, np.int8)
    for i in range(256):
        c = chr(i)
        t[i] = _ALPHABET.index(c) if c in _ALPHABET else len(_ALPHABET) + (0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isalpha() else 3)
    return t


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 256, _table()[np.minimum(points, 255)], len(_ALPHABET) + 2)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Bidirectional LSTM over character classes, tag scores, CRF transitions."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN):
        r, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {f"{n}{d}": r.normal(0, s, shape).astype(np.float32) for d in "fb" for n, s, shape in (("x", 0.3, (CLASSES, 4 * h)), ("u", h**-0.5, (h, 4 * h)))}
        for d in "fb":
            self.p[f"x{d}"][:, h : 2 * h] += 1.0  # forget gate
        self.p |= {"o": r.normal(0, 0.2, (2 * h, len(TAGS))).astype(np.float32), "e": np.zeros(len(TAGS), np.float32), "t": np.zeros((len(TAGS), len(TAGS)), np.float32), "s": np.zeros(len(TAGS), np.float32)}
        self.block = np.zeros((len(TAGS), len(TAGS)), np.float32)  # an I goes on from its own B or I alone
        for j, tag in enumerate(TAGS):
            if tag[0] == "I":
                for i, before in enumerate(TAGS):
                    if before[1:] != tag[1:]:
                        self.block[i, j] = -1e4
        self.start_block = np.array([-1e4 if t[0] == "I" else 0 for t in TAGS], np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States over x (n, T), backwards for d = "b"; with keep, what backpropagation needs."""
        n, T = x.shape
        h = self.h
        c, s = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, kept = np.empty((n, T, h), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            z = self.p[f"x{d}"][x[:, t]] + s @ self.p[f"u{d}"]
            gates, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            before, came = c, s
            c = gates[:, h : 2 * h] * c + gates[:, :h] * g
            tc = np.tanh(c)
            s = gates[:, 2 * h :] * tc
            out[:, t] = s
            if keep:
                kept.append((t, came, before, gates, g, tc))
        return out, kept

    def scores(self, x: np.ndarray, keep: bool = False):
        f, kf = self._run(x, "f", keep)
        b, kb = self._run(x, "b", keep)
        both = np.concatenate([f, b], axis=2)
        y = both @ self.p["o"] + self.p["e"]
        return (y, both, kf, kb) if keep else y

    def _chain(self):
        return (self.p["t"] + self.block).astype(np.float64), (self.p["s"] + self.start_block).astype(np.float64)

    def marginals(self, y: np.ndarray, mask: np.ndarray):
        """Forward-backward: tag posteriors (n, T, K), log partition (n,), summed transition posteriors."""
        n, T, K = y.shape
        A, start = self._chain()
        E = np.exp(A)
        y = y.astype(np.float64)
        a, scale = np.empty((n, T, K)), np.empty((n, T))
        top = y.max(axis=2, keepdims=True)
        ey = np.exp(y - top)
        v = np.exp(start) * ey[:, 0]
        for t in range(T):
            if t:
                v = np.where(mask[:, t, None], (a[:, t - 1] @ E) * ey[:, t], a[:, t - 1])
            scale[:, t] = v.sum(axis=1)
            a[:, t] = v / scale[:, t, None]
        b = np.ones((n, K))
        post, pairs = np.empty((n, T, K)), np.zeros((K, K))
        for t in range(T - 1, -1, -1):
            q = a[:, t] * b
            post[:, t] = q / q.sum(axis=1, keepdims=True)
            if t:
                m = mask[:, t, None]
                w = ey[:, t] * b
                pr = a[:, t - 1, :, None] * E * w[:, None, :]
                pr /= np.maximum(pr.sum(axis=(1, 2), keepdims=True), 1e-300)
                pairs += (pr * m[:, :, None]).sum(axis=0)
                nb = w @ E.T
                b = np.where(m, nb / nb.sum(axis=1, keepdims=True), b)
        z = (np.log(scale) * mask + top[:, :, 0] * mask).sum(axis=1)
        return post, z, pairs

    def viterbi(self, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
        n, T, _ = y.shape
        A, start = self._chain()
        v = start + y[:, 0]
        back = []
        for t in range(1, T):
            s = v[:, :, None] + A
            best = s.argmax(axis=1)
            step = np.take_along_axis(s, best[:, None], 1)[:, 0] + y[:, t]
            m = mask[:, t, None]
            back.append(np.where(m, best, np.arange(len(TAGS))))
            v = np.where(m, step, v)
        out = np.empty((n, T), np.int64)
        out[:, -1] = v.argmax(axis=1)
        for t in range(T - 1, 0, -1):
            out[:, t - 1] = np.take_along_axis(back[t - 1], out[:, t, None], 1)[:, 0]
        return out

    def fit(self, x: np.ndarray, tags: np.ndarray, mask: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = SEED) -> list[float]:
        """Adam on the CRF's negative log likelihood."""
        r = np.random.default_rng(seed)
        m1, m2, losses = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, []
        for step in range(1, steps + 1):
            k = r.integers(0, len(x), batch)
            loss, grads = self._gradients(x[k], tags[k], mask[k])
            losses.append(loss)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for name, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.99 * m2[name] + 0.01 * g * g
                decay = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
                self.p[name] -= (decay * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def _gradients(self, x, tags, mask):
        n, T = x.shape
        K, h = len(TAGS), self.h
        y, both, kf, kb = self.scores(x, keep=True)
        post, z, pairs = self.marginals(y, mask)
        A, start = self._chain()
        gold = np.eye(K)[tags]
        path = (y * gold).sum(axis=2) * mask
        path[:, 1:] += A[tags[:, :-1], tags[:, 1:]] * mask[:, 1:]
        loss = float((z - path.sum(axis=1) - start[tags[:, 0]]).mean())
        dy = ((post - gold) * mask[:, :, None] / n).astype(np.float32)
        real = np.zeros((K, K))
        np.add.at(real, (tags[:, :-1][mask[:, 1:]], tags[:, 1:][mask[:, 1:]]), 1)
        g = {"o": both.reshape(-1, 2 * h).T @ dy.reshape(-1, K), "e": dy.sum(axis=(0, 1)), "t": ((pairs - real) / n * (self.block > -1)).astype(np.float32), "s": ((post[:, 0] - gold[:, 0]).sum(axis=0) / n * (self.start_block > -1)).astype(np.float32)}
        dboth = dy @ self.p["o"].T
        for d, kept, part in (("f", kf, dboth[:, :, :h]), ("b", kb, dboth[:, :, h:])):
            u, dx, du = self.p[f"u{d}"], np.zeros_like(self.p[f"x{d}"]), np.zeros_like(self.p[f"u{d}"])
            ds, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, came, before, gates, cand, tc in reversed(kept):
                ds = ds + part[:, t]
                i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                dc = dc + ds * o * (1 - tc * tc)
                dz = np.concatenate([dc * cand * i * (1 - i), dc * before * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - cand * cand)], axis=1)
                np.add.at(dx, x[:, t], dz)
                du += came.T @ dz
                ds, dc = dz @ u.T, dc * f
            g[f"x{d}"], g[f"u{d}"] = dx, du
        return loss, g


# ---------------------------------------------------------------- labelled spans
def generate(n: int, seed: int, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[str, list[Span]]]]:
    """Labelled windows: filler of many looks, with personal data of each kind, and numbers and words that look alike but are none."""
    r = np.random.default_rng(seed)
    pick = lambda s: s[int(r.integers(len(s)))]
    digits = lambda k: "".join(str(d) for d in r.integers(0, 10, k))
    between = lambda a, b: int(r.integers(a, b + 1))

    def word() -> str:
        w = pick(("at", "dot", "to", "do", "add", "today")) if r.random() < 0.06 else "".join(pick("abcdefghijklmnopqrstuvwxyzaeiouéüñß") for _ in range(between(1, 10)))
        return pick((w, w, w, w.capitalize(), w.upper() if r.random() < 0.2 else w)) + pick(("", "", "", "", "", "", ".", ",", "%%%", "\n", " |", ":", ";"))

    def name(least: int = 2) -> str:
        return "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(between(least, 9)))

    def email() -> str:
        local = pick((name(), name().capitalize())) + pick(("", ".", "_", "-", "+", "")) + pick(("", name(), digits(2)))
        labels = [name() + pick(("", "", digits(1), "-" + name())), *pick((("example", "com"), ("com",), ("org",), ("net",), ("co", "uk"), ("de",), ("mail", "io")))]
        sign = pick(("@", " @ ", " at ", " at ", "[at]", " [at] ", "(at)", " (at) ", "{at}", "<at>", " AT ", " (AT) "))
        dot = pick((".", ".", " dot ", " dot ", "[dot]", " [dot] ", "(dot)", " (dot) ", "[.]", " . ", " DOT "))
        return local + sign + dot.join(labels) if r.random() < 0.8 else f"{local}@{'.'.join(labels)}"

    def ip() -> str:
        return pick((".", ".", "[.]", "[.]", "(.)", " . ", "[dot]", " dot ")).join(str(int(x)) for x in r.integers(0, 256, 4))

    def card() -> str:
        size = pick((16, 16, 16, 15, 13))
        body = digits(size - 1)
        s = body + next(str(d) for d in range(10) if luhn(body + str(d)))
        parts = [s[i : i + 4] for i in range(0, size, 4)] if size != 15 else [s[:4], s[4:10], s[10:]]
        return pick((s, " ".join(parts), "-".join(parts), ".".join(parts), "  ".join(parts), " - ".join(parts)))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+{pick('123456789')} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"00{digits(2)} {a} {b} {c}", f"0{digits(2)} {c} {digits(4)}", f"0{digits(3)}/{digits(6)}", f"0{digits(3)}-{digits(7)}", f"+1{a}{b}{c}"))

    def other() -> str:
        code = "".join(pick("0123456789abcdef") for _ in range(between(12, 40)))
        return pick((
            digits(between(1, 9)), digits(between(9, 22)), code, f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(2)}", f"{digits(2)}.{digits(1)}.{digits(1)}",
            f"({digits(between(1, 5))})", f"{digits(3)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"meet at {name()}", f"meet at {name()}. {name().capitalize()}", f"x @ {digits(2)}", f"@{name()}",
            f"dot {name()} at", f'token = "{code}"', f"{digits(2)}.{digits(2)}.{digits(4)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"https://{name()}.{pick(('com', 'org'))}/{name()}/{digits(4)}",
            f"{name()}.{name()}", f"{digits(3)}.{digits(2)} {pick(('kg', 'eur', '%'))}", f"{name()} dot {name()}", f"{pick(('look', 'stay', 'arrive'))} at {name()} at {digits(2)}:{digits(2)}", f"[{digits(between(1, 3))}]", f"{digits(2)} {digits(2)}", f"No. {digits(between(4, 8))}",
        ))

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    X, Y, M, texts = np.full((n, width), CLASSES - 1, np.int64), np.zeros((n, width), np.int64), np.zeros((n, width), bool), []
    for row in range(n):
        text, spans = "", []
        while len(text) < width:
            what = r.random()
            text += " " * bool(text and text[-1] != "\n")
            if what < 0.16:
                kind = pick(KINDS)
                s = make[kind]()
                opened = pick(("", "", "", "", "(", '"', "<", "tel:", "mail: "))
                if len(text) + len(opened) + len(s) > width:
                    break
                text += opened
                spans.append((kind, len(text), len(text) + len(s)))
                text += s + pick(("", "", "", ".", ",", ";", ")", '"', "\n"))
            else:
                text += other() if what < 0.3 else word()
        text = text[:width]
        X[row, : len(text)], M[row, : len(text)] = classes(text), True
        for kind, a, b in spans:
            Y[row, a], Y[row, a + 1 : b] = TAGS.index(f"B-{kind}"), TAGS.index(f"I-{kind}")
        texts.append((text, spans))
    return X, Y, M, texts


@functools.lru_cache(maxsize=1)
def trained() -> Tagger:
    x, tags, mask, _ = generate(EXAMPLES, SEED)
    model = Tagger()
    model.fit(x, tags, mask)
    return model


# ---------------------------------------------------------------- decoding
_AT = r"(?: ?@ ?| ?[\[({<] ?at ?[\])}>] ?| at )"
_DOT = r"(?: ?\. ?| ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot )"
_SPELLED = re.compile(rf"(?i)(?=({_AT}[A-Z0-9-]+{_DOT}[A-Z0-9-]))")
_SOUND = {
    "email": re.compile(rf"(?i)[A-Z0-9._%+-]+{_AT}[A-Z0-9-]+(?:{_DOT}[A-Z0-9-]+)+"),
    "ip": re.compile(rf"(?i)[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}"),
    "card": re.compile(r"[0-9](?:[ .-]{0,3}[0-9]){11,18}"),
    "phone": re.compile(r"[+(]{0,2}[0-9][ ()./-]{0,3}(?:[0-9][ ()./-]{0,3}){7,13}[0-9]"),
}


def _sound(kind: str, s: str) -> bool:
    """What a reading must be, whatever its score: an address has one at and dots between names, an IP four bytes, a card 12 to
    19 digits passing Luhn, a telephone number 9 to 15 digits with some separator or sign among them."""
    if not _SOUND[kind].fullmatch(s):
        return False
    digits = "".join(_DIGITS.findall(s))
    if kind == "ip":
        return all(int(p) <= 255 for p in _DIGITS.findall(s))
    if kind == "card":
        return luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15 and digits != s


def windows(text: str) -> list[tuple[int, int]]:
    """Those of the overlapping windows (starts are multiples of STRIDE) that hold what every reported span holds."""
    starts: set[int] = set()
    for a, b in [*((m.start(), m.end()) for m in _MARK.finditer(text)), *(m.span(1) for m in _SPELLED.finditer(text))]:
        starts.update(range(max(0, b - WINDOW + STRIDE - 1) // STRIDE, a // STRIDE + 1))
    return [(k * STRIDE, min(k * STRIDE + WINDOW, len(text))) for k in sorted(starts)]


def all_windows(text: str) -> list[tuple[int, int]]:
    return [(a, min(a + WINDOW, len(text))) for a in range(0, len(text), STRIDE)]


_MARK = re.compile(r"[0-9@]")


def reconcile(readings: list[tuple[float, Span]]) -> list[Span]:
    """The set of readings without overlap that has the largest total score (weighted interval scheduling)."""
    best_of: dict[Span, float] = {}
    for score, span in readings:
        best_of[span] = max(score, best_of.get(span, 0.0))
    ordered = sorted(best_of, key=lambda s: (s[2], s[1], KINDS.index(s[0])))
    ends = [s[2] for s in ordered]
    total, taken = [0.0], []
    for i, s in enumerate(ordered):
        j = int(np.searchsorted(ends[:i], s[1], "right"))
        gain = best_of[s] * (s[2] - s[1]) + total[j]
        taken.append((gain > total[-1], j))
        total.append(max(gain, total[-1]))
    out, i = [], len(ordered)
    while i:
        use, j = taken[i - 1]
        if use:
            out.append(ordered[i - 1])
        i = j if use else i - 1
    return out[::-1]


def model_spans(texts: list[str], model: Tagger, choose=windows) -> list[list[Span]]:
    """Spans that the model reads in each text."""
    where = [(k, a, b) for k, text in enumerate(texts) for a, b in choose(text)]
    readings: list[list] = [[] for _ in texts]
    codes: dict[int, np.ndarray] = {}
    for at in range(0, len(where), DECODED):
        some = where[at : at + DECODED]
        x, mask = np.full((len(some), WINDOW), CLASSES - 1, np.int64), np.zeros((len(some), WINDOW), bool)
        for row, (k, a, b) in enumerate(some):
            if k not in codes:
                codes = {k: classes(texts[k])}
            x[row, : b - a], mask[row, : b - a] = codes[k][a:b], True
        y = model.scores(x)
        tags = model.viterbi(y, mask)
        hit = np.flatnonzero(((tags > 0) & mask).any(axis=1))
        if not len(hit):
            continue
        post, _, _ = model.marginals(y[hit], mask[hit])
        for i, row in enumerate(hit.tolist()):
            k, a, b = some[row]
            own = tags[row, : b - a]
            t = 0
            while t < b - a:
                if own[t] == 0:
                    t += 1
                    continue
                e = t + 1
                while e < b - a and own[e] and own[e] % 2 == 0:  # I tags are even
                    e += 1
                kind = KINDS[(own[t] - 1) // 2]
                cut = (t == 0 and a > 0) or (e == b - a and b < len(texts[k]))
                score = float(np.take_along_axis(post[i, t:e], own[t:e, None], 1).mean())
                if not cut and score >= LEAST and _sound(kind, texts[k][a + t : a + e]):
                    readings[k].append((score, (kind, a + t, a + e)))
                t = e
    return [reconcile(r) for r in readings]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """Per document: counts of base matches, the digest of their spans, and all spans, the model's included.

    The model adds a span only where it overlaps no base span. A map without exchange. Null and empty texts have no spans.
    Rows that repeat stay rows of their own; null doc_ids stay null; extra columns are ignored; an empty table gives no rows.
    ``model`` defaults to the one trained here (some 4,000 parameters, sent with the tasks)."""
    model = model or trained()

    def run(batch):
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        rows = []
        for doc_id, text, found in zip(ids, texts, model_spans(texts, model), strict=True):
            base = base_spans(text)
            more = [s for s in found if not any(s[1] < b and a < s[2] for _, a, b in base)]
            n = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((doc_id, *n, digest(base, KINDS), joined(base + more, KINDS), len(more)))
        types = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return common.map_batches(common.only(docs, doc_id="long", text="string"), run, SCHEMA)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, one row each; nulls, repeats, extra columns and empty tables as in ``find_pii``."""
    return find_pii(common.table(spark, sf_dir, "documents"))
