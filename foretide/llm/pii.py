"""Personal data by fixed patterns and by a linear-chain conditional random field over word shapes.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers (leftmost, non-overlapping per kind, in
time linear in the text). The random field adds what patterns of that strictness miss: secrets (with letters only after
a word such as "password="), identity numbers and phone numbers without a country code. It reads every word of every text. A
word's features are its shape (runs of character classes), its length, its number of digits and runs, whether it is one
of a few cue words, and the shapes, digits and cues of the words next to it. The field is trained by gradient ascent of
the conditional likelihood on the small labelled table `labelled_examples`, and decoded by Viterbi in numpy batches: each
text is cut every `CORE` words, each part decoded with `MARGIN` words around it. Of
a decoded span, what a pattern's span covers is taken off. Names of persons and places are not looked for.

Rows: a null or empty text has no spans; repeated rows and ids are scanned each on its own; very long texts and words
are scanned whole. An empty table gives no rows; extra columns are ignored (`redact` keeps them).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretide.llm.common import text_batches

BASE_KINDS = ("email", "ip", "card", "phone")
MODEL_KINDS = ("secret", "ident", "tel")
KINDS = BASE_KINDS + MODEL_KINDS
RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
#: A match can't begin inside a run of digits: the run's first digit has the same rest.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost match begins where the run of local characters before an @ begins, or at the end of the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[::-1][::2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the patterns' spans, by start, then kind."""
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and _luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], RANK[s[2]], s[1]))


# ---- the conditional random field ----

#: Words decoded at once, and so many more on each side.
CORE, MARGIN = 48, 8
STATES = ("O", *(f"{p}-{k}" for k in MODEL_KINDS for p in "BI"))
N_SHAPES, N_CUES = 512, 5
#: Words that announce a secret, an identity number or a phone number.
CUES = {
    **dict.fromkeys("password passwd pwd passwort kennwort contraseña clave token secret geheimnis key apikey api_key access_key secret_key auth bearer".split(), 1),
    **dict.fromkeys("id ssn iban dni nif nie passport ausweis konto account".split(), 2),
    **dict.fromkeys("tel telephone telefon teléfono téléphone phone call mobile mobil móvil fax".split(), 3),
}
_LETTERS = re.compile(r"[^\W\d]*")
_WORD = re.compile(r"[^ \t-\r]+")


class Classes(dict):
    """Code point -> its class: a, A, 0 for ASCII, a for other letters, # for other signs beyond ASCII, else itself."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        self[c] = "0" if x in "0123456789" else ("A" if "A" <= x <= "Z" else "a") if x.isalpha() else x if c < 128 else "#"
        return self[c]


_CLASS = Classes()
_RUN = re.compile(r"(.)\1+", re.S)
_EDGE = "\"'“”‘’«»,;:.!?()[]{}<>|*#$%&"


def cue(word: str) -> int:
    """What a word announces (0: nothing), 4 for a value behind an equals sign or colon of something else."""
    core = word.lstrip(_EDGE)
    head = _LETTERS.match(core).group()
    found = CUES.get(head.lower(), 0)
    after = core[len(head) : len(head) + 1]
    return found if not after or after in "=:.,;\"" else 4 * ("=" in core)


class Shapes(dict):
    """Word -> features: shape, length, digits, runs, cue, each a small number."""

    def __missing__(self, word: str) -> tuple[int, int, int, int, int]:
        classes = word.translate(_CLASS)
        runs = _RUN.sub(r"\1", classes)
        n, digits = len(word), classes.count("0")
        shape = int.from_bytes(hashlib.blake2b(runs.encode(), digest_size=4).digest(), "little") % N_SHAPES
        value = (shape, min(n, 15) if n < 16 else min(15 + n // 16, 19), min(digits, 15), min(len(runs), 15), cue(word))
        if len(self) > 200_000:
            self.clear()
        if n <= 64:
            self[word] = value
        return value


#: Tables of features: (offset of the word, which of its features, size).
FEATURES = ((0, 0, N_SHAPES), (0, 1, 20), (0, 2, 16), (0, 3, 16), (0, 4, N_CUES), (-1, 0, N_SHAPES), (-1, 2, 16), (-1, 4, N_CUES), (-2, 4, N_CUES), (1, 0, N_SHAPES), (1, 2, 16))
#: The feature values of no word.
NO_WORD = (N_SHAPES, 20, 16, 16, N_CUES)


@dataclass
class Field:
    tables: list[np.ndarray]  # of each feature: values and "no word" x states
    move: np.ndarray  # states x states
    first: np.ndarray  # states

    def emit(self, x: np.ndarray) -> np.ndarray:
        """x: segments x words x features -> segments x words x states"""
        return sum(t[x[:, :, i]] for i, t in enumerate(self.tables))


def features(segments: list[list[str]], shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Features of segments, padded to the longest, and their lengths. An index past a table's values stands for no word."""
    sizes = np.asarray([len(s) for s in segments])
    own = np.zeros((len(segments), sizes.max() + 3, len(NO_WORD)), np.int32)
    own[:] = NO_WORD
    for i, s in enumerate(segments):
        own[i, 2 : len(s) + 2] = [shapes[w] for w in s]
    return np.stack([own[:, 2 + at : own.shape[1] - 1 + at, k] for at, k, _ in FEATURES], -1), sizes


def viterbi(emit: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best states (words x rows) of all rows of emit (words x states x rows) at once, word by word."""
    scores = [emit[0] + first[:, None]]
    for x in emit[1:]:
        scores.append(x + np.stack([(scores[-1] + m[:, None]).max(0) for m in move.T]))
    out = np.zeros((len(emit), emit.shape[2]), np.int8)
    out[-1] = scores[-1].argmax(0)
    for t in range(len(emit) - 1, 0, -1):
        out[t - 1] = (scores[t - 1] + move[:, out[t]]).argmax(0)
    return out


def slots(words: list) -> int:
    """Places of a text: its parts begin with it, and two empty places or more part it from the next, so no text changes another's states."""
    return -(-(len(words) + 2) // CORE) * CORE


class Emissions(dict):
    """Word (bytes) -> row of what it adds to the scores of the states of itself, the word before, the one after the next, and the next; row 0 is no word.

    Words of equal features share a row.
    """

    def __init__(self, field: Field, most: int = 300_000):
        super().__init__()
        self.field, self.most = field, most
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.shapes, self.row_of, self.rows, self.n = Shapes(), {}, np.zeros((1024, 4, len(STATES)), np.float32), 0
        self._row(NO_WORD)
        self.rows[0, 0, 1:] = -1e6

    def _row(self, values: tuple[int, ...]) -> int:
        if values not in self.row_of:
            if self.n == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for (at, k, _), table in zip(FEATURES, self.field.tables):
                self.rows[self.n, at] += table[values[k]]  # a word's offset from the one that reads it, -2 to 1
            self.row_of[values] = self.n
            self.n += 1
        return self.row_of[values]

    def __missing__(self, word: bytes) -> int:
        # words of ASCII letters in lower case are told apart by length and cue only
        plain = word.isalpha() and word.islower()
        found = self[word] = self._row(self.shapes[word.decode()] if not plain else (*self.shapes["a" * len(word)][:4], CUES.get(word.decode(), 0)))
        return found

    def states(self, split: list[list[bytes]]) -> np.ndarray:
        """The best states of the words of all texts, end to end, each text filled up with zeros to `slots` words."""
        if len(self) > self.most:
            self.clear()
        flat = np.zeros(sum(map(slots, split)), np.int64)
        at = 0
        for words in split:
            flat[at : at + len(words)] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            at += slots(words)
        n = -(-len(flat) // CORE)
        padded = np.zeros(n * CORE + 2 * MARGIN + 3, np.int64)
        padded[MARGIN + 2 : MARGIN + 2 + len(flat)] = flat
        out, rows = np.zeros((n, CORE), np.int8), 1024
        first, move = self.field.first.astype(np.float32), self.field.move.astype(np.float32)
        for start in range(0, n, rows):
            k = min(rows, n - start)
            part = padded[start * CORE : (start + k) * CORE + 2 * MARGIN + 3]
            emit = np.ascontiguousarray(sum(self.rows[part[2 + at : len(part) - 1 + at], at] for at in (-2, -1, 0, 1)).T)
            # word t of the row r is the word r * CORE + t
            parts = np.lib.stride_tricks.as_strided(emit, (CORE + 2 * MARGIN, len(STATES), k), (emit.strides[1], emit.strides[0], CORE * emit.strides[1]), writeable=False)
            out[start : start + k] = viterbi(parts, first, move)[MARGIN : MARGIN + CORE].T
        out = out.ravel()
        return out[: len(flat)]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def likelihood(field: Field, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Minus the conditional log-likelihood of states y of padded segments, and its gradient by forward-backward: tables, move, first."""
    live, rows, n_t = np.arange(x.shape[1])[None] < sizes[:, None], np.arange(len(x)), x.shape[1]
    emit = field.emit(x)
    fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
    fwd[:, 0] = emit[:, 0] + field.first
    for t in range(1, n_t):
        fwd[:, t] = np.where(live[:, t, None], _lse(fwd[:, t - 1, :, None] + field.move, 1) + emit[:, t], fwd[:, t - 1])
    for t in range(n_t - 2, -1, -1):
        bwd[:, t] = np.where(live[:, t + 1, None], _lse(field.move + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2), 0)
    z = _lse(fwd[:, -1], 1)
    own = (np.take_along_axis(emit, y[:, :, None], 2)[..., 0] * live).sum(1) + field.first[y[:, 0]] + (field.move[y[:, :-1], y[:, 1:]] * live[:, 1:]).sum(1)
    near = np.exp(fwd + bwd - z[:, None, None]) * live[..., None]
    near[rows[:, None], np.arange(n_t), y] -= live
    grads = []
    for i, table in enumerate(field.tables):
        g = np.zeros_like(table)
        np.add.at(g, x[:, :, i].ravel(), near.reshape(-1, near.shape[2]))
        grads.append(g)
    g = np.zeros_like(field.move)
    for t in range(1, n_t):
        on = live[:, t]
        g += np.exp(fwd[on, t - 1, :, None] + field.move + (emit[on, t] + bwd[on, t])[:, None, :] - z[on, None, None]).sum(0)
        np.add.at(g, (y[on, t - 1], y[on, t]), -1)
    return float((z - own).sum()), [*grads, g, near[:, 0].sum(0)]


def train(examples: list[tuple[str, list[tuple[int, int, str]]]], steps: int = 70, decay: float = 0.01) -> Field:
    """Adam on the conditional log-likelihood, over all examples at once."""
    shapes, n_s = Shapes(), len(STATES)
    words = [[(m.start(), m.end()) for m in _WORD.finditer(t)] for t, _ in examples]
    x, sizes = features([[t[a:b] for a, b in w] for (t, _), w in zip(examples, words)], shapes)
    y = np.zeros(x.shape[:2], np.int64)
    for i, ((_, spans), w) in enumerate(zip(examples, words)):
        for a, b, kind in spans:
            hit = [j for j, (c, d) in enumerate(w) if c < b and a < d]
            for j in hit:
                y[i, j] = STATES.index(("B-" if j == hit[0] else "I-") + kind)
    field = Field([np.zeros((size + 1, n_s)) for *_, size in FEATURES], np.zeros((n_s, n_s)), np.zeros(n_s))
    params = [*field.tables, field.move, field.first]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        _, grads = likelihood(field, x, sizes, y)
        for p, g, mm, vv in zip(params, grads, m, v):
            g = g + decay * p
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            p -= 0.2 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    # an inside state follows its own kind only
    for j, s in enumerate(STATES):
        if s[0] == "I":
            field.first[j] = -1e6
            for i, r in enumerate(STATES):
                if r[1:] != s[1:]:
                    field.move[i, j] = -1e6
    return field


def labelled_examples(n: int = 1000, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled table: n short texts, by rule from a seed; half hold no personal data, but digits, cue words or odd shapes."""
    r = random.Random(seed)
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k)) + dig(2)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "ti", "es", "en", "eau", "ung", "ción", "é", "ß", "que"]) for _ in range(r.randint(1, 5)))

    def plain(k: int) -> str:
        ws = [word() for _ in range(k)]
        ws = [w.capitalize() if r.random() < 0.15 else w.upper() if r.random() < 0.05 else w for w in ws]
        ws = [r.choice(odd)() if r.random() < 0.08 else w for w in ws]
        return " ".join(w + r.choice(["", "", "", "", ",", ".", "|" * (r.random() < 0.1), "!!", r.choice("*#%$&~@+=/^-") * 3]) for w in ws)

    cues = ["the key", "a token of", "secret", "Password", "her phone", "call", "Account", "key:", "tokens", "an id", "tel.", "Telefon", "clave", "passport", "keys"]
    odd = [
        lambda: r.choice(["https://", "http://", "see https://", "www."]) + ".".join(word() for _ in range(r.randint(2, 4))) + r.choice(["", "/", "/" + word(), f"/{word()}/{dig(2)}", f"/{word()}/{dig(2)}/{word()}", f"/{word()}?{word()}={dig(2)}", f"/{word()}.html"]), lambda: f"{word()}{word().capitalize()}()", lambda: f"{word()}_{word()}", lambda: f"{word()}={word()}", lambda: f"{word()}-{word()}-{word()}",
        lambda: f"<{word()}>", lambda: f"l'{word()}", lambda: f"«{word()}»", lambda: r.choice(["I", "a", "A", "é", "—", "|", "=", ":", "...", "[1]", "&", "日本語", "привет", "II.", "U.S.", "e.g.", "don't", "==", "<|user|>"]), lambda: r.choice(cues) + " " + word(),
        lambda: "=" * r.randint(3, 30), lambda: f"{word()}@{word()}", lambda: f"{word()}.{word()}.{word()}", lambda: word() * 3, lambda: word().upper() + word().upper(),
    ]

    secret = lambda: r.choice([lambda: hexes(40), lambda: hexes(32), lambda: hexes(64), lambda: mixed(30), lambda: "sk_live_" + mixed(22), lambda: "AKIA" + mixed(14).upper(), lambda: hexes(40).upper(), lambda: f"{word()}{word()}", lambda: f"{word()}_{word()}{r.choice(['', '!', '#'])}", lambda: f"{word().capitalize()}{dig(2)}{r.choice('!#$%')}"])()
    ident = lambda: r.choice([lambda: f"{dig(3)}-{dig(2)}-{dig(4)}", lambda: f"DE{dig(2)} {dig(4)} {dig(4)} {dig(4)} {dig(4)} {dig(2)}", lambda: f"{r.choice(['FR', 'ES', 'DE', 'GB'])}{dig(20)}", lambda: f"{dig(8)}{r.choice('ABCDEFGHJK')}"])()
    tel = lambda: r.choice([lambda: f"({dig(3)}) {dig(3)}-{dig(4)}", lambda: f"{dig(3)}-{dig(3)}-{dig(4)}", lambda: f"{dig(3)}.{dig(3)}.{dig(4)}", lambda: f"0{dig(3)} {dig(6)}", lambda: f"0{dig(1)} {dig(2)} {dig(2)} {dig(2)} {dig(2)}"])()
    other = lambda: r.choice([lambda: "4.0", lambda: "2.0", "3", dig(1), dig(2), str(r.randint(1900, 2099)), f"{dig(1)}.{dig(2)}", f"{dig(2)}%", f"v{dig(1)}.{dig(1)}.{dig(2)}", f"{dig(3)},{dig(3)}", f"({dig(2)})", f"{dig(2)}:{dig(2)}", f"{r.randint(1900, 2099)}-{dig(2)}-{dig(2)}", f"${dig(3)}", f"{dig(2)}/{dig(2)}/{dig(4)}", f"{word()}{dig(1)}", f"{dig(16)}", f"{dig(4)} {dig(4)} {dig(4)} {dig(4)}", f"{dig(2)}.{dig(3)}.{dig(2)}.{dig(3)}", f"{word()}.{dig(2)}@mail{dig(1)}.example.com", f"+{dig(1)} ({dig(3)}) {dig(3)}-{dig(4)}", f"#{dig(4)}", f"{dig(5)}", f"{dig(6)}", f"{dig(1)}th"])
    out = []
    for i in range(n):
        kind = r.choice(MODEL_KINDS) if i % 2 else None
        made = {"secret": secret, "ident": ident, "tel": tel}[kind]() if kind else other()
        made = made() if callable(made) else made
        before, after = plain(r.randint(0, 6)), plain(r.randint(0, 6))
        cue = {"secret": ["token = ", "key: ", "password=", "password=", "token=", "secret=", 'secret = "', 'token = "', 'TOKEN = "', "password: ", "api_key=", "passwort=", "clave="] + [""] * (len(made) > 18 and any(x.isdigit() for x in made)), "ident": ["ID ", "no. ", "", ""], "tel": ["tel. ", "call ", "", ""], None: ["", "", "", "version ", "License, Version ", "CC BY-NC ", "page ", "key ", "call ", "id "]}[kind]
        c = r.choice(cue)
        text = (before + " " if before else "") + c
        start = len(text)
        text += made
        end = len(text)
        text += ('"' if c.endswith('"') else r.choice(["", "", ".", ",", "!!"])) + (" " + after if after else "")
        out.append((text, [(start, end, kind)] if kind else []))
    return out


def model_spans(texts: list[str], known: Emissions) -> list[list[tuple[int, int, str]]]:
    """What the field finds in each text: start, end, kind."""
    split = [t.encode().split() for t in texts]
    states, out, at = known.states(split), [], 0
    for text, words in zip(texts, split):
        best = states[at : at + len(words)]
        at += slots(words)
        out.append([])
        if not best.any():
            continue
        place = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        j = 0
        for j in np.flatnonzero(best).tolist():
            kind = STATES[best[j]][2:]
            if STATES[best[j]][0] == "I" and j and STATES[best[j - 1]][2:] == kind:
                continue
            k = j + 1
            while k < len(words) and STATES[best[k]] == "I-" + kind:
                k += 1
            a, b = place[j][0], place[k - 1][1]
            if kind == "secret" and (m := re.search(r"[=:]", text[a:b])) and m.end() < b - a:
                a += m.end()
            while a < b and text[a] in _EDGE.replace("(", "") + "=":
                a += 1
            while a < b and text[b - 1] in _EDGE:
                b -= 1
            if a < b:
                out[-1].append((a, b, kind))
    return out


def outside(span: tuple[int, int, str], taken: list[tuple[int, int, str]], text: str, least: int = 3) -> list[tuple[int, int, str]]:
    """The parts of a span that no span of `taken` (by start) covers and that hold `least` letters or digits."""
    (a, b, kind), out = span, []
    for c, d, _ in [*taken, (b, b, "")]:
        if c > a:
            out.append((a, min(b, c), kind))
        a = max(a, d)
    return [(a, b, k) for a, b, k in out if a < b and sum(x.isalnum() for x in text[a:b]) >= least]


def all_spans(texts: list[str], known: Emissions) -> list[tuple[list, list]]:
    """Of each text, the patterns' spans, and those with what the field finds beside them."""
    out = []
    for text, more in zip(texts, model_spans(texts, known)):
        base = base_spans(text)
        more = [p for s in more for p in (outside(s, base, text) if base else [s])]
        out.append((base, sorted(base + more, key=lambda s: (s[0], RANK[s[2]], s[1])) if more else base))
    return out


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_ident long, n_tel long"


def find_pii(docs: DataFrame, examples: list | None = None) -> DataFrame:
    """docs (doc_id, text) -> counts by kind of the patterns, their digest, all spans, and counts by kind of the field's."""
    field = train(examples or labelled_examples())

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = Emissions(field)
        for batch in text_batches(batches):
            each = all_spans([t or "" for t in batch.column("text").to_pylist()], known)
            columns = [batch.column("doc_id").cast(pa.int64())]
            columns += [pa.array([sum(s[2] == k for s in base) for base, _ in each], pa.int64()) for k in BASE_KINDS]
            columns += [pa.array([hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in each]), pa.array([_join(spans) for _, spans in each], pa.string())]
            columns += [pa.array([sum(s[2] == k for s in spans) for _, spans in each], pa.int64()) for k in MODEL_KINDS]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FOUND.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(found, FOUND)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans, overlapping ones as one, replaced by the first one's kind in capitals and brackets."""
    out, end, start = [], 0, None
    for a, b, kind in [*spans, (len(text) + 1, len(text) + 1, "")]:
        if start is not None and a >= stop:
            out += [text[end:start], f"[{name.upper()}]"]
            end, start = stop, None
        if start is None:
            start, stop, name = a, b, kind
        stop = max(stop, b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, examples: list | None = None) -> DataFrame:
    """docs with all found spans of text replaced by their kinds; other columns stay."""
    field, names = train(examples or labelled_examples()), docs.columns

    def cleaned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = Emissions(field)
        for batch in text_batches(batches):
            texts = batch.column("text").to_pylist()
            each = all_spans([t or "" for t in texts], known)
            new = pa.array([redacted(t, spans) if spans else t for t, (_, spans) in zip(texts, each)], batch.column("text").type)
            yield pa.RecordBatch.from_arrays([new if c == "text" else batch.column(c) for c in names], schema=batch.schema)

    return docs.mapInArrow(cleaned, docs.schema)
