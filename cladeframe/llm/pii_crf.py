"""Personal data by fixed patterns and a linear-chain conditional random field.

Base spans are exact: email, ip, card (Luhn) and phone matches, leftmost and
non-overlapping for each kind, found over the whole text in linear time.

The random field adds spans: secrets (the value, with its key if they are one
token), and emails, cards and phones in forms that the patterns do not know.
Tokens are runs without white space; the features are the word shape of the
whole token (letters ``x``/``X``, digits ``0``, others as they are, runs
collapsed), its length, digit share, changes of class and share of vowels, a
few closed word classes, and the same of its neighbours.  It is trained by
gradient ascent with momentum on a small labelled table, written by rule from
phrases and random values (:func:`training_table`, or any table of the same
form), and decoded by Viterbi in batches: all pieces of a batch go through the
recursion together, one token position at a time.

A piece is a line, cut after the ends of sentences.  Only pieces with a digit,
``@``, ``+``, ``=``, a key word or a spelled-out ``at`` and ``dot`` can hold a
span; that is a constraint of the model, so names and postal addresses in plain
words are out of its reach.  A predicted span is dropped if it covers nothing
beside base spans (for a base kind: no letter or digit), has fewer than six
characters, is a secret of plain words only, or is one of a base kind that
fails that kind's check (Luhn, parts up to 255, number of digits): what the
patterns rule out stays out.

Defined results
---------------
* null or empty text: no spans, the hash of no bytes.
* repeated rows, null ``doc_id``: one output row for each input row.
* a very long text, line or token: linear time and memory in its length.
* extra columns are ignored (kept by :func:`redact`).
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cladeframe.llm.tables import map_text
from cladeframe.llm.textnum import claim

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@+]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the order of start, then of the kinds."""
    if not _HINT.search(text):
        return []
    found = [(s, e, 0) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append((*m.span(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    found.append((*m.span(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


#: Lines of the labelled table as they are; ``token//kind`` marks a span; equal neighbours of one kind join.
FIXED_LINES = """\
the report was sent to ana.lima@mail.example.org//email yesterday evening
please write to bob42@inbox7.example.com//email for more of this
contact: x.y_z+tag@sub.host.example.net//email .
it is ana.7@mail.example.org//email that reads the long line of words which goes on and on
das haus von ben.49@mail1.example.com//email steht am rand der stadt und nicht weit vom see
la lettre de jo.81@mail7.example.com//email au lever du jour
write to jane//email at//email example//email dot//email com//email if you can
reach karl//email (at)//email posteo//email (dot)//email net//email for this
escribe a maria99//email arroba//email correo//email punto//email org//email hoy
we met at the dot on the map
server 10.20.30.40//ip answered with an error
from 192.168.7.12//ip and 172.16.254.3//ip came the same line
paid with 4539578763621486//card in march
number 4716 2210 5188 5662//card was declined
karte 5500-0055-5555-5559//card nicht angenommen
call +1//phone (555)//phone 010-4477//phone after noon
tel. +49//phone 30//phone 901820//phone oder schreiben
llame al +34912345678//phone por la tarde
tel. 030//phone 901//phone 82044//phone oder schreiben
phone: (212)//phone 555-0147//phone until five
this work is licensed under the general public license, version 3.
licensed under the apache license, version 2.0.
released under the mit license in 2019 by the authors
licensed under cc by-nc 4.0.
on 12 may 2021 there were 350 people and 27 dogs
chapter 3 section 4.2 says the value x = 12 is small
the token was a word = and nothing more
the key to this is patience and the secret is time
a password is needed here, said the clerk
he lost the key : it was in the grass
la clave es la paciencia y el secreto = el tiempo
das passwort ist lang und der schlüssel = die zeit
we saw 1,204 of 3,500 items (34%) in 2020-05-17 at 10:45
the price is $45.99 for 2 and 5 for 100
a = b + c and d = 7
version 10.2.1 and build 20210408 of the tool
commit 9f3c2e1 fixed the line in report_2020_v2.pdf
isbn 978-3-16-148410-0 is a book
see https://example.org/a/b?id=8812&page=3 for all of it
sum = 3 + 4 equals 7
room b12, floor 3, gate a7
and + one plus two
see @ the end or # 5
il y a 25 ans et 3 mois
im jahr 1998 gab es 12 davon
en 1975 hubo 8 casos de 40
the code 404 means not found
order 8812736451 was sent on 3.4.2022 to berlin
iPhone and GitHub = two names
| id | 1 | 20 | 300 | total = 321 |
| river | house | 106.15.24.39//ip | over | stone | 8 |
| haus | zeit | 8.150.18.54//ip | Strasse | stadt |
"""
#: What stands before a secret; ``{}`` is where it goes.
SECRET_PHRASES = (
    "token = {}", "api_key = {}", "password : {}", "secret => {}", "passwort = {}", "clave : {}", "contraseña = {}", "mot de passe : {}", "password is {}", "key : {}",
    "password={}", "token:{}", "API_KEY={}", "--token {}", "Authorization: Bearer {}", "export SECRET_KEY={}", "secret {}", "das passwort lautet {}", "pwd: {}", "| token = {} |",
)
_CONTEXT = (
    "the report was printed in full again", "and then it rained over the old house", "le serveur ne repond pas ce matin", "das haus steht am rand der stadt", "la casa esta cerca del rio azul",
    "must be kept in the config", "please do not share this with them", "steht hier noch immer", "est dans le fichier", "no cambia nunca",
)


def random_secret(rnd: random.Random) -> str:
    """A secret of one of several makes, some in quotes."""
    letters, hexes = string.ascii_letters, "0123456789abcdef"
    some = lambda chars, low, high: "".join(rnd.choice(chars) for _ in range(rnd.randint(low, high)))
    value = rnd.choice((
        lambda: some(hexes, 12, 64), lambda: some(hexes.upper(), 16, 48), lambda: some(letters + string.digits, 14, 44), lambda: some(letters + string.digits + "+/", 20, 60) + "==",
        lambda: "-".join(some(hexes, n, n) for n in (8, 4, 4, 4, 12)), lambda: some(string.ascii_lowercase, 4, 8) + some(string.digits, 2, 4) + some("!$%&*", 0, 1),
        lambda: some(letters, 10, 24), lambda: some(string.ascii_lowercase, 2, 4) + "_" + some(letters + string.digits, 16, 40), lambda: some(letters + string.digits + "!@#%&?", 8, 16),
    ))()
    quote = rnd.choice(('"', '"', "'", "", ""))
    return quote + value + quote


def training_table(copies: int = 9, seed: int = 5) -> str:
    """The labelled table: the fixed lines, and every secret phrase with ``copies`` random values in random context."""
    rnd = random.Random(seed)
    lines = FIXED_LINES.splitlines()
    for phrase in SECRET_PHRASES:
        for _ in range(copies):
            before, after = rnd.choice(_CONTEXT), rnd.choice(_CONTEXT)
            said = [t.format(random_secret(rnd)) + rnd.choice(("", "", ".", "!!")) + "//secret" if "{}" in t else t for t in phrase.split(" ")]
            line = " ".join([*before.split(" ")[-rnd.randint(0, 4) :], *said, *after.split(" ")[: rnd.randint(0, 4)]])
            lines.append(line.upper().replace("//SECRET", "//secret") if rnd.random() < 0.1 else line)
    return "\n".join(lines)


LABELS = ("O", *(f"{p}-{k}" for k in (*KINDS, "secret") for p in "BI"))
_KEYS = frozenset("token secret password passwd pwd passwort kennwort clave contraseña key api_key apikey secret_key access_key credential credentials bearer --token passe lautet".split())
_AT, _DOT = frozenset(("at", "(at)", "[at]", "arroba")), frozenset(("dot", "(dot)", "[dot]", "punto", "punkt"))
_CALL = frozenset("tel tel. phone phone: call telefon fon llame".split())
_EDGE = "!$#%*&|.,;:()[]{}<>?"


def shape(token: str) -> str:
    """Classes of the whole token's characters, runs collapsed; four or more changes between letters and digits as one ``~``."""
    out: list[str] = []
    for c in token:
        k = "0" if "0" <= c <= "9" else "x" if c.islower() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return re.sub("[0xX]{5,}", "~", "".join(out))


def token_features(token: str) -> tuple[str, ...]:
    """Features of a token; those of short tokens are kept."""
    return _short_features(token) if len(token) <= 64 else features_of(token)


def features_of(token: str) -> tuple[str, ...]:
    core = token.strip(_EDGE)
    n = len(core)
    inner = core.strip("\"'")
    digits = sum("0" <= c <= "9" for c in inner)
    turns = sum(a.isdigit() != b.isdigit() or a.islower() != b.islower() for a, b in zip(inner, inner[1:]))
    alpha = sum(map(str.isalpha, inner))
    vowels = sum(c in "aeiouyäöüáéíóúàèêAEIOUYÄÖÜ" for c in inner)
    out = [f"s={shape(core)}", f"l={min(n, 40) // 4}", f"d={4 * digits // max(len(inner), 1)}", f"t={min(turns, 12) // 3}"]
    if alpha >= 6 and not digits:
        out.append(f"v={min(4, 10 * vowels // alpha)}")
    low = core.lower()
    if low in _KEYS or low.strip(":=") in _KEYS:
        out.append("key")
    if core in ("=", "=>") or token in ("=", "=>", ":"):
        out.append("equals")
    if inner != core:
        out.append("quoted")
    head, mark, rest = inner.replace(":", "=", 1).partition("=")
    if mark and len(rest) >= 4 and any(head.lower().endswith(k) for k in _KEYS):
        out.append("pair")
        out.append(f"pd={any(map(str.isdigit, rest))}")
    if len(inner) >= 12 and digits and alpha and inner.isalnum():
        out.append("mixed")
    if "@" in core:
        out.append("at")
    for name, words in (("AT", _AT), ("DOT", _DOT), ("CALL", _CALL)):
        if low in words or token.lower() in words:
            out.append(name)
    return tuple(out)


@functools.lru_cache(20_000)
def _short_features(token: str) -> tuple[str, ...]:
    return features_of(token)


def line_features(tokens: list[str]) -> list[list[str]]:
    own = [token_features(t) for t in tokens]
    edge = ("edge",)
    out = []
    for i, f in enumerate(own):
        before, after = (own[i - 1] if i else edge), (own[i + 1] if i + 1 < len(own) else edge)
        out.append(["bias", *f, *("-1" + x for x in before), *("+1" + x for x in after)])
    return out


class RandomField:
    """Weights of features by label and of label pairs."""

    def __init__(self, lines: list[tuple[list[str], list[str]]], steps: int = 150, rate: float = 0.3, decay: float = 1e-3):
        self.labels = LABELS
        n = len(self.labels)
        number: dict[str, int] = {}
        data = []
        for tokens, tags in lines:
            rows = [[number.setdefault(f, len(number)) for f in fs] for fs in line_features(tokens)]
            data.append((rows, [self.labels.index(t) for t in tags]))
        self.number = number
        #: an I label follows a B or I label of its kind; a line starts with O or B.
        self.allowed = np.array([[not b.startswith("I") or a[2:] == b[2:] for b in self.labels] for a in self.labels])
        self.first = np.array([not b.startswith("I") for b in self.labels])
        bar = np.where(self.allowed, 0.0, -1e9)
        self.emit, self.pair = np.zeros((len(number), n)), np.zeros((n, n))
        if not data:
            return
        longest = max(len(r) for r, _ in data)
        live = np.zeros((len(data), longest), bool)
        gold = np.zeros((len(data), longest), np.int64)
        at, feat = [], []
        for i, (rows, tags) in enumerate(data):
            live[i, : len(rows)] = True
            gold[i, : len(rows)] = tags
            for j, r in enumerate(rows):
                at += [i * longest + j] * len(r)
                feat += r
        at, feat = np.array(at), np.array(feat)
        speed_e, speed_p = np.zeros_like(self.emit), np.zeros_like(self.pair)

        def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

        for _ in range(steps):
            score = np.zeros((len(data) * longest, n))
            np.add.at(score, at, self.emit[feat])
            score = score.reshape(len(data), longest, n)
            step = self.pair + bar
            ahead = np.full((len(data), longest, n), -1e9)
            ahead[:, 0] = score[:, 0] + np.where(self.first, 0, -1e9)
            for j in range(1, longest):
                ahead[:, j] = np.where(live[:, j, None], log_sum(ahead[:, j - 1, :, None] + step, 1) + score[:, j], ahead[:, j - 1])
            total = log_sum(ahead[:, -1], 1)
            back = np.zeros((len(data), longest, n))
            for j in range(longest - 2, -1, -1):
                back[:, j] = np.where(live[:, j + 1, None], log_sum(step + (score[:, j + 1] + back[:, j + 1])[:, None, :], 2), 0)
            here = np.where(live[..., None], np.exp(ahead + back - total[:, None, None]), 0)
            want = np.zeros_like(here)
            i, j = np.nonzero(live)
            want[i, j, gold[i, j]] = 1
            grad_e = np.zeros_like(self.emit)
            np.add.at(grad_e, feat, (want - here).reshape(-1, n)[at])
            grad_p = np.zeros_like(self.pair)
            for j in range(1, longest):
                rows = live[:, j]
                both = ahead[rows, j - 1, :, None] + step + (score[rows, j] + back[rows, j])[:, None, :] - total[rows, None, None]
                grad_p -= np.exp(both).sum(0)
                np.add.at(grad_p, (gold[rows, j - 1], gold[rows, j]), 1)
            speed_e = 0.9 * speed_e + grad_e / len(data) - decay * self.emit
            speed_p = 0.9 * speed_p + np.where(self.allowed, grad_p, 0) / len(data) - decay * self.pair
            self.emit += rate * speed_e
            self.pair += rate * speed_p

    def codes(self, tokens: list[str]) -> list[int]:
        """A number for each token's features; 0 is the edge of a piece."""
        if len(self.known) > 200_000:
            self.known.clear()
        out = []
        for token in tokens:
            code = self.known.get(token)
            if code is None:
                features = token_features(token)
                code = self.made.setdefault(features, len(self.made))
                if code == len(self.tables):
                    self.tables.append(self._table(features))
                if len(token) <= 64:
                    self.known[token] = code
            out.append(code)
        return out

    def _table(self, features: tuple[str, ...]) -> np.ndarray:
        """Scores by label that a token gives to itself, to the one behind it and to the one before it."""
        rows = [[self.number.get(p + f) for f in features] for p in ("", "-1", "+1")]
        return np.stack([self.emit[[i for i in r if i is not None]].sum(0) for r in rows])

    def decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The best labels of every line; all lines advance together."""
        n = len(self.labels)
        lens = np.array([len(t) for t in lines])
        starts = np.concatenate([[0], np.cumsum(lens)])
        if not hasattr(self, "known"):
            self.known, self.made, self.tables = {}, {("edge",): 0}, [self._table(("edge",))]
        code = np.array([c for t in lines for c in self.codes(t)], np.int64)
        table = np.stack(self.tables)
        before, after = np.roll(code, 1), np.roll(code, -1)
        before[starts[:-1][lens > 0]] = 0
        after[starts[1:][lens > 0] - 1] = 0
        score = self.emit[self.number["bias"]] + table[code, 0] + table[before, 1] + table[after, 2] if len(code) else np.zeros((0, n))
        order = np.argsort(-lens, kind="stable")  # the lines still running are a prefix
        step = self.pair + np.where(self.allowed, 0.0, -1e9)
        came = np.zeros((starts[-1], n), np.int8)
        best = np.zeros((len(lines), n))
        best[order] = score[starts[order]] + np.where(self.first, 0, -1e9) if len(lines) else 0
        running = order
        for j in range(1, int(lens.max(initial=0))):
            running = running[lens[running] > j]
            ways = best[running][:, :, None] + step
            came[starts[running] + j] = ways.argmax(1)
            best[running] = ways.max(1) + score[starts[running] + j]
        labels = np.zeros(starts[-1], np.int64)
        last = best.argmax(1)
        labels[starts[1:] - 1] = last
        running = order
        for j in range(int(lens.max(initial=0)) - 1, 0, -1):
            on = order[: np.searchsorted(-lens[order], -j, side="left")]  # lines longer than j
            labels[starts[on] + j - 1] = came[starts[on] + j, labels[starts[on] + j]]
        return [labels[a:b] for a, b in zip(starts[:-1], starts[1:])]


def parse_training(table: str) -> list[tuple[list[str], list[str]]]:
    lines = []
    for line in table.splitlines():
        tokens, tags, last = [], [], ""
        for item in line.split():
            token, _, kind = item.rpartition("//")
            if kind not in (*KINDS, "secret"):
                token, kind = item, ""
            tokens.append(token)
            tags.append(f"{'I' if kind == last else 'B'}-{kind}" if kind else "O")
            last = kind
        if tokens:
            lines.append((tokens, tags))
    return lines


@functools.lru_cache(4)
def train(table: str | None = None) -> RandomField:
    return RandomField(parse_training(training_table() if table is None else table))


_TOKEN = re.compile(r"[^\s]+")
_MARK = re.compile(r"[0-9@+=]")
_SAID = ("token", "secret", "passw", "pwd", "kennwort", "contrase", "clave", "credential", "bearer")
_SAID_SO = re.compile(r"api.?key|passe\b|(?<!\w)key\s*[:=]")
_AT_WORD, _DOT_WORD = re.compile(r"\b(?:at|arroba)\b"), re.compile(r"\b(?:dot|punto|punkt)\b")
_PLAIN = re.compile(r"[^\W\d_]?[^\W\d_A-ZÄÖÜ]*")


def triggered(said: str) -> bool:
    """Whether a line or sentence can hold a span: a digit, ``@``, ``+`` or ``=``, a key word, or a spelled-out at before a dot."""
    if _MARK.search(said):
        return True
    low = said.lower()
    if any(word in low for word in _SAID) or ("key" in low or "passe" in low) and _SAID_SO.search(low):
        return True
    at = _AT_WORD.search(low)
    return at is not None and _DOT_WORD.search(low, at.end()) is not None


def pieces(text: str):
    """Tokens (start, end) of every piece that can hold a span."""
    lo = 0
    for line in text.split("\n"):
        if triggered(line):
            held: list[tuple[int, int]] = []
            for m in _TOKEN.finditer(line):
                held.append((m.start() + lo, m.end() + lo))
                if line[m.end() - 1] in ".!?" and m.end() - m.start() > 4:
                    if triggered(line[held[0][0] - lo : m.end()]):
                        yield held
                    held = []
            if held and triggered(line[held[0][0] - lo :]):
                yield held
        lo += len(line) + 1


def all_spans(texts: list[str], field: RandomField) -> list[tuple[list, list]]:
    """(base spans, base and added spans) of every text."""
    base = [base_spans(t) for t in texts]
    lines, places = [], []
    for d, text in enumerate(texts):
        for found in pieces(text):
            lines.append([text[a:b] for a, b in found])
            places.append((d, found))
    extra: dict[int, list] = {}
    for (d, found), labels in zip(places, field.decode(lines) if lines else []):
        i = 0
        while i < len(labels):
            name = LABELS[labels[i]]
            if name == "O":
                i += 1
                continue
            j = i + 1
            while j < len(labels) and LABELS[labels[j]] == "I" + name[1:]:
                j += 1
            start, end = found[i][0], found[j - 1][1]
            text = texts[d]
            while end > start and text[end - 1] in _EDGE:
                end -= 1
            while start < end and text[start] in _EDGE and text[start] != "(":
                start += 1
            extra.setdefault(d, []).append((start, end, name[2:]))
            i = j
    out = []
    for d, spans in enumerate(base):
        more = [
            x for x in extra.get(d, ())
            if x[1] - x[0] >= 6 and plausible(x[2], texts[d][x[0] : x[1]]) and adds(texts[d], x, spans)
        ]
        rank = {k: i for i, k in enumerate((*KINDS, "secret"))}
        out.append((spans, sorted(spans + more, key=lambda x: (x[0], rank[x[2]]))))
    return out


def adds(text: str, found: tuple, spans: list) -> bool:
    """Whether a predicted span covers more than the base spans it touches; for a base kind, a letter or digit more."""
    start, end, kind = found
    for s, e, _ in spans:
        if s >= end:
            break
        if e > start:
            if s > start and (kind == "secret" or any(map(str.isalnum, text[start:s]))):
                return True
            start = max(start, e)
    return start < end and (kind == "secret" or any(map(str.isalnum, text[start:end])))


def plausible(kind: str, said: str) -> bool:
    """Whether a predicted span passes the check of its kind."""
    digits = re.sub(r"[^0-9]", "", said)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        parts = said.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "email":
        words = said.lower().split()
        return len(words) == 1 and "@" in said or 5 <= len(words) <= 9 and words[1] in _AT and words[-2] in _DOT
    return not all(_PLAIN.fullmatch(w) for w in said.split())  # a quote, a digit, a symbol or a capital inside


def written(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _batches(column, size: int = 500_000):
    held, total = [], 0
    for v in column:
        held.append(v.as_py() or "")
        total += len(held[-1])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def find(docs: DataFrame, table: str | None = None) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans for every document row."""
    field = docs.sparkSession.sparkContext.broadcast(train(table))  # some thousand features by label

    def run(batches):
        claim("pii", _short_features.cache_clear)
        for batch in batches:
            counts, hashes, spans = [], [], []
            for texts in _batches(batch.column("text")):
                for base, every in all_spans(texts, field.value):
                    counts.append([sum(k == kind for _, _, k in base) for kind in KINDS])
                    hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
                    spans.append(written(every))
            by_kind = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(by_kind[:, i]) for i in range(len(KINDS))), pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    schema = "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return map_text(docs.select("doc_id", "text"), run, schema)


def mask(text: str, spans: list) -> str:
    """The text with every span replaced by its kind; spans that overlap are masked together."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out.append(text[at:s] + f"[{kind.upper()}]")
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, table: str | None = None) -> DataFrame:
    """``docs`` with all found spans masked in text, and n_chars, if present, counted anew; same columns."""
    field = docs.sparkSession.sparkContext.broadcast(train(table))
    names = docs.columns

    def run(batches):
        claim("pii", _short_features.cache_clear)
        for batch in batches:
            texts = []
            for held in _batches(batch.column("text")):
                texts += [mask(t, every) for t, (_, every) in zip(held, all_spans(held, field.value))]
            old = batch.column("text")
            new = pa.array([t if ok else None for ok, t in zip(old.is_valid().to_pylist(), texts)], pa.string())
            cols = []
            for name in names:
                if name == "text":
                    cols.append(new)
                elif name == "n_chars":
                    cols.append(pa.array([None if t is None else len(t) for t in new.to_pylist()], pa.int64()))
                else:
                    cols.append(batch.column(name))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_text(docs, run, docs.schema)
