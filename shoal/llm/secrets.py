"""Secrets in text: fixed patterns, and values whose guess cost is that of a random password.

The patterns (kinds assign, access and hex) are what any scan must report. On top, a value in a
credential context (a word such as password, passwd, pwd, secret, token, key, login or bearer, then
a separator, "is", or an opening quote; after bearer a blank will do), whatever its length, is cut
into segments by dynamic programming: words of a small list, dates, repeats, keyboard walks,
sequences, and brute force in between, over the kinds of characters that the value has. The cheapest
segmentation's guesses decide: from ``bits`` on the value is reported as kind cost. Letters alone are
judged after = or : only; elsewhere they are prose.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.words import slices

KINDS = ("assign", "access", "hex", "cost")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Where a credential may follow: the context, then its value up to white space, a quote, a bracket, a comma or a semicolon.
CONTEXT = re.compile(r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key"""
                     r"""|credentials?|login|bearer|authorization|auth)["'\]]{0,2}"""
                     r"""(?:\x20{0,8}(?P<sign>:=|=>|[:=])\x20{0,8}|\x20{1,8}is\x20{1,8}|\x20{1,8}(?=["'`])|(?<=[bB][eE][aA][rR][eE][rR])\x20{1,8})["'`]?(?P<value>[^\s"'`,;<>()\[\]{}]{8,})""", re.ASCII)
HINTS = re.compile(rb"pass|pwd|secret|token|key|credential|login|bearer|auth")

#: Words that guessers try first, most likely first.
WORDS = ("password pass admin user root login welcome letmein qwerty monkey dragon master hello secret test guest default change "
         "changeme example sample demo dummy placeholder value string text name none null true false your here enter token key api "
         "account access server system public private love sunshine princess football baseball shadow summer winter spring "
         "autumn january february march april june july august september october november december monday friday company "
         "super trust super hunter ranger thomas michael jordan daniel andrew robert charlie jessica ashley nicole").split()
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "1qaz2wsx3edc4rfv5tgb6yhn7ujm", "azertyuiop", "qwertzuiop")
DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:19|20)?\d\d")
LEET = str.maketrans("013457@$!", "oieastasi")
SECRET_BITS = 45.0


def _brute_bits(c: str) -> float:
    """Bits of one unknown character of its kind."""
    return math.log2(10) if c.isdigit() else math.log2(26) if c.isascii() and c.isalpha() else math.log2(33) if c.isascii() else 12.0


def alphabet_bits(value: str):
    """Bits of one unknown character, among all of the kinds of ASCII characters in ``value``."""
    kinds = (any("a" <= c <= "z" for c in value), any("A" <= c <= "Z" for c in value), any("0" <= c <= "9" for c in value),
             any(c.isascii() and not c.isalnum() for c in value))
    bits = math.log2(max(2, sum(n for n, there in zip((26, 26, 10, 33), kinds) if there)))
    return lambda c: bits if c.isascii() else _brute_bits(c)


def _periods(value: str) -> list[list[int]]:
    """For each block size from 1 to 6 and each place, how many characters from there on equal the one a block later."""
    out = []
    for size in range(1, 7):
        run = [0] * (len(value) + 1)
        for i in range(len(value) - size - 1, -1, -1):
            run[i] = run[i + 1] + 1 if value[i] == value[i + size] else 0
        out.append(run)
    return out


def _walks() -> set[str]:
    rows = [r for k in KEYBOARD for r in (k, k[::-1])] + ["abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba", "01234567890", "9876543210"]
    return {r[a:b] for r in rows for a in range(len(r)) for b in range(a + 3, len(r) + 1)}


class GuessCost:
    """Cheapest segmentation of a value into guessable parts; bits add up, one more for each further segment."""

    def __init__(self, words=tuple(WORDS)):
        self.words = {w: math.log2(i + 2) for i, w in enumerate(words)}
        self.longest = max(map(len, self.words), default=0)
        self.walks = _walks()
        self.longest_walk = max(map(len, self.walks))

    def parts(self, value: str, start: int, brute=_brute_bits, periods: list[list[int]] | None = None):
        """(end, kind, bits) of the guessable parts that begin at ``start``; the work does not grow with the value, given its periods."""
        low = value[start:start + max(self.longest, self.longest_walk)].lower()
        plain = low.translate(LEET)
        for end in range(start + 3, min(len(value), start + self.longest) + 1):
            for form, extra in ((low[:end - start], 0.0), (plain[:end - start], 1.5)):
                if form in self.words:
                    yield end, "word", self.words[form] + extra + (0.0 if value[start:end] == form else 1.0)
                    break
        for end in range(start + 3, min(len(value), start + self.longest_walk) + 1):
            if low[:end - start] in self.walks:
                yield end, "walk", 5.0 + math.log2(end - start)
        if m := DATE.match(value, start):
            yield m.end(), "date", 8.0 if m.end() - start == 4 else 15.5
        for size, run in enumerate(periods or _periods(value), 1):  # a block, again and again
            block, end = value[start:start + size], start + size + run[start] // size * size
            if end - start >= max(3, 2 * size):
                yield end, "repeat", sum(map(brute, block)) + math.log2((end - start) / size)

    def __call__(self, value: str, brute=_brute_bits) -> tuple[float, list[tuple[int, int, str]]]:
        """(log2 of the guesses, segments (start, end, kind)) of the cheapest segmentation; ``brute`` gives the bits of one character."""
        n, periods = len(value), _periods(value)
        best: list[tuple[float, int, str]] = [(0.0, -1, "")] + [(math.inf, -1, "")] * n
        for at in range(n):
            cost, _, kind = best[at]
            step = cost + brute(value[at]) + (1.0 if at and kind != "brute" else 0.0)
            if step < best[at + 1][0]:
                best[at + 1] = (step, at, "brute")
            for end, what, bits in self.parts(value, at, brute, periods):
                if cost + bits + (at > 0) < best[end][0]:
                    best[end] = (cost + bits + (at > 0), at, what)
        cuts, at = [], n
        while at > 0:
            _, before, kind = best[at]
            if cuts and kind == "brute" and cuts[-1][2] == "brute":
                cuts[-1] = (before, cuts[-1][1], kind)
            else:
                cuts.append((before, at, kind))
            at = before
        return best[n][0], cuts[::-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns, leftmost first in each kind, without overlap in a kind."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def find_spans(text: str, cost: GuessCost, bits: float = SECRET_BITS) -> tuple[list[tuple[int, int, str]], float]:
    """(all spans by start, then kind as listed; the largest guess bits of a value in credential context)."""
    raw = text.encode()
    hinted = HINTS.search(raw.lower()) is not None
    spans = base_spans(text) if hinted else ([(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
                                             + [(*m.span(), "hex") for m in HEX.finditer(text)])
    most = 0.0
    if hinted:
        for m in CONTEXT.finditer(text):
            value = m["value"].rstrip(".:!?")
            if len(value) < 8 or not (m["sign"] or any(c.isdigit() or not c.isalnum() for c in value)):
                continue  # a plain word after a context word is prose
            guessed = cost(value, alphabet_bits(value))[0]
            most = max(most, guessed)
            if guessed >= bits:
                spans.append((m.start("value"), m.start("value") + len(value), "cost"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))), most


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: float = SECRET_BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_assign, n_access, n_hex, n_cost, base, spans, guess_bits, redacted).

    ``base`` and ``spans`` list kind:start:end (code points, end exclusive) by start, then kind, comma-joined:
    the fixed patterns alone, and with the spans found by guess cost. ``redacted`` is the text with all spans
    replaced, null where there are none. Null and empty texts have no spans; null and repeated ids pass
    through. ``keep`` names further columns to carry; names of the result win over them.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_cost", "base", "spans", "guess_bits", "redacted"]
    carried = [c for c in keep if c not in names]
    moved = [c for c in carried if c != text_col or docs.schema[c].dataType.simpleString() != "string"]  # the text itself travels once

    def task(batches):
        cost = GuessCost()
        for part in slices(batches, "__text"):
            rows = []
            for text in part.column("__text").to_pylist():
                spans, most = find_spans(text or "", cost, bits)
                base = [s for s in spans if s[2] != "cost"]
                count = [sum(s[2] == k for s in spans) for k in KINDS]
                rows.append((*count, written(base), written(spans), most, redacted(text, spans) if spans else None))
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types)), *(part.column(c if c in moved else "__text") for c in carried)], names + carried)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"), *[F.col(f"`{c}`") for c in moved])
    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(task, "doc_id long, n_assign long, n_access long, n_hex long, n_cost long, base string, spans string, "
                                 "guess_bits double, redacted string" + extra)


def digest(spans: str | None) -> str:
    return hashlib.sha256((spans or "").encode()).hexdigest()
