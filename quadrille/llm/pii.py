"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it is. Transducers then rewrite the
text - homoglyphs, spelled digits, at/dot disguises - while every character of
the rewritten text carries the span of source characters it stands for; what is
detected there maps back to the source. Base spans always stay; a found span
that lies within one of its kind, or that no transducer touched, adds nothing.
One that is wider than a base span stands beside it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .textgrid import slices

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match can start only at the first digit of a run: the one before it took its run whole
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and non-overlapping per kind, by start and then kind."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), 0))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    found.append((m.start(), m.end(), 3))
    found.sort(key=lambda f: (f[0], f[2], f[1]))
    return [(s, e, KINDS[k]) for s, e, k in found]


# Characters that look like an ASCII letter.
_LOOKALIKE = dict(zip("АВЕКМНОРСТУХаеіјкорсухѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυ", "ABEKMHOPCTYXaeijkopcyxsdhqwABEZHIKMNOPTYXavopu", strict=True))
_INVISIBLE = "­​‌‍⁠﻿"
_DASHES = "‐‑‒–—−"
_SPACES = "      　"
# Digits as words.
_SPELLED = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)) | {"oh": "0"}

_FOREIGN = re.compile("[" + re.escape("".join(_LOOKALIKE) + _INVISIBLE + _DASHES + _SPACES) + "！-～]|(?![0-9])\\d")
_NUMBER = "|".join(sorted(_SPELLED, key=len, reverse=True))
_PART = rf"(?:{_NUMBER}|[0-9]++)(?![^\W_])"
_RUN = re.compile(rf"(?i)(?<![^\W_])(?:(plus)[\s-]{{1,3}})?({_PART}(?:[ \t,()/-]{{1,4}}+{_PART})++)")
_TOKEN = re.compile(rf"(?i){_NUMBER}|[0-9]+")
_HAS_NUMBER_WORDS = re.compile(rf"(?i)\b(?:{_NUMBER})\b")
_DOT_WORD = re.compile(r"(?i)(?<![^\W_])dot(?![^\W_])")
_OCTET = rf"{_PART}(?:[ \t-]{{1,3}}{_PART}){{0,2}}"
_SPELLED_IP = re.compile(rf"(?i)(?<![^\W_]){_OCTET}(?:[ \t]{{1,3}}dot[ \t]{{1,3}}{_OCTET}){{3}}")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKETED = re.compile(rf"(?i)[ \t]{{0,3}}{_OPEN}[ \t]{{0,3}}(at|@|dot|\.)[ \t]{{0,3}}{_CLOSE}[ \t]{{0,3}}|&(?:(commat|#64|#x40)|period|#46|#x2e);")
_GAP = r"(?:[ \t]{1,3}+|_{1,2}+|-{1,2}+)"
# what parts a disguised address: the words, between gaps, and a plain @
_PARTING = re.compile(rf"(?i){_GAP}(?:dot|at|@){_GAP}|@")
_LABELS = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
_BARE_IP = re.compile(r"(?i)(?<![0-9])[0-9]{1,3}(?:(?:[ \t]{1,3}dot[ \t]{1,3}|\.)[0-9]{1,3}){3}(?![0-9])")
_WORD_DOT = re.compile(rf"(?i){_GAP}dot{_GAP}")


class Aligned:
    """A text with, for each character, the span of source characters it stands for."""

    def __init__(self, text: str, start=None, end=None):
        self.text = text
        self.start = range(len(text)) if start is None else start
        self.end = range(1, len(text) + 1) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Aligned:
        """Edits are (from, to, replacement), in order and disjoint; each new character stands for the whole edited span."""
        if not edits:
            return self
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            start.extend(self.start[at:a])
            end.extend(self.end[at:a])
            text.append(new)
            if new:
                start.extend([self.start[a]] * len(new))
                end.extend([self.end[b - 1]] * len(new))
            at = b
        text.append(self.text[at:])
        start.extend(self.start[at:])
        end.extend(self.end[at:])
        return Aligned("".join(text), start, end)


def _fold(c: str) -> str:
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if c in _INVISIBLE:
        return ""
    if c in _DASHES:
        return "-"
    if c in _SPACES:
        return " "
    return str(unicodedata.decimal(c)) if unicodedata.decimal(c, None) is not None else chr(ord(c) - 0xFEE0)


def fold_homoglyphs(x: Aligned) -> Aligned:
    return x if x.text.isascii() else x.rewrite([(m.start(), m.end(), _fold(m.group())) for m in _FOREIGN.finditer(x.text)])


def _digits(text: str, begin: int, end: int, edits: list[tuple[int, int, str]], first: str = "") -> None:
    """Edits that leave the digits of a run alone: each word stands for itself, what is between words goes."""
    at = begin
    for i, t in enumerate(_TOKEN.finditer(text, begin, end)):
        if i and t.start() > at:
            edits.append((at, t.start(), ""))
        edits.append((t.start(), t.end(), (first if not i else "") + _SPELLED.get(t.group().lower(), t.group())))
        at = t.end()


def unspell_addresses(x: Aligned) -> Aligned:
    """Four numbers, some of them in words, with `dot` between them."""
    if not _DOT_WORD.search(x.text) or not _HAS_NUMBER_WORDS.search(x.text):
        return x
    edits: list[tuple[int, int, str]] = []
    for m in _SPELLED_IP.finditer(x.text):
        at = m.start()
        for d in [*_WORD_DOT.finditer(x.text, m.start(), m.end()), None]:
            _digits(x.text, at, d.start() if d else m.end(), edits)
            if d:
                edits.append((d.start(), d.end(), "."))
                at = d.end()
    return x.rewrite(edits)


def unspell_digits(x: Aligned) -> Aligned:
    """Runs of digit words, figures among them, become digits if two or more are words."""
    if not _HAS_NUMBER_WORDS.search(x.text):
        return x
    edits: list[tuple[int, int, str]] = []
    for m in _RUN.finditer(x.text):
        if sum(not t.group()[0].isdigit() for t in _TOKEN.finditer(x.text, m.start(2), m.end(2))) >= 2:
            if m.group(1):
                edits.append((m.start(), m.start(2), "+"))
            _digits(x.text, m.start(2), m.end(2), edits)
    return x.rewrite(edits)


def undisguise(x: Aligned) -> Aligned:
    """[at], (dot) and the like become @ and a full stop; bare words only inside a whole address or four numbers."""
    if re.search(_OPEN + "|&", x.text):
        x = x.rewrite([(m.start(), m.end(), "@" if m.group(2) or (m.group(1) or "").lower() in ("at", "@") else ".") for m in _BRACKETED.finditer(x.text)])
    if not _DOT_WORD.search(x.text) and " @ " not in x.text:
        return x
    edits = {e[0]: e for e in _addresses(x.text)}
    for m in _BARE_IP.finditer(x.text):
        for y in _WORD_DOT.finditer(x.text, m.start(), m.end()):
            edits.setdefault(y.start(), (y.start(), y.end(), "."))
    last, kept = 0, []
    for e in sorted(edits.values()):
        if e[0] >= last:
            kept.append(e)
            last = e[1]
    return x.rewrite(kept)


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits that make whole addresses of disguised ones, in one pass: what parts them is found first, and each `at` reaches as
    far to both sides as `dot` and parts without gaps go; no part is looked at by more than the two `at` around it."""
    marks = [(m.start(), m.end(), "." if "dot" in m.group().lower() else "@") for m in _PARTING.finditer(text)]
    edits, done = [], 0

    def local(n: int) -> int:
        """Where the local characters before mark n begin; they reach no farther than the mark before it, or what is done."""
        low, at = max(done, marks[n - 1][1] if n else 0), marks[n][0]
        while at > low and text[at - 1] in _LOCAL:
            at -= 1
        return at

    for n, (start, end, kind) in enumerate(marks):
        first, begin = n, local(n) if kind == "@" else start
        if begin == start:
            continue
        while first and marks[first - 1][1] == begin and marks[first - 1][2] == "." and done < marks[first - 1][0] and (before := local(first - 1)) < marks[first - 1][0]:
            first, begin = first - 1, before
        last, at, dots = n, end, 0
        while m := _LABELS.match(text, at):
            dots += "." in m.group() or last > n
            at = m.end()
            if last + 1 < len(marks) and marks[last + 1][0] == at and marks[last + 1][2] == "." and _LABELS.match(text, marks[last + 1][1]):
                last += 1
                at = marks[last][1]
            else:
                break
        if not dots:
            continue
        done = at
        edits += [(s, e, k) for s, e, k in marks[first : last + 1] if e - s > 1]
    return edits


TRANSDUCERS = (fold_homoglyphs, unspell_addresses, unspell_digits, undisguise)


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and all spans."""
    base = base_spans(text)
    x = Aligned(text)
    for step in TRANSDUCERS:
        x = step(x)
    if x.text == text:
        return base, base
    # base spans of a kind are disjoint: the last that starts at or before a span is the only one that may hold it
    taken = {kind: [(s, e) for s, e, k in base if k == kind] for kind in KINDS}
    found = list(base)
    for a, b, kind in base_spans(x.text):
        s, e = x.start[a], x.end[b - 1]
        if text[s:e] == x.text[a:b]:
            continue
        k = bisect_right(taken[kind], (s, len(text)))
        if not k or taken[kind][k - 1][1] < e:
            found.append((s, e, kind))
    found = sorted(set(found), key=lambda f: (f[0], KINDS.index(f[2]), f[1]))
    return base, found


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans and n_added for each row.

    Null or empty text has no spans, and the hash of nothing. Repeated rows and
    null ids come through as they are; other columns are not read; no row moves
    between tasks, and memory follows one batch of texts.
    """

    def scan(batches):
        for batch in slices(batches):
            n, sha, spans, added = {k: [] for k in KINDS}, [], [], []
            for value in batch.column("text"):
                base, found = all_spans(value.as_py() or "")
                for k in KINDS:
                    n[k].append(sum(x[2] == k for x in base))
                sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(found))
                added.append(len(found) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    narrow = docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as string) text")
    return narrow.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(value: str | None) -> str | None:
    """The text with each identifier replaced by its kind in brackets; where spans overlap, they are replaced as one."""
    if not value:
        return value
    _, spans = all_spans(value)
    if not spans:
        return value
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [value[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, value[at:]])


def mask_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with identifiers masked in the text and, where there is n_chars, the length of the new text there.

    Null text stays null, with a null length; other columns and the number of rows stay as they are.
    """
    names, schema = docs.columns, docs.schema

    def scan(batches):
        for batch in slices(batches, names.index(text)):
            new = [mask(v.as_py()) for v in batch.column(names.index(text))]
            columns = list(batch.columns)
            columns[names.index(text)] = pa.array(new, batch.schema.field(names.index(text)).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([None if v is None else len(v) for v in new], pa.int64()).cast(batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(scan, schema)
