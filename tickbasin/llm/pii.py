"""PII: offset-preserving deobfuscation.

A base detector finds four kinds of identifiers in the text as it is.  Then
three transducers rewrite the text, each keeping a map from its output back to
its input: look-alike characters become ASCII and invisible ones go, spelled
digits become digits, and disguised at and dot signs become signs.  The base
detector runs on the result, and spans found there that touch rewritten text
are mapped back to source characters.

All work is one pass over rows (mapInPandas): no shuffle, memory of one Arrow
batch.  Scans are linear in the text's length, so very long texts are read
whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, slices

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORDLIKE = LOCAL - {"."}
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Look-alike letters and digits of other scripts, by the ASCII character they stand for.
LOOKALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "κ", "l": "ӏ", "m": "м", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "т", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ",
    "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "-": "‐‑‒–−﹣", ".": "․。｡", "@": "﹫", " ": "    ", "+": "﹢",
}
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits of the corpus languages, by digit.
SPELLED = {
    "0": "zero null cero zéro", "1": "one eins uno un", "2": "two zwei dos deux", "3": "three drei tres trois", "4": "four vier cuatro quatre",
    "5": "five fünf cinco cinq", "6": "six sechs seis", "7": "seven sieben siete sept", "8": "eight acht ocho huit", "9": "nine neun nueve neuf",
}


def lookalike_table() -> dict[int, str]:
    """Character to ASCII character, or to nothing for invisible ones."""
    table = {ord(c): plain for plain, others in LOOKALIKES.items() for c in others}
    table |= {0xFEE0 + code: chr(code) for code in range(0x21, 0x7F)}  # full-width forms
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # decimal digits of other scripts
        table |= {zero + k: str(k) for k in range(10)}
    return table | {ord(c): "" for c in INVISIBLE}


TABLE = lookalike_table()
ODD = re.compile("[" + "".join(map(re.escape, map(chr, sorted(TABLE)))) + "]")
DIGIT_OF = {word: digit for digit, words in SPELLED.items() for word in words.split()}
WORD = "(?:" + "|".join(sorted(DIGIT_OF, key=len, reverse=True)) + ")"
#: Four or more spelled digits in a row, or spelled digits around a spelled dot.
DIGIT_RUN = re.compile(rf"(?<!\w)(?:plus[ -]{{1,3}})?{WORD}(?:(?:[ ,-]{{1,3}}|\s{{0,3}}[\[(]?\s{{0,3}}\b(?:dot|point|punkt|punto)\b\s{{0,3}}[\])]?\s{{0,3}}){WORD}){{3,}}(?!\w)", re.I)
DIGIT_WORD = re.compile(rf"plus[ -]{{1,3}}|{WORD}", re.I)
SOME_DIGITS = re.compile(rf"(?<!\w){WORD}[ ,-]{{1,3}}{WORD}(?!\w)", re.I)
DOT_SIGN = r"(?:\s{0,3}[\[({<]\s{0,2}(?:dot|punkt|punto|point|\.)\s{0,2}[\])}>]\s{0,3}|\s{1,3}(?:dot|punkt|punto)\s{1,3})"
AT_SIGN = re.compile(r"\s{0,3}[\[({<]\s{0,2}(?:at|@|arroba)\s{0,2}[\])}>]\s{0,3}|\s{1,3}(?:at|arroba)\s{1,3}|@", re.I)
AFTER_AT = re.compile(rf"[A-Za-z0-9-]+(?:(?:{DOT_SIGN}|\.)[A-Za-z0-9-]+)+", re.I)
DOT = re.compile(DOT_SIGN, re.I)
BETWEEN_DIGITS = re.compile(rf"(?<=[0-9]){DOT_SIGN}(?=[0-9])", re.I)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of an address: around each at sign, so long runs of letters are read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans of four dotted numbers up to 255, four by four along a dotted run."""
    for run in DOTTED.finditer(text):
        if "." not in run[0]:
            continue
        numbers, start = run[0].split("."), run.start()
        for k in range(0, len(numbers) - 3, 4):
            end = start + len(".".join(numbers[k : k + 4]))
            if all(int(n.lstrip("0")[:4] or 0) <= 255 for n in numbers[k : k + 4]):
                yield start, end
            start = end + 1


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Spans of 16 to 19 digits with a right check digit."""
    for run in CARD.finditer(text):
        if run.end() - run.start() >= 16:
            digits = run[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    """Spans of an international number of 8 to 15 digits."""
    if "+" in text:
        for run in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in run[0]) <= 15:
                yield run.span()


def detect(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end), by kind and then start."""
    found = [("email", *span) for span in emails(text)]
    if DOTTED.search(text):
        found += [("ip", *span) for span in addresses(text)]
        found += [("card", *span) for span in cards(text)]
        found += [("phone", *span) for span in phones(text)]
    return found


class Rewrite:
    """A rewritten text that maps spans back to the text it came from."""

    def __init__(self, text: str, changes: list[tuple[int, int, str]]):
        """changes: disjoint (start, end, replacement) in order."""
        self.changes, self.starts, parts, at, out = changes, [], [], 0, 0
        for start, end, new in changes:
            parts += text[at:start], new
            out += start - at
            self.starts.append(out)
            out, at = out + len(new), end
        self.text = "".join([*parts, text[at:]])

    def back(self, at: int, last: bool) -> tuple[int, bool]:
        """Source offset where the character at begins, or ends if last; whether it was rewritten."""
        k = bisect_right(self.starts, at) - 1
        if k < 0:
            return at + last, False
        start, end, new = self.changes[k]
        inside = at - self.starts[k]
        if inside < len(new):
            return (end if last else start), True
        return end + inside - len(new) + last, False

    def touches(self, start: int, end: int) -> bool:
        """Whether a span of the output holds or borders rewritten text inside it."""
        k = bisect_right(self.starts, start)
        if k and start < self.starts[k - 1] + len(self.changes[k - 1][2]):
            return True
        return k < len(self.starts) and self.starts[k] < end


def plain_characters(text: str) -> Rewrite:
    """Look-alikes to ASCII, invisible characters to nothing."""
    return Rewrite(text, [] if text.isascii() else [(m.start(), m.end(), TABLE[ord(m[0])]) for m in ODD.finditer(text)])


def plain_digits(text: str) -> Rewrite:
    """Runs of spelled digits to digits."""
    changes: list[tuple[int, int, str]] = []
    if SOME_DIGITS.search(text):
        for run in DIGIT_RUN.finditer(text):
            at = run.start()
            for word in DIGIT_WORD.finditer(text, run.start(), run.end()):
                between = text[at : word.start()]
                if between and not DOT.fullmatch(between):
                    changes.append((at, word.start(), ""))
                changes.append((word.start(), word.end(), DIGIT_OF.get(word[0].lower(), "+")))
                at = word.end()
    return Rewrite(text, changes)


def local_start(text: str, at: int, dots: dict[int, int]) -> int:
    """Where a local part that ends at `at` begins, dots plain or disguised; `at` itself if there is none.

    dots: start of every disguised dot by its end.  The walk stops at the first
    character that is neither, the previous at sign at the latest, so walks
    from different at signs do not overlap.
    """
    start = at
    while True:
        low = start
        while low and text[low - 1] in WORDLIKE:
            low -= 1
        if low == start:
            return at if start == at else ends
        ends = low
        if low and text[low - 1] == ".":
            start = low - 1
        elif low in dots:
            start = dots[low]
        else:
            return low


def plain_signs(text: str) -> Rewrite:
    """Disguised at and dot signs to signs, only where they stand in an address."""
    changes: dict[int, tuple[int, int, str]] = {m.start(): (m.start(), m.end(), ".") for m in BETWEEN_DIGITS.finditer(text)}
    signs = None
    for at in AT_SIGN.finditer(text):
        after = AFTER_AT.match(text, at.end())
        if not after:
            continue
        dots = [(m.start(), m.end(), ".") for m in DOT.finditer(text, after.start(), after.end())]
        sure = at[0] == "@" or not at[0].isspace() and any(c in at[0] for c in "[({<")
        if not dots and not sure:
            continue
        if signs is None:
            signs = {m.end(): m.start() for m in DOT.finditer(text)}
        start = local_start(text, at.start(), signs)
        if start == at.start():
            continue
        dots += [(m.start(), m.end(), ".") for m in DOT.finditer(text, start, at.start())]
        for change in [*dots, *([] if at[0] == "@" else [(at.start(), at.end(), "@")])]:
            changes.setdefault(change[0], change)
    kept: list[tuple[int, int, str]] = []
    for change in sorted(changes.values()):
        if not kept or change[0] >= kept[-1][1]:
            kept.append(change)
    return Rewrite(text, kept)


def disguised(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows and that no base span of their kind covers; wider ones stand beside it."""
    stages, now = [], text
    for step in (plain_characters, plain_digits, plain_signs):
        stage = step(now)
        if stage.changes:
            stages.append(stage)
            now = stage.text
    if not stages:
        return []
    taken = {kind: [(s, e) for k, s, e in base if k == kind] for kind in KINDS}
    added = []
    for kind, start, end in detect(now):
        touched = False
        for stage in reversed(stages):
            touched |= stage.touches(start, end)
            start, end = stage.back(start, False)[0], stage.back(end - 1, True)[0]
        if touched and not any(s <= start and end <= e for s, e in taken[kind]):
            added.append((kind, start, end))
    return added


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, by kind as listed and then start."""
    base = detect(text)
    added = disguised(text, base)
    return base, sorted([*base, *added], key=lambda x: (KINDS.index(x[0]), x[1])) if added else base


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            parts += text[at:start], f"[{kind.upper()}]"
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds identifiers in every whole text.

    Returns one row per input row: the id, n_email, n_ip, n_card, n_phone (base
    spans), n_added (spans that only deobfuscation shows), base_sha256 and
    spans.  Null and empty texts have no spans; very long texts are read whole,
    in time linear in their length; of spans that start alike the kind listed
    first comes first; repeated rows give repeated rows; null ids stay null;
    other columns, whatever their names, are not read; an empty table gives an
    empty table.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                base, spans = spans_of(text)
                kinds = [k for k, _, _ in base]
                out.append((*(kinds.count(k) for k in KINDS), len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = ["n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"]
            yield pd.concat([batch[["id"]].reset_index(drop=True), pd.DataFrame(out, columns=columns)], axis=1)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return read.mapInPandas(rows, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Replaces every identifier in the text by [KIND]; other columns stay, their types too.

    Null texts stay null, empty ones empty; repeated rows and null ids stay;
    very long texts are read whole.  Overlapping spans become one, named by the
    first, of equal starts the longest.  length_col, if the table has it, gets
    the new length.  An empty table gives an empty table.
    """
    from pyspark.sql import types as T

    @F.arrow_udf(T.StringType())
    def clean(texts: pa.Array) -> pa.Array:
        parts = [pa.array([t if t is None else redacted(t, spans_of(t)[1]) for t in part.to_pylist()], texts.type) for part in slices(texts)]
        release_memory()
        return pa.concat_arrays(parts) if parts else texts

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out
