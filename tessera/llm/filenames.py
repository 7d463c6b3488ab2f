"""What a file name says apart from how it is written, and its winnowed fingerprints."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

import xxhash

# File types, and words that mark a copy or version.
EXTENSIONS = frozenset("pdf docx doc pptx ppt xlsx xls txt md csv tsv rtf odt ods odp htm html xml json eml msg png jpg jpeg gif tif tiff bmp zip".split())
MARKS = frozenset("copy kopie copie copia kopia final finale draft signed scanned version ver rev revision fw fwd re aw wg of von de di".split())
_BRACKETS = re.compile(r"\(\s*(?:\d{1,3}|(?:rev|version|ver|v|copy|kopie|copie|copia)\.?\s*[a-z0-9]{0,3})\s*\)")
_VERSION = re.compile(r"(?<![a-z0-9])v(?:er(?:sion)?)?[ ._-]?\d{1,2}(?:\.\d{1,2})?(?![a-z0-9])")
_YEAR_FIRST = re.compile(r"(?<![0-9a-z])((?:19|20)\d\d)([-._ /]?)(0[1-9]|1[0-2])\2(0[1-9]|[12]\d|3[01])(?![0-9a-z])")
_DAY_FIRST = re.compile(r"(?<![0-9a-z])(0?[1-9]|[12]\d|3[01])([-._ /])(0?[1-9]|1[0-2])\2((?:19|20)\d\d)(?![0-9a-z])")
_CODE = re.compile(r"^([a-z]+)(\d{4,})$")
GRAM, WINDOW = 4, 3
#: Up to this many letters two slips may leave no winnowed fingerprint in common.
SHORT = 24


def canonical_name(path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(words, numbers) of the file name, both sorted; folder, file type, case, accents, separators, percent
    encoding, date notation and marks of copying or version do not count. Dates are among the numbers."""
    for _ in range(3):
        decoded = unquote(path, errors="replace")
        if decoded == path or "�" in decoded:
            break
        path = decoded
    name = re.split(r"[/\\]", path.rstrip("/\\ "))[-1]
    if "Ã" in name or "Â" in name:
        try:
            name = name.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    name = unicodedata.normalize("NFKD", name).casefold()
    name = "".join(c for c in name if unicodedata.category(c) not in ("Mn", "Me", "Cf")).strip()
    while True:
        stem, dot, kind = name.rpartition(".")
        if dot and kind.strip() in EXTENSIONS and stem.strip():
            name = stem.strip()
        else:
            break
    name = _BRACKETS.sub(" ", name)
    name = _YEAR_FIRST.sub(lambda m: f" {m[1]}{m[3]}{m[4]} ", name)
    name = _DAY_FIRST.sub(lambda m: f" {m[4]}{int(m[3]):02d}{int(m[1]):02d} ", name)
    name = _VERSION.sub(" ", name.replace("_", " "))
    words, numbers = [], []
    tokens = re.findall(r"[^\W_]+", name)
    for i, token in enumerate(tokens):
        code = _CODE.match(token)
        for part in code.groups() if code else (token,):
            if any(c.isdigit() for c in part):
                numbers.append(part)
            elif part not in MARKS and not (part == "scan" and i == len(tokens) - 1 and i):
                words.append(part)
    return tuple(sorted(words)), tuple(sorted(numbers))


def canonical_hash(value: str | None) -> str | None:
    """Lower-case hexadecimal digits of a SHA-256 in any notation; None if it is none."""
    if value is None:
        return None
    found = re.findall(r"[0-9a-f]{64}", re.sub(r"[^0-9a-z]", "", re.sub(r"(?i)^\s*sha-?256\s*[:=-]?", "", value).lower()))
    return found[0] if found else None


def damerau(a: str, b: str, most: int) -> int:
    """Edits, adjacent swaps counting one, or ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def same_words(a: tuple[str, ...], b: tuple[str, ...], slips: int = 2) -> bool:
    """The same words apart from at most ``slips`` slips in all, none of which replaces most of a word."""
    if a == b:
        return True
    left = list(a)
    rest = []
    for w in b:
        if w in left:
            left.remove(w)
        else:
            rest.append(w)
    # a mark with a slip in it has stayed in one of the names
    for some, other in ((left, rest), (rest, left)):
        if len(some) == len(other) + 1:
            odd = [w for w in some if any(len(m) > 3 and damerau(w, m, 1) <= 1 for m in MARKS)]
            if odd:
                some.remove(odd[0])
                slips -= 1
    if not left and not rest:
        return True
    if not left or not rest:
        return False
    if len(left) != len(rest):
        return len("".join(left)) > 6 and damerau("".join(left), "".join(rest), slips) <= min(slips, 1)
    budget = slips
    for w in sorted(left, key=len, reverse=True):
        best, at = min((damerau(w, x, budget), i) for i, x in enumerate(rest))
        if best > budget or best > max(1, min(len(w), len(rest[at])) // 3):
            return False
        budget -= best
        rest.pop(at)
    return True


def fingerprints(words: tuple[str, ...], numbers: tuple[str, ...]) -> list[int]:
    """Winnowed grams of the words, each bound to all numbers, as names with other numbers are never the same."""
    bound = xxhash.xxh64_intdigest("\x1f".join(numbers))
    text = " ".join(words)
    grams = [xxhash.xxh64_intdigest(text[i : i + GRAM], bound) for i in range(max(len(text) - GRAM + 1, 1))] if text else []
    picked: set[int] = set()
    for i in range(max(len(grams) - WINDOW + 1, 1) if grams else 0):
        picked.add(min(grams[i : i + WINDOW]))
    return sorted(picked)


def slip_prints(words: tuple[str, ...], numbers: tuple[str, ...]) -> list[int]:
    """Prints of a short name of which two that :func:`same_words` accepts share one, bound to all numbers.

    Of three words one is whole. Of two, one is whole or each has one slip; a single one may have two. Words
    that are typed apart have one slip together.
    """
    text = "".join(words)
    if not text or len(text) > SHORT:
        return []

    def without(some: set[str]) -> set[str]:
        return {w[:i] + w[i + 1 :] for w in some for i in range(len(w))}

    parts = {*words, text, *without({text})}
    if len(words) <= 2:
        parts |= without(set(words))
    if len(words) == 1 and len(text) >= 5:
        parts |= without(without({text}))
    bound = xxhash.xxh64_intdigest("\x1f".join(numbers), 7)
    return sorted(xxhash.xxh64_intdigest(w, bound) for w in parts if w)
