"""Format-preserving pseudonyms for personal data.

A candidate that fits a pattern counts only if it is valid: card numbers by their check
digit, bank accounts by their remainder, addresses by their octets, dates by the calendar,
social security numbers by the ranges in use, telephone numbers by their number of digits. A valid value is a
number in a range; a Feistel network keyed for its kind permutes the range, and what falls
outside is permuted again until it falls inside. So a pseudonym is valid too, has the same
format, the same value has the same pseudonym in every document however it is punctuated,
no two values share one, and whoever has the key can turn it back.

A match that is not valid or overlaps another value is tried by its parts between blanks and
hyphens, and the search goes on from its next group, so a value next to other digits or
words is found. Turning back searches in the same way: beside further digits, the digits of
a pseudonym can by chance complete another valid number, and then that one is turned back.

Results for odd rows: a null text stays null, with counts of 0 and no spans; an empty one
stays empty. Repeated rows give equal results. Columns other than ``doc_id`` and ``text``
are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame

from netbehave.llm.words import map_slices

ROUNDS = 10
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LOCAL_BLOCK = 512  # characters of the part before the sign that are permuted together


# ---------------------------------------------------------------- permutation


class Permutation:
    """Keyed permutation of 0 .. size - 1 for any size, apart for each label."""

    def __init__(self, key: bytes, label: str, size: int):
        self.key, self.label, self.size = key, label.encode(), size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1

    def mix(self, turn: int, value: int) -> int:
        message = b"%s|%d|%d|%d" % (self.label, self.size, turn, value)
        digest = hashlib.blake2b(message, key=self.key, digest_size=16).digest()
        # Halves wider than a digest get further ones, so that every bit is mixed.
        for block in range(1, -(-self.half // 128)):
            more = b"%s|%d" % (message, block)
            digest += hashlib.blake2b(more, key=self.key, digest_size=16).digest()
        return int.from_bytes(digest, "little") & self.mask

    def once(self, value: int) -> int:
        left, right = value >> self.half, value & self.mask
        for turn in range(ROUNDS):
            left, right = right, left ^ self.mix(turn, right)
        return left << self.half | right

    def once_back(self, value: int) -> int:
        left, right = value >> self.half, value & self.mask
        for turn in reversed(range(ROUNDS)):
            left, right = right ^ self.mix(turn, left), left
        return left << self.half | right

    def walk(self, value: int, step: Callable[[int], int]) -> int:
        value = step(value)
        while value >= self.size:
            value = step(value)
        return value

    def forward(self, value: int) -> int:
        return self.walk(value, self.once)

    def backward(self, value: int) -> int:
        return self.walk(value, self.once_back)


def permuted(key: bytes, label: str, size: int, value: int, back: bool) -> int:
    permutation = Permutation(key, label, size)
    return permutation.backward(value) if back else permutation.forward(value)


# ---------------------------------------------------------------- kinds


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in turn."""
    new = iter(digits)
    return "".join(next(new) if c in "0123456789" else c for c in text)


def luhn_sum(digits: str) -> int:
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(doubled[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits)))


def card(text: str, key: bytes, back: bool) -> str | None:
    digits = digits_of(text)
    if not 13 <= len(digits) <= 19 or luhn_sum(digits) % 10 or not int(digits):
        return None
    n = len(digits) - 1
    payload = f"{permuted(key, 'card', 10**n, int(digits[:n]), back):0{n}d}"
    return refill(text, payload + str(-luhn_sum(payload + "0") % 10))


def iban(text: str, key: bytes, back: bool) -> str | None:
    joined = text.replace(" ", "")
    land, check, rest = joined[:2], joined[2:4], joined[4:]

    def remainder(tail: str, digits: str) -> int:
        return int("".join(str(int(c, 36)) for c in tail + land + digits)) % 97

    if remainder(rest, check) != 1:
        return None
    # Letters stay; the digits of the account are permuted and the check digits set anew.
    digits = digits_of(rest)
    if not digits:
        return None
    new = f"{permuted(key, f'iban{land}', 10 ** len(digits), int(digits), back):0{len(digits)}d}"
    tail = refill(rest, new)
    fill = iter(land + f"{98 - remainder(tail, '00'):02d}" + tail)
    return "".join(c if c == " " else next(fill) for c in text)


def ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    areas = [a for a in range(1, 900) if a != 666]
    if area not in areas or not group or not serial:
        return None
    value = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    value = permuted(key, "ssn", len(areas) * 99 * 9999, value, back)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return refill(text, f"{areas[area]:03d}{group + 1:02d}{serial + 1:04d}")


def phone(text: str, key: bytes, back: bool) -> str | None:
    digits = digits_of(text)
    if len(digits) < 10 or len(digits) > 13:
        return None
    land, number = digits[:-10], digits[-10:]
    return refill(text, land + f"{permuted(key, 'phone', 10**10, int(number), back):010d}")


def ip(text: str, key: bytes, back: bool) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    value = int.from_bytes(bytes(map(int, octets)))
    return ".".join(map(str, permuted(key, "ip", 2**32, value, back).to_bytes(4)))


FIRST_DAY = date(1900, 1, 1)
N_DAYS = (date(2100, 1, 1) - FIRST_DAY).days


def day(text: str, key: bytes, back: bool) -> str | None:
    parts = re.split(r"([-/.])", text)
    numbers, separators = parts[::2], parts[1::2]
    if separators[0] != separators[1]:
        return None
    year_first = len(numbers[0]) == 4
    year, month, last = numbers if year_first else reversed(numbers)
    # 12/31/2024 has the month first; a day up to 12 is read as day first.
    month_first = not year_first and int(month) > 12
    if month_first:
        month, last = last, month
    try:
        value = (date(int(year), int(month), int(last)) - FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= value < N_DAYS or not len(month) == len(last) == 2:
        return None
    # A month-first date is one with a day above 12; its pseudonym must be one too.
    label = f"date{year_first}{month_first}"
    value = permuted(key, label, N_DAYS, value, back)
    while month_first and (FIRST_DAY + timedelta(value)).day <= 12:
        value = permuted(key, label, N_DAYS, value, back)
    new = FIRST_DAY + timedelta(value)
    if year_first:
        return new.strftime(f"%Y{separators[0]}%m{separators[0]}%d")
    order = "%m{0}%d{0}%Y" if month_first else "%d{0}%m{0}%Y"
    return new.strftime(order.format(separators[0]))


def email(text: str, key: bytes, back: bool) -> str | None:
    """Letters and digits of the part before the sign are permuted, each among its own.

    A part of over ``LOCAL_BLOCK`` characters, which no mailbox has, is permuted block by block,
    so that the work stays in proportion to its length.
    """
    local, _, domain = text.partition("@")
    blocks = [local[at : at + LOCAL_BLOCK] for at in range(0, len(local), LOCAL_BLOCK)]
    made = [local_part(block, "" if not at else f"|{at}|", key, back) for at, block in enumerate(blocks)]
    if all(one is None for one in made):
        return None
    return "".join(block if one is None else one for block, one in zip(blocks, made)) + "@" + domain


def local_part(local: str, place: str, key: bytes, back: bool) -> str | None:
    """``local`` permuted within its format, or None if it has no letter or digit."""
    size, value, places = 1, 0, []
    for c in local:
        if c in "0123456789":
            radix, number = 10, int(c)
        elif c.lower() in LETTERS and c.isascii():
            radix, number = 26, LETTERS.index(c.lower())
        else:
            continue
        places.append(radix)
        size, value = size * radix, value * radix + number
    if size < 2:
        return None
    value = permuted(key, f"email{place}{local_shape(local)}", size, value, back)
    new = []
    for radix in reversed(places):
        value, number = divmod(value, radix)
        new.append(str(number) if radix == 10 else LETTERS[number])
    fill = iter(reversed(new))
    made = []
    for c in local:
        if c.isascii() and c.isalnum():
            d = next(fill)
            made.append(d.upper() if c.isupper() else d)
        else:
            made.append(c)
    return "".join(made)


def local_shape(local: str) -> str:
    return re.sub("[0-9]", "9", re.sub("[A-Za-z]", "a", local))


PATTERNS: tuple[tuple[str, str, Callable[[str, bytes, bool], str | None]], ...] = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("phone", r"(?<![A-Za-z0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![A-Za-z0-9])", phone),
    ("phone", r"(?<![A-Za-z0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![A-Za-z0-9])", phone),
    ("card", r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])", card),
    ("ssn", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", ssn),
    ("ip", r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[A-Za-z0-9])", ip),
    (
        "date",
        r"(?<![A-Za-z0-9./-])"
        r"(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4})"
        r"(?![A-Za-z0-9]|[./-][0-9])",
        day,
    ),
)

COMPILED = tuple((kind, re.compile(pattern), permute) for kind, pattern, permute in PATTERNS)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + LETTERS + "0123456789._%+-")
SIGNS = re.compile("[0-9@]")
GAP = re.compile("[ -]")

Span = tuple[int, int, str, str]


def pseudonyms(text: str, key: bytes, back: bool = False) -> list[Span]:
    """Disjoint (start, end, kind, pseudonym) in ascending order.

    Of two valid values that overlap, the kind listed first in ``PATTERNS`` counts.
    """
    if not SIGNS.search(text):
        return []
    taken: list[Span] = []  # in order and disjoint

    def place(low: int, high: int) -> int | None:
        """Where a span belongs, or None if it overlaps one that is taken."""
        at = bisect_left(taken, high, key=lambda span: span[0])
        return None if at and taken[at - 1][1] > low else at

    for kind, pattern, permute in COMPILED:
        search = email_match if kind == "email" else pattern.search
        at = 0
        while match := search(text, at):
            found = None
            for low, high in parts_of(pattern, match):
                where = place(low, high)
                if where is None:
                    continue
                new = permute(text[low:high], key, back)
                if new is not None:
                    found = (low, high, kind, new)
                    break
            if found:
                taken.insert(where, found)
                at = found[1]
            else:
                next_group = GAP.search(text, match.start(), match.end())
                at = next_group.end() if next_group else match.end()
    return taken


def email_match(text: str, at: int) -> re.Match | None:
    """What the pattern of addresses finds from ``at`` on, looked for from its sign backwards.

    A search by the pattern itself would read a long run of letters without a sign once for
    each of its characters.
    """
    pattern = COMPILED[0][1]
    sign = text.find("@", at)
    while sign >= 0:
        start = sign
        while start > at and text[start - 1] in LOCAL:
            start -= 1
        if start < sign and (match := pattern.match(text, start)):
            return match
        at = sign + 1
        sign = text.find("@", at)
    return None


def parts_of(pattern: re.Pattern, match: re.Match) -> Iterator[tuple[int, int]]:
    """The match, then its shorter parts between blanks and hyphens that fit, longest first."""
    low, high = match.span()
    yield low, high
    gaps = [gap.span() for gap in GAP.finditer(match.string, low, high)]
    starts, ends = [low, *(b for _, b in gaps)], [*(a for a, _ in gaps), high]
    spans = [(a, b) for a in starts for b in ends if a < b and (a, b) != (low, high)]
    for a, b in sorted(spans, key=lambda span: (span[0] - span[1], span)):
        if pattern.fullmatch(match.string, a, b):
            yield a, b


def replaced(text: str, spans: list[Span]) -> str:
    pieces, at = [], 0
    for start, end, _, new in spans:
        pieces += [text[at:start], new]
        at = end
    return "".join([*pieces, text[at:]])


SCHEMA = ", ".join(["doc_id long, text string", *[f"n_{kind} long" for kind in KINDS], "spans string"])


def pseudonymized(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """Texts with pseudonyms, the number of each kind and the spans in the given text.

    ``back`` turns pseudonyms made with the same key back into the values.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        found = [pseudonyms(text, key, back) if text else [] for text in texts]
        new = [replaced(text, spans) if spans else text for text, spans in zip(texts, found)]
        columns = [part.column("doc_id"), pa.array(new, pa.string())]
        for kind in KINDS:
            counts = [sum(one[2] == kind for one in spans) for spans in found]
            columns.append(pa.array(counts, pa.int64()))
        told = [",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in spans) for spans in found]
        columns.append(pa.array(told, pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

    return map_slices(docs.select("doc_id", "text"), work, SCHEMA)
