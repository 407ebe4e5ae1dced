"""PII: pseudonyms by a keyed permutation (Feistel network) within the format of each value.

Numbers and dates are found by their form and checked (digit sums, octets, calendar). A value is
read as a number within the set of all values of its format, the number is permuted by the key,
and written back in the format. So a pseudonym is as valid as the value, equal values get equal
pseudonyms in all documents however they are punctuated, different values different ones, and who
has the key can undo it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable
from math import isqrt, prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.llm.common import map_text

#: production keys come from the caller; this one serves the registered query
KEY = b"a key for test data"
ROUNDS = 8
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), 73049  # 1900 to 2099
_REMEMBERED = 1 << 16

# fixed values: forms of personal data
FORMS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w/-]|\.\d)",
    "address": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "phone": r"(?<![\w+])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
             r"|\+[1-9](?:[ .()-]{0,2}[0-9]){6,14})(?![\w]|-\d)",
    # to the next space or quote, without marks of a sentence at its end
    "secret": r"(?i:\b(?:password|passwd|secret|token|api_?key))\s*[=:]\s*[\"']?"
              r"[^\s\"']{7,}[^\s\"'.,;:!?)\]}>]",
}
_FOUND = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMS.items()))
_HINT = re.compile(r"[0-9@=:]")
# country codes; those of three digits are all others
_COUNTRY = re.compile(
    "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")
_PIECE = 128  # letters and digits permuted at once; a round's 512 bits are enough for half of them
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Feistel:
    """A keyed permutation of 0 .. size - 1, by an unbalanced network and cycle walking."""

    def __init__(self, key: bytes, tag: str, size: int) -> None:
        self.size = size
        self.left = isqrt(size - 1) + 1 if size > 1 else 1
        self.right = -(-size // self.left)
        self.key = hashlib.blake2b(f"{tag}/{size}".encode(), key=key[:64], digest_size=32).digest()

    def _round(self, number: int, half: int) -> int:
        data = half.to_bytes(half.bit_length() // 8 + 1, "big")
        out = hashlib.blake2b(data, key=self.key, salt=bytes([number]), digest_size=64).digest()
        return int.from_bytes(out, "big")

    def _once(self, value: int, forward: bool) -> int:
        left, right = divmod(value, self.right)
        sign = 1 if forward else -1
        for number in range(ROUNDS) if forward else reversed(range(ROUNDS)):
            if number % 2:
                right = (right + sign * self._round(number, left)) % self.right
            else:
                left = (left + sign * self._round(number, right)) % self.left
        return left * self.right + right

    def permute(self, value: int, forward: bool = True) -> int:
        if self.size < 2:
            return value
        value = self._once(value, forward)
        while value >= self.size:
            value = self._once(value, forward)
        return value


def _luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = sum(
        sum(divmod(int(d) * 2, 10)) if i % 2 == 0 else int(d)
        for i, d in enumerate(reversed(digits)))
    return -total % 10


def _refill(shape: str, chars: str, of: Callable[[str], bool]) -> str:
    """``shape`` with those characters that ``of`` holds for replaced in order."""
    left = iter(chars)
    return "".join(next(left) if of(c) else c for c in shape)


class Pseudonyms:
    """Finds and replaces values; ``forward=False`` undoes it."""

    def __init__(self, key: bytes, forward: bool = True) -> None:
        self.key, self.forward = key, forward
        self.networks: dict[tuple[str, int], Feistel] = {}
        self.known: dict[tuple[str, str], str | None] = {}

    def _permute(self, tag: str, value: int, size: int) -> int:
        network = self.networks.get((tag, size))
        if network is None:
            network = self.networks[tag, size] = Feistel(self.key, tag, size)
        return network.permute(value, self.forward)

    def _mixed(self, tag: str, chars: str, alphabets: list[str]) -> str:
        """Permutes a text whose characters come from the given alphabets."""
        value = 0
        for c, alphabet in zip(chars, alphabets):
            value = value * len(alphabet) + alphabet.index(c)
        value = self._permute(tag, value, prod(map(len, alphabets)))
        out = []
        for alphabet in reversed(alphabets):
            value, i = divmod(value, len(alphabet))
            out.append(alphabet[i])
        return "".join(reversed(out))

    def _digits(self, tag: str, digits: str) -> str:
        return self._mixed(tag, digits, ["0123456789"] * len(digits))

    def _classes(self, tag: str, text: str, hexadecimal: bool = True) -> str:
        """Permutes letters and digits, each within its class; long hexadecimal text as such."""
        chars = "".join(c for c in text if c.isascii() and c.isalnum())
        if hexadecimal and len(chars) >= 16 and re.fullmatch("[0-9a-f]+", chars):
            alphabets = ["0123456789abcdef"] * len(chars)
            tag += "/hex"
        else:
            alphabets = ["0123456789" if c.isdigit() else _LETTERS if c.islower()
                         else _LETTERS.upper() for c in chars]
            tag += "/" + "".join(a[0] for a in alphabets)
        new = self._mixed(tag, chars, alphabets)
        return _refill(text, new, lambda c: c.isascii() and c.isalnum())

    def email(self, text: str) -> str:
        name, at, domain = text.partition("@")
        return self._classes("email", name) + at + domain

    def secret(self, text: str) -> str | None:
        start = re.match(r"\w+\s*[=:]\s*[\"']?", text).end()
        chars = re.sub("[^A-Za-z0-9]", "", text[start:])
        if not chars:
            return None
        pieces = -(-len(chars) // _PIECE)
        cuts = [len(chars) * i // pieces for i in range(pieces + 1)]
        new = "".join(self._classes("secret", chars[i:j]) for i, j in zip(cuts, cuts[1:]))
        return text[:start] + _refill(text[start:], new, lambda c: c.isascii() and c.isalnum())

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")

        def rest(x: str) -> int:
            return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97

        if not 15 <= len(plain) <= 34 or rest(plain) != 1:
            return None
        body = self._classes(f"iban/{plain[:2]}", plain[4:], hexadecimal=False)
        check = 98 - rest(plain[:2] + "00" + body)
        return _refill(text, f"{plain[:2]}{check:02d}{body}", lambda c: c != " ")

    def date(self, text: str) -> str | None:
        parts = [int(x) for x in re.split(r"[./-]", text)]
        iso = "-" in text
        # days come first with dots; with slashes months do, unless that is no date
        orders = [(0, 1, 2)] if iso else [(2, 1, 0)] if "." in text else [(2, 0, 1), (2, 1, 0)]
        for order in orders:
            try:
                day = dt.date(*(parts[i] for i in order))
            except ValueError:
                continue
            place = day.toordinal() - FIRST_DAY
            if not 0 <= place < DAYS:
                return None
            # a slashed date that reads both ways stays so, and one that does not stays one-way;
            # in all formats alike, so that equal dates stay equal
            late = day.day > 12
            new = None
            while new is None or (new.day > 12) != late:
                place = self._permute("date", place, DAYS)
                new = dt.date.fromordinal(FIRST_DAY + place)
            if iso:
                return new.isoformat()
            values = {order[0]: f"{new.year:04d}", order[1]: new.month, order[2]: new.day}
            width = [len(x) for x in re.split(r"[./]", text)]
            joined = [values[i] if i == 2 else f"{values[i]:02d}" for i in range(3)]
            if min(width[:2]) == 1:
                joined = [x if i == 2 else str(int(x)) for i, x in enumerate(joined)]
            return re.search(r"[./]", text)[0].join(joined)
        return None

    def address(self, text: str) -> str | None:
        octets = text.split(".")
        if any(int(o) > 255 or str(int(o)) != o for o in octets):
            return None
        value = int.from_bytes(bytes(map(int, octets)), "big")
        new = self._permute("address", value, 1 << 32)
        return ".".join(map(str, new.to_bytes(4, "big")))

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if str(_luhn(digits[:-1])) != digits[-1] or not digits.strip("0"):
            return None
        body = self._digits("card", digits[:-1])
        return _refill(text, f"{body}{_luhn(body)}", str.isdigit)

    def ssn(self, text: str) -> str | None:
        area, group, serial = text.split("-")
        number = int(area)
        if number in (0, 666) or number >= 900 or group == "00" or serial == "0000":
            return None
        number -= 1 + (number > 666)
        value = (number * 99 + int(group) - 1) * 9999 + int(serial) - 1
        value = self._permute("ssn", value, 898 * 99 * 9999)
        value, serial_ = divmod(value, 9999)
        number, group_ = divmod(value, 99)
        number += 1 + (number >= 665)
        return f"{number:03d}-{group_ + 1:02d}-{serial_ + 1:04d}"

    def phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if text[0] == "+":
            code = _COUNTRY.match(digits)[0]
            own = digits[len(code):]
            if code != "1" or len(own) != 10:
                # the country stays, and so does a zero that the number starts with
                first = "0" if own[0] == "0" else "123456789"
                tag = f"phone/+{code}/{first[0]}"
                new = self._mixed(tag, own, [first] + ["0123456789"] * (len(own) - 1))
                return _refill(text, code + new, str.isdigit)
        own = digits[-10:]
        # area and exchange that start with 2 to 9 keep doing so
        alphabets = [
            ("23456789" if c in "23456789" else "01") if i in (0, 3) else "0123456789"
            for i, c in enumerate(own)]
        tag = "phone/" + "".join(alphabets[i][0] for i in (0, 3))
        return _refill(text, digits[:-10] + self._mixed(tag, own, alphabets), str.isdigit)

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds of the values replaced, in order."""
        if not _HINT.search(text):
            return text, []
        kinds: list[str] = []

        def one(match: re.Match) -> str:
            kind, value = match.lastgroup, match[0]
            if (kind, value) not in self.known:
                if len(self.known) >= _REMEMBERED:
                    self.known.clear()
                self.known[kind, value] = getattr(self, kind)(value)
            new = self.known[kind, value]
            if new is None:
                return value
            kinds.append(kind)
            return new

        return _FOUND.sub(one, text), kinds


def pseudonymise(
    docs: DataFrame, key: bytes = KEY, text: str = "text", forward: bool = True
) -> DataFrame:
    """Replaces personal data in the text; adds n_found and kinds (in order of place).

    Columns of these names are replaced, all others stay. NULL text stays NULL with nothing found.
    Values that fail their check (no such day, wrong check digit, octet over 255) stay as they
    are. ``forward=False`` restores the values with the same key.
    """

    def start():
        names = Pseudonyms(key, forward)

        def work(texts: list) -> dict:
            done = [names.replace(t.decode("utf-8", "replace")) if t is not None else (None, [])
                    for t in texts]
            return {
                "_new": [d[0] for d in done], "n_found": [len(d[1]) for d in done],
                "kinds": [d[1] for d in done]}

        return work

    added = [
        T.StructField("_new", T.StringType()), T.StructField("n_found", T.LongType()),
        T.StructField("kinds", T.ArrayType(T.StringType()))]
    made = map_text(docs.drop("_new", "n_found", "kinds"), text, added, start)
    order = [c for c in docs.columns if c not in ("_new", "n_found", "kinds")]
    return made.select(
        *[F.col("_new").alias(text) if c == text else F.col(c) for c in order],
        "n_found", "kinds")


def pseudonymise_all(docs: DataFrame) -> DataFrame:
    return pseudonymise(docs.select("doc_id", "text"))
