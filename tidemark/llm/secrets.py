"""Secret scans: fixed patterns and a token-efficiency test.

Three base patterns find assignments, access keys and long hex runs.  The
method adds spans of kind ``random``: runs of key-like characters of which the
tiktoken vocabulary needs so many tokens that a token covers few characters.
Known digests (bare hex of a digest's length), UUIDs, numbers, words, paths
and other identifiers are excluded before the test, and what a base span covers already is left out.

Edge cases: null and empty texts have no spans; spans are in code points;
repeated rows and further columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from hashlib import sha256

import tiktoken
from pyspark.sql import DataFrame

from .common import free_name, map_rows

KINDS = ["assign", "access", "hex", "random"]
#: Fixed patterns of the base kinds; ASCII letters only, in either case for the keywords.
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so short ones need not be matched first
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Runs that may be a key: at least so long; shorter ones outside of an assignment are not tested.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\Z")
_PLAIN = re.compile(r"(?:[0-9+/_=-]+|(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[/_=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[/_=+-]*)\Z")


def vocabulary(path: str | None) -> tiktoken.Encoding:
    """The vocabulary of a file; each task reads it anew, so that workers keep none."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    folded = text.lower() if text.isascii() else text.translate(_LOWER)
    if any(k in folded for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


_LOWER = {c: c + 32 for c in range(65, 91)}


def is_random(run: str, encoding: tiktoken.Encoding, ratio: float, letters_ratio: float) -> bool:
    """Whether a run has under ``ratio`` characters a token and is no known kind of name.

    Runs of letters in both cases without a digit must be under ``letters_ratio``.
    """
    if len(run) in _DIGEST_SIZES and _DIGEST.match(run) or _UUID.match(run) or _PLAIN.match(run):
        return False
    lower, upper, digit = (re.search(c, run) for c in ("[a-z]", "[A-Z]", "[0-9]"))
    if digit and (lower or upper):
        return len(run) < ratio * len(encoding.encode_ordinary(run))
    return bool(lower and upper) and len(run) < letters_ratio * len(encoding.encode_ordinary(run))


def spans(text: str, encoding: tiktoken.Encoding, ratio: float = 2.0, letters_ratio: float = 1.6) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end), sorted."""
    base = sorted(base_spans(text))
    found, k, reach = list(base), 0, 0  # reach: the furthest end of the base spans that start at or before the run
    for m in _RUN.finditer(text):
        a, b = m.span()
        while k < len(base) and base[k][0] <= a:
            reach = max(reach, base[k][2])
            k += 1
        if reach < b and is_random(m[0], encoding, ratio, letters_ratio):
            found.append((a, 3, b))
    return sorted(found)


def scan(df: DataFrame, keep: list[str], text: str = "text", ratio: float = 2.0, path: str | None = None) -> DataFrame:
    """``keep`` and the spans of every text: array of (kind, start, end)."""

    def make():
        encoding = vocabulary(path)

        def work(texts):
            for t in texts:
                yield ([(KINDS[k], a, b) for a, k, b in spans((t or b"").decode(), encoding, ratio)],)

        return work

    return map_rows(df, [text], "spans array<struct<kind string, start long, end long>>", make, keep=keep)


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by the name of its kind."""
    out, at = [], 0
    for a, k, b in sorted(found, key=lambda s: (s[0], -s[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{KINDS[k]}]" if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text", ratio: float = 2.0, path: str | None = None) -> DataFrame:
    """``docs`` with the secrets in ``text`` masked; all rows and columns stay."""
    names = docs.columns

    def make():
        encoding = vocabulary(path)

        def work(texts):
            for t in texts:
                if t is None:
                    yield (None,)
                    continue
                t = t.decode()
                found = spans(t, encoding, ratio)
                yield (masked(t, found) if found else t,)

        return work

    new = free_name(docs, "_masked")
    done = map_rows(docs, [text], f"`{new}` string", make)
    return done.select(*[done[f"`{new}`"].alias(c) if c == text else done[f"`{c}`"] for c in names])


def digest(found: list[tuple[int, int, int]]) -> str:
    return sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)).encode()).hexdigest()
