"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that can end its BPE
encoding.  An automaton of the vocabulary with suffix links reads the word once
and reports, for each prefix, the tokens that are its suffixes, longest first;
the one that is compatible with the last token of the prefix before it is
stored, and following these back from the whole word gives the ids.  Two tokens are compatible if merging their joint text yields just the
two, which is read off the merges that cross their border.

Chunks are encoded once and kept in a table of bounded bytes, which is emptied
at the end of a task; texts are split into white-space-free chunks first, since
no token spans white space.

Edge cases: null is the empty text, which has no ids and decodes to the empty
text; the strings of special tokens are those tokens wherever they stand;
repeated rows and further columns pass through.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import map_rows

#: The byte-to-character table of byte-level BPE: printable bytes stand for
#: themselves, the others follow from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_FROM_CHARS = {c: b for b, c in BYTE_CHARS.items()}
#: The last character of a word is a symbol of its own, moved by this much.
_END = 0x1000
#: Stands for no token before the first one.
NONE = 1 << 31
#: Pairs of tokens whose test is kept.
MAX_PAIRS = 1 << 17
#: White space as the normalizer's pattern has it (Python's split knows four more).
_MORE_SPACE = regex.compile(r"[\x1c-\x1f]")
#: Characters whose case, class and composition differ between Unicode versions lie above.
_RARE = regex.compile(r"[^\x00-\u024f]")
_SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memo:
    """A table of bounded bytes that forgets what has not been used for long.

    Two generations: a full young one becomes the old one, and what is read
    from the old one is young again.  Keys of 64 and more are not kept.
    """

    #: Bytes of an entry besides its strings: their objects and the place in the table.
    ENTRY = 140

    def __init__(self, max_bytes: int):
        self.half, self.held = max_bytes // 2, 0
        self.young, self.old = {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(key) < 64:
            self.held += self.ENTRY + len(key) + len(value)
            if self.held > self.half:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[key] = value
        return value

    def clear(self):
        self.young, self.old, self.held = {}, {}, 0


class WordBpe:
    """A tokenizer with word ends, read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str, max_bytes: int = 48 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["byte_fallback"] or model["end_of_word_suffix"] is None or spec["decoder"] is not None:
            raise ValueError(f"{path} is no byte-level BPE with word ends")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        self.raw = {i: t.encode() for i, t in self.text.items()}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        suffix = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        #: token: (rank of the merge that makes it, left part, right part)
        self.made: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, t) in self.merged.items():
            self.made.setdefault(t, (rank, a, b))
        self.suffix = suffix
        # tokens as they end a word, or not: the last symbol of a word is another one
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in vocab.items():
            if t.endswith(suffix):
                body = t[: -len(suffix)]
                t = body[:-1] + chr(ord(body[-1]) + _END)
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        #: symbols in each token
        self.size = [0] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.size[i] = len(t) - len(suffix) * t.endswith(suffix)
        self.known = Memo(max_bytes)
        # the library's normalizer and splitter, without its model
        rest = spec | {"model": model | {"vocab": {suffix: 0}, "merges": []}, "added_tokens": [], "post_processor": None}
        library = Tokenizer.from_str(json.dumps(rest))
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.pairs: dict[int, bool] = {}

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens' joint text as these two tokens.

        Undo the later of the two tokens' merges, step by step.  A merge across
        the border that comes before the step undone last would have won.
        """
        merged, made = self.merged, self.made
        # the first merge that has not been undone yet; ties go to the left
        limit, limit_left = 1 << 60, True
        while True:
            across = merged.get((left, right))
            if across is not None and (across[0] < limit or (across[0] == limit and not limit_left)):
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, limit_left, left = a[0], True, a[2]
            else:
                limit, limit_left, right = b[0], False, b[1]

    def fits(self, left: int, right: int) -> bool:
        """``_compatible``, kept for pairs of tokens; nothing stands before the first token."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        ok = self.pairs[left << 32 | right] = left == NONE or self._compatible(left, right)
        return ok

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token (already normalized, in UTF-8)."""
        chars = word.decode("latin-1").translate(BYTE_CHARS)
        symbols = chars[:-1] + chr(ord(chars[-1]) + _END)
        n = len(symbols)
        last = [-1] * (n + 1)  # the last token of each prefix
        last[0] = NONE
        known, size = self.pairs.get, self.size
        for end, token in self.automaton.iter(symbols):
            end += 1
            if last[end] < 0 and (left := last[end - size[token]]) >= 0:
                ok = known(left << 32 | token)
                if self.fits(left, token) if ok is None else ok:
                    last[end] = token
        out = []
        while n:
            out.append(last[n])
            n -= size[last[n]]
        return out[::-1]

    def words_of(self, chunk: str) -> list[str]:
        """Pre-tokens of a normalized chunk below U+0250, where isalpha() is the pattern's class of letters."""
        return [chunk] if chunk.isalpha() else self.pattern.findall(chunk)

    def ids_of(self, words: list[str]) -> bytes:
        """Packed ids of the pre-tokens of a chunk."""
        if len(words) == 1:
            return array("I", self.encode_word(words[0].encode())).tobytes()
        known, out = self.known, []
        for w in words:
            ids = known.get(w)
            out.append(known.put(w, array("I", self.encode_word(w.encode())).tobytes()) if ids is None else ids)
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens.

        Below U+0250 case and composition depend on no neighbour, so the text
        is normalized at once and its chunks are looked up as they then are.
        """
        known = self.known
        if _RARE.search(text):
            out = []
            for c in _SPACES.split(text):
                if not _RARE.search(c):
                    out.append(self.plain(c))
                    continue
                key = "\0" + c  # by the library's own Unicode tables
                ids = known.get(key)
                if ids is None:
                    ids = known.put(key, self.ids_of([bytes(map(_FROM_CHARS.__getitem__, w)).decode() for w, _ in self.split(self.normalize(c))]))
                out.append(ids)
            return b"".join(out)
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
        chunks = _SPACES.split(text) if _MORE_SPACE.search(text) else text.split()
        out = list(map(known.young.get, chunks))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    c = chunks[i]
                    ids = known.get(c)
                    out[i] = known.put(c, self.ids_of(self.words_of(c))) if ids is None else ids
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit integers."""
        if "<|" not in text or not self.special_pattern:
            return self.plain(text)
        special = self.special
        return b"".join([array("I", [special[part]]).tobytes() if part in special else self.plain(part) for part in self.special_pattern.split(text)])

    def forget(self) -> None:
        """Empty the tables."""
        self.known.clear()
        self.pairs.clear()

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.packed(text or "")).tolist()

    def decode(self, ids) -> str:
        """The tokens of the ids joined by spaces (the file names no decoder)."""
        return " ".join(map(self.text.__getitem__, ids))


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordBpe:
    """One tokenizer per worker process; each task ends by forgetting the words it met."""
    return WordBpe(path)


def encode(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` and ``ids`` (array of ints) of every text."""
    path = path or default_vocabulary()

    def make():
        bpe = tokenizer(path)

        def work(texts):
            for t in texts:
                yield (bpe.encode((t or b"").decode()),)

        return work

    return map_rows(df, [text], "ids array<int>", make, keep=keep, finish=lambda: tokenizer(path).forget())


def decode(df: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """``keep`` and the ``decoded`` text of every array of ids; null has none."""
    path = path or default_vocabulary()

    def make():
        bpe = tokenizer(path)

        def work(rows):
            for r in rows:
                yield (None if r is None else bpe.decode(r),)

        return work

    return map_rows(df, [ids], "decoded string", make, keep=keep)


def digests(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``keep``, ``n_tokens``, SHA-256 of the packed ids and of the decoded text.

    ``with_ids`` adds the ids themselves.
    """
    path = path or default_vocabulary()

    def make():
        bpe = tokenizer(path)
        raw = bpe.raw.__getitem__

        def work(texts):
            for t in texts:
                ids = bpe.packed((t or b"").decode())
                decoded = b" ".join(map(raw, array("I", ids)))
                row = len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded).hexdigest()
                yield (*row, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else row

        return work

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_rows(df, [text], schema, make, keep=keep, finish=lambda: tokenizer(path).forget())
