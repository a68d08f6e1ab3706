"""Exact token ids of whole texts, by the tokenizers library, with a memo of pieces.

Both supported kinds of vocabulary cut a text at white space before merging:
no merge crosses such a cut. A worker therefore encodes each distinct piece once and
joins the stored ids. Pieces of Latin letters are one pre-token, for which ``LetterMerges`` merges
bytes by the same ranks at a lower cost than a call of the library; it is checked against the library when loaded. Texts in which a cut could matter (a special string's
start, white space or separators beyond ASCII) are encoded whole by the library, as is
everything under a vocabulary of another kind.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Callable
from functools import cache
from importlib.metadata import version

#: Entries of the memo in one worker; what comes later is encoded each time. Frequent pieces come early.
MEMO_ENTRIES = 400_000
#: Longer pieces are not kept.
LONG_PIECE = 48

_ODD = re.compile("<\\||[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
#: Latin letters without the dotted capital I: its lower case ends in a combining mark, which clings to what follows.
_LATIN = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+"
#: A run of them before plain punctuation is a piece of its own in both kinds.
_LETTERS = rf"{_LATIN}(?=[\s,.;:!?]|\Z)"
_SPACED = re.compile(rf" ?{_LETTERS}| ?[^\s]+|\s+(?!\S)|\s+", re.ASCII)
_WORDS = re.compile(rf"{_LETTERS}|[^\s]+", re.ASCII)
_ONLY_LETTERS = re.compile(f" ?{_LATIN}")
_SPLIT_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _kind(spec: dict) -> str:
    """How pieces may be cut: ``spaced`` keeps white space, ``words`` drops it, ``whole`` means not at all."""
    before = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    if model.get("type") != "BPE" or model.get("dropout") or any(not x.get("special") or x.get("lstrip") or x.get("rstrip") or x.get("single_word") or "<|" != x["content"][:2] for x in spec.get("added_tokens", [])):
        return "whole"
    if spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "spaced"
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    cut = (before.get("pretokenizers") or [{}])[0]
    if steps == ["NFC", "Replace", "Lowercase"] and cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert") and cut["pattern"].get("Regex") == _SPLIT_WORDS:
        return "words"
    return "whole"


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class LetterMerges:
    """Ids of one pre-token of letters.

    Ranks are ids: single bytes, then (where words end in a suffix) last bytes with the suffix, then merges in
    order. The suffix becomes a byte that UTF-8 never has. Two symbols whose concatenation is a
    token are always the two that its merge names, so that ranks of tokens can stand for ranks of pairs.
    """

    END = b"\xff"

    def __init__(self, spec: dict, kind: str) -> None:
        import tiktoken

        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.lower = kind == "words"
        special = {x["content"] for x in spec.get("added_tokens", [])}
        byte_of = _byte_of()
        ranks: dict[bytes, int] = {}
        for token, number in spec["model"]["vocab"].items():
            if token in special:
                continue
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            ranks[bytes(byte_of[c] for c in body) + (self.END if ends else b"")] = number
        first = 512 if self.suffix else 256
        merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        if any(spec["model"]["vocab"][a + b] != first + i for i, (a, b) in enumerate(merges)) or len(ranks) != first + len(merges):
            raise ValueError("ids don't follow the order of merges")
        self.core = tiktoken.Encoding("letters", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __call__(self, piece: str) -> bytes:
        raw = piece.lower().encode() + self.END if self.suffix else piece.encode()
        ids = self.core.encode_single_piece(raw)
        return struct.pack(f"<{len(ids)}I", *ids)


class _Memo(dict):
    """Ids of pieces; a piece that is missing is encoded when asked for."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= LONG_PIECE and len(self) < MEMO_ENTRIES:
            self[piece] = ids
        return ids


class Codec:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kind = _kind(spec)
        #: All ids fit in 16 bits.
        self.small = max([*spec["model"].get("vocab", {0: 1 << 20}).values(), *(x["id"] for x in spec.get("added_tokens", []))]) < 1 << 16
        self.letters = self._letters(spec)
        self.memo = _Memo(self._piece)

    def _letters(self, spec: dict) -> LetterMerges | None:
        if self.kind == "whole" or (self.kind == "words") != bool(spec["model"].get("end_of_word_suffix")):
            return None
        try:
            merges = LetterMerges(spec, self.kind)
        except (ValueError, KeyError, ImportError):
            return None
        tokens = [x for x in (t.replace("</w>", "") for t in list(spec["model"]["vocab"])[::97]) if _ONLY_LETTERS.fullmatch(x)]
        probe = [a + b for a, b in zip(tokens, tokens[1:] + tokens[:1], strict=True)] + tokens
        return merges if [merges(x) for x in probe] == self._direct(probe) else None

    def _direct(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str] | None:
        """The pieces, or None where the text must be encoded whole."""
        if self.kind == "whole" or _ODD.search(text):
            return None
        if self.kind == "spaced":
            return _SPACED.findall(text)
        return _WORDS.findall(text.lower() if text.isascii() else text)

    def _one(self, text: str) -> bytes:
        pieces = self._cut(text)
        return self._direct([text])[0] if pieces is None else b"".join(map(self.memo.__getitem__, pieces))

    def _piece(self, piece: str) -> bytes:
        if self.letters is not None and _ONLY_LETTERS.fullmatch(piece):
            return self.letters(piece)
        return self._direct([piece])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Null counts as the empty text."""
        return [self._one(x) if x else b"" for x in texts]


@cache
def codec(path: str) -> Codec:
    """One codec a worker and vocabulary."""
    return Codec(path)


def tokenizer_version(path: str) -> str:
    """Hex digest of the vocabulary file and the library's version, read on the driver."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + b"\0tokenizers " + version("tokenizers").encode()).hexdigest()
