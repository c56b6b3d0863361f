"""Public tokenizer files inside tasks: ids of texts, and the bytes behind the ids."""

from __future__ import annotations

import hashlib
import json
import sys
import types
from collections.abc import Callable
from functools import cached_property
from typing import Any

import numpy as np
import tiktoken

# Fixed value: how byte-level BPE of this kind cuts a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: how pieces write a space.
PIECE_SPACE = "▁"


def once_per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """What `make` returns, made once in each Python worker however many tasks it runs.

    This package's modules travel with the job and are rebuilt by every task, so what
    should outlive a task is kept in a module of its own.
    """
    held = sys.modules.setdefault("_held_by_worker", types.ModuleType("_held_by_worker"))
    if key not in held.__dict__:
        held.__dict__[key] = make()
    return held.__dict__[key]


def file_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class JsonVocabulary:
    """A `.json` file of `tokenizers`.

    For byte-level BPE whose merges are numbered in the order in which they apply,
    `tiktoken` reads the same merges, gives the same ids and is several times faster;
    a text that holds a special token, and any text under another kind of vocabulary,
    goes to `tokenizers` itself.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.fast = self._merges(stored)
        self.byte_level = (stored["pre_tokenizer"] or {}).get("type") == "ByteLevel"
        self.words = stored["model"]["vocab"]

    @cached_property
    def library(self):  # noqa: ANN201 - only loaded where it is needed
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        return made

    @cached_property
    def library_plain(self):  # noqa: ANN201
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        made.encode_special_tokens = True
        return made

    def _merges(self, stored: dict) -> tiktoken.Encoding | None:
        model, cut = stored["model"], stored["pre_tokenizer"] or {}
        known = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if stored["normalizer"] or any(cut.get(k) != v for k, v in known.items()):
            return None
        ids = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if [ids.get(m.replace(" ", "")) for m in merged] != list(range(256, 256 + len(merged))):
            return None
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in ids.items()}
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """As the library gives them, special strings inside the text as it does by default."""
        if any(t in text for t in self.special):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.plain_ids(text)

    def plain_ids(self, text: str) -> np.ndarray:
        """With special strings inside the text as ordinary text."""
        if self.fast is not None:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.asarray(self.library_plain.encode(text, add_special_tokens=False).ids, "<u4")

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """By id, the bytes a token stands for."""
        letters = byte_letters()
        out = [b""] * (max([*self.words.values(), *self.special.values()]) + 1)
        for token, i in self.words.items():
            known = self.byte_level and token not in self.special and all(c in letters for c in token)
            out[i] = bytes(letters[c] for c in token) if known else token.encode()
        for token, i in self.special.items():
            out[i] = token.encode()
        return out


class PieceVocabulary:
    """A `.model` file of `sentencepiece`, which has no strings with a special meaning."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text), "<u4")

    plain_ids = ids

    @cached_property
    def token_bytes(self) -> list[bytes]:
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        return [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(PIECE_SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]


Vocabulary = JsonVocabulary | PieceVocabulary


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each Python worker."""
    kind = PieceVocabulary if path.endswith(".model") else JsonVocabulary
    return once_per_worker((kind.__name__, path), lambda: kind(path))
