"""Tokenizers of the public `tokenizers` library behind one interface. Executors get the JSON text once per worker."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

import numpy as np

from .errors import EngineError

EOS_NAMES = ("<|endoftext|>", "</s>", "<|end_of_text|>", "<eos>", "[EOS]", "<|im_end|>")
BOS_NAMES = ("<s>", "<|begin_of_text|>", "<bos>", "[BOS]", "<|startoftext|>")


def canonical(value: object) -> str:
    """JSON with sorted keys, without spaces, non-ASCII kept."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


class TokenizerLike(Protocol):
    """What a writer asks of a tokenizer; objects must travel to executors by pickling."""

    vocab_size: int
    eos_id: int | None
    bos_id: int | None

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]: ...
    def fingerprint(self) -> str: ...
    def text(self) -> str: ...


@dataclass
class HubTokenizer:
    """A `tokenizers` model as text; truncation and padding are removed."""

    json_text: str
    eos_id: int | None = None
    bos_id: int | None = None
    notes: list[str] = field(default_factory=list)
    _loaded: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    @property
    def model(self):
        if self._loaded is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
            from tokenizers import Tokenizer

            self._loaded = Tokenizer.from_str(self.json_text)
        return self._loaded

    @property
    def vocab_size(self) -> int:
        return self.model.get_vocab_size(with_added_tokens=True)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def fingerprint(self) -> str:
        """First 16 hexadecimal digits of the SHA-256 of the canonical JSON."""
        return hashlib.sha256(canonical(json.loads(self.json_text)).encode()).hexdigest()[:16]

    def text(self) -> str:
        return self.json_text

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids, skip_special_tokens=False)


def resolve(given: object, eos_token: str | None = None, bos_token: str | None = None) -> HubTokenizer:
    """A tokenizers.Tokenizer, a path of tokenizer.json (or a folder with it), or a HubTokenizer as it is."""
    if isinstance(given, HubTokenizer):
        return given
    settings: dict = {}
    if isinstance(given, (str, Path)):
        at = Path(given)
        at = at / "tokenizer.json" if at.is_dir() else at
        if not at.is_file():
            raise EngineError("C311", f"{at} doesn't exist")
        text = at.read_text(encoding="utf-8")
        side = at.parent / "tokenizer_config.json"
        if side.is_file():
            settings = json.loads(side.read_text(encoding="utf-8"))
    elif hasattr(given, "to_str") and hasattr(given, "encode_batch"):
        text = given.to_str()
    else:
        raise EngineError("K205", f"{type(given).__name__} is no tokenizer", fix="give a tokenizers.Tokenizer or the path of its JSON")
    j = json.loads(text)
    j["truncation"] = j["padding"] = None
    out = HubTokenizer(json.dumps(j, ensure_ascii=False))
    out.eos_id = _special(out, eos_token, settings.get("eos_token"), EOS_NAMES, "EOS")
    out.bos_id = _special(out, bos_token, settings.get("bos_token"), BOS_NAMES, "BOS")
    return out


def _special(t: HubTokenizer, explicit: str | None, configured: object, names: tuple[str, ...], kind: str) -> int | None:
    """An explicit token, else the configured one, else the one well-known name that the vocabulary has."""
    if explicit is not None:
        at = t.model.token_to_id(explicit)
        if at is None:
            raise EngineError("K206", f"the vocabulary has no token {explicit!r}")
        return at
    if isinstance(configured, dict):
        configured = configured.get("content")
    if isinstance(configured, str) and (at := t.model.token_to_id(configured)) is not None:
        return at
    found = {at for n in names if (at := t.model.token_to_id(n)) is not None}
    if len(found) > 1:
        t.notes.append(f"several tokens could be {kind}; none is used")
    return found.pop() if len(found) == 1 else None


def item_type(vocab_size: int, asked: str | None = None) -> str:
    """The narrowest of uint8, uint16 and uint32 for ids below vocab_size, or a wider one that is asked for."""
    if not 1 <= vocab_size <= 1 << 32:
        raise EngineError("K207", f"a vocabulary of {vocab_size} entries", "1 to 2**32 are possible")
    narrow = "uint8" if vocab_size <= 1 << 8 else "uint16" if vocab_size <= 1 << 16 else "uint32"
    if asked is None:
        return narrow
    if asked not in ("uint8", "uint16", "uint32") or np.dtype(asked).itemsize < np.dtype(narrow).itemsize:
        raise EngineError("C303", f"{asked} doesn't hold {vocab_size} ids", fix=f"use {narrow} or wider")
    return asked
