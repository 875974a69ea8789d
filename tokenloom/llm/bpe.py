"""Operator 5: BPE encoding and decoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens by successive merge gadgets.
It starts with one arc per byte from every state. The gadget of the merge (u, v) -> w takes the
arc v away from the state behind u, and gives the arc w to each state that has the arc u; the
state behind w starts as a copy of the state behind v. The sequences the last automaton accepts
are exactly the tokenizations that the merges yield. So a state is known by the last token, and
an arc's presence follows from the order of the gadgets (arc()); every arc that is asked for is
kept in the transition table. A pre-split word is encoded by running the automaton over the
tokens that a byte trie finds, and decoded by emitting the arcs' labels.

Nulls and empty texts have no tokens. A special token's string in a text is that token, as in the
tokenizers library. Texts are processed whole; the caches of words and arcs are bounded.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Words and arcs that are remembered; a full table is emptied (results don't change).
MAX_WORDS, MAX_ARCS = 1 << 20, 1 << 20
#: Two white-space characters side by side, or one that is neither space nor line break.
IRREGULAR = ("  ", "\n\n", " \n", "\n ", *(chr(c) for c in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
STOPS = (".", ",", "!", "?", ";", ":")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges. State -1 is the start; any other state is the token that leads to it."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_alphabet()
        size = max([*vocab.values(), *special.values(), 0]) + 1
        self.label = [b""] * size
        for piece, i in vocab.items():
            self.label[i] = bytes(letters[c] for c in piece)
        for text, i in special.items():
            self.label[i] = text.encode()
        self.rank = [-1] * size
        self.left, self.right = [-1] * size, [-1] * size
        self.gadget: dict[tuple[int, int], int] = {}
        self.table: dict[int, bool] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.final = [-1]
        reached = [False] * size
        for piece, i in vocab.items():
            if len(self.label[i]) == 1:
                reached[i] = True
        for k, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.rank[w] >= 0 or (u, v) in self.gadget:
                continue
            # The gadget finds something to do only where the state behind u still has the arc v.
            reached[w] = reached[u] and reached[v] and self._has(u, v, k - 1)
            self.gadget[u, v] = k
            self.rank[w], self.left[w], self.right[w] = k, u, v
        for i, ok in enumerate(reached):
            if ok:
                self._insert(self.label[i], i)
        self.special = special
        self.find_special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.size = [len(x) for x in self.label]
        self.newline = self._pieces("\n")

    @classmethod
    def load(cls, path: str) -> "Automaton":
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
        return cls(j["model"]["vocab"], merges, {t["content"]: t["id"] for t in j.get("added_tokens", [])})

    def _insert(self, label: bytes, token: int) -> None:
        at = 0
        for b in label:
            nxt = self.trie[at].get(b)
            if nxt is None:
                nxt = len(self.trie)
                self.trie[at][b] = nxt
                self.trie.append({})
                self.final.append(-1)
            at = nxt
        self.final[at] = token

    def _has(self, s: int, t: int, time: int) -> bool:
        """Does the state behind s have the arc t once the gadgets up to time are in place?"""
        rank, gadget = self.rank, self.gadget
        while True:
            k = gadget.get((s, t))
            if k is not None and k <= time:
                return False  # that gadget took it away
            if rank[t] >= rank[s] and rank[t] >= 0:  # t came later (or is s): its gadget gave it where there was the arc of its left part
                time = rank[t]
                t = self.left[t]
            elif rank[s] < 0:
                return True
            else:  # s came later: a copy of the state behind its right part
                time = rank[s] - 1
                s = self.right[s]

    def arc(self, s: int, t: int) -> bool:
        key = s << 32 | t
        got = self.table.get(key)
        if got is None:
            if len(self.table) >= MAX_ARCS:
                self.table.clear()
            got = self.table[key] = self._has(s, t, 1 << 60)
        return got

    def run(self, word: bytes) -> list[int]:
        """The one accepted sequence of tokens that spells word.

        behind[i] is the state after the first i bytes where those are accepted. Of the tokens that
        end at i exactly one has an arc from the state where it begins, so states lead back.
        """
        n = len(word)
        behind = [-1] * (n + 1)
        trie, final, table = self.trie, self.final, self.table
        for i in range(n):
            s = behind[i]
            if i and s < 0:
                continue
            row, node = s << 32, trie[0]
            for j in range(i, n):
                at = node.get(word[j])
                if at is None:
                    break
                t = final[at]
                if t >= 0 and behind[j + 1] < 0:
                    ok = table.get(row | t) if i else True
                    if ok or (ok is None and self.arc(s, t)):
                        behind[j + 1] = t
                node = trie[at]
                if not node:
                    break
        out, i, size = [], n, self.size
        while i:
            t = behind[i]
            out.append(t)
            i -= size[t]
        return out[::-1]

    def _pieces(self, text: str) -> bytes:
        return b"".join([pack(f"<{len(t)}I", *t) for t in map(self.run, map(str.encode, SPLIT.findall(text)))])

    def _chunk(self, memo: dict[str, bytes], key: str, lead: str) -> bytes:
        """Ids of lead + key. Behind a letter or digit a final stop or comma is a piece of its own, so
        that the word is found or remembered without it."""
        got = memo.get(key)
        if got is None:
            if key[-1:] in STOPS and key[-2:-1].isalnum():
                return self._chunk(memo, key[:-1], lead) + self._chunk(self.words, key[-1], "")
            if len(memo) >= MAX_WORDS:
                memo.clear()
            got = self._pieces(lead + key)
            if len(key) <= 64:
                memo[key] = got
        return got

    def _plain(self, text: str, out: list[bytes]) -> None:
        """The split never joins what a lone space or line break between other characters parts, so
        each chunk between those is split and run by itself, and remembered."""
        if text[:1].isspace() or text[-1:].isspace() or any(x in text for x in IRREGULAR):
            out.extend([self._chunk(self.words, p, "") for p in SPLIT.findall(text)])
            return
        later = self.spaced
        for k, line in enumerate(text.split("\n") if text else ()):
            if k:
                out.append(self.newline)
            chunks = line.split(" ")
            out.append(self._chunk(self.words, chunks[0], ""))
            del chunks[0]
            ids = list(map(later.get, chunks))
            if None in ids:
                ids = [self._chunk(later, c, " ") if x is None else x for c, x in zip(chunks, ids)]
            out.extend(ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        for m in self.find_special.finditer(text) if any(s in text for s in self.special) else ():
            self._plain(text[at : m.start()], out)
            out.append(np.array([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text in UTF-8: the labels of the arcs, with what isn't UTF-8 replaced."""
        raw = b"".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


_LOADED: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """Compiled once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Automaton.load(path)
    return _LOADED[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    path: a byte-level BPE file of the tokenizers library, readable on every executor.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for b in batches:
            n, ids_hash, text_hash, kept = [], [], [], []
            for value in b.column(1):
                ids = a.encode(value.as_py() or "")
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(a.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    extra = ", ids array<int>" if with_ids else ""
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
