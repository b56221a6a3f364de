"""Token counts of a byte-level BPE tokenizer by the whole-token shortcut.

The pre-tokenizer cuts a text into pieces that are merged on their own.  Offline, every vocabulary string is encoded by the
tokenizer; those that come back as the one token are proven to encode alone, so a piece equal to one of them counts one
without merging.  Only the other pieces are merged, by the tokenizer itself, and remembered in a bounded table.
"""

from __future__ import annotations

import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm.common import map_rows

#: The byte-level pre-tokenizer's fixed pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged pieces remembered in each worker; beyond it the table starts anew, which changes no count.
REMEMBERED = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary: printable Latin-1 stands for itself, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenCounter:
    """Counts tokens as the tokenizers library does, without begin, end or padding tokens."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        state = json.loads(self.tokenizer.to_str())
        pre = state["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or state["normalizer"]:
            raise ValueError("the shortcut needs a byte-level tokenizer without normalizer and prefix space")
        self.pieces = regex.compile(PIECES).findall
        # added tokens are cut out of the text before pieces are; each is one token
        added = [regex.escape(t["content"]) for t in state["added_tokens"]]
        self.added = regex.compile("|".join(sorted(added, key=len, reverse=True))) if added else None
        self.whole = frozenset(self._whole_tokens())
        self.merged: dict[str, int] = {}

    def _whole_tokens(self) -> list[str]:
        """Vocabulary strings that are one piece and that the tokenizer gives back as one token: proven, not assumed."""
        alphabet = byte_alphabet()
        strings = []
        for token in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                strings.append(bytes(alphabet[c] for c in token).decode())
            except (KeyError, UnicodeDecodeError):
                continue  # an added token, or part of a character
        strings = [s for s in strings if self.pieces(s) == [s]]
        encoded = self.tokenizer.encode_batch(strings, add_special_tokens=False)
        return [s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.added is None or not self.added.search(text):
            return self._count(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._count, parts))

    def _count(self, text: str) -> int:
        pieces = self.pieces(text)
        rest = [p for p in pieces if p not in self.whole]
        if not rest:
            return len(pieces)
        known, new = self.merged, [p for p in {*rest} if p not in self.merged]
        if len(known) + len(new) > REMEMBERED:
            known, new = {}, [*{*rest}]
            self.merged = known
        if new:
            encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            known.update((p, len(e.ids)) for p, e in zip(new, encoded, strict=True))
        return len(pieces) - len(rest) + sum(map(known.__getitem__, rest))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter a worker process and tokenizer file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row.

    ``tokenizer`` is the path of a byte-level .json file that every executor can read.  Null and empty texts have no bytes
    and tokens; texts of any length are counted whole; equal rows give equal results; other columns of ``docs`` are not read; an empty table gives no rows.
    """

    def fn(c: dict[str, list]) -> dict[str, list]:
        count = counter(tokenizer).count
        return {"doc_id": c["doc_id"], "n_bytes": c["n_bytes"], "n_tokens": [count(t) for t in c["text"]]}

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return map_rows(rows, fn, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
