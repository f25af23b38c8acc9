"""Token counts with a whole-token shortcut.

Fitting (on the driver, once for a vocabulary file) proves which vocabulary strings encode alone as one token: each string that
ends a word is decoded to text and encoded by the library; those that give exactly one token form the shortcut. Counting then
normalises and splits a text as the file says, adds up the pre-tokens that are in the shortcut and merges only the others,
each distinct one once for a block, with the library's own merge model.

Only files that are normalised, split and merged like that are taken (see supported()); others are refused.

The split runs on this process's Unicode tables. Code points that they do not know (category Cn) could be classed otherwise by
the library, so texts with such a code point are encoded by the library whole.

Defined results: null and empty texts have no bytes and no tokens; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .common import appended

_READY: dict[str, "WholeTokens"] = {}
#: So many words are merged at a time: what the library returns for each is far larger than its word.
WORDS = 1024


def supported(j: dict) -> None:
    """Refuse a file whose normaliser, split, model or added tokens this counter does not follow."""

    def like(have: dict | None, want: dict) -> bool:
        return have is not None and all(have.get(k) == v for k, v in want.items())

    normal, split, model = j.get("normalizer") or {}, j.get("pre_tokenizer") or {}, j.get("model") or {}
    steps, cuts = normal.get("normalizers") or [], split.get("pretokenizers") or []
    fine = len(steps) == 3 and like(steps[0], {"type": "NFC"}) and like(steps[1], {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}) and like(steps[2], {"type": "Lowercase"})
    fine = fine and len(cuts) == 2 and like(cuts[0], {"type": "Split", "behavior": "Removed", "invert": True}) and "Regex" in cuts[0]["pattern"] and like(cuts[1], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False})
    fine = fine and like(model, {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}) and bool(model.get("end_of_word_suffix"))
    fine = fine and all(like(a, {"special": True, "normalized": False, "lstrip": False, "rstrip": False, "single_word": False}) for a in j.get("added_tokens") or [])
    if not fine:
        raise ValueError("the vocabulary is not a lower-casing BPE of words with an end mark")


class WholeTokens:
    """Counter for one BPE vocabulary (the text of its .json file) of words with an end mark and lower-casing."""

    def __init__(self, spec: str, proven: frozenset[str] | None = None):
        import regex
        from tokenizers import Tokenizer

        self.spec, j = spec, json.loads(spec)
        supported(j)
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        names = sorted((a["content"] for a in j["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        # merges alone: no normaliser, no split, no special tokens
        bare = j | {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.merge = Tokenizer.from_str(json.dumps(bare))
        self.proven = self._prove(j) if proven is None else proven

    @cached_property
    def library(self):
        """The whole tokenizer, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec)

    def _merged(self, words: list[str]) -> list[int]:
        """The number of tokens of each word."""
        return [len(e.ids) for k in range(0, len(words), WORDS) for e in self.merge.encode_batch_fast(words[k : k + WORDS], add_special_tokens=False)]

    def _prove(self, j: dict) -> frozenset[str]:
        """Vocabulary strings, as text, that encode alone as one token."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        end = j["model"]["end_of_word_suffix"]
        texts = []
        for piece in j["model"]["vocab"]:
            body = piece.removesuffix(end)
            if body != piece and body:
                try:
                    texts.append(bytes(byte[c] for c in body).decode("utf-8"))
                except (UnicodeDecodeError, KeyError):
                    continue
        return frozenset(t for t, n in zip(texts, self._merged(texts), strict=True) if n == 1)

    def count(self, texts: list[str | None]) -> list[int]:
        n, rest, owners = [0] * len(texts), {}, []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
                n[i] = len(self.library.encode(text, add_special_tokens=False).ids)
                continue
            pieces = [text]
            if self.special and (found := self.special.findall(text)):
                n[i] += len(found)
                pieces = self.special.split(text)
            for piece in pieces:
                # lower-casing goes by code point, without the rule for a final sigma
                piece = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                for word, times in Counter(self.split.findall(piece)).items():
                    if word in self.proven:
                        n[i] += times
                    else:
                        owners.append((i, rest.setdefault(word, len(rest)), times))
        if rest:
            sizes = self._merged(list(rest))
            for i, at, times in owners:
                n[i] += sizes[at] * times
        return n


def fit(path: str) -> tuple[str, frozenset[str]]:
    """The vocabulary's own text and its proven strings: a few MB at most, bounded by the vocabulary."""
    spec = checked(path)
    return spec, WholeTokens(spec).proven


def checked(path: str) -> str:
    """The vocabulary's own text, if it is of the kind that WholeTokens takes."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    supported(json.loads(spec))
    return spec


def counter(spark: SparkSession, path: str) -> Callable[[list[str | None]], list[int]]:
    """A function for workers, from texts to their numbers of tokens.

    The library is loaded and strings are proven by each worker, once: the driver would keep its memory for all later stages.
    """
    sent = spark.sparkContext.broadcast(checked(path))
    name = path

    def run(texts: list[str | None]) -> list[int]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if name not in _READY:
            _READY[name] = WholeTokens(sent.value)
        return _READY[name].count(texts)

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    counted = counter(docs.sparkSession, path)

    def run(texts: list[str | None]) -> tuple[list, list, list]:
        tokens = counted(texts)
        return [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], tokens, [t > limit for t in tokens]

    return appended(docs.select("doc_id", "text"), ["text"], run, n_bytes="long", n_tokens="long", over_limit="boolean").drop("text")
