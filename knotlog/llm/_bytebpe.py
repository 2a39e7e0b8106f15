"""A byte-level BPE vocabulary read from a public tokenizer file."""

from __future__ import annotations

import json
import re

import numpy as np
import regex

#: Fixed value: the public pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same on ASCII text, where the classes are plain ranges.
_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: What ``Vocabulary`` reads; a file that asks for anything else is refused.
_READS = {"normalizer": None, "type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_NONE = np.iinfo(np.int64).max


def default_path() -> str:
    """Where the installed public tokenizer package keeps the 50k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _letters() -> dict[str, int]:
    """The printable letter that the file format writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merge ranks by pair of ids, and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        flags = [k for x in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized") if x.get(k)]
        asked = {"normalizer": spec.get("normalizer"), "type": pre.get("type"), "add_prefix_space": pre.get("add_prefix_space"), "use_regex": pre.get("use_regex", True)}
        model = {k: v for k, v in spec["model"].items() if k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") and v}
        if asked != _READS or model or flags and set(flags) != {"normalized"}:
            raise ValueError(f"{path}: not a plain byte-level BPE file: {asked}, {model}, {flags}")
        letters = _letters()
        vocab = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.token = [b""] * size
        for text, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in text)
        self.special = special
        for text, i in special.items():
            self.token[i] = text.encode()
        self.byte = np.zeros(256, np.int64)
        for i in vocab.values():
            if len(self.token[i]) == 1:
                self.byte[self.token[i][0]] = i
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        pairs = np.array([a * size + b for a, b in self.merge], np.int64)
        order = np.argsort(pairs)
        self.pairs, merged = pairs[order], np.array(list(self.merge.values()), np.int64).reshape(-1, 2)[order]
        self.rank, self.made = merged[:, 0], merged[:, 1]
        #: inside[a, b]: byte b follows byte a somewhere inside a token.
        self.inside = np.zeros((256, 256), bool)
        for i in vocab.values():
            t = np.frombuffer(self.token[i], np.uint8)
            self.inside[t[:-1], t[1:]] = True
        self.find = regex.compile(PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")").split if special else None

    def merged(self, sym: np.ndarray, seq: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of ragged sequences of symbols, and the owner of each.

        In each round every sequence merges all places of its adjacent pair of
        lowest rank; sequences without a mergeable pair leave.  A merged symbol
        only takes part in pairs of higher rank, so this gives what merging the
        places one by one gives.
        """
        size, at_first = len(self.token), np.arange(len(sym))
        done: list[tuple[np.ndarray, ...]] = []
        while len(sym) > 1:
            key = sym[:-1] * size + sym[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            ok = (self.pairs[at] == key) & (seq[:-1] == seq[1:])
            rank = np.full(len(sym), _NONE)
            rank[:-1][ok] = self.rank[at[ok]]
            head = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.r_[head, len(sym)]))
            live = low != _NONE
            if not live.all():
                out = ~live
                done.append((at_first[out], sym[out], owner[out]))
            if not live.any():
                sym = sym[:0]
                break
            spot = np.flatnonzero(live & (rank == low))
            first = np.r_[True, np.diff(spot) > 1]  # of a chain of overlapping places
            chain = np.maximum.accumulate(np.where(first, np.arange(len(spot)), 0))
            spot = spot[(np.arange(len(spot)) - chain) % 2 == 0]
            sym[spot] = self.made[at[spot]]
            live[spot + 1] = False
            sym, seq, owner, at_first = sym[live], seq[live], owner[live], at_first[live]
        done.append((at_first[: len(sym)], sym, owner[: len(sym)]))
        at_first, sym, owner = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(at_first, kind="stable")
        return sym[order], owner[order]

    def pieces(self, text: str) -> list[tuple[str, bool]]:
        """Text between special strings, and those strings (marked)."""
        if not self.special or not any(s in text for s in self.special):
            return [(text, False)]
        return [(x, x in self.special) for x in self.split_special(text) if x]


class Pretokens:
    """Splits texts into pre-tokens as the tokenizer library does.

    The pattern's character classes follow a Unicode version, and the regex
    module's may be another than the library's.  Each character is therefore
    asked of the library once, when first seen; one that it classes otherwise
    is replaced, for the split only, by a stand-in of the library's class.
    """

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers.pre_tokenizers import ByteLevel

        self.vocabulary = vocabulary
        self.ascii = re.compile(_ASCII).findall
        self.ask = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.known: set[str] = {chr(i) for i in range(128)}
        self.other: dict[int, str] = {}
        self.odd: set[str] = set()

    def _class(self, split, c: str) -> str:
        return next((x for x in "a1!" if len(split(x + c)) == 1), "\t")

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        find = self.vocabulary.find
        chars = set(text)
        for c in chars - self.known:
            self.known.add(c)
            if (mine := self._class(self.ask, c)) != self._class(find, c):
                self.other[ord(c)] = mine
                self.odd.add(c)
        if self.odd and not chars.isdisjoint(self.odd):
            out, at = [], 0
            for piece in find(text.translate(self.other)):
                out.append(text[at : at + len(piece)])
                at += len(piece)
            return out
        return find(text)
